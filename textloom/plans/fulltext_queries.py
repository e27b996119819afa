"""Queries of full-text search. Lines of documents are chunks; words of benchmark passages are put into queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stemming
from ..operators import fulltext as T
from ..sources.tables import read
from .retrieval_queries import _LINES, _QUESTIONS, _chunks, _ordered_terms, _questions


def _grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of five kinds from the first words of passages."""
    w = F.split("text", " ")
    at = lambda k: F.coalesce(F.get(w, F.lit(k - 1)), F.lit(""))
    kinds = [
        F.concat(F.lit('"'), at(3), F.lit(" "), at(4), F.lit('" '), at(1)),
        F.concat(at(2), F.lit(" or "), at(5), F.lit(" -"), at(1)),
        F.concat(at(1), F.lit(' -"'), at(2), F.lit(" "), at(3), F.lit('"')),
        F.concat(at(1), F.lit(" "), at(2), F.lit(" "), at(3)),
        F.concat(F.lit('"'), at(1), F.lit(" "), at(2), F.lit(" "), at(3), F.lit('" OR '), at(6), F.lit(" "), at(7)),
    ]
    text = F.lit(None).cast("string")
    for k, kind in enumerate(kinds):
        text = F.when(F.col("question_id") % len(kinds) == k, kind).otherwise(text)
    return _questions(spark, sf_dir).select("question_id", text.alias("text"))


def _index(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    return T.postings(_chunks(spark, sf_dir), asked)


def stemmed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _index(spark, sf_dir).groupBy("stem").agg(F.count("*").alias("n_chunks"), F.sum(F.size("positions")).alias("n"))
    return rows


def positional_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each chunk's postings: how many, and where."""
    places = F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = _index(spark, sf_dir).select("doc", "stem", F.size("positions").alias("n"), places.alias("at"))
    # Positions are added up where they stand; the stems of a document come together before they are counted.
    each = rows.groupBy("doc", "stem").agg(F.sum("n").alias("n"), F.sum("at").alias("at"))
    return each.groupBy("doc").agg(F.sum("n").alias("n"), F.count("stem").alias("n_stems"), F.sum("at").alias("places"), F.sum(F.col("at") * F.length("stem")).alias("weighed"))


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with any of a question's words, by cover density: every place of a word is a cover."""
    asked = T.queries(T.either_words(_questions(spark, sf_dir)))
    return T.leg(T.matches(_index(spark, sf_dir, asked), asked)).withColumn("rank", F.col("rank").cast("long"))


def covered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with all of the first three words of a passage, by cover density."""
    asked = _questions(spark, sf_dir).select("question_id", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("text"))
    asked = T.queries(asked)
    return T.leg(T.matches(_index(spark, sf_dir, asked), asked)).withColumn("rank", F.col("rank").cast("long"))


def grammar_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks that fulfil queries with phrases, alternatives and exclusions."""
    asked = T.queries(_grammar(spark, sf_dir))
    return T.matches(_index(spark, sf_dir, asked), asked, ranked=False).select("question_id", "doc", "ord")


def two_leg_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _grammar(spark, sf_dir)
    rows = T.search(_index(spark, sf_dir, T.both_legs(asked)), asked)
    return rows.select("question_id", "doc", "ord", F.col("rank").cast("long").alias("rank"))


QUERIES = {
    "stemmed_words": stemmed_words,
    "positional_postings": positional_postings,
    "ranked_search": ranked_search,
    "covered_search": covered_search,
    "grammar_search": grammar_search,
    "two_leg_search": two_leg_search,
}


def _cases(column: str, pairs: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + " END"


def _ends(endings: object) -> str:
    return "(" + "|".join(endings) + ")$"


_REGION, _SHORT = "^[^aeiouy]*[aeiouy]+[^aeiouy]", "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
_BODY = "w[1:length(w) - length(e)]"


def _stems_sql(words: str) -> str:
    """CTEs that end in stems(word, stem), of the relation ``words`` with a column word. The step rules, a step for each CTE."""
    s = stemming
    in_region = lambda r: f"length(w) - length(e) >= {r}"
    stop = ", ".join(f"'{w}'" for w in sorted(T.STOPWORDS))
    whole = ", ".join(f"'{w}'" for w in s.WHOLE)
    return rf"""st0 AS (SELECT word, CASE WHEN word[1] = 'y' THEN 'Y' || word[2:] ELSE word END AS w FROM {words}),
    st1 AS (SELECT word, regexp_replace(w, '([aeiouy])y', '\1Y', 'g') AS w FROM st0),
    st2 AS (SELECT *, CASE WHEN regexp_matches(w, '^({"|".join(s.FIRST_REGION)})') THEN length(regexp_extract(w, '^({"|".join(s.FIRST_REGION)})')) ELSE coalesce(nullif(length(regexp_extract(w, '{_REGION}')), 0), length(w)) END AS r1 FROM st1),
    st3 AS (SELECT *, coalesce(r1 + nullif(length(regexp_extract(w[r1 + 1:], '{_REGION}')), 0), length(w)) AS r2 FROM st2),
    st4 AS (SELECT word, r1, r2, CASE WHEN w LIKE '%sses' THEN w[1:length(w) - 2] WHEN regexp_matches(w, '(ied|ies)$') THEN w[1:length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END]
        WHEN w LIKE '%s' AND NOT regexp_matches(w, '(us|ss)$') AND regexp_matches(w[1:length(w) - 2], '[aeiouy]') THEN w[1:length(w) - 1] ELSE w END AS w FROM st3),
    st5 AS (SELECT *, regexp_extract(w, '{_ends(("eed", "eedly", "ed", "edly", "ing", "ingly"))}') AS e, w IN ({whole}) AS whole FROM st4),
    st6 AS (SELECT word, r1, r2, whole, w AS kept, CASE WHEN e = '' THEN w WHEN e LIKE 'ee%' THEN CASE WHEN {in_region("r1")} THEN {_BODY} || 'ee' ELSE w END WHEN NOT regexp_matches({_BODY}, '[aeiouy]') THEN w
        WHEN regexp_matches({_BODY}, '(at|bl|iz)$') THEN {_BODY} || 'e' WHEN regexp_matches({_BODY}, '{_ends(s.DOUBLES)}') THEN w[1:length(w) - length(e) - 1]
        WHEN r1 >= length(w) - length(e) AND regexp_matches({_BODY}, '{_SHORT}') THEN {_BODY} || 'e' ELSE {_BODY} END AS w FROM st5),
    st7 AS (SELECT word, r1, r2, whole, kept, CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN w[1:length(w) - 1] || 'i' ELSE w END AS w FROM st6),
    st8 AS (SELECT *, regexp_extract(w, '{_ends(s.LONG_ENDINGS)}') AS e FROM st7),
    st9 AS (SELECT word, r1, r2, whole, kept, CASE WHEN e = '' OR NOT {in_region("r1")} OR (e = 'ogi' AND NOT w LIKE '%logi') OR (e = 'li' AND NOT regexp_matches({_BODY}, '[{s.BEFORE_LI}]$')) THEN w ELSE {_BODY} || {_cases("e", s.LONG_ENDINGS)} END AS w FROM st8),
    st10 AS (SELECT *, regexp_extract(w, '{_ends(s.MIDDLE_ENDINGS)}') AS e FROM st9),
    st11 AS (SELECT word, r1, r2, whole, kept, CASE WHEN e = '' OR NOT {in_region("CASE WHEN e = 'ative' THEN r2 ELSE r1 END")} THEN w ELSE {_BODY} || {_cases("e", s.MIDDLE_ENDINGS)} END AS w FROM st10),
    st12 AS (SELECT *, regexp_extract(w, '{_ends(s.LAST_ENDINGS)}') AS e FROM st11),
    st13 AS (SELECT word, r1, r2, whole, kept, CASE WHEN e = '' OR NOT {in_region("r2")} OR (e = 'ion' AND NOT regexp_matches({_BODY}, '[st]$')) THEN w ELSE {_BODY} END AS w FROM st12),
    st14 AS (SELECT word, CASE WHEN whole THEN kept WHEN w LIKE '%e' AND (length(w) > r2 OR (length(w) > r1 AND NOT regexp_matches(w[1:length(w) - 1], '{_SHORT}'))) THEN w[1:length(w) - 1] WHEN w LIKE '%ll' AND length(w) > r2 THEN w[1:length(w) - 1] ELSE w END AS w FROM st13),
    stems AS (SELECT word, CASE WHEN length(word) < 3 OR regexp_matches(word, '\p{{N}}') THEN word ELSE coalesce({_cases("word", s.IRREGULAR)}, replace(w, 'Y', 'y')) END AS stem FROM st14 WHERE word NOT IN ({stop}))"""


_RUNS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
#: line words with positions; all words; their stems; postings.
_INDEX = f"""WITH ln AS (SELECT doc, ord, {_RUNS.format("x")} AS ws FROM ({_LINES})), lw AS (SELECT doc, ord, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM ln),
    qs AS (SELECT q, string_split(t, ' ') AS ts FROM ({_QUESTIONS})), qw AS (SELECT q, k, word, pos FROM (SELECT q, k, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT q, k, {_RUNS.format("t")} AS ws FROM (SELECT q, unnest(ts) AS t, generate_subscripts(ts, 1) AS k FROM qs)))
    ),
    wd AS (SELECT word FROM lw UNION SELECT word FROM qw UNION SELECT term FROM ({_ordered_terms(_QUESTIONS, "q", "t")})), {_stems_sql("wd")},
    p AS MATERIALIZED (SELECT doc, ord, stem, pos FROM lw JOIN stems ON stems.word = lw.word)"""
#: Of relation t(q, stem): the covers of all stems, with the places that they name, then the density.
_COVERS = """tt AS (SELECT DISTINCT q, stem FROM t), nq AS (SELECT q, count(*) AS n FROM tt GROUP BY q), h AS MATERIALIZED (SELECT q, doc, ord, pos, p.stem FROM tt JOIN p ON p.stem = tt.stem),
    full_ AS (SELECT h.q, doc, ord FROM h JOIN nq ON nq.q = h.q GROUP BY h.q, doc, ord, n HAVING count(DISTINCT stem) = n), pl AS (SELECT DISTINCT h.q, h.doc, h.ord, pos FROM h JOIN full_ f ON f.q = h.q AND f.doc = h.doc AND f.ord = h.ord),
    last AS (SELECT pl.q, pl.doc, pl.ord, pl.pos AS b, h.stem, max(h.pos) AS a FROM pl JOIN h ON h.q = pl.q AND h.doc = pl.doc AND h.ord = pl.ord AND h.pos <= pl.pos GROUP BY ALL),
    ext AS (SELECT last.q, doc, ord, b, min(a) AS a FROM last JOIN nq ON nq.q = last.q GROUP BY last.q, doc, ord, b, n HAVING count(*) = n), cov AS (SELECT q, doc, ord, a, min(b) AS b FROM ext GROUP BY ALL),
    den AS (SELECT q, doc, ord, round(sum(w), 9) AS density FROM (SELECT c.q, c.doc, c.ord, c.a, 0.1::DOUBLE / (1 + (c.b - c.a) - (count(*) - 1)) AS w FROM cov c JOIN pl ON pl.q = c.q AND pl.doc = c.doc AND pl.ord = c.ord AND pl.pos BETWEEN c.a AND c.b GROUP BY c.q, c.doc, c.ord, c.a, c.b) GROUP BY ALL)"""
_TOP = "SELECT q AS question_id, doc, ord, density, row_number() OVER (PARTITION BY q ORDER BY density DESC, doc, ord) AS rank FROM den QUALIFY rank <= 20"
_LOOSE = f"""lt AS (SELECT DISTINCT q, stem FROM ({_ordered_terms(_QUESTIONS, "q", "t")}) JOIN stems ON stems.word = term)"""

#: Parts of each kind of query: alternative, whether excluded, first and last word of the passage. A part of stopwords only is no part.
_PARTS = """VALUES (0, 1, false, 3, 4), (0, 1, false, 1, 1), (1, 1, false, 2, 2), (1, 2, false, 5, 5), (1, 2, true, 1, 1), (2, 1, false, 1, 1), (2, 1, true, 2, 3), (3, 1, false, 1, 1), (3, 1, false, 2, 2), (3, 1, false, 3, 3),
    (4, 1, false, 1, 3), (4, 2, false, 6, 6), (4, 2, false, 7, 7)"""
_GRAMMAR = f"""qg AS (SELECT q, k, row_number() OVER (PARTITION BY q ORDER BY k, pos) AS g, stem FROM qw LEFT JOIN stems ON stems.word = qw.word),
    pt AS (SELECT qs.q, alt, neg, ka, kb, (SELECT count(*) FROM qg WHERE qg.q = qs.q AND qg.k BETWEEN ka AND kb AND qg.stem IS NOT NULL) AS n FROM qs JOIN ({_PARTS}) AS parts(kind, alt, neg, ka, kb) ON kind = qs.q % 5),
    pm AS (SELECT DISTINCT q, alt, neg, ka, kb, doc, ord FROM (SELECT pt.q, alt, neg, ka, kb, n, p.doc, p.ord, p.pos - qg.g AS base, count(*) AS met FROM pt JOIN qg ON qg.q = pt.q AND qg.k BETWEEN ka AND kb JOIN p ON p.stem = qg.stem GROUP BY ALL) WHERE met = n),
    al AS (SELECT q, alt, count(*) FILTER (WHERE NOT neg) AS wanted FROM pt WHERE n > 0 GROUP BY q, alt), void AS (SELECT q FROM al WHERE wanted = 0),
    hit AS (SELECT pm.q, pm.alt, doc, ord FROM pm JOIN al ON al.q = pm.q AND al.alt = pm.alt GROUP BY pm.q, pm.alt, doc, ord, wanted HAVING count(*) FILTER (WHERE NOT neg) = wanted AND count(*) FILTER (WHERE neg) = 0)"""

SQL = {
    "stemmed_words": f"{_INDEX} SELECT stem, count(DISTINCT (doc, ord)) AS n_chunks, count(*) AS n FROM p GROUP BY stem",
    "positional_postings": f"{_INDEX} SELECT doc, count(*) AS n, count(DISTINCT stem) AS n_stems, CAST(sum(pos) AS BIGINT) AS places, CAST(sum(pos * length(stem)) AS BIGINT) AS weighed FROM p GROUP BY doc",
    "ranked_search": f"""{_INDEX}, {_LOOSE}, den AS (SELECT q, doc, ord, round(0.1::DOUBLE * count(DISTINCT pos), 9) AS density FROM lt JOIN p ON p.stem = lt.stem GROUP BY ALL) {_TOP}""",
    "covered_search": f"""{_INDEX}, t AS (SELECT q, stem FROM qw JOIN stems ON stems.word = qw.word WHERE k <= 3), {_COVERS} {_TOP}""",
    "grammar_search": f"""{_INDEX}, {_GRAMMAR} SELECT DISTINCT q AS question_id, doc, ord FROM hit WHERE q NOT IN (SELECT q FROM void)""",
}
