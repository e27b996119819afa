"""Queries of whole-document analysis: sections with a verdict, standard clauses, key topics, excerpts, places, caps, tool arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import compare as G
from ..operators import retrieval as R
from ..operators import scan as N
from ..operators import structure as S
from ..operators import tools as T
from ..sources.tables import read
from .retrieval_queries import _KEYWORD, _LINES, _PHRASE, _QUESTIONS, _index, _phrases, _questions
from .structure_queries import _HEADS, _NUMBERED, _numbered_lines, lengths, text_lines

#: Titles and first words of sections, dealt to parts.
_TITLES = ("Term of Agreement", "Termination", "Fees and Payment", "Limitation of Liability", "Indemnity", "Confidentiality", "Licence of Marks", "Warranties", "Governing Law", "Disputes and Arbitration", "Assignment", "Acts of God", "Notice", "Non-Compete", "Privacy", "Entire Agreement", "General", "Miscellaneous", "Page 3", "Preamble")
_OPENINGS = ("The total liability is one crate.", "Each side may terminate at will.", "This is governed by the laws of the sea.", "Personal data stay at home.", "Nothing is said here.", "No side shall solicit the other\'s crew.", "Confidential information is kept.")
_SAID = (
    "The crates shall continue to be sent until next year.", "All fees are to pay within thirty days of the invoice.", "Shall pay", "The total liability of each side is one crate.", "Force majeure event means a storm at sea or on land.",
    "The parties agree that crates of intellectual property stay.", "It is governed by the laws of the sea and land.", "Either side may terminate this for a good cause.", "The buyer shall pay for all of the crates.", "Nothing of note stands in this line of text.", "Renewal of the initial term ........ 12",
)


def _pick(values: tuple[str, ...], n: object) -> object:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _titled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sections of 100 characters, 20 to a document, and the texts."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part", "p_partkey").select(F.floor(k / 20).alias("doc"), (k % 20).cast("int").alias("ord"), _pick(_TITLES, k * 7).alias("title"), F.when(k % 3 != 0, (k % 20).cast("string")).alias("number"), F.rpad(_pick(_OPENINGS, k), 100, " ").alias("body"))
    sections = rows.select("doc", "ord", "number", "title", (F.col("ord") * 100).alias("start"), (F.col("ord") * 100 + 100).alias("end"))
    held = F.sort_array(F.collect_list(F.struct("ord", "body")))
    filler = F.repeat(F.lit(" "), 100)
    texts = rows.groupBy("doc").agg(held.alias("b")).select("doc", F.concat(F.repeat(filler, F.get("b", F.lit(0))["ord"]), F.array_join(F.transform("b", lambda x: x["body"]), "")).alias("text"))
    return sections, texts


def standard_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.clause_tags(*_titled(spark, sf_dir), S.CLAUSE_TITLES, S.CLAUSE_BODIES)
    return rows.select("doc", F.col("ord").cast("long").alias("ord"), "type", "confidence")


def clause_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections, texts = _titled(spark, sf_dir)
    rows = S.clause_tags(sections, texts, S.CLAUSE_TITLES, S.CLAUSE_BODIES).join(sections.select("doc", "ord", "start", "end"), ["doc", "ord"])
    rows = S.clauses_of(rows, "termination", most=3)
    return rows.select("doc", F.col("place").cast("long").alias("place"), F.col("ord").cast("long").alias("ord"), F.col("start").cast("long").alias("start"))


def detected_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines as documents; every third loses its headings and falls back to parts."""
    lines = _numbered_lines(spark, sf_dir).withColumn("text", F.when(F.col("doc") % 3 == 0, F.lower(F.concat(F.lit("so "), "text"))).otherwise(F.col("text")))
    lines = lines.withColumns({"start": F.col("ord") * 100, "end": F.col("ord") * 100 + 99})
    texts = lines.groupBy("doc").agg(F.max("end").alias("n")).select("doc", F.rpad(F.lit("x"), F.col("n").cast("int"), "x").alias("text"))
    heads = S.without_contents(S.headings(lines))
    rows = S.detected_sections(heads, texts, lines)
    return rows.groupBy("doc", "structured").agg(F.count("*").alias("n_sections"), F.max("end").cast("long").alias("last"), F.bool_or(F.col("title") == "Preamble").alias("leads"), F.sum("start").cast("long").alias("starts"))


def analyzed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis of every document."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("doc"), "text", F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("furniture"))
    rows = S.analyzed(docs, text_lines(spark, sf_dir))[3]
    return rows.select("doc", "structured", "n_sections", "n_chunks", "n_clauses", "tokens", F.array_join("warnings", ",").alias("warnings"))


def key_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    lines = read(spark, sf_dir, "part", "p_partkey").select(F.floor(k / 10).alias("doc"), (k % 10).alias("ord"), (k % 10 * 80).alias("start"), (k % 10 * 80 + 79).alias("end"), _pick(_SAID, k * 3 + F.floor(k / 7)).alias("text"))
    furniture = lines.where((F.col("doc") % 5 == 0) & (F.col("ord") < 3)).select("doc", "start", "end")
    rows = N.first_topics(lines, furniture=furniture)
    return rows.select("doc", "topic", F.col("start").cast("long").alias("start"))


def find_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select(F.col("doc_id").alias("doc"), F.lower("text").alias("text"))
    rows = R.places_of(texts, "the")
    return rows.select("doc", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place"), F.col("start").cast("long").alias("start"), F.md5("context").alias("context"))


def budget_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages in order of rank within a budget; what does not fit is passed over to the last."""
    chunks = text_lines(spark, sf_dir).withColumn("tokens", X.token_estimate(F.col("text")))
    rows = R.within_budget(R.keyword_leg(_index(spark, sf_dir), _questions(spark, sf_dir)), chunks, 300, limit=None, nearly=None)
    return rows.select("question_id", "doc", F.col("ord").cast("long").alias("ord"), F.col("place").cast("long").alias("place"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five lines of each question as excerpts, under the parts that hold them."""
    lines = text_lines(spark, sf_dir)
    docs = read(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("doc"), "text")
    parts = S.fallback_parts(lines, lengths(spark, sf_dir)).withColumns({"level": F.lit(1), "number": F.lit(None).cast("string")})
    chosen = R.keyword_leg(_index(spark, sf_dir), _questions(spark, sf_dir)).where("rank <= 5")
    rows = R.excerpts(chosen, lines, docs, parts)
    return rows.select("question_id", "doc", F.col("place").cast("long").alias("place"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "heading", F.md5("text").alias("digest"), "percent")


def fused_with_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords, phrases and, with weight 3, the section that a question names: the first part of the document of its number."""
    lines, questions = text_lines(spark, sf_dir), _questions(spark, sf_dir)
    parts = S.fallback_parts(lines, lengths(spark, sf_dir)).withColumn("number", (F.col("ord") + 1).cast("string"))
    named = R.section_leg(lines, parts, questions.select("question_id", F.col("question_id").alias("doc"), F.lit("1").alias("number")))
    rows = R.fused([(R.keyword_leg(_index(spark, sf_dir), questions), 1.0), (R.phrase_leg(lines, _phrases(spark, sf_dir)), 1.5), (named, 3.0)])
    return rows.select("question_id", "doc", F.col("ord").cast("long").alias("ord"), "score", F.col("rank").cast("long").alias("rank"))


def affordable_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events", "event_id", "user_id").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 400).alias("n_tokens"))
    return T.affordable(rows, 20, 3000).groupBy("run_id").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("n"))


def repaired_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments as models write them: single quotes, a bare key, an end cut off, a comma too many, a key too many, a number as text."""
    k, n = F.col("event_id"), F.get_json_object("props", "$.k")
    forms = ("{{'k': {}}}", "{{k: {},}}", "{{\"k\": {}", "{{\"k\": \"{}\", \"more\": [1, 2]}}", "{{\"k\": {}}}", "no value: {}")
    args = F.when(F.lit(False), "")
    for i, form in enumerate(forms):
        a, b = form.replace("{{", "{").replace("}}", "}").split("{}") if form.count("{}") == 1 else (form, "")
        args = args.when(k % len(forms) == i, F.concat(F.lit(a), n, F.lit(b)))
    calls = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props").select(F.col("user_id").alias("run_id"), k.alias("seq"), F.col("event_type").alias("tool"), args.alias("args"))
    tools = spark.createDataFrame([(t, ["k"], ["k"], [], ["k"]) for t in ("click", "view", "error")], "tool string, keys array<string>, numbers array<string>, strings array<string>, required array<string>")
    rows = T.normalized_calls(calls, tools)
    return rows.select(F.col("seq").alias("event_id"), F.coalesce("error", F.lit("")).alias("error"), F.when(F.col("error").isNull(), F.col("args")).alias("args"), F.array_join("ignored", ",").alias("ignored"), "repeat")


def spelled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in words and defined terms on both sides of a change."""
    k = F.col("p_partkey")
    term = _pick(("Buyer", "Seller", "Key Person"), k)
    before = F.concat(F.lit("They pay "), _pick(("two hundred", "ten", "fifty-five thousand"), k), F.lit(" dollars. (the “"), term, F.lit("”) may wait."))
    after = F.concat(F.lit("They pay "), _pick(("two hundred", "twenty", "fifty-five thousand"), k), F.lit(" dollars. "), F.when(k % 2 == 0, F.concat(F.lit("(the “"), term, F.lit("”)"))).otherwise(F.concat(F.lit("\"Other\" means it, and “"), term, F.lit("” means"))), F.lit(" may wait."))
    rows = read(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.explode(G.changed_facts(before, after)).alias("f"))
    return rows.select("p_partkey", "f.kind", "f.before", "f.after")


def top_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") + F.col("l_partkey")
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    changes = rows.select(F.floor(F.col("l_orderkey") / 4).alias("pair"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("change_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), _pick(("modified", "unchanged", "added"), k).alias("type"), _pick(G.SEVERITIES, k * 5 + 1).alias("severity"), F.lit("s").alias("summary"))
    return G.top_changes(changes).select("pair", F.col("place").cast("long").alias("place"), "change_id")


QUERIES = {f.__name__: f for f in (standard_clauses, clause_lookup, detected_sections, analyzed_documents, key_topics, find_places, budget_passages, excerpts, fused_with_sections, affordable_calls, repaired_calls, spelled_facts, top_changes)}


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _rules(rules: list[tuple[str, str]], column: str) -> str:
    fits = ", ".join(f"CASE WHEN regexp_matches({column}, '(?i){p}') THEN '{t}' END" for t, p in rules)
    return f"list_filter([{fits}], lambda x: x IS NOT NULL)"


_CLAUSES = f"""SELECT doc, ord, unnest(by_title) AS type, 0.8::DOUBLE AS confidence FROM (SELECT *, {_rules(S.CLAUSE_TITLES, "title")} AS by_title, {_rules(S.CLAUSE_BODIES, "body")} AS by_body FROM (
        SELECT p_partkey // 20 AS doc, p_partkey % 20 AS ord, ({_list(_TITLES)})[p_partkey * 7 % {len(_TITLES)} + 1] AS title, p_partkey % 3 <> 0 AS numbered, ({_list(_OPENINGS)})[p_partkey % {len(_OPENINGS)} + 1] AS body FROM part) WHERE title NOT IN ('Preamble', 'Page 3'))"""
_CLAUSES = f"""{_CLAUSES} UNION ALL {_CLAUSES.replace("unnest(by_title) AS type, 0.8::DOUBLE", "unnest(by_body) AS type, 0.4::DOUBLE", 1)} WHERE numbered AND len(by_title) = 0"""
_TOPICS = " UNION ALL ".join(f"SELECT '{t}' AS topic, {i} AS k, '(?i){p}' AS p" for t, patterns in N.KEY_TOPICS for i, p in enumerate(patterns))
_PARTS = f"""parts AS (WITH RECURSIVE l AS (SELECT doc, ord, CAST(coalesce(sum(length(x) + 1) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p FROM ({_LINES})),
        c AS (SELECT doc, CAST(0 AS BIGINT) AS p, 1 AS k FROM l WHERE p = 0 UNION SELECT c.doc, min(l.p), c.k + 1 FROM c JOIN l ON l.doc = c.doc AND l.p - c.p >= 2000 GROUP BY c.doc, c.p, c.k) SELECT * FROM c)"""
SQL = {
    "standard_clauses": f"SELECT doc, ord, type, confidence FROM ({_CLAUSES})",
    "clause_lookup": f"SELECT doc, place, ord, ord * 100 AS start FROM (SELECT doc, ord, row_number() OVER (PARTITION BY doc ORDER BY ord) AS place FROM ({_CLAUSES}) WHERE type = 'termination') WHERE place <= 3",
    "key_topics": f"""WITH l AS (SELECT p_partkey // 10 AS doc, p_partkey % 10 AS ord, ({_list(_SAID)})[(p_partkey * 3 + p_partkey // 7) % {len(_SAID)} + 1] AS x FROM part), t AS ({_TOPICS}),
        h AS (SELECT doc, topic, min((k, ord)) AS b FROM l JOIN t ON regexp_matches(x, p) WHERE len(string_split(x, ' ')) >= 6 AND NOT contains(x, '....') AND NOT (doc % 5 = 0 AND ord < 3) GROUP BY 1, 2) SELECT doc, topic, b[2] * 80 AS start FROM h""",
    "find_places": """WITH d AS (SELECT doc_id AS doc, lower(text) AS t, string_split(lower(text), 'the') AS p FROM documents WHERE text IS NOT NULL), e AS (SELECT doc, t, p, unnest(range(1, least(15, len(p) - 1) + 1)) AS k FROM d),
        f AS (SELECT doc, t, least(1000, len(p) - 1) AS n, k - 1 AS place, CAST(list_sum(list_transform(p[1:k], lambda x: length(x) + 3)) - 3 AS BIGINT) AS s FROM e)
        SELECT doc, n, place, s AS start, md5(substring(t, CAST(greatest(0, s - 120) + 1 AS BIGINT), CAST(s + 123 - greatest(0, s - 120) AS BIGINT))) AS context FROM f""",
    "budget_passages": f"""WITH RECURSIVE r AS (SELECT k.q, k.doc, k.ord, k.rank, CAST(ceil(length(x) / 4) AS BIGINT) AS n FROM ({_KEYWORD}) k JOIN ({_LINES}) l ON l.doc = k.doc AND l.ord = k.ord),
        f AS (SELECT q, 0 AS rank, CAST(0 AS BIGINT) AS used, false AS took, CAST(0 AS BIGINT) AS doc, CAST(0 AS BIGINT) AS ord FROM (SELECT DISTINCT q FROM r)
            UNION ALL SELECT f.q, f.rank + 1, CASE WHEN f.used + r.n <= 300 THEN f.used + r.n ELSE f.used END, f.used + r.n <= 300, r.doc, r.ord FROM f JOIN r ON r.q = f.q AND r.rank = f.rank + 1)
        SELECT q AS question_id, doc, ord, row_number() OVER (PARTITION BY q ORDER BY rank) - 1 AS place FROM f WHERE took""",
    "excerpts": f"""WITH {_PARTS}, l AS (SELECT doc, ord, x, CAST(coalesce(sum(length(x) + 1) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM ({_LINES})),
        c AS (SELECT k.q, l.doc, l.x, l.s, l.s + length(l.x) AS e FROM ({_KEYWORD}) k JOIN l ON l.doc = k.doc AND l.ord = k.ord WHERE k.rank <= 5 AND length(l.x) > 0), g AS (SELECT q, doc, sum(e - s) AS shown FROM c GROUP BY 1, 2)
        SELECT c.q AS question_id, c.doc, row_number() OVER (PARTITION BY c.q, c.doc ORDER BY c.s) AS place, c.s AS start, c.e AS "end", '── Part ' || (SELECT max(k) FROM parts WHERE parts.doc = c.doc AND parts.p <= c.s) || ' ──' AS heading, md5(trim(c.x, chr(32) || chr(9) || chr(13) || chr(10))) AS digest,
            CAST(greatest(1, round(100 * shown / greatest(1, length(d.text)))) AS BIGINT) AS percent FROM c JOIN g ON g.q = c.q AND g.doc = c.doc JOIN documents d ON d.doc_id = c.doc""",
    "fused_with_sections": f"""WITH {_PARTS}, l AS (SELECT doc, ord, x, CAST(coalesce(sum(length(x) + 1) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM ({_LINES})),
        n AS (SELECT q.q, l.doc, l.ord, row_number() OVER (PARTITION BY q.q ORDER BY l.ord) AS rank FROM ({_QUESTIONS}) q JOIN l ON l.doc = q.q WHERE length(l.x) > 0 AND NOT EXISTS (SELECT 1 FROM parts WHERE parts.doc = l.doc AND parts.k = 2 AND parts.p <= l.s) QUALIFY rank <= 6),
        b AS (SELECT q, doc, ord, round(sum(s), 9) AS score, min((leg, rank)) AS k FROM (SELECT q, doc, ord, rank, 1.0::DOUBLE / (60 + rank) AS s, 0 AS leg FROM ({_KEYWORD}) UNION ALL SELECT q, doc, ord, rank, 1.5::DOUBLE / (60 + rank), 1 FROM ({_PHRASE}) UNION ALL SELECT q, doc, ord, rank, 3.0::DOUBLE / (60 + rank), 2 FROM n) GROUP BY 1, 2, 3)
        SELECT q AS question_id, doc, ord, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, k, doc, ord) AS rank FROM b""",
    "affordable_calls": """WITH c AS (SELECT user_id AS r, row_number() OVER w AS k, sum(event_id % 400) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT r AS run_id, count(*) FILTER (WHERE k <= 20 AND t <= 3000) AS allowed, count(*) AS n FROM c GROUP BY r""",
    "repaired_calls": """WITH c AS (SELECT event_id AS e, user_id AS r, event_type AS t, event_id % 6 AS m, json_extract_string(props, '$.k') AS k FROM events),
        d AS (SELECT *, CASE WHEN t NOT IN ('click', 'view', 'error') THEN 'UNKNOWN_TOOL' WHEN m = 5 THEN 'INVALID_ARGUMENTS' ELSE '' END AS error, '{"k":' || k || '}' AS a FROM c)
        SELECT e AS event_id, error, CASE WHEN error = '' THEN a END AS args, CASE WHEN error = '' AND m = 3 THEN 'more' ELSE '' END AS ignored, error = '' AND row_number() OVER (PARTITION BY r, t, a, error ORDER BY e) > 1 AS repeat FROM d""",
    "spelled_facts": """WITH p AS (SELECT p_partkey AS k, (['Buyer', 'Seller', 'Key Person'])[p_partkey % 3 + 1] AS t FROM part)
        SELECT k AS p_partkey, 'money' AS kind, 'ten dollars' AS before, 'twenty dollars' AS after FROM p WHERE k % 3 = 1 UNION ALL SELECT k, 'party', '—', 'Other' FROM p WHERE k % 2 = 1""",
    "top_changes": f"""WITH r AS (SELECT l_orderkey AS o, l_linenumber AS l, l_linenumber + min(l_partkey) AS k FROM lineitem GROUP BY 1, 2), c AS (SELECT o // 4 AS pair, o || '-' || l AS id, o * 10 + l AS p, k % 3 AS t, (k * 5 + 1) % 4 AS s FROM r),
        w AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY s DESC, p, id) AS place FROM c WHERE t <> 1 AND s > 0) SELECT pair, place, id AS change_id FROM w WHERE place <= 5""",
}
