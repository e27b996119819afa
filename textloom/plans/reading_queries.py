"""Queries of reading: places that a context tells apart, words of a range, units of all kinds, pages of documents, answers as text, classified changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as G
from ..operators import scan as N
from ..operators import structure as S
from ..operators import verification as V
from ..sources.tables import read
from .structure_queries import text_lines
from .verification_queries import _EMPTY, spaced_sql, verified_passages

#: Characters of a page.
PAGE = 1500


def expected_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document stands twice in a text; passages are looked up with the second half as their context, which tells their places apart; all of
    them are counted."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    found = verified_passages(spark, sf_dir).join(read(spark, sf_dir, "benchmark"), "item_id").join(docs.select("doc_id", F.length("text").alias("n")), "doc_id")
    half = F.array(F.struct((F.col("n") + 1).alias("start"), (2 * F.col("n") + 1).alias("end")))
    quotes = found.select(F.concat_ws(":", "item_id", "doc_id").alias("quote_id"), "doc_id", "text", half.alias("context"))
    twice = docs.select("doc_id", F.concat("text", F.lit("\n"), "text").alias("text"), F.expr(_EMPTY).alias("furniture"))
    rows = V.verify_quotes(twice, quotes, most=None).join(docs.select("doc_id", F.length("text").alias("n")), "doc_id")
    return rows.select("quote_id", "status", F.size("occurrences").cast("long").alias("n_found"), F.col("primary").cast("long").alias("place"), (F.get("occurrences", F.col("primary"))["start"] > F.col("n")).alias("inside"))


def displayed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document from its tenth character on, words broken at line ends and two stretches of furniture left out."""
    rows = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", F.regexp_replace("text", "([aeiou])(nt|th|re)", "$1-\n$2"))
    rows = rows.withColumns({"start": F.lit(10), "end": F.length("text"), "furniture": F.expr("array(named_struct('start', 90, 'end', 120), named_struct('start', 40, 'end', 45))")})
    return rows.select("doc_id", F.md5(V.displayed()).alias("digest"))


def split_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of every document: three lines are a section in every other one; sections of over 120 tokens are split, and the rest goes by paragraphs."""
    lines = text_lines(spark, sf_dir)
    texts = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select(F.col("doc_id").alias("doc"), "text")
    number = (F.col("ord") / 3).cast("int") + 1
    sections = lines.where("doc % 2 = 0 and ord % 3 = 0").select("doc", "ord", number.cast("string").alias("number"), F.concat(F.lit("Lines "), number).alias("title"), "start", "end")
    rows = G.comparison_units(sections, texts, lines, most=120)
    return rows.select("doc", F.col("idx").cast("long").alias("idx"), "number", "title", F.md5("text").alias("digest"), "start", "end")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of texts; the last page of a text ends where the text does, and an empty text has one empty page."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select(F.col("doc_id").alias("doc"), F.length("text").alias("n"))
    rows = docs.select("doc", "n", F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(PAGE))).alias("k", "start"))
    return rows.select("doc", (F.col("k") + 1).alias("page_no"), "start", F.least(F.col("start") + PAGE, "n").alias("end"), ((F.col("doc") + F.col("k")) % 7 == 0).alias("unreadable"))


def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.fallback_pages(_pages(spark, sf_dir))
    return rows.select("doc", F.col("ord").cast("long").alias("ord"), "title", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def pages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document asked for five pages from one of its first three on; a null text has no pages."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("doc"), "text")
    n = F.ceil(F.length("text") / PAGE).cast("int")
    first = (F.col("doc") % 3 + 1).cast("int")
    calls = docs.select(F.col("doc").alias("call_id"), "doc", first.alias("first"), F.when(F.col("doc") % 5 == 0, first + 4).otherwise(F.least(first + 4, n)).alias("last"))
    rows = N.read_pages(calls, _pages(spark, sf_dir), docs)
    return rows.select("call_id", "error", "page_no", F.md5("text").alias("digest"), "unreadable", "next")


def _cited_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as answers: a mark after each sentence and one in place of each comma, to three citations; what they quote is the text itself."""
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "text").where("text is not null")
    rows = rows.select(F.concat_ws(":", "conv_id", "turn").alias("answer_id"), "conv_id", "turn", "text")
    answers = rows.select("answer_id", F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\.", " ⟦c1⟧."), ",", " ⟦c2⟧"), r"\n", " ⟦c9⟧\n").alias("content"))
    n = F.col("conv_id") + F.col("turn")
    status = [F.when(n % 3 == k, "unverified").when(n % 2 == 0, "verified").otherwise("verified_close") for k in range(3)]
    told = F.array(*[F.struct(F.lit(f"c{k + 1}").alias("citation_id"), F.lit(k % 2).alias("passage"), s.alias("status"), F.concat(F.lit("*"), F.col("text") if k else F.substring("text", 1, 30)).alias("display")) for k, s in enumerate(status)])
    return answers, rows.select("answer_id", F.explode(told).alias("c")).select("answer_id", "c.*")


def plain_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.plain_answers(*_cited_turns(spark, sf_dir))
    return rows.select("answer_id", F.md5("content").alias("digest"), F.length("content").cast("long").alias("n_chars"))


def markdown_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.markdown_answers(*_cited_turns(spark, sf_dir))
    return rows.select("answer_id", F.md5("content").alias("digest"), F.length("content").cast("long").alias("n_chars"))


def _judge(changes: list[dict]) -> list[tuple[str, str] | None]:
    """Stands for a language model: silent on every fifth change, without a summary on every third."""
    return [None if c["place"] % 5 == 0 else (G.SEVERITIES[c["place"] % 4], f"told {c['place']}" if c["place"] % 3 else " ") for c in changes]


def classified_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    floor = F.element_at(F.array(*map(F.lit, G.SEVERITIES)), (F.col("p") % 4 + 1).cast("int"))
    changes = rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("change_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), floor.alias("severity"), F.lit("by rules").alias("summary"))
    return G.classified(changes, _judge).select("change_id", "severity", "summary", F.col("by").alias("told_by"))


QUERIES = {f.__name__: f for f in (expected_places, displayed_ranges, split_units, page_parts, pages_read, plain_answers, markdown_answers, classified_changes)}

_BLANKS = "[\\s\\x{A0}\\x{85}\\x0B\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
# Applied twice: a letter that ends one match may start the next.
_BROKEN = f"(\\p{{L}})-[ \\t]*\\n{_BLANKS}*(\\p{{Ll}})"
_PAGES = f"""SELECT doc_id AS doc, text, k + 1 AS page_no, k * {PAGE} AS s, least(k * {PAGE} + {PAGE}, length(text)) AS e, (doc_id + k) % 7 = 0 AS unreadable
    FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / {PAGE}) AS BIGINT)))) AS k FROM documents WHERE text IS NOT NULL)"""
_CITED = """t AS (SELECT conv_id || ':' || turn AS answer_id, conv_id + turn AS n, text FROM conversations WHERE text IS NOT NULL),
    a AS (SELECT answer_id, n, text, replace(replace(replace(text, '.', ' ⟦c1⟧.'), ',', ' ⟦c2⟧'), chr(10), ' ⟦c9⟧' || chr(10)) AS content FROM t),
    m AS (SELECT *, string_split(regexp_replace(content, '⟦c\\d+⟧', chr(1), 'g'), chr(1)) AS plain, regexp_extract_all(content, '⟦(c\\d+)⟧', 1) AS marks FROM a)"""
_OPEN = f"(?i)(?:(?:^|[^0-9A-Za-z_])(?:{'|'.join(V.OPEN_WORDS)})|[{V.OPEN_SIGNS}])[\\s\\x{{A0}}]*$"
_SHOWN = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '`', '\\`'), '*', '\\*'), '_', '\\_'), '[', '\\['), ']', '\\]'), '<', '\\<'), '>', '\\>'), '#', '\\#'), '|', '\\|'), '~', '\\~')"


def _inline(display: str) -> str:
    return "' *“' || " + _SHOWN.format(f"CASE WHEN length({display}) > 240 THEN substr({display}, 1, 237) || '…' ELSE {display} END") + " || '”*'"


SQL = {
    "expected_places": f"""WITH d AS (SELECT doc_id, {spaced_sql("text")} AS t FROM documents), b AS (SELECT item_id, {spaced_sql("text")} AS p FROM benchmark),
        m AS (SELECT item_id, doc_id, CAST((length(t) - length(replace(t, p, ''))) // length(p) AS BIGINT) AS k FROM d JOIN b ON contains(t, p) WHERE p <> '' AND len(string_split(p, ' ')) >= 5)
        SELECT item_id || ':' || doc_id AS quote_id, 'verified' AS status, 2 * k AS n_found, k AS place, true AS inside FROM m""",
    "displayed_ranges": f"""WITH d AS (SELECT doc_id, regexp_replace(text, '([aeiou])(nt|th|re)', '\\1-' || chr(10) || '\\2', 'g') AS t FROM documents)
        SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(substr(t, 11, 30) || chr(10) || substr(t, 46, 45) || chr(10) || substr(t, 121), '{_BROKEN}', '\\1\\2', 'g'), '{_BROKEN}', '\\1\\2', 'g'), '{_BLANKS}+', ' ', 'g'), ' ')) AS digest FROM d""",
    "page_parts": f"SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page_no) - 1 AS ord, 'Page ' || page_no AS title, s AS start, e AS \"end\" FROM ({_PAGES}) WHERE e > s",
    "pages_read": f"""WITH d AS (SELECT doc_id AS doc, text, doc_id % 3 + 1 AS first, greatest(1, CAST(ceil(length(text) / {PAGE}) AS BIGINT)) AS n, CASE WHEN doc_id % 5 = 0 THEN doc_id % 3 + 5 ELSE least(doc_id % 3 + 5, CAST(ceil(length(text) / {PAGE}) AS BIGINT)) END AS last FROM documents),
        c AS (SELECT *, CASE WHEN text IS NULL THEN 'NO_PAGES' WHEN last > n OR first > last THEN 'PAGE_OUT_OF_RANGE' END AS error FROM d)
        SELECT c.doc AS call_id, error, page_no, md5(CASE WHEN unreadable THEN '' ELSE trim(regexp_replace(regexp_replace(substr(p.text, s + 1, e - s), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) END) AS digest, unreadable, CASE WHEN first + 2 < last THEN first + 3 END AS next
            FROM c JOIN ({_PAGES}) p ON p.doc = c.doc AND page_no BETWEEN first AND least(last, first + 2) WHERE error IS NULL
        UNION ALL SELECT doc, error, NULL, NULL, NULL, NULL FROM c WHERE error IS NOT NULL""",
    "plain_answers": f"""WITH {_CITED}, n AS (SELECT *, (n % 3 <> 0) AND list_contains(marks, 'c1') AS one, (n % 3 <> 1) AND list_contains(marks, 'c2') AS two, list_position(marks, 'c2') < list_position(marks, 'c1') AS turned FROM m),
        x AS (SELECT answer_id, replace(replace(replace(content, '⟦c1⟧', CASE WHEN NOT one THEN ' [unverified]' WHEN two AND turned THEN ' [2]' ELSE ' [1]' END), '⟦c2⟧', CASE WHEN NOT two THEN ' [unverified]' WHEN one AND NOT turned THEN ' [2]' ELSE ' [1]' END), '⟦c9⟧', '') AS c FROM n)
        SELECT answer_id, md5(c) AS digest, length(c) AS n_chars FROM x""",
    "markdown_answers": f"""WITH {_CITED}, x AS (SELECT *, list_transform(range(1, len(plain) + 1), lambda i: plain[i] || CASE WHEN i > len(marks) THEN '' ELSE
            CASE WHEN (marks[i] = 'c1' AND n % 3 <> 0 OR marks[i] = 'c2' AND n % 3 <> 1) AND regexp_matches(right(CASE WHEN i > 1 THEN '⟧' ELSE '' END || plain[i], 40), '{_OPEN}')
                THEN CASE WHEN marks[i] = 'c1' THEN {_inline("('*' || substr(text, 1, 30))")} ELSE {_inline("('*' || text)")} END ELSE '' END || ' [' || marks[i] || '](#cite-' || marks[i] || ')' END) AS c FROM m)
        SELECT answer_id, md5(array_to_string(c, '')) AS digest, length(array_to_string(c, '')) AS n_chars FROM x""",
    "classified_changes": f"""WITH r AS (SELECT l_orderkey AS o, l_linenumber AS l, min(l_partkey) % 4 AS s, l_orderkey * 10 + l_linenumber AS p FROM lineitem GROUP BY 1, 2)
        SELECT o || '-' || l AS change_id, ({list(G.SEVERITIES)})[CASE WHEN p % 5 = 0 THEN s ELSE greatest(s, p % 4) END + 1] AS severity, CASE WHEN p % 5 <> 0 AND p % 3 <> 0 THEN 'told ' || p ELSE 'by rules' END AS summary, CASE WHEN p % 5 = 0 THEN 'rules' ELSE 'classifier' END AS told_by FROM r""",
}
