"""Queries on structure. Numbered lines come from parts (names as titles), running text from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import structure as S
from ..sources.tables import read

#: Rules with the words that the documents have; contracts would bring their own.
TITLE_RULES = [("widget", r"\bwidget\b"), ("ring", r"\bring"), ("red", r"^red\b|crimson"), ("small", "small|tiny"), ("gear", "gear|cog")]
BODY_RULES = [("bolt", "bolt"), ("plate", r"plate\b")]

_LINE_ENDS = "aggregate(lines, cast(array() as array<int>), (a, x) -> array_append(a, if(size(a) = 0, 0, a[size(a) - 1] + 1) + length(x)))"


def text_lines(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """(doc, ord, start, end, text) of every line of documents, or of those in ``only`` (doc)."""
    rows = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select(F.col("doc_id").alias("doc"), "text")
    return lines_of(rows if only is None else rows.join(only, "doc", "left_semi"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, ord, start, end, text) of every line of docs (doc, text) that have a text."""
    rows = docs.select("doc", F.split("text", "\n").alias("lines"))
    rows = rows.withColumn("ends", F.expr(_LINE_ENDS))
    rows = rows.select("doc", "ends", F.posexplode("lines").alias("ord", "text"))
    return rows.select("doc", "ord", (F.get("ends", F.col("ord")) - F.length("text")).alias("start"), F.get("ends", F.col("ord")).alias("end"), "text")


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("doc"), F.length("text").alias("n"))


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_lines(spark, sf_dir)
    return rows.select("doc", F.col("ord").cast("long").alias("ord"), F.col("start").cast("long").alias("start"), F.md5("text").alias("digest"))


def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a document, its documents are pages, first and last lines stand in the outer bands."""
    rows = read(spark, sf_dir, "documents", "doc_id", "source", "text").where("text is not null").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"), F.size(F.split("text", "\n")).alias("n"))
    pages = rows.select(F.col("source").alias("doc"), F.col("doc_id").alias("page_no"), F.col("k").alias("start"), (F.col("k") + 1).alias("end"), (F.col("k") / F.col("n")).alias("top"), ((F.col("k") + 1) / F.col("n")).alias("bottom"), "text")
    return S.furniture(pages, band=0.375, share=0.0625).groupBy("doc").agg(F.count("*").alias("n_lines"), F.count_distinct("page_no").alias("n_pages"))


def furniture_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part", "p_partkey", "p_name")
    return rows.select("p_partkey", S.furniture_form(F.concat(F.lit(" Page "), F.col("p_partkey"), F.lit("  of 400  "), "p_name")).alias("form"))


def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents", "doc_id", "text")
    return rows.select("doc_id", S.unreadable(F.col("text"), F.col("doc_id") % 2 == 0).alias("unreadable")).where("unreadable")


def _numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    title = F.initcap("p_name")
    text = (
        F.when(k % 10 == 0, F.concat(F.lit("ARTICLE "), F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV", "V", "VI"))), (F.floor(k / 10) % 6 + 1).cast("int")), F.lit(" - "), title))
        .when(k % 10 == 1, F.concat(F.lit("Section "), (F.floor(k / 10) % 4 + 1), F.lit("."), k % 3 + 1, F.lit(": "), title, F.lit(". It holds more.")))
        .when(k % 10 == 2, F.concat((F.floor(k / 10) % 5 + 1), F.lit("."), k % 4, F.lit(" "), title))
        .when(k % 10 == 3, F.concat(F.lit("EXHIBIT "), F.chr((F.lit(65) + k % 5)), F.lit(" "), title))
        .when(k % 10 == 4, F.upper("p_name"))
        .when(k % 10 == 5, F.concat(F.lit("(a) "), title))
        .when(k % 10 == 6, F.concat((F.floor(k / 10) % 5 + 1), F.lit("."), k % 4, F.lit(" "), title, F.lit(" ........ 12")))
        .otherwise(F.concat(title, F.lit(" goes on in plain words.")))
    )
    return read(spark, sf_dir, "part", "p_partkey", "p_name").select(F.floor(k / 40).alias("doc"), (k % 40).cast("int").alias("ord"), (k % 40 * 100).cast("int").alias("start"), (k % 40 * 100 + 90).cast("int").alias("end"), text.alias("text"))


_TITLED = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_NUMBERED = f"""SELECT p_partkey // 40 AS doc, p_partkey % 40 AS ord, p_partkey % 40 * 100 AS start, CASE p_partkey % 10
    WHEN 0 THEN 'ARTICLE ' || (['I', 'II', 'III', 'IV', 'V', 'VI'])[p_partkey // 10 % 6 + 1] || ' - ' || {_TITLED} WHEN 1 THEN 'Section ' || (p_partkey // 10 % 4 + 1) || '.' || (p_partkey % 3 + 1) || ': ' || {_TITLED} || '. It holds more.'
    WHEN 2 THEN (p_partkey // 10 % 5 + 1) || '.' || (p_partkey % 4) || ' ' || {_TITLED} WHEN 3 THEN 'EXHIBIT ' || chr(CAST(65 + p_partkey % 5 AS INTEGER)) || ' ' || {_TITLED} WHEN 4 THEN upper(p_name)
    WHEN 5 THEN '(a) ' || {_TITLED} WHEN 6 THEN (p_partkey // 10 % 5 + 1) || '.' || (p_partkey % 4) || ' ' || {_TITLED} || ' ........ 12' ELSE {_TITLED} || ' goes on in plain words.' END AS text, {_TITLED} AS t, p_partkey AS k FROM part"""
_HEADS = f"""SELECT doc, ord, start, text, k % 10 AS m, CASE k % 10 WHEN 0 THEN 'article' WHEN 1 THEN 'section' WHEN 3 THEN 'schedule' WHEN 4 THEN 'caps' ELSE 'numbered' END AS kind,
    CASE k % 10 WHEN 0 THEN (['I', 'II', 'III', 'IV', 'V', 'VI'])[k // 10 % 6 + 1] WHEN 1 THEN (k // 10 % 4 + 1) || '.' || (k % 3 + 1) WHEN 2 THEN (k // 10 % 5 + 1) || '.' || (k % 4) WHEN 6 THEN (k // 10 % 5 + 1) || '.' || (k % 4)
        WHEN 3 THEN 'Exhibit ' || chr(CAST(65 + k % 5 AS INTEGER)) END AS number,
    CASE k % 10 WHEN 3 THEN 'Exhibit ' || chr(CAST(65 + k % 5 AS INTEGER)) || ' ' || t WHEN 6 THEN t || ' ........ 12' ELSE t END AS title, CASE WHEN k % 10 IN (1, 2, 6) THEN 2 ELSE 1 END AS level FROM ({_NUMBERED}) WHERE k % 10 IN (0, 1, 2, 3, 4, 6)"""


def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.headings(_numbered_lines(spark, sf_dir))
    return rows.select("doc", F.col("ord").cast("long").alias("ord"), "kind", "number", "title", F.col("level").cast("long").alias("level"))


def headings_without_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.without_contents(S.headings(_numbered_lines(spark, sf_dir)))
    return rows.select("doc", F.col("ord").cast("long").alias("ord"), "number", "title")


def headings_in_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.in_sequence(S.headings(_numbered_lines(spark, sf_dir))).select("doc", F.col("ord").cast("long").alias("ord"), "kind", "number", "title")


def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = S.headings(_numbered_lines(spark, sf_dir))
    n = heads.groupBy("doc").agg(F.lit(4000).alias("n"))
    rows = S.section_tree(heads, n)
    return rows.select("doc", *[F.col(c).cast("long").alias(c) for c in ("ord", "level", "parent", "start", "end")], "title")


def fallback_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fallback_parts(text_lines(spark, sf_dir), lengths(spark, sf_dir)).select("doc", "title", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    raw = F.when(F.col("p_partkey") % 2 == 0, F.upper(F.concat_ws(" ", "p_name", F.lit("of the"), "p_type"))).otherwise(F.concat_ws(" ", "p_name", F.lit("stands here. Then more:")))
    return rows.select("p_partkey", S.title_from(raw).alias("title"))


def roman_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    numerals = ["I", "IV", "IX", "XIV", "XL", "XC", "CXLIX"]
    return read(spark, sf_dir, "nation", "n_nationkey").select("n_nationkey", S.roman_value(F.element_at(F.array(*map(F.lit, numerals)), F.col("n_nationkey") % 7 + 1)).cast("long").alias("value"))


def clause_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = S.headings(_numbered_lines(spark, sf_dir))
    tree = S.section_tree(heads, heads.groupBy("doc").agg(F.lit(4000).alias("n")))
    lines = _numbered_lines(spark, sf_dir).groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.rpad("text", 100, " ").alias("t")))), lambda x: x["t"]), "").alias("text"))
    return S.clause_tags(tree, lines, TITLE_RULES, BODY_RULES).select("doc", F.col("ord").cast("long").alias("ord"), "type", "confidence")


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole documents by parts."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select(F.col("doc_id").alias("doc"), "text")
    return chunks_of(docs)


def chunks_of(docs: DataFrame) -> DataFrame:
    """Chunks of docs (doc, text) that have a text, by parts."""
    parts = S.fallback_parts(lines_of(docs), docs.select("doc", F.length("text").alias("n"))).withColumns({"parent": F.lit(None).cast("int"), "number": F.lit(None).cast("string")})
    return S.chunks(docs.withColumn("furniture", F.expr("cast(array() as array<struct<start:int,end:int>>)")), parts)


def scan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.windows(document_chunks(spark, sf_dir), lengths(spark, sf_dir), 1500)


QUERIES = {f.__name__: f for f in (
    line_offsets, furniture_lines, furniture_forms, page_quality, heading_lines, headings_without_contents, headings_in_sequence, section_tree, fallback_parts, titles, roman_numbers, clause_tags, token_estimates,
    document_chunks, scan_windows,
)}

SQL = {
    "line_offsets": """WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents WHERE text IS NOT NULL)
        SELECT doc, ord, CAST(coalesce(sum(length(x) + 1) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, md5(x) AS digest FROM l""",
    "furniture_lines": """WITH l AS (SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
        p AS (SELECT doc, count(DISTINCT page) AS n_pages FROM l GROUP BY doc), o AS (SELECT *, trim(regexp_replace(regexp_replace(lower(x), '\\d+', '#', 'g'), '\\s+', ' ', 'g'), ' ') AS form FROM l WHERE k / n <= 0.375 OR (k + 1) / n >= 0.625),
        s AS (SELECT doc, form, count(DISTINCT page) AS n_on FROM o WHERE form <> '' GROUP BY 1, 2)
        SELECT o.doc, count(*) AS n_lines, count(DISTINCT page) AS n_pages FROM o JOIN p ON p.doc = o.doc LEFT JOIN s ON s.doc = o.doc AND s.form = o.form
        WHERE (p.n_pages >= 3 AND coalesce(n_on, 0) >= greatest(3, ceil(p.n_pages * 0.0625))) OR regexp_matches(o.form, '^\\s*(page\\s*)?#(\\s*(of|/)\\s*#)?\\s*$') OR regexp_matches(o.form, '^\\s*[-–—]\\s*#\\s*[-–—]\\s*$')
            OR (o.form <> '' AND regexp_matches(o.form, '^\\s*m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})\\s*$')) GROUP BY o.doc""",
    "furniture_forms": "SELECT p_partkey, trim('page # of # ' || p_name, ' ') AS form FROM part",
    "page_quality": """WITH d AS (SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS s, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS w FROM documents)
        SELECT doc_id, true AS unreadable FROM d WHERE (s > 0 AND w / s < 0.5) OR (s < 20 AND doc_id % 2 = 0)""",
    "heading_lines": f"SELECT doc, ord, kind, number, title, level FROM ({_HEADS})",
    "headings_without_contents": f"""WITH h AS (SELECT *, coalesce(number, '') || '|' || trim(regexp_replace(regexp_replace(lower(title), '\\s*\\d+\\s*$', ''), '[^a-z0-9]+', ' ', 'g'), ' ') AS key FROM ({_HEADS}) WHERE m <> 6),
        c AS (SELECT *, count(*) OVER (PARTITION BY doc, key) AS n, row_number() OVER (PARTITION BY doc, key ORDER BY ord DESC) AS back FROM h), r AS (SELECT *, sum(CASE WHEN n > 1 AND back = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc) AS recur FROM c)
        SELECT doc, ord, number, title FROM r WHERE recur < 3 OR back = 1""",
    "headings_in_sequence": f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord) AS i, kind = 'article' OR NOT contains(number, '.') AS flat,
            CASE WHEN kind = 'article' THEN list_position(['I', 'II', 'III', 'IV', 'V', 'VI'], number) WHEN kind IN ('section', 'numbered') THEN CAST(string_split(number, '.')[1] AS INTEGER) END AS top FROM ({_HEADS})),
        s AS (SELECT DISTINCT doc, CAST(0 AS BIGINT) AS i, CAST(NULL AS INTEGER) AS reached, []::VARCHAR[] AS seen, false AS took FROM h UNION ALL
            SELECT s.doc, h.i, CASE WHEN h.kind = 'schedule' THEN NULL WHEN h.kind <> 'caps' AND ok THEN h.top ELSE s.reached END, CASE WHEN h.kind = 'schedule' THEN [] WHEN h.kind <> 'caps' AND ok THEN list_append(s.seen, h.number) ELSE s.seen END, ok
            FROM s JOIN h ON h.doc = s.doc AND h.i = s.i + 1, LATERAL (SELECT h.kind IN ('caps', 'schedule') OR (h.top IS NOT NULL AND NOT list_contains(s.seen, h.number)
                AND CASE WHEN s.reached IS NULL THEN h.top <= 3 WHEN h.flat THEN h.top BETWEEN s.reached + 1 AND s.reached + 2 ELSE h.top BETWEEN s.reached AND s.reached + 2 END) AS ok) AS o)
        SELECT h.doc, CAST(h.ord AS BIGINT) AS ord, h.kind, h.number, h.title FROM s JOIN h ON h.doc = s.doc AND h.i = s.i WHERE s.took""",
    "section_tree": f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY start) - 1 AS i FROM ({_HEADS}))
        SELECT a.doc, a.i AS ord, CAST(a.level AS BIGINT) AS level, (SELECT max(b.i) FROM h b WHERE b.doc = a.doc AND b.i < a.i AND b.level < a.level) AS parent, a.start,
            coalesce((SELECT min(b.start) FROM h b WHERE b.doc = a.doc AND b.i > a.i AND b.level <= a.level), 4000) AS "end", a.title FROM h a""",
    "fallback_parts": """WITH RECURSIVE l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents WHERE text <> ''),
        s AS (SELECT doc, CAST(coalesce(sum(length(x) + 1) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p FROM l),
        c AS (SELECT doc, CAST(0 AS BIGINT) AS p, 1 AS k FROM s WHERE p = 0 UNION ALL SELECT c.doc, min(s.p), c.k + 1 FROM c JOIN s ON s.doc = c.doc AND s.p - c.p >= 2000 GROUP BY c.doc, c.p, c.k)
        SELECT c.doc, 'Part ' || k AS title, p AS start, coalesce(lead(p) OVER (PARTITION BY c.doc ORDER BY k), length(text)) AS "end" FROM c JOIN documents d ON d.doc_id = c.doc""",
    "titles": """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN string_split(lower(p_name || ' of the ' || p_type), ' ') ELSE string_split(p_name || ' stands here', ' ') END AS w FROM part)
        SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN array_to_string(list_transform(w[1:10], lambda x, i: CASE WHEN i > 1 AND x IN ('of', 'the') THEN x ELSE upper(x[1]) || x[2:] END), ' ') ELSE array_to_string(w[1:10], ' ') END AS title FROM r""",
    "roman_numbers": "SELECT n_nationkey, CAST(([1, 4, 9, 14, 40, 90, 149])[n_nationkey % 7 + 1] AS BIGINT) AS value FROM nation",
    "clause_tags": f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY start) - 1 AS i FROM ({_HEADS})), a AS (SELECT string_agg(rpad(text, 100, ' '), '' ORDER BY ord) AS body, doc FROM ({_NUMBERED}) GROUP BY doc),
        e AS (SELECT x.*, coalesce((SELECT min(b.start) FROM h b WHERE b.doc = x.doc AND b.i > x.i AND b.level <= x.level), 4000) AS e FROM h x),
        t AS (SELECT e.*, substring(body, CAST(start + 1 AS BIGINT), CAST(least(e - start, 200) AS BIGINT)) AS b, list_filter(['widget', 'ring', 'red', 'small', 'gear'], lambda r: CASE r WHEN 'widget' THEN regexp_matches(title, '(?i)\\bwidget\\b')
            WHEN 'ring' THEN regexp_matches(title, '(?i)\\bring') WHEN 'red' THEN regexp_matches(title, '(?i)^red\\b|crimson') WHEN 'small' THEN regexp_matches(title, '(?i)small|tiny') ELSE regexp_matches(title, '(?i)gear|cog') END) AS tags FROM e JOIN a ON a.doc = e.doc)
        SELECT doc, i AS ord, unnest(tags) AS type, 0.8::DOUBLE AS confidence FROM t UNION ALL SELECT doc, i, 'bolt', 0.4 FROM t WHERE len(tags) = 0 AND number IS NOT NULL AND regexp_matches(b, '(?i)bolt')
        UNION ALL SELECT doc, i, 'plate', 0.4 FROM t WHERE len(tags) = 0 AND number IS NOT NULL AND regexp_matches(b, '(?i)plate\\b')""",
    "token_estimates": "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents",
}
