"""Queries of leases, intake codes, labels of what was read, notices, rendered spans and markup, built citations, results that fit and tables rewritten in part."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage as C
from ..operators import relational as H
from ..operators import structure as S
from ..operators import tools as T
from ..operators import verification as V
from ..sources import files
from ..sources.files import BULLET, html_text, rendered, spans_of
from ..sources.scratch import folder
from ..sources.tables import read, rewrite_documents, write_partitioned
from .relational_queries import _JOBS, _jobs, _now


def queue_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    rows = H.heartbeat(jobs, jobs.where("job_id % 3 = 0").select("job_id"), _now())
    return rows.select("job_id", F.date_format("locked_until", "yyyy-MM-dd HH:mm:ss").alias("locked_until"), "alive")


def queue_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    done = jobs.where("job_id % 2 = 1").select("job_id", F.when(F.col("job_id") % 5 == 0, "damaged").alias("error_code"))
    rows = H.complete(jobs, done)
    return rows.groupBy("status", F.col("locked_until").isNull().alias("free")).agg(F.count("*").alias("n"), F.count_if(H.comparison_retryable(F.col("status"))).alias("retryable"))


def intake_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part", "p_partkey").withColumn("kind", F.when(k % 2 == 0, "pdf").otherwise("docx"))
    code = files.content_error(k % 7 == 0, k % 5 != 0, k % 600, k % 60 * 10, F.col("kind"))
    taken, rejected = files.split_by_error(rows, code)
    taken = taken.select(F.lit("").alias("code"), F.lit(0).alias("status"), "kind")
    both = taken.unionByName(rejected.select("code", "status", "kind"))
    return both.groupBy("code", F.col("status").cast("long").alias("status")).agg(F.count("*").alias("n"))


def documents_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines are its pages; every fourth shows an image. A null text is one empty page."""
    rows = read(spark, sf_dir, "documents", "doc_id", "text")
    pages = rows.select(F.col("doc_id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("page", "text"))
    return S.without_text(pages.select("doc", "text", S.unreadable(F.col("text"), F.col("page") % 4 == 0).alias("bad")))


def touched_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part", "p_partkey", "p_size").select(F.floor(k / 40).alias("doc"), (k % 40).alias("ord"), (k % 40 * 100).alias("start"), (k % 40 * 100 + 100).alias("end"), F.lit(1).alias("level"), F.when((F.floor(k / 40) % 2 == 0) | (k % 3 == 0), (k % 40 + 1).cast("string")).alias("number"), F.concat(F.lit("T"), k % 40).alias("title"), "p_size")
    ranges = rows.where("p_size % 2 = 0").select("doc", F.col("start").alias("start"), (F.col("start") + F.col("p_size")).alias("end"))
    return C.touched_sections(ranges, rows.drop("p_size"))


def answer_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, "The contract does not mention it.").when(k % 4 == 1, "It says so.").when(k % 4 == 2, " ").otherwise("There is no clause on it.")
    answers = read(spark, sf_dir, "part", "p_partkey").select(k.alias("answer_id"), text.alias("text"), (k % 3 == 0).alias("complete"), (k % 5 % 2).alias("unreadable"), (k % 7).alias("n_citations"), F.greatest(F.lit(0), k % 7 - 3).alias("n_verified"))
    return C.notices(answers).groupBy("code").agg(F.count("*").alias("n"), F.sum("answer_id").alias("ids"))


def rendered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 30 characters every 50; positions between two belong to the end of the first."""
    events = read(spark, sf_dir, "events", "event_id", "user_id", "value")
    positions = events.select(F.col("user_id").alias("doc"), "event_id", F.floor(F.col("value") * 20).cast("long").alias("pos"))
    docs = events.select(F.col("user_id").alias("doc"), F.floor(F.col("value") * 20 / 50).cast("long").alias("node")).distinct()
    spans = docs.select("doc", (F.col("node") * 50).alias("start"), "node", F.lit(30).cast("long").alias("length"))
    return V.rendered_spans(positions, spans).select("event_id", "node", "offset")


def built_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    span = lambda a, n: F.struct(a.cast("int").alias("start"), (a + n).cast("int").alias("end"))
    docs = read(spark, sf_dir, "documents", "doc_id", "text").where("length(text) >= 200")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    status = F.element_at(F.array(*map(F.lit, ("verified", "unverified", "abandoned", "verified_close", "misattributed"))), (d % 5 + 1).cast("int"))
    verdicts = docs.select(d.alias("quote_id"), "doc_id", status.alias("status"), F.array(span(d % 40, 30), span(d % 40 + 50, 30)).alias("occurrences"), (d % 2).cast("int").alias("primary"), F.when(d % 3 == 0, F.array(span(d % 40, 20), span(d % 40 + 60, 25))).otherwise(none).alias("segments"))
    return V.built_citations(verdicts, docs)


def fitted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("m"))
    item = F.concat(F.lit('{"n":'), F.col("l_linenumber"), F.lit(',"mode":"'), "m", F.lit('"}'))
    rows = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", item.alias("t")))).alias("i"))
    told = rows.select("l_orderkey", T.fitted(F.concat(F.lit('"order":'), "l_orderkey"), F.col("i.t"), 130).alias("f"))
    return told.select("l_orderkey", F.col("f.kept").cast("long").alias("kept"), "f.truncated", "f.json")


def rewritten_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of all documents' digests; then a tenth is derived anew, twice, as after a run that was cut off."""
    path = f"{folder(spark)}/rewritten-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents", "doc_id", "text").where("doc_id is not null")
    write_partitioned(docs.select("doc_id", F.md5("text").alias("digest")), path, "doc_id")
    fresh = docs.where("doc_id % 10 = 3").select("doc_id", F.md5(F.concat("text", F.lit("!"))).alias("digest"))
    for _ in range(2):
        rewrite_documents(spark, path, fresh)
    return spark.read.parquet(path).select("doc_id", "digest")


def _turn_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as paragraphs: numbered, bulleted and plain ones."""
    k = F.col("turn") % 4
    label = F.when(k == 0, F.concat(F.lit("<"), F.col("turn").cast("string"), F.lit(".>"))).when(k == 1, BULLET)
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.struct("turn", "role", "text").alias("ord"), F.lit("p").alias("tag"), label.alias("label"), "text")


def _offsets(paragraphs: DataFrame) -> DataFrame:
    """Of each document's markup, read back: spans, characters, and how many spans show something else than the text has at their offset."""
    rows = rendered(paragraphs)
    spans = spans_of(rows.select("doc", "ord", "html")).join(rows.select("doc", "ord", F.col("start").alias("from"), "text"), ["doc", "ord"])
    wrong = F.substring("text", (F.col("start") - F.col("from") + 1).cast("int"), F.col("length")) != F.col("shown")
    return spans.groupBy("doc").agg(F.count("*").alias("n_spans"), F.sum("length").alias("n_chars"), F.sum(F.col("start")).alias("starts"), F.count_if(wrong).alias("n_wrong"))


def turn_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(_turn_paragraphs(spark, sf_dir))


def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of every page."""
    blocks = html_text(read(spark, sf_dir, "pages", "page_id", "html"))
    return _offsets(blocks.select(F.col("page_id").alias("doc"), "ord", "tag", F.lit(None).cast("string").alias("label"), "text"))


QUERIES = {f.__name__: f for f in (queue_heartbeat, queue_complete, intake_split, documents_without_text, touched_sections, answer_notices, rendered_spans, built_citations, fitted_results, rewritten_documents, turn_offsets, page_offsets)}

SQL = {
    "documents_without_text": """WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS page FROM documents),
        n AS (SELECT doc_id, page, length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS solid, len(regexp_extract_all(t, '[\\p{L}\\p{N}]')) AS words, len(regexp_extract_all(t, '[\\x{FFFD}\\x{E000}-\\x{F8FF}\\x00-\\x08\\x0E-\\x1F]')) AS odd FROM p),
        b AS (SELECT *, solid > 0 AND (words < 0.5 * solid OR odd > 0.2 * solid) OR solid < 20 AND page % 4 = 0 AS bad FROM n)
        SELECT doc_id AS doc FROM b GROUP BY doc_id HAVING bool_and(bad) OR coalesce(sum(solid) FILTER (WHERE NOT bad), 0) < 50""",
    "queue_heartbeat": f"""SELECT job_id, strftime(CASE WHEN job_id % 3 = 0 AND status = 'running' THEN TIMESTAMP '2024-01-15 00:02:00' ELSE locked_until END, '%Y-%m-%d %H:%M:%S') AS locked_until, CASE WHEN job_id % 3 = 0 THEN status = 'running' END AS alive FROM ({_JOBS})""",
    "queue_complete": f"""WITH j AS (SELECT *, job_id % 2 = 1 AND status = 'running' AS ends FROM ({_JOBS})), s AS (SELECT CASE WHEN ends THEN CASE WHEN job_id % 5 = 0 THEN 'failed' ELSE 'done' END ELSE status END AS status, ends FROM j)
        SELECT status, ends AS free, count(*) AS n, count(*) FILTER (WHERE status = 'failed') AS retryable FROM s GROUP BY 1, 2""",
    "intake_split": """WITH c AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'encrypted' WHEN p_partkey % 5 = 0 THEN 'damaged' WHEN p_partkey % 600 > 500 THEN 'too_many_pages' WHEN p_partkey % 60 * 10 < 50 THEN CASE WHEN p_partkey % 2 = 0 THEN 'no_text_layer' ELSE 'empty_document' END ELSE '' END AS code FROM part)
        SELECT code, CAST(CASE code WHEN '' THEN 0 WHEN 'empty_document' THEN 400 ELSE 422 END AS BIGINT) AS status, count(*) AS n FROM c GROUP BY 1, 2""",
    "touched_sections": """WITH p AS (SELECT p_partkey // 40 AS doc, p_partkey % 40 AS ord, p_size, p_partkey // 40 % 2 = 0 OR p_partkey % 3 = 0 AS numbered FROM part), h AS (SELECT * FROM p WHERE p_size % 2 = 0 AND p_size > 20),
        i AS (SELECT doc, ord + 1 AS n, ord + 1 - row_number() OVER (PARTITION BY doc ORDER BY ord) AS g FROM h), u AS (SELECT doc, min(n) AS lo, max(n) AS hi FROM i GROUP BY doc, g),
        a AS (SELECT doc, string_agg('§' || CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '–' || hi END, ', ' ORDER BY lo) AS plain FROM u GROUP BY doc),
        b AS (SELECT doc, bool_and(numbered) AS whole, list(CASE WHEN numbered THEN '§' || (ord + 1) ELSE 'T' || ord END ORDER BY ord) AS t FROM h GROUP BY doc)
        SELECT a.doc, CASE WHEN whole THEN plain ELSE array_to_string(t[1:12], ', ') || CASE WHEN len(t) > 12 THEN ' and ' || (len(t) - 12) || ' more' ELSE '' END END AS label FROM a JOIN b ON b.doc = a.doc""",
    "answer_notices": """WITH a AS (SELECT p_partkey AS k, greatest(0, p_partkey % 7 - 3) AS v FROM part), n AS (SELECT k, 'ABSENCE_UNVERIFIED' AS code FROM a WHERE k % 4 IN (0, 3) AND k % 3 <> 0 UNION ALL SELECT k, 'UNREADABLE_PAGES' FROM a WHERE k % 5 % 2 > 0
        UNION ALL SELECT k, CASE WHEN k % 7 > 0 THEN 'QUOTES_NOT_FOUND' ELSE 'NO_QUOTES' END FROM a WHERE k % 4 <> 2 AND v = 0) SELECT code, count(*) AS n, CAST(sum(k) AS BIGINT) AS ids FROM n GROUP BY code""",
    "rendered_spans": """SELECT event_id, CAST(floor(value * 20 / 50) AS BIGINT) AS node, least(CAST(floor(value * 20) AS BIGINT) - CAST(floor(value * 20 / 50) AS BIGINT) * 50, 30) AS "offset" FROM events""",
    "built_citations": """WITH d AS (SELECT doc_id AS k, doc_id % 40 AS a, text AS t, (['verified', 'unverified', 'abandoned', 'verified_close', 'misattributed'])[doc_id % 5 + 1] AS s FROM documents WHERE length(text) >= 200),
        c AS (SELECT k, s, CASE WHEN k % 3 = 0 THEN [substring(t, CAST(a + 1 AS BIGINT), 20), substring(t, CAST(a + 61 AS BIGINT), 25)] WHEN k % 2 = 0 THEN [substring(t, CAST(a + 1 AS BIGINT), 30)] ELSE [substring(t, CAST(a + 51 AS BIGINT), 30)] END AS w FROM d)
        SELECT k AS quote_id, CASE WHEN s = 'abandoned' THEN 'unverified' ELSE s END AS status, CASE WHEN s IN ('verified', 'verified_close') THEN array_to_string(list_transform(w, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'), ' ')), ' … ') END AS display FROM c""",
    "rewritten_documents": "SELECT doc_id, md5(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS digest FROM documents",
    "turn_offsets": """WITH c AS (SELECT conv_id AS doc, turn, role, text, CASE WHEN turn % 4 = 0 THEN length('<' || turn || '.> ') ELSE 0 END AS a, length(coalesce(text, '')) AS b FROM conversations),
        v AS (SELECT *, CAST(coalesce(sum(a + b + 1) OVER (PARTITION BY doc ORDER BY turn, role NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM c WHERE a > 0 OR regexp_matches(text, '[^\\s]'))
        SELECT doc, CAST(sum(CASE WHEN a > 0 THEN 1 ELSE 0 END + CASE WHEN b > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_spans, CAST(sum(a + b) AS BIGINT) AS n_chars, CAST(sum(CASE WHEN a > 0 THEN s ELSE 0 END + CASE WHEN b > 0 THEN s + a ELSE 0 END) AS BIGINT) AS starts, CAST(0 AS BIGINT) AS n_wrong
        FROM v GROUP BY doc""",
    "fitted_results": """WITH i AS (SELECT l_orderkey AS o, l_linenumber AS n, '{"n":' || l_linenumber || ',"mode":"' || min(l_returnflag) || '"}' AS t FROM lineitem GROUP BY 1, 2), l AS (SELECT o, list(t ORDER BY n) AS t FROM i GROUP BY o),
        w AS (SELECT *, '{"order":' || o || ',"items":[' || array_to_string(t, ',') || ']}' AS whole FROM l), r AS (SELECT *, ',"truncated":true,"chars_available":' || length(whole) || '}' AS note FROM w),
        k AS (SELECT *, len(list_filter(range(1, len(t) + 1), lambda j: length('{"order":' || o || ',"items":[' || array_to_string(t[1:j], ',') || ']') + length(note) <= 130)) AS j FROM r)
        SELECT o AS l_orderkey, CAST(CASE WHEN length(whole) <= 130 THEN len(t) ELSE j END AS BIGINT) AS kept, length(whole) > 130 AS truncated, CASE WHEN length(whole) <= 130 THEN whole WHEN j > 0 THEN '{"order":' || o || ',"items":[' || array_to_string(t[1:j], ',') || ']' || note
            ELSE '{"error":"RESULT_TOO_LARGE","truncated":true,"chars_available":' || length(whole) || '}' END AS json FROM k""",
}
