"""Queries over the range algebra. Ranges come from events: a user is a document, value places a range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranges as R
from ..sources.tables import read


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    start = F.floor(F.col("value") * 20).cast("long")
    return rows.select("event_id", "event_type", F.col("user_id").alias("doc"), start.alias("start"), (start + F.col("event_id") % 90).alias("end"))


_SOURCE = "SELECT event_id, event_type, user_id AS doc, CAST(floor(value * 20) AS BIGINT) AS s, CAST(floor(value * 20) AS BIGINT) + event_id % 90 AS e FROM events"


def _merged(source: str) -> str:
    return f"""SELECT doc, min(s) AS s, max(e) AS e FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
            SELECT doc, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY doc ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
            FROM ({source}) WHERE e > s)) GROUP BY doc, island"""


def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge(_events(spark, sf_dir))


def range_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.total_length(_events(spark, sf_dir))


def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return R.overlap_length(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), ["event_id"])


def range_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return R.subtract(rows.where("event_type in ('click', 'view')"), rows.where("event_type = 'error'"))


def range_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    points = rows.where("event_type = 'signup'").select("event_id", "doc", F.col("start").alias("pos"))
    return R.containing(points, R.merge(rows.where("event_type = 'error'"))).select("event_id", "pos", "start", "end")


def range_last_starting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    points = rows.where("event_type = 'signup'").select("event_id", "doc", F.col("start").alias("pos"))
    starts = R.merge(rows.where("event_type = 'error'")).select("doc", "start", F.col("start").alias("found"))
    return R.last_starting(points, starts, ["found"]).select("event_id", "pos", "found")


def compress_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("doc", (F.col("start") % 60).alias("page"))
    return R.compress_numbers(rows, ["doc"], "page")


def blank_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    skip = F.array(*[F.struct(((F.col("doc_id") % 7 + a) * 3).cast("int").alias("start"), ((F.col("doc_id") % 7 + a) * 3 + b).cast("int").alias("end")) for a, b in ((2, 4), (10, 9), (40, 1))])
    return rows.select("doc_id", R.blanked(F.col("text"), skip).alias("blanked"))


QUERIES = {
    "merge_ranges": merge_ranges,
    "range_length": range_length,
    "range_overlap": range_overlap,
    "range_subtract": range_subtract,
    "range_point_lookup": range_point_lookup,
    "range_last_starting": range_last_starting,
    "compress_numbers": compress_numbers,
    "blank_ranges": blank_ranges,
}

SQL = {
    "merge_ranges": f'SELECT doc, s AS start, e AS "end" FROM ({_merged(_SOURCE)})',
    "range_length": f"SELECT doc, CAST(sum(e - s) AS BIGINT) AS length FROM ({_merged(_SOURCE)}) GROUP BY doc",
    "range_overlap": f"""WITH r AS ({_SOURCE})
        SELECT q.event_id, CAST(coalesce(sum(CASE WHEN v.event_id IS NOT NULL THEN least(q.e, v.e) - greatest(q.s, v.s) END), 0) AS BIGINT) AS overlap
        FROM r q LEFT JOIN r v ON v.doc = q.doc AND v.event_type = 'view' AND v.s < v.e AND q.s < q.e AND v.s < q.e AND q.s < v.e
        WHERE q.event_type = 'click' GROUP BY q.event_id""",
    "range_subtract": f"""WITH r AS ({_SOURCE}), e AS (
            SELECT doc, s AS p, 1 AS a, 0 AS b FROM r WHERE event_type IN ('click', 'view') AND e > s UNION ALL SELECT doc, e, -1, 0 FROM r WHERE event_type IN ('click', 'view') AND e > s
            UNION ALL SELECT doc, s, 0, 1 FROM r WHERE event_type = 'error' AND e > s UNION ALL SELECT doc, e, 0, -1 FROM r WHERE event_type = 'error' AND e > s),
        g AS (SELECT doc, p, sum(a) AS a, sum(b) AS b FROM e GROUP BY doc, p),
        w AS (SELECT doc, p AS s, lead(p) OVER (PARTITION BY doc ORDER BY p) AS e, sum(a) OVER (PARTITION BY doc ORDER BY p) AS held, sum(b) OVER (PARTITION BY doc ORDER BY p) AS gone FROM g)
        SELECT doc, s AS start, e AS "end" FROM ({_merged("SELECT doc, s, e FROM w WHERE held > 0 AND gone = 0 AND e IS NOT NULL")})""",
    "range_point_lookup": f"""WITH r AS ({_SOURCE}), m AS ({_merged("SELECT * FROM r WHERE event_type = 'error'")})
        SELECT p.event_id, p.s AS pos, m.s AS start, m.e AS "end" FROM r p JOIN m ON m.doc = p.doc AND m.s <= p.s AND p.s < m.e WHERE p.event_type = 'signup'""",
    "range_last_starting": f"""WITH r AS ({_SOURCE}), m AS ({_merged("SELECT * FROM r WHERE event_type = 'error'")}), p AS (SELECT event_id, doc, s AS pos FROM r WHERE event_type = 'signup')
        SELECT p.event_id, p.pos, m.s AS found FROM p ASOF LEFT JOIN m ON p.doc = m.doc AND p.pos >= m.s""",
    "compress_numbers": f"""WITH n AS (SELECT DISTINCT doc, s % 60 AS n FROM ({_SOURCE})), i AS (SELECT doc, n, n - row_number() OVER (PARTITION BY doc ORDER BY n) AS k FROM n),
        g AS (SELECT doc, min(n) AS lo, max(n) AS hi FROM i GROUP BY doc, k)
        SELECT doc, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '–' || hi END, ', ' ORDER BY lo) AS label FROM g GROUP BY doc""",
    "blank_ranges": """WITH t AS (SELECT doc_id, text AS x, (doc_id % 7 + 2) * 3 AS a, (doc_id % 7 + 10) * 3 AS b, (doc_id % 7 + 40) * 3 AS c FROM documents WHERE text IS NOT NULL),
        u AS (SELECT doc_id, x, b, c, CASE WHEN length(x) > a THEN rtrim(substring(x, 1, a), ' ') || repeat(' ', greatest(1, length(substring(x, 1, a)) - length(rtrim(substring(x, 1, a), ' ')))) ELSE x END AS o, CASE WHEN length(x) > a THEN a + 4 ELSE 0 END AS p1, a FROM t),
        v AS (SELECT doc_id, x, c, CASE WHEN length(x) > b THEN o || substring(x, p1 + 1, b - p1) ELSE o END AS o, CASE WHEN length(x) > b THEN b + 9 ELSE p1 END AS p2, b, p1, a FROM u),
        w AS (SELECT doc_id, x, c, p2, b, CASE WHEN length(x) > b AND right(o, 1) <> ' ' THEN o || ' ' ELSE o END AS o FROM v),
        y AS (SELECT doc_id, x, c, p2, CASE WHEN length(x) > c THEN o || substring(x, p2 + 1, c - p2) ELSE o END AS o FROM w),
        z AS (SELECT doc_id, x, c, p2, CASE WHEN length(x) > c AND right(o, 1) <> ' ' THEN o || ' ' ELSE o END AS o FROM y)
        SELECT doc_id, CASE WHEN length(x) > c THEN o || substring(x, c + 2) WHEN p2 > 0 THEN o || substring(x, p2 + 1) ELSE x END AS blanked FROM z""",
}
