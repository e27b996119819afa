"""Algebra of half-open ranges [start, end) by document, in code points.

All operators take DataFrames with the columns ``doc``, ``start`` and ``end`` (further ones pass where it makes sense).
Empty ranges (end <= start) hold nothing. Joins always carry ``doc`` and a position bucket as equality keys, with the
overlap as the residual condition, so they plan as hash or sort-merge joins and a long document spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the position buckets that range joins are dealt by.
BUCKET = 4096


def _islands(rows: DataFrame) -> DataFrame:
    """rows with the number of the run that each range joins; equal ranges are in one run."""
    w = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    return rows.withColumn("island", F.sum("fresh").over(w))


def merge(ranges: DataFrame) -> DataFrame:
    """(doc, start, end): the union of each document's ranges; touching ranges join."""
    rows = _islands(ranges.where("end > start").select("doc", "start", "end"))
    return rows.groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def merge_all(ranges: DataFrame) -> DataFrame:
    """As ``merge``, but ranges that hold nothing stay where no other reaches them: empty ones as one range, those that end before they start once
    for each time they are given."""
    rows = _islands(ranges.select("doc", "start", "end"))
    rows = rows.groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    times = F.when(F.col("end") < F.col("start"), F.col("n")).otherwise(1)
    return rows.select("doc", "start", "end", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))).alias("_time")).drop("_time")


def total_length(ranges: DataFrame) -> DataFrame:
    """(doc, length) of the union."""
    return merge(ranges).groupBy("doc").agg(F.sum(F.col("end") - F.col("start")).alias("length"))


def _bucketed(rows: DataFrame, start: str, end: str, width: int) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / width)
    return rows.withColumn("_bucket", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, width: int = BUCKET) -> DataFrame:
    """Pairs that overlap, once each; right's columns other than doc get the prefix ``r_``. A pair that shares several
    buckets is kept in the one where its overlap starts."""
    r = right.select(*[F.col(c) if c == "doc" else F.col(c).alias(f"r_{c}") for c in right.columns])
    a, b = _bucketed(left.where("end > start"), "start", "end", width), _bucketed(r.where("r_end > r_start"), "r_start", "r_end", width)
    rows = a.join(b, ["doc", "_bucket"]).where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")))
    return rows.where(F.floor(F.greatest("start", "r_start") / width) == F.col("_bucket")).drop("_bucket")


def overlap_length(queries: DataFrame, ranges: DataFrame, key: list[str], width: int = BUCKET) -> DataFrame:
    """key and the summed overlap of each query range with a set that may overlap itself; 0 where there is none."""
    hits = overlap_join(queries, ranges, width)
    sums = hits.groupBy(*key).agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("overlap"))
    return queries.select(*key).join(sums, key, "left").select(*key, F.coalesce("overlap", F.lit(0)).alias("overlap"))


def subtract(ranges: DataFrame, removed: DataFrame) -> DataFrame:
    """(doc, start, end) of what ranges hold and removed do not: a sweep over both sides' boundaries."""

    def edges(rows: DataFrame, a: int, b: int) -> DataFrame:
        rows = rows.where("end > start")
        opening = rows.select("doc", F.col("start").alias("at"), F.lit(a).alias("a"), F.lit(b).alias("b"))
        return opening.unionByName(rows.select("doc", F.col("end").alias("at"), F.lit(-a).alias("a"), F.lit(-b).alias("b")))

    at = edges(ranges, 1, 0).unionByName(edges(removed, 0, 1)).groupBy("doc", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy("doc").orderBy("at")
    at = at.select("doc", F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("a").over(w).alias("held"), F.sum("b").over(w).alias("gone"))
    return merge(at.where("held > 0 and gone = 0 and end is not null"))


def containing(points: DataFrame, ranges: DataFrame, width: int = BUCKET) -> DataFrame:
    """points (doc, pos, ...) joined with the ranges that hold them (disjoint ranges: one at most)."""
    b = _bucketed(ranges.where("end > start"), "start", "end", width)
    return points.withColumn("_bucket", F.floor(F.col("pos") / width)).join(b, ["doc", "_bucket"]).where("start <= pos and pos < end").drop("_bucket")


def last_starting(points: DataFrame, items: DataFrame, value: list[str]) -> DataFrame:
    """points (doc, pos, ...) with the columns ``value`` of the last item that starts at or before pos, null if there is none.

    Both sides go through one window by position; items of equal start are ordered by their values.
    """
    carried = F.struct("start", *value)
    a = items.select("doc", F.col("start").alias("pos"), carried.alias("_item"), F.lit(0).alias("_kind"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in ("doc", "pos")])
    b = points.select("doc", "pos", F.lit(None).cast(a.schema["_item"].dataType).alias("_item"), F.lit(1).alias("_kind"), *[c for c in points.columns if c not in ("doc", "pos")])
    w = Window.partitionBy("doc").orderBy("pos", "_kind", "_item").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("_last", F.last("_item", ignorenulls=True).over(w))
    return rows.where("_kind = 1").select(*points.columns, *[F.col(f"_last.{v}").alias(v) for v in value])


def compress_numbers(rows: DataFrame, key: list[str], number: str) -> DataFrame:
    """key and a label such as "3–5, 41" of the distinct whole numbers of each key. Rows are dealt by key once, into all shuffle partitions: they are so
    well compressed that partitions made by their bytes hold many in a task's memory."""
    w = Window.partitionBy(*key).orderBy(number)
    dealt = rows.select(*key, number).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    runs = dealt.distinct().withColumn("island", F.col(number) - F.row_number().over(w))
    runs = runs.groupBy(*key, "island").agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("–", "lo", "hi"))
    parts = runs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("lo", text.alias("text")))).alias("parts"))
    return parts.select(*key, F.array_join(F.col("parts.text"), ", ").alias("label"))


def blanked(text: Column, skip: Column) -> Column:
    """text with the merged, sorted ranges of the array ``skip`` (start, end from 0) each replaced by one space; a space that
    already stands before a range is not doubled."""

    def step(acc: Column, r: Column) -> Column:
        lo, hi = F.least(F.greatest(r["start"], F.lit(0)), F.length(text)), F.least(r["end"], F.length(text))
        before = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(lo - acc["at"], F.lit(0))))
        inside = (hi > 0) & (lo < F.length(text))
        out = F.when(before.endswith(" "), before).otherwise(F.concat(before, F.lit(" ")))
        return F.when(inside, F.struct(out.alias("out"), F.greatest(acc["at"], hi).cast("int").alias("at"))).otherwise(acc)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(skip, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
