"""Shared parts: table reading, scratch tables, the ASCII word rule."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, shipped
from ..sources.scratch import folder

#: Fixed values of the contracts: words are runs of anything but these six ASCII characters.
ASCII_SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table of that name, through Spark's reader, so any store that Spark can open will do."""
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage: the rows survive the loss of any executor, and nothing above is computed twice. The
    files stay until the checkpoint folder is cleared.
    """
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_words(text: Column) -> Column:
    """Array of the words of a text, [^\\x20\\x09-\\x0D]+; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


#: Bits of a membership map at most: 2^18 rows of 64 bits, a few MB when broadcast, whatever the input.
MAX_MAP_BITS = 1 << 24


def marked_by_ids(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """rows with the column ``_map_maybe``: false where key is surely not among ids, true where it is or may be.

    The ids are hashed to a bit map of bounded size, which is broadcast; so rows that a join would only throw away (or
    only let pass) need not be shuffled. With more ids than the map can tell apart it says true more often, and the join behind
    it does the work.
    """
    n = ids.count()
    bits = min(MAX_MAP_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    spots = ids.select(place(F.col(id_col)).alias("_map_h")).select(F.floor(F.col("_map_h") / 64).alias("_map_word"), F.expr("shiftleft(1L, cast(_map_h % 64 as int))").alias("_map_mask"))
    spots = scratch_table(spots.groupBy("_map_word").agg(F.bit_or("_map_mask").alias("_map_mask")), "id-map")
    told = rows.withColumn("_map_h", place(F.col(key))).withColumn("_map_word", F.floor(F.col("_map_h") / 64)).join(F.broadcast(spots), "_map_word", "left")
    hit = F.expr("coalesce((_map_mask & shiftleft(1L, cast(_map_h % 64 as int))) <> 0, false)")
    return told.withColumn("_map_maybe", hit).select(*rows.columns, "_map_maybe")


def texts_of(batch: pa.RecordBatch, column: str, step: int = 512) -> Iterator[str | None]:
    """The texts of a batch; only a few hundred at a time are copied out of Arrow's memory."""
    texts = batch.column(column)
    for at in range(0, len(texts), step):
        yield from texts.slice(at, step).to_pylist()


def texts_kept(docs: DataFrame, text_col: str, rule: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows of docs, all columns as they are, whose text passes the rule that rule() makes once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = rule()
        for batch in batches:
            yield batch.filter(pa.array([passes(t) for t in texts_of(batch, text_col)], pa.bool_()))

    return docs.transform(shipped).mapInArrow(run, docs.schema)
