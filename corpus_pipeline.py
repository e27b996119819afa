"""The corpus pipeline: documents to a mix, one operator for each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, language_id, minhash_dedup, mixing, toxicity
from textloom.llm._common import marked_by_ids, read, scratch_table

#: Documents whose language is undetermined, or predicted with less certainty than this, go.
LEAST_CERTAINTY = 0.2
#: A language predicted with this certainty replaces the one that a document came with; a document without one takes what is predicted.
CERTAIN = 0.9
#: Documents that score this or more go.
TOXIC_FROM = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What follows goes by the language found here: the thresholds of toxicity are set for each."""
    return language_id.known(docs, LEAST_CERTAINTY, told_in="lang", certain=CERTAIN)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.civil(docs, toxicity.train(docs, read(spark, sf_dir, "labels")), TOXIC_FROM)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an id cannot be named by a group and stay; of equal rows one stays.

    Ids with one row that is kept pass by a membership map. Only the others, dropped or of several rows, are moved to meet
    the kept ids.
    """
    told = scratch_table(minhash_dedup.deduplicate(docs).groupBy("id").agg(F.count("*").alias("rows"), F.max("kept").alias("kept")), "verdicts")
    told = told.withColumnRenamed("id", "told_id")
    unsure = told.where("rows > 1 or not kept")
    marked = marked_by_ids(docs, "doc_id", unsure, "told_id")
    rest = marked.where("_map_maybe").select(*docs.columns)
    rest = rest.join(told.where("kept"), rest["doc_id"].eqNullSafe(told["told_id"]), "left_semi")
    rest = rest.withColumn("_text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_hash"]).select(*docs.columns)
    return marked.where("not _map_maybe").select(*docs.columns).unionByName(rest)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix is written to the shared folder, a row with its words for each slot; what comes back is its account, read from there."""
    mixed, told = mixing.mix(docs)
    account = mixing.account(scratch_table(mixed, "mixed-corpus"), told)
    return account.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language ID", keep_known_languages),
    ("toxicity", keep_civil),
    ("near-dedup", keep_one_of_each_group),
    ("decontamination", keep_unleaked),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again by the next."""
    rows = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if k < len(STAGES) - 1:
            rows = scratch_table(rows, name.replace(" ", "-"))
    return rows


#: Trained stages and hashed draws have no SQL form; tests compare with brute force.
ORACLE_SQL = None
