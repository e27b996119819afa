"""Bookkeeping over tables of conversations, documents and jobs: pure DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lease and backoff in seconds, error codes that no retry mends.
LEASE_SECONDS = 120
BACKOFF_SECONDS = 10
PERMANENT_ERRORS = ("unsupported_type", "too_large", "too_many_pages", "encrypted", "damaged", "no_text_layer", "empty_document")


def latest_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by the order columns: one aggregation with map-side combine, no sort."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(key, "row.*")


def first_or_counted(rows: DataFrame, order: str, count: str) -> DataFrame:
    """The first row and those whose count is positive; the first is found without sorting the rest."""
    first = rows.orderBy(order).limit(1).where(F.col(count) <= 0)
    return rows.where(F.col(count) > 0).unionByName(first)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def history(messages: DataFrame, *, budget: int, limit: int = 40, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The newest turns of each conversation whose running token sum stays within budget (it stops at the first that
    does not fit), from the first user turn among them on. Blank texts take no room and are left out."""
    newest = Window.partitionBy(conv).orderBy(F.col(turn).desc(), "role")
    rows = messages.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= limit)
    rows = rows.withColumn("text", F.btrim("text")).where("text <> ''").withColumn("tokens", token_estimate(F.col("text")))
    rows = rows.withColumn("used", F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)
    oldest_user = F.min(F.when(F.col("role") == "user", F.col(turn))).over(Window.partitionBy(conv))
    return rows.withColumn("_from", oldest_user).where(F.col(turn) >= F.col("_from")).drop("_place", "_from")


def update_where(rows: DataFrame, condition: Column, changes: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The table after a conditional update, and the rows that it changed."""
    hit = F.coalesce(condition, F.lit(False))
    after = rows.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else c for c in rows.columns])
    changed = rows.where(hit).select(*[changes[c].alias(c) if c in changes else c for c in rows.columns])
    return after, changed


def delete_cascade(parents: DataFrame, doomed: DataFrame, key: str, children: list[tuple[DataFrame, str, bool]]) -> tuple[DataFrame, list[DataFrame]]:
    """Parents without the doomed keys, and each child table with its rows deleted (or their key set null if ``keep``)."""
    gone = doomed.select(F.col(key).alias("_gone")).distinct()
    out = []
    for child, fk, keep in children:
        if keep:
            rows = child.join(gone, child[fk] == gone["_gone"], "left")
            out.append(rows.withColumn(fk, F.when(F.col("_gone").isNull(), F.col(fk))).drop("_gone").select(*child.columns))
        else:
            out.append(child.join(gone, child[fk] == gone["_gone"], "left_anti"))
    return parents.join(gone, parents[key] == gone["_gone"], "left_anti"), out


def claimable(jobs: DataFrame, now: Column) -> Column:
    """Queued and due, or running with its lease expired."""
    return ((F.col("status") == "queued") & (F.col("run_after") <= now)) | ((F.col("status") == "running") & (F.col("locked_until") < now))


def next_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """The oldest claimable job of each type as it stands once claimed."""
    rows = jobs.where(claimable(jobs, now))
    first = rows.groupBy("type").agg(F.min_by(F.struct("job_id", "attempts"), F.struct("created_at", "job_id")).alias("j"))
    return first.select("type", "j.job_id", F.lit("running").alias("status"), (F.col("j.attempts") + 1).alias("attempts"), (now + F.make_interval(secs=F.lit(LEASE_SECONDS))).alias("locked_until"))


def retry_or_fail(jobs: DataFrame, now: Column) -> DataFrame:
    """What becomes of jobs that met a passing error: queued again after 10 s * 2^attempts, or failed when none is left."""
    left = F.col("attempts") < F.col("max_attempts")
    delay = F.lit(BACKOFF_SECONDS) * F.pow(F.lit(2), F.col("attempts")).cast("int")
    return jobs.select("job_id", F.when(left, "queued").otherwise("failed").alias("status"), F.when(left, now + F.make_interval(secs=delay)).alias("run_after"))


def heartbeat(jobs: DataFrame, held: DataFrame, now: Column) -> DataFrame:
    """jobs with the leases of those held (job_id) extended; a job that is no longer running keeps what it has, and ``alive`` tells its
    worker so (null for jobs that nobody holds)."""
    rows = jobs.join(held.select("job_id").distinct().withColumn("_held", F.lit(True)), "job_id", "left")
    alive = F.when(F.col("_held"), F.col("status") == "running")
    lease = F.when(F.coalesce(alive, F.lit(False)), now + F.make_interval(secs=F.lit(LEASE_SECONDS))).otherwise(F.col("locked_until"))
    return rows.withColumn("locked_until", lease).withColumn("alive", alive).select(*jobs.columns, "alive")


def complete(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """jobs with those in done (job_id, error_code) finished: done, or failed where there is an error; only running jobs change."""
    ended = done.groupBy("job_id").agg(F.max("error_code").alias("_error"), F.lit(True).alias("_ended"))
    rows = jobs.join(ended, "job_id", "left")
    ends = F.coalesce("_ended", F.lit(False)) & (F.col("status") == "running")
    status = F.when(ends, F.when(F.col("_error").isNull(), "done").otherwise("failed")).otherwise(F.col("status"))
    return rows.withColumn("locked_until", F.when(~ends, F.col("locked_until"))).withColumn("status", status).select(*jobs.columns)


def comparison_retryable(status: Column) -> Column:
    """A comparison may be tried again whenever it failed."""
    return F.coalesce(status == "failed", F.lit(False))


def enqueue(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (type, target_id) that no queued or running job serves."""
    return wanted.distinct().join(jobs.where("status in ('queued', 'running')").select("type", "target_id"), ["type", "target_id"], "left_anti")


def retryable(status: Column, error_code: Column) -> Column:
    return F.coalesce((status == "failed") & ~F.coalesce(error_code, F.lit("")).isin(*PERMANENT_ERRORS), F.lit(False))


def byte_label(n: Column) -> Column:
    """512 B, 3 KB, 2.5 MB; a tenth of a MB halfway between two goes to the even one."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.round(n / 1024).cast("long").cast("string"), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", F.bround(n / (1024 * 1024), 1)), F.lit(" MB")))


def elapsed_label(seconds: Column) -> Column:
    """42 s, 3 m 05 s."""
    minutes = F.floor(seconds / 60)
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" s"))).otherwise(F.concat(minutes.cast("string"), F.lit(" m "), F.lpad((seconds % 60).cast("string"), 2, "0"), F.lit(" s")))


def age_label(seconds: Column) -> Column:
    """just now, 5 min ago, 3 h ago, 2 d ago."""
    of = lambda size, name: F.concat(F.floor(seconds / size).cast("string"), F.lit(f" {name} ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, of(60, "min")).when(seconds < 86400, of(3600, "h")).otherwise(of(86400, "d"))


def new_chat(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """(request, outcome, tags) from (request, position, doc_id) and (doc_id, ready): distinct, one to five, all there
    and ready; then D1, D2, ... by position."""
    rows = requests.join(documents, "doc_id", "left").groupBy("request").agg(
        F.count("*").alias("n"),
        F.count_distinct("doc_id").alias("distinct"),
        F.count_if(F.col("ready").isNull()).alias("missing"),
        F.count_if(~F.col("ready")).alias("unready"),
        F.sort_array(F.collect_list(F.struct("position", "doc_id"))).alias("docs"),
    )
    outcome = F.when(F.col("n") > F.col("distinct"), "duplicate").when(F.col("n") > 5, "too_many").when(F.col("missing") > 0, "missing").when(F.col("unready") > 0, "not_ready").otherwise("ok")
    tags = F.transform("docs", lambda d, i: F.concat(F.lit("D"), (i + 1).cast("string"), F.lit("="), d["doc_id"].cast("string")))
    return rows.select("request", outcome.alias("outcome"), F.when(outcome == "ok", F.array_join(tags, ",")).alias("tags"))
