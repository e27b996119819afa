"""Queries over the relational bookkeeping, on conversations, events as jobs, and the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as H
from ..sources.tables import read



def _now() -> Column:
    return F.to_timestamp(F.lit("2024-01-15 00:00:00"))


def filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    return rows.where(F.col("role").isin("user", "system")).orderBy("conv_id", "turn").limit(50)


def recent_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    customers = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select("o_orderkey", "c_name").orderBy(F.col("o_orderkey").desc()).limit(50)


def left_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents", "doc_id", "lang"), read(spark, sf_dir, "labels", "doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select("doc_id", "lang", F.col("quality").cast("long").alias("quality"))


def joined_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    a, b = nation.alias("a"), nation.alias("b")
    rows = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").withColumn("other", (F.col("s_nationkey") + F.col("s_suppkey")) % 30)
    rows = rows.join(a, F.col("s_nationkey") == F.col("a.n_nationkey"), "left").join(b, F.col("other") == F.col("b.n_nationkey"), "left")
    return rows.select("s_suppkey", F.col("a.n_name").alias("home"), F.col("b.n_name").alias("away"))


def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations", "conv_id").groupBy("conv_id").agg(F.count("*").alias("n_messages"))


def counts_with_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders", "o_custkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read(spark, sf_dir, "customer", "c_custkey").join(orders, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


def latest_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return H.latest_by(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


def deletion_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scalar counts in one pass over each table."""
    conv = read(spark, sf_dir, "conversations", "conv_id", "turn").groupBy("conv_id").agg(F.count("*").alias("n"))
    chats = conv.agg(F.count_if(F.col("n") <= 2).alias("single_chats"), F.count_if(F.col("n") > 2).alias("multi_chats"))
    nation = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").agg(F.count_if((F.col("s_nationkey") == 3) | (F.col("s_suppkey") % 10 == 3)).alias("comparisons"))
    one = F.lit(1).alias("one")
    return chats.select("*", one).join(nation.select("*", one), "one").drop("one")


def nonempty_or_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations", "conv_id", "role").groupBy("conv_id").agg(F.count_if(F.col("role") == "system").alias("n"))
    return H.first_or_counted(rows, "conv_id", "n")


def ordered_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    w = Window.partitionBy("conv_id").orderBy(F.floor(F.col("turn") / 2), F.col("role").desc(), "turn")
    return rows.select("conv_id", "turn", "role", F.row_number().over(w).cast("long").alias("place"))


def history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.history(read(spark, sf_dir, "conversations"), budget=300).select("conv_id", "turn", "role", "tokens", "used")


def title_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = read(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    old = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Chat "), F.col("conv_id").cast("string")))
    return first.select("conv_id", F.when(old.isNotNull(), old).otherwise(F.substring("text", 1, 40)).alias("title"))


def guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    return H.update_where(orders, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 50000), {"o_orderstatus": F.lit("O")})[1]


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    doomed = customers.where("c_nationkey = 5")
    left, (kept, nulled) = H.delete_cascade(customers, doomed, "c_custkey", [(orders, "o_custkey", False), (orders, "o_custkey", True)])
    count = lambda df, name, n: df.agg(n.alias("n")).select(F.lit(name).alias("what"), "n")
    return count(left, "customers", F.count("*")).unionByName(count(kept, "orders", F.count("*"))).unionByName(count(nulled, "unowned", F.count_if(F.col("o_custkey").isNull())))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return rows.select(
        F.col("event_id").alias("job_id"), F.col("event_type").alias("type"), F.col("user_id").alias("target_id"), status.alias("status"), (F.col("event_id") % 5).cast("int").alias("attempts"),
        F.lit(3).alias("max_attempts"), (F.col("ts") + F.make_interval(hours=(F.col("event_id") % 50).cast("int"))).alias("run_after"), (F.col("ts") + F.make_interval(secs=F.lit(H.LEASE_SECONDS))).alias("locked_until"), F.col("ts").alias("created_at"),
    )


_JOBS = """SELECT event_id AS job_id, event_type AS type, user_id AS target_id, (['queued', 'running', 'done', 'failed'])[event_id % 4 + 1] AS status, event_id % 5 AS attempts, 3 AS max_attempts,
    ts + to_hours(CAST(event_id % 50 AS BIGINT)) AS run_after, ts + INTERVAL 120 SECOND AS locked_until, ts AS created_at FROM events"""


def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.next_jobs(_jobs(spark, sf_dir).where("created_at >= '2024-01-10'"), _now()).select("type", "job_id", "status", F.col("attempts").cast("long").alias("attempts"), F.date_format("locked_until", "yyyy-MM-dd HH:mm:ss").alias("locked_until"))


def queue_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.retry_or_fail(_jobs(spark, sf_dir).where("status = 'failed'"), _now())
    return rows.select("job_id", "status", F.date_format("run_after", "yyyy-MM-dd HH:mm:ss").alias("run_after"))


def queue_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    return H.enqueue(jobs.where("job_id % 3 = 0"), jobs.select("type", "target_id"))


def stale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _jobs(spark, sf_dir).where("status = 'running'")
    return H.update_where(rows, F.col("created_at") < _now() - F.make_interval(mins=F.lit(3)), {"status": F.lit("interrupted")})[0].groupBy("status").agg(F.count("*").alias("n"))


def retryable_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("job_id") % 7 == 0, "encrypted").when(F.col("job_id") % 7 == 1, "timeout")
    return _jobs(spark, sf_dir).select("job_id", H.retryable(F.col("status"), code).alias("retryable"))


def new_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("doc_id"))
    documents = read(spark, sf_dir, "part", "p_partkey", "p_size").where("p_partkey % 50 <> 7").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") > 2).alias("ready"))
    return H.new_chat(requests.groupBy("request", "position").agg(F.min("doc_id").alias("doc_id")), documents)


def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events", "event_id")
    n = F.col("event_id")
    return rows.select("event_id", H.byte_label(n * 517).alias("size"), H.elapsed_label(n % 4000).alias("elapsed"), H.age_label(n * 31).alias("age"))


def selection_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "N").alias("ready"))
    return rows.select("l_orderkey", F.col("ready").between(2, 5).alias("can_ask"), (F.col("ready") == 2).alias("can_compare"))


def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified sources, one for each passage number, the first by place."""
    rows = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value").where("event_type <> 'error'").withColumn("number", F.floor(F.col("value") / 50))
    w = Window.partitionBy("user_id", "number").orderBy("event_id")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "number", "event_id")


QUERIES = {f.__name__: f for f in (
    filtered_scan, recent_joined, left_joined, joined_twice, group_counts, counts_with_zero, latest_per_target, deletion_impact, nonempty_or_first, ordered_messages, history_budget, title_once,
    guarded_update, delete_cascade, queue_claim, queue_backoff, queue_enqueue, stale_sweep, retryable_flag, new_chat, display_labels, selection_gates, source_list,
)}

SQL = {
    "filtered_scan": "SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'system') ORDER BY conv_id, turn LIMIT 50",
    "recent_joined": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey DESC LIMIT 50",
    "left_joined": "SELECT d.doc_id, d.lang, CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "joined_twice": "SELECT s.s_suppkey, a.n_name AS home, b.n_name AS away FROM supplier s LEFT JOIN nation a ON a.n_nationkey = s.s_nationkey LEFT JOIN nation b ON b.n_nationkey = (s.s_nationkey + s.s_suppkey) % 30",
    "group_counts": "SELECT conv_id, count(*) AS n_messages FROM conversations GROUP BY conv_id",
    "counts_with_zero": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "latest_per_target": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC",
    "deletion_impact": """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT (SELECT count(*) FROM c WHERE n <= 2) AS single_chats, (SELECT count(*) FROM c WHERE n > 2) AS multi_chats,
        (SELECT count(*) FROM supplier WHERE s_nationkey = 3 OR s_suppkey % 10 = 3) AS comparisons""",
    "nonempty_or_first": """WITH c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'system') AS n FROM conversations GROUP BY conv_id) SELECT conv_id, n FROM (SELECT *, row_number() OVER (ORDER BY conv_id) AS k FROM c) WHERE k = 1 OR n > 0""",
    "ordered_messages": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, role DESC, turn) AS place FROM conversations",
    "history_budget": """WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS k FROM conversations), t AS (SELECT conv_id, turn, role, k, CAST(ceil(length(trim(text, ' ')) / 4) AS BIGINT) AS tokens FROM m WHERE k <= 40 AND trim(text, ' ') <> ''),
        u AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY k) AS BIGINT) AS used FROM t), w AS (SELECT * FROM u WHERE used <= 300)
        SELECT conv_id, turn, role, tokens, used FROM (SELECT *, min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS f FROM w) WHERE turn >= f""",
    "title_once": "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Chat ' || conv_id ELSE substring(arg_min(text, turn), 1, 40) END AS title FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "guarded_update": "SELECT o_orderkey, 'O' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 50000",
    "delete_cascade": """WITH g AS (SELECT c_custkey FROM customer WHERE c_nationkey = 5) SELECT 'customers' AS what, count(*) AS n FROM customer WHERE c_nationkey <> 5 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM g)
        UNION ALL SELECT 'unowned', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM g)""",
    "queue_claim": f"""WITH j AS (SELECT * FROM ({_JOBS}) WHERE created_at >= TIMESTAMP '2024-01-10'), n AS (SELECT TIMESTAMP '2024-01-15 00:00:00' AS now)
        SELECT type, arg_min(job_id, (created_at, job_id)) AS job_id, 'running' AS status, CAST(arg_min(attempts, (created_at, job_id)) + 1 AS BIGINT) AS attempts, '2024-01-15 00:02:00' AS locked_until
        FROM j, n WHERE (status = 'queued' AND run_after <= now) OR (status = 'running' AND locked_until < now) GROUP BY type""",
    "queue_backoff": f"""SELECT job_id, CASE WHEN attempts < max_attempts THEN 'queued' ELSE 'failed' END AS status, CASE WHEN attempts < max_attempts THEN strftime(TIMESTAMP '2024-01-15 00:00:00' + to_seconds(10 * (1 << attempts)), '%Y-%m-%d %H:%M:%S') END AS run_after
        FROM ({_JOBS}) WHERE status = 'failed'""",
    "queue_enqueue": f"""WITH j AS ({_JOBS}) SELECT DISTINCT type, target_id FROM j a WHERE NOT EXISTS (SELECT 1 FROM j b WHERE b.job_id % 3 = 0 AND b.status IN ('queued', 'running') AND b.type = a.type AND b.target_id = a.target_id)""",
    "stale_sweep": f"SELECT CASE WHEN created_at < TIMESTAMP '2024-01-14 23:57:00' THEN 'interrupted' ELSE status END AS status, count(*) AS n FROM ({_JOBS}) WHERE status = 'running' GROUP BY 1",
    "retryable_flag": f"SELECT job_id, status = 'failed' AND job_id % 7 <> 0 AS retryable FROM ({_JOBS})",
    "new_chat": """WITH r AS (SELECT l_orderkey AS request, l_linenumber AS position, min(l_partkey) AS doc_id FROM lineitem GROUP BY 1, 2), d AS (SELECT p_partkey AS doc_id, p_size > 2 AS ready FROM part WHERE p_partkey % 50 <> 7),
        g AS (SELECT request, count(*) AS n, count(DISTINCT r.doc_id) AS u, count(*) FILTER (WHERE ready IS NULL) AS missing, count(*) FILTER (WHERE NOT ready) AS unready, list(r.doc_id ORDER BY position) AS docs FROM r LEFT JOIN d ON d.doc_id = r.doc_id GROUP BY request),
        o AS (SELECT *, CASE WHEN n > u THEN 'duplicate' WHEN n > 5 THEN 'too_many' WHEN missing > 0 THEN 'missing' WHEN unready > 0 THEN 'not_ready' ELSE 'ok' END AS outcome FROM g)
        SELECT request, outcome, CASE WHEN outcome = 'ok' THEN array_to_string(list_transform(docs, lambda x, i: 'D' || i || '=' || x), ',') END AS tags FROM o""",
    "display_labels": """SELECT event_id, CASE WHEN event_id * 517 < 1024 THEN (event_id * 517) || ' B' WHEN event_id * 517 < 1048576 THEN CAST(round(event_id * 517 / 1024) AS BIGINT) || ' KB' ELSE printf('%.1f', event_id * 517 / 1048576) || ' MB' END AS size,
        CASE WHEN event_id % 4000 < 60 THEN (event_id % 4000) || ' s' ELSE (event_id % 4000 // 60) || ' m ' || lpad(CAST(event_id % 4000 % 60 AS VARCHAR), 2, '0') || ' s' END AS elapsed,
        CASE WHEN event_id * 31 < 60 THEN 'just now' WHEN event_id * 31 < 3600 THEN (event_id * 31 // 60) || ' min ago' WHEN event_id * 31 < 86400 THEN (event_id * 31 // 3600) || ' h ago' ELSE (event_id * 31 // 86400) || ' d ago' END AS age FROM events""",
    "selection_gates": "WITH g AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'N') AS ready FROM lineitem GROUP BY 1) SELECT l_orderkey, ready BETWEEN 2 AND 5 AS can_ask, ready = 2 AS can_compare FROM g",
    "source_list": "SELECT user_id, CAST(floor(value / 50) AS BIGINT) AS number, min(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY 1, 2",
}
