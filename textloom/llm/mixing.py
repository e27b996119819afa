"""Mixing sources to target weights, in DataFrame operations only.

Packing: the documents of a source are laid end to end, in an order given by a hash of their ids, and cut into blocks of
``BLOCK_WORDS`` words; only a source's last block is shorter.

Drawing: every output shard has ``SLOTS_PER_SHARD`` slots (the last one what remains). Each slot draws its source with the sources'
shares of all slots as probabilities, so a shard's counts are multinomial. A source's draws then number its slots,
shard after shard; those beyond its quota are handed over to sources that drew less than theirs, at a rate that falls
with the square root of the number of slots. So shards keep their size, and totals meet the targets.

Mapping: slot i of a source takes block p(i mod n) of its n blocks, where p is a pseudorandom permutation by a key of the
source and the pass i div n. Every pass takes every block once, and slots end where the source has given its target: the last of
them is cut to the words that remain. So no document is taken more than ``max_repeat`` times. Slots and blocks meet in a join
on (source, block).

Everything depends on ids, sources and texts alone: reruns agree.

Defined results: null text has size 0 and takes 0; a null source is a source of its own, last in order; rows that
repeat one id and source count as one document with all their words; empty tables give no rows; further columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ASCII_SPACE, scratch_table, text_of

#: Default parameters.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
BLOCK_WORDS = 512
SLOTS_PER_SHARD = 8192
DOCS_PER_BUCKET = 1000
#: Rows that one window over numbers holds, about; totals of such runs go through a second one.
RUN = 4096
#: Sources whose bounds are broadcast at most: 17 rows for each, a few MB in all.
MAX_BROADCAST_SOURCES = 4096
#: Rounds of a permutation; times that a number outside its range goes on: the share of such numbers is below 1 / sqrt(n) each time.
ROUNDS, WALK = 8, 64
#: Documents of so many blocks or fewer are cut at their blanks; longer ones by a list of their words.
FEW_BLOCKS = 8
#: Draws are numbers below 2^DRAW_BITS.
DRAW_BITS = 40


def with_said(rows: DataFrame) -> DataFrame:
    """rows with ``said``: the words of text, joined by single blanks. Regular expressions run only where there are blanks in a row."""
    flat = text_of(F.col("text"))
    for c in ASCII_SPACE[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    rows = rows.withColumn("said", F.btrim(flat, F.lit(" ")))
    return rows.withColumn("said", F.when(F.contains("said", F.lit("  ")), F.regexp_replace("said", " {2,}", " ")).otherwise(F.col("said")))


def words_in(said: Column) -> Column:
    return F.when(said == "", F.lit(0)).otherwise(F.length(said) - F.length(F.replace(said, F.lit(" "), F.lit(""))) + 1).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(skey, source, source_size, weight, target) from (source, skey, size).

    Sharing by weight, cutting at the cap and sharing the excess again until none is above ends where every source
    gets min(cap, level * weight). Sources in ascending order of cap / weight are cut as long as the level that
    remains for them and those after them is above their ratio. One row per source goes through the window.
    """
    per = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "skey")
    rows = rows.withColumn("budget", F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("budget") - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))).over(Window.partitionBy())
    rows = rows.withColumn("final", level["level"])
    target = F.when(F.col("level") > F.col("ratio"), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    return rows.select("skey", "source", "source_size", "weight", target.alias("target"))


# ---- permutations and running sums


def permuted(i: Column, n: Column, key: Column, *, back: bool = False) -> Column:
    """A pseudorandom permutation of 0..n-1 for any n, chosen by key; with back, its inverse.

    A number is a place in a grid of about sqrt(n) by sqrt(n), by column and row. In turn one of the two is moved on by a hash of the other, around the grid's edge; the
    inverse moves back, from the last round to the first. The grid has fewer than sqrt(n) places too many: who lands on one goes on until it is below n.
    """
    width = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    height = F.ceil(n / width).cast("long")

    def turn(at: Column, r: Column) -> Column:
        by = lambda other, size: F.pmod(F.xxhash64(key, r, other), size)
        moved = lambda x, other, size: F.pmod(x - by(other, size) if back else x + by(other, size), size)
        column, row = at["column"], at["row"]
        return F.when(r % 2 == 0, F.struct(moved(column, row, width).alias("column"), row.alias("row"))).otherwise(F.struct(column.alias("column"), moved(row, column, height).alias("row")))

    def once(x: Column) -> Column:
        rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(rounds, F.struct((x % width).alias("column"), F.floor(x / width).alias("row")), turn, lambda at: at["row"] * width + at["column"])

    # Each number is worked out once: it stands in an array of one.
    again = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), x, lambda y, _: F.when(y < n, y).otherwise(once(y)))
    landed = F.transform(F.array(once(i)), lambda x: F.when(x < n, x).otherwise(again(x)))
    return F.get(F.transform(landed, lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a permutation left its range")).cast("long"))), F.lit(0))


def pass_key(skey: Column, turn: Column) -> Column:
    return F.xxhash64(F.lit("pass"), skey, turn)


def running(rows: DataFrame, by: list[str], at: str, value: str, name: str, *, run: int = RUN) -> DataFrame:
    """rows with ``name``: the sum of value over the rows of the same key before it, by the whole number ``at`` (one row each). Sums run within
    stretches of ``run`` numbers, then over the stretches' totals, so no task holds all rows of a key."""
    rows = rows.withColumn("_run", F.floor(F.col(at) / run))
    totals = rows.groupBy(*by, "_run").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_run", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*by, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(totals, [*by, "_run"]).withColumn(name, F.col("_start") + F.col("_within")).drop("_run", "_within", "_start")


# ---- packing


def keyed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, skey, text)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return rows.select("id", "source", F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source")).alias("skey"), "text")


def sized(rows: DataFrame) -> DataFrame:
    """(id, source, skey, size), one row for each id and source, written to the shared folder."""
    sizes = with_said(rows).select("id", "source", "skey", words_in(F.col("said")).alias("size"))
    return scratch_table(sizes.groupBy("id", "source", "skey").agg(F.sum("size").alias("size")), "mix-sizes")


def packed(rows: DataFrame, sizes: DataFrame, *, block: int = BLOCK_WORDS, docs_per_bucket: int = DOCS_PER_BUCKET) -> DataFrame:
    """(skey, block_no, words, pieces array<struct<start, id, first_word, n_words, text>>): the blocks of every source.

    A piece is a run of words of one document, joined by single blanks; start is its place in the block and first_word its
    first word's place in the document's row. A block has no more pieces than words. Documents get their places in hash buckets, so no
    task holds a whole source.
    """
    buckets = max(512, -(-sizes.count() // docs_per_bucket))
    bucket = F.pmod(F.xxhash64(F.lit("layout"), "id"), F.lit(buckets)).alias("bucket")
    starts = sizes.where("size > 0").groupBy("skey", bucket).agg(F.sum("size").alias("bucket_size"))
    starts = running(starts, ["skey"], "bucket", "bucket_size", "bucket_start").select("skey", "bucket", "bucket_start")
    placed = with_said(rows).select("id", "skey", "said", bucket, F.xxhash64(F.lit("order"), "id").alias("order_key"), F.xxhash64("text").alias("text_key")).where("said <> ''")
    placed = placed.withColumn("size", words_in(F.col("said")))
    within = Window.partitionBy("skey", "bucket").orderBy("order_key", "id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("in_bucket", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["skey", "bucket"])
    placed = placed.select("id", "skey", "said", (F.col("bucket_start") + F.col("in_bucket")).alias("start"), "size")
    few = F.floor((F.col("start") + F.col("size") - 1) / block) - F.floor(F.col("start") / block) < FEW_BLOCKS
    placed = placed.withColumn("list", F.when(~few, F.split("said", " ")))
    cut = f"""
        transform(sequence(start div {block}, (start + size - 1) div {block}), b -> named_struct(
            'block_no', b,
            'start', greatest(start - b * {block}, 0),
            'first_word', greatest(b * {block} - start, 0),
            'n_words', least(start + size, (b + 1) * {block}) - greatest(start, b * {block}),
            'text', if(list is null,
                substring_index(if((b + 1) * {block} < start + size, substring_index(said, ' ', cast((b + 1) * {block} - start as int)), said), ' ', -cast(least(start + size, (b + 1) * {block}) - greatest(start, b * {block}) as int)),
                array_join(slice(list, cast(greatest(b * {block} - start, 0) as int) + 1, cast(least(start + size, (b + 1) * {block}) - greatest(start, b * {block}) as int)), ' '))))
    """
    pieces = placed.select("id", "skey", F.explode(F.expr(cut)).alias("p")).select("skey", "p.block_no", F.struct("p.start", "id", "p.first_word", "p.n_words", "p.text").alias("piece"))
    return pieces.groupBy("skey", "block_no").agg(F.sum("piece.n_words").alias("words"), F.sort_array(F.collect_list("piece")).alias("pieces"))


# ---- drawing


def draw_plan(targets: DataFrame, *, block: int = BLOCK_WORDS) -> DataFrame:
    """(skey, n_blocks, quota, n_last) of each source that gives words: blocks, slots, and the words that the last slot takes.

    Whole passes give source_size words each. In the last, partial pass slots are counted until the words that remain are reached,
    which depends on whether the short last block is among them: its place in the pass is the inverse permutation's.
    """
    words = F.floor(F.col("target") + 0.5).cast("long")
    plan = targets.where("source_size > 0").select("skey", "source_size", words.alias("target_words"), F.ceil(F.col("source_size") / block).cast("long").alias("n_blocks"))
    plan = plan.withColumn("passes", F.floor(F.col("target_words") / F.col("source_size"))).withColumn("rest", F.col("target_words") - F.col("passes") * F.col("source_size"))
    plan = plan.withColumn("missing", F.col("n_blocks") * block - F.col("source_size"))
    plan = plan.withColumn("short_at", permuted(F.col("n_blocks") - 1, F.col("n_blocks"), pass_key(F.col("skey"), F.col("passes")), back=True))
    plan = plan.withColumn("plain", F.ceil(F.col("rest") / block)).withColumn("with_short", F.ceil((F.col("rest") + F.col("missing")) / block))
    plan = plan.withColumn("partial", F.when(F.col("short_at") < F.col("plain"), F.col("with_short")).otherwise(F.col("plain")))
    given = (F.col("partial") - 1) * block - F.when(F.col("short_at") < F.col("partial") - 1, F.col("missing")).otherwise(F.lit(0))
    plan = plan.withColumn("n_last", F.when(F.col("rest") > 0, F.col("rest") - given))
    return plan.select("skey", "n_blocks", (F.col("passes") * F.col("n_blocks") + F.col("partial")).cast("long").alias("quota"), F.col("n_last").cast("long").alias("n_last")).where("quota > 0")


def _thresholds(plan: DataFrame, total: int, cells: int) -> DataFrame:
    """(cell, lo, hi, skey): a draw belongs to the source in whose [lo, hi) it falls; cells make that an equality join. One row per
    source goes through the window."""
    upto = F.sum("quota").over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0))
    rows = plan.select("skey", "quota", upto.alias("upto"))
    # Exact bounds by decimal arithmetic: quota * 2^40 may pass a long.
    edge = lambda c: F.floor(c.cast("decimal(38,0)") * F.lit(1 << DRAW_BITS).cast("decimal(20,0)") / F.lit(total).cast("decimal(20,0)")).cast("long")
    rows = rows.select("skey", edge(F.col("upto") - F.col("quota")).alias("lo"), edge(F.col("upto")).alias("hi")).where("hi > lo")
    width = (1 << DRAW_BITS) // cells
    return rows.select("skey", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))


def draw_counts(plan: DataFrame, *, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """(shard, skey, first, n): the numbers first..first+n-1 of a source's slots go to a shard."""
    spark = plan.sparkSession
    told = plan.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("total"), F.count("*").alias("sources")).first()
    total, shards = int(told["total"]), -(-int(told["total"]) // slots_per_shard)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = 1 << (4 + int(told["sources"]).bit_length())
    slots = spark.range(0, shards, 1, max(1, min(tasks, shards))).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(slots_per_shard).cast("long"), F.lit(total) - F.col("id") * slots_per_shard) - 1)).alias("j"))
    slots = slots.withColumn("draw", F.xxhash64(F.lit("draw"), "shard", "j").bitwiseAND(F.lit((1 << DRAW_BITS) - 1)))
    slots = slots.withColumn("cell", F.floor(F.col("draw") / ((1 << DRAW_BITS) // cells)))
    # The planner would judge the slots by the few rows that they are made from, and broadcast them; the sources are few, which is checked.
    bounds = _thresholds(plan, max(total, 1), cells)
    bounds = F.broadcast(bounds) if told["sources"] <= MAX_BROADCAST_SOURCES else bounds.hint("merge")
    drawn = slots.join(bounds, "cell").where("draw >= lo and draw < hi").groupBy("skey", "shard").agg(F.count("*").alias("n"))
    drawn = running(scratch_table(drawn, "mix-drawn"), ["skey"], "shard", "n", "first")
    filled = drawn.groupBy("skey").agg(F.sum("n").alias("filled"))
    quotas = scratch_table(plan.select("skey", "quota").join(filled, "skey", "left").select("skey", "quota", F.coalesce("filled", F.lit(0)).alias("filled")), "mix-quotas")
    # Of a source's draws beyond its quota, every so-manieth is handed over, so no shard gives more than its part.
    over = lambda c: f"if(filled > quota, (({c}) * (filled - quota) + filled - 1) div filled, 0)"
    drawn = drawn.join(quotas, "skey").select("skey", "shard", F.expr(f"first - {over('first')}").alias("first"), F.expr(f"{over('first + n')} - {over('first')}").alias("given"), "n")
    drawn = scratch_table(drawn, "mix-draws")
    kept = drawn.select("shard", "skey", "first", (F.col("n") - F.col("given")).alias("n")).where("n > 0")
    # Draws handed over and slots that no draw has filled are as many; they meet number by number, one side's numbers permuted.
    lacking = quotas.where("filled < quota").withColumn("at", F.coalesce(F.sum(F.col("quota") - F.col("filled")).over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lacking = lacking.select("skey", F.explode(F.sequence(F.col("filled"), F.col("quota") - 1)).alias("first"), "at", "filled").select("skey", "first", (F.col("at") + F.col("first") - F.col("filled")).alias("number"))
    handed = F.lit(max(1, int(quotas.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col("quota") - F.col("filled"))), F.lit(0)).alias("n")).first()["n"]))).cast("long")
    surplus = drawn.groupBy("shard").agg(F.sum("given").alias("n")).where("n > 0").withColumn("one", F.lit(0))
    surplus = running(surplus, ["one"], "shard", "n", "at").select("shard", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("k"))
    surplus = surplus.select("shard", permuted(F.col("k"), handed, F.xxhash64(F.lit("handed"))).alias("number"))
    return kept.unionByName(surplus.hint("merge").join(lacking, "number").select("shard", "skey", "first", F.lit(1).cast("long").alias("n")))


def draw_slots(plan: DataFrame, *, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """(shard, skey, slot, block_no, n_last): the slots of every shard, numbered by source, with their blocks; n_last is set where a slot takes only so many words."""
    counts = draw_counts(plan, slots_per_shard=slots_per_shard).join(plan, "skey")
    # The rows are few until exploded: the number of tasks is stated, or the planner would put them into one.
    counts = counts.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "skey", "shard")
    slots = counts.select("shard", "skey", "n_blocks", "quota", "n_last", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    # Key and index are columns, so that they are not worked out again in every round.
    slots = slots.withColumns({"pass_key": pass_key(F.col("skey"), F.floor(F.col("slot") / F.col("n_blocks"))), "index": F.col("slot") % F.col("n_blocks")})
    place = permuted(F.col("index"), F.col("n_blocks"), F.col("pass_key"))
    return slots.select("shard", "skey", "slot", place.alias("block_no"), F.when(F.col("slot") == F.col("quota") - 1, F.col("n_last")).alias("n_last"))


# ---- the mix


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT, block: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD, docs_per_bucket: int = DOCS_PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """The mix, and the sizes and targets of its documents.

    First: (shard, skey, slot, block_no, pieces array<struct<id, first_word, n_words, text>>), a row for each slot with the words it holds;
    second: (id, source, skey, size, source_size, target).
    """
    rows = keyed(docs, id_col, source_col, text_col)
    sizes = sized(rows)
    targets = scratch_table(source_targets(sizes, weights, share, max_repeat), "mix-targets")
    plan = scratch_table(draw_plan(targets, block=block), "mix-plan")
    blocks = packed(rows, sizes, block=block, docs_per_bucket=docs_per_bucket)
    # Both sides grow with the input; the planner would judge the slots by the short rows they are made from and broadcast them.
    mixed = draw_slots(plan, slots_per_shard=slots_per_shard).hint("merge").join(blocks, ["skey", "block_no"])
    cut = """
        if(n_last is null or n_last >= words, pieces, transform(filter(pieces, p -> p.start < n_last), p ->
            named_struct('start', p.start, 'id', p.id, 'first_word', p.first_word, 'n_words', least(p.n_words, n_last - p.start), 'text', substring_index(p.text, ' ', cast(least(p.n_words, n_last - p.start) as int)))))
    """
    mixed = mixed.select("shard", "skey", "slot", "block_no", F.expr(cut).alias("pieces"))
    mixed = mixed.select("shard", "skey", "slot", "block_no", F.expr("transform(pieces, p -> named_struct('id', p.id, 'first_word', p.first_word, 'n_words', p.n_words, 'text', p.text))").alias("pieces"))
    return mixed, sizes.join(targets.select("skey", "source_size", "target"), "skey")


def account(mixed: DataFrame, told: DataFrame) -> DataFrame:
    """(id, source, size, source_size, target, taken): taken is counted in the words of the mix."""
    words = F.length("p.text") - F.length(F.replace(F.col("p.text"), F.lit(" "), F.lit(""))) + 1
    taken = mixed.select("skey", F.explode("pieces").alias("p")).select("skey", F.col("p.id").alias("id"), words.cast("long").alias("taken"))
    taken = taken.groupBy("id", "skey").agg(F.sum("taken").alias("taken"))
    # They meet by one sum for each document; a null id counts as an id.
    rows = told.select("id", "source", "skey", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    none = lambda c: F.lit(None).cast(told.schema[c].dataType).alias(c)
    more = taken.select("id", none("source"), "skey", none("size"), none("source_size"), none("target"), "taken")
    rows = rows.unionByName(more).groupBy("id", "skey").agg(*(F.max(c).alias(c) for c in ("source", "size", "source_size", "target")), F.sum("taken").alias("taken"))
    return rows.select("id", "source", "size", "source_size", "target", "taken")


def text_of_slot(pieces: Column) -> Column:
    """The words that a slot holds, in order."""
    return F.array_join(F.transform(pieces, lambda p: p["text"]), " ")
