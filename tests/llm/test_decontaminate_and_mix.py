import random
import re
import time
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate as B
from textloom.llm import mixing as M
from textloom.llm._common import scratch_table

from .helpers import awkward, documents, prose


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, id string")


def words(rng, n):
    return " ".join(f"w{rng.randrange(900)}" for _ in range(n))


def test_substitutions_are_tolerated_and_others_left_alone(spark):
    rng = random.Random(3)
    bench = [(k, words(rng, 30)) for k in range(20)] + [(50, "six short words are enough here"), (51, "too few words"), (52, None), (53, "")]
    docs, want = [], set()
    for d in range(120):
        text = words(rng, rng.randint(0, 200)).split()
        if d % 3 == 0:
            k = d % 20
            passage = bench[k][1].upper().split()
            for p in range(4, 30, 8):
                passage[p] = "changed,"
            at = rng.randint(0, len(text))
            text[at:at] = passage
            want.add((d, k))
        docs.append((d, " ".join(text), None, None))
    docs.append((500, "He said: six SHORT words, are enough here.", None, None))
    want.add((500, 50))
    frame = documents(spark, docs)
    rows = B.overlaps(frame, items(spark, bench)).collect()
    assert {(r["id"], r["item_id"]) for r in rows} == want
    assert all(r["best_stretch"] >= 0.8 * min(12, r["n_item_tokens"]) for r in rows)
    # The same in several blocks of the benchmark.
    assert {(r["id"], r["item_id"]) for r in B.overlaps(frame, items(spark, bench), block_bytes=900).collect()} == want
    left = B.clean(frame, items(spark, bench))
    assert left.columns == frame.columns and {r["doc_id"] for r in left.collect()} == {d[0] for d in docs} - {d for d, _ in want}


@pytest.mark.parametrize("blank", [" ", ""])
@pytest.mark.parametrize("n", range(1, 15))
def test_no_pattern_of_substitutions_is_missed(n, blank):
    """The rule, told by laying the item on every diagonal, and the seeds agree for all placements of substitutions, of words and of
    characters where no blanks are set."""
    item, (x, before, after) = ([f"w{k}" for k in range(n)], ("x", "before", "after")) if blank else ([chr(0x4E00 + k) for k in range(n)], "水前後")
    width = min(n, 12)
    seeds, most = B.Seeds([(1, blank.join(item))]), width - B.least_agreeing(width)
    for k in range(min(n, most + 2)):
        for gone in combinations(range(n), k):
            got = seeds.overlaps(blank.join([before, *(x if i in gone else w for i, w in enumerate(item)), after]))
            stretch = max(sum(i not in gone for i in range(s, s + width)) for s in range(n - width + 1))
            assert bool(got) == (100 * stretch >= 80 * width), gone


def diagonals(text, bench):
    """(item, matched, best stretch) by brute force over all diagonals."""
    words, out = B.tokens(text), {}
    for i, t in bench:
        item = B.tokens(t)
        width = min(12, len(item))
        for at in range(1 - len(item), len(words)) if item else ():
            same = [0 <= at + q < len(words) and words[at + q] == w for q, w in enumerate(item)]
            stretch = max(sum(same[s : s + width]) for s in range(len(item) - width + 1))
            if 100 * stretch >= 80 * width:
                out[i] = max(out.get(i, (0, 0)), (sum(same), stretch))
    return {(i, *x) for i, x in out.items()}


def test_like_all_diagonals_on_few_words(spark):
    """Texts of few words, where many seeds agree by chance; the way by a join of seeds gives the same rows, and so does clean."""
    rng = random.Random(11)
    few = lambda n: " ".join(rng.choices("a b c d e".split(), k=n))
    bench = [(k, few(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15]))) for k in range(25)] + [(90, "水は"), (None, few(30))]
    docs = documents(spark, [(k, few(rng.randint(0, 60)) if k % 4 else few(3) + "、水は、", None, None) for k in range(1, 60)] + [(1001, "same row", None, None)] * 2 + [(None, None, None, None)])
    rows = [B.overlaps(docs, items(spark, bench), block_bytes=n) for n in (1 << 20, 10)]
    got = [sorted(tuple(-1 if x is None else x for x in r) for r in r.collect()) for r in rows]
    assert got[0] == got[1] and len(got[0]) > 100
    told = {(r["id"], r["item_id"], r["n_matched"], r["best_stretch"]) for r in rows[0].collect()}
    assert told == {(r["doc_id"], *x) for r in docs.collect() for x in diagonals(r["text"], bench)} and any(x[1] == 90 for x in told)
    left = [sorted(r["doc_id"] or -1 for r in B.clean(docs, items(spark, bench[:6]), block_bytes=n).collect()) for n in (1 << 20, 10)]
    hit = {r["id"] for r in B.overlaps(docs, items(spark, bench[:6])).collect()}
    assert left[0] == left[1] == sorted(r["doc_id"] or -1 for r in docs.collect() if r["doc_id"] not in hit)


def test_a_phrase_of_many_items_is_cheap():
    rng = random.Random(1)
    phrase = "the quick brown fox jumps over the lazy dog today"
    seeds = B.Seeds([(k, f"{words(rng, 20)} {phrase} {words(rng, 20)}") for k in range(200)])
    text = " ".join(f"{phrase} {words(rng, 1)}" for _ in range(60))
    began = time.perf_counter()
    seeds.overlaps(text)
    assert time.perf_counter() - began < 0.5


def test_short_items_and_items_without_id(spark):
    long = "an item of seven words without id"
    bench = items(spark, [(1, "Zebra crossing"), (2, "水は百度で沸騰する"), (3, "ไทย"), (None, long), (4, "...")])
    texts = ["a zebra, crossing here", "a zebra crossings here", "答え 水は百度で沸騰すると言う", "ภาษาไทยดี", f"Here is {long}.", "nothing", ""]
    docs = documents(spark, [(k, t, None, None) for k, t in enumerate(texts)])
    got = {(r["id"], r["item_id"]): r["first_token"] for r in B.overlaps(docs, bench).collect()}
    assert got == {(0, 1): 1, (2, 2): 2, (3, 3): 4, (4, None): 2}
    assert {r["doc_id"] for r in B.clean(docs, bench).collect()} == {1, 5, 6}


def test_scripts_without_blanks(spark):
    """Characters are tokens there: blanks make no difference, a few characters may differ, other texts are left alone; both ways alike, and
    like the SQL."""
    import duckdb

    from textloom.llm.queries import ORACLE_SQL

    said = "东海渔民每年春天出海捕鱼直到秋末才回到自己的港口"
    one = said[:9] + "夏" + said[10:]
    spread = "".join("木" if k % 3 == 0 else c for k, c in enumerate(said))
    bench = [(1, said), (2, " ".join(said[:12])), (3, "ทะเลตะวันออกมีปลามากในฤดูใบไม้ผลิ"), (4, "Ferry 東京 to 大阪 by night boat")]
    texts = ["今年" + said + "。", " ".join(said), f"他说：{one}吗", spread, "ว่าทะเลตะวันออกมีปลามากในฤดูใบไม้ร่วง", "the ferry 東京to大阪 by night boat", "东海很远", None]
    docs = documents(spark, [(k, t, None, None) for k, t in enumerate(texts)])
    ways = [sorted(map(tuple, B.overlaps(docs, items(spark, bench), block_bytes=n).collect())) for n in (1 << 20, 10)]
    assert ways[0] == ways[1] and {(r[0], r[1]) for r in ways[0]} == {(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2), (4, 3), (5, 4)}
    con = duckdb.connect()
    for name, rows, key in (("documents", list(enumerate(texts)), "doc_id"), ("benchmark", bench, "item_id")):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert sorted(con.execute(ORACLE_SQL["op6_decontaminate"]).fetchall()) == ways[0]


def test_finds_every_exact_passage(spark, medium):
    from textloom.llm.queries import op6_decontaminate

    strip = lambda t: " " + " ".join(re.sub(r"[!-/:-@\[-`{-~]", " ", t.lower()).split()) + " "
    bench = [(r["item_id"], strip(r["text"])) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    exact = {(r["doc_id"], i) for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect() for i, t in bench if t in strip(r["text"] or "")}
    got = {(r["doc_id"], r["item_id"]) for r in op6_decontaminate(spark, medium).collect()}
    assert exact <= got and len(exact) >= 20


def test_decontamination_awkward_rows(spark):
    docs = awkward(spark)
    assert B.overlaps(docs, items(spark, [])).collect() == [] and B.overlaps(docs.limit(0), items(spark, [(1, "a b c d e f g")])).collect() == []
    own = docs.where("doc_id = 7").first()["text"].split()
    got = B.overlaps(docs, items(spark, [(1, " ".join(own[-40:])), (1, " ".join(own[-40:]))])).where("id = 7").collect()
    assert [(r["n_matched"], r["first_token"]) for r in got] == [(40, len(own) - 40)]
    assert B.clean(docs, items(spark, [])).count() == docs.count()


def targets_by_turns(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Sharing by weight, cutting at the cap, sharing the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, pool, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while pool > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += pool * weight[s] / total
        pool = 0.0
        for s in list(free):
            if target[s] >= most * sizes[s]:
                pool += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize(("seed", "block", "per_shard"), [(1, 64, 128), (2, 512, 8192)])
def test_mix(spark, seed, block, per_shard):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([0, 1, 7, 200, 900])), None, rng.choice(["hot"] * 6 + ["a", "b", "é", "", None])) for i in range(600)] + [(9000, None, None, "a"), (9001, "tiny", None, "lone")]
    docs = documents(spark, rows)
    mixed, told = M.mix(docs, block=block, slots_per_shard=per_shard)
    mixed = scratch_table(mixed, "mixed")
    got = M.account(mixed, told).collect()
    assert len(got) == len(rows)
    size, by_source, taken, text = {}, defaultdict(int), defaultdict(int), {}
    for i, t, _, s in rows:
        text[i] = (t or "").split()
        size[i] = len(text[i])
        by_source[s] += size[i]
    want = targets_by_turns(by_source)
    for r in got:
        assert r["size"] == size[r["id"]] and r["source_size"] == by_source[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(n - want[s]) <= 0.5001 for s, n in taken.items())
    # Slots hold the documents' own words; all but a source's last block and last slot hold a whole block.
    slots, used, sources = mixed.collect(), defaultdict(int), {r["id"]: r["source"] for r in got}
    for r in slots:
        for p in r["pieces"]:
            assert p["text"].split(" ") == text[p["id"]][p["first_word"] : p["first_word"] + p["n_words"]]
            used[p["id"]] += p["n_words"]
    assert dict(used) == {r["id"]: r["taken"] for r in got if r["taken"]}
    short = Counter(r["skey"] for r in slots if sum(p["n_words"] for p in r["pieces"]) != block)
    assert all(n <= 3 for n in short.values())
    # Shards have one size, the last what remains; slots are numbered without gaps and every block is taken once in each whole pass.
    shards = Counter(r["shard"] for r in slots)
    assert all(shards[k] == per_shard for k in range(max(shards))) and 0 < shards[max(shards)] <= per_shard
    for key in {r["skey"] for r in slots}:
        mine = sorted((r["slot"], r["block_no"]) for r in slots if r["skey"] == key)
        n = 1 + max(b for _, b in mine)
        assert [k for k, _ in mine] == list(range(len(mine)))
        assert sorted(b for k, b in mine if k < n) == list(range(n)) or len(mine) < n
    again = {r["id"]: r["taken"] for r in M.account(*M.mix(docs.repartition(5), block=block, slots_per_shard=per_shard)).collect()}
    assert again == {r["id"]: r["taken"] for r in got}
    assert {sources[p["id"]] for r in slots for p in r["pieces"]} == {s for s, n in by_source.items() if n}


def test_counts_of_shards_are_multinomial(spark):
    """Variances of the counts over shards as a multinomial has them, and totals at the quotas."""
    quotas = {"1a": 50_000, "1b": 30_000, "1c": 15_000, "1d": 5_000}
    plan = spark.createDataFrame([(k, q, q, None) for k, q in quotas.items()], "skey string, n_blocks long, quota long, n_last long")
    rows = M.draw_counts(plan, slots_per_shard=500).groupBy("skey", "shard").agg(F.sum("n").alias("n")).collect()
    assert Counter({k: sum(r["n"] for r in rows if r["skey"] == k) for k in quotas}) == quotas
    assert set(Counter({s: sum(r["n"] for r in rows if r["shard"] == s) for s in range(200)}).values()) == {500}
    for k, q in quotas.items():
        p, counts = q / 100_000, [next((r["n"] for r in rows if r["skey"] == k and r["shard"] == s), 0) for s in range(200)]
        spread = sum((c - 500 * p) ** 2 for c in counts) / 200
        assert 0.7 < spread / (500 * p * (1 - p)) < 1.4, (k, spread)


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        rows = spark.range(n).select("id", M.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(42).cast("long")).alias("p"))
        rows = rows.withColumn("back", M.permuted(F.col("p"), F.lit(n).cast("long"), F.lit(42).cast("long"), back=True)).orderBy("id").collect()
        got = [r["p"] for r in rows]
        assert sorted(got) == list(range(n)) and (n < 64 or got != sorted(got)) and all(r["back"] == r["id"] for r in rows)


def test_running_sums(spark):
    rows = spark.createDataFrame([(k, i, (7 * i) % 5) for k in "ab" for i in range(0, 90, 3 if k == "a" else 1)], "k string, i long, v long")
    got = {(r["k"], r["i"]): r["s"] for r in M.running(rows, ["k"], "i", "v", "s", run=8).collect()}
    told = [(r["k"], r["i"], r["v"]) for r in rows.collect()]
    assert got == {(k, i): sum(v for x, j, v in told if x == k and j < i) for k, i, _ in told}


def test_mix_awkward_rows(spark):
    docs = awkward(spark)
    got = M.account(*M.mix(docs)).collect()
    ids = {(r["doc_id"], r["source"]) for r in docs.collect()}
    assert {(r["id"], r["source"]) for r in got} == ids and len(got) == len(ids)
    assert M.account(*M.mix(docs.limit(0))).collect() == []
    assert all(r["taken"] == 0 for r in M.account(*M.mix(docs.where("doc_id in (1, 2)"))).collect())
    # Each row of a repeated id is laid out.
    twice = documents(spark, [(1, "a b c", None, "s"), (1, "a b c", None, "s"), (1, "d", None, "s"), (2, "e f", None, "t")])
    assert {(r["id"], r["size"]): r["taken"] for r in M.account(*M.mix(twice)).collect()}[1, 7] <= 14
