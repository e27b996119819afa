"""Range operators against sets of positions."""

import random

from pyspark.sql import functions as F

from textloom.operators import ranges as R


def rows(rng, n, docs=6, top=60):
    return [(rng.randrange(docs), s, s + rng.randrange(0, 9)) for s in (rng.randrange(top) for _ in range(n))]


def covered(ranges):
    out = {}
    for d, s, e in ranges:
        out.setdefault(d, set()).update(range(s, e))
    return {d: v for d, v in out.items() if v}


def frame(spark, r):
    return spark.createDataFrame(r, "doc int, start int, end int")


def test_identities(spark):
    rng = random.Random(7)
    a, b = rows(rng, 120), rows(rng, 90)
    fa, fb = frame(spark, a), frame(spark, b)
    merged = [tuple(r) for r in R.merge(fa).select("doc", "start", "end").collect()]
    assert covered(merged) == covered(a)
    assert sorted(merged) == sorted(tuple(r) for r in R.merge(frame(spark, merged)).select("doc", "start", "end").collect())
    for d in {x[0] for x in merged}:
        own = sorted(x[1:] for x in merged if x[0] == d)
        assert all(x[1] < y[0] for x, y in zip(own, own[1:], strict=False)), "touching ranges join"
    left = covered(tuple(r) for r in R.subtract(fa, fb).select("doc", "start", "end").collect())
    ca, cb = covered(a), covered(b)
    assert left == {d: v for d in ca if (v := ca[d] - cb.get(d, set()))}
    lengths = {r["doc"]: r["length"] for r in R.total_length(fa).collect()}
    assert lengths == {d: len(v) for d, v in ca.items()}


def test_overlap_across_buckets(spark):
    q = spark.createDataFrame([(1, 0, 10, 30), (2, 0, 5, 5), (3, 1, 0, 100)], "id int, doc int, start int, end int")
    r = frame(spark, [(0, 0, 12), (0, 20, 200), (0, 29, 31), (2, 0, 9)])
    got = {x["id"]: x["overlap"] for x in R.overlap_length(q, r, ["id"], width=8).collect()}
    assert got == {1: 2 + 10 + 1, 2: 0, 3: 0}


def test_blanked(spark):
    text = "abcdefghij"
    skip = "array(named_struct('start', 2, 'end', 4), named_struct('start', 4, 'end', 5), named_struct('start', 9, 'end', 30))"
    got = spark.range(1).select(F.lit(text).alias("t"), F.expr(skip).alias("s")).select(R.blanked(F.col("t"), F.col("s")).alias("b")).first()["b"]
    assert got == "ab fghi "


def test_blank_ranges_keeps_whole_texts(spark, small):
    from textloom.plans.range_queries import blank_ranges

    def blanked(text, k):
        out, at = "", 0
        for lo, n in ((2, 4), (10, 9), (40, 1)):
            lo = (k % 7 + lo) * 3
            if lo < len(text):
                out += text[at:lo]
                out, at = out if out.endswith(" ") else out + " ", lo + n
        return out + text[at:]

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").where("text is not null").collect()}
    assert any(len(t) > 400 for t in texts.values())
    assert {r["doc_id"]: r["blanked"] for r in blank_ranges(spark, small).collect()} == {k: blanked(t, k) for k, t in texts.items()}
