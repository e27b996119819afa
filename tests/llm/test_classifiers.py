import random

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import language_id as L
from textloom.llm import toxicity as X
from textloom.llm.queries import op3_language_id, op9_toxicity

from .helpers import awkward, documents, prose


def test_language_accuracy_on_rows_held_out(spark, medium):
    rows = op3_language_id(spark, medium).where("held_out").join(spark.read.parquet(f"{medium}/documents.parquet"), "doc_id")
    right, n, low = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score")).first()
    assert n > 200 and right >= 0.98 and low >= 0


def test_family_then_pairs():
    grams, rng = L.Grams(), random.Random(1)
    words = {"en": "the of and with house stone", "de": "der die und mit haus stein", "fr": "le la et avec maison pierre", "es": "el los y con casa piedra"}
    rows = [(k, grams(prose(rng, 60, w))) for k, w in words.items() for _ in range(25)]
    model = L.fit(rows)
    assert model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    for k, w in words.items():
        assert model.predict(grams(prose(rng, 40, w)))[0] == k


def test_language_awkward_rows(spark):
    docs = awkward(spark)
    model = L.train(docs)
    rows = L.identify(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in {"en", "de", "fr", L.UNKNOWN}
        if r["id"] in (1, 2, 3):
            assert (r["lang_pred"], r["score"]) == (L.UNKNOWN, 0)
    assert L.identify(docs.limit(0)).collect() == []
    none = L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {L.UNKNOWN}
    assert L.known(docs, 0.0, model).columns == docs.columns


def test_pieces_change_nothing(monkeypatch):
    text = prose(random.Random(3), 5000)
    whole = L.Grams()(text)
    monkeypatch.setattr(L, "PIECE", 1000)
    assert np.abs(L.Grams()(text) - whole).max() < 0.02


def toxic_rows(rng, n, insult="scum trash"):
    return [(prose(rng, rng.randint(20, 200)) + (f" {rng.choice(insult.split())} " + prose(rng, 9) if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(n)]


def test_net_learns_words_and_pieces_agree(monkeypatch):
    rng, words = random.Random(4), X.Words()
    net = X.fit([(words(t), y, "en") for t, y in toxic_rows(rng, 300)])
    fresh = toxic_rows(rng, 120)
    assert sum((net.score(words(t)) >= 0.5) == bool(y) for t, y in fresh) >= 117
    long = words(" ".join(t for t, y in fresh if not y) + " scum " + prose(rng, 50))
    want = net.score(long)
    monkeypatch.setattr(X, "PIECE", 64)
    assert abs(net.score(long) - want) < 1e-4 and want >= 0.5


def test_toxicity_on_rows_held_out(spark):
    rng = random.Random(6)
    rows = toxic_rows(rng, 500)
    docs = documents(spark, [(i, t, "en", "a") for i, (t, _) in enumerate(rows)])
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    net = X.train(docs, labels)
    got = {r["id"]: r["score"] for r in X.score(docs, net).where(~X.is_training_row("id")).collect()}
    assert len(got) > 60 and np.mean([(s >= 0.5) == bool(rows[i][1]) for i, s in got.items()]) >= 0.97
    again = {r["id"]: r["score"] for r in X.score(docs, X.train(docs, labels)).collect()}
    assert all(abs(again[i] - s) < 1e-9 for i, s in got.items())
    odd = X.score(awkward(spark), net).collect()
    assert len(odd) == awkward(spark).count() and all(0 <= r["score"] <= 1 for r in odd)
    assert all(r["score"] < 0.5 for r in odd if r["id"] in (1, 2, 3))
    assert X.score(docs.limit(0), net).collect() == []
    assert X.train(docs, labels.limit(0)) is None and {r["score"] for r in X.score(docs.limit(3), None).collect()} == {0.0}


def test_query_columns(spark, small):
    rows = op9_toxicity(spark, small)
    assert rows.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]


def test_toxicity_of_the_table_on_rows_held_out(spark, medium):
    labels = spark.read.parquet(f"{medium}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = op9_toxicity(spark, medium).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    right = sum(r["toxic"] == r["predicted"] for r in rows)
    found = [r["predicted"] for r in rows if r["toxic"]]
    assert len(rows) >= 50 and right >= 0.9 * len(rows) and (not found or sum(found) >= 0.5 * len(found)), (len(rows), right, found)


def test_rows_without_id_are_held_out(spark):
    none = spark.createDataFrame([(None,), (1,)], "id long")
    assert [r[0] for r in none.select(L.is_training_row("id")).collect()][0] is False
    assert [r[0] for r in none.select(X.is_training_row("id")).collect()][0] is False


def test_repeated_labels_count_by_their_maximum(spark):
    rng = random.Random(8)
    rows = toxic_rows(rng, 200)
    docs = documents(spark, [(i, t, "en", "a") for i, (t, _) in enumerate(rows)])
    once = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    more = once.unionByName(once.withColumn("toxic", F.lit(0))).unionByName(once.withColumn("toxic", F.lit(None).cast("int")))
    a, b = ({r["id"]: r["score"] for r in X.score(docs, X.train(docs, x)).collect()} for x in (once, more))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)
