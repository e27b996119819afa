import corpus_pipeline
from textloom.llm import decontaminate, language_id, toxicity
from textloom.llm._common import scratch_table

from .helpers import awkward
from .test_minhash_dedup import brute


def test_stages_against_their_operators(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{small}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch_table(stage(spark, docs, small), "stage")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "language ID":
            want = {r["id"] for r in language_id.identify(before).where(f"lang_pred <> 'und' and score >= {corpus_pipeline.LEAST_CERTAINTY}").collect()}
        elif name == "toxicity":
            want = {r["id"] for r in toxicity.score(before, toxicity.train(before, labels)).where("score < 0.5").collect()}
        elif name == "near-dedup":
            want = {i for i, _, _, first in brute([(r["doc_id"], r["text"]) for r in before.collect()]) if first}
        elif name == "decontamination":
            bad = decontaminate.overlaps(before, spark.read.parquet(f"{small}/benchmark.parquet")).select("id").collect()
            want = {r["doc_id"] for r in before.collect()} - {r["id"] for r in bad}
        else:
            want = {r["doc_id"] for r in before.collect()}
        assert ids == want, name
        assert name == "mixing" or docs.columns == columns
        kept[name] = ids
    assert len(kept["decontamination"]) > 100


def test_run_is_the_stages(spark, small):
    a = sorted(map(tuple, corpus_pipeline.run(spark, small).collect()))
    assert a and a == sorted(map(tuple, corpus_pipeline.run(spark, small).collect()))


def test_awkward_rows(spark, small):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), small).collect() == [], name
    kept = sorted((r["doc_id"] or 0) for r in corpus_pipeline.STAGES[2][1](spark, docs, small).collect())
    assert kept == [0, 1, 2, 3, 4, 5, 7, 8]


def test_the_language_found_goes_on(spark, small):
    """Languages that are missing, or wrong for certain, leave the first stage as found; the next stage learns from them."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    held_out = "crc32(cast(doc_id as string)) % 4 = 2"
    lost = docs.selectExpr("doc_id", "text", f"case when {held_out} then if(doc_id % 2 = 0, null, if(lang = 'de', 'en', 'de')) else lang end as lang", "source", "n_chars")
    found = {r["id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(lost).collect()}
    had, right = ({r["doc_id"]: r["lang"] for r in rows.collect()} for rows in (lost, docs))
    out = {r["doc_id"]: r["lang"] for r in corpus_pipeline.keep_known_languages(spark, lost, small).collect()}
    assert out == {k: found[k][0] if had[k] is None or found[k][1] >= corpus_pipeline.CERTAIN else had[k] for k in out}
    wrong = [k for k in out if had[k] != right[k]]
    assert len(wrong) > 30 and sum(out[k] == right[k] for k in wrong) > 0.9 * len(wrong)
