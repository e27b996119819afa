"""Cases that a review found: ties of rounding, words cut short, ranges that repeat, reads of one time."""

import random
import re
import time

from pyspark.sql import functions as F

from textloom.functions import matching as M
from textloom.operators import compare as G
from textloom.operators import coverage as C
from textloom.operators import ranges as R
from textloom.operators import relational as H
from textloom.operators import retrieval as T

from .test_ranges import covered, frame


def test_tenths_between_two_go_to_the_even(spark):
    sizes = {132120576 + 3407872: "129.2 MB", 786432 + 1048576: "1.8 MB", 1048576 + 262144: "1.2 MB", 1048576: "1.0 MB"}
    rows = spark.createDataFrame([(k,) for k in sizes], "n long").select("n", H.byte_label(F.col("n")).alias("size"))
    assert {r["n"]: r["size"] for r in rows.collect()} == sizes


def test_phrase_whose_last_words_go_on(spark):
    """Only a word inside a phrase stands whole in every text that holds the phrase."""
    chunks = [(1, 0, "on the it retiinof a"), (1, 1, "the it retiin"), (2, 0, "breathe it retiin"), (2, 1, "the it reti in"), (3, 0, "of ALL the ones"), (3, 1, "overall the onesies")]
    rows = spark.createDataFrame(chunks, "doc long, ord int, text string")
    phrases = spark.createDataFrame([(7, "the it retiin"), (8, "all the one"), (9, "all ones")], "question_id long, phrase string")
    got = {(r["question_id"], r["doc"], r["ord"]) for r in T.phrase_leg(rows, phrases).collect()}
    assert got == {(7, 1, 0), (7, 1, 1), (7, 2, 0), (8, 3, 0), (8, 3, 1)}


def test_reads_of_one_time(spark):
    reads = spark.createDataFrame([(1, 5, d, s, 9) for d in (3, 1, 2) for s in (4, 0)], "run_id long, seq long, doc long, start long, end long")
    got = [(r["doc"], r["start"], r["evidence_id"]) for r in C.evidence(reads.repartition(4)).orderBy("doc", "start").collect()]
    assert got == [(d, s, f"E{2 * k + n + 1}") for k, d in enumerate((1, 2, 3)) for n, s in enumerate((0, 4))]


def test_findings_beyond_the_text(spark, tmp_path):
    """As the SQL has it: they stay, once for each time, and give their length back; a null user is a document as well."""
    import duckdb

    from textloom.plans import registry

    values = [(1, 3.0), (1, 499.9), (1, 510.0), (1, 510.0), (1, 530.5), (2, 500.75), (2, 500.75), (3, 500.75), (3, 500.0), (None, 7.0), (None, 520.0), (4, None), (4, 600.0)]
    values += [(5, 2.0 * k) for k in range(1, 60)] + [(5, 505.0), (5, 560.0)]
    rows = spark.createDataFrame([(k, u, v) for k, (u, v) in enumerate(values)], "event_id long, user_id long, value double")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT doc, start, \"end\", used FROM ({registry.SQL['reduced_context']})").fetchall()
    got = [(r["doc"], r["start"], r["end"], r["used"]) for r in registry.QUERIES["reduced_context"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(e < s for _, s, e, _ in got) > 3


def test_reads_of_parts_and_of_no_time(spark, tmp_path):
    """As the SQL has it: quantities are rounded, not cut off, and a read without a seq comes last."""
    import duckdb

    from textloom.plans import registry

    lines = [(1, None, 4, 1.0), (1, 2, 5, 2.0), (1, 1, 7, 2.0), (2, 1, 3, 1.7), (2, 2, 4, 2.5), (2, 3, 5, 3.5), (2, 4, 6, 0.5), (2, 5, None, 2.0), (3, None, 8, 2.0), (3, 1, 9, None), (None, 1, 2, 1.2), (4, 1, 10005, 1.0), (4, 3, 6, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"SELECT run_id, evidence_id, doc, start, \"end\" FROM ({registry.SQL['evidence_ids']})").fetchall()
    got = [(r["run_id"], r["evidence_id"], r["doc"], r["start"], r["end"]) for r in registry.QUERIES["evidence_ids"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 7


def test_merge_of_ranges_that_repeat(spark):
    rng = random.Random(8)
    some = [(rng.randrange(3), s, s + rng.randrange(0, 30)) for s in (rng.randrange(4000) for _ in range(900))]
    merged = [tuple(r) for r in R.merge(frame(spark, [r for r in some for _ in range(20)]).repartition(7)).select("doc", "start", "end").collect()]
    assert covered(merged) == covered(some) and len(merged) == len({tuple(r) for r in R.merge(frame(spark, some)).select("doc", "start", "end").collect()})


def test_forms_of_long_texts_take_no_step_for_each_character():
    """A megabyte of text in both forms; the loop over characters took about five times this limit."""
    text = "The buyer’s ﬁrst duty … is to pay-\nment of ½ x y.\n" * 20000
    began = time.process_time()
    spaced, compact = M.spaced_form(text), M.compact_form(text)
    assert time.process_time() - began < 1
    assert spaced.text.startswith("the buyer's first duty ... is to payment of 1⁄2 x y. the") and compact.text.startswith("thebuyersfirstdutyistopaymentof12xythe")
    assert len(spaced.text) == len(spaced.starts) == len(spaced.ends) and spaced.source(12, 14) == (12, 13)


def test_both_legs_read_the_index_once(spark, small):
    from textloom.plans import registry

    plan = registry.QUERIES["two_leg_search"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("doc_id#" in line and "Relation" in line for line in plan.splitlines()) == 1


def test_places_beyond_the_first_ones_are_counted(spark, tmp_path):
    """Thirteen passages are twenty-six in the text that stands twice; with thirty the context begins behind the first twenty-five."""
    from textloom.plans import registry

    passage = "the buyer shall pay for all crates"
    spark.createDataFrame([(7, 5, (passage + " and ") * 13), (8, 5, (passage + " or ") * 30)], "doc_id long, n long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, registry.QUERIES["expected_places"](spark, str(tmp_path)).collect()))
    assert got == [("1:7", "verified", 26, 13, True), ("1:8", "verified", 60, 30, True)]


def test_numbers_are_looked_up_only_where_digits_are(spark):
    """Texts almost without digits: looking behind at every character took more than ten times as long as at digits."""
    text = F.concat(F.repeat(F.lit("no number is told in these words, "), 300), F.lit("but clause  7, 8.5 and 1,200 are; article 12 3 days"))
    rows = spark.range(300).select(F.concat(text, F.col("id").cast("string")).alias("t"))
    found = rows.select(F.array_join(F.regexp_extract_all("t", F.lit(G.PLAIN_NUMBER), 1), " ").alias("n"))
    found.where("n = ''").count()
    began = time.time()
    got = {r["n"] for r in found.distinct().collect()}
    assert time.time() - began < 3
    assert got == {"8.5 1,200 3"}


def test_clauses_of_one_small_file_are_dealt_to_many_tasks(spark, small):
    """A file of a few MB is one task otherwise, however long its rows take."""
    from textloom.plans import registry

    for name in ("changed_facts", "change_severity", "change_summaries"):
        rows = registry.QUERIES[name](spark, small)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [o_orderkey" in plan and f", {spark.conf.get('spark.sql.shuffle.partitions')}" in plan


def test_legs_count_chunks_where_their_documents_are(spark, small):
    """One shuffle by document for postings and hits, into all partitions: a task holds its share of the rows however well they are compressed."""
    from textloom.plans import registry

    for name in ("keyword_search", "precise_search"):
        plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
        assert any(re.match(r"doc#\w+, \d+$", d) for d in dealt) and not any("doc#" in d and "ord#" in d for d in dealt), (name, dealt)


def test_numbers_of_a_key_are_dealt_once(spark, small):
    from textloom.plans import registry

    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", registry.QUERIES["failed_pages"](spark, small)._jdf.queryExecution().executedPlan().toString())
    assert dealt and all(re.match(r"doc#\w+, \d+$", d) for d in dealt), dealt


def test_positions_are_added_up_without_a_row_for_each(spark, small):
    from textloom.plans import registry

    rows = registry.QUERIES["positional_postings"](spark, small)
    assert "explode(positions" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [f.dataType.simpleString() for f in rows.schema] == ["bigint"] * 5


def test_changes_shown_search_their_texts_once(spark):
    """A filter on the severity has no fact searches of its own, and tells the same changes."""
    units = [(d, k, None, f"unit {k}", t, t.lower(), t.lower().replace(" ", "")) for d, ts in ((1, ("pay USD 5 in time", "it stays as it is")), (2, ("pay USD 90 in time", "it stays as it is"))) for k, t in enumerate(ts)]
    units = spark.createDataFrame(units, "doc long, idx int, number string, title string, text string, spaced string, compact string")
    shown = G.visible(G.drafted(units, spark.createDataFrame([(1, 2)], "a long, b long")))
    assert [(r["type"], r["severity"], r["title"], r["shown_at"]) for r in shown.collect()] == [("modified", "critical", "unit 0", 1)]
    lines = shown._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("regexp_extract_all" in line for line in lines) == 1


def test_titles_and_shares_as_worked_out_in_full():
    rng = random.Random(12)
    titles = ["".join(rng.choices("abcd ", k=rng.randrange(0, 12))) for _ in range(60)] + ["payment of fees", "payment of fee", "fees of payment"]
    for a in titles:
        for b in titles:
            assert G.same_title(a, b) == (bool(a and b) and 1 - G.edit_distance(a, b) / max(len(a), len(b)) >= G.SAME_TITLE)
    sets = [set(rng.choices("abcdefgh", k=rng.randrange(0, 6))) for _ in range(40)]
    got = G._shares(sets[:25], sets[25:])
    assert all(got[i, j] == G._jaccard(a, b) for i, a in enumerate(sets[:25]) for j, b in enumerate(sets[25:]))


def test_no_window_over_sections_holds_whole_texts(spark):
    """Texts join when the sections' ends are known: no window is right over the join."""
    sections = spark.createDataFrame([(d, k, str(k), f"t{k}", 30 * k, 30 * k + 30) for d in (1, 2) for k in range(3)], "doc long, ord int, number string, title string, start int, end int")
    texts = spark.createDataFrame([(1, "a b c d e f. " * 8), (2, "g h i j k l. " * 9)], "doc long, text string")
    units = G.section_units(sections, texts)
    assert [(r["doc"], r["idx"], r["start"], r["end"]) for r in units.orderBy("doc", "idx").collect()] == [(d, k, 30 * k, 30 * k + 30 if k < 2 else n) for d, n in ((1, 104), (2, 117)) for k in range(3)]
    lines = [x.lstrip(" :+-") for x in units._jdf.queryExecution().optimizedPlan().toString().split("\n")]
    below = lines[max(k for k, x in enumerate(lines) if x.startswith("Join")) + 1 :]
    assert any(x.startswith("Window") and "lead" in x for x in below)
