"""Sending and saving with timers, by a clock of the test's own and over streams."""

import itertools
import random
import time

import pandas as pd
import pytest
from pyspark.sql import Row

from textloom.functions.quote_stream import joined, parse
from textloom.streaming import answers as A


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, x):
        self.held = x

    def clear(self):
        self.held = None


class Map(dict):
    containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__

    def removeKey(self, k):
        del self[k]


class Clock:
    """One key's state and timers; run(until) fires what is due in order."""

    def __init__(self, processor):
        self.now, self.timers, self.out, self.processor = 1_000_000, set(), [], processor
        self.states = []
        processor.init(self)

    def getValueState(self, name, schema):
        self.states.append(Value())
        return self.states[-1]

    def getMapState(self, name, key, value):
        self.states.append(Map())
        return self.states[-1]

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def _took(self, frames):
        self.out += [(self.now, *r) for f in frames for r in f.astype(object).where(f.notna(), None).itertuples(index=False)]

    def rows(self, columns, rows):
        self._took(self.processor.handleInputRows((7,), iter([pd.DataFrame(rows, columns=columns)]), self))

    def run(self, ms):
        end = self.now + ms
        while due := [t for t in self.timers if t <= end]:
            self.now = max(self.now, min(due))
            self.timers.discard(min(due))
            fired = type("Fired", (), {"getExpiryTimeInMs": lambda _, t=min(due): t})()
            self._took(self.processor.handleExpiredTimer((7,), self, fired))
        self.now = end

    def empty(self):
        return not self.timers and all(not s.exists() if isinstance(s, Value) else not s for s in self.states)


STATE = ["seq", "content", "last"]


def test_saves_are_apart_and_the_latest():
    rng = random.Random(2)
    clock = Clock(A.Saver(1500, 60_000))
    said = []
    for n in range(200):
        clock.run(rng.randrange(0, 700))
        said.append((clock.now, n))
        clock.rows(STATE, [(n, f"state {n}", False)])
    clock.run(10)
    clock.rows(STATE, [(200, "the end", True)])
    times = [r[0] for r in clock.out]
    assert all(b - a >= 1500 for a, b in itertools.pairwise(times[:-1])) and clock.out[0][2] == 0 and clock.out[-1][2:5] == (200, "the end", True)
    for at, _, seq, *_ in clock.out[:-1]:
        assert seq in {max((n for t, n in said if t < at), default=0), max(n for t, n in said if t <= at)}
    assert max(b - a for a, b in itertools.pairwise(times)) < 1500 + 700 and clock.empty()


def test_nothing_is_saved_twice_and_silence_ends_the_state():
    clock = Clock(A.Saver(1500, 60_000))
    clock.rows(STATE, [(1, "a", False), (0, "older", False)])
    clock.rows(STATE, [(2, "b", False)])
    clock.run(1500)
    clock.rows(STATE, [(1, "late", False)])
    clock.run(1_000_000)
    assert [r[2:4] for r in clock.out] == [(1, "a"), (2, "b")] and clock.empty()


PIECE = ["seq", "delta", "last"]


def pieces(text, n=5):
    cut = [text[i : i + n] for i in range(0, len(text), n)] or [""]
    return [(k, c, k == len(cut) - 1) for k, c in enumerate(cut)]


TEXTS = ['It says <quote doc="D2">the words</quote> here.', "[[NOT_FOUND]]\nNothing on it.", "plain", "", 'open <quote doc=3>never closed']


@pytest.mark.parametrize("text, escalate", list(itertools.product(TEXTS, (False, True))))
def test_ids_pings_and_one_done(text, escalate):
    for seed in range(5):
        rng = random.Random(seed)
        clock, todo = Clock(A.Sender(escalate, 15_000, 60_000)), pieces(text)
        rng.shuffle(todo)
        while todo:
            clock.rows(PIECE, [todo.pop() for _ in range(min(len(todo), rng.randrange(1, 4)))])
            clock.run(rng.randrange(0, 40_000))
        clock.rows(PIECE, [(0, "again", False), (99, "late", True)])
        clock.run(200_000)
        numbered = [r for r in clock.out if r[2] is not None]
        assert clock.out[0][3] == "ping" and [r[2] for r in numbered] == list(range(1, len(numbered) + 1))
        ends = [r[3] for r in numbered if r[3] in ("done", "escalated")]
        gone = escalate and text.startswith("[[NOT")
        assert ends == ["escalated" if gone else "done"] and numbered[-1][3] == ends[0]
        assert not [r for r in clock.out[clock.out.index(numbered[-1]) :] if r[3] == "ping"]
        events = [{k: v for k, v in zip(("type", "id", "tag", "text", "reason"), r[3:8], strict=True) if v is not None} for r in numbered[:-1]]
        assert joined(events) == ([{"type": "not_found"}] if gone else parse(text)) and clock.empty()


def test_pings_in_silence_then_a_stop():
    clock = Clock(A.Sender(False, 15_000, 60_000))
    clock.rows(PIECE, [(0, "begun", False), (2, "early", False)])
    clock.run(300_000)
    assert [(t - 1_000_000, kind) for t, _, _, kind, *_ in clock.out] == [(0, "ping"), (0, "text"), (15_000, "ping"), (30_000, "ping"), (45_000, "ping"), (60_000, "done")] and clock.out[-1][7] == "stopped" and clock.empty()


def test_stream_to_table_replayed_and_resumed(spark, tmp_path):
    """Pieces in several files, the second outputs, a replayed batch and readers that come back."""
    texts = {k: TEXTS[k % len(TEXTS)] for k in range(12)}
    rows = [(m, *p) for m, t in texts.items() for p in pieces(t)]
    schema = "msg_id long, seq int, delta string, last boolean"
    for n in range(3):
        spark.createDataFrame(rows[n::3], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    sink, path, batches = A.table_sink(str(tmp_path / "out")), str(tmp_path / "out"), []

    def twice(batch, batch_id):
        batch.persist()
        sink(batch, batch_id)
        sink(batch, batch_id)
        batch.unpersist()
        batches.append(batch_id)

    q = A.sent(stream, escalate=True).writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="100 milliseconds").start()
    A.drained(q, len(rows), 90)
    assert len(batches) >= 3
    got = {}
    for r in sorted((r for r in A.received(spark, path).collect() if r["id"] is not None), key=lambda r: (r["msg_id"], r["id"])):
        got.setdefault(r["msg_id"], []).append(r)
    for m, t in texts.items():
        assert [r["id"] for r in got[m]] == list(range(1, len(got[m]) + 1)) and got[m][-1]["type"] == ("escalated" if t.startswith("[[NOT") else "done")
    assert {r[0] for r in A.escalated(A.received(spark, path)).collect()} == {m for m, t in texts.items() if t.startswith("[[NOT")}
    after = spark.createDataFrame([(0, 2), (2, None), (50, 1)], "msg_id long, after_id int")
    assert {(r["msg_id"], r["id"]) for r in A.resumed(A.received(spark, path), after).collect()} == {(m, r["id"]) for m in (0, 2) for r in got[m] if r["id"] > (2 if m == 0 else 0)}


def test_saving_over_a_stream(spark, tmp_path):
    """A running query: saves of a message lie an interval apart, and its last state is there."""
    schema = "msg_id long, seq int, content string, last boolean"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = A.saved(stream, interval_ms=1500).writeStream.foreachBatch(A.table_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="100 milliseconds").start()
    try:
        for n in range(5):
            spark.createDataFrame([(m, n, f"{m}:{n}", n == 4 and m == 1) for m in (1, 2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            time.sleep(0.5)
        for _ in range(60):
            rows = A.received(spark, str(tmp_path / "out"), A.FLUSHED).collect() if list((tmp_path / "out").glob("*/_SUCCESS")) else []
            if {(r["msg_id"], r["seq"]) for r in rows} >= {(1, 4), (2, 4)}:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    for m in (1, 2):
        mine = sorted((r for r in rows if r["msg_id"] == m), key=lambda r: r["at"])
        assert mine[-1]["content"] == f"{m}:4" and all(b["at"] - a["at"] >= 1500 for a, b in itertools.pairwise([r for r in mine if not r["last"]]))


def test_escalated_messages_get_findings(spark, small):
    """Every message that ended early and whose document is there is scanned, in all of that document's windows."""
    from textloom.operators import structure as S
    from textloom.plans import stream_queries as P
    from textloom.plans.structure_queries import document_chunks, lengths

    got = {r["msg_id"]: (r["doc"], r["n_windows"] + r["n_failed"]) for r in P.escalated_findings(spark, small).collect()}
    windows = {r["doc"]: r["count"] for r in S.windows(document_chunks(spark, small), lengths(spark, small), 1500).groupBy("doc").count().collect()}
    marked = [r["msg_id"] for r in P._messages(spark, small).collect() if r["text"].startswith("[[NOT_FOUND]]")]
    assert marked and got == {m: (m // 1000, windows[m // 1000]) for m in marked if m // 1000 in windows}


def test_escalated_messages_tell_what_was_found(spark, tmp_path):
    """Places of the sentences that share two words with the message, in order and once each; a message without any has none."""
    from textloom.plans import stream_queries as P

    asked = "the late crate waits for the buyer in town, and more is said of it here."
    spark.createDataFrame([(7, 0, "user", asked), (14, 0, "user", asked), (8, 0, "user", asked)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    text = "Nothing stands here. A late crate came in. Some other words follow. Every crate waits."
    spark.createDataFrame([(7, text), (14, "Nothing of it."), (8, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = ", ".join(f"{text.index(x)}–{text.index(x) + len(x)}" for x in ("A late crate came in.", "Every crate waits."))
    got = sorted(tuple(r) for r in P.escalated_findings(spark, str(tmp_path)).select("msg_id", "doc", "n_windows", "n_failed", "n_discarded", "n_findings", "findings").collect())
    assert got == [(7000, 7, 1, 0, 0, 2, want), (14000, 14, 1, 0, 0, 0, "")]


def test_no_messages(spark, tmp_path):
    from textloom.plans import stream_queries as P

    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([], "event_id long, user_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert P.sent_answers(spark, str(tmp_path)).count() == P.saved_states(spark, str(tmp_path)).count() == 0


def test_silent_messages_of_the_parser_end(spark, tmp_path):
    from textloom.streaming import quotes as Q

    schema = "msg_id long, seq int, delta string, last boolean"
    spark.createDataFrame([(1, 0, 'it <quote doc="2">begun', False)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = Q.streamed(stream, idle_ms=500).writeStream.foreachBatch(A.table_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(100):
            time.sleep(0.3)
            rows = A.received(spark, str(tmp_path / "out"), Q.EVENTS).collect() if list((tmp_path / "out").glob("*/_SUCCESS")) else []
            if any(r["reason"] == "stopped" for r in rows):
                break
    finally:
        q.stop()
    assert [(r["type"], r["reason"]) for r in sorted(rows, key=lambda r: r["seq"])][-1] == ("quote_abandoned", "stopped")


class RowClock(Clock):
    """The same for processors of single rows."""

    def _took(self, rows):
        self.out += [(self.now, *r) for r in rows]

    def rows(self, columns, rows):
        self._took(self.processor.handleInputRows((7,), iter([Row(*columns)(*r) for r in rows]), self))


def test_single_rows_are_sent_and_saved_as_frames_are():
    rng = random.Random(26)
    for escalate in (False, True):
        text = ("[[NOT_FOUND]]\n" if rng.random() < 0.5 else "") + 'a b <quote doc="2">c d</quote> e f'
        pieces = [(k, text[i : i + 5], i + 5 >= len(text)) for k, i in enumerate(range(0, len(text), 5))]
        rng.shuffle(pieces)
        clocks = Clock(A.Sender(escalate, 15_000, 60_000)), RowClock(A.RowSender(escalate, 15_000, 60_000))
        for clock in clocks:
            for at in range(0, len(pieces), 3):
                clock.rows(["seq", "delta", "last"], pieces[at : at + 3])
                clock.run(20_000)
            clock.run(200_000)
        assert clocks[0].out == clocks[1].out and len(clocks[0].out) > 3 and all(c.empty() for c in clocks)
    clocks = Clock(A.Saver(1500, 60_000)), RowClock(A.RowSaver(1500, 60_000))
    for clock in clocks:
        for k in range(9):
            clock.rows(STATE, [(k, f"s{k}", k == 8)])
            clock.run(700)
    assert clocks[0].out == clocks[1].out and len(clocks[0].out) > 2


def test_a_message_that_comes_whole_asks_for_no_waiting_pieces():
    clock = Clock(A.Sender(False, 15_000, 60_000))
    clock.states[1] = clock.processor.waiting = None
    clock.rows(["seq", "delta", "last"], [(0, "a ", False), (1, "b", True)])
    assert [r[3] for r in clock.out] == ["ping", "text", "text", "done"]


def test_batches_grow_with_the_partitions(spark):
    from textloom.plans.stream_queries import _files_a_batch

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, files in ((1, 2), (8, 2), (200, 25), (600, 75)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert _files_a_batch(spark) == files
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_runs_of_pieces_are_sent_as_single_rows_are():
    """One row with lists gives what its pieces give one by one, in one row for each call."""
    rng = random.Random(28)
    for escalate, text in itertools.product((False, True), TEXTS):
        todo = pieces(text)
        rng.shuffle(todo)
        single, runs = RowClock(A.RowSender(escalate, 15_000, 60_000)), RowClock(A.RunSender(escalate, 15_000, 60_000))
        for at in range(0, len(todo), 4):
            single.rows(PIECE, todo[at : at + 4])
            runs.rows(PIECE, [tuple(map(list, zip(*todo[k : k + 2], strict=True))) for k in range(at, min(at + 4, len(todo)), 2)])
            for clock in (single, runs):
                clock.run(20_000)
        for clock in (single, runs):
            clock.rows(PIECE, [([99], ["late"], [True])] if clock is runs else [(99, "late", True)])
            clock.run(200_000)
        assert all(r[1] == 7 and len({len(c) for c in r[2:]}) == 1 for r in runs.out)
        assert [(r[0], 7, *e) for r in runs.out for e in zip(*r[2:], strict=True)] == [tuple(r) for r in single.out] and runs.empty()


def test_neighbouring_pieces_are_packed(spark):
    rows = [(1, 0, "a", False), (1, 1, None, True), (2**60 + 1, 0, "b", False), (2**60 + 2, 0, "c", False), (None, 3, "d", None), (None, 4, "e", True), (1, 2, "f", True)]
    docs = spark.createDataFrame(rows, "msg_id long, seq int, delta string, last boolean").coalesce(1)
    packed = A._runs(docs).collect()
    assert [len(r["seq"]) for r in packed] == [2, 1, 1, 1, 1, 1]
    assert [(r["msg_id"], *p) for r in packed for p in zip(r["seq"], r["delta"], r["last"], strict=True)] == rows
    assert A._runs(docs.limit(0)).collect() == []


class Running:
    """A query that reads a row in each 0.3 s until it has read all."""

    def __init__(self, most):
        self.began, self.most, self.stopped = time.monotonic(), most, False

    def exception(self):
        return None

    def stop(self):
        self.stopped = True

    @property
    def recentProgress(self):
        return [{"batchId": k, "numInputRows": 1} for k in range(min(self.most, int((time.monotonic() - self.began) / 0.3)))]


def test_a_long_stream_is_waited_for_while_it_goes_on():
    """The limit holds for standing still, not for all."""
    query = Running(7)
    A.drained(query, 7, seconds=1)
    assert query.stopped and time.monotonic() - query.began > 1.5
    query = Running(2)
    with pytest.raises(TimeoutError):
        A.drained(query, 7, seconds=1)
    assert query.stopped


def test_only_asked_documents_are_cut(spark, small, monkeypatch):
    from textloom.plans import stream_queries as P
    from textloom.plans import structure_queries as S

    cut, whole = [], S.chunks_of
    monkeypatch.setattr(S, "chunks_of", lambda docs: cut.append({r["doc"] for r in docs.select("doc").collect()}) or whole(docs))
    asked = {r["doc"] for r in P.escalated_findings(spark, small).collect()}
    every = {r["doc_id"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()}
    assert cut == [asked] and asked < every
