"""Answers sent as they are written: numbered events with pings and one last ``done``, an early stop where nothing was found, and throttled saving.

Both operators keep a message's state only while it is open and for an idle time after it; processing-time timers do what a server's clock does. They need
the RocksDB state store (``with_timers``). What they send goes to a table whose batches replace themselves when they are replayed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.quote_stream import Parser
from ..session import shipped

# Between two saves, between two pings.
FLUSH_MS, PING_MS = 1500, 15_000
#: A message that is silent for so long is over.
IDLE_MS = 600_000
SENT = "msg_id long, id int, type string, quote_id string, tag string, text string, reason string"
FLUSHED = "msg_id long, seq int, content string, last boolean, at long"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> SparkSession:
    """The session with a state store that keeps timers, if it names none of its own."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return spark


class Saver(StatefulProcessor):
    """At most one save of a message in an interval, always of its latest state; the last state is saved at once."""

    def __init__(self, interval_ms: int, idle_ms: int) -> None:
        self.interval, self.idle = interval_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "seq int, content string, waits boolean, saved_at long, due long")

    def _timer(self, kept: tuple, due: int) -> None:
        if kept[4]:
            self.handle.deleteTimer(kept[4])
        self.handle.registerTimer(due)
        self.kept.update((*kept[:4], due))

    def _read(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in rows:
            yield from zip(frame["seq"], frame["content"], frame["last"], strict=True)

    def _saved(self, key: tuple, kept: tuple, last: bool, now: int) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(int(key[0]), kept[0], kept[1], last, now)], columns=[c.split()[0] for c in FLUSHED.split(", ")])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        seq, content, waits, saved_at, due = self.kept.get() if self.kept.exists() else (-1, None, False, 0, 0)
        over = False
        for s, c, last in self._read(rows):
            over |= bool(last)
            if s >= seq:
                seq, content, waits = int(s), c, True
        kept = (seq, content, waits, saved_at, due)
        if over:
            if due:
                self.handle.deleteTimer(due)
            self.kept.clear()
            yield from self._saved(key, kept, True, now)
        elif waits and now - saved_at >= self.interval:
            self._timer((seq, content, False, now, due), now + self.idle)
            yield from self._saved(key, kept, False, now)
        else:
            self._timer(kept, saved_at + self.interval if waits else now + self.idle)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.kept.exists():
            return
        kept = self.kept.get()
        if kept[4] != expiredTimerInfo.getExpiryTimeInMs():
            return
        if kept[2]:
            self._timer((kept[0], kept[1], False, now, 0), now + self.idle)
            yield from self._saved(key, kept, False, now)
        else:
            self.kept.clear()

    def close(self) -> None:
        pass


class Sender(StatefulProcessor):
    """Events of a message's pieces as they are sent: a ping at once and in silence, numbers from 1, exactly one ``done``, nothing behind it.

    With ``escalate``, a message that begins with the mark of nothing found ends there, with ``escalated`` in place of ``done``. A message that falls silent is
    closed as stopped. What it was is forgotten an idle time after its end; until then late pieces are dropped.
    """

    def __init__(self, escalate: bool, ping_ms: int, idle_ms: int) -> None:
        self.escalate, self.ping, self.idle = escalate, ping_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "mode string, pending string, quote string, tag string, count int, piece int, id int, open boolean, ping_at long, idle_at long")
        self.waiting = handle.getMapState("waiting", "seq int", "delta string, last boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        out: list[tuple] = []
        known = self.kept.exists()
        if known:
            *state, piece, number, is_open, ping_at, idle_at = self.kept.get()
        else:
            state, piece, number, is_open, ping_at, idle_at = ["start", "", "", "", 0], 0, 1, True, 0, 0
            out.append((None, {"type": "ping"}))
        early = {int(seq): (delta or "", bool(last)) for seq, delta, last in self._read(rows)}
        parser = Parser.restored(tuple(state))
        while is_open:
            if piece in early:
                delta, last = early.pop(piece)
            elif known and self.waiting.containsKey((piece,)):
                delta, last = self.waiting.getValue((piece,))
                self.waiting.removeKey((piece,))
            else:
                break
            piece += 1
            events = [*parser.push(delta), *(parser.end() if last else [])]
            stop = next((k for k, e in enumerate(events) if e["type"] == "not_found"), None) if self.escalate else None
            events = events if stop is None else [*events[: stop + 1], {"type": "escalated"}]
            if last and stop is None:
                events.append({"type": "done", "reason": "complete"})
            is_open = not last and stop is None
            for e in events:
                out.append((number, e))
                number += 1
        if is_open:
            for seq, held in early.items():
                if seq > piece:
                    self.waiting.updateValue((seq,), held)
        elif known:
            self.waiting.clear()
        self._keep((*parser.state(), piece, number, is_open), (ping_at, idle_at), now)
        yield from self._rows(key, out)

    def _read(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in rows:
            yield from zip(frame["seq"], frame["delta"], frame["last"], strict=True)

    def _keep(self, state: tuple, timers: tuple[int, int], now: int) -> None:
        """The state with fresh timers: silence is counted from now, and pings only while the message is open."""
        for t in {t for t in timers if t}:
            self.handle.deleteTimer(t)
        fresh = (now + self.ping if state[-1] else 0, now + self.idle)
        for t in {t for t in fresh if t}:
            self.handle.registerTimer(t)
        self.kept.update((*state, *fresh))

    def _told(self, key: tuple, out: list[tuple]) -> list[tuple]:
        return [(int(key[0]), n, e["type"], e.get("id"), e.get("tag"), e.get("text"), e.get("reason")) for n, e in out]

    def _rows(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        frame = pd.DataFrame(self._told(key, out), columns=[c.split()[0] for c in SENT.split(", ")])
        yield frame.astype({"id": "Int32"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, due = timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()
        if not self.kept.exists():
            return
        *state, piece, number, is_open, ping_at, idle_at = self.kept.get()
        if due == idle_at and is_open:
            parser = Parser.restored(tuple(state))
            out = list(enumerate([*parser.end("stopped"), {"type": "done", "reason": "stopped"}], number))
            self.waiting.clear()
            self._keep((*parser.state(), piece, number + len(out), False), (ping_at, 0), now)
            yield from self._rows(key, out)
        elif due == idle_at:
            self.kept.clear()
            self.waiting.clear()
        elif due == ping_at:
            self.handle.registerTimer(now + self.ping)
            self.kept.update((*state, piece, number, is_open, now + self.ping, idle_at))
            yield from self._rows(key, [(None, {"type": "ping"})])

    def close(self) -> None:
        pass


_SENT_ROW, _FLUSHED_ROW = (Row(*(c.split()[0] for c in schema.split(", "))) for schema in (SENT, FLUSHED))


class RowSaver(Saver):
    """A saver for single rows in and out: most messages have a few, and frames of them cost more than the work."""

    def _read(self, rows: Iterator[Row]) -> Iterator[tuple]:
        return ((r["seq"], r["content"], r["last"]) for r in rows)

    def _saved(self, key: tuple, kept: tuple, last: bool, now: int) -> Iterator[Row]:
        yield _FLUSHED_ROW(int(key[0]), kept[0], kept[1], last, now)


class RowSender(Sender):
    """A sender for single rows in and out."""

    def _read(self, rows: Iterator[Row]) -> Iterator[tuple]:
        return ((r["seq"], r["delta"], r["last"]) for r in rows)

    def _rows(self, key: tuple, out: list[tuple]) -> Iterator[Row]:
        return (_SENT_ROW(*told) for told in self._told(key, out))


class RunSender(RowSender):
    """A sender for runs of pieces, as ``_runs`` packs them: a row holds lists, in and out, so what Spark does for each row is done for each run."""

    def _read(self, rows: Iterator[Row]) -> Iterator[tuple]:
        for r in rows:
            yield from zip(r["seq"], r["delta"], r["last"], strict=True)

    def _rows(self, key: tuple, out: list[tuple]) -> Iterator[Row]:
        if out:
            msg_id, *columns = zip(*self._told(key, out), strict=True)
            yield _SENT_ROW(msg_id[0], *map(list, columns))


def _runs(deltas: DataFrame) -> DataFrame:
    """Neighbouring pieces of one message in one row of lists, as far as they stand in one Arrow batch; other pieces are runs of one."""
    names = ["seq", "delta", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids = batch.num_rows, batch.column("msg_id")
            if not n:
                continue
            other = pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            starts = np.append(0, np.flatnonzero(other) + 1)
            bounds = pa.array(np.append(starts, n), pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(starts)), *(pa.ListArray.from_arrays(bounds, batch.column(c)) for c in names)], ["msg_id", *names])

    kinds = {c: deltas.schema[c].dataType.simpleString() for c in ("msg_id", *names)}
    return deltas.select("msg_id", *names).mapInArrow(run, ", ".join(f"{c} {k if c == 'msg_id' else f'array<{k}>'}" for c, k in kinds.items()))


def saved(states: DataFrame, interval_ms: int = FLUSH_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """What to save of a stream of a message's states (msg_id, seq, content, last): at most one for each interval, the latest, and the last at once.

    A state that comes after the last one is saved again with its own seq; whoever reads takes the largest seq.
    """
    with_timers(states.sparkSession)
    return states.transform(shipped).groupBy("msg_id").transformWithState(RowSaver(interval_ms, idle_ms), FLUSHED, "Append", "ProcessingTime")


def sent(deltas: DataFrame, *, escalate: bool = False, ping_ms: int = PING_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """Events (msg_id, id, type, ...) of a stream of pieces (msg_id, seq, delta, last), as ``Sender`` sends them; pings have no id."""
    with_timers(deltas.sparkSession)
    columns = [c.split() for c in SENT.split(", ")[1:]]
    lists = ", ".join(["msg_id long", *(f"{c} array<{kind}>" for c, kind in columns)])
    told = deltas.transform(shipped).transform(_runs).groupBy("msg_id").transformWithState(RunSender(escalate, ping_ms, idle_ms), lists, "Append", "ProcessingTime")
    return told.select("msg_id", F.inline(F.arrays_zip(*(c for c, _ in columns))))


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is a folder of its own, so a batch that is replayed replaces its rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def drained(query: StreamingQuery, n_rows: int, seconds: float = 600) -> None:
    """Waits until a running query has read so many rows and sent what they gave, then stops it; after so many seconds without any more rows it is an error. With
    timers there is always a next batch, so ``availableNow`` would never end."""
    seen: dict[int, int] = {}
    had, since = 0, time.monotonic()
    try:
        while had < n_rows:
            if query.exception() is not None:
                raise query.exception()
            if time.monotonic() > since + seconds:
                raise TimeoutError(f"{had} of {n_rows} rows read, none in {seconds} s")
            time.sleep(0.2)
            seen |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
            if sum(seen.values()) > had:
                had, since = sum(seen.values()), time.monotonic()
    finally:
        query.stop()


def received(spark: SparkSession, path: str, schema: str = SENT) -> DataFrame:
    """All rows that a sink has written."""
    return spark.read.schema(f"{schema}, batch_id long").parquet(path)


def resumed(rows: DataFrame, after: DataFrame) -> DataFrame:
    """What readers (msg_id, after_id) have not had yet: their messages' numbered events behind that id, all of them for a null."""
    return rows.join(after, "msg_id").where(F.col("id") > F.coalesce("after_id", F.lit(0))).drop("after_id")


def escalated(rows: DataFrame) -> DataFrame:
    """The second output: messages that ended early and go to the whole scan."""
    return rows.where(F.col("type") == "escalated").select("msg_id").distinct()
