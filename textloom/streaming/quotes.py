"""The quote parser over streams of pieces: batch and Structured Streaming, with the same events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.quote_stream import Parser, parse
from ..session import shipped

EVENTS = "msg_id long, seq int, type string, quote_id string, tag string, text string, reason string"
_NAMES = [c.split()[0] for c in EVENTS.split(", ")]
_STATE = "mode string, pending string, quote string, tag string, count int, next_piece int, next_event int, waiting string"


def parsed(messages: DataFrame) -> DataFrame:
    """Events of whole messages (msg_id, text), numbered in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, k, e["type"], e.get("id"), e.get("tag"), e.get("text"), e.get("reason")) for m, t in zip(batch.column("msg_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, e in enumerate(parse(t or ""))]
            types = [pa.int64(), pa.int32(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(types)], _NAMES)

    return messages.select(F.col("msg_id").cast("long").alias("msg_id"), "text").transform(shipped).mapInArrow(run, EVENTS)


def streamed(deltas: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Events of a stream of pieces (msg_id, seq, delta, last). Pieces of a message may come in any order and over several
    micro-batches: one that is early waits in the state until those before it have come. A message's state goes with its last piece, or
    with ``idle_ms``, which a stream without end needs, after so long without any piece: what is open is then abandoned as stopped."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        mode, pending, quote, tag, count, piece, event, waiting = state.get if state.exists else ("start", "", "", "", 0, 0, 0, "{}")
        parser, held = Parser.restored((mode, pending, quote, tag, count)), json.loads(waiting)
        for frame in frames:
            for seq, delta, last in zip(frame["seq"], frame["delta"], frame["last"], strict=True):
                held[str(int(seq))] = [delta, bool(last)]
        rows, done = [], state.hasTimedOut
        for e in parser.end("stopped") if done else []:
            rows.append((int(key[0]), event, e["type"], e.get("id"), e.get("tag"), e.get("text"), e.get("reason")))
            event += 1
        while not done and str(piece) in held:
            delta, done = held.pop(str(piece))
            piece += 1
            found = parser.push(delta or "") + (parser.end() if done else [])
            for e in found:
                rows.append((int(key[0]), event, e["type"], e.get("id"), e.get("tag"), e.get("text"), e.get("reason")))
                event += 1
        if done:
            state.remove()
        else:
            state.update((*parser.state(), piece, event, json.dumps(held)))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=_NAMES)

    return deltas.groupBy("msg_id").applyInPandasWithState(step, EVENTS, _STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def until_done(events: DataFrame, key: str = "msg_id", seq: str = "seq", done: str = "done") -> DataFrame:
    """What a sink sends: everything up to the first ``done`` event of a message, that included, and nothing after."""
    first = F.min(F.when(F.col("type") == done, F.col(seq))).over(Window.partitionBy(key))
    return events.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(seq) <= F.col("_first"))).drop("_first")


def citations_first(events: DataFrame) -> DataFrame:
    """(msg_id, place, ...) with a citation event before the mark that points to it: two rows for a quote, in that order."""
    kind = F.when(F.col("type") == "quote", F.array(F.lit("citation"), F.lit("mark"))).otherwise(F.array("type"))
    rows = events.select("*", F.posexplode(kind).alias("half", "out"))
    place = F.row_number().over(Window.partitionBy("msg_id").orderBy("seq", "half")) - 1
    return rows.select("msg_id", place.alias("place"), F.col("out").alias("type"), "quote_id")


def latest_state(flushes: DataFrame) -> DataFrame:
    """The last state of each message among flushes (msg_id, seq, content): later ones replace earlier ones."""
    return flushes.groupBy("msg_id").agg(F.max_by("content", "seq").alias("content"), F.max("seq").alias("seq"))
