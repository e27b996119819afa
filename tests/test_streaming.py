"""The quote parser's events do not depend on how its input is cut, in Python and over a stream."""

import pytest

from textloom.functions.quote_stream import Parser, joined, parse
from textloom.streaming import quotes as Q

CASES = [
    "plain answer",
    'It says <quote doc="D2">the words</quote> here.',
    "[[NOT_FOUND]]\nNothing on it.",
    "  [[not_found]] \r\nrest",
    "[[NOT a sentinel",
    "a < b and <quotes are not tags>",
    "stray </quote> close",
    'open <quote doc=3>never closed',
    "tag <quote that never ends " + "x" * 90,
    'nested <quote doc="1">one <quote> two</quote> three</quote> end',
    '<quote>' + "y" * 1600 + "</quote> after",
    '<QUOTE DOC="d4">caps</QUOTE><quote>next</quote>',
    "ends in <quo",
    "",
]


@pytest.mark.parametrize("text", CASES)
def test_every_cut(text):
    whole = parse(text)
    for i in range(len(text) + 1):
        p = Parser()
        assert joined([*p.push(text[:i]), *p.push(text[i:]), *p.end()]) == whole
    p = Parser()
    assert joined([e for c in text for e in p.push(c)] + p.end()) == whole


def test_events():
    assert parse(CASES[1]) == [{"type": "text", "text": "It says "}, {"type": "quote_open", "id": "c1", "tag": "D2"}, {"type": "quote", "id": "c1", "tag": "D2", "text": "the words"}, {"type": "text", "text": " here."}]
    assert [e["type"] for e in parse(CASES[2])] == ["not_found", "text"]
    assert parse(CASES[7])[-1]["reason"] == "truncated" and parse(CASES[7], reason="stopped")[-1]["reason"] == "stopped"
    assert "y" not in "".join(e.get("text", "") for e in parse(CASES[10]))


def test_stream_equals_batch(spark, tmp_path):
    texts = {k: t for k, t in enumerate(CASES) if t}
    rows = [(m, i // 7, t[i : i + 7], i + 7 >= len(t)) for m, t in texts.items() for i in range(0, len(t), 7)]
    # Later pieces land in earlier files, so they have to wait.
    for n, part in enumerate((rows[1::2], rows[0::2])):
        spark.createDataFrame(part, "msg_id long, seq int, delta string, last boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema("msg_id long, seq int, delta string, last boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = Q.streamed(stream).writeStream.format("memory").queryName("quote_events_test").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in sorted(spark.table("quote_events_test").collect(), key=lambda r: (r["msg_id"], r["seq"])):
        e = {"type": r["type"], "id": r["quote_id"], "tag": r["tag"], "text": r["text"], "reason": r["reason"]}
        got.setdefault(r["msg_id"], []).append({k: v for k, v in e.items() if v is not None})
    assert {m: joined(v) for m, v in got.items()} == {m: parse(t) for m, t in texts.items()}


def test_queries_parse_every_turn_whole(spark, tmp_path):
    from textloom.plans.stream_queries import quote_events, quote_events_streamed

    turns = ["w" * 30, None, "", "x" * 100, "ab " * 200, "y" * 2000, "z" * 1541, "é漢 " * 90]
    spark.createDataFrame([(c, n, "user", t) for c in range(0, 30, 3) for n, t in enumerate(turns)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    events = {}
    for r in sorted(quote_events(spark, str(tmp_path)).collect(), key=lambda r: (r["msg_id"], r["seq"])):
        events.setdefault(r["msg_id"], []).append(r)
    streamed = {r["msg_id"]: r["events"] for r in quote_events_streamed(spark, str(tmp_path)).collect()}
    assert len(events) == len(streamed) == 10 * len(turns)
    dropped = 0
    for m, found in events.items():
        assert streamed[m] == ",".join(r["type"] for r in found if r["type"] != "text")
        said, whole = "".join(r["text"] or "" for r in found), turns[m % 1000] or ""
        if any(r["type"] == "quote_abandoned" and not r["text"] for r in found) and len(whole) > 1540:
            dropped, whole = dropped + 1, whole[:40]
        assert said == whole
    assert dropped
