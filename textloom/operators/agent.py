"""Injected callables under a deadline, query plans, and research in rounds of tool calls.

Models and tools are callables that the caller brings; this library has none. Each call runs beside a clock: one that is late is left behind and its fallback
taken, one that raises is an error row, and neither stops its batch. A research run is a row of a state table; a round reads the open runs, asks each for its
next calls, carries them out and writes the table anew, so a lost executor costs the calls of one round at most, and what has been asked stays asked.
"""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shipped
from ..sources.scratch import scratch_table
from .tools import arguments, repaired

# What a plan may hold, the caps of a run, and the notes that a model gets.
PLAN_SECONDS, MOST_QUERIES, KEPT_QUERIES, QUERY_CHARS, MOST_SECTIONS, SECTION_CHARS = 6.0, 6, 4, 120, 10, 30
FINISH = "finish_research"


@dataclass(frozen=True)
class Caps:
    rounds: int = 8
    calls: int = 20
    calls_per_round: int = 4
    input_tokens: int = 150_000
    output_tokens: int = 12_000
    seconds: float = 90.0
    call_seconds: float = 15.0
    result_chars: int = 8000
    same_failures: int = 3


@dataclass(frozen=True)
class Tool:
    """A callable of arguments (a dict) with the names that it takes and needs, and what it costs of the cap on calls."""

    call: Callable[[dict], object]
    keys: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    cost: int = 1
    seconds: float | None = None


def within(calls: list[Callable[[], object]], seconds: list[float] | float) -> list[tuple[str, object]]:
    """(status, value) of each call, all of them side by side: ``ok`` with its value, ``late`` with None, or ``failed`` with the error's text.

    A late call goes on in a thread that nothing waits for; what it gives is dropped.
    """
    limits = seconds if isinstance(seconds, list) else [seconds] * len(calls)
    out: list[tuple[str, object]] = [("late", None)] * len(calls)
    ready = [threading.Event() for _ in calls]

    def run(k: int) -> None:
        try:
            told = ("ok", calls[k]())
        except Exception as e:  # noqa: BLE001  a callable of the caller's
            told = ("failed", f"{type(e).__name__}: {e}")
        box[k] = told
        ready[k].set()

    box: dict[int, tuple[str, object]] = {}
    began = time.monotonic()
    for k in range(len(calls)):
        threading.Thread(target=run, args=(k,), daemon=True).start()
    for k, limit in enumerate(limits):
        if ready[k].wait(max(0.0, began + limit - time.monotonic())):
            out[k] = box[k]
    return out


def answered(rows: DataFrame, key: str, column: str, fn: Callable[[str | None], str | None], fallback: str | None, seconds: float, at_once: int = 16) -> DataFrame:
    """(key, value, status) of fn on a column's values, ``at_once`` of a task side by side; late and failed calls have the fallback for a value."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                told = within([lambda x=x: fn(x) for x in part.column(column).to_pylist()], seconds)
                values = [v if s == "ok" and (v is None or isinstance(v, str)) else fallback for s, v in told]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(values, pa.string()), pa.array([s for s, _ in told], pa.string())], [key, "value", "status"])

    return rows.select(key, column).transform(shipped).mapInArrow(run, f"{key} {kind}, value string, status string")


def checked_plan(raw: str | None) -> dict[str, Any] | None:
    """A plan's queries (blank ones left out, the first four), sections and topic; None if the JSON in the text is not of that shape."""
    found = re.search(r"\{.*\}", raw or "", re.S)
    try:
        plan = repaired(found.group() if found else "")
    except ValueError:
        return None
    if not isinstance(plan, dict):
        return None
    queries, sections, topic = plan.get("queries", []), plan.get("sections", []), plan.get("topic")
    texts = lambda x, most, chars: isinstance(x, list) and len(x) <= most and all(isinstance(t, str) and len(t) <= chars for t in x)
    if not texts(queries, MOST_QUERIES, QUERY_CHARS) or not texts(sections, MOST_SECTIONS, SECTION_CHARS) or not (topic is None or isinstance(topic, str) and len(topic) <= QUERY_CHARS):
        return None
    return {"queries": [q for q in queries if q.strip()][:KEPT_QUERIES], "sections": sections, "topic": topic}


def planned(questions: DataFrame, planner: Callable[[str | None], str | None], seconds: float = PLAN_SECONDS, at_once: int = 16) -> DataFrame:
    """(question_id, queries, sections, topic, status) of questions (question_id, text): what a planner names to look for. A plan that is late, failed or
    not of the right shape (status ``invalid``) is an empty one, so the search goes on without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans = [checked_plan(v) if s == "ok" else None for s, v in zip(batch.column("status").to_pylist(), batch.column("value").to_pylist(), strict=True)]
            status = ["invalid" if s == "ok" and p is None else s for s, p in zip(batch.column("status").to_pylist(), plans, strict=True)]
            get = lambda name, none: [p[name] if p else none for p in plans]  # noqa: E731, B023
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("question_id"), pa.array(get("queries", []), lists), pa.array(get("sections", []), lists), pa.array(get("topic", None), pa.string()), pa.array(status)], ["question_id", "queries", "sections", "topic", "status"])

    kind = questions.schema["question_id"].dataType.simpleString()
    return answered(questions, "question_id", "text", planner, None, seconds, at_once).mapInArrow(run, f"question_id {kind}, queries array<string>, sections array<string>, topic string, status string")


def variants(questions: DataFrame, plans: DataFrame) -> DataFrame:
    """(question_id, variant, text): a question, variant 0, and the queries of its plan."""
    own = questions.select("question_id", F.lit(0).alias("variant"), "text")
    return own.unionByName(plans.select("question_id", F.posexplode("queries").alias("variant", "text")).withColumn("variant", F.col("variant") + 1))


@dataclass
class Run:
    """What a run has come to. Kept as JSON between rounds."""

    messages: list[dict]
    round: int = 0
    calls: int = 0
    input_tokens: int = 0
    output_tokens: int = 0
    seconds: float = 0.0
    nudged: bool = False
    failures: dict[str, int] = field(default_factory=dict)
    done: dict[str, object] = field(default_factory=dict)
    outcome: str | None = None


def _tokens(messages: list[dict]) -> int:
    return -(-sum(len(m.get("content") or "") for m in messages) // 4)


def _dispatched(run: Run, calls: list[dict], tools: dict[str, Tool], caps: Caps) -> list[tuple[str | None, object]]:
    """(error, payload) of a round's calls; caps come before each call, and a call that says the same as an earlier one has its result again."""
    out: list[tuple[str | None, object]] = [(None, None)] * len(calls)
    todo: list[tuple[int, str, Tool, dict]] = []
    waiting: dict[str, list[int]] = {}
    for k, call in enumerate(calls):
        name = call.get("name")
        if k >= caps.calls_per_round:
            out[k] = ("TOO_MANY_CALLS", None)
            continue
        tool = tools.get(name)
        if name != FINISH:
            cost = tool.cost if tool else 1
            if run.calls + cost > caps.calls:
                out[k] = ("CALL_LIMIT", None)
                continue
            run.calls += cost
        else:
            out[k] = (None, {"finished": True})
            continue
        if tool is None:
            out[k] = ("UNKNOWN_TOOL", None)
            continue
        args, _, error = arguments(call.get("arguments"), list(tool.keys), [], [])
        if error is None and any(json.loads(args).get(r) is None for r in tool.required):
            error = "INVALID_ARGUMENTS"
        if error is not None:
            out[k] = (error, None)
            continue
        same = f"{name}:{args}"
        if same in run.done:
            out[k] = (None, run.done[same])
        elif same in waiting:
            waiting[same].append(k)
        else:
            waiting[same] = [k]
            todo.append((k, same, tool, json.loads(args)))
    told = within([lambda t=t, a=a: t.call(a) for _, _, t, a in todo], [t.seconds or caps.call_seconds for _, _, t, _ in todo])
    for (_, same, _, _), (status, value) in zip(todo, told, strict=True):
        result = (None, value) if status == "ok" else ("TIMEOUT" if status == "late" else "TOOL_ERROR", None)
        if status == "ok":
            run.done[same] = value
        for k in waiting[same]:
            out[k] = result
    return out


def _step(run: Run, model: Callable[[list[dict], bool], dict], tools: dict[str, Tool], caps: Caps) -> Run:
    """One round of one run."""
    began = time.monotonic()
    if run.seconds > caps.seconds:
        run.outcome = "timeout"
        return run
    last = run.round + 1 == caps.rounds
    if last:
        run.messages.append({"role": "user", "content": f"This is the last round. {caps.calls - run.calls} calls left."})
    if run.input_tokens + _tokens(run.messages) > caps.input_tokens or run.output_tokens >= caps.output_tokens:
        run.outcome = "cap"
        return run
    run.round += 1
    (status, reply), = within([lambda: model(run.messages, True)], max(0.1, caps.seconds - run.seconds))
    if status != "ok" or not isinstance(reply, dict):
        # What earlier rounds found is kept; a run whose first round fails has nothing.
        run.outcome = "failed" if run.round == 1 else "timeout"
        return run
    text, calls = reply.get("text") or "", [c for c in reply.get("calls") or [] if isinstance(c, dict)]
    run.input_tokens += int(reply.get("input_tokens") or _tokens(run.messages))
    run.output_tokens += int(reply.get("output_tokens") or _tokens([{"content": text}]))
    run.messages.append({"role": "assistant", "content": text, "calls": calls})
    if not calls:
        if reply.get("cut_off") and not run.nudged:
            run.nudged = True
            run.messages.append({"role": "user", "content": "The reply was cut off. Go on, with shorter calls."})
        else:
            run.outcome = "model_text"
    else:
        results = _dispatched(run, calls, tools, caps)
        nudge = False
        for call, (error, payload) in zip(calls, results, strict=True):
            body = json.dumps({"error": error} if error else payload, ensure_ascii=False, default=str)
            run.messages.append({"role": "tool", "name": call.get("name"), "content": body if len(body) <= caps.result_chars else json.dumps({"truncated": True, "chars_available": len(body), "text": body[: caps.result_chars // 2]}, ensure_ascii=False)})
            if error:
                key = f"{call.get('name')}:{error}"
                run.failures[key] = run.failures.get(key, 0) + 1
                nudge |= run.failures[key] == caps.same_failures - 1
        if any(c.get("name") == FINISH and e is None for c, (e, _) in zip(calls, results, strict=True)):
            run.outcome = "finished"
        elif max(run.failures.values(), default=0) >= caps.same_failures:
            run.outcome = "repeat_failures"
        elif nudge:
            run.messages.append({"role": "user", "content": "The same call has failed before. Try another way."})
    if run.outcome is None and run.round >= caps.rounds:
        run.outcome = "cap"
    run.seconds += time.monotonic() - began
    return run


def researched(questions: DataFrame, model: Callable[[list[dict], bool], dict], tools: dict[str, Tool], caps: Caps | None = None) -> DataFrame:
    """(run_id, outcome, rounds, n_calls, answer, n_results) of questions (run_id, text).

    model(messages, with_tools) gives text, calls (name, arguments as JSON) and, if it counts them, tokens. A run ends when it finishes, answers in text, meets a cap, repeats a
    failure or is late; then the model is asked once more, without tools, for the answer. Rounds are written to the shared folder; one count for each reaches the driver.
    """
    caps = caps or Caps()
    shape = "run_id long, outcome string, state string"

    def begun(rows: DataFrame) -> DataFrame:
        first = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content"))).alias("messages")))
        return rows.select(F.col("run_id").cast("long").alias("run_id"), F.lit(None).cast("string").alias("outcome"), first.alias("state"))

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                run = _step(Run(**json.loads(batch.column("state")[k].as_py())), model, tools, caps)
                state = json.dumps(vars(run), ensure_ascii=False, default=str)
                yield pa.RecordBatch.from_arrays([batch.column("run_id").slice(k, 1), pa.array([run.outcome], pa.string()), pa.array([state], pa.string())], ["run_id", "outcome", "state"])

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                run = Run(**json.loads(batch.column("state")[k].as_py()))
                (status, reply), = within([lambda: model(run.messages, False)], caps.seconds)  # noqa: B023
                answer = reply.get("text") if status == "ok" and isinstance(reply, dict) else None
                n = sum(m["role"] == "tool" for m in run.messages)
                values = [(run.outcome, pa.string()), (run.round, pa.int32()), (run.calls, pa.int32()), (answer, pa.string()), (n, pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column("run_id").slice(k, 1), *(pa.array([v], t) for v, t in values)], ["run_id", "outcome", "rounds", "n_calls", "answer", "n_results"])

    table = scratch_table(begun(questions).transform(shipped), "research-0")
    ended = table.limit(0)
    for n in range(1, caps.rounds + 1):
        table = scratch_table(table.mapInArrow(stepped, shape), f"research-{n}")
        ended = ended.unionByName(table.where("outcome is not null"))
        table = table.where("outcome is null")
        if table.isEmpty():
            break
    return ended.mapInArrow(closed, "run_id long, outcome string, rounds int, n_calls int, answer string, n_results int")
