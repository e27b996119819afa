"""Deadlines, plans and research in rounds, against a plain loop over the same scripts."""

import json
import time

import pytest

from textloom.operators import agent as A


def test_slow_raising_and_well_behaved_in_one_batch(spark):
    rows = spark.createDataFrame([(k, ["ok", "slow", "raise", None, "number"][k % 5]) for k in range(40)], "k long, text string").coalesce(1)

    def fn(x):
        if x == "slow":
            time.sleep(30)
        if x == "raise":
            raise ValueError("no")
        return 7 if x == "number" else x

    began = time.monotonic()
    got = {r["k"]: (r["value"], r["status"]) for r in A.answered(rows, "k", "text", fn, "else", seconds=1.5, at_once=40).collect()}
    assert time.monotonic() - began < 20
    assert got == {k: [("ok", "ok"), ("else", "late"), ("else", "failed"), (None, "ok"), ("else", "ok")][k % 5] for k in range(40)}


@pytest.mark.parametrize(
    "raw, plan",
    [
        ('{"queries": ["a", " ", "b"], "sections": ["4"], "topic": null}', {"queries": ["a", "b"], "sections": ["4"], "topic": None}),
        ("```json\n{'queries': ['a'],}\n```", {"queries": ["a"], "sections": [], "topic": None}),
        ('{"queries": ["1", "2", "3", "4", "5", "6"]}', {"queries": ["1", "2", "3", "4"], "sections": [], "topic": None}),
        ("{}", {"queries": [], "sections": [], "topic": None}),
        ('{"queries": ["1", "2", "3", "4", "5", "6", "7"]}', None),
        (json.dumps({"queries": ["x" * 121]}), None),
        ('{"queries": "a"}', None),
        ('{"topic": 3}', None),
        ("[1]", None),
        ("none", None),
        (None, None),
    ],
)
def test_plans(raw, plan):
    assert A.checked_plan(raw) == plan


def test_variants_and_no_rows(spark):
    asked = spark.createDataFrame([(1, "one"), (2, "two")], "question_id long, text string")
    plans = A.planned(asked, lambda t: json.dumps({"queries": [t + " a", t + " b"]}) if t == "one" else "{", seconds=5)
    assert sorted(tuple(r) for r in A.variants(asked, plans).collect()) == [(1, 0, "one"), (1, 1, "one a"), (1, 2, "one b"), (2, 0, "two")]
    assert A.planned(asked.limit(0), lambda t: "{}", seconds=1).count() == 0
    assert A.researched(asked.limit(0).withColumnRenamed("question_id", "run_id"), lambda m, t: {}, {}).count() == 0


def use(n, name="read"):
    return {"name": name, "arguments": json.dumps({"n": n})}


#: Replies of each round by the question's text; the last one stays.
SCRIPTS = {
    "same again": [{"calls": [use(1)]}, {"calls": [use(1), use(1)]}, {"calls": [{"name": A.FINISH}]}],
    "broken": [{"calls": [{"name": "read", "arguments": "{n:"}]}, {"calls": [{"name": "read", "arguments": '["a"]'}]}, {"text": "enough"}],
    "cut off": [{"text": "I was abo", "cut_off": True}, {"text": "done"}],
    "cut off twice": [{"text": "I was", "cut_off": True}],
    "late tool": [{"calls": [use(0, "sleep"), use(2)]}, {"calls": [{"name": A.FINISH, "arguments": "{}"}]}],
    "raising tool": [{"calls": [use(0, "fail")]}],
    "costly": [{"calls": [use(k, "scan") for k in range(4)]}, {"text": "so"}],
    "many tokens": [{"calls": [use(1)], "input_tokens": 10**9}],
    "broken model": ["no reply"],
    "broken later": [{"calls": [use(1)]}, "no reply"],
    "no end": [{"calls": [use(k) for k in range(1)]}],
}
WANT = {
    "same again": ("finished", 3, 3), "broken": ("model_text", 3, 2), "cut off": ("model_text", 2, 0), "cut off twice": ("model_text", 2, 0), "late tool": ("finished", 2, 2), "raising tool": ("repeat_failures", 3, 3),
    "costly": ("model_text", 2, 20), "many tokens": ("cap", 1, 1), "broken model": ("failed", 1, 0), "broken later": ("timeout", 2, 1), "no end": ("cap", 8, 8),
}


def test_rounds_follow_their_scripts(spark):
    scripts = SCRIPTS

    def model(messages, with_tools):
        if not with_tools:
            return {"text": json.dumps([m["content"] for m in messages if m["role"] == "tool"])}
        script = scripts[messages[0]["content"]]
        return script[min(sum(m["role"] == "assistant" for m in messages), len(script) - 1)]

    def sleep(args):
        time.sleep(30)

    def fail(args):
        raise RuntimeError("no")

    tools = {"read": A.Tool(lambda a: {"read": a["n"]}, ("n",), ("n",)), "sleep": A.Tool(sleep, ("n",), seconds=1.0), "fail": A.Tool(fail, ("n",)), "scan": A.Tool(lambda a: "x" * 20_000, ("n",), cost=6)}
    names = sorted(scripts)
    rows = A.researched(spark.createDataFrame(list(enumerate(names)), "run_id long, text string"), model, tools, A.Caps(calls=20)).collect()
    got = {names[r["run_id"]]: r for r in rows}
    # Three scans cost 18 of 20; the fourth is refused.
    want = WANT | {"costly": ("model_text", 2, 18)}
    assert {k: (r["outcome"], r["rounds"], r["n_calls"]) for k, r in got.items()} == want
    assert [json.loads(x) for x in json.loads(got["same again"]["answer"])] == [{"read": 1}] * 3 + [{"finished": True}]
    assert [json.loads(x) for x in json.loads(got["late tool"]["answer"])][:2] == [{"error": "TIMEOUT"}, {"read": 2}]
    assert [json.loads(x).get("error") for x in json.loads(got["costly"]["answer"])] == [None, None, None, "CALL_LIMIT"] and all(len(x) < 8000 for x in json.loads(got["costly"]["answer"]))
