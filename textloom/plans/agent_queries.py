"""Queries of plans under a deadline and of research in rounds. Openings of benchmark passages are questions; stubs stand in for models, by a question's length."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agent as A
from .retrieval_queries import _QUESTIONS, _questions


def planner(text: str | None) -> str | None:
    """A planner that raises, answers in prose, names too much, never comes back, or gives a plan."""
    words, kind = (text or "").split(" "), len(text or "") % 7
    if kind == 0:
        raise ConnectionError("no provider")
    if kind == 1:
        return "I would look for the main points."
    if kind == 2:
        return json.dumps({"queries": words[:1] * 7})
    if kind == 3:
        time.sleep(60)
    return "Here: " + json.dumps({"queries": [" ".join(words[:2]), " ", words[-1]], "sections": ["4.2"], "topic": words[0]}) if kind == 4 else json.dumps({"queries": [" ".join(words[:2]), " ", words[-1]], "topic": words[0]})


def planned_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.planned(_questions(spark, sf_dir), planner, seconds=3, at_once=64)
    return rows.select("question_id", F.array_join("queries", "|").alias("queries"), F.array_join("sections", "|").alias("sections"), "topic", "status")


def model(messages: list[dict], with_tools: bool) -> dict:
    """Five ways to research: two readings and an end, an answer at once, a tool that there is not, too many calls in a round, and no end."""
    results = [m for m in messages if m["role"] == "tool"]
    if not with_tools:
        return {"text": f"from {len(results)} results"}
    kind, n = len(messages[0]["content"]) % 5, sum(m["role"] == "assistant" for m in messages)
    call = lambda k, name="read": {"name": name, "arguments": json.dumps({"n": k})}
    if kind == 0:
        return {"calls": [call(1), call(2)] if n == 0 else [{"name": A.FINISH, "arguments": "{}"}]}
    if kind == 1:
        return {"text": "at once"}
    if kind == 2:
        return {"calls": [call(n, "sing")]}
    return {"calls": [call(10 * n + k) for k in range(6 if kind == 3 else 1)]}


def research_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _questions(spark, sf_dir).select(F.col("question_id").alias("run_id"), "text")
    return A.researched(runs, model, {"read": A.Tool(lambda a: {"n": a["n"]}, ("n",), ("n",))})


QUERIES = {f.__name__: f for f in (planned_queries, research_rounds)}

SQL = {
    "planned_queries": f"""WITH q AS (SELECT q, length(t) % 7 AS k, string_split(t, ' ') AS w FROM ({_QUESTIONS}))
        SELECT q AS question_id, CASE WHEN k < 4 THEN '' ELSE CASE WHEN trim(array_to_string(w[1:2], ' ')) = '' THEN '' ELSE array_to_string(w[1:2], ' ') || '|' END || w[-1] END AS queries, CASE WHEN k = 4 THEN '4.2' ELSE '' END AS sections, CASE WHEN k >= 4 THEN w[1] END AS topic,
        CASE k WHEN 0 THEN 'failed' WHEN 1 THEN 'invalid' WHEN 2 THEN 'invalid' WHEN 3 THEN 'late' ELSE 'ok' END AS status FROM q""",
    "research_rounds": f"""SELECT q AS run_id, (['finished', 'model_text', 'repeat_failures', 'repeat_failures', 'cap'])[k] AS outcome, ([2, 1, 3, 2, 8])[k] AS rounds, ([2, 0, 3, 8, 8])[k] AS n_calls,
        'from ' || ([3, 0, 3, 12, 8])[k] || ' results' AS answer, ([3, 0, 3, 12, 8])[k] AS n_results FROM (SELECT q, length(t) % 5 + 1 AS k FROM ({_QUESTIONS}))""",
}
