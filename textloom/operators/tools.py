"""Tool calls of an agent, as tables: dispatch, duplicates, envelopes, loose JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shipped

ENVELOPE_CHARS = 8000


def loose_json(text: Column) -> Column:
    """The JSON text inside fences or prose: from the first bracket to the last one of its kind; null if there is none."""
    body = F.regexp_replace(text, r"(?s)^.*?```(?:json)?\s*(.*?)```.*$", "$1")
    return F.nullif(F.regexp_extract(body, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))


def dispatched(calls: DataFrame, tools: DataFrame, cap: int) -> DataFrame:
    """(run_id, seq, outcome) of calls (run_id, seq, tool, args) against tools (tool, required): too many, unknown tool, broken
    arguments, a required one missing, a repeat of an earlier call, or run. Caps come before the call."""
    args = loose_json(F.col("args"))
    rows = calls.join(tools.withColumn("known", F.lit(True)), "tool", "left").withColumn("json", args).withColumn("parsed", F.try_parse_json("json")).withColumn("plain", F.regexp_replace(F.coalesce("json", F.lit("")), r"\s+", ""))
    repeat = F.row_number().over(Window.partitionBy("run_id", "tool", "plain").orderBy("seq")) > 1
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
    rows = rows.withColumn("repeat", repeat).withColumn("place", place)
    needs = F.col("required").isNotNull() & F.expr("get_json_object(json, concat('$.', required))").isNull()
    outcome = F.when(F.col("place") > cap, "over_cap").when(F.col("known").isNull(), "unknown_tool").when(F.col("parsed").isNull(), "bad_json").when(needs, "missing_argument").when(F.col("repeat"), "duplicate").otherwise("run")
    return rows.select("run_id", "seq", outcome.alias("outcome"))


def envelope(payload: Column, most: int = ENVELOPE_CHARS) -> Column:
    """A result as it is sent: cut to ``most`` characters with a note of how many are missing."""
    over = F.length(payload) > most
    return F.when(over, F.concat(F.substring(payload, 1, most), F.lit("… ["), (F.length(payload) - most).cast("string"), F.lit(" more characters]"))).otherwise(payload)


_TOKEN = re.compile(r"""\s*(?:([{}\[\]:,])|"((?:[^"\\]|\\.)*)"?|'((?:[^'\\]|\\.)*)'?|([^\s{}\[\]:,"']+))""", re.S)
_WORDS = {"true": True, "false": False, "null": None, "none": None, "undefined": None}


def repaired(text: str) -> object:
    """The value of JSON as models write it: single quotes, bare keys and words, Python's constants, commas too many or
    missing, and ends that are cut off are understood. ValueError where there is no value at all."""
    tokens = [m.groups() for m in _TOKEN.finditer(text) if m.group().strip()]

    def scalar(mark: str | None, double: str | None, single: str | None, word: str | None) -> object:
        if word is None:
            body = double if double is not None else re.sub(r'(?<!\\)"', r'\\"', (single or "").replace("\\'", "'"))
            try:
                return json.loads(f'"{body}"', strict=False)
            except ValueError:
                return body
        if word.lower() in _WORDS:
            return _WORDS[word.lower()]
        try:
            return json.loads(word)
        except ValueError:
            return word

    # A stack of open containers; a key waits for its value in ``keys``.
    root: list = []
    stack: list = [root]
    keys: list[object] = [None]

    def put(value: object) -> None:
        top = stack[-1]
        if isinstance(top, list):
            top.append(value)
        elif keys[-1] is None:
            keys[-1] = str(value) if not isinstance(value, str) else value
        else:
            top[keys[-1]], keys[-1] = value, None

    for mark, *rest in tokens:
        if mark in ("{", "["):
            fresh: dict | list = {} if mark == "{" else []
            put(fresh)
            stack.append(fresh)
            keys.append(None)
        elif mark in ("}", "]"):
            if len(stack) > 1:
                stack.pop()
                keys.pop()
        elif mark == ",":
            keys[-1] = None
        elif mark is None:
            put(scalar(mark, *rest))
    if not root:
        raise ValueError("no value")
    return root[0]


def arguments(raw: str | None, keys: list[str], numbers: list[str], strings: list[str]) -> tuple[str | None, list[str], str | None]:
    """(canonical JSON of a call's arguments, names left out, error): keys that the tool does not have are left out and told, texts that are
    numbers become numbers where one is asked for and the other way round, and a document's number becomes its tag."""
    source = (raw or "").strip() or "{}"
    try:
        value = json.loads(source)
    except ValueError:
        try:
            value = repaired(source)
        except ValueError:
            return None, [], "INVALID_JSON"
    if not isinstance(value, dict):
        return None, [], "INVALID_ARGUMENTS"
    out = {k: v for k, v in value.items() if k in keys}
    for k in numbers:
        if isinstance(out.get(k), str) and re.fullmatch(r"\s*[-+]?\d+(?:\.\d+)?\s*", out[k]):
            out[k] = float(out[k]) if "." in out[k] else int(out[k])
    for k in [*strings, "doc"]:
        if isinstance(out.get(k), int | float) and not isinstance(out[k], bool):
            out[k] = f"D{out[k]}" if k == "doc" else str(out[k])
    return json.dumps(out, sort_keys=True, separators=(",", ":"), ensure_ascii=False), [k for k in value if k not in keys], None


def normalized_calls(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """(run_id, seq, tool, args, ignored, error, repeat) of calls (run_id, seq, tool, args) against tools (tool, keys, numbers, strings, required, each but the first an array of names).

    args are canonical; error is UNKNOWN_TOOL, INVALID_JSON, INVALID_ARGUMENTS or null; repeat is true for a call that says the same as an earlier one
    of its run."""
    rows = calls.join(tools, "tool", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw, keys, numbers, strings, required in zip(*(batch.column(c).to_pylist() for c in ("args", "keys", "numbers", "strings", "required")), strict=True):
                if keys is None:
                    found.append((raw, [], "UNKNOWN_TOOL"))
                    continue
                args, ignored, error = arguments(raw, keys, numbers or [], strings or [])
                if error is None and any(json.loads(args).get(k) is None for k in required or []):
                    error = "INVALID_ARGUMENTS"
                found.append((args, ignored, error))
            own = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array([f[2] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("seq"), batch.column("tool"), *own], ["run_id", "seq", "tool", "args", "ignored", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in calls.schema}
    told = rows.transform(shipped).mapInArrow(run, f"run_id {kinds['run_id']}, seq {kinds['seq']}, tool string, args string, ignored array<string>, error string")
    again = F.row_number().over(Window.partitionBy("run_id", "tool", "args", "error").orderBy("seq")) > 1
    return told.withColumn("repeat", F.col("error").isNull() & again)


def affordable(calls: DataFrame, most_calls: int, most_tokens: int) -> DataFrame:
    """(run_id, seq, allowed): caps are checked before each call: so many calls, and tokens (n_tokens) of all calls so far and this one. Once one
    is refused, all later ones are."""
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    fits = (F.count("*").over(w) <= most_calls) & (F.sum("n_tokens").over(w) <= most_tokens)
    return calls.select("run_id", "seq", fits.alias("fits")).select("run_id", "seq", F.bool_and("fits").over(w).alias("allowed"))


def fitted(head: Column, items: Column, most: int = ENVELOPE_CHARS) -> Column:
    """struct(kept, truncated, json) of a result of JSON items in order of rank: as many of the first as fit with the head's members into ``most`` characters, one
    at least; if even one does not fit, a small envelope that says so. The text is valid JSON whatever is left out."""
    body = lambda kept: F.concat(F.lit("{"), head, F.lit(',"items":['), F.array_join(kept, ","), F.lit("]"))
    whole = F.concat(body(items), F.lit("}"))
    note = F.concat(F.lit(',"truncated":true,"chars_available":'), F.length(whole).cast("string"), F.lit("}"))
    room = F.lit(most) - F.length(body(F.array().cast("array<string>"))) - F.length(note)
    sums = F.aggregate(items, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("used")), lambda a, x: F.when(a["used"] + 1 + F.length(x) <= room, F.struct((a["n"] + 1).alias("n"), (a["used"] + 1 + F.length(x)).alias("used"))).otherwise(F.struct(a["n"].alias("n"), F.lit(1 << 30).alias("used"))))
    fits = F.length(whole) <= most
    kept = F.when(fits, F.size(items)).otherwise(sums["n"])
    cut = F.concat(body(F.slice(items, F.lit(1), F.greatest(sums["n"], F.lit(1)))), note)
    small = F.concat(F.lit('{"error":"RESULT_TOO_LARGE","truncated":true,"chars_available":'), F.length(whole).cast("string"), F.lit("}"))
    return F.struct(kept.alias("kept"), (~fits).alias("truncated"), F.when(fits, whole).when(sums["n"] > 0, cut).otherwise(small).alias("json"))
