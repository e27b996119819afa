"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Every rule has a boolean expression that is true where a document passes. On a sample of bounded size the planner
counts what each rule rejects and measures what it costs, then orders the rules by rejections per cost; a nested CASE
evaluates them in that order and stops at the first that fails. A document is kept if it passes all, so the order changes the
cost and never the verdict.

The sample is the first rows that an incremental ``take`` yields, so only as many partitions are read as it needs. Of a sampled row
only verdicts come to the driver. A rule's cost is the time of a job that evaluates it many times for each row, less that of the same job
with one evaluation, so what a job costs anyway drops out; repetitions are raised until they take twice that, or the rule is known to
cost less than ``LEAST_COST``. Costs without a gap of ``COST_GAP`` times between
them count as one, so that noise does not change the order.

Defined results: a null or blank text has no words and fails the base rules; repeated rows are judged one by one;
an empty table gives no rows and the rules' given order.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ASCII_SPACE, ascii_words, text_of

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rows that the planner counts rejections on, and those that it measures costs on, at most.
SAMPLE_ROWS, COST_ROWS = 500, 64
#: Repetitions of a rule for each row at first.
REPEATS = 32
#: Costs below this many seconds a row are taken for equal, and so are costs each less than so many times the next.
LEAST_COST, COST_GAP = 1e-5, 3


@dataclass(frozen=True)
class Rule:
    """name, and the expression that is true for a document that passes; it may use the base columns, words and text."""

    name: str
    passes: Column


def default_rules() -> list[Rule]:
    n = F.col("n_words")
    alpha = F.regexp_count(F.col("text"), F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]+(?![^\x20\x09-\x0D])"))
    ends = F.regexp_count(F.col("text"), F.lit(r"[.!?](?=[\x20\x09-\x0D]|$)"))
    return [
        Rule("symbols", F.col("n_symbols") * 10 <= n),
        Rule("word_length", F.col("word_chars").between(n * 2, n * 12)),
        Rule("repeated_lines", F.col("n_dup_lines") * 10 <= F.col("n_lines") * 4),
        Rule("letters", alpha * 10 <= n * 4),
        Rule("sentence_ends", ends * 10 <= n * 7),
    ]


def base_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words).

    Repeated 3-word windows: a 64-bit hash per window; hash and position share one long (the position in as many low
    bits as it needs), so one sort of longs brings equal windows together, and neighbours are compared by the full
    hash. Where two different hashes share their high bits, hashes and positions are sorted whole. Covered words follow from the
    positions found, in order.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))
    rows = rows.select("id", "text", ascii_words(text).alias("words"), F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != "").alias("lines"))
    rows = rows.select("*", F.size("words").cast("long").alias("n_words"), F.expr("if(size(words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))").alias("windows"))
    rows = rows.select("*", F.expr("size(windows) - size(array_distinct(windows))").alias("n_same"))
    # Window i as one long: its hash with the low bits replaced by i; only for texts with a repeated window.
    rows = rows.select("*", F.expr("if(n_same = 0, null, length(bin(size(windows))))").alias("bits"))
    rows = rows.select("*", F.expr("if(n_same = 0, null, sort_array(transform(windows, (h, i) -> shiftleft(shiftright(h, bits), bits) | cast(i as bigint))))").alias("packed"))
    rows = rows.select("*", F.expr("if(n_same = 0, null, transform(packed, p -> cast(p & (shiftleft(1L, bits) - 1) as int)))").alias("near"))
    mixed = "exists(sequence(1, greatest(1, size(near) - 1)), k -> k < size(near) and shiftright(packed[k], bits) = shiftright(packed[k - 1], bits) and windows[near[k]] <> windows[near[k - 1]])"
    whole = "transform(sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i))), x -> x.i)"
    rows = rows.select("*", F.expr(f"if(n_same = 0, null, if({mixed}, {whole}, near))").alias("at"))
    again = """
        if(n_same = 0, null, sort_array(filter(at, (p, k) ->
            (k > 0 and windows[at[k - 1]] = windows[p]) or (k < size(at) - 1 and windows[at[k + 1]] = windows[p]))))
    """
    rows = rows.select("*", F.expr(again).alias("found"))
    covered = "if(n_same = 0, 0L, aggregate(found, named_struct('n', 0L, 'end', 0), (a, p) -> named_struct('n', a.n + (p + 3 - greatest(p, a.end)), 'end', p + 3), a -> a.n))"
    return rows.select(
        "id",
        "text",
        "n_words",
        F.length(F.translate("text", ASCII_SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
    )


def rejections(rows: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> tuple[list[int], int]:
    """What each rule rejects of the first rows, and how many those are."""
    told = rows.select(*((~F.coalesce(rule.passes, F.lit(False))).cast("int").alias(f"r{k}") for k, rule in enumerate(rules))).take(sample_rows)
    return [sum(r[k] for r in told) for k in range(len(rules))], len(told)


def costs(rows: DataFrame, rules: list[Rule], n: int, cost_rows: int = COST_ROWS) -> list[float]:
    """Seconds that each rule takes for a row, measured on the first rows; ``LEAST_COST`` where it takes no more than that."""
    # An explode that changes nothing: base columns are worked out once for a row, not folded into what is repeated.
    rows, n = rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("r")).select("r.*"), min(n, cost_rows)

    def seconds(passes: Column, repeats: int) -> float:
        # A lambda's body is evaluated for each element, so the rule is not worked out once for all.
        work = F.aggregate(F.sequence(F.lit(1), F.lit(repeats)), F.lit(0), lambda a, _: a + F.when(passes, 1).otherwise(0))
        began = time.perf_counter()
        rows.select(work.alias("w")).take(cost_rows)
        return time.perf_counter() - began

    # What a job costs anyway; the first runs compile.
    idle = min(seconds(F.col("n_words") >= 0, 1) for _ in range(3))
    # So many repetitions of a rule at the least cost take twice that.
    enough = max(REPEATS, math.ceil(2 * idle / (LEAST_COST * n)))
    out = []
    for rule in rules:
        repeats = REPEATS
        while True:
            taken = seconds(rule.passes, repeats) - idle
            if taken >= 2 * idle:
                # The first run of a rule compiles; what counts is the second.
                taken = min(taken, seconds(rule.passes, repeats) - idle)
            if taken >= 2 * idle or repeats >= enough:
                break
            repeats = min(enough, math.ceil(repeats * max(2, 3 * idle / max(taken, idle / 16))))
        out.append(max(LEAST_COST, taken / (repeats * n)))
    return out


def planned_order(rows: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, measure: Callable[[DataFrame, list[Rule], int], list[float]] = costs) -> list[Rule]:
    """Rules by rejections per cost on a sample of at most ``sample_rows`` rows (the first that the scan yields, with
    whole texts). Only verdicts and times reach the driver; ties keep the given order."""
    rejected, n = rejections(rows, rules, sample_rows)
    if not n or not rules:
        return rules
    taken = measure(rows, rules, n)
    by_cost, level = sorted(range(len(rules)), key=lambda k: taken[k]), dict[int, float]()
    for before, k in zip([by_cost[0], *by_cost], by_cost, strict=False):
        level[k] = level[before] if before in level and taken[k] < COST_GAP * taken[before] else taken[k]
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-(rejected[k] + 0.5) / level[k], k))]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that fails, null if none does; later rules are not evaluated then."""
    failed = F.lit(None).cast("string")
    for rule in reversed(rules):
        failed = F.when(~rule.passes, F.lit(rule.name)).otherwise(failed)
    return failed


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rule, kept)."""
    rules = default_rules() if rules is None else rules
    base = F.col("n_words") < MIN_WORDS
    base = base | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    rows = base_columns(docs, id_col, text_col)
    ordered = planned_order(rows, rules, sample_rows)
    rows = rows.select("*", base.alias("base_failed"))
    failed = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered))
    rows = rows.select("*", failed.alias("failed_rule"))
    return rows.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", F.col("failed_rule").isNull().alias("kept"))
