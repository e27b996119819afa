"""Chat formatting by prefix-target expansion, in DataFrame operations only.

A conversation is rendered once, turn after turn; every assistant turn becomes an example whose context is all that
stands before it and whose loss mask covers that reply alone. An example is a prefix of the rendered conversation, so
it is kept as offsets into it (context_end, loss_start, loss_end): written out, the prefixes of one conversation of n
turns would take n times its length. ``example_text`` cuts one out.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Control strings inside roles and texts are escaped: a backslash is
doubled, a control string becomes a backslash and its letter, in a role a line feed becomes ``\\n``. ``unescaped``
undoes it exactly: pairs of backslashes are split off first, so every remaining backslash starts an escape.

A conversation ends up in one row, as its digest needs all of it in one place.

Defined results: null texts and roles are empty; a null conv_id is a conversation of its own; turns of equal number
are ordered by role, then text; repeated rows are turns like others; a conversation without an assistant turn has no
example and an empty loss; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings and the letters that stand for them after a backslash. Fixed values.
CONTROL = (("<|im_start|>", "a"), ("<|im_end|>", "b"), ("<|endoftext|>", "c"), ("</s>", "d"), ("<s>", "e"), ("[INST]", "f"), ("[/INST]", "g"), ("<<SYS>>", "h"), ("<</SYS>>", "i"))
TRAINED_ROLE = "assistant"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for string, letter in (*CONTROL, *((("\n", "n"),) if role else ())):
        out = F.replace(out, F.lit(string), F.lit(f"\\{letter}"))
    return out


def unescaped(text: Column, role: bool = False) -> Column:
    def plain(piece: Column) -> Column:
        for string, letter in (*CONTROL, *((("\n", "n"),) if role else ())):
            piece = F.replace(piece, F.lit(f"\\{letter}"), F.lit(string))
        return piece

    whole = F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")
    return F.when(F.contains(text, F.lit("\\")), whole).otherwise(text)


def render(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, examples array<struct<target, context_end, loss_start, loss_end>>); offsets in code points."""
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    head, body = F.concat(F.lit(OPEN), escaped(F.col("role"), role=True), F.lit("\n")), escaped(F.col("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    # Each turn's place is a running sum; a turn is never empty, so places tell the order from here on.
    size = F.length("head") + F.length("body") + len(CLOSE)
    rows = rows.select("conv_id", (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size).cast("int").alias("at"), (F.row_number().over(order) - 1).alias("k"), (F.col("role") == TRAINED_ROLE).alias("trained"), F.length("head").alias("n_head"), F.concat("head", "body", F.lit(CLOSE)).alias("said"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "k", "trained", "n_head", "said"))).alias("turns"))
    spans = f"""
        transform(filter(turns, t -> t.trained), t -> named_struct(
            'target', t.k, 'context_end', t.at, 'loss_start', t.at + t.n_head, 'loss_end', t.at + length(t.said) - {len(CLOSE)}))
    """
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"), F.expr(spans).alias("examples"))


def expand(rendered: DataFrame, *keep: str, outer: bool = False) -> DataFrame:
    """One row for each example: (conv_id, target, context_end, loss_start, loss_end, n_chars) and the columns of keep. Its text is
    the first loss_end code points of the rendered conversation and the closing mark; only loss_start to loss_end is trained.
    With outer, a conversation without an example has a row of nulls."""
    rows = rendered.select("conv_id", *keep, (F.explode_outer if outer else F.explode)("examples").alias("e"))
    return rows.select("conv_id", "e.*", (F.col("e.loss_end") + len(CLOSE)).alias("n_chars"), *keep)


def example_text(formatted: Column, loss_end: Column) -> Column:
    return F.substring(formatted, F.lit(1), loss_end + len(CLOSE))


def read_back(rendered: DataFrame, *keep: str) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_texts array<string>, formatted_chars), from the output alone."""
    marked = F.slice(F.split("formatted", r"<\|im_start\|>"), F.lit(2), F.size(F.split("formatted", r"<\|im_start\|>")))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(head) + 2, F.length(piece) - F.length(head) - 1 - len(CLOSE))
        return F.struct(unescaped(head, role=True).alias("role"), unescaped(body).alias("text"))

    loss = F.transform("examples", lambda e: unescaped(F.substring(F.col("formatted"), e["loss_start"] + 1, e["loss_end"] - e["loss_start"])))
    return rendered.select("conv_id", F.transform(marked, turn).alias("turns"), loss.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"), *keep)


def digests(conversations: DataFrame) -> DataFrame:
    """What the contract asks of each conversation, read back from the rendered form and from its examples: each is cut out as a text
    of its own, and its trained part is taken from that text."""
    rendered = render(conversations)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = ("n_turns", "turns_sha256", "formatted_chars")
    back = read_back(rendered, "formatted", "examples").select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), "formatted_chars", "formatted", "examples")
    rows = expand(back, *whole, "formatted", outer=True).withColumn("text", example_text(F.col("formatted"), F.col("loss_end")))
    loss = unescaped(F.expr("substring(text, loss_start + 1, loss_end - loss_start)"))
    rows = rows.select("conv_id", *whole, F.when(F.col("target").isNotNull(), F.struct("target", loss.alias("loss"))).alias("x"))
    rows = rows.groupBy("conv_id", *whole).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["loss"]), "").alias("loss"))
    return rows.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
