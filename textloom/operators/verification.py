"""Quotes looked up in documents.

``passages`` is the built-in path for exact matches of many passages in all documents: an equality join on word anchors,
then a substring check. ``verify_quotes`` runs all tiers on the documents that quotes name; a document's text meets its
quotes once, in groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matching as M
from ..functions import text as X
from ..session import shipped

#: Quotes of one document that are worked on together.
GROUP = 500
VERDICT = "status string, method string, score double, reason string, occurrences array<struct<start:int,end:int>>, primary int, segments array<struct<start:int,end:int>>"


def _anchors(spaced: Column, width: int = 3) -> Column:
    """64-bit hashes of all runs of ``width`` words."""

    def hashes(words: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
        return F.when(F.size(words) < width, F.array().cast("array<bigint>")).otherwise(every)

    return X.let(F.split(spaced, " "), hashes)


def passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, position): items whose spaced form stands in a document's, with its first place from 0.

    docs (doc_id, text), items (item_id, text) of five words or more. An occurrence may cut the item's first and last
    word short, so the anchor is the run of words two to four. Documents are not shuffled as long as the anchors are few enough
    to be broadcast, which the planner judges by their size; beyond, ids and anchors are shuffled, not texts.
    """
    items = items.select("item_id", X.spaced(F.col("text")).alias("passage")).where("passage <> ''")
    words = F.split("passage", " ")
    items = items.where(F.size(words) >= 5).withColumn("anchor", F.xxhash64(*[F.get(words, F.lit(k)) for k in (1, 2, 3)]))
    docs = docs.select("doc_id", X.spaced(F.col("text")).alias("spaced"))
    # Only ids and anchors are exploded; a text is not copied for each of its words, but read again where an anchor was met.
    at = docs.select("doc_id", F.explode(F.array_distinct(_anchors(F.col("spaced")))).alias("anchor"))
    met = at.join(items.select("anchor", "item_id", "passage"), "anchor").select("doc_id", "item_id", "passage").distinct()
    rows = met.join(docs, "doc_id").where(F.contains("spaced", "passage"))
    return rows.select("doc_id", "item_id", (F.instr("spaced", F.col("passage")) - 1).cast("long").alias("position"))


def _letter_runs(compact: Column, width: int) -> Column:
    """64-bit hashes of all runs of ``width`` letters."""

    def hashes(letters: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(letters) - width), lambda i: F.xxhash64(*[F.get(letters, i + k) for k in range(width)]))
        return F.when(F.size(letters) < width, F.array().cast("array<bigint>")).otherwise(every)

    return X.let(F.split(compact, ""), hashes)


def compact_passages(docs: DataFrame, items: DataFrame, prefix: int = 16) -> DataFrame:
    """(doc_id, item_id): items of ``prefix`` letters and more that stand in a document letter by letter, whatever the white space and punctuation, at
    a place whose numbers read as the item's.

    An item's first letters are the equality key, as in ``passages``: only ids and runs are exploded, and a text is read again where a run
    was met. There the numbers of the span itself are compared.
    """
    items = items.select("item_id", F.col("text").alias("item"), X.compact(F.col("text")).alias("needle")).where(F.length("needle") >= prefix)
    items = items.withColumn("run", F.get(_letter_runs(F.substring("needle", 1, prefix), prefix), F.lit(0)))
    hay = docs.select("doc_id", F.col("text").alias("source"), X.compact(F.col("text")).alias("hay"))
    at = hay.select("doc_id", F.explode(F.array_distinct(_letter_runs(F.col("hay"), prefix))).alias("run"))
    met = at.join(items.select("run", "item_id", "item", "needle"), "run").select("doc_id", "item_id", "item", "needle").distinct()
    rows = met.join(hay, "doc_id").where(F.contains("hay", "needle")).select("doc_id", "item_id", "item", "source")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stands = [bool(M.Document(text).loose(item)) for item, text in zip(batch.column("item").to_pylist(), batch.column("source").to_pylist(), strict=True)]
            yield batch.select(["doc_id", "item_id"]).filter(pa.array(stands, pa.bool_()))

    return rows.transform(shipped).mapInArrow(run, f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}")


def _spans(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": s, "end": e} for s, e in spans]


def verify_quotes(docs: DataFrame, quotes: DataFrame, *, group: int = GROUP, most: int | None = M.MAX_FOUND) -> DataFrame:
    """(quote_id, doc_id, VERDICT columns) for quotes (quote_id, doc_id, text, context array<struct<start,end>>).

    docs: (doc_id, text, furniture array<struct<start,end>>). A quote of an unknown document is unverified with the
    reason unknown_document. ``most`` places of a quote are told, with None all of them.
    """
    # row_number over a document's quotes deals them into groups; a group and the text are one row.
    w = Window.partitionBy("doc_id").orderBy("quote_id")
    dealt = quotes.withColumn("_g", F.floor((F.row_number().over(w) - 1) / group))
    held = dealt.groupBy("doc_id", "_g").agg(F.collect_list(F.struct("quote_id", "text", "context")).alias("quotes")).drop("_g")
    rows = held.join(docs.select("doc_id", F.col("text").alias("body"), "furniture"), "doc_id", "left")
    quote_type, doc_type = quotes.schema["quote_id"].dataType.simpleString(), quotes.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, asked, body, furniture in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "quotes", "body", "furniture")), strict=True):
                doc = None if body is None else M.Document(body, tuple((r["start"], r["end"]) for r in furniture or ()))
                told = [M.Verdict("unverified", reason="unknown_document") if doc is None else M.verify(doc, q["text"] or "", [(r["start"], r["end"]) for r in q["context"] or ()], most) for q in asked]
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                kind = batch.schema.field("quotes").type.value_type.field("quote_id").type
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([q["quote_id"] for q in asked], kind),
                        pa.array([doc_id] * len(asked), batch.schema.field("doc_id").type),
                        pa.array([v.status for v in told], pa.string()),
                        pa.array([v.method for v in told], pa.string()),
                        pa.array([v.score for v in told], pa.float64()),
                        pa.array([v.reason for v in told], pa.string()),
                        pa.array([_spans(v.occurrences) for v in told], span),
                        pa.array([v.primary for v in told], pa.int32()),
                        pa.array([_spans(v.segments) for v in told], span),
                    ],
                    ["quote_id", "doc_id", *(c.split()[0] for c in VERDICT.split(", "))],
                )

    return rows.transform(shipped).mapInArrow(run, f"quote_id {quote_type}, doc_id {doc_type}, {VERDICT}")


def attribute(docs: DataFrame, chats: DataFrame, quotes: DataFrame) -> DataFrame:
    """verify_quotes against the document that a quote's tag names in its chat, and for those not found there the first
    other document of the chat (by tag number) that has the quote exactly: status misattributed, found_in.

    chats: (chat_id, tag, doc_id); quotes: (quote_id, chat_id, tag, text). Tags are trimmed and case does not count.
    """
    number = F.regexp_extract("tag", r"(\d+)", 1).cast("int")
    chats = chats.select("chat_id", F.upper("tag").alias("tag"), "doc_id")
    asked = quotes.withColumn("tag", F.upper(F.trim("tag"))).join(chats, ["chat_id", "tag"], "left")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    first = verify_quotes(docs, asked.select("quote_id", "doc_id", "text", empty.alias("context")))
    missed = first.where("status = 'unverified' and doc_id is not null").select("quote_id", F.col("doc_id").alias("claimed"))
    others = missed.join(asked.select("quote_id", "chat_id", "text"), "quote_id").join(chats.select("chat_id", "doc_id", number.alias("n")), "chat_id").where("doc_id <> claimed")
    # Only whether a quote stands there is asked of other documents, not where, and not nearly.
    told = others.select("quote_id", "n", "doc_id", "text").join(docs.select("doc_id", F.col("text").alias("body"), "furniture"), "doc_id")

    def standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(*(batch.column(c).to_pylist() for c in ("text", "body", "furniture")), strict=True)
            there = [body is not None and M.exists_exactly(M.Document(body, tuple((r["start"], r["end"]) for r in furniture or ())), text or "") for text, body, furniture in texts]
            yield batch.select(["quote_id", "n", "doc_id"]).filter(pa.array(there, pa.bool_()))

    kinds = {f.name: f.dataType.simpleString() for f in told.schema}
    there = told.transform(shipped).mapInArrow(standing, f"quote_id {kinds['quote_id']}, n int, doc_id {kinds['doc_id']}")
    again = there.groupBy("quote_id").agg(F.min_by("doc_id", "n").alias("found_in"))
    rows = first.join(again, "quote_id", "left")
    return rows.withColumn("status", F.when(F.col("found_in").isNotNull(), "misattributed").otherwise(F.col("status")))


def located(occurrences: DataFrame, sections: DataFrame, pages: DataFrame) -> DataFrame:
    """occurrences (doc, id, start, end) with the deepest section at their start (the later one among equals) and the
    pages of their first and last character."""
    from . import ranges as R

    points = occurrences.select("doc", "id", F.col("start").alias("pos"))
    last = occurrences.select("doc", "id", (F.greatest(F.col("start"), F.col("end") - 1)).alias("pos"))
    inner = R.containing(points, sections.select("doc", "start", "end", "level", "ord", "number", "title"))
    inner = inner.groupBy("doc", "id").agg(F.max_by(F.struct("number", "title"), F.struct("level", "ord")).alias("s"))
    a = R.last_starting(points, pages.select("doc", "start", "page_no"), ["page_no"]).select("doc", "id", F.col("page_no").alias("page_start"))
    b = R.last_starting(last, pages.select("doc", "start", "page_no"), ["page_no"]).select("doc", "id", F.col("page_no").alias("page_end"))
    rows = occurrences.join(inner, ["doc", "id"], "left").join(a, ["doc", "id"], "left").join(b, ["doc", "id"], "left")
    return rows.select(*occurrences.columns, F.col("s.number").alias("section_number"), F.col("s.title").alias("section_title"), "page_start", "page_end")


def citation_numbers(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(answer_id, citation_id, number): verified citations numbered by their first mark ⟦cN⟧ in the answer; citations of
    one passage share a number. answers (answer_id, content); citations (answer_id, citation_id, passage, status)."""
    marks = answers.select("answer_id", F.posexplode(F.regexp_extract_all("content", F.lit("⟦(c\\d+)⟧"), 1)).alias("pos", "citation_id"))
    first = marks.groupBy("answer_id", "citation_id").agg(F.min("pos").alias("pos"))
    rows = first.join(citations.where("status in ('verified', 'verified_close')"), ["answer_id", "citation_id"])
    rows = rows.withColumn("seen", F.min("pos").over(Window.partitionBy("answer_id", "passage")))
    return rows.select("answer_id", "citation_id", F.dense_rank().over(Window.partitionBy("answer_id").orderBy("seen")).alias("number"))


_MARK = "⟦(c\\d+)⟧"
#: The words and signs that leave a sentence open before a quote, how far back they are looked for, and how much of a quote is shown there.
OPEN_WORDS = (
    "is", "are", "was", "were", "be", "made", "that", "where", "which", "as", "since", "because", "state", "states", "stating", "provide", "provides", "providing", "say", "says", "saying", "read", "reads",
    "noting", "meaning", "namely", "including", "of", "by", "under", "in", "to", "with", "from", "between", "and", "or", "than", "per",
)
OPEN_SIGNS, LEAD_IN, SHOWN_QUOTE, MARKDOWN = ":—–", 40, 240, r"([\\`*_\[\]<>#|~])"


def _marks(answers: DataFrame) -> DataFrame:
    """(answer_id, pos, citation_id, lead): the marks ⟦cN⟧ of answers in order, each with what stands before it, as far as the mark before."""
    plain = F.transform(F.split("content", "⟦c\\d+⟧"), lambda p, i: F.when(i > 0, F.concat(F.lit("⟧"), p)).otherwise(p))
    rows = answers.select("answer_id", plain.alias("plain"), F.posexplode(F.regexp_extract_all("content", F.lit(_MARK), 1)).alias("pos", "citation_id"))
    return rows.select("answer_id", "pos", "citation_id", F.right(F.get("plain", F.col("pos")), F.lit(LEAD_IN)).alias("lead"))


def _filled(answers: DataFrame, shown: DataFrame) -> DataFrame:
    """(answer_id, content) with the text of shown (answer_id, pos, text) in the place of each mark; marks without one go."""
    texts = shown.groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "text"))).alias("texts"))
    rows = answers.select("answer_id", F.split("content", "⟦c\\d+⟧").alias("plain")).join(texts, "answer_id", "left")
    joined = F.array_join(F.transform("plain", lambda p, i: F.concat(p, F.coalesce(F.try_element_at("texts", i), F.lit("")))), "")
    return rows.select("answer_id", joined.alias("content"))


def rendered_answers(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(answer_id, content) with each mark replaced by its verified quote in tag form; marks of others go."""
    shown = citations.where("status in ('verified', 'verified_close') and display is not null")
    quote = F.concat(F.lit(' <quote doc="'), F.col("tag"), F.lit('">'), F.col("display"), F.lit("</quote> "))
    return _filled(answers, _marks(answers).join(shown, ["answer_id", "citation_id"]).select("answer_id", "pos", quote.alias("text")))


def plain_answers(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(answer_id, content) as plain text: each mark gives the number of its verified citation, or says that it is unverified; unknown marks go.
    answers (answer_id, content); citations (answer_id, citation_id, passage, status)."""
    told = citations.join(citation_numbers(answers, citations), ["answer_id", "citation_id"], "left")
    text = F.coalesce(F.concat(F.lit(" ["), F.col("number").cast("string"), F.lit("]")), F.lit(" [unverified]"))
    return _filled(answers, _marks(answers).join(told, ["answer_id", "citation_id"]).select("answer_id", "pos", text.alias("text")))


def markdown_answers(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(answer_id, content) as Markdown: each mark is a link; where the words before it leave the sentence open, the words of its verified citation
    stand before the link, escaped, an overlong quote cut. citations (answer_id, citation_id, status, display)."""
    known = citations.where("status in ('verified', 'verified_close') and display <> ''").select("answer_id", "citation_id", "display")
    rows = _marks(answers).join(known, ["answer_id", "citation_id"], "left")
    opened = F.col("lead").rlike(rf"(?i)(?:(?<![0-9A-Za-z_])(?:{'|'.join(OPEN_WORDS)})|[{OPEN_SIGNS}])[\s\x{{A0}}]*$")
    words = F.when(F.length("display") > SHOWN_QUOTE, F.concat(F.substring("display", 1, SHOWN_QUOTE - 3), F.lit("…"))).otherwise(F.col("display"))
    quote = F.when(opened, F.concat(F.lit(" *“"), F.regexp_replace(words, MARKDOWN, r"\\$1"), F.lit("”*")))
    link = F.concat(F.coalesce(quote, F.lit("")), F.lit(" ["), F.col("citation_id"), F.lit("](#cite-"), F.col("citation_id"), F.lit(")"))
    return _filled(answers, rows.select("answer_id", "pos", link.alias("text")))


def displayed(text: str = "text", start: str = "start", end: str = "end", furniture: str = "furniture") -> Column:
    """The document's own words for a range, as a column: furniture (array<struct<start,end>>) out, broken words joined, white space collapsed."""
    kept = f"""
        aggregate(filter(array_sort(`{furniture}`), s -> s.end > `{start}` and s.start < `{end}`), named_struct('at', cast(`{start}` as int), 'out', cast(array() as array<string>)),
            (a, s) -> if(s.end <= a.at, a, named_struct('at', cast(greatest(a.at, least(s.end, `{end}`)) as int), 'out', array_append(a.out, substring(`{text}`, a.at + 1, greatest(a.at, s.start) - a.at)))),
            a -> array_join(array_append(a.out, substring(`{text}`, a.at + 1, cast(`{end}` as int) - a.at)), '\n'))
    """
    joined = F.regexp_replace(F.expr(kept), r"(?U)(\p{L})-[ \t]*\n\s*(?=\p{Ll})", "$1")
    return F.trim(F.regexp_replace(joined, r"(?U)\s+", " "))


def highlight_boxes(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, id, page_no, rects): the rectangles of a range's items on each page, those of one visual line merged, padded.

    pages: (doc, page_no, width, height, items array<struct<start,len,x,y,w,h>>), coordinates from 0 to 1, furniture
    items left out; spans: (doc, id, start, end). Rows of one page fold in order inside one array expression.
    """
    from . import ranges as R

    items = pages.select("doc", "page_no", "width", "height", F.explode("items").alias("i")).where("i.len > 0")
    items = items.select("doc", F.col("i.start").alias("start"), (F.col("i.start") + F.col("i.len")).alias("end"), F.struct("page_no", "width", "height", "i").alias("at"))
    rows = R.overlap_join(spans.select("doc", "id", "start", "end"), items).select("doc", "id", "start", "end", "r_at.*")
    lo, hi = F.greatest("start", "i.start") - F.col("i.start"), F.least(F.col("end"), F.col("i.start") + F.col("i.len")) - F.col("i.start")
    share = F.col("i.w") / F.col("i.len")
    rect = F.struct(F.col("i.start").alias("at"), (F.col("i.x") + share * lo).alias("x"), F.col("i.y").alias("y"), (share * (hi - lo)).alias("w"), F.col("i.h").alias("h"))
    rows = rows.groupBy("doc", "id", "page_no").agg(F.first(F.col("height") / F.col("width")).alias("ar"), F.sort_array(F.collect_list(rect)).alias("parts"))
    rows = rows.select("doc", "id", "page_no", "ar", F.transform("parts", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["w"].alias("w"), p["h"].alias("h"))).alias("parts"))
    merged = """
        aggregate(parts, cast(array() as array<struct<x:double,y:double,w:double,h:double>>), (acc, r) -> if(
            size(acc) > 0
                and abs(element_at(acc, -1).y - r.y) < 0.3 * greatest(element_at(acc, -1).h, r.h)
                and r.x - element_at(acc, -1).x - element_at(acc, -1).w < 0.6 * greatest(element_at(acc, -1).h, r.h) * ar
                and r.x - element_at(acc, -1).x - element_at(acc, -1).w > -0.5 * element_at(acc, -1).w,
            concat(slice(acc, 1, size(acc) - 1), array(named_struct(
                'x', least(element_at(acc, -1).x, r.x), 'y', least(element_at(acc, -1).y, r.y),
                'w', greatest(element_at(acc, -1).x + element_at(acc, -1).w, r.x + r.w) - least(element_at(acc, -1).x, r.x),
                'h', greatest(element_at(acc, -1).y + element_at(acc, -1).h, r.y + r.h) - least(element_at(acc, -1).y, r.y)))),
            array_append(acc, r)))
    """
    rows = rows.select("doc", "id", "page_no", "ar", F.expr(merged).alias("m"))
    padded = """transform(m, r -> named_struct('x', round(greatest(0, r.x - 0.15 * r.h * ar), 4), 'y', round(greatest(0, r.y - 0.15 * r.h), 4),
        'w', round(least(1, r.w + 0.3 * r.h * ar), 4), 'h', round(least(1, r.h + 0.3 * r.h), 4)))"""
    return rows.select("doc", "id", "page_no", F.expr(padded).alias("rects"))


def rendered_spans(positions: DataFrame, spans: DataFrame) -> DataFrame:
    """positions (doc, pos, ...) with the rendered span (doc, start, node, length) that holds them, the last one starting at or before, and the offset in
    it, which never passes the span's end."""
    from . import ranges as R

    rows = R.last_starting(positions, spans.select("doc", "start", "node", "length", F.col("start").alias("at")), ["node", "length", "at"])
    return rows.select(*positions.columns, "node", F.least(F.col("pos") - F.col("at"), F.col("length")).alias("offset"))


def built_citations(verdicts: DataFrame, docs: DataFrame) -> DataFrame:
    """(quote_id, status, display) of verdicts (quote_id, doc_id, status, occurrences, primary, segments): the document's own words of the parts of a quote, joined
    by " … "; a quote that is not verified, or whose stream was cut off (status abandoned), shows nothing and is unverified."""
    at = F.when(F.size("segments") > 0, F.col("segments")).otherwise(F.slice("occurrences", F.col("primary") + 1, F.lit(1)))
    good = F.col("status").isin("verified", "verified_close")
    rows = verdicts.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id", "left").withColumn("at", at)
    words = lambda r: F.trim(F.regexp_replace(F.regexp_replace(F.substring(F.col("body"), r["start"] + 1, r["end"] - r["start"]), r"(\p{L})-[ \t]*\n\s*(?=\p{Ll})", "$1"), r"\s+", " "))
    status = F.when(good | (F.col("status") == "misattributed"), F.col("status")).otherwise("unverified")
    return rows.select("quote_id", status.alias("status"), F.when(good, F.array_join(F.transform("at", words), " … ")).alias("display"))
