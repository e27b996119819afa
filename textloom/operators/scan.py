"""Reading whole documents window by window with an injected extractor, and what a first look at a document shows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import ranges as R
from . import verification as V
from ..session import shipped
from ..sources.scratch import scratch_table

#: An extractor takes a question and a window's text and gives quotes; it stands for a language model.
Extractor = Callable[[str, str], list[str]]
MOST_FINDINGS = 6
#: What an overview of a contract should show, by topic, in the order of patterns.
KEY_TOPICS = [
    ("term", [r"\bterm of (this|the) agreement\b", r"\binitial term\b", r"\bshall (commence|continue)\b", r"\brenew"]),
    ("liability", [r"\b(total|aggregate) liability\b", r"\bliability cap\b", r"\bshall not be liable\b"]),
    ("termination", [r"\bterminate this agreement\b", r"\bmay terminate\b"]),
    ("law", [r"\bgoverned by\b", r"\bgoverning law\b"]),
    ("payment", [r"\b(fees|charges)\b[^.\n]{0,120}\b(pay|payable|invoice|within)\b", r"\bshall pay\b"]),
    ("confidentiality", [r"\bconfidential information\b"]),
    ("indemnity", [r"\bindemnif"]),
    ("force_majeure", [r"\bforce majeure event\b", r"\bforce majeure\b"]),
    ("intellectual_property", [r"\bintellectual property\b"]),
    ("data", [r"\bpersonal data\b", r"\bdata protection\b"]),
]


def sentence_picker(question: str, text: str, most: int = 2) -> list[str]:
    """A deterministic stand-in: the sentences that share most words with the question, at least two."""
    asked = set(re.findall(r"[a-z]{3,}", question.lower()))
    told = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text)]
    scored = sorted(((-len(asked & set(re.findall(r"[a-z]{3,}", s.lower()))), k) for k, s in enumerate(told)))
    return [told[k] for n, k in scored[:most] if -n >= 2]


def scan(windows: DataFrame, docs: DataFrame, questions: DataFrame, extract: Extractor, most: int = MOST_FINDINGS) -> tuple[DataFrame, DataFrame]:
    """Findings and the account of a scan of questions (question_id, doc, text) over windows (doc, index, start, end).

    Findings: (question_id, doc, start, end), each quote verified in the document at once, once for all windows that have it. Account:
    (question_id, doc, n_windows, n_failed, n_discarded); a window whose extractor fails is counted, never dropped silently. The extractor is asked once for
    each window and each quote is verified once: what they gave is written to the shared folder, and both outputs read it from there.
    """
    rows = questions.select("question_id", "doc", F.col("text").alias("question")).join(windows, "doc").join(docs.select("doc", F.col("text").alias("body")), "doc")
    rows = rows.select("question_id", "doc", "index", "question", F.col("start").alias("from"), F.substring("body", F.col("start") + 1, F.col("end") - F.col("start")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quotes, failed = [], []
            for q, t in zip(batch.column("question").to_pylist(), batch.column("body").to_pylist(), strict=True):
                try:
                    quotes.append(extract(q, t)[:most])
                    failed.append(False)
                except Exception:  # noqa: BLE001  whatever an extractor raises is a failed window
                    quotes.append([])
                    failed.append(True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("question_id", "doc", "index")), pa.array(quotes, pa.list_(pa.string())), pa.array(failed, pa.bool_())], ["question_id", "doc", "index", "quotes", "failed"])

    shape = f"question_id {questions.schema['question_id'].dataType.simpleString()}, doc {rows.schema['doc'].dataType.simpleString()}, index int, quotes array<string>, failed boolean"
    told = scratch_table(rows.transform(shipped).mapInArrow(run, shape), "scanned-windows")
    asked = told.select("question_id", "doc", "index", F.posexplode("quotes").alias("k", "quote"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    quotes = asked.select(F.struct("question_id", "doc", "index", "k").alias("quote_id"), F.col("doc").alias("doc_id"), F.col("quote").alias("text"), empty.alias("context"))
    checked = V.verify_quotes(docs.select(F.col("doc").alias("doc_id"), "text", empty.alias("furniture")), quotes)
    at = F.get("occurrences", F.col("primary"))
    checked = scratch_table(checked.select("quote_id.question_id", "quote_id.doc", "status", at["start"].alias("start"), at["end"].alias("end")), "scanned-quotes")
    found = checked.where("status <> 'unverified'").select("question_id", "doc", "start", "end").distinct()
    lost = checked.where("status = 'unverified'").groupBy("question_id", "doc").agg(F.count("*").alias("n_discarded"))
    account = told.groupBy("question_id", "doc").agg(F.count("*").alias("n_windows"), F.count_if("failed").alias("n_failed")).join(lost, ["question_id", "doc"], "left")
    return found, account.select("question_id", "doc", "n_windows", "n_failed", F.coalesce("n_discarded", F.lit(0)).alias("n_discarded"))


def clean_slice(text: Column) -> Column:
    """Trailing blanks off each line, two line feeds at most, trimmed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), F.lit(" \t\n\r"))


def first_topics(lines: DataFrame, topics: list[tuple[str, list[str]]] = KEY_TOPICS, length: int = 700, furniture: DataFrame | None = None) -> DataFrame:
    """(doc, topic, start, end): for each topic the first line of six words and more that fits its first pattern, or else its next;
    contents lines do not count, nor do lines of furniture (doc, start, end)."""
    if furniture is not None:
        lines = lines.join(R.overlap_join(lines.select("doc", "ord", "start", "end"), furniture.select("doc", "start", "end")).select("doc", "ord").distinct(), ["doc", "ord"], "left_anti")
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    rows = lines.where((words >= 6) & ~F.col("text").rlike(r"(\.{4,}|…{2,}|(\s\.){3,})\s*\d+\s*$"))
    hit = F.filter(F.array(*[F.when(F.col("text").rlike(f"(?i){p}"), F.struct(F.lit(t).alias("topic"), F.lit(k).alias("k"))) for t, patterns in topics for k, p in enumerate(patterns)]), lambda x: x.isNotNull())
    rows = rows.select("doc", "start", F.explode(hit).alias("h"))
    best = rows.groupBy("doc", "h.topic").agg(F.min(F.struct("h.k", "start")).alias("b"))
    return best.select("doc", "topic", "b.start", (F.col("b.start") + length).alias("end"))


def opening_parts(sections: DataFrame, budget: int, length: int = 350) -> DataFrame:
    """(doc, ord, start, end): the first characters of top sections in order, until one does not fit the token budget."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = sections.where(F.col("level") == 1).withColumn("end", F.least("end", F.col("start") + length)).withColumn("used", F.sum(F.ceil((F.col("end") - F.col("start")) / 4)).over(w))
    return rows.where(F.col("used") <= budget).select("doc", "ord", "start", "end")


def overview(lines: DataFrame, sections: DataFrame, lengths: DataFrame, topics: list[tuple[str, list[str]]], budget: int, opening: int = 1200) -> DataFrame:
    """(doc, start, end, percent): the opening, the first passage on each topic and the first lines of top sections, merged, and how much
    of the document that is (one per cent at least)."""
    parts = lengths.select("doc", F.lit(0).cast("long").alias("start"), F.least("n", F.lit(opening)).cast("long").alias("end"))
    for more in (first_topics(lines, topics), opening_parts(sections, budget)):
        parts = parts.unionByName(more.select("doc", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    cut = parts.join(lengths, "doc").select("doc", "start", F.least("end", "n").alias("end"))
    merged = R.merge(cut)
    total = merged.groupBy("doc").agg(F.sum(F.col("end") - F.col("start")).alias("shown")).join(lengths, "doc")
    percent = F.greatest(F.lit(1), F.round(100 * F.col("shown") / F.greatest(F.lit(1), F.col("n")))).cast("long")
    return merged.join(total.select("doc", percent.alias("percent")), "doc")


def section_page(sections: DataFrame, docs: DataFrame, size: int = 6000) -> DataFrame:
    """(doc, ord, page, text): sections' texts in pages of ``size`` characters."""
    rows = sections.where("end > start").join(docs, "doc").select("doc", "ord", "start", "end", "text", F.explode(F.sequence(F.lit(0).cast("int"), F.floor((F.col("end") - F.col("start") - 1) / size).cast("int"))).alias("page"))
    at = F.col("start") + F.col("page") * size
    return rows.select("doc", "ord", "page", F.substring("text", at.cast("int") + 1, F.least(F.lit(size), F.col("end") - at).cast("int")).alias("text"))


def read_pages(calls: DataFrame, pages: DataFrame, docs: DataFrame, most: int = 3) -> DataFrame:
    """(call_id, error, page_no, text, unreadable, next): the pages that calls (call_id, doc, first, last) ask for, ``most`` at once, from ``first`` on; next is where
    to go on if there were more. A document without pages, and pages out of range, give one row with an error. pages (doc, page_no, start, end, unreadable), numbered
    from 1; an unreadable page shows no text."""
    told = calls.join(pages.groupBy("doc").agg(F.count("*").alias("n")), "doc", "left")
    ranged = (F.col("first") >= 1) & (F.col("last") <= F.col("n")) & (F.col("first") <= F.col("last"))
    told = told.withColumn("error", F.when(F.col("n").isNull(), "NO_PAGES").when(~F.coalesce(ranged, F.lit(False)), "PAGE_OUT_OF_RANGE"))
    final = F.least(F.col("last"), F.col("first") + most - 1)
    shown = told.where("error is null").select("call_id", "doc", F.when(final < F.col("last"), final + 1).alias("next"), F.explode(F.sequence("first", final)).alias("page_no"))
    rows = shown.join(pages, ["doc", "page_no"]).join(docs.select("doc", F.col("text").alias("body")), "doc")
    text = clean_slice(F.expr("substring(body, cast(start as int) + 1, cast(end - start as int))"))
    rows = rows.select("call_id", F.lit(None).cast("string").alias("error"), F.col("page_no").cast("long").alias("page_no"), F.when(F.col("unreadable"), "").otherwise(text).alias("text"), "unreadable", F.col("next").cast("long").alias("next"))
    return rows.unionByName(told.where("error is not null").select("call_id", "error"), allowMissingColumns=True)


def plain_quotes(answers: DataFrame, least: int = 25, most: int = 800) -> DataFrame:
    """(answer_id, pos, quote): passages of five words and more in plain quotation marks."""
    rows = answers.select("answer_id", F.posexplode(F.regexp_extract_all("content", F.lit(f"[“\"]([^“”\"]{{{least},{most}}})[”\"]"), 1)).alias("pos", "quote"))
    return rows.where(F.size(F.filter(F.split(F.trim("quote"), r"\s+"), lambda w: w != "")) >= 5)


def recovered_citations(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """plain_quotes of answers (answer_id, doc_id, content) that are verified in their document: (answer_id, pos, status, method)."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    quotes = plain_quotes(answers).join(answers.select("answer_id", "doc_id"), "answer_id")
    told = V.verify_quotes(docs.select("doc_id", "text", empty.alias("furniture")), quotes.select(F.struct("answer_id", "pos").alias("quote_id"), "doc_id", F.col("quote").alias("text"), empty.alias("context")))
    return told.where("status <> 'unverified'").select("quote_id.answer_id", "quote_id.pos", "status", "method")


def document_bundle(docs: DataFrame, pages: DataFrame, sections: DataFrame) -> DataFrame:
    """docs with their pages and sections as sorted arrays, all in one row."""
    packed = lambda rows, name, *c: rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(*c))).alias(name))
    out = docs.join(packed(pages, "pages", "start", "page_no"), "doc", "left").join(packed(sections, "sections", "ord", "start", "end", "title"), "doc", "left")
    return out.withColumn("tokens", X.token_estimate(F.col("text")))
