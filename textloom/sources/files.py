"""File intake: what kind of file it is, whether it is taken, and the text of Word and HTML files.

Files are rows (path, content) as Spark's binaryFile reader gives them. PDF text needs a library that is not here; lines can be
made from extracted items (``lines_from_items``).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship, shipped

# Fixed values.
MAX_BYTES = 50 * 1024 * 1024
BLOCK_TAGS = frozenset("address article aside blockquote dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SILENT_TAGS = frozenset("script style head title noscript template".split())
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return ship(spark).read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content", "length")


def sniffed(content: Column) -> Column:
    """pdf (header in the first kilobyte), ole (old Office), zip, text or unknown, from the first bytes."""
    head = F.hex(F.substring(content, 1, 1024))
    return (
        F.when(F.contains(head, F.lit("255044462D")), "pdf")
        .when(head.startswith("D0CF11E0A1B11AE1"), "ole")
        .when(head.startswith("504B0304"), "zip")
        .when(~F.regexp_like(head, F.lit("^(?:..)*?(?:0[0-8]|0E|0F|1[0-9A-F])")), "text")
        .otherwise("unknown")
    )


def _members(content: bytes) -> list[str]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return z.namelist()
    except (zipfile.BadZipFile, OSError):
        return []


def with_kind(files: DataFrame) -> DataFrame:
    """files with the column kind: pdf, docx, doc, zip, text or unknown; archives are looked into."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = ["docx" if "word/document.xml" in _members(c) else "zip" for c in batch.column("content").to_pylist()]
            names = [n for n in batch.schema.names if n != "kind"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(kinds, pa.string())], [*names, "kind"])

    rows = files.withColumn("kind", sniffed(F.col("content")))
    rows = rows.withColumn("kind", F.when(F.col("kind") == "ole", "doc").otherwise(F.col("kind")))
    zips = rows.where("kind = 'zip'").transform(shipped).mapInArrow(look, rows.schema)
    return rows.where("kind <> 'zip'").unionByName(zips)


MAX_PAGES, LEAST_TEXT = 500, 50


def intake_error(kind: Column, size: Column, limit: int = MAX_BYTES) -> Column:
    """The code for which a file is rejected, null if it is taken."""
    return F.when(size == 0, "empty_document").when(size > limit, "too_large").when(kind == "doc", "legacy_word").when(~kind.isin("pdf", "docx"), "unsupported_type")


def content_error(encrypted: Column, readable: Column, pages: Column, solid: Column, kind: Column) -> Column:
    """The code for which a file that was taken in fails once it is read, null if it does not: encrypted, not readable as its kind, of too
    many pages, or with too few characters that are not blanks."""
    empty = F.when(kind == "pdf", "no_text_layer").otherwise("empty_document")
    return F.when(encrypted, "encrypted").when(~readable, "damaged").when(pages > MAX_PAGES, "too_many_pages").when(solid < LEAST_TEXT, empty)


def split_by_error(files: DataFrame, code: Column) -> tuple[DataFrame, DataFrame]:
    """(taken, rejected): the latter with code and HTTP status."""
    told = files.withColumn("code", code)
    return told.where("code is null").drop("code"), told.where("code is not null").withColumn("status", error_status(F.col("code")))


ERROR_STATUS = {"empty_document": 400, "too_large": 413, "legacy_word": 415, "unsupported_type": 415, "encrypted": 422, "damaged": 422, "too_many_pages": 422, "no_text_layer": 422}


def error_status(code: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, status in ERROR_STATUS.items():
        out = out.when(code == name, status)
    return out


def lines_from_items(items: DataFrame) -> DataFrame:
    """(doc, page_no, line, text, top, bottom) from extracted items (doc, page_no, ord, text, x, y, w, h): a new line where the
    baseline moves by more than half the height, a blank where the gap is over 0.15 of it."""
    w = Window.partitionBy("doc", "page_no").orderBy("ord")
    moved = F.abs(F.col("y") - F.lag("y").over(w)) > 0.5 * F.col("h")
    gap = F.col("x") - (F.lag("x").over(w) + F.lag("w").over(w)) > 0.15 * F.col("h")
    rows = items.select("*", F.coalesce(moved, F.lit(True)).alias("fresh"), F.coalesce(gap, F.lit(False)).alias("gap"))
    rows = rows.withColumn("line", F.sum(F.col("fresh").cast("int")).over(w))
    piece = F.when(F.col("gap") & ~F.col("fresh"), F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    out = rows.groupBy("doc", "page_no", "line").agg(F.sort_array(F.collect_list(F.struct("ord", piece.alias("t")))).alias("parts"), F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"))
    return out.select("doc", "page_no", "line", F.array_join(F.col("parts.t"), "").alias("text"), "top", "bottom")


# ---- Word


def roman(n: int) -> str:
    out = ""
    for value, letters in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += letters * (n // value)
        n %= value
    return out


def number_text(n: int, form: str) -> str:
    if form in ("lowerLetter", "upperLetter"):
        text = chr(97 + (n - 1) % 26) * ((n - 1) // 26 + 1)
        return text.upper() if form == "upperLetter" else text
    if form in ("lowerRoman", "upperRoman"):
        return roman(n).upper() if form == "upperRoman" else roman(n)
    return {"decimalZero": f"{n:02d}", "none": ""}.get(form, str(n))


#: Fixed value: the label of every bullet, whatever its font's character.
BULLET = "•"


class Numbering:
    """Labels of automatically numbered paragraphs. Counters belong to a list's abstract definition; a paragraph of one level starts the deeper ones
    anew, and levels above it that have not come yet stand at their start. What a list overrides holds from its first use."""

    def __init__(self, xml: bytes | None) -> None:
        self.levels: dict[str, dict[int, tuple[int, str, str, bool]]] = {}
        self.abstract: dict[str, str] = {}
        self.first: dict[str, dict[int, int]] = {}
        self.now: dict[str, dict[int, int]] = {}
        root = ElementTree.fromstring(xml) if xml else ElementTree.Element("none")
        for a in root.iter(f"{_W}abstractNum"):
            self.levels[a.get(f"{_W}abstractNumId")] = {
                int(v.get(f"{_W}ilvl")): (int(_val(v, "start") or 1), _val(v, "numFmt") or "decimal", _val(v, "lvlText") or "", v.find(f"{_W}isLgl") is not None and _val(v, "isLgl") not in ("0", "false", "off")) for v in a.iter(f"{_W}lvl")
            }
        for n in root.iter(f"{_W}num"):
            name = n.get(f"{_W}numId")
            self.abstract[name] = _val(n, "abstractNumId")
            starts = ((int(o.get(f"{_W}ilvl")), _val(o, "startOverride")) for o in n.iter(f"{_W}lvlOverride"))
            self.first[name] = {level: int(s) for level, s in starts if s is not None}

    @staticmethod
    def _put(counters: dict[int, int], level: int, value: int) -> None:
        counters[level] = value
        for deeper in [k for k in counters if k > level]:
            del counters[deeper]

    def label(self, num: str | None, level: int) -> str | None:
        abstract = self.abstract.get(num or "0") if num != "0" else None
        levels = self.levels.get(abstract, {})
        if level not in levels:
            return None
        counters = self.now.setdefault(abstract, {})
        for overridden, start in self.first.pop(num, {}).items():
            self._put(counters, overridden, start - 1)
        self._put(counters, level, counters.get(level, levels[level][0] - 1) + 1)
        start_of = lambda k: levels[k][0] if k in levels else 1
        for above in range(level):
            counters.setdefault(above, start_of(above))
        _, form, text, legal = levels[level]
        if form == "bullet":
            return BULLET

        def number(found: re.Match) -> str:
            k = int(found.group(1)) - 1
            own = "decimal" if legal or k not in levels or levels[k][1] == "bullet" else levels[k][1]
            return number_text(counters.get(k, start_of(k)), own)

        return re.sub(r"%(\d)", number, text).strip() or None


def _val(node: ElementTree.Element, name: str) -> str | None:
    found = node.find(f"{_W}{name}")
    return None if found is None else found.get(f"{_W}val")


def word_paragraphs(content: bytes) -> list[dict]:
    """Paragraphs of a Word file in their final view: text inserted stays, text deleted goes; with style, heading level (by the style
    or up to six styles it is based on) and number label; table cells in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        part = lambda n: z.read(n) if n in names else None
        body, styles, numbering = ElementTree.fromstring(part("word/document.xml")), part("word/styles.xml"), Numbering(part("word/numbering.xml"))
    based: dict[str, tuple[str | None, int | None]] = {}
    for s in ElementTree.fromstring(styles).iter(f"{_W}style") if styles else ():
        outline = s.find(f"{_W}pPr/{_W}outlineLvl")
        based[s.get(f"{_W}styleId")] = (_val(s, "basedOn"), None if outline is None else int(outline.get(f"{_W}val")) + 1)
    deleted = {f"{_W}del", f"{_W}moveFrom", f"{_W}instrText"}

    def text(node: ElementTree.Element) -> str:
        if node.tag in deleted:
            return ""
        own = {f"{_W}t": node.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(node.tag, "")
        return own + "".join(map(text, node))

    out = []
    cells = {p for t in body.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")}
    for p in body.iter(f"{_W}p"):
        style, level = None, None
        props = p.find(f"{_W}pPr")
        if props is not None:
            style = _val(props, "pStyle")
            at, hops = style, 0
            while at in based and level is None and hops < 6:
                at, level = based[at][0], based[at][1]
                hops += 1
        numbered = None if props is None else props.find(f"{_W}numPr")
        label = None if numbered is None else numbering.label(_val(numbered, "numId"), int(_val(numbered, "ilvl") or 0))
        out.append({"text": text(p), "style": style, "heading_level": level, "label": label, "in_table": p in cells})
    return out


def word_rows(contents: DataFrame) -> DataFrame:
    """(doc, ord, start, end, text, style, heading_level, label, in_table, error) of Word files (doc, content): a row for each paragraph, with its place in
    the text that joins them by line feeds. A file that is not readable gives one row with the error ``damaged``; a null content gives none."""
    kind = contents.schema["doc"].dataType.simpleString()
    fields = "ord int, start int, end int, text string, style string, heading_level int, label string, in_table boolean, error string"
    types = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, content in enumerate(batch.column("content")):  # one file at a time
                if not content.is_valid:
                    continue
                try:
                    at, rows = 0, []
                    for n, p in enumerate(word_paragraphs(content.as_py())):
                        rows.append((n, at, at + len(p["text"]), p["text"], p["style"], p["heading_level"], p["label"], p["in_table"], None))
                        at += len(p["text"]) + 1
                except (zipfile.BadZipFile, ElementTree.ParseError, TypeError, KeyError, ValueError):
                    rows = [(None,) * 8 + ("damaged",)]
                named = [f.split() for f in fields.split(", ")]
                own = batch.column("doc").take(pa.array([k] * len(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([own, *(pa.array([r[n] for r in rows], types[t]) for n, (_, t) in enumerate(named))], ["doc", *(n for n, _ in named)])

    return contents.select("doc", "content").transform(shipped).mapInArrow(run, f"doc {kind}, {fields}")


# ---- HTML


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.open: list[str] = ["p"]
        self.held: list[str] = []
        self.silent = 0

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.held)).strip()
        if text:
            self.blocks.append((self.open[-1], text))
        self.held = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT_TAGS:
            self.silent += 1
        elif tag in BLOCK_TAGS:
            self.flush()
            self.open.append(tag)
        elif tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT_TAGS:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCK_TAGS:
            self.flush()
            if tag in self.open[1:]:
                while self.open.pop() != tag:
                    pass

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.held.append(data)


def html_blocks(page: str) -> list[tuple[str, str]]:
    """(tag, text) of the text blocks of a page."""
    p = _Blocks()
    p.feed(page)
    p.close()
    p.flush()
    return p.blocks


def html_text(pages: DataFrame) -> DataFrame:
    """(page_id, ord, tag, start, end, text): the blocks of each page and their offsets in the text that joins them by line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, page in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                at = 0
                for k, (tag, text) in enumerate(html_blocks(page or "")):
                    rows.append((page_id, k, tag, at, at + len(text), text))
                    at += len(text) + 1
            types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(types)], ["page_id", "ord", "tag", "start", "end", "text"])

    return pages.select("page_id", "html").transform(shipped).mapInArrow(run, "page_id long, ord int, tag string, start int, end int, text string")


def canonical(paragraphs: DataFrame) -> DataFrame:
    """(doc, ord, start, end, html): offsets of paragraphs (doc, ord, tag, text) in their document's text, one line each, and their
    markup with the offset as an attribute."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = paragraphs.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))
    return rows.select("doc", "ord", "start", "end", F.concat(F.lit("<"), "tag", F.lit(' data-o="'), F.col("start").cast("string"), F.lit('">'), safe, F.lit("</"), "tag", F.lit(">")).alias("html"))


def _escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def _unescaped(text: Column) -> Column:
    for char, name in (("'", "&#39;"), ('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def rendered(paragraphs: DataFrame) -> DataFrame:
    """(doc, ord, start, end, text, html) of paragraphs (doc, ord, tag, label, text): the canonical text and its markup from one model, so that every
    canonical character stands in exactly one span that carries the offset of its first.

    A label that is not a bullet is part of the text, with a blank behind it; bullets are shown but are no text. Paragraphs without either are left out: they
    have no place in the text. A null text is empty, a null label none. The running length is per document, like ``canonical``'s.
    """
    label = F.when((F.col("label") != BULLET) & (F.col("label") != ""), F.concat("label", F.lit(" "))).otherwise("")
    rows = paragraphs.select("doc", "ord", "tag", F.coalesce("text", F.lit("")).alias("body"), F.coalesce(label, F.lit("")).alias("lead"), F.coalesce(F.col("label") == BULLET, F.lit(False)).alias("bullet"))
    rows = rows.where((F.col("lead") != "") | F.col("body").rlike(r"\S"))
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("lead") + F.length("body")
    rows = rows.withColumn("start", F.coalesce(F.sum(size + 1).over(w), F.lit(0)))
    span = lambda at, text, more: F.concat(F.lit(f'<span{more} data-o="'), at.cast("string"), F.lit('">'), _escaped(text), F.lit("</span>"))
    lead = F.when(F.col("bullet"), f'<span aria-hidden="true" class="bullet">{BULLET}</span>').when(F.col("lead") != "", span(F.col("start"), F.col("lead"), ' class="num"')).otherwise("")
    body = F.when(F.col("body") != "", span(F.col("start") + F.length("lead"), F.col("body"), "")).otherwise("")
    html = F.concat(F.lit("<"), "tag", F.when(F.col("bullet"), ' class="bulleted"').otherwise(""), F.lit(">"), lead, body, F.lit("</"), "tag", F.lit(">"))
    return rows.select("doc", "ord", "start", (F.col("start") + size).alias("end"), F.concat("lead", "body").alias("text"), html.alias("html"))


def spans_of(html: DataFrame) -> DataFrame:
    """(doc, ord, start, node, length, shown): the spans with an offset in markup (doc, ord, html), read back from the markup alone, numbered from 0 in each row."""
    pattern = r'<span[^>]* data-o="(\d+)">([^<]*)</span>'
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), 1).alias("at"), F.regexp_extract_all("html", F.lit(pattern), 2).alias("raw"))
    rows = html.select("doc", "ord", F.posexplode(pairs).alias("node", "x")).select("doc", "ord", F.col("x.at").cast("long").alias("start"), "node", _unescaped(F.col("x.raw")).alias("shown"))
    return rows.select("doc", "ord", "start", "node", F.length("shown").alias("length"), "shown")
