"""Structure of documents: furniture, headings, section trees, chunks, clause tags.

Lines are rows (doc, ord, start, end, text); sections rows (doc, ord, number, title, level, parent, start, end). Rules that look
at one line are expressions; rules that depend on the lines before fold over a document's sorted headings, which are
few, in one array expression. Chunk packing walks a whole text and runs in an Arrow function, a document at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shipped

# Fixed values of the rules.
BAND, SHARE, LEAST_PAGES = 0.08, 0.4, 3
CHUNK_TOKENS, OVERLAP_TOKENS, PART_CHARS = 700, 60, 2000
ABBREVIATIONS = ("No.", "Sec.", "Art.", "Inc.", "Ltd.", "Co.", "e.g.", "i.e.", "U.S.", "Corp.", "cl.", "para.", "Pty.", "L.L.C.", "vs.", "etc.")
SMALL_WORDS = ("of", "and", "or", "the", "to", "in", "for", "a", "an", "on", "by", "with")
ARTICLE = r"^(ARTICLE|Article)\s+([IVXLC]+|\d+)\b[.:\s-]*(.*)$"
SECTION = r"^(SECTION|Section|Clause|CLAUSE)\s+(\d+(?:\.\d+)*)\b[.:\s-]*(.*)$"
SCHEDULE = r"^(SCHEDULE|Schedule|EXHIBIT|Exhibit|ANNEX|Annex|APPENDIX|Appendix)\s+([A-Z0-9]+)\b(.*)$"
NUMBERED = r"^(\d{1,3}(?:\.\d{1,3}){0,3})\.?\s+([A-Z“\"‘'(][^\n]{0,160})$"
SUB_ITEM = r"(?i)^\(?([a-z]{1,3}|[ivxlc]{1,6}|\d{1,2})\)"
TOC_LINE = r"(\.{3,}|…{2,}|\s\.\s\.\s\.)\s*\d+\s*$"
PAGE_NUMBER = r"(?i)^\s*(page\s*)?#(\s*(of|/)\s*#)?\s*$"
DASHED_NUMBER = r"^\s*[-–—]\s*#\s*[-–—]\s*$"
#: The standard clauses by a section's title, and by the first 200 characters of one whose title says nothing; Java patterns, case does
#: not count.
CLAUSE_TITLES = [
    ("term_and_renewal", r"\b(term of (the )?agreement|duration|renewal|renew|commencement and term|^term\b|initial term)"),
    ("termination", r"terminat|\bexpiry\b|\bexpiration\b"),
    ("payment", r"\b(payment|fees?|charges|invoic|price|pricing|remuneration|compensation)\b"),
    ("limitation_of_liability", r"limitation of liability|limits? (of|on) liability|liabilit(y|ies)\b|exclusion of (certain )?damages|consequential"),
    ("indemnification", r"indemn"),
    ("confidentiality", r"confidential|non-?disclosure"),
    ("intellectual_property", r"intellectual property|\bip rights\b|ownership of (work|deliverables)|licen[cs]e|proprietary rights"),
    ("warranties", r"warrant|representations"),
    ("governing_law", r"governing law|applicable law|choice of law"),
    ("dispute_resolution", r"dispute|arbitrat|jurisdiction|mediation|litigation"),
    ("assignment", r"\bassign(ment)?\b|subcontract|change of control"),
    ("force_majeure", r"force majeure|acts? of god"),
    ("notices", r"\bnotices?\b"),
    ("non_compete_non_solicit", r"non-?compet|non-?solicit|restrictive covenant|exclusivity"),
    ("data_protection", r"data protection|personal data|privacy|gdpr|data processing"),
    ("entire_agreement", r"entire agreement|whole agreement|integration clause"),
]
CLAUSE_BODIES = [
    ("limitation_of_liability", r"(aggregate|total) liability|shall not be liable"),
    ("indemnification", r"indemnif"),
    ("confidentiality", r"confidential information"),
    ("governing_law", r"governed by (and construed in accordance with )?the laws? of"),
    ("force_majeure", r"force majeure"),
    ("non_compete_non_solicit", r"non-?compet|shall not (directly or indirectly )?(solicit|compete)"),
    ("data_protection", r"personal data|data protection"),
    ("termination", r"may terminate"),
    ("entire_agreement", r"entire agreement"),
]
LEAST_HEADINGS, LEAST_NUMBERED, LEAST_UNNUMBERED = 3, 2, 5
ROMAN_NUMBER = r"(?i)^\s*(?=[ivxlcdm])m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})\s*$"


# ---- pages and furniture


def unreadable(text: Column, has_image: Column) -> Column:
    """A page whose letters are mostly something else, or that shows little but an image."""
    solid = F.length(F.regexp_replace(text, r"\s+", ""))
    words, odd = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")), F.regexp_count(text, F.lit(r"[\x{FFFD}\x{E000}-\x{F8FF}\x00-\x08\x0E-\x1F]"))
    garbled = (solid > 0) & ((words / solid < 0.5) | (odd / solid > 0.2))
    return garbled | ((solid < 20) & has_image)


def without_text(pages: DataFrame) -> DataFrame:
    """Documents all of whose pages are unreadable, or whose readable pages hold under 50 characters: (doc)."""
    solid = F.sum(F.when(~F.col("bad"), F.length(F.regexp_replace("text", r"\s+", ""))).otherwise(0))
    return pages.groupBy("doc").agg(F.bool_and("bad").alias("all_bad"), solid.alias("solid")).where("all_bad or solid < 50").select("doc")


def furniture_form(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+", "#"), r"\s+", " "))


def furniture(lines: DataFrame, band: float = BAND, share: float = SHARE) -> DataFrame:
    """Lines (doc, page_no, start, end, top, bottom, text) that are running heads, feet or page numbers: those in the outer
    bands that recur on enough distinct pages, or look like a page number."""
    pages = lines.groupBy("doc").agg(F.count_distinct("page_no").alias("n_pages"))
    outer = lines.where((F.col("top") <= band) | (F.col("bottom") >= 1 - band)).withColumn("form", furniture_form(F.col("text")))
    seen = outer.where("form <> ''").groupBy("doc", "form").agg(F.count_distinct("page_no").alias("n_on"))
    rows = outer.join(seen, ["doc", "form"], "left").join(pages, "doc")
    needed = F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("n_pages") * share))
    repeated = (F.col("n_pages") >= LEAST_PAGES) & (F.coalesce("n_on", F.lit(0)) >= needed)
    numbered = F.col("form").rlike(PAGE_NUMBER) | F.col("form").rlike(DASHED_NUMBER) | F.col("form").rlike(ROMAN_NUMBER)
    return rows.where(repeated | numbered).select("doc", "page_no", "start", "end")


# ---- headings


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def title_case(text: Column) -> Column:
    small = F.array(*map(F.lit, SMALL_WORDS))
    return F.array_join(F.transform(_words(F.lower(text)), lambda w, i: F.when((i > 0) & F.array_contains(small, w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))), " ")


def title_from(text: Column) -> Column:
    """The first sentence's first ten words, less closing punctuation; all capitals become title case."""
    first = F.when(text.rlike("(?i)^.*?[a-z0-9)\\]”\"]\\.(\\s|$)"), F.regexp_extract(text, "(?i)^(.*?[a-z0-9)\\]”\"])\\.(?:\\s|$)", 1)).otherwise(text)
    short = F.trim(F.regexp_replace(F.array_join(F.slice(_words(first), 1, 10), " "), r"[\s.:;,–—-]+$", ""))
    letters = F.regexp_replace(short, r"[^\p{L}]", "")
    return F.when((F.length(letters) >= 4) & (letters == F.upper(letters)), title_case(short)).otherwise(short)


def all_caps(text: Column) -> Column:
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    return (F.size(_words(text)).between(1, 10)) & ~F.trim(text).rlike("[.;,]$") & (F.length(letters) >= 4) & (letters == F.upper(letters)) & (F.length(letters) / solid >= 0.7)


def _level(number: Column) -> Column:
    return F.size(F.split(number, r"\."))


def headings(lines: DataFrame) -> DataFrame:
    """Lines that read as headings, with kind, number, title and level; the first rule that fits counts."""
    t = F.trim("text")
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    named = lambda title, kind, number: F.when(title != "", title).otherwise(F.concat(F.lit(f"{kind} "), number))
    schedule = F.concat_ws(" ", F.initcap(part(SCHEDULE, 1)), part(SCHEDULE, 2))
    tail = F.trim(part(SCHEDULE, 3))
    kind = F.when(t.rlike(ARTICLE), "article").when(t.rlike(SECTION), "section").when(t.rlike(SCHEDULE), "schedule").when(t.rlike(NUMBERED), "numbered").when(all_caps(t), "caps")
    rows = lines.where((t != "") & (F.length(t) <= 200) & ~t.rlike(SUB_ITEM)).withColumn("kind", kind).where("kind is not null")
    k = F.col("kind")
    number = F.when(k == "article", part(ARTICLE, 2)).when(k == "section", part(SECTION, 2)).when(k == "schedule", schedule).when(k == "numbered", part(NUMBERED, 1))
    title = (
        F.when(k == "article", named(title_from(part(ARTICLE, 3)), "Article", part(ARTICLE, 2)))
        .when(k == "section", named(title_from(part(SECTION, 3)), "Section", part(SECTION, 2)))
        .when(k == "schedule", F.when(tail != "", F.concat_ws(" ", schedule, title_from(F.regexp_replace(part(SCHEDULE, 3), r"^[\s:.–—-]+", "")))).otherwise(schedule))
        .when(k == "numbered", title_from(part(NUMBERED, 2)))
        .otherwise(title_case(t))
    )
    level = F.when(k == "section", _level(part(SECTION, 2))).when(k == "numbered", _level(part(NUMBERED, 1))).otherwise(1)
    return rows.select(*lines.columns, "kind", number.alias("number"), title.alias("title"), level.cast("int").alias("level"))


def word_headings(paragraphs: DataFrame) -> DataFrame:
    """Headings of Word paragraphs (doc, ord, start, end, text, heading_level, label, bold_lead, in_table): automatically numbered
    ones (sub-items in brackets or letters are none), those of a heading style, and short or bold ones that read as headings."""
    label = F.trim("label")
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(label, r"(?i)^(article|section|clause|schedule|exhibit|annex|appendix)\s+", ""), r"[.):\s]+$", ""), r"^\(", ""))
    sub = label.rlike(r"(?i)^\(?[a-z]{1,3}\)$|^\(?[ivxlc]{1,6}\)$|^\(")
    t = F.trim("text")
    body = F.when(F.col("label").isNotNull() & t.startswith(F.col("label")), F.trim(F.expr("substring(trim(text), length(label) + 1)"))).otherwise(t)
    own = paragraphs.where((t != "") & ~F.col("in_table"))
    lead = title_from(F.trim(F.replace("bold_lead", F.col("label"), F.lit(""))))
    title = F.when(F.col("bold_lead").isNotNull() & (lead != ""), lead).otherwise(title_from(body))
    level = F.when(bare.rlike(r"^\d+(\.\d+)*$"), _level(bare)).otherwise(F.coalesce("heading_level", F.lit(1)))
    names = [c for c in paragraphs.columns if c in ("doc", "ord", "start", "end", "text")]
    numbered = own.where(F.col("label").isNotNull() & ~sub).select(*names, F.lit("word").alias("kind"), F.nullif(bare, F.lit("")).alias("number"), F.when(title != "", title).otherwise(bare).alias("title"), level.cast("int").alias("level"))
    rest = own.where(F.col("label").isNull())
    plain = headings(rest)
    short = F.size(_words(F.col("text"))) <= 15
    styled = plain.where(F.col("heading_level").isNotNull()).withColumn("level", F.col("heading_level").cast("int"))
    free = plain.where(F.col("heading_level").isNull() & ((F.col("kind") == "caps") | short | F.col("bold_lead").isNotNull()))
    other = rest.where(F.col("heading_level").isNotNull()).join(plain.select("doc", "ord"), ["doc", "ord"], "left_anti")
    first = title_from(F.trim("text"))
    other = other.select(*names, F.lit("word").alias("kind"), F.lit(None).cast("string").alias("number"), F.when(first != "", first).otherwise(F.substring(F.trim("text"), 1, 80)).alias("title"), F.col("heading_level").cast("int").alias("level"))
    columns = [*names, "kind", "number", "title", "level"]
    return numbered.unionByName(styled.select(*columns)).unionByName(free.select(*columns)).unionByName(other)


def without_contents(heads: DataFrame) -> DataFrame:
    """Headings less a table of contents: lines with dot leaders go; if three headings or more recur, only the last of each
    stays."""
    key = F.concat_ws("|", F.coalesce("number", F.lit("")), F.trim(F.regexp_replace(F.regexp_replace(F.lower("title"), r"\s*\d+\s*$", ""), "[^a-z0-9]+", " ")))
    rows = heads.where(~F.col("text").rlike(TOC_LINE)).withColumn("_key", key)
    same = Window.partitionBy("doc", "_key")
    rows = rows.withColumn("_n", F.count("*").over(same)).withColumn("_back", F.row_number().over(same.orderBy(F.col("ord").desc())))
    rows = rows.withColumn("_recur", F.sum(F.when((F.col("_n") > 1) & (F.col("_back") == 1), 1).otherwise(0)).over(Window.partitionBy("doc")))
    return rows.where("_recur < 3 or _back = 1").drop("_key", "_n", "_back", "_recur")


def roman_value(numeral: Column) -> Column:
    """Value of a numeral of the letters I, V, X, L and C."""
    digits = F.transform(F.split(numeral, ""), lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).otherwise(0))
    signed = F.transform(digits, lambda v, i: F.when(v < F.coalesce(F.get(digits, i + 1), F.lit(0)), -v).otherwise(v))
    return F.aggregate(signed, F.lit(0), lambda a, v: a + v)


def in_sequence(heads: DataFrame) -> DataFrame:
    """Headings whose numbers go on from those accepted before: top numbers step by one or two (deeper ones may also stay), begin
    at three at most, never recur; a schedule starts anew; capitals are always accepted."""
    rest = [c for c in heads.columns if c not in ("doc", "ord")]
    top = F.when((F.col("kind") == "article") & F.col("number").rlike("^[IVXLC]+$"), roman_value(F.col("number"))).otherwise(F.expr("try_cast(split(number, '[.]')[0] as int)"))
    rows = heads.withColumn("_top", F.when(F.col("kind").isin("article", "section", "numbered"), top)).withColumn("_flat", (F.col("kind") == "article") | ~F.contains("number", F.lit(".")))
    rows = rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("ord", "_top", "_flat", *rest))).alias("h"))
    fold = """
        aggregate(h, named_struct('last', cast(null as int), 'seen', cast(array() as array<string>), 'kept', cast(array() as array<int>)), (a, x) -> case
            when x.kind = 'caps' then named_struct('last', a.last, 'seen', a.seen, 'kept', array_append(a.kept, cast(x.ord as int)))
            when x.kind = 'schedule' then named_struct('last', cast(null as int), 'seen', cast(array() as array<string>), 'kept', array_append(a.kept, cast(x.ord as int)))
            when x._top is not null and not array_contains(a.seen, x.number) and case
                    when a.last is null then x._top <= 3
                    when x._flat then x._top between a.last + 1 and a.last + 2
                    else x._top between a.last and a.last + 2 end
                then named_struct('last', x._top, 'seen', array_append(a.seen, x.number), 'kept', array_append(a.kept, cast(x.ord as int)))
            else a end, a -> a.kept)
    """
    rows = rows.select("doc", "h", F.expr(fold).alias("kept")).select("doc", F.explode(F.expr("filter(h, x -> array_contains(kept, cast(x.ord as int)))")).alias("x"))
    return rows.select("doc", "x.ord", *[f"x.{c}" for c in rest])


def section_tree(heads: DataFrame, lengths: DataFrame) -> DataFrame:
    """Sections from headings (doc, start, number, title, level) and texts' lengths (doc, n): the parent is the nearest before of a
    smaller level, the end is where the next of the same or a smaller level starts."""
    item = F.struct("start", F.greatest(F.lit(1), F.least("level", F.lit(6))).alias("level"), "number", "title")
    rows = heads.groupBy("doc").agg(F.sort_array(F.collect_list(item)).alias("h")).join(lengths, "doc")
    parent = "array_max(filter(sequence(0, size(h) - 1), j -> j < i and h[j].level < x.level))"
    after = "array_min(transform(filter(sequence(0, size(h) - 1), j -> j > i and h[j].level <= x.level), j -> h[j].start))"
    rows = rows.select("doc", F.explode(F.expr(f"transform(h, (x, i) -> named_struct('ord', i, 'number', x.number, 'title', x.title, 'level', x.level, 'parent', {parent}, 'start', x.start, 'end', coalesce({after}, n)))")).alias("s"))
    return rows.select("doc", "s.*")


def fallback_parts(lines: DataFrame, lengths: DataFrame, size: int = PART_CHARS) -> DataFrame:
    """Parts of about ``size`` characters that start at line starts, for documents without headings: (doc, ord, title, start, end)."""
    rows = lines.groupBy("doc").agg(F.sort_array(F.collect_list("start")).alias("at")).join(lengths, "doc")
    cuts = f"aggregate(at, cast(array(0) as array<int>), (a, x) -> if(x - element_at(a, -1) >= {size}, array_append(a, cast(x as int)), a))"
    rows = rows.where("n > 0").select("doc", "n", F.expr(cuts).alias("cuts"))
    rows = rows.select("doc", "n", "cuts", F.posexplode("cuts").alias("ord", "start"))
    return rows.select("doc", "ord", F.concat(F.lit("Part "), F.col("ord") + 1).alias("title"), "start", F.coalesce(F.get("cuts", F.col("ord") + 1), "n").alias("end"))


def fallback_pages(pages: DataFrame) -> DataFrame:
    """A part for each page that has text, for documents without headings that have pages (doc, page_no, start, end)."""
    rows = pages.where("end > start")
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page_no")) - 1
    return rows.select("doc", place.alias("ord"), F.concat(F.lit("Page "), F.col("page_no")).alias("title"), "start", "end")


def detected_sections(heads: DataFrame, texts: DataFrame, lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc, ord, number, title, level, parent, start, end, structured): the sections of every text (doc, text) that is not empty.

    heads are its headings, in sequence and without a table of contents. Fewer than three, or, where pages are known,
    fewer than two with a number and five in all, are no structure: then pages, or else parts of lines, are the sections. Where text stands before the first
    heading, a section Preamble comes first, so sections cover the text.
    """
    texts = texts.where("text is not null and text <> ''").select("doc", "text", F.length("text").alias("n"))
    few = (F.col("heads") < LEAST_HEADINGS) | (F.lit(pages is not None) & (F.col("numbered") < LEAST_NUMBERED) & (F.col("heads") < LEAST_UNNUMBERED))
    told = heads.groupBy("doc").agg(F.count("*").alias("heads"), F.count("number").alias("numbered"), F.min("start").alias("first"))
    told = texts.join(told, "doc", "left").select("doc", "n", "first", (~F.coalesce(few, F.lit(True))).alias("structured"), F.expr("trim(BOTH ' \t\n\r' FROM substring(text, 1, coalesce(first, 0))) <> ''").alias("leads"))
    kept = heads.join(told.where("structured").select("doc"), "doc", "left_semi").select("doc", F.col("start").cast("long").alias("start"), "number", "title", F.col("level").cast("int").alias("level"))
    lead = told.where("structured and leads").select("doc", F.lit(0).cast("long").alias("start"), F.lit(None).cast("string").alias("number"), F.lit("Preamble").alias("title"), F.lit(1).alias("level"))
    tree = section_tree(kept.unionByName(lead), told.select("doc", F.col("n").cast("long").alias("n")))
    rest = told.where("not structured").select("doc", "n")
    parts = fallback_parts(lines.join(rest.select("doc"), "doc", "left_semi"), rest) if pages is None else fallback_pages(pages.join(rest.select("doc"), "doc", "left_semi"))
    names = ["doc", "ord", "number", "title", "level", "parent", "start", "end"]
    parts = parts.select("doc", "ord", F.lit(None).cast("string").alias("number"), "title", F.lit(1).alias("level"), F.lit(None).cast("int").alias("parent"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return tree.select(*names).withColumn("structured", F.lit(True)).unionByName(parts.select(*names).withColumn("structured", F.lit(False)))


def analyzed(docs: DataFrame, lines: DataFrame, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Everything the other operators need of texts: sections, chunks, clauses, and a row for each document.

    docs (doc, text, furniture array<struct<start, end>>), lines (doc, ord, start, end, text) without furniture, pages (doc, page_no, start, end, text, has_image) or
    None. The rows of documents: (doc, structured, n_sections, n_chunks, n_clauses, tokens, unreadable array of page numbers, warnings array<string>); a text
    that is empty has neither sections nor chunks.
    """
    bad = None if pages is None else pages.where(unreadable(F.col("text"), F.col("has_image"))).select("doc", "page_no", "start", "end")
    if bad is not None:
        from . import ranges as R

        lines = lines.join(R.overlap_join(lines.select("doc", "ord", "start", "end"), bad.select("doc", "page_no", "start", "end")).select("doc", "ord").distinct(), ["doc", "ord"], "left_anti")
    heads = in_sequence(without_contents(headings(lines)))
    sections = detected_sections(heads, docs, lines, None if pages is None else pages.select("doc", "page_no", "start", "end"))
    parts = chunks(docs, sections)
    clauses = clause_tags(sections, docs.select("doc", "text"), CLAUSE_TITLES, CLAUSE_BODIES)
    clauses = clauses.join(sections.select("doc", "ord", "start", "end"), ["doc", "ord"])
    hidden = F.aggregate(F.coalesce("furniture", F.array().cast("array<struct<start:int,end:int>>")), F.lit(0), lambda a, r: a + r["end"] - r["start"])
    told = docs.select("doc", F.ceil((F.length(F.coalesce("text", F.lit(""))) - hidden) / 4).alias("tokens"))
    counts = sections.groupBy("doc").agg(F.bool_and("structured").alias("structured"), F.count("*").alias("n_sections"))
    told = told.join(counts, "doc", "left").join(parts.groupBy("doc").agg(F.count("*").alias("n_chunks")), "doc", "left").join(clauses.groupBy("doc").agg(F.count("*").alias("n_clauses")), "doc", "left")
    none = F.array().cast("array<int>")
    if bad is None:
        told = told.withColumn("unreadable", none)
    else:
        told = told.join(bad.groupBy("doc").agg(F.sort_array(F.collect_list(F.col("page_no").cast("int"))).alias("unreadable")), "doc", "left")
    told = told.select("doc", F.coalesce("structured", F.lit(False)).alias("structured"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sections", "n_chunks", "n_clauses")), "tokens", F.coalesce("unreadable", none).alias("unreadable"))
    warnings = F.filter(F.array(F.when(F.size("unreadable") > 0, "partial_scan"), F.when(~F.col("structured"), "no_structure_detected")), lambda w: w.isNotNull())
    return sections, parts, clauses, told.withColumn("warnings", warnings)


def clauses_of(clauses: DataFrame, type_: str | None = None, most: int = 40) -> DataFrame:
    """(doc, place, type, ord, start, end): the clauses of a document in text order, of one type or all; a list shows ``most``."""
    rows = clauses if type_ is None else clauses.where(F.col("type") == type_)
    place = F.row_number().over(Window.partitionBy("doc").orderBy("start", "ord", "type"))
    return rows.select("doc", place.alias("place"), "type", "ord", "start", "end").where(F.col("place") <= most)


def clause_tags(sections: DataFrame, texts: DataFrame, title_rules: list[tuple[str, str]], body_rules: list[tuple[str, str]]) -> DataFrame:
    """(doc, ord, type, confidence): every title rule that fits, at 0.8; where none does and the section has a number, every
    body rule that fits its first 200 characters, at 0.4. Rules are (type, Java pattern)."""
    fits = lambda rules, c: F.filter(F.array(*[F.when(c.rlike(f"(?i){p}"), F.lit(t)) for t, p in rules]), lambda x: x.isNotNull())
    rows = sections.where(~F.col("title").rlike(r"^(Preamble|Page \d+|Part \d+)$")).join(texts, "doc")
    body = F.substring("text", F.col("start") + 1, F.least(F.col("end") - F.col("start"), F.lit(200)))
    rows = rows.withColumn("by_title", fits(title_rules, F.col("title"))).withColumn("by_body", F.when((F.size("by_title") == 0) & F.col("number").isNotNull(), fits(body_rules, body)).otherwise(F.array().cast("array<string>")))
    tag = lambda c, v: F.transform(c, lambda t: F.struct(t.alias("type"), F.lit(v).alias("confidence")))
    return rows.select("doc", "ord", F.explode(F.concat(tag("by_title", 0.8), tag("by_body", 0.4))).alias("t")).select("doc", "ord", "t.type", "t.confidence")


# ---- chunks

_SENTENCE = regex.compile(r"[.!?]+[\"”'’)\]]*\s+")


def estimate(text: str) -> int:
    return -(-len(text) // 4)


def sentence_starts(text: str, lo: int, hi: int) -> list[int]:
    """Where sentences start inside (lo, hi); the stop of a known abbreviation ends none."""
    return [m.end() for m in _SENTENCE.finditer(text, lo, hi) if m.end() < hi and not text[max(lo, m.end() - 8) : m.end()].rstrip().endswith(ABBREVIATIONS)]


def packed(lo: int, hi: int, cuts: list[int], most: int) -> list[tuple[int, int]]:
    """The range cut at as few of the given places as keep each piece within ``most`` tokens where that can be."""
    out, room = [], most * 4
    while hi - lo > room:
        k = bisect_right(cuts, lo + room) - 1
        if k < 0 or cuts[k] <= lo:
            # No cut in reach: up to the next one.
            k = bisect_right(cuts, lo)
            if k >= len(cuts):
                break
        out.append((lo, cuts[k]))
        lo = cuts[k]
    return [*out, (lo, hi)] if lo < hi else out


def pieces(text: str, lo: int, hi: int, most: int) -> list[tuple[int, int]]:
    """Cut at line starts, then at sentence starts, then anywhere."""
    out = []
    for a, b in packed(lo, hi, [m.end() for m in re.compile("\n").finditer(text, lo, hi) if m.end() < hi], most):
        for c, d in [(a, b)] if b - a <= most * 4 else packed(a, b, sentence_starts(text, a, b), most):
            out += [(x, min(d, x + most * 4)) for x in range(c, d, most * 4)]
    return out


def _visible(text: str, lo: int, hi: int, skip: list[tuple[int, int]]) -> str:
    out, at = [], lo
    for s, e in skip:
        if e > at and s < hi:
            out += [text[at : max(at, s)], " "]
            at = min(hi, max(at, e))
    return "".join([*out, text[at:hi]])


def chunk_ranges(text: str, sections: list[dict], skip: list[tuple[int, int]], most: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, int, int]]:
    """(section ord, start, end): bodies of sections under one top section packed together up to ``most`` tokens; a longer
    body alone, cut, each piece after the first starting some words back. Chunks never span two top sections."""
    parent = {s["ord"]: s["parent"] for s in sections}

    def top(o: int) -> int:
        while parent.get(o) is not None:
            o = parent[o]
        return o

    out: list[tuple[int, int, int]] = []
    held: list[int] | None = None  # top, section, start, end, tokens
    ends = [*(s["start"] for s in sections[1:]), len(text)]
    for s, end in zip(sections, ends, strict=True):
        body = _visible(text, s["start"], end, skip) if end > s["start"] else ""
        if not body.strip():
            continue
        n = estimate(body)
        if held and n <= most and held[0] == top(s["ord"]) and held[4] + n <= most:
            held[3], held[4] = end, held[4] + n
            continue
        if held:
            out.append((held[1], held[2], held[3]))
            held = None
        if n <= most:
            held = [top(s["ord"]), s["ord"], s["start"], end, n]
            continue
        for k, (a, b) in enumerate(pieces(text, s["start"], end, most - overlap)):
            if k:
                back = max(s["start"], a - overlap * 4)
                while s["start"] < back < a and not text[back - 1].isspace():
                    back += 1
                a = back
            out.append((s["ord"], a, b))
    return [*out, (held[1], held[2], held[3])] if held else out


def chunks(docs: DataFrame, sections: DataFrame, *, most: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """(doc, ord, section_ord, start, end, text, search_text, tokens) from docs (doc, text, furniture) and their sections."""
    item = F.struct("start", "ord", "parent", "number", "title")
    rows = docs.join(sections.groupBy("doc").agg(F.sort_array(F.collect_list(item)).alias("sections")), "doc")
    out = "doc long, ord int, section_ord int, start int, end int, text string, search_text string, tokens int"
    names = [c.split()[0] for c in out.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, furniture, parts in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "furniture", "sections")), strict=True):
                skip = sorted((r["start"], r["end"]) for r in furniture or ())
                label = {s["ord"]: f"§{s['number']} {s['title']}".rstrip() if s["number"] else s["title"] for s in parts}
                found = []
                for k, (section, lo, hi) in enumerate(chunk_ranges(text or "", parts, skip, most, overlap)):
                    body = _visible(text, lo, hi, skip).strip()
                    found.append((doc, k, section, lo, hi, body, f"{label[section]} — {body}", estimate(body)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names)

    return rows.select(F.col("doc").cast("long").alias("doc"), "text", "furniture", "sections").transform(shipped).mapInArrow(run, out)


def windows(chunk_rows: DataFrame, lengths: DataFrame, size: int) -> DataFrame:
    """(doc, index, start, end, first, last): runs of chunks of up to ``size`` tokens, each starting with the last chunk of the
    one before; the first starts at 0, the last ends at the text's end."""
    rows = chunk_rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("ord", "start", "end", "tokens"))).alias("c")).join(lengths, "doc")
    # Greedy: j is the chunk after the window's last; the next window starts at max(i + 1, j - 1).
    fold = f"""
        aggregate(sequence(0, size(c) - 1), named_struct('i', 0, 'used', 0L, 'out', cast(array() as array<struct<i:int,j:int>>)), (a, k) -> if(
            k > a.i and a.used + c[k].tokens > {size},
            named_struct(
                'i', greatest(a.i + 1, k - 1),
                'used', if(greatest(a.i + 1, k - 1) = k, cast(c[k].tokens as bigint), cast(c[k - 1].tokens + c[k].tokens as bigint)),
                'out', array_append(a.out, named_struct('i', a.i, 'j', k))),
            named_struct('i', a.i, 'used', a.used + c[k].tokens, 'out', a.out)),
            a -> array_append(a.out, named_struct('i', a.i, 'j', size(c))))
    """
    rows = rows.select("doc", "n", "c", F.posexplode(F.expr(fold)).alias("index", "w"))
    return rows.select("doc", "index", F.expr("if(w.i = 0, 0, c[w.i].start)").alias("start"), F.expr("if(w.j >= size(c), n, c[w.j - 1].end)").alias("end"), F.expr("w.i").alias("first"), F.expr("w.j - 1").alias("last"))
