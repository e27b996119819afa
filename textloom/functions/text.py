"""Column functions over text, all built in. Offsets and lengths are code points.

The white-space class is spelled out, so that every engine reads it alike; word classes are ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters folded to plain ones.
SINGLE_QUOTES = "‘’‚‛′`´"
DOUBLE_QUOTES = "“”„‟″«»"
DASHES = "‐‑‒–—―−﹘﹣－"
SPACES = "              　"
DROPPED = "­​‌‍⁠﻿"
COMPACT_SYMBOLS = "%$€£¥§"
# Words that carry no search meaning, and words that nearly every part of a contract has.
STOPWORDS = (
    "the a an and or of to in for on by with is are was were be been being this that these those what which who whom whose when where why how does do did can could should would may might must "
    "shall will there their them they it its as at from into about any all each every under over than then also not no nor if but so such"
).split()
CONTRACT_WORDS = "agreement agreements contract contracts party parties clause clauses section sections document hereof herein thereof".split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for each row, also where body puts it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spaced(text: Column) -> Column:
    """Lower case, characters folded, white space collapsed and trimmed. Without compatibility forms (NFKC): see
    ``matching.normalized`` for texts that have them."""
    plain = F.translate(F.lower(text), SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + SPACES + DROPPED, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES) + " " * len(SPACES))
    return F.trim(F.regexp_replace(plain, r"[ \t\n\x0B\f\r]+", " "))


def compact(text: Column) -> Column:
    """Letters, digits and a few symbols only."""
    return F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}{COMPACT_SYMBOLS}]", "")


def dehyphenated(text: Column) -> Column:
    """Words broken by a hyphen at a line's end, joined if they go on in lower case."""
    return F.regexp_replace(text, r"[-­‐‑][ \t\r ]*\n[ \t\r\n ]*(\p{Ll})", "$1")


def precleaned(quote: Column) -> Column:
    """A quote as a model writes it, less page marks, wrapping quotation marks, outer ellipses and asterisks."""
    s = F.trim(F.regexp_replace(quote, r"\r?\n+", " "))
    s = F.regexp_replace(s, r"(?i)\[\s*p(?:age|p)?\.?\s*\d+\s*\]", " ")

    def peeled(s: Column, _: Column) -> Column:
        s = F.trim(F.regexp_replace(F.trim(s), r"^(?:\s*(?:\.\s*){3,}|\s*…)+|(?:(?:\s*\.){3,}\s*|…\s*)+$", ""))
        return F.trim(F.regexp_replace(unquoted(s), r"^\*+|\*+$", ""))

    def unquoted(s: Column) -> Column:
        rest, head = F.substring(s, F.lit(2), F.length(s)), F.substring(s, F.lit(1), F.greatest(F.length(s) - 1, F.lit(0)))
        return (
            F.when(s.rlike("(?s)^[\"“”'‘’«»].*[\"“”'‘’«»]$") & (F.length(s) > 1), F.trim(F.substring(s, F.lit(2), F.length(s) - 2)))
            .when(s.rlike("^[\"“'‘«]") & ~rest.rlike("[\"”'’»]"), F.trim(rest))
            .when(s.rlike("[\"”'’»]$") & ~head.rlike("[\"“'‘«]"), F.trim(head))
            .otherwise(s)
        )

    return F.regexp_replace(F.aggregate(F.sequence(F.lit(1), F.lit(3)), s, peeled), r"\s+", " ")


def numbers(text: Column) -> Column:
    """Numbers in order, thousands separators removed."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)*"), 0), lambda x: F.replace(x, F.lit(","), F.lit("")))


def search_terms(question: Column, limit: int = 12) -> Column:
    """Distinct content words of three letters or more; generic contract words only if there is nothing else."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit("[a-z0-9]{3,}"), 0))
    words = F.array_except(words, F.array(*map(F.lit, STOPWORDS)))
    specific = F.array_except(words, F.array(*map(F.lit, CONTRACT_WORDS)))
    return F.slice(F.when(F.size(specific) > 0, specific).otherwise(words), 1, limit)


def or_query(question: Column) -> Column:
    terms = search_terms(question)
    return F.when(F.size(terms) > 0, F.array_join(terms, " | "))


def phrases(question: Column, limit: int = 5) -> Column:
    """Quoted phrases, then runs of capitalised words."""
    quoted = F.transform(F.regexp_extract_all(question, F.lit("[\"“']([^\"”']{3,60})[\"”']"), 1), lambda x: F.trim(x))
    named = F.regexp_extract_all(question, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"), 1)
    return F.slice(F.array_distinct(F.concat(quoted, named)), 1, limit)


def section_refs(question: Column) -> Column:
    return F.regexp_extract_all(question, F.lit(r"(?i)(?:clause|section|article|§)\s*(\d{1,3}(?:\.\d{1,3}){0,3})"), 1)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def clean_filename(name: Column) -> Column:
    base = F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1)
    return F.substring(F.trim(F.regexp_replace(base, r"[\x00-\x1F\x7F]", "")), 1, 200)


def location_label(number: Column, title: Column, page_start: Column, page_end: Column) -> Column:
    """§12.3 Title · p. 4–5, as far as each is known."""
    section = F.when(number.isNotNull(), F.concat_ws(" ", F.concat(F.lit("§"), number), title)).otherwise(title)
    pages = F.when(page_start == page_end, F.concat(F.lit("p. "), page_start.cast("string"))).when(page_start.isNotNull(), F.concat(F.lit("p. "), F.concat_ws("–", page_start.cast("string"), page_end.cast("string"))))
    return F.concat_ws(" · ", section, pages)


def word_shingles(spaced_text: Column, k: int = 3) -> Column:
    """Distinct k-word shingles of a spaced text; a shorter text is one shingle."""

    def runs(words: Column) -> Column:
        n = F.size(words)
        every = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(every))

    return let(F.filter(F.split(spaced_text, " "), lambda w: w != ""), runs)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def title_similarity(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / longest)
