"""Token counts by the whole-token shortcut.

Offline, on the driver, every vocabulary string that ends a word is run through the model's merges alone; the set of
those that come out as one token is the proof that a pre-token equal to one of them counts 1. Executors look each
pre-token up in that set and merge only the rest.

Pre-tokens never cross white space, so texts are cut at white space first and each distinct word is worked out once
(a bounded memory of words per Python worker; it changes the cost only). Special strings are single tokens and are
cut out of the raw text before anything else, as the library does by default.

The tokenizer file is read on the driver and broadcast, so executors need no copy; its size is checked.

Defined results: null and empty texts have 0 tokens; rows are counted one by one, repeated or not; other columns of
the input pass by; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from os.path import commonprefix
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shipped
from ._common import texts_of

OVER_LIMIT = 2048
#: Words remembered by each Python worker.
MEMORY_WORDS = 200_000
#: A tokenizer file above this is not broadcast; it is refused.
MAX_FILE_BYTES = 64 << 20


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Spec:
    """What the counter needs of a tokenizer file: specials, pre-token pattern, vocabulary and merges."""

    def __init__(self, source: str):
        told = json.loads(source)
        kinds = [x["type"] for x in told["normalizer"]["normalizers"]]
        split = told["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or told["model"]["type"] != "BPE" or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("only word-level byte BPE files with NFC, white space and lower-case rules are known here")
        self.source = source
        self.specials = [x["content"] for x in told["added_tokens"]]
        self.pattern = split["pattern"]["Regex"]
        self.suffix = told["model"]["end_of_word_suffix"] or ""
        self.vocab = told["model"]["vocab"]
        pairs = (x if isinstance(x, list) else x.split(" ") for x in told["model"]["merges"])
        self.ranks = {tuple(p): k for k, p in enumerate(pairs)}


def merged(letters: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Byte-pair merging: the pair of lowest rank first, all its occurrences from the left."""
    while len(letters) > 1:
        best = min(zip(letters, letters[1:], strict=False), key=lambda p: ranks.get(p, len(ranks)))
        if best not in ranks:
            break
        out, i = [], 0
        while i < len(letters):
            if i + 1 < len(letters) and (letters[i], letters[i + 1]) == best:
                out.append(letters[i] + letters[i + 1])
                i += 2
            else:
                out.append(letters[i])
                i += 1
        letters = out
    return letters


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings, less the word-end mark, that encode alone as one token."""
    spec = Spec(Path(path).read_text())
    proven = set()
    for string in spec.vocab:
        if string.endswith(spec.suffix) and (body := string[: len(string) - len(spec.suffix)]):
            letters = list(body)
            letters[-1] += spec.suffix
            if len(merged(letters, spec.ranks)) == 1:
                proven.add(body)
    return frozenset(proven)


def counter(source: str, whole: frozenset[str]) -> Callable[[str | None], int]:
    """A function from a text to its number of tokens."""
    from tokenizers import Tokenizer

    spec = Spec(source)
    library = Tokenizer.from_str(source)
    model, normalize, split = library.model, library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
    letters = byte_letters()
    table = [letters[b] for b in range(256)]
    pieces = regex.compile(spec.pattern)
    # White space as the tokenizer's own pattern language has it; str.split would also cut at U+001C to U+001F.
    blank = regex.compile(r"[\t-\r\x85\p{Z}]+")
    odd = re.compile("[\x1c-\x1f]")
    special = re.compile("|".join(map(re.escape, sorted(spec.specials, key=len, reverse=True)))) if spec.specials else None
    hint = commonprefix(spec.specials)
    memory: dict[str, int] = {}

    def of_word(word: str) -> int:
        if word.isascii():
            forms = [p if p.isprintable() else "".join([table[b] for b in p.encode()]) for p in pieces.findall(word.lower())]
        else:
            # The library's own tables of letters and cases, which differ from Python's for a few code points.
            forms = [p for p, _ in split(normalize(word))]
        n = sum(1 if form in whole else len(model.tokenize(form)) for form in forms)
        if len(memory) >= MEMORY_WORDS:
            memory.clear()
        memory[word] = n
        return n

    def of_plain(text: str) -> int:
        words = [w for w in blank.split(text) if w] if odd.search(text) else text.split()
        get, n = memory.get, 0
        counts = list(map(get, words))
        if None not in counts:
            return sum(counts)
        for word, c in zip(words, counts, strict=True):
            if c is None:
                c = get(word)
                n += of_word(word) if c is None else c
            else:
                n += c
        return n

    def of_text(text: str | None) -> int:
        if not text:
            return 0
        if special is None or hint not in text or not special.search(text):
            return of_plain(text)
        parts = special.split(text)
        return len(parts) - 1 + sum(map(of_plain, parts))

    return of_text


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, over: int = OVER_LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of whole texts."""
    path = path or default_file()
    if Path(path).stat().st_size > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    source = Path(path).read_text()
    held = docs.sparkSession.sparkContext.broadcast((source, whole_tokens(path)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*held.value)
        for batch in batches:
            n = pa.array([count(x) for x in texts_of(batch, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), n], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    rows = rows.transform(shipped).mapInArrow(counted, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > over)
