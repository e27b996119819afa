"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased words with ASCII punctuation taken for blanks; in scripts that set no blanks between words each character is a
token, so a text reads the same with and without blanks. A seed hashes the tokens of a window at the
positions that a fixed mask keeps, so a substitution at an ignored position leaves it intact. Seeds of the benchmark
and of the documents are joined; around each hit the item is laid against the document on the hit's diagonal, and the
two overlap if some stretch of ``STRETCH`` item tokens (the whole item if it is shorter) agrees in at least ``AGREE`` percent of
its positions.

The masks are lossless: for each length of a stretch, ``MASKS`` has so many that whatever positions the rule lets differ, some
mask fits between them. So every overlap has a seed, and items of all lengths and scripts go by the same rule and the same join.

A benchmark of up to ``BLOCK_BYTES`` of text is broadcast, and documents are not shuffled. A larger one is never held
in one place: its seeds are written as a table, the documents' seeds that may be among them (by a bit map of bounded size)
are shuffled to meet them, and the pairs found are verified in portions of ``PORTION`` items for each text. Both ways give the same rows.

Defined results: null and empty texts on either side match nothing; items with a null id are looked for like others; repeated rows give repeated
results on the document's side and one on the item's; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shipped
from ._common import marked_by_ids, scratch_table, texts_kept, texts_of

STRETCH, AGREE = 12, 80
#: Fixed masks by length of the stretch; 1 keeps a position. A length of up to four tokens has to agree whole.
MASKS = {
    5: ("111", "1101"),
    6: ("1111", "11011"),
    7: ("11011",),
    8: ("111011", "11111"),
    9: ("1111011", "1101111"),
    10: ("111011", "11010011", "11111"),
    11: ("1101011", "1110011"),
    12: ("11101011", "101100111", "111111"),
}
#: Code points of scripts that set no blanks between words, first and last: Thai and Lao, Myanmar, Khmer, kana, Han.
UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_UNSPACED = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED) + "]")
BLOCK_BYTES = 8 << 20
PORTION = 64
#: Words remembered by each worker; this changes the cost only.
MEMORY_WORDS = 200_000
_BLANK = bytes(b if not (b < 128 and not chr(b).isalnum()) else 32 for b in range(256))
_TABLE_BITS = 22
#: Bits of the map that documents' seeds are looked up in when seeds are joined: 4 MB, whatever the input.
_MAP_BITS = 25
_SEEDS = np.random.default_rng(3).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)

Item = tuple[int | None, str]


def tokens(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.encode("utf-8", "surrogatepass").translate(_BLANK).split()


def numbered(word: bytes) -> int:
    """A token's number; 0 is kept for tokens that no item has."""
    return xxhash.xxh3_64_intdigest(word) | 1


def least_agreeing(width: int) -> int:
    return -(-AGREE * width // 100)


def masks_of(n: int) -> tuple[str, ...]:
    """The masks that items of n tokens are seeded with."""
    return ("1" * n,) if n < 5 else MASKS[min(n, STRETCH)]


ALL_MASKS = tuple(dict.fromkeys(m for n in range(1, STRETCH + 1) for m in masks_of(n)))


def hashed(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed at every position."""
    n = len(words) - len(mask) + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, _SEEDS[63 - ALL_MASKS.index(mask)])
    for k, c in enumerate(mask):
        if c == "1":
            h += words[k : k + n] * _SEEDS[k]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def agreeing(item: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[int, int, int] | None:
    """(matched tokens, best stretch, first token) of the best of the diagonals ``at`` on which the item overlaps."""
    n, best = len(item), None
    width = min(STRETCH, n)
    for lo in range(0, len(at), max(1, (1 << 20) // n)):
        part = at[lo : lo + max(1, (1 << 20) // n)]
        places = part[:, None] + np.arange(n)
        inside = (places >= 0) & (places < len(words))
        same = (words[np.clip(places, 0, len(words) - 1)] == item) & inside
        sums = np.zeros((len(part), n + 1), np.int64)
        np.cumsum(same, axis=1, out=sums[:, 1:])
        stretch = (sums[:, width:] - sums[:, :-width]).max(axis=1)
        for k in np.flatnonzero(stretch >= least_agreeing(width)):
            found = (int(sums[k, n]), int(stretch[k]), -int(part[k]))
            best = found if best is None else max(best, found)
    return best and (best[0], best[1], -best[2])


class Seeds:
    """Seeds of some benchmark items, to look up texts in."""

    def __init__(self, items: list[Item]) -> None:
        self.vocab: dict[bytes, int] = {}
        self.ids, self.items = [], []
        groups: dict[str, list[int]] = {}
        for item, text in items:
            words = tokens(text)
            if words:
                for m in masks_of(len(words)):
                    groups.setdefault(m, []).append(len(self.ids))
                self.ids.append(item)
                self.items.append(np.array([self.vocab.setdefault(w, numbered(w)) for w in words], np.uint64))
        self.masks = sorted(groups)
        hashes, where = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
        for m in self.masks:
            for i in groups[m]:
                h = hashed(self.items[i], m)
                hashes.append(h)
                where.append(np.stack([np.full(len(h), i), np.arange(len(h))], axis=1))
        self.hashes = np.concatenate(hashes)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.where = self.hashes[order], np.concatenate(where)[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.hashes >> np.uint64(64 - _TABLE_BITS)] = True

    def hits(self, words: np.ndarray) -> np.ndarray:
        """Distinct (item, diagonal) of all seeds that the words have."""
        found = []
        for m in self.masks:
            h = hashed(words, m)
            at = np.flatnonzero(self.table[h >> np.uint64(64 - _TABLE_BITS)])
            lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            n = hi - lo
            if n.sum():
                place = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                pairs = self.where[place]
                found.append(np.stack([pairs[:, 0], np.repeat(at, n) - pairs[:, 1]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def overlaps(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, matched tokens, item tokens, first token of the item's place in the document, best stretch) of each
        item that the text overlaps, on its best diagonal."""
        get = self.vocab.get
        words = np.array([get(w, 0) for w in tokens(text)], np.uint64)
        if not len(words) or not self.vocab:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        pairs = self.hits(words)
        for group in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1) if len(pairs) else ():
            i = int(group[0, 0])
            if found := agreeing(self.items[i], words, group[:, 1]):
                best[i] = found
        return [(self.ids[i], total, len(self.items[i]), at, stretch) for i, (total, stretch, at) in sorted(best.items())]


_FOUND = ("item_id", "n_matched", "n_item_tokens", "first_token", "best_stretch")
_FOUND_TYPES = ", ".join(f"{c} long" for c in _FOUND)


def _found(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([x[j] for x in rows], pa.int64()) for j in range(len(_FOUND))]
    return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *columns], ["id", *_FOUND])


# ---- a benchmark that fits in one place


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()


def _bytes(items: DataFrame) -> int:
    return int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"])


def _held(items: DataFrame) -> list[Item]:
    return sorted(((r["item"], r["text"]) for r in items.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _looked_up(rows: DataFrame, items: DataFrame) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(_held(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(held.value)
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(texts_of(batch, "text")):
                for x in seeds.overlaps(text):
                    at.append(k)
                    found.append(x)
            yield _found(batch, at, found)

    return rows.transform(shipped).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_FOUND_TYPES}")


# ---- one that does not


class _Numbers:
    """Tokens of texts as numbers, words remembered."""

    def __init__(self) -> None:
        self.memory: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.memory) > MEMORY_WORDS:
            self.memory.clear()
        memory, out = self.memory, []
        for w in tokens(text):
            if (h := memory.get(w)) is None:
                h = memory[w] = numbered(w)
            out.append(h)
        return np.array(out, np.uint64)


def _seed_table(rows: DataFrame, name: str, kept: np.ndarray | None = None) -> DataFrame:
    """(key, seed, at) of every text, all masks if kept is given (a bit map: only seeds that may be in it), else the text's own."""
    held = None if kept is None else rows.sparkSession.sparkContext.broadcast(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers()
        for batch in batches:
            key, seed, place = [], [], []
            for k, text in zip(batch.column("key").to_pylist(), texts_of(batch, "text"), strict=True):
                words = number(text)
                for m in ALL_MASKS if held is not None else masks_of(len(words)) if len(words) else ():
                    h = hashed(words, m)
                    at = np.arange(len(h))
                    if held is not None:
                        bit = h >> np.uint64(64 - _MAP_BITS)
                        at = np.flatnonzero(held.value[bit >> np.uint64(3)] & (np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8)))
                    key += [k] * len(at)
                    seed.append(h[at].view(np.int64))
                    place.append(at)
            seeds, places = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (seed, place))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(seeds, pa.int64()), pa.array(places, pa.int64())], ["key", "seed", "at"])

    return scratch_table(rows.select("key", "text").transform(shipped).mapInArrow(run, "key string, seed long, at long"), name)


def _map_of(seeds: DataFrame) -> np.ndarray:
    """Bit map of a seed table: 2^_MAP_BITS bits, made on executors as words of 64 bits."""
    bit = F.shiftrightunsigned("seed", 64 - _MAP_BITS)
    words = seeds.select(bit.alias("b")).select(F.floor(F.col("b") / 64).alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    told = words.toArrow()
    out = np.zeros(1 << (_MAP_BITS - 6), np.int64)
    out[told.column("w").to_numpy()] = told.column("m").to_numpy()
    return out.view(np.uint8)


def _joined(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The same rows by a join of seeds; texts go by their MD5, so equal texts are looked at once."""
    rows = rows.where("text is not null").withColumn("key", F.md5("text"))
    items = scratch_table(items.withColumn("key", F.concat_ws(":", F.md5("text"), "item")), "benchmark-items")
    own = _seed_table(items, "benchmark-seeds")
    theirs = _seed_table(rows.select("key", "text"), "document-seeds", _map_of(own))
    # Both are plain tables and neither is broadcast, so a hot seed can be split.
    pairs = theirs.select("seed", F.col("key").alias("text_key"), F.col("at").alias("p")).hint("merge").join(own.select("seed", F.col("key").alias("item_key"), F.col("at").alias("q")), "seed")
    pairs = scratch_table(pairs.select("text_key", "item_key", (F.col("p") - F.col("q")).alias("at")).distinct(), "seed-pairs")
    per_text = pairs.groupBy("text_key").agg(F.approx_count_distinct("item_key").alias("n"))
    dealt = pairs.join(per_text, "text_key").withColumn("portion", F.pmod(F.xxhash64("item_key"), F.ceil(F.col("n") / PORTION)))
    dealt = dealt.groupBy("text_key", "portion", "item_key").agg(F.collect_set("at").alias("at"))
    dealt = dealt.join(items.select(F.col("key").alias("item_key"), "item", F.col("text").alias("item_text")), "item_key")
    dealt = scratch_table(dealt.groupBy("text_key", "portion").agg(F.collect_list(F.struct("item", "item_text", "at")).alias("pairs")), "seed-portions")
    marked = marked_by_ids(rows, "key", dealt.select("text_key"), "text_key").where("_map_maybe").drop("_map_maybe")
    met = marked.join(dealt.select(F.col("text_key").alias("key"), "pairs"), "key").select("id", "text", "pairs")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers()
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(texts_of(batch, "text")):
                words = number(text)
                for pair in batch.column("pairs")[k].as_py():
                    item = number(pair["item_text"])
                    if best := agreeing(item, words, np.array(pair["at"], np.int64)):
                        at.append(k)
                        found.append((pair["item"], best[0], len(item), best[2], best[1]))
            yield _found(batch, at, found)

    return met.transform(shipped).mapInArrow(verified, f"id {rows.schema['id'].dataType.simpleString()}, {_FOUND_TYPES}")


def overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, n_matched, n_item_tokens, first_token, best_stretch), a row for each document and item that overlap."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = _items(benchmark, item_col, item_text_col)
    return _looked_up(rows, items) if _bytes(items) <= block_bytes else _joined(rows, items)


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that overlap no item, all their columns kept."""
    items = _items(benchmark, "item_id", "text")
    if _bytes(items) <= block_bytes:
        held = docs.sparkSession.sparkContext.broadcast(_held(items))

        def rule() -> Callable[[str | None], bool]:
            seeds = Seeds(held.value)
            return lambda text: not seeds.overlaps(text)

        return texts_kept(docs, text_col, rule)
    texts = docs.select(F.md5(text_col).alias("_key"), F.col(text_col).alias("_text"))
    found = overlaps(texts, benchmark, id_col="_key", text_col="_text", block_bytes=block_bytes)
    leaked = scratch_table(found.select(F.col("id").alias("_leaked")).distinct(), "leaked-texts")
    marked = marked_by_ids(docs.withColumn("_key", F.md5(text_col)), "_key", leaked, "_leaked")
    rest = marked.where("_map_maybe").join(leaked, F.col("_key") == F.col("_leaked"), "left_anti").select(*docs.columns)
    return marked.where("not _map_maybe").select(*docs.columns).unionByName(rest)
