"""Phrases whose words keep together, from counts kept as sorted streams.

Words are counted first, then pairs of frequent words, then triples of frequent pairs: a phrase is never more frequent than its parts, so this loses none. What is
frequent is told to the next pass by a bit map of bounded size; a map that is too full only lets more phrases through, and counts stay exact.

The counts are then one stream in prefix order (lang, first word, second, third): a word stands before its pairs and a pair before its triples, so one pass
in lockstep over the three lengths gives each phrase the counts of its first words, and each pair the largest count of its extensions. A second
stream in suffix order (last word, the one before, ...) does the same for last words. Streams are dealt out by ranges of the whole key, so a
frequent word's phrases lie in many runs; what a run's beginning owes to the runs before it, one word and one pair, is told by the runs' ends.

Defined results: a null text is empty, a null lang ``und``; empty tables give no phrases. Only the text and lang columns are read; repeated rows count each time.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shipped
from ._common import scratch_table

#: Pieces end at these characters, words at the others.
STOPS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: A phrase counted so often is a candidate; a candidate goes if a longer one has this share of its count, in percent.
LEAST_COUNT, ABSORBED = 10, 50
#: Bits of a map of frequent phrases at most, and for each phrase.
MAX_MAP_BITS, BITS_EACH = 1 << 26, 16
#: Counts that a task holds before it sends them on; bytes of text that it cuts into words at once.
HELD_COUNTS, SEGMENT = 200_000, 1 << 20
#: Odd factors that mix the hashes of a pair's words.
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_END = b"."
_TO_SPACE = bytes.maketrans(STOPS + BLANKS, _END * len(STOPS) + b" " * len(BLANKS))


def segments(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in lower case (A-Z only), with b"." between pieces, which no word holds; a long text in several lists, cut between pieces."""
    data = (text or "").encode().lower().translate(_TO_SPACE)
    at = 0
    while at < len(data):
        end = data.find(_END, at + SEGMENT) if len(data) - at > SEGMENT else -1
        end = len(data) if end < 0 else end + 1
        yield data[at:end].replace(_END, b" . ").split()
        at = end


def _hashed(words: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of words (an array of bytes), the same in every process."""
    return hash_array(words, categorize=False) ^ np.uint64(seed)


def _seed(lang: str) -> int:
    return int(hash_array(np.array([lang.encode()], object), categorize=False)[0])


def _pairs(h: np.ndarray) -> np.ndarray:
    return (h[:-1] * FIRST + h[1:] * SECOND) >> np.uint64(1)


def _map_of(frequent: DataFrame) -> np.ndarray:
    """A bit map of the (lang, phrase) rows, phrases of one or of two words; at most MAX_MAP_BITS reach the driver."""
    bits = min(MAX_MAP_BITS, max(1 << 16, 1 << (BITS_EACH * frequent.count()).bit_length()))

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                h = _hashed(np.array(phrase.encode().split(b" "), object), _seed(lang))
                got.append(int((h if len(h) == 1 else _pairs(h))[0]) & (bits - 1))
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], ["h"])

    found = frequent.select("lang", "phrase").mapInArrow(spots, "h long")
    words = found.groupBy(F.floor(F.col("h") / 64).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("mask")).toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[words.column("at").to_numpy()] = words.column("mask").to_numpy()
    return out.view(np.uint8)


def _phrases(words: list[bytes], length: int, seed: int, bits: np.ndarray | None) -> Iterator[bytes | tuple[bytes, ...]]:
    """The phrases of that many words within pieces whose two parts, one word shorter, are in the map."""
    if length == 1:
        return iter(words)
    if len(words) < length:
        return iter(())
    array = np.array(words, object)
    inside, of_words = array != _END, _hashed(array, seed)
    h = (of_words if length == 2 else _pairs(of_words)) & np.uint64(8 * len(bits) - 1)
    may = (bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1
    ok = (may[:-1] & may[1:]).astype(bool)
    for k in range(length):
        ok &= inside[k : len(words) - length + 1 + k]
    return compress(zip(*(words[k:] for k in range(length))), ok.tolist())


def counted(docs: DataFrame, length: int, frequent: DataFrame | None = None) -> DataFrame:
    """(lang, phrase, a) of all phrases of that many words whose parts may be frequent; docs has (lang, text)."""
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(_map_of(frequent)) if frequent is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        bits, held = told.value if told is not None else None, 0

        def sent() -> pa.RecordBatch:
            langs = [pa.nulls(0, pa.string()), *(pa.repeat(pa.scalar(x, pa.string()), len(c)) for x, c in counts.items())]
            phrases = [p for c in counts.values() for p in (map(b" ".join, c) if length > 1 else c)]
            n = [x for c in counts.values() for x in c.values()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(langs), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "a"])

        for batch in batches:
            langs, texts = batch.column("lang"), batch.column("text")
            for k in range(batch.num_rows):
                lang = langs[k].as_py()
                mine, seed = counts[lang], _seed(lang)
                for words in segments(texts[k].as_py()):
                    held -= len(mine)
                    mine.update(_phrases(words, length, seed, bits))
                    if length == 1:
                        mine.pop(_END, None)
                    held += len(mine)
                    if held > HELD_COUNTS:
                        yield sent()
                        mine, held = counts[lang], 0
        if counts:
            yield sent()

    parts = docs.transform(shipped).mapInArrow(run, "lang string, phrase string, a long")
    return parts.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


# A row of a stream: the phrase's words in the stream's order (null beyond its length), its count, and what other passes found.
_STREAM = "lang string, phrase string, a long, length int, head1 long, head2 long, tail1 long, tail2 long, longer long"


def _order(suffix: bool) -> list[Column]:
    words = F.split("phrase", " ")
    if suffix:
        words = F.reverse(words)
    return [F.col("lang"), *(F.get(words, F.lit(k)) for k in range(3))]


def _lockstep(stream: DataFrame, one: str, two: str, suffix: bool) -> DataFrame:
    """Fills, in one pass over the stream in its order, columns one and two with the counts of a phrase's first word and pair, and ``longer``
    with the largest count of a triple that begins with a pair. suffix: the order is that of last words, and these are what is found."""
    columns = [f.split()[0] for f in _STREAM.split(", ")]
    at = {c: k for k, c in enumerate(columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_id = TaskContext.get().partitionId()
        word, pair = (None, None, None), (None, None, None)  # lang, words, count: the heads that are open
        waiting: list | None = None  # the open pair's row, until its triples are over
        out: list[list] = []

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * len(columns)
            made = [pa.array(list(c), pa.string() if k < 2 else pa.int32() if columns[k] == "length" else pa.int64()) for k, c in enumerate(cols)]
            n = len(out)
            out.clear()
            return pa.RecordBatch.from_arrays([*made, pa.array([run_id] * n, pa.int32())], [*columns, "run"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                row = list(row)
                lang, words = row[0], row[1].split(" ")
                if suffix:
                    words.reverse()
                if waiting is not None and (pair[0] != lang or pair[1] != words[:2]):
                    out.append(waiting)
                    waiting = None
                if len(words) == 1:
                    word = (lang, words, row[at["a"]])
                else:
                    row[at[one]] = word[2] if word[0] == lang and word[1] == words[:1] else None
                if len(words) == 2:
                    pair, waiting = (lang, words, row[at["a"]]), row
                    continue
                if len(words) == 3:
                    if pair[0] == lang and pair[1] == words[:2]:
                        row[at[two]] = pair[2]
                        waiting[at["longer"]] = max(waiting[at["longer"]] or 0, row[at["a"]])
                out.append(row)
                if len(out) >= 8192:
                    yield batch_of()
        if waiting is not None:
            out.append(waiting)
        yield batch_of()

    order = _order(suffix)
    done = stream.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{_STREAM}, run int")
    done = scratch_table(done, "suffix-stream" if suffix else "prefix-stream")
    return _joined_runs(done, one, two, suffix)


def _joined_runs(done: DataFrame, one: str, two: str, suffix: bool) -> DataFrame:
    """Across the runs' ends: what begins a run gets the word and the pair that the runs before it ended with, and that pair the longer phrases that came after.

    A run has one such word, pair and largest count, so the tables of them have a row for each run.
    """
    spark = done.sparkSession
    key = F.struct(*_order(suffix))
    open_pair = F.when((F.col("length") == 3) & F.col(two).isNull(), F.col("a"))
    ends = done.groupBy("run").agg(
        F.max_by("a", F.when(F.col("length") == 1, key)).alias("word"), F.max_by(F.struct("a", "lang", "phrase"), F.when(F.col("length") == 2, key)).alias("pair"), F.max(open_pair).alias("later"),
    ).orderBy("run").collect()
    # Triples that begin a run belong to the pair that an earlier run ended with: the last run that has one.
    facts, word, pair, owner, later = {}, None, None, None, {}
    for r in ends:
        facts[r["run"]] = (word, pair["a"] if pair else None)
        if r["later"] is not None and owner is not None:
            later[owner] = max(later.get(owner, 0), r["later"])
        word = r["word"] or word
        if r["pair"]:
            pair, owner = r["pair"], r["run"]
    pairs = {r["run"]: r["pair"] for r in ends}
    seams = [(k, *facts[k], pairs[k]["lang"] if k in later else None, pairs[k]["phrase"] if k in later else None, later.get(k)) for k in facts]
    seams = spark.createDataFrame(seams, "run int, open_word long, open_pair long, last_lang string, last_pair string, later long")
    told = done.join(F.broadcast(seams), "run").withColumn(one, F.when(F.col("length") > 1, F.coalesce(one, "open_word"))).withColumn(two, F.when(F.col("length") > 2, F.coalesce(two, "open_pair")))
    is_last = F.coalesce((F.col("lang") == F.col("last_lang")) & (F.col("phrase") == F.col("last_pair")), F.lit(False))
    told = told.withColumn("longer", F.when(F.col("length") == 2, F.greatest("longer", F.when(is_last, F.col("later")))))
    return told.select(*(f.split()[0] for f in _STREAM.split(", ")))


def mine(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT, absorbed: int = ABSORBED) -> DataFrame:
    """All collocations of two and three words: lang, phrase, a, l, r, n, score; those inside a longer candidate that is ``absorbed`` percent as frequent are left out."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = scratch_table(counted(rows, 1), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    levels = [words.where(F.col("a") >= least)]
    for length in (2, 3):
        levels.append(scratch_table(counted(rows, length, levels[-1]).where(F.col("a") >= least), f"phrases-{length}"))
    blank = [F.lit(None).cast("long").alias(c) for c in ("head1", "head2", "tail1", "tail2", "longer")]
    stream = None
    for k, level in enumerate(levels):
        part = level.select("lang", "phrase", "a", F.lit(k + 1).alias("length"), *blank)
        stream = part if stream is None else stream.unionByName(part)
    stream = _lockstep(_lockstep(stream, "head1", "head2", False), "tail1", "tail2", True)
    score = lambda l, r: F.expr(f"(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))")
    found = stream.where((F.col("length") > 1) & ~F.coalesce(100 * F.col("longer") >= absorbed * F.col("a"), F.lit(False)))
    one = F.struct(F.when(F.col("length") == 2, score("head1", "tail1")).otherwise(score("head1", "tail2")).alias("score"), F.lit(1).alias("cut"), F.col("head1").alias("l"), F.when(F.col("length") == 2, F.col("tail1")).otherwise(F.col("tail2")).alias("r"))
    two = F.when(F.col("length") == 3, F.struct(score("head2", "tail1").alias("score"), F.lit(2).alias("cut"), F.col("head2").alias("l"), F.col("tail1").alias("r")))
    found = found.withColumn("best", F.least(one, F.coalesce(two, one))).select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    return found.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def ranked(found: DataFrame, limit: int = 2000, shares: int = 64) -> DataFrame:
    """Each lang's first phrases by score, then count, then phrase, with their rank from 1. A lang's phrases are ranked in shares first, so
    that no task gets more than ``limit`` of each share."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = found.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= limit)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return found.where(F.col("rank") <= limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
