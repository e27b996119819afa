"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of three hashed embeddings: the word, its first four and its first five letters. Filters of widths
1, 2 and 3 slide over the words; the largest answer of each filter over the whole text goes through a rectifier into
a logistic output. One embedding channel starts from the log-odds of each hash bucket in the fitting rows, the others from
small random values; all are trained. Thresholds are set for each language on fitting rows kept apart, the language
being guessed from the words by a naive Bayes table of the same fit, and the score is shifted so that 0.5 is the
threshold.

The fit takes at most about ``per_class`` (``PER_CLASS``) labelled rows of each class, picked by a hash of their id, none of more than
``MAX_FIT_CHARS`` characters. Every row is scored over its whole text, in pieces of bounded size.

Defined results: null and empty texts score as texts without words (below 0.5); without labelled rows of both
classes every score is 0; a row with a null id is held out, and scored like others; a repeated label counts by its maximum; repeated rows are scored one by one; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shipped
from ._common import texts_kept, texts_of

BITS, DIM, FILTERS, WIDTHS = 15, 8, 6, (1, 2, 3)
#: Rows of each class that the fit takes at most, in expectation; characters of such a row; passes over them.
PER_CLASS = 2000
MAX_FIT_CHARS = 60_000
EPOCHS = 6
#: Words worked on at once, and words remembered by each worker.
PIECE, MEMORY_WORDS = 1 << 15, 100_000
_NOT_WORD = {c: " " for c in range(128) if not chr(c).isalnum()}


class Words:
    """Text to packed bucket numbers, one 64-bit value for each word."""

    def __init__(self) -> None:
        self.memory: dict[str, int] = {}
        self.table = str.maketrans(_NOT_WORD)

    def _pack(self, word: str) -> int:
        mask = (1 << BITS) - 1
        out = 0
        for k, part in enumerate((word, "4" + word[:4], "5" + word[:5])):
            out |= (xxhash.xxh3_64_intdigest(part) & mask) << (BITS * k)
        if len(self.memory) >= MEMORY_WORDS:
            self.memory.clear()
        self.memory[word] = out
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().translate(self.table).split()
        get, pack = self.memory.get, self._pack
        found = [pack(w) if (v := get(w)) is None else v for w in words]
        packed, mask = np.array(found, np.int64), (1 << BITS) - 1
        return np.stack([(packed >> (BITS * k)) & mask for k in range(3)], axis=1) if len(found) else np.zeros((0, 3), np.int64)


@dataclass
class Net:
    embedding: np.ndarray  # buckets x dim
    filters: list[np.ndarray]  # for each width: width x dim x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    languages: list[str]
    language_odds: np.ndarray  # buckets x languages
    thresholds: np.ndarray

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of every filter over the text, and where it stands; -1 where the text is shorter than the filter."""
        n_out = FILTERS * len(WIDTHS)
        best, at = np.zeros(n_out, np.float32), np.full(n_out, -1)
        for lo in range(0, len(ids), PIECE):
            part = ids[max(0, lo - max(WIDTHS) + 1) : lo + PIECE]
            x = self.embedding[part[:, 0]] + self.embedding[part[:, 1]] + self.embedding[part[:, 2]]
            for k, (width, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                n = len(x) - width + 1
                if n < 1:
                    continue
                y = x[:n] @ f[0]
                for d in range(1, width):
                    y += x[d : d + n] @ f[d]
                top = y.argmax(axis=0)
                value = y[top, np.arange(FILTERS)]
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                better = (value > best[own]) | (at[own] < 0)
                best[own] = np.where(better, value, best[own])
                at[own] = np.where(better, top + max(0, lo - max(WIDTHS) + 1), at[own])
        return best, at

    def logit(self, ids: np.ndarray) -> float:
        best, at = self.pooled(ids)
        return float(np.where(at < 0, 0, np.maximum(best + self.bias, 0)) @ self.out + self.out_bias)

    def language(self, ids: np.ndarray) -> int:
        if not len(ids) or not self.languages:
            return 0
        return int(sum(self.language_odds[ids[lo : lo + PIECE, 0]].sum(axis=0) for lo in range(0, len(ids), PIECE)).argmax())

    def score(self, ids: np.ndarray) -> float:
        shift = self.thresholds[self.language(ids)] if len(self.thresholds) else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.logit(ids) - shift, -30, 30))))


def _odds(ids: list[np.ndarray], hit: np.ndarray) -> np.ndarray:
    """Log-odds of each bucket: share of documents with it among those hit, against the others."""
    seen = np.zeros((2, 1 << BITS))
    for x, h in zip(ids, hit, strict=True):
        seen[int(h)][np.unique(x)] += 1
    n = np.array([[max(1, (~hit).sum())], [max(1, hit.sum())]])
    share = (seen + 0.5) / (n + 1)
    return np.log(share[1] / share[0]) * (seen.sum(axis=0) > 1)


def fit(rows: list[tuple[np.ndarray, int, str | None]], *, epochs: int = EPOCHS, seed: int = 11) -> Net | None:
    """A net from (buckets, label, language) rows in a fixed order; a fifth of them sets the thresholds."""
    rng = np.random.default_rng(seed)
    label = np.array([bool(r[1]) for r in rows])
    if not len(rows) or label.all() or not label.any():
        return None
    aside = np.zeros(len(rows), bool)
    for cls in (True, False):
        aside[np.flatnonzero(label == cls)[4::5]] = True
    learn = np.flatnonzero(~aside)
    e = (rng.standard_normal((1 << BITS, DIM)) * 0.02).astype(np.float32)
    e[:, 0] += (_odds([rows[i][0] for i in learn], label[learn]) / 4).astype(np.float32)
    filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] += 1.0 / len(f)
    n_out = FILTERS * len(WIDTHS)
    names = sorted({r[2] for r in rows if r[2] is not None})
    tongue = np.array([r[2] if r[2] is not None else "" for r in rows])
    odds = np.zeros((1 << BITS, len(names)), np.float32)
    for k, name in enumerate(names):
        counts = np.bincount(np.concatenate([rows[i][0][:, 0] for i in np.flatnonzero(tongue == name)]), minlength=1 << BITS) + 0.1
        odds[:, k] = np.log(counts / counts.sum())
    net = Net(e, filters, np.zeros(n_out, np.float32), np.full(n_out, 0.5, np.float32), -1.0, names, odds, np.zeros(max(1, len(names))))
    weight = {c: len(learn) / (2 * max(1, (label[learn] == c).sum())) for c in (True, False)}
    speed, grown = 0.05, [np.full(p.shape, 0.1, np.float32) for p in (net.bias, net.out, *filters)]
    e_grown, b_grown = np.full(1 << BITS, 0.1, np.float32), 0.1

    def move(param: np.ndarray, sums: np.ndarray, grad: np.ndarray) -> None:
        sums += grad * grad
        param -= speed * grad / np.sqrt(sums)

    for _ in range(epochs):
        for i in rng.permutation(learn):
            ids = rows[i][0]
            best, at = net.pooled(ids)
            live = (at >= 0) & (best + net.bias > 0)
            hidden = np.where(live, best + net.bias, 0)
            err = weight[bool(label[i])] * (1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias, -30, 30))) - label[i])
            if abs(err) < 1e-3:
                continue
            back = np.where(live, err * net.out, 0).astype(np.float32)
            move(net.out, grown[1], (err * hidden + 1e-4 * net.out).astype(np.float32))
            move(net.bias, grown[0], back)
            b_grown += err * err
            net.out_bias -= float(speed * err / np.sqrt(b_grown))
            for k, (width, f) in enumerate(zip(WIDTHS, filters, strict=True)):
                grad = np.zeros_like(f)
                for j in range(FILTERS):
                    g, p = back[k * FILTERS + j], at[k * FILTERS + j]
                    if g == 0:
                        continue
                    for d in range(width):
                        buckets = ids[p + d]
                        grad[d, :, j] += g * e[buckets].sum(axis=0)
                        down = g * f[d, :, j]
                        for b in buckets:
                            e_grown[b] += float(down @ down)
                            e[b] -= speed * down / np.sqrt(e_grown[b])
                move(f, grown[2 + k], grad)
    logits = np.array([net.logit(rows[i][0]) for i in np.flatnonzero(aside)])
    guess = np.array([net.language(rows[i][0]) for i in np.flatnonzero(aside)])
    truth = label[aside]
    overall = _threshold(logits, truth, 0.0)
    net.thresholds = np.array([_threshold(logits[guess == k], truth[guess == k], overall) for k in range(max(1, len(names)))])
    return net


def _threshold(logits: np.ndarray, truth: np.ndarray, default: float) -> float:
    """Midway between the two neighbouring logits that make the fewest balanced errors; the default for under 5 of a class."""
    if truth.sum() < 5 or (~truth).sum() < 5:
        return default
    order = np.sort(logits)
    cuts = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2, [order[-1] + 1]])
    errors = np.array([(logits[truth] < c).mean() + (logits[~truth] >= c).mean() for c in cuts])
    least = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float((cuts[least[0]] + cuts[least[-1]]) / 2)


def is_training_row(id_col: str) -> Column:
    """A row without an id has no remainder: it is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", per_class: int = PER_CLASS) -> Net | None:
    """Fit on a bounded sample of the labelled training rows."""
    marks = labels.where(F.col(label_col).isNotNull() & is_training_row(id_col)).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    counts = {r[0]: r[1] for r in marks.groupBy("_label").count().collect()}  # one row for each class
    if not counts.get(1) or not counts.get(0):
        return None
    draw = F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(1_000_003)) / 1_000_003.0
    marks = marks.where(draw < F.when(F.col("_label") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0])))
    # The picked labels number about 2 * per_class whatever the input, so they are broadcast and no text is shuffled.
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    held = docs.select(id_col, F.col(text_col).alias("text"), lang.alias("lang")).where(F.length("text") <= MAX_FIT_CHARS).join(F.broadcast(marks), id_col)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found = [words(t).astype(np.uint16).tobytes() for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("_label"), batch.column("lang"), pa.array(found, pa.binary())], ["id", "y", "lang", "v"])

    rows = held.select(F.col(id_col).cast("string").alias("id"), F.col("_label").cast("int").alias("_label"), "lang", "text").transform(shipped).mapInArrow(buckets, "id string, y int, lang string, v binary").collect()
    rows = sorted(rows, key=lambda r: (r["id"], r["v"]))
    return fit([(np.frombuffer(r["v"], np.uint16).reshape(-1, 3).astype(np.int64), r["y"], r["lang"]) for r in rows])


def civil(docs: DataFrame, net: Net | None, below: float = 0.5, *, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, all their columns kept."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def rule() -> Callable[[str | None], bool]:
        words, own = Words(), held.value
        return lambda text: own is None or own.score(words(text)) < below

    return texts_kept(docs, text_col, rule)


def score(docs: DataFrame, net: Net | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score)."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = Words(), held.value
        for batch in batches:
            found = [own.score(words(t)) if own else 0.0 for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.transform(shipped).mapInArrow(scored, f"id {rows.schema['id'].dataType.simpleString()}, score double")
