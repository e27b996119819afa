"""Language identification in two steps: the family first, then one-versus-one linear support vector machines among
the languages of that family.

Features are hashed counts of letter 1- to 3-grams over the whole text (letters lower-cased, everything else a
blank), square-rooted and scaled to length 1. Both steps are linear support vector machines fitted in numpy on the
driver from at most about ``per_language`` (``PER_LANGUAGE``) labelled rows of each language, picked by a hash of their id, none of
more than ``MAX_FIT_CHARS`` characters; every row is then scored on the executors.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no labelled row all are ``und``;
with one language that one is predicted; a row with a null id is held out, and predicted like others; repeated rows are scored one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shipped
from ._common import texts_of

#: Language families by ISO 639-1 code. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ne", "ur"),
    "semitic": ("ar", "he", "mt", "am"),
}
UNKNOWN = "und"
#: Rows of each language that the fit takes at most, in expectation; and characters of such a row.
PER_LANGUAGE = 400
MAX_FIT_CHARS = 200_000
DIM_BITS = 11
#: Characters worked on at once; longer texts are counted in pieces that overlap by two.
PIECE = 1 << 20


def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)], dtype=bool)


class Grams:
    """Text to feature vector."""

    def __init__(self) -> None:
        self.letters = _letter_table()
        self.shift = np.uint32(32 - DIM_BITS)

    def __call__(self, text: str | None) -> np.ndarray | None:
        if not text or not any(map(str.isalpha, text)):
            return None
        counts = np.zeros(1 << DIM_BITS)
        for at in range(0, len(text), PIECE):
            code = np.frombuffer(f" {text[max(0, at - 2) : at + PIECE].lower()} ".encode("utf-32-le", "replace"), "<u4")
            code = np.where(self.letters[np.minimum(code, 0xFFFF)] | (code > 0xFFFF), code, np.uint32(32))
            h = code * np.uint32(0x9E3779B1)
            two = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + h[1:]
            three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + h[2:]
            for ids in (h, two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)):
                counts += np.bincount(ids >> self.shift, minlength=counts.size)
        vector = np.sqrt(counts)
        return (vector / np.linalg.norm(vector)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, *, penalty: float = 1e-4, rounds: int = 30, seed: int = 5) -> np.ndarray:
    """Weights (with a bias at the end) of a linear machine: hinge loss by averaged stochastic subgradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    w, mean, t, rng = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0, np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            t += 1
            step = 1 / (penalty * (t + 1 / penalty))
            close = y[i] * (x[i] @ w) < 1
            w *= 1 - step * penalty
            if close:
                w += step * share[int(y[i])] * y[i] * x[i]
            mean += w
    return mean / max(t, 1)


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    family_weights: np.ndarray | None
    members: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int, np.ndarray]]] = field(default_factory=dict)

    def predict(self, vector: np.ndarray | None) -> tuple[str, float]:
        """The language, and the family's certainty times the language's among its family's."""
        if vector is None or not self.languages:
            return UNKNOWN, 0.0
        x = np.append(vector, np.float32(1))
        family, sure = self.families[0], 1.0
        if self.family_weights is not None:
            margins = self.family_weights @ x
            best = int(margins.argmax())
            rest = float(np.delete(margins, best).max())
            family, sure = self.families[best], _logistic(2 * (float(margins[best]) - rest))
        names = self.members[family]
        if len(names) == 1:
            return names[0], sure
        votes = np.zeros(len(names))
        for a, b, w in self.pairs[family]:
            p = _logistic(4 * float(w @ x))
            votes[a] += p
            votes[b] += 1 - p
        votes /= len(names) - 1
        best = int(votes.argmax())
        return names[best], float(min(1.0, max(0.0, sure * votes[best])))


def _logistic(v: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(v, -30, 30))))


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), f"only {language}")


def fit(rows: list[tuple[str, np.ndarray]]) -> Model:
    """A model from (language, vector) rows in a fixed order."""
    languages = sorted({name for name, _ in rows})
    members: dict[str, list[str]] = {}
    for name in languages:
        members.setdefault(family_of(name), []).append(name)
    families = sorted(members)
    if not rows:
        return Model([], [], None, {})
    x, label = np.stack([v for _, v in rows]), np.array([name for name, _ in rows])
    kin = np.array([family_of(name) for name in label])
    over = np.stack([fit_svm(x, np.where(kin == f, 1, -1)) for f in families]) if len(families) > 1 else None
    model = Model(languages, families, over, members)
    for f, names in members.items():
        model.pairs[f] = []
        for (a, one), (b, two) in combinations(enumerate(names), 2):
            mine = (label == one) | (label == two)
            model.pairs[f].append((a, b, fit_svm(x[mine], np.where(label[mine] == one, 1, -1))))
    return model


def is_training_row(id_col: str) -> Column:
    """A row without an id has no remainder: it is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 != 2, F.lit(False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the labelled training rows."""
    known = docs.where(is_training_row(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).where(F.length(text_col) <= MAX_FIT_CHARS)
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # one row for each language
    if not counts:
        return fit([])
    share = F.create_map(*[F.lit(v) for name, n in sorted(counts.items()) for v in (name, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(1_000_003)) / 1_000_003.0
    picked = known.where(draw < F.try_element_at(share, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            found = [v.tobytes() if (v := grams(t)) is not None else None for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("id"), pa.array(found, pa.binary())], ["lang", "id", "v"])

    rows = picked.transform(shipped).mapInArrow(vectors, "lang string, id string, v binary").where("v is not null").collect()
    return fit([(r["lang"], np.frombuffer(r["v"], np.float32)) for r in sorted(rows, key=lambda r: (r["lang"], r["id"], r["v"]))])


def known(docs: DataFrame, least: float, model: Model | None = None, *, text_col: str = "text", told_in: str | None = None, certain: float = 1.0, **options: object) -> DataFrame:
    """The documents whose language is predicted with a score of ``least`` or more, all their columns kept.

    In the column ``told_in``, if one is named, the predicted language stands where there was none, or another one and the score is ``certain`` or more.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col=text_col, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, own = Grams(), held.value
        for batch in batches:
            found = [own.predict(grams(t)) for t in texts_of(batch, text_col)]
            if told_in is not None:
                at = batch.schema.get_field_index(told_in)
                told = [lang if had is None or score >= certain else had for (lang, score), had in zip(found, batch.column(at).to_pylist(), strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(told, batch.schema.field(at).type))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.transform(shipped).mapInArrow(run, docs.schema)


def identify(docs: DataFrame, model: Model | None = None, *, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """(id, lang_pred, score)."""
    model = model or train(docs, id_col=id_col, text_col=text_col, **options)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, own = Grams(), held.value
        for batch in batches:
            found = [own.predict(grams(t)) for t in texts_of(batch, "text")]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *more], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.transform(shipped).mapInArrow(predicted, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
