"""Near-duplicate vectors: collisions on many sorted one-dimensional projections, counted per pair, then verified.

A vector is projected on S * S random directions, each the sum of one direction of a first book and one of a second, so that its largest
projections among all of them follow from 2 * S products. It is posted under its k largest. Two vectors collide in a direction if both are posted there and
their projections lie within the same window around each other. Pairs that collide in enough directions are verified by their cosine.

Books grow with the number of vectors, so that a direction's list does not. k and the count that is asked for are calibrated: how often
two vectors at exactly the threshold collide depends on their angle only, not on the data, so it is measured on planted pairs before the search.

Equal vectors form one class and are compared once. A long list is dealt into blocks, and every two blocks meet in a task of their own; a pair is
counted in one task only, that of the first direction in which it collides. No row is made for a pair: tasks give links for each class and a forest.

Defined results: a vector that is null, zero, empty, or holds a null or non-finite component links with nothing, and so do vectors of unequal length. Rows that
repeat are vectors of their own. A row without id takes part; it is named by its component's smallest id, null if there is none. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shipped
from ._common import scratch_table
from ._components import components

#: Vectors for each direction, about; sizes of a book.
PER_DIRECTION, LEAST_BOOK, BOOK_CELLS = 16, 16, 1 << 22
#: Numbers of postings that are tried, in order, and the recall at the threshold that is asked of collisions.
POSTINGS, RECALL = (16, 24, 32, 48, 64, 96, 128), 0.999
#: Half the width of a window, in standard deviations of a difference at the threshold.
WINDOW = 2.7
#: Classes of a block; planted pairs of the calibration.
BLOCK, PLANTED = 1024, 4000
SEED = 11


def book_size(n: int, dims: int) -> int:
    return int(min(max(LEAST_BOOK, np.ceil(np.sqrt(n / PER_DIRECTION))), max(LEAST_BOOK, BOOK_CELLS // dims)))


@lru_cache(maxsize=8)
def books(dims: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, dims, size))
    return tuple(rng.standard_normal((dims, size)) / np.sqrt(2) for _ in range(2))


def largest(unit: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k directions with the largest projections of each unit vector, in ascending order, and these projections.

    The k largest sums lie among the sums of the k largest of either book.
    """
    dirs, proj = [], []
    for at in range(0, len(unit), 256):
        tops = []
        for book in books(unit.shape[1], size):
            p = unit[at : at + 256] @ book
            top = np.argpartition(-p, min(k, size) - 1, axis=1)[:, :k]
            tops.append((top, np.take_along_axis(p, top, 1)))
        (i, p), (j, q) = tops
        sums, names = (p[:, :, None] + q[:, None, :]).reshape(len(p), -1), (i[:, :, None].astype(np.int64) * size + j[:, None, :]).reshape(len(p), -1)
        top = np.argpartition(-sums, k - 1, axis=1)[:, :k]
        names, sums = np.take_along_axis(names, top, 1), np.take_along_axis(sums, top, 1)
        order = np.argsort(names, axis=1)
        dirs.append(np.take_along_axis(names, order, 1))
        proj.append(np.take_along_axis(sums, order, 1).astype(np.float32))
    return np.concatenate(dirs), np.concatenate(proj)


def window(threshold: float) -> float:
    return WINDOW * float(np.sqrt(2 - 2 * threshold))


@lru_cache(maxsize=64)
def calibrated(dims: int, size: int, threshold: float) -> tuple[int, int]:
    """(k, count): the fewest postings with which pairs at the threshold collide twice as often as RECALL asks, and the largest count that still does.

    In few dimensions directions repeat each other; where even the most postings do not suffice, one collision is enough.
    """
    if dims == 1:
        return POSTINGS[0], 1
    rng = np.random.default_rng((SEED, dims, size, 1))
    a, b = rng.standard_normal((2, PLANTED, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = threshold * a + np.sqrt(1 - threshold**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for k in POSTINGS:
        met = np.zeros(PLANTED, np.int64)
        for at in range(0, PLANTED, 256):
            (d, p), (e, q) = (largest(x[at : at + 256], size, k) for x in (a, b))
            met[at : at + 256] = ((d[:, :, None] == e[:, None, :]) & (np.abs(p[:, :, None] - q[:, None, :]) <= window(threshold))).sum((1, 2))
        fits = [c for c in range(1, k + 1) if (met >= c).mean() >= RECALL]
        if fits and fits[-1] >= 2:
            return k, fits[-1]
    return POSTINGS[-1], 1


def comparable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(vectors: pa.Array) -> np.ndarray:
    v = np.asarray(vectors.values if hasattr(vectors, "values") else vectors.flatten(), np.float64)
    v = v[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()].reshape(len(vectors), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _posted(classes: DataFrame, plans: dict[int, tuple[int, int]]) -> DataFrame:
    """Every class with its directions and projections; plans has (book size, k) for each number of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(np.asarray(batch.column("v").offsets))
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                size, k = plans[int(d)]
                dirs, proj = largest(_units(part.column("v")), size, k)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(part) + 1, k), pa.int32()), pa.array(x.ravel())) for x in (dirs, proj)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("c", "size", "dims", "v")), *lists], ["c", "size", "dims", "v", "dirs", "proj"])

    kind = classes.schema["v"].dataType.simpleString()
    return classes.transform(shipped).mapInArrow(run, f"c long, size long, dims int, v {kind}, dirs array<long>, proj array<float>")


def collisions(dirs: np.ndarray, proj: np.ndarray, side: np.ndarray | None, here: int, half: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that collide in ``count`` directions at least, of which ``here`` is the first. side: only pairs of unequal sides.

    All directions' lists lie one behind another, sorted by projection; each entry meets those behind it as far as its window reaches.
    """
    n, k = dirs.shape
    row, d, p = np.repeat(np.arange(n), k), dirs.ravel(), proj.ravel()
    order = np.lexsort((p, d))
    row, d, p = row[order], d[order], p[order]
    met, early, now = np.zeros(n * n, np.int32), np.zeros(n * n, bool), np.zeros(n * n, bool)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def count_held() -> None:
        pairs, where = (np.concatenate(x) for x in zip(*held, strict=True))
        met.__iadd__(np.bincount(pairs, minlength=n * n).astype(np.int32))
        early[pairs[where < here]], now[pairs[where == here]] = True, True
        held.clear()

    at, ahead, waiting = np.arange(len(d)), 0, 0
    while True:
        ahead += 1
        at = at[at + ahead < len(d)]
        at = at[(d[at + ahead] == d[at]) & (p[at + ahead] - p[at] <= half)]
        if not len(at):
            break
        a, b = row[at], row[at + ahead]
        keep = slice(None) if side is None else side[a] != side[b]
        a, b, where = a[keep], b[keep], d[at][keep]
        held.append((np.minimum(a, b) * n + np.maximum(a, b), where))
        waiting += len(a)
        if waiting > 2_000_000:
            count_held()
            waiting = 0
    if held:
        count_held()
    found = np.flatnonzero((met >= count) & now & ~early)
    return found // n, found % n


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what the pairs (a, b) connect, one fewer than each part has rows."""
    near = np.zeros((n, n), bool)
    near[a, b] = near[b, a] = True
    left, out = near.any(1), []
    while left.any():
        root = int(np.argmax(left))
        left[root] = False
        front = np.array([root])
        while len(front):
            new = np.flatnonzero(near[front].any(0) & left)
            out += [(root, int(x)) for x in new]
            left[new] = False
            front = new
    return out


def _linked(posted: DataFrame, plans: dict[int, tuple[int, int]], counts: dict[int, int], threshold: float) -> DataFrame:
    """Rows (a, b, n): a class and the vectors that it is linked to in one task (b null), or two classes of one component (n 0)."""
    half = window(threshold)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        get = lambda c: rows.column(c).to_numpy()
        c, size, side, dims = get("c"), get("size"), get("own"), int(get("dims")[0])
        dirs, proj = (np.asarray(rows.column(x).combine_chunks().flatten()).reshape(len(c), -1) for x in ("dirs", "proj"))
        lo, hi = int(get("lo")[0]), int(get("hi")[0])
        a, b = collisions(dirs, proj, None if lo == hi else side, int(get("dir")[0]), half, counts[dims])
        unit = _units(rows.column("v").combine_chunks()) if len(a) else None
        sure = np.concatenate([np.einsum("ij,ij->i", unit[a[x : x + 65536]], unit[b[x : x + 65536]]) >= threshold for x in range(0, len(a), 65536)] or [np.zeros(0, bool)])
        a, b = a[sure], b[sure]
        links = np.bincount(a, size[b], len(c)) + np.bincount(b, size[a], len(c))
        with_links = np.flatnonzero(links)
        edges = _forest(len(c), a, b) if len(a) else []
        first = [*c[with_links].tolist(), *(int(c[x]) for x, _ in edges)]
        second = [*[None] * len(with_links), *(int(c[y]) for _, y in edges)]
        n = [*(int(x) for x in links[with_links]), *[0] * len(edges)]
        return pa.table([pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    lists = posted.select("dims", F.explode("dirs").alias("dir")).groupBy("dims", "dir").count().where(F.col("count") > BLOCK)
    long = scratch_table(lists.select("dims", "dir", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "long-lists")
    rows = posted.withColumn("dir", F.explode("dirs")).join(long, ["dims", "dir"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("c", "dir"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("c", "size", "dims", "v", "dirs", "proj", "dir", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return rows.groupBy("dims", "dir", "lo", "hi").applyInArrow(run, "a long, b long, n long")


def near_duplicates(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per vector: id, n_links (other vectors with a cosine of the threshold or more that were found), component_id, kept."""
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    kind = named.schema["v"].dataType.elementType.simpleString()
    if kind not in ("float", "double"):
        named = named.withColumn("v", F.col("v").cast("array<double>"))
    # A vector's name: 128 bits of hash.
    named = named.withColumn("ok", comparable(F.col("v"))).withColumn("h", F.when(F.col("ok"), F.xxhash64("v"))).withColumn("g", F.when(F.col("ok"), F.xxhash64(F.lit(SEED), "v")))
    classes = named.where("ok").groupBy("h", "g").agg(F.first("v").alias("v"), F.min("id").alias("first_id"), F.count("*").alias("size"))
    classes = scratch_table(classes.select(F.monotonically_increasing_id().alias("c"), "*", F.size("v").alias("dims")), "vector-classes")
    sizes = {r["dims"]: r["n"] for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    books_of = {d: book_size(n, d) for d, n in sizes.items()}
    told = {d: calibrated(d, s, threshold) for d, s in books_of.items()}
    plans = {d: (books_of[d], k) for d, (k, _) in told.items()}
    posted = scratch_table(_posted(classes.select("c", "size", "dims", "v"), plans), "posted-vectors")
    found = scratch_table(_linked(posted, plans, {d: c for d, (_, c) in told.items()}, threshold), "vector-links")
    links = found.where("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("linked"))
    parts = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "c")
    of_class = classes.select("c", "h", "g", "first_id", "size").join(links, "c", "left").join(parts, "c", "left").withColumn("component", F.coalesce("component", "c"))
    of_class = scratch_table(of_class, "linked-classes")
    least = of_class.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = of_class.join(least, "component").select("h", "g", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    with_class = named.where("ok").select("id", "h", "g").join(of_class, ["h", "g"]).select("id", "n_links", "component_id")
    alone = named.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return with_class.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
