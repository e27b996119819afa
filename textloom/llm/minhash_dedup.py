"""Near-duplicate documents by an inverted join over minhash signature coordinates, confirmed on full shingle sets.

1. Every document becomes its set of 5-word shingles and a signature of 64 coordinates. Documents of equal sets form
   one class from here on; copies need no further comparison.
2. Classes are posted under each (coordinate, value). A pair is a candidate if at least ``MATCHES`` coordinates agree:
   for a similarity of 0.75 fewer agree with a probability below 1e-4. A posting that stands alone helps no pair, so
   classes with fewer shared postings than that are done.
3. Prefix and skip: a class's postings are put in one global order, rarest first. Two classes that agree in
   ``MATCHES`` coordinates meet in the first (shared - MATCHES + 1) postings of each, so the longest lists are skipped.
4. Each list counts the agreeing coordinates of its members and reports a spanning forest of those above the threshold,
   not its pairs. The forests' components are candidate groups.
5. Within candidate groups links are confirmed on full sets, and a spanning forest of the confirmed links gives the
   classes' components.

In a list or group of more than ``BLOCK`` members the most shared one, the pivot, is compared with all others first, one row
for each. Only members that stay apart from it are then compared with all, in blocks of ``BLOCK`` by ``BLOCK``; so a group of close copies moves
about as many rows as it has members, and no task holds more than two blocks. Within a block the same is done: the heaviest
member first, and members already joined need no further comparison.

A class is named by 64 bits of its set's digest; a second 64 bits tell sets of one name apart, and such get other names.

Defined results: null texts and texts without words have an empty set, are linked with nothing and kept; repeated
rows of one text are copies; rows that repeat one id are all kept or all dropped with it; rows with a null id are linked like others,
and component_id is the smallest id that is not null, or null where a component has none: then all its rows are kept; an empty table gives no
rows; further columns pass by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shipped
from ._common import marked_by_ids, scratch_table, texts_of
from ._components import components
from ._shingles import Shingler, Signer

#: Fixed values of the contract: shingle width, and similarity as a ratio of whole numbers.
WIDTH, OVER, UNDER = 5, 75, 100
COORDINATES, MATCHES = 64, 34
BLOCK = 512


def _node(shingles: np.ndarray) -> tuple[int, int]:
    """Name of a set, and what tells it from others of that name."""
    digest = blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _renamed(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """rows (node, second, ...) with other names for the sets that share one."""
    if clashes is None:
        return rows
    told = rows.join(clashes.select("node", F.lit(True).alias("_shared")), "node", "left")
    return told.withColumn("node", F.when(F.col("_shared"), F.xxhash64("node", "second")).otherwise(F.col("node"))).select(*rows.columns)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, node, second, sig): set size, name of the set (null if empty) and what tells it apart, signature. Written to the shared folder."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(WIDTH), Signer(COORDINATES)
        for batch in batches:
            n, node, second, sig = [], [], [], []
            for text in texts_of(batch, "text"):
                s = shingler(text)
                n.append(len(s))
                a, b = _node(s) if len(s) else (None, None)
                node.append(a)
                second.append(b)
                sig.append(signer(s).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(second, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], ["id", "n", "node", "second", "sig"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return scratch_table(rows.transform(shipped).mapInArrow(signed, f"id {rows.schema['id'].dataType.simpleString()}, n long, node long, second long, sig array<int>"), "signatures")


def _postings(classes: DataFrame) -> DataFrame:
    rows = classes.select("node", F.posexplode("sig").alias("k", "v"))
    return rows.select("node", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))


def _blocks(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (with members) dealt to pairs of blocks of their key: columns key, lo, hi (block numbers), part (own block) and the rest."""
    rows = rows.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.select(key, "part", *columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return rows.select(key, F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", *columns)


def _apart_blocks(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (with members, apart, n_apart) dealt so that each that is apart meets all of its key: blocks of the former (part -1)
    by blocks of all (part -2)."""
    a, b = F.ceil(F.col("n_apart") / BLOCK).cast("int"), F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.withColumns({"a": a, "b": b})
    own_a, own_b = F.pmod(F.xxhash64("node"), F.col("a")).cast("int"), F.pmod(F.xxhash64("node"), F.col("b")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    first = rows.where("apart").select(key, F.lit(-1).alias("part"), *columns, own_a.alias("lo"), every("b").alias("hi"))
    second = rows.select(key, F.lit(-2).alias("part"), *columns, own_b.alias("hi"), every("a").alias("lo"))
    return first.select(key, "lo", "hi", "part", *columns).unionByName(second.select(key, "lo", "hi", "part", *columns))


def _same_coordinates(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def _similar(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both * UNDER >= (F.size(a) + F.size(b) - both) * OVER


def _forests(rows: DataFrame, key: str, columns: list[str], work: Callable[[pa.Table], list[tuple[int, int]]], linked: Callable[[Column, Column], Column]) -> DataFrame:
    """Edges (a, b) that join what is linked among the rows of each key. rows have node, weight and sig; linked tells by their columns and the
    pivot's whether both are."""
    sizes = scratch_table(rows.groupBy(key).agg(F.count("*").alias("members")).where("members > 1"), "group-sizes")
    rows = rows.join(sizes, key)
    small = _by_group(_blocks(rows.where(F.col("members") <= BLOCK), key, columns), [key, "lo", "hi"], work)
    if sizes.where(F.col("members") > BLOCK).isEmpty():
        return small
    large = scratch_table(rows.where(F.col("members") > BLOCK).select(key, "members", *columns), "large-groups")
    pivots = scratch_table(large.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("weight", "node")).alias("pivot")), "pivots")
    met = large.join(pivots, key)
    met = met.withColumn("near", linked(F.struct(*columns), F.col("pivot"))).withColumn("self", F.col("node") == F.col("pivot.node"))
    met = scratch_table(met.select(key, "members", *columns, F.col("pivot.node").alias("pivot"), "self", (~F.col("near") & ~F.col("self")).alias("apart")), "met-pivots")
    edges = met.where("not apart and not self").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    left = scratch_table(met.where("apart").groupBy(key).agg(F.count("*").alias("n_apart")), "apart-sizes")
    rest = met.join(left, key)
    # Where most stay apart, blocks against blocks of the same rows are fewer.
    most = F.col("n_apart") * 2 > F.col("members")
    found = _by_group(_apart_blocks(rest.where(~most), key, columns), [key, "lo", "hi"], work)
    found = found.unionByName(_by_group(_blocks(rest.where(most), key, columns), [key, "lo", "hi"], work))
    return small.unionByName(edges).unionByName(found.where("a <> b"))


def _by_group(rows: DataFrame, keys: list[str], work: Callable[[dict[str, np.ndarray | list]], list[tuple[int, int]]]) -> DataFrame:
    """Edges (a, b) from each group of equal keys. Groups arrive sorted; only the one at hand is held."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def edges(table: pa.Table) -> list[tuple[int, int]]:
            keyed = [table.column(k).to_numpy() for k in keys]
            change = np.zeros(len(table), bool)
            for k in keyed:
                change[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(table)]
            table = table.combine_chunks()
            out: list[tuple[int, int]] = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo > 1:
                    out += work(table.slice(lo, hi - lo))
            return out

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            if not len(table):
                continue
            last = [table.column(k)[len(table) - 1].as_py() for k in keys]
            same = np.ones(len(table), bool)
            for k, v in zip(keys, last, strict=True):
                same &= table.column(k).to_numpy() == v
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = table.slice(cut)
            if cut:
                yield batch_of(edges(table.slice(0, cut)))
        if held is not None and len(held):
            yield batch_of(edges(held))

    assert set(keys) <= set(names)
    return rows.repartition(*keys).sortWithinPartitions(*keys).transform(shipped).mapInArrow(run, "a long, b long")


class _Sets:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _forest(n: int, part: np.ndarray, weight: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of the links between the members of two blocks (within one, if there is but one). The heaviest
    member of each block goes first; later only pairs not yet joined are compared. linked(i, others) tells which."""
    sets, out = _Sets(n), []
    two = len(np.unique(part)) > 1
    order = np.argsort(-weight, kind="stable")
    first = [int(order[part[order] == p][0]) for p in np.unique(part)]
    roots = np.arange(n)
    for i in [*first, *(int(x) for x in order if int(x) not in first)]:
        others = (part != part[i]) if two else (np.arange(n) != i)
        others = np.flatnonzero(others & (roots != roots[i]))
        if not len(others):
            continue
        found = others[linked(i, others)]
        joined = False
        for j in found.tolist():
            if sets.join(i, j):
                out.append((i, j))
                joined = True
        if joined:
            roots = np.array([sets.root(x) for x in range(n)])
    return out


def _agreeing(table: pa.Table) -> list[tuple[int, int]]:
    """Forest of the members of a list whose signatures agree in MATCHES coordinates or more."""
    node = table.column("node").to_numpy()
    sig = table.column("sig").chunk(0).flatten().to_numpy().reshape(len(node), COORDINATES)
    if len(node) == 2:
        return [(int(node[0]), int(node[1]))] if (sig[0] == sig[1]).sum() >= MATCHES else []
    found = _forest(len(node), table.column("part").to_numpy(), table.column("weight").to_numpy(), lambda i, others: (sig[others] == sig[i]).sum(axis=1) >= MATCHES)
    return [(int(node[i]), int(node[j])) for i, j in found]


def _confirmed(table: pa.Table) -> list[tuple[int, int]]:
    """Forest of the members of a group whose full sets are as similar as asked; signatures spare hopeless pairs."""
    node = table.column("node").to_numpy()
    sig = table.column("sig").chunk(0).flatten().to_numpy().reshape(len(node), COORDINATES)
    lists = table.column("shingles").chunk(0)
    flat, starts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
    size = np.diff(starts)

    def linked(i: int, others: np.ndarray) -> np.ndarray:
        fits = (np.minimum(size[others], size[i]) * UNDER >= np.maximum(size[others], size[i]) * OVER) & ((sig[others] == sig[i]).sum(axis=1) >= MATCHES)
        out = np.zeros(len(others), bool)
        mine = flat[starts[i] : starts[i + 1]]
        for k in np.flatnonzero(fits):
            j = others[k]
            theirs = flat[starts[j] : starts[j + 1]]
            at = np.searchsorted(mine, theirs)
            both = int((mine[np.minimum(at, len(mine) - 1)] == theirs).sum())
            out[k] = UNDER * both >= OVER * (len(mine) + len(theirs) - both)
        return out

    found = _forest(len(node), table.column("part").to_numpy(), table.column("weight").to_numpy(), linked)
    return [(int(node[i]), int(node[j])) for i, j in found]


def classes_of(signed: DataFrame) -> DataFrame:
    """(node, sig, rep, lo, hi) of every set: rep is the smallest id that has it, lo and hi differ if the name is not its own."""
    rows = signed.where("node is not null").groupBy("node").agg(F.first("sig").alias("sig"), F.min("id").alias("rep"), F.min("second").alias("lo"), F.max("second").alias("hi"))
    return scratch_table(rows, "classes")


def link_classes(docs: DataFrame, classes: DataFrame, clashes: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, component) of every class that has a confirmed link to another."""
    posted = _postings(classes)
    lengths = posted.groupBy("token").agg(F.count("*").alias("length")).where("length > 1")
    shared = scratch_table(posted.hint("merge").join(lengths, "token"), "shared-postings")
    live = shared.groupBy("node").agg(F.count("*").alias("shared"), F.sum("length").alias("weight")).where(F.col("shared") >= MATCHES)
    live = scratch_table(live.join(classes.select("node", "sig", "rep"), "node"), "live")
    # Prefixes: at most COORDINATES rows for each class in a window.
    ranked = shared.join(live.select("node", "shared"), "node").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("length", "token")))
    prefix = scratch_table(ranked.where(F.col("rank") <= F.col("shared") - MATCHES + 1).select("token", "node"), "prefixes")
    lists = prefix.join(live.select("node", "sig", "weight"), "node")
    groups = components(_forests(lists, "token", ["node", "weight", "sig"], _agreeing, lambda x, p: _same_coordinates(x["sig"], p["sig"]) >= MATCHES))

    # Full sets of the members of candidate groups, worked out anew from the texts of their first documents.
    wanted = groups.join(live, "node")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(WIDTH)
        for batch in batches:
            found = [shingler(t) for t in texts_of(batch, "text")]
            names = [_node(s) if len(s) else (None, None) for s in found]
            # Sorted as signed values, as they are held here.
            sets = pa.array([np.sort(s.view(np.int64)) for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()), sets], ["node", "second", "shingles"])

    reps = scratch_table(wanted.select(F.col("rep").alias("wanted_rep")).distinct(), "wanted")
    texts = marked_by_ids(docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")), "rep", reps, "wanted_rep").where("_map_maybe").drop("_map_maybe")
    # A null id may be a class's only one.
    texts = texts.join(reps, F.col("rep").eqNullSafe(F.col("wanted_rep")), "left_semi")
    sets = _renamed(texts.select("text").transform(shipped).mapInArrow(full_sets, "node long, second long, shingles array<long>"), clashes)
    sets = scratch_table(sets.select("node", "shingles").join(wanted.select("node", "component", "weight", "sig"), "node").dropDuplicates(["node"]), "sets")
    confirmed = _forests(sets, "component", ["node", "weight", "sig", "shingles"], _confirmed, lambda x, p: (_same_coordinates(x["sig"], p["sig"]) >= MATCHES) & _similar(x["shingles"], p["shingles"]))
    return components(confirmed)


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each row of docs."""
    signed = signatures(docs, id_col, text_col)
    classes, clashes = classes_of(signed), None
    shared = classes.where("lo <> hi").select("node")
    if not shared.isEmpty():
        clashes = scratch_table(shared, "shared-names")
        signed = scratch_table(_renamed(signed, clashes), "signatures")
        classes = classes_of(signed)
    linked = link_classes(docs, classes, clashes, id_col, text_col)
    firsts = classes.select("node", F.col("rep").alias("first")).join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = scratch_table(firsts, "firsts")
    least = scratch_table(firsts.groupBy("component").agg(F.min("first").alias("component_id")), "least-ids")
    named = firsts.join(least, "component").select("node", "component_id", F.lit(True).alias("known"))
    rows = signed.select("id", "n", "node").join(named, "node", "left")
    rows = rows.select("id", F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return rows.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
