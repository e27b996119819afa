"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shipped
from ._common import scratch_table


#: Edges that one task contracts at most, about; its memory follows from this.
EDGES_PER_TASK = 500_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: a spanning forest of each task's share. Groups that many lists have found
    over and over come down to about one edge for each node."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            a, b = [], []
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                if (p := root(x)) != (q := root(y)):
                    up[max(p, q)] = min(p, q)
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held = scratch_table(edges.select("a", "b"), "found-edges")
    return held.repartition(-(-held.count() // EDGES_PER_TASK) or 1).transform(shipped).mapInArrow(forest, "a long, b long")


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge (a, b); component is the least node reachable.

    Each round takes the least label among a node and its neighbours, then the label of that label, and is written to
    the shared folder; labels fall until a round changes none, in about the logarithm of the longest path. One
    count for each round reaches the driver.
    """
    kept = scratch_table(contracted(edges), "kept-edges")
    both = kept.union(kept.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch_table(both, "edges")
    labels = scratch_table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        step = scratch_table(step, "step")
        jump = step.select(F.col("node").alias("now"), F.col("now").alias("far"))
        step = scratch_table(step.join(jump, "now", "left").select("node", "was", F.least("now", F.coalesce("far", "now")).alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("was <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
