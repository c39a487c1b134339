"""Connected components of undirected edges, by union-find and, for what one task must not hold, alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

#: Edges that one task may hold: two longs each, and a tree of as many nodes.
ONE_TASK = 1_000_000


def union_find(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """The smallest member of each node's component; nodes that are their own root are left out."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top and up != x:
            parent[x] = top
            x = up
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def _forest(edges: DataFrame) -> DataFrame:
    """Union-find within each partition: edges (node, root of its component there)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = union_find(p for b in it for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["a", "b"])

    ship(edges.sparkSession)
    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _stars(edges: DataFrame) -> DataFrame:
    """A large star and a small star: every node moves to the least node it knows of."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = materialize(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "large")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
    return materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small")


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, component (the smallest node reachable) for every node with an edge to a smaller component; a, b are bigint.

    Partitions shrink their edges to forests first. What remains goes to one task only if it is few enough; else the
    stars are drawn until nothing changes, in about log(nodes) rounds.
    """
    forest = materialize(_forest(edges), "forest")
    if forest.count() <= one_task:
        found = _forest(forest.coalesce(1))
    else:
        now, mark = forest, None
        while True:
            now = _stars(now)
            seen = now.agg(F.count("*").alias("n"), F.sum("b").alias("s")).first()
            if (seen["n"], seen["s"]) == mark:
                break
            mark = (seen["n"], seen["s"])
        found = now
    return materialize(found.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
