"""Connected components: alternating large-star and small-star steps in DataFrame operations, or a bounded union-find.

Graphs of at most LOCAL_EDGES edges, by count, are solved by union-find in one task; the rounds of the distributed way cost
more than the work there. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialise


#: Edges up to which one task solves the graph.
LOCAL_EDGES = 200_000


def _union_find(batches: Iterator) -> Iterator:
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    nodes = sorted(root)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "comp"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``node, comp`` (the component's smallest node) of every node of at least one edge between two nodes.

    Each round needs partial minima by node and a join; a hub's join is split by Spark's skew handling. The number of
    rounds grows with the logarithm of a component's size; the driver sees a count and a checksum of each.
    """
    edges = materialise(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct(), "edges")
    if local_edges and edges.limit(local_edges + 1).count() <= local_edges:
        return materialise(edges.coalesce(1).mapInArrow(frugal(_union_find), "node long, comp long"), "labels")
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = materialise(_small_star(_large_star(edges)).distinct(), "stars")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select("v", "v"))
    return materialise(ends.groupBy("node").agg(F.min("comp").alias("comp")), "labels")
