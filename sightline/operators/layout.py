"""Neighbour graphs, and a layout of them: where the points of a cloud lie in two dimensions.

Neighbours are exact. Points are dealt into blocks by a hash of their ids, and each pair of blocks meets once, in one task, for both
directions, as matrix products of bounded tiles; only the ``k`` best of each point and other block go on. So the arithmetic is that of all
pairs, but what is shuffled are the points once a block, of some 65,000 points with 64 components. (A descent over neighbours of
neighbours joined some 9 k^2 offers a point with both vectors, and found 0.63 of the neighbours of vectors without clusters.)

The layout takes the leading directions in which a walk along the graph mixes slowest: power iteration of the graph's smoothing,
one join and one sum a round, with the constant direction taken out and the two kept at right angles. All sums are rounded, so
every run gives the same numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import EPSILON, double, norm
from ..sources.tables import written
from .ranking import _unit_rows, top_k

DIGITS = 10

#: Numbers of a block's vectors (32 MB); blocks at least of a table of ``BLOCKS`` thousand points or more, so that small ones are spread too.
BLOCK, BLOCKS = 1 << 22, 8

#: Points of the two sides of a tile (16 MB of cosines).
TILE = 1024, 4096


def _drawn(of: Column, salt: int) -> Column:
    """A number from 0 to 1 by a hash."""
    return F.pmod(F.xxhash64(of, F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)


def _update(best: np.ndarray, at: np.ndarray, near: np.ndarray, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
    """Puts what is better into the k ``best`` cosines of each row of x and the ids ``at`` them.

    ``near`` has the cosines of x and y in single precision; what by its greatest error may be better is computed again in double.
    ``ids``, those of y, ascend and are greater than those seen before, so of equal cosines those that are there stay.
    """
    k, most = best.shape[1], (x.shape[1] + 4) * 2.0**-23
    over = near > (best[:, -1:] - most).astype(np.float32)
    many = np.flatnonzero(np.count_nonzero(over, axis=1) > 8 * k)
    if len(many):
        v = np.where(np.isneginf(near[many]), -np.inf, np.round(x[many] @ y.T, 12))
        kth = np.partition(v, -k, axis=1)[:, -k, None]
        more, equal = v > kth, v == kth
        over[many] = more | (equal & (np.cumsum(equal, axis=1) <= k - more.sum(1, keepdims=True)))
    flat = np.flatnonzero(over.ravel(order="K"))
    row, column = divmod(flat, over.shape[1]) if over.flags.c_contiguous else divmod(flat, over.shape[0])[::-1]
    score = np.round(np.einsum("ij,ij->i", x[row], y[column]), 12)
    better = score > best[row, -1]
    row, column, score = row[better], column[better], score[better]
    asked = np.unique(row)
    if not len(asked):
        return
    rows = np.concatenate([asked.repeat(k), row])
    score = np.concatenate([best[asked].ravel(), score])
    other = np.concatenate([at[asked].ravel(), ids[column]])
    order = np.lexsort((other, -score, rows))
    kept = order[np.searchsorted(rows[order], asked)[:, None] + np.arange(k)]
    best[asked], at[asked] = score[kept], other[kept]


def _meet(k: int, tile: tuple[int, int]):
    """The k best others of each point of a pair of blocks in the other block (or in the one, if they are the same)."""

    def sides(points):
        place = points.column("place").to_numpy()
        for number in np.unique(place):
            own = points.filter(place == number).sort_by("id")
            ids = own.column("id").to_numpy()
            yield ids, _unit_rows(own.column("vec")), np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def run(key, points):
        import pyarrow as pa

        both, same = list(sides(points)), key[1].as_py() == key[2].as_py()
        if len(both) == 2 or same:
            (u, x, of_u, at_u), (v, y, of_v, at_v) = both[0], both[-1]
            x32, y32 = x.astype(np.float32), y.astype(np.float32)
            for a in range(0, len(u), tile[0]):
                for b in range(0, len(v), tile[1]):
                    i, j = slice(a, a + tile[0]), slice(b, b + tile[1])
                    near = x32[i] @ y32[j].T
                    if same and a < b + tile[1] and b < a + tile[0]:
                        near[u[i, None] == v[None, j]] = -np.inf
                    _update(of_u[i], at_u[i], near, x[i], y[j], v[j])
                    if not same:
                        _update(of_v[j], at_v[j], near.T, y[j], x[i], u[i])
        else:
            both = []
        found = [(ids[row], at[row, column], best[row, column]) for ids, _, best, at in both for row, column in [np.nonzero(best > -np.inf)]]
        joined = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in joined], names=["u", "v", "score"])

    return run


def neighbours(rows: DataFrame, id_col: str, vec_col: str, k: int = 10, block: int = BLOCK, tile: tuple[int, int] = TILE) -> DataFrame:
    """``u, v, score, rank``: the k nearest others of each point by cosine (rounded to 12 digits), ties by the smaller id.

    block: numbers that the vectors of a block hold at most, about; tile: points that are compared at once. Points without an id or
    direction are left out; ids must be different. Vectors of different lengths are not compared.
    """
    single = rows.schema[vec_col].dataType.elementType.typeName() == "float"
    vec = F.col(vec_col) if single else double(F.col(vec_col))
    own = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    own = own.where(norm(double(F.col("vec"))).between(EPSILON, 1e300))
    points = written(own.select("id", "vec", F.size("vec").alias("width")), "points")
    n, width = points.agg(F.count("*"), F.coalesce(F.max("width"), F.lit(1))).first()
    blocks = max(1, min(BLOCKS, n // 1024), -(-n * width // block))
    dealt = points.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("width", F.least("place", "other").alias("i"), F.greatest("place", "other").alias("j"), "place", "id", "vec")
    met = dealt.groupBy("width", "i", "j").applyInArrow(_meet(k, tile), "u long, v long, score double")
    return top_k(met, ["u"], [F.desc("score"), F.asc("v")], k)


def layout(graph: DataFrame, rounds: int = 40) -> DataFrame:
    """``id, x, y``: unit coordinates of the nodes of a graph (u, v), the slowest directions of its lazy walk.

    Edges count in both directions. Coordinates have a spread of 1 over all nodes; a graph of two nodes or fewer has zeros.
    """
    edges = graph.select("u", "v").union(graph.select("v", "u")).where("u <> v").distinct()
    edges = written(edges.toDF("u", "v"), "edges")
    nodes = written(edges.groupBy(F.col("u").alias("id")).agg(F.sqrt(F.count("*")).alias("d")), "nodes")
    n = nodes.count()
    if n <= 2:
        return nodes.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    weight = nodes.agg(F.sum(F.col("d") * F.col("d"))).first()[0]
    at = _straight(nodes.select("id", "d", (_drawn(F.col("id"), 1) - 0.5).alias("x"), (_drawn(F.col("id"), 2) - 0.5).alias("y")), weight)
    for _ in range(rounds):
        sent = edges.join(at.select(F.col("id").alias("v"), *(F.round(F.col(c) / F.col("d"), DIGITS + 2).alias(c) for c in "xy")), "v")
        summed = sent.groupBy(F.col("u").alias("id")).agg(*(F.sum(F.col(c).cast("decimal(30,14)")).cast("double").alias(f"s{c}") for c in "xy"))
        moved = at.join(summed, "id").select("id", "d", *((0.5 * F.col(c) + 0.5 * F.col(f"s{c}") / F.col("d")).alias(c) for c in "xy"))
        at = _straight(moved, weight)
    return at.select("id", *(F.round(F.col(c) / F.col("d") * float(weight) ** 0.5, 6).alias(c) for c in "xy"))


def _straight(at: DataFrame, weight: float) -> DataFrame:
    """Without the constant direction (which is ``d``), at right angles and of length 1; sums are exact, of rounded terms."""
    at = written(at, "moved")
    exact = lambda c: F.sum(F.round(c, DIGITS + 4).cast("decimal(30,14)")).cast("double")
    mx, my = at.agg(exact(F.col("x") * F.col("d")), exact(F.col("y") * F.col("d"))).first()
    at = at.withColumn("x", F.col("x") - F.lit(mx / weight) * F.col("d")).withColumn("y", F.col("y") - F.lit(my / weight) * F.col("d"))
    xx, xy = at.agg(exact(F.col("x") * F.col("x")), exact(F.col("x") * F.col("y"))).first()
    at = at.withColumn("y", F.col("y") - F.lit(xy / (xx or 1.0)) * F.col("x"))
    (yy,) = at.agg(exact(F.col("y") * F.col("y"))).first()
    return written(at.select("id", "d", *(F.round(F.col(c) / F.lit((s or 1.0) ** 0.5), DIGITS).alias(c) for c, s in (("x", xx), ("y", yy)))), "straight")
