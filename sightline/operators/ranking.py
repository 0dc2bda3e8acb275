"""Exact top-k search and rank fusion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Row numbers from 1 within ``keys``; with ``k``, only the first k (planned as partial and final group limits)."""
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(name) <= k)


def rrf(ranked: DataFrame, keys: list[str], k: int = 60, rank: str = "rank") -> DataFrame:
    """Reciprocal rank fusion: ``keys, score`` = sum of 1 / (k + rank)."""
    return ranked.groupBy(*keys).agg(F.round(F.sum(F.lit(1.0) / (k + F.col(rank))), 9).alias("score"))


def min_max(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """``norm``: scores scaled to 0..1 within keys; constant ones become 1."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn("norm", F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(1.0)))


def fuse_scores(rows: DataFrame, list_keys: list[str], item_keys: list[str], how: str = "avg", normalise: bool = True) -> DataFrame:
    """Scores of the lists an item is in, min-max normalised or as they are, by avg, sum or max.

    Filling missing scores with the item's own mean and dividing by all lists gives the same number as ``avg``.
    """
    scored = min_max(rows, list_keys) if normalise else rows.withColumn("norm", F.col("score"))
    return scored.groupBy(*item_keys).agg(getattr(F, how)("norm").alias("score"))


def _best(values: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest values of each row, ties by the smaller item."""
    if values.shape[1] > k:
        row, column = np.nonzero(values >= np.partition(values, -k, axis=1)[:, -k, None])
    else:
        row, column = (x.ravel() for x in np.indices(values.shape))
    order = np.lexsort((item[column], -values[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], column[kept]


#: Items and queries of a block: with 64 components, some 10 MB a side.
ITEMS_A_BLOCK, QUERIES_A_BLOCK = 16_384, 16_384


def _unit_rows(column) -> np.ndarray:
    import pyarrow as pa

    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    vectors = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-8)


def _score_blocks(k: int, step: int):
    def run(items, queries):
        import pyarrow as pa

        out = []
        if items.num_rows and queries.num_rows:
            item, vectors = items.column("item").to_numpy(), _unit_rows(items.column("vec"))
            ids, matrix = queries.column("qid").to_numpy(), _unit_rows(queries.column("vec"))
            for a in range(0, len(ids), step):
                values = np.round(matrix[a : a + step] @ vectors.T, 12)
                row, column = _best(values, item, k)
                out.append((ids[a + row], item[column], values[row, column]))
        joined = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(x) for x in joined], names=["qid", "item", "score"])

    return run


def block_top_k(items: DataFrame, queries: DataFrame, k: int, id_col: str = "item", vec_col: str = "vec", block: int = 256, item_block: int = ITEMS_A_BLOCK, query_block: int = QUERIES_A_BLOCK) -> DataFrame:
    """``qid, item, rank, score`` of the k items most similar by cosine to each query.

    ``queries`` (qid, vec) is a stated query set of any size. Items and queries are dealt into blocks by a hash of their ids; each
    block of queries meets each block of items in one task, as matrix products, and the k best of each query and block of items
    are shuffled on. Only the numbers of rows reach the driver. Rows without an id or a vector are left out.
    """
    wanted = queries.select(F.col("qid").cast("long").alias("qid"), "vec").where("qid IS NOT NULL AND vec IS NOT NULL")
    own = items.select(F.col(id_col).cast("long").alias("item"), F.col(vec_col).alias("vec")).where("item IS NOT NULL AND vec IS NOT NULL")
    tasks = items.sparkSession.sparkContext.defaultParallelism
    n_items, n_queries = own.count(), max(1, -(-wanted.count() // query_block))
    least = max(1, min(tasks, n_items // 1024))  # small tables are spread over the cores all the same
    n_items = max(least, -(-n_items // item_block))
    place = lambda of, n: F.pmod(F.xxhash64(of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.withColumn("i", place("item", n_items)).withColumn("q", every(n_queries))
    right = wanted.withColumn("q", place("qid", n_queries)).withColumn("i", every(n_items))
    found = left.groupBy("i", "q").cogroup(right.groupBy("i", "q")).applyInArrow(_score_blocks(k, block), "qid long, item long, score double")
    return top_k(found, ["qid"], [F.desc("score"), F.asc("item")], k)


def _softmax_blocks(k: int, step: int):
    def run(items, queries):
        import pyarrow as pa

        out = []
        if items.num_rows and queries.num_rows:
            item, vectors = items.column("item").to_numpy(), _unit_rows(items.column("vec"))
            ids, matrix = queries.column("qid").to_numpy(), _unit_rows(queries.column("vec"))
            for a in range(0, len(ids), step):
                values = np.round(matrix[a : a + step] @ vectors.T, 12)
                total = np.exp(values).sum(1)  # cosines are at most 1, so nothing overflows
                row, column = _best(values, item, k)
                first = np.concatenate([[True], row[1:] != row[:-1]])
                out.append((ids[a + row], item[column], values[row, column], np.where(first, total[row], 0.0)))
        joined = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        return pa.table([pa.array(x) for x in joined], names=["qid", "item", "score", "total"])

    return run


def softmax_top_k(items: DataFrame, queries: DataFrame, group: str, k: int, item_block: int = ITEMS_A_BLOCK, query_block: int = QUERIES_A_BLOCK) -> DataFrame:
    """``qid, item, score, probability, rank``: the k best items of each query's group by cosine, with the softmax over all of it.

    items: item, group, vec; queries: qid, group, vec. A group is cut into blocks of items and of queries by its counted size;
    a block gives k rows a query, one of which carries the block's sum of exponentials.
    """
    own = items.select(F.col("item").alias("item"), F.col(group).alias("grp"), F.col("vec").alias("vec"))
    asked = queries.select(F.col("qid").alias("qid"), F.col(group).alias("grp"), F.col("vec").alias("vec"))
    sized = lambda rows, block, name: rows.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = sized(own, item_block, "_ni").join(sized(asked, query_block, "_nq"), "grp")
    place = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fresh = lambda rows, key: rows.join(sizes, "grp").select(F.col("grp").alias("g"), F.col(key).alias(key), F.col("vec").alias("vec"), "_ni", "_nq")
    left = fresh(own, "item").withColumn("i", place("item", "_ni")).withColumn("q", every("_nq")).drop("_ni", "_nq")
    right = fresh(asked, "qid").withColumn("q", place("qid", "_nq")).withColumn("i", every("_ni")).drop("_ni", "_nq")
    keys = ["g", "i", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_softmax_blocks(k, 256), "qid long, item long, score double, total double")
    rows = found.withColumn("total", F.sum("total").over(Window.partitionBy("qid")))
    return top_k(rows, ["qid"], [F.desc("score"), F.asc("item")], k).select("qid", "item", "score", (F.exp("score") / F.col("total")).alias("probability"), "rank")
