"""An index for vector search: inverted lists with product-quantised residuals.

A vector belongs to the list of its nearest coarse centroid; its residual, in units of the list's usual distance (so that tight
lists are told apart as finely as wide ones), is cut into sub-vectors, each of which is replaced by its nearest code. A search visits the lists nearest to a query, estimates distances by adding up entries of the
query's table of code distances, and ranks the best candidates again by their true cosine.

Every row also keeps how far its replacement is from it, and every list its radius. By the triangle inequality these bound
true distances from below, so ``search(..., exact=True)`` can leave out lists and rows that cannot be among the k best and
still return what comparing all pairs would.

Centroids and codes are fitted on a bounded sample of rows (``Settings.sample``, by a hash of the id), in tasks; they are all
that the driver sees of the vectors. All rows are indexed. Queries are a table: a chunk of them meets a rack of lists in a task (lists,
a third of all rows perhaps, are cut into blocks), and a rack gives k rows a query on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import double, norm
from .ranking import _best, top_k


@dataclass(frozen=True)
class Settings:
    """lists: None takes the square root of the rows, up to ``most_lists``. recall: what the number of lists to visit is
    chosen for, on the sample. refine: candidates of a query that are ranked again, in multiples of k. block: rows of a list that stay together. rack: rows, and
    chunk: queries, that meet in a task (with 64 components some 70 MB and 4 MB)."""

    lists: int | None = None
    most_lists: int = 1024
    parts: int = 16
    codes: int = 256
    sample: int = 16_384
    rounds: int = 12
    recall: float = 0.97
    refine: int = 32
    seed: int = 7
    block: int = 16_384
    rack: int = 131_072
    chunk: int = 8_192


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None, :], 0.0)


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of at most k clusters: seeds drawn by their distance from the seeds before, then alternating rounds."""
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(x)))]
    away = distances(x, x[picked])[:, 0]
    while len(picked) < k and away.max() > 1e-12:
        picked.append(int(np.searchsorted(np.cumsum(away), rng.random() * away.sum(), side="right").clip(0, len(x) - 1)))
        away = np.minimum(away, distances(x, x[picked[-1:]])[:, 0])
    centres = x[picked].copy()
    for _ in range(rounds):
        nearest = distances(x, centres).argmin(1)
        sizes = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        moved = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        if np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    return centres


def lists_to_visit(x: np.ndarray, centres: np.ndarray, recall: float, seed: int, k: int = 10, queries: int = 512) -> int:
    """The least number of nearest lists that hold the share ``recall`` of the k nearest rows of x, for rows drawn from x.

    Neighbours in the whole table are nearer than those in a sample, so this is on the safe side.
    """
    asked = x[np.random.default_rng(seed).permutation(len(x))[:queries]]
    near = np.argsort(distances(asked, x), axis=1, kind="stable")[:, : k + 1]
    home = distances(x, centres).argmin(1)
    order = np.argsort(distances(asked, centres), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(asked), 0), 1)
    needed = np.sort(np.take_along_axis(place, home[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


@dataclass
class Index:
    """Tables at ``path``: ``rows`` (list, item, vec, codes, error), by list, and ``lists`` (list, size, radius); the model."""

    path: str
    spark: SparkSession
    centres: np.ndarray
    scales: np.ndarray
    codebooks: list[np.ndarray]
    visit: int
    settings: Settings = field(default_factory=Settings)

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column (no nulls), one a row."""
    import pyarrow as pa

    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def _vectors(x: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _unit(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``item, vec``: unit vectors; rows without an id or a direction are left out."""
    v = rows.select(F.col(id_col).cast("long").alias("item"), double(F.col(vec_col)).alias("vec")).where("item IS NOT NULL AND vec IS NOT NULL")
    length = norm(F.col("vec"))
    return v.withColumn("_n", length).where("_n > 1e-8").select("item", F.transform("vec", lambda x: x / F.col("_n")).alias("vec"))


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """The columns of x in ``parts`` nearly equal pieces; the first are the longer ones."""
    return np.array_split(x, parts, axis=1)


def _fit_centres(settings: Settings, lists: int):
    def run(table):
        import pyarrow as pa

        x = _matrix(table.column("vec"))[np.argsort(table.column("item").to_numpy(), kind="stable")]
        centres = lloyd(x, lists, settings.rounds, settings.seed)
        visit = lists_to_visit(x, centres, settings.recall, settings.seed)
        far = distances(x, centres)
        home = far.argmin(1)
        size = np.bincount(home, minlength=len(centres))
        usual = np.sqrt(np.bincount(home, far[np.arange(len(x)), home], minlength=len(centres)) / np.maximum(size, 1))
        scale = np.maximum(np.where(size > 1, usual, 1.0), 1e-3)
        return pa.table([pa.array(range(len(centres)), pa.int32()), _vectors(centres), pa.array(scale), pa.array([visit] * len(centres), pa.int32())], names=["list", "vec", "scale", "visit"])

    return run


def _residuals(x: np.ndarray, home: np.ndarray, coarse) -> np.ndarray:
    centres, scales = coarse.value
    return (x - centres[home]) / scales[home, None]


def _residual_pieces(coarse, parts: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                for part, piece in enumerate(_cut(_residuals(x, distances(x, coarse.value[0]).argmin(1), coarse), parts)):
                    yield pa.record_batch([pa.array([part] * len(x), pa.int32()), batch.column(0), _vectors(piece)], names=["part", "item", "piece"])

    return run


def _fit_codes(settings: Settings):
    def run(table):
        import pyarrow as pa

        x = _matrix(table.column("piece"))[np.argsort(table.column("item").to_numpy(), kind="stable")]
        codes = lloyd(x, settings.codes, settings.rounds, settings.seed)
        return pa.table([table.column("part")[:1].combine_chunks().take(pa.array([0] * len(codes))), pa.array(range(len(codes)), pa.int32()), _vectors(codes)], names=["part", "code", "vec"])

    return run


def _encode(coarse, books):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            far = distances(x, coarse.value[0])
            home = far.argmin(1)
            pieces = _cut(_residuals(x, home, coarse), len(books.value))
            codes = np.stack([distances(p, b).argmin(1) for p, b in zip(pieces, books.value)], axis=1).astype(np.uint8)
            error = coarse.value[1][home] * np.sqrt(sum(((p - b[codes[:, s]]) ** 2).sum(1) for s, (p, b) in enumerate(zip(pieces, books.value))))
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            radius = np.sqrt(far[np.arange(len(x)), home])
            yield pa.record_batch([pa.array(home.astype(np.int32)), batch.column(0), batch.column(1), packed, pa.array(error), pa.array(radius)], names=["list", "item", "vec", "codes", "error", "away"])

    return run


def build(rows: DataFrame, id_col: str, vec_col: str, path: str, settings: Settings = Settings()) -> Index:
    """Fits on the sample, then writes every row with a direction, partitioned by list (large lists in several files)."""
    if settings.codes > 256:
        raise ValueError("a code is one byte")
    spark = rows.sparkSession
    own = _unit(rows, id_col, vec_col)
    count = own.count()
    if not count:
        raise ValueError("no vectors to index")
    lists = settings.lists or max(1, min(settings.most_lists, round(count**0.5)))
    sample = own.where(F.pmod(F.xxhash64("item"), F.lit(max(1, count // settings.sample))) == 0)
    if sample.isEmpty():
        sample = own
    model = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fit_centres(settings, lists), "list int, vec array<double>, scale double, visit int").orderBy("list").collect()  # at most most_lists rows
    centres, scales = np.array([r.vec for r in model]), np.array([r.scale for r in model])
    parts = min(settings.parts, centres.shape[1])
    shared = spark.sparkContext.broadcast((centres, scales))
    pieces = sample.mapInArrow(_residual_pieces(shared, parts), "part int, item long, piece array<double>")
    codes = pieces.groupBy("part").applyInArrow(_fit_codes(settings), "part int, code int, vec array<double>").orderBy("part", "code").collect()  # parts x codes rows
    books = [np.array([r.vec for r in codes if r.part == s]) for s in range(parts)]
    encoded = own.mapInArrow(_encode(shared, spark.sparkContext.broadcast(books)), "list int, item long, vec array<double>, codes binary, error double, away double")
    encoded.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    stored.groupBy("list").agg(F.count("*").alias("size"), F.max("away").alias("radius")).coalesce(1).write.parquet(f"{path}/lists")
    named = [("centre", int(r.list), 0, [float(v) for v in r.vec]) for r in model] + [("code", int(r.part), int(r.code), [float(v) for v in r.vec]) for r in codes] + [("scale", 0, 0, scales.tolist()), ("visit", int(model[0].visit), 0, None)]
    spark.createDataFrame(named, "kind string, a int, b int, vec array<double>").coalesce(1).write.parquet(f"{path}/model")
    return Index(path, spark, centres, scales, books, int(model[0].visit), settings)


def open_index(spark: SparkSession, path: str, settings: Settings = Settings()) -> Index:
    """An index that was built at ``path``."""
    model = spark.read.parquet(f"{path}/model").orderBy("kind", "a", "b").collect()
    centres = np.array([r.vec for r in model if r.kind == "centre"])
    codes = [r for r in model if r.kind == "code"]
    books = [np.array([r.vec for r in codes if r.a == s]) for s in range(1 + max(r.a for r in codes))]
    scales = np.array(next(r.vec for r in model if r.kind == "scale"))
    return Index(path, spark, centres, scales, books, next(r.a for r in model if r.kind == "visit"), settings)


def _reached(q: np.ndarray, centres: np.ndarray, radii: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """[q, list]: the list can hold a vector at most ``reach`` away from the query."""
    return np.sqrt(distances(q, centres)) - radii[None, :] <= reach[:, None]


def _lists_within(centres, radii, rows: int = 256):
    """``qid, q, reach, list``: what ``_reached`` leaves of the lists, as rows, to see how many an exact search reads."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (b.slice(a, rows) for b in batches for a in range(0, b.num_rows, rows)):
            row, number = np.nonzero(_reached(_matrix(batch.column(1)), centres.value, radii.value, batch.column(2).to_numpy()))
            at = pa.array(row)
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(number.astype(np.int32))], names=["qid", "q", "reach", "list"])

    return run


def _lists_of(far: np.ndarray, sizes: np.ndarray, visit: int, k: int) -> np.ndarray:
    """[q, list]: the ``visit`` nearest lists of each query, and more of them while they hold fewer than k rows."""
    order = np.argsort(far, axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1)
    wanted = np.maximum(visit, (held < k).sum(1) + 1).clip(max=order.shape[1])
    out = np.zeros(far.shape, bool)
    np.put_along_axis(out, order, np.arange(order.shape[1])[None, :] < wanted[:, None], 1)
    return out


def _estimates(q: np.ndarray, centre: np.ndarray, scale: float, books: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Squared distances of all queries to the replacements of all rows of a list, from the queries' tables."""
    total = np.zeros((len(q), len(codes)))
    for s, (piece, book) in enumerate(zip(_cut((q - centre) / scale, len(books)), books)):
        total += distances(piece, book)[:, codes[:, s]]
    return total * scale**2


class _Rack:
    """Rows of several lists in one task, by list: ``parts`` are the lists' numbers and ranges."""

    def __init__(self, rows):
        number = rows.column("list").to_numpy()
        order = np.argsort(number, kind="stable")
        self.item, self.error = (rows.column(c).to_numpy()[order] for c in ("item", "error"))
        self.vec = _matrix(rows.column("vec"))[order]
        self.codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(rows.num_rows, -1)[order]
        held, first = np.unique(number[order], return_index=True)
        self.parts = list(zip(held.tolist(), first.tolist(), [*first[1:].tolist(), rows.num_rows]))


def _nearest_rows(rack: _Rack, q: np.ndarray, wanted: np.ndarray, model, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and cosine of the ``keep`` rows nearest to each query by estimate, in the lists that it wants."""
    (centres, scales), books = model
    best, at = np.full((len(q), keep), np.inf), np.full((len(q), keep), -1)
    for number, first, end in rack.parts:
        asks = np.flatnonzero(wanted[:, number])
        if not len(asks):
            continue
        far = _estimates(q[asks], centres[number], scales[number], books, rack.codes[first:end])
        nearer = far.min(1) < best[asks].max(1)
        asks, far = asks[nearer], far[nearer]
        both = np.concatenate([best[asks], far], axis=1)
        rows = np.concatenate([at[asks], np.arange(first, end)[None, :].repeat(len(asks), 0)], axis=1)
        kept = np.argpartition(both, keep - 1, axis=1)[:, :keep]
        best[asks], at[asks] = np.take_along_axis(both, kept, 1), np.take_along_axis(rows, kept, 1)
    row, column = np.nonzero(at >= 0)
    at = at[row, column]
    return row, at, np.einsum("ij,ij->i", q[row], rack.vec[at])


def _rows_within(rack: _Rack, q: np.ndarray, wanted: np.ndarray, model, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and cosine of the k best rows of each list for each query, of those that their bounds leave within its reach."""
    (centres, scales), books = model
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for number, first, end in rack.parts:
        asks = np.flatnonzero(wanted[:, number])
        if not len(asks):
            continue
        far = _estimates(q[asks], centres[number], scales[number], books, rack.codes[first:end])
        out_of_reach = np.sqrt(far) - rack.error[None, first:end] > reach[asks, None]
        values = np.round(q[asks] @ rack.vec[first:end].T, 12)
        values[out_of_reach] = -np.inf
        row, column = _best(values, rack.item[first:end], k)
        score = values[row, column]
        kept = np.isfinite(score)
        found.append((asks[row[kept]], first + column[kept], score[kept]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _scan(coarse, books, held, visit: int, k: int, keep: int | None, step: int = 64):
    """The k best of a rack's rows for each query of a chunk: of the ``keep`` nearest by estimate, or of all that can be within reach."""

    def run(asked, rows):
        import pyarrow as pa

        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asked.num_rows and rows.num_rows:
            rack, model = _Rack(rows), (coarse.value, books.value)
            sizes, radii = held.value
            qid, queries = asked.column("qid").to_numpy(), _matrix(asked.column("q"))
            for a in range(0, len(queries), step):
                q = queries[a : a + step]
                if keep is None:
                    reach = asked.column("reach").to_numpy()[a : a + step]
                    row, at, score = _rows_within(rack, q, _reached(q, coarse.value[0], radii, reach), model, reach, k)
                else:
                    row, at, score = _nearest_rows(rack, q, _lists_of(distances(q, coarse.value[0]), sizes, visit, k), model, keep)
                score, item = np.round(score, 12), rack.item[at]
                order = np.lexsort((item, -score, row))
                row, item, score = row[order], item[order], score[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append((qid[a + row[first]], item[first], score[first]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], names=["qid", "item", "score"])

    return run


def _found(index: Index, asked: DataFrame, held: tuple[np.ndarray, np.ndarray], visit: int, k: int, keep: int | None) -> DataFrame:
    """``qid, item, score, rank`` of asked (qid, q[, reach]): chunks of queries meet racks of lists, and k rows a query and rack go on.

    Lists, large ones in blocks, are dealt into racks, with their vectors, so what is shuffled are the rows once a chunk and the queries
    once a rack; candidates stay in their task.
    """
    context, s = index.spark.sparkContext, index.settings
    racks = max(1, -(-int(held[0].sum()) // s.rack))
    chunks = max(1, -(-asked.count() // s.chunk), -(-context.defaultParallelism // racks))
    blocks = F.broadcast(index.lists.select("list", F.ceil(F.col("size") / s.block).cast("int").alias("blocks")))  # at most most_lists rows
    number = lambda n, *of: F.pmod(F.xxhash64(*of), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("chunk", number(F.lit(chunks), "qid")).withColumn("rack", every(racks))
    right = index.rows.select("list", "item", "vec", "codes", "error").join(blocks, "list").withColumn("rack", number(F.lit(racks), "list", number(F.col("blocks"), "item"))).drop("blocks").withColumn("chunk", every(chunks))
    scan = _scan(context.broadcast((index.centres, index.scales)), context.broadcast(index.codebooks), context.broadcast(held), visit, k, keep)
    found = left.groupBy("rack", "chunk").cogroup(right.groupBy("rack", "chunk")).applyInArrow(scan, "qid long, item long, score double")
    return top_k(found, ["qid"], [F.desc("score"), F.asc("item")], k)


def search(index: Index, queries: DataFrame, k: int = 10, visit: int | None = None, exact: bool = False) -> DataFrame:
    """``qid, item, score, rank``: the k most similar rows of each query (qid, vec) by cosine, ties by the smaller item.

    By default the ``visit`` nearest lists are read (as many as the sample asked for), and ``refine`` times k candidates of each rack
    ranked again. ``exact``: what that finds limits how far away a row of the true list can be; all rows which their bounds
    leave within that distance are ranked, so the result is the one of comparing all pairs. Queries and rows without a
    direction have no result.
    """
    asked = _unit(queries, "qid", "vec").select(F.col("item").alias("qid"), F.col("vec").alias("q"))
    lists = len(index.centres)
    radii, sizes = np.full(lists, -np.inf), np.zeros(lists, np.int64)
    for r in index.lists.collect():  # at most most_lists rows
        radii[r["list"]], sizes[r["list"]] = r["radius"], r["size"]
    visit, keep = min(visit or index.visit, lists), k * index.settings.refine
    found = _found(index, asked, (sizes, radii), visit, k, keep)
    if not exact:
        return found
    # The k-th best score so far; without k candidates, any direction can be in the list.
    worst = found.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    reach = F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))) + 1e-5).otherwise(F.lit(3.0))
    limited = asked.join(worst, "qid", "left").select("qid", "q", F.coalesce(reach, F.lit(3.0)).alias("reach"))
    return _found(index, limited, (sizes, radii), visit, k, None)
