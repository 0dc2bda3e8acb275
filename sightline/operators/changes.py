"""Content-based scenes: the cheapest segmentation of a video's vectors, with long videos spread over many tasks.

A scene costs the squared distances of its vectors to their mean, plus a penalty; it has ``least`` to ``most`` vectors. The
cheapest cost up to a place depends on those of the ``most`` places before it only, so it is a product of matrices in (min, +) algebra:

1. each range of places gives the matrix of costs from each last cut before the range to each last cut at its end,
2. the matrices of a video's ranges, a few numbers each, are multiplied in order: the costs at every border,
3. with these, each range finds where each place's scene begins, and which cut before the range each cut at its end leads back to,
4. the borders are walked back from the video's end, and each range from its own last cut.

So the cuts are those of the whole video, wherever the borders lie. Costs come from running sums of vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


@dataclass(frozen=True)
class Settings:
    """penalty: the cost of a further scene. least, most: vectors of a scene (most >= 2 * least, so every length can be cut).
    width: places of a range; videos of over ``ranges`` ranges get wider ones, so the borders of a video fit one task."""

    penalty: float = 1.0
    least: int = 2
    most: int = 32
    width: int = 4_096
    ranges: int = 1_024

    def __post_init__(self):
        if not 1 <= self.least or self.most < 2 * self.least or self.width < self.most:
            raise ValueError("1 <= least, 2 * least <= most <= width")


class Costs:
    """The costs of scenes [s, t) of a stretch of vectors that begins at place ``first``; rounded, so that ties are ties."""

    def __init__(self, vectors: np.ndarray, first: int, penalty: float):
        self.first, self.penalty = first, penalty
        self.sums = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0)])
        self.squares = np.concatenate([[0.0], np.cumsum((vectors * vectors).sum(1))])

    def of(self, low: int, high: int, t: int) -> np.ndarray:
        """Of the scenes from each s in [low, high) to t."""
        a, b, e = low - self.first, high - self.first, t - self.first
        between = self.sums[e] - self.sums[a:b]
        size = e - np.arange(a, b)
        return np.round(self.squares[e] - self.squares[a:b] - (between * between).sum(1) / size, 9) + self.penalty


def border_costs(costs: Costs, a: int, b: int, least: int, most: int) -> np.ndarray:
    """[j, i]: the cost of the cheapest scenes from a cut at a - j to a last cut at b - i, with cuts between at places in (a, b]."""
    best = np.full((most, most + b - a), np.inf)  # columns: places a - most + 1 .. b
    zero = a - most + 1
    best[np.arange(most), a - np.arange(most) - zero] = 0.0
    for t in range(a + 1, b + 1):
        low, high = max(zero, costs.first, t - most), t - least + 1
        if low < high:
            best[:, t - zero] = (best[:, low - zero : high - zero] + costs.of(low, high, t)).min(1)
    return best[:, b - zero - np.arange(most)]


def cheapest(costs: Costs, before: np.ndarray, a: int, b: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """From the costs of cuts at a - j: where the last scene before each place of (a, b] begins (-1: nowhere), and for each cut at b - i
    the j of the cut it leads back to. Ties: the earliest beginning."""
    zero = a - most + 1
    best = np.full(most + b - a, np.inf)
    best[:most] = before[::-1]
    begin = np.full(b - a, -1, dtype=np.int64)
    enters = np.concatenate([np.arange(most - 1, -1, -1), np.full(b - a, -1)])
    for t in range(a + 1, b + 1):
        low, high = max(zero, costs.first, t - most), t - least + 1
        if low < high:
            total = best[low - zero : high - zero] + costs.of(low, high, t)
            at = int(total.argmin())
            if np.isfinite(total[at]):
                best[t - zero], begin[t - a - 1], enters[t - zero] = total[at], low + at, enters[low + at - zero]
    return begin, enters[b - zero - np.arange(most)]


def _part(table, settings: Settings):
    """The vectors of a range and those before it: (costs, range's first place, one after its last)."""
    place = table.column("place").to_numpy()
    order = np.argsort(place, kind="stable")
    vectors = np.array(table.column("vec").to_pylist(), dtype=np.float64)[order]
    a = int(table.column("range")[0].as_py()) * int(table.column("width")[0].as_py())
    return Costs(vectors, int(place[order[0]]), settings.penalty), a, int(place[order[-1]]) + 1


def _border_costs(settings: Settings):
    def run(table):
        import pyarrow as pa

        costs, a, b = _part(table, settings)
        found = border_costs(costs, a, b, settings.least, settings.most)
        return pa.table([table.column("video")[:1], table.column("range")[:1], pa.array([found.ravel().tolist()], pa.list_(pa.float64()))], names=["video", "range", "costs"])

    return run


def _at_borders(settings: Settings):
    """The costs of the cuts before each range: products of the ranges' matrices from the video's beginning on."""

    def run(table):
        import pyarrow as pa

        pairs = sorted(zip(table.column("range").to_pylist(), table.column("costs").to_pylist()))
        before, out = np.full(settings.most, np.inf), []
        before[0] = 0.0
        for _, flat in pairs:
            out.append(before.tolist())
            before = (before[:, None] + np.array(flat).reshape(settings.most, -1)).min(0)
        return pa.table([table.column("video"), pa.array([r for r, _ in pairs], pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=["video", "range", "before"])

    return run


def _begins(settings: Settings):
    def run(table):
        import pyarrow as pa

        costs, a, b = _part(table, settings)
        before = np.array(table.column("before")[0].as_py())
        begin, enters = cheapest(costs, before, a, b, settings.least, settings.most)
        return pa.table([table.column("video")[:1], table.column("range")[:1], pa.array([a], pa.int64()), pa.array([begin.tolist()], pa.list_(pa.int64())), pa.array([enters.tolist()], pa.list_(pa.int64()))], names=["video", "range", "a", "begin", "enters"])

    return run


def _last_cuts(table):
    """Which cut at each range's end is on the cheapest way: from the video's end backwards."""
    import pyarrow as pa

    pairs = sorted(zip(table.column("range").to_pylist(), table.column("enters").to_pylist()), reverse=True)
    last, out = 0, []
    for _, enters in pairs:
        out.append(last)
        last = enters[last]
    return pa.table([table.column("video"), pa.array([r for r, _ in pairs], pa.int64()), pa.array(out, pa.int64())], names=["video", "range", "last"])


def _walked(table):
    """``video, first, after`` of the scenes that end in a range."""
    import pyarrow as pa

    a, begin = table.column("a")[0].as_py(), table.column("begin")[0].as_py()
    t, scenes = a + len(begin) - table.column("last")[0].as_py(), []
    while t > a:
        scenes.append((begin[t - a - 1], t))
        t = scenes[-1][0]
    video = table.column("video")[:1].combine_chunks().take(pa.array([0] * len(scenes), pa.int64()))
    return pa.table([video, pa.array([s for s, _ in scenes], pa.int64()), pa.array([e for _, e in scenes], pa.int64())], names=["video", "first", "after"])


def content_scenes(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``video, scene, first, after``: the cheapest scenes, places [first, after), of rows (video, place, vec).

    Places run from 0 without gaps within a video (``views.numbered`` makes them). A video with fewer than ``least`` vectors is
    one scene. Ties go to the earlier beginning. Rows without a video or vector must be taken out before places are given.
    """
    kind = rows.schema["video"].dataType.simpleString()
    sizes = rows.groupBy("video").agg(F.count("*").alias("n"))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    width = max(settings.width, -(-longest // settings.ranges))
    short = sizes.where(F.col("n") < settings.least).select("video", F.lit(0).cast("long").alias("first"), F.col("n").alias("after"))
    own = rows.select("video", F.col("place").cast("long").alias("place"), F.col("vec").cast("array<double>").alias("vec"), F.lit(width).cast("long").alias("width"))
    home = F.floor(F.col("place") / width)
    # The vectors before a range, of which its first scenes may begin.
    ranges = F.when(F.col("place") >= (home + 1) * width - settings.most, F.array(home, home + 1)).otherwise(F.array(home))
    spread = own.join(sizes.where(F.col("n") >= settings.least), "video").withColumn("range", F.explode(ranges)).where(F.col("range") * width < F.col("n")).drop("n")
    keys = ["video", "range"]
    matrices = spread.groupBy(*keys).applyInArrow(_border_costs(settings), f"video {kind}, range long, costs array<double>")
    borders = matrices.groupBy("video").applyInArrow(_at_borders(settings), f"video {kind}, range long, before array<double>")
    begins = written(spread.join(borders, keys).groupBy(*keys).applyInArrow(_begins(settings), f"video {kind}, range long, a long, begin array<long>, enters array<long>"), "begins")
    last = begins.select(*keys, "enters").groupBy("video").applyInArrow(_last_cuts, f"video {kind}, range long, last long")
    cuts = begins.drop("enters").join(last, keys).groupBy(*keys).applyInArrow(_walked, f"video {kind}, first long, after long").union(short)
    # Scenes are numbered by the places they begin at; a video has fewer of them than vectors by a factor, and no vectors go along.
    return _numbered(cuts, width)


def _numbered(cuts: DataFrame, width: int) -> DataFrame:
    from ..sources.views import numbered

    return numbered(cuts, "video", "first", width).select("video", F.col("place").cast("long").alias("scene"), "first", "after")
