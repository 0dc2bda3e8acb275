"""Segments, windows of scenes, merging of adjacent scenes, as-of and overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed_split(rows: DataFrame, key: str, duration: Column, width: float = 35.0, least: float = 0.3) -> DataFrame:
    """``key, segment, start, end``: segments of ``width`` seconds; a rest of at most ``least`` is dropped."""
    d = rows.select(key, duration.cast("double").alias("d"))
    rest = F.col("d") - F.floor(F.col("d") / width) * width
    n = (F.floor(F.col("d") / width) + F.when(rest > least, 1).otherwise(0)).cast("int")
    cut = d.withColumn("n", n).where("n > 0").select(key, "d", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("segment"))
    return cut.select(key, "segment", (F.col("segment") * width).alias("start"), F.least((F.col("segment") + 1) * width, F.col("d")).alias("end"))


def scene_windows(scenes: DataFrame, video: str = "video", order: str = "ord", size: int = 3, stride: int = 2) -> DataFrame:
    """``video, window, first``: runs of ``size`` scenes every ``stride``, and one more for a tail not covered.

    With fewer scenes than ``size`` there is one window of all of them; ``n_scenes`` is its length.
    """
    counts = scenes.groupBy(video).agg(F.count("*").cast("int").alias("n"))
    n = F.least(F.col("n"), F.lit(size))
    starts = F.sequence(F.lit(0), F.col("n") - n, F.lit(stride))
    last = F.element_at(starts, -1)
    starts = F.when(last + n < F.col("n"), F.concat(starts, F.array(F.col("n") - n))).otherwise(starts)
    return counts.select(video, n.alias("n_scenes"), F.posexplode(starts).alias("window", "first"))


def window_members(windows: DataFrame, scenes: DataFrame, video: str = "video", order: str = "ord") -> DataFrame:
    """Each window with its scenes: the window's places are exploded and joined on (video, ord)."""
    places = windows.withColumn(order, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n_scenes") - 1)))
    return places.join(scenes, [video, order])


#: Seconds of a range of time: windows are taken within ranges, and what a range needs of those before or behind it is carried
#: over from one row a range. So a key with most rows is spread over many tasks.
RANGE_SECONDS = 3600.0
_NO_TIME = -(1 << 62)


def _ranged(rows: DataFrame, at: str, width: float) -> DataFrame:
    return rows.withColumn("_b", F.coalesce(F.floor(F.col(at) / width), F.lit(_NO_TIME)).cast("long"))


def _with_carried(rows: DataFrame, keys: list[str], of_range: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """``rows`` (with ``_b``) with ``carried``, which are windows over the ranges' aggregates ``of_range``; null keys are keys."""
    ranges = rows.groupBy(*keys, "_b").agg(*(c.alias(n) for n, c in of_range.items()))
    own = ranges.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_rb"), *(c.alias(n) for n, c in carried.items()))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = rows.join(own, [*same, F.col("_b") == F.col("_rb")] if keys else F.col("_b") == F.col("_rb"))
    return joined.drop("_rb", *(f"_k{i}" for i in range(len(keys))))


def clip_ends(clips: DataFrame, keys: list[str], start: str = "start", order: list[str] | None = None, gap: float = 1.0, last: float = 30.0, width: float = RANGE_SECONDS) -> DataFrame:
    """``ord, end``: one second before the next start; the last clip, and one whose end would not follow its start, 30 s."""
    w = Window.partitionBy(*keys, "_b").orderBy(start, *(order or []))
    v = Window.partitionBy(*keys).orderBy("_b")
    before = F.coalesce(F.sum("_n").over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = _with_carried(_ranged(clips, start, width), keys, {"_n": F.count("*"), "_low": F.min(start)}, {"_before": before, "_next": F.lead("_low").over(v)})
    end = F.coalesce(F.lead(start).over(w), F.col("_next")) - gap
    made = rows.withColumn("ord", (F.col("_before") + F.row_number().over(w) - 1).cast("int")).withColumn("end", F.when(end > F.col(start), end).otherwise(F.col(start) + last))
    return made.drop("_b", "_before", "_next")


def merge_consecutive(scenes: DataFrame, keys: list[str], max_gap: float = 1.0, least: int = 2, most: int = 5, how: str = "max", width: float = RANGE_SECONDS) -> DataFrame:
    """Runs of scenes with gaps of 0 to ``max_gap`` become one, at most ``most`` at a time; smaller runs stay single.

    Returns ``keys, start, end, scenes, n, score``: the end is the last scene's, the score the members' ``how`` (max, avg, sum).
    """
    w = Window.partitionBy(*keys, "_b").orderBy("start", "scene")
    v = Window.partitionBy(*keys).orderBy("_b")
    earlier = v.rowsBetween(Window.unboundedPreceding, -1)
    of_range = {"_n": F.count("*"), "_end": F.max_by("end", F.struct("start", "scene"))}
    rows = _with_carried(_ranged(scenes, "start", width), keys, of_range, {"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_last": F.lag("_end").over(v)})
    rows = rows.withColumn("_rn", F.row_number().over(w))
    gap = F.col("start") - F.when(F.col("_rn") == 1, F.col("_last")).otherwise(F.lag("end").over(w))
    rows = rows.withColumn("_place", F.col("_before") + F.col("_rn") - 1).withColumn("_split", F.when(gap.between(0, max_gap), F.lit(None)).otherwise(F.col("_place")))
    rows = _with_carried(rows.drop("_before", "_last", "_rn"), keys, {"_s": F.max("_split")}, {"_open": F.max("_s").over(earlier)})
    island = F.coalesce(F.max("_split").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_open"))
    parts = rows.withColumn("_island", island).withColumn("_part", F.floor((F.col("_place") - F.col("_island")) / most))
    members = F.array_sort(F.collect_list(F.struct("_place", "start", "scene", "end", "score")), lambda a, b: (a["_place"] - b["_place"]).cast("int"))
    grouped = parts.groupBy(*keys, "_island", "_part").agg(members.alias("m"))  # at most ``most`` scenes
    runs = F.when(F.size("m") < least, F.transform("m", lambda x: F.array(x))).otherwise(F.array("m"))
    each = grouped.select(*keys, F.explode(runs).alias("m"))
    scores = F.filter(F.transform("m", lambda x: x["score"].cast("double")), lambda s: s.isNotNull())
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    score = {"max": F.array_max(scores), "sum": F.when(F.size(scores) > 0, total), "avg": F.try_divide(total, F.size(scores))}[how]
    return each.select(*keys, F.col("m")[0]["start"].alias("start"), F.element_at("m", -1)["end"].alias("end"), F.array_join(F.transform("m", lambda x: x["scene"].cast("string")), "_").alias("scenes"), F.size("m").alias("n"), score.alias("score"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str = "at", start: str = "start", width: float = RANGE_SECONDS) -> DataFrame:
    """``left`` with ``start``: the greatest right start not after ``at`` of the same keys, else the least; null without any.

    One sort of the union by time within the keys and ranges of ``width`` seconds; the last start before a range is carried over.
    """
    columns = [c for c in left.columns if c not in keys]
    rows = left.select(*keys, F.struct(*columns).alias("row"), F.col(at).cast("double").alias("_t"), F.lit(None).cast("double").alias("_start"), F.lit(1).alias("_side"))
    clips = right.where(F.col(start).isNotNull()).select(*keys, F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.col(start).cast("double").alias("_t"), F.col(start).cast("double").alias("_start"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_side")
    every = Window.partitionBy(*keys)
    earlier = every.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    both = _with_carried(_ranged(rows.union(clips), "_t", width), keys, {"_top": F.max("_start"), "_low": F.min("_start")}, {"_held": F.max("_top").over(earlier), "_least": F.min("_low").over(every)})
    inside = F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_best", F.coalesce(inside, "_held", "_least")).where("_side = 1").select(*keys, "row.*", F.col("_best").alias(start))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of closed intervals (start, end) and (r_start, r_end) of the same keys that meet.

    Both sides are exploded to the buckets of ``width`` seconds they touch, so the join is an equi-join even where one key
    has many intervals; a pair counts in the first bucket both touch.
    """
    bucket = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    x = left.withColumn("_b", bucket(F.col("start"), F.col("end")))
    y = right.withColumn("_b", bucket(F.col("r_start"), F.col("r_end")))
    met = x.join(y, [*keys, "_b"]).where("end >= r_start AND start <= r_end")
    return met.where(F.col("_b") == F.floor(F.greatest("start", "r_start") / width)).drop("_b")
