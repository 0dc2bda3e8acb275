"""Metrics over predictions (qid, rank, iou, hit columns) and all queries; a query without predictions counts as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import interval_iou
from .ranking import top_k


def per_query(queries: DataFrame, predictions: DataFrame, value: Column, default: float = 0.0) -> DataFrame:
    """``qid, value`` of every query; ``value`` aggregates its predictions."""
    found = predictions.groupBy("qid").agg(value.alias("value"))
    return queries.select("qid").join(found, "qid", "left").withColumn("value", F.coalesce("value", F.lit(default)).cast("double"))


def mean_over(queries: DataFrame, predictions: DataFrame, value: Column, name: str, default: float = 0.0) -> DataFrame:
    return per_query(queries, predictions, value, default).agg(F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias(name))


def recall_table(queries: DataFrame, predictions: DataFrame, ks: list[int], taus: list[float]) -> DataFrame:
    """``k, tau, recall``: share of queries with a prediction of rank <= k and IoU >= tau; one pass for all of them."""
    grid = [(k, t) for k in ks for t in taus]
    flags = [F.max(F.when((F.col("rank") <= k) & (F.col("iou") >= t), 1).otherwise(0)).alias(f"c{i}") for i, (k, t) in enumerate(grid)]
    hits = queries.select("qid").join(predictions.groupBy("qid").agg(*flags), "qid", "left")
    means = [F.struct(F.lit(k).alias("k"), F.lit(t).alias("tau"), F.round(F.avg(F.coalesce(f"c{i}", F.lit(0)).cast("double")), 6).alias("recall")) for i, (k, t) in enumerate(grid)]
    return hits.agg(F.array(*means).alias("r")).select(F.inline("r"))


def adjusted_rank() -> Column:
    """Rank of the best overlapping prediction, nearer to 1 the better it overlaps; one more than all without one."""
    best = F.max(F.when(F.col("iou") > 0, F.struct("iou", (-F.col("rank")).alias("r"))))
    rank = -best["r"]
    return F.coalesce(rank - best["iou"] * (rank - 1), F.count("*") + 1.0)


def repaired_truth(start: Column, end: Column) -> Column:
    """start, end and whether both were given: a missing or negative start is 0, such an end is the start."""
    a = F.when(start.isNull() | (start < 0), F.lit(0.0)).otherwise(start)
    b = F.when(end.isNull() | (end < 0), a).otherwise(end)
    return F.struct(a.alias("start"), b.alias("end"), F.coalesce((start >= 0) & (end >= 0), F.lit(False)).alias("valid"))


def truth_window(start: Column, end: Column, half: float = 0.5) -> Column:
    """A truth that is one moment (no end) as a window around it."""
    return F.struct(F.when(end.isNull(), start - half).otherwise(start).alias("start"), F.coalesce(end, start + half).alias("end"))


def best_iou(start: Column, end: Column, truths: Column) -> Column:
    """The greatest IoU with any of several truths (start, end); 0 without one."""
    return F.coalesce(F.array_max(F.transform(truths, lambda t: interval_iou(start, end, t["start"], t["end"]))), F.lit(0.0))


def flattened(results: DataFrame) -> DataFrame:
    """``qid, video, scene, score, rank``: scenes of all videos of a query (rows qid, video, score, scenes[(scene, score)]) ranked
    anew by score; a scene without a score has its video's."""
    each = results.select("qid", "video", F.col("score").alias("_v"), F.explode("scenes").alias("s")).where("s.scene IS NOT NULL")
    rows = each.select("qid", "video", F.col("s.scene").alias("scene"), F.coalesce("s.score", "_v").alias("score"))
    return top_k(rows, ["qid"], [F.desc("score"), F.asc("video"), F.asc("scene")])


def evaluation_stats(queries: DataFrame, predictions: DataFrame) -> DataFrame:
    """n queries (qid, start, end), how many lack predictions or a valid truth, and the mean number of predictions."""
    n = predictions.groupBy("qid").agg(F.count("*").alias("_n"))
    rows = queries.join(n, "qid", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("_n") == 0).alias("n_empty"), F.count_if(F.col("start") >= F.col("end")).alias("n_invalid"), F.round(F.avg("_n"), 6).alias("mean_predictions"))


def day_hit(days: Column, day: Column) -> Column:
    """Whether the plan's days have the truth's; null where the plan restricts nothing or the truth has no day."""
    return F.when((F.size(days) > 0) & (F.coalesce(day, F.lit("")) != ""), F.array_contains(days, F.upper(day)))


def time_hit(ranges: Column, at: Column) -> Column:
    """Whether the truth's time lies in one of the plan's ranges; null where the plan restricts nothing or it has no time."""
    return F.when((F.size(ranges) > 0) & at.isNotNull(), F.exists(ranges, lambda r: (r["s"] <= at) & (at <= r["e"])))


def accuracy_log(rows: DataFrame, label: str, day: str, time: str) -> DataFrame:
    """Counts of applied filters (hit is not null) and of hits by label and over all (label ``all``), with a line of text."""
    done = rows.rollup(label).agg(F.count("*").alias("n"), *(x for c, name in ((day, "day"), (time, "time")) for x in (F.count(c).alias(f"{name}_applied"), F.count_if(c).alias(f"{name}_hits"))))
    line = F.when(F.col("day_applied") == 0, "never").otherwise(F.format_string("%d/%d of %d", "day_hits", "day_applied", "n"))
    return done.withColumn(label, F.coalesce(label, F.lit("all"))).withColumn("day_line", line)
