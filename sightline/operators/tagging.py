"""Tags from similarities, co-occurrence boosts and tag statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import top_k


def tags_by_quantile(scores: DataFrame, keys: list[str], quantile: float = 0.70, least: float = 0.10, most: int = 10) -> DataFrame:
    """Rows (keys, tag, score) over both the quantile (linear interpolation) of their key's scores and ``least``; the best ``most``."""
    limits = scores.groupBy(*keys).agg(F.greatest(F.percentile("score", F.lit(quantile)), F.lit(least)).alias("limit"))
    return top_k(scores.join(limits, keys).where("score > limit").drop("limit"), keys, [F.desc("score"), F.asc("tag")], most)


def frame_tags(frames: DataFrame, keys: list[str], quantile: float = 0.75, least: float = 0.10, present: float = 0.05) -> DataFrame:
    """Tags of sets of frames from rows (keys, tag, score) of each frame: 0.8 max + 0.2 mean over the quantile limit, with at
    least ``present`` of the frames over 0.8 of it."""
    each = frames.groupBy(*keys, "tag").agg((0.8 * F.max("score") + 0.2 * F.avg("score")).alias("score"))
    limits = each.groupBy(*keys).agg(F.greatest(F.percentile("score", F.lit(quantile)), F.lit(least)).alias("limit"))
    share = frames.join(limits, keys).groupBy(*keys, "tag").agg(F.avg((F.col("score") > 0.8 * F.col("limit")).cast("double")).alias("share"))
    return each.join(limits, keys).where("score > limit").join(share, [*keys, "tag"]).where(F.col("share") >= present).drop("limit")


def co_occurrence(scores: DataFrame, groups: DataFrame, item: str = "item") -> DataFrame:
    """``boosted`` = score x (1 + 0.1 x the sum over the tag's groups of how many other tags of the item are in it)."""
    member = scores.join(F.broadcast(groups), "tag")  # the group vocabulary is fixed
    others = member.withColumn("c", F.count("*").over(Window.partitionBy(item, "grp")) - 1)
    boost = others.groupBy(item, "tag").agg(F.sum("c").alias("boost"))
    return scores.join(boost, [item, "tag"], "left").withColumn("boosted", F.col("score") * (1 + 0.1 * F.coalesce("boost", F.lit(0))))


def tag_statistics(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """``category, tag, n, in_category``: how often each tag, and each tag's prefix, occurs."""
    each = rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    each = each.withColumn("category", F.split_part("tag", F.lit("_"), F.lit(1)))
    return each.withColumn("in_category", F.sum("n").over(Window.partitionBy("category")))


def query_tags(queries: DataFrame, scores: DataFrame, **limits) -> DataFrame:
    """``qid, tags, scores`` of every query, best first; queries with a blank text (or no scores) have empty lists."""
    best = tags_by_quantile(scores, ["qid"], **limits).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.lower("tag").alias("tag"), "score"))).alias("_best"))
    joined = queries.select("qid", "query_text").join(best, "qid", "left")
    known = F.when(F.trim(F.coalesce("query_text", F.lit(""))) != "", F.col("_best"))
    pick = lambda c, t: F.coalesce(F.transform(known, lambda x: x[c]), F.array().cast(f"array<{t}>"))
    return joined.select("qid", pick("tag", "string").alias("tags"), pick("score", "double").alias("scores"))


def tag_levels(frames: DataFrame, levels: dict[str, list[str]], **limits) -> DataFrame:
    """``level, name, tag, score`` of sets of frames at each level; ``levels`` gives the columns that name a level's sets."""
    rows = None
    for level, keys in levels.items():
        found = frame_tags(frames.select(*keys, "tag", "score"), keys, **limits)
        named = found.select(F.lit(level).alias("level"), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("name"), "tag", "score")
        rows = named if rows is None else rows.union(named)
    return rows


def tag_matches(tags: Column, wanted: Column, score: Column) -> Column:
    """How many wanted tags are there, their share, and the score raised by a tenth for each."""
    n = F.size(F.array_intersect(tags, wanted))
    return F.struct(n.cast("long").alias("n"), F.coalesce(F.try_divide(n, F.size(wanted)), F.lit(0.0)).alias("share"), (score * (1 + 0.1 * n)).alias("score"))
