"""Updates inside nested annotations (videos, clips, annotations, queries), where they stand.

A video's changes come to it as a map by clip and query, and its arrays are transformed in place: order, places and all other
fields stay, and no query is ever a row. A map holds what changes in one video, which is at most as many as it has queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def videos_of(nlq: DataFrame) -> DataFrame:
    """``file, version, split, place, v``: a row a video of files read by the NLQ schema."""
    named = nlq if "file" in nlq.columns else nlq.withColumn("file", F.input_file_name())
    return named.select("file", "version", "split", F.posexplode("videos").alias("place", "v"))


def files_of(videos: DataFrame) -> DataFrame:
    """The files again, each with its videos in their order. A file was one row when it was read."""
    whole = videos.groupBy("file", "version", "split").agg(F.array_sort(F.collect_list(F.struct("place", "v")), lambda a, b: a["place"] - b["place"]).alias("vs"))
    return whole.select("file", "version", "split", F.transform("vs", lambda x: x["v"]).alias("videos"))


def _lookup(changes: DataFrame, value: str, seq: str, by_clip: bool) -> DataFrame:
    """``_video, _by_clip``: clip to query to the last value. Without clips, all stand under the empty name."""
    known = changes.where("video_uid IS NOT NULL AND query IS NOT NULL" + (" AND clip_uid IS NOT NULL" if by_clip else ""))
    clip = F.col("clip_uid") if by_clip else F.lit("")
    last = known.groupBy(F.col("video_uid").alias("_video"), clip.alias("_clip"), "query").agg(F.max_by(value, seq).alias("_new"))
    queries = last.groupBy("_video", "_clip").agg(F.map_from_entries(F.collect_list(F.struct("query", "_new"))).alias("_q"))
    return queries.groupBy("_video").agg(F.map_from_entries(F.collect_list(F.struct("_clip", "_q"))).alias("_by_clip"))


def each_query(video: Column, change) -> Column:
    """``video`` with each query replaced by ``change(clip, query)``."""
    clip = lambda c: c.withField("annotations", F.transform(c["annotations"], lambda a: a.withField("language_queries", F.transform(a["language_queries"], lambda q: change(c, q)))))
    return video.withField("clips", F.transform(video["clips"], clip))


def _hits(video: Column, found) -> tuple[Column, Column]:
    """How many queries a video has, and for how many ``found(clip, query)`` is there."""
    counts = F.flatten(F.transform(video["clips"], lambda c: F.flatten(F.transform(F.coalesce(c["annotations"], F.array()), lambda a: F.transform(F.coalesce(a["language_queries"], F.array()), lambda q: found(c, q).isNotNull())))))
    flags = F.coalesce(counts, F.array().cast("array<boolean>"))
    return F.size(flags), F.size(F.filter(flags, lambda x: x))


def replaced(videos: DataFrame, changes: DataFrame, value: str, seq: str = "seq", by_clip: bool = True) -> DataFrame:
    """``videos`` (with ``v``) after the changes, with ``n_queries`` and ``n_replaced`` of each video.

    changes: video_uid, clip_uid (if ``by_clip``), query, ``value``, ``seq``. A value that is a struct takes a whole entry's
    place; a text takes the query's text. The last by ``seq`` wins; several entries with the same query are all replaced. Null
    keys and null values change nothing; videos, clips and queries that no change names stay as they are.
    """
    whole = changes.schema[value].dataType.typeName() == "struct"
    joined = videos.join(_lookup(changes, value, seq, by_clip), F.col("v.video_uid") == F.col("_video"), "left")

    def found(c: Column, q: Column) -> Column:
        return F.try_element_at(F.try_element_at(F.col("_by_clip"), F.coalesce(c["clip_uid"], F.lit("")) if by_clip else F.lit("")), F.coalesce(q["query"], F.lit("\0")))

    change = (lambda c, q: F.coalesce(found(c, q), q)) if whole else (lambda c, q: q.withField("query", F.coalesce(found(c, q), q["query"])))
    total, hits = _hits(F.col("v"), found)
    rows = joined.withColumn("n_queries", total).withColumn("n_replaced", hits).withColumn("v", F.when(F.col("_by_clip").isNull(), F.col("v")).otherwise(each_query(F.col("v"), change)))
    return rows.drop("_video", "_by_clip")
