"""Scenes of videos: payloads, sources, stages of encoding, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pooling import mean_vectors
from ..functions.vectors import l2_normalise

#: A scene's payload before anything is encoded.
PAYLOAD = {"video": "array<double>", "audio": "array<double>", "text": "array<double>", "text_raw": "string", "caption_text": "string", "transcript": "string", "tags": "array<string>"}
BLANK = ("text_raw", "caption_text", "transcript")


def with_payload(scenes: DataFrame) -> DataFrame:
    """Missing payload columns as nulls, or empty texts; ``meta`` is the scene's own laid over what is stored (``stored_meta``)."""
    for name, kind in PAYLOAD.items():
        empty = F.lit("") if name in BLANK else F.lit(None)
        scenes = scenes.withColumn(name, F.coalesce(F.col(name), empty).cast(kind) if name in scenes.columns else empty.cast(kind))
    none = F.create_map().cast("map<string,string>")
    old, new = (F.coalesce(F.col(c).cast("map<string,string>"), none) for c in ("stored_meta", "meta"))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return scenes.withColumn("meta", F.map_concat(kept, new)).drop("stored_meta")


def source_range(scene: Column, video_path: Column) -> Column:
    """path, start and end to encode a scene from: its own source where it has one."""
    return F.struct(
        F.coalesce(F.nullif(scene["source_path"], F.lit("")), video_path).alias("path"),
        F.coalesce(scene["source_start"], scene["start"]).cast("double").alias("start"),
        F.coalesce(scene["source_end"], scene["end"]).cast("double").alias("end"),
    )


def at_times(scene: Column, start: Column, end: Column) -> Column:
    """The scene with other times."""
    return scene.withField("start", start).withField("end", end)


def narrated(caption: Column, meta: Column) -> Column:
    """A stated narration in place of the caption."""
    return F.coalesce(F.nullif(F.try_element_at(meta, F.lit("narration")), F.lit("")), caption)


def text_step(text_raw: Column, *fresh: Column) -> Column:
    """``reuse`` a text that is there, unless anything new has come; else ``generate`` one."""
    new = F.lit(False)
    for c in fresh:
        new = new | (F.coalesce(c, F.lit("")) != "")
    return F.when(new | (F.coalesce(text_raw, F.lit("")) == ""), "generate").otherwise("reuse")


def stages_needed(videos: DataFrame, scenes: DataFrame, stages: list[str], key: str = "video") -> DataFrame:
    """``key`` and, for each stage's column, whether neither the video nor any of its scenes has a value."""
    have = lambda s: F.max(F.col(s).isNotNull()).alias(s)
    all_ = videos.select(key, *stages).union(scenes.select(key, *stages))
    found = all_.groupBy(key).agg(*(have(s) for s in stages))
    return found.select(key, *((~F.col(s)).alias(f"need_{s}") for s in stages))


def promoted(videos: DataFrame, scenes: DataFrame, key: str, vecs: list[str]) -> DataFrame:
    """``videos`` whose missing vectors are those of their first scene (``ord`` 0)."""
    first = scenes.where("ord = 0").select(key, *(F.col(v).alias(f"_{v}") for v in vecs)).dropDuplicates([key])
    joined = videos.join(first, key, "left")
    for v in vecs:
        joined = joined.withColumn(v, F.coalesce(v, f"_{v}")).drop(f"_{v}")
    return joined


def prototypes(rows: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """``keys, vec``: the unit vector of the mean of the unit vectors."""
    means = mean_vectors(rows.withColumn(vec, l2_normalise(F.col(vec))), keys, vec)
    return means.withColumn("vec", l2_normalise(F.col("vec")))


#: What stands in the place of a text that was pooled from vectors.
POOLED = "[mean pooled: no texts]"


def window_texts(places: DataFrame, scenes: DataFrame) -> DataFrame:
    """``video, window, texts, text, vec``: what a window's text vector is made from.

    places: video, window, ord. scenes: video, ord, text_raw, vec (of the text; null if there is none). ``texts``: the scenes'
    texts in order, for an encoder of their summary. A window without any falls back to the mean of its scenes' vectors, with
    ``POOLED`` as text; without vectors its text is empty and its vector null. Windows whose scenes are unknown stay, too.
    """
    members = places.join(scenes, ["video", "ord"], "left")
    said = F.when(F.coalesce("text_raw", F.lit("")) != "", F.struct("ord", F.col("text_raw").alias("text")))
    listed = members.groupBy("video", "window").agg(F.array_sort(F.collect_list(said)).alias("t"), F.max(F.col("vec").isNotNull()).alias("some"))  # a window's scenes
    texts = listed.select("video", "window", "some", F.transform("t", lambda x: x["text"]).alias("texts"))
    bare = texts.where((F.size("texts") == 0) & F.coalesce("some", F.lit(False))).select("video", "window")
    pooled = mean_vectors(members.where("vec IS NOT NULL").join(bare, ["video", "window"], "left_semi"), ["video", "window"], "vec")
    text = F.when(F.size("texts") > 0, F.array_join("texts", "\n")).when(F.coalesce("some", F.lit(False)), POOLED).otherwise("")
    return texts.join(pooled, ["video", "window"], "left").select("video", "window", "texts", text.alias("text"), "vec")
