"""Hierarchical retrieval: videos, then windows or scenes, fused over modalities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm
from ..operators.ranking import _best, _unit_rows, rrf, top_k
from ..sources.tables import small, written


def with_norm(rows: DataFrame, vec: str = "vec") -> DataFrame:
    return rows.withColumn("norm", norm(F.col(vec)))


def scored(candidates: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Cosine scores of candidates (keys, modality, item, vec, norm) against queries (qid, modality, vec, norm) on ``keys``.

    An item without a vector of a modality has no row, and so no score.
    """
    q = queries.select("qid", "modality", *[k for k in keys if k not in ("qid", "modality")], F.col("vec").alias("q_vec"), F.col("norm").alias("q_norm"))
    joined = candidates.join(q, keys)
    return joined.withColumn("score", F.round(cosine(F.col("vec"), F.col("q_vec"), F.col("norm"), F.col("q_norm")), 12)).drop("vec", "norm", "q_vec", "q_norm")


def _vectors_of(rows: DataFrame, key: str) -> DataFrame:
    """``key, vecs``: the vectors of a key, one a modality."""
    return rows.groupBy(key).agg(F.collect_list(F.struct("modality", "vec")).alias("vecs"))


def top_videos(videos: DataFrame, queries: DataFrame, k: int, plans: DataFrame | None = None) -> DataFrame:
    """``qid, video, score, video_rank``: the k best videos by rank fusion over modalities, scored in blocks.

    With plans (qid, c) only videos (with ``day``) that a query's constraints allow; all of them where none is. Times and relations
    of a plan need clips' times, see ``search.planned_search``.
    """
    from .search import CONSTRAINTS, permitted_videos

    about = F.col("day") if plans is not None else F.lit(None).cast("string")
    rows = _vectors_of(videos, "video")
    days = videos.select("video", about.alias("day")).distinct()
    rows = rows.join(days, "video").withColumn("start", F.lit(None).cast("double")).withColumn("tags", F.lit(None).cast("array<string>"))
    asked = _vectors_of(queries, "qid").withColumn("tags", F.lit(None).cast("array<string>"))
    asked = asked.withColumn("c", F.lit(None).cast(CONSTRAINTS)) if plans is None else asked.join(plans.select("qid", F.col("c").cast(CONSTRAINTS).alias("c")), "qid")
    return permitted_videos(rows, asked, k)


def planned_videos(videos: DataFrame, queries: DataFrame, plans: DataFrame, k: int) -> DataFrame:
    """As :func:`top_videos` over the videos of the days that each query's constraints (plans: qid, c) allow."""
    return top_videos(videos, queries, k, plans)


def with_scores(rows: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with their ``score``, 0 where they have none."""
    return rows.join(scores, keys, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


#: Rows and queries of a block: with 64 components, some 4 MB a side.
ITEMS_A_BLOCK, QUERIES_A_BLOCK = 8_192, 8_192


def _best_places(k: int, permitted, step: int = 256):
    """The k best items of a block for each of its queries; ``permitted`` gives which a query allows as a matrix [query, item]."""

    def run(items, asked):
        import pyarrow as pa

        out = []
        if items.num_rows and asked.num_rows:
            place, vectors = items.column("place").to_numpy(), _unit_rows(items.column("vec"))
            allowed = None if permitted is None else permitted(items, asked)
            wanted = _unit_rows(asked.column("vec"))
            for a in range(0, len(wanted), step):
                values = np.round(wanted[a : a + step] @ vectors.T, 12)
                if allowed is not None:
                    values[~allowed[a : a + step]] = -np.inf
                row, column = _best(values, place, k)
                kept = np.isfinite(values[row, column])
                row, column = row[kept], column[kept]
                out.append((a + row, place[column], values[row, column]))
        row, at, score = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        kept = asked.select(["qid", "video", "modality", "video_rank"]).take(pa.array(row, pa.int64()))
        return kept.append_column("place", pa.array(at, pa.int64())).append_column("score", pa.array(score, pa.float64()))

    return run


def best_in_videos(items: DataFrame, place: str, chosen: DataFrame, queries: DataFrame, k: int, permitted=None, about: tuple[str, ...] = (), item_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """``qid, video, modality, video_rank, place, score``: the k best items of each chosen video and modality by cosine, ties by place.

    items: video, place, modality, vec and what ``permitted`` reads. chosen: qid, video, video_rank and the columns ``about``, which are
    handed to ``permitted`` as well. A video's items of a modality and the queries that chose it are cut into blocks by their
    counted numbers; a block of both is a matrix in one task and gives k rows a query on, so pairs are never rows.
    """
    keys = ["video", "modality"]
    fresh = lambda rows: rows.select(*(F.col(c).alias(c) for c in rows.columns))  # noqa: E731  items and queries may come from one table
    own = fresh(items.withColumnRenamed(place, "place")).withColumn("place", F.col("place").cast("long")).where("place IS NOT NULL AND vec IS NOT NULL")
    asked = fresh(chosen.select("qid", "video", "video_rank", *about)).join(fresh(queries.select("qid", "modality", "vec")), "qid")
    sized = lambda rows, block, name: rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = sized(own, item_block or ITEMS_A_BLOCK, "_ni").join(sized(asked, query_block or QUERIES_A_BLOCK, "_nq"), keys)
    sizes = small(written(sizes, "sizes"))
    number = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = own.join(sizes, keys).withColumn("_i", number("place", "_ni")).withColumn("_q", every("_nq")).drop("_ni", "_nq")
    right = asked.join(sizes, keys).withColumn("_q", number("qid", "_nq")).withColumn("_i", every("_ni")).drop("_ni", "_nq")
    block = [F.col(c).alias(f"_{c}") for c in keys] + [F.col("_i").alias("_bi"), F.col("_q").alias("_bq")]
    dealt = lambda rows: fresh(rows).select("*", *block).groupBy("_video", "_modality", "_bi", "_bq")
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("qid", "video", "modality", "video_rank")) + ", place long, score double"
    found = dealt(left).cogroup(dealt(right)).applyInArrow(_best_places(k, permitted), schema)
    return top_k(found, ["qid", "video", "modality"], [F.desc("score"), F.asc("place")], k)


def fused_places(ranked: DataFrame, place: str, k: int, name: str = "rank") -> DataFrame:
    """``qid, video, video_rank, place, score, rank`` of lists by modality; ties of fused scores go by video rank and place."""
    fused = rrf(ranked.withColumnRenamed("place", place), ["qid", "video", "video_rank", place])
    return top_k(fused, ["qid"], [F.desc("score"), F.asc("video_rank"), F.asc(place)], k, name)


def top_scenes(scenes: DataFrame, chosen: DataFrame, queries: DataFrame, k: int, on: tuple[str, ...] = ("video",)) -> DataFrame:
    """``qid, video, ord, score, rank``: the k best scenes of each query's chosen videos, or scenes (qid, *on, video_rank).

    In each video, the lists of 2k scenes of each modality are fused; ties of fused scores go by video rank and order.
    """
    if tuple(on) == ("video",):
        return fused_places(best_in_videos(scenes.select("video", "ord", "modality", "vec"), "ord", chosen, queries, 2 * k), "ord", k)
    candidates = scenes.join(chosen.select("qid", *on, "video_rank"), [*on])
    ranked = top_k(scored(candidates, queries, ["qid", "modality"]), ["qid", "video", "modality"], [F.desc("score"), F.asc("ord")], 2 * k)
    fused = rrf(ranked, ["qid", "video", "video_rank", "ord"])
    return top_k(fused, ["qid"], [F.desc("score"), F.asc("video_rank"), F.asc("ord")], k)


def top_windows(windows: DataFrame, chosen: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``qid, video, window, score, rank``: the k best windows over all chosen videos."""
    return fused_places(best_in_videos(windows.select("video", "window", "modality", "vec"), "window", chosen, queries, k), "window", k)
