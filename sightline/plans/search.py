"""Retrieval that obeys each query's plan: tags, days, ranges of time and relation choose videos, windows and scenes; the plan's
switches say whether a query goes through windows and which modalities count.

Videos and queries meet in blocks: what a query allows is a matrix of its block, and so are the scores, so pairs of queries and videos are
never rows. Whether any video passes a filter is found by a first pass, for a filter that leaves nothing is not applied.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import shares_tag
from ..operators.ranking import _best, rrf, top_k
from ..sources.tables import written
from .retrieval import best_in_videos, fused_places, top_scenes

CLIP_SECONDS = 30.0

#: What ``planner.constraints`` gives.
CONSTRAINTS = "struct<query_date:string,query_time_sec:double,allowed_days:array<string>,ranges:array<struct<s:double,e:double>>,relation:string>"
ITEMS_A_BLOCK, QUERIES_A_BLOCK = 4_096, 4_096


def _tagged(items: list, wanted: list) -> np.ndarray:
    """[q, i]: the item shares a tag with the query, case apart; all do where the query wants none."""
    where: dict[str, list[int]] = {}
    for n, tags in enumerate(items):
        for tag in {t.lower() for t in tags or [] if t is not None}:
            where.setdefault(tag, []).append(n)
    out = np.zeros((len(wanted), len(items)), bool)
    for q, tags in enumerate(wanted):
        if not tags:
            out[q] = True
        for tag in {t.lower() for t in tags or [] if t is not None}:
            out[q, where.get(tag, [])] = True
    return out


def _dated(days: list, constraints: list) -> np.ndarray:
    """[q, i]: the item's day is among the query's; all are where the query names none."""
    names = np.array([d or "" for d in days])
    return np.stack([np.isin(names, c["allowed_days"]) if c and c["allowed_days"] else np.ones(len(names), bool) for c in constraints])


def _timed(starts: np.ndarray, constraints: list) -> np.ndarray:
    """[q, i]: the clip of 30 s meets one of the query's ranges, if there are some, and its relation to the query's time."""
    out = np.ones((len(constraints), len(starts)), bool)
    ends = starts + CLIP_SECONDS
    for q, c in enumerate(constraints):
        if not c:
            continue
        if c["ranges"]:
            out[q] = np.any([(ends >= r["s"]) & (starts <= r["e"]) for r in c["ranges"]], axis=0)
        at = c["query_time_sec"]
        if at is not None and at > 0:
            if c["relation"] == "before_query_time":
                out[q] &= starts <= at
            if c["relation"] == "after_query_time":
                out[q] &= ends >= at
        out[q] |= np.isnan(starts)
    return out


def _masks(items, asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    constraints = asked.column("c").to_pylist()
    starts = np.array([np.nan if s is None else s for s in items.column("start").to_pylist()], float)
    return _tagged(items.column("tags").to_pylist(), asked.column("tags").to_pylist()), _dated(items.column("day").to_pylist(), constraints), _timed(starts, constraints)


def _any_left(items, asked):
    """Whether a block has videos of the query's days, of its times, and of both."""
    import pyarrow as pa

    if not items.num_rows or not asked.num_rows:
        return pa.table({"qid": pa.array([], pa.int64()), "day": pa.array([], pa.bool_()), "time": pa.array([], pa.bool_()), "both": pa.array([], pa.bool_())})
    tagged, dated, timed = _masks(items, asked)
    return pa.table([asked.column("qid"), *(pa.array((tagged & m).any(1)) for m in (dated, timed, dated & timed))], names=["qid", "day", "time", "both"])


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)


def _scores(k: int):
    def run(items, asked):
        import pyarrow as pa

        out = []
        if items.num_rows and asked.num_rows:
            tagged, dated, timed = _masks(items, asked)
            flag = lambda name: np.array(asked.column(name).to_pylist(), bool)[:, None]
            days = np.where(flag("day"), dated, True)
            times = np.where(np.where(flag("day"), flag("both"), flag("time")), timed, True)
            allowed = tagged & days & times
            names = items.column("video").to_pylist()
            order = np.argsort(np.argsort(np.array(names)))
            qid = asked.column("qid").to_numpy()
            of_items, of_queries = ([dict((v["modality"], v["vec"]) for v in row) for row in t.column("vecs").to_pylist()] for t in (items, asked))
            for modality in sorted({m for row in of_queries for m in row}):
                i, q = ([n for n, row in enumerate(rows) if modality in row] for rows in (of_items, of_queries))
                if not i or not q:
                    continue
                values = np.round(_unit([of_queries[n][modality] for n in q]) @ _unit([of_items[n][modality] for n in i]).T, 12)
                values = np.where(allowed[np.ix_(q, i)], values, -np.inf)
                row, column = _best(values, order[i], k)
                kept = np.isfinite(values[row, column])
                out += [(int(qid[q[r]]), modality, names[i[c]], float(values[r, c])) for r, c in zip(row[kept].tolist(), column[kept].tolist())]
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.float64()))], names=["qid", "modality", "video", "score"])

    return run


def permitted_videos(videos: DataFrame, asked: DataFrame, k: int, item_block: int = ITEMS_A_BLOCK, query_block: int = QUERIES_A_BLOCK) -> DataFrame:
    """``qid, video, score, video_rank``: the k best videos by rank fusion, of those that the query allows.

    videos: video, day, start (either may be null), tags, vecs (array of modality, vec). asked: qid, c (``planner.constraints`` or
    null), tags, vecs. Tags always hold; days, and then times, only if some video is left.
    """
    tasks = videos.sparkSession.sparkContext.defaultParallelism
    n_videos, n_asked = videos.count(), max(1, -(-asked.count() // query_block))
    n_videos = max(1, min(tasks, n_videos // 512), -(-n_videos // item_block))
    place = lambda of, n: F.pmod(F.xxhash64(of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = videos.withColumn("i", place("video", n_videos)).withColumn("b", every(n_asked)).groupBy("i", "b")
    blocks = lambda rows: rows.withColumn("b", place("qid", n_asked)).withColumn("i", every(n_videos)).groupBy("i", "b")
    flags = left.cogroup(blocks(asked)).applyInArrow(_any_left, "qid long, day boolean, time boolean, both boolean")
    flags = flags.groupBy("qid").agg(*(F.max(c).alias(c) for c in ("day", "time", "both")))
    known = written(asked.join(flags, "qid"), "asked")
    found = left.cogroup(blocks(known)).applyInArrow(_scores(k), "qid long, modality string, video string, score double")
    ranked = top_k(found, ["qid", "modality"], [F.desc("score"), F.asc("video")], k)
    return top_k(rrf(ranked, ["qid", "video"]), ["qid"], [F.desc("score"), F.asc("video")], k, "video_rank")


def _met(items, asked) -> np.ndarray:
    """[q, i]: the window meets the query's days, ranges and relation, as ``filters.in_window``, and shares a wanted tag."""
    out = _sharing(items, asked)
    days, at_day = np.unique(np.array([d or "" for d in items.column("day").to_pylist()]), return_inverse=True)
    start, end = (np.array([np.nan if t is None else t for t in items.column(c).to_pylist()], float) for c in ("start", "end"))
    for q, c in enumerate(asked.column("c").to_pylist()):
        if not c:
            continue
        if c["allowed_days"] and None not in c["allowed_days"]:
            out[q] &= np.array([not d or d in c["allowed_days"] for d in days])[at_day]
        if c["ranges"]:
            bounds = [(-np.inf if r["s"] is None else r["s"], np.inf if r["e"] is None else r["e"]) for r in c["ranges"]]
            out[q] &= np.any([~(end < s) & ~(start > e) for s, e in bounds], axis=0)
        at = c["query_time_sec"]
        if at is not None and at > 0 and c["relation"] in ("before_query_time", "after_query_time"):
            stands = ~(start > at) if c["relation"] == "before_query_time" else ~(end < at)
            out[q] &= ~np.array([bool(d) and d.upper() == (c["query_date"] or "").upper() for d in days])[at_day] | stands
    return out


def _sharing(items, asked) -> np.ndarray:
    return _tagged(items.column("tags").to_pylist(), asked.column("wanted").to_pylist())


def permitted_windows(windows: DataFrame, chosen: DataFrame, queries: DataFrame, plans: DataFrame, k: int) -> DataFrame:
    """``qid, video, video_rank, window``: the k best windows over a query's chosen videos that meet its days, times and tags.

    windows: video, window, modality, vec, norm, day, start, end (seconds of the day), tags.
    """
    wanted = chosen.select("qid", "video", "video_rank").join(plans.select("qid", F.col("c").cast(CONSTRAINTS).alias("c"), F.col("tags").alias("wanted")), "qid")
    own = windows.select("video", "window", "modality", "vec", "day", "start", "end", "tags")
    ranked = best_in_videos(own, "window", wanted, queries, k, _met, ("c", "wanted"))
    return fused_places(ranked, "window", k).select("qid", "video", "video_rank", "window")


def planned_search(videos: DataFrame, windows: DataFrame, places: DataFrame, scenes: DataFrame, queries: DataFrame, plans: DataFrame, k_videos: int = 3, k_windows: int = 2, k_scenes: int = 5, only_planned: bool = False) -> DataFrame:
    """``qid, video, ord, score, rank, by``: the best scenes of each query under its plan, and whether they came through windows.

    plans: qid, c (constraints), s (switches), tags. queries: qid, modality, vec, norm. places: video, window, ord. scenes: video, ord,
    modality, vec, norm, tags. Queries whose windows are all ruled out are answered from their videos' scenes. ``only_planned``
    leaves out modalities behind the first of a plan's order, which are all kept otherwise.
    """
    own = queries.join(plans.select("qid", "s"), "qid")
    if only_planned:
        own = own.where(F.col("modality") == F.col("s.modalities")[0])
    own = written(own.drop("s"), "queries")
    asked = own.groupBy("qid").agg(F.collect_list(F.struct("modality", "vec")).alias("vecs")).join(plans.select("qid", "c", "tags"), "qid")  # a row a modality
    chosen = written(permitted_videos(videos, asked, k_videos).select("qid", "video", "video_rank"), "chosen")
    through = chosen.join(plans.where("s.use_windows").select("qid"), "qid", "left_semi")
    best = written(permitted_windows(windows, through, own, plans, k_windows), "windows")
    inside = best.join(places, ["video", "window"]).select("qid", "video", "video_rank", "ord").distinct()
    straight = chosen.join(best.select("qid").distinct(), "qid", "left_anti")
    tags = plans.select("qid", F.col("tags").alias("wanted"))
    kept = scenes.join(inside, ["video", "ord"]).join(tags, "qid").where(shares_tag(F.col("tags"), F.col("wanted")))  # a few windows a query
    found = top_scenes(scenes.drop("tags"), kept.select("qid", "video", "ord", "video_rank").distinct(), own, k_scenes, ("video", "ord")).withColumn("by", F.lit("windows"))
    ranked = best_in_videos(scenes.select("video", "ord", "modality", "vec", "tags"), "ord", straight.join(tags, "qid"), own, 2 * k_scenes, _sharing, ("wanted",))
    return found.union(fused_places(ranked, "ord", k_scenes).withColumn("by", F.lit("videos")).select(*found.columns))
