"""Substring deduplication by paragraph MinHash banding (operator 5).

Two kinds of units are compared, both by the same method: MinHash bands tuned for recall, exact Jaccard similarity of the
units that collide, components of the confirmed links.

* Paragraphs: lines of at least ``min_words`` words. A line of over ``cut_words`` words is cut at those sentence ends whose
  last words' hash falls into one of ``cut_share`` classes, so where it is cut depends on the words there only.
* Windows: a passage that is spliced into other text, or wrapped otherwise, makes no similar line. So runs of
  ``window_words`` words are taken, across lines, from anchors that the words alone decide: the least shingle hash of every
  ``reach`` successive ones. Equal runs of ``run_words`` words hold an equal window wherever they stand. A passage of 50
  words or more that is edited to a similarity of 0.8 has, between the edits, a run of half its words at least: so edited
  passages are caught too, in the parts that stayed (tests measure how many).

All units come from one pass over the texts and are written once. Equal word sequences are one node (a 64-bit hash, with 32
further bits wherever members are counted). All but the first unit of each component are removed. Windows inside removed
paragraphs are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_dup
from . import shingles as sh
from .common import BROADCAST_ROWS, bounded_broadcast, fresh, frugal, materialise, release, slices


def tuned_bands(limit: float, rows: int, recall: float) -> int:
    """The fewest bands of ``rows`` samples in which a pair at the limit collides with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - limit**rows))


@dataclass(frozen=True)
class Settings:
    """Two samples a band are enough: shingles of five words are rarely shared by chance, so few buckets mix strangers.

    A window's one band is of its anchor and ``window_rows`` samples: it has to bring equal windows together.
    """

    min_words: int = 20
    cut_words: int = 100
    cut_share: int = 4
    words: int = 5
    num: int = 80
    den: int = 100
    rows: int = 2
    recall: float = 0.999
    run_words: int = 36
    window_words: int = 20
    window_rows: int = 3

    @property
    def reach(self) -> int:
        """Shingles among which one is an anchor: its window still ends within the run."""
        return self.run_words - self.window_words + 1

    @property
    def bands(self) -> int:
        return tuned_bands(self.num / self.den, self.rows, self.recall)

    def near(self, window: bool) -> near_dup.Settings:
        bands, rows = (1, self.window_rows) if window else (self.bands, self.rows)
        return near_dup.Settings(words=self.words, num=self.num, den=self.den, bands=bands, rows=rows)


def paragraphs(data: bytes, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of the paragraphs that take part."""
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    breaks = np.flatnonzero(raw == 10)
    line = np.searchsorted(breaks, starts)
    new = np.ones(n, np.bool_)
    new[1:] = line[1:] != line[:-1]
    new[first[:-1][first[:-1] < n]] = True
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    long = np.repeat(size > s.cut_words, size)
    final = np.isin(raw[ends - 1], np.frombuffer(b".!?", np.uint8))
    tail = words.copy()
    tail[1:] += words[:-1] * np.uint64(0x9E3779B97F4A7C15)
    chosen = long & final & (sh.mix(tail) % np.uint64(s.cut_share) == 0)
    new[1:] |= chosen[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    kept = size >= s.min_words
    return begin[kept], size[kept]


def windows(words: np.ndarray, grams: np.ndarray, first: np.ndarray, s: Settings) -> np.ndarray:
    """First words of the windows; ``grams``: the hash of the shingle that starts at each word, whatever unit it ends in."""
    place = sh.leftmost_minima(grams, s.reach)
    sizes = np.diff(first)
    counts = np.maximum(sizes - s.words + 1 - s.reach + 1, 0) * (sizes >= s.run_words)
    chosen = place[sh.spread(first[:-1], counts)]
    if not len(chosen):
        return chosen
    chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
    unit = np.searchsorted(first, chosen, side="right") - 1
    return chosen[chosen + s.window_words <= first[unit + 1]]


def _units(s: Settings):
    """Of rows (id, th, text) the units; of equal paragraphs of a batch only the first has band keys."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def made(batch, offsets, window: bool, words, grams, starts, ends, first, begin, size) -> pa.RecordBatch:
            near = s.near(window)
            if window:
                rep, check = (sh.equal_sequence_hashes(words, begin, s.window_words, salt) for salt in (0, 1))
            else:
                rep, check = (sh.sequence_hashes(words, begin, size, salt) for salt in (0, 1))
            one = np.arange(len(rep)) if window else np.sort(np.unique(rep, return_index=True)[1])
            count = size[one] - s.words + 1
            bounds = np.concatenate([[0], np.cumsum(count)])
            keys = sh.band_keys(sh.minhash(grams[sh.spread(begin[one], count)], bounds, near.bands * near.rows), near.rows)
            if window:  # neighbours that overlap are alike; only windows with the same anchor are compared
                keys = sh.mix(keys.view(np.uint64) ^ grams[begin, None]).view(np.int64)
            some = np.zeros(len(begin), np.int32)
            some[one] = near.bands
            unit = np.searchsorted(first, begin, side="right") - 1
            at = pa.array(unit)
            columns = [
                batch.column(0).take(at),
                batch.column(1).take(at),
                pa.array(np.full(len(begin), window)),
                pa.array(starts[begin] - offsets[unit]),
                pa.array(ends[begin + size - 1] - offsets[unit]),
                pa.array(rep.view(np.int64)),
                pa.array((check >> np.uint64(33)).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]).astype(np.int32)), pa.array(keys.ravel())),
            ]
            return pa.record_batch(columns, names=["id", "th", "window", "start", "end", "rep", "check", "keys"])

        for whole in batches:
            for batch in slices(whole, ["text"], 2_000_000):
                data, offsets = sh.buffer_of(batch.column(batch.schema.get_field_index("text")))
                starts, ends, first = sh.word_places(data, offsets)
                words = sh.hashes_between(data, starts, ends)
                if len(words) < s.words:
                    continue
                grams = sh.word_grams(words, s.words)
                given = (words, grams, starts, ends, first)
                yield made(batch, offsets, False, *given, *paragraphs(data, words, starts, ends, first, s))
                begin = windows(words, grams, first, s)
                yield made(batch, offsets, True, *given, begin, np.full(len(begin), s.window_words))

    return run


def _take(batches: Iterator) -> Iterator:
    """Of rows (text, [(rep, start, end)]) the units (rep, text)."""
    import pyarrow as pa

    for whole in batches:
        for batch in slices(whole, ["text"], 4_000_000):
            reps, texts = [], []
            for text, wanted in zip(batch.column(0), batch.column(1)):
                raw = text.as_buffer().to_pybytes()
                for w in wanted.as_py():
                    reps.append(w["rep"])
                    texts.append(raw[w["start"] : w["end"]])
            yield pa.record_batch([pa.array(reps, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["rep", "text"])


def _same(a: str, b: str):
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _components(own: DataFrame, units: DataFrame, near: near_dup.Settings, most: int = BROADCAST_ROWS) -> DataFrame:
    """``units`` (id, th, start, end, rep, check, ...) in components of two or more, with ``component, n_members, keep``.

    Components are summed over classes of equal units, so the units meet what is known of their class once; ``most``: rows of that up
    to which it is sent to all executors.
    """
    keyed = units.where("size(keys) > 0").select("rep", F.posexplode("keys").alias("band", "key"))
    some = near_dup.bucketed(keyed)
    buckets = materialise(some.distinct(), "buckets")
    met = materialise(buckets.select("rep").distinct(), "met")
    place = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "start", "end", "check")).alias("at")
    spots = materialise(units.join(bounded_broadcast(met), "rep", "left_semi").groupBy("rep").agg(place).select("rep", "at.*"), "spots")
    wanted = materialise(spots.groupBy("id", "th").agg(F.collect_list(F.struct("rep", "start", "end")).alias("wanted")), "wanted")
    read = own.alias("d").join(wanted.alias("w"), _same("d", "w")).select("text", "wanted")
    texts = materialise(read.mapInArrow(frugal(_take), "rep long, text string").dropDuplicates(["rep"]), "texts")
    info = materialise(texts.mapInArrow(frugal(near_dup.sign(near)), f"rep long, {near_dup.SIGNED}").select("rep", "n", "sketch", "bands"), "info")
    labels = near_dup.linked(buckets, info, lambda reps: texts.join(reps, "rep", "left_semi"), near)
    release(some, buckets, met, wanted, texts, info)

    linked = labels.withColumnRenamed("node", "rep").join(spots.select("rep", "check"), "rep")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "start")).alias("first")
    classes = materialise(units.groupBy("rep", "check").agg(F.count("*").alias("n"), first), "classes")
    placed = classes.join(linked, ["rep", "check"], "left").where("n > 1 OR comp IS NOT NULL")
    placed = materialise(placed.select("rep", "check", "n", "first", F.coalesce("comp", "rep").alias("component"), F.when(F.col("comp").isNull(), F.col("check")).otherwise(-1).alias("apart")), "placed")
    totals = placed.groupBy("component", "apart").agg(F.sum("n").alias("n_members"), F.min("first").alias("keep")).where("n_members > 1")
    known = materialise(placed.drop("n", "first").join(totals, ["component", "apart"]), "known")
    found = materialise(units.drop("keys").join(bounded_broadcast(known, most), ["rep", "check"]), "found")
    release(classes, placed, known, spots, labels)
    return found


def paragraph_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """A row for each paragraph or window of a component of two or more: ``id_col, start, end`` (bytes), ``component, n_members,
    keep_<id_col>, keep_start, removed``.

    The first paragraph or window by (id, start), null ids last, of a component stays. Windows may overlap. Null and empty
    texts have no units. Ids may be of any type that has an order. Rows that repeat an id are told apart by text; fully
    repeated rows keep the same units. An empty table gives an empty result; other columns are ignored.
    """
    s = settings
    own = fresh(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("th"), "text").where("text IS NOT NULL")
    schema = f"id {own.schema['id'].dataType.simpleString()}, th long, window boolean, start long, end long, rep long, check int, keys array<long>"
    units = materialise(own.mapInArrow(frugal(_units(s)), schema), "units")
    stays = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("start") == F.col("keep.start"))
    whole = _components(own, units.where("NOT window"), s.near(False)).withColumn("removed", ~stays)

    # A window meets others only in a bucket of its band, so the rest goes at once; what removed paragraphs cover goes too.
    # Both sides are shuffled at every size: a broadcast of the keys would only fit on small inputs. A window has one key.
    pieces = units.where("window").withColumn("key", F.col("keys")[0]).drop("window", "keys")
    again = materialise(pieces.groupBy("key").count().where("count > 1").select("key"), "again")
    found = pieces.join(again.hint("merge"), "key", "left_semi").select("*", F.lit(True).alias("window"), F.array("key").alias("keys"))
    found = materialise(found.select(units.columns), "repeated")
    release(units, again)
    spans = whole.where("removed").groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    inside = F.exists("spans", lambda x: (x["start"] <= F.col("f.start")) & (F.col("f.end") <= x["end"]))
    apart = found.alias("f").join(spans.alias("g"), _same("f", "g"), "left").where(~F.coalesce(inside, F.lit(False))).select("f.*")
    apart = materialise(apart, "apart")
    release(found)
    rows = whole.unionByName(_components(own, apart, s.near(True), 0).withColumn("removed", ~stays))
    return rows.select(
        F.col("id").alias(id_col),
        "start",
        "end",
        "component",
        "n_members",
        F.col("keep.id").alias(f"keep_{id_col}"),
        F.col("keep.start").alias("keep_start"),
        "removed",
    )
