"""Suffix deduplication of byte strings by bucket-pointer refinement (operator 8).

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Ranking all suffixes of a corpus would
shuffle many times its size, so suffixes are ranked only where a repeat can be:

1. Anchors: the least q-gram (the first by hash) of those within a string of ``length`` bytes is the string's anchor. It
   depends on the string's bytes only, so equal strings have equal anchors at equal distances, and every string belongs to
   one anchor. An anchor's strings start ``least`` to ``most`` bytes before it. About 1.5 % of positions are anchors.
2. Initial buckets: anchors with the same q-gram. Buckets of one are dropped. An anchor's context is all its strings'
   bytes; a context that occurs twice (by digest) is repeated as a whole and needs no further look.
3. Refinement: buckets with several different contexts. Every position of a context gets the bucket of its short string
   (aligned to the anchor); buckets are refined by sorting on (own bucket, bucket of a later offset), and each update is
   used by the next, so compared lengths double up to ``length``. Singletons leave at once.
4. Buckets of more than ``block`` contexts are first refined by digests: the strings are halved by their distance to the
   anchor, and each half gets the bucket of what its strings have in common, a longer string around the anchor. Halves
   alone in their bucket can't repeat; halves whose bytes all occur twice repeat as a whole; buckets that are small enough
   are refined as in 3, others halved again, down to single strings. So at most two halves go on from a boundary.

All strings around an anchor overlap, so the first and the last that repeat bound what they cover.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import fresh, frugal, materialise, release, slices


@dataclass(frozen=True)
class Settings:
    """Bytes of a string that must not repeat, of a q-gram, and of the first buckets; contexts refined together."""

    length: int = 200
    gram: int = 64
    first: int = 50
    block: int = 4096

    @property
    def reach(self) -> int:
        """How far before its anchor a string may start."""
        return self.length - self.gram


#: An anchor's place, the distances of its strings, and what its bucket is known by.
ROW = "id {id}, th long, pos long, least int, most int, gram long, context long"
PLACE = ("id", "th", "pos", "least", "most")


def anchors(data: bytes, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """unit, position in it, least and greatest distance of its strings, gram hash and context hash of all anchors of the units."""
    n = len(data)
    if n < s.length:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    sums = sh.prefix_sums(data)
    _, down = sh.powers(n + 1)
    grams = sh.mix((sums[s.gram :] - sums[: n - s.gram + 1]) * down[: n - s.gram + 1])
    sizes = np.diff(offsets)
    starts = sh.spread(offsets[:-1], np.maximum(sizes - s.length + 1, 0))
    at = sh.leftmost_minima(grams, s.reach + 1)[starts]
    if not len(at):
        return tuple(np.empty(0, np.int64) for _ in range(6))
    # Within a text, strings with one anchor start side by side; texts never share an anchor.
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    at, lo, hi = at[new], starts[new], starts[np.append(new[1:], len(starts)) - 1]
    unit = np.searchsorted(offsets, at, side="right") - 1
    most, least = at - lo, at - hi
    context = sh.mix(sh.mix((sums[hi + s.length] - sums[lo]) * down[lo]) + (most * 4096 + least).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return unit, at - offsets[unit], least.astype(np.int32), most.astype(np.int32), grams[at].view(np.int64), context.view(np.int64)


def _list_anchors(s: Settings):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, ["text"], 2_000_000):
                unit, *found = anchors(*sh.buffer_of(batch.column(2)), s)
                rows = pa.array(unit)
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, found)], names=[c.split()[0] for c in ROW.split(", ")])

    return run


def _contexts(s: Settings):
    """Of rows (id, th, text, [(pos, least, most, bucket, large)]) the contexts' bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, ["text"], 2_000_000):
                rows, wanted, parts = [], [], []
                for row, (text, asked) in enumerate(zip(batch.column(2), batch.column(3))):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    for w in asked.as_py():
                        rows.append(row)
                        wanted.append(w)
                        parts.append(raw[w["pos"] - w["most"] : w["pos"] - w["least"] + s.length])
                at = pa.array(rows, pa.int32())
                own = [pa.array([w[c] for w in wanted], t) for c, t in (("pos", pa.int64()), ("least", pa.int32()), ("most", pa.int32()), ("bucket", pa.int64()), ("large", pa.bool_()))]
                yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), *own, pa.array(parts, pa.binary())], names=[*PLACE, "bucket", "large", "bytes"])

    return run


def aligned(least: np.ndarray, most: np.ndarray, raw, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the contexts, with their anchors in column ``reach``, and which columns they fill. ``raw``: their bytes as an Arrow column."""
    width = s.reach + s.length
    data, offsets = sh.buffer_of(raw)
    sizes = most - least + s.length
    place = sh.spread(np.arange(len(sizes)) * width + s.reach - most, sizes)
    text, valid = np.zeros(len(sizes) * width, np.uint64), np.zeros(len(sizes) * width, np.bool_)
    text[place] = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    valid[place] = True
    up, _ = sh.powers(width + 1)
    sums = np.zeros((len(sizes), width + 1), np.uint64)
    np.cumsum(text.reshape(-1, width) * up[:width], axis=1, out=sums[:, 1:])
    return sums, valid.reshape(-1, width)


def digests(sums: np.ndarray, rows: np.ndarray, columns: np.ndarray, size) -> np.ndarray:
    _, down = sh.powers(sums.shape[1])
    return sh.mix((sums[rows, columns + size] - sums[rows, columns]) * down[columns])


def repeated_starts(buckets: np.ndarray, sums: np.ndarray, valid: np.ndarray, s: Settings) -> np.ndarray:
    """(contexts, reach + 1): the bucket of the string that starts in each column, if another context has it, else -1."""
    width = valid.shape[1]
    pointers = np.full(valid.shape, -1, np.int32)

    def ranked(at: np.ndarray, keys: np.ndarray) -> None:
        """New pointers for the flat positions ``at``; buckets of one are dropped."""
        pointers.fill(-1)
        if len(at):
            order = np.argsort(keys)
            new = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])
            alone = new & np.concatenate([new[1:], [True]])
            bucket = np.cumsum(new, dtype=np.int32)
            bucket[alone] = -1
            pointers.ravel()[at[order]] = bucket

    rows, columns = np.nonzero(valid[:, : width - s.first + 1] & valid[:, s.first - 1 :])
    _, bucket = np.unique(buckets, return_inverse=True)
    place = (bucket[rows] * width + columns).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    ranked(rows * width + columns, sh.mix(digests(sums, rows, columns, s.first) + place))
    known = s.first
    while known < s.length:
        step = min(known, s.length - known)
        rows, columns = np.nonzero((pointers[:, : width - step] >= 0) & (pointers[:, step:] >= 0))
        ranked(rows * width + columns, (pointers[rows, columns].astype(np.int64) << 32) | pointers[rows, columns + step])
        known += step
    return pointers[:, : s.reach + 1]


def _refine(s: Settings):
    """Of contexts sorted by bucket, the least and the greatest distance of a repeated string's start before the anchor."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def refined(table) -> pa.RecordBatch:
            bucket, least, most = (table.column(c).to_numpy() for c in ("bucket", "least", "most"))
            sums, valid = aligned(least.astype(np.int64), most.astype(np.int64), table.column("bytes").combine_chunks(), s)
            found = repeated_starts(bucket, sums, valid, s) >= 0
            some = np.flatnonzero(found.any(axis=1))
            first, last = np.argmax(found[some], axis=1), s.reach - np.argmax(found[some, ::-1], axis=1)
            own = [table.column(c).combine_chunks().take(pa.array(some)) for c in ("id", "th", "pos")]
            return pa.record_batch([*own, pa.array((s.reach - last).astype(np.int32)), pa.array((s.reach - first).astype(np.int32))], names=list(PLACE))

        held: list = []
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                held.append(whole.slice(at, 1024))
                table = pa.Table.from_batches(held)
                if table.num_rows < 1024:
                    continue
                bucket = table.column("bucket").to_numpy()
                other = np.flatnonzero(bucket != bucket[-1])
                if len(other):
                    yield refined(table.slice(0, int(other[-1]) + 1))
                    held = table.slice(int(other[-1]) + 1).to_batches()
        if held and sum(x.num_rows for x in held):
            yield refined(pa.Table.from_batches(held))

    return run


def _halves(s: Settings):
    """Of contexts whose bucket holds the strings at distances ``low`` to ``high``, either half of those: the context's own
    distances in it, the bucket of what all strings of the half share, and the digest of the context's bytes in it."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                least, most, low, high, bucket = (column[c].to_numpy().astype(np.int64) for c in ("least", "most", "low", "high", "bucket"))
                sums, _ = aligned(least, most, column["bytes"], s)
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    x, y = np.maximum(least, a), np.minimum(most, b)
                    row = np.flatnonzero((a <= b) & (x <= y))
                    a, b, x, y = a[row], b[row], x[row], y[row]
                    shared = digests(sums, row, s.reach - a, s.length - (b - a)) + sh.mix(bucket[row].view(np.uint64) + (a * 512 + b).astype(np.uint64))
                    hull = digests(sums, row, s.reach - y, s.length + y - x)
                    made = [pa.array(v.astype(np.int32)) for v in (x, y, a, b)] + [pa.array(sh.mix(shared).view(np.int64)), pa.array(hull.view(np.int64))]
                    own = [column[c].take(pa.array(row)) for c in ("id", "th", "pos")]
                    yield pa.record_batch([*own, *made], names=[*PLACE, "low", "high", "bucket", "hull"])

    return run


def _cut(batches: Iterator) -> Iterator:
    """Of rows (id, text, [(lo, hi)]) the merged spans and the bytes that remain."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for whole in batches:
        for batch in slices(whole, ["text"], 8_000_000):
            sizes, merged, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                runs: list[dict] = []
                for x in sorted((y["lo"], y["hi"]) for y in spans.as_py() or ()):
                    if runs and x[0] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], x[1])
                    else:
                        runs.append({"start": x[0], "end": x[1]})
                edges = [0, *(e for r in runs for e in (r["start"], r["end"])), len(raw)]
                sizes.append(len(raw))
                merged.append(runs)
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def _same(a: str, b: str):
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _sorted_out(rows: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Of rows (place, low, high, bucket, hull) the spans (id, th, lo, hi) of those whose bytes occur twice as a whole, and
    one of each set of equal ones (place, low, high, bucket, k) in buckets that hold k > 1 different ones."""
    keys = ["bucket", "hull", "least", "most"]
    firsts = [F.first(c).alias(c) for c in ("id", "th", "pos", "low", "high")]  # all of the same row
    classes = materialise(rows.groupBy(*keys).agg(F.count("*").alias("n"), *firsts), "classes")
    span = [(F.col("pos") - F.col("most")).alias("lo"), (F.col("pos") - F.col("least") + s.length).alias("hi")]
    whole = materialise(rows.join(classes.where("n > 1").select(*keys), keys, "left_semi").select("id", "th", *span), "whole")
    several = classes.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    unclear = materialise(classes.join(several, "bucket").select(*PLACE, "low", "high", "bucket", "k"), "unclear")
    release(classes)
    return whole, unclear


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``id_col, n_bytes, spans, kept``: per row the maximal removed runs (bytes, ends exclusive) and the remaining bytes.

    Null texts count as empty. Ids may be of any type. Rows are told apart by id (null-safely) and text; repeated rows
    remove each other's text. Texts shorter than ``length`` lose nothing. In a run of one byte every position is an anchor.
    An empty table gives an empty result; other columns are ignored.
    """
    s = settings
    own = fresh(docs, id=id_col, text=text_col).select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    kind = own.schema["id"].dataType.simpleString()
    place = f"id {kind}, th long, pos long, least int, most int"

    listed = materialise(own.mapInArrow(frugal(_list_anchors(s)), ROW.format(id=kind)), "anchors")
    repeated = listed.groupBy("gram").count().where("count > 1").select("gram")
    found = materialise(listed.join(repeated, "gram", "left_semi"), "repeated")
    release(listed)
    bounds = [F.lit(0).alias("low"), F.lit(s.reach).alias("high")]
    whole, unclear = _sorted_out(found.select(*PLACE, *bounds, F.col("gram").alias("bucket"), F.col("context").alias("hull")), s)
    release(found)

    each = F.struct("pos", "least", "most", "bucket", (F.col("k") > s.block).alias("large"))
    wanted = unclear.groupBy("id", "th").agg(F.collect_list(each).alias("wanted"))
    reads = own.alias("d").join(wanted.hint("shuffle_hash").alias("w"), _same("d", "w")).select("d.id", "d.th", "text", "wanted")
    store = materialise(reads.mapInArrow(frugal(_contexts(s)), f"{place}, bucket long, large boolean, bytes binary"), "bytes")
    release(unclear)
    spans, parts, done = [whole], [store.where("NOT large").select(*PLACE, "bucket", "bytes")], [store]
    large = store.where("large").select(*PLACE, *bounds, "bucket", "bytes")
    while not large.isEmpty():
        halves = materialise(large.mapInArrow(frugal(_halves(s)), f"{place}, low int, high int, bucket long, hull long"), "halves")
        whole, unclear = _sorted_out(halves, s)
        spans.append(whole)
        both = unclear.alias("u").join(store.where("large").select("id", "th", "pos", F.col("most").alias("all"), "bytes").alias("b"), _same("u", "b") & (F.col("u.pos") == F.col("b.pos")))
        part = F.substring("bytes", F.col("all") - F.col("u.most") + 1, F.col("u.most") - F.col("u.least") + s.length).alias("bytes")
        cut = materialise(both.select(*(F.col(f"u.{c}") for c in PLACE), "low", "high", "bucket", "k", part), "cut")
        release(halves, unclear)
        done.append(cut)
        parts.append(cut.where(F.col("k") <= s.block).select(*PLACE, "bucket", "bytes"))
        large = cut.where(F.col("k") > s.block).select(*PLACE, "low", "high", "bucket", "bytes")
    work = parts[0]
    for part in parts[1:]:
        work = work.union(part)
    refined = materialise(work.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(frugal(_refine(s)), place), "refined")
    release(*done)
    spans.append(refined.select("id", "th", (F.col("pos") - F.col("most")).alias("lo"), (F.col("pos") - F.col("least") + s.length).alias("hi")))

    union = spans[0]
    for more in spans[1:]:
        union = union.union(more)
    removed = materialise(union.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    release(refined, *spans[:-1])
    joined = own.alias("d").join(removed.hint("shuffle_hash").alias("w"), _same("d", "w"), "left").select("d.id", "text", "spans")
    return joined.mapInArrow(frugal(_cut), f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("id", id_col)


def substring_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` of :func:`substring_dedup`."""
    cut = substring_dedup(docs, id_col, text_col, settings)
    return cut.select(
        f"`{id_col}`",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
