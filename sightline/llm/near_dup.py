"""MinHash near-deduplication with odd sketches (operator 7).

1. Each document's distinct word shingles give a set digest, MinHash band keys, and an odd sketch: a bitmap in which every
   MinHash sample toggles one bit. The XOR of two sketches has few ones exactly when the sets are very similar, so its
   population count is a precise and cheap estimate at high similarity.
2. Documents with equal sets (by 128-bit digest) form a class. A class is a node, numbered by one of its rows, so ids that
   repeat with different texts stay apart. One row of a class goes on.
3. Star rounds: in each band bucket every member is paired with the bucket's smallest member. Pairs survive a size test
   and the sketch test (several standard errors below the limit, so that no true link is lost), and are confirmed by the
   exact Jaccard similarity of the full sets. Components follow from the confirmed links.
4. Remainder: of the buckets that still hold several components, those with equal members count once, in their first band.
   Members of different components are compared by sketch in blocks of bounded size, each pair in the first bucket it
   shares. Members that may have a partner get their texts, and the blocks are compared again by exact similarity,
   emitting only links that connect components. So all colliding pairs are compared or already known to be connected, and
   pairs themselves are never emitted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import bounded_broadcast, fresh, frugal, materialise, release, slices
from .components import components


@dataclass(frozen=True)
class Settings:
    """Words in a shingle; the limit as numerator / denominator; bands of rows samples; bits of a sketch; members in a block.

    With 30 bands of 5, a pair at similarity 0.85 shares no bucket with probability (1 - 0.85**5) ** 30 = 2e-8, at 0.8
    with 7e-6.
    """

    words: int = 5
    num: int = 80
    den: int = 100
    bands: int = 30
    rows: int = 5
    bits: int = 512
    block: int = 4096
    errors: float = 6.0

    @property
    def max_ones(self) -> int:
        """XOR ones up to which a pair may reach the limit, ``errors`` standard errors granted."""
        k, limit = self.bands * self.rows, self.num / self.den
        spread = math.sqrt(limit * (1 - limit) / k + 1 / (8 * k))
        differing = 2 * k * (1 - max(0.0, limit - self.errors * spread))
        return math.ceil(self.bits / 2 * (1 - math.exp(-2 * differing / self.bits)) + 3 * math.sqrt(self.bits) / 4)


SIGNED = "n long, digest binary, bands array<long>, sketch array<long>"


def sign(settings: Settings):
    """Of rows (..., text) the other columns, set size, set digest, band keys and odd sketch; without words, no digest and no keys."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, ["text"], 2_000_000):
                own = [i for i, name in enumerate(batch.schema.names) if name != "text"]
                data, offsets = sh.buffer_of(batch.column(batch.schema.get_field_index("text")))
                hashes, bounds = sh.shingles(data, offsets, settings.words)
                sets = sh.distinct(hashes, bounds)
                signature = sh.minhash(hashes, bounds, settings.bands * settings.rows)
                filled = np.diff(bounds) > 0
                lists = np.concatenate([[0], np.cumsum(filled)]).astype(np.int32)
                keys, marks = sh.band_keys(signature, settings.rows), sh.odd_sketch(signature, settings.bits)
                made = [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(lists * settings.bands, keys.ravel()),
                    pa.ListArray.from_arrays(lists * (settings.bits // 64), marks.ravel()),
                ]
                yield pa.record_batch([*(batch.column(i) for i in own), *made], names=[*(batch.schema.names[i] for i in own), *(c.split()[0] for c in SIGNED.split(", "))])

    return run


def _confirm(settings: Settings):
    """Of rows (a, b, text_a, text_b) the pairs (a, b) whose full sets reach the limit."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, ["ta", "tb"], 4_000_000):
                left, right = (sh.distinct(*sh.shingles(*sh.buffer_of(batch.column(i)), settings.words)) for i in (2, 3))
                good = []
                for x, y in zip(left, right):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(bool(len(x)) and settings.den * both >= settings.num * (len(x) + len(y) - both))
                yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


_ROW = "key long, band int, i long, j long, chunk long, rep long, comp long"


#: Rows up to which block pairs are small: many are compared at once. Rows and bytes of text of those taken together.
SMALL, RUN_ROWS, RUN_BYTES = 64, 8192, 2_000_000


class _Group:
    """The rows of one block pair of a bucket (two blocks of its members, or twice the same), or those of many small ones.

    ``sizes``: rows of each.
    """

    def __init__(self, table, settings: Settings, sizes: list[int]) -> None:
        self.table, self.settings, self.sizes = table, settings, np.array(sizes)
        for name in ("rep", "comp", "n", "chunk", "band", "i", "j"):
            setattr(self, name, table.column(name).to_numpy())
        self.sketch, self.bands = (table.column(c).combine_chunks().flatten().to_numpy().reshape(len(self.rep), -1) for c in ("sketch", "bands"))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of members of different components that may reach the limit and share no earlier bucket."""
        return self._in_small() if self.sizes.max() <= SMALL else self._in_blocks()

    def _in_small(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        s, here = self.settings, np.arange(len(self.rep))
        after = np.repeat(np.cumsum(self.sizes), self.sizes) - here - 1
        a, b = np.repeat(here, after), sh.spread(here + 1, after)
        near = (self.comp[a] != self.comp[b]) & ((self.i[a] == self.j[a]) | (self.chunk[a] != self.chunk[b]))
        near &= s.den * np.minimum(self.n[a], self.n[b]) >= s.num * np.maximum(self.n[a], self.n[b])
        a, b = a[near], b[near]
        for part in range(0, len(a), 65536):
            x, y = a[part : part + 65536], b[part : part + 65536]
            keep = np.bitwise_count(self.sketch[x] ^ self.sketch[y]).sum(axis=1) <= s.max_ones
            x, y = x[keep], y[keep]
            earlier = np.arange(self.bands.shape[1]) < self.band[x, None]
            first = ~((self.bands[x] == self.bands[y]) & earlier).any(axis=1)
            if first.any():
                yield x[first], y[first]

    def _in_blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        s, band, i, j = self.settings, int(self.band[0]), self.i[0], self.j[0]
        same, left, right = i == j, np.flatnonzero(self.chunk == i), np.flatnonzero(self.chunk == j)
        for at in range(0, len(left), 128):
            x = left[at : at + 128]
            near = self.comp[x, None] != self.comp[None, right]
            near &= s.den * np.minimum(self.n[x, None], self.n[None, right]) >= s.num * np.maximum(self.n[x, None], self.n[None, right])
            if same:
                near &= self.rep[x, None] < self.rep[None, right]
            row, col = np.nonzero(near)
            for part in range(0, len(row), 65536):
                a, b = x[row[part : part + 65536]], right[col[part : part + 65536]]
                keep = np.bitwise_count(self.sketch[a] ^ self.sketch[b]).sum(axis=1) <= s.max_ones
                a, b = a[keep], b[keep]
                first = ~(self.bands[a, :band] == self.bands[b, :band]).any(axis=1)
                if first.any():
                    yield a[first], b[first]

    def links(self) -> list[tuple[int, int]]:
        """Confirmed links that connect the components, no more than there are members."""
        data, offsets = sh.buffer_of(self.table.column("text").combine_chunks())
        sets = sh.distinct(*sh.shingles(data, offsets, self.settings.words))
        _, places = np.unique(np.concatenate(sets), return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        mark = np.zeros(places.max(initial=0) + 1, np.bool_)
        root = {c: c for c in self.comp.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for xs, ys in self.pairs():
            order = np.argsort(xs, kind="stable")
            each, start = np.unique(xs[order], return_index=True)
            for x, partners in zip(each.tolist(), np.split(ys[order], start[1:])):
                others = [y for y in partners.tolist() if find(int(self.comp[x])) != find(int(self.comp[y]))]
                if not others:
                    continue
                own = places[bounds[x] : bounds[x + 1]]
                mark[own] = True
                both = [int(np.count_nonzero(mark[places[bounds[y] : bounds[y + 1]]])) for y in others]
                mark[own] = False
                for y, k in zip(others, both):
                    if self.settings.den * k >= self.settings.num * (len(own) + int(bounds[y + 1] - bounds[y]) - k):
                        a, b = find(int(self.comp[x])), find(int(self.comp[y]))
                        if a != b:
                            root[max(a, b)] = min(a, b)
                            out.append((int(self.rep[x]), int(self.rep[y])))
        return out


def _groups(batches: Iterator, settings: Settings) -> Iterator[_Group]:
    """The block pairs of rows sorted by (key, i, j), small ones together."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def runs(table, cuts: list[int]) -> Iterator[_Group]:
        ends = np.zeros(table.num_rows + 1, np.int64)
        if "text" in table.column_names:
            ends[1:] = np.cumsum(pc.fill_null(pc.binary_length(table.column("text")), 0).to_numpy())
        begin, sizes = 0, []
        for a, b in zip(cuts, cuts[1:]):
            if sizes and (max(b - a, sizes[-1]) > SMALL or b - begin > RUN_ROWS or ends[b] - ends[begin] > RUN_BYTES):
                yield _Group(table.slice(begin, a - begin), settings, sizes)
                sizes = []
            if not sizes:
                begin = a
            sizes.append(b - a)
        if sizes:
            yield _Group(table.slice(begin, cuts[-1] - begin), settings, sizes)

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        if not table.num_rows:
            continue
        where = [table.column(c).to_numpy() for c in ("key", "i", "j")]
        cuts = [0, *(np.flatnonzero(np.logical_or.reduce([np.diff(w) != 0 for w in where])) + 1).tolist()]
        yield from runs(table, cuts)
        held = table.slice(cuts[-1])
    if held is not None and held.num_rows > 1:
        yield _Group(held, settings, [held.num_rows])


def _unsure(settings: Settings):
    """The rows that have a partner which may reach the limit."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for group in _groups(batches, settings):
            found = [np.concatenate(p) for p in group.pairs()]
            if found:
                yield group.table.select([c.split()[0] for c in _ROW.split(", ")]).take(pa.array(np.unique(np.concatenate(found)))).combine_chunks().to_batches()[0]

    return run


def _settle(settings: Settings):
    """The confirmed links among the rows that are unsure."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for group in _groups(batches, settings):
            if found := group.links():
                yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def ones(a: Column, b: Column) -> Column:
    """Population count of the XOR of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _plausible(pairs: DataFrame, info: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) that pass the size and sketch tests."""
    x = info.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    y = info.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    joined = pairs.join(x, "a").join(y, "b")
    return joined.where((settings.den * F.least("na", "nb") >= settings.num * F.greatest("na", "nb")) & (ones(F.col("sa"), F.col("sb")) <= settings.max_ones)).select(*pairs.columns)


def _links(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    wide = pairs.select("a", "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
    return wide.select("a", "b", "ta", "tb").mapInArrow(frugal(_confirm(settings)), "a long, b long")


def apart(rows: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the component of each named column's node as comp_<column>; a node without a link is its own."""
    for c in columns:
        one = labels.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
        rows = rows.join(one, c, "left").withColumn(f"comp_{c}", F.coalesce(f"comp_{c}", c))
    return rows


def bucketed(members: DataFrame) -> DataFrame:
    """Of rows (key, band, rep) those in buckets with different members, with the bucket's smallest one as ``low``.

    ``members`` is read twice, so it is a written table or a cheap projection of one.
    """
    shared = members.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key", "low")
    return materialise(members.join(shared, "key"), "buckets")


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, band, rep, comp, chunks of ``block`` members) of the buckets with several components; of those with equal members the first band's."""
    placed = apart(buckets.select("key", "band", "rep"), labels, "rep").withColumnRenamed("comp_rep", "comp")
    salt = lambda n: F.sum(F.pmod(F.xxhash64("rep", F.lit(n)), F.lit(1 << 31))).alias(f"s{n}")
    mixed = placed.groupBy("key", "band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"), salt(1), salt(2), salt(3), salt(4)).where("x < y")
    first = mixed.groupBy("m", "s1", "s2", "s3", "s4").agg(F.min_by("key", F.struct("band", "key")).alias("key"))
    return placed.join(first.select("key", "m"), "key")


def linked(buckets: DataFrame, info: DataFrame, texts_of, settings: Settings) -> DataFrame:
    """``node, comp`` of all linked nodes.

    ``info`` has (rep, n, sketch, bands) of at least the buckets' members, and ``texts_of`` gives (rep, text) of the nodes
    (rep) it is asked for.
    """
    stars = buckets.where("rep <> low").groupBy(F.col("low").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("bands"))
    stars = materialise(_plausible(stars, info, settings), "stars")
    texts = materialise(texts_of(stars.select(F.col("a").alias("rep")).union(stars.select("b")).distinct()), "texts")
    best = stars.groupBy("b").agg(F.max("bands").alias("bands"))
    first = stars.join(best, ["b", "bands"]).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    one = materialise(_links(first, texts, settings), "links")
    labels = components(one, "a", "b")

    second = apart(stars.select("a", "b").join(first, ["a", "b"], "left_anti"), labels, "a", "b").where("comp_a <> comp_b")
    two = materialise(_links(second, texts, settings), "links")
    links = one.union(two)
    labels = components(links, "a", "b")
    release(stars, texts)

    rest = materialise(_mixed(buckets, labels).withColumn("chunks", F.ceil(F.col("m") / settings.block)).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks"))), "mixed")
    members = rest.join(info, "rep").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    placed = members.select("key", "band", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", "comp", "n", "sketch", "bands")
    placed = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    unsure = materialise(placed.mapInArrow(frugal(_unsure(settings)), _ROW), "unsure")
    sizes = info.select("rep", "n", "sketch", "bands").join(texts_of(unsure.select("rep").distinct()), "rep")
    full = unsure.join(sizes, "rep").select(*unsure.columns, "n", "sketch", "bands", "text")
    three = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(frugal(_settle(settings)), "a long, b long")
    labels = components(links.union(three), "a", "b")
    release(one, two, rest, unsure)
    return labels


def _judged(docs: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """(id, th, row, n, comp_row, component_id) of each input row; th is the text's hash, row a number of the row, and
    comp_row the number of a row that stands for its component."""
    own = fresh(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("th"), "text")
    schema = f"id {own.schema['id'].dataType.simpleString()}, th long, {SIGNED}"
    signed = materialise(own.mapInArrow(frugal(sign(settings)), schema).withColumn("row", F.monotonically_increasing_id()), "signed")  # fixes the numbers

    rows = signed.select("id", "th", "row", "n", "digest")
    classes = materialise(rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("row").alias("rep"), F.min("id").alias("least")), "classes")
    info = materialise(signed.join(classes.select(F.col("rep").alias("row")), "row").select(F.col("row").alias("rep"), "id", "th", "n", "sketch", "bands"), "info")
    asked = []

    def texts_of(reps: DataFrame) -> DataFrame:
        asked.append(materialise(info.select("rep", "id", "th").join(reps, "rep"), "asked"))
        x, y = own.alias("x"), bounded_broadcast(asked[-1]).alias("y")
        found = x.join(y, F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.th") == F.col("y.th"))).select("rep", "text")
        return found.dropDuplicates(["rep"])  # a row may occur twice

    buckets = bucketed(info.select("rep", F.posexplode("bands").alias("band", "key")))
    labels = linked(buckets, info, texts_of, settings)
    release(buckets, info, *asked)
    placed = apart(classes, labels, "rep").withColumnRenamed("comp_rep", "comp_row")
    heads = placed.groupBy("comp_row").agg(F.min("least").alias("component_id"))
    known = placed.select("digest", "comp_row").join(heads, "comp_row")
    done = rows.where("digest IS NOT NULL").join(known, "digest").select("id", "th", "row", "n", "comp_row", "component_id")
    return done.union(rows.where("digest IS NULL").select("id", "th", "row", "n", F.col("row").alias("comp_row"), F.col("id").alias("component_id")))


def near_dup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``id_col, n_shingles, component_id, kept``: one row per input row.

    Null texts and texts without words have the empty set and are linked with nothing; a text of fewer words than a
    shingle has its whole sequence as its only one. Ids may be of any type that has an order. Rows that share an id are
    judged each by its own text. A row with a null id is linked like any other but does not name its component: a
    component of such rows alone is null. An empty table gives an empty result; other columns are ignored.
    """
    judged = _judged(docs, id_col, text_col, settings)
    return judged.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with one row of each component, the first by id (nulls last); texts without words all stay.

    Rows are matched by id (null-safely) and text; of a row that occurs twice one stays.
    """
    judged = materialise(_judged(docs, id_col, text_col, settings).where("n > 0"), "judged")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "th")
    several = materialise(judged.groupBy("comp_row").agg(F.count("*").alias("members"), F.min(place).alias("first")).where("members > 1"), "several")
    losers = judged.join(several, "comp_row").where("row <> first.row").select(F.col("id").alias("l_id"), F.col("th").alias("l_th")).distinct()
    keepers = several.select(F.col("first.id").alias("l_id"), F.col("first.th").alias("l_th"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"))
    same = F.col("id").eqNullSafe(F.col("l_id")) & (F.col("th") == F.col("l_th"))
    pair = F.col("x.l_id").eqNullSafe(F.col("y.l_id")) & (F.col("x.l_th") == F.col("y.l_th"))
    gone = materialise(losers.alias("x").join(keepers.alias("y"), pair, "left_anti"), "gone")
    twice = materialise(losers.alias("x").join(keepers.alias("y"), pair, "left_semi"), "twice")
    kept = rows.join(bounded_broadcast(gone), same, "left_anti")
    if twice.isEmpty():
        return kept.select("row.*")
    few = bounded_broadcast(twice)
    return kept.join(few, same, "left_anti").select("row.*").union(kept.join(few, same, "left_semi").dropDuplicates(["id", "th"]).select("row.*"))
