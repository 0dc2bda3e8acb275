"""Fuzzy line deduplication by MinHash (operator 4, native).

Each distinct line (trimmed) is a node. Its character shingles are exploded and hashed once; a MinHash sample is the least
value of one multiplication of the hash by the sample's own constant, so a partial aggregation by line keeps all samples in
one pass of generated code. The samples are the points of an affine plane and its lines are the bands: any two samples share
one band and each serves several, which gives a high recall from few samples. Lines that share a band are confirmed by the
exact Jaccard similarity of their shingle sets, confirmed links are joined to components by distributed union-find
(alternating stars), and one line of each stays.

Of each line that shares a band, the number of its different shingles and 1,024 parity bits are kept: every shingle turns one bit over,
so sets that differ in d members differ in at most d bits, and a pair that differs in more bits than the limit allows is no link. Only
pairs that pass this bound, which loses none, are compared as sets.

Members of a bucket are held against its least node first. Of buckets that still hold several components, those with equal
members count once, and members of different components meet in blocks of bounded size, which give out the pairs that pass
(lines of over ``dense`` shingles, which fill the bits, are compared as sets there). Near copies share many buckets; a pair is given
out in the least bucket that both are in, so once.

Only DataFrame functions are used. Nodes are 64-bit hashes of lines (among 1e11 different lines a few hundred would share one).
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, fresh, materialise, release
from .components import components


#: Numbers of 64 parity bits of a line.
WORDS = 16


def _times(a: int, b: int) -> int:
    """Multiplication in the field of four elements, whose addition is exclusive or."""
    return 0 if not a or not b else (a + b - 2) % 3 + 1


@dataclass(frozen=True)
class Settings:
    """Characters (UTF-16 units) in a shingle; the limit as numerator / denominator; members in a block; shingles that fill the bits.

    A pair at 0.8 shares none of the 20 bands with probability 0.006, at 0.85 with 0.0006.
    """

    chars: int = 6
    num: int = 80
    den: int = 100
    block: int = 128
    dense: int = 2000

    @property
    def factors(self) -> list[int]:
        """An odd constant of 31 bits for each sample."""
        rng = random.Random(4)
        return [rng.getrandbits(30) * 2 + 1 for _ in range(16)]

    @property
    def bands(self) -> list[list[int]]:
        """The lines y = m x + b and x = b of the plane over four elements, as numbers of their points 4 x + y."""
        n = range(4)
        return [[4 * x + (_times(m, x) ^ b) for x in n] for m in n for b in n] + [[4 * b + y for y in n] for b in n]


def _line(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def _lines(docs: DataFrame) -> DataFrame:
    """(id, pos, node, line) of all lines that aren't blank."""
    split = docs.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw"))
    return split.select("id", "pos", _line(F.col("raw")).alias("line")).where("line <> ''").select("id", "pos", F.xxhash64("line").alias("node"), "line")


def _starts(wide: Column, s: Settings) -> Column:
    """Places (from 1) in the bytes of UTF-16 at which shingles start; a line shorter than a shingle is its only one."""
    return F.sequence(F.lit(1), F.greatest(F.length(wide) - 2 * s.chars + 1, F.lit(1)), F.lit(2))


def _shingles(line: Column, s: Settings) -> Column:
    """The distinct shingles as 64-bit hashes; arrays of numbers are compared by hashing, those of binaries are not."""
    own = lambda w: F.transform(_starts(w, s), lambda i: F.xxhash64(F.substring(w, i, F.lit(2 * s.chars))))
    wide = F.array(F.encode(line, "UTF-16BE"))  # bound to a variable, so that a line is encoded once and not for each shingle
    return F.get(F.transform(wide, lambda w: F.array_distinct(own(w))), F.lit(0))


def _keys(lines: DataFrame, s: Settings) -> DataFrame:
    """(node, keys) of each distinct line."""
    wide = lines.select("node", F.encode("line", "UTF-16BE").alias("wide"))
    spots = wide.select("node", "wide", F.explode(_starts(F.col("wide"), s)).alias("i"))
    upper = F.shiftrightunsigned(F.xxhash64(F.substring("wide", F.col("i"), F.lit(2 * s.chars))), 33)  # 31 bits: a product fits
    hashed = spots.select("node", upper.alias("h"))
    samples = hashed.groupBy("node").agg(*(F.min((F.col("h") * F.lit(c)).bitwiseAND(F.lit((1 << 40) - 1))).alias(f"m{j}") for j, c in enumerate(s.factors)))
    return samples.select("node", F.array(*(F.xxhash64(F.lit(b), *(F.col(f"m{j}") for j in band)) for b, band in enumerate(s.bands))).alias("keys"))


def _sketched(texts: DataFrame, s: Settings) -> DataFrame:
    """(node, n, x0 to x15): the number of different shingles and their parities, 64 to a column."""
    h = F.col("h")
    spot = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 4).bitwiseAND(F.lit(63)).cast("int"))
    words = (F.bit_xor(F.when(h.bitwiseAND(F.lit(WORDS - 1)) == j, spot).otherwise(F.lit(0).cast("long"))).alias(f"x{j}") for j in range(WORDS))
    return texts.select("node", F.explode(_shingles(F.col("line"), s)).alias("h")).groupBy("node").agg(F.count("*").alias("n"), *words)


def _named(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{c}_{side}") for c in rows.columns))


def _may_be_alike(s: Settings) -> Column:
    """Whether the sets of sides a and b may reach the limit: with d members in one only it is n + m - d of n + m + d, and d is at least the bits that differ."""
    n, m = F.col("n_a"), F.col("n_b")
    differ = sum((F.bit_count(F.col(f"x{j}_a").bitwiseXOR(F.col(f"x{j}_b"))) for j in range(1, WORDS)), F.bit_count(F.col("x0_a").bitwiseXOR(F.col("x0_b"))))
    return (s.den * F.least(n, m) >= s.num * F.greatest(n, m)) & ((s.den + s.num) * differ <= (s.den - s.num) * (n + m))


def _possible(pairs: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that the bound lets pass."""
    x, y = (_named(sketches, side).withColumnRenamed(f"node_{side}", side) for side in "ab")
    return pairs.join(x, "a").join(y, "b").where(_may_be_alike(s)).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the limit. Lines travel as texts; their sets are made after the join."""
    x, y = (texts.select(F.col("node").alias(c), F.col("line").alias(f"line_{c}")) for c in "ab")
    sets = F.array(F.struct(_shingles(F.col("line_a"), s).alias("a"), _shingles(F.col("line_b"), s).alias("b")))  # so each is made once
    return pairs.join(x, "a").join(y, "b").where(F.exists(sets, lambda p: _alike(F.size(p["a"]), p["a"], F.size(p["b"]), p["b"], s))).select("a", "b")


def _alike(n: Column, x: Column, m: Column, y: Column, s: Settings) -> Column:
    """Whether sets of sizes n and m reach the limit; sizes are compared first."""
    return (s.den * F.least(n, m) >= s.num * F.greatest(n, m)) & ((s.den + s.num) * F.size(F.array_intersect(x, y)) >= s.num * (n + m))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (key, node, comp, m) of buckets with several components; of buckets with equal members only one."""
    placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    salt = lambda n: F.sum(F.pmod(F.xxhash64("node", F.lit(n)), F.lit(1 << 31))).alias(f"s{n}")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"), salt(1), salt(2), salt(3), salt(4)).where("x < y")
    return placed.join(mixed.groupBy("m", "s1", "s2", "s3", "s4").agg(F.min("key").alias("key")).select("key", "m"), "key")


def _blocks(mixed: DataFrame, sketches: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of members of different components that may be links, found in pairs of blocks of at most about ``block`` members.

    Only lines of over ``dense`` shingles travel as texts, and are compared as sets where the bound lets them pass. Of the buckets that
    hold both members of a pair, the one with the least key gives it out.
    """
    chunks = F.ceil(F.col("m") / s.block)
    dealt = mixed.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    long = sketches.where(F.col("n") > s.dense).select("node").join(texts, "node")
    known = sketches.join(long, "node", "left").join(mixed.groupBy("node").agg(F.collect_list("key").alias("keys")), "node")
    dealt = dealt.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "comp").join(known, "node")
    x, y = _named(dealt, "a"), _named(dealt, "b")
    sets = F.array(F.struct(_shingles(F.col("line_a"), s).alias("a"), _shingles(F.col("line_b"), s).alias("b")))  # so each is made once
    same = F.col("line_a").isNull() | F.col("line_b").isNull() | F.exists(sets, lambda p: _alike(F.col("n_a"), p["a"], F.col("n_b"), p["b"], s))
    met = (F.col("key_a") == F.col("key_b")) & (F.col("i_a") == F.col("i_b")) & (F.col("j_a") == F.col("j_b"))
    apart = F.when(F.col("i_a") == F.col("j_a"), F.col("node_a") < F.col("node_b")).otherwise(F.col("chunk_a") < F.col("chunk_b")) & (F.col("comp_a") != F.col("comp_b"))
    here = (F.size("keys_a") == 1) | (F.size("keys_b") == 1) | (F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key_a"))
    found = x.join(y.hint("merge"), met & apart & _may_be_alike(s) & here & same)
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def _members(keys: DataFrame) -> DataFrame:
    """(key, node, a, n) of the buckets with several nodes: the least of them and their number.

    Keys are dealt once, and both the counts and the rows are read from there, at every size.
    """
    dealt = keys.select("node", F.explode("keys").alias("key")).repartition("key")
    shared = dealt.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n")).where("a < b")
    return dealt.join(shared.select("key", "a", "n").hint("shuffle_hash"), "key").select("key", "node", "a", "n")


def line_labels(lines: DataFrame, s: Settings) -> DataFrame:
    """``node, comp`` of all nodes of at least one link. ``lines`` has (node, line)."""
    members = materialise(_members(_keys(lines, s)), "members")
    first = materialise(members.where("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")

    met = materialise(members.select("node").distinct(), "met")
    # Shuffled at every size: a broadcast of the nodes would only fit on small inputs.
    texts = materialise(lines.join(met.hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("line").alias("line")), "lines")
    sketches = materialise(_sketched(texts, s), "sketches")
    one = materialise(_confirmed(_possible(first, sketches, s), texts, s), "links")
    release(first, met)
    labels = components(one, "a", "b", local_edges=0)

    # A bucket of two was held against its least node as a whole.
    rest = materialise(_mixed(members.where("n > 2").select("key", "node"), labels), "mixed")
    may = materialise(_blocks(rest, sketches, texts, s), "pairs")
    two = materialise(_confirmed(may, texts, s), "links")
    labels = components(one.union(two), "a", "b", local_edges=0)
    release(members, texts, sketches, rest, may, one, two)
    return labels


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``id_col, line, component, n_members, keep_<id_col>, keep_line, kept``: a row for each line (numbered from 0) of a
    component with several lines; equal lines are in one component.

    The first line by (id, number), null ids last, of a component stays. Blank lines never take part; null and empty texts
    have none. Fully repeated rows share their verdicts. An empty table gives an empty result; other columns are ignored.
    """
    own = fresh(docs, id=id_col, text=text_col)
    lines = _lines(own)
    places = materialise(lines.select("id", "pos", "node"), "places")
    labels = line_labels(lines.select("node", "line"), settings)
    where = F.struct(F.col("id").isNull().alias("none"), "id", "pos")
    counts = places.groupBy("node").agg(F.count("*").alias("n"), F.min(where).alias("first"))
    sizes = counts.join(labels, "node", "left").select("node", "n", "first", F.coalesce("comp", "node").alias("component"))
    sizes = materialise(sizes, "sizes")
    totals = sizes.groupBy("component").agg(F.sum("n").alias("n_members"), F.min("first").alias("keep")).where("n_members > 1")
    known = materialise(sizes.select("node", "component").join(totals, "component"), "known")
    return (
        places.join(bounded_broadcast(known), "node")
        .select(
            F.col("id").alias(id_col),
            F.col("pos").cast("long").alias("line"),
            "component",
            "n_members",
            F.col("keep.id").alias(f"keep_{id_col}"),
            F.col("keep.pos").cast("long").alias("keep_line"),
            (F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("pos") == F.col("keep.pos"))).alias("kept"),
        )
    )
