"""ROUGE-L, BLEU and METEOR of pairs of texts, within the row: no step shuffles words.

``pairs`` has ``id`` (different for each pair), ``candidate`` and ``reference``; null texts count as empty. Stems and the alignment of
METEOR are Python over batches of rows, the rest are expressions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stems import porter

#: Bits of a limb; the rest of a long holds the carry.
LIMB = 62


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, bit-parallel: a bit for each member of ``a``, all moved by
    one addition a limb for each member of ``b``. A member of ``b`` looks through the different members of ``a``."""
    full = F.lit((1 << LIMB) - 1)

    def run(x: Column) -> Column:
        last = F.floor((F.size(x) - 1) / LIMB).cast("int")
        limbs = F.sequence(F.lit(0), last)
        part = lambda l: F.slice(x, l * LIMB + 1, LIMB)
        # A set bit for each place of a member within a limb.
        bits = lambda word, l: F.aggregate(F.transform(part(l), lambda y, i: F.when(y == word, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(v))
        places = F.map_from_entries(F.transform(F.array_distinct(x), lambda word: F.struct(word, F.transform(limbs, lambda l: bits(word, l)))))
        start = F.transform(limbs, lambda l: full)

        def step(v: Column, mask: Column) -> Column:
            """v' = (v + (v & mask)) | (v & ~mask), limb by limb with the carry."""

            def limb(s: Column, l: Column) -> Column:
                old, m = F.get(v, l), F.get(mask, l)
                total = lambda: old + old.bitwiseAND(m) + s["carry"]
                new = total().bitwiseAND(full).bitwiseOR(old.bitwiseAND(F.bitwise_not(m)))
                return F.struct(F.array_append(s["out"], new).alias("out"), F.shiftright(total(), LIMB).alias("carry"))

            zero = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("carry"))
            return F.aggregate(limbs, zero, limb, lambda s: s["out"])

        def ones(v: Column) -> Column:
            used = lambda l: F.least(F.size(x) - l * LIMB, F.lit(LIMB))
            mask = lambda l: F.call_function("shiftleft", F.lit(1).cast("long"), used(l)) - 1
            return F.aggregate(F.transform(v, lambda y, l: F.bit_count(y.bitwiseAND(mask(l)))), F.lit(0), lambda s, n: s + n)

        def found(p: Column) -> Column:
            end = F.aggregate(b, start, lambda v, word: F.when(F.try_element_at(p, word).isNull(), v).otherwise(step(v, F.try_element_at(p, word))))
            return F.size(x) - _let(end, ones)

        return _let(places, found)

    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(0)).otherwise(run(a))


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def blank_split(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def _f_measure(shared: Column, a: Column, b: Column) -> Column:
    return F.when(shared > 0, 2 * shared / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def rouge_l(pairs: DataFrame) -> DataFrame:
    """``id, rouge_l``: F measure of the longest common subsequence of words."""
    split = pairs.select("id", words_of(F.col("candidate")).alias("a"), words_of(F.col("reference")).alias("b"))
    return split.select("id", _f_measure(lcs_length(F.col("a"), F.col("b")), F.col("a"), F.col("b")).alias("rouge_l"))


#: Stems that a worker keeps.
STEMS = 100_000


def _stem_batches(least: int):
    """Of rows (id, a, b) the same with stems for the words of at least ``least`` letters."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        stem = lru_cache(STEMS)(porter)
        stemmed = lambda words: [stem(w) if len(w) >= least else w for w in words]
        for batch in batches:
            sides = (pa.array([stemmed(words) for words in batch.column(c).to_pylist()], pa.list_(pa.string())) for c in "ab")
            yield pa.record_batch([batch.column("id"), *sides], names=["id", "a", "b"])

    return run


def rouge_l_stemmed(pairs: DataFrame, least: int = 4) -> DataFrame:
    """``id, rouge_l``: as ``rouge_l`` over stems; words of fewer than ``least`` letters are not stemmed."""
    split = pairs.select("id", words_of(F.col("candidate")).alias("a"), words_of(F.col("reference")).alias("b"))
    both = split.mapInArrow(_stem_batches(least), f"id {pairs.schema['id'].dataType.simpleString()}, a array<string>, b array<string>")
    return both.select("id", _f_measure(lcs_length(F.col("a"), F.col("b")), F.col("a"), F.col("b")).alias("rouge_l"))


def bleu(pairs: DataFrame, orders: int = 4, smooth: float = 5.0) -> DataFrame:
    """``id, bleu``: geometric mean of the clipped n-gram precisions of words between blanks, times the brevity penalty.

    Orders without a match are smoothed: the k-th of them counts ln(length) / (2^k * smooth) matches; 1e-9 for texts of one word.
    """
    split = pairs.select("id", blank_split(F.col("candidate")).alias("a"), blank_split(F.col("reference")).alias("b"))
    grams = lambda words, n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: i + n - 1 <= F.size(words)), lambda i: F.array_join(F.slice(words, i, n), " "))
    # The second of equal grams of a text is another member than the first, so that shared members are clipped counts.
    told_apart = lambda g: _let(g, lambda x: F.transform(x, lambda y, i: F.concat_ws("\0", y, (i + 1 - F.array_position(x, y)).cast("string"))))
    numbered = lambda c, n: told_apart(F.array_sort(grams(F.col(c), n)))
    hits = lambda n: F.size(F.array_intersect(numbered("a", n), numbered("b", n)))
    rows = split.select("id", F.size("a").alias("x"), F.size("b").alias("y"), *(hits(n).alias(f"h{n}") for n in range(1, orders + 1)))
    missed, logs = F.lit(0), F.lit(0.0)
    for n in range(1, orders + 1):
        none = F.col(f"h{n}") == 0
        missed = missed + F.when(none, 1).otherwise(0)
        smoothed = F.when(F.col("x") > 1, F.log("x") / (F.pow(F.lit(2.0), missed) * smooth)).otherwise(F.lit(1e-9))
        logs = logs + F.log(F.when(none, smoothed).otherwise(F.col(f"h{n}")) / F.greatest(F.col("x") - (n - 1), F.lit(1))) / orders
    brief = F.when(F.col("x") < F.col("y"), F.exp(1 - F.col("y") / F.col("x"))).otherwise(F.lit(1.0))
    return rows.select("id", F.when((F.col("x") == 0) | (F.col("y") == 0) | (F.col("h1") == 0), F.lit(0.0)).otherwise(brief * F.exp(logs)).alias("bleu"))


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of the words that are the same, the last with the last and so on, as often as both lists have them."""
    places: dict[str, list[int]] = defaultdict(list)
    for j, word in enumerate(b):
        places[word].append(j)
    return [(i, places[a[i]].pop()) for i in range(len(a) - 1, -1, -1) if places.get(a[i])]


def _align_batches(stemmed: bool):
    """Of rows (id, a, b) the numbers of words, of matches, and of chunks of matches that follow each other on both sides."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        stem = lru_cache(STEMS)(porter)

        def counts(a: list[str], b: list[str]) -> tuple[int, int, int, int]:
            found = aligned(a, b)
            if stemmed:
                left = [sorted(set(range(len(words))) - {pair[side] for pair in found}) for side, words in enumerate((a, b))]
                rest = aligned([stem(a[i]) for i in left[0]], [stem(b[j]) for j in left[1]])
                found += [(left[0][i], left[1][j]) for i, j in rest]
            known = set(found)
            return len(a), len(b), len(found), sum((i - 1, j - 1) not in known for i, j in found)

        for batch in batches:
            rows = [counts(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            columns = zip(*rows) if rows else [()] * 4
            yield pa.record_batch([batch.column("id"), *(pa.array(c, pa.int64()) for c in columns)], names=["id", "x", "y", "matches", "chunks"])

    return run


def meteor(pairs: DataFrame, stemmed: bool = True, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> DataFrame:
    """``id, matches, chunks, meteor`` over lower-case words between blanks: equal words are aligned, then the rest by stems.

    There are as many matches as both texts allow; of words that come several times, the last are aligned with the last, so
    equal words never cross. Synonyms, which need a lexicon, are left out.
    """
    lower = lambda c: blank_split(F.lower(F.col(c)))
    split = pairs.select("id", lower("candidate").alias("a"), lower("reference").alias("b"))
    rows = split.mapInArrow(_align_batches(stemmed), f"id {pairs.schema['id'].dataType.simpleString()}, x long, y long, matches long, chunks long")
    p, r = F.col("matches") / F.col("x"), F.col("matches") / F.col("y")
    score = p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * F.pow(F.col("chunks") / F.col("matches"), F.lit(beta)))
    return rows.select("id", "matches", "chunks", F.when(F.col("matches") > 0, score).otherwise(F.lit(0.0)).alias("meteor"))
