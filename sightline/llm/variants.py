"""Spelling variants: words one edit apart, found by merging the light subtrees of a trie (an errata trie with one error).

Take the trie of all words. At every branching node one child is the heavy one; the path along heavy children is a heavy path, and
a word leaves heavy paths at few nodes: at each, what is left of its subtree at most halves. Where a word P a X leaves node P by a light
edge a (or by ending there) while the heavy edge is h, the light subtree is merged into the heavy one, with one character

* replaced:  P h X, beside the other light words that become the same, and the word P h X itself,
* skipped:   P X,
* put in:    P h a X, which is the heavy side's word with h skipped.

Two words at one edit have a deepest common node P. There at least one of them is on a light edge, so one of the three
coincidences of terminals gives the pair, and (if the skipped character differs from the next one) no other node does. Terminals
coincide by a shuffle on their string; words that become the same by replacing one place differ there only, so they are as many as
there are letters at most, and their best members are found without listing pairs.

The words are sorted and cut into ranges, each of which is walked as a trie of its own. A node that lies across
several ranges needs one heavy child that all of them know: the one with most range bounds, read off the list of bounds. Any
choice gives the right pairs, and the size of a subtree counted in ranges keeps the walk short.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words a range holds, about; memory of a task grows with it, the number of bounds falls with it.
RANGE_WORDS = 20_000

#: A document's words whose checksum this divides lose a character.
DAMAGE = 97


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_count: int = 3, damage: int = DAMAGE) -> DataFrame:
    """``word, n`` of runs of Latin letters, lower-cased in A-Z only, counted over all documents.

    A run loses a character where its checksum with the document's id is a multiple of ``damage`` (0: never); a null id reads as
    the empty string there. Null texts have no words; rows that repeat count again.
    """
    own = fresh(docs, id=id_col, text=text_col)
    listed = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    each = own.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.explode(listed).alias("word"))
    if damage:
        each = each.where(F.length("word") >= least_chars).withColumn("h", F.crc32(F.concat_ws(":", "id", "word")))
        gone = F.concat(F.expr("substring(word, 1, int(h % length(word)))"), F.expr("substring(word, int(h % length(word)) + 2)"))
        each = each.select(F.when(F.col("h") % damage == 0, gone).otherwise(F.col("word")).alias("word"))
    return each.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _common(a: str, b: str) -> int:
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Bounds:
    """The first word of each range but the first, and how much of it the last word of the range before shares."""

    def __init__(self, ranges: list[tuple[str, str]]):
        """ranges: (first, last) word of each, in order."""
        self.firsts = [first for first, _ in ranges[1:]]
        self.depths = [_common(a[1], b[0]) for a, b in zip(ranges, ranges[1:])]

    def across(self, word: str) -> int:
        """Down to which depth the nodes above ``word``, the first or last of its range, lie in other ranges too."""
        at = bisect_left(self.firsts, word)
        near = [k for k in (at - 1, at, at + 1) if 0 <= k < len(self.firsts)]
        return max((min(self.depths[k], _common(word, self.firsts[k])) for k in near), default=-1)

    def heavy(self, node: str) -> str | None:
        """The child of a node across ranges with most bounds; ties: the smallest. None: the node lies in one range."""
        depth, seen = len(node), Counter()
        for k in range(bisect_left(self.firsts, node), len(self.firsts)):
            if not self.firsts[k].startswith(node):
                break
            if self.depths[k] >= depth:
                seen[self.firsts[k][depth]] += 1
        return min(seen, key=lambda c: (-seen[c], c), default=None)


def light_edges(words: list[str], bounds: Bounds) -> list[list[tuple[int, str]]]:
    """For each word of a range (sorted, distinct) the depths at which it leaves a heavy path, with the heavy letter there."""
    import numpy as np

    leaves: list[list[tuple[int, str]]] = [[] for _ in words]
    shared = np.array([0, *map(_common, words, words[1:])])
    stack = [(0, len(words), 0)]
    while stack:
        low, high, depth = stack.pop()
        word = words[low]
        here = int(shared[low + 1 : high].min()) if high - low > 1 else len(word)
        # Nodes on the way to the branching one that branch in other ranges.
        outer = max(bounds.across(words[k]) for k in {low, high - 1} & {0, len(words) - 1}) if low == 0 or high == len(words) else -1
        for d in range(depth, min(here, outer + 1)):
            heavy = bounds.heavy(word[:d])
            if heavy is not None and heavy != word[d]:
                for k in range(low, high):
                    leaves[k].append((d, heavy))
        at_end = high - low == 1
        if at_end and here > outer:
            continue
        starts = [low] if at_end else [low, *(low + 1 + np.flatnonzero(shared[low + 1 : high] == here)).tolist()]
        groups = list(zip(starts, [*starts[1:], high]))
        heavy = bounds.heavy(word[:here]) if here <= outer else None
        if heavy is None:
            inner = [(a, b) for a, b in groups if len(words[a]) > here]
            if not inner:
                continue
            heavy = words[max(inner, key=lambda g: (g[1] - g[0], -g[0]))[0]][here]
        for a, b in groups:
            if len(words[a]) > here:
                stack.append((a, b, here + 1))
                if words[a][here] == heavy:
                    continue
            for k in range(a, b):
                leaves[k].append((here, heavy))
    return leaves


#: Kinds of changed words: a character replaced, skipped, put in.
REPLACED, SKIPPED, PUT_IN = 0, 1, 2


def changed(word: str, leaves: list[tuple[int, str]]) -> Iterator[tuple[str, int, int]]:
    """``(terminal, kind, depth)`` of a word's copies in the subtrees that its light subtrees are merged into."""
    for d, heavy in leaves:
        head, tail = word[:d], word[d + 1 :]
        yield head + heavy + word[d:], PUT_IN, d
        if d < len(word):
            yield head + heavy + tail, REPLACED, d
            if tail[:1] != word[d]:
                yield head + tail, SKIPPED, d


def _merge_light(bounds: Bounds):
    def run(table):
        import pyarrow as pa

        pairs = sorted(zip(table.column("word").to_pylist(), table.column("n").to_pylist()))
        words = [w for w, _ in pairs]
        terminal, kind, depth, word, n = [], [], [], [], []
        for (w, count), leaves in zip(pairs, light_edges(words, bounds)):
            for t, k, d in changed(w, leaves):
                terminal.append(t), kind.append(k), depth.append(d), word.append(w), n.append(count)
        return pa.table([pa.array(terminal, pa.string()), pa.array(kind, pa.int32()), pa.array(depth, pa.int32()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["terminal", "kind", "depth", "word", "n"])

    return run


def merged(words: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """``terminal, kind, depth, word, n``: every word's copies by light subtree, of ``word, n`` (distinct words, written)."""
    ranges = max(1, -(-words.count() // range_words))
    placed = materialise(words.repartitionByRange(ranges, "word").withColumn("part", F.spark_partition_id()), "ranges")
    ends = placed.groupBy("part").agg(F.min("word"), F.max("word")).collect()  # two words a range
    bounds = Bounds(sorted((a, b) for _, a, b in ends))
    out = materialise(placed.groupBy("part").applyInArrow(_merge_light(bounds), "terminal string, kind int, depth int, word string, n long"), "merged")
    release(placed)
    return out


def _best(n: str, word: str):
    """Least for the largest n, then the smallest word."""
    return F.struct((-F.col(n)).alias("minus"), F.col(word).alias("word"))


def near_words(words: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """``word, n_near, best`` (struct ``minus``, ``word``: the near word of largest n) of words with a near word."""
    copies = merged(words, range_words)
    own = words.select(F.col("word").alias("terminal"), F.col("n").alias("own_n"))
    moved = copies.repartition("terminal")
    # Words that become the same by replacing one place, with the word that stands there itself: some 90 letters, so as many members.
    alike = moved.where(F.col("kind") == REPLACED).groupBy("terminal", "depth").agg(F.collect_list(_best("n", "word")).alias("members"))
    alike = alike.join(own, "terminal", "left")
    itself = F.struct((-F.col("own_n")).alias("minus"), F.col("terminal").alias("word"))
    alike = alike.select(F.array_sort(F.when(F.col("own_n").isNull(), F.col("members")).otherwise(F.array_append("members", itself))).alias("members"))
    replaced = alike.where(F.size("members") > 1).select("members", F.posexplode("members").alias("at", "me"))
    replaced = replaced.select(F.col("me.word").alias("word"), (F.size("members") - 1).cast("long").alias("near"), F.expr("members[if(at = 0, 1, 0)]").alias("best"))
    other = moved.where(F.col("kind") != REPLACED).join(own, "terminal")
    ends = F.explode(F.array(F.struct(F.col("word").alias("word"), _best("own_n", "terminal").alias("best")), F.struct(F.col("terminal").alias("word"), _best("n", "word").alias("best")))).alias("x")
    other = other.select(ends).select("x.word", F.lit(1).cast("long").alias("near"), "x.best")
    out = materialise(replaced.union(other).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")), "near")
    release(copies)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: forms followed to the last by doubling. A form's n is twice the word's, so there are no
    cycles, chains are as long as the logarithm of the largest n, and rounds are as many as that length's."""
    state = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialise(state.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        release(state)
        state = after
        if not state.where("moved").limit(1).count():
            return state.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_count: int = 3, factor: int = 2, damage: int = DAMAGE, range_words: int = RANGE_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row per word of ``least_chars`` characters or more, found ``least_count`` times.

    Near words differ by one character put in, left out or replaced. A word's form is its near word of largest n (ties: the
    smallest), if that is ``factor`` (2 or more) times the word's own or more; its root is the last of the forms of forms, or the word. A word without a near
    word has n_near 0 and is its own root. Texts are split into words on Spark's side, whatever their length; null texts and
    empty tables give no words; ids may be null, repeated and of any type; other columns make no difference.
    """
    words = materialise(word_counts(docs, id_col, text_col, least_chars, least_count, damage), "words")
    near = near_words(words, range_words)
    known = words.join(near, "word", "left")
    form_n = F.when(-F.col("best.minus") >= factor * F.col("n"), -F.col("best.minus"))
    known = materialise(known.select("word", F.when(form_n.isNotNull(), F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form_n.alias("form_n")), "forms")
    last = roots(known.where("form IS NOT NULL"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
