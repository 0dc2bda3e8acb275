"""Maximal periodic runs of words, by Lyndon arrays over an ordered alphabet in linear time (Ellert and Fischer).

The words of a text are letters, ordered by their bytes; letters are only compared, never hashed, and no suffix array or tree is built.
A run of period p has, for the order of letters or for its reverse, a place i from which the longest Lyndon word is as long
as p, and the next one starts at the next smaller suffix i + p. So each run is seen as an edge from a place to its next smaller
suffix, together with the length over which both suffixes agree.

``edges`` finds the next and previous smaller suffixes from left to right, and the agreement of each edge:

* Climbing from r - 1 along previous smaller suffixes, the agreement with r follows from the last one and from that of the edge
  climbed, unless both are equal; only then are letters compared, and only behind what is known to agree.
* Of all agreements so far, the one that ends furthest right is remembered: ``t[x:far] == t[x-d:far-d]``. A later edge (l, r)
  within it has its mirror edge (l-d, r-d), found before; if the mirror's agreement ends before ``far`` it is copied, else letters
  are compared from ``far`` on. So every comparison moves ``far`` or ends an edge, as in Manacher's palindromes.

Runs of four periods or more, which are wanted here, lie where the same words come again at short distances: a stretch of three
periods in which every word comes again within one. Places whose word does not come again within a third of the stretch around
them cannot be inside, so they cut stretches; what is left when no more cuts are found goes through ``edges`` whole. This
removes places only, never runs (tests: with and without).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import fresh, frugal, slices

#: Letters and periods that a run needs at least.
LEAST, EXPONENT = 6, 4


def edges(t: list[int]) -> tuple[list[int], list[int]]:
    """For each place the start of its next smaller suffix (``len(t)`` if none) and how many letters both share."""
    n = len(t)
    after, after_same = [n] * n, [0] * n
    before, before_same = [-1] * n, [0] * n
    far = d = x = 0
    for r in range(1, n):
        left, same, exact = r - 1, 0, False
        while True:
            if not exact:
                compare = True
                if left >= x and r + same < far:
                    a, b = left - d, r - d
                    known = after_same[a] if after[a] == b else before_same[b] if before[b] == a else same
                    compare = known >= far - r or (after[a] != b and before[b] != a)
                    same = max(same, min(known, far - r))
                if compare:
                    i, j = left + same, r + same
                    while j < n and t[i] == t[j]:
                        i += 1
                        j += 1
                    same = j - r
                    if j >= far:
                        far, d, x = j, r - left, r
            if r + same < n and t[left + same] < t[r + same]:
                before[r], before_same[r] = left, same
                break
            after[left], after_same[left] = r, same
            up, up_same = before[left], before_same[left]
            if up < 0:
                break
            if up_same < same:
                before[r], before_same[r] = up, up_same
                break
            exact, left = up_same > same, up
    return after, after_same


def runs_of(t: list[int], least: int = LEAST, exponent: int = EXPONENT) -> set[tuple[int, int, int]]:
    """``(start, length, period)`` of the maximal runs of ``exponent`` (3 or more) periods and ``least`` letters.

    Only a run's first Lyndon root is extended to the left, by less than a period. At the end of the text, both orders find it.
    """
    found = set()
    for letters in (t, [-x for x in t]):
        after, same = edges(letters)
        n = len(t)
        for i in range(n):
            j = after[i]
            p = j - i
            if j == n or same[i] < (exponent - 2) * p or (i >= p and after[i - p] == i and same[i - p] >= p):
                continue
            k = i
            while k and t[k - 1] == t[k - 1 + p]:
                k -= 1
            length = j + same[i] - k
            if length >= max(least, exponent * p):
                found.add((k, length, p))
    return found


def stretches(gap: np.ndarray, ends: np.ndarray, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Disjoint ranges of places that hold all runs of ``exponent`` periods.

    gap: the distance to the same word's next place in its text (0: none). ends: the end of each place's text.
    """
    at = np.flatnonzero(gap)
    while len(at):
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        sizes = np.diff(first, append=len(at))
        keep = gap[at] * (exponent - 1) <= np.repeat(sizes, sizes)
        if keep.all():
            break
        at = at[keep]
    if not len(at):
        return []
    begin = at[first]
    end = np.minimum(begin + sizes + sizes // (exponent - 1), ends[begin])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] >= np.maximum.accumulate(end)[:-1]]))
    return list(zip(begin[new].tolist(), np.maximum.reduceat(end, new).tolist()))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def ranks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The rank of every word among the words of all texts, in byte order, and where each text's words start (one more at the end)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    inside = ~_BLANK[data]
    change = np.diff(inside.view(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    starts = np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    if not len(begin):
        return np.zeros(0, np.int64), starts
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside].tobytes())])
    order = pc.array_sort_indices(words).to_numpy().astype(np.int64)
    ordered = words.take(pa.array(order))
    number = np.zeros(len(begin), dtype=np.int64)
    number[order[1:]] = np.cumsum(pc.not_equal(ordered[1:], ordered[:-1]).to_numpy(zero_copy_only=False))
    return number, starts


def gaps(number: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The distance from each place to the next with the same number in the same text; 0 if there is none."""
    gap = np.zeros(len(number), dtype=np.int64)
    order = np.argsort(number, kind="stable")
    a, b = order[:-1], order[1:]
    hit = (number[a] == number[b]) & (text[a] == text[b])
    gap[a[hit]] = (b - a)[hit]
    return gap


def planted_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Of a tenth of the documents, by their id's checksum: the word from which on the next p words repeat, and p."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def texts_with_runs(ids: list, texts: list[bytes], rewrite: Callable | None, least: int = LEAST, exponent: int = EXPONENT) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """For each text its runs by start and period, and the words that stay without the repetitions of runs."""
    number, starts = ranks(texts)
    sizes = np.diff(starts)
    sources: dict[int, np.ndarray] = {}
    if rewrite is not None:
        for k, (doc_id, n) in enumerate(zip(ids, sizes.tolist())):
            if (tail := rewrite(doc_id, n)) is not None:
                a, p = tail
                place = np.arange(n)
                sources[k] = np.where(place < a, place, a + (place - a) % p)
                number[starts[k] : starts[k + 1]] = number[starts[k] + sources[k]]
    text = np.repeat(np.arange(len(texts)), sizes)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in stretches(gaps(number, text), np.repeat(starts[1:], sizes), exponent):
        k = int(text[a])
        found.setdefault(k, []).extend((a + s - int(starts[k]), length, p) for s, length, p in runs_of(number[a:b].tolist(), least, exponent))
    for k, raw in enumerate(texts):
        mine = sorted(found.get(k, ()), key=lambda r: (r[0], r[2]))
        words = raw.split()
        if k in sources:
            words = [words[i] for i in sources[k].tolist()]
        if mine:
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            for s, length, p in mine:
                cover[s + p] += 1
                cover[s + length] -= 1
            words = [w for w, c in zip(words, np.cumsum(cover).tolist()) if not c]
        yield mine, words


def _batches(batches: Iterator, rewrite: Callable | None, row: Callable, finish: Callable) -> Iterator:
    import pyarrow as pa

    for whole in batches:
        for batch in slices(whole, ["text"]):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
            rows = [row(*r) for r in texts_with_runs(ids, [t or b"" for t in texts], rewrite)]
            yield finish(batch.column(0), rows)


def _run_batches(rewrite: Callable | None) -> Callable:
    def finish(ids, rows):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        listed = [[dict(zip(("start", "length", "period"), x)) for x in runs] for runs, _ in rows]
        return pa.record_batch([ids, pa.array(listed, kind), pa.array([b" ".join(words).decode() for _, words in rows], pa.string())], names=["id", "runs", "collapsed"])

    return lambda batches: _batches(batches, rewrite, lambda runs, words: (runs, words), finish)


def _digest(runs: list[tuple[int, int, int]], words: list[bytes]) -> tuple:
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join("%d,%d,%d\n" % r for r in runs)
    milli = 1000 * longest[1] // longest[2] if runs else None
    return len(runs), *longest, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


_DIGEST = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}


def _digest_batches(rewrite: Callable | None) -> Callable:
    def finish(ids, rows):
        import pyarrow as pa

        columns = [pa.array(c, pa.string() if kind == "string" else pa.int64()) for c, kind in zip(zip(*rows), _DIGEST.values())]
        return pa.record_batch([ids, *columns], names=["id", *_DIGEST])

    return lambda batches: _batches(batches, rewrite, _digest, finish)


def _own(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return fresh(docs, id=id_col, text=text_col), docs.schema[id_col].dataType.simpleString()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable | None = None) -> DataFrame:
    """``id, runs array<struct<start, length, period>>, collapsed``: one row per input row, without a shuffle.

    Words are split at ASCII blanks. ``runs``: every maximal run of four periods and six words or more, by start and period.
    ``collapsed``: the words that are in no run behind its first period, joined by a blank. ``rewrite`` may replace the end of a
    text by a repetition (see ``planted_tail``). Null, empty and blank texts have no run and collapse to the empty text. Rows
    are read one by one, so null, repeated or clashing ids of any type and other columns make no difference; an empty table
    gives an empty result. Memory is that of some four megabytes of text, or of the longest text.
    """
    own, kind = _own(docs, id_col, text_col)
    return own.mapInArrow(frugal(_run_batches(rewrite)), f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def run_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable | None = planted_tail) -> DataFrame:
    """Of each row: the number of runs, the longest one (ties: smallest start, then period; nulls if none), its thousandths of
    periods, and digests of the list of runs and of the collapsed text. A document without an id is not rewritten."""
    own, kind = _own(docs, id_col, text_col)
    schema = f"id {kind}, " + ", ".join(f"{name} {type_}" for name, type_ in _DIGEST.items())
    return own.mapInArrow(frugal(_digest_batches(rewrite)), schema).withColumnRenamed("id", id_col)
