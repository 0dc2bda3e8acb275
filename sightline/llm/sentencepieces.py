"""SentencePiece encoding and decoding by a batched numpy Viterbi (operator 1).

New words of equal length advance together through their lattices. At each position the hashes of all substrings that end
there probe the sorted keys of the pieces, and a vectorised maximum stores the length of the best last piece as
backpointer. For unigram models a path's value is its sum of scores. For BPE models the best path is the result of the
merges: a piece may follow another only if merging their joined text gives just the two back, and of the pieces that end at
a position exactly one may follow the best path to its start, so the maximum runs over those. A text is a sequence of words,
each encoded once and kept in a bounded cache of the worker.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, frugal, slices
from .shingles import mix, powers, spread

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Words that a worker keeps encoded; when there are more, it starts anew.
CACHE_WORDS = 150_000
#: Binary logarithm of how many pairs of pieces a worker keeps an answer for.
ANSWERS = 20
_WORDS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
_NONE = 1 << 40


def _codes(words: list[str]) -> np.ndarray:
    """(words, length) code points of words of equal length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def _sums(codes: np.ndarray) -> np.ndarray:
    up, _ = powers(codes.shape[1])
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, axis=1, out=out[:, 1:])
    return out


class _Sorted:
    """Sorted distinct 64-bit keys with values; a table of the places by the keys' upper bits starts each probe near its end."""

    BITS = 20

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        place = np.argsort(keys, kind="stable")
        self.keys, self.values = np.append(keys[place], np.uint64(0)), np.append(values[place], -1)
        upper = (self.keys[:-1] >> np.uint64(64 - self.BITS)).astype(np.int64)
        count = np.bincount(upper, minlength=1 << self.BITS)
        self.most, self.some = int(count.max(initial=0)), count > 0
        self.first = (np.cumsum(count) - count).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, else -1."""
        out = np.full(len(keys), -1, np.int64)
        upper = keys >> np.uint64(64 - self.BITS)
        live = np.flatnonzero(self.some[upper])
        sought, at = keys[live], self.first[upper[live]]
        for _ in range(self.most):
            met = self.keys[at] == sought
            out[live[met]] = self.values[at[met]]
            left = ~met & (at + 1 < len(self.keys) - 1)
            live, sought, at = live[left], sought[left], at[left] + 1
        return out


@dataclass
class Vocabulary:
    """Pieces and scores by id; ids of the byte pieces; ``kind`` is bpe or unigram."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    ordinary: list[bool]
    unknown: int = 0
    kind: str = "bpe"
    ids: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.ordinary[i]}
        self.longest = max(map(len, self.ids), default=1)
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self._rank_pieces()

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The merges carried out one by one (best score, then leftmost), and the last pair merged."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, str, str]] = []
        last = None

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (i := self.ids.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, parts[a], parts[b]))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        while heap:
            _, a, x, y = heapq.heappop(heap)
            b = right[a] if parts[a] is not None else len(parts)
            if parts[a] != x or b >= len(parts) or parts[b] != y:
                continue
            last, parts[a], parts[b] = (x, y), x + y, None
            right[a] = right[b]
            if right[a] < len(parts):
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p is not None], last

    def _rank_pieces(self) -> None:
        """Inner numbers of the pieces: single characters first, then by score; their keys; how each was merged last."""
        whole = {p: self.merged(p) for p in self.ids} if self.kind == "bpe" else {p: ([p], None) for p in self.ids}
        order = [p for p in self.ids if len(p) == 1] + sorted((p for p in self.ids if len(p) > 1 and len(whole[p][0]) == 1 and set(p) != {BLANK}), key=lambda p: -self.scores[self.ids[p]])
        number = {p: k for k, p in enumerate(order)}
        self.sorted = _Sorted(np.array([self._key(p) for p in order], np.uint64), np.arange(len(order)))
        self.outer = np.array([self.ids[p] for p in order], np.int64)
        self.values = np.array([self.scores[self.ids[p]] for p in order], np.float64)
        split = [(number[a], number[b]) if len(p) > 1 and (ab := whole[p][1]) and (a := ab[0]) in number and (b := ab[1]) in number else (k, k) for k, p in enumerate(order)]
        self.first, self.second = (np.array([s[i] for s in split], np.int64) for i in (0, 1))
        made = [(a, b, k) for k, (a, b) in enumerate(split) if a != k]
        a, b, k = (np.array([m[i] for m in made], np.int64) for i in range(3))
        self.made = _Sorted(self._pair(a, b), k)
        self.asked, self.answer = np.zeros(1 << ANSWERS, np.uint64), np.zeros(1 << ANSWERS, np.bool_)
        self.answer[0] = self._compatible(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]  # the pair whose key is 0

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A key for two inner numbers (of 32 bits at most)."""
        return mix((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))

    @staticmethod
    def _key(piece: str) -> np.uint64:
        return mix(_sums(_codes([piece]))[:, -1])[0]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As ``_compatible``, whose answers are kept in a table of fixed size under the pairs' keys."""
        keys = self._pair(a, b)
        slot = (keys >> np.uint64(64 - ANSWERS)).astype(np.int64)
        out = self.answer[slot]
        miss = np.flatnonzero(self.asked[slot] != keys)
        if len(miss):
            _, one, which = np.unique(keys[miss], return_index=True, return_inverse=True)
            one = miss[one]
            known = self._compatible(a[one], b[one])
            out[miss] = known[which]
            self.asked[slot[one]], self.answer[slot[one]] = keys[one], known
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of piece a and then b leaves the two as they are.

        The merges that made both pieces are undone, latest first; if the parts that then touch would have merged before
        what was undone, the pieces could not have come about side by side.
        """
        out = np.zeros(len(a), np.bool_)
        live, a, b, limit = np.arange(len(a)), a.copy(), b.copy(), np.full(len(a), _NONE)
        while len(live):
            result = self.made.find(self._pair(a, b))
            free = (result < 0) | (result >= limit)
            live, a, b = live[free], a[free], b[free]
            later = a > b
            can_a, can_b = self.second[a] != a, self.first[b] != b
            undo_a = np.where(later, can_a, ~can_b & can_a)
            undo_b = np.where(later, ~can_a & can_b, can_b)
            done = ~undo_a & ~undo_b
            out[live[done]] = True
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.second[a], a), np.where(undo_b, self.first[b], b)
            live, a, b, limit = live[~done], a[~done], b[~done], limit[~done]
        return out

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Inner numbers of the pieces of words of equal length, and how many each has; -1 - code point for a character
        without a piece."""
        codes = _codes(words)
        n, length = codes.shape
        sums, (_, down) = _sums(codes), powers(length + 1)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0.0
        last, back = np.full((n, length + 1), -1, np.int64), np.zeros((n, length + 1), np.int64)
        for i in range(1, length + 1):
            lens = np.arange(1, min(i, self.longest) + 1)
            piece = self.sorted.find(mix((sums[:, i, None] - sums[:, i - lens]) * down[i - lens]).ravel()).reshape(n, -1)
            if self.kind == "bpe":
                value = np.where(piece >= 0, lens, -np.inf)
                row, col = np.nonzero((piece >= 0) & (last[:, i - lens] >= 0) & (i > lens))
                if len(row):
                    fits = self.compatible(last[row, i - lens[col]], piece[row, col])
                    value[row[~fits], col[~fits]] = -np.inf
            else:
                value = np.where(piece >= 0, best[:, i - lens] + self.values[piece], -np.inf)
            chosen = np.argmax(value, axis=1)
            rows = np.arange(n)
            top = value[rows, chosen]
            lost = np.isneginf(top)
            chosen[lost] = 0
            best[:, i] = np.where(lost, best[:, i - 1] - 1e6, top)
            last[:, i] = np.where(lost, -1, piece[rows, chosen])
            back[:, i] = lens[chosen]
        found = np.full((n, length), _NONE, np.int64)
        at, rows, column = np.full(n, length), np.arange(n), length
        while len(rows):
            number = last[rows, at]
            column -= 1
            found[rows, column] = np.where(number >= 0, number, -1 - codes[rows, at - 1].astype(np.int64))
            at = at - back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        some = found != _NONE
        return found[some], some.sum(axis=1)

    def _pieces_out(self, numbers: list[int]) -> list[int]:
        out: list[int] = []
        for k in numbers:
            if k >= 0:
                out.append(int(self.outer[k]))
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in chr(-1 - k).encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def _sections(self, word: str) -> list[str]:
        """A long word cut where no piece holds both neighbours, so no merge or piece crosses."""
        if len(word) <= 24:
            return [word]
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def _encode_plain(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words by length, their ids one after another, and how many each has; at most one blank, at a word's start."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        order, ids, sizes = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for length, group in sorted(by_length.items()):
            rows = max(1, 400_000 // length)
            for a in range(0, len(group), rows):
                part = group[a : a + rows]
                numbers, size = self.viterbi(part)
                if (numbers < 0).any():
                    ends = np.cumsum(size).tolist()
                    lists = [self._pieces_out(numbers[e - k : e].tolist()) for e, k in zip(ends, size.tolist())]
                    numbers, size = np.fromiter((i for x in lists for i in x), np.int64), np.array([len(x) for x in lists])
                else:
                    numbers = self.outer[numbers]
                order += part
                ids.append(numbers)
                sizes.append(size)
        return order, np.concatenate(ids), np.concatenate(sizes)

    def encode_words(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in some order, their ids one after another, and how many each has.

        A word is a run of blanks, a line feed, or characters after blanks; long ones and ones after several blanks are put
        together from parts.
        """
        plain, made = [], {}
        for w in words:
            if len(w) <= 24 and w[:2] != BLANK + BLANK and w != BLANK:
                plain.append(w)
            else:
                core = w.lstrip(BLANK)
                made[w] = self._sections(BLANK * (len(w) > len(core)) + core) if core else []
        order, ids, sizes = self._encode_plain(plain)
        if made:
            names, flat, size = self._encode_plain(list({s for parts in made.values() for s in parts}))
            ends = np.cumsum(size).tolist()
            found = {s: flat[e - k : e].tolist() for s, e, k in zip(names, ends, size.tolist())}
            alone, lists = self.ids.get(BLANK), []
            for w, parts in made.items():
                blanks = len(w) - len(w.lstrip(BLANK))
                own = [i for s in parts for i in found[s]]
                extra = max(0, blanks - 1) if own else blanks
                if self.kind == "bpe" and extra and own and own[0] == alone:
                    extra, own = extra + 1, own[1:]  # a blank that merges with nothing after it belongs to the run
                lists.append([self.ids.get(p, self.unknown) for p in self.merged(BLANK * extra)[0]] + own if extra else own)
            order = order + list(made)
            ids = np.concatenate([ids, np.fromiter((i for x in lists for i in x), np.int64)])
            sizes = np.concatenate([sizes, np.array([len(x) for x in lists], np.int64)])
        return order, ids, sizes

    def piece_bytes(self) -> list[bytes]:
        table = [p.replace(BLANK, " ").encode() if self.ordinary[i] else b"" for i, p in enumerate(self.pieces)]
        for value, i in enumerate(self.byte_ids):
            table[i] = bytes([value])
        return table


def load_vocabulary(model_file: str = MODEL_FILE, kind: str = "bpe") -> Vocabulary:
    """Reads a model's pieces with the sentencepiece library; nothing else of it is used."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(m.vocab_size())
    byte_ids = [i for i in ids if m.is_byte(i)]
    special = {i for i in ids if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)} | set(byte_ids)
    return Vocabulary([m.id_to_piece(i) for i in ids], [m.get_score(i) for i in ids], byte_ids, [i not in special for i in ids], m.unk_id(), kind)


class _Cache:
    """Encoded words of one worker: ids in one growing array, addressed by word. It outlives a task, as the vocabulary does."""

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> _Cache:
        if not hasattr(vocabulary, "cache"):
            vocabulary.cache = cls(vocabulary)
        return vocabulary.cache

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.index = vocabulary, {}
        self.flat, self.start = np.empty(0, np.int32), np.zeros(1, np.int64)

    def add(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > CACHE_WORDS:
            self.__init__(self.vocabulary)
            new = words
        if new:
            order, ids, sizes = self.vocabulary.encode_words(new)
            self.index |= zip(order, range(len(self.index), len(self.index) + len(order)))
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of different words start, and how many each has; new words are encoded."""
        self.add(words)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return self.start[at], self.start[at + 1] - self.start[at]


def _encoded(cache: _Cache, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts one after another, and each text's first (one more at the end)."""
    words = [_WORDS.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
    all_words = [w for x in words for w in x]
    names = list(set(all_words))
    number = dict(zip(names, range(len(names))))  # small, so the look-ups of all words stay in the processor's cache
    at = np.fromiter(map(number.__getitem__, all_words), np.int64, len(all_words))
    first, size = cache.places(names)
    first, size = first[at], size[at]
    return cache.flat[spread(first, size)], np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, words)])]


def _decoded(table: list[bytes], ids: list[int]) -> str:
    return b"".join(map(table.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


def _encode_batches(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache = _Cache.of(shared.value)
        for whole in batches:
            for batch in slices(whole, ["text"], 1_000_000):
                ids, ends = _encoded(cache, batch.column(1).to_pylist())
                yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=["id", "text", "pieces"])

    return run


def _decode_batches(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = shared.value
        for batch in batches:
            out = [_decoded(table, ids.values.to_pylist() if ids.is_valid else []) for ids in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string())], names=["id", "text", "pieces", "decoded"])

    return run


def _round_trip_batches(shared):
    """Encoding and decoding in one worker, without the texts on the way back."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache, table = _Cache.of(shared.value), shared.value.piece_bytes()
        for whole in batches:
            for batch in slices(whole, ["text"], 1_000_000):
                texts = batch.column(1).to_pylist()
                ids, ends = _encoded(cache, texts)
                flat, cuts = ids.tolist(), ends.tolist()
                same = [_decoded(table, flat[a:b]) == (t or "") for t, a, b in zip(texts, cuts, cuts[1:])]
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array(same, pa.bool_())], names=["id", "pieces", "round_trip"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL_FILE, kind: str = "bpe") -> DataFrame:
    """``id, text, pieces``: one row per input row, without a shuffle.

    Null and empty texts have no pieces. Rows are encoded one by one, so null, repeated or clashing ids and other columns
    make no difference; an empty table gives an empty result. Characters without a piece become their UTF-8 bytes'
    pieces. The vocabulary, whose size is fixed, is read on the driver and broadcast.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(model_file, kind))
    return fresh(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text").mapInArrow(frugal(_encode_batches(shared)), "id long, text string, pieces array<int>")


def decode(encoded: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """Adds ``decoded`` to ``id, text, pieces``: the pieces' text without the blank put before every text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model_file).piece_bytes())
    return encoded.select("id", "text", "pieces").mapInArrow(frugal(_decode_batches(shared)), "id long, text string, pieces array<int>, decoded string")


def pieces_and_back(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL_FILE) -> DataFrame:
    """``id_col, n_pieces, pieces, round_trip``: the pieces of each text and whether decoding them gives it back."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))
    own = fresh(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    both = own.mapInArrow(frugal(_round_trip_batches(shared)), "id long, pieces array<int>, round_trip boolean")
    return both.select(F.col("id").alias(id_col), F.size("pieces").cast("long").alias("n_pieces"), "pieces", "round_trip")
