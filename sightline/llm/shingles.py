"""Word shingles, MinHash signatures and odd sketches of many texts at once, in numpy.

Words are runs of bytes other than U+0020, U+0009-U+000D after A-Z are lower-cased. A word's hash sums its blocks of eight bytes,
each mixed with its place; a shingle's hash mixes its words' hashes in order. (Polynomials modulo 2**64, which ``prefix_sums`` gives
for byte strings of bounded length, have known collisions from 1,024 letters on, whatever the base.)
"""

from __future__ import annotations

from functools import cache

import numpy as np

_SPACES = b" \t\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_INK = bytes(0 if bytes([b]) in [_SPACES[i : i + 1] for i in range(6)] else 1 for b in range(256))
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's and its inverse's powers up to n - 1, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    up, _ = powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + _U(1)) * up[: len(raw)], out=sums[1:])
    return sums


def word_places(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the units ``data[offsets[i]:offsets[i + 1]]``, and each unit's first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = np.frombuffer(data.translate(_INK), dtype=np.bool_)
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    at = offsets[offsets < n]
    first[at] = ink[at]
    at = offsets[offsets > 0]
    last[at - 1] = ink[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of each range, one after another."""
    return spread(np.zeros(len(sizes), np.int64), sizes)


_PLACE, _LENGTH = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25)


def hashes_between(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the given parts (none empty), after A-Z are lower-cased."""
    if not len(starts):
        return np.empty(0, np.uint64)
    eights = np.ndarray((len(data),), np.dtype("<u8"), data.translate(_LOWER) + bytes(8), strides=(1,))  # eight bytes from each place on
    sizes = ends - starts
    blocks = (sizes + 7) >> 3
    place = _within(blocks)
    rest = np.repeat(sizes, blocks) - 8 * place
    value = eights[np.repeat(starts, blocks) + 8 * place]
    value &= _U(2**64 - 1) >> (8 * np.maximum(8 - rest, 0)).astype(np.uint64)
    value = mix(mix(value) + (place.astype(np.uint64) + _U(1)) * _PLACE)
    return mix(np.add.reduceat(value, np.cumsum(blocks) - blocks) + sizes.astype(np.uint64) * _LENGTH)


def word_hashes(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the units, and each unit's first word (one more at the end)."""
    starts, ends, first = word_places(data, offsets)
    return hashes_between(data, starts, ends), first


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[p:p + width] for every p, by prefixes and suffixes of blocks."""
    n = len(values) - width + 1
    size = -(-len(values) // width) * width
    blocks = np.full(size, np.iinfo(values.dtype).max, values.dtype)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def leftmost_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value (by the upper 32 bits) of hashes[p:p + width], for every p."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    placed = (hashes & _U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    return (sliding_minimum(placed, width) & _U(0xFFFFFFFF)).astype(np.int64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def sequence_hashes(words: np.ndarray, first: np.ndarray, size: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of the runs of ``size`` (1 or more) word hashes from ``first`` on."""
    if not len(first):
        return np.empty(0, np.uint64)
    value = mix(mix(words[spread(first, size)] + _U(salt)) + (_within(size).astype(np.uint64) + _U(1)) * _PLACE)
    return mix(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64) * _LENGTH)


def equal_sequence_hashes(words: np.ndarray, first: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """``sequence_hashes`` of runs of one size; a word that stands in several runs is mixed once."""
    own, value = mix(words + _U(salt)), np.zeros(len(first), np.uint64)
    for j in range(size):
        value += mix(own[first + j] + _U((j + 1) * int(_PLACE) & (2**64 - 1)))
    return mix(value + _U(size * int(_LENGTH) & (2**64 - 1)))


def _weights(k: int) -> list[np.uint64]:
    return [_U((0xD6E8FEB86659FD93 * (2 * j + 1)) & (2**64 - 1) | 1) for j in range(k)]


def _joined(words: np.ndarray, k: int) -> np.ndarray:
    """A number for the k words from each word on; 0 for the last k - 1."""
    value = np.zeros(len(words), dtype=np.uint64)
    m = len(words) - k + 1
    if m > 0:
        for j, weight in enumerate(_weights(k)):
            value[:m] += words[j : j + m] * weight
    return value


def word_grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the shingle of k words that starts at each word, across units."""
    return mix(_joined(words, k))


def shingles(data: bytes, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of the units, in order, and each unit's first (one more at the end).

    A unit of fewer than k words has its whole sequence as its only shingle; one without words has none.
    """
    words, first = word_hashes(data, offsets)
    counts = np.diff(first)
    value = _joined(words, k)
    weights = _weights(k)
    valid = np.ones(len(words), dtype=np.bool_)
    for j in range(1, k):
        at = first[1:] - j
        valid[at[at >= first[:-1]]] = False
    for length in range(1, k):
        at = first[:-1][counts == length]
        if len(at):
            value[at] = sum((words[at + j] * weights[j] for j in range(length)), np.zeros(len(at), np.uint64)) + _U(length * 0xA24BAED4963EE407 & (2**64 - 1))
            valid[at] = True
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return mix(value[valid]), np.concatenate([[0], np.cumsum(sizes)])


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Each unit's sorted distinct hashes."""
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        s = np.sort(hashes[a:b])
        if b - a > 1:
            keep = np.empty(b - a, np.bool_)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        out.append(s)
    return out


@cache
def _permutations(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**31, samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, samples, dtype=np.uint32)


def minhash(hashes: np.ndarray, bounds: np.ndarray, samples: int) -> np.ndarray:
    """(samples, units) smallest values under random permutations; only units with shingles, whose starts are in ``bounds``."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((samples, len(starts)), dtype=np.uint32)
    if len(starts):
        low, a, b = (hashes >> _U(32)).astype(np.uint32), *_permutations(samples)
        scratch = np.empty_like(low)
        for j in range(samples):
            np.multiply(low, a[j], out=scratch)
            scratch ^= b[j]
            scratch *= np.uint32(0x9E3779B1)
            np.minimum.reduceat(scratch, starts, out=out[j])
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """(units, bands) 64-bit keys of ``rows`` samples each; the band's number is part of the key."""
    bands = signature.shape[0] // rows
    out = np.empty((signature.shape[1], bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(signature.shape[1], b + 1, dtype=np.uint64)
        for j in range(b * rows, (b + 1) * rows):
            key = mix(key * _U(0x9E3779B97F4A7C15) + signature[j])
        out[:, b] = key
    return out.view(np.int64)


def odd_sketch(signature: np.ndarray, bits: int) -> np.ndarray:
    """(units, bits / 64) parity bitmaps: each (sample, value) toggles one bit."""
    samples, units = signature.shape
    out = np.zeros((units, bits // 64), dtype=np.uint64)
    for a in range(0, units, 4096):
        part = signature[:, a : a + 4096].T.astype(np.uint64)
        spot = mix(part + (np.arange(samples, dtype=np.uint64) << _U(32))) % _U(bits)
        spot += (np.arange(len(part), dtype=np.uint64) * _U(bits))[:, None]
        parity = (np.bincount(spot.ravel().astype(np.int64), minlength=len(part) * bits) & 1).astype(np.uint8)
        out[a : a + 4096] = np.packbits(parity.reshape(len(part), bits), axis=1).view(np.uint64)
    return out.view(np.int64)


def buffer_of(column) -> tuple[bytes, np.ndarray]:
    """An Arrow string column's bytes (null: empty) and offsets from 0."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if data is not None else b""), offsets - offsets[0]
