"""Byte-level BPE encoding and decoding: the tiktoken library with a local rank file, over texts of any length.

The pattern splits a text into pieces and the library merges each piece's bytes by rank. No piece of the pattern goes from
a visible character on to a blank or line feed, and the only look-ahead sits behind blanks. So the pieces of a text are those of
its sections, one after another, if sections end at a visible character before a blank or line feed. Long texts are cut there and
encoded section by section; a run without such a place stays one section, whose merges the library makes with a heap.
Long runs of blanks, on which the library's matcher runs out of stack, are taken out: such a run is one piece but for its last blank
if a visible character follows, and the library merges that piece.
Decoding joins the bytes of the tokens. A token may end inside a character, so a text comes from the joined bytes only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import fresh, frugal, slices

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

#: Code points after which a section ends at the next safe place.
SECTION = 1 << 16

_SAFE = re.compile(r"\S(?=[ \n])")

#: Long runs of what the pattern calls blanks (Unicode's White_Space).
_BLANKS = re.compile(r"[\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]{4096,}")


def _cut(text: str, start: int, stop: int, size: int) -> Iterator[str]:
    while stop - start > size:
        place = _SAFE.search(text, start + size - 1, stop)
        if place is None:
            break
        yield text[start : place.end()]
        start = place.end()
    if start < stop:
        yield text[start:stop]


def sections(text: str, size: int = SECTION) -> Iterator[tuple[str, bool]]:
    """``text`` in parts of ``size`` code points or more that end at safe places, but for the last before a long run of blanks; and
    whether a part is one piece of blanks."""
    start = 0
    for run in _BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        yield from ((part, False) for part in _cut(text, start, run.start(), size))
        yield text[run.start() : end], True
        start = end
    yield from ((part, False) for part in _cut(text, start, len(text), size))


class Coder:
    """An encoding of the library, made once a worker, and the decimal names of its ids."""

    _made: dict[tuple[str, str], Coder] = {}

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.names = list(map(str, range(self.library.n_vocab)))

    @classmethod
    def of(cls, ranks: bytes, pattern: str) -> Coder:
        key = (hashlib.sha256(ranks).hexdigest(), pattern)
        if key not in cls._made:
            cls._made[key] = cls(ranks, pattern)
        return cls._made[key]

    def parts(self, text: str, size: int = SECTION) -> Iterator[list[int]]:
        """The ids of each section."""
        for part, blanks in sections(text, size):
            yield self.library._encode_single_piece(part) if blanks else self.library.encode_ordinary(part)

    def digest(self, text: str) -> tuple[int, str, str]:
        """How many ids, the digest of their decimal names, the digest of the decoded bytes; a section is held at a time."""
        count, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.parts(text):
            ids_hash.update((b"," if count else b"") + ",".join(map(self.names.__getitem__, ids)).encode())
            bytes_hash.update(self.library.decode_bytes(ids))
            count += len(ids)
        return count, ids_hash.hexdigest(), bytes_hash.hexdigest()


def _rank_bytes(spark: SparkSession, rank_file: str):
    """The rank file, read on the driver and broadcast; its size is that of a vocabulary, whatever the corpus."""
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encode_batches(shared, pattern: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        coder = Coder.of(shared.value, pattern)
        for whole in batches:
            for batch in slices(whole, ["text"]):
                rows = [np.concatenate([np.zeros(0, np.int32), *(np.array(p, np.int32) for p in coder.parts(t or ""))]) for t in batch.column(1).to_pylist()]
                tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows)))
                yield pa.record_batch([batch.column(0), tokens], names=["id", "tokens"])

    return run


def _decode_batches(shared, pattern: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = Coder.of(shared.value, pattern)
        for batch in batches:
            out = [coder.library.decode_bytes(ids.values.to_pylist()) if ids.is_valid else b"" for ids in batch.column(1)]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], names=["id", "tokens", "decoded"])

    return run


def _digest_batches(shared, pattern: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = Coder.of(shared.value, pattern)
        for whole in batches:
            for batch in slices(whole, ["text"]):
                found = [coder.digest(t.as_py() or "") for t in batch.column(1)]
                n, ids, decoded = zip(*found)
                yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = RANK_FILE, pattern: str = PATTERN) -> DataFrame:
    """``id, tokens array<int>``: one row per input row, without a shuffle.

    Null and empty texts have no tokens. Rows are encoded one by one: null, repeated or clashing ids of any type, repeated
    rows and other columns make no difference. An empty table gives an empty result. Names of special tokens in a text are
    text. A text is read in sections, but its tokens make one row, which Arrow bounds at 2 GB.
    """
    shared = _rank_bytes(docs.sparkSession, rank_file)
    return fresh(docs, id=id_col, text=text_col).mapInArrow(frugal(_encode_batches(shared, pattern)), f"id {_id_type(docs, id_col)}, tokens array<int>")


def decode(encoded: DataFrame, rank_file: str = RANK_FILE, pattern: str = PATTERN) -> DataFrame:
    """Adds ``decoded`` (binary) to ``id, tokens``: the joined bytes of the tokens; of null tokens, none.

    Bytes are not read as text, for a part of a document's tokens may begin or end inside a character.
    """
    shared = _rank_bytes(encoded.sparkSession, rank_file)
    return encoded.select("id", "tokens").mapInArrow(frugal(_decode_batches(shared, pattern)), f"id {_id_type(encoded, 'id')}, tokens array<int>, decoded binary")


def token_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = RANK_FILE, pattern: str = PATTERN) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: each text encoded and decoded in one worker.

    The defined results of ``encode`` hold; a text without tokens has the digests of the empty string.
    """
    shared = _rank_bytes(docs.sparkSession, rank_file)
    schema = f"id {_id_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return fresh(docs, id=id_col, text=text_col).mapInArrow(frugal(_digest_batches(shared, pattern)), schema).withColumnRenamed("id", id_col)
