"""Token ids of a corpus under a public byte-level BPE vocabulary.

Every distinct piece that the vocabulary's pattern cuts from the texts is encoded once per worker. A segment
tree over the piece's byte positions has at each live part the rank of its pair with the next part, and at
each inner node the least rank below; the root gives the least rank, the way down its leftmost place. A merge
changes three leaves (the part, its right and its left neighbour), so a piece of n bytes takes O(n log n).
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookalike import slices

#: Fixed value: the pattern of byte_bpe_50k and byte_bpe_multi_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 30
#: Distinct pieces a worker keeps; beyond, it starts anew.
CACHE = 1_000_000
#: Pieces longer than this aren't kept.
LONG = 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Where a vocabulary file is: in folder, in $TOKENIZERS_DIR, or in the installed public_tokenizers."""
    folder = folder or os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Rank (which is the id) of each token, from lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: again and again the leftmost of the pairs of least rank is merged."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b

    def put(i: int, rank: int) -> None:
        i += size
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a <= b else b
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1

    while tree[1] < NONE:
        low, i = tree[1], 1
        while i < size:
            i = 2 * i if tree[2 * i] == low else 2 * i + 1
        i -= size
        gone = ahead[i]
        end = ahead[gone]
        ahead[i] = end
        put(gone, NONE)
        if end < n:
            behind[end] = i
            put(i, get(piece[i : ahead[end]], NONE))
        else:
            put(i, NONE)
        if (left := behind[i]) >= 0:
            put(left, get(piece[left:end], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ahead[i]]])
        i = ahead[i]
    return out


class Encoder:
    """Encodes texts, keeping the ids of pieces it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.ranks, self.pieces, self.known = ranks, regex.compile(pattern).findall, {}

    def _new(self, piece: str) -> list[int]:
        ids = encode_piece(piece.encode(), self.ranks)
        if len(piece) <= LONG:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, new, out = self.known.get, self._new, []
        for piece in self.pieces(text):
            ids = known(piece)
            out += new(piece) if ids is None else ids
        return out

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """Lists of int32 ids; a null or empty text has the empty list."""
        rows = [np.array(self.encode(t), np.int32) if t else np.empty(0, np.int32) for t in texts.to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64)))
        values = np.concatenate(rows) if rows else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, pa.int32()))


@functools.cache
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(read_ranks(path), pattern)


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str = PATTERN, out: str = "ids") -> DataFrame:
    """(key, out): for every row of df the ids of its text, a list of int; special tokens neither are added nor
    are their strings treated otherwise than text.

    vocabulary: a path that all executors can read. Null and empty texts have the empty list. Rows stay as they
    are, so a repeated key comes out as often, and a null key too. Texts are taken whole; nothing is shuffled.
    """
    path = vocabulary or vocabulary_path()
    sent = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    schema = T.StructType([sent.schema[key], T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in (x for whole in batches for x in slices(whole, 1)):
            yield pa.RecordBatch.from_arrays([b.column(0), enc.encode_array(b.column(1))], [key, out])

    return sent.mapInArrow(run, schema)
