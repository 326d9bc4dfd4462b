"""Byte-pair encoding by ranks, with a segment tree over the bytes of a piece, and decoding.

A piece (one match of the split pattern) that is a token is that token.  Any other piece starts as its
bytes.  Leaf i of a segment tree holds the rank of the pair that starts at byte i, and every inner node
the smaller of its two children, rank before place, so the root names the leftmost pair of the least
rank.  A merge takes that pair: the token at i grows, the next live one goes, and three leaves change
(the pair that is now at i, the one that went, and the one before i), each with the nodes above it.
A piece of n bytes takes n log n steps, however it is made up.

Short pieces are merged many at a time: trees of one size lie side by side in an array, one column
for a piece, and each round merges one pair of every piece that still has one.  Long pieces have a tree of
their own.  Pieces and space-separated chunks are cached per Python worker, in tables of a fixed size.

Cases: a null text is the empty text and has no ids; texts are encoded whole, whatever their length;
no string is a special token; repeated rows and ids are rows of their own and a null id stays null; an
empty table gives no rows; an output column that df already has is replaced, and the query reads no
column but the id and the text.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longleaf.llm.bpe import LONG, PATTERN, PIECES, Generations, TextEncoder, decode_bytes
from longleaf.llm.common import map_arrow, texts, tokenizer_path
from longleaf.session import ship

RANKS = "byte_bpe_50k.tiktoken"
#: Leaves of the largest tree that is kept beside others, and columns of an array of trees.
SIDE, COLUMNS = 64, 1 << 14
_NONE = (1 << 31) - 1


class Ranks:
    """Tokens by rank of a file of the tiktoken library, and the rank of every pair of them that is a token."""

    special: dict[str, int] = {}
    special_split = None

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.table = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.table[rank] = token
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.wide = len(self.table)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.wide + right] = rank
        #: Rank of a pair, by the number of its left token times the vocabulary's size and its right one.
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where a pair is no token."""
        keys = left * self.wide + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], _NONE)


def merge_long(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one piece, by a tree of its own."""
    n, pairs, wide = len(piece), ranks.pairs, ranks.wide
    size = 1 << max(0, n - 1).bit_length()
    token = ranks.single[np.frombuffer(piece, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    never = _NONE * size
    tree = [never] * (2 * size)
    for i in range(n - 1):
        if (r := pairs.get(token[i] * wide + token[i + 1])) is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            if a > b:
                a = b
            if tree[k] == a:
                return  # nothing above changes either
            tree[k] = a

    while (least := tree[1]) < never:
        token_here, i = divmod(least, size)
        j = after[i]
        k = after[j]
        token[i], after[i] = token_here, k
        put(j, never)
        if k < n:
            before[k] = i
            r = pairs.get(token_here * wide + token[k])
            put(i, never if r is None else r * size + i)
        else:
            put(i, never)
        if (h := before[i]) >= 0:
            r = pairs.get(token[h] * wide + token_here)
            put(h, never if r is None else r * size + h)
    out, i = [], 0
    while i < n:
        out.append(token[i])
        i = after[i]
    return out


def merge_side(pieces: list[bytes], size: int, ranks: Ranks) -> list[bytes]:
    """Ids (little-endian, unsigned, 32 bits) of pieces of at most size bytes, by trees of that many leaves that lie side by side."""
    m = len(pieces)
    shift = size.bit_length() - 1
    lengths = np.fromiter(map(len, pieces), np.int64, m)
    held = np.arange(size)[:, None] < lengths
    raw = np.zeros((m, size), np.uint8)
    raw[held.T] = np.frombuffer(b"".join(pieces), np.uint8)
    # row size of token and before takes what is written past a piece's end
    token = np.zeros((size + 1, m), np.int64)
    token[:size] = ranks.single[raw.T]
    after = np.minimum(np.arange(1, size + 1)[:, None], lengths)
    after[after == lengths] = size
    before = np.repeat(np.arange(-1, size)[:, None], m, axis=1)
    tree = np.full((2 * size, m), _NONE << shift, np.int64)
    pair = held[1:]
    first = np.full((size - 1, m), _NONE, np.int64)
    first[pair] = ranks.joined(token[: size - 1][pair], token[1:size][pair])
    tree[size : 2 * size - 1] = first << shift | np.arange(size - 1)[:, None]
    tree[size : 2 * size - 1][first == _NONE] = _NONE << shift
    for k in range(size - 1, 0, -1):
        np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])
    flat, tokens, afters, befores = tree.reshape(-1), token.reshape(-1), after.reshape(-1), before.reshape(-1)
    live = np.flatnonzero(flat[m : 2 * m] < _NONE << shift)
    while len(live):
        least = flat[m + live]
        new, i = least >> shift, least & size - 1
        j = afters[i * m + live]
        k = np.where(j < size, afters[np.minimum(j, size - 1) * m + live], size)
        h = befores[i * m + live]
        tokens[i * m + live] = new
        afters[i * m + live] = k
        befores[k * m + live] = i
        right, left = np.full(len(live), _NONE), np.full(len(live), _NONE)
        some = np.flatnonzero(k < size)
        right[some] = ranks.joined(new[some], tokens[k[some] * m + live[some]])
        some = np.flatnonzero(h >= 0)
        left[some] = ranks.joined(tokens[h[some] * m + live[some]], new[some])
        h = np.maximum(h, 0)
        left = np.where(befores[i * m + live] >= 0, left << shift | h, flat[(size + h) * m + live])  # without one before it, leaf 0 is i's own and set below
        right = right << shift | i
        columns = np.concatenate([live, live, live])
        node = size + np.concatenate([h, j, i])
        flat[node * m + columns] = np.concatenate([left, np.full(len(live), _NONE << shift), right])
        while node[0] > 1:
            node >>= 1
            low = 2 * node * m + columns
            flat[node * m + columns] = np.minimum(flat[low], flat[low + m])
        live = live[flat[m + live] < _NONE << shift]
    alive = np.zeros((size, m), bool)
    at = np.zeros(m, np.int64)
    column = np.arange(m)
    while len(column):
        alive[at, column] = True
        at = after[at, column]
        column, at = column[at < size], at[at < size]
    counts = alive.sum(axis=0)
    ids = token[:size].T[alive.T].astype("<u4").tobytes()
    ends = np.cumsum(counts * 4).tolist()
    return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class TreeEncoder:
    """Ids of pieces and of chunks made of them."""

    def __init__(self, ranks: Ranks):
        import regex

        self.r = ranks
        self.find = regex.compile(PATTERN).findall
        self.pieces = Generations(self._alone, PIECES)

    def _alone(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.r.ranks.get(raw)
        return array("I", [whole] if whole is not None else merge_long(raw, self.r)).tobytes()

    def known(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct pieces, those that are new by trees of equal size side by side."""
        out: dict[str, bytes] = {}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in set(pieces):
            ids = self.pieces.get(p) or self.pieces.old.get(p)
            if ids is None:
                raw = p.encode()
                if (whole := self.r.ranks.get(raw)) is None and len(raw) <= SIDE:
                    by_size.setdefault(1 << (len(raw) - 1).bit_length(), []).append((p, raw))
                    continue
                ids = array("I", [whole]).tobytes() if whole is not None else self.pieces[p]
            out[p] = ids
        for size, mine in by_size.items():
            for a in range(0, len(mine), COLUMNS):
                part = mine[a : a + COLUMNS]
                for (p, _), ids in zip(part, merge_side([raw for _, raw in part], size, self.r), strict=True):
                    out[p] = ids
                    if len(p) <= LONG:
                        self.pieces.put(p, ids)
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit numbers."""
        found = self.find(chunk)
        if len(found) < 64:
            return b"".join(map(self.pieces.__getitem__, found))
        return b"".join(map(self.known(found).__getitem__, found))

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The same for many chunks that follow a space and hold no white space."""
        found = self.find(" " + " ".join(chunks))
        ids = self.known(found)
        out: list[list[bytes]] = []
        for p in found:
            if p[0] == " ":
                out.append([])
            out[-1].append(ids[p])
        return list(map(b"".join, out))


@lru_cache(maxsize=4)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(maxsize=4)
def encoder_of(path: str) -> TextEncoder:
    """One encoder per Python worker; its caches live as long as the worker."""
    r = ranks_of(path)
    return TextEncoder(r, TreeEncoder(r))


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """df with out_col: the text's ids as binary, little-endian unsigned 32-bit."""
    ship(df.sparkSession)
    path = ranks or tokenizer_path(RANKS)

    @F.arrow_udf("binary")
    def ids(column: pa.Array) -> pa.Array:
        return pa.array(encoder_of(path).batch(texts(column)), pa.binary())

    return df.withColumn(out_col, ids(F.col(text_col)))


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", ranks: str | None = None) -> DataFrame:
    """df with out_col: the bytes of binary ids (which need not be UTF-8); null ids give none."""
    ship(df.sparkSession)
    path = ranks or tokenizer_path(RANKS)

    @F.arrow_udf("binary")
    def raw(column: pa.Array) -> pa.Array:
        table = ranks_of(path).table
        return pa.array([decode_bytes(np.frombuffer(b or b"", "<u4"), table) for b in column.to_pylist()], pa.binary())

    return df.withColumn(out_col, raw(F.col(ids_col)))


def round_trip(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", ranks: str | None = None) -> DataFrame:
    """doc_id, number of ids, digest of the ids and digest of the bytes decoded from them, in one pass without a shuffle."""
    path = ranks or tokenizer_path(RANKS)

    def digest(batch: pa.RecordBatch) -> dict[str, object]:
        table = ranks_of(path).table
        encoded = encoder_of(path).batch(texts(batch.column(1)))
        decoded = (decode_bytes(np.frombuffer(raw, "<u4"), table) for raw in encoded)
        return {"doc_id": batch.column(0), "n_tokens": [len(raw) // 4 for raw in encoded], "ids_sha256": [hashlib.sha256(raw).hexdigest() for raw in encoded], "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in decoded]}

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), digest, {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})
