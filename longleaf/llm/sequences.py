"""Token-id output: documents packed best-fit-decreasing into matrices of ids.

Documents are encoded and those longer than a row are split without loss.  Pieces go, longest
first, into the open row with the least room that still holds them; a segment tree over the
possible rooms finds that row in logarithmic time.  Each task packs windows of a fixed number of
tokens, so memory is bounded and no row depends on another task; a lost task is packed again alike.

A packed row holds: ids (binary, little-endian, padded), position within the piece for every
id (binary; it starts anew with each piece), cumulative segment lengths, and the document id and
start of each segment.

Cases: a null or empty text has no ids and so no segment and leaves no trace; very long texts fill
many rows; equal rows are packed each on its own; a null document id stays null; an empty table gives no
rows; other columns are not read, whatever their names.  Ids that don't fit the width are an error before
any row is read.  Segments have no end id of their own: cumulative lengths tell them apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longleaf.llm.bpe import text_encoder, vocabulary
from longleaf.llm.common import binaries, lists, map_arrow, text_blocks, texts, tokenizer_path


class Rooms:
    """Open rows by the room they have left: a segment tree over rooms 0..size counts them."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.tree = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.base + room
        while i:
            self.tree[i] += 1
            i >>= 1

    def least(self, need: int) -> int:
        """The smallest room of at least need that some row has, or -1."""
        tree, i = self.tree, self.base + need
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return -1
            i += 1
            while i < self.base:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        return i - self.base

    def take(self, room: int) -> int:
        i = self.base + room
        while i:
            self.tree[i] -= 1
            i >>= 1
        return self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and offset of each piece, and the number of rows."""
    row, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths == size).sum())
    row[order[:full]] = np.arange(full)
    rooms, rows = Rooms(size), full
    for i in order[full:].tolist():
        n = int(lengths[i])
        if (room := rooms.least(n)) < 0:
            row[i], room = rows, size
            rows += 1
        else:
            row[i] = rooms.take(room)
        offset[i] = size - room
        if room > n:
            rooms.add(room - n, int(row[i]))
    return row, offset, rows


def _packed(path: str, size: int, pad_id: int, window: int, wide: bool):
    kind = "<u4" if wide else "<u2"
    width = np.dtype(kind).itemsize

    def matrix(docs: list[int | None], raw: list[bytes], first: int) -> tuple[dict[str, object], int]:
        ids = np.frombuffer(b"".join(raw), "<u4")
        tokens = np.array([len(x) // 4 for x in raw], np.int64)
        pieces = -(-tokens // size)
        doc = np.repeat(np.arange(len(raw)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(tokens[doc] - nth * size, size)
        row, offset, rows = best_fit_decreasing(length, size)
        cells = np.full(rows * size, pad_id, kind)
        places = np.zeros(rows * size, kind)
        source = np.repeat((np.cumsum(tokens) - tokens)[doc] + nth * size, length)
        within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        target = np.repeat(row * size + offset, length) + within
        cells[target] = ids[source + within]
        places[target] = within
        order = np.lexsort((offset, row))
        segments = np.bincount(row, minlength=rows)
        ends = (offset + length)[order]
        cumulative = np.zeros(rows + len(order), np.int64)
        cumulative[np.arange(len(order)) + row[order] + 1] = ends
        return {
            "sequence_id": first + np.arange(rows), "input_ids": binaries(cells, np.full(rows, size * width)), "position_ids": binaries(places, np.full(rows, size * width)), "cu_seqlens": lists(cumulative, segments + 1, pa.int32()),
            "doc_ids": lists(np.zeros(0), segments, pa.int64()) if not rows else pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(segments)]).astype(np.int32)), pa.array([docs[i] for i in doc[order].tolist()], pa.int64())), "starts": lists((nth * size)[order], segments, pa.int64()),
        }, rows

    def run(batches) -> Iterator[dict[str, object]]:
        first = TaskContext.get().partitionId() << 33
        docs: list[int | None] = []
        raw: list[bytes] = []
        held = 0
        for batch in batches:
            values, keys = texts(batch.column(1)), batch.column(0).to_pylist()
            for a, b in text_blocks(values):
                new = text_encoder(path, False).batch(values[a:b])
                docs += keys[a:b]
                raw += new
                held += sum(map(len, new)) // 4
                if held >= window:
                    out, rows = matrix(docs, raw, first)
                    yield out
                    first, docs, raw, held = first + rows, [], [], 0
        if held:
            yield matrix(docs, raw, first)[0]

    return run


def pack_sequences(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 2048, pad_id: int = 0, window: int = 2_000_000, wide: bool = False, tokenizer: str | None = None) -> DataFrame:
    """Packed rows of ``size`` ids; ids and positions are unsigned 16-bit, or 32-bit if wide (ValueError where vocabulary, pad_id or size don't fit)."""
    path = tokenizer or tokenizer_path()
    largest = max(len(vocabulary(path).table()) - 1, pad_id, size - 1)
    if largest >= 1 << (32 if wide else 16):
        raise ValueError(f"ids and positions up to {largest} need wide=True")
    schema = {"sequence_id": "long", "input_ids": "binary", "position_ids": "binary", "cu_seqlens": "array<int>", "doc_ids": "array<long>", "starts": "array<long>"}
    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _packed(path, size, pad_id, window, wide), schema, whole=True)


def matrix_of(rows, size: int = 2048, wide: bool = False) -> np.ndarray:
    """The id matrix of collected rows, one row each."""
    return np.array([np.frombuffer(r["input_ids"], "<u4" if wide else "<u2") for r in rows]).reshape(-1, size)
