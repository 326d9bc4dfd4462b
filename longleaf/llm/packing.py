"""Packing by cutting-stock column generation.

Every document is its ids and a final end id.  Its whole multiples of the sequence length are
sequences of their own; what is left, its tail, is shorter than a sequence.  Tails of one length
are interchangeable, so packing them is a cutting-stock problem over a histogram of at most
``size - 1`` lengths:

* a linear program chooses how often to use each pattern (a multiset of lengths that fits);
* knapsack dynamic programming over the program's prices finds the pattern that improves it most;
* the numbers are rounded down, and the program is solved once more for the lengths that are left;
  what that leaves (fewer sequences than there are lengths) gets patterns one by one, each by
  dynamic programming over the lengths still there, as long as they waste ``waste`` ids or fewer;
* the documents of a length, ranked, take its places in order;
* tails beyond the patterns are laid end to end, largest first, and cut where a sequence ends: no
  padding there but in the last sequence.

Only the histogram comes to the driver.  Ranks come from counts by (length, task), never from
sorting the documents of a length in one task, so a length that a third of all documents share
is no hot spot.

Cases: a null text is the empty text (one end id); very long texts give many whole sequences; equal
rows are packed as rows of their own; an empty table gives no pieces; other columns are not read,
whatever their names; a null id stays null in the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longleaf.llm.bpe import text_encoder
from longleaf.llm.common import Tables, binaries, lists, map_arrow, text_blocks, texts, tokenizer_path


def knapsack(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the largest value that fits each capacity, and the last length taken (0: none)."""
    best, took = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    worth = np.zeros(size + 1)
    worth[lengths] = values
    worth = worth[1:]
    for c in range(1, size + 1):
        got = best[c - 1 :: -1] if c == size else best[c - 1 :: -1][:c]
        got = got + worth[:c]
        k = int(got.argmax())
        if got[k] > best[c - 1] + 1e-12:
            best[c], took[c] = got[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, took


def pattern_of(took: np.ndarray, c: int, first: int = 0) -> dict[int, int]:
    """The multiset of lengths behind capacity c, after one of length first."""
    pattern = {first: 1} if first else {}
    c -= first
    while c > 0:
        if n := int(took[c]):
            pattern[n] = pattern.get(n, 0) + 1
            c -= n
        else:
            c -= 1
    return pattern


def cutting_stock(counts: dict[int, int], size: int, rounds: int = 80, gap: float = 1e-3) -> list[tuple[dict[int, int], float]]:
    """Patterns with their (fractional) numbers, by revised simplex with priced columns.

    A round prices by one dynamic program; it gives the best pattern that holds each length, and
    those enter as long as they still improve.  It stops when no pattern improves the program, when
    the program is within gap of the least number of sequences possible, or after so many rounds;
    the numbers are a feasible packing at any time.
    """
    lengths = np.array(sorted(counts))
    if not len(lengths):
        return []
    need = np.array([counts[int(n)] for n in lengths], float)
    row = {int(n): i for i, n in enumerate(lengths)}
    basis: list[dict[int, int]] = []
    for n in lengths.tolist():  # of two lengths that fill a sequence together, the rarer one starts in such pairs
        other = size - n
        paired = other in row and other != n and (counts[n], n) < (counts[other], other)
        basis.append({n: 1, other: 1} if paired else {n: size // n})
    matrix = np.zeros((len(lengths), len(lengths)))
    for i, pattern in enumerate(basis):
        matrix[[row[n] for n in pattern], i] = list(pattern.values())
    inverse = np.linalg.inv(matrix)
    x = np.maximum(inverse @ need, 0)
    least = float(lengths @ need) / size
    y = inverse.sum(axis=0)
    for _ in range(rounds):
        if x.sum() <= least * (1 + gap):
            break
        best, took = knapsack(np.maximum(y, 0), lengths, size)
        if best[size] <= 1 + 1e-7:
            break
        held = np.maximum(y, 0) + best[size - lengths]
        for i in np.argsort(-held, kind="stable")[:64].tolist():
            if held[i] <= 1 + 1e-7:
                break
            pattern = pattern_of(took, size, int(lengths[i]))
            at = np.array([row[n] for n in pattern])
            times = np.array(list(pattern.values()), float)
            if y[at] @ times <= 1 + 1e-7:
                continue
            d = inverse[:, at] @ times
            ratio = np.divide(x, d, out=np.full(len(d), np.inf), where=d > 1e-9)
            out = int(ratio.argmin())
            step = max(0.0, float(ratio[out]))
            x = np.maximum(x - step * d, 0)
            x[out] = step
            pivot = inverse[out] / d[out]
            y = y + (1 - float(y[at] @ times)) * pivot
            moving, across = np.flatnonzero(np.abs(d) > 1e-12), np.flatnonzero(pivot)
            inverse[np.ix_(moving, across)] -= np.outer(d[moving], pivot[across])
            inverse[out] = pivot
            basis[out] = pattern
    return list(zip(basis, x.tolist(), strict=True))


def fullest(left: dict[int, int], size: int) -> dict[int, int]:
    """The fullest pattern with the largest length of left that its numbers allow (bounded knapsack; sums are bits of an integer)."""
    first = max(left)
    room = size - first
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for n in sorted(left, reverse=True):
        count, times = left[n] - (n == first), 1
        while count > 0 and not reach >> room & 1:
            m = min(times, count)
            steps.append((n, m, reach))
            reach |= reach << n * m & mask
            count, times = count - m, 2 * times
    at = reach.bit_length() - 1
    pattern = {first: 1}
    for n, m, before in reversed(steps):
        if not before >> at & 1:
            pattern[n] = pattern.get(n, 0) + m
            at -= n * m
    return pattern


class Places:
    """Where the tail of a given length and rank goes."""

    def __init__(self, counts: dict[int, int], size: int, waste: int, rounds: int = 80):
        self.size = size
        slots: list[tuple[int, int, int, int, int]] = []  # length, first rank, times in the pattern, first sequence, offset
        used = dict.fromkeys(counts, 0)
        sequence = 0

        def take(pattern: dict[int, int], times: int) -> None:
            nonlocal sequence
            offset = 0
            for n, k in sorted(pattern.items(), reverse=True):
                slots.append((n, used[n], k, sequence, offset))
                used[n] += times * k
                offset += n * k
            sequence += times

        for most in (rounds, rounds // 4):
            for pattern, x in cutting_stock({n: k - used[n] for n, k in counts.items() if k > used[n]}, size, most):
                times = min(int(x + 1e-6), *((counts[n] - used[n]) // k for n, k in pattern.items()))
                if times > 0 and size - sum(n * k for n, k in pattern.items()) <= waste:
                    take(pattern, times)
        spare: dict[int, int] = {n: k - used[n] for n, k in counts.items()}
        while any(spare.values()):
            pattern = fullest({n: k for n, k in spare.items() if k}, size)
            if size - sum(n * k for n, k in pattern.items()) <= waste:
                take(pattern, 1)
            else:
                pattern = {max(pattern): spare[max(pattern)]}  # no pattern holds this length
            for n, k in pattern.items():
                spare[n] -= k
        slots.sort()
        self.length, self.first, self.times, self.sequence, self.offset = (np.array([s[i] for s in slots], np.int64) for i in range(5))
        self.used = np.zeros(size + 1, np.int64)
        self.rest_at = np.zeros(size + 1, np.int64)
        self.rest_from, at = sequence, 0
        for n in sorted(counts, reverse=True):
            self.used[n], self.rest_at[n] = used[n], at
            at += n * (counts[n] - used[n])
        self.sequences = sequence + -(-at // size)

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each tail; a tail may run over its sequence's end (then it is cut there)."""
        rest = rank >= self.used[length]
        at = self.rest_at[length] + (rank - self.used[length]) * length
        sequence, offset = self.rest_from + at // self.size, at % self.size
        if len(self.length):
            i = np.maximum(np.searchsorted(self.length << 44 | self.first, length << 44 | rank, side="right") - 1, 0)
            k = rank - self.first[i]
            sequence = np.where(rest, sequence, self.sequence[i] + k // self.times[i])
            offset = np.where(rest, offset, self.offset[i] + k % self.times[i] * length)
        return sequence, offset


def _cut(path: str, size: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches) -> Iterator[dict[str, object]]:
        part = TaskContext.get().partitionId()
        full_before = 0
        ranks = np.zeros(size + 1, np.int64)
        for batch in batches:
            values = texts(batch.column(1))
            for a, b in text_blocks(values):
                ids = [x + end for x in text_encoder(path, False).batch(values[a:b])]
                length = np.array([len(x) // 4 for x in ids], np.int64)
                tail, full = length % size, length // size
                step, k = 4 * size, b - a
                order = np.argsort(tail, kind="stable")
                start = np.searchsorted(tail[order], np.arange(size + 1))
                rank = np.empty(k, np.int64)
                rank[order] = np.arange(k) - start[tail[order]]
                rank += ranks[tail]
                ranks += np.bincount(tail, minlength=size + 1)
                tails = [x[len(x) - 4 * int(t) :] if t else b"" for x, t in zip(ids, tail, strict=True)]
                crcs = [zlib.crc32(x[i : i + step]) for x, f in zip(ids, full.tolist(), strict=True) for i in range(0, f * step, step)]
                before = full_before + np.cumsum(full) - full
                yield {
                    "part": np.full(k, part), "doc_id": batch.column(0)[a:b], "doc_tokens": length, "full_before": before,
                    "full_crcs": lists(np.array(crcs, np.int64), full, pa.int64()), "tail": tail.astype(np.int32), "tail_rank": rank, "tail_crc": [zlib.crc32(x) for x in tails], "tail_ids": binaries(b"".join(tails), 4 * tail),
                }
                full_before += int(full.sum())

    return run


def pack(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 1024, end_id: int = 0, tokenizer: str | None = None, waste: int = 8, rounds: int = 80) -> DataFrame:
    """Pieces of documents in sequences of ``size`` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    rounds bounds the pricing rounds of a program, and so the driver's time; what they leave is cut, not padded.
    """
    spark, path = df.sparkSession, tokenizer or tokenizer_path()
    tables = Tables(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = tables.write(map_arrow(docs, _cut(path, size, end_id), {"part": "long", "doc_id": "long", "doc_tokens": "long", "full_before": "long", "full_crcs": "array<long>", "tail": "int", "tail_rank": "long", "tail_crc": "long", "tail_ids": "binary"}, whole=True), "cut")

    by_task = cut.where("tail > 0").groupBy("tail", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {int(r["tail"]): int(r["n"]) for r in by_task.groupBy("tail").agg(F.sum("n").alias("n")).collect()}  # size - 1 rows at most
    places = Places(counts, size, waste, rounds)
    offsets = by_task.select("tail", "part", (F.sum("n").over(Window.partitionBy("tail").orderBy("part")) - F.col("n")).alias("ranked"))

    def place(batch: pa.RecordBatch) -> dict[str, object]:
        doc, tokens, tail, rank, crc = (batch.column(i) for i in range(5))
        tokens, tail, rank, crc = (np.asarray(x, np.int64) for x in (tokens, tail, rank, crc))
        sequence, offset = places.of(tail, rank)
        over = np.maximum(offset + tail - size, 0)
        twice = np.flatnonzero(over)
        take = np.concatenate([np.arange(len(tail)), twice])
        second = np.arange(len(take)) >= len(tail)
        head = tail - over
        skip, length = np.where(second, head[take], 0), np.where(second, over[take], head[take])
        crcs = crc[take]
        for i in np.flatnonzero(over[take]).tolist():
            crcs[i] = zlib.crc32(batch.column(5)[int(take[i])].as_py()[4 * skip[i] : 4 * (skip[i] + length[i])])
        return {
            "doc_id": doc.take(pa.array(take)), "start": skip + (tokens - tail)[take], "length": length, "ids_crc32": crcs,
            "doc_tokens": tokens[take], "sequence_id": sequence[take] + second, "offset": np.where(second, 0, offset[take]),
        }

    ranked = cut.where("tail > 0").join(offsets, ["tail", "part"]).select("doc_id", "doc_tokens", F.col("tail").cast("long"), (F.col("tail_rank") + F.col("ranked")).alias("rank"), "tail_crc", "tail_ids")
    placed = map_arrow(ranked, place, {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "sequence_id": "long", "offset": "long"})

    by_part = cut.groupBy("part").agg(F.max(F.col("full_before") + F.size("full_crcs")).alias("n"))
    firsts = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") + F.lit(places.sequences)).alias("first"))  # a row for each task
    whole = cut.join(firsts, "part").select("doc_id", "doc_tokens", (F.col("first") + F.col("full_before")).alias("first"), F.posexplode("full_crcs").alias("i", "ids_crc32"))
    whole = whole.select("doc_id", (F.col("i").cast("long") * size).alias("start"), F.lit(size).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(placed)
