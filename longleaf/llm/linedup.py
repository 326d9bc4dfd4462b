"""Line deduplication by pairwise alignment.

* Lines (without surrounding white space) that aren't blank are hashed; so are windows, the shortest
  runs of such lines that reach ``min_words``.  The document of the smallest id that has a window
  owns it, and every later document that has it is linked to the owner.  Any block that may be
  deleted is made of windows, so all of it is found with their owners.  Windows stand for the rare
  lines of the method: a single line, however rare, would lead a document only to the line's first
  owner, who need not have the rest of the passage.  A window that many documents share costs a
  link for each of them, not one for each two, and none is too common to be followed.
* Linked documents are aligned by patience diff: lines that occur once in both are anchors, the
  longest increasing run of anchors is kept and the gaps between them are aligned alike.  What
  stays unaligned is aligned again; a passage that no alignment shows, as its place is crossed by
  a chain of short lines, is found by its windows.  So every block of both documents is found, in
  whatever order.
* Aligned common blocks of at least ``min_words`` words are deleted from the later document.  The
  first document with a line always keeps it.

So a line goes exactly if it lies in a run of lines, of ``min_words`` words or more, that an earlier
document has as well; blank lines count for nothing in such runs, and those inside a deleted block go.

Cases: a null text stays null; a null id counts as later than all others; rows equal in id and text
are one document and get the same result; rows of equal id and different text have an order of
their own (by digest); an output column that df already has is replaced, other names may clash; very
long texts are aligned whole; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longleaf.llm.common import Tables, free_name, lists, map_arrow, met, parted, texts

_LAST = (1 << 63) - 1


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, given by rising first places, whose second places rise too (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
        back.append(at[pile - 1] if pile else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal lines of a and b, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        once: dict[int, int] = {}
        for k in range(i, i_end):
            once[a[k]] = -1 if a[k] in once else k
        there: dict[int, int] = {}
        for k in range(j, j_end):
            there[b[k]] = -1 if b[k] in there else k
        anchors = _increasing([(p, q) for h, p in once.items() if p >= 0 and (q := there.get(h, -1)) >= 0])
        if anchors:
            for (p, q), (p_end, q_end) in zip(anchors, [*anchors[1:], (i_end, j_end)], strict=True):
                out.append((p, q))
                todo.append((p + 1, p_end, q + 1, q_end))
            todo.append((i, anchors[0][0], j, anchors[0][1]))
        else:  # only lines that repeat: each takes its next occurrence
            places: dict[int, list[int]] = {}
            for k in range(j, j_end):
                places.setdefault(b[k], []).append(k)
            last = j - 1
            for k in range(i, i_end):
                if (p := places.get(a[k])) and (n := bisect_right(p, last)) < len(p):
                    last = p[n]
                    out.append((k, last))
    return sorted(out)


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(start, stop) of the shortest runs of lines from and to each line that reach min_words.

    Every line of a longer run lies in one of the windows inside that run.
    """
    total = [0, *accumulate(words)]
    out = set()
    for k, n in enumerate(words):
        if n:
            if (stop := bisect_left(total, total[k] + min_words)) < len(total):
                out.add((k, stop))
            if total[k + 1] >= min_words:
                out.add((bisect_right(total, total[k + 1] - min_words) - 1, k + 1))
    return sorted(out)


def _moved(a: list[int], words: list[int], b: list[int], min_words: int, gone: set[int]) -> set[int]:
    """Lines of a in windows that b has too, beyond those in gone."""
    todo = [(i, i_end) for i, i_end in windows(words, min_words) if not gone.issuperset(range(i, i_end))]
    if not todo:
        return set()
    known = dict(zip(a, words, strict=True))
    mine, its = (np.array(x, np.int64).tobytes() for x in (a, b))
    there = {its[8 * j : 8 * j_end] for j, j_end in windows([known.get(h, min_words) for h in b], min_words)}  # a line that a hasn't ends a window
    return {k for i, i_end in todo if mine[8 * i : 8 * i_end] in there for k in range(i, i_end)}


def common_blocks(a: list[int], words: list[int], b: list[int], min_words: int) -> list[int]:
    """Lines of a in blocks, of min_words words or more, that b has too."""
    gone: list[int] = []
    left = list(range(len(a)))
    while left:
        aligned = patience([a[i] for i in left], b)
        block: list[int] = []
        found: list[int] = []

        def close(block: list[int] = block, found: list[int] = found) -> None:
            if sum(words[i] for i in block) >= min_words:
                found += block
            block.clear()

        before = (-2, -2)
        for k, j in aligned:
            i = left[k]
            if (i, j) != (before[0] + 1, before[1] + 1):
                close()
            block.append(i)
            before = (i, j)
        close()
        if not found:
            break
        gone += found
        taken = set(found)
        left = [i for i in left if i not in taken]
    return sorted({*gone} | _moved(a, words, b, min_words, {*gone}))


def whole(gone: list[int], places: list[int]) -> list[int]:
    """Places in the text of the lines in gone (places among those that aren't blank) and of the blank ones between them."""
    out: list[int] = []
    for before, i in zip([-2, *gone], gone, strict=False):
        out += range(places[before] + 1, places[i] + 1) if before == i - 1 else [places[i]]
    return out


def repeated_lines(df: DataFrame, text_col: str, id_col: str, min_words: int) -> DataFrame:
    """(id, digest, lines): the places (from 0) of the lines to delete, for documents that have any."""
    tables = Tables(df.sparkSession)
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))

    def cut(batch: pa.RecordBatch) -> dict[str, object]:
        hashes, words, places, keys, n_lines, n_keys = [], [], [], [], [], []
        for t in texts(batch.column(2)):
            said = [(i, x, n) for i, x in enumerate(map(str.strip, t.split("\n"))) if (n := len(x.split()))]
            h = [xxhash.xxh64_intdigest(x) - (1 << 63) for _, x, _ in said]
            flat = np.array(h, np.int64).tobytes()
            own = {xxhash.xxh64_intdigest(flat[8 * i : 8 * i_end]) - (1 << 63) for i, i_end in windows([n for _, _, n in said], min_words)}
            hashes += h
            places += [i for i, _, _ in said]
            words += [n for _, _, n in said]
            keys += own
            n_lines.append(len(h))
            n_keys.append(len(own))
        n = np.array(n_lines)
        return {"id": batch.column(0), "digest": batch.column(1), "lines": lists(np.array(hashes, np.int64), n, pa.int64()), "words": lists(np.array(words, np.int32), n, pa.int32()), "places": lists(np.array(places, np.int32), n, pa.int32()), "keys": lists(np.array(keys, np.int64), np.array(n_keys), pa.int64())}

    lined = tables.write(map_arrow(docs, cut, {"id": "long", "digest": "long", "lines": "array<long>", "words": "array<int>", "places": "array<int>", "keys": "array<long>"}), "lined")
    has = lined.select("id", "digest", F.explode("keys").alias("key"))
    owners = has.groupBy("key").agg(F.min(F.struct("id", "digest")).alias("own"), F.max(F.struct("id", "digest")).alias("last")).where("own <> last").select("key", F.col("own.id").alias("own_id"), F.col("own.digest").alias("own_digest"))
    linked = met(has, owners, "key", tables, "owners").where("id <> own_id or digest <> own_digest").select("id", "digest", "own_id", "own_digest").distinct()
    once = lined.dropDuplicates(["id", "digest"])
    sides = linked.join(once.select(F.col("id").alias("own_id"), F.col("digest").alias("own_digest"), F.col("lines").alias("own_lines")), ["own_id", "own_digest"]).join(once.select("id", "digest", "lines", "words", "places"), ["id", "digest"])

    def align(batch: pa.RecordBatch) -> dict[str, object] | None:
        rows = []
        for i in range(batch.num_rows):
            a, w, b, at = (batch.column(k)[i].as_py() for k in (2, 3, 4, 5))
            if gone := common_blocks(a, w, b, min_words):
                rows.append((i, whole(gone, at)))
        if not rows:
            return None
        at = pa.array([i for i, _ in rows])
        return {"id": batch.column(0).take(at), "digest": batch.column(1).take(at), "gone": [g for _, g in rows]}

    blocks = map_arrow(sides.select("id", "digest", "lines", "words", "own_lines", "places"), align, {"id": "long", "digest": "long", "gone": "array<int>"})
    return tables.write(blocks.groupBy("id", "digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")), "gone")


def drop_repeated_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = 40, removed_col: str = "removed_lines") -> DataFrame:
    """df with its text without the repeated blocks, and removed_col, the places (from 0) of the lines that were deleted."""
    gone = repeated_lines(df, text_col, id_col, min_words)
    i, d = (free_name(df, n) for n in ("_line_id", "_line_digest"))
    keyed = df.drop(removed_col).withColumns({i: F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), d: F.xxhash64(text_col)})
    marks = gone.select(F.col("id").alias(i), F.col("digest").alias(d), F.col("gone").alias(removed_col))
    whole, rest = parted(keyed, marks, [i, d])  # what is marked grows with the corpus, so the rest takes one plan at every size
    both = whole.withColumn(removed_col, F.lit(None).cast("array<int>")).unionByName(rest.join(marks.hint("merge"), [i, d], "left"))
    pieces = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(pieces, lambda _, k: ~F.array_contains(F.col(removed_col), k)), "\n")
    out = both.withColumn(text_col, F.when(F.col(removed_col).isNull(), F.col(text_col)).otherwise(left)).withColumn(removed_col, F.coalesce(removed_col, F.array().cast("array<int>")))
    return out.select(*[c for c in df.columns if c.lower() != removed_col.lower()], removed_col)
