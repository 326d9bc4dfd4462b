"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

* Texts are grouped by digest first, so thousands of equal copies are one node from then on.
* Signature: each distinct word shingle, with weight 1 + ln(its count), sends the arrivals of a
  Poisson process of that rate; every arrival falls into a random register, which keeps its
  earliest.  A shingle stops as soon as its next arrival is later than all registers hold.  Two
  texts agree in a register with the probability Jaccard of their weighted shingles.
* Banding: nodes that agree in all registers of a band share a bucket.
* Verification: within a bucket every node is compared with a leader, not with every other node.
  A link is a pair whose probability Jaccard, computed exactly from the weighted shingles of whole
  texts, is at least threshold: the measure that the signatures estimate, so banding finds a
  pair of 0.8 with probability 0.9999.  It equals set Jaccard where no shingle repeats.  Leaders
  are the nodes with most company over all bands, so the original of a family comes before its copies.
* Nodes that are in another component than their leader after that are compared with the members of
  their bucket that the triangle inequality of the Jaccard distance to the leader lets be near
  enough.  They meet in blocks of bounded size, and only links leave a block, so a bucket of
  thousands of texts just below the threshold makes no table of pairs.  No bucket, partner or
  candidate is dropped or capped.
* Classes are the connected components of the links.

Cases: null texts and texts without words are classes of their own, whatever else is equal; texts
of fewer than ``width`` words have one shingle of all their words; very long texts are compared whole;
rows repeat in the result as in the input; other columns are not read, whatever their names; a null id stays null and the class id is the smallest id of the class (null if it has
none); an empty table gives no rows.  Words are runs of bytes without ASCII white space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longleaf.llm.common import Tables, batches_of, free_name, lists, map_arrow, met, parted, text_blocks, texts
from longleaf.llm.graph import components
from longleaf.llm.hashing import mix, shingle_sets


#: Nodes, and characters of their texts, that are compared with as many others in one step; blocks of a bucket that one task compares with all of it.
BLOCK, BLOCK_CHARS, TASK_BLOCKS = 256, 2_000_000, 8


def weights(counts: np.ndarray) -> np.ndarray:
    """Weight of a shingle by how often a text has it."""
    return 1.0 + np.log(np.maximum(counts, 1))


def prob_minhash(values: list[str], registers: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature of each text (the shingle that each register keeps) and whether it has any shingle."""
    h, doc, n = shingle_sets(values, width)
    rate = weights(n)
    when = np.full(len(values) * registers, np.inf)
    what = np.zeros(len(values) * registers, np.uint64)
    some = np.zeros(len(values), bool)
    some[doc] = True
    clock, arrival = np.zeros(len(h)), 0
    latest = np.full(len(values), np.inf)
    while len(h):
        draw = mix(h + np.uint64((2 * arrival + 1) * 0xA0761D6478BD642F % (1 << 64)))
        clock = clock - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        alive = clock < latest[doc]
        h, doc, rate, clock = h[alive], doc[alive], rate[alive], clock[alive]
        place = doc * registers + (mix(draw[alive] + np.uint64(0xE7037ED1A0B428DB)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(when, place, clock)
        first = when[place] == clock
        what[place[first]] = h[first]
        latest = when.reshape(-1, registers).max(axis=1)
        arrival += 1
    return what.reshape(-1, registers), some


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of each signature."""
    s = signatures.reshape(len(signatures), -1, rows)
    key = np.broadcast_to(mix(np.arange(s.shape[1], dtype=np.uint64) + np.uint64(77)), s.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, j])
    return key.view(np.int64)


def probability_jaccard(h: np.ndarray, w: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Sum over the shared shingles x of 1 / (sum over all shingles y of max(w(y) / w(x), w2(y) / w2(x)))."""
    _, i, j = np.intersect1d(h, h2, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    a, b = w[i], w2[j]
    alone, alone2 = w.sum() - a.sum(), w2.sum() - b.sum()
    ratio = a / b
    order = np.argsort(ratio, kind="stable")
    at = np.searchsorted(ratio[order], ratio)  # the shared ones from here on have a ratio as large
    above = np.concatenate([[0.0], np.cumsum(a[order][::-1])])[::-1]
    below = np.concatenate([[0.0], np.cumsum(b[order])])
    return float((a / (alone + above[at] + ratio * (alone2 + below[at]))).sum())


def _sets(values: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and weights of all texts, text by text, and where each text's begin and end."""
    h, owner, n = shingle_sets(values, width)
    order = np.argsort(owner, kind="stable")
    size = np.bincount(owner, minlength=len(values))
    return h[order], weights(n[order]), np.cumsum(size) - size, np.cumsum(size)


def jaccard(left: list[str], right: list[str], width: int) -> np.ndarray:
    """Probability Jaccard of the weighted shingles of each pair of texts."""
    names: dict[str, int] = {}
    a = [names.setdefault(t, len(names)) for t in left]
    b = [names.setdefault(t, len(names)) for t in right]
    h, w, first, last = _sets(list(names), width)
    return np.array([probability_jaccard(h[first[x] : last[x]], w[first[x] : last[x]], h[first[y] : last[y]], w[first[y] : last[y]]) for x, y in zip(a, b, strict=True)])


def due(x: list[dict], y: list[dict], key: int) -> np.ndarray:
    """Which pairs of two blocks are to be compared in the bucket of that key: of different components, one open, and no earlier band shared."""
    a, b = (np.array([m["keys"] for m in z], np.int64).reshape(len(z), -1) for z in (x, y))
    first = np.zeros((len(x), len(y)), bool)
    shared = np.zeros((len(x), len(y)), bool)
    for band in range(a.shape[1]):
        same = a[:, band, None] == b[None, :, band]
        first |= same & ~shared & (a[:, band, None] == key)
        shared |= same
    comp = {c: k for k, c in enumerate({m["comp"] for z in (x, y) for m in z})}
    p, q = (np.array([comp[m["comp"]] for m in z]) for z in (x, y))
    some = np.array([m["open"] for m in x], bool)[:, None] | np.array([m["open"] for m in y], bool)[None, :]
    return first & some & (p[:, None] != q[None, :])


def linked(x: list[dict], y: list[dict], key: int, threshold: float, width: int) -> list[tuple[bytes, bytes]]:
    """Links between two blocks of a bucket, of nodes in different components of which one is open.

    Nodes that share several buckets are compared in the first one.  Matrix products give the
    weight that each node shares with each other one, relative to its own; no probability Jaccard
    is larger than the lesser of both, and those that can reach the threshold are computed
    exactly, until a link has joined both components.
    """
    wanted = due(x, y, key)
    if not wanted.any():
        return []
    h, w, start, stop = _sets([m["text"] for m in [*x, *y]], width)
    names, column = np.unique(h, return_inverse=True)
    size = stop - start
    owner = np.repeat(np.arange(len(size)), size)
    weight = np.add.reduceat(w, start)  # of each text; texts in buckets have shingles
    both = np.zeros((len(x), len(y)), np.float32)
    order = np.argsort(column, kind="stable")
    for first in range(0, len(names), 8192):
        at = order[np.searchsorted(column[order], first) : np.searchsorted(column[order], first + 8192)]
        has = np.zeros((len(size), min(8192, len(names) - first)), np.float32)
        has[owner[at], column[at] - first] = 1
        both += has[: len(x)] @ has[len(x) :].T
    mine, its = both.copy(), both
    heavy = np.unique(column[w > 1])  # shingles that repeat in some text count for more than one
    if len(heavy):
        at = np.flatnonzero(np.isin(column, heavy))
        has, more = np.zeros((2, len(size), len(heavy)), np.float32)
        place = np.searchsorted(heavy, column[at])
        has[owner[at], place], more[owner[at], place] = 1, w[at] - 1
        mine = mine + more[: len(x)] @ has[len(x) :].T
        its = its + has[: len(x)] @ more[len(x) :].T
    bound = np.minimum(mine / weight[: len(x), None], its / weight[None, len(x) :])
    out: list[tuple[bytes, bytes]] = []
    above: dict[bytes, bytes] = {}

    def top(c: bytes) -> bytes:
        while c in above:
            c = above[c]
        return c

    could = np.argwhere(wanted & (bound >= threshold - 1e-4))
    for i, k in could[np.argsort(-bound[could[:, 0], could[:, 1]], kind="stable")].tolist():
        p, q = top(x[i]["comp"]), top(y[k]["comp"])
        if p != q:
            a, b = slice(start[i], stop[i]), slice(start[len(x) + k], stop[len(x) + k])
            if probability_jaccard(h[a], w[a], h[b], w[b]) >= threshold - 1e-12:
                out.append((x[i]["node"], y[k]["node"]))
                above[p] = q
    return out


def near_enough(threshold: float) -> Column:
    """Whether a member of a bucket (open, its Jaccard j to the leader, the largest j of the open ones as reach) can link to an open one."""
    return F.col("open") | (F.col("j") <= F.col("reach") + (1 - threshold) + 1e-9)


def classified(df: DataFrame, text_col: str, id_col: str, threshold: float, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, worded, comp) for every row: digest of its text, whether it has words, and its class."""
    tables = Tables(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("node", F.unhex(F.md5("text")))

    def sign(batch: pa.RecordBatch) -> dict[str, object]:
        values, keys, some = texts(batch.column(2)), [], []
        for a, b in text_blocks(values):
            s, has = prob_minhash(values[a:b], bands * rows, width)
            keys.append(band_keys(s, rows))
            some.append(has)
        has = np.concatenate(some)
        return {"doc_id": batch.column(0), "node": batch.column(1), "keys": lists(np.concatenate(keys)[has].reshape(-1), has * bands, pa.int64())}

    signed = tables.write(map_arrow(docs.select("doc_id", "node", "text"), sign, {"doc_id": "long", "node": "binary", "keys": "array<long>"}), "signed")
    nodes = signed.where("size(keys) > 0").select("node", F.explode("keys").alias("key")).distinct()
    crowd = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = tables.write(met(nodes, crowd, "key", tables, "crowd"), "shared")
    standing = shared.groupBy("node").agg(F.sum("n").alias("standing"))
    standing = tables.write(standing, "standing")
    kept = parted(docs.select("node", "text"), standing, ["node"])[1].join(standing.select("node"), "node", "left_semi").dropDuplicates(["node"])
    kept = tables.write(kept, "texts")

    def verify(batch: pa.RecordBatch) -> dict[str, object]:
        return {"a": batch.column(0), "b": batch.column(1), "j": jaccard(texts(batch.column(2)), texts(batch.column(3)), width)}

    comps = None
    if not shared.isEmpty():
        hubs = shared.join(standing, "node").groupBy("key").agg(F.max(F.struct("standing", "node")).alias("best")).select("key", F.col("best.node").alias("hub"))
        active = tables.write(met(shared.select("key", "node"), hubs, "key", tables, "hubs"), "active")
        pairs = active.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        text_of = lambda n, t: kept.select(F.col("node").alias(n), F.col("text").alias(t))
        found = tables.write(map_arrow(pairs.join(text_of("a", "t"), "a").join(text_of("b", "u"), "b").select("a", "b", "t", "u"), verify, {"a": "binary", "b": "binary", "j": "double"}), "pairs")
        links = found.where(F.col("j") >= threshold - 1e-12).select("a", "b")
        comps = components(links, tables)

        j = found.select(F.col("a").alias("node"), F.col("b").alias("hub"), "j").union(found.select("b", "a", "j"))
        its = comps.select(F.col("node").alias("hub"), F.col("comp").alias("its_comp"))
        state = active.join(j, ["node", "hub"], "left").join(comps, "node", "left").join(its, "hub", "left")
        apart = (F.col("node") != F.col("hub")) & ~F.coalesce(F.col("comp") == F.col("its_comp"), F.lit(False))
        state = tables.write(state.select("key", "node", "comp", F.coalesce("j", F.lit(1.0)).alias("j"), apart.alias("open")), "state")
        reach = state.where("open").groupBy("key").agg(F.max("j").alias("reach"))
        left = tables.write(state.join(reach, "key").where(near_enough(threshold)).join(kept, "node").select("key", "node", "comp", "open", "text"), "left")
        keys_of = signed.join(left.select("node").distinct(), "node", "left_semi").select("node", "keys").dropDuplicates(["node"])
        size = left.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.length("text")) / BLOCK_CHARS)).cast("long").alias("parts")).where("parts > 0")
        member = F.struct("node", F.coalesce("comp", "node").alias("comp"), "open", "keys", "text")
        blocks = left.join(size, "key").join(keys_of, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).groupBy("key", "part").agg(F.collect_list(member).alias("members"), F.max("open").alias("some"))
        blocks = tables.write(blocks, "blocks")
        tasks = size.select("key", F.ceil(F.col("parts") / TASK_BLOCKS).cast("long").alias("tasks"))  # a bucket of many blocks is no task's alone
        dealt = blocks.join(tasks, "key")
        mine = dealt.withColumn("task", F.pmod("part", "tasks"))
        other = dealt.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), F.col("part").alias("part2"), F.col("members").alias("others"), F.col("some").alias("some2"))
        meet = mine.join(other, ["key", "task"]).where("part <= part2 and (some or some2)").select("key", "members", "others")

        def compare(batch: pa.RecordBatch) -> dict[str, object] | None:
            out = [p for key, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in linked(x, y, key, threshold, width)]
            return {"a": [a for a, _ in out], "b": [b for _, b in out]} if out else None

        with batches_of(df.sparkSession, 16):  # a row is a pair of blocks
            more = tables.write(map_arrow(meet, compare, {"a": "binary", "b": "binary"}), "more")
        comps = components(links.union(more), tables)

    rows_of = signed.select("doc_id", "node", (F.size("keys") > 0).alias("worded"))
    if comps is not None:
        rows_of = rows_of.join(comps, "node", "left")
    else:
        rows_of = rows_of.withColumn("comp", F.lit(None).cast("binary"))
    return rows_of.withColumn("comp", F.coalesce("comp", "node"))


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.8, width: int = 5, bands: int = 24, rows: int = 5) -> DataFrame:
    """Every row's id with class_id (the smallest id of its class) and class_size (rows in it)."""
    every = classified(df, text_col, id_col, threshold, width, bands, rows)
    worded = every.where("worded")
    classes = worded.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    alone = every.where("not worded").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return met(worded, classes, "comp", Tables(df.sparkSession), "classes").select("doc_id", "class_id", "class_size").unionByName(alone)


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.8, width: int = 5, bands: int = 24, rows: int = 5) -> DataFrame:
    """df without all but one document of each class: the one of the smallest id (nulls last) stays.

    Rows equal in id and text are one document, of which one row stays.
    """
    every = classified(df, text_col, id_col, threshold, width, bands, rows).where("worded")
    every = Tables(df.sparkSession).write(every.groupBy("comp", "node", F.col("doc_id").isNull().alias("null_id"), F.coalesce("doc_id", F.lit(0)).alias("id")).agg(F.count(F.lit(1)).alias("n")), "documents")
    stays = every.groupBy("comp").agg(F.min(F.struct("null_id", "id", "node")).alias("best"))
    judged = every.join(stays, "comp").withColumn("stays", F.struct("null_id", "id", "node") == F.col("best"))
    node, null_id, id_ = (free_name(df, c) for c in ("_node", "_null_id", "_id"))
    drop = judged.where("not stays or n > 1").select(F.col("node").alias(node), F.col("null_id").alias(null_id), F.col("id").alias(id_), "stays")
    drop = Tables(df.sparkSession).write(drop, "drop")
    keys = [node, null_id, id_]
    keyed = df.withColumns({node: F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))), null_id: F.col(id_col).isNull(), id_: F.coalesce(F.col(id_col).cast("long"), F.lit(0))})
    whole, rest = parted(keyed, drop, keys)  # what goes grows with the corpus, so the rest takes one plan at every size
    repeated = rest.join(drop.where("stays").drop("stays"), keys, "left_semi").dropDuplicates(keys)
    return whole.unionByName(rest.join(drop.drop("stays").hint("merge"), keys, "left_anti")).unionByName(repeated).select(df.columns)
