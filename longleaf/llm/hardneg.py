"""Hard negatives: rows of another label whose score lies in a window under a positive's, by vantage-point trees.

Scores are inner products, which are no distance.  Each row x gets one more component, the root of M - x·x
with M the largest x·x of the table, and an anchor q gets a zero there; then the squared distance of q
and x is q·q + M - 2 q·x.  The larger the score the nearer the row, and a window of scores is an
annulus around the anchor.

* A tree's node has a vantage point; rows nearer to it than the median go to one child, the others to the other, and the
  node keeps the least and largest distance in each.  By the triangle inequality an anchor's distance to the
  vantage point bounds its distance to all rows of a child, and so their scores.
* A search keeps nodes (by the best score they can hold) and rows (by their score) in one queue and takes the best
  first.  A node that misses the annulus is never entered; rows come out nearest first, ties by id, and the search ends with
  the last row it needs.
* The top of the tree is fitted on a bounded sample and deals all rows to its leaves.  A leaf of many rows (copies of
  one vector cannot be told apart) is split by hash into blocks.  A block is one task's, which builds the rest of the tree
  over its rows and then reads the anchors that come to it: only those whose annulus may meet the block's leaf.
* Positives are searched in the anchor's own block first; the last of them is the floor under which other blocks, and
  nodes in them, are not entered.  Then all windows of an anchor are searched at once, its own block first again: a window that is full there takes
  better rows only from other blocks.

Everything after the sample is exact: scores are sums of integers in double precision, exact below 2^53.

Cases: rows with a null label, a null vector or a null or non-finite component take no part, nor do vectors of
another length than the most frequent one, or of length 0; rows that repeat, with or without their id, are rows of their
own, and only the anchor's own row is no positive of it; a null id is no anchor, loses ties and is given as
null; fewer rows than asked for are all given; a window of a positive with a score under zero is empty; an empty table gives no
rows; other columns are read by the given expressions only, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longleaf.llm.common import Tables, lists, map_arrow

_LAST = (1 << 63) - 1
#: Components of the sample's vectors together, at most (but for its first 1024 rows), in the driver.
SAMPLED = 1 << 22


@dataclass
class Tree:
    """A vantage-point tree over rows that are put in its order, so that a leaf is a slice of them."""

    x: np.ndarray
    most: float  # M
    order: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    vantage: list[np.ndarray] = field(default_factory=list)
    split: list[float] = field(default_factory=list)
    #: By node: its children and the distances (least, largest) of their rows to its vantage point, or the slice of a leaf.
    nodes: list[tuple] = field(default_factory=list)

    def grow(self, leaf: int) -> Tree:
        lift = np.sqrt(np.maximum(self.most - np.einsum("ij,ij->i", self.x, self.x), 0))
        out: list[np.ndarray] = []
        size = 0

        def far(rows: np.ndarray, v: int) -> np.ndarray:
            apart = self.x[rows] - self.x[v]
            return np.sqrt(np.einsum("ij,ij->i", apart, apart) + (lift[rows] - lift[v]) ** 2)

        self.nodes.append(())
        todo = [(0, np.arange(len(self.x)))]
        while todo:
            n, rows = todo.pop()
            v = rows[0]
            d = far(rows, v) if len(rows) > leaf else None
            if d is not None and d.max() > 0:
                v = rows[d.argmax()]
                d = far(rows, v)
                middle = np.partition(d, len(d) // 2)[len(d) // 2]
                near = d < middle if middle > d.min() else d <= middle
                self.nodes[n] = (len(self.vantage), len(self.nodes), len(self.nodes) + 1, (d[near].min(), d[near].max()), (d[~near].min(), d[~near].max()))
                self.vantage.append(v)
                self.split.append(float((d[near].max() + d[~near].min()) / 2))
                todo += [(len(self.nodes), rows[near]), (len(self.nodes) + 1, rows[~near])]
                self.nodes += [(), ()]
            else:
                self.nodes[n] = (size, size + len(rows))
                size += len(rows)
                out.append(rows)
        self.order = np.concatenate(out) if out else np.zeros(0, np.int64)
        self.points, self.lift = (self.x[self.vantage], lift[self.vantage]) if self.vantage else (np.zeros((0, self.x.shape[1])), np.zeros(0))
        self.x = self.x[self.order]
        return self

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Of anchors to all vantage points."""
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + self.most - 2 * (q @ self.points.T), 0))

    def leaves(self) -> list[int]:
        return [n for n, node in enumerate(self.nodes) if len(node) == 2]

    def deal(self, x: np.ndarray) -> np.ndarray:
        """The leaf (by its place among leaves) of other rows, by what stands between a node's children."""
        lift = np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))
        place = {n: k for k, n in enumerate(self.leaves())}
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            n, rows = todo.pop()
            if len(self.nodes[n]) == 2:
                out[rows] = place[n]
            elif len(rows):
                v, near, far, *_ = self.nodes[n]
                d = np.sqrt(((x[rows] - self.points[v]) ** 2).sum(axis=1) + (lift[rows] - self.lift[v]) ** 2)
                todo += [(near, rows[d <= self.split[v]]), (far, rows[d > self.split[v]])]
        return out

    def slack(self, qq: float) -> float:
        """What rounding may add to a bound of a score; scores themselves are whole numbers."""
        return 0.5 + 1e-9 * (self.most + qq)

    def reach(self, d: np.ndarray, qq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score (anchor, leaf) that rows dealt to each leaf can have with anchors, from distances to vantage points."""
        least, most = np.zeros((len(self.nodes), len(d))), np.full((len(self.nodes), len(d)), np.inf)
        for n, node in enumerate(self.nodes):  # parents come before their children
            if len(node) > 2:
                v, near, far, *_ = node
                edge = self.split[v] * (1 + 1e-12)
                least[near], most[near] = np.maximum(least[n], d[:, v] - edge), np.minimum(most[n], d[:, v] + edge)
                least[far], most[far] = np.maximum(least[n], self.split[v] * (1 - 1e-12) - d[:, v]), most[n]
        leaves = self.leaves()
        total = (qq + self.most)[:, None]
        slack = 0.5 + 1e-9 * total
        return (total - most[leaves].T ** 2) / 2 - slack, (total - least[leaves].T ** 2) / 2 + slack

    def nearest(self, q: np.ndarray, qq: float, d: np.ndarray, low: float, high: float, fits: np.ndarray, ids: np.ndarray, most: int) -> Iterator[tuple[float, int]]:
        """(score, row) of rows that fit and score from low to high, best score first, ties by id; most: how many a leaf need give."""
        total, slack = qq + self.most, self.slack(qq)
        queue: list[tuple] = [(-np.inf, 0, 0, 0, None)]
        while queue:
            key, kind, _, n, rest = heapq.heappop(queue)
            if kind:
                yield -key, n
                if (following := next(rest, None)) is not None:
                    heapq.heappush(queue, (*following, rest))
                continue
            node = self.nodes[n]
            if len(node) == 2:
                a, b = node
                scores = self.x[a:b] @ q
                at = np.flatnonzero(fits[a:b] & (scores >= low) & (scores <= high))
                if len(at):
                    if len(at) > 4 * most:  # only the best need an order
                        edge = np.partition(scores[at], len(at) - most)[len(at) - most]
                        at = at[scores[at] >= edge]
                    at = at[np.lexsort((ids[a + at], -scores[at]))]
                    rows = iter(zip((-scores[at]).tolist(), [1] * len(at), ids[a + at].tolist(), (a + at).tolist(), strict=True))
                    heapq.heappush(queue, (*next(rows), rows))
                continue
            v, near, far, *spans = node
            here = d[v]
            for child, (inner, outer) in ((near, spans[0]), (far, spans[1])):
                gap, reach = max(here - outer, inner - here, 0.0), here + outer
                best = (total - gap * gap) / 2 + slack
                if best >= low and (total - reach * reach) / 2 - slack <= high:
                    heapq.heappush(queue, (-best, 0, child, child, None))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(_LAST), np.int64)


def _met(rows: DataFrame, visits: DataFrame, parts: int, dim: int, most: float, leaf: int, search, schema: dict[str, str]) -> DataFrame:
    """search(tree, ids, labels, row numbers, anchors of a batch) for the anchors that visit a block, in the task that holds the block.

    A task gets the rows of a block before its anchors, which pass in batches, so it holds one tree at a time.
    """
    columns = ["block", "visits", "row", "id", "label", "v", "low", "high"]
    none = F.lit(None).cast("array<long>")
    both = rows.select("block", F.lit(False).alias("visits"), "row", "id", "label", "v", none.alias("low"), none.alias("high")).unionByName(visits.withColumn("visits", F.lit(True)).select(columns))

    def run(batches):
        mine, parts_of, tree = None, [], None
        for batch in batches:
            block, asks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = np.flatnonzero(np.diff(block * 2 + asks)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(block)], strict=True):
                part = batch.slice(a, b - a)
                if block[a] != mine:
                    mine, parts_of, tree = block[a], [], None
                if not asks[a]:
                    parts_of.append(part)
                    continue
                if tree is None and parts_of:
                    held = [np.concatenate([f(p) for p in parts_of]) for f in (lambda p: _matrix(p.column(5), dim), lambda p: _numbers(p.column(3)), lambda p: _numbers(p.column(4)), lambda p: _numbers(p.column(2)))]
                    tree = Tree(held[0], most).grow(leaf)
                    ids, labels, numbers = (h[tree.order] for h in held[1:])
                    parts_of = []
                if tree is not None and (out := search(tree, ids, labels, numbers, part)) is not None:
                    yield out

    dealt = both.repartition(parts, "block").sortWithinPartitions("block", "visits")
    return map_arrow(dealt.select(columns), run, schema, whole=True)


def mine(df: DataFrame, is_anchor: Column, label: Column, vector_col: str = "embedding", id_col: str = "vec_id", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block: int = 65_536, leaf: int = 512, sample: int = 16_384) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x).  An anchor's positives are the rows of its label with the best scores; its negatives for a
    positive are the best rows of other labels whose score is low to high hundredths of the positive's.
    block is the number of rows of a task's tree, leaf those of its leaves, sample the rows that the top of the tree is fitted on (fewer where
    vectors are long, see SAMPLED).
    """
    spark = df.sparkSession
    tables = Tables(spark)
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    base = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("v"))
    base = base.where("label is not null and v is not null and size(v) > 0").where(finite).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    base = tables.write(base.withColumn("row", F.monotonically_increasing_id()), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sizes = base.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most")).orderBy(F.desc("n"), "dim").limit(1).collect()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, n, most = sizes[0]["dim"], sizes[0]["n"], float(sizes[0]["most"])
    base = base.where(F.size("v") == dim)
    block = min(block, max(1024, n // 32))  # enough tasks for small tables too

    sample = min(sample, max(1024, SAMPLED // dim))
    share = min(1 << 30, int((1 << 30) * sample / n))
    some = base.where(F.pmod(F.xxhash64("id", "row"), F.lit(1 << 30)) < share).orderBy(F.xxhash64("row")).limit(2 * sample).select("v").toArrow()
    if not some.num_rows:
        some = base.select("v").limit(1).toArrow()
    fitted = _matrix(some["v"].combine_chunks(), dim)
    top = Tree(fitted, most).grow(max(16, -(-len(fitted) * block // n)))

    def deal(batch: pa.RecordBatch) -> dict[str, object]:
        names = ("id", "label", "asks", "v", "row")
        return {**{k: batch.column(i) for i, k in enumerate(names)}, "leaf": top.deal(_matrix(batch.column(3), dim))}

    dealt = tables.write(map_arrow(base.select("id", "label", "asks", "v", "row"), deal, {"id": "long", "label": "long", "asks": "boolean", "v": "array<double>", "row": "long", "leaf": "long"}), "dealt")
    held = {r["leaf"]: r["n"] for r in dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each leaf of the sample's tree
    tasks = [-(-held.get(k, 0) // block) for k in range(len(top.leaves()))]
    starts = np.concatenate([[0], np.cumsum(tasks)])
    blocks = int(starts[-1])
    at = lambda xs: F.get(F.array(*[F.lit(int(x)) for x in xs]), F.col("leaf").cast("int"))
    rows = dealt.withColumn("block", (at(starts[:-1]) + F.pmod(F.xxhash64("row"), at(tasks))).cast("int"))
    anchors = rows.where("asks")

    def visited(batch: pa.RecordBatch, seen) -> dict[str, object] | None:
        """The blocks that each anchor of a batch (row, id, label, v, low, high, block) visits: those of leaves that its scores from low to high may meet."""
        q = _matrix(batch.column(3), dim)
        least, best = top.reach(top.distances(q), (q * q).sum(axis=1))
        wanted = seen(batch)
        meets = (best >= wanted[0][:, None]) & (least <= wanted[1][:, None])
        lists_of = [np.concatenate([np.arange(starts[k], starts[k + 1]) for k in np.flatnonzero(m)] or [np.zeros(0, np.int64)]) for m in meets]
        return {"row": batch.column(0), "id": batch.column(1), "label": batch.column(2), "v": batch.column(3), "low": batch.column(4), "high": batch.column(5), "home": batch.column(6), "blocks": lists(np.concatenate(lists_of), np.array([len(x) for x in lists_of]), pa.int32())}

    carried = {"row": "long", "id": "long", "label": "long", "v": "array<double>", "low": "array<long>", "high": "array<long>", "home": "int", "blocks": "array<int>"}
    found = {"anchor": "long", "anchor_id": "long", "place": "int", "other_id": "long", "score": "long"}
    widest = F.array(F.lit(-_LAST))

    def near(tree: Tree, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray, part: pa.RecordBatch) -> dict[str, object] | None:
        """The best rows of the anchors' labels, from their floors on."""
        q = _matrix(part.column(5), dim)
        d, qq = tree.distances(q), (q * q).sum(axis=1)
        out = []
        for k, (row, own, id_, floor) in enumerate(zip(*(part.column(c).to_pylist() for c in (2, 4, 3, 6)), strict=True)):
            fits = (labels == own) & (numbers != row)
            for count, (score, hit) in enumerate(tree.nearest(q[k], qq[k], d[k], float(floor[0]), np.inf, fits, ids, positives), 1):
                out.append((row, id_, 0, int(ids[hit]), int(score)))
                if count == positives:
                    break
        return dict(zip(found, zip(*out, strict=True), strict=True)) if out else None

    ways = {"parts": max(1, blocks), "dim": dim, "most": most, "leaf": leaf}
    home = anchors.withColumns({"low": widest, "high": widest})
    first = tables.write(_met(rows, home, search=near, schema=found, **ways), "home")
    floors = first.groupBy(F.col("anchor").alias("row")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= positives)
    asked = anchors.join(floors, "row", "left").select("row", "id", "label", "v", F.array(F.coalesce("floor", F.lit(-_LAST))).alias("low"), widest.alias("high"), F.col("block").alias("home"))
    floor_of = lambda b: (np.array([x[0] for x in b.column(4).to_pylist()], np.float64), np.full(b.num_rows, np.inf))
    away = map_arrow(asked, lambda b: visited(b, floor_of), carried).withColumn("block", F.explode("blocks")).where("block <> home")
    more = tables.write(_met(rows, away, search=near, schema=found, **ways), "away")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "other_id")
    likes = tables.write(first.unionByName(more).withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives), "positives")

    def window(tree: Tree, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray, part: pa.RecordBatch) -> dict[str, object] | None:
        """The best rows of other labels in each of an anchor's windows; one search serves all of them."""
        q = _matrix(part.column(5), dim)
        d, qq = tree.distances(q), (q * q).sum(axis=1)
        out = []
        for k, (row, own, id_, lows, highs) in enumerate(zip(*(part.column(c).to_pylist() for c in (2, 4, 3, 6, 7)), strict=True)):
            open_ = {p: [lo, hi, 0] for p, (lo, hi) in enumerate(zip(lows, highs, strict=True), 1) if lo <= hi}
            if not open_:
                continue
            lowest = min(w[0] for w in open_.values())
            for score, hit in tree.nearest(q[k], qq[k], d[k], lowest, max(w[1] for w in open_.values()), labels != own, ids, len(ids)):
                for p, w in list(open_.items()):
                    if score < w[0]:
                        del open_[p]
                    elif score <= w[1]:
                        out.append((row, id_, p, int(ids[hit]), int(score)))
                        w[2] += 1
                        if w[2] == negatives:
                            del open_[p]
                if not open_:
                    break
        return dict(zip(found, zip(*out, strict=True), strict=True)) if out else None

    bounds = likes.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p"))  # positives rows each
    floor = lambda x: f"({x} - pmod({x}, 100L)) div 100"  # noqa: E731  in whole numbers
    least, largest = F.expr(f"transform(p, p -> -({floor(f'(-p.score * {low}L)')}))"), F.expr(f"transform(p, p -> {floor(f'(p.score * {high}L)')})")
    ask = anchors.join(bounds, "row").select("row", "id", "label", "v", least.alias("low"), largest.alias("high"), F.col("block").alias("home"))

    def span(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lows, highs = b.column(4).to_pylist(), b.column(5).to_pylist()
        return np.array([min(x) for x in lows], np.float64), np.array([max(x) for x in highs], np.float64)

    ask = tables.write(ask, "windows")
    inside = tables.write(_met(rows, ask.withColumn("block", F.col("home")), search=window, schema=found, **ways), "inside")
    full = inside.groupBy(F.col("anchor").alias("row"), "place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= negatives)
    raised = full.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("place", "floor"))).alias("floors"))  # positives entries each
    floor_at = lambda x, i: F.greatest(x, F.try_element_at("floors", i + 1))  # noqa: E731  greatest passes over nulls
    around = ask.join(raised, "row", "left").withColumn("low", F.transform("low", floor_at)).drop("floors")
    around = map_arrow(around.select("row", "id", "label", "v", "low", "high", "home"), lambda b: visited(b, span), carried).withColumn("block", F.explode("blocks")).where("block <> home")
    hits = inside.unionByName(tables.write(_met(rows, around, search=window, schema=found, **ways), "outside"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "other_id"))).where(F.col("rank") <= negatives)
    known = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    pairs = likes.select("anchor", "place", known("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(pairs, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", known("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: Brute force in DuckDB.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id AS other, q.label = c.label AS alike, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), p AS (SELECT anchor_id, other, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, p.other AS positive_id, (row_number() OVER (PARTITION BY anchor_id, p.other ORDER BY s.score DESC, s.other))::INT AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3
"""
