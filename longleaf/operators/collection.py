"""A collection of chunks with a dense and a sparse vector each, as tables.

A collection starts as one table that is searched exactly.  ``create_index`` deals its rows to inverted lists by their dense vectors (see
``ivf``) and keeps the places of their sparse vectors as postings sorted by place.  Each index is a
version in a folder of its own, complete when its centres are written, so a stopped build leaves the version
before it in use.  Rows inserted later go to the lists of the version in use.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from longleaf.operators import dense, ivf
from longleaf.session import delete, is_complete, ship

SCHEMA = "id string, text string, dense array<float>, sparse map<int,float>"
#: Parts of the postings of sparse vectors, each of a range of places.
RANGES = 32
#: Hits that are sent to the texts at most; scores that a task holds at once, and entries of rows that meet all queries at once.
SENT, CELLS, STEP = 500_000, 1_000_000, 1024


@dataclass
class Collection:
    spark: SparkSession
    path: str

    def create(self, drop: bool = True) -> Collection:
        """An empty collection; without drop one that is there stays as it is."""
        if drop:
            delete(self.spark, self.path)
        if self._version() < 0:
            self.spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{self.path}/version=0/rows/list=-1")
            ivf.Centres.save(ivf.Centres(ivf.np.zeros((0, 0))), self.spark, f"{self.path}/version=0/centres")
        return self

    def _version(self) -> int:
        """The last complete version, -1 if there is none."""
        n = -1
        while is_complete(self.spark, f"{self.path}/version={n + 1}/centres"):
            n += 1
        return n

    def _at(self, name: str) -> str:
        return f"{self.path}/version={self._version()}/{name}"

    def _centres(self) -> ivf.Centres:
        return ivf.Centres.load(self.spark, self._at("centres"))

    def insert(self, rows: DataFrame) -> None:
        """Add rows (id, text, dense, sparse); of equal ids the last one inserted is not told from the first, so ids should be new."""
        rows = rows.selectExpr("cast(id as string) id", "cast(text as string) text", "cast(dense as array<float>) dense", "cast(sparse as map<int,float>) sparse")
        self._put(rows, self._centres(), f"{self.path}/version={self._version()}", "append")

    def _put(self, rows: DataFrame, centres: ivf.Centres, folder: str, mode: str) -> None:
        named = rows.withColumnRenamed("dense", "embedding")
        ivf.write(named, centres, f"{folder}/rows", mode) if len(centres.points) else named.withColumnRenamed("embedding", "dense").write.mode("append").parquet(f"{folder}/rows/list=-1")
        if len(centres.points):
            places = rows.select("id", F.explode("sparse").alias("place", "weight"))
            places.repartitionByRange(RANGES, "place", "id").sortWithinPartitions("place").write.mode(mode).parquet(f"{folder}/places")

    def create_index(self, lists: int = ivf.LISTS, sample: int = ivf.SAMPLE) -> Collection:
        """Inverted lists and postings over all rows, as a new version."""
        centres = ivf.Centres.fit(self.rows().select(F.col("id").alias("ord"), F.col("dense").alias("embedding")), lists, sample)
        folder = f"{self.path}/version={self._version() + 1}"
        self._put(self.rows(), centres, folder, "overwrite")
        centres.save(self.spark, f"{folder}/centres")
        return self

    def _lists(self) -> DataFrame:
        """Rows with their list; vectors are named embedding in lists and dense in a collection without an index."""
        indexed = len(self._centres().points) > 0
        schema = SCHEMA.replace("dense", "embedding") if indexed else SCHEMA
        rows = self.spark.read.schema(f"{schema}, list int").option("basePath", self._at("rows")).parquet(self._at("rows"))
        return rows.withColumnRenamed("embedding", "dense")

    def rows(self) -> DataFrame:
        return self._lists().drop("list")

    def count(self) -> int:
        return self.rows().count()

    def dense_search(self, queries: DataFrame, k: int = 50, probes: int = ivf.PROBES) -> DataFrame:
        """(target, id, text, score, rank) of the k largest inner products with queries (target, q), scaled to length 1.

        With an index only the probes nearest lists of each query are read; without one, all rows are.
        """
        rows = self._lists().select(F.col("id").alias("ord"), F.col("dense").alias("embedding"), "text", "list")
        centres = self._centres()
        found = ivf.search(rows, centres, queries, k, probes) if len(centres.points) else dense.top_k(rows, queries, k)
        return found.withColumnRenamed("ord", "id").drop("list")

    def sparse_search(self, queries: DataFrame, k: int = 50) -> DataFrame:
        """The same with sparse queries (target, q as map); rows without any shared place are no hits.

        Queries are sent to the rows in rounds, and each task keeps the k best of a query, so no table of pairs is made.
        """
        ship(self.spark)
        kind = dict(queries.dtypes)["target"]
        wanted, found, n = queries.select("target", "q").where("q is not null").toLocalIterator(), [], 0
        pairs = self.rows().select("id", F.map_keys("sparse").alias("places"), F.map_values("sparse").alias("weights"))
        while (block := list(islice(wanted, dense.QUERIES))) or not found:
            n += len(block)
            found.append(pairs.mapInArrow(_sparse_hits(block, to_arrow_type(queries.schema["target"].dataType), k), f"target {kind}, id string, score double"))
        every = reduce(DataFrame.unionByName, found)
        ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        if n * k <= SENT:
            ranked = F.broadcast(ranked)  # so many rows at most: texts stay where they are
        return ranked.join(self.rows().select("id", "text"), "id")


def _sparse_hits(block: list, kind: pa.DataType, k: int):
    """A task's work: the k best rows (id, places, weights) of each query of a block (target, q) among those that share a place with it."""
    n = len(block)
    entries = [(place, j, float(w)) for j, r in enumerate(block) for place, w in r["q"].items() if w is not None]
    names, at = np.unique(np.array([p for p, _, _ in entries], np.int64), return_inverse=True)
    order = np.argsort(at, kind="stable")
    who, times = np.array([j for _, j, _ in entries], np.int64)[order], np.array([w for _, _, w in entries], np.float64)[order]
    counts = np.bincount(at, minlength=len(names))
    starts = np.cumsum(counts) - counts
    targets = pa.array([r["target"] for r in block], kind)
    rows = max(1, min(1024, CELLS // max(1, n)))

    def scored(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Scores of a few rows for all queries, and whether they share a place."""
        sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(part.column(1)), 0), np.int64)
        place = np.asarray(part.column(1).flatten(), np.int64)
        weight = np.asarray(part.column(2).flatten().to_numpy(zero_copy_only=False), np.float64)
        row = np.repeat(np.arange(part.num_rows), sizes)
        slot = np.minimum(np.searchsorted(names, place), len(names) - 1)
        keep = (names[slot] == place) & (np.asarray(part.column(2).flatten().is_valid()))
        score, shared = np.zeros((part.num_rows, n)), np.zeros((part.num_rows, n), bool)
        cells, shares = score.reshape(-1), shared.reshape(-1)
        row, slot, weight = row[keep], slot[keep], weight[keep]
        for i in range(0, len(row), STEP):  # so many entries of rows at a time, each with the queries that have its place
            s = slot[i : i + STEP]
            many = counts[s]
            ends = np.cumsum(many)
            e = np.repeat(starts[s] - (ends - many), many) + np.arange(ends[-1])
            cell = np.repeat(row[i : i + STEP] * n, many) + who[e]
            first, last = cell.min(), cell.max() + 1
            cells[first:last] += np.bincount(cell - first, times[e] * np.repeat(weight[i : i + STEP], many), last - first)
            shares[cell] = True
        return np.where(shared, dense.rounded(score), -np.inf), shared

    def run(batches):
        best = dense.Best(n, k)
        for b in batches if len(names) else ():
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                score, shared = scored(part)
                floor = best.floor if part.num_rows <= k else np.maximum(best.floor, np.partition(score, -k, axis=0)[-k])
                i, j = np.nonzero(shared & (score >= floor))
                best.add(j, score[i, j], part.column(0).take(pa.array(i)))
        if (whole := best.cut()) is not None:
            yield pa.RecordBatch.from_arrays([targets.take(whole["query"].combine_chunks()), whole["ord"].combine_chunks(), whole["score"].combine_chunks()], names=["target", "id", "score"])

    return run
