"""Inverted lists of vectors: each row stands in the list of its nearest centre, and a search reads the lists it probes.

Centres are those of Spark's k-means on a bounded sample; every row is dealt to a list.  A table of
lists is partitioned by list, so a search that probes some lists reads their files only.  Lists suit vectors of
similar length (embeddings are of length 1); where lengths differ much, near lists are no sign of large inner products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longleaf.operators import dense
from longleaf.session import ship

#: Lists, lists that a query probes, and vectors of the sample for each list.
LISTS, PROBES, SAMPLE = 128, 64, 256


def sound(vector: str = "embedding"):
    """Whether a vector can be compared: neither null nor empty, and without components that are null or not finite."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


@dataclass
class Centres:
    points: np.ndarray
    #: Root of the mean squared length of the sample's vectors.
    length: float = 1.0

    @staticmethod
    def fit(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE, rounds: int = 10, seed: int = 7) -> Centres:
        """Of vectors (ord, embedding); at most lists x sample of them, those with the smallest hashes of their ord, take part.

        Vectors of another length than the sample's most frequent one have no say.
        """
        some = vectors.where(sound()).select("ord", F.col("embedding").cast("array<double>").alias("embedding")).orderBy(F.xxhash64("ord"), "ord").limit(lists * sample)
        dim = some.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        if dim is None:
            return Centres(np.zeros((0, 0)))
        points = some.where(F.size("embedding") == dim["dim"]).select(array_to_vector("embedding").alias("features"))
        model = KMeans(k=lists, maxIter=rounds, seed=seed).fit(points.repartition(8)) if dim["count"] > 1 else None
        centres = np.array(model.clusterCenters() if model else [r["features"].toArray() for r in points.collect()])
        squared = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
        length = some.where(F.size("embedding") == dim["dim"]).agg(F.sqrt(F.avg(squared))).head()[0]
        return Centres(centres[np.lexsort(centres.T[::-1])], float(length))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(n, p.tolist(), self.length) for n, p in enumerate(self.points)], "list int, centre array<double>, length double").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Centres:
        rows = sorted(spark.read.schema("list int, centre array<double>, length double").parquet(path).collect())  # a row for each list
        return Centres(np.array([r["centre"] for r in rows]), rows[0]["length"]) if rows else Centres(np.zeros((0, 0)))

    def dealt(self, vectors: DataFrame) -> DataFrame:
        """vectors (embedding) with list: the nearest centre, or -1 for vectors that can't be compared."""
        ship(vectors.sparkSession)
        points = self.points
        half = (points * points).sum(axis=1) / 2

        @F.arrow_udf("int")
        def nearest(column: pa.Array) -> pa.Array:
            out = np.full(len(column), -1, np.int32)
            rows = column.to_pylist()
            fit = [i for i, v in enumerate(rows) if v is not None and len(v) == points.shape[1]]
            if fit and len(points):
                v = np.array([rows[i] for i in fit], np.float64)
                out[fit] = (v @ points.T - half).argmax(axis=1)
            return pa.array(out)

        return vectors.withColumn("list", F.when(sound(), nearest("embedding")).otherwise(F.lit(-1)))

    def probe(self, probes: int):
        """For a block of queries: by list, the places of the queries that probe it, each query those whose centres are nearest to it when it has the rows' length."""

        def of(q: np.ndarray) -> list[np.ndarray]:
            length = np.sqrt((q * q).sum(axis=1))
            q = self.length * q / np.where(length > 0, length, 1)[:, None]
            chosen = np.argsort((self.points * self.points).sum(axis=1) / 2 - q @ self.points.T, axis=1, kind="stable")[:, :probes]
            out: list[list[int]] = [[] for _ in self.points]
            for i, lists in enumerate(chosen.tolist()):
                for n in lists:
                    out[n].append(i)
            return [np.array(x, np.int64) for x in out]

        return of


def write(vectors: DataFrame, centres: Centres, path: str, mode: str = "overwrite") -> None:
    """Vectors, with all their columns, dealt to lists and partitioned by them; lists of many rows become several files."""
    centres.dealt(vectors).hint("rebalance", "list").write.mode(mode).partitionBy("list").parquet(path)


def search(lists: DataFrame, centres: Centres, queries: DataFrame, k: int = 50, probes: int = PROBES) -> DataFrame:
    """(target, ord, score, rank and other columns): of the vectors in the lists (ord, embedding, list) that each of queries (target, q) probes, the k best.

    With as many probes as lists the result is exact.
    """
    return dense.top_k(lists, queries, k, probe=centres.probe(probes))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, wanted, found and recall of hits (target, ord) held against exact ones."""
    hit = exact.select("target", "ord").join(found.select("target", "ord", F.lit(1).alias("hit")), ["target", "ord"], "left")
    return hit.agg(F.count_distinct("target").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.greatest("wanted", F.lit(1)))
