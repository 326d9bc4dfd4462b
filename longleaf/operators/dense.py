"""Exact dense search by inner product, saved vectors, and the fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from longleaf.plans import provider
from longleaf.session import delete, is_complete, ship

#: Query vectors that are sent to the tasks at once (more go in several rounds), and vectors that meet them in one product.
QUERIES, ROWS = 4096, 1024


def rounded(scores: np.ndarray) -> np.ndarray:
    """To six places, halves away from zero."""
    return np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6, scores)


class Best:
    """The k best rows of each of n queries, by score (ties by ord), among all that were added.

    Rows wait in a buffer; when it holds several times what may stay, it is sorted and cut.  What is kept is a part of
    any larger set's best, so the best of several tasks' bests are the best of all rows.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k, self.held = n, k, 0
        #: A query's k-th best score so far; lower ones can't stay.
        self.floor = np.full(n, -np.inf)
        self.parts: list[pa.Table] = []

    def add(self, query: np.ndarray, score: np.ndarray, ord_: pa.Array) -> None:
        if len(query):
            self.parts.append(pa.table({"query": query, "score": score, "ord": ord_}))
            self.held += len(query)
            if self.held > 4 * self.n * self.k:
                self.cut()

    def cut(self) -> pa.Table | None:
        if not self.parts:
            return None
        whole = pa.concat_tables(self.parts).combine_chunks().sort_by([("query", "ascending"), ("score", "descending"), ("ord", "ascending")])
        query = np.asarray(whole["query"])
        at = np.arange(len(query)) - np.searchsorted(query, query)
        whole = whole.take(pa.array(np.flatnonzero(at < self.k)))
        full = np.flatnonzero(at == self.k - 1)
        self.floor[query[full]] = np.asarray(whole["score"])[np.flatnonzero(at[at < self.k] == self.k - 1)]
        self.parts, self.held = [whole], len(whole)
        return whole


def _hits(vectors: DataFrame, block: list, kind: pa.DataType, schema: str, k: int, probes: list[np.ndarray] | None = None) -> DataFrame:
    """(target, ord, score): for each query of a block, its k best vectors in each task.

    With probes (by list: the places of the queries that look into it) vectors have a list, and meet these queries only.
    """
    q = np.array([r["q"] for r in block], np.float64).reshape(len(block), -1)
    norm = np.sqrt((q * q).sum(axis=1))
    q = q / np.where(norm > 0, norm, 1)[:, None]
    targets = pa.array([r["target"] for r in block], kind)
    every = np.arange(len(block))

    def meet(best: Best, asked: np.ndarray, part: pa.RecordBatch) -> None:
        v = np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
        scores = rounded(q[asked] @ v.T)
        floor = best.floor[asked]
        if part.num_rows > k:
            floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
        i, j = np.nonzero(scores >= floor[:, None])
        best.add(asked[i], scores[i, j], part.column(0).take(pa.array(j)))

    def run(batches):
        best = Best(len(block), k)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                keep = [i for i, v in enumerate(part.column(1).to_pylist()) if v is not None and len(v) == q.shape[1] and None not in v]
                if not keep:
                    continue
                part = part.take(pa.array(keep))
                if probes is None:
                    meet(best, every, part)
                    continue
                lists = np.asarray(part.column(2))
                for one in np.unique(lists).tolist():
                    asked = probes[one] if 0 <= one < len(probes) else every  # rows of no list meet all queries
                    if len(asked):
                        meet(best, asked, part.take(pa.array(np.flatnonzero(lists == one))))
        if (whole := best.cut()) is not None:
            yield pa.RecordBatch.from_arrays([targets.take(whole["query"].combine_chunks()), whole["ord"].combine_chunks(), whole["score"].combine_chunks()], names=["target", "ord", "score"])

    return vectors.select("ord", "embedding", *(["list"] if probes is not None else [])).mapInArrow(run, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 50, allow: Column | None = None, narrow: Column | None = None, coarse: int = 100, probe: Callable[[np.ndarray], list[np.ndarray]] | None = None) -> DataFrame:
    """(target, ord, score, rank and the vectors' other columns): the k best vectors (ord, embedding) for each of queries (target, q).

    allow filters before ranking.  narrow filters after taking the coarse best, as search engines
    with a fixed index do, and so may give fewer than k.  Queries are scaled to length 1; vectors
    that are null, hold nulls or have another length than the queries take no part.  Matrix
    products of a block of queries and a batch of vectors leave each task's k best of a query only, so
    no table of pairs is made, and targets x k x tasks rows at most are shuffled.  probe (see ``ivf``) tells, for a block of
    queries, which of them look into each list; vectors then have a column list, and only lists that are looked into are read.
    """
    ship(vectors.sparkSession)
    kind = to_arrow_type(queries.schema["target"].dataType)
    schema = f"target {dict(queries.dtypes)['target']}, ord {dict(vectors.dtypes)['ord']}, score double"
    base = vectors if allow is None else vectors.where(allow)
    wanted = k if narrow is None else max(k, coarse)
    rows = queries.select("target", "q").where("q is not null").toLocalIterator()
    found, read = None, {-1}
    while (block := list(islice(rows, QUERIES))) or found is None:
        if not block:
            part = vectors.sparkSession.createDataFrame([], schema)
        elif probe is None:
            part = _hits(base, block, kind, schema, wanted)
        else:
            probes = probe(np.array([r["q"] for r in block], np.float64))
            mine = {n for n, asked in enumerate(probes) if len(asked)}
            read |= mine
            part = _hits(base.where(F.col("list").isin(*mine, -1)), block, kind, schema, wanted, probes)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("target").orderBy(F.desc("score"), "ord")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)
    ranked = ranked.join((vectors if probe is None else vectors.where(F.col("list").isin(*read))).drop("embedding"), "ord")
    if narrow is not None:
        ranked = ranked.where(narrow).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked


def fused(lists: DataFrame, k: int = 10, offset: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (target, ord, rank), one row for each list's hit.  An extension: the two search paths are otherwise apart."""
    total = lists.groupBy("target", "ord").agg(F.round(F.sum(F.lit(1.0) / (F.lit(float(offset)) + F.col("rank"))), 6).alias("score"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "ord"))).where(F.col("rank") <= k)


def embed(chunks: DataFrame, path: str, make: Callable[[], provider.Embed] = provider.HashedGrams, dim: int = 256, slices: int = 8, force: bool = False) -> DataFrame:
    """Vectors of chunks (ord, text), kept at path: chunks that have one there are left out, so a build that was stopped goes on where it was.

    Each slice of the chunks is a job of its own whose output is there whole or not at all.
    """
    spark = chunks.sparkSession
    if force:
        delete(spark, path)
    for n in range(slices):
        if not is_complete(spark, f"{path}/slice={n}"):
            mine = chunks.select("ord", "text").where(F.pmod(F.xxhash64("ord"), F.lit(slices)) == n)
            provider.with_embedding(mine, "text", make, dim).select("ord", "embedding").write.mode("overwrite").parquet(f"{path}/slice={n}")
    stored = load(spark, path).select("ord", "embedding")
    fresh = chunks.select("ord", "text").join(stored, "ord", "left_anti")
    if not fresh.isEmpty():
        more = sum(1 for _ in _slices(spark, path))
        provider.with_embedding(fresh, "text", make, dim).select("ord", "embedding").write.mode("overwrite").parquet(f"{path}/slice={more}")
    return load(spark, path).select("ord", "embedding")


def _slices(spark: SparkSession, path: str):
    n = 0
    while is_complete(spark, f"{path}/slice={n}"):
        yield n
        n += 1


def save(vectors: DataFrame, path: str) -> None:
    """Vectors with their chunks' columns, to be loaded again."""
    vectors.write.mode("overwrite").parquet(f"{path}/slice=0")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Saved vectors; text, doc_id and header_path are empty where they were not saved."""
    saved = spark.read.option("basePath", path).parquet(*[f"{path}/slice={n}" for n in _slices(spark, path)]).drop("slice")
    return saved.select("*", *[F.lit("").alias(c) for c in ("doc_id", "header_path") if c not in saved.columns])


def count(vectors: DataFrame) -> DataFrame:
    """vectors and their dim, in one row."""
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).alias("dim"))
