"""Keyword search that reads only the parts of an index whose best possible score reaches the k-th best found so far.

Chunks are dealt to ranges of neighbours (by document and place), and a term's postings in one range are a block, whose
largest contribution to a score is kept beside it.  For a target, the sum of its terms' largest contributions in a range bounds the score of
every chunk there.  The ranges with the largest bounds are scored first; the k-th best score in them is
the floor, and of the other ranges only those whose bound reaches it are scored.  The result is that of the full search.
Postings are partitioned by range, so ranges that no target needs are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longleaf.functions import text as T
from longleaf.operators import bm25
from longleaf.session import is_complete, written

#: Chunks of a range, and ranges of each target that are scored first.
RANGE_CHUNKS, FIRST = 10_000, 2
#: What rounding to four places may add to a score.
SLACK = 1e-3


@dataclass
class Blocks:
    index: bm25.Index
    postings: DataFrame  # term, ord, part, range (part: the posting's share of a score, but for the term's idf)
    blocks: DataFrame  # term, range, top, n

    @staticmethod
    def ensure(index: bm25.Index, path: str, range_chunks: int = RANGE_CHUNKS) -> Blocks:
        """Blocks of an index, saved at path unless they are there."""
        spark = index.chunks.sparkSession
        if not is_complete(spark, f"{path}/blocks"):
            ranges = max(1, -(-index.chunks.count() // range_chunks))
            placed = index.chunks.select("ord", "doc_id").repartitionByRange(ranges, "doc_id", "ord").select("ord", F.spark_partition_id().alias("range"))
            placed = written(placed, "ranges")  # where the borders are is settled once
            part = bm25.saturation(F.col("tf"), F.col("n_terms"), F.col("avg_terms"))
            parts = index.postings.join(placed, "ord").crossJoin(F.broadcast(index.corpus)).select("term", "ord", part.alias("part"), "range")  # corpus: one row
            parts.hint("rebalance", "range").sortWithinPartitions("range", "term").write.mode("overwrite").partitionBy("range").parquet(f"{path}/postings")
            Blocks._postings(spark, path, index).groupBy("term", "range").agg(F.max("part").alias("top"), F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/blocks")
        return Blocks(index, Blocks._postings(spark, path, index), spark.read.parquet(f"{path}/blocks"))

    @staticmethod
    def _postings(spark: SparkSession, path: str, index: bm25.Index) -> DataFrame:
        kind = dict(index.chunks.dtypes)["ord"]
        return spark.read.schema(f"term string, ord {kind}, part double, range int").parquet(f"{path}/postings")

    def _bounds(self, asked: DataFrame) -> DataFrame:
        """(target, range, bound, n): the largest score that a chunk of each range can have, and its postings for the target."""
        return asked.join(self.blocks, "term").groupBy("target", "range").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"), F.sum("n").alias("n"))

    def _scored(self, asked: DataFrame, where: DataFrame, k: int, weights: dict | None) -> DataFrame:
        """(target, ord, score) of the chunks in some ranges (target, range); with weights, the k best of each task, which scores its chunks for all targets."""
        if weights is None:  # more terms than are sent to every task
            pairs = asked.join(where.select("target", "range"), "target")
            scored = self.postings.join(pairs, ["term", "range"]).groupBy("target", "ord").agg(F.sum(F.col("weight") * F.col("part")).alias("raw"))
            return scored.select("target", "ord", F.round("raw", 4).alias("score"))
        tasks = bm25.tasks_of(self.postings.sparkSession, self.index.corpus.head()["n_chunks"])
        shares = self.postings.select("term", "ord", F.col("part").alias("share"), "range")
        rows = where.groupBy("target").agg(F.collect_set("range").alias("ranges")).toLocalIterator()
        parts: list[DataFrame] = []
        while (block := list(islice(rows, bm25.TARGETS))) or not parts:
            parts.append(bm25.best_of(shares, weights, block, k, asked.schema["target"].dataType, tasks, ranges={r["target"]: r["ranges"] for r in block}))
        return reduce(DataFrame.unionByName, parts)

    def _searched(self, targets: DataFrame, k: int, first: int, tokenizer: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
        """Hits, and the ranges (target, range, n, reads) with whether they were read."""
        asked = bm25.weighted(self.index.vocabulary, targets, tokenizer)
        weights = bm25.by_target(asked)
        bounds = self._bounds(asked).withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("bound"), "range")))
        bounds = written(bounds, "bounds")
        best = Window.partitionBy("target").orderBy(F.desc("score"), "ord")
        top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = written(top(self._scored(asked, bounds.where(F.col("place") <= first), k, weights)), "first")
        floors = found.where(F.col("rank") == k).select("target", F.col("score").alias("floor"))
        reads = (F.col("place") <= first) | F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor"))
        judged = bounds.join(floors, "target", "left").select("target", "range", "n", (F.col("place") <= first).alias("first"), reads.alias("reads"))
        rest = self._scored(asked, judged.where("reads and not first"), k, weights)
        return top(found.drop("rank").unionByName(rest)), judged

    def search(self, targets: DataFrame, k: int = 10, first: int = FIRST, tokenizer: Callable[[Column], Column] = T.terms) -> DataFrame:
        """(target, ord, score, rank): the k best chunks of each target (target, query), as ``bm25.search`` without enhancement gives them."""
        return self._searched(targets, k, first, tokenizer)[0].select("target", "ord", "score", "rank")

    def share(self, targets: DataFrame, k: int = 10, first: int = FIRST, tokenizer: Callable[[Column], Column] = T.terms) -> DataFrame:
        """(ranges, read, postings, postings_read) over all targets of such a search."""
        of = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        judged = self._searched(targets, k, first, tokenizer)[1]
        return judged.agg(F.count(F.lit(1)).alias("ranges"), F.count_if("reads").alias("read"), of("n").alias("postings"), of(F.when(F.col("reads"), F.col("n"))).alias("postings_read"))
