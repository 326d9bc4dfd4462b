"""Both indexes over one table of chunks: built together, searched apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longleaf.operators import bm25, dense, ivf
from longleaf.plans import provider
from longleaf.session import is_complete


@dataclass
class Hybrid:
    keywords: bm25.Index
    vectors: DataFrame  # ord, embedding, and list if there are lists
    make: Callable[[], provider.Embed]
    dim: int
    centres: ivf.Centres | None = None

    @staticmethod
    def build(chunks: DataFrame, path: str, make: Callable[[], provider.Embed] = provider.HashedGrams, dim: int = 256, force: bool = True, lists: int = 0) -> Hybrid:
        """Both indexes of chunks (ord, doc_id, chunk_id, header_path, text) at path; vectors go on where a stopped build was unless force makes them anew.

        With lists the vectors are dealt to so many inverted lists too (see ``ivf``), which searches then probe.
        """
        bm25.Index.ensure(chunks, f"{path}/keywords", force)
        vectors = dense.embed(chunks, f"{path}/vectors", make, dim, force=force)
        if lists:
            centres = ivf.Centres.fit(vectors, lists)
            ivf.write(vectors, centres, f"{path}/lists")
            centres.save(chunks.sparkSession, f"{path}/centres")
        return Hybrid.load(chunks.sparkSession, path, make, dim)

    @staticmethod
    def load(spark: SparkSession, path: str, make: Callable[[], provider.Embed] = provider.HashedGrams, dim: int = 256) -> Hybrid:
        keywords = bm25.Index.load(spark, f"{path}/keywords")
        if is_complete(spark, f"{path}/centres"):
            return Hybrid(keywords, spark.read.parquet(f"{path}/lists"), make, dim, ivf.Centres.load(spark, f"{path}/centres"))
        return Hybrid(keywords, dense.load(spark, f"{path}/vectors").select("ord", "embedding"), make, dim)

    def search_keywords(self, targets: DataFrame, k: int = 5, filters: DataFrame | None = None) -> DataFrame:
        return bm25.search(self.keywords, targets, k, filters)

    def search_meaning(self, targets: DataFrame, k: int = 5, coarse: int = 50, filters: DataFrame | None = None, rerank: Callable[[], provider.Rerank] = provider.WordOverlap, probes: int = ivf.PROBES) -> DataFrame:
        """The k most relevant of the coarse nearest chunks of targets (target, query); with filters (target, req_doc) the nearest 100 at least are filtered by exact document first."""
        asked = provider.with_embedding(targets.select("target", "query"), "query", self.make, self.dim)
        coarse = coarse if filters is None else max(coarse, 100)
        asked = asked.select("target", F.col("embedding").alias("q"))
        near = ivf.search(self.vectors, self.centres, asked, coarse, probes).drop("list") if self.centres else dense.top_k(self.vectors, asked, coarse)
        hits = near.join(self.keywords.chunks.select("ord", "doc_id", "chunk_id", "header_path", "text"), "ord").join(targets.select("target", "query"), "target")
        if filters is not None:
            named = filters.select("target").distinct().withColumn("named", F.lit(True))
            allowed = filters.select("target", F.col("req_doc").alias("doc_id")).distinct().withColumn("allowed", F.lit(True))
            hits = hits.join(named, "target", "left").join(allowed, ["target", "doc_id"], "left").where("named is null or allowed").drop("named", "allowed")
        best = provider.reranked(hits.select("target", "query", "text", "score", "ord", "doc_id", "chunk_id", "header_path"), rerank, k)
        return best.withColumn("rerank_score", F.round("rerank_score", 4)).drop("query", "score")
