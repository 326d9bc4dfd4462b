"""A keyword index that grows by segments: chunks are added and removed without building it anew.

Each change is a folder of its own, numbered in order, which counts once its last table is there.  An addition holds its chunks, their
postings, and how many chunks have each term; a removal holds which chunks of which segment go, and what that takes from these
counts.  The index at any time is the union of the segments without what was removed, with counts
summed, and scores as one that is built anew.  ``compact`` writes that as one segment, bucketed as
``bm25.Index.save`` does, after which the changes before it are read no more.

Cases: an added chunk takes the place of one with its ord that is there; of chunks with one ord in one addition all are
kept, as in a fresh build; removing what isn't there changes nothing; a null ord is never replaced or removed; a change that was stopped is no change.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longleaf.functions import text as T
from longleaf.operators import bm25
from longleaf.session import delete, folders, is_complete

#: Removed chunks that are sent to every task at most.
GONE = 1_000_000


@dataclass
class Segments:
    spark: SparkSession
    path: str
    tokenizer: Callable[[Column], Column] = T.terms
    slots: int = 1  # of each term, the same in all segments

    def _changes(self) -> list[tuple[int, str]]:
        """Number and kind of the complete changes, from the last compaction on."""
        found = sorted((int(n), kind) for n, _, kind in (name.partition("-") for name in folders(self.spark, self.path)) if is_complete(self.spark, f"{self.path}/{n}-{kind}/corpus"))
        last = max((i for i, (_, kind) in enumerate(found) if kind == "whole"), default=0)
        return found[last:]

    def _next(self, kind: str) -> tuple[int, str]:
        """A number after all that are taken, by stopped changes too."""
        n = 1 + max((int(name.partition("-")[0]) for name in folders(self.spark, self.path)), default=0)
        return n, f"{self.path}/{n:08d}-{kind}"

    def _read(self, name: str, *kinds: str) -> DataFrame | None:
        """A table of all changes of these kinds, with the number of each as segment."""
        of = {("whole", "chunks"): "index/chunks", ("whole", "postings"): "index/postings", ("whole", "terms"): "index/vocabulary"}
        parts = [self.spark.read.parquet(f"{self.path}/{n:08d}-{kind}/{of.get((kind, name), name)}").withColumn("segment", F.lit(n)) for n, kind in self._changes() if kind in kinds]
        parts = [p.drop("idf") for p in parts]  # a saved vocabulary has it too
        return reduce(DataFrame.unionByName, parts) if parts else None

    @staticmethod
    def _sent(gone: DataFrame) -> DataFrame:
        """Removed chunks, for a join: sent to postings, which stay where they are, unless there are too many."""
        return F.broadcast(gone) if gone.limit(GONE + 1).count() <= GONE else gone

    def _live(self, name: str) -> DataFrame | None:
        rows, gone = self._read(name, "add", "whole"), self._read("gone", "remove")
        if rows is None or gone is None:
            return rows
        gone = self._sent(gone.select("ord", F.col("of").alias("segment")))
        return rows.join(gone, ["ord", "segment"], "left_anti")

    def add(self, chunks: DataFrame) -> None:
        """Chunks (ord, doc_id, chunk_id, header_path, text) as a new segment; those that are there with their ord go."""
        self.remove(chunks.select("ord"))
        _, folder = self._next("add")
        self._store(bm25.build(chunks, self.tokenizer, self.slots), folder)

    def _store(self, index: bm25.Index, folder: str) -> None:
        index.chunks.write.parquet(f"{folder}/chunks")
        index.postings.write.parquet(f"{folder}/postings")
        saved = [self.spark.read.parquet(f"{folder}/{name}") for name in ("chunks", "postings")]
        saved[1].groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{folder}/terms")
        self._counts(saved[0]).write.parquet(f"{folder}/corpus")

    @staticmethod
    def _counts(chunks: DataFrame) -> DataFrame:
        return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum("n_terms"), F.lit(0)).cast("long").alias("n_terms"))

    def remove(self, ords: DataFrame) -> None:
        """Take out the chunks with these ords (one column, ord)."""
        chunks, postings = self._live("chunks"), self._live("postings")
        if chunks is None:
            return
        _, folder = self._next("remove")
        chunks.join(ords.distinct(), "ord", "left_semi").select("ord", F.col("segment").alias("of"), "n_terms").write.parquet(f"{folder}/gone")
        gone = self.spark.read.parquet(f"{folder}/gone")
        if gone.isEmpty():
            delete(self.spark, folder)
            return
        which = self._sent(gone.select("ord", F.col("of").alias("segment")).distinct())
        postings.join(which, ["ord", "segment"], "left_semi").groupBy("term").agg((-F.count(F.lit(1))).alias("df")).write.parquet(f"{folder}/terms")
        self._counts(gone).select(*[(-F.col(c)).alias(c) for c in ("n_chunks", "n_terms")]).write.parquet(f"{folder}/corpus")

    def index(self) -> bm25.Index:
        """The index as it stands, for ``bm25.search``."""
        changes = self._changes()
        if len(changes) == 1 and changes[0][1] == "whole":
            return bm25.Index.load(self.spark, f"{self.path}/{changes[0][0]:08d}-whole/index")
        chunks, postings = self._live("chunks"), self._live("postings")
        if chunks is None:
            raise ValueError(f"no segment at {self.path}")
        every = ("add", "whole", "remove")
        totals = self._read("corpus", *every).agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_terms").alias("n"))
        corpus = totals.select("n_chunks", F.when(F.col("n_chunks") > 0, F.col("n") / F.col("n_chunks")).otherwise(F.lit(1.0)).alias("avg_terms"))
        counted = self._read("terms", *every).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").crossJoin(F.broadcast(corpus.select("n_chunks")))  # one row
        vocabulary = counted.select("term", "df", bm25.inverse(F.col("df"), F.col("n_chunks")).alias("idf"))
        return bm25.Index(chunks.drop("segment"), postings.drop("segment"), vocabulary, corpus, self.slots)

    def compact(self) -> None:
        """One segment of all that is there; what came before it goes when it is complete."""
        before = [f"{self.path}/{n:08d}-{kind}" for n, kind in self._changes()]
        index = self.index()
        _, folder = self._next("whole")
        index.save(f"{folder}/index")
        saved = bm25.Index.load(self.spark, f"{folder}/index")
        self._counts(saved.chunks).write.parquet(f"{folder}/corpus")
        for old in before:
            delete(self.spark, old)
