"""Retrieval for the targets of a plan: per document, without repeats, with a second try."""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from longleaf.functions import text as T
from longleaf.operators import bm25
from longleaf.session import written


def _hits(index: bm25.Index, targets: DataFrame, k: int) -> DataFrame:
    """Best chunks in the order of the requested documents; of repeated chunks the first stays."""
    wanted = targets.select("target", F.posexplode("doc_ids").alias("pos", "req_doc")).groupBy("target", "req_doc").agg(F.min("pos").alias("pos"))
    found = bm25.search(index, targets.select("target", "query"), k, wanted.select("target", "req_doc"), per_doc=True)
    placed = found.join(wanted, ["target", "req_doc"], "left").withColumn("pos", F.coalesce("pos", F.lit(0)))
    first = Window.partitionBy("target", "chunk_id").orderBy("pos", "rank")
    once = placed.withColumn("n", F.row_number().over(first)).where("n = 1")
    return once.withColumn("hit", F.row_number().over(Window.partitionBy("target").orderBy("pos", "rank"))).drop("n", "pos", "rank", "req_doc")


def retrieve(index: bm25.Index, targets: DataFrame, k: int = 3, second_k: int = 5, second_keep: int = 2) -> DataFrame:
    """Hits of targets (target, semantic_query, keywords, doc_ids); a target without any has one row of nulls.

    Targets whose keywords find nothing are searched again by their semantic query.
    """
    asked = targets.select("target", "doc_ids", "semantic_query", T.query_text(F.col("keywords"), F.col("semantic_query")).alias("query"))
    real = asked.where(F.coalesce(F.col("semantic_query"), F.lit("")) != "")
    first = written(_hits(index, real, k).withColumn("source", F.lit("keywords")), "hits")  # found once, for the answer and for what it leaves open
    missed = real.join(first.select("target").distinct(), "target", "left_anti").withColumn("query", F.col("semantic_query"))
    found = first
    if not missed.isEmpty():
        found = first.unionByName(_hits(index, missed, second_k).where(F.col("hit") <= second_keep).withColumn("source", F.lit("semantic")))
    return asked.select("target").join(found, "target", "left")


def containing(index: bm25.Index, targets: DataFrame) -> DataFrame:
    """(target, ord) of every chunk whose text holds a target's query, character by character.

    A text that holds a query has all terms inside of it, so only chunks with the rarest of these
    are compared; queries without a term that is surely whole are looked for in all texts, many at a time, by one automaton.
    """
    asked = targets.where("query is not null").withColumn("terms", T.terms(F.col("query")))
    inner = asked.select("target", F.explode(F.slice("terms", 2, F.greatest(F.size("terms") - 2, F.lit(0)))).alias("term"))
    rarest = inner.join(index.vocabulary.select("term", "idf"), "term", "left").groupBy("target").agg(F.max_by("term", F.struct(F.coalesce("idf", F.lit(float("inf"))), "term")).alias("term"))
    texts = index.chunks.select("ord", "text")
    likely = rarest.join(index.postings.select("term", "ord"), "term").join(texts, "ord").join(asked.select("target", "query"), "target")
    out = likely.where(F.col("text").contains(F.col("query"))).select("target", "ord")
    rest = asked.join(rarest.select("target"), "target", "left_anti").select("target", "query").toLocalIterator()
    while block := list(islice(rest, bm25.TARGETS)):
        out = out.unionByName(_held(texts, block, targets.select("target").schema))
    return out


def _held(texts: DataFrame, block: list, schema: T_.StructType) -> DataFrame:
    """(target, ord) of the texts that hold queries of a block."""
    of: dict[str, list[int]] = {}
    for k, r in enumerate(block):
        of.setdefault(r["query"], []).append(k)
    made: dict[str, object] = {}

    @F.arrow_udf("array<int>")
    def found(column: pa.Array) -> pa.Array:
        import ahocorasick

        if not made:
            made["of"] = a = ahocorasick.Automaton()
            for q, ks in of.items():
                if q:
                    a.add_word(q, ks)
            a.make_automaton()
        every = of.get("", [])  # every text holds the empty query
        seen = [sorted({*every, *(k for _, ks in made["of"].iter(t) for k in ks)}) if t is not None and len(made["of"]) else every if t is not None else [] for t in column.to_pylist()]
        return pa.array(seen, pa.list_(pa.int32()))

    places = texts.sparkSession.createDataFrame([(r["target"], k) for k, r in enumerate(block)], T_.StructType([*schema.fields, T_.StructField("k", T_.IntegerType())]))
    return texts.select("ord", F.explode(found("text")).alias("k")).join(F.broadcast(places), "k").select("target", "ord")  # a block's rows
