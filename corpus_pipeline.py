"""The training-corpus pipeline: toxic documents go, repeated passages go, one document of each
near-duplicate group stays, and what is left is packed into sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir).  All but the last return
the columns of documents.  A stage's result is written as Parquet and read again by the next one.

Cases, as the operators define them: null and empty texts are clean, have no lines or shingles
and so pass every filter, and are packed as one end id; a null id counts as held out for the
classifier, as later than all others for lines and classes, and stays null; rows equal in id and
text are one document, of which near_dedup keeps one row (of documents without words all rows);
very long texts are judged whole; other columns are handed on, whatever their names; empty tables
give no rows, and without labels of both kinds no document is toxic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longleaf.llm import linedup, neardup, packing, toxicity
from longleaf.llm.common import Tables, free_name, read, small_batches


def _counted(df: DataFrame) -> DataFrame:
    """The number of characters follows the text, where there is such a column."""
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the classifier learns from labels of these documents only."""
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that earlier documents have; those that had nothing else go."""
    small_batches(spark)
    removed = free_name(docs, "removed_lines")
    out = linedup.drop_repeated_lines(docs, removed_col=removed)
    emptied = (F.size(removed) > 0) & ~F.col("text").rlike(r"(?U)\S")
    return _counted(out.where(~emptied).select(docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    small_batches(spark)
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 ids."""
    small_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("toxicity", reject_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("packing", pack)]
#: A trained network, alignment, hashing and a tokenizer are beyond SQL.  Tests hold line_dedup, near_dedup and packing against brute force, and toxicity against its labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
