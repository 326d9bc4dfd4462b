"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longleaf.llm import ann, bpe, bpetree, chat, filteraudit, hardneg, linedup, media, neardup, packing, sequences, toxicity, wrapper
from longleaf.llm.common import read, small_batches


def op1_onebit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.perspectives(read(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string")))
    return out.withColumn("mask", F.array_join(spans, ","))


def op5_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return wrapper.main_text(read(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return media.copies(media.render(read(spark, sf_dir, "embeddings")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op9_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sequences.pack_sequences(read(spark, sf_dir, "documents"))


def op10_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = linedup.drop_repeated_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "removed_lines", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_bpetree(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpetree.round_trip(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_onebit": op1_onebit, "op2_bpe": op2_bpe, "op3_packing": op3_packing, "op4_chat": op4_chat, "op5_wrapper": op5_wrapper, "op6_toxicity": op6_toxicity, "op7_media": op7_media, "op8_minhash": op8_minhash, "op9_sequences": op9_sequences, "op10_linedup": op10_linedup, "op11_audit": op11_audit, "op12_vptree": op12_vptree, "op13_bpetree": op13_bpetree}


def oracle_sql() -> dict[str, str]:
    return {"op1_onebit": ann.ORACLE, "op4_chat": chat.ORACLE, "op11_audit": filteraudit.ORACLE, "op12_vptree": hardneg.ORACLE}
