"""Saved postings that are read by slot, rounds of targets, and texts that hold queries."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from longleaf.operators import bm25, retrieve
from longleaf.session import is_complete
from test_engine import asked, chunks


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def many(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.concat(F.lit("w"), F.pmod(F.col("id") * 31 + i * i * 7, F.lit(211)).cast("string")))
    text = F.concat(F.lit("every "), F.array_join(words, " "))
    return spark.range(800).select(F.col("id").alias("ord"), F.lit("d").alias("doc_id"), F.col("id").cast("string").alias("chunk_id"), F.lit("").alias("header_path"), text.alias("text"))


def scored(df):
    return sorted((r["target"], r["ord"], round(r["bm25"], 9)) for r in df.collect())


def test_slots_change_no_score(spark, many):
    t = spark.createDataFrame([("a", "every w3 w40 w3"), ("b", "w7"), ("c", "none of these"), ("d", "")], "target string, query string")
    want = scored(bm25.scores(bm25.build(many), t))
    assert len(want) > 800 and scored(bm25.scores(bm25.build(many, slots=5), t)) == want


def test_a_search_shuffles_and_reads_no_other_buckets(spark, many, tmp_path):
    path = str(tmp_path / "i")
    bm25.build(many, slots=3).save(path, buckets=16)
    index = bm25.Index.load(spark, path)
    assert index.slots == 3 and index.info().head()["n_chunks"] == 800
    few = spark.createDataFrame([("a", "w3 w40")], "target string, query string")
    plan = plan_of(bm25.scores(index, few))
    selected, of = map(int, re.search(r"SelectedBucketsCount: (\d+) out of (\d+)", plan).groups())
    assert of == 16 and selected <= 6
    assert scored(bm25.scores(index, few)) == scored(bm25.scores(bm25.build(many), few))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        more = spark.range(400).select(F.col("id").alias("target"), F.concat(F.lit("w"), F.pmod("id", F.lit(200)).cast("string"), F.lit(" x"), F.col("id").cast("string"), F.lit(" y"), (F.col("id") * 7).cast("string"), F.lit(" z"), (F.col("id") * 3).cast("string")).alias("query"))
        plan = plan_of(bm25.scores(index, more))
        assert "Bucketed: true" in plan and "SelectedBucketsCount: 16 out of 16" in plan
        assert len(re.findall(r"Exchange hashpartitioning\(slot", plan)) == 1  # the targets' side
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_index_of_another_layout_is_built_anew(spark, many, tmp_path):
    path = str(tmp_path / "i")
    bm25.build(chunks(spark)).save(path)
    corpus = spark.read.parquet(f"{path}/corpus").select("n_chunks", "avg_terms").collect()
    spark.createDataFrame(corpus, "n_chunks long, avg_terms double").write.mode("overwrite").parquet(f"{path}/corpus")
    assert bm25.Index.ensure(many, path).info().head()["n_chunks"] == 800
    (tmp_path / "i" / "corpus" / "_SUCCESS").unlink()
    assert not is_complete(spark, f"{path}/corpus") and bm25.Index.ensure(chunks(spark), path).info().head()["n_chunks"] == 4


def test_rounds_read_their_own_part(spark, many, monkeypatch):
    index = bm25.build(many)
    t = spark.range(40).select(F.col("id").alias("target"), F.concat(F.lit("every w"), (F.col("id") * 5).cast("string")).alias("query"))
    names = ("target", "ord", "score", "rank")
    want = sorted(map(tuple, bm25.search(index, t, 3).select(*names).collect()))
    monkeypatch.setattr(bm25, "TARGETS", 6)
    assert sorted(map(tuple, bm25.search(index, t, 3).select(*names).collect())) == want and len(want) == 120


def test_queries_without_a_whole_term_are_found_at_once(spark, monkeypatch):
    index = bm25.build(chunks(spark))
    monkeypatch.setattr(bm25, "TARGETS", 3)
    queries = ["pple", "e", "", "red", "pple", "sky", "zzz", " ", "d appl", "blue sky"]
    t = spark.createDataFrame(list(enumerate(queries)), "target int, query string")
    texts = {r["ord"]: r["text"] for r in chunks(spark).collect()}
    assert {(r["target"], r["ord"]) for r in retrieve.containing(index, t).collect()} == {(k, o) for k, q in enumerate(queries) for o, x in texts.items() if q in x}
    assert retrieve.containing(index, asked(spark, None)).count() == 0


def test_pairs_of_target_and_chunk_are_not_shuffled(spark, many):
    index, t = bm25.build(many), spark.createDataFrame([("a", "every w3 w40 w3"), ("b", "every w7")], "target string, query string")
    got = bm25.scores_by_chunk(index, t)
    assert scored(got) == scored(bm25.scores(index, t))
    assert "hashpartitioning(target" not in plan_of(got) and "hashpartitioning(ord" in plan_of(got)
