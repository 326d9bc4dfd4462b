"""What grows with the input: expressions worked out once, and tasks that hold little."""

import pyarrow as pa
from pyspark.sql import functions as F

from longleaf import rulequeries
from longleaf.functions import text as T
from longleaf.operators import bm25, chunking, collection, lexicon, segments, tables

SMALL = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_table_is_parsed_once(spark):
    plan = optimized(spark.read.parquet(f"{SMALL}/pages.parquet").select(tables.html_to_markdown(F.col("html")).alias("m")))
    assert plan.count("(?is)<tr") == 1
    assert optimized(rulequeries.html_table(spark, SMALL)).count("split(") == 1


def test_first_terms_are_those_of_all(spark):
    texts = ["", " ", "one", "-one two", "A b;c d e f g", "é-Ü 7x\n8 -", "a b c d e", "...a b c d e ... ", None, "İ ß 第一章 ²"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", T.first_terms(F.col("text"), 5).alias("first"), F.slice(T.terms(F.col("text")), 1, 5).alias("want")).collect():
        assert r["first"] == r["want"], r["text"]


def test_sentences_are_made_in_one_pass(spark):
    assert "lambdafunction" not in optimized(rulequeries.chunk_split_cases(spark, SMALL))


def test_pieces_leave_a_task_in_slices():
    text = ("word " * 20 + "\n") * 100
    batch = pa.RecordBatch.from_pydict({"doc_id": [str(n) for n in range(500)], "text": [text] * 500})
    schema = pa.schema([("doc_id", pa.string()), ("text", pa.string())])
    got = list(chunking.in_slices(iter([batch]), lambda r: [(r["doc_id"], c[1]) for c in chunking.article_chunks(r["text"])], schema))
    assert len(got) > 3 and max(sum(map(len, b["text"].to_pylist())) for b in got) < 2 * chunking.SLICE_CHARS
    assert {d for b in got for d in b["doc_id"].to_pylist()} == {str(n) for n in range(500)}


def test_pairs_of_free_targets_are_scored_in_tasks(spark):
    """With filters that name no target, what was found is neither worked out twice nor shuffled by pairs."""
    index = bm25.build(spark.range(300).select(F.col("id").alias("ord"), F.lit("d").alias("doc_id"), F.col("id").cast("string").alias("chunk_id"), F.lit("").alias("header_path"), F.concat(F.lit("every w"), (F.col("id") % 17).cast("string")).alias("text")))
    t = spark.createDataFrame([("a", "every w3"), ("b", "w7 w7"), ("c", "x"), (None, "w1")], "target string, query string")
    none = spark.createDataFrame([], "target string, req_doc string")
    got = bm25.search(index, t, 3, none, per_doc=True)
    plan = optimized(got)
    assert "bm25" not in plan and plan.count("collect_list") == 1
    assert {(r["target"], r["ord"]) for r in got.collect()} == {("a", 3), ("a", 20), ("a", 37), ("b", 7), ("b", 24), ("b", 41)}
    plain = {(r["target"], r["ord"], r["score"]) for r in bm25.search(index, t, 3, enhanced=False).collect() if r["target"]}
    slow = bm25.scores(index, t).where("target is not null").select("target", "ord", F.round("bm25", 4).alias("score")).collect()
    assert plain == {tuple(r) for x in "ab" for r in sorted((r for r in slow if r["target"] == x), key=lambda r: (-r["score"], r["ord"]))[:3]}


def test_grams_and_words_are_counted_alike_by_squares_and_by_search(monkeypatch):
    asked = [("red apple  pie", ["red", "apple", "pie"]), ("", []), ("中文 字", ["中文"]), ("pp\\x1cp\\U0001f600", ["pp"])]
    texts = ["a red apple", "", "字 中文", "pie pie\\x1cp\\U0001f600 ", "\\ud800 x"]
    want = [[(len({*bm25.gram_codes(q)} & {*bm25.gram_codes(t)}), sum(w in t for w in ws)) for q, ws in asked] for t in texts]
    for limits in ({}, {"LETTERS": 1}, {"CELLS": 1}):
        for name, n in limits.items():
            monkeypatch.setattr(bm25, name, n)
        shared, held = bm25.overlaps(asked)(texts)
        assert [[(int(a), int(b)) for a, b in zip(x, y, strict=True)] for x, y in zip(shared, held, strict=True)] == want


def test_terms_are_cut_a_few_texts_at_a_time(spark):
    cut = lexicon.Lexicon(spark.createDataFrame([("ab", 5), ("cd", 5)], "word string, n long")).cutter()
    got = list(cut.func(iter([pa.array([["abcd", "x"], None, []] * 400)])))
    assert len(got) > 5 and max(map(len, got)) <= lexicon.SLICE
    assert [x for c in got for x in c.to_pylist()] == [["ab", "cd", "x"], [], []] * 400


def test_sparse_pairs_are_scored_in_tasks(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("text"), F.lit(None).cast("array<float>").alias("dense"), F.when(F.col("id") % 11 != 0, F.create_map((F.col("id") % 5).cast("int"), F.col("id").cast("float"), F.lit(9), F.lit(-1.0))).alias("sparse"))
    c = collection.Collection(spark, str(tmp_path / "c")).create()
    c.insert(rows)
    q = spark.createDataFrame([("a", {1: 2.0}), ("b", {9: 1.0, 7: 3.0}), ("c", {}), ("d", None), ("e", {77: 1.0})], "target string, q map<int,double>")
    got = c.sparse_search(q, 2)
    assert "Aggregate" not in optimized(got)
    assert sorted((r["target"], r["id"], r["score"], r["rank"]) for r in got.collect()) == [("a", "51", 102.0, 2), ("a", "56", 112.0, 1), ("b", "1", -1.0, 1), ("b", "10", -1.0, 2)]


def test_postings_are_counted_where_texts_are(spark, tmp_path):
    made = spark.range(40).select(F.col("id").alias("ord"), F.lit("d").alias("doc_id"), F.col("id").cast("string").alias("chunk_id"), F.lit("").alias("header_path"), F.concat(F.lit("a b w"), F.col("id").cast("string")).alias("text"))
    plan = bm25.build(made, slots=1).postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(ord" in plan
    s = segments.Segments(spark, str(tmp_path / "s"))
    s.add(made)
    s.remove(made.where("ord < 5").select("ord"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in s.index().postings._jdf.queryExecution().executedPlan().toString()
        assert s.index().postings.count() == 3 * 35
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
