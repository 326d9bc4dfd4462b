from __future__ import annotations

import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from longleaf.operators import bm25, dense, retrieve
from longleaf.plans import agent, provider, report
from longleaf.sources import files
from longleaf.streaming import ingest


def chunks(spark):
    rows = [(0, "a_x", "c0", "", "red apple pie apple"), (1, "ab", "c1", "", "green apple"), (2, "a（y", "c2", "", "blue sky"), (3, "a", "c3", "", "")]
    return spark.createDataFrame(rows, "ord int, doc_id string, chunk_id string, header_path string, text string")


def asked(spark, query, target="q"):
    return spark.createDataFrame([(target, query)], "target string, query string")


def test_scores_count_repeated_terms(spark):
    index = bm25.build(chunks(spark))
    once = {r["ord"]: r["bm25"] for r in bm25.scores(index, asked(spark, "apple")).collect()}
    twice = {r["ord"]: r["bm25"] for r in bm25.scores(index, asked(spark, "apple apple")).collect()}
    assert set(once) == {0, 1} and all(abs(twice[k] - 2 * v) < 1e-9 for k, v in once.items())


def test_filters_by_name_or_beginning(spark):
    index = bm25.build(chunks(spark))
    f = spark.createDataFrame([("q", "a")], "target string, req_doc string")
    assert {r["ord"] for r in bm25.allowed(index, f).collect()} == {0, 2, 3}
    assert {r["ord"] for r in bm25.allowed(index, f, prefix=False).collect()} == {3}
    assert [r["ord"] for r in bm25.search(index, asked(spark, "apple"), 5, f).collect()] == [0]


def test_index_is_saved_and_loaded(spark, tmp_path):
    bm25.build(chunks(spark)).save(str(tmp_path))
    assert bm25.Index.load(spark, str(tmp_path)).info().head()["n_chunks"] == 4


def test_retrieval_second_try_and_empty_targets(spark):
    index = bm25.build(chunks(spark))
    t = spark.createDataFrame([("t1", ["ab", "a"], "sky", "apple"), ("t2", [], "apple", "zzz"), ("t3", [], "", "apple"), ("t4", [], "zzz", "")], "target string, doc_ids array<string>, semantic_query string, keywords string")
    got = [(r["target"], r["ord"], r["source"]) for r in retrieve.retrieve(index, t).orderBy("target", "hit").collect()]
    assert got == [("t1", 1, "keywords"), ("t1", 0, "keywords"), ("t2", 0, "semantic"), ("t2", 1, "semantic"), ("t3", None, None), ("t4", None, None)]


def test_dense_filters_before_and_after(spark):
    v = spark.createDataFrame([(i, [1.0, i / 10], i % 2) for i in range(10)], "ord int, embedding array<float>, label int")
    q = spark.createDataFrame([("q", [0.0, 2.0])], "target string, q array<float>")
    assert [r["ord"] for r in dense.top_k(v, q, 2, allow=F.col("label") == 0).orderBy("rank").collect()] == [8, 6]
    assert [r["ord"] for r in dense.top_k(v, q, 2, narrow=F.col("label") == 0, coarse=1).orderBy("rank").collect()] == [8]


class Failing:
    def chat(self, prompts):
        raise OSError

    def rerank(self, query, texts):
        raise OSError


class Answering:
    def chat(self, prompts):
        return [('{"correct_options":["B","A"]}', 3, 1)] * len(prompts)


def test_a_failing_model_leaves_the_rules(spark):
    q = spark.createDataFrame([("1", "which apple is red", {"A": "red apple", "B": "sky"}, "单选题", [])], "qid string, question string, options map<string,string>, type string, doc_ids array<string>")
    index = bm25.build(chunks(spark))
    r = agent.run(q, index, Failing).head()
    assert (r["answer"], r["prompt_tokens"]) == ("A", 0)
    assert agent.run(q.withColumn("type", F.lit("多选题")), index, Answering).head()["answer"] == "AB"
    hits = spark.createDataFrame([("q", "red", "red apple", 1.0, 0), ("q", "red", "sky", 2.0, 1)], "target string, query string, text string, score double, ord int")
    assert [x["ord"] for x in provider.reranked(hits).collect()] == [0, 1]
    assert [x["ord"] for x in provider.reranked(hits, Failing).collect()] == [1, 0]


def test_embedding_repairs_wrong_lengths(spark):
    d = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [len(r["embedding"]) for r in provider.with_embedding(d, "t", dim=256).collect()] == [256, 256]
    assert {tuple(r["embedding"]) for r in provider.with_embedding(d, "t", dim=8).collect()} == {(0.0,) * 8}


def test_calculation_takes_numbers_only():
    assert agent.calculate("(1 + 2) * 3 / 4") == 2.25
    assert agent.calculate("__import__('os')") is None and agent.calculate("2 ** 9") is None and agent.calculate("1/0") is None


def test_submission_has_its_summary_first(spark):
    q = spark.createDataFrame([("1", "问题", "单选题", {"A": "x"}), ("2", "how much", "计算题", None)], "qid string, question string, type string, options map<string,string>")
    a = spark.createDataFrame([("1", "A", 10, 5)], "qid string, answer string, prompt_tokens long, completion_tokens long")
    rows = report.submission(q, a).collect()
    assert [r["qid"] for r in rows] == ["summary", "1", "2"]
    assert rows[0]["total_tokens"] == sum(r["total_tokens"] for r in rows[1:]) and rows[2]["warnings"] == ["empty answer"]
    assert rows[1]["prompt_tokens"] == 10 and rows[2]["prompt_tokens"] == 202


def test_sources(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "fin.json").write_text("﻿" + json.dumps([{"qid": "1", "question": "x", "options": {"A": "y"}}]), encoding="utf-8")
    (tmp_path / "q" / "ins.jsonl").write_text('{"qid":"2","question":"z","domain":"d"}\n\n{"qid":"3"}\n', encoding="utf-8")
    got = {r["qid"]: (r["domain"], r["options"]) for r in files.questions(spark, str(tmp_path / "q")).collect()}
    assert got == {"1": ("fin", {"A": "y"}), "2": ("d", None), "3": ("ins", None)}
    assert [r["qid"] for r in files.questions(spark, str(tmp_path / "q"), "fin").collect()] == ["1"]
    for k, v in enumerate(({"answers": [{"qid": "1", "answer": "A", "tokens": {"input": 2, "output": 1}}]}, {"1": "A"}, [{"qid": "1", "answer": "A"}], {"1": {"answer": "A"}})):
        (tmp_path / f"a{k}.json").write_text(json.dumps(v))
        rows = files.answers(spark, str(tmp_path / f"a{k}.json")).collect()
        assert [(r["qid"], r["answer"]) for r in rows] == [("1", "A")], v
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "x.html").write_text("<p>")
    (tmp_path / "raw" / "y.md").write_text("# a")
    assert [(r["doc_id"], r["ext"], r["subdir"]) for r in files.raw_files(spark, str(tmp_path / "raw")).collect()] == [("x", "html", "raw")]
    assert files.documents(spark, str(tmp_path / "raw")).head()["text"] == "# a"
    parts = spark.createDataFrame([("d", 2, 2, "b"), ("d", 1, 2, "a"), ("e", 1, 2, "a")], "doc_id string, part int, parts int, text string")
    assert [(r["doc_id"], r["text"]) for r in files.merged_parts(parts).collect()] == [("d", "<!-- Part 1 -->\na\n\n<!-- Part 2 -->\nb")]
    files.write_csv(spark.createDataFrame([("1", "")], "qid string, answer string"), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_text(encoding="utf-8").startswith("﻿qid,answer")


def test_ingest_chunks_each_document_once(spark, tmp_path):
    docs = lambda *ids: spark.createDataFrame([(i, "# 一、标题\n内容内容内容内容内容内容内容") for i in ids], "doc_id string, text string")
    where = [str(tmp_path / x) for x in ("in", "out", "check")]
    docs("a", "b").write.parquet(where[0])
    ingest.ingest(spark, *where).awaitTermination()
    docs("b", "c").write.mode("append").parquet(where[0])
    ingest.ingest(spark, *where).awaitTermination()
    assert sorted(r["doc_id"] for r in ingest.chunks(spark, where[1]).collect()) == ["a", "b", "c"]


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_more_query_vectors_than_are_broadcast(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(9)], "ord int, embedding array<double>, label int")
    q = v.select(F.col("ord").alias("target"), F.col("embedding").alias("q"))
    want = sorted(dense.top_k(v, q, 2).select("target", "ord", "rank").collect())
    monkeypatch.setattr(dense, "QUERIES", 4)
    assert len(want) == 18 and sorted(dense.top_k(v, q, 2).select("target", "ord", "rank").collect()) == want


def test_recall_counts_every_item(spark, tmp_path):
    items = [(i, f"q{i} z{i}") for i in range(1030)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(k, " ".join(t for _, t in items[k::103]), "en", "s") for k in range(103)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    r = entry.queries()["recall_at_ten"](spark, str(tmp_path)).head()
    assert r["items"] == 1030
