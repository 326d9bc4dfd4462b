"""Files, settings, command line, both indexes together, collections and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from longleaf import __main__ as command
from longleaf import settings
from longleaf.functions import headings as H
from longleaf.functions import text as T
from longleaf.operators import bm25, chunking, collection, dense, hybrid, retrieve
from longleaf.plans import agent, provider, report
from longleaf.sources import files
from longleaf.streaming import ingest
from test_engine import Failing, asked, chunks


def test_a_saved_index_is_used_until_forced(spark, tmp_path):
    path = str(tmp_path / "i")
    assert bm25.Index.ensure(chunks(spark), path).info().head()["n_chunks"] == 4
    fewer = chunks(spark).where("ord < 2")
    assert bm25.Index.ensure(fewer, path).info().head()["n_chunks"] == 4
    assert bm25.Index.ensure(fewer, path, force=True).info().head()["n_chunks"] == 2


def test_rounds_of_targets_give_the_same_scores(spark, monkeypatch):
    index = bm25.build(chunks(spark))
    t = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(["red apple", "green pie", "sky  blue", "", "apple pie apple"])], "target string, query string")
    want = sorted(map(tuple, bm25.search(index, t, 3).select("target", "ord", "score", "rank").collect()))
    monkeypatch.setattr(bm25, "TARGETS", 2)
    assert sorted(map(tuple, bm25.search(index, t, 3).select("target", "ord", "score", "rank").collect())) == want and len(want) > 5


def test_scores_follow_the_rule(spark):
    """By the definition, for each chunk and target, in plain Python."""
    index = bm25.build(chunks(spark))
    query = "red apple\x1c apple"
    base = {r["ord"]: r["bm25"] for r in bm25.scores(index, asked(spark, query)).collect()}
    grams = lambda s: {*(b := "".join(c for c in s if not c.isspace() or c == "\x1c")), *(x + y for x, y in zip(b, b[1:], strict=False))}
    texts = {r["ord"]: r["text"] for r in chunks(spark).collect()}
    want = {o: round(s + 0.3 * len(grams(query) & grams(texts[o])) + 0.25 * sum(t in texts[o] for t in ("red", "apple", "apple")), 4) for o, s in base.items()}
    assert {r["ord"]: r["score"] for r in bm25.search(index, asked(spark, query), 5).collect()} == pytest.approx(want)


def test_texts_that_hold_a_query_are_found_by_their_rarest_term(spark):
    index = bm25.build(chunks(spark))
    t = spark.createDataFrame([("a", "red apple pie"), ("b", "pple"), ("c", "apple"), ("d", "ed apple pi"), ("e", "red pie apple"), ("f", "")], "target string, query string")
    got = {(r["target"], r["ord"]) for r in retrieve.containing(index, t).collect()}
    texts = {r["ord"]: r["text"] for r in chunks(spark).collect()}
    assert got == {(r["target"], o) for r in t.collect() for o, x in texts.items() if r["query"] in x}


def test_both_indexes(spark, tmp_path):
    path = str(tmp_path / "h")
    h = hybrid.Hybrid.build(chunks(spark), path)
    assert dense.count(h.vectors).head().asDict() == {"vectors": 4, "dim": 256}
    more = chunks(spark).union(spark.createDataFrame([(9, "z", "c9", "", "new words here")], chunks(spark).schema))
    again = hybrid.Hybrid.build(more, path, force=False)
    assert again.vectors.count() == 5 and hybrid.Hybrid.load(spark, path).vectors.count() == 5
    t = asked(spark, "red apple pie")
    assert h.search_keywords(t, 1).head()["chunk_id"] == "c0"
    assert h.search_meaning(t, 1).head()["chunk_id"] == "c0"
    f = spark.createDataFrame([("q", "ab")], "target string, req_doc string")
    assert [r["chunk_id"] for r in h.search_meaning(t, 3, filters=f).collect()] == ["c1"]
    assert h.search_meaning(t, 2, rerank=Failing).count() == 2
    listed = hybrid.Hybrid.build(chunks(spark), str(tmp_path / "l"), lists=3)
    assert listed.centres is not None and hybrid.Hybrid.load(spark, str(tmp_path / "l")).vectors.columns == ["ord", "embedding", "list"]
    assert [r["chunk_id"] for r in listed.search_meaning(t, 1, probes=1).collect()] == ["c0"] and listed.search_meaning(t, 9).count() == h.search_meaning(t, 9).count()


def test_a_stopped_embedding_goes_on(spark, tmp_path):
    path = str(tmp_path / "v")
    dense.embed(chunks(spark), path, slices=4)
    first = (tmp_path / "v" / "slice=1" / "_SUCCESS").stat().st_mtime_ns
    (tmp_path / "v" / "slice=3" / "_SUCCESS").unlink()
    assert dense.embed(chunks(spark), path, slices=4).count() == 4
    assert (tmp_path / "v" / "slice=1" / "_SUCCESS").stat().st_mtime_ns == first


def test_collection(spark, tmp_path):
    c = collection.Collection(spark, str(tmp_path / "c")).create()
    assert c.count() == 0
    c.insert(spark.createDataFrame([("a", "x", [1.0, 0.0], {1: 2.0}), ("b", "y", [0.0, 1.0], {2: 1.0, 1: 0.5}), ("c", "z", None, None)], collection.SCHEMA))
    assert c.create(drop=False).count() == 3
    q = spark.createDataFrame([("q", [0.0, 3.0], {1: 1.0})], "target string, q array<float>, s map<int,float>")
    assert [(r["id"], r["score"]) for r in c.dense_search(q.select("target", "q"), 2).orderBy("rank").collect()] == [("b", 1.0), ("a", 0.0)]
    assert [(r["id"], r["score"]) for r in c.sparse_search(q.select("target", F.col("s").alias("q"))).orderBy("rank").collect()] == [("a", 2.0), ("b", 0.5)]


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("retrieval:\n  bm25:\n    top_k: 7\nagent: 3\n")
    s = settings.Settings(str(tmp_path / "c.yaml"), {"TOKEN_BUDGET": "12"})
    assert s.get("retrieval", "bm25", "top_k") == 7 and s.get("agent", "batch_size", default=1) == 1
    assert {k: settings.known(s)[k] for k in ("top_k", "fallback_k", "token_budget")} == {"top_k": 7, "fallback_k": 5, "token_budget": 12}
    (tmp_path / "c.toml").write_text("[output]\ndir = 'x'\n")
    assert settings.known(settings.Settings(str(tmp_path / "c.toml"), {}))["output_dir"] == "x"
    assert settings.Settings(str(tmp_path / "none.json"), {}).values == {}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "chunks").mkdir()
    rows = [r.asDict() | {"tokens": 3} for r in chunks(spark).drop("ord").collect()]
    (tmp_path / "chunks" / "d.json").write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    index = ["--index", str(tmp_path / "i")]
    assert command.main([*index, "info"], spark) == 1
    assert command.main([*index, "build", str(tmp_path / "chunks")], spark) == 0
    assert command.main([*index, "search", "red pie", "--top-k", "1"], spark) == 0
    assert command.main([*index, "info"], spark) == 0
    out = capsys.readouterr().out
    assert "[1] a_x | c0" in out and "chunks: 4" in out


def test_raw_files_of_domains(spark, tmp_path):
    for p in ("ins/a.pdf", "ins/b.md", "reg/txt/c.txt", "reg/html/d.html", "reg/other/e.txt", "reg/txt/deep/f.txt", "reg/a.txt"):
        (tmp_path / "raw" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / p).write_text("1. 总体要求\n正文" if p.endswith("txt") else "<h1>1. 网页标题</h1><p>网页正文")
    f = files.raw_files(spark, str(tmp_path / "raw"))
    assert {(r["doc_id"], r["ext"], r["domain"], r["subdir"]) for r in f.collect()} == {("a", "pdf", "ins", "ins"), ("c", "txt", "reg", "txt"), ("d", "html", "reg", "html"), ("a", "txt", "reg", "reg")}
    assert {r["doc_id"] for r in files.raw_files(spark, str(tmp_path / "raw"), domains=["ins"]).collect()} == {"a"}
    assert {r["doc_id"]: r["path"].rsplit("/", 2)[-2] for r in files.mapping(f).collect()}["a"] == "reg"
    pdf, rest = files.by_kind(f)
    assert (pdf.count(), rest.count()) == (1, 3)
    words = spark.createDataFrame([("a", 1, "1. 文件标题", 10.0, 0.0, 14.0), ("a", 1, "正文内容", 30.0, 0.0, 10.0), ("a", 1, "更多内容", 50.0, 0.0, 10.0), ("a", 1, "7", 90.0, 0.0, 10.0)], "doc_id string, page int, text string, top double, x0 double, size double")
    got = {(r["doc_id"], r["total_sections"], tuple((s["header_path"], s["content"]) for s in r["flat_sections"])) for r in files.parsed(spark, f.where("ext <> 'txt' or subdir <> 'reg'"), words).collect()}
    assert got == {
        ("a", 2, (("文档", ""), ("文档 > 文件标题", "正文内容\n更多内容\n"))),
        ("c", 2, (("文档", ""), ("文档 > 总体要求", "正文\n"))),
        ("d", 2, (("文档", ""), ("文档 > 网页标题", "网页正文\n"))),
    }
    same = lambda **ways: sorted(map(str, files.scanned_lines(spark, f.where("ext <> 'pdf'"), **ways).collect()))
    assert same(folder=str(tmp_path / "raw")) == same()
    files.write_trees(files.parsed(spark, f.where("ext = 'html'")), str(tmp_path / "trees"))
    assert spark.read.json(str(tmp_path / "trees")).head()["section_tree"][0]["children"][0]["title"] == "网页标题"


def test_section_tree_is_json_of_any_text(spark):
    lines = spark.createDataFrame([("d", 0, 'a "q" \\ \t'), ("d", 1, "第一章 甲甲甲"), ("d", 2, "第一类：乙乙乙"), ("d", 3, "第一条 丙丙丙"), ("d", 4, "第二章 丁丁丁")], "doc_id string, ord int, line string")
    r = H.section_tree(H.section_rows(lines)).head()
    root = json.loads(r["section_tree"])[0]
    assert root["content"] == 'a "q" \\ \t\n' and [c["title"] for c in root["children"]] == ["甲甲甲", "丁丁丁"]
    assert [c["title"] for c in root["children"][0]["children"]] == ["乙乙乙", "丙丙丙"]


def test_page_body_takes_the_first_of_equally_frequent_sizes(spark):
    w = spark.createDataFrame([("d", 1, 9.0, 5.0, 0.0), ("d", 1, 11.0, 1.0, 0.0), ("d", 2, 8.0, 0.0, 0.0), ("d", 2, 0.0, 0.0, 0.0)], "doc_id string, page int, size double, top double, x0 double")
    assert {(r["page"], r["body"]) for r in H.page_body(w).collect()} == {(1, 11.0), (2, 8.0)}


def test_result_files(spark, tmp_path):
    a = spark.createDataFrame([("2", "", 5, 1), ("1", "A", 2, 1)], "qid string, answer string, prompt_tokens int, completion_tokens int")
    document = json.loads(files.answers_document(a, report.run_summary(a, 4.0)).head()["value"])
    assert document["summary"]["questions"] == 2 and [x["qid"] for x in document["answers"]] == ["1", "2"]
    for _ in range(2):
        files.append_log(a, str(tmp_path / "log"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()) == ["1: A tok=2/1"] * 2 + ["2: (empty) tok=5/1"] * 2
    files.write_evidence(a.withColumn("evidence", F.array("qid")), str(tmp_path / "evidence"))
    assert sorted(p.name for p in (tmp_path / "evidence").glob("qid=*")) == ["qid=1", "qid=2"]
    c = spark.createDataFrame([("c1", "d", "h", "t", 3, ["i"], "x"), ("c2", "d", "h", "t", 3, None, "y")], files.CHUNK + ", domain string")
    files.write_chunks(c, str(tmp_path / "chunks"))
    assert spark.read.json(str(tmp_path / "chunks" / "all")).count() == 2 and (tmp_path / "chunks" / "by_domain" / "domain=x").exists()
    files.write_chunks(c.drop("domain"), str(tmp_path / "plain"))
    assert spark.read.json(str(tmp_path / "plain" / "all")).count() == 2


def test_small_sources(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.json").write_text('[{"qid":"1","question":"x"},{"qid":"1","question":"y"}]')
    (tmp_path / "q" / "b.jsonl").write_text('{"qid":"1","question":"z"}')
    assert [r["question"] for r in files.distinct_questions(spark, str(tmp_path / "q")).collect()] == ["z"]
    (tmp_path / "r.json").write_text('﻿{"1":"because"}', encoding="utf-8")
    assert files.reasoning(spark, str(tmp_path / "r.json")).head()["reasoning"] == "because"
    (tmp_path / "reg.json").write_text('{"cat":{"d1":{"title":"T1"}}}')
    known = files.registry(spark, str(tmp_path / "reg.json"))
    q = spark.createDataFrame([("q", ["d2", "d1"])], "qid string, doc_ids array<string>")
    assert files.titled(q, known).head()["titles"] == ["d2", "T1"]
    docs = spark.createDataFrame([("d", " a \n\n　b　")], "doc_id string, text string")
    assert [(r["ord"], r["line"]) for r in files.plain_lines(docs).collect()] == [(0, "a"), (1, "b")]
    n = spark.range(5).select(F.col("id").alias("k"))
    assert (files.first_rows(n, "k", 2).count(), files.first_rows(n, "k", 0).count()) == (2, 5)
    assert spark.createDataFrame([("a > b > c",)], "p string").select(T.parent_path(F.col("p")).alias("x")).head()["x"] == "a > b"
    assert [r["x"] for r in spark.createDataFrame([("|" * 6,), ("x" * 99,), ("x" * 100,)], "t string").select(T.keeps_whole(F.col("t")).alias("x")).collect()] == [True, True, False]


class Recording:
    """Answers every call, and needs a formula first."""

    def chat(self, prompts):
        return [('{"need_calc":true,"code":"result = 2 * 3"}' if "need_calc" in p else '{"correct_options":["A"]}' if "result = 6.0" in p else "", 10, 1) for p in prompts]


def test_numeric_questions_take_two_calls(spark):
    q = spark.createDataFrame([("1", "how much is 2 times 3", {"A": "6"}, "计算题", []), ("2", "plain", {"A": "y"}, "单选题", [])], "qid string, question string, options map<string,string>, type string, doc_ids array<string>")
    got = {r["qid"]: r for r in agent.run(q, bm25.build(chunks(spark)), Recording).collect()}
    assert got["1"]["answer"] == "A" and got["1"]["calculated"] == "result = 6.0" and got["2"]["calculated"] is None
    assert got["1"]["prompt_tokens"] == got["2"]["prompt_tokens"] + 10


@pytest.mark.parametrize("code,result", [
    ("import math\nresult = math.ceil(2.1) + math.sqrt(9)", "result = 6.0"), ("total = 0\nfor i in range(1, 4):\n    total += i * 10\nresult = total", "result = 60.0"),
    ("rates = {'a': 0.1, 'b': 0.2}\nresults = {}\nfor k, v in rates.items():\n    if v > 0.15:\n        results[k] = v * 100\n    else:\n        results[k] = 0", "results = {'a': 0, 'b': 20.0}"),
    ("xs = [1, 2, 3]\nys = [x * x for x in xs if x != 2]\nresult = sum(ys)", "result = 10.0"), ("a, b = [3, 4]\nresult = max(a, b)", "result = 4"), ("result = 2\nprint(result)", "result = 2"),
    ("out = []\nfor i, x in enumerate([5, 6]):\n    out.append(i + x)\nresult = out", "result = [5.0, 7.0]"), ("results = {k: v > 1 for k, v in zip(['A', 'B'], [1, 2])}", "results = {'A': False, 'B': True}"),
])
def test_formulas_with_loops(code, result):
    assert agent.evaluate(code) == result


def test_formulas_take_so_many_steps():
    for code in ("x = 0\nfor i in range(9999):\n    for j in range(9999):\n        x += 1\nresult = x", "result = range(10 ** 9)", "x = [1]\nfor i in range(70):\n    x = [x, x]\nresult = x", "x = y = [1]\nfor i in range(70):\n    x = [x, x]\n    y = [y, y]\nresult = x == y", "while True:\n    pass", "def f():\n    return 1\nresult = f()", "import os", "from math import pi", "result = math.factorial(9)", "result = ().__class__", "result = [].append.__self__", "x = 'a'\nresult = x.format(1)", "result = print.__self__", "result = sorted(3)"):
        assert agent.evaluate(code).startswith("failed"), code


def test_formulas_are_bounded():
    assert agent.evaluate("x = [1, 2]\nresult = sum(x) / len(x) if 1 < 2 else 0") == "result = 1.5"
    for code in ("result = 'a' * 9", "result = (1).real", "f = lambda: 1", "result = 2 ** 1000", "for i in []: pass", "result = x", "result = [1] * 9", "(" * 300):
        assert agent.evaluate(code).startswith("failed"), code


def test_evidence_of_one_description_stands_together(spark):
    rows = [("q", 0, "rates", "s1", ["c1"], "five"), ("q", 1, "limits", "s2", ["c2", "c3"], "ten"), ("q", 2, "rates", "s3", ["c4"], "six"), ("q", 3, "", "s4", [], "")]
    c = spark.createDataFrame(rows, "qid string, target_ord int, description string, semantic_query string, chunk_ids array<string>, compressed_text string").withColumns({"prompt_tokens": F.lit(1), "completion_tokens": F.lit(2)})
    r = agent.evidence_of(c).head()
    assert r["evidence"].strip() == "rates\n[c1] five\n[c4] six\nlimits\n[c2, c3] ten" and (r["evidence_prompt"], r["evidence_completion"]) == (4, 8)


def test_documents_without_chunks_are_worked_on_once(spark, tmp_path):
    where = [str(tmp_path / x) for x in ("in", "out", "check")]
    spark.createDataFrame([("e", ""), ("a", "# 一、标题\n内容内容内容内容内容内容内容")], "doc_id string, text string").write.parquet(where[0])
    ingest.ingest(spark, *where).awaitTermination()
    spark.createDataFrame([("e", "# 一、标题\n内容内容内容内容内容内容内容"), ("a", "x")], "doc_id string, text string").write.mode("append").parquet(where[0])
    ingest.ingest(spark, *where).awaitTermination()
    assert [r["doc_id"] for r in ingest.chunks(spark, where[1]).collect()] == ["a"]


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:10", 7, "click", 1.0), (2, "2024-01-01 00:04:00", 7, "click", 2.0), (3, "2024-01-01 00:50:00", 7, "view", 4.0), (4, "2024-01-01 03:00:00", 8, "view", 1.0)]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    for name, made, table in (("w", ingest.windowed_counts, lambda r: (r["event_type"], r["n"], r["value"])), ("s", ingest.sessions, lambda r: (r["user_id"], r["n"], str(r["last"])))):
        made(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "w" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        got, whole = sorted(map(table, spark.table(name).collect())), sorted(map(table, made(events).collect()))
        assert got and set(got) <= set(whole)
        if name == "w":
            assert got == whole == [("click", 2, 3.0), ("view", 1, 1.0), ("view", 1, 4.0)]
        else:
            assert whole == [(7, 1, "2024-01-01 00:50:00"), (7, 2, "2024-01-01 00:04:00"), (8, 1, "2024-01-01 03:00:00")]


def test_peers_merge_in_rounds_from_the_left():
    sections = [chunking.Section(f"{k}、x", 4, "CHINESE", False, f"{k}、x", chunks=["x" * 4 * n], labels=[f"{k}、x"], first=k, last=k, size=n) for k, n in enumerate((100, 100, 150, 100, 300), 1)]
    got = chunking.merge_peers(sections, 400, "A")
    assert [s.labels for s in got] == [["1、x", "2、x"], ["3、x", "4、x"], ["5、x"]]


def test_providers():
    s = provider.Scripted([("a", "1"), ("b", "22")])
    assert s.chat(["xa", "b", "c"]) == [("1", 2, 1), ("22", 1, 2), ("", 1, 0)]


def test_texts_in_gbk_are_read(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, raw in (("u", "﻿# 标题 é".encode()), ("g", "# 标题\n内容".encode("gb18030")), ("x", b"\x81")):
        (tmp_path / "d" / f"{name}.md").write_bytes(raw)
    got = {r["doc_id"]: r["text"] for r in files.documents(spark, str(tmp_path / "d")).collect()}
    assert got == {"u": "# 标题 é", "g": "# 标题\n内容", "x": "�"}
