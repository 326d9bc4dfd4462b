"""A batch of questions from files to results."""

from __future__ import annotations

import csv
import json

from longleaf import __main__ as command
from longleaf.operators import bm25
from longleaf.plans import batch, provider
from test_replies import CHUNKS, QUESTIONS, SCRIPT


class Script(provider.Scripted):
    def __init__(self):
        super().__init__(SCRIPT)


def test_a_batch_writes_all_results(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(provider, "WAIT", 0)
    index = bm25.build(spark.createDataFrame(CHUNKS, "ord int, doc_id string, chunk_id string, header_path string, text string"))
    (tmp_path / "q").mkdir()
    rows = [{"qid": q, "question": x, "options": o, "type": t, "doc_ids": d} for q, x, o, t, d in QUESTIONS]
    (tmp_path / "q" / "fin.json").write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "q" / "ins.jsonl").write_text('{"qid":"q4","question":"nothing of it","type":"单选题"}\n', encoding="utf-8")
    out = str(tmp_path / "out")
    assert batch.answer(index, str(tmp_path / "q"), out, Script, "script", domain="fin") == 0
    assert {r["qid"]: r["answer"] for r in spark.read.json(f"{out}/answers").collect()} == {"q1": "AB", "q2": "A", "q3": "B"}
    assert {r["qid"] for r in spark.read.json(f"{out}/evidence").where("evidence like '%[c%'").collect()} == {"q1", "q2", "q3"}
    summary = spark.read.json(f"{out}/summary").head()
    trace = {r["stage"]: r for r in spark.read.json(f"{out}/trace").collect()}
    assert summary["questions"] == 3 and summary["seconds"] >= sum(r["seconds"] for r in trace.values()) > 0
    assert sum(r["calls"] for r in trace.values()) == 10 and sum(r["prompt_tokens"] for r in trace.values()) == summary["prompt_tokens"]
    document = json.loads((next((tmp_path / "out" / "document").glob("part-*.txt"))).read_text(encoding="utf-8"))
    assert [a["qid"] for a in document["answers"]] == ["q1", "q2", "q3"] and document["summary"]["questions"] == 3
    lines = list(csv.reader(next((tmp_path / "out" / "submission").glob("*.csv")).read_text(encoding="utf-8-sig").splitlines()))
    assert lines[0][0] == "qid" and [r[0] for r in lines[1:]] == ["summary", "q1", "q2", "q3"]

    assert batch.answer(index, str(tmp_path / "q"), out, Script, "script", domain="fin") == 0
    assert {r["stage"]: r["calls"] for r in spark.read.json(f"{out}/trace").collect()} == {"plan": 0, "retrieve": 0, "compress": 0, "answer": 0}
    assert len(spark.read.text(f"{out}/log").collect()) == 6

    index.save(str(tmp_path / "i"))
    where = ["--index", str(tmp_path / "i"), "answer", str(tmp_path / "q"), "--out", str(tmp_path / "cli")]
    assert command.main([*where, "--limit", "2"], spark) == 0 and "plan: 2 rows, 0 calls" in capsys.readouterr().out
    assert command.main([*where, "--domain", "ins"], spark) == 2  # a question without options has no answer by rule
