"""Kept replies: one call for each prompt, runs that go on, tokens that are those of the calls made."""

from __future__ import annotations

import json
import uuid
from functools import partial
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from longleaf.operators import bm25
from longleaf.plans import agent, provider

CHUNKS = [(0, "d1", "c0", "", "red apple pie"), (1, "d1", "c1", "", "green pear tart"), (2, "d2", "c2", "", "the rate is 5 of 100")]
QUESTIONS = [("q1", "which pie", {"A": "apple", "B": "pear"}, "多选题", ["d1"]), ("q2", "what is the rate", {"A": "5", "B": "6"}, "计算题", ["d2"]), ("q3", "green tart", {"A": "apple", "B": "pear tart"}, "单选题", ["d1"])]
SCRIPT = [
    ("Calculated:\nresult = 0.05", '{"correct_options":["A"]}'), ('"need_calc": true', '{"need_calc":true,"code":"result = 5 / 100"}'), (f"{agent.ANSWER_TASK}\nJudge each option", '{"correct_options":["B","A"]}'),
    (f"{agent.PLAN_TASK}\nPlan what to look up for each option", '{"retrieval_plan":[{"semantic_query":"apple pie","keywords":"apple|pie","description":"pies","doc_ids":["d1"]}]}'),
]


class Counting(provider.Scripted):
    """Leaves a file for each prompt that it is asked."""

    def __init__(self, folder: str, failing: str = ""):
        super().__init__(SCRIPT)
        self.folder, self.failing = Path(folder), failing

    def chat(self, prompts):
        if self.failing and any(self.failing in p for p in prompts):
            raise OSError
        for p in prompts:
            (self.folder / uuid.uuid4().hex).write_text(json.dumps(p))
        return super().chat(prompts)


@pytest.fixture(autouse=True)
def at_once(monkeypatch):
    monkeypatch.setattr(provider, "WAIT", 0)


@pytest.fixture(scope="module")
def asked(spark):
    i = bm25.build(spark.createDataFrame(CHUNKS, "ord int, doc_id string, chunk_id string, header_path string, text string"))
    return i, spark.createDataFrame(QUESTIONS, "qid string, question string, options map<string,string>, type string, doc_ids array<string>")


def calls(folder: Path) -> list[str]:
    return [json.loads(p.read_text()) for p in folder.iterdir()]


def test_each_prompt_is_sent_once(spark, tmp_path, asked):
    index, q = asked
    (tmp_path / "calls").mkdir()
    make = partial(Counting, str(tmp_path / "calls"))
    replies, trace = provider.Replies(spark, str(tmp_path / "kept")), agent.Trace()
    out = agent.run(q, index, make, replies, trace)
    rows = sorted((r["qid"], r["answer"], r["needs_calculation"], r["calculated"]) for r in out.collect())
    assert rows == [("q1", "AB", False, None), ("q2", "A", True, "result = 0.05"), ("q3", "B", False, None)]
    made = calls(tmp_path / "calls")
    assert len(made) == 10 == len(set(made))
    spent = {r["stage"]: r for r in replies.spent().collect()}
    assert {k: r["calls"] for k, r in spent.items()} == {"plan": 3, "compress": 3, "formula": 1, "answer": 3}
    total = out.agg(F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c")).head()
    assert total["p"] == sum(map(len, made)) == sum(r["prompt_tokens"] for r in spent.values()) and total["c"] == sum(r["completion_tokens"] for r in spent.values())
    stages = {r["stage"]: r for r in trace.table(replies).collect()}
    assert [stages[s]["calls"] for s in ("plan", "retrieve", "compress", "answer")] == [3, 0, 3, 4] and all(r["seconds"] > 0 for r in stages.values())
    assert stages["answer"]["figures"] == {"empty": 0, "calculated": 1} and stages["plan"]["figures"] == {"first_round": 3}

    again = provider.Replies(spark, str(tmp_path / "kept"))
    out = agent.run(q, index, make, again)
    assert sorted((r["qid"], r["answer"], r["needs_calculation"], r["calculated"]) for r in out.collect()) == rows
    assert len(calls(tmp_path / "calls")) == 10 and again.spent().where(F.col("run") == again.run).count() == 0


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    (tmp_path / "calls").mkdir()
    monkeypatch.setattr(provider, "STORED", 4)
    d = spark.createDataFrame([(f"prompt {i % 9}", i) for i in range(12)] + [(None, 99)], "p string, reply int")
    d = d.withColumnRenamed("reply", "n")
    kept = provider.Replies(spark, str(tmp_path / "kept"), model="m")
    provider.with_chat(d, "p", partial(Counting, str(tmp_path / "calls"), "prompt 7"), kept, batch=1)
    assert sorted(calls(tmp_path / "calls")) == [f"prompt {i}" for i in range(9) if i != 7]
    out = provider.with_chat(d, "p", partial(Counting, str(tmp_path / "calls")), kept, batch=1)
    assert sorted(calls(tmp_path / "calls")) == [f"prompt {i}" for i in range(9)]
    assert {r["n"]: r["reply"] for r in out.collect()} == {i: "" for i in [*range(12), 99]} and out.agg(F.sum("prompt_tokens")).head()[0] == 9 * 8
    assert kept.kept().where("part <> 'none'").select("part").distinct().count() >= 3  # a job for every four prompts
    other = provider.Replies(spark, str(tmp_path / "kept"), model="n")
    provider.with_chat(d.limit(1), "p", partial(Counting, str(tmp_path / "calls")), other)
    assert len(calls(tmp_path / "calls")) == 10  # another model's replies are no replies of this one


class Unmade:
    def __init__(self):
        raise OSError


def test_a_model_that_cannot_be_made_is_no_error(spark):
    d = spark.createDataFrame([("a",), ("b",)], "t string")
    assert [(r["reply"], r["prompt_tokens"]) for r in provider.with_chat(d, "t", Unmade).collect()] == [("", 0)] * 2
    assert {tuple(r["embedding"]) for r in provider.with_embedding(d, "t", Unmade, dim=4).collect()} == {(0.0,) * 4}


def test_groups_without_evidence_are_not_sent(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    hits = spark.createDataFrame([("q", 0, "d", "s", None, None, None), ("q", 1, "e", "t", 1, "c1", "words")], "qid string, target_ord int, description string, semantic_query string, hit int, chunk_id string, text string")
    got = {r["description"]: r["compressed_text"] for r in agent.compress(hits, partial(Counting, str(tmp_path / "calls"))).collect()}
    assert got == {"d": agent.NEGATIVE, "e": "words"} and len(calls(tmp_path / "calls")) == 1
