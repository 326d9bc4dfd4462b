"""Search by a lexicon without an index: its terms are counted where texts are cut, and its results are those of an index."""

from __future__ import annotations

import pyarrow as pa

from longleaf import queries
from longleaf.operators import bm25, lexicon

SF = "/root/testdata/sf0.001"


def test_the_query_makes_no_index_and_equals_one(spark, monkeypatch):
    docs, chunks, asked = queries.table(spark, SF, "documents"), queries.corpus(spark, SF), queries.targets(spark, SF)
    terms = lexicon.Lexicon.fit(docs).tokenizer()
    slow = bm25.search(bm25.build(chunks, terms), asked, 10, enhanced=False, tokenizer=terms)
    want = sorted(map(tuple, slow.select("target", "ord", "score", "rank").collect()))
    monkeypatch.setattr(bm25, "build", None)
    assert len(want) > 100 and sorted(map(tuple, queries.lexicon_topk(spark, SF).collect())) == want


def test_rounds_limits_and_texts_without_terms(spark, monkeypatch):
    texts = ["Dampf schiff dampf Schiff dampf schiff fahrt", "Dampfschifffahrt", None, "", "fahrt fahrt x", "- ."] * 5
    chunks = spark.createDataFrame([(n, "d", f"c{n}", "", t) for n, t in enumerate(texts)], "ord int, doc_id string, chunk_id string, header_path string, text string")
    targets = spark.createDataFrame([("q", "schifffahrt"), ("r", "x fahrt x"), ("s", None), ("q", "dampf"), ("t", "unheard"), (None, "x")], "target string, query string")
    lex = lexicon.Lexicon.fit(chunks)
    terms = lex.tokenizer()
    slow = bm25.search(bm25.build(chunks, terms), targets, 7, enhanced=False, tokenizer=terms)
    want = sorted(map(tuple, slow.select("target", "ord", "score", "rank").collect()), key=str)
    assert {r[0] for r in want} == {"q", "r", None} and len(want) == 7 + 7 + 5
    for limits in ({}, {"TARGETS": 1}, {"CELLS": 1}, {"SENT": 1}):
        with monkeypatch.context() as m:
            for name, n in limits.items():
                m.setattr(bm25, name, n)
            assert sorted(map(tuple, lex.search(chunks, targets, 7).collect()), key=str) == want, limits
    assert not lex.search(chunks.limit(0), targets, 7).count() and not lex.search(chunks, targets.limit(0), 7).count()


def test_counts_are_those_of_the_terms(monkeypatch):
    words = {"ab": 9, "abc": 5, "bc": 4, "cd": 7, "abcd": 3}
    asked = ["ab", "bc", "cd", "zz", "abc"]
    texts = [["abcd", "ab", "abzzcd"], None, [], ["zz", "abc", "abc"]] * 3
    cutter = lexicon.Cutter(words)
    every = [[t for r in x or () for t in cutter.terms(r)] for x in texts]
    for kept in (1, 100):
        monkeypatch.setattr(lexicon, "KEPT", kept)
        n, t, tf = lexicon.Counter(cutter, {w: k for k, w in enumerate(asked)}).counted(pa.array(texts, pa.list_(pa.string())))
        assert n.to_pylist() == [len(e) for e in every]
        assert [dict(zip(a, b, strict=True)) for a, b in zip(t.to_pylist(), tf.to_pylist(), strict=True)] == [{k: e.count(w) for k, w in enumerate(asked) if w in e} for e in every]


def test_no_row_is_made_for_a_term_of_a_text(spark):
    lex = lexicon.Lexicon(spark.createDataFrame([("ab", 5), ("cd", 5)], "word string, n long"))
    got = lex.counted(spark.createDataFrame([(1, "abcd ab")], "ord int, text string"), ["ab", "x"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    assert [tuple(r) for r in got.collect()] == [(1, 3, [0], [2])]
