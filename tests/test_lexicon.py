"""Cuts by a dictionary against brute force, and an index that is built with them."""

from __future__ import annotations

from math import log

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from longleaf.functions import text as T
from longleaf.operators import bm25, lexicon

SF = "/root/testdata/sf0.001"


def brute(run: str, counts: dict[str, int]) -> list[str]:
    """The best of all ways to cut a run, tried one by one."""
    total = log(max(1, sum(counts.values())))

    def ways(rest: str):
        if not rest:
            yield 0.0, []
        for k in range(len(rest), 0, -1):
            if k == 1 or rest[:k] in counts:
                for s, more in ways(rest[k:]):
                    yield log(counts.get(rest[:k], 1)) - total + s, [rest[:k], *more]

    best = max(round(s, 9) for s, _ in ways(run))
    path = max(([len(p) for p in w], w) for s, w in ways(run) if round(s, 9) == best)[1]
    out: list[str] = []
    before = False
    for p in path:
        unknown = len(p) == 1 and p not in counts
        if unknown and before:
            out[-1] += p
        else:
            out.append(p)
        before = unknown
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("abc中国人", min_size=1, max_size=8), st.dictionaries(st.text("abc中国人", min_size=1, max_size=4), st.integers(1, 50), max_size=12))
def test_the_path_is_the_best_of_all(run, counts):
    assert lexicon.Cutter(counts).path(run) == brute(run, counts)


def test_parts_of_words():
    c = lexicon.Cutter({"中华": 5, "华人": 4, "中华人民": 9, "人民": 7, "共和国": 3, "和国": 1})
    assert c("中华人民共和国") == ["中华", "华人", "人民", "中华人民", "和国", "共和国"]
    assert lexicon.Cutter({"ab": 2}, parts=False)("zzabyx") == ["zz", "ab", "yx"] and lexicon.Cutter({})("xyz") == ["xyz"]


def test_every_run_of_the_documents_is_cut_along_its_best_path(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lex = lexicon.Lexicon.fit(docs)
    counts = {r["word"]: r["n"] for r in lex.words.collect()}
    assert len(counts) > 100 and min(counts.values()) >= 3
    runs = docs.select(F.explode(T.terms(F.col("text"))).alias("run")).distinct()
    got = {r["run"]: r["words"] for r in runs.select("run", lex.cutter(parts=False)(F.array("run")).alias("words")).collect()}
    assert len(got) == runs.count() and all("".join(w) == r for r, w in got.items())
    short = [r for r in got if len(r) <= 12]
    assert len(short) > 1000 and all(got[r] == brute(r, counts) for r in short)


def test_terms_of_texts_and_an_index_of_them(spark):
    docs = spark.createDataFrame([(0, "d", "c0", "", "Dampf schiff dampf Schiff dampf schiff fahrt"), (1, "d", "c1", "", "Dampfschifffahrt"), (2, "d", "c2", "", None), (3, "d", "c3", "", "fahrt fahrt x")], "ord int, doc_id string, chunk_id string, header_path string, text string")
    lex = lexicon.Lexicon.fit(docs, least=3)
    tokens = lex.tokenizer()
    assert [r["t"] for r in docs.select(tokens(F.col("text")).alias("t")).collect()] == [["dampf", "schiff", "dampf", "schiff", "dampf", "schiff", "fahrt"], ["dampf", "schiff", "fahrt"], [], ["fahrt", "fahrt", "x"]]
    index = bm25.build(docs, tokens)
    t = spark.createDataFrame([("q", "schifffahrt")], "target string, query string")
    assert {r["ord"] for r in bm25.scores(index, t, tokens).collect()} == {0, 1, 3} and not bm25.scores(bm25.build(docs), t).count()
    assert [r["ord"] for r in bm25.search(index, t, 2, tokenizer=tokens).orderBy("rank").collect()] == [0, 1]
    assert docs.limit(0).select(tokens(F.col("text"))).count() == 0
