"""Partial top-k, inverted lists and the collection that uses them."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from longleaf import queries as Q
from longleaf.functions import text as T
from longleaf.operators import collection, dense, ivf


def vectors(spark, n=600, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) + 3 * (np.arange(n)[:, None] % 5 == np.arange(dim))
    rows = [(i, v.tolist(), f"t{i}") for i, v in enumerate(x / np.sqrt((x * x).sum(axis=1))[:, None])]
    return spark.createDataFrame(rows, "ord int, embedding array<float>, text string")


def hits(df, *names):
    return sorted(map(tuple, df.select(*(names or ("target", "ord", "score", "rank"))).collect()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6), st.integers(0, 50)), max_size=40), max_size=6), st.integers(1, 4))
def test_best_of_parts_is_the_best_of_all(parts, k):
    best = dense.Best(4, k)
    for p in parts:
        q, s, o = (np.array([x[i] for x in p], np.int64) for i in range(3))
        best.add(q, s / 2, pa.array(o))
        if len(p) % 3 == 0:
            best.cut()
    whole = best.cut()
    got = [] if whole is None else sorted(zip(whole["query"].to_pylist(), whole["score"].to_pylist(), whole["ord"].to_pylist(), strict=True))
    every = [(q, s / 2, o) for p in parts for q, s, o in p]
    assert got == sorted(x for n in range(4) for x in sorted((e for e in every if e[0] == n), key=lambda e: (-e[1], e[2]))[:k])


def test_a_task_gives_k_rows_of_a_query_at_most(spark, monkeypatch):
    monkeypatch.setattr(dense, "ROWS", 16)
    v = vectors(spark).repartition(3)
    q = v.where("ord < 7").select(F.col("ord").alias("target"), F.col("embedding").alias("q"))
    want = hits(dense.top_k(vectors(spark), q, 4))
    assert hits(dense.top_k(v, q, 4)) == want and len(want) == 28
    block = q.collect()
    assert dense._hits(v, block, pa.int32(), "target int, ord int, score double", 4).count() <= 7 * 4 * 3
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(200)], "ord int, embedding array<float>").repartition(4)
    one = spark.createDataFrame([("q", [0.5, 0.5])], "target string, q array<float>")
    assert [o for _, o, _ in hits(dense.top_k(same, one, 3), "target", "ord", "rank")] == [0, 1, 2]


def test_scores_are_rounded_as_columns_are(spark):
    x = np.array([0.1234565, -0.1234565, 1.0000004999, 0.0, -2.5e-7, 123.4567891])
    want = [r["y"] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(F.round("x", 6).alias("y")).collect()]
    assert np.allclose(dense.rounded(x), want, atol=1.1e-6) and dense.rounded(x)[2] == want[2] == 1.0


def test_lists_hold_every_row_and_searches_read_those_they_probe(spark, tmp_path):
    v = vectors(spark).unionByName(spark.createDataFrame([(1000, None, "none"), (1001, [1.0], "short"), (1002, [None] * 8, "nulls")], "ord int, embedding array<float>, text string"))
    v = v.unionByName(spark.range(2000, 2300).select(F.col("id").cast("int").alias("ord"), F.array(*[F.lit(1.0 if i == 1 else 0.0).cast("float") for i in range(8)]).alias("embedding"), F.lit("copy").alias("text")))
    centres = ivf.Centres.fit(v, 16, 20)
    path = str(tmp_path / "lists")
    ivf.write(v, centres, path)
    lists = spark.read.parquet(path)
    assert lists.count() == v.count() and {r["ord"] for r in lists.where("list = -1").collect()} == {1000, 1001, 1002}
    assert lists.where("ord >= 2000 and list >= 0").select("list").distinct().count() == 1
    q = v.where("ord % 100 = 0 and ord < 600").select(F.col("ord").alias("target"), F.col("embedding").alias("q"))
    exact = dense.top_k(v, q, 10)
    assert hits(ivf.search(lists, centres, q, 10, len(centres.points))) == hits(exact)
    r = ivf.recall(ivf.search(lists, centres, q, 10, 8), exact).head()
    assert (r["queries"], r["wanted"]) == (6, 60) and r["recall"] >= 0.9
    found = ivf.search(lists, centres, q.limit(1), 10, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    probed = {n for n, asked in enumerate(centres.probe(2)(np.array([q.head()["q"]], float))) if len(asked)}
    read = [{int(n) for n in m.split(",")} for m in re.findall(r"PartitionFilters: \[list#\d+ IN \(([-\d,]+)\)", plan)]
    assert len(probed) == 2 and read and all(x == probed | {-1} for x in read)
    centres.save(spark, str(tmp_path / "centres"))
    assert np.array_equal(ivf.Centres.load(spark, str(tmp_path / "centres")).points, centres.points)


def test_lists_of_few_or_no_vectors(spark, tmp_path):
    none = vectors(spark).limit(0)
    assert len(ivf.Centres.fit(none).points) == 0
    one = vectors(spark, 1)
    centres = ivf.Centres.fit(one, 4)
    assert len(centres.points) == 1
    ivf.write(one, centres, str(tmp_path / "x"))
    q = spark.createDataFrame([("q", [0.0] * 8), ("r", None)], "target string, q array<float>")
    assert hits(ivf.search(spark.read.parquet(str(tmp_path / "x")), centres, q, 3)) == [("q", 0, 0.0, 1)]


def test_a_collection_with_an_index(spark, tmp_path):
    v = vectors(spark, 300).select(F.col("ord").cast("string").alias("id"), "text", F.col("embedding").alias("dense"), F.create_map(F.col("ord") % 7, F.lit(1.0).cast("float")).alias("sparse"))
    c = collection.Collection(spark, str(tmp_path / "c")).create()
    c.insert(v.where("cast(id as int) < 200"))
    q = v.where("id in ('5', '250')").select(F.col("id").alias("target"), F.col("dense").alias("q"), "sparse")
    sparse = q.select("target", F.col("sparse").alias("q"))
    before = hits(c.dense_search(q.select("target", "q"), 5), "target", "id", "score", "rank"), hits(c.sparse_search(sparse, 5), "target", "id", "score", "rank")
    c.create_index(8, 100)
    assert (hits(c.dense_search(q.select("target", "q"), 5, 8), "target", "id", "score", "rank"), hits(c.sparse_search(sparse, 5), "target", "id", "score", "rank")) == before
    c.insert(v.where("cast(id as int) >= 200"))
    assert c.count() == 300 and c.create(drop=False).count() == 300
    assert hits(c.dense_search(q.select("target", "q"), 1, 8), "target", "id") == [("250", "250"), ("5", "5")]
    (tmp_path / "c" / "version=2").mkdir()
    assert c.count() == 300  # a build that was stopped is no version
    c.create_index(4, 100)
    assert c.count() == 300 and len(c._centres().points) == 4
    assert collection.Collection(spark, str(tmp_path / "c")).create().count() == 0


def test_a_vector_is_worked_out_once_to_be_scaled(spark):
    """Its expression was worked out again for each component."""
    d = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    scaled = d.select(T.unit_vector(F.transform("v", lambda x: x * 7919)).alias("u"))
    assert [r["u"] for r in scaled.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert scaled._jdf.queryExecution().optimizedPlan().toString().count("7919") == 1


def test_letters_are_counted(spark):
    d = spark.createDataFrame([(0, "Abéa z"), (1, ""), (2, None)], "k int, c string")
    assert [r["n"] for r in d.orderBy("k").select(Q.letter_counts(F.lower("c"), "abz").alias("n")).collect()] == [[2.0, 1.0, 1.0], [0.0] * 3, None]
