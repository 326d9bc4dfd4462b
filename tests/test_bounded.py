"""Search by bounds against the full search."""

from __future__ import annotations

from pyspark.sql import functions as F

from longleaf.operators import bm25, bounded


def rows(df):
    return sorted(map(tuple, df.select("target", "ord", "score", "rank").collect()))


def test_bounds_change_no_hit_and_leave_ranges_unread(spark, tmp_path):
    topic = F.floor(F.col("id") / 50)
    word = lambda i: F.concat(F.lit("t"), topic.cast("string"), F.lit("w"), F.pmod(F.col("id") * 7 + i * i, F.lit(9)).cast("string"))
    text = F.array_join(F.concat(F.array_repeat(F.lit("every"), 2), F.transform(F.sequence(F.lit(0), F.pmod("id", F.lit(13)).cast("int") + 3), word)), " ")
    chunks = spark.range(1000).select(F.col("id").alias("ord"), F.format_string("d%03d", topic).alias("doc_id"), F.col("id").cast("string").alias("chunk_id"), F.lit("").alias("header_path"), text.alias("text"))
    index = bm25.build(chunks)
    made = bounded.Blocks.ensure(index, str(tmp_path / "b"), 50)
    assert 15 <= made.blocks.select("range").distinct().count() <= 20
    t = spark.createDataFrame([("a", "every t3w1 t3w2"), ("b", "every"), ("c", "t7w0 t12w3 t12w3"), ("d", "none"), ("e", ""), ("f", "t3w1 t7w2 t9w5 t15w1")], "target string, query string")
    want = rows(bm25.search(index, t, 5, enhanced=False))
    assert len(want) == 20 and rows(made.search(t, 5)) == want
    assert rows(made.search(t, 5, first=1)) == want and rows(made.search(t, 400)) == rows(bm25.search(index, t, 400, enhanced=False))
    share = made.share(t.where("target = 'a'"), 5).head()
    assert share["ranges"] == made.blocks.select("range").distinct().count() and share["read"] <= 4 and share["postings_read"] < share["postings"] / 3
    again = bounded.Blocks.ensure(index, str(tmp_path / "b"), 7)
    assert again.blocks.count() == made.blocks.count()
    none = bm25.build(chunks.limit(0))
    assert rows(bounded.Blocks.ensure(none, str(tmp_path / "n")).search(t)) == []
