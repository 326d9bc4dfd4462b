"""An index by segments against one that is built anew."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from longleaf.operators import bm25, segments


@pytest.fixture(scope="module")
def many(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.lit("w"), F.pmod(F.col("id") * 31 + i * i * 7, F.lit(97)).cast("string")))
    return spark.range(300).select(F.col("id").alias("ord"), F.lit("d").alias("doc_id"), F.col("id").cast("string").alias("chunk_id"), F.lit("").alias("header_path"), F.array_join(words, " ").alias("text"))


def same(spark, index: bm25.Index, chunks) -> None:
    fresh = bm25.build(chunks)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    for name, columns in (("chunks", ("ord", "text", "n_terms")), ("postings", ("term", "ord", "tf", "n_terms")), ("vocabulary", ("term", "df", F.round("idf", 12))), ("corpus", ("n_chunks", F.round("avg_terms", 12)))):
        assert rows(getattr(index, name), *columns) == rows(getattr(fresh, name), *columns), name
    t = spark.createDataFrame([("a", "w3 w40 w3"), ("b", "w7"), ("c", "w96 w1 new")], "target string, query string")
    scored = lambda i: rows(bm25.search(i, t, 20).select("target", "ord", "score", "rank"), "*")
    assert scored(index) == scored(fresh)


def test_additions_removals_and_compaction_equal_a_fresh_build(spark, many, tmp_path):
    s = segments.Segments(spark, str(tmp_path / "s"), slots=2)
    with pytest.raises(ValueError):
        s.index()
    s.remove(many.select("ord"))  # of nothing
    for k in range(3):
        s.add(many.where(F.col("ord") % 3 == k))
    same(spark, s.index(), many)
    s.remove(many.where("ord % 5 = 0").select("ord"))
    s.remove(spark.createDataFrame([(10_000,), (None,), (0,)], "ord long"))
    left = many.where("ord % 5 <> 0")
    same(spark, s.index(), left)
    changed = many.where("ord between 50 and 60").withColumn("text", F.concat("text", F.lit(" new words")))
    s.add(changed)
    now = left.where("not ord between 50 and 60").unionByName(changed)
    same(spark, s.index(), now)
    s.compact()
    assert [kind for _, kind in s._changes()] == ["whole"]
    same(spark, s.index(), now)
    s.remove(many.where("ord = 7").select("ord"))
    s.add(many.where("ord in (5, 10)"))
    same(spark, segments.Segments(spark, str(tmp_path / "s"), slots=2).index(), now.where("ord <> 7").unionByName(many.where("ord in (5, 10)")).where("ord <> 0"))


def test_a_stopped_change_is_none(spark, many, tmp_path):
    s = segments.Segments(spark, str(tmp_path / "s"))
    s.add(many.where("ord < 10"))
    many.where("ord < 20").write.parquet(str(tmp_path / "s" / "00000002-add" / "chunks"))
    same(spark, s.index(), many.where("ord < 10"))
    s.add(many.where("ord between 10 and 12"))
    same(spark, s.index(), many.where("ord < 13"))
    s.remove(many.select("ord"))
    assert s.index().info().head()["n_chunks"] == 0
