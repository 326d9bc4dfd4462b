"""Queries of rules, of both indexes and of streams against their SQL twins, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [
    "heading_rank", "heading_path", "simple_headings", "rich_headings", "section_rows", "section_trees", "furniture_lines", "weak_titles", "chinese_numerals", "dotted_prefixes", "merge_short", "html_table", "empty_chunk_cases", "json_replies",
    "numeric_intent", "calculations", "prompt_routes", "plan_flatten", "answer_format", "answer_slots", "upload_results", "chunk_markdown_cases", "chunk_headers_cases", "chunk_articles_cases", "chunk_split_cases", "split_figures", "chunk_document_sql", "answer_cases",
    "collection_dense", "collection_recall", "segments_topk", "bm25_bounded_topk", "bm25_filtered_prefix", "hybrid_topk", "answer_trace", "event_sessions", "conversion_states",
]


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_a_query_equals_its_twin(spark, tables, name):
    got = entry.queries()[name](spark, SF)
    want = tables.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_annexes_at_the_limit_equal_their_twin(spark, tmp_path):
    """A title of two Chinese characters over 1,580 letters or so: by length alone it is at the limit, as mixed text beyond it."""
    d = spark.createDataFrame([(k, "x" * n) for k, n in enumerate(range(1570, 1600))], "doc_id long, text string")
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["chunk_markdown_cases"](spark, str(tmp_path)).select("doc_id", "header_path", "chunks").collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, got)) == sorted(c.execute(entry.oracle_sql()["chunk_markdown_cases"]).fetchall())
    assert {r["chunks"] for r in got} == {1, 2}
