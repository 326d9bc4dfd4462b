from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from longleaf.functions import headings as H
from longleaf.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("text,value", [("十", 10), ("二十一", 21), ("一百二十三", 123), ("一百零五", 105), ("none", None), ("", None)])
def test_chinese_number(spark, text, value):
    assert one(spark, T.chinese_number(F.col("t")), t=text) == value


@pytest.mark.parametrize("text,value", [("", 1), ("abcd", 2), ("中文字", 2), ("中文abcd", 3)])
def test_tokens_mixed(spark, text, value):
    assert one(spark, T.tokens_mixed(F.col("t")), t=text) == value


@pytest.mark.parametrize("text,grams", [("", []), ("a", ["a"]), ("a b", ["ab", "a", "b"]), ("aa", ["aa", "a"]), ("中文 字", ["中文", "文字", "中", "文", "字"])])
def test_char_grams(spark, text, grams):
    assert one(spark, T.char_grams(F.col("t")), t=text) == grams


def test_terms(spark):
    assert one(spark, T.terms(F.col("t")), t="A-b a, 中文1") == ["a", "b", "a", "中文1"]
    assert one(spark, T.terms_cjk(F.col("t")), t="中文字 ab") == ["中文", "文字", "ab"]


def test_sentences_keep_their_marks(spark):
    assert one(spark, T.sentences(F.col("t")), t="一。二； 三") == ["一。", "二；", "三"]


def test_html_lines(spark):
    assert one(spark, T.html_lines(F.col("t")), t="<style>x</style><!-- c --><p>a&nbsp;&lt;b&amp;</p>&#65;") == ["a <b", "&#65;"]


@pytest.mark.parametrize("text,found", [('{"a":1}', 1), ('x ```json\n{"a":1}\n``` y', 1), ("<thinking>{}</thinking>{\"a\":1}", 1), ('{"a":1} {"a":2}', None), ("none", None)])
def test_json_value(spark, text, found):
    assert one(spark, F.try_variant_get(T.json_value(F.col("t")), "$.a", "int"), t=text) == found


def test_query_text_falls_back_to_the_question(spark):
    assert one(spark, T.query_text(F.col("k"), F.col("q")), k="a|b", q="z") == "a b"
    assert one(spark, T.query_text(F.col("k"), F.col("q")), k=" | ", q="z") == "z"


def test_empty_chunk(spark):
    no = F.array().cast("array<string>")
    assert one(spark, T.is_empty_chunk(F.col("t"), no), t="不适用") is True
    assert one(spark, T.is_empty_chunk(F.col("t"), no), t="| a | b |\n| --- | --- |") is False
    assert one(spark, T.is_empty_chunk(F.col("t"), no), t="| a | b |") is True
    assert one(spark, T.is_empty_chunk(F.col("t"), no), t="□ 适用 □ 不适用 本期无变化") is True
    assert one(spark, T.is_empty_chunk(F.col("t"), no), t="本条款适用于全部投保人员和受益人") is False
    assert one(spark, T.is_empty_chunk(F.col("t"), no), t="第一章 总则 ..... 1\n第二章 附则 ..... 9") is True


def test_packing_keeps_order_and_limit(spark):
    got = one(spark, T.packed(F.col("t"), 6, glue="|"), t=["aaaa", "bbbb", "cccc", "d" * 60, "e"])
    assert got == ["aaaa|bbbb|cccc", "d" * 60, "e"]


def test_weak_titles_and_markdown_headings(spark):
    assert one(spark, T.is_weak_title(F.col("t")), t="目　录")
    assert tuple(one(spark, T.markdown_heading(F.col("t")), t="##  Title ")) == (2, "Title")
    assert one(spark, T.markdown_heading(F.col("t")), t="## ") is None


def test_paths_equal_a_stack(spark):
    import random

    rng = random.Random(3)
    rows = [("d", i, rng.randint(1, 12), f"t{i}") for i in range(300)]
    h = spark.createDataFrame(rows, "doc_id string, ord int, rank int, title string")
    got = {r["ord"]: r["path"] for r in H.paths(h).collect()}
    for block in (1, 7, 100):
        assert {r["ord"]: r["path"] for r in H.paths(h, block=block).collect()} == got
    stack: list[tuple[int, str]] = []
    for _, i, rank, title in rows:
        while stack and stack[-1][0] >= rank:
            stack.pop()
        stack.append((rank, title))
        assert got[i] == " > ".join(t for _, t in stack)


def test_visual_lines_and_body_size(spark):
    w = spark.createDataFrame([("d", 1, "b", 10.0, 5.0, 9.0), ("d", 1, "a", 10.2, 1.0, 9.0), ("d", 1, "T", 40.0, 1.0, 12.0)], "doc_id string, page int, text string, top double, x0 double, size double")
    assert [(r["line"], r["size"]) for r in H.visual_lines(w).orderBy("row").collect()] == [("ab", 9.0), ("T", 12.0)]
    assert H.body_size(w).head()["body"] == 9.0
