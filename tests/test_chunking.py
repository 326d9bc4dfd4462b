from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from longleaf.operators import chunking as C
from longleaf.operators import tables as B


def test_sections_get_the_path_of_their_ancestors():
    text = "# 第一章 总则\n" + "总则内容很多字。" * 60 + "\n## 第一节 目的\n" + "目的内容很多字。" * 60 + "\n# 第二章 附则\n" + "附则内容很多字。" * 60
    got = C.markdown_chunks(text)
    assert [p for p, *_ in got] == ["第一章 总则", "第一章 总则 > 第一节 目的", "第二章 附则"]


def test_short_peers_merge_and_stand_for_their_parent():
    text = "# 第一章 总则\n正文正文正文正文正文。\n## 第一条 甲\n甲的内容甲的内容甲的内容。\n## 第二条 乙\n乙的内容乙的内容乙的内容。"
    got = C.markdown_chunks(text)
    assert len(got) == 1 and got[0][0] == "第一章 总则"
    assert all(w in got[0][1] for w in ("正文", "甲的内容", "乙的内容"))


def test_text_before_the_first_heading_is_kept_unless_asked():
    text = "序言文字序言文字序言文字。\n# 一、标题\n内容内容内容内容内容内容。"
    assert any("序言" in c for _, c, *_ in C.markdown_chunks(text))
    assert not any("序言" in c for _, c, *_ in C.markdown_chunks(text, preamble=False))


def test_convention():
    assert C.convention_of(["1 Scope", "1.1 General", "2 Rules"]) == "B"
    assert C.convention_of(["第一章 总则", "1 a", "2 b", "3 c"]) == "A"
    assert C.convention_of(["1 a", "一、b", "3 c"]) == "A"


def test_articles():
    assert [c[:2] for c in C.article_chunks("前文\n第一条 甲\n 内容\n第二条 乙")] == [("", "\n前文"), ("第一条 甲", "第一条 甲\n内容"), ("第二条 乙", "第二条 乙\n")]
    long = C.article_chunks("第一条 甲\n" + "内容很长的一句。" * 150 + "\n" + "第二段。" * 100)
    assert len(long) > 2 and {p for p, *_ in long} == {"第一条 甲"} and not any("甲" in c for _, c, *_ in long)


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="ab 。；\n中", min_size=1, max_size=4000))
def test_long_texts_are_cut_without_loss(text):
    assert "".join("".join(C.cut_long(text, 50)).split()) == "".join(text.split())


@settings(deadline=None, max_examples=40)
@given(st.lists(st.text(alphabet="abc中", min_size=1, max_size=600), max_size=12))
def test_packing_loses_nothing_and_keeps_limits(parts):
    got = [t for t, _ in C.pack(parts, 100, 400)]
    assert "\n\n".join(got) == "\n\n".join(parts)
    assert all(B.tokens(g) <= 400 + 8 * len(parts) or g in parts for g in got)


def test_secondary_split():
    assert C.split_parts("短") == ["短"]
    got = C.split_parts("句子内容。" * 200)
    assert len(got) > 1 and "".join(got) == "句子内容。" * 200
    hard = C.split_parts("x" * 1500)
    assert len(hard) > 2 and all(len(p) <= 600 for p in hard[:-1])


def test_tables():
    md = B.rows_to_markdown("<table><tr><td colspan=2>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>")
    assert md == "| a | a | b |\n| --- | --- | --- |\n| 1 | 2 |  |"
    header, rows = B.parse(md)
    assert header == ["a", "a", "b"] and rows == [["1", "2"]]
    tall = B.build(["k", "v"], [[str(i), "内容" * 20] for i in range(40)])
    parts = B.split_tall(tall, 200)
    assert len(parts) > 1 and all(B.tokens(p) <= 200 and p.startswith("| k | v |") for p in parts)
    wide = B.build([f"c{i}" for i in range(9)], [["x" * 300] * 9])
    parts = B.split_tall(wide, 150)
    assert parts[0].startswith("[表 1]") and all(B.tokens(p) <= 160 for p in parts)


def test_chunk_numbers_are_dense(spark):
    docs = spark.createDataFrame([("d", "# 一、甲\n" + "内容。" * 300), ("e", None), ("f", "")], "doc_id string, text string")
    rows = C.chunk_markdown(docs).collect()
    assert [r["chunk_no"] for r in rows] == list(range(1, len(rows) + 1)) and {r["doc_id"] for r in rows} == {"d"}
    split = C.split_long(C.chunk_headers(docs)).collect()
    assert all(r["tokens"] > 0 for r in split)


def test_parts_of_tables():
    one = B.build(["k", "v"], [["a", "x" * 40], ["b", "y" * 40]])
    assert B.split_tall(one, 400) == [one]
    assert B.split_tall("| only a header |", 3) == ["| ", "on", "ly", " a", " h", "ea", "de", "r ", "|"]
    rows = B.build(["k", "v"], [[str(i), "z" * 80] for i in range(6)])
    assert [len(B.parse(p)[1]) for p in B.split_tall(rows, 60)] == [2, 2, 2]
    wide = B.build([f"c{i}" for i in range(9)], [["x" * 100] * 9])
    parts = B.split_wide(wide, 150)
    assert [p.split("\n")[0] for p in parts] == ["[表 1]", "[表 2]"] and [len(B.parse(p)[0]) for p in parts] == [5, 5]
    assert B.split_wide(B.build(["a", "b", "c"], [["1", "2", "3"]]), 100) == [B.build(["a", "b", "c"], [["1", "2", "3"]])]


def test_cells_are_cut_in_the_line_that_passes_the_limit():
    t = B.build(["k"], [["a" * 300], ["b" * 400], ["c" * 400]])
    assert B.cut_cells(t, 10_000) == t
    got = B.cut_cells(t, 150).split("\n")
    assert got[2] == "| " + "a" * 300 + " |" and got[3].count("b") == 200 and "..." in got[3] and len(got) == 4


def test_levels_follow_the_outline():
    text = "# 第一章 甲\n## x\n## y\n# 附件\n## 一、乙\n##  \n### 第二章 丙"
    assert C.normalized(text) == "# 第一章 甲\n## x\n## y\n### 附件\n## 一、乙\n##  \n# 第二章 丙"
