"""Literal cases of rules: headings, trees, chunkers, tables, replies, formulas and answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from longleaf.functions import headings as H
from longleaf.functions import text as T
from longleaf.operators import chunking, tables
from longleaf.plans import agent, report
from longleaf.sources import files

FURNITURE = [("12", True), (" 1234 ", True), ("12345", False), ("3 / 10", True), ("3/10 页", False), ("请务必阅读正文之后的免责条款部分", True), ("请扫描以查询验证条款", True), ("敬请参阅最后一页特别声明", False), ("请务必阅读声明", False), ("正文", False)]
WEAK = [("目 录", True), ("目　录", True), ("附录", False), ("附件一", True), ("摘要", True), ("前言", False), ("说明", False), ("TOC", True), ("Abstract", True), ("Executive Summary", True), ("Contents", False), ("GLOSSARY", True), ("Declaration", True), ("注释", False), ("参考文献", False), ("备查文件目录", True)]
#: Document, order, title, convention of the document, rank there.
HEADINGS = [
    ("a", 0, "第一章 总则", "A", 1), ("a", 1, "第一节 目的", "A", 2), ("a", 2, "第三条 范围", "A", 3), ("a", 3, "一、定义", "A", 4), ("a", 4, "（一）术语", "A", 5), ("a", 5, "（1）单位", "A", 7), ("a", 6, "第二章 附则", "A", 1), ("a", 7, "补充", "A", None),
    ("a", 8, "百一、不是", "A", None), ("a", 9, "第 三 章 空格", "A", None), ("a", 10, "(1）混合", "A", None), ("a", 11, "(2)半角", "A", 7), ("a", 12, "1.2.3.4 深", "A", 9), ("a", 13, "十）括", "A", 4), ("a", 14, "3）旁", "A", 7),
    ("b", 0, "1 Scope", "B", 4), ("b", 1, "1.1 General", "B", 5), ("b", 2, "1.1.1 Terms", "B", 6), ("b", 3, "2 Rules", "B", 4), ("b", 4, "2.1.3.4 Deep", "B", 7), ("b", 5, "3）旁注", "B", 9), ("b", 6, "12、其他", "B", 8), ("b", 7, "一、中文", "B", 10), ("b", 8, "（二）内", "B", 11), ("b", 9, "（3）里", "B", 12),
    ("c", 0, "前言", "A", None), ("c", 1, "二十一、结语", "A", 4), ("d", 0, "1 a", "A", 6), ("d", 1, "2 b", "A", 6), ("e", 0, "1. x", "A", 6), ("e", 1, "一、y", "A", 4), ("e", 2, "2. z", "A", 6), ("e", 3, "3. w", "A", 6),
]
SIMPLE = [("第一章 总则", 1), ("第十条 范围", 1), ("第 12 条 范围", 1), ("第一编 甲", None), ("( 一 ) 甲", 2), ("（一）甲", None), ("1.2.3 甲", 3), ("1.2 乙", 3), ("1.2 3", None), ("A. Scope", 4), ("A.Scope", None), ("一、甲", None), ("正文", None)]
#: A line, its font size, the body's size, and the level and title that a rich heading has.
RICH = [
    ("1. 总体要求", 12.0, 10.0, 1, "总体要求"), ("1. 总体要求", 11.0, 10.0, None, None), ("1. 总体要求", 10.0, 10.0, 1, "总体要求"), ("1.1. 适用范围", 10.9, 10.0, 2, "适用范围"), ("1.1.1. 适用对象", 10.0, 10.0, 2, "1. 适用对象"), ("第一章 总则总则", 12.0, 10.0, 1, "总则总则"),
    ("第二条、范围说明", 10.0, 10.0, 2, "范围说明"), ("第一类：高风险", 10.0, 10.0, 3, "高风险"), ("一、概述内容", 10.0, 10.0, 1, "概述内容"), ("（一）概述内容", 10.0, 10.0, 3, "概述内容"), ("（1）列表内容", 10.0, 10.0, None, None), ("1、列表内容", 10.0, 10.0, None, None), ("a. listed", 10.0, 10.0, None, None),
    ("一、短", 10.0, 10.0, None, None), ("正文内容没有编号", 14.0, 10.0, None, None), ("", 10.0, 10.0, None, None),
]
TREE_LINES = [("d", 0, "序言"), ("d", 1, "一、总体概述"), ("d", 2, "甲"), ("d", 3, "（一）适用范围"), ("d", 4, "乙"), ("d", 5, "丙"), ("d", 6, "二、附则内容"), ("e", 0, "只有\"引号\"")]
TREE_ROWS = [("d", 0, "文档", "文档", 0, "序言\n"), ("d", 1, "文档 > 总体概述", "总体概述", 1, "甲\n"), ("d", 2, "文档 > 总体概述 > 适用范围", "适用范围", 3, "乙\n丙\n"), ("d", 3, "文档 > 附则内容", "附则内容", 1, ""), ("e", 0, "文档", "文档", 0, "只有\"引号\"\n")]
TREES = [
    ("d", 4, '[{"level": 0, "title": "文档", "content": "序言\\n", "children": [{"level": 1, "title": "总体概述", "content": "甲\\n", "children": [{"level": 3, "title": "适用范围", "content": "乙\\n丙\\n", "children": []}]}, {"level": 1, "title": "附则内容", "content": "", "children": []}]}]'),
    ("e", 1, '[{"level": 0, "title": "文档", "content": "只有\\"引号\\"\\n", "children": []}]'),
]
NUMERALS = [("十", 10), ("二十一", 21), ("一百二十三", 123), ("一百零五", 105), ("第三十条", 30), ("两千零一十", 1010), ("零", 0), ("none", None)]
PREFIXES = [("1.2.3. 标题", "1.2.3", 3), ("1.2 标题", "1.2", 2), ("12、其他", "12", 12), ("标题", "", None), ("第3条", "", 3)]
SHORT = [("a", "短", "长" * 300, "短|" + "长" * 300), ("b", "长" * 300, "短", "长" * 300 + "/短"), ("c", "长" * 700, "短", "长" * 700 + "/短"), ("d", "长" * 720, "短", "长" * 720 + "|短")]
TABLES = [("<table><tr><th colspan=2>A</th><th>B</th></tr><tr><td>1</td><td>2 <b>x</b></td><td>3</td></tr></table>", "| A | A | B |\n| --- | --- | --- |\n| 1 | 2 x | 3 |"), ("<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>", "| a |  |\n| --- | --- |\n| b | c |"), ("<p>none</p>", None)]
EMPTY = [("不适用", True), ("□ 适用 □ 不适用 无变化的情况", True), ("本条款适用于全部投保人员和受益人", False), ("| a | b |", True), ("| a | b |\n| --- | --- |", False), ("第一章 总则 ..... 1\n第二章 附则 ..... 9", True), ("第一章 总则 …… 1\n第二章 附则 …… 9", False), ("☑ 适用的全部说明内容文字", False), ("无。无．", True), ("a" * 9, True), ("a" * 10, False)]
REPLY_VALUES = [('{"a":1}', "1"), ('{"a":1} {"a":2}', None), ('x ```python\n{"a":2}\n``` y', "2"), ('<thinking>{"a":9}</thinking> {"a":3}', "3"), ('say {"a":4} done', "4"), ('{"a":5', None), ("", None), ('{"a":"x } y"}', "x } y"), ('{"a":6}]', "6"), ('{"a":7},{"a":8}', None)]
#: Type, format, question, an option, evidence, and whether it is to be calculated.
NUMERIC = [
    ("计算题", "mcq", "问", "答", "", True), ("单选题", "mcq", "金额 3 元是否超过", "是", "", True), ("单选题", "mcq", "金额是否超过", "是", "", False), ("单选题", "mcq", "共 3 项", "增长 金额", "", False), ("多选题", "multi", "问", "至少 5 份", "", True), ("多选题", "multi", "问", "答", "以内 30 天", True),
    ("判断题", "tf", "3 元超过 2 元", "", "", False), ("单选题", None, "3 年以上", "", "", True), ("问答", "free", "3 年以上", "", "", False),
]
FORMULAS = [("result = 1e8 * 0.01 + max(2, 3)", "result = 1000003.0"), ("a = 3\nb = a ** 2\nresults = {'A': b > 8, 'B': b / 2}", "results = {'A': True, 'B': 4.5}"), ("import os", "failed: not an assignment: Import"), ("x = open('f')", "failed: not allowed: Call"), ("result = 1 / 0", "failed: float division by zero"), ("x = 1", "failed: no result"), ("result = 9 ** 9 ** 9", "failed: not allowed: BinOp"), ("3 + 4", "result = 7.0")]
ROUTES = [("计算题", "mcq", "calc"), ("单选题", "mcq", "mcq"), ("多选题", "multi", "multi"), ("判断题", "tf", "tf"), ("其他", "free", "mcq"), (None, None, "mcq")]
REPLIES = [
    ("q1", '{"retrieval_plan":[{"round":1,"description":"d","semantic_query":"s","keywords":"k","doc_ids":["x","y"]},{"round":2,"semantic_query":"t","doc_id":"z, w"}]}'),
    ("q2", 'text before ```json\n{"retrieval_plan":[{"semantic_query":"u","doc_id":"v"}]}\n``` and after'),
    ("q3", '{"retrieval_plan":[]}'),
    ("q4", "no json"),
    ("q5", '{"retrieval_plan":[{"semantic_query":"","doc_id":"v"}]}'),
    ("q6", '{"a":1} {"b":2}'),
]
FLAT = [("q1", 0, 1, "s", "x,y"), ("q1", 1, 2, "t", "z,w"), ("q2", 0, 1, "u", "v")]
ANSWERS = [("A,C", "multi", "AC"), ("D,B,B", "multi", "BD"), ("B", "tf", "B"), ("A", "tf", "A"), ("C,A", "mcq", "C"), ("", "mcq", ""), ("AB", "tf", "B"), ("AB,D", "multi", "ABD")]
SLOTS = [("ACD", "多选题", "ACD", "", "", "", ""), ("12.34%；56.78%", "计算题", "12.34%", "56.78%", "", "", ""), ("a,b,c,d,e", "计算题", "a", "b", "c", "d；e", ""), ("", "单选题", "", "", "", "", "empty answer,not a choice"), (" AB ", "mcq", "AB", "", "", "", ""), ("12%；", "计算题", "12%；", "", "", "", ""), ("甲 乙", "free", "甲", "乙", "", "", ""), ("甲", "单选题", "甲", "", "", "", "not a choice")]
UPLOADS = [("d1", "/raw/a/x.pdf"), ("d2", "/raw/b/y.html")]
RESULTS = [("x.pdf", "d1"), ("y.html", "d2"), ("z.pdf", "z.pdf")]
#: Documents of both conventions, with a table, an image, weak and plain headings, and a gap in the numbers.
CHUNK_DOCS = [
    ("A", "# 第一章 总则\n正文正文正文正文正文。\n## 第一条 甲\n甲的内容甲的内容甲的内容。\n## 第二条 乙\n乙的内容乙的内容乙的内容。\n## 附件一\n附件的内容附件的内容。\n# 第三章 表\n\n| 项 | 值 |\n| --- | --- |\n| 一 | 1 |\n\n![图](a.png)\n\n表后的文字内容文字内容。"),
    ("B", "# 1 Scope\nThis part is the scope of it all.\n# 1.1 General\nGeneral words stand here in full.\n# 1.2 Terms\nTerms and words that are used below.\n# 2 Rules\nRules that hold for everybody here."),
    ("C", "# Foreword\nSome plain words to begin with.\n# Thanks\nSome plain words of thanks to all.\n# 一、正题\n不适用\n# 二、后续\n后续的内容后续的内容后续的内容。\n# 四、跳号\n跳号的内容跳号的内容跳号的内容。"),
]
CHUNK_ROWS = [
    ("A", 1, "第一章 总则", "第一章 总则\n正文正文正文正文正文。\n\n第一条 甲\n甲的内容甲的内容甲的内容。\n\n第二条 乙\n乙的内容乙的内容乙的内容。", 30, ""),
    ("A", 2, "附件一", "附件一\n附件的内容附件的内容。", 8, ""),
    ("A", 3, "第三章 表", "第三章 表\n\n| 项 | 值 |\n| --- | --- |\n| 一 | 1 |\n\n表后的文字内容文字内容。", 20, "![图](a.png)"),
    ("B", 1, "1 + 2", "1 Scope\nThis part is the scope of it all.\n\n1.1 General\nGeneral words stand here in full.\n\n1.2 Terms\nTerms and words that are used below.\n\n2 Rules\nRules that hold for everybody here.", 46, ""),
    ("C", 1, "", "Foreword\n\nForeword\nSome plain words to begin with.\n\nThanks\nSome plain words of thanks to all.", 24, ""),
    ("C", 2, "一、正题 + 二、后续", "一、正题\n不适用\n\n二、后续\n后续的内容后续的内容后续的内容。", 16, ""),
    ("C", 3, "四、跳号", "四、跳号\n跳号的内容跳号的内容跳号的内容。", 11, ""),
]
HEADER_ROWS = [
    ("A", 1, "第一章 总则", "# 第一章 总则\n正文正文正文正文正文。", 10, ""),
    ("A", 2, "第一章 总则 > 第一条 甲", "## 第一条 甲\n甲的内容甲的内容甲的内容。", 11, ""),
    ("A", 3, "第一章 总则 > 第二条 乙", "## 第二条 乙\n乙的内容乙的内容乙的内容。", 11, ""),
    ("A", 4, "第一章 总则 > 第二条 乙 > 附件一", "### 附件一\n附件的内容附件的内容。", 9, ""),
    ("A", 5, "第三章 表", "# 第三章 表\n\n| 项 | 值 |\n| --- | --- |\n| 一 | 1 |\n\n表后的文字内容文字内容。", 20, "![图](a.png)"),
    ("B", 1, "1 Scope", "# 1 Scope\nThis part is the scope of it all.", 11, ""),
    ("B", 2, "1 Scope > 1.1 General", "## 1.1 General\nGeneral words stand here in full.", 13, ""),
    ("B", 3, "1 Scope > 1.2 Terms", "## 1.2 Terms\nTerms and words that are used below.", 13, ""),
    ("B", 4, "2 Rules", "# 2 Rules\nRules that hold for everybody here.", 12, ""),
    ("C", 1, "Foreword", "# Foreword\nSome plain words to begin with.", 11, ""),
    ("C", 2, "Thanks", "# Thanks\nSome plain words of thanks to all.", 11, ""),
    ("C", 3, "一、正题", "# 一、正题\n不适用", 5, ""),
    ("C", 4, "二、后续", "# 二、后续\n后续的内容后续的内容后续的内容。", 12, ""),
    ("C", 5, "四、跳号", "# 四、跳号\n跳号的内容跳号的内容跳号的内容。", 12, ""),
]
REGULATION = "前文\n第一条 甲\n 内容\n第二条 乙\n" + "乙的句子。" * 100 + "\n\n" + "丙的句子。" * 100
ARTICLE_ROWS = [("", 1, 3, 2), ("第一条 甲", 2, 8, 4), ("第二条 乙", 3, 500, 248), ("第二条 乙", 4, 500, 248)]
SPLIT_TEXTS = [("sentences", "h", "句子内容。" * 200), ("hard", "", "x" * 1500), ("table", "h", "| a | b | c | d |\n" * 60), ("paragraph", "h", "段落一" * 60 + "\n\n" + "段落二" * 160 + "。" + "尾" * 200), ("short", "h", "短")]
SPLIT_ROWS = [
    ("sentences_s1", "h (part 1/2)", 600, 333), ("sentences_s2", "h (part 2/2)", 400, 222), ("hard_s1", "(part 1/4)", 400, 222), ("hard_s2", "(part 2/4)", 400, 222), ("hard_s3", "(part 3/4)", 400, 222), ("hard_s4", "(part 4/4)", 510, 283),
    ("table", "h", 1080, 600), ("paragraph_s1", "h (part 1/3)", 180, 100), ("paragraph_s2", "h (part 2/3)", 481, 267), ("paragraph_s3", "h (part 3/3)", 200, 111), ("short", "h", 1, 1),
]

def line():
    return F.col("c0")


#: Literal rows and the columns that a rule makes of their first ones (c0, c1 and so on), which the last ones hold.
RULES = {
    "furniture": (FURNITURE, 1, lambda: [T.is_page_furniture(line())]),
    "weak titles": (WEAK, 1, lambda: [T.is_weak_title(line())]),
    "simple headings": (SIMPLE, 1, lambda: [H.simple_level(line())]),
    "rich headings": (RICH, 3, lambda: [H.rich_heading(line(), F.col("c1"), F.col("c2"))["level"], H.rich_heading(line(), F.col("c1"), F.col("c2"))["title"]]),
    "numerals": (NUMERALS, 1, lambda: [T.chinese_number(line())]),
    "prefixes": (PREFIXES, 1, lambda: [T.dotted_prefix(line()), T.last_number(F.regexp_extract(line(), r"[\d.]+", 0))]),
    "short chunks": (SHORT, 3, lambda: [F.array_join(T.merged_short(F.array("c1", "c2"), 100, 400, glue="/"), "|")]),
    "HTML tables": (TABLES, 1, lambda: [tables.html_to_markdown(line())]),
    "empty chunks": (EMPTY, 1, lambda: [T.is_empty_chunk(line(), F.array().cast("array<string>"))]),
    "replies": (REPLY_VALUES, 1, lambda: [F.try_variant_get(T.json_value(line()), "$.a", "string")]),
    "calculations": (NUMERIC, 5, lambda: [T.needs_calculation(line(), F.col("c1"), F.col("c2"), F.create_map(F.lit("A"), F.col("c3")), F.col("c4"))]),
    "routes": (ROUTES, 2, lambda: [agent.route(line(), F.col("c1"))]),
    "answers": (ANSWERS, 2, lambda: [T.format_answer(F.filter(F.split(line(), ","), lambda x: x != ""), F.col("c1"))]),
    "slots": (SLOTS, 2, lambda: [*[T.split_answer(line(), F.col("c1"))[i] for i in range(4)], F.array_join(T.answer_warnings(line(), F.col("c1")), ",")]),
}


@pytest.mark.parametrize("name", RULES)
def test_rules(spark, name):
    rows, n, rule = RULES[name]
    kind = lambda x: "double" if isinstance(x, float) else "string"
    d = spark.createDataFrame([(k, *r[:n]) for k, r in enumerate(rows)], "k int, " + ", ".join(f"c{i} {kind(rows[0][i])}" for i in range(n)))
    assert [tuple(r) for r in d.orderBy("k").select(*rule()).collect()] == [tuple(r[n:]) for r in rows]


def test_numbers_beyond_an_integer(spark):
    d = spark.createDataFrame([(0, "4703443633 号"), (1, "1.2147483647"), (2, "1.2147483648")], "k int, c string")
    assert [r["n"] for r in d.orderBy("k").select(T.last_number(F.col("c")).alias("n")).collect()] == [None, 2147483647, None]


def test_headings_by_convention(spark):
    h = spark.createDataFrame([r[:3] for r in HEADINGS], "doc_id string, ord int, title string")
    ranked = h.join(H.conventions(h), "doc_id").withColumn("rank", H.heading(F.col("title"), F.col("convention"))["rank"])
    assert sorted(map(str, map(tuple, ranked.select("doc_id", "ord", "title", "convention", "rank").collect()))) == sorted(map(str, HEADINGS))
    path = {(r["doc_id"], r["ord"]): r["path"] for r in H.paths(ranked.where("rank is not null")).collect()}
    assert path["a", 5] == "第一章 总则 > 第一节 目的 > 第三条 范围 > 一、定义 > （一）术语 > （1）单位" and path["a", 6] == "第二章 附则" and path["b", 3] == "2 Rules"


def test_section_rows_and_trees(spark):
    flat = H.section_rows(spark.createDataFrame(TREE_LINES, "doc_id string, ord int, line string"))
    assert sorted(map(tuple, flat.select("doc_id", "section", "header_path", "title", "level", "content").collect())) == sorted(TREE_ROWS)
    assert sorted(map(tuple, H.section_tree(flat).select("doc_id", "total_sections", "section_tree").collect())) == sorted(TREES)


def test_formulas(spark):
    d = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(FORMULAS)], "k int, code string").withColumn("reply", F.to_json(F.struct(F.lit(True).alias("need_calc"), "code")))
    assert [r["calculated"] for r in agent.with_calculation(d, "reply").orderBy("k").collect()] == [x for _, x in FORMULAS]


def test_plans_are_flattened(spark):
    plans = agent.parse_plan(spark.createDataFrame(REPLIES, "qid string, reply string"))
    assert sorted(map(tuple, agent.flatten_plan(plans).select("qid", "target_ord", "round", "semantic_query", F.array_join("doc_ids", ",")).collect())) == sorted(FLAT)


def test_uploads_are_matched(spark):
    got = files.matched_results(spark.createDataFrame([(f,) for f, _ in RESULTS], "file_name string"), spark.createDataFrame(UPLOADS, "doc_id string, path string"))
    assert sorted(map(tuple, got.select("file_name", "doc_id").collect())) == sorted(RESULTS)


@pytest.mark.parametrize("cut,rows", [(chunking.chunk_markdown, CHUNK_ROWS), (chunking.chunk_headers, HEADER_ROWS)])
def test_chunkers(spark, cut, rows):
    d = spark.createDataFrame(CHUNK_DOCS, "doc_id string, text string")
    got = cut(d).select("doc_id", "chunk_no", "header_path", "text", "tokens", F.array_join("images", ","))
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_the_table_function(spark):
    chunking.register(spark)
    spark.createDataFrame(CHUNK_DOCS, "doc_id string, text string").createOrReplaceTempView("longleaf_case_docs")
    got = spark.sql("SELECT c.chunk_no, c.header_path, c.tokens FROM longleaf_case_docs d, LATERAL chunk_document(d.doc_id, d.text, 'markdown') c WHERE d.doc_id = 'A'")
    assert sorted(map(tuple, got.collect())) == sorted((r[1], r[2], r[4]) for r in CHUNK_ROWS if r[0] == "A")


def test_articles_and_the_secondary_split(spark):
    got = chunking.chunk_articles(spark.createDataFrame([("d", REGULATION)], "doc_id string, text string"))
    assert sorted(map(tuple, got.select("header_path", "chunk_no", F.length("text"), "tokens").collect())) == sorted(ARTICLE_ROWS)
    d = spark.createDataFrame(SPLIT_TEXTS, "chunk_id string, header_path string, text string").select(F.lit("d").alias("doc_id"), "*", T.tokens_dense(F.col("text")).alias("tokens"))
    parts = chunking.split_long(d)
    assert sorted(map(tuple, parts.select("chunk_id", "header_path", F.length("text"), "tokens").collect())) == sorted(SPLIT_ROWS)
    assert report.split_statistics(d, parts).head().asDict() == {"before": 5, "kept": 2, "split": 3, "after": 11}


def test_trees_are_nested_json():
    assert json.loads(TREES[0][2])[0]["children"][0]["children"][0]["title"] == "适用范围"
