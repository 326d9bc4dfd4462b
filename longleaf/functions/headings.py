"""Heading recognition: rules as data, the numbering convention of a document, and heading paths.

Rules are lists of (pattern, rank under convention A, rank under B, kind); a heading takes the first
rule that matches its beginning.  Convention A numbers by Chinese characters, B by dotted digits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longleaf.functions import text as T

NUM = "[一二三四五六七八九十]+"
PLACE = "[一二三四五六七八九十百千零\\d]+"
#: Shapes of numbered headings, their ranks under both conventions and their kind.
SHAPES = {
    "chapter": (f"^第{PLACE}章", 1, 1, "CHINESE"),
    "section": (f"^第{PLACE}节", 2, 2, "CHINESE"),
    "article": (f"^第{PLACE}条", 3, 3, "CHINESE"),
    "numeral": (f"^{NUM}[、．]", 4, 10, "CHINESE"),
    "numeral_dot": (f"^{NUM}[.）)]", 4, 10, "CHINESE"),
    "bracket_numeral": (f"^（{NUM}）", 5, 11, "CHINESE"),
    "bracket_digit": (r"^(?:（\d+）|\(\d+\))", 7, 12, "CHINESE"),
    "dotted4": (r"^\d+\.\d+\.\d+\.\d+\.?(?:\s|$)", 9, 7, "ARABIC"),
    "dotted3": (r"^\d+\.\d+\.\d+\.?(?:\s|$)", 8, 6, "ARABIC"),
    "dotted2": (r"^\d+\.\d+\.?(?:\s|$)", 7, 5, "ARABIC"),
    "digit_bracket": (r"^\d+[）)]", 7, 9, "ARABIC"),
    "digit_blank": (r"^\d{1,2}\.?\s", 6, 4, "ARABIC"),
    "digit_mark": (r"^\d+[、．]", 6, 8, "ARABIC"),
}
#: The order in which each convention tries the shapes.
ORDER = {
    "A": ("chapter", "section", "article", "numeral", "numeral_dot", "bracket_numeral", "bracket_digit", "dotted4", "dotted3", "dotted2", "digit_bracket", "digit_blank", "digit_mark"),
    "B": ("chapter", "section", "article", "dotted4", "dotted3", "dotted2", "digit_blank", "digit_mark", "digit_bracket", "numeral", "numeral_dot", "bracket_numeral", "bracket_digit"),
}
#: What forces convention A, and headings of plain text files by level.
NAMED = f"^第{PLACE}[章节]"
SIMPLE = ((r"^第[一二三四五六七八九十百千\d]+[章节条]\s+", 1), (r"^第\s*\d+\s*条\s+", 1), (r"^\(\s*[一二三四五六七八九十百千\d]+\s*\)\s+", 2), (r"^(\d+\.)+\d+\s+[^\d]", 3), (r"^\d+\.\d+\s+[^\d\s]", 3), (r"^[A-Z]\.\s\s*[A-Z一-鿿]", 4))
#: Headings of laid-out pages by level, in the order they are tried (the last group is the title); list items; how much larger than the body text a level is.
RICH = (
    (r"^\s*#?\s*(\d+)\.\s+([^\d].{3,})$", 1), (r"^\s*#?\s*(\d+\.\d+)\.\s*(.{3,})$", 2), (r"^\s*#?\s*(\d+\.\d+\.\d+)\.\s*(.{3,})$", 3), (r"^\s*#?\s*(\d+\.\d+\.\d+\.\d+)\.\s*(.{3,})$", 4), (r"^\s*第[一二三四五六七八九十百零\d]+章[、\s\.]+(.+)$", 1),
    (r"^\s*第[一二三四五六七八九十百零\d]+条[、\s\.]+(.+)$", 2), (r"^\s*第[一二三四五六七八九十\d]+类[：:]\s*(.{2,})$", 3), (r"^\s*[一二三四五六七八九十]+[、]\s*(.{2,})$", 1), (r"^\s*[（(][一二三四五六七八九十\d]+[）)]\s*(.{2,})$", 3),
)
LISTED = (r"^\s*（\d+）\s*", r"^\s*[\(（]\d+[\)）]\s*", r"^\s*[a-zA-Z][\.．]\s*", r"^\s*[①-⑩]\s*", r"^\s*\d+[、,，]\s*")
LARGER = {1: 1.15, 2: 1.08, 3: 1.05, 4: 1.02}
ROOT, BODY_SIZE = "文档", 10.5
RANKS = 12
#: Places of lines that are one block of a document.
BLOCK = 1_000_000


def heading(title: Column, convention: Column) -> Column:
    """struct(rank, kind) of a title; rank is null and kind PLAIN if it isn't numbered."""

    def chain(name: str) -> Column:
        out = F.struct(F.lit(None).cast("int").alias("rank"), F.lit("PLAIN").alias("kind"))
        for shape in reversed(ORDER[name]):
            pattern, a, b, kind = SHAPES[shape]
            out = F.when(title.rlike("(?U)" + pattern), F.struct(F.lit(a if name == "A" else b).alias("rank"), F.lit(kind).alias("kind"))).otherwise(out)
        return out

    return F.when(convention == "B", chain("B")).otherwise(chain("A"))


def conventions(headings: DataFrame) -> DataFrame:
    """(doc_id, convention) from headings (doc_id, ord, title): A if a chapter or section is named or the first three numbered headings aren't all in digits."""
    h = headings.withColumn("h", heading(F.col("title"), F.lit("A")))
    numbered = F.when(F.col("h.rank").isNotNull(), F.struct("ord", F.col("h.kind").alias("kind")))
    per = h.groupBy("doc_id").agg(F.coalesce(F.max(F.col("title").rlike("(?U)" + NAMED)), F.lit(False)).alias("named"), F.slice(F.array_sort(F.collect_list(numbered)), 1, 3).alias("first"))
    digits = (F.size("first") == 3) & F.forall("first", lambda x: x["kind"] == "ARABIC")
    return per.select("doc_id", F.when(~F.col("named") & digits, "B").otherwise("A").alias("convention"))


def paths(headings: DataFrame, key: str = "doc_id", ranks: int = RANKS, block: int = BLOCK) -> DataFrame:
    """headings (key, ord, rank from 1 to ranks, title) with path, the titles of the open ancestors and the heading itself.

    A rank is open where its last heading comes after the last one of every smaller rank, which
    running maxima tell, without a stack.  Maxima go on from block to block of a document (so many places of ord each): what
    the blocks before have is taken from their own maxima, so a document of any length is many tasks' work.
    """
    number = F.floor(F.col("ord") / block)
    mine = headings.withColumn("_block", number)
    of_rank = [F.when(F.col("rank") == r, F.struct("ord", "title")) for r in range(1, ranks + 1)]
    ends = mine.where(F.col("_block") >= 0).groupBy(key, "_block").agg(*[F.max(c).alias(f"_e{r}") for r, c in enumerate(of_rank, 1)])
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    handed = ends.select(key, "_block", *[F.max(f"_e{r}").over(before).alias(f"_e{r}") for r in range(1, ranks + 1)]).where("_block > 0")
    w = Window.partitionBy(key, "_block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    out = mine.select("*", *[F.max(c).over(w).alias(f"_p{r}") for r, c in enumerate(of_rank, 1)]).join(handed, [key, "_block"], "left")
    out = out.select(*headings.columns, *[F.coalesce(f"_p{r}", f"_e{r}").alias(f"_p{r}") for r in range(1, ranks + 1)])
    parts = []
    for r in range(1, ranks + 1):
        above = [F.coalesce(F.col(f"_p{s}.ord"), F.lit(-1)) for s in range(1, r)]
        top = F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(-1)
        parts.append(F.when(F.col(f"_p{r}.ord") > top, F.col(f"_p{r}.title")))
    return out.withColumn("path", F.array_join(F.array_compact(F.array(*parts)), " > ")).drop(*[f"_p{r}" for r in range(1, ranks + 1)])


def simple_level(line: Column) -> Column:
    """Level 1 to 4 of a plain heading line; null for other lines."""
    return reduce(lambda out, p: F.when(line.rlike("(?U)" + p[0]), F.lit(p[1])).otherwise(out), reversed(SIMPLE), F.lit(None).cast("int"))


def sections(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections of lines (key, ord, line): a heading line and the text below it; what precedes the first heading opens the first section's text."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("level", simple_level(F.col("line"))).withColumn("section", F.greatest(F.lit(1), F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(w)))
    head = F.when(F.col("level").isNotNull(), F.col("ord"))
    grouped = marked.groupBy(key, "section").agg(F.min_by("line", head).alias("header"), F.min_by("level", head).alias("level"), F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("ord", "line")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return grouped.select(key, "section", F.coalesce("header", F.lit("")).alias("header"), F.coalesce("level", F.lit(0)).alias("level"), body.alias("text"), F.size("l").alias("line_count")).withColumn("char_count", F.length("text"))


def rich_heading(line: Column, size: Column, body: Column) -> Column:
    """struct(level, title) of a heading line of a laid-out page: short, no list item, numbered, and larger than the body text (unless it has its size); null for others."""
    text = T.strip(line)
    none = F.lit(None).cast("struct<level:int,title:string>")

    def tried(k: int) -> Column:
        if k == len(RICH):
            return none
        pattern, level = "(?U)" + RICH[k][0], RICH[k][1]
        title = T.strip(F.regexp_extract(text, pattern, RICH[k][0].count("(") - RICH[k][0].count("[（(]")))
        larger = (size == body) | (size / body >= LARGER[level])
        return F.when(text.rlike(pattern) & (F.length(title) >= 3) & larger, F.struct(F.lit(level).alias("level"), title.alias("title"))).otherwise(tried(k + 1))

    return F.when((F.length(text) > 0) & (F.length(text) <= 200) & ~text.rlike("(?U)" + "|".join(LISTED)), tried(0))


def section_rows(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Flat sections (key, section, header_path, title, level, content) of lines (key, ord, line, and size and body or neither), in order.

    Section 0 is the document itself with what precedes the first heading; paths start there.  A
    level is open where its last heading comes after the last one of every smaller level.
    """
    has = {"size", "body"} <= set(lines.columns)
    size, body = (F.col("size"), F.col("body")) if has else (F.lit(BODY_SIZE), F.lit(BODY_SIZE))
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("h", rich_heading(F.col("line"), size, body)).withColumn("section", F.sum(F.when(F.col("h").isNotNull(), 1).otherwise(0)).over(w))
    head = F.when(F.col("h").isNotNull(), F.col("h"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("h").isNull(), F.struct("ord", "line")))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    found = marked.groupBy(key, "section").agg(F.first(head, ignorenulls=True).alias("h"), text.alias("content"))
    root = lines.select(key).distinct().join(found.where("section = 0").select(key, "content"), key, "left").select(key, F.lit(0).cast("long").alias("section"), F.lit(ROOT).alias("title"), F.lit(0).alias("level"), F.coalesce("content", F.lit("")).alias("content"))
    flat = root.unionByName(found.where("section > 0").select(key, "section", F.col("h.title").alias("title"), F.col("h.level").alias("level"), "content"))
    path = paths(flat.select(key, F.col("section").alias("ord"), (F.col("level") + 1).alias("rank"), "title", "level", "content"), key, 5)
    return path.select(key, F.col("ord").alias("section"), F.col("path").alias("header_path"), "title", "level", "content")


def section_tree(flat: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, total_sections, section_tree, flat_sections) from flat sections: the nested tree as JSON text, and its rows.

    From the deepest level up, the JSON of a section joins its parent's children, which is the
    last section before it of a smaller level.
    """
    w = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == v, F.col("section"))).over(w) for v in range(4)]
    parent = F.greatest(*[F.when(F.col("level") > v, last[v]) for v in range(4)])
    rows = flat.withColumn("parent", parent).withColumn("children", F.array().cast("array<struct<section:bigint,node:string>>"))

    def quoted(c: str) -> Column:
        pair = F.to_json(F.struct(F.col(c).alias("x")))  # {"x":value}
        return pair.substr(F.lit(6), F.length(pair) - 6)

    children = F.array_join(F.transform(F.array_sort("children"), lambda c: c["node"]), ", ")
    whole = F.concat(F.lit('{"level": '), F.col("level").cast("string"), F.lit(', "title": '), quoted("title"), F.lit(', "content": '), quoted("content"), F.lit(', "children": ['), children, F.lit("]}"))
    for level in range(4, 0, -1):
        made = rows.where(F.col("level") == level).groupBy(key, F.col("parent").alias("section")).agg(F.collect_list(F.struct("section", whole.alias("node"))).alias("more"))
        rows = _adopt(rows.where(F.col("level") < level), made, key)
    tree = rows.select(key, F.concat(F.lit("["), whole, F.lit("]")).alias("section_tree"))
    named = flat.groupBy(key).agg(F.count_if(F.col("title") != "").alias("total_sections"), F.transform(F.array_sort(F.collect_list(F.struct("section", "header_path", "title", "level", "content"))), lambda x: F.struct(x["header_path"].alias("header_path"), x["title"].alias("title"), x["level"].alias("level"), x["content"].alias("content"))).alias("flat_sections"))
    return named.join(tree, key)


def _adopt(rows: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """rows with the nodes of made (key, section, more) among their children."""
    both = rows.join(made, [key, "section"], "left")
    return both.withColumn("children", F.when(F.col("more").isNull(), F.col("children")).otherwise(F.concat("children", "more"))).drop("more")


def visual_lines(words: DataFrame) -> DataFrame:
    """Lines of words (doc_id, page, text, top, x0, size): words of one height, left to right, without blanks, with their mean size."""
    w = words.withColumn("row", F.bround(F.col("top") / 3).cast("long"))
    g = w.groupBy("doc_id", "page", "row").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("w"), F.avg("size").alias("size"))
    return g.select("doc_id", "page", "row", F.array_join(F.transform("w", lambda x: x["text"]), "").alias("line"), "size")


def body_size(words: DataFrame) -> DataFrame:
    """(doc_id, body): the most frequent font size of a document; of equally frequent ones the smallest."""
    n = words.groupBy("doc_id", F.round("size", 1).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))


def page_body(words: DataFrame) -> DataFrame:
    """(doc_id, page, body): the most frequent font size of a page; of equally frequent ones the one that is seen first."""
    n = words.where("size > 0").groupBy("doc_id", "page", "size").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("top", "x0")).alias("at"))
    first = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("n"), "at"))
    return n.withColumn("k", first).where("k = 1").select("doc_id", "page", F.col("size").alias("body"))


def without_furniture(lines: DataFrame, share: float = 0.7, short: int = 40) -> DataFrame:
    """lines (doc_id, page, line) without page numbers, disclaimers, and short lines that stand on most pages of their document."""
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    seen = lines.groupBy("doc_id", "line").agg(F.count_distinct("page").alias("on"))
    common = seen.join(pages, "doc_id").where((F.col("on") >= F.col("pages") * F.lit(share)) & (F.col("pages") > 1) & (F.length("line") < short) & ~F.col("line").rlike("[\\u4e00-\\u9fff，。；：]{5,}"))
    return lines.where(~T.is_page_furniture(F.col("line"))).join(common.select("doc_id", "line"), ["doc_id", "line"], "left_anti")
