"""Text functions as native column expressions.

Every function takes columns and returns a column, so filters and projections built from them stay
in generated code.  White space is Unicode's unless a function says otherwise; a null text stays
null unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chinese digits and units, words that mark weak headings, words that call for a calculation, types and formats of choices.
CN_DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CN_UNITS = {"十": 10, "百": 100, "千": 1000}
WEAK_TITLES = ("目录", "释义", "备查文件", "附件", "摘要", "声明", "TOC", "abstract", "summary", "disclaimer", "declaration", "glossary", "appendix")
COMPARISONS = (
    "大于", "小于", "不低于", "不超过", "高于", "低于", "至少", "至多", "超过", "介于", "范围", "以内", "以上", "以下", "不足", "多于", "少于", "同比增长", "同比下降", "增幅", "降幅", "占比", "比率", "倍",
)
CHOICES = ("单选题", "多选题", "判断题", "mcq", "multi", "tf")
CJK = "[\\u4e00-\\u9fff]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def cjk_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CJK))


def tokens_mixed(c: Column) -> Column:
    """Estimate for mixed text: one token for 1.8 CJK or 4 other characters, and one more."""
    n = cjk_count(c)
    return (n / F.lit(1.8) + (F.length(c) - n) / F.lit(4.0)).cast("int") + 1


def tokens_dense(c: Column) -> Column:
    """Estimate for CJK text: one token for 1.8 characters, at least one."""
    return F.greatest(F.lit(1), (F.length(c) / F.lit(1.8)).cast("int"))


def tokens_billed(c: Column) -> Column:
    """Estimate for billing: half a token for a CJK character, a quarter for another, at least one."""
    n = cjk_count(c)
    return F.greatest(F.lit(1), (n * F.lit(0.5) + (F.length(c) - n) * F.lit(0.25)).cast("int"))


def char_grams(c: Column) -> Column:
    """Set of the characters and pairs of neighbouring characters of a text without its white space."""
    chars = F.filter(F.split(F.regexp_replace(c, r"(?U)\s+", ""), ""), lambda x: x != "")
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.concat(pairs, chars))


def terms(c: Column) -> Column:
    """Search terms of a text in order, repeats kept: lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def once(c: Column, of: Callable[[Column], Column]) -> Column:
    """of(c), where c is worked out once for each row, however often and in whatever lambda of names it."""
    return F.get(F.transform(F.array(c), of), F.lit(0))


def first_terms(c: Column, n: int) -> Column:
    """The first n of a text's terms; what stands after them is not searched."""
    parts = F.split(F.lower(c), r"[^\p{L}\p{N}]+", n + 2)  # one more for an empty beginning, and the rest
    return once(parts, lambda x: F.slice(F.filter(F.when(F.size(x) > n + 1, F.slice(x, 1, n + 1)).otherwise(x), lambda t: t != ""), 1, n))


def terms_cjk(c: Column) -> Column:
    """Search terms that also cut CJK runs into overlapping pairs, for text without word spaces."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(f"{CJK}+|[\\p{{L}}\\p{{N}}&&[^\\u4e00-\\u9fff]]+"), F.lit(0))
    pairs = lambda r: F.when(r.rlike(f"^{CJK}{{2,}}$"), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: r.substr(i, F.lit(2)))).otherwise(F.array(r))
    return F.flatten(F.transform(runs, pairs))


def last_number(c: Column) -> Column:
    """The last run of digits as an integer, or null if there is none or it is beyond an integer's range."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), F.lit(-1)).try_cast("int")


def dotted_prefix(c: Column) -> Column:
    """A leading number such as 1.2.3, without a dot at its end; empty if there is none."""
    return F.rtrim(F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)*\.?)", 1), F.lit("."))


def chinese_number(c: Column) -> Column:
    """Value of the first run of Chinese digits and units; null if there is none."""
    run = F.regexp_extract(c, "[" + "".join([*CN_DIGITS, *CN_UNITS]) + "]+", 0)
    digits = F.create_map(*[F.lit(x) for kv in CN_DIGITS.items() for x in kv])
    units = F.create_map(*[F.lit(x) for kv in CN_UNITS.items() for x in kv])

    def step(s: Column, ch: Column) -> Column:
        unit = F.try_element_at(units, ch)
        digit = F.try_element_at(digits, ch)
        pending = F.when(s["digit"] == 0, F.lit(1)).otherwise(s["digit"])
        total = F.when(unit.isNotNull(), s["total"] + pending * unit).otherwise(s["total"])
        return F.struct(total.alias("total"), F.when(unit.isNotNull(), F.lit(0)).otherwise(digit).alias("digit"))

    value = F.aggregate(F.split(run, ""), F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit")), step, lambda s: s["total"] + s["digit"])
    return F.when(run != "", value)


def is_weak_title(c: Column) -> Column:
    """Whether a title, without blanks, has a word that announces no content of its own."""
    return F.translate(c, " 　", "").rlike("(?i)" + "|".join(WEAK_TITLES))


def markdown_heading(c: Column) -> Column:
    """struct(level, title) of a Markdown heading line with a title; null otherwise."""
    level = F.length(F.regexp_extract(c, r"^(#{1,6})(?U)\s+(.*)", 1))
    title = strip(F.regexp_extract(c, r"^(#{1,6})(?U)\s+(.*)", 2))
    return F.when((level > 0) & (title != ""), F.struct(level.alias("level"), title.alias("title")))


def sentences(c: Column) -> Column:
    """Pieces that end at a full stop or semicolon of Chinese text; blank ones are left out."""
    return F.filter(F.split(c, r"(?<=[。；;])\s*"), lambda s: strip(s) != "")


def html_lines(c: Column) -> Column:
    """Non-blank lines of an HTML text: comments, styles and scripts go, tags break lines, named entities other than spaces and angle brackets go."""
    t = c
    for pattern in (r"(?s)<!--.*?-->", r"(?s)<style[^>]*>.*?</style>", r"(?s)<script[^>]*>.*?</script>"):
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(t, r"<[^>]+>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"&[a-z]+;", "")
    return F.filter(F.transform(F.split(t, "\n"), strip), lambda s: s != "")


def parent_path(c: Column) -> Column:
    """A heading path without its last part."""
    parts = F.split(c, " > ")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), " > ")


def query_text(keywords: Column, question: Column) -> Column:
    """Keywords with alternatives spread out, or the question where there are none."""
    return F.coalesce(F.nullif(strip(F.replace(F.coalesce(keywords, F.lit("")), F.lit("|"), F.lit(" "))), F.lit("")), question)


#: Lines that are page numbers, and texts of lines that stand on pages for form's sake.
PAGE_NUMBERS = (r"^\s*\d{1,4}\s*$", r"^\s*\d{1,4}\s*/\s*\d{1,4}\s*$")
PAGE_TEXTS = ("请扫描以查询验证条款", "请务必阅读正文之后的免责条款")


def is_page_furniture(c: Column) -> Column:
    """Whether a line is only a page number or holds one of the fixed texts of pages."""
    return c.rlike("|".join([*PAGE_NUMBERS, *PAGE_TEXTS]))


def is_empty_chunk(text: Column, images: Column) -> Column:
    """Whether a chunk without images and tables says nothing: under 10 characters after removing marks of absence, or a table of contents."""
    bare = F.regexp_replace(strip(text), "无。|无．|不适用", "")
    rest = strip(F.replace(F.regexp_replace(bare, r"(?U)□\s*适用", ""), F.lit("|"), F.lit("")))
    listing = F.regexp_count(rest, F.lit(r"(?U)\.\.\s*\d+")) >= 2
    table = text.contains("|") & text.contains("---")
    return ~((F.coalesce(F.size(images), F.lit(0)) > 0) | table) & ((F.length(rest) < 10) | listing)


def keeps_whole(c: Column) -> Column:
    """Whether the secondary split leaves a text alone: table-like or short."""
    return (F.regexp_count(c, F.lit(r"\|")) > 5) | (F.length(c) < 100)


#: What a list of a JSON text and this mark ends with, if the text is one value and nothing else.
_MARK = "end of the value 5f3c"


def _whole_json(c: Column) -> Column:
    """VARIANT of a text that is one JSON value; null for others, also for several values in a row."""
    both = F.try_parse_json(F.concat(F.lit("["), c, F.lit(f', "{_MARK}"]')))
    last = F.try_variant_get(both, "$[1]", "string") == _MARK
    return F.when(F.coalesce(last, F.lit(False)) & F.try_variant_get(both, "$[2]", "variant").isNull(), F.try_variant_get(both, "$[0]", "variant"))


def json_value(c: Column) -> Column:
    """VARIANT of a model's reply: all of it, or what stands between its first and last brace or bracket; null if neither is JSON."""
    bare = strip(F.regexp_replace(F.regexp_replace(c, r"```[a-z]*(?U)\s*", ""), r"(?s)<thinking>.*?</thinking>", ""))
    span = lambda p: _whole_json(F.nullif(F.regexp_extract(bare, p, 0), F.lit("")))
    return F.coalesce(_whole_json(bare), span(r"(?s)\{.*\}"), span(r"(?s)\[.*\]"))


def needs_calculation(kind: Column, answer_format: Column, question: Column, options: Column, evidence: Column) -> Column:
    """Whether a question is to be calculated: by its type, or if it asks for choices and its texts hold a digit and a word of comparison."""
    text = F.concat_ws(" ", question, F.array_join(F.map_values(options), " "), evidence)
    stated = F.coalesce(answer_format, F.lit("mcq")).isin("mcq", "multi")
    return F.coalesce(kind.contains("计算"), F.lit(False)) | (stated & text.rlike(r"(?U)\d") & text.rlike("|".join(COMPARISONS)))


def format_answer(options: Column, kind: Column) -> Column:
    """Answer letters of a list of chosen options: A if it is chosen or else B for true/false, the first for one choice, sorted letters otherwise."""
    letters = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.array_join(options, ""), F.lit("[ABCD]"), F.lit(0)))), "")
    truth = F.when(F.array_contains(options, "A"), F.lit("A")).otherwise(F.lit("B"))
    return F.when(F.coalesce(F.size(options), F.lit(0)) <= 0, F.lit("")).when(kind == "tf", truth).when(kind == "mcq", options[0]).otherwise(letters)


def split_answer(answer: Column, kind: Column) -> Column:
    """The four answer slots (array of 4) of an answer without white space around it: choices stay whole, others are cut at separators and the fourth takes the rest."""
    bare = strip(F.coalesce(answer, F.lit("")))
    parts = F.filter(F.split(bare, r"(?U)[；;，,\s]+"), lambda p: p != "")
    whole = F.coalesce(kind.isin(*CHOICES), F.lit(False)) | bare.rlike("^[A-D]+$") | (F.size(parts) <= 1)
    slot = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    fourth = F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), "；")
    return F.when(whole, F.concat(F.array(bare), F.array_repeat(F.lit(""), 3))).otherwise(F.array(slot(1), slot(2), slot(3), fourth))


def answer_warnings(answer: Column, kind: Column) -> Column:
    """What is wrong with an answer: empty, and not letters A-D where a choice is asked for."""
    bare = strip(F.coalesce(answer, F.lit("")))
    wrong = F.coalesce(kind.isin(*CHOICES), F.lit(False)) & ~bare.rlike("^[A-D]+$")
    return F.array_compact(F.array(F.when(bare == "", F.lit("empty answer")), F.when(wrong, F.lit("not a choice"))))


def token_score(total: Column, budget: int = 5_000_000) -> Column:
    """What is left of a token budget, from 1 (nothing used) to 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(float(budget)) - total) / F.lit(float(budget))))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is worked out once, however often then names it: within a lambda an expression is worked out at each place and for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def unit_vector(v: Column) -> Column:
    """A vector scaled to length 1 (a zero vector stays)."""
    squared = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    scaled = lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x.cast("double") / s["n"])).otherwise(s["v"].cast("array<double>"))
    return let(let(v, lambda a: F.struct(a.alias("v"), F.sqrt(squared(a)).alias("n"))), scaled)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def repaired_vector(v: Column, dim: int) -> Column:
    """A vector of the wrong length becomes zeros."""
    return F.when(F.coalesce(F.size(v), F.lit(-1)) == dim, v).otherwise(F.array_repeat(F.lit(0.0).cast("float"), dim))


def packed(pieces: Column, limit: int, size=None, glue: str = "\n\n") -> Column:
    """Greedy packing, in order, of an array of texts into texts whose size estimates sum to at most limit (one larger piece stands alone).

    Each piece is measured once; the fold goes over sizes and keeps where packs begin.
    """
    begun = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("n"), F.lit(1).alias("at"))

    def step(s: Column, n: Column) -> Column:
        new = (F.size(s["starts"]) == 0) | (s["n"] + n > limit)
        return F.struct(F.when(new, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"), F.when(new, n).otherwise(s["n"] + n).alias("n"), (s["at"] + 1).alias("at"))

    starts = F.aggregate(F.transform(pieces, size or tokens_mixed), begun, step, lambda s: F.concat(s["starts"], F.array(s["at"])))  # and where one would begin after the last piece
    spans = F.zip_with(F.slice(starts, 1, F.size(starts) - 1), F.slice(starts, 2, F.size(starts) - 1), lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    return F.transform(spans, lambda s: F.array_join(F.slice(pieces, s["a"], s["n"]), glue))


def merged_short(chunks: Column, least: int, most: int, glue: str = "\n\n") -> Column:
    """A chunk shorter than least joins the one before it if both together are estimated at most at most tokens."""

    def step(out: Column, c: Column) -> Column:
        before = F.try_element_at(out, F.lit(-1))
        joined = F.concat(before, F.lit(glue), c)
        fits = (F.size(out) > 0) & (tokens_mixed(c) < least) & (tokens_mixed(joined) <= most)
        return F.when(fits, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(out, F.array(c)))

    return F.aggregate(chunks, F.array().cast("array<string>"), step)
