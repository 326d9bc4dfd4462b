"""Files in and out: raw documents, Markdown and plain text, questions, answers, registry and results."""

from __future__ import annotations

from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longleaf.functions import headings as H
from longleaf.functions import text as T

_STEM = r"([^/]+?)(?:\.([^./]*))?$"
QUESTION = "qid string, domain string, split string, question string, type string, options map<string,string>, doc_ids array<string>, answer_format string"


#: Folders below a domain's own that belong to it.
BELOW = ("", "txt", "html", "attachments")
CHUNK = "chunk_id string, doc_id string, header_path string, text string, tokens int, images array<string>"


def raw_files(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("pdf", "html", "txt"), domains: list[str] | None = None) -> DataFrame:
    """doc_id, path, ext, domain and subdir (the folder's name) of the documents in a folder, its domains, and their txt, html and attachments folders; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").load(folder).select("path")
    root = PurePosixPath(folder.split("://")[-1]).name
    inside = F.split(F.substring_index("path", f"/{root}/", -1), "/")
    placed = f.select("path", inside.alias("p"), F.element_at(F.split("path", "/"), -2).alias("subdir")).where((F.size("p") <= 2) | (F.size("p") == 3) & F.col("subdir").isin(*BELOW))
    domain = F.when(F.size("p") > 1, F.get("p", F.lit(0))).otherwise(F.lit(root))
    found = placed.select(F.regexp_extract("path", _STEM, 1).alias("doc_id"), "path", F.lower(F.regexp_extract("path", _STEM, 2)).alias("ext"), domain.alias("domain"), "subdir")
    return found if domains is None else found.where(F.col("domain").isin(*domains))


def mapping(files: DataFrame) -> DataFrame:
    """One path for each document; of several the last by domain, folder below it and name."""
    below = F.array_position(F.array(*map(F.lit, BELOW)), F.col("subdir"))  # 0 for a domain's own folder
    return files.groupBy("doc_id").agg(F.max_by("path", F.struct("domain", below, "path")).alias("path"))


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose document isn't done."""
    return files.join(done.select("doc_id"), "doc_id", "left_anti")


def pending_counts(files: DataFrame, done: DataFrame) -> DataFrame:
    """(subdir, files): how many files of each folder are to be worked on."""
    return pending(files, done).groupBy("subdir").agg(F.count(F.lit(1)).alias("files"))


def by_kind(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files that are PDF, and the others, which take another service."""
    return files.where("ext = 'pdf'"), files.where("ext <> 'pdf'")


def first_rows(df: DataFrame, ord_col: str, n: int) -> DataFrame:
    """The first n rows by an order; all of them for 0."""
    return df.orderBy(ord_col).limit(n) if n > 0 else df


def matched_results(results: DataFrame, uploads: DataFrame) -> DataFrame:
    """Results (file_name) with the document (doc_id, path) that was uploaded under that name; the name itself where none was."""
    named = uploads.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("doc_id").alias("known")).dropDuplicates(["file_name"])
    return results.join(named, "file_name", "left").withColumn("doc_id", F.coalesce("known", "file_name")).drop("known")


def page_ranges(files: DataFrame, pages: int = 200) -> DataFrame:
    """files (doc_id, n_pages) in parts of so many pages: part_id, first_page, last_page."""
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_pages") / pages).cast("int") - 1, F.lit(0)))).alias("k")
    p = files.select("doc_id", "n_pages", part)
    return p.select("doc_id", F.when(F.col("n_pages") > pages, F.concat_ws("_p", F.col("doc_id"), (F.col("k") + 1).cast("string"))).otherwise(F.col("doc_id")).alias("part_id"), (F.col("k") * pages + 1).alias("first_page"), F.least((F.col("k") + 1) * pages, "n_pages").alias("last_page"))


def merged_parts(parts: DataFrame) -> DataFrame:
    """(doc_id, text) of documents all of whose parts (doc_id, part, parts, text) are there, with marks between them."""
    g = parts.groupBy("doc_id").agg(F.max("parts").alias("parts"), F.count_distinct("part").alias("n"), F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
    return g.where("n = parts").select("doc_id", F.array_join(F.transform("p", lambda x: F.concat(F.lit("<!-- Part "), x["part"].cast("string"), F.lit(" -->\n"), x["text"])), "\n\n").alias("text"))


def decoded(content: Column) -> Column:
    """Text of bytes in UTF-8, or else in GBK (bytes that aren't either are replaced), without a byte order mark.

    Only bytes that aren't UTF-8 go to Python, as Spark has no decoder for GBK.
    """

    @F.arrow_udf("string")
    def gbk(column: pa.Array) -> pa.Array:
        return pa.array([None if b is None else b.decode("gb18030", "replace") for b in column.to_pylist()], pa.string())

    valid = F.is_valid_utf8(content.cast("string"))
    return F.regexp_replace(F.coalesce(F.when(valid, content.cast("string")), gbk(F.when(~valid, content))), "^﻿", "")


def documents(spark: SparkSession, folder: str, ext: str = "md", gbk: bool = True) -> DataFrame:
    """ord, doc_id, subdir and text of the files of one kind, ordered by path; without gbk bytes that aren't UTF-8 are replaced."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{ext}").load(folder)
    text = decoded(F.col("content")) if gbk else F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "")
    return f.select(F.col("path").alias("ord"), F.regexp_extract("path", _STEM, 1).alias("doc_id"), F.element_at(F.split("path", "/"), -2).alias("subdir"), text.alias("text"))


def plain_lines(docs: DataFrame) -> DataFrame:
    """Non-blank lines (doc_id, ord, line) of texts."""
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(lines).alias("ord", "line"))


def questions(spark: SparkSession, folder: str, domain: str = "*") -> DataFrame:
    """Questions in JSON arrays or JSON lines, with or without a byte order mark; a domain reads its files only."""
    return _questions(spark, folder, domain).drop("file", "ord")


def _questions(spark: SparkSession, folder: str, domain: str) -> DataFrame:
    f = spark.read.text(f"{folder}/*{domain}*" if domain != "*" else folder, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"), F.regexp_extract(F.input_file_name(), _STEM, 1).alias("file"))
    array = F.from_json("v", f"array<struct<{_struct(QUESTION)}>>")
    line = F.transform(F.filter(F.split("v", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, f"struct<{_struct(QUESTION)}>"))
    q = f.select("file", F.posexplode(F.when(F.ltrim("v").startswith("["), array).otherwise(line)).alias("ord", "q")).select("file", "ord", "q.*").where("qid is not null")
    return q.withColumn("domain", F.coalesce("domain", "file"))


def distinct_questions(spark: SparkSession, folder: str, domain: str = "*") -> DataFrame:
    """Questions with one row for each qid: the last one by file and place."""
    q = _questions(spark, folder, domain)
    fields = [c for c in q.columns if c not in ("file", "ord")]
    return q.groupBy("qid").agg(F.max_by(F.struct(*fields), F.struct("file", "ord")).alias("q")).select("q.*")


def _struct(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in fields.replace("map<string,string>", "map<string;string>").split(",")).replace(";", ",")


def answers(spark: SparkSession, path: str) -> DataFrame:
    """qid, answer, prompt_tokens and completion_tokens from a file of any of its three shapes."""
    v = F.try_parse_json(F.regexp_replace("value", "^﻿", "")).alias("v")
    f = spark.read.text(path, wholetext=True).select(v)
    listed = F.coalesce(F.try_variant_get("v", "$.answers", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    rows = f.select(F.explode(listed).alias("a")).select(F.try_variant_get("a", "$.qid", "string").alias("qid"), "a")
    named = f.where(listed.isNull()).select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("qid", "a"))
    text = F.coalesce(F.try_variant_get("a", "$.answer", "string"), F.when(F.schema_of_variant("a") == "STRING", F.try_variant_get("a", "$", "string")), F.lit(""))
    return rows.unionByName(named).where("qid is not null").select("qid", text.alias("answer"), F.try_variant_get("a", "$.tokens.input", "long").alias("prompt_tokens"), F.try_variant_get("a", "$.tokens.output", "long").alias("completion_tokens"))


def reasoning(spark: SparkSession, path: str) -> DataFrame:
    """(qid, reasoning) from a JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.regexp_replace("value", "^﻿", ""), "map<string,string>")).alias("qid", "reasoning"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(category, doc_id, title) from a JSON object of categories of documents."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.regexp_replace("value", "^﻿", ""), "map<string,map<string,struct<title:string>>>")).alias("category", "docs"))
    return m.select("category", F.explode("docs").alias("doc_id", "info")).select("category", "doc_id", F.col("info.title").alias("title"))


def titled(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """asked (qid, doc_ids) with the titles of its documents in their order; unknown ones by their id."""
    d = asked.select("qid", F.posexplode("doc_ids").alias("pos", "doc_id")).join(registry, "doc_id", "left")
    return d.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("title", "doc_id").alias("title")))), lambda x: x["title"]).alias("titles"))


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """ord and the columns of chunks from files that hold a JSON array of them each."""
    chunks = spark.read.schema(CHUNK).json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("file"))
    return chunks.where("chunk_id is not null").withColumn("ord", F.concat_ws("#", "file", "chunk_id")).drop("file")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines: a folder for each domain if there is such a column, and all of them together."""
    if "domain" in chunks.columns:
        chunks.write.mode("overwrite").partitionBy("domain").json(f"{path}/by_domain")
    chunks.write.mode("overwrite").json(f"{path}/all")


def write_trees(trees: DataFrame, path: str) -> None:
    """One JSON line for each document: its sections as a tree and as rows (see headings.section_tree)."""
    tree = F.from_json("section_tree", "array<variant>")
    trees.select("doc_id", "total_sections", tree.alias("section_tree"), "flat_sections").write.mode("overwrite").json(path)


def write_evidence(answers: DataFrame, path: str) -> None:
    """A folder for each question with its evidence and its log line."""
    answers.write.mode("overwrite").partitionBy("qid").json(path)


def answers_document(answers: DataFrame, summary: DataFrame) -> DataFrame:
    """One JSON text: the summary (one row) and all answers by qid.  For results of bounded size such as a batch of questions."""
    fields = [c for c in answers.columns if c != "qid"]
    listed = answers.agg(F.array_sort(F.collect_list(F.struct("qid", *fields))).alias("answers"))
    return summary.select(F.struct("*").alias("summary")).crossJoin(listed).select(F.to_json(F.struct("summary", "answers")).alias("value"))


def append_log(answers: DataFrame, path: str) -> None:
    """Add a line for each answer to a log: qid, answer and tokens."""
    line = F.concat(F.col("qid"), F.lit(": "), F.coalesce(F.nullif("answer", F.lit("")), F.lit("(empty)")), F.lit(" tok="), F.col("prompt_tokens").cast("string"), F.lit("/"), F.col("completion_tokens").cast("string"))
    answers.select(line.alias("value")).write.mode("append").text(path)


def full_text(chunks: DataFrame, by: str) -> DataFrame:
    """(by, part, text): lines ``[DOC:id] text`` of each domain, in order, blank lines between; a part holds a thousand chunks."""
    rows = chunks.select(by, F.floor(F.col("ord") / 1000).alias("part"), F.struct("ord", F.concat(F.lit("[DOC:"), F.col("doc_id"), F.lit("] "), F.col("text")).alias("t")).alias("s"))
    return rows.groupBy(by, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "\n\n").alias("text"))


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header and a byte order mark, for results of bounded size such as a submission."""
    names = df.columns
    head = names[0]
    df.select(F.col(head).alias("﻿" + head), *names[1:]).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(str(PurePosixPath(path)) if "://" not in path else path)


def scanned_lines(spark: SparkSession, files: DataFrame, words: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """(doc_id, ord, line, size, body) of raw files (doc_id, path, ext): text by lines, HTML without tags, PDF from a table of its words.

    words (doc_id, page, text, top, x0, size) stands for what a PDF reader gives; without it PDF files have no lines.  folder is
    one that all files are below; without it the driver lists the files' folders.
    """
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    listed = files.select("doc_id", "path", "ext")
    folders = [folder] if folder else [r["p"] for r in listed.select(F.regexp_replace("path", "/[^/]*$", "").alias("p")).distinct().collect()]  # a row for each folder
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "")
    lines = F.when(F.col("ext") == "html", T.html_lines(text)).otherwise(F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != ""))
    none = spark.createDataFrame([], "doc_id string, ord bigint, line string, size double, body double")
    if folders:
        read = contents.load(folders).select("path", "content").join(listed.where("ext <> 'pdf'"), "path")
        none = read.select("doc_id", F.posexplode(lines).alias("ord", "line")).select("doc_id", F.col("ord").cast("long"), "line", F.lit(H.BODY_SIZE).alias("size"), F.lit(H.BODY_SIZE).alias("body"))
    if words is None:
        return none
    seen = H.without_furniture(H.visual_lines(words.join(listed.where("ext = 'pdf'").select("doc_id"), "doc_id", "left_semi")))
    pdf = seen.join(H.page_body(words), ["doc_id", "page"]).select("doc_id", (F.col("page").cast("long") * 1_000_000 + F.col("row")).alias("ord"), "line", "size", "body")
    return none.unionByName(pdf)


def parsed(spark: SparkSession, files: DataFrame, words: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """(doc_id, total_sections, section_tree, flat_sections) of raw files of any kind (see scanned_lines)."""
    return H.section_tree(H.section_rows(scanned_lines(spark, files, words, folder)))
