"""The report on a batch of answers, and checks on its inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longleaf.functions import text as T

#: Tokens that a prompt and an answer have besides their texts.
PROMPT_EXTRA, ANSWER_EXTRA = 200, 50


def submission(questions: DataFrame, answers: DataFrame, reasoning: DataFrame | None = None) -> DataFrame:
    """qid, answer_1..4, token counts, reasoning and warnings; the summary row first, then questions by qid.

    Tokens are the measured ones if both are there, else estimates.
    """
    r = reasoning if reasoning is not None else answers.select("qid", F.lit("").alias("reasoning")).limit(0)
    both = questions.join(answers.select("qid", "answer", "prompt_tokens", "completion_tokens"), "qid", "left").join(r.select("qid", "reasoning"), "qid", "left")
    both = both.withColumns({"answer": F.coalesce("answer", F.lit("")), "reasoning": F.coalesce("reasoning", F.lit("")), "measured": F.col("prompt_tokens").isNotNull() & F.col("completion_tokens").isNotNull()})
    asked = F.concat(F.col("question"), F.coalesce(F.array_join(F.map_values("options"), ""), F.lit("")), F.col("reasoning"))
    prompt = F.when(F.col("measured"), F.col("prompt_tokens")).otherwise(T.tokens_billed(asked) + PROMPT_EXTRA).cast("long")
    completion = F.when(F.col("measured"), F.col("completion_tokens")).otherwise(T.tokens_billed(F.concat("answer", "reasoning")) + ANSWER_EXTRA).cast("long")
    slots = T.split_answer(F.col("answer"), F.col("type"))
    rows = both.select("qid", *[slots[i].alias(f"answer_{i + 1}") for i in range(4)], prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), "reasoning", T.answer_warnings(F.col("answer"), F.col("type")).alias("warnings"))
    rows = rows.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    totals = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    total = rows.agg(*totals).select(F.lit("summary").alias("qid"), *[F.lit("").alias(f"answer_{i}") for i in range(1, 5)], "prompt_tokens", "completion_tokens", F.lit("").alias("reasoning"), F.array().cast("array<string>").alias("warnings"), "total_tokens")
    return total.unionByName(rows).orderBy(F.when(F.col("qid") == "summary", 0).otherwise(1), "qid")


def run_summary(answers: DataFrame, seconds: float) -> DataFrame:
    """Questions, seconds, seconds for each, and tokens of a run, in one row."""
    s = answers.agg(F.count(F.lit(1)).alias("questions"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return s.withColumns({"seconds": F.lit(float(seconds)), "average_seconds": F.round(F.lit(float(seconds)) / F.greatest("questions", F.lit(1)), 2), "score": T.token_score(F.col("prompt_tokens") + F.col("completion_tokens"))})


def coverage(questions: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, questions): documents that questions name and no file has."""
    return questions.select("qid", F.explode("doc_ids").alias("doc_id")).groupBy("doc_id").agg(F.count_distinct("qid").alias("questions")).join(files.select("doc_id"), "doc_id", "left_anti")


def split_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Chunks before, kept whole, split and after the secondary split."""
    parts = after.select(F.regexp_replace("chunk_id", r"_s\d+$", "").alias("chunk_id")).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    return before.select("chunk_id").join(parts, "chunk_id", "left").agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("n") == 1).alias("kept"), F.count_if(F.col("n") > 1).alias("split"), F.sum("n").alias("after"))


def corpus_statistics(chunks: DataFrame, by: str = "doc_id") -> DataFrame:
    """Chunks, tokens and whole tokens a chunk, by document or domain."""
    s = chunks.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.sum("tokens").alias("tokens"))
    return s.withColumn("average", F.floor(F.col("tokens") / F.greatest("chunks", F.lit(1))))


def round_histogram(targets: DataFrame) -> DataFrame:
    """(round, targets): how many targets each round of retrieval has; targets without one are of the first."""
    return targets.groupBy(F.coalesce("round", F.lit(1)).alias("round")).agg(F.count(F.lit(1)).alias("targets"))


def uncovered(compressed: DataFrame) -> DataFrame:
    """(qid, targets, empty, any_empty): targets of a plan, and those for which nothing was found."""
    none = F.size("chunk_ids") == 0
    return compressed.groupBy("qid").agg(F.count(F.lit(1)).alias("targets"), F.count_if(none).alias("empty"), F.bool_or(none).alias("any_empty"))


def empty_answers(rows: DataFrame) -> int:
    """How many questions of a submission have no answer (an exit code of 2 in a batch run)."""
    return rows.where("qid <> 'summary' and answer_1 = ''").count()


def section_counts(sections: DataFrame, by: str = "domain") -> DataFrame:
    """(by, files, sections): documents and titled sections by domain, from flat sections (doc_id, title, and the domain)."""
    return sections.groupBy(by).agg(F.count_distinct("doc_id").alias("files"), F.count_if(F.col("title") != "").alias("sections"))
