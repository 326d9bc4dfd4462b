"""A batch of questions from files to results: answers, evidence, log, figures, trace and submission, each a table written once."""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable

from pyspark.sql import functions as F

from longleaf.operators import bm25
from longleaf.plans import agent, provider, report
from longleaf.sources import files

#: Folders that evidence is dealt to, by question.
FOLDERS = 64


def model_of(name: str) -> Callable[[], provider.Chat]:
    """The factory that ``package.module:factory`` names."""
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)


def answer(index: bm25.Index, questions: str, out: str, make: Callable[[], provider.Chat] = provider.NoModel, model: str = "", domain: str = "*", limit: int = 0) -> int:
    """Answer the questions in a folder, or a file of it; 0, or 2 if some question has no answer.

    In ``out``: answers (JSON lines), evidence (JSON lines by question, in folders by hash), log (lines, added to), summary and trace
    (JSON lines), document (one JSON text of all answers), submission (one CSV file), and the model's replies, so a
    batch that was stopped goes on where it was and one that is run again sends nothing.
    """
    spark = index.chunks.sparkSession
    began = time.monotonic()
    asked = files.first_rows(files.distinct_questions(spark, questions, domain), "qid", limit)
    asked = asked.withColumn("doc_ids", F.coalesce("doc_ids", F.array().cast("array<string>")))
    replies, trace = provider.Replies(spark, f"{out}/replies", model), agent.Trace()
    rows = agent.run(asked, index, make, replies, trace)
    rows.write.mode("overwrite").json(f"{out}/answers")
    rows = spark.read.schema(rows.schema).json(f"{out}/answers")
    evidence = agent.evidence_of(trace.tables["compress"]).select("qid", "evidence")
    by_folder = evidence.withColumn("folder", F.pmod(F.xxhash64("qid"), F.lit(FOLDERS)))
    by_folder.repartition("folder").sortWithinPartitions("folder", "qid").write.mode("overwrite").partitionBy("folder").json(f"{out}/evidence")
    files.append_log(rows, f"{out}/log")
    summary = report.run_summary(rows, time.monotonic() - began)
    summary.coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    trace.table(replies).coalesce(1).write.mode("overwrite").json(f"{out}/trace")  # a row for each stage
    files.answers_document(rows, spark.read.json(f"{out}/summary")).write.mode("overwrite").text(f"{out}/document")
    submission = report.submission(asked, rows).drop("reasoning", "warnings")
    files.write_csv(submission, f"{out}/submission")
    return 2 if report.empty_answers(submission) else 0
