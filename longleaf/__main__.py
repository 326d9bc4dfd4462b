"""``python -m longleaf build|search|info|answer``: make, ask and describe a keyword index, and answer questions with it."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from longleaf.operators import bm25
from longleaf.plans import batch
from longleaf.session import is_complete
from longleaf.settings import Settings, known
from longleaf.sources import files


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="longleaf")
    parser.add_argument("--config")
    parser.add_argument("--index")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="index chunk files")
    build.add_argument("chunks")
    build.add_argument("--force", action="store_true")
    search = commands.add_parser("search", help="best chunks for a query")
    search.add_argument("query")
    search.add_argument("--top-k", type=int, default=5)
    commands.add_parser("info", help="figures of the index")
    answer = commands.add_parser("answer", help="answer a folder of questions")
    answer.add_argument("questions")
    answer.add_argument("--out")
    answer.add_argument("--model", default="longleaf.plans.provider:NoModel", help="package.module:factory")
    answer.add_argument("--domain", default="*")
    answer.add_argument("--limit", type=int, default=0)
    asked = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    path = asked.index or known(Settings(asked.config))["index_dir"]
    if asked.command == "build":
        bm25.Index.ensure(files.chunk_files(spark, asked.chunks), path, asked.force)
        print(f"index: {path}")
        return 0
    if not is_complete(spark, f"{path}/chunks"):
        print(f"no index at {path}: build one first")
        return 1
    index = bm25.Index.load(spark, path)
    if asked.command == "info":
        row = index.info().head()
        print(f"chunks: {row['n_chunks']}\nterms: {row['n_terms']}\nterms a chunk: {row['avg_terms']:.1f}")
        return 0
    if asked.command == "answer":
        out = asked.out or known(Settings(asked.config))["output_dir"]
        code = batch.answer(index, asked.questions, out, batch.model_of(asked.model), asked.model, asked.domain, asked.limit)
        for r in spark.read.json(f"{out}/trace").orderBy("ord").collect():  # a row for each stage
            print(f"{r['stage']}: {r['rows']} rows, {r['calls']} calls, {r['prompt_tokens']}/{r['completion_tokens']} tokens, {r['seconds']:.1f} s")
        print(f"results: {out}")
        return code
    target = spark.createDataFrame([(0, asked.query)], "target int, query string")
    for hit in bm25.search(index, target, asked.top_k).orderBy("rank").collect():  # top_k rows
        print(f"[{hit['rank']}] {hit['doc_id']} | {hit['chunk_id']} | {hit['score']:.4f}\n    {(hit['text'] or '')[:120]}".replace("\n ", "\n "))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
