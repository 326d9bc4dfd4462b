"""Models behind an interface, with offline stand-ins that need no network.

A provider is made once for each task and gets its rows in batches.  It answers every row: a
failure, of a call or of the provider's making, is an empty reply and no usage, never an error.  The stand-ins are deterministic; what they
answer says nothing about the quality of a model.

A model's replies are kept in a table by the digest of model and prompt, and are read from there by whatever needs
them: a prompt is sent once, however often a plan is worked out, and a run that was stopped goes on
with the prompts that have no reply yet.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longleaf.session import is_complete, scratch_path, ship, written

#: Seconds before a call is tried again (twice as many each time), and prompts whose replies are stored together.
WAIT, STORED = 0.5, 10_000


class Chat(Protocol):
    def chat(self, prompts: list[str]) -> list[tuple[str, int, int]]:
        """Reply, prompt tokens and reply tokens of each prompt."""


class Embed(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Rerank(Protocol):
    def rerank(self, query: str, texts: list[str]) -> list[float]: ...


class HashedGrams:
    """Vectors of counted character trigrams in hashed places, of length 1."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for i in range(max(0, len(t) - 2)):
                v[int.from_bytes(hashlib.blake2b(t[i : i + 3].lower().encode(), digest_size=4).digest(), "little") % self.dim] += 1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out


class WordOverlap:
    """Relevance as the share of the query's words that a text has."""

    def rerank(self, query: str, texts: list[str]) -> list[float]:
        asked = set(query.lower().split())
        return [len(asked & set(t.lower().split())) / max(1, len(asked)) for t in texts]


class NoModel:
    """A chat model that never answers, so every caller takes its fallback."""

    def chat(self, prompts: list[str]) -> list[tuple[str, int, int]]:
        return [("", 0, 0)] * len(prompts)


class Scripted:
    """A chat model that gives the reply of the first mark that a prompt has, and counts characters as tokens."""

    def __init__(self, replies: list[tuple[str, str]]):
        self.replies = replies

    def chat(self, prompts: list[str]) -> list[tuple[str, int, int]]:
        found = [next((r for mark, r in self.replies if mark in p), "") for p in prompts]
        return [(r, len(p), len(r)) for p, r in zip(prompts, found, strict=True)]


def _tried(call: Callable, rows: list, empty, tries: int = 3):
    """call(rows), tried again after a while; rows of empty if it always fails."""
    for n in range(tries):
        try:
            return call(rows)
        except Exception:  # noqa: BLE001  any failure of a service is an empty reply
            if n + 1 < tries:
                time.sleep(WAIT * 2**n)
    return [empty] * len(rows)


class _Made:
    """A provider that is made at its first call, so that a failure to make it is a failure of that call."""

    def __init__(self, make: Callable):
        self.make, self.made = make, None

    def __getattr__(self, name: str):
        def call(*given):
            self.made = self.made or self.make()
            return getattr(self.made, name)(*given)

        return call


@dataclass
class Replies:
    """The replies of a model, in a folder: one row for each prompt that was sent, with the run and the stage that sent it.

    Failed calls are not kept.  Replies are stored in parts of so many prompts, each there whole or
    not at all, so what a stopped run has paid for is kept but for its last part.
    """

    spark: SparkSession
    path: str
    model: str = ""
    run: str = field(default_factory=lambda: uuid.uuid4().hex)

    SCHEMA = "key string, reply string, prompt_tokens long, completion_tokens long, run string, stage string, part string"

    @staticmethod
    def temporary(spark: SparkSession) -> Replies:
        return Replies(spark, scratch_path(spark, "replies"))

    def kept(self) -> DataFrame:
        """All rows; runs at the same time may have sent a prompt twice."""
        root = f"{self.path}/run=none/stage=none/part=none"
        if not is_complete(self.spark, root):
            self.spark.createDataFrame([], "key string, reply string, prompt_tokens long, completion_tokens long").write.mode("overwrite").parquet(root)
        return self.spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(f"{self.path}/*/*/*")

    def known(self) -> DataFrame:
        """(key, reply, prompt_tokens, completion_tokens), one row for each key."""
        one = F.min(F.struct("reply", "prompt_tokens", "completion_tokens")).alias("r")
        return self.kept().groupBy("key").agg(one).select("key", "r.*")

    def spent(self) -> DataFrame:
        """(run, stage, calls, prompt_tokens, completion_tokens): what was sent and what it cost."""
        return self.kept().groupBy("run", "stage").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))

    def ask(self, prompts: DataFrame, make: Callable[[], Chat], stage: str, batch: int, workers: int) -> None:
        """Send the prompts (key, prompt; a key once) that have no reply, and keep what comes back."""
        fresh = prompts.join(self.known().select("key"), "key", "left_anti")
        slices = -(-fresh.count() // STORED)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = _Made(make)
            for f in frames:
                got = []
                for i in range(0, len(f), batch):
                    got += _tried(model.chat, f["prompt"].iloc[i : i + batch].tolist(), None)
                rows = [(k, *g) for k, g in zip(f["key"], got, strict=True) if g is not None]
                yield pd.DataFrame(rows, columns=["key", "reply", "prompt_tokens", "completion_tokens"])

        for n in range(slices):
            mine = fresh.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == n).repartition(workers, "key").select("key", "prompt")
            part = f"{self.path}/run={self.run}/stage={stage}/part={uuid.uuid4().hex}"
            mine.mapInPandas(run, "key string, reply string, prompt_tokens long, completion_tokens long").write.parquet(part)


def with_chat(df: DataFrame, prompt_col: str, make: Callable[[], Chat] = NoModel, replies: Replies | None = None, stage: str = "chat", batch: int = 10, workers: int = 5) -> DataFrame:
    """df with reply, prompt_tokens and completion_tokens; a null prompt is not sent and has an empty reply.

    Replies are there when this returns.  Of rows with one prompt, which is sent once, the first has its tokens; a reply
    that was kept before has the tokens that it cost then.
    """
    none = {"reply": F.lit(""), "prompt_tokens": F.lit(0).cast("long"), "completion_tokens": F.lit(0).cast("long")}
    if make is NoModel:
        return df.withColumns(none)
    ship(df.sparkSession)
    replies = replies or Replies.temporary(df.sparkSession)
    key = F.when(F.col(prompt_col).isNotNull(), F.sha2(F.concat_ws("\x1f", F.lit(replies.model), F.col(prompt_col)), 256))
    asked = written(df.withColumns({"_key": key, "_row": F.monotonically_increasing_id()}), "prompts")
    distinct = asked.where("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.first(prompt_col).alias("prompt"), F.min("_row").alias("first"))
    replies.ask(distinct.select("key", "prompt"), make, stage, batch, workers)
    got = distinct.select("key", "first").join(replies.known(), "key").withColumnRenamed("key", "_key")
    first = lambda c: F.when(F.col("_row") == F.col("first"), F.col(f"r.{c}"))
    got = got.select("_key", "first", F.struct("reply", "prompt_tokens", "completion_tokens").alias("r"))
    out = asked.join(got, "_key", "left").select(*df.columns, *[F.coalesce(c, none[n]).alias(n) for n, c in (("reply", F.col("r.reply")), ("prompt_tokens", first("prompt_tokens")), ("completion_tokens", first("completion_tokens")))])
    return out


def with_embedding(df: DataFrame, text_col: str, make: Callable[[], Embed] = HashedGrams, dim: int = 256, batch: int = 10) -> DataFrame:
    """df with embedding; a vector of the wrong length is asked for once more and then zeros."""
    ship(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _Made(make)
        for f in frames:
            texts, got = f[text_col].fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                vectors = _tried(model.embed, part, [])
                got += [v if len(v) == dim else ([*_tried(model.embed, [t], []), []][0] or []) for v, t in zip(vectors, part, strict=True)]
            yield f.assign(embedding=[v if len(v) == dim else [0.0] * dim for v in got])

    return df.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", embedding array<float>")


def reranked(hits: DataFrame, make: Callable[[], Rerank] = WordOverlap, k: int = 5) -> DataFrame:
    """The k most relevant hits (target, query, text, score, ord) of each target; if the model fails, the first k by their own score."""
    ship(hits.sparkSession)
    fields = hits.dtypes

    def run(f: pd.DataFrame) -> pd.DataFrame:
        got = _tried(lambda texts: make().rerank(f["query"].iloc[0], texts), f["text"].tolist(), None)
        rerank = f["score"] if None in got else pd.Series(got, index=f.index)
        return f.assign(rerank_score=rerank.astype(float)).sort_values(["rerank_score", "ord"], ascending=[False, True]).head(k)

    return hits.groupBy("target").applyInPandas(run, ", ".join(f"`{c}` {t}" for c, t in fields) + ", rerank_score double")  # a group is one target's coarse hits
