"""The filter audit against brute force, and the segment-tree encoder against the tiktoken library."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from longleaf.llm import bpe, bpetree, common, filteraudit
from longleaf.llm.queries import op13_bpetree


def brute_audit(docs: list[tuple], labels: list[tuple]) -> dict[tuple, tuple]:
    """Every order gone through row by row."""
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    rows = []
    for doc_id, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = doc_id is not None and any(d is not None and d < doc_id and (x or "") == t for d, x, _ in docs)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": smaller}
        rows.append((lang or "", {k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in rows if r[0] == part and f in r[1]]
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in filteraudit.audit(docs, labels).collect()}


def test_audit_equals_going_through_the_orders(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Ab", "cd", "EF", "x#", "é"] + [f"w{i}" for i in range(150)]) for _ in range(rng.choice((5, 99, 100, 130)))) for _ in range(25)] + [None, "", "SHOUT", "a | b", "same " * 120, "line\nbreak\x0b tab\t" * 60]
    rows = [(rng.randrange(60), rng.choice(texts), rng.choice(("en", "de", "", None))) for _ in range(150)]
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (0, "copy", "en"), (0, "copy", "de"), (1, "copy", "en"), (-5, texts[0], None)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 70, 2)] + [(4, 1, 0), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, digest string, good int")
    known = spark.createDataFrame([(*r, 7) for r in labels], "doc_id long, quality int, toxic int, mask int")
    got, want = audited(docs, known), brute_audit(rows, labels)
    assert got == want and len(got) == 3 * 600


def test_audit_of_many_copies_and_of_nothing(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"), F.lit(None).cast("string").alias("lang"))
    labels = spark.createDataFrame([(0, 1, 0), (2999, 0, 1)], "doc_id long, quality int, toxic int")
    got = audited(docs, labels)
    assert got["", "EABCD", 1] == (1, 2999, 0, 0, 0, 1, 2999 * 60 + 0) and got["", "EABCD", 2][:3] == (0, 1, 2999)
    assert filteraudit.audit(docs.limit(0), labels).count() == 0
    assert audited(docs, labels.limit(0))["", "ABCDE", 1][4:6] == (0, 0)


def test_parity_sums_are_their_own_inverse():
    counts = np.random.default_rng(1).integers(0, 10**12, 32)
    assert ((filteraudit.parities() @ (filteraudit.parities() @ counts)) // 32 == counts).all()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = bpetree.ranks_of(common.tokenizer_path(bpetree.RANKS)).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts: list[str]) -> list[list[int]]:
    path = common.tokenizer_path(bpetree.RANKS)
    return [np.frombuffer(b, "<u4").tolist() for b in bpetree.encoder_of(path).batch(texts)]


def test_ids_are_the_librarys(library):
    rng = random.Random(3)
    texts = ["", "a" * 5000, "ab" * 3000 + " " * 50 + "x", "\x1c \x85 　 x\n\n\n  y", " \n \t ", "<|endoftext|> hi", "日本語" * 200, "don't we'll I'M", "\x00﻿‍", "x" * 63 + " " + "y" * 64 + " " + "z" * 65]
    texts += ["".join(rng.choice("abcdeé 日\n'") for _ in range(rng.randrange(1, 80))) for _ in range(2000)]
    texts.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0x1F000, 0x1F900)])) for _ in range(20000)))
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids_of_any_text_are_the_librarys(library, text):
    assert ids_of([text]) == [library.encode_ordinary(text)]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=64))
def test_trees_side_by_side_and_alone_are_the_merge_loop(piece):
    """The rule itself: join the leftmost pair of the least rank until none is a token."""
    r = bpetree.ranks_of(common.tokenizer_path(bpetree.RANKS))
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((r.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    want = [r.ranks[p] for p in parts]
    size = 1 << (len(piece) - 1).bit_length()
    side = bpetree.merge_side([piece, b"a" * size, piece[:1]], max(size, 2), r)
    assert bpetree.merge_long(piece, r) == want == np.frombuffer(side[0], "<u4").tolist()


def test_round_trip_of_rows(spark, tmp_path, library):
    rows = [(1, "hello  world", "k"), (1, None, "k"), (None, "naïve café — 日本", "k"), (2, "", "k"), (3, "zq" * 40_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op13_bpetree(spark, str(tmp_path)).collect())
    each = [(i or 0, library.encode_ordinary(t or ""), t or "") for i, t, _ in rows]
    assert got == sorted((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in each)
    out = bpetree.decode(bpetree.encode(docs.withColumn("ids", F.lit(0))), "ids", "decoded")
    assert sorted(r["decoded"].decode() for r in out.collect()) == sorted(t or "" for _, t, _ in rows)
    assert bpetree.round_trip(docs.limit(0)).count() == 0
    assert bpe.PATTERN == __import__("public_tokenizers").PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
