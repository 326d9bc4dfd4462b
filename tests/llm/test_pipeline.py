from __future__ import annotations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near(a, b):
    """Set Jaccard of five-word shingles, by the definition."""
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in (a, b))
    return len(x & y) >= 0.8 * len(x | y) if x and y else False


def test_stages_equal_brute_force(spark, tmp_path):
    """200 documents with shared passages and near copies, a null id, repeated rows, empty texts and clashing columns."""
    rng = np.random.default_rng(21)
    passages = [[" ".join(f"p{k}l{j}w{i}" for i in range(18)) for j in range(3)] for k in range(8)]
    rows: list[tuple[int | None, str | None]] = []
    for i in range(180):
        if i % 6 == 5:
            words = rows[int(rng.integers(i))][1].split("\n")[0].split()
            words[int(rng.integers(len(words)))] = f"edit{i}"
            rows.append((i, " ".join(words)))
        else:
            lines = [" ".join(f"d{i}w{k}" for k in range(90))]
            lines += passages[int(rng.integers(8))] if rng.random() < 0.3 else []
            rows.append((i, "\n".join([*lines, f"end of {i}"])))
    rows += [(500, None), (501, ""), (None, rows[0][1]), (3, rows[3][1]), (None, None)]
    d = str(tmp_path)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(180)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{d}/labels.parquet")
    extra = [(i, t, "en", "s", len(t or ""), f"x{n}", [n], f"n{n}", n) for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(extra, SCHEMA + ", _id string, removed_lines array<int>, node string, label long")
    clean = corpus_pipeline.reject_toxic(spark, docs, d)
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))

    order = sorted({(2**62 if i is None else i, t) for i, t in rows if t}, key=lambda r: r[0])
    seen: set[tuple[str, ...]] = set()
    left: dict[tuple[int, str], str] = {}
    for i, t in order:
        lines = t.split("\n")
        runs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if sum(len(x.split()) for x in lines[a:b]) >= 40]
        gone = {k for a, b in runs if tuple(lines[a:b]) in seen for k in range(a, b)}
        seen |= {tuple(lines[a:b]) for a, b in runs}
        left[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    want = [(i, left[2**62 if i is None else i, t] if t else t) for i, t in rows]
    want = [(i, t) for (i, t), (_, before) in zip(want, rows, strict=True) if t or not before]
    out = corpus_pipeline.dedup_lines(spark, docs, d)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(i), str(t)) for i, t in want)
    assert all(r["n_chars"] == len(r["text"] or "") and r["removed_lines"] == [r["label"]] for r in got if r["text"] is not None)

    parent = list(range(len(want)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(want)):
        for j in range(i):
            if near(want[i][1], want[j][1]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups: dict[int, list[int]] = {}
    for i in range(len(want)):
        groups.setdefault(root(i), []).append(i)
    best = [min(g, key=lambda k: (want[k][0] is None, want[k][0] or 0)) for g in groups.values()]
    kept = corpus_pipeline.dedup_documents(spark, out, d)
    assert kept.columns == docs.columns and len(groups) < len(want) - 10
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted((str(want[k][0]), str(want[k][1])) for k in best)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in kept.collect() if r["doc_id"] is not None}
    total: dict[int, int] = {}
    for r in corpus_pipeline.pack(spark, kept, d).collect():
        if r["doc_id"] is not None:
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == size


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_stages_take_their_decisions(spark, tmp_path):
    passage = " ".join(f"shared{k}" for k in range(60))
    plain = lambda i, n=80: " ".join(f"d{i}w{k}" for k in range(n))
    rows = [(i, plain(i)) for i in range(40)]
    rows += [(100 + i, plain(100 + i) + " vile vile") for i in range(40)]
    rows += [(200, f"{plain(200)}\n{passage}"), (201, f"{plain(201)}\n{passage}"), (202, plain(0) + " tail"), (203, plain(1)), (204, None), (205, "")]
    labels = [(i, 1, int(100 <= i < 200)) for i, _ in rows]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/{k}")
        out = spark.read.parquet(f"{d}/{k}")
        if k < 3:
            assert out.columns == docs.columns, name
        seen.append({r["doc_id"]: r["text"] if k < 3 else None for r in out.collect()})
        docs = out if k < 3 else docs
    everything = {i for i, _ in rows}
    assert set(seen[0]) == {i for i in everything if not 100 <= i < 200}
    assert seen[1][200].endswith("shared59") and seen[1][201] == plain(201)
    assert set(seen[1]) == set(seen[0]) - {203}
    assert set(seen[2]) == set(seen[1]) - {202}
    assert set(seen[3]) == set(seen[2])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).select("doc_id").distinct().collect()} == set(seen[3])
