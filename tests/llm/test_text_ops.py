from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from longleaf.llm import bpe, common, hashing, linedup, neardup, packing, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)
ODD = ["", " ", "  a", "a\n\nb ", "don't I'll", "x" * 300, "aaaaaaaaaaaaa", "中文 字", "é ß　😀", "a<|endoftext|>b <|endoftext|>", "\x1c\x85\t\r\n", "12 345 ²½", "word " * 3000]
ROWS = [(1, "one two three"), (2, None), (None, "lost id"), (3, ""), (4, "one two three"), (4, "one two three"), (5, "w " * 5000)]


def reference(text):
    return REFERENCE.encode(text or "", add_special_tokens=False).ids


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, ids long, node string")


@pytest.mark.parametrize("dp", [True, False])
def test_encoders_equal_the_tokenizers_library(dp):
    enc = bpe.text_encoder(PATH, dp)
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.batch(ODD)] == [reference(t) for t in ODD]


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'srelmdvt.,!aé中😀 　"), st.characters(codec="utf-8")), max_size=40))
def test_any_text_is_encoded_exactly_and_decodes_to_itself(text):
    for dp in (True, False):
        ids = np.frombuffer(bpe.text_encoder(PATH, dp).ids(text), "<u4")
        assert ids.tolist() == reference(text)
        if "<|" not in text:
            assert bpe.decode_bytes(ids, bpe.vocabulary(PATH).table()).decode() == text


def test_round_trip_and_columns(spark):
    for r, (i, t) in zip(bpe.round_trip(docs(spark)).collect(), ROWS, strict=True):
        ids = reference(t)
        assert (r["doc_id"], r["n_tokens"]) == (i, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    both = bpe.decode(bpe.encode(docs(spark)))
    assert [r["decoded"] for r in both.collect()] == [t or "" for _, t in ROWS]
    assert bpe.round_trip(docs(spark).limit(0)).count() == 0


def check_pieces(rows, pieces, size=1024):
    ids = sorted((*([i] if i is not None else [-1]), tuple([*reference(t), 0])) for i, t in rows)
    whole: dict = {}
    rooms: dict = {}
    for p in pieces:
        whole.setdefault((p["doc_id"] if p["doc_id"] is not None else -1, p["doc_tokens"]), []).append(p)
        rooms.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sum(p["length"] for p in pieces) == sum(len(x) for _, x in ids)
    for (i, n), mine in whole.items():
        same = [x for k, x in ids if k == i and len(x) == n]
        assert sum(p["length"] for p in mine) == n * len(same)
        for p in mine:
            assert zlib.crc32(np.array(same[0][p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
    for used in rooms.values():
        at = 0
        for offset, length in sorted(used):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(rooms)


def test_packing_covers_every_id_once(spark):
    check_pieces(ROWS, packing.pack(docs(spark)).collect())
    many = [(i, "word " * (i * 37 % 900)) for i in range(300)]
    n = check_pieces(many, packing.pack(docs(spark, many)).collect())
    assert n <= -(-sum(len(reference(t)) + 1 for _, t in many) // 1024) + 3
    assert packing.pack(docs(spark).limit(0)).count() == 0


def test_cutting_stock_is_near_the_least_number():
    rng = np.random.default_rng(1)
    lengths, n = np.unique(rng.integers(1, 200, 20_000), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist(), strict=True))
    patterns = packing.cutting_stock(counts, 256)
    assert all(sum(k * t for k, t in p.items()) <= 256 for p, _ in patterns)
    for length, need in counts.items():
        assert sum(p.get(length, 0) * x for p, x in patterns) == pytest.approx(need, rel=1e-6)
    assert sum(x for _, x in patterns) <= 1.02 * sum(k * t for k, t in counts.items()) / 256


def test_most_tails_are_placed_by_patterns():
    rng = np.random.default_rng(6)
    for n in (1000, 20_000):
        counts = dict(Counter(np.minimum(1023, rng.geometric(1 / 300, n)).tolist()))
        places = packing.Places(counts, 1024, 8)
        assert sum(int(places.used[k]) for k in counts) >= 0.9 * n
        assert places.sequences <= 1.01 * sum(k * c for k, c in counts.items()) / 1024 + 1


@settings(deadline=None, max_examples=100)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), min_size=1, max_size=6))
def test_fullest_pattern_equals_a_plain_search(left):
    got = packing.fullest(left, 40)
    assert all(k <= left[n] for n, k in got.items()) and got.get(max(left), 0) >= 1
    sums = {max(left)}
    for n, k in left.items():
        sums |= {s + n * m for s in list(sums) for m in range(1, k + 1 - (n == max(left))) if s + n * m <= 40}
    assert sum(n * k for n, k in got.items()) == max(sums)


def test_sequences_are_lossless(spark):
    rows = sequences.pack_sequences(docs(spark), size=256).collect()
    matrix = sequences.matrix_of(rows, 256)
    found: dict = {}
    for r, cells in zip(rows, matrix, strict=True):
        assert r["cu_seqlens"][0] == 0 and len(r["cu_seqlens"]) == len(r["doc_ids"]) + 1
        places = np.frombuffer(r["position_ids"], "<u2")
        for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            assert places[a:b].tolist() == list(range(b - a))
            found.setdefault(d, []).append((s, cells[a:b].tolist()))
    for i in {i for i, _ in ROWS}:
        want = sorted(x for k, t in ROWS if k == i for x in reference(t))
        assert sorted(x for _, part in found.get(i, []) for x in part) == want


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(1, 32), max_size=200))
def test_best_fit_equals_a_plain_search(lengths):
    row, offset, rows = sequences.best_fit_decreasing(np.array(lengths, np.int64), 32)
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(32 - n)
    assert rows == len(rooms)
    assert sorted((r, o) for r, o in zip(row.tolist(), offset.tolist(), strict=True)) == sorted(set(zip(row.tolist(), offset.tolist(), strict=True)))


def shingles_of(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for base in range(12):
        words = [f"b{base}w{k}" for k in range(120)]
        for copy in range(6):
            mine = list(words)
            for k in rng.integers(0, 120, copy):
                mine[k] = f"x{rng.integers(1_000_000)}"
            rows.append((10 * base + copy, " ".join(mine)))
    rows += [(500, ""), (501, None), (502, "one two"), (503, "one two"), (504, "one  two"), (505, "three"), (None, rows[0][1]), (0, rows[0][1])]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles_of(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = sorted((-1 if rows[i][0] is None else rows[i][0], min(r[0] for k, r in enumerate(rows) if root(k) == root(i) and r[0] is not None)) for i in range(len(rows)))
    got = neardup.near_duplicates(docs(spark, rows)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["class_id"]) for r in got) == want
    kept = neardup.keep_one(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "ids", "node"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want})
    assert neardup.near_duplicates(docs(spark).limit(0)).count() == 0


def test_signatures_estimate_the_similarity():
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" for i in range(40, 440))
    s, some = neardup.prob_minhash([a, b, "", "one"], 4000, 5)
    exact = neardup.jaccard([a], [b], 5)[0]
    assert abs((s[0] == s[1]).mean() - exact) < 0.04 and some.tolist() == [True, True, False, True]
    x, y = a + " " + " ".join(["the same old line once more"] * 60), b + " the same old line once more"
    s, _ = neardup.prob_minhash([x, y], 4000, 5)
    assert abs((s[0] == s[1]).mean() - neardup.jaccard([x], [y], 5)[0]) < 0.04


def plain_probability_jaccard(a, b):
    """By the definition, over counted shingles."""
    w, w2 = ({k: 1 + np.log(n) for k, n in c.items()} for c in (a, b))
    return sum(1 / sum(max(w.get(y, 0) / w[x], w2.get(y, 0) / w2[x]) for y in {*w, *w2}) for x in w.keys() & w2.keys())


def counted(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


@settings(deadline=None, max_examples=100)
@given(st.lists(st.sampled_from("abc"), min_size=5, max_size=60), st.lists(st.sampled_from("abc"), min_size=5, max_size=60))
def test_exact_measure_follows_its_definition(a, b):
    a, b = " ".join(a), " ".join(b)
    assert abs(neardup.jaccard([a], [b], 5)[0] - plain_probability_jaccard(counted(a), counted(b))) < 1e-9


def test_near_duplicates_with_repeats_equal_brute_force(spark):
    """300 documents, many with passages that repeat, all pairs: every link by the definition is found."""
    rng = np.random.default_rng(8)
    rows = []
    for base in range(30):
        words = [f"b{base}w{k}" for k in range(60)]
        for copy in range(10):
            mine = list(words)
            for k in rng.integers(0, 60, rng.integers(0, 4)):
                mine[k] = f"x{rng.integers(1_000_000)}"
            again = [f"b{base}r{k}" for k in range(8)] * int(rng.integers(0, 30))
            rows.append((len(rows), " ".join(mine + again)))
    sets = [counted(t) for _, t in rows]
    links = [(i, j) for i in range(300) for j in range(i) if sets[i].keys() & sets[j].keys() and plain_probability_jaccard(sets[i], sets[j]) >= 0.8]
    parent = list(range(300))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert len(links) > 200 and got == {i: root(i) for i in range(300)}


def test_parted_rows_are_all_there_once(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"k{i % 50}", "x") for i in range(200)] + [(None, None, "x")], "doc_id long, key string, _word string")
    marks = spark.createDataFrame([("k3",), ("k7",), (None,)], "key string")
    for bits in (common.MAP_BITS, 64):
        monkeypatch.setattr(common, "MAP_BITS", bits)
        whole, rest = common.parted(df, marks, ["key"])
        assert whole.columns == rest.columns == df.columns
        assert sorted(str(tuple(r)) for r in whole.union(rest).collect()) == sorted(str(tuple(r)) for r in df.collect())
        assert {"k3", "k7", None} <= {r["key"] for r in rest.collect()} and (bits == 64 or rest.count() == 9)
    whole, rest = common.parted(df, marks.limit(0), ["key"])
    assert (whole.count(), rest.count()) == (201, 0)


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "X", "n", True), (2, "a b c d e f", "Y", "m", False), (3, None, None, None, None)], "doc_id long, text string, _id string, _node string, stays boolean")
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} == {(1, "a b c d e f", "X", "n", True), (3, None, None, None, None)}


def test_a_block_gives_only_true_links():
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[:k], "zz", *base[k + 1 :]]) for k in range(0, 100, 10)] + ["other words " * 20]
    members = [{"node": bytes([i]), "comp": bytes([i]), "open": True, "keys": [i, 7], "text": t} for i, t in enumerate(texts)]
    want = {(i, j) for i in range(11) for j in range(11) if i != j and neardup.jaccard([texts[i]], [texts[j]], 5)[0] >= 0.8}
    got = {(a[0], b[0]) for a, b in neardup.linked(members, members, 7, 0.8, 5)}
    assert neardup.linked(members, members, 3, 0.8, 5) == []  # each shares that band with itself only
    earlier = [m | {"keys": [1, 7]} for m in members]
    assert neardup.linked(earlier, earlier, 7, 0.8, 5) == [] and len(neardup.linked(earlier, earlier, 1, 0.8, 5)) == 9
    assert got <= want and len(got) == 9 and {i for p in got for i in p} == {i for p in want for i in p}


def test_shingle_hashes_follow_words():
    h, owner, n = hashing.shingle_sets(["a b c d e f", "a  b\nc d e f", "a b", "", "a a a a a a a"])
    assert sorted(h[owner == 0].tolist()) == sorted(h[owner == 1].tolist()) and (owner == 2).sum() == 1 and (owner == 3).sum() == 0
    assert n[owner == 4].tolist() == [3]


def test_sequences_of_nothing_and_of_ids_too_large(spark):
    assert sequences.pack_sequences(docs(spark).limit(0)).count() == 0
    assert sequences.pack_sequences(docs(spark, [(1, None), (2, "")])).count() == 0
    with pytest.raises(ValueError, match="wide"):
        sequences.pack_sequences(docs(spark), size=70_000)
    assert sequences.pack_sequences(docs(spark), size=70_000, wide=True).count() > 0


LONG = [" ".join(f"{c}{k}" for k in range(45)) for c in "pqrs"]


def test_repeated_blocks_go_from_later_documents(spark):
    rows = [(1, f"intro one\n{LONG[0]}\n{LONG[1]}\nend"), (2, f"other\n{LONG[1]}\n{LONG[0]}"), (3, f"{LONG[2]}\nshort line"), (4, "short line\nmore"), (5, f"x\n {LONG[2]} \ny"), (6, None), (7, ""), (None, LONG[0]), (8, f"{LONG[3]}"), (8, f"{LONG[3]}")]
    out = linedup.drop_repeated_lines(docs(spark, rows))
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert out.columns == ["doc_id", "text", "ids", "node", "removed_lines"] and out.count() == len(rows)
    assert got == {(1, rows[0][1]), (2, "other"), (3, rows[2][1]), (4, rows[3][1]), (5, "x\ny"), (6, None), (7, ""), (None, ""), (8, LONG[3])}
    assert linedup.drop_repeated_lines(docs(spark).limit(0)).count() == 0


def test_a_chain_of_short_lines_hides_no_moved_passage():
    owner, later = [9, 11, 1, 12, 2, 13], [20, 1, 21, 2, 22, 9]
    assert linedup.common_blocks(later, [3, 3, 3, 3, 3, 60], owner, 40) == [5]


def test_a_passage_is_found_though_others_own_its_lines(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(17)) for c in "abc")
    rows = [(1, f"{one}\n{two}"), (2, f"{two}\n{three}"), (3, f"x\n{one}\n{two}\n{three}"), (4, f"{one}\n{two}\n{three}\ny")]
    got = {r["doc_id"]: r["removed_lines"] for r in linedup.drop_repeated_lines(docs(spark, rows)).collect()}
    assert got == {1: [], 2: [], 3: [], 4: [0, 1, 2]}


def test_three_lines_of_three_owners_are_one_passage(spark):
    lines = [" ".join(f"{c}{i}" for i in range(20)) for c in "abc"]
    rows = [(k + 1, line) for k, line in enumerate(lines)] + [(10, "x\n" + "\n\n".join(lines)), (11, "\n \n".join(lines) + "\n\ny")]
    got = {r["doc_id"]: r["text"] for r in linedup.drop_repeated_lines(docs(spark, rows)).collect()}
    assert got == {**dict(rows), 11: "\ny"}


def test_line_deduplication_equals_brute_force(spark):
    """A line goes exactly if it lies in a run of 40 words or more that an earlier document has (300 documents)."""
    rng = np.random.default_rng(9)
    pool = [" ".join(f"l{k}w{i}" for i in range(int(rng.integers(3, 30)))) for k in range(60)]
    passages = [[pool[k] for k in rng.integers(0, 60, 4)] for _ in range(25)]
    rows = []
    for i in range(300):
        mine = []
        for _ in range(4):
            mine += passages[rng.integers(25)] if rng.random() < 0.3 else [pool[rng.integers(60)], f"own{rng.integers(10**9)}"]
            mine += [""] * int(rng.integers(0, 2))
        rows.append((i, "\n".join(mine)))
    split = [[(k, x) for k, x in enumerate(t.split("\n")) if x.strip()] for _, t in rows]
    seen: set[tuple[str, ...]] = set()
    want = {}
    for i, said in enumerate(split):
        runs = [(a, b) for a in range(len(said)) for b in range(a + 1, len(said) + 1) if sum(len(x.split()) for _, x in said[a:b]) >= 40]
        want[i] = {said[k][0] for a, b in runs if tuple(x for _, x in said[a:b]) in seen for k in range(a, b)}
        seen |= {tuple(x for _, x in said[a:b]) for a, b in runs}
    got = {r["doc_id"]: {k for k in r["removed_lines"] if rows[r["doc_id"]][1].split("\n")[k].strip()} for r in linedup.drop_repeated_lines(docs(spark, rows)).collect()}
    assert got == want and sum(map(len, want.values())) > 300


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(1, 5), max_size=20), st.lists(st.integers(1, 5), max_size=20))
def test_every_common_block_is_found(a, b):
    words = [(0, 3, 5, 10, 17, 25)[h] for h in a]
    got = linedup.common_blocks(a, words, b, 40)
    runs = {tuple(b[j:k]) for j in range(len(b)) for k in range(j + 1, len(b) + 1)}
    blocks = [range(i, k) for i in range(len(a)) for k in range(i + 1, len(a) + 1) if sum(words[i:k]) >= 40 and tuple(a[i:k]) in runs]
    every = {i for r in blocks for i in r}
    assert {i for i in every if words[i]} <= set(got) <= every


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25))
def test_alignment_is_a_common_subsequence(a, b):
    got = linedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    if a == b:
        assert len(got) == len(a)


def test_members_closed_by_a_chain_meet_open_ones(spark):
    state = spark.createDataFrame([(0, True, 0.45, 0.45), (1, False, 0.55, 0.45), (2, False, 0.66, 0.45), (3, False, 1.0, 0.8), (4, False, 0.3, 0.1)], "n int, open boolean, j double, reach double")
    assert [r["n"] for r in state.where(neardup.near_enough(0.8)).orderBy("n").collect()] == [0, 1, 3, 4]
