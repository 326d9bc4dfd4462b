"""Toxicity by a bidirectional gated recurrent network with attention, trained and run in numpy.

Each word is a vector from its own table (frequent training words only) joined to the mean of the
vectors of its character trigrams.  Two gated recurrent layers read a window of words in both
directions, attention pools their states, and a logistic unit gives the window's score.  A
document's score is that of its highest window; windows overlap and cover the whole text.

Training sees only labelled rows outside the held-out fifth, at most ``sample`` documents of each
label, those with the smallest hash of their id (one text of each id).  Word vectors start from the smoothed log-odds of
the word in that sample; of a toxic document the window with the highest log-odds is learned, of a
clean one that window and another.  Executors count the sample's words, cut its windows and score
it; only frequent words, windows (of at most ``WINDOW_CHARS`` characters; longer ones are not
learned) and scores come to the driver.  The threshold is the one that errs least on the
sample, and scores are scaled to be its likeliest probabilities.

Cases: null and empty texts, and others without words, are clean; very long texts are scored
in full; rows repeat as in the input; a null id counts as held out; contradicting labels of one id
count as toxic; without labels of both kinds every score is 0; an empty table gives no rows; other columns
are not read, whatever their names, and keep_clean hands them on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longleaf.llm.common import Tables, map_arrow, text_blocks, texts
from longleaf.llm.hashing import mix
from longleaf.session import ship

WINDOW, STRIDE, STATE, WORD_DIM, CHAR_DIM, ATTEND, TRIGRAMS = 64, 48, 12, 8, 8, 8, 4096
#: Logit of a window without words, and what a trigram's vector keeps in a step of training.
CLEAN, DECAY = -30.0, 0.97
#: Characters that are read at once, and those of a window that is learned from at most.
BLOCK_CHARS, WINDOW_CHARS = 1_000_000, 20_000
_ASCII = np.zeros(128, bool)
_ASCII[[*range(48, 58), *range(97, 123)]] = True


def split_words(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of the lower-case texts; start, size, hash and text of every word (run of ASCII letters and digits and of other characters)."""
    lower = [v.lower() for v in values]
    data = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = data >= 128
    low = np.flatnonzero(~letter)
    letter[low] = _ASCII[data[low]]
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return data, start, start, np.zeros(0, np.uint64), start
    size = stop - start
    at = np.flatnonzero(letter)
    pos = at - np.repeat(start, size)
    powers = np.multiply.accumulate(np.full(int(size.max()), 0xD6E8FEB86659FD93, np.uint64))
    h = mix(np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * powers[pos], np.concatenate([[0], np.cumsum(size)[:-1]])))
    return data, start, size, h, np.searchsorted(np.cumsum([len(t) + 1 for t in lower]), start, side="right")


def trigrams(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each character trigram of each word (edges marked), and the word it is of."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(start)), size)
    at = np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    first, last = at == start[owner], at == (start + size - 1)[owner]
    left = np.where(first, 1, data[np.maximum(at - 1, 0)]).astype(np.uint64)
    right = np.where(last, 2, data[np.minimum(at + 1, len(data) - 1)]).astype(np.uint64)
    return (mix(left << np.uint64(42) | data[at].astype(np.uint64) << np.uint64(21) | right) % np.uint64(TRIGRAMS)).astype(np.int64), owner


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word (within its text) and text of every window; each text has one at least."""
    n = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), n)
    return (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE, text


@dataclass
class Model:
    known: np.ndarray  # sorted hashes of the words with vectors of their own
    p: dict[str, np.ndarray]
    scale: float = 1.0
    middle: float = 0.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _parameters(rng: np.random.Generator, odds: np.ndarray) -> dict[str, np.ndarray]:
    d, h = WORD_DIM + CHAR_DIM, STATE
    make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"word": (0.05 * rng.standard_normal((len(odds) + 1, WORD_DIM))).astype(np.float32), "char": (0.05 * rng.standard_normal((TRIGRAMS, CHAR_DIM))).astype(np.float32)}
    p["word"][:-1, 0] += odds
    p["word"][-1] = 0
    for s in "fb":
        p |= {f"W{s}": make(d, 3 * h), f"U{s}": make(h, 3 * h), f"c{s}": np.zeros(3 * h, np.float32)}
    return p | {"A": make(2 * h, ATTEND), "v": make(ATTEND, 1)[:, 0], "w": make(2 * h, 1)[:, 0], "b": np.zeros(1, np.float32)}


def _layer(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of a gated recurrent layer; x: input projections (time, window, 3 x state), mask: (time, window, 1)."""
    n = STATE
    h = np.zeros((x.shape[1], n), np.float32)
    out = np.empty((len(x), x.shape[1], n), np.float32)
    for t in range(len(x)):
        a = h @ u
        g = _sigmoid(x[t, :, : 2 * n] + a[:, : 2 * n])
        z, r = g[:, :n], g[:, n:]
        c = np.tanh(x[t, :, 2 * n :] + r * a[:, 2 * n :])
        new = c + z * (h - c)
        if keep is not None:
            keep.append((h, z, r, c, a[:, 2 * n :]))
        h = out[t] = h + mask[t] * (new - h)
    return out


def _pool(s: np.ndarray, mask: np.ndarray, p: dict[str, np.ndarray]):
    k = np.tanh(s @ p["A"])
    e = np.where(mask[:, :, 0] > 0, k @ p["v"], -1e4)
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = (a[:, :, None] * s).sum(axis=0)
    return k, a, pooled, pooled @ p["w"] + p["b"][0]


class Inputs:
    """The distinct words of a block of texts, and the windows over them."""

    def __init__(self, values: list[str], known: np.ndarray):
        data, start, size, h, text = split_words(values)
        distinct, first, self.index = np.unique(h, return_index=True, return_inverse=True) if len(h) else (h, start, start)
        self.hashes = distinct
        self.gram, self.gram_of = trigrams(data, start[first] if len(h) else start, size[first] if len(h) else size)
        self.count = np.bincount(self.gram_of, minlength=len(distinct)).astype(np.float32)
        at = np.searchsorted(known, distinct)
        at = np.minimum(at, max(len(known) - 1, 0))
        self.word = np.where(known[at] == distinct, at, len(known)) if len(known) else np.zeros(len(distinct), np.int64)
        self.counts = np.bincount(text, minlength=len(values)) if len(text) else np.zeros(len(values), np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.start, self.text = windows(self.counts)

    def vectors(self, p: dict[str, np.ndarray]) -> np.ndarray:
        """Word and character vectors of the distinct words, and a row of zeros for padding."""
        out = np.zeros((len(self.hashes) + 1, WORD_DIM + CHAR_DIM), np.float32)
        if len(self.hashes):
            out[:-1, :WORD_DIM] = p["word"][self.word]
            out[:-1, WORD_DIM:] = np.add.reduceat(p["char"][self.gram], np.cumsum(self.count.astype(np.int64)) - self.count.astype(np.int64)) / self.count[:, None]
        return out

    def places(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each word of the windows (time, window) and which of them there are."""
        at = self.start[window][None, :] + np.arange(WINDOW)[:, None]
        there = at < self.counts[self.text[window]][None, :]
        flat = self.first[self.text[window]][None, :] + at
        if not len(self.index):
            return np.zeros(at.shape, np.int64), there
        return np.where(there, self.index[np.minimum(flat, len(self.index) - 1)], len(self.hashes)), there


def score_texts(values: list[str], m: Model, batch: int = 2048) -> np.ndarray:
    """Logit of each text: the highest of its windows."""
    best = np.full(len(values), -np.inf)
    for a, b in text_blocks(values, BLOCK_CHARS):
        x = Inputs(values[a:b], m.known)
        rows = x.vectors(m.p)
        forward, backward = rows @ m.p["Wf"] + m.p["cf"], rows @ m.p["Wb"] + m.p["cb"]
        for i in range(0, len(x.text), batch):
            chosen = np.arange(i, min(i + batch, len(x.text)))
            at, there = x.places(chosen)
            longest = max(1, int(there.sum(axis=0).max()))
            at, mask = at[:longest], there[:longest, :, None].astype(np.float32)
            s = np.concatenate([_layer(forward[at], mask, m.p["Uf"]), _layer(backward[at[::-1]], mask[::-1], m.p["Ub"])[::-1]], axis=2)
            np.maximum.at(best, a + x.text[chosen], np.where(there.any(axis=0), _pool(s, mask, m.p)[3], CLEAN))
    return best


def _learn(x: Inputs, chosen: np.ndarray, label: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Gradient of the mean log loss of the chosen windows."""
    at, there = x.places(chosen)
    longest = max(1, int(there.sum(axis=0).max()))
    at, mask = at[:longest], there[:longest, :, None].astype(np.float32)
    used, index = np.unique(at, return_inverse=True)
    index = index.reshape(at.shape)
    rows = x.vectors(p)[used]
    kept: dict[str, list] = {"f": [], "b": []}
    state = []
    for s in "fb":
        i, k = (index, mask) if s == "f" else (index[::-1], mask[::-1])
        h = _layer((rows @ p[f"W{s}"] + p[f"c{s}"])[i], k, p[f"U{s}"], kept[s])
        state.append(h if s == "f" else h[::-1])
    s = np.concatenate(state, axis=2)
    k, a, pooled, logit = _pool(s, mask, p)
    g: dict[str, np.ndarray] = {}
    d = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
    g["w"], g["b"] = pooled.T @ d, np.array([d.sum()], np.float32)
    d_pooled = d[:, None] * p["w"]
    d_s = a[:, :, None] * d_pooled
    d_a = (s * d_pooled).sum(axis=2)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    g["v"] = np.tensordot(d_e, k, ([0, 1], [0, 1]))
    d_k = d_e[:, :, None] * p["v"] * (1 - k * k)
    g["A"] = np.tensordot(s, d_k, ([0, 1], [0, 1]))
    d_s = d_s + d_k @ p["A"].T
    d_rows = np.zeros_like(rows)
    n = STATE
    for side, lo in (("f", 0), ("b", n)):
        d_out = d_s[:, :, lo : lo + n] if side == "f" else d_s[::-1, :, lo : lo + n]
        m = mask if side == "f" else mask[::-1]
        i = index if side == "f" else index[::-1]
        u, d_u, d_h = p[f"U{side}"], np.zeros_like(p[f"U{side}"]), np.zeros((len(label), n), np.float32)
        d_x = np.empty((longest, len(label), 3 * n), np.float32)
        for t in range(longest - 1, -1, -1):
            h, z, r, c, an = kept[side][t]
            d_h = d_h + d_out[t]
            d_new = d_h * m[t]
            d_c = d_new * (1 - z) * (1 - c * c)
            d_z = d_new * (h - c) * z * (1 - z)
            d_r = d_c * an * r * (1 - r)
            d_x[t] = np.concatenate([d_z, d_r, d_c], axis=1)
            d_pre = np.concatenate([d_z, d_r, d_c * r], axis=1)
            d_u += h.T @ d_pre
            d_h = d_h * (1 - m[t]) + d_new * z + d_pre @ u.T
        g[f"U{side}"], g[f"c{side}"] = d_u, d_x.sum(axis=(0, 1))
        summed = np.zeros((len(used), 3 * n), np.float32)
        np.add.at(summed, i.reshape(-1), d_x.reshape(-1, 3 * n))
        g[f"W{side}"] = rows.T @ summed
        d_rows += summed @ p[f"W{side}"].T
    real = used < len(x.hashes)
    words, d_rows = used[real], d_rows[real]
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], x.word[words], d_rows[:, :WORD_DIM])
    g["word"][-1] = 0
    spread = np.full(len(x.hashes), -1)
    spread[words] = np.arange(len(words))
    mine = spread[x.gram_of] >= 0
    owner = x.gram_of[mine]
    np.add.at(g["char"], x.gram[mine], d_rows[spread[owner], WORD_DIM:] / x.count[owner, None])
    return g


def word_counts(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words (hashes) of each text, and the text they are in."""
    hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in text_blocks(values, BLOCK_CHARS):
        h, of = split_words(values[lo:hi])[3:]
        pair = np.unique(h ^ mix(of.astype(np.uint64) + np.uint64(1)), return_index=True)[1] if len(h) else of
        hashes.append(h[pair])
        docs.append(of[pair] + lo)
    return np.concatenate(hashes), np.concatenate(docs)


def odds_of(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Smoothed log-odds of words that so many toxic and clean texts have; those of rare words count less."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return (odds * np.minimum(1, (toxic + clean) / 10)).astype(np.float32)


def learned_windows(values: list[str], labels: np.ndarray, draws: np.ndarray, known: np.ndarray, odds: np.ndarray) -> list[list[str]]:
    """Of each text its window of the highest log-odds; of a clean one (label 0) the one that draws, a number, picks, too."""
    weight = np.append(odds, 0)
    out: list[list[str]] = []
    for lo, hi in text_blocks(values, BLOCK_CHARS):
        data, start, size = split_words(values[lo:hi])[:3]
        x = Inputs(values[lo:hi], known)
        at, there = x.places(np.arange(len(x.text)))
        peak = np.where(there, np.append(weight[x.word], 0)[at], -9).max(axis=0)
        order = np.lexsort((-peak, x.text))
        first = np.searchsorted(x.text[order], np.arange(hi - lo))
        count = np.bincount(x.text, minlength=hi - lo)
        for t in range(hi - lo):
            picks = [order[first[t]], *([order[first[t] + int(draws[lo + t]) % int(count[t])]] if labels[lo + t] == 0 else [])]
            mine = []
            for w in map(int, picks):
                a = int(x.first[t] + x.start[w])
                b = int(x.first[t] + min(x.start[w] + WINDOW, x.counts[t])) - 1
                mine.append(data[start[a] : start[b] + size[b]].tobytes().decode("utf-32-le", "surrogatepass") if x.counts[t] else "")
            out.append([m for m in mine if len(m) <= WINDOW_CHARS])
    return out


def train(windows: list[str], labels: np.ndarray, known: np.ndarray, odds: np.ndarray, least_steps: int = 60, epochs: int = 6, batch: int = 256, seed: int = 7) -> Model:
    """Fit a network on windows of words and their labels (1: toxic), in so many rounds or as many as make the least steps; known words have vectors that start from their log-odds."""
    rng = np.random.default_rng(seed)
    p = _parameters(rng, odds)
    mixed = rng.permutation(len(windows))
    windows, targets = [windows[i] for i in mixed.tolist()], labels[mixed]
    inputs = [Inputs(windows[i : i + 4096], known) for i in range(0, len(windows), 4096)]
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    steps = 0
    for _ in range(max(epochs, -(-least_steps * batch // max(1, len(windows))))):
        for part in rng.permutation(len(inputs)).tolist():
            x = inputs[part]
            chosen = rng.permutation(len(x.text))
            for i in range(0, len(chosen), batch):
                pick = chosen[i : i + batch]
                steps += 1
                for k, g in _learn(x, pick, targets[4096 * part + x.text[pick]].astype(np.float32), p).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    if k == "char":
                        p[k] *= DECAY  # what few windows say of trigrams fades
                    p[k] -= 0.01 * (mean[k] / (1 - 0.9**steps)) / (np.sqrt(square[k] / (1 - 0.99**steps)) + 1e-8)
    return Model(known, p)


def calibrate(m: Model, got: np.ndarray, labels: np.ndarray) -> Model:
    """Set the logit that errs least on these scores as the middle, and the scale that makes the labels likeliest (smoothed, so that no scale is endless)."""
    order = np.argsort(got, kind="stable")
    wrong = np.concatenate([[(labels == 0).sum()], (labels == 0).sum() + np.cumsum(np.where(labels[order] == 1, 1, -1))])
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    low, high = got[order[max(k - 1, 0)]], got[order[min(k, len(order) - 1)]]
    m.middle = float((low + high) / 2) if 0 < k < len(order) else float(low - 1 if k == 0 else high + 1)
    n = labels.sum()
    target = np.where(labels == 1, (n + 1) / (n + 2), 1 / (len(labels) - n + 2))
    scales = np.geomspace(0.05, 20, 80)
    loss = [np.mean(np.logaddexp(0, (s := c * np.clip(got - m.middle, -30, 30))) - target * s) for c in scales]
    m.scale = float(scales[int(np.argmin(loss))])
    return m


def held_out(id_col: str):
    """Whether a row is outside what may be learned: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", sample: int = 2500, words: int = 20_000) -> Model:
    """Train on at most ``sample`` labelled documents of each label that aren't held out; ``words`` frequent words have vectors of their own."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    marked = marked.where(~held_out("id"))
    chosen = [marked.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample) for label in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # 2 x sample rows at most
    texts_of = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(ids, "id")
    rows = Tables(docs.sparkSession).write(texts_of.groupBy("id", "label").agg(F.min("text").alias("text")), "sample")
    n_of = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n_of) < 2:
        none = np.zeros(0, np.uint64)
        return Model(none, _parameters(np.random.default_rng(0), np.zeros(0, np.float32)), 0.0, 0.0)

    def count(batch: pa.RecordBatch) -> dict[str, object]:
        h, doc = word_counts(texts(batch.column(2)))
        return {"word": h.view(np.int64), "label": np.asarray(batch.column(1))[doc]}

    counts = map_arrow(rows, count, {"word": "long", "label": "int"}).groupBy("word").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n"))
    frequent = counts.where("n >= 5").orderBy(F.desc("n"), "word").limit(words).collect()
    known = np.array([r["word"] for r in frequent], np.int64).view(np.uint64)
    toxic, n = (np.array([r[c] for r in frequent], np.float64) for c in ("toxic", "n"))
    order = np.argsort(known)
    known, odds = known[order], odds_of(toxic, n - toxic, n_of[1], n_of[0])[order]

    def cut(batch: pa.RecordBatch) -> dict[str, object] | None:
        label, ids = np.asarray(batch.column(1)), np.asarray(batch.column(0))
        mine = learned_windows(texts(batch.column(2)), label, mix(ids.astype(np.uint64)), known, odds)
        times = [len(w) for w in mine]
        return {"id": np.repeat(ids, times), "nth": [k for w in mine for k in range(len(w))], "label": np.repeat(label, times), "window": [x for w in mine for x in w]}

    learned = map_arrow(rows, cut, {"id": "long", "nth": "int", "label": "int", "window": "string"}).orderBy(F.xxhash64("id"), "id", "nth").collect()
    model = train([r["window"] for r in learned], np.array([r["label"] for r in learned], np.int64), known, odds)

    def judge(batch: pa.RecordBatch) -> dict[str, object]:
        return {"id": batch.column(0), "label": batch.column(1), "logit": score_texts(texts(batch.column(2)), model)}

    judged = map_arrow(rows, judge, {"id": "long", "label": "int", "logit": "double"}).orderBy("id").collect()
    return calibrate(model, np.array([r["logit"] for r in judged]), np.array([r["label"] for r in judged]))


def probabilities(values: list[str], model: Model) -> np.ndarray:
    if not model.scale:
        return np.zeros(len(values))
    return _sigmoid(model.scale * (score_texts(values, model) - model.middle)).astype(np.float64)


def score(df: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        s = probabilities(texts(batch.column(2)), model)
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")), run, {"doc_id": "long", "held_out": "boolean", "score": "double", "predicted": "int"})


def keep_clean(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, that score below 0.5."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(probabilities(texts(b.column(at)), model) < 0.5))

    return df.mapInArrow(run, df.schema)
