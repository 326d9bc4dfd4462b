"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

Encoding a piece (one match of the vocabulary's split pattern) stores for every prefix the one
token with which the prefix's encoding ends:

* an automaton over all tokens yields, position by position, the tokens that are suffixes of the
  prefix;
* a candidate is that last token exactly if the shorter prefix it leaves is empty, or if the last
  token stored there may stand before it: no merge rule would have joined pieces across the seam.

Following the stored tokens backwards gives the same ids as applying the merge rules in order.
Pieces and space-separated chunks are cached per Python worker, in tables of a fixed size, so memory does not grow with the input.

Cases: a null text is the empty text and has no ids; very long texts are encoded whole (work per
piece is linear in its length times the longest token); a special token's string in a text becomes
that token, as the tokenizers library does; an output column that df already has is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longleaf.llm.common import map_arrow, text_blocks, texts, tokenizer_path
from longleaf.session import ship

#: The split pattern of byte-level BPE with white space as Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries of a generation of each cache, and the longest text (in characters) that a cache keeps.
CHUNKS, PIECES, FIRSTS, SEAMS, LONG = 600_000, 500_000, 50_000, 1_000_000, 40
_ODD_SPACE = re.compile(r"\s\s|^\s|\s\Z")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_SAFE_FEED = re.compile(r"(?<=\S)\n(?=\S)")
_SPACE = re.compile(r"\s")
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_RARE_SPACE = tuple(c for c in map(chr, [*range(0x3001)]) if c.isspace() and c not in " \n")
_NEVER = 1 << 30


def byte_names() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merge rules and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, names = spec["model"], byte_names()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: bytes(names[c] for c in t) for t, i in model["vocab"].items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.size = max(self.bytes) + 1
        ids = model["vocab"]
        #: (left, right) -> (rank, merged); token -> its two parts and the rank at which they join.
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.pairs[left, right] = (rank, whole)
            self.parts.setdefault(whole, (left, right, rank))
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def table(self) -> list[bytes]:
        return [self.bytes.get(i, b"") for i in range(self.size)]


class Generations(dict):
    """A cache of bounded size: the newer of two generations; what is still used moves over when it fills."""

    def __init__(self, compute, entries: int):
        self.compute, self.entries, self.old = compute, entries, {}

    def put(self, key: str, value: bytes) -> None:
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def __missing__(self, key: str) -> bytes:
        if (value := self.old.get(key)) is None:
            value = self.compute(key)
            if len(key) > LONG:
                return value
        self.put(key, value)
        return value


class PrefixEncoder:
    """Exact ids of a piece by dynamic programming over its prefixes."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        import regex

        self.v = vocabulary
        self.find = regex.compile(PATTERN).findall
        self.machine = ahocorasick.Automaton()
        special = set(vocabulary.special.values())
        for i, b in vocabulary.bytes.items():
            if i not in special:
                self.machine.add_word(b.decode("latin-1"), (i, len(b)))
        self.machine.make_automaton()
        #: A piece that is a token ends with it after the empty prefix.
        self.single = {b: i for i, b in vocabulary.bytes.items() if i not in special}
        self.known: dict[int, bool] = {}
        self.seams: dict[int, tuple[tuple[tuple[int, int], ...], tuple[tuple[int, int], ...]]] = {}
        self.pieces = Generations(lambda p: array("I", self.encode_piece(p.encode())).tobytes(), PIECES)

    def seam(self, token: int) -> tuple[tuple[tuple[int, int], ...], tuple[tuple[int, int], ...]]:
        """What stands at the token's left and right end while it is built: (piece, rank that ends it)."""
        if token not in self.seams:
            ends = []
            for side in (0, 1):
                spine, ends_at, t = [], _NEVER, token
                while True:
                    spine.append((t, ends_at))
                    if t not in self.v.parts:
                        break
                    ends_at, t = self.v.parts[t][2], self.v.parts[t][side]
                ends.append(tuple(spine))
            self.seams[token] = (ends[0], ends[1])
        return self.seams[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a then b stay two tokens: no rule joins what stands at the seam while both live.

        Of equal ranks the left one goes first, so a's own merge wins a tie and b's own loses it.
        """
        pairs = self.v.pairs
        for x, x_ends in self.seam(a)[1]:
            for y, y_ends in self.seam(b)[0]:
                if (r := pairs.get((x, y))) is not None and r[0] < x_ends and r[0] <= y_ends:
                    return False
        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.single.get(piece)) is not None:
            return [whole]
        n = len(piece)
        last, back, known = [-1] * (n + 1), [0] * (n + 1), self.known
        for end, (token, length) in self.machine.iter(piece.decode("latin-1")):
            stop = end + 1
            if last[stop] >= 0:
                continue
            if start := stop - length:
                if (before := last[start]) < 0:
                    continue
                key = before << 20 | token
                if (fits := known.get(key)) is None:
                    if len(known) >= SEAMS:
                        known.clear()
                    fits = known[key] = self.compatible(before, token)
                if not fits:
                    continue
            last[stop], back[stop] = token, start
        ids = []
        while n:
            ids.append(last[n])
            n = back[n]
        ids.reverse()
        return ids

    def encode_chunk(self, chunk: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text without special tokens."""
        return b"".join(map(self.pieces.__getitem__, self.find(chunk)))

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The same for many chunks that follow a space and hold no white space."""
        out: list[list[bytes]] = []
        for p in self.find(" " + " ".join(chunks)):
            if p[0] == " ":
                out.append([])
            out[-1].append(self.pieces[p])
        return list(map(b"".join, out))


class MergeEncoder:
    """The same ids from tiktoken's merge loop, for operators that need ids but are not about encoding.

    Where no two white-space characters meet, the split pattern's look-ahead decides nothing and a
    pattern without it, which runs several times faster, gives the same pieces.
    """

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        self.v = vocabulary
        special = set(vocabulary.special.values())
        ranks = {b: i for i, b in vocabulary.bytes.items() if i not in special}
        full = PATTERN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S")
        single = full[: full.index(r"|\s+(?!")] + r"|\s"
        self.full, self.single = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (full, single))

    def _plain(self, text: str) -> bytes:
        spaced = any(x in text for x in _PAIRS) or any(x in text for x in _RARE_SPACE)
        return array("I", (self.full if spaced else self.single)(text)).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        special = self.v.special
        if any(t in text for t in special):
            return b"".join(array("I", [special[p]]).tobytes() if p in special else self._plain(p) for p in self.v.special_split.split(text))
        return self._plain(text)

    def batch(self, values: list[str]) -> list[bytes]:
        return list(map(self.ids, values))


class TextEncoder:
    """Whole texts to ids.

    A single space between two characters that are not white space starts a new piece, and a single
    line feed between two such characters is a piece, so texts are cut there and each chunk is
    encoded once; the chunks that a block of texts adds are encoded together.
    """

    def __init__(self, vocabulary: Vocabulary, encoder: PrefixEncoder):
        self.v, self.encoder = vocabulary, encoder
        self.first = Generations(encoder.encode_chunk, FIRSTS)
        self.later = Generations(lambda chunk: encoder.encode_chunk(" " + chunk), CHUNKS)
        self.feed = encoder.encode_chunk("\n")
        self.special = {t: array("I", [i]).tobytes() for t, i in vocabulary.special.items()}

    def _lines(self, text: str) -> list[list[str]]:
        if _ODD_SPACE.search(text) is None:
            return [line.split(" ") for line in text.split("\n")]
        return [_SAFE_SPACE.split(line) for line in _SAFE_FEED.split(text)]

    def _learn(self, lines: list[list[str]]) -> None:
        unknown = filterfalse(self.later.old.__contains__, filterfalse(self.later.__contains__, set(chain.from_iterable(lines))))
        new = {c for c in unknown if 0 < len(c) <= LONG and not _SPACE.search(c)}
        if new:
            for c, ids in zip(new, self.encoder.encode_chunks(list(new)), strict=True):
                self.later.put(c, ids)

    def _join(self, lines: list[list[str]]) -> bytes:
        first, later = self.first.__getitem__, self.later.__getitem__
        return self.feed.join([first(x[0]) + b"".join(map(later, x[1:])) for x in lines])

    def batch(self, values: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        for a, b in text_blocks(values):
            parts = [[t] if not any(s in t for s in self.special) else self.v.special_split.split(t) for t in values[a:b]]
            cut = [[p if p in self.special or not p else self._lines(p) for p in text] for text in parts]
            self._learn([x[1:] for text in cut for p in text if isinstance(p, list) for x in p])
            out += [b"".join(self.special.get(p, b"") if isinstance(p, str) else self._join(p) for p in text) for text in cut]
        return out

    def ids(self, text: str) -> bytes:
        return self.batch([text])[0]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def text_encoder(path: str, prefix_dp: bool) -> TextEncoder | MergeEncoder:
    """One encoder per Python worker; its caches live as long as the worker."""
    v = vocabulary(path)
    return TextEncoder(v, PrefixEncoder(v)) if prefix_dp else MergeEncoder(v)


def decode_bytes(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """df with out_col: the text's ids as binary, little-endian unsigned 32-bit."""
    ship(df.sparkSession)
    path = tokenizer or tokenizer_path()

    @F.arrow_udf("binary")
    def ids(column: pa.Array) -> pa.Array:
        return pa.array(text_encoder(path, True).batch(texts(column)), pa.binary())

    return df.withColumn(out_col, ids(F.col(text_col)))


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """df with out_col: the text of binary ids (bytes that aren't UTF-8 are replaced); null ids give the empty text."""
    ship(df.sparkSession)
    path = tokenizer or tokenizer_path()

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        table = vocabulary(path).table()
        return pa.array([decode_bytes(np.frombuffer(b or b"", "<u4"), table).decode("utf-8", "replace") for b in column.to_pylist()], pa.string())

    return df.withColumn(out_col, text(F.col(ids_col)))


def round_trip(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """id, number of ids, digest of the ids and digest of the text decoded from them, in one pass without a shuffle."""
    path = tokenizer or tokenizer_path()

    def digest(batch: pa.RecordBatch) -> dict[str, object]:
        table = vocabulary(path).table()
        names = [str(i) for i in range(len(table))]
        n, ids_sha, text_sha = [], [], []
        for raw in text_encoder(path, True).batch(texts(batch.column(1))):
            ids = np.frombuffer(raw, "<u4").tolist()
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace").encode()).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), digest, {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})
