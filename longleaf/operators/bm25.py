"""A keyword index as ordinary tables, and ranked search over it.

The index is four tables: chunks (with their length), postings (term, chunk, times), vocabulary
(term, documents, idf) and one row of corpus figures.  A saved index is used again until it is
built anew.  A term's postings are dealt to slots by their chunk, so that no term is one task's alone; saved postings are bucketed
and sorted by slot.  A search shuffles the postings of all targets' terms by their chunk and sends the targets' terms to them, so
a chunk's scores for all targets are summed where it is, and pairs of target and chunk are never shuffled before the k best of each task are
chosen.  A search for few terms reads only their buckets; one for very many terms joins the slots of all targets' terms with the postings instead.  What
characters and substrings add is scored for the chunks that the terms found, and only for those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from longleaf.functions import text as T
from longleaf.operators import dense
from longleaf.session import delete, is_complete, scratch_path, ship, written

K1, B, GRAM_WEIGHT, SUBSTRING_WEIGHT = 1.5, 0.75, 0.3, 0.25
#: Targets whose grams and terms are sent to the tasks at once; more go in several rounds.
TARGETS = 2048
#: Unicode's white space, as patterns with (?U) have it.
SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_TABLES = ("chunks", "postings", "vocabulary", "corpus")
#: Buckets of saved postings; chunks for each slot of a term; terms of a search that are looked up by their buckets alone.
BUCKETS, SLOT_CHUNKS, NAMED_TERMS = 64, 1_000_000, 1000
#: Terms of all targets, and names of documents that filters allow, which are sent to every task at most; pairs of target and chunk of a task, and tasks at most.
SENT, PAIRS, TASKS = 500_000, 1_000_000, 10_000
#: Chunks that a task of a search scores, cells of one table of scores or counts in it, and characters of queries whose pairs are looked up in a square.
CHUNKS, CELLS, LETTERS = 10_000, 4_000_000, 1500
_CUT = "\x1f"  # stands between a term and its slot's number; terms are letters and digits


@dataclass
class Index:
    chunks: DataFrame  # ord, doc_id, chunk_id, header_path, text, n_terms
    postings: DataFrame  # slot, term, ord, tf, n_terms
    vocabulary: DataFrame  # term, df, idf
    corpus: DataFrame  # n_chunks, avg_terms
    slots: int = 1  # of each term

    def save(self, path: str, buckets: int = BUCKETS) -> None:
        """Each table from those saved before it, so texts are cut into terms once.  The corpus figures come last and complete it."""
        spark = self.chunks.sparkSession
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        name = _table(path)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        dealt = self.postings.repartition(buckets, "slot")
        dealt.write.mode("overwrite").bucketBy(buckets, "slot").sortBy("slot").option("path", f"{path}/postings").saveAsTable(name)
        saved = _figures(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/postings"), self.slots)
        saved.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        saved.corpus.withColumns({"slots": F.lit(self.slots), "buckets": F.lit(buckets)}).write.mode("overwrite").parquet(f"{path}/corpus")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        """A saved index.  Spark learns how its postings are bucketed from a table of this session's catalog over the same files."""
        chunks, postings, vocabulary, corpus = (spark.read.parquet(f"{path}/{name}") for name in _TABLES)
        layout = corpus.select("slots", "buckets").head()
        name = _table(path)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        columns = ", ".join(f"`{c}` {t}" for c, t in postings.dtypes)
        place = f"{path}/postings".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (slot) SORTED BY (slot) INTO {layout['buckets']} BUCKETS LOCATION '{place}'")
        return Index(chunks, spark.table(name), vocabulary, corpus.select("n_chunks", "avg_terms"), layout["slots"])

    @staticmethod
    def ensure(chunks: DataFrame, path: str, force: bool = False, tokenizer: Callable[[Column], Column] = T.terms) -> Index:
        """The index saved at path; built from chunks (and saved there) if there is none, or anew if forced."""
        spark = chunks.sparkSession
        if force:
            delete(spark, path)
        whole = all(is_complete(spark, f"{path}/{name}") for name in _TABLES)
        if not whole or "buckets" not in spark.read.parquet(f"{path}/corpus").columns:  # stopped, or of another layout
            delete(spark, path)
            build(chunks, tokenizer).save(path)
        return Index.load(spark, path)

    def info(self) -> DataFrame:
        """n_chunks, n_terms and avg_terms in one row."""
        return self.corpus.crossJoin(self.vocabulary.agg(F.count(F.lit(1)).alias("n_terms"))).select("n_chunks", "n_terms", "avg_terms")


def _table(path: str) -> str:
    return f"longleaf_postings_{hashlib.sha256(path.encode()).hexdigest()[:16]}"


def build(chunks: DataFrame, tokenizer: Callable[[Column], Column] = T.terms, slots: int | None = None) -> Index:
    """Index of a table with ord, doc_id, chunk_id, header_path and text.  slots: how many a term's postings are dealt to, by the number of chunks if not stated."""
    base = chunks.select("ord", "doc_id", "chunk_id", "header_path", "text", tokenizer(F.coalesce(F.col("text"), F.lit(""))).alias("terms"))
    sized = base.withColumn("n_terms", F.size("terms")).drop("terms")
    count = chunks.count()
    slots = slots or max(1, -(-count // SLOT_CHUNKS))
    dealt = chunks.select("ord", "text").repartition(tasks_of(chunks.sparkSession, count), "ord")  # texts are shuffled, and not each of their terms
    terms = dealt.select("ord", tokenizer(F.coalesce(F.col("text"), F.lit(""))).alias("terms"))
    counted = terms.select("ord", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).groupBy("term", "ord", "n_terms").agg(F.count(F.lit(1)).alias("tf"))
    return indexed(sized, counted, slots)


def indexed(sized: DataFrame, counted: DataFrame, slots: int | None = None) -> Index:
    """Index of chunks that are cut already: sized as Index.chunks is, counted with term, ord, tf and n_terms."""
    slots = slots or max(1, -(-sized.count() // SLOT_CHUNKS))
    return _figures(sized, counted.select(_slot(F.pmod(F.xxhash64("ord"), F.lit(slots))), "term", "ord", "tf", "n_terms"), slots)


def _slot(number: Column) -> Column:
    return F.concat("term", F.lit(_CUT), number.cast("string")).alias("slot")


def _figures(sized: DataFrame, postings: DataFrame, slots: int) -> Index:
    corpus = sized.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.avg("n_terms"), F.lit(1.0)).alias("avg_terms"))
    counted = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(corpus.select("n_chunks"))
    return Index(sized, postings, counted.select("term", "df", inverse(F.col("df"), F.col("n_chunks")).alias("idf")), corpus, slots)


def inverse(df: Column, n_chunks: Column) -> Column:
    """How rare a term is that df of n_chunks chunks have."""
    return F.ln((n_chunks - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def saturation(tf: Column, n_terms: Column, avg_terms: Column) -> Column:
    return tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * n_terms / avg_terms))


def scores(index: Index, targets: DataFrame, tokenizer: Callable[[Column], Column] = T.terms) -> DataFrame:
    """(target, ord, bm25) of every chunk that has a term of the target (columns target, query)."""
    asked = targets.select("target", F.explode(tokenizer(F.col("query"))).alias("term")).groupBy("target", "term").agg(F.count(F.lit(1)).alias("times"))
    weighted = asked.join(index.vocabulary.select("term", "idf"), "term")
    weighted = weighted.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(index.slots - 1)))).select("target", "times", "idf", _slot(F.col("number")))
    postings = index.postings.select("slot", "ord", "tf", "n_terms")
    few = asked.select("term").distinct().limit(NAMED_TERMS + 1).collect()  # so many rows at most
    if len(few) * index.slots <= NAMED_TERMS:
        postings = postings.where(F.col("slot").isin([f"{r['term']}{_CUT}{n}" for r in few for n in range(index.slots)]))
    part = F.col("times") * F.col("idf") * saturation(F.col("tf"), F.col("n_terms"), F.col("avg_terms"))
    return postings.join(weighted, "slot").crossJoin(F.broadcast(index.corpus)).groupBy("target", "ord").agg(F.sum(part).alias("bm25"))  # corpus: one row


def scores_by_chunk(index: Index, targets: DataFrame, tokenizer: Callable[[Column], Column] = T.terms) -> DataFrame:
    """As scores, dealt to tasks by ord: the asked terms' postings are shuffled by it once, and what a task sums for its chunks is whole.  For more terms than are sent to every task it is scores itself."""
    asked = targets.select("target", F.explode(tokenizer(F.col("query"))).alias("term")).groupBy("target", "term").agg(F.count(F.lit(1)).alias("times"))
    weighted = written(asked.join(index.vocabulary.select("term", "idf"), "term").select("target", "term", (F.col("times") * F.col("idf")).alias("weight")), "asked")
    if weighted.limit(SENT + 1).count() > SENT:
        return scores(index, targets, tokenizer)
    figures = weighted.agg(F.count_distinct("target").alias("targets"), F.slice(F.collect_set("term"), 1, NAMED_TERMS + 1).alias("terms")).head()  # so many rows at most
    postings = index.postings
    if len(figures["terms"]) * index.slots <= NAMED_TERMS:
        postings = postings.where(F.col("slot").isin([f"{t}{_CUT}{n}" for t in figures["terms"] for n in range(index.slots)]))
    pairs = figures["targets"] * index.corpus.select("n_chunks").head()["n_chunks"]
    tasks = max(2 * postings.sparkSession.sparkContext.defaultParallelism, min(TASKS, pairs // PAIRS))
    named = F.broadcast(weighted.select("term").distinct())  # SENT rows at most, as is the other
    share = saturation(F.col("tf"), F.col("n_terms"), F.col("avg_terms")).alias("share")
    mine = postings.select("term", "ord", "tf", "n_terms").join(named, "term").crossJoin(F.broadcast(index.corpus)).select("ord", "term", share)  # corpus: one row
    return mine.repartition(tasks, "ord").join(F.broadcast(weighted), "term").groupBy("target", "ord").agg(F.sum(F.col("weight") * F.col("share")).alias("bm25"))


def doc_keys(doc_id: Column) -> Column:
    """All names under which a document may be asked for: its id, and its beginnings before _ or an opening parenthesis."""
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(doc_id), F.lit(1))), lambda i: doc_id.substr(i, F.lit(1)).isin("_", "（", "("))
    return F.array_distinct(F.concat(F.array(doc_id), F.transform(ends, lambda i: doc_id.substr(F.lit(1), i - 1))))


def named(index: Index, filters: DataFrame, prefix: bool = True) -> DataFrame:
    """(target, req_doc, doc_id) for filters (target, req_doc): the documents that each names, exactly or by a beginning, as an equi-join over documents."""
    names = doc_keys(F.col("doc_id")) if prefix else F.array("doc_id")
    known = index.chunks.select("doc_id").distinct().select("doc_id", F.explode(names).alias("req_doc"))
    return filters.select("target", "req_doc").distinct().join(known, "req_doc").select("target", "req_doc", "doc_id")


def allowed(index: Index, filters: DataFrame, prefix: bool = True) -> DataFrame:
    """(target, req_doc, ord): the chunks of these documents."""
    return named(index, filters, prefix).join(index.chunks.select("ord", "doc_id"), "doc_id").select("target", "req_doc", "ord")


def gram_codes(text: str) -> np.ndarray:
    """The characters and pairs of neighbouring characters of a text without its white space, as sorted numbers."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    c = c[~np.isin(c, SPACE)]
    return np.unique(np.concatenate([c, c[:-1] << 21 | c[1:] | 1 << 42])) if len(c) else c


def _gram_finder(names: np.ndarray) -> Callable[[str], np.ndarray]:
    """A function of a text: for each of these grams (sorted numbers), whether the text has it."""
    single, pair = names[names < 1 << 42], names[names >= 1 << 42] & (1 << 42) - 1
    first, second = pair >> 21, pair & (1 << 21) - 1
    letters = np.unique(np.concatenate([single, first, second]))
    m = len(letters) + 1
    if m > LETTERS:

        def sought(text: str) -> np.ndarray:
            out = np.zeros(len(names), bool)
            at = np.searchsorted(names, mine := gram_codes(text))
            has = at < len(names)
            out[at[has][names[at[has]] == mine[has]]] = True
            return out

        return sought
    of = np.zeros(0x110000, np.int64)
    of[list(SPACE)] = -1
    of[letters] = np.arange(1, m)
    one, two = of[single], of[first] * m + of[second]

    def looked_up(text: str) -> np.ndarray:
        a = of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        a = a[a >= 0]
        seen, beside = np.zeros(m, bool), np.zeros(m * m, bool)
        seen[a] = True
        beside[a[:-1] * m + a[1:]] = True
        return np.concatenate([seen[one], beside[two]])

    return looked_up


def _word_finder(words: list[str]) -> Callable[[str], np.ndarray]:
    """A function of a text: for each of these words, whether it stands in the text."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, t in enumerate(words):
        a.add_word(t, k)
    a.make_automaton()

    def found(text: str) -> np.ndarray:
        out = np.zeros(len(words), bool)
        if words:
            out[[*{k for _, k in a.iter(text)}]] = True
        return out

    return found


def _counted(n_names: int, flat: np.ndarray, starts: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function of rows of marks of names: for each row and list, how many of the list's names are marked."""
    n = len(starts)
    if n_names * n > CELLS:
        return lambda marks: np.stack([_summed(np.append(m, False).astype(np.float64), flat, starts) for m in marks])
    times = np.zeros((n_names + 1, n), np.float32)
    np.add.at(times, (flat, np.repeat(np.arange(n), np.diff(np.append(starts, len(flat))))), 1)
    return lambda marks: (marks.astype(np.float32) @ times[:-1]).astype(np.float64)


def overlaps(asked: list[tuple[str, list[str]]]) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """A function of texts: their shared grams and found terms with each of these targets (query, terms), as rows of counts.  What it looks things up in is made at its first call in a task."""
    names, grams = _listed([gram_codes(q).tolist() for q, _ in asked])
    words, terms = _listed([t for _, t in asked])
    codes, made = np.array(names, np.int64), {}

    def of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not made:
            made.update(grams=_gram_finder(codes), words=_word_finder(words), shared=_counted(len(codes), *grams), held=_counted(len(words), *terms))
        return made["shared"](np.stack([made["grams"](t) for t in texts])), made["held"](np.stack([made["words"](t) for t in texts]))

    return of


def likeness(asked: list[tuple[str, list[str]]]):
    """A function of (text, numbers of targets): what the shared grams and found terms of these targets (query, terms) add to their scores."""
    of = overlaps(asked)

    @F.arrow_udf("array<double>")
    def adds(texts: pa.Array, targets: pa.Array) -> pa.Array:
        out, lengths = [np.zeros(0)], [0]
        for text, ks in zip(texts.to_pylist(), targets.to_pylist(), strict=True):
            shared, held = of([text or ""])
            out.append(np.stack([shared[0, ks], held[0, ks]], axis=1).reshape(-1))
            lengths.append(2 * len(ks))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(lengths).astype(np.int32)), pa.array(np.concatenate(out)))

    return adds


def _listed(parts: list[list]) -> tuple[list, tuple[np.ndarray, np.ndarray]]:
    """The distinct values of lists, sorted, and the lists as places in them (each ended by the place after the last), with their starts."""
    names = sorted({x for p in parts for x in p})
    place = {x: k for k, x in enumerate(names)}
    flat = [k for p in parts for k in [*map(place.__getitem__, p), len(names)]]
    return names, (np.array(flat, np.int64), np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1])


def _summed(values: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the values that each list names."""
    return np.add.reduceat(values[flat], starts) if len(flat) else np.zeros(0)


def _enhanced(found: DataFrame, chunks: DataFrame, targets: DataFrame, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """found (target, ord, bm25 and others) with raw instead of bm25: a chunk's text meets the targets that found it, in one row.

    Targets beyond TARGETS go in several rounds.  What was found is written once, in a part for each round, so a round reads
    its own part, and its result is written before the next one begins.
    """
    ship(targets.sparkSession)
    asked = targets.select("target", "query", F.filter(tokenizer(F.col("query")), lambda t: F.length(t) >= 2).alias("terms"))
    kept = [c for c in found.columns if c not in ("bm25", "ord")]
    schema = targets.select("target").withColumn("k", F.lit(0)).schema

    def scored(mine: DataFrame, block: list) -> DataFrame:
        places = targets.sparkSession.createDataFrame([(r["target"], k) for k, r in enumerate(block)], schema)
        by_chunk = mine.join(F.broadcast(places), "target").groupBy("ord").agg(F.collect_list(F.struct(*kept, "bm25", "k")).alias("c"))  # a round's targets
        adds = likeness([(r["query"] or "", r["terms"] or []) for r in block])
        both = by_chunk.join(chunks.select("ord", "text"), "ord").select("ord", "c", adds(F.col("text"), F.col("c.k")).alias("adds"))
        each = both.select("ord", "adds", F.posexplode("c").alias("at", "c"))
        raw = F.col("c.bm25") + F.get("adds", 2 * F.col("at")) * F.lit(GRAM_WEIGHT) + F.get("adds", 2 * F.col("at") + 1) * F.lit(SUBSTRING_WEIGHT)
        return each.select("ord", *[F.col(f"c.{c}").alias(c) for c in kept], raw.alias("raw"))

    first = asked.limit(TARGETS + 1).collect()
    if len(first) <= TARGETS:
        return scored(found, first)
    rounds = -(-2 * asked.count() // TARGETS)  # by hash, so some hold more than others; half full on average
    number = F.pmod(F.xxhash64("target"), F.lit(rounds)).cast("int").alias("round")
    spark, parts, out = targets.sparkSession, scratch_path(targets.sparkSession, "found"), scratch_path(targets.sparkSession, "scored")
    found.select("*", number).repartition("round", "ord").write.partitionBy("round").parquet(parts)
    asked = written(asked.select("*", number), "asked")
    for n in range(rounds):
        rows = asked.where(F.col("round") == n).toLocalIterator()
        for k, block in enumerate(iter(lambda rows=rows: list(islice(rows, TARGETS)), [])):
            mine = spark.read.schema(found.withColumn("round", F.lit(0)).schema).parquet(parts).where(F.col("round") == n).drop("round")
            scored(mine, block).write.parquet(f"{out}/round={n}/part={k}")
    return spark.read.parquet(out).drop("round", "part")


def weighted(vocabulary: DataFrame, targets: DataFrame, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """(target, term, weight) of the targets' terms, written."""
    asked = targets.select("target", F.explode(tokenizer(F.col("query"))).alias("term")).groupBy("target", "term").agg(F.count(F.lit(1)).alias("times"))
    return written(asked.join(vocabulary.select("term", "idf"), "term").select("target", "term", (F.col("times") * F.col("idf")).alias("weight")), "asked")


def best_of(postings: DataFrame, weights: dict, block: list, k: int, target_type, tasks: int, texts: DataFrame | None = None, ranges: dict | None = None) -> DataFrame:
    """(target, ord, score): for each target of a block (target, and query and terms where texts are given), its k best chunks in each task.

    postings: term, ord and share (and range where ranges are given), of which only the block's terms are read and shuffled by their chunk, as one row
    for each.  A task adds up a chunk's scores for all targets at once, so no row for a pair of target and chunk is made.  weights: (term, weight) of each target.
    texts: ord and text, for what shared grams and found terms add.  ranges: by target, the ranges in which it looks.
    """
    spark = postings.sparkSession
    ship(spark)
    n = len(block)
    terms = sorted({t for r in block for t, _ in weights.get(r["target"], ())})
    place = {t: i for i, t in enumerate(terms)}
    each = sorted((place[t], j, w) for j, r in enumerate(block) for t, w in weights.get(r["target"], ()))
    who, weight = np.array([j for _, j, _ in each], np.int64), np.array([w for _, _, w in each], np.float64)
    counts = np.bincount(np.array([i for i, _, _ in each], np.int64), minlength=len(terms))
    starts = np.cumsum(counts) - counts
    of = overlaps([(r["query"] or "", r["terms"] or []) for r in block]) if texts is not None else None
    numbers = {x: i for i, x in enumerate(sorted({x for r in block for x in ranges.get(r["target"], ())}))} if ranges is not None else {}
    looks = np.zeros((len(numbers) + 1, n), bool)
    for j, r in enumerate(block):
        looks[[numbers[x] for x in (ranges or {}).get(r["target"], ())], j] = True
    names = pa.array([r["target"] for r in block], to_arrow_type(target_type))
    rows = max(1, min(1024, CELLS // 4 // max(1, n)))

    def scored(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Scores of a few chunks (rows) for all targets, and whether they have a term of the target."""
        sizes, flat = np.asarray(pa.compute.list_value_length(part.column(1))), part.column(1).flatten()
        term, share = (np.asarray(x) for x in flat.flatten())
        many = counts[term]
        ends = np.cumsum(many)
        at = np.repeat(starts[term] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
        cell = np.repeat(np.repeat(np.arange(part.num_rows), sizes) * n, many) + who[at]
        raw = np.bincount(cell, weight[at] * np.repeat(share, many), part.num_rows * n).reshape(-1, n)
        has = np.bincount(cell, minlength=part.num_rows * n).reshape(-1, n) > 0
        if ranges is not None:
            has &= looks[[numbers.get(x, len(numbers)) for x in part.column(2).to_pylist()]]
        if of is not None:
            shared, held = of([t or "" for t in part.column(2).to_pylist()])
            raw += shared * GRAM_WEIGHT + held * SUBSTRING_WEIGHT
        return np.where(has, np.floor(raw * 1e4 + 0.5) / 1e4, -np.inf), has

    def run(batches):
        best = dense.Best(n, k)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                score, has = scored(part)
                floor = best.floor if part.num_rows <= k else np.maximum(best.floor, np.partition(score, -k, axis=0)[-k])
                i, j = np.nonzero(has & (score >= floor))
                best.add(j, score[i, j], part.column(0).take(pa.array(i)))
        if (whole := best.cut()) is not None:
            yield pa.RecordBatch.from_arrays([names.take(whole["query"].combine_chunks()), whole["ord"].combine_chunks(), whole["score"].combine_chunks()], names=["target", "ord", "score"])

    kinds = f"target {target_type.simpleString()}, ord {dict(postings.dtypes)['ord']}, score double"
    if not terms:
        return spark.createDataFrame([], kinds)
    if ranges is not None:
        postings = postings.where(F.col("range").isin(*numbers))
    known = spark.createDataFrame(pa.table({"term": terms, "t": pa.array(range(len(terms)), pa.int32())}))
    mine = postings.join(F.broadcast(known), "term").drop("term")  # a block's terms
    more = [F.first("range").alias("range")] if ranges is not None else []
    by_chunk = mine.repartition(tasks, "ord").groupBy("ord").agg(F.collect_list(F.struct("t", "share")).alias("c"), *more)
    if texts is not None:
        by_chunk = by_chunk.join(texts, "ord")
    return by_chunk.mapInArrow(run, kinds)


def tasks_of(spark: SparkSession, n_chunks: int) -> int:
    return max(2 * spark.sparkContext.defaultParallelism, min(TASKS, -(-n_chunks // CHUNKS)))


def by_target(weighted: DataFrame) -> dict | None:
    """(term, weight) of each target, if there are no more rows than are sent to every task."""
    rows = weighted.limit(SENT + 1).toArrow()
    if rows.num_rows > SENT:
        return None
    out: dict = {}
    for target, term, weight in zip(*(rows.column(c).to_pylist() for c in ("target", "term", "weight")), strict=True):
        out.setdefault(target, []).append((term, weight))
    return out


def _searched(index: Index, targets: DataFrame, k: int, enhanced: bool, tokenizer: Callable[[Column], Column]) -> DataFrame | None:
    """(target, ord, score) with the k best chunks of each target and more, or None if the targets have more terms than are sent to every task."""
    weights = by_target(weighted(index.vocabulary, targets, tokenizer))
    if weights is None:
        return None
    spark, kind = targets.sparkSession, targets.schema["target"].dataType
    postings = index.postings
    named = {t for ts in weights.values() for t, _ in ts}
    if len(named) * index.slots <= NAMED_TERMS:
        postings = postings.where(F.col("slot").isin([f"{t}{_CUT}{n}" for t in named for n in range(index.slots)]))
    share = saturation(F.col("tf"), F.col("n_terms"), F.col("avg_terms")).alias("share")
    shares = postings.select("term", "ord", "tf", "n_terms").crossJoin(F.broadcast(index.corpus)).select("term", "ord", share)  # corpus: one row
    tasks = tasks_of(spark, index.corpus.head()["n_chunks"])
    texts = index.chunks.select("ord", "text") if enhanced else None
    asked = targets.where("target is not null").select("target", "query", F.filter(tokenizer(F.col("query")), lambda t: F.length(t) >= 2).alias("terms")) if enhanced else targets.select("target").distinct()
    rows = asked.toLocalIterator()
    parts = []
    while (block := list(islice(rows, TARGETS))) or not parts:
        parts.append(best_of(shares, weights, block, k, kind, tasks, texts))
    return reduce(DataFrame.unionByName, parts)


def search(index: Index, targets: DataFrame, k: int = 10, filters: DataFrame | None = None, prefix: bool = True, enhanced: bool = True, per_doc: bool = False, tokenizer: Callable[[Column], Column] = T.terms) -> DataFrame:
    """Top k chunks of each target by score, rank 1 first; ties go to the smaller ord.

    enhanced adds the overlap of character grams and the terms found in the text.  With per_doc the
    k best of each requested document are given, each with its own ranks.  Targets without filters are scored where
    their chunks are; for those with filters what was found meets the documents that they allow.
    """
    free, parts, per_filter = targets, [], False
    if filters is not None:
        filtered = written(filters.select("target").distinct(), "filtered")
        free, held = targets.join(filtered, "target", "left_anti"), targets.join(filtered, "target", "left_semi")
        if per_filter := not held.isEmpty():
            parts.append(_filtered(index, held, filters, prefix, enhanced, per_doc, tokenizer))
    if not parts or not free.isEmpty():
        found = _searched(index, free, k, enhanced, tokenizer)
        if found is None:
            found = scores_by_chunk(index, free, tokenizer)
            found = (_enhanced(found, index.chunks, free, tokenizer) if enhanced else found.withColumnRenamed("bm25", "raw")).withColumn("score", F.round("raw", 4)).drop("raw")
        parts.append(found.withColumn("req_doc", F.lit(None).cast("string")) if per_doc else found)
    group = ["target", "req_doc"] if per_doc else ["target"]
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "ord"))).where(F.col("rank") <= k)
    if len(parts) == 1 and not per_filter and targets.count() * k <= SENT:
        ranked = F.broadcast(ranked)  # so many rows at most: texts stay where they are
    return ranked.join(index.chunks.select("ord", "doc_id", "chunk_id", "header_path", "text"), "ord")


def _filtered(index: Index, targets: DataFrame, filters: DataFrame, prefix: bool, enhanced: bool, per_doc: bool, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """(target, ord, score and, with per_doc, req_doc) of what targets with filters find in the documents that these allow."""
    found = scores_by_chunk(index, targets, tokenizer).join(index.chunks.select("ord", "doc_id"), "ord")  # what was found, and not all chunks of a document, meets the filters
    docs = written(named(index, filters, prefix), "named")
    docs = F.broadcast(docs) if docs.limit(SENT + 1).count() <= SENT else docs
    found = found.join(docs, ["target", "doc_id"]).select("target", "ord", "bm25", "req_doc")
    if not per_doc:
        found = found.drop("req_doc").distinct()
    found = _enhanced(found, index.chunks, targets, tokenizer) if enhanced else found.withColumnRenamed("bm25", "raw")
    return found.withColumn("score", F.round("raw", 4)).drop("raw")


def search_counted(counted: DataFrame, targets: DataFrame, asked: pa.Table, names: list[str], k: int) -> DataFrame:
    """(target, ord, score, rank) of the k best chunks of each target, from chunks whose terms are counted in one row each.

    counted: ord, n_terms, and t and tf for those of the terms names (by their places) that the chunk has.  asked: target, term and times, SENT rows at most.
    A task scores its chunks for all targets (TARGETS in a round), and nothing is shuffled but its k best.
    """
    spark, kind, n = counted.sparkSession, targets.schema["target"].dataType, len(names)

    def holders(batches):
        """In how many of the task's chunks each term is."""
        df = np.zeros(n, np.int64)
        for b in batches:
            df += np.bincount(np.asarray(b.column(0).flatten(), np.int64), minlength=n)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["t", "df"])

    held = counted.select("t").mapInArrow(holders, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()  # a row for each asked term at most
    corpus = counted.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.avg("n_terms"), F.lit(1.0)).alias("avg_terms")).head()
    avg, df = corpus["avg_terms"], np.zeros(n)
    df[np.asarray(held["t"], np.int64)] = np.asarray(held["df"])
    idf = np.log((corpus["n_chunks"] - df + 0.5) / (df + 0.5) + 1.0)
    place, weights = {t: i for i, t in enumerate(names)}, {}
    for target, term, times in zip(*(asked[c].to_pylist() for c in ("target", "term", "times")), strict=True):
        if df[place[term]]:
            weights.setdefault(target, []).append((place[term], times * idf[place[term]]))
    rows = targets.toLocalIterator()
    parts = []
    while (block := [r["target"] for r in islice(rows, TARGETS)]) or not parts:
        parts.append(_best_counted(counted, weights, block, n, avg, k, kind))
    best = reduce(DataFrame.unionByName, parts)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "ord"))).where(F.col("rank") <= k)


def _best_counted(counted: DataFrame, weights: dict, block: list, n_names: int, avg: float, k: int, target_type) -> DataFrame:
    """(target, ord, score): for each target of a block, its k best of each task's chunks."""
    ship(counted.sparkSession)
    n, kind = len(block), dict(counted.dtypes)["ord"]
    each = sorted((t, j, w) for j, target in enumerate(block) for t, w in weights.get(target, ()))
    term_of, who, weight = (np.array([e[i] for e in each], d) for i, d in enumerate((np.int64, np.int64, np.float64)))
    names = pa.array(block, to_arrow_type(target_type))
    mine = np.unique(term_of)  # the block's terms
    square = len(mine) * n <= CELLS
    rows = max(1, min(1024, CELLS // 4 // max(1, n, len(mine) if square else 1)))

    def run(batches):
        column = np.full(n_names, len(mine))
        column[mine] = np.arange(len(mine))
        counts = np.bincount(term_of, minlength=n_names)
        starts = np.cumsum(counts) - counts
        table = np.zeros((len(mine), n) if square else (0, n))
        if square:
            table[column[term_of], who] = weight

        def scored(row, term, share, size):
            """Sums of share times weight of a few chunks, for all targets."""
            if square:
                has = column[term] < len(mine)
                cells = np.zeros((size, len(mine)))
                cells[row[has], column[term[has]]] = share[has]
                return cells @ table
            many = counts[term]
            ends = np.cumsum(many)
            at = np.repeat(starts[term] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
            return np.bincount(np.repeat(row, many) * n + who[at], weight[at] * np.repeat(share, many), size * n).reshape(-1, n)

        best = dense.Best(n, k)
        for b in batches:
            for start in range(0, b.num_rows, rows):
                part = b.slice(start, rows)
                row = np.repeat(np.arange(part.num_rows), np.asarray(pa.compute.list_value_length(part.column(2))))
                term, tf = (np.asarray(part.column(c).flatten(), np.int64) for c in (2, 3))
                share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.asarray(part.column(1))[row] / avg))
                raw = scored(row, term, share, part.num_rows)
                score = np.where(raw > 0, np.floor(raw * 1e4 + 0.5) / 1e4, -np.inf)  # a term that a chunk has adds more than nothing
                floor = best.floor if part.num_rows <= k else np.maximum(best.floor, np.partition(score, -k, axis=0)[-k])
                i, j = np.nonzero((raw > 0) & (score >= floor))
                best.add(j, score[i, j], part.column(0).take(pa.array(i)))
        if (whole := best.cut()) is not None:
            yield pa.RecordBatch.from_arrays([names.take(whole["query"].combine_chunks()), whole["ord"].combine_chunks(), whole["score"].combine_chunks()], names=["target", "ord", "score"])

    return counted.mapInArrow(run, f"target {target_type.simpleString()}, ord {kind}, score double")
