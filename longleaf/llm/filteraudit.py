"""What five filters of documents do to each other, in all 120 orders, by a Walsh-Hadamard transform.

Each row fails a set of the filters A to E, a mask of five bits.  For a part of the rows and a label,
and for each of the 32 sets S of filters, one sum is taken: +1 for a row that fails an even number of the
filters in S, -1 for one that fails an odd number.  These 32 signed parity sums are the Walsh-Hadamard
transform of the counts of masks; the transform is its own inverse but for the factor 32, so the counts come back exactly, and every
figure of every order is a sum of some of them.  A row that fails n filters is removed by each of
these in 120 / n of the 120 orders, which gives a filter's Shapley figure without going through the orders.

Filters look at a text alone but for E, which a row fails if the same text has a smaller id.  Rows are counted by
(text digest, part, labels) first, and a text's smallest id is found among these counts, so copies of one
text meet as a few counts and never as rows.

Cases: a null text is the empty one; a null part is the empty string, as one with the empty string itself; a row
whose id is null has no labels, never fails E, and no other row fails E by it; rows that repeat an id
are rows of their own, of which those with the smallest id of a text all pass E; of labels that repeat an id one that holds the label is
enough; labels of unknown or null ids count for nothing; an empty table gives no rows; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longleaf.llm.common import Tables, map_arrow

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: The filter that is judged against the whole table; the others are judged by a text alone.
COPY = 16
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> Column:
    """Mask of the filters A to D that a text (not null) fails, as bits 1, 2, 4 and 8."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    few = F.size(words) < 100
    repeated = 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)
    loud = 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text)
    marked = text.rlike("[#$%&*|]")
    return sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate((few, repeated, loud, marked))), F.lit(0))


def _sign(mask: Column, s: int) -> Column:
    """+1 or -1, by the parity of the filters in s that a mask has."""
    return F.lit(1) - 2 * (F.bit_count(mask.bitwiseAND(F.lit(s))) % 2)


def parity_sums(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "lang") -> DataFrame:
    """(part, n, good, toxic): the 32 signed parity sums of all rows of each part, of its good ones and of its toxic ones."""
    tables = Tables(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    facts = tables.write(facts.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failures(F.col("text")).alias("mask")), "facts")
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias("good" if c == "quality" else c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(flag("quality"), flag("toxic"))
    rows = facts.where("id is not null").join(known, "id", "left").fillna(0, ["good", "toxic"])
    group = ["digest", "part", "mask", "good", "toxic"]
    counted = rows.groupBy("id", *group).agg(F.count(F.lit(1)).alias("n")).groupBy(*group).agg(F.min(F.struct("id", "n")).alias("least"), F.sum("n").alias("n"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    copies = F.col("n") - F.when(F.col("least.id") == first, F.col("least.n")).otherwise(F.lit(0))
    cells = counted.select("part", "mask", "good", "toxic", "n", copies.alias("copies"))
    lost = facts.where("id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.unionByName(lost.select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n", F.lit(0).cast("long").alias("copies")))

    def sums(label: Column, name: str) -> Column:
        signed = lambda s: (F.col("n") - (2 * F.col("copies") if s & COPY else F.lit(0))) * _sign(F.col("mask"), s) * label
        return F.array(*[F.sum(signed(s)) for s in range(MASKS)]).alias(name)

    return cells.groupBy("part").agg(sums(F.lit(1), "n"), sums(F.col("good"), "good"), sums(F.col("toxic"), "toxic"))


def parities() -> np.ndarray:
    """The matrix of signs, by set and mask."""
    at = np.arange(MASKS, dtype=np.uint8)
    return 1 - 2 * (np.bitwise_count(at[:, None] & at[None, :]).astype(np.int64) % 2)


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it) of all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for n, name in enumerate(order, 1):
            out.append(("".join(order), n, 1 << FILTERS.index(name), before))
            before |= 1 << FILTERS.index(name)
    return out


def figures(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Every figure at every one of steps(), from counts by mask."""
    bit, before = (np.array(x)[:, None] for x in list(zip(*steps(), strict=True))[2:])
    mask = np.arange(MASKS)[None, :]
    fails, gone = (mask & bit) > 0, (mask & before) > 0
    here = fails & ~gone
    failed = np.maximum(np.bitwise_count(np.arange(MASKS, dtype=np.uint8)).astype(np.int64), 1)
    return {"kept": ~(fails | gone) @ n, "removed": here @ n, "redundant": (fails & gone) @ n, "unique_fails": n[bit[:, 0]], "good_lost": here @ good, "toxic_lost": here @ toxic, "shapley": fails @ (n * (120 // failed))}


def audit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part."""
    orders, numbers = zip(*[x[:2] for x in steps()], strict=True)

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        parts = batch.column(0).to_pylist()
        cells = [np.array(batch.column(k).to_pylist(), np.int64) @ parities() // MASKS for k in (1, 2, 3)]
        each = [figures(*x) for x in zip(*cells, strict=True)]
        return {"part": [p for p in parts for _ in orders], "filter_order": list(orders) * len(parts), "step": list(numbers) * len(parts)} | {f: np.concatenate([x[f] for x in each]) for f in FIGURES}

    return map_arrow(parity_sums(docs, labels, text_col, id_col, part_col), rows, {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(FIGURES, "long"))


#: All orders gone through one by one in DuckDB.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * len(regexp_extract_all(x, '[A-Z]')) > 10 * length(x))::INT
    + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)::INT AS mask FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
