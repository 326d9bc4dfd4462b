"""What the operators of this subpackage share: written intermediate tables and Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longleaf.session import delete, scratch_dir, ship

#: Tokenizer file used by the registered queries; every operator takes the path as a parameter.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file on this machine (each executor resolves its own)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _forget(spark: SparkSession, path: str) -> None:
    """Results may be read until the driver's program ends; then their tables go."""
    with contextlib.suppress(Exception):  # the session's JVM may be gone already
        delete(spark, path)
    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


class Tables:
    """Intermediate tables written as Parquet in the shared folder.

    A written table cuts lineage: a lost executor costs the tasks that ran on it and never the
    stages before the table.  ``drop`` removes a table that nothing will read again.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(_forget, spark, self.base)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._longleaf_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t._longleaf_path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_type(name: str) -> pa.DataType:
    return {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
        "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
    }[name]


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], dict[str, object] | None], schema: dict[str, str], whole: bool = False) -> DataFrame:
    """``mapInArrow`` over record batches; function returns the columns named in schema.

    With whole=True the function gets the iterator of a partition's batches and yields such dicts.
    """
    ship(df.sparkSession)
    spec = pa.schema([(k, arrow_type(v)) for k, v in schema.items()])

    def batch(cols: dict[str, object]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) for c, f in ((cols[f.name], f) for f in spec)], schema=spec)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if whole:
            for cols in function(batches):
                yield batch(cols)
            return
        for b in batches:
            if b.num_rows and (cols := function(b)) is not None:
                yield batch(cols)

    return df.mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in schema.items()))


def texts(column: pa.Array) -> list[str]:
    """Python strings of a text column; a null counts as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def text_blocks(values: list[str], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about so many characters together (one long text may exceed it)."""
    start, size = 0, 0
    for i, v in enumerate(values):
        size += len(v)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(values):
        yield start, len(values)


def lists(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat, kind))


def binaries(data: bytes | np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column from concatenated bytes."""
    raw = data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes()
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bits of the map of hashed keys that ``parted`` sends to every task, 64 to a row: a million rows at most.
MAP_BITS = 1 << 26


def parted(df: DataFrame, marks: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """df (read twice) in two: rows whose keys surely aren't in marks, and those whose keys may be.

    Rows of the first part need no join, and so no shuffle.  Keys are hashed into a map of bits of fixed size,
    which is broadcast; with more keys than it can tell apart, the second part becomes all of df.
    """
    place, word, bits = (free_name(df, n) for n in ("_place", "_word", "_bits"))
    hashed = F.pmod(F.xxhash64(*keys), F.lit(MAP_BITS))
    held = marks.select(hashed.alias(place)).select(F.shiftright(place, 6).alias(word), F.expr(f"shiftleft(1L, cast({place} & 63 as int))").alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    met = df.withColumn(place, hashed).join(F.broadcast(held), F.shiftright(place, 6) == F.col(word), "left")  # MAP_BITS / 64 rows at most
    may = F.coalesce(F.expr(f"shiftright({bits}, cast({place} & 63 as int)) & 1") == 1, F.lit(False))
    return met.where(~may).select(df.columns), met.where(may).select(df.columns)


def met(rows: DataFrame, found: DataFrame, key: str, tables: Tables, name: str) -> DataFrame:
    """rows joined with what an aggregate found by key.

    The aggregate is written first: where it is part of the join's own stage, adaptive execution can't split a key that half of the
    rows have, as both sides of what it splits must be plain exchanges.
    """
    return rows.join(tables.write(found, name).hint("merge"), key)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a unique long for each row.  Materialise the result before it is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of so many rows: very long texts then never meet in one batch by tens of thousands."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside, whatever the session's setting is before and after."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    small_batches(spark, rows)
    try:
        yield
    finally:
        small_batches(spark, int(before))
