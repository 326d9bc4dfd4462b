"""Files that a service converts, as a state machine: what it reports of each file, in any order and number, becomes one end.

A file is running until it ends: done, when a report brings its text; failed, when the last of its tries failed; or timed
out, when no end came within a limit.  A failed try that isn't the last asks for another (status again).  Reports on a file that has ended change
nothing, and what is known of it is forgotten after a while, so the state is that of the files under way.
All times are those of the reports: timers follow the stream's watermark, and a replay gives the same.

Files are dealt to shares by a hash of their ids, and a share's files have one state and one timer (the first of theirs), since each call from
Python to the state store, and each table of rows that is passed, costs as much as hundreds of reports.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from longleaf.session import ship

#: Columns of reports and of what becomes of files; ends of files.
REPORT = "doc_id string, state string, text string, at timestamp"
CHANGE = "doc_id string, status string, tries int, text string, at timestamp"
ENDS = ("done", "failed", "timed out")
#: Shares to which files are dealt; a checkpoint goes on with the number it began with.  A task holds the reports of one share of a batch.
SHARES = 1024
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Conversion(StatefulProcessor):
    """The files of a share: of each its status, tries, and the time (in milliseconds) at which it times out or is forgotten."""

    def __init__(self, tries: int, limit: int, keep: int):
        self.tries, self.limit, self.keep = tries, limit * 1000, keep * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "files binary, timer long")

    def _get(self) -> tuple[dict[str, tuple[str, int, int]], int | None]:
        """What is known of each file, and the share's timer."""
        if (got := self.known.get()) is None:
            return {}, None
        with pa.ipc.open_stream(bytes(got[0])) as reader:
            ids, *what = (c.to_pylist() for c in reader.read_all().columns)
        return dict(zip(ids, zip(*what, strict=True), strict=True)), got[1]

    def _put(self, files: dict[str, tuple[str, int, int]], timer: int | None, after: int | None = None) -> None:
        """The state and its only timer (after a time, if that has just expired)."""
        due = min(d for _, _, d in files.values()) if files else None
        if due is not None and after is not None:
            due = max(due, after + 1)
        if due != timer:
            if timer is not None and after is None:  # one that has expired is deleted by Spark
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if due is None:
            self.known.clear()
            return
        status, tries, dues = zip(*files.values(), strict=True)
        table = pa.table({"doc_id": pa.array(files, pa.string()), "status": pa.array(status, pa.string()), "tries": pa.array(tries, pa.int32()), "due": pa.array(dues, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.known.update((sink.getvalue().to_pybytes(), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        reports = sorted((r for part in rows for r in zip(*(part[c].tolist() for c in ("doc_id", "state", "text", "us")), strict=True)), key=lambda r: r[3])
        files, timer = self._get()
        out = []
        for doc_id, state, text, us in reports:
            before, tries, due = files.get(doc_id, (None, 0, 0))
            if before in ENDS:
                continue
            status = before
            if state == "done" and text:
                status = "done"
            elif state in ("done", "failed"):  # done without a text is a failed try
                tries += 1
                status = "failed" if tries >= self.tries else "again"
            elif status is None or status == "again":
                status = "running"
            if status != before or state == "failed":
                out.append((doc_id, status, tries, text if status == "done" else None, us))
            if status != before:
                due = us // 1000 + (self.keep if status in ENDS else self.limit)
            files[doc_id] = (status, tries, due)
        self._put(files, timer)
        if out:
            yield _made(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        """Files whose time has come: those that had ended are forgotten, others time out."""
        now, (files, timer) = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), self._get()
        out = []
        for doc_id, (status, tries, due) in list(files.items()):
            if due > now:
                continue
            if status in ENDS:
                del files[doc_id]
            else:
                files[doc_id] = ("timed out", tries, due + self.keep)
                out.append((doc_id, "timed out", tries, None, due * 1000))
        self._put(files, timer, expiredTimerInfo.getExpiryTimeInMs())
        if out:
            yield _made(out)

    def close(self) -> None:
        pass


def _made(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "status", "tries", "text", "us"])


def changes(reports: DataFrame, tries: int = 3, limit: int = 1800, keep: int = 86_400, late: str = "10 minutes", shares: int = SHARES) -> DataFrame:
    """Changes of status (see CHANGE) of the files of a stream of reports (see REPORT); limit and keep are seconds.  More shares make smaller ones."""
    spark = reports.sparkSession
    ship(spark)
    stamped = reports.select("doc_id", "state", "text", "at").where("doc_id is not null and at is not null").withWatermark("at", late)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(shares)).cast("int").alias("share")
    dealt = stamped.select(share, "doc_id", "state", F.when(F.col("state") == "done", F.col("text")).alias("text"), "at", F.unix_micros("at").alias("us"))  # no session's time zone matters to a number
    made = dealt.groupBy("share").transformWithStateInPandas(Conversion(tries, limit, keep), "doc_id string, status string, tries int, text string, us long", "Append", "EventTime")
    return made.select("doc_id", "status", "tries", "text", F.timestamp_micros("us").alias("at"))


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that this needs, for queries that start inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def follow(reports: DataFrame, target: str, checkpoint: str, **ways) -> StreamingQuery:
    """Write the changes of what has been reported so far to a folder; a later call goes on where this one ends."""
    spark = reports.sparkSession
    with state_store(spark):
        return changes(reports, **ways).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)


def ended(spark: SparkSession, target: str) -> DataFrame:
    """The files that have ended, one row each."""
    return spark.read.schema(CHANGE).parquet(target).where(F.col("status").isin(*ENDS))
