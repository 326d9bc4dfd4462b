"""What a session needs: the package on its executors, a folder they share, and files written there."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the package to every executor, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_longleaf_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="longleaf-"))
    target = folder / "longleaf.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the context serves the file until it ends
    context._longleaf_shipped = True  # type: ignore[attr-defined]


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only for a local master."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_longleaf_scratch", None)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="longleaf-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        context._longleaf_scratch = base  # type: ignore[attr-defined]
    return base.rstrip("/") + "/longleaf"


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    fs, p = _place(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _place(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it isn't there."""
    fs, p = _place(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()] if fs.exists(p) else []


def forget(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder, also when the session has ended."""
    with contextlib.suppress(Exception):  # the session's JVM may be gone already
        delete(spark, path)
    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, which goes when the driver's program ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it is worked out once, and a lost executor costs no stage before it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of a file's or folder's name, size and time: equal for unchanged inputs."""
    fs, p = _place(spark, path)
    seen = [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in sorted(fs.listStatus(p), key=lambda f: str(f.getPath()))]
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:16]
