"""Tables that the engine writes for its own use, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

_written: list[tuple[SparkSession, str]] = []
_kept: dict[tuple, tuple] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset, on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="evispark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A place for a table, which discard() deletes."""
    path = f"{shared_dir(spark)}/evispark/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(discard)
    _written.append((spark, path))
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run within leaves no shuffle files behind: a table's own don't lie beside those of its readers."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """df as Parquet, read back: lineage ends there, and losing an executor loses nothing of it."""
    path = new_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path, partitionBy=by, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_parts(spark: SparkSession, label: str, by: str, parts: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Tables of one schema as one that is laid out by `by`, written one after the other: the shuffles of one at a time, and the tables it is made of, take disk."""
    path = new_path(spark, label)
    kept = len(_written)
    with shuffles_removed(spark):
        for value, make in parts.items():
            part = make()
            part.write.parquet(f"{path}/{by}={value}", compression="zstd")
            _drop_from(kept)
    return spark.read.schema(StructType([*part.schema.fields, StructField(by, StringType())])).parquet(path)


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of the shared folder."""
    where, files = _place(spark, path)
    out = files.create(where, True)
    try:
        out.write(data)
    finally:
        out.close()


def renamed(spark: SparkSession, source: str, target: str) -> None:
    """Move a file in one step; a file in its place is replaced."""
    jvm = spark.sparkContext._jvm
    a, _ = _place(spark, source)
    b, files = _place(spark, target)
    files.mkdirs(b.getParent())
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(files.makeQualified(a), files.makeQualified(b), how)


def state_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and time of change of a file or folder."""
    where, files = _place(spark, path)
    return files.getContentSummary(where).getLength(), files.getFileStatus(where).getModificationTime()


def once(spark: SparkSession, label: str, inputs: list[str], make: Callable[[], DataFrame | dict[str, Callable[[], DataFrame]]], by: list[str] | None = None) -> DataFrame:
    """make(), written once in an application for each state of its inputs; a dict holds the parts by the one column of `by`."""
    key = (spark.sparkContext.applicationId, label, *[(p, *state_of(spark, p)) for p in inputs])
    if key not in _kept:
        made = make()
        out = written_parts(spark, label, by[0], made) if isinstance(made, dict) else written(made, label, by)
        _kept[key] = out.schema, _written[-1][1]
    schema, path = _kept[key]
    return spark.read.schema(schema).parquet(path)


def discard() -> None:
    """Delete all that was written here."""
    _kept.clear()
    _drop_from(0)


def _drop_from(kept: int) -> None:
    while len(_written) > kept:
        spark, path = _written.pop()
        try:
            where, files = _place(spark, path)
            files.delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended
            return
