"""Plumbing shared by the corpus operators: Arrow text scans, shared-folder tables, sizes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_libc = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None
#: Rows and bytes that one Arrow batch of texts may hold.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Column prefix of what an operator adds to rows that it passes through.
ADDED = "__added_"
#: Column prefix of passed-through columns while an operator works.
OWN = "__own_"
TEXT = "__scan_text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="evispark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, label: str, tasks: int = 0) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and any executor can read it.

    tasks: into so many files at most, where the caller knows the number of rows.
    """
    df = df.coalesce(tasks) if tasks else df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evispark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(discard)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard() -> None:
    """Delete every table that materialize() wrote in this process."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended
            return


def result_of(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """make()'s rows, written; the tables that it wrote on the way are deleted then."""
    mark = len(_written)
    out = materialize(make(), label)
    for spark, path in _written[mark:-1]:
        _delete(spark, path)
    _written[mark:] = _written[-1:]
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read again; and let the shuffles of what is gone be deleted."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            for entry in [x for x in _written if f"/{x[1].rsplit('/', 1)[1]}/" in file]:
                _written.remove(entry)
                _delete(*entry)
    gc.collect()
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to what the kernels' memory is planned for; never raise them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).lower().rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def apart(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns named by their place, so that no helper column can clash with them, and the new name of each."""
    names = {c: f"{OWN}{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def restored(df: DataFrame, names: dict[str, str], *more) -> DataFrame:
    """The columns of apart() under their own names again."""
    return df.select(*[F.col(new).alias(old) for old, new in names.items()], *more)


def each_text(col: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each row."""
    data, offsets = utf8(col)
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield raw[a:b]


def scan_texts(df: DataFrame, text_col: str, keep: list[str], fields: list[T.StructField], make_kernel: Callable[[], Callable[[pa.Array], list[pa.Array]]], prefix: str = ADDED) -> DataFrame:
    """One pass over whole texts, without a shuffle: the `keep` columns, then `fields` under the prefix.

    make_kernel() runs once a task and gives a function from a batch's text column to the added columns.
    """
    bounded_batches(df.sparkSession)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(TEXT))
    added = [T.StructField(prefix + f.name, f.dataType, True) for f in fields]
    schema = T.StructType([*source.schema.fields[:-1], *added])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make_kernel()
        for batch in batches:
            at = batch.schema.get_field_index(TEXT)
            made = kernel(batch.column(at))
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[f.name for f in schema.fields])
        give_back()

    return source.mapInArrow(scan, schema)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "spans": SPANS}


def give_back() -> None:
    """Return a task's freed memory to the system: workers are reused, and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def field(name: str, kind: str) -> T.StructField:
    """A nullable field; kind: one of KINDS, or array<one of them>. (Workers import this: no session is there.)"""
    inner = kind.removeprefix("array<").removesuffix(">")
    return T.StructField(name, T.ArrayType(KINDS[inner]) if inner != kind else KINDS[kind], True)


def part_of(id_col: str, modulus: int):
    """crc32 of the id as text, modulo: what splits rows into folds."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(modulus))


def is_null_or_in(col, values):
    return col.isNull() | col.isin(values)
