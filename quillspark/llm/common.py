"""What the training-data operators share: staged tables, id buckets, Arrow maps."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Arrow batches stay this small, so that very long texts don't add up in a Python worker.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def tuned(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches bounded by bytes and rows where the user left the defaults."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        if spark.conf.get(key, None) in (None, "10000", "-1", "64MB", "67108864", "9223372036854775807", "2147483647"):
            try:
                spark.conf.set(key, str(value))
            except Exception:  # a session of a version without this key keeps its own bound
                continue
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a local one only where that is unset, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    # with its file system, as tasks that write files themselves need to know it too
    at = spark._jvm.org.apache.hadoop.fs.Path(found)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    return "file://" + whole[len("file:") :] if whole.startswith("file:/") and not whole.startswith("file://") else whole


_kept: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses; the application's paths go when it ends."""
    root = f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}"
    if root not in _kept:
        _kept.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, root: str) -> None:
    try:
        drop(spark, root)
    except Exception:  # the session has ended before us: its owner cleans the shared folder
        pass


def drop(spark: SparkSession, path: str) -> None:
    """Removes a staged table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a staged table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_forget: dict[str, Callable[[], object]] = {}


def claim(name: str, forget: Callable[[], object]) -> None:
    """Says that operator `name` works in this Python worker now; what other operators remember is dropped.

    Workers outlive stages, so the bounded memories of several operators would otherwise add up."""
    if list(_forget) != [name]:
        others = [f for n, f in _forget.items() if n != name]
        _forget.clear()
        _forget[name] = forget
        for f in others:
            f()
        if others:
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library: it keeps the freed pages
                pass


def bucket(value: object, n: int) -> int:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """mapInArrow of a function on single batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return df.mapInArrow(run, schema)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Splits a batch of texts at ASCII white space: its distinct words (the empty one among them at times),
    every word's number among those in order, and where each text's words begin (one entry more than texts)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    coded = parts.flatten().dictionary_encode()
    offsets = parts.offsets.to_numpy()
    return coded.dictionary, coded.indices.to_numpy(), offsets - offsets[0]


def expand(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions in a table of runs (run k has lengths[k] entries, runs behind each other) for a sequence of runs."""
    n, starts = lengths[codes], np.cumsum(lengths) - lengths
    ends = np.cumsum(n)
    return np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))
