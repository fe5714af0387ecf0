"""What the training-data operators share: table access, text chunks, materialised tables."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import suppress
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII blanks; bytes.split() splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step holds at once in a Python worker.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; one with fewer splits than there are cores is dealt out to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a local one only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.gettempdir() + "/lexhound-shared"
    return folder.rstrip("/")


#: The scratch that tables go to in this context (a thread, say), if any.
_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


class Scratch:
    """Owns the tables that materialise() writes while it is entered, in this context alone; remove() deletes them.

    Tables that no scratch owns, or that aren't removed, are deleted when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        self._token = _scratch.set(self)
        return self

    def __exit__(self, *_) -> None:
        _scratch.reset(self._token)

    def remove(self, but: DataFrame | None = None) -> None:
        """Deletes the tables but for those that a table reads."""
        stays = {_bare(f.rsplit("/", 1)[0]) for f in but.inputFiles()} if but is not None else set()
        left = []
        for path in self.paths:
            if _bare(path) in stays:
                left.append(path)
            else:
                _delete(self.spark, path)
        self.paths = left


def _bare(path: str) -> str:
    return path.split(":", 1)[-1].lstrip("/")


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _delete(spark: SparkSession, path: str) -> None:
    files, folder = _files(spark, path)
    files.delete(folder, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: computed once, its lineage cut, safe from lost executors.

    Each call writes to a path of its own, which the Scratch of this context owns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (own := _scratch.get()) is not None:
        own.paths.append(path)
    df.write.parquet(path)
    files, folder = _files(spark, path)
    files.deleteOnExit(folder)  # which counts for folders that exist
    return spark.read.schema(df.schema).parquet(path)


def delete_table(df: DataFrame) -> None:
    """Removes the files of a table that materialise() wrote."""
    if found := df.inputFiles():
        _delete(df.sparkSession, found[0].rsplit("/", 1)[0])


def row_hash(df: DataFrame, *only: str):
    """A hash of whole rows, nulls told from what isn't there; of columns that hold maps, which have no hash, nothing counts."""
    hashed = [c for c in only or df.columns if "map<" not in df.schema[c].dataType.simpleString()]
    return F.xxhash64(*(x for c in hashed for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))))


def release_memory() -> None:
    """Gives what a batch's work has freed back to the system: a worker's memory counts beside the JVM's, and workers stay for other tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets, without a copy; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[at[0] : at[-1]]
    at = at - at[0]
    return raw, at


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def segment_sums(values: np.ndarray, bounds: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; 0 for empty ranges."""
    out_shape = (len(bounds) - 1, *values.shape[1:])
    out = np.zeros(out_shape, dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=dtype)
    return out


def column_free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
