"""Where intermediate tables go, and small Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own, but only with a local master."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    have = spark.sparkContext.getCheckpointDir()
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
        have = spark.sparkContext.getCheckpointDir()
    return have.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/barloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    _WRITTEN[id(out)] = out, at
    return out


#: Tables of materialise() that discard() may remove: (DataFrame, folder).
_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialise() wrote, once nothing reads them any more; other DataFrames are left alone."""
    for df in tables:
        held, at = _WRITTEN.pop(id(df), (None, None))
        if held is df:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def scratch():
    """Gives keep(df). At the end, what materialise() wrote inside is removed, but for tables that were to be kept."""
    before, kept = set(_WRITTEN), []
    try:
        yield kept.append
    finally:
        mine = [df for key, (df, _) in _WRITTEN.items() if key not in before]
        discard(*(df for df in mine if not any(df is k for k in kept)))


def fan_out(spark: SparkSession) -> int:
    """Partitions of our own shuffles: what the session asks for, at least one for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def with_documents_columns(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (null: empty); whatever else docs holds is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches, most: int):
    """Runs of rows of each batch whose texts (column text) hold about `most` bytes together; a row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


#: What operators keep in a Python worker from task to task, by operator: something with clear().
CACHES: dict[str, list] = {}


def tidied(rows, own: str = ""):
    """rows, without what other operators kept in this worker; after them what the task no longer needs goes back to the system."""
    for name, kept in CACHES.items():
        if name != own:
            for held in kept:
                held.clear()
    yield from rows
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueeze(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def put_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 as byte planes of their differences, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return squeeze(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def get_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def put_counts(values: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest width that holds them, compressed; the first byte tells the width."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 2**8 else 2 if top < 2**16 else 4 if top < 2**32 else 8
    return bytes([width]) + squeeze(values.astype(f"<u{width}").tobytes())


def get_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(unsqueeze(blob[1:]), f"<u{blob[0]}").astype(np.int64)
