"""Tables, the shared scratch folder and grouping over sorted Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20
#: Modules that keep something in _open between the tasks of a worker.
KEEPERS = ("vellum.llm._bpe", "vellum.llm.token_counts")
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut and it is computed once."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/vellum/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def unsettle(df: DataFrame) -> None:
    """The files of a settled df go before the end, when nothing reads them any more."""
    at = (df.sparkSession, df._settled_at)
    _delete(*at)
    _written.remove(at)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before
            return


def text_key() -> Column:
    """text_key: the hash of a row's text (of null too), by which rows of one doc_id, or of none, are told apart."""
    return F.xxhash64(F.col("text").cast("string")).alias("text_key")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Arrow batches of a bounded number of rows and bytes, as texts can be long; settings of the session that are lower stay."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(key, most)


def give_back() -> None:
    """Memory that this process has freed, but its allocators still hold, goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def frugal(f: Callable, keeps: str = "") -> Callable:
    """f, for mapInArrow, in a worker that outlives its task: what modules other than ``keeps`` have in _open goes first, what the task has freed at its end."""

    @functools.wraps(f)
    def run(batches):
        for m in KEEPERS:
            if m != keeps and m in sys.modules:
                sys.modules[m]._open.clear()
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal non-null long keys, of batches sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        new[0] = last is not None and first != last
        cuts = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if held and new[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def long_lists(values: list[np.ndarray]) -> pa.Array:
    offs = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offs[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))
