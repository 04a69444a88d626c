"""Token ids in ORC: stripes of run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm._bpe import SLICE, encoder
from vellum.llm._shared import small_batches
from vellum.llm._text import crc32_le, slices

SCHEMA = "doc_id long, part int, before long, tokens array<int>"


def _encoded(path: str, end_id: int):
    def run(batches):
        e, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for b in batches:
            for i, j, buf, offs in slices(b.column(1), SLICE):
                ids, to = e.encode(buf, offs)
                ends = to + np.arange(len(to))
                out = np.empty(ends[-1], np.int32)
                stop = np.zeros(len(out), bool)
                stop[ends[1:] - 1] = True
                out[stop] = end_id
                out[~stop] = ids
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(before + ends[:-1]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))],
                    names=["doc_id", "part", "before", "tokens"],
                )
                before += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, to: str, tokenizer: str, end_id: int = 0, stripe_bytes: int = 16 << 20, row_index: int = 1000) -> None:
    """Encodes ``docs(doc_id, text)`` whole and writes the ids, each text's with ``end_id`` after them, as ORC below ``to``.

    Files hold consecutive ranges of doc_id in ascending order (null first), rows ascend
    within a file; ``part`` is the file's place in that order and ``before`` the number of
    ids before the row in its file. Ids are integers in ORC's run-length encoding; each
    stripe has row indexes every ``row_index`` rows and a Bloom filter on doc_id, so a
    reader takes single stripes in parallel and skips by metadata. A null or empty text
    gives the end id alone; repeated rows give rows each; an empty table an empty one.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(_encoded(tokenizer, end_id), SCHEMA)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(row_index), "orc.stripe.size": str(stripe_bytes), "compression": "zstd"}
    rows.write.options(**options).orc(to)


def read_tokens(spark: SparkSession, at: str, low: int | None = None, high: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """Rows of the written table; ranges and lists of ids are pushed down to stripe statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(at)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return rows if ids is None else rows.where(F.col("doc_id").isin(list(ids)))


def _summed(batches):
    for b in batches:
        lists = b.column(3)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        n = np.asarray(lists.value_lengths()).astype(np.int64)
        end = np.cumsum(n)
        crc = [crc32_le(flat[e - k : e]) for e, k in zip(end.tolist(), n.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])


def token_digest(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows as ``read_tokens`` gives them, ``start`` counted over all files."""
    rows = rows.mapInArrow(_summed, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a file, so this single small partition does not grow with the rows
    ahead = totals.selectExpr("part", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead")
    return rows.join(ahead, "part").select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
