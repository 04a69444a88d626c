"""Incremental repair of a folder that books land in (an extension: batch runs need none of it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length long, content binary"


def landing(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of (book_id, sha256, content, arrived) of *.epub files as they land."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.epub").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select(F.col("path").alias("book_id"), F.sha2("content", 256).alias("sha256"), "content", F.col("modificationTime").alias("arrived"))


def once_each(books: DataFrame, late: str = "7 days") -> DataFrame:
    """Equal files once, as long as their copies arrive within the given time of each other."""
    return books.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["sha256"])


def run(books: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Each micro-batch through ``step(books, batch_id)``, which writes; started again it goes on where it stopped."""
    writer = books.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
