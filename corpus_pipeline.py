"""A training corpus from documents: five stages, each a DataFrame written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm._shared import settle, table, text_key
from vellum.llm.minhash_dedup import minhash_dedup
from vellum.llm.mixing import mix_sources
from vellum.llm.packing import pack_documents
from vellum.llm.quality_rules import quality_rules
from vellum.llm.queries import BYTE_BPE, tokenizer_path
from vellum.llm.suffix_dedup import suffix_dedup


def _keep(docs: DataFrame, judged: DataFrame, *more: str) -> DataFrame:
    """Rows of docs that are kept, each by the verdict on its own doc_id (or none), text and further columns."""
    keys = ["doc_id", "text_key", *more]
    gone = judged.where("NOT kept").select(*[F.col(k).alias(f"gone_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same &= (text_key() if k == "text_key" else F.col(k)).eqNullSafe(F.col(f"gone_{k}"))
    return docs.join(gone, same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are probably bad by the votes of all rules go."""
    return _keep(docs, quality_rules(docs, keyed=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their five-word shingles the smallest id stays, once; all rows without an id stay."""
    named = docs.where("doc_id IS NOT NULL")
    kept = _keep(named, minhash_dedup(named, words=5, percent=80, keyed=True))
    # of an id's rows in one component one text is kept: only repeats of it are left
    once = kept.withColumn("text_key", text_key()).dropDuplicates(["doc_id", "text_key"]).drop("text_key")
    return once.unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that are still found elsewhere are cut out of the texts; bytes of a split character go too."""
    cut = suffix_dedup(docs, length=200)
    # the replacement characters that the text has itself are written as another character's escape meanwhile
    text = F.col("kept").cast("string")
    for a, b in (("\x01", "\x01a"), ("\ufffd", "\x01b"), (None, None), ("\ufffd", ""), ("\x01b", "\ufffd"), ("\x01a", "\x01")):
        text = F.make_valid_utf8(text) if a is None else F.replace(text, F.lit(a), F.lit(b))
    made = {"text": F.when(F.col("n_removed") > 0, text).otherwise(F.col("kept").cast("string"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("row.n_chars"))
    return cut.select(*[(made[c] if c in made else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that tokens follow the flattened source, language and topic marginals, nine tenths of them in all."""
    return _keep(docs, mix_sources(docs, share=0.9, keyed=True), "source", "lang")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    out = pack_documents(docs, tokenizer_path(BYTE_BPE), end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("minhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("target weights", target_weights),
    ("packing", packed),
]

#: Signatures, a tokenizer and retrieval have no SQL form; the pipeline is tested against its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, name.replace(" ", "-"))
    return docs
