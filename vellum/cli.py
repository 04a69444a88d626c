"""spark-submit entry: ``fix INPUTS`` repairs books and writes them and their reports."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parser(settings: dict) -> argparse.ArgumentParser:
    """Options, with defaults from settings (see config_from_env)."""
    top = argparse.ArgumentParser(prog="vellum")
    fix = top.add_subparsers(dest="command", required=True).add_parser("fix", help="repair books")
    fix.add_argument("inputs", nargs="+", help="*.epub files, or with --batch folders of them")
    fix.add_argument("--batch", action="store_true")
    fix.add_argument("--dry-run", action="store_true", help="report the changes without making them")
    fix.add_argument("--interactive", action="store_true", help="ask about each flagged change on the console")
    fix.add_argument("--decisions", help="JSON lines of book_id, seq, accept for flagged changes")
    fix.add_argument("--rebuild-graph", action="store_true", help="ask the provider even where the cache has an answer")
    fix.add_argument("--cache", default=settings.get("cache"), help="folder of graphs found before")
    fix.add_argument("--llm", default=settings.get("llm"), help="model to ask for entities; without it capitalised words are taken")
    fix.add_argument("--llm-url", default=settings.get("llm_url"), help="address of a chat completion service")
    fix.add_argument("--api-key", default=settings.get("api_key"))
    fix.add_argument("--concurrency", type=int, default=settings.get("concurrency", 4))
    fix.add_argument("--catalogue", default=settings.get("catalogue"), help="file or address of a catalogue of models")
    fix.add_argument("--reconcile", default=None, help="JSON lines of book, category, ord, members, canonical, confidence: groups of names that are one")
    fix.add_argument("--no-reconcile", dest="reconcile", action="store_const", const=None)
    fix.add_argument("--use-batch", metavar="FOLDER", help="write requests for a batch service there, or read its replies.jsonl")
    fix.add_argument("--chunk-chars", type=int, default=settings.get("chunk_chars"))
    fix.add_argument("--num-ctx", type=int, default=settings.get("num_ctx"))
    fix.add_argument("--words", default=settings.get("words"), help="text file of a dictionary, a word a line")
    fix.add_argument("--source-uid", default=settings.get("source_uid"))
    fix.add_argument("--report-dir", default=settings.get("report_dir"))
    fix.add_argument("--out", required=True, help="folder that all executors share")
    return top


def asked(changes: DataFrame, ask=input) -> DataFrame:
    """(book_id, seq, accept): answers to the flagged changes, one by one; their number is what a person can answer."""
    from vellum.operators.report import pending_review

    said = []
    for c in pending_review(changes).orderBy("book_id", "seq").toLocalIterator():
        reply = ask(f"{c['book_id']}: {c['description']} at {c['location']}: {c['original'] or ''} -> {c['replacement'] or ''}? [y/N] ")
        said.append((c["book_id"], c["seq"], reply.strip().lower().startswith("y")))
    return changes.sparkSession.createDataFrame(said, "book_id string, seq long, accept boolean")


def main(argv: list[str] | None = None) -> int:
    from vellum import providers
    from vellum.operators.report import write_reports
    from vellum.plans.repair import Config, repair_books
    from vellum.sources.epub import read_books, write_books
    from vellum.sources.tables import config_from_env, exists, summary_lines

    a = parser(config_from_env(dotenv=os.path.join(os.getcwd(), ".env"))).parse_args(argv)
    if not a.batch and not all(x.endswith(".epub") for x in a.inputs):
        print("folders need --batch", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    books = None
    for x in sorted(a.inputs):
        b = read_books(spark, x)
        books = b if books is None else books.unionByName(b)
    books = books.dropDuplicates(["book_id"]).select("book_id", "content")
    provider, model = providers.capitalised, "capitalised"
    if a.llm:
        model, ask = a.llm, providers.chat(a.llm_url or "http://localhost:11434/v1", a.llm, a.api_key)
        provider = lambda chunks: providers.called(chunks, ask, a.concurrency)
    if a.use_batch and exists(spark, f"{a.use_batch}/replies.jsonl"):
        provider = providers.batched(spark.read.text(f"{a.use_batch}/replies.jsonl"))
    elif a.use_batch:
        provider = _requested(f"{a.use_batch}/requests", model)
    info = providers.model_info(model, providers.read_catalogue(a.catalogue)) if a.catalogue else providers.ModelInfo()
    groups = spark.read.schema("book string, category string, ord int, members array<string>, canonical string, confidence string").json(a.reconcile) if a.reconcile else None
    config = Config(
        max_chunk_chars=a.chunk_chars, num_ctx=a.num_ctx or info.max_input_tokens, provider=provider, model=model, dry_run=a.dry_run or a.interactive, source_uid=a.source_uid,
        interactive_decisions=spark.read.schema("book_id string, seq long, accept boolean").json(a.decisions) if a.decisions else None,
        words=spark.read.text(a.words).select(F.trim("value").alias("word")) if a.words else None, cache=a.cache, rebuild_graph=a.rebuild_graph, reconcile=None if groups is None else lambda _: groups,
    )
    out = repair_books(books, config)
    if a.use_batch and provider is not None and not exists(spark, f"{a.use_batch}/replies.jsonl"):
        print(f"requests written to {a.use_batch}/requests; run again when replies.jsonl is there")
        return 0
    if a.interactive and not a.dry_run:
        from dataclasses import replace

        out = repair_books(books, replace(config, dry_run=False, rebuild_graph=False, interactive_decisions=asked(out.changes)))
    for line in summary_lines(out.report):
        print(line)
    if not a.dry_run:
        write_books(out.books, a.out)
        write_reports(out.report, a.report_dir or a.out)
    return 0


def _requested(folder: str, model: str):
    """A provider that writes its requests and has no replies yet."""
    from vellum import providers

    def none(chunks: DataFrame) -> DataFrame:
        providers.batch_requests(chunks, model).write.mode("overwrite").text(folder)
        return chunks.select("book", "chunk_no", F.lit(None).cast("string").alias("raw")).where("false")

    return none


if __name__ == "__main__":
    sys.exit(main())
