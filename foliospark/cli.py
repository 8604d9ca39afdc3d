"""Command line: ``python -m foliospark.cli COMMAND ...`` over JSON lines and Parquet in any store that Spark reads."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.functions import storage
from foliospark.functions.frames import ship
from foliospark.operators import chunking, curation, embedding, evaluation, layout, preparation, retrieval
from foliospark.sources import files, html, parsing
from foliospark.sources.cache import VectorCache


def named(place: str):
    """The function or class that ``module:name`` names."""
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def parse(spark: SparkSession, a) -> int:
    """files to elements, by the HTML parser or by any function (path, content, strategy) -> elements"""
    found = parsing.find_files(spark, a.input, pattern=a.glob, recursive=not a.flat)
    if a.parser:
        parsed = storage.written(spark, parsing.parse_files(found, named(a.parser), strategies=tuple(a.strategies.split(","))), "parsed")
        elements = parsing.normalize_elements(parsed)
    else:
        elements = storage.written(spark, html.parse_html(found.select("path", "content")), "parsed")
        parsed = found.select(F.col("path").alias("source_path")).join(elements, "source_path", "left").withColumns({"strategy": F.lit("html"), "error": F.lit(None).cast("string")})
    if a.images:
        elements = parsing.collect_images(elements, a.images)
    if a.tables:
        tables = parsing.extract_tables(found, named(a.tables))
        tables = parsing.write_markdown(tables, a.markdown) if a.markdown else tables
        elements = parsing.replace_tables(elements, tables)
    files.write_jsonl(elements, a.output)
    stats = storage.written(spark, parsing.file_stats(parsed), "stats")
    if a.stats:
        files.write_jsonl(stats, a.stats)
    summary = parsing.batch_summary(stats).first().asDict()
    print(json.dumps(summary))
    return int(summary["failed"] > 0 and not summary["succeeded"])


def prepare(spark: SparkSession, a) -> int:
    """chunk, check, compare with a second run, remove duplicates and check again"""
    made = preparation.prepare(_elements(spark, a.input), max_tokens=a.max_tokens, overlap=a.overlap, strict=a.strict_toc, tokenizer=_tokenizer(a), determinism=not a.skip_determinism, dedup=not a.skip_dedup)
    files.write_jsonl(made.chunks, f"{a.output}/chunks")
    files.write_jsonl(made.manifest, f"{a.output}/manifest")
    if made.unique is not None:
        files.write_jsonl(made.unique, f"{a.output}/unique")
    for r in made.report.collect():
        print(f"{'ok' if r['passed'] else 'FAIL':5} {r['step']}: {r['detail']}")
    return int(not made.passed)


def demo(spark: SparkSession, a) -> int:
    """a small set of chunks to try the other commands on"""
    files.write_jsonl(files.demo_chunks(spark), a.output)
    return 0


def chunk(spark: SparkSession, a) -> int:
    chunks, manifest = chunking.run_chunking(_elements(spark, a.input), max_tokens=a.max_tokens, overlap=a.overlap, strict=a.strict_toc, tokenizer=_tokenizer(a))
    files.write_jsonl(chunks, f"{a.output}/chunks")
    files.write_jsonl(manifest, f"{a.output}/manifest")
    return 0


def _elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements as this package writes them (with ``ord``) or as a parser does (with ``meta``)."""
    names = set(spark.read.json(path).columns)
    return files.read_jsonl(spark, path, schemas.ELEMENT) if "ord" in names else files.read_elements(spark, path)


def check(spark: SparkSession, a) -> int:
    found = curation.invalid_lines(spark, a.input).limit(a.show).collect()
    found = found or curation.violations(files.read_chunks(spark, a.input)).orderBy("doc_id", "ord").limit(a.show).collect()
    for r in found:
        print(f"{r['doc_id']} {r['chunk_id']}: {r['rule']} ({r['detail']})")
    print("FAIL" if found else "OK")
    return int(bool(found))


def dedup(spark: SparkSession, a) -> int:
    chunks = files.read_chunks(spark, a.input)
    unique = curation.unique_chunks(chunks)
    files.write_jsonl(curation.relink(unique), a.output)
    print(json.dumps(curation.duplicate_stats(chunks, unique).first().asDict()))
    return 0


def compare(spark: SparkSession, a) -> int:
    n = curation.differences(files.read_chunks(spark, a.input), files.read_chunks(spark, a.other)).count()
    print(f"{n} rows differ")
    return int(n > 0)


def embed(spark: SparkSession, a) -> int:
    if a.batch_size:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", a.batch_size)
    cache = VectorCache(spark, a.cache) if a.cache else None
    chunks = files.read_chunks(spark, a.input)
    if a.check_links:
        retrieval.check_chain(embedding.rewire(embedding.select_chunks(chunks, a.policy)), scope=("doc_id",))
    vectors, fresh = embedding.embed_chunks(
        chunks, a.policy, _encoder(a), most=a.max_tokens, strategy=a.truncation.replace("+", "_"), normalize=a.l2_normalize, half=a.dtype == "float16", tables=not a.plain_tables,
        describe=embedding.describer(named(a.describe)) if a.describe else None, cache=cache.read() if cache else None, tokenizer=_tokenizer(a),
    )
    files.write_vectors(vectors, a.output)
    if spark.read.parquet(a.output).isEmpty():
        print("No chunk is selected by the policy.")
        return 1
    if cache:
        cache.append(fresh)
    return 0


def _encoder(a):
    return named(a.encoder)(embedding.pick_device(a.device)) if a.encoder else embedding.HashEncoder(a.dimension)


def _tokenizer(a):
    """``module:function`` that gives a tokenizer, or nothing: words between white space."""
    return named(a.tokenizer)() if a.tokenizer else None


def evaluate(spark: SparkSession, a) -> int:
    store = files.read_store(spark, a.store).withColumn("text", F.col("embedding_text"))
    asked = files.read_jsonl(spark, a.questions, "question string, ground_truth_context array<string>")
    numbered = storage.written(spark, asked.withColumn("query_id", F.monotonically_increasing_id()), "questions")
    scored = evaluation.run_evaluation(
        numbered,
        lambda q: retrieval.retrieve(q, store, encoder=_encoder(a), top_k_dense=a.top_k_dense, top_k_sparse=a.top_k_sparse, top_k_rerank=a.top_k, rrf_k=a.rrf_k, context_window_size=a.window),
        top_k=a.top_k,
    )
    totals = evaluation.aggregate(scored)
    report = files.evaluation_report(scored, totals, {k: v for k, v in vars(a).items() if k != "run"})
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(report)
    for name, value in totals.first().asDict().items():
        print(f"{name:18} {value}")
    return 0


def quality(spark: SparkSession, a) -> int:
    elements = _elements(spark, a.input)
    metrics = curation.layout_metrics(elements, layout.page_sizes(elements))
    metrics.write.mode("overwrite").json(f"{a.output}/metrics")
    metrics.write.mode("overwrite").option("header", True).csv(f"{a.output}/csv")
    curation.type_counts(elements).write.mode("overwrite").json(f"{a.output}/types")
    curation.order_sanity(elements).where(~F.col("in_order")).write.mode("overwrite").json(f"{a.output}/ordering")
    if a.page:
        doc = a.doc or elements.agg(F.min("doc_id")).first()[0]
        own = elements.where(F.col("doc_id") == doc)
        with open(a.page, "w", encoding="utf-8") as f:
            f.write(files.quality_page(metrics.where(F.col("doc_id") == doc).orderBy("page_number"), f"Parser quality of {doc}", own, layout.page_sizes(own)))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="foliospark", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name, run, *needed):
        p = commands.add_parser(name, help=(run.__doc__ or name))
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        p.set_defaults(run=run)
        return p

    p = command("parse", parse, "input", "output")
    p.add_argument("--glob", default="*.html")
    p.add_argument("--flat", action="store_true", help="leave out subfolders")
    p.add_argument("--parser", help="module:function of another parser than HTML's")
    p.add_argument("--strategies", default="hi_res,fast")
    p.add_argument("--tables", help="module:function of a table extractor for files whose tables have no markup")
    p.add_argument("--markdown", help="folder for the extracted tables")
    p.add_argument("--images", help="folder that pictures are gathered in")
    p.add_argument("--stats", help="where statistics of each file go")
    for name, run in (("chunk", chunk), ("prepare", prepare)):
        p = command(name, run, "input", "output")
        p.add_argument("--max-tokens", type=int, default=chunking.MAX_TOKENS)
        p.add_argument("--overlap", type=int, default=chunking.OVERLAP_WORDS)
        p.add_argument("--strict-toc", action="store_true")
        p.add_argument("--tokenizer", help="module:function that gives a tokenizer for the budget")
    p.add_argument("--skip-determinism", action="store_true")
    p.add_argument("--skip-dedup", action="store_true")
    command("demo", demo, "output")
    command("check", check, "input").add_argument("--show", type=int, default=20)
    command("dedup", dedup, "input", "output")
    command("compare", compare, "input", "other")
    p = embedder = command("embed", embed, "input", "output")
    p.add_argument("--policy", default=schemas.EMBED_POLICY)
    p.add_argument("--max-tokens", type=int, default=512)
    p.add_argument("--truncation", choices=["head", "tail", "head_tail", "head+tail"], default="head")
    p.add_argument("--cache", help="folder of cached vectors; fresh ones are added")
    p.add_argument("--check-links", action="store_true", help="stop if links between the selected chunks are faulty")
    p.add_argument("--tokenizer", help="module:function that gives a tokenizer for truncation")
    p.add_argument("--batch-size", type=int)
    p.add_argument("--plain-tables", action="store_true", help="embed tables as they are, not as sentences")
    p.add_argument("--describe", help="module:function that describes figures by their path")
    p.add_argument("--dimension", type=int, default=64)
    p.add_argument("--l2-normalize", action="store_true")
    p.add_argument("--dtype", choices=["float32", "float16"], default="float32")
    p = command("evaluate", evaluate, "store", "questions")
    for name, value in (("top-k", 10), ("top-k-dense", 100), ("top-k-sparse", 100), ("rrf-k", 60), ("window", 1), ("dimension", 64)):
        p.add_argument(f"--{name}", type=int, default=value)
    p.add_argument("--output")
    for p in (embedder, p):
        p.add_argument("--encoder", help="module:class of an encoder that takes the device")
        p.add_argument("--device", choices=["auto", "cpu", "cuda", "mps"], default="auto")
    p = command("quality", quality, "input", "output")
    p.add_argument("--page", help="HTML file with the metrics and boxes of one document")
    p.add_argument("--doc", help="its doc_id; the least by default")
    return top


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("foliospark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
