"""One run from elements to checked, unique chunks: chunk, check, compare with a second run, remove duplicates, check again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import storage
from foliospark.operators import chunking, curation


@dataclass
class Prepared:
    """``chunks``, ``manifest`` and, unless left out, ``unique`` are tables in the shared folder; ``report`` has a row a step."""

    chunks: DataFrame
    manifest: DataFrame
    unique: DataFrame | None
    report: DataFrame
    passed: bool


def prepare(elements: DataFrame, *, max_tokens: int = chunking.MAX_TOKENS, overlap: int = chunking.OVERLAP_WORDS, strict: bool = False, tokenizer=None, determinism: bool = True, dedup: bool = True) -> Prepared:
    """Runs the steps in order and stops at the first that fails; steps after it are not in the report.

    The report has (step, passed, detail): the number of chunks, broken rules, rows in which two runs differ, and duplicates.
    """
    spark, steps = elements.sparkSession, []
    run = lambda: chunking.run_chunking(elements, max_tokens=max_tokens, overlap=overlap, strict=strict, tokenizer=tokenizer)
    made, manifest = run()
    chunks, manifest = storage.written(spark, made, "chunks"), storage.written(spark, manifest, "manifest")
    unique = None

    def step(name: str, good: bool, detail: str) -> bool:
        steps.append((name, good, detail))
        return good

    def checked(name: str, rows: DataFrame) -> bool:
        broken = {r["rule"]: r["n"] for r in curation.violations(rows).groupBy("rule").agg(F.count("*").alias("n")).collect()}  # a row a rule
        return step(name, not broken, ", ".join(f"{rule}: {n}" for rule, n in sorted(broken.items())))

    n = chunks.count()
    good = step("chunk", n > 0, f"{n} chunks") and checked("check", chunks)
    if good and determinism:
        different = curation.differences(chunks, run()[0]).count()
        good = step("determinism", not different, f"{different} rows differ")
    if good and dedup:
        unique = storage.written(spark, curation.relink(curation.unique_chunks(chunks)), "unique")
        stats = curation.duplicate_stats(chunks, unique).first()
        good = step("dedup", True, f"{stats['removed']} of {stats['original']} removed") and checked("check unique", unique)
    return Prepared(chunks, manifest, unique, spark.createDataFrame(steps, "step string, passed boolean, detail string"), good)
