"""Retrieval quality: hit rate, reciprocal rank, nDCG and their means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit(retrieved: Column, truth: Column) -> Column:
    return F.coalesce(F.arrays_overlap(retrieved, truth), F.lit(False))


def reciprocal_rank(retrieved: Column, truth: Column) -> Column:
    """1 over the first relevant place, 0 without one."""
    places = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(truth, x), i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(places) > 0, F.lit(1.0) / F.get(places, F.lit(0))).otherwise(0.0)


def _gain(places: Column) -> Column:
    return F.aggregate(places, F.lit(0.0), lambda a, p: a + F.lit(1.0) / F.log2(p.cast("double") + 1))


def ndcg(retrieved: Column, truth: Column, k: int | Column = 10) -> Column:
    """Binary nDCG at the lesser of k and the places there are; 0 without truth."""
    limit = F.least(F.lit(k) if isinstance(k, int) else k, F.size(retrieved))
    ideal = F.least(F.size(F.array_distinct(truth)), limit)
    places = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(truth, x) & (i < limit), i + 1)), lambda p: p.isNotNull())
    best = _gain(F.filter(F.sequence(F.lit(1), F.greatest(ideal, F.lit(1))), lambda p: p <= ideal))
    return F.when(best > 0, _gain(places) / best).otherwise(0.0)


def score(results: DataFrame, *, k: int = 10, retrieved: str = "retrieved_ids", truth: str = "ground_truth_ids") -> DataFrame:
    r, t = F.col(retrieved), F.col(truth)
    return results.withColumn("hit_rate", hit(r, t)).withColumn("mrr", reciprocal_rank(r, t)).withColumn("ndcg", ndcg(r, t, k))


def score_judged(hits: DataFrame, truths: DataFrame, *, k: int = 10) -> DataFrame:
    """``truths``, (query_id, n_truth, ...), with hit_rate, mrr and ndcg from judged hits, (query_id, rank, relevant).

    As ``score``, but the truth is a number of rows, so a query may have any number of them.
    """
    right, place = F.coalesce("relevant", F.lit(False)), F.col("rank").cast("double")
    found = hits.groupBy("query_id").agg(
        F.count("*").alias("__shown"), F.min(F.when(right, place)).alias("__first"), F.sum(F.when(right & (F.col("rank") <= k), F.lit(1.0) / F.log2(place + 1))).alias("__gain")
    )
    ideal = F.least(F.col("n_truth"), F.lit(k), F.coalesce("__shown", F.lit(0))).cast("int")
    best = _gain(F.filter(F.sequence(F.lit(1), F.greatest(ideal, F.lit(1))), lambda p: p <= ideal))
    joined = truths.join(found, "query_id", "left").withColumn("hit_rate", F.col("__first").isNotNull()).withColumn("mrr", F.coalesce(F.lit(1.0) / F.col("__first"), F.lit(0.0)))
    return joined.withColumn("ndcg", F.when(best > 0, F.coalesce("__gain", F.lit(0.0)) / best).otherwise(0.0)).drop("__shown", "__first", "__gain")


def aggregate(scored: DataFrame) -> DataFrame:
    """Means over the rows without an error, and the numbers of all, valid and failed questions; means are 0 without valid rows."""
    columns = scored.columns
    failed = F.col("error").isNotNull() if "error" in columns else F.lit(False)
    latency = F.col("latency_seconds") if "latency_seconds" in columns else F.lit(0.0)
    mean = lambda c: F.coalesce(F.avg(F.when(~failed, c)), F.lit(0.0))
    return scored.agg(
        mean(F.col("hit_rate").cast("double")).alias("hit_rate"), mean(F.col("mrr")).alias("mean_mrr"), mean(F.col("ndcg")).alias("mean_ndcg"), mean(latency).alias("mean_latency"),
        F.count("*").alias("total_questions"), F.count_if(~failed).alias("valid_questions"), F.count_if(failed).alias("failed_questions"),
    )


#: Questions that are tried alone when a whole level of halves has failed alike, and batches that are tried in all.
PROBES, MOST_TRIES = 8, 256


def run_evaluation(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], *, top_k: int = 10, probes: int = PROBES, most_tries: int = MOST_TRIES) -> DataFrame:
    """Scores of every question of (query_id, question, ground_truth_context), with ``latency_seconds`` and ``error``.

    ``retrieve`` takes (query_id, query) and gives (query_id, rank, chunk_id); all questions go as one batch and the wall
    time is shared among them. If a batch fails, its halves (by a hash of the id) are tried apart, a level at a time, down to
    single questions: each failing question gets its error and zero scores, and all others their results. Where the halves
    have all failed with one class of error and no batch has succeeded, ``probes`` questions are tried alone: if they fail so
    too, the engine itself is down, and every question gets that error. After ``most_tries`` batches the questions of those
    that are still to be parted get the error of their batch, which says so. Questions without an id share one fate. Hits stay
    in the shared folder and errors are joined as a table; nothing but error messages reaches the driver.
    """
    import time

    from foliospark.functions import storage

    spark = questions.sparkSession
    base = questions.select("query_id", "question", F.coalesce("ground_truth_context", F.array().cast("array<string>")).alias("ground_truth_ids"))
    base = storage.written(spark, base, "questions")
    asked = base.select("query_id", F.col("question").alias("query"))
    bits, found, failed, began, tries = F.xxhash64("query_id"), [], [], time.time(), 0
    of = lambda place, level: bits.bitwiseAND(F.lit((1 << level) - 1)) == place

    def tried(part: DataFrame) -> Exception | None:
        nonlocal tries
        tries += 1
        try:
            hits = retrieve(part).where(F.col("rank") <= top_k).select(F.col("query_id").cast("string").alias("query_id"), "rank", F.col("chunk_id").cast("string").alias("chunk_id"))
            found.append(storage.written(spark, hits, "hits"))
        except Exception as e:
            return e
        return None

    def alone() -> Exception | None:
        """The error that some single questions all fail with, if they do."""
        error = None
        for r in asked.select("query_id").where("query_id IS NOT NULL").orderBy(F.xxhash64("query_id", F.lit(1))).limit(probes).collect():
            before = len(found)
            error = tried(asked.where(F.col("query_id") == r["query_id"]))
            del found[before:]  # a probe's hits come again with its batch
            if error is None:
                return None
        return error

    level, kinds = 0, set()
    error = tried(asked)
    pending = [] if error is None else [(0, error)]
    while pending:
        kinds |= {type(e) for _, e in pending}
        if level == 2 and not found and len(kinds) == 1 and (down := alone()) is not None and type(down) in kinds:
            failed.append((0, 0, str(down)))
            break
        sizes = {r["place"]: r["n"] for r in asked.groupBy(bits.bitwiseAND(F.lit((1 << level) - 1)).alias("place")).agg(F.count_distinct("query_id").alias("n")).where(F.col("place").isin([p for p, _ in pending])).collect()}
        ahead = []
        for place, error in pending:
            if sizes.get(place, 0) < 2 or level == 62:
                failed.append((place, level, str(error)))
                continue
            for side in (place, place + (1 << level)):
                half = asked.where(of(side, level + 1))
                if tries >= most_tries:
                    failed.append((side, level + 1, f"one of a batch that failed and was not parted further after {tries} tries: {error}"))
                elif not half.isEmpty() and (own := tried(half)) is not None:
                    ahead.append((side, own))
        pending, level = ahead, level + 1
    took = (time.time() - began) / max(1, base.count())
    ranked = spark.createDataFrame([], "query_id string, rank int, chunk_id string")
    for hits in found:
        ranked = ranked.unionByName(hits)
    lists = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved_ids"))
    errors = spark.createDataFrame(failed, "place long, level int, error string")  # at most 2 x most_tries rows
    levels = sorted({n for _, n, _ in failed})
    marks = F.array(*[F.struct(F.lit(n).alias("level"), bits.bitwiseAND(F.lit((1 << n) - 1)).alias("place")) for n in levels]) if levels else None
    joined = base.join(lists, base["query_id"].cast("string") == lists["query_id"], "left").drop(lists["query_id"])
    if marks is None:
        joined = joined.withColumn("error", F.lit(None).cast("string"))
    else:
        told = errors.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.struct("level", "place"), "error"))).alias("errors"))
        joined = joined.join(F.broadcast(told)).withColumn("error", F.array_max(F.transform(marks, lambda m: F.element_at("errors", m)))).drop("errors")
    full = joined.withColumn("retrieved_ids", F.coalesce("retrieved_ids", F.array().cast("array<string>")))
    scored = score(full, k=top_k).withColumn("latency_seconds", F.when(F.col("error").isNull(), took).otherwise(0.0))
    return scored.select(*[c for c in scored.columns if c != "error"], "error")
