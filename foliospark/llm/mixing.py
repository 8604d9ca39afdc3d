"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

Each document draws a uniform number from a hash of its id and the seed; the inverse of the Poisson distribution with
its source's mean repetition rate turns it into a count. The document is exploded by that count and the copies are
shuffled globally by another hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import hot_join, hot_keys, text_or_empty, written

#: Sources up to which their rates (a few numbers each) are broadcast; beyond it they are joined by a shuffle.
FEW_SOURCES = 10_000
#: The distribution is inverted within so many deviations and counts about its mean: beyond lies less than 1e-18 of it, while
#: the uniform numbers have 48 bits.
DEVIATIONS, EXTRA = 9, 16
#: Bytes of text for which a shuffle partition is made, where that gives more than the session's number.
PART_BYTES = 256 << 20


def uniform(key: Column, seed: int, what: str) -> Column:
    """A number in (0, 1) with 48 bits from the MD5 of seed, purpose and key."""
    hexed = F.md5(F.concat(F.lit(f"{seed}:{what}:"), key).cast("binary"))
    return (F.conv(F.substring(hexed, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def poisson_start(rate: Column) -> Column:
    """struct<low, high, first, total>: the counts that matter, the weight of the lowest, and the sum of all weights.

    Weights are those of the distribution over that of its mode, found by steps outward from it; so no rate underflows, and
    a source needs four numbers whatever its rate.
    """
    spread = F.ceil(DEVIATIONS * F.sqrt(rate)) + EXTRA
    mode = F.floor(rate).cast("int")
    low, high = F.greatest(F.lit(0), mode - spread).cast("int"), (mode + spread).cast("int")
    none = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))

    def step(acc: Column, factor: Column) -> Column:
        return F.struct((acc["w"] * factor).alias("w"), (acc["sum"] + acc["w"] * factor).alias("sum"))

    below = F.when(mode > low, F.aggregate(F.sequence(mode, low + 1, F.lit(-1)), none, lambda a, k: step(a, k / rate))).otherwise(none)
    above = F.aggregate(F.sequence(mode + 1, high), none, lambda a, k: step(a, rate / k))
    return F.struct(low.alias("low"), high.alias("high"), below["w"].alias("first"), (below["sum"] + 1 + above["sum"]).alias("total"))


def poisson_count(start: Column, rate: Column, u: Column) -> Column:
    """The least count whose distribution function reaches ``u``. Its steps are fewer than nine deviations, in constant memory."""
    begin = F.struct(start["first"].alias("w"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        total = acc["sum"] + acc["w"]
        return F.struct((acc["w"] * rate / (k + 1)).alias("w"), total.alias("sum"), (acc["n"] + F.when(total < u * start["total"], 1).otherwise(0)).alias("n"))

    return F.when(rate <= 0, 0).otherwise(start["low"] + F.aggregate(F.sequence(start["low"], start["high"]), begin, step, lambda a: a["n"])).cast("int")


def source_rates(docs: DataFrame, weights: dict[str, float] | None, *, source_column: str, text_column: str, exponent: float, budget: float) -> DataFrame:
    """(source, bytes, n, rate): mean repetitions that bring each source's bytes to its weight's share of ``budget`` x all bytes.

    Without ``weights``, a source weighs its bytes to the power ``exponent``. With them, sources not named get rate 0.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source")).agg(
        F.sum(F.octet_length(text_or_empty(text_column)).cast("long")).alias("bytes"), F.count("*").alias("n")
    )
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(exponent)))
    else:
        if any(w < 0 or not math.isfinite(w) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        given = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "source string, weight double")
        weighed = sizes.join(F.broadcast(given), "source", "left").fillna(0.0, ["weight"])
    weighed = written(docs.sparkSession, weighed, "source-sizes")
    total = weighed.where("bytes > 0").agg(F.sum("bytes").alias("bytes"), F.sum("weight").alias("weight")).first()
    if not total["weight"]:
        return weighed.select("source", "bytes", "n", F.lit(0.0).alias("rate"))
    rate = F.lit(budget) * F.lit(float(total["bytes"])) * F.col("weight") / F.lit(total["weight"]) / F.col("bytes")
    return weighed.select("source", "bytes", "n", F.when(F.col("bytes") > 0, rate).otherwise(0.0).alias("rate"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    seed: int = 17,
    exponent: float = 0.5,
    budget: float = 1.0,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """``docs`` replicated, with ``replica`` (from 0), ``n_copies``, ``rate`` (rounded to 6 places) and ``shuffle_key``.

    Rows are dealt to partitions and ordered within them by the hash of id, replica and seed. Null ids hash as the empty
    string and null sources form one source named by it; null texts have no bytes; a source without bytes, and an empty
    table, give no rows. Rows that repeat an id draw the same count. Texts of any length are carried whole; ties of the
    shuffle key stand in any order. Columns of ``docs`` with the new names are replaced, others may have any name.
    Without ``partitions``, they are the session's number, and adaptive execution may join them, or one for every
    PART_BYTES of text where that is more.
    """
    spark, new = docs.sparkSession, ("replica", "n_copies", "rate", "shuffle_key")
    columns = [c for c in docs.columns if c not in new]
    sizes = source_rates(docs, weights, source_column=source_column, text_column=text_column, exponent=exponent, budget=budget)
    rates = sizes.select(F.col("source").alias("__source"), F.col("rate").alias("__exact"), poisson_start(F.col("rate")).alias("__start"))
    key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("__source"), key.alias("__id"),
        uniform(key, seed, "count").alias("__u"),
    )
    if rates.count() <= FEW_SOURCES:
        met = packed.join(F.broadcast(rates), "__source")  # five numbers a source
    else:  # a source may have a third of all rows: those are dealt to many tasks
        met = hot_join(packed, rates, ["__source"], hot_keys(sizes.select(F.col("source").alias("__source"), "n"), ["__source"]), F.col("__id"))
    copies = (
        met.withColumn("n_copies", poisson_count(F.col("__start"), F.col("__exact"), F.col("__u"))).where("n_copies > 0")
        .withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
        .withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}:order:"), F.col("__id"), F.lit(":"), F.col("replica").cast("string")).cast("binary")))
    )
    expected = sizes.agg(F.sum(F.col("bytes") * F.col("rate"))).first()[0] or 0.0
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = partitions or max(session, math.ceil(expected / PART_BYTES))
    dealt = copies.repartition("shuffle_key") if partitions is None and n == session else copies.repartition(n, "shuffle_key")
    named = [F.col("__row").getField(c).alias(c) for c in columns]
    return dealt.sortWithinPartitions("shuffle_key").select(*named, "replica", "n_copies", F.round("__exact", 6).alias("rate"), "shuffle_key")
