"""Joins that hold against hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than this part of all rows (and more than LEAST_HOT), so there are fewer than so many hot keys.
HOT_PARTS, LEAST_HOT = 4096, 20_000


def hot_keys(counted: DataFrame, keys: list[str], *, n: str = "n", least: int | None = None) -> DataFrame:
    """(keys, __splits) of the hot keys of ``counted`` (keys, n): fewer than HOT_PARTS rows, whatever the input's size."""
    total = counted.agg(F.sum(n)).first()[0] or 0
    size = float(max(total / HOT_PARTS, LEAST_HOT if least is None else least))
    found = counted.where(F.col(n) > size).select(*keys, F.ceil(F.col(n) / size).cast("int").alias("__splits"))
    return counted.sparkSession.createDataFrame(found.collect(), found.schema)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique, so that no task gets a whole hot key.

    ``hot`` is what ``hot_keys`` gives for the left side; its size is bounded, so it is broadcast. A hot key's left rows are
    dealt to its splits by the hash of ``spread``, its right row is repeated for each: fewer than 2 x HOT_PARTS rows more.
    """
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), F.coalesce("__splits", F.lit(1))).cast("int")).drop("__splits")
    repeated = right.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__splits", F.lit(1)) - 1))).drop("__splits")
    return dealt.join(repeated, [*keys, "__salt"], how).drop("__salt")
