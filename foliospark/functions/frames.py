"""Functions on whole frames."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores. A scan of fewer splits than there are cores, one small file for example, is dealt out anew;
    larger inputs have splits enough and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that Python workers find it wherever they start."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if context.applicationId in _SHIPPED or not os.path.isdir(root):
        return
    _SHIPPED.add(context.applicationId)
    name = os.path.basename(root)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as packed:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    packed.write(full, os.path.join(name, os.path.relpath(full, root)))
    context.addPyFile(path)


def ship_active() -> None:
    """``ship`` for the active session: for functions that give columns and see no frame."""
    if spark := SparkSession.getActiveSession():
        ship(spark)


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` by workers that have this package; for ``DataFrame.transform``."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def slices(batch, rows: int = 256, size: int = 4 << 20):
    """Parts of an Arrow batch, in order, of at most ``rows`` rows and ``size`` bytes; a larger row is a part by itself.

    What a Python function makes of one part at a time does not grow with the batch that Spark sends.
    """
    if batch.num_rows > rows or (batch.num_rows > 1 and batch.nbytes > size):
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), rows, size)
        yield from slices(batch.slice(half), rows, size)
    elif batch.num_rows:
        yield batch


def parts(texts, rows: int = 256, size: int = 1 << 18):
    """Parts of a pandas series of texts, in order, as lists with '' for null: at most ``rows`` and about ``size`` characters each."""
    part, held = [], 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        if part and (len(part) == rows or held + len(t) > size):
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{directory}/{name}.parquet"))
