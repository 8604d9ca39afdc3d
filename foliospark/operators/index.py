"""A stored index for exact dense search: vectors in cells around pivots, cells and blocks with bounds.

Every row goes to the nearest of some pivots. A cell's rows are stored in blocks, nearest to the pivot first, each with the
least and most distance from it. A query first reads the few cells around it and takes the k-th hit for a cutoff; by the
triangle inequality it then needs no block whose bound cannot reach that. So results are those of ``dense_search``, and
what is read depends on how the vectors cluster; ``search`` tells how many rows each query was compared with.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import storage
from foliospark.functions.frames import in_arrow
from foliospark.functions.joins import hot_join
from foliospark.operators.retrieval import nearest

#: Cells at most; pivots are fitted on so many rows at most, those of the least hashes of their ids.
MOST_CELLS, SAMPLE, ROUNDS = 1024, 16_384, 4
#: Rows of a block, queries that meet it at a time, and blocks of a cell for one task.
BLOCK, QUERIES, BLOCKS_A_TASK = 2048, 1024, 16


def fitted(sample, cells: int, rounds: int = ROUNDS):
    """Pivots: rows of the sample that lie apart, moved to their members' means a few times. Any pivots give right results."""
    import numpy as np

    v = np.asarray(sample, np.float64)
    chosen = v[:: max(1, len(v) // cells)][:cells].copy()
    for _ in range(rounds):
        apart = np.square(v).sum(1)[:, None] - 2 * v @ chosen.T + np.square(chosen).sum(1)[None, :]
        own = apart.argmin(1)
        for c in np.unique(own):
            chosen[c] = v[own == c].mean(0)
    return chosen


def _sampled(rows: DataFrame, n: int) -> DataFrame:
    """(v) of the SAMPLE rows of least hashes of their ids.

    Every task gives the driver its own SAMPLE rows of the least hashes, so hashes are bounded first: of ``n`` rows, some five
    quarters of SAMPLE are left, wherever they lie.
    """
    hashed = rows.withColumn("h", F.xxhash64("id"))
    if n > 2 * SAMPLE:
        hashed = hashed.where(F.col("h") < int(-(2**63) + 2**64 * min(1.25 * SAMPLE / n, 1)))
    return hashed.orderBy("h", "id").limit(SAMPLE).select("v")


@dataclass(frozen=True)
class Cells:
    """What the driver knows of an index: at most MOST_CELLS pivots, with the number of rows and blocks and the radius of each cell."""

    pivots: list[list[float]]
    rows: list[int]
    blocks: list[int]
    radius: list[float]

    def apart(self, q):
        """Distances of queries from the pivots."""
        import numpy as np

        p = np.array(self.pivots, np.float64)
        return np.sqrt(np.maximum(np.square(q).sum(1)[:, None] - 2 * q @ p.T + np.square(p).sum(1)[None, :], 0))


def bound(apart, length, product, least, most, metric: str):
    """The best score (lower is better) that rows between ``least`` and ``most`` from a pivot can have, less a margin for rounding."""
    import numpy as np

    margin = 1e-6 * (1 + apart + length + most)
    if metric == "ip":
        return -(product + length * (most + margin)) - 1e-9 * np.abs(product)
    near = np.maximum(np.maximum(apart - most, least - apart) - margin, 0)
    return np.square(near) * (1 - 1e-9)


class DenseIndex:
    """An index under ``path``: ``blocks`` and ``cells`` as Parquet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.blocks = spark.read.parquet(f"{self.path}/blocks")
        found = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # MOST_CELLS at most
        self.cells = Cells([list(r["pivot"]) for r in found], [r["rows"] for r in found], [r["blocks"] for r in found], [r["radius"] for r in found])
        self.row_id = json.loads(spark.read.text(f"{self.path}/about").first()[0])["row_id"]

    @staticmethod
    def build(store: DataFrame, path: str, *, row_id: str = "chunk_id", vector: str = "vector", cells: int | None = None, block: int = BLOCK) -> DenseIndex:
        """Writes the index of all rows of ``store``; vectors must be there, finite and of one dimension.

        Rows are dealt by cell and distance, so a cell of any size is spread over tasks. An empty store gives an empty index.
        """
        spark = store.sparkSession
        rows = store.select(F.col(row_id).alias("id"), F.col(vector).alias("v"))
        n = rows.count()
        wanted = min(MOST_CELLS, cells or max(1, round(n**0.5 / 2)), max(n, 1))
        sample = [list(r["v"]) for r in _sampled(rows, n).collect() if r["v"] is not None]
        pivots = fitted(sample, wanted).tolist() if sample else []
        own, kind = store.schema[row_id].dataType, store.schema[vector].dataType
        placed = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType()), T.StructField("id", own), T.StructField("v", kind)])
        packed = T.StructType(
            [T.StructField("cell", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("least", T.DoubleType()), T.StructField("most", T.DoubleType()),
             T.StructField("ids", T.ArrayType(own)), T.StructField("flat", kind)]
        )

        def place(batches: Iterator):
            import numpy as np
            import pyarrow as pa

            known = Cells(pivots, [], [], [])
            for batch in batches:
                if not batch.num_rows:
                    continue
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if batch.column(1).null_count or len(flat) != batch.num_rows * len(pivots[0]) or not np.isfinite(flat).all():
                    raise ValueError("stored vectors must be there, finite and of one dimension")
                apart = known.apart(flat.reshape(batch.num_rows, -1))
                cell = apart.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(apart[np.arange(len(cell)), cell]), batch.column(0), batch.column(1)], names=["cell", "away", "id", "v"])

        def pack(batches: Iterator):
            import numpy as np
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow, number = to_arrow_schema(packed), 0
            held: list = []

            def told():
                nonlocal number
                part = pa.concat_arrays([h[2] for h in held])
                away = np.concatenate([h[1] for h in held])
                number += 1
                flat = pa.concat_arrays([h[3] for h in held]).flatten()
                listed = lambda values, to: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(to)
                columns = [pa.array([held[0][0]], pa.int32()), pa.array([number]), pa.array([len(away)], pa.int32()), pa.array([away.min()]), pa.array([away.max()]), listed(part, arrow.field("ids").type), listed(flat, arrow.field("flat").type)]
                held.clear()
                return pa.RecordBatch.from_arrays(columns, schema=arrow)

            for batch in batches:
                if not batch.num_rows:
                    continue
                cell, away = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                edges = [0, *(np.nonzero(cell[1:] != cell[:-1])[0] + 1).tolist(), len(cell)]
                for low, high in zip(edges, edges[1:], strict=False):
                    if held and held[0][0] != cell[low]:
                        yield told()
                    while low < high:
                        room = block - sum(len(h[1]) for h in held)
                        end = min(high, low + room)
                        held.append((int(cell[low]), away[low:end], batch.column(2).slice(low, end - low), batch.column(3).slice(low, end - low)))
                        low = end
                        if sum(len(h[1]) for h in held) == block:
                            yield told()
            if held:
                yield told()

        dealt = storage.written(spark, rows.transform(in_arrow, place, placed), "index-rows") if pivots else spark.createDataFrame([], placed)
        ranged = dealt.repartitionByRange("cell", "away").sortWithinPartitions("cell", "away", "id")
        ranged.transform(in_arrow, pack, packed).write.mode("overwrite").parquet(f"{path}/blocks")
        told = spark.read.parquet(f"{path}/blocks").groupBy("cell").agg(F.sum("n").alias("rows"), F.count("*").alias("blocks"), F.max("most").alias("radius"))
        known = spark.createDataFrame([(c, [float(x) for x in p]) for c, p in enumerate(pivots)], "cell int, pivot array<double>")
        full = known.join(told, "cell", "left").fillna(0, ["rows", "blocks"]).fillna(0.0, ["radius"])
        full.write.mode("overwrite").parquet(f"{path}/cells")
        spark.createDataFrame([(json.dumps({"row_id": row_id}),)], "value string").write.mode("overwrite").text(f"{path}/about")
        return DenseIndex(spark, path)

    def search(self, queries: DataFrame, k: int, *, metric: str = "ip", query_id: str = "query_id", query_vector: str = "query_vector") -> tuple[DataFrame, DataFrame]:
        """(hits, work): hits as ``dense_search`` gives them, and (query_id, rows, share) compared for each query.

        Query ids must be unique; null query vectors have no hits. Queries of a cell meet its blocks in one join, in which the
        blocks of a large cell are dealt to many tasks. ``share`` is of all rows of the index.
        """
        if k <= 0:
            raise ValueError("top_k must be a positive integer")
        if metric not in ("ip", "l2"):
            raise ValueError(f"unknown metric: {metric}")
        spark, cells = self.spark, self.cells
        own, row = queries.schema[query_id].dataType, self.blocks.schema["ids"].dataType.elementType
        result = T.StructType([T.StructField(query_id, own), T.StructField(self.row_id, row), T.StructField("score", T.DoubleType()), T.StructField("compared", T.LongType())])
        asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
        chosen = T.StructType([T.StructField("q", own), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cutoff", T.DoubleType()), T.StructField("seen", T.ArrayType(T.IntegerType())), T.StructField("cells", T.ArrayType(T.IntegerType()))])
        total = sum(cells.rows)

        def choose(batches: Iterator):
            """The cells of every query: at first those around it that have k rows, later all that may reach its cutoff."""
            import numpy as np
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            p, n, radius = np.array(cells.pivots, np.float64), np.array(cells.rows), np.array(cells.radius)
            for batch in batches:
                found = []
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256).to_pylist()
                    v = [np.array([np.nan if x is None else x for x in r["v"]], np.float64) for r in part]
                    if any(len(x) != p.shape[1] or not np.isfinite(x).all() for x in v):
                        raise ValueError("query vectors must be finite and of the index's dimension")
                    q = np.stack(v)
                    apart, product, length = cells.apart(q), q @ p.T, np.sqrt(np.square(q).sum(1))
                    best = bound(apart, length[:, None], product, np.zeros(len(p)), radius, metric)
                    order = np.argsort(-product if metric == "ip" else apart, axis=1, kind="stable")
                    for i, r in enumerate(part):
                        if r["seen"] is None:
                            enough = np.cumsum(n[order[i]])
                            wanted = order[i][: int(np.searchsorted(enough, min(k, total))) + 1]
                        else:
                            wanted = np.setdiff1d(np.nonzero(best[i] <= r["cutoff"])[0], r["seen"])
                        found.append(r | {"cells": [c for c in wanted.tolist() if n[c]]})
                yield pa.RecordBatch.from_pylist(found, schema=to_arrow_schema(chosen))

        def meet(batches: Iterator):
            import numpy as np
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow, p = to_arrow_schema(result), np.array(cells.pivots, np.float64)
            for batch in batches:
                for r in range(batch.num_rows):
                    cell, least, most = (batch.column(c)[r].as_py() for c in ("cell", "least", "most"))
                    ids = batch.column("ids")[r].as_py()
                    rows = batch.column("flat")[r].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                    held = batch.column("queries")[r].as_py()
                    q, cutoff = np.array([x["v"] for x in held], np.float64), np.array([np.inf if x["cutoff"] is None else x["cutoff"] for x in held])
                    apart = np.sqrt(np.square(q - p[cell]).sum(1))
                    reach = bound(apart, np.sqrt(np.square(q).sum(1)), q @ p[cell], least, most, metric) <= cutoff
                    if not reach.any():
                        continue
                    names = [x["q"] for x, ok in zip(held, reach, strict=True) if ok]
                    i, j, score = nearest(q[reach], rows, metric, cutoff[reach], k)
                    order = np.lexsort((j, score, i))
                    columns = [[names[x] for x in i[order]] + names, [ids[x] for x in j[order]] + [None] * len(names), score[order].tolist() + [None] * len(names), [None] * len(i) + [len(ids)] * len(names)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        # hot cells are known beforehand; there are no more of them than cells
        hot = spark.createDataFrame([(c, -(-b // BLOCKS_A_TASK)) for c, b in enumerate(cells.blocks) if b > BLOCKS_A_TASK], "cell int, __splits int")
        parts = max(1, -(-asked.count() // QUERIES))

        def compared(wanted: DataFrame) -> DataFrame:
            each = wanted.select(F.explode("cells").alias("cell"), F.pmod(F.xxhash64("q"), F.lit(parts)).alias("part"), F.struct("q", "v", "cutoff").alias("s"))
            packs = each.groupBy("cell", "part").agg(F.collect_list("s").alias("queries")).drop("part")
            used = [r["cell"] for r in each.select("cell").distinct().collect()]  # MOST_CELLS at most
            blocks = self.blocks.where(F.col("cell").isin(used))
            met = hot_join(blocks, packs, ["cell"], hot, F.col("block")).select("cell", "least", "most", "ids", "flat", "queries")
            return storage.written(spark, met.transform(in_arrow, meet, result), "index-hits")

        none = asked.select("q", "v", F.lit(None).cast("double").alias("cutoff"), F.lit(None).cast("array<int>").alias("seen"), F.lit(None).cast("array<int>").alias("cells"))
        if not cells.pivots:
            return spark.createDataFrame([], result).select(query_id, self.row_id, "score", F.lit(1).alias("rank")), asked.select(F.col("q").alias(query_id), F.lit(0).cast("long").alias("rows"), F.lit(0.0).alias("share"))
        first = storage.written(spark, none.transform(in_arrow, choose, chosen), "index-queries")
        one = compared(first)
        ranking = F.row_number().over(Window.partitionBy(query_id).orderBy("score", self.row_id))
        kth = one.where(F.col("score").isNotNull()).withColumn("rank", ranking).where(F.col("rank") <= k).groupBy(F.col(query_id).alias("q")).agg(F.when(F.count("*") == k, F.max("score")).alias("cutoff"))
        again = first.drop("cutoff", "seen").withColumnRenamed("cells", "seen").join(kth, "q", "left").select("q", "v", F.coalesce("cutoff", F.lit(float("inf"))).alias("cutoff"), "seen", F.lit(None).cast("array<int>").alias("cells"))
        second = storage.written(spark, again.transform(in_arrow, choose, chosen), "index-queries")
        both = one.unionByName(compared(second))
        hits = both.where(F.col("score").isNotNull()).withColumn("rank", ranking).where(F.col("rank") <= k).select(query_id, self.row_id, "score", "rank")
        work = both.where(F.col("compared").isNotNull()).groupBy(query_id).agg(F.sum("compared").alias("rows")).withColumn("share", F.col("rows") / F.lit(max(total, 1)))
        return (hits.withColumn("score", -F.col("score")) if metric == "ip" else hits), work
