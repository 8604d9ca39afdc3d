"""Centroid clustering by ball k-means.

A cluster is a ball: its centroid and a radius that encloses its vectors. Two balls are neighbours if half the distance of
their centroids is not above the first one's radius; only centroids of neighbours can be as near to a member as its own. A
member nearer to its centroid than half the way to the nearest neighbour is in the stable core and keeps its cluster
unseen; the others lie in annuli by how many neighbours half their distances reach, and are compared with these alone.

Vectors are whole numbers and all arithmetic is exact, so every assignment is the one that comparing with all centroids
would give. Each round is one pass of tasks over the vectors, which are never shuffled: a task adds up what its vectors
give to each ball, and the sums (one row for each task and ball) are combined by Spark. The driver sees the model alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import in_arrow, remove, scratch, write

CLUSTERS, ROUNDS, DIMENSION = 40, 5, 64
#: Clusters at most: the driver and every task hold the centroids and the distances between them.
MOST_CLUSTERS = 1024
SCALE = 256

STATE = "vec_id long, v array<int>, cluster int, distance long, sums array<long>, n long, reach long"


def quantized(vectors: DataFrame, *, dimension: int | None = None, id_column: str = "vec_id", vector_column: str = "embedding", keep: tuple[Column, ...] = ()) -> DataFrame:
    """(vec_id, v array<int>, columns of ``keep``): whole components, each floor(256 * x); rows without a vector of finite components are left out.

    ``dimension``: only vectors of so many components. A component beyond the range of an int is an error.
    """
    v = F.col(vector_column)
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if dimension is not None:
        whole = whole & (F.size(v) == dimension)
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("v"), *keep)


@dataclass
class Model:
    """Centroids with the balls around them; ``reach`` bounds the distance of every member from its centroid, rounded up."""

    centroids: list[list[int]]
    reach: list[int] = field(default_factory=list)

    def neighbours(self):
        """For each ball its neighbours, nearest first, with four times the squared half distances (the squared distances)."""
        import numpy as np

        c = np.array(self.centroids, np.int64)
        out = []
        for i in range(len(c)):
            apart = np.square(c - c[i]).sum(1)
            order = np.lexsort((np.arange(len(c)), apart))
            # python's integers: four times a squared reach may exceed 64 bits
            near = [j for j in order.tolist() if j != i and (not self.reach or int(apart[j]) <= 4 * self.reach[i] ** 2)]
            out.append((np.array(near, np.int64), apart[near] if near else np.zeros(0, np.int64)))
        return out


def squared(rows, centroids):
    """Exact squared distances of all rows from all centroids, as 64-bit integers."""
    import numpy as np

    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    width = rows.shape[1]
    if width * (2 * most) ** 2 >= 1 << 60:
        raise ValueError("components are too large for distances of 64 bits")
    kind = np.float64 if width * (2 * most) ** 2 < 1 << 52 else np.int64  # whole numbers below 2**53 are exact in doubles
    a, b = rows.astype(kind), centroids.astype(kind)
    return (np.square(a).sum(1)[:, None] - 2 * (a @ b.T) + np.square(b).sum(1)[None, :]).astype(np.int64)


def assign(rows, cluster, centroids, neighbours):
    """(cluster, distance, compared): the nearest centroid of each row, the smaller number of equals.

    ``cluster``: the ball that each row was in, or None for rows that meet all centroids. compared: distances computed beside
    those from the own centroid.
    """
    import numpy as np

    if cluster is None:
        apart = squared(rows, centroids)
        best = apart.argmin(1)  # the first of equals
        return best, apart[np.arange(len(rows)), best], apart.size
    best, compared = cluster.copy(), 0
    distance = np.empty(len(rows), np.int64)
    for i in np.unique(cluster).tolist():
        members = np.nonzero(cluster == i)[0]
        own = squared(rows[members], centroids[i : i + 1])[:, 0]
        distance[members] = own
        near, apart = neighbours[i]
        annulus = np.searchsorted(apart, 4 * own, side="right")
        for level in np.unique(annulus[annulus > 0]).tolist():
            ring = members[annulus == level]
            others = np.sort(near[:level])
            d = squared(rows[ring], centroids[others])
            compared += d.size
            at = d.argmin(1)
            nearest, found = d[np.arange(len(ring)), at], others[at]
            closer = (nearest < distance[ring]) | ((nearest == distance[ring]) & (found < i))
            best[ring[closer]], distance[ring[closer]] = found[closer], nearest[closer]
    return best, distance, compared


def _pass(state: DataFrame, model: Model, *, first: bool) -> DataFrame:
    """STATE rows: every vector with its cluster, and for each task and cluster the sums of its members (``n`` not null)."""
    dimension = len(model.centroids[0])

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        centroids, neighbours = np.array(model.centroids, np.int64), None if first else model.neighbours()
        k = len(centroids)
        sums, counts, reach = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        names = ["vec_id", "v", "cluster", "distance", "sums", "n", "reach"]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, dimension)
            known = None if first else batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            cluster, distance, _ = assign(rows, known, centroids, neighbours)
            order = np.argsort(cluster, kind="stable")
            there, starts = np.unique(cluster[order], return_index=True)
            sums[there] += np.add.reduceat(rows[order], starts, axis=0)
            counts[there] += np.diff([*starts, len(order)])
            np.maximum.at(reach, cluster, distance)
            none = [pa.nulls(batch.num_rows, t) for t in kinds[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(kinds[1]), pa.array(cluster, pa.int32()), pa.array(distance), *none], names=names)
        own = np.nonzero(counts)[0]
        if len(own):
            columns = [pa.nulls(len(own), pa.int64()), pa.nulls(len(own), kinds[1]), pa.array(own, pa.int32()), pa.nulls(len(own), pa.int64()), pa.array(sums[own].tolist(), kinds[4]), pa.array(counts[own]), pa.array(reach[own])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return state.transform(in_arrow, run, STATE)


def _moved(state: DataFrame, model: Model) -> Model:
    """The balls after their vectors were assigned: at most clusters x dimension sums reach the driver."""
    parts = state.where("n is not null").select("cluster", "sums", "n", "reach")
    sizes = {r["cluster"]: r for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("reach").alias("reach")).collect()}
    sums: dict[int, dict[int, int]] = {}
    for r in parts.select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x")).collect():
        sums.setdefault(r["cluster"], {})[r["i"]] = r["x"]
    centroids, reach = [], []
    for k, old in enumerate(model.centroids):
        if k not in sizes:
            centroids.append(old)
            reach.append(0)
            continue
        new = [sums[k][i] // sizes[k]["n"] for i in range(len(old))]
        drift = sum((a - b) ** 2 for a, b in zip(new, old, strict=True))
        centroids.append(new)
        reach.append(isqrt(sizes[k]["reach"]) + 1 + (isqrt(drift) + 1 if drift else 0))  # both rounded up: the ball still encloses all
    return Model(centroids, reach)


def first_centroids(kept: DataFrame, clusters: int, order: Column) -> list[list[int]]:
    """The vectors of the least ``order``, ties by id and components."""
    return [list(r["v"]) for r in kept.orderBy(order, "vec_id", "v").limit(clusters).select("v").collect()]


def cluster_vectors(
    vectors: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, salt: str = "2:", id_column: str = "vec_id", vector_column: str = "embedding"
) -> tuple[DataFrame, Model]:
    """((vec_id, cluster, distance), model): every vector's cluster and squared distance after ``rounds`` of moving centroids.

    The first centroids are the vectors with the least SHA-256 of ``salt`` and the id. Ties of distance go to the smaller
    number; a ball without vectors stays where it is; a new centroid is the floor of the mean. Rows with a null vector, another
    dimension, or a null or non-finite component are left out. Repeated rows are vectors of their own; a null id hashes as an empty
    one and comes out null. Fewer vectors than clusters: as many clusters as vectors. An empty table gives an empty result and a
    model without centroids. Extra columns are not read.
    """
    if not 0 < clusters <= MOST_CLUSTERS:
        raise ValueError(f"clusters must be between 1 and {MOST_CLUSTERS}")
    spark: SparkSession = vectors.sparkSession
    kept = quantized(vectors, dimension=dimension, id_column=id_column, vector_column=vector_column)
    named = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    model = Model(first_centroids(kept, clusters, named))
    if not model.centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), model
    rows, before = kept, None
    for n in range(rounds + 1):
        path = scratch(spark, "balls")
        write(spark, _pass(rows, model, first=before is None), path)
        if before:
            remove(spark, before)
        before, state = path, spark.read.schema(STATE).parquet(path)
        rows = state.where("n is null").select("vec_id", "v", "cluster")
        if n < rounds:
            model = _moved(state, model)
    return state.where("n is null").select("vec_id", "cluster", "distance"), model


def with_figures(assigned: DataFrame, model: Model) -> DataFrame:
    """``assigned`` with its cluster's and the whole inertia and its centroid's SHA-256 (components joined by commas)."""
    import hashlib

    spark = assigned.sparkSession
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    told = [(k, sums[k], sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(model.centroids) if k in sums]
    figures = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
