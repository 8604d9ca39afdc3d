import hashlib

import numpy as np
import pytest

from foliospark.llm import balls


def expected(rows, clusters, rounds, dimension, salt="2:"):
    """{row number: (cluster, distance)} and the centroids, comparing every vector with every centroid."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in named[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        held = [near(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            own = [v for (_, v), h in zip(kept, held, strict=True) if h == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=str), centroids


def check(spark, rows, clusters=7, rounds=4, dimension=3, partitions=3):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(partitions)
    found, model = balls.cluster_vectors(frame, clusters=clusters, rounds=rounds, dimension=dimension)
    want, centroids = expected(rows, clusters, rounds, dimension)
    assert sorted(map(tuple, found.collect()), key=str) == want and model.centroids == centroids


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_comparing_with_all(spark, seed):
    rng = np.random.default_rng(seed)
    spots = rng.normal(0, 1, (9, 3))
    rows = [(i, [float(x) for x in spots[i % 9] + rng.normal(0, 0.3, 3)]) for i in range(400)]
    check(spark, rows)


def test_ties_and_repeats(spark):
    rows = [(i, [(i % 5) / 4, (i % 3) / 4, (i % 2) / 4]) for i in range(200)] + [(7, [0.5, 0.5, 0.25])] * 20
    check(spark, rows, clusters=12)


def test_rows_left_out(spark):
    rows = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0]), (6, [1.0, 2.0]), (None, [0.5, 0.25, -0.5]), (8, [-1.0, 0.1, 0.3]), (9, [0.2, 0.1, 0.3])]
    check(spark, rows)


def test_fewer_vectors_than_clusters_and_none(spark):
    check(spark, [(1, [0.1, 0.2, 0.3]), (2, [-5.0, 0.2, 0.3])], clusters=40)
    found, model = balls.cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert found.collect() == [] and model.centroids == []
    assert balls.with_figures(found, model).collect() == []


def test_empty_balls_stay(spark):
    rows = [(i, [1.0, 1.0, 1.0]) for i in range(30)] + [(99, [3.0, 1.0, 1.0])]
    check(spark, rows, clusters=5)


def test_annuli_spare_comparisons():
    """In well separated groups nearly all members are in stable cores; what is compared gives the same answer."""
    rng = np.random.default_rng(5)
    centroids = rng.integers(-4000, 4000, (30, 8))
    rows = np.concatenate([c + rng.integers(-50, 50, (40, 8)) for c in centroids])
    best, distance, every = balls.assign(rows, None, centroids, None)
    reach = [int(np.ceil(distance[best == k].max() ** 0.5)) for k in range(30)]
    again, same, compared = balls.assign(rows, best, centroids, balls.Model(centroids.tolist(), reach).neighbours())
    assert (again == best).all() and (same == distance).all() and compared < every / 50
    moved = centroids + rng.integers(-3000, 3000, centroids.shape)
    reach = [int(np.ceil(balls.squared(rows[best == k], moved[k : k + 1]).max() ** 0.5)) for k in range(30)]
    other, d, compared = balls.assign(rows, best, moved, balls.Model(moved.tolist(), reach).neighbours())
    want, least, every = balls.assign(rows, None, moved, None)
    assert (other == want).all() and (d == least).all() and compared < every


def test_large_components(spark):
    check(spark, [(i, [1e4 * (i % 7), -2e4 * (i % 3), 1e4]) for i in range(60)], clusters=5)
    frame = spark.createDataFrame([(1, [5e6, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        balls.cluster_vectors(frame, dimension=3)


def test_extra_columns(spark):
    frame = spark.createDataFrame([(1, [0.1, 0.2], 5, 6)], "vec_id long, embedding array<float>, cluster int, v int")
    assert [tuple(r) for r in balls.cluster_vectors(frame, dimension=2)[0].collect()] == [(1, 0, 0)]
