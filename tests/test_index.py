"""The stored index against the search that reads every row."""

import numpy as np
import pytest

from foliospark.operators import index, retrieval


def frame(spark, rows, name="chunk_id", vector="vector", kind="float"):
    return spark.createDataFrame([(f"r{i:05}", [float(x) for x in v]) for i, v in rows], f"{name} string, {vector} array<{kind}>").repartition(3)


def same(spark, store, queries, built, k, metric):
    hits, work = built.search(queries, k, metric=metric)
    want = sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in retrieval.dense_search(queries, store, k, metric=metric).collect())
    got = sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in hits.collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) <= 1e-9 * (1 + abs(w[3])) for g, w in zip(got, want, strict=True))
    return {r.query_id: r.share for r in work.collect()}


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_clustered_rows_are_read_in_part(spark, tmp_path, metric):
    rng = np.random.default_rng(1)
    spots = rng.normal(0, 1, (20, 8))
    spots /= np.linalg.norm(spots, axis=1, keepdims=True)
    v = spots[np.arange(1200) % 20] + rng.normal(0, 0.02, (1200, 8))
    store = frame(spark, enumerate(v))
    queries = frame(spark, ((i, v[i]) for i in range(0, 1200, 100)), "query_id", "query_vector")
    built = index.DenseIndex.build(store, str(tmp_path / "index"), block=50, cells=20)
    share = same(spark, store, queries, built, 5, metric)
    assert len(share) == 12 and sum(share.values()) / 12 < (0.2 if metric == "l2" else 0.5)
    again = index.DenseIndex(spark, str(tmp_path / "index"))
    assert again.cells == built.cells and sum(built.cells.rows) == 1200 and sum(built.cells.blocks) >= 24


def test_sample_is_bounded_before_it_is_sorted(spark, monkeypatch):
    """Each task gives the driver rows near the sample's share alone; the sample is still that of the least hashes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(index, "SAMPLE", 400)
    rows = spark.range(0, 20_000, numPartitions=20).select(F.col("id").cast("string").alias("id"), F.array(F.col("id").cast("double")).alias("v"))
    sampled = index._sampled(rows, 20_000)
    assert [r.v[0] for r in sampled.collect()] == [float(r.id) for r in rows.orderBy(F.xxhash64("id"), "id").limit(400).collect()]
    kept = rows.withColumn("h", F.xxhash64("id")).where(F.col("h") < int(-(2**63) + 2**64 * 1.25 * 400 / 20_000)).count()
    assert 400 <= kept <= 600 and "Filter" in sampled._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_scattered_rows_copies_and_ties(spark, tmp_path, monkeypatch, metric):
    monkeypatch.setattr(index, "BLOCKS_A_TASK", 2)
    monkeypatch.setattr(index, "QUERIES", 4)
    rng = np.random.default_rng(2)
    v = [*rng.normal(0, 1, (150, 4)), *([[0.5, 0.5, 0.5, 0.5]] * 200), *([[0.0] * 4] * 3)]  # a third and more are one vector
    store = frame(spark, enumerate(v), kind="double")
    queries = frame(spark, [*((i, v[i]) for i in range(0, 350, 25)), (999, [0.0] * 4)], "query_id", "query_vector", "double")
    built = index.DenseIndex.build(store, str(tmp_path / "index"), block=16)
    assert max(built.cells.blocks) > 2
    same(spark, store, queries, built, 7, metric)


def test_more_hits_than_rows_and_empty(spark, tmp_path):
    store = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    queries = frame(spark, [(5, [1.0, 0.5])], "query_id", "query_vector")
    same(spark, store, queries, index.DenseIndex.build(store, str(tmp_path / "a")), 10, "ip")
    none = index.DenseIndex.build(store.limit(0), str(tmp_path / "b"))
    hits, work = none.search(queries, 3)
    assert hits.collect() == [] and [r.rows for r in work.collect()] == [0]


def test_wrong_vectors_and_arguments(spark, tmp_path):
    store = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    built = index.DenseIndex.build(store, str(tmp_path / "a"))
    for bad in ([1.0], [float("nan"), 1.0]):
        with pytest.raises(Exception, match="finite and of the index's dimension"):
            built.search(frame(spark, [(5, bad)], "query_id", "query_vector"), 3)[0].collect()
    with pytest.raises(ValueError, match="top_k"):
        built.search(store, 0)
    with pytest.raises(ValueError, match="metric"):
        built.search(store, 1, metric="cosine")
    with pytest.raises(Exception, match="of one dimension"):
        index.DenseIndex.build(frame(spark, [(0, [1.0, float("inf")]), (1, [1.0, 2.0])]), str(tmp_path / "c"))
    only_null = spark.createDataFrame([("q", None)], "query_id string, query_vector array<float>")
    assert built.search(only_null, 2)[0].collect() == []
