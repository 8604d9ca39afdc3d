import collections
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from foliospark.llm import mixing


def expected(rows, seed=17, exponent=0.5, budget=1.0, weights=None):
    """{row: count} by the definition of the inverse distribution."""
    size = collections.Counter()
    for _, source, text in rows:
        size[source or ""] += len((text or "").encode())
    weigh = {s: (b**exponent if weights is None else weights.get(s, 0.0)) for s, b in size.items() if b}
    out = []
    for d, source, _ in rows:
        s = source or ""
        rate = budget * sum(size.values()) * weigh[s] / sum(weigh.values()) / size[s] if size[s] and sum(weigh.values()) else 0.0
        u = (int(hashlib.md5(f"{seed}:count:{'' if d is None else d}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
        n, total = 0, math.exp(-rate)
        term = total
        while total < u and rate > 0:
            n += 1
            term *= rate / n
            total += term
        out.append((d, source, n))
    return out


def corpus(n=400):
    rng = random.Random(3)
    return [(i, rng.choice("aaaabbc"), "x" * rng.randrange(1, 60)) for i in range(n)]


def counted(frame):
    return collections.Counter((r.doc_id, r.source) for r in frame.collect())


@pytest.mark.parametrize("options", [{}, {"exponent": 0.0, "budget": 3.0, "seed": 5}, {"weights": {"a": 1.0, "c": 5.0}}])
def test_counts_equal_the_definition(spark, options):
    rows = corpus()
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5), **options)
    assert counted(found) == +collections.Counter({(d, s): n for d, s, n in expected(rows, **options)})


def test_shares_reach_the_target(spark):
    rows = [(i, "a" if i % 10 else "b", "x" * 10) for i in range(20_000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), {"a": 0.5, "b": 0.5})
    share = {r.source: r["count"] for r in found.groupBy("source").count().collect()}
    assert abs(share["a"] / 10_000 - 1) < 0.03 and abs(share["b"] / 10_000 - 1) < 0.03


def test_replicas_and_order(spark):
    found = mixing.mix(spark.createDataFrame(corpus(), "doc_id long, source string, text string").withColumn("rate", F.lit("own")), budget=4.0, partitions=7)
    rows = found.collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert all(sorted(r.replica for r in g) == list(range(g[0].n_copies)) and len({r.shuffle_key for r in g}) == len(g) for g in by.values())
    parts = found.select(F.spark_partition_id().alias("p"), "shuffle_key").collect()
    assert all(a.shuffle_key <= b.shuffle_key for a, b in zip(parts, parts[1:]) if a.p == b.p) and len({r.p for r in parts}) > 1


def test_large_rates_do_not_underflow(spark):
    """Counts at given uniform numbers, against sums of log-gamma terms; a rate of a million takes no square of time."""
    import time

    marks = [1e-9, 0.001, 0.25, 0.5, 0.75, 0.999, 1 - 1e-9]
    rows = [(rate, u) for rate in (0.0, 1e-9, 0.3, 1.0, 7.5, 260.0, 5000.0, 1e6) for u in marks]
    frame = spark.createDataFrame(rows, "rate double, u double").withColumn("start", mixing.poisson_start(F.col("rate")))
    began = time.time()
    found = [r.n for r in frame.select(mixing.poisson_count(F.col("start"), F.col("rate"), F.col("u")).alias("n")).collect()]
    assert time.time() - began < 20
    for (rate, u), n in zip(rows, found, strict=True):
        if rate == 0:
            assert n == 0
            continue
        low = max(0, int(rate - 12 * math.sqrt(rate) - 40))
        cdf = lambda k: math.fsum(math.exp(-rate + j * math.log(rate) - math.lgamma(j + 1)) for j in range(low, k + 1))
        assert cdf(n) >= u - 1e-8 and (n == 0 or cdf(n - 1) < u + 1e-8)


def test_clashing_names_pass_through(spark):
    frame = spark.createDataFrame([(i, "a", "xyz", 1, 2, 3, "own") for i in range(50)], "doc_id long, source string, text string, __source int, __u int, __start int, `a.b` string")
    found = mixing.mix(frame, budget=2.0)
    assert found.columns == [*frame.columns, "replica", "n_copies", "rate", "shuffle_key"] and {(r["__source"], r["__u"], r["__start"], r["a.b"]) for r in found.collect()} == {(1, 2, 3, "own")}


def test_partitions_grow_with_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_BYTES", 100)
    found = mixing.mix(spark.createDataFrame(corpus(), "doc_id long, source string, text string"))
    assert found.rdd.getNumPartitions() > 50


def test_nulls_repeats_and_many_sources(spark, monkeypatch):
    rows = [(None, None, "abc"), (None, None, None), (1, "s", None), (1, "s", ""), (2, "t", "xx"), (2, "t", "xx"), (3, None, "yy")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = +sum((collections.Counter({(d, s): n}) for d, s, n in expected(rows, budget=2.0)), collections.Counter())
    assert counted(mixing.mix(frame, budget=2.0)) == want
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)  # rates joined by a shuffle
    assert counted(mixing.mix(frame, budget=2.0)) == want


def test_empty_tables_and_wrong_weights(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(empty).collect() == []
    assert mixing.mix(spark.createDataFrame([(1, "a", "")], "doc_id long, source string, text string")).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(empty, {"a": -1.0})


def test_plan_is_native(spark):
    plan = mixing.mix(spark.createDataFrame(spark.range(9).rdd.map(lambda r: (r.id, "a", "x")), "doc_id long, source string, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and "MapIn" not in plan


def test_many_sources_with_a_hot_one(spark, monkeypatch):
    """Beyond the broadcast a hot source is dealt to many tasks, with the same counts."""
    from foliospark.functions import joins

    monkeypatch.setattr(mixing, "FEW_SOURCES", 2)
    monkeypatch.setattr(joins, "LEAST_HOT", 10)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 90}" if i % 7 else None, "x" * (i % 50)) for i in range(600)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert counted(found) == +collections.Counter({(d, s): n for d, s, n in expected(rows)})


def test_very_long_texts_are_carried_whole(spark):
    rows = [(1, "a", "x" * 3_000_000), (2, "a", "y"), (3, "b", None), (4, "b", "")]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), budget=2.0).collect()
    assert collections.Counter((r.doc_id, r.source) for r in found) == +collections.Counter({(d, s): n for d, s, n in expected(rows, budget=2.0)})
    assert all(len(r.text) == 3_000_000 for r in found if r.doc_id == 1)
