"""Chains of chunks, digests of runs, vocabularies of corpora, evaluations that fail."""

import random
import time

import pytest
from pyspark.sql import functions as F

from foliospark.operators import curation, evaluation, retrieval


def store(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, chunk_id string, prev_id string, next_id string").repartition(3)


def expected(rows):
    """Faulty links by walking every one of them."""
    out, nodes = set(), {(d, c): (p, n) for d, c, p, n in rows if c is not None}
    for (d, c), links in nodes.items():
        for side, link in zip(("prev", "next"), links, strict=True):
            if link is None:
                continue
            if link == c:
                out.add((d, c, side, "self", link))
            elif (d, link) not in nodes:
                out.add((d, c, side, "dangling", link))
            else:
                k = 1 if side == "next" else 0
                if nodes[d, link][1 - k] != c:
                    out.add((d, c, side, "one_sided", link))
                at, seen = link, set()
                while at is not None and at not in seen and at != c and (d, at) in nodes:
                    seen.add(at)
                    onward = nodes[d, at][k]
                    at = None if onward == at else onward
                if at == c:
                    out.add((d, c, side, "cycle", link))
    return sorted(out)


def found(spark, rows):
    return sorted(map(tuple, retrieval.chain_violations(store(spark, rows), scope=("doc_id",)).collect()))


def chain(doc, n):
    return [(doc, f"c{i}", f"c{i - 1}" if i else None, f"c{i + 1}" if i + 1 < n else None) for i in range(n)]


def test_sound_chains(spark):
    rows = chain("a", 130) + chain("b", 1) + chain("c", 2)
    assert found(spark, rows) == expected(rows) == []
    retrieval.check_chain(store(spark, rows), scope=("doc_id",))


CASES = {
    "self": [("a", "x", "x", None), ("a", "y", None, "y")],
    "dangling": [("a", "x", "gone", "y"), ("a", "y", "x", "gone"), ("b", "gone", None, None)],
    "two that link to one": [("a", "x", None, "z"), ("a", "y", None, "z"), ("a", "z", "x", None)],
    "ring": [("a", f"c{i}", f"c{(i - 1) % 7}", f"c{(i + 1) % 7}") for i in range(7)],
    "long tail into a ring of two": [("a", f"c{i}", None, f"c{i + 1}" if i < 40 else "c39") for i in range(41)],
    "chain into a self-link": [("a", f"c{i}", None, f"c{min(i + 1, 20)}") for i in range(21)],
    "nothing": [],
    "null ids": [("a", None, "x", "x"), ("a", "x", None, None)],
    "a long chain ends and a ring does not": chain("a", 100) + [("b", f"c{i}", None, f"c{(i + 1) % 3}") for i in range(3)],
}


@pytest.mark.parametrize("case", CASES)
def test_faults(spark, case):
    assert found(spark, CASES[case]) == expected(CASES[case])


@pytest.mark.parametrize("seed", range(2))
def test_random_links(spark, seed):
    rng = random.Random(seed)
    rows = [(d, f"c{i}", *(rng.choice([None, f"c{rng.randrange(25)}"]) for _ in range(2))) for d in "ab" for i in range(22)]
    assert found(spark, rows) == expected(rows)


def test_check_names_faults(spark):
    with pytest.raises(ValueError, match="self"):
        retrieval.check_chain(store(spark, CASES["self"]), scope=("doc_id",))


def test_fetch_names_ten_unknown_ids(spark):
    s = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, n int")
    asked = spark.createDataFrame([(1, ["a", *[f"x{i:02}" for i in range(30)]])], "request_id int, chunk_ids array<string>")
    with pytest.raises(ValueError, match=r"x00.*x09'\] and more"):
        retrieval.fetch(asked, s)


# ---- digests ----------------------------------------------------------------------------------------------------------


def runs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, chunk_id string, text string").repartition(4)


def test_digests_add_up_and_forget_the_order(spark):
    rows = [(f"d{i % 5}", f"c{i}", f"text {i % 7}") for i in range(60)] + [("d1", "c1", "text 1")] * 3
    one, two = runs(spark, rows), runs(spark, rows[::-1]).orderBy("text")
    assert curation.changed(one, two).collect() == []
    whole = curation.digests(one, ()).first()
    assert curation.merged(curation.digests(two)).first() == whole and whole.n == 63


def test_changes_by_kind(spark):
    before = [("a", "1", "x"), ("a", "2", "y"), ("b", "1", "x"), ("c", "1", "x"), (None, "1", "n"), ("e", "1", None)]
    after = [("a", "1", "x"), ("a", "2", "z"), ("b", "1", "x"), ("b", "1", "x"), ("d", "1", "x"), (None, "1", "m"), ("e", "1", "")]
    found = sorted(map(tuple, curation.changed(runs(spark, before), runs(spark, after)).collect()), key=str)
    assert found == sorted([("a", 2, 2, "content"), ("b", 1, 2, "rows"), ("c", 1, 0, "removed"), ("d", 0, 1, "added"), (None, 1, 1, "content"), ("e", 1, 1, "content")], key=str)
    empty = runs(spark, before).limit(0)
    assert curation.changed(empty, empty).collect() == [] and curation.digests(empty, ()).first().n == 0


def test_swapped_values_are_seen(spark):
    assert curation.changed(runs(spark, [("a", "1", "x"), ("a", "2", "y")]), runs(spark, [("a", "1", "y"), ("a", "2", "x")])).count() == 1


# ---- vocabularies -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("a", "b"), [(["x y z", "X q"], ["y", "z w w"]), ([], []), (["a"], []), ([None, ""], ["a"]), (["a b"], ["a b"]), (["a"], ["b"])])
def test_vocabularies(spark, a, b):
    left, right = (spark.createDataFrame([(t,) for t in side], "text string") for side in (a, b))
    r = curation.vocabulary_overlap(left, right).first()
    p, q = ({w for t in side for w in (t or "").lower().split()} for side in (a, b))
    both = len(p & q)
    recall = 1.0 if not p else both / len(p)
    precision = (1.0 if not q else 0.0) if not p else (1.0 if not q else both / len(q))
    f1 = 1.0 if not p and not q else (2 * recall * precision / (recall + precision) if recall + precision and p else 0.0)
    assert (r.source_terms, r.parsed_terms, r.common_terms) == (len(p), len(q), both)
    assert (r.recall, r.precision) == (recall, precision) and abs(r.f1 - f1) < 1e-12


# ---- evaluation -------------------------------------------------------------------------------------------------------


def questions(spark, n):
    return spark.range(n).select(F.col("id").alias("query_id"), F.lit("q").alias("question"), F.array(F.lit("a")).alias("ground_truth_context"))


def answers(q):
    return q.select("query_id", F.lit(1).alias("rank"), F.lit("a").alias("chunk_id"))


def test_an_engine_that_is_down_is_told_from_bad_questions(spark):
    calls = []

    def down(q):
        calls.append(1)
        raise ConnectionError("x" * 2000)

    began = time.time()
    rows = evaluation.run_evaluation(questions(spark, 1000), down).collect()
    assert len(rows) == 1000 and all(r.error == "x" * 2000 and r.mrr == 0 for r in rows)
    assert len(calls) <= 7 + evaluation.PROBES and time.time() - began < 60


def test_many_bad_questions_fail_alone(spark):
    bad = {3, 4, 17, 40, 63}

    def engine(q):
        if q.where(F.col("query_id").isin(*bad)).count():
            raise ValueError("bad question")
        return answers(q)

    rows = evaluation.run_evaluation(questions(spark, 64), engine, probes=4).collect()
    assert {r.query_id for r in rows if r.error} == bad and all(r.mrr == 1 for r in rows if not r.error) and len(rows) == 64


def test_tries_are_bounded(spark):
    calls = []

    def engine(q):
        calls.append(1)
        if q.where("query_id % 2 = 0").count():
            raise ValueError("even")
        return answers(q)

    rows = evaluation.run_evaluation(questions(spark, 64), engine, most_tries=20).collect()
    assert len(calls) <= 20 and len(rows) == 64 and all((r.error is None) == (r.mrr == 1) for r in rows)
    assert any("not parted further" in (r.error or "") for r in rows) and all(r.error for r in rows if r.query_id % 2 == 0)
