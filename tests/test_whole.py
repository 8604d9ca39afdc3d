"""Queries over whole tables against brute force on a small one."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from foliospark.operators import evaluation
from foliospark.plans import catalog

N = 301
ASKED = [0, 100, 200, 300]


@pytest.fixture(scope="module")
def vectors():
    return np.random.default_rng(5).normal(size=(N, 8)).astype(np.float32)


@pytest.fixture(scope="module")
def texts():
    """What tells them apart comes after character 400."""
    rng = np.random.default_rng(6)
    return ["pad " * (120 + i % 7) + " ".join(f"word{w}" for w in rng.integers(0, 200, 12)) for i in range(N)]


@pytest.fixture(scope="module")
def labels():
    return [i % 3 for i in range(N)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory, vectors, texts, labels):
    path = str(tmp_path_factory.mktemp("small"))
    rows = [(i, [float(x) for x in vectors[i]], labels[i]) for i in range(N)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def lists(frame):
    found = {}
    for r in frame.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(int(r.chunk_id))
    return found


def nearest(vectors, q, metric):
    v = vectors.astype(float)
    score = -(v @ v[q]) if metric == "ip" else np.square(v - v[q]).sum(1)
    return sorted(range(N), key=lambda i: (score[i], str(i)))


def bm25(texts, q):
    docs = [Counter(re.findall("[a-z0-9]+", t.lower())) for t in texts]
    sizes = [sum(d.values()) for d in docs]
    mean, score = sum(sizes) / N, [0.0] * N
    for term in docs[q]:
        df = sum(term in d for d in docs)
        for i, d in enumerate(docs):
            if tf := d[term]:
                score[i] += math.log(1 + (N - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[i] / mean))
    return [i for _, _, i in sorted((-round(s, 9), str(i), i) for i, s in enumerate(score) if s)]


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_dense_asks_every_hundredth(spark, small, vectors, metric):
    assert lists(catalog.QUERIES[f"dense_topk_{metric}"](spark, small)) == {q: nearest(vectors, q, metric)[:10] for q in ASKED}


def test_bm25_asks_with_whole_texts(spark, small, texts):
    assert lists(catalog.QUERIES["bm25_search"](spark, small)) == {q: bm25(texts, q)[:10] for q in ASKED}


def test_retrieval_reranks_with_whole_texts(spark, small, vectors, texts):
    words, want = [set(re.findall("[a-z0-9]+", t)) for t in texts], {}
    for q in ASKED:
        rank = {i: n for n, i in enumerate(nearest(vectors, q, "ip")[:50])}
        want[q] = sorted(rank, key=lambda i: (-len(words[q] & words[i]) / len(words[q] | words[i]), rank[i]))[:10]
    assert lists(catalog.QUERIES["retrieve_batch"](spark, small)) == want


def test_evaluation_asks_every_hundredth_with_its_whole_text(spark, small, texts):
    found = {r.query_id: r.question_md5 for r in catalog.QUERIES["evaluation_run"](spark, small).collect()}
    assert found == {q: hashlib.md5(texts[q].encode()).hexdigest() for q in ASKED}


def test_fusion_ranks_the_whole_store_twice(spark, small, vectors, texts):
    want = {}
    for q in ASKED:
        ranks = [{i: n + 1 for n, i in enumerate(one[:20])} for one in (nearest(vectors, q, "ip"), bm25(texts, q))]
        score = {i: sum(1 / (60 + r[i]) for r in ranks if i in r) for i in set().union(*ranks)}
        want[q] = sorted(score, key=lambda i: (-score[i], min((n, r[i]) for n, r in enumerate(ranks) if i in r)))[:15]
    assert lists(catalog.QUERIES["rrf_fusion"](spark, small)) == want


def test_every_row_is_fetched(spark, small, labels):
    chain = lambda i, step: i + step if 0 <= i + step < N else i
    want = [(i, p, str(c), labels[c], f"label {labels[c]}") for i in range(N) for p, c in enumerate((i, chain(i, 3), i, chain(i, -3)))]
    assert sorted(map(tuple, catalog.QUERIES["fetch_ordered"](spark, small).collect())) == want
    want = [(i, p, c, labels[int(c)] if known else None, known) for i in range(N) for p, (c, known) in enumerate([(str(i), True), (f"x{i}", False), (str(i * 50), i * 50 < N)])]
    assert sorted(map(tuple, catalog.QUERIES["fetch_partial"](spark, small).collect()), key=lambda r: r[:2]) == want


def test_every_link_is_checked(spark, small):
    want = [(str(i), side, f"lost {i + step}") for i in range(3, N, 7) for side, step in (("next", 3), ("prev", -3)) if 0 <= i + step < N]
    assert sorted(map(tuple, catalog.QUERIES["dangling_refs"](spark, small).select("chunk_id", "side", "reference").collect())) == sorted(want)


def test_whole_texts_are_compared_and_prefixed(spark, small, texts):
    words, want = [set(re.findall("[a-z0-9]+", t)) for t in texts] + [set()], {}
    for i in range(N):
        a, b, both = words[i], words[i + 1], len(words[i] & words[i + 1])
        recall, precision = both / len(a), both / len(b) if b else 1.0
        want[i] = (both / len(a | b), recall, precision, 2 * recall * precision / (recall + precision) if both else 0.0)
    found = {r.doc_id: (r.jaccard, r.recall, r.precision, r.f1) for r in catalog.QUERIES["text_prf"](spark, small).collect()}
    assert found == {i: pytest.approx(w, abs=1e-8) for i, w in want.items()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    found = {r.doc_id: (r.passage_md5, r.query_md5) for r in catalog.QUERIES["prefixes"](spark, small).collect()}
    assert found == {i: (md5(f"passage: {t}"), md5(f"query: {t}")) for i, t in enumerate(texts)}


def test_metrics_judge_by_all_rows_of_the_label(spark, small, vectors, labels):
    gain, want = lambda places: sum(1 / math.log2(p + 1) for p in places), {}
    for q in ASKED:
        shown = [i for i in nearest(vectors, q, "ip") if i != q][:10]
        right = [p + 1 for p, i in enumerate(shown) if labels[i] == labels[q]]
        want[q] = (bool(right), round(1 / right[0], 9) if right else 0.0, round(gain(right) / gain(range(1, 1 + min(10, labels.count(labels[q]) - 1))), 9))
    found = {r.query_id: (r.hit_rate, r.mrr, r.ndcg) for r in catalog.QUERIES["retrieval_metrics"](spark, small).collect()}
    assert found == {q: pytest.approx(w) for q, w in want.items()}
    means = catalog.QUERIES["retrieval_metrics_agg"](spark, small).first()
    assert (means.hit_rate, means.mean_mrr, means.mean_ndcg) == pytest.approx(tuple(np.mean(list(want.values()), 0)), abs=1e-8) and means.total_questions == len(ASKED)


def test_judged_scores_are_those_of_lists(spark):
    rows = [(0, ["a", "b", "c"], ["b", "x", "y"]), (1, ["a", "b"], []), (2, ["a"], ["a"]), (3, ["a", "b", "c"], ["c", "a"]), (4, ["a", "b"], ["z"])]
    listed = evaluation.score(spark.createDataFrame(rows, "query_id long, retrieved_ids array<string>, ground_truth_ids array<string>"), k=2)
    hits = spark.createDataFrame([(q, n + 1, c in t) for q, r, t in rows for n, c in enumerate(r)], "query_id long, rank int, relevant boolean")
    judged = evaluation.score_judged(hits, spark.createDataFrame([(q, len(t)) for q, _, t in rows], "query_id long, n_truth long"), k=2)
    key = lambda f: {r.query_id: (r.hit_rate, r.mrr, round(r.ndcg, 9)) for r in f.collect()}
    assert key(judged) == key(listed)
