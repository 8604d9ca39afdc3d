"""The inverted index against the search that scores every row."""

import random

import pytest

from foliospark.operators import keywords, retrieval


def corpus(spark, n, seed, words=300):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    rows = [(f"r{i:04}", " ".join(f"w{x}" for x in rng.choices(range(words), weights, k=rng.randrange(0, 60)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)


def both(spark, store, queries, built, k):
    asked = spark.createDataFrame(queries, "query_id int, query string")
    hits, work = built.search(asked, k)
    key = lambda f: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 7)) for r in f.collect())
    assert key(hits) == key(retrieval.bm25_search(asked, store, k))
    return work.first()


@pytest.mark.parametrize("block", [8])
def test_equal_to_scoring_all(spark, tmp_path, block):
    rows, store = corpus(spark, 400, 1)
    built = keywords.KeywordIndex.build(store, str(tmp_path / "i"), block=block)
    queries = [(i, t) for i, (_, t) in enumerate(rows[::50])] + [(100, "w0"), (101, "w250 w1"), (102, "unknown"), (103, ""), (104, None), (105, "W1 w1, w2!")]
    work = both(spark, store, queries, built, 5)
    assert work.rows == 400 and work.read <= work.postings == sum(len(set(t.split())) for _, t in rows)
    assert keywords.KeywordIndex(spark, str(tmp_path / "i")).mean == built.mean


def test_rare_words_read_few_postings(spark, tmp_path):
    rows, store = corpus(spark, 600, 2, words=2000)
    built = keywords.KeywordIndex.build(store, str(tmp_path / "i"), block=8)
    work = both(spark, store, [(1, "w900 w0"), (2, "w1500 w0 w1")], built, 1)
    assert work.read < 0.4 * work.postings and work.scored < 0.5 * work.rows


def test_hot_word_ties_and_repeats(spark, tmp_path):
    rows = [(f"r{i:04}", "same words here") for i in range(300)] + [(f"s{i}", f"same {i}") for i in range(20)]
    store = spark.createDataFrame(rows, "chunk_id string, text string")
    built = keywords.KeywordIndex.build(store, str(tmp_path / "i"), block=16)
    both(spark, store, [(1, "same"), (2, "same words here"), (3, "here 7")], built, 4)


def test_empty(spark, tmp_path):
    store = spark.createDataFrame([], "chunk_id string, text string")
    built = keywords.KeywordIndex.build(store, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "a")], "query_id int, query string")
    assert built.search(asked, 3)[0].collect() == []
    with pytest.raises(ValueError, match="top_k"):
        built.search(asked, 0)
