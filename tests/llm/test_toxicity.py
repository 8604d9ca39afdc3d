import random
import zlib

import numpy as np
import pytest

from foliospark.llm import toxicity


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def corpus(n=900, seed=4):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 80))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), "vorku" + rng.choice(["ti", "sa", "lem", "no", "ra"]) if rng.random() < 0.7 else rng.choice(["moron", "idiot"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    y = np.asarray(y, bool)
    return (rank[y].mean() - (y.sum() - 1) / 2) / (~y).sum()


def test_held_out_rows_with_unseen_endings(spark):
    docs, labels = corpus()
    docs.append((5000, "abc vorkuxyz dcb ghf abd"))  # an ending that no labelled row has
    found = toxicity.toxicity(*frames(spark, docs, labels)).collect()
    assert len(found) == len(docs) and {r.doc_id: r.held_out for r in found} == {d: held(d) for d, _ in docs}
    truth = dict(labels)
    out = [r for r in found if r.held_out and r.doc_id in truth]
    assert auc([truth[r.doc_id] for r in out], np.array([r.score for r in out])) > 0.98
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    assert next(r.predicted for r in found if r.doc_id == 5000) == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = corpus(300)
    one = {r.doc_id: r.score for r in toxicity.toxicity(*frames(spark, docs, labels)).collect()}
    turned = [(d, 1 - y if held(d) else y) for d, y in labels]
    assert one == {r.doc_id: r.score for r in toxicity.toxicity(*frames(spark, docs, turned)).collect()}


def test_benchmark_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert auc([truth[r.doc_id] for r in out], np.array([r.score for r in out])) > 0.95
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.96


def test_label_model_finds_rates_and_correlations():
    rng = random.Random(3)
    counts, known, rates = {}, ({}, {}), [(0.02, 0.7), (0.05, 0.6), (0.1, 0.8), (0.01, 0.5)]
    for _ in range(40_000):
        y = int(rng.random() < 0.2)
        fired = [rng.random() < r[y] for r in rates]
        fired.append(fired[0] if rng.random() < 0.95 else rng.random() < 0.1)  # an echo of the first voter
        mask = sum(f << k for k, f in enumerate(fired))
        counts[mask] = counts.get(mask, 0) + 1
        if rng.random() < 0.05:
            known[y][mask] = known[y].get(mask, 0) + 1
    posterior, cliques, found = toxicity.label_model(counts, known, 5)
    assert (0, 4) in cliques
    for k in range(4):
        assert abs(found[1][k] - rates[k][1]) < 0.08 and abs(found[0][k] - rates[k][0]) < 0.05
    assert posterior[0b01111] > 0.99 and posterior[0] < 0.1
    assert posterior[0b10001] < posterior[0b00011]  # an echo is no second witness


def test_many_echoes_are_one_witness():
    rng = random.Random(8)
    counts, known, toxic = {}, ({}, {}), {}
    for _ in range(60_000):
        y = int(rng.random() < 0.2)
        fired = [rng.random() < r[y] for r in ((0.05, 0.5), (0.1, 0.6))]
        heard = rng.random() < (0.1, 0.6)[y]
        fired += [heard if rng.random() < 0.9 else rng.random() < 0.3 for _ in range(6)]
        mask = sum(f << k for k, f in enumerate(fired))
        counts[mask] = counts.get(mask, 0) + 1
        toxic[mask] = toxic.get(mask, 0) + y
        if rng.random() < 0.1:
            known[y][mask] = known[y].get(mask, 0) + 1
    posterior, cliques, _ = toxicity.label_model(counts, known, 8)
    assert (2, 3, 4, 5, 6, 7) in cliques
    all_echoes = 0b11111100
    assert abs(posterior[all_echoes] - toxic[all_echoes] / counts[all_echoes]) < 0.1


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, None), (None, 1)], [(1, 1), (1, 0), (2, 1)]])
def test_scanty_labels(spark, labels):
    docs = [(1, "some text"), (2, None), (3, ""), (None, "idiot"), (4, "x" * 200_000), (1, "some text")]
    found = toxicity.toxicity(*frames(spark, docs, labels)).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)


def test_empty_table_and_clashing_columns(spark):
    docs, labels = frames(spark, [], [])
    assert toxicity.toxicity(docs, labels).collect() == []
    rows, marks = corpus(60)
    d, y = frames(spark, rows, marks)
    from pyspark.sql import functions as F

    found = toxicity.toxicity(d.withColumn("score", F.lit("own")).withColumn("toxic", F.lit(1)), y).collect()
    assert len(found) == 60 and isinstance(found[0].score, float)


def test_query_equals_the_model_row_by_row(spark):
    """Scores by the definition: a sigmoid of the weights of a text's words and word beginnings."""
    import math
    import re

    import xxhash

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == len(texts)
    for r in found:
        hits = set()
        for w in set(re.findall(r"\w+", texts[r.doc_id].lower())):
            hits.add(xxhash.xxh32_intdigest(w) // 4 * 4)
            hits |= {xxhash.xxh32_intdigest(w[:n] + "*") // 4 * 4 + n - 3 for n in (4, 5, 6) if len(w) > n}
        z = model.bias + sum(model.weights.get(h, 0.0) for h in hits)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id)


def test_label_model_equals_plain_expectation_maximisation():
    """Independent voters, no labels: the textbook loops give the same posterior."""
    rng = random.Random(5)
    rates = [(0.05, 0.8), (0.1, 0.7), (0.02, 0.6), (0.1, 0.9), (0.02, 0.1), (0.03, 0.1), (0.01, 0.05)]
    counts = {}
    for _ in range(30_000):
        y = rng.random() < 0.3
        mask = sum((rng.random() < r[y]) << k for k, r in enumerate(rates))
        counts[mask] = counts.get(mask, 0) + 1
    posterior, cliques, _ = toxicity.label_model(counts, ({}, {}), 7, bound=2.0)
    assert all(len(c) == 1 for c in cliques)
    post = {m: 0.9 if m & 15 else 0.05 for m in counts}
    for _ in range(130):
        size = [sum(n * (1 - post[m]) for m, n in counts.items()), sum(n * post[m] for m, n in counts.items())]
        table = [[(sum(n * (post[m] if y else 1 - post[m]) for m, n in counts.items() if m >> v & 1) + 0.25) / (size[y] + 0.5) for v in range(7)] for y in (0, 1)]
        for m in counts:
            like = [(size[y] + 1.0) for y in (0, 1)]
            for v in range(7):
                for y in (0, 1):
                    like[y] *= table[y][v] if m >> v & 1 else 1 - table[y][v]
            post[m] = like[1] / sum(like)
    assert all(abs(posterior[m] - post[m]) < 0.02 for m in counts)


def test_voters():
    voters = toxicity.Voters([])
    fired = lambda text: {toxicity.VOTERS[k] for k in range(len(toxicity.VOTERS)) if voters(text) >> k & 1}
    assert fired("a calm text") == set() and fired("an idiot") == {"insults"} and fired("worthless") == {"contempt"} and fired("shit") == {"profanity"}
    assert fired("what an 1d10t") == {"disguised"} and fired("m*ron") == {"disguised"} and fired("i d i o t") == {"disguised"} and fired("word$$$ a*b c0de 1st 42") == set()
    assert fired("you are an idiot") == {"insults", "aimed"} and fired("what an IDIOT") == {"insults", "shouted"} and fired("stuuupid") == {"shouted"}
    assert fired("he is not an idiot") == {"insults", "negated"} and fired("idiot moron idiot") == {"insults", "repeated"}
    assert fired("") == set()


def test_reported_voters_and_what_the_label_model_adds(spark):
    """Voters' reported rates are those of the labelled rows; the posterior's classifier is no worse than the labels' with few labels."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    out = [d for d in truth if held(d) and d in texts]
    wrong = {}
    for posterior in (True, False):
        score = toxicity.Scorer(toxicity.fit(docs, labels, most=400, posterior=posterior))
        called = [score(texts[d]) >= 0.5 for d in out]
        wrong[posterior] = sum(c != truth[d] for c, d in zip(called, out, strict=True)), sum(c and not truth[d] for c, d in zip(called, out, strict=True))
    assert wrong[True][0] <= wrong[False][0] + 5 and wrong[True][1] < wrong[False][1]  # fewer clean documents are called toxic
    model = toxicity.fit(docs, labels)
    told = {v["voter"]: v for v in model.voters}
    voters = toxicity.Voters(model.lexicons)
    rows = [d for d in truth if not held(d) and d in texts]
    for k, name in enumerate(toxicity.VOTERS):
        fires = [voters(texts[d]) >> k & 1 for d in rows]
        for y, key in ((0, "fires_if_clean"), (1, "fires_if_toxic")):
            own = [f for f, d in zip(fires, rows, strict=True) if truth[d] == y]
            assert abs(told[name][key] - sum(own) / len(own)) < 0.1
    assert told["mined fours"]["fires_if_toxic"] > 0.5 > told["mined fours"]["fires_if_clean"] and told["insults"]["accuracy"] > 0.9
