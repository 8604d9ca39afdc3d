"""The N-gram Jaccard join against brute force."""

import itertools
import random
import re

import pytest

from foliospark.llm import near


def grams(text):
    words = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows):
    """{doc_id: (class_id, text_id, n_links)}"""
    texts = {}
    for d, t in rows:
        texts.setdefault(t or "", []).append(d)
    keys = list(texts)
    sets = [grams(t) for t in keys]
    root, links = list(range(len(keys))), [0] * len(keys)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(keys)), 2):
        if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for k, t in enumerate(keys):
        low[find(k)] = min(low.get(find(k), 1 << 60), *texts[t])
    return {d: (low[find(k)], min(texts[t]), links[k]) for k, t in enumerate(keys) for d in texts[t]}


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 8, 60, 150)))]
        for _ in range(rng.choice((1, 1, 1, 2, 6))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows + [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "?!"), (len(rows) + 3, "one"), (len(rows) + 4, "One")]


def got(frame):
    return {r.doc_id: (r.class_id, r.text_id, r.n_links) for r in frame.collect()}


def test_bands_reach_the_recall():
    bands, rows = near.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
    with pytest.raises(ValueError):
        near.choose_bands(0.01, 0.999999, 10)


@pytest.mark.parametrize("block", [512, 3])
def test_equals_brute_force(spark, block):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, text_key string, bands string").repartition(5)
    assert got(near.classes(frame, block=block)) == brute(rows)


def test_a_large_group_of_near_copies_in_small_blocks(spark):
    rng = random.Random(8)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(80):
        copy = list(base)
        for _ in range(rng.choice((0, 1, 2, 3))):
            copy[rng.randrange(120)] = f"z{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    assert got(near.classes(spark.createDataFrame(rows, "doc_id long, text string"), block=10)) == brute(rows)


def test_blocks_are_bounded_by_bytes_and_put_down_once(spark, monkeypatch):
    """Long texts split a bucket as many texts do; what is stored grows with the bucket, not with its square."""
    from foliospark.functions import joins, storage

    monkeypatch.setattr(joins, "LEAST_HOT", 3)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(4000)]
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.choice((0, 3, 20, 60))):
            copy[rng.randrange(4000)] = f"z{rng.randrange(4000)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, rows[0][1]) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near.classes(frame, block_bytes=100_000)) == brute(rows)
    paths = []
    monkeypatch.setattr(near, "scratch", lambda s, n: paths.append(storage.scratch(s, n)) or paths[-1])
    near.linked_texts(frame, block_bytes=100_000)
    import glob
    import os

    stored = sum(os.path.getsize(f) for f in glob.glob(paths[-1].removeprefix("file://") + "/*.blocks"))
    texts = len({t for _, t in rows})
    bands, _ = near.choose_bands()
    assert 0 < stored <= 1.2 * texts * bands * (8 * 4000 + 8 * bands + 100)


def test_very_long_texts(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(50_000)}" for _ in range(400_000)]
    near_copy = list(words)
    near_copy[200_000] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near_copy)), (3, " ".join(words[:300_000])), (4, "w " * 400_000), (5, "x" * 3_000_000)]
    assert got(near.classes(spark.createDataFrame(rows, "doc_id long, text string"))) == {1: (1, 1, 1), 2: (1, 2, 1), 3: (3, 3, 0), 4: (4, 4, 0), 5: (5, 5, 0)}


def test_benchmark_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(near.classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_one_of_each_keeps_the_least_id(spark):
    rows = corpus(5, 20)
    frame = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    kept = sorted(r.doc_id for r in near.one_of_each(frame).collect())
    assert kept == sorted({c for c, _, _ in brute(rows).values()})


def test_empty_table_and_null_ids(spark):
    assert near.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert near.one_of_each(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f g")], "doc_id long, text string")
    found = near.classes(rows).collect()
    assert len(found) == 3 and {r.doc_id for r in found} == {None, 7}
    assert len(near.one_of_each(spark.createDataFrame([(None, "q"), (None, "q")], "doc_id long, text string")).collect()) == 1


def test_components(spark):
    edges = [(a, a + 1) for a in range(0, 30)] + [(100, 105), (105, 103), (200, 200)]
    labels = {r.node: r.label for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({labels[k] for k in range(31)}) == 1 and labels[100] == labels[103] == labels[105] != labels[0]


def test_recall_on_the_benchmark(spark):
    """Links of every id divisible by 100 with all rows of sf0.1, against brute force."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    texts = {}
    for d, t in rows:
        texts.setdefault(t or "", []).append(d)
    sets = [grams(t) for t in texts]
    at = {}
    for k, s in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(k)
    links = {}
    for k, (t, ids) in enumerate(texts.items()):
        if any(d % 100 == 0 for d in ids):
            shared = {}
            for g in sets[k]:
                for j in at[g]:
                    shared[j] = shared.get(j, 0) + 1
            n = sum(j != k and both >= 0.8 * (len(sets[k]) + len(sets[j]) - both) for j, both in shared.items())
            links |= {d: n for d in ids if d % 100 == 0}
    found = {r.doc_id: r.n_links for r in near.classes(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("doc_id % 100 = 0").collect()}
    assert found.keys() == links.keys() and all(found[d] <= links[d] for d in links)
    assert sum(found.values()) >= 0.99 * sum(links.values()) > 0
    print("recall", sum(found.values()), sum(links.values()))


def test_hubs_and_large_labels_are_dealt_out(spark, monkeypatch):
    """Every key is hot: buckets, hubs of the graph, labels of large components."""
    from foliospark.functions import joins

    monkeypatch.setattr(joins, "LEAST_HOT", 1)
    rows = corpus(11, 10)
    assert got(near.classes(spark.createDataFrame(rows, "doc_id long, text string"), block=3)) == brute(rows)
    edges = [(0, i) for i in range(1, 20)] + [(100 + i, 101 + i) for i in range(10)]
    labels = {r.node: r.label for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({labels[i] for i in range(20)}) == 1 and len({labels[100 + i] for i in range(11)}) == 1 and labels[0] != labels[100]


def test_one_of_each_with_any_columns(spark):
    rows = corpus(5, 12)
    frame = spark.createDataFrame([(*r, 1, "own", "x", None) for r in rows], "doc_id long, text string, label int, `a.b` string, text_key string, n string")
    found = near.one_of_each(frame)
    assert found.columns == frame.columns and sorted(r.doc_id for r in found.collect()) == sorted({c for c, _, _ in brute(rows).values()})
    assert {(r.label, r["a.b"], r.text_key, r.n) for r in found.collect()} == {(1, "own", "x", None)}
