"""Tokenizers, truncation on ids, pooled encoders, and embedding and chunking with them."""

import os
import subprocess
import sys
import threading
import uuid
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import storage, tokens
from foliospark.operators import chunking, embedding
from foliospark.sources import files
from foliospark.sources.cache import VectorCache


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return tokens.RankFile(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


TEXTS = ["", "one two three four five six seven", "é" * 40 + " naïve 漢字 tail words", "x " * 3000, "short"]


@pytest.mark.parametrize("strategy", ["head", "tail", "head_tail"])
@pytest.mark.parametrize("most", [0, 1, 5, 20])
def test_truncation_on_ids(spark, ranks, strategy, most):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")
    for tokenizer in (ranks, tokens.CodePoints()):
        found = [r.t for r in frame.select("i", tokens.truncated(F.col("t"), tokenizer, most, strategy).alias("t")).orderBy("i").collect()]
        for text, got in zip([*TEXTS, ""], found, strict=True):
            ids = tokenizer.encode([text])[0]
            head = {"head": most, "tail": 0, "head_tail": int(most * 0.7)}[strategy]
            want = ids[:head] + (ids[len(ids) - (most - head) :] if most > head else [])
            assert got == (text if len(ids) <= most else tokenizer.decode([want])[0])


def test_counts(spark, ranks):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    assert [r.n for r in frame.select("i", tokens.counted(F.col("t"), ranks).alias("n")).orderBy("i").collect()] == [len(x) for x in ranks.encode(TEXTS)]


def test_unknown_strategy_and_negative_limit():
    with pytest.raises(ValueError, match="strategy"):
        tokens.cut([1, 2], 1, "middle")
    with pytest.raises(ValueError, match="negative"):
        tokens.truncated(None, tokens.CodePoints(), -1)


class Attentive:
    """States that depend on all of a text's tokens, so that padding would show if it were seen."""

    name, dimension, longest, padding = "attentive", 3, 50, 77

    def __init__(self):
        self.seen = []

    def states(self, ids, mask):
        self.seen.append(mask.shape)
        base = np.stack([ids, ids % 7, np.ones_like(ids)], 2).astype(float)
        whole = np.where(mask, ids, 0).sum(1) / np.maximum(mask.sum(1), 1)
        out = base + whole[:, None, None]
        out[~mask] = np.nan  # what a model gives for padding must not matter
        return out


@pytest.mark.parametrize("cells", [1, 60, 1 << 14])
def test_pooling_is_free_of_padding_and_batches(cells):
    texts = ["abc", "", "a" * 500, "zz", "hello world", "q"]
    model = Attentive()
    found = tokens.PooledEncoder(tokens.CodePoints(), model, cells).encode(texts)
    for text, got in zip(texts, found, strict=True):
        ids = np.array([ord(c) for c in text[:50]])
        want = np.stack([ids, ids % 7, np.ones_like(ids)], 1).mean(0) + ids.mean() if len(ids) else np.zeros(3)
        assert np.allclose(got, want)
    assert all(n == 1 or n * width <= cells for n, width in model.seen)


def test_batches_share_like_lengths():
    model = Attentive()
    tokens.PooledEncoder(tokens.CodePoints(), model, 400).encode(["a" * 40, "b"] * 50)
    assert sum(n * w for n, w in model.seen) <= 50 * 40 + 50 + 400


def test_embedding_with_a_tokenizer(spark, ranks):
    chunks = files.demo_chunks(spark)
    encoder = tokens.PooledEncoder(ranks, tokens.TokenTable(dimension=8))
    vectors, fresh = embedding.embed_chunks(chunks, "min_len=1", encoder, most=4, tokenizer=ranks)
    rows = {r.chunk_id: r for r in vectors.collect()}
    assert all(len(ranks.encode([r.embedding_text])[0]) <= 4 for r in rows.values()) and rows["c1"].dim == 8 and rows["c1"].model_id == "token-table/byte-bpe"
    want = encoder.encode([rows["c1"].embedding_text])[0]
    assert np.allclose(rows["c1"].vector, want / np.linalg.norm(want), atol=1e-6)
    other = embedding.embed_chunks(chunks, "min_len=1", encoder, most=4)[1]
    assert not {r.key for r in fresh.collect()} & {r.key for r in other.collect()}


def test_chunking_counts_by_the_tokenizer(spark):
    rows = [("d", n, 1, "paragraph", f"paragraph number {n} has some words in it for sure.", "", [n], None, "", 1.0, 1.0) for n in range(12)]
    blocks = spark.createDataFrame(rows, "doc_id string, ord int, page int, role string, text string, html string, element_ids array<int>, bbox struct<x1:double,y1:double,x2:double,y2:double>, picture string, page_width double, page_height double")
    few = chunking.chunk_blocks(blocks, max_tokens=120, overlap=0, tokenizer=tokens.CodePoints()).collect()
    assert len(few) == 6 and all(60 < len(r.text) <= 120 for r in few)
    assert len(chunking.chunk_blocks(blocks, max_tokens=120, overlap=0).collect()) < len(few)


# ---- descriptions -----------------------------------------------------------------------------------------------------


def figures(spark, n):
    demo = files.demo_chunks(spark).where("role = 'figure'")
    return demo.drop("chunk_id", "ord", "order_rank", "image_path").crossJoin(spark.range(n)).select("*", F.concat(F.lit("f"), "id").alias("chunk_id"), F.col("id").cast("int").alias("ord"), F.col("id").cast("int").alias("order_rank"), F.concat(F.lit("p"), "id").alias("image_path")).drop("id")


@pytest.mark.parametrize("plain", [True, False])
def test_a_describer_whose_answers_vary_loses_nothing(spark, tmp_path, plain):
    log = str(tmp_path / "calls")
    os.mkdir(log)

    def told(path):
        name = uuid.uuid4().hex
        open(f"{log}/{name}", "w").close()
        return f"{path} {name}"

    @F.pandas_udf("string")
    def column(paths):
        return paths.map(told)

    vectors, fresh = embedding.embed_chunks(figures(spark, 20), "", describe=embedding.describer(told) if plain else column)
    rows = vectors.collect()
    assert len(rows) == 20 and len({r.embedding_text for r in rows}) == 20 and fresh.count() == 20
    assert len(os.listdir(log)) == 20
    assert {r.chunk_id for r in vectors.collect()} == {r.chunk_id for r in rows}


def test_failing_descriptions_keep_the_caption_and_are_counted(spark):
    def told(path):
        if path.endswith("3"):
            raise OSError("no such picture")
        return None if path.endswith("4") else "a picture"

    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        vectors, _ = embedding.embed_chunks(figures(spark, 20), "", describe=embedding.describer(told))
    texts = {r.chunk_id: r.embedding_text for r in vectors.collect()}
    assert texts["f3"] == "passage: Figure caption: The parts in order" and texts["f5"].endswith("\nVisual summary: a picture")
    assert any("4 figures could not be described" in str(w.message) for w in said)


def test_only_figures_are_described(spark):
    def told(path):
        raise AssertionError("not a figure")

    vectors, _ = embedding.embed_chunks(files.demo_chunks(spark).where("role <> 'figure'"), "min_len=1", describe=embedding.describer(told))
    assert vectors.count() == 5


SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from foliospark.operators import embedding
from foliospark.functions import text
kind = "doc_id string, chunk_id string, ord int, page_start int, order_rank int, role string, text string, html string, image_path string, section_id string, section_path string, content_sha256 string"
row = ("d", "c", 0, 1, 0, "table", "cap\\u00e9", "<table><tr><td>a</td></tr></table>", "", "", "", "")
spark.createDataFrame([row], kind).write.mode("overwrite").parquet(sys.argv[2])
stored = spark.read.parquet(sys.argv[2])
if sys.argv[3] == "embed":
    print("ROWS", embedding.embed_chunks(stored, "")[0].count())
elif sys.argv[3] == "normalize":
    print("ROWS", len(stored.select(text.normalize(F.col("text"))).collect()))
else:
    print("ROWS", len(stored.select(embedding.linearized(F.col("html"), F.col("text"))).collect()))
"""


@pytest.mark.parametrize("what", ["embed", "normalize", "linearized"])
def test_first_call_of_a_session_from_another_folder(tmp_path, what):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, root, str(tmp_path / "rows"), what], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1" in done.stdout, done.stderr[-2000:]


# ---- shared folder and cache ------------------------------------------------------------------------------------------


def in_threads(work, n):
    failed = []

    def run(i):
        try:
            work(i)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed


def test_writes_side_by_side_leave_the_session_as_it_was(spark):
    before = spark.conf.get(storage.CLEANUP, "false")
    in_threads(lambda i: storage.written(spark, spark.range(2000).repartition(3, "id"), f"t{i}").count(), 6)
    assert spark.conf.get(storage.CLEANUP, "false") == before and not storage._WRITING


def test_cache_has_one_row_a_key_whoever_writes(spark, tmp_path):
    cache = VectorCache(spark, f"file://{tmp_path}/cache")
    assert cache.version() == 0 and cache.read().count() == 0
    rows = lambda own, first, last: spark.range(first, last).select(F.concat(F.lit("k"), "id").alias("key"), F.array(F.lit(float(own)).cast("float")).alias("vector"))
    in_threads(lambda i: cache.append(rows(i, 0, 50).unionByName(rows(i, 10 * i + 100, 10 * i + 120))), 4)
    found = cache.read().collect()
    assert len(found) == len({r.key for r in found}) == 50 + 50 and 1 <= cache.version() <= 4
    assert len({tuple(r.vector) for r in found if int(r.key[1:]) < 50}) == 1  # all from the first commit
    version = cache.version()
    assert cache.append(rows(9, 0, 50)) == version and cache.append(rows(9, 500, 501)) == version + 1
    assert cache.read(version).count() == 100 and cache.read().count() == 101


def test_cache_takes_one_of_repeated_keys(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "cache"))
    cache.append(spark.createDataFrame([("a", [2.0]), ("a", [1.0]), (None, [3.0]), ("b", [5.0])], "key string, vector array<float>"))
    assert sorted((r.key, r.vector) for r in cache.read().collect()) == [("a", [1.0]), ("b", [5.0])]


def test_repeated_keys_of_a_foreign_cache_double_nothing(spark):
    chunks = files.demo_chunks(spark)
    vectors, fresh = embedding.embed_chunks(chunks, "min_len=1")
    twice = fresh.unionByName(fresh.withColumn("vector", F.transform("vector", lambda x: x + 1)))
    again, missing = embedding.embed_chunks(chunks, "min_len=1", cache=twice)
    assert missing.count() == 0 and again.count() == vectors.count() == 6


class FewAtATime(tokens.CodePoints):
    """A tokenizer that is given no more than 256 texts and not much more than a part's characters."""

    def encode(self, texts):
        if len(texts) > 256 or (len(texts) > 1 and sum(map(len, texts)) > 1 << 18):
            raise MemoryError(f"{len(texts)} texts at a time")
        return super().encode(texts)


def test_texts_are_tokenized_a_few_at_a_time(spark):
    rows = spark.range(0, 3000, numPartitions=1).select("id", F.when(F.col("id") % 7 != 3, F.repeat(F.lit("né "), (F.col("id") % 700).cast("int"))).alias("t"))
    least = FewAtATime()
    one = rows.select("id", tokens.counted(F.col("t"), least).alias("n_tokens"), *[tokens.truncated(F.col("t"), least, 512, s).alias(s) for s in ("head", "tail", "head_tail")])
    cuts = tokens.with_cuts(rows, "t", least, 512)
    assert cuts.columns == one.columns and sorted(cuts.collect()) == sorted(one.collect()) and cuts.count() == 3000
    with pytest.raises(ValueError):
        tokens.with_cuts(rows, "t", least, 3, ("middle",))


def test_texts_are_embedded_a_few_at_a_time(spark):
    encoder = tokens.PooledEncoder(FewAtATime(), tokens.TokenTable(dimension=4, longest=64))
    rows = spark.range(0, 3000, numPartitions=1).select("id", F.when(F.col("id") % 7 != 3, F.repeat(F.lit("né "), (F.col("id") % 700).cast("int"))).alias("t"))
    found = {r.id: r.v for r in rows.select("id", embedding.embed(F.col("t"), encoder).alias("v")).collect()}
    again = {r.id: r.v for r in rows.where("id % 500 = 8").select("id", embedding.embed(F.col("t"), encoder).alias("v")).collect()}
    assert len(found) == 3000 and all(found[k] == v for k, v in again.items()) and found[3] == [0.0] * 4
