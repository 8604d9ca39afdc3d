"""The pipeline against its stages written out in plain Python."""

import collections
import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from foliospark.llm import bpe
from tests.llm import test_mixing, test_near, test_pii, test_quality

SF = "/root/testdata/sf0.001"


def redacted(text):
    marks = []
    for kind, pattern in test_pii.PATTERNS.items():
        marks += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if test_pii.valid(kind, m[0])]
    out, at = [], 0
    for start, end, kind in sorted(marks):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    left = []
    good = {w[0] for w in test_quality.brute([(r.doc_id, r.source, r.text) for r in rows.values()], left=left) if w[7]}
    texts = {d: t for d, t in left if d in good}
    stages = dict(corpus_pipeline.STAGES)

    one = stages["quality rules"](spark, docs, SF)
    assert one.columns == docs.columns and {r.doc_id: r.text for r in one.collect()} == texts
    classes = test_near.brute(list(texts.items()))
    texts = {d: t for d, t in texts.items() if classes[d][0] == d}
    two = stages["n-gram Jaccard join"](spark, one, SF)
    assert two.columns == docs.columns and {r.doc_id: r.text for r in two.collect()} == texts
    texts = {d: redacted(t) for d, t in texts.items()}
    three = stages["PII"](spark, two, SF)
    assert three.columns == docs.columns and {r.doc_id: r.text for r in three.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in three.collect() if "<" in r.text)
    counts = {d: n for d, _, n in test_mixing.expected([(d, rows[d].source, t) for d, t in texts.items()]) if n}
    four = stages["mixing"](spark, three, SF)
    assert four.columns == docs.columns and collections.Counter(r.doc_id for r in four.collect()) == counts
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in stages["byte-level BPE"](spark, four, SF).collect():
        assert r.n_tokens == len(own.encode_ordinary(texts[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_the_rows_of_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda frame: sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in frame.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(docs)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


BODY = " ".join(f"word{i}" for i in range(60))
CASES = [
    (1, f"{BODY} end", "en", "a", 1), (2, f"{BODY} end", "en", "a", 1), (2, f"{BODY} end", "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (None, f"{BODY} other tail entirely", None, None, 7),
    (5, f"{BODY.replace('word', 'term')} mail me@example.org now", "de", "b", 9), (6, " ".join(f"l{i}" for i in range(60_000)), "en", "b", 3), (7, "ab " * 400, "en", "b", 3), (8, "short", "en", "a", 5),
]


def awkward(spark):
    """Nulls in every column, ties, repeated rows, empty and very long texts, and more columns with names used inside."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, text_key string, label int, n int, replica int, __row string, rate double, kept boolean, spans string"
    return spark.createDataFrame([(*r, "own", 1, 2, 3, "own", 0.5, False, "own") for r in CASES], kind)


def test_stages_on_awkward_rows(spark):
    docs = awkward(spark)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, SF)
    good = [w[0] for w in test_quality.brute([(r[0], r[3], r[1]) for r in CASES]) if w[7]]
    assert kept.columns == columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, good))
    unique = stages["n-gram Jaccard join"](spark, docs, SF)
    # equal texts are one, and so are texts without words; of a class whose ids are null one row stays
    assert unique.columns == columns and sorted(str(r.doc_id) for r in unique.collect()) == sorted(["1", "3", "5", "6", "7", "8"])
    shown = stages["PII"](spark, docs, SF)
    texts = sorted((str(r.doc_id), r.text or "") for r in shown.collect())
    assert shown.columns == columns and texts == sorted((str(d), redacted(t or "")) for d, t, *_ in CASES)
    assert [r.text for r in shown.collect() if r.doc_id == 3] == [None]
    mixed = stages["mixing"](spark, docs, SF)
    counts = collections.Counter((r.doc_id, r.source) for r in mixed.collect())
    want = collections.Counter()
    for d, s, n in test_mixing.expected([(r[0], r[3], r[1]) for r in CASES]):
        want[d, s] += n
    assert mixed.columns == columns and counts == +want
    coded = stages["byte-level BPE"](spark, docs, SF).collect()
    assert len(coded) == len(CASES) and sorted((str(r.doc_id), r.decoded_sha256) for r in coded) == sorted((str(d), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in CASES)


def test_run_of_all_stages_on_awkward_rows(spark):
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} <= {1, 5, 6, None}
