"""Personal data against Python's regular expressions."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from foliospark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
    }[kind]


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
    return out


def check(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.digest(pii.find(frame)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        kinds = [s for s in r.spans.split(",") if s and s.split(":")[0] in PATTERNS]
        assert kinds == want, (texts[r.doc_id], kinds, want)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in PATTERNS]


def test_random_texts(spark):
    rng = random.Random(2)
    parts = ["a@b.co", "x.y+z@", "@", ".", "c-d.e", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "0000000000000000", "+1 (212) 555-0100", "+4", "+1234", " ", "-", "é", "😀", "x", "7", "12-34", "\n", "+12 34 56 78 90.", "%"]
    check(spark, ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)] + [None, ""])


def test_benchmark_documents(spark):
    check(spark, [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()])


def long_texts(n):
    return ["a" * n, "a." * (n // 2), "x@" + "a." * (n // 2) + "b", "1" * n, "1 " * (n // 2), "1." * (n // 2), "+1" * (n // 3), "+1" + "." * n, "4111 1111 1111 1111x" * (n // 20)]


def test_long_texts(spark):
    check(spark, long_texts(5000))


def test_very_long_texts_take_no_square_of_time(spark):
    frame = spark.createDataFrame(list(enumerate(long_texts(100_000))), "doc_id long, text string")
    began = time.time()
    assert len(pii.digest(pii.find(frame)).collect()) == 9
    assert time.time() - began < 60


@pytest.mark.parametrize(("number", "good"), [("GB82WEST12345698765432", True), ("GB82 WEST 1234 5698 7654 32", True), ("DE89370400440532013000", True), ("GB83WEST12345698765432", False)])
def test_iban(spark, number, good):
    text = f"é Konto: {number}, danke"
    found = pii.digest(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first().spans
    assert (f"iban:9:{9 + len(number)}" in found) == good


def test_context_decides_on_weak_kinds(spark):
    rows = [(1, "social security number 123-45-6789 of the insured"), (2, "order part 123-45-6789"), (3, "123-45-6789"), (4, "ssn 666-45-6789")]
    found = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found == {1: "ssn:23:34", 2: "", 3: "", 4: ""}
    scored = {r.doc_id: r.pii[0].score for r in pii.find(spark.createDataFrame([(1, "write to a@b.co"), (2, "noreply a@b.co")], "doc_id long, text string")).collect()}
    assert scored[1] > scored[2]


def test_redaction(spark):
    rows = [(1, "é a@b.co and +1 (212) 555-0100.", 32), (2, None, None), (3, "clean", 5), (4, "card 4111 1111 1111 1111", 24)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("pii", F.lit("own"))
    out = {r.doc_id: r for r in pii.redact(frame).collect()}
    assert out[1].text == "é <EMAIL> and <PHONE>." and out[1].n_chars == len(out[1].text) and out[1].pii == "own"
    assert out[2].text is None and out[3].text == "clean" and out[4].text == "card <CARD>"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(pii.find(empty)).collect() == [] and pii.redact(empty).collect() == []


def test_plan_is_native(spark):
    found = pii.digest(pii.find(spark.createDataFrame([(1, "x")], "doc_id long, text string")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_forty_thousand_matches_in_one_text(spark):
    body = " ".join(f"u{i}@host{i}.org" for i in range(40_000))
    frame = spark.createDataFrame([(1, body, 1), (2, None, 2), (2, None, 2)], "doc_id long, text string, n_chars long").withColumn("__row", F.lit("own")).withColumn("__text", F.lit("own")).withColumn("a.b", F.lit(1))
    began = time.time()
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find(frame)).collect()}
    assert time.time() - began < 15
    assert spans == {1: ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(PATTERNS["email"], body)), 2: ""}
    began = time.time()
    rows = pii.redact(frame).collect()
    assert time.time() - began < 15
    assert sorted((r.doc_id, r.text or "", r["__row"], r["a.b"]) for r in rows) == [(1, " ".join(["<EMAIL>"] * 40_000), "own", 1), (2, "", "own", 1), (2, "", "own", 1)]


def test_overlapping_spans_become_one_mark(spark):
    rng = random.Random(11)
    parts = ["+1 4111 1111 1111 1111", "4111 1111 1111 1111", "1.2.3.4", "a@1.2.3.4", "+49 30 1234567", " ", "x", "é😀", "1.2.3.4@b.co"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.pii for r in pii.find(frame).collect()}
    for r in pii.redact(frame).collect():
        out, at, text = [], 0, texts[r.doc_id]
        for start, end, kind in sorted((s.start, s.end, s.kind) for s in spans[r.doc_id]):
            if start >= at:
                out += [text[at:start], f"<{kind.upper()}>"]
            at = max(at, end)
        assert r.text == "".join(out) + text[at:]
