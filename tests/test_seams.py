"""Seams and commands: other parsers, pictures, table files, caches, devices, store checks."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark import cli
from foliospark.operators import curation, embedding, retrieval
from foliospark.sources import files, parsing
from foliospark.sources.cache import VectorCache


def parse_plain(path, content, strategy):
    """A parser as the command line names it."""
    if content.startswith(b"broken"):
        raise ValueError("cannot be read")
    rows = [{"type": "NarrativeText", "text": t, "page_number": 9, "element_index": n} for n, t in enumerate(content.decode().split("\n")) if t and not t.startswith("picture ")]
    rows += [{"type": "Image", "text": "", "page_number": 9, "image_path": t[8:]} for t in content.decode().split("\n") if t.startswith("picture ")]
    return [*rows, {"type": "Table", "text": "cells", "page_number": 9}]


def find_tables(path, content, flavor):
    return ["| a | b |"] if flavor == "stream" else []


class SmallEncoder:
    name, dimension = "small", 3

    def __init__(self, device):
        self.device = device

    def encode(self, texts):
        return [[float(len(t)), 1.0, 0.0] for t in texts]


def test_other_parsers_pictures_and_tables(spark, tmp_path, capsys):
    shelf, out = tmp_path / "shelf", tmp_path / "out"
    shelf.mkdir()
    out.mkdir()
    (tmp_path / "pic.png").write_bytes(b"png bytes")
    (out / "own_images").mkdir()
    (out / "own_images" / "in.png").write_bytes(b"inside")
    (shelf / "a.txt").write_text(f"This is a paragraph that is long enough.\npicture {tmp_path}/pic.png\npicture {out}/own_images/in.png\npicture {tmp_path}/gone.png")
    (shelf / "b.txt").write_text("broken")
    run = lambda *a: cli.main([str(x) for x in a])
    where = "tests.test_seams"
    args = ["parse", "--input", shelf, "--output", out / "e", "--glob", "*.txt", "--parser", f"{where}:parse_plain", "--images", out, "--tables", f"{where}:find_tables", "--markdown", out / "tables", "--stats", out / "stats"]
    assert run(*args) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) | {"pages": 0} == {"files": 2, "succeeded": 1, "failed": 1, "elements": 5, "pages": 0, "tables": 1, "images": 3}
    rows = spark.read.json(str(out / "e")).collect()
    doc = next(r.doc_id for r in rows if r.type == "Image")
    assert {r.image_path for r in rows if r.type == "Image"} == {f"{doc}_images/pic.png", "own_images/in.png", ""}
    assert (out / f"{doc}_images" / "pic.png").read_bytes() == b"png bytes"
    assert [r.markdown_path for r in rows if r.type == "Table"] == [f"{doc}/a_table_1.md"] and (out / "tables" / doc / "a_table_1.md").read_text() == "| a | b |"
    stats = {r.success: r for r in spark.read.json(str(out / "stats")).collect()}
    assert stats[True].strategy == "hi_res" and "cannot be read" in stats[False].error


def test_prepare_demo_embed_and_page(spark, tmp_path, capsys):
    run = lambda *a: cli.main([str(x) for x in a])
    site = tmp_path / "site"
    site.mkdir()
    for n in range(2):
        (site / f"{n}.html").write_text(f"<h1>Page number {n} has a title</h1><p>This is the text of page number {n}, long enough to be kept.</p><p>Same on all pages, word for word and letter.</p>")
    assert run("parse", "--input", site, "--output", tmp_path / "e") == 0
    assert run("prepare", "--input", tmp_path / "e", "--output", tmp_path / "p", "--strict-toc") == 0
    told = capsys.readouterr().out
    assert [line.split()[1].rstrip(":") for line in told.splitlines() if line.startswith("ok")] == ["chunk", "check", "determinism", "dedup", "check"]
    assert spark.read.json(str(tmp_path / "p/unique")).count() <= spark.read.json(str(tmp_path / "p/chunks")).count()
    assert run("quality", "--input", tmp_path / "e", "--output", tmp_path / "m", "--page", tmp_path / "page.html") == 0 and "<table>" in (tmp_path / "page.html").read_text()
    assert run("demo", "--output", tmp_path / "d") == 0
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        embed = ["embed", "--input", tmp_path / "d", "--cache", tmp_path / "cache", "--truncation", "head+tail", "--batch-size", 2, "--encoder", "tests.test_seams:SmallEncoder", "--device", "cpu", "--plain-tables"]
        assert run(*embed, "--output", tmp_path / "v") == 0 and VectorCache(spark, str(tmp_path / "cache")).read().count() == 3
        assert run(*embed, "--output", tmp_path / "w") == 0 and VectorCache(spark, str(tmp_path / "cache")).read().count() == 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows = [{(r.chunk_id, tuple(r.vector), r.truncation, r.embedding_text) for r in spark.read.parquet(str(tmp_path / n)).collect()} for n in ("v", "w")]
    assert rows[0] == rows[1] and {t for _, _, t, _ in rows[0]} == {"head_tail(512)"} or {t for _, _, t, _ in rows[0]} == {"head+tail(512)"}


def test_overlays(spark):
    from tests.test_layout import element, frame

    page = files.quality_page(spark.createDataFrame([(1, 0.5)], "page_number int, coverage double"), "t", frame(spark, [element(0, "a", y=10), element(1, "b", page=2, y=20)]), spark.createDataFrame([(1, 100.0, 200.0)], "page_number int, width double, height double"))
    assert page.count("<svg") == 2 == page.count("<rect") and 'viewBox="0 0 100 200"' in page


def test_devices():
    assert embedding.pick_device("cuda") == "cuda" and embedding.pick_device() in ("cpu", "cuda", "mps")


def test_store_with_vectors(spark):
    chunks = spark.createDataFrame([("d", "1", None, "2"), ("d", "2", "1", "3"), ("d", "3", "2", None), ("e", "2", "1", None)], "doc_id string, chunk_id string, prev_id string, next_id string")
    vectors = spark.createDataFrame([("d", "1", [1.0]), ("d", "2", [2.0]), ("x", "9", [3.0])], "doc_id string, chunk_id string, vector array<double>")
    found = retrieval.with_vectors(chunks, vectors, scope=("doc_id",), columns=("vector",))
    assert sorted(map(tuple, found.collect())) == [("d", "1", None, "2", [1.0]), ("d", "2", "1", None, [2.0])]
    retrieval.validate_store(found.withColumn("section_path", F.lit("")), key=("doc_id", "chunk_id"))
    with pytest.warns(UserWarning, match="the index has 3 vectors, the store 4 rows"):
        assert not retrieval.check_aligned(chunks, vectors)
    assert retrieval.check_aligned(chunks, chunks)


def test_cached_store(spark):
    store = retrieval.CachedStore(spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, n int"), size=2)
    assert [r["n"] for r in store.fetch(["b", "a", "b"])] == [2, 1, 2] and store.fetch([]) == []
    store.fetch(["b", "a", "b"])[0]["n"] = 9
    assert store.fetch(["b", "a", "b"])[0]["n"] == 2 and store.info().hits == 2
    with pytest.raises(ValueError, match="unknown"):
        store.fetch(["zzz"])


def test_broken_lines_are_violations(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n\n  \nbroken\n[1, 2]\n{"a": \n')
    found = curation.invalid_lines(spark, str(tmp_path / "c.jsonl")).collect()
    assert len(found) == 2 and {r.rule for r in found} == {"json"} and all(r.detail.endswith("c.jsonl") for r in found)


def test_image_paths_lie_beside_their_chunks(spark, tmp_path):
    files.write_jsonl(files.demo_chunks(spark), str(tmp_path / "d"))
    found = {r.image_path for r in files.read_chunks(spark, str(tmp_path / "d")).collect()}
    assert found == {"", f"file://{tmp_path}/d/figures/parts.png"} or found == {"", f"file:{tmp_path}/d/figures/parts.png"}
    assert "languages" in parsing.find_files(spark, str(tmp_path), pattern="*.json").columns
