import json

import pytest
from pyspark.sql import functions as F

from foliospark import cli, schemas
from foliospark.operators import chunking, embedding
from foliospark.sources import files, html, parsing
from foliospark.streaming import elements as stream


def test_find_and_parse_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.pdf", b"A"), ("sub/b.pdf", b"fails"), ("sub/c.pdf", b"slow"), ("d.txt", b"no")):
        (tmp_path / name).write_bytes(body)
    assert parsing.find_files(spark, str(tmp_path)).count() == 3 and parsing.find_files(spark, str(tmp_path), recursive=False).count() == 1

    def parse(path, content, strategy):
        if content == b"fails" or (content == b"slow" and strategy == "hi_res"):
            raise OSError("cannot be read")
        return [{"type": "Title", "text": "in-\nside  x", "page_number": 1}, None, {"type": "Table", "html": "", "page_number": 2}]

    parsed = parsing.parse_files(parsing.find_files(spark, str(tmp_path)), parse)
    rows = {(r.file_name, r.ord): r for r in parsed.collect()}
    assert rows["a.pdf", 0].text == "inside x" and rows["a.pdf", 0].strategy == "hi_res" and rows["c.pdf", 0].strategy == "fast" and ("a.pdf", 1) not in rows
    assert "cannot be read" in rows["b.pdf", None].error
    stats = parsing.file_stats(parsed, by="file_name").withColumn("error", F.when(F.col("file_name") == "b.pdf", "x"))
    assert tuple(parsing.batch_summary(stats).first()) == (3, 2, 1, 4, 4, 2, 0)


def test_normalized_elements(spark):
    schema = "doc_id string, file_name string, source_path string, ord int, element_index int, page_number int, type string, text string, html string, image_path string, points array<array<double>>, error string, meta_html string, layout struct<w:double,h:double>"
    points = [[0.0, 0.0], [0.0, 1.0], [2.0, 3.0], [1.0, 0.0]]
    rows = [("d", "f", "/f", 0, 0, 1, None, "x", "", None, points, None, "<t>", (100.0, 200.0)), ("d", "f", "/f", 1, 1, 1, "Text", None, "<own>", "p", None, None, "<t>", (0.0, 0.0)), ("d", "f", "/f", None, None, None, None, None, None, None, None, "broken", None, None)]
    one, two = parsing.normalize_elements(spark.createDataFrame(rows, schema)).orderBy("ord").collect()
    assert tuple(one.coordinates) == (0, 0, 2, 3) and tuple(one.given_box) == (0, 0, 0.02, 0.015) and one.html == "<t>" and one.type == "Unknown" and not one.is_toc
    assert two.html == "<own>" and two.coordinates is None and two.given_box is None and two.text == ""


def test_extracted_tables(spark):
    def extract(path, content, flavor):
        if content == b"broken":
            raise OSError("no")
        return ["| a |", "| b |"] if flavor == "stream" and content == b"soft" else ["| c |"] if content == b"ruled" else []

    rows = [("/x/a.pdf", bytearray(b"soft")), ("/x/b.pdf", bytearray(b"ruled")), ("/x/c.pdf", bytearray(b"none")), ("/x/d.pdf", bytearray(b"broken"))]
    found = parsing.extract_tables(spark.createDataFrame(rows, "path string, content binary"), extract).collect()
    assert sorted((r.markdown_path, r.text, r.strategy, r.element_index) for r in found) == [("a_table_1.md", "| a |", "stream", -1), ("a_table_2.md", "| b |", "stream", -1), ("b_table_1.md", "| c |", "lattice", -1)]


def test_table_fallback(spark):
    rows = [("a", 0, "Table", ""), ("a", 1, "Text", ""), ("b", 0, "Table", "<t>"), ("b", 1, "Table", ""), ("c", 0, "Text", "")]
    fallback = spark.createDataFrame([("a", -1, "Table", "a.md"), ("b", -1, "Table", "b.md")], "doc_id string, ord int, type string, markdown_path string")
    found = parsing.replace_tables(spark.createDataFrame(rows, "doc_id string, ord int, type string, html string"), fallback)
    assert sorted((r.doc_id, r.ord, r.markdown_path) for r in found.collect()) == [("a", -1, "a.md"), ("a", 1, None), ("b", 0, None), ("b", 1, None), ("c", 0, None)]


def test_html_elements():
    page = "<title>t</title><script>var x='<p>no</p>'</script><h1>Head <b>line</b></h1><p>one<br>two<p>three<ul><li>item</li></ul><img src=a.png alt=pic><table><tr><th>A<td>1</table><div>loose</div><p>end &amp; all"
    assert [(k, t) for k, t, _, _ in html.elements_of(page)] == [
        ("Title", "Head line"), ("NarrativeText", "one two"), ("NarrativeText", "three"), ("ListItem", "item"), ("Image", "pic"), ("Table", "A 1"), ("NarrativeText", "end & all"),
    ]
    assert html.elements_of("") == [] and html.elements_of("<p></p>") == []
    assert html.elements_of(page)[5][2].startswith("<table>")


def test_table_sentences():
    grid = "<table><thead><tr><th>Part</th><th>Mass</th></tr></thead><tbody><tr><td>Frame</td><td>4 kg</td></tr><tr><td></td><td>1 kg</td><td>x</td></tr></tbody></table>"
    assert embedding.table_sentences(grid, "Masses") == "Table caption: Masses\nColumns: Part, Mass\nRow 1: Part is 'Frame'; Mass is '4 kg'\nRow 2: Mass is '1 kg'; col3 is 'x'"
    assert embedding.table_sentences("<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>", "") == "Columns: a, b\nRow 1: a is 'a'; b is 'b'\nRow 2: a is '1'; b is '2'"
    assert embedding.table_sentences("<p>no table</p>", "cap") == "cap" and embedding.table_sentences("", None) == ""


def test_policy():
    assert embedding.parse_policy("roles=a, b|min_len=7|skip_empty_figures|what") == {"roles": ["a", "b"], "min_len": 7, "skip_empty_figures": True}
    assert embedding.parse_policy("min_len=abc") == {"roles": [], "min_len": 0, "skip_empty_figures": False} and embedding.parse_policy("")["roles"] == []


@pytest.mark.parametrize(("policy", "want"), [("roles=title|skip_empty_figures", {0}), ("roles=title", {0, 4}), ("min_len=20", {1, 3, 5}), ("roles=figure,table|skip_empty_figures", {4, 5}), ("", {0, 1, 2, 3, 4, 5})])
def test_selection(spark, policy, want):
    assert {r.ord for r in embedding.select_chunks(files.demo_chunks(spark), policy).collect()} == want


def test_embedding_with_a_cache(spark):
    chunks = files.demo_chunks(spark)
    vectors, fresh = embedding.embed_chunks(chunks, "min_len=1", embedding.HashEncoder(16))
    rows = {r.chunk_id: r for r in vectors.collect()}
    assert len(rows) == 6 and fresh.count() == 6 and abs(sum(x * x for x in rows["c1"].vector) - 1) < 1e-6
    assert rows["c5"].embedding_text.startswith("passage: Table caption: Masses") and rows["c0"].prev_id is None and rows["c0"].next_id == "c1" and rows["c0"].truncation == "head(512)"
    cached = spark.createDataFrame(fresh.collect(), fresh.schema)
    again, missing = embedding.embed_chunks(chunks, "min_len=1", embedding.HashEncoder(16), cache=cached)
    assert missing.count() == 0 and {r.chunk_id: r.vector for r in again.collect()} == {c: r.vector for c, r in rows.items()}
    assert embedding.embed_chunks(chunks, "min_len=1", embedding.HashEncoder(16), cache=cached, normalize=False)[1].count() == 6
    short = embedding.embed_chunks(chunks, "min_len=1", most=3, strategy="tail")[0].where("chunk_id = 'c1'").first()
    assert short.embedding_text == "together and checked." and short.truncation == "tail(3)"


def test_figures_are_described(spark):
    described = embedding.with_descriptions(files.demo_chunks(spark), lambda path: F.when(path != "", F.concat(F.lit("seen "), path)))
    rows = {r.chunk_id: r.t for r in described.select("chunk_id", embedding.rich_text(told=F.col("told")).alias("t")).collect()}
    assert rows["c4"] == "Figure caption: The parts in order\nVisual summary: seen figures/parts.png"


@pytest.mark.parametrize(("value", "message"), [("wide", "numbers"), ("nan", "not finite")])
def test_broken_encoders_are_errors(spark, value, message):
    class Broken:
        name, dimension = "broken", 4

        def encode(self, texts):
            return [[1.0] * 5 if value == "wide" else [float("nan")] * 4 for _ in texts]

    with pytest.raises(Exception, match=message):
        files.demo_chunks(spark).select(embedding.embed(F.col("text"), Broken()).alias("v")).collect()


def test_half_precision(spark):
    rows = files.demo_chunks(spark).select(embedding.embed(F.col("text"), embedding.HashEncoder(8), half=True).alias("v")).collect()
    import numpy as np

    assert all(np.array_equal(np.float16(r.v).astype(np.float32), np.float32(r.v)) for r in rows)


def test_json_lines(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    rows = [{"doc_id": "d", "file_name": "d.pdf", "source_path": "/d.pdf", "element_index": 4, "meta": {"layout_size": {"w": 1, "h": 2}, "is_toc": True}}, {"doc_id": "d", "file_name": "d.pdf", "source_path": "/d.pdf", "text": None, "type": "Title"}]
    path.write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    first, second = files.read_elements(spark, str(path)).orderBy(F.desc("ord")).collect()
    assert first.element_index == 4 and first.layout.h == 2 and first.is_toc and first.type == "Unknown" and second.element_index == -1 and second.text == ""
    path.write_text(json.dumps({"doc_id": "d"}) + "\n")
    with pytest.raises(Exception, match="no file_name"):
        files.read_elements(spark, str(path)).collect()
    path.write_text('{"a": 1}\nbroken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(path), "a int").collect()
    assert files.read_jsonl(spark, str(path), "a int", strict=False).where("_corrupt_record is not null").cache().count() == 1


def elements(spark):
    rows = [(f"d{d}", f"d{d}.pdf", f"/d{d}.pdf", o, o, 8, "Title" if o == 0 else "NarrativeText", f"document {d} says thing number {o} at length", "", "", None, None, None, False) for d in range(3) for o in range(4)]
    return spark.createDataFrame(rows, schemas.ELEMENT)


def test_chunks_survive_their_file(spark, tmp_path):
    chunks, _ = chunking.run_chunking(elements(spark))
    files.write_jsonl(chunks, str(tmp_path / "c"))
    back = files.read_chunks(spark, str(tmp_path / "c")).select(chunks.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, chunks.collect()))


def test_streams(spark, tmp_path):
    files.write_jsonl(elements(spark).where("doc_id = 'd0'").coalesce(1), str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream.chunk_stream(stream.read_elements(spark, str(tmp_path / "in")), out, state, once=True).awaitTermination()
    elements(spark).where("doc_id <> 'd0'").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream.chunk_stream(stream.read_elements(spark, str(tmp_path / "in")), out, state, once=True).awaitTermination()
    want = chunking.run_chunking(elements(spark))[0]
    got = spark.read.parquet(out)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted((r.doc_id, r.text) for r in want.collect()) and got.select("batch").distinct().count() == 2
    clean = stream.normalized(stream.read_elements(spark, str(tmp_path / "in"))).withColumn("at", F.current_timestamp())
    query = stream.first_of_hash(clean, time="at").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "state2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("firsts").count() == 12


def test_command_line(spark, tmp_path, capsys):
    site = tmp_path / "site"
    site.mkdir()
    for n in range(3):
        (site / f"{n}.html").write_text(f"<h1>Page number {n} has a title</h1><p>This is the text of page number {n}, long enough to be kept.</p><p>Same on all pages, word for word and letter.</p>")
    run = lambda *a: cli.main([str(x) for x in a])
    assert run("parse", "--input", site, "--output", tmp_path / "e") == 0
    assert run("chunk", "--input", tmp_path / "e", "--output", tmp_path / "c", "--strict-toc") == 0
    assert run("check", "--input", tmp_path / "c/chunks") == 0 and "OK" in capsys.readouterr().out
    assert run("dedup", "--input", tmp_path / "c/chunks", "--output", tmp_path / "u") == 0
    assert run("compare", "--input", tmp_path / "c/chunks", "--other", tmp_path / "c/chunks") == 0
    assert run("embed", "--input", tmp_path / "u", "--output", tmp_path / "v", "--l2-normalize") == 0
    ids = [r.chunk_id for r in spark.read.parquet(str(tmp_path / "v")).collect()]
    (tmp_path / "q.jsonl").write_text(json.dumps({"question": "page number 1", "ground_truth_context": ids[:1]}))
    one = tmp_path / "one"
    spark.read.parquet(str(tmp_path / "v")).dropDuplicates(["chunk_id"]).withColumns({"prev_id": F.lit(None).cast("string"), "next_id": F.lit(None).cast("string")}).write.parquet(str(one))
    assert run("evaluate", "--store", one, "--questions", tmp_path / "q.jsonl", "--output", tmp_path / "r.json") == 0
    assert json.loads((tmp_path / "r.json").read_text())["aggregate_metrics"]["total_questions"] == 1
    assert run("quality", "--input", tmp_path / "e", "--output", tmp_path / "m") == 0
    assert "<table>" in files.quality_page(spark.read.json(str(tmp_path / "m/metrics")))


def batches_of(monkeypatch, run):
    """The batches that ``run``'s function for tasks makes of one batch of 1,200 files."""
    import pyarrow as pa

    made = []
    monkeypatch.setattr(parsing, "in_arrow", lambda frame, function, schema: made.append(function) or frame.sparkSession.createDataFrame([], schema))
    run()
    files = pa.RecordBatch.from_pylist([{"path": f"/x/{n}.a", "content": b"x" * (2 << 20 if n == 7 else 100)} for n in range(1200)])
    return list(made[0](iter([files])))


def test_parsed_files_come_out_in_parts(spark, monkeypatch):
    files = spark.createDataFrame([], "path string, content binary")
    found = batches_of(monkeypatch, lambda: parsing.parse_files(files, lambda path, content, strategy: [{"type": "Text", "text": f"{len(content)}"}] * 2))
    assert sum(b.num_rows for b in found) == 2400 and max(b.num_rows for b in found) <= 512
    assert [r["text"] for b in found for r in b.to_pylist()][13:17] == ["100", str(2 << 20), str(2 << 20), "100"]


def test_extracted_tables_come_out_in_parts(spark, monkeypatch):
    files = spark.createDataFrame([], "path string, content binary")
    found = batches_of(monkeypatch, lambda: parsing.extract_tables(files, lambda path, content, flavor: [f"{len(content)}"]))
    assert sum(b.num_rows for b in found) == 1200 and max(b.num_rows for b in found) <= 256


def test_slices():
    import pyarrow as pa

    from foliospark.functions import frames

    batch = pa.RecordBatch.from_pylist([{"t": "x" * n} for n in [10] * 1000 + [3 << 20, 5, 5]])
    parts = list(frames.slices(batch, 256, 1 << 20))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and max(p.num_rows for p in parts) <= 256
    assert all(p.num_rows == 1 or p.nbytes <= 1 << 20 for p in parts) and not list(frames.slices(batch.slice(0, 0)))
