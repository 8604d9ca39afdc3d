import pytest
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.operators import chunking, curation, layout


def element(ord_, text, page=1, kind="NarrativeText", y=None, x=0.0, h=20.0, doc="d", **more):
    box = None if y is None else {"x1": x, "y1": float(y), "x2": x + 100.0, "y2": float(y) + h}
    row = {"doc_id": doc, "file_name": f"{doc}.pdf", "source_path": f"/{doc}.pdf", "ord": ord_, "element_index": ord_, "page_number": page, "type": kind, "text": text, "html": "", "image_path": "", "coordinates": box, "layout": {"w": 1000.0, "h": 1000.0}, "given_box": None, "is_toc": False}
    return row | more


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.ELEMENT.fields) for r in rows], schemas.ELEMENT).repartition(3)


def flags(rows, name):
    return {r.ord for r in rows.collect() if r[name]}


def test_contents_pages(spark):
    entries = [element(i, t) for i, t in enumerate(["TABLE OF CONTENTS", "1 Scope ..... 3", "2 Terms .... 4", "no entry, since it goes on and says something at some length, well beyond what a heading would ever say, with commas and all the rest of it, so that nobody could take it for an entry of any list, " + "x" * 60])]
    big = element(10, "LIST OF FIGURES " + "word " * 120, page=2, kind="Table")
    late = element(11, "1 Scope ..... 3", page=9)
    explicit = element(12, "anything", page=9, is_toc=True)
    assert flags(layout.contents_flags(frame(spark, [*entries, big, late, explicit])), "contents") == {0, 1, 2, 10, 12}


def test_collapsed_line_is_made_once(spark):
    plan = layout.contents_flags(frame(spark, [element(0, "a")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?U)\\s+,  ") + plan.count("(?U)\\s+,  , 1") >= 1 and sum("(?U)\\s+,  " in line for line in plan.splitlines()) == 1


def test_a_task_gets_a_bounded_number_of_elements(spark, monkeypatch):
    monkeypatch.setattr(chunking, "ROWS_A_TASK", 20)
    rows = frame(spark, [element(0, "some text of a document", doc=f"d{i}") for i in range(400)])
    blocks, pages = chunking.blocks_of(rows)
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 20" in plan.split("RepartitionByExpression")[1].splitlines()[0]
    plain, stored = chunking.run_chunking(rows), chunking.run_chunking(rows, stored=True)
    assert sorted(map(str, plain[1].collect())) == sorted(map(str, stored[1].collect())) and plain[0].count() == stored[0].count() == 400


def test_two_word_headings_are_taken_unless_strict(spark):
    rows = [element(i, t) for i, t in enumerate(["alpha beta", "gamma delta", "eps zeta", "eta theta", "iota kappa"])]
    assert flags(layout.contents_flags(frame(spark, rows)), "contents") == {0, 1, 2, 3, 4}
    assert flags(layout.contents_flags(frame(spark, rows), strict=True), "contents") == set()


def test_documents_without_pages_pass(spark):
    assert flags(layout.contents_flags(frame(spark, [element(0, "TABLE OF CONTENTS", page=None), element(1, "x", page=None, is_toc=True)])), "contents") == set()


def test_headers_and_footers(spark):
    rows = []
    for p in range(1, 7):
        rows += [element(p * 10, "Running Title Of The Standard", page=p, y=500), element(p * 10 + 1, f"Page {p}", page=p, y=960), element(p * 10 + 2, f"body text of page {p} that says much", page=p, y=400)]
    rows += [
        element(101, "moves about", page=1, y=200), element(102, "moves about", page=2, y=500), element(103, "moves about", page=3, y=700), element(104, "ABC-STD-12.4", page=4, y=20), element(105, "short once", page=4, y=30),
        element(106, "see http://x.org for more of the same text here", page=5, y=970), element(107, "5 of 6", page=5, y=500), element(108, "", page=5, kind="Image", image_path="a.png"), element(109, " ", page=5), element(110, "no page", page=None),
    ]
    got = flags(layout.margin_flags(layout.with_boxes(frame(spark, rows))), "margin")
    assert got == {p * 10 + k for p in range(1, 7) for k in (0, 1)} | {104, 106, 107, 109}


def test_spread_at_the_limit_is_rounded_in_document_order(spark):
    """Heights of 0.22 and then 0.12 deviate by 0.05, which is not steady; 0.22, 0.22, 0.32, 0.32 by the float before it, which is."""
    rows = [element(k, "two lines apart", page=k + 1, y=y, h=40.0) for k, y in enumerate((200, 100))]
    rows += [element(k, "four lines in two heights", page=k + 1, y=y, h=40.0, doc="e") for k, y in enumerate((200, 200, 300, 300))]
    for parts in (1, 5):
        flagged = layout.margin_flags(layout.with_boxes(frame(spark, rows[::-1]).repartition(parts, "ord"))).collect()
        assert {r.doc_id: r.margin for r in flagged} == {"d": False, "e": True}


def test_blocks_take_the_spread_at_the_limit_in_no_order(spark):
    """Assembly's rows come by page: 0.22 and 0.12, which deviate by the float before 0.05, are dropped whichever comes first; 0.22 and 0.32 stay."""
    rows = [element(k, "two lines apart", page=k + 7, y=y, h=40.0, doc=doc) for doc, ys in {"a": (200, 100), "b": (100, 200), "c": (200, 300), "d": (300, 200)}.items() for k, y in enumerate(ys)]
    rows += [element(9, f"more of {doc}", page=9, y=500, doc=doc) for doc in "abcd"]
    blocks = chunking.blocks_of(frame(spark, rows[::-1]))[0].collect()
    assert {(r.doc_id, r.page) for r in blocks} == {(doc, page) for doc in "cd" for page in (7, 8)} | {(doc, 9) for doc in "abcd"}


def test_page_sizes(spark):
    rows = [element(0, "a", layout=None, y=50), element(1, "b", page=2, layout={"w": 5.0, "h": 6.0}), element(2, "c", page=2, layout={"w": 7.0, "h": 8.0}), element(3, "d", page=3, layout=None), element(4, "e", page=None)]
    assert {r.page_number: (r.width, r.height) for r in layout.page_sizes(frame(spark, rows)).collect()} == {1: (100.0, 70.0), 2: (7.0, 8.0)}


def test_merge_and_captions(spark):
    rows = [
        element(0, "left top", y=100, x=0.0), element(1, "right top", y=101, x=500.0), element(2, "left low", y=200, x=0.0), element(3, "Table 1", y=300, kind="FigureCaption"), element(4, "cells", y=250, kind="Table", html="<table>"),
        element(5, "after", y=400), element(6, "Figure 9", y=500, kind="FigureCaption"), element(7, "  ", y=600, kind="Title"), element(8, " ", y=620), element(9, "second page", page=2), element(10, "Figure 1 lone", page=2, kind="FigureCaption"),
    ]
    blocks = layout.merge_text(layout.with_boxes(frame(spark, rows)))
    got = [(r.page, r.role, r.text, list(r.element_ids)) for r in sorted(blocks.collect(), key=lambda r: r.ord)]
    assert got == [
        (1, "paragraph", "left top right top left low", [0, 1, 2]), (1, "table", "cells", [4]), (1, "caption", "Table 1", [3]), (1, "paragraph", "after", [5]), (1, "caption", "Figure 9", [6]), (1, "title", "  ", [7]),
        (2, "paragraph", "second page", [9]), (2, "caption", "Figure 1 lone", [10]),
    ]
    held = {r.role: r.text for r in layout.attach_captions(blocks).where("page = 1").collect() if r.role == "table"}
    assert held == {"table": "cells\nTable 1\nFigure 9"}
    assert layout.attach_captions(blocks).where("role = 'caption'").count() == 1


def block(role, text, page=1, ids=(1,), bbox=None):
    return {"page": page, "role": role, "text": text, "html": "", "ids": list(ids), "bbox": bbox, "picture": "", "page_width": 1.0, "page_height": 1.0}


def chunked(blocks, **options):
    joined = chunking.join_headings(blocks)
    return chunking.assemble([b | {"section": s} for b, s in zip(joined, chunking.sections(joined), strict=True)], **options)


def test_headings_and_sections():
    blocks = [block("title", "Guide"), block("paragraph", "1 Scope"), block("paragraph", "first text of the scope"), block("table", "t"), block("paragraph", "1.1 Detail"), block("figure", "f"), block("title", "Annex")]
    joined = chunking.join_headings(blocks)
    assert [b["text"] for b in joined] == ["Guide\n1 Scope", "first text of the scope", "t", "1.1 Detail", "f", "Annex"]
    found = [s and (s["id"], s["level"], s["path"], s["index"]) for s in chunking.sections(joined)]
    assert found[0] == ("s0", 1, "Guide", 1) and found[3] == ("s1", 2, "Guide > 1.1 Detail", 1) and found[5] == ("s2", 1, "Annex", 2) and found[4] == found[3]


def test_numbered_heading_glued_to_a_long_paragraph_is_none():
    joined = chunking.join_headings([block("h2", "1 Scope"), block("paragraph", "word " * 30)])
    assert len(joined) == 1 and chunking.sections(joined) == [None]


def test_assembly():
    long = "word " * 60
    blocks = [block("paragraph", "tiny"), block("paragraph", "fifteen chars!!"), block("table", "x", ids=(7,)), block("title", "Heading"), block("caption", "a caption here"), block("paragraph", long, ids=(2,)), block("paragraph", long, ids=(3,)), block("paragraph", long, page=2)]
    found = chunked(blocks, max_tokens=170, overlap=5)
    assert [(c["role"], c["page"]) for c in found] == [("paragraph", 1), ("table", 1), ("paragraph", 1), ("paragraph", 2)]
    assert found[0]["text"] == "fifteen chars!!" and found[2]["text"].startswith("Heading\na caption here\n") and found[2]["ids"] == [1, 1, 2, 3]
    assert found[2]["section_path"] == "Heading"


def test_overlap_within_a_section_is_a_chunk_without_one():
    blocks = [block("title", "Heading"), *[block("paragraph", f"p{i} " + "word " * 50) for i in range(3)]]
    blocks.insert(1, block("figure", "f"))  # so that the heading keeps to itself
    found = chunked(blocks, max_tokens=80, overlap=4)
    assert [c["section_id"] for c in found] == ["s0", "s0", "s0", "", "s0", "", "s0"]
    assert found[3]["text"] == "word word word word" and [c["section_index"] for c in found] == [1, 2, 3, 0, 4, 0, 5]


def test_regions_without_sections_come_to_an_end():
    found = chunked([block("paragraph", "word " * 400), block("paragraph", "word " * 400)], max_tokens=100, overlap=120)
    assert len(found) == 3 and len(found[1]["text"].split()) == 120
    assert len(chunked([block("paragraph", "word " * 5000)], max_tokens=100)) == 1  # one long paragraph is not split


def test_run_chunking(spark):
    rows = [r | {"page_number": 7} for r in (element(0, "GENERAL GUIDE", kind="Title", y=150), element(1, "The first paragraph says enough to be kept.", y=200), element(2, "", kind="Image", y=300, image_path="p.png"), element(3, "Figure 1", kind="FigureCaption", y=340))]  # past the pages where contents are looked for
    rows += [r | {"doc_id": "e", "file_name": "e.pdf"} for r in rows]
    chunks, manifest = chunking.run_chunking(frame(spark, rows))
    assert [f.name for f in chunks.schema] == [f.name for f in schemas.CHUNK]
    got = [(r.chunk_id, r.role, r.text, r.image_path, r.prev_id, r.next_id, r.order_rank, r.source_file) for r in chunks.where("doc_id = 'd'").orderBy("ord").collect()]
    assert got == [("c0", "paragraph", "GENERAL GUIDE\nThe first paragraph says enough to be kept.", "", None, "c1", 0, "d.pdf"), ("c1", "figure", "Figure 1", "p.png", "c0", None, 1, "d.pdf")]
    counts = {r.doc_id: dict(r.counts) for r in manifest.collect()}
    assert counts["e"] == {"blocks_title": 1, "blocks_paragraph": 1, "blocks_figure": 1, "chunks_paragraph": 1, "chunks_figure": 1}
    assert curation.violations(chunks).count() == 0


def test_each_rule_is_reported(spark):
    good = {"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0}
    fields = "doc_id string, chunk_id string, ord int, source_file string, page_start int, role string, text string, bbox struct<x1:double,y1:double,x2:double,y2:double>, coord_system string, order_rank int"
    rows = [
        ("d", "c0", 0, "f", 1, "title", "x", good, "top-left", 0), ("d", "c0", 1, "f", 1, "title", "x", good, "top-left", 1), ("d", "c2", 2, "f", 1, "title", "x", good | {"x2": 1.1}, "top-left", 2),
        ("d", "c3", 3, "f", 1, "title", "x", good | {"x1": 0.9, "x2": 0.1}, "top-left", 3), ("d", "c4", 4, "f", 1, "title", "x", good, "bottom-left", 4), ("d", "c5", 5, "f", 1, "title", "x", good, "top-left", 3),
        ("d", "c6", 6, "f", 2, "title", " ", good, "top-left", 0), ("d", "c7", 7, "f", 2, "figure", "", good, "top-left", 1), ("d", "c8", 8, "f", 2, "other", "x", None, "top-left", 2), ("d", "c9", 9, "f", 2, "chapter", "x", good, "top-left", 3),
        ("d", "c10", 10, None, 2, "title", "x", good, "top-left", 4),
    ]
    found = sorted((r.ord, r.rule) for r in curation.violations(spark.createDataFrame(rows, fields)).collect())
    assert found == [(1, "duplicate"), (2, "bbox"), (3, "bbox"), (4, "coord_system"), (5, "order"), (6, "blank"), (9, "role"), (10, "missing_source_file")]
    assert curation.first_violation(spark.createDataFrame(rows, fields)).first().rule == "duplicate"


def test_exact_duplicates(spark):
    rows = [("d", 0, "h1", "paragraph", "a", ""), ("d", 1, "h1", "paragraph", "a", ""), ("d", 2, "", "paragraph", "a", ""), ("d", 3, None, "paragraph", "a", ""), ("d", 4, "h2", "figure", "", ""), ("d", 5, "h2", "paragraph", "b", ""), ("d", 6, "h3", "figure", " ", "p.png"), ("d", 7, "", "figure", "", "")]
    chunks = spark.createDataFrame(rows, "doc_id string, ord int, content_sha256 string, role string, text string, image_path string")
    unique = curation.unique_chunks(chunks)
    assert sorted(r.ord for r in unique.collect()) == [0, 2, 3, 5, 6, 7]
    assert tuple(curation.duplicate_stats(chunks, unique).first()) == (8, 6, 2, 0.25)
    assert curation.duplicate_stats(chunks.limit(0), unique.limit(0)).first().rate == 0
    linked = curation.relink(unique.withColumn("chunk_id", F.concat(F.lit("c"), F.col("ord").cast("string"))))
    assert [(r.order_rank, r.prev_id, r.next_id) for r in linked.orderBy("ord").collect()][:2] == [(0, None, "c2"), (1, "c0", "c3")]


@pytest.mark.parametrize("changed", [False, True])
def test_differences(spark, changed):
    one = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b")], "doc_id string, ord int, text string")
    two = one.withColumn("text", F.when(F.col("ord") == 1, "c").otherwise(F.col("text"))) if changed else one
    assert curation.differences(one, two).count() == (2 if changed else 0)
