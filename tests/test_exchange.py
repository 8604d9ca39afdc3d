"""The queries of files, seams and assembly against their SQL over small awkward tables: nulls, empty texts, repeats, extra columns, no rows."""

import duckdb
import pytest

from foliospark.plans import catalog

NAMES = ["parse_strategies", "table_flavors", "elements_scan", "chunks_scan", "json_lines", "vector_sink", "rich_texts", "chunk_texts", "manifest_counts"]

LONG = "\n".join(f"{'1.' * (n // 17 % 4)}2 Heading {n}" if n % 17 == 0 else f"words of line {n} " + "and more of them " * (20 if n % 3 else 2) for n in range(400))
LOUD = "\n".join(["PART ONE", "text below the first part of all", "PART TWO", "1.2 Deeper", "1 Higher again", "", "a", "text at the very end, once more"] * 9)
TEXTS = ["", None, "one", "one\n\n\none", "   \n\t\n ", LONG, LOUD, LOUD, "é ü\n漢字 漢字\n", "1 A\n1.1 B\n1.1.1 C\n1.2 D\n2 E\nplain words that follow here"]
HTML = ["", None, "<p>", "no mark", "<p>é<p><p>" * 30, "x<p>y", "x<p>y"]


@pytest.fixture(scope="module")
def places(spark, tmp_path_factory):
    """Two folders of tables: awkward rows, and none."""
    out = []
    for name, n in (("awkward", 1), ("empty", 0)):
        path = tmp_path_factory.mktemp(name)
        docs = [(i, t, None if i % 3 == 0 else "en", "s", 0, "extra") for i, t in enumerate(TEXTS * 4)] * n
        pages = [(i, f"http://h/{i}", h, "extra") for i, h in enumerate(HTML * 6)] * n
        vectors = [(i, [float(i), -0.5], i % 2) for i in range(20)] * n
        for table, rows, kind in (
            ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long, role string"), ("pages", pages, "page_id long, url string, html string, path string"),
            ("embeddings", vectors, "vec_id long, embedding array<float>, label int"),
        ):
            spark.createDataFrame(rows, kind).coalesce(2).write.parquet(f"{path}/{table}.parquet")
        out.append(str(path))
    return out


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("which", [0, 1], ids=["awkward", "empty"])
def test_equals_sql(spark, places, name, which):
    place = places[which]
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{place}/{table}.parquet/*.parquet')")
    found = catalog.QUERIES[name](spark, place)
    names = sorted(found.columns)
    got = sorted(repr(tuple(r)) for r in found.select(*names).collect())
    wanted = sorted(repr(r) for r in db.sql(f"SELECT {', '.join(names)} FROM ({catalog.SQL[name]})").fetchall())
    assert got == wanted
    assert bool(got) == (which == 0)


def test_a_budget_that_stops_a_chunk_opens_one_without_a_section(spark, places):
    """The awkward tables reach the carry of words, which opens a chunk outside all sections, and sections of several depths."""
    rows = catalog.QUERIES["chunk_texts"](spark, places[0]).where("doc_id = '5'").orderBy("ord").collect()
    assert any(r["section_id"] == "" and r["ord"] for r in rows) and {r["section_level"] for r in rows} >= {0, 2, 3, 4}


def test_chunks_do_not_hang_on_which_page_of_a_line_at_the_limit_comes_first(spark, tmp_path):
    """A line at heights 0.22 and 0.12 is a running header in either order of its pages, one at 0.22 and 0.32 never is."""
    places = [(104, 142), (142, 164), (104, 126), (126, 164)]
    texts = ["\n".join("1 Scope ..... 3" if n < 100 else "a line of two pages" if n in at else "the only other line" if n == 145 else "" for n in range(170)) for at in places]
    spark.createDataFrame([(2 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in catalog.QUERIES["chunk_texts"](spark, str(tmp_path)).where("role = 'paragraph'").collect():
        found.setdefault(int(r.doc_id) // 2, set()).add(r.ids)
    assert found == {0: {"145"}, 1: {"145"}, 2: {"104", "126", "145"}, 3: {"126", "145", "164"}}
