"""What chunk assembly costs: generated code that the JVM compiles, and texts whose words are counted once."""

import re

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.operators import chunking
from foliospark.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_code_before_assembly_is_small_enough_to_be_compiled(spark):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = chunking.run_chunking(fx.elements(spark, SF))[0]._jdf.queryExecution().executedPlan()
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert len(sizes) > 10 and max(sizes) < 8000


def test_words_of_growing_text_are_counted_once(monkeypatch):
    read = []

    class Counted:
        def findall(self, s, token=chunking._TOKEN):
            read.append(len(s))
            return token.findall(s)

    block = {"page": 1, "page_width": 1.0, "page_height": 1.0, "picture": "", "role": "paragraph", "html": "", "bbox": None, "section": None}
    blocks = [block | {"text": f"number {i} of the paragraphs, as short as it is", "ids": [i]} for i in range(200)]
    want = [[c["text"], c["ids"]] for c in chunking.assemble(blocks, tokens=lambda t: chunking.estimated_tokens(t))]
    monkeypatch.setattr(chunking, "_TOKEN", Counted())
    assert [[c["text"], c["ids"]] for c in chunking.assemble(blocks)] == want and len(want) > 2
    assert sum(read) < 3 * sum(len(b["text"]) for b in blocks)


@pytest.mark.parametrize("blank", sorted(text.BLANKS) + ["  ", " \n", "  ", "\x1c", "​", "x"])
def test_blanks_are_those_of_the_patterns(spark, blank):
    texts = [blank, f"{blank}a b", f"a b{blank}", f"a{blank}b", f"{blank}é{blank}b{blank}", "", " a", "a ", None]
    t = F.col("t")
    body = F.coalesce(t, F.lit(""))
    edges = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    whole = F.regexp_replace(F.regexp_replace(body, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    words = F.size(F.filter(F.split(body, r"(?U)\s+"), lambda w: w != ""))
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(
        edges.alias("a"), text.strip(t).alias("b"), whole.alias("c"), text.collapse(t).alias("d"), words.alias("e"), text.count_words(t).alias("f")
    )
    for r in rows.collect():
        assert r.a == r.b and r.c == r.d and r.e == r.f


def test_determinism_makes_two_runs(spark, monkeypatch):
    """Elements that differ from run to run are found, so the second run is not the first one read again."""
    from foliospark.plans import catalog

    def varied(batches):
        import uuid

        import pyarrow as pa

        for batch in batches:
            texts = pa.array([f"{t} {uuid.uuid4()}" for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if f.name == "text" else batch.column(f.name) for f in batch.schema], schema=batch.schema)

    made = fx.elements
    monkeypatch.setattr(fx, "elements", lambda s, d: (e := made(s, d)).mapInArrow(varied, e.schema))
    assert catalog.QUERIES["determinism"](spark, SF).first().different > 0
