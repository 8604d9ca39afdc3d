"""Checks, exact duplicates, ranks and links, determinism and parser quality."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.functions import geometry, text
from foliospark.functions.frames import in_arrow

REQUIRED = ("chunk_id", "doc_id", "source_file", "page_start", "role", "text", "order_rank")



def invalid_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, rule, ord, chunk_id, detail) like ``violations``, rule ``json``, for every line that is no JSON; blank lines pass."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("detail"))
    bad = lines.where(F.expr("trim(value) <> '' AND try_parse_json(value) IS NULL"))
    none = F.lit(None).cast("string")
    return bad.select(none.alias("doc_id"), F.lit("json").alias("rule"), F.lit(None).cast("int").alias("ord"), none.alias("chunk_id"), "detail")


def shared_area(x1, y1, x2, y2) -> float:
    """Area that pairs of boxes share, summed over all pairs; boxes are swept by y, a few hundred at a time."""
    import numpy as np

    order = np.argsort(y1, kind="stable")
    x1, y1, x2, y2 = (np.asarray(v, float)[order] for v in (x1, y1, x2, y2))
    total = 0.0
    for at in range(0, len(y1), 256):
        end = min(at + 256, len(y1))
        beyond = int(np.searchsorted(y1, y2[at:end].max(), "left"))  # later boxes begin below all of these
        wide = np.minimum(x2[at:end, None], x2[None, at:beyond]) - np.maximum(x1[at:end, None], x1[None, at:beyond])
        high = np.minimum(y2[at:end, None], y2[None, at:beyond]) - np.maximum(y1[at:end, None], y1[None, at:beyond])
        both = np.maximum(wide, 0) * np.maximum(high, 0)
        both[np.arange(beyond - at)[None, :] <= np.arange(end - at)[:, None]] = 0  # each pair once
        total += float(both.sum())
    return total


def violations(chunks: DataFrame) -> DataFrame:
    """(doc_id, rule, ord, chunk_id, detail), a row for every broken rule of every chunk.

    Rules: missing (a required value is null), duplicate (an id used before in the document), bbox (outside 0..1 or its
    corners out of order), coord_system, order (rank falls within a run of one page, in the order of ``ord``), blank (no
    text but not a figure), role (none of the known).
    """
    doc = Window.partitionBy("doc_id").orderBy("ord")
    b = F.col("bbox")
    outside = F.lit(False)
    for k in ("x1", "y1", "x2", "y2"):
        outside = outside | b[k].isNull() | (b[k] < 0) | (b[k] > 1)
    rules: list[tuple[str, Column, Column]] = [
        (f"missing_{c}", F.col(c).isNull(), F.lit(c)) for c in REQUIRED if c in chunks.columns
    ] + [
        ("duplicate", F.col("__n") > 1, F.col("chunk_id")),
        ("bbox", b.isNotNull() & (outside | (b["x2"] < b["x1"]) | (b["y2"] < b["y1"])), F.lit("bbox")),
        ("coord_system", F.coalesce("coord_system", F.lit("")) != "top-left", F.coalesce("coord_system", F.lit(""))),
        ("order", (F.col("__page") == F.col("page_start")) & (F.col("order_rank") < F.col("__rank")), F.concat_ws("<", F.col("order_rank").cast("string"), F.col("__rank").cast("string"))),
        ("blank", (F.col("role") != "figure") & (text.strip(text.empty_if_null(F.col("text"))) == ""), F.lit("text")),
        ("role", ~F.col("role").isin(*schemas.ROLES), F.col("role")),
    ]
    seen = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy("ord"))
    marked = chunks.withColumn("__n", seen).withColumn("__page", F.lag("page_start").over(doc)).withColumn("__rank", F.lag("order_rank").over(doc))
    found = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for rule, broken, detail in rules]))
    return marked.select("doc_id", "ord", "chunk_id", F.explode(found).alias("v")).select("doc_id", "v.rule", "ord", "chunk_id", "v.detail")


def first_violation(chunks: DataFrame) -> DataFrame:
    """The first broken rule of each document."""
    return violations(chunks).groupBy("doc_id").agg(F.min_by(F.struct("rule", "ord", "chunk_id", "detail"), F.struct("ord", "rule")).alias("v")).select("doc_id", "v.*")


def unique_chunks(chunks: DataFrame, order: tuple[str, ...] = ("doc_id", "ord"), keys: tuple[str, ...] = ()) -> DataFrame:
    """The first chunk of each content hash, by ``order``.

    Chunks without a hash all stay. Figures with a hash but neither text nor image go first, and their hash counts for
    nothing. ``keys`` narrow the search for equals, to the document for example. A hash that many chunks share is reduced
    to one row a task before the shuffle.
    """
    hashed = F.coalesce("content_sha256", F.lit("")) != ""
    empty = (F.col("role") == "figure") & (text.strip(text.empty_if_null(F.col("text"))) == "") & (text.strip(text.empty_if_null(F.col("image_path"))) == "")
    left = chunks.where(~(hashed & empty))
    first = left.where(hashed).groupBy(*keys, "content_sha256").agg(F.min(F.struct(*order)).alias("__first"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"f.{k}")) for k in (*keys, "content_sha256")] + [F.struct(*[F.col(f"l.{c}") for c in order]).eqNullSafe(F.col("f.__first"))]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    kept = left.where(hashed).alias("l").join(first.alias("f"), condition, "left_semi")
    return kept.unionByName(left.where(~hashed))


def duplicate_stats(chunks: DataFrame, unique: DataFrame) -> DataFrame:
    """(original, unique, removed, rate); the rate of an empty table is 0."""
    n = chunks.agg(F.count("*").alias("original")).withColumn("k", F.lit(1))
    u = unique.agg(F.count("*").alias("unique")).withColumn("k", F.lit(1))
    removed = F.col("original") - F.col("unique")
    return n.join(u, "k").select("original", "unique", removed.alias("removed"), F.when(F.col("original") > 0, removed / F.col("original")).otherwise(0.0).alias("rate"))


def relink(chunks: DataFrame, *, by: str = "doc_id") -> DataFrame:
    """New order_rank (0..), prev_id and next_id in the order of ``ord``, within each document."""
    doc = Window.partitionBy(by).orderBy("ord")
    return (
        chunks.withColumn("order_rank", F.row_number().over(doc) - 1).withColumn("prev_id", F.lag("chunk_id").over(doc)).withColumn("next_id", F.lead("chunk_id").over(doc))
    )


DETERMINISTIC = (
    "doc_id", "chunk_id", "page_start", "page_end", "role", "text", "html", "bbox", "source_element_ids", "order_rank", "section_path", "section_level", "section_index", "content_sha256",
)


def row_hashes(chunks: DataFrame, columns: tuple[str, ...] = DETERMINISTIC) -> DataFrame:
    """(doc_id, ord, row_sha256) over the columns that two runs must agree in."""
    there = sorted(c for c in columns if c in chunks.columns)
    return chunks.select("doc_id", "ord", F.sha2(F.to_json(F.struct(*there), {"ignoreNullFields": "false"}).cast("binary"), 256).alias("row_sha256"))


def differences(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows of either run that the other lacks; none for a deterministic pipeline."""
    a, b = row_hashes(one), row_hashes(two)
    return a.exceptAll(b).withColumn("run", F.lit(1)).unionByName(b.exceptAll(a).withColumn("run", F.lit(2)))


#: The four 32-bit numbers of a row's hash that are added up.
LIMBS = ("h0", "h1", "h2", "h3")


def digests(chunks: DataFrame, by: tuple[str, ...] = ("doc_id",), columns: tuple[str, ...] = DETERMINISTIC) -> DataFrame:
    """(by, n, h0 .. h3): a digest of each group of rows that does not depend on their order.

    It adds up 128 bits of every row's hash, so repeated rows count, tasks combine their rows before the shuffle, and digests
    of parts add up to the digest of the whole (``merged``). Without ``by`` there is one digest of all rows.
    """
    there = sorted(c for c in columns if c in chunks.columns)
    hashed = chunks.select(*by, F.sha2(F.to_json(F.struct(*there), {"ignoreNullFields": "false"}).cast("binary"), 256).alias("h"))
    limbs = hashed.select(*by, F.lit(1).cast("long").alias("n"), *[F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)").alias(c) for k, c in enumerate(LIMBS)])
    return merged(limbs, by)


def merged(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Digests of larger groups from those of their parts; of no rows at all, zeros."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long" if c == "n" else "decimal(38,0)").alias(c)
    return parts.groupBy(*by).agg(zero("n"), *map(zero, LIMBS))


def changed(one: DataFrame, two: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(by, n_before, n_after, change) of the groups that differ between two runs: added, removed, rows or content.

    Only digests are shuffled and joined, a row a group; ``rows``: their number differs, ``content``: it is equal and they are not.
    """
    return compared(digests(one, by), digests(two, by), by)


def compared(one: DataFrame, two: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``changed`` from the ``digests`` of two runs.

    Two runs of one plan must not meet in one query, where Spark makes the rows of both from one exchange: write the first
    one's digests before the second begins.
    """
    a = one.withColumnsRenamed({c: f"{c}_a" for c in ("n", *LIMBS)})
    b = two.withColumnsRenamed({c: f"{c}_b" for c in ("n", *LIMBS)})
    # the keys as one struct, so that null groups meet
    a, b = (x.select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("key"), F.struct(*by).alias("k"), *[c for c in x.columns if c not in by]) for x in (a, b))
    same = F.lit(True)
    for c in LIMBS:
        same = same & (F.col(f"{c}_a") == F.col(f"{c}_b"))
    change = F.when(F.col("n_a").isNull(), "added").when(F.col("n_b").isNull(), "removed").when(F.col("n_a") != F.col("n_b"), "rows").when(~same, "content")
    joined = a.withColumnRenamed("k", "k_a").join(b.withColumnRenamed("k", "k_b"), "key", "full").withColumn("change", change).where(F.col("change").isNotNull())
    return joined.select(F.coalesce("k_a", "k_b").alias("k"), F.coalesce("n_a", F.lit(0)).alias("n_before"), F.coalesce("n_b", F.lit(0)).alias("n_after"), "change").select("k.*", "n_before", "n_after", "change")


def vocabulary_overlap(source: DataFrame, parsed: DataFrame, *, source_text: str = "text", parsed_text: str = "text") -> DataFrame:
    """(source_terms, parsed_terms, common_terms, recall, precision, f1) of two corpora's vocabularies: one row.

    Each side's words are marked by a bit and combined by word, first in the tasks; no document's words stand in one place.
    Both empty: 1, 1, 1. Source empty: 1, 0, 0. Parsed empty: 0, 1, 0.
    """
    sides = [
        frame.select(F.explode(text.ascii_tokens(F.col(column))).alias("term"), F.lit(bit).alias("side")) for frame, column, bit in ((source, source_text, 1), (parsed, parsed_text, 2))
    ]
    terms = sides[0].unionByName(sides[1]).groupBy("term").agg(F.bit_or("side").alias("side"))
    n = terms.agg(F.count_if(F.col("side").bitwiseAND(1) > 0).alias("source_terms"), F.count_if(F.col("side").bitwiseAND(2) > 0).alias("parsed_terms"), F.count_if(F.col("side") == 3).alias("common_terms"))
    a, b, both = F.col("source_terms"), F.col("parsed_terms"), F.col("common_terms").cast("double")
    recall = F.when(a == 0, 1.0).otherwise(both / F.greatest(a, F.lit(1)))
    precision = F.when((a == 0) & (b == 0), 1.0).when(a == 0, 0.0).when(b == 0, 1.0).otherwise(both / F.greatest(b, F.lit(1)))
    f1 = F.when((a == 0) & (b == 0), 1.0).when(both > 0, 2 * both / (a + b)).otherwise(0.0)
    return n.withColumns({"recall": recall, "precision": precision, "f1": f1})


def layout_metrics(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, n, in_bounds, coverage, overlap) of each page; a missing page number counts as page 1.

    in_bounds: share of elements with a proper box inside the page, within 2 units; coverage: area of boxes over the
    page's, at most 1; overlap: area that pairs of boxes share over the page's. A page's boxes are swept in one row of a
    task, so no pair becomes a row; a document without page numbers is one page.
    """
    zero = geometry.box(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    boxes = (
        elements.select("doc_id", F.coalesce("page_number", F.lit(1)).alias("page_number"), "ord", F.coalesce("coordinates", zero).alias("b"))
        .join(pages, ["doc_id", "page_number"], "left")
        .fillna(0.0, ["width", "height"])
    )
    proper = (F.col("b.x2") > F.col("b.x1")) & (F.col("b.y2") > F.col("b.y1"))
    fits = proper & geometry.inside(F.col("b"), F.col("width"), F.col("height"))
    single = boxes.groupBy("doc_id", "page_number").agg(
        F.count("*").alias("n"), F.avg(F.coalesce(fits, F.lit(False)).cast("double")).alias("in_bounds"), F.sum(geometry.area(F.col("b"))).alias("area"),
        F.max(F.col("width") * F.col("height")).alias("page_area"),
    )
    sides = [F.collect_list(F.when(proper, F.col(f"b.{k}"))).alias(k) for k in ("x1", "y1", "x2", "y2")]

    def sweep(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            areas = [shared_area(*(batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in range(2, 6))) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(areas, pa.float64())], names=["doc_id", "page_number", "shared"])

    pairs = boxes.groupBy("doc_id", "page_number").agg(*sides).transform(in_arrow, sweep, "doc_id string, page_number int, shared double")
    paged = F.col("page_area") > 0
    return single.join(pairs, ["doc_id", "page_number"], "left").select(
        "doc_id", "page_number", "n", "in_bounds", F.when(paged, F.least(F.lit(1.0), F.col("area") / F.col("page_area"))).otherwise(0.0).alias("coverage"),
        F.when(paged, F.coalesce("shared", F.lit(0.0)) / F.col("page_area")).otherwise(0.0).alias("overlap"),
    )


def type_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("doc_id", F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"))


def order_sanity(elements: DataFrame) -> DataFrame:
    """(doc_id, page_number, in_order): whether element_index never falls along the page."""
    page = Window.partitionBy("doc_id", "page_number").orderBy("ord")
    falls = F.col("element_index") < F.lag("element_index").over(page)
    return (
        elements.withColumn("page_number", F.coalesce("page_number", F.lit(1))).withColumn("falls", F.coalesce(falls, F.lit(False)))
        .groupBy("doc_id", "page_number").agg((~F.max("falls")).alias("in_order"))
    )
