"""JSON Lines, Parquet and report sinks and sources."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark import schemas


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, *, strict: bool = True) -> DataFrame:
    """Rows of JSON lines, blank lines skipped. ``strict``: a malformed line is an error; else it is a row with ``_corrupt_record``."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if schema is not None:
        full = T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(list(schema.fields))
        if not strict:
            full = T.StructType([*full.fields, T.StructField("_corrupt_record", T.StringType())])
        reader = reader.schema(full)
    return reader.json(path)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements with their defaults. doc_id, file_name and source_path are required: a row without one is an error in the plan."""
    raw = T.StructType.fromDDL(
        "element_index int, doc_id string, file_name string, source_path string, page_number int, type string, text string, html string, image_path string,"
        f" coordinates {schemas.BOX}, meta struct<is_toc:boolean,layout_size:struct<w:double,h:double>,bbox_norm_top_left:{schemas.BOX}>"
    )
    rows = read_jsonl(spark, path, raw)
    for name in ("doc_id", "file_name", "source_path"):
        rows = rows.withColumn(name, F.coalesce(name, F.raise_error(F.lit(f"an element has no {name}")).cast("string")))
    index = F.coalesce("element_index", F.lit(-1))
    return rows.select(
        "doc_id", "file_name", "source_path", index.alias("ord"), index.alias("element_index"), "page_number", F.coalesce("type", F.lit("Unknown")).alias("type"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("html", F.lit("")).alias("html"), F.coalesce("image_path", F.lit("")).alias("image_path"), "coordinates", F.col("meta.layout_size").alias("layout"), F.col("meta.bbox_norm_top_left").alias("given_box"),
        F.coalesce("meta.is_toc", F.lit(False)).alias("is_toc"),
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with ``ord``, their place in the document by page, rank and id; sorted by document and ``ord`` they are in order.

    A relative image path is taken as relative to the folder of the chunks' file.
    """
    from pyspark.sql import Window

    rows = read_jsonl(spark, path, schemas.CHUNK)
    folder = F.regexp_replace(F.input_file_name(), "/[^/]*$", "/")
    rows = rows.withColumn("image_path", F.when(F.col("image_path").rlike(r"^(?!/|[A-Za-z][A-Za-z0-9+.-]*:).+"), F.concat(folder, "image_path")).otherwise(F.col("image_path")))
    for name, value in (("text", ""), ("html", ""), ("image_path", ""), ("section_path", ""), ("content_sha256", ""), ("role", "paragraph")):
        rows = rows.withColumn(name, F.coalesce(name, F.lit(value)))
    for name in ("page_start", "order_rank"):
        rows = rows.withColumn(name, F.coalesce(name, F.lit(0)))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_start", "order_rank", "chunk_id")) - 1)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Replaces ``path`` by JSON lines; Spark's commit makes the files appear at the end or not at all. Nulls are written."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """The vector table; vectors as 32-bit floats."""
    vectors.write.mode("overwrite").parquet(path)


def evaluation_report(scored: DataFrame, totals: DataFrame, config: dict) -> str:
    """JSON of an evaluation: totals, configuration and every question (an evaluation set is small)."""
    rows = [r.asDict(recursive=True) for r in scored.orderBy("query_id").collect()]
    return json.dumps({"aggregate_metrics": totals.first().asDict(), "config": config, "results": rows}, ensure_ascii=False, indent=2, default=str)


def overlays(elements: DataFrame, pages: DataFrame) -> str:
    """An SVG for each page of one document, its elements' boxes drawn on the page's area with their types."""
    sizes = {r["page_number"]: (r["width"], r["height"]) for r in pages.collect()}
    found: dict = {}
    for r in elements.where("coordinates IS NOT NULL").select(F.coalesce("page_number", F.lit(1)).alias("page"), "ord", "type", "coordinates").orderBy("page", "ord").collect():
        b = r["coordinates"]
        found.setdefault(r["page"], []).append(
            f'<g><title>{html.escape(str(r["type"]))} {r["ord"]}</title><rect x="{b["x1"]:g}" y="{b["y1"]:g}" width="{b["x2"] - b["x1"]:g}" height="{b["y2"] - b["y1"]:g}"/></g>'
        )
    drawn = []
    for page, boxes in sorted(found.items()):
        width, height = sizes.get(page, (1.0, 1.0))
        drawn.append(f'<h2>Page {page}</h2><svg viewBox="0 0 {width:g} {height:g}" width="400" fill="none" stroke="navy" style="border:1px solid gray">{"".join(boxes)}</svg>')
    return "".join(drawn)


def quality_page(metrics: DataFrame, title: str = "Parser quality", elements: DataFrame | None = None, pages: DataFrame | None = None) -> str:
    """An HTML table of page metrics of one document, with its pages' boxes below if ``elements`` and ``pages`` are given."""
    names = metrics.columns
    cells = lambda values, tag: "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values)
    body = "".join(f"<tr>{cells(r, 'td')}</tr>" for r in metrics.collect())
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{cells(names, 'th')}</tr>{body}</table>" + (overlays(elements, pages) if elements is not None and pages is not None else "")


def demo_chunks(spark: SparkSession) -> DataFrame:
    """Six chunks of one document: title, paragraph, heading, paragraph, figure and table."""
    grid = "<table><thead><tr><th>Part</th><th>Mass</th></tr></thead><tbody><tr><td>Frame</td><td>4 kg</td></tr><tr><td>Lid</td><td>1 kg</td></tr></tbody></table>"
    rows = [
        ("title", "Assembly guide", "", ""), ("paragraph", "This guide tells how the case is put together and checked.", "", ""), ("h2", "Parts", "", ""),
        ("paragraph", "All parts are laid out before work begins.", "", ""), ("figure", "The parts in order", "", "figures/parts.png"), ("table", "Masses of the parts", grid, ""),
    ]
    from foliospark.functions import text

    frame = spark.createDataFrame([("demo", f"c{i}", i, r, t, h, p) for i, (r, t, h, p) in enumerate(rows)], "doc_id string, chunk_id string, ord int, role string, text string, html string, image_path string")
    full = frame.withColumns(
        {
            "page_start": F.lit(1), "order_rank": F.col("ord"), "section_id": F.lit("s0"), "section_path": F.lit("Assembly guide"), "content_sha256": text.content_hash(F.col("text"), F.col("html")),
            "prev_id": F.when(F.col("ord") > 0, F.concat(F.lit("c"), (F.col("ord") - 1).cast("string"))), "next_id": F.when(F.col("ord") < 5, F.concat(F.lit("c"), (F.col("ord") + 1).cast("string"))),
        }
    )
    return full
