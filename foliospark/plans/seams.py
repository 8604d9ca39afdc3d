"""Queries of the sources, sinks and seams: what goes through files or through a given Python function, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import storage
from foliospark.functions.frames import table
from foliospark.operators import curation, embedding
from foliospark.plans import catalog
from foliospark.plans import fixtures as fx
from foliospark.sources import files, parsing


def _number(path: str) -> int:
    return int(path.rsplit("/", 1)[-1].split(".")[0])


def parse_pieces(path: str, content: bytes | None, strategy: str) -> list[dict]:
    """A parser that takes every paragraph mark for an element; it fails for some pages at first and for some altogether."""
    n = _number(path)
    if n % 10 == 7 or (strategy == "hi_res" and n % 3 == 0):
        raise ValueError(f"{strategy} {n}")
    pieces = (content or b"").decode().split("<p>")
    kinds = {4: "Table", 3: "Image"}
    return [{"type": kinds.get(k % 5, "NarrativeText"), "text": p, "page_number": k // 10 + 1} for k, p in enumerate(pieces)]


def extract_pieces(path: str, content: bytes | None, flavor: str) -> list[str]:
    """A table extractor whose first flavor fails for some pages and finds nothing in others."""
    n, body = _number(path), (content or b"").decode()
    if flavor == "lattice":
        if n % 4 == 1:
            raise ValueError(flavor)
        return [f"| {len(body)} |"] if n % 4 == 3 else []
    return [] if n % 7 == 0 else [f"| {flavor} |", f"| {body} |"]


def tell(path: str) -> str | None:
    """A describer that fails for some figures and has nothing to say about others."""
    n = _number(path)
    if n % 3 == 0:
        raise ValueError(path)
    return None if n % 5 == 0 else f" figure {path} "


def _pages(spark, sf_dir):
    """The pages' markup as files, named by their ids."""
    path = F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return table(spark, sf_dir, "pages").select(path.alias("path"), F.col("html").cast("binary").alias("content"))


_PAGES = "p AS (SELECT page_id, '/pages/' || page_id || '.html' AS source_path, coalesce(html, '') AS html FROM pages)"


@catalog.query(f"""WITH {_PAGES}, n AS (SELECT source_path, page_id, page_id % 10 <> 7 AS success, len(string_split(html, '<p>')) AS n FROM p)
SELECT source_path, CASE WHEN success THEN n ELSE 0 END AS elements, CASE WHEN success THEN (n + 9) // 10 ELSE 0 END AS pages, CASE WHEN success THEN n // 5 ELSE 0 END AS tables, CASE WHEN success THEN (n + 1) // 5 ELSE 0 END AS images,
 CASE WHEN success THEN CASE WHEN page_id % 3 = 0 THEN 'fast' ELSE 'hi_res' END END AS strategy, CASE WHEN NOT success THEN 'ValueError: fast ' || page_id END AS error, success FROM n""")
def parse_strategies(spark, sf_dir):
    """Every page parsed by the first strategy that does not fail, with its statistics."""
    return parsing.file_stats(parsing.parse_files(_pages(spark, sf_dir), parse_pieces))


@catalog.query(f"""WITH {_PAGES}, f AS (SELECT *, CASE WHEN page_id % 4 = 3 THEN ['| ' || length(html) || ' |'] WHEN page_id % 7 <> 0 THEN ['| stream |', '| ' || html || ' |'] ELSE [] END AS t FROM p)
SELECT source_path, k AS number, -1 AS element_index, md5(t[k]) AS text_md5, page_id || '_table_' || k || '.md' AS markdown_path, CASE WHEN page_id % 4 = 3 THEN 'lattice' ELSE 'stream' END AS strategy
FROM (SELECT *, unnest(range(1, len(t) + 1))::INT AS k FROM f)""")
def table_flavors(spark, sf_dir):
    """Tables of every page by the first flavor that finds any."""
    found = parsing.extract_tables(_pages(spark, sf_dir), extract_pieces)
    number = F.regexp_extract("markdown_path", r"_(\d+)\.md$", 1).cast("int")
    return found.select("source_path", number.alias("number"), "element_index", F.md5(F.col("text").cast("binary")).alias("text_md5"), "markdown_path", "strategy")


@catalog.query(f"""WITH {fx.ELEMENTS} SELECT doc_id, CASE WHEN ord % 9 = 8 THEN -1 ELSE ord END AS ord, page_number::INT AS page_number, CASE WHEN ord % 7 = 6 THEN 'Unknown' ELSE type END AS type, md5(CASE WHEN ord % 8 = 7 THEN '' ELSE text END) AS text_md5, image_path,
 x2, CASE WHEN ord % 5 <> 4 THEN lw END AS width, CASE WHEN ord % 5 <> 4 AND given THEN 0.3::DOUBLE END AS given_x2, ord % 5 <> 4 AND is_toc AS is_toc FROM elements""")
def elements_scan(spark, sf_dir):
    """Elements written as a parser's JSON lines, some values missing, and scanned again with their defaults."""
    o, path = F.col("ord"), storage.scratch(spark, "elements")
    meta = F.struct("is_toc", F.col("layout").alias("layout_size"), F.col("given_box").alias("bbox_norm_top_left"))
    rows = fx.elements(spark, sf_dir).select(
        "doc_id", "file_name", "source_path", F.when(o % 9 != 8, o).alias("element_index"), "page_number", F.when(o % 7 != 6, F.col("type")).alias("type"), F.when(o % 8 != 7, F.col("text")).alias("text"), "html",
        F.when(F.col("image_path") != "", F.col("image_path")).alias("image_path"), "coordinates", F.when(o % 5 != 4, meta).alias("meta"),
    )
    files.write_jsonl(rows, path)
    return files.read_elements(spark, path).select(
        "doc_id", "ord", "page_number", "type", F.md5(F.col("text").cast("binary")).alias("text_md5"), "image_path", F.col("coordinates.x2").alias("x2"), F.col("layout.w").alias("width"),
        F.col("given_box.x2").alias("given_x2"), "is_toc",
    )


@catalog.query(f"""WITH {fx.CHUNKS} SELECT doc_id, chunk_id, order_rank::INT AS order_rank, (row_number() OVER (PARTITION BY doc_id ORDER BY page_start, order_rank, chunk_id) - 1)::INT AS ord, role, md5(text) AS text_md5, image_path <> '' AS has_image FROM chunks""")
def chunks_scan(spark, sf_dir):
    """Chunks written as JSON lines and scanned again: in order by page, rank and id, pictures beside the file."""
    path = storage.scratch(spark, "chunks")
    files.write_jsonl(fx.chunks(spark, sf_dir).drop("ord"), path)
    rows = files.read_chunks(spark, path)
    return rows.select("doc_id", "chunk_id", "order_rank", "ord", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("image_path").endswith("/img.png").alias("has_image"))


@catalog.query("SELECT CASE doc_id % 7 WHEN 3 THEN 'invalid' ELSE 'valid' END AS kind, count(*) AS n FROM documents WHERE doc_id % 7 <> 5 GROUP BY 1")
def json_lines(spark, sf_dir):
    """Documents as JSON lines of which some are cut short and some blank: lines that are no JSON, and lines with a document."""
    path, kind = storage.scratch(spark, "lines"), F.col("doc_id") % 7
    whole = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "text")).alias("line"))
    whole.select(F.when(kind == 3, F.expr("left(line, length(line) - 1)")).when(kind == 5, "  ").otherwise(F.col("line")).alias("value")).write.text(path)
    bad = curation.invalid_lines(spark, path).select(F.lit("invalid").alias("kind"))
    good = files.read_jsonl(spark, path, "doc_id long, text string", strict=False).where("_corrupt_record IS NULL AND doc_id IS NOT NULL").select(F.lit("valid").alias("kind"))
    return bad.unionByName(good).groupBy("kind").agg(F.count("*").alias("n"))


@catalog.query("SELECT vec_id, len(embedding)::INT AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[-1]::DOUBLE, 6) AS last FROM embeddings")
def vector_sink(spark, sf_dir):
    """The vector table written and scanned again."""
    path = storage.scratch(spark, "store")
    files.write_vectors(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")), path)
    v = F.transform("vector", lambda x: x.cast("double"))
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return files.read_store(spark, path).select("vec_id", F.size("vector").alias("dim"), F.round(total, 5).alias("total"), F.round(v[0], 6).alias("first"), F.round(F.element_at(v, -1), 6).alias("last"))


_TEXT = fx.STRIP.format("text")


@catalog.query(f"""WITH {fx.CHUNKS}, f AS (SELECT *, role = 'figure' AND (ord % 3 = 0 OR ord % 5 = 0) AS told_failed, role = 'figure' AND ord % 3 <> 0 AND ord % 5 <> 0 AS told FROM chunks)
SELECT doc_id, ord, told_failed, md5(CASE role WHEN 'figure' THEN {fx.STRIP.format(f"'Figure caption: ' || {_TEXT} || CASE WHEN told THEN chr(10) || 'Visual summary: figure ' || doc_id || '/' || ord || '.png' ELSE '' END")}
 WHEN 'table' THEN CASE WHEN text = '' THEN '' ELSE 'Table caption: ' || text || chr(10) END || 'Columns: place' || chr(10) || 'Row 1: place is ' || chr(39) || ord || chr(39) ELSE text END) AS text_md5 FROM f""")
def rich_texts(spark, sf_dir):
    """Texts to embed: tables as sentences, figures with what a describer that sometimes fails tells of them."""
    o = F.col("ord").cast("string")
    html = F.when(F.col("role") == "table", F.concat(F.lit("<table><tr><th>place</th></tr><tr><td>"), o, F.lit("</td></tr></table>"))).otherwise("")
    rows = fx.chunks(spark, sf_dir).withColumns({"html": html, "image_path": F.concat("doc_id", F.lit("/"), o, F.lit(".png"))})
    told = embedding.with_descriptions(rows, embedding.describer(tell))
    full = embedding.rich_text(told=F.col("told"))
    return told.select("doc_id", "ord", "told_failed", F.md5(full.cast("binary")).alias("text_md5"))
