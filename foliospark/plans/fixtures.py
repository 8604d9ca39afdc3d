"""Elements, chunks, vectors and questions derived from the benchmark tables, in Spark and as SQL over the same tables.

A document's lines are its elements, twenty a page, with types, boxes and flags by their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.functions import geometry, text
from foliospark.functions.frames import table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc long, ord, text)"""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"))


LINES = "lines AS (SELECT doc_id AS doc, unnest(range(len(l)))::INT AS ord, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, doc = F.col("ord"), F.col("doc")
    kind = (
        F.when(o % 17 == 0, "Title").when(o % 13 == 5, "Table").when(o % 13 == 6, "Image").when(o % 13 == 7, "FigureCaption").when(o % 11 == 3, "ListItem")
        .when(o % 11 == 4, "UncategorizedText").otherwise("NarrativeText")
    )
    x, y = (o % 3) * 10, (o % 20) * 50
    rows = lines(spark, sf_dir).withColumn("type", kind)
    return rows.select(
        doc.cast("string").alias("doc_id"), F.concat(F.lit("doc"), doc.cast("string"), F.lit(".pdf")).alias("file_name"), F.concat(F.lit("/corpus/doc"), doc.cast("string"), F.lit(".pdf")).alias("source_path"),
        o.alias("ord"), o.alias("element_index"), F.when(o % 41 == 40, F.lit(None)).otherwise(F.floor(o / 20) + 1).cast("int").alias("page_number"), "type", "text",
        F.when(F.col("type") == "Table", F.concat(F.lit("<table><tr><th>line</th></tr><tr><td>"), "text", F.lit("</td></tr></table>"))).otherwise("").alias("html"),
        F.when((F.col("type") == "Image") & (o % 2 == 0), F.concat(F.lit("img/"), o.cast("string"), F.lit(".png"))).otherwise("").alias("image_path"),
        F.when(o % 29 != 28, geometry.box(x, y, x + 500, y + 40)).alias("coordinates"),
        F.when(doc % 2 == 0, F.struct(F.lit(600.0).alias("w"), F.lit(1000.0).alias("h"))).alias("layout"),
        F.when(o % 31 == 30, geometry.box(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.4))).alias("given_box"), (o % 97 == 96).alias("is_toc"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in schemas.ELEMENT.fields])


ELEMENTS = LINES + """,
typed AS (SELECT *, CASE WHEN ord % 17 = 0 THEN 'Title' WHEN ord % 13 = 5 THEN 'Table' WHEN ord % 13 = 6 THEN 'Image' WHEN ord % 13 = 7 THEN 'FigureCaption'
  WHEN ord % 11 = 3 THEN 'ListItem' WHEN ord % 11 = 4 THEN 'UncategorizedText' ELSE 'NarrativeText' END AS type FROM lines),
elements AS (SELECT doc::VARCHAR AS doc_id, doc, ord, CASE WHEN ord % 41 = 40 THEN NULL ELSE ord // 20 + 1 END AS page_number, type, text,
  CASE WHEN type = 'Image' AND ord % 2 = 0 THEN 'img/' || ord || '.png' ELSE '' END AS image_path,
  CASE WHEN ord % 29 <> 28 THEN (ord % 3 * 10)::DOUBLE END AS x1, CASE WHEN ord % 29 <> 28 THEN (ord % 20 * 50)::DOUBLE END AS y1,
  CASE WHEN ord % 29 <> 28 THEN (ord % 3 * 10 + 500)::DOUBLE END AS x2, CASE WHEN ord % 29 <> 28 THEN (ord % 20 * 50 + 40)::DOUBLE END AS y2,
  CASE WHEN doc % 2 = 0 THEN 600.0::DOUBLE END AS lw, CASE WHEN doc % 2 = 0 THEN 1000.0::DOUBLE END AS lh, ord % 31 = 30 AS given, ord % 97 = 96 AS is_toc FROM typed)"""

STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
COLLAPSE = "regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"

PAGES = """pages_ AS (SELECT doc_id, page_number, coalesce(max(lw), greatest(1.0, max(x2) FILTER (WHERE lw IS NULL))) AS width,
  coalesce(max(lh), greatest(1.0, max(y2) FILTER (WHERE lw IS NULL))) AS height FROM {source} WHERE page_number IS NOT NULL GROUP BY 1, 2
  HAVING max(lw) IS NOT NULL OR max(x2) IS NOT NULL)"""

BOXED = """boxed AS (SELECT e.*, coalesce(p.width, 1.0) AS page_width, coalesce(p.height, 1.0) AS page_height,
  CASE WHEN given THEN 0.1 ELSE greatest(0.0, least(1.0, x1 / coalesce(lw, p.width, 1.0))) END AS bx1, CASE WHEN given THEN 0.2 ELSE greatest(0.0, least(1.0, y1 / coalesce(lh, p.height, 1.0))) END AS by1,
  CASE WHEN given THEN 0.3 WHEN x2 IS NOT NULL THEN greatest(0.0, least(1.0, x2 / coalesce(lw, p.width, 1.0))) END AS bx2,
  CASE WHEN given THEN 0.4 WHEN y2 IS NOT NULL THEN greatest(0.0, least(1.0, y2 / coalesce(lh, p.height, 1.0))) END AS by2
  FROM {source} e LEFT JOIN pages_ p USING (doc_id, page_number)),
boxes AS (SELECT * EXCLUDE (bx1, by1), CASE WHEN bx2 IS NOT NULL THEN bx1 END AS bx1, CASE WHEN bx2 IS NOT NULL THEN by1 END AS by1 FROM boxed)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks, with some faults for the checks: links, roles, boxes and ranks by their place."""
    o = F.col("ord")
    name = F.concat(F.lit("c"), o.cast("string"))
    role = F.when(o % 7 == 3, "figure").when(o % 11 == 5, "table").when(o % 13 == 0, "title").when(o % 53 == 51, "footnote").otherwise("paragraph")
    from pyspark.sql import Window

    # by the id that later windows have too, which then need no further exchange
    doc = Window.partitionBy("doc_id").orderBy("ord")
    body = F.when((role == "figure") & (o % 2 == 0), "").when(o % 47 == 45, "").otherwise(F.col("text"))
    rows = lines(spark, sf_dir).withColumns({"body": body, "doc_id": F.col("doc").cast("string")})
    return rows.select(
        "doc_id", F.when(o % 43 == 42, F.concat(F.lit("c"), (o - 1).cast("string"))).otherwise(name).alias("chunk_id"), o.alias("ord"), F.lit("x.pdf").alias("source_file"),
        (F.floor(o / 20) + 1).cast("int").alias("page_start"), role.alias("role"), F.col("body").alias("text"), F.lit("").alias("html"), F.when(o % 14 == 3, "img.png").otherwise("").alias("image_path"),
        geometry.box(F.lit(0.1), (o % 20) / 20, F.lit(0.9), F.when(o % 37 == 36, F.lit(1.5)).otherwise((o % 20 + 1) / 20)).alias("bbox"), F.when(o % 61 == 60, "bottom-left").otherwise("top-left").alias("coord_system"),
        F.when(o % 31 == 30, o - 5).otherwise(o).cast("int").alias("order_rank"), F.lag(name).over(doc).alias("prev_id"), F.lead(name).over(doc).alias("next_id"),
        F.lit("s0").alias("section_id"), F.concat(F.lit("part "), F.floor(o / 10).cast("string")).alias("section_path"), F.when(o % 59 == 58, "").otherwise(text.content_hash(F.col("body"), F.lit(""))).alias("content_sha256"),
    )


CHUNKS = LINES + """,
roled AS (SELECT *, CASE WHEN ord % 7 = 3 THEN 'figure' WHEN ord % 11 = 5 THEN 'table' WHEN ord % 13 = 0 THEN 'title' WHEN ord % 53 = 51 THEN 'footnote' ELSE 'paragraph' END AS role FROM lines),
bodied AS (SELECT doc, ord, role, CASE WHEN (role = 'figure' AND ord % 2 = 0) OR ord % 47 = 45 THEN '' ELSE text END AS text FROM roled),
chunks AS (SELECT doc::VARCHAR AS doc_id, CASE WHEN ord % 43 = 42 THEN 'c' || (ord - 1) ELSE 'c' || ord END AS chunk_id, ord, ord // 20 + 1 AS page_start, role, text,
  CASE WHEN ord % 14 = 3 THEN 'img.png' ELSE '' END AS image_path, (ord % 20) / 20.0 AS y1, CASE WHEN ord % 37 = 36 THEN 1.5 ELSE (ord % 20 + 1) / 20.0 END AS y2,
  CASE WHEN ord % 61 = 60 THEN 'bottom-left' ELSE 'top-left' END AS coord_system, CASE WHEN ord % 31 = 30 THEN ord - 5 ELSE ord END AS order_rank,
  CASE WHEN ord > 0 THEN 'c' || (ord - 1) END AS prev_id, CASE WHEN ord + 1 < count(*) OVER (PARTITION BY doc) THEN 'c' || (ord + 1) END AS next_id, 'part ' || (ord // 10) AS section_path,
  CASE WHEN ord % 59 = 58 THEN '' ELSE sha256(text) END AS content_sha256 FROM bodied)"""


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector store: embeddings chained within their label, with the text of the document of the same number."""
    from pyspark.sql import Window

    vectors, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    chain = Window.partitionBy("label").orderBy("vec_id")
    linked = vectors.select(
        F.col("vec_id").cast("string").alias("chunk_id"), "vec_id", "label", F.col("embedding").alias("vector"), F.lag("vec_id").over(chain).cast("string").alias("prev_id"), F.lead("vec_id").over(chain).cast("string").alias("next_id"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("section_path"),
    )
    return linked.join(docs.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left").withColumn("text", F.coalesce("text", F.concat(F.lit("vector "), F.col("chunk_id"))))


STORE = """store AS (SELECT vec_id::VARCHAR AS chunk_id, vec_id, label, embedding AS vector, lag(vec_id) OVER w::VARCHAR AS prev_id, lead(vec_id) OVER w::VARCHAR AS next_id, 'label ' || label AS section_path,
  coalesce(d.text, 'vector ' || vec_id) AS text FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id WINDOW w AS (PARTITION BY label ORDER BY vec_id))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 as a query, with its whole text."""
    return store(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("text").alias("query"), F.col("vector").alias("query_vector"), "label")


QUESTIONS = "questions AS (SELECT vec_id AS query_id, text AS query, vector AS query_vector, label FROM store WHERE vec_id % 100 = 0)"
