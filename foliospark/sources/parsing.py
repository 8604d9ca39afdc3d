"""Files to elements through a parser seam, with per-file statistics.

A parser is ``parse(path, content bytes, strategy) -> list of element dicts`` with the keys of ``schemas.ELEMENT``. It runs
in tasks over binary files; elements that it marks as broken are skipped and a failing file becomes a row with its error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark import schemas
from foliospark.functions import geometry, storage, text
from foliospark.functions.frames import in_arrow, slices


#: Bytes of files that a parser's task turns into rows at a time, or one larger file.
SLICE = 1 << 20


def find_files(spark: SparkSession, directory: str, *, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """(path, content, modified, length, languages) of the files that match, whatever store holds them."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(directory).select("path", "content", F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"), "length", F.array(F.lit("eng")).alias("languages"))


def parse_files(files: DataFrame, parse: Callable[[str, bytes, str], list[dict]], *, strategies: tuple[str, ...] = ("hi_res", "fast")) -> DataFrame:
    """Elements of every file: the first strategy that does not raise. A file for which all fail gives one row with ``error``."""
    fields = "doc_id string, file_name string, source_path string, ord int, element_index int, page_number int, type string, text string, html string, image_path string, points array<array<double>>, strategy string, error string"
    schema = T.StructType.fromDDL(fields)
    columns = schema.names

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in (part for whole in batches for part in slices(whole, size=SLICE)):
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, used, error = [], None, None
                for strategy in strategies:
                    try:
                        found, used, error = parse(path, content, strategy), strategy, None
                        break
                    except Exception as e:  # the next strategy, or the file's own error row
                        error = f"{type(e).__name__}: {e}"
                base = {"source_path": path, "file_name": path.rsplit("/", 1)[-1], "strategy": used}
                rows += [base | {k: v for k, v in e.items() if k in columns} | {"ord": n, "element_index": n} for n, e in enumerate(found) if isinstance(e, dict)]
                if error is not None:
                    rows.append(base | {"error": error})
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    parsed = files.select("path", "content").transform(in_arrow, run, schema)
    return parsed.withColumn("doc_id", text.path_id(F.col("source_path"))).withColumn("text", F.when(F.col("error").isNull(), text.normalize(F.col("text"))))


def normalize_elements(parsed: DataFrame) -> DataFrame:
    """Parser rows in the form of ``schemas.ELEMENT``.

    Takes what ``parse_files`` gives, and further columns a parser may have: meta_html (used where html is empty), points,
    layout (struct<w, h>), is_toc. Boxes come from the first and third corner point; the normalised box is given where the
    layout's size is above 0. Rows that carry an error are left out.
    """
    have = set(parsed.columns)
    column = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    own = F.when(F.coalesce(column("html", "string"), F.lit("")) != "", column("html", "string")).otherwise(F.coalesce(column("meta_html", "string"), F.lit("")))
    rows = parsed.where(column("error", "string").isNull()).withColumns(
        {"html": own, "layout": column("layout", "struct<w:double,h:double>"), "coordinates": geometry.from_points(column("points", "array<array<double>>")), "is_toc": F.coalesce(column("is_toc", "boolean"), F.lit(False))}
    )
    sized = (F.col("layout.w") > 0) & (F.col("layout.h") > 0)
    given = F.when(sized, geometry.normalized(F.lit(None).cast(schemas.BOX), F.col("coordinates"), F.col("layout"), F.lit(1.0), F.lit(1.0)))
    rows = rows.withColumns({"given_box": given, "type": F.coalesce("type", F.lit("Unknown")), "image_path": F.coalesce("image_path", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.ELEMENT.fields])


def extract_tables(files: DataFrame, extract: Callable[[str, bytes, str], list[str]], *, flavors: tuple[str, ...] = ("lattice", "stream")) -> DataFrame:
    """Table elements of every file from a table extractor: those of the first flavor that finds any.

    ``extract(path, content, flavor)`` gives tables as Markdown. Rows have element_index -1, ``text`` the Markdown and
    ``markdown_path`` a name for it; a failing flavor counts as one that finds nothing.
    """
    schema = T.StructType.fromDDL("source_path string, file_name string, ord int, element_index int, type string, text string, html string, image_path string, markdown_path string, strategy string")

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in (part for whole in batches for part in slices(whole, size=SLICE)):
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, used = [], None
                for flavor in flavors:
                    try:
                        found, used = extract(path, content, flavor), flavor
                    except Exception:  # the next flavor
                        found = []
                    if found:
                        break
                name = path.rsplit("/", 1)[-1]
                stem = name.rsplit(".", 1)[0]
                rows += [
                    {"source_path": path, "file_name": name, "ord": -1, "element_index": -1, "type": "Table", "text": t, "html": "", "image_path": "", "markdown_path": f"{stem}_table_{n}.md", "strategy": used}
                    for n, t in enumerate(found, 1)
                ]
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    return files.select("path", "content").transform(in_arrow, run, schema).withColumn("doc_id", text.path_id(F.col("source_path")))


def write_markdown(tables: DataFrame, directory: str) -> DataFrame:
    """Writes every table of ``extract_tables`` to ``directory``/<doc_id>/<name>; ``markdown_path`` becomes that place, relative to it.

    Tables are written by tasks; a repeated attempt writes the same bytes to the same place. The rows are read again from
    the shared folder, so each file is written once.
    """
    schema = tables.schema
    names = schema.names

    def run(batches: Iterator):
        import pyarrow as pa

        files, root = storage.open_fs(directory)
        for batch in batches:
            paths = []
            for doc, name, body in zip(*(batch.column(names.index(c)).to_pylist() for c in ("doc_id", "markdown_path", "text")), strict=True):
                files.create_dir(f"{root}/{doc}", recursive=True)
                with files.open_output_stream(f"{root}/{doc}/{name}") as handle:
                    handle.write((body or "").encode())
                paths.append(f"{doc}/{name}")
            columns = [pa.array(paths, pa.string()) if n == "markdown_path" else batch.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return storage.written(tables.sparkSession, tables.transform(in_arrow, run, schema), "tables")


def collect_images(elements: DataFrame, directory: str) -> DataFrame:
    """Elements whose pictures lie in ``directory``/<doc_id>_images: ``image_path`` relative to ``directory``.

    A picture that is there already is only named anew; one that lies elsewhere is copied by the task; one that cannot be
    found gives an empty path. The rows are read again from the shared folder, so each picture is copied once.
    """
    schema = elements.schema
    names = schema.names

    def run(batches: Iterator):
        import pyarrow as pa
        from pyarrow import fs

        files, root = storage.open_fs(directory)
        inside = root.rstrip("/") + "/"
        for batch in batches:
            places = []
            for doc, path in zip(*(batch.column(names.index(c)).to_pylist() for c in ("doc_id", "image_path")), strict=True):
                place = ""
                if path:
                    own, source = storage.open_fs(path)
                    if own.get_file_info(source).type == fs.FileType.File:
                        place = source.removeprefix(inside) if source.startswith(inside) else f"{doc}_images/{source.rsplit('/', 1)[-1]}"
                        if not source.startswith(inside) and files.get_file_info(inside + place).type == fs.FileType.NotFound:
                            files.create_dir(f"{inside}{doc}_images", recursive=True)
                            with own.open_input_stream(source) as given, files.open_output_stream(inside + place) as taken:
                                while data := given.read(1 << 20):
                                    taken.write(data)
                places.append(place)
            columns = [pa.array(places, pa.string()) if n == "image_path" else batch.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return storage.written(elements.sparkSession, elements.transform(in_arrow, run, schema), "pictures")


def replace_tables(elements: DataFrame, fallback: DataFrame, *, by: str = "doc_id") -> DataFrame:
    """A file that has tables but none with HTML loses them and gets the rows of ``fallback``; other files stay."""
    file = Window.partitionBy(by)
    table = F.col("type") == "Table"
    flags = elements.withColumn("__swap", (F.max(table.cast("int")).over(file) == 1) & (F.max((table & (F.coalesce("html", F.lit("")) != "")).cast("int")).over(file) == 0))
    swapped = flags.where("__swap").select(by).distinct()
    kept = flags.where(~(F.col("__swap") & table)).drop("__swap")
    return kept.unionByName(fallback.join(swapped, by, "left_semi"), allowMissingColumns=True)


def file_stats(elements: DataFrame, *, by: str = "source_path") -> DataFrame:
    """(file, elements, pages, tables, images[, strategy, error, success]) of each file.

    The last three come with rows of ``parse_files``: the strategy that worked, the error if none did, and whether one did.
    """
    kind, have = F.col("type"), set(elements.columns)
    own = [F.max(c).alias(c) for c in ("strategy", "error") if c in have]
    stats = elements.groupBy(by).agg(
        F.count(kind).alias("elements"), F.countDistinct("page_number").alias("pages"), F.count_if(kind == "Table").alias("tables"), F.count_if(kind == "Image").alias("images"), *own
    )
    return stats.withColumn("success", F.col("error").isNull()) if "error" in have else stats


def batch_summary(stats: DataFrame) -> DataFrame:
    """Numbers of files, of those with and without an error, and sums over all."""
    failed = F.col("error").isNotNull()
    return stats.agg(
        F.count("*").alias("files"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), *[F.sum(c).alias(c) for c in ("elements", "pages", "tables", "images")]
    )
