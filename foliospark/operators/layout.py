"""From page elements to text blocks: contents pages and running headers out, pages merged, captions attached.

Everything is windows and aggregates by document and page, so one document's pages spread over tasks as far as the keys
allow. Frames carry the columns of ``schemas.ELEMENT`` that a function needs; other columns pass through.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry, text

ATOMIC = ("table", "figure", "caption", "title", "h2")

#: Fixed patterns of contents entries, matched from the start of a collapsed line.
CONTENTS_PATTERNS = (
    r"(?i)^\s*TABLE\s+OF\s+CONTENTS\s*$",
    r"(?i)^\s*LIST\s+OF\s+(FIGURES|TABLES|APPENDICES)\s*$",
    r"^.*\.{3,}\s*\d+\s*$",
    r"^.*\.{2,}\s*\d{1,4}\s*$",
    r"(?i)^\s*(Chapter|Section|Part|Appendix|Figure|Table)\s+[\d\w]",
    r"(?i)^\s*\d+(\.\d+)*\s+[A-Z]",
)
LETTERED = r"^\s*[A-Z]+(\.\d+)*\s+[A-Z]"
#: Titles of a table that is a contents list (in capitals; as written), and words that a table of edits has.
CONTENTS_TITLES = ("TABLE OF CONTENTS", "LIST OF FIGURES", "LIST OF TABLES")
CONTENTS_NAMES = ("Table of Contents", "List of Figures", "List of Tables", "Chapter ")
EDIT_WORDS = "renumber|revise|insert"
#: Fixed patterns of lines in a page's margin: page numbers, document codes, notices; and of a page count anywhere.
PAGE_NUMBER = r"(?i)^\s*(\d+\s+(of|/)\s+\d+|page\s+\d+|\d+)\s*$"
DOCUMENT_CODE = r"^[A-Z]{2,}-[A-Z0-9\-\.]+[A-Z0-9]$"
NOTICE = r"copyright|©|confidential|proprietary|www\.|http"
PAGE_COUNT = r"(?i)^\s*\d+\s+of\s+\d+\s*$"
#: A line's height is steady if its centres deviate by less than this.
STEADY = 0.05


def numbered_page() -> Column:
    """Page 0 counts as no page."""
    return F.coalesce(F.col("page_number"), F.lit(0)) != 0


def _has_any(line: Column, names: tuple[str, ...]) -> Column:
    return reduce(or_, (line.contains(n) for n in names))


def _extent() -> tuple[Column, Column, Column]:
    """Aggregates of a page: its last layout size above 0, and the reach in x and y of elements without one."""
    sized = (F.col("layout.w") > 0) & (F.col("layout.h") > 0)
    free = ~F.coalesce(sized, F.lit(False)) & F.col("coordinates").isNotNull()
    return (
        F.max_by(F.when(sized, F.col("layout")), F.when(sized, F.col("ord"))), F.max(F.when(free, F.coalesce("coordinates.x2", F.lit(0.0)))), F.max(F.when(free, F.coalesce("coordinates.y2", F.lit(0.0)))),
    )


def page_sizes(elements: DataFrame) -> DataFrame:
    """(doc_id, page_number, width, height): the last layout size above 0, else the reach of the elements without one, at least 1."""
    own, x, y = _extent()
    return (
        elements.where(numbered_page()).groupBy("doc_id", "page_number").agg(own.alias("own"), x.alias("x"), y.alias("y")).where("own is not null or x is not null or y is not null")
        .select("doc_id", "page_number", F.coalesce("own.w", F.greatest(F.lit(1.0), "x")).alias("width"), F.coalesce("own.h", F.greatest(F.lit(1.0), "y")).alias("height"))
    )


def with_boxes(elements: DataFrame) -> DataFrame:
    """Adds page_width, page_height (as ``page_sizes`` has them, 1 where unknown) and bbox, the normalised box."""
    page = Window.partitionBy("doc_id", "page_number")
    own, x, y = (c.over(page) for c in _extent())
    size = F.when(numbered_page(), F.coalesce(own, F.when(x.isNotNull() | y.isNotNull(), F.struct(F.greatest(F.lit(1.0), x).alias("w"), F.greatest(F.lit(1.0), y).alias("h")))))
    sized = elements.withColumn("__size", size).withColumns({"page_width": F.coalesce("__size.w", F.lit(1.0)), "page_height": F.coalesce("__size.h", F.lit(1.0))}).drop("__size")
    w, h = geometry.scales(F.col("layout"), F.col("page_width"), F.col("page_height"))
    return sized.withColumns({"__w": w, "__h": h}).withColumn("bbox", geometry.scaled(F.col("given_box"), F.col("coordinates"), F.col("__w"), F.col("__h"))).drop("__w", "__h")


def contents_flags(elements: DataFrame, *, strict: bool = False) -> DataFrame:
    """Adds ``contents``: the row belongs to a table of contents.

    The lettered-heading pattern ignores case, as faithful defaults go, and so takes most short prose for entries; with
    ``strict`` it asks for capitals. Rows are told apart by ``ord``; documents without numbered pages lose explicit rows only.
    """
    doc = Window.partitionBy("doc_id")
    page = Window.partitionBy("doc_id", "page_number")
    raw, line = F.col("__raw"), F.col("__line")
    early = F.col("__page") & (F.col("page_number") <= F.col("__limit")) & (F.length(F.coalesce(F.col("text"), F.lit(""))) > 0)
    upper = F.upper(raw)
    crowded = (
        _has_any(upper, CONTENTS_TITLES)
        | ((F.length(raw) - F.length(F.replace(raw, F.lit("...."), F.lit("")))) / 4 > 5)
        | (F.regexp_count(raw, F.lit(r"(?mU)\d+\s*$")) > 10)
    )
    names = _has_any(raw, CONTENTS_NAMES)
    edited = F.lower(raw).rlike(EDIT_WORDS)
    n_words, dots = text.count_words(line), F.regexp_count(line, F.lit(r"\."))
    # the pattern that most lines match goes first; dotted lines have two dots
    entry = line.rlike(LETTERED if strict else "(?i)" + LETTERED)
    for pattern in CONTENTS_PATTERNS:
        entry = entry | (line.contains("..") & line.rlike(pattern) if r"\.{" in pattern else line.rlike(pattern))
    short = n_words <= 15
    entry = entry | (short & line.rlike(r"(?U)^(\d+\.?\d*|\w+\.?\d*)\s+\S") & line.rlike(r"(?U)\b\d{1,4}\s*$")) | (short & (dots > n_words) & (dots > 5))
    title = (F.octet_length(line) == len(CONTENTS_TITLES[0])) & line.rlike(CONTENTS_PATTERNS[0])
    kind = (
        F.when(~F.col("__early"), 0).when(title, 2).when(F.col("__table") & (F.length(raw) > 500) & crowded, 1)
        .when(F.col("__table") & (F.length(raw) > 200) & names & edited, 2).when((F.length(line) <= 200) & entry, 2).otherwise(0)
    )
    limit = F.greatest(F.lit(5), F.floor(F.max("page_number").over(doc) * 0.20))
    # columns of their own, or each pattern would have them made anew; in steps, as code of more than 8,000 bytes is not compiled
    table = F.lower(F.coalesce("type", F.lit(""))) == "table"
    numbered = F.max(F.when(F.col("__page"), F.col("page_number"))).over(doc).isNotNull()
    staged = elements.withColumn("__page", numbered_page()).withColumns({"__limit": limit, "__numbered": numbered}).withColumn("__line", text.collapse(F.col("text")))
    staged = staged.withColumns({"__early": F.coalesce(early, F.lit(False)), "__table": table})
    staged = staged.withColumn("__raw", F.when(F.col("__early") & F.col("__table"), text.strip(text.empty_if_null(F.col("text")))))
    staged = staged.withColumn("__kind", F.coalesce(kind, F.lit(0))).drop("__line", "__limit", "__raw", "__table")
    candidates, there = F.sum((F.col("__kind") == 2).cast("int")).over(page), F.sum(F.col("__early").cast("int")).over(page)
    dense = ((candidates / F.when(there > 0, there) > 0.3) & (candidates >= 2)) | (candidates >= 5)
    explicit = F.coalesce("is_toc", F.lit(False))
    flag = F.col("__numbered") & (explicit | (F.col("__kind") == 1) | ((F.col("__kind") == 2) & F.coalesce(dense, F.lit(False))))
    return staged.withColumn("contents", flag).drop("__page", "__numbered", "__early", "__kind")


def without_contents(elements: DataFrame, *, strict: bool = False) -> DataFrame:
    return contents_flags(elements, strict=strict).where(~F.col("contents")).drop("contents")


def _spread(values: Column, ordered: bool) -> Column:
    """Population deviation of an array, its values taken in one after another: by a running mean, or as parts of one value each that are put together.

    The second way gives the same for two values whichever comes first.
    """
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def taken(a: Column, y: Column) -> Column:
        n, off = a["n"] + 1, y - a["mean"]
        mean = a["mean"] + off / n if ordered else (a["n"] * a["mean"] + y) / n
        more = (y - mean) * off if ordered else off * off * a["n"] / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["squares"] + more).alias("squares"))

    return F.aggregate(values, start, taken, lambda a: F.sqrt(a["squares"] / a["n"]))


def margin_flags(boxed: DataFrame, *, ordered: bool = True) -> DataFrame:
    """Adds ``margin``: the row is a running header, footer, page number or other boilerplate.

    A line of up to 150 characters is boilerplate if it stands on at least max(2, a third) of the document's pages, once
    or at a steady height. Where rounding decides about steadiness, the centres are taken in as they come in the document if
    ``ordered``, else by size: for rows that were dealt by page, which come in no order.
    """
    doc, same = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "__key")
    centre = (F.col("bbox.y1") + F.col("bbox.y2")) / 2
    line, page = F.col("line"), F.when(numbered_page(), F.col("page_number"))
    rows = boxed.withColumn("line", text.collapse(F.col("text")))
    rows = rows.withColumn("__key", F.when(numbered_page() & (line != "") & (F.length(line) <= 150), line))
    rows = rows.withColumn("__page_no", F.dense_rank().over(doc.orderBy("page_number")))
    rows = rows.withColumns(
        {
            "__pages": F.max(F.when(page.isNotNull(), F.col("__page_no"))).over(doc) - F.max(F.when(F.col("page_number") == 0, 1).otherwise(0)).over(doc) - F.max(F.col("page_number").isNull().cast("int")).over(doc),
            "__line_pages": F.size(F.collect_set(page).over(same)), "__n_y": F.count(centre).over(same), "__spread": F.stddev_pop(centre).over(same),
        }
    )
    # lines that stand just at the limit, as those of two rows two lines apart do, are decided by one fixed way of rounding
    at_limit = F.col("__spread").between(STEADY - 1e-9, STEADY + 1e-9)
    rows = rows.withColumn("__centres", F.collect_list(F.when(at_limit & centre.isNotNull(), F.struct("ord", centre.alias("y")))).over(same))
    pick = lambda r: r["y"]
    taken = F.transform(F.array_sort("__centres"), pick) if ordered else F.array_sort(F.transform("__centres", pick))
    rows = rows.withColumn("__spread", F.when(at_limit, _spread(taken, ordered)).otherwise(F.col("__spread"))).drop("__centres")
    wide = F.col("__line_pages") >= F.greatest(F.lit(2), F.floor(F.col("__pages") / 3))
    steady = (F.col("__n_y") <= 1) | (F.col("__spread") < STEADY)
    boilerplate = F.col("__key").isNotNull() & F.coalesce(wide & steady, F.lit(False))
    picture = F.lower(F.coalesce("type", F.lit(""))).isin("image", "figure") & (F.trim(F.coalesce("image_path", F.lit(""))) != "")
    in_margin = F.coalesce((centre < 0.12) | (centre > 0.88), F.lit(False))
    short = (F.length(line) < 50) & (text.count_words(line) <= 5)
    dropped_in_margin = (
        F.when(line.rlike(PAGE_NUMBER), True)
        .when(line.rlike(DOCUMENT_CODE), True)
        .when(short, F.col("__key").isNotNull() & (F.col("__line_pages") > 1))
        .otherwise(F.lower(line).rlike(NOTICE))
    )
    drop = (
        F.when(~numbered_page(), False).when(picture, False).when(line == "", True).when(boilerplate, True)
        .when(in_margin & dropped_in_margin, True).otherwise(line.rlike(PAGE_COUNT))
    )
    return rows.withColumn("margin", drop).drop("line", "__key", "__page_no", "__pages", "__line_pages", "__n_y", "__spread")


def without_margins(boxed: DataFrame, *, ordered: bool = True) -> DataFrame:
    return margin_flags(boxed, ordered=ordered).where(~F.col("margin")).drop("margin")


def line_tolerance(heights: Column) -> Column:
    """0.6 of the upper median of a page's box heights, at least 0.006; 0.012 without boxes."""
    median = F.get(F.sort_array(heights), F.floor(F.size(heights) / 2).cast("int"))
    return F.when(F.size(heights) > 0, F.greatest(F.lit(0.006), median * 0.6)).otherwise(F.lit(0.012))


def merge_text(boxed: DataFrame) -> DataFrame:
    """Blocks: atomic elements by themselves, runs of other elements on a page joined by spaces.

    Pages come in the order of their first element; within a page, elements by line (height over the tolerance, half to
    even), then by x, then as given. Gives doc_id, page, ord (0.. in the document), role, text, html, image_path,
    element_ids, bbox, picture (the path if the element is an image) and the page's size. Runs without text vanish.
    """
    page = Window.partitionBy("doc_id", "page_number")
    heights = F.collect_list(F.when(F.col("coordinates").isNotNull(), F.col("bbox.y2") - F.col("bbox.y1"))).over(page)
    line = F.rint(F.coalesce("bbox.y1", F.lit(0.0)) / F.col("tolerance"))
    placed = (
        boxed.where(numbered_page())
        .withColumns({"__heights": heights, "page_ord": F.min("ord").over(page)})
        .withColumns({"tolerance": line_tolerance(F.col("__heights")), "role": text.role(F.col("type"), F.col("text"))}).drop("__heights")
        .withColumns({"atomic": F.col("role").isin(*ATOMIC), "__line": line, "__x": F.coalesce("bbox.x1", F.lit(0.0))})
    )
    ordered = page.orderBy("__line", "__x", "ord")
    # an atomic row is an island of its own, and so is each stretch between two of them
    so_far = F.sum(F.col("atomic").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    body = F.when(F.col("atomic"), text.empty_if_null(F.col("text"))).otherwise(text.strip(text.empty_if_null(F.col("text"))))
    placed = placed.withColumns({"rank": F.row_number().over(ordered), "__so_far": so_far, "__body": body})
    island = F.col("__so_far") * 2 - F.col("atomic").cast("int")
    gathered = F.sort_array(F.collect_list(F.struct("rank", F.col("__body").alias("text"), "element_index")))
    blocks = (
        placed.withColumn("island", island)
        .groupBy("doc_id", "page_number", "page_ord", "island")
        .agg(
            F.max("atomic").alias("atomic"), F.max(F.col("__body") != "").alias("said"), F.min_by("role", "rank").alias("first_role"), F.min("rank").alias("first_rank"), gathered.alias("rows"),
            F.min_by(F.coalesce("html", F.lit("")), "rank").alias("html"), F.min_by(F.coalesce("image_path", F.lit("")), "rank").alias("image_path"), geometry.union(F.col("bbox")).alias("bbox"),
            F.min_by(F.when(F.lower("type") == "image", F.coalesce("image_path", F.lit(""))).otherwise(""), "rank").alias("picture"), F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"),
        )
        .where(F.col("atomic") | F.col("said"))
        .select(
            "doc_id", F.col("page_number").alias("page"), "page_ord", "first_rank", "atomic", F.when(F.col("atomic"), F.col("first_role")).otherwise("paragraph").alias("role"),
            F.array_join(F.filter(F.transform("rows", lambda r: r["text"]), lambda t: t != ""), " ").alias("text"),
            F.when(F.col("atomic"), F.col("html")).otherwise("").alias("html"), F.when(F.col("atomic"), F.col("image_path")).otherwise("").alias("image_path"),
            F.transform("rows", lambda r: r["element_index"]).alias("element_ids"), "bbox", "picture", "page_width", "page_height",
        )
    )
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_ord", "first_rank")) - 1
    return blocks.withColumn("ord", number).select("doc_id", "page", "ord", "role", "text", "html", "image_path", "element_ids", "bbox", "picture", "page_width", "page_height")


def attach_captions(blocks: DataFrame) -> DataFrame:
    """Caption texts go to the last figure or table before them on the page, one line each; other captions stay.

    A figure or table and its captions become one row, which is the holder's but for the text.
    """
    before = Window.partitionBy("doc_id", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    holder = F.last(F.when(F.col("role").isin("figure", "table"), F.col("ord")), ignorenulls=True).over(before)
    others = [c for c in blocks.columns if c not in ("doc_id", "page", "ord", "text")]
    grouped = blocks.withColumn("at", F.coalesce(F.when(F.col("role") == "caption", holder), F.col("ord"))).groupBy("doc_id", "page", "at")
    rows = F.sort_array(F.collect_list(F.struct("ord", "text")))
    joined = grouped.agg(F.min_by(F.struct(*others), "ord").alias("own"), rows.alias("rows"))
    # an empty text of the holder leaves no line of its own
    lines = F.filter(F.transform("rows", lambda r: r["text"]), lambda t, i: (i > 0) | (t != ""))
    return joined.select("doc_id", "page", F.col("at").alias("ord"), F.array_join(lines, "\n").alias("text"), *[F.col(f"own.{c}").alias(c) for c in others])


def reading_order(chunks: DataFrame) -> DataFrame:
    """Sets ``order_rank``: by page, line, x and emission; chunks without a box come last on their page.

    The line's height is 0.6 of the true median of the page's box heights (0.012 without boxes), at least 0.006.
    """
    height = F.when(F.col("bbox").isNotNull(), F.greatest(F.lit(1e-6), F.col("bbox.y2") - F.col("bbox.y1")))
    median = F.median(height).over(Window.partitionBy("doc_id", "page_start"))
    sized = chunks.drop("order_rank").withColumn("__tolerance", F.greatest(F.lit(0.006), F.coalesce(median, F.lit(0.012)) * 0.6))
    line = F.when(F.col("bbox").isNull(), F.lit(9999.0)).otherwise(F.rint(F.col("bbox.y1") / F.col("__tolerance")))
    x = F.when(F.col("bbox").isNull(), F.lit(9999.0)).otherwise(F.col("bbox.x1"))
    ranked = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_start", line, x, "ord")) - 1
    return sized.withColumn("order_rank", ranked).drop("__tolerance")


def figure_images(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, image_path): the path of the first image among a chunk's elements, '' without one."""
    ids = chunks.select("doc_id", "chunk_id", F.posexplode_outer("source_element_ids").alias("pos", "element_index"))
    images = elements.where((F.lower("type") == "image") & (F.coalesce("image_path", F.lit("")) != "")).select("doc_id", "element_index", "image_path", "ord")
    last = images.groupBy("doc_id", "element_index").agg(F.max_by("image_path", "ord").alias("image_path"))
    return ids.join(last, ["doc_id", "element_index"], "left").groupBy("doc_id", "chunk_id").agg(
        F.coalesce(F.min_by("image_path", F.when(F.col("image_path").isNotNull(), F.col("pos"))), F.lit("")).alias("image_path")
    )
