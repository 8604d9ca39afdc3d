"""Line dedup: repeated long lines stay in one document alone, told as compressed keep bitmaps.

Every long line becomes (hash, document, position). Rows are partitioned by ranges of the hash and sorted within it by
document and position, so that a window streams over each line's occurrences: the first document is the one that keeps the
line, the others lose it if there are documents enough. What comes back for a document is a run-length bitmap; no text is
shuffled to get it. A hash with more than a fair part of all rows is split by document, and its counts are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import HOT_PARTS, hot_keys, text_or_empty, written

LEAST_CHARACTERS, LEAST_DOCUMENTS = 40, 5
#: What is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: A hash of fewer rows than this is never split.
LEAST_HOT = 500
#: Leading bits of the hash that are counted first, to find those that may be hot.
COARSE_BITS = 20


def _lower(text: Column) -> Column:
    """A to Z in lower case, nothing else changed."""
    ascii_alone = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_alone, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _long_lines(docs: DataFrame, least: int, id_column: str, text_column: str) -> DataFrame:
    """(line binary, doc_id, text_key, pos, coarse) of every line whose key has ``least`` code points."""
    text = text_or_empty(text_column)
    split = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(_lower(text), "\n", -1)).alias("pos", "raw"))
    key = split.withColumn("key", F.btrim("raw", F.lit(BLANKS))).where(F.char_length("key") >= least)
    hashed = key.select(F.md5(F.col("key").cast("binary")).alias("hex"), "doc_id", "text_key", "pos")
    return hashed.select(F.unhex("hex").alias("line"), "doc_id", "text_key", "pos", F.conv(F.substring("hex", 1, COARSE_BITS // 4), 16, 10).cast("int").alias("coarse"))


def _hot_lines(lines: DataFrame, least_hot: int) -> DataFrame:
    """(line, __splits, hot_docs, hot_last) of the hot lines: fewer than HOT_PARTS rows, whatever the input's size.

    Leading bits are counted first, a million groups at most; only the few that may hold a hot line are counted by line.
    """
    spark: SparkSession = lines.sparkSession
    coarse = lines.groupBy("coarse").agg(F.count("*").alias("n"))
    total = coarse.agg(F.sum("n")).first()[0] or 0
    near = hot_keys(coarse, ["coarse"], least=least_hot).select("coarse")
    if near.isEmpty():
        return lines.limit(0).select("line", F.lit(1).alias("__splits"), F.lit(0).cast("long").alias("hot_docs"), F.col("doc_id").alias("hot_last"))
    counted = lines.join(F.broadcast(near), "coarse").groupBy("line").agg(F.count("*").alias("n"))
    size = max(total / HOT_PARTS, least_hot)
    hot = counted.where(F.col("n") > size).select("line", F.ceil(F.col("n") / size).cast("int").alias("__splits"))
    hot = spark.createDataFrame(hot.collect(), hot.schema)
    # distinct documents first, so that a hot line's rows are combined in many tasks; null is a document of its own
    holders = lines.join(F.broadcast(hot), "line").select("line", "__splits", "doc_id").distinct()
    found = holders.groupBy("line", "__splits").agg(F.count("*").alias("hot_docs"), F.max("doc_id").alias("hot_last"))
    return spark.createDataFrame(found.collect(), found.schema)


def keep_bitmaps(
    docs: DataFrame, *, least_characters: int = LEAST_CHARACTERS, least_documents: int = LEAST_DOCUMENTS, least_hot: int = LEAST_HOT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, text_key, n_dropped, dropped) of every document that loses lines.

    ``dropped`` is the keep bitmap in compressed form: its runs of dropped lines as (start, length), ascending; all other
    lines stay. A line's key is the line without white space of ASCII at both ends, A to Z in lower case. A key of
    ``least_characters`` code points found in ``least_documents`` documents loses all its lines but those of the largest id.

    Null and empty texts are one empty line. A null id counts as one document, less than all others. Rows that repeat an id
    are one document; if their texts differ, ``text_key`` tells them apart, and equal rows share one bitmap. Within a
    document repeated lines share one fate. Long texts are split whole; an empty table gives an empty result; extra
    columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    lines = written(spark, _long_lines(docs, least_characters, id_column, text_column), "long-lines")
    hot = _hot_lines(lines, least_hot)
    salt = F.pmod(F.xxhash64("doc_id"), F.coalesce("__splits", F.lit(1))).cast("int")
    dealt = lines.join(F.broadcast(hot), "line", "left").withColumn("salt", salt).drop("__splits", "coarse")
    ranged = dealt.repartitionByRange("line", "salt")
    stream = Window.partitionBy("line", "salt").orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    whole = Window.partitionBy("line", "salt")
    another = (F.row_number().over(stream) == 1) | ~F.lag("doc_id").over(stream).eqNullSafe(F.col("doc_id"))
    placed = ranged.withColumns({"another": another.cast("long"), "first": F.first("doc_id").over(stream)}).withColumn("docs", F.sum("another").over(whole))
    is_hot = F.col("hot_docs").isNotNull()
    n_docs, last = F.coalesce("hot_docs", "docs"), F.when(is_hot, F.col("hot_last")).otherwise(F.col("first"))
    lost = placed.where((n_docs >= least_documents) & ~F.col("doc_id").eqNullSafe(last)).select("doc_id", "text_key", "pos")
    gathered = lost.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("d"))
    starts = F.filter("d", lambda p, k: (k == 0) | (F.get("d", k - 1) != p - 1))
    ends = F.filter("d", lambda p, k: (k == F.size("d") - 1) | (F.get("d", k + 1) != p + 1))
    runs = gathered.select("doc_id", "text_key", F.size("d").alias("n_dropped"), F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length"))).alias("dropped"))
    return written(spark, runs, "keep-bitmaps")


def kept_lines(lines: Column, dropped: Column) -> Column:
    """The array ``lines`` without the runs of ``dropped``: slices between the runs, so that no line is looked up one by one."""
    end = lambda k: F.get(dropped, k)["start"] + F.get(dropped, k)["length"]
    before = F.transform(dropped, lambda r, k: F.slice(lines, F.when(k == 0, 1).otherwise(end(k - 1) + 1), r["start"] - F.when(k == 0, 0).otherwise(end(k - 1))))
    n = F.size(dropped)
    rest = F.slice(lines, end(n - 1) + 1, F.size(lines))
    return F.when(n > 0, F.concat(F.flatten(before), rest)).otherwise(lines)


def without_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated lines of its texts dropped, ``n_lines`` (before) and ``n_dropped`` (int) as the last columns in
    place of any that have these names.

    Every row stays; null texts become empty. The bitmaps meet the texts in one join by id and text, whose hot keys (repeated
    rows) Spark may split. Nulls, ties, repeats and empty tables as in ``keep_bitmaps``.
    """
    found = keep_bitmaps(docs, id_column=id_column, text_column=text_column, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text_or_empty(text_column)).alias("key"))
    joined = rows.join(found, F.col("row")[id_column].eqNullSafe(found["doc_id"]) & (F.col("key") == found["text_key"]), "left")
    split = joined.withColumn("body", F.coalesce(F.col("row")[text_column], F.lit(""))).withColumn("lines", F.split("body", "\n", -1))
    kept = F.when(F.col("dropped").isNull(), F.col("body")).otherwise(F.array_join(kept_lines(F.col("lines"), F.col("dropped")), "\n"))
    own = [(kept if c == text_column else F.col("row")[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return split.select(*own, F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
