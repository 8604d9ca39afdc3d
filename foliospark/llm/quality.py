"""Quality rules: word statistics of each document, and lines that too many documents of a host share.

Lines are normalised (ASCII lower case, runs of white space as one space) and hashed. For every host and line the
distinct documents are counted, over all documents. Lines above the host's limit are removed, and documents that lose
most of their words are rejected. Equal texts of a host are examined together and carry their number, so that neither a
text nor a line that most documents have meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import hot_join, hot_keys, in_arrow, text_or_empty, written

SYMBOLS = "#*$%&|<>"
#: A line is above the limit if more documents of its host hold it than the larger of these two. The first only guards
#: hosts of a few documents against chance; the share rules from 250 documents on.
LEAST_DOCUMENTS, SHARE_OF_HOST = 5, 0.02
#: A document is depleted if more than this share of its words stood in removed lines.
DEPLETED = 0.7
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
LINES = "lines array<struct<line:long,words:int>>"


def statistics(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, [(line hash, words)]) of a text."""
    import numpy as np
    import xxhash

    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at 0x20 and 0x09 to 0x0D alone
    n = len(words)
    blanks = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    repeated = 0
    if n > 3:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
        size = len(known)
        if size < 2_000_000:
            keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        else:  # three such numbers don't fit 64 bits: number the pairs first
            pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
            keys = pairs[:-1] * size + ids[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        found = np.zeros(n - 2, bool)
        found[order[1:][same]] = found[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= found
        repeated = int(covered.sum())
    seen, dup, lines = set(), 0, []
    for line in data.split(b"\n"):
        parts = line.split()
        if parts:
            dup += line in seen
            seen.add(line)
            key = xxhash.xxh64_intdigest(b" ".join(parts).lower())
            lines.append((key - (1 << 64) if key >> 63 else key, len(parts)))
    return n, len(text) - blanks, sum(map(text.count, SYMBOLS)), dup, repeated, lines


KEYS = ["__host", "text_key"]


def _host(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("__host")


def _key(column: str):
    return F.unhex(F.md5(text_or_empty(column).cast("binary"))).alias("text_key")


def examine(docs: DataFrame, *, host_column: str = "source", text_column: str = "text") -> DataFrame:
    """(host, text key, n, statistics, hashed lines) of every distinct text of a host; n: its documents.

    Null texts count as empty, null hosts as one host named by the empty string.
    """
    base = docs.select(_host(host_column), _key(text_column), text_or_empty(text_column).alias("__text"))
    schema = T.StructType([*base.schema.fields[:2], *T.StructType.fromDDL(f"{STATISTICS}, {LINES}").fields])

    def run(batches: Iterator):
        import pyarrow as pa

        kinds = [pa.int64()] * 5 + [pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = []
                for t in batch.column(2):
                    *counts, lines = statistics(t.as_py())
                    found.append((*counts, [{"line": a, "words": b} for a, b in lines]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))], names=schema.names)

    found = base.transform(in_arrow, run, schema)
    of = F.first(F.struct(*schema.names[2:])).alias("s")
    return found.groupBy(*KEYS).agg(F.count("*").alias("n"), of).select(*KEYS, "n", "s.*")


def common_lines(texts: DataFrame, *, least: int = LEAST_DOCUMENTS, share: float = SHARE_OF_HOST, copies_once: bool = False) -> DataFrame:
    """(host, line, n_docs) of the lines above their host's limit.

    Counts are exact and over all documents: a text's lines count for each of its copies, or once with ``copies_once``. A
    line that most documents have is added up in the tasks before its shuffle.
    """
    weight = F.lit(1) if copies_once else F.col("n")
    hosts = texts.groupBy("__host").agg(F.sum(weight).alias("n_host"))
    lines = texts.select("__host", weight.alias("n"), F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    counts = lines.groupBy("__host", "line").agg(F.sum("n").alias("n_docs"))
    limit = F.greatest(F.lit(float(least)), F.lit(share) * F.col("n_host"))
    met = hot_join(counts.where(F.col("n_docs") > least), hosts, ["__host"], hot_keys(hosts, ["__host"], n="n_host"), F.col("line"))
    return met.where(F.col("n_docs") > limit).select("__host", "line", "n_docs")


def removals(texts: DataFrame, common: DataFrame) -> DataFrame:
    """(host, text_key, removed_words, removed) of texts that have common lines; removed: the hashes of those lines."""
    lines = texts.select(*KEYS, F.explode("lines").alias("l")).select(*KEYS, "l.line", "l.words")
    met = hot_join(lines, common, ["__host", "line"], hot_keys(common, ["__host", "line"], n="n_docs"), F.col("text_key"))
    return met.groupBy(*KEYS).agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed"))


def verdicts(texts: DataFrame, *, depleted: float = DEPLETED, **limits) -> DataFrame:
    """The rows of ``examine`` with removed_words, removed, base_failed and kept instead of the lines."""
    common = written(texts.sparkSession, common_lines(texts, **limits), "quality-lines")
    lost = removals(texts, common)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return (
        texts.drop("lines").join(lost, KEYS, "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= depleted * F.col("n_words")))
    )


def apply_rules(docs: DataFrame, *, host_column: str = "source", text_column: str = "text", carry: list[str] | None = None, **limits) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all but the text by default) with statistics, base_failed, kept and the removed lines.

    Null and empty texts have no words and fail the base rule. Null hosts are one host. Repeated rows are documents of their
    own and get equal verdicts; a count equal to the limit (a tie) is not above it. Texts of any length are taken whole. An
    empty table gives an empty result. Columns of ``docs`` that clash with the new names are left out.
    """
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_key", "lines", "n", "__host", "removed_words", "removed", "base_failed", "kept"}
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in new and c != text_column]
    texts = written(docs.sparkSession, examine(docs, host_column=host_column, text_column=text_column), "quality-texts")
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], _host(host_column), _key(text_column))
    spread = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(0)
    return hot_join(rows, verdicts(texts, **limits).drop("n"), KEYS, hot_keys(texts, KEYS), spread)


def kept_documents(docs: DataFrame, *, host_column: str = "source", text_column: str = "text", length_column: str | None = "n_chars", **limits) -> DataFrame:
    """The columns of ``docs`` for the documents kept, lines above the limit cut out of their texts.

    Nulls, ties, repeats, long texts and empty tables as in ``apply_rules``; columns with any names pass through. Documents
    meet their text's verdict in one shuffle, in which the copies of a text are spread by their other columns.
    """
    columns = docs.columns
    texts = written(docs.sparkSession, examine(docs, host_column=host_column, text_column=text_column), "quality-texts")
    keep = verdicts(texts, **limits).where("kept").select("__host", F.col("text_key").alias("__key"), F.col("removed").alias("__removed"))
    hot = hot_keys(texts.select("__host", F.col("text_key").alias("__key"), "n"), ["__host", "__key"])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), _host(host_column), _key(text_column).alias("__key"))
    spread = F.struct(F.lit(0), *[F.col("__row").getField(c) for c in columns if c != text_column])
    joined = hot_join(packed, keep, ["__host", "__key"], hot, spread).select(*[F.col("__row").getField(c).alias(f"c{i}") for i, c in enumerate(columns)], "__removed")
    schema = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(columns)])
    at = columns.index(text_column)

    def cut(batches: Iterator):
        import pyarrow as pa
        import xxhash

        for batch in (whole.slice(low, 256) for whole in batches for low in range(0, whole.num_rows, 256)):
            arrays, gone = [*batch.columns[:-1]], batch.column(batch.num_columns - 1)
            if gone.null_count < batch.num_rows:
                out = []
                for text, lines in zip(arrays[at].to_pylist(), gone.to_pylist(), strict=True):
                    if lines is None:
                        out.append(text)
                        continue
                    drop, left = {x % (1 << 64) for x in lines}, []
                    for line in text.split("\n"):
                        words = line.encode("utf-8", "surrogatepass").split()
                        if not words or xxhash.xxh64_intdigest(b" ".join(words).lower()) not in drop:
                            left.append(line)
                    out.append("\n".join(left))
                arrays[at] = pa.array(out, pa.string())
                if length_column in columns:
                    k = columns.index(length_column)
                    new = zip(out, gone, arrays[k].to_pylist(), strict=True)
                    arrays[k] = pa.array([len(t) if g.is_valid else n for t, g, n in new], pa.int64()).cast(batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return joined.transform(in_arrow, cut, schema).toDF(*columns)
