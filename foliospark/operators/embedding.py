"""Selecting, linking, enriching and embedding chunks.

The encoder is a seam: anything with ``name``, ``dimension`` and ``encode(texts) -> 2-D array``. It runs in a vectorised
Python function, loaded once a worker; the default hashes words, so that nothing has to be downloaded.
``functions.tokens.PooledEncoder`` makes one of a tokenizer and a model of token states.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import storage, text, tokens
from foliospark.functions.frames import parts, ship_active
from foliospark.functions.joins import hot_join, hot_keys

SCHEMA_VERSION = "chunk-v1"


class Encoder(Protocol):
    name: str
    dimension: int

    def encode(self, texts: list[str]): ...


@dataclass(frozen=True)
class HashEncoder:
    """Signed word counts in ``dimension`` buckets; deterministic, no model."""

    dimension: int = 64
    name: str = "hash-words"

    def encode(self, texts: list[str]):
        import re
        import zlib

        import numpy as np

        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            for word in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(word.encode())
                out[i, h % self.dimension] += 1.0 if h >> 31 else -1.0
        return out


def pick_device(wanted: str = "auto") -> str:
    """The device for an encoder: the one asked for, else mps, cuda or cpu, whichever is there first. Without torch it is cpu."""
    if wanted != "auto":
        return wanted
    try:
        import torch
    except ImportError:
        return "cpu"
    mps = getattr(torch.backends, "mps", None)
    return "mps" if mps is not None and mps.is_available() else "cuda" if torch.cuda.is_available() else "cpu"


def embed(texts: Column, encoder: Encoder, *, normalize: bool = True, half: bool = False) -> Column:
    """array<float> for each text; ``half`` rounds to 16 bits (Parquet here has no such type, so 32 are stored).

    Wrong dimensions and values that are not finite are errors.
    """
    ship_active()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        for part in (p for batch in batches for p in parts(batch)):
            found = np.asarray(encoder.encode(part)).reshape(len(part), -1)
            if found.shape[1] != encoder.dimension:
                raise ValueError(f"the encoder gave {found.shape[1]} numbers, not {encoder.dimension}")
            if not np.isfinite(found).all():
                raise ValueError("the encoder gave a value that is not finite")
            if normalize:
                length = np.linalg.norm(found, axis=1, keepdims=True)
                found = np.where(length > 1e-12, found / np.maximum(length, 1e-12), found)
            found = found.astype(np.float32)
            if half:
                found = found.astype(np.float16).astype(np.float32)
            yield pd.Series(list(found), dtype=object)

    return run(texts)


def parse_policy(policy: str) -> dict:
    """``roles=a,b|min_len=N|skip_empty_figures``; a malformed number is 0, unknown parts are passed over."""
    found = {"roles": [], "min_len": 0, "skip_empty_figures": False}
    for part in filter(None, map(str.strip, policy.split("|"))):
        name, _, value = part.partition("=")
        if part.startswith("roles="):
            found["roles"] = [r.strip() for r in value.split(",") if r.strip()]
        elif part.startswith("min_len="):
            try:
                found["min_len"] = int(value)
            except ValueError:
                found["min_len"] = 0
        elif part == "skip_empty_figures":
            found["skip_empty_figures"] = True
    return found


def select_chunks(chunks: DataFrame, policy: str | dict) -> DataFrame:
    """Chunks that the policy embeds. Figures pass the list of roles unless empty ones are skipped; tables may be short."""
    p = parse_policy(policy) if isinstance(policy, str) else policy
    figure, table = F.col("role") == "figure", F.col("role") == "table"
    body = text.strip(text.empty_if_null(F.col("text")))
    keep = F.lit(True)
    if p["roles"]:
        listed = F.coalesce(F.col("role").isin(*p["roles"]), F.lit(False))
        keep = keep & (listed | (figure & F.lit(not p["skip_empty_figures"])))
    if p["skip_empty_figures"]:
        keep = keep & ~(figure & (body == ""))
    return chunks.where(keep & ((F.length(body) >= p["min_len"]) | table))


def rewire(kept: DataFrame) -> DataFrame:
    """prev_id and next_id point to the nearest kept chunks of the document, in the order of ``ord``."""
    doc = Window.partitionBy("doc_id").orderBy("ord")
    return kept.withColumn("prev_id", F.lag("chunk_id").over(doc)).withColumn("next_id", F.lead("chunk_id").over(doc))


class _Tables(HTMLParser):
    """Cells of the first table: headers, and rows as (in the body, cells of td, cells of td and th)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.done, self.has_body, self.in_body = 0, False, False, False
        self.headers, self.rows, self.cell, self.kind = [], [], None, ""

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif self.depth and tag == "tbody":
            self.has_body = self.in_body = True
        elif self.depth and tag == "tr":
            self._close()
            self.rows.append((self.in_body, [], []))
        elif self.depth and tag in ("td", "th"):
            self._close()
            if not self.rows:
                self.rows.append((self.in_body, [], []))
            self.cell, self.kind = [], tag

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self._close()
        elif tag == "tbody":
            self.in_body = False
        elif tag == "table" and self.depth:
            self._close()
            self.depth -= 1
            self.done = not self.depth

    def handle_data(self, data):
        if self.cell is not None and data.strip():
            self.cell.append(data.strip())

    def _close(self):
        if self.cell is None:
            return
        value, self.cell = "".join(self.cell), None
        if self.kind == "th":
            self.headers.append(value)
        else:
            self.rows[-1][1].append(value)
        self.rows[-1][2].append(value)


def table_sentences(html: str, caption: str) -> str:
    """A table's markup as lines: caption, columns, then each row as ``column is 'value'``; the caption alone without a table."""
    caption = caption or ""
    if not html:
        return caption
    parser = _Tables()
    parser.feed(html)
    parser.close()
    if not parser.rows and not parser.headers and "<table" not in html.lower():
        return caption
    headers = parser.headers or (parser.rows[0][2] if parser.rows else [])
    lines = [f"Table caption: {caption}"] if caption else []
    if headers:
        lines.append("Columns: " + ", ".join(headers))
    n = 0
    for in_body, cells, _ in parser.rows:
        pairs = [f"{headers[i] if i < len(headers) else f'col{i + 1}'} is '{c}'" for i, c in enumerate(cells) if c]
        if pairs and (in_body or not parser.has_body):
            n += 1
            lines.append(f"Row {n}: " + "; ".join(pairs))
    return "\n".join(lines).strip()


@F.pandas_udf(T.StringType())
def _linearized(html: pd.Series, caption: pd.Series) -> pd.Series:
    return pd.Series([table_sentences(h, c) for h, c in zip(html, caption, strict=True)], dtype=object)


def linearized(html: Column, caption: Column) -> Column:
    """``table_sentences`` as a column."""
    ship_active()
    return _linearized(html, caption)


def describer(function: Callable[[str], str]) -> Callable[[Column], Column]:
    """A describer of figures from a plain function of their path: struct<text, failed>.

    A path that the function fails on has an empty text and ``failed``, and so have a null path and an answer of None.
    """

    def describe(path: Column) -> Column:
        ship_active()

        @F.pandas_udf("text string, failed boolean")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                told = []
                for place in batch:
                    try:
                        answer = function(place) if place is not None else None
                    except Exception:
                        answer = None
                    told.append(("" if answer is None else str(answer).strip(), answer is None))
                yield pd.DataFrame(told, columns=["text", "failed"])

        return run(path)

    return describe


def rich_text(*, tables: bool = True, told: Column | None = None) -> Column:
    """Text to embed: tables as sentences; figures, if ``told`` is given, as their caption and what is told of them."""
    plain = text.empty_if_null(F.col("text"))
    out = F.when(F.lit(False), "")
    if tables:
        out = out.when((F.col("role") == "table") & (F.coalesce("html", F.lit("")) != ""), linearized(F.col("html"), plain))
    if told is not None:
        caption = F.concat(F.lit("Figure caption: "), text.strip(plain))
        out = out.when(F.col("role") == "figure", text.strip(F.when(told != "", F.concat(caption, F.lit("\nVisual summary: "), told)).otherwise(caption)))
    return out.otherwise(plain)


def with_descriptions(rows: DataFrame, describe: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with ``told`` and ``told_failed``; figures alone are described, each once, as their rows are written first.

    ``describe`` gives a string or, as ``describer`` does, struct<text, failed>. Null descriptions are empty ones.
    """
    figure = F.coalesce(F.col("role") == "figure", F.lit(False))
    told = rows.where(figure).withColumn("told", describe(F.col("image_path")))
    nested = isinstance(told.schema["told"].dataType, T.StructType)
    parts = (F.col("told.text"), F.col("told.failed")) if nested else (F.col("told"), F.lit(False))
    told = told.select(*rows.columns, F.coalesce(parts[0], F.lit("")).alias("told"), F.coalesce(parts[1], F.lit(False)).alias("told_failed"))
    told = storage.written(rows.sparkSession, told, "figures")
    return told.unionByName(rows.where(~figure).withColumns({"told": F.lit(""), "told_failed": F.lit(False)}))


def cache_key(model: str, embedding_text: Column, truncation: str, normalize: bool) -> Column:
    """Key of a cached vector; the normalisation is part of it."""
    parts = [F.lit(model), F.lit(SCHEMA_VERSION), F.sha2(embedding_text.cast("binary"), 256), F.lit(truncation), F.lit(str(normalize))]
    return F.sha2(F.concat_ws(" ", *parts).cast("binary"), 256)


def embed_chunks(
    chunks: DataFrame, policy: str, encoder: Encoder | None = None, *, most: int = 512, strategy: str = "head", normalize: bool = True, half: bool = False, tables: bool = True, describe=None, cache: DataFrame | None = None,
    tokenizer: tokens.Tokenizer | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(vectors, fresh): the vector table, and the rows (key, vector) to append to the cache.

    Select, relink, enrich, prefix, truncate, embed what ``cache`` (key, vector; of a repeated key one row counts) lacks.
    Enriched rows are written to the shared folder before anything reads them, so a figure is described once, and its text is
    the same wherever it is used; figures that could not be described keep their caption and are counted in a warning. Each
    text is encoded once however many chunks share it and however often the two results are read. Chunks meet their vectors
    with hot texts dealt to many tasks; a chunk whose vector is missing is an error. The stored text is the one that was
    embedded. Truncation is on ``tokenizer``'s ids, or counts words between white space without one.
    """
    import warnings

    spark = chunks.sparkSession
    encoder = encoder or HashEncoder()
    cut = text.truncation_name(most, strategy)
    rows = rewire(select_chunks(chunks, policy))
    if describe is not None:
        rows = with_descriptions(rows, describe)
    full = text.document_prefix(rich_text(tables=tables, told=F.col("told") if describe is not None else None))
    rows = rows.withColumn("__full", full)
    if tokenizer is not None:
        short, cut_key = tokens.truncated(F.col("__full"), tokenizer, most, strategy), f"{cut} {tokenizer.name}"
    else:
        split = text.words(F.col("__full"))
        short, cut_key = F.when(F.size(split) <= most, F.col("__full")).otherwise(F.array_join(text.truncate(split, most, strategy), " ")), cut
    keyed = rows.withColumn("key", cache_key(encoder.name, F.col("__full"), cut_key, normalize)).withColumn("embedding_text", short).drop("__full")
    # only what the vector table has goes on: not the text and markup that the embedded text was made of, nor boxes
    used = ["chunk_id", "doc_id", "role", "page_start", "order_rank", "section_id", "section_path", "content_sha256", "prev_id", "next_id", "key", "embedding_text"]
    keyed = storage.written(spark, keyed.select(*used, *(["told_failed"] if describe is not None else [])), "enriched")
    if describe is not None and (failed := keyed.where("told_failed").count()):
        warnings.warn(f"{failed} figures could not be described", stacklevel=2)
    wanted = keyed.groupBy("key").agg(F.first("embedding_text").alias("embedding_text"), F.count("*").alias("n"))
    wanted = storage.written(spark, wanted, "texts")
    stored = cache.groupBy("key").agg(F.min("vector").alias("vector")) if cache is not None else None
    missing = wanted.drop("n") if stored is None else wanted.drop("n").join(stored.select("key"), "key", "left_anti")
    fresh = storage.written(spark, missing.select("key", embed(F.col("embedding_text"), encoder, normalize=normalize, half=half).alias("vector")), "vectors")
    known = fresh if stored is None else fresh.unionByName(stored.select("key", "vector"))
    joined = hot_join(keyed, known, ["key"], hot_keys(wanted, ["key"]), F.struct("doc_id", "chunk_id"), how="left")
    vector = F.coalesce("vector", F.raise_error(F.concat(F.lit("no vector of chunk "), F.coalesce("chunk_id", F.lit("null")))).cast("array<float>"))
    vectors = joined.select(
        "chunk_id", "doc_id", "role", F.col("page_start").cast("int").alias("page_start"), F.col("order_rank").cast("int").alias("order_rank"), "section_id", "section_path", "content_sha256",
        "prev_id", "next_id", F.lit(encoder.name).alias("model_id"), F.lit(encoder.dimension).alias("dim"), F.lit(cut).alias("truncation"), F.lit(normalize).alias("l2_normalize"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "embedding_text", F.sha2(F.col("embedding_text").cast("binary"), 256).alias("embedding_text_sha256"), vector.alias("vector"),
    )
    return vectors, fresh
