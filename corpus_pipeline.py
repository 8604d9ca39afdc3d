"""The corpus pipeline: quality rules, near-duplicate removal, personal data, source mixing and tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns
of ``documents`` (extra columns of ``docs``, whatever their names, are left out); each result is written to the shared folder
and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.storage import written
from foliospark.llm import bpe, mixing, near, pii, quality
from foliospark.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the word rules or are depleted go; lines above their host's limit are cut out of the others.

    Null and empty texts fail the word rules; null hosts are one host; repeated rows are documents of their own with equal
    verdicts; a count equal to a limit is not above it; long texts are taken whole; no documents give none.
    """
    return quality.kept_documents(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, that of the least id.

    Null texts are empty ones, so copies of each other; texts without words have no near copies; of rows that repeat id and
    text one stays; a similarity equal to the limit counts; long texts are compared whole; no documents give none.
    """
    return near.one_of_each(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind.

    Null texts stay null, rows stay one to one; of overlapping spans the first is shown, of those that begin together the
    shortest; long texts are searched whole; no documents give none.
    """
    return pii.redact(docs.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to the square root of their bytes, the total kept; copies of a document are rows of their own.

    Null sources are one source; null texts have no bytes, and a source without bytes gives no rows; rows that repeat an id
    draw the same count; ties of the shuffle key stand in any order; no documents give none.
    """
    return mixing.mix(docs.select(*COLUMNS), exponent=0.5, budget=1.0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded bytes.

    Null and empty texts have no tokens; rows stay one to one; long texts are encoded whole; no documents give none.
    """
    coded = bpe.tokenize(docs.select("doc_id", "source", "text"), *tokenizer()).drop("text")
    return coded.select(
        "doc_id", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("ids")
    )


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing", source_mix),
    ("byte-level BPE", tokens),
]

#: Shingle sets, MinHash and byte-pair merges have no SQL of reasonable size; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(spark, docs, f"stage-{n}")
    return docs
