"""A stored inverted index for exact BM25 search.

Postings are stored once, by term and falling weight, in blocks with their largest weight. A query's words are ranked by the
most that each can add to a score. First the best blocks of its strongest words give rows, whose k-th exact score is a
cutoff. A row whose strongest word of the query is the r-th cannot score more than its posting for that word and the bounds of
all later words, so only postings that reach the cutoff that way name further candidates. Candidates are scored exactly.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import storage, text
from foliospark.functions.frames import in_arrow
from foliospark.functions.joins import hot_join, hot_keys
from foliospark.operators import retrieval

#: Postings of a block, and strongest words of a query whose first blocks give its cutoff.
BLOCK, SEEDS = 512, 4
#: Postings in finished blocks that a task holds before it gives them.
READY = 20_000
#: Margin under a cutoff for rounding: scores are rounded to 9 places.
MARGIN = 1e-8


class KeywordIndex:
    """An index under ``path``: ``rows`` (id, terms), ``postings`` (term, n, top, rows, weights) and ``terms`` (term, df, top)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = json.loads(spark.read.text(f"{self.path}/about").first()[0])
        self.row_id, self.n, self.mean, self.k1, self.b = about["row_id"], about["rows"], about["mean"], about["k1"], about["b"]
        self.rows, self.postings, self.terms = (spark.read.parquet(f"{self.path}/{name}") for name in ("rows", "postings", "terms"))

    @staticmethod
    def build(store: DataFrame, path: str, *, k1: float = 1.2, b: float = 0.75, row_id: str = "chunk_id", body: str = "text", block: int = BLOCK) -> KeywordIndex:
        """Writes the index of all rows of ``store``. Null texts have no words; row ids must be unique.

        Postings are dealt by term and weight, so a word that most rows have is spread over tasks.
        """
        spark = store.sparkSession
        store.select(row_id, text.ascii_tokens(F.col(body)).alias("terms")).write.mode("overwrite").parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        stats, n, words = retrieval.term_statistics(rows)
        mean = words / n or 1.0 if n else 1.0
        own = rows.schema[row_id].dataType
        single = T.StructType([T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("id", own)])
        packed = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("top", T.DoubleType()), T.StructField("rows", T.ArrayType(own)), T.StructField("weights", T.ArrayType(T.DoubleType()))])

        def weigh(batches: Iterator):
            from collections import Counter

            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(single)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    found = []
                    for name, terms in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                        norm = k1 * (1 - b + b * len(terms) / mean)
                        found += [(t, tf * (k1 + 1) / (tf + norm), name) for t, tf in Counter(terms).items()]
                    columns = zip(*found, strict=True) if found else ([], [], [])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        def pack(batches: Iterator):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow, held, ready, n = to_arrow_schema(packed), [], [], 0

            def close():
                nonlocal n
                if held:
                    n += len(held)
                    ready.append({"term": held[0][0], "n": len(held), "top": held[0][1], "rows": [h[2] for h in held], "weights": [h[1] for h in held]})
                    held.clear()

            for batch in batches:
                for posting in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and (held[0][0] != posting[0] or len(held) == block):
                        close()
                    held.append(posting)
                if len(ready) > 1000 or n > READY:
                    yield pa.RecordBatch.from_pylist(ready, schema=arrow)
                    ready, n = [], 0
            close()
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema=arrow)

        order = [F.col("term"), F.desc("weight"), F.col("id")]
        postings = rows.transform(in_arrow, weigh, single).repartitionByRange(*order).sortWithinPartitions(*order)
        postings.transform(in_arrow, pack, packed).write.mode("overwrite").parquet(f"{path}/postings")
        tops = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.max("top").alias("top"), F.count("*").alias("blocks"))
        stats.join(tops, "term").write.mode("overwrite").parquet(f"{path}/terms")
        about = {"row_id": row_id, "rows": n, "mean": mean, "k1": k1, "b": b}
        spark.createDataFrame([(json.dumps(about),)], "value string").write.mode("overwrite").text(f"{path}/about")
        return KeywordIndex(spark, path)

    def _scored(self, words: DataFrame, candidates: DataFrame, k: int, query_id: str) -> DataFrame:
        """The k best of the candidate rows (id) for every query, by their exact scores."""
        docs = self.rows.join(candidates.select(F.col("id").alias(self.row_id)), self.row_id, "left_semi")
        return retrieval.score_rows(words, docs, self.mean, k, k1=self.k1, b=self.b, query_id=query_id, row_id=self.row_id)

    def search(self, queries: DataFrame, k: int, *, query_id: str = "query_id", query: str = "query") -> tuple[DataFrame, DataFrame]:
        """(hits, work): hits as ``bm25_search`` gives them; work is one row (postings, read, rows, scored) of the batch.

        read: postings of the blocks that were looked into; scored: rows whose exact scores were computed. Postings that
        several queries need are read once.
        """
        if k <= 0:
            raise ValueError("top_k must be a positive integer")
        spark = self.spark
        words = storage.written(spark, retrieval.weighed_terms(queries, self.terms.select("term", "df"), self.n, query_id=query_id, query=query), "words")
        tops = self.terms.select("term", "top")
        popular = hot_keys(words.groupBy("term").agg(F.count("*").alias("n")), ["term"])
        bounded = hot_join(words, tops, ["term"], popular, F.col("ids")).withColumn("most", F.col("idf") * F.col("top"))
        by = Window.partitionBy("ids").orderBy(F.desc("most"), "term")
        later = F.coalesce(F.sum("most").over(by.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
        ranked = storage.written(spark, bounded.withColumns({"place": F.row_number().over(by), "later": later}), "ranked")
        # the first blocks of the strongest words: a block is a term's first if its top is the term's
        seeds = ranked.where(F.col("place") <= SEEDS).groupBy("term").agg(F.max("top").alias("floor"))
        first = self._candidates(seeds)
        one = self._scored(words, first, k, query_id)
        cutoffs = one.groupBy(F.col(query_id).alias("ids")).agg(F.when(F.count("*") == k, F.min("score")).alias("cutoff"))
        # the least weight that a posting of a term must have for any query of the batch
        needs = ranked.join(cutoffs, "ids", "left").withColumn("need", (F.coalesce("cutoff", F.lit(0.0)) - MARGIN - F.col("later")) / F.col("idf"))
        floors = storage.written(spark, needs.groupBy("term").agg(F.min("need").alias("floor"), F.max("top").alias("top")).where(F.col("floor") <= F.col("top")).select("term", "floor"), "floors")
        second = storage.written(spark, self._candidates(floors).unionByName(first).groupBy("id").agg(F.lit(1).alias("one")), "candidates")
        hits = self._scored(words, second, k, query_id)
        read = self._blocks(seeds.unionByName(floors).groupBy("term").agg(F.min("floor").alias("floor"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("read"))
        all_ = self.terms.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
        work = all_.join(read).join(second.agg(F.count("*").alias("scored"))).select("postings", "read", F.lit(self.n).cast("long").alias("rows"), "scored")
        return hits, work

    def _blocks(self, floors: DataFrame) -> DataFrame:
        """The blocks that have a posting of at least the term's ``floor``; those of a common word are dealt to many tasks."""
        common = hot_keys(self.terms.select("term", F.col("blocks").alias("n")), ["term"], least=64)
        return hot_join(self.postings, floors, ["term"], common, F.col("top")).where(F.col("top") >= F.col("floor"))

    def _candidates(self, floors: DataFrame) -> DataFrame:
        """(id) of the rows that such postings name."""
        found = self._blocks(floors).select("floor", F.explode(F.arrays_zip("rows", "weights")).alias("p"))
        return found.where(F.col("p.weights") >= F.col("floor")).select(F.col("p.rows").alias("id")).distinct()
