"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry, storage, text, tokens, vectors
from foliospark.functions.frames import table
from foliospark.operators import chunking, curation, embedding, evaluation, index, keywords, layout, retrieval
from foliospark.plans import fixtures as fx
from foliospark.sources import html as html_source
from foliospark.sources import parsing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            SQL[key] = sql
        return function

    return register


# ---- retrieval --------------------------------------------------------------------------------------------------------

_DENSE = f"""WITH {fx.STORE}, {fx.QUESTIONS}, scored AS (SELECT query_id, chunk_id, {{score}} AS score FROM questions, store),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {{order}}, chunk_id) AS rank FROM scored)
SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM ranked WHERE rank <= 10"""
_IP = "list_dot_product(query_vector::DOUBLE[], vector::DOUBLE[])"
_L2 = "list_sum(list_transform(list_zip(query_vector, vector), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"


def _dense(spark: SparkSession, sf_dir: str, metric: str, k: int) -> DataFrame:
    return retrieval.dense_search(fx.questions(spark, sf_dir), fx.store(spark, sf_dir).select("chunk_id", "vector"), k, metric=metric)


@query(_DENSE.format(score=_IP, order="DESC"))
def dense_topk_ip(spark, sf_dir):
    return _dense(spark, sf_dir, "ip", 10).withColumn("score", F.round("score", 6))


@query(_DENSE.format(score=_L2, order="ASC"))
def dense_topk_l2(spark, sf_dir):
    return _dense(spark, sf_dir, "l2", 10).withColumn("score", F.round(F.col("score"), 6))


def _indexed(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    """The same questions through a stored index."""
    built = index.DenseIndex.build(fx.store(spark, sf_dir).select("chunk_id", "vector"), storage.scratch(spark, "index"))
    return built.search(fx.questions(spark, sf_dir), 10, metric=metric)[0].withColumn("score", F.round("score", 6))


@query(_DENSE.format(score=_IP, order="DESC"))
def indexed_topk_ip(spark, sf_dir):
    return _indexed(spark, sf_dir, "ip")


@query(_DENSE.format(score=_L2, order="ASC"))
def indexed_topk_l2(spark, sf_dir):
    return _indexed(spark, sf_dir, "l2")


_BM25 = """d AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM store), m AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM questions), u AS (SELECT chunk_id, len(t) AS size, unnest(t) AS term FROM d),
tf AS (SELECT chunk_id, size, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS score FROM tf JOIN df USING (term) JOIN q USING (term), m GROUP BY 1, 2),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)"""


@query(
    f"""WITH {fx.STORE}, {fx.QUESTIONS}, {_BM25}, one AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY {_IP} DESC, chunk_id) AS rank FROM questions, store QUALIFY rank <= 20),
fused AS (SELECT query_id, chunk_id, sum(s) AS score, min(list * 1000 + rank) AS first FROM (SELECT query_id, chunk_id, 0 AS list, rank, 1.0::DOUBLE / (60 + rank) AS s FROM one
 UNION ALL SELECT query_id, chunk_id, 1, rank, 1.0::DOUBLE / (60 + rank) FROM bm25 WHERE rank <= 20) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS rank FROM fused)
SELECT query_id, chunk_id, round(score, 9) AS score, rank::INT AS rank FROM ranked WHERE rank <= 15"""
)
def rrf_fusion(spark, sf_dir):
    """Dense and keyword ranks, both over the whole store."""
    store, asked = fx.store(spark, sf_dir), fx.questions(spark, sf_dir)
    lists = [retrieval.dense_search(asked, store, 20), retrieval.bm25_search(asked, store, 20)]
    return retrieval.fuse(lists, k=60, cap=15).withColumn("score", F.round("score", 9))


@query(f"""WITH {fx.STORE}, r AS (SELECT vec_id AS request_id, [chunk_id, coalesce(next_id, chunk_id), chunk_id, coalesce(prev_id, chunk_id)] AS ids FROM store),
u AS (SELECT request_id, unnest(range(4))::INT AS pos, unnest(ids) AS chunk_id FROM r) SELECT request_id, pos, u.chunk_id, label, section_path FROM u JOIN store USING (chunk_id)""")
def fetch_ordered(spark, sf_dir):
    """Every row asks for itself, its neighbours (itself at a chain's end) and itself again."""
    store = fx.store(spark, sf_dir)
    ids = F.array("chunk_id", F.coalesce("next_id", "chunk_id"), "chunk_id", F.coalesce("prev_id", "chunk_id"))
    return retrieval.fetch(store.select(F.col("vec_id").alias("request_id"), ids.alias("chunk_ids")), store).select("request_id", "pos", "chunk_id", "label", "section_path")


@query(f"""WITH {fx.STORE}, r AS (SELECT vec_id AS request_id, [chunk_id, 'x' || vec_id, (vec_id * 50)::VARCHAR] AS ids FROM store),
u AS (SELECT request_id, unnest(range(3))::INT AS pos, unnest(ids) AS chunk_id FROM r) SELECT request_id, pos, u.chunk_id, label, s.chunk_id IS NOT NULL AS found FROM u LEFT JOIN store s USING (chunk_id)""")
def fetch_partial(spark, sf_dir):
    """Every row asks for itself, for an id that nothing has and for one that lies beyond the store's end for most."""
    store = fx.store(spark, sf_dir)
    ids = F.array("chunk_id", F.concat(F.lit("x"), F.col("vec_id").cast("string")), (F.col("vec_id") * 50).cast("string"))
    requests = store.select(F.col("vec_id").alias("request_id"), ids.alias("chunk_ids"))
    return retrieval.fetch(requests, store, strict=False).select("request_id", "pos", "chunk_id", "label", "found")


@query(f"""WITH {fx.STORE} SELECT chunk_id, array_to_string(list_reverse(coalesce(p, [])), ',') AS prev, array_to_string(coalesce(n, []), ',') AS next FROM (SELECT chunk_id,
 list(chunk_id) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p, list(chunk_id) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS n FROM store)""")
def neighbors_window(spark, sf_dir):
    store = fx.store(spark, sf_dir).select("chunk_id", "prev_id", "next_id")
    return retrieval.neighbors(store, store, 3).select("chunk_id", F.array_join("prev", ",").alias("prev"), F.array_join("next", ",").alias("next"))


@query(f"WITH {fx.STORE} SELECT chunk_id, vec_id, section_path FROM store WHERE coalesce(section_path, '') = 'label 1'")
def section_lookup(spark, sf_dir):
    return retrieval.section(fx.store(spark, sf_dir), "label 1", order=("vec_id",)).select("chunk_id", "vec_id", "section_path")


@query(f"""WITH {fx.STORE}, b AS (SELECT chunk_id, CASE WHEN vec_id % 7 = 3 THEN 'lost ' || prev_id ELSE prev_id END AS p, CASE WHEN vec_id % 7 = 3 THEN 'lost ' || next_id ELSE next_id END AS n FROM store),
l AS (SELECT chunk_id, 'prev' AS side, p AS reference FROM b UNION ALL SELECT chunk_id, 'next', n FROM b) SELECT * FROM l WHERE reference IS NOT NULL AND reference NOT IN (SELECT chunk_id FROM b)""")
def dangling_refs(spark, sf_dir):
    """Links of the whole store, those of every seventh row rewritten to lead nowhere."""
    broken = [F.when(F.col("vec_id") % 7 == 3, F.concat(F.lit("lost "), c)).otherwise(F.col(c)).alias(c) for c in ("prev_id", "next_id")]
    return retrieval.dangling(fx.store(spark, sf_dir).select("chunk_id", "vec_id", *broken))


@query(f"""WITH {fx.STORE}, v AS (SELECT chunk_id FROM store WHERE vec_id % 6 <> 1)
SELECT chunk_id, label, CASE WHEN prev_id IN (SELECT chunk_id FROM v) THEN prev_id END AS prev_id, CASE WHEN next_id IN (SELECT chunk_id FROM v) THEN next_id END AS next_id, len(vector) AS dimension FROM store JOIN v USING (chunk_id)""")
def vectors_joined(spark, sf_dir):
    """All chunks with their vectors; every sixth vector is missing from the index, so links to its chunk lead nowhere."""
    store = fx.store(spark, sf_dir)
    joined = retrieval.with_vectors(store.drop("vector"), store.where("vec_id % 6 <> 1").select("chunk_id", "vector"), columns=("vector",))
    return joined.select("chunk_id", "label", "prev_id", "next_id", F.size("vector").cast("long").alias("dimension"))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE vec_id % 6 <> 1) AS vectors, count(*) = count(*) FILTER (WHERE vec_id % 6 <> 1) AS same FROM embeddings")
def index_aligned(spark, sf_dir):
    store = fx.store(spark, sf_dir)
    return retrieval.aligned(store, store.where("vec_id % 6 <> 1"))


@query(f"SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'query vector has the wrong dimension' WHEN vec_id % 5 = 1 THEN 'query vector is not finite' WHEN vec_id % 5 = 2 THEN 'query vector is missing' END AS problem FROM embeddings")
def query_validation(spark, sf_dir):
    n = F.col("vec_id") % 5
    v = F.col("embedding")
    broken = F.when(n == 0, F.slice(v, 1, 3)).when(n == 1, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan")).cast("float")))).when(n != 2, v)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", broken.alias("query_vector"))
    return retrieval.validate_queries(rows, 64).select("vec_id", "problem")


def _reranked(dense: int, shown: int) -> str:
    """SQL: the dense candidates of each question in the order of their word sets' similarity with it."""
    return f"""tok AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM store), asked AS (SELECT * FROM questions WHERE regexp_replace(query, '^\\s+|\\s+$', '', 'g') <> ''),
qt AS (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS q FROM asked),
dense AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY {_IP} DESC, chunk_id) AS rank FROM asked, store QUALIFY rank <= {dense}),
sc AS (SELECT query_id, chunk_id, rank, CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0.0 ELSE len(list_intersect(q, t))::DOUBLE / (len(q) + len(t) - len(list_intersect(q, t))) END AS s FROM dense JOIN qt USING (query_id) JOIN tok USING (chunk_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank, chunk_id) AS rr FROM sc QUALIFY rr <= {shown})"""


@query(f"""WITH {fx.STORE}, {fx.QUESTIONS}, {_reranked(50, 10)}
SELECT query_id, rr::INT AS rank, r.chunk_id, round(s, 9) AS rerank_score, coalesce(prev_id, '') AS prev, coalesce(next_id, '') AS next FROM r JOIN store USING (chunk_id)""")
def retrieve_batch(spark, sf_dir):
    asked = fx.questions(spark, sf_dir).select("query_id", "query", "query_vector")
    found = retrieval.retrieve(asked, fx.store(spark, sf_dir), top_k_dense=50, top_k_sparse=50, top_k_rerank=10)
    return found.select("query_id", "rank", "chunk_id", F.round("rerank_score", 9).alias("rerank_score"), F.array_join("prev", ",").alias("prev"), F.array_join("next", ",").alias("next"))


@query("SELECT NULL::BIGINT AS query_id, NULL::VARCHAR AS chunk_id, NULL::DOUBLE AS score, NULL::INT AS rank WHERE false")
def keyword_search(spark, sf_dir):
    return retrieval.keyword_search(fx.questions(spark, sf_dir), fx.store(spark, sf_dir), 10)


@query(f"""WITH {fx.STORE}, {fx.QUESTIONS}, {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM bm25 WHERE rank <= 10""")
def bm25_search(spark, sf_dir):
    return retrieval.bm25_search(fx.questions(spark, sf_dir), fx.store(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {fx.STORE}, {fx.QUESTIONS}, {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM bm25 WHERE rank <= 10""")
def indexed_bm25(spark, sf_dir):
    """The same questions through a stored inverted index."""
    built = keywords.KeywordIndex.build(fx.store(spark, sf_dir).select("chunk_id", "text"), storage.scratch(spark, "keywords"))
    return built.search(fx.questions(spark, sf_dir), 10)[0].withColumn("score", F.round("score", 6))


_FAULTS = """n AS (SELECT chunk_id, vec_id, prev_id AS p, next_id AS n, lag(chunk_id, 3) OVER (PARTITION BY label ORDER BY vec_id) AS back FROM store),
f AS (SELECT chunk_id, CASE WHEN vec_id % 50 = 33 THEN NULL ELSE p END AS prev_id, CASE vec_id % 50 WHEN 7 THEN chunk_id WHEN 13 THEN 'lost' WHEN 21 THEN coalesce(back, n) ELSE n END AS next_id FROM n),
l AS (SELECT chunk_id, 'prev' AS side, prev_id AS reference FROM f WHERE prev_id IS NOT NULL UNION ALL SELECT chunk_id, 'next', next_id FROM f WHERE next_id IS NOT NULL),
m AS (SELECT l.*, g.chunk_id IS NOT NULL AS there, CASE side WHEN 'prev' THEN g.next_id ELSE g.prev_id END AS back FROM l LEFT JOIN f g ON g.chunk_id = l.reference)"""


@query(f"""WITH RECURSIVE {fx.STORE}, {_FAULTS}, ok AS (SELECT side, chunk_id, reference FROM m WHERE there AND reference <> chunk_id),
w AS (SELECT side, chunk_id AS start, reference AS spot, 1 AS d FROM ok UNION ALL SELECT w.side, start, ok.reference, d + 1 FROM w JOIN ok ON ok.side = w.side AND ok.chunk_id = w.spot WHERE d < 40 AND w.spot <> start)
SELECT chunk_id, side, 'self' AS rule, reference FROM m WHERE reference = chunk_id UNION ALL SELECT chunk_id, side, 'dangling', reference FROM m WHERE NOT there
UNION ALL SELECT chunk_id, side, 'one_sided', reference FROM m WHERE there AND reference <> chunk_id AND back IS DISTINCT FROM chunk_id
UNION ALL SELECT chunk_id, side, 'cycle', reference FROM ok WHERE (side, chunk_id) IN (SELECT (side, start) FROM w WHERE spot = start)""")
def chain_integrity(spark, sf_dir):
    """The whole store with planted links to oneself, to nothing, back along the chain, and none where one belongs."""
    store = fx.store(spark, sf_dir).select("chunk_id", "vec_id", "label", "prev_id", "next_id")
    k, back = F.col("vec_id") % 50, F.lag("chunk_id", 3).over(Window.partitionBy("label").orderBy("vec_id"))
    onward = F.when(k == 7, F.col("chunk_id")).when(k == 13, "lost").when(k == 21, F.coalesce(back, "next_id")).otherwise(F.col("next_id"))
    faulty = store.select("chunk_id", F.when(k != 33, F.col("prev_id")).alias("prev_id"), onward.alias("next_id"))
    return retrieval.chain_violations(faulty)


# ---- evaluation -------------------------------------------------------------------------------------------------------

_RESULTS = f"""top AS (SELECT query_id, q.label, chunk_id, s.label AS l, row_number() OVER (PARTITION BY query_id ORDER BY {_IP} DESC, chunk_id) AS rank FROM questions q, store s WHERE s.vec_id <> query_id QUALIFY rank <= 10),
truth AS (SELECT query_id, count(*) - 1 AS n FROM questions q JOIN store s ON s.label IS NOT DISTINCT FROM q.label GROUP BY 1), rel AS (SELECT query_id, rank, l = label AS r FROM top),
m AS (SELECT query_id, bool_or(r) AS hit_rate, coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE r), 0.0) AS mrr, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE r), 0.0) AS dcg, count(*) AS k FROM rel GROUP BY 1),
scored AS (SELECT query_id, hit_rate, mrr, CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE dcg / list_sum(list_transform(range(1, least(n, k)::BIGINT + 1), lambda i: 1 / log2(i + 1))) END AS ndcg FROM m LEFT JOIN truth USING (query_id))"""


def _judged(spark, sf_dir) -> DataFrame:
    """Every vector whose id is divisible by 100 asks for all others of its label."""
    store = fx.store(spark, sf_dir).select("chunk_id", "vec_id", "label", "vector")
    asked = fx.questions(spark, sf_dir).select("query_id", "query_vector", F.col("label").alias("own"))
    found = retrieval.dense_search(asked, store, 11).where(F.col("query_id").cast("string") != F.col("chunk_id"))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where("rank <= 10")
    sizes = store.groupBy(F.col("label").alias("own")).agg((F.count("*") - 1).alias("n_truth"))
    truths = asked.select("query_id", "own").join(sizes, "own", "left").withColumn("n_truth", F.coalesce("n_truth", F.lit(0)))
    hits = found.join(store.select("chunk_id", "label"), "chunk_id").join(asked.select("query_id", "own"), "query_id").withColumn("relevant", F.col("own") == F.col("label"))
    return evaluation.score_judged(hits, truths, k=10)


@query(f"WITH {fx.STORE}, {fx.QUESTIONS}, {_RESULTS} SELECT query_id, hit_rate, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg FROM scored")
def retrieval_metrics(spark, sf_dir):
    return _judged(spark, sf_dir).select("query_id", "hit_rate", F.round("mrr", 9).alias("mrr"), F.round("ndcg", 9).alias("ndcg"))


@query(f"""WITH {fx.STORE}, {fx.QUESTIONS}, {_RESULTS} SELECT round(avg(hit_rate::INT) FILTER (WHERE query_id % 9 <> 8), 9) AS hit_rate, round(avg(mrr) FILTER (WHERE query_id % 9 <> 8), 9) AS mean_mrr, round(avg(ndcg) FILTER (WHERE query_id % 9 <> 8), 9) AS mean_ndcg, 0.0::DOUBLE AS mean_latency,
 count(*) AS total_questions, count(*) FILTER (WHERE query_id % 9 <> 8) AS valid_questions, count(*) FILTER (WHERE query_id % 9 = 8) AS failed_questions FROM scored""")
def retrieval_metrics_agg(spark, sf_dir):
    """Means over the questions without an error; some are given one."""
    scored = _judged(spark, sf_dir).withColumn("error", F.when(F.col("query_id") % 9 == 8, "failed"))
    return evaluation.aggregate(scored).select(*[F.round(c, 9).alias(c) for c in ("hit_rate", "mean_mrr", "mean_ndcg")], "mean_latency", "total_questions", "valid_questions", "failed_questions")


@query(f"""WITH {fx.STORE}, {fx.QUESTIONS}, {_reranked(100, 5)}, m AS (SELECT query_id, array_to_string(list(chunk_id ORDER BY rr), ',') AS retrieved, min(rr) FILTER (WHERE chunk_id = query_id::VARCHAR) AS place FROM r GROUP BY 1)
SELECT query_id, md5(query) AS question_md5, query_id::VARCHAR AS truth, coalesce(retrieved, '') AS retrieved, place IS NOT NULL AS hit_rate, round(coalesce(1.0::DOUBLE / place, 0), 9) AS mrr, round(coalesce(1 / log2(place + 1), 0.0::DOUBLE), 9) AS ndcg, NULL::VARCHAR AS error
FROM questions LEFT JOIN m USING (query_id)""")
def evaluation_run(spark, sf_dir):
    store = fx.store(spark, sf_dir)
    asked = fx.questions(spark, sf_dir)
    items = asked.select("query_id", F.col("query").alias("question"), F.array(F.col("query_id").cast("string")).alias("ground_truth_context"))
    vectors_of = asked.select("query_id", "query_vector")
    run = evaluation.run_evaluation(items, lambda q: retrieval.retrieve(q.join(vectors_of, "query_id"), store, top_k_rerank=5), top_k=5)
    return run.select(
        "query_id", F.md5(F.col("question").cast("binary")).alias("question_md5"), F.array_join("ground_truth_ids", ",").alias("truth"), F.array_join("retrieved_ids", ",").alias("retrieved"), "hit_rate",
        F.round("mrr", 9).alias("mrr"), F.round("ndcg", 9).alias("ndcg"), "error",
    )


# ---- text -------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_sha256 FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text"), F.lit("")).alias("content_sha256"))


@query("SELECT page_id, substring(sha256(url), 1, 16) AS document_id FROM pages")
def path_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.path_id(F.col("url")).alias("document_id"))


@query("SELECT doc_id, greatest(1, round_even(len(regexp_extract_all(coalesce(text, ''), '[\\pL\\pN_]+|\\S')) / 0.75::DOUBLE, 0))::INT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


@query(
    "WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '\\n{2,}'), lambda x: regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)"
    " SELECT doc_id, md5(coalesce(array_to_string(l, chr(10) || chr(10)), '')) AS normalized_md5 FROM p"
)
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize(F.col("text")).cast("binary")).alias("normalized_md5"))


_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, md5(array_to_string(w[1:50], ' ')) AS head, md5(array_to_string(w[greatest(len(w) - 49, 1):len(w)], ' ')) AS tail,
 md5(CASE WHEN len(w) <= 50 THEN array_to_string(w, ' ') ELSE array_to_string(list_concat(w[1:35], w[len(w) - 14:len(w)]), ' ') END) AS head_tail FROM w""")
def truncation(spark, sf_dir):
    words = text.words(F.col("text"))
    cut = [F.md5(F.array_join(text.truncate(words, 50, s), " ").cast("binary")).alias(s) for s in ("head", "tail", "head_tail")]
    return table(spark, sf_dir, "documents").select("doc_id", *cut)


@query("""SELECT doc_id, md5(CASE WHEN lower(coalesce(text, '')) LIKE 'passage:%' THEN text ELSE 'passage: ' || coalesce(text, '') END) AS passage_md5, md5(regexp_replace('query: ' || coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS query_md5 FROM documents""")
def prefixes(spark, sf_dir):
    body = text.empty_if_null(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[F.md5(made(body).cast("binary")).alias(n) for n, made in (("passage_md5", text.document_prefix), ("query_md5", text.query_prefix))])


_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


@query(f"""WITH w AS (SELECT doc_id, {_TOKENS.format("coalesce(text, '')")} AS a FROM documents), t AS (SELECT w.doc_id, w.a, coalesce(z.a, []) AS b FROM w LEFT JOIN w z ON z.doc_id = w.doc_id + 1), n AS (SELECT *, len(list_intersect(a, b))::DOUBLE AS i FROM t),
r AS (SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE i / (len(a) + len(b) - i) END AS jaccard, CASE WHEN len(a) = 0 THEN 1.0 WHEN len(b) = 0 THEN 0.0 ELSE i / len(a) END AS recall,
 CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 THEN 0.0 WHEN len(b) = 0 THEN 1.0 ELSE i / len(b) END AS "precision" FROM n)
SELECT doc_id, round(jaccard, 9) AS jaccard, round(recall, 9) AS recall, round("precision", 9) AS "precision", round(CASE WHEN recall + "precision" > 0 THEN 2 * recall * "precision" / (recall + "precision") ELSE 0 END, 9) AS f1 FROM r""")
def text_prf(spark, sf_dir):
    """Each whole text with the whole text of the next id, an empty one where there is none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(text.ascii_tokens(F.col("text"))).alias("a"))
    beside = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return _compared(docs.join(beside, "doc_id", "left").withColumn("b", F.coalesce("b", F.array().cast("array<string>"))))


def _compared(rows: DataFrame) -> DataFrame:
    """Similarities of the word sets a and b, in which no word repeats."""
    sizes = rows.select("doc_id", F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.size(F.array_intersect("a", "b")).alias("n_both"))
    found = text.similarities(F.col("n_a"), F.col("n_b"), F.col("n_both"))
    return sizes.select("doc_id", *[F.round(c, 9).alias(n) for n, c in zip(("jaccard", "recall", "precision", "f1"), found, strict=True)])


@query("""WITH s AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Part ' || page_id || ' (AB' || page_id || ') >  Scope:  > ' WHEN 1 THEN '(JWL4) > (XY-01)' WHEN 2 THEN '' ELSE ' - Intro (continued)  >Two   words;' END AS p, page_id::INT % 9 AS l FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Part ' || page_id || ' > Scope' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'Intro (continued) > Two words' END AS section_path, greatest(1, least(6, l)) AS section_level FROM s""")
def section_cleanup(spark, sf_dir):
    n, name = F.col("page_id") % 4, F.col("page_id").cast("string")
    path = (
        F.when(n == 0, F.concat(F.lit("Part "), name, F.lit(" (AB"), name, F.lit(") >  Scope:  > "))).when(n == 1, "(JWL4) > (XY-01)").when(n == 2, "").otherwise(" - Intro (continued)  >Two   words;")
    )
    return table(spark, sf_dir, "pages").select("page_id", text.section_path(path).alias("section_path"), text.section_level((F.col("page_id") % 9).cast("int")).alias("section_level"))


@query("""SELECT item_id, md5('Answer the question from the context alone. If the context does not hold the answer, say so.' || chr(10) || chr(10) || 'Context:' || chr(10) || '[1] ' || text || chr(10) || chr(10) || '[2] second' || chr(10) || chr(10) || 'Question: who?' || chr(10) || 'Answer:') AS prompt_md5 FROM benchmark""")
def prompt_render(spark, sf_dir):
    made = text.prompt(F.lit("who?"), F.array(F.col("text"), F.lit("second")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(made.cast("binary")).alias("prompt_md5"))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM e")
def l2_normalize(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(vectors.l2_normalized(v), F.lit(0)), 6).alias("first"), F.round(vectors.norm(v), 6).alias("norm"))


# ---- layout -----------------------------------------------------------------------------------------------------------

_COLL = fx.COLLAPSE.format("text")
_STRIP = fx.STRIP.format("text")
_ROLE = """CASE WHEN type = 'Title' THEN 'title' WHEN type = 'Table' THEN 'table' WHEN type = 'Image' THEN 'figure' WHEN type = 'FigureCaption' THEN 'caption' WHEN type IN ('NarrativeText', 'ListItem') THEN 'paragraph'
 WHEN regexp_matches(text, '(?i)^\\s*(?:Figure|Table)\\s+[\\dA-Za-z\\-\\.]+') THEN 'caption' WHEN regexp_matches(text, '^(\\d+(\\.\\d+){0,3})\\s+\\S+') AND length(text) < 200 THEN 'h2'
 WHEN length(text) BETWEEN 3 AND 80 AND len(regexp_extract_all(text, '[\\pL\\pN_]')) > 0 AND len(regexp_extract_all(text, '\\p{Lu}')) > 0.7 * len(regexp_extract_all(text, '[\\pL\\pN_]')) THEN 'h2' ELSE 'paragraph' END"""


@query(f"WITH {fx.ELEMENTS} SELECT doc_id, ord, {_ROLE} AS role FROM elements")
def role_classify(spark, sf_dir):
    return fx.elements(spark, sf_dir).select("doc_id", "ord", text.role(F.col("type"), F.col("text")).alias("role"))


@query(f"""WITH {fx.ELEMENTS}, r AS (SELECT doc_id, ord, {_ROLE} AS role, {_STRIP} AS s FROM elements) SELECT doc_id, ord, CASE WHEN regexp_matches(s, '^(\\d+(?:\\.\\d+)*)\\b') THEN CASE WHEN len(regexp_extract_all(s, '[\\pL\\pN_]+')) <= 25 THEN len(regexp_extract_all(s, '\\.')) + 1 END
 WHEN role IN ('title', 'h1') THEN 1 WHEN len(regexp_extract_all(s, '[\\pL\\pN_]+')) BETWEEN 1 AND 15 AND len(regexp_extract_all(s, '[A-Za-z]')) > 0 AND len(regexp_extract_all(s, '[A-Z]')) >= 0.70 * len(regexp_extract_all(s, '[A-Za-z]')) THEN 2 END::INT AS level FROM r""")
def heading_levels(spark, sf_dir):
    role = text.role(F.col("type"), F.col("text"))
    return fx.elements(spark, sf_dir).select("doc_id", "ord", text.heading_level(role, F.col("text")).alias("level"))


@query(f"WITH {fx.ELEMENTS}, {fx.PAGES.format(source='elements')} SELECT doc_id, page_number, width, height FROM pages_")
def page_size(spark, sf_dir):
    return layout.page_sizes(fx.elements(spark, sf_dir))


def _boxed(spark, sf_dir) -> DataFrame:
    elements = fx.elements(spark, sf_dir)
    return layout.with_boxes(elements)


_BOXES = f"{fx.ELEMENTS}, {fx.PAGES.format(source='elements')}, {fx.BOXED.format(source='elements')}"


@query(f"WITH {_BOXES} SELECT doc_id, ord, round(bx1, 9) AS x1, round(by1, 9) AS y1, round(bx2, 9) AS x2, round(by2, 9) AS y2, round(bx1 * page_width, 6) AS abs_x1, round(by2 * page_height, 6) AS abs_y2 FROM boxes")
def bbox_normalize(spark, sf_dir):
    boxed = _boxed(spark, sf_dir).withColumn("a", geometry.absolute(F.col("bbox"), F.col("page_width"), F.col("page_height")))
    return boxed.select("doc_id", "ord", *[F.round(f"bbox.{k}", 9).alias(k) for k in ("x1", "y1", "x2", "y2")], F.round("a.x1", 6).alias("abs_x1"), F.round("a.y2", 6).alias("abs_y2"))


@query(f"WITH {_BOXES} SELECT doc_id, page_number, round(min(bx1), 9) AS x1, round(min(by1), 9) AS y1, round(max(bx2), 9) AS x2, round(max(by2), 9) AS y2 FROM boxes GROUP BY 1, 2")
def bbox_union(spark, sf_dir):
    around = _boxed(spark, sf_dir).groupBy("doc_id", "page_number").agg(geometry.union(F.col("bbox")).alias("b"))
    return around.select("doc_id", "page_number", *[F.round(f"b.{k}", 9).alias(k) for k in ("x1", "y1", "x2", "y2")])


_WC = f"len(list_filter(string_split({_COLL}, ' '), lambda w: w <> ''))"
_TOC = f"""k AS (SELECT *, {_COLL} AS line, {_STRIP} AS raw, {_WC} AS wc, max(page_number) OVER (PARTITION BY doc_id) AS last FROM elements),
early AS (SELECT *, page_number IS NOT NULL AND page_number <= greatest(5, floor(last * 0.20)) AND length(text) > 0 AS e FROM k),
kinds AS (SELECT *, CASE WHEN NOT coalesce(e, false) THEN 0 WHEN regexp_matches(line, '(?i)^\\s*TABLE\\s+OF\\s+CONTENTS\\s*$') THEN 2
 WHEN type = 'Table' AND length(raw) > 500 AND (contains(upper(raw), 'TABLE OF CONTENTS') OR contains(upper(raw), 'LIST OF FIGURES') OR contains(upper(raw), 'LIST OF TABLES') OR (length(raw) - length(replace(raw, '....', ''))) / 4 > 5 OR len(regexp_extract_all(raw, '(?m)\\d+\\s*$')) > 10) THEN 1
 WHEN type = 'Table' AND length(raw) > 200 AND (contains(raw, 'Table of Contents') OR contains(raw, 'List of Figures') OR contains(raw, 'List of Tables') OR contains(raw, 'Chapter ')) AND regexp_matches(lower(raw), 'renumber|revise|insert') THEN 2
 WHEN length(line) <= 200 AND (regexp_matches(line, '(?i)^\\s*LIST\\s+OF\\s+(FIGURES|TABLES|APPENDICES)\\s*$') OR regexp_matches(line, '^.*\\.{{3,}}\\s*\\d+\\s*$') OR regexp_matches(line, '^.*\\.{{2,}}\\s*\\d{{1,4}}\\s*$')
  OR regexp_matches(line, '(?i)^\\s*(Chapter|Section|Part|Appendix|Figure|Table)\\s+[\\d\\w]') OR regexp_matches(line, '(?i)^\\s*\\d+(\\.\\d+)*\\s+[A-Z]') OR regexp_matches(line, '(?i)^\\s*[A-Z]+(\\.\\d+)*\\s+[A-Z]')
  OR (wc <= 15 AND regexp_matches(line, '^(\\d+\\.?\\d*|[\\pL\\pN_]+\\.?\\d*)\\s+\\S') AND regexp_matches(line, '(^|[^\\pL\\pN_])\\d{{1,4}}\\s*$')) OR (wc <= 15 AND len(regexp_extract_all(line, '\\.')) > wc AND len(regexp_extract_all(line, '\\.')) > 5)) THEN 2 ELSE 0 END AS kind FROM early),
dens AS (SELECT *, count(*) FILTER (WHERE kind = 2) OVER (PARTITION BY doc_id, page_number) AS c, count(*) FILTER (WHERE e) OVER (PARTITION BY doc_id, page_number) AS n FROM kinds),
toc AS (SELECT * EXCLUDE (k), (is_toc OR kind = 1 OR (kind = 2 AND ((c > 0.3 * n AND c >= 2) OR c >= 5))) AND last IS NOT NULL AS contents FROM (SELECT *, 0 AS k FROM dens))"""


@query(f"WITH {fx.ELEMENTS}, {_TOC} SELECT doc_id, ord, contents FROM toc")
def toc_filter(spark, sf_dir):
    return layout.contents_flags(fx.elements(spark, sf_dir)).select("doc_id", "ord", "contents")


_MARGIN = f"""np AS (SELECT doc_id, count(DISTINCT page_number) AS np FROM boxes WHERE page_number IS NOT NULL GROUP BY 1), lined AS (SELECT *, {_COLL} AS line, (by1 + by2) / 2 AS yc FROM boxes),
st AS (SELECT doc_id, line, count(DISTINCT page_number) AS lp, count(yc) AS ny, stddev_pop(yc) AS sd FROM lined WHERE page_number IS NOT NULL AND line <> '' AND length(line) <= 150 GROUP BY 1, 2),
bp AS (SELECT doc_id, line, lp, lp >= greatest(2, np // 3) AND (ny <= 1 OR sd < 0.05) AS bad FROM st JOIN np USING (doc_id)),
flagged AS (SELECT l.*, CASE WHEN page_number IS NULL THEN false WHEN type = 'Image' AND image_path <> '' THEN false WHEN l.line = '' THEN true WHEN coalesce(bad, false) THEN true
 WHEN coalesce(yc < 0.12 OR yc > 0.88, false) AND CASE WHEN regexp_matches(l.line, '(?i)^\\s*(\\d+\\s+(of|/)\\s+\\d+|page\\s+\\d+|\\d+)\\s*$') THEN true WHEN regexp_matches(l.line, '^[A-Z]{{2,}}-[A-Z0-9\\-\\.]+[A-Z0-9]$') THEN true
  WHEN length(l.line) < 50 AND len(list_filter(string_split(l.line, ' '), lambda w: w <> '')) <= 5 THEN coalesce(lp > 1, false) ELSE regexp_matches(lower(l.line), 'copyright|©|confidential|proprietary|www\\.|http') END THEN true
 ELSE regexp_matches(l.line, '(?i)^\\s*\\d+\\s+of\\s+\\d+\\s*$') END AS margin FROM lined l LEFT JOIN bp USING (doc_id, line))"""


@query(f"WITH {_BOXES}, {_MARGIN} SELECT doc_id, ord, margin FROM flagged")
def header_footer_filter(spark, sf_dir):
    return layout.margin_flags(_boxed(spark, sf_dir)).select("doc_id", "ord", "margin")


_MERGE = f"""tl AS (SELECT doc_id, page_number, list_sort(list(by2 - by1) FILTER (WHERE x1 IS NOT NULL)) AS hs FROM boxes WHERE page_number IS NOT NULL GROUP BY 1, 2),
tol AS (SELECT doc_id, page_number, CASE WHEN len(hs) > 0 THEN greatest(0.006, hs[len(hs) // 2 + 1] * 0.6) ELSE 0.012 END AS tol FROM tl),
pl AS (SELECT b.*, {_ROLE} AS role, min(ord) OVER (PARTITION BY doc_id, page_number) AS page_ord, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY round_even(coalesce(by1, 0.0) / tol, 0), coalesce(bx1, 0.0), ord) AS rk FROM boxes b JOIN tol USING (doc_id, page_number) WHERE page_number IS NOT NULL),
atom AS (SELECT *, role IN ('table', 'figure', 'caption', 'title', 'h2') AS a FROM pl), isl AS (SELECT *, sum(a::INT) OVER (PARTITION BY doc_id, page_number ORDER BY rk) * 2 - a::INT AS island FROM atom),
g AS (SELECT doc_id, page_number AS page, page_ord, min(rk) AS fr, bool_or(a) AS a, min_by(role, rk) AS r0, array_to_string(list_filter(list(CASE WHEN a THEN text ELSE {_STRIP} END ORDER BY rk), lambda t: t <> ''), ' ') AS text, array_to_string(list(ord ORDER BY rk), ',') AS ids, min(by1) AS y1, max(by2) AS y2 FROM isl GROUP BY doc_id, page_number, page_ord, island),
blocks AS (SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id ORDER BY page_ord, fr) - 1)::INT AS ord, CASE WHEN a THEN r0 ELSE 'paragraph' END AS role, text, ids, y1, y2 FROM g WHERE a OR text <> '')"""


@query(f"WITH {_BOXES}, {_MERGE} SELECT doc_id, page, ord, role, md5(text) AS text_md5, ids, round(y1, 9) AS y1, round(y2, 9) AS y2 FROM blocks")
def merge_text(spark, sf_dir):
    blocks = layout.merge_text(_boxed(spark, sf_dir))
    return blocks.select(
        "doc_id", "page", "ord", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.array_join("element_ids", ",").alias("ids"), F.round("bbox.y1", 9).alias("y1"), F.round("bbox.y2", 9).alias("y2")
    )


@query(f"""WITH {_BOXES}, {_MERGE}, h AS (SELECT *, CASE WHEN role = 'caption' THEN max(CASE WHEN role IN ('figure', 'table') THEN ord END) OVER (PARTITION BY doc_id, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS holder FROM blocks),
c AS (SELECT doc_id, holder AS ord, array_to_string(list(text ORDER BY ord), chr(10)) AS caps FROM h WHERE holder IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, page, ord, role, md5(CASE WHEN caps IS NULL THEN text WHEN text = '' THEN caps ELSE text || chr(10) || caps END) AS text_md5 FROM h LEFT JOIN c USING (doc_id, ord) WHERE holder IS NULL""")
def attach_captions(spark, sf_dir):
    out = layout.attach_captions(layout.merge_text(_boxed(spark, sf_dir)))
    return out.select("doc_id", "page", "ord", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {fx.CHUNKS}, t AS (SELECT doc_id, page_start, greatest(0.006, median(greatest(1e-6, y2 - y1)) * 0.6) AS tol FROM chunks GROUP BY 1, 2)
SELECT doc_id, ord, (row_number() OVER (PARTITION BY doc_id ORDER BY page_start, round_even(y1 / tol, 0), ord) - 1)::INT AS order_rank FROM chunks JOIN t USING (doc_id, page_start)""")
def reading_order(spark, sf_dir):
    return layout.reading_order(fx.chunks(spark, sf_dir)).select("doc_id", "ord", "order_rank")


@query(f"""WITH {fx.ELEMENTS}, c AS (SELECT doc_id, ord, [ord - 1, ord, ord + 1, ord + 2] AS ids FROM elements WHERE ord % 5 = 0), u AS (SELECT doc_id, ord, unnest(range(4)) AS pos, unnest(ids) AS eid FROM c)
SELECT u.doc_id, 'c' || u.ord AS chunk_id, coalesce(min_by(e.image_path, pos) FILTER (WHERE e.image_path <> ''), '') AS image_path FROM u LEFT JOIN elements e ON e.doc_id = u.doc_id AND e.ord = u.eid AND e.type = 'Image' GROUP BY 1, u.ord""")
def figure_images(spark, sf_dir):
    elements, o = fx.elements(spark, sf_dir), F.col("ord")
    chunks = elements.where(o % 5 == 0).select("doc_id", F.concat(F.lit("c"), o.cast("string")).alias("chunk_id"), F.array(o - 1, o, o + 1, o + 2).alias("source_element_ids"))
    return layout.figure_images(chunks, elements)


# ---- chunks -----------------------------------------------------------------------------------------------------------


@query()
def chunk_assemble(spark, sf_dir):
    return chunking.run_chunking(fx.elements(spark, sf_dir))[0]


@query()
def manifest_counts(spark, sf_dir):
    found = chunking.run_chunking(fx.elements(spark, sf_dir), stored=True)[1]
    return found.select("doc_id", F.to_json("counts").alias("counts"), F.size("pages").alias("n_pages"))


_BODY = f"""{fx.ELEMENTS}, {_TOC}, body AS (SELECT doc_id, doc, ord, page_number, type, text, image_path, x1, y1, x2, y2, lw, lh, given, is_toc FROM toc WHERE NOT coalesce(contents, false)), {fx.PAGES.format(source='body')}, {fx.BOXED.format(source='body')}, {_MARGIN},
inner_ AS (SELECT * EXCLUDE (line, yc, margin) FROM flagged WHERE NOT coalesce(margin, false))"""


_INNER_MERGE = _MERGE.replace("FROM boxes WHERE page_number", "FROM inner_ WHERE page_number").replace("FROM boxes b JOIN tol", "FROM inner_ b JOIN tol")


@query(f"""WITH {_BODY}, {_INNER_MERGE}, h AS (SELECT *, CASE WHEN role = 'caption' THEN max(CASE WHEN role IN ('figure', 'table') THEN ord END) OVER (PARTITION BY doc_id, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS holder FROM blocks),
c AS (SELECT doc_id, holder AS ord, array_to_string(list(text ORDER BY ord), chr(10)) AS caps FROM h WHERE holder IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, page, ord, role, md5(CASE WHEN caps IS NULL THEN text WHEN text = '' THEN caps ELSE text || chr(10) || caps END) AS text_md5, ids, round(y1, 9) AS y1, round(y2, 9) AS y2 FROM h LEFT JOIN c USING (doc_id, ord) WHERE holder IS NULL""")
def chunk_blocks_in(spark, sf_dir):
    """The blocks that assembly gets: contents and margins out, boxes, merged text, captions attached."""
    blocks = chunking.blocks_of(fx.elements(spark, sf_dir))[0]
    return blocks.select("doc_id", "page", "ord", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.array_join("element_ids", ",").alias("ids"), F.round("bbox.y1", 9).alias("y1"), F.round("bbox.y2", 9).alias("y2"))


_CHECKS = "role IN ('title', 'h1', 'h2', 'h3', 'paragraph', 'list_item', 'caption', 'table', 'figure', 'other')"
_QC = f"""w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY ord) AS rn, lag(page_start) OVER d AS pp, lag(order_rank) OVER d AS pr FROM chunks WINDOW d AS (PARTITION BY doc_id ORDER BY ord)),
v AS (SELECT doc_id, 'duplicate' AS rule, ord, chunk_id FROM w WHERE rn > 1 UNION ALL SELECT doc_id, 'bbox', ord, chunk_id FROM w WHERE y2 > 1 UNION ALL SELECT doc_id, 'coord_system', ord, chunk_id FROM w WHERE coord_system <> 'top-left'
 UNION ALL SELECT doc_id, 'order', ord, chunk_id FROM w WHERE pp = page_start AND order_rank < pr UNION ALL SELECT doc_id, 'blank', ord, chunk_id FROM w WHERE role <> 'figure' AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') = ''
 UNION ALL SELECT doc_id, 'role', ord, chunk_id FROM w WHERE NOT {_CHECKS})"""


@query(f"WITH {fx.CHUNKS}, {_QC} SELECT doc_id, rule, ord, chunk_id FROM v")
def qc_violations(spark, sf_dir):
    return curation.violations(fx.chunks(spark, sf_dir)).drop("detail")


@query(f"WITH {fx.CHUNKS}, {_QC} SELECT doc_id, min_by(rule, (ord, rule)) AS rule, min(ord) AS ord FROM v GROUP BY 1")
def qc_first_violation(spark, sf_dir):
    return curation.first_violation(fx.chunks(spark, sf_dir)).select("doc_id", "rule", "ord")


_UNIQUE = f"""u AS (SELECT * FROM chunks WHERE NOT (content_sha256 <> '' AND role = 'figure' AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' AND image_path = '')
 QUALIFY content_sha256 = '' OR row_number() OVER (PARTITION BY content_sha256 ORDER BY doc_id, ord) = 1)"""


@query(f"WITH {fx.CHUNKS}, {_UNIQUE} SELECT doc_id, ord, content_sha256 FROM u")
def dedup_exact(spark, sf_dir):
    return curation.unique_chunks(fx.chunks(spark, sf_dir)).select("doc_id", "ord", "content_sha256")


@query(f"WITH {fx.CHUNKS}, {_UNIQUE}, n AS (SELECT (SELECT count(*) FROM chunks) AS o, (SELECT count(*) FROM u) AS k) SELECT o AS original, k AS \"unique\", o - k AS removed, round((o - k) / o, 9) AS rate FROM n")
def dedup_stats(spark, sf_dir):
    chunks = fx.chunks(spark, sf_dir)
    return curation.duplicate_stats(chunks, curation.unique_chunks(chunks)).withColumn("rate", F.round("rate", 9))


@query(f"""WITH {fx.CHUNKS}, {_UNIQUE} SELECT doc_id, ord, chunk_id, (row_number() OVER d - 1)::INT AS order_rank, lag(chunk_id) OVER d AS prev_id, lead(chunk_id) OVER d AS next_id FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY ord)""")
def dedup_relink(spark, sf_dir):
    kept = curation.relink(curation.unique_chunks(fx.chunks(spark, sf_dir)))
    return kept.select("doc_id", "ord", "chunk_id", "order_rank", "prev_id", "next_id")


_POLICY = "roles=title,h1,paragraph,table|min_len=25|skip_empty_figures|unknown"
_SELECTED = f"sel AS (SELECT * FROM chunks WHERE role IN ('title', 'paragraph', 'table') AND (length({_STRIP}) >= 25 OR role = 'table'))"


@query(f"WITH {fx.CHUNKS}, {_SELECTED} SELECT doc_id, ord, role FROM sel")
def policy_select(spark, sf_dir):
    return embedding.select_chunks(fx.chunks(spark, sf_dir), _POLICY).select("doc_id", "ord", "role")


@query(f"WITH {fx.CHUNKS} SELECT doc_id, ord, role FROM chunks WHERE role IN ('paragraph', 'figure') AND length({_STRIP}) >= 5")
def policy_select_figures(spark, sf_dir):
    return embedding.select_chunks(fx.chunks(spark, sf_dir), "roles=paragraph|min_len=5").select("doc_id", "ord", "role")


@query(f"WITH {fx.CHUNKS}, {_SELECTED} SELECT doc_id, ord, lag(chunk_id) OVER d AS prev_id, lead(chunk_id) OVER d AS next_id FROM sel WINDOW d AS (PARTITION BY doc_id ORDER BY ord)")
def policy_rewire(spark, sf_dir):
    return embedding.rewire(embedding.select_chunks(fx.chunks(spark, sf_dir), _POLICY)).select("doc_id", "ord", "prev_id", "next_id")


@query(f"""WITH {fx.CHUNKS}, {_SELECTED}, f AS (SELECT doc_id, ord, CASE WHEN lower(text) LIKE 'passage:%' THEN text ELSE 'passage: ' || text END AS t FROM sel)
SELECT doc_id, ord, sha256('hash-words chunk-v1 ' || sha256(t) || ' head(512) True') AS key FROM f""")
def cache_keys(spark, sf_dir):
    rows = embedding.select_chunks(fx.chunks(spark, sf_dir), _POLICY).withColumn("full", text.document_prefix(F.col("text")))
    return rows.select("doc_id", "ord", embedding.cache_key("hash-words", F.col("full"), "head(512)", True).alias("key"))


@query()
def embed_vectors(spark, sf_dir):
    found, _ = embedding.embed_chunks(fx.chunks(spark, sf_dir), _POLICY)
    return found.drop("created_at").withColumn("vector", F.transform("vector", lambda x: F.round(x, 4)))


@query(f"""WITH {fx.CHUNKS}, {_SELECTED}, f AS (SELECT ord, sha256('hash-words chunk-v1 ' || sha256(CASE WHEN lower(text) LIKE 'passage:%' THEN text ELSE 'passage: ' || text END) || ' head(512) True') AS key FROM sel)
SELECT DISTINCT key FROM f WHERE key NOT IN (SELECT key FROM f WHERE ord % 2 = 0)""")
def embed_cache_misses(spark, sf_dir):
    half = fx.chunks(spark, sf_dir).where("ord % 2 = 0")
    cache = embedding.embed_chunks(half, _POLICY)[1].select("key", "vector")
    return embedding.embed_chunks(fx.chunks(spark, sf_dir), _POLICY, cache=cache)[1].select("key")


@query("SELECT 0::BIGINT AS different")
def determinism(spark, sf_dir):
    """Two runs in two jobs: in one query Spark would make both from one exchange."""
    first, second = (curation.digests(chunking.run_chunking(fx.elements(spark, sf_dir))[0]) for _ in range(2))
    return curation.compared(storage.written(spark, first, "digests"), second).agg(F.count("*").alias("different"))


@query(f"""WITH {fx.CHUNKS}, n AS (SELECT doc, count(*) AS n FROM lines GROUP BY 1), k AS (SELECT *, doc % 6 AS k FROM n)
SELECT CASE WHEN k = 4 THEN 'new ' || doc ELSE doc::VARCHAR END AS doc_id, CASE WHEN k = 4 THEN 0 ELSE n END AS n_before, CASE k WHEN 2 THEN n - 1 WHEN 3 THEN n + 1 ELSE n END AS n_after,
 CASE k WHEN 1 THEN 'content' WHEN 4 THEN 'added' ELSE CASE WHEN k = 2 AND n = 1 THEN 'removed' ELSE 'rows' END END AS change FROM k WHERE k BETWEEN 1 AND 4
UNION ALL SELECT doc::VARCHAR, n, 0, 'removed' FROM k WHERE k = 4""")
def digest_changes(spark, sf_dir):
    """Two runs, compared by digests: a changed text, a lost row, a repeated row, another id; and rows in another order, which is none."""
    before = fx.chunks(spark, sf_dir)
    kind, first = F.col("doc_id").cast("long") % 6, F.col("ord") == 0
    after = before.where(~((kind == 2) & first)).unionByName(before.where((kind == 3) & first)).repartition("chunk_id")
    after = after.withColumn("text", F.when((kind == 1) & first, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return curation.changed(before, after.withColumn("doc_id", F.when(kind == 4, F.concat(F.lit("new "), "doc_id")).otherwise(F.col("doc_id"))))


# ---- tokens -----------------------------------------------------------------------------------------------------------

_CUT = "CASE WHEN length(t) > 512 THEN {0} ELSE t END"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, length(t) AS n_tokens, md5({_CUT.format("left(t, 512)")}) AS head, md5({_CUT.format("right(t, 512)")}) AS tail, md5({_CUT.format("left(t, 358) || right(t, 154)")}) AS head_tail FROM d""")
def token_truncation(spark, sf_dir):
    """Whole texts cut on their token ids and decoded, by a tokenizer whose ids are code points."""
    body, tokenizer = F.coalesce("text", F.lit("")), tokens.CodePoints()
    cuts = tokens.with_cuts(table(spark, sf_dir, "documents").select("doc_id", body.alias("body")), "body", tokenizer, 512)
    return cuts.select("doc_id", "n_tokens", *[F.md5(F.col(s).cast("binary")).alias(s) for s in ("head", "tail", "head_tail")])


@query("""WITH d AS (SELECT doc_id, left(coalesce(text, ''), 512) AS t FROM documents), c AS (SELECT doc_id, unicode(substring(t, i, 1)) AS id FROM (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS i FROM d)),
n AS (SELECT doc_id, id, count(*) AS n FROM c GROUP BY 1, 2), s AS (SELECT doc_id, j, sum(n * ((id * (2 * j + 1) + j) % 257 - 128))::DOUBLE / sum(n)::DOUBLE AS m FROM n, range(8) r(j) GROUP BY 1, 2),
v AS (SELECT doc_id, list(m ORDER BY j) AS v FROM s GROUP BY 1), l AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM v)
SELECT doc_id, r.j::INT AS component, round(coalesce((CASE WHEN l > 1e-12 THEN v[r.j + 1] / l ELSE v[r.j + 1] END)::FLOAT::DOUBLE, 0), 6) AS value FROM d LEFT JOIN l USING (doc_id), range(8) r(j)""")
def pooled_vectors(spark, sf_dir):
    """Every document through tokenizer, padded batches and masked mean pooling; texts of any length, also none."""
    encoder = tokens.PooledEncoder(tokens.CodePoints(), tokens.TokenTable(dimension=8, longest=512))
    found = table(spark, sf_dir, "documents").select("doc_id", embedding.embed(F.coalesce("text", F.lit("")), encoder).alias("v"))
    return found.select("doc_id", F.posexplode("v").alias("component", "x")).select("doc_id", "component", F.round(F.col("x").cast("double"), 6).alias("value"))


@query(f"""WITH {fx.CHUNKS}, a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM chunks),
n AS (SELECT (SELECT count(*) FROM a) AS source_terms, (SELECT count(*) FROM b) AS parsed_terms, (SELECT count(*) FROM a JOIN b USING (term)) AS common_terms)
SELECT *, common_terms / source_terms AS recall, common_terms / parsed_terms AS "precision", 2 * common_terms / (source_terms + parsed_terms) AS f1 FROM n""")
def vocabulary_overlap(spark, sf_dir):
    """The words of all documents and those of their chunks, some of which have lost their text."""
    return curation.vocabulary_overlap(table(spark, sf_dir, "documents"), fx.chunks(spark, sf_dir))


# ---- parser quality and parsing ---------------------------------------------------------------------------------------


@query(f"""WITH {fx.ELEMENTS}, {fx.PAGES.format(source='elements')}, b AS (SELECT doc_id, coalesce(page_number, 1) AS page_number, ord, coalesce(x1, 0.0) AS x1, coalesce(y1, 0.0) AS y1, coalesce(x2, 0.0) AS x2, coalesce(y2, 0.0) AS y2 FROM elements),
z AS (SELECT b.*, coalesce(width, 0.0) AS w, coalesce(height, 0.0) AS h FROM b LEFT JOIN pages_ USING (doc_id, page_number)),
s AS (SELECT doc_id, page_number, count(*) AS n, avg((x2 > x1 AND y2 > y1 AND x1 >= -2 AND y1 >= -2 AND x2 <= w + 2 AND y2 <= h + 2)::INT) AS ib, sum(greatest(0, x2 - x1) * greatest(0, y2 - y1)) AS area, max(w * h) AS pa FROM z GROUP BY 1, 2),
p AS (SELECT a.doc_id, a.page_number, sum(greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1))) AS sh FROM z a JOIN z c ON a.doc_id = c.doc_id AND a.page_number = c.page_number AND a.ord < c.ord GROUP BY 1, 2)
SELECT doc_id, page_number, n, round(ib, 9) AS in_bounds, round(CASE WHEN pa > 0 THEN least(1.0, area / pa) ELSE 0 END, 9) AS coverage, round(CASE WHEN pa > 0 THEN coalesce(sh, 0) / pa ELSE 0 END, 9) AS overlap FROM s LEFT JOIN p USING (doc_id, page_number)""")
def layout_metrics(spark, sf_dir):
    elements = fx.elements(spark, sf_dir)
    return curation.layout_metrics(elements, layout.page_sizes(elements)).select("doc_id", "page_number", "n", *[F.round(c, 9).alias(c) for c in ("in_bounds", "coverage", "overlap")])


@query(f"WITH {fx.ELEMENTS} SELECT doc_id, type, count(*) AS n FROM elements GROUP BY 1, 2")
def type_counts(spark, sf_dir):
    return curation.type_counts(fx.elements(spark, sf_dir))


@query(f"""WITH {fx.ELEMENTS}, e AS (SELECT doc_id, coalesce(page_number, 1) AS page_number, ord, CASE WHEN ord % 19 = 18 THEN ord - 7 WHEN ord % 41 = 40 THEN ord % 83 ELSE ord END AS idx FROM elements),
l AS (SELECT doc_id, page_number, coalesce(idx < lag(idx) OVER (PARTITION BY doc_id, page_number ORDER BY ord), false) AS f FROM e) SELECT doc_id, page_number, NOT bool_or(f) AS in_order FROM l GROUP BY 1, 2""")
def order_sanity(spark, sf_dir):
    """Some indices fall within their page, some on elements without a page, which count to page 1."""
    moved = F.when(F.col("ord") % 19 == 18, F.col("ord") - 7).when(F.col("ord") % 41 == 40, F.col("ord") % 83).otherwise(F.col("ord"))
    return curation.order_sanity(fx.elements(spark, sf_dir).withColumn("element_index", moved))


@query(f"""WITH {fx.ELEMENTS}, f AS (SELECT doc_id, count(*) AS n, count(DISTINCT page_number) AS pages, count(*) FILTER (WHERE type = 'Table') AS tables, count(*) FILTER (WHERE type = 'Image') AS images FROM elements GROUP BY 1)
SELECT count(*) AS files, count(*) FILTER (WHERE n > 1) AS succeeded, count(*) FILTER (WHERE n <= 1) AS failed, sum(n)::BIGINT AS elements, sum(pages)::BIGINT AS pages, sum(tables)::BIGINT AS tables, sum(images)::BIGINT AS images FROM f""")
def batch_summary(spark, sf_dir):
    stats = parsing.file_stats(fx.elements(spark, sf_dir), by="doc_id")
    return parsing.batch_summary(stats.withColumn("error", F.when(F.col("elements") <= 1, "too short")))


@query(f"""WITH {fx.ELEMENTS}, t AS (SELECT *, count(*) FILTER (WHERE type = 'Table') OVER (PARTITION BY doc_id) AS nt FROM elements)
SELECT doc_id, ord, type FROM t WHERE NOT (nt > 0 AND type = 'Table') UNION ALL SELECT DISTINCT doc_id, -1, 'Table' FROM t WHERE nt > 0""")
def table_fallback(spark, sf_dir):
    bare = fx.elements(spark, sf_dir).withColumn("html", F.lit(""))
    fallback = bare.select("doc_id").distinct().withColumn("ord", F.lit(-1)).withColumn("type", F.lit("Table")).withColumn("markdown_path", F.lit("t.md"))
    return parsing.replace_tables(bare, fallback, by="doc_id").select("doc_id", "ord", "type")


@query("SELECT page_id, [[0, 0], [0, 1], [page_id % 7 + 2, 3], [1, 0]][1][1]::DOUBLE AS x1, (page_id % 7 + 2)::DOUBLE AS x2, 3.0::DOUBLE AS y2 FROM pages")
def coordinates(spark, sf_dir):
    pair = lambda a, b: F.array(F.lit(a).cast("double"), F.lit(b).cast("double"))
    moving = F.array((F.col("page_id") % 7 + 2).cast("double"), F.lit(3.0))
    rows = table(spark, sf_dir, "pages").select("page_id", geometry.from_points(F.array(pair(0, 0), pair(0, 1), moving, pair(1, 0))).alias("b"))
    return rows.select("page_id", "b.x1", "b.x2", "b.y2")


@query("""SELECT page_id::VARCHAR AS doc_id, CASE WHEN page_id % 3 = 0 THEN 'Unknown' ELSE 'Text' END AS type, CASE WHEN page_id % 2 = 0 THEN '<own>' ELSE '<meta>' END AS html, (page_id % 7)::DOUBLE AS x2, round(least(1.0, (page_id % 7) / 5.0), 9) AS nx2 FROM pages WHERE page_id % 11 <> 10""")
def element_normalize(spark, sf_dir):
    n, zero = F.col("page_id"), F.array(F.lit(0.0), F.lit(0.0))
    corner = F.array((n % 7).cast("double"), F.lit(3.0))
    raw = table(spark, sf_dir, "pages").select(
        n.cast("string").alias("doc_id"), F.col("url").alias("file_name"), F.col("url").alias("source_path"), F.lit(0).alias("ord"), F.lit(0).alias("element_index"), F.lit(1).alias("page_number"), F.when(n % 3 != 0, "Text").alias("type"),
        F.lit("x").alias("text"), F.when(n % 2 == 0, "<own>").otherwise("").alias("html"), F.lit("<meta>").alias("meta_html"), F.lit(None).cast("string").alias("image_path"), F.array(zero, zero, corner, zero).alias("points"),
        F.when(n % 11 == 10, "broken").alias("error"), F.struct(F.lit(5.0).alias("w"), F.lit(5.0).alias("h")).alias("layout"),
    )
    return parsing.normalize_elements(raw).select("doc_id", "type", "html", F.col("coordinates.x2").alias("x2"), F.round("given_box.x2", 9).alias("nx2"))


@query()
def html_elements(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"))
    return html_source.parse_html(pages).select("doc_id", "ord", "type", "text")


@query(f"""WITH {fx.ELEMENTS}, t AS (SELECT doc_id, ord, {_STRIP} AS cell FROM elements WHERE type = 'Table')
SELECT doc_id, ord, md5('Table caption: lines' || chr(10) || 'Columns: line' || CASE WHEN cell <> '' THEN chr(10) || 'Row 1: line is ' || chr(39) || cell || chr(39) ELSE '' END) AS linear_md5 FROM t""")
def table_linearize(spark, sf_dir):
    elements = fx.elements(spark, sf_dir).where("type = 'Table'")
    return elements.select("doc_id", "ord", F.md5(embedding.linearized(F.col("html"), F.lit("lines")).cast("binary")).alias("linear_md5"))
