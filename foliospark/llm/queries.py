"""The queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import balls, bpe, chat, lines, media, mixing, near, negatives, pii, quality, sharding, toxicity, warc
from foliospark.llm.common import table, written


def tokenizer() -> tuple[str, str]:
    """(path of the rank file, pre-token pattern) of the byte-level vocabulary used here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts with mixed and missing markers, parsed and decoded by a model that never sees the roles of
    the held-out ones (CRC-32 of the id, modulo 5, is 0). ``turn`` orders a conversation's entries."""
    parsed = written(spark, chat.entries(chat.transcripts(table(spark, sf_dir, "conversations")), segment="segment", roles="roles"), "chat-entries")
    held = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return chat.format_chat(parsed, learn_from=~held).select("conv_id", "turn", held.alias("held_out"), "role", "given_role", "rendered")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.tokenize(docs, *tokenizer()).drop("text")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, directory, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, exponent=0.5, budget=1.0)


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), carry=["doc_id"])
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(media.text_payloads(table(spark, sf_dir, "documents")))
    read = media.with_content(media.with_metadata(media.dealt(stored)))
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    given = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return negatives.hard_negatives(negatives.prepared(given), F.col("vec_id") % 100 == 0)


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.with_figures(*balls.cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_warc": op5_warc,
    "op6_pii": op6_pii,
    "op7_karmarkar_karp": op7_karmarkar_karp,
    "op8_poisson_mix": op8_poisson_mix,
    "op9_line_quality": op9_line_quality,
    "op10_media_columns": op10_media_columns,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_line_dedup": op13_line_dedup,
}

_WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d, n >= 1000) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM m"""

_MIX_SQL = """WITH d AS (SELECT doc_id, source, text, coalesce(source, '') AS s, (('0x' || substring(md5('17:count:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE AS u FROM documents),
z AS (SELECT s, sum(strlen(coalesce(text, '')))::DOUBLE AS bytes FROM d GROUP BY 1), t AS (SELECT sum(bytes) AS b, sum(sqrt(bytes)) AS w FROM z WHERE bytes > 0),
r AS (SELECT s, b * sqrt(bytes) / w / bytes AS rate FROM z, t WHERE bytes > 0),
k AS (SELECT s, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 40))::BIGINT + 1)) AS k FROM r),
c AS (SELECT s, rate, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS cdf FROM k),
n AS (SELECT d.doc_id, d.source, d.text, rate, count(*) FILTER (WHERE cdf < u)::INT AS n_copies FROM d JOIN c USING (s) GROUP BY ALL),
e AS (SELECT *, unnest(range(n_copies))::INT AS replica FROM n WHERE n_copies > 0)
SELECT doc_id, source, text, replica, n_copies, round(rate, 6) AS rate, md5('17:order:' || coalesce(doc_id::VARCHAR, '') || ':' || replica) AS shuffle_key FROM e"""

_QUALITY_SQL = """WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
p AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS a FROM w),
g AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) >= 2 AS two FROM g),
v AS (SELECT doc_id, i, two OR coalesce(lag(two) OVER o, false) OR coalesce(lag(two, 2) OVER o, false) AS cov FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, count(*) FILTER (WHERE cov) AS n_repeat_words FROM v GROUP BY 1),
ln AS (SELECT doc_id, host, unnest(ls) AS l FROM w),
nl AS (SELECT *, translate(array_to_string(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS words FROM ln),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM nl WHERE words > 0 GROUP BY 1),
hosts AS (SELECT host, count(*) AS n_host FROM w GROUP BY 1),
freq AS (SELECT host, norm, count(DISTINCT doc_id) AS n_docs FROM nl WHERE words > 0 GROUP BY 1, 2),
bad AS (SELECT host, norm FROM freq JOIN hosts USING (host) WHERE n_docs > greatest(5.0, 0.02 * n_host)),
rem AS (SELECT doc_id, sum(words) FILTER (WHERE bad.norm IS NOT NULL) AS removed FROM nl LEFT JOIN bad USING (host, norm) WHERE words > 0 GROUP BY 1),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
 coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rem USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= 0.7 * n_words AS kept, removed_words FROM s"""

_IBAN = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
_SSN = "[0-9]{3}-[0-9]{2}-[0-9]{4}"
#: Kind, pattern, and the core of the match; RE2 has no look-around, so the last two take in the characters beside them.
_SPANS = (
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", ""), ("ip", "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+", ""), ("card", "[0-9](?:[ -]?[0-9])+", ""), ("phone", "\\+[0-9][ ().0-9-]+[0-9]", ""),
    ("iban", f"(?:^|[^A-Za-z0-9]){_IBAN}(?:$|[^A-Za-z0-9])", _IBAN), ("ssn", f"(?:^|[^0-9-]){_SSN}(?:$|[^0-9-])", _SSN),
)
_FOUND = " UNION ALL ".join(f"SELECT doc_id, {n} AS k, '{kind}' AS kind, '{core}' AS core, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d" for n, (kind, pattern, core) in enumerate(_SPANS))
_PII_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_FOUND}),
u AS (SELECT doc_id, k, kind, core, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(p[1:len(m)]) AS p, unnest(p[2:len(m) + 1]) AS q FROM f WHERE len(m) > 0),
w AS (SELECT *, sum(length(p)) OVER o + sum(length(m)) OVER o - length(m) AS begun FROM u WINDOW o AS (PARTITION BY doc_id, k ORDER BY i)),
c AS (SELECT *, CASE WHEN core = '' THEN m ELSE regexp_extract(m, core) END AS own, regexp_replace(m, '[^0-9]', '', 'g') AS n FROM w),
g AS (SELECT *, begun + strpos(m, own) - 1 AS s, CASE WHEN kind = 'iban' THEN replace(own, ' ', '') ELSE '' END AS b, lower(right(p, 48) || chr(10) || left(q, 48)) AS around FROM c),
v AS (SELECT * FROM g WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255))
 WHEN 'card' THEN length(n) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(n)), lambda j: CASE WHEN j % 2 = 0 THEN n[length(n) - j]::INT ELSE (n[length(n) - j]::INT * 2) // 10 + (n[length(n) - j]::INT * 2) % 10 END)) % 10 = 0
 WHEN 'phone' THEN length(n) BETWEEN 8 AND 15
 WHEN 'iban' THEN length(b) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substring(b, 5) || left(b, 4), ''), lambda x: (CASE WHEN x >= 'A' THEN ascii(x) - 55 ELSE ascii(x) - 48 END)::BIGINT)), lambda r, x: (CASE WHEN x > 9 THEN r * 100 + x ELSE r * 10 + x END) % 97) = 1
 ELSE left(own, 3) NOT IN ('000', '666') AND left(own, 3) < '900' AND substring(own, 5, 2) <> '00' AND right(own, 4) <> '0000' AND regexp_matches(around, 'ssn|social|security|taxpayer|insured') AND NOT regexp_matches(around, 'isbn|order|part|model|date') END),
l AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
 string_agg(kind || ':' || s || ':' || (s + length(own)), ',' ORDER BY k, s) AS spans, string_agg(kind || ':' || s || ':' || (s + length(own)), ',' ORDER BY k, s) FILTER (WHERE k < 4) AS base FROM v GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN l USING (doc_id)"""

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_NEGATIVES_SQL = f"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE label IS NOT NULL AND {_WHOLE}), s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM r a, r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank FROM p JOIN s USING (anchor_id)
 WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score) SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


def _kmeans_sql(rounds: int = 5, clusters: int = 40, dimension: int = 64) -> str:
    """The rounds written out one after another."""
    near = "SELECT vec_id, v, k, d FROM (SELECT vec_id, v, k, (list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c))::BIGINT AS d FROM r, c{0}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1"
    parts = [
        f"r AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE {_WHOLE} AND len(embedding) = {dimension})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INT AS k, v AS c FROM r QUALIFY k < {clusters})",
    ]
    for n in range(rounds):
        parts.append(f"a{n} AS MATERIALIZED ({near.format(n)})")
        parts.append(f"s{n} AS (SELECT k, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT k, unnest(range({dimension})) AS i, unnest(v)::BIGINT AS x FROM a{n}) GROUP BY 1, 2)")
        parts.append(f"m{n} AS (SELECT k, list((CASE WHEN s < 0 THEN -((-s + n - 1) // n) ELSE s // n END)::DOUBLE ORDER BY i) AS m FROM s{n} GROUP BY 1)")
        parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{n} LEFT JOIN m{n} USING (k))")
    told = f"sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM last JOIN c{rounds} USING (k)"
    return f"WITH {', '.join(parts)}, last AS ({near.format(rounds)}) SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, {told}"


_LINES_SQL = """WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), u AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS l FROM d),
k AS (SELECT *, translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
m AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
o AS (SELECT doc_id, i, l, last IS NULL OR last = doc_id AS kept FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT kept) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE kept), '')) AS kept_sha256 FROM o GROUP BY 1"""

SQL: dict[str, str] = {
    "op5_warc": _WARC_SQL, "op6_pii": _PII_SQL, "op8_poisson_mix": _MIX_SQL, "op9_line_quality": _QUALITY_SQL,
    "op11_hard_negatives": _NEGATIVES_SQL, "op12_ball_kmeans": _kmeans_sql(), "op13_line_dedup": _LINES_SQL,
}
