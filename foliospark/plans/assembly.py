"""Chunk assembly as a query, and its SQL: joined headings by windows, sections by their parents, chunks by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import chunking
from foliospark.plans import catalog
from foliospark.plans import fixtures as fx

_LEVEL = """CASE WHEN regexp_matches({s}, '^(\\d+(?:\\.\\d+)*)\\b') THEN CASE WHEN len(regexp_extract_all({s}, '[\\pL\\pN_]+')) <= 25 THEN len(regexp_extract_all({s}, '\\.')) + 1 END
 WHEN role IN ('title', 'h1') THEN 1 WHEN len(regexp_extract_all({s}, '[\\pL\\pN_]+')) BETWEEN 1 AND 15 AND len(regexp_extract_all({s}, '[A-Za-z]')) > 0
  AND len(regexp_extract_all({s}, '[A-Z]')) >= 0.70 * len(regexp_extract_all({s}, '[A-Za-z]')) THEN 2 END"""

#: Blocks as assembly gets them, in ``given``: (doc_id, n from 1, page, role, text, ids).
_GIVEN = f"""h AS (SELECT *, CASE WHEN role = 'caption' THEN max(CASE WHEN role IN ('figure', 'table') THEN ord END) OVER (PARTITION BY doc_id, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS holder FROM blocks),
c AS (SELECT doc_id, holder AS ord, array_to_string(list(text ORDER BY ord), chr(10)) AS caps FROM h WHERE holder IS NOT NULL GROUP BY 1, 2),
held AS (SELECT doc_id, page, ord, role, CASE WHEN caps IS NULL THEN text WHEN text = '' THEN caps ELSE text || chr(10) || caps END AS text, ids FROM h LEFT JOIN c USING (doc_id, ord) WHERE holder IS NULL),
given AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n, page, role, text, ids, {fx.STRIP.format("text")} AS s FROM held)"""

#: A block is taken in by the heading before it if that one is not taken in itself: every second one of a run of such pairs.
_JOINED = f"""paired AS (SELECT *, {_LEVEL.format(s="s")} IS NOT NULL AND coalesce(lead(page) OVER d = page AND lead(role) OVER d = 'paragraph', false) AS pair, lead(text) OVER d AS after, lead(ids) OVER d AS after_ids
 FROM given WINDOW d AS (PARTITION BY doc_id ORDER BY n)),
run AS (SELECT *, n - 1 - coalesce(max(CASE WHEN NOT pair THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pairs FROM paired),
joined AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, page, role,
  CASE WHEN pair THEN {fx.STRIP.format("regexp_replace(text, '\\s+$', '') || chr(10) || regexp_replace(after, '^\\s+', '')")} ELSE text END AS text, CASE WHEN pair THEN ids || ',' || after_ids ELSE ids END AS ids
  FROM run WHERE pairs % 2 = 0)"""

#: The parent of a heading is the last one before it of a lower level.
_PLACED = f"""leveled AS (SELECT *, {_LEVEL.format(s="s")} AS level, substr(string_split(s, chr(10))[1], 1, 120) AS title FROM (SELECT *, {fx.STRIP.format("text")} AS s FROM joined)),
heads AS (SELECT doc_id, i, level, title, 's' || (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) AS section_id FROM leveled WHERE level IS NOT NULL),
parents AS (SELECT x.doc_id, x.i, any_value(x.level) AS level, any_value(x.title) AS title, any_value(x.section_id) AS section_id, max(y.i) AS parent FROM heads x LEFT JOIN heads y ON y.doc_id = x.doc_id AND y.i < x.i AND y.level < x.level GROUP BY 1, 2),
paths AS (SELECT doc_id, i, level, section_id, title AS path FROM parents WHERE parent IS NULL UNION ALL SELECT p.doc_id, p.i, p.level, p.section_id, q.path || ' > ' || p.title FROM parents p JOIN paths q ON q.doc_id = p.doc_id AND q.i = p.parent),
placed AS (SELECT doc_id, i, page, role, text, ids, length(s) AS size, max(CASE WHEN level IS NOT NULL THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM leveled)"""

_TOKENS = "greatest(1, round_even(len(regexp_extract_all(t.text || chr(10) || a.text, '[\\pL\\pN_]+|\\S')) / 0.75::DOUBLE, 0))"

#: One step takes a block, lets an open chunk grow by the next one, or closes it; ``made`` has what a step gave out.
_STEPS = f"""steps AS (
 SELECT DISTINCT doc_id, 0 AS step, 1::BIGINT AS i, false AS open, ''::VARCHAR AS text, ''::VARCHAR AS ids, 0::BIGINT AS page, NULL::BIGINT AS sec, false AS carried, NULL::STRUCT(role VARCHAR, text VARCHAR, ids VARCHAR, page BIGINT, sec BIGINT) AS made FROM placed
 UNION ALL
 SELECT doc_id, step + 1, CASE WHEN open AND NOT grows THEN i WHEN NOT open AND glued THEN i + 2 ELSE i + 1 END, CASE WHEN open THEN grows OR (over AND length(tail) >= 15) ELSE NOT (tiny OR alone) END,
  CASE WHEN grows THEN text || chr(10) || a_text WHEN open THEN tail WHEN glued THEN a_text || chr(10) || b_text ELSE a_text END,
  CASE WHEN grows THEN CASE WHEN ids = '' THEN a_ids ELSE ids || ',' || a_ids END WHEN open THEN '' WHEN glued THEN a_ids || ',' || b_ids ELSE a_ids END,
  CASE WHEN open THEN page ELSE a_page END, CASE WHEN grows THEN sec WHEN open THEN NULL ELSE a_sec END, CASE WHEN grows THEN carried ELSE open END,
  CASE WHEN open AND NOT grows THEN {{'role': 'paragraph', 'text': text, 'ids': ids, 'page': page, 'sec': sec}} WHEN NOT open AND alone THEN {{'role': a_role, 'text': a_text, 'ids': a_ids, 'page': a_page, 'sec': a_sec}} END
 FROM (SELECT *, open AND follows AND NOT grows AND NOT carried AND tail <> '' AS over FROM (
  SELECT t.*, a.text AS a_text, a.ids AS a_ids, a.page AS a_page, a.sec AS a_sec, a.role AS a_role, b.text AS b_text, b.ids AS b_ids,
   coalesce(a.role = 'paragraph' AND a.page = t.page AND a.sec IS NOT DISTINCT FROM t.sec, false) AS follows,
   t.open AND coalesce(a.role = 'paragraph' AND a.page = t.page AND a.sec IS NOT DISTINCT FROM t.sec AND {_TOKENS} <= 900, false) AS grows,
   coalesce(a.role IN ('paragraph', 'other') AND a.size < 15, false) AS tiny, coalesce(a.role IN ('table', 'figure'), false) AS alone,
   coalesce(a.role IN ('title', 'h2') AND b.page = a.page AND b.role NOT IN ('table', 'figure'), false) AS glued,
   array_to_string(list_filter(string_split_regex(t.text, '\\s+'), lambda w: w <> '')[-120:], ' ') AS tail
  FROM steps t LEFT JOIN placed a ON a.doc_id = t.doc_id AND a.i = t.i LEFT JOIN placed b ON b.doc_id = t.doc_id AND b.i = t.i + 1 WHERE t.open OR a.i IS NOT NULL))),
made AS (SELECT doc_id, step, made.role AS role, made.text AS text, made.ids AS ids, made.page AS page, made.sec AS sec FROM steps WHERE made IS NOT NULL)"""

CHUNKED = f"WITH RECURSIVE {catalog._BODY}, {catalog._INNER_MERGE}, {_GIVEN}, {_JOINED}, {_PLACED}, {_STEPS}"


@catalog.query(f"""{CHUNKED} SELECT m.doc_id, (row_number() OVER (PARTITION BY m.doc_id ORDER BY step) - 1)::INT AS ord, m.page::INT AS page, role, md5(text) AS text_md5, ids, coalesce(section_id, '') AS section_id, coalesce(path, '') AS section_path,
 coalesce(level, 0)::INT AS section_level, CASE WHEN sec IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY m.doc_id, sec ORDER BY step) END::INT AS section_index FROM made m LEFT JOIN paths p ON p.doc_id = m.doc_id AND p.i = m.sec""")
def chunk_texts(spark, sf_dir):
    """Chunks of all documents as assembly gives them out: texts, elements and sections."""
    chunks = chunking.chunk_blocks(chunking.blocks_of(fx.elements(spark, sf_dir))[0])
    return chunks.select(
        "doc_id", "ord", "page", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.array_join("ids", ",").alias("ids"), "section_id", "section_path", "section_level", "section_index"
    )


catalog.SQL["manifest_counts"] = f"""{CHUNKED}, named AS (SELECT doc_id, 'blocks_' || role AS k FROM given UNION ALL SELECT doc_id, 'chunks_' || role FROM made), counted AS (SELECT doc_id, k, count(*) AS n FROM named GROUP BY 1, 2),
sized AS (SELECT doc_id, count(*)::INT AS n_pages FROM pages_ GROUP BY 1) SELECT doc_id, '{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}' AS counts, any_value(n_pages) AS n_pages FROM counted LEFT JOIN sized USING (doc_id) GROUP BY doc_id"""
