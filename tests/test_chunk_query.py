"""The chunk query against chunk assembly written out once more, from the blocks that SQL has checked; and other whole queries."""

import hashlib
import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.operators import chunking, curation, embedding, preparation
from foliospark.plans import catalog
from foliospark.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def level(role, text):
    s = text.strip()
    if role == "listitem":
        return None
    if m := re.match(r"\d+(\.\d+)*\b", s):
        return None if len(re.findall(r"\w+", s)) > 25 else s.count(".") + 1 if m else None
    if role in ("title", "h1"):
        return 1
    letters = re.findall("[A-Za-z]", s)
    if letters and sum(map(str.isupper, letters)) >= 0.7 * len(letters) and 1 <= len(re.findall(r"\w+", s)) <= 15:
        return 2
    return None


def tokens(text):
    return max(1, round(len(re.findall(r"\w+|\S", text)) / 0.75))


def box(a, b):
    return a if b is None else b if a is None else (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def assembled(blocks, limit=900, overlap=120):
    """Chunks of one document, as tuples (page, role, text, ids, box, section path, section index)."""
    joined = []
    i = 0
    while i < len(blocks):  # a heading and the paragraph after it
        page, role, text, ids, b = blocks[i]
        after = blocks[i + 1] if i + 1 < len(blocks) else None
        if role == "caption" and joined and joined[-1][0] == page and joined[-1][1] in ("figure", "table"):
            p, r, t, own, c = joined[-1]
            joined[-1] = (p, r, f"{t}\n{text}".strip() if t and text else t or text, own + ids, box(c, b))
        elif after and after[0] == page and after[1] == "paragraph" and level(role, text) is not None:
            joined.append((page, role, f"{text.rstrip()}\n{after[2].lstrip()}".strip(), ids + after[3], box(b, after[4])))
            i += 1
        else:
            joined.append(blocks[i])
        i += 1
    rows, path, numbers = [], [], {}
    for block in joined:  # sections: the path of open headings
        n = level(block[1], block[2])
        if n is not None:
            path = [s for s in path if s[0] < n]
            path = [*path, (n, block[2].strip().splitlines()[0][:120] if block[2].strip() else "", len(numbers))]
            numbers[len(numbers)] = " > ".join(s[1] for s in path)
        rows.append((*block, path[-1][2] if path else None))
    out, count, i, carry = [], {}, 0, None
    while i < len(rows) or carry:
        carried = carry is not None
        if carried:
            page, role, text, ids, b, section = carry
            carry = None
        else:
            page, role, text, ids, b, section = rows[i]
            i += 1
        if role in ("paragraph", "other") and len(text.strip()) < 15:
            continue
        if role not in ("table", "figure"):
            if role in ("title", "h2") and i < len(rows) and rows[i][0] == page and rows[i][1] not in ("table", "figure"):
                text, ids, b, section_of_text = f"{text}\n{rows[i][2]}", ids + rows[i][3], box(b, rows[i][4]), rows[i][5]
                del section_of_text  # the heading's own section is the chunk's
                i += 1
            role = "paragraph"
            follows = lambda: i < len(rows) and rows[i][1] == "paragraph" and rows[i][0] == page and rows[i][5] == section  # noqa: E731,B023
            while follows() and tokens(f"{text}\n{rows[i][2]}") <= limit:
                text, ids, b = f"{text}\n{rows[i][2]}", ids + rows[i][3], box(b, rows[i][4])
                i += 1
            if follows() and text.split() and not carried:
                carry = (page, "paragraph", " ".join(text.split()[-overlap:]), [], b, None)
        if section is not None:
            count[section] = count.get(section, 0) + 1
        out.append((page, role, text, ids, b, numbers[section] if section is not None else "", count.get(section, 0) if section is not None else 0))
    return out


@pytest.fixture(scope="module")
def blocks(spark):
    found = {}
    for r in chunking.blocks_of(fx.elements(spark, SF))[0].orderBy("doc_id", "ord").collect():
        b = tuple(r.bbox[k] for k in ("x1", "y1", "x2", "y2")) if r.bbox else None
        found.setdefault(r.doc_id, []).append((r.page, r.role, r.text or "", list(r.element_ids), b))
    return found


def test_chunks_equal_assembly_written_out_once_more(spark, blocks):
    rows = {}
    for r in catalog.QUERIES["chunk_assemble"](spark, SF).orderBy("doc_id", "ord").collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert len(rows) > 50
    for doc, own in blocks.items():
        want, got = assembled(own), rows.get(doc, [])
        assert [(c.page_start, c.role, c.text, list(c.source_element_ids), c.section_index) for c in got] == [(p, r, t, i, n) for p, r, t, i, _, _, n in want]
        assert [tuple(c.bbox) if c.bbox else None for c in got] == [b for _, _, _, _, b, _, _ in want]
        assert [c.chunk_id for c in got] == [f"c{i}" for i in range(len(got))] and [c.next_id for c in got] == [f"c{i + 1}" for i in range(len(got) - 1)] + [None] * bool(got)
        assert [c.content_sha256 for c in got] == [hashlib.sha256(c.text.encode() + (b"\0" + c.html.encode() if c.html else b"")).hexdigest() for c in got]
        assert all((not c.section_path) == (not p) or re.fullmatch(r"\W*|.*\(.*", p) for c, (*_, p, _) in zip(got, want))


def test_manifest_counts(spark, blocks):
    for r in catalog.QUERIES["manifest_counts"](spark, SF).collect():
        want = {}
        for kind, roles in (("blocks", [b[1] for b in blocks[r.doc_id]]), ("chunks", [c[1] for c in assembled(blocks[r.doc_id])])):
            for role in roles:
                want[f"{kind}_{role}"] = want.get(f"{kind}_{role}", 0) + 1
        assert json.loads(r.counts) == want


def test_embedded_vectors(spark):
    """Every selected chunk's vector by the definition of the hashing encoder."""
    import zlib

    import numpy as np

    rows = {(r.doc_id, r.ord): r for r in embedding.select_chunks(fx.chunks(spark, SF), catalog._POLICY).collect()}
    found = catalog.QUERIES["embed_vectors"](spark, SF).collect()
    assert len(found) == len(rows)
    texts = {}
    for (doc, _), r in rows.items():
        texts.setdefault((doc, r.chunk_id), []).append(r.text)
    for r in found:
        full = [t if t.lower().startswith("passage:") else "passage: " + t for t in texts[r.doc_id, r.chunk_id]]
        cut = [t if len(t.split()) <= 512 else " ".join(t.split()[:512]) for t in full]
        assert r.embedding_text in cut
        v = np.zeros(64)
        for word in re.findall(r"\w+", r.embedding_text.lower()):
            h = zlib.crc32(word.encode())
            v[h % 64] += 1 if h >> 31 else -1
        assert np.allclose(r.vector, v / max(1e-12, np.linalg.norm(v)) if v.any() else v, atol=1e-4)


def test_html_elements(spark):
    """Blocks of the pages by regular expressions over their markup, which is simple enough for these."""
    import html as entities

    pages = duckdb.sql(f"select url, html from '{SF}/pages.parquet'").fetchall()
    found = {}
    for r in catalog.QUERIES["html_elements"](spark, SF).orderBy("doc_id", "ord").collect():
        found.setdefault(r.doc_id, []).append((r.type, r.text))
    kinds = {"h1": "Title", "h2": "h2", "h3": "h3", "p": "NarrativeText", "li": "ListItem"}
    checked = 0
    for url, page in pages:
        if page is None or re.search(r"(?i)<(table|img|figcaption|caption|textarea)", page):
            continue
        body = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", page)
        want, kind, held = [], None, ""

        def flush():
            text = " ".join(held.split())
            if kind and text:
                want.append((kinds[kind], text))  # noqa: B023

        for part in re.split(r"(<[^<>]*>)", body):
            m = re.fullmatch(r"<(/?)([a-zA-Z0-9]+)[^<>]*>", part)
            if m and m[2].lower() in kinds:
                flush()
                kind, held = (None if m[1] else m[2].lower()), ""
            elif m:
                held += " " if m[2].lower() in ("br", "td", "th", "tr") and not m[1] else ""
            elif kind and not part.startswith("<!"):
                held += entities.unescape(part)
        flush()
        doc = hashlib.sha256(url.encode()).hexdigest()[:16]
        assert [(k, re.sub(r"\s+", " ", t)) for k, t in found.get(doc, [])] == [(k, re.sub(r"\s+", " ", t.replace("\xad", "").replace("\xa0", " "))) for k, t in want], url
        checked += 1
    assert checked > 10


def test_shared_area_by_a_sweep():
    import numpy as np

    rng = np.random.default_rng(4)
    x, y = rng.uniform(0, 100, (2, 700))
    w, h = rng.uniform(0, 20, (2, 700))
    want = sum(max(0, min(x[i] + w[i], x[j] + w[j]) - max(x[i], x[j])) * max(0, min(y[i] + h[i], y[j] + h[j]) - max(y[i], y[j])) for i in range(700) for j in range(i))
    assert curation.shared_area(x, y, x + w, y + h) == pytest.approx(want) and curation.shared_area([], [], [], []) == 0


def test_one_run_prepares_and_stops_at_faults(spark):
    elements = fx.elements(spark, SF).where("doc_id < '12'")
    made = preparation.prepare(elements)
    assert [r.step for r in made.report.collect()][:2] == ["chunk", "check"]
    if made.passed:
        assert [r.step for r in made.report.collect()] == ["chunk", "check", "determinism", "dedup", "check unique"] and made.unique.count() <= made.chunks.count()
    empty = preparation.prepare(elements.limit(0))
    assert not empty.passed and [(r.step, r.passed) for r in empty.report.collect()] == [("chunk", False)]
    short = preparation.prepare(elements, determinism=False, dedup=False)
    assert short.unique is None and short.report.count() == 2
    assert short.manifest.where(F.col("doc_id").isNotNull()).count() > 0
