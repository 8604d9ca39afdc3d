"""Chunk assembly.

Headings, sections and chunks depend on all that came before in the document, so this one step is a Python kernel over a
document's blocks; what comes before and after it is native. A group is a document, never a corpus. Documents of very many
blocks are cut where the kernel's state is known whatever came before, and the same kernel runs over their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.functions import geometry, storage
from foliospark.functions import text as text_functions
from foliospark.functions.frames import in_arrow
from foliospark.functions.tokens import Tokenizer
from foliospark.operators import layout

LEAST_CHARACTERS = 15
MAX_TOKENS, OVERLAP_WORDS = 900, 120
TITLE_LENGTH = 120
#: Documents of more blocks than this are cut into pieces of about PIECE blocks.
LARGE, PIECE = 20_000, 512
#: Elements that a task of the document pipeline gets: it sorts them several times over.
ROWS_A_TASK = 50_000

_TOKEN = re.compile(r"\w+|\S")
_NUMBER = re.compile(r"\d+(?:\.\d+)*\b")


def estimated_tokens(text: str) -> int:
    return _estimate(len(_TOKEN.findall(text)))


def _estimate(words: int) -> int:
    return max(1, round(words / text_functions.WORDS_PER_TOKEN))


def heading_level(role: str, text: str) -> int | None:
    """The same as ``functions.text.heading_level`` for single values."""
    s, kind = text.strip(), role.lower()
    if kind == "listitem":
        return None
    if _NUMBER.match(s):
        return s.count(".") + 1 if len(re.findall(r"\w+", s)) <= 25 else None
    if kind in ("title", "h1"):
        return 1
    if not 1 <= sum(1 for _ in islice(re.finditer(r"\w+", s), 16)) <= 15:  # of a long text, no more is read
        return None
    letters = len(re.findall("[A-Za-z]", s))
    return 2 if letters and len(re.findall("[A-Z]", s)) / letters >= 0.70 else None


def _around(*boxes):
    known = [b for b in boxes if b is not None]
    if not known:
        return None
    return {"x1": min(b["x1"] for b in known), "y1": min(b["y1"] for b in known), "x2": max(b["x2"] for b in known), "y2": max(b["y2"] for b in known)}


def join_headings(blocks: list[dict]) -> list[dict]:
    """A heading takes in the paragraph right after it on its page; both count as one block from then on."""
    out, skip = [], False
    for block, after in zip(blocks, [*blocks[1:], None], strict=True):
        if skip:
            skip = False
        elif block["role"] == "caption" and out and out[-1]["page"] == block["page"] and out[-1]["role"] in ("figure", "table"):
            held = out[-1]
            out[-1] = held | {
                "text": f"{held['text']}\n{block['text']}".strip() if held["text"] and block["text"] else held["text"] or block["text"],
                "html": held["html"] or block["html"], "ids": held["ids"] + block["ids"], "bbox": _around(held["bbox"], block["bbox"]),
            }
        elif after is not None and after["page"] == block["page"] and after["role"] == "paragraph" and heading_level(block["role"], block["text"]) is not None:
            out.append(
                block | {"text": f"{block['text'].rstrip()}\n{after['text'].lstrip()}".strip(), "html": block["html"] or after["html"], "ids": block["ids"] + after["ids"], "bbox": _around(block["bbox"], after["bbox"])}
            )
            skip = True
        else:
            out.append(block)
    return out


class Headings:
    """The open sections of a document while its headings are read one after another."""

    def __init__(self):
        self.open, self.counts, self.made = [], {}, 0

    def add(self, level: int, title: str) -> dict:
        """The section that a heading opens, below the nearest lower level."""
        self.open = [s for s in self.open if s["level"] < level]  # levels rise along the open sections
        parent = self.open[-1] if self.open else None
        place = (level, parent["id"] if parent else None)
        self.counts[place] = self.counts.get(place, 0) + 1
        self.open.append({"id": f"s{self.made}", "level": level, "title": title, "path": " > ".join([*(s["title"] for s in self.open), title]), "index": self.counts[place]})
        self.made += 1
        return self.open[-1]


def title_of(text: str) -> str:
    lines = text.strip().splitlines()
    return lines[0][:TITLE_LENGTH] if lines else ""


def sections(blocks: list[dict]) -> list[dict | None]:
    """The section of each block: a heading opens one below the nearest lower level, other blocks stay in the open one."""
    headings, now, out = Headings(), None, []
    for block in blocks:
        level = heading_level(block["role"], block["text"])
        if level is not None:
            now = headings.add(level, title_of(block["text"]))
        out.append(now)
    return out


def assemble(blocks: list[dict], max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_WORDS, tokens=estimated_tokens) -> list[dict]:
    """Chunks of blocks that have their section in ``section``.

    Tables and figures stand alone. A title takes the next text block of its page; text grows by the following paragraphs of
    the page and section as long as the tokens fit. Where the limit stopped it, the last ``overlap`` words open a chunk of
    their own without a section. Such a carry never makes another one, so a region without sections comes to an end too.
    """
    queue, chunks, counts = list(reversed(blocks)), [], {}

    def emit(block: dict, role: str, text: str, html: str, ids: list, bbox, section: dict | None) -> None:
        if section:
            counts[section["id"]] = counts.get(section["id"], 0) + 1
        chunks.append(
            {
                "page": block["page"], "page_width": block["page_width"], "page_height": block["page_height"], "picture": block["picture"] if role == "figure" else "", "role": role, "text": text, "html": html, "ids": ids, "bbox": bbox, "section_id": section["id"] if section else "",
                "section_path": section["path"] if section else "", "section_level": section["level"] if section else 0, "section_index": counts[section["id"]] if section else 0,
            }
        )

    while queue:
        block = queue.pop()
        section = block["section"]
        if block["role"] in ("paragraph", "other") and len(block["text"].strip()) < LEAST_CHARACTERS:
            continue
        if block["role"] in ("table", "figure"):
            emit(block, block["role"], block["text"], block["html"], list(block["ids"]), block["bbox"], section)
            continue
        texts, ids, bbox = [block["text"]], list(block["ids"]), block["bbox"]
        carried = block.get("carry", False)
        if block["role"] in ("title", "h2") and queue and queue[-1]["page"] == block["page"] and queue[-1]["role"] not in ("table", "figure"):
            block = queue.pop()
            texts, ids, bbox = [*texts, block["text"]], ids + block["ids"], _around(bbox, block["bbox"])
        text = "\n".join(texts)

        def follows(block: dict = block, section: dict | None = section) -> bool:
            return bool(queue) and queue[-1]["role"] == "paragraph" and queue[-1]["page"] == block["page"] and queue[-1]["section"] is section

        words = len(_TOKEN.findall(text)) if tokens is estimated_tokens and follows() else 0
        while follows():
            # no word goes over a line's end, so words of lines add up
            if tokens is estimated_tokens:
                words += len(_TOKEN.findall(queue[-1]["text"]))
                fits = _estimate(words) <= max_tokens
            else:
                fits = tokens("\n".join([text, queue[-1]["text"]])) <= max_tokens
            if not fits:
                break
            taken = queue.pop()
            text, ids, bbox = f"{text}\n{taken['text']}", ids + taken["ids"], _around(bbox, taken["bbox"])
        emit(block, "paragraph", text, "", ids, bbox, section)
        tail = text.split()[-overlap:] if overlap > 0 and not carried and follows() else []
        if tail:
            queue.append(block | {"role": "paragraph", "text": " ".join(tail), "html": "", "ids": [], "bbox": bbox, "section": None, "carry": True})
    return chunks


KERNEL = (
    "doc_id string, ord int, page int, role string, text string, html string, ids array<int>, bbox struct<x1:double,y1:double,x2:double,y2:double>,"
    " section_id string, section_path string, section_level int, section_index int, picture string, page_width double, page_height double"
)


_OWN = "struct<ord:int,page:int,role:string,text:string,html:string,ids:array<int>,bbox:struct<x1:double,y1:double,x2:double,y2:double>,picture:string,page_width:double,page_height:double>"
_SECTION = "struct<id:string,path:string,level:int,index:int>"


def _own() -> Column:
    columns = ["ord", "page", "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("html", F.lit("")).alias("html"), F.col("element_ids").alias("ids"), "bbox", "picture", "page_width", "page_height"]
    return F.struct(*columns)


def _counter(tokenizer: Tokenizer | None):
    return estimated_tokens if tokenizer is None else lambda t: len(tokenizer.encode([t])[0])


def _by_rows(frame: DataFrame, work, schema: str, step: int = 64) -> DataFrame:
    """``frame`` with every row turned into rows by ``work(row)``, a few at a time."""
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                yield pa.RecordBatch.from_pylist([out for row in whole.slice(at, step).to_pylist() for out in work(row)], schema=arrow)

    return frame.transform(in_arrow, run, kind)


def chunk_blocks(blocks: DataFrame, *, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_WORDS, tokenizer: Tokenizer | None = None, large: int | None = None) -> DataFrame:
    """Raw chunks of every document's blocks, in emission order ``ord``.

    A document's blocks become one row, so the kernel gets many documents in an Arrow batch. Budgets count ``tokenizer``'s
    ids, or estimated tokens without one. Documents of more than ``large`` blocks are cut into pieces instead
    (``chunk_pieces``); without ``large`` none is.
    """
    if large is not None:
        sized = blocks.withColumn("__n", F.count("*").over(Window.partitionBy("doc_id")))
        options = {"max_tokens": max_tokens, "overlap": overlap, "tokenizer": tokenizer}
        small, others = (sized.where(c).drop("__n") for c in (F.col("__n") <= large, F.col("__n") > large))
        return chunk_blocks(small, **options).unionByName(chunk_pieces(others, **options))
    tokens = _counter(tokenizer)
    documents = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(_own())).alias("blocks"))

    def kernel(row: dict) -> list[dict]:
        joined = join_headings(row["blocks"])
        placed = [b | {"section": s} for b, s in zip(joined, sections(joined), strict=True)]
        return [c | {"doc_id": row["doc_id"], "ord": n} for n, c in enumerate(assemble(placed, max_tokens, overlap, tokens))]

    return _by_rows(documents, kernel, KERNEL)


def _pieces(rows: DataFrame, cut: Column, order: tuple[str, ...], piece: int) -> DataFrame:
    """``rows`` with ``piece``: about so many rows each, every piece beginning at a row where ``cut`` holds."""
    doc = Window.partitionBy("doc_id").orderBy(*order)
    so_far = doc.rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(doc)
    marked = rows.withColumn("__at", F.when((place == 1) | F.coalesce(cut, F.lit(True)), F.floor((place - 1) / piece)))
    return marked.withColumn("piece", F.last("__at", ignorenulls=True).over(so_far)).drop("__at")


def chunk_pieces(blocks: DataFrame, *, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_WORDS, tokenizer: Tokenizer | None = None, piece: int = PIECE) -> DataFrame:
    """``chunk_blocks`` for documents of any length: the same chunks, from pieces that are dealt to many tasks.

    Joining headings can begin anew before a block that nothing before it could take: on another page, or one that is no
    caption and no paragraph after a heading. Sections follow from the headings alone, which one pass with the open sections as
    its state numbers; every block then has the last one. Assembly can begin anew on another page, at a table or figure, and
    where the section changes unless a title is right before. Windows stream over a document's rows; no task holds
    more than a piece, which is longer than ``piece`` blocks only where no cut comes.
    """
    spark, tokens = blocks.sparkSession, _counter(tokenizer)
    order = Window.partitionBy("doc_id").orderBy("ord")
    before = lambda c, w=order: F.lag(c).over(w)
    level = text_functions.heading_level(F.col("role"), F.col("text"))
    told = blocks.withColumn("__heading", level.isNotNull())
    free = (F.col("page") != before("page")) | ((F.col("role") != "caption") & ~((F.col("role") == "paragraph") & before("__heading")))
    cut = _pieces(told, free, ("ord",), piece).select("doc_id", "piece", _own().alias("b"))
    grouped = cut.repartition("doc_id", "piece").groupBy("doc_id", "piece").agg(F.array_sort(F.collect_list("b")).alias("blocks"))

    def joined(row: dict) -> list[dict]:
        out = []
        for n, b in enumerate(join_headings(row["blocks"])):
            out.append({"doc_id": row["doc_id"], "piece": row["piece"], "n": n, "b": b, "level": heading_level(b["role"], b["text"]), "title": title_of(b["text"])})
        return out

    rows = storage.written(spark, _by_rows(grouped, joined, f"doc_id string, piece long, n int, b {_OWN}, level int, title string"), "joined-blocks")
    heads = rows.where("level IS NOT NULL").select("doc_id", "piece", "n", "level", "title")

    def numbered(batches: Iterator):
        import pyarrow as pa

        doc, state = None, None
        for batch in batches:
            found = []
            for own, at, n, depth, title in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or own != doc:
                    doc, state = own, Headings()
                s = state.add(depth, title)
                found.append({"doc_id": own, "piece": at, "n": n, "section": {"id": s["id"], "path": s["path"], "level": s["level"], "index": s["index"]}})
            kinds = pa.schema([("doc_id", pa.string()), ("piece", pa.int64()), ("n", pa.int32()), ("section", pa.struct([("id", pa.string()), ("path", pa.string()), ("level", pa.int32()), ("index", pa.int32())]))])
            yield pa.RecordBatch.from_pylist(found, schema=kinds)

    opened = heads.repartition("doc_id").sortWithinPartitions("doc_id", "piece", "n").transform(in_arrow, numbered, f"doc_id string, piece long, n int, section {_SECTION}")
    key = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("doc_id", "piece", "n")]
    met = rows.alias("r").join(opened.alias("s"), key[0] & key[1] & key[2], "left").select("r.doc_id", "r.piece", "r.n", "r.b", "s.section")
    place = Window.partitionBy("doc_id").orderBy("piece", "n")
    placed = met.withColumn("section", F.last("section", ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, 0))).withColumnsRenamed({"piece": "p"})
    place = Window.partitionBy("doc_id").orderBy("p", "n")
    changed = ~F.col("section.id").eqNullSafe(F.lag("section.id").over(place)) & ~F.lag("b.role").over(place).isin("title", "h2")
    free = (F.col("b.page") != F.lag("b.page").over(place)) | F.col("b.role").isin("table", "figure") | changed
    cut = _pieces(placed, free, ("p", "n"), piece)
    again = cut.select("doc_id", "piece", F.struct("p", "n", "b", "section").alias("x")).repartition("doc_id", "piece")
    grouped = again.groupBy("doc_id", "piece").agg(F.array_sort(F.collect_list(F.struct("x.p", "x.n", "x.b", "x.section"))).alias("blocks"))

    def made(row: dict) -> list[dict]:
        known: dict = {}
        placed = [x["b"] | {"section": known.setdefault(x["section"]["id"], x["section"]) if x["section"] else None} for x in row["blocks"]]
        return [c | {"doc_id": row["doc_id"], "piece": row["piece"], "ord": n} for n, c in enumerate(assemble(placed, max_tokens, overlap, tokens))]

    chunks = _by_rows(grouped, made, f"{KERNEL}, piece long")
    doc, inside = Window.partitionBy("doc_id").orderBy("piece", "ord"), Window.partitionBy("doc_id", "section_id").orderBy("piece", "ord")
    index = F.when(F.col("section_id") != "", F.row_number().over(inside)).otherwise(0)
    return chunks.withColumns({"section_index": index.cast("int"), "__ord": (F.row_number().over(doc) - 1).cast("int")}).withColumn("ord", F.col("__ord")).drop("piece", "__ord")


def finish_chunks(raw: DataFrame, elements: DataFrame, *, max_level: int = 6, names: DataFrame | None = None) -> DataFrame:
    """Ids, links, page geometry, images, section clean-up, reading order and content hash: the columns of ``schemas.CHUNK``.

    ``names``: (doc_id, source_file), made from the elements if not given.
    """
    doc = Window.partitionBy("doc_id").orderBy("ord")
    name = F.concat(F.lit("c"), F.col("ord").cast("string"))
    names = elements.groupBy("doc_id").agg(F.min_by("file_name", "ord").alias("source_file")) if names is None else names
    chunks = raw.select(
        "doc_id", name.alias("chunk_id"), "ord", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "role", "text", "html", F.col("picture").alias("image_path"), "bbox",
        F.lit("top-left").alias("coord_system"), "page_width", "page_height", geometry.absolute(F.col("bbox"), F.col("page_width"), F.col("page_height")).alias("bbox_abs"),
        F.col("ids").alias("source_element_ids"), F.lag(name).over(doc).alias("prev_id"), F.lead(name).over(doc).alias("next_id"), "section_id",
        text_functions.section_path(F.col("section_path")).alias("section_path"), text_functions.section_level(F.col("section_level"), max_level).alias("section_level"), "section_index",
        F.lit(schemas.VERSION).alias("schema_version"), text_functions.content_hash(F.col("text"), F.col("html")).alias("content_sha256"),
    )
    full = layout.reading_order(chunks).join(names, "doc_id", "left")
    return full.select(*[F.col(f.name).cast(f.dataType) for f in schemas.CHUNK.fields])


def manifest(pages: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, pages, counts, notes): page sizes and the numbers of blocks and chunks of each role."""
    counts = blocks.select("doc_id", F.concat(F.lit("blocks_"), "role").alias("k")).unionByName(chunks.select("doc_id", F.concat(F.lit("chunks_"), "role").alias("k")))
    counted = counts.groupBy("doc_id", "k").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("counts"))
    sizes = pages.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_number", F.struct("width", "height").alias("size"))))).alias("pages"))
    notes = F.create_map(
        F.lit("embed_policy"), F.lit(schemas.EMBED_POLICY), F.lit("coord_contract"), F.lit("normalized_top_left")
    )
    return counted.join(sizes, "doc_id", "left").select("doc_id", "pages", "counts", notes.alias("notes"))


def blocks_of(elements: DataFrame, *, strict: bool = False, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, pages): what assembly gets, and the page sizes; elements are dealt by document first.

    They go to as many tasks as their number (``rows``, counted if not given) asks for, so a task's memory does not grow with
    the input.
    """
    rows = elements.count() if rows is None else rows
    tasks = max(elements.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
    # one order for all windows by document or page that come before margins
    dealt = elements.repartition(tasks, "doc_id").sortWithinPartitions("doc_id", "page_number")
    body = layout.without_contents(dealt, strict=strict)
    inner = layout.without_margins(layout.with_boxes(body), ordered=False)
    return layout.attach_captions(layout.merge_text(inner)), layout.page_sizes(body)


def run_chunking(elements: DataFrame, *, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_WORDS, strict: bool = False, tokenizer: Tokenizer | None = None, large: int = LARGE, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunks, manifest) of all documents at once.

    Rows are dealt by document first. All keys that follow begin with the document, so that this is the one shuffle of
    elements; the files' names and the numbers of elements are written beforehand, a row a document. The manifest needs blocks and chunks, which
    would have the blocks made twice: with ``stored`` they are written to the shared folder.
    """
    own = storage.written(elements.sparkSession, elements.groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by("file_name", "ord").alias("source_file")), "documents")
    sizes = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    blocks, pages = blocks_of(elements, strict=strict, rows=sizes["rows"])
    if stored:
        blocks = storage.written(elements.sparkSession, blocks, "blocks")
    # without a long document the plan stays as it is
    options = {"max_tokens": max_tokens, "overlap": overlap, "tokenizer": tokenizer, "large": large if sizes["most"] > large else None}
    raw = chunk_blocks(blocks, **options)
    return finish_chunks(raw, elements, names=own.select("doc_id", "source_file")), manifest(pages, blocks, raw)
