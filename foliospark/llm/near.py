"""N-gram Jaccard join by MinHash banding, with every candidate verified on full n-gram sets.

Nodes are distinct texts; copies of a text are never expanded. Texts that agree in a band meet in that band's bucket. A
bucket's n-gram sets are shuffled once, into blocks bounded by texts and bytes. A block is verified against itself where it
was gathered; blocks of a large bucket are also put down in the shared folder, and tasks that get nothing but two places
read two blocks and verify one against the other. So what is shuffled and stored grows with a bucket's size, only the
comparing with its square. Pairs leave the tasks as link counts and spanning edges alone. A pair that meets in several
buckets counts in the first one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import ceil, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import joins
from foliospark.llm.common import hot_join, hot_keys, in_arrow, open_fs, scratch, text_or_empty, written

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
#: Most hash functions that the choice of bands may take.
MOST_HASHES = 160
#: Most texts in a block of a large bucket, and most bytes of their n-gram sets on average; a task holds two blocks at a time.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Columns of the n-gram matrix that are multiplied at a time.
CHUNK = 4096


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, that reach ``recall`` at ``similarity``."""
    best = None
    for rows in range(1, most + 1):
        bands = ceil(log(1 - recall) / log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("this recall takes more hash functions than allowed")
    return best


@functools.cache
def _words():
    import re

    return re.compile(r"\w+").findall


@functools.cache
def _multipliers(n: int):
    import numpy as np

    return np.random.default_rng(20_011).integers(0, 1 << 63, size=(2, n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, n: int = WORDS):
    """Sorted distinct 64-bit hashes of the n-word runs of a text in lower case; a shorter text is one run."""
    import numpy as np
    import xxhash

    words = _words()(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : len(words) - n + 1 + k])
    return np.unique(out)


def band_hashes(grams, bands: int, rows: int):
    """One 64-bit hash for each band of the MinHash signature of an n-gram set; the band's number is part of it."""
    import numpy as np

    a, b = _multipliers(bands * rows)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        np.minimum(low, (grams[at : at + 2048, None] * a + b).min(axis=0), out=low)
    out = np.arange(bands, dtype=np.uint64)
    for column in low.reshape(bands, rows).T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def _texts(docs: DataFrame, id_column: str, text_column: str, bands: int, rows: int, n: int) -> DataFrame:
    """(doc_id, text_key, bands, n_grams) of every row; n_grams: the size of its set."""
    text = text_or_empty(text_column)
    given = docs.select(F.col(id_column).alias("doc_id"), _key(text), text.alias("text"))

    def run(batches: Iterator):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found, sizes = [], []
                for t in batch.column(2):
                    grams = shingles(t.as_py(), n)
                    sizes.append(len(grams))
                    found.append(band_hashes(grams, bands, rows).tolist() if len(grams) else [])
                columns = [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "bands", "n_grams"])

    kind = docs.schema[id_column].dataType.simpleString()
    return given.transform(in_arrow, run, f"doc_id {kind}, text_key binary, bands array<bigint>, n_grams bigint")


def _key(text):
    return F.unhex(F.md5(text.cast("binary"))).alias("text_key")


def _sets(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str, n: int) -> DataFrame:
    """(text_key, grams) for the wanted (text_key, text_id); grams: the n-gram set as sorted little-endian 64-bit numbers.

    Id and text together are the join's key, so that of a text's copies only the first one's row is met, and a large
    group of copies is spread by its ids. The join shuffles at every size; the wanted keys grow with the input.
    """
    text = text_or_empty(text_column)
    rows = docs.select(F.col(id_column).alias("id"), _key(text), text.alias("text"))
    first = wanted.select(F.col("text_key").alias("key"), "text_id").hint("merge")
    own = rows.join(first, (F.col("text_key") == F.col("key")) & F.col("id").eqNullSafe(F.col("text_id")), "left_semi").select("text_key", "text")

    def run(batches: Iterator):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), n).tobytes() for t in batch.column(1)], pa.binary())], names=["text_key", "grams"])

    return own.transform(in_arrow, run, "text_key binary, grams binary").dropDuplicates(["text_key"])


def _products(of: list, split: int, own: bool):
    """For rows of distinct numbers: how many each of the first ``split`` rows shares with each row (``own``) or each of the rest."""
    import numpy as np

    flat = np.concatenate(of)
    owner = np.repeat(np.arange(len(of)), [len(x) for x in of])
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[place] > 1
    owner, column = owner[keep], number[place[keep]]
    width = int(number[-1]) + 1 if len(number) else 0
    shared = np.zeros((split, len(of) if own else len(of) - split), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, width, CHUNK):
        first, last = np.searchsorted(column, (low, low + CHUNK))
        dense = np.zeros((len(of), min(CHUNK, width - low)), np.float32)
        dense[owner[first:last], column[first:last] - low] = 1
        shared += dense[:split] @ (dense if own else dense[split:]).T
    return shared


def verify(keys: list, grams: list, buckets: list, blocks: list, bucket: int, own: bool, similarity: float) -> list[tuple]:
    """(key, links, root) of the members of a unit that have links in it. ``own``: the unit is a block against itself.

    A unit is one block of a bucket against itself, or two blocks against each other. Links of pairs whose first common
    bucket is another one are left to that bucket. root: the least key of the member's component within the unit.
    """
    import numpy as np

    order = sorted(range(len(keys)), key=lambda i: (blocks[i], keys[i]))
    keys, grams, buckets, blocks = ([x[i] for i in order] for x in (keys, grams, buckets, blocks))
    split = len(keys) if own else blocks.index(blocks[-1])
    if not split:  # one of the two blocks is empty
        return []
    earlier = [b[b < bucket] for b in buckets]
    sizes = np.array([len(g) for g in grams], np.float32)
    shared = _products(grams, split, own)
    union = sizes[:split, None] + (sizes if own else sizes[split:])[None, :] - shared
    linked = (shared > 0) & (shared >= similarity * union.astype(np.float64) - 1e-9)
    if any(len(e) for e in earlier):
        linked &= _products(earlier, split, own) == 0
    if own:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(keys), np.int64)
    links[:split] += linked.sum(axis=1)
    if not own:
        links[split:] += linked.sum(axis=0)
    root = np.full(len(keys), -1)
    for start in sorted(np.nonzero(links)[0].tolist(), key=keys.__getitem__):
        if root[start] >= 0:
            continue
        root[start], ahead = start, [start]
        while ahead:
            x = ahead.pop()
            near = np.nonzero(linked[x] if x < split else linked[:, x - split])[0] + (0 if own or x >= split else split)
            fresh = near[root[near] < 0]
            root[fresh] = start
            ahead += fresh.tolist()
    return [(keys[i], int(links[i]), keys[root[i]]) for i in range(len(keys)) if links[i]]


VERIFIED = "text_key binary, links bigint, root binary, bucket bigint, block int, file string, offset bigint, length bigint"


def _told(links: list[tuple], places: list[tuple]):
    """A batch of VERIFIED: rows of links, and places of blocks that were put down."""
    import pyarrow as pa

    rows = [(*x, None, None, None, None, None) for x in links] + [(None, None, None, *p) for p in places]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    names = ["text_key", "links", "root", "bucket", "block", "file", "offset", "length"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _packed(keys: list, grams: list, others: list) -> bytes:
    """A block as an Arrow stream of one batch."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([g.tobytes() for g in grams], pa.large_binary()), pa.array([o.tobytes() for o in others], pa.binary())], names=["k", "g", "o"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> tuple[list, list, list]:
    import numpy as np
    import pyarrow as pa

    keys, grams, others = (c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns)
    return keys, [np.frombuffer(g, np.uint64) for g in grams], [np.frombuffer(o, np.int64) for o in others]


def _gathered(rows: DataFrame, directory: str, similarity: float) -> DataFrame:
    """VERIFIED rows of (bucket, block, blocks, text_key, grams, buckets), sorted so that a block's rows stand together.

    Links are those within a block; a block of several is put down in ``directory``. A lost or repeated attempt leaves at
    most a file that no committed row names.
    """

    def run(batches: Iterator):
        import uuid

        import numpy as np

        files, root = open_fs(directory)
        name, sink, at, unit, held, links, places = f"{uuid.uuid4().hex}.blocks", None, 0, None, [], [], []

        def done():
            nonlocal sink, at
            keys, grams, others = (list(c) for c in zip(*held, strict=True))
            if len(keys) > 1:
                links.extend(verify(keys, grams, others, [0] * len(keys), unit[0], True, similarity))
            if unit[2] > 1:
                if sink is None:
                    files.create_dir(root, recursive=True)
                    sink = files.open_output_stream(f"{root}/{name}")
                data = _packed(keys, grams, others)
                sink.write(data)
                places.append((unit[0], unit[1], name, at, len(data)))
                at += len(data)

        for batch in batches:
            columns = batch.columns
            for i in range(batch.num_rows):
                bucket, block, blocks, key, grams, others = (c[i].as_py() for c in columns)
                if unit != (bucket, block, blocks):
                    if held:
                        done()
                    unit, held = (bucket, block, blocks), []
                held.append((key, np.frombuffer(grams, np.uint64), np.array(others, np.int64)))
                if len(links) > 10_000:
                    yield _told(links, places)
                    links, places = [], []
        if held:
            done()
        if sink is not None:
            sink.close()
        if links or places:
            yield _told(links, places)

    return rows.transform(in_arrow, run, VERIFIED)


def _across(units: DataFrame, directory: str, similarity: float) -> DataFrame:
    """Links between two blocks of a bucket that lie in ``directory``, for rows (bucket, place of one, place of the other)."""

    def run(batches: Iterator):
        files, root = open_fs(directory)
        known: dict[tuple, tuple] = {}

        def block(*place):
            if place not in known:
                while len(known) > 1:
                    known.pop(next(iter(known)))
                file, offset, length = place
                with files.open_input_file(f"{root}/{file}") as handle:
                    known[place] = _unpacked(handle.read_at(length, offset))
            return known[place]

        for batch in batches:
            for bucket, *places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = block(*places[:3]), block(*places[3:])
                sides = [0] * len(one[0]) + [1] * len(two[0])
                if links := verify(*(a + b for a, b in zip(one, two, strict=True)), sides, bucket, False, similarity):
                    yield _told(links, [])

    return units.transform(in_arrow, run, VERIFIED)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is one node of the component, the same for all of it.

    Each round every node joins its least neighbour and edges are contracted; keys are hashes, so a constant share of the
    nodes is expected to go each round. Nothing is gathered in one place: the edges of a hub and the nodes of a large label
    are dealt to many tasks. Rounds are cut by tables in the shared folder.
    """
    spark = edges.sparkSession

    def joined(left, right, key, spread, n, how="inner"):
        if n <= joins.LEAST_HOT:  # so few rows that no key is hot
            return left.join(right, key, how)
        return hot_join(left, right, [key], hot_keys(left.groupBy(key).agg(F.count("*").alias("n")), [key]), F.col(spread), how)

    edges = written(spark, edges.select("a", "b").where("a <> b").distinct(), "edges")
    maps = []
    while n := edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(spark, both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up")), "up")
        maps.append(up)
        one = joined(edges, up.toDF("a", "up_a"), "a", "b", n).select(F.col("up_a").alias("a"), "b")
        edges = written(
            spark, joined(one, up.toDF("b", "up_b"), "b", "a", n).select("a", F.col("up_b").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
        )
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = maps[0].toDF("node", "label")
    nodes = labels.count()
    for up in maps[1:]:
        labels = joined(labels, up.toDF("label", "up"), "label", "node", nodes, "left").select("node", F.coalesce("up", "label").alias("label"))
    return labels


def linked_texts(
    docs: DataFrame, *, similarity: float = SIMILARITY, n: int = WORDS, recall: float = RECALL, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): rows has (doc_id, text_key) for every document; texts has (text_key, text_id, n, n_links, label).

    text_id is the least doc_id of the text's copies, n their number, n_links the number of other distinct texts with at
    least the given Jaccard similarity of n-gram sets, label the same for all texts of a component of links. Null texts
    count as empty ones; texts without words have no links and their own label; a similarity equal to the limit is a link;
    repeated rows are copies; null ids are passed over for text_id; texts of any length are taken whole; extra columns are not
    read; an empty table gives two empty results.
    """
    spark = docs.sparkSession
    bands, rows = choose_bands(similarity, recall)
    base = written(spark, _texts(docs, id_column, text_column, bands, rows, n), "near-rows")
    one = [F.count("*").alias("n"), F.min("doc_id").alias("text_id"), F.first("bands").alias("bands"), F.first("n_grams").alias("n_grams")]
    texts = written(spark, base.groupBy("text_key").agg(*one), "near-texts")
    spots = texts.select("text_key", "n_grams", F.explode("bands").alias("bucket"))
    same = (F.bit_xor(F.xxhash64("text_key")).alias("x"), F.bit_xor(F.xxhash64("text_key", F.lit(1))).alias("y"))
    full = spots.groupBy("bucket").agg(F.count("*").alias("n"), (F.sum("n_grams") * 8).alias("bytes"), *same).where("n > 1")
    # of buckets with the very same texts, one is enough
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    kept = written(spark, full.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.max("bytes").alias("bytes")).select("bucket", blocks.alias("blocks")), "near-buckets")
    members = written(spark, spots.drop("n_grams").join(kept, "bucket"), "near-members")
    per_text = members.groupBy("text_key").agg(F.collect_list("bucket").alias("buckets"))
    wanted = per_text.join(texts.select("text_key", "text_id"), "text_key")
    sets = _sets(docs, wanted, id_column, text_column, n).join(per_text, "text_key")
    own = F.pmod(F.xxhash64("text_key", "bucket"), F.col("blocks")).cast("int")
    placed = members.select("text_key", "bucket", own.alias("block"), "blocks").join(sets, "text_key").select("bucket", "block", "blocks", "text_key", "grams", "buckets")
    dealt = placed.repartitionByRange("bucket", "block").sortWithinPartitions("bucket", "block")
    directory = scratch(spark, "near-blocks")
    found = written(spark, _gathered(dealt, directory, similarity), "near-links")
    places = found.where("file is not null").select("bucket", "block", "file", "offset", "length")
    sizes = places.groupBy("bucket").agg(F.count("*").alias("n"))
    if count := int(sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0):
        # a bucket's places stand in one array, which meets its blocks where these are dealt; each makes its own pairs
        others = places.groupBy("bucket").agg(F.collect_list(F.struct(F.col("block").alias("j"), F.col("file").alias("file_j"), F.col("offset").alias("offset_j"), F.col("length").alias("length_j"))).alias("others"))
        met = hot_join(places, others, ["bucket"], hot_keys(sizes, ["bucket"], least=256), F.col("block"))
        pairs = met.select("bucket", F.col("block").alias("i"), "file", "offset", "length", F.explode(F.filter("others", lambda o: o["j"] > F.col("block"))).alias("o")).select("bucket", "i", "o.j", "file", "offset", "length", "o.file_j", "o.offset_j", "o.length_j")
        units = pairs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(count, 100_000)), "bucket", "i", "j").drop("i", "j")
        found = found.unionByName(written(spark, _across(units, directory, similarity), "near-links"))
    found = found.where("text_key is not null")
    links = found.groupBy("text_key").agg(F.sum("links").alias("n_links"))
    labels = components(found.select(F.col("text_key").alias("a"), F.col("root").alias("b")))
    result = (
        texts.select("text_key", "text_id", "n").join(links, "text_key", "left").join(labels.withColumnRenamed("node", "text_key"), "text_key", "left")
        .select("text_key", "text_id", "n", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "text_key").alias("label"))
    )
    return base.select("doc_id", "text_key"), result


def classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, text_id, n_links) of every row.

    class_id: the least doc_id of the component of links and copies; text_id: that of the rows with the same text; n_links:
    the number of other distinct texts at the similarity or above (a similarity equal to it, a tie, is a link). Null texts
    count as empty; texts without words have copies but no links; nulls in doc_id are passed over when the least is taken (a
    class of nulls alone has none). Repeated rows are copies, and the copies of a text are dealt to many tasks. Texts of any
    length are taken whole; a block holds about BLOCK_BYTES of sets, or one longer text's. Extra columns are not read. An
    empty table gives an empty result.
    """
    rows, texts = linked_texts(docs, **options)
    texts = written(docs.sparkSession, texts, "near-classes")
    least = texts.groupBy("label").agg(F.min("text_id").alias("class_id"), F.count("*").alias("n"))
    named = hot_join(texts.drop("n"), least.drop("n"), ["label"], hot_keys(least, ["label"]), F.col("text_key")).select("text_key", "text_id", "n_links", "class_id")
    return hot_join(rows, named, ["text_key"], hot_keys(texts, ["text_key"]), F.col("doc_id")).select("doc_id", "class_id", "text_id", "n_links")


def one_of_each(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The columns of ``docs`` for one row of each class: that of the least doc_id (a class of null ids keeps one of them).

    Nulls, ties, repeats, long texts and empty tables as in ``classes``; of rows that repeat id and text one stays.
    """
    _, texts = linked_texts(docs, id_column=id_column, text_column=text_column, **options)
    texts = written(docs.sparkSession, texts, "near-classes")
    first = F.min(F.struct(F.col("text_id").isNull().alias("none"), F.col("text_id").alias("text_id"), F.col("text_key").alias("text_key")))
    chosen = texts.groupBy("label").agg(first.alias("f")).select("f.text_key", "f.text_id")
    # id and text together are the key, so that a text's copies are spread; repeated rows then need no further shuffle
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    first = chosen.select(F.col("text_key").alias("__key"), named("text_id").alias("__id"))
    keyed = docs.withColumn("__key", _key(text_or_empty(text_column))).withColumn("__id", named(id_column))
    joined = keyed.join(first.hint("merge"), ["__key", "__id"], "left_semi")
    return joined.dropDuplicates(["__key", "__id"]).select(*[F.col(f"`{c}`") for c in docs.columns])
