"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form a group and always share a shard. All groups are differenced, at two levels. Groups with more
than ``1/heavy_parts`` of the bytes (fewer than ``heavy_parts`` of these) go to the driver as they are. All others are dealt
to cells of some 50,000 by a hash; a task differences a cell's groups into one partial partition of ``shards`` parts. Where
there are more than MOST_CELLS of these, tasks difference them again, MOST_CELLS at a time, level by level; the driver goes
on with heavy groups and the partial partitions that are left by the same rule. Balanced parts cannot make up for a heavy
group, so as many cells as the heavy groups need are differenced into smaller parts, which count as single items. What the
driver sees is at most ``shards`` sums for each of MOST_CELLS partial partitions, ``heavy_parts + LOOSE`` items, and a
count for each of MOST_CHUNKS chunks of a shard, whatever the table's size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import hot_join, hot_keys, in_arrow, text_or_empty, written

#: Groups in a cell, and rows of a shard in a chunk, on average.
CELL, CHUNK = 50_000, 1_000_000
#: Partial partitions that the driver, or a task of a higher level, differences; chunks of a shard at most.
MOST_CELLS, MOST_CHUNKS = 4096, 8192
#: A group with more than this part of all bytes is heavy; parts that loose cells give in all, and in one at most.
HEAVY_PARTS, LOOSE, MOST_LOOSE = 4096, 65_536, 512
#: Parts of a loose cell that are differenced; where it may have more, these are single groups of all sizes, the largest ones
#: and some from the whole range, so that gaps of any width can be filled.
BUNDLES = 64


def combine(partials: list[tuple[list, list]], shards: int) -> list[list]:
    """Karmarkar-Karp over partial partitions (sums, parts) of ``shards`` parts at most: the parts of the one that is left.

    A heap holds them by spread. The two with the largest spread are combined with opposite orders (the heaviest part of
    one meets the lightest of the other) until one is left. Ties go by the order given. Sums are kept above the lightest,
    and empty parts are left out, so that memory grows with the items and not with their product with the parts.
    """

    def kept(n: int, entries: list) -> tuple:
        entries.sort(key=lambda x: -x[0])
        if len(entries) == shards and entries[-1][0]:
            low = entries[-1][0]
            entries = [(total - low, part) for total, part in entries]
        return (-entries[0][0] if entries else 0, n, entries)

    heap = [kept(n, [(total, part) for total, part in zip(sums, parts, strict=True) if part]) for n, (sums, parts) in enumerate(partials)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, n, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        alone, other = max(0, min(len(one), shards - len(two))), max(0, min(len(two), shards - len(one)))
        joined = one[:alone] + two[:other]
        for (total, part), (total2, part2) in zip(one[alone:], reversed(two[other:]), strict=True):
            long, short = (part, part2) if len(part) >= len(part2) else (part2, part)
            long.extend(short)
            joined.append((total + total2, long))
        heapq.heappush(heap, kept(n, joined))
    parts = [part for _, part in heap[0][2]] if heap else []
    return parts + [[] for _ in range(shards - len(parts))]


def difference(sizes: dict, shards: int) -> dict:
    """item -> shard, differencing all items. Larger items come first, ties go by the items' order; no items: an empty result."""
    ordered = sorted(sizes.items(), key=lambda x: (-x[1], x[0]))
    return {item: shard for shard, part in enumerate(combine([([size], [[item]]) for item, size in ordered], shards)) for item in part}


def _cells(groups: DataFrame, shards: int, loose: int, loose_parts: int) -> DataFrame:
    """(cell, key, part) of every group of (cell, key, bytes), sorted by cell; and (cell, null, part, sum) of every part.

    The first ``loose`` cells have ``loose_parts`` parts, the others one for each shard.
    """

    def run(batches: Iterator):
        import pyarrow as pa

        def done():
            sizes, parts, alone = dict(held), shards, []
            if cell < loose:
                parts = loose_parts
                falling, room = sorted(sizes, key=lambda k: (-sizes[k], k)), max(0, min(parts - BUNDLES, len(sizes)))
                alone = falling[: room // 2]
                rest = falling[room // 2 :]
                alone += [rest[i * len(rest) // (room - room // 2)] for i in range(room - room // 2)]
            single = set(alone)
            placed = difference({k: v for k, v in sizes.items() if k not in single} if alone else sizes, parts - len(alone))
            placed |= {k: parts - len(alone) + i for i, k in enumerate(alone)}
            sums = [0] * parts
            for key, part in placed.items():
                sums[part] += sizes[key]
            rows = [(cell, key, part, None) for key, part in placed.items()] + [(cell, None, part, total) for part, total in enumerate(sums)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["cell", "key", "part", "sum"])

        cell, held = None, []
        for batch in batches:
            for own, key, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != cell:
                    if held:
                        yield done()
                    cell, held = own, []
                held.append((key, size))
        if held:
            yield done()

    return groups.transform(in_arrow, run, "cell long, key long, part int, sum long")


def _levels(parted: DataFrame, shards: int, loose: int, cells: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """(sums, maps): (cell, part, sum) of at most ``most`` partial partitions beside the loose cells, and for each level a table
    (cell, part, up, up_part): which part of which cell above a part went to.

    The tight cells that a hash brings together, ``most`` of them on average, are combined in one task.
    """
    spark = parted.sparkSession
    sums = parted.where("key is null").select("cell", "part", "sum")
    maps, level = [], 0

    def run(batches: Iterator):
        import pyarrow as pa

        def done():
            own = sorted(held.items())
            parts = combine([([own_sums[p] for p in sorted(own_sums)], [[(c, p)] for p in sorted(own_sums)]) for c, own_sums in own], shards)
            rows = [(c, p, up, n, None) for n, part in enumerate(parts) for c, p in part]
            rows += [(None, None, up, n, sum(held[c][p] for c, p in part)) for n, part in enumerate(parts)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["cell", "part", "up", "up_part", "sum"])

        up, held = None, {}
        for batch in batches:
            for above, c, p, total in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if above != up:
                    if held:
                        yield done()
                    up, held = above, {}
                held.setdefault(c, {})[p] = total
        if held:
            yield done()

    tight = cells - loose
    while tight > most:
        level += 1
        above = -(-tight // most)
        # cells of a level are numbered from 0 again; loose ones stay as they are
        told = sums.where(F.col("cell") >= loose).select((F.pmod(F.xxhash64("cell", F.lit(level)), F.lit(above)) + loose).alias("up"), "cell", "part", "sum")
        done = written(spark, told.repartition(above, "up").sortWithinPartitions("up").transform(in_arrow, run, "cell long, part int, up long, up_part int, sum long"), "shard-levels")
        maps.append(done.where("sum is null").select("cell", "part", "up", "up_part"))
        sums = sums.where(F.col("cell") < loose).unionByName(done.where("sum is not null").select(F.col("up").alias("cell"), F.col("up_part").alias("part"), "sum"))
        tight = above
    return sums, maps


def _place(heavy: dict[int, int], sums: dict[int, list[int]], shards: int, loose: int) -> tuple[dict, dict]:
    """(heavy key -> shard, (cell, part) -> shard): heavy groups and loose parts as single items, other cells as they are."""
    items = [([size], [[key]]) for key, size in sorted(heavy.items(), key=lambda x: (-x[1], x[0]))]
    for cell, own in sorted(sums.items()):
        if cell < loose:
            items += [([size], [[(cell, part)]]) for part, size in enumerate(own)]
        else:
            items.append((own, [[(cell, part)] for part in range(len(own))]))
    placed = {item: shard for shard, part in enumerate(combine(items, shards)) for item in part}
    return {k: v for k, v in placed.items() if not isinstance(k, tuple)}, {k: v for k, v in placed.items() if isinstance(k, tuple)}


def shard_documents(docs: DataFrame, *, shards: int = 8, cell: int = CELL, chunk: int = CHUNK, heavy_parts: int = HEAVY_PARTS, most_cells: int = MOST_CELLS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of ``docs``.

    size is the text's UTF-8 bytes plus 1; a null text counts as empty and shares the group of the empty text. Slots
    run from 0 without gaps in each shard; they follow from the rows alone, not from how the table is split. Rows equal in
    id and text get distinct slots; null ids are kept. Texts of any length are one row each. An empty table gives an empty
    result. Extra columns are neither read nor returned, whatever their names.

    Slots need no sort of a whole shard: rows have a chunk by the hash of id and text, some ``chunk`` rows of each shard in
    one, the driver adds up a count for each shard and chunk, and ranks are taken within a chunk. Equal rows share a chunk.
    """
    spark: SparkSession = docs.sparkSession
    text = text_or_empty(text_column)
    rows = written(
        spark,
        docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")),
        "shard-rows",
    )
    groups = written(spark, rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    totals = groups.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.sum("bytes").alias("bytes")).first()
    cells, chunks = 1 + totals["groups"] // cell, min(MOST_CHUNKS, 1 + (totals["rows"] or 0) // (shards * chunk))
    is_heavy = F.col("bytes") > F.lit((totals["bytes"] or 0) / heavy_parts)
    heavy = {r["key"]: r["bytes"] for r in groups.where(is_heavy).select("key", "bytes").collect()}  # fewer than heavy_parts
    loads = [0] * shards
    for key, shard in difference(heavy, shards).items():
        loads[shard] += heavy[key]
    light, need = (totals["bytes"] or 0) - sum(loads), shards * max(loads) - sum(loads)
    loose = min(cells, ceil(1.1 * cells * need / light)) if light and need else 0
    loose_parts = max(shards, min(MOST_LOOSE, LOOSE // max(1, loose)))
    celled = groups.where(~is_heavy).select(F.pmod(F.xxhash64("key"), F.lit(cells)).alias("cell"), "key", "bytes")
    parted = written(spark, _cells(celled.repartition(cells, "cell").sortWithinPartitions("cell"), shards, loose, loose_parts), "shard-cells")
    left, maps = _levels(parted, shards, loose, cells, most_cells)
    sums: dict[int, list[int]] = {}
    for r in sorted(left.collect()):
        sums.setdefault(r["cell"], []).append(r["sum"])
    alone, of_part = _place(heavy, sums, shards, loose)
    where = spark.createDataFrame([(c, p, shard) for (c, p), shard in of_part.items()], "cell long, part int, shard int")
    for known in reversed(maps):  # down the levels; loose cells are in none of them
        below = known.join(where.select(F.col("cell").alias("up"), F.col("part").alias("up_part"), "shard"), ["up", "up_part"]).select("cell", "part", "shard")
        where = below.unionByName(where.where(F.col("cell") < loose))
    shard_of = parted.where("key is not null").join(where, ["cell", "part"]).select("key", "shard").unionByName(spark.createDataFrame(list(alone.items()), "key long, shard int"))
    dealt = hot_join(rows, shard_of, ["key"], hot_keys(groups, ["key"]), F.col("doc_id")).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "key", F.lit(1)), F.lit(chunks)).cast("int"))
    dealt = written(spark, dealt, "shard-dealt")
    offsets, ends = [], {}
    for r in sorted(dealt.groupBy("shard", "chunk").count().collect()):
        offsets.append((r["shard"], r["chunk"], ends.get(r["shard"], 0)))
        ends[r["shard"]] = ends.get(r["shard"], 0) + r["count"]
    start = spark.createDataFrame(offsets, "shard int, chunk int, start long")
    rank = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size", "key"))
    return dealt.withColumn("rank", rank).join(start, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))
