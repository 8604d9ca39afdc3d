"""Hard-negative mining by a Voronoi-partitioned kNN join.

The nearest rows by inner product are the nearest by distance once every row gets a further component that brings its length
to the longest one's (an anchor's is 0). Rows belong to the nearest of some pivots; each cell keeps, for every label, the
distances of the few rows nearest to its pivot. By the triangle inequality these bound how far an anchor's positives can be,
and the positives' scores bound how far and how near its negatives can be. Anchors are grouped by cells that lie together; a
row is sent to the groups one of whose cells it might serve, dealt to as many units as the group's work needs, and every
unit joins its rows exactly with its anchors, in whole numbers. A window merges the units' best rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.balls import quantized
from foliospark.llm.common import hot_join, hot_keys, in_arrow, written

POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least so many hundredths of the positive's, and not above it.
LEAST_PERCENT = 80
#: Pivots at most, and buckets of labels: together they bound what the driver and the tasks hold of all cells.
MOST_PIVOTS, BUCKETS = 1024, 64
#: Anchors in a group, and groups (beside those of single cells) at most; the larger bound of the two rules.
ANCHORS, MOST_GROUPS = 4096, 16_384
#: Pairs in a unit: as many as make about UNITS of them, within these bounds.
UNITS, LEAST_WORK, MOST_WORK = 1024, 1 << 20, 1 << 30
#: Candidates that meet a unit's anchors at a time, and rows that are dealt out at a time.
STEP, SLICE = 1024, 1000

DEALT = "unit long, kind int, vec_id long, label int, v array<int>, ids array<long>, scores array<long>"
FOUND = "anchor_id long, positive_id long, positive_score long, found_id long, score long"


@dataclass
class Space:
    """Pivots and what all rows have in common; every field is bounded by the parameters."""

    pivots: list[list[int]]
    longest: float
    exact_in_double: bool

    def matrix(self):
        import numpy as np

        p = np.array(self.pivots, np.float64)
        return p, np.sqrt(np.maximum(self.longest - np.square(p).sum(1), 0))

    def slack(self) -> float:
        """More than the rounding of any distance."""
        return 1e-6 * (self.longest**0.5 + 1)


def _distances(rows, space: Space, *, anchors: bool):
    """Of rows (as stored, or as anchors) from all pivots, in the space with the further component."""
    import numpy as np

    p, p_more = space.matrix()
    v = rows.astype(np.float64)
    length = np.square(v).sum(1)
    more = np.zeros(len(v)) if anchors else np.sqrt(np.maximum(space.longest - length, 0))
    whole = length if anchors else np.full(len(v), space.longest)
    return np.sqrt(np.maximum(whole[:, None] + space.longest - 2 * (v @ p.T + more[:, None] * p_more[None, :]), 0))


def _matrix(column, n: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def _celled(rows: DataFrame, space: Space, *, anchors: bool) -> DataFrame:
    """(vec_id, label, v, cell, away): the nearest pivot of every row, and how far it is."""

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                apart = _distances(_matrix(batch.column(2), batch.num_rows), space, anchors=anchors)
                cell = apart.argmin(1)
                columns = [*batch.columns[:3], pa.array(cell, pa.int32()), pa.array(apart[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v", "cell", "away"])

    return rows.select("vec_id", "label", "v").transform(in_arrow, run, "vec_id long, label int, v array<int>, cell int, away double")


@dataclass
class Deal:
    """Which groups the anchors of a (cell, bucket) are in, how far such a cell reaches, and into how many units a group is dealt."""

    groups: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    reach: dict[tuple[int, int], tuple[float, float]] = field(default_factory=dict)
    units: list[tuple[int, int]] = field(default_factory=list)


def deal(bounds: list[tuple[int, int, int, float, float]], rows: dict[int, int], space: Space, anchors: int = ANCHORS) -> Deal:
    """The deal for (cell, bucket, anchors, least, most): what lies between least and most from the pivot may serve the cell.

    Within a bucket cells are taken along a chain, each one the nearest to the one before, and fill up groups of at most
    ``anchors``; a cell with more has groups of its own. ``rows``: the number of rows that may be sent in each bucket.
    """
    import numpy as np

    out, sizes = Deal(), []
    anchors = max(anchors, -(-sum(b[2] for b in bounds) // MOST_GROUPS))
    p, more = space.matrix()
    p = np.column_stack([p, more])
    by: dict[int, list] = {}
    for b in sorted(bounds):
        by.setdefault(b[1], []).append(b)
    for bucket, cells in sorted(by.items()):
        ahead, room = {b[0]: b for b in cells}, 0
        at = cells[0][0]
        while ahead:
            cell, _, n, least, most = ahead.pop(at)
            out.reach[cell, bucket] = least, most
            if n > anchors:
                parts = -(-n // anchors)
                out.groups[cell, bucket] = len(sizes), parts
                sizes += [(bucket, -(-n // parts))] * parts
                room = 0
            else:
                if room < n:
                    sizes.append((bucket, 0))
                    room = anchors
                sizes[-1] = bucket, sizes[-1][1] + n
                room -= n
                out.groups[cell, bucket] = len(sizes) - 1, 1
            if ahead:
                others = sorted(ahead)
                at = others[int(np.square(p[others] - p[cell]).sum(1).argmin())]
    total = sum(n * rows.get(bucket, 0) for bucket, n in sizes)
    work, first = min(max(total // UNITS, LEAST_WORK), MOST_WORK), 0
    for bucket, n in sizes:
        splits = max(1, -(-n * rows.get(bucket, 0) // work))
        out.units.append((first, splits))
        first += splits
    return out


def _bucket(label: str, buckets: int) -> Column:
    return F.pmod(F.col(label), F.lit(buckets)) if buckets > 1 else F.lit(0)


def _dealt(rows: DataFrame, space: Space, plan: Deal, buckets: int) -> DataFrame:
    """DEALT rows (kind 1) of every stored row for the units it might serve."""
    groups, reach, units = plan.groups, plan.reach, plan.units

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        slack = space.slack()
        least, most = np.full((len(space.pivots), buckets), np.inf), np.full((len(space.pivots), buckets), -np.inf)
        first, parts = np.zeros((len(space.pivots), buckets), np.int64), np.zeros((len(space.pivots), buckets), np.int64)
        for (cell, bucket), (low, high) in reach.items():
            least[cell, bucket], most[cell, bucket] = low - slack, high + slack
            first[cell, bucket], parts[cell, bucket] = groups[cell, bucket]
        start, splits = np.array([u[0] for u in units]), np.array([u[1] for u in units])
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                apart = _distances(_matrix(batch.column(2), batch.num_rows), space, anchors=False)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                bucket = np.mod(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), buckets)
                row, cell = np.nonzero((apart >= least.T[bucket]) & (apart <= most.T[bucket]))
                n = parts[cell, bucket[row]]
                of = np.repeat(np.arange(len(row)), n)
                group = first[cell, bucket[row]][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                pairs = np.unique(row[of] * len(units) + group)  # a group of several cells gets a row once
                row, group = pairs // len(units), pairs % len(units)
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                unit = start[group] + (mixed[row] % splits[group].astype(np.uint64)).astype(np.int64)
                for low in range(0, len(row), 20_000):
                    taken = pa.array(row[low : low + 20_000])
                    columns = [pa.array(unit[low : low + 20_000], pa.int64()), pa.array(np.ones(len(taken), np.int32)), *(batch.column(i).take(taken) for i in range(3))]
                    columns += [pa.nulls(len(taken), pa.list_(pa.int64()))] * 2
                    yield pa.RecordBatch.from_arrays(columns, names=["unit", "kind", "vec_id", "label", "v", "ids", "scores"])

    return rows.select("vec_id", "label", "v").transform(in_arrow, run, DEALT)


def _dealt_anchors(anchors: DataFrame, plan: Deal, buckets: int) -> DataFrame:
    """DEALT rows (kind 0) of every anchor, once for each unit of its group. The plan's table has a row a cell and bucket."""
    spark = anchors.sparkSession
    cells = spark.createDataFrame([(c, b, *g) for (c, b), g in plan.groups.items()], "cell int, bucket int, first int, parts int")
    units = spark.createDataFrame([(g, *u) for g, u in enumerate(plan.units)], "group int, start long, splits long")
    placed = anchors.withColumn("bucket", _bucket("label", buckets)).join(F.broadcast(cells), ["cell", "bucket"])
    placed = placed.withColumn("group", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).join(F.broadcast(units), "group")
    return placed.select(F.explode(F.sequence("start", F.col("start") + F.col("splits") - 1)).alias("unit"), F.lit(0).alias("kind"), "vec_id", "label", "v", "ids", "scores")


class Best:
    """The k best (score, id) of each of ``n`` slots: higher scores first, ties by the smaller id."""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.k, self.slot, self.id, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: Lower scores cannot enter any more.
        self.cutoff = np.full(n, np.iinfo(np.int64).min)

    def add(self, slot, ids, score) -> None:
        import numpy as np

        slot, ids, score = np.concatenate([self.slot, slot]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last, keep = rank == self.k - 1, rank < self.k
        self.cutoff[slot[last]] = score[last]
        self.slot, self.id, self.score = slot[keep], ids[keep], score[keep]


def _joined(dealt: DataFrame, k: int, exact_in_double: bool, least_percent: int | None) -> DataFrame:
    """FOUND rows: the k best of every anchor's slots in every unit, of rows sorted by unit and kind.

    Without ``least_percent`` an anchor has one slot, for other rows of its label (positive_id and positive_score are null).
    With it, a slot for each of ``scores``: rows of other labels from so many hundredths of that score up to the score.
    """

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        kind_of = np.float64 if exact_in_double else np.int64
        unit, held, anchors, best = None, [], None, None

        def ready():
            nonlocal anchors, best
            ids, labels, v = (np.concatenate(x) for x in zip(*(h[:3] for h in held), strict=True))
            own = [s for h in held for s in h[4]]
            width = 1 if least_percent is None else max(map(len, own), default=0)
            scores = np.full((len(ids), width), np.iinfo(np.int64).min // 200)
            for i, s in enumerate(own):
                scores[i, : len(s)] = s
            floor = -((-least_percent * scores) // 100) if least_percent is not None else None
            anchors = ids, labels, v.astype(kind_of), [s for h in held for s in h[3]], scores, floor
            best = Best(len(ids) * width, k)

        def meet(ids, labels, v):
            own, own_labels, q, _, scores, floor = anchors
            product = (q @ v.astype(kind_of).T).astype(np.int64)
            same = own_labels[:, None] == labels[None, :]
            if least_percent is None:
                i, j = np.nonzero(same & (own[:, None] != ids[None, :]) & (product >= best.cutoff[:, None]))
                best.add(i, ids[j], product[i, j])
                return
            width = scores.shape[1]
            least = np.maximum(floor, best.cutoff.reshape(scores.shape))
            i, j = np.nonzero(~same & (product >= least.min(1)[:, None]) & (product <= scores.max(1)[:, None]))
            score, slots = product[i, j], []
            for r in range(width):
                fits = (score <= scores[i, r]) & (score >= least[i, r])
                slots.append((i[fits] * width + r, ids[j[fits]], score[fits]))
            if slots:
                best.add(*(np.concatenate(x) for x in zip(*slots, strict=True)))

        def told():
            own, _, _, positives, scores, _ = anchors
            width = scores.shape[1]
            for low in range(0, len(best.slot), 50_000):
                part = slice(low, low + 50_000)
                i, r = best.slot[part] // max(width, 1), best.slot[part] % max(width, 1)
                empty = pa.nulls(len(i), pa.int64())
                known = [pa.array([positives[a][b] for a, b in zip(i.tolist(), r.tolist(), strict=True)], pa.int64()), pa.array(scores[i, r])] if least_percent is not None else [empty, empty]
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), *known, pa.array(best.id[part]), pa.array(best.score[part])], names=["anchor_id", "positive_id", "positive_score", "found_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            units, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = [0, *(np.nonzero((units[1:] != units[:-1]) | (kinds[1:] != kinds[:-1]))[0] + 1).tolist(), len(units)]
            for low, high in zip(edges, edges[1:], strict=False):
                if units[low] != unit:
                    if best is not None:
                        yield from told()
                    unit, held, anchors, best = units[low], [], None, None
                part = batch.slice(low, high - low)
                ids, labels = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
                v = _matrix(part.column(4), high - low)
                if kinds[low] == 0:
                    held.append((ids, labels, v, *(part.column(i).to_pylist() if least_percent is not None else [[]] * len(ids) for i in (5, 6))))
                elif held:
                    if best is None:
                        ready()
                    for at in range(0, len(ids), STEP):
                        meet(ids[at : at + STEP], labels[at : at + STEP], v[at : at + STEP])
        if best is not None:
            yield from told()

    return dealt.transform(in_arrow, run, FOUND)


def _search(rows: DataFrame, anchors: DataFrame, space: Space, *, buckets: int, k: int, group: int, least_percent: int | None) -> DataFrame:
    """FOUND rows of anchors (vec_id, label, v, cell, least, most, ids, scores) and all rows, written."""
    spark = rows.sparkSession
    bounds = anchors.groupBy("cell", _bucket("label", buckets).alias("bucket")).agg(F.count("*").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect()  # pivots x buckets rows at most
    sent = {r["bucket"]: r["n"] for r in rows.groupBy(_bucket("label", buckets).alias("bucket")).agg(F.count("*").alias("n")).collect()}
    plan = deal([tuple(b) for b in bounds], sent, space, group)
    dealt = _dealt(rows, space, plan, buckets).unionByName(_dealt_anchors(anchors, plan, buckets))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(sum(u[1] for u in plan.units), 100_000))
    return written(spark, _joined(dealt.repartition(parts, "unit").sortWithinPartitions("unit", "kind"), k, space.exact_in_double, least_percent), "mined")


def prepared(vectors: DataFrame, *, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, label, v): rows that take part, one for each id, with components as whole numbers."""
    given = vectors.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    kept = quantized(given, id_column=id_column, vector_column=vector_column, keep=(F.col(label_column).cast("int").alias("label"),))
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", "s.v")


def hard_negatives(
    rows: DataFrame, anchors: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, pivots: int | None = None, group: int = ANCHORS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors among ``rows`` (vec_id, label, v).

    A score is the inner product of whole components; higher ones come first, ties by the smaller id. An anchor's positives
    are its best other rows of its label; the negatives of an anchor and a positive are the best rows of other labels whose
    score is between ``least_percent`` hundredths of the positive's and the positive's (so a positive with a negative score has
    none). Both are exact; pivots (rows of the least hashes of their ids) and groups decide about speed alone.

    ``prepared`` gives such rows: ids, labels and components that are null or not finite take no part, and rows that repeat an id
    count once, with the least label and then the least vector. Vectors of fewer components than the longest are filled up with zeros.
    An empty table, or one without anchors, gives an empty result. A hot label or cell is dealt to many units.
    """
    spark: SparkSession = rows.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = written(spark, rows.select("vec_id", "label", "v"), "mining-rows")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    size = rows.agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("long"))))).alias("most")).first()
    if not size["n"]:
        return spark.createDataFrame([], result)
    width, bound = max(1, size["width"]), max(1, size["width"]) * (size["most"] or 0) ** 2
    if bound >= 1 << 62:
        raise ValueError("components are too large for scores of 64 bits")
    full = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(width) - F.size("v"))))
    n_pivots = pivots or min(MOST_PIVOTS, max(8, round(size["n"] ** 0.5 / 4)))
    chosen = [list(r["v"]) for r in full.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(n_pivots, MOST_PIVOTS)).select("v").collect()]
    space = Space(chosen, float(size["longest"]), bound < 1 << 52)
    cells = written(spark, _celled(full, space, anchors=False), "mining-cells")
    asked = _celled(full.where(anchors), space, anchors=True)
    # of each cell and label the distances of the rows nearest to its pivot: an anchor itself may be one of them
    near = cells.select("cell", "label", "away").withColumn("r", F.row_number().over(Window.partitionBy("cell", "label").orderBy("away"))).where(F.col("r") <= positives + 1)
    summary = near.where(F.col("r") == positives + 1).select("cell", "label", F.col("away").alias("enough"))
    asked = written(spark, asked, "mining-anchors")
    hot = hot_keys(asked.groupBy("cell", "label").agg(F.count("*").alias("n")), ["cell", "label"])
    anywhere = F.sqrt(length) + F.lit(space.longest**0.5)
    bounded = hot_join(asked, summary, ["cell", "label"], hot, F.col("vec_id"), how="left")
    none = F.array().cast("array<long>")
    reach = F.col("away") + F.coalesce(F.col("away") + F.col("enough"), anywhere)
    first = written(spark, bounded.select("vec_id", "label", "v", "cell", F.lit(0.0).alias("least"), reach.alias("most"), none.alias("ids"), none.alias("scores")), "mining-anchors")
    found = _search(cells, first, space, buckets=BUCKETS, k=positives, group=group, least_percent=None)
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "found_id"))).where(F.col("r") <= positives)
    lists = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("r", "found_id", "score"))).alias("p"))
    known = asked.join(lists, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", "cell", "away", F.col("p.found_id").alias("ids"), F.col("p.score").alias("scores"))
    apart = lambda score: F.sqrt(F.greatest(F.lit(0.0), length + F.lit(space.longest) - 2 * score))
    top, low = F.array_max("scores").cast("double"), F.array_min("scores").cast("double")
    second = known.withColumns({"least": apart(top) - F.col("away"), "most": apart(F.least(low * least_percent / 100, low)) + F.col("away")})
    second = written(spark, second.select("vec_id", "label", "v", "cell", "least", "most", "ids", "scores"), "mining-anchors")
    mined = _search(cells, second, space, buckets=1, k=negatives, group=group, least_percent=least_percent)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "found_id"))
    ranked = mined.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
