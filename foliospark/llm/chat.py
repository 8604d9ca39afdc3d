"""Chat formatting: plain transcripts are parsed, roles recovered by a hidden Markov model, and turns rendered canonically.

An entry shows a speaker marker (``User:``, ``### Assistant``, ``<|system|>`` ...) or none, and features of its lines. The
model's states are roles. Entries are sorted by conversation and turn over range partitions, so that a conversation of any
length is spread over tasks of like size; Viterbi runs inside a partition, and conversations that cross partitions are
joined exactly by max-plus products of one matrix for each piece. Scores are whole numbers and ties have an order, so the
result does not depend on the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.storage import write
from foliospark.llm.common import in_arrow, open_fs, scratch, text_or_empty

ROLES = ("system", "user", "assistant")
#: Names of the roles in markers and role columns, as they occur in public chat formats.
NAMES = {
    "system": ("system", "context", "instructions"),
    "user": ("user", "human", "question", "customer", "prompter", "q"),
    "assistant": ("assistant", "ai", "bot", "model", "gpt", "agent", "answer", "a"),
}
MARK = r"\s*(?:<\|(?:im_start\|>)?|\[|#{1,4}\s*|\*\*)?\s*(%s)\s*(?:\|>|\]|:\s*\*\*|\*\*\s*:?|:|\n)"
MARKER = "(?i)^" + MARK
#: Values of each feature, in the order of ``observed``.
SIZES = (4, 2, 2, 6, 4, 2)
LENGTHS = (60, 150, 300, 600, 1200)
#: Turns in a piece of a rendered transcript, so that a conversation of any length is a column of pieces of bounded size.
PIECE = 64
#: How a rendered transcript marks a speaker; beside these styles so many others leave the marker out, and the entry begins
#: after a blank line.
STYLES = ("%s: ", "### %s\n", "<|%s|> ", "[%s] ", "**%s:** ")
UNMARKED = 4
#: Logarithms are kept as whole numbers of this unit.
UNIT = 1 << 20


def marker_of(text: Column) -> Column:
    """0: none, else 1 + the role's place in ROLES. A marker opens the text."""
    found = F.lit(0)
    for k, role in reversed(list(enumerate(ROLES))):
        found = F.when(text.rlike(MARKER % "|".join(NAMES[role])), k + 1).otherwise(found)
    return found


def without_marker(text: Column) -> Column:
    every = "|".join(n for role in ROLES for n in NAMES[role])
    bare = F.regexp_replace(F.regexp_replace(text, MARKER % every, ""), r"(?i)(?:<\|im_end\|>|<\|end\|>)\s*$", "")
    return F.regexp_replace(bare, r"(?U)^\s+|\s+$", "")


def transcripts(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role", seed: int = 3) -> DataFrame:
    """(conv_id, segment, text, roles): conversations as plain transcripts, in pieces of at most PIECE turns.

    Each turn loses its own marker, if it has one, and is marked in one of STYLES or not at all, by a hash of the seed, its
    conversation, turn and text; turns of unknown roles are never marked. Blank lines inside a turn are closed up, as they would end it. Turns without a mark and
    without text leave no trace. ``roles`` has the places in ROLES (or null) of the turns shown, and serves to score what is
    recovered. ``segment`` rises along a conversation. Order, ties and nulls as in ``arrange``.
    """
    raw = arrange(turns, conversation=conversation, turn=turn, text=text, role=role, observe=False).frame
    body = without_marker(F.regexp_replace("text", r"\n\s*\n", "\n"))
    drawn = F.xxhash64(F.lit(seed), "conv_id", "turn", "text")
    named = F.lit(None).cast("string")
    for k, r in enumerate(ROLES):
        names = F.array(*[F.lit(n.capitalize()) for n in NAMES[r] if len(n) > 1])
        named = F.when(F.col("given") == k, F.get(names, F.pmod(F.shiftright(drawn, 8), F.size(names)).cast("int"))).otherwise(named)
    pick, shown = F.pmod(drawn, F.lit(len(STYLES) + UNMARKED)), F.concat(F.lit("\n"), body)
    for k, style in enumerate(STYLES):
        shown = F.when((pick == k) & named.isNotNull(), F.concat(F.format_string(style, named), body)).otherwise(shown)
    told = raw.select("part", "seq", "conv_id", "given", shown.alias("text")).where("trim(both '\n\t ' from text) <> ''")
    beside = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy("seq")) - 1
    piece = told.withColumn("piece", F.floor(beside / PIECE)).groupBy("conv_id", "part", "piece").agg(F.min("seq").alias("segment"), F.array_sort(F.collect_list(F.struct("seq", "text", "given"))).alias("own"))
    return piece.select("conv_id", "segment", F.array_join(F.transform("own", lambda x: x["text"]), "\n").alias("text"), F.transform("own", lambda x: x["given"]).alias("roles"))


def entries(transcripts: DataFrame, *, conversation: str = "conv_id", text: str = "text", segment: str | None = None, roles: str | None = None) -> DataFrame:
    """(conv_id, turn, text, role) of plain transcripts, one a row: an entry begins at a line with a marker and after a blank line.

    Lines of a block without a marker stay together. Null and blank transcripts have no entries. Where a transcript comes
    in pieces, ``segment`` orders them. ``roles`` may name an array of known roles; it is used where it has one for every
    entry (otherwise role is null).
    """
    every = MARK % "|".join(n for role in ROLES for n in NAMES[role])
    pieces = F.split(text_or_empty(text), rf"(?i)\n(?:[ \t]*\n)+|\n(?={every})", -1)
    kept = F.filter(pieces, lambda p: F.regexp_replace(p, r"(?U)\s+", "") != "")
    known = F.col(roles) if roles else F.lit(None).cast("array<int>")
    first = F.col(segment) * 1024 if segment else F.lit(0)  # segments are numbered by their first turn
    found = transcripts.select(F.col(conversation).alias("conv_id"), first.alias("first"), kept.alias("kept"), known.alias("known"))
    named = F.when(F.size("kept") == F.size("known"), F.get("known", F.col("pos")))
    return found.select("conv_id", "first", "known", "kept", F.posexplode("kept").alias("pos", "text")).select("conv_id", (F.col("first") + F.col("pos")).alias("turn"), "text", named.alias("role"))


def observed(text: Column) -> Column:
    """One number for the entry's features: marker, question, imperative opening, length, lines, list or code."""
    length, lines = F.length(text), F.size(F.split(text, "\n", -1)) - 1
    bucket = sum((F.when(length > b, 1).otherwise(0) for b in LENGTHS), F.lit(0))
    values = (
        marker_of(text),
        text.contains("?").cast("int"),
        text.rlike(r"(?i)^\s*(?:you are|act as|please|write|explain|translate|answer|always|never)\b").cast("int"),
        bucket,
        F.least(lines, F.lit(3)),
        text.rlike(r"(?m)^\s*(?:[-*] |\d+[.)] |```|def |import )").cast("int"),
    )
    code = F.lit(0)
    for value, size in zip(values, SIZES, strict=True):
        code = code * size + value
    return code.cast("int")


def role_of(column: Column) -> Column:
    """Place in ROLES of a given role, null for others. Numbers are places already."""
    name = F.lower(F.trim(column))
    found = F.lit(None).cast("int")
    for k, role in enumerate(ROLES):
        found = F.when(name.isin(*NAMES[role], str(k)), k).otherwise(found)
    return found


@dataclass
class Model:
    """Logarithms in units: start[role], step[role][role], show[role][observation]; a table of len(ROLES) x product of SIZES."""

    start: list[int]
    step: list[list[int]]
    show: list[list[int]]


@dataclass
class Arranged:
    """Entries in order: the frame, and the folder where each part is a file (or several in the order of their names)."""

    frame: DataFrame
    path: str

    def parts(self) -> list[list[str]]:
        from pyarrow import fs

        files, root = open_fs(self.path)
        found: dict[str, list[str]] = {}
        for f in files.get_file_info(fs.FileSelector(root)):
            if f.base_name.startswith("part-"):
                found.setdefault(f.base_name[:10], []).append(f.base_name)
        return [sorted(found[k]) for k in sorted(found)]


def arrange(turns: DataFrame, *, conversation: str, turn: str, text: str, role: str | None, taught: Column | None = None, observe: bool = True) -> Arranged:
    """Entries in order of conversation and turn: (part, seq, conv_id, turn, text, observed, given, taught).

    ``part`` is the range partition, ``seq`` rises with the order. Ties of conversation and turn are ordered by the text's
    hash, then the given role; rows equal in all of these by a number drawn when they are read, so even these can be dealt
    to many parts. Nulls come first. ``taught``: the given role where a model may learn from it (everywhere by default).
    Features are looked at after the shuffle, as its ranges are found by reading the rows once before; ``observe=False``
    leaves them out.
    """
    spark, body = turns.sparkSession, text_or_empty(text)
    given = role_of(F.col(role)) if role else F.lit(None).cast("int")
    lesson = given if taught is None else F.when(taught, given)
    rows = turns.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), body.alias("text"), given.alias("given"), lesson.alias("taught"))
    tie, drawn = F.xxhash64("text").alias("tie"), F.xxhash64(F.monotonically_increasing_id()).alias("drawn")
    order = ["conv_id", "turn", "tie", "given", "drawn"]
    dealt = rows.withColumn("tie", tie).withColumn("drawn", drawn).repartitionByRange(*order).sortWithinPartitions(*order)
    seen = [observed(F.col("text")).alias("observed")] if observe else []
    numbered = dealt.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"), "conv_id", "turn", "text", *seen, "given", "taught")
    path = scratch(spark, "chat")
    write(spark, numbered, path)
    return Arranged(spark.read.schema(numbered.schema).parquet(path), path)


def learn(arranged: Arranged, smoothing: float = 0.5) -> Model:
    """Start, transition and emission tables from the entries whose role is taught; counts are over all of them.

    Neighbours are looked up within a part; the pair at each part's edge is counted from the parts' first and last rows.
    Features are taken as independent given the role; each has its table. Without roles the tables are flat but for the
    markers.
    """
    import math

    rows = arranged.frame
    beside = Window.partitionBy("part").orderBy("seq")
    before = F.when(F.lag("conv_id").over(beside).eqNullSafe(F.col("conv_id")), F.lag("taught").over(beside))
    opening = F.row_number().over(beside) > 1
    first = opening & ~F.coalesce(F.lag("conv_id").over(beside).eqNullSafe(F.col("conv_id")), F.lit(False))
    pairs = rows.select("taught", "observed", before.alias("before"), first.alias("first")).where("taught is not null")
    counts = pairs.groupBy("taught", "before", "first", "observed").agg(F.count("*").alias("n")).collect()  # at most roles^2 * 2 * product of SIZES rows
    ends = [by(c, "seq").alias(f"{end}_{c}") for end, by in (("first", F.min_by), ("last", F.max_by)) for c in ("conv_id", "taught")]
    edges = sorted(rows.groupBy("part").agg(*ends).collect(), key=lambda r: r["part"])  # a row a part
    k = len(ROLES)
    start, step = [smoothing] * k, [[smoothing] * k for _ in ROLES]
    tables = [[[smoothing] * size for size in SIZES] for _ in ROLES]
    for row in counts:
        if row["first"]:
            start[row["taught"]] += row["n"]
        if row["before"] is not None:
            step[row["before"]][row["taught"]] += row["n"]
        for f, value in enumerate(unpack(row["observed"])):
            tables[row["taught"]][f][value] += row["n"]
    for last, own in zip([None, *edges], edges):
        if own["first_taught"] is None:
            continue
        if last is None or last["last_conv_id"] != own["first_conv_id"]:
            start[own["first_taught"]] += 1
        elif last["last_taught"] is not None:
            step[last["last_taught"]][own["first_taught"]] += 1
    for role in range(k):  # a marker of another role is rare, whether or not the counts have seen any
        for other in range(k):
            tables[role][0][other + 1] += 4.0 if other == role else 0.0
    logs = lambda row: [round(UNIT * math.log(x / sum(row))) for x in row]
    named = [[logs(t) for t in role] for role in tables]
    size = math.prod(SIZES)
    show = [[sum(t[v] for t, v in zip(role, unpack(o), strict=True)) for o in range(size)] for role in named]
    return Model(logs(start), [logs(r) for r in step], show)


def unpack(code: int) -> list[int]:
    out = []
    for size in reversed(SIZES):
        code, value = divmod(code, size)
        out.append(value)
    return out[::-1]


def piece_matrix(model: Model, seen: list[int]) -> tuple[list[list], list[list[int]]]:
    """(best, order): best[a][b] is the best score from role a before the piece to role b at its end; order[b] lists the a's.

    Where several a's do equally well, ``viterbi`` over the whole would take the path whose last differing role comes first
    in ROLES; order[b] lists the a's by that.
    """
    k = range(len(ROLES))
    best = [[model.step[a][b] + model.show[b][seen[0]] for b in k] for a in k]
    order = [list(k) for _ in k]
    for o in seen[1:]:
        came = [[max(k, key=lambda x: row[x] + model.step[x][b]) for b in k] for row in best]
        order = [sorted(k, key=lambda a: (came[a][b], order[came[a][b]].index(a))) for b in k]
        best = [[row[came[a][b]] + model.step[came[a][b]][b] + model.show[b][o] for b in k] for a, row in enumerate(best)]
    return best, order


def begun_scores(model: Model, seen: list[int]) -> list:
    """Scores of the roles at the end of a piece with which its conversation begins."""
    k = range(len(ROLES))
    score = [model.start[b] + model.show[b][seen[0]] for b in k]
    for o in seen[1:]:
        score = [max(score[a] + model.step[a][b] for a in k) + model.show[b][o] for b in k]
    return score


def viterbi(model: Model, seen: list[int], enter: list[float] | None = None, leave: int | None = None) -> list[int]:
    """Best roles. ``enter``: scores of the roles before the first entry (None: the conversation begins here);
    ``leave``: the role of the last entry, if it is settled. Ties go to the role that ROLES lists first."""
    k = range(len(ROLES))
    if enter is None:
        score, back = [model.start[b] + model.show[b][seen[0]] for b in k], []
    else:
        score, back = [max(enter[a] + model.step[a][b] for a in k) + model.show[b][seen[0]] for b in k], []
    for o in seen[1:]:
        came = [max(k, key=lambda a: score[a] + model.step[a][b]) for b in k]
        back.append(came)
        score = [score[came[b]] + model.step[came[b]][b] + model.show[b][o] for b in k]
    state = leave if leave is not None else max(k, key=score.__getitem__)
    path = [state]
    for came in reversed(back):
        state = came[state]
        path.append(state)
    return path[::-1]


def settle(pieces: list[tuple]) -> dict[tuple[int, object], tuple[list | None, int]]:
    """(part, conversation) -> (scores on entry or None, role on leaving) for conversations that cross parts.

    ``pieces``: (part, conversation, matrix, order, scores at the end if the conversation began with this piece).
    """
    k = range(len(ROLES))
    by: dict = {}
    for part, conv, matrix, order, begun in sorted(pieces, key=lambda p: p[0]):
        by.setdefault(conv, []).append((part, matrix, order, begun))
    settled = {}
    for conv, own in by.items():
        if len(own) < 2:
            continue
        enters, score = [None], own[0][3]
        for _, matrix, _, _ in own[1:]:
            enters.append(score)
            score = [max(score[a] + matrix[a][b] for a in k) for b in k]
        state = max(k, key=score.__getitem__)
        for (part, matrix, order, _), enter in zip(reversed(own), reversed(enters), strict=True):
            settled[part, conv] = (enter, state)
            if enter is not None:
                state = max(order[state], key=lambda a: enter[a] + matrix[a][state])
    return settled


def _runs(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conversation, rows) of consecutive rows that begin with the same conversation."""
    import itertools

    for conv, own in itertools.groupby(rows, key=lambda r: r[0]):
        yield conv, [r[1:] for r in own]


def _rows(path: str, names: list[str], columns: list[str]) -> Iterator[tuple]:
    """Rows of the named Parquet files in order, a few thousand at a time in memory."""
    import pyarrow.parquet as pq

    files, root = open_fs(path)
    for name in names:
        with files.open_input_file(f"{root}/{name}") as handle:
            for batch in pq.ParquetFile(handle).iter_batches(batch_size=2000, columns=columns):
                yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def decode(arranged: Arranged, model: Model) -> DataFrame:
    """(conv_id, turn, text, given, role): the recovered role of every entry; text, given as they came.

    A task reads one part's file as it was written, so nothing is shuffled again. First each part tells what its first and
    last conversation can do (two small matrices a part reach the driver), then the parts are decoded. Null and empty
    texts are entries like others; repeated rows are entries of their own; of roles that score alike the first in the
    model's order is taken; no entries give none.
    """
    spark, path, parts = arranged.frame.sparkSession, arranged.path, arranged.parts()
    kinds = {f.name: f.dataType for f in arranged.frame.schema.fields}
    conv_kind, turn_kind = kinds["conv_id"].simpleString(), kinds["turn"].simpleString()
    shared = spark.sparkContext.broadcast((model, parts))  # size: fixed by the features, and a name a part
    tasks = spark.range(0, len(parts), 1, max(1, len(parts)))  # one part a task

    def matrices(batches: Iterator):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        from foliospark.llm import chat

        own, names = shared.value
        for batch in batches:
            for part in batch.column(0).to_pylist():
                ends = []  # only a part's first and last conversation can go on elsewhere
                for conv, run in chat._runs(chat._rows(path, names[part], ["conv_id", "observed"])):
                    ends[1:] = [(conv, [r[0] for r in run])] if ends else []
                    if not ends:
                        ends = [(conv, [r[0] for r in run])]
                rows = []
                for conv, seen in ends:
                    best, order = chat.piece_matrix(own, seen)
                    rows.append((part, conv, [x for r in best for x in r], [x for r in order for x in r], chat.begun_scores(own, seen)))
                if rows:
                    longs = pa.list_(pa.int64())
                    types = [pa.int64(), to_arrow_type(kinds["conv_id"]), longs, longs, longs]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "conv_id", "best", "order", "begun"])

    k = len(ROLES)
    square = lambda flat: [list(flat[i * k : i * k + k]) for i in range(k)]
    got = tasks.transform(in_arrow, matrices, f"part long, conv_id {conv_kind}, best array<long>, order array<long>, begun array<long>").collect()
    crossing = spark.sparkContext.broadcast(settle([(r["part"], r["conv_id"], square(r["best"]), square(r["order"]), list(r["begun"])) for r in got]))

    def roles(batches: Iterator):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        from foliospark.llm import chat

        (own, names), known, held = shared.value, crossing.value, []
        types = [to_arrow_type(kinds["conv_id"]), to_arrow_type(kinds["turn"]), pa.string(), pa.int32(), pa.string()]

        def told():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=["conv_id", "turn", "text", "given", "role"])

        for batch in batches:
            for part in batch.column(0).to_pylist():
                # a second reader of the same file brings the texts, so that of a run only what was observed is held
                texts = chat._rows(path, names[part], ["turn", "text", "given"])
                for conv, run in chat._runs(chat._rows(path, names[part], ["conv_id", "observed"])):
                    enter, leave = known.get((part, conv), (None, None))
                    for s in chat.viterbi(own, [r[0] for r in run], enter, leave):
                        held.append((conv, *next(texts), ROLES[s]))
                        if len(held) >= 2000:
                            yield told()
                            held = []
        if held:
            yield told()

    return tasks.transform(in_arrow, roles, f"conv_id {conv_kind}, turn {turn_kind}, text string, given int, role string")


def format_chat(
    turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", text: str = "text", role: str | None = "role", learn_from: Column | None = None, model: Model | None = None
) -> DataFrame:
    """(conv_id, turn, role, given_role, rendered) of every entry.

    ``role`` names a column of known roles that the model learns from, of the rows where ``learn_from`` holds (of all by
    default); entries are decoded without it. rendered is the entry in canonical form, ``<|role|>``, the text without its
    own marker, ``<|end|>``. Null texts count as empty; null conversations form one, null turns come first; rows that repeat
    a turn are entries of their own, ordered by their texts. Texts and conversations of any length are taken whole. Columns
    beside these are not read. An empty table gives an empty result.
    """
    arranged = arrange(turns, conversation=conversation, turn=turn, text=text, role=role, taught=learn_from)
    decoded = decode(arranged, model or learn(arranged))
    names = F.array(*[F.lit(r) for r in ROLES])
    rendered = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), without_marker(F.col("text")), F.lit("\n<|end|>\n"))
    return decoded.select("conv_id", "turn", "role", F.when(F.col("given").isNotNull(), F.get(names, F.col("given"))).alias("given_role"), rendered.alias("rendered"))
