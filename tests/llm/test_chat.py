import random

import pytest

from foliospark.llm import chat


def conversation(rng, conv, marked=True):
    rows, turn = [], 0
    if rng.random() < 0.3:
        rows.append((conv, turn, "system", "You are a helpful guide."))
        turn += 1
    for k in range(rng.randrange(2, 9)):
        role = ("user", "assistant")[k % 2]
        body = "what is it?" if role == "user" else "\n".join("it is a long answer of many words " * 4 for _ in range(4))
        mark = {"user": "User: ", "assistant": "### Assistant:\n"}[role] if marked and rng.random() < 0.5 else ""
        rows.append((conv, turn, role, mark + body))
        turn += 1
    return rows


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    return [row for c in range(n) for row in conversation(rng, c)]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_markers(spark):
    texts = ["User: hi", "  human: hi", "### Assistant:\nhi", "<|im_start|>system\nhi", "<|user|> hi", "[bot] hi", "**AI:** hi", "A: hi", "none", "username is set", "", "usable: x"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    from pyspark.sql import functions as F

    rows = {r.i: (r.m, r.t) for r in frame.select("i", chat.marker_of(F.col("text")).alias("m"), chat.without_marker(F.col("text")).alias("t")).collect()}
    assert [rows[i][0] for i in range(12)] == [2, 2, 3, 1, 2, 3, 3, 3, 0, 0, 0, 0]
    assert all(rows[i][1] == "hi" for i in range(8)) and rows[9][1] == "username is set"


def test_plain_transcripts(spark):
    talk = "System: You are a guide.\nUser: hi there\nwhat is it?\nAssistant: a long answer\nof lines\n\n  \nwithout a marker\nUser : bye"
    frame = spark.createDataFrame([(1, talk), (2, None), (3, " \n\n"), (4, "just this")], "conv_id long, text string")
    found = sorted((r.conv_id, r.turn, r.text) for r in chat.entries(frame).collect())  # no roles are known
    assert found == [
        (1, 0, "System: You are a guide."), (1, 1, "User: hi there\nwhat is it?"), (1, 2, "Assistant: a long answer\nof lines"), (1, 3, "without a marker"), (1, 4, "User : bye"), (4, 0, "just this"),
    ]
    roles = {(r.conv_id, r.turn): r.role for r in chat.format_chat(chat.entries(frame), role=None).collect()}
    assert [roles[1, k] for k in (0, 1, 2, 4)] == ["system", "user", "assistant", "user"]


def brute(model, seen):
    """Best path by trying all."""
    import itertools

    best = None
    for path in itertools.product(range(3), repeat=len(seen)):
        score = model.start[path[0]] + model.show[path[0]][seen[0]]
        for a, b, o in zip(path, path[1:], seen[1:]):
            score += model.step[a][b] + model.show[b][o]
        if best is None or score > best[0] + 1e-12:
            best = (score, list(path))
    return best


def random_model(rng):
    import math

    row = lambda n: [math.log(x) for x in (lambda w: [v / sum(w) for v in w])([rng.random() + 0.01 for _ in range(n)])]
    return chat.Model(row(3), [row(3) for _ in range(3)], [row(10) for _ in range(3)])


@pytest.mark.parametrize("ties", [False, True])
def test_viterbi_whole_and_in_pieces(ties):
    """Also where many paths are equally good: pieces give the very path of the whole."""
    rng = random.Random(2)
    for _ in range(150):
        model, seen = random_model(rng), [rng.randrange(10) for _ in range(rng.randrange(1, 8))]
        if ties:
            few = lambda n: [rng.randrange(-2, 1) for _ in range(n)]
            model = chat.Model(few(3), [few(3) for _ in range(3)], [few(10) for _ in range(3)])
            want = chat.viterbi(model, seen)
            score = lambda path: model.start[path[0]] + sum(model.show[p][o] for p, o in zip(path, seen)) + sum(model.step[a][b] for a, b in zip(path, path[1:]))  # noqa: E731,B023
            assert score(want) == score(brute(model, seen)[1])
        else:
            want = brute(model, seen)[1]
        assert chat.viterbi(model, seen) == want
        cuts = sorted({0, len(seen), *(rng.randrange(len(seen) + 1) for _ in range(3))})
        parts = [seen[a:b] for a, b in zip(cuts, cuts[1:])]
        settled = chat.settle([(n, "c", *chat.piece_matrix(model, part), chat.begun_scores(model, part)) for n, part in enumerate(parts)])
        got = []
        for n, part in enumerate(parts):
            enter, leave = settled.get((n, "c"), (None, None))
            got += chat.viterbi(model, part, enter, leave)
        assert got == want


def test_roles_are_recovered_whatever_the_partitions(spark):
    rows = corpus()
    rng = random.Random(9)
    for k in range(300):  # one conversation longer than any partition
        rows.append((999, k, ("user", "assistant")[k % 2], "what?" if k % 2 == 0 else "answer " * rng.randrange(60, 90)))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("2", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            found = chat.format_chat(frame).collect()
            assert len(found) == len(rows)
            results.append(sorted((r.conv_id, r.turn, r.role) for r in found))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    right = {(c, t): r for c, t, r, _ in rows}
    assert sum(right[c, t] == r for c, t, r in results[0]) > 0.97 * len(rows)
    assert results[0] == results[1]


def test_rendering(spark):
    found = chat.format_chat(spark.createDataFrame([(1, 0, "human", "User: hi there?"), (1, 1, "gpt", "### Assistant: well<|im_end|>")] * 3 + corpus(20), SCHEMA))
    texts = {r.rendered for r in found.where("conv_id = 1").collect()}
    assert "<|user|>\nhi there?\n<|end|>\n" in texts and "<|assistant|>\nwell\n<|end|>\n" in texts


def test_nulls_ties_repeats_empty(spark):
    rows = [(None, None, None, None), (None, 1, "user", ""), (1, 0, "user", "same"), (1, 0, "user", "same"), (1, 0, "tool", "other"), (1, None, "assistant", "x" * 50_000)]
    frame = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA + ", rendered string")
    found = chat.format_chat(frame).collect()
    assert len(found) == 6 and all(r.role in chat.ROLES for r in found) and {r.given_role for r in found} == {None, "user", "assistant"}
    assert chat.format_chat(spark.createDataFrame([], SCHEMA)).collect() == []


def test_transcripts_are_parsed_back(spark):
    rows = corpus(40) + [(500, k, ("user", "assistant")[k % 2], f"turn {k}\n\n \nof many") for k in range(200)] + [(501, 0, "user", None), (501, 1, None, ""), (None, 0, "user", "hi"), (502, 0, "tool", "unknown role")]
    told = chat.transcripts(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert max(len(r.roles) for r in told.collect()) <= chat.PIECE and told.where("conv_id = 500").count() >= 4
    found = chat.entries(told, segment="segment", roles="roles").orderBy("conv_id", "turn").collect()
    by = {}
    for r in found:
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv in {c for c, *_ in rows} - {501}:
        own = [(chat.ROLES.index(role) if role in chat.ROLES else None) for c, _, role, _ in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert [role for role, _ in by[conv]] == own
    assert all(t.rstrip().endswith(f"turn {k}\nof many") for k, (_, t) in enumerate(by[500])) and len(by.get(501, [])) <= 1


def test_query_equals_brute_force(spark):
    """Transcripts from the operator; parsing, learning, decoding and rendering again in plain Python."""
    import itertools
    import math
    import re
    import zlib

    from foliospark.llm import queries

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    mark = chat.MARK.replace("(%s)", "(?:%s)") % "|".join(n for role in chat.ROLES for n in chat.NAMES[role])
    talks = {}
    for r in chat.transcripts(turns).orderBy("conv_id", "segment").collect():
        pieces = [p for p in re.split(rf"\n(?:[ \t]*\n)+|\n(?={mark})", r.text, flags=re.I) if p.strip()]
        assert len(pieces) == len(r.roles)
        talks.setdefault(r.conv_id, []).extend(zip(pieces, r.roles))

    def seen(t):
        which = 0
        for k, role in enumerate(chat.ROLES):
            if not which and re.match(chat.MARK % "|".join(chat.NAMES[role]), t, re.I):
                which = k + 1
        opening = bool(re.match(r"\s*(?:you are|act as|please|write|explain|translate|answer|always|never)\b", t, re.I))
        return which, int("?" in t), int(opening), sum(len(t) > b for b in chat.LENGTHS), min(3, t.count("\n")), int(bool(re.search(r"(?m)^\s*(?:[-*] |\d+[.)] |```|def |import )", t)))

    start, step, tables = [0.5] * 3, [[0.5] * 3 for _ in range(3)], [[[0.5] * n for n in chat.SIZES] for _ in range(3)]
    held = lambda c: zlib.crc32(str(c).encode()) % 5 == 0
    for conv, talk in talks.items():
        if held(conv):
            continue
        for n, (t, role) in enumerate(talk):
            if n == 0:
                start[role] += 1
            else:
                step[talk[n - 1][1]][role] += 1
            for f, v in enumerate(seen(t)):
                tables[role][f][v] += 1
    for role in range(3):
        tables[role][0][role + 1] += 4
    logs = lambda row: [round(chat.UNIT * math.log(x / sum(row))) for x in row]
    start, step, tables = logs(start), [logs(r) for r in step], [[logs(t) for t in role] for role in tables]
    want = []
    for conv, talk in talks.items():
        shown = [[sum(tables[role][f][v] for f, v in enumerate(seen(t))) for role in range(3)] for t, _ in talk]
        score = lambda path: start[path[0]] + sum(s[p] for s, p in zip(shown, path)) + sum(step[a][b] for a, b in zip(path, path[1:]))  # noqa: E731,B023
        best = max(itertools.product(range(3), repeat=len(talk)), key=score)
        for (t, role), p in zip(talk, best):
            bare = re.sub(r"(?i)(?:<\|im_end\|>|<\|end\|>)\s*$", "", re.sub("^" + mark, "", t, flags=re.I)).strip()
            want.append((conv, held(conv), chat.ROLES[p], chat.ROLES[role], f"<|{chat.ROLES[p]}|>\n{bare}\n<|end|>\n"))
    found = [(r.conv_id, r.held_out, r.role, r.given_role, r.rendered) for r in queries.op1_chat_format(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(found) == sorted(want)


def test_query_recovers_roles_the_model_never_saw(spark):
    from foliospark.llm import queries

    found = queries.op1_chat_format(spark, "/root/testdata/sf0.1").where("held_out").collect()
    assert len(found) > 500 and sum(r.role == r.given_role for r in found) >= 0.97 * len(found)


def test_held_out_accuracy_on_the_benchmark_conversations(spark):
    turns = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    model = chat.learn(chat.arrange(turns.where("conv_id % 5 <> 0"), conversation="conv_id", turn="turn", text="text", role="role"))
    found = chat.format_chat(turns.where("conv_id % 5 = 0"), model=model).collect()
    assert sum(r.role == r.given_role for r in found) >= 0.97 * len(found)


def test_features_fit_their_table(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(c,) for c in ("", "User: please?", "x" * 5000, "a\n" * 50, "- item\n- b", "System: write")], "text string")
    codes = [r.o for r in rows.select(chat.observed(F.col("text")).alias("o")).collect()]
    for code in codes:
        values = chat.unpack(code)
        assert all(0 <= v < s for v, s in zip(values, chat.SIZES, strict=True))
    assert chat.unpack(codes[1])[:2] == [2, 1]
    with pytest.raises(ValueError):
        list(zip(chat.unpack(codes[0]), chat.SIZES[:-1], strict=True))


@pytest.mark.parametrize("parts", ["1", "9", "60"])
def test_counts_are_over_all_rows_whatever_the_partitions(spark, parts):
    import math

    rows = corpus() + [(999, k, ("user", "assistant", None)[k % 3], "what?") for k in range(100)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        arranged = chat.arrange(spark.createDataFrame(rows, SCHEMA).repartition(7), conversation="conv_id", turn="turn", text="text", role="role")
        assert parts == "1" or arranged.frame.select("part").distinct().count() > 4
        model = chat.learn(arranged)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    start, step, last = [0.5] * 3, [[0.5] * 3 for _ in range(3)], (None, None)
    for conv, _, role, _ in sorted(rows, key=lambda r: r[:2]):
        k = chat.ROLES.index(role) if role else None
        if k is not None and conv != last[0]:
            start[k] += 1
        elif k is not None and last[1] is not None:
            step[last[1]][k] += 1
        last = (conv, k)
    logs = lambda row: [round(chat.UNIT * math.log(x / sum(row))) for x in row]
    assert model.start == logs(start) and model.step == [logs(r) for r in step]
