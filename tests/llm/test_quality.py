import collections
import random
import re

from pyspark.sql import functions as F

from foliospark.llm import quality


def brute(rows, least=5, share=0.02, depleted=0.7, left=None):
    """Expected rows; ``left`` gets the texts without common lines."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    norm = lambda line: " ".join(word.findall(line)).translate(low)
    texts = [(h or "", t or "") for _, h, t in rows]
    hosts, lines = collections.Counter(h for h, _ in texts), collections.Counter()
    for h, t in texts:
        lines.update({(h, norm(x)) for x in t.split("\n") if word.search(x)})
    out = []
    for d, h, t in rows:
        h, t = h or "", t or ""
        words = word.findall(t)
        grams = collections.defaultdict(list)
        for i in range(len(words) - 2):
            grams[tuple(words[i : i + 3])].append(i)
        covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
        seen, dup, removed, stay = set(), 0, 0, []
        for line in t.split("\n"):
            if word.search(line):
                dup += line in seen
                seen.add(line)
                if lines[h, norm(line)] > max(least, share * hosts[h]):
                    removed += len(word.findall(line))
                    continue
            stay.append(line)
        if left is not None:
            left.append((d, "\n".join(stay)))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append((d, len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), failed, not failed and removed <= depleted * len(words), removed))
    return out


def corpus():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)] + ["a\x0bb", "c d", "#x", "É", "é"]
    rows = []
    for i in range(150):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 8))]
        if rng.random() < 0.4:
            lines += ["All  Rights reserved."] * rng.choice((1, 2)) + ["click here for more of this " * rng.choice((1, 1, 40))]
        if rng.random() < 0.1:
            lines.append(lines[0])
        if rng.random() < 0.2:
            lines = [" ".join(f"c{k}" for k in range(80)), *lines[:1]]
        rows.append((i, rng.choice(["a", "a", "b", None]), "\n".join(lines)))
    rows += [(900, "a", None), (901, "a", ""), (902, None, " \t\n\n "), (None, "a", "x y z " * 30), (903, "a", rows[0][2]), (903, "a", rows[0][2]), (904, "b", "one two three\none two three")]
    return rows


def test_statistics_and_verdicts(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, source string, text string, kept string, lines int").repartition(4)
    found = quality.apply_rules(frame, least=5, carry=["doc_id"]).collect()
    key = lambda t: (t[0] is None, t[0] or 0, t[1:])
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.removed_words) for r in found), key=key)
    want = sorted(brute(rows, least=5), key=key)
    assert got == want and any(w[-1] for w in want) and any(not w[6] and not w[7] for w in want)


def test_kept_documents_lose_common_lines(spark):
    rows = corpus()
    texts = []
    want = [w for w in brute(rows, least=5, left=texts) if w[7]]
    frame = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, s, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.withColumn("removed", F.lit("own")).withColumn("text_key", F.lit("own"))
    found = quality.kept_documents(frame, least=5).collect()
    assert {(r.removed, r.text_key) for r in found} == {("own", "own")}
    ids = {w[0] for w in want}
    key = lambda t: (t[0] is None, t[0] or 0, t[1])
    assert sorted(((r.doc_id, r.text) for r in found), key=key) == sorted((t for t in texts if t[0] in ids), key=key)
    assert all(r.n_chars == len(r.text) and "Rights reserved" not in r.text for r in found) and any(w[8] for w in want)


def test_every_document_counts_unless_copies_count_once(spark):
    text = "\n".join(" ".join(f"v{i}{j}" for j in range(20)) for i in range(5))
    rows = [(i, "h", text) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert all(not r.kept and r.removed_words == 100 for r in quality.apply_rules(frame).collect())
    assert all(r.kept and not r.removed_words for r in quality.apply_rules(frame, copies_once=True).collect())


def test_small_hosts_lose_lines_above_the_floor_alone(spark):
    """A host of 5 documents keeps every line, one of 6 loses what all have, one of 1,500 what more than 30 have."""
    body = lambda h, i: " ".join(f"{h}x{i}y{j}" for j in range(60))
    rows = [(h, i, body(h, i) + ("\nthe same foot" if i < shared else "")) for h, n, shared in (("5", 5, 5), ("6", 6, 6), ("250", 250, 5), ("251", 251, 6), ("1500", 1500, 30), ("1501", 1501, 31)) for i in range(n)]
    frame = spark.createDataFrame([(k, h, t) for k, (h, _, t) in enumerate(rows)], "doc_id long, source string, text string")
    gone = {r.host: r.n for r in quality.apply_rules(frame).groupBy(F.col("__host").alias("host")).agg(F.count_if(F.col("removed_words") > 0).alias("n")).collect()}
    assert gone == {"5": 0, "6": 6, "250": 0, "251": 6, "1500": 0, "1501": 31}


def test_one_text_in_most_rows_is_dealt_to_many_tasks(spark, monkeypatch):
    from foliospark.functions import joins

    monkeypatch.setattr(joins, "LEAST_HOT", 50)
    hot = "\n".join(" ".join(f"h{i}w{j}" for j in range(30)) for i in range(4))
    rows = [(i, "a", hot) for i in range(3000)] + [(3000 + i, "a", " ".join(f"u{i}w{j}" for j in range(60)) + "\nAll rights reserved") for i in range(600)]
    rows += [(9000 + i, "b", hot) for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    found = quality.apply_rules(frame, share=0.9, carry=["doc_id"]).collect()
    want = brute(rows, share=0.9)
    assert sorted((r.doc_id, r.kept, r.removed_words) for r in found) == sorted((w[0], w[7], w[8]) for w in want)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        dealt = quality.apply_rules(frame, share=0.9, carry=["doc_id"]).select("doc_id", F.spark_partition_id().alias("part"))
        sizes = collections.Counter(r.part for r in dealt.where("doc_id < 3000").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes.values()) == 3000 and max(sizes.values()) < 1000
    texts = {d: t for d, _, t in rows}
    kept = {r.doc_id: r.text for r in quality.kept_documents(frame, share=0.9).collect()}
    assert kept == {w[0]: texts[w[0]] for w in want if w[7]}


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert quality.apply_rules(empty).collect() == [] and quality.kept_documents(empty).collect() == []
    rng = random.Random(1)
    rows = [(1, "a", " ".join(str(rng.randrange(60_000)) for _ in range(200_000)))]
    r = quality.apply_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).first()
    assert (r.n_words, r.n_repeat_words, r.kept) == (200_000, brute(rows)[0][5], brute(rows)[0][7])
