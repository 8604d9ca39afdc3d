"""Toxicity by weak supervision.

Voters of independent kinds look at a text: lexicons of the project's own (insults, contempt, profanity), insults written in
disguise, patterns around insults (addressed to someone, shouted or stretched, negated), and four lexicons mined from
labelled rows, each from its own kind of feature and from all but its own quarter of the rows. A generative label model over the voters'
joint firing counts (of all documents) gives each voter's firing rates a class, finds voters that stay correlated within the
classes and models those jointly. Its posterior labels train a linear classifier on hashed words and word beginnings, which
scores every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import in_arrow, text_or_empty, written

#: Most labelled rows that the voters are mined from and the classifier is trained on.
MOST_LABELLED = 10_000
#: Most features (those that speak most for toxicity) that leave the tasks, and most stems of a mined lexicon.
FEATURES, MOST_STEMS = 8192, 80
#: Kinds of features: 0 is a whole word, the others are its beginnings of so many letters. The two lowest bits hold the kind.
PREFIXES = (4, 5, 6)
KINDS = 1 + len(PREFIXES)

#: The project's own lists of English words.
INSULTS = frozenset("airhead bonehead clown coward creep cretin degenerate dimwit dolt dope dumb dunce fool freak halfwit idiot idiotic idiots imbecile jerk loser losers lunatic moron moronic morons nitwit simpleton stupid sucker twit weirdo".split())
CONTEMPT = frozenset("abomination abysmal despicable dirt disgrace disgusting filth filthy garbage gross hideous lowlife nasty parasite parasites pathetic repulsive rotten rubbish scum scumbag trash ugly useless vermin vile worthless".split())
PROFANITY = frozenset("arse arsehole ass asshole bastard bastards bitch bitches bollocks bullshit crap cunt damn dickhead dumbass fuck fucked fucker fucking motherfucker piss prick retard shit shitty slut wanker whore".split())
ALL = INSULTS | CONTEMPT | PROFANITY
SQUEEZED = frozenset(re.sub(r"(.)\1+", r"\1", w) for w in ALL if len(w) > 3)
MASKED = frozenset(f"{w[:k]}*{w[k + 1 :]}" for w in ALL if len(w) > 3 for k in range(1, len(w) - 1))

WORDS = re.compile(r"\w+").findall
SIGNED = re.compile(r"[a-z0-9@$*]*[a-z0-9][@$*]+[a-z][a-z0-9@$*]*|(?<![\w@$*])[@$][a-z0-9][a-z0-9@$*]*").findall
SPACED = re.compile(r"\b(?:[a-z][ .-]){3,}[a-z]\b").findall
PLAIN = str.maketrans("013457@$", "oieastas")
_ANY = "|".join(sorted(ALL))
AIMED = re.compile(rf"\b(?:you|your|he|she|they|these|those|such)(?:'re|'s| are| is)?(?: \w+)? (?:{_ANY})\b").search
SHOUTED = re.compile(rf"\b(?:{_ANY.upper()})\b|\b(?i:{_ANY})\b[^\w\n]{{0,2}}!{{3,}}").search
STRETCHED = re.compile(r"(\w)\1\1").search
NEGATED = re.compile(rf"\b(?:not|no|never|n't|isn't|nobody is|without being)(?: \w+){{0,2}} (?:{_ANY})\b|[\"“](?:{_ANY})[\"”]").search
#: Bits of a firing pattern, lowest first. The driver sees at most 2**12 counts.
VOTERS = ("mined words", "mined fours", "mined fives", "mined sixes", "insults", "contempt", "profanity", "disguised", "repeated", "aimed", "shouted", "negated")


def train_part(column: str = "doc_id"):
    """Rows that labels may be learnt from: CRC-32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def features_of(word: str) -> list[int]:
    """Hashes of a word and of its proper beginnings, with their kinds."""
    import xxhash

    hashed = lambda text, kind: xxhash.xxh32_intdigest(text) & 0xFFFFFFFC | kind
    return [hashed(word, 0)] + [hashed(f"{word[:n]}*", kind) for kind, n in enumerate(PREFIXES, 1) if len(word) > n]


@dataclass
class Model:
    lexicons: list[list[int]] = field(default_factory=list)
    voters: list[dict] = field(default_factory=list)
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -2.0


def disguised(low: str) -> bool:
    """Whether the lower-case text has a listed word with signs for letters, a letter masked, or letters apart."""
    if "@" in low or "$" in low or "*" in low:
        for found in SIGNED(low):
            if found in MASKED or ("*" not in found and found.translate(PLAIN) in ALL):
                return True
    return any(re.sub("[ .-]", "", found) in ALL for found in SPACED(low))


class Voters:
    """Firing pattern of a text, bits as in VOTERS."""

    REMEMBERED = 400_000

    def __init__(self, lexicons: list[list[int]]):
        self.of = {h: 1 << k for k, stems in enumerate(lexicons) for h in stems}
        self.known: dict[str, int] = {}

    def _look(self, word: str) -> int:
        if len(self.known) >= self.REMEMBERED:
            self.known.clear()
        bits = (word in INSULTS) << KINDS | (word in CONTEMPT) << KINDS + 1 | (word in PROFANITY) << KINDS + 2
        for h in features_of(word):
            bits |= self.of.get(h, 0)
        if word not in ALL:  # with digits for letters, or letters drawn out
            if not word.isalpha() and not word.isdigit() and word.translate(PLAIN) in ALL:
                bits |= 1 << KINDS + 3
            if STRETCHED(word) and re.sub(r"(.)\1+", r"\1", word) in SQUEEZED:
                bits |= 1 << KINDS + 6
        self.known[word] = bits
        return bits

    def __call__(self, text: str) -> int:
        low = text.lower()
        words, known, bits = WORDS(low), self.known, 0
        for w in set(words):
            b = known.get(w)
            bits |= self._look(w) if b is None else b
        n = KINDS + 3
        bits |= disguised(low) << n
        if bits >> KINDS & 7:
            bits |= (sum(w in ALL for w in words) >= 3) << n + 1 | bool(AIMED(low)) << n + 2 | bool(SHOUTED(text)) << n + 3 | bool(NEGATED(low)) << n + 4
        return bits


def indexed(sets: list, least: int):
    """(names, place, owner) of the features that at least ``least`` sets have: entry i says that set owner[i] has names[place[i]].

    Rare features, the bulk of them, are dropped by counts of hash buckets first, so that little is sorted.
    """
    import numpy as np

    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    bits = np.uint32((1 << 22) - 1)
    often = np.bincount(flat & bits, minlength=1 << 22) >= least
    keep = often[flat & bits]
    flat, owner = flat[keep], owner[keep]
    names, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = (np.cumsum(count >= least) - 1).astype(np.int32)
    keep = count[place] >= least
    return names[count >= least], number[place[keep]], owner[keep]


def mine(sets: list, labels) -> list[int]:
    """Stems for one mined lexicon, from feature sets of labelled texts.

    Greedy: the feature with the highest likelihood ratio that seldom occurs in clean texts is taken, the toxic texts it
    covers weigh half from then on, and so forth.
    """
    import numpy as np

    labels = np.asarray(labels, bool)
    if not len(labels) or not labels.any():
        return []
    least = 2 if labels.sum() < 150 else 3 if labels.sum() < 1000 else 5
    names, place, owner = indexed(sets, least)
    toxic, clean = np.bincount(place[labels[owner]], minlength=len(names)), np.bincount(place[~labels[owner]], minlength=len(names))
    odds = np.log((toxic + 0.1) / (labels.sum() + 0.2)) - np.log((clean + 0.1) / ((~labels).sum() + 0.2))
    able = np.nonzero((toxic >= least) & (toxic >= 9 * clean) & (odds > 1))[0]
    number = np.full(len(names), -1)
    number[able] = np.arange(len(able))
    pick = labels[owner] & (number[place] >= 0)
    owner, column = owner[pick], number[place[pick]]
    weight, taken = np.ones(len(labels)), []
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    starts = np.searchsorted(column, np.arange(len(able) + 1))
    while len(taken) < min(MOST_STEMS, len(able)):
        gain = np.bincount(column, weights=weight[owner], minlength=len(able)) * odds[able]
        gain[taken] = 0
        best = int(gain.argmax())
        covered = owner[starts[best] : starts[best + 1]]
        if weight[covered].sum() < 0.5:
            break
        taken.append(best)
        weight[covered] /= 2
    return [int(names[able[best]]) for best in taken]


def label_model(counts: dict[int, float], known: tuple[dict[int, float], dict[int, float]], voters: int, *, rounds: int = 60, bound: float = 0.15):
    """Posterior of the toxic class for every firing pattern.

    ``counts``: firing pattern -> documents; ``known``: the same for labelled clean and toxic rows, whose class is fixed.
    Correlations of voters within the classes come from the labelled rows where each class has 30, else from a first run of
    expectation-maximisation with independent voters. Voters whose correlation exceeds ``bound`` and four standard errors
    are joined to cliques, as many as hang together; each clique has a joint table (2**16 cells at most, as patterns have so
    many bits), and expectation-maximisation over all documents estimates these and the classes.
    Gives (pattern -> posterior, cliques, firing rates of each voter in both classes).
    """
    import numpy as np

    masks = np.array(sorted({*counts, *known[0], *known[1]}), np.int64)
    if not len(masks):
        return {}, [], np.zeros((2, voters))
    n = np.array([counts.get(int(m), 0) for m in masks], float)
    fixed = np.array([[k.get(int(m), 0) for m in masks] for k in known], float)
    n = np.maximum(n - fixed.sum(axis=0), 0)
    fires = (masks[:, None] >> np.arange(voters)) & 1

    def fit(cliques, start):
        codes = [sum(fires[:, v] << k for k, v in enumerate(c)) for c in cliques]
        post = start
        for _ in range(rounds):
            both = np.stack([fixed[0] + n * (1 - post), fixed[1] + n * post])
            size = both.sum(axis=1) + 1.0
            score = np.log(np.array([size[0], size[1]]))[:, None] + np.zeros_like(both)
            for clique, code in zip(cliques, codes, strict=True):
                cells = 1 << len(clique)
                for y in (0, 1):
                    table = (np.bincount(code, weights=both[y], minlength=cells) + 0.5 / cells) / (both[y].sum() + 0.5)
                    score[y] += np.log(table)[code]
            new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))
            if np.abs(new - post).max() < 1e-9:
                break
            post = new
        return post

    evidence = fixed[1] + 0.5 * fixed[1].sum() / max(1.0, fixed.sum())
    start = np.where(fixed.sum(axis=0) > 0, evidence / (fixed.sum(axis=0) + 0.5), np.where((fires[:, : max(1, voters - 3)]).any(axis=1), 0.9, 0.05))
    start = np.clip(start, 0.01, 0.99)
    labelled = fixed.sum(axis=1).min() >= 30
    if labelled:
        both = fixed
    else:
        start = fit([(v,) for v in range(voters)], start)
        both = np.stack([n * (1 - start), n * start]) + fixed
    strength = np.zeros((voters, voters))
    for y in (0, 1):
        size = both[y].sum()
        share = both[y] / max(1e-9, size)
        mean = share @ fires
        cov = (fires * share[:, None]).T @ fires - np.outer(mean, mean)
        spread = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
        found = np.abs(cov / np.outer(spread, spread))
        strength = np.maximum(strength, np.where(found * np.sqrt(size) > 4, found, 0))
    cliques = [[v] for v in range(voters)]
    for a, b in [(a, b) for a in range(voters) for b in range(a) if strength[a, b] > bound]:
        one, two = next(c for c in cliques if a in c), next(c for c in cliques if b in c)
        if one is not two:
            cliques.remove(two)
            one += two
    cliques = [tuple(sorted(c)) for c in cliques]
    post = fit(cliques, start)
    both = np.stack([fixed[0] + n * (1 - post), fixed[1] + n * post])
    rates = (both @ fires + 0.5) / (both.sum(axis=1, keepdims=True) + 1)
    return {int(m): float(p) for m, p in zip(masks, post, strict=True)}, cliques, rates


def train_linear(sets: list, soft, *, features: int = FEATURES, rounds: int = 1500, penalty: float = 5e-5):
    """Logistic regression on presence features by gradient descent with momentum, against soft labels.

    The ``features`` that speak for toxicity with the largest chi-square are kept: which clean words a text has says
    nothing about its insults. Gives (weights by hash, bias).
    """
    import numpy as np

    soft = np.asarray(soft, float)
    share = float(soft.mean()) if len(soft) else 0.1
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not len(soft) or not (0.001 < share < 0.999):
        return {}, bias
    names, place, owner = indexed(sets, 3)
    total = np.bincount(place, minlength=len(names)).astype(float)
    toxic = np.bincount(place, weights=soft[owner], minlength=len(names))
    chi = (toxic - total * share) ** 2 / (total * share * (1 - share))
    chi[toxic <= total * share] = 0
    best = np.sort(np.argsort(-chi, kind="stable")[:features])
    best = best[chi[best] > 6.6]
    number = np.full(len(names), -1)
    number[best] = np.arange(len(best))
    pick = number[place] >= 0
    owner, column = owner[pick], number[place[pick]]
    w, b, vw, vb = np.zeros(len(best)), bias, np.zeros(len(best)), 0.0
    rate = 4.0 / max(1.0, np.bincount(owner, minlength=1).max() ** 0.5)
    # rows are weighed so that both classes count alike
    weigh = soft / share + (1 - soft) / (1 - share)
    weigh /= weigh.sum()
    for _ in range(rounds):
        z = b + np.bincount(owner, weights=w[column], minlength=len(soft))
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - soft) * weigh
        vw = 0.9 * vw + np.bincount(column, weights=error[owner], minlength=len(best)) + penalty * w
        vb = 0.9 * vb + error.sum()
        w, b = w - rate * vw, b - rate * vb
    return {int(names[best[k]]): float(w[k]) for k in np.nonzero(np.abs(w) > 1e-4)[0]}, float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, label: str, most: int, id_column: str, text_column: str) -> DataFrame:
    """(k, y, t) of at most ``most`` labelled rows of the training part, in the shared folder; k is a hash of the text.

    Rows are taken by the order of a hash of their id, copies of a text once. An id with several labels has the largest;
    null labels and ids don't count.
    """
    one = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & train_part(id_column)).groupBy(id_column).agg(F.max(F.col(label).cast("int")).alias("__y"))
    few = one.orderBy(F.xxhash64(id_column), id_column).limit(most)
    rows = docs.select(F.col(id_column), text_or_empty(text_column).alias("__t")).join(F.broadcast(few), id_column)  # size: ``most`` rows
    rows = rows.groupBy(F.xxhash64("__t").alias("k")).agg(F.max("__y").alias("y"), F.first("__t").alias("t"))
    return written(docs.sparkSession, rows.select("k", (F.col("y") > 0).cast("int").alias("y"), "t"), "toxic-labelled")


def feature_sets(sample: DataFrame) -> tuple[list, list, list]:
    """(keys, labels, feature sets) of the labelled rows, by key; of their features the FEATURES that speak most for toxicity.

    Features are made and counted in tasks. What is gathered is bounded by rows and FEATURES, not by the texts' lengths.
    """
    import numpy as np

    def run(batches: Iterator):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = [sorted({h for w in set(WORDS(t.as_py().lower())) for h in features_of(w)}) for t in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["k", "y", "f"])

    spark = sample.sparkSession
    made = written(spark, sample.transform(in_arrow, run, "k long, y int, f array<long>"), "toxic-features")
    size = made.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    share = (size["toxic"] or 0) / max(1, size["n"])
    counted = made.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).where("toxic >= 2")
    more = F.col("toxic") - F.col("n") * share
    chi = counted.where(more > 0).select("f", (more * more / (F.col("n") * max(1e-9, share * (1 - share)))).alias("chi")).orderBy(F.desc("chi"), "f").limit(FEATURES)
    chosen = np.array(sorted(r["f"] for r in chi.collect()), np.int64)
    shared = spark.sparkContext.broadcast(chosen)  # size: FEATURES numbers

    def restrict(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            kept = [np.intersect1d(np.array(f.as_py(), np.int64), shared.value, assume_unique=True).astype(np.uint32).tobytes() for f in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary())], names=["k", "y", "f"])

    got = sorted(made.transform(in_arrow, restrict, "k long, y int, f binary").collect(), key=lambda r: r["k"])
    return [r["k"] for r in got], [r["y"] for r in got], [np.frombuffer(bytes(r["f"]), np.uint32) for r in got]


def _patterns(texts: DataFrame, lexicons: list[list[int]], keys: list[str]) -> DataFrame:
    """(keys, mask, n): the number of rows of (keys, t) with a firing pattern, added up in the tasks first."""
    fields = [f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys]

    def count(batches: Iterator):
        import pyarrow as pa

        voters, seen = Voters(lexicons), {}
        for batch in batches:
            given = [c.to_pylist() for c in batch.columns[:-1]]
            for i, t in enumerate(batch.column(batch.num_columns - 1)):
                place = (*(g[i] for g in given), voters(t.as_py()))
                seen[place] = seen.get(place, 0) + 1
        if seen:
            columns = [*zip(*seen, strict=True), list(seen.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "y" else pa.int64()) for c, k in zip(columns, [*keys, "mask", "n"], strict=True)], names=[*keys, "mask", "n"])

    return texts.select(*keys, "t").transform(in_arrow, count, ", ".join([*fields, "mask long, n long"])).groupBy(*keys, "mask").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", most: int = MOST_LABELLED, posterior: bool = True, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Voters, label model and classifier. The firing patterns are counted over all rows of ``docs``.

    ``posterior=False`` trains the classifier on the given labels instead, to tell what the label model adds.
    """
    import numpy as np

    sample = labelled_sample(docs, labels, label=label, most=most, id_column=id_column, text_column=text_column)
    keys, given, sets = feature_sets(sample)
    kind = lambda s, k: s[s & 3 == k]
    parts = [[i for i, key in enumerate(keys) if (key >> 7) % KINDS != k] for k in range(KINDS)]
    model = Model(lexicons=[mine([kind(sets[i], k) for i in rows], [given[i] for i in rows]) for k, rows in enumerate(parts)])
    total = {r["mask"]: r["n"] for r in _patterns(docs.select(text_or_empty(text_column).alias("t")), model.lexicons, []).collect()}
    mask_of = {r["k"]: (r["y"], r["mask"]) for r in _patterns(sample, model.lexicons, ["k", "y"]).collect()}  # a row for each labelled text
    known: tuple[dict, dict] = ({}, {})
    for y, mask in mask_of.values():
        known[y][mask] = known[y].get(mask, 0) + 1
    chance, cliques, rates = label_model(total, known, len(VOTERS))
    prior = sum(n * chance[m] for m, n in total.items()) / max(1, sum(total.values()))
    for v, name in enumerate(VOTERS):
        clean, toxic = (float(rates[y][v]) for y in (0, 1))
        together = next((c for c in cliques if v in c), (v,))
        model.voters.append({"voter": name, "fires_if_clean": clean, "fires_if_toxic": toxic, "accuracy": prior * toxic + (1 - prior) * (1 - clean), "together_with": [VOTERS[o] for o in together if o != v]})
    soft = [chance[mask_of[k][1]] for k in keys] if posterior else given
    model.weights, model.bias = train_linear(sets, np.array(soft, float))
    return model


class Scorer:
    REMEMBERED = 400_000

    def __init__(self, model: Model):
        self.weights, self.bias, self.known = model.weights, model.bias, {}

    def _look(self, word: str) -> tuple:
        if len(self.known) >= self.REMEMBERED:
            self.known.clear()
        self.known[word] = found = tuple(h for h in features_of(word) if h in self.weights)
        return found

    def __call__(self, text: str) -> float:
        import math

        known, hits = self.known, set()
        for w in set(WORDS(text.lower())):
            found = known.get(w)
            if found is None:
                found = self._look(w)
            if found:
                hits.update(found)
        z = self.bias + math.fsum(self.weights[h] for h in hits)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def score(docs: DataFrame, model: Model, *, text_column: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1). Null and empty texts get the score of the bias alone. Rows stay one to one."""
    from pyspark.sql import types as T

    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "score"], text_or_empty(text_column).alias("__t"))
    schema = T.StructType([f for f in kept.schema.fields if f.name != "__t"] + [T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size: at most FEATURES weights and KINDS x MOST_STEMS stems

    def run(batches: Iterator):
        import pyarrow as pa

        own = Scorer(shared.value)
        for batch in batches:
            scores = [own(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=schema.names)

    return kept.transform(in_arrow, run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Only rows of the training part teach labels; scores see nothing but the text, whole whatever its length. Null texts
    count as empty, a null id as the empty text in the check sum. Repeated rows get equal scores; a score of 0.5 (a tie) is
    predicted toxic. Without usable labels every score is that of the bias. Extra columns are not read. An empty table gives
    an empty result.
    """
    model = fit(docs, labels, id_column=id_column, text_column=text_column, **options)
    scored = score(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("__x")), model, text_column="__x")
    return scored.select("doc_id", (~train_part("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
