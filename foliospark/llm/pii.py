"""Personal data by regular expressions, checksum validators and context words. DataFrame functions only.

A pattern proposes spans, leftmost and without overlap for each kind. Spark has no function that gives positions, so they
follow from the lengths of the pieces between matches: ``split`` gives the pieces, ``regexp_extract_all`` the matches.
Validators confirm spans (digit counts, octets, Luhn, mod-97), and words near a span raise or lower its score. Base kinds
stay whatever their score; spans of the other kinds are kept from ``KEEP`` on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import text_or_empty

#: Code points before and after a span in which context words count, as far as the next match of the kind.
WINDOW = 48
KEEP = 0.5
RAISE, LOWER = 0.3, 0.3


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``cheap`` is a test that every text with a match passes, so others skip the pattern."""

    name: str
    pattern: str
    cheap: str
    valid: Callable[[Column], Column]
    score: float
    near: str
    against: str
    base: bool = True


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _card(match: Column) -> Column:
    d = digits(match)
    return F.length(d).between(16, 19) & F.call_function("luhn_check", d)


def _phone(match: Column) -> Column:
    return F.length(digits(match)).between(8, 15)


def _ip(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))


#: ISO 13616: letters count as 10 to 35, the first four characters go last, the number is 1 modulo 97.
def mod97(match: Column) -> Column:
    plain = F.upper(F.regexp_replace(match, " ", ""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def _iban(match: Column) -> Column:
    return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & mod97(match)


def _ssn(match: Column) -> Column:
    area = F.substring(match, 1, 3)
    return ~area.isin("000", "666") & (area < "900") & (F.substring(match, 5, 2) != "00") & (F.substring(match, 8, 4) != "0000")


#: Fixed forms of the first four kinds, written so that a scan stays linear: a run of local-part characters is tried once,
#: from its start or from the end of the match before; an address starts at a whole run of digits; a card number is a whole run of digits with single separators.
KINDS = (
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.9,
        r"mail|contact|kontakt|correo|courriel|write|reach", r"example\.|noreply|no-reply",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", _ip, 0.6, r"\bip\b|server|host|address|login|client", r"version|release|section|kapitel"),
    Kind(
        "card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])", "", _card, 0.8,
        r"card|visa|master|credit|karte|carte|tarjeta|pay", r"isbn|order|tracking|serial",
    ),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", _phone, 0.7, r"phone|tel|call|mobile|fax|anruf|appel|llam", r"isbn|version|offset"),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", _iban, 0.8,
        r"iban|bank|account|konto|compte|cuenta", r"serial|order", base=False,
    ),
    Kind(
        "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", _ssn, 0.4,
        r"ssn|social|security|taxpayer|insured", r"isbn|order|part|model|date", base=False,
    ),
)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often and however deep it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(numbers: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For every place of an array of integers: 0 and all numbers before it, joined in order.

    The array is cut into pieces of about the square root of its size, so that the arrays a fold copies stay short: a
    million places take a thousand folds of a thousand.
    """

    def fold(own: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(own, start, lambda a, x: F.struct(join(a["at"], x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))

    def pieces(own: Column) -> Column:
        size = F.size(own)
        return let(F.greatest(F.ceil(F.sqrt(size)), F.lit(1)).cast("int"), lambda c: F.transform(F.sequence(F.lit(0), F.ceil(size / c).cast("int") - 1), lambda j: fold(F.slice(own, j * c + 1, c))))

    def joined(inner: Column) -> Column:
        starts = fold(F.transform(inner, lambda x: x["at"]))["out"]
        return F.flatten(F.zip_with(inner, starts, lambda x, base: F.transform(x["out"], lambda o: join(base, o))))

    return let(numbers, lambda own: F.when(F.size(own) > 0, let(pieces(own), joined)).otherwise(F.array().cast("array<int>")))


def spans(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of the valid spans of a kind, in order; offsets in code points, end exclusive."""

    def score(around: Column) -> Column:
        raised = F.when(around.rlike(kind.near), RAISE).otherwise(0.0) - F.when(around.rlike(kind.against), LOWER).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(kind.score) + raised))

    def placed(found: Column) -> Column:
        """From struct<m: matches, p: pieces between them>."""
        beside = F.zip_with(found["m"], F.slice(found["p"], 1, F.size(found["m"])), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
        both = F.zip_with(beside, F.slice(found["p"], 2, F.size(found["m"])), lambda x, n: F.struct(x["m"].alias("m"), x["p"].alias("p"), n.alias("n")))
        begins = running(F.transform(beside, lambda x: F.length(x["p"]) + F.length(x["m"])), lambda a, b: a + b)
        with_begin = F.zip_with(both, begins, lambda x, b: F.struct(x["m"].alias("m"), x["p"].alias("p"), x["n"].alias("n"), b.alias("b")))
        valid = F.filter(with_begin, lambda x: kind.valid(x["m"]))

        def told(x: Column) -> Column:
            start = x["b"] + F.length(x["p"])
            around = F.lower(F.concat(F.substring(x["p"], -WINDOW, WINDOW), F.lit("\n"), F.substring(x["n"], 1, WINDOW)))
            return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(x["m"])).alias("end"), F.round(score(around), 2).alias("score"))

        return F.transform(valid, told)

    found = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("p"))
    scored = let(found, placed)
    if not kind.base:
        scored = F.filter(scored, lambda x: x["score"] >= KEEP)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    likely = text.contains(kind.cheap) if kind.cheap else F.lit(True)
    return F.when(likely & text.rlike(kind.pattern), scored).otherwise(none)


def find(docs: DataFrame, *, text_column: str = "text", to: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with the column ``to``: array<struct<kind, start, end, score>>, by kind as listed and then by start.

    Null and empty texts have none. Rows are kept one to one, repeated ones too, without a shuffle; an existing column of that
    name is replaced, others may have any name. Kinds are sought apart, so spans of two kinds may overlap or tie. A text of
    any length is taken whole; the work grows with its length, and with its matches to the power 1.5 at most. An empty table
    gives an empty result.
    """
    text = text_or_empty(text_column)
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != to], F.concat(*[spans(text, k) for k in kinds]).alias(to))


def redact(docs: DataFrame, *, text_column: str = "text", length_column: str | None = "n_chars", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one mark of the first.

    Null texts stay null, empty ones empty. The columns stay, whatever their names; ``length_column``, if there, gets the new
    length in code points. Of spans that begin together the shortest comes first, and its kind is shown. Rows stay one to
    one, repeats too. Long texts are cut piece by piece, so that no part of them is walked through for every span. An empty
    table gives an empty result.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), text_or_empty(text_column).alias("__text"))
    found = find(packed, text_column="__text", to="__pii", kinds=kinds)
    body = F.col("__text")

    def cut(rows: Column) -> Column:
        """From array<struct<at, start, kind>>: the text between ``at`` and ``start``, then the kind's mark, row after row."""
        c = F.greatest(F.ceil(F.sqrt(F.size(rows))), F.lit(1)).cast("int")

        def piece(own: Column) -> Column:
            first = F.get(own, F.lit(0))["at"]
            segment = F.substring(body, first + 1, F.element_at(own, -1)["start"] - first)
            marked = lambda s: F.transform(own, lambda x: F.concat(F.substring(s, x["at"] - first + 1, x["start"] - x["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
            return let(segment, lambda s: F.array_join(marked(s), ""))

        many = let(c, lambda n: F.transform(F.sequence(F.lit(0), F.ceil(F.size(rows) / n).cast("int") - 1), lambda j: let(F.slice(rows, j * n + 1, n), piece)))
        return F.array_join(many, "")

    def done(ordered: Column) -> Column:
        reach = running(F.transform(ordered, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        rows = F.zip_with(ordered, reach, lambda x, at: F.struct(at.alias("at"), x["start"].alias("start"), x["kind"].alias("kind")))
        rest = F.substring(body, F.array_max(F.transform(ordered, lambda x: x["end"])) + 1, F.length(body))
        return F.concat(let(F.filter(rows, lambda x: x["start"] >= x["at"]), cut), rest)

    ordered = F.array_sort(F.transform("__pii", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    any_found = F.size("__pii") > 0
    out = found.withColumn("__new", F.when(any_found, let(ordered, done)))
    kept = {c: F.col("__row").getField(c) for c in columns}
    kept[text_column] = F.coalesce("__new", kept[text_column])
    if length_column in columns:
        kept[length_column] = F.when(any_found, F.length("__new").cast(docs.schema[length_column].dataType)).otherwise(kept[length_column])
    return out.select(*[v.alias(c) for c, v in kept.items()])


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts, and the spans as ``kind:start:end`` by kind, then start.

    A row for each row of ``find``, repeated ones too. Without spans (null and empty texts) the counts are 0, the spans an
    empty string and base_sha256 its digest; no rows give none.
    """

    def told(array: Column) -> Column:
        return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = [k.name for k in KINDS if k.base]
    of_base = F.filter("pii", lambda x: x["kind"].isin(base))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(b) for b in base]
    return found.select(F.col(id_column).alias("doc_id"), *counts, F.sha2(told(of_base).cast("binary"), 256).alias("base_sha256"), told(F.col("pii")).alias("spans"))
