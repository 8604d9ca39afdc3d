"""Text functions as Column builders.

Patterns carry ``(?U)`` wherever letters, digits or white space of all scripts count: without it Java's classes are ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.frames import parts, ship_active

SPACES = r"(?U)\s+"
#: The characters that ``(?U)\s`` matches; those of ASCII.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_BLANKS = " \t\n\x0b\x0c\r"
#: A token is taken as 0.75 words.
WORDS_PER_TOKEN = 0.75

#: Types, in lower case, that decide about the role.
ROLE_OF_TYPE = (
    {k: k for k in ("title", "h1", "h2", "h3", "table")} | dict.fromkeys(("image", "figure"), "figure") | dict.fromkeys(("figurecaption", "tablecaption", "caption"), "caption")
    | dict.fromkeys(("narrativetext", "list", "listitem", "text", "header", "footer"), "paragraph")
)
#: Codes in a section path and what is stripped from its parts; numbering of headings; begin of a caption.
SECTION_CODE = r"\(([A-Z]{2,}[A-Z0-9\-]*\d+[A-Z0-9\-]*)\)"
SECTION_EDGES = r"^[ \-–—:;\t]+|[ \-–—:;\t]+$"
NUMBERED_HEADING = r"(?U)^(\d+(\.\d+){0,3})\s+\S+"
LEADING_NUMBER = r"(?U)^(\d+(?:\.\d+)*)\b"
CAPTION = r"(?iU)^\s*(?:Figure|Table)\s+[\dA-Za-z\-\.]+"


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.when(_edged(text, ASCII_BLANKS), F.btrim(text, F.lit(BLANKS))).otherwise(text)


def _edged(text: Column, blanks: str) -> Column:
    """Whether a text might have white space at its ends: it is not ASCII, or one of ``blanks`` is there."""
    found = F.octet_length(text) != F.char_length(text)
    for blank in blanks:
        found = found | text.startswith(blank) | text.endswith(blank)
    return found


def collapse(text: Column) -> Column:
    """Stripped, with every run of white space as one space. ASCII texts that have single spaces only go through no pattern."""
    s = empty_if_null(text)
    uneven = _edged(s, " ")
    for blanks in ("  ", *ASCII_BLANKS.strip(" ")):
        uneven = uneven | s.contains(blanks)
    return F.when(uneven, F.regexp_replace(F.btrim(s, F.lit(BLANKS)), SPACES, " ")).otherwise(s)


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(empty_if_null(text), SPACES), lambda w: w != "")


def count_words(text: Column) -> Column:
    """The number of ``words``, without their array."""
    return F.regexp_count(empty_if_null(text), F.lit(r"(?U)\S+"))


def estimated_tokens(text: Column) -> Column:
    """At least 1; runs of word characters and single other characters, divided by the words of a token, half to even."""
    found = F.regexp_count(empty_if_null(text), F.lit(r"(?U)\w+|\S"))
    return F.greatest(F.lit(1), F.rint(found / F.lit(WORDS_PER_TOKEN)).cast("int"))


def path_id(path: Column) -> Column:
    """Document id of a file: the first 16 hexadecimal digits of its absolute path's SHA-256."""
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 16)


@F.pandas_udf(T.StringType())
def _compatible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for texts in batches:
        for part in parts(texts):
            yield pd.Series([unicodedata.normalize("NFKC", t) for t in part], dtype=object)


def normalize(text: Column, unicode_form: bool = True) -> Column:
    """Compatibility form, soft hyphens dropped, words split at line ends joined, paragraphs kept, other white space collapsed.

    Spark has no NFKC function, so that step alone is a vectorised Python function, to which texts other than ASCII are sent
    alone, as ASCII texts have that form already; ``unicode_form=False`` leaves it out.
    """
    t = empty_if_null(text)
    if unicode_form:
        ship_active()
        ascii_only = F.octet_length(t) == F.char_length(t)
        t = F.when(ascii_only, t).otherwise(_compatible(F.when(~ascii_only, t)))
    t = F.translate(t, "\u00a0\u00ad", " ")
    t = F.regexp_replace(t, r"(?U)(?<=\w)-\s*\n\s*(?=[a-z])", "")
    t = F.regexp_replace(t, r"[ \t]*\n[ \t]*", "\n")
    parts = F.transform(F.split(t, r"\n{2,}"), lambda p: strip(F.regexp_replace(p, r"[ \t]+", " ")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def content_hash(text: Column, html: Column) -> Column:
    """SHA-256 of the text, followed by NUL and the HTML where there is any."""
    body, markup = empty_if_null(text).cast("binary"), empty_if_null(html).cast("binary")
    return F.sha2(F.when(F.length(markup) > 0, F.concat(body, F.unhex(F.lit("00")), markup)).otherwise(body), 256)


def document_prefix(text: Column, prefix: str = "passage: ") -> Column:
    """The prefix in front, unless the text has it in any case."""
    return F.when(F.lower(text).startswith(prefix.strip().lower()), text).otherwise(F.concat(F.lit(prefix), text))


def query_prefix(text: Column, prefix: str = "query: ") -> Column:
    return strip(F.concat(F.lit(prefix), text))


def truncate(tokens: Column, most: int, strategy: str = "head") -> Column:
    """``head``, ``tail`` or ``head_tail`` (70 % and 30 %) of a token array; arrays within the limit stay."""
    size = F.size(tokens)
    if strategy == "head":
        cut = F.slice(tokens, 1, most)
    elif strategy == "tail":
        cut = F.slice(tokens, F.greatest(size - most + 1, F.lit(1)), most)
    elif strategy == "head_tail":
        head = int(most * 0.7)
        cut = F.concat(F.slice(tokens, 1, head), F.slice(tokens, F.greatest(size - (most - head) + 1, F.lit(1)), most - head))
    else:
        raise ValueError(f"unknown truncation strategy: {strategy}")
    return F.when(size > most, cut).otherwise(tokens)


def truncation_name(most: int, strategy: str) -> str:
    return f"{strategy}({most})"


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(empty_if_null(text)), F.lit("[A-Za-z0-9]+"), F.lit(0))


def jaccard(left: Column, right: Column) -> Column:
    """Of two token arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(both / F.size(F.array_union(left, right)))


def similarities(left: Column, right: Column, both: Column) -> tuple[Column, Column, Column, Column]:
    """Jaccard similarity, recall, precision and F1 of two sets by their sizes and that of what they have in common.

    The three are best columns of their own: array functions in a condition are worked out at each place where they stand.
    """
    jaccard = F.when((left == 0) | (right == 0), 0.0).otherwise(both / (left + right - both))
    return jaccard, *_recall_precision_f1(left, right, both)


def recall_precision_f1(source: Column, parsed: Column) -> tuple[Column, Column, Column]:
    """Of token sets. Both empty: 1, 1, 1. Source empty: 1, 0, 0. Parsed empty: 0, 1, 0."""
    a, b = F.array_distinct(source), F.array_distinct(parsed)
    return _recall_precision_f1(F.size(a), F.size(b), F.size(F.array_intersect(a, b)))


def _recall_precision_f1(left: Column, right: Column, both: Column) -> tuple[Column, Column, Column]:
    no_a, no_b = left == 0, right == 0
    recall = F.when(no_a, 1.0).when(no_b, 0.0).otherwise(both / F.greatest(left, F.lit(1)))
    precision = F.when(no_a & no_b, 1.0).when(no_a, 0.0).when(no_b, 1.0).otherwise(both / F.greatest(right, F.lit(1)))
    total = recall + precision
    f1 = F.when(no_a & no_b, 1.0).when(total > 0, 2 * recall * precision / F.when(total > 0, total).otherwise(1.0)).otherwise(0.0)
    return recall, precision, f1


def section_path(path: Column) -> Column:
    """Section path with codes in parentheses, doubled spaces and stray punctuation removed; null if nothing is left."""
    parts = F.transform(
        F.split(path, r"(?U)\s*>\s*"),
        lambda p: F.regexp_replace(
            F.regexp_replace(F.regexp_replace(strip(p), SECTION_CODE, ""), SPACES, " "), SECTION_EDGES, ""
        ),
    )
    kept = F.array_join(F.filter(parts, lambda p: p != ""), " > ")
    # null if nothing is left, without a second look at the parts
    return F.when(path == "", path).otherwise(F.get(F.filter(F.array(kept), lambda p: p != ""), F.lit(0)))


def section_level(level: Column, most: int = 6) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(most), level))


def prompt(question: Column, blocks: Column) -> Column:
    """An answering prompt: the context blocks, numbered, and the question."""
    told = F.transform(blocks, lambda b, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), b))
    return F.concat(
        F.lit("Answer the question from the context alone. If the context does not hold the answer, say so.\n\nContext:\n"),
        F.array_join(told, "\n\n"), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"),
    )


def role(kind: Column, text: Column) -> Column:
    """Role of a layout element: by its type where that decides, else by caption, numbering and capitals."""
    body = empty_if_null(text)
    capitals, letters = F.regexp_count(body, F.lit(r"\p{Lu}")), F.regexp_count(body, F.lit(r"(?U)\w"))
    loud = F.length(body).between(3, 80) & (letters > 0) & (capitals > 0.7 * letters)
    numbered = body.rlike(NUMBERED_HEADING) & (F.length(body) < 200)
    known = F.create_map(*[F.lit(s) for pair in ROLE_OF_TYPE.items() for s in pair])
    return F.coalesce(
        known[F.lower(empty_if_null(kind))],
        F.when(body.rlike(CAPTION), "caption").when(numbered | loud, "h2").otherwise("paragraph"),
    )


def heading_level(role: Column, text: Column) -> Column:
    """Level of a heading, null for other text. A leading number counts up to 25 words, with the dots of the whole text."""
    s, t = strip(empty_if_null(text)), F.lower(empty_if_null(role))
    n_words = F.regexp_count(s, F.lit(r"(?U)\w+"))
    letters, capitals = F.regexp_count(s, F.lit("[A-Za-z]")), F.regexp_count(s, F.lit("[A-Z]"))
    return (
        F.when(t == "listitem", F.lit(None).cast("int"))
        .when(s.rlike(LEADING_NUMBER), F.when(n_words <= 25, F.regexp_count(s, F.lit(r"\.")) + 1))
        .when(t.isin("title", "h1"), 1)
        .when(n_words.between(1, 15) & (letters > 0) & (capitals >= 0.70 * letters), 2)
    )
