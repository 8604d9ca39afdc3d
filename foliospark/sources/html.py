"""Elements of HTML pages: the locally testable parser behind the document seam of ``parsing``."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.functions import text
from foliospark.functions.frames import ship

TYPES = {"h1": "Title", "h2": "h2", "h3": "h3", "p": "NarrativeText", "li": "ListItem", "figcaption": "FigureCaption", "caption": "TableCaption", "table": "Table"}
HIDDEN = ("script", "style", "template", "noscript")
VOID = ("br", "img", "hr", "input", "meta", "link", "source", "wbr", "col")


class _Elements(HTMLParser):
    """(type, text, html, image path) in document order. A block ends at its end tag or where the next one begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.kind, self.words, self.hidden, self.table, self.markup = [], None, [], 0, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if self.table:
            self.markup.append(self.get_starttag_text() or "")
        if tag == "table":
            if not self.table:
                self._flush()
                self.kind, self.markup = "Table", [self.get_starttag_text() or "<table>"]
            self.table += 1
        elif tag == "img" and not self.table:
            self.found.append(("Image", dict(attrs).get("alt") or "", "", dict(attrs).get("src") or ""))
        elif tag in TYPES and not self.table:
            self._flush()
            self.kind = TYPES[tag]
        elif tag in ("br", "td", "th", "tr"):
            self.words.append(" ")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if self.table:
            self.markup.append(f"</{tag}>")
            if tag == "table":
                self.table -= 1
                if not self.table:
                    self._flush("".join(self.markup))
        elif tag in TYPES:
            self._flush()

    def handle_data(self, data):
        if self.hidden:
            return
        if self.table:
            self.markup.append(data)
        if self.kind:
            self.words.append(data)

    def _flush(self, html=""):
        body = " ".join("".join(self.words).split())
        if self.kind and (body or html):
            self.found.append((self.kind, body, html, ""))
        self.kind, self.words = None, []


def elements_of(content: str) -> list[tuple[str, str, str, str]]:
    parser = _Elements()
    parser.feed(content or "")
    parser.close()
    parser._flush()
    return parser.found


def parse_html(files: DataFrame) -> DataFrame:
    """``schemas.ELEMENT`` rows of (path, content); all on page 1, without boxes. Null content has no elements."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(p, n, *e) for p, c in zip(frame["path"], frame["content"], strict=True) for n, e in enumerate(elements_of(c))]
            yield pd.DataFrame(rows, columns=["path", "ord", "type", "text", "html", "image_path"])

    ship(files.sparkSession)
    found = files.select("path", F.col("content").cast("string").alias("content")).mapInPandas(run, "path string, ord int, type string, text string, html string, image_path string")
    named = found.select(
        text.path_id(F.col("path")).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path").alias("source_path"), "ord", F.col("ord").alias("element_index"),
        F.lit(1).alias("page_number"), "type", text.normalize(F.col("text")).alias("text"), "html", "image_path",
    )
    given = {f.name for f in named.schema}
    return named.select(*[F.col(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.ELEMENT.fields])
