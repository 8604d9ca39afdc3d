"""Tokenizers, truncation on token ids, and encoders that pool token states under a mask.

A tokenizer is a seam: anything with ``name``, ``encode(texts) -> lists of ids`` and ``decode(lists of ids) -> texts``. It
works on many texts at a time in vectorised Python functions; what it has to load is loaded once a worker.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.frames import in_arrow, parts, ship_active, slices

#: Of ``head_tail``, this part of the limit is head.
HEAD_SHARE = 0.7
#: Padded tokens in a batch of an encoder.
CELLS = 1 << 14


class Tokenizer(Protocol):
    name: str

    def encode(self, texts: list[str]) -> list[list[int]]: ...

    def decode(self, ids: list[list[int]]) -> list[str]: ...


@dataclass(frozen=True)
class CodePoints:
    """Every character is a token, its code point the id: nothing to load, and SQL can say the same."""

    name: str = "code-points"

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(map(ord, t)) for t in texts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return ["".join(map(chr, x)) for x in ids]


@functools.lru_cache(4)
def _loaded(path: str, pattern: str):
    """One instance a worker, however many tasks it runs."""
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})


@dataclass(frozen=True)
class RankFile:
    """Byte-level BPE by a file of ranks that every worker finds at ``path``; ids cut within a character decode to U+FFFD."""

    path: str
    pattern: str
    name: str = "byte-bpe"

    def encode(self, texts: list[str]) -> list[list[int]]:
        return _loaded(self.path, self.pattern).encode_ordinary_batch(texts, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [_loaded(self.path, self.pattern).decode(x) for x in ids]


def cut(ids: list[int], most: int, strategy: str = "head") -> list[int]:
    """``head``, ``tail`` or ``head_tail`` of a list of ids, which has at most ``most`` then."""
    if strategy not in ("head", "tail", "head_tail"):
        raise ValueError(f"unknown truncation strategy: {strategy}")
    if len(ids) <= most:
        return ids
    head = {"head": most, "tail": 0, "head_tail": int(most * HEAD_SHARE)}[strategy]
    return ids[:head] + ids[len(ids) - (most - head) :]


def truncated(text: Column, tokenizer: Tokenizer, most: int, strategy: str = "head") -> Column:
    """Texts of more than ``most`` tokens cut on their ids and decoded; others stay as they are, character by character."""
    if most < 0:
        raise ValueError("the number of tokens must not be negative")
    cut([], most, strategy)
    ship_active()

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for texts in parts(batch):
                yield pd.Series(_cut_texts(texts, tokenizer, tokenizer.encode(texts), most, strategy), dtype=object)

    return run(text)


def _cut_texts(texts: list[str], tokenizer: Tokenizer, ids: list[list[int]], most: int, strategy: str) -> list[str]:
    out = list(texts)
    long = [i for i, x in enumerate(ids) if len(x) > most]
    for i, t in zip(long, tokenizer.decode([cut(ids[i], most, strategy) for i in long]), strict=True):
        out[i] = t
    return out


def with_cuts(rows: DataFrame, body: str, tokenizer: Tokenizer, most: int, strategies: tuple[str, ...] = ("head", "tail", "head_tail")) -> DataFrame:
    """``rows`` without ``body`` (null: empty), with ``n_tokens`` and the text cut by each strategy, in a column of its name.

    The same as ``counted`` and ``truncated``, but each text is encoded once and one Python worker a task does it all, a few
    texts at a time.
    """
    if most < 0:
        raise ValueError("the number of tokens must not be negative")
    for s in strategies:
        cut([], most, s)
    own = [f for f in rows.schema.fields if f.name != body]
    result = T.StructType([*own, T.StructField("n_tokens", T.LongType()), *[T.StructField(s, T.StringType()) for s in strategies]])

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(result)
        for whole in batches:
            for batch in slices(whole, size=1 << 18):
                texts = [t or "" for t in batch.column(len(own)).to_pylist()]
                ids = tokenizer.encode(texts)
                told = [[len(x) for x in ids], *[_cut_texts(texts, tokenizer, ids, most, s) for s in strategies]]
                columns = [*batch.columns[: len(own)], *[pa.array(c, arrow.field(len(own) + n).type) for n, c in enumerate(told)]]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.select(*[f.name for f in own], body).transform(in_arrow, run, result)


def counted(text: Column, tokenizer: Tokenizer) -> Column:
    """The number of tokens; null texts have none."""
    ship_active()

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for texts in parts(batch):
                yield pd.Series([len(x) for x in tokenizer.encode(texts)], dtype="int64")

    return run(text)


class TokenModel(Protocol):
    """States of tokens: ``states(ids, mask)`` takes padded (texts, tokens) arrays and gives (texts, tokens, dimension)."""

    name: str
    dimension: int
    #: Tokens that it takes at most; longer texts lose their tails.
    longest: int
    #: The id that padding has.
    padding: int

    def states(self, ids, mask): ...


@dataclass(frozen=True)
class TokenTable:
    """A model without weights: whole numbers that follow from the id alone, so that pooled vectors can be told in SQL.

    Component j of token t is (t * (2 j + 1) + j) mod ``modulus`` less half of it.
    """

    dimension: int = 16
    longest: int = 512
    padding: int = 0
    modulus: int = 257
    name: str = "token-table"

    def states(self, ids, mask):
        import numpy as np

        j = np.arange(self.dimension)
        return ((ids[:, :, None] * (2 * j + 1) + j) % self.modulus - self.modulus // 2).astype(np.float64)


def pooled(states, mask):
    """Mean of the states of real tokens; a text without any gives zeros. Padding counts nothing, whatever its states are."""
    import numpy as np

    kept = np.where(mask[:, :, None], states, 0.0)
    return kept.sum(1) / np.maximum(mask.sum(1), 1e-6)[:, None]


@dataclass(frozen=True)
class PooledEncoder:
    """An encoder of a tokenizer and a model: texts of like length share a batch, so that little is padding.

    A batch has at most ``cells`` padded tokens, or one text of more; order and batches change no vector.
    """

    tokenizer: Tokenizer
    model: TokenModel
    cells: int = CELLS

    @property
    def name(self) -> str:
        return f"{self.model.name}/{self.tokenizer.name}"

    @property
    def dimension(self) -> int:
        return self.model.dimension

    def encode(self, texts: list[str]):
        import numpy as np

        ids = [x[: self.model.longest] for x in self.tokenizer.encode(texts)]
        order = sorted(range(len(ids)), key=lambda i: len(ids[i]))
        out = np.zeros((len(ids), self.dimension))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(ids[order[end]]) <= self.cells:
                end += 1
            batch = order[at:end]
            width = len(ids[batch[-1]])
            padded, mask = np.full((len(batch), width), self.model.padding, np.int64), np.zeros((len(batch), width), bool)
            for row, i in enumerate(batch):
                padded[row, : len(ids[i])], mask[row, : len(ids[i])] = ids[i], True
            if width:
                out[batch] = pooled(np.asarray(self.model.states(padded, mask)), mask)
            at = end
        return out
