"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank vocabulary.

Every vocabulary entry becomes one piece, its bytes written with the printable byte alphabet of byte-level BPE, scored
by its negative rank. The normaliser is the identity and nothing is escaped or prefixed, so the model merges exactly
the pair of lowest rank first, leftmost on ties, and piece ids equal ranks.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import in_arrow, text_or_empty

#: Distinct pre-tokens remembered by a worker; beyond it the memory starts afresh (results never depend on it).
REMEMBERED = 300_000


def byte_alphabet() -> list[str]:
    """The printable character of each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


ALPHABET = byte_alphabet()
TO_PIECE = {b: c for b, c in enumerate(ALPHABET)}
FROM_PIECE = {ord(c): b for b, c in enumerate(ALPHABET)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _integer(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece i is the token of rank i; the unknown piece that the format wants comes last.

    Ranks must be 0..n-1 without gaps; otherwise ValueError, since ids would not equal ranks.
    """
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for rank, token in enumerate(ordered):
        piece = "".join(ALPHABET[b] for b in token).encode()
        body = _message(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _integer(3, normal)
        out += _message(1, body)
    out += _message(1, _message(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _integer(3, unknown))
    trainer = _integer(3, bpe) + _integer(4, len(ordered) + 1) + _integer(40, len(ordered))
    identity = _message(1, b"identity") + _integer(3, 0) + _integer(4, 0) + _integer(5, 0)
    return bytes(out) + _message(2, trainer) + _message(3, identity)


class Codec:
    """Encoder and decoder over a serialised model."""

    def __init__(self, proto: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.split = regex.compile(pattern).findall
        self.pieces = [
            self.model.id_to_piece(i).translate(FROM_PIECE).encode("latin-1") for i in range(self.model.get_piece_size() - 1)
        ]
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Every match of the pattern is encoded on its own."""
        words, known = self.split(text), self.known
        if new := list({w for w in words if w not in known}):
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(words))
            mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(TO_PIECE) for w in new]
            for w, ids in zip(new, self.model.encode(mapped, num_threads=1), strict=True):
                known[w] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join([known[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in memoryview(ids).cast("I")])


_CODECS: dict[tuple[bytes, str], Codec] = {}


def codec(proto: bytes, pattern: str) -> Codec:
    """One codec a worker process."""
    key = (hashlib.sha1(proto).digest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(proto, pattern)
    return _CODECS[key]


def tokenize(docs: DataFrame, ranks: str, pattern: str, *, text_column: str = "text", round_trip: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens`` (long), ``ids`` (binary, little-endian u32) and, if asked for, ``decoded`` (binary).

    A null text counts as empty and has no tokens. Repeated rows and ties are encoded alike; rows are kept one to one
    and in place (no shuffle); an empty table gives an empty result. Columns of ``docs`` named like the three new ones
    are replaced. ``ranks`` is a path on the driver; the model reaches the executors in the task's closure.
    """
    from pyspark.sql import types as T

    proto = docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(ranks)))  # size: that of the vocabulary
    new = ["n_tokens", "ids", "decoded"][: 3 if round_trip else 2]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "ids", "decoded")], text_or_empty(text_column).alias("__text"))
    schema = T.StructType(
        [f for f in kept.schema.fields if f.name != "__text"] + [T.StructField(c, T.LongType() if c == "n_tokens" else T.BinaryType()) for c in new]
    )

    def run(batches: Iterator):
        import pyarrow as pa

        own = codec(proto.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = [own.encode(t.as_py()) for t in batch.column(batch.num_columns - 1)]
                columns = [*batch.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if round_trip:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return kept.transform(in_arrow, run, schema)
