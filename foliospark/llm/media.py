"""Media columns: content-addressed payloads in tar shards, with metadata filled from header-only range reads.

A payload (bytes of 8-bit samples) is stored losslessly as a greyscale PNG of fixed width. A tar shard holds each
distinct payload of its rows once, under the name ``<sha-256 of the payload>.png``; rows carry digest, shard, offset and
length, so a reader needs no scan of the shard: the first 33 bytes at the offset give the picture's header.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import in_arrow, open_fs, scratch, text_or_empty

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, and the IHDR chunk with its length, name and check sum.
HEADER_BYTES = 33
LOCATION = "digest string, shard string, offset long, length long"
#: Stored bytes that a reading task is dealt, and most reading tasks.
READ_BYTES, MOST_TASKS = 16 << 20, 100_000


def pad(data: bytes, width: int = WIDTH, fill: bytes = b" ") -> bytes:
    """``data`` filled up to a positive multiple of ``width``."""
    return data + fill * (max(1, -(-len(data) // width)) * width - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """8-bit greyscale, one row for each ``width`` bytes, no row filter."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    rows = b"".join(b"\x00" + payload[i : i + width] for i in range(0, len(payload), width))
    head = struct.pack(">IIBBBBB", width, len(payload) // width, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, level)) + _chunk(b"IEND", b"")


def read_header(data: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from the first 33 bytes; ValueError if these are not a PNG's."""
    if len(data) < HEADER_BYTES or data[:8] != SIGNATURE or data[8:16] != b"\x00\x00\x00\rIHDR":
        raise ValueError("not a PNG header")
    if zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("the header's check sum is wrong")
    return struct.unpack(">IIBB", data[16:26])


def decode_png(data: bytes) -> bytes:
    """Samples of an 8-bit greyscale PNG without interlacing; chunk check sums are verified, all row filters known."""
    width, height, depth, colour = read_header(data)
    if (depth, colour, data[28]) != (8, 0, 0):
        raise ValueError("only 8-bit greyscale without interlacing is read")
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk is cut short or its check sum is wrong")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    rows = zlib.decompress(b"".join(packed))
    if len(rows) != height * (width + 1):
        raise ValueError("the picture has not as many samples as its header says")
    out, above = [], bytes(width)
    for i in range(0, len(rows), width + 1):
        kind, line = rows[i], rows[i + 1 : i + 1 + width]
        above = line if kind == 0 else _unfilter(kind, line, above)
        out.append(above)
    return b"".join(out)


def _unfilter(kind: int, line: bytes, above: bytes) -> bytes:
    done = bytearray(line)
    for x in range(len(done)):
        left, up, corner = (done[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
        if kind == 4:
            guess = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
        else:
            guess = {1: left, 2: up, 3: (left + up) // 2}[kind]
        done[x] = done[x] + guess & 255
    return bytes(done)


def features(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit average hash over as many equal stretches."""
    import numpy as np

    x = np.frombuffer(samples, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    entropy = -float((share[share > 0] * np.log2(share[share > 0])).sum())
    sums = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    ends = np.arange(65) * len(x) // 64
    means = np.diff(sums[ends]) / np.maximum(1, np.diff(ends))
    bits = int("".join("1" if m > x.mean() else "0" for m in means), 2)
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={entropy:.4f};ahash={bits:016x}"


def store(rows: DataFrame, payload: str = "payload", *, directory: str | None = None) -> DataFrame:
    """Writes one tar shard a task; gives ``rows`` without the payload but with digest, shard, offset and length.

    The result is a table in the shared folder, so rows and shards always belong together. A shard's name has the
    attempt's number, and a lost or repeated attempt leaves at most a shard that no row names. Equal payloads of a task are
    stored once, so a shard is addressed by content; several shards may hold the same one, which spares a shuffle of all
    payloads. A null payload has no place, an empty one is an error, one of any length is stored whole. Columns of ``rows``
    named as the new ones are left out. Empty tables and partitions write no shard.
    """
    import uuid

    from pyspark.sql import types as T

    spark = rows.sparkSession
    directory = directory or scratch(spark, "media")
    extra = T.StructType.fromDDL(LOCATION)
    others = [c for c in rows.columns if c != payload and c not in extra.names]
    schema = T.StructType([rows.schema[c] for c in others] + extra.fields)

    def run(batches: Iterator):
        import pyarrow as pa

        files, root = open_fs(directory)
        shard, sink, at, where = f"{uuid.uuid4().hex}.tar", None, 0, {}
        for batch in batches:
            found = []
            for data in batch.column(batch.num_columns - 1):
                data = data.as_py()
                if data is None:
                    found.append((None,) * 4)
                    continue
                digest = hashlib.sha256(data).hexdigest()
                if digest not in where:
                    if sink is None:
                        files.create_dir(root, recursive=True)
                        sink = files.open_output_stream(f"{root}/{shard}")
                    coded = encode_png(data)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(coded)
                    sink.write(head := info.tobuf(tarfile.USTAR_FORMAT))
                    sink.write(coded + bytes(-len(coded) % 512))
                    where[digest] = (at + len(head), len(coded))
                    at += len(head) + len(coded) + -len(coded) % 512
                found.append((digest, shard, *where[digest]))
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                names=schema.names,
            )
        if sink is not None:
            sink.write(bytes(1024))
            sink.close()

    placed = rows.select(*[F.col(f"`{c}`") for c in others], payload).transform(in_arrow, run, schema)
    index = f"{directory}/index"
    placed.write.parquet(index)
    return spark.read.schema(schema).parquet(index).withColumn("shard", F.concat(F.lit(f"{directory}/"), F.col("shard")))


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in ranges of shard and offset, a task for about READ_BYTES of what is stored, and one for each core at least;
    only places are shuffled."""
    total = rows.agg(F.sum("length")).first()[0] or 0
    tasks = min(MOST_TASKS, max(rows.sparkSession.sparkContext.defaultParallelism, 1 + total // READ_BYTES))
    return rows.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")


def _ranged(rows: DataFrame, fields: str, read) -> DataFrame:
    """``rows`` with the fields that ``read(handle, offset, length, digest)`` gives; a shard stays open over its rows.

    Rows without a place get nulls. Columns named as the new ones are replaced.
    """
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(fields)
    kept = [c for c in rows.columns if c not in new.names]
    schema = T.StructType([rows.schema[c] for c in kept] + new.fields)
    names = schema.names

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        name, handle, last, value = None, None, None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                found = []
                for shard, offset, length, digest in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length", "digest")), strict=True):
                    if shard is None:
                        found.append((None,) * len(new.fields))
                        continue
                    if shard != name:
                        files, path = open_fs(shard)
                        if handle is not None:
                            handle.close()
                        name, handle = shard, files.open_input_file(path)
                    if last != (shard, offset):
                        last, value = (shard, offset), read(handle, offset, length, digest)
                    found.append(value)
                columns = list(zip(*found, strict=True)) if found else [()] * len(new.fields)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, new.fields, strict=True))], names=names
                )
        if handle is not None:
            handle.close()

    return rows.select(*[F.col(f"`{c}`") for c in kept]).transform(in_arrow, run, schema)


def with_metadata(rows: DataFrame) -> DataFrame:
    """Adds width, height, bit_depth and colour_type from the first 33 bytes of each stored picture alone.

    Rows without a place (null payloads) get nulls; rows that share a place, repeated ones too, get equal values; columns named
    as the new ones are replaced; no rows give none.
    """

    def read(handle, offset, length, digest):
        handle.seek(offset)
        return read_header(handle.read(min(length, HEADER_BYTES)))

    return _ranged(rows, "width int, height int, bit_depth int, colour_type int", read)


def with_content(rows: DataFrame, *, payload: bool = False) -> DataFrame:
    """Reads the stored bytes back, verifies their digest and adds what the samples give.

    New columns: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and the samples
    themselves with ``payload=True``. Nulls, repeats, clashing columns and no rows as in ``with_metadata``; a picture of any
    size is held once at a time.
    """

    def read(handle, offset, length, digest):
        handle.seek(offset)
        coded = handle.read(length)
        samples = decode_png(coded)
        own = hashlib.sha256(samples).hexdigest()
        if own != digest:
            raise ValueError(f"the bytes stored as {digest} have the digest {own}")
        told = (len(samples), own, zlib.crc32(samples[-16:]), len(coded), hashlib.sha256(coded).hexdigest(), features(samples))
        return (*told, samples) if payload else told

    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _ranged(rows, fields + ", payload binary" * payload, read)


def text_payloads(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload): each whole text in UTF-8, filled with spaces to a positive multiple of 192 bytes.

    A null or empty text gives 192 spaces. Extra columns are not read.
    """
    data = text_or_empty(text_column).cast("binary")
    size = F.octet_length(data)
    full = F.greatest(F.lit(1), F.ceil(size / WIDTH)).cast("int") * WIDTH
    return docs.select(F.col(id_column).alias("doc_id"), size.cast("long").alias("n_bytes"), F.rpad(data, full, F.lit(b" ")).alias("payload"))
