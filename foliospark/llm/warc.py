"""WARC archives compressed by Zstandard with a dictionary.

An archive starts with a skippable frame that holds the dictionary; then every record is one frame of its own, so a
record can be read from its offset alone once the dictionary is known.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import hot_join, hot_keys, in_arrow, open_fs, scratch, text_or_empty, written

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DATE = "2024-01-01T00:00:00Z"
LEAST_REVISIT = 1000
#: An archive that has grown beyond this is closed and another begun.
ARCHIVE_BYTES = 256 << 20
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def build_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block); ValueError on a wrong version line, a missing or malformed header or a wrong length."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("a record must begin with its version and end its headers with an empty line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"malformed header {line!r}")
        headers[name.strip()] = value.strip()
    if missing := [h for h in REQUIRED if h not in headers]:
        raise ValueError(f"missing headers {missing}")
    if not headers["Content-Length"].isdigit() or len(rest) != int(headers["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as its Content-Length says")
    return headers, rest[:-4]


def dictionary_frame(content: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


class ArchiveReader:
    """Records of one archive, read as a stream: the dictionary first, then frame by frame.

    The dictionary may itself be compressed. Any violation (no dictionary frame, a frame cut short, a malformed record,
    a wrong payload digest) raises ValueError naming the offset.
    """

    #: Bytes asked of the file at a time; a longer record takes as many reads as it needs.
    STEP = 1 << 14

    def __init__(self, handle):
        import zstandard

        self.zstd, self.handle = zstandard, handle
        head = handle.read(8)
        if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
            raise ValueError("offset 0: the archive does not begin with a dictionary frame")
        size = struct.unpack("<I", head[4:])[0]
        content = handle.read(size)
        if len(content) != size:
            raise ValueError("offset 0: the dictionary is cut short")
        if content[:4] == FRAME_MAGIC:
            content = zstandard.ZstdDecompressor().decompress(content)
        self.offset = 8 + size
        dictionary = zstandard.ZstdCompressionDict(content) if content else None
        self.decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()

    def __iter__(self) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
        """(offset, frame length, headers, block) of each record."""
        rest, ended = b"", False
        while True:
            if not rest:
                rest = self.handle.read(self.STEP)
                if not rest:
                    return
            if rest[:4] != FRAME_MAGIC[: len(rest[:4])]:
                raise ValueError(f"offset {self.offset}: no frame begins here")
            frame, parts, used = self.decompressor.decompressobj(), [], 0
            while True:
                try:
                    parts.append(frame.decompress(rest))
                except self.zstd.ZstdError as e:
                    raise ValueError(f"offset {self.offset}: {e}") from e
                used += len(rest)
                if frame.eof:
                    used -= len(frame.unused_data)
                    rest = frame.unused_data
                    break
                rest = self.handle.read(self.STEP)
                if not rest:
                    raise ValueError(f"offset {self.offset}: the frame is cut short")
            try:
                headers, block = parse_record(b"".join(parts))
            except ValueError as e:
                raise ValueError(f"offset {self.offset}: {e}") from e
            yield self.offset, used, headers, block
            self.offset += used


#: Bits of a bitmap as Spark builds them, and of all bitmaps of the filter at most (16 MB).
BITMAP_BITS, FILTER_BITS = 32_768, 1 << 27


def _slices(batches: Iterator, rows: int = 128) -> Iterator:
    """Batches cut so that only a few payloads are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def write_archives(
    pages: DataFrame, *, directory: str | None = None, least: int = LEAST_REVISIT, samples: int = 64, most_bytes: int = ARCHIVE_BYTES,
    id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
) -> str:
    """Writes a record for every row of ``pages``, archives of about ``most_bytes``; gives the directory.

    Among rows of equal payloads of at least ``least`` bytes, those with the largest page_id are responses and the others
    revisits of it without a block (rows that repeat that page_id are responses too). Null html is an empty payload; a
    null url is written as an empty target; among null page_ids, null counts as the smallest. Extra columns are not read.
    Payloads that have no copy are written where they are read: smaller ones, and larger ones whose digest is not in a Bloom
    filter of the repeated digests. The others meet their digest's first page in one shuffle, in which the copies of a
    payload are dealt to many tasks; what the filter lets through by chance only takes that way too. A payload of any length is one record, held once at a time. An empty
    table gives no archive. Each archive's dictionary is made of its own first ``samples`` records, so it needs no driver.
    Names carry a fresh id for each attempt; only archives named in the index that the job commits are read later.
    """
    spark = pages.sparkSession
    directory = directory or scratch(spark, "warc")
    html = text_or_empty(html_column)
    size, digest, page = F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("digest"), F.col(id_column).alias("page_id")
    rows = pages.select(page, F.coalesce(F.col(url_column), F.lit("")).alias("url"), html.cast("binary").alias("payload"), digest, size)
    first = written(spark, rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "warc-digests")
    bits = min(FILTER_BITS, max(BITMAP_BITS, 1 << (16 * first.count()).bit_length()))
    place = F.pmod(F.xxhash64("digest"), F.lit(bits))
    spots = first.select((place / BITMAP_BITS).cast("int").alias("map"), (place % BITMAP_BITS).alias("bit"))
    maps = spots.groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits"))  # FILTER_BITS at most in all
    byte = F.conv(F.hex(F.substring("bits", (place % BITMAP_BITS / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (place % 8).cast("int")) % 2 == 1
    found = rows.where(F.col("size") >= least).withColumn("map", (place / BITMAP_BITS).cast("int")).join(F.broadcast(maps), "map", "left").withColumn("maybe", F.coalesce(is_set, F.lit(False))).drop("map", "bits")
    met = hot_join(found.where("maybe"), first.drop("n"), ["digest"], hot_keys(first, ["digest"]), F.struct("page_id", "url"), "left")
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    copied = met.select("page_id", "url", F.when(~revisits, F.col("payload")).alias("payload"), "digest", "size", F.when(revisits, F.col("first_id")).alias("refers_to"))
    alone = rows.where(F.col("size") < least).unionByName(found.where("NOT maybe").drop("maybe"))
    full = alone.select("page_id", "url", "payload", "digest", "size", F.lit(None).cast(pages.schema[id_column].dataType).alias("refers_to")).unionByName(copied)

    def run(batches: Iterator):
        import pyarrow as pa
        import zstandard

        files, root = open_fs(directory)
        name, sink, packer, n, size_now = None, None, None, 0, 0

        def closed():
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "records"])

        for batch in _slices(batches):
            records = []
            for page_id, url, payload, digest, size, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                headers = [
                    ("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
                    ("WARC-Target-URI", " ".join(url.split())), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page_id is None else str(page_id)),
                ]
                if payload is None:
                    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to)), ("X-Payload-Bytes", str(size))]
                records.append(build_record(headers, payload or b""))
            if sink is None:
                content = b"".join(r[:2048] for r in records[:samples])[-(110 << 10) :]
                name, n, size_now = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                files.create_dir(root, recursive=True)
                sink = files.open_output_stream(f"{root}/{name}")
                sink.write(dictionary_frame(content))
                packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True, write_content_size=True)
            for r in records:
                frame = packer.compress(r)
                sink.write(frame)
                size_now += len(frame)
            n += len(records)
            if size_now > most_bytes:
                yield closed()
                sink = None
        if sink is not None:
            yield closed()

    full.transform(in_arrow, run, "archive string, records long").write.parquet(f"{directory}/index")
    return directory


FIELDS = (
    "archive string, offset long, frame_bytes long, record_type string, record_id string, target_uri string, page_id long, refers_to long,"
    " payload_digest string, payload_bytes long, payload binary"
)


def read_archives(spark, directory: str, *, payload: bool = True) -> DataFrame:
    """A row for each record of the archives that the directory's index names.

    Every header and length is validated, and the payload's SHA-1 against the record's digest; the number of records
    against the index. A revisit has no payload of its own; its payload_bytes come from its header. Null page ids come
    back null, null targets empty, repeated rows as records of their own; payloads may be empty, or of any length and are held
    once at a time; an index without archives gives no rows.
    """
    from pyspark.sql import types as T

    index = spark.read.schema("archive string, records long").parquet(f"{directory}/index")
    schema = T.StructType.fromDDL(FIELDS if payload else FIELDS.replace(", payload binary", ""))

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        files, root = open_fs(directory)
        arrow, rows, held = to_arrow_schema(schema), [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for given in batches:
            for name, expected in zip(*(c.to_pylist() for c in given.columns), strict=True):
                n = 0
                with files.open_input_stream(f"{root}/{name}") as handle:
                    for offset, length, headers, block in ArchiveReader(handle):
                        kind, digest = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").partition(":")[2]
                        if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                            raise ValueError(f"{name}, offset {offset}: the payload does not have the digest {digest}")
                        if kind == "revisit" and (block or "WARC-Refers-To" not in headers):
                            raise ValueError(f"{name}, offset {offset}: a revisit has a reference and no block")
                        page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                        size = len(block) if kind == "response" else int(headers["X-Payload-Bytes"])
                        row = (name, offset, length, kind, headers["WARC-Record-ID"], headers.get("WARC-Target-URI"), int(page) if page else None, int(refers) if refers else None, digest, size)
                        rows.append((*row, block) if payload else row)
                        n, held = n + 1, held + len(block)
                        if len(rows) >= 1000 or held > 1 << 24:
                            yield batch()
                            rows, held = [], 0
                if n != expected:
                    raise ValueError(f"{name} has {n} records, its index says {expected}")
        if rows:
            yield batch()

    tasks = max(1, min(index.count(), 10_000))
    return index.repartition(tasks).transform(in_arrow, run, schema)  # archives are of like size and dealt in turn
