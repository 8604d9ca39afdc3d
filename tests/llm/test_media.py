import hashlib
import struct
import tarfile
import zlib

import pytest

from foliospark.llm import media


def filtered_png(rows, width, kinds):
    """A PNG whose rows use the given filters, written from the format's definition."""
    packed, above = b"", bytes(width)
    for row, kind in zip(rows, kinds, strict=True):
        out = bytearray()
        for x, v in enumerate(row):
            a, b, c = (row[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        packed += bytes([kind]) + bytes(out)
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(packed)) + chunk(b"IEND", b"")


def test_png_round_trip_and_all_filters():
    data = bytes(range(192)) + b"abc" * 64
    assert media.decode_png(media.encode_png(data)) == data and media.read_header(media.encode_png(data)[:33]) == (192, 2, 8, 0)
    rows = [bytes((i * 37 + x * x) & 255 for x in range(40)) for i in range(10)]
    assert media.decode_png(filtered_png(rows, 40, [0, 1, 2, 3, 4] * 2)) == b"".join(rows)


def test_damage_is_noticed():
    coded = media.encode_png(b"x" * 384)
    for at in (0, 20, 30, 60, len(coded) - 3):
        broken = bytearray(coded)
        broken[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(bytes(broken))
    with pytest.raises(ValueError):
        media.encode_png(b"short")


def expected(text):
    data = (text or "").encode()
    full = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
    return len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])


def test_rows(spark):
    rows = [(1, "a"), (2, None), (3, ""), (4, "é" * 96), (5, "é" * 97), (None, "x" * 100_000), (6, "a"), (6, "a"), (7, "\x00\r\n ")]
    frame = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, digest string").repartition(3)
    stored = media.store(media.text_payloads(frame))
    found = media.with_content(media.with_metadata(stored), payload=True).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found), key=lambda t: (key(t[0]), t[1:])) == sorted(((d, *expected(t)) for d, t in rows), key=lambda t: (key(t[0]), t[1:]))
    for r in found:
        assert r.width == 192 and r.height * 192 == r.payload_bytes == len(r.payload) and (r.bit_depth, r.colour_type) == (8, 0)
        with open(r.shard.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            coded = f.read(r.length)
        assert hashlib.sha256(coded).hexdigest() == r.media_sha256 and len(coded) == r.media_bytes
        with tarfile.open(r.shard.removeprefix("file://")) as tar:
            names = tar.getnames()
            assert f"{r.digest}.png" in names and len(names) == len(set(names))
            assert tar.extractfile(f"{r.digest}.png").read() == coded
    same = {(r.feature, r.media_sha256) for r in found if r.payload_sha256 == expected("a")[2]}
    assert len(same) == 1


def test_query_equals_brute_force(spark):
    from foliospark.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = queries.op10_media_columns(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found} == {d: expected(t) for d, t in texts.items()}


def test_empty_table(spark):
    stored = media.store(media.text_payloads(spark.createDataFrame([], "doc_id long, text string")))
    assert media.with_content(media.with_metadata(stored)).collect() == []


def feature(samples):
    """Mean, deviation, entropy and 64 stretches against the mean, by the definitions."""
    import math

    n = len(samples)
    mean = sum(samples) / n
    std = math.sqrt(sum((x - mean) ** 2 for x in samples) / n)
    share = [samples.count(x) / n for x in set(samples)]
    ends = [k * n // 64 for k in range(65)]
    bits = "".join("1" if b > a and sum(samples[a:b]) / (b - a) > mean else "0" for a, b in zip(ends, ends[1:]))
    return mean, std, -sum(p * math.log2(p) for p in share), f"{int(bits, 2):016x}"


def test_features_equal_their_definitions(spark):
    from foliospark.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op10_media_columns(spark, "/root/testdata/sf0.001").collect():
        data = media.pad((texts[r.doc_id] or "").encode())
        told = dict(x.split("=") for x in r.feature.split(";"))
        mean, std, entropy, bits = feature(data)
        assert told["ahash"] == bits
        assert [float(told[k]) for k in ("mean", "std", "entropy")] == pytest.approx([mean, std, entropy], abs=1e-4)


def test_clashing_columns_null_payloads_and_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(media, "READ_BYTES", 200)
    rows = [(i, bytearray(f"{i:>192}".encode()) if i % 7 else None, "own", "own", 1, 2, "own") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, payload binary, digest string, shard string, offset long, length long, feature string").repartition(3)
    stored = media.dealt(media.store(frame))
    assert stored.rdd.getNumPartitions() > 5
    found = {r.doc_id: r for r in media.with_content(media.with_metadata(stored), payload=True).collect()}
    assert all((found[i].payload is None and found[i].width is None) if p is None else bytes(found[i].payload) == bytes(p) for i, p, *_ in rows) and len(found) == 60
