"""Archives: round trip, revisits, and files that must be refused."""

from __future__ import annotations

import hashlib
import struct

import pytest
import zstandard

from geoledger.llm import warc_zstd as W


def test_round_trip(spark, tmp_path):
    long, other = "ä" * 700, "b" * 1000
    pages = [(1, "http://a/\r\n%0A", long), (5, "u", long), (3, None, long), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""),
             (8, "u", other), (8, "u", other), (9, "u", "c" * 999), (10, "u", "c" * 999), (None, "n", other), (None, "n", "d" * 2000), (11, "x", "P*M\x18\x00\x00\x00\x00\n" * 300), (12, "u", "e" * 3_000_000)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, key string")
    W.write_archives(df, str(tmp_path / "w"))
    got = sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in W.scan_archives(spark.read, str(tmp_path / "w")).collect()), key=repr)
    wanted = []
    for i, u, h in pages:
        raw = (h or "").encode()
        first = max((j for j, _, g in pages if g == h and j is not None), default=None)
        again = len(raw) >= 1000 and first is not None and i != first
        wanted.append((i, u, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None, None if again else raw))
    assert got == sorted(wanted, key=repr)


def test_empty_table(spark):
    assert W.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def archive(*records: bytes, dictionary: bytes = b"some words", between: bytes = b"") -> bytes:
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return struct.pack("<II", W.DICTIONARY_MAGIC, len(dictionary)) + dictionary + between.join(packer.compress(r) for r in records)


def test_reader_checks_what_it_reads():
    good = W.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, False)
    assert [r["payload"] for r in W.read_archive(archive(good, good, between=W.EMPTY_FRAME.encode()))] == [b"payload"] * 2
    assert list(W.read_archive(b"")) == []
    bad = {
        "no dictionary": zstandard.compress(good), "cut": archive(good)[:-3], "junk": archive(good) + b"junk junk",
        "length": archive(good.replace(b"Content-Length: 7", b"Content-Length: 8")), "digest": archive(good.replace(b"payload\r", b"paylaod\r")),
        "version": archive(b"WARC/9" + good[8:]), "header": archive(good.replace(b"WARC-Type: response\r\n", b"")), "twice": archive(good.replace(b"\r\n\r\npay", b"\r\nWARC-Type: response\r\n\r\npay")),
        "type": archive(good.replace(b"response", b"request")), "skippable cut": struct.pack("<II", W.DICTIONARY_MAGIC, 99) + b"x",
    }
    for name, data in bad.items():
        with pytest.raises(ValueError):
            list(W.read_archive(data))
            pytest.fail(name)


def test_frame_lengths():
    for text in (b"", b"a", b"ab" * 70_000, bytes(range(256)) * 2000):
        for checksum in (False, True):
            for size in (False, True):
                frame = zstandard.ZstdCompressor(write_checksum=checksum, write_content_size=size).compress(text)
                assert W._frame_length(frame + b"rest", 0) == len(frame)
