"""Web archives (WARC) of Zstandard frames with a shared dictionary: writer and reader.

A file begins with a skippable frame that holds the dictionary; every record
is one frame of its own. Files go through Spark's own writers and readers, so
any file system Spark can reach will do: frames are rows of the text sink,
whose line separator is an empty skippable frame, which decoders pass over.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "1970-01-01T00:00:00Z"


def train_dictionary(pages: DataFrame, html: str, sample: int = 512, size: int = 32_768, bytes_each: int = 4096) -> bytes:
    """Dictionary from at most ``sample`` payloads of at most ``bytes_each`` bytes; it decides file size, never content.

    The sample is the rows of smallest hash. Too small or too plain a table gives raw bytes of the sample.
    """
    part = F.substring(F.encode(F.coalesce(html, F.lit("")), "UTF-8"), 1, bytes_each)
    heads = pages.select(part.alias("p")).where("length(p) > 64").withColumn("h", F.xxhash64("p"))
    wanted = [r["h"] for r in heads.select("h").orderBy("h").limit(sample).collect()]  # hashes only: every task offers its own
    samples = sorted({bytes(r["p"]) for r in heads.where(F.col("h").isin(wanted)).dropDuplicates(["h"]).collect()}) if wanted else []
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: response with its payload, or revisit without."""
    body = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_name(page_id)}>",
        f"WARC-Date: {WARC_DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{_name(refers_to)}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return "none" if page_id is None or pd.isna(page_id) else str(int(page_id))


def _id(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise ValueError(f"not a record name: {urn}")
    return None if urn[10:-1] == "none" else int(urn[10:-1])


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; raises if a header is lacking or malformed, or a length or digest does not fit."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] != "WARC/1.1":
        raise ValueError("a record must begin with WARC/1.1 and a block of headers")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon or name.lower() in fields:
            raise ValueError(f"malformed or repeated header: {line[:80]}")
        fields[name.lower()] = value
    missing = {"warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "x-payload-length", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"headers lacking: {sorted(missing)}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"the block is not of the {length} bytes its header says")
    kind, body = fields["warc-type"], rest[:length]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if hashlib.sha1(body).hexdigest() != digest or len(body) != int(fields["x-payload-length"]):
            raise ValueError("the payload does not fit its digest")
    elif kind != "revisit" or length or "warc-refers-to" not in fields:
        raise ValueError(f"not a proper record of type {kind}")
    uri = fields.get("warc-target-uri")
    return {
        "page_id": _id(fields["warc-record-id"]), "payload_bytes": int(fields["x-payload-length"]), "payload_digest": digest,
        "record_type": kind, "refers_to": _id(fields["warc-refers-to"]) if kind == "revisit" else None,
        "url": None if uri is None else uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "payload": body if kind == "response" else None,
    }


def write_archives(pages: DataFrame, path: str, min_revisit: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One archive per task, one record per row.

    Of rows with equal payloads of ``min_revisit`` bytes or more, that of the
    largest page_id is the response and the others are revisits of it (rows that
    repeat that very page_id are responses too); shorter payloads are always
    responses. A null payload is empty; a null page_id never is the one referred
    to, unless all of its group are null, and then all are responses. The
    largest id per digest is found by a combined aggregation. Each payload is
    compressed before it moves, so the join with those ids deals compressed
    frames and splits a crowded digest; payloads too short to revisit are dealt
    by their id. A folder of no rows holds no archive.
    """
    dictionary = train_dictionary(pages, html)
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        for batch in batches:
            digests = [hashlib.sha1(p).hexdigest() for p in batch["payload"]]
            ids = batch["page_id"].tolist()
            yield pd.DataFrame({
                "page_id": batch["page_id"], "url": batch["url"], "digest": digests, "bytes": batch["payload"].map(len),
                "frame": [packer.compress(record(i, u, p, d, None, False)) for i, u, p, d in zip(ids, batch["url"], batch["payload"], digests)],
            }).astype({"page_id": "Int64"})

    narrow = rows.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("bytes"))
    largest = narrow.where(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    frames = rows.mapInPandas(compress, "page_id long, url string, digest string, bytes long, frame binary")
    keyed = frames.withColumn("key", F.when(F.col("bytes") >= min_revisit, F.col("digest")).otherwise(F.concat(F.lit("short "), F.coalesce(F.col("page_id").cast("string"), F.col("digest")))))
    settled = keyed.join(largest.select(F.col("digest").alias("key"), "first"), "key", "left")

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        begun = False
        for batch in batches:
            out = []
            if len(batch) and not begun:
                out.append(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                begun = True
            for i, u, d, n, frame, first in zip(batch["page_id"].tolist(), batch["url"], batch["digest"], batch["bytes"].tolist(), batch["frame"], batch["first"].tolist()):
                if pd.isna(first) or i == first:
                    out.append(frame)
                else:
                    out.append(packer.compress(record(i, u, bytes(n), d, int(first), True)))
            yield pd.DataFrame({"frame": out})

    packed = settled.select("page_id", "url", "digest", "bytes", "frame", "first").mapInPandas(archive, "frame binary")
    packed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Frames of a file as (magic number, content): skippable ones bare, compressed ones whole."""
    at = 0
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if magic in SKIPPABLE:
            (n,) = struct.unpack_from("<I", data, at + 4)
            if at + 8 + n > len(data):
                raise ValueError("a skippable frame is cut off")
            yield magic, data[at + 8 : at + 8 + n]
            at += 8 + n
        elif magic == FRAME_MAGIC:
            n = _frame_length(data, at)
            yield magic, data[at : at + n]
            at += n
        else:
            raise ValueError(f"no frame begins at byte {at}")


def _frame_length(data: bytes, at: int) -> int:
    """Length of the compressed frame at ``at``, from its header and block headers."""
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        block = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if end > len(data):
            raise ValueError("a frame is cut off")
        if block & 1:
            return end + 4 * checksum - at


def read_archive(data: bytes) -> Iterator[dict]:
    """Records of one file: the dictionary first, then one record per frame."""
    parts = frames(data)
    first = next(parts, None)
    if first is None:
        return
    if first[0] != DICTIONARY_MAGIC:
        raise ValueError("the file does not begin with a dictionary frame")
    dictionary = first[1]
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    for magic, frame in parts:
        if magic == FRAME_MAGIC:
            size = zstandard.get_frame_parameters(frame).content_size
            data = unpacker.decompress(frame)
            if size != len(data):
                raise ValueError("a frame is not of the length its header says")
            yield parse_record(data)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def scan_archives(df_reader, path: str, max_rows: int = 256, max_bytes: int = 8 << 20) -> DataFrame:
    """Records of all archives in a folder; ``df_reader`` is ``spark.read``. Batches are bounded in rows and bytes."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for found in read_archive(content):
                    rows.append(found)
                    held += len(found["payload"] or b"")
                    if len(rows) >= max_rows or held >= max_bytes:
                        yield _records(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _records(rows, names)

    return df_reader.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content").mapInPandas(unpack, RECORD)


def _records(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def archived(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to fresh archives in the shared folder and read the records back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_revisit)
    return scan_archives(pages.sparkSession.read, path)
