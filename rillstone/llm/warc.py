"""Zstandard WARC archives: one frame per record, the dictionary in a leading skippable frame.

Writing goes through Spark's text sink, so archives reach any store that Spark
writes and a lost task's file is never left half done. A row of the sink is a
frame; the line separator is an empty skippable frame, which decoders pass over.
The first row of each file is a skippable frame that holds the dictionary, which
is trained on a bounded sample (the first ``SAMPLE_CHARS`` characters of
``DICTIONARY_PAGES`` pages).

Reading loads the dictionary, finds each frame's length from its block headers,
decodes one frame for each record, and checks the version line, the mandatory
headers, the block's length and its digest.

Of records with equal payloads of at least ``REVISIT_BYTES``, that with the
smallest page id is a response and the others revisit it; a revisit has no
block, and keeps the payload's digest and length in its headers.

Edge cases: a null html is an empty payload; a null url leaves its header out;
a null page id is written as `null`, and never is the smallest unless all are
null. Repeated rows: rows with the smallest id are all responses. Empty tables
write no record. A page is a record whatever its length, a few times its bytes
in a task's memory. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.runtime import work_folder

#: Fixed values of the formats: frame magics, record lines and headers.
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE_MAGIC = 0x184D2A50
DICTIONARY_MAGIC = 0x184D2A5D
TRAINED_MAGIC = b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_PAGES = 120
SAMPLE_CHARS = 4000
DICTIONARY_BYTES = 1 << 14
REVISIT_BYTES = 100
#: Payload bytes of one archive, about.
ARCHIVE_BYTES = 1 << 24
DATE = "2024-01-01T00:00:00Z"
#: An empty skippable frame; all of its bytes are ASCII.
SEPARATOR = struct.pack("<II", SKIPPABLE_MAGIC, 0).decode("ascii")
_ID = "urn:page:"


def train(samples: list[bytes]) -> bytes:
    """A dictionary; of too few or too short samples their own bytes, which serve as one too."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if s]).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or VERSION + b"\r\nWARC-Type: response\r\n")[-DICTIONARY_BYTES:]


def load(raw: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == TRAINED_MAGIC else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(raw, dict_type=kind)


def dictionary_frame(raw: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC record."""
    block = b"" if revisit else payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{_ID}{'null' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~|^`{}<>\"\\")
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{_ID}{'null' if refers_to is None else refers_to}>"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises ValueError where it isn't valid."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError(f"not a WARC record: {raw[:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(": ")
        if not colon:
            raise ValueError(f"not a header line: {line!r}")
        headers[name] = value
    if missing := [h for h in MANDATORY if h not in headers]:
        raise ValueError(f"headers missing: {missing}")
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, its header says {size}")
    block = rest[:size]
    if headers["WARC-Type"] == "response" and headers.get("WARC-Payload-Digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("the payload's digest is another than its header says")
    return headers, block


def frame_end(raw: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends."""
    describes = raw[at + 4]
    single = describes >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[describes & 3] + ((single, 2, 4, 8)[describes >> 6])
    last = 0
    while not last:
        block = int.from_bytes(raw[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * (describes >> 2 & 1)


def frames(archive: bytes) -> Iterator[tuple[int, memoryview]]:
    """Magic and bytes of each frame; of a skippable one its content."""
    raw, at = memoryview(archive), 0
    while at < len(raw):
        if len(raw) - at < 8:
            raise ValueError("the archive ends within a frame")
        magic, size = struct.unpack_from("<II", raw, at)
        if magic == FRAME_MAGIC:
            end = frame_end(raw, at)
            content = raw[at:end]
        elif magic & ~0xF == SKIPPABLE_MAGIC:
            end = at + 8 + size
            content = raw[at + 8 : end]
        else:
            raise ValueError(f"no frame begins at byte {at}")
        if end > len(raw):
            raise ValueError("the archive ends within a frame")
        yield magic, content
        at = end


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    decoder = None
    for k, (magic, content) in enumerate(frames(archive)):
        if magic == DICTIONARY_MAGIC:
            if k:
                raise ValueError("the dictionary must lead")
            decoder = zstandard.ZstdDecompressor(dict_data=load(bytes(content)))
        elif magic == FRAME_MAGIC:
            decoder = decoder or zstandard.ZstdDecompressor()
            yield parse(decoder.decompress(content))


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to and revisit of each row of `pages`."""
    held = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = held.where(F.length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = large.join(first, "digest").where("not (page_id <=> refers_to)").distinct()
    later = later.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to")
    joined = held.join(later, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    return joined.select("page_id", "url", "payload", "digest", "refers_to", F.col("r_digest").isNotNull().alias("revisit"))


def write(pages: DataFrame, path: str, dictionary_pages: int = DICTIONARY_PAGES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record for each row of `pages` to archives in the folder `path`."""
    total, n = pages.agg(F.sum(F.octet_length("html")), F.count(F.lit(1))).first()
    # about twice as many pages as are wanted pass by their hash, from all partitions together
    hashed = pages.where(F.length("html") > 0).select(F.xxhash64("html").alias("h"), F.substring("html", 1, SAMPLE_CHARS).alias("html"))
    sample = hashed.where(F.pmod("h", F.lit(max(1, n // (2 * dictionary_pages)))) == 0).orderBy("h", "html").limit(dictionary_pages)
    raw = train([VERSION + b"\r\n" + r["html"].encode() for r in sample.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = zstandard.ZstdCompressor(level=3, dict_data=load(raw), write_checksum=True)
        rows, size, begun = [], 0, False
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                for row in batch.slice(low, 64).to_pylist():
                    if not begun:
                        rows, begun = [dictionary_frame(raw)], True
                    rows.append(encoder.compress(record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["revisit"])))
                    size += len(rows[-1])
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["frame"])
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["frame"])

    marked = mark_revisits(pages).drop("digest").coalesce(max(1, -(-(total or 0) // archive_bytes)))
    frame = marked.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frame.write.option("lineSep", SEPARATOR).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload (null for revisits) of each record."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"

    def number(urn: str | None) -> int | None:
        text = urn[len(_ID) + 1 : -1] if urn else "null"
        return None if text == "null" else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for headers, block in records(content.as_buffer()):
                    kind = headers["WARC-Type"]
                    length = int(headers["X-Payload-Length"])
                    if kind == "response" and length != len(block):
                        raise ValueError("the payload's length is another than its header says")
                    rows.append((number(headers["WARC-Record-ID"]), length, headers["WARC-Payload-Digest"].removeprefix("sha256:"), kind, number(headers.get("WARC-Refers-To")), headers.get("WARC-Target-URI"), block if kind == "response" else None))
                    size += len(block) + 200
                    if size > 1 << 20:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes `pages` to archives beside the checkpoints and reads them back; `rillstone.runtime.cleanup` deletes them."""
    spark = pages.sparkSession
    path = work_folder(spark, "warc")
    write(pages, path)
    return read(spark, path)
