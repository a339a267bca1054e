"""WARC archives of zstandard frames with a shared dictionary.

A file is a skippable frame with the dictionary, then one frame a record. The writer trains a dictionary on the
first records of each file; the reader loads it from the leading frame (stored plain or itself compressed),
decodes one frame at a time and validates every record: version line, header syntax, required headers, block
length, end mark, block and payload digests.

``archive`` writes a table of pages. Of records with equal payloads of at least ``REVISIT_BYTES`` the smallest
page_id is the response and the others revisit it. Cases: a null html is an empty payload; smaller payloads are
all responses; rows that repeat the smallest page_id with the same payload are responses too; null page_ids
never serve as the response of others; an empty table writes no archive and reads back no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import materialise, new_path, table

# Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

REVISIT_BYTES = 100
#: Payload bytes in a file, bytes of its dictionary and of the records that it is trained on, rows of a read batch, salts of a payload.
FILE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, BATCH_ROWS, SALTS = 64 << 20, 16 << 10, 1 << 20, 256, 32
LEVEL = 3


class InvalidRecord(ValueError):
    """A frame that isn't a valid WARC record."""


def build_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    for name, value in headers:
        if any(c in name + value for c in "\r\n") or ":" in name:
            raise InvalidRecord(f"header {name!r} can't be written")
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))])]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises InvalidRecord."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in (b"WARC/1.0", VERSION):
        raise InvalidRecord("no version line or header end")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip() or name.decode() in headers:
            raise InvalidRecord(f"bad header line {line[:80]!r}")
        headers[name.decode()] = value.strip().decode()
    if missing := [k for k in REQUIRED if k not in headers]:
        raise InvalidRecord(f"missing {missing}")
    if not headers["Content-Length"].isdigit() or int(headers["Content-Length"]) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise InvalidRecord(f"the block isn't of length {headers['Content-Length']}")
    block = rest[:-4]
    for name, of in (("WARC-Block-Digest", block), ("WARC-Payload-Digest", block if headers["WARC-Type"] == "response" else None)):
        if of is not None and name in headers and headers[name] != "sha256:" + hashlib.sha256(of).hexdigest():
            raise InvalidRecord(f"{name} doesn't match")
    return headers, block


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for the samples; a plain tail of them where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


def write_frames(out, dictionary: bytes, records: Iterable[bytes], compress_dictionary: bool = True) -> int:
    """The dictionary frame, then a frame a record; returns the number of records."""
    stored = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary) if compress_dictionary else dictionary
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(stored)) + stored)
    to, n = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_content_size=True), 0
    for record in records:
        out.write(to.compress(record))
        n += 1
    return n


def read_frames(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of a stream, one frame at a time; what is buffered is bounded by a frame and a chunk."""
    head = source.read(8)
    if not head:
        return
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICTIONARY_MAGIC:
        raise InvalidRecord("no leading dictionary frame")
    stored = source.read(size)
    if len(stored) != size:
        raise InvalidRecord("the dictionary frame is cut short")
    dictionary = zstandard.ZstdDecompressor().decompress(stored) if stored[:4] == ZSTD_MAGIC else stored
    of, left = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)), b""
    while left or (left := source.read(chunk)):
        one, out = of.decompressobj(), []
        while True:
            try:
                out.append(one.decompress(left))
            except zstandard.ZstdError as e:
                raise InvalidRecord(f"a frame can't be decoded: {e}") from e
            if one.eof:
                left = one.unused_data
                break
            if not (left := source.read(chunk)):
                raise InvalidRecord("the last frame is cut short")
        yield b"".join(out)


def page_record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {digest}")
    clean = "".join(c if " " <= c != "\x7f" else "%%%02X" % ord(c) for c in url or "")
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", clean), ("Content-Type", "text/html; charset=utf-8"), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload))),
    ]
    block = payload
    if refers_to is not None:
        first, block = uuid.uuid5(uuid.NAMESPACE_URL, f"{refers_to} {digest}"), b""
        headers += [("WARC-Refers-To", f"<urn:uuid:{first}>"), ("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", str(refers_to))]
    headers.append(("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()))
    return build_record(headers, block)


def writer(folder: str, file_bytes: int):
    """For mapInArrow: writes the rows' records into files of about ``file_bytes`` and yields (path, records).
    A file is written under a name of its own; only those that the committed rows list are ever read, so a task
    that ran twice leaves a file that nobody reads."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)

        def records():
            for batch in batches:
                c = [batch.column(k) for k in ("page_id", "url", "html", "digest", "refers_to")]
                for i in range(batch.num_rows):
                    html = c[2][i].as_buffer()
                    yield page_record(c[0][i].as_py(), c[1][i].as_py(), b"" if html is None else bytes(html), c[3][i].as_py(), c[4][i].as_py())

        rows = records()
        store.create_dir(base, recursive=True)
        while True:
            samples, size = [], 0
            for record in rows:
                samples.append(record)
                size += len(record)
                if size >= SAMPLE_BYTES:
                    break
            if not samples:
                return
            written = [0]

            def some(written=written, samples=samples):
                yield from samples
                written[0] = sum(map(len, samples))
                while written[0] < file_bytes and (record := next(rows, None)) is not None:
                    written[0] += len(record)
                    yield record

            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(path, compression=None) as out:
                n = write_frames(out, train([x[:4096] for x in samples]), some())
            yield pa.RecordBatch.from_pydict({"path": [path.removeprefix(base).lstrip("/")], "records": pa.array([n], pa.int64())})

    return write


READ = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
)


def reader(folder: str):
    """For mapInArrow over (path, records): one row a record; a file with another number of records than listed is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, wanted in zip(*(batch.column(k).to_pylist() for k in ("path", "records")), strict=True):
                n, rows = 0, []
                with store.open_input_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20) as source:
                    for data in read_frames(source):
                        h, block = parse_record(data)
                        response = h["WARC-Type"] == "response"
                        if response and len(block) != int(h["X-Payload-Length"]):
                            raise InvalidRecord("the payload isn't of its stated length")
                        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        rows.append((int(h["X-Page-Id"]) if h["X-Page-Id"] else None, int(h["X-Payload-Length"]), digest, h["WARC-Type"], None if response else int(h["X-Refers-To-Page-Id"]), h["WARC-Target-URI"]))
                        n += 1
                        if len(rows) == BATCH_ROWS * 16:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), READ.types, strict=True)], schema=READ)
                            rows = []
                if n != wanted:
                    raise InvalidRecord(f"{name} holds {n} records of {wanted}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), READ.types, strict=True)], schema=READ)

    return read


def with_roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): revisits name the smallest page_id with their payload.
    Only payloads that occur twice are joined, each side dealt over ``SALTS`` keys a payload, so a page that a
    third of the table repeats is spread over that many tasks."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    large = rows.filter(F.length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    twice = large.filter("n > 1 AND first IS NOT NULL").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    twice, _ = materialise(twice, "payloads")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    return salted.join(twice, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", F.when(later, F.col("first")).alias("refers_to"))


def archive(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the pages' archives under ``folder`` and return their list (path, records), itself written down."""
    files = with_roles(pages).mapInArrow(writer(folder, file_bytes), "path string, records long")
    return materialise(files, "archives")[0]


def load(files: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the listed archives."""
    spark = files.sparkSession
    return files.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "path").mapInArrow(
        reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    )


def query(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    return load(archive(table(spark, sf_dir, "pages"), folder), folder)


ORACLE = f"""
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id > first THEN first END AS refers_to, url
FROM f
"""

