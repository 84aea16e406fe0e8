"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, a frame per record.

``write`` packs records, one partition at a time and in a fixed order of its rows, into ``.warc.zst``
files of bounded size in the shared folder, through the file system that owns it; a file is written under a
temporary name and then renamed, so a repeated attempt writes the same files again.
``read`` opens any such files with Spark's binary source and yields records: it loads the dictionary
from the skippable frame (itself compressed or not), finds the end of each frame by its block headers, so
that the time is linear in the archive, decodes one frame per record and checks the
version line, mandatory headers, Content-Length against the bytes that follow, the closing blank
lines and the payload digest; a record that fails comes back with ``error`` set.  An archive is one
binary value of Spark's: ``write`` closes them at ``ARCHIVE_BYTES``, others must be under 2 GB.

Target URIs are written as they are, in UTF-8.  One that a header line can't hold (controls, spaces at an
end) is percent-escaped and marked by a header of its own, and read back unescaped.

Records whose payloads are equal and of ``MIN_REVISIT`` bytes or more are stored once, by the largest
page_id; the others become revisit records that refer to it.

Defined results: a null html is an empty payload, a null url an empty target; rows that repeat a
page_id are records of their own, and all rows with the largest page_id of equal payloads are
responses; a null page_id is stored and read as null and never is the largest; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.storage import new_path
from foliant.session import ship

MIN_REVISIT = 1000
#: Archives are closed once they hold this much, compressed; the dictionary's size, and the sample it is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_CHARS = 16 << 20, 32 << 10, 500, 4096
SALTS = 16
LEVEL = 3
#: Magic numbers of the formats; fixed values.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages; what it holds changes sizes, never contents."""
    rows = pages.select(F.substring("html", 1, SAMPLE_CHARS).alias("h")).filter("h != ''").limit(SAMPLE_ROWS).collect()
    samples = [r.h.encode() for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b"".join(samples)[:DICTIONARY_BYTES] or b" " * 8


#: Characters that end a header line or vanish at its ends.
_UNHEADED = re.compile(r"[\x00-\x1f\x7f]|^[\x20]|[\x20]$")
ESCAPED = "X-Target-URI-Escaped"


def target_fields(url: str) -> list[tuple[str, str]]:
    if _UNHEADED.search(url):
        return [("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=")), (ESCAPED, "percent")]
    return [("WARC-Target-URI", url)]


def target_of(fields: dict) -> str:
    url = fields.get("warc-target-uri", "")
    return unquote(url) if ESCAPED.lower() in fields else url


def record_bytes(page_id, url: str, kind: str, payload: bytes, digest: str, size: int, refers_to=None) -> bytes:
    name = lambda x: f"<urn:foliant:page:{'null' if x is None else x}>"
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), *target_fields(url), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Payload-Length", str(size))]
    if kind == "revisit":
        head += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", PROFILE)]
        payload = b""
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def archive_head(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, refers_to: null for responses."""
    key = F.when(F.octet_length("html") >= min_bytes, F.sha2("html", 256))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("key", key)
    long = rows.filter("key IS NOT NULL")
    same = long.groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    salted = same.select("key", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = long.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    told = met.select("page_id", "url", "html", F.when(F.col("last") != F.coalesce("page_id", F.col("last") - 1), F.col("last")).alias("refers_to"))
    return told.unionByName(rows.filter("key IS NULL").select("page_id", "url", "html", F.lit(None).cast(told.schema["refers_to"].dataType).alias("refers_to")))


def write(pages: DataFrame, path: str, dictionary: bytes) -> int:
    """Archives of ``with_revisits`` rows under ``path``; returns how many records were written."""

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        filesystem, base = pafs.FileSystem.from_uri(path)
        filesystem.create_dir(base, recursive=True)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        head, parts, size, count, nth = archive_head(dictionary), [], 0, 0, 0

        def close(parts, nth):
            name = f"{base}/part-{context.partitionId():06d}-{nth:04d}"
            draft = f"{name}.{context.taskAttemptId()}.tmp"
            with filesystem.open_output_stream(draft) as out:
                out.write(head)
                for x in parts:
                    out.write(x)
            filesystem.move(draft, f"{name}.warc.zst")

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = html.encode()
                digest = hashlib.sha1(payload).hexdigest()
                kind = "response" if refers_to is None else "revisit"
                parts.append(packer.compress(record_bytes(page_id, url or "", kind, payload, digest, len(payload), refers_to)))
                size, count = size + len(parts[-1]), count + 1
                if size >= ARCHIVE_BYTES:
                    close(parts, nth)
                    parts, size, nth = [], 0, nth + 1
        if parts:
            close(parts, nth)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["records"])

    ship(pages.sparkSession)
    ordered = pages.sortWithinPartitions("page_id", "url", F.xxhash64("html"), "refers_to")
    return ordered.mapInArrow(run, "records bigint").agg(F.sum("records")).first()[0] or 0


RECORDS = "archive string, offset bigint, type string, record_id string, target_uri string, payload_digest string, payload_length bigint, refers_to string, payload binary, error string"


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, by its header and block headers; over the end of data if it is cut."""
    flags = data[at + 4] if at + 4 < len(data) else 0
    single = flags >> 5 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    while at + 3 <= len(data):
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * (flags >> 2 & 1)
    return len(data) + 1


def split_archive(data: bytes):
    """(offset, record bytes or None, error) of each frame."""
    at, decoder, view = 0, zstandard.ZstdDecompressor(), memoryview(data)
    while at + 8 <= len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if at + 8 + size > len(data):
                yield at, None, "frame: it ends early"
                return
            if magic == SKIPPABLE and at == 0:
                held = data[8 : 8 + size]
                if held[:4] == struct.pack("<I", FRAME):
                    held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            at += 8 + size
        elif magic == FRAME:
            end = frame_end(view, at)
            if end > len(data):
                yield at, None, "frame: it ends early"
                return
            try:
                reader = decoder.decompressobj()
                record = reader.decompress(view[at:end])
            except zstandard.ZstdError as e:
                yield at, None, f"frame: {e}"
                return
            if not reader.eof:
                yield at, None, "frame: it ends early"
                return
            yield at, record, None
            at = end
        else:
            yield at, None, "frame: no known magic number"
            return
    if at != len(data):
        yield at, None, "frame: bytes are left over"


def parse_record(record: bytes) -> tuple[dict, bytes, str | None]:
    """Headers by lower-case name, payload and what is wrong, if anything."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip(" \t").lower(): v.strip(" \t") for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}
    if not gap or not lines[0].startswith("WARC/1."):
        return fields, b"", "version: no WARC/1.x record"
    if missing := [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in fields]:
        return fields, b"", f"headers: {', '.join(missing)} missing"
    if not fields["content-length"].isdigit():
        return fields, b"", "length: Content-Length is no number"
    size = int(fields["content-length"])
    payload = rest[:size]
    if len(payload) != size or rest[size:] != b"\r\n\r\n":
        return fields, payload, "length: Content-Length does not match the record"
    algorithm, _, value = fields.get("warc-payload-digest", "").partition(":")
    if fields["warc-type"] == "response" and algorithm == "sha1" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != value:
        return fields, payload, "digest: the payload has another"
    return fields, payload, None


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ``*.warc.zst`` under ``path``, as ``RECORDS``."""

    def run(batches):
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in RECORDS.split(", ")]
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows, size = [], 0
                for at, record, error in split_archive(content.as_py()):
                    fields, payload, wrong = parse_record(record) if record is not None else ({}, b"", error)
                    digest = fields.get("warc-payload-digest", "").partition(":")[2]
                    try:
                        digest = base64.b32decode(digest).hex() or None
                    except ValueError:
                        digest, wrong = None, wrong or "digest: it is not base 32"
                    length = fields.get("x-payload-length") or str(len(payload))
                    rows.append((name.as_py(), at, fields.get("warc-type"), fields.get("warc-record-id"), target_of(fields), digest, int(length) if length.isdigit() else None, fields.get("warc-refers-to"), payload, wrong))
                    size += len(payload)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes every page to archives in the shared folder and returns the records read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    rows = with_revisits(pages)
    if not write(rows, path, train_dictionary(pages)):
        return spark.createDataFrame([], RECORDS)
    return read(spark, path)


def page_number(name):
    """The page_id in a record's name, null for others."""
    return F.regexp_extract(F.coalesce(name, F.lit("")), r"page:(-?[0-9]+)>", 1).try_cast("bigint")
