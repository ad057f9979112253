"""WARC archives in Zstandard: one frame per record, the dictionary in the leading skippable frame.

Writing: each task that has read pages writes files of bounded size into a
folder that driver and executors share, under names and with contents that a
repeated task reproduces. Payloads that occur more than
once are stored once; the others are revisit records that refer to it.

Reading: whole files come through Spark's binaryFile source, so any store that
Spark reads will do. Frame boundaries, dictionary, record version, header
fields, block length, trailing line ends and payload digest are all checked.

Defined results: a null payload is empty; a null id never is the original of a
payload that a row with an id has; rows that share the original's id are all
responses; a null url has no target field; an empty table gives an archive
folder without files and an empty result. A file that fails a check raises
WarcError.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import Scratch

MIN_REVISIT = 1000
#: Payload bytes per file; a single record may be longer.
FILE_BYTES = 8 << 20
DICT_BYTES = 32 << 10
#: The dictionary is trained on about this many pages of at most SAMPLE_BYTES; it changes sizes, never contents.
DICT_SAMPLES = 400
SAMPLE_BYTES = 64 << 10
LEVEL = 3
_SKIPPABLE = 0x184D2A5D
_FRAME = 0xFD2FB528
_RAW_DICT = 0xEC30A437
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


class WarcError(ValueError):
    pass


# Records -----------------------------------------------------------------


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, kind: str) -> bytes:
    """One WARC record holding an HTTP response, or for a revisit its head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if kind == "revisit" else head + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]-._"))
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _head(data: bytes, at: int, what: str) -> tuple[str, dict[str, str], int]:
    """First line, fields by lower-case name, and the offset behind the empty line."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise WarcError(f"{what} without end of header")
    first, *lines = data[at:end].decode("utf-8").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line in {what}: {line!r}")
        fields[name.strip().lower()] = value.strip()
    return first, fields, end + 4


def _length(fields: dict[str, str], what: str) -> int:
    value = fields.get("content-length", "")
    if not value.isdigit():
        raise WarcError(f"{what} without a length")
    return int(value)


def _page(value: str) -> int | None:
    bare = value.removeprefix("<").removesuffix(">")
    if not bare.startswith(_ID):
        raise WarcError(f"unknown record id {value!r}")
    return int(bare[len(_ID) :]) if bare != _ID else None


def parse_record(data: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest of one whole record."""
    first, fields, at = _head(data, 0, "record")
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"unknown version {first!r}")
    length = _length(fields, "record")
    if data[at + length :] != b"\r\n\r\n":
        raise WarcError("block length and record differ")
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        raise WarcError(f"record type {kind!r}")
    block = data[at : at + length]
    status, http, body = _head(block, 0, "response")
    if not status.startswith("HTTP/"):
        raise WarcError("no HTTP status line")
    size = _length(http, "response")
    stated = fields.get("warc-payload-digest", "")
    if not stated.startswith("sha1:"):
        raise WarcError("no payload digest")
    digest = base64.b32decode(stated[5:])
    payload = block[body:]
    if kind == "response":
        if len(payload) != size:
            raise WarcError("payload and its length differ")
        if hashlib.sha1(payload).digest() != digest:
            raise WarcError("payload and its digest differ")
        refers_to = None
    else:
        if payload:
            raise WarcError("a revisit with a payload")
        if "warc-refers-to" not in fields:
            raise WarcError("a revisit that refers to nothing")
        refers_to = _page(fields["warc-refers-to"])
    return {"page_id": _page(fields.get("warc-record-id", "")), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": refers_to, "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest.hex()}


# Archives ----------------------------------------------------------------


def train(samples: list[bytes]) -> bytes:
    """A raw dictionary, or b"" where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    return struct.pack("<II", _SKIPPABLE, len(packed)) + packed


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True, write_content_size=True)


def read_dictionary(data: bytes) -> tuple[bytes, int]:
    """The archive's dictionary (b"" if it has none) and the offset of its first record."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != _SKIPPABLE:
        return b"", 0
    size = struct.unpack_from("<I", data, 4)[0]
    body = data[8 : 8 + size]
    if len(body) != size:
        raise WarcError("archive ends within its dictionary")
    magic = struct.unpack_from("<I", body)[0] if size >= 4 else 0
    if magic == _FRAME:
        try:
            body = zstandard.ZstdDecompressor().decompress(body)
        except zstandard.ZstdError as e:
            raise WarcError(f"bad dictionary frame: {e}") from e
        magic = struct.unpack_from("<I", body)[0] if len(body) >= 4 else 0
    if magic != _RAW_DICT:
        raise WarcError("no dictionary in the leading frame")
    return body, 8 + size


def frame_end(data: bytes, at: int) -> int:
    """The offset behind the Zstandard frame that starts at ``at``, from its block headers."""
    try:
        if struct.unpack_from("<I", data, at)[0] != _FRAME:
            raise WarcError("no frame where a record is expected")
        flags = data[at + 4]
        i = at + zstandard.frame_header_size(data[at : at + 18])
        while True:
            head = data[i] | data[i + 1] << 8 | data[i + 2] << 16
            i += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                break
    except (IndexError, struct.error, zstandard.ZstdError) as e:
        raise WarcError("archive ends within a frame") from e
    i += 4 if flags & 4 else 0
    if i > len(data):
        raise WarcError("archive ends within a frame")
    return i


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of a .warc.zst file, one frame decoded at a time."""
    dictionary, at = read_dictionary(data)
    kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    plain, with_dict = zstandard.ZstdDecompressor(), zstandard.ZstdDecompressor(dict_data=kept) if kept else None
    while at < len(data):
        end = frame_end(data, at)
        frame = data[at:end]
        wanted = zstandard.get_frame_parameters(frame).dict_id
        if wanted and (kept is None or wanted != kept.dict_id()):
            raise WarcError(f"a frame asks for dictionary {wanted}")
        try:
            record = (with_dict if wanted else plain).decompressobj().decompress(frame)
        except zstandard.ZstdError as e:
            raise WarcError(f"bad frame: {e}") from e
        yield parse_record(record)
        at = end


# Tables ------------------------------------------------------------------


def decide(pages: DataFrame, payload: Column, id_col: str, scratch: Scratch, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """pages with payload (binary), record_type and refers_to."""
    # The digest stands for the payload: the reader checks it for every payload stored.
    full = pages.withColumn("__digest", F.sha1(payload)).withColumn("payload", payload)
    same = (
        full.filter(F.octet_length("payload") >= min_bytes).groupBy("__digest")
        .agg(F.max(id_col).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1 AND __first IS NOT NULL").drop("__n")
    )
    # Written, so that its true size decides between a broadcast and a shuffle of the payloads.
    same = scratch.write(same, "same")
    again = F.col("__first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__first"))
    kind = F.when(again, "revisit").otherwise("response")
    return full.join(same, "__digest", "left").withColumn("record_type", kind).withColumn("refers_to", F.when(again, F.col("__first"))).drop("__digest", "__first")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", scratch: Scratch | None = None) -> DataFrame:
    """Write pages as .warc.zst files into folder (a URI that executors can write); returns path, records, bytes of each."""
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    sized = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias(html_col))
    # The share of small pages that gives about DICT_SAMPLES of them, told by a hash: the same in every run.
    small = sized.filter(F.octet_length(html_col).between(1, SAMPLE_BYTES))
    share = DICT_SAMPLES / max(1, small.count())
    place = F.xxhash64(F.lit("dictionary"), "page_id")
    rows = small.filter(place / 2.0**64 + 0.5 <= share).orderBy(place, F.col(html_col)).select(html_col).limit(4 * DICT_SAMPLES).collect()
    dictionary = train(sorted(r[0].encode() for r in rows))
    decided = decide(sized, payload, "page_id", scratch).select("page_id", "url", "payload", "record_type", "refers_to")
    # Rows of a task in a fixed order, so that a task run again writes the same files.
    dealt = decided.sortWithinPartitions("page_id", F.sha1("payload"), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        pack = compressor(dictionary)
        done: list[tuple[str, int, int]] = []
        parts: list[bytes] = []
        held = 0

        def save() -> None:
            name = f"{root}/part-{context.partitionId():06d}-{len(done):05d}.warc.zst"
            body = leading_frame(dictionary) + b"".join(parts)
            # Written aside and moved, so that two attempts of a task never mix.
            aside = f"{root}/.{context.taskAttemptId()}-{len(done)}.tmp"
            with store.open_output_stream(aside) as f:
                f.write(body)
            store.move(aside, name)
            done.append((name, len(parts), len(body)))
            parts.clear()

        for batch in batches:
            for row in zip(*[batch.column(k) for k in range(5)]):
                page_id, url, body, kind, refers_to = (x.as_py() for x in row)
                parts.append(pack.compress(build_record(page_id, url, body, refers_to, kind)))
                held += len(body)
                if held >= FILE_BYTES:
                    save()
                    held = 0
        if parts:
            save()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return scratch.write(dealt.mapInArrow(run, "path string, records long, bytes long"), "files")


RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
    ]
)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of all .warc.zst files in folder; payload=False verifies payloads but leaves them out."""
    schema = RECORD if payload else T.StructType([f for f in RECORD.fields if f.name != "payload"])
    # A given schema, so that a folder without files is an empty table.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def rows(held: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in held], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for content in batch.column(0):
                held = []
                for record in read_archive(content.as_py()):
                    held.append(record)
                    if len(held) == 256:
                        yield rows(held)
                        held = []
                if held:
                    yield rows(held)

    return files.mapInArrow(run, schema)


def query(pages: DataFrame) -> DataFrame:
    scratch = Scratch(pages.sparkSession, "warc")
    folder = scratch.path("archives")
    made = write_archives(pages, folder, scratch=scratch)
    if not made.take(1):
        empty = pages.sparkSession.createDataFrame([], RECORD)
        return empty.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return read_archives(pages.sparkSession, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
    SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM w
"""
