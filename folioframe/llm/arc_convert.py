"""Legacy archive converter: ARC records to WARC records.

An ARC file starts with a version block that names its version, 1 or 2, and the
fields of its header lines. A record is a header line, then as many bytes as the line
declares. The converter reads by these lengths, so payloads may hold anything, and
synthesises what WARC asks for: record ids, W3C timestamps from 14-digit dates, record
types, block and payload digests.

Pages go through it in both versions (odd ids in version 2) and are written as
gzipped WARC files by Spark's text writer, whose line separator is the two line ends
after a record; its commit protocol makes lost executors harmless. Reading back goes
by declared lengths again.

Equal payloads: the record with the largest page_id is a response and the others are
revisits of it, which hold the stored headers but no payload. Decisions are made on
digests alone; payloads are shuffled once, by page_id and digest.

Defined results: a null page is an empty payload; a null url is written as "-"; rows
equal in page_id and payload that share the largest id are all responses; a null
page_id counts as the smallest; an empty table writes no record; other columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_rows, shared_folder

#: Header fields of an ARC line by version: fixed by the format.
FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
DATE = "20240101000000"
#: Bytes of records in a WARC file, on average.
FILE_BYTES = 64 << 20
LEAST_BYTES = 0


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- ARC


def arc_start(version: str, name: str = "pages.arc") -> bytes:
    body = f"{version} 0 folioframe\n{' '.join(FIELDS[version])}\n".encode()
    fields = ["filedesc://" + name, "0.0.0.0", DATE, "text/plain"] + (["200", "-", "-", "0", name] if version == "2" else [])
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_record(version: str, url: str, http: bytes, offset: int = 0, name: str = "pages.arc") -> bytes:
    fields = [url, "0.0.0.0", DATE, "text/html"] + (["200", digest_of(http), "-", str(offset), name] if version == "2" else [])
    return " ".join([*fields, str(len(http))]).encode("utf-8", "surrogatepass") + b"\n" + http + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record after the version block."""
    fields, at = None, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at {at} does not end")
        line = data[at:end].decode("utf-8", "surrogatepass").rstrip("\r").split(" ")
        length = int(line[-1])
        if end + 1 + length > len(data):
            raise ValueError(f"record at {at} declares {length} bytes; fewer follow")
        content = data[end + 1 : end + 1 + length]
        at = end + 1 + length
        if fields is None:
            version = content.split(b" ", 1)[0].decode()
            if version not in FIELDS:
                raise ValueError(f"ARC version {version!r}")
            fields = FIELDS[version]
            continue
        # blanks in old urls are part of the first field
        rest = len(fields) - 1
        yield dict(zip(fields, [" ".join(line[:-rest]), *line[-rest:]])), content


# ---- WARC


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    def stored(self, name: str) -> str | None:
        """A field of the HTTP headers in the block."""
        for line in self.block.partition(b"\r\n\r\n")[0].split(b"\r\n"):
            key, _, value = line.partition(b": ")
            if key.lower() == name.lower().encode():
                return value.decode()
        return None


def record_id(key: int | None) -> str:
    """A version-8 UUID that holds a 64-bit key, so that reruns and references agree."""
    k = (key or 0) & 0xFFFFFFFFFFFFFFFF
    value = (0x0F << 120) | (0x8 << 76) | ((k >> 62) << 64) | (0b10 << 62) | (k & (1 << 62) - 1) | ((key is None) << 80)
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def key_of(record: str) -> int | None:
    value = uuid.UUID(record[10:-1]).int
    if value >> 80 & 1:
        return None
    k = ((value >> 64 & 3) << 62) | (value & (1 << 62) - 1)
    return k - (1 << 64) if k >> 63 else k


def w3c(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def convert(fields: dict[str, str], content: bytes, key: int | None, refers_to: int | None = None, revisit: bool = False, payload_digest: str | None = None) -> bytes:
    """The WARC record of an ARC record, without the two line ends after it."""
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(key), "WARC-Date": w3c(fields["Archive-date"]), "WARC-Target-URI": fields["URL"]}
    if fields["IP-address"] != "0.0.0.0":
        head["WARC-IP-Address"] = fields["IP-address"]
    http, gap, payload = content.partition(b"\r\n\r\n")
    head["WARC-Payload-Digest"] = "sha1:" + (payload_digest or digest_of(payload))
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = record_id(refers_to)
        content = http + gap
    head["WARC-Block-Digest"] = "sha1:" + digest_of(content)
    head["Content-Type"] = "application/http;msgtype=response"
    head["Content-Length"] = str(len(content))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + content


def read_warc(data: bytes) -> Iterator[Record]:
    """The records of a WARC file, gzipped (by record or as a whole) or not, by declared lengths.

    Bytes are unpacked as records are asked for, so one record is held at a time.
    """
    f = gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while first := f.readline():
        if not first.startswith(b"WARC/1."):
            raise ValueError(f"no record where {first[:40]!r} stands")
        head = {}
        while line := f.readline().rstrip(b"\r\n"):
            key, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
            head[key] = value
        n = int(head["Content-Length"])
        block = f.read(n)
        if len(block) < n or f.read(4) != b"\r\n\r\n":
            raise ValueError(f"{head.get('WARC-Record-ID')} does not end after its declared length")
        yield Record(head, block)


# ---- in Spark


def http_of(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def decided(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, digest, n_bytes, winner): winner is the response that a revisit refers to, null for responses."""

    def make():
        def one(i, html):
            payload = (html or "").encode("utf-8", "surrogatepass")
            return i, digest_of(payload), len(payload)

        return lambda rows: [one(*r) for r in rows]

    rows = checkpointed(map_rows(pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")), make, "page_id long, digest string, n_bytes long"))
    largest = rows.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    named = rows.join(largest, "digest", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("largest")) & F.col("largest").isNotNull()
    return named.select("page_id", "digest", "n_bytes", F.when(other, F.col("largest")).alias("winner"))


def _archived(rows: list[tuple], version: str) -> list[str]:
    """WARC records of (page_id, url, payload or None, digest, n_bytes, winner), by way of an ARC file."""
    arc = bytearray(arc_start(version))
    for _, url, html, _, n, _ in rows:
        clean = (url or "-").replace("\r", "%0D").replace("\n", "%0A")
        arc += arc_record(version, clean, http_of(n) + (html or "").encode("utf-8", "surrogatepass"), len(arc))
    out = []
    for (key, _, _, digest, _, winner), (fields, content) in zip(rows, read_arc(bytes(arc))):
        out.append(convert(fields, content, key, winner, winner is not None, digest).decode("utf-8", "surrogatepass"))
    return out


def records(pages: DataFrame, choice: DataFrame) -> DataFrame:
    """(value): the WARC record of each page, without the two line ends after it, by what was ``decided``."""

    def make():
        def work(rows):
            out: list[tuple] = []
            for version in FIELDS:
                mine = [r for r in rows if (r[0] or 0) % 2 == int(version) - 1]
                out += [(x,) for x in _archived(mine, version)]
            return out

        return work

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    choice = choice.withColumn("sha", F.lower(F.hex(_unbase32("digest")))).distinct()
    same = rows["page_id"].eqNullSafe(choice["page_id"]) & (rows["sha"] == choice["sha"])
    # of a revisit only the headers are written, so its page stays behind
    kept = rows.join(choice, same).select(rows["page_id"], "url", F.when(F.col("winner").isNull(), F.col("html")).alias("html"), "digest", "n_bytes", "winner")
    return map_rows(kept, make, "value string")


def _unbase32(column: str):
    @F.pandas_udf("binary")
    def unpack(s):
        return s.map(base64.b32decode)

    return unpack(F.col(column))


def write(pages: DataFrame, folder: str, least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Writes pages as gzipped WARC files of ``file_bytes`` on average; Spark's writer commits whole tasks."""
    choice = checkpointed(decided(pages, least))
    mean = choice.agg(F.avg(F.when(F.col("winner").isNull(), F.col("n_bytes")).otherwise(0) + 700)).first()[0] or 1.0
    out = records(pages, choice).write.mode("overwrite").option("compression", "gzip").option("lineSep", "\r\n\r\n")
    out.option("maxRecordsPerFile", max(1, int(file_bytes / mean))).text(folder)


def read(spark, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record in a folder's files."""
    files = spark.read.format("binaryFile").load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                out = []
                for r in read_warc(data):
                    revisit = r.headers["WARC-Type"] == "revisit"
                    n = int(r.stored("Content-Length"))
                    if not revisit and (len(r.payload) != n or "sha1:" + digest_of(r.payload) != r.headers["WARC-Payload-Digest"]):
                        raise ValueError(f"payload of {r.headers['WARC-Record-ID']} is not what was stored")
                    out.append((key_of(r.headers["WARC-Record-ID"]), r.headers["WARC-Target-URI"], n, r.headers["WARC-Payload-Digest"][5:], r.headers["WARC-Type"], key_of(r.headers["WARC-Refers-To"]) if revisit else None))
                cols = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def digest(pages: DataFrame) -> DataFrame:
    """The rows of op7: archives written to the shared folder and read back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
