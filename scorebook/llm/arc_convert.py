"""Operator 8, converter of legacy ARC archives to WARC.

An ARC file opens with a version block that declares the layout of its header lines:

    version 1: URL IP date type length
    version 2: URL IP date type result checksum location offset file length

``parse_arc`` walks a file by header line and declared length (payload bytes are never
searched for marks).  Each record becomes a WARC record with a name-based record id, an ISO
timestamp from the 14 digits of the ARC date, a type and digests: of records with equal
payloads the one with the smallest key is the response and the others revisit it, unless the
payload is shorter than ``revisit_from`` bytes.  The archives are written with Spark's text
sink (one gzip file a partition, records end in a blank line as the formats ask) and read
with its binary reader, so any store that Spark reads will do.  A task streams its file record by
record; the text of a page is held once.

Cases: a null payload is empty; a null or blank URL becomes ``-``; white space and line breaks
in URLs are percent-encoded; a missing or malformed date becomes the epoch; pages with equal
rows are records of their own under their own keys; an empty table gives an empty result;
a file that breaks off inside a record raises.  A record without a key (null key column) is
named by its URL and date and comes back with a null key; rows with equal keys are all written.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook._ship import ship
from scorebook.llm.common import fresh_path, staged

ship(__name__)

RECORDS = ("key string, url string, ip string, date string, media string, version int, "
           "payload binary, bytes long, digest string")
WARC_ROWS = ("record_id string, record_type string, key string, url string, date string, refers_to_id string, "
             "payload_bytes long, payload_digest string, intact boolean")
EPOCH = "19700101000000"
HOST_IP = "0.0.0.0"
STAMP = "20200101000000"


class Stream:
    """Bytes of one gzip or plain file, decompressed as they are asked for."""

    def __init__(self, body: bytes):
        self.body, self.at, self.buf, self.pos = memoryview(body), 0, bytearray(), 0
        self.gz = zlib.decompressobj(31) if body[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.body):
            return False
        part = bytes(self.body[self.at:self.at + 65536])
        self.at += len(part)
        if self.pos > 1 << 20:
            del self.buf[:self.pos]
            self.pos = 0
        if self.gz is None:
            self.buf += part
            return True
        while part:
            self.buf += self.gz.decompress(part)
            part = self.gz.unused_data
            if self.gz.eof and part:        # the next member of a file of several
                self.gz = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        """The next line without its line feed; None at the end."""
        while (end := self.buf.find(b"\n", self.pos)) < 0:
            if not self._more():
                rest = bytes(self.buf[self.pos:])
                self.pos = len(self.buf)
                return rest or None
        out = bytes(self.buf[self.pos:end])
        self.pos = end + 1
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) - self.pos < n:
            if not self._more():
                raise ValueError(f"the archive breaks off: {n} bytes declared, {len(self.buf) - self.pos} there")
        out = bytes(self.buf[self.pos:self.pos + n])
        self.pos += n
        return out


def parse_arc(body: bytes) -> Iterator[dict]:
    """Records of one ARC file: url, ip, date, media, version, http headers, payload."""
    stream, version = Stream(body), None
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        fields = line.rstrip(b"\r").decode("utf-8", "replace").split(" ")
        if version is None or fields[0].startswith("filedesc://"):
            # the version block has five fields in files of either version
            block = stream.take(int(fields[-1])).split(b"\n")
            version = int(block[0].split(b" ")[0])
            if version not in (1, 2):
                raise ValueError(f"unknown ARC version {version}")
            continue
        want = 5 if version == 1 else 10
        if len(fields) != want:
            raise ValueError(f"version {version} header line of {len(fields)} fields")
        block = stream.take(int(fields[-1]))
        head, mark, payload = block.partition(b"\r\n\r\n")
        if not (mark and head.startswith(b"HTTP/")):
            head, payload = b"", block
        yield {"url": fields[0], "ip": fields[1], "date": fields[2], "media": fields[3],
               "version": version, "head": head, "payload": payload}


def http_field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"\r\n" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head, re.I)
    return found[1].decode("utf-8", "replace") if found else None


def iso(date: str) -> str:
    """ARC's 14 digits (12 or 8 are padded) as a WARC timestamp; anything else: the epoch."""
    d = (date + "000000")[:14] if re.fullmatch(r"[0-9]{8}([0-9]{4}|[0-9]{6})?", date) else EPOCH
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(key: str, date: str) -> str:
    """The same record has the same id in every run."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{date} {key}')}"


def _slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in small pieces, so that few payloads are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _read_arc(batches: Iterator) -> Iterator:
    import pyarrow as pa
    names = ["key", "url", "ip", "date", "media", "version", "payload", "bytes", "digest"]
    schema = pa.schema([("key", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()),
                        ("media", pa.string()), ("version", pa.int32()), ("payload", pa.binary()),
                        ("bytes", pa.int64()), ("digest", pa.string())])
    for batch in batches:
        for body in batch.column("content"):
            rows, held = [], 0
            for r in parse_arc(body.as_py()):
                key = http_field(r["head"], b"X-Archive-Key") or f"{r['url']} {r['date']}"
                rows.append(dict(zip(names, (key, r["url"], r["ip"], r["date"], r["media"], r["version"],
                                             r["payload"], len(r["payload"]),
                                             hashlib.sha256(r["payload"]).hexdigest()))))
                held += len(r["payload"])
                if held > 4 << 20 or len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def write_arc(pages: DataFrame, path: str, key: Column, url: Column, payload: Column, version: int) -> None:
    """Write rows as gzipped ARC files of one version, one file a partition.

    The key travels as a header field of the stored HTTP response.
    """
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    site = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), " ", "%20"),
                                             "\n", "%0A"), "[\\x00-\\x1f\\x7f]", "%09")
    slim = pages.select(key.cast("string").alias("key"), site.alias("url"), body.alias("body"))
    heading = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else (
        "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length")
    block = f"{version} 0 scorebook\n{heading}\n".encode()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        opened, offset = False, 0
        for batch in _slices(batches):
            out = []
            if not opened:
                opened = True
                first = b"filedesc://scorebook.arc %s %s text/plain %d\n%s" % (
                    HOST_IP.encode(), STAMP.encode(), len(block), block)
                offset += len(first) + 1
                out.append(first)
            for k, u, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                named = "" if k is None else f"X-Archive-Key: {k}\r\n"
                head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{named}"
                        f"Content-Length: {len(b)}\r\n\r\n").encode()
                n = len(head) + len(b)
                start = f"{u or '-'} {HOST_IP} {STAMP} text/html "
                if version == 2:
                    start += f"200 {zlib.crc32(b):08x} - {offset} scorebook.arc "
                record = start.encode() + b"%d\n" % n + head + b
                offset += len(record) + 1
                out.append(record)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    _write_records(slim.mapInArrow(run, "record binary"), path)


def _write_records(records: DataFrame, path: str) -> None:
    """Records as files: the sink adds the line feed that ends each record."""
    records.select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").text(path)


def read_arc(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of ARC files of either version, plain or gzipped."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("content").mapInArrow(_read_arc, RECORDS)


def _warc_records(batches: Iterator) -> Iterator:
    """Rows with the verdict -> bytes of WARC records (without the last line feed)."""
    import pyarrow as pa
    for batch in _slices(batches):
        out = []
        for r in batch.to_pylist():
            when, rid = iso(r["date"]), record_id(r["key"], r["date"])
            kind = "revisit" if r["first_key"] is not None else "response"
            head = (f"HTTP/1.1 200 OK\r\nContent-Type: {r['media']}\r\nX-Archive-Key: {r['key']}\r\n"
                    f"Content-Length: {r['bytes']}\r\n\r\n").encode()
            body = head if kind == "revisit" else head + r["payload"]
            fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", when),
                      ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]),
                      ("WARC-Payload-Digest", f"sha256:{r['digest']}"),
                      ("WARC-Block-Digest", f"sha256:{hashlib.sha256(body).hexdigest()}")]
            if kind == "revisit":
                fields += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
                           ("WARC-Refers-To", f"<{record_id(r['first_key'], r['first_date'])}>")]
            fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
            out.append(b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
                       + body + b"\r\n\r")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def arc_to_warc(spark: SparkSession, arc_paths: list[str], warc_path: str, revisit_from: int = 100) -> None:
    """Convert ARC files to gzipped WARC files.

    Keys compare as numbers where both are numbers, else as text after them.  The first key of
    each payload digest comes from one aggregation of digests; payloads take part in one join.
    """
    def turn() -> Column:
        return F.struct(F.coalesce(F.col("key").try_cast("decimal(38,0)"),
                                   F.lit("9" * 38).cast("decimal(38,0)")).alias("n"), "key", "date")
    firsts = read_arc(spark, *arc_paths).filter(F.col("bytes") >= revisit_from).select(
        F.col("digest").alias("same"), turn().alias("turn")).groupBy("same").agg(
        F.min("turn").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = staged(firsts, "first-payloads")      # a frequent payload's rows can then be split
    records = read_arc(spark, *arc_paths)
    judged = records.join(firsts, (F.col("digest") == F.col("same")) & (F.col("bytes") >= revisit_from), "left")
    later = F.col("first.key") != F.col("key")
    rows = judged.select(
        "key", "url", "ip", "date", "media", "bytes", "digest",
        F.when(~F.coalesce(later, F.lit(False)), F.col("payload")).alias("payload"),
        F.when(later, F.col("first.key")).alias("first_key"),
        F.when(later, F.col("first.date")).alias("first_date"))
    _write_records(rows.mapInArrow(_warc_records, "record binary"), warc_path)


def parse_warc(body: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of one WARC file."""
    stream = Stream(body)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8").rstrip("\r").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.take(int(fields["content-length"]))


def _read_warc(batches: Iterator) -> Iterator:
    import pyarrow as pa
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("key", pa.string()),
                        ("url", pa.string()), ("date", pa.string()), ("refers_to_id", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())])
    for batch in batches:
        for body in batch.column("content"):
            rows = []
            for f, block in parse_warc(body.as_py()):
                head, _, payload = block.partition(b"\r\n\r\n")
                declared = f["warc-payload-digest"].removeprefix("sha256:")
                whole = f["warc-type"] == "response"
                digest = hashlib.sha256(payload).hexdigest() if whole else declared
                size = len(payload) if whole else int(http_field(head, b"Content-Length") or 0)
                rows.append({"record_id": f["warc-record-id"].strip("<>"), "record_type": f["warc-type"],
                             "key": http_field(head, b"X-Archive-Key"), "url": f["warc-target-uri"],
                             "date": f["warc-date"], "refers_to_id": f.get("warc-refers-to", "").strip("<>") or None,
                             "payload_bytes": size, "payload_digest": digest,
                             "intact": digest == declared and hashlib.sha256(block).hexdigest()
                             == f["warc-block-digest"].removeprefix("sha256:")})
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(_read_warc, WARC_ROWS)


def convert_pages(pages: DataFrame, key_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", revisit_from: int = 100) -> DataFrame:
    """Pages -> ARC files of both versions (even digests of the key: version 1) -> WARC files -> one row a page.

    ``refers_to`` is found by the record id that a revisit names.
    """
    spark, root = pages.sparkSession, fresh_path(pages.sparkSession, "archive")
    slim = pages.select(F.col(key_col).alias("k"), F.col(url_col).alias("u"), F.col(payload_col).alias("p"))
    old = F.pmod(F.xxhash64("k"), F.lit(2)) == 0
    for version, rows in ((1, slim.filter(old)), (2, slim.filter(~old))):
        write_arc(rows, f"{root}/arc-v{version}", F.col("k"), F.col("u"), F.col("p"), version)
    arc_to_warc(spark, [f"{root}/arc-v1", f"{root}/arc-v2"], f"{root}/warc", revisit_from)
    back = read_warc(spark, f"{root}/warc")
    # a repeated page row has one record id: one row each, or its revisits would multiply
    ids = back.filter(F.col("record_type") == "response").groupBy(F.col("record_id").alias("target_id")).agg(
        F.min("key").alias("target_key"))
    wanted = back.filter(F.col("refers_to_id").isNotNull()).select("refers_to_id").distinct()
    named = wanted.join(ids, F.col("refers_to_id") == F.col("target_id")).select("target_id", "target_key")
    kind = dict(pages.dtypes)[key_col]
    out = back.join(named, F.col("refers_to_id") == F.col("target_id"), "left")
    return out.select(F.col("key").try_cast(kind).alias(key_col), "payload_bytes", "payload_digest", "record_type",
                      F.col("target_key").try_cast(kind).alias("refers_to"), "record_id", "url", "date", "intact")


def oracle_sql() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::bigint AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""
