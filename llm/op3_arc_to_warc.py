"""Legacy archive converter: ARC files, versions 1 and 2, to WARC 1.1.

An ARC record is a header line (version 1: URL, IP, date, content type, length; version 2 has result
code, checksum, location, offset and file name before the length), that many bytes, and a line
feed. The first record of a file, ``filedesc://``, declares the version. The converter reads by declared
lengths, never by looking for line ends in bodies, and gives each record a WARC id derived from what
identifies it (URL, date, digest, row), a WARC-Date, a type and SHA-1 digests. Repeated payloads become revisits.

WARC files are gzip files of one member a record, in the folder that driver and executors share.

Edge cases: null html is an empty payload; null and odd URLs are percent-coded; repeated page ids stay records, and
null ids never serve as referred-to; payloads under ``min_revisit`` bytes are all responses; equal largest
ids (repeated rows) are all responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.workspace import materialise
from llm.files import new_folder, open_fs, part_name

MIN_REVISIT = 1000
_DATE = "20240101000000"
_FIELDS = {1: ["url", "ip", "date", "type", "length"], 2: ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"]}


@dataclass
class ArcRecord:
    fields: dict[str, str]
    body: bytes


class ArcError(ValueError):
    """The archive does not follow its own header."""


def write_arc(version: int, records: list[tuple[str, bytes]], date: str = _DATE) -> bytes:
    """An ARC file of (url, body) records."""
    names = " ".join({"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "length": "Archive-length", "status": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "file": "Filename"}[f] for f in _FIELDS[version])
    intro = f"{version} 0 made-from-rows\n{names}\n".encode()
    out = io.BytesIO()
    for url, body in [("filedesc://rows.arc", intro), *records]:
        kind = "text/plain" if url.startswith("filedesc:") else "text/html"
        v1 = url.startswith("filedesc:") or version == 1
        more = "" if v1 else f" 200 {hashlib.md5(body).hexdigest()} - {out.tell()} rows.arc"
        out.write(f"{url} 0.0.0.0 {date} {kind}{more} {len(body)}\n".encode() + body + b"\n")
    return out.getvalue()


def read_arc(f) -> Iterator[ArcRecord]:
    """Records after the file's own description, by declared lengths."""
    version = None
    while line := f.readline():
        if not line.strip(b"\r\n"):
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        names = _FIELDS[1] if version is None and len(parts) == 5 else _FIELDS[version or 2]
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ArcError(f"not a version {version or '?'} header: {line[:100]!r}")
        rec = dict(zip(names, parts, strict=True))
        body = f.read(int(rec["length"]))
        if len(body) < int(rec["length"]):
            raise ArcError("the archive ends inside a record")
        if version is None:
            if not rec["url"].startswith("filedesc:"):
                raise ArcError("the first record must be filedesc://")
            head = body.split(b" ", 1)[0]
            version = int(head) if head in (b"1", b"2") else 0
            if not version:
                raise ArcError("versions 1 and 2 are known")
            continue
        yield ArcRecord(rec, body)


def warc_date(arc_date: str) -> str:
    d = (re.sub(r"\D", "", arc_date) + "00000101000000"[len(re.sub(r"\D", "", arc_date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, row: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((url, date, digest, row)))}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(header with its blank line, payload); all payload, if there is no HTTP header."""
    if body.startswith(b"HTTP/"):
        cut = body.find(b"\r\n\r\n")
        if cut >= 0:
            return body[: cut + 4], body[cut + 4 :]
    return b"", body


def warcinfo(name: str, date: str = _DATE) -> bytes:
    """What a file's filedesc:// record becomes: the first record of the WARC file."""
    body = b"software: legacy archive converter\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(name, warc_date(date), _sha1(body), 'warcinfo')}", f"WARC-Date: {warc_date(date)}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return "\r\n".join([*lines, f"WARC-Block-Digest: {_sha1(body)}", f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def to_warc(rec: ArcRecord, row: str, refers_to: str | None, refers_url: str = "", refers_date: str = _DATE) -> bytes:
    """One WARC record, uncompressed: a revisit keeps the HTTP header alone and names the record it repeats by id, URI and date."""
    head, payload = split_http(rec.body)
    digest, date = _sha1(payload), warc_date(rec.fields["date"])
    block = head if refers_to is not None else rec.body
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(rec.fields['url'], date, digest, row)}", f"WARC-Date: {date}", f"WARC-Target-URI: {rec.fields['url']}",
        f"WARC-IP-Address: {rec.fields['ip']}", f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_sha1(block)}",
        "Content-Type: " + ("application/http; msgtype=response" if head else rec.fields["type"]), f"X-Source-Row: {row}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Row: {refers_to}"]
        lines += [f"WARC-Refers-To: {record_id(refers_url, warc_date(refers_date), digest, refers_to)}", f"WARC-Refers-To-Target-URI: {refers_url}", f"WARC-Refers-To-Date: {warc_date(refers_date)}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def read_warc(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a plain stream."""
    while line := f.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(":")
            head[k.strip().lower()] = v.strip()
        block = f.read(int(head["content-length"]))
        if f.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record does not end where its length says")
        yield head, block


def member(data: bytes) -> bytes:
    c = zlib.compressobj(3, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _coded(url: str | None) -> str:
    return quote(url or "unknown:", safe=":/?#[]@!$&'()*+,;=%~")


def _convert(folder: str):
    """(page_id, url, html, refers_to, refers_url) -> ARC bytes -> converter -> WARC files; yields their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path = None, f"{folder}/{part_name('.warc.gz')}"
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs, p = open_fs(path)
                out = fs.open_output_stream(p)
                out.write(member(warcinfo(path.rsplit("/", 1)[-1])))
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)
            for i, (page, url, html, ref, ref_url) in enumerate(rows):
                body = html.as_buffer().to_pybytes() if html.is_valid else b""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                arc = write_arc(1 + i % 2, [(_coded(url), head + body)])
                for rec in read_arc(io.BytesIO(arc)):
                    out.write(member(to_warc(rec, "" if page is None else str(page), None if ref is None else str(ref), _coded(ref_url))))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return run


_ROWS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _ROWS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for b in batches:
        for path in b.column(0).to_pylist():
            fs, p = open_fs(path)
            rows = []
            with fs.open_input_stream(p) as raw, gzip.open(raw) as f:
                for h, block in read_warc(f):
                    if h["warc-type"] == "warcinfo":
                        continue
                    digest = h["warc-payload-digest"]
                    if h["warc-block-digest"] != _sha1(block) or h["warc-type"] == "response" and _sha1(split_http(block)[1]) != digest:
                        raise ValueError("a digest does not fit its record")
                    n, ref = h["x-payload-length"], h.get("x-refers-to-row")
                    rows.append((int(h["x-source-row"]) if h["x-source-row"] else None, int(n), base64.b32decode(digest.partition(":")[2]).hex(), h["warc-type"], int(ref) if ref else None, h["warc-record-id"]))
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), types, strict=True)], names=names)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """WARC files of the pages; returns their paths, kept in the shared folder."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    slim = p.select("page_id", "url", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")).filter(F.col("n") >= min_revisit)
    # only digests that occur more than once can have revisits; written, so that the join can split a hot one
    largest = materialise(slim.groupBy("digest").agg(F.max("page_id").alias("response"), F.max_by("url", "page_id").alias("response_url"), F.count("*").alias("n")).filter("n > 1 and response is not null").select("digest", "response", "response_url"))
    j = p.withColumn("digest", F.sha1("html")).join(largest, "digest", "left")
    j = j.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("response")), F.col("response")).alias("refers_to"), "response_url")
    return materialise(j.mapInArrow(_convert(new_folder(spark, "warc")), "path string"))


def read_archives(files: DataFrame) -> DataFrame:
    n = max(1, min(files.count(), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return files.repartition(n).mapInArrow(_read, _ROWS)


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))).drop("record_id")


SQL = f"""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::BIGINT as payload_bytes, sha1(h) as payload_digest from p),
m as (select payload_digest as k, max(page_id) as top from d where payload_bytes >= {MIN_REVISIT} group by 1)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {MIN_REVISIT} and page_id <> top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {MIN_REVISIT} and page_id <> top then top end as refers_to
from d left join m on k = payload_digest"""
