"""WARC (operator 3): a converter of legacy ARC archives.

* ``write_arc`` makes ARC archives (version 1 or 2) of rows.  ``read_arc`` parses any: it takes the
  version from the archive's own version block, reads header lines from both ends (so blanks in a url
  or a content type do no harm), takes each body by its declared length, and splits HTTP heads at the
  first blank line, with or without carriage returns.  Archives may be gzipped, a member a record.
* ``arc_to_warc`` synthesises WARC records: record id (of the archive's digest and the record's place),
  WARC-Date (short ARC dates are filled up), type and digests.  A version block becomes ``warcinfo``,
  an HTTP message ``response`` or ``revisit``, a name lookup ``response``, anything else ``resource``.
* Of HTTP records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest page
  id (without ids: the earliest date, then url) is the response; the others revisit it, by the standard
  ``WARC-Refers-To`` fields.  Only records whose digest may be shared are shuffled.
* ``write_warc`` stores records with Spark's text writer, so files appear by its commit protocol on any
  store; every record is a gzip member of its own, and files are bounded by bytes.  ``read_warc`` reads
  them back by declared lengths, member by member.

Edge cases: a null html is an empty payload; null urls become ``urn:x-page:<id>``, and blanks, control
characters and stray bytes in urls are percent-encoded; null page_ids order last and read back as null;
repeated rows with the smallest page id are all responses; payloads may hold anything, header lines
and record separators included.  Records that can't be read go to ``bad_records`` with the reason and
the archive is read on behind them; a null archive holds nothing.  Other columns don't enter an archive.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_mask, mask_of, scratch, stage

MIN_REVISIT = 100
ARC_RECORDS = 256
ARC_BYTES = 4 << 20
CHUNK_BYTES = 2 << 20  # compressed; a row of the writer
FILE_CHUNKS = 16
MEMBER_BYTES = 8 << 20  # a longer record takes several gzip members
#: The header line of each ARC version, and the widths of ARC dates.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
_HEADER = {1: re.compile(r"(.+) (\S+) (\d{4,14}) (.*) (\d+)"), 2: re.compile(r"(.+) (\S+) (\d{4,14}) (.*) (\S+) (\S+) (\S+) (\d+) (\S+) (\d+)")}
_FILEDESC = re.compile(r"filedesc:")
_BLANK = re.compile(rb"\r?\n\r?\n")
_PAGE = re.compile(rb"^X-Page-Id: (-?\d+)\r?$", re.M)
_AWAY = re.compile("[\x00-\x20\x7f\ud800-\udfff]")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(url: str) -> str:
    return _AWAY.sub(lambda m: f"%{ord(m[0]) & 0xFF:02X}", url)


def _url(url, page_id) -> str:
    return _clean(url) if url else f"urn:x-page:{'' if page_id is None else page_id}"


def arc_record(version: int, url: str, date: str, body: bytes, name: str = "-", offset: int = 0, kind: str = "text/html", code: int = 200, ip: str = "0.0.0.0") -> bytes:
    if version == 1:
        head = [url, ip, date, kind, str(len(body))]
    else:
        head = [url, ip, date, kind, str(code), hashlib.md5(body).hexdigest(), "-", str(offset), name, str(len(body))]
    return " ".join(head).encode() + b"\n" + body + b"\n"


def arc_bytes(version: int, records, name: str, date: str) -> bytes:
    """An archive: the version block, then (url, date, body) records."""
    about = f"{version} 0 touchline\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    out = [arc_record(version, f"filedesc://{name}", date, about, name, 0, "text/plain")]
    at = len(out[0])
    for url, when, body in records:
        out.append(arc_record(version, url, when, body, name, at))
        at += len(out[-1])
    return b"".join(out)


def parse_arc(data: bytes):
    """Dicts of an archive's records: the header's fields, ``at``, ``body``, ``version`` and ``error``; of
    a record that can't be read, only ``at`` and ``error``.  The version block comes as a record too."""
    at, version, lost = 0, None, False
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        line = data[at:stop].decode("utf-8", "surrogateescape").rstrip("\r")
        about = bool(_FILEDESC.match(line))
        fit = next((m for v in ((1, 2) if about else (version,) if version else ()) if (m := _HEADER[v].fullmatch(line))), None)
        if fit is None:
            if not lost:  # one error for a run of lines that are no headers
                yield {"at": at, "error": "no version block" if version is None else "a header line doesn't fit the archive's version"}
            at, lost = stop + 1, True
            continue
        length = int(fit[fit.re.groups])
        body = data[stop + 1 : stop + 1 + length]
        if len(body) != length:
            yield {"at": at, "error": "the archive ends inside a record"}
            return
        lost = False
        if about:
            said = body.split(b" ", 1)[0]
            version = int(said) if said.isdigit() and int(said) in ARC_FIELDS else None
            if version is None:
                yield {"at": at, "error": "an unknown ARC version"}
                at = stop + 1 + length
                continue
            fit = _HEADER[version].fullmatch(line) or fit
        yield {**dict(zip(ARC_FIELDS[2 if fit.re is _HEADER[2] else 1], fit.groups())), "at": at, "body": body, "version": version, "about": about, "error": None}
        at = stop + 1 + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload) of an HTTP message."""
    end = _BLANK.search(block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def warc_date(date: str) -> str | None:
    """A WARC-Date of an ARC date, which may leave out what is small; None if it is no date."""
    full = date + "00000101000000"[len(date) :]
    when = f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"
    try:
        return when if len(date) % 2 == 0 and pd.Timestamp(when) else None
    except ValueError:
        return None


def _http(page_id, payload: bytes) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload


def write_arc(pages: DataFrame, version: int | None = None, date: str = "20240101000000") -> DataFrame:
    """(archive binary): ARC archives of pages (page_id, url, html), at most ``ARC_RECORDS`` records or
    ``ARC_BYTES`` and one record each; versions by turns if none is named."""

    def make(batches):
        made, rows, size = 0, [], 0
        for pdf in batches:
            for page, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                rows.append((_url(url, page), date, _http(page, (html or "").encode("utf-8", "surrogatepass"))))
                size += len(rows[-1][2])
                if len(rows) == ARC_RECORDS or size >= ARC_BYTES:
                    yield pd.DataFrame({"archive": [arc_bytes(version or 1 + made % 2, rows, f"part-{made}.arc", date)]})
                    made, rows, size = made + 1, [], 0
        if rows:
            yield pd.DataFrame({"archive": [arc_bytes(version or 1 + made % 2, rows, f"part-{made}.arc", date)]})

    text = F.col("page_id").cast("string").alias("page_id")  # pandas would round long ids beside nulls
    return pages.select(text, "url", "html").mapInPandas(make, "archive binary")


RECORD = "archive string, at long, kind string, page_id long, url string, ip string, date string, content_type string, block binary, payload_bytes long, payload_digest string, error string"


def _records(archive: bytes):
    """The rows of ``read_arc`` of one archive."""
    data = gzip.decompress(archive) if archive[:2] == b"\x1f\x8b" else archive
    name = hashlib.sha256(data).hexdigest()
    none = (None,) * 9
    for r in parse_arc(data):
        when = r["error"] or warc_date(r["Archive-date"])
        if r["error"] or not when:
            yield (name, r["at"], *none, r["error"] or "no date")
            continue
        url, kind, block, page = _clean(r["URL"]), r["Content-type"], r["body"], None
        if r["about"]:
            what, payload = "about", block
        elif block.startswith(b"HTTP/"):
            what = "http"
            head, payload = split_http(block)
            own = _PAGE.search(head)
            page = int(own[1]) if own else None
        else:
            what, payload = "dns" if url.startswith("dns:") or kind == "text/dns" else "other", block
        yield name, r["at"], what, page, url, r["IP-address"], when, kind, block, len(payload), hashlib.sha256(payload).hexdigest(), None


def _frame(rows: list, schema: str, whole: tuple) -> pd.DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]
    out = pd.DataFrame(rows, columns=columns, dtype=object)
    return out.astype({c: "Int64" for c in whole})


def read_arc(archives: DataFrame) -> DataFrame:
    """One row for each ARC record; ``kind`` is about, http, dns or other, ``error`` null if it was read."""

    def parse(batches):
        for pdf in batches:
            for data in pdf["archive"]:
                if data is not None:
                    yield _frame(list(_records(bytes(data))), RECORD, ("at", "page_id", "payload_bytes"))

    return archives.select("archive").mapInPandas(parse, RECORD)


def bad_records(archives: DataFrame) -> DataFrame:
    """(archive, at, error): what could not be read, by the archive's SHA-256 and the byte where it starts."""
    return read_arc(archives).where("error is not null").select("archive", "at", "error")


def record_id(archive: str, at) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{archive}:{at}'.encode()).hexdigest()[:32])}>"


def arc_to_warc(archives: DataFrame) -> DataFrame:
    """(record binary): a WARC record for each ARC record that could be read, with its end.

    The first of equal payloads comes from a minimum by digest, over digests alone; only records whose
    digest may be shared meet it by an equi-join, which AQE splits where one payload is a large share."""
    records = read_arc(archives).where("error is null")
    place = F.struct(F.col("page_id").isNull().alias("o"), F.col("page_id").alias("p"), "date", "url", "archive", "at")  # null ids last
    able = records.where((F.col("kind") == "http") & (F.col("payload_bytes") >= MIN_REVISIT))
    firsts = able.groupBy(F.col("payload_digest").alias("_digest")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stage(firsts.where("n > 1").select("_digest", "first.*").toDF("_digest", "f_null", "f_page", "f_date", "f_url", "f_archive", "f_at").drop("f_null"), "warc-first")
    mask = stage(mask_of(firsts, "_digest"), "warc-mask")
    shared = in_mask(records, mask, "payload_digest").join(firsts, F.col("payload_digest") == F.col("_digest"), "left").drop("_digest")
    joined = shared.unionByName(in_mask(records, mask, "payload_digest", outside=True), allowMissingColumns=True)
    fields = ["archive", "at", "kind", "page_id", "url", "ip", "date", "content_type", "block", "payload_bytes", "payload_digest", "f_page", "f_date", "f_url", "f_archive", "f_at"]

    def make(batches):
        for pdf in batches:
            out = []
            for archive, at, kind, page, url, ip, date, media, block, size, digest, f_page, f_date, f_url, f_archive, f_at in zip(*(pdf[c].tolist() for c in fields)):
                block, what, target = bytes(block), "response", [("WARC-Target-URI", url), ("WARC-IP-Address", ip)]
                media = {"http": "application/http; msgtype=response", "dns": "text/dns"}.get(kind, media or "application/octet-stream")
                if kind == "about":
                    what, media, target = "warcinfo", "application/warc-fields", [("WARC-Filename", url.removeprefix("filedesc://"))]
                    version = block.split(b"\n", 1)[0].decode("ascii", "replace").strip()
                    block = f"software: touchline\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC {version}\r\n".encode()
                elif kind == "other":
                    what = "resource"
                elif kind == "http" and size >= MIN_REVISIT and f_archive is not None:
                    own = (page, date, url, archive, at) if page is None else page
                    if own != ((f_page, f_date, f_url, f_archive, f_at) if page is None else f_page):
                        what, block = "revisit", split_http(block)[0]
                        target += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(f_archive, f_at)), ("WARC-Refers-To-Target-URI", f_url), ("WARC-Refers-To-Date", f_date)]
                if kind != "about":
                    target.append(("WARC-Payload-Digest", f"sha256:{digest}"))
                lines = [("WARC-Type", what), ("WARC-Record-ID", record_id(archive, at)), ("WARC-Date", date), *target, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", media), ("Content-Length", str(len(block)))]
                out.append("".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in lines), "\r\n"]).encode("utf-8", "replace") + block + b"\r\n\r\n")
            yield pd.DataFrame({"record": out})

    text = ("at", "page_id", "f_page", "f_at")  # pandas would round long numbers beside nulls
    return joined.select(*[F.col(c).cast("string").alias(c) if c in text else c for c in fields]).mapInPandas(make, "record binary")


def member(record: bytes) -> bytes:
    """A gzip member of its own; of a very long record several, which read as one."""
    return b"".join(gzip.compress(record[i : i + MEMBER_BYTES], 6, mtime=0) for i in range(0, len(record), MEMBER_BYTES))


def write_warc(records: DataFrame, path: str) -> str:
    """Store records as gzipped WARC files under ``path``, a member a record.

    Tasks join members to chunks of ``CHUNK_BYTES`` and the writer puts ``FILE_CHUNKS`` of them into a
    file.  A member ends in the top byte of its length, which is zero below 16 MiB; the writer's line
    separator is that byte, so nothing stands between members."""

    def chunks(batches):
        held, size = [], 0
        for pdf in batches:
            for record in pdf["record"]:
                held.append(member(bytes(record)))
                size += len(held[-1])
                if size >= CHUNK_BYTES:
                    yield pd.DataFrame({"chunk": [b"".join(held)[:-1]]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"chunk": [b"".join(held)[:-1]]})

    rows = records.mapInPandas(chunks, "chunk binary").select(F.col("chunk").cast("string").alias("value"))
    rows.write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_CHUNKS).text(path)
    return path


def members(data: bytes):
    """What each gzip member holds, one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("a file ends inside a gzip member")
            piece = view[at : at + 65536]
            out.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        yield b"".join(out)


def parse_warc(data: bytes):
    """(headers, block) of each record of a gzipped file, by declared lengths."""
    left = b""
    for part in members(data):
        left = left + part if left else part
        stop = left.find(b"\r\n\r\n")
        if stop < 0:
            continue
        first, *lines = left[:stop].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record where one should start")
        head = dict(x.split(": ", 1) for x in lines)
        length = int(head["Content-Length"])
        if len(left) < stop + 8 + length:
            continue  # the record goes on in the next member
        block = left[stop + 4 : stop + 4 + length]
        if left[stop + 4 + length :] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        left = b""
        yield head, block
    if left:
        raise ValueError("a file ends inside a record")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, url string, date string, record_id string, to_record string"


def read_warc(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, date, record_id of stored records.

    Digests of blocks, and of payloads where they are held, are computed anew and compared.  What a
    revisit lacks, its payload's length and its response's page, comes from the record that it refers to."""

    def parse(batches):
        for pdf in batches:
            for data in pdf["content"]:
                out = []
                for head, block in parse_warc(bytes(data)):
                    kind, digest = head["WARC-Type"], head.get("WARC-Payload-Digest", "sha256:").removeprefix("sha256:")
                    if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
                        raise ValueError("a block differs from its digest")
                    http, payload = split_http(block) if block.startswith(b"HTTP/") else (b"", block)
                    if kind in ("response", "resource") and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload differs from its digest")
                    own = _PAGE.search(http)
                    size = None if kind == "revisit" else len(payload)
                    out.append((int(own[1]) if own else None, size, digest or None, kind, head.get("WARC-Target-URI"), head["WARC-Date"], head["WARC-Record-ID"], head.get("WARC-Refers-To")))
                yield _frame(out, READ, ("page_id", "payload_bytes"))

    files = spark.read.format("binaryFile").load(path).select("content")
    read = stage(files.mapInPandas(parse, READ), "warc-read")
    asked = read.where("to_record is not null").select("to_record").distinct()
    told = read.select(F.col("record_id").alias("to_record"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes")).join(asked, "to_record", "left_semi").distinct()
    again = read.where("to_record is not null").join(told, "to_record", "left")
    columns = ["page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("_page").alias("refers_to"), "url", "date", "record_id"]
    plain = read.where("to_record is null").withColumns({"_page": F.lit(None).cast("long"), "_bytes": F.lit(None).cast("long")})
    return plain.select(*columns).union(again.select(*columns))


def convert(archives: DataFrame) -> DataFrame:
    """ARC archives to WARC files in the shared folder, read back."""
    spark = archives.sparkSession
    return read_warc(spark, write_warc(arc_to_warc(archives), scratch(spark, "warc")))
