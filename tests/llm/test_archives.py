"""The archive converter: round trips of pages, archives as old crawlers wrote them, files as others read them."""

import gzip

import pytest

from touchline.llm import archives
from touchline.llm.common import stage


def pages_of(read):
    return read.where("record_type <> 'warcinfo'").collect()


def test_warc(spark):
    import hashlib

    rows = [(1, "http://a", "x" * 200), (2, "http://b c", "x" * 200), (3, None, None), (4, "", ""), (5, "http://d", "tiny"), (6, "http://d", "tiny"), (None, "http://e", "x" * 200), (7, "http://f", "WARC/1.1\r\n\r\nX-Page-Id: 9\r\n\r\n" * 9 + "é"), (8, "http://g", "L" * 300000), (2**62 + 1, "http://h", "big id"), (9, "http://i", "m" * 150), (9, "http://j", "m" * 150), (10, "http://i", "m" * 150)]
    pages = spark.createDataFrame([(*r, "clash", "k", 0) for r in rows], "page_id long, url string, html string, record string, kind string, at int")
    first = {2: 1, None: 1, 10: 9}
    for version in (1, 2, None):
        got = pages_of(archives.convert(stage(archives.write_arc(pages, version), "t")))
        by = {r["page_id"]: r for r in got}
        assert len(got) == len(rows)
        for i, _, h in rows:
            raw = (h or "").encode()
            assert by[i]["payload_bytes"] == len(raw) and by[i]["payload_digest"] == hashlib.sha256(raw).hexdigest()
        assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == sorted((str(i), "revisit" if i in first else "response", first.get(i)) for i, _, _ in rows)
        assert len({r["record_id"] for r in got}) == len(rows)
    assert archives.convert(stage(archives.write_arc(pages.limit(0)), "t")).count() == 0
    raw = archives.arc_bytes(2, [("http://x", "20240102030405", b"a\n\nb")], "n", "20240101000000")
    about, r = archives.parse_arc(raw)
    assert about["about"] and r["body"] == b"a\n\nb" and r["Result-code"] == "200" and raw[int(r["Offset"]) :].startswith(b"http://x ")


#: Two archives as old crawlers wrote them: heads with bare line feeds, blanks in a url and a content
#: type, a name lookup, a file transfer, short dates, a line that is no header, a cut end.
_OLD = [
    (1, b"1 1 InternetArchive\nURL IP-address Archive-date Content-type Archive-length\n<xml/>\n", [
        (b"http://a.org/x y.html 10.0.0.1 20010203040506 text/html; charset=iso-8859-1", b"HTTP/1.0 200 OK\nServer: old\n\n" + b"p" * 120),
        (b"dns:a.org 10.0.0.2 20010203040507 text/dns", b"20010203040507\na.org. 300 IN A 10.0.0.1\n"),
        (b"ftp://a.org/f.bin 10.0.0.3 200102030405 application/octet-stream", b"\x00\xff\n\nraw"),
        (b"http://a.org/b\xe9 10.0.0.1 20010203 text/plain", b"HTTP/1.1 404 Not Found\r\nA: b\r\n\r\nnone\n\nhere"),
    ]),
    (2, b"2 0 crawler\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n", [
        (b"http://b.org/ 10.1.0.1 20020203040506 text/html 200 abc - 300 f.arc", b"HTTP/1.0 200 OK\r\nServer: new\r\n\r\n" + b"p" * 120),
        (b"http://b.org/empty 10.1.0.1 20020203040599 text/html 204 - - 900 f.arc", b"HTTP/1.0 204 No Content\r\n\r\n"),
        (b"http://b.org/headless 10.1.0.1 20020203040506 text/html 200 - - 901 f.arc", b"HTTP/1.0 200 OK\r\nServer: x"),
    ]),
]


def old_archive(version, about, records, zipped):
    tail = b" 0 - - 0 f.arc" if version == 2 else b""
    whole = [b"filedesc://old.arc 0.0.0.0 2001 text/plain" + tail + b" %d\n" % len(about) + about] + [head + b" %d\n" % len(body) + body + b"\n" for head, body in records]
    return b"".join(gzip.compress(w) for w in whole) if zipped else b"\n".join(whole)


def test_old_archives(spark):
    import hashlib

    blobs = [old_archive(*_OLD[0], True), old_archive(*_OLD[1], False), b"junk\n", b"", old_archive(*_OLD[0][:2], [], False) + b"no header here\nnor here\nhttp://c.org/ 1.1.1.1 20010101 text/html 5\nabcdehttp://d.org/ 1.1.1.1 20010101 text/html 500\ncut"]
    arcs = spark.createDataFrame([(b,) for b in blobs] + [(None,)], "archive binary")
    got = archives.convert(arcs).collect()
    by = {r["url"]: r for r in got if r["url"]}
    assert sum(r["record_type"] == "warcinfo" for r in got) == 3
    assert {u: r["record_type"] for u, r in by.items()} == {
        "http://a.org/x%20y.html": "response", "dns:a.org": "response", "ftp://a.org/f.bin": "resource", "http://a.org/b%E9": "response",
        "http://b.org/": "revisit", "http://b.org/headless": "response", "http://c.org/": "resource"}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for url, payload in (("http://a.org/x%20y.html", b"p" * 120), ("http://b.org/", b"p" * 120), ("dns:a.org", _OLD[0][2][1][1]), ("ftp://a.org/f.bin", b"\x00\xff\n\nraw"), ("http://a.org/b%E9", b"none\n\nhere"), ("http://b.org/headless", b"")):
        assert (by[url]["payload_bytes"], by[url]["payload_digest"]) == (len(payload), sha(payload))
    assert by["ftp://a.org/f.bin"]["date"] == "2001-02-03T04:05:00Z" and by["http://a.org/b%E9"]["date"] == "2001-02-03T00:00:00Z"
    bad = sorted(r["error"] for r in archives.bad_records(arcs).collect())
    assert bad == sorted(["no version block", "no date", "a header line doesn't fit the archive's version", "the archive ends inside a record"])
    # what other readers see: each record a member, a revisit that names its response
    path = archives.write_warc(archives.arc_to_warc(arcs), stage(arcs, "z").inputFiles()[0].rsplit("/", 1)[0] + "-w")
    files = [bytes(b["content"]) for b in spark.read.format("binaryFile").load(path).collect()]
    parts = [m for f in files for m in archives.members(f)]
    assert len(parts) == len(got) and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in parts)
    assert b"".join(gzip.decompress(f) for f in files) == b"".join(parts)
    heads = [h for f in files for h, _ in archives.parse_warc(f)]
    (again,) = [h for h in heads if h["WARC-Type"] == "revisit"]
    (told,) = [h for h in heads if h["WARC-Record-ID"] == again["WARC-Refers-To"]]
    assert told["WARC-Target-URI"] == again["WARC-Refers-To-Target-URI"] == "http://a.org/x%20y.html" and told["WARC-Date"] == again["WARC-Refers-To-Date"]


def test_warc_files_are_bounded_by_bytes(spark, monkeypatch):
    """Long records take several members, chunks and files; all come back."""
    import os

    monkeypatch.setattr(archives, "CHUNK_BYTES", 20000)
    monkeypatch.setattr(archives, "MEMBER_BYTES", 1 << 16)
    records = [b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n" for b in (os.urandom(n) for n in [300000, 0, 70000] + [900] * 900)]
    path = stage(spark.range(1), "z").inputFiles()[0].rsplit("/", 1)[0] + "-b"
    archives.write_warc(spark.createDataFrame([(r,) for r in records], "record binary").coalesce(1), path)
    files = [bytes(b["content"]) for b in spark.read.format("binaryFile").load(path).collect()]
    assert len(files) > 1 and max(map(len, files)) < archives.FILE_CHUNKS * 20000 + 400000
    assert sorted(b for f in files for _, b in archives.parse_warc(f)) == sorted(r.partition(b"\r\n\r\n")[2][:-4] for r in records)
    with pytest.raises(ValueError):
        list(archives.parse_warc(files[0][:-3]))
