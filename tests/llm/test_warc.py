"""Archives: round trips of any bytes, revisits against a plain rule, archives of others."""

import gzip
import hashlib
import tempfile

import pytest
from pyspark.sql import functions as F

from wayspark.llm import warc

PAGES = "key long, uri string, payload binary, uid string, record_type string"
NASTY = b"<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n</p>" + bytes(range(256))


def expected(rows):
    """(key, payload's length, digest, type, key of the response) by the plain rule, sorted."""
    first, out = {}, []
    for key, payload in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        p = payload or b""
        known = len(p) >= 100 and p in first
        if len(p) >= 100:
            first.setdefault(p, key)
        out.append((key, len(p), hashlib.sha256(p).hexdigest(), "revisit" if known else "response", first[p] if known else None))
    return sorted(out, key=repr)


def heads(df):
    return sorted(((None if r.key is None else int(r.key), r.payload_bytes, r.payload_digest, r.record_type, None if r.original is None else int(r.original)) for r in df.collect()), key=repr)


def some_dir(name):
    return f"file://{tempfile.mkdtemp(prefix='warc-')}/{name}"


def test_round_trip_and_revisits(spark):
    big = b"x" * 3_000_000
    bodies = [b"a" * 99, b"a" * 100, None, b"", NASTY, big, "é ſ \r\n".encode() * 40]
    rows = [(i, bodies[i % len(bodies)]) for i in range(40)] + [(3, b"a" * 100), (None, NASTY), (None, b"b" * 100), (None, b"b" * 100), (7, NASTY), (7, NASTY)]
    df = spark.createDataFrame([(k, None if i % 5 == 0 else f"http://h.org/ {i}\r\nX: y", p, "u", "t") for i, (k, p) in enumerate(rows)], PAGES).repartition(3)
    at = warc.write_archives(df, some_dir("a"))
    read = warc.read_archives(spark, at)
    assert heads(warc.full(read)) == expected(rows)
    # each payload of 100 bytes or more is stored once, whole
    stored = [bytes(r.payload) for r in read.where("record_type = 'response'").collect()]
    assert sorted(stored) == sorted([p or b"" for _, p in rows if len(p or b"") < 100] + list({p for _, p in rows if len(p or b"") >= 100}))
    assert not any(c in (r.uri or "") for r in read.collect() for c in " \r\n")


def test_empty_table(spark):
    at = warc.write_archives(spark.createDataFrame([], PAGES), some_dir("e"))
    assert warc.full(warc.read_archives(spark, at)).count() == 0


def test_archives_of_others(spark):
    """Plain files and files of many gzip members; records of other types go; revisits are resolved and written anew."""

    def record(kind, uid, body, more=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{uid}>\r\nWARC-Target-URI: u{uid}\r\nWARC-Page-Key: {uid}\r\n{more}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    one = [record("warcinfo", 1, b"software: x"), record("response", 5, http + b"p" * 200, "Content-Type: application/http\r\n"), record("resource", 6, NASTY)]
    two = [record("revisit", 2, http, "WARC-Refers-To: <5>\r\n"), record("response", 9, http + NASTY, "Content-Type: application/http\r\n"), record("request", 7, b"GET /")]
    top = tempfile.mkdtemp(prefix="warc-")
    open(f"{top}/part-0.warc", "wb").write(b"".join(one))
    open(f"{top}/part-1.warc.gz", "wb").write(b"".join(gzip.compress(r) for r in two))
    at = f"file://{top}"
    found = {r.key: (r.record_type, r.original, r.payload_bytes) for r in warc.full(warc.read_archives(spark, at)).collect()}
    assert found == {"5": ("response", None, 200), "6": ("resource", None, len(NASTY)), "2": ("revisit", "5", 200), "9": ("response", None, len(NASTY))}
    anew = warc.full(warc.read_archives(spark, warc.deduplicate(spark, at, some_dir("n"))))
    assert heads(anew) == expected([(5, b"p" * 200), (6, NASTY), (2, b"p" * 200), (9, NASTY)])
    # a revisit whose response is missing can't be made whole
    open(f"{top}/part-2.warc", "wb").write(record("revisit", 3, b"", "WARC-Refers-To: <404>\r\n"))
    assert warc.full(warc.read_archives(spark, at)).where("key = 3 and payload_bytes is null").count() == 1
    with pytest.raises(Exception, match="no response"):
        warc.deduplicate(spark, at, some_dir("x"))
    open(f"{top}/part-3.warc", "wb").write(one[1][:-50])
    with pytest.raises(Exception, match="cut off"):
        warc.read_archives(spark, at).select(F.count("*")).collect()
