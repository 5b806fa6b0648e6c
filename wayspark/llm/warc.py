"""WARC archives without repeated payloads: revisit resolution.

Records are written to a staging table and numbered once. Their headers alone, without payloads, are shuffled by
payload digest; of each digest the record of the smallest key becomes the response, and what joins it is a
revisit. The archives then hold each payload once, under fresh headers. Reading goes the other way: records are parsed
by their ``Content-Length``, and revisits joined to the responses they refer to.

Archives are written by Spark's text sink, so they go wherever Spark can write and half-written files of lost tasks never
show: CRLF is the line separator, a record is one value, and each file is compressed by gzip. A payload may hold any bytes,
record marks of other archives too.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.llm.common import shared_dir, table, written

#: Payloads under so many bytes are stored as they are: a revisit would be longer.
LEAST_BYTES = 100
#: A file holds so many records that it has about these bytes before compression, at their mean length.
FILE_BYTES = 32 << 20
#: Records of the same payload differ in nothing that a revisit needs (fixed value of the format).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
CRLF = "\r\n"
RECORDS = "record_id string, record_type string, key string, uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"


def resolve(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``records(uid, key, payload_digest, payload_bytes)`` with ``record_type`` and ``original``: the uid of the response that a revisit
    repeats, null for responses.

    Of records with equal digests, that of the smallest key (nulls last, then the smallest uid) is the response. The
    least is taken by partial sums before the shuffle, and only digests that occur twice come back.
    """
    long_ = records.where(F.col("payload_bytes") >= least_bytes)
    lead = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "uid"))
    many = long_.groupBy("payload_digest").agg(lead.alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", F.col("lead.uid").alias("first"))
    met = records.join(many, "payload_digest", "left").withColumn("again", F.coalesce((F.col("first") != F.col("uid")) & (F.col("payload_bytes") >= least_bytes), F.lit(False)))
    return met.select(*records.columns, F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("again"), F.col("first")).alias("original"))


def _safe(text: Column) -> Column:
    """A header's value: white space and control characters are percent signs' business, so they can't end the line."""
    return F.regexp_replace(text, r"[\x00-\x20\x7F]+", "%20")


def _urn(uid: Column) -> Column:
    h = F.md5(F.concat(F.lit("record:"), uid.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.substring(h, a, n),) if a == 1 else (F.lit("-"), F.substring(h, a, n)))), F.lit(">"))


def _record(date: str) -> Column:
    """A whole record but for its last CRLF, from uid, key, uri, payload, payload_bytes, payload_digest, record_type and original."""
    again = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    body = F.when(again, F.lit("")).otherwise(F.col("payload").cast("string"))
    length = F.octet_length(http) + F.octet_length(body)

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _urn(F.col("uid"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _safe(F.col("uri"))), line("WARC-Page-Key", _safe(F.col("key"))), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(again, PROFILE)), line("WARC-Refers-To", F.when(again, _urn(F.col("original")))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")), F.lit(CRLF), http, body, F.lit(CRLF),
    )


def write_archives(records: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> str:
    """Writes ``records(key, uri, payload)`` as archives under ``path``, a record each, and returns the path.

    Equal payloads of at least ``least_bytes`` are stored once. Null payloads are empty; null keys and uris leave their
    header out. Repeated rows are records of their own. Other columns are ignored. An empty table gives
    archives without records.
    """
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    staged = records.select(F.monotonically_increasing_id().alias("uid"), "key", F.col("uri").cast("string").alias("uri"), payload.alias("payload"))
    staged = written(staged.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long")), "staged", "zstd")
    heads = resolve(staged.select("uid", "key", "payload_digest", "payload_bytes"), least_bytes).select("uid", "record_type", "original")
    mean = staged.agg(F.avg(F.col("payload_bytes"))).first()[0] or 0
    typed = staged.withColumn("key", F.col("key").cast("string")).join(heads, "uid")
    typed.select(_record(date).alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 500)))).text(path)
    return path


def _parsed(content: bytes) -> Iterator[tuple]:
    """The records of one archive, plain or of any number of gzip members; memory is a record and a piece of the file."""
    view, zipped = memoryview(content), content[:2] == b"\x1f\x8b"
    at, unzip, have = 0, zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal at, unzip
        while at < len(view) or (zipped and unzip.unconsumed_tail):
            if not zipped:
                have.extend(view[at : at + (1 << 20)])
                at += 1 << 20
                return True
            raw = unzip.unconsumed_tail or view[at : at + (1 << 18)]
            at += 0 if unzip.unconsumed_tail else len(raw)
            have.extend(unzip.decompress(raw, 1 << 22))
            if unzip.eof:
                at -= len(unzip.unused_data)
                unzip = zlib.decompressobj(31)
            return True
        return False

    def until(mark: bytes) -> int:
        start = 0
        while (k := have.find(mark, start)) < 0:
            start = max(0, len(have) - len(mark) + 1)
            if not more():
                return -1
        return k

    while True:
        while have[:2] == b"\r\n" or (len(have) < 2 and more()):
            if have[:2] == b"\r\n":
                del have[:2]
        if not have.strip():
            return
        if (end := until(b"\r\n\r\n")) < 0 or not have.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in have[:end].decode("utf-8", "replace").split(CRLF)[1:])}
        del have[: end + 4]
        n = int(head["content-length"])
        while len(have) < n and more():
            pass
        if len(have) < n:
            raise ValueError("a WARC record is cut off")
        block = bytes(have[:n])
        del have[:n]
        yield head, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``, as ``RECORDS``; files without compression and of one gzip member or many are taken.

    Revisits have no payload and no length of their own (``full`` gives it). Records that are neither responses, resources nor
    revisits are left out. A record that is cut off raises an error.
    """
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("key", pa.string()), ("uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for head, block in _parsed(content.as_py()):
                    kind = head.get("warc-type", "")
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
                    digest = head.get("warc-payload-digest", "")
                    again = kind == "revisit"
                    rows.append((head.get("warc-record-id"), kind, head.get("warc-page-key"), head.get("warc-target-uri"), digest.removeprefix("sha256:") or None, head.get("warc-refers-to"), None if again else len(payload), None if again else payload))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    # one file in an Arrow batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parsed, RECORDS)


def full(records: DataFrame) -> DataFrame:
    """Headers of ``RECORDS`` with the digest and length of each record's full payload, taken from the payload itself, a revisit's from the
    response it refers to, and ``original``: that response's key. A revisit of a record that isn't there keeps its own digest and no length."""
    own = records.select("record_id", "record_type", "key", "uri", "refers_to", F.coalesce(F.sha2("payload", 256), "payload_digest").alias("payload_digest"), "payload_bytes")
    own = written(own, "heads")
    there = own.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("key").alias("original"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n"))
    met = own.where("record_type = 'revisit'").join(there, "refers_to", "left")
    cols = ["record_id", "record_type", "key", "uri", "refers_to"]
    found = met.select(*cols, F.coalesce("d", "payload_digest").alias("payload_digest"), F.col("n").alias("payload_bytes"), "original")
    return own.where("record_type <> 'revisit'").select(*cols, "payload_digest", "payload_bytes", F.lit(None).cast("string").alias("original")).unionByName(found)


def deduplicate(spark: SparkSession, path: str, to: str, least_bytes: int = LEAST_BYTES, date: str = DATE, key_type: str = "string") -> str:
    """Archives of ``path``, written by anyone, written anew under ``to`` with each payload once: their revisits are joined to the responses they
    refer to, which bring the payload, and all are resolved afresh, whatever type they had. Keys are compared as ``key_type``. Revisits
    without their response are lost by the archives themselves, so they raise an error."""
    records = written(read_archives(spark, path), "records")
    again = records.where("record_type = 'revisit'").select("key", "uri", "refers_to")
    first = records.where("record_type <> 'revisit'")
    met = again.join(first.select(F.col("record_id").alias("refers_to"), "payload"), "refers_to", "left")
    found = F.when(F.col("payload").isNull(), F.raise_error(F.lit("a revisit has no response"))).otherwise(F.col("payload"))
    whole = first.select("key", "uri", "payload").unionByName(met.select("key", "uri", found.alias("payload")))
    return write_archives(whole.withColumn("key", F.col("key").cast(key_type)), to, least_bytes, date)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.col("url").alias("uri"), F.col("html").alias("payload"))
    at = write_archives(pages, f"{shared_dir(spark)}/wayspark-warc-{uuid.uuid4().hex[:12]}")
    return full(read_archives(spark, at)).select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("original").cast("long").alias("refers_to"))


OP13_SQL = """with r as (select page_id, coalesce(html, '') as p, strlen(coalesce(html, ''))::bigint as n from pages),
s as (select page_id, n, sha256(p) as d from r),
f as (select d, min(page_id) as first from s where n >= 100 group by d)
select page_id, n as payload_bytes, s.d as payload_digest,
  case when f.first < page_id then 'revisit' else 'response' end as record_type,
  case when f.first < page_id then f.first end as refers_to
from s left join f on s.d = f.d and s.n >= 100"""
