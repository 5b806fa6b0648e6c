"""Token counts as delta-maintained rollups.

A batch of changes (insert, delete, revise) becomes signed rows, each the difference to what the ledger holds
of that document, and their sums by source, language and tokenizer version are added to the running totals:
nothing is recounted.

What the ledger holds is a snapshot by document and the deltas since; after ``COMPACT`` deltas a batch also writes
the next snapshot, so a batch costs the same however many came before it. A batch's files are written under
names of its own. It counts from the moment its entry in the log, numbered one above the last, appears under that
number; this is one rename that fails if the number is taken. So a batch that broke off leaves nothing but unread
files, a batch whose id is in the log does nothing, and of two writers the later one starts anew on the other's
state.
"""

from __future__ import annotations

import base64
import json
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.llm.common import arrow_rows, shared_dir, table, written

BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BPE_VERSION = "byte_bpe_50k"
WORD_VERSION = "words_1"
#: The tokenizer's public pattern of words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEY = ["source", "lang", "tokenizer"]
DELTA = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Deltas after which a snapshot is written, and the parts of one, of which a batch reads those its documents are in.
COMPACT, BUCKETS = 8, 64
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

_encoders: dict[int, object] = {}


def bpe_tokens(text: Column, spark: SparkSession, path: str = BPE) -> Column:
    """Tokens of a text under a tiktoken vocabulary; none for null. Whole texts are encoded."""
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        import tiktoken

        if id(shared) not in _encoders:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
            _encoders.clear()
            _encoders[id(shared)] = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = _encoders[id(shared)].encode_ordinary
        return pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], type=pa.int64())

    return counted(text)


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Signed rows summed by ``keys``, without what has gone."""
    sums = rows.groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def _bucket(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


class Ledger:
    """Committed batches under a folder that every executor sees."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or f"{shared_dir(spark)}/wayspark-ledger-{uuid.uuid4().hex[:12]}").rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _head(self) -> dict:
        """The log's last entry: its number, all batch ids, and where totals, snapshot and deltas are."""
        log = self._path(f"{self.root}/log")
        fs = log.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
        last = max((n for n in names if n.isdigit()), default=None)
        if last is None:
            return {"number": 0, "batches": [], "totals": None, "snapshot": None, "deltas": []}
        return json.loads(self.spark.read.text(f"{self.root}/log/{last}", wholetext=True).first()[0])

    def _publish(self, entry: dict) -> bool:
        """Writes an entry under its number; false if another one has that number."""
        own = f"{self.root}/log/_{uuid.uuid4().hex}"
        path = self._path(own)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(path)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        uri, conf = fs.getUri(), self.spark._jsc.hadoopConfiguration()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        number = self._path(f"{self.root}/log/{entry['number']:012d}")
        try:
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, conf).rename(path, number, none)
        except Py4JJavaError as e:
            fs.delete(path, False)
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def committed(self) -> list[str]:
        return self._head()["batches"]

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _held(self, head: dict, buckets: list[int] | None = None) -> DataFrame:
        """Signed rows whose sums are what the ledger holds; of a snapshot only those buckets are read."""
        rows = self._read(head["deltas"], DELTA)
        if head["snapshot"]:
            old = self.spark.read.schema(DELTA + ", bucket int").parquet(head["snapshot"])
            rows = rows.unionByName((old if buckets is None else old.where(F.col("bucket").isin(buckets))).drop("bucket"))
        return rows

    def documents(self) -> DataFrame:
        """What the ledger holds of each document."""
        return _sums(self._held(self._head()), "doc_id", *KEY)

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by source, language and tokenizer version."""
        at = self._head()["totals"]
        return self._read([at] if at else [], TOTALS)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies ``changes(op, doc_id, source, lang, tokenizer, n_tokens)`` once; false if the batch is in.

        op is insert, delete or revise; an insert of a known document revises it, a revise of an unknown one
        inserts it, a delete of an unknown one is nothing; any other op, or null, counts as revise. Of several
        changes of one document and tokenizer in a batch the one of greatest ``at`` counts (a column that may be
        missing or null), then the greatest (op, source, lang, n_tokens), so reruns agree. Rows without an id are
        inserted as they come and can't be changed later. Null counts are 0; null sources, languages and
        tokenizers are groups of their own. Other columns are ignored; an empty batch changes nothing but is in.
        """
        at = F.col("at") if "at" in changes.columns else F.lit(0)
        op = F.when(F.col("op").isin("insert", "delete"), F.col("op")).otherwise(F.lit("revise")).alias("op")
        changes = changes.select(op, F.col("doc_id").cast("long").alias("doc_id"), *KEY, F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")).alias("n_tokens"), at.alias("at"))
        last = changes.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "tokenizer").agg(F.max(F.struct("at", "op", "source", "lang", "n_tokens")).alias("c"))
        last = last.select("doc_id", "tokenizer", "c.op", "c.source", "c.lang", "c.n_tokens")
        loose = changes.where(F.col("doc_id").isNull()).select("doc_id", "tokenizer", "op", "source", "lang", "n_tokens")
        one = F.lit(1).cast("long").alias("n_docs")
        named = None
        while True:
            head = self._head()
            if batch in head["batches"]:
                return False
            if named is None:  # what does not depend on the ledger is worked out once
                named = written(last.unionByName(loose), "changes")
                buckets = sorted(r[0] for r in named.where(F.col("doc_id").isNotNull()).select(_bucket(F.col("doc_id"))).distinct().collect())  # at most BUCKETS
            base = f"{self.root}/data/{head['number'] + 1:012d}-{uuid.uuid4().hex[:12]}"
            keys = named.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("d"), F.col("tokenizer").alias("t"))
            held = self._held(head, buckets)
            held = _sums(held.join(keys, (held["doc_id"] == keys["d"]) & held["tokenizer"].eqNullSafe(keys["t"]), "left_semi"), "doc_id", *KEY)
            gone = held.select("doc_id", *KEY, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
            new = named.where("op <> 'delete'").select("doc_id", *KEY, one, "n_tokens")
            new.unionByName(gone).write.parquet(f"{base}/delta")
            delta = self._read([f"{base}/delta"], DELTA)
            old = self._read([head["totals"]] if head["totals"] else [], TOTALS)
            _sums(old.unionByName(delta.select(*KEY, "n_docs", "n_tokens")), *KEY).write.parquet(f"{base}/totals")
            entry = head | {"number": head["number"] + 1, "batches": [*head["batches"], batch], "totals": f"{base}/totals", "deltas": [*head["deltas"], f"{base}/delta"]}
            if len(entry["deltas"]) >= COMPACT:
                _sums(self._held(entry), "doc_id", *KEY).withColumn("bucket", _bucket(F.col("doc_id"))).repartition("bucket").write.partitionBy("bucket").parquet(f"{base}/snapshot")
                entry |= {"snapshot": f"{base}/snapshot", "deltas": []}
            if self._publish(entry):
                return True


def counts(docs: DataFrame) -> DataFrame:
    """Two rows per row of ``docs``, one for each tokenizer version: doc_id, source, lang, chars, tokenizer, n_tokens.

    Null texts hold no tokens; nulls in other columns stay; repeated rows repeat; other columns are ignored; an
    empty table gives none.
    """
    arrow_rows(docs.sparkSession)
    n_words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^ \t-\r]+"))
    rows = written(docs.select("doc_id", "source", "lang", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), n_words.cast("long").alias("n_words"), bpe_tokens(F.col("text"), docs.sparkSession).alias("n_bpe")), "tokens")
    each = F.inline(F.array(F.struct(F.lit(BPE_VERSION).alias("tokenizer"), F.col("n_bpe").alias("n_tokens")), F.struct(F.lit(WORD_VERSION).alias("tokenizer"), F.col("n_words").alias("n_tokens"))))
    return rows.select("doc_id", "source", "lang", "chars", each)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter with estimates (a token for each four characters), are revised to exact counts, and
    go again if they hold no token; each batch is committed twice, the second time to no effect."""
    exact = counts(table(spark, sf_dir, "documents"))
    ledger = Ledger(spark)
    batches = {
        "1-estimates": exact.select(F.lit("insert").alias("op"), "doc_id", *KEY, F.ceil(F.col("chars") / 4).alias("n_tokens")),
        "2-exact": exact.select(F.lit("revise").alias("op"), "doc_id", *KEY, "n_tokens"),
        "3-empty": exact.where("n_tokens = 0").select(F.lit("delete").alias("op"), "doc_id", *KEY, "n_tokens"),
    }
    for name, changes in batches.items():
        ledger.commit(name, changes)
        ledger.commit(name, changes)
    return ledger.totals()
