"""Benchmark decontamination by winnowing.

Texts are fingerprinted by the smallest hash of five-word grams in each run of nine, so two texts that share
13 words in a row share a fingerprint. A document's fingerprints, with their places, are joined with the
benchmark's. Each hit is extended: all 13-word windows around it are formed and joined, by their words, with the
benchmark's windows, so a hit is never a hash collision. An item of fewer than 13 words is one window; its
fingerprint is the hash of all its words, and every run of so many words of a document is one too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.llm.common import BROADCAST_ROWS, ascii_lower, free_name, let, table, words, written

SPAN = 13
GRAM = 5
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RUN = SPAN - GRAM + 1
_PRINTS = "array<struct<h:bigint,len:int,at:int>>"


def _gram_hash(h: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(h, i + k) for k in range(n)))


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _grams(h: Column, n: int) -> Column:
    return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: _gram_hash(h, i, n))).otherwise(F.array().cast("array<bigint>"))


def windows(benchmark: DataFrame) -> DataFrame:
    """Distinct (key, len, item_id, tokens) of the benchmark; key is the window's words, space-joined."""
    items = benchmark.select("item_id", words(ascii_lower(F.col("text")), SEPARATOR).alias("t")).where(F.size("t") > 0)
    n = F.least(F.size("t"), F.lit(SPAN))
    each = items.select("item_id", n.alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.slice("t", i, n))).alias("w"))
    return each.select(F.array_join("w", " ").alias("key"), "len", "item_id", "w").distinct()


def _prints(tokens: Column, lengths: list[int]) -> Column:
    """(h, len, at) of a text's fingerprints: the winnowed grams, and all runs of each of the shorter lengths."""

    def winnowed(g: Column) -> Column:
        """Grams that are the smallest of some run: the greatest of the minima around such a gram is its own hash."""
        last = F.size(g) - RUN

        def chosen(least: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_max(F.slice(least, F.greatest(F.lit(0), i - RUN + 1) + 1, F.least(i, last) - F.greatest(F.lit(0), i - RUN + 1) + 1)) == F.get(g, i))
            return F.transform(at, lambda i: F.struct(F.get(g, i).alias("h"), F.lit(SPAN).alias("len"), i.alias("at")))

        return let(F.transform(F.sequence(F.lit(0), last), lambda j: F.array_min(F.slice(g, j + 1, RUN))), chosen)

    def short(h: Column, n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.struct(_gram_hash(h, i, n).alias("h"), F.lit(n).alias("len"), i.alias("at")))
        return F.when(F.size(h) >= n, runs).otherwise(F.array().cast(_PRINTS))

    def every(h: Column) -> Column:
        full = F.when(F.size(h) >= SPAN, let(_grams(h, GRAM), winnowed)).otherwise(F.array().cast(_PRINTS))
        return F.concat(full, *(short(h, n) for n in lengths))

    return let(_hashes(tokens), every)


def _whole_hash(n: int) -> Column:
    """The hash of a window ``w`` of n words."""
    return let(_hashes(F.col("w")), lambda h: _gram_hash(h, F.lit(0), n))


def _around(hits: DataFrame) -> DataFrame:
    """Of (uid, tokens, h, len, at): the words of all windows that hold the fingerprint's gram, from ``base`` on."""
    base = F.when(F.col("len") < SPAN, F.col("at")).otherwise(F.greatest(F.lit(0), F.col("at") - RUN + 1))
    return hits.select("uid", "h", "len", base.alias("base"), F.slice("tokens", base + 1, F.col("at") - base + F.when(F.col("len") < SPAN, F.col("len")).otherwise(SPAN)).alias("near"))


def _judged(docs: DataFrame, benchmark: DataFrame, uid: str, n_words: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a row key and its word count, written; and, by row key, n_hit, n_items and item_ids of
    the rows that have hits."""
    wins = written(windows(benchmark), "windows")
    # a full window is one run of nine grams: its smallest is the benchmark's fingerprint
    grams = let(_hashes(F.col("w")), lambda h: F.array_min(_grams(h, GRAM)))
    lengths = [r[0] for r in wins.where(F.col("len") < SPAN).select("len").distinct().orderBy("len").collect()]  # at most 12
    whole = reduce(lambda a, n: F.when(F.col("len") == n, _whole_hash(n)).otherwise(a), lengths, F.lit(None).cast("long"))
    prints = written(wins.select(F.when(F.col("len") == SPAN, grams).otherwise(whole).alias("h"), "len").distinct(), "prints")
    few = prints.count() <= BROADCAST_ROWS
    count = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = written(docs.withColumn(uid, F.monotonically_increasing_id()).withColumn(n_words, count), "keyed")
    tokens = rows.select(F.col(uid).alias("uid"), words(ascii_lower(F.col("text")), SEPARATOR).alias("tokens"))
    each = tokens.select("uid", "tokens", F.inline(_prints(F.col("tokens"), lengths)))
    # a row of prints is 12 bytes, so few enough of them may be broadcast, and a document's words never move; of
    # many, what is shuffled of a document is the words around its fingerprints
    hits = _around(each.join(F.broadcast(prints), ["h", "len"])) if few else _around(each).join(prints, ["h", "len"])
    starts = F.sequence(F.lit(0), F.size("near") - F.col("len"))
    spans = F.transform(starts, lambda s: F.struct((F.col("base") + s).alias("s"), F.array_join(F.slice("near", s + 1, F.col("len")), " ").alias("key")))
    found = hits.select("uid", "len", F.inline(F.when(F.size("near") >= F.col("len"), spans)))
    own = found.groupBy("uid", "s", "len").agg(F.first("key").alias("key")).join(wins.select("key", "len", "item_id"), ["key", "len"])
    per = own.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("s", "len"))).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    cover = F.aggregate("spans", state, lambda a, x: F.struct(F.greatest(a["end"], x["s"] + x["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["s"] + x["len"] - F.greatest(x["s"], a["end"]))).alias("n")))["n"]
    return rows, per.select("uid", cover.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("item_ids"))


def _bad(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids and contaminated, one row per row of ``docs``.

    Null and empty texts have no words and are clean; benchmark items without words match nothing; repeated
    rows give repeated rows, repeated items count once; a null item_id hits but is not listed. Empty tables
    are fine on either side. Other columns are ignored.
    """
    rows, per = _judged(docs.select("doc_id", "text"), benchmark, "uid", "n_words")
    zero = F.lit(0).cast("long")
    out = rows.select("uid", "doc_id", "n_words").join(per, "uid", "left")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"))
    return out.withColumn("contaminated", _bad(F.col("n_hit"), F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept; cases are those of ``contamination``."""
    uid, n_words = (free_name(docs, c) for c in ("row_key", "row_words"))
    rows, per = _judged(docs, benchmark, uid, n_words)
    bad = per.join(rows.select(F.col(uid).alias("uid"), F.col(n_words).alias("n")), "uid").where(_bad(F.col("n_hit"), F.col("n"))).select(F.col("uid").alias(uid))
    return rows.join(bad, uid, "left_anti").select(docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("item_ids", 256).alias("items_sha256"), "contaminated")


#: The same rows in DuckDB.
OP2_SQL = """
with d as (select row_number() over () as uid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as ws from benchmark),
bw as (select distinct item_id, least(len(ws), 13) as n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') as k
  from (select *, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) as i from b where len(ws) > 0)),
ns as (select distinct n from bw),
dw as (select uid, i, n, array_to_string(ws[i:i + n - 1], ' ') as k from (select uid, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, ns where len(ws) >= n)),
h as (select uid, i, dw.n, item_id from dw join bw on dw.k = bw.k and dw.n = bw.n),
c as (select uid, count(*) as n_hit from (select distinct uid, unnest(range(i, i + n)) as p from h) group by uid),
it as (select uid, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct uid, cast(item_id as varchar) as s from h) group by uid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join c using (uid) left join it using (uid)
"""
