"""Mixing sources to target weights along a time-varying curriculum.

Training time u runs from 0 to 1 over one axis of all words taken. Each source has a weight schedule: its share
of the mix at time u is linear, rising or falling by a tilt about its mean share; gains and losses are balanced,
so the shares of all sources add up to one at any time. A source's schedule integrated over time is its
cumulative demand D(u), which ends at its target.

A source's documents stand one after another in a fixed pseudo-random order, epoch after epoch. A place of a
document begins at a word b of that stream; inverting the demand gives the time D^-1(b) at which the mix comes to
that word, which is the place's training position. A place's words are what the source demands between its two
ends, the second no later than the end of training: what a document is taken for follows from its positions.
Places are range-sorted by position, which interleaves the sources as the schedules say.

The stream's offsets are prefix sums over a source that may hold a third of all rows. They are taken in two steps:
totals of 4096 hash buckets per source, then a window inside each bucket, so no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspark.llm.common import table, written

CYCLE = (1, 2, 3)
MAX_REPEATS = 3
#: Hash buckets of a source are the first hex digits of its documents' md5.
BUCKET_DIGITS = 3
#: How much of its mean share a source gains (even rank) or loses (odd rank) from the middle of training to its end, at most.
TILT = 0.5


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


def targets(totals: DataFrame, cycle: tuple[int, ...] = CYCLE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, rank, weight, target) from (source, source_size).

    Targets are the smaller of the cap and one common rate times the weight. The rate follows from sorting the
    sources by cap over weight: it is the first rate, over the sources not yet capped, that caps no other.
    This is where resharing the excess by weight, again and again, ends.
    """
    cap = (F.lit(max_repeats) * F.col("source_size")).alias("cap")
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = totals.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(c) for c in cycle)), (F.pmod("rank", F.lit(len(cycle))) + 1).cast("int")).cast("long"))
    ranked = ranked.select("source", "source_size", "rank", "weight", cap, F.sum("source_size").over(W.partitionBy()).alias("all_size"), F.sum("weight").over(W.partitionBy()).alias("all_weight"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    earlier = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rate = (F.col("all_size") - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    rated = ranked.withColumn("rate", rate).withColumn("fits", F.col("rate") * F.col("weight") <= F.col("cap"))
    common = F.first(F.when(F.col("fits"), F.col("rate")), ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rated.withColumn("common", common).select("source", "source_size", "rank", "weight", F.least(F.col("cap").cast("double"), F.coalesce(F.col("common") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def tilted(plan: DataFrame, tilt: float = TILT) -> DataFrame:
    """``plan`` with ``slope``, in words: a source's demand up to time u is target * u + slope * (u * u - u).

    Sources of even rank gain, those of odd rank lose, at most ``tilt`` times their target; the larger side is
    scaled down until the slopes of all sources add up to zero, so a source alone has none.
    """
    gains = F.col("rank") % 2 == 0
    up, down = (F.coalesce(F.sum(F.when(g, F.col("target"))).over(W.partitionBy()), F.lit(0.0)) for g in (gains, ~gains))
    both = F.least(up, down)
    slope = F.when(both == 0, F.lit(0.0)).when(gains, F.lit(tilt) * F.col("target") * (both / up)).otherwise(F.lit(-tilt) * F.col("target") * (both / down))
    return plan.withColumn("slope", slope)


def demanded(time: Column, target: Column, slope: Column) -> Column:
    """The words a source has been asked for by a time."""
    return target * time + slope * (time * time - time)


def time_of(words: Column, target: Column, slope: Column) -> Column:
    """The time by which a source has been asked for so many words: ``demanded`` inverted, at most 1."""
    rate = target - slope  # at time 0; positive, as no slope reaches its target
    share = F.least(words.cast("double"), target)
    return F.when(target > 0, F.least(2 * share / (rate + F.sqrt(rate * rate + 4 * slope * share)), F.lit(1.0)))


def sized(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, h, bucket, *carry), written once: the text is read a single time."""
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), h.alias("h"), *carry)
    return written(slim.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS)), "sized")


def mix(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, max_repeats: int = MAX_REPEATS, tilt: float = TILT, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, start, places, taken, position, n_places.

    ``places`` is an array of (epoch, begin, position, words), one for each time the mix comes to the document;
    ``taken`` is the sum of their words, ``position`` the first place's (null without places). Only the place in
    which training ends is cut, so a source's taken words add up to its target, rounded. ``start`` is the
    document's first word in the source's stream.

    Null texts have size 0; a null source is a source of its own, ranked last; rows that repeat a doc_id stand
    side by side in order of size, so reruns agree; rows without an id stand in the order of their texts' hashes.
    Empty documents and sources take nothing; an empty table gives an empty result. Other columns are ignored, but for those that
    ``carry`` names, which mustn't have a name of these.
    """
    rows = sized(docs, carry)
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    plan = tilted(targets(totals.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), cycle, max_repeats), tilt)
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    starts = starts.join(plan, starts["source"].eqNullSafe(plan["source"])).select(starts["source"].alias("s"), starts["bucket"].alias("b"), "bucket_start", "source_size", "target", "slope")
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, placed["source"].eqNullSafe(starts["s"]) & (placed["bucket"] == starts["b"]))
    placed = placed.select("doc_id", "source", "size", "source_size", "target", "slope", (F.col("bucket_start") + F.col("inside")).alias("start"), *carry)
    target, slope = F.col("target"), F.col("slope")

    def place(epoch: Column) -> Column:
        begin = F.col("start") + F.col("source_size") * epoch
        end = demanded(time_of(begin + F.col("size"), target, slope), target, slope)
        words = F.greatest(F.lit(0).cast("long"), F.round(end).cast("long") - begin)
        return F.struct(epoch.alias("epoch"), begin.alias("begin"), time_of(begin, target, slope).alias("position"), words.alias("words"))

    places = F.filter(F.array(*(place(F.lit(e)) for e in range(max_repeats))), lambda p: p["words"] > 0)
    placed = placed.select("doc_id", "source", "size", "source_size", "target", "start", F.when(F.col("size") > 0, places).otherwise(F.filter(places, lambda p: F.lit(False))).alias("places"), *carry)
    taken = F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return placed.select("*", taken.alias("taken"), F.get("places", 0)["position"].alias("position"), F.size("places").cast("long").alias("n_places"))


def by_position(mixed: DataFrame) -> DataFrame:
    """The training order: one row for each place, range-sorted by position."""
    each = mixed.drop("position").select("doc_id", "source", F.inline("places"))
    return each.select("position", "doc_id", "source", "epoch", "words").orderBy("position", "doc_id", "epoch", "source", "words")


def curriculum(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, max_repeats: int = MAX_REPEATS, tilt: float = TILT, carry: tuple[str, ...] = ()) -> DataFrame:
    """``mix`` dealt out, in training order: doc_id, source, size, source_size, target, taken, start, position, epoch, *carry.

    A document has a row for each place; ``taken``, ``start`` and ``position`` are that place's. ``size`` stands on
    a document's first row and is 0 on its repeats, so both add up over the rows. Documents without a place
    follow the training order, with taken 0 and no position and epoch. Cases are those of ``mix``.
    """
    each = mix(docs, cycle, max_repeats, tilt, carry).drop("position").select("*", F.inline_outer("places"))
    size = F.when(F.col("epoch") > 0, F.lit(0).cast("long")).otherwise(F.col("size")).alias("size")
    rows = each.select("doc_id", "source", size, "source_size", "target", F.coalesce("words", F.lit(0).cast("long")).alias("taken"), F.coalesce("begin", "start").alias("start"), "position", "epoch", *carry)
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id", "epoch", "source", "start")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words taken of each document by the sum over its places, in order of first training position."""
    rows = mix(table(spark, sf_dir, "documents")).orderBy(F.col("position").asc_nulls_last(), "doc_id", "size")
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"), "n_places")


def op9_mixing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of the curriculum, in training order."""
    rows = by_position(mix(table(spark, sf_dir, "documents")))
    return rows.select(F.round("position", 9).alias("position"), "doc_id", "source", "epoch", "words")


#: Sources, targets and slopes, and each document's first word in its source's stream, in DuckDB.
_PLAN_SQL = """
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), text, '')) as h from documents),
tot as (select source, sum(size)::bigint as source_size from d group by source),
rk as (select *, row_number() over (order by source is null, source) - 1 as rank from tot),
wt as (select *, (rank % 3) + 1 as weight, 3 * source_size as cap, sum(source_size) over () as t, sum((rank % 3) + 1) over () as w from rk),
ra as (select *, (t - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))::double
    / (w - coalesce(sum(weight) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))::double as rate from wt),
co as (select *, (select arg_min(rate, struct_pack(a := cap / weight, b := rank)) from ra where rate * weight <= cap) as common from ra),
pl as (select source, rank, source_size, least(cap::double, coalesce(common * weight, cap::double)) as target from co),
ud as (select *, coalesce(sum(target) filter (rank % 2 = 0) over (), 0e0) as up, coalesce(sum(target) filter (rank % 2 = 1) over (), 0e0) as down from pl),
sl as (select source, source_size, target, case when least(up, down) = 0 then 0e0 when rank % 2 = 0 then 5e-1 * target * (least(up, down) / up)
    else -5e-1 * target * (least(up, down) / down) end as slope from ud),
st as (select d.doc_id, d.source, d.size, sl.source_size, sl.target, sl.slope,
    coalesce(sum(d.size) over (partition by d.source order by d.h, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join sl on d.source is not distinct from sl.source),
ep as (select *, e as epoch, start + e * source_size as b, greatest(0, least(size, round(target)::bigint - start - e * source_size))::bigint as words
  from st, (select unnest(range(0, 3)) as e)),
tm as (select *, case when words > 0 then least(2e0 * least(b::double, target)
    / ((target - slope) + sqrt((target - slope) * (target - slope) + 4e0 * slope * least(b::double, target))), 1e0) end as position from ep)
"""

#: The same rows in DuckDB.
OP9_SQL = (
    _PLAN_SQL
    + """select doc_id, any_value(size) as size, any_value(source_size) as source_size, any_value(target) as target, sum(words)::bigint as taken,
  round(min(position), 6) as position, count(position) as n_places from tm group by doc_id, source, start, size
"""
)

#: Every place in DuckDB.
OP9_ORDER_SQL = _PLAN_SQL + "select round(position, 9) as position, doc_id, source, cast(epoch as int) as epoch, words from tm where words > 0"
