"""Personal data: fixed patterns, and identifiers that patterns of context discover.

The four base kinds are regular expressions. Their finds are the seeds of a bootstrap over a graph of lexical
patterns and instances. An instance is a base find or any token with a digit or an ``@`` outside of them; its
patterns are the two words before it and the one word before it (digits read as 0, ``^`` stands for the start of
a text). A pattern's confidence is the share of its instances, by value, that are known; an unknown token of four
digits or more is scored by the noisy-or of the confidences of its patterns, and becomes known if that is enough.
Rounds go on until none finds a value. Known values are reported wherever they stand, as spans of kind
``context``.

Spark has no regular expression that tells where matches stand, so a text is split into gaps and matches, and
starts are running sums over a document's pieces. Patterns are written so that they scan a text once: a match
can start only where a run of its first characters starts, and runs are possessive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspark.llm.common import ascii_lower, let, table, words, written

#: kind, pattern, and a cheap test that a text can hold a match.
_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+",
}
GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
    "token": lambda t: t.rlike(r"[0-9@]"),
}
#: Words in the longer pattern; the shorter one has one.
CONTEXT = 2
#: A pattern counts if so many different known values follow it, in such a share of all values that do. A value
#: becomes known at such a score if it has so many digits.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_SCORE, MIN_DIGITS = 3, 0.5, 0.6, 4
#: Each round makes a value known, so rounds end; more than this many mean that something is wrong.
MAX_ROUNDS = 100


def _pieces(text: Column, kind: str) -> Column:
    """Gap length, last words of the gap (nearest first; tokens only) and match, in order."""
    pattern = PATTERNS[kind]
    tail = (lambda g: F.slice(F.reverse(words(g)), 1, CONTEXT)) if kind == "token" else (lambda g: F.lit(None).cast("array<string>"))
    zipped = F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), tail(g).alias("tail"), m.alias("match")))
    found = F.transform(F.filter(zipped, lambda p: p["match"].isNotNull()), lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), p["gap"].alias("gap"), p["tail"].alias("tail"), p["match"].alias("match")))
    return F.when(GATES[kind](text), found).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,tail:array<string>,match:string>>"))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = F.transform(F.sequence(F.lit(1), n), lambda i: let(F.substring(digits, i, F.lit(1)).cast("int"), lambda d: F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    small = F.forall(F.split(match, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small)
        .when(kind == "card", F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(True)
    )


def _placed(rows: DataFrame) -> DataFrame:
    """(uid, kind, i, start, end, match, tail) of all matches that hold, tokens included."""
    each = rows.select("uid", F.inline("parts"))
    before = W.partitionBy("uid", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.length("match")).over(before), F.lit(0)) + F.col("gap")
    order = W.partitionBy("uid", "kind").orderBy("i")
    # the words before a token, nearest first, may be tokens or stand before one
    earlier = [part for k in range(1, CONTEXT + 1) for part in (F.array(F.lag("match", k).over(order)), F.coalesce(F.lag("tail", k).over(order), F.array().cast("array<string>")))]
    near = F.concat("tail", *earlier)
    context = F.when(F.col("kind") == "token", F.slice(F.filter(near, lambda w: w.isNotNull()), 1, CONTEXT))
    placed = each.select("uid", "kind", "i", start.cast("int").alias("start"), "match", context.alias("context"))
    placed = placed.withColumn("end", F.col("start") + F.length("match"))
    return placed.where(_holds(F.col("kind"), F.col("match")))


def _instances(placed: DataFrame) -> DataFrame:
    """uid, start, end, value, patterns, seed and free of the graph's instances: tokens in which a base find
    starts (seed; the value is the whole find) and tokens that no base find touches (free)."""
    token = F.col("kind") == "token"
    base_start, base_end = F.when(~token, F.struct("start", "match")), F.when(~token, F.col("end"))
    # running extremes in both directions, each a frame that only grows
    onward = W.partitionBy("uid").orderBy(F.col("start").desc(), token).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("uid").orderBy("start", ~token).rowsBetween(W.unboundedPreceding, 0)
    seen = placed.withColumn("next", F.min(base_start).over(onward)).withColumn("reach", F.max(base_end).over(before)).where(token)
    seed = F.coalesce(F.col("next.start") < F.col("end"), F.lit(False))
    free = ~seed & F.coalesce(F.col("reach") <= F.col("start"), F.lit(True))
    lead = F.length(F.regexp_extract("match", r"^[^A-Za-z0-9+]*+", 0))
    bare = F.regexp_replace("match", r"^[^A-Za-z0-9+]++|(?<=[A-Za-z0-9])[^A-Za-z0-9]++$", "")
    near = F.transform("context", lambda w: F.regexp_replace(ascii_lower(w), "[0-9]", "0"))
    one, two = F.coalesce(F.get(near, F.lit(0)), F.lit("^")), F.coalesce(F.get(near, F.lit(1)), F.lit("^"))
    patterns = F.when(one == "^", F.array(one)).otherwise(F.array(one, F.concat_ws(" ", two, one)))
    seen = seen.select("uid", (F.col("start") + lead).cast("int").alias("start"), F.when(seed, F.col("next.match")).otherwise(bare).alias("value"), F.length(bare).alias("n"), patterns.alias("patterns"), seed.alias("seed"), free.alias("free"))
    return seen.where("seed or free").select("uid", "start", (F.col("start") + F.col("n")).alias("end"), "value", "patterns", "seed", "free")


def graph(instances: DataFrame) -> DataFrame:
    """(pattern, value, seed): each edge of the graph once; seed if the value is a base find anywhere after it."""
    return instances.select(F.explode("patterns").alias("pattern"), "value", "seed").groupBy("pattern", "value").agg(F.max("seed").alias("seed"))


def discovered(edges: DataFrame) -> DataFrame:
    """The values (one column) that contexts reveal and that are no base finds; ``edges`` as of ``graph``."""
    edges = written(edges.withColumn("open", F.length(F.regexp_replace("value", "[^0-9]", "")) >= MIN_DIGITS), "edges")
    seeds = written(edges.where("seed").select("value").distinct(), "seeds")
    found = seeds.limit(0)
    for _ in range(MAX_ROUNDS):
        known = seeds.unionByName(found).withColumn("known", F.lit(True))
        held = edges.join(known, "value", "left")
        support, size = F.count("known"), F.count(F.lit(1))
        good = held.groupBy("pattern").agg(support.alias("support"), (support / size).alias("confidence")).where((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE))
        score = held.where(F.col("known").isNull() & F.col("open")).join(good, "pattern").groupBy("value").agg((1 - F.product(1 - F.col("confidence"))).alias("score"))
        new = written(score.where(F.col("score") >= MIN_SCORE).select("value"), "found")
        if new.isEmpty():
            return found
        found = written(found.unionByName(new), "known")
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``, an array of (rank, start, end, kind) in code points, by kind and start; one row
    per row of ``docs``.

    Null texts count as empty and have no spans; repeated rows give repeated rows; an empty table gives
    none; other columns are ignored. Base spans stay as they are; ``context`` spans never overlap them. Texts
    without base finds anywhere give no context spans; equal scores need no order, as all that suffice count.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = F.concat(*(_pieces(text, k) for k in PATTERNS))
    rows = written(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", parts.alias("parts")), "pii")
    placed = written(_placed(rows), "placed")
    tokens = written(_instances(placed), "tokens")
    values = discovered(graph(tokens))
    rank = reduce(lambda a, k: a.when(F.col("kind") == k, F.lit(KINDS.index(k))), KINDS[1:], F.when(F.col("kind") == KINDS[0], F.lit(0)))
    base = placed.where(F.col("kind") != "token").select("uid", rank.alias("rank"), "start", "end", "kind")
    more = tokens.where("free").join(values, "value", "left_semi").select("uid", F.lit(len(KINDS)).alias("rank"), "start", "end", F.lit("context").alias("kind"))
    per = base.unionByName(more).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "end", "kind"))).alias("spans"))
    out = rows.select("uid", "doc_id").join(per, "uid", "left")
    return out.select("doc_id", F.coalesce("spans", F.array().cast("array<struct<rank:int,start:int,end:int,kind:string>>")).alias("spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    spell = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.filter("spans", lambda s: s["rank"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(spell(F.filter("spans", lambda s: s["rank"] < len(KINDS))), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"))
