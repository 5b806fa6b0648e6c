"""Quality rules as a bitmask ledger: each rule is evaluated once, its measurement and failure bit are stored,
and versioned policies (masks over the bits) are applied to the ledger afterwards, without the texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.llm.common import let, table, words, written

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 10, 20
#: Bits of the ledger, in this order.
RULES = ("few_words", "repeats", "symbols", "dup_lines", "word_length", "shouting")
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject under it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


#: Policies by version; a ledger outlives them.
POLICIES = {
    "base": Policy("base", ("few_words", "repeats")),
    "v1": Policy("v1", ("few_words", "repeats", "symbols", "dup_lines")),
    "v2": Policy("v2", RULES),
}


def repeat_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the text. A window is known by a 64-bit hash of its
    words' hashes. Only texts with a repeat are sorted: hashes with their places, then the places whose
    neighbour has the same hash, then the words these windows cover."""
    zero = F.lit(0).cast("long")

    def covered(grams: Column) -> Column:
        placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda e, j: ((j > 0) & (F.get(s, j - 1)["g"] == e["g"])) | F.coalesce(F.get(s, j + 1)["g"] == e["g"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda e: e["i"]))

        def spread(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window))))
            return F.aggregate(steps, zero, lambda a, x: a + x)

        return let(let(placed, places), spread)

    def grams(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))

    def counted(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(zero)

    return F.when(F.size(tokens) > window, let(let(F.transform(tokens, lambda w: F.xxhash64(w)), grams), counted)).otherwise(zero)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``fail_bits``: bit i is set if rule i of ``RULES`` fails.

    A null text has no words and fails few_words alone; an empty table gives an empty ledger; repeated rows
    give repeated rows; extra columns are ignored. Measurements are exact up to 64-bit hash collisions.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = words(F.col("text"))

    def dup(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
        return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))

    measured = docs.select("doc_id", let(tokens, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("m"), F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), F.when(text.contains("\n"), dup(text)).otherwise(F.lit(0).cast("long")).alias("n_dup_lines"), F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"))
    measured = measured.select("doc_id", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "n_upper")
    n, c = F.col("n_words"), F.col("word_chars")
    fails = {
        "few_words": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * n,
        "symbols": 4 * F.col("n_symbols") > n,
        "dup_lines": F.col("n_dup_lines") >= 20,
        "word_length": (n > 0) & ((c < 2 * n) | (c > 12 * n)),
        "shouting": 2 * F.col("n_upper") > c,
    }
    mask = sum((F.when(fails[r], F.lit(BIT[r])).otherwise(F.lit(0)) for r in RULES), F.lit(0))
    return measured.withColumn("fail_bits", mask.cast("int"))


def verdicts(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``policy`` and ``kept``."""
    return rows.withColumn("policy", F.lit(policy.version)).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents it fails, those it alone rejects, and those kept without it.
    One pass over the ledger: counts by bit pattern (at most 2**rules of them), then bitwise sums."""
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in policy.rules))).alias("r")
    each = patterns.select("b", "n", rules)
    bit = F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("b").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("b") == bit, F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("b").bitwiseAND(F.bitwise_not(bit)) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str, policy: str = "v2") -> DataFrame:
    judged = verdicts(ledger(table(spark, sf_dir, "documents")), POLICIES[policy])
    failed = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base"].mask)) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits", "policy")


def op5_quality_rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of every policy from one stored ledger: the texts are read and the rules evaluated once, policies read the ledger."""
    stored = written(ledger(table(spark, sf_dir, "documents")).select("doc_id", "fail_bits"), "ledger")
    each = [ablations(stored, p).select(F.lit(v).alias("policy"), "rule", "n_failed", "n_only", "n_kept_without") for v, p in POLICIES.items()]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


#: The same rows in DuckDB.
OP5_SQL = """
with w as (select row_number() over () as uid, doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
g as (select uid, i, array_to_string(ws[i:i + 4], ' ') as g from (select uid, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
r as (select uid, i from (select *, count(*) over (partition by uid, g) as c from g) where c > 1),
p as (select uid, count(*) as n_repeat_words from (select distinct uid, unnest(range(i, i + 5)) as k from r) group by uid),
l as (select uid, count(*) - count(distinct line) as n_dup_lines from (select uid, unnest(string_split(text, chr(10))) as line from w)
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by uid),
m as (select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
    cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as n_upper
  from w left join p using (uid) left join l using (uid)),
b as (select *, cast((n_words < 10)::int + 2 * (100 * n_repeat_words > 20 * n_words)::int + 4 * (4 * n_symbols > n_words)::int
    + 8 * (n_dup_lines >= 20)::int + 16 * (n_words > 0 and (word_chars < 2 * n_words or word_chars > 12 * n_words))::int
    + 32 * (2 * n_upper > word_chars)::int as int) as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept, fail_bits, 'v2' as policy from b
"""

#: Every rule of every policy in DuckDB.
OP5_ABLATION_SQL = f"""with q as ({OP5_SQL}),
rules(policy, mask, rule, bit) as (values {", ".join(f"('{v}', {p.mask}, '{r}', {BIT[r]})" for v, p in POLICIES.items() for r in p.rules)})
select rules.policy, rule, count(*) filter ((fail_bits & mask & bit) <> 0) as n_failed, count(*) filter ((fail_bits & mask) = bit) as n_only,
  count(*) filter ((fail_bits & mask & ~bit) = 0) as n_kept_without from q cross join rules group by rules.policy, rule"""
