"""Spelling variants by forward and reversed dictionaries.

Two words one edit apart agree on all before the edit and all after it, so they share one half: a prefix or a
suffix. In the dictionary sorted forwards the words of one prefix stand together, in the reversed one those of one
suffix; these blocks are scanned, and the pairs in them verified. A block is a row key (length, i, j, first i and last j code
points): words of that length, and words one shorter, which agree there. A skewed block is subdivided by the same
argument, as of what lies between i and j again one half is intact; blocks end where one code point is left, and there all
pairs are variants. So no block of many words is ever paired with itself, and none is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.llm.common import ascii_lower, table, written

NOT_LETTERS = "[^A-Za-zÀ-ÿ]+"
#: Shortest word, and its least occurrences.
LEAST_LENGTH, LEAST_N = 6, 5
#: A word's form occurs at least so many times as often.
TIMES = 5
#: Blocks whose scan would compare more pairs are subdivided.
BLOCK_PAIRS = 2_000
#: One run in so many loses a code point (the query's damage to its texts).
DAMAGE = 199


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run) for each maximal run of Latin-1 letters of each text, A-Z in lower case; null and empty texts give none."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", F.explode(F.split(text, NOT_LETTERS)).alias("run")).where("run <> ''")


def damaged(runs_: DataFrame, every: int = DAMAGE) -> DataFrame:
    """(word): a run, without its code point h % length if ``every`` divides h, the crc32 of ``<doc_id>:<run>``. A null id is empty text."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.col("h") % F.char_length("run")
    less = F.concat(F.expr("substring(run, 1, cast(h % char_length(run) as int))"), F.expr("substring(run, cast(h % char_length(run) as int) + 2)"))
    return runs_.select("run", h.alias("h")).select(F.when((F.col("h") % every == 0) & at.isNotNull(), less).otherwise(F.col("run")).alias("word"))


def dictionary(words: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N) -> DataFrame:
    """(word, n) of the distinct words that are long and frequent enough; counts are partial sums before the shuffle."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def _members(at: DataFrame) -> DataFrame:
    """The halves of blocks (word, len, i, j): from each, the block whose prefix is longer and that whose suffix is."""
    half = F.floor((F.col("len") - F.col("i") - F.col("j")) / 2).cast("int")
    longer = F.array(F.struct((F.col("i") + half).alias("i"), F.col("j").alias("j")), F.struct(F.col("i").alias("i"), (F.col("j") + half).alias("j")))
    return at.select("word", "len", F.inline(longer))


def _keyed(members: DataFrame) -> DataFrame:
    """With the block's key, and whether the word is the longer kind. Sorted dictionaries: by prefix, then suffix."""
    head, tail = F.expr("substring(word, 1, i)"), F.expr("case when j > 0 then right(word, j) else '' end")
    return members.withColumn("head", head).withColumn("tail", tail).withColumn("whole", F.char_length("word") == F.col("len"))


KEY = ["len", "i", "j", "head", "tail"]


def variants(words: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(a, b), each pair once: the distinct non-null ``words(word)`` that differ by one inserted, deleted or replaced code point; a is the shorter,
    or of two of one length the smaller. The empty word is one edit from words of one code point.

    Blocks are halved in rounds, at most as many as a word's length has bits; each round counts its blocks' members, scans the
    small blocks and subdivides the others.
    """
    own = words.select("word").where("word is not null").distinct()
    size = F.char_length("word")
    start = own.select("word", F.explode(F.array(size, size + 1)).alias("len"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    # a word of one code point has no halves: its blocks are whole from the start
    alone = start.where("len < 2")
    members = written(_keyed(_members(start.where("len >= 2")).unionByName(alone)).distinct(), "blocks")
    found = None
    while True:
        longer, shorter = F.count_if("whole"), F.count_if(~F.col("whole"))
        sizes = members.groupBy(*KEY).agg(longer.alias("n"), shorter.alias("m")).where("n > 0 and n + m > 1")
        big = (F.col("n") * (F.col("n") + F.col("m")) > block_pairs) & (F.col("len") - F.col("i") - F.col("j") > 1)
        sizes = written(sizes.select(*KEY, big.alias("big")), "sizes")
        tied = members.join(sizes, KEY)
        small = tied.where("not big").drop("big")
        left, right = small.where("whole").select(*KEY, F.col("word").alias("b")), small.select(*KEY, F.col("word").alias("a"), "whole")
        # of two words that agree on i and j the whole distance is that of what lies between
        between = lambda c: F.substring(c, F.col("i") + 1, F.char_length(c) - F.col("i") - F.col("j"))
        pairs = left.join(right.hint("merge"), KEY).where((~F.col("whole") | (F.col("a") < F.col("b"))) & (F.levenshtein(between(F.col("a")), between(F.col("b")), 1) == 1))
        pairs = written(pairs.select("a", "b"), "pairs")
        found = pairs if found is None else found.unionByName(pairs)
        if sizes.where("big").isEmpty():
            return found.distinct()
        members = written(_keyed(_members(tied.where("big"))).distinct(), "blocks")


def forms(counted: DataFrame, near: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of ``counted(word, n)`` by its pairs ``near(a, b)``.

    A form is the near word of largest n, ties to the smallest, if that is ``times`` the word's n. Roots follow forms to the last, by doubling:
    each round a word takes its root's root.
    """
    ends = near.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other")))
    other = counted.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = ends.join(other, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("m"))
    met = counted.join(best, "word", "left")
    enough = -F.col("m.less") >= times * F.col("n")
    rows = written(met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("m.other")).alias("form"), F.when(enough, -F.col("m.less")).alias("form_n")), "forms")
    root = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = root.select(F.col("word").alias("root"), F.col("root").alias("up"))
        met = written(root.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        root = met.select("word", "root")
        if met.where("moved").isEmpty():
            break
    return rows.join(root, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variant_groups(words: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, times: int = TIMES) -> DataFrame:
    """The whole operator over ``words(word)``, a row each occurrence: (word, n, n_near, form, form_n, root), a row for each word of the dictionary.

    Null and short words are left out, repeated rows are occurrences, very long words are words like any other; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    counted = written(dictionary(words, least_length, least_n), "dictionary")
    return forms(counted, written(variants(counted), "variants"), times)


def canonical(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, run, root): what each run of ``docs`` that has another root would be spelt as, with repeats."""
    return runs(docs).join(groups.where("root <> word").select(F.col("word").alias("run"), "root"), "run").select("doc_id", "run", "root")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(damaged(runs(table(spark, sf_dir, "documents")))).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 over the bytes of a text: the polynomial's table follows from its rule.
OP11_SQL = """with recursive d as (select doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^A-Za-zÀ-ÿ]+')) as run from documents),
k as (select doc_id, run, count(*) as times, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from d where run <> '' group by doc_id, run),
t as (select list(list_reduce(list_prepend(b, range(8)), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by b) as crc from range(256) r(b)),
h as (select run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::int, 2))::bigint)),
  lambda c, b: xor(c // 256, crc[(xor(c % 256, b) + 1)::int])), 4294967295) as h from k, t),
w as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times from h),
c as (select word, sum(times)::bigint as n from w where length(word) >= 6 group by word having sum(times) >= 5),
cut as (select word, n, p, substr(word, 1, p) || substr(word, p + 2) as less from (select word, n, unnest(range(length(word))) as p from c)),
near as (select distinct a.word, b.word as other, b.n as other_n from cut a join cut b on a.less = b.less and a.p = b.p and a.word <> b.word
  union select a.word, c.word, c.n from cut a join c on a.less = c.word
  union select c.word, a.word, a.n from cut a join c on a.less = c.word),
best as (select word, count(*) as n_near, min(struct_pack(less := -other_n, other := other)) as m from near group by word),
f as (select c.word, c.n, coalesce(n_near, 0) as n_near, case when -m.less >= 5 * c.n then m.other end as form, case when -m.less >= 5 * c.n then -m.less end as form_n
  from c left join best using (word)),
up as (select word, form as at from f where form is not null union all select up.word, f.form from up join f on up.at = f.word where f.form is not null),
last as (select up.word, up.at as root from up join f on up.at = f.word where f.form is null)
select f.word, f.form, coalesce(root, f.word) as root, n, n_near, form_n from f left join last using (word)"""
