"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Fingerprints at most four bits apart have, of three segments, one with at most
one differing bit, or, of two, one with at most two. So each fingerprint looks up, per segment, all keys of a small
Hamming ball, and the whole distance of what it meets is verified. Of two keys that differ, exactly one has the
lowest differing bit clear; only balls' keys that set such a bit are looked up, so every pair is found from one
end, at half the probes. The cut is the one with fewer probes and candidates for the number of fingerprints; both
give the same links. Copies are folded before any lookup: the index holds each distinct fingerprint once.

``keep_one`` is for corpora: documents whose sets of five-word shingles are 0.8 or more alike are one group. Four bits
of 64 find few of these, so it uses a longer fingerprint (``Sketch``): so many bits differ at 0.8 that more segments, looked up as
they are, cost less than balls around fewer; and it has 256 bits more by which candidates are told apart; an exact comparison of the shingle sets follows. Of short texts these bits are
the parities of 256 cells into which the shingles fall: sets that differ by m shingles differ in m parities at most, so no pair that is
alike fails, and hardly any that isn't passes. Of long ones, whose parities are all noise, they are hyperplanes.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.llm import arrowtext as A
from wayspark.llm.common import among, arrow_rows, ascii_lower, free_name, let, table, words, written
from wayspark.operators.components import components

SHINGLE = 4
MAX_BITS = 4
#: Members of a slot, picked by hash, with which all others are compared before any pairs are met.
STARS = 8
#: Spark's xxhash64 of one string is XXH64 of its UTF-8 with this seed.
SEED = 42
#: Cuts of 64 bits: (first bit, width) of each segment, and the radius of the balls.
CUTS = (
    (((0, 21), (21, 21), (42, 22)), 1),
    (((0, 32), (32, 32)), 2),
)


def _fingerprints(hashes: pa.Array) -> pa.Array:
    """Of lists of shingle hashes: a bit is set if it is set in over half of them."""
    if isinstance(hashes, pa.ChunkedArray):
        hashes = hashes.combine_chunks()
    counts = np.diff(hashes.offsets.to_numpy())
    h = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    full = np.flatnonzero(counts)
    ones = np.zeros((len(full), 64), dtype=np.int64)
    edges = np.append(np.cumsum(counts[full]) - counts[full], len(h))
    step = 1 << 17
    for b in range(0, len(h), step):
        part = np.unpackbits(h[b : b + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        g0, g1 = np.searchsorted(edges, b, "right") - 1, np.searchsorted(edges, b + len(part))
        ones[g0:g1] += np.add.reduceat(part, np.maximum(edges[g0:g1] - b, 0), axis=0, dtype=np.int64)
    out = np.zeros(len(counts), dtype=np.uint64)
    out[full] = np.packbits((2 * ones > counts[full][:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()
    return pa.array(out.view(np.int64), type=pa.int64())


def simhash(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and ``fp``, the 64-bit SimHash of the text as a signed long; 0 for null and for texts without words."""

    def hashed(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + k) for k in range(shingle)))))
        whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) >= shingle, grams).otherwise(whole)

    def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _fingerprints(batch.column("hashes"))], ["doc_id", "fp"])

    hashes = docs.select("doc_id", let(words(ascii_lower(F.col("text"))), hashed).alias("hashes"))
    return hashes.mapInArrow(fingerprinted, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _cut(n: int) -> tuple[tuple[tuple[int, int], ...], int]:
    """The cut with the fewest probes and candidates for n fingerprints."""

    def cost(cut: tuple) -> float:
        segments, radius = cut
        balls = [sum(math.comb(width, r) for r in range(radius + 1)) for _, width in segments]
        return sum(ball / 2 * (1 + n / 2**width) for ball, (_, width) in zip(balls, segments))

    return min(CUTS, key=cost)


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in itertools.combinations(range(width), r)]


def _ball(key: Column, width: int, radius: int) -> Column:
    """The keys to look up: the key itself, and those at most ``radius`` bits away whose lowest other bit it has clear."""
    masks = F.array(*(F.lit(m).cast("long") for m in _masks(width, radius)))
    lowest = lambda m: m.bitwiseAND(-m)
    open_ = F.filter(masks, lambda m: key.bitwiseAND(lowest(m)) == 0)
    return F.concat(F.array(key), F.transform(open_, lambda m: key.bitwiseXOR(m)))


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS, cut: tuple | None = None) -> DataFrame:
    """Pairs (a, b) of different values of ``fp`` at most ``max_bits`` bits apart, each once. Nulls have no links."""
    fps = fingerprints.select("fp").where(F.col("fp").isNotNull()).distinct()
    segments, radius = cut or _cut(fps.count())
    if max_bits >= len(segments) * (radius + 1):
        raise ValueError(f"at most {len(segments) * (radius + 1) - 1} bits with {len(segments)} segments and balls of {radius}")

    def key(k: int) -> Column:
        low, width = segments[k]
        return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    def table_(k: int, keys: Column) -> Column:
        return F.transform(keys, lambda x: x + F.lit(k << 32).cast("long"))

    index = fps.select(F.col("fp").alias("b"), F.explode(F.concat(*(table_(k, F.array(key(k))) for k in range(len(segments))))).alias("slot"))
    balls = F.concat(*(F.transform(table_(k, _ball(key(k), segments[k][1], radius)), lambda x, i: F.struct(x.alias("probe"), (i == 0).alias("whole"))) for k in range(len(segments))))
    probes = fps.select(F.col("fp").alias("a"), F.inline(balls))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = probes.join(index, (F.col("probe") == F.col("slot")) & near & (~F.col("whole") | (F.col("a") < F.col("b"))))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component_id, n_docs) for every fingerprint of ``rows(doc_id, fp)``; component_id is the smallest
    doc_id among all fingerprints reachable, null where all of them are null."""
    own = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprints")
    tied = components(links(own, max_bits)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = own.join(tied, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    per_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_docs"))
    return rooted.join(per_root, "root").select("fp", "component_id", "n_docs")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint and component of every document, one row per row of ``docs``.

    Null and word-less texts have fingerprint zero and are linked like any other. Repeated rows give repeated
    rows. Other columns are ignored, whatever their names. An empty table gives none.
    """
    arrow_rows(docs.sparkSession)
    rows = written(simhash(docs, shingle), "simhash")
    found = groups(rows, max_bits)
    return rows.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_docs")


@dataclass(frozen=True)
class Sketch:
    """A fingerprint of random hyperplanes over the set of shingles: ``tables`` segments of ``width`` bits and 256 bits
    more. Two sets of a Jaccard similarity differ in a bit with probability ``flip``."""

    width: int
    tables: int

    #: Shingles are counted into so many signed cells, on which the hyperplanes act.
    CELLS = 1024
    #: Longs of the 256 bits by which candidates are told apart.
    CHECKS = 4
    #: Texts of so many shingles or fewer are told apart by parities.
    SHORT = 320

    @staticmethod
    def flip(similarity: float) -> float:
        return math.acos(2 * similarity / (1 + similarity)) / math.pi

    @classmethod
    def sized(cls, n: int, similarity: float, recall: float) -> Sketch:
        """Segments so wide that of n distinct documents some 256 at random share one, and so many that a pair of just the
        similarity has one in common with probability ``recall``, if flips were independent. (Comparing bits is cheap, a row for
        each segment is not.)"""
        width = min(30, max(8, math.ceil(math.log2(max(n, 2))) - 8))
        met = (1 - cls.flip(similarity)) ** width
        return cls(width, math.ceil(math.log(1 - recall) / math.log(1 - met)))

    @staticmethod
    def distance(similarity: float) -> int:
        """The distance in 256 bits that a pair of just the similarity keeps to, but for three deviations."""
        p, n = Sketch.flip(similarity), 64 * Sketch.CHECKS
        return math.ceil(n * p + 3 * math.sqrt(n * p * (1 - p)))

    @functools.lru_cache(4)  # noqa: B019
    def planes(self) -> np.ndarray:
        """Whole numbers, so that sums are exact and reruns agree."""
        return np.rint(32 * np.random.default_rng(SEED).standard_normal((self.CELLS, 64 * self.CHECKS + self.tables * self.width)))


def _shingle_sets(texts: pa.Array, shingle: int):
    """(first row, last row + 1, hashes, rows) of the distinct shingles of each row, by row, then hash."""
    for lo, hi, raw, offsets in A.chunks(texts):
        data = A.LOWER[raw]
        starts, ends, rows = A.runs(A.NOT_SPACE[data], offsets)
        h = A.hashes(data, starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
        count = np.bincount(rows, minlength=hi - lo) if len(rows) else np.zeros(hi - lo, dtype=np.int64)
        first = np.cumsum(count) - count
        n = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
        owner = np.repeat(np.arange(hi - lo), n)
        begin = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        gram = np.zeros(len(owner), dtype=np.uint64)
        for k in range(shingle):
            inside = begin + k < (first + count)[owner]
            gram = A.mix(gram * np.uint64(31) + np.where(inside, h[np.minimum(begin + k, max(0, len(h) - 1))] if len(h) else 0, 0).astype(np.uint64))
        order = np.lexsort((gram, owner))
        gram, owner = gram[order], owner[order]
        new = np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]))[: len(gram)]
        yield lo, hi, gram[new], owner[new]


def sketched(texts: pa.Array, how: Sketch, shingle: int) -> pa.Array:
    """(n, whole, check, odd, keys) of each text: the number of its distinct shingles, a hash of their set, 256 bits of its
    fingerprint, the parities of 256 cells, and its segments."""
    free, planes, parts = 64 * how.CHECKS, how.planes(), []
    for lo, hi, gram, row in _shingle_sets(texts, shingle):
        n = np.bincount(row, minlength=hi - lo)
        whole = np.zeros(hi - lo, dtype=np.uint64)
        np.add.at(whole, row, A.mix(gram ^ np.uint64(SEED)))
        sign = np.where(gram & np.uint64(1), 1.0, -1.0)
        cells = np.bincount(row * how.CELLS + (gram >> np.uint64(54)).astype(np.int64), weights=sign, minlength=(hi - lo) * how.CELLS)
        bits = (cells.reshape(hi - lo, how.CELLS) @ planes) > 0
        check = np.packbits(bits[:, :free], axis=1, bitorder="little").view(np.int64)
        odd = np.bincount(row * free + (gram >> np.uint64(20)).astype(np.int64) % free, minlength=(hi - lo) * free).reshape(hi - lo, free) & 1
        odd = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.int64)
        keys = bits[:, free:].reshape(hi - lo, how.tables, how.width) @ (1 << np.arange(how.width, dtype=np.int64))
        parts.append((n, whole.view(np.int64), check, odd, keys))
    names = ["n", "whole", "check", "odd", "keys"]
    if not parts:
        return pa.array([], type=pa.struct([(name, pa.int64() if name in ("n", "whole") else pa.list_(pa.int64())) for name in names]))
    n, whole, *bits = (np.concatenate(x) for x in zip(*parts))
    lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel())) for x in bits]
    return pa.StructArray.from_arrays([pa.array(n), pa.array(whole), *lists], names)


def sketch(text: Column, how: Sketch, shingle: int) -> Column:
    """``sketched`` of a column."""

    @F.arrow_udf("struct<n:bigint,whole:bigint,check:array<bigint>,odd:array<bigint>,keys:array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        return sketched(texts, how, shingle)

    return of(text)


def shingle_set(text: Column, shingle: int) -> Column:
    """The hashes of a text's distinct shingles, as longs."""

    @F.arrow_udf("array<bigint>")
    def listed(texts: pa.Array) -> pa.Array:
        grams, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)]
        for lo, hi, gram, row in _shingle_sets(texts, shingle):
            grams.append(gram)
            counts.append(np.bincount(row, minlength=hi - lo))
        return pa.ListArray.from_arrays(np.cumsum(np.concatenate(counts)).astype(np.int32), pa.array(np.concatenate(grams).view(np.int64)))

    return listed(text)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least so alike."""
    left, right = sets.select(F.col("uid").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("uid").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b")
    return met.where(both >= similarity * (F.size("ga") + F.size("gb") - both)).select("a", "b")


def similar_links(own: DataFrame, rows: DataFrame, how: Sketch, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between the nodes of ``own(uid, n, check, odd, keys)``, enough to join all that are ``similarity`` alike
    and were met; ``rows(uid, text)`` gives the texts.

    First all members of a slot are compared with a few of them alone (``STARS`` picks by hash): a large group of near copies is joined
    by a number of comparisons that grows with its members; slots of two segments at once serve for this. Then those of a slot
    meet, but only nodes that are not joined yet; of these each one's nearest is compared first, and of the rest those that are still
    apart. Short texts meet in slots of their own, told apart by parities; those nearly as long as the longest short ones meet the
    long ones too, so no two texts alike are kept apart by their lengths.
    """
    # the bits of a check are columns a0, a1, .. and b0, b1, ..
    checks = lambda side: [F.get("check", F.lit(i)).alias(f"{side}{i}") for i in range(how.CHECKS)]
    far = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(how.CHECKS)), F.lit(0))
    near = far <= F.col("room_a") + F.col("room_b")
    # sets of a similarity s differ by (1 - s) / (1 + s) of their sizes together
    short = F.struct(F.lit(0).cast("long").alias("kind"), F.col("odd").alias("check"), (F.col("n") * ((1 - similarity) / (1 + similarity)) + 1e-6).alias("room"))
    long_ = F.struct(F.lit(1).cast("long").alias("kind"), F.col("check"), F.lit(Sketch.distance(similarity) / 2).alias("room"))
    kinds = F.array_compact(F.array(F.when(F.col("n") <= how.SHORT, short), F.when(F.col("n") >= math.floor(similarity * how.SHORT), long_)))
    own = own.select("uid", "keys", F.inline(kinds))
    sorted_ = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def sets(nodes: DataFrame) -> DataFrame:
        return among(rows, "uid", nodes).select("uid", shingle_set(F.col("text"), shingle).alias("grams"))

    def rooted(nodes: DataFrame, links_: DataFrame) -> DataFrame:
        tied = components(links_).select(F.col("node").alias("uid"), F.col("component").alias("root"))
        return nodes.join(tied, "uid", "left").withColumn("root", F.coalesce("root", "uid"))

    def slots(rows_: DataFrame, *cols, step: int = 1) -> DataFrame:
        """A row for each segment, or each ``step`` segments together, that a node has."""
        key = lambda k: sum((F.shiftleft(F.get("keys", k + i), how.width * i) for i in range(1, step)), F.get("keys", k))
        each = F.array(*(F.struct(F.lit(k).alias("table"), key(k).alias("key")) for k in range(0, how.tables - step + 1, step)))
        return rows_.select(*cols, "kind", F.inline(each))

    # of each slot the picks, each the smallest by another hash; in most slots they are the same one. Most slots have one row, so rows
    # are dealt before they are summed
    picks = F.array_distinct(F.array(*(F.min(F.struct(F.xxhash64("uid", F.lit(turn)).alias("h"), "uid"))["uid"] for turn in range(STARS))))
    slot = ["kind", "table", "key"]
    some = slots(own, "uid", step=2).repartition(*slot).groupBy(*slot).agg(picks.alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*slot, F.explode("p").alias("a"))
    some = some.join(own.select(F.col("uid").alias("a"), "kind", F.col("room").alias("room_a"), *checks("a")), ["a", "kind"])
    stars = slots(own, F.col("uid").alias("b"), F.col("room").alias("room_b"), *checks("b"), step=2).join(some, slot).where((F.col("a") != F.col("b")) & near)
    stars = written(stars.select(*sorted_).distinct(), "stars")
    have = written(sets(stars.select(F.explode(F.array("a", "b")).alias("uid")).distinct()), "sets")
    first = written(_alike(stars, have, similarity), "joined")
    own = written(rooted(own, first), "rooted")
    side = lambda x: slots(own, F.col("uid").alias(x), F.col("room").alias(f"room_{x}"), *checks(x), F.col("root").alias(f"r{x}"))
    met = side("a").join(side("b"), slot).where(near & (F.col("ra") != F.col("rb")) & (F.col("a") < F.col("b")))
    # a pair that was compared before failed then
    pairs = written(met.select(*sorted_, far.alias("far")).groupBy("a", "b").agg(F.min("far").alias("far")).join(stars, ["a", "b"], "left_anti"), "candidates")
    ends = pairs.select("a", "b", "far").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "far"))
    have = have.unionByName(written(sets(ends.select(F.col("a").alias("uid")).distinct().join(have, "uid", "left_anti")), "sets"))
    nearest = ends.groupBy("a").agg(F.min(F.struct("far", "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()
    first = first.unionByName(written(_alike(nearest, have, similarity), "nearest"))
    tied = rooted(ends.select(F.col("a").alias("uid")).distinct(), first)
    left, right = tied.select(F.col("uid").alias("a"), F.col("root").alias("ra")), tied.select(F.col("uid").alias("b"), F.col("root").alias("rb"))
    apart = pairs.join(left, "a").join(right, "b").where("ra <> rb")
    return first.unionByName(_alike(apart.join(nearest, ["a", "b"], "left_anti"), have, similarity))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.98) -> DataFrame:
    """The rows of ``docs`` that lead their group: the smallest doc_id, one row of those that repeat it (a null id only
    where the group has no other). All columns are kept.

    Rows are in one group if a chain of pairs leads from one to the other whose sets of ``shingle``-word shingles
    have a Jaccard similarity of ``similarity`` or more. Segments are sized for meeting a pair of just that similarity with
    probability ``recall``; the hyperplanes are one draw for all pairs, and measured recall between 0.8 and 0.84 is 0.95 or more
    (tests, at several widths). Closer pairs are met more surely. Null, empty and word-less texts are one group, as are equal sets;
    shorter texts are one shingle. Other columns may have any name; an empty table stays empty.
    """
    arrow_rows(docs.sparkSession)
    uid, col = free_name(docs, "row_key"), free_name(docs, "row_sketch")
    how = Sketch.sized(docs.count(), similarity, recall)
    rows = written(docs.withColumn(uid, F.monotonically_increasing_id()).withColumn(col, sketch(F.col("text"), how, shingle)), "keyed", "zstd")
    slim = rows.select("doc_id", F.col(uid).alias("uid"), F.col(f"{col}.n").alias("n"), F.col(f"{col}.whole").alias("whole"), *(F.col(f"{col}.{c}").alias(c) for c in ("check", "odd", "keys")))
    # equal sets are folded; their sketches are equal too
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("lead")
    own = written(slim.groupBy("n", "whole").agg(lead, F.min("uid").alias("uid"), *(F.first(c).alias(c) for c in ("check", "odd", "keys"))), "own")
    texts = rows.select(F.col(uid).alias("uid"), "text")
    tied = components(similar_links(own.where("n > 0"), texts, how, shingle, similarity)).select(F.col("node").alias("uid"), F.col("component").alias("root"))
    leads = own.select("uid", "lead").join(tied, "uid", "left").groupBy(F.coalesce("root", "uid")).agg(F.min("lead").alias("lead")).select(F.col("lead.uid").alias(uid))
    return among(rows, uid, leads).drop(uid, col)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
