"""Hard negatives by a vantage-point tree over norm-augmented vectors.

One component more brings all vectors x to the greatest length M of any; an anchor q gets 0 there. Then |q - x|^2 = |q|^2 + M^2 - 2 q.x,
so high inner products are short distances, and a window of scores is an annulus around the anchor. The tree is fitted on a
bounded sample; every row is routed to its leaf, and each leaf keeps the range of its rows' distances to the pivots above it. By
these, an anchor knows the best and the least score that a leaf can hold. It visits leaves nearest first, some more each
round, passes over those wholly outside the annulus, and is done when no leaf left can better what it has.

Anchors are visited with in blocks: those that go to a leaf are packed, and a pack meets a block of the leaf's rows in one matrix
product. Scores are whole numbers, so sums are exact; results equal brute force whatever the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspark.llm.common import table, written

#: Rows of a leaf and of a block, depth and sampled rows a leaf (at most 65,536 rows in all are sampled), anchors of a pack.
LEAF_ROWS, MAX_DEPTH, SAMPLED, PACK = 1024, 12, 16, 128
#: Leaves that an anchor visits in its first round, and how many times more in each later one.
FIRST, GROWTH = 1, 4
#: Pairs of a pack and a block in an Arrow batch.
BATCH = 16
#: The query: scale of components, anchors, positives and negatives, window in percent of the positive's score.
SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 50, 5, 3, 50, 95
FOUND = "array<array<struct<score:bigint,id:bigint>>>"


@dataclass(frozen=True)
class Tree:
    """A complete tree: node k has the children 2k+1 (within the radius) and 2k+2. ``near`` and ``far`` are the ranges of each leaf's
    distances to the pivot of each level above it; a leaf without rows has the range from inf to -inf."""

    top: float
    dim: int
    depth: int
    pivots: np.ndarray
    radius: np.ndarray
    near: np.ndarray | None = None
    far: np.ndarray | None = None

    def distances(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Of vectors with their extra component to all pivots."""
        p, e = self.pivots[:, :-1], self.pivots[:, -1]
        d2 = ((x * x).sum(1) + extra * extra)[:, None] + (self.pivots * self.pivots).sum(1)[None, :] - 2 * (x @ p.T + extra[:, None] * e[None, :])
        return np.sqrt(np.maximum(d2, 0))

    def extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distance to the pivot of each level."""
        d, at, rows = self.distances(x, self.extra(x)), np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        way = np.zeros((len(x), self.depth))
        for level in range(self.depth):
            way[:, level] = d[rows, at]
            at = 2 * at + 1 + (way[:, level] > self.radius[at])
        return at - (2**self.depth - 1), way

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best and the least score that a row of each leaf can have with each anchor, with room for rounding."""
        n, leaves = len(q), 2**self.depth
        least, most = np.zeros((n, leaves)), np.full((n, leaves), np.inf)
        d = self.distances(q, np.zeros(n))
        for level in range(self.depth):
            pivot = 2**level - 1 + (np.arange(leaves) >> (self.depth - level))
            to = d[:, pivot]
            least = np.maximum(least, np.maximum(to - self.far[:, level], self.near[:, level] - to))
            most = np.minimum(most, to + self.far[:, level])
        norm = ((q * q).sum(1) + self.top)[:, None]
        room = 1e-6 * norm + 1
        with np.errstate(invalid="ignore"):
            return np.where(least == np.inf, -np.inf, (norm - least * least) / 2 + room), (norm - most * most) / 2 - room


def _to(whole: np.ndarray, rows: np.ndarray, pivot: np.ndarray, some: int = 4096) -> np.ndarray:
    """Distances of rows to a pivot, some rows at a time, as this runs on the driver."""
    out = np.empty(len(rows))
    for i in range(0, len(rows), some):
        out[i : i + some] = np.sqrt(((whole[rows[i : i + some]] - pivot) ** 2).sum(1))
    return out


def fit(sample: np.ndarray, top: float, dim: int, depth: int) -> Tree:
    """Pivots and radii: of each node's sampled rows, of eight tried the one whose distances spread most, cut at their median."""
    sample = sample.astype(float, copy=False)
    whole = np.hstack([sample, np.sqrt(np.maximum(top - (sample * sample).sum(1), 0))[:, None]])
    nodes = 2**depth - 1
    pivots, radius, own = np.zeros((nodes, dim + 1)), np.zeros(nodes), {0: np.arange(len(whole))}
    for k in range(nodes):
        rows = own.pop(k)
        if len(rows):
            tried = whole[rows[:: max(1, len(rows) // 8)][:8]]
            d = np.stack([_to(whole, rows, p) for p in tried])
            best = int(np.argmax(d.std(axis=1)))
            pivots[k], radius[k] = tried[best], np.median(d[best])
            out = d[best] > radius[k]
        else:
            out = np.zeros(0, dtype=bool)
        own[2 * k + 1], own[2 * k + 2] = rows[~out], rows[out]
    return Tree(top, dim, depth, pivots, radius)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of whole numbers as floats; shorter ones end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(lists) * dim:
        return flat.reshape(len(lists), dim).astype(float)
    out = np.zeros((len(lists), dim))
    out[np.repeat(np.arange(len(lists)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _ragged(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), values)


@dataclass(frozen=True)
class Index:
    tree: Tree
    #: (leaf, ids, labels, vecs): every row, in blocks of about LEAF_ROWS.
    blocks: DataFrame


def _one_batch(spark: SparkSession, rows: int, run):
    """``run()`` while Arrow batches have so many rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        return run()
    finally:
        spark.conf.set(name, before)


def build(rows: DataFrame, copies: int) -> Index:
    """The index of ``rows(id, label, vec)``. Of rows of one vector and label only the ``copies`` smallest ids are kept in it, as
    results of so many never reach others; these are cut before the shuffle, so a very common vector is no hot key."""
    spark = rows.sparkSession
    same = W.partitionBy("label", F.xxhash64("vec"), "vec").orderBy("id")
    slim = rows.select("id", "label", "vec").withColumn("k", F.row_number().over(same)).where(F.col("k") <= copies).drop("k")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    slim = written(slim.withColumn("norm", norm), "vectors")
    n, top, dim = slim.agg(F.count(F.lit(1)), F.coalesce(F.max("norm"), F.lit(0.0)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(n, 1) / LEAF_ROWS))))
    want = SAMPLED * 2**depth
    pick = F.pmod(F.xxhash64("id", "label"), F.lit(1 << 30)) < int(min(1.0, 1.2 * want / max(n, 1)) * (1 << 30))
    sample = _matrix(slim.where(pick).limit(want).select("vec").toArrow().column("vec"), dim)
    tree = fit(sample, top, dim, depth)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, way = tree.route(_matrix(b.column("vec"), dim))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("vec"), pa.array(leaf), _ragged(pa.array(way.ravel()), np.full(len(leaf), depth))], ["id", "label", "vec", "leaf", "way"])

    at = written(_one_batch(spark, 4096, lambda: slim.select("id", "label", "vec").mapInArrow(routed, "id long, label long, vec array<long>, leaf long, way array<double>")), "routed")
    # one row a leaf, at most 2^MAX_DEPTH
    ranges = at.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.min(F.get("way", F.lit(k))) for k in range(depth))).alias("near"), F.array(*(F.max(F.get("way", F.lit(k))) for k in range(depth))).alias("far")).collect()
    near, far, count = np.full((2**depth, depth), np.inf), np.full((2**depth, depth), -np.inf), np.ones(2**depth, dtype=np.int64)
    for r in ranges:
        near[r.leaf], far[r.leaf], count[r.leaf] = r.near, r.far, math.ceil(r.n / LEAF_ROWS)
    tree = Tree(top, dim, depth, tree.pivots, tree.radius, near, far)
    block = F.pmod(F.xxhash64("id", "label", "vec"), F.element_at(F.array(*(F.lit(int(c)).cast("long") for c in count)), (F.col("leaf") + 1).cast("int")))
    packed = at.groupBy("leaf", block.alias("block")).agg(F.collect_list(F.struct("id", "label", "vec")).alias("r"))
    return Index(tree, written(packed.select("leaf", F.col("r.id").alias("ids"), F.col("r.label").alias("labels"), F.col("r.vec").alias("vecs")), "leaves"))


def _planned(tree: Tree, k: int, step: int):
    """Adds to each anchor the next leaves to visit and moves its place in its order of leaves on."""

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, n = _matrix(b.column("vec"), tree.dim), b.num_rows
            best, least = tree.scores(q)
            cursor = b.column("cursor").to_numpy()
            wins, found = b.column("windows").to_pylist(), b.column("found").to_pylist()
            order = np.argsort(-best, axis=1, kind="stable")
            leaves, counts, moved = [], np.zeros(n, dtype=np.int64), cursor.copy()
            for i in range(n):
                useful = np.zeros(best.shape[1], dtype=bool)
                for w, f in zip(wins[i], found[i] or [[]] * len(wins[i])):
                    floor = max(w["lo"], f[k - 1]["score"]) if len(f) >= k else w["lo"]
                    useful |= (best[i] >= floor) & (least[i] <= w["hi"]) & (best[i] > -np.inf)
                rank = np.flatnonzero(useful[order[i, cursor[i] :]])[:step]
                counts[i] = len(rank)
                if len(rank):
                    leaves.append(order[i, cursor[i] :][rank])
                    moved[i] = cursor[i] + rank[-1] + 1
            flat = pa.array(np.concatenate(leaves).astype(np.int64) if leaves else np.zeros(0, dtype=np.int64))
            cols = {name: b.column(name) for name in b.schema.names} | {"cursor": pa.array(moved), "leaves": _ragged(flat, counts)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return planned


def _met(dim: int, exact: bool, k: int, same: bool):
    """Of each pack and block: the first k rows of each anchor's windows, as (uid, w, score, id)."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i in range(b.num_rows):
                pack = b.column("pack")[i].values
                ids, labels = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "labels"))
                x, q = _matrix(b.column("vecs")[i].values, dim), _matrix(pack.field("vec"), dim)
                uid, own_id, own_label = (pack.field(c).to_numpy() for c in ("uid", "id", "label"))
                if exact:
                    s = np.rint(q @ x.T).astype(np.int64)
                else:
                    whole = lambda a: np.array([[int(v) for v in r] for r in a.to_pylist()], dtype=object)
                    s = (whole(pack.field("vec")) @ whole(b.column("vecs")[i].values).T).astype(np.int64)
                fits = (own_label[:, None] == labels[None, :]) == same
                for r, c in np.argwhere((own_id[:, None] == ids[None, :]) & fits):
                    fits[r, c] = not (same and np.array_equal(q[r], x[c]))
                wins = pack.field("windows")
                first, n = wins.offsets.to_numpy() - wins.offsets[0].as_py(), np.diff(wins.offsets.to_numpy())
                lo, hi = (wins.flatten().field(c).to_numpy() for c in ("lo", "hi"))
                for w in range(int(n.max(initial=0))):
                    has = np.flatnonzero(n > w)
                    at = first[has] + w
                    mine = s[has]
                    hit = fits[has] & (mine >= lo[at][:, None]) & (mine <= hi[at][:, None])
                    if hit.shape[1] > k:
                        # all that is worse than the k-th of the row goes before the sort; ties stay
                        kth = np.partition(np.where(hit, mine, np.iinfo(np.int64).min), hit.shape[1] - k, axis=1)[:, hit.shape[1] - k]
                        hit &= mine >= kth[:, None]
                    r, c = np.nonzero(hit)
                    order = np.lexsort((ids[c], -mine[r, c], r))
                    r, c = r[order], c[order]
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    r, c = r[place < k], c[place < k]
                    out.append((uid[has[r]], np.full(len(r), w), mine[r, c], ids[c]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["uid", "w", "score", "id"])

    return met


def search(index: Index, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """``anchors(uid, id, label, vec, windows)`` with ``found``: for each window (lo, hi) of scores the first k rows of the same label but
    the anchor itself, or of other labels, as (score, id); higher scores first, then smaller ids.

    A round is a plan of visits and their matrix products; what each anchor has found is a table in the shared folder.
    """
    spark, tree = anchors.sparkSession, index.tree
    cols = ["uid", "id", "label", "vec", "windows"]
    state = written(anchors.select(*cols, F.lit(None).cast(FOUND).alias("found"), F.lit(0).cast("long").alias("cursor")), "anchors")
    n, norm = state.agg(F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    packs = max(1, math.ceil(n / PACK))
    exact = math.sqrt((norm or 0.0) * tree.top) < 2**53
    kind = "uid long, id long, label long, vec array<long>, windows array<struct<lo:bigint,hi:bigint>>, found " + FOUND + ", cursor long"
    done, step = None, FIRST
    while True:
        plan = _one_batch(spark, 256, lambda: written(state.mapInArrow(_planned(tree, k, step), kind + ", leaves array<bigint>"), "visits"))  # noqa: B023
        ended = plan.where("size(leaves) = 0").select(*cols, "found")
        done = ended if done is None else done.unionByName(ended)
        open_ = plan.where("size(leaves) > 0")
        if open_.isEmpty():
            return done
        # what is found raises the floor of a window
        floor = lambda w, i: F.greatest(w["lo"], F.coalesce(F.get(F.get("found", i), F.lit(k - 1))["score"], w["lo"]))
        windows = F.transform("windows", lambda w, i: F.struct(floor(w, i).alias("lo"), w["hi"].alias("hi")))
        visits = open_.withColumn("windows", windows).select(F.explode("leaves").alias("leaf"), F.struct(*cols).alias("a"))
        pack = visits.groupBy("leaf", F.pmod(F.xxhash64("a.uid"), F.lit(packs)).alias("p")).agg(F.collect_list("a").alias("pack"))
        # merges throughout, as arrays of vectors are many times their files and a broadcast would go through the driver
        pairs = pack.select("leaf", "pack").join(index.blocks.hint("merge"), "leaf").select("pack", "ids", "labels", "vecs")
        new = pairs.mapInArrow(_met(tree.dim, exact, k, same), "uid long, w long, score long, id long")
        old = open_.select("uid", F.posexplode("found").alias("w", "f")).select("uid", F.col("w").cast("long").alias("w"), F.inline("f"))
        best = new.unionByName(old).repartition("uid").withColumn("r", F.row_number().over(W.partitionBy("uid", "w").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k)
        got = best.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("w", "r", "score", "id"))).alias("got"))
        mine = F.transform(F.sequence(F.lit(0), F.size("windows") - 1), lambda w: F.transform(F.filter(F.coalesce("got", F.array()), lambda g: g["w"] == w), lambda g: F.struct(g["score"].alias("score"), g["id"].alias("id"))))
        after = open_.drop("found", "leaves").join(got.hint("merge"), "uid", "left").select(*cols, mine.cast(FOUND).alias("found"), "cursor")
        state = _one_batch(spark, BATCH, lambda: written(after, "found"))  # noqa: B023
        step *= GROWTH


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``vectors(id, label, vec)``, vec of whole numbers.

    Anchors are the rows for which ``anchor`` (over id, label, vec) is true; positives the first other rows of their label; negatives the
    first ``k`` rows of other labels whose score is from ``low`` to ``high`` percent of the positive's. Rows with a null id,
    label, vector or component take no part; rows that repeat in all three count once, others of one id each for itself. Vectors of
    different lengths end in zeros; other columns are ignored, whatever their names. No rows, or none of another label, give none.
    Scores must fit a long.
    """
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vec", lambda x: x.isNotNull()), F.lit(False))
    rows = written(vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<long>").alias("vec")).where(good).distinct(), "rows")
    index = build(rows, max(positives + 1, k))
    any_score = F.array(F.struct(F.lit(-(2**63)).cast("long").alias("lo"), F.lit(2**63 - 1).cast("long").alias("hi")))
    anchors = written(rows.where(anchor).select(F.monotonically_increasing_id().alias("uid"), "*"), "asked")
    first = written(search(index, anchors.withColumn("windows", any_score), positives, True).select("uid", "id", "label", "vec", F.explode(F.get("found", F.lit(0))).alias("p")), "positives")
    # percent of whole numbers, rounded inwards
    part = lambda f, percent: F.expr(f"cast({f}(cast(p.score as decimal(20,0)) * {percent} / 100) as bigint)")
    asked = written(first.select("*", part("ceil", low).alias("lo"), part("floor", high).alias("hi")).where("lo <= hi"), "windows")
    windows = asked.groupBy("uid").agg(F.first("id").alias("id"), F.first("label").alias("label"), F.first("vec").alias("vec"), F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("windows"))
    found = search(index, windows, k, False).select("uid", F.explode(F.arrays_zip("windows", "found")).alias("x")).select("uid", F.col("x.windows.lo").alias("lo"), F.col("x.windows.hi").alias("hi"), F.posexplode("x.found").alias("r", "n"))
    met = asked.select("uid", "id", "p", "lo", "hi").join(found.hint("merge"), ["uid", "lo", "hi"])
    return met.select(F.col("id").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("r") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vectors(id, label, vec)`` with floor(scale * x) for each component; vectors with a null or non-finite one become null."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.withColumn("vec", F.when(finite, F.transform("vec", lambda x: F.floor(x.cast("double") * scale).cast("long"))))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vec"))
    return hard_negatives(whole_numbers(rows), F.col("id") % EVERY == 0)


OP12_SQL = """with r as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as anchor_id, b.id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score from r a join r b on a.id % 50 = 0 and a.id <> b.id),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id)::int as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3"""
