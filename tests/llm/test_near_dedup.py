"""``keep_one`` against all pairs of shingle sets."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_ops import VOCAB, docs, odd, prose  # noqa: F401
from wayspark.llm import simhash_dedup


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) if a or b else True


def edited(r, text, share):
    return " ".join(f"z{r.random()}" if r.random() < share else w for w in text.split())


def test_groups_are_those_of_all_pairs(spark, odd):  # noqa: F811
    r = random.Random(2)
    base = [prose(r.choice([3, 60, 150, 400])) for _ in range(40)]
    texts = base + [edited(r, r.choice(base), r.choice([0.004, 0.01, 0.02, 0.1])) for _ in range(160)] + base[:5] + [base[0].upper(), None, "", " \n", "one", "ONE"]
    texts += [edited(r, base[7], 0.002) for _ in range(60)]  # a large group of near copies
    sets = [shingles(t) for t in texts]
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if alike(sets[i], sets[j])]
    for i, j in links:
        a, b = sorted((root(i), root(j)))
        comp[b] = a
    kept = {x.doc_id for x in simhash_dedup.keep_one(docs(spark, texts)).collect()}
    want = {i for i in range(len(texts)) if root(i) == i}
    assert want <= kept and len(kept - want) <= 0.05 * (len(texts) - len(want))
    out = simhash_dedup.keep_one(odd)
    assert out.columns == odd.columns and out.groupBy("doc_id").count().where("count > 1").count() == 0
    assert simhash_dedup.keep_one(odd.limit(0)).count() == 0


def pairs_at(seed, n):
    """Texts of a generator of their own, two by two of a similarity of 0.8 to 0.84."""
    r, texts = random.Random(seed), []
    while len(texts) < 2 * n:
        a = " ".join(r.choice(VOCAB) for _ in range(200))
        b = edited(r, a, 0.021)
        j = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        if 0.8 <= j < 0.84:
            texts += [a, b]
    return texts


def test_pairs_of_just_the_similarity_are_met(spark):
    """Recall of single pairs of a similarity of 0.8 to 0.84, without help from other members of a group."""
    texts = pairs_at(9, 300)
    kept = simhash_dedup.keep_one(docs(spark, texts)).count()
    print("met", (len(texts) - kept) / (len(texts) / 2))
    assert kept <= len(texts) / 2 * 1.05


@pytest.mark.parametrize("n", [2_000, 2_000_000, 200_000_000])
def test_recall_at_three_widths(n):
    """The drawn planes of other numbers of documents: how many pairs share a segment but for one bit, and pass the check."""
    how = simhash_dedup.Sketch.sized(n, 0.8, 0.98)
    texts = pa.array(pairs_at(n, 400))
    planes, bits = how.planes(), []
    for lo, hi, gram, row in simhash_dedup._shingle_sets(texts, 5):
        cells = np.zeros((hi - lo, how.CELLS))
        np.add.at(cells, (row, (gram >> np.uint64(54)).astype(int)), np.where(gram & np.uint64(1), 1.0, -1.0))
        bits.append(cells @ planes > 0)
    bits = np.concatenate(bits)
    differ = bits[::2] != bits[1::2]
    segments = differ[:, 64 * how.CHECKS :].reshape(len(differ), how.tables, how.width).sum(2)
    met = (segments.min(1) <= 1) & (differ[:, : 64 * how.CHECKS].sum(1) <= how.distance(0.8))
    print(how, "met", met.mean())
    assert met.mean() >= 0.95


def nearly_alike(n):
    """Copies of one text, each with edits of its own: pairs of them are 0.6 to 0.75 alike, no two 0.8."""
    r = random.Random(4)
    base = [r.choice(VOCAB) + str(i) for i in range(150)]
    texts = []
    for k, at in enumerate(r.sample(list(itertools.combinations(range(4, 146, 8), 3)), n)):
        texts.append(" ".join(f"own{k}x{i}" if i in at else w for i, w in enumerate(base)))
    return texts


def test_copies_not_quite_alike_are_not_met_in_pairs(spark, monkeypatch):
    """Parities tell short texts apart before pairs are made."""
    texts, made, write = nearly_alike(300), {}, simhash_dedup.written

    def seen(df, name, *codec):
        out = write(df, name, *codec)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash_dedup, "written", seen)
    assert not any(alike(a, b) for a, b in itertools.combinations([shingles(t) for t in texts], 2))
    assert simhash_dedup.keep_one(docs(spark, texts)).count() == 300 and made["candidates"] <= 0.02 * 300 * 299 / 2


def test_parities_lose_no_pair():
    """Sets differ in no more parities than shingles, so what is alike always passes."""
    how, texts = simhash_dedup.Sketch.sized(1000, 0.8, 0.98), pairs_at(5, 100)
    sets = []
    for lo, hi, gram, row in simhash_dedup._shingle_sets(pa.array(texts), 5):
        sets += [set(gram[row == i].tolist()) for i in range(hi - lo)]
    odd = simhash_dedup.sketched(pa.array(texts), how, 5).field("odd").to_pylist()
    for i in range(0, len(texts), 2):
        differ = sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(odd[i], odd[i + 1]))
        assert differ <= len(sets[i] ^ sets[i + 1]) <= (len(sets[i]) + len(sets[i + 1])) / 9 + 1e-6


@pytest.mark.parametrize("n", [310, 325])
def test_texts_on_both_sides_of_short_meet(spark, n):
    """A text a little longer and one a little shorter than the longest short one."""
    r = random.Random(n)
    base = [f"{r.choice(VOCAB)}{i}" for i in range(n)]
    texts = [" ".join(base), " ".join(base[: n - 12]), " ".join(base + [f"more{i}" for i in range(12)])]
    assert [x.doc_id for x in simhash_dedup.keep_one(docs(spark, texts)).collect()] == [0]


def test_texts_are_not_shuffled(spark):
    """What is kept is looked up in bits, whatever the size of the tables."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = nearly_alike(10)
        out = simhash_dedup.keep_one(docs(spark, texts))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [row_key" not in plan and "BroadcastHashJoin [shiftright(row_key" in plan
        assert out.count() == len(texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("n", [2_000, 2_000_000, 200_000_000])
def test_recall_of_segments_as_they_are(n):
    """As above, of pairs that have a segment in common."""
    how = simhash_dedup.Sketch.sized(n, 0.8, 0.98)
    got = simhash_dedup.sketched(pa.array(pairs_at(n + 1, 400)), how, 5)
    keys, check = (np.array(got.field(c).to_pylist(), dtype=np.int64).view(np.uint64) for c in ("keys", "check"))
    far = np.bitwise_count(check[::2] ^ check[1::2]).sum(1)
    met = (keys[::2] == keys[1::2]).any(1) & (far <= how.distance(0.8))
    print(how, "met", met.mean())
    assert met.mean() >= 0.95
