"""The curriculum against a plain version that walks along the token axis."""

import bisect
import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_ops import docs, odd, prose  # noqa: F401
from wayspark.llm import mixing


def plain(rows, tilt):
    """{(doc_id, epoch): (position, words)} by summing each source's schedule over small steps of time."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s))
    size = {s: sum(n for _, o, n in rows if o == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    total, fixed = sum(size.values()), {}
    while True:
        free = [s for s in sources if s not in fixed]
        rate = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if rate * weight[s] > 3 * size[s]]
        if not over:
            break
        fixed |= {s: 3 * size[s] for s in over}
    target = {s: fixed.get(s, rate * weight[s]) for s in sources}
    up = sum(target[s] for k, s in enumerate(sources) if k % 2 == 0)
    down = sum(target[s] for k, s in enumerate(sources) if k % 2)
    out, mixed = {}, []
    steps = 20_000
    for k, s in enumerate(sources):
        most = tilt * min(up, down) / (up if k % 2 == 0 else down) if min(up, down) else 0
        speed = [1 + (most if k % 2 == 0 else -most) * (2 * (i + 0.5) / steps - 1) for i in range(steps)]
        cum = [0.0]
        for v in speed:
            cum.append(cum[-1] + target[s] * v / steps)
        mixed.append(cum)
        at, goal = 0, round(target[s])
        stream = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, n) for i, o, n in rows if o == s)
        for epoch in range(3):
            for _, i, n in stream:
                words = max(0, min(n, goal - at))
                if words:
                    j = max(1, bisect.bisect_left(cum, at))
                    out[i, epoch] = ((j - 1 + (at - cum[j - 1]) / (cum[j] - cum[j - 1])) / steps, words)
                at += n
    # at any time the sources' demands add up to the words the mix has come to
    for i in range(0, steps + 1, 2500):
        assert sum(c[i] for c in mixed) == pytest.approx(sum(target.values()) * i / steps, rel=1e-3, abs=1)
    return out


def test_positions_brute_force(spark):
    sizes = [n % 37 for n in range(300)]
    d = docs(spark, [prose(n) for n in sizes]).withColumn("source", F.when(F.col("doc_id") < 200, "big").when(F.col("doc_id") < 210, "é").when(F.col("doc_id") < 290, "mid"))
    rows = [(r.doc_id, r.source, sizes[r.doc_id]) for r in d.select("doc_id", "source").collect()]
    want = plain(rows, mixing.TILT)
    got = {(r.doc_id, r.epoch): (r.position, r.words) for r in mixing.by_position(mixing.mix(d)).collect()}
    assert got.keys() == want.keys()
    for k, (position, words) in want.items():
        assert got[k][1] == words and got[k][0] == pytest.approx(position, abs=1e-3), k


def test_taken_follows_from_positions(spark):
    """The query's plan inverts demand: without positions there is nothing to take."""
    plan = mixing.mix(docs(spark, [prose(9)] * 5)).select("taken")._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT" in plan and "slope" in plan


def test_odd_rows(spark, odd):  # noqa: F811
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == sum(p.words for p in r.places) <= 3 * r.size for r in rows)
    nameless = spark.createDataFrame([(None, "a b c", "s"), (None, None, "s"), (None, "d e", None), (None, "a b c", "s")], "doc_id long, text string, source string")
    assert sorted(r.taken for r in mixing.mix(nameless).collect()) == sorted(r.taken for r in mixing.mix(nameless.repartition(3)).collect())
    assert mixing.mix(nameless.limit(0)).count() == 0
