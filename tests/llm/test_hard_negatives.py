"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayspark.llm import hard_negatives as hn

ROWS = "id long, label int, vec array<double>, uid string, leaf int"


def brute(rows, every=5):
    rows = list({(i, lab, tuple(v)): (i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}.values())
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in rows:
        if a[0] % every:
            continue
        scored = sorted(((-dot(a[2], b[2]), b[0], b[1]) for b in rows if b is not a))
        for s, i, _ in [x for x in scored if x[2] == a[1]][:5]:
            fit = [(t, j) for t, j, lab in scored if lab != a[1] and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a[0], i, k + 1, j, -s, -t) for k, (t, j) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "u", 0) for r in rows], ROWS)
    got = hn.hard_negatives(hn.whole_numbers(df), F.col("id") % 5 == 0)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(hn, "LEAF_ROWS", 16)
    monkeypatch.setattr(hn, "PACK", 8)


def test_brute_force(spark, small_leaves):
    """Clustered vectors of few dimensions, copies in plenty, ties, nulls, ragged lengths, repeated rows and ids."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 5))
    rows = [(i, int(r.integers(4)), np.round(centres[i % 6] + 0.3 * r.normal(size=5), 2).tolist()) for i in range(260)]
    rows += [(300 + i, i % 3, [0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(60)] + [(400 + i, 1, [0.0] * 5) for i in range(12)]
    rows += [(450, None, [1.0] * 5), (None, 1, [1.0] * 5), (455, 1, None), (460, 1, [1.0, None, 0.0, 0.0, 0.0]), (465, 1, [float("nan")] * 5), (470, 2, [float("inf")] * 5)]
    rows += [(475, 2, [1.0]), (480, 2, []), (0, 1, [0.3] * 5), rows[3], rows[5], rows[5], (5, 3, rows[5][2])]
    assert mined(spark, rows) == brute(rows)


def test_odd_tables(spark, small_leaves):
    assert mined(spark, []) == []
    assert mined(spark, [(5, 1, [0.5]), (6, 1, [0.5])]) == []
    assert mined(spark, [(5, 1, [1.0]), (6, 1, [1.0]), (7, 2, [0.9]), (8, 2, [0.99])]) == [(5, 6, 1, 7, 65536, 256 * 230)]


def test_scores_beyond_floats(spark):
    big = 3.0e7 / 256 * 4
    rows = [(5, 1, [big, 1 / 256]), (6, 1, [big, 3 / 256]), (7, 2, [big * 0.9, 1 / 256]), (8, 2, [big * 0.9, 2 / 256])]
    assert mined(spark, rows) == brute(rows)


def test_annulus_passes_over_leaves():
    """An anchor needn't visit leaves wholly outside its windows."""
    r = np.random.default_rng(1)
    x = np.rint(np.concatenate([r.normal(size=(400, 3)) + c for c in (np.array([9, 0, 0]), np.array([0, 9, 0]), np.array([-9, 0, 0]))]) * 256)
    top = float((x * x).sum(1).max())
    tree = hn.fit(x[::4], top, 3, 4)
    leaf, way = tree.route(x)
    near, far = np.full((16, 4), np.inf), np.full((16, 4), -np.inf)
    np.minimum.at(near, leaf, way)
    np.maximum.at(far, leaf, way)
    tree = hn.Tree(top, 3, 4, tree.pivots, tree.radius, near, far)
    best, least = tree.scores(x[:50])
    s = x[:50] @ x.T
    assert (s <= best[:, leaf]).all() and (s >= least[:, leaf]).all()
    assert ((best < 0.5 * s.max(1)[:, None]) | (best == -np.inf)).mean() > 0.4


def test_no_vectors_go_through_the_driver(spark, small_leaves):
    """Tables of vectors are small files and large arrays, so none is broadcast, however small it looks."""
    seen = lambda: {x.executionId(): x.physicalPlanDescription() for x in (lambda l: [l.apply(i) for i in range(l.size())])(spark._jsparkSession.sharedState().statusStore().executionsList())}
    before = seen().keys()
    r = np.random.default_rng(4)
    rows = [(i, i % 3, r.normal(size=4).round(2).tolist()) for i in range(60)]
    assert mined(spark, rows) == brute(rows)
    plans = [p for k, p in seen().items() if k not in before]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
