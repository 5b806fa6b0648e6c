"""Cases in which an operator once did less than its whole job."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_ops import docs, prose
from wayspark.llm import mixing, registry

SF = "/root/testdata/sf0.001"


def test_repeats_are_placed_and_untaken_documents_stand_last(spark):
    d = docs(spark, [prose(20) for _ in range(60)]).withColumn("source", F.when(F.col("doc_id") < 40, "a").when(F.col("doc_id") < 50, "b").otherwise("c"))
    size = {r.doc_id: r.taken for r in mixing.mix(d).collect()}
    rows = corpus_pipeline.mixed(spark, d, "").collect()
    placed = [r for r in rows if r.position is not None]
    assert rows[: len(placed)] == placed and all(r.taken == 0 and r.epoch is None for r in rows[len(placed) :])
    assert {r.doc_id for r in rows[len(placed) :]} == {i for i, t in size.items() if not t} != set()
    assert [r.position for r in placed] == sorted(r.position for r in placed)
    assert {r.epoch for r in placed} == {0, 1, 2} and all(r.size == (0 if r.epoch else 20) for r in placed)
    for i, t in size.items():
        mine = sorted((r.epoch, r.position, r.taken) for r in placed if r.doc_id == i)
        assert sum(m[2] for m in mine) == t and [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1] for m in mine] == sorted({m[1] for m in mine})


def test_op9_order_is_its_sql(spark):
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    got = [tuple(r) for r in registry.QUERIES["op9_mixing_order"](spark, SF).collect()]
    want = duckdb.sql(registry.ORACLES["op9_mixing_order"]).fetchall()
    assert [g[0] for g in got] == sorted(g[0] for g in got)
    got, want = (sorted(x, key=lambda r: (r[1], r[3])) for x in (got, want))
    assert [g[1:] for g in got] == [w[1:] for w in want] and [g[0] for g in got] == pytest.approx([w[0] for w in want], abs=2e-9)
    words = {}
    for g in got:
        words[g[1]] = words.get(g[1], 0) + g[4]
    once = registry.QUERIES["op9_mixing"](spark, SF).collect()
    assert {r.doc_id: r.taken for r in once if r.taken} == words
