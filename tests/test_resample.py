"""Sixteen samples of every way, in the query and in its SQL."""

import duckdb

from __spark_entry__ import oracle_sql, queries


def test_samples_on_vertices(spark, tmp_path):
    """Ways of which a sample lies on a vertex, and the sums of the segments on both sides leave a gap of a last bit."""
    n = {w + 2440 * k: m for w, m in {5452: 64, 8349: 71, 23109: 71}.items() for k in range(200)}  # ways alike, each of other bits in a running sum
    con = duckdb.connect()
    con.sql("create table events as " + f"select w * 1000 + r as event_id, timestamp '2024-01-01' + interval (r) second as ts, w::bigint as user_id, 'view' as event_type, 1e0 as value, '{{}}' as props from (values {', '.join(map(str, n.items()))}) n(w, k), range(100) t(r) where r < k")
    con.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    want = con.sql(oracle_sql()["resample_polyline"]).fetchall()
    got = [tuple(r) for r in queries()["resample_polyline"](spark, str(tmp_path)).collect()]
    assert len(want) == 16 * len(n) and sorted(got) == sorted(want)
