"""The pipeline against plain versions of its stages, on a small corpus with planted and odd rows."""

import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_secrets
from tests.llm.test_mixing import plain as plain_mix
from tests.llm.test_near_dedup import alike, shingles
from tests.llm.test_ops import contaminated, prose
from wayspark.llm import mixing, quality_classifier

#: Columns beyond those of documents, some with names that stages use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, uid int, position double, kind string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
KEY = "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dF3gH5"


def saved(spark, at, rows, labels, bench):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    bench = prose(30)
    good = [prose(60) for _ in range(60)]
    bad = [" | ".join(prose(60).split()) for _ in range(40)]
    texts = good + bad + [good[0], good[0].upper(), bench + " " + prose(20), prose(60) + " password=82da0c4f9f2588bda2 " + prose(5)]
    texts += [f"{prose(30)} client_id=svc.bot {prose(4)} {KEY} {prose(30)}", good[1] + " and one more", None, "", prose(9000)]
    row = lambda i, t, s: (i, t, "en", s, len(t) if t else None, "x", 1, 0.5, "y")
    rows = [row(i, t, f"s{i % 2}") for i, t in enumerate(texts)] + [row(5, texts[5], "s1"), row(None, prose(50), None), row(None, None, None)]
    labels = [(i, int(i < 60), 0) for i in range(100)] + [(None, 1, 0), (3, None, 0)]
    at = saved(spark, str(tmp_path_factory.mktemp("sf")), rows, labels, [(1, bench), (2, None), (3, "")])
    return at, rows, bench


def one_of_each(rows):
    """One row of each group of similar texts, as (leading id, text)."""
    sets, comp = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if alike(sets[i], sets[j]):
            a, b = sorted((root(i), root(j)))
            comp[b] = a
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r["doc_id"])
    return sorted((min((d is None, d or 0) for d in g) for g in groups.values()), key=str)


def masked(text):
    out, at = [], 0
    for _, a, b in test_secrets.plain(text):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return None if text is None else "".join(out) + text[at:]


def test_stages_are_the_plain_ones(spark, corpus):
    at, rows, bench = corpus
    docs, before = spark.read.parquet(f"{at}/documents.parquet"), None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, at)
        got = [r.asDict() for r in out.collect()]
        if i < 4:
            assert out.columns == COLUMNS
        if i == 0:
            labels = spark.read.parquet(f"{at}/labels.parquet")
            taught = labels.where(F.col("doc_id").isNotNull()).collect()
            model = quality_classifier.fit(docs, spark.createDataFrame([r for r in taught if zlib.crc32(str(r.doc_id).encode()) % 5], labels.schema))
            want = [r for r in quality_classifier.classify(docs, model).collect() if r.score >= 0.3]
            assert sorted((str(r.doc_id), r.text or "") for r in want) == sorted((str(r["doc_id"]), r["text"] or "") for r in got)
            kept = {r["doc_id"] for r in got}
            assert len(kept & set(range(60, 100))) <= 2 and set(range(60)) <= kept
        elif i == 1:
            assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in got), key=str) == one_of_each(before)
        elif i == 2:
            clean = [r for r in before if not ((n := contaminated(r["text"], [(1, bench)]))[1] > 0 and 20 * n[1] >= n[0])]
            assert sorted(map(str, clean)) == sorted(map(str, got)) and len(clean) == len(before) - 1
        elif i == 3:
            want = [{**r, "text": masked(r["text"])} for r in before]
            for r, b in zip(want, before):
                r["n_chars"] = len(r["text"]) if r["text"] != b["text"] else b["n_chars"]
            assert sorted(map(str, want)) == sorted(map(str, got)) and sum("[SECRET]" in (r["text"] or "") for r in got) == 2
        else:
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
            named = [(r["doc_id"], r["source"], size(r["text"])) for r in before if r["doc_id"] is not None]
            assert {g["doc_id"] for g in got} == {b["doc_id"] for b in before}
            assert sum(g["size"] for g in got) == sum(size(r["text"]) for r in before)
            if len(named) == len(before):
                placed = {(g["doc_id"], g["epoch"]): (g["position"], g["taken"]) for g in got if g["position"] is not None}
                want = plain_mix(named, mixing.TILT)
                assert placed.keys() == want.keys() and all(placed[k][1] == w[1] and placed[k][0] == pytest.approx(w[0], abs=1e-3) for k, w in want.items())
            positions = [g["position"] for g in got if g["position"] is not None]
            assert positions == sorted(positions)
        docs = spark.createDataFrame([tuple(g[c] for c in out.columns) for g in got], out.schema)
    run = corpus_pipeline.run(spark, at)
    assert sorted(map(str, run.drop("text_file").collect())) == sorted(map(str, docs.drop("text_file").collect()))
    # the texts that the result points to are the masked ones
    files = [r.text_file for r in run.select("text_file").distinct().collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(*files).collect()}
    assert {r.doc_id for r in run.collect()} == texts.keys() and sum("[SECRET]" in (t or "") for t in texts.values()) == 2
    assert not any(KEY in (t or "") or "82da0c4f9f2588bda2" in (t or "") for t in texts.values())


def test_empty_tables(spark, tmp_path_factory, corpus):
    nothing = saved(spark, str(tmp_path_factory.mktemp("none")), [], [], [])
    assert corpus_pipeline.run(spark, nothing).count() == 0
    _, rows, _ = corpus
    unlabelled = saved(spark, str(tmp_path_factory.mktemp("few")), rows[:5] + rows[-3:], [], [])
    assert corpus_pipeline.run(spark, unlabelled).count() >= 5


def test_no_oracle():
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][1] == "near-duplicates"
