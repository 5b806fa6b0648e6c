"""The trained operators: fitting against plain versions, and held-out results."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.test_ops import docs, odd, prose  # noqa: F401
from wayspark.llm import language_id, quality_classifier, registry

SF = "/root/testdata/sf0.01"


def test_classifier_held_out(spark):
    got = registry.QUERIES["op1_quality_classifier"](spark, SF)
    rows = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.predicted for r in good]) > 0.99 and np.mean([r.predicted for r in bad]) < 0.3
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) > 0.95


def test_classifier_scores_are_sparse_dot_products(spark):
    texts = [prose(20), "A b, c!", "", None, "é " * 9, prose(3000)]
    r = np.random.default_rng(1)
    m = quality_classifier.Model(r.normal(size=1 << quality_classifier.LOG2_SLOTS), 0.25)
    got = {x.doc_id: x.score for x in quality_classifier.classify(docs(spark, texts), m).collect()}
    for i, (slots, values) in enumerate(quality_classifier._sparse(pa.array(texts, type=pa.string()))):
        assert np.isclose(got[i], 1 / (1 + np.exp(-(m.weights[slots] @ values + 0.25))))


def plain_features(text):
    """{slot: value} of a text by a dictionary: words and marks, and pairs of neighbours, hashed with whole numbers."""
    full, p = 2**64 - 1, 0x9E3779B97F4A7C15

    def mix(h):
        h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & full
        return h ^ (h >> 29)

    low = re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    h = [mix(sum((b + 1) * pow(p, i, 2**64) for i, b in enumerate(w)) & full) for w in re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff \t-\r]+", low)]
    n = Counter(x >> (64 - quality_classifier.LOG2_SLOTS) for x in h + [mix((a * 31 + b) & full) for a, b in zip(h, h[1:])])
    return {slot: c * quality_classifier.SCALE / n.total() for slot, c in n.items()}


def test_features_are_a_plain_dictionary():
    texts = [prose(30), "Ab ab, AB!! x-y 12é3", "", None, "one", "é " * 9, "\t a\n\nb ", prose(2000)]
    for text, (slots, values) in zip(texts, quality_classifier._sparse(pa.array(texts, type=pa.string()))):
        want = plain_features(text)
        assert dict(zip(slots.tolist(), values.tolist())) == want


def test_ftrl_is_a_plain_loop():
    """Per-coordinate follow-the-regularised-leader with dictionaries, one example after another."""
    r, alpha, beta, l1, l2 = np.random.default_rng(2), 1.0, 1.0, 0.002, 0.002
    labels = r.integers(0, 2, 40).astype(float)
    rows = [plain_features(prose(12) + (" good" if y else " bad!")) for y in labels]
    z, n, last = Counter(), Counter(), 1 << quality_classifier.LOG2_SLOTS

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for row, y in zip(rows, labels):
            x = row | {last: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    got = quality_classifier.ftrl([(np.array(list(x)), np.array(list(x.values()))) for x in rows], labels, 3)
    want = {i: weight(i) for i in z}
    assert all(np.isclose(got[i], w, atol=1e-9) for i, w in want.items())
    assert not np.delete(got, list(want)).any() and np.abs(got).max() > 0.1


def test_classifier_fit_cases(spark, odd):  # noqa: F811
    d = docs(spark, [prose(30) for _ in range(20)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 1), (None, 1), (4, None), (99, 1)], "doc_id long, quality int")
    one = quality_classifier.fit(d, labels)
    again = quality_classifier.fit(d.unionByName(d).repartition(5), labels.unionByName(labels))
    assert np.array_equal(one.weights, again.weights) and one.bias == again.bias
    few = quality_classifier.fit(d, labels.where("doc_id = 0"))  # one shard of four has rows
    assert np.abs(few.weights).max() > 0 and np.isfinite(few.weights).all()
    assert quality_classifier.fit(d.limit(0), labels).bias == 0
    assert quality_classifier.classify(odd.limit(0), one).count() == 0 and quality_classifier.keep_good(odd, one).columns == odd.columns


def test_language_words(spark):
    texts = ["Straße, don't 12x", "日本語テキスト。中文 字" + "中" * 50, "naïve été Ωμ-мир", None, "", "́a 😀b"]
    got = {r.doc_id: r.w for r in docs(spark, texts).select("doc_id", language_id.word_list(F.col("text")).alias("w")).collect()}
    assert got[0] == ["straße", "don", "t", "x"] and got[2] == ["naïve", "été", "Ωμ", "мир"] and got[3] == got[4] == [] and got[5] == ["a", "b"]
    assert got[1][:4] == ["日本語", "テキスト", "中文", "字" + "中" * 23] and "".join(got[1][3:]) == "字" + "中" * 50


def test_expected_counts_are_sums_over_segmentations():
    v = language_id.vocabulary()
    p = np.random.default_rng(2).random((1, v.size + 1))
    p[:, -1] = 0
    p /= p.sum()
    words = ["the", "aße", "abab"]
    got = language_id._expected(pd.DataFrame({"lang": ["x"] * 3, "word": words, "n": [1, 2, 3]}), language_id.Model(["x"], v, p))
    want = {}
    for word, n in zip(words, (1, 2, 3)):
        w = b" " + word.encode()
        total, own = 0.0, {}
        for cuts in itertools.product((0, 1), repeat=len(w) - 1):
            at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(w)]
            ids = [int(language_id._pieces(np.frombuffer(w[a:b], dtype=np.uint8)[None, :], v)[b - a - 1, b - a - 1, 0]) for a, b in zip(at, at[1:])]
            if v.size not in ids:
                q = np.prod(p[0, ids])
                total += q
                for i in ids:
                    own[i] = own.get(i, 0) + q
        for i, q in own.items():
            want[i] = want.get(i, 0) + n * q / total
    assert {r.piece: r.uses for r in got.itertuples()}.keys() == want.keys()
    assert all(np.isclose(r.uses, want[r.piece]) for r in got.itertuples())


def test_rare_languages_are_learned_and_held_out_rows_predicted(spark):
    rare = spark.createDataFrame([(10**6 + i, f"γεια σου κόσμε {i} καλημέρα", "el") for i in range(3)], "doc_id long, text string, lang string")
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").unionByName(rare)
    m = language_id.fit(d, per_language=40)
    assert m.languages == ["de", "el", "en", "es", "fr"]
    got = registry.QUERIES["op6_language_id"](spark, SF).where("held_out").join(d, "doc_id").where("lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_unspaced_texts_are_not_slow(spark):
    import time

    v = language_id.vocabulary()
    m = language_id.Model(["a", "b"], v, np.full((2, v.size + 1), 1 / v.size))
    r = np.random.default_rng(5)
    took = []
    for text in (" ".join(prose(4000).split()), "".join(chr(c) for c in r.integers(0x4E00, 0x9000, 8000))):
        scorer, start = language_id._Scorer(m), time.process_time()
        scorer.texts(pa.array([text]))
        took.append(time.process_time() - start)
    print(took)
    assert took[1] < 12
