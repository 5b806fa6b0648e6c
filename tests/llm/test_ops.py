"""The training-data operators against brute force, and on nulls, empty tables, repeats and odd columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayspark.llm import decontamination, language_id, mixing, quality_classifier, quality_rules, secrets, simhash_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCAB = [a + b for a in ("ba", "ko", "mi", "tu", "se") for b in ("l", "ran", "pe", "dix", "o", "ur")]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", "   \n\t ", "one", prose(40), prose(40), "é" * 50, "x" * 30_000, prose(4000), "ſ K straße"]


@pytest.fixture(scope="module")
def odd(spark):
    d = docs(spark, ODD)
    more = d.where("doc_id = 4").unionByName(spark.createDataFrame([(None, "no id here", None, None, None)], DOCS))
    return d.unionByName(more).withColumn("uid", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("kind", F.lit(2)).withColumn("size", F.lit("y"))


def simhash(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_brute_force(spark, odd):
    base = [prose(60) for _ in range(6)]
    texts = ODD + base + [b + " end" for b in base] + [" ".join(w if rng.random() > 0.02 else "zz" for w in b.split()) for b in base for _ in range(3)] + [base[0]] * 3
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(docs(spark, texts)).collect()}
    fp = [simhash(t) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if bin(fp[i] ^ fp[j]).count("1") <= 4:
                comp[i] = comp[j] = min(comp[i], comp[j])
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == fp
    assert [got[i].component_id for i in range(len(texts))] == comp
    kept = simhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.groupBy("doc_id").count().where("count > 1").count() == 0
    assert simhash_dedup.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("cut", [None, *simhash_dedup.CUTS])
def test_links_are_complete(spark, cut):
    r = np.random.default_rng(3)
    fps = [int(x) for x in r.integers(-(2**63), 2**63, 300)]
    for f in fps[:150]:
        for k in range(1, 7):
            g = f
            for b in r.choice(64, k, replace=False):
                g ^= 1 << int(b)
            fps.append((g + 2**63) % 2**64 - 2**63)
    fps = sorted({(f + 2**63) % 2**64 - 2**63 for f in fps})
    got = {(a, b) for a, b in simhash_dedup.links(spark.createDataFrame([(f,) for f in fps], "fp long"), cut=cut).collect()}
    want = {(a, b) for a, b in itertools.combinations(fps, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    assert got == want


def contaminated(text, items):
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, ids = w(text), set(), set()
    for i, t in items:
        iw = w(t)
        n = min(13, len(iw))
        for s in range(len(iw) - n + 1) if iw else ():
            for p in range(len(own) - n + 1):
                if own[p : p + n] == iw[s : s + n]:
                    hit |= set(range(p, p + n))
                    ids.add(str(i))
    return len(own), len(hit), ",".join(sorted(ids))


@pytest.mark.parametrize("many", [False, True])
def test_decontamination_brute_force(spark, odd, many, monkeypatch):
    if many:  # fingerprints too many to be broadcast
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 1)
    items = [(3, prose(30)), (20, prose(13)), (1, prose(15).upper()), (7, "rare tulip bulbs"), (8, "solo"), (9, None), (10, ""), (20, prose(13)), (11, "ba ba ba ba ba ba ba ba ba ba ba ba ba ba")]
    texts = ODD + [prose(20) + ", " + items[0][1][:140] + ". " + prose(9), items[1][1], "x " + items[2][1].lower() + " y", "some RARE tulip bulbs, solo", items[1][1][:-4], ("ba " * 40).strip()] + [prose(25) for _ in range(4)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contamination(docs(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        n, hit, ids = contaminated(t, items)
        assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (n, hit, ids), i
        assert got[i].contaminated == (hit > 0 and 20 * hit >= n)
    kept = decontamination.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert decontamination.drop_contaminated(odd, bench.limit(0)).count() == odd.count()
    assert decontamination.contamination(odd.limit(0), bench).count() == 0


def test_quality_rules(spark, odd):
    line = "the same line of words again and again"
    texts = ["short", "\n".join([line] * 30), prose(40), "# $ % & " * 10 + prose(10), "LOUD WORDS " * 10, None]
    r = {x.doc_id: x for x in quality_rules.ledger(docs(spark, texts)).collect()}
    assert r[1].n_repeat_words == 240 and r[1].n_dup_lines == 29 and r[3].n_symbols == 40
    bit = quality_rules.BIT
    assert r[0].fail_bits == bit["few_words"] == r[5].fail_bits and r[1].fail_bits & bit["dup_lines"] and r[2].fail_bits == 0
    assert r[4].fail_bits & bit["shouting"]
    led = quality_rules.ledger(docs(spark, texts))
    a = {x.rule: x for x in quality_rules.ablations(led, quality_rules.POLICIES["v2"]).collect()}
    assert a["few_words"].n_only == 2 and a["few_words"].n_kept_without == 3
    assert quality_rules.ledger(odd).count() == odd.count()
    w = texts[1].split()
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    assert len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}) == 240


def test_mixing(spark, odd):
    texts = [prose(rng.randint(0, 90)) for _ in range(200)] + [None, ""]
    d = docs(spark, texts).withColumn("source", F.when(F.col("doc_id") < 150, "big").when(F.col("doc_id") < 160, "é").when(F.col("doc_id") < 195, "mid"))
    rows = mixing.mix(d).collect()
    assert len(rows) == 202 and all(0 <= r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert sum(r.taken for r in v) == round(v[0].target) and v[0].target <= 3 * v[0].source_size
    assert sorted(map(str, mixing.mix(d.repartition(7)).collect())) == sorted(map(str, rows))
    order = mixing.by_position(mixing.mix(d)).collect()
    assert sum(r.words for r in order) == sum(r.taken for r in rows) and [r.position for r in order] == sorted(r.position for r in order)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0


def test_secrets_link(spark, odd):
    key = "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dF3gH5"
    texts = [
        f"key_id: svc.bot\nvalue {key} at https://vault.example/x",
        f"only {key} here",
        f"client_id=abc {'.' * 300} {key}",
        'é password = "hunter22" token: ab AKIA' + "Q" * 16 + " AKIAQQQQQ " + "0af" * 9,
    ]
    got = {r.doc_id: [(secrets.KINDS[p.kind], p.start, p.end) for p in r.parts] for r in secrets.find(docs(spark, texts)).collect()}
    assert [k for k, _, _ in got[0]] == ["weak_id", "weak_secret", "weak_endpoint"]
    assert got[1] == [] and got[2] == []
    assert [(k, texts[3][a:b].split()[0]) for k, a, b in got[3]] == [("assign", "password"), ("access", "AKIA" + "Q" * 16), ("weak_id", "AKIAQQQQQ"), ("hex", "0af" * 9)]
    masked = {r.doc_id: r for r in secrets.redact(docs(spark, texts)).collect()}
    assert key not in masked[0].text and key in masked[1].text and masked[3].text.startswith('é [SECRET]" token: ab') and masked[3].n_chars == len(masked[3].text)
    assert secrets.find(odd).count() == odd.count() and secrets.redact(odd).columns == odd.columns and secrets.redact(odd).count() == odd.count()


def test_classifier(spark, odd):
    good, bad = [prose(30) for _ in range(80)], [" | ".join(prose(30).split()) for _ in range(80)]
    d = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    m = quality_classifier.fit(d, labels)
    got = quality_classifier.classify(d, m).collect()
    assert np.mean([r.predicted == (r.doc_id < 80) for r in got]) > 0.97
    scored = quality_classifier.classify(odd, m)
    assert scored.count() == odd.count() and scored.where("score between 0 and 1").count() == odd.count()
    none = quality_classifier.fit(d, labels.limit(0))
    assert {r.score for r in quality_classifier.classify(odd, none).collect()} == {0.5}


def test_language_id(spark, odd):
    en, de = "the quick brown fox jumps over lazy dogs while it rains", "der schnelle braune fuchs springt über faule hunde weil es regnet"
    d = spark.createDataFrame([(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(20)] + [(50, None, "en"), (51, "words", None)], "doc_id long, text string, lang string")
    m = language_id.fit(d)
    assert m.languages == ["de", "en"] and np.allclose(m.probabilities.sum(axis=1), 1)
    ask = spark.createDataFrame([(1, "The lazy fox rains"), (2, "Über hunde springt der fuchs"), (3, None), (4, "123 -- 😀"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.label(ask, m).collect()}
    assert (got[1][0], got[2][0]) == ("en", "de") and got[3] == got[4] == got[5] == ("und", 0.0)
    assert language_id.label(odd, m).count() == odd.count()
    assert {r.lang_pred for r in language_id.label(ask, language_id.fit(d.limit(0))).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    v = language_id.vocabulary()
    p = np.random.default_rng(0).random((2, v.size + 1))
    p[:, -1] = 0
    p /= p.sum(axis=1, keepdims=True)
    number = {}
    for w in (b" the", " straße".encode(), b" abcabc"):
        for i, j in itertools.combinations(range(len(w) + 1), 2):
            ids = language_id._pieces(np.frombuffer(w[i:j], dtype=np.uint8)[None, :], v)
            number[w[i:j]] = int(ids[j - i - 1, j - i - 1, 0]) if j - i <= language_id.MAX_PIECE else v.size
        total = np.zeros(2)
        for cuts in itertools.product((0, 1), repeat=len(w) - 1):
            at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(w)]
            total += np.prod([p[:, number[w[a:b]]] for a, b in zip(at[:-1], at[1:])], axis=0)
        assert np.allclose(language_id._forward(np.frombuffer(w, dtype=np.uint8)[None, :], v, p)[0], np.log(total))


def test_sha_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
