"""Spelling variants against all pairs and a plain walk."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.test_ops import DOCS, odd  # noqa: F401
from wayspark.llm import spelling


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_variants_are_all_pairs(spark):
    r = random.Random(4)
    words = {"", "a", "b", "é", "ab", "ba"}
    for _ in range(60):
        w = "".join(r.choice("abcé") for _ in range(r.choice([1, 2, 3, 6, 7, 8, 13])))
        words.add(w)
        for _ in range(3):
            k = r.randrange(len(w))
            words |= {w[:k] + w[k + 1 :], w[:k] + r.choice("xyzß") + w[k:], w[:k] + r.choice("pqrÿ") + w[k + 1 :]}
    # a hot prefix, a hot suffix, and words that differ only in the middle
    words |= {"prefix" + "".join(p) for p in itertools.product("abcd", repeat=3)} | {"".join(p) + "suffix" for p in itertools.product("abc", repeat=4)}
    words |= {"middle" + c + d + "middle" for c in "abcdefghijklm" for d in "abcde"} | {"x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1500}
    df = spark.createDataFrame([(w,) for w in words] + [(None,), ("ab",)], "word string")
    want = {tuple(sorted((a, b), key=lambda w: (len(w), w))) for a, b in itertools.combinations(words, 2) if one_edit(a, b)}
    for block in (2_000, 4):
        got = [(x.a, x.b) for x in spelling.variants(df, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def plain(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += len(run) >= 6
    n = {w: c for w, c in n.items() if c >= 5}
    form, out = {}, {}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def test_groups_are_those_of_a_plain_walk(spark, odd):  # noqa: F811
    r = random.Random(8)
    base = ["".join(r.choice("abdeÀé") for _ in range(r.randint(6, 9))) for _ in range(40)]
    chain = ["voyage" + "s" * k for k in range(4)]
    words = base + [w[:2] + w[3:] for w in base] + [w[:4] + "Z" + w[4:] for w in base[:20]]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(60)]
    texts += [" ".join([w] * 5 * 6**k) for k, w in enumerate(chain)] + [None, "", "1 2", "ſtraße strasse"]
    rows = list(enumerate(texts)) + [(None, "TRAVELS, " * 7)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.variant_groups(spelling.damaged(spelling.runs(df))).collect()}
    want = plain(rows)
    assert got == want and want["voyage"][1] == "voyagesss"
    groups = spelling.variant_groups(spelling.damaged(spelling.runs(odd)))
    assert {x.word: x.n for x in groups.collect()} == {w: v[2] for w, v in plain([(x.doc_id, x.text) for x in odd.collect()]).items()}
    assert spelling.variant_groups(spelling.damaged(spelling.runs(odd.limit(0)))).count() == 0


@pytest.mark.parametrize("name", ["word", "n", "len", "head"])
def test_clashing_columns(spark, name):
    df = spark.createDataFrame([("seasons", "x")] * 5, "text string, y string").withColumnRenamed("y", name).selectExpr("1 as doc_id", "*")
    assert [x.word for x in spelling.variant_groups(spelling.damaged(spelling.runs(df))).collect()] == [x for x in plain([(1, "seasons")] * 5)]
