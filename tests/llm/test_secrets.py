"""The scan and its links against a plain version, planted credentials, and long texts."""

import random
import re
import time

import pyarrow as pa

from tests.llm.test_ops import docs, odd  # noqa: F401
from wayspark.llm import secrets

FILL = "the red boat went over a calm sea while birds sang and 12 more came".split()


def parts(text):
    out = set()
    for m in re.finditer(secrets.ASSIGN, text, re.I | re.A):
        if len(m[2]) >= 4:
            out.add((m.start(), 0 if len(m[2]) >= 6 else 4, m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 8:
            out.add((m.start(), 1 if len(m[0]) >= 20 else 3, m.end()))
    for m in re.finditer("[0-9a-f]{16,}", text):
        out.add((m.start(), 2 if len(m[0]) >= 24 else 4, m.end()))
    for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text):
        if all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]")):
            out.add((m.start(), 4, m.end()))
    out |= {(m.start(), 3, m.end()) for m in re.finditer(secrets.NAMED_ID, text, re.I | re.A)}
    out |= {(m.start(), 5, m.end()) for m in re.finditer(secrets.ENDPOINT, text, re.I | re.A)}
    return sorted(out)


def plain(text):
    own = parts(text or "")
    role = lambda k: {1: "id", 3: "id", 5: "endpoint"}.get(k, "secret")
    keep = []
    for a, k, b in own:
        near = {role(j) for c, j, d in own if (c >= b or d <= a) and a - d <= 200 and c - b <= 200}
        if k < 3 or (k == 3 and "secret" in near) or (k == 4 and "id" in near) or (k == 5 and {"id", "secret"} <= near):
            keep.append((secrets.KINDS[k], a, b))
    return keep


def found(spark, texts):
    got = {r.doc_id: [(secrets.KINDS[p.kind], p.start, p.end) for p in r.parts] for r in secrets.find(docs(spark, texts)).collect()}
    return [got[i] for i in range(len(texts))]


def test_brute_force(spark):
    r = random.Random(8)
    bits = ["password: ab12", 'Token="x9"', "secret = q1w2e3r4", "AKIAABCD12", "AKIA" + "7Q" * 9, "0af3" * 4, "0af3" * 7, "aB3dE5gH7jK9mN1pQ3sT5", "user=bob", "client_id: 77-a", "login : é", "https://x.org/a?b", "jdbc:postgres://h:1/d", "host=db-1.local:5432", "é😀", ".", "\n", "x" * 60, " " * 90]
    texts = [" ".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(300)] + [None, ""]
    for text, got in zip(texts, found(spark, texts)):
        assert got == plain(text), text


def test_planted_credentials_are_found_and_lone_parts_are_not(spark):
    r = random.Random(4)
    fill = lambda n: " ".join(r.choice(FILL) for _ in range(n))
    key = lambda: "".join(r.choice("abcdefghijkmnpqrstuvwxyz") + r.choice("ABCDEFGHJKLM") + r.choice("23456789") for _ in range(8))
    texts, want = [], []
    for i in range(120):
        name, pin, host = f"user=app{i}", f"password: {r.choice('abc')}{i:03}", f"host=db{i}.internal:5432"
        case = i % 4
        own = [[name, pin, host], [f"client_id: c{i}", key()], [name, host], [key() if i % 8 == 3 else pin]][case]
        text, spots = fill(12), []
        for w in own:
            text += " "
            spots.append((len(text), len(text) + len(w)))
            text += w + " " + fill(5)
        texts.append(text + " " + fill(60))
        want.append(spots if case < 2 else [])
    got = [[s[1:] for s in x] for x in found(spark, texts)]
    hits = sum(s in g for g, w in zip(got, want) for s in w)
    assert hits == sum(map(len, want)) == sum(map(len, got)) > 100


def test_long_texts_take_linear_time():
    def took(n):
        text = pa.array(["é " + "0af39c" * 5 + "\n"]).to_pylist()[0] * n
        start = time.process_time()
        secrets._scan(pa.array([text]))
        return time.process_time() - start

    took(500)
    assert took(16_000) < 16 * max(took(4_000), 0.02)


def test_odd_rows(spark, odd):  # noqa: F811
    assert secrets.find(odd).count() == odd.count() == secrets.redact(odd).count() and secrets.redact(odd).columns == odd.columns
    assert secrets.find(odd.limit(0)).count() == 0 == secrets.redact(odd.limit(0)).count()
    twice = odd.unionByName(odd)
    assert secrets.find(twice).count() == twice.count()
