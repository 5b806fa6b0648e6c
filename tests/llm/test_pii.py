"""Base spans against Python's re, the bootstrap against a plain version, and planted identifiers."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.test_ops import docs, odd  # noqa: F401
from wayspark.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    own = [int(c) for c in reversed(digits)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(own)) % 10 == 0


def base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".") if p) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def plain(texts):
    """All spans of all texts, by sets and loops."""
    instances = []
    for i, text in enumerate(texts):
        spans = base(text)
        tokens = list(re.finditer(r"[^ \t-\r]+", text or ""))
        for k, m in enumerate(tokens):
            if not re.search("[0-9@]", m[0]):
                continue
            starts = sorted((a, text[a:b]) for _, a, b in spans if m.start() <= a < m.end())
            near = [re.sub("[0-9]", "0", re.sub("[A-Z]", lambda x: x[0].lower(), t[0])) for t in tokens[max(0, k - 2) : k]]
            one, two = (near[-1] if near else "^"), (near[-2] if len(near) > 1 else "^")
            patterns = {one} if one == "^" else {one, f"{two} {one}"}
            lead = len(re.match("[^A-Za-z0-9+]*", m[0])[0])
            bare = re.sub(r"(?<=[A-Za-z0-9])[^A-Za-z0-9]+$", "", m[0][lead:])
            if starts:
                instances.append((i, None, None, starts[0][1], patterns, True))
            elif not any(a < m.end() and m.start() < b for _, a, b in spans):
                instances.append((i, m.start() + lead, m.start() + lead + len(bare), bare, patterns, False))
    follows = collections.defaultdict(set)
    for *_, value, patterns, _seed in instances:
        for p in patterns:
            follows[p].add(value)
    # a value is a seed only where it is one
    seeds = {x[3] for x in instances if x[5]}
    known = set(seeds)
    while True:
        good = {p: len(v & known) / len(v) for p, v in follows.items() if len(v & known) >= 3 and len(v & known) >= 0.5 * len(v)}
        new = set()
        for v in {x[3] for x in instances} - known:
            rest = 1.0
            for p, own in follows.items():
                if v in own and p in good:
                    rest *= 1 - good[p]
            if 1 - rest >= 0.6 and len(re.sub("[^0-9]", "", v)) >= 4:
                new.add(v)
        if not new:
            break
        known |= new
    found = known - seeds
    return [sorted(base(t), key=lambda s: (list(BASE).index(s[0]), s[1])) + sorted(("context", a, b) for j, a, b, v, _, seed in instances if j == i and not seed and v in found) for i, t in enumerate(texts)]


def spans(spark, texts):
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(docs(spark, texts)).collect()}
    return [got[i] for i in range(len(texts))]


def test_base_spans_on_random_texts(spark):
    r = random.Random(11)
    bits = ["a@b.c", "@", ".", "..", "-", "+", " ", "\n", "é", "😀", "(", ")", "1", "25", "256", "0", "10.0.0.1", "4111111111111111", "4111 1111 1111 1111", "+1 202 555 0147", "x", "Z_", "%", "a.b", "@x.y", "77-77", "\x1f"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400)]
    texts += ["a@b.c_d@e.f 1.2.3.4.5 999.1.1.1 " + "7" * 5000, None, "", "1" * 20_000, "+" * 5000, "a." * 5000, "1." * 5000, "\x00 a@b.c"]
    for text, got in zip(texts, spans(spark, texts)):
        assert [s for s in got if s[0] != "context"] == base(text), text and text[:80]


def planted(r, n):
    """Texts in which identifiers of a form no base pattern knows follow the contexts of those it does, with the
    spans that should be found, and numbers in other contexts."""
    forms = [lambda: f"{r.randint(100, 999)}-{r.randint(10000, 99999)}-k", lambda: f"zx{r.randint(10**6, 10**7)}", lambda: f"{r.choice('ABC')}{r.randint(1000, 9999)}/{r.randint(100, 999)}"]
    cues = ["write me at", "my contact is", "Account holder number:", "pays with card"]
    fill = "the red boat went over a calm sea while birds sang".split()
    texts, want = [], []
    for i in range(n):
        known = i % 3 > 0
        value = r.choice([f"u{i}@host{i}.org", f"10.{i % 250}.{r.randint(0, 255)}.7", f"+1 (202) 555-{1000 + i}"]) if known else r.choice(forms)()
        before = " ".join(r.choice(fill) for _ in range(r.randint(0, 9))) + " " + r.choice(cues) + " "
        texts.append(before + value + " " + r.choice(fill))
        want.append([] if known else [(len(before), len(before) + len(value))])
        texts.append(f"in the year {r.randint(1000, 2999)} boats cost {r.randint(1000, 99999)} or page {r.randint(1, 2000)} of it")
        want.append([])
    return texts, want


def test_planted_identifiers_are_found(spark):
    texts, want = planted(random.Random(3), 240)
    got = [[s[1:] for s in x if s[0] == "context"] for x in spans(spark, texts)]
    hits = sum(s in g for g, w in zip(got, want) for s in w)
    assert hits >= 0.9 * sum(map(len, want)) and hits >= 0.9 * sum(map(len, got)) > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_bootstrap_is_the_plain_one(spark, seed):
    r = random.Random(seed)
    cues = ["id", "mail to", "see", "no.", "the 12", ""]
    values = [f"m{i}@x.org" for i in range(6)] + [f"9{i}12-{i}" for i in range(12)] + ["7", "12", "(20255)", "+1 202 555 0147,", "chain0001", "chain0002"]
    texts = [" ".join(f"{r.choice(cues)} {r.choice(values)}" for _ in range(r.randint(1, 4))) for _ in range(80)] + [None, ""]
    # a second round: chain0002 is known only by a context that the first round's finds teach
    texts += [f"mail to m{i}@x.org" for i in range(6)] + ["mail to 55501", "mail to 55502", "mail to 55503", "ref 55501", "ref 55502", "ref 55503", "ref 77701", "so ref 77701"]
    assert spans(spark, texts) == plain(texts)


def test_odd_rows(spark, odd):  # noqa: F811
    assert pii.find(odd).count() == odd.count() and pii.find(odd.limit(0)).count() == 0
    assert pii.find(odd.withColumn("text", F.lit(None).cast("string"))).where("size(spans) > 0").count() == 0
