"""The ledger against a plain dictionary, broken-off and competing batches, and counts against the tokenizer."""

import random
import sys

import pytest

from tests.llm.test_ops import ODD, odd, prose  # noqa: F401
from wayspark.llm import registry, token_counts

SCHEMA = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, at long, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(*r[:6], r[6] if len(r) > 6 else None, "x") for r in rows], SCHEMA)


def totals(ledger):
    return sorted(((r.source, r.lang, r.tokenizer, r.n_docs, r.n_tokens) for r in ledger.totals().collect()), key=str)


def plain(batches):
    held, loose = {}, []
    for rows in batches:
        best = {}
        for r in rows:
            key = (r[1], r[4])
            if r[1] is None:
                loose += [(r[2], r[3], r[4], r[5] or 0)] if r[0] != "delete" else []
            elif key not in best or rank(r) > rank(best[key]):
                best[key] = r
        for key, r in best.items():
            held.pop(key, None)
            if r[0] != "delete":
                held[key] = (r[2], r[3], r[4], r[5] or 0)
    out = {}
    for *k, n in [*held.values(), *loose]:
        d, t = out.get(tuple(k), (0, 0))
        out[tuple(k)] = (d + 1, t + n)
    return sorted(((*k, *v) for k, v in out.items()), key=str)


def rank(r):
    return tuple((x is not None, x) for x in ((r[6] if len(r) > 6 else None), r[0] if r[0] in ("insert", "delete") else "revise", r[2], r[3], r[5] or 0))


def test_many_batches_are_the_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "COMPACT", 3)
    r, ledger, done = random.Random(6), token_counts.Ledger(spark), []
    assert totals(ledger) == []
    for b in range(7):
        rows = [(r.choice(["insert", "delete", "revise", None]), r.choice([None, *range(12)]), r.choice(["a", "b", None]), r.choice(["en", None]), r.choice(["t", "u", None]), r.choice([None, 0, 5, 9]), r.choice([None, 1, 2])) for _ in range(r.randint(0, 12))]
        assert ledger.commit(f"b{b}", frame(spark, rows)) and not ledger.commit(f"b{b}", frame(spark, rows))
        done.append(rows)
        assert totals(ledger) == plain(done), b
    head = ledger._head()
    assert head["snapshot"] and len(head["deltas"]) == 1 and ledger.committed() == [f"b{b}" for b in range(7)]
    held = ledger.documents().groupBy("source", "lang", "tokenizer").sum("n_docs", "n_tokens").collect()
    assert sorted((tuple(x) for x in held), key=str) == plain(done)


def test_a_broken_off_batch_leaves_nothing_and_can_be_committed(spark, monkeypatch):
    ledger = token_counts.Ledger(spark)
    one, two = frame(spark, [("insert", 1, "a", "en", "t", 10)]), frame(spark, [("revise", 1, "b", "en", "t", 7), ("insert", 2, "a", "en", "t", 1)])
    ledger.commit("one", one)
    with monkeypatch.context() as m:
        m.setattr(ledger, "_publish", lambda entry: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ledger.commit("two", two)
    assert totals(ledger) == [("a", "en", "t", 1, 10)] and ledger.committed() == ["one"]
    assert ledger.commit("two", two) and totals(ledger) == [("a", "en", "t", 1, 1), ("b", "en", "t", 1, 7)]


def test_of_two_writers_the_later_one_starts_anew(spark, monkeypatch):
    ledger, publish, asked = token_counts.Ledger(spark), token_counts.Ledger._publish, []

    def late(self, entry):
        if not asked:
            asked.append(1)
            other = token_counts.Ledger(spark, self.root)
            assert other.commit("other", frame(spark, [("insert", 1, "a", "en", "t", 4)]))
            assert other.commit("mine", mine) is True
        return publish(self, entry)

    mine = frame(spark, [("revise", 1, "b", "en", "t", 6)])
    monkeypatch.setattr(token_counts.Ledger, "_publish", late)
    assert ledger.commit("mine", mine) is False
    assert totals(ledger) == [("b", "en", "t", 1, 6)] and ledger.committed() == ["other", "mine"]


def test_counts_are_the_tokenizers(spark, odd):  # noqa: F811
    sys.path.insert(0, "/opt/tokenizers")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    own.encode_special_tokens = True
    texts = [t for t in ODD if t] + ["It's 12,345  spaces\n\n and über 日本語 😀 <|endoftext|>", prose(300)]
    d = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r.n_tokens for r in token_counts.counts(d).where(f"tokenizer = '{token_counts.BPE_VERSION}'").collect()}
    assert [got[i] for i in range(len(texts))] == [len(own.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.counts(odd).count() == 2 * odd.count() and token_counts.counts(odd.limit(0)).count() == 0


def test_query_is_a_recount(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in registry.QUERIES["op4_token_counts"](spark, sf).collect()), key=str)
    exact = token_counts.counts(spark.read.parquet(f"{sf}/documents.parquet")).where("n_tokens > 0").groupBy("source", "lang", "tokenizer").agg({"doc_id": "count", "n_tokens": "sum"})
    want = sorted(((r[0], r[1], r[2], r["count(doc_id)"], r["sum(n_tokens)"]) for r in exact.collect()), key=str)
    assert got == want
