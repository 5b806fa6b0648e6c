"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces; each language has a probability for each piece. A word's
likelihood is the sum over all ways of cutting it into pieces, by the forward algorithm; a text's is the
product over its words, which is the sum over all segmentations of the text, as no piece crosses words.
Probabilities are fitted by expectation-maximisation (forward-backward) on the word counts of a bounded sample
of labelled documents (``per_language`` rows of each language); the model has a number for each language and
piece, whatever the corpus.

Words are runs of letters and marks of one script, in lower case (A-Z), each with a space before it; a longer run,
as scripts without spaces have, is cut after every 24 characters, so a word's work and memory are bounded. Whole
texts are scored; a word's likelihoods are worked out once for as long as a worker's table has room.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.llm import arrowtext as A
from wayspark.llm.common import arrow_rows, fold_in, table, written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Rows of a language used for fitting, about so many at most.
PER_LANGUAGE = 1_000
ROUNDS = 2
#: Code points of a word, at most.
MAX_WORD = 24
#: Tasks that share the words of a round of fitting.
PARTS = 16
#: Pieces of more bytes are left out.
MAX_PIECE = 16
#: Added to each piece's expected count.
PRIOR = 0.05
#: Entries of a worker's table of words, times languages.
TABLE = 4_000_000
UND = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class Vocabulary:
    """Pieces by length: sorted hashes and the pieces' numbers."""

    size: int
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = field(repr=False)


@dataclass
class Model:
    languages: list[str]
    vocabulary: Vocabulary
    probabilities: np.ndarray = field(repr=False)  # (languages, pieces + 1); the last is no piece


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The lower-case letter pieces of a tiktoken file, and every single byte of a word."""
    pieces = {bytes([b]) for b in np.flatnonzero(_LETTER)} | {b" "}
    with open(path, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0])
            body = np.frombuffer(piece[1:] if piece[:1] == b" " else piece, dtype=np.uint8)
            if len(piece) <= MAX_PIECE and len(body) and _LETTER[body].all():
                pieces.add(piece)
    by_length, at = {}, 0
    for n in range(1, MAX_PIECE + 1):
        own = sorted(p for p in pieces if len(p) == n)
        if own:
            data = np.frombuffer(b"".join(own), dtype=np.uint8)
            h = A.hashes(data, np.arange(0, len(data), n), np.arange(n, len(data) + 1, n))
            order = np.argsort(h)
            by_length[n] = h[order], (at + order).astype(np.int32)
            at += len(own)
    return Vocabulary(at, by_length)


def _pieces(block: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """For words of one length, rows of bytes: [length - 1, end, word] -> piece number, or the vocabulary's size."""
    count, n = block.shape
    most = min(n, MAX_PIECE)
    ids = np.full((most, n, count), vocab.size, dtype=np.int32)
    sums = np.zeros((n + 1, count), dtype=np.uint64)
    np.cumsum((block.T.astype(np.uint64) + np.uint64(1)) * A.power("up", n)[:, None], axis=0, out=sums[1:])
    down = A.power("down", n)[:, None]
    for size, (known, number) in vocab.by_length.items():
        if size <= n:
            h = A.mix((sums[size:] - sums[: n - size + 1]) * down[: n - size + 1]).ravel()
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            ids[size - 1, size - 1 :] = np.where(known[at] == h, number[at], vocab.size).reshape(-1, count)
    return ids


_scripts: list[np.ndarray] = []


def _script() -> np.ndarray:
    """A class for each code point: 0 for no letter, 255 for marks, which continue what they follow, else a script,
    roughly: Latin, ideographs, Hangul, and other letters by block of 256."""
    if not _scripts:
        at = np.arange(0x110000)
        out = (4 + (at >> 8) % 200).astype(np.uint8)
        out[(at < 0x250) | ((at >= 0x1E00) & (at < 0x1F00))] = 1
        out[((at >= 0x2E80) & (at < 0x3040)) | ((at >= 0x3400) & (at < 0xA000)) | ((at >= 0xF900) & (at < 0xFB00)) | (at >= 0x20000)] = 2
        out[((at >= 0x1100) & (at < 0x1200)) | ((at >= 0xAC00) & (at < 0xD7B0))] = 3
        kind = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
        out[kind == "M"] = 255
        out[(kind != "L") & (kind != "M")] = 0
        _scripts.append(out)
    return _scripts[0]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, last byte + 1 and row of each word."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    kind = _script()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)]
    n = len(kind)
    row = np.searchsorted(offsets, first, "right") - 1
    new_row = np.append(True, row[1:] != row[:-1])[:n]
    held = np.maximum.accumulate(np.where((kind != 255) | new_row, np.arange(n), 0)) if n else first
    kind = kind[held]
    kind[kind == 255] = 0  # marks at the start of a text follow nothing
    begins = (kind > 0) & (np.append(True, kind[1:] != kind[:-1])[:n] | new_row)
    run = np.maximum.accumulate(np.where(begins, np.arange(n), 0)) if n else first
    begins |= (kind > 0) & ((np.arange(n) - run) % MAX_WORD == 0)
    at = np.flatnonzero(begins)
    stop = np.flatnonzero((kind == 0) | begins)
    ends = np.append(first[stop], len(data))[np.searchsorted(stop, at, "right")]
    return first[at], ends, row[at]


def _forward(block: np.ndarray, vocab: Vocabulary, probabilities: np.ndarray) -> np.ndarray:
    """Log-likelihoods [word, language] for words of one length; sums are rescaled every few positions."""
    count, n = block.shape
    table_ = np.ascontiguousarray(probabilities.T)
    alpha = np.zeros((n + 1, count, table_.shape[1]))
    alpha[0] = 1.0
    scale = np.zeros(alpha.shape[1:])
    ids = _pieces(block, vocab)
    for j in range(n):
        for m in range(min(j + 1, MAX_PIECE)):
            own = ids[m, j]
            if own.min() < vocab.size:
                alpha[j + 1] += alpha[j - m] * table_[own]
        if j % 8 == 7:
            top = alpha[j + 1].copy()
            alpha[max(0, j + 1 - MAX_PIECE) : j + 2] /= top
            scale += np.log(top)
    return scale + np.log(alpha[n])


def _blocks(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, bytes with a space before them) for words of one length, few enough to fit memory."""
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        step = max(1, 16_384 // (int(n) + 1))
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            block = np.full((len(part), int(n) + 1), 32, dtype=np.uint8)
            block[:, 1:] = data[starts[part][:, None] + np.arange(int(n))[None, :]]
            yield part, block


class _Scorer:
    """Word likelihoods kept by hash, in a table of bounded size."""

    def __init__(self, model: Model):
        self.model = model
        self.known = np.zeros(0, dtype=np.uint64)
        self.values = np.zeros((0, len(model.languages)))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h, index, back = np.unique(A.hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, h)
        held = np.zeros(len(h), dtype=bool)
        inside = at < len(self.known)
        held[inside] = self.known[at[inside]] == h[inside]
        values = np.zeros((len(h), len(self.model.languages)))
        values[held] = self.values[at[held]]
        new = np.flatnonzero(~held)
        first = starts[index[new]]
        for part, block in _blocks(data, first, ends[index[new]] - first):
            values[new[part]] = _forward(block, self.model.vocabulary, self.model.probabilities)
        if len(self.known) + len(new) > TABLE // len(self.model.languages):
            self.known, self.values = h, values
        else:
            self.known, self.values = np.insert(self.known, at[new], h[new]), np.insert(self.values, at[new], values[new], axis=0)
        return values[back]

    def texts(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(self.model.languages)))
        for lo, hi, raw, offsets in A.chunks(texts):
            data = A.LOWER[raw]
            starts, ends, rows = _words(data, offsets)
            if len(starts):
                values = self.words(data, starts, ends)
                for k in range(values.shape[1]):
                    out[lo:hi, k] = np.bincount(rows, weights=values[:, k], minlength=hi - lo)
        return out


_scorers: dict[int, _Scorer] = {}


def _expected(rows: pd.DataFrame, model: Model) -> pd.DataFrame:
    """Expected uses of each piece in words (lang, word, n), by forward-backward under the word's language."""
    vocab, out = model.vocabulary, []
    for lang, own in rows.groupby("lang"):
        p = np.append(model.probabilities[model.languages.index(lang)][:-1], 0.0)
        raw = [w.encode() for w in own["word"]]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        lengths = np.array([len(w) for w in raw])
        starts = np.cumsum(lengths) - lengths
        weight = own["n"].to_numpy(dtype=float)
        total = np.zeros(vocab.size + 1)
        for part, block in _blocks(data, starts, lengths):
            count, n = block.shape
            ids = np.full((count, n, MAX_PIECE), vocab.size, dtype=np.int32)
            ids[:, :, : min(n, MAX_PIECE)] = _pieces(block, vocab).transpose(2, 1, 0)
            prob = p[ids]
            scale, backward = np.zeros((count, n + 1)), np.zeros((count, n + 1))  # log alpha, log beta
            for j in range(1, n + 1):
                m = min(j, MAX_PIECE)
                shift = np.exp(scale[:, j - m : j] - scale[:, j - 1 : j])
                scale[:, j] = scale[:, j - 1] + np.log((prob[:, j - 1, :m][:, ::-1] * shift).sum(axis=1))
            log_z = scale[:, n]
            for i in range(n - 1, -1, -1):
                m = min(n - i, MAX_PIECE)
                q = prob[:, np.arange(i, i + m), np.arange(m)]
                peak = backward[:, i + 1 : i + m + 1].max(axis=1)
                backward[:, i] = peak + np.log((q * np.exp(backward[:, i + 1 : i + m + 1] - peak[:, None])).sum(axis=1) + 1e-300)
            for m in range(1, min(n, MAX_PIECE) + 1):
                use = np.exp(scale[:, : n - m + 1] + backward[:, m:] - log_z[:, None]) * prob[:, m - 1 :, m - 1]
                total += np.bincount(ids[:, m - 1 :, m - 1].ravel(), weights=(use * weight[part][:, None]).ravel(), minlength=vocab.size + 1)
        used = np.flatnonzero(total[:-1])
        out.append(pd.DataFrame({"lang": lang, "piece": used.astype(np.int64), "uses": total[used]}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "piece": [], "uses": []})


def word_list(text: Column) -> Column:
    """The words of a text, in order; none for null."""

    @F.arrow_udf("array<string>")
    def listed(texts: pa.Array) -> pa.Array:
        out: list[list[str]] = []
        for lo, hi, raw, offsets in A.chunks(texts):
            data = A.LOWER[raw]
            own: list[list[str]] = [[] for _ in range(hi - lo)]
            whole = data.tobytes()
            for a, b, r in zip(*(x.tolist() for x in _words(data, offsets))):
                own[r].append(whole[a:b].decode())
            out += own
        return pa.array(out, type=pa.list_(pa.string()))

    return listed(text)


def fit(docs: DataFrame, path: str = VOCABULARY, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """A model from ``docs(text, lang, doc_id)``.

    Every language of the labelled rows is learned. Rows with null text or language teach nothing; without any
    the model has no languages. Each language's rows are chosen by a hash of id and text, the same each time;
    rows that repeat both count once.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(sizes)
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1_000_000))
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int(1_000_000 * min(1.0, per_language / n))))) if sizes else F.create_map().cast("map<string,int>")
    sample = known.where(place < F.element_at(share, F.col("lang"))).distinct()
    counts = sample.select("lang", F.explode(word_list(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.repartition(PARTS, "lang", "word"), "words")
    vocab = vocabulary(path)
    probabilities = np.full((len(languages), vocab.size + 1), 1.0 / vocab.size)
    probabilities[:, -1] = 0.0
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast(Model(languages, vocab, probabilities))

        def expected(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield _expected(rows, shared.value)

        uses = counts.mapInPandas(expected, "lang string, piece long, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
        probabilities = np.full((len(languages), vocab.size + 1), PRIOR)
        at = {x: i for i, x in enumerate(languages)}
        for lang, piece, use in uses.collect():  # at most languages times pieces
            probabilities[at[lang], piece] += use
        probabilities[:, -1] = 0.0
        probabilities /= probabilities.sum(axis=1, keepdims=True)
    return Model(languages, vocab, probabilities)


def identify(text: Column, model: Model, spark: SparkSession) -> Column:
    """(lang, score) of a text: the language of greatest likelihood and its share under equal priors; ``und``
    and 0 for null, for texts without a letter, and for a model without languages."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def identified(texts: pa.Array) -> pa.Array:
        own = shared.value
        scorer = _scorers.get(id(own))
        if scorer is None:
            _scorers.clear()
            scorer = _scorers[id(own)] = _Scorer(own)
        ll = scorer.texts(texts)
        best = ll.argmax(axis=1)
        share = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array([own.languages[b] for b in best], type=pa.string()), pa.array(share)], ["lang", "score"])

    none = F.struct(F.lit(UND).alias("lang"), F.lit(0.0).alias("score"))
    if not model.languages:
        return none
    found = identified(text)
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), found).otherwise(none)


def label(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score, one row per row of ``docs``; repeated rows repeat, other columns are ignored."""
    arrow_rows(docs.sparkSession)
    found = docs.select("doc_id", identify(F.col("text"), model, docs.sparkSession).alias("found"))
    return found.select("doc_id", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold_in(F.col("doc_id"), 4) != 2))
    return label(docs, model).select("doc_id", (fold_in(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
