"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader
updates and scored as a sparse dot product.

Words are lower-cased runs of letters and digits and, as words of their own, runs of other marks; features are
words and pairs of words, hashed into 2**18 slots, each counting as its share of the text's features.

Training takes a bounded sample of labelled rows (``max_rows``), chosen by a hash of the id. Texts become hashed
features where they are read; only these are dealt to a fixed number of shards. Each shard runs the updates over
its rows in a fixed order, and the weights of the shards that have rows are averaged. The model is at most 2**18
numbers, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.llm import arrowtext as A
from wayspark.llm.common import arrow_rows, fold_in, table, written

LOG2_SLOTS = 18
#: Labelled rows used for fitting, at most about so many.
MAX_ROWS = 16_000
SHARDS, EPOCHS = 4, 4
THRESHOLD = 0.3
#: A text's features sum to SCALE.
SCALE = 16.0

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_MARK = ~_WORD & A.NOT_SPACE
#: Any run of one class is a word; the class of a byte.
_CLASS = np.where(_WORD, 1, np.where(_MARK, 2, 0)).astype(np.uint8)


@dataclass
class Model:
    weights: np.ndarray = field(repr=False)
    bias: float


def _features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, slots, row of each slot) for each chunk."""
    for lo, hi, raw, offsets in A.chunks(texts):
        data = A.LOWER[raw]
        kind = _CLASS[data]
        a = A.runs(kind == 1, offsets)
        b = A.runs(kind == 2, offsets)
        starts, ends, rows = (np.concatenate(x) for x in zip(a, b))
        order = np.argsort(starts, kind="stable")
        starts, ends, rows = starts[order], ends[order], rows[order]
        h = A.hashes(data, starts, ends)
        same = rows[1:] == rows[:-1]
        pairs = A.mix(h[:-1] * np.uint64(31) + h[1:])[same] if len(h) else h
        slots = (np.concatenate([h, pairs]) >> np.uint64(64 - LOG2_SLOTS)).astype(np.int64)
        yield lo, hi - lo, slots, np.concatenate([rows, rows[1:][same]]) if len(h) else rows


def _scores(texts: pa.Array, model: Model) -> np.ndarray:
    out = np.zeros(len(texts))
    for lo, n, slots, rows in _features(texts):
        total = np.bincount(rows, weights=model.weights[slots], minlength=n)
        count = np.bincount(rows, minlength=n)
        out[lo : lo + n] = total * SCALE / np.maximum(count, 1)
    return 1 / (1 + np.exp(-(out + model.bias)))


def _sparse(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for _, n, slots, rows in _features(texts):
        order = np.argsort(rows, kind="stable")
        cuts = np.searchsorted(rows[order], np.arange(n + 1))
        for i in range(n):
            own, count = np.unique(slots[order[cuts[i] : cuts[i + 1]]], return_counts=True)
            out.append((own, count * SCALE / max(1, count.sum())))
    return out


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002) -> np.ndarray:
    """Weights after follow-the-regularised-leader (proximal) updates, row by row; the last one is the bias."""
    z, n = np.zeros((1 << LOG2_SLOTS) + 1), np.zeros((1 << LOG2_SLOTS) + 1)
    last = 1 << LOG2_SLOTS

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for (slots, values), y in zip(rows, labels):
            i, x = np.append(slots, last), np.append(values, 1.0)
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    return weight(np.arange(last + 1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> Model:
    """A model of ``label`` (0 or 1) from ``docs(doc_id, text)`` and ``labels(doc_id, label)``.

    Rows with a null id or label are no examples, nor are ids without a document. An id labelled both ways is
    two examples, labels that repeat are one; of documents that repeat an id the smallest text is the example, a
    null one counts as empty. With no examples all scores are one half. Ids beyond ``max_rows`` are left out by
    hash, so the sample is the same each time.
    """
    arrow_rows(docs.sparkSession)
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).distinct()
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = known.where(place < int(1_000_000 * min(1.0, max_rows / max(n, 1))))
    # the sample's ids are about max_rows, so they may be broadcast
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    shard, at = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SHARDS)).cast("int"), F.xxhash64("doc_id", F.lit(11))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = zip(*_sparse(batch.column("text"))) if batch.num_rows else ((), ())
            columns = [batch.column(c) for c in ("shard", "at", "y")]
            columns += [pa.array(slots, type=pa.list_(pa.int32())), pa.array(values, type=pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "at", "y", "slots", "values"])

    features = sample.select(shard.alias("shard"), at.alias("at"), "y", "text").mapInArrow(hashed, "shard int, at long, y int, slots array<int>, values array<float>")

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "y"])
        w = ftrl(list(zip(rows["slots"], rows["values"])), rows["y"].to_numpy(dtype=float), epochs)
        i = np.flatnonzero(w)
        return pd.DataFrame({"shard": rows["shard"].iloc[0], "slot": i.astype(np.int64), "w": w[i]})

    # one shard a task: dealt by range, as hashes of so few keys would often meet
    parts = written(features.repartitionByRange(SHARDS, "shard").groupBy("shard").applyInPandas(train, "shard int, slot long, w double"), "weights")
    shards = parts.select("shard").distinct().count()
    weights = np.zeros((1 << LOG2_SLOTS) + 1)
    for slot, w in parts.groupBy("slot").agg((F.sum("w") / F.lit(float(max(1, shards)))).alias("w")).collect():  # at most 2**18 + 1
        weights[slot] = w
    return Model(weights[:-1], float(weights[-1]))


def score(text: Column, model: Model, spark: SparkSession) -> Column:
    """The probability of label 1, from the whole text; null and empty texts get the bias alone."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(_scores(texts, shared.value))

    return scored(text)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if score >= threshold); columns of these names are replaced.

    Null and empty texts score by the bias alone; repeated rows repeat; a score at the threshold is predicted 1;
    an empty table stays empty.
    """
    arrow_rows(docs.sparkSession)
    out = docs.withColumn("score", score(F.col("text"), model, docs.sparkSession))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` the model does not reject, columns unchanged; cases are those of ``classify``."""
    arrow_rows(docs.sparkSession)
    return docs.where(score(F.col("text"), model, docs.sparkSession) >= threshold)


def learnable(labels: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out fifth."""
    return labels.where(fold_in(F.col("doc_id"), 5) != 0)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learnable(table(spark, sf_dir, "labels")))
    judged = classify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", (fold_in(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
