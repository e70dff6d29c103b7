"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm import buffers, letters, pretokens

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
DIM = 8
FIT_TOXIC, FIT_CLEAN = 1000, 2000  # labelled rows the model is fitted on at most, by label
FIT_CHARS = 20_000  # longer texts take no part in fitting; scoring reads every text whole
LEAST_DOCS = 15  # n-grams of fewer documents stay without a vector
EPOCHS, BATCH, RATE = 30, 64, 0.5


def subwords(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character n-grams, with marks at both ends, and of the words; their word."""
    sizes = ends - starts + 2
    at = np.cumsum(sizes) - sizes
    marked = np.empty(int(sizes.sum()), np.uint32)
    marked[at], marked[at + sizes - 1] = 1, 2
    marked[buffers.ranges(at + 1, sizes - 2)] = points[buffers.ranges(starts, sizes - 2)]
    words, begins, stops = [np.arange(len(starts))], [at], [at + sizes]
    for n in GRAMS:
        number = np.maximum(sizes - n + 1, 0)
        places = buffers.ranges(at, number)
        words.append(np.repeat(np.arange(len(starts)), number))
        begins.append(places)
        stops.append(places + n)
    begin, stop = np.concatenate(begins), np.concatenate(stops)
    hashes = buffers.span_hashes(marked, begin, stop)
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(words)


@dataclass
class Model:
    """A number per bucket, the bucket's vector times the difference of the two softmax rows, and a bias."""

    weights: np.ndarray
    bias: float

    def word_scores(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        buckets, words = subwords(points, starts, ends)
        sums = np.bincount(words, self.weights[buckets], len(starts))
        return sums / np.bincount(words, minlength=len(starts))

    def scores(self, column: pa.Array, memo: pretokens.Memo) -> np.ndarray:
        """Probability of each text: the mean of its words' vectors goes through the softmax."""
        w = letters.words_of(column)
        total = np.zeros(len(column))
        if len(w.starts):
            each = memo.get(w.hashes, lambda new: self.word_scores(w.points, w.starts[new], w.ends[new]))
            count = np.bincount(w.rows, minlength=len(column))
            total = np.bincount(w.rows, each, len(column)) / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -60, 60)))


def _bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and weights of all documents, one after another, and where each begins.

    Each word's share of its document is spread over its buckets. Few documents are spread at a time.
    """
    buckets, weights, sizes = [], [], []
    for part in buffers.slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text", 250_000):
        w, documents = letters.words_of(part.column(0)), len(part)
        keys, at, word = np.unique(w.hashes, return_index=True, return_inverse=True)
        pairs, uses = np.unique(w.rows.astype(np.int64) * max(1, len(keys)) + word, return_counts=True)
        doc, word = pairs // max(1, len(keys)), pairs % max(1, len(keys))
        share = uses / np.bincount(w.rows, minlength=documents)[doc]
        flat, of_word = subwords(w.points, w.starts[at], w.ends[at])
        flat, per_word = flat[np.argsort(of_word, kind="stable")], np.bincount(of_word, minlength=len(keys))
        number = per_word[word]
        flat = flat[buffers.ranges((np.cumsum(per_word) - per_word)[word], number)]
        cells, inverse = np.unique(np.repeat(doc, number) * BUCKETS + flat, return_inverse=True)
        weights.append(np.bincount(inverse, np.repeat(share / number, number), len(cells)).astype(np.float32))
        buckets.append((cells % BUCKETS).astype(np.int32))
        sizes.append(np.bincount(cells // BUCKETS, minlength=documents))
    return np.concatenate(buckets), np.concatenate(weights), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def fit(texts: pa.Array, labels: np.ndarray, share: float | None = None, seed: int = 11) -> Model:
    """Train bucket vectors and softmax together by mini-batch gradient steps with adaptive rates.

    share: the part of label 1 where the model will be used, if it isn't that of these rows. Without
    both labels the model knows nothing: its score is 1 or 0 as the only label, 0 without any.
    """
    rate = float(labels.mean()) if len(labels) else 0.0
    if not 0 < rate < 1:
        return Model(np.zeros(BUCKETS), 60.0 if rate == 1 else -60.0)
    bucket, weight, at = _bags(texts)
    seen = np.bincount(bucket, minlength=BUCKETS)
    known = np.flatnonzero(seen >= min(LEAST_DOCS, 1 + len(labels) // 100))
    number = np.full(BUCKETS, -1, np.int32)
    number[known] = np.arange(len(known))
    kept = number[bucket] >= 0
    at = np.concatenate([[0], np.cumsum(kept)])[at]
    bucket, weight = number[bucket[kept]], weight[kept]
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (len(known), DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (2, DIM)).astype(np.float32)
    bias = np.log(np.array([1 - rate, rate], np.float32))
    grown = [np.full((len(known), 1), 1e-6, np.float32), np.full((2, DIM), 1e-6, np.float32), np.full(2, 1e-6, np.float32)]
    target = np.eye(2, dtype=np.float32)[labels]
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // BATCH)):
            sizes = at[batch + 1] - at[batch]
            cells = buffers.ranges(at[batch], sizes)
            used, share_of = bucket[cells], weight[cells][:, None]
            mean = np.zeros((len(batch), DIM), np.float32)
            filled = sizes > 0
            if len(cells):
                mean[filled] = np.add.reduceat(vectors[used] * share_of, (np.cumsum(sizes) - sizes)[filled], axis=0)
            logit = mean @ out.T + bias
            odds = np.exp(logit - logit.max(1, keepdims=True))
            error = (odds / odds.sum(1, keepdims=True) - target[batch]) / len(batch)
            step = (error @ out)[np.repeat(np.arange(len(batch)), sizes)] * share_of
            grads = (
                np.stack([np.bincount(used, step[:, k], len(known)) for k in range(DIM)], 1).astype(np.float32),
                error.T @ mean,
                error.sum(0),
            )
            grown[0] += (grads[0] ** 2).mean(1, keepdims=True)
            grown[1] += grads[1] ** 2
            grown[2] += grads[2] ** 2
            for value, grad, sum_ in zip((vectors, out, bias), grads, grown, strict=True):
                value -= RATE * grad / np.sqrt(sum_)
    weights = np.zeros(BUCKETS)
    weights[known] = vectors @ (out[1] - out[0])
    moved = 0.0 if not share or share >= 1 else np.log(share / (1 - share)) - np.log(rate / (1 - rate))
    return Model(weights, float(bias[1] - bias[0]) + float(moved))


def remainder(column: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo a divisor; a null id counts as 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % divisor, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fit on at most FIT_TOXIC + FIT_CLEAN labelled rows that aren't held out, drawn by a hash of the id.

    Labels other than 0 and 1 are no labels; an id labelled both ways counts as toxic.
    """
    known = labels.select(F.col("doc_id").alias("__label_id"), F.col("toxic").cast("int").alias("__toxic"))
    known = known.filter(F.col("__toxic").isin(0, 1) & (remainder(F.col("__label_id"), 5) != 0))
    known = known.groupBy("__label_id").agg(F.max("__toxic").alias("__toxic"))
    share = known.agg(F.avg("__toxic")).first()[0]
    drawn = [
        known.filter(F.col("__toxic") == k).orderBy(F.xxhash64("__label_id"), "__label_id").limit(n)
        for k, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))
    ]
    # the drawn ids are bounded by the two limits, so they may be broadcast
    few = F.broadcast(drawn[0].unionByName(drawn[1]))
    short = docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"))
    rows = short.join(few, F.col("__id") == F.col("__label_id")).filter(F.length("__text") <= FIT_CHARS)
    table = rows.select("__id", "__text", "__toxic").orderBy("__id", "__text").limit(FIT_TOXIC + FIT_CLEAN).toArrow()
    return fit(table.column("__text").combine_chunks(), table.column("__toxic").to_numpy().astype(np.int64), share)


def _scored(model: Model, text_column: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = pretokens.Memo(width=1, dtype=np.float64)
        for batch in buffers.slices(batches, text_column):
            scores = model.scores(batch.column(text_column), memo)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    return run


def with_score(docs: DataFrame, model: Model, text_column: str = "text", name: str = "__score") -> DataFrame:
    """All rows and columns of `docs` with the probability of label 1 of the whole text."""
    fields = T.StructType([*docs.schema, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_scored(model, text_column, name), fields)


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Toxicity of each whole text, from a model that never sees ids, languages, sources or held-out labels.

    Words are runs of letters; a misspelt word shares most of its n-grams with the right one. A null or
    empty text, or one without letters, gets the score of the bias alone. Null ids are held out. Repeated
    rows get equal scores. Other columns are ignored, whatever their names. Empty table: empty result;
    without labels every score is 0.
    """
    model = train(docs, labels, id_column, text_column)
    scored = with_score(docs.select(id_column, text_column), model, text_column)
    return scored.select(
        id_column, (remainder(F.col(id_column), 5) == 0).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"),
    )
