"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm import buffers, letters, pretokens
from panelwright.llm.toxicity import remainder

HIDDEN = 16
LONGEST = 24  # bytes of a word that the network reads at once; a longer word is read in such parts
FIT_DOCS = 250  # documents the model is fitted on at most, by language
FIT_ROWS = 16_000  # documents it is fitted on at most, but one of each language: with many languages, fewer of each
FIT_CHARS = 20_000  # longer texts take no part in fitting; prediction reads every text whole
STEPS, BATCH, RATE = 900, 256, 0.01
UNKNOWN = "und"


def sequences(w: letters.Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the chosen words, a blank at both ends, as padded rows; row lengths; the row's word."""
    texts = w.points.tobytes()
    raw = [b" " + texts[4 * w.starts[i] : 4 * w.ends[i]].decode("utf-32-le").encode() + b" " for i in chosen.tolist()]
    parts = [(k, x[i : i + LONGEST]) for k, x in enumerate(raw) for i in range(0, len(x), LONGEST)]
    lengths = np.array([len(x) for _, x in parts], np.int64)
    flat = np.frombuffer(b"".join(x for _, x in parts), np.uint8)
    rows = np.zeros((len(parts), LONGEST), np.uint8)
    rows[np.arange(LONGEST) < lengths[:, None]] = flat
    return rows, lengths, np.array([k for k, _ in parts], np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One gated recurrent direction: byte tables for the three gates and their recurrent weights."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.table = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)
        self.gates = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 2 * HIDDEN)).astype(np.float32)
        self.inner = rng.normal(0, HIDDEN**-0.5, (HIDDEN, HIDDEN)).astype(np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.gates, self.inner]

    def forward(self, rows: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States at every position; rows: time first. Padding leaves the state as it is."""
        state = np.zeros((rows.shape[1], HIDDEN), np.float32)
        out = np.empty((len(rows), rows.shape[1], HIDDEN), np.float32)
        for t in range(len(rows)):
            x = self.table[rows[t]]
            both = _sigmoid(x[:, : 2 * HIDDEN] + state @ self.gates)
            reset, update = both[:, :HIDDEN], both[:, HIDDEN:] * mask[t][:, None]
            new = np.tanh(x[:, 2 * HIDDEN :] + (reset * state) @ self.inner)
            if keep is not None:
                keep.append((state, reset, update, both[:, HIDDEN:], new))
            state = state + update * (new - state)
            out[t] = state
        return out

    def backward(self, rows: np.ndarray, mask: np.ndarray, kept: list, above: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weights by backpropagation through time; above: gradient of each state."""
        table, gates, inner = (np.zeros_like(x) for x in self.weights())
        flow = np.zeros_like(above[0])
        for t in range(len(rows) - 1, -1, -1):
            flow = flow + above[t]
            state, reset, update, raw, new = kept[t]
            d_new = flow * update * (1 - new**2)
            d_update = flow * (new - state) * mask[t][:, None] * raw * (1 - raw)
            through = d_new @ self.inner.T
            d_reset = through * state * reset * (1 - reset)
            d_both = np.concatenate([d_reset, d_update], 1)
            gates += state.T @ d_both
            inner += (reset * state).T @ d_new
            np.add.at(table, rows[t], np.concatenate([d_both, d_new], 1))
            flow = flow * (1 - update) + through * reset + d_both @ self.gates.T
        return [table, gates, inner]


@dataclass
class Model:
    langs: list[str]
    ahead: Direction
    back: Direction
    top: np.ndarray
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [*self.ahead.weights(), *self.back.weights(), self.top, self.bias]

    def positions(self, rows: np.ndarray, lengths: np.ndarray, keep: tuple[list, list] | None = None):
        """Log probabilities of the languages at every position, time first, and the states and mask."""
        steps = int(lengths.max())
        seen = rows[:, :steps].T
        mask = (np.arange(steps)[:, None] < lengths).astype(np.float32)
        ahead = self.ahead.forward(seen, mask, keep[0] if keep else None)
        back = self.back.forward(seen[::-1], mask[::-1], keep[1] if keep else None)[::-1]
        states = np.concatenate([ahead, back], 2)
        logit = states @ self.top + self.bias
        logit -= logit.max(2, keepdims=True)
        return logit - np.log(np.exp(logit).sum(2, keepdims=True)), states, mask, seen

    def word_sums(self, w: letters.Words, chosen: np.ndarray) -> np.ndarray:
        """For each chosen word, the sums over its positions of the log probabilities, and their number."""
        out = np.zeros((len(chosen), len(self.langs) + 1))
        rows, lengths, word = sequences(w, chosen)
        order = np.argsort(lengths, kind="stable")  # rows of like length together: little padding
        for part in np.array_split(order, max(1, len(order) // 4096)):
            if len(part):
                logs, _, mask, _ = self.positions(rows[part], lengths[part])
                np.add.at(out[:, :-1], word[part], (logs * mask[:, :, None]).sum(0))
        np.add.at(out[:, -1], word, lengths)
        return out

    def predict(self, column: pa.Array, memo: pretokens.Memo) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text: position labels pooled by their geometric mean."""
        w = letters.words_of(column)
        pooled = np.zeros((len(column), len(self.langs) + 1))
        if len(w.starts) and self.langs:
            each = memo.get(w.hashes, lambda new: self.word_sums(w, new))
            for k in range(pooled.shape[1]):
                pooled[:, k] = np.bincount(w.rows, each[:, k], len(column))
        lettered = pooled[:, -1] > 0
        mean = pooled[:, :-1] / np.maximum(pooled[:, -1:], 1)
        if not self.langs:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        odds = np.exp(mean - mean.max(1, keepdims=True))
        odds /= odds.sum(1, keepdims=True)
        best = odds.argmax(1)
        names = [self.langs[k] if known else UNKNOWN for k, known in zip(best.tolist(), lettered.tolist(), strict=True)]
        return names, np.where(lettered, odds[np.arange(len(best)), best], 0.0)


def fit(texts: pa.Array, langs: list[str], seed: int = 5) -> Model:
    """Train on words drawn from the texts, every language as often, by Adam steps."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    model = Model(
        names, Direction(rng), Direction(rng),
        rng.normal(0, 0.3, (2 * HIDDEN, len(names))).astype(np.float32), np.zeros(len(names), np.float32),
    )
    w = letters.words_of(texts)
    label = np.array([names.index(x) for x in langs], np.int64)[w.rows] if len(w.rows) else np.zeros(0, np.int64)
    pools = [np.flatnonzero(label == k) for k in range(len(names))]
    if len(names) < 2 or not all(map(len, pools)):
        return model
    sizes = max(1, BATCH // len(names))
    drawn = np.concatenate([rng.choice(p, sizes * STEPS) for p in pools])
    chosen, inverse = np.unique(drawn, return_inverse=True)
    rows, lengths, word = sequences(w, chosen)
    first = np.searchsorted(word, np.arange(len(chosen) + 1))
    inverse = first[inverse] + rng.integers(0, np.diff(first)[inverse])  # of a long word, any of its parts
    inverse = inverse.reshape(len(names), STEPS, sizes)
    means = [np.zeros_like(x) for x in model.weights()]
    squares = [np.zeros_like(x) for x in model.weights()]
    target = np.repeat(np.arange(len(names)), sizes)
    for step in range(STEPS):
        part = inverse[:, step].reshape(-1)
        keep: tuple[list, list] = ([], [])
        logs, states, mask, seen = model.positions(rows[part], lengths[part], keep)
        error = np.exp(logs)
        error[:, np.arange(len(part)), target] -= 1
        error *= mask[:, :, None] / mask.sum()
        below = error @ model.top.T
        grads = [
            *model.ahead.backward(seen, mask, keep[0], below[:, :, :HIDDEN]),
            *model.back.backward(seen[::-1], mask[::-1], keep[1], below[::-1, :, HIDDEN:]),
            np.tensordot(states, error, ((0, 1), (0, 1))),
            error.sum((0, 1)),
        ]
        rate = RATE * (1 - step / STEPS) * np.sqrt(1 - 0.999 ** (step + 1)) / (1 - 0.9 ** (step + 1))
        for value, grad, mean, square in zip(model.weights(), grads, means, squares, strict=True):
            mean += 0.1 * (grad - mean)
            square += 0.001 * (grad**2 - square)
            value -= (rate * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """Fit on documents of every language that aren't held out, at most FIT_DOCS of each, drawn by a hash of the id."""
    known = docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"), F.col(lang_column).alias("__lang"))
    known = known.filter(F.col("__lang").isNotNull() & (remainder(F.col("__id"), 4) != 2) & F.col("__id").isNotNull())
    short = known.filter((F.length("__text") <= FIT_CHARS) & F.col("__text").rlike(r"\p{L}"))
    place = F.row_number().over(Window.partitionBy("__lang").orderBy("__hash", "__id"))
    ids = short.select("__id", "__lang", F.xxhash64("__id").alias("__hash")).withColumn("__place", place)
    each = max(1, min(FIT_DOCS, FIT_ROWS // max(1, short.select("__lang").distinct().count())))
    # at most FIT_ROWS ids, or one of each language, may be broadcast
    few = ids.filter(F.col("__place") <= each).select("__id", "__lang").distinct()
    rows = short.join(F.broadcast(few), ["__id", "__lang"]).groupBy("__lang", "__id").agg(F.min("__text").alias("__text"))
    table = rows.orderBy("__lang", "__id").select("__text", "__lang").toArrow()
    return fit(table.column("__text").combine_chunks(), table.column("__lang").to_pylist())


def _predicted(model: Model, id_column: str, text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = pretokens.Memo(bits=18, width=len(model.langs) + 1, dtype=np.float64)
        for batch in buffers.slices(batches, text_column):
            langs, scores = model.predict(batch.column(text_column), memo)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column), pa.array(langs, pa.string()), pa.array(scores)], names=[id_column, "lang_pred", "score"]
            )

    return run


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Language of each whole text, learned from texts and languages of rows that aren't held out.

    The network reads each word's bytes in both directions and labels every position; a document pools
    all its positions. Equal words have equal labels, so a task reads each new word once. Null text or
    one without letters: `und` with score 0; so it is everywhere if nothing could be learned. Null ids
    count as remainder 0 and aren't learned from. Repeated rows get equal results. Other columns are
    ignored, whatever their names. Empty table: empty result.
    """
    model = train(docs, id_column, text_column, lang_column)
    kind = docs.schema[id_column].dataType
    read = docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"))
    found = read.mapInArrow(
        _predicted(model, "__id", "__text"), f"__id {kind.simpleString()}, lang_pred string, score double"
    )
    held = remainder(F.col("__id"), 4) == 2
    return found.select(F.col("__id").alias(id_column), held.alias("held_out"), "lang_pred", "score")
