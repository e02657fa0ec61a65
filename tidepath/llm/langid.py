"""Language of a text by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepath.llm.common import per_slice

# The network starts afresh at each piece: a word, or a stretch of so many bytes
# of a longer one. Equal pieces have equal outputs, so a worker runs each once.
PIECE_BYTES = 24
MEMO_PIECES = 300_000
# Bound of the training sample: documents per language and pieces per document.
DOCS_PER_LANG = 400
PIECES_PER_DOC = 48


def pieces_of(text: str) -> list[bytes]:
    """The text in lower case, as words of at most `PIECE_BYTES` bytes; nothing is left out."""
    words = text.lower().encode().split()
    if all(len(word) <= PIECE_BYTES for word in words):
        return words
    return [w[at : at + PIECE_BYTES] for w in words for at in range(0, len(w), PIECE_BYTES)]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Gru:
    """Weights of the two directions and of the output, all float32.

    `inputs[d]` has a row of 3H numbers per byte, `loops[d]` is H x 3H (update,
    reset, candidate), `heads[d]` is H x classes; d is 0 forward, 1 backward.
    """

    inputs: list[np.ndarray]
    loops: list[np.ndarray]
    heads: list[np.ndarray]
    bias: np.ndarray

    @classmethod
    def fresh(cls, hidden: int, classes: int, seed: int) -> Gru:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        return cls(
            [normal(256, 3 * hidden, scale=0.3) for _ in range(2)],
            [normal(hidden, 3 * hidden, scale=hidden**-0.5) for _ in range(2)],
            [normal(hidden, classes, scale=hidden**-0.5) for _ in range(2)],
            np.zeros(classes, np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.loops, *self.heads, self.bias]

    def states(self, data: np.ndarray, way: int) -> tuple[np.ndarray, list]:
        """States after each byte of `data` (pieces x bytes), and what backpropagation needs."""
        inputs, loops = self.inputs[way], self.loops[way]
        n, length = data.shape
        size = loops.shape[0]
        state = np.zeros((n, size), np.float32)
        out = np.empty((length, n, size), np.float32)
        trace = [None] * length
        for at in range(length) if way == 0 else range(length - 1, -1, -1):
            given = inputs[data[:, at]]
            looped = state @ loops
            gates = _sigmoid(given[:, : 2 * size] + looped[:, : 2 * size])
            keep, reset = gates[:, :size], gates[:, size:]
            inner = looped[:, 2 * size :]
            fresh = np.tanh(given[:, 2 * size :] + reset * inner)
            trace[at] = (state, keep, reset, inner, fresh)
            state = fresh + keep * (state - fresh)
            out[at] = state
        return out, trace

    def position_probs(self, data: np.ndarray) -> tuple[np.ndarray, list, list]:
        """Probabilities of the classes at every byte: bytes x pieces x classes."""
        outs, traces = zip(*(self.states(data, way) for way in (0, 1)))
        logits = outs[0] @ self.heads[0] + outs[1] @ self.heads[1] + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits, list(outs), list(traces)

    def gradients(self, data: np.ndarray, label: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Backpropagation through time of the mean cross entropy over all positions."""
        probs, outs, traces = self.position_probs(data)
        length, n, classes = probs.shape
        rows = np.arange(n)
        loss = -float(np.log(probs[:, rows, label] + 1e-9).mean())
        probs[:, rows, label] -= 1.0
        error = probs / np.float32(length * n)
        inputs = [np.zeros_like(w) for w in self.inputs]
        loops = [np.zeros_like(w) for w in self.loops]
        heads = [
            np.tensordot(out, error, ((0, 1), (0, 1))).astype(np.float32) for out in outs
        ]
        for way in (0, 1):
            back = np.zeros_like(traces[way][0][0])
            for at in range(length - 1, -1, -1) if way == 0 else range(length):
                state, keep, reset, inner, fresh = traces[way][at]
                back = back + error[at] @ self.heads[way].T
                d_fresh = back * (1 - keep) * (1 - fresh * fresh)
                d_keep = back * (state - fresh) * keep * (1 - keep)
                d_reset = d_fresh * inner * reset * (1 - reset)
                given = np.concatenate([d_keep, d_reset, d_fresh], axis=1)
                looped = np.concatenate([d_keep, d_reset, d_fresh * reset], axis=1)
                np.add.at(inputs[way], data[:, at], given)
                loops[way] += state.T @ looped
                back = back * keep + looped @ self.loops[way].T
        return [*inputs, *loops, *heads, error.sum(axis=(0, 1))], loss


def by_length(pieces: list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of pieces of one length: their places in the list, and their bytes."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for same in np.split(order, cuts):
        for at in range(0, len(same), most):
            part = same[at : at + most]
            if len(part) and sizes[part[0]]:
                joined = b"".join([pieces[i] for i in part.tolist()])
                yield part, np.frombuffer(joined, np.uint8).reshape(len(part), -1)


def train(
    pieces: list[bytes],
    labels: np.ndarray,
    classes: int,
    hidden: int = 16,
    epochs: int = 4,
    rate: float = 0.01,
    seed: int = 5,
) -> Gru:
    """Fit a network to pieces and the class of the document of each, with Adam."""
    model = Gru.fresh(hidden, classes, seed)
    weights = model.weights()
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    rng = np.random.default_rng(seed)
    done, mixed = 0, rng.permutation(len(pieces))
    shuffled, targets = [pieces[i] for i in mixed.tolist()], labels[mixed]
    batches = list(by_length(shuffled, 256))
    for epoch in range(epochs):
        speed = rate * (1 - epoch / epochs)
        for number in rng.permutation(len(batches)).tolist():
            part, data = batches[number]
            slopes, _ = model.gradients(data, targets[part])
            done += 1
            for w, m, v, slope in zip(weights, first, second, slopes):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                w -= speed * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.999**done)) + 1e-8)
    return model


class Labeller:
    """Pools what the network says at every byte of a text."""

    def __init__(self, model: Gru, names: list[str]):
        self.model, self.names = model, names
        self.number: dict[bytes, int] = {}
        self.sums = np.zeros((0, len(names)), np.float32)

    def learn_pieces(self, texts: list[list[bytes]]) -> None:
        if len(self.number) > MEMO_PIECES:
            self.number, self.sums = {}, self.sums[:0]
        fresh = list({p for some in texts for p in some if p not in self.number})
        if not fresh:
            return
        sums = np.zeros((len(fresh), len(self.names)), np.float32)
        for part, data in by_length(fresh, 4096):
            sums[part] = self.model.position_probs(data)[0].sum(axis=0)
        self.number.update(zip(fresh, range(len(self.sums), len(self.sums) + len(fresh))))
        self.sums = np.concatenate([self.sums, sums])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [bool(self.names) and text is not None and has_letter(text) for text in texts]
        parts = [pieces_of(text) if ok else [] for text, ok in zip(texts, known)]
        self.learn_pieces(parts)
        found = []
        for some in parts:
            if not some:
                found.append(("und", 0.0))
                continue
            at = np.fromiter(map(self.number.__getitem__, some), np.int64, len(some))
            pooled = self.sums[at].sum(axis=0, dtype=np.float64)
            best = int(pooled.argmax())
            found.append((self.names[best], float(min(1.0, pooled[best] / pooled.sum()))))
        return found


def fit(docs: DataFrame, learn: Column, seed: int = 5) -> tuple[Gru | None, list[str]]:
    """Train on a sample of the rows where `learn` holds and `lang` is known.

    The sample is bounded: `DOCS_PER_LANG` documents of each language, chosen by
    a hash of the id, and `PIECES_PER_DOC` pieces spread over each.
    """
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    turn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        usable.select("doc_id", "lang")
        .withColumn("turn", F.row_number().over(turn))
        .where(F.col("turn") <= DOCS_PER_LANG)
        .select(F.col("doc_id").alias("id"), F.col("lang").alias("learnt"))
        .distinct()
    )
    texts = usable.select("doc_id", "text", "lang").join(
        F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("learnt"))
    )

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            some = []
            for text in batch.column(0).to_pylist():
                words = pieces_of(text) if has_letter(text) else []
                step = max(1, len(words) // PIECES_PER_DOC)
                some.append(words[::step][:PIECES_PER_DOC])
            return {"lang": batch.column(1), "pieces": some}

        return step

    rows = per_slice(
        texts.select("text", "lang"), "text", "lang string, pieces array<binary>", work
    ).collect()
    rows = sorted((row.lang, bytes(p)) for row in rows for p in row.pieces)
    names = sorted({name for name, _ in rows})
    if not names:
        return None, []
    labels = np.array([names.index(name) for name, _ in rows])
    return train([p for _, p in rows], labels, len(names), seed=seed), names


def predict_language(docs: DataFrame, learn: Column) -> DataFrame:
    """`doc_id, lang_pred, score` for every row of `docs`, from its text alone.

    The network labels every byte of the whole text; the probabilities are
    pooled over the text, and `score` is that of the best language. Learns from
    the rows where `learn` holds; see `fit` for the sample.

    `lang_pred` is `und`, with score 0, where the text is null, empty or has no
    letter, or where there is nothing to learn from. Languages are whatever
    values `lang` holds; ties go to the first by name. Repeated rows and null
    ids are rows like others, and an empty table gives an empty result.
    """
    model, names = fit(docs, learn)
    rows = docs.select("doc_id", "text")

    def work():
        label = Labeller(model, names)

        def step(batch: pa.RecordBatch) -> dict:
            found = label(batch.column(1).to_pylist())
            return {
                "doc_id": batch.column(0),
                "lang_pred": [name for name, _ in found],
                "score": [score for _, score in found],
            }

        return step

    kind = rows.schema["doc_id"].dataType.simpleString()
    return per_slice(rows, "text", f"doc_id {kind}, lang_pred string, score double", work)
