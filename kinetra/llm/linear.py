"""Sparse logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters, digits and bytes over 0x7F, and runs of other marks. Two streams of n-grams
are hashed into one table: lower-cased tokens (1 and 2 of them), and token shapes (1 to 3), a shape being
the marks themselves or a word's case and whether it repeats the word before. A feature's value is 1 for a
token n-gram and log(1 + count) for a shape n-gram, so any length of text is scored as one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.kernel import LOWER, SPACE, U, _spans, mix, slices, span_hashes, text_buffer
from kinetra.llm.scratch import Scratch, bound_batches

BITS = 20
#: The first columns stay free for inputs that are not hashed.
RESERVED = 16
#: Rows of an update, at every size of the sample.
BATCH = 2
#: Labelled rows and features that a fit takes at most, in the order of a hash of doc_id.
MAX_LABELLED, MAX_FEATURES = 16_000, 24_000_000

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_SMALL = np.zeros(256, np.int64)
_SMALL[0x61:0x7B] = 1


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of lower-cased tokens, hashes of their shapes, and the rows' bounds."""
    flat, offsets = text_buffer(column)
    ws, we = _spans(flat, offsets, ~_WORD)
    ms, me = _spans(flat, offsets, _WORD | SPACE)
    order = np.argsort(np.concatenate([ws, ms]), kind="stable")
    starts, ends = np.concatenate([ws, ms])[order], np.concatenate([we, me])[order]
    is_word = order < len(ws)
    token = span_hashes(LOWER[flat], starts, ends)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return token, token, bounds
    upper, small = (np.concatenate(([0], np.cumsum(t[flat])))[[starts, ends]] for t in (_UPPER, _SMALL))
    upper, small = upper[1] - upper[0], small[1] - small[0]
    again = np.zeros(len(token), bool)
    again[1:] = token[1:] == token[:-1]
    again[bounds[:-1][bounds[:-1] < len(token)]] = False  # a row's first token has none before it
    first_upper = _UPPER[flat[starts]] == 1
    kind = np.where(upper + small == 0, 0, np.where(small == 0, np.where(upper == 1, 1, 2), np.where(first_upper, 3, 4)))
    shape = np.where(is_word, mix((kind * 2 + again).astype(U) + U(77)), token)
    return token, shape, bounds


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, values) of each row; repeated n-grams count once or by log(1 + count), see above."""
    token, shape, bounds = _tokens(column)
    size = U((1 << BITS) - RESERVED)
    streams = []
    for salt, base, most in ((U(11), token, 2), (U(12), shape, 3)):
        h = np.full(len(base), salt, U)
        for n in range(most):
            h = mix(h[: len(base) - n] if n else h) + base[n:] if len(base) > n else np.zeros(0, U)
            streams.append((salt, n, (mix(h + U(n)) % size).astype(np.int32) + RESERVED))
    for a, b in zip(bounds[:-1], bounds[1:]):
        lexical = np.unique(np.concatenate([s[a : max(a, b - n)] for salt, n, s in streams if salt == 11]))
        forms, count = np.unique(np.concatenate([s[a : max(a, b - n)] for salt, n, s in streams if salt == 12]), return_counts=True)
        yield np.concatenate([lexical, forms]), np.concatenate([np.ones(len(lexical), np.float32), np.log1p(count).astype(np.float32)])


class Ftrl:
    """Follow-the-regularised-leader with a learning rate of its own for each weight."""

    def __init__(self, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = np.zeros(1 << BITS, bool) if isinstance(at, slice) else at < RESERVED
        if isinstance(at, slice):
            free[:RESERVED] = True
        l1 = np.where(free, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 3, seed: int = 7, batch: int = BATCH) -> np.ndarray:
        """Epochs in random order, in batches of ``batch`` rows, whatever the size of the sample: the gradients of a batch
        are summed before an update."""
        order = np.random.default_rng(seed)
        edges = [np.where(at < RESERVED, 0.0, self.l1) for at, _ in rows]
        total = np.zeros(1 << BITS)  # gradients of the batch at hand; zero between batches
        for _ in range(epochs):
            mixed = order.permutation(len(rows)).tolist()
            for own in (mixed[i : i + batch] for i in range(0, len(rows), batch)):
                sizes = [len(edges[i]) for i in own]
                at, x, edge = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own]), np.concatenate([edges[i] for i in own])
                z, n = self.z[at], self.n[at]
                root = np.sqrt(n)
                w = np.copysign(np.maximum(np.abs(z) - edge, 0), -z) / ((self.beta + root) / self.alpha + self.l2)
                score = np.add.reduceat(w * x, np.cumsum([0, *sizes[:-1]]))
                np.add.at(total, at, np.repeat(sigmoid(score) - labels[own], sizes) * x)
                g = total[at]  # a column that stands twice gets the same values twice
                n = n + g * g
                self.z[at], self.n[at] = z + g - (np.sqrt(n) - root) / self.alpha * w, n
                total[at] = 0
        return self.weights().astype(np.float32)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


#: Column of the constant input.
BIAS = 0


def with_inputs(row: tuple[np.ndarray, np.ndarray], extra: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """The row with the constant and with inputs of its own in the reserved columns after it."""
    at, x = row
    return np.concatenate([np.arange(BIAS, 1 + len(extra), dtype=np.int32), at]), np.concatenate([np.array([1.0, *extra], np.float32), x])


def labelled_rows(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """``(doc_id, at, x, labels)`` of the labelled documents that come first by a hash of doc_id: at most
    ``MAX_LABELLED`` of them, and with their features at most ``MAX_FEATURES`` (but the first one always).

    Labels of documents that ``docs`` lacks don't count. Of several labels of a document the largest counts, and
    labels with a null are left out. The sample is bounded, so its ids are broadcast and unlabelled texts do not move.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "labels")
    known = labels.dropna(subset=["doc_id", *columns]).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns))
    place = F.xxhash64("doc_id").alias("place")
    chosen = known.join(docs.select("doc_id"), "doc_id", "left_semi").select(place, "doc_id", *columns).orderBy("place", "doc_id").limit(MAX_LABELLED)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("place", "doc_id", "text", *columns)

    def run(batches):
        for batch in slices(batches):
            rows = list(features(batch.column("text")))
            cols = [batch.column("place"), batch.column("doc_id"), pa.array([len(a) for a, _ in rows], pa.int64()), pa.array([a.tobytes() for a, _ in rows], pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary()), *(batch.column(c).cast(pa.int32()) for c in columns)]
            yield pa.RecordBatch.from_arrays(cols, ["place", "doc_id", "size", "at", "x", *columns])

    made = scratch.table(picked.mapInArrow(run, "place long, doc_id long, size long, at binary, x binary, " + ", ".join(f"{c} int" for c in columns)))
    sizes = made.groupBy("place", "doc_id").agg(F.sum("size").alias("size")).orderBy("place", "doc_id").collect()  # at most MAX_LABELLED
    upto = np.cumsum([r["size"] for r in sizes]) <= MAX_FEATURES
    if len(sizes) and not upto.all():
        last = sizes[max(0, int(np.argmin(upto)) - 1)]
        made = made.where((F.col("place") < last["place"]) | ((F.col("place") == last["place"]) & (F.col("doc_id") <= last["doc_id"])))
    return made.select("doc_id", "at", "x", *columns)


def fit_in_one_task(rows: DataFrame, columns: list[str], train) -> list[np.ndarray]:
    """Runs ``train(rows, labels) -> list of weight vectors`` in a task over the bounded sample, in the order of doc_id.
    Features were made where the texts are; only they are shuffled to the task."""

    def run(batches):
        found = []
        for batch in batches:
            known = zip(*(batch.column(c).to_pylist() for c in columns))
            for doc, at, x, y in zip(batch.column("doc_id").to_pylist(), batch.column("at"), batch.column("x"), known):
                found.append((doc, np.frombuffer(at.as_py(), np.int32), np.frombuffer(x.as_py(), np.float32), y))
        if not found:
            return
        found.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))  # rows that repeat a doc_id in an order of their own
        labels = dict(zip(columns, np.array([r[3] for r in found]).T))
        for w in train([(at, x) for _, at, x, _ in found], labels):
            yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary())], ["w"])

    return [np.frombuffer(r.w, np.float32) for r in rows.repartition(1).mapInArrow(run, "w binary").collect()]
