"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model gets the probabilities of the
categories before it as inputs. In training these are out-of-fold predictions, so a later model sees
what it will see on new texts. Where only an overall label is known, the earlier categories are weak
ones found in the labelled sample: texts with a marker (a feature that stands in toxic texts almost
only), and texts with several.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kinetra.llm.kernel import slices
from kinetra.llm.linear import BITS, Ftrl, features, fit_in_one_task, labelled_rows, sigmoid, with_inputs
from kinetra.llm.scratch import bound_batches

FOLDS = 3
REJECT = 0.5
CHAIN = ["marked", "severe", "toxic"]
#: A marker stands in this many toxic rows at least, and this share of its rows is toxic.
MARKER_ROWS, MARKER_SHARE = 4, 0.9
#: A column that a model may use stands in this many rows at least, and its likelihood ratio statistic
#: is this large: chance passes it in five of a thousand columns, at any share of positive rows.
TELLING_ROWS, TELLING = 4, 7.88


def counts(rows: list, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column, the rows and the positive rows it stands in."""
    seen, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for (at, _), v in zip(rows, y):
        seen[at] += 1
        bad[at] += v
    return seen, bad


def telling(seen: np.ndarray, bad: np.ndarray, n: int, positive: float) -> np.ndarray:
    """Which columns tell positive rows from others, of ``n`` rows with ``positive`` positive ones: those whose
    two-by-two table with the label is no chance. Most n-grams of a sample are chance."""
    ok = seen >= TELLING_ROWS
    if not 0 < positive < n:
        return np.zeros(len(seen), bool)
    s, b = seen[ok], bad[ok]
    share = positive / n
    cells = [(b, s * share), (s - b, s * (1 - share)), (positive - b, (n - s) * share), (n - positive - s + b, (n - s) * (1 - share))]
    ok[ok] = 2 * sum(o * np.log(np.where(o > 0, o, 1) / np.where(o > 0, e, 1)) for o, e in cells) >= TELLING
    return ok


def weak_categories(rows: list, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Labels ``marked`` (toxic, with a marker) and ``severe`` (toxic, with two or more)."""
    seen, bad = counts(rows, toxic)
    marker = telling(seen, bad, len(rows), toxic.sum()) & (bad >= MARKER_ROWS) & (bad >= MARKER_SHARE * seen)
    count = np.array([int(marker[at].sum()) for at, _ in rows])
    return {"marked": (toxic == 1) & (count > 0), "severe": (toxic == 1) & (count > 1)}


def _fit(rows: list, extra: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    ok = telling(*counts(rows, y), len(rows), y.sum())
    cut = ((at[ok[at]], x[ok[at]]) for at, x in rows)
    return Ftrl(alpha=0.5, l1=0.5, l2=0.1).fit([with_inputs(r, [float(p[i]) for p in extra]) for i, r in enumerate(cut)], y, epochs=10)


def train_chain(rows: list, labels: dict[str, np.ndarray], chain: list[str], folds: int = FOLDS) -> list[np.ndarray]:
    """A weight vector for each category; ``labels`` has a 0/1 array for each."""
    fold = np.arange(len(rows)) % folds
    earlier: list[np.ndarray] = []
    out = []
    for name in chain:
        y = np.asarray(labels[name], float)
        out.append(_fit(rows, earlier, y))
        if name != chain[-1]:
            p = np.zeros(len(rows))
            for k in range(folds):
                own, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
                w = _fit([rows[i] for i in own], [e[own] for e in earlier], y[own])
                for i in rest:
                    at, x = with_inputs(rows[i], [float(e[i]) for e in earlier])
                    p[i] = sigmoid(float(w[at] @ x))
            earlier.append(p)
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, chain: list[str] | None = None) -> tuple[list[str], list[np.ndarray]]:
    """The chain and its weights. With ``chain``, labels has a 0/1 column for each category; without,
    it has ``toxic`` and the earlier categories are weak ones. Without labelled rows nothing is toxic.

    Null and empty texts have no features. Rows that repeat a labelled doc_id are learnt from each; for labels
    see ``linear.labelled_rows``. Other columns are ignored."""
    columns = chain or ["toxic"]

    def train(rows, known):
        found = known if chain else {**weak_categories(rows, known["toxic"]), **known}
        yield from train_chain(rows, found, chain or CHAIN)

    names = chain or CHAIN
    weights = fit_in_one_task(labelled_rows(docs, labels, columns), columns, train)
    return names, weights or [np.eye(1, 1 << BITS, dtype=np.float32)[0] * -40.0 for _ in names]


def score_toxicity(docs: DataFrame, names: list[str], weights: list[np.ndarray]) -> DataFrame:
    """``docs`` plus ``p_<category>`` for each category of the chain, in order.

    Null and empty texts score by the constants. Repeated rows score alike; an empty table gives an
    empty result; columns of ``docs`` named like a new one are replaced.
    """
    new = [f"p_{n}" for n in names]
    docs = docs.drop(*new)
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in slices(batches):
            probs: list[list[float]] = [[] for _ in new]
            for row in features(batch.column("text")):
                before: list[float] = []
                for w, out in zip(held.value, probs):
                    at, x = with_inputs(row, before)
                    before.append(float(sigmoid(float(w[at] @ x))))
                    out.append(before[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p, pa.float64()) for p in probs)], [*batch.schema.names, *new])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(n, DoubleType()) for n in new)]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    names, weights = fit_toxicity(docs, labels)
    return score_toxicity(docs, names, weights)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, with the same columns."""
    return scored(docs, labels).where(F.col("p_toxic") < REJECT).select(docs.columns)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    toxic = F.col("p_toxic") >= REJECT
    return out.select("doc_id", *(f"p_{n}" for n in CHAIN), F.col("p_toxic").alias("score"), toxic.cast("int").alias("predicted"), toxic.alias("toxic"), (~toxic).alias("kept"))
