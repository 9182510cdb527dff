"""Quality classifier: hashed word n-gram logistic regression, scored as sparse dot products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.kernel import slices
from kinetra.llm.linear import BITS, Ftrl, features, fit_in_one_task, labelled_rows, sigmoid, with_inputs
from kinetra.llm.scratch import bound_batches

THRESHOLD = 0.7


def fit_quality(docs: DataFrame, labels: DataFrame, column: str = "quality") -> np.ndarray:
    """Weights from the labelled rows (at most ``linear.MAX_LABELLED``); without any, all zeros.

    ``docs(doc_id, text, ...)``, ``labels(doc_id, column, ...)``. Null and empty texts have no features. Rows that repeat
    a labelled doc_id are learnt from each; for labels see ``linear.labelled_rows``. Other columns are ignored."""

    def train(rows, known):
        yield Ftrl().fit([with_inputs(r, []) for r in rows], known[column].astype(float))

    found = fit_in_one_task(labelled_rows(docs, labels, [column]), [column], train)
    return found[0] if found else np.zeros(1 << BITS, np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` for every row: the probability that the text is of quality 1.

    Null and empty texts score by the constant alone. Repeated rows score alike; other columns are
    ignored; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = held.value
        for batch in slices(batches):
            score = [float(sigmoid(float(w[at] @ x))) for at, x in (with_inputs(r, []) for r in features(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    scored = score_quality(docs, fit_quality(docs, labels.where(~held_out)))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
