"""Connected components by alternating large-star and small-star steps, all on executors. Each task first joins the edges
that it holds anyway, then as few tasks as edges need join those stars, however many partitions they came in; so rounds, and
their plans in the driver, are left for what spans more than ``CHUNK_EDGES`` edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.scratch import Scratch
from kinetra.llm.skew import join_groups


#: Edges that a task joins at once.
CHUNK_EDGES = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(node, root)`` for every node of the edges but the roots; a root is the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        a, b, low, high = (x[low != high] for x in (a, b, low, high))
        np.minimum.at(up, high, low)
        while not np.array_equal(far := up[up], up):
            up = far
    own = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[own], nodes[up[own]]


def _joined(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` as the stars of each task's edges: the same nodes and components, no more edges. Two tasks may both
    give an edge."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        node, root = stars(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in "uv"))
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["u", "v"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_EDGES:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _state(held: DataFrame) -> tuple[int, int]:
    """Edges, and nodes that are not yet in a star: with two smaller neighbours, or with a smaller and a larger one."""
    ends = held.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(held.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to")))
    node = ends.groupBy("node").agg(F.count("to").alias("n"), F.min("to").alias("low"), F.max("to").alias("high"), F.max(F.col("to").isNull()).alias("centre"))
    found = node.agg(F.sum("n"), F.count_if((F.col("low") < F.col("high")) | (F.col("low").isNotNull() & F.col("centre")))).first()
    return found[0] or 0, found[1]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(u, v)`` longs -> ``(node, root)``, root the smallest node of the component, for every
    node that has an edge to another one. Self-loops and repeated edges are allowed; nulls are ignored;
    an empty input gives an empty result. Each round is written to the shared folder and rereads it."""
    u, v = F.col("u"), F.col("v")

    def gathered(held: DataFrame, rows: int) -> DataFrame:
        """Joined by a task for each ``CHUNK_EDGES`` rows; a single one leaves stars only, each edge once."""
        new = scratch.table(_joined(held.coalesce(max(1, -(-rows // CHUNK_EDGES)))))
        scratch.drop(held)
        return new

    held = scratch.table(_joined(edges.where(u != v)))
    rows = held.count()
    held = gathered(held, rows)
    while rows > CHUNK_EDGES:
        rows, apart = _state(held)
        if not apart:
            break
        if rows <= CHUNK_EDGES:
            held = gathered(held, rows)
            break
        both = held.unionByName(held.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"), F.sum((v > u).cast("long")).alias("rows"))
        large = join_groups(both.where(v > u), low, ["u"], "rows", rows, ["v"]).select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
        small = join_groups(large, low, ["u"], "rows", rows, ["v"]).where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        new = scratch.table(_joined(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()))
        scratch.drop(held)
        held = new
    return held.select(u.alias("node"), v.alias("root")).distinct().unionByName(held.select(v.alias("node"), v.alias("root")).distinct())
