"""Normalisation statistics: mean, population deviation and constant channels, by dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.operators.packing import flat_row
from kinetra.operators.temporal import center_root

TINY = 1e-8


def moments(frames: DataFrame, streams) -> DataFrame:
    """``dim, n, mean, m2``: count, mean and summed squared deviations, which can be merged with those of other frames.
    Map-side sums make the shuffle one row per dimension and task."""
    cells = frames.select(F.posexplode(flat_row(streams)).alias("dim", "x"))
    found = cells.groupBy("dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("v"))
    return found.select("dim", "n", "mean", (F.col("v") * F.col("n")).alias("m2"))


def merge_moments(parts: DataFrame, *keys: str) -> DataFrame:
    """Moments of all frames from rows of parts (some per dimension), two at a time, which keeps their precision."""

    def both(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        share = b["n"] / F.greatest(n, F.lit(1))
        return F.struct(n.alias("n"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    listed = parts.groupBy(*keys, "dim").agg(F.array_sort(F.collect_list(F.struct("n", "mean", "m2"))).alias("parts"))  # a few builds
    return listed.select(*keys, "dim", F.aggregate("parts", none, both).alias("m")).select(*keys, "dim", "m.n", "m.mean", "m.m2")


def of_moments(found: DataFrame, *keys: str) -> DataFrame:
    """``dim, mean, std, constant``; a deviation under 1e-8 becomes 1 and marks the channel constant."""
    std = F.sqrt(F.col("m2") / F.col("n"))
    return found.select(*keys, "dim", "mean", F.when(std < TINY, 1.0).otherwise(std).alias("std"), (std < TINY).alias("constant"))


def channel_stats(frames: DataFrame, streams) -> DataFrame:
    """``dim, mean, std, constant`` over all frames."""
    return of_moments(moments(frames, streams))


def normalization_stats(frames: DataFrame, include_root: bool = True, center: bool = False) -> DataFrame:
    """Root first, then joints in order, then channels. Clips must have been checked to share a skeleton."""
    base = center_root(frames.select("clip_id", "t", "root_pos", "joint_rot")) if center else frames
    return channel_stats(base, ["root_pos", "joint_rot"] if include_root else ["joint_rot"])


def position_stats(frames: DataFrame, stream: str = "joint_pos") -> DataFrame:
    """A block of its own for positions, without the root."""
    return channel_stats(frames, [stream])


def _with_stats(packed: DataFrame, stats: DataFrame, f) -> DataFrame:
    """Statistics have as many rows as a frame has numbers, so they become literals of the plan."""
    rows = stats.orderBy("dim").select("mean", "std").collect()
    mean, std = F.array(*(F.lit(r["mean"]) for r in rows)), F.array(*(F.lit(r["std"]) for r in rows))
    return packed.withColumn("data", f(F.col("data"), mean, std))


def normalize(packed: DataFrame, stats: DataFrame) -> DataFrame:
    """z-scores of flat rows ``(clip_id, t, data)``."""
    z: Column = lambda x, m, s: F.zip_with(F.zip_with(x, m, lambda a, b: a - b), s, lambda a, b: a / b)
    return _with_stats(packed, stats, z)


def denormalize(packed: DataFrame, stats: DataFrame) -> DataFrame:
    back: Column = lambda x, m, s: F.zip_with(F.zip_with(x, s, lambda a, b: a * b), m, lambda a, b: a + b)
    return _with_stats(packed, stats, back)
