"""Joins on keys of which a few may hold most rows, and names that can't clash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in so many; there are at most so many hot keys.
HOT = 1024


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns called ``in0, in1, ...``, so that columns of an operator's own clash with none, and the new
    name of each old one."""
    new = [f"in{i}" for i in range(len(df.columns))]
    return df.toDF(*new), dict(zip(df.columns, new))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, spread: list[str]) -> DataFrame:
    """``rows`` left-joined with ``groups``, which has each value of ``keys`` once and, in ``size``, its number of rows.

    Hot keys, at most ``HOT`` whatever the input's size, are broadcast. Rows that met one are dealt by a hash of
    ``spread`` in the shuffled join with all other keys, so that no task gets a hot key's rows. Adds the columns
    of ``groups``; ``keys`` must not be null in ``groups``. Columns named ``_hot``, ``_cold`` and ``_deal`` are taken.
    """
    values = [c for c in groups.columns if c not in keys]
    big = F.col(size) * HOT >= total
    packed = F.struct(*(F.col(c) for c in values))
    hot = F.broadcast(groups.where(big).select(*keys, packed.alias("_hot")))
    none = F.pmod(F.xxhash64(*keys), F.lit(1).cast("long"))  # 0, but no literal: the planner would take one out of the join's keys
    cold = groups.where(~big).select(*keys, packed.alias("_cold"), none.alias("_deal"))
    met = rows.join(hot, keys, "left")
    met = met.withColumn("_deal", F.when(F.col("_hot").isNotNull(), F.xxhash64(*spread)).otherwise(F.lit(0).cast("long")))
    out = met.join(cold, [*keys, "_deal"], "left").withColumn("_any", F.coalesce("_hot", "_cold"))
    return out.select(*rows.columns, *(F.col(f"_any.{c}").alias(c) for c in values))
