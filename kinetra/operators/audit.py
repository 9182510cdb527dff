"""Audits of heterogeneous corpora: distributions, majorities, compatibility, and targets to harmonise to."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.schema import parse_axis

AXES = ("world_up", "rest_forward", "rest_up", "fps")
UNKNOWN = "unknown"


def fps_key(frame_time: Column) -> Column:
    """Frames per second with six significant digits and no trailing zeros, as Python's ``.6g`` writes it."""
    fps = 1 / frame_time
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(fps))).cast("int")
    scaled = F.rint(fps * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    text = F.format_string("%.6f", scaled)
    plain = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.when(frame_time.isNull() | (frame_time <= 0), F.lit(UNKNOWN)).otherwise(plain)


def _values(clips: DataFrame, axes) -> DataFrame:
    pairs = [F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a).cast("string"), F.lit(UNKNOWN)).alias("value")) for a in axes]
    return clips.select("clip_id", F.explode(F.array(*pairs)).alias("p")).select("clip_id", "p.axis", "p.value")


def values(clips: DataFrame, axes=AXES) -> DataFrame:
    """``clip_id, axis, value``: which clip has which value, as a table, since it grows with the clips."""
    return _values(clips, axes)


def distribution(clips: DataFrame, axes=AXES) -> DataFrame:
    """``axis, value, n`` in one pass over the clips."""
    return _values(clips, axes).groupBy("axis", "value").agg(F.count("*").alias("n"))


def majority(dist: DataFrame) -> DataFrame:
    """``axis, value, n``: the most frequent known value of each axis; of equals, the largest."""
    best = dist.where(F.col("value") != UNKNOWN).groupBy("axis").agg(F.max(F.struct("n", "value")).alias("b"))
    return best.select("axis", F.col("b.value").alias("value"), F.col("b.n").alias("n"))


def euler_order_majority(clips: DataFrame) -> DataFrame:
    """``value, n``: the most frequent order over all joints of all clips (one row, none for no joints)."""
    counts = clips.select(F.explode("euler_orders").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    best = counts.agg(F.max(F.struct("n", "value")).alias("b")).where("b is not null")
    return best.select(F.col("b.value").alias("value"), F.col("b.n").alias("n"))


def stage_counts(stages: DataFrame) -> DataFrame:
    """``stages(clip_id, stages array<string>)`` -> ``stage, n``."""
    return stages.select(F.explode("stages").alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


def incompatible(clips: DataFrame, with_orders: bool = False) -> DataFrame:
    """``clip_id, what``: clips whose joint names, parents (or, if asked, Euler orders) differ from those of
    the first clip by name. Offsets may differ."""
    checks = {"names": "joint_names", "parents": "parents", **({"euler orders": "euler_orders"} if with_orders else {})}
    first = clips.orderBy("clip_id").select(*checks.values()).first()
    if first is None:
        return clips.select("clip_id", F.lit(None).cast("string").alias("what")).limit(0)
    same = lambda c: F.col(c).eqNullSafe(F.lit(first[c]).cast(clips.schema[c].dataType))
    what = F.coalesce(*(F.when(~same(c), F.lit(n)) for n, c in checks.items()))
    return clips.select("clip_id", what.alias("what")).where("what is not null")


def check_compatible(clips: DataFrame, with_orders: bool = False) -> None:
    bad = incompatible(clips, with_orders).orderBy("clip_id").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['clip_id']} has other {bad[0]['what']} than the first clip")


def is_parallel(a: str | None, b: str | None) -> bool:
    """Whether two axes lie on one line; their signs don't count."""
    return a is not None and b is not None and parse_axis(a)[0] == parse_axis(b)[0]


def harmonize_targets(dist: dict[str, dict[str, int]], explicit: dict[str, object], *, mismatch: bool = False, order: str | None = None) -> dict[str, object]:
    """What every clip is brought to. Explicit targets win; else the majority of an axis on which clips differ.

    ``dist`` has the counts by axis and value. The rest pose's up axis is filled only where some clip's is not its world
    up (``mismatch``). Forward axes along the world up that clips will have are left out; if none is left, the axis
    stays as it is, with a warning; an explicit one along it is refused. ``order`` is the Euler order to fill in."""
    best = lambda counts: max(((n, v) for v, n in counts.items() if v != UNKNOWN), default=(0, None))[1]
    out = {a: explicit.get(a) for a in (*AXES, "euler_order")}
    for a in ("fps", "world_up"):
        if out[a] is None and len(dist.get(a, {})) > 1:
            out[a] = best(dist[a])
    if out["rest_up"] is None and mismatch:
        out["rest_up"] = best(dist.get("rest_up", {}))
    up = out["world_up"] or best(dist.get("world_up", {}))
    ahead = dist.get("rest_forward", {})
    if explicit.get("rest_forward"):
        if is_parallel(explicit["rest_forward"], up):
            raise ValueError(f"rest_forward {explicit['rest_forward']} lies along the world up of all clips, {up}")
    elif len(ahead) > 1:
        left = {v: n for v, n in ahead.items() if v != UNKNOWN and not is_parallel(v, up)}
        out["rest_forward"] = best(left)
        if not left:
            warnings.warn(f"all forward axes ({', '.join(sorted(ahead))}) lie along {up}: they stay as they are", stacklevel=2)
    out["euler_order"] = out["euler_order"] or order
    return {a: float(v) if a == "fps" else v for a, v in out.items() if v}


def reject_parallel_forward(clips: DataFrame, target_forward: str | None, target_up: str | None) -> None:
    """Names up to five clips whose up axis the target forward axis would lie along."""
    if target_forward is None:
        return
    up = F.lit(target_up) if target_up else F.col("world_up")
    bad = clips.where(F.substring(up, 2, 1) == target_forward[1]).orderBy("clip_id").limit(5)
    if names := [r["clip_id"] for r in bad.select("clip_id").collect()]:
        raise ValueError(f"rest_forward {target_forward} lies along the up axis of {', '.join(names)}")


def reject_degenerate_up(clips: DataFrame, target_rest_up: str | None) -> None:
    """Names up to five clips whose rest pose has no measurable up axis to turn."""
    if target_rest_up is None:
        return
    if names := [r["clip_id"] for r in clips.where("rest_up is null").orderBy("clip_id").limit(5).select("clip_id").collect()]:
        raise ValueError(f"no rest up axis can be measured in {', '.join(names)}")


def heterogeneity(clips: DataFrame, axes=AXES) -> DataFrame:
    """``axis, n_values, examples``: axes with several values, with up to three clips that differ from the most frequent."""
    values = _values(clips, axes)
    top = values.groupBy("axis", "value").agg(F.count("*").alias("n"))
    top = top.groupBy("axis").agg(F.max(F.struct("n", "value")).alias("b"), F.count("*").alias("n_values")).where("n_values > 1")
    odd = values.join(top, "axis").where(F.col("value") != F.col("b.value"))
    order = Window.partitionBy("axis").orderBy("clip_id")
    few = odd.withColumn("k", F.row_number().over(order)).where("k <= 3")
    return few.groupBy("axis", "n_values").agg(F.array_sort(F.collect_list("clip_id")).alias("examples"))


def warn_heterogeneous(clips: DataFrame, axes=AXES) -> None:
    for r in heterogeneity(clips, axes).orderBy("axis").collect():
        warnings.warn(f"clips have {r['n_values']} values of {r['axis']}, e.g. {', '.join(r['examples'])}", stacklevel=2)
