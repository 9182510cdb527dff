"""Clips as tables: making them from arrays, checking their shapes, replacing streams, comparing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.functions.rotations import convert_joints
from kinetra.operators.skeleton import Topology
from kinetra.schema import STREAMS, present, require_representation

#: Representations that clips are extracted and stored in.
EXTRACTED = ("euler", "quat", "6d", "axisangle")


def violations(frames: DataFrame) -> DataFrame:
    """``clip_id, what``: clips that are no clips, each with its first fault. A clip has gapless frames from 0,
    three root numbers, equal joint counts in all frames and joint streams, equal channel counts, positions of
    three numbers, and no fewer nodes than joints."""
    checks: list[tuple[str, Column]] = [("t is not 0, 1, 2, ...", (F.min("t") != 0) | (F.max("t") != F.count("*") - 1) | (F.countDistinct("t") != F.count("*")))]
    for s in present(frames.columns):
        checks.append((f"{s} is missing in some frames", F.count(s) != F.count("*")))
        if s == "root_pos":
            checks.append(("root_pos has not three numbers", F.max((F.size(s) != 3).cast("int")) == 1))
        else:
            widths = F.transform(s, lambda v: F.size(v))
            checks.append((f"{s} changes its number of vertices", F.min(F.size(s)) != F.max(F.size(s))))
            odd = (F.array_min(widths) != F.array_max(widths)) if s == "joint_rot" else F.exists(s, lambda v: F.size(v) != 3)
            checks.append((f"{s} has vertices of other widths", F.max(odd.cast("int")) == 1))
    have = set(present(frames.columns))
    if {"joint_rot", "joint_pos"} <= have:
        checks.append(("joint_rot and joint_pos disagree about joints", F.max((F.size("joint_rot") != F.size("joint_pos")).cast("int")) == 1))
    for s in ("joint_rot", "joint_pos"):
        if {s, "node_pos"} <= have:
            checks.append((f"there are fewer nodes than joints in {s}", F.max((F.size("node_pos") < F.size(s)).cast("int")) == 1))
    found = frames.groupBy("clip_id").agg(F.coalesce(*(F.when(c, F.lit(n)) for n, c in checks)).alias("what"))
    return found.where("what is not null")


def check_clips(frames: DataFrame) -> None:
    """Refuses a table in which some clip is broken, and names one."""
    if "root_pos" not in frames.columns:
        raise ValueError("clips need root_pos")
    bad = violations(frames).orderBy("clip_id").limit(1).collect()
    if bad:
        raise ValueError(f"clip {bad[0]['clip_id']}: {bad[0]['what']}")


def from_arrays(spark: SparkSession, clips: list[dict], names: list[str] | None = None, labels: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Frame rows and clip rows of clips in memory: dicts of stream name -> array with frames first.
    ``joint_data`` is an old name of ``joint_rot``; numbers that are not floats become doubles."""
    for what, given in (("names", names), ("labels", labels)):
        if given is not None and len(given) != len(clips):
            raise ValueError(f"{len(given)} {what} for {len(clips)} clips")
    ids = names or [f"{i:06d}" for i in range(len(clips))]
    rows, have = [], set()
    for name, clip in zip(ids, clips):
        if not isinstance(clip, dict):
            raise ValueError("a clip in memory is a dict of arrays")
        own = {("joint_rot" if k == "joint_data" else k): np.asarray(v, float) for k, v in clip.items() if v is not None}
        if bad := set(own) - set(STREAMS):
            raise ValueError(f"unknown streams {sorted(bad)}")
        if "root_pos" not in own:
            raise ValueError("clips need root_pos")
        if len({len(v) for v in own.values()}) > 1:
            raise ValueError(f"streams of {name} have different numbers of frames")
        have |= own.keys()
        rows += [{"clip_id": name, "t": t, **{k: v[t].tolist() for k, v in own.items()}} for t in range(len(own["root_pos"]))]
    schema = "clip_id string, t int, " + ", ".join(f"{s} array<{'double' if s == 'root_pos' else 'array<double>'}>" for s in STREAMS if s in have)
    facts = [(n, len(c["root_pos"]), None if labels is None else int(labels[i])) for i, (n, c) in enumerate(zip(ids, clips))]
    return spark.createDataFrame(rows, schema), spark.createDataFrame(facts, "clip_id string, n_frames int, label long")


def replace(frames: DataFrame, **streams: Column | None) -> DataFrame:
    """The clips with some streams replaced (None takes one away), checked again."""
    if bad := set(streams) - set(STREAMS):
        raise ValueError(f"unknown streams {sorted(bad)}")
    gone = [s for s, v in streams.items() if v is None]
    out = frames.drop(*gone).withColumns({s: v for s, v in streams.items() if v is not None})
    check_clips(out)
    return out


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same clips, number for number, in whatever order."""
    if set(a.columns) != set(b.columns):
        return False
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def extract(frames: DataFrame, representation: str, euler_orders, quats: bool = False) -> DataFrame:
    """Euler clips of motion files in another representation, with ``joint_quats`` beside if asked. Both come
    from one quaternion per joint, made once. Orders may be a column with each row's own."""
    require_representation(representation, EXTRACTED)
    held = frames.withColumn("_q", convert_joints(F.col("joint_rot"), "euler", "quat", euler_orders))
    out = held if representation == "euler" else held.withColumn("joint_rot", convert_joints(F.col("_q"), "quat", representation, euler_orders))
    return (out.withColumn("joint_quats", F.col("_q")) if quats else out).drop("_q")


def joints_of_nodes(nodes: Column, top: Topology) -> Column:
    """The joints' part of a node stream, in joint order, wherever end sites stand."""
    return F.transform(F.array(*map(F.lit, top.joint_nodes)), lambda n: nodes[n])
