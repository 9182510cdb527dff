"""Fused Arrow passes against the expression path, in every representation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.functions import kernels
from kinetra.functions import rotations as R
from kinetra.operators import augment
from kinetra.operators.clips import from_arrays
from kinetra.plans import fused
from kinetra.plans.draws import Draws
from kinetra.plans.pipeline import Pipeline, Step

ORDERS = ["ZXY", "XYZ", "YZX", "ZYX", "XZY"]
WIDTH = {"quat": 4, "6d": 6, "euler": 3, "axisangle": 3, "rotmat": 9}


def clips(spark, representation, joints=5, positions=False, n=6):
    r = np.random.default_rng(3)
    made = []
    for i in range(n):
        q = r.normal(size=(4 + 3 * i, joints, 4))
        q /= np.linalg.norm(q, axis=-1, keepdims=True)
        q[0, 0] = q[1, 0]  # two frames that agree
        clip = {"root_pos": r.normal(size=(len(q), 3)), "joint_rot": kernels.convert(q, "quat", representation, ORDERS[:joints])}
        made.append(clip | ({"joint_pos": r.normal(size=(len(q), joints, 3)), "node_pos": r.normal(size=(len(q), joints + 2, 3))} if positions else {}))
    return from_arrays(spark, made)[0]


def numbers(df):
    rows = df.orderBy("clip_id", "t").collect()
    assert all(r.t == (rows[i - 1].t + 1 if i and rows[i - 1].clip_id == r.clip_id else 0) for i, r in enumerate(rows))
    return [np.concatenate([np.ravel(r[c]) for c in df.columns if c not in ("clip_id", "t")]) for r in rows]


def same(steps, frames, seed=5, **how):
    a, b = (numbers(Pipeline(steps, fused=f, **how).apply(frames, seed=seed, epoch=2)) for f in (True, False))
    assert len(a) == len(b) and all(len(x) == len(y) for x, y in zip(a, b))
    np.testing.assert_allclose(np.concatenate(a), np.concatenate(b), atol=1e-9)


def standard(noise=True):
    steps = [
        Step(augment.rotate_vertical, 0.7, {"angle": lambda u: u.uniform(-3, 3, "angle"), "up_axis": "-z", "degrees": False}),
        Step(augment.mirror, 0.5, {"lateral_axis": "+x", "lr_joint_pairs": [(1, 2), (3, 4)], "lr_node_pairs": [(1, 2), (5, 6)]}),
        *([Step(augment.rotation_noise, 0.6, {"sigma": 3.0, "degrees": True})] if noise else []),
        Step(augment.root_noise, 0.5, {"sigma": 0.2, "centering": "world"}),
        Step(augment.speed, 0.8, {"factor": lambda u: u.uniform(0.6, 1.7, "factor")}),
        Step(augment.rotate_vertical, 1.0, {"angle": 30.0, "up_axis": "+y", "degrees": True}),
    ]
    return steps


@pytest.mark.parametrize("representation", sorted(WIDTH))
@pytest.mark.parametrize("share", [True, False])
def test_fused_steps_equal_expressions(spark, representation, share):
    same(standard(), clips(spark, representation), representation=representation, euler_orders=ORDERS, share_quaternions=share)


def test_positions_go_along(spark):
    same(standard(noise=False), clips(spark, "quat", positions=True), representation="quat")


def test_between_steps_that_are_not_fused(spark):
    own = lambda f: f.withColumn("root_pos", F.transform("root_pos", lambda x: x + 1))
    steps = [*standard()[:3], Step(own, 0.5), Step(augment.dropout, 0.9, {"rate": 0.4}), *standard()[2:]]
    same(steps, clips(spark, "6d"), representation="6d")


def test_clips_with_other_numbers_of_joints_in_a_batch(spark):
    both = clips(spark, "quat", 5, n=3).unionByName(clips(spark, "quat", 3, n=4).withColumn("clip_id", F.concat(F.lit("b"), "clip_id"))).coalesce(1)
    same([s for s in standard() if s.fn is not augment.mirror], both, representation="quat")


def test_numbers_of_generators(spark):
    frames = clips(spark, "6d")
    ids = frames.select("clip_id").distinct().withColumn("idx", F.col("clip_id").cast("int"))
    a, b = (numbers(Pipeline(standard(), representation="6d", fused=f).apply(frames, 3, 1, generators=ids)) for f in (True, False))
    np.testing.assert_allclose(np.concatenate(a), np.concatenate(b), atol=1e-9)


def test_no_rotations_and_no_rows(spark):
    frames = clips(spark, "quat").drop("joint_rot")
    same([s for s in standard(False)], frames)
    assert Pipeline(standard(), representation="quat").apply(clips(spark, "quat").where("t < 0"), seed=1).count() == 0


def test_zero_rotations_and_clips_without_joints_are_refused(spark):
    zero = clips(spark, "quat").withColumn("joint_rot", F.transform("joint_rot", lambda q: F.transform(q, lambda x: x * 0)))
    with pytest.raises(Exception, match="length zero"):
        Pipeline([Step(augment.rotation_noise, 1.0, {"sigma": 0.1})], representation="quat").apply(zero, seed=1).collect()
    none = clips(spark, "quat").withColumn("joint_rot", F.slice("joint_rot", 1, F.lit(0)))
    with pytest.raises(Exception, match="without joints"):
        Pipeline([Step(augment.rotate_vertical, 1.0, {"angle": 1.0, "up_axis": "+y"})], representation="quat").apply(none, seed=1).collect()


@pytest.mark.parametrize("source", sorted(WIDTH))
def test_conversions_of_kernels(spark, source):
    frames = clips(spark, source)
    x = np.array([r.joint_rot for r in frames.orderBy("clip_id", "t").collect()])
    for target in WIDTH:
        want = np.array([r[0] for r in frames.orderBy("clip_id", "t").select(R.convert_joints(F.col("joint_rot"), source, target, ORDERS)).collect()])
        np.testing.assert_allclose(kernels.convert(x, source, target, ORDERS), want, atol=1e-9)


def test_normals_are_those_of_the_plan(spark):
    draws = Draws(2**40 + 7, 3, 1)
    df = spark.range(5).select(F.concat(F.lit("é"), F.col("id").cast("string")).alias("clip_id"), F.col("id").cast("int").alias("t"))
    cells = [draws.normal("axis", F.lit(v), F.lit(c)).alias(f"n{v}{c}") for v in range(4) for c in range(3)]
    rows = df.select(draws.seed_of("a", "axis").alias("a"), draws.seed_of("b", "axis").alias("b"), *cells).collect()
    got = kernels.normals(np.array([r.a for r in rows]), np.array([r.b for r in rows]), 4, 3)
    np.testing.assert_allclose(got.reshape(5, 12), np.array([r[2:] for r in rows]), atol=1e-12)


def test_whole_tables(spark):
    frames = clips(spark, "euler").withColumn("root_pos", F.col("root_pos").cast("array<float>"))
    a = fused.change_speed(frames, 1.3, "euler", ORDERS)
    assert a.dtypes == frames.dtypes
    b = augment.speed(clips(spark, "euler"), factor=1.3, representation="euler", euler_orders=ORDERS)
    np.testing.assert_allclose(np.concatenate(numbers(a)), np.concatenate(numbers(b)), atol=1e-6)
    assert fused.convert_frames(frames, "euler", "euler") is frames
    for bad in (lambda: fused.convert_frames(frames, "euler", "quat"), lambda: fused.convert_frames(frames, "cube", "quat"), lambda: fused.change_speed(frames, 0.0, "quat"), lambda: fused.change_speed(frames, 1.0)):
        with pytest.raises(ValueError):
            bad()
