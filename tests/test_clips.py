import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.functions import arrays as A
from kinetra.functions import rotations as R
from kinetra.operators import clips, skeleton
from kinetra.plans import build, feed
from kinetra.sources import bvh, store
from tests_rig import rig


def some(n=3, joints=2, seed=0):
    r = np.random.default_rng(seed)
    return {"root_pos": r.normal(size=(n, 3)), "joint_rot": r.normal(size=(n, joints, 6)), "joint_pos": None}


def test_from_arrays(spark):
    frames, facts = clips.from_arrays(spark, [some(), some(5)], ["a", "b"], [1, 0])
    assert frames.count() == 8 and facts.where("clip_id = 'b' and n_frames = 5 and label = 0").count() == 1
    clips.check_clips(frames)
    old = clips.from_arrays(spark, [{"root_pos": [[1, 2, 3]], "joint_data": [[[1, 2, 3]]]}])[0]
    assert old.columns == ["clip_id", "t", "root_pos", "joint_rot"] and old.first().root_pos == [1.0, 2.0, 3.0]
    for bad in ([{"joint_rot": some()["joint_rot"]}], [{**some(), "speed": 1}], [{"root_pos": np.zeros((2, 3)), "joint_rot": np.zeros((3, 1, 6))}], [np.zeros(3)]):
        with pytest.raises(ValueError):
            clips.from_arrays(spark, bad)
    for how in ({"names": ["a"]}, {"labels": [1]}):
        with pytest.raises(ValueError):
            clips.from_arrays(spark, [some(), some()], **how)


@pytest.mark.parametrize(
    "column,value,what",
    [
        ("root_pos", "array(1D, 2D)", "three numbers"),
        ("t", "t + 1", "0, 1, 2"),
        ("joint_rot", "if(t = 1, slice(joint_rot, 1, 1), joint_rot)", "number of vertices"),
        ("joint_rot", "array(array(1D), array(1D, 2D))", "other widths"),
        ("joint_pos", "array(array(1D, 2D, 3D))", "disagree"),
        ("node_pos", "array(array(1D, 2D, 3D))", "fewer nodes"),
        ("joint_pos", "if(t = 1, null, array(array(1D, 2D, 3D), array(1D, 2D, 3D)))", "missing"),
    ],
)
def test_broken_clips_are_named(spark, column, value, what):
    frames = clips.from_arrays(spark, [some()], ["odd"])[0].withColumn(column, F.expr(value))
    with pytest.raises(ValueError, match=f"odd.*{what}"):
        clips.check_clips(frames)


def test_replace_and_equal(spark):
    frames = clips.from_arrays(spark, [some()])[0]
    assert clips.equal(frames, frames.repartition(3)) and not clips.equal(frames, frames.limit(2))
    assert clips.replace(frames, joint_rot=None).columns == ["clip_id", "t", "root_pos"]
    with pytest.raises(ValueError):
        clips.replace(frames, root_pos=F.array(F.lit(1.0)))
    with pytest.raises(ValueError):
        clips.replace(frames, speed=F.lit(1.0))


def test_files_to_feed_and_rest_targets(spark, tmp_path):
    for i in range(2):
        bvh.write(str(tmp_path / f"c{i}.bvh"), rig(5, seed=i))
    f = feed.from_files(spark, str(tmp_path), "quat", include_positions=True, label=lambda s: F.substring(s, 2, 1), streams=["root_pos", "joint_pos"], target_length=4)
    assert {(r.label, len(r.data), len(r.data[0])) for r in f.items().collect()} == {(0, 4, 15), (1, 4, 15)}
    parsed = bvh.scan(spark, str(tmp_path))
    both = clips.extract(bvh.frames(parsed), "6d", rig()["euler_orders"], quats=True).first()
    np.testing.assert_allclose(A.sixd_to_matrix(np.array(both.joint_rot)), A.quat_to_matrix(np.array(both.joint_quats)), atol=1e-9)
    with pytest.raises(ValueError):
        clips.extract(bvh.frames(parsed), "rotmat", None)
    nodes = bvh.skeletons(parsed)
    assert {(r.world_up, r.rest_up, r.rest_forward) for r in build.with_axes(parsed).collect()} == {("+y", "+y", "+z")}
    plain = build.preprocess(spark, str(tmp_path), str(tmp_path / "p"), "quat", center=False, include_positions=True)
    turned = build.preprocess(spark, str(tmp_path), str(tmp_path / "q"), "quat", center=False, include_positions=True, target_rest_up="+z", target_euler_order="XYZ")
    assert plain["skeleton_info"]["rest_up"] == "+y" and turned["skeleton_info"]["rest_up"] == "+z" and turned["skeleton_info"]["euler_orders"] == ["XYZ"] * 4
    a, b = (np.array([r.joint_pos for r in store.load(spark, str(tmp_path / d)).frames.orderBy("clip_id", "t").collect()]) for d in "pq")
    np.testing.assert_allclose(a, b, atol=1e-9)
    with pytest.raises(ValueError):
        build.preprocess(spark, str(tmp_path), str(tmp_path / "r"), target_rest_up="+z", target_rest_forward="-z")
    top = skeleton.topology(nodes.where("skeleton = 'c0'"))
    got = parsed.select(clips.joints_of_nodes(F.col("offsets"), top).alias("o")).first().o
    assert got == [rig()["offsets"][i] for i in (0, 1, 3, 5)]


def test_slerp_the_long_way(spark):
    q = spark.range(1).select(R.slerp(F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))), F.array(*map(F.lit, (-0.8, 0.6, 0.0, 0.0))), F.lit(0.5), shortest=False).alias("x"), R.slerp(F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))), F.array(*map(F.lit, (-0.8, 0.6, 0.0, 0.0))), F.lit(0.5)).alias("y")).first()
    assert np.dot(q.x, q.y) == pytest.approx(0, abs=1e-9)
