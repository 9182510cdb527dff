"""Rotations, sequence lengths, augmentation and kinematics against NumPy, and the rules that tie them together."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.functions import arrays as A
from kinetra.functions import rotations as R
from kinetra.operators import audit, augment, harmonize, packing, skeleton, stats, temporal

RNG = np.random.default_rng(42)


def unit(n, j):
    q = RNG.normal(size=(n, j, 4))
    return q / np.linalg.norm(q, axis=-1, keepdims=True)


def clips(spark, *lengths, joints=5, positions=False):
    rows, kept = [], {}
    for c, n in enumerate(lengths):
        root, rot, pos = RNG.normal(size=(n, 3)) * 10, unit(n, joints), RNG.normal(size=(n, joints, 3))
        kept[c] = (root, rot, pos)
        rows += [(c, t, root[t].tolist(), rot[t].tolist(), pos[t].tolist()) for t in range(n)]
    df = spark.createDataFrame(rows, "clip_id int, t int, root_pos array<double>, joint_rot array<array<double>>, joint_pos array<array<double>>")
    return (df if positions else df.drop("joint_pos")).repartition(3), kept


def stream(df, name, clip=0):
    return np.array([r[name] for r in df.where(F.col("clip_id") == clip).orderBy("t").collect()])


def convert(spark, values, source, target, order=None):
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(values)], "clip_id int, t int, x array<array<double>>")
    return stream(df.withColumn("x", R.convert_joints(F.col("x"), source, target, order)), "x")


@pytest.mark.parametrize("target", ["6d", "axisangle", "rotmat", "euler"])
def test_representations_agree_with_numpy(spark, target):
    q = unit(40, 6)
    orders = ["XYZ", "XZY", "YXZ", "YZX", "ZXY", "ZYX"]
    out = convert(spark, q, "quat", target, orders)
    np.testing.assert_allclose(A.to_matrix(out, target, orders), A.quat_to_matrix(q), atol=1e-9)
    back = convert(spark, out, target, "quat", orders)
    np.testing.assert_allclose(A.quat_to_matrix(back), A.quat_to_matrix(q), atol=1e-9)


def test_gimbal_lock_keeps_the_rotation(spark):
    e = np.array([[[0.3, math.pi / 2, 0.4], [0.1, -math.pi / 2, -0.7]]])
    for order in ("XYZ", "ZYX", "YXZ"):
        m = A.euler_to_matrix(e, order)
        back = convert(spark, convert(spark, e, "euler", "quat", order), "quat", "euler", order)
        np.testing.assert_allclose(A.euler_to_matrix(back, order), m, atol=1e-6)


def test_conversion_refusals(spark):
    for f in (lambda: R.convert_joints(F.lit(None), "euler", "quat"), lambda: R.to_quat(F.lit(None), "nope")):
        with pytest.raises(ValueError):
            f()


def test_resample_is_linear_interpolation(spark):
    df, kept = clips(spark, 17, 2, 1)
    for target in (1, 2, 5, 17, 40):
        out = temporal.resample(df.drop("joint_rot"), F.lit(target))
        for c, (root, _, _) in kept.items():
            want = np.stack([np.interp(np.linspace(0, 1, target), np.linspace(0, 1, len(root)) if len(root) > 1 else [0.0], root[:, k]) for k in range(3)], 1)
            np.testing.assert_allclose(stream(out, "root_pos", c), want, atol=1e-9)


def test_speed_one_changes_nothing_and_rounds_half_to_even(spark):
    df, kept = clips(spark, 10)
    same = augment.speed(df, factor=1.0, representation="quat")
    np.testing.assert_allclose(stream(same, "joint_rot"), kept[0][1], atol=1e-12)
    assert augment.speed(df, factor=4.0, representation="quat").count() == 2  # 2.5 frames


def test_windows_lengths_and_samples(spark):
    df, kept = clips(spark, 23, 4)
    w = temporal.sliding_windows(df, 6, 4)
    assert w.where("clip_id = 0").select("window").distinct().count() == (23 - 6) // 4 + 1
    assert w.where("clip_id = 1").count() == 0
    padded = temporal.standardize(df, 10, "pad")
    assert stream(padded, "root_pos", 1).shape == (10, 3) and not stream(padded, "root_pos", 1)[4:].any()
    assert stream(padded, "length", 1).tolist() == [4] * 10
    np.testing.assert_array_equal(stream(temporal.standardize(df, 9, "crop"), "root_pos"), kept[0][0][7:16])
    for length in (4, 15, 23, 40):
        idx = [r.idx for r in temporal.temporal_indices(temporal.frame_counts(df), length).where("clip_id = 0").orderBy("i").collect()]
        assert len(idx) == length and all(np.diff(idx) >= 1)
        if length <= 23:
            assert 0 <= min(idx) and max(idx) < 23
        if 2 * length <= 23:
            assert all(i * 23 // length <= x < (i + 1) * 23 // length for i, x in enumerate(idx))
    first = temporal.temporal_indices(temporal.frame_counts(df), 6, "test").orderBy("clip_id", "i").collect()
    assert first == temporal.temporal_indices(temporal.frame_counts(df.repartition(7)), 6, "test").orderBy("clip_id", "i").collect()
    for bad in (lambda: temporal.standardize(df, 5, "stretch"), lambda: temporal.apply_temporal(df, None, "crop"), lambda: temporal.sliding_windows(df, 0)):
        with pytest.raises(ValueError):
            bad()


def test_centring_rules(spark):
    df, kept = clips(spark, 6, positions=True)
    root, _, pos = kept[0]
    np.testing.assert_allclose(stream(temporal.center_root(df, "world"), "joint_pos"), pos - root[0], atol=1e-12)
    np.testing.assert_allclose(stream(temporal.center_root(df, "skeleton"), "joint_pos"), pos)
    with pytest.raises(ValueError):
        temporal.center_root(df)
    v = stream(temporal.derive(df, ["joint_vel", "joint_acc"]), "joint_acc")
    np.testing.assert_allclose(v[2:], np.diff(pos, 2, axis=0), atol=1e-12)
    assert not v[:2].any()


def test_pack_and_unpack(spark):
    df, kept = clips(spark, 7)
    root, rot, _ = kept[0]
    ctv = np.array(packing.pack_ctv(df, representation="quat", center=False).first().data)
    assert ctv.shape == (4, 7, 6)
    np.testing.assert_array_equal(ctv[:3, :, 0].T, root)
    assert not ctv[3, :, 0].any()
    np.testing.assert_array_equal(np.moveaxis(ctv[:, :, 1:], 0, 2), rot)
    back = packing.unpack_ctv(packing.pack_ctv(df, representation="quat", center=False))
    np.testing.assert_array_equal(stream(back, "joint_rot"), rot)
    flat = packing.pack_flat(df, center=False)
    np.testing.assert_array_equal(stream(packing.unpack_flat(flat, 3, 4), "joint_rot"), rot)
    with pytest.raises(Exception, match="divide"):
        packing.unpack_flat(flat, 3, 7).collect()
    with pytest.raises(ValueError):
        packing.pack(df, "voxels")


def test_mirror_twice_is_nothing_and_representations_agree(spark):
    df, kept = clips(spark, 8, positions=True)
    how = {"lateral_axis": "+x", "lr_joint_pairs": [(1, 2), (3, 4)]}
    twice = augment.mirror(augment.mirror(df, representation="quat", **how), representation="quat", **how)
    np.testing.assert_allclose(stream(twice, "joint_rot"), kept[0][1], atol=1e-12)
    np.testing.assert_allclose(stream(twice, "joint_pos"), kept[0][2], atol=1e-12)
    want = A.quat_to_matrix(stream(augment.mirror(df, representation="quat", **how), "joint_rot"))
    s = np.diag([-1.0, 1, 1])
    np.testing.assert_allclose(want, (s @ A.quat_to_matrix(kept[0][1]) @ s)[:, [0, 2, 1, 4, 3]], atol=1e-12)
    for r in ("6d", "rotmat", "axisangle", "euler"):
        orders = ["XYZ", "ZYX", "YXZ", "ZXY", "XZY"]
        other = df.withColumn("joint_rot", R.convert_joints(F.col("joint_rot"), "quat", r, orders))
        got = stream(augment.mirror(other, representation=r, euler_orders=orders, **how), "joint_rot")
        np.testing.assert_allclose(A.to_matrix(got, r, orders), want, atol=1e-6)
    with pytest.raises(ValueError):
        augment.mirror(df, lateral_axis="+x", representation="quat")


def test_rotate_turns_everything_alike(spark):
    df, kept = clips(spark, 5, positions=True)
    for up in ("+y", "-z"):
        q = augment.rotate_vertical(df, angle=90, degrees=True, up_axis=up, representation="quat")
        six = df.withColumn("joint_rot", R.convert_joints(F.col("joint_rot"), "quat", "6d"))
        d = augment.rotate_vertical(six, angle=90, degrees=True, up_axis=up, representation="6d")
        np.testing.assert_allclose(A.sixd_to_matrix(stream(d, "joint_rot")), A.quat_to_matrix(stream(q, "joint_rot")), atol=1e-9)
        np.testing.assert_array_equal(stream(q, "joint_rot")[:, 1:], kept[0][1][:, 1:])
        np.testing.assert_allclose(np.linalg.norm(stream(q, "joint_pos"), axis=-1), np.linalg.norm(kept[0][2], axis=-1))


def test_dropout_fills_between_kept_frames(spark):
    df, kept = clips(spark, 9)
    out = augment.dropout(df, rate=0.5, draw=(F.col("t") % 3) / 3.0, representation="quat")
    root = kept[0][0]
    np.testing.assert_allclose(stream(out, "root_pos")[3:5], [root[2] + (root[5] - root[2]) * k / 3 for k in (1, 2)], atol=1e-12)
    np.testing.assert_array_equal(stream(out, "joint_rot")[[0, 2, 5, 8]], kept[0][1][[0, 2, 5, 8]])


def test_noise_rules(spark):
    df, kept = clips(spark, 4, positions=True)
    draw = lambda w, v, c: F.lit(1.0)
    with pytest.raises(ValueError):
        augment.rotation_noise(df, sigma=0.1, draw=draw, representation="quat")
    with pytest.raises(ValueError):
        augment.joint_position_noise(df, sigma=0.1, draw=draw)
    with pytest.raises(ValueError):
        augment.root_noise(df, sigma=0.1, draw=draw)
    moved = augment.root_noise(df, sigma=0.5, draw=draw, centering="skeleton")
    np.testing.assert_array_equal(stream(moved, "joint_pos"), kept[0][2])
    np.testing.assert_allclose(stream(moved, "root_pos"), kept[0][0] + 0.5)
    out = augment.rotation_noise(df.drop("joint_pos"), sigma=0.1, draw=draw, representation="quat")
    np.testing.assert_allclose(np.linalg.norm(stream(out, "joint_rot"), axis=-1), 1)


def tree(spark):
    """Two hands, the left with two tips and the right with one, and a head tip before them in file order."""
    rows = [(0, "Hips", None, 0), (1, "Head", 0, 1), (2, "Head_end", 1, None), (3, "LeftHand", 0, 2), (4, "l1", 3, None), (5, "l2", 3, None), (6, "RightHand", 0, 3), (7, "r1", 6, None)]
    return spark.createDataFrame([(n, s, p, j, float(n), 1.0, 0.5 * n, "ZYX") for n, s, p, j in rows], "node int, name string, parent int, joint_idx int, off_x double, off_y double, off_z double, euler_order string")


def test_skeleton_graph(spark):
    nodes = tree(spark)
    pick = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert pick(skeleton.lr_pairs(nodes), "left", "right") == [(2, 3)]
    assert pick(skeleton.node_lr_pairs(nodes), "left", "right") == [(3, 6), (4, 7)]
    assert pick(skeleton.mismatched_end_sites(nodes), "left", "right", "n_left", "n_right") == [(2, 3, 2, 1)]
    assert pick(skeleton.edges(nodes), "child", "parent") == [(1, 0), (2, 0), (3, 0)]
    assert dict(pick(skeleton.depths(nodes), "node", "depth"))[7] == 2
    info = skeleton.skeleton_info(nodes, partitions=True)
    assert info["end_site_indices"] == [2, 4, 5, 7] and info["body_partitions"]["left_arm"] == [2]
    top = skeleton.topology(nodes)
    assert skeleton.Topology.from_json(top.to_json()) == top and top.joint_nodes == [0, 1, 3, 6]
    with pytest.raises(ValueError):
        skeleton.Topology.from_json("{}")


def test_forward_kinematics_and_rest_turns(spark):
    top = skeleton.topology(tree(spark))
    df, kept = clips(spark, 6, joints=4)
    root, rot, _ = kept[0]
    out = skeleton.refresh_positions(df, top, "quat", joint=True, node=True)
    nodes = stream(out, "node_pos")
    np.testing.assert_array_equal(stream(out, "joint_pos"), nodes[:, top.joint_nodes])
    m = A.quat_to_matrix(rot)
    np.testing.assert_allclose(nodes[:, 7], root + (m[:, 0] @ np.array(top.offsets[6])) + np.einsum("fij,fjk,k->fi", m[:, 0], m[:, 3], top.offsets[7]), atol=1e-9)
    first = skeleton.refresh_positions(df, top, "quat", centering="first", up=1)
    np.testing.assert_allclose(stream(first, "joint_pos"), stream(out, "joint_pos") - root[0] * [1, 0, 1], atol=1e-9)
    alone = skeleton.refresh_positions(df, top, "quat", centering="skeleton")
    np.testing.assert_allclose(stream(alone, "joint_pos"), stream(out, "joint_pos") - root[:, None], atol=1e-9)
    turned = skeleton.topology(harmonize.turn_rest_offsets(tree(spark), "+z", "+y"))
    same = skeleton.refresh_positions(harmonize.turn_rest_rotations(df, "+z", "+y"), turned, "quat", node=True)
    np.testing.assert_allclose(stream(same, "node_pos"), nodes, atol=1e-9)
    e = skeleton.refresh_positions(df.withColumn("joint_rot", R.convert_joints(F.col("joint_rot"), "quat", "euler", "ZYX")), top, "euler", node=True)
    np.testing.assert_allclose(stream(e, "node_pos"), nodes, atol=1e-6)


@pytest.mark.parametrize("source", ["+x", "-x", "+y", "-y", "+z", "-z"])
def test_axis_turns_are_rotations(source):
    for target in ("+x", "-x", "+y", "-y", "+z", "-z"):
        m = np.array(harmonize.axis_turn(source, target))
        np.testing.assert_allclose(m @ m.T, np.eye(3))
        assert np.linalg.det(m) == pytest.approx(1)
        v = lambda a: np.eye(3)["xyz".index(a[1])] * (1 if a[0] == "+" else -1)
        np.testing.assert_allclose(m @ v(source), v(target))
        np.testing.assert_allclose(A.quat_to_matrix(np.array(harmonize._matrix_quat(m.tolist()))), m, atol=1e-12)


def test_statistics(spark):
    df, kept = clips(spark, 30, 12)
    s = {r.dim: r for r in stats.normalization_stats(df.withColumn("root_pos", F.array(F.lit(2.0), F.col("root_pos")[1], F.col("root_pos")[2]))).collect()}
    root = np.concatenate([kept[0][0], kept[1][0]])
    assert s[0].constant and s[0].std == 1.0 and s[1].std == pytest.approx(root[:, 1].std()) and len(s) == 23


def test_audit(spark):
    df = spark.createDataFrame([("a", "+y", 1 / 120), ("b", "+z", 1 / 30), ("c", None, 0.0), ("d", "+z", 0.041708), ("e", "+y", 1 / 120)], "clip_id string, world_up string, frame_time double").withColumn("fps", audit.fps_key(F.col("frame_time")))
    dist = audit.distribution(df, ("world_up", "fps"))
    got = {(r.axis, r.value): r.n for r in dist.collect()}
    assert got[("fps", "120")] == 2 and got[("fps", f"{1 / 0.041708:.6g}")] == 1 and got[("fps", "unknown")] == 1
    assert sorted(r.clip_id for r in audit.values(df, ("fps",)).where("value = '120'").collect()) == ["a", "e"]
    best = {r.axis: r.value for r in audit.majority(dist).collect()}
    assert best == {"world_up": "+z", "fps": "120"}
    counts = {"world_up": {"+y": 3, "+z": 2}, "rest_forward": {"-y": 4, "+x": 1, "unknown": 9}, "rest_up": {"+y": 1, "unknown": 5}, "fps": {"30": 2, "120": 2}}
    assert audit.harmonize_targets(counts, {}) == {"world_up": "+y", "rest_forward": "+x", "fps": 30.0}
    assert audit.harmonize_targets(counts, {"fps": 24, "world_up": "+z"}, mismatch=True, order="XYZ") == {"world_up": "+z", "rest_forward": "-y", "rest_up": "+y", "fps": 24.0, "euler_order": "XYZ"}
    assert audit.harmonize_targets({"world_up": {"+y": 3}, "fps": {"30": 3}, "rest_forward": {"+z": 3}}, {}) == {}
    with pytest.raises(ValueError):
        audit.harmonize_targets({"world_up": {"+y": 1}}, {"rest_forward": "+y"})
    with pytest.warns(UserWarning, match="stay as they are"):
        assert audit.harmonize_targets({"world_up": {"+y": 1}, "rest_forward": {"+y": 1, "-y": 1}}, {}) == {}
    with pytest.raises(ValueError, match="b, d"):
        audit.reject_parallel_forward(df, "+z", None)
    with pytest.warns(UserWarning, match="world_up"):
        audit.warn_heterogeneous(df, ("world_up",))
