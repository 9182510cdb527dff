"""Files, stores, pipelines and feeds, end to end on small rigs."""


import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.functions import arrays as A
from kinetra.operators import augment, temporal
from kinetra.plans import build, feed
from kinetra.plans.draws import exact_draws, generator
from kinetra.plans.pipeline import Pipeline, Step, handles_streams, stream_support
from kinetra.sources import bvh, store
from tests_rig import rig


@pytest.fixture()
def folder(tmp_path):
    for i in range(4):
        bvh.write(str(tmp_path / f"walk_{i}.bvh"), rig(6 + i, seed=i))
    (tmp_path / "notes.txt").write_text("no motion")
    return tmp_path


def test_parse_reverses_write(tmp_path):
    clip = rig()
    bvh.write(str(tmp_path / "a.bvh"), clip)
    back = bvh.parse((tmp_path / "a.bvh").read_text())
    for k in ("parents", "joint_idx", "euler_orders", "n_frames"):
        assert back[k] == clip[k]
    np.testing.assert_allclose(back["joints"], clip["joints"], atol=1e-12)
    np.testing.assert_allclose(back["root"], clip["root"])


@pytest.mark.parametrize("text", ["", "HIERARCHY ROOT a {", "MOTION", "HIERARCHY ROOT a { OFFSET 0 0 0 CHANNELS 3 Xrotation Xrotation Yrotation } MOTION Frames: 0 Frame Time: 1", "HIERARCHY JOINT a { }", "HIERARCHY ROOT a { OFFSET 0 0 0 CHANNELS 3 Xrotation Yrotation Zrotation } MOTION Frames: 2 Frame Time: 1 1 2 3"])
def test_broken_files(text):
    with pytest.raises(ValueError):
        bvh.parse(text)


def test_scan(spark, folder):
    assert bvh.scan(spark, str(folder)).count() == 4
    assert [r.clip_id for r in bvh.scan(spark, str(folder), keep=lambda s: s.endswith("2")).collect()] == ["walk_2"]
    (folder / "zz.bvh").write_text("HIERARCHY")
    with pytest.raises(Exception, match="zz"):
        bvh.scan(spark, str(folder)).collect()
    assert bvh.good(bvh.scan(spark, str(folder), skip_errors=True)).count() == 4
    with pytest.raises(FileNotFoundError):
        bvh.require_files(bvh.scan(spark, str(folder), "*.nothing"), str(folder))
    nodes = bvh.skeletons(bvh.scan(spark, str(folder), skip_errors=True))
    assert nodes.count() == 28 and nodes.where("parent is null").count() == 4


def test_build_and_load(spark, folder, tmp_path):
    out = str(tmp_path / "data")
    meta = build.preprocess(spark, str(folder), out, include_positions=True, include_quaternions=True, include_velocities=True, include_foot_contacts=True, label=lambda s: F.regexp_extract(s, "([0-9]+)", 1))
    assert meta["num_clips"] == 4 and meta["skeleton_info"]["lr_pairs"] == [[2, 3]] and meta["skeleton_info"]["world_up"] == "+y"
    data = store.load(spark, out)
    assert data.frames.count() == 6 + 7 + 8 + 9
    assert {"joint_quats", "velocities", "foot_contacts", "joint_pos"} <= set(data.frames.columns)
    assert sorted(r.label for r in data.clips.collect()) == [0, 1, 2, 3]
    assert data.stats.where("block = 'features'").count() == 3 + 4 * 6 and data.stats.where("block = 'positions'").count() == 12
    store.save_npz(data, str(tmp_path / "data.npz"))
    back = store.load(spark, str(tmp_path / "data.npz"))
    a, b = (d.frames.orderBy("clip_id", "t").select("clip_id", "t", "root_pos", "joint_rot").collect() for d in (data, back))
    np.testing.assert_allclose(np.array([r.joint_rot for r in a]), np.array([r.joint_rot for r in b]))
    assert back.meta["representation"] == "6d" and back.meta["skeleton_info"]["num_nodes"] == 7
    items = feed.MotionFeed(data.frames.select("clip_id", "t", "root_pos", "joint_rot"), data.clips.select("clip_id", "label"), target_length=8).items()
    assert {(r.length, len(r.data), len(r.data[0])) for r in items.collect()} == {(6, 8, 27), (7, 8, 27), (8, 8, 27)}


def test_build_refusals_and_harmonizing(spark, folder, tmp_path):
    for how in ({"representation": "rotmat"}, {"position_centering": "hips"}, {"target_world_up": "up"}, {"position_space": "bone"}, {"include_positions": True, "position_centering": "first"}):
        with pytest.raises(ValueError):
            build.preprocess(spark, str(folder), str(tmp_path / "x"), **how)
    with pytest.raises(ValueError):
        build.preprocess(spark, str(folder), str(tmp_path / "x.csv"))
    bvh.write(str(folder / "zfast.bvh"), rig(21, 1 / 120, seed=9))
    with pytest.warns(UserWarning, match="fps"):
        meta = build.preprocess(spark, str(folder), str(tmp_path / "h"), do_harmonize=True, target_world_up="+z")
    assert meta["harmonized_to"] == {"world_up": "+z", "fps": 30.0} and meta["uniformity"]["fps"] == {"30": 4, "120": 1}
    assert meta["harmonizing"] == {"retarget": False, "reference": None, "stage_counts": {"resample": 1, "world_up": 5}}
    built = store.load(spark, str(tmp_path / "h"))
    assert [r.clip_id for r in built.audit.where("axis = 'fps' and value = '120'").collect()] == ["zfast"]
    facts = {r.clip_id: r for r in built.clips.collect()}
    assert facts["zfast"].n_frames == 6 and facts["zfast"].frame_time == pytest.approx(1 / 30) and facts["walk_0"].world_up == "+z"
    n = {r.clip_id: r.n for r in store.load(spark, str(tmp_path / "h")).frames.groupBy("clip_id").agg(F.count("*").alias("n")).collect()}
    assert n["zfast"] == 6 and n["walk_0"] == 6
    other = rig(3)
    other["names"][1] = "Chest"
    bvh.write(str(folder / "zother.bvh"), other)
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="zother"):
        build.preprocess(spark, str(folder), str(tmp_path / "y"))


def mixed_folder(path):
    """Clips of one graph, but with other orders, bones, frame times and rest axes."""
    a, b, c = rig(6, 0.1, seed=1), rig(7, 0.05, seed=2), rig(5, 0.1, seed=3)
    b["euler_orders"] = ["XYZ", "ZYX", "YZX", "XZY"]
    b["offsets"] = [[2.0 * x for x in o] for o in b["offsets"]]
    c["offsets"] = [[x, -z, y] for x, y, z in c["offsets"]]  # +z is up at rest
    for name, clip in zip("abc", (a, b, c)):
        (path / name).mkdir(parents=True)
        for folder in (path / name, path):
            bvh.write(str(folder / f"{name}.bvh"), clip)
    return path


ALL = {"include_positions": True, "include_velocities": True, "include_quaternions": True, "include_foot_contacts": True}


def rows_of(frames, clip):
    names = [c for c in sorted(frames.columns) if c not in ("clip_id", "t")]
    rows = frames.where(F.col("clip_id") == clip).orderBy("t").collect()
    return {c: np.array([r[c] for r in rows]) for c in names}


@pytest.mark.parametrize("how", [{"representation": "6d", "position_centering": "first", "center": False}, {"representation": "quat", "target_world_up": "-x", "target_fps": 20.0, "target_rest_up": "+y", "target_rest_forward": "-z"}])
@pytest.mark.filterwarnings("ignore::UserWarning")
def test_a_clip_is_the_same_alone_and_in_company(spark, tmp_path, how):
    mixed_folder(tmp_path / "in")
    build.preprocess(spark, str(tmp_path / "in"), str(tmp_path / "all"), **ALL, **how)
    together = store.load(spark, str(tmp_path / "all")).frames
    for c in "bc":
        build.preprocess(spark, str(tmp_path / "in" / c), str(tmp_path / f"only_{c}"), **ALL, **how)
        alone, own = rows_of(store.load(spark, str(tmp_path / f"only_{c}")).frames, c), rows_of(together, c)
        assert alone.keys() == own.keys() and len(own["root_pos"]) > 2
        for k in own:
            np.testing.assert_allclose(own[k], alone[k], atol=1e-12, err_msg=f"{c} {k}")


@pytest.mark.filterwarnings("ignore::UserWarning")
def test_a_feed_from_files_takes_each_clip_as_it_is(spark, tmp_path):
    mixed_folder(tmp_path)
    for how in ({}, {"position_centering": "first"}):
        for kind in ("euler", "quat"):
            make = lambda folder: feed.from_files(spark, str(folder), kind, include_positions=True, center_root=False, streams=["root_pos", "joint_rot", "joint_pos"], source_repr=kind, target_repr=kind, **how)  # noqa: B023, E731
            together = {r.clip_id: np.array(r.data) for r in make(tmp_path).items().collect()}
            for c in "abc":
                np.testing.assert_allclose(together[c], np.array(make(tmp_path / c).items().first().data), atol=1e-5)
    got = {r.clip_id: np.array(r.joint_rot) for r in feed.from_files(spark, str(tmp_path), "quat").frames.where("t = 0").collect()}
    for c, orders in (("a", rig()["euler_orders"]), ("b", ["XYZ", "ZYX", "YZX", "XZY"])):
        angles = np.array(bvh.parse((tmp_path / f"{c}.bvh").read_text())["joints"])[0]
        np.testing.assert_allclose(A.quat_to_matrix(got[c]), A.to_matrix(angles, "euler", orders), atol=1e-9)


@pytest.mark.filterwarnings("ignore::UserWarning")
def test_harmonizing_and_retargeting(spark, tmp_path):
    mixed_folder(tmp_path / "in")
    meta = build.preprocess(spark, str(tmp_path / "in"), str(tmp_path / "h"), "euler", do_harmonize=True, **ALL)
    assert meta["harmonized_to"]["fps"] == 10.0 and meta["harmonized_to"]["world_up"] == "+y" and "euler_order" in meta["harmonized_to"]
    assert meta["harmonizing"]["stage_counts"]["resample"] == 1 and meta["harmonizing"]["stage_counts"]["world_up"] == 1 and meta["harmonizing"]["stage_counts"]["euler_order"] == 3
    with pytest.raises(ValueError, match="euler orders"):
        build.preprocess(spark, str(tmp_path / "in"), str(tmp_path / "x"), "euler")
    same = build.preprocess(spark, str(tmp_path / "in"), str(tmp_path / "r"), "quat", retarget=True, center=False, include_positions=True)
    assert same["harmonizing"]["reference"] == "a" and same["harmonizing"]["stage_counts"] == {"retarget": 3}
    bones = lambda p: np.linalg.norm(p[:, 1] - p[:, 0], axis=-1)
    for c in "abc":
        np.testing.assert_allclose(bones(rows_of(store.load(spark, str(tmp_path / "r")).frames, c)["joint_pos"]), 4)
    other = rig(3)
    other["names"][1] = "Chest"
    bvh.write(str(tmp_path / "in" / "d.bvh"), other)
    with pytest.raises(ValueError, match="d has other names"):
        build.preprocess(spark, str(tmp_path / "in"), str(tmp_path / "y"), retarget=True)


@pytest.mark.filterwarnings("ignore:clips have")
def test_skipped_files_are_told(spark, folder, tmp_path):
    (folder / "zz.bvh").write_text("HIERARCHY")
    with pytest.warns(UserWarning, match="1 files are skipped, e.g. zz"):
        assert build.preprocess(spark, str(folder), str(tmp_path / "d"), skip_errors=True)["num_clips"] == 4


def test_hdf5_archives(spark, folder, tmp_path, monkeypatch):
    """h5py is not installed here: a stand-in keeps groups, datasets and attributes in memory."""
    import sys
    import types

    if "h5py" not in sys.modules:
        with pytest.raises(ImportError, match="h5py"):
            build.preprocess(spark, str(folder), str(tmp_path / "d.h5"))
    files: dict = {}

    class Group(dict):
        def __init__(self):
            super().__init__()
            self.attrs = {}

        def require_group(self, name):
            return self.setdefault(name, Group())

        def create_dataset(self, name, data, **_):
            raw = [x.encode() for x in data] if isinstance(data, list) else data
            self[name] = np.array(raw, object) if isinstance(data, list) else np.asarray(raw)

    class Array:
        def __init__(self, value):
            self.value = value

        def __getitem__(self, _):
            return self.value

    class File(Group):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

    def opened(path, mode):
        if mode == "w":
            files[path] = File()
            return files[path]
        back = File()
        back.attrs = files[path].attrs
        for k, v in files[path].items():
            back[k] = {n: Array(x) for n, x in v.items()} if isinstance(v, Group) else Array(v)
            if isinstance(v, Group):
                group = Group()
                group.attrs = v.attrs
                group.update(back[k])
                back[k] = group
        return back

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=opened, string_dtype=lambda _: None))
    build.preprocess(spark, str(folder), str(tmp_path / "d.h5"), "quat", include_positions=True, label=lambda s: F.regexp_extract(s, "([0-9]+)", 1))
    build.preprocess(spark, str(folder), str(tmp_path / "d.npz"), "quat", include_positions=True, label=lambda s: F.regexp_extract(s, "([0-9]+)", 1))
    h5, npz = store.load(spark, str(tmp_path / "d.h5")), store.load(spark, str(tmp_path / "d.npz"))
    assert h5.meta == npz.meta and h5.meta["uniformity"]["fps"]["30"] == [f"walk_{i}" for i in range(4)]
    assert sorted(h5.clips.collect()) == sorted(npz.clips.collect()) and sorted(h5.stats.collect(), key=str) == sorted(npz.stats.collect(), key=str)
    for c in ("walk_0", "walk_3"):
        for k, v in rows_of(h5.frames, c).items():
            np.testing.assert_array_equal(v, rows_of(npz.frames, c)[k])


def test_legacy_names(spark):
    old = spark.createDataFrame([("a", 0, [[1.0]])], "clip_id string, t int, joint_data array<array<double>>")
    assert store.legacy_columns(old).columns == ["clip_id", "t", "joint_rot"]
    assert store.normalize_info({"num_joints": 3})["rest_up"] is None


def frames(spark, n=(12, 7, 30)):
    r = np.random.default_rng(1)
    rows = []
    for c, f in enumerate(n):
        q = r.normal(size=(f, 4, 4))
        q /= np.linalg.norm(q, axis=-1, keepdims=True)
        rows += [(f"c{c}", t, r.normal(size=3).tolist(), q[t].tolist()) for t in range(f)]
    return spark.createDataFrame(rows, "clip_id string, t int, root_pos array<double>, joint_rot array<array<double>>")


INFO = {"lr_pairs": [(1, 2)], "node_lr_pairs": [], "euler_orders": ["XYZ"] * 4}


def test_pipeline_is_a_function_of_seed_and_epoch(spark):
    f, p = frames(spark), Pipeline.standard(INFO, representation="quat")
    key = lambda df: sorted((r.clip_id, r.t, tuple(np.round(np.ravel(r.joint_rot), 9))) for r in df.collect())
    one = key(p.apply(f, 3, 1))
    assert one == key(p.apply(f.repartition(7), 3, 1))
    assert one != key(p.apply(f, 3, 2)) and one != key(p.apply(f, 4, 1))
    with pytest.raises(ValueError):
        p.apply(f, None)


def test_explain_tells_what_apply_does(spark):
    f = frames(spark, (10, 10, 10, 10))
    p = Pipeline([Step(augment.mirror, 0.5, {"lateral_axis": "+x", "lr_joint_pairs": []}), Step(augment.speed, 1.0, {"factor": lambda d: d.uniform(0.5, 2.0)})], representation="quat")
    told = {(r.clip_id, r.name): r for r in p.explain(f.select("clip_id").distinct(), 5, 1).collect()}
    got = p.apply(f, 5, 1)
    first = {r.clip_id: r.root_pos for r in got.where("t = 0").collect()}
    source = {r.clip_id: r.root_pos for r in f.where("t = 0").collect()}
    count = {r.clip_id: r["n"] for r in got.groupBy("clip_id").agg(F.count("*").alias("n")).collect()}
    for c in source:
        flipped = told[c, "mirror"].applied
        assert first[c][0] == pytest.approx(-source[c][0] if flipped else source[c][0])
        assert count[c] == max(2, round(10 / float(told[c, "speed"].params["factor"])))


def test_sharing_quaternions_changes_nothing(spark):
    f = frames(spark).withColumn("joint_rot", F.transform("joint_rot", lambda x: F.slice(x, 1, 3)))
    both = [Pipeline(Pipeline.standard(INFO, representation="axisangle", rotate_angle_range=(0.5, 1.0)).steps, representation="axisangle", share_quaternions=s).apply(f, 1) for s in (True, False)]
    a, b = (np.array([np.ravel(r.joint_rot) for r in x.orderBy("clip_id", "t").collect()]) for x in both)
    np.testing.assert_allclose(a, b, atol=1e-6)


def test_pipeline_refusals(spark):
    f = frames(spark, (3,))
    for steps, how in (([(augment.speed, 2.0)], {}), ([(augment.speed,)], {}), ([("speed", 1.0)], {}), ([(augment.speed, 1.0, {"factor": 0})], {}), ([(augment.dropout, 1.0, {"rate": 1.0})], {}), ([(augment.speed, 1.0, {"factor": 1.0, "representation": "6d"})], {"representation": "quat"})):
        with pytest.raises(ValueError):
            Pipeline(steps, **how)
    with pytest.raises(ValueError):
        Pipeline([(augment.speed, 1.0, {"factor": 1.0})]).apply(f, 1)
    with pytest.raises(ValueError):
        Pipeline([(augment.joint_position_noise, 1.0, {"sigma": 0.1})], representation="quat").apply(f, 1)
    own = lambda df: df.withColumn("root_pos", F.transform("root_pos", lambda x: x * 2))
    out = Pipeline([(own, 1.0)], representation="quat").apply(f, 1)
    assert out.first().root_pos[0] == pytest.approx(2 * f.first().root_pos[0])
    positions = f.drop("joint_rot").withColumn("joint_pos", F.array("root_pos"))
    with pytest.raises(ValueError, match="does not say"):
        Pipeline([(own, 1.0)]).apply(positions, 1)
    marked = handles_streams("root_pos", "joint_pos")(own)
    assert stream_support(marked) == {"root_pos", "joint_pos"}
    assert Pipeline([(marked, 1.0)]).apply(positions, 1).count() == 3
    with pytest.raises(ValueError, match="add nor drop"):
        Pipeline([(lambda df: df.drop("joint_rot"), 1.0)], representation="quat").apply(f, 1)
    with pytest.raises(ValueError):
        Pipeline.standard(INFO, position_noise_sigma=0.1)


def test_float_streams_stay_float(spark):
    f = frames(spark, (4,)).withColumn("root_pos", F.col("root_pos").cast("array<float>"))
    out = Pipeline([(augment.mirror, 1.0, {"lateral_axis": "+x", "lr_joint_pairs": []})], representation="quat").apply(f, 1)
    assert dict(out.dtypes)["root_pos"] == "array<float>" and dict(out.dtypes)["joint_rot"] == "array<array<double>>"


def test_exact_draws_repeat_the_generator(spark):
    clips = temporal.frame_counts(frames(spark)).withColumn("idx", F.substring("clip_id", 2, 9).cast("long"))
    got = {(r.clip_id, r.k, r.place): r.value for r in exact_draws(clips, 7, 2, [("gate",), ("uniform", -1, 1), ("normal", 2)]).collect()}
    rng = generator(7, 2, 1)
    assert got["c1", 0, 0] == rng.random() and got["c1", 1, 0] == rng.uniform(-1, 1)
    np.testing.assert_array_equal([got["c1", 2, i] for i in range(14)], rng.normal(size=14))


def test_steps_take_the_numbers_of_generators(spark):
    """Against NumPy: gates, parameters and noise of one generator per clip, in the order in which steps ask."""
    r = np.random.default_rng(1)
    lengths, rows, kept = (12, 1, 9, 15), [], {}
    for c, n in enumerate(lengths):
        root, pos = r.normal(size=(n, 3)), r.normal(size=(n, 4, 3))
        kept[f"c{c}"] = (root, pos)
        rows += [(f"c{c}", t, root[t].tolist(), pos[t].tolist()) for t in range(n)]
    f = spark.createDataFrame(rows, "clip_id string, t int, root_pos array<double>, joint_pos array<array<double>>")
    who = spark.createDataFrame([(f"c{i}", 10 + i) for i in range(4)], "clip_id string, idx long")
    steps = [
        Step(augment.rotate_vertical, 0.7, {"angle": lambda d: d.uniform(-2, 2), "up_axis": "+y"}),
        Step(augment.speed, 0.6, {"factor": lambda d: d.uniform(0.5, 1.5)}),
        Step(augment.root_noise, 0.5, {"sigma": 0.3, "centering": "world"}),
        Step(augment.mirror, 0.9, {"lateral_axis": "+x", "lr_joint_pairs": []}),
        Step(augment.joint_position_noise, 0.8, {"sigma": lambda d: d.uniform(0.1, 0.2)}),
        Step(augment.dropout, 0.5, {"rate": 0.4}),
    ]
    got = Pipeline(steps).apply(f, 7, 3, "world", generators=who)
    fired = set()
    for c, (clip, (root, pos)) in enumerate(kept.items()):
        rng = generator(7, 3, 10 + c)
        both = np.concatenate([root[:, None], pos], 1)

        def lerped(x, at):
            low = np.minimum(np.floor(at).astype(int), max(0, len(x) - 2))
            high = np.minimum(low + 1, len(x) - 1)
            a = (at - low)[:, None, None]
            return (1 - a) * x[low] + a * x[high]

        for k, s in enumerate(steps):
            if not rng.random() < s.prob:
                continue
            fired.add(k)
            n = len(both)
            if k == 0:
                a = rng.uniform(-2, 2)
                both = both @ np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]]).T
            elif k == 1:
                factor = rng.uniform(0.5, 1.5)
                if n > 1:
                    both = lerped(both, np.linspace(0, n - 1, max(2, round(n / factor))))
            elif k == 2:
                both = both + 0.3 * rng.normal(size=(n, 3))[:, None]
            elif k == 3:
                both = both * [-1, 1, 1]
            elif k == 4:
                sigma = rng.uniform(0.1, 0.2)
                both = np.concatenate([both[:, :1], both[:, 1:] + sigma * rng.normal(size=(n, 4, 3))], 1)
            elif n > 1:
                keep = rng.random(n) >= 0.4
                keep[[0, -1]] = True
                at = np.flatnonzero(keep)
                both = np.stack([np.stack([np.interp(np.arange(n), at, both[at, v, i]) for i in range(3)], -1) for v in range(5)], 1)
        own = rows_of(got, clip)
        np.testing.assert_allclose(np.concatenate([own["root_pos"][:, None], own["joint_pos"]], 1), both, atol=1e-9, err_msg=clip)
    assert fired == set(range(6))
    with pytest.raises(ValueError):
        Pipeline(steps).apply(f, None, 3, "world", generators=who)


def test_rotation_noise_takes_the_numbers_of_generators(spark):
    f = frames(spark, (6, 4))
    who = f.select("clip_id").distinct().withColumn("idx", F.substring("clip_id", 2, 9).cast("long"))
    got = Pipeline([Step(augment.rotation_noise, 1.0, {"sigma": 0.3})], representation="quat").apply(f, 5, 0, generators=who)
    for c, n in enumerate((6, 4)):
        rng = generator(5, 0, c)
        rng.random()
        axis, angle = rng.normal(size=(n, 4, 3)), rng.normal(size=(n, 4)) * 0.3 / 2
        axis /= np.linalg.norm(axis, axis=-1, keepdims=True)
        noise = np.concatenate([np.cos(angle)[..., None], np.sin(angle)[..., None] * axis], -1)
        source = rows_of(f, f"c{c}")["joint_rot"]
        np.testing.assert_allclose(A.quat_to_matrix(rows_of(got, f"c{c}")["joint_rot"]), A.quat_to_matrix(noise) @ A.quat_to_matrix(source), atol=1e-9)
    items = feed.MotionFeed(f, augmentation=Pipeline([Step(augment.rotation_noise, 1.0, {"sigma": 0.3})], representation="quat"), seed=5, generators=who, streams=["joint_rot"]).items()
    np.testing.assert_allclose(np.array({r.clip_id: r.data for r in items.collect()}["c1"]).reshape(4, 4, 4), rows_of(got, "c1")["joint_rot"], atol=1e-6)


def test_feed_orders_and_refusals(spark):
    f = frames(spark)
    for how in ({"layout": "cube"}, {"temporal": "stretch"}, {"temporal": "crop"}, {"streams": ["joint_vel"]}, {"source_repr": "quat"}, {"source_repr": "quat", "target_repr": "euler"}):
        with pytest.raises(ValueError):
            feed.MotionFeed(f, **how)
    items = feed.MotionFeed(f, target_length=9, temporal="resample_deterministic", layout="ctv", source_repr="quat", target_repr="6d").items().collect()
    assert {(r.length, len(r.data), len(r.data[0]), len(r.data[0][0])) for r in items} == {(9, 6, 9, 5)}
    moving = f.drop("joint_rot").withColumn("joint_pos", F.array("root_pos"))
    v = feed.MotionFeed(moving, target_length=20, streams=["joint_vel"], position_centering="world").items()
    data = {r.clip_id: np.array(r.data) for r in v.collect()}
    assert not data["c1"][7:].any()  # padding comes after differences
    with pytest.raises(ValueError):
        feed.MotionFeed(f).explain_augmentation()


def test_collate(spark):
    items = feed.MotionFeed(frames(spark), streams=["root_pos"]).items().withColumns({"batch_id": F.lit(0), "label": F.length("clip_id")})
    b = feed.collate(items).first()
    assert b.lengths == [12, 7, 30] and [sum(m) for m in b["mask"]] == [12, 7, 30] and len(b.data[1]) == 30 and b.labels == [2, 2, 2]
    feed.all_or_none(items, "label")
    with pytest.raises(ValueError):
        feed.all_or_none(items.withColumn("label", F.when(F.col("clip_id") == "c0", 1)), "label")
    arrays = feed.collate_arrays([{"data": np.ones((n, 2)), "length": n, "label": n} for n in (2, 5)])
    assert arrays["data"].shape == (2, 5, 2) and arrays["mask"].sum() == 7 and arrays["labels"].tolist() == [2, 5]
    for bad in ([], [{"data": np.ones((2, 2, 2)), "length": 2}], [{"data": np.ones((2, 2)), "length": 2, "label": 1}, {"data": np.ones((2, 2)), "length": 2}]):
        with pytest.raises(ValueError):
            feed.collate_arrays(bad)
    assert feed.normalize_index(-1, 3) == 2
    with pytest.raises(IndexError):
        feed.normalize_index(3, 3)
    shuffled = feed.MotionFeed(frames(spark), seed=1, streams=["root_pos"]).shuffled(0, 2)
    assert sorted(r.batch_id for r in shuffled.collect()) == [0, 0, 1]


def test_batches_have_their_size(spark, monkeypatch):
    monkeypatch.setattr(feed, "GROUP", 10)
    f = spark.range(103).select(F.concat(F.lit("c"), "id").alias("clip_id"), F.lit(0).alias("t"), F.array(F.lit(1.0), F.lit(2.0), F.col("id").cast("double")).alias("root_pos"))
    made = feed.MotionFeed(f, seed=3, streams=["root_pos"])
    rows = made.shuffled(0, 10).collect()
    sizes = {}
    for r in rows:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    assert sizes == {**{i: 10 for i in range(10)}, 10: 3} and len({r.clip_id for r in rows}) == 103
    again, later = ({r.clip_id: r.batch_id for r in made.shuffled(e, 10).collect()} for e in (0, 1))
    assert again == {r.clip_id: r.batch_id for r in rows} and later != again
    with pytest.raises(ValueError):
        made.shuffled(0, 0)
    got = list(feed.batches(made.items(), 20))
    assert [b.num_rows for b in got] == [20] * 5 + [3] and {x for b in got for x in b.column("clip_id").to_pylist()} == {r.clip_id for r in rows}


def test_several_samples_of_a_clip(spark):
    clips = temporal.frame_counts(frames(spark, (5, 30, 200)))
    picks = temporal.temporal_samples(clips, 16, 3)
    got = temporal.sample_frames(frames(spark, (5, 30, 200)), picks).collect()
    assert {(r.clip_id, r["sample"]) for r in got} == {(f"c{i}", k) for i in range(3) for k in range(3)} and len(got) == 3 * 3 * 16
    test = {(r.clip_id, r["sample"], r.i): r.idx for r in temporal.temporal_samples(clips, 16, 2, "test").collect()}
    assert test == {(r.clip_id, r["sample"], r.i): r.idx for r in temporal.temporal_samples(clips, 16, 2, "test").collect()}
    assert [test["c2", 0, i] for i in range(16)] != [test["c2", 1, i] for i in range(16)]
    with pytest.raises(ValueError):
        temporal.temporal_samples(clips, 16, 0)
