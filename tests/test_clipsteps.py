"""Steps on NumPy arrays of a clip: contract, gates, draws, lengths and refusals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.operators import augment
from kinetra.operators.clips import from_arrays
from kinetra.plans.clipsteps import clip_step, run
from kinetra.plans.pipeline import Pipeline, Step, handles_streams


def make(spark, n=12, seed=0):
    r = np.random.default_rng(seed)
    clips = [{"root_pos": r.normal(size=(5 + i, 3)), "joint_rot": r.normal(size=(5 + i, 4, 6)), "joint_pos": r.normal(size=(5 + i, 4, 3))} for i in range(n)]
    return clips, from_arrays(spark, clips)[0]


def arrays(frames):
    out = {}
    for r in frames.orderBy("clip_id", "t").collect():
        own = out.setdefault(r.clip_id, {})
        for s in ("root_pos", "joint_rot", "joint_pos"):
            own.setdefault(s, []).append(r[s])
    return {c: {s: np.array(v) for s, v in own.items()} for c, own in out.items()}


ALL = ("root_pos", "joint_rot", "joint_pos")


def test_a_step_sees_whole_clips_and_keeps_other_columns(spark):
    @clip_step
    def smooth(clip, width):
        kernel = np.ones(width) / width
        out = dict(clip)
        out["root_pos"] = np.stack([np.convolve(c, kernel, "same") for c in clip["root_pos"].T], 1)
        return out

    clips, frames = make(spark)
    got = run(frames.withColumn("other", F.col("t") * 2).repartition(7), smooth, kwargs={"width": 3})
    assert got.where("other <> t * 2").isEmpty() and got.columns == [*frames.columns, "other"]
    back = arrays(got)
    for i, c in enumerate(clips):
        np.testing.assert_allclose(back[f"{i:06d}"]["root_pos"], smooth(c, width=3)["root_pos"])
        np.testing.assert_array_equal(back[f"{i:06d}"]["joint_rot"], c["joint_rot"])


def test_gates_and_draws_agree_with_what_explain_tells(spark):
    @handles_streams(*ALL)
    @clip_step
    def shift(clip, by):
        return {s: v + by if s == "root_pos" else v for s, v in clip.items()}

    clips, frames = make(spark, 30)
    steps = Pipeline([Step(shift, 0.5, {"by": lambda u: u.uniform(1, 2, "by")})], representation="6d")
    got = arrays(steps.apply(frames, seed=3, epoch=4))
    told = {r.clip_id: r for r in steps.explain(frames.select("clip_id").distinct(), 3, 4).collect()}
    assert {r.name for r in told.values()} == {"shift"} and {r.applied for r in told.values()} == {True, False}
    for i, c in enumerate(clips):
        moved = got[f"{i:06d}"]["root_pos"] - c["root_pos"]
        r = told[f"{i:06d}"]
        np.testing.assert_allclose(moved, float(r.params["by"]) if r.applied else 0, atol=1e-12)


def test_generators_depend_on_seed_epoch_step_and_clip_alone(spark):
    @handles_streams(*ALL)
    @clip_step
    def jitter(clip, rng):
        return {**clip, "root_pos": clip["root_pos"] + rng.normal(size=clip["root_pos"].shape)}

    _, frames = make(spark)
    steps = Pipeline([(jitter, 1.0), (jitter, 1.0)], representation="6d")
    a, b = arrays(steps.apply(frames, seed=1, epoch=2)), arrays(steps.apply(frames.repartition(9), seed=1, epoch=2))
    other = arrays(steps.apply(frames, seed=1, epoch=3))
    for c in a:
        np.testing.assert_array_equal(a[c]["root_pos"], b[c]["root_pos"])
        assert abs(a[c]["root_pos"] - other[c]["root_pos"]).max() > 0.01
    with pytest.raises(ValueError, match="seed"):
        run(frames, jitter)


def test_lengths_may_change_between_steps(spark):
    @handles_streams(*ALL)
    @clip_step
    def half(clip):
        return {s: v[::2] for s, v in clip.items()}

    clips, frames = make(spark)
    frames = frames.withColumns({"joint_rot": F.transform("joint_rot", lambda x: F.slice(x, 1, F.lit(4)))})
    steps = Pipeline([Step(half), Step(augment.speed, 1.0, {"factor": 0.5}), Step(half)], representation="quat")
    got = arrays(steps.apply(frames, seed=0))
    for i in range(len(clips)):
        n = (5 + i + 1) // 2
        n = max(2, round(n / 0.5))
        assert len(got[f"{i:06d}"]["root_pos"]) == (n + 1) // 2
    assert steps.apply(frames, seed=0).where("t < 0").isEmpty()


@pytest.mark.parametrize("fn, match", [
    (lambda c: {"root_pos": c["root_pos"]}, "dropped"),
    (lambda c: {**c, "node_pos": c["joint_pos"]}, "added"),
    (lambda c: (c["root_pos"], c["joint_rot"]), "returned tuple"),
    (lambda c: {**c, "root_pos": c["root_pos"][:2]}, "shapes"),
    (lambda c: {**c, "root_pos": c["root_pos"][:, :2]}, "width"),
    (lambda c: {**c, "joint_rot": c["joint_rot"][:, :2]}, "vertices"),
    (lambda c: {s: v[:0] for s, v in c.items()}, "shapes"),
])
def test_broken_steps_are_refused_by_name(spark, fn, match):
    _, frames = make(spark, 2)
    with pytest.raises(Exception, match=match):
        run(frames, clip_step(fn)).collect()
    with pytest.raises((ValueError, TypeError), match=match):
        clip_step(fn)({"root_pos": np.zeros((3, 3)), "joint_rot": np.zeros((3, 4, 6)), "joint_pos": np.zeros((3, 4, 3))})


def test_long_clips_and_undeclared_streams_are_refused(spark):
    _, frames = make(spark, 3)
    with pytest.raises(Exception, match="000002 has more than 6 frames"):
        run(frames, clip_step(lambda c: c, most_frames=6)).where("clip_id = '000002'").collect()
    with pytest.raises(ValueError, match="joint_pos"):
        Pipeline([(clip_step(lambda c: c), 1.0)], representation="6d").apply(frames, seed=0)


def test_empty_tables_and_rotations_in_float(spark):
    _, frames = make(spark, 3)
    same = handles_streams(*ALL)(clip_step(lambda c: c))
    assert Pipeline([(same, 1.0)], representation="6d").apply(frames.where("t < 0"), seed=0).count() == 0
    small = frames.withColumn("root_pos", F.col("root_pos").cast("array<float>"))
    assert dict(Pipeline([(same, 1.0)], representation="6d").apply(small, seed=0).dtypes)["root_pos"] == "array<float>"
