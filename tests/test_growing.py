"""Datasets that grow, feeds that many trainers read, clips by number, and skeletons of any depth."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_rig import rig

from kinetra.operators import skeleton, stats, temporal
from kinetra.plans import build, feed, shards
from kinetra.plans.pipeline import Pipeline, Step
from kinetra.operators import augment
from kinetra.sources import bvh, numbered, store


def paths(spark, lengths, name="c"):
    rows = [(f"{name}{i:03d}", t, [float(i), float(t), float(i * t)]) for i, n in enumerate(lengths) for t in range(n)]
    return spark.createDataFrame(rows, "clip_id string, t int, root_pos array<double>")


# ---- incremental builds -----------------------------------------------------------------------


def files(folder, span):
    folder.mkdir(exist_ok=True)
    for i in span:
        bvh.write(str(folder / f"walk_{i}.bvh"), rig(6 + i, seed=i))


@pytest.mark.parametrize("how", [{}, {"representation": "euler", "include_positions": True, "include_velocities": True, "target_fps": 20.0, "target_euler_order": "XYZ", "retarget": True, "include_foot_contacts": True}])
def test_a_build_in_steps_equals_one_build(spark, tmp_path, how):
    src, label = tmp_path / "src", lambda s: F.regexp_extract(s, "([0-9]+)", 1)
    files(src, range(2))
    grown = str(tmp_path / "grown")
    build.preprocess(spark, str(src), grown, label=label, **how)
    (src / "walk_0.bvh").chmod(0o000)
    stamp = (src / "walk_1.bvh").stat()
    (src / "walk_1.bvh").write_text("x" * stamp.st_size)  # must not be opened again
    os.utime(src / "walk_1.bvh", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    files(src, range(2, 4))
    assert build.extend(spark, str(src), grown, label)["num_clips"] == 4
    files(src, range(4, 5))
    meta = build.extend(spark, str(src), grown, label)
    assert build.extend(spark, str(src), grown, label) == meta and meta["parts"] == 3
    (src / "walk_0.bvh").chmod(0o644)
    files(src, range(2))
    once = str(tmp_path / "once")
    want = build.preprocess(spark, str(src), once, label=label, **how)
    a, b = store.load(spark, grown), store.load(spark, once)
    rows = lambda df, *key: [tuple(r) for r in df.select(sorted(df.columns)).orderBy(*key).collect()]
    assert rows(a.frames, "clip_id", "t") == rows(b.frames, "clip_id", "t")
    assert rows(a.clips, "clip_id") == rows(b.clips, "clip_id") and rows(a.audit, "clip_id", "axis", "value") == rows(b.audit, "clip_id", "axis", "value")
    for x, y in zip(a.stats.orderBy("block", "dim").collect(), b.stats.orderBy("block", "dim").collect()):
        assert (x.block, x.dim, x.constant) == (y.block, y.dim, y.constant)
        assert (x["mean"], x["std"]) == pytest.approx((y["mean"], y["std"]), abs=1e-12)
    for k in ("uniformity", "harmonized_to", "harmonizing", "num_clips", "skeleton_info"):
        assert meta[k] == want[k], k


def test_additions_are_refused_or_run_again(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    files(src, range(2))
    build.preprocess(spark, str(src), out)
    clip = rig(6) | {"parents": [-1, 0, 1, 1, 3, 0, 5]}
    bvh.write(str(src / "walk_7.bvh"), clip)
    with pytest.raises(ValueError, match="walk_7 has other parents"):
        build.extend(spark, str(src), out)
    (src / "walk_7.bvh").unlink()
    files(src, [8])
    spark.range(1).write.parquet(f"{out}/frames-1")  # what a failed addition left
    build.extend(spark, str(src), out)
    assert {r.clip_id for r in store.load(spark, out).frames.select("clip_id").distinct().collect()} == {"walk_0", "walk_1", "walk_8"}
    (src / "walk_0.bvh").write_text((src / "walk_1.bvh").read_text())
    with pytest.raises(ValueError, match="changed.*walk_0"):
        build.extend(spark, str(src), out)


def test_moments_merge(spark):
    r = np.random.default_rng(0)
    values = [1e6 + r.normal(size=(n, 3)) for n in (3, 50, 1, 200)]
    parts = None
    for k, v in enumerate(values):
        f = spark.createDataFrame([(f"c{k}", t, [float(a) for a in x]) for t, x in enumerate(v)], "clip_id string, t int, root_pos array<double>")
        m = stats.moments(f, ["root_pos"])
        parts = m if parts is None else parts.unionByName(m)
    got = stats.of_moments(stats.merge_moments(parts)).orderBy("dim").collect()
    every = np.concatenate(values)
    np.testing.assert_allclose([x["mean"] for x in got], every.mean(0), rtol=1e-14)
    np.testing.assert_allclose([x["std"] for x in got], every.std(0), rtol=1e-9)


# ---- feeds ------------------------------------------------------------------------------------


def test_clips_without_frames_keep_their_items(spark):
    frames = paths(spark, (5, 3)).withColumn("joint_pos", F.array("root_pos", "root_pos"))
    clips = spark.createDataFrame([("c000", 1), ("c001", 2), ("none", 3)], "clip_id string, label int")
    for how, shape in (({"target_length": 4}, (4, 9)), ({"target_length": 4, "layout": "ctv"}, (3, 4, 3)), ({"target_length": 4, "layout": "tvc"}, (4, 3, 3)), ({}, (0,))):
        rows = {r.clip_id: r for r in feed.MotionFeed(frames, clips, streams=["root_pos", "joint_pos"], **how).items().collect()}
        assert set(rows) == {"c000", "c001", "none"} and rows["none"].length == 0 and rows["none"].label == 3
        assert np.shape(rows["none"].data) == shape and not np.any(rows["none"].data)
        if how:
            assert np.shape(rows["c000"].data) == shape
    items = feed.MotionFeed(frames, clips, streams=["root_pos", "joint_pos"]).items().withColumn("batch_id", F.lit(0))
    b = feed.collate(items).first()
    assert b.lengths == [5, 3, 0] and np.shape(b.data) == (3, 5, 9) and [sum(m) for m in b["mask"]] == [5, 3, 0]
    alone = feed.collate(items.where("length = 0")).first()
    assert alone.lengths == [0] and alone.data == [[]] and alone["mask"] == [[]]
    with pytest.raises(Exception, match="items of widths 2 and 9 in batch 0"):
        odd = items.withColumn("data", F.when(F.col("clip_id") == "c000", F.transform("data", lambda x: F.slice(x, 1, F.lit(2)))).otherwise(F.col("data")))
        feed.collate(odd).collect()


def steps():
    return Pipeline([Step(augment.rotate_vertical, 0.5, {"angle": lambda u: u.uniform(-3, 3, "angle"), "up_axis": "+y"}), Step(augment.root_noise, 0.5, {"sigma": 0.1}), Step(augment.speed, 0.5, {"factor": lambda u: u.uniform(0.5, 2, "factor")})])


def test_told_draws_of_generators_are_those_of_items(spark):
    frames = paths(spark, [20] * 40)
    ids = frames.select("clip_id").distinct().withColumn("idx", F.substring("clip_id", 2, 9).cast("int"))
    made = feed.MotionFeed(frames, streams=["root_pos"], augmentation=steps(), seed=3, generators=ids)
    told = {(r.clip_id, r.step): r for r in made.explain_augmentation(2).collect()}
    lengths = {r.clip_id: r.length for r in made.items(2).collect()}
    seen = 0
    for i in range(40):
        rng = np.random.default_rng(np.random.SeedSequence([3, 2, i]))
        turn = rng.random() < 0.5
        angle = rng.uniform(-3, 3) if turn else None
        if noisy := rng.random() < 0.5:
            rng.normal(size=(20, 3))
        fast = rng.random() < 0.5
        factor = rng.uniform(0.5, 2) if fast else None
        own = [told[f"c{i:03d}", k] for k in range(3)]
        assert [r.applied for r in own] == [turn, noisy, fast]
        assert not turn or float(own[0].params["angle"]) == pytest.approx(angle)
        assert lengths[f"c{i:03d}"] == (max(2, round(20 / factor)) if fast else 20)
        assert not fast or float(own[2].params["factor"]) == pytest.approx(factor)
        seen += turn
    assert 0 < seen < 40
    assert made.exact(2) is made.exact(2)


def test_a_feed_from_files_knows_its_clips_by_name(spark, tmp_path):
    files(tmp_path, range(3))
    made = feed.from_files(spark, str(tmp_path), label=lambda s: F.regexp_extract(s, "([0-9]+)", 1), include_positions=True, streams=["root_pos", "joint_rot"], seed=1)
    (tmp_path / "walk_9.bvh").write_text("broken")  # is listed when the feed is read, and opened only for items
    assert {r.clip_id for r in made.ids.collect()} <= {"walk_0", "walk_1", "walk_2", "walk_9"}
    (tmp_path / "walk_9.bvh").unlink()
    assert sorted((r.clip_id, r.length, r.label) for r in made.items().collect()) == [("walk_0", 6, 0), ("walk_1", 7, 1), ("walk_2", 8, 2)]
    assert made.shuffled(0, 2).count() == 3


# ---- shards -----------------------------------------------------------------------------------


@pytest.mark.parametrize("layout", ["flat", "ctv"])
def test_readers_share_an_epoch(spark, tmp_path, layout):
    made = feed.MotionFeed(paths(spark, [2 + i % 5 for i in range(53)]), spark.createDataFrame([(f"c{i:03d}", i) for i in range(53)], "clip_id string, label long"), streams=["root_pos"], seed=7, target_length=4 if layout == "ctv" else None, layout=layout)
    folder = str(tmp_path / "epochs")
    manifest = shards.write_epoch(made, folder, 0, world_size=3, batch_size=4, shard_batches=2)
    assert manifest.agg(F.sum("n_items"), F.sum("n_batches")).first()[:] == (53, 14)
    order = [r.clip_id for r in feed.with_batches(made.ids, made.order(0), 1).orderBy("batch_id").collect()]
    seen = {}
    for rank in range(3):
        reader = shards.RankReader(folder, rank, 3)
        assert len(reader) == [5, 5, 4][rank]
        for b in reader.batches():
            seen[b["batch"] * 3 + rank] = b["clip_ids"]
            assert b["data"].shape[0] == len(b["clip_ids"]) and list(b["labels"]) == [int(c[1:]) for c in b["clip_ids"]]
            assert b["data"].ndim == (4 if layout == "ctv" else 3) and b["lengths"].min() >= 2
    assert [c for k in sorted(seen) for c in seen[k]] == order and len(order) == 53


def test_reading_goes_on_where_it_stopped(spark, tmp_path):
    made = feed.MotionFeed(paths(spark, [3] * 30), streams=["root_pos"], seed=7)
    folder = "file://" + str(tmp_path / "epochs")
    for epoch in (0, 1):
        shards.write_epoch(made, folder, epoch, world_size=2, batch_size=2, shard_batches=3)
    reader = shards.RankReader(folder, 1, 2)
    whole = [b["clip_ids"] for b in reader.batches(0)]
    first = shards.RankReader(folder, 1, 2)
    for b in first.batches():
        if b["batch"] == 4:
            break
    assert first.next_batch == 4  # the batch that was being used counts as not done
    assert [b["clip_ids"] for b in first.batches()] == whole[4:]
    first.set_epoch(1)
    assert first.next_batch == 0 and sum(len(b["clip_ids"]) for b in first.batches()) == 14
    with pytest.raises(FileExistsError):
        shards.write_epoch(made, folder, 1, world_size=2, batch_size=2)
    with pytest.raises(FileNotFoundError):
        reader.set_epoch(5)
    with pytest.raises(ValueError, match="for 2 ranks"):
        shards.RankReader(folder, 0, 3)


# ---- clips by number --------------------------------------------------------------------------


def test_an_item_reads_one_row_group(spark, tmp_path):
    lengths = [40, 0, 700, 1, 90, 60, 3000]
    frames = paths(spark, lengths)
    clips = spark.createDataFrame([(f"c{i:03d}", i * 10) for i in range(7)], "clip_id string, label int")
    folder = str(tmp_path / "numbered")
    index = numbered.write(frames, clips, folder, file_clips=3).orderBy("number").collect()
    assert [(r.number, r.clip_id, r.n_frames, r.label) for r in index] == [(i, f"c{i:03d}", n, i * 10) for i, n in enumerate(lengths)]
    assert index[1].path is None and len({r.path for r in index if r.path}) == 3
    held = numbered.NumberedClips(folder)
    assert len(held) == 7
    for i, n in enumerate(lengths):
        for k in (i, i - 7):
            got = held[k]
            assert got["clip_id"] == f"c{i:03d}" and got["label"] == i * 10 and len(got.get("root_pos", [])) == n
        if n:
            np.testing.assert_array_equal(got["root_pos"][:, 1], np.arange(n))
    size = (tmp_path / "numbered" / index[6].path).stat().st_size
    held.bytes_read = 0
    held[3]
    small, held.bytes_read = held.bytes_read, 0
    held[6]
    assert small < 8000 < 10_000 < size and held.bytes_read <= size + 8000
    beside = (tmp_path / "numbered" / index[2].path).stat().st_size
    held.bytes_read = 0
    held[0]
    assert held.bytes_read < beside  # not the long clip in the same file
    for k in (7, -8):
        with pytest.raises(IndexError):
            held[k]


def test_numbers_of_many_ranges(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(numbered, "RANGE_CLIPS", 7)
    clips = spark.range(100).select(F.format_string("%03d", "id").alias("clip_id"))
    got = numbered.numbers(clips.unionByName(clips)).orderBy("number").collect()
    assert [(r.clip_id, r.number) for r in got] == [(f"{i:03d}", i) for i in range(100)]


# ---- skeletons, windows, the parser in SQL ----------------------------------------------------


def test_depths_of_chains_and_of_many_nodes(spark):
    chain = spark.range(1000).select(F.col("id").cast("int").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).cast("int").alias("parent"))
    got = skeleton.depths(chain).agg(F.count("*"), F.max("depth"), F.sum(F.when(F.col("depth") != F.col("node"), 1).otherwise(0))).first()
    assert got[:] == (1000, 999, 0)
    with pytest.raises(ValueError, match="circle"):
        skeleton.depths(spark.createDataFrame([(0, None), (1, 2), (2, 1)], "node int, parent int"))
    lost = skeleton.depths(spark.createDataFrame([(0, None), (1, 0), (5, 9), (6, 5)], "node int, parent int"))
    assert sorted((r.node, r.depth) for r in lost.collect()) == [(0, 0), (1, 1)]
    assert skeleton.depths(spark.createDataFrame([], "node int, parent int")).count() == 0


def test_depths_of_two_million_nodes(spark):
    n = spark.range(2_000_000).select((F.col("id") / 20).cast("int").alias("skeleton"), (F.col("id") % 20).cast("int").alias("node"))
    n = n.withColumn("parent", F.when(F.col("node") > 0, F.floor((F.col("node") - 1) / 2)).cast("int"))
    assert skeleton.depths(n).agg(F.count("*"), F.sum("depth")).first()[:] == (2_000_000, 100_000 * sum(int(np.log2(k + 1)) for k in range(20)))


def test_short_clips_are_skipped_or_refused(spark):
    frames = paths(spark, (5, 2))
    assert {r.clip_id for r in temporal.sliding_windows(frames, 3).collect()} == {"c000"}
    with pytest.raises(Exception, match="clip c001 is shorter than a window of 3 frames"):
        temporal.sliding_windows(frames, 3, short="refuse").collect()
    assert temporal.sliding_windows(frames, 2, short="refuse").count() == 2 * 4 + 2
    with pytest.raises(ValueError):
        temporal.sliding_windows(frames, 2, short="pad")


def test_the_parser_in_sql(spark, tmp_path):
    files(tmp_path, range(3))
    texts = spark.read.text(str(tmp_path), wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.", 1).alias("clip_id"), "value")
    texts.unionByName(spark.createDataFrame([("bad", "HIERARCHY"), ("null", None)], "clip_id string, value string")).createOrReplaceTempView("texts")
    rows = {r.clip_id: r for r in spark.sql(f"SELECT * FROM {bvh.register_parser(spark, 'parse_rows')}(TABLE(SELECT clip_id, value FROM texts))").collect()}
    want = {r.clip_id: r for r in bvh.scan(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in rows.items() if v.error is None} == want and rows["bad"].error and rows["null"].error
