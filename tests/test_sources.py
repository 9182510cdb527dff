"""The motion data source: what is opened and read for a question, filters on names, plans by size, and broken files."""

import numpy as np
import pytest
from tests_rig import rig

from kinetra.operators import audit
from kinetra.sources import bvh, motionfiles


@pytest.fixture
def folder(tmp_path):
    for i in range(6):
        clip = rig()
        n = 40 * (i + 1)
        clip |= {"n_frames": n, "root": np.tile(clip["root"], (n, 1))[:n].tolist(), "joints": np.tile(clip["joints"], (n, 1, 1))[:n].tolist()}
        bvh.write(str(tmp_path / f"{'walk' if i < 4 else 'run'}_{i}.bvh"), clip)
    return tmp_path


def read(spark, folder, columns, where=None, **options):
    df = motionfiles.motion_files(spark, str(folder), columns, **options)
    return sorted((df.where(where) if where else df).collect())


def test_rows_equal_those_of_the_text_reader(spark, folder):
    want = sorted(bvh.scan(spark, str(folder)).collect())
    assert read(spark, folder, bvh.SCHEMA) == want
    assert read(spark, f"file://{folder}", bvh.SCHEMA, partition_bytes=1) == want


def test_names_open_no_file_and_heads_parse_no_motion(spark, folder, monkeypatch):
    monkeypatch.setattr(motionfiles, "HEAD_BYTES", 512)  # of this process only: tasks read 64 KB at a time
    assert [(r.clip_id, r.bytes_read) for r in read(spark, folder, "clip_id string, bytes_read long, bytes long")] == [(f"{'walk' if i < 4 else 'run'}_{i}", 0) for i in (4, 5, 0, 1, 2, 3)]
    big = folder / "big.bvh"
    big.write_text((folder / "run_5.bvh").read_text() + "no number " * 200_000)  # motion that would not parse
    head = read(spark, folder, "clip_id string, n_frames int, joint_names array<string>, bytes long, bytes_read long", "clip_id = 'big'")
    assert [(r.n_frames, r.bytes_read) for r in head] == [(240, 64 << 10)] and head[0].bytes > 20 * head[0].bytes_read
    with pytest.raises(Exception, match="big"):
        read(spark, folder, "clip_id string, root array<array<double>>", "clip_id = 'big'")


def test_filters_reach_the_listing(spark, folder):
    (folder / "walk_9.bvh").write_text("HIERARCHY broken")  # raises when it is opened
    cases = {
        "clip_id like 'run%'": ["run_4", "run_5"], "clip_id in ('walk_1', 'x')": ["walk_1"], "endswith(clip_id, '_2')": ["walk_2"], "contains(clip_id, 'alk_3')": ["walk_3"],
        "clip_id > 'walk_1' and clip_id < 'walk_3'": ["walk_2"], "clip_id <= 'run_4'": ["run_4"], "not clip_id like 'walk%'": ["run_4", "run_5"], "clip_id is null": [],
    }
    for where, want in cases.items():
        assert [r.clip_id for r in read(spark, folder, "clip_id string, names array<string>", where)] == want, where
    rest = motionfiles.motion_files(spark, str(folder), "clip_id string, n_frames int", skip_errors=True).where("n_frames = 80 and clip_id <> 'walk_0'")
    assert [r.clip_id for r in rest.collect()] == ["walk_1"]  # n_frames is not a name: Spark filters it


def test_partitions_are_planned_by_size(folder):
    reader = motionfiles.MotionReader(type("S", (), {"names": ["clip_id"]}), {"path": str(folder), "partition_bytes": str(60_000)})
    parts = reader.partitions()
    sizes = [sum(n for _, n in p.files) for p in parts]
    assert sum(len(p.files) for p in parts) == 6 and len(parts) == -(-sum(sizes) // 60_000) and max(sizes) < 2 * 60_000
    assert {len(p.files) for p in parts} != {6}


def test_heads_answer_the_audit(spark, folder):
    heads = motionfiles.heads(spark, str(folder))
    assert bvh.skeletons(heads).count() == 6 * 7
    full = bvh.scan(spark, str(folder))
    assert sorted(audit.euler_order_majority(heads).collect()) == sorted(audit.euler_order_majority(full).collect())
    assert heads.schema == full.drop("root", "joints").select(heads.columns).schema


def test_odd_files(spark, folder, tmp_path):
    (folder / "zz.bvh").write_text("HIERARCHY")
    with pytest.raises(Exception, match="zz"):
        read(spark, folder, bvh.SCHEMA)
    rows = {r.clip_id: r for r in read(spark, folder, bvh.SCHEMA, skip_errors=True)}
    assert rows["zz"].error and rows["zz"].root is None and rows["run_4"].error is None
    assert read(spark, folder, "clip_id string", pattern="*.nothing") == []
    with pytest.raises(Exception, match="no columns"):
        read(spark, folder, "clip_id string, other int")
    with pytest.raises(ValueError, match="no number"):
        bvh.parse((folder / "run_4.bvh").read_text() + " x")


def test_listing_opens_nothing(spark, folder):
    (folder / "bad.bvh").write_text("nothing")
    rows = bvh.listing(spark, str(folder)).orderBy("clip_id").collect()
    assert [r.clip_id for r in rows][:2] == ["bad", "run_4"] and rows[0].bytes == 7
