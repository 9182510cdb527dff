"""Listings by tasks: the driver holds no list of files, and tasks are as many as bytes need; Spark's own listing sees the same files."""

import gzip

import pytest
from pyspark.sql import functions as F
from tests_rig import rig

from kinetra.plans import build
from kinetra.sources import bvh, shared, store


def files(folder, span):
    folder.mkdir(exist_ok=True, parents=True)
    for i in span:
        bvh.write(str(folder / f"walk_{i}.bvh"), rig(2 + i % 3, seed=i))
    return folder


def by_spark(spark, folder, pattern):
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(str(folder))
    return sorted(tuple(r) for r in f.select(bvh.stem_of(F.element_at(F.split("path", "/"), -1)), "path", "length", "modificationTime").collect())


def test_a_build_and_its_extension_hold_no_list_of_files_on_the_driver(spark, tmp_path, monkeypatch):
    src, out = files(tmp_path / "src", range(300)), str(tmp_path / "out")
    seen, scan = [], bvh.scan

    def spy(*args, **how):
        made = scan(*args, **how)
        seen.append(([f for f in made.inputFiles() if f.endswith(".bvh")], made.rdd.getNumPartitions()))
        return made

    monkeypatch.setattr(bvh, "scan", spy)
    assert build.preprocess(spark, str(src), out, keep=lambda s: s.contains("1"))["num_clips"] == 138
    assert build.extend(spark, str(src), out)["num_clips"] == 300
    assert seen == [([], spark.sparkContext.defaultParallelism)] * 2
    data = store.load(spark, out)
    assert data.frames.select("clip_id").distinct().count() == data.clips.count() == 300


@pytest.mark.parametrize("pattern", ["*.bvh", "*", "{a,c}*.bvh", "[a-c]*", "?.bvh", "[^a]*.bvh", r"a\[1].bvh", "*.nothing"])
def test_tasks_list_what_spark_lists(spark, tmp_path, pattern):
    for name in ("a b.bvh", ".x.bvh", "_y.bvh", "_k=v.bvh", "ü.bvh", "z%20.bvh", "zero.bvh", "q.txt", "s.bvh._COPYING_", "a[1].bvh", "c.bvh", "no"):
        (tmp_path / name).write_text("x" * (0 if name == "zero.bvh" else len(name)))
    files(tmp_path / "plain", range(2))
    assert sorted(tuple(r) for r in bvh.listing(spark, str(tmp_path), pattern).collect()) == by_spark(spark, tmp_path, pattern)


def test_named_sub_folders_count(spark, tmp_path):
    for i, k in enumerate(("k=w/j=1", "k=w/j=2", "k=x/j=3")):
        files(tmp_path / "src" / k, [i])
    got = sorted(tuple(r) for r in bvh.listing(spark, str(tmp_path / "src")).collect())
    assert len(got) == 3 and got == by_spark(spark, tmp_path / "src", "*.bvh")
    assert sorted(r.clip_id for r in bvh.scan(spark, str(tmp_path / "src")).collect()) == ["walk_0", "walk_1", "walk_2"]
    files(tmp_path / "src", [7])  # beside sub-folders
    assert bvh.listing(spark, str(tmp_path / "src")).count() == 4


def test_tasks_follow_bytes(spark, tmp_path, monkeypatch):
    listed = bvh.listing(spark, str(files(tmp_path, range(40))))
    total = listed.agg(F.sum("bytes")).first()[0] + 40 * bvh.FILE_BYTES
    for tasks in (40, 10):
        monkeypatch.setattr(bvh, "PARTITION_BYTES", -(-total // tasks))
        made = bvh.parse_files(listed)
        assert made.rdd.getNumPartitions() == tasks and made.count() == 40
    assert bvh.parse_files(listed.where("false")).count() == 0


def test_what_tasks_cannot_open_goes_through_spark(spark, tmp_path):
    src = files(tmp_path / "src", range(3))
    want = sorted(bvh.scan(spark, str(src)).collect())
    assert bvh.by_tasks(spark, str(src)) == f"file:{src}" and len(want) == 3
    for other in (f"{src}/*.bvh", str(src / "walk_0.bvh"), str(tmp_path / "none")):
        assert bvh.by_tasks(spark, other) is None
    assert bvh.by_tasks(spark, str(src), "*.bvh.snappy") is None
    assert sorted(bvh.scan(spark, f"{src}/*.bvh").collect()) == want
    assert sorted(bvh.scan(spark, [str(p) for p in src.iterdir()]).collect()) == want
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        bvh.scan(spark, str(tmp_path / "none"))


def test_a_dataset_listed_by_spark_is_extended_by_tasks(spark, tmp_path, monkeypatch):
    src, out = files(tmp_path / "src", range(2)), str(tmp_path / "out")
    with monkeypatch.context() as m:
        m.setattr(bvh, "by_tasks", lambda *a: None)
        build.preprocess(spark, str(src), out)
        files(src, [2])
        with pytest.raises(ValueError, match="changed"):
            (src / "walk_0.bvh").touch()
            build.extend(spark, str(src), out)
        build.preprocess(spark, str(src), out)
        files(src, [3])
        assert build.extend(spark, str(src), out)["num_clips"] == 4
    files(src, [4])
    assert build.extend(spark, str(src), out)["num_clips"] == 5
    (src / "walk_1.bvh").touch()
    with pytest.raises(ValueError, match="changed.*walk_1"):
        build.extend(spark, str(src), out)


def test_packed_and_odd_files(spark, tmp_path):
    src = files(tmp_path / "a b%20", range(2))
    (src / "packed.bvh.gz").write_bytes(gzip.compress((src / "walk_1.bvh").read_bytes()))
    (src / "odd.bvh").write_bytes(b"HIERARCHY \xff\xfe")
    rows = {r.clip_id: r for r in bvh.scan(spark, str(src), skip_errors=True).collect()}
    assert set(rows) == {"walk_0", "walk_1", "odd"} and "utf-8" in rows["odd"].error
    packed = bvh.scan(spark, str(src), "*.gz").collect()
    assert [r.clip_id for r in packed] == ["packed.bvh"] and packed[0].joints == rows["walk_1"].joints


def test_paths_of_stores():
    assert shared.arrow_path("file:/a/b c%20")[1] == shared.arrow_path("file:///a/b c%20")[1] == "/a/b c%20"
