"""The offline build: motion files to a dataset on disk, with audit, harmonising and statistics."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.functions.rotations import convert_joints
from kinetra.operators import audit, harmonize, skeleton, stats
from kinetra.operators.temporal import center_root, foot_contacts, joint_velocities
from kinetra.schema import check_euler_order, parse_axis, require_centering, require_representation
from kinetra.sources import bvh, store
from kinetra.sources.shared import written

STORED = ("euler", "quat", "6d", "axisangle")


def _dominant(vector: list[Column], order: str) -> Column:
    """The signed axis of the largest number, null where all are 0; of equals, the first in ``order``."""
    big = F.greatest(*(F.abs(v) for v in vector))
    of = dict(zip("xyz", vector))
    return F.coalesce(*(F.when((big > 0) & (F.abs(of[a]) == big), F.when(of[a] > 0, f"+{a}").otherwise(f"-{a}")) for a in order))


def _total(nodes: Column) -> list[Column]:
    """The sum of the nodes' offsets."""
    return [F.aggregate(F.transform(nodes, lambda n: n["offsets"][i]), F.lit(0.0), lambda a, b: a + b) for i in range(3)]


def with_axes(clips: DataFrame, world_up: str = "auto") -> DataFrame:
    """Rows of motion files with ``world_up, rest_up, rest_forward``, worked out within each row (our own definitions).

    ``rest_up`` is the dominant axis of summed torso and head offsets, ``rest_forward`` that of the offsets under feet and
    toes that is not up; both are null where nothing can be measured. ``world_up`` is ``rest_up`` unless given."""
    nodes = F.arrays_zip("names", "parents", "offsets")
    inner = F.filter(nodes, lambda n: (n["parents"] >= 0) & skeleton.has_word(n["names"], skeleton.TORSO_WORDS + skeleton.HEAD_WORDS))
    above = lambda n: F.lower(F.element_at("names", F.greatest(n["parents"], F.lit(0)) + 1))
    toes = F.filter(nodes, lambda n: (n["parents"] >= 0) & above(n).rlike("foot|toe|ankle"))
    held = clips.withColumn("_inner", F.array(*_total(inner))).withColumn("_toes", F.array(*_total(toes)))
    held = held.withColumn("rest_up", _dominant([F.col("_inner")[i] for i in range(3)], "yzx"))
    level = [F.when(F.substring("rest_up", 2, 1) == a, 0.0).otherwise(F.col("_toes")[i]) for i, a in enumerate("xyz")]
    up = F.col("rest_up") if world_up == "auto" else F.lit(world_up)
    return held.withColumns({"rest_forward": _dominant(level, "zxy"), "world_up": up}).drop("_inner", "_toes")


def axis_number(axis: Column) -> Column:
    """0 to 2 of a signed axis; y where it is null."""
    return F.coalesce(*(F.when(F.substring(axis, 2, 1) == a, i) for i, a in enumerate("xyz")), F.lit(1))


def stages_of(facts: DataFrame, targets: dict[str, object], retarget: bool) -> DataFrame:
    """``clip_id, stages``: what a build changes in each clip."""
    tests = {"resample": F.col("fps") != audit.fps_key(F.lit(1 / targets["fps"])) if "fps" in targets else None}
    tests |= {a: F.col(a) != targets[a] if a in targets else None for a in ("world_up", "rest_forward", "rest_up")}
    tests["euler_order"] = F.exists("euler_orders", lambda o: o != targets["euler_order"]) if "euler_order" in targets else None
    tests["retarget"] = F.lit(True) if retarget else None
    found = [F.when(c, n) for n, c in tests.items() if c is not None]
    stages = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
    return facts.select("clip_id", stages.alias("stages"))


def clip_streams(clips: DataFrame, representation: str, *, targets: dict[str, object] | None = None, top: skeleton.Topology | None = None, bones: Column | None = None, positions=(), centering: str = "world", quaternions: bool = False, velocities: bool = False, feet: list[int] | None = None) -> DataFrame:
    """Frame rows of files (``with_axes``) in a representation, brought to ``targets``, with positions (``joint``, ``node``),
    velocities and foot contacts made by forward kinematics over the graph of ``top``, if asked for.

    All that differs between clips comes from the clip's own row: Euler orders, bone offsets (or ``bones``), axes and
    frame time."""
    targets = targets or {}
    fps = targets.get("fps")
    frames = bvh.frames(clips, "euler_orders", "frame_time", "world_up", "rest_up", "rest_forward")
    frames = frames.withColumn("joint_rot", convert_joints(F.col("joint_rot"), "euler", "quat", F.col("euler_orders")))
    if fps:
        frames = harmonize.to_fps(frames, fps, F.col("frame_time")).withColumn("frame_time", F.lit(1 / fps))
    if "world_up" in targets:
        frames = harmonize.turn_world(frames, targets["world_up"])
    for name in ("rest_forward", "rest_up"):
        if name in targets:
            frames = harmonize.turn_rest_rotations(frames, F.col(name), targets[name])
    joints = velocities or feet is not None
    if positions or joints:
        own = clips.select("clip_id", (F.col("offsets") if bones is None else bones).alias("bones"))
        frames = frames.join(own, "clip_id").withColumn("up", axis_number(F.col("world_up")))
        frames = skeleton.refresh_positions(frames, top, "quat", joint="joint" in positions or joints, node="node" in positions, centering=centering, up="up", own_offsets="bones")
    if velocities:
        frames = joint_velocities(frames, F.col("frame_time"))
    if feet is not None:
        longest = F.array_max(F.transform(F.flatten("bones"), lambda x: F.abs(x)))
        frames = frames.withColumn("scale", F.when(longest > 0, longest).otherwise(1.0))
        frames = foot_contacts(frames, feet, F.col("up"), 0.25 * F.col("scale"), 0.05 * F.col("scale"))
    if quaternions and representation != "quat":
        frames = frames.withColumn("joint_quats", F.col("joint_rot"))
    frames = frames.withColumn("joint_rot", convert_joints(F.col("joint_rot"), "quat", representation, targets.get("euler_order") or F.col("euler_orders")))
    made = [*(f"{p}_pos" for p in positions), *(["joint_quats"] if "joint_quats" in frames.columns else []), *(["velocities"] if velocities else []), *(["foot_contacts"] if feet is not None else [])]
    return frames.select("clip_id", "t", "root_pos", "joint_rot", *made)


def preprocess(
    spark: SparkSession, folder: str, output: str, representation: str = "6d", center: bool = True, include_positions: bool = False, position_space: str = "joint",
    position_centering: str = "world", include_quaternions: bool = False, include_velocities: bool = False, include_foot_contacts: bool = False, foot_joints: list[int] | None = None,
    label: Callable[[Column], Column] | None = None, keep: Callable[[Column], Column] | None = None, pattern: str = "*.bvh", skip_errors: bool = False,
    world_up: str = "auto", do_harmonize: bool = False, target_world_up: str | None = None, target_fps: float | None = None, target_rest_up: str | None = None,
    target_rest_forward: str | None = None, target_euler_order: str | None = None, retarget: bool = False,
) -> dict:
    """Builds the dataset and returns its metadata. All arguments are checked before a file is opened.

    Every clip keeps its own Euler orders, bone offsets, rest axes and frame time through all steps, so that a clip's
    rows are the same alone and in company. ``do_harmonize`` fills targets from majorities where clips differ; given
    targets apply without it, too, in the order frame rate, world up, rest forward, rest up. ``retarget`` gives every clip
    the first one's bone offsets; clips of another hierarchy are then refused by name.
    """
    require_representation(representation, STORED)
    kind = store.check_suffix(output)
    require_centering(position_centering)
    if position_space not in ("joint", "node"):
        raise ValueError("position_space is joint or node")
    if center and position_centering == "first" and include_positions:
        raise ValueError("positions centred on the first frame can't be centred again")
    if target_euler_order is not None:
        check_euler_order(target_euler_order)
    if audit.is_parallel(target_rest_up, target_rest_forward):
        raise ValueError("rest_forward can't lie along rest_up")
    for a in (target_world_up, target_rest_up, target_rest_forward, None if world_up == "auto" else world_up):
        if a is not None:
            parse_axis(a)
    listed = bvh.listing(spark, folder, pattern)
    files = listed if bvh.by_tasks(spark, folder, pattern) else folder
    parsed = bvh.scan(spark, files, pattern, keep, skip_errors).persist(StorageLevel.DISK_ONLY)  # files are parsed once
    try:
        return _build(parsed, listed, pattern, folder, output, kind, representation, center, include_positions, position_space, position_centering, include_quaternions, include_velocities, include_foot_contacts, foot_joints, label, skip_errors, world_up, do_harmonize, {"world_up": target_world_up, "fps": target_fps, "rest_up": target_rest_up, "rest_forward": target_rest_forward, "euler_order": target_euler_order}, retarget)
    finally:
        parsed.unpersist()


def _build(parsed, listed, pattern, folder, output, kind, representation, center, include_positions, position_space, position_centering, include_quaternions, include_velocities, include_foot_contacts, foot_joints, label, skip_errors, world_up, do_harmonize, explicit, retarget) -> dict:
    bvh.require_files(parsed, folder)
    if skip_errors:
        bvh.warn_skipped(parsed)
    clips = with_axes(bvh.good(parsed), world_up)
    facts = clips.drop("root", "joints", "error").withColumn("fps", audit.fps_key(F.col("frame_time")))
    dist: dict[str, dict[str, int]] = {}
    for r in audit.distribution(facts).collect():
        dist.setdefault(r["axis"], {})[r["value"]] = r["n"]
    audit.warn_heterogeneous(facts)
    first = facts.orderBy("clip_id").first()
    ordered = representation in ("euler", "axisangle")
    targets = {a: float(v) if a == "fps" else v for a, v in explicit.items() if v}
    if do_harmonize:
        order = audit.euler_order_majority(facts).first() if ordered else None
        mixed = order is not None and not facts.where(F.exists("euler_orders", lambda o: o != order["value"])).isEmpty()
        targets = audit.harmonize_targets(dist, explicit, mismatch=not facts.where("rest_up <> world_up").isEmpty(), order=order["value"] if mixed else None)
    audit.reject_degenerate_up(facts, targets.get("rest_up"))
    audit.reject_parallel_forward(facts, targets.get("rest_forward"), targets.get("world_up"))
    if retarget:
        bad = audit.incompatible(facts).orderBy("clip_id").limit(5).collect()
        if bad:
            raise ValueError(f"clips can't take the skeleton of {first['clip_id']}: " + "; ".join(f"{r['clip_id']} has other {r['what']}" for r in bad))
    audit.check_compatible(facts, ordered and "euler_order" not in targets)

    fps = targets.get("fps")
    bones = F.lit(first["offsets"]).cast("array<array<double>>") if retarget else F.col("offsets")
    for name in ("rest_forward", "rest_up"):
        if name in targets:
            bones = harmonize.turn_offsets(bones, F.lit(first[name]).cast("string") if retarget else F.col(name), targets[name])
    base = clips.where(F.col("clip_id") == first["clip_id"])
    nodes = bvh.skeletons(base).cache()
    top = skeleton.topology(nodes)
    top = replace(top, offsets=[list(x) for x in base.select(bones.alias("bones")).first()["bones"]])
    feet = foot_joints
    if include_foot_contacts and feet is None:
        feet = [i for i, n in enumerate(first["joint_names"]) if any(w in n.lower() for w in ("foot", "toe", "ankle"))]
    position = f"{position_space}_pos" if include_positions else None
    frames = clip_streams(clips, representation, targets=targets, top=top, bones=bones, positions=[position_space] if position else [], centering=position_centering, quaternions=include_quaternions, velocities=include_velocities, feet=feet if include_foot_contacts else None)
    if center:
        frames = center_root(frames, position_centering if position else None)
    if kind not in store.ARCHIVES:
        frames = store.save_frames(frames, output)  # statistics read what is written
    found = written(block_moments(frames, position), "moments")
    block = stats.of_moments(found, "block")
    clip_rows = clip_facts(facts, fps, targets, label)
    info = skeleton.skeleton_info(nodes, targets.get("world_up") or first["world_up"] or "+y", targets.get("rest_forward") or first["rest_forward"], targets.get("rest_up") or first["rest_up"], partitions=True)
    nodes.unpersist()
    info["euler_orders"] = info["fk_topology"]["euler_orders"] = [targets["euler_order"]] * len(top.euler_orders) if "euler_order" in targets else top.euler_orders
    info["fk_topology"]["offsets"] = top.offsets
    counts = {r["stage"]: r["n"] for r in audit.stage_counts(stages_of(facts, targets, retarget)).collect()}
    trail = {"retarget": retarget, "reference": first["clip_id"] if retarget else None, "stage_counts": counts}
    meta = {"representation": representation, "center_root": center, "position_centering": position_centering if position else None, "position_space": position_space if position else None, "include_quaternions": include_quaternions, "uniformity": dist, "harmonized_to": targets, "harmonizing": trail, "skeleton_info": info, "num_clips": facts.count(), "has_audit": True, "parts": 1}
    meta["build"] = {"pattern": pattern, "skip_errors": skip_errors, "world_up": world_up, "include_velocities": include_velocities, "feet": feet if include_foot_contacts else None, "parents": list(first["parents"]), "base": first["clip_id"]}
    if kind not in store.ARCHIVES:
        found.write.mode("overwrite").parquet(store.part_folder(output, "moments", 0))
        files_of(parsed, listed).write.mode("overwrite").parquet(store.part_folder(output, "files", 0))
    store.save(store.MotionDataset(frames, clip_rows, block, meta, audit.values(facts)), output, frames=False)
    return meta


def clip_facts(facts: DataFrame, fps: float | None, targets: dict[str, object], label) -> DataFrame:
    """The rows of the dataset's clips."""
    n = harmonize.target_frames(F.col("n_frames"), F.col("frame_time"), fps).cast("int") if fps else F.col("n_frames")
    return facts.select("clip_id", n.alias("n_frames"), (F.lit(1 / fps) if fps else F.col("frame_time")).alias("frame_time"), (F.lit(targets["world_up"]) if "world_up" in targets else F.col("world_up")).alias("world_up"), *([label(F.col("clip_id")).cast("long").alias("label")] if label else []))


def block_moments(frames: DataFrame, position: str | None) -> DataFrame:
    """``block, dim, n, mean, m2`` of the features and, if asked for, of the positions."""
    found = stats.moments(frames, ["root_pos", "joint_rot"]).withColumn("block", F.lit("features"))
    return found if position is None else found.unionByName(stats.moments(frames, [position]).withColumn("block", F.lit("positions")))


def files_of(parsed: DataFrame, listed: DataFrame) -> DataFrame:
    """``clip_id, path, bytes, modified`` of the files that a build took, broken ones among them."""
    return listed.join(parsed.select("clip_id").hint("merge"), "clip_id", "left_semi")


def extend(spark: SparkSession, folder: str, output: str, label: Callable[[Column], Column] | None = None, keep: Callable[[Column], Column] | None = None) -> dict:
    """Adds the files of ``folder`` that the dataset at ``output`` has not yet; only these are opened. Returns the metadata.

    Everything is made as in the first build: its arguments, its targets (also those that majorities chose then), its
    skeleton where clips are retargeted. Statistics are merged from stored moments, so with targets given the dataset is the one
    that a single build would make. Rows of the addition lie in folders of their own, and count once the metadata, written last,
    names them: an addition that failed is simply run again. Files that changed since they were taken are refused by name, clips
    of another hierarchy too; files that went away keep their clips.
    """
    if store.check_suffix(output) in store.ARCHIVES:
        raise ValueError("archives can't be extended")
    meta = store.load_meta(spark, output)
    if "build" not in meta:
        raise ValueError(f"{output} was built before datasets could be extended")
    how, info, parts = meta["build"], meta["skeleton_info"], meta["parts"]
    known = store.read_parts(spark, output, "files", parts)
    listed = bvh.listing(spark, folder, how["pattern"])
    listed = listed if keep is None else listed.where(keep(F.col("clip_id")))
    was = known.select("clip_id", F.col("bytes").alias("_bytes"), F.col("modified").alias("_modified"))
    changed = listed.join(was.hint("merge"), "clip_id").where("bytes <> _bytes or modified <> _modified").orderBy("clip_id").limit(5).collect()
    if changed:
        raise ValueError("files changed since they were built: " + ", ".join(r["clip_id"] for r in changed))
    new = written(listed.join(known.hint("merge"), "clip_id", "left_anti"), "files")
    if new.isEmpty():
        return meta
    # names of new files go to the driver only where Spark's own listing holds them there
    files = new if bvh.by_tasks(spark, folder, how["pattern"]) else [r["path"] for r in new.select("path").toLocalIterator()]
    parsed = bvh.scan(spark, files, how["pattern"], None, how["skip_errors"]).persist(StorageLevel.DISK_ONLY)
    try:
        if how["skip_errors"]:
            bvh.warn_skipped(parsed)
        clips = with_axes(bvh.good(parsed), how["world_up"])
        facts = clips.drop("root", "joints", "error").withColumn("fps", audit.fps_key(F.col("frame_time")))
        targets, retarget, representation = meta["harmonized_to"], meta["harmonizing"]["retarget"], meta["representation"]
        audit.reject_degenerate_up(facts, targets.get("rest_up"))
        audit.reject_parallel_forward(facts, targets.get("rest_forward"), targets.get("world_up"))
        like = {"joint_names": info["joint_names"], "parents": how["parents"]}
        if representation in ("euler", "axisangle") and "euler_order" not in targets:
            like["euler_orders"] = info["euler_orders"]
        for column, value in like.items():
            bad = facts.where(~F.col(column).eqNullSafe(F.lit(value).cast(facts.schema[column].dataType))).orderBy("clip_id").limit(1).collect()
            if bad:
                raise ValueError(f"{bad[0]['clip_id']} has other {column} than {how['base']}")
        fps = targets.get("fps")
        top = skeleton.Topology.from_json(json.dumps(info["fk_topology"]))
        bones = F.lit(top.offsets).cast("array<array<double>>") if retarget else F.col("offsets")
        for name in () if retarget else ("rest_forward", "rest_up"):
            if name in targets:
                bones = harmonize.turn_offsets(bones, F.col(name), targets[name])
        position = f"{meta['position_space']}_pos" if meta["position_space"] else None
        frames = clip_streams(clips, representation, targets=targets, top=top, bones=bones, positions=[meta["position_space"]] if position else [], centering=meta["position_centering"] or "world", quaternions=meta["include_quaternions"], velocities=how["include_velocities"], feet=how["feet"])
        if meta["center_root"]:
            frames = center_root(frames, meta["position_centering"] if position else None)
        frames = store.save_frames(frames, output, parts)
        block_moments(frames, position).write.mode("overwrite").parquet(store.part_folder(output, "moments", parts))
        merged = stats.merge_moments(store.read_parts(spark, output, "moments", parts + 1), "block")
        stats.of_moments(merged, "block").write.mode("overwrite").parquet(store.part_folder(output, "stats", parts))
        clip_facts(facts, fps, targets, label).write.mode("overwrite").parquet(store.part_folder(output, "clips", parts))
        audit.values(facts).write.mode("overwrite").parquet(store.part_folder(output, "audit", parts))
        files_of(parsed, new).write.mode("overwrite").parquet(store.part_folder(output, "files", parts))
        for r in audit.distribution(facts).collect():
            of = meta["uniformity"].setdefault(r["axis"], {})
            of[r["value"]] = of.get(r["value"], 0) + r["n"]
        for r in audit.stage_counts(stages_of(facts, targets, retarget)).collect():
            counts = meta["harmonizing"]["stage_counts"]
            counts[r["stage"]] = counts.get(r["stage"], 0) + r["n"]
        meta |= {"num_clips": meta["num_clips"] + facts.count(), "parts": parts + 1}
        store.save_meta(spark, meta, output)
        return meta
    finally:
        parsed.unpersist()
