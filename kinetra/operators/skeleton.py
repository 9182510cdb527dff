"""Skeleton graphs: edges, left-right pairs, end sites, body parts, and forward kinematics.

A skeleton table has a row per node in file order: ``node, name, parent, joint_idx, off_x, off_y, off_z,
euler_order``; ``parent`` is null at the root, ``joint_idx`` null at end sites. A ``skeleton`` column before
these (any key) holds many skeletons in one table.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.functions.arrays import forward_kinematics, to_matrix
from kinetra.schema import require_centering
from kinetra.sources.shared import written

# The words by which joints are told apart.
TORSO_WORDS = ("hips", "spine", "chest", "abdomen", "pelvis", "torso", "back")
HEAD_WORDS = ("head", "neck", "jaw", "eye")
ARM_WORDS = ("arm", "shoulder", "hand", "finger", "thumb", "wrist", "elbow", "clavicle", "collar", "forearm")
LEG_WORDS = ("leg", "hip", "knee", "ankle", "foot", "toe", "thigh", "shin", "calf", "upleg")

KEY = ["skeleton"]


def keyed(nodes: DataFrame) -> DataFrame:
    return nodes if "skeleton" in nodes.columns else nodes.withColumn("skeleton", F.lit("0"))


def edges(nodes: DataFrame, end_sites: bool = False) -> DataFrame:
    """``skeleton, child, parent``: in node numbers with end sites, else in joint numbers."""
    n = keyed(nodes)
    if end_sites:
        return n.where("parent is not null").select(*KEY, F.col("node").alias("child"), "parent")
    up = n.select(*KEY, F.col("node").alias("parent"), F.col("joint_idx").alias("up"))
    return n.where("parent is not null and joint_idx is not null").join(up, [*KEY, "parent"]).select(*KEY, F.col("joint_idx").alias("child"), F.col("up").alias("parent"))


def depths(nodes: DataFrame) -> DataFrame:
    """``skeleton, node, depth`` by pointer doubling: each round, a node that knows its ancestor of 2^k levels up learns that of
    2^(k+1) from it, so chains of a thousand nodes take ten rounds, whatever the number of rows.

    A node whose chain of parents ends in a node that is not there has no row; parents in a circle are refused."""
    n = keyed(nodes).select(*KEY, "node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    state = written(n, "depth")
    most = math.ceil(math.log2(max(2, state.count()))) + 1
    for _ in range(most):
        if state.where("up is not null").isEmpty():
            return state.select(*KEY, "node", "depth")
        higher = state.select(*KEY, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_more"))
        moved = state.where("up is not null").join(higher, [*KEY, "up"])
        moved = moved.select(*KEY, "node", F.col("_up").alias("up"), (F.col("depth") + F.col("_more")).alias("depth"))
        state = written(state.where("up is null").unionByName(moved), "depth")
    raise ValueError("parents go round in a circle")


def plain_name(name: Column) -> Column:
    return F.translate(F.lower(name), "_- ", "")


def side_of(name: Column) -> Column:
    """left, right or null: the word anywhere, else a capital L or R before another capital."""
    low = F.lower(name)
    return F.when(low.contains("left"), "left").when(low.contains("right"), "right").when(name.rlike("^L[A-Z]"), "left").when(name.rlike("^R[A-Z]"), "right")


def has_word(name: Column, words) -> Column:
    return plain_name(name).rlike("|".join(words))


def body_part(name: Column) -> Column:
    side, torso, head = side_of(name), has_word(name, TORSO_WORDS), has_word(name, HEAD_WORDS)
    return (
        F.when(torso & side.isNull(), "torso")
        .when(head & side.isNull(), "head")
        .when(side.isNotNull() & has_word(name, ARM_WORDS), F.concat(side, F.lit("_arm")))
        .when(side.isNotNull() & has_word(name, LEG_WORDS), F.concat(side, F.lit("_leg")))
        .when(torso, "torso")
        .when(head, "head")
        .otherwise("other")
    )


def body_partitions(nodes: DataFrame) -> DataFrame:
    """``skeleton, joint_idx, name, part``: a guess from names; a large ``other`` says not to trust it."""
    return keyed(nodes).where("joint_idx is not null").select(*KEY, "joint_idx", "name", body_part(F.col("name")).alias("part"))


def pair_key(name: Column) -> Column:
    """The name without its side word, prefix or suffix: equal for the two of a pair."""
    low = F.regexp_replace(name, "(?i)left|right", "*")
    low = F.regexp_replace(low, "^[LR](?=[A-Z])", "*")
    return F.lower(F.regexp_replace(low, "(?i)[_. -][lr]$|^[lr][_. -]", "*"))


def pair_side(name: Column) -> Column:
    tail = F.lower(F.regexp_extract(name, "(?i)(?:[_. -]([lr])$)|(?:^([lr])[_. -])", 0))
    return F.coalesce(side_of(name), F.when(tail.contains("l"), "left").when(tail.contains("r"), "right"))


def _pairs(n: DataFrame, index: str) -> DataFrame:
    m = n.select(*KEY, F.col(index).alias("i"), pair_side(F.col("name")).alias("side"), pair_key(F.col("name")).alias("k"))
    left = m.where("side = 'left'").groupBy(*KEY, "k").agg(F.min("i").alias("left"))
    right = m.where("side = 'right'").groupBy(*KEY, "k").agg(F.min("i").alias("right"))
    return left.join(right, [*KEY, "k"]).select(*KEY, "left", "right")


def lr_pairs(nodes: DataFrame) -> DataFrame:
    """``skeleton, left, right`` in joint numbers, by names."""
    return _pairs(keyed(nodes).where("joint_idx is not null"), "joint_idx")


def node_lr_pairs(nodes: DataFrame) -> DataFrame:
    """``skeleton, left, right`` in node numbers: paired joints, and the end sites of paired parents in order."""
    n = keyed(nodes)
    joints = _pairs(n.where("joint_idx is not null"), "node")
    order = Window.partitionBy(*KEY, "parent").orderBy("node")
    tips = n.where("joint_idx is null").select(*KEY, "parent", "node", F.row_number().over(order).alias("k"))
    left = joints.join(tips.select(*KEY, F.col("parent").alias("left"), F.col("node").alias("ln"), "k"), [*KEY, "left"])
    both = left.join(tips.select(*KEY, F.col("parent").alias("right"), F.col("node").alias("rn"), "k"), [*KEY, "right", "k"])
    return joints.unionByName(both.select(*KEY, F.col("ln").alias("left"), F.col("rn").alias("right")))


def mismatched_end_sites(nodes: DataFrame) -> DataFrame:
    """Joint pairs whose two sides have different numbers of end sites: ``left, right, n_left, n_right``."""
    n = keyed(nodes)
    joint = n.where("joint_idx is not null").select(*KEY, F.col("joint_idx").alias("j"), F.col("node").alias("parent"))
    tips = n.where("joint_idx is null").groupBy(*KEY, "parent").agg(F.count("*").alias("n"))
    count = joint.join(tips, [*KEY, "parent"], "left").select(*KEY, "j", F.coalesce("n", F.lit(0)).alias("n"))
    out = lr_pairs(nodes).join(count.select(*KEY, F.col("j").alias("left"), F.col("n").alias("n_left")), [*KEY, "left"])
    out = out.join(count.select(*KEY, F.col("j").alias("right"), F.col("n").alias("n_right")), [*KEY, "right"])
    return out.where("n_left <> n_right").select(*KEY, "left", "right", "n_left", "n_right")


# ---- topology and forward kinematics ----------------------------------------------------------


@dataclass(frozen=True)
class Topology:
    """What forward kinematics needs: node offsets, parents (-1 at the root), joint numbers (-1 at end sites), orders."""

    offsets: list[list[float]]
    parent_idx: list[int]
    joint_idx: list[int]
    euler_orders: list[str]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Topology:
        raw = json.loads(text)
        if missing := {"offsets", "parent_idx", "joint_idx", "euler_orders"} - raw.keys():
            raise ValueError(f"a topology lacks {', '.join(sorted(missing))}")
        return cls(**{k: raw[k] for k in ("offsets", "parent_idx", "joint_idx", "euler_orders")})

    @property
    def joint_nodes(self) -> list[int]:
        """Node number of each joint."""
        return [n for _, n in sorted((j, n) for n, j in enumerate(self.joint_idx) if j >= 0)]


def topology(nodes: DataFrame) -> Topology:
    """Of a table that holds one skeleton; a skeleton is small, so it is read on the driver."""
    rows = nodes.orderBy("node").collect()
    own = [r for r in rows if r["joint_idx"] is not None]
    return Topology([[r["off_x"], r["off_y"], r["off_z"]] for r in rows], [-1 if r["parent"] is None else r["parent"] for r in rows], [-1 if r["joint_idx"] is None else r["joint_idx"] for r in rows], [r["euler_order"] for r in sorted(own, key=lambda r: r["joint_idx"])])


def cube(column: pa.Array, inner: int) -> np.ndarray:
    """list<list<double>> of equal lengths -> (rows, n, inner)."""
    flat = column.flatten().flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1, inner)


def lists(values: np.ndarray) -> pa.Array:
    """(rows, n, c) -> list<list<double>>."""
    rows, n, c = values.shape
    inner = pa.ListArray.from_arrays(pa.array(np.arange(rows * n + 1, dtype=np.int32) * c), pa.array(values.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * n), inner)


def own_matrices(angles: np.ndarray, orders: list[list[str]]) -> np.ndarray:
    """Euler angles (rows, J, 3) of rows with orders of their own -> (rows, J, 3, 3)."""
    out = np.empty((*angles.shape, 3))
    kinds: dict[tuple, list[int]] = {}
    for i, o in enumerate(orders):
        kinds.setdefault(tuple(o), []).append(i)
    for o, at in kinds.items():
        out[at] = to_matrix(angles[at], "euler", o)
    return out


def refresh_positions(frames: DataFrame, top: Topology, representation: str, *, joint: bool = True, node: bool = False, centering: str = "world", up: int | str = 1, first_root=None, own_offsets: str | None = None, own_orders: str | None = None) -> DataFrame:
    """Makes joint_pos and/or node_pos anew from rotations: (frames of a batch) x joints at once.

    ``own_offsets`` and ``own_orders`` name columns with each row's own bone offsets and Euler orders, which then
    count instead of those of ``top``; ``up`` may name a column with each row's up axis (0 to 2).

    ``world`` stands at the root's path, ``skeleton`` at the origin; ``first`` is ``world`` less the first
    frame's root in the two axes that are not up, which ``first_root`` (a column) holds.
    """
    require_centering(centering)
    offsets, parent, joint_of = np.array(top.offsets, float), np.array(top.parent_idx), np.array(top.joint_idx)
    at = top.joint_nodes
    names = [*(["joint_pos"] if joint else []), *(["node_pos"] if node else [])]
    base = frames.drop(*names)
    if centering == "first":
        if first_root is None:
            first_root = F.first("root_pos").over(Window.partitionBy("clip_id").orderBy("t"))
        base = base.withColumn("_first", first_root)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            root = cube(pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32)), b.column("root_pos")), 3)[:, 0]
            rot = b.column("joint_rot")
            width = {"euler": 3, "quat": 4, "6d": 6, "axisangle": 3, "rotmat": 9}[representation]
            local = own_matrices(cube(rot, width), b.column(own_orders).to_pylist()) if own_orders and representation == "euler" else to_matrix(cube(rot, width), representation, top.euler_orders)
            where = forward_kinematics(np.zeros_like(root) if centering == "skeleton" else root, local, cube(b.column(own_offsets), 3) if own_offsets else offsets, parent, joint_of)
            if centering == "first":
                shift = cube(pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32)), b.column("_first")), 3)[:, 0].copy()
                shift[np.arange(len(shift)), b.column(up).to_numpy() if isinstance(up, str) else up] = 0
                where = where - shift[:, None]
            made = {"joint_pos": lambda: lists(where[:, at]), "node_pos": lambda: lists(where)}
            keep = [c for c in b.schema.names if c != "_first"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(made[n]() for n in names)], [*keep, *names])

    plain = ", ".join(f"`{c}` {t}" for c, t in base.drop("_first").dtypes)
    return base.mapInArrow(run, plain + "".join(f", {n} array<array<double>>" for n in names))


def skeleton_info(nodes: DataFrame, world_up=None, rest_forward=None, rest_up=None, partitions: bool = False) -> dict:
    """All that downstream code needs of one skeleton, as a JSON-ready dict."""
    rows = nodes.orderBy("node").collect()
    top = topology(nodes)
    pick = lambda df, *c: sorted([r[x] for x in c] for r in df.collect())
    joints, ends = pick(lr_pairs(nodes), "left", "right"), [r["node"] for r in rows if r["joint_idx"] is None]
    names = [r["name"] for r in rows if r["joint_idx"] is not None]
    out = {
        "num_joints": len(names), "joint_names": names, "edges": pick(edges(nodes), "child", "parent"), "euler_orders": top.euler_orders,
        "lr_pairs": joints, "lr_mapping": {names[a]: names[b] for a, b in joints}, "num_nodes": len(rows), "node_names": [r["name"] for r in rows],
        "node_edges": pick(edges(nodes, True), "child", "parent"), "node_lr_pairs": pick(node_lr_pairs(nodes), "left", "right"), "end_site_indices": ends,
        "fk_topology": asdict(top), "mismatched_end_site_pairs": pick(mismatched_end_sites(nodes), "left", "right", "n_left", "n_right"),
        "world_up": world_up, "rest_forward": rest_forward, "rest_up": rest_up,
    }
    if partitions:
        groups = {g: [] for g in ("torso", "head", "left_arm", "right_arm", "left_leg", "right_leg", "other")}
        for r in body_partitions(nodes).orderBy("joint_idx").collect():
            groups[r["part"]].append(r["joint_idx"])
        out["body_partitions"] = groups
    return out
