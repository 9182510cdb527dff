"""Vocabulary of a clip: streams, index spaces, widths, and the refusals that need no data.

A clip is kept as frame rows ``(clip_id, t, root_pos, joint_rot, joint_pos, node_pos)``: ``t`` counts from 0
without gaps, ``root_pos`` is array<double> of 3, the others are array<array<double>> with one inner array per
joint or node. Absent streams are absent columns. The representation, the Euler orders and the position
centering are properties of a table of clips and are passed beside it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

STREAMS = ("root_pos", "joint_rot", "joint_pos", "node_pos")
DERIVED = {"joint_vel": ("joint_pos", 1), "joint_acc": ("joint_pos", 2), "node_vel": ("node_pos", 1), "node_acc": ("node_pos", 2)}
CENTERINGS = ("world", "skeleton", "first")
WIDTHS = {"euler": 3, "quat": 4, "6d": 6, "axisangle": 3, "rotmat": 9}
LAYOUTS = ("flat", "tvc", "ctv")
TEMPORAL = ("pad", "crop", "resample", "resample_deterministic")
EULER_ORDERS = ("XYZ", "XZY", "YXZ", "YZX", "ZXY", "ZYX")
DEFAULT_STREAMS = ("root_pos", "joint_rot")
#: Columns that are stored beside a clip and that augmentation does not keep in step.
STATIC_FEATURES = ("joint_quats", "velocities", "foot_contacts")


def base_of(stream: str) -> str:
    return DERIVED[stream][0] if stream in DERIVED else stream


def space_of(stream: str) -> str:
    """root, joint or node: what the inner index of the stream counts."""
    base = base_of(stream)
    return {"root_pos": "root", "joint_rot": "joint", "joint_pos": "joint", "node_pos": "node"}[base]


def width_of(stream: str, representation: str = "6d") -> int:
    return WIDTHS[require_representation(representation)] if stream == "joint_rot" else 3


def require_representation(name: str, allowed=tuple(WIDTHS)) -> str:
    if name not in allowed:
        raise ValueError(f"unknown representation {name!r}; one of {', '.join(allowed)} is asked for")
    return name


def require_centering(name: str | None) -> str | None:
    if name is not None and name not in CENTERINGS:
        raise ValueError(f"unknown position centering {name!r}; one of {', '.join(CENTERINGS)} or None is asked for")
    return name


def present(columns) -> list[str]:
    return [s for s in STREAMS if s in columns]


def check_streams(streams, columns=None, centering: str | None = "world", need_positions_centred: bool = True) -> None:
    """Refuses unknown, repeated, empty, missing or mixed streams, and derived ones of unknown centering."""
    streams = list(streams)
    if not streams:
        raise ValueError("at least one stream is asked for")
    known = (*STREAMS, *DERIVED)
    if bad := [s for s in streams if s not in known]:
        raise ValueError(f"unknown streams {bad}; known are {', '.join(known)}")
    if len(set(streams)) < len(streams):
        raise ValueError(f"a stream is named twice in {streams}")
    if {space_of(s) for s in streams} >= {"joint", "node"}:
        raise ValueError("joint and node streams count different things and can't share a vertex axis")
    if columns is not None and (lost := [s for s in streams if base_of(s) not in columns]):
        raise ValueError(f"the clips have no {', '.join(base_of(s) for s in lost)}")
    if need_positions_centred and any(s in DERIVED for s in streams) and centering is None:
        raise ValueError("derived streams need clips of known position centering")


def split_root(streams) -> tuple[bool, list[str]]:
    return "root_pos" in streams, [s for s in streams if s != "root_pos"]


def channel_count(pack_root: bool, widths) -> int:
    """Channels of a graph layout: vertex 0 holds a position, so there are 3 at least with a root."""
    return max(3 if pack_root else 0, sum(widths))


def check_root_channels(root_channels: int, channels: int | None = None) -> None:
    if not isinstance(root_channels, int) or root_channels < 1 or (channels is not None and root_channels > channels):
        raise ValueError(f"root_channels must be between 1 and the channel count, not {root_channels}")


@dataclass(frozen=True)
class FlatLayout:
    """Column ranges of a flat row: block name -> (start, end)."""

    blocks: dict[str, tuple[int, int]]
    total_dim: int

    def __getitem__(self, name: str) -> tuple[int, int]:
        return self.blocks[name]

    def __contains__(self, name: str) -> bool:
        return name in self.blocks

    def slice(self, name: str) -> slice:
        return slice(*self.blocks[name])


@dataclass(frozen=True)
class GraphLayout:
    """Geometry of a vertex layout: channel ranges of the streams, and where the first vertex is."""

    num_channels: int
    num_vertices: int
    packs_root: bool
    first_vertex: int
    channel_ranges: dict[str, tuple[int, int]] = field(default_factory=dict)

    def shape(self, frames: int, layout: str = "ctv") -> tuple[int, int, int]:
        if layout == "ctv":
            return self.num_channels, frames, self.num_vertices
        if layout == "tvc":
            return frames, self.num_vertices, self.num_channels
        raise ValueError("a graph layout is ctv or tvc")


def _counts(streams, num_joints: int, num_nodes: int | None) -> dict[str, int]:
    out = {}
    for s in streams:
        space = space_of(s)
        if space == "node" and num_nodes is None:
            raise ValueError("node streams need num_nodes")
        out[s] = {"root": 1, "joint": num_joints, "node": num_nodes}[space]
    return out


def describe_flat(num_joints: int, representation: str = "6d", include_root: bool = True, streams=None, num_nodes: int | None = None) -> FlatLayout:
    streams = list(streams) if streams is not None else [*(["root_pos"] if include_root else []), "joint_rot"]
    check_streams(streams)
    at, blocks = 0, {}
    for s, n in _counts(streams, num_joints, num_nodes).items():
        size = n * width_of(s, representation)
        blocks[s] = (at, at + size)
        at += size
    return FlatLayout(blocks, at)


def describe_graph(num_joints: int, representation: str = "6d", streams=None, num_nodes: int | None = None) -> GraphLayout:
    streams = list(streams) if streams is not None else list(DEFAULT_STREAMS)
    check_streams(streams)
    root, rest = split_root(streams)
    at, ranges = 0, {}
    for s in rest:
        ranges[s] = (at, at + width_of(s, representation))
        at = ranges[s][1]
    vertices = max([0, *(n for s, n in _counts(streams, num_joints, num_nodes).items() if s != "root_pos")])
    return GraphLayout(channel_count(root, [b - a for a, b in ranges.values()]), vertices + root, root, int(root), ranges)


def parse_axis(token: str) -> tuple[int, int]:
    """'+x' .. '-z' -> (axis number, sign)."""
    if not isinstance(token, str) or len(token) != 2 or token[0] not in "+-" or token[1] not in "xyz":
        raise ValueError(f"an axis is written like '+y', not {token!r}")
    return "xyz".index(token[1]), 1 if token[0] == "+" else -1


def check_euler_order(order: str) -> str:
    if sorted(order) != ["X", "Y", "Z"]:
        raise ValueError(f"an Euler order has each of X, Y and Z once, not {order!r}")
    return order


def check_probability(p: float) -> float:
    if not 0 <= p <= 1:
        raise ValueError(f"a probability is between 0 and 1, not {p}")
    return p


def check_sigma(sigma) -> None:
    if isinstance(sigma, (int, float)) and sigma < 0:
        raise ValueError(f"sigma can't be negative: {sigma}")


def check_drop_rate(rate) -> None:
    if isinstance(rate, (int, float)) and not 0 <= rate < 1:
        raise ValueError(f"a drop rate is at least 0 and under 1, not {rate}")


def check_factor(factor) -> None:
    if isinstance(factor, (int, float)) and factor <= 0:
        raise ValueError(f"a speed factor is over 0, not {factor}")
