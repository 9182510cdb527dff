"""Augmentation pipelines: steps with a probability each, compiled into one plan for all clips of an epoch.

The plan tracks which representation joint_rot is in and converts only when the next step can't work on it,
so a chain of steps pays for two conversions at most. All preconditions are checked before anything runs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.functions.rotations import convert_joints
from kinetra.operators import augment
from kinetra.plans import clipsteps, fused
from kinetra.plans.draws import Draws, ExactDraws, steps_draws
from kinetra.schema import STREAMS, check_drop_rate, check_factor, check_probability, check_sigma, present, require_representation

_SUPPORT = "_kinetra_streams"


def handles_streams(*streams: str) -> Callable:
    """Declares which streams a step of one's own keeps right; others in the clips are then refused."""
    if bad := [s for s in streams if s not in STREAMS]:
        raise ValueError(f"unknown streams {bad}")

    def mark(fn):
        setattr(fn, _SUPPORT, frozenset(streams))
        return fn

    return mark


def _unwrapped(fn: Callable) -> Callable:
    while isinstance(fn, functools.partial):
        fn = fn.func
    return fn


def stream_support(fn: Callable) -> frozenset | None:
    return getattr(_unwrapped(fn), _SUPPORT, None)


def _gated_draw(fn, draws_as: str):
    return lambda frames, draws, **kw: fn(frames, **{draws_as: draws.normal if draws_as == "draw" else draws}, **kw)


@dataclass(frozen=True)
class _Known:
    run: Callable
    native: tuple[str, ...]  # representations it works on as they are
    streams: tuple[str, ...] = STREAMS
    keeps_rows: bool = True


_RUN = {
    augment.rotate_vertical: _Known(lambda f, d, **k: augment.rotate_vertical(f, **k), ("quat", "6d")),
    augment.mirror: _Known(lambda f, d, **k: augment.mirror(f, **k), ("quat", "6d")),
    augment.rotation_noise: _Known(_gated_draw(augment.rotation_noise, "draw"), ("quat",)),
    augment.root_noise: _Known(_gated_draw(augment.root_noise, "draw"), ("quat", "6d", "euler", "axisangle", "rotmat")),
    augment.joint_position_noise: _Known(_gated_draw(augment.joint_position_noise, "draw"), ("quat",), ("root_pos", "joint_pos")),
    augment.node_position_noise: _Known(_gated_draw(augment.node_position_noise, "draw"), ("quat",), ("root_pos", "node_pos")),
    augment.speed: _Known(lambda f, d, **k: augment.speed(f, **k), ("quat",), keeps_rows=False),
    augment.dropout: _Known(lambda f, d, **k: augment.dropout(f, draw=d.frame(), **k), ("quat",)),
}


@dataclass(frozen=True)
class Step:
    """``fn(frames, **kwargs)``, or a ``clip_step`` over arrays, applied to a clip with probability ``prob``. A keyword that is a function of the
    step's ``Draws`` is called for the column of its per-clip value."""

    fn: Callable
    prob: float = 1.0
    kwargs: dict = field(default_factory=dict)

    @property
    def name(self) -> str:
        fn = _unwrapped(self.fn)
        return getattr(fn, "__name__", type(fn).__name__)


def _step(x) -> Step:
    if isinstance(x, Step):
        out = x
    else:
        if not isinstance(x, (tuple, list)) or not 2 <= len(x) <= 3:
            raise ValueError("a step is (function, probability) or (function, probability, keywords)")
        out = Step(x[0], x[1], dict(x[2]) if len(x) == 3 else {})
    if not callable(out.fn):
        raise ValueError(f"a step's first part is a function, not {out.fn!r}")
    check_probability(out.prob)
    return out


class Pipeline:
    """``fused`` compiles runs of steps that look at single frames into one Arrow pass (see ``plans.fused``) where draws are not
    ``portable``; results are the same either way."""

    def __init__(self, steps, *, representation: str | None = None, euler_orders=None, share_quaternions: bool = True, fused: bool = True) -> None:
        self.steps = [_step(s) for s in steps]
        self.fused = fused
        self.representation, self.euler_orders, self.share = representation, euler_orders, share_quaternions
        told = {s.kwargs["representation"] for s in self.steps if s.fn in _RUN and s.kwargs.get("representation")}
        if representation:
            told.add(require_representation(representation))
        if len(told) > 1:
            raise ValueError(f"steps disagree about the representation: {', '.join(sorted(told))}")
        self.told = next(iter(told), None)
        for s in self.steps:
            check_sigma(s.kwargs.get("sigma"))
            check_drop_rate(s.kwargs.get("rate"))
            check_factor(s.kwargs.get("factor"))

    def check(self, columns, centering: str | None = None) -> None:
        """Every step's preconditions on clips with these columns."""
        have = set(present(columns))
        if "joint_rot" in have and self.told is None and any(s.fn in _RUN for s in self.steps):
            raise ValueError("the pipeline needs the representation of joint_rot")
        for s in self.steps:
            support = frozenset(_RUN[s.fn].streams) if s.fn in _RUN else stream_support(s.fn)
            if support is None and have - {"root_pos", "joint_rot"}:
                raise ValueError(f"{s.name} does not say that it handles {', '.join(sorted(have - {'root_pos', 'joint_rot'}))}")
            if support is not None and have - support:
                raise ValueError(f"{s.name} does not handle {', '.join(sorted(have - support))}")
            moved = have & {"joint_pos", "node_pos"}
            if s.fn is augment.rotation_noise and moved and "refresh" not in s.kwargs:
                raise ValueError("rotation noise on clips with positions needs a skeleton to refresh them by")
            if s.fn is augment.root_noise and moved and (s.kwargs.get("centering") or centering) is None:
                raise ValueError("root noise on clips with positions needs their centering")
            if s.fn is augment.mirror and s.kwargs.get("lr_joint_pairs") is None and have & {"joint_rot", "joint_pos"}:
                raise ValueError("mirror needs lr_joint_pairs for joint streams")

    def apply(self, frames: DataFrame, seed: int | None, epoch: int = 0, centering: str | None = None, portable: bool = False, generators: DataFrame | None = None, exact: DataFrame | None = None) -> DataFrame:
        """The augmented frames; the same (seed, epoch, clip) gives the same result in any partitioning. ``portable``: see
        ``Draws``. With ``generators(clip_id, idx)``, numbers are those of NumPy generators seeded by (seed, epoch, idx),
        one per clip; steps of one's own get none. ``exact`` is a table of such draws made before (``exact_draws``)."""
        self.check(frames.columns, centering)
        out, now = augment.as_double(frames), self.told
        streams = present(frames.columns)
        if generators is not None and exact is None:
            exact = self.exact_draws(out, generators, seed, epoch)
        if exact is not None:
            key = exact.withColumnRenamed("clip_id", "_clip").withColumnRenamed("draws", "_draws")
            out = out.join(key.select("_clip", "_draws"), F.col("clip_id").cast("string") == F.col("_clip")).drop("_clip")

        program = fused.Program() if self.fused and not portable else None
        flush = program.flush if program is not None else lambda df: df

        def to(df: DataFrame, target: str) -> DataFrame:
            nonlocal now
            if "joint_rot" in streams and now != target:
                if program is not None:
                    fused.convert(program, now, target, self.euler_orders)
                else:
                    df = df.withColumn("joint_rot", convert_joints(F.col("joint_rot"), now, target, self.euler_orders))
                now = target
            return df

        for k, s in enumerate(self.steps):
            draws = Draws(seed, epoch, k, portable) if exact is None else ExactDraws(k)
            noisy = exact is not None and _NOISE.get(s.fn)
            if noisy:
                out = _with_noise(flush(out), exact, k)
            kw = {n: v(draws) if callable(v) and n != "refresh" else v for n, v in s.kwargs.items()}
            gate = draws.gate(s.prob)
            if s.fn in _RUN:
                known = _RUN[s.fn]
                if self.told and now not in known.native:
                    out = to(out, "quat")
                if s.fn in (augment.rotate_vertical, augment.mirror, augment.rotation_noise, augment.speed, augment.dropout):
                    kw["representation"] = now
                    kw.setdefault("euler_orders", self.euler_orders)
                if s.fn is augment.root_noise:
                    kw.setdefault("centering", centering)
                if s.fn is augment.mirror and kw.get("lr_node_pairs") is None and "node_pos" in streams:
                    raise ValueError("mirror needs lr_node_pairs for node_pos")
                if program is not None and s.fn in _FUSED and not (s.fn is augment.rotation_noise and augment.positions(out)):
                    _FUSED[s.fn](program, gate, now, **{n: v for n, v in kw.items() if n != "refresh"}, **({"draws": draws} if s.fn in _NOISE else {}))
                elif program is not None and s.fn is augment.speed:
                    out = augment.speed_pairs(flush(out), F.when(gate, kw["factor"]).otherwise(F.lit(1.0)))
                    fused.blend(program, "joint_rot" in streams)
                elif not known.keeps_rows:
                    out = flush(out)
                    factor = kw["factor"] if not isinstance(kw["factor"], (int, float)) else F.lit(float(kw["factor"]))
                    kw["factor"] = F.when(gate, factor).otherwise(F.lit(1.0))
                    out = known.run(out, draws, **kw)
                else:
                    out = _gated(flush(out), streams, gate, lambda f: known.run(f, draws, **kw))
                if not self.share:
                    out = to(out, self.told) if self.told else out
            elif isinstance(base := _unwrapped(s.fn), clipsteps.ClipStep):
                out = to(out, self.told) if self.told else out
                kw = {**(s.fn.keywords if isinstance(s.fn, functools.partial) else {}), **kw}
                out = clipsteps.run(flush(out), base, gate=gate, kwargs=kw, seed=seed, epoch=epoch, number=k)
            else:
                out = to(out, self.told) if self.told else out
                out = _gated(flush(out), streams, gate, lambda f: s.fn(f, **kw))
            if noisy:
                out = flush(out).drop("_noise")
        if self.told:
            out = to(out, self.told)
        return augment.as_float(flush(out).drop("_draws"), frames)

    def exact_draws(self, frames: DataFrame, generators: DataFrame, seed: int | None, epoch: int) -> DataFrame:
        """``clip_id, draws, noise``: what each clip's generator gives to the steps. Write it where it is read more than once."""
        if seed is None:
            raise ValueError("draws need a seed")
        steps = []
        for k, s in enumerate(self.steps):
            told = ExactDraws(k)
            factor = s.kwargs.get("factor")
            for n, v in s.kwargs.items():
                if callable(v) and n != "refresh":
                    if n == "factor" and s.fn is augment.speed:
                        factor = ("param", len(told.ranges))
                    v(told)
            kind = _NOISE.get(s.fn)
            quiet = kind in ("root", "joint", "node") and s.kwargs.get("sigma") == 0 or kind == "frame" and s.kwargs.get("rate") == 0
            steps.append({"prob": s.prob, "ranges": told.ranges, "kind": None if quiet else kind, "factor": factor if s.fn is augment.speed else None})
        size = lambda c: (F.max(F.size(c)) if c in frames.columns else F.lit(0)).cast("int")
        joints = next((c for c in ("joint_rot", "joint_pos") if c in frames.columns), "joint_rot")
        clips = frames.groupBy("clip_id").agg(F.count("*").cast("int").alias("n_frames"), size(joints).alias("n_joints"), size("node_pos").alias("n_nodes"))
        return steps_draws(clips.join(generators.select("clip_id", "idx"), "clip_id"), seed, epoch, steps)

    def explain(self, clips: DataFrame, seed: int | None, epoch: int = 0, portable: bool = False, exact: DataFrame | None = None) -> DataFrame:
        """``clip_id, step, name, applied, params map<string, string>``: what ``apply`` does to each clip, with ``exact`` by the
        same table of generators' draws."""
        rows = None
        if exact is not None:
            clips = clips.join(exact.select(F.col("clip_id").alias("_clip"), F.col("draws").alias("_draws")), F.col("clip_id").cast("string") == F.col("_clip")).drop("_clip")
        for k, s in enumerate(self.steps):
            draws = Draws(seed, epoch, k, portable) if exact is None else ExactDraws(k)
            params = [x for n, v in s.kwargs.items() if n != "refresh" and (isinstance(v, (int, float, str, bool)) or callable(v)) for x in (F.lit(n), (v(draws) if callable(v) else F.lit(v)).cast("string"))]
            held = F.create_map(*params) if params else F.create_map().cast("map<string,string>")
            row = clips.select("clip_id", F.lit(k).alias("step"), F.lit(s.name).alias("name"), draws.gate(s.prob).alias("applied"), F.when(draws.gate(s.prob), held).alias("params"))
            rows = row if rows is None else rows.unionByName(row)
        return rows

    @classmethod
    def standard(cls, skeleton_info: dict, *, representation: str = "6d", up_axis: str = "+y", lateral_axis: str = "+x", rotate_angle_range=(-math.pi, math.pi), mirror_prob: float = 0.5, noise_sigma: float = math.radians(1), position_noise_sigma: float | None = None, position_space: str | None = None, speed_factor_range=(0.8, 1.2), degrees: bool = False, refresh=None) -> Pipeline:
        """Rotate, mirror, rotation noise (or position noise), speed."""
        pairs = {"lr_joint_pairs": [tuple(p) for p in skeleton_info["lr_pairs"]], "lr_node_pairs": [tuple(p) for p in skeleton_info["node_lr_pairs"]]}
        if position_noise_sigma is not None and noise_sigma:
            raise ValueError("position noise and rotation noise exclude each other: set noise_sigma to 0")
        if position_noise_sigma is not None and position_space not in ("joint", "node"):
            raise ValueError("position noise needs position_space: joint or node")
        steps = [
            Step(augment.rotate_vertical, 1.0, {"angle": lambda d: d.uniform(*rotate_angle_range, "angle"), "up_axis": up_axis, "degrees": degrees}),
            Step(augment.mirror, mirror_prob, {"lateral_axis": lateral_axis, **pairs}),
        ]
        if position_noise_sigma is not None:
            steps.append(Step(augment.joint_position_noise if position_space == "joint" else augment.node_position_noise, 1.0, {"sigma": position_noise_sigma}))
        elif noise_sigma:
            steps.append(Step(augment.rotation_noise, 1.0, {"sigma": noise_sigma, "degrees": degrees, **({"refresh": refresh} if refresh else {})}))
        steps.append(Step(augment.speed, 1.0, {"factor": lambda d: d.uniform(*speed_factor_range, "factor")}))
        return cls(steps, representation=representation, euler_orders=skeleton_info.get("euler_orders"))


#: Steps that can be part of a fused pass.
_FUSED = {augment.rotate_vertical: fused.rotate_vertical, augment.mirror: fused.mirror, augment.rotation_noise: fused.rotation_noise, augment.root_noise: fused.root_noise}
#: Which noise a step draws from a generator.
_NOISE = {augment.rotation_noise: "rotation", augment.root_noise: "root", augment.joint_position_noise: "joint", augment.node_position_noise: "node", augment.dropout: "frame"}


def _with_noise(frames: DataFrame, exact: DataFrame, step: int) -> DataFrame:
    """Frames with ``_noise``, the step's numbers of each; zeros where the gate is closed."""
    rows = exact.select(F.col("clip_id").alias("_clip"), F.posexplode(F.col("noise")[step]).alias("_t", "_noise"))
    zeros = F.array_repeat(F.lit(0.0), 4 * F.greatest(F.lit(1), F.lit(1), *(F.size(s) for s in present(frames.columns) if s != "root_pos")))
    joined = frames.join(rows, (F.col("clip_id").cast("string") == F.col("_clip")) & (F.col("t") == F.col("_t")), "left")
    return joined.withColumn("_noise", F.coalesce("_noise", zeros)).drop("_clip", "_t")


def _gated(frames: DataFrame, streams, gate, step) -> DataFrame:
    """The step's result where the gate is open, the old values elsewhere; streams may not come or go."""
    held = frames.withColumns({f"_old_{s}": F.col(s) for s in streams} | {"_gate": gate})
    new = step(held)
    if set(present(new.columns)) != set(streams):
        raise ValueError("a step may neither add nor drop streams")
    return new.withColumns({s: F.when(F.col("_gate"), F.col(s)).otherwise(F.col(f"_old_{s}")) for s in streams}).drop("_gate", *(f"_old_{s}" for s in streams))
