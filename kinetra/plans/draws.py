"""Chance as data: every random number is a function of (seed, epoch, clip, step, place).

Native draws are hashes in the plan, so they need no order and no state. Exact draws run NumPy's generator
seeded by (seed, epoch, clip number), one clip at a time, for runs that must repeat such a generator's numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.operators.temporal import portable_hash, unit_hash


class Draws:
    """Columns of random numbers for one step of one epoch; ``clip_id`` and ``t`` are taken from the row. ``portable``
    numbers are hashed by md5, so that other engines can repeat them, at some cost."""

    def __init__(self, seed: int | None, epoch: int = 0, step: int = 0, portable: bool = False) -> None:
        if seed is None:
            raise ValueError("draws need a seed")
        self.key = [F.lit(int(seed)), F.lit(int(epoch)), F.lit(int(step))]
        self.hash = portable_hash if portable else unit_hash
        if not portable:
            self.seed_of = self._seed_of

    def unit(self, *place: Column) -> Column:
        return self.hash(*self.key, F.col("clip_id").cast("string"), *place)

    def gate(self, prob: float) -> Column:
        return self.unit(F.lit("gate")) < prob

    def uniform(self, low: float, high: float, name: str = "value") -> Column:
        """One number per clip."""
        return low + (high - low) * self.unit(F.lit(name))

    def normal(self, what: str, v: Column, c: Column) -> Column:
        """A standard normal number per frame and place (Box-Muller)."""
        place = (F.lit(what), F.col("t").cast("long"), v.cast("long"), c.cast("long"))
        a, b = self.unit(F.lit("a"), *place), self.unit(F.lit("b"), *place)
        return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * math.pi * b)

    def _seed_of(self, side: str, what: str) -> Column:
        """The hash that ``normal`` goes on from with a frame's vertex and channel; ``side`` is a or b of its two uniforms."""
        return F.xxhash64(*self.key, F.col("clip_id").cast("string"), F.lit(side), F.lit(what), F.col("t").cast("long"))

    def pick(self, i: Column) -> Column:
        """One uniform per place of a sampled clip."""
        return self.unit(F.lit("pick"), i.cast("long"))

    def frame(self) -> Column:
        """One uniform per frame."""
        return self.unit(F.lit("frame"), F.col("t").cast("long"))


def generator(seed: int, epoch: int, index: int) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence([seed, epoch, index]))


def exact_draws(clips: DataFrame, seed: int, epoch: int, spec: list[tuple]) -> DataFrame:
    """``clips(clip_id, idx, n_frames)`` -> ``clip_id, k, place, value``: the numbers that a generator of the clip
    gives, in the order of ``spec``: ("gate",), ("uniform", low, high), ("normal", per_frame) or ("random",), the
    last two with per_frame numbers, or one, for each frame. ``k`` numbers the entries of ``spec``."""
    if seed is None:
        raise ValueError("draws need a seed")

    def run(batches):
        for b in batches:
            out = []
            for clip, idx, n in zip(*(b.column(c).to_pylist() for c in ("clip_id", "idx", "n_frames"))):
                rng = generator(seed, epoch, idx)
                for k, (kind, *args) in enumerate(spec):
                    if kind == "gate":
                        values = [rng.random()]
                    elif kind == "uniform":
                        values = [rng.uniform(*args)]
                    elif kind == "random":
                        values = rng.random(n)
                    elif kind == "normal":
                        values = rng.normal(size=n * args[0])
                    else:
                        raise ValueError(f"unknown draw {kind!r}")
                    out += [(str(clip), k, i, float(v)) for i, v in enumerate(values)]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.float64()))], ["clip_id", "k", "place", "value"])

    return clips.select("clip_id", "idx", "n_frames").mapInArrow(run, "clip_id string, k int, place int, value double")


class ExactDraws:
    """The numbers of a clip's NumPy generator for one step, as columns that ``with_exact_draws`` has added to the frames."""

    def __init__(self, step: int, per_vertex: int = 0) -> None:
        self.step, self.per_vertex, self.ranges = step, per_vertex, []

    def gate(self, prob: float) -> Column:
        return F.col("_draws")[self.step]["open"]

    def uniform(self, low: float, high: float, name: str = "value") -> Column:
        self.ranges.append((float(low), float(high)))
        return F.col("_draws")[self.step]["params"][len(self.ranges) - 1]

    def normal(self, what: str, v: Column, c: Column) -> Column:
        """``angle`` numbers stand after all ``axis`` numbers of a frame."""
        held = F.col("_noise")
        if what == "angle":
            return held[F.floor(F.size(held) * 3 / 4).cast("int") + v]
        return held[v * 3 + c]

    def frame(self) -> Column:
        return F.col("_noise")[0]


def steps_draws(clips: DataFrame, seed: int, epoch: int, steps: list[dict]) -> DataFrame:
    """``clips(clip_id, idx, n_frames, n_joints, n_nodes)`` -> ``clip_id, draws, noise``: what one generator per clip gives
    to a pipeline's steps, in the order in which they ask.

    Every step asks for its gate. One that opens asks for its parameters (``ranges``), then for its noise: ``kind`` is
    None, rotation, root, joint, node or frame. ``factor``, a number or the place of a parameter, changes the frames of
    the steps after it. ``draws`` has a struct (open, params) for each step; ``noise`` has frames of numbers."""
    kind = pa.list_(pa.struct([("open", pa.bool_()), ("params", pa.list_(pa.float64()))]))
    cube = pa.list_(pa.list_(pa.list_(pa.float64())))

    def numbers(rng: np.random.Generator, what: str | None, n: int, joints: int, nodes: int) -> list:
        if what == "rotation":
            axis, angle = rng.normal(size=(n, joints, 3)), rng.normal(size=(n, joints))
            return np.concatenate([axis.reshape(n, -1), angle], 1).tolist()
        if what == "frame":
            return rng.random(n)[:, None].tolist() if n > 1 else [[1.0]] * n
        return rng.normal(size=(n, {"root": 1, "joint": joints, "node": nodes}[what] * 3)).tolist() if what else []

    def run(batches):
        for b in batches:
            out = []
            for clip, idx, n, joints, nodes in zip(*(b.column(c).to_pylist() for c in ("clip_id", "idx", "n_frames", "n_joints", "n_nodes"))):
                rng, draws, noise = generator(seed, epoch, idx), [], []
                for s in steps:
                    opened = bool(rng.random() < s["prob"])
                    params = [float(rng.uniform(*r)) for r in s["ranges"]] if opened else [0.0] * len(s["ranges"])
                    draws.append({"open": opened, "params": params})
                    noise.append(numbers(rng, s["kind"] if opened else None, n, joints or 0, nodes or 0))
                    if opened and s["factor"] is not None and n > 1:
                        factor = params[s["factor"][1]] if isinstance(s["factor"], tuple) else s["factor"]
                        n = max(2, round(n / factor))
                out.append((str(clip), draws, noise))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), kind, cube))], ["clip_id", "draws", "noise"])

    return clips.select("clip_id", "idx", "n_frames", "n_joints", "n_nodes").mapInArrow(run, "clip_id string, draws array<struct<open: boolean, params: array<double>>>, noise array<array<array<double>>>")
