"""Steps written on NumPy arrays of one whole clip, run as grouped Arrow kernels inside a pipeline.

A clip's frames meet in one task by a shuffle on clip_id, which steps that work in time use anyway. A kernel sees the
clip's streams as arrays with frames first and returns the same streams; gates and drawn values come in as
columns, and a generator, where the step asks for one, is seeded by (seed, epoch, step, clip).
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.functions.arrays import as_array, as_lists
from kinetra.schema import present

#: A clip of more frames than this is refused by name, before it fills a task: about half a GB of 100 joints in 6d.
MOST_FRAMES = 100_000


class ClipStep:
    """``fn(clip, **kwargs) -> dict`` over a clip's arrays; see ``clip_step``."""

    def __init__(self, fn: Callable, most_frames: int = MOST_FRAMES) -> None:
        self.fn, self.most_frames = fn, most_frames
        self.__name__ = getattr(fn, "__name__", type(fn).__name__)
        try:
            self.wants_rng = "rng" in inspect.signature(fn).parameters
        except (TypeError, ValueError):
            self.wants_rng = False

    def __call__(self, clip: dict[str, np.ndarray], **kwargs) -> dict[str, np.ndarray]:
        """The step on arrays, with its contract checked; for trainers and tests."""
        return checked(self.__name__, clip, self.fn(dict(clip), **kwargs))


def clip_step(fn: Callable | None = None, *, most_frames: int = MOST_FRAMES):
    """Marks ``fn(clip, **kwargs)`` as a step over arrays. ``clip`` has root_pos (F, 3), joint_rot (F, J, C), joint_pos (F, J, 3)
    and node_pos (F, N, 3), as far as the clip has them, in double. It returns a dict of the same streams, of any one
    number of frames (at least one). A parameter ``rng`` gets a NumPy generator. Streams other than root_pos and joint_rot need
    ``handles_streams``, as for every step."""
    return (lambda f: ClipStep(f, most_frames)) if fn is None else ClipStep(fn, most_frames)


def checked(name: str, before: dict[str, np.ndarray], after) -> dict[str, np.ndarray]:
    """What a step returned, as arrays of doubles; a step that broke the contract is refused by name."""
    if not isinstance(after, dict):
        raise TypeError(f"step {name} returned {type(after).__name__}, not a dict of streams")
    if set(after) != set(before):
        raise ValueError(f"step {name} changed the streams: dropped {sorted(set(before) - set(after))}, added {sorted(set(after) - set(before))}")
    out = {s: np.asarray(v, float) for s, v in after.items()}
    frames = {len(v) for v in out.values() if v.ndim}
    if len(frames) != 1 or any(v.ndim != before[s].ndim for s, v in out.items()) or not next(iter(frames)):
        raise ValueError(f"step {name} returned streams of shapes {({s: v.shape for s, v in out.items()})}")
    for s, v in out.items():
        if s != "joint_rot" and v.shape[-1] != 3:
            raise ValueError(f"step {name} returned {s} of width {v.shape[-1]}")
        if v.ndim == 3 and v.shape[1] != before[s].shape[1]:
            raise ValueError(f"step {name} changed the vertices of {s}")
    return out


def generator(seed: int, epoch: int, step: int, clip_id) -> np.random.Generator:
    """The same numbers for a clip wherever it is worked on."""
    own = int.from_bytes(hashlib.sha256(str(clip_id).encode()).digest()[:8], "little")
    return np.random.default_rng(np.random.SeedSequence([seed & 0xFFFFFFFFFFFFFFFF, epoch, step, own]))


def run(frames: DataFrame, step: ClipStep, *, gate: Column | None = None, kwargs: dict | None = None, seed: int | None = None, epoch: int = 0, number: int = 0) -> DataFrame:
    """``frames`` with the step applied to each clip whose ``gate`` is open. Values of ``kwargs`` may be columns, constant in a
    clip. Columns that are no streams stay with their frames; where a step changes the number of frames, every frame gets
    the values of the clip's first one."""
    kwargs = kwargs or {}
    if step.wants_rng and "rng" not in kwargs and seed is None:
        raise ValueError("draws need a seed")
    streams = present(frames.columns)
    drawn = {f"_kw_{n}": v for n, v in kwargs.items() if isinstance(v, Column)}
    fixed = {n: v for n, v in kwargs.items() if not isinstance(v, Column)}
    held = frames.withColumns({"_gate": F.lit(True) if gate is None else F.coalesce(gate, F.lit(False)), **drawn})
    params = [*drawn]  # columns themselves don't travel
    names, most, wants, label = frames.columns, step.most_frames, step.wants_rng and "rng" not in kwargs, step.__name__

    def kernel(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip_id = key[0].as_py()
        parts, n = [], 0
        for b in batches:
            n += b.num_rows
            if n > most:
                raise ValueError(f"clip {clip_id} has more than {most} frames, which step {label} takes at most")
            parts.append(b)
        table = pa.Table.from_batches(parts).sort_by("t")
        if not table.column("_gate")[0].as_py():
            yield from table.select(names).to_batches()
            return
        try:
            clip = {s: as_array(table.column(s)) for s in streams}
        except ValueError as e:
            raise ValueError(f"clip {clip_id}: {e}") from e
        own = {**fixed, **{c.removeprefix("_kw_"): table.column(c)[0].as_py() for c in params}}
        if wants:
            own["rng"] = generator(seed, epoch, number, clip_id)
        after = checked(label, clip, step.fn(dict(clip), **own))
        m = len(after[streams[0]])
        rest = table if m == n else table.take(pa.array(np.zeros(m, np.int64)))
        made = {s: as_lists(v) for s, v in after.items()} | {"t": pa.array(np.arange(m, dtype=np.int32))}
        for b in pa.table([made.get(c, rest.column(c)) for c in names], names=names).to_batches(max_chunksize=10_000):
            yield b

    kinds = dict(frames.dtypes)
    schema = ", ".join(f"`{c}` {'int' if c == 't' else kinds[c]}" for c in names)
    return held.groupBy("clip_id").applyInArrow(kernel, schema)
