"""Training feeds: one plan per epoch gives every clip's item; batches are padded and masked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinetra.functions.rotations import convert_joints
from kinetra.operators import clips as clip_tables
from kinetra.operators import skeleton
from kinetra.operators.packing import clip_arrays, flat_row, to_ctv, vertex_rows
from kinetra.operators.temporal import apply_temporal, center_root, derive
from kinetra.plans import fused
from kinetra.plans.build import axis_number, with_axes
from kinetra.plans.draws import Draws
from kinetra.plans.pipeline import Pipeline
from kinetra.schema import DEFAULT_STREAMS, LAYOUTS, TEMPORAL, channel_count, check_streams, present, require_centering, require_representation, space_of, split_root, width_of
from kinetra.sources import bvh
from kinetra.sources.shared import written


#: Items that are ranked in one group, about.
GROUP = 100_000


class MotionFeed:
    """Items of a table of clips, as a function of the epoch.

    ``clips(clip_id, label?, name?)`` is optional, and says which clips there are: one without frames has an item of length 0,
    padded like others. ``ids`` names the clips where neither table should be read for that; ``frames`` holds the streams. The order of work is fixed:
    centre, convert, augment, derive, standardise length, pack, cast to float. Deriving comes before any change
    of length, so that a difference is always one of neighbouring frames.
    """

    def __init__(self, frames: DataFrame, clips: DataFrame | None = None, *, target_length: int | None = None, augmentation: Pipeline | None = None, seed: int | None = None, center_root: bool = False, temporal: str = "pad", layout: str = "flat", streams=DEFAULT_STREAMS, position_centering: str | None = None, source_repr: str | None = None, target_repr: str | None = None, euler_orders=None, portable: bool = False, generators: DataFrame | None = None, ids: DataFrame | None = None) -> None:
        if layout not in LAYOUTS:
            raise ValueError(f"unknown layout {layout!r}")
        if temporal not in TEMPORAL:
            raise ValueError(f"unknown temporal rule {temporal!r}")
        if temporal != "pad" and target_length is None:
            raise ValueError(f"{temporal} needs a target length")
        require_centering(position_centering)
        if any(s in frames.columns for s in ("joint_pos", "node_pos")) and position_centering is None and center_root:
            raise ValueError("clips with positions need a known position centering to be centred")
        check_streams(streams, frames.columns, position_centering)
        if (source_repr is None) != (target_repr is None):
            raise ValueError("source_repr and target_repr go together")
        for r in (source_repr, target_repr):
            if r is not None:
                require_representation(r)
        if "euler" in (source_repr, target_repr) and source_repr != target_repr and euler_orders is None:
            raise ValueError("Euler angles need their orders")
        if augmentation is not None:
            augmentation.check(frames.columns, position_centering)
        self.frames, self.clips = frames, clips
        self.ids = ids if ids is not None else (frames if clips is None else clips).select("clip_id").distinct()
        self._exact: dict[int, DataFrame] = {}
        self._sizes: tuple[int, int] | None = None
        self.length, self.augmentation, self.seed, self.center = target_length, augmentation, seed, center_root
        self.temporal, self.layout, self.streams, self.centering = temporal, layout, list(streams), position_centering
        self.source, self.target, self.orders, self.portable, self.generators = source_repr, target_repr, euler_orders, portable, generators
        self.representation = target_repr or (augmentation.told if augmentation else None) or source_repr or "6d"

    def items(self, epoch: int = 0) -> DataFrame:
        """``clip_id, length, data`` and the columns of clips: a row per clip, of array<array<float>> in flat
        layout, array<array<array<float>>> in the others."""
        f = self.frames
        if self.center:
            f = center_root(f, self.centering)
        if self.source and self.source != self.target:
            if isinstance(self.orders, Column):
                f = f.withColumn("joint_rot", convert_joints(F.col("joint_rot"), self.source, self.target, self.orders))
            else:
                f = fused.convert_frames(f, self.source, self.target, self.orders)
        if self.augmentation is not None:
            f = self.augmentation.apply(f, self.seed, epoch, self.centering, self.portable, exact=self.exact(epoch))
        f = derive(f, self.streams).select("clip_id", "t", *self.streams)
        picks = None if self.seed is None else Draws(self.seed, epoch, -2, self.portable).pick
        f = apply_temporal(f, self.length, self.temporal, picks)
        data = flat_row(self.streams) if self.layout == "flat" else vertex_rows(self.streams, self.representation)
        items = clip_arrays(f.select("clip_id", "t", "length", data.alias("data")), "length")
        if self.layout == "ctv":
            items = items.withColumn("data", to_ctv(F.col("data")))
        items = items.withColumn("data", F.col("data").cast("array<array<float>>" if self.layout == "flat" else "array<array<array<float>>>"))
        if self.clips is None:
            return items
        every = self.clips.join(items, "clip_id", "left").withColumns({"length": F.coalesce("length", F.lit(0)), "data": F.coalesce("data", self._nothing())})
        return every.select("clip_id", "length", "data", *(c for c in self.clips.columns if c not in ("clip_id", "length", "data")))

    def _nothing(self) -> Column:
        """The data of a clip without frames. Its width is that of the first frame at hand."""
        if self._sizes is None:
            sizes = {space: next((F.size(s) for s in present(self.frames.columns) if s.startswith(space)), F.lit(0)) for space in ("joint", "node")}
            row = self.frames.select(*(c.alias(n) for n, c in sizes.items())).first()
            self._sizes = (row["joint"], row["node"]) if row else (0, 0)
        count = {"root": 1, "joint": self._sizes[0], "node": self._sizes[1]}
        width = lambda s: 3 if s == "root_pos" else width_of(s, self.representation)
        zeros = lambda n, what: F.array_repeat(what, n)
        t, zero = self.length or 0, F.lit(0.0).cast("float")
        if self.layout == "flat":
            return zeros(t, zeros(sum(count[space_of(s)] * width(s) for s in self.streams), zero))
        root, rest = split_root(self.streams)
        c, v = channel_count(root, [width(s) for s in rest]), int(root) + (count[space_of(rest[0])] if rest else 0)
        return zeros(c, zeros(t, zeros(v, zero))) if self.layout == "ctv" else zeros(t, zeros(v, zeros(c, zero)))

    def exact(self, epoch: int) -> DataFrame | None:
        """The draws of the clips' generators in an epoch: one table, written once, that items and explanations both read."""
        if self.generators is None or self.augmentation is None:
            return None
        if epoch not in self._exact:
            self._exact[epoch] = written(self.augmentation.exact_draws(self.frames, self.generators, self.seed, epoch), "draws")
        return self._exact[epoch]

    def order(self, epoch: int) -> Column:
        """The number in [0, 1) by which a clip stands in an epoch."""
        return Draws(self.seed or 0, epoch, -1, self.portable).unit(F.lit("order"))

    def explain_augmentation(self, epoch: int = 0) -> DataFrame:
        """The draws of every clip in an epoch; without a seed there is nothing to repeat."""
        if self.augmentation is None or self.seed is None:
            raise ValueError("draws can be told again only for a seeded feed with augmentation")
        return self.augmentation.explain(self.ids, self.seed, epoch, self.portable, self.exact(epoch))

    def shuffled(self, epoch: int, batch_size: int) -> DataFrame:
        """Items with ``batch_id``: clips in an order drawn anew for each epoch."""
        clips = with_batches(self.ids, self.order(epoch), batch_size)  # ranked before items are made
        return self.items(epoch).join(clips, "clip_id")


def from_files(spark, folder: str, representation: str = "6d", *, center_root: bool = True, include_positions: bool = False, position_space: str = "joint", position_centering: str = "world", label=None, pattern: str = "*.bvh", world_up: str = "auto", **how) -> MotionFeed:
    """A feed straight from motion files: nothing is parsed before an epoch is read, and then each file once; which clips there
    are is known from their names. Each clip keeps its own skeleton, up
    axis and Euler orders; ``label(stem)`` is a column. Other keywords are those of ``MotionFeed``."""
    require_representation(representation, clip_tables.EXTRACTED)
    files = bvh.listing(spark, folder, pattern).select("clip_id")
    bvh.require_files(files, folder)
    parsed = with_axes(bvh.scan(spark, folder, pattern), world_up)
    held = bvh.frames(parsed, "euler_orders", *(["offsets", "world_up"] if include_positions else []))
    frames = clip_tables.extract(held, representation, F.col("euler_orders"))
    if include_positions:
        first = files.agg(F.min("clip_id")).first()[0]
        top = skeleton.topology(bvh.skeletons(bvh.scan(spark, folder, pattern, keep=lambda stem: stem == first)))  # no other file is parsed
        frames = frames.withColumn("up", axis_number(F.col("world_up")))
        frames = skeleton.refresh_positions(frames, top, representation, joint=position_space == "joint", node=position_space == "node", centering=position_centering, up="up", own_offsets="offsets", own_orders="euler_orders")
    frames = frames.drop("euler_orders", "offsets", "world_up", "up")
    facts = files.select("clip_id", *([label(F.col("clip_id")).cast("long").alias("label")] if label else []))
    return MotionFeed(frames, facts, center_root=center_root, position_centering=position_centering if include_positions else None, ids=files, **how)


def with_batches(items: DataFrame, order: Column, batch_size: int, place: str | None = None) -> DataFrame:
    """Adds ``batch_id`` (and, called ``place``, the item's place in its batch): the items ranked by ``order`` (a number in [0, 1)), then by clip_id, ``batch_size`` to a batch,
    the last one with what is left.

    Ranks are counted in groups of equal ranges of ``order``, of about ``GROUP`` items each, and the groups before are
    added from their counts, so no task has all items. Only clip_id and order take part in ranking."""
    if batch_size < 1:
        raise ValueError("a batch has one item or more")
    keyed = items.select("clip_id", order.alias("_order"))
    groups = max(1, keyed.count() // GROUP)
    keyed = keyed.withColumn("_group", F.least(F.floor(F.col("_order") * groups), F.lit(groups - 1)).cast("int"))
    sizes = keyed.groupBy("_group").agg(F.count("*").alias("_n"))
    before = sizes.select("_group", (F.sum("_n").over(Window.orderBy("_group")) - F.col("_n")).alias("_before"))  # one row per group
    own = F.row_number().over(Window.partitionBy("_group").orderBy("_order", "clip_id")) - 1
    rank = F.col("_own") + F.col("_before")
    extra = [] if place is None else [(rank % batch_size).cast("int").alias(place)]
    ranked = keyed.withColumn("_own", own).join(before, "_group").select("clip_id", F.floor(rank / batch_size).cast("long").alias("batch_id"), *extra)
    return items.join(ranked, "clip_id")


def all_or_none(items: DataFrame, column: str) -> None:
    """Refuses a column that some items have and others lack."""
    some, every = items.agg(F.count(column), F.count("*")).first()
    if some not in (0, every):
        raise ValueError(f"{every - some} of {every} items have no {column}")


def collate(items: DataFrame) -> DataFrame:
    """``batch_id, clip_ids, data, lengths, mask`` (and ``labels``): flat items padded with 0 to the longest of
    their batch; the mask is true before an item's length. A batch is a row, as its tensor is."""
    batch = Window.partitionBy("batch_id")
    width = F.size(F.get("data", F.lit(0)))  # null for an item without rows
    wide = items.withColumns({"_t": F.max(F.size("data")).over(batch), "_w": F.when(F.size("data") > 0, width)})
    wide = wide.withColumns({"_low": F.min("_w").over(batch), "_high": F.max("_w").over(batch)})
    said = F.concat(F.lit("items of widths "), F.col("_low").cast("string"), F.lit(" and "), F.col("_high").cast("string"), F.lit(" in batch "), F.col("batch_id").cast("string"))
    width = F.when(F.col("_low") < F.col("_high"), F.raise_error(said).cast("int")).otherwise(F.coalesce("_high", F.lit(0)))
    pad = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), width), (F.col("_t") - F.size("data")).cast("int"))
    wide = wide.withColumn("_data", F.concat("data", pad))
    mask = F.transform(F.array_repeat(F.lit(0), F.col("_t")), lambda _, k: k < F.col("length"))
    extra = ["label"] if "label" in items.columns else []
    rows = F.array_sort(F.collect_list(F.struct("clip_id", "_data", "length", mask.alias("mask"), *extra)))
    take = lambda name: F.transform(F.col("rows"), lambda r: r[name])
    out = wide.groupBy("batch_id").agg(rows.alias("rows"))
    return out.select("batch_id", take("clip_id").alias("clip_ids"), take("_data").alias("data"), take("length").alias("lengths"), take("mask").alias("mask"), *(take(c).alias(f"{c}s") for c in extra))


def collate_arrays(items: list[dict]) -> dict:
    """The same on the trainer's side, for items read as NumPy arrays."""
    if not items:
        raise ValueError("an empty batch")
    items = [x | {"data": np.asarray(x["data"]).reshape(0, 0)} if np.size(x["data"]) == 0 and np.ndim(x["data"]) < 2 else x for x in items]
    if any(np.ndim(x["data"]) != 2 for x in items):
        raise ValueError("items of two dimensions can be padded into a batch; others need a target length")
    widths = {x["data"].shape[1] for x in items if len(x["data"])} or {x["data"].shape[1] for x in items}
    if len(widths) > 1:
        raise ValueError(f"items of widths {sorted(widths)} in one batch")
    longest, width = max(len(x["data"]) for x in items), widths.pop()
    out = {"data": np.zeros((len(items), longest, width), np.float32), "lengths": np.array([x["length"] for x in items], np.int64)}
    for row, x in zip(out["data"], items):
        if len(x["data"]):
            row[: len(x["data"])] = x["data"]
    out["mask"] = np.arange(longest)[None, :] < out["lengths"][:, None]
    for name in ("label", "name"):
        have = [name in x and x[name] is not None for x in items]
        if any(have) and not all(have):
            raise ValueError(f"some items have no {name}")
        if all(have):
            out[f"{name}s"] = np.array([x[name] for x in items]) if name == "label" else [x[name] for x in items]
    return out


def normalize_index(index: int, size: int) -> int:
    if not -size <= index < size:
        raise IndexError(f"index {index} is outside of {size} items")
    return index % size


def batches(items: DataFrame, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the items for a trainer, of ``rows`` rows or fewer. The driver holds one partition at a time, and
    asks for the next one ahead."""
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in items.schema.fields])
    held: list[dict] = []
    for r in items.toLocalIterator(prefetchPartitions=True):
        held.append(r.asDict(recursive=True))
        if len(held) == rows:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
