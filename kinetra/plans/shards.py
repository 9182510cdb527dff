"""Epochs as files that many trainers read side by side.

Executors write an epoch's items in shards, each of whole batches of one rank, and a manifest that lists them; nothing goes
through the driver. A trainer of a rank opens its own shards one after the other, without Spark, and can begin again at
any batch. Batches are dealt to ranks in turn, so each item is handed out once.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.plans.feed import MotionFeed, collate_arrays, with_batches

#: Batches of a shard.
SHARD_BATCHES = 64


def write_epoch(feed: MotionFeed, folder: str, epoch: int, *, world_size: int, batch_size: int, shard_batches: int = SHARD_BATCHES) -> DataFrame:
    """Writes ``folder/epoch=<epoch>`` and returns its manifest: ``rank, shard, first_batch, n_batches, n_items``.

    Batch b of the epoch goes to rank b mod ``world_size``, which counts its own from 0. An epoch that is there already is
    refused; one whose manifest is missing was not finished and is written anew.
    """
    if world_size < 1 or shard_batches < 1:
        raise ValueError("there is one rank, and one batch in a shard, at least")
    spark = feed.frames.sparkSession
    where = f"{folder.rstrip('/')}/epoch={epoch}"
    if _exists(f"{where}/manifest/_SUCCESS"):
        raise FileExistsError(f"epoch {epoch} is in {folder} already")
    items = feed.items(epoch).join(with_batches(feed.ids, feed.order(epoch), batch_size, place="place"), "clip_id")  # ranked before items are made
    own = F.floor(F.col("batch_id") / world_size)
    dealt = items.withColumns({"rank": F.pmod("batch_id", F.lit(world_size)).cast("int"), "batch": own.cast("long")}).withColumn("shard", F.floor(F.col("batch") / shard_batches).cast("long"))
    ordered = dealt.repartition("rank", "shard").sortWithinPartitions("rank", "shard", "batch", "place")
    ordered.write.mode("overwrite").partitionBy("rank", "shard").parquet(f"{where}/items")
    back = spark.read.parquet(f"{where}/items")
    listed = back.groupBy("rank", "shard").agg(F.min("batch").alias("first_batch"), F.countDistinct("batch").alias("n_batches"), F.count("*").alias("n_items"))
    facts = {"epoch": epoch, "world_size": world_size, "batch_size": batch_size, "shard_batches": shard_batches, "seed": feed.seed, "layout": feed.layout}
    spark.createDataFrame([(json.dumps(facts),)], "json string").coalesce(1).write.mode("overwrite").parquet(f"{where}/facts")
    listed.coalesce(1).sortWithinPartitions("rank", "shard").write.mode("overwrite").parquet(f"{where}/manifest")  # last: it says that all is there
    return spark.read.parquet(f"{where}/manifest")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _exists(path: str) -> bool:
    fs, own = _open(path)
    return fs.get_file_info(own).type != pafs.FileType.NotFound


def _tables(folder: str) -> list[str]:
    fs, own = _open(folder)
    return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(own, allow_not_found=True)) if f.path.endswith(".parquet"))


def _read(folder: str) -> pa.Table:
    fs, _ = _open(folder)
    return pa.concat_tables([pq.read_table(io.BytesIO(fs.open_input_file(p).read())) for p in _tables(folder)])


class RankReader:
    """One rank's batches of the epochs in a folder. A trainer process holds one; no Spark session is needed.

    ``set_epoch`` chooses the epoch, ``batches(start)`` gives its batches from number ``start`` on, and ``next_batch`` is where to begin
    again after a stop: it moves on when the next batch is asked for."""

    def __init__(self, folder: str, rank: int, world_size: int, epoch: int = 0) -> None:
        if not 0 <= rank < world_size:
            raise ValueError(f"rank {rank} of {world_size}")
        self.folder, self.rank, self.world_size = folder.rstrip("/"), rank, world_size
        self.set_epoch(epoch)

    def set_epoch(self, epoch: int) -> None:
        where = f"{self.folder}/epoch={epoch}"
        if not _exists(f"{where}/manifest/_SUCCESS"):
            raise FileNotFoundError(f"epoch {epoch} is not in {self.folder}")
        self.facts = json.loads(_read(f"{where}/facts").column("json")[0].as_py())
        if self.facts["world_size"] != self.world_size:
            raise ValueError(f"the epoch was written for {self.facts['world_size']} ranks, not {self.world_size}")
        listed = [r for r in _read(f"{where}/manifest").to_pylist() if r["rank"] == self.rank]
        self.shards = sorted(listed, key=lambda r: r["shard"])
        self.epoch, self.next_batch = epoch, 0

    def __len__(self) -> int:
        """Batches of this rank."""
        return sum(s["n_batches"] for s in self.shards)

    def rows(self, start: int = 0) -> Iterator[tuple[int, pa.Table]]:
        """(number, rows of the batch in order); a shard is in memory at a time, shards before ``start`` are not opened."""
        for s in self.shards:
            if s["first_batch"] + s["n_batches"] <= start:
                continue
            table = _read(f"{self.folder}/epoch={self.epoch}/items/rank={self.rank}/shard={s['shard']}")
            if table.num_rows != s["n_items"]:
                raise ValueError(f"shard {s['shard']} of rank {self.rank} has {table.num_rows} of {s['n_items']} items")
            table = table.sort_by([("batch", "ascending"), ("place", "ascending")])
            number = table.column("batch").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:]):
                if number[a] >= start:
                    yield int(number[a]), table.slice(a, b - a)

    def batches(self, start: int | None = None) -> Iterator[dict]:
        """Batches as arrays, padded and masked in flat layout (see ``feed.collate_arrays``), stacked in others, with ``clip_ids``."""
        for number, table in self.rows(self.next_batch if start is None else start):
            rows = table.to_pylist()
            extra = [c for c in ("label", "name") if c in table.column_names]
            items = [{"data": np.array(r["data"], np.float32), "length": r["length"], **{c: r[c] for c in extra}} for r in rows]
            out = collate_arrays(items) if self.facts["layout"] == "flat" else {"data": np.stack([x["data"] for x in items]), "lengths": np.array([x["length"] for x in items], np.int64), **{f"{c}s": [x[c] for x in items] for c in extra}}
            yield out | {"clip_ids": [r["clip_id"] for r in rows], "batch": number}
            self.next_batch = number + 1
