"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Packing looks at lengths only, and there are at most ``SEQUENCE`` of them: the histogram of piece lengths,
counted by executors, is packed as bin patterns with multiplicities, so the plan's size does not grow with
the corpus. A sequence is filled greedily with the longest piece that fits; then its smallest piece is
replaced with the two unpacked pieces that fit the expanded gap most tightly, where that is tighter. A piece
finds its place by its rank among the pieces of its length, which is counted in salted groups.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.kernel import slices
from kinetra.llm.scratch import Scratch

SEQUENCE = 1024
END = 2
#: Runs of white space from this length are left to ``tokenizers``.
LONG_SPACE = 1000
#: Pieces of one length are dealt to groups to be ranked: at least so many groups, of about so many pieces.
RANK_GROUPS, GROUP_PIECES = 64, 100_000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(tokenizer: str, ranks: str):
    """text -> ids of the ``tokenizers`` file. Its byte-level pieces are merged by ``tiktoken`` over the
    same vocabulary as ranks, which gives the same ids several times faster; a text that has one of the
    file's added tokens, or white space so long that the pattern's look-ahead would have to go back over it, goes
    through ``tokenizers`` itself."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    added = [t.content for t in model.get_added_tokens_decoder().values()]
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    wide = re.compile(rf"\s{{{LONG_SPACE}}}")

    def encode(text: str) -> list[int]:
        if any(a in text for a in added) or wide.search(text):
            return model.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, the first piece takes what is over."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer: str, ranks: str, size: int = SEQUENCE) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of each document's ids and the end id."""

    def run(batches):
        encode = encoder(tokenizer, ranks)
        for batch in slices(batches, most=1 << 20):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), END], "<u4")
                out += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), size))]
            d, k, s, n, crc = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: np.ndarray, size: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a bin, number of such bins) that use ``counts[length]`` pieces wholly."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    while left.any():
        used: dict[int, int] = {}
        free, bin_ = left.copy(), []
        gap = size
        while True:  # greedy: the longest piece that fits
            fit = np.flatnonzero(free[: gap + 1])
            if not len(fit):
                break
            n = int(fit[-1])
            take = int(min(free[n], gap // n))
            bin_ += [n] * take
            free[n] -= take
            gap -= take * n
        if gap and bin_:  # the smallest piece gives way to two that leave less
            small = bin_[-1]
            two = _best_two(free, gap + small)
            if two and sum(two) > small:
                bin_[-1:] = two
        for n in bin_:
            used[n] = used.get(n, 0) + 1
        times = min(int(left[n]) // c for n, c in used.items())
        for n, c in used.items():
            left[n] -= c * times
        out.append((bin_, times))
    return out


def _best_two(free: np.ndarray, gap: int) -> list[int] | None:
    """The two lengths at hand whose sum is largest within the gap."""
    at = np.flatnonzero(free[: gap + 1])
    if not len(at):
        return None
    # largest[g]: the longest piece at hand of length g or less (0: none)
    largest = np.zeros(gap + 1, np.int64)
    largest[at] = at
    largest = np.maximum.accumulate(largest)
    other = largest[gap - at]
    same = (other == at) & (free[at] < 2)
    if same.any():
        lower = largest[np.maximum(at[same] - 1, 0)]
        other[same] = np.where(at[same] > 0, lower, 0)
    ok = other > 0
    if not ok.any():
        return None
    best = int(np.argmax(np.where(ok, at + other, -1)))
    return sorted([int(at[best]), int(other[best])], reverse=True)


def places(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces a bin, first bin, offset in the bin) in order of rank."""
    rank: dict[int, int] = {}
    rows: dict[int, list] = {}
    base = 0
    for bin_, times in patterns:
        offset = 0
        for n in sorted(set(bin_), reverse=True):
            c = bin_.count(n)
            rows.setdefault(n, []).append((rank.get(n, 0), c, base, offset))
            rank[n] = rank.get(n, 0) + c * times
            offset += c * n
        base += times
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Every row of ``docs(doc_id, text, ...)`` is packed; null text counts as empty and gives the end id alone.
    Rows that repeat a doc_id are packed each. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    cut_up = scratch.table(pieces(docs, tokenizer or public_path("byte_bpe_50k.json"), ranks or public_path("byte_bpe_50k.tiktoken"), size))
    counts = np.zeros(size + 1, np.int64)
    for row in cut_up.groupBy("length").count().collect():  # at most ``size`` rows
        counts[row["length"]] = row["count"]
    found = docs.sparkSession.sparkContext.broadcast(places(plan(counts, size)))
    groups = max(RANK_GROUPS, int(counts.max()) // GROUP_PIECES)
    salted = cut_up.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    sizes = salted.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = sizes.select("length", "group", (F.sum("n").over(Window.partitionBy("length").orderBy("group")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(before, ["length", "group"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))

    def place(batches):
        table = found.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                rows = table[int(n)]
                first, per, base, start = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1].T
                sequence[at] = base + (rank[at] - first) // per
                offset[at] = start + (rank[at] - first) % per * n
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
