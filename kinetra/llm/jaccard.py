"""N-gram Jaccard join by signature trees.

Documents become sets of hashed k-word shingles. Equal sets collapse to one class first. Two exact filters,
which follow from the threshold alone, then bring sets together that may link:

* Of its first tokens in hash order, a set must share so many with other sets (``shared_tokens``).
* Linked sets have few tokens apart, so among the first tokens of both in hash order some run of a few
  tokens is the same in both (``run_keys``). Sets with an equal run form candidate components.

A task joins its own rows on such keys before they are shuffled, and sends each key once for them all, so that a
key has as many shuffled rows as there are tasks' chunks, however many sets have it.

Each component is joined with itself by a signature tree: nodes hold the OR of their members' token bitmaps
and their size range, and a dual traversal drops node pairs whose largest possible overlap is below what the
threshold asks, or which are linked already. Pairs of leaves are verified on whole sets. A component over
``TASK_TOKENS`` is cut into chunks by set size. Chunks are joined with themselves, then with their neighbours
in size, then with all others that their size ranges let link and that are not one linked part with them; each
pair is a task of its own, so no task holds more than two chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.graph import components
from kinetra.llm.kernel import U, mix, shingles, slices, words
from kinetra.llm.scratch import Scratch
from kinetra.llm.skew import join_groups

#: Tokens that one chunk holds; a task works on two chunks at most, or on some small components.
TASK_TOKENS = 100_000
#: Keys that a task joins among themselves before it sends them on.
CHUNK_KEYS = 1_000_000


# ---- sets -------------------------------------------------------------------------------------


def row_sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    hashes, bounds = words(batch.column("text"))
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield shingles(hashes[a:b], k)


def set_key(tokens: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """Two independent 64-bit fingerprints of a set."""
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16, key=seed.to_bytes(4, "big")).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def needed(n: np.ndarray | int, percent: int):
    """Least overlap that a set of size n has with any set that it links with."""
    return (percent * n + 99) // 100


def needed_pair(total, percent: int):
    """Least overlap of two sets whose sizes sum to ``total``: 100 i >= p (total - i)."""
    return (percent * total + 99 + percent) // (100 + percent)


def shared_tokens(n, percent: int):
    """How many of its prefix a set of n tokens shares at least with a set whose prefix ends no earlier."""
    return np.minimum(np.maximum(1, -(-n * 3 // 50)), needed(n, percent))


def prefix(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The tokens with the smallest hashes: all but so many that, of two linked sets, the one whose prefix ends
    first has ``shared_tokens`` of the common tokens in it, which the other's prefix then has, too."""
    n = len(tokens)
    return tokens[: n - needed(n, percent) + int(shared_tokens(n, percent))]


def most_apart(n, percent: int):
    """Tokens at most that stand in only one of two linked sets, the smaller of which has n."""
    return n * (100 - percent) // percent


@cache
def run_rule(percent: int) -> tuple[int, int | None]:
    """(run, long): linked sets, the smaller of ``long`` tokens or more, share a run of ``run``.

    The common tokens, in order, are cut into one run more than there are tokens apart; so ``run - 1`` common
    tokens for each, and one more, have a run of that length. There must be so many: ``long`` is the size from
    which all sets have them. None: runs of two or more are sure for no size, so single tokens serve all sets."""
    sizes = np.arange(1, 4097)
    for run in (6, 5, 4, 3, 2):
        if (run - 1) * (100 - percent) / percent + (100 - percent) / 100 > 0.75:
            continue  # nearly the whole set would be sent
        short = sizes[needed(sizes, percent) < (run - 1) * (most_apart(sizes, percent) + 1) + 1]
        if not len(short):
            return run, 1
        if short[-1] < 64:
            return run, int(short[-1]) + 1
    return 1, None


def run_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the runs, among the first tokens, of which linked sets share one. The smaller set of a pair decides
    between runs and single tokens, so a set gives both where smaller partners decide otherwise."""
    n = len(tokens)
    run, long = run_rule(percent)
    spare = n - needed(n, percent)
    out = []
    if long is not None and n >= long:
        stretch = min(n, (run - 1) * (most_apart(n, percent) + 1) + 1 + spare)
        h = np.full(max(0, stretch - run + 1), U(run), U)
        for i in range(run):
            h = mix(h) + tokens[i : i + len(h)]
        out.append(mix(h))
    if long is None or needed(n, percent) < long:
        out.append(mix(tokens[: 1 + spare] + U(1)))
    return np.concatenate(out)


# ---- signature tree ---------------------------------------------------------------------------


class SignatureTree:
    """Nodes over sets in an order that brings alike sets together. ``levels[0]`` are the sets."""

    FANOUT = 8

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        # sixteen bits a token of the largest set, but no more in all than 64 bits a token of all sets
        width = min(16 * int(self.sizes.max(initial=1)), 64 * int(self.sizes.sum()) // max(1, len(sets)))
        bits = 1 << int(np.clip(width, 512, 1 << 17)).bit_length() - 1
        maps = np.zeros((len(sets), bits // 64), U)
        for i, s in enumerate(sets):
            where = s & U(bits - 1)
            np.bitwise_or.at(maps[i], (where >> U(6)).astype(np.int64), U(1) << (where & U(63)))
        extra = self.sizes - np.bitwise_count(maps).sum(1)
        self.levels = [(maps, self.sizes, self.sizes, extra)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, extra = self.levels[-1]
            cut = np.arange(0, len(low), self.FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(extra, cut)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether some member of node a may link with some member of node b: two sets share no more
        tokens than the smaller has, nor than the bits in both maps plus tokens that met in one bit."""
        maps, low, high, extra = self.levels[level]
        least = needed_pair(low[a] + low[b], percent)
        ok = (np.minimum(high[a], high[b]) >= least) & (high[a] >= needed(low[b], percent)) & (high[b] >= needed(low[a], percent))
        at = np.flatnonzero(ok)
        step = max(1, (8 << 20) // (maps.shape[1] * 8))
        for i in range(0, len(at), step):
            x = at[i : i + step]
            shared = np.bitwise_count(maps[a[x]] & maps[b[x]]).sum(1)
            ok[x] = shared + np.minimum(extra[a[x]], extra[b[x]]) >= least[x]
        return ok


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


class Parts:
    """Disjoint sets of numbers, by union with path halving."""

    def __init__(self, labels: np.ndarray) -> None:
        """Numbers with equal labels are together from the start."""
        _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[inverse]

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def flat(self) -> np.ndarray:
        """The least number of each number's part."""
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up


def join_sets(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, parts: np.ndarray | None = None, forest: bool = True) -> list[tuple[int, int]]:
    """Links (i, j) that connect all that links connect (a spanning forest), or, with ``forest`` off, all links. With
    ``side``, pairs of the same side are known already: only pairs of different sides are looked at. ``parts``
    are labels of parts that are known to be linked."""
    if len(sets) < 2:
        return []
    order = sorted(range(len(sets)), key=lambda i: (sets[i][0] if len(sets[i]) else U(0), len(sets[i])))
    tree = SignatureTree([sets[i] for i in order])
    linked_parts = Parts(np.arange(len(order)) if parts is None else np.asarray(parts)[order])
    links: list[tuple[int, int]] = []
    sides = None if side is None else np.asarray(side)[order]

    def join(a: int, b: int) -> None:
        if forest and linked_parts.find(a) == linked_parts.find(b):
            return
        if (sides is None or sides[a] != sides[b]) and linked(tree.sets[a], tree.sets[b], percent):
            links.append((order[a], order[b]))
            if forest:
                linked_parts.join(a, b)

    if forest:  # neighbours in the order: most copies are linked before the traversal
        for a in range(len(order) - 1):
            join(a, a + 1)

    def uniform(level: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = high = value
        for _ in range(level):
            cut = np.arange(0, len(low), tree.FANOUT)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
        return low, high

    def walk(level: int, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs of nodes of one level, a <= b, in blocks: depth first, so few pairs wait at once."""
        for i in range(0, len(a), 4096):
            x, y = a[i : i + 4096], b[i : i + 4096]
            keep = np.ones(len(x), bool)
            for value in ([linked_parts.flat()] if forest else []) + ([] if sides is None else [sides]):
                low, high = uniform(level, value)
                keep &= (low[x] != low[y]) | (low[x] != high[x]) | (low[y] != high[y])
            x, y = x[keep], y[keep]
            ok = tree.possible(level, x, y, percent)
            x, y = x[ok], y[ok]
            if level:
                n = len(tree.levels[level - 1][1])
                grid = np.arange(tree.FANOUT)
                cx = (x[:, None, None] * tree.FANOUT + grid[None, :, None]).repeat(tree.FANOUT, 2).ravel()
                cy = (y[:, None, None] * tree.FANOUT + grid[None, None, :]).repeat(tree.FANOUT, 1).ravel()
                good = (cx < n) & (cy < n) & ((cx < cy) if level == 1 else (cx <= cy))
                walk(level - 1, cx[good], cy[good])
            else:
                for p, q in zip(x.tolist(), y.tolist()):
                    join(p, q)

    top = len(tree.levels) - 1
    walk(top, np.zeros(1, np.int64), np.zeros(1, np.int64))
    return links


# ---- distributed join -------------------------------------------------------------------------


def _longs(values: list[np.ndarray]) -> pa.Array:
    """list<int64>, one for each array."""
    flat = np.concatenate([np.zeros(0, U), *values]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat))


def _leads(keys: list[np.ndarray], sids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the keys of several sets end to end: their sets' places, the keys, how many of the sets have the key, and
    the place of the one with the least sid."""
    own = np.repeat(np.arange(len(keys)), np.array([len(x) for x in keys], np.int64))
    flat = np.concatenate([np.zeros(0, U), *keys])
    order = np.lexsort((np.array(sids, np.int64)[own], flat))
    start = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]])) if len(flat) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([start, [len(flat)]])).astype(np.int64)
    count, lead = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    count[order], lead[order] = np.repeat(size, size), np.repeat(own[order][start], size)
    return own, flat, count, lead


def _read_sets(docs: DataFrame, k: int, percent: int, seed: int) -> DataFrame:
    """A row per document: ``doc_id, n, sid, chk, need, sure, ask, tell``. The first row of a set in a task's chunk has
    its prefix: ``sure`` keys are shared with sets of the chunk; ``tell`` are those of them that it sends
    on for all; ``ask`` are keys that no other set of the chunk has."""

    def flush(rows: list[tuple], keys: dict[int, np.ndarray]) -> pa.RecordBatch:
        sids = list(keys)
        own, flat, count, lead = _leads(list(keys.values()), sids)
        ask, tell = count == 1, (count > 1) & (lead == own)
        sure = np.bincount(own[count > 1], minlength=len(sids))
        cut = lambda which: np.split(flat[which], np.searchsorted(own[which], np.arange(1, len(sids)))) if sids else []
        of = {s: (int(x), a, t) for s, x, a, t in zip(sids, sure, cut(ask), cut(tell))}
        none = (0, np.zeros(0, U), np.zeros(0, U))
        found = [of.pop(r[2], none) for r in rows]
        doc, n, sid, chk, need = zip(*rows)
        cols = [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(chk, pa.int64()), pa.array(need, pa.int32()), pa.array([x for x, _, _ in found], pa.int32()), _longs([a for _, a, _ in found]), _longs([t for _, _, t in found])]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "sid", "chk", "need", "sure", "ask", "tell"])

    def run(batches):
        rows, keys, held = [], {}, 0
        for batch in slices(batches):
            for doc, s in zip(batch.column("doc_id").to_pylist(), row_sets(batch, k)):
                n = len(s)
                sid, chk = set_key(s, seed) if n else (int(mix(np.array([doc or 0], np.int64).view(U))[0].view(np.int64)), 0)  # no set: any number
                if n and doc is not None and sid not in keys:
                    keys[sid] = prefix(s, percent).copy()
                    held += len(keys[sid])
                rows.append((doc, n, sid, chk, int(shared_tokens(needed(n, percent), percent))))
            if held >= CHUNK_KEYS or len(rows) >= 1 << 16:
                yield flush(rows, keys)
                rows, keys, held = [], {}, 0
        if rows:
            yield flush(rows, keys)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sid long, chk long, need int, sure int, ask array<bigint>, tell array<bigint>")


def _survivors(seen: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of ``reps`` of sets that share enough of their prefix with other sets (keys that copies in several
    chunks ask for count again, which keeps a set too many at most)."""
    asked = seen.select(F.explode("ask").alias("key"), "sid")
    told = seen.select(F.explode("tell").alias("key"), F.lit(None).cast("long").alias("sid"))
    of_key = Window.partitionBy("key")
    known = asked.unionByName(told).select("sid", F.min("sid").over(of_key).alias("a"), F.max("sid").over(of_key).alias("b"), F.max(F.col("sid").isNull()).over(of_key).alias("told"))
    shared = known.where("sid is not null and (told or a <> b)").groupBy("sid").agg(F.count("*").cast("int").alias("got"))
    got = shared.select("sid", "got", F.lit(0).alias("sure")).unionByName(seen.where("sure > 0").select("sid", F.lit(0).alias("got"), "sure"))
    got = got.groupBy("sid").agg((F.sum("got") + F.max("sure")).alias("got"))
    return got.join(reps, "sid").where("got >= need").select("sid", "rep", "n")


def _whole_sets(docs: DataFrame, reps: DataFrame, k: int, seed: int) -> DataFrame:
    """``sid, rep, n, tokens`` of the classes in ``reps(sid, rep)``, from the text of one document each."""

    def run(batches):
        for batch in slices(batches):
            sets = list(row_sets(batch, k))
            good = np.array([set_key(s, seed)[0] for s in sets], np.int64) == batch.column("sid").to_numpy()  # not rows that repeat a doc_id
            cols = [batch.column("sid"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["sid", "rep", "n", "tokens"]).filter(pa.array(good))

    # merged at any size, so that costs grow evenly: the list of sets grows with the input, and is broadcast only while small
    picked = docs.join(reps.select("sid", F.col("rep").alias("doc_id")).hint("merge"), "doc_id").select("doc_id", "text", "sid")
    return picked.mapInArrow(run, "sid long, rep long, n long, tokens binary")


def _run_rows(sets: DataFrame, percent: int) -> DataFrame:
    """``key, u, v``: within a task's chunk a set u is joined to the least one v of each of its runs (key null); that one
    alone is sent on with the run (v null)."""

    def flush(keys: dict[int, np.ndarray]) -> pa.RecordBatch:
        sids = np.array(list(keys), np.int64)
        own, flat, _, lead = _leads(list(keys.values()), list(keys))
        first = own == lead
        near = np.stack([own[~first], lead[~first]])
        near = np.unique(near, axis=1) if near.size else near
        key = pa.concat_arrays([pa.array(flat[first].view(np.int64)), pa.nulls(near.shape[1], pa.int64())])
        return pa.RecordBatch.from_arrays([key, pa.array(np.concatenate([sids[own[first]], sids[near[0]]])), pa.concat_arrays([pa.nulls(int(first.sum()), pa.int64()), pa.array(sids[near[1]])])], ["key", "u", "v"])

    def run(batches):
        keys, held = {}, 0
        for batch in batches:
            for sid, tokens in zip(batch.column("sid").to_pylist(), batch.column("tokens")):
                keys[sid] = np.unique(run_keys(np.frombuffer(tokens.as_py(), U), percent))
                held += len(keys[sid])
                if held >= CHUNK_KEYS:
                    yield flush(keys)
                    keys, held = {}, 0
        if keys:
            yield flush(keys)

    return sets.select("sid", "tokens").mapInArrow(run, "key long, u long, v long")


def _chunks(nodes: DataFrame) -> DataFrame:
    """``nodes(sid, n, comp)`` -> ``sid, comp, n, chunk, task``: components of up to ``TASK_TOKENS`` share tasks and
    have no chunk; larger ones are cut into chunks by size, each a task of its own."""
    size = nodes.groupBy("comp").agg(F.sum("n").alias("total"), F.count("*").alias("members"))
    small_tasks = max(1, -(-(size.where(F.col("total") <= TASK_TOKENS).agg(F.sum("total")).first()[0] or 0) // TASK_TOKENS)) * 2
    nodes = join_groups(nodes, size, ["comp"], "members", nodes.count(), ["sid"])
    shared = F.concat(F.lit("s"), F.pmod(F.xxhash64("comp"), F.lit(small_tasks)).cast("string"))
    small = nodes.where(F.col("total") <= TASK_TOKENS).select("sid", "comp", "n", F.lit(None).cast("int").alias("chunk"), shared.alias("task"))
    big = nodes.where(F.col("total") > TASK_TOKENS)
    by_size = big.groupBy("comp", "n").agg(F.sum("n").alias("tokens"), F.count("*").alias("members"))
    before = F.sum("tokens").over(Window.partitionBy("comp").orderBy("n")) - F.col("tokens")
    by_size = by_size.select("comp", "n", "tokens", "members", before.alias("before"))
    unit = F.pmod(F.xxhash64("sid"), F.lit(1 << 20)) / F.lit(1 << 20)
    big = join_groups(big.select("sid", "comp", "n"), by_size, ["comp", "n"], "members", nodes.count(), ["sid"])
    big = big.select("sid", "comp", "n", F.floor((F.col("before") + unit * F.col("tokens")) / TASK_TOKENS).cast("int").alias("chunk"))
    return small.unionByName(big.withColumn("task", F.concat_ws("-", F.lit("b"), "comp", "chunk")))


def _links(sets: DataFrame, placed: DataFrame, percent: int, forest: bool) -> DataFrame:
    """``u, v``: links found by the tasks of ``placed(sid, comp, chunk, part, task)``; two chunks of a task are two sides.
    Sets without a task are left out."""

    def join(group: pa.Table) -> pa.Table:
        sid, comp, part = (group[c].to_numpy() for c in ("sid", "comp", "part"))
        chunk = group["chunk"].fill_null(0).to_numpy()
        tokens = group["tokens"]
        out: list[tuple[int, int]] = []
        order = np.argsort(comp, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            first: dict[int, int] = {}
            for i in rows:
                first.setdefault(int(sid[i]), int(i))  # repeated rows give a set twice
            own = list(first.values())
            side = chunk[own]
            found = join_sets([np.frombuffer(tokens[i].as_py(), U) for i in own], percent, side if side.min() != side.max() else None, part[own], forest)
            out += [(sid[own[i]], sid[own[j]]) for i, j in found]
        return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})

    rows = sets.select("sid", "tokens").join(placed.select("sid", "comp", "chunk", "part", "task"), "sid")
    return rows.groupBy("task").applyInArrow(join, "u long, v long")


def _all_links(sets: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch, forest: bool = True) -> DataFrame:
    """Links within the components of ``nodes(sid, n, comp)``: a spanning forest, or all."""
    placed = scratch.table(_chunks(nodes))
    placed = placed.withColumn("part", F.col("sid"))
    links = scratch.table(_links(sets, placed.hint("merge"), percent, forest))
    big = placed.where("chunk is not null")
    if big.isEmpty():
        return links
    for far in (False, True):
        known = big
        if forest and far:
            if _chunk_pairs(big, percent, far).isEmpty():  # no component has three chunks of sizes that meet
                break
            parts = components(links, scratch)  # most of a group of near copies is one part by now
            known = scratch.table(big.drop("part").join(parts, F.col("sid") == F.col("node"), "left").select("sid", "comp", "n", "chunk", F.coalesce("root", "sid").alias("part")))
        pairs = scratch.table(_chunk_pairs(known, percent, far))
        if pairs.isEmpty():
            continue
        chunk_tasks = pairs.select("comp", F.explode(F.array("i", "j")).alias("chunk"), F.concat_ws("-", F.lit("p"), "comp", "i", "j").alias("task"))
        new = _links(sets, known.drop("task").join(chunk_tasks, ["comp", "chunk"]), percent, forest)
        links = scratch.table(links.unionByName(new))
    return links


def _chunk_pairs(known: DataFrame, percent: int, far: bool) -> DataFrame:
    """``comp, i, j``: pairs of chunks of ``known(comp, chunk, n, part)``, neighbours or, with ``far``, others, whose size
    ranges let them link and which are not one linked part."""
    node = known.groupBy("comp", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("part").alias("p"), F.max("part").alias("q"))
    a, b = (node.select("comp", *(F.col(c).alias(f"{c}{x}") for c in ("low", "high", "p", "q")), F.col("chunk").alias(x)) for x in "ij")
    which = F.col("j") > F.col("i") + 1 if far else F.col("j") == F.col("i") + 1
    one_part = (F.col("pi") == F.col("qi")) & (F.col("pj") == F.col("qj")) & (F.col("pi") == F.col("pj"))
    return a.join(b, "comp").where(which & (F.col("highi") * 100 >= F.col("lowj") * percent) & ~one_part).select("comp", "i", "j")


def _candidates(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``profiles(doc_id, n, sid)``, ``reps(sid, rep, n, copies)``, ``sets(sid, rep, n, tokens)``, ``nodes(sid, n, comp)``."""
    docs = docs.select("doc_id", "text")
    for seed in range(16):  # a fingerprint that two sets share (never seen) is tried again with another key
        seen = scratch.table(_read_sets(docs, k, percent, seed))
        reps = seen.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("need").alias("need"), F.count("*").alias("copies"), F.min("chk").alias("c1"), F.max("chk").alias("c2"))
        reps = scratch.table(reps)
        if reps.where("c1 <> c2").isEmpty():
            break
        scratch.drop(seen, reps)
    chosen = scratch.table(_survivors(seen, reps))
    profiles = scratch.table(seen.select("doc_id", "n", "sid"))
    scratch.drop(seen)
    sets = scratch.table(_whole_sets(docs.where(F.col("doc_id").isNotNull()), chosen, k, seed))
    runs = scratch.table(_run_rows(sets, percent))
    far = runs.where("key is not null").select("u", F.min("u").over(Window.partitionBy("key")).alias("v")).where("u <> v")
    groups = components(far.unionByName(runs.where("key is null").select("u", "v")), scratch).select(F.col("node").alias("sid"), F.col("root").alias("comp"))
    scratch.drop(runs)
    return profiles, reps, sets, scratch.table(groups.join(sets.select("sid", "n").distinct(), "sid"))


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, n_shingles, component_id``.

    Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z lowered. A text's set has its
    distinct k-word shingles; a shorter text has its whole sequence as one; null, empty and blank texts
    have no shingles and link with nothing (component_id is their own doc_id). Two sets link when
    100 * intersection >= percent * union (and they intersect); component_id is the smallest doc_id reachable by
    links. Rows with a null doc_id take part in counts only: they link with nothing and component_id is null.
    Repeated rows each give a row; rows that repeat a doc_id with other texts are sets of their own under
    that id; other columns are ignored; an empty table gives an empty result. ``percent`` is from 1 to 100.
    """
    _check(k, percent)
    scratch = Scratch(docs.sparkSession, "jaccard")
    profiles, reps, sets, nodes = _candidates(docs, k, percent, scratch)
    links = components(_all_links(sets, nodes, percent, scratch), scratch)
    scratch.drop(sets, nodes)
    classes = scratch.table(reps.join(links, reps.sid == links.node, "left").select("sid", "rep", "copies", F.coalesce("root", "sid").alias("root")))
    smallest = classes.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("members"))
    of_set = join_groups(classes, smallest, ["root"], "members", classes.count(), ["sid"]).select("sid", "component", "copies")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return join_groups(profiles, scratch.table(of_set), ["sid"], "copies", profiles.count(), ["doc_id"]).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def jaccard_links(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """All links between different sets, as ``a, b``: the smallest doc_ids of the two sets' documents, a < b. Documents
    with equal sets are one class (see ``jaccard_classes``) and are not expanded. Odd rows are treated as there."""
    _check(k, percent)
    scratch = Scratch(docs.sparkSession, "links")
    _, reps, sets, nodes = _candidates(docs, k, percent, scratch)
    links = _all_links(sets, nodes, percent, scratch, forest=False)
    u, v = (reps.select(F.col("sid").alias(x), F.col("rep").alias(f"rep_{x}")) for x in "uv")
    both = links.join(u, "u").join(v, "v")
    return both.select(F.least("rep_u", "rep_v").alias("a"), F.greatest("rep_u", "rep_v").alias("b"))


def _check(k: int, percent: int) -> None:
    if k < 1 or not 1 <= percent <= 100:
        raise ValueError("shingles have one word or more, and the similarity is 1 to 100 percent")


def keep_one_per_class(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their class; rows without shingles stay, and
    so do rows with a null doc_id. Columns are those of ``docs``; of rows that repeat a doc_id all stay."""
    classes = jaccard_classes(docs, k, percent).where("doc_id is not null")
    first = F.max(F.col("component_id") == F.col("doc_id")).alias("first")
    gone = classes.groupBy("doc_id").agg(first).where("not first").select("doc_id")
    # written first, so that the planner knows its size: while it is under the broadcast threshold, texts stay where they are
    return docs.join(Scratch(docs.sparkSession, "copies").table(gone), "doc_id", "left_anti").select(docs.columns)


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
lists AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS l FROM w),
s AS (SELECT doc_id, unnest(l) AS g FROM lists),
n AS (SELECT doc_id, len(l)::BIGINT AS n FROM lists),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
half AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n
"""
