"""A Merkle manifest of a dataset: one tree for each source, and a tree over the sources' roots.

Leaves are put in order by ranges, and each range is cut into indexed blocks. Within a block a stack of peaks grows as a
mountain range does: whenever a run of ``fanout`` nodes of one level is whole, it is taken off and its parent is pushed.
A block begins and ends anywhere, so runs that cross its edges stay as peaks; blocks of a range, then of 64 ranges, and
so on, merge their peaks by the same stack. The last run of a level may be short: it is hashed as it is, without
padding. For proofs, each block takes the few nodes beside its edges that other blocks or merges made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.scratch import Scratch

FANOUT = 3
#: Leaves of a block at most; ranges are at most so many, and a small dataset is cut into ranges of so many leaves.
BLOCK, MOST_RANGES, SMALL_RANGE = 1 << 16, 20_000, 1024
#: Each merge takes the peaks of two to this power of neighbours.
MERGE_BITS = 3

Node = tuple[int, int, str]  # level, index, digest


def hashed(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def widths(total: int, fanout: int = FANOUT) -> list[int]:
    """Nodes by level, from the leaves to the single top."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


def climb(nodes: Iterable[Node], total: int, fanout: int = FANOUT) -> tuple[list[Node], list[Node]]:
    """(nodes made, peaks left) of a stretch of nodes in order, of any levels, of a tree of ``total`` leaves."""
    wide = widths(total, fanout)
    made: list[Node] = []
    stack: list[Node] = []
    for node in nodes:
        stack.append(node)
        while stack[-1][0] < len(wide) - 1:
            level, i, _ = stack[-1]
            first = i - i % fanout
            size = min(fanout, wide[level] - first)
            if i != first + size - 1 or len(stack) < size or stack[-size][:2] != (level, first):
                break
            parent = (level + 1, i // fanout, hashed(n[2] for n in stack[-size:]))
            del stack[-size:]
            made.append(parent)
            stack.append(parent)
    return made, stack


def beside(first: int, end: int, total: int, fanout: int = FANOUT) -> Iterator[tuple[int, int]]:
    """(level, index) of the nodes that proofs of the leaves [first, end) need and that do not lie within them."""
    wide, span = widths(total, fanout), 1
    for level, width in enumerate(wide[:-1]):
        runs = {edge // span // fanout * fanout for edge in (first, end - 1)}
        for i in sorted(i for run in runs for i in range(run, min(run + fanout, width))):
            if i * span < first or min((i + 1) * span, total) > end:
                yield level, i
        span *= fanout


def proofs(first: int, leaves: list[str], total: int, known: dict[tuple[int, int], str], above: list[tuple[str, str]], fanout: int = FANOUT) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in order, (siblings before, siblings after) by level, and then ``above``. ``known`` has the nodes that
    lie beside; steps that a leaf shares with the one before are not made again."""
    at = dict(known)
    at.update(((0, first + k), d) for k, d in enumerate(leaves))
    at.update(((level, i), d) for level, i, d in climb(((0, first + k, d) for k, d in enumerate(leaves)), total, fanout)[0])
    wide = widths(total, fanout)
    places, steps = [-1] * (len(wide) - 1), [("", "")] * (len(wide) - 1)
    for x in range(first, first + len(leaves)):
        i = x
        for level in range(len(steps)):
            if places[level] == i:
                break
            run = i - i % fanout
            places[level] = i
            steps[level] = ("".join(at[level, j] for j in range(run, i)), "".join(at[level, j] for j in range(i + 1, min(run + fanout, wide[level]))))
            i //= fanout
        yield steps + above


def fold(digest: str, steps: list[tuple[str, str]]) -> str:
    for before, after in steps:
        digest = hashed((before, digest, after))
    return digest


# ---- forests ----------------------------------------------------------------------------------

_KEYS = ["pid", "sub"]
_NODE = "tree string, pid int, sub int, total long, level int, idx long, digest string, peak boolean"


def _segments(table: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    """The trees of a block, in order, with their rows."""
    trees = table.column("tree").to_pylist()
    at = 0
    while at < len(trees):
        to = at
        while to < len(trees) and trees[to] == trees[at]:
            to += 1
        yield trees[at], table.slice(at, to - at)
        at = to


def _told(rows: list[tuple]) -> pa.Table:
    names = ["tree", "pid", "sub", "total", "level", "idx", "digest", "peak"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)


class Forest:
    """Trees over ``leaves(tree string, ord, digest, ...)``: each tree's leaves ascend by ``ord``, then by digest.

    ``roots(tree, digest)`` is a table; ``records()`` gives all nodes over the leaves as rows; ``visit`` runs a function over
    blocks with all they need for proofs. Memory is bounded by the block in leaves and by levels in nodes.
    """

    def __init__(self, leaves: DataFrame, scratch: Scratch, fanout: int = FANOUT, block: int = BLOCK) -> None:
        self.scratch, self.fanout = scratch, fanout
        spark = leaves.sparkSession
        n = leaves.count()
        ranges = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SMALL_RANGE)), min(-(-n // block), MOST_RANGES), 1)
        ordered = leaves.repartitionByRange(ranges, "tree", "ord", "digest").sortWithinPartitions("tree", "ord", "digest").withColumn("pid", F.spark_partition_id())

        def number(batches):
            at = 0
            for batch in batches:
                place = list(range(at, at + batch.num_rows))
                at += batch.num_rows
                new = [pa.array([p // block for p in place], pa.int32()), pa.array([p % block for p in place], pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "sub", "place"])

        types = ", ".join(f"`{c}` {t}" for c, t in ordered.dtypes)
        self.ordered = scratch.table(ordered.mapInArrow(number, f"{types}, sub int, place int"))
        sizes = self.ordered.groupBy("tree", "pid", "sub").agg(F.count("*").alias("n"))
        by_range = sizes.groupBy("tree", "pid").agg(F.sum("n").alias("m"))
        of_tree = Window.partitionBy("tree").orderBy("pid")
        by_range = by_range.select("tree", "pid", (F.sum("m").over(of_tree) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("tree")).alias("total"))
        own = F.sum("n").over(Window.partitionBy("tree", "pid").orderBy("sub")) - F.col("n")
        blocks = sizes.select("*", own.alias("own")).join(by_range, ["tree", "pid"])
        self.blocks = scratch.table(blocks.select("tree", "pid", "sub", (F.col("before") + F.col("own")).alias("first"), "n", "total"))
        self._merge()

    def _merge(self) -> None:
        """Peaks of blocks, then of ranges, then of ever more ranges, until each tree has its root."""
        fanout = self.fanout
        climbed = self.scratch.table(self._with_blocks(self.ordered.select("tree", "pid", "sub", "place", "digest"), _first_climb(fanout), _NODE))
        known, shift = [climbed], -1
        while True:
            going = known[-1].where("peak and pow({0}, level) < total".format(fanout))
            if going.isEmpty():
                break
            shift = 0 if shift < 0 else shift + MERGE_BITS
            keyed = going.withColumn("pid", F.shiftright("pid", MERGE_BITS) if shift else F.col("pid")).withColumn("sub", F.lit(0))
            made = keyed.groupBy("tree", "pid").applyInArrow(_next_climb(fanout), _NODE + ", fresh boolean")
            known.append(self.scratch.table(made))
        alike = [k.withColumn("fresh", F.lit(True)) if "fresh" not in k.columns else k for k in known]
        every = alike[0]
        for k in alike[1:]:
            every = every.unionByName(k)
        self.nodes = every.where("fresh").select("tree", "level", "idx", "digest", "total")
        self.roots = self.nodes.where("pow({0}, level) >= total and idx = 0 and (level = 0 or pow({0}, level - 1) < total)".format(fanout)).select("tree", "digest")

    def _with_blocks(self, rows: DataFrame, run: Callable, schema: str) -> DataFrame:
        return rows.groupBy(*_KEYS).cogroup(self.blocks.groupBy(*_KEYS)).applyInArrow(run, schema)

    def records(self) -> DataFrame:
        """``tree, level, idx, digest`` of all nodes over the leaves, from blocks and merges."""
        fanout = self.fanout

        def run(rows: pa.Table, blocks: pa.Table) -> pa.Table:
            return _told([(*n[:6], n[6], n[7]) for n in _block_nodes(rows, blocks, fanout, True)])

        within = self._with_blocks(self.ordered.select("tree", "pid", "sub", "place", "digest"), run, _NODE).where("level > 0 and not peak")
        return within.select("tree", "level", "idx", "digest").unionByName(self.nodes.where("level > 0").select("tree", "level", "idx", "digest"))

    def visit(self, tops: DataFrame, run: Callable, schema: str) -> DataFrame:
        """``run(rows, first, total, known, top)`` for each tree's rows in each block: ``known`` has the nodes beside, ``top``
        is the tree's row of ``tops(tree, ...)`` as a dict. It returns an Arrow table."""
        fanout = self.fanout

        def wanted(batches):
            for batch in batches:
                out = []
                for tree, pid, sub, first, n, total in zip(*(batch.column(c).to_pylist() for c in ("tree", "pid", "sub", "first", "n", "total"))):
                    out += [(tree, pid, sub, level, i) for level, i in beside(first, first + n, total, fanout)]
                if out:
                    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], ["tree", "pid", "sub", "level", "idx"])

        wants = self.blocks.mapInArrow(wanted, "tree string, pid int, sub int, level int, idx long")
        met = wants.join(self.nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])
        met = met.groupBy("tree", *_KEYS).agg(F.collect_list(F.struct("level", "idx", "digest")).alias("known"))  # a few nodes a level
        side = self.blocks.join(met, ["tree", *_KEYS], "left").join(tops, "tree")

        def go(rows: pa.Table, blocks: pa.Table) -> pa.Table:
            of = {b["tree"]: b for b in blocks.to_pylist()}
            out = []
            for tree, own in _segments(rows.sort_by("place")):
                b = of[tree]
                known = {(k["level"], k["idx"]): k["digest"] for k in b["known"] or ()}
                out.append(run(own, b["first"], b["total"], known, b))
            return pa.concat_tables(out)

        return self.ordered.groupBy(*_KEYS).cogroup(side.groupBy(*_KEYS)).applyInArrow(go, schema)


def _block_nodes(rows: pa.Table, blocks: pa.Table, fanout: int, inner: bool) -> Iterator[tuple]:
    of = {b["tree"]: b for b in blocks.to_pylist()}
    for tree, own in _segments(rows.sort_by("place")):
        b = of[tree]
        made, peaks = climb(((0, b["first"] + k, d) for k, d in enumerate(own.column("digest").to_pylist())), b["total"], fanout)
        ends = {p[:2] for p in peaks}
        if inner:
            yield from ((tree, b["pid"], b["sub"], b["total"], *n, False) for n in made if n[:2] not in ends)
        yield from ((tree, b["pid"], b["sub"], b["total"], *p, True) for p in peaks)


def _first_climb(fanout: int) -> Callable:
    def run(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        return _told(list(_block_nodes(rows, blocks, fanout, False)))

    return run


def _next_climb(fanout: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        tree, pid, total = rows[0]["tree"], rows[0]["pid"], rows[0]["total"]
        nodes = sorted(((r["level"], r["idx"], r["digest"]) for r in rows), key=lambda n: n[1] * fanout ** n[0])
        made, peaks = climb(nodes, total, fanout)
        ends = {p[:2] for p in peaks}
        fresh = {n[:2] for n in made}
        out = [(tree, pid, 0, total, *n, False) for n in made if n[:2] not in ends] + [(tree, pid, 0, total, *p, True) for p in peaks]
        return _told(out).append_column("fresh", pa.array([n[4:6] in fresh for n in out], pa.bool_()))

    return run


# ---- the manifest -----------------------------------------------------------------------------

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as byte count, colon and value, or ``-`` for null."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*told), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """``tree, ord, digest, bent``: each row's source as a key that puts null first, its doc_id, its leaf, and the leaf after
    tampering where that differs."""
    fields = [F.col(c) for c in FIELDS]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    bent = F.when(hit, leaf([*fields[:-1], F.replace("text", F.lit("\n"), F.lit(""))]))
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").alias("ord"), leaf(fields).alias("digest"), bent.alias("bent"))


def manifest(docs: DataFrame, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs`` (the columns in ``FIELDS``).

    Leaves of a source ascend by doc_id, null first, rows that repeat a doc_id by leaf. A null source is a source of its
    own and comes first. A row with a null doc_id is not tampered with. Texts of any length are hashed where they are; only
    digests move. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    forest = Forest(scratch.table(leaves_of(docs)), scratch, fanout, block)
    names = forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("ord"), "digest")
    crown = Forest(scratch.table(names), scratch, fanout, block)
    step = "array<struct<before: string, after: string>>"

    def ways(rows: pa.Table, first: int, total: int, known: dict, top: dict) -> pa.Table:
        digests = rows.column("digest").to_pylist()
        steps = [[{"before": b, "after": a} for b, a in s] for s in proofs(first, digests, total, known, [], fanout)]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.table([rows.column("ord"), rows.column("digest"), pa.array([top["root"]] * len(digests), pa.string()), pa.array(steps, kind)], names=["tree", "subroot", "root", "above"])

    tops = crown.visit(crown.roots.withColumnRenamed("digest", "root"), ways, f"tree string, subroot string, root string, above {step}")
    tops = scratch.table(tops)

    def tell(rows: pa.Table, first: int, total: int, known: dict, top: dict) -> pa.Table:
        digests, bents = rows.column("digest").to_pylist(), rows.column("bent").to_pylist()
        above = [(s["before"], s["after"]) for s in top["above"]]
        proof, folded = [], []
        for d, bent, steps in zip(digests, bents, proofs(first, digests, total, known, above, fanout)):
            proof.append(hashed(x for s in steps for x in s))
            folded.append(fold(d if bent is None else bent, steps))
        same = lambda v: pa.array([v] * len(digests), pa.string())
        cols = [rows.column("ord"), rows.column("digest"), same(top["subroot"]), same(top["root"]), pa.array(proof, pa.string()), pa.array(folded, pa.string()), pa.array([f == top["root"] for f in folded], pa.bool_())]
        return pa.table(cols, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = dict(docs.dtypes)["doc_id"]
    return forest.visit(tops, tell, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _levels(name: str, base: str, most: int) -> str:
    """SQL of the levels ``name0, name1, ...`` over ``base(s, i, h)``: nodes with their siblings before and after."""
    out = []
    for k in range(most + 1):
        rows = base if k == 0 else f"SELECT s, i // {FANOUT} AS i, CASE WHEN m > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {name}{k - 1} GROUP BY s, i // {FANOUT}, m"
        run = f"PARTITION BY s, i // {FANOUT} ORDER BY i ROWS BETWEEN"
        out.append(
            f"{name}{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY s) AS m, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, "
            f"coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM ({rows}))"
        )
    return ",\n".join(out)


#: Levels that the SQL writes out: sources of up to 3 ** 11 rows, and up to 3 ** 5 sources. The test tables are smaller.
_DEEP, _TOP = 11, 5
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in FIELDS) + ")"
_BITS = "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: list_prepend(ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0])))), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1)))"
_STEPS = ", ".join([f"CASE WHEN l{k}.m > 1 THEN l{k}.b || ':' || l{k}.a END" for k in range(_DEEP)] + [f"CASE WHEN r{k}.m > 1 THEN r{k}.b || ':' || r{k}.a END" for k in range(_TOP)])
_JOINS = " ".join([f"JOIN l{k} ON l{k}.s = d.s AND l{k}.i = d.i // {FANOUT**k}" for k in range(_DEEP + 1)] + [f"JOIN r{k} ON r{k}.i = o.i // {FANOUT**k}" for k in range(_TOP + 1)])
OP13_SQL = f"""
WITH t AS (SELECT *, coalesce('+' || source, '') AS s, {_LEAF} AS h FROM documents),
d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
  CASE WHEN (xor({_BITS}, 4294967295) & 1) = 0 THEN {_LEAF.replace("text", "replace(text, chr(10), '')")} ELSE h END AS bent FROM t),
{_levels("l", "SELECT s, i, h FROM d", _DEEP)},
o AS MATERIALIZED (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, h FROM l{_DEEP}),
{_levels("r", "SELECT 0 AS s, i, h FROM o", _TOP)},
w AS (SELECT d.doc_id, d.h AS leaf, d.bent, l{_DEEP}.h AS subroot, r{_TOP}.h AS root, list_filter([{_STEPS}], lambda x: x IS NOT NULL) AS steps
  FROM d JOIN o ON o.s = d.s {_JOINS})
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), ':', '')) AS proof_sha256,
  list_reduce(list_prepend(bent, steps), lambda x, y: sha256(split_part(y, ':', 1) || x || split_part(y, ':', 2))) AS folded_root, folded_root = root AS verified
FROM w
"""
