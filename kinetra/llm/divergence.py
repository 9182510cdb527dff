"""Source divergence audit: how far the word shares of each source of a language are from those of other sources.

A byte-level tokenizer works on concatenated UTF-8 buffers: a lookup table of 256 entries finds the boundaries of words,
their XXH64 values group them, and the bytes of each group are compared, so that words are told apart exactly. Counts are
summed by Spark; counts of a block of words are a sparse matrix (rows: sources), and divergences between its rows
are sums over runs of one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.kernel import LOWER, SLAB, U, _spans, slices, text_buffer
from kinetra.llm.scratch import Scratch
from kinetra.llm.skew import join_groups

#: A term stands in this many documents of its language at least; this is added to each count; shares are of this whole.
MIN_DOCS, PRIOR, WHOLE = 30, 5, 1_000_000_000
#: Ranks of single terms that are told.
TOP = 50
#: Bytes of text that are tokenised at once.
WINDOW = 4 << 20
#: A block of the matrix has about so many counts (or as many as pairs of its sources, if these are more), of so many
#: sources against as many.
BLOCK_COUNTS, BLOCK_SOURCES = 1 << 14, 256

#: Bytes between terms: all below 0x80 but letters.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

# The five primes of XXH64 (fixed values).
P1, P2, P3, P4, P5 = map(U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def xxh64(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each slice of the buffer: slices under 32 bytes step by step together, others one by one."""
    size = ends - starts
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(flat) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each place
    four = np.ndarray((len(flat) + 1,), "<u4", padded, strides=(1,))
    h = P5 + size.astype(U)
    at = starts.copy()
    for _ in range(3):
        on = np.flatnonzero(ends - at >= 8)
        if len(on):
            h[on] = _turn(h[on] ^ (_turn(eight[at[on]] * P2, 31) * P1), 27) * P1 + P4
            at[on] += 8
    on = np.flatnonzero(ends - at >= 4)
    h[on] = _turn(h[on] ^ (four[at[on]].astype(U) * P1), 23) * P2 + P3
    at[on] += 4
    for _ in range(3):
        on = np.flatnonzero(ends > at)
        h[on] = _turn(h[on] ^ (flat[at[on]].astype(U) * P5), 11) * P1
        at[on] += 1
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    h ^= h >> U(32)
    for i in np.flatnonzero(size >= 32):
        h[i] = xxhash.xxh64_intdigest(flat[starts[i] : ends[i]])
    return h


def _same(flat: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``a`` are those from ``b``, for each row."""
    out = np.ones(len(a), bool)
    for i in np.flatnonzero(size >= 4096):
        out[i] = np.array_equal(flat[a[i] : a[i] + size[i]], flat[b[i] : b[i] + size[i]])
    rows = np.flatnonzero((size < 4096) & (a != b))
    upto = np.concatenate(([0], np.cumsum(size[rows])))
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + SLAB, "right")) - 1)
        own = rows[at:to]
        begin = upto[at:to] - upto[at]
        place = np.arange(upto[to] - upto[at]) - np.repeat(begin, size[own])
        equal = flat[place + np.repeat(a[own], size[own])] == flat[place + np.repeat(b[own], size[own])]
        out[own] = np.logical_and.reduceat(equal, begin)
        at = to
    return out


def distinct(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, key=xxh64) -> tuple[np.ndarray, np.ndarray]:
    """(slices that stand for each content, number of each slice's content). Grouped by hash, then compared by bytes:
    slices that differ from the one that stands for their hash are grouped anew among themselves."""
    number = np.empty(len(starts), np.int64)
    heads: list[np.ndarray] = []
    left, known = np.arange(len(starts)), 0
    hashes = key(flat, starts, ends)
    while len(left):
        _, first, group = np.unique(hashes[left], return_index=True, return_inverse=True)
        head = left[first]
        other = head[group]
        size = ends[left] - starts[left]
        ok = size == ends[other] - starts[other]
        ok[ok] = _same(flat, starts[left[ok]], starts[other[ok]], size[ok])
        number[left[ok]] = known + group[ok]
        heads.append(head)
        known += len(head)
        left = left[~ok]
    return np.concatenate(heads) if heads else np.zeros(0, np.int64), number


def _gather(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices' bytes one after the other, and their offsets."""
    size = ends - starts
    offsets = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return flat[place], offsets


def _long_text(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, counts) of the distinct terms of one text of any length, window by window."""
    data, sizes, counts, at = [], [], [], 0
    while at < len(flat):
        to = min(at + WINDOW, len(flat))
        while to < len(flat) and not BETWEEN[flat[to]]:  # a window ends at a boundary
            gap = np.flatnonzero(BETWEEN[flat[to : to + WINDOW]])
            to = to + int(gap[0]) if len(gap) else min(to + WINDOW, len(flat))
        part = LOWER[flat[at:to]]
        starts, ends = _spans(part, np.array([0, len(part)]), BETWEEN)
        head, number = distinct(part, starts, ends)
        own, offsets = _gather(part, starts[head], ends[head])
        data.append(own)
        sizes.append(np.diff(offsets))
        counts.append(np.bincount(number, minlength=len(head)))
        at = to
    joined, size, count = np.concatenate(data), np.concatenate(sizes), np.concatenate(counts)
    ends = np.cumsum(size)
    head, number = distinct(joined, ends - size, ends)
    own, offsets = _gather(joined, (ends - size)[head], ends[head])
    return own, offsets, np.bincount(number, count, len(head)).astype(np.int64)


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def tally(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` of the batch's rows ``text, lang, source``: occurrences of each term, and rows with it."""
    flat, offsets = text_buffer(batch.column("text"))
    pairs = pa.StructArray.from_arrays([batch.column("lang").cast(pa.string()), batch.column("source").cast(pa.string())], ["lang", "source"])
    named: dict[tuple, int] = {}
    group = np.array([named.setdefault((r["lang"], r["source"]), len(named)) for r in pairs.to_pylist()], np.int64)
    names = list(named)

    def told(g: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        lang, source = (pa.array([x[i] for x in names], pa.string()).take(pa.array(g)) for i in (0, 1))
        return pa.RecordBatch.from_arrays([lang, source, terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    if len(group) == 1 and len(flat) > WINDOW:
        data, at, n = _long_text(flat)
        if len(n):
            yield told(np.zeros(len(n), np.int64), _strings(data, at), n, np.ones(len(n), np.int64))
        return
    flat = LOWER[flat]
    starts, ends = _spans(flat, offsets, BETWEEN)
    if not len(starts):
        return
    head, number = distinct(flat, starts, ends)
    row = np.searchsorted(offsets, starts, "right") - 1
    in_row, n = np.unique(row * len(head) + number, return_counts=True)
    key, place = np.unique(group[in_row // len(head)] * len(head) + in_row % len(head), return_inverse=True)
    term = key % len(head)
    data, at = _gather(flat, starts[head[term]], ends[head[term]])
    yield told(key // len(head), _strings(data, at), np.bincount(place, n, len(key)).astype(np.int64), np.bincount(place, minlength=len(key)))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` of ``docs(text, lang, source, ...)``, each term once; nulls are read as ''."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in slices(batches, most=WINDOW):
            own = int(text_buffer(batch.column("text"))[1][-1])
            if held and size + own > WINDOW:
                yield from tally(_joined(held))
                held, size = [], 0
            held.append(batch)
            size += own
        if held:
            yield from tally(_joined(held))

    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def share(count: str, total: str) -> Column:
    """1 + floor(10^9 * count / total) in whole numbers: a division by hand, three digits at a time, which no count overflows."""
    rest, out = f"({count})", "0L"
    for _ in range(3):
        out = f"({out} * 1000L + ({rest} * 1000L) div ({total}))"
        rest = f"(({rest} * 1000L) % ({total}))"
    return F.expr(f"1L + {out}")


def apart(a, b, width: int) -> Iterator[np.ndarray]:
    """For each row s of the sparse matrix ``a``, its sums to the rows o of ``b``: of |p_s - p_o| - |d_s - d_o| over the columns
    where either has a count. A matrix is (row pointers, columns, values p, each row's value d where it has no count)."""
    pointer, columns, values, rest = a
    edge, at, p, d = b
    filled = np.flatnonzero(np.diff(edge))  # sums over runs take no empty run
    own_rest = np.repeat(d, np.diff(edge))
    for k in range(len(rest)):
        own = slice(pointer[k], pointer[k + 1])
        x = np.full(width, rest[k], np.int64)
        x[columns[own]] = values[own]
        there = x[at]
        out = np.zeros(len(d), np.int64)
        if len(filled):
            out[filled] = np.add.reduceat(np.abs(p - there) - np.abs(own_rest - there), edge[filled])
        ordered = np.sort(values[own])
        upto = np.concatenate(([0], np.cumsum(ordered)))
        below = np.searchsorted(ordered, d)
        out += below * d - upto[below] + (upto[-1] - upto[below]) - (len(ordered) - below) * d
        yield out - len(ordered) * np.abs(d - rest[k])


def _block(table: pa.Table, per: int) -> pa.Table:
    """Corrections ``lang, s, o, value`` of one block of terms between two blocks of ``per`` sources; a row without a term names
    a source of the blocks."""
    table = table.combine_chunks()
    sid, rest = table.column("sid").to_numpy(), table.column("rest").to_numpy()
    real = table.column("term").is_valid().to_numpy()
    term = table.column("term").filter(pa.array(real)).combine_chunks().dictionary_encode()
    counts = (sid[real], term.indices.to_numpy(), table.column("p").filter(pa.array(real)).to_numpy())
    first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()

    def matrix(side: int):
        ids, at = np.unique(np.where(real | (sid // per != side), -1, sid), return_index=True)
        ids, at = ids[ids >= 0], at[ids >= 0]
        own = np.flatnonzero(counts[0] // per == side)
        own = own[np.argsort(counts[0][own], kind="stable")]
        pointer = np.append(np.searchsorted(counts[0][own], ids), len(own))
        return ids, (pointer, counts[1][own], counts[2][own], rest[at])

    (s_ids, a), (o_ids, b) = matrix(first), matrix(second)
    value = np.concatenate([np.zeros(0, np.int64), *apart(a, b, len(term.dictionary))])
    s, o = np.repeat(s_ids, len(o_ids)), np.tile(o_ids, len(s_ids))
    if first != second:
        s, o, value = np.concatenate([s, o]), np.concatenate([o, s]), np.concatenate([value, value])
    lang = pa.array([table.column("lang")[0].as_py()] * len(s), pa.string())
    return pa.table([lang, pa.array(s, pa.int64()), pa.array(o, pa.int64()), pa.array(value, pa.int64())], names=["lang", "s", "o", "value"])


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block_counts: int = BLOCK_COUNTS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs(text, lang, source, ...)``.

    Part ``pair``: the sum of differences of word shares from each other source of the language; part ``term``: the ``top``
    terms of a source whose share exceeds the language's. Ranks go by value from the largest, then by item. Nulls count
    as ''; repeated rows count each; other columns are ignored; texts of any length are read whole; a language without kept
    terms has pairs of value 0; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    counts = scratch.table(term_counts(docs))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("in_docs")).where(F.col("in_docs") >= min_docs)
    terms = scratch.table(terms.select("lang", "term", "all_n"))
    kept = scratch.table(counts.select("lang", "term", "source", "n").join(terms, ["lang", "term"]))
    scratch.drop(counts)
    # sources, few against terms: their totals, numbers and shares of a term without a count
    names = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).groupBy("lang", "source").agg(F.lit(1).alias("_one")).drop("_one")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_total"), F.count("*").alias("own_terms"))
    langs = terms.groupBy("lang").agg(F.sum("all_n").alias("all_total"), F.count("*").alias("v"))
    groups = names.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["own_total", "own_terms", "all_total", "v"])
    groups = groups.withColumn("whole", F.greatest(F.expr(f"own_total + {PRIOR} * v"), F.lit(1))).withColumn("all_whole", F.greatest(F.expr(f"all_total + {PRIOR} * v"), F.lit(1)))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    of_lang = Window.partitionBy("lang")
    per_block = F.greatest(F.lit(block_counts), F.pow(F.least(F.lit(block_sources), F.count("*").over(of_lang)), F.lit(2)))
    blocks = F.greatest(F.lit(1), F.ceil(F.sum("own_terms").over(of_lang) / per_block))
    groups = scratch.table(groups.select("*", number.cast("long").alias("sid"), F.count("*").over(of_lang).alias("n_sources"), blocks.cast("long").alias("blocks"), share(str(PRIOR) + "L", "whole").alias("rest")))
    total = groups.agg(F.sum("own_terms")).first()[0] or 0
    known = join_groups(kept, groups, ["lang", "source"], "own_terms", total, ["term"])
    known = known.select("lang", "source", "term", "sid", "rest", "blocks", "n_sources", share(f"n + {PRIOR}", "whole").alias("p"), share(f"all_n + {PRIOR}", "all_whole").alias("q"))
    known = scratch.table(known)

    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    over = known.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("p - q").alias("value"))
    over = over.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)

    # blocks of terms and, within them, of sources against sources
    last = F.expr(f"(n_sources - 1) div {block_sources}")
    side = F.expr(f"sid div {block_sources}")
    sides = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda other: F.named_struct(F.lit("i"), F.least(side, other), F.lit("j"), F.greatest(side, other)))
    cells = known.select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "sid", "rest", "term", "p", F.explode(sides).alias("_s"))
    stubs = groups.where("v > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "sid", "rest", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), sides.alias("_s"))
    stubs = stubs.select("lang", "block", "sid", "rest", "term", "p", F.explode("_s").alias("_s"))
    cells = cells.unionByName(stubs).select("lang", "block", "_s.i", "_s.j", "sid", "rest", "term", "p")
    made = cells.groupBy("lang", "block", "i", "j").applyInArrow(lambda table: _block(table, block_sources), "lang string, s long, o long, value long")
    corrections = made.where("s <> o").groupBy("lang", "s", "o").agg(F.sum("value").alias("more"))
    one = groups.select("lang", "source", F.col("sid").alias("s"), F.col("rest").alias("rest_s"), "v")
    two = groups.select("lang", F.col("source").alias("item"), F.col("sid").alias("o"), F.col("rest").alias("rest_o"))
    pairs = one.join(two, "lang").where("s <> o").join(corrections, ["lang", "s", "o"], "left")
    value = F.coalesce("more", F.lit(0).cast("long")) + F.col("v") * F.abs(F.col("rest_s") - F.col("rest_o"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(place))
    return over.unionByName(pairs)


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_P = "(1 + ({c}::HUGEINT + {prior}) * {whole} // ({n}::HUGEINT + {prior} * v))::BIGINT"
OP11_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT rid, lang, source, term, count(*) AS n FROM (
  SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS all_n FROM w GROUP BY ALL HAVING count(*) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(all_n) AS all_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, sum(n) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT g.lang, g.source, l.v, l.all_total, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = g.lang AND c.source = g.source) AS total FROM g JOIN l USING (lang)),
p AS MATERIALIZED (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, {_P.format(c="coalesce(c.n, 0)", n="t.total", prior=PRIOR, whole=WHOLE)} AS p,
    {_P.format(c="k.all_n", n="t.all_total", prior=PRIOR, whole=WHOLE)} AS q
  FROM t JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= {TOP}
"""
