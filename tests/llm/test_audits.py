"""Source divergence, token counts and the Merkle manifest against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinetra.llm import divergence, merkle, tokencount
from kinetra.llm.packing import public_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# ---- divergence -------------------------------------------------------------------------------


def plain_divergence(rows, least, top):
    """The definition, in Python's integers."""
    words = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, count = Counter(), {}
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = Counter(w.translate(lower) for w in words.findall(text or ""))
        count.setdefault((lang, source), Counter()).update(found)
        docs.update((lang, w) for w in found)
    out = []
    for lang in {g[0] for g in count}:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= least]
        own = {s: c for (x, s), c in count.items() if x == lang}
        share = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for w in kept}
        p = {s: share(c) for s, c in own.items()}
        q = share(sum(own.values(), Counter()))
        for s in own:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in own if o != s]
            terms = [(q[w] - p[s][w], w) for w in kept if own[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, -v, rank))
    return sorted(out)


def random_docs(n, seed, sources=5):
    r = random.Random(seed)
    words = ["the", "THE", "Öl", "été", "naïve", "x", "日本", "İ", "word" * 20, *(f"w{chr(97 + i)}" for i in range(25))]
    text = lambda: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "5", "_"]) for _ in range(r.randrange(40)))
    return [(i, r.choice([text(), text(), text(), None, ""]), r.choice(["en", "de", None]), r.choice([*(f"s{k}" for k in range(sources)), "é", None]), 1) for i in range(n)]


@pytest.mark.parametrize("blocks", [(), (20, 2)])
def test_divergence_equals_the_definition(spark, blocks):
    rows = random_docs(300, 1) + [(900, None, "xx", "lonely", 1), (901, "rare words", "yy", "a", 1), (902, None, "yy", "b", 1)]
    rows += rows[:40]
    docs = spark.createDataFrame(rows, DOCS).withColumn("term", F.lit(1)).withColumn("value", F.lit("v"))
    got = sorted(tuple(r) for r in divergence.divergences(docs, 12, 3, *blocks).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_divergence(rows, 12, 3)
    assert ("yy", "a", "pair", "b", 0, 1) in got


def test_divergence_of_no_rows(spark):
    assert divergence.divergences(spark.createDataFrame([], DOCS)).count() == 0


def test_xxh64_is_the_library_s():
    r = random.Random(2)
    data = r.randbytes(4000)
    starts = np.array([r.randrange(3900) for _ in range(2000)])
    ends = starts + np.array([r.randrange(90) for _ in range(2000)])
    want = [xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(starts, ends)]
    assert divergence.xxh64(np.frombuffer(data, np.uint8), starts, ends).tolist() == want


def test_contents_are_told_apart_where_hashes_collide():
    data = np.frombuffer(b"ab ba ab cd abc ba", np.uint8)
    starts, ends = divergence._spans(data, np.array([0, len(data)]), divergence.BETWEEN)
    for key in (divergence.xxh64, lambda flat, s, e: np.zeros(len(s), np.uint64), lambda flat, s, e: (e - s).astype(np.uint64)):
        head, number = divergence.distinct(data, starts, ends, key)
        words = ["ab", "ba", "ab", "cd", "abc", "ba"]
        assert [words[head[n]] for n in number] == words and len(head) == 4


def test_one_long_text_is_tallied_window_by_window(monkeypatch):
    r = random.Random(5)
    text = " ".join(r.choice(["alpha", "Beta", "gämma", "x" * 300, "delta-delta"]) for _ in range(3000))
    batch = pa.RecordBatch.from_pydict({"text": [text], "lang": ["en"], "source": ["s"]})
    want = {t["term"]: t for t in next(divergence.tally(batch)).to_pylist()}
    monkeypatch.setattr(divergence, "WINDOW", 1000)
    got = {t["term"]: t for t in next(divergence.tally(batch)).to_pylist()}
    assert got == want and want["delta"]["docs"] == 1 and len(want) == 5


def test_shares_of_large_counts_do_not_overflow(spark):
    cases = [(5, 10**15 + 7), (10**15, 10**15 + 5), (999_999_999_999_937, 3 * 10**15), (0, 1)]
    for c, n in cases:
        assert spark.range(1).select(divergence.share(f"{c}L", f"{n}L")).first()[0] == 1 + 10**9 * c // n


# ---- tokens -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(tokencount.offline(public_path("word_bpe_49k.json")))


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False))


def test_tokens_of_all_code_points(counter, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("b{0}b", "{0}", "5{0}{0}'s"):
        for k in range(0, len(points), 8000):
            text = " ".join(form.format(c) for c in points[k : k + 8000])
            assert counter(text) == library(text), (form, k)


def test_tokens_of_random_texts(counter, library):
    r = random.Random(7)
    letters = [*map(chr, range(0x20, 0x180)), *"'''sStTrReEvVlLmMdD  \n\t\r\x1c\x85\xa0　İΣςǅﬁ①Ⅷ½٣日本😀", *map(chr, (0x300, 0x327, 0x345, 0x2F800, 0x1F3FB, 0xAC00, 0x1161))]
    for _ in range(5000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(40)))
        if r.random() < 0.3:
            text += r.choice(["<|endoftext|>", "<|startoftext|><|endoftext|>", "<|endoftext|", "<|EndOfText|>"]) + text[:7]
        assert counter(text) == library(text), ascii(text)


def test_tokens_of_parts_and_full_tables(counter, library, monkeypatch):
    text = " ".join(f"word{i} naïve don't é́ {i}" for i in range(400))
    monkeypatch.setattr(tokencount, "PART", 50)
    monkeypatch.setattr(tokencount, "KEPT_WORDS", 10)
    assert counter(text) == library(text)
    assert len(counter.costs) <= 10 + len(counter.costs.one)
    assert counter("x" * 30_000) == library("x" * 30_000)


def test_whole_tokens_are_one_token_each(counter, library):
    some = sorted(counter.costs.one)[::40]
    assert len(counter.costs.one) > 30_000 and all(library(w) == 1 for w in some)


def test_token_counts_of_odd_rows(spark, library):
    rows = [(1, "A word", "en", "s", 1), (1, "A word", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "héllo <|endoftext|>", "fr", "s", 1), (4, "tok " * 3000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("x")).withColumn("n_bytes", F.lit(0))
    got = sorted(map(tuple, tokencount.count_tokens(docs).collect()), key=str)
    want = [(d, len((t or "").encode()), n := library(t or ""), n > 2048) for d, t, *_ in rows]
    assert got == sorted(want, key=str)
    assert tokencount.count_tokens(spark.createDataFrame([], DOCS)).count() == 0


# ---- Merkle -----------------------------------------------------------------------------------


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(doc, text, lang, source, n):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def plain_tree(leaves, fanout):
    """(root, siblings (before, after) of each leaf by level)."""
    level, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for p, i in zip(paths, at):
            run, k = runs[i // fanout], i % fanout
            p.append(("".join(run[:k]), "".join(run[k + 1 :])))
        at = [i // fanout for i in at]
        level = [H("".join(r)) for r in runs]
    return level[0], paths


def plain_manifest(rows, fanout):
    trees = {}
    for doc, text, lang, source, n in rows:
        bent = text.replace("\n", "") if text and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text
        trees.setdefault(source, []).append((doc is not None, doc or 0, plain_leaf(doc, text, lang, source, n), plain_leaf(doc, bent, lang, source, n), doc))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subs = [(sorted(trees[s]), plain_tree([x[2] for x in sorted(trees[s])], fanout)) for s in order]
    if not subs:
        return []
    root, above = plain_tree([sub for _, (sub, _) in subs], fanout)
    out = []
    for (leaves, (sub, paths)), top in zip(subs, above):
        for (_, _, leaf, bent, doc), own in zip(leaves, paths):
            steps, folded = own + top, bent
            for before, after in steps:
                folded = H(before + folded + after)
            out.append((doc, leaf, sub, root, H("".join(x for s in steps for x in s)), folded, folded == root))
    return sorted(out, key=str)


def merkle_docs(n, seed):
    r = random.Random(seed)
    source = lambda: r.choice(["hot"] * 10 + [None, "", "é", "z", *(f"s{i}" for i in range(6))])
    return [(r.choice([i, i, i, i // 2, None]), r.choice(["a\nb", "ç\n\n", "", None, f"text {i}"]), r.choice(["en", None]), source(), r.choice([i, None])) for i in range(n)]


@pytest.mark.parametrize("n, fanout, block, size, bits", [(0, 3, 9, 9, 6), (1, 3, 9, 9, 6), (200, 3, 7, 20, 6), (700, 3, 1 << 16, 10, 2), (400, 2, 5, 30, 1), (300, 4, 64, 1024, 6)])
def test_manifest_equals_the_definition(spark, monkeypatch, n, fanout, block, size, bits):
    monkeypatch.setattr(merkle, "SMALL_RANGE", size)
    monkeypatch.setattr(merkle, "MERGE_BITS", bits)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40" if n == 700 else before)
    try:
        rows = merkle_docs(n, n)
        docs = spark.createDataFrame(rows, DOCS).withColumn("tree", F.lit(1)).withColumn("digest", F.lit("x"))
        got = sorted(map(tuple, merkle.manifest(docs, fanout, block).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_manifest(rows, fanout)


def test_node_records_are_all_nodes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SMALL_RANGE", 25)
    leaves = [("+a", i, H(str(i))) for i in range(130)] + [("+b", 1, H("b"))]
    forest = merkle.Forest(spark.createDataFrame(leaves, "tree string, ord long, digest string"), merkle.Scratch(spark, "t"), 3, 10)
    want, level, k = {}, [H(str(i)) for i in range(130)], 0
    while len(level) > 1:
        level, k = [H("".join(level[i : i + 3])) for i in range(0, len(level), 3)], k + 1
        want |= {("+a", k, i): h for i, h in enumerate(level)}
    got = [tuple(r) for r in forest.records().collect()]
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == want
    assert dict(map(tuple, forest.roots.collect())) == {"+a": level[0], "+b": H("b")}


def test_a_stack_climbs_from_any_edge():
    for total in (1, 2, 3, 4, 9, 10, 28, 100):
        leaves = [H(str(i)) for i in range(total)]
        for a in range(0, total, 7):
            made, peaks = merkle.climb(((0, i, leaves[i]) for i in range(a, total)), total)
            rest = merkle.climb(((0, i, leaves[i]) for i in range(a)), total)[1]
            top = merkle.climb(rest + peaks, total)[1]
            assert top == [(len(merkle.widths(total)) - 1, 0, plain_tree(leaves, 3)[0])]
