"""Places where operators once did less than the whole job."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetra.llm import avi, linear, linededup, mixing, packing, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_short_lines_on_many_sites_go(spark):
    rows = [(i, f"own line {i}\n\n Share this\r\n\t\r\nLes.\n{'two' if i < 4 else i}", "en", f"s{i % 2 if i < 4 else i}", 1) for i in range(8)]
    got = {r.doc_id: r for r in linededup.drop_boilerplate(spark.createDataFrame(rows, DOCS)).collect()}
    assert [i for i, r in got.items() if "Share" in r.text or "Les." in r.text] == [0]
    assert got[5].text == "own line 5\n\n\t\r\n5" and got[5].n_lines_removed == 2
    assert all("two" in got[i].text for i in range(4))


def test_lines_of_all_lengths_match_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(f"SELECT doc_id, text, n_lines_removed FROM ({linededup.OP9_SQL})").fetchall()
    docs = spark.read.parquet(path)
    got = linededup.drop_boilerplate(docs).select("doc_id", "text", "n_lines_removed").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    short = docs.select("source", F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) between 1 and 19").groupBy(F.trim("line")).agg(F.countDistinct("source").alias("n")).where("n >= 3")
    assert not short.isEmpty()


def test_rare_source_reaches_its_target_weight(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 1000 == 0, "rare").otherwise("large").alias("source"))
    got = {r.source: r for r in mixing.poisson_mix(docs, {"rare": 0.2, "large": 0.8}).groupBy("source").agg(F.count("*").alias("n"), F.max("mix_rate").alias("rate")).collect()}
    assert got["rare"].rate == pytest.approx(200) and got["rare"].n == pytest.approx(4000, abs=5 * 4000**0.5)
    assert got["rare"].n / (got["rare"].n + got["large"].n) == pytest.approx(0.2, abs=0.02)


def test_counts_of_large_rates_follow_the_distribution(spark):
    n = 3000
    for rate in (7.9, 8.1, 50.0, 300.0):
        r = spark.range(n).select(mixing.mix_count(F.lit(rate), "t", F.col("id").cast("string")).alias("k")).agg(F.avg("k"), F.var_pop("k")).first()
        assert r[0] == pytest.approx(rate, abs=5 * (rate / n) ** 0.5)
        assert r[1] == pytest.approx(rate, rel=0.15)


def test_copies_over_a_block_are_numbered_once(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 7)
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b" * 99, "y")], "doc_id long, text string, source string")
    rows = mixing.poisson_mix(docs, {"x": 1, "y": 1}).where("source = 'x'").collect()
    assert len(rows) > 7 and sorted(r.mix_copy for r in rows) == list(range(rows[0].mix_count))


@pytest.mark.parametrize("percent", [10, 40, 50, 60, 90])
def test_chain_reads_the_text_at_any_share_of_toxic_labels(percent):
    r = random.Random(percent)
    words, bad = [f"w{i}" for i in range(400)], ["vile", "nasty", "awful"]
    toxic = np.array([i % 10 < percent // 10 for i in range(900)], int)
    texts = [" ".join(r.choices(words, k=60) + (r.sample(bad, r.randint(1, 2)) if t else [])) for t in toxic]
    rows = list(linear.features(pa.array(texts)))
    weights = toxicity.train_chain(rows[:600], {**toxicity.weak_categories(rows[:600], toxic[:600]), "toxic": toxic[:600]}, toxicity.CHAIN)
    wrong = 0
    for row, t in zip(rows[600:], toxic[600:]):
        before = []
        for w in weights:
            at, x = linear.with_inputs(row, before)
            before.append(float(linear.sigmoid(float(w[at] @ x))))
        wrong += (before[-1] >= toxicity.REJECT) != bool(t)
    assert wrong <= 3


def test_labels_of_one_kind_teach_no_text():
    rows = list(linear.features(pa.array(["some words here"] * 20)))
    for y in (np.zeros(20), np.ones(20)):
        assert not toxicity.telling(*toxicity.counts(rows, y), 20, y.sum()).any()


def test_white_space_of_any_length_is_packed(spark):
    from tokenizers import Tokenizer

    path = packing.public_path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    texts = [c * 1_000_000 for c in (" ", "\n", "\t", "\u3000")] + ["word" + " " * 300_000 + "x", "\n \t" * 300_000, "a" * 1_000_000, " " * packing.LONG_SPACE + "b", " " * (packing.LONG_SPACE - 1) + "b"]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: len(model.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    encode = packing.encoder(path, packing.public_path("byte_bpe_50k.tiktoken"))
    assert all(encode(t) == model.encode(t, add_special_tokens=False).ids for t in texts[4:])


def brute_fit(rows, labels, alpha, beta, l1, l2, epochs, seed, batch):
    """Follow-the-regularised-leader, one weight at a time."""
    z, n = {}, {}

    def weight(i):
        edge = 0.0 if i < linear.RESERVED else l1
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= edge else -(v - (edge if v > 0 else -edge)) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        mixed = order.permutation(len(rows)).tolist()
        for at in range(0, len(rows), batch):
            grad = {}
            for r in mixed[at : at + batch]:
                p = 1 / (1 + math.exp(-sum(weight(i) * x for i, x in rows[r])))
                for i, x in rows[r]:
                    grad[i] = grad.get(i, 0.0) + (p - labels[r]) * x
            for i, g in grad.items():
                w, before = weight(i), n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / alpha * w
                n[i] = before + g * g
    return weight


@pytest.mark.parametrize("rows_n", [7, 120, 1600])
def test_training_matches_a_plain_one(rows_n):
    r = np.random.default_rng(3)
    rows = [(np.sort(r.choice(np.arange(100, 160), 6, replace=False)).astype(np.int32), r.random(6).astype(np.float32)) for _ in range(rows_n)]
    y = np.array([float(at[0] % 3 == 0) for at, _ in rows])
    full = [linear.with_inputs(x, [0.25]) for x in rows]
    w = linear.Ftrl(0.3, 1.0, 0.2, 0.5).fit(full, y, epochs=2, seed=5)
    plain = brute_fit([list(zip(a.tolist(), x.tolist())) for a, x in full], y.tolist(), 0.3, 1.0, 0.2, 0.5, 2, 5, linear.BATCH)
    np.testing.assert_allclose(w[:200], [plain(i) for i in range(200)], rtol=1e-4, atol=1e-6)
    assert (w[100:160] != 0).any()


def test_chain_matches_a_plain_one():
    """Each model gets the out-of-fold probabilities of those before it, from models of two thirds of the rows."""
    r = random.Random(9)
    toxic = np.array([int(i % 4 == 0) for i in range(240)])
    texts = [" ".join(r.choices([f"w{i}" for i in range(60)], k=20) + (r.sample(["vile", "nasty"], r.randint(1, 2)) if t else [])) for t in toxic]
    rows = list(linear.features(pa.array(texts)))
    labels = {**toxicity.weak_categories(rows, toxic), "toxic": toxic}
    got = toxicity.train_chain(rows, labels, toxicity.CHAIN)
    before = []
    for name, w in zip(toxicity.CHAIN, got):
        y = np.asarray(labels[name], float)

        def fit(own, before=before, y=y):
            base = [rows[i] for i in own]
            seen, bad = {}, {}
            for i in own:
                for c in rows[i][0].tolist():
                    seen[c], bad[c] = seen.get(c, 0) + 1, bad.get(c, 0) + y[i]
            n, p = len(own), y[own].sum()

            def keep(c):
                s, b = seen.get(c, 0), bad.get(c, 0)
                cells = [(b, s * p / n), (s - b, s * (n - p) / n), (p - b, (n - s) * p / n), (n - p - s + b, (n - s) * (n - p) / n)]
                return s >= toxicity.TELLING_ROWS and 0 < p < n and 2 * sum(o * math.log(o / e) for o, e in cells if o > 0) >= toxicity.TELLING

            cut = []
            for i, (at, x) in zip(own, base):
                use = [k for k, c in enumerate(at.tolist()) if keep(c)]
                cut.append([(0, 1.0), *((1 + k, float(np.float32(e[i]))) for k, e in enumerate(before)), *((int(at[k]), float(x[k])) for k in use)])
            return brute_fit(cut, y[own].tolist(), 0.5, 1.0, 0.5, 0.1, 10, 7, linear.BATCH)

        whole = fit(np.arange(len(rows)))
        used = np.unique(np.concatenate([at for at, _ in rows]))
        np.testing.assert_allclose(w[used], [whole(int(c)) for c in used], rtol=1e-3, atol=1e-5)
        p = np.zeros(len(rows))
        for k in range(toxicity.FOLDS):
            weight = fit(np.array([i for i in range(len(rows)) if i % toxicity.FOLDS != k]))
            for i in range(k, len(rows), toxicity.FOLDS):
                score = weight(0) + sum(weight(1 + j) * float(np.float32(e[i])) for j, e in enumerate(before)) + sum(weight(int(c)) * float(x) for c, x in zip(*rows[i]))
                p[i] = 1 / (1 + math.exp(-score))
        before = [*before, p]


def test_sample_is_cut_by_features_in_hash_order(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of {i} " * (1 + i % 5), "x") for i in range(60)] + [(7, "again other words", "x")], "doc_id long, text string, size string")
    labels = spark.createDataFrame([(i, 1) for i in range(90)] + [(3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    whole = linear.labelled_rows(docs, labels, ["quality"]).collect()
    assert len(whole) == 61 and {r.quality for r in whole} == {1}
    order = [r.doc_id for r in spark.range(60).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id")).collect()]
    monkeypatch.setattr(linear, "MAX_LABELLED", 30)
    assert {r.doc_id for r in linear.labelled_rows(docs, labels, ["quality"]).collect()} == set(order[:30])
    size = {}
    for r in whole:
        size[r.doc_id] = size.get(r.doc_id, 0) + len(r["at"]) // 4
    monkeypatch.setattr(linear, "MAX_FEATURES", sum(size[i] for i in order[:12]) + 1)
    assert {r.doc_id for r in linear.labelled_rows(docs, labels, ["quality"]).collect()} == set(order[:12])
    monkeypatch.setattr(linear, "MAX_FEATURES", 1)
    assert {r.doc_id for r in linear.labelled_rows(docs, labels, ["quality"]).collect()} == {order[0]}


def test_scratch_folders(spark, tmp_path, monkeypatch):
    from kinetra.llm import scratch

    class Named:
        sparkContext = spark.sparkContext

        class conf:
            @staticmethod
            def get(key, *_):
                return str(tmp_path)

    assert scratch.shared_root(Named) == f"file:{tmp_path}"
    monkeypatch.setattr(scratch, "shared_root", lambda _: f"file:{tmp_path}")
    assert warc.archived(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")).count() == 1

    class Cluster:
        class conf:
            @staticmethod
            def get(*_):
                return None

        class sparkContext:
            master = "yarn"

    monkeypatch.undo()
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_root(Cluster)


def test_feature_of_media_by_hand(spark, tmp_path):
    """Samples by the cosine sum, histograms and shots by their definitions, from the payload alone."""
    texts = ["", "some words " * 900, "é" * 5000, bytes(range(1, 127)).decode() * 90]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    zigzag = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    wave = [[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]
    basis = np.array([[wave[u][x] * wave[v][y] for x in range(8) for y in range(8)] for u, v in zigzag])
    for r in avi.op3_avi(spark, str(tmp_path)).collect():
        raw = texts[r.doc_id].encode()
        raw += b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        hist = []
        for f in range(0, len(raw), 4096):
            count = [0] * 16
            blocks = [raw[b : b + 64] for b in range(f, min(len(raw), f + 4096), 64)]
            for block in blocks:
                values = np.clip(np.rint(np.array([v if v >= 128 else v - 255 for v in block]) @ basis + 128), 0, 255)
                for v in values:
                    count[int(v) // 16] += 1
            count[8] += 64 * (64 - len(blocks))
            hist.append(count)
        starts, gaps = [0], [0.5 * sum(abs(p / 4096 - q / 4096) for p, q in zip(a, b)) for a, b in zip(hist, hist[1:])]
        for i in range(1, len(hist)):
            past = gaps[max(starts[-1], i - 13) : i - 1]
            limit = 0.1 if len(past) < 2 else sum(past) / len(past) + 3 * math.sqrt(sum((g - sum(past) / len(past)) ** 2 for g in past) / len(past))
            if gaps[i - 1] > max(limit, 0.05):
                starts.append(i)
        ends = [*starts[1:], len(hist)]
        assert r.feature == f"frames={len(hist)};clips={','.join(f'{a / 25:.2f}-{b / 25:.2f}' for a, b in zip(starts, ends))};histogram={','.join(str(sum(h[k] for h in hist)) for k in range(16))}"
        assert [(c.clip, c.first_frame, c.frames) for c in r.clips] == [(k, a, b - a) for k, (a, b) in enumerate(zip(starts, ends))]
        assert all(c.start_s == pytest.approx(c.first_frame / 25) and c.end_s == pytest.approx((c.first_frame + c.frames) / 25) for c in r.clips)
    assert avi.with_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_pack(lengths, size):
    """Fill a bin with the longest piece that fits, again and again; then its smallest piece gives way to the two unpacked
    pieces whose sum is largest in the gap it leaves, if that is larger."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own, gap = [], size
        for n in list(left):
            if n <= gap:
                own.append(n)
                left.remove(n)
                gap -= n
        if gap:
            small = own[-1]
            pairs = [(a + b, a) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= gap + small]
            if pairs and max(pairs)[0] > small:
                total, a = max(pairs)
                left.append(small)
                left.remove(a), left.remove(total - a)
                left.sort(reverse=True)
                own[-1:] = [a, total - a]
        bins.append(own)
    return bins


def test_plan_is_best_two_fit():
    r = random.Random(6)
    for _ in range(60):
        size = r.choice([16, 40, 64])
        lengths = [r.randint(1, size) for _ in range(r.randint(1, 60))]
        counts = np.bincount(lengths, minlength=size + 1)
        got = packing.plan(counts, size)
        want = brute_pack(lengths, size)
        assert sorted(n for b, t in got for n in b * t) == sorted(lengths)
        assert sum(t for _, t in got) <= len(want) + 1
        first, _ = got[0]
        assert sum(first) == sum(want[0]) and first[: len(first) - 2] == want[0][: len(first) - 2]


def plain_features(text):
    """The n-grams of a text, one by one: {column: value}."""

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    def word_hash(word):
        total = len(word) * 0xD6E8FEB86659FD93
        for place, byte in enumerate(word):
            total += mix(((place << 8) + byte + 0x9E3779B97F4A7C15) % 2**64)
        return mix(total % 2**64)

    data = (text or "").encode()
    kind = lambda b: "w" if b >= 0x80 or bytes([b]).isalnum() else " " if b == 0x20 or 9 <= b <= 13 else "m"
    runs, at = [], 0
    while at < len(data):
        to = at
        while to < len(data) and kind(data[to]) == kind(data[at]):
            to += 1
        if kind(data[at]) != " ":
            runs.append((kind(data[at]), data[at:to]))
        at = to
    tokens, shapes, before = [], [], None
    for what, word in runs:
        own = word_hash(bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in word))
        upper, small = sum(0x41 <= b <= 0x5A for b in word), sum(0x61 <= b <= 0x7A for b in word)
        case = 0 if upper + small == 0 else (1 if upper == 1 else 2) if small == 0 else 3 if 0x41 <= word[0] <= 0x5A else 4
        tokens.append(own)
        shapes.append(mix(2 * case + (own == before) + 77) if what == "w" else own)
        before = own
    out = {}
    for salt, base, most in ((11, tokens, 2), (12, shapes, 3)):
        for n in range(most):
            for i in range(len(base) - n):
                h = salt
                for k in range(n + 1):
                    h = (mix(h) + base[i + k]) % 2**64
                column = mix((h + n) % 2**64) % (2**linear.BITS - linear.RESERVED) + linear.RESERVED
                out.setdefault((salt, column), 0)
                out[salt, column] += 1
    return sorted((c, 1.0 if s == 11 else math.log(1 + n)) for (s, c), n in out.items())


def test_features_are_the_n_grams_of_the_text():
    r = random.Random(4)
    letters = ["a", "B", "Ab", "the", "THE", "é", "日本", "12", " ", "  ", "\n", "\t", "!", "!?", "_", "x" * 60, "İ"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(30))) for _ in range(150)] + ["", None, "go go Go GO", "x" * 5000]
    for text, (at, x) in zip(texts, linear.features(pa.array(texts))):
        got = sorted(zip(at.tolist(), x.tolist()))
        want = plain_features(text)
        assert [c for c, _ in got] == [c for c, _ in want], ascii(text)
        np.testing.assert_allclose([v for _, v in got], [v for _, v in want], rtol=1e-6)


def test_every_bin_of_a_plan_is_best_two_fit():
    """Bins are made one after the other over what is left, as the plain version makes them; equal bins come together."""
    r = random.Random(8)
    for _ in range(40):
        size = r.choice([12, 30])
        lengths = [r.randint(1, size) for _ in range(r.randint(1, 80))]
        counts = np.bincount(lengths, minlength=size + 1)
        left = counts.copy()
        for bin_, times in packing.plan(counts, size):
            for _ in range(times):
                own, free, gap = [], left.copy(), size
                while (fit := [n for n in range(1, gap + 1) if free[n]]):
                    own.append(fit[-1])
                    free[fit[-1]] -= 1
                    gap -= fit[-1]
                if gap and own:
                    pairs = [(a + b, a, b) for a in range(1, size + 1) for b in range(1, a + 1) if free[a] and free[b] - (a == b) > 0 and a + b <= gap + own[-1]]
                    if pairs and max(pairs)[0] > own[-1]:
                        tight = max(pairs)[0]
                        assert sum(bin_) == sum(own[:-1]) + tight and bin_[: len(own) - 1] == own[:-1] and len(bin_) == len(own) + 1
                    else:
                        assert bin_ == own
                else:
                    assert bin_ == own
                for n in bin_:
                    left[n] -= 1
            assert (left >= 0).all()
        assert not left.any()
