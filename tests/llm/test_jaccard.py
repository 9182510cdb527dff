import random
import re

import numpy as np
import pytest

from kinetra.llm import graph
from kinetra.llm import jaccard as J
from kinetra.llm.graph import components
from kinetra.llm.scratch import Scratch


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    """component_id by doc_id, from all pairs."""
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def near_copies(seed, groups=12, copies=9, longest=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = r.choices(vocabulary, k=40)
    out = []
    for _ in range(groups):
        base = r.choices(vocabulary, k=r.randint(1, longest))
        if r.random() < 0.5:
            base = base + passage
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                at = r.randrange(len(text))
                text[at : at + r.randint(0, 1)] = r.choices(vocabulary, k=r.randint(0, 2))
            out.append(" ".join(text).title() if r.random() < 0.2 else "\n".join(text))
    out += ["", "  \t", "one", "one two", "One  Two", "a b c"]
    return list(enumerate(out, 100))


def random_sets(seed, n=60):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.8:
            base = out[r.integers(len(out))]
            keep = base[r.random(len(base)) > r.choice([0, 0.02, 0.05, 0.08])]
            extra = r.integers(0, 2**63, r.integers(0, max(2, len(base) // 15)), dtype=np.uint64)
            out.append(np.unique(np.concatenate([keep, extra, base[:1]])))
        else:
            out.append(np.unique(r.integers(0, 2**63, r.choice([1, 5, 11, 12, 13, 40, 300]), dtype=np.uint64)))
    return out


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_filters_lose_no_link(percent):
    found = 0
    for seed in range(30):
        sets = random_sets(seed)
        for i, x in enumerate(sets):
            for y in sets[:i]:
                if J.linked(x, y, percent):
                    found += 1
                    common = len(np.intersect1d(J.prefix(x, percent), J.prefix(y, percent)))
                    for s in (x, y):
                        assert common >= J.shared_tokens(J.needed(len(s), percent), percent)
                    assert len(np.intersect1d(J.run_keys(x, percent), J.run_keys(y, percent)))
    assert found > 100


def interleaved(percent, n):
    """Two linked sets whose tokens apart, in hash order, stand as evenly among the common ones as they can."""
    both = J.needed(n, percent)
    while 100 * both < percent * (2 * n - both):
        both += 1
    order, x, y = 0, [], []
    for i in range(both):
        order += 1
        x.append(order), y.append(order)
        if i < n - both:
            x.append(order + 1), y.append(order + 2)
            order += 2
    return (np.array(s, np.uint64) for s in (x, y))


@pytest.mark.parametrize("percent", [1, 5, 20, 50, 60, 70, 73, 75, 80, 85, 90, 95, 99])
def test_filters_hold_for_evenly_spread_tokens(percent):
    for n in range(1, 400):
        x, y = interleaved(percent, n)
        for a, b in ((x, y), (x, y[: max(1, J.needed(n, percent))])):
            if J.linked(a, b, percent):
                assert len(np.intersect1d(J.run_keys(a, percent), J.run_keys(b, percent)))
                common = len(np.intersect1d(J.prefix(a, percent), J.prefix(b, percent)))
                assert all(common >= J.shared_tokens(J.needed(len(s), percent), percent) for s in (a, b))


def test_maps_of_a_tree_are_bounded_by_its_tokens():
    sets = [np.arange(i, i + 15, dtype=np.uint64) for i in range(20_000)] + [np.arange(20_000, dtype=np.uint64)]
    assert J.SignatureTree(sets).levels[0][0].nbytes <= 9 * sum(map(len, sets))


@pytest.mark.parametrize("percent", [80, 90])
def test_all_links(percent):
    sets = random_sets(7, 120)
    want = {(j, i) for i in range(120) for j in range(i) if J.linked(sets[i], sets[j], percent)}
    assert {tuple(sorted(p)) for p in J.join_sets(sets, percent, forest=False)} == want
    side = np.arange(120) % 2
    assert {tuple(sorted(p)) for p in J.join_sets(sets, percent, side, forest=False)} == {p for p in want if side[p[0]] != side[p[1]]}


def test_known_parts_are_not_linked_again():
    sets = random_sets(3, 80)
    assert J.join_sets(sets, 80, parts=np.zeros(80, int)) == []


@pytest.mark.parametrize("percent", [80, 90])
def test_tree_connects_what_links_connect(percent):
    for seed in range(20):
        sets = random_sets(seed, 120)
        root = list(range(len(sets)))

        def find(a, root=root):
            while root[a] != a:
                a = root[a]
            return a

        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if J.linked(x, y, percent):
                    root[find(i)] = find(j)
        own = list(range(len(sets)))
        links = J.join_sets(sets, percent)
        for a, b in links:
            assert J.linked(sets[a], sets[b], percent)
            own[find(a, own)] = find(b, own)
        assert len(links) < len(sets)
        for i in range(len(sets)):
            for j in range(i):
                assert (find(i) == find(j)) == (find(i, own) == find(j, own))


def test_two_sides_find_the_links_between_them():
    sets = random_sets(3, 80)
    side = np.arange(80) % 2
    links = J.join_sets(sets, 80, side)
    assert links and all(side[a] != side[b] for a, b in links)


@pytest.mark.parametrize("k,percent,task_tokens,chunk_keys", [(3, 90, 100_000, 1_000_000), (5, 80, 300, 40), (4, 60, 300, 500)])
def test_classes_match_all_pairs(spark, monkeypatch, k, percent, task_tokens, chunk_keys):
    monkeypatch.setattr(J, "TASK_TOKENS", task_tokens)
    monkeypatch.setattr(J, "CHUNK_KEYS", chunk_keys)
    rows = near_copies(k)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_shingles string").repartition(5)
    got = sorted(map(tuple, J.jaccard_classes(docs, k, percent).collect()))
    assert got == sorted(brute(rows, k, percent))


@pytest.mark.parametrize("task_tokens", [300])
def test_links_match_all_pairs(spark, monkeypatch, task_tokens):
    monkeypatch.setattr(J, "TASK_TOKENS", task_tokens)
    rows = near_copies(11, groups=6)
    least = {}
    for d, t in rows:
        if s := frozenset(shingle_set(t, 3)):
            least[s] = min(d, least.get(s, d))
    want = {tuple(sorted((a, b))) for x, a in least.items() for y, b in least.items() if a < b and 100 * len(x & y) >= 80 * len(x | y)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in J.jaccard_links(docs, 3, 80).collect()]
    assert len(want) > 30 and set(got) == want and len(got) == len(want)
    with pytest.raises(ValueError):
        J.jaccard_links(docs, 3, 0)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (4, "A B C D E F"), (None, "a b c d e f"), (5, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, J.jaccard_classes(docs, 5, 80).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 2, 3), (3, 2, 3), (4, 2, 3), (None, 2, None), (5, 1, 5)], key=str)
    kept = J.keep_one_per_class(docs, 5, 80).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 2, 3, 3, 5, None]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_classes(empty, 5, 80).count() == 0
    assert J.keep_one_per_class(empty).columns == ["doc_id", "text"]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (7, 6), (20, 20)] + [(i, i + 1) for i in range(100, 140)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6} | {i: 100 for i in range(100, 141)}


def roots(edges):
    """Brute force: node -> smallest node of its component."""
    up = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    return up


def test_stars_of_one_task():
    rng = random.Random(3)
    for n, m in ((1, 1), (40, 30), (40, 80), (500, 450)):
        edges = [(a, b) for a, b in ((rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(m)) if a != b]
        node, root = graph.stars(*np.array(edges, np.int64).reshape(-1, 2).T)
        assert dict(zip(node.tolist(), root.tolist())) == {a: r for a, r in roots(edges).items() if a != r}


def test_components_within_tasks_need_no_rounds(spark):
    """A long chain, which rounds of joins alone take many plans for."""
    names = random.Random(4).sample(range(-(10**6), 10**6), 3000)
    scratch = Scratch(spark, "t")
    got = components(spark.createDataFrame(list(zip(names, names[1:])), "u long, v long"), scratch).collect()
    assert sorted(map(tuple, got)) == sorted((x, min(names)) for x in names)
    assert scratch.count <= 2


@pytest.mark.parametrize("chunk", [1_000_000, 1000])
def test_components_in_many_partitions_need_no_rounds(spark, monkeypatch, chunk):
    """Chains dealt over many small partitions, which Spark is told not to merge, are joined by as few tasks as their edges need."""
    monkeypatch.setattr(graph, "CHUNK_EDGES", chunk)
    names = random.Random(6).sample(range(-(10**6), 10**6), 800)
    edges = [*zip(names[:400], names[1:400]), *zip(names[400:], names[401:])]
    random.Random(7).shuffle(edges)
    scratch = Scratch(spark, "t")
    held = {"spark.sql.shuffle.partitions": "31", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, x in held.items():
        spark.conf.set(k, x)
    try:
        got = components(spark.createDataFrame(edges, "u long, v long").repartition(31), scratch).collect()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert sorted(map(tuple, got)) == sorted([(x, min(names[:400])) for x in names[:400]] + [(x, min(names[400:])) for x in names[400:]])
    assert scratch.count <= 2


@pytest.mark.parametrize("chunk", [1, 7])
def test_components_that_span_tasks(spark, monkeypatch, chunk):
    """Chunks give the same edge several times, and a chain and a hub through many of them; each node comes once."""
    monkeypatch.setattr(graph, "CHUNK_EDGES", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    rng = random.Random(5)
    chain = rng.sample(range(1000, 2000), 60)
    edges = [*zip(chain, chain[1:]), *((5000, 5001 + i) for i in range(80)), *((rng.randrange(90), rng.randrange(90)) for _ in range(60))]
    edges = [e for e in edges if e[0] != e[1]]
    try:
        got = components(spark.createDataFrame(edges + edges[::3], "u long, v long").repartition(9), Scratch(spark, "t")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == sorted(roots(edges).items())
