"""Operators in DataFrame functions: against DuckDB where SQL says the same, and on odd rows."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kinetra.llm import chat, exactdedup, linededup, mixing, queries, skew

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def same(df, con, sql):
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    got = df.select(names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, db, name):
    same(queries.QUERIES[name](spark, SF), db, queries.SQL[name])


ODD = [(1, "same text", "en", "a", 9), (1, "same text", "en", "a", 9), (7, "same text", "en", "b", 9), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "same text", "en", "c", 9), (4, "x" * 100_000, "en", "b", 1), (5, "x" * 99_999 + "y", "en", "b", 1)]


CLASHES = ("recipe", "row", "key", "of", "gone", "_gone", "_doc", "_v", "_version", "version", "at", "a", "b", "n", "_hot", "_cold", "_deal", "_any", "n_lines_removed", "mix_rate", "_s", "name", "begin", "rate", "keep_id", "group_size")


def view(con, rows):
    con.execute("CREATE OR REPLACE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)


@pytest.mark.parametrize("rows", [ODD, []])
def test_documents_with_odd_rows(spark, rows):
    con = duckdb.connect()
    view(con, rows)
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in CLASHES})
    same(exactdedup.exact_groups(docs), con, exactdedup.OP8_SQL)
    cut = linededup.drop_boilerplate(docs)
    same(cut.select("doc_id", "text", "lang", "source", "n_chars", "n_lines_removed"), con, linededup.OP9_SQL)
    assert cut.columns == [c for c in docs.columns if c != "n_lines_removed"] + ["n_lines_removed"] and {r.gone for r in cut.collect()} <= {"clash"}
    mixed = mixing.poisson_mix(docs)
    same(mixed.select("doc_id", "text", "lang", "source", "n_chars", F.round("mix_rate", 9).alias("mix_rate"), "mix_count", "mix_copy", "mix_key"), con, mixing.OP6_SQL)
    assert mixed.columns == [c for c in docs.columns if c != "mix_rate"] + list(mixing.ADDED)
    assert mixing.mixed_documents(docs.drop("mix_rate")).columns == docs.drop("mix_rate").columns


def test_recipes_of_colliding_hashes_stay_apart(spark):
    base = "a line of text, some more words and then so on; " * 40
    rows = [(i, base[: 700 + 40 * i] + t, None, None, None) for i in range(4) for t in ("", "!", "?")] + [(99, base[:700], None, None, None), (100, None, None, None, None), (101, "", None, None, None)]
    con = duckdb.connect()
    view(con, rows)
    docs = spark.createDataFrame(rows, DOCS)
    weak = lambda c: F.pmod(F.length(c), F.lit(3)).cast("long")
    assert not exactdedup.collisions(docs, weak).isEmpty()
    same(exactdedup.exact_groups(docs, weak), con, exactdedup.OP8_SQL)


def test_chunks_join_to_the_text_and_meet_again_after_an_insert(spark):
    r = random.Random(1)
    text = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(1, 9))) for _ in range(12_000))
    both = spark.createDataFrame([(text,), ("some new words " + text,), ("z" * 20_000,)], "text string").select("text", exactdedup.chunks(F.col("text")).alias("c")).collect()
    assert all("".join(r.c) == r.text for r in both)
    assert max(len(c) for r in both for c in r.c) <= exactdedup.LARGEST
    assert len(set(both[0].c) & set(both[1].c)) > 0.8 * len(both[0].c)


def test_boilerplate_keeps_one_place(spark):
    common, local = "this passage stands on many sites", "this passage stands on two sites only"
    rows = [(i, f"own line {i} of the text\n{common}\n{local if i < 6 else 'short'}", "en", f"s{i % 4 if i >= 6 else i % 2}", 1) for i in range(12)]
    got = {r.doc_id: r for r in linededup.drop_boilerplate(spark.createDataFrame(rows, DOCS), min_sites=3).collect()}
    assert [d for d, r in got.items() if common in r.text] == [0]
    assert sum(local in r.text for r in got.values()) == 6 and all("own line" in r.text for r in got.values())
    assert got[3].n_chars == len(got[3].text) and got[3].n_lines_removed == 1


def test_poisson_counts_follow_the_distribution(spark):
    n = 20_000
    for rate in (0.2, 1.0, 5.0):
        r = spark.range(n).select(mixing.poisson_count(F.lit(rate), mixing.unit(F.lit("t"), F.col("id").cast("string"))).alias("k")).agg(F.avg("k"), F.var_pop("k"), F.avg((F.col("k") == 0).cast("int"))).first()
        assert r[0] == pytest.approx(rate, abs=5 * (rate / n) ** 0.5)
        assert r[1] == pytest.approx(rate, rel=0.1)
        assert r[2] == pytest.approx(2.718281828 ** -rate, abs=0.02)


def test_target_weights(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 4 == 0, "small").otherwise("large").alias("source"))
    got = {r.source: r["count"] for r in mixing.poisson_mix(docs, {"small": 1, "large": 1}).groupBy("source").count().collect()}
    assert got["small"] == pytest.approx(2000, rel=0.1) and got["large"] == pytest.approx(2000, rel=0.1)
    assert "large" not in {r.source for r in mixing.poisson_mix(docs, {"small": 1}).collect()}


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_hot_keys_are_joined_alike(spark, monkeypatch, hot):
    """However many keys count as hot, results are those of SQL."""
    monkeypatch.setattr(skew, "HOT", hot)
    r = random.Random(4)
    rows = [(i, f"the passage that many carry\nown {r.randrange(30)}\nfoot {i % 7}", "en", f"s{i % 9}" if i % 3 else "hot", 20) for i in range(120)] + ODD
    rows += [(200 + i, "one text of many", "en", "hot" if i else None, 5) for i in range(40)]
    con = duckdb.connect()
    view(con, rows)
    docs = spark.createDataFrame(rows, DOCS)
    same(exactdedup.exact_groups(docs), con, exactdedup.OP8_SQL)
    same(linededup.drop_boilerplate(docs), con, linededup.OP9_SQL)
    same(mixing.poisson_mix(docs).withColumn("mix_rate", F.round("mix_rate", 9)), con, mixing.OP6_SQL)


def test_mix_is_in_key_order_over_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.lit("s").alias("source"))
    parts = mixing.poisson_mix(docs).select("mix_key").rdd.glom().map(lambda rows: [r.mix_key for r in rows]).collect()
    keys = [k for p in parts for k in p]
    assert keys == sorted(keys) and len(keys) > 2500 and min(map(len, parts)) > 400


def test_mix_sql_at_large_rates(spark):
    rows = [(i, "x" * (4000 if i else 10), None, "large" if i else "rare", 1) for i in range(60)]
    con = duckdb.connect()
    view(con, rows)
    got = mixing.poisson_mix(spark.createDataFrame(rows, DOCS)).withColumn("mix_rate", F.round("mix_rate", 9))
    assert got.agg(F.max("mix_rate")).first()[0] > 100
    same(got, con, mixing.OP6_SQL)


def tree_paths(messages):
    children, roots = {}, []
    ids = {(t, n) for t, n, *_ in messages}
    for m in messages:
        (children.setdefault((m[0], m[2]), []) if m[2] is not None and (m[0], m[2]) in ids else roots).append(m)
    out = []

    def walk(m, path):
        path = [*path, m]
        below = children.get((m[0], m[1]), [])
        if not below:
            out.append(path)
        for c in below:
            walk(c, path)

    for r in roots:
        walk(r, [])
    return out


def test_reply_trees(spark):
    ctl = chat.OPEN + "\\" + chat.CLOSE + "<\\|" + chat.MIDDLE + "\\\\<|"
    messages = [(1, 1, None, "user", "root " + ctl, 1.0), (1, 2, 1, "assistant", ctl, 2.0), (1, 3, 1, "assistant", "other", 5.0), (1, 4, 2, "user", None, None), (1, 5, 4, "assistant", "deep \\", 0.5), (2, 1, 99, "user", "orphan", 1.0), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (None, 1, None, "assistant", "é" + ctl, 1.0), (4, 1, None, None, "", 1.0)]
    messages += [(5, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}", 1.0) for i in range(40)]
    df = spark.createDataFrame(messages, "tree long, node long, parent long, role string, text string, score double")
    got = chat.parsed(chat.format_threads(df)).collect()
    want = {}
    for p in tree_paths([m for m in messages if m[0] != 3]):
        want[p[0][0], p[-1][1]] = p
    assert len(got) == len(want)
    for r in got:
        path = want[r.tree, r.leaf]
        assert [(t.role, t.text) for t in r.turns] == [(m[3] or "", m[4] or "") for m in path]
        assert r.loss == "".join(m[4] or "" for m in path if m[3] == "assistant")
        assert r.score == sum(m[5] or 0 for m in path) and r.n_turns == len(path)
    assert {(r.leaf, r["rank"]) for r in got if r.tree == 1} == {(3, 1), (5, 2)}
    assert chat.format_threads(df.where("false")).count() == 0
    twice = chat.format_threads(df.unionByName(df.limit(5)).withColumn("leaf", F.lit("clash")))
    assert sorted(r.formatted for r in twice.collect()) == sorted(r.formatted for r in got)
    odd = spark.createDataFrame([(1, None, None, "user", "a", 1.0), (1, 1, None, "user", "b", 1.0), (1, 1, None, "assistant", "c", 1.0)], df.schema)
    assert [t.text for r in chat.parsed(chat.format_threads(odd)).collect() for t in r.turns] == ["c"]
