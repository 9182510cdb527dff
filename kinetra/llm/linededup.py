"""Line dedup by distinct-site spread, with DataFrame functions only.

For each line hash, one aggregation counts rows and merges a HyperLogLog sketch of the sites. Lines
whose estimate is near the threshold get an exact distinct count, so the decision is exact there and
far from it the sketch's error can't change it. A line on enough sites is boilerplate: it goes
everywhere but where it stands first (smallest doc_id, then place), so no content is lost wholly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.llm.scratch import Scratch
from kinetra.llm.skew import join_groups, numbered

#: A line on this many distinct sites is boilerplate.
MIN_SITES = 3
LG_K = 11
#: Estimates within this share of the threshold get exact counts: about six standard errors at LG_K.
NEAR = 0.15


def line_key(line: Column) -> Column:
    """Two 64-bit hashes of the trimmed line; together they stand for the line."""
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _lines(docs: DataFrame) -> DataFrame:
    at = docs.select("doc_id", F.xxhash64("text").alias("version"), "source", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return at.where(F.col("line").rlike(r"\S")).select("doc_id", "version", "source", "at", line_key(F.col("line")).alias("key")).select("doc_id", "version", "source", "at", "key.a", "key.b")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``(a, b, n)``: keys of lines on at least ``min_sites`` distinct sites, and the number of their places on sites.
    Null sites don't count."""
    lines = _lines(docs).where("source is not null").select("a", "b", "source", "doc_id")
    sketch = lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.hll_sketch_agg("source", F.lit(LG_K)).alias("sites")).where(F.col("n") >= min_sites)
    guess = Scratch(docs.sparkSession, "sites").table(sketch.select("a", "b", "n", F.hll_sketch_estimate("sites").alias("n_sites")))
    far = guess.where(F.col("n_sites") > min_sites * (1 + NEAR)).select("a", "b", "n")
    near = guess.where(F.col("n_sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR))).select("a", "b", "n")
    met = join_groups(lines, near, ["a", "b"], "n", _places(guess), ["doc_id"]).where("n is not null")
    exact = met.select("a", "b", "n", "source").distinct().groupBy("a", "b").agg(F.max("n").alias("n"), F.count("*").alias("n_sites"))
    return far.unionByName(exact.where(F.col("n_sites") >= min_sites).select("a", "b", "n"))


def _places(keys: DataFrame) -> int:
    return keys.agg(F.sum("n")).first()[0] or 0


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, ``n_chars`` (where there is one) made new where a line
    went, plus ``n_lines_removed``, which replaces a column of that name. No document goes, also where no line is
    left (its text is then empty).

    A line of any length that is not blank is boilerplate when its trimmed form stands in documents of
    ``min_sites`` distinct sources; its first place (smallest doc_id, place, null doc_id last) keeps
    it. Blank lines stay. Null text stays null. Rows that repeat a doc_id with another text are told apart
    by text; wholly repeated rows are treated alike. Other columns are kept, whatever their names. An empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    flagged = scratch.table(boilerplate(docs, min_sites))
    hits = scratch.table(join_groups(_lines(docs).select("a", "b", "doc_id", "version", "at"), flagged, ["a", "b"], "n", _places(flagged), ["doc_id", "at"]).where("n is not null").drop("n"))
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), F.col("at").alias("z"), F.col("version").alias("v"))
    first = hits.groupBy("a", "b").agg(F.min(order).alias("first")).select(F.col("first.y").alias("doc_id"), F.col("first.v").alias("version"), F.col("first.z").alias("at"))
    # a document's places and those of them that come first meet by document, not by line
    both = hits.select("doc_id", "version", F.col("at").alias("hit"), F.lit(None).cast("int").alias("keep")).unionByName(first.select("doc_id", "version", F.lit(None).cast("int").alias("hit"), F.col("at").alias("keep")))
    places = both.groupBy("doc_id", "version").agg(F.array_except(F.collect_set("hit"), F.collect_set("keep")).alias("gone")).where(F.size("gone") > 0)
    places = scratch.table(places.select(F.struct("doc_id", "version").alias("key"), "gone"))  # written, so that the planner knows its size
    held, new = numbered(docs)
    text = F.col(new["text"])
    keyed = held.withColumn("key", F.struct(F.col(new["doc_id"]).alias("doc_id"), F.xxhash64(text).alias("version")))
    joined = keyed.join(places.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left")
    cut = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n")
    made = {"text": cut, "n_chars": F.length(cut).cast("long")}
    columns = [(F.when(F.col("gone").isNull(), F.col(n)).otherwise(made[c]) if c in made else F.col(n)).alias(c) for c, n in new.items() if c.lower() != "n_lines_removed"]
    return joined.select(*columns, F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_lines_removed"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return drop_boilerplate(docs)


OP9_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM documents),
l AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
t AS (SELECT *, trim(line, ' ') AS k FROM l),
bad AS (SELECT k FROM t WHERE regexp_matches(k, '[^ \t\n\v\f\r]') GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT t.*, bad.k IS NOT NULL AND rank() OVER (PARTITION BY t.k ORDER BY t.doc_id NULLS LAST, t.pos) > 1 AS gone FROM t LEFT JOIN bad USING (k)),
s AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS cut, count(*) FILTER (WHERE gone) AS n FROM m GROUP BY rid)
SELECT d.doc_id, coalesce(s.cut, d.text) AS text, d.lang, d.source,
  CASE WHEN s.n > 0 THEN length(s.cut) ELSE d.n_chars END::BIGINT AS n_chars, coalesce(s.n, 0)::INT AS n_lines_removed
FROM d LEFT JOIN s USING (rid)
"""
