"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's mean repetition rate is its target share of the characters over its present share. A
document's count inverts the Poisson distribution at a uniform number hashed from the seed and its
doc_id; for a large rate it is a sum of independent counts of equal, smaller rates. The document is
exploded by its count, and all copies are sorted by a hash over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.llm.scratch import Scratch
from kinetra.llm.skew import join_groups, numbered

SEED = "mix-1"
#: Target shares are present shares to this power, made to sum to 1: large sources give way to small ones.
TEMPERATURE = 0.5
#: One draw ends here: a Poisson count over it has a chance below 1e-30 at the largest rate of one draw.
MOST, LARGEST_RATE = 64, 8.0
#: Copies that one array numbers at most.
BLOCK = 1 << 16
#: Columns that a mix adds.
ADDED = ("mix_rate", "mix_count", "mix_copy", "mix_key")
_TWO52 = float(1 << 52)


def unit(*parts: Column) -> Column:
    """A uniform number in [0, 1) of 52 bits, from the md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(_TWO52)


def poisson_count(rate: Column, u: Column) -> Column:
    """Smallest k with P(X <= k) > u, for X of a Poisson distribution with mean ``rate``."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        return F.when(s["cdf"] > u, s).otherwise(F.struct(i.cast("int").alias("k"), p.alias("p"), (s["cdf"] + p).alias("cdf")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, step, lambda s: s["k"])


def mix_count(rate: Column, seed: str, name: Column) -> Column:
    """A Poisson count for any rate: the sum of as few draws as keep each one's rate at ``LARGEST_RATE``
    or less. The only draw of a small rate is hashed from seed and name, further ones from their number, too."""
    draws = F.ceil(rate / F.lit(LARGEST_RATE)).cast("int")
    first, small = unit(F.lit(seed), name), rate <= LARGEST_RATE

    def add(total: Column, i: Column) -> Column:
        return total + poisson_count(rate / draws, unit(F.lit(seed), F.lit("draw"), i.cast("string"), name))

    return F.when(small, poisson_count(rate, first)).otherwise(F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), add))


def rates(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, budget: float = 1.0) -> DataFrame:
    """``(source, rate, n)``: ``budget`` times target share over present share of the characters, however
    large, and the number of documents. ``targets`` are weights by source (others get 0); without them, shares to the
    power ``temperature``. A null source is a source of its own; one without characters gets rate 1."""
    scratch = Scratch(docs.sparkSession, "mix")
    size = scratch.table(docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("chars"), F.count("*").alias("n")))
    total = size.agg(F.sum("chars")).first()[0] or 1.0
    share = size.withColumn("share", F.col("chars") / F.lit(total))
    if targets is None:
        weight = F.pow("share", F.lit(temperature))
    elif not targets:
        weight = F.lit(0.0)
    else:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col("source")), F.lit(0.0))
    share = share.withColumn("weight", weight)
    whole = share.agg(F.sum("weight")).first()[0] or 1.0
    rate = F.lit(budget) * F.col("weight") / F.lit(whole) / F.nullif(F.col("share"), F.lit(0.0))
    return share.select("source", F.coalesce(rate, F.lit(1.0)).alias("rate"), "n")


def poisson_mix(docs: DataFrame, targets: dict[str, float] | None = None, seed: str = SEED, temperature: float = TEMPERATURE, budget: float = 1.0) -> DataFrame:
    """The rows of ``docs`` repeated by their counts, plus ``mix_rate, mix_count, mix_copy`` (from 0) and
    ``mix_key``, which replace columns of these names, in the order of ``mix_key`` over the whole result.

    A document whose count is 0 has no row. Rows that repeat a doc_id get equal counts; a null doc_id
    hashes as empty. Null text has no characters. Other columns are kept, whatever their names. An empty table
    gives an empty result.
    """
    rate = rates(docs, targets, temperature, budget).select(F.struct("source").alias("of"), F.col("rate").alias("mix_rate"), "n")
    held, new = numbered(docs)
    name = F.coalesce(F.col(new["doc_id"]).cast("string"), F.lit("")).alias("name")
    rows = held.select("*", name, F.struct(F.col(new["source"]).alias("source")).alias("of"))  # a struct, so that a null source is a key
    rows = join_groups(rows, rate, ["of"], "n", rate.agg(F.sum("n")).first()[0] or 0, ["name"])
    counted = rows.withColumn("mix_count", mix_count(F.col("mix_rate"), seed, F.col("name"))).where("mix_count > 0")
    blocks = counted.withColumn("begin", F.explode(F.sequence(F.lit(0), F.col("mix_count") - 1, F.lit(BLOCK))))
    copies = blocks.withColumn("mix_copy", F.explode(F.sequence("begin", F.least(F.col("begin") + (BLOCK - 1), F.col("mix_count") - 1))))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), "name", F.col("mix_copy").cast("string"))))
    kept = [F.col(n).alias(c) for c, n in new.items() if c.lower() not in ADDED]
    return in_key_order(keyed.select(*held.columns, *ADDED)).select(*kept, *ADDED)


def in_key_order(keyed: DataFrame) -> DataFrame:
    """Rows in the order of ``mix_key`` over all partitions. An md5 is uniform, so the bounds of the partitions are
    fixed shares of its first 32 bits, and no scan is spent on finding them."""
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * F.lit(n)
    return keyed.repartitionById(n, F.shiftright(share, 32).cast("int")).sortWithinPartitions("mix_key")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``poisson_mix`` with the columns of ``docs`` only."""
    return poisson_mix(docs, **how).select(docs.columns)


def op6_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return poisson_mix(docs).withColumn("mix_rate", F.round("mix_rate", 9))


_NAME = "coalesce(doc_id::VARCHAR, '')"
_UNIT = f"('0x' || substr(md5({{}}), 1, 13))::UBIGINT::DOUBLE / {1 << 52}.0"
OP6_SQL = f"""
WITH RECURSIVE size AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source),
share AS (SELECT source, chars / nullif((SELECT sum(chars) FROM size), 0) AS share FROM size),
rates AS (SELECT source, coalesce(pow(share, {TEMPERATURE}) / nullif((SELECT sum(pow(share, {TEMPERATURE})) FROM share), 0) / nullif(share, 0), 1.0) AS rate FROM share),
draws AS (SELECT source, rate, greatest(1, ceil(rate / {LARGEST_RATE}))::INT AS draws, rate / greatest(1, ceil(rate / {LARGEST_RATE})) AS r FROM rates),
steps AS (SELECT source, rate, draws, r, 0 AS k, exp(-r) AS p, exp(-r) AS c FROM draws
  UNION ALL SELECT source, rate, draws, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) FROM steps WHERE k < {MOST - 1}),
table_of AS (SELECT source, rate, draws, list(c ORDER BY k) AS cdf FROM steps GROUP BY source, rate, draws),
u AS (SELECT d.*, t.rate, t.draws, t.cdf, CASE WHEN t.draws = 1 THEN [{_UNIT.format(f"'{SEED}:' || {_NAME}")}]
    ELSE list_transform(range(1, t.draws + 1), lambda i: {_UNIT.format(f"'{SEED}:draw:' || i || ':' || {_NAME}")}) END AS us
  FROM documents d JOIN table_of t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, list_sum(list_transform(us, lambda u: len(list_filter(cdf, lambda x: x <= u)))) AS mix_count FROM u),
copies AS (SELECT *, unnest(range(mix_count::BIGINT)) AS c FROM counted WHERE mix_count > 0)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS mix_rate, mix_count::INT AS mix_count, c::INT AS mix_copy,
  md5('{SEED}:order:' || {_NAME} || ':' || c) AS mix_key
FROM copies ORDER BY mix_key
"""
