"""Clips made from the driver's tables, and the same as DuckDB SQL: the inputs of the registered queries.

``events`` give root paths (a clip per user); ``embeddings`` give 16 unit quaternions and 21 positions a frame
(a clip per label); ``supplier`` gives skeletons (binary trees with arithmetic offsets); ``part`` gives clip facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetra.functions.rotations import normalize


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ev_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, t, root_pos = (value, k, value - k)."""
    e = read(spark, sf_dir, "events")
    t = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("user_id").alias("clip_id"), t.alias("t"), F.array(F.col("value"), k, F.col("value") - k).alias("root_pos"))


EV = """ev AS (
  SELECT user_id AS clip_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS t,
    [value, json_extract(props, '$.k')::DOUBLE, value - json_extract(props, '$.k')::DOUBLE] AS root_pos FROM events),
n AS (SELECT clip_id, count(*)::INT AS n FROM ev GROUP BY clip_id)"""


def emb_frames(spark: SparkSession, sf_dir: str, rotations: bool = True, positions: bool = False) -> DataFrame:
    """clip_id, t, root_pos (first three numbers), joint_rot (16 unit quaternions), joint_pos (21 triples)."""
    e = read(spark, sf_dir, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    t = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("int")
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    streams = {"root_pos": F.slice("e", 1, 3)}
    if rotations:
        streams["joint_rot"] = F.transform(number(16), lambda j: normalize(F.slice("e", 4 * j + 1, F.lit(4))))
    if positions:
        streams["joint_pos"] = F.transform(number(21), lambda j: F.slice("e", 3 * j + 1, F.lit(3)))
    return e.select(F.col("label").alias("clip_id"), t.alias("t"), *(c.alias(s) for s, c in streams.items()))


EMB = """e AS (
  SELECT label AS clip_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS t, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT clip_id, count(*)::INT AS n FROM e GROUP BY clip_id),
q0 AS (SELECT clip_id, t, j::INT AS j, e[4 * j + 1] AS w, e[4 * j + 2] AS x, e[4 * j + 3] AS y, e[4 * j + 4] AS z FROM e, range(16) r(j)),
q1 AS (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS s FROM q0),
q AS MATERIALIZED (SELECT clip_id, t, j, w / s AS w, x / s AS x, y / s AS y, z / s AS z FROM q1),
p AS (SELECT clip_id, t, j::INT AS j, e[3 * j + 1] AS x, e[3 * j + 2] AS y, e[3 * j + 3] AS z FROM e, range(21) r(j))"""

PAIRS = [(2 * k + 1, 2 * k + 2) for k in range(7)]
#: The vertex that a vertex changes places with, in SQL.
PARTNER = "CASE WHEN j = 0 OR j > 14 THEN j WHEN j % 2 = 1 THEN j + 1 ELSE j - 1 END"


def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary tree of 7 to 15 nodes for each supplier; leaves are end sites, but for one side of some pairs."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("skeleton"), (7 + F.col("s_suppkey") % 9).cast("int").alias("size"))
    n = s.select("skeleton", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("node"))
    n = n.withColumn("end", (2 * F.col("node") + 1 >= F.col("size")) & (F.col("node") > 2))
    pair = F.floor((F.col("node") - 1) / 2).cast("int")
    word = F.element_at(F.array(*map(F.lit, ("Arm", "UpLeg", "Spine", "Neck", "Wing"))), pair % 5 + 1)
    name = F.when(F.col("node") == 0, "Hips").otherwise(F.concat(F.when(F.col("node") % 2 == 1, "Left").otherwise("Right"), word, pair.cast("string")))
    idx = (F.sum(F.when(~F.col("end"), 1).otherwise(0)).over(Window.partitionBy("skeleton").orderBy("node")) - 1).cast("int")
    off = lambda a, m: ((F.col("node") * a) % m).cast("double")
    return n.select("skeleton", "node", F.when(F.col("end"), F.concat(name, F.lit("_end"))).otherwise(name).alias("name"), F.when(F.col("node") > 0, pair).alias("parent"), F.when(~F.col("end"), idx).alias("joint_idx"), off(1, 3).alias("off_x"), off(2, 5).alias("off_y"), F.lit(1.0).alias("off_z"), F.when(~F.col("end"), F.lit("ZYX")).alias("euler_order"))


SK = """sk0 AS (SELECT s_suppkey AS skeleton, (7 + s_suppkey % 9)::INT AS size FROM supplier),
sk1 AS (SELECT skeleton, size, unnest(range(size))::INT AS node FROM sk0),
sk2 AS (SELECT *, 2 * node + 1 >= size AND node > 2 AS is_end, CASE WHEN node > 0 THEN ((node - 1) // 2)::INT END AS parent FROM sk1),
sk3 AS (SELECT *, CASE WHEN node = 0 THEN 'Hips' ELSE CASE WHEN node % 2 = 1 THEN 'Left' ELSE 'Right' END || ['Arm', 'UpLeg', 'Spine', 'Neck', 'Wing'][parent % 5 + 1] || parent END AS base,
  (sum(CASE WHEN is_end THEN 0 ELSE 1 END) OVER (PARTITION BY skeleton ORDER BY node) - 1)::INT AS idx FROM sk2),
sk AS (SELECT skeleton, node, CASE WHEN is_end THEN base || '_end' ELSE base END AS name, parent, CASE WHEN NOT is_end THEN idx END AS joint_idx FROM sk3)"""


def clip_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip per part: axes, frame time, Euler orders, stages, joint names and parents."""
    p = read(spark, sf_dir, "part")
    pick = lambda c, *v: F.element_at(F.array(*(F.lit(x) for x in v)), (c % len(v) + 1).cast("int"))
    size, key = F.col("p_size"), F.col("p_partkey")
    return p.select(
        key.alias("clip_id"), pick(size, "+y", "+z", "+y", "-z").alias("world_up"), pick(key, "+z", "+x", None, "+z", "-x").alias("rest_forward"), pick(size, "+y", None, "+y").alias("rest_up"),
        pick(size, 0.033333, 0.008333, 0.041708, 0.016667, 0.04).alias("frame_time"),
        F.array(pick(size, "ZYX", "XYZ"), pick(key, "ZYX", "YXZ", "XYZ")).alias("euler_orders"),
        F.filter(F.array(F.when(size % 2 == 0, "resample"), F.when(size % 3 == 0, "world_up"), F.when(size % 5 == 0, "rest_up")), lambda x: x.isNotNull()).alias("stages"),
        F.array(F.lit("Hips"), F.col("p_type")).alias("joint_names"), F.array(F.lit(-1), (key % 7 == 3).cast("int")).alias("parents"),
    )


CLIPS = """clips AS (SELECT p_partkey AS clip_id,
  ['+y', '+z', '+y', '-z'][p_size % 4 + 1] AS world_up, ['+z', '+x', NULL, '+z', '-x'][p_partkey % 5 + 1] AS rest_forward, ['+y', NULL, '+y'][p_size % 3 + 1] AS rest_up,
  [0.033333::DOUBLE, 0.008333, 0.041708, 0.016667, 0.04][p_size % 5 + 1] AS frame_time,
  [['ZYX', 'XYZ'][p_size % 2 + 1], ['ZYX', 'YXZ', 'XYZ'][p_partkey % 3 + 1]] AS euler_orders,
  list_filter([CASE WHEN p_size % 2 = 0 THEN 'resample' END, CASE WHEN p_size % 3 = 0 THEN 'world_up' END, CASE WHEN p_size % 5 = 0 THEN 'rest_up' END], lambda x: x IS NOT NULL) AS stages,
  p_type, (p_partkey % 7 = 3)::INT AS odd FROM part)"""


def r6(c: Column) -> Column:
    """Rounded to six decimals; the added zero makes -0 a 0."""
    return F.round(c, 6) + F.lit(0.0)
