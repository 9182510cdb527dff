"""Registered queries: each applies one operator to the driver's tables, with the same in DuckDB SQL."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra import schema
from kinetra import views as V
from kinetra.functions import rotations as R
from kinetra.operators import audit, augment, clips, harmonize, packing, skeleton, stats, temporal
from kinetra.plans import build, fused, shards
from kinetra.plans.clipsteps import clip_step
from kinetra.plans.draws import Draws, exact_draws
from kinetra.plans.feed import MotionFeed, collate
from kinetra.plans.pipeline import Pipeline, Step, handles_streams
from kinetra.sources import bvh, motionfiles, numbered, store
from kinetra.sources.shared import shared_folder
from kinetra.views import EMB, EV, r6

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def cells(df: DataFrame, stream: str, *keys: str, digits: int = 6) -> DataFrame:
    """Rounded cells of a stream; with ``keys``, of root_pos with these columns instead of t and v."""
    value = (F.round("value", digits) + F.lit(0.0)).alias("value")
    if keys:
        return df.select("clip_id", *keys, F.posexplode("root_pos").alias("c", "value")).select("clip_id", *keys, "c", value)
    return packing.cells(df, stream).select("clip_id", "t", "v", "c", value)


def root_sql(source: str, value: str = "root_pos[c + 1]", keys: str = "clip_id, t") -> str:
    return f"SELECT {keys}, 0 AS v, c::INT AS c, round({value}, 6) + 0.0 AS value FROM {source}, range(3) r(c)"


def vertex_sql(source: str, parts: list[str], keys: str = "clip_id, t, j AS v") -> str:
    """Cells from columns: one number of ``parts`` per channel."""
    return f"SELECT {keys}, c::INT AS c, round([{', '.join(parts)}][c + 1], 6) + 0.0 AS value FROM {source}, range({len(parts)}) r(c)"


# ---- centring and derivatives -----------------------------------------------------------------


@query(f"WITH {EV}, c AS (SELECT clip_id, t, root_pos, first_value(root_pos) OVER (PARTITION BY clip_id ORDER BY t) AS o FROM ev) {root_sql('c', 'root_pos[c + 1] - o[c + 1]')}")
def center_root(spark, d):
    return cells(temporal.center_root(V.ev_frames(spark, d)), "root_pos")


@query(f"WITH {EMB}, o AS (SELECT clip_id, e[1] AS a, e[2] AS b, e[3] AS c FROM e WHERE t = 0), m AS (SELECT p.clip_id, t, j, x - a AS x, y - b AS y, z - c AS z FROM p JOIN o USING (clip_id)) {vertex_sql('m', ['x', 'y', 'z'])}")
def center_positions(spark, d):
    return cells(temporal.center_root(V.emb_frames(spark, d, False, True), "world"), "joint_pos")


def _derived(order: int) -> str:
    lag = lambda c, k: f"lag({c}, {k}) OVER w"
    one = lambda c: f"CASE WHEN t < {order} THEN 0.0 ELSE " + (f"{c} - {lag(c, 1)}" if order == 1 else f"{c} - 2 * {lag(c, 1)} + {lag(c, 2)}") + " END"
    return f"WITH {EMB}, m AS (SELECT clip_id, t, j, {one('x')} AS x, {one('y')} AS y, {one('z')} AS z FROM p WINDOW w AS (PARTITION BY clip_id, j ORDER BY t)) {vertex_sql('m', ['x', 'y', 'z'])}"


@query(_derived(1))
def derive_vel(spark, d):
    return cells(temporal.derive(V.emb_frames(spark, d, False, True), ["joint_vel"]).select("clip_id", "t", "joint_vel"), "joint_vel")


@query(_derived(2))
def derive_acc(spark, d):
    return cells(temporal.derive(V.emb_frames(spark, d, False, True), ["joint_acc"]).select("clip_id", "t", "joint_acc"), "joint_acc")


FRAME_TIME = 0.05


@query(f"""WITH {EMB}, m AS (SELECT p.clip_id, t, j, (coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) / d AS x, (coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y)) / d AS y,
  (coalesce(lead(z) OVER w, z) - coalesce(lag(z) OVER w, z)) / d AS z FROM (SELECT p.*, CASE WHEN t = 0 OR t = n - 1 THEN 1 ELSE 2 END * {FRAME_TIME}::DOUBLE AS d FROM p JOIN n USING (clip_id)) p WINDOW w AS (PARTITION BY clip_id, j ORDER BY t)) {vertex_sql('m', ['x', 'y', 'z'])}""")  # fmt: skip
def joint_velocities(spark, d):
    return cells(temporal.joint_velocities(V.emb_frames(spark, d, False, True), FRAME_TIME), "velocities")


FEET = [3, 7]


@query(f"""WITH {EMB}, f AS (SELECT * FROM p WHERE j IN (3, 7)), m AS (SELECT clip_id, t, j, y - min(y) OVER (PARTITION BY clip_id) AS h,
  sqrt((x - coalesce(lag(x) OVER w, x)) ** 2 + (y - coalesce(lag(y) OVER w, y)) ** 2 + (z - coalesce(lag(z) OVER w, z)) ** 2) AS s FROM f WINDOW w AS (PARTITION BY clip_id, j ORDER BY t))
  SELECT clip_id, t, CASE j WHEN 3 THEN 0 ELSE 1 END AS foot, (h <= 0.2 AND s <= 0.25)::INT AS contact FROM m""")  # fmt: skip
def foot_contacts(spark, d):
    df = temporal.foot_contacts(V.emb_frames(spark, d, False, True), FEET, 1, 0.2, 0.25)
    return df.select("clip_id", "t", F.posexplode("foot_contacts").alias("foot", "contact"))


# ---- windows and lengths ----------------------------------------------------------------------


@query(f"""WITH {EV}, w AS (SELECT clip_id, unnest(range((n - 16) // 5 + 1))::INT AS "window" FROM n WHERE n >= 16)
  SELECT w.clip_id, w."window", (t - w."window" * 5)::INT AS o, c::INT AS c, round(root_pos[c + 1], 6) + 0.0 AS value
  FROM w JOIN ev ON w.clip_id = ev.clip_id AND t BETWEEN w."window" * 5 AND w."window" * 5 + 15, range(3) r(c)""")
def sliding_window(spark, d):
    return cells(temporal.sliding_windows(V.ev_frames(spark, d), 16, 5), "root_pos", "window", "o")


def _length_sql(length: int, start: str, pad: float) -> str:
    return f"""WITH {EV}, g AS (SELECT clip_id, n, unnest(range({length}))::INT AS t, {start} AS s FROM n)
      SELECT g.clip_id, g.t, least(n, {length})::INT AS length, c::INT AS c, round(coalesce(root_pos[c + 1], {pad}::DOUBLE), 6) + 0.0 AS value
      FROM g LEFT JOIN ev ON g.clip_id = ev.clip_id AND g.t + g.s = ev.t, range(3) r(c)"""


@query(_length_sql(64, "0", -1.0))
def pad_length(spark, d):
    return cells(temporal.standardize(V.ev_frames(spark, d), 64, "pad", -1.0), "root_pos", "t", "length")


@query(_length_sql(64, "CASE WHEN n > 64 THEN (n - 64) // 2 ELSE 0 END", 0.0))
def crop_length(spark, d):
    return cells(temporal.standardize(V.ev_frames(spark, d), 64, "crop"), "root_pos", "t", "length")


def _stencil(target: str, source: str = "n") -> str:
    """(clip_id, t, l, a): output frame, left input frame, and weight of the right one."""
    return f"""m AS (SELECT clip_id, n, ({target})::BIGINT AS m FROM {source}), k AS (SELECT *, unnest(range(m)) AS k FROM m),
      st AS (SELECT clip_id, k::INT AS t, CASE WHEN n = 1 OR m = 1 THEN 0 ELSE least((k * (n - 1)) // (m - 1), n - 2) END AS l, n, m, k FROM k),
      sa AS MATERIALIZED (SELECT clip_id, t, l::INT AS l, CASE WHEN n = 1 OR m = 1 THEN 0.0 ELSE (k * (n - 1) - l * (m - 1))::DOUBLE / (m - 1) END AS a, least(l + 1, n - 1)::INT AS rr FROM st)"""


_LERP = "SELECT sa.clip_id, sa.t, 0 AS v, c::INT AS c, round((1 - a) * x.root_pos[c + 1] + a * y.root_pos[c + 1], 9) + 0.0 AS value FROM sa JOIN ev x ON x.clip_id = sa.clip_id AND x.t = l JOIN ev y ON y.clip_id = sa.clip_id AND y.t = rr, range(3) r(c)"


@query(f"WITH {EV}, {_stencil('50')} {_LERP}")
def resample_linear(spark, d):
    return cells(temporal.resample(V.ev_frames(spark, d), F.lit(50)), "root_pos", digits=9)


def _pseudo(i: Column) -> Column:
    return ((i * 31 + F.col("clip_id") * 17) % 10) / F.lit(10.0)


def _indices_sql(length: int) -> str:
    u = lambda i: f"((({i}) * 31 + clip_id * 17) % 10) / 10.0::DOUBLE"
    seg = lambda i: f"(({i}) * n // {length})"
    return f"""g{length} AS (SELECT clip_id, n, unnest(range({length})) AS i FROM n), gap{length} AS (SELECT clip_id, n, k, row_number() OVER (PARTITION BY clip_id ORDER BY {u('k')}, k) AS place FROM (SELECT clip_id, n, unnest(range({length} + 1)) AS k FROM n)),
      i{length} AS (SELECT clip_id, i, CASE WHEN n < {length} THEN floor((((-1 * 31 + clip_id * 17) % 10 + 0) / 10.0::DOUBLE) * n)::BIGINT + i
        WHEN n < {2 * length} THEN i + (SELECT count(*) FROM gap{length} p WHERE p.clip_id = g.clip_id AND p.place <= p.n - {length} AND p.k <= i)
        ELSE {seg('i')} + floor({u('i')} * ({seg('i + 1')} - {seg('i')}))::BIGINT END AS idx FROM g{length} g)"""


@query(f"""WITH {EV}, {_indices_sql(40)}, {_indices_sql(70)}
  SELECT clip_id, 40 AS length, i::INT AS i, idx::BIGINT AS idx FROM i40 UNION ALL SELECT clip_id, 70, i::INT, idx::BIGINT FROM i70""")
def temporal_indices(spark, d):
    clips = temporal.frame_counts(V.ev_frames(spark, d))
    # the start of a short run is drawn at i = -1; a negative remainder counts as it is in both engines
    one = lambda n: temporal.temporal_indices(clips, n, "train", _pseudo).select("clip_id", F.lit(n).alias("length"), "i", "idx")
    return one(40).unionByName(one(70))


@query(f"WITH {EV}, {_indices_sql(70)} SELECT s.clip_id, s.i::INT AS t, 0 AS v, c::INT AS c, round(root_pos[c + 1], 6) + 0.0 AS value FROM i70 s JOIN n USING (clip_id) JOIN ev ON ev.clip_id = s.clip_id AND ev.t = ((s.idx % n) + n) % n, range(3) r(c)")
def temporal_sample(spark, d):
    f = V.ev_frames(spark, d)
    picks = temporal.temporal_indices(temporal.frame_counts(f), 70, "train", _pseudo)
    return cells(temporal.sample_frames(f, picks), "root_pos")


def _test_sql(length: int) -> str:
    u = lambda i: f"(('0x' || substr(md5('test:' || ({i})), 1, 13))::UBIGINT::DOUBLE / {1 << 52}.0)"
    seg = lambda i: f"(({i}) * n // {length})"
    return f"""g AS (SELECT clip_id, n, unnest(range({length})) AS i FROM n), gp AS (SELECT clip_id, n, k, row_number() OVER (PARTITION BY clip_id ORDER BY {u('k')}, k) AS place FROM (SELECT clip_id, n, unnest(range({length} + 1)) AS k FROM n)),
      ix AS (SELECT clip_id, i::INT AS i, n, CASE WHEN n < {length} THEN i WHEN n < {2 * length} THEN i + (SELECT count(*) FROM gp WHERE gp.clip_id = g.clip_id AND gp.place <= gp.n - {length} AND gp.k <= g.i)
        ELSE {seg('i')} + floor({u('i')} * ({seg('i + 1')} - {seg('i')}))::BIGINT END AS idx FROM g)"""


@query(f"WITH {EV}, {_test_sql(20)} SELECT clip_id, i, idx::BIGINT AS idx FROM ix")
def temporal_indices_test(spark, d):
    """The same frames in every call, clip by clip alike."""
    return temporal.temporal_indices(temporal.frame_counts(V.ev_frames(spark, d)), 20, "test")


@query(f"WITH {EV}, {_test_sql(70)} SELECT ix.clip_id, i AS t, 70 AS length, c::INT AS c, round(root_pos[c + 1], 6) + 0.0 AS value FROM ix JOIN ev ON ev.clip_id = ix.clip_id AND ev.t = ix.idx % ix.n, range(3) r(c)")
def temporal_deterministic(spark, d):
    return cells(temporal.apply_temporal(V.ev_frames(spark, d), 70, "resample_deterministic"), "root_pos", "t", "length")


@query(f"WITH {EV} SELECT ev.clip_id, t, n AS length, c::INT AS c, round(root_pos[c + 1], 6) + 0.0 AS value FROM ev JOIN n USING (clip_id), range(3) r(c)")
def temporal_as_is(spark, d):
    return cells(temporal.apply_temporal(V.ev_frames(spark, d), None), "root_pos", "t", "length")


@query(_length_sql(60, "CASE WHEN n > 60 THEN (n - 60) // 2 ELSE 0 END", 0.0))
def temporal_crop(spark, d):
    return cells(temporal.apply_temporal(V.ev_frames(spark, d), 60, "crop"), "root_pos", "t", "length")


# ---- packing ----------------------------------------------------------------------------------

_FLAT = f"{EMB}, fl AS (SELECT clip_id, t, (c::INT) AS c, e[c + 1] AS value FROM e, range(3) r(c) UNION ALL SELECT clip_id, t, (3 + 4 * j + c)::INT, [w, x, y, z][c + 1] FROM q, range(4) r(c))"
_TVC = f"{EMB}, tv AS (SELECT clip_id, t, 0 AS v, c::INT AS c, CASE WHEN c < 3 THEN e[c + 1] ELSE 0.0 END AS value FROM e, range(4) r(c) UNION ALL SELECT clip_id, t, (j + 1)::INT, c::INT, [w, x, y, z][c + 1] FROM q, range(4) r(c))"
_RAW = {"center": False, "centering": None}


@query(f"WITH {_FLAT} SELECT clip_id, t, c, round(value, 6) + 0.0 AS value FROM fl")
def pack_flat(spark, d):
    df = packing.pack_flat(V.emb_frames(spark, d), **_RAW)
    return df.select("clip_id", "t", F.posexplode("data").alias("c", "value")).withColumn("value", r6(F.col("value")))


@query(f"WITH {_TVC} SELECT clip_id, t, v, c, round(value, 6) + 0.0 AS value FROM tv")
def pack_tvc(spark, d):
    return cells(packing.pack_tvc(V.emb_frames(spark, d), representation="quat", **_RAW), "data")


@query(f"WITH {_TVC} SELECT clip_id, c, t, v, round(value, 6) + 0.0 AS value FROM tv")
def pack_ctv(spark, d):
    df = packing.pack_ctv(V.emb_frames(spark, d), representation="quat", **_RAW)
    df = df.select("clip_id", F.posexplode("data").alias("c", "_t")).select("clip_id", "c", F.posexplode("_t").alias("t", "_v"))
    return df.select("clip_id", "c", "t", F.posexplode("_v").alias("v", "value")).withColumn("value", r6(F.col("value")))


def _back_sql(parts: str) -> str:
    return f"WITH {EMB} {parts}"


_UNPACKED = "SELECT clip_id, t, -1 AS v, c::INT AS c, round(e[c + 1], 6) + 0.0 AS value FROM e, range(3) r(c) UNION ALL SELECT clip_id, t, j AS v, c::INT AS c, round([w, x, y, z][c + 1], 6) + 0.0 AS value FROM q, range(4) r(c)"


def _unpacked(frames: DataFrame) -> DataFrame:
    return cells(frames, "root_pos").withColumn("v", F.lit(-1)).unionByName(cells(frames, "joint_rot"))


@query(_back_sql(_UNPACKED))
def unpack_flat(spark, d):
    return _unpacked(packing.unpack_flat(packing.pack_flat(V.emb_frames(spark, d), **_RAW), 3, 4))


@query(_back_sql(_UNPACKED))
def unpack_tvc(spark, d):
    return _unpacked(packing.unpack_tvc(packing.pack_tvc(V.emb_frames(spark, d), representation="quat", **_RAW)))


@query(_back_sql(_UNPACKED))
def unpack_ctv(spark, d):
    return _unpacked(packing.unpack_ctv(packing.pack_ctv(V.emb_frames(spark, d), representation="quat", **_RAW)))


@query("""SELECT * FROM (VALUES ('flat', 'root_pos', 0, 3), ('flat', 'joint_rot', 3, 147), ('flat', 'joint_pos', 147, 219), ('flat', 'joint_vel', 219, 291), ('flat', 'total', 0, 291),
  ('graph', 'joint_rot', 0, 6), ('graph', 'joint_pos', 6, 9), ('graph', 'joint_vel', 9, 12), ('graph', 'channels', 0, 12), ('graph', 'vertices', 1, 25)) t(kind, block, low, high)""")
def describe_layouts(spark, d):
    streams = ["root_pos", "joint_rot", "joint_pos", "joint_vel"]
    flat, graph = schema.describe_flat(24, "6d", streams=streams), schema.describe_graph(24, "6d", streams=streams)
    rows = [("flat", k, *v) for k, v in flat.blocks.items()] + [("flat", "total", 0, flat.total_dim)]
    rows += [("graph", k, *v) for k, v in graph.channel_ranges.items()] + [("graph", "channels", 0, graph.num_channels), ("graph", "vertices", graph.first_vertex, graph.num_vertices)]
    return spark.createDataFrame(rows, "kind string, block string, low int, high int")


@query(f"WITH {_FLAT}, o AS (SELECT clip_id, e[1] AS a, e[2] AS b, e[3] AS c FROM e WHERE t = 0) SELECT clip_id, t, fl.c, round(value - CASE fl.c WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN o.c ELSE 0 END, 6) + 0.0 AS value FROM fl JOIN o USING (clip_id)")
def pack_centered(spark, d):
    """Clips are centred while they are packed."""
    df = packing.pack_flat(V.emb_frames(spark, d), centering=None, center=True)
    return df.select("clip_id", "t", F.posexplode("data").alias("c", "value")).withColumn("value", r6(F.col("value")))


@query(f"""WITH {EMB}, o AS (SELECT clip_id, e[1] AS a, e[2] AS b, e[3] AS c FROM e WHERE t = 0), m AS (SELECT p.clip_id, t, j, x - a AS x, y - b AS y, z - c AS z FROM p JOIN o USING (clip_id)),
  dv AS (SELECT clip_id, t, j, CASE WHEN t = 0 THEN 0.0 ELSE x - lag(x) OVER w END AS x, CASE WHEN t = 0 THEN 0.0 ELSE y - lag(y) OVER w END AS y, CASE WHEN t = 0 THEN 0.0 ELSE z - lag(z) OVER w END AS z FROM m WINDOW w AS (PARTITION BY clip_id, j ORDER BY t))
  SELECT 'joint_pos' AS stream, * FROM ({vertex_sql('m', ['x', 'y', 'z'])}) UNION ALL SELECT 'joint_vel', * FROM ({vertex_sql('dv', ['x', 'y', 'z'])})""")
def materialize_streams(spark, d):
    """Streams as they are packed: centred, then derived."""
    out = temporal.materialize(V.emb_frames(spark, d, False, True), ["root_pos", "joint_pos", "joint_vel"], "world", True)
    one = lambda s: cells(out, s).select(F.lit(s).alias("stream"), "clip_id", "t", "v", "c", "value")
    return one("joint_pos").unionByName(one("joint_vel"))


# ---- statistics -------------------------------------------------------------------------------

_STATS = "SELECT c AS dim, round(avg(value), 6) + 0.0 AS mean, round(CASE WHEN stddev_pop(value) < 1e-8 THEN 1.0 ELSE stddev_pop(value) END, 6) + 0.0 AS std, stddev_pop(value) < 1e-8 AS constant FROM fl GROUP BY c"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("dim", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "constant")


@query(f"WITH {_FLAT} {_STATS}")
def norm_stats(spark, d):
    return _rounded(stats.normalization_stats(V.emb_frames(spark, d)))


@query(f"WITH {EMB}, fl AS (SELECT (3 * j + c)::INT AS c, [x, y, z][c + 1] AS value FROM p, range(3) r(c)) {_STATS}")
def position_stats(spark, d):
    return _rounded(stats.position_stats(V.emb_frames(spark, d, False, True)))


_NORMED = f"{_FLAT}, st AS (SELECT c, avg(value) AS m, CASE WHEN stddev_pop(value) < 1e-8 THEN 1.0 ELSE stddev_pop(value) END AS s FROM fl GROUP BY c)"


@query(f"WITH {_NORMED} SELECT clip_id, t, c, round((value - m) / s, 6) + 0.0 AS value FROM fl JOIN st USING (c)")
def normalize(spark, d):
    f = V.emb_frames(spark, d)
    df = stats.normalize(packing.pack_flat(f, **_RAW), stats.normalization_stats(f))
    return df.select("clip_id", "t", F.posexplode("data").alias("c", "value")).withColumn("value", r6(F.col("value")))


@query(f"WITH {_FLAT} SELECT clip_id, t, c, round(value, 6) + 0.0 AS value FROM fl")
def denormalize(spark, d):
    f = V.emb_frames(spark, d)
    s = stats.normalization_stats(f)
    df = stats.denormalize(stats.normalize(packing.pack_flat(f, **_RAW), s), s)
    return df.select("clip_id", "t", F.posexplode("data").alias("c", "value")).withColumn("value", r6(F.col("value")))


@query(f"WITH {EMB}, fl AS (SELECT (4 * j + c)::INT AS c, [w, x, y, z][c + 1] AS value FROM q, range(4) r(c)) {_STATS}")
def norm_stats_without_root(spark, d):
    return _rounded(stats.normalization_stats(V.emb_frames(spark, d), include_root=False))


@query(f"WITH {EMB}, o AS (SELECT clip_id, e[1] AS a, e[2] AS b, e[3] AS c FROM e WHERE t = 0), fl AS (SELECT r.c::INT AS c, e[r.c + 1] - [a, b, o.c][r.c + 1] AS value FROM e JOIN o USING (clip_id), range(3) r(c) UNION ALL SELECT (3 + 4 * j + c)::INT, [w, x, y, z][c + 1] FROM q, range(4) r(c)) {_STATS}")
def norm_stats_centered(spark, d):
    return _rounded(stats.normalization_stats(V.emb_frames(spark, d), center=True))


# ---- audits -----------------------------------------------------------------------------------

_DIST = f"""{V.CLIPS}, vals AS (SELECT clip_id, 'world_up' AS axis, coalesce(world_up, 'unknown') AS value FROM clips UNION ALL SELECT clip_id, 'rest_forward', coalesce(rest_forward, 'unknown') FROM clips
  UNION ALL SELECT clip_id, 'rest_up', coalesce(rest_up, 'unknown') FROM clips UNION ALL SELECT clip_id, 'fps', format('{{:.6g}}', 1 / frame_time) FROM clips), dist AS (SELECT axis, value, count(*) AS n FROM vals GROUP BY axis, value)"""


def _facts(spark, d) -> DataFrame:
    return V.clip_facts(spark, d).withColumn("fps", audit.fps_key(F.col("frame_time")))


@query(f"WITH {_DIST} SELECT axis, value, n FROM dist")
def audit_counts(spark, d):
    return audit.distribution(_facts(spark, d))


@query(f"WITH {_DIST} SELECT axis, value, n FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY n DESC, value DESC) AS k FROM dist WHERE value <> 'unknown') WHERE k = 1")
def audit_majority(spark, d):
    return audit.majority(audit.distribution(_facts(spark, d)))


@query(f"WITH {_DIST}, top AS (SELECT axis, arg_max(value, (n, value)) AS best, count(*) AS n_values FROM dist GROUP BY axis HAVING count(*) > 1) SELECT axis, n_values, array_to_string(list(clip_id ORDER BY clip_id)[1:3], ',') AS examples FROM vals JOIN top USING (axis) WHERE value <> best GROUP BY axis, n_values")
def audit_heterogeneity(spark, d):
    df = audit.heterogeneity(_facts(spark, d))
    return df.select("axis", "n_values", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


@query(f"WITH {V.CLIPS}, o AS (SELECT value, count(*) AS n FROM (SELECT unnest(euler_orders) AS value FROM clips) GROUP BY value) SELECT value, n FROM o ORDER BY n DESC, value DESC LIMIT 1")
def euler_order_majority(spark, d):
    return audit.euler_order_majority(V.clip_facts(spark, d))


@query(f"WITH {V.CLIPS} SELECT stage, count(*) AS n FROM (SELECT unnest(stages) AS stage FROM clips) GROUP BY stage")
def stage_counts(spark, d):
    return audit.stage_counts(V.clip_facts(spark, d).select("clip_id", "stages"))


@query(f"WITH {V.CLIPS}, f AS (SELECT p_type AS ft, odd AS fo FROM clips ORDER BY clip_id LIMIT 1) SELECT clip_id, CASE WHEN p_type <> ft THEN 'names' ELSE 'parents' END AS what FROM clips, f WHERE p_type <> ft OR odd <> fo")
def compat_check(spark, d):
    return audit.incompatible(V.clip_facts(spark, d))


# ---- skeletons --------------------------------------------------------------------------------


@query(f"WITH {V.SK} SELECT skeleton, node AS child, parent FROM sk WHERE parent IS NOT NULL")
def node_edges(spark, d):
    return skeleton.edges(V.skeletons(spark, d), True)


@query(f"WITH {V.SK} SELECT a.skeleton, a.joint_idx AS child, b.joint_idx AS parent FROM sk a JOIN sk b ON a.skeleton = b.skeleton AND a.parent = b.node WHERE a.joint_idx IS NOT NULL")
def joint_edges(spark, d):
    return skeleton.edges(V.skeletons(spark, d))


@query(f"WITH RECURSIVE {V.SK}, walk AS (SELECT skeleton, node, 0 AS depth FROM sk WHERE parent IS NULL UNION ALL SELECT c.skeleton, c.node, w.depth + 1 FROM sk c JOIN walk w ON c.skeleton = w.skeleton AND c.parent = w.node) SELECT skeleton, node, depth FROM walk")
def tree_depth(spark, d):
    return skeleton.depths(V.skeletons(spark, d))


_LR = f"{V.SK}, lr AS (SELECT a.skeleton, a.node AS ln, b.node AS rn, a.joint_idx AS \"left\", b.joint_idx AS \"right\" FROM sk a JOIN sk b ON a.skeleton = b.skeleton AND a.parent = b.parent AND a.node % 2 = 1 AND b.node = a.node + 1 WHERE a.joint_idx IS NOT NULL AND b.joint_idx IS NOT NULL)"


@query(f'WITH {_LR} SELECT skeleton, "left", "right" FROM lr')
def lr_pairs(spark, d):
    return skeleton.lr_pairs(V.skeletons(spark, d))


_TIPS = "tips AS (SELECT skeleton, parent, node, row_number() OVER (PARTITION BY skeleton, parent ORDER BY node) AS k FROM sk WHERE joint_idx IS NULL)"


@query(f'WITH {_LR}, {_TIPS} SELECT skeleton, ln AS "left", rn AS "right" FROM lr UNION ALL SELECT lr.skeleton, a.node, b.node FROM lr JOIN tips a ON a.skeleton = lr.skeleton AND a.parent = ln JOIN tips b ON b.skeleton = lr.skeleton AND b.parent = rn AND a.k = b.k')
def node_lr_pairs(spark, d):
    return skeleton.node_lr_pairs(V.skeletons(spark, d))


@query(f'WITH {_LR}, ct AS (SELECT skeleton, parent, count(*) AS n FROM sk WHERE joint_idx IS NULL GROUP BY ALL) SELECT lr.skeleton, "left", "right", coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM lr LEFT JOIN ct a ON a.skeleton = lr.skeleton AND a.parent = ln LEFT JOIN ct b ON b.skeleton = lr.skeleton AND b.parent = rn WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)')
def end_site_mismatch(spark, d):
    return skeleton.mismatched_end_sites(V.skeletons(spark, d))


def _part_sql() -> str:
    has = lambda words: f"regexp_matches(replace(replace(replace(lower(name), '_', ''), '-', ''), ' ', ''), '{'|'.join(words)}')"
    side = "CASE WHEN contains(lower(name), 'left') THEN 'left' WHEN contains(lower(name), 'right') THEN 'right' WHEN regexp_matches(name, '^L[A-Z]') THEN 'left' WHEN regexp_matches(name, '^R[A-Z]') THEN 'right' END"
    return f"""WITH {V.SK}, s AS (SELECT *, {side} AS side FROM sk WHERE joint_idx IS NOT NULL) SELECT skeleton, joint_idx, name,
      CASE WHEN {has(skeleton.TORSO_WORDS)} AND side IS NULL THEN 'torso' WHEN {has(skeleton.HEAD_WORDS)} AND side IS NULL THEN 'head' WHEN side IS NOT NULL AND {has(skeleton.ARM_WORDS)} THEN side || '_arm'
      WHEN side IS NOT NULL AND {has(skeleton.LEG_WORDS)} THEN side || '_leg' WHEN {has(skeleton.TORSO_WORDS)} THEN 'torso' WHEN {has(skeleton.HEAD_WORDS)} THEN 'head' ELSE 'other' END AS part FROM s"""


@query(_part_sql())
def body_partitions(spark, d):
    return skeleton.body_partitions(V.skeletons(spark, d))


def _tree() -> skeleton.Topology:
    """16 joints and no end sites: parent (n - 1) // 2, offsets by arithmetic."""
    n = range(16)
    return skeleton.Topology([[float(i % 3), float(2 * i % 5), 1.0] for i in n], [(i - 1) // 2 if i else -1 for i in n], list(n), ["ZYX"] * 16)


_QMUL = "a.w * q.w - a.x * q.x - a.y * q.y - a.z * q.z AS w, a.w * q.x + a.x * q.w + a.y * q.z - a.z * q.y AS x, a.w * q.y - a.x * q.z + a.y * q.w + a.z * q.x AS y, a.w * q.z + a.x * q.y - a.y * q.x + a.z * q.w AS z"
_ROT = [["1 - 2 * ({q}.y * {q}.y + {q}.z * {q}.z)", "2 * ({q}.x * {q}.y - {q}.w * {q}.z)", "2 * ({q}.x * {q}.z + {q}.w * {q}.y)"], ["2 * ({q}.x * {q}.y + {q}.w * {q}.z)", "1 - 2 * ({q}.x * {q}.x + {q}.z * {q}.z)", "2 * ({q}.y * {q}.z - {q}.w * {q}.x)"], ["2 * ({q}.x * {q}.z - {q}.w * {q}.y)", "2 * ({q}.y * {q}.z + {q}.w * {q}.x)", "1 - 2 * ({q}.x * {q}.x + {q}.y * {q}.y)"]]
_O = ["(q.j % 3)", "(2 * q.j % 5)", "1.0"]
_STEP = ", ".join(f"a.p{i} + " + " + ".join(f"({_ROT[i][k].format(q='a')}) * {_O[k]}" for k in range(3)) + f" AS p{i}" for i in range(3))


@query(f"""WITH RECURSIVE {EMB}, fk AS (SELECT q.clip_id, q.t, q.j, q.w, q.x, q.y, q.z, e[1] AS p0, e[2] AS p1, e[3] AS p2 FROM q JOIN e ON e.clip_id = q.clip_id AND e.t = q.t WHERE q.j = 0
  UNION ALL SELECT q.clip_id, q.t, q.j, {_QMUL}, {_STEP} FROM q JOIN fk a ON a.clip_id = q.clip_id AND a.t = q.t AND q.j > 0 AND a.j = (q.j - 1) // 2) {vertex_sql('fk', ['p0', 'p1', 'p2'])}""")
def fk_positions(spark, d):
    return cells(skeleton.refresh_positions(V.emb_frames(spark, d), _tree(), "quat"), "joint_pos")


# ---- augmentation -----------------------------------------------------------------------------

ANGLE = 0.7
_C, _S = math.cos(ANGLE), math.sin(ANGLE)


@query(f"WITH {EMB}, m AS (SELECT clip_id, t, j, {_C!r} * x + {_S!r} * z AS x, y, -{_S!r} * x + {_C!r} * z AS z FROM p) {vertex_sql('m', ['x', 'y', 'z'])}")
def rotate_vertical_pos(spark, d):
    return cells(augment.rotate_vertical(V.emb_frames(spark, d, False, True), angle=ANGLE, up_axis="+y"), "joint_pos")


_H = (math.cos(ANGLE / 2), math.sin(ANGLE / 2))


@query(f"WITH {EMB}, m AS (SELECT clip_id, t, j, w * {_H[0]!r} - y * {_H[1]!r} AS w, x * {_H[0]!r} + z * {_H[1]!r} AS x, y * {_H[0]!r} + w * {_H[1]!r} AS y, z * {_H[0]!r} - x * {_H[1]!r} AS z FROM q WHERE j = 0 UNION ALL SELECT * FROM q WHERE j > 0) {vertex_sql('m', ['w', 'x', 'y', 'z'])}")
def rotate_vertical_quat(spark, d):
    return cells(augment.rotate_vertical(V.emb_frames(spark, d), angle=ANGLE, up_axis="+y", representation="quat"), "joint_rot")


_6D = [_ROT[i][k].format(q="q") for k in range(2) for i in range(3)]
_S6 = f"{EMB}, s6 AS (SELECT clip_id, t, j, " + ", ".join(f"{x} AS r{i}" for i, x in enumerate(_6D)) + " FROM q)"


def _turned(i: int) -> str:
    a, b, c = (f"r{3 * i + k}" for k in range(3))
    return f"CASE WHEN j = 0 THEN {_C!r} * {a} + {_S!r} * {c} ELSE {a} END, {b}, CASE WHEN j = 0 THEN -{_S!r} * {a} + {_C!r} * {c} ELSE {c} END"


def _sixd(spark, d) -> DataFrame:
    f = V.emb_frames(spark, d)
    return f.withColumn("joint_rot", R.convert_joints(F.col("joint_rot"), "quat", "6d"))


@query(f"WITH {_S6} {vertex_sql('s6', [_turned(0), _turned(1)]).replace('range(2)', 'range(6)')}")
def rotate_vertical_6d(spark, d):
    return cells(augment.rotate_vertical(_sixd(spark, d), angle=ANGLE, up_axis="+y", representation="6d"), "joint_rot")


@query(f"WITH {EMB}, m AS (SELECT clip_id, t, ({V.PARTNER})::INT AS j, -x AS x, y, z FROM p) {vertex_sql('m', ['x', 'y', 'z'])}")
def mirror_pos(spark, d):
    return cells(augment.mirror(V.emb_frames(spark, d, False, True), lateral_axis="+x", lr_joint_pairs=V.PAIRS), "joint_pos")


@query(f"WITH {EMB}, m AS (SELECT clip_id, t, ({V.PARTNER})::INT AS j, w, x, -y AS y, -z AS z FROM q) {vertex_sql('m', ['w', 'x', 'y', 'z'])}")
def mirror_quat(spark, d):
    return cells(augment.mirror(V.emb_frames(spark, d), lateral_axis="+x", lr_joint_pairs=V.PAIRS, representation="quat"), "joint_rot")


@query(f"WITH {_S6}, m AS (SELECT clip_id, t, ({V.PARTNER})::INT AS j, r0, -r1 AS r1, -r2 AS r2, -r3 AS r3, r4, r5 FROM s6) {vertex_sql('m', [f'r{i}' for i in range(6)])}")
def mirror_6d(spark, d):
    return cells(augment.mirror(_sixd(spark, d), lateral_axis="+x", lr_joint_pairs=V.PAIRS, representation="6d"), "joint_rot")


def _noise(what: str, v: Column, c: Column) -> Column:
    return ((F.col("clip_id") * 31 + F.col("t") * 17 + v * 7 + c * 3) % 10 - 4.5) / F.lit(3.0)


_N = lambda v, c: f"(((clip_id * 31 + t * 17 + ({v}) * 7 + ({c}) * 3) % 10 - 4.5) / 3.0::DOUBLE)"


@query(f"WITH {EMB}, m AS (SELECT clip_id, t, j, x + 0.1 * {_N(0, 0)} AS x, y + 0.1 * {_N(0, 1)} AS y, z + 0.1 * {_N(0, 2)} AS z FROM p) {vertex_sql('m', ['x', 'y', 'z'])}")
def root_noise(spark, d):
    return cells(augment.root_noise(V.emb_frames(spark, d, False, True), sigma=0.1, draw=_noise, centering="world"), "joint_pos")


@query(f"WITH {EMB}, m AS (SELECT clip_id, t, j, x + 0.1 * {_N('j', 0)} AS x, y + 0.1 * {_N('j', 1)} AS y, z + 0.1 * {_N('j', 2)} AS z FROM p) {vertex_sql('m', ['x', 'y', 'z'])}")
def joint_noise(spark, d):
    return cells(augment.joint_position_noise(V.emb_frames(spark, d, False, True), sigma=0.1, draw=_noise), "joint_pos")


@query(f"WITH {EMB}, m AS (SELECT clip_id, t, j, x + 0.1 * {_N('j', 0)} AS x, y + 0.1 * {_N('j', 1)} AS y, z + 0.1 * {_N('j', 2)} AS z FROM p) {vertex_sql('m', ['x', 'y', 'z'])}")
def node_noise(spark, d):
    f = V.emb_frames(spark, d, False, True).withColumnRenamed("joint_pos", "node_pos")
    return cells(augment.node_position_noise(f, sigma=0.1, draw=_noise), "node_pos")


@query(f"""WITH {EMB}, d0 AS (SELECT *, {_N('j', 0)} AS a0, {_N('j', 1)} AS a1, {_N('j', 2)} AS a2, {_N('j', 0)} * 0.2 / 2 AS h FROM q), d1 AS (SELECT *, sqrt(a0 * a0 + a1 * a1 + a2 * a2) AS s FROM d0),
  pr AS (SELECT clip_id, t, j, {{'w': cos(h), 'x': sin(h) * a0 / s, 'y': sin(h) * a1 / s, 'z': sin(h) * a2 / s}} AS a, {{'w': w, 'x': x, 'y': y, 'z': z}} AS q FROM d1),
  m AS (SELECT clip_id, t, j, {_QMUL} FROM pr) {vertex_sql('m', ['w', 'x', 'y', 'z'])}""")
def rot_noise_quat(spark, d):
    return cells(augment.rotation_noise(V.emb_frames(spark, d), sigma=0.2, draw=_noise, representation="quat"), "joint_rot")


_FACTOR = "(0.8 + (clip_id % 5) * 0.1::DOUBLE)"
_TARGET = f"CASE WHEN n < 2 THEN n ELSE greatest(2, round_even(n / {_FACTOR}, 0)::BIGINT) END"


def _factor() -> Column:
    return F.lit(0.8) + (F.col("clip_id") % 5) * F.lit(0.1)


@query(f"WITH {EV}, {_stencil(_TARGET)} {_LERP}")
def speed_lerp(spark, d):
    return cells(augment.speed(V.ev_frames(spark, d), factor=_factor()), "root_pos", digits=9)


def _slerp_sql(source: str) -> str:
    """From rows (clip_id, t, j, p, r, a) of quaternion structs and a weight."""
    return f"{_slerp_ctes(source)} {vertex_sql('s2', _SLERPED)}"


_SLERPED = [f"CASE WHEN a = 0 THEN p.{k} WHEN a = 1 THEN r.{k} WHEN abs(d) > 0.9995 THEN (p.{k} + a * (g * r.{k} - p.{k})) / s ELSE (sin((1 - a) * o) * p.{k} + sin(a * o) * g * r.{k}) / sin(o) END" for k in "wxyz"]


def _slerp_ctes(source: str) -> str:
    dot = "p.w * r.w + p.x * r.x + p.y * r.y + p.z * r.z"
    return f"""s0 AS (SELECT *, {dot} AS d FROM {source}), s1 AS (SELECT *, CASE WHEN d < 0 THEN -1.0 ELSE 1.0 END AS g, acos(least(abs(d), 1.0)) AS o FROM s0),
      s2 AS (SELECT *, sqrt({' + '.join(f'(p.{k} + a * (g * r.{k} - p.{k})) ** 2' for k in 'wxyz')}) AS s FROM s1)"""


_Q = "{'w': %s.w, 'x': %s.x, 'y': %s.y, 'z': %s.z}"
#: The quaternions of a frame as one list, in the order of joints: frames meet, not joints.
_FRAMES = "ql AS MATERIALIZED (SELECT clip_id, t, list({'w': w, 'x': x, 'y': y, 'z': z} ORDER BY j) AS qs FROM q GROUP BY clip_id, t)"


@query(f"WITH {EMB}, {_stencil(_TARGET)}, {_FRAMES}, src AS (SELECT sa.clip_id, sa.t, g.j::INT AS j, u.qs[g.j + 1] AS p, v.qs[g.j + 1] AS r, a FROM sa JOIN ql u ON u.clip_id = sa.clip_id AND u.t = l JOIN ql v ON v.clip_id = sa.clip_id AND v.t = rr, range(16) g(j)), {_slerp_sql('src')}")
def speed_slerp(spark, d):
    return cells(augment.speed(V.emb_frames(spark, d), factor=_factor(), representation="quat"), "joint_rot")


_KEEP = "((clip_id * 13 + t * 7) % 10) / 10.0::DOUBLE >= 0.4 OR t = 0 OR t = n - 1"
_FILL = f"""kp AS (SELECT clip_id, t, ({_KEEP}) AS keep FROM base JOIN n USING (clip_id)), lr AS (SELECT clip_id, t, keep, max(CASE WHEN keep THEN t END) OVER (PARTITION BY clip_id ORDER BY t) AS l,
  min(CASE WHEN keep THEN t END) OVER (PARTITION BY clip_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rr FROM kp), sa AS MATERIALIZED (SELECT clip_id, t, l, rr, (t - l)::DOUBLE / greatest(rr - l, 1) AS a FROM lr)"""


def _drop() -> Column:
    return ((F.col("clip_id") * 13 + F.col("t") * 7) % 10) / F.lit(10.0)


@query(f"WITH {EV}, base AS (SELECT clip_id, t FROM ev), {_FILL} {_LERP}")
def dropout_lerp(spark, d):
    return cells(augment.dropout(V.ev_frames(spark, d), rate=0.4, draw=_drop()), "root_pos", digits=9)


@query(f"WITH {EMB}, base AS (SELECT clip_id, t FROM e), {_FILL}, {_FRAMES}, src AS (SELECT sa.clip_id, sa.t, g.j::INT AS j, u.qs[g.j + 1] AS p, v.qs[g.j + 1] AS r, a FROM sa JOIN ql u ON u.clip_id = sa.clip_id AND u.t = l JOIN ql v ON v.clip_id = sa.clip_id AND v.t = rr, range(16) g(j)), {_slerp_sql('src')}")
def dropout_slerp(spark, d):
    return cells(augment.dropout(V.emb_frames(spark, d), rate=0.4, draw=_drop(), representation="quat"), "joint_rot")


# ---- rotation conversion ----------------------------------------------------------------------


def _converted(spark, d, source: str, target: str, order: str | None = None) -> DataFrame:
    f = V.emb_frames(spark, d)
    if source == "euler":
        f = f.withColumn("joint_rot", F.transform("joint_rot", lambda x: F.slice(x, 1, 3)))  # three numbers in [-1, 1] as radians
    elif source != "quat":
        f = f.withColumn("joint_rot", R.convert_joints(F.col("joint_rot"), "quat", source, order))
    return cells(f.withColumn("joint_rot", R.convert_joints(F.col("joint_rot"), source, target, order)), "joint_rot")


_MATRIX = [_ROT[i][k].format(q="q") for i in range(3) for k in range(3)]
_POSITIVE = "CASE WHEN w < 0 THEN -1.0 ELSE 1.0 END"


@query(f"WITH {EMB} {vertex_sql('q', _MATRIX)}")
def convert_quat_rotmat(spark, d):
    return _converted(spark, d, "quat", "rotmat")


@query(f"WITH {EMB} {vertex_sql('q', _6D)}")
def convert_quat_6d(spark, d):
    return _converted(spark, d, "quat", "6d")


@query(f"WITH {EMB} {vertex_sql('q', [f'{k} * {_POSITIVE}' for k in 'wxyz'])}")
def convert_6d_quat(spark, d):
    return _converted(spark, d, "6d", "quat")


@query(f"WITH {EMB} {vertex_sql('q', [f'{k} * {_POSITIVE}' for k in 'wxyz'])}")
def convert_rotmat_quat(spark, d):
    return _converted(spark, d, "rotmat", "quat")


@query(f"WITH {EMB}, m AS (SELECT *, {_POSITIVE} AS g, sqrt(x * x + y * y + z * z) AS s FROM q) {vertex_sql('m', [f'g * {k} * 2 * atan2(s, abs(w)) / s' for k in 'xyz'])}")
def convert_quat_axisangle(spark, d):
    return _converted(spark, d, "quat", "axisangle")


@query(f"WITH {EMB} {vertex_sql('q', [f'{k} * {_POSITIVE}' for k in 'wxyz'])}")
def convert_axisangle_quat(spark, d):
    return _converted(spark, d, "axisangle", "quat")


_ZYX = ["cos(a) * cos(b)", "cos(a) * sin(b) * sin(g) - sin(a) * cos(g)", "cos(a) * sin(b) * cos(g) + sin(a) * sin(g)", "sin(a) * cos(b)", "sin(a) * sin(b) * sin(g) + cos(a) * cos(g)", "sin(a) * sin(b) * cos(g) - cos(a) * sin(g)", "-sin(b)", "cos(b) * sin(g)", "cos(b) * cos(g)"]


@query(f"WITH {EMB}, m AS (SELECT clip_id, t, j, w AS a, x AS b, y AS g FROM q) {vertex_sql('m', _ZYX)}")
def convert_euler_rotmat(spark, d):
    return _converted(spark, d, "euler", "rotmat", "ZYX")


@query(f"WITH {EMB} {vertex_sql('q', ['w', 'x', 'y'])}")
def convert_euler_roundtrip(spark, d):
    f = V.emb_frames(spark, d).withColumn("joint_rot", F.transform("joint_rot", lambda x: F.slice(x, 1, 3)))
    orders = [("ZYX", "XYZ", "YZX", "ZXY", "YXZ", "XZY")[i % 6] for i in range(16)]
    q = f.withColumn("joint_rot", R.convert_joints(F.col("joint_rot"), "euler", "quat", orders))
    return cells(q.withColumn("joint_rot", R.convert_joints(F.col("joint_rot"), "quat", "euler", orders)), "joint_rot")


@query(f"WITH {EMB}, m AS (SELECT clip_id, t, j, {_MATRIX[7].replace('q.', '')} AS r21, {_MATRIX[8].replace('q.', '')} AS r22, {_MATRIX[6].replace('q.', '')} AS r20, {_MATRIX[3].replace('q.', '')} AS r10, {_MATRIX[0].replace('q.', '')} AS r00 FROM q) {vertex_sql('m', ['atan2(r10, r00)', 'asin(-r20)', 'atan2(r21, r22)'])}")
def convert_quat_euler(spark, d):
    return _converted(spark, d, "quat", "euler", "ZYX")


@query(f"WITH {EMB}, {_FRAMES}, pr AS (SELECT clip_id, t, g.j::INT AS j, qs[g.j + 1] AS a, qs[16 - g.j] AS q FROM ql, range(16) g(j)), m AS (SELECT clip_id, t, j, {_QMUL} FROM pr) {vertex_sql('m', ['w', 'x', 'y', 'z'])}")
def quat_products(spark, d):
    f = V.emb_frames(spark, d)
    return cells(f.withColumn("joint_rot", F.transform("joint_rot", lambda x, j: R.quat_multiply(x, F.col("joint_rot")[15 - j]))), "joint_rot")


@query(f"WITH {EMB} {vertex_sql('q', _MATRIX)}")
def convert_6d_rotmat(spark, d):
    return _converted(spark, d, "6d", "rotmat")


@query(f"WITH {EMB}, m AS (SELECT *, {_POSITIVE} AS g, sqrt(x * x + y * y + z * z) AS s FROM q) {vertex_sql('m', [f'g * {k} * 2 * atan2(s, abs(w)) / s' for k in 'xyz'])}")
def convert_rotmat_axisangle(spark, d):
    return _converted(spark, d, "rotmat", "axisangle")


@query(f"WITH {EMB} SELECT clip_id, t, (CASE j WHEN 2 THEN 0 WHEN 5 THEN 1 ELSE 2 END) AS v, c::INT AS c, round([x, y, z][c + 1], 6) + 0.0 AS value FROM p, range(3) r(c) WHERE j IN (2, 5, 20)")
def joints_of_nodes(spark, d):
    """The joints' part of a node stream, wherever end sites stand."""
    top = skeleton.Topology([[0.0, 0.0, 0.0]] * 21, [-1, *range(20)], [{2: 0, 5: 1, 20: 2}.get(i, -1) for i in range(21)], ["ZYX"] * 3)
    f = V.emb_frames(spark, d, False, True)
    return cells(f.withColumn("joint_pos", clips.joints_of_nodes(F.col("joint_pos"), top)), "joint_pos")


@query("SELECT NULL::BIGINT AS clip_id, NULL::VARCHAR AS what WHERE false UNION ALL SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 't is not 0, 1, 2, ...' ELSE 'root_pos has not three numbers' END FROM events WHERE user_id % 3 < 2 GROUP BY user_id")
def broken_clips(spark, d):
    """A third of the clips lacks its first frame, another has roots of two numbers."""
    f = V.ev_frames(spark, d).where((F.col("clip_id") % 3 != 0) | (F.col("t") > 0))
    return clips.violations(f.withColumn("root_pos", F.when(F.col("clip_id") % 3 == 1, F.slice("root_pos", 1, 2)).otherwise(F.col("root_pos"))))


@query(f"WITH {EMB}, m AS (SELECT clip_id, t, j, 0.0 AS x, 2 * y AS y, z FROM p) {vertex_sql('m', ['x', 'y', 'z'])}")
def replaced_stream(spark, d):
    f = V.emb_frames(spark, d, False, True)
    return cells(clips.replace(f, joint_pos=F.transform("joint_pos", lambda p: F.array(F.lit(0.0), 2 * p[1], p[2]))), "joint_pos")


# ---- harmonising ------------------------------------------------------------------------------

_UP = "CASE clip_id % 3 WHEN 0 THEN '+y' WHEN 1 THEN '+z' ELSE '-x' END"


@query(f"""WITH {EV}, m AS (SELECT clip_id, t, CASE clip_id % 3 WHEN 0 THEN root_pos WHEN 1 THEN [root_pos[1], root_pos[3], -root_pos[2]] ELSE [root_pos[2], -root_pos[1], root_pos[3]] END AS root_pos FROM ev) {root_sql('m')}""")
def harmonize_world_up(spark, d):
    up = F.when(F.col("clip_id") % 3 == 0, "+y").when(F.col("clip_id") % 3 == 1, "+z").otherwise("-x")
    return cells(harmonize.turn_world(V.ev_frames(spark, d).withColumn("world_up", up), "+y"), "root_pos")


_FT = "(CASE clip_id % 2 WHEN 0 THEN 0.03 ELSE 0.008 END)::DOUBLE"


@query(f"WITH {EV}, {_stencil(f'CASE WHEN n < 2 THEN n ELSE greatest(2, round_even((n - 1) * {_FT} * 30, 0)::BIGINT + 1) END')} {_LERP}")
def harmonize_fps(spark, d):
    return cells(harmonize.to_fps(V.ev_frames(spark, d), 30.0, F.when(F.col("clip_id") % 2 == 0, 0.03).otherwise(0.008)), "root_pos", digits=9)


# ---- sources ----------------------------------------------------------------------------------


@query("SELECT s_name AS stem, regexp_extract(s_name, '([0-9]+)$', 1)::BIGINT AS label FROM supplier WHERE regexp_matches(s_name, '[02468]$')")
def stem_filter_label(spark, d):
    stem = F.col("s_name")
    return V.read(spark, d, "supplier").where(stem.rlike("[02468]$")).select(stem.alias("stem"), F.regexp_extract(stem, "([0-9]+)$", 1).cast("long").alias("label"))


@query(f"""WITH {EV}, m AS (SELECT clip_id::VARCHAR AS clip_id, t, CASE c WHEN 0 THEN root_pos[1] WHEN 1 THEN root_pos[2] WHEN 2 THEN root_pos[3] ELSE 0 END AS v, c, root_pos FROM ev, range(9) r(c))
  SELECT clip_id, t, c::INT AS c, round(CASE WHEN c < 3 THEN v WHEN c < 6 THEN root_pos[c - 2] * pi() / 180 ELSE root_pos[9 - c] * pi() / 180 END, 6) + 0.0 AS value FROM m""")
def bvh_parse(spark, d):
    """Motion text made from the events (two joints, orders ZXY and XYZ), then parsed."""
    out = bvh.frames(_files(spark, d, [F.lit(_head("ZXY", "XYZ", 5))], [F.lit(0.05)]))
    row = F.concat("root_pos", F.flatten("joint_rot"))
    return out.select("clip_id", "t", F.posexplode(row).alias("c", "value")).withColumn("value", r6(F.col("value")))


@query(f"""WITH {EV}, m AS (SELECT clip_id::VARCHAR AS clip_id, t, CASE c WHEN 0 THEN root_pos[1] WHEN 1 THEN root_pos[2] WHEN 2 THEN root_pos[3] ELSE 0 END AS v, c, root_pos FROM ev, range(9) r(c))
  SELECT clip_id, t, c::INT AS c, round(CASE WHEN c < 3 THEN v WHEN c < 6 THEN root_pos[c - 2] * pi() / 180 ELSE root_pos[9 - c] * pi() / 180 END, 6) + 0.0 AS value FROM m""")
def bvh_parse_table_function(spark, d):
    """The same texts parsed by a table function of SQL."""
    _texts(spark, d, [F.lit(_head("ZXY", "XYZ", 5))], [F.lit(0.05)]).createOrReplaceTempView("kinetra_texts")
    out = spark.sql(f"""
        SELECT clip_id, t, c, round(x, 6) + 0.0D AS value
        FROM (SELECT clip_id, posexplode(arrays_zip(root, joints)) AS (t, f) FROM {bvh.register_parser(spark)}(TABLE(SELECT clip_id, value FROM kinetra_texts)))
        LATERAL VIEW posexplode(concat(f.root, flatten(f.joints))) AS c, x""")
    return out


@query(f"""WITH {EV}, m AS (SELECT clip_id::VARCHAR AS clip_id, t, CASE c WHEN 0 THEN root_pos[1] WHEN 1 THEN root_pos[2] WHEN 2 THEN root_pos[3] ELSE 0 END AS v, c, root_pos FROM ev, range(9) r(c))
  SELECT clip_id, t, c::INT AS c, round(CASE WHEN c < 3 THEN v WHEN c < 6 THEN root_pos[c - 2] * pi() / 180 ELSE root_pos[9 - c] * pi() / 180 END, 6) + 0.0 AS value FROM m""")
def motion_source(spark, d):
    """The same texts written as files by executors and read by the motion data source."""
    folder = bvh.write_texts(_texts(spark, d, [F.lit(_head("ZXY", "XYZ", 5))], [F.lit(0.05)]), shared_folder(spark, "motion"))
    out = bvh.frames(motionfiles.motion_files(spark, folder, bvh.SCHEMA))
    return out.select("clip_id", "t", F.posexplode(F.concat("root_pos", F.flatten("joint_rot"))).alias("c", "value")).withColumn("value", r6(F.col("value")))


@query("SELECT user_id::VARCHAR AS clip_id, count(*)::INT AS n_frames, 0.05::DOUBLE AS frame_time, 'Hips,Chest' AS joints, false AS whole FROM events WHERE user_id::VARCHAR LIKE '1%' GROUP BY user_id HAVING count(*) > 40")
def motion_heads(spark, d):
    """Heads of files by name: the listing is filtered, and motion is not read (of files that are longer than a head's piece)."""
    folder = bvh.write_texts(_texts(spark, d, [F.lit(_head("ZXY", "XYZ", 5))], [F.lit(0.05)]), shared_folder(spark, "motion"))
    heads = motionfiles.motion_files(spark, folder, "clip_id string, n_frames int, frame_time double, joint_names array<string>, bytes long, bytes_read long")
    heads = heads.where(F.col("clip_id").startswith("1")).where("n_frames > 40")
    return heads.select("clip_id", "n_frames", "frame_time", F.array_join("joint_names", ",").alias("joints"), (F.col("bytes_read") > motionfiles.HEAD_BYTES).alias("whole"))


def _head(root: str, chest: str, length: int) -> str:
    turn = lambda order: " ".join(f"{a}rotation" for a in order)
    return f"HIERARCHY ROOT Hips {{ OFFSET 0 0 0 CHANNELS 6 Xposition Yposition Zposition {turn(root)} JOINT Chest {{ OFFSET 0 {length} 0 CHANNELS 3 {turn(chest)} End Site {{ OFFSET 0 1 0 }} }} }} MOTION "


def _texts(spark, d, heads: list[Column], steps: list[Column]) -> DataFrame:
    """Texts of motion files of the events, a file per user; heads and frame times are dealt to users in turn."""
    x = lambda i: F.col("root_pos")[i].cast("string")
    line = F.concat_ws(" ", x(0), x(1), x(2), x(0), x(1), x(2), x(2), x(1), x(0))
    f = V.ev_frames(spark, d).select("clip_id", F.struct("t", line.alias("line")).alias("f"))
    text = f.groupBy("clip_id").agg(F.array_sort(F.collect_list("f")).alias("f"))
    own = lambda parts: F.element_at(F.array(*parts), (F.col("clip_id") % len(parts) + 1).cast("int")).cast("string")
    whole = F.concat(own(heads), F.lit("Frames: "), F.size("f").cast("string"), F.lit(" Frame Time: "), own(steps), F.lit("\n"), F.array_join(F.transform("f", lambda r: r["line"]), "\n"))
    return text.select(F.col("clip_id").cast("string").alias("clip_id"), whole.alias("value"))


def _files(spark, d, heads: list[Column], steps: list[Column]) -> DataFrame:
    return bvh.parse_rows(_texts(spark, d, heads, steps))


# Clips from two sources: other Euler orders, another bone length, another frame time.
MIXED = [("ZXY", "XYZ", 5, 0.05), ("XYZ", "YZX", 9, 0.1)]


def _mixed(spark, d) -> DataFrame:
    return build.with_axes(_files(spark, d, [F.lit(_head(*m[:3])) for m in MIXED], [F.lit(m[3]) for m in MIXED]))


def _qmul_sql(p: list[str | None], q: list[str | None]) -> list[str | None]:
    """The Hamilton product of quaternions of SQL expressions; None stands for 0."""
    signs = [[(0, 0, 1), (1, 1, -1), (2, 2, -1), (3, 3, -1)], [(0, 1, 1), (1, 0, 1), (2, 3, 1), (3, 2, -1)], [(0, 2, 1), (1, 3, -1), (2, 0, 1), (3, 1, 1)], [(0, 3, 1), (1, 2, 1), (2, 1, -1), (3, 0, 1)]]
    out = []
    for terms in signs:
        parts = [f"{'+' if s > 0 else '-'} ({p[i]}) * ({q[k]})" for i, k, s in terms if p[i] and q[k]]
        out.append(" ".join(parts) or None)
    return out


def _euler_sql(order: str, angles: list[str]) -> list[str]:
    out: list[str | None] = ["1.0", None, None, None]
    for letter, angle in zip(order, angles):
        turn: list[str | None] = [f"cos(({angle}) * pi() / 360)", None, None, None]
        turn["XYZ".index(letter) + 1] = f"sin(({angle}) * pi() / 360)"
        out = _qmul_sql(out, turn)
    return [x or "0.0" for x in out]


def _mixed_sql() -> str:
    """mq: quaternions of both joints; mp: their positions; both with the clip's own orders, bones and frame time."""
    n = len(MIXED)
    joints = [["root_pos[1]", "root_pos[2]", "root_pos[3]"], ["root_pos[3]", "root_pos[2]", "root_pos[1]"]]
    rows = []
    for k, m in enumerate(MIXED):
        for j in (0, 1):
            q = ", ".join(f"{x} AS {c}" for x, c in zip(_euler_sql(m[j], joints[j]), "wxyz"))
            rows.append(f"SELECT clip_id::VARCHAR AS clip_id, t, {j} AS j, {q}, {m[2]} AS bone, {m[3]}::DOUBLE AS step, root_pos FROM ev WHERE clip_id % {n} = {k}")
    up = ["2 * (x * y - w * z)", "1 - 2 * (x * x + z * z)", "2 * (y * z + w * x)"]
    positions = ["SELECT clip_id, t, 0 AS j, step, root_pos[1] AS x, root_pos[2] AS y, root_pos[3] AS z FROM mq WHERE j = 0"]
    positions.append("SELECT clip_id, t, 1 AS j, step, " + ", ".join(f"root_pos[{i + 1}] + bone * ({u}) AS {c}" for i, (u, c) in enumerate(zip(up, "xyz"))) + " FROM mq WHERE j = 0")
    return f"{EV}, mq AS ({' UNION ALL '.join(rows)}), mp AS ({' UNION ALL '.join(positions)})"


@query(f"WITH {_mixed_sql()} {vertex_sql('mq', ['w', 'x', 'y', 'z'])}")
def build_mixed_orders(spark, d):
    """A corpus of two sources: each clip's rotations by its own Euler orders."""
    return cells(build.clip_streams(_mixed(spark, d), "quat"), "joint_rot")


def _two_joints() -> skeleton.Topology:
    return skeleton.Topology([[0.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 1.0, 0.0]], [-1, 0, 1], [0, 1, -1], ["ZXY", "XYZ"])


@query(f"WITH {_mixed_sql()} {vertex_sql('mp', ['x', 'y', 'z'])}")
def build_mixed_offsets(spark, d):
    """Positions by each clip's own bone lengths."""
    return cells(build.clip_streams(_mixed(spark, d), "quat", top=_two_joints(), positions=["joint"]), "joint_pos")


_CENTRAL = ", ".join(f"(coalesce(lead({c}) OVER w, {c}) - coalesce(lag({c}) OVER w, {c})) / (step * (CASE WHEN lag(t) OVER w IS NULL OR lead(t) OVER w IS NULL THEN 1 ELSE 2 END)) AS {c}" for c in "xyz")


@query(f"WITH {_mixed_sql()}, m AS (SELECT clip_id, t, j, {_CENTRAL} FROM mp WINDOW w AS (PARTITION BY clip_id, j ORDER BY t)) {vertex_sql('m', ['x', 'y', 'z'])}")
def build_mixed_fps(spark, d):
    """Velocities by each clip's own frame time."""
    return cells(build.clip_streams(_mixed(spark, d), "quat", top=_two_joints(), velocities=True), "velocities")


_6D_MIXED = [x.format(q="mq") for x in (_ROT[i][k] for k in range(2) for i in range(3))]


@query(f"WITH {_mixed_sql()} {vertex_sql('mq', _6D_MIXED)}")
def build_mixed_6d(spark, d):
    return cells(build.clip_streams(_mixed(spark, d), "6d"), "joint_rot")


def _tip_sql() -> str:
    """Node positions of the mixed clips, the end site too: the chest, and the chest's own up from there."""
    a = {k: f"a.{k}" for k in "wxyz"}
    chest = _qmul_sql([a[k] for k in "wxyz"], [f"b.{k}" for k in "wxyz"])
    up = ["2 * (x * y - w * z)", "1 - 2 * (x * x + z * z)", "2 * (y * z + w * x)"]
    both = f"ch AS (SELECT a.clip_id, a.t, {', '.join(f'{c} AS {k}' for c, k in zip(chest, 'wxyz'))}, p.x AS px, p.y AS py, p.z AS pz FROM mq a JOIN mq b ON a.clip_id = b.clip_id AND a.t = b.t AND a.j = 0 AND b.j = 1 JOIN mp p ON p.clip_id = a.clip_id AND p.t = a.t AND p.j = 1)"
    return f"{_mixed_sql()}, {both}, nd AS (SELECT clip_id, t, j, x, y, z FROM mp UNION ALL SELECT clip_id, t, 2, " + ", ".join(f"p{c} + {u} AS {c}" for u, c in zip(up, "xyz")) + " FROM ch)"


@query(f"WITH {_tip_sql()} {vertex_sql('nd', ['x', 'y', 'z'])}")
def build_node_positions(spark, d):
    return cells(build.clip_streams(_mixed(spark, d), "quat", top=_two_joints(), positions=["node"]), "node_pos")


@query(f"WITH {_mixed_sql()}, o AS (SELECT clip_id, x AS a, z AS c FROM mp WHERE t = 0 AND j = 0), m AS (SELECT clip_id, t, j, x - a AS x, y, z - c AS z FROM mp JOIN o USING (clip_id)) {vertex_sql('m', ['x', 'y', 'z'])}")
def build_first_centered(spark, d):
    """Positions centred on the first frame in the two axes that are not up."""
    return cells(build.clip_streams(_mixed(spark, d), "quat", top=_two_joints(), positions=["joint"], centering="first"), "joint_pos")


@query(f"WITH {_mixed_sql()}, r AS (SELECT * FROM mp WHERE j = 0), m AS (SELECT mp.clip_id, mp.t, mp.j, mp.x - r.x AS x, mp.y - r.y AS y, mp.z - r.z AS z FROM mp JOIN r USING (clip_id, t)) {vertex_sql('m', ['x', 'y', 'z'])}")
def build_skeleton_centered(spark, d):
    return cells(build.clip_streams(_mixed(spark, d), "quat", top=_two_joints(), positions=["joint"], centering="skeleton"), "joint_pos")


@query(f"WITH {_mixed_sql()}, m AS (SELECT clip_id, t, j, x, z AS y, -y AS z FROM mp) {vertex_sql('m', ['x', 'y', 'z'])}")
def build_world_up(spark, d):
    """Clips whose world up is +z, brought to +y: roots, root rotations, and so all positions turn."""
    files = _mixed(spark, d).withColumn("world_up", F.lit("+z"))
    return cells(build.clip_streams(files, "quat", targets={"world_up": "+y"}, top=_two_joints(), positions=["joint"]), "joint_pos")


@query(f"WITH {_mixed_sql()} {vertex_sql('mp', ['x', 'y', 'z'])}")
def build_rest_up(spark, d):
    """The rest pose is turned to +z, bones and rotations alike: no joint moves in space."""
    bones = harmonize.turn_offsets(F.col("offsets"), F.col("rest_up"), "+z")
    return cells(build.clip_streams(_mixed(spark, d), "quat", targets={"rest_up": "+z"}, top=_two_joints(), bones=bones, positions=["joint"]), "joint_pos")


@query(f"WITH {EV} SELECT 'resample' AS stage, count(*) AS n FROM n WHERE clip_id % 2 = 1 UNION ALL SELECT 'rest_up', count(*) FROM n UNION ALL SELECT 'euler_order', count(*) FROM n")
def build_stages(spark, d):
    """How many clips each stage of harmonising changes."""
    facts = _mixed(spark, d).withColumn("fps", audit.fps_key(F.col("frame_time")))
    return audit.stage_counts(build.stages_of(facts, {"fps": 20.0, "world_up": "+y", "rest_up": "+z", "euler_order": "XYZ"}, False))


def _built(spark, d, keep=None, **how) -> tuple[str, str]:
    """A dataset built from motion files of the events (of both sources), and the folder of the files."""
    folder, out = shared_folder(spark, "motion"), shared_folder(spark, "dataset")
    texts = _texts(spark, d, [F.lit(_head(*m[:3])) for m in MIXED], [F.lit(m[3]) for m in MIXED])
    bvh.write_texts(texts, folder)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the sources differ, which the build tells
        build.preprocess(spark, folder, out, keep=keep, **how)
    return folder, out


@query(f"WITH {_mixed_sql()} {vertex_sql('mq', _6D_MIXED)}")
def dataset_frames(spark, d):
    """Files to a dataset on disk and back: the stored rotations."""
    _, out = _built(spark, d, center=False)
    return cells(store.load(spark, out).frames, "joint_rot")


@query("SELECT 'all' AS what, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'odd', count(DISTINCT user_id) FROM events WHERE user_id % 2 = 1 UNION ALL SELECT 'frames', count(*) FROM events")
def dataset_facts(spark, d):
    """What a build tells: clips by frame time, and the frames that the clips' rows count."""
    _, out = _built(spark, d, center=False)
    data = store.load(spark, out)
    rows = data.clips.select(F.explode(F.array(F.lit("all"), F.when(F.col("frame_time") > 0.07, "odd"))).alias("what")).where("what is not null")
    return rows.groupBy("what").agg(F.count("*").alias("n")).unionByName(data.clips.agg(F.lit("frames").alias("what"), F.sum("n_frames").alias("n")))


@query(f"WITH {_mixed_sql()}, fl AS (SELECT (3 + 6 * j + c)::INT AS c, [{', '.join(_6D_MIXED)}][c + 1] AS value FROM mq, range(6) r(c) UNION ALL SELECT c::INT, root_pos[c + 1] FROM ev, range(3) r(c)) {_STATS}")
def dataset_in_steps(spark, d):
    """A dataset built from the files of some names, then extended by the rest: the merged statistics."""
    folder, out = _built(spark, d, keep=lambda stem: stem.like("%1%"), center=False)
    build.extend(spark, folder, out)
    return _rounded(store.load(spark, out).stats.where("block = 'features'"))


# ---- fused passes -----------------------------------------------------------------------------


@query(SQL["convert_quat_6d"])
def fused_convert_quat_6d(spark, d):
    return cells(fused.convert_frames(V.emb_frames(spark, d), "quat", "6d"), "joint_rot")


@query(SQL["convert_quat_axisangle"])
def fused_convert_quat_axisangle(spark, d):
    return cells(fused.convert_frames(V.emb_frames(spark, d), "quat", "axisangle"), "joint_rot")


@query(SQL["convert_quat_euler"])
def fused_convert_quat_euler(spark, d):
    return cells(fused.convert_frames(V.emb_frames(spark, d), "quat", "euler", "ZYX"), "joint_rot")


@query(SQL["speed_slerp"])
def fused_speed_slerp(spark, d):
    return cells(fused.change_speed(V.emb_frames(spark, d), _factor(), "quat"), "joint_rot")


@query(SQL["mirror_quat"])
def fused_mirror_quat(spark, d):
    """A sure step in a fused pass."""
    steps = Pipeline([Step(augment.mirror, 1.0, {"lateral_axis": "+x", "lr_joint_pairs": V.PAIRS})], representation="quat")
    return cells(steps.apply(V.emb_frames(spark, d), seed=1), "joint_rot")


@query(SQL["rotate_vertical_6d"])
def fused_rotate_vertical_6d(spark, d):
    steps = Pipeline([Step(augment.rotate_vertical, 1.0, {"angle": ANGLE, "up_axis": "+y"})], representation="6d")
    return cells(steps.apply(_sixd(spark, d), seed=1), "joint_rot")


# ---- pipelines and feeds ----------------------------------------------------------------------


@query(f"""WITH {EV}, m AS (SELECT *, max(n) OVER (PARTITION BY clip_id % 8) AS w FROM n), g AS (SELECT clip_id, n, unnest(range(w))::INT AS t FROM m)
  SELECT (g.clip_id % 8)::BIGINT AS batch_id, g.clip_id, g.t, g.t < n AS mask, c::INT AS c, round(coalesce(root_pos[c + 1], 0)::FLOAT::DOUBLE, 4) + 0.0 AS value FROM g LEFT JOIN ev ON ev.clip_id = g.clip_id AND ev.t = g.t, range(3) r(c)""")
def collate_pad_mask(spark, d):
    items = MotionFeed(V.ev_frames(spark, d), streams=["root_pos"]).items().withColumn("batch_id", F.col("clip_id") % 8)
    b = collate(items).select("batch_id", F.explode(F.arrays_zip("clip_ids", "data", "mask")).alias("x"))
    b = b.select("batch_id", F.col("x.clip_ids").alias("clip_id"), F.posexplode(F.arrays_zip(F.col("x.data").alias("data"), F.col("x.mask").alias("mask"))).alias("t", "y"))
    return b.select("batch_id", "clip_id", "t", F.col("y.mask").alias("mask"), F.posexplode("y.data").alias("c", "v")).select("batch_id", "clip_id", "t", "mask", "c", (F.round(F.col("v").cast("double"), 4) + F.lit(0.0)).alias("value"))


def standard_pipeline(fused: bool = True) -> Pipeline:
    info = {"lr_pairs": V.PAIRS, "node_lr_pairs": [], "euler_orders": None}
    out = Pipeline.standard(info, representation="quat")
    out.fused = fused
    return out


def _unit_sql(seed: int, epoch: int, step: int, *place: str) -> str:
    """A portable draw: the parts of the place are SQL expressions."""
    parts = " || ':' || ".join([f"'{seed}:{epoch}:{step}'", "clip_id", *place])
    return f"(('0x' || substr(md5({parts}), 1, 13))::UBIGINT::DOUBLE / {1 << 52}.0)"


def _between(u: str, low: float, high: float) -> str:
    return f"({low!r}::DOUBLE + ({high - low!r}::DOUBLE) * {u})"


def _standard_sql(seed: int, epoch: int) -> str:
    """The standard pipeline over quaternion clips: pr (roots) and pq (quaternions) with clip, frame and joint, pn the counts.

    Turned about +y, mirrored across x by a gate, noised, and played faster or slower."""
    u = lambda step, *place: _unit_sql(seed, epoch, step, *place)
    normal = lambda what, c: "sqrt(-2 * ln(1 - " + u(2, "'a'", f"'{what}'", "t", "j", str(c)) + ")) * cos(2 * pi() * " + u(2, "'b'", f"'{what}'", "t", "j", str(c)) + ")"
    sigma = math.radians(1)
    target = "greatest(2, round_even(n / factor, 0)::BIGINT)"
    return f"""{EMB},
      dr AS MATERIALIZED (SELECT clip_id, n, {_between(u(0, "'angle'"), -math.pi, math.pi)} AS angle, {u(1, "'gate'")} < 0.5 AS flip, {_between(u(3, "'factor'"), 0.8, 1.2)} AS factor FROM n),
      r1 AS (SELECT e.clip_id, t, CASE WHEN flip THEN -1 ELSE 1 END * (cos(angle) * e[1] + sin(angle) * e[3]) AS x, e[2] AS y, -sin(angle) * e[1] + cos(angle) * e[3] AS z FROM e JOIN dr USING (clip_id)),
      q2 AS (SELECT clip_id, t, j, CASE WHEN j = 0 THEN w * cos(angle / 2) - y * sin(angle / 2) ELSE w END AS w, CASE WHEN j = 0 THEN x * cos(angle / 2) + z * sin(angle / 2) ELSE x END AS x,
        CASE WHEN j = 0 THEN y * cos(angle / 2) + w * sin(angle / 2) ELSE y END AS y, CASE WHEN j = 0 THEN z * cos(angle / 2) - x * sin(angle / 2) ELSE z END AS z, flip FROM q JOIN dr USING (clip_id)),
      q3 AS (SELECT clip_id, t, (CASE WHEN flip THEN {V.PARTNER} ELSE j END)::INT AS j, w, x, CASE WHEN flip THEN -y ELSE y END AS y, CASE WHEN flip THEN -z ELSE z END AS z FROM q2),
      q4 AS (SELECT *, {normal('axis', 0)} AS a0, {normal('axis', 1)} AS a1, {normal('axis', 2)} AS a2, {normal('angle', 0)} * {sigma!r} / 2 AS h FROM q3),
      q5 AS (SELECT *, sqrt(a0 * a0 + a1 * a1 + a2 * a2) AS s FROM q4),
      q6 AS (SELECT clip_id, t, j, {{'w': cos(h), 'x': sin(h) * a0 / s, 'y': sin(h) * a1 / s, 'z': sin(h) * a2 / s}} AS a, {{'w': w, 'x': x, 'y': y, 'z': z}} AS q FROM q5),
      q7 AS (SELECT clip_id, t, j, {_QMUL} FROM q6),
      q8 AS MATERIALIZED (SELECT clip_id, t, j, w / l AS w, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS l FROM q7)),
      {_stencil(target, 'dr')},
      pn AS (SELECT clip_id, m::INT AS n FROM m),
      src AS (SELECT sa.clip_id, sa.t, u.j, {_Q % (('u',) * 4)} AS p, {_Q % (('v',) * 4)} AS r, a FROM sa JOIN q8 u ON u.clip_id = sa.clip_id AND u.t = l JOIN q8 v ON v.clip_id = sa.clip_id AND v.t = rr AND v.j = u.j),
      {_slerp_ctes('src')}, pq AS MATERIALIZED (SELECT clip_id, t, j, {', '.join(f'{m} AS {k}' for m, k in zip(_SLERPED, 'wxyz'))} FROM s2),
      pr AS MATERIALIZED (SELECT sa.clip_id, sa.t, (1 - a) * o.x + a * i.x AS x, (1 - a) * o.y + a * i.y AS y, (1 - a) * o.z + a * i.z AS z FROM sa JOIN r1 o ON o.clip_id = sa.clip_id AND o.t = l JOIN r1 i ON i.clip_id = sa.clip_id AND i.t = rr)"""


@query(f"WITH {_standard_sql(7, 1)} {vertex_sql('pq', ['w', 'x', 'y', 'z'])}")
def pipeline_standard(spark, d):
    """Rotate, mirror, noise and speed over all clips, drawn by hashes of (seed, epoch, clip, step)."""
    return cells(standard_pipeline().apply(V.emb_frames(spark, d), seed=7, epoch=1, portable=True), "joint_rot")


@query(f"WITH {EV}, m AS (SELECT clip_id, t, [-root_pos[1] * 1.0, root_pos[2], root_pos[3]] AS root_pos FROM ev) {root_sql('m')}")
def pipeline_gates(spark, d):
    """A sure step applies and an impossible one does not."""
    steps = [Step(augment.mirror, 1.0, {"lateral_axis": "+x", "lr_joint_pairs": []}), Step(augment.speed, 0.0, {"factor": 2.0}), Step(augment.rotate_vertical, 0.0, {"angle": 1.0, "up_axis": "+y"})]
    return cells(Pipeline(steps).apply(V.ev_frames(spark, d), seed=3), "root_pos")


def _told_sql() -> str:
    """Rows of the draws as explain tells them: name, gate, and the parameters that are texts, flags or numbers."""
    u = lambda step, name: _unit_sql(7, 1, step, f"'{name}'")
    steps = [
        (0, "rotate_vertical", 1.0, [("angle", _between(u(0, "angle"), -math.pi, math.pi), None), ("up_axis", None, "+y"), ("degrees", None, "false")]),
        (1, "mirror", 0.5, [("lateral_axis", None, "+x")]),
        (2, "rotation_noise", 1.0, [("sigma", f"{math.radians(1)!r}::DOUBLE", None), ("degrees", None, "false")]),
        (3, "speed", 1.0, [("factor", _between(u(3, "factor"), 0.8, 1.2), None)]),
    ]
    rows = [f"SELECT clip_id, {k} AS step, '{name}' AS name, '{p}' AS param, round({number or 'NULL'}, 6) AS number, {f"'{text}'" if text else 'NULL::VARCHAR'} AS text FROM n WHERE {u(k, 'gate')} < {prob}" for k, name, prob, params in steps for p, number, text in params]
    closed = f"SELECT clip_id, 1 AS step, 'mirror' AS name, NULL AS param, NULL::DOUBLE AS number, NULL::VARCHAR AS text FROM n WHERE {u(1, 'gate')} >= 0.5"
    return " UNION ALL ".join([*rows, closed])


@query(f"WITH {EMB} SELECT clip_id, step::INT AS step, name, param IS NOT NULL AS applied, param, number, text FROM ({_told_sql()})")
def explain_draws(spark, d):
    """A row for each parameter of a step that applies to a clip, and one without for a step that does not."""
    clips = V.emb_frames(spark, d).select("clip_id").distinct()
    told = standard_pipeline().explain(clips, seed=7, epoch=1, portable=True)
    rows = told.select("clip_id", "step", "name", "applied", F.explode_outer("params").alias("param", "value"))
    number = F.expr("try_cast(value as double)")
    return rows.select("clip_id", "step", "name", "applied", "param", F.round(number, 6).alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


@query()
def exact_generator_draws(spark, d):
    clips = temporal.frame_counts(V.ev_frames(spark, d)).withColumn("idx", F.col("clip_id").cast("long"))
    return exact_draws(clips, 7, 1, [("gate",), ("uniform", -3.14, 3.14), ("normal", 3)])


def _picked_sql(length: int, u: str, start: str) -> str:
    """pk: the frames that a clip of n frames (pn) is sampled at, modulo n."""
    seg = lambda i: f"(({i}) * n // {length})"
    return f"""pg AS (SELECT clip_id, n, unnest(range({length})) AS i FROM pn), gp AS (SELECT clip_id, n, i AS k, row_number() OVER (PARTITION BY clip_id ORDER BY {u}, i) AS place FROM (SELECT clip_id, n, unnest(range({length} + 1)) AS i FROM pn)),
      pk AS MATERIALIZED (SELECT clip_id, i, ((CASE WHEN n < {length} THEN floor({start} * n)::BIGINT + i WHEN n < {2 * length} THEN i + (SELECT count(*) FROM gp WHERE gp.clip_id = pg.clip_id AND gp.place <= gp.n - {length} AND gp.k <= pg.i)
        ELSE {seg('i')} + floor({u} * ({seg('i + 1')} - {seg('i')}))::BIGINT END) % n)::INT AS t FROM pg)"""


@query(f"""WITH {_standard_sql(5, 2)}, {_picked_sql(32, _unit_sql(5, 2, -2, "'pick'", "i"), _unit_sql(5, 2, -2, "'pick'", "-1"))},
  vx AS (SELECT pk.clip_id, pk.i, 0 AS v, [x, y, z, 0.0] AS c FROM pk JOIN pr USING (clip_id, t) UNION ALL SELECT pk.clip_id, pk.i, j + 1, [w, x, y, z] FROM pk JOIN pq USING (clip_id, t))
  SELECT clip_id, 32 AS length, k::INT AS c, i::INT AS t, v::INT AS v, round(c[k + 1]::FLOAT::DOUBLE, 4) + 0.0 AS value FROM vx, range(4) r(k)""")
def epoch_items(spark, d):
    """A seeded epoch: augmented, derived, sampled to 32 frames, packed as (C, T, V) floats; every number of every item."""
    feed = MotionFeed(V.emb_frames(spark, d), target_length=32, augmentation=standard_pipeline(), seed=5, temporal="resample", layout="ctv", target_repr="quat", source_repr="quat", portable=True)
    items = feed.items(epoch=2).select("clip_id", "length", F.posexplode("data").alias("c", "_x"))
    items = items.select("clip_id", "length", "c", F.posexplode("_x").alias("t", "_x"))
    return items.select("clip_id", "length", "c", "t", F.posexplode("_x").alias("v", "x")).select("clip_id", "length", "c", "t", "v", (F.round(F.col("x").cast("double"), 4) + F.lit(0.0)).alias("value"))


@query(f"WITH {EV}, o AS (SELECT clip_id, {_unit_sql(4, 2, -1, "'order'")} AS u FROM n) SELECT clip_id, floor((row_number() OVER (ORDER BY u, clip_id) - 1) / 8)::BIGINT AS batch_id FROM o")
def epoch_batches(spark, d):
    """Batches of eight clips in the order of an epoch."""
    feed = MotionFeed(V.ev_frames(spark, d), streams=["root_pos"], seed=4, portable=True)
    return feed.shuffled(2, 8).select("clip_id", "batch_id")


@query(f"WITH {EV}, dr AS (SELECT clip_id, {_unit_sql(9, 0, 0, "'gate'")} < 0.6 AS go, {_unit_sql(9, 0, 1, "'gate'")} < 0.5 AS two, {_between(_unit_sql(9, 0, 0, "'angle'"), -1.0, 1.0)} AS a FROM n), m AS (SELECT ev.clip_id, t, [CASE WHEN go THEN cos(a) * root_pos[1] + sin(a) * root_pos[3] ELSE root_pos[1] END, root_pos[2], CASE WHEN go THEN -sin(a) * root_pos[1] + cos(a) * root_pos[3] ELSE root_pos[3] END] AS r, two FROM ev JOIN dr USING (clip_id)), k AS (SELECT clip_id, t, CASE WHEN two THEN [2 * r[1], 2 * r[2], 2 * r[3]] ELSE r END AS root_pos FROM m) {root_sql('k')}")
def pipeline_own_step(spark, d):
    """A drawn turn, then a step of one's own, each behind its gate."""
    double = handles_streams("root_pos")(lambda f: f.withColumn("root_pos", F.transform("root_pos", lambda x: 2 * x)))
    steps = [Step(augment.rotate_vertical, 0.6, {"angle": lambda u: u.uniform(-1.0, 1.0, "angle"), "up_axis": "+y"}), Step(double, 0.5)]
    return cells(Pipeline(steps).apply(V.ev_frames(spark, d), seed=9, portable=True), "root_pos")


@clip_step
def _turned_back(clip, gain):
    """The path about the middle of its range, enlarged and run backwards."""
    root = clip["root_pos"]
    return {"root_pos": (root - (root.min(0) + root.max(0)) / 2)[::-1] * gain}


@clip_step
def _every_second(clip):
    return {s: v[::2] for s, v in clip.items()}


@query(f"""WITH {EV}, dr AS (SELECT clip_id, n, {_unit_sql(11, 1, 0, "'gate'")} < 0.6 AS go, {_between(_unit_sql(11, 1, 0, "'gain'"), 0.5, 2.0)} AS gain, {_unit_sql(11, 1, 1, "'gate'")} < 0.5 AS half FROM n),
  mid AS (SELECT clip_id, c, (min(root_pos[c + 1]) + max(root_pos[c + 1])) / 2 AS mid FROM ev, range(3) r(c) GROUP BY ALL),
  m AS (SELECT ev.clip_id, CASE WHEN go THEN n - 1 - t ELSE t END AS t, c, half, CASE WHEN go THEN (root_pos[c + 1] - mid) * gain ELSE root_pos[c + 1] END AS x FROM ev JOIN dr USING (clip_id) JOIN mid USING (clip_id))
  SELECT clip_id, CASE WHEN half THEN t // 2 ELSE t END::INT AS t, 0 AS v, c::INT AS c, round(x, 6) + 0.0 AS value FROM m WHERE NOT half OR t % 2 = 0""")
def pipeline_numpy_steps(spark, d):
    """Two steps on the arrays of a whole clip, each behind its gate: one with a drawn value, one that changes the length."""
    steps = [Step(_turned_back, 0.6, {"gain": lambda u: u.uniform(0.5, 2.0, "gain")}), Step(_every_second, 0.5)]
    return cells(Pipeline(steps).apply(V.ev_frames(spark, d), seed=11, epoch=1, portable=True), "root_pos")


@query(f"WITH {EV} SELECT clip_id, n, k AS draws, 0::BIGINT AS wrong FROM n, (VALUES ('generator'), ('hash')) g(k)")
def explain_equals_items(spark, d):
    """Frames of an epoch's items that are not what the told draws make of the clip, for draws by hash and by generators."""
    paths, out = V.ev_frames(spark, d), None
    steps = Pipeline([Step(augment.rotate_vertical, 0.5, {"angle": lambda u: u.uniform(-3.0, 3.0, "angle"), "up_axis": "+y"}), Step(augment.mirror, 0.4, {"lateral_axis": "+x", "lr_joint_pairs": []})])
    ids = paths.select("clip_id").distinct().withColumn("idx", F.col("clip_id").cast("long"))
    for kind, generators in (("hash", None), ("generator", ids)):
        feed = MotionFeed(paths, streams=["root_pos"], augmentation=steps, seed=3, generators=generators)
        told = feed.explain_augmentation(epoch=4).groupBy("clip_id").agg(
            F.max(F.when(F.col("step") == 0, F.col("params")["angle"].cast("double"))).alias("a"), F.min(F.when((F.col("step") == 1) & F.col("applied"), -1).otherwise(1)).alias("side")
        )
        a, x, y, z = F.coalesce("a", F.lit(0.0)), *(F.col("root_pos")[i] for i in range(3))
        made = paths.join(told, "clip_id").select("clip_id", "t", F.array(F.col("side") * (F.cos(a) * x + F.sin(a) * z), y, F.cos(a) * z - F.sin(a) * x).alias("want"))
        items = feed.items(epoch=4).select("clip_id", F.posexplode("data").alias("t", "got"))
        off = F.exists(F.zip_with("want", "got", lambda p, q: F.abs(p - q) > 1e-5 * (1 + F.abs(p))), lambda bad: bad)
        rows = made.join(items, ["clip_id", "t"], "left").groupBy("clip_id").agg(F.count("*").cast("int").alias("n"), F.sum(F.when(F.coalesce(off, F.lit(True)), 1).otherwise(0)).alias("wrong"))
        rows = rows.select("clip_id", "n", F.lit(kind).alias("draws"), "wrong")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH {EV}, o AS (SELECT clip_id, n, row_number() OVER (ORDER BY {_unit_sql(4, 2, -1, "'order'")}, clip_id) - 1 AS k FROM n)
  SELECT ((k // 8) % 3)::INT AS rank, (k // 8 // 3)::BIGINT AS batch, (k % 8)::INT AS place, clip_id, n AS length FROM o""")
def epoch_shards(spark, d):
    """An epoch written for three trainers, and read again as each trainer reads its own."""
    folder = shared_folder(spark, "epochs")
    feed = MotionFeed(V.ev_frames(spark, d), streams=["root_pos"], seed=4, portable=True)
    shards.write_epoch(feed, folder, 2, world_size=3, batch_size=8, shard_batches=2)

    def read(batches):
        for b in batches:
            for rank in b.column("id").to_pylist():
                for number, rows in shards.RankReader(folder, rank, 3, epoch=2).rows():
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([rank] * n, pa.int32()), pa.array([number] * n, pa.int64()), *(rows.column(c).combine_chunks().cast(k) for c, k in (("place", pa.int32()), ("clip_id", pa.int64()), ("length", pa.int32())))], ["rank", "batch", "place", "clip_id", "length"])

    return spark.range(3).repartition(3).mapInArrow(read, "rank int, batch long, place int, clip_id long, length int")


@query(f"WITH {EV} SELECT (row_number() OVER (ORDER BY clip_id) - 1)::BIGINT AS number, n.clip_id, n AS n_frames, (SELECT round(sum(root_pos[2]), 4) FROM ev WHERE ev.clip_id = n.clip_id) AS total FROM n")
def clips_by_number(spark, d):
    """Clips stored by number, and each read by its number, as a trainer does."""
    folder, paths = shared_folder(spark, "numbered"), V.ev_frames(spark, d)
    index = numbered.write(paths, paths.select("clip_id").distinct(), folder, file_clips=16)

    def read(batches):
        clips = numbered.NumberedClips(folder)
        for b in batches:
            found = [clips[i - (len(clips) if i % 2 else 0)] for i in b.column("number").to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in found], t) for k, t in (("number", pa.int64()), ("clip_id", pa.int64()), ("n_frames", pa.int32()))] + [pa.array([float(c["root_pos"][:, 1].sum()) for c in found])], ["number", "clip_id", "n_frames", "total"])

    return index.select("number").mapInArrow(read, "number long, clip_id long, n_frames int, total double").withColumn("total", F.round("total", 4))


@query(f"WITH {EV} SELECT clip_id, {_unit_sql(1, 0, 0, "'gate'")} < 0.5 AS gate, round({_between(_unit_sql(1, 0, 0, "'value'"), -1.0, 1.0)}, 6) + 0.0 AS value FROM n")
def native_uniforms(spark, d):
    draws = Draws(1, 0, 0, portable=True)
    clips = V.ev_frames(spark, d).select("clip_id").distinct()
    return clips.select("clip_id", draws.gate(0.5).alias("gate"), r6(draws.uniform(-1, 1)).alias("value"))


def flagship(spark, d) -> DataFrame:
    """Centred root paths with velocity-like and acceleration-like differences, as flat rows."""
    f = V.ev_frames(spark, d).withColumn("joint_pos", F.array("root_pos"))
    return packing.pack_flat(f, ["root_pos", "joint_pos", "joint_vel", "joint_acc"], "world", True)
