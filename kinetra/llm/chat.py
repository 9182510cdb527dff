"""Chat formatting of reply trees, with DataFrame functions only.

Every message points to its parent. Jump tables (the ancestor 1, 2, 4, ... steps up) come from
repeated self-joins, and each leaf then collects its ancestors by joining through them, so a thread of
n messages takes log2(n) joins. Each root-to-leaf path is ranked among the paths of its tree by the
sum of its scores, and is formatted as one conversation with a loss mask over assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.scratch import Scratch

#: Template: OPEN role MIDDLE text CLOSE for each turn.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|says|>", "<|over|>\n"


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one between < and |, so no control string is left in a text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def paths(messages: DataFrame) -> DataFrame:
    """``messages(tree, node, parent, ...)`` -> ``(tree, leaf, node, up)``: for each leaf, its ancestors
    and itself, ``up`` steps above it. A parent that the tree lacks counts as none; nodes on a cycle
    have no leaf and no path; ``node`` must be unique in its tree."""
    scratch = Scratch(messages.sparkSession, "chat")
    messages = scratch.table(messages.select("tree", "node", "parent"))
    up = messages.where("parent is not null").select("tree", "node", F.col("parent").alias("to"))
    real = messages.select("tree", F.col("node").alias("to"))
    jumps = [scratch.table(up.join(real, ["tree", "to"], "left_semi"))]
    total = messages.count()
    while (1 << len(jumps)) <= total:
        last = jumps[-1]
        step = last.select("tree", F.col("node").alias("to"), F.col("to").alias("then"))
        new = scratch.table(last.join(step, ["tree", "to"]).select("tree", "node", F.col("then").alias("to")))
        if new.isEmpty():
            break
        jumps.append(new)
    parents = jumps[0].select("tree", F.col("to").alias("node"))
    found = messages.select("tree", "node").join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):  # each round is written, so that the plan stays as long as one round
        before = scratch.table(found)
        more = before.join(jumps[k], ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        found = before.unionByName(more)
    return found


def format_threads(messages: DataFrame) -> DataFrame:
    """One row per root-to-leaf path: ``tree, leaf, rank, score, n_turns, formatted, loss_spans``.

    ``messages(tree, node, parent, role, text, score)``; null text and role count as empty, null score
    as 0. ``rank`` counts from 1 by score, then by leaf. ``loss_spans`` are (start, length) in code
    points of ``formatted``, one for each assistant turn, in order. Of rows that repeat a (tree, node) the
    smallest by parent, role, text and score counts, nulls first. Rows with a null node
    are left out. A null tree is a tree of its own. An empty table gives an empty result; other columns are ignored.
    """
    m = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    m = m.where("node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*")
    m = m.withColumn("tree", F.struct(F.col("tree").isNull().alias("none"), F.coalesce("tree", F.lit(0).cast(m.schema["tree"].dataType)).alias("id")))  # a null tree is a tree of its own
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    turn = m.join(paths(m.select("tree", "node", "parent")), ["tree", "node"]).select("tree", "leaf", "up", "score", (F.col("role") == "assistant").alias("learn"), head.alias("head"), escape(F.col("text")).alias("body"))
    turn = turn.withColumn("size", F.length("head") + F.length("body") + F.lit(len(CLOSE)))
    before = F.sum("size").over(Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))) - F.col("size")
    turn = turn.withColumn("span", F.when(F.col("learn"), F.struct((before + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("length"))))
    row = F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "span")
    one = turn.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.count("*").alias("n_turns"), F.array_sort(F.collect_list(row)).alias("rows"))
    spans = F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull())
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    return one.select(F.when(~F.col("tree.none"), F.col("tree.id")).alias("tree"), "leaf", rank.alias("rank"), "score", "n_turns", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parsed(threads: DataFrame) -> DataFrame:
    """Reads ``formatted`` and ``loss_spans`` back: adds ``turns array<struct<role, text>>`` and ``loss``,
    the unescaped text under the mask, in order."""
    body = lambda s: F.substring(s, 1, F.length(s) - len(CLOSE))
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), 2, F.greatest(F.col("n_turns").cast("int"), F.lit(1)))
    one = lambda s: F.struct(unescape(F.substring_index(s, MIDDLE, 1)).alias("role"), unescape(F.substring_index(body(s), MIDDLE, -1)).alias("text"))
    masked = F.transform("loss_spans", lambda p: unescape(F.substring("formatted", (p["start"] + 1).cast("int"), p["length"].cast("int"))))
    return threads.withColumns({"turns": F.transform(pieces, one), "loss": F.array_join(masked, "")})


def as_replies(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` rows as trees in which each turn answers the one before it.

    Turns are ordered by turn, then role, then text (nulls first), so repeated rows keep a fixed order.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


PROBE_TEXT = "</s>[INST] ok [/INST]"


def op5_chat(spark, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    back = parsed(format_threads(as_replies(c.unionByName(probe))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE_TEXT}', 'user', '{PROBE_TEXT}'
  UNION ALL SELECT -1, 1, 'assistant', '{PROBE_TEXT}', 'assistant', '{PROBE_TEXT}'
), e AS (
  SELECT *, replace(replace(role, '\\', '\\\\'), '<|', '<\\|') AS er, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS et FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(er) + length(et) + {len(OPEN) + len(MIDDLE) + len(CLOSE)})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
