"""Exact dedup by recipes of content-defined chunks, with DataFrame functions only.

A text is cut where its content says so (after a space that a certain pattern of letters precedes), between a
least and a largest chunk length. Each distinct chunk moves once, to be verified: a 64-bit hash that stands
for one content is the chunk's identifier, and where contents collide the identifier also has the
content's number. A document's recipe is its ordered list of identifiers; documents are compared by
recipes, so long texts do not move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.scratch import Scratch
from kinetra.llm.skew import join_groups

LEAST, LARGEST = 64, 4096
_ODD, _EVEN = "[acegikmoqsuwyACEGIKMOQSUWY13579]", "[^acegikmoqsuwyACEGIKMOQSUWY13579]"
#: A chunk ends at a white space whose seven characters before have this pattern of two classes: about one
#: place in 128, wherever the chunk began, so chunks meet again after an insert. LEAST and LARGEST bound it.
_MARK = _ODD + _EVEN + _ODD + _ODD + _EVEN + _EVEN + _ODD
CHUNK = rf"(?s).{{{LEAST},{LARGEST - 1}}}?\s(?<={_MARK}\s)|.{{1,{LARGEST}}}"


def chunks(text: Column) -> Column:
    """The chunks of a text, which joined give the text; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def collisions(docs: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """``(hash, chunk, variant)`` of the hashes that stand for more than one content."""
    moved = docs.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(key(F.col("chunk")).alias("hash"), "chunk")
    distinct = moved.groupBy("hash", "chunk").agg(F.lit(1).alias("_one")).select("hash", "chunk")
    odd = distinct.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    again = distinct.join(odd, "hash", "left_semi")
    return again.withColumn("variant", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")))


def recipes(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``docs`` with ``recipe array<bigint>``: equal for equal texts only.

    With no collision (the case in practice) a recipe is the list of chunk hashes, made within the row.
    Otherwise every hash is followed by its variant, 0 where it stands for one content.
    """
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    plain = F.transform(chunks(F.col("text")), lambda c: key(c))
    if collisions(docs, key).isEmpty():
        return docs.withColumn("recipe", plain)
    odd = collisions(docs, key)
    rows = docs.select("text").distinct().select("text", F.posexplode(chunks(F.col("text"))).alias("at", "chunk")).withColumn("hash", key(F.col("chunk")))
    marked = rows.join(odd, ["hash", "chunk"], "left").select("text", "at", "hash", F.coalesce("variant", F.lit(0)).cast("long").alias("variant"))
    listed = marked.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("at", "hash", "variant"))).alias("rows"))
    listed = listed.select("text", F.flatten(F.transform("rows", lambda r: F.array(r["hash"], r["variant"]))).alias("recipe"))
    return docs.join(listed, "text", "left").withColumn("recipe", F.coalesce("recipe", F.array().cast("array<bigint>")))


def exact_groups(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest
    doc_id stays (a null doc_id is the smallest; if all are null, keep_id is null and all rows stay).
    Rows that repeat the kept doc_id are all marked kept. Other columns are ignored; an empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "recipes")
    listed = recipes(docs.select("doc_id", "text"), key).select("doc_id", "recipe", F.sha2("text", 256).alias("text_sha256"))
    groups = listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = scratch.table(groups.where("group_size > 1"))  # a text that stands alone needs no partner
    out = join_groups(listed, groups, ["recipe"], "group_size", groups.agg(F.sum("group_size")).first()[0] or 0, ["doc_id"])
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
