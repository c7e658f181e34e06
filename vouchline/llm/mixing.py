"""Mixing sources to target weights by hash thresholds, without sorting or collecting documents.

Every document has a fixed 60-bit hash. A source's target beyond whole repetitions is filled by the documents with the smallest hashes:
words are summed by source and the first 12 bits of the hash, the bucket in which the budget runs out is found from the running sum,
and only that bucket is summed again by the next 12 bits, and once more. Documents below the final threshold are taken once more than
the others. Native DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouchline.llm.common import WORD, table, written
from vouchline.llm.registry import query

WEIGHTS, MOST = (1, 2, 3), 3
BITS, LEVELS, HASH_BITS = 12, 3, 60
#: Columns that mixing adds; columns of these names that come in are replaced.
ADDED = ("size", "source_size", "target", "taken")
_SPACE = r"[\x20\x09-\x0D]"


def word_count(text: str = "text") -> Column:
    """Number of words of a text, 0 for null: each word with the white space around it becomes one character."""
    runs = F.regexp_replace(F.col(text), rf"{_SPACE}*+[^\x20\x09-\x0D]++{_SPACE}*+", "x")
    return F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.char_length(runs)).otherwise(0).cast("long")


def order_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of the md5 of id and text: the same in every run, and spread out where ids are missing or repeat."""
    whole = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(source, source_size), one row per source -> source, source_size, target.

    Weights repeat over the sources in code point order, null last. All targets add up to all sizes; a target above `most` times its
    source stops there and the rest is shared by weight again. Sources in order of (cap / weight) fill up first, so one running sum
    finds those that stop: no loop.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("stops", F.col("cap") / F.col("weight") <= share)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(whole), F.lit(0))
    open_ = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(whole)
    return rows.select("source", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("weight") * (rest / open_)).alias("target"))


def budgets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """rows(source, size, h) -> source, source_size, target, whole (repetitions of every document), threshold, with_threshold.

    A document is taken once more if the first BITS * LEVELS bits of its hash are below the threshold, or equal and with_threshold.
    """
    first = rows.groupBy("source", F.shiftright("h", HASH_BITS - BITS).alias("bucket")).agg(F.sum("size").alias("size"))
    sources = targets(first.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    sources = sources.withColumn("whole", whole.cast("long")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = written(sources, "mix-sources")
    edge = sources.where("left > 0").select("source", "left", F.lit(0.0).alias("below"))
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - BITS * level
        if level == 1:
            sums = first
        else:  # only the bucket in which the budget runs out
            inside = rows.join(edge.select(F.col("source").alias("s"), "bucket"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("bucket")))
            sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        known = edge.select(F.col("source").alias("s"), "left", "below")
        running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        placed = sums.withColumn("run", running).join(known, F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", F.col("below") + F.col("run"))
        reach = placed.where("upto >= left").groupBy("source").agg(F.min(F.struct("bucket", "upto", "size", "left")).alias("e"))
        edge = reach.select("source", "e.left", "e.bucket", (F.col("e.upto") - F.col("e.size")).alias("below"), F.col("e.upto").alias("upto"))
        edge = written(edge, "mix-edge")
    edge = edge.select(F.col("source").alias("s"), F.col("bucket").alias("threshold"), (F.col("upto") - F.col("left") <= F.col("left") - F.col("below")).alias("with_threshold"))
    return written(sources.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "left"), "mix-budgets")


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(source, size, h, ...) with source_size, target and taken."""
    plan = plan.withColumnRenamed("source", "s")
    head = F.shiftright("h", HASH_BITS - BITS * LEVELS)
    more = F.coalesce((head < F.col("threshold")) | ((head == F.col("threshold")) & F.col("with_threshold")), F.lit(False))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return joined.withColumn("taken", F.col("size") * (F.col("whole") + more.cast("long"))).drop("s", "whole", "threshold", "with_threshold", "h")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h of each document; budgets): the narrow table is written once and the texts are read once."""
    rows = written(docs.select("doc_id", "source", word_count().alias("size"), order_hash().alias("h")), "mix-rows")
    return rows, budgets(rows, weights, most)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """`docs` with size, source_size, target and taken (words, repetitions counted). One row for each row.

    Null texts have size 0; documents of size 0 take nothing. A null source is a source of its own. Rows that agree in id and text are
    taken alike. Without rows the result is empty.
    """
    docs = docs.drop(*ADDED, "h", "s")
    _, plan = mix_plan(docs, weights, most)
    return take(docs.withColumn("size", word_count()).withColumn("h", order_hash()), plan)


# The same result by one sort of all documents.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT >> 24 AS head FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
c AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS everything, (sum(weight) OVER ())::BIGINT AS weights,
             coalesce(sum(cap) OVER w, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER w, 0)::BIGINT AS weight_before
      FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap / weight <= (everything - cap_before) / (weights - weight_before) AS stops FROM c),
t AS (SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE weight * ((everything - coalesce((sum(cap) FILTER (stops) OVER ())::BIGINT, 0)) / (sum(weight) FILTER (NOT stops) OVER ())::BIGINT) END AS target FROM f),
l AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS whole FROM t),
h AS (SELECT source, head, sum(sum(size)) OVER (PARTITION BY source ORDER BY head)::BIGINT AS upto, sum(size)::BIGINT AS size FROM d GROUP BY source, head),
e AS (SELECT h.source, min(head) AS head, arg_min(upto, head) AS upto, arg_min(size, head) AS size, any_value(target - whole * source_size) AS remainder
      FROM h JOIN l ON h.source IS NOT DISTINCT FROM l.source WHERE target - whole * source_size > 0 AND upto >= target - whole * source_size GROUP BY h.source)
SELECT d.doc_id, d.size, l.source_size, l.target,
       d.size * (l.whole + CASE WHEN d.head < e.head OR (d.head = e.head AND e.upto - e.remainder <= e.remainder - (e.upto - e.size)) THEN 1 ELSE 0 END) AS taken
FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""


@query("op2_mixing", MIX_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, plan = mix_plan(table(spark, sf_dir, "documents"))
    return take(rows, plan).select("doc_id", "size", "source_size", "target", "taken")
