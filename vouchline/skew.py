"""Ordered computations that stay parallel when one key holds a large share of all rows.

A plain window sorts every row of a key in one task. Here the keys that hold more than `HOT_ROWS` rows are found by a
pre-aggregated count, and only their rows are split further by an order-preserving bucket (a date, a block of row
positions). Running values are computed inside each bucket, and the totals of the earlier buckets (one row per hot
key and bucket) are added afterwards. The result equals the plain window for every input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HOT_ROWS = 1 << 21
MAX_HOT_KEYS = 10_000
BLOCK = 1 << 16


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """The heaviest keys with a `_hot` mark, at most MAX_HOT_KEYS of them, so the result may be broadcast.

    A key that is left out is only computed without splitting; no result depends on this list.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > (HOT_ROWS if hot_rows is None else hot_rows))
        .orderBy(F.desc("_rows"), *keys)
        .limit(MAX_HOT_KEYS)
        .select(*keys, F.lit(True).alias("_hot"))
    )


def block(position: str | Column, size: int | None = None) -> Column:
    """Bucket of a dense integer position."""
    column = F.col(position) if isinstance(position, str) else position
    return F.floor(column / F.lit(size or BLOCK)).cast("long")


def _split(df: DataFrame, keys: list[str], split: Column, hot: DataFrame | None) -> DataFrame:
    """Mark the rows of hot keys and give them their bucket; every other key is one bucket.

    A handed-in list may name only the leading part of the keys: all keys below it are then split.
    """
    listed = hot_keys(df.select(*keys), keys) if hot is None else hot
    return df.join(F.broadcast(listed), [c for c in listed.columns if c != "_hot"], "left").withColumn("_part", F.when(F.col("_hot"), split))


def _by_part(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*[F.col(k) for k in keys], F.col("_part"))


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    split: Column,
    running: dict[str, tuple[str, Column]] | None = None,
    lags: dict[str, str] | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add running values and previous-row values per key, in ascending `order`.

    `running` maps an output column to (kind, expression): "sum" and "max" run up to the current row, "max_before" up to
    the row before. `lags` maps an output column to the column whose previous value it holds. `split` must not decrease
    along `order`. Counting the hot keys reads `df` once more, so where `df` is costly to compute `hot` should hand in keys
    counted on the table it comes from.
    """
    running, lags = running or {}, lags or {}
    base = _split(df, keys, split, hot)
    per_part = W.partitionBy(*keys, "_part").orderBy(*order)
    upto = per_part.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = per_part.rowsBetween(W.unboundedPreceding, -1)
    whole = {"sum": F.sum, "max": F.max, "max_before": F.max}
    local = _by_part(base, keys).withColumns(
        {
            **{name: whole[kind](expr).over(before if kind == "max_before" else upto) for name, (kind, expr) in running.items()},
            **{name: F.lag(source).over(per_part) for name, source in lags.items()},
            **({"_first": F.row_number().over(per_part) == 1} if lags else {}),
        }
    )

    totals = (
        base.filter("_hot")
        .groupBy(*keys, "_part")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            *[whole[kind](expr).alias(f"_t_{name}") for name, (kind, expr) in running.items()],
            *[F.max_by(F.struct(source), F.struct(*order)).alias(f"_l_{name}") for name, source in lags.items()],
        )
    )
    parts = W.partitionBy(*keys).orderBy("_part")
    earlier = parts.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_part",
        *[whole[kind](f"_t_{name}").over(earlier).alias(f"_o_{name}") for name, (kind, _) in running.items()],
        *[F.lag(f"_l_{name}").over(parts)[source].alias(f"_p_{name}") for name, source in lags.items()],
    )

    joined = local.join(offsets, [*keys, "_part"], "left")
    out: dict[str, Column] = {}
    for name, (kind, _) in running.items():
        offset = F.col(f"_o_{name}")
        if kind == "sum":
            out[name] = F.when(offset.isNull(), F.col(name)).otherwise(F.coalesce(F.col(name), F.lit(0)) + offset)
        else:
            out[name] = F.greatest(F.col(name), offset)
    for name in lags:
        out[name] = F.when(F.col("_hot") & F.col("_first"), F.col(f"_p_{name}")).otherwise(F.col(name))
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[value.alias(name) for name, value in out.items()])


def islands(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    split: Column,
    previous: str,
    opens: Callable[[Column], Column],
    out: str,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Number runs of rows from 1 per key. A row opens a new run when it is the first of its key, or when
    `opens(value)` is true or null for the previous row's `previous`.

    Inside a bucket the first row counts as 0; whether it really opens a run is decided on the table of buckets, which
    knows the last row of the bucket before.
    """
    base = _split(df, keys, split, hot)
    per_part = W.partitionBy(*keys, "_part").orderBy(*order)
    local = (
        _by_part(base, keys)
        .withColumns({"_before": F.lag(previous).over(per_part), "_nth": F.row_number().over(per_part)})
        .withColumn("_open", F.when((F.col("_nth") == 1) | ~F.coalesce(opens(F.col("_before")), F.lit(True)), 0).otherwise(1))
        .withColumn(out, F.sum("_open").over(per_part.rowsBetween(W.unboundedPreceding, W.currentRow)))
    )
    rows = [c for c in df.columns if c not in keys]
    buckets = local.filter("_hot").groupBy(*keys, "_part").agg(
        F.sum("_open").alias("_opened"), F.max_by(previous, F.struct(*order)).alias("_last"), F.min_by(F.struct(*rows), F.struct(*order)).alias("_row"),
    )
    parts = W.partitionBy(*keys).orderBy("_part")
    offsets = (
        buckets.select(*keys, "_part", "_row.*", "_opened", F.lag(F.struct("_last")).over(parts).alias("_prior"))
        .withColumn("_starts", F.when(F.col("_prior").isNull() | F.coalesce(opens(F.col("_prior._last")), F.lit(True)), 1).otherwise(0))
        .select(*keys, "_part", (
            F.sum("_starts").over(parts.rowsBetween(W.unboundedPreceding, W.currentRow))
            + F.coalesce(F.sum("_opened").over(parts.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ).alias("_offset"))
    )
    number = (F.col(out) + F.coalesce("_offset", F.lit(1))).cast("long")
    return local.join(offsets, [*keys, "_part"], "left").select(*df.columns, number.alias(out))
