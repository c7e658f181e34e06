"""Validation steps the requirements describe: balance, order, duplicates, periods, bank detection, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouchline.skew import block, hot_keys, ordered
from vouchline.sources.templates import GENERIC_KEYWORDS

TOLERANCE = "0.01"
FILE_DAYS = 90
TRANSACTION_YEARS = 7

ACCOUNT_NUMBER = r"(?i)\ba/?c(?:count)?\s*(?:no|number)?\.?\s*:?\s*(\d{9,18})\b"
IFSC_CODE = r"(?i)\bIFSC\s*:?\s*([A-Z]{4}0[A-Z0-9]{6})\b"
HOLDER = r"(?i)\b(?:account holder|name)\s*:\s*([A-Za-z][A-Za-z .]*[A-Za-z.])"


def with_previous(tx: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Balance and date of the row above, per statement; safe for very long statements."""
    return ordered(
        tx, ["statement_id"], ["row_number"], split=block("row_number"),
        lags={"previous_balance": "balance", "previous_date": "txn_date"}, hot=hot,
    )


def _moved() -> Column:
    zero = F.lit(0).cast("decimal(18,2)")
    return F.coalesce("credit", zero) - F.coalesce("debit", zero)


def balance_fails() -> Column:
    gap = F.abs(F.col("previous_balance") + _moved() - F.col("balance"))
    return F.coalesce(gap > F.lit(TOLERANCE).cast("decimal(3,2)"), F.lit(False))


def date_goes_back() -> Column:
    return F.coalesce(F.col("txn_date") < F.col("previous_date"), F.lit(False))


def duplicate_keys(tx: DataFrame) -> DataFrame:
    """(statement, date, amount, narration, reference) groups with more than one row: pre-aggregated, no row window."""
    return tx.groupBy("statement_id", "txn_date", "debit", "credit", "narration", "reference_no").agg(
        F.count(F.lit(1)).alias("copies")
    ).filter("copies > 1")


def mark_duplicates(tx: DataFrame) -> DataFrame:
    keys = ["statement_id", "txn_date", "debit", "credit", "narration", "reference_no"]
    groups = duplicate_keys(tx).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return tx.join(groups, same, "left").withColumn("is_duplicate", F.col("copies").isNotNull()).drop(*[f"_{k}" for k in keys], "copies")


def statement_balances(tx: DataFrame) -> DataFrame:
    """Opening and closing balance, period and the sum check per statement."""
    movement = F.struct("balance", _moved().alias("moved"))
    ends = tx.groupBy("statement_id").agg(
        F.min_by(movement, "row_number").alias("_a"), F.max_by("balance", "row_number").alias("closing_balance"),
        F.min("txn_date").alias("period_start"), F.max("txn_date").alias("period_end"),
        F.sum(_moved()).alias("net_movement"),
    ).withColumn("opening_balance", (F.col("_a.balance") - F.col("_a.moved")).cast("decimal(18,2)"))
    gap = F.abs(F.col("opening_balance") + F.col("net_movement") - F.col("closing_balance"))
    return ends.select(
        "statement_id", "opening_balance", "closing_balance", "period_start", "period_end",
        F.col("net_movement").cast("decimal(28,2)").alias("net_movement"),
        (gap <= F.lit(TOLERANCE).cast("decimal(3,2)")).alias("sum_ok"),
    )


def with_warnings(tx: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Array of warning names per transaction."""
    checked = mark_duplicates(with_previous(tx, hot))
    return checked.withColumn(
        "validation_warnings",
        F.array_compact(F.array(
            F.when(balance_fails(), "balance_mismatch"), F.when(date_goes_back(), "date_order"), F.when(F.col("is_duplicate"), "duplicate"),
        )),
    )


def detect_bank(df: DataFrame, templates: DataFrame, text: str = "header_text", generic: list[str] = GENERIC_KEYWORDS) -> DataFrame:
    """`df` with `bank_code`, the best bank of the catalogue for a header text: IFSC pattern 100 points, own keyword 10, keyword many banks share 1.

    The catalogue (one short row per bank) is one value that every row is held against. Equal scores go to the longer keyword ("State Bank
    of India" over "Bank of India"), then to the first bank by code; no match gives null.
    """
    banks = templates.select("code", "keywords", "ifsc_regex").agg(F.array_sort(F.collect_list(F.struct("code", "keywords", "ifsc_regex")))).scalar()
    header_text = F.col(text)

    def score(bank: Column) -> Column:
        words = F.filter(bank["keywords"], lambda w: F.contains(header_text, w))
        points = F.aggregate(words, F.lit(0), lambda n, w: n + F.when(w.isin(generic), 1).otherwise(10))
        ifsc = F.when(F.exists(bank["ifsc_regex"], lambda p: F.rlike(header_text, p)), 100).otherwise(0)
        longest = F.aggregate(words, F.lit(0), lambda n, w: F.greatest(n, F.length(w)))
        return F.struct((points + ifsc).alias("score"), longest.alias("longest"), bank["code"].alias("code"))

    best = F.aggregate(
        F.transform("_banks", score), F.lit(None).cast("struct<score:int,longest:int,code:string>"),
        lambda kept, one: F.when((one["score"] > 0) & (kept.isNull() | (F.struct(one["score"], one["longest"]) > F.struct(kept["score"], kept["longest"]))), one).otherwise(kept),
    )
    return df.withColumn("_banks", banks).withColumn("bank_code", best["code"]).drop("_banks")


def header_fields(text: Column) -> list[Column]:
    """Account number, IFSC and holder from the text above the header row."""
    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    return [found(ACCOUNT_NUMBER).alias("account_number"), F.upper(found(IFSC_CODE)).alias("ifsc"), found(HOLDER).alias("holder")]


def stitch_periods(periods: DataFrame, gap_days: int = 1) -> DataFrame:
    """Statements of one account whose periods touch or overlap get one `stitch_no` (from 1 per account)."""
    keys, order, split = ["account_number"], ["period_start", "statement_id"], F.date_trunc("month", "period_start")
    hot = hot_keys(periods, keys)
    reach = ordered(periods, keys, order, split, running={"_before": ("max_before", F.col("period_end"))}, hot=hot)
    opens = F.when(F.col("_before").isNull() | (F.col("period_start") > F.date_add("_before", gap_days)), 1).otherwise(0)
    return ordered(reach, keys, order, split, running={"stitch_no": ("sum", opens)}, hot=hot).drop("_before")


def stitched(periods: DataFrame) -> DataFrame:
    return stitch_periods(periods).groupBy("account_number", "stitch_no").agg(
        F.count(F.lit(1)).alias("parts"), F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end")
    )


def past_retention(df: DataFrame, date_column: str, today: Column, days: int | None = None, years: int | None = None) -> DataFrame:
    """Rows old enough to delete."""
    limit = F.date_sub(today, days) if days is not None else F.add_months(today, -12 * years)
    return df.filter(F.col(date_column) < limit)


def edit_rate(edits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Edited share of the transactions shown in each review session."""
    shown = sessions.groupBy("session_id").agg(F.count(F.lit(1)).alias("shown"))
    changed = edits.select("session_id", "id").distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("edited"))
    return shown.join(changed, "session_id", "left").select(
        "session_id", "shown", F.coalesce("edited", F.lit(0)).alias("edited"),
        (F.coalesce("edited", F.lit(0)) / F.col("shown")).alias("edit_rate"),
    )


def write_by_firm(df: DataFrame, path: str, file_rows: int = 1_000_000) -> None:
    """Partitioned by firm, so tenant filters prune whole folders. A firm is written by one task for each `file_rows` of its rows."""
    sizes = df.groupBy("firm_id").agg(F.ceil(F.count(F.lit(1)) / file_rows).alias("_files")).withColumnRenamed("firm_id", "_firm")
    dealt = df.join(sizes, F.col("firm_id").eqNullSafe(F.col("_firm"))).withColumn("_file", F.pmod(F.xxhash64(*df.columns), F.col("_files")))
    dealt.repartition("firm_id", "_file").drop("_firm", "_files", "_file").write.mode("overwrite").partitionBy("firm_id").parquet(path)
