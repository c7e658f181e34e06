"""Export rows, totals, vouchers and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouchline.skew import block, ordered

SUSPENSE = "Suspense Account"


def export_rows(tx: DataFrame) -> DataFrame:
    """One row per transaction that is not ignored; each keeps row_number as its sort key."""
    confirmed = F.nullif(F.col("confirmed_ledger"), F.lit(""))
    ledger = F.coalesce(confirmed, F.nullif(F.col("suggested_ledger"), F.lit(""))) if "suggested_ledger" in tx.columns else confirmed
    return tx.filter(~F.col("is_ignored")).withColumns(
        {
            "amount": F.coalesce("debit", "credit"),
            "tx_type": F.when(F.col("debit").isNotNull(), "DEBIT").otherwise("CREDIT"),
            "ledger_name": ledger,
            "is_reviewed": confirmed.isNotNull(),
        }
    )


def _side(kind: str) -> Column:
    total = F.sum(F.when(F.col("tx_type") == kind, F.coalesce("amount", F.lit(0).cast("decimal(18,2)"))))
    return F.coalesce(total, F.lit(0)).cast("decimal(28,2)")


def side_totals() -> list[Column]:
    return [_side("DEBIT").alias("total_debit"), _side("CREDIT").alias("total_credit")]


def statement_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("statement_id").agg(*side_totals())


def rollup_totals(rows: DataFrame) -> DataFrame:
    """Totals per statement, client, firm and overall. Statements are summed first, so the rollup expands only those."""
    per_statement = rows.groupBy("firm_id", "client_id", "statement_id").agg(*side_totals())
    return per_statement.rollup("firm_id", "client_id", "statement_id").agg(
        F.sum("total_debit").cast("decimal(38,2)").alias("total_debit"),
        F.sum("total_credit").cast("decimal(38,2)").alias("total_credit"),
        F.grouping_id().cast("int").alias("level"),
    )


def vouchers(rows: DataFrame, reviewed_only: bool = False, hot: DataFrame | None = None) -> DataFrame:
    """Kept rows with voucher type, counter ledger and a number from 1 per statement."""
    kept = rows.filter(F.col("amount") > 0)
    if reviewed_only:
        kept = kept.filter("is_reviewed")
    numbered = ordered(
        kept, ["statement_id"], ["row_number"], split=block("row_number"), running={"voucher_number": ("sum", F.lit(1))}, hot=hot
    )
    return numbered.withColumns(
        {
            "voucher_number": F.col("voucher_number").cast("long"),
            "voucher_type": F.when(F.col("tx_type") == "DEBIT", "Payment").otherwise("Receipt"),
            "counter_ledger": F.coalesce("ledger_name", F.lit(SUSPENSE)),
        }
    )


def voucher_entries(kept: DataFrame, bank_ledger: str = "Bank Account") -> DataFrame:
    """Two entries per voucher: the bank side and the counter side with the opposite sign."""
    payment = F.col("voucher_type") == "Payment"
    signed = F.when(payment, F.col("amount")).otherwise(-F.col("amount"))
    yes_no = F.when(payment, "No").otherwise("Yes")
    bank = F.struct(F.lit(1).alias("entry_no"), F.lit(bank_ledger).alias("ledger"), yes_no.alias("deemed_positive"), signed.alias("signed_amount"))
    counter = F.struct(
        F.lit(2).alias("entry_no"), F.col("counter_ledger").alias("ledger"),
        F.when(payment, "Yes").otherwise("No").alias("deemed_positive"), (-signed).alias("signed_amount"),
    )
    return kept.select("statement_id", "voucher_number", "voucher_type", F.explode(F.array(bank, counter)).alias("e")).select(
        "statement_id", "voucher_number", "voucher_type", "e.*"
    )


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("transactions"), *side_totals(),
        F.min("txn_date").alias("first_date"), F.max("txn_date").alias("last_date"),
    )


def mode_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    mode = F.coalesce(F.nullif(F.col("payment_mode"), F.lit("")), F.lit("Unknown"))
    return rows.groupBy(*keys, mode.alias("payment_mode")).agg(
        F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(28,2)").alias("total")
    )


def confidence_tier(value: Column) -> Column:
    return F.when(value >= 0.85, "high").when(value >= 0.70, "medium").otherwise("low")


def fill_class(rows: DataFrame, position: str) -> Column:
    """Sheet row colour: weak recognition first, else every second sheet row (data starts on sheet row 2)."""
    tier = F.when(F.col("ocr_confidence").isNotNull(), confidence_tier(F.col("ocr_confidence")))
    return F.when(tier == "low", "low").when(tier == "medium", "medium").when(F.col(position) % 2 == 0, "stripe").otherwise("plain")


def closing_balance(rows: DataFrame) -> DataFrame:
    present = rows.filter("balance is not null")
    return present.groupBy("statement_id").agg(F.max_by("balance", "row_number").alias("closing_balance"))
