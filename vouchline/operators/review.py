"""Review queries: listing, filters, paging, edits, diffs and tenant isolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouchline.skew import ordered

# The statuses a statement may have.
ALLOWED_STATUSES = ["UPLOADED", "PARSING", "OCR", "READY_FOR_REVIEW", "REVIEWED", "EXPORTED", "FAILED", "PARSE_ERROR"]

# Fields a reviewer may change.
EDITABLE = ["narration", "narration_clean", "reference_no", "payment_mode", "counterparty", "suggested_ledger",
            "confirmed_ledger", "is_ignored"]


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def list_statements(statements: DataFrame, firm_id, page: int = 1, size: int = 20, status=None, bank=None) -> DataFrame:
    rows = statements.filter(F.col("firm_id") == firm_id)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if bank is not None:
        rows = rows.filter(F.col("bank_code") == bank)
    return page_of(rows, [F.desc("created_on"), F.asc("statement_id")], page, size)


def with_counts(statements: DataFrame, tx: DataFrame) -> DataFrame:
    counts = tx.groupBy("statement_id").agg(F.count(F.lit(1)).alias("transaction_count"))
    return statements.join(counts, "statement_id", "left").withColumn(
        "transaction_count", F.coalesce("transaction_count", F.lit(0))
    )


def filter_transactions(tx: DataFrame, side=None, date_from=None, date_to=None, search=None) -> DataFrame:
    """Server-side filter: inclusive dates, `%` and `_` in the search text act as wildcards."""
    if side == "DEBIT":
        tx = tx.filter("debit is not null")
    elif side == "CREDIT":
        tx = tx.filter("credit is not null")
    if date_from:
        tx = tx.filter(F.col("txn_date") >= F.lit(date_from).cast("date"))
    if date_to:
        tx = tx.filter(F.col("txn_date") <= F.lit(date_to).cast("date"))
    if search:
        tx = tx.filter(F.col("narration").ilike(f"%{search}%"))
    return tx


def page_counts(tx: DataFrame, keys: list[str], size: int, at_least_one: bool = True) -> DataFrame:
    pages = F.ceil(F.col("total") / size)
    return tx.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.greatest(pages, F.lit(1)) if at_least_one else pages
    )


def statement_result(tx: DataFrame) -> DataFrame:
    """All rows with text amounts; file order is carried by row_number, and whoever writes a statement sorts its rows."""
    return tx.select(
        "statement_id", "row_number", F.date_format("txn_date", "yyyy-MM-dd").alias("txn_date"), "narration",
        *[F.col(c).cast("string").alias(c) for c in ["debit", "credit", "balance"]],
    )


def grid_filter(tx: DataFrame, search=None, side=None, date_from=None, date_to=None) -> DataFrame:
    """Grid filter: plain substring without wildcards; a zero amount counts as absent."""
    if search:
        tx = tx.filter(F.contains(F.lower("narration"), F.lit(search.lower())))
    if side in ("DEBIT", "CREDIT"):
        tx = tx.filter(F.coalesce(F.col(side.lower()), F.lit(0)) != 0)
    return filter_transactions(tx, None, date_from, date_to)


def grid_totals(tx: DataFrame, keys: list[str]) -> DataFrame:
    counted = ~F.col("is_ignored")
    return tx.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(counted, F.col(c))), F.lit(0)).cast("decimal(28,2)").alias(f"total_{c}") for c in ["debit", "credit"]],
        F.count_if(F.coalesce("confirmed_ledger", F.lit("")) == "").alias("unledgered"),
    )


def triage_class(tx: DataFrame) -> Column:
    scanned = F.coalesce(F.col("ocr_confidence"), F.lit(0))
    sure = F.coalesce(F.nullif(F.col("confidence"), F.lit(0).cast("decimal(4,3)")), F.lit(1))
    return (
        F.when(F.col("is_ignored"), "ignored")
        .when((scanned > 0) & (scanned < 0.70), "low_ocr").when((scanned > 0) & (scanned < 0.85), "medium_ocr")
        .when(F.coalesce("confirmed_ledger", F.lit("")) == "", "no_ledger")
        .when(sure < 0.5, "low_confidence").when(sure < 0.8, "medium_confidence").otherwise("ok")
    )


def apply_edits(tx: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """Change only the fields an edit names; `edits`: statement_id, id, fields_set array<string>, new values.

    A field in `fields_set` with a null value is set to null; a field outside it stays.
    """
    packed = edits.select("statement_id", "id", F.struct("fields_set", *fields).alias("_e"))
    joined = tx.join(packed, ["statement_id", "id"], "left")
    return joined.withColumns(
        {f: F.when(F.array_contains("_e.fields_set", f), F.col(f"_e.{f}")).otherwise(F.col(f)) for f in fields}
    ).drop("_e")


def failed_edits(tx: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits whose id is not in the statement they name."""
    return edits.join(tx, ["statement_id", "id"], "left_anti")


def ledger_edits(edits: DataFrame) -> DataFrame:
    """Edits that set a non-blank ledger: these also teach the ledger memory."""
    return edits.filter(F.array_contains("fields_set", "confirmed_ledger") & (F.trim(F.coalesce("confirmed_ledger", F.lit(""))) != ""))


def change_status(statements: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest valid requested status per statement; requests with an unknown status have no effect."""
    valid = updates.filter(F.col("status").isin(ALLOWED_STATUSES)).groupBy("statement_id").agg(
        F.max_by("status", "requested_at").alias("_new")
    )
    return statements.join(valid, "statement_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def rejected_status(updates: DataFrame) -> DataFrame:
    return updates.filter(~F.col("status").isin(ALLOWED_STATUSES))


def delete_statements(children: DataFrame, deleted: DataFrame) -> DataFrame:
    """What stays of a child table (transactions, exports, usage) after deleting statements."""
    return children.join(deleted.select("statement_id"), "statement_id", "left_anti")


def diff_snapshots(before: DataFrame, after: DataFrame, fields: list[str] = EDITABLE) -> DataFrame:
    """Minimal edit set between two snapshots: changed rows, changed fields and their new values."""
    old = before.select("id", F.struct(*fields).alias("_old"))
    joined = after.select("id", *fields).join(old, "id")
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_old.{f}")), F.lit(f)) for f in fields]))
    return joined.withColumn("fields_set", changed).filter(F.size("fields_set") > 0).select(
        "id", "fields_set", *[F.when(F.array_contains("fields_set", f), F.col(f)).alias(f) for f in fields]
    )


def reusable_exports(exports: DataFrame, now: Column) -> DataFrame:
    """Newest READY, unexpired export per statement and format."""
    live = exports.filter((F.col("status") == "READY") & (F.col("expires_at") > now))
    newest = F.struct("created_at", "export_id")
    return live.groupBy("statement_id", "format").agg(
        F.max_by("export_id", newest).alias("export_id"), F.max("created_at").alias("created_at")
    )


def of_firm(df: DataFrame, statements: DataFrame, clients: DataFrame, firm_id) -> DataFrame:
    """Rows whose statement belongs to a client of the firm; no firm means no rows."""
    own = clients.filter(F.col("firm_id") == F.lit(firm_id)) if firm_id is not None else clients.filter("false")
    visible = statements.join(own, "client_id", "left_semi")
    return df.join(visible, "statement_id", "left_semi")


def rules_in_order(rules: DataFrame) -> DataFrame:
    return ordered(rules, ["client_id"], ["priority", "created_at", "rule_id"], split=F.col("priority"), running={"place": ("sum", F.lit(1))})
