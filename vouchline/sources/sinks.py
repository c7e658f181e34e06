"""Export files: CSV, JSON, voucher XML and the two workbook tables.

A document is produced as numbered lines per statement, never as one value, so a statement of any length is written by
many tasks. `write_documents` range-partitions by statement and line: the part files of a statement, in name order, are
its document. `write_shards` is for many documents: the number of its files follows the size of the data, and an index finds
single documents in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from vouchline.operators.export import export_rows, fill_class, mode_totals, side_totals, statement_totals, summary, vouchers

# Column titles, file extensions and the line numbers around the rows.
CSV_COLUMNS = ["Date", "Narration", "Debit", "Credit", "Balance", "Payment Mode", "Counterparty", "Ledger", "OCR Confidence", "Reviewed"]
EXTENSIONS = {"csv": "csv", "excel": "xlsx", "json": "json", "tally_xml": "xml"}
FIRST, LAST = -1, 9223372036854775807
BOM = "﻿"


def _optional(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def _documents(tx: DataFrame, statements: DataFrame | None) -> DataFrame:
    """The statements that get a document: those listed, or all of `tx`, whether or not a row is left to export."""
    return (tx if statements is None else statements).select("statement_id").distinct()


def csv_rows(tx: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """The ten export columns per transaction and one TOTAL row per statement of `statements` (all of `tx` by default), with `sort_key`."""
    rows = export_rows(tx)
    cells = [
        F.date_format("txn_date", "yyyy-MM-dd"), F.col("narration"),
        F.when(F.col("tx_type") == "DEBIT", F.col("amount").cast("string")).otherwise(""),
        F.when(F.col("tx_type") == "CREDIT", F.coalesce(F.col("amount").cast("string"), F.lit("0.00"))).otherwise(""),
        F.coalesce(F.col("balance").cast("string"), F.lit("")), _optional(rows, "payment_mode"), _optional(rows, "counterparty"),
        F.coalesce("ledger_name", F.lit("")), F.coalesce(F.col("ocr_confidence").cast("decimal(4,3)").cast("string"), F.lit("")),
        F.when(F.col("is_reviewed"), "Yes").otherwise("No"),
    ]
    body = rows.select("statement_id", F.col("row_number").cast("long").alias("sort_key"), *[c.alias(n) for c, n in zip(cells, CSV_COLUMNS)])
    blank = F.lit("")
    total = _documents(tx, statements).join(statement_totals(rows), "statement_id", "left").select(
        "statement_id", F.lit(LAST).alias("sort_key"), F.lit("TOTAL").alias("Date"), blank.alias("Narration"),
        F.coalesce(F.col("total_debit").cast("string"), F.lit("0.00")).alias("Debit"), F.coalesce(F.col("total_credit").cast("string"), F.lit("0.00")).alias("Credit"),
        *[blank.alias(c) for c in CSV_COLUMNS[4:]],
    )
    return body.unionByName(total)


def csv_lines(tx: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """CSV text lines: byte-order mark and titles, rows, TOTAL."""
    def quoted(c: Column) -> Column:
        return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    rows = csv_rows(tx, statements)
    titles = _documents(tx, statements).select(
        "statement_id", F.lit(FIRST).cast("long").alias("line_no"), F.lit(BOM + ",".join(CSV_COLUMNS)).alias("line")
    )
    return rows.select(
        "statement_id", F.col("sort_key").alias("line_no"), F.concat_ws(",", *[quoted(F.col(f"`{c}`")) for c in CSV_COLUMNS]).alias("line")
    ).unionByName(titles)


def json_lines(tx: DataFrame, meta: DataFrame, exported_at: Column) -> DataFrame:
    """JSON document per statement. meta: statement_id, filename, bank_id."""
    rows = export_rows(tx)
    names = ["id", "statement_id", "txn_date", "value_date", "narration", "reference_no", "amount", "tx_type", "balance", "payment_mode",
             "counterparty", "ledger_name", "ocr_confidence", "page_number", "is_reviewed", "is_ignored"]
    fields = [F.col(n).alias("date" if n == "txn_date" else n) for n in names if n in rows.columns]
    keep_nulls = {"ignoreNullFields": "false"}
    totals = rows.groupBy("statement_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_number").alias("first_row"), *side_totals())
    statement = F.struct(
        F.col("statement_id").alias("id"), F.coalesce("filename", F.lit("statement")).alias("filename"),
        F.coalesce("bank_id", F.lit("Unknown")).alias("bank_id"), exported_at.alias("export_timestamp"),
        F.coalesce("n", F.lit(0)).alias("total_transactions"),
        *[F.coalesce(c, F.lit(0)).cast("decimal(28,2)").alias(c) for c in ["total_debit", "total_credit"]],
    )
    heads = meta.join(totals, "statement_id", "left")
    head = heads.select(
        "statement_id", F.lit(FIRST).cast("long").alias("line_no"),
        F.concat(F.lit('{"statement":'), F.to_json(statement, keep_nulls), F.lit(',"transactions":[')).alias("line"),
    )
    foot = meta.select("statement_id", F.lit(LAST).alias("line_no"), F.lit("]}").alias("line"))
    body = rows.join(totals.select("statement_id", "first_row"), "statement_id").select(
        "statement_id", F.col("row_number").cast("long").alias("line_no"),
        F.concat(F.when(F.col("row_number") == F.col("first_row"), "").otherwise(","), F.to_json(F.struct(*fields), keep_nulls)).alias("line"),
    )
    return head.unionByName(body).unionByName(foot)


def _xml_text(value: Column) -> Column:
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def _element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def voucher_xml(company_bank: str) -> Column:
    """One import message per voucher row."""
    payment = F.col("voucher_type") == "Payment"
    plus, minus = F.col("amount").cast("string"), (-F.col("amount")).cast("string")

    def entry(ledger: Column, positive: Column, amount: Column) -> Column:
        inner = F.concat(_element("LEDGERNAME", _xml_text(ledger)), _element("ISDEEMEDPOSITIVE", positive), _element("AMOUNT", amount))
        return _element("ALLLEDGERENTRIES.LIST", inner)

    day = F.date_format("txn_date", "yyyyMMdd")
    view = "Accounting Voucher View"
    return F.concat(
        F.lit('<TALLYMESSAGE xmlns:UDF="TallyUDF"><VOUCHER VCHTYPE="'), F.col("voucher_type"), F.lit(f'" ACTION="Create" OBJVIEW="{view}">'),
        _element("DATE", day), _element("EFFECTIVEDATE", day), _element("NARRATION", _xml_text(F.coalesce("narration", F.lit("")))),
        _element("VOUCHERTYPENAME", F.col("voucher_type")), _element("VOUCHERNUMBER", F.col("voucher_number").cast("string")),
        _element("PARTYLEDGERNAME", _xml_text(F.lit(company_bank))), _element("PERSISTEDVIEW", F.lit(view)),
        entry(F.lit(company_bank), F.when(payment, "No").otherwise("Yes"), F.when(payment, plus).otherwise(minus)),
        entry(F.col("counter_ledger"), F.when(payment, "Yes").otherwise("No"), F.when(payment, minus).otherwise(plus)),
        F.lit("</VOUCHER></TALLYMESSAGE>"),
    )


def xml_lines(tx: DataFrame, company: str = "My Company", bank_ledger: str = "Bank Account", reviewed_only: bool = False,
              hot: DataFrame | None = None, statements: DataFrame | None = None) -> DataFrame:
    """Voucher document per statement of `statements` (all of `tx` by default): opening lines, one line per voucher, closing line."""
    rows = export_rows(tx)
    ids = _documents(tx, statements)
    safe = company.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    head = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<ENVELOPE><HEADER><TALLYREQUEST>Import Data</TALLYREQUEST></HEADER><BODY><IMPORTDATA>'
        f"<REQUESTDESC><REPORTNAME>Vouchers</REPORTNAME><STATICVARIABLES><SVCURRENTCOMPANY>{safe}</SVCURRENTCOMPANY>"
        "</STATICVARIABLES></REQUESTDESC><REQUESTDATA>"
    )
    foot = "</REQUESTDATA></IMPORTDATA></BODY></ENVELOPE>"
    body = vouchers(rows, reviewed_only, hot).select(
        "statement_id", F.col("voucher_number").alias("line_no"), voucher_xml(bank_ledger).alias("line")
    )
    return (
        ids.select("statement_id", F.lit(FIRST).cast("long").alias("line_no"), F.lit(head).alias("line"))
        .unionByName(body).unionByName(ids.select("statement_id", F.lit(LAST).alias("line_no"), F.lit(foot).alias("line")))
    )


def workbook_tables(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions sheet with its fill class, and the Summary sheet. `sheet_row` of data rows needs a dense row number."""
    rows = export_rows(tx)
    sheet = rows.select(
        "statement_id", "row_number", "txn_date", "narration",
        F.when(F.col("tx_type") == "DEBIT", F.col("amount")).alias("debit"), F.when(F.col("tx_type") == "CREDIT", F.col("amount")).alias("credit"),
        "balance", "ledger_name", "ocr_confidence", F.when(F.col("is_reviewed"), "Yes").otherwise("No").alias("reviewed"),
        fill_class(rows, "row_number").alias("fill"),
    )
    return sheet, summary(rows)


def summary_cells(tx: DataFrame, meta: DataFrame) -> DataFrame:
    """The filled rows of the Summary sheet, two cells each: statement_id, sheet_row, label, value; amounts with two places.

    meta: statement_id, filename, bank_id; each of its statements has a sheet, also one without rows to export. Below the fixed rows stand
    the totals by payment mode, in order of their names.
    """
    rows = export_rows(tx)
    heads = meta.join(summary(rows), "statement_id", "left")
    money = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(28,2)").cast("string")
    span = F.concat(F.col("first_date").cast("string"), F.lit(" to "), F.col("last_date").cast("string"))
    # Rows and titles of the sheet.
    fixed = [
        (1, "Statement", F.coalesce(F.nullif("filename", F.lit("")), F.lit("statement"))), (2, "Bank", F.coalesce(F.nullif("bank_id", F.lit("")), F.lit("Unknown"))),
        (3, "Date Range", F.coalesce(span, F.lit("N/A"))), (5, "Metric", F.lit("Value")), (6, "Total Transactions", F.coalesce("transactions", F.lit(0)).cast("string")),
        (7, "Total Debit", money("total_debit")), (8, "Total Credit", money("total_credit")), (10, "Payment Mode", F.lit("Total")),
    ]
    cells = [F.struct(F.lit(at).cast("long").alias("sheet_row"), F.lit(label).alias("label"), value.alias("value")) for at, label, value in fixed]
    place = F.lit(10) + F.row_number().over(W.partitionBy("statement_id").orderBy("payment_mode"))
    modes = mode_totals(rows, ["statement_id"]).join(meta.select("statement_id"), "statement_id", "left_semi").select(
        "statement_id", place.cast("long").alias("sheet_row"), F.col("payment_mode").alias("label"), F.col("total").cast("string").alias("value"))
    return heads.select("statement_id", F.inline(F.array(*cells))).unionByName(modes)


def file_name(bank: Column, day: Column, fmt: str) -> Column:
    ext = EXTENSIONS.get(fmt, "bin")
    return F.concat(F.coalesce(bank, F.lit("bank")), F.lit("_"), F.date_format(day, "yyyy-MM-dd"), F.lit(f"_{fmt}.{ext}"))


def write_documents(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per statement; rows stay in document order and a long statement spreads over several part files."""
    (
        lines.repartitionByRange(F.col("statement_id"), F.col("line_no"))
        .sortWithinPartitions("statement_id", "line_no")
        .select("statement_id", "line").write.mode(mode).partitionBy("statement_id").text(path)
    )


def write_shards(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Documents (statement_id, line_no, line) as files of many documents each, in order of statement and line, and an index of which file
    holds which lines of which statement (statement_id, shard, first_line, lines).

    A statement of any length spreads over several shards, and short ones share one. No lines, no documents.
    """
    spark = lines.sparkSession
    placed = lines.select("statement_id", "line_no", "line").repartitionByRange("statement_id", "line_no").sortWithinPartitions("statement_id", "line_no")
    placed.write.mode(mode).parquet(f"{path}/shards")
    held = spark.read.parquet(f"{path}/shards").select("statement_id", "line_no", F.col("_metadata.file_name").alias("shard"))
    index = held.groupBy("statement_id", "shard").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("lines"))
    index.repartitionByRange("statement_id").sortWithinPartitions("statement_id", "first_line").write.mode("overwrite").parquet(f"{path}/index")


def read_shards(spark: SparkSession, path: str, statements: list | None = None) -> DataFrame:
    """The lines of some documents, or of all. Of a few statements only the shards that hold them are opened, found by the index; the
    statements and the names of their shards go through the driver."""
    if statements is None:
        return spark.read.parquet(f"{path}/shards")
    index = spark.read.parquet(f"{path}/index")
    names = [r.shard for r in index.filter(F.col("statement_id").isin(statements)).select("shard").distinct().collect()]
    if not names:
        return read_shards(spark, path).limit(0)
    return spark.read.parquet(*[f"{path}/shards/{name}" for name in sorted(names)]).filter(F.col("statement_id").isin(statements))


def export_document(spark: SparkSession, path: str, statement: object, target: str) -> None:
    """One document out of the shards as text; its part files, in name order, are the document."""
    lines = read_shards(spark, path, [statement]).repartitionByRange("line_no").sortWithinPartitions("line_no")
    lines.select("line").write.mode("overwrite").text(target)
