import datetime
import decimal
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from vouchline.functions import masking
from vouchline.operators import checks as ck, export as ex, quality as q, recognition as rc, review as rv
from vouchline.sources import sinks, templates as tp

Dec, D = decimal.Decimal, datetime.date
TX = "statement_id long, id long, row_number long, txn_date date, narration string, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2), confirmed_ledger string, suggested_ledger string, is_ignored boolean, ocr_confidence decimal(4,3)"
ROWS = [
    (1, 11, 1, D(2024, 1, 1), "UPI-SWIGGY Payment", Dec("350.00"), None, Dec("49650.00"), "Food & Beverages", None, False, None),
    (1, 12, 2, D(2024, 1, 2), "NEFT CR-Salary", None, Dec("50000.00"), Dec("99650.00"), "Salary Income", "x", False, Dec("0.850")),
    (1, 13, 3, D(2024, 1, 3), "ATM WITHDRAWAL", Dec("2000.00"), None, None, None, "", False, Dec("0.500")),
    (1, 14, 4, D(2024, 1, 4), 'ignored "x", y', Dec("9.00"), None, None, None, None, True, None),
]


def tx(spark):
    return spark.createDataFrame(ROWS, TX)


def document(lines):
    return "".join(r.line for r in sorted(lines.collect(), key=lambda r: (r.statement_id, r.line_no)))


def test_voucher_document(spark):
    text = document(sinks.xml_lines(tx(spark), "Acme Pvt Ltd", "HDFC Bank A/c"))
    assert text.startswith('<?xml version="1.0" encoding="UTF-8"?>')
    root = ET.fromstring(text.split("\n", 1)[1])
    assert root.find(".//SVCURRENTCOMPANY").text == "Acme Pvt Ltd" and root.find(".//REPORTNAME").text == "Vouchers"
    got = [(v.get("VCHTYPE"), v.findtext("DATE"), v.findtext("VOUCHERNUMBER"), [(e.findtext("LEDGERNAME"), e.findtext("ISDEEMEDPOSITIVE"), e.findtext("AMOUNT")) for e in v.findall("ALLLEDGERENTRIES.LIST")]) for v in root.iter("VOUCHER")]
    assert got == [
        ("Payment", "20240101", "1", [("HDFC Bank A/c", "No", "350.00"), ("Food & Beverages", "Yes", "-350.00")]),
        ("Receipt", "20240102", "2", [("HDFC Bank A/c", "Yes", "-50000.00"), ("Salary Income", "No", "50000.00")]),
        ("Payment", "20240103", "3", [("HDFC Bank A/c", "No", "2000.00"), ("Suspense Account", "Yes", "-2000.00")])]
    order = [e.tag for e in next(root.iter("VOUCHER"))]
    assert order == ["DATE", "EFFECTIVEDATE", "NARRATION", "VOUCHERTYPENAME", "VOUCHERNUMBER", "PARTYLEDGERNAME", "PERSISTEDVIEW", "ALLLEDGERENTRIES.LIST", "ALLLEDGERENTRIES.LIST"]
    assert document(sinks.xml_lines(tx(spark), reviewed_only=True)).count("<VOUCHER ") == 2


def test_voucher_entries_balance(spark):
    entries = ex.voucher_entries(ex.vouchers(ex.export_rows(tx(spark))))
    assert entries.groupBy("statement_id", "voucher_number").agg(F.sum("signed_amount").alias("s")).filter("s <> 0").count() == 0


def test_csv_document_in_order(spark, tmp_path):
    sinks.write_documents(sinks.csv_lines(tx(spark)), str(tmp_path / "csv"))
    folder = tmp_path / "csv" / "statement_id=1"
    lines = "".join(p.read_text(encoding="utf-8") for p in sorted(folder.glob("part-*"))).splitlines()
    assert lines[0] == "﻿Date,Narration,Debit,Credit,Balance,Payment Mode,Counterparty,Ledger,OCR Confidence,Reviewed"
    assert lines[1] == "2024-01-01,UPI-SWIGGY Payment,350.00,,49650.00,,,Food & Beverages,,Yes"
    assert lines[3] == "2024-01-03,ATM WITHDRAWAL,2000.00,,,,,,0.500,No"
    assert lines[-1] == "TOTAL,,2350.00,50000.00,,,,,," and len(lines) == 5


def test_documents_in_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    sizes = {n: 4000 if n == 77 else n % 5 for n in range(400)}  # one long statement, some without lines
    rows = [(n, i, f"{n}:{i} " + "x" * 40) for n, size in sizes.items() for i in range(size)]
    lines = spark.createDataFrame(rows[::-1], "statement_id long, line_no long, line string").repartition(7)
    sinks.write_shards(lines, path)
    files = list((tmp_path / "shards" / "shards").glob("part-*"))
    assert len(files) <= 8  # by size, not one for each of 320 documents
    assert sorted(map(tuple, sinks.read_shards(spark, path).collect())) == sorted(rows)
    index = spark.read.parquet(path + "/index")
    assert {r.statement_id: r.n for r in index.groupBy("statement_id").agg(F.sum("lines").alias("n")).collect()} == {n: s for n, s in sizes.items() if s}
    for asked in ([3], [77], [4, 399], [5], [1000]):
        got = sinks.read_shards(spark, path, asked)
        assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] in asked)
        if asked in ([3], [4, 399]):
            assert len(got.inputFiles()) <= len(asked) + 1
    sinks.export_document(spark, path, 77, str(tmp_path / "one"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "one").glob("part-*")))
    assert text.splitlines() == [f"77:{i} " + "x" * 40 for i in range(4000)]
    sinks.write_shards(lines.filter("false"), path)
    assert sinks.read_shards(spark, path).isEmpty() and sinks.read_shards(spark, path, [3]).isEmpty()


def test_summary_sheet(spark):
    meta = spark.createDataFrame([(1, "a.csv", None), (2, None, "sbi")], "statement_id long, filename string, bank_id string")
    modes = tx(spark).withColumn("payment_mode", F.when(F.col("id") == 11, "UPI").when(F.col("id") == 12, "NEFT").otherwise(""))
    sheets = {1: [], 2: []}
    for r in sinks.summary_cells(modes, meta).orderBy("statement_id", "sheet_row").collect():
        sheets[r.statement_id].append((r.sheet_row, r.label, r.value))
    assert sheets[1] == [
        (1, "Statement", "a.csv"), (2, "Bank", "Unknown"), (3, "Date Range", "2024-01-01 to 2024-01-03"), (5, "Metric", "Value"), (6, "Total Transactions", "3"),
        (7, "Total Debit", "2350.00"), (8, "Total Credit", "50000.00"), (10, "Payment Mode", "Total"), (11, "NEFT", "50000.00"), (12, "UPI", "350.00"), (13, "Unknown", "2000.00")]
    assert sheets[2][:3] == [(1, "Statement", "statement"), (2, "Bank", "sbi"), (3, "Date Range", "N/A")] and [c[2] for c in sheets[2][4:7]] == ["0", "0.00", "0.00"] and len(sheets[2]) == 8


def test_json_document(spark):
    import json

    meta = spark.createDataFrame([(1, "a.csv", None), (2, None, "sbi")], "statement_id long, filename string, bank_id string")
    lines = sinks.json_lines(tx(spark), meta, F.lit("2024-01-01T00:00:00Z")).collect()
    one = json.loads("".join(r.line for r in sorted((r for r in lines if r.statement_id == 1), key=lambda r: r.line_no)))
    assert one["statement"]["total_transactions"] == 3 and one["statement"]["total_debit"] == 2350.0 and one["statement"]["bank_id"] == "Unknown"
    assert [t["id"] for t in one["transactions"]] == [11, 12, 13] and one["transactions"][2]["ledger_name"] is None
    two = json.loads("".join(r.line for r in sorted((r for r in lines if r.statement_id == 2), key=lambda r: r.line_no)))
    assert two["statement"]["filename"] == "statement" and two["transactions"] == []


def test_alert_limits(spark):
    rows = [(bank, status, datetime.datetime(2024, 1, 5)) for bank, ok, bad in [("hdfc", 19, 2), ("SBI", 19, 1), ("axis", 10, 2)] for status, n in [("REVIEWED", ok), ("PARSE_ERROR", bad)] for _ in range(n)]
    rows += [(None, "UPLOADED", datetime.datetime(2024, 1, 5)), ("hdfc", "FAILED", datetime.datetime(2023, 1, 1))]
    df = spark.createDataFrame(rows, "bank_code string, status string, created_at timestamp")
    got = {r.bank_code: (r.total, r.failures, r.alert) for r in q.failure_alerts(df, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {"hdfc": (21, 2, True), "sbi": (20, 1, False), "axis": (12, 2, False), "unknown": (1, 0, False)}


def test_unset_is_not_null(spark):
    edits = spark.createDataFrame([(1, 11, ["confirmed_ledger"], None, None), (1, 12, ["is_ignored"], "zzz", True), (1, 99, ["is_ignored"], None, True), (2, 13, ["is_ignored"], None, True)],
                                  "statement_id long, id long, fields_set array<string>, confirmed_ledger string, is_ignored boolean")
    got = {r.id: (r.confirmed_ledger, r.is_ignored) for r in rv.apply_edits(tx(spark), edits, ["confirmed_ledger", "is_ignored"]).collect()}
    assert got == {11: (None, False), 12: ("Salary Income", True), 13: (None, False), 14: (None, True)}
    assert sorted(r.id for r in rv.failed_edits(tx(spark), edits).collect()) == [13, 99]


def test_no_firm_sees_nothing(spark):
    st = spark.createDataFrame([(1, 7)], "statement_id long, client_id int")
    clients = spark.createDataFrame([(7, 3), (8, 4)], "client_id int, firm_id int")
    assert [rv.of_firm(tx(spark), st, clients, f).count() for f in (3, 4, None)] == [4, 0, 0]


def test_masking_kinds_and_order(spark):
    cases = {
        "card 4111 1111 1111 1111 x": "card [CARD]x", "id 1234 5678 9012": "id [AADHAAR]", "pan abcde1234f": "pan [PAN]", "ifsc HDFC0001234": "ifsc [IFSC]",
        "UPI/9876543210/PHONEPE": "UPI/[PHONE]/PHONEPE", "acct 123456789": "acct [ACCT]", "own 55501": "own [ACCT]", "né 9876543210é": "né 9876543210é",
    }
    df = spark.createDataFrame([(k, "55501") for k in cases], "t string, a string")
    masked = df.select("t", masking.mask_text(F.col("t"), F.col("a")).alias("m"))
    assert {r.t: r.m for r in masked.collect()} == cases
    assert masked.filter(masking.first_violation(F.col("m")).isNotNull()).count() == 0
    found = {r.t: r.v for r in df.select("t", masking.first_violation(F.col("t")).alias("v")).collect()}
    assert found["ifsc HDFC0001234"] is None and found["pan abcde1234f"] == "PAN" and found["UPI/9876543210/PHONEPE"] == "PHONE"


def test_scrub_reaches_every_leaf(spark):
    df = spark.sql("""select struct('a@b.co' as mail, array(struct('pan ABCDE1234F' as t, 5 as n)) as list, map('9876543210', 'call 9876543210') as m, cast(null as struct<x:string>) as none) as r""")
    r = masking.scrub_record(df, "r").first().r
    assert (r.mail, r.list[0].t, r.list[0].n, r.m, r.none) == ("[EMAIL]", "pan [PAN]", 5, {"9876543210": "call [ACCT]"}, None)


def test_words_to_cells(spark, all_hot):
    words = [("d", 1, t, c, x, y, 40, 12) for t, c, x, y in [("Date", .9, 10, 10), ("Narration", .8, 100, 12), ("Amount", .7, 300, 9), ("01/01", .9, 10, 60), ("UPI", .5, 100, 61), ("x", .7, 150, 62)]]
    cells = rc.split_cells(rc.cluster_rows(spark.createDataFrame(words, "doc_id string, page int, text string, confidence double, x int, y int, w int, h int")))
    rows = rc.rows_from_cells(cells).orderBy("row_no").collect()
    assert [r.cells for r in rows] == [["Date", "Narration", "Amount"], ["01/01", "UPI x"]]
    assert round(rows[1].row_confidence, 4) == 0.75


def test_tiers(spark):
    df = spark.createDataFrame([(0.85,), (0.8499,), (0.7,), (0.69,)], "confidence double")
    assert {r.tier: r.n for r in rc.tier_counts(df, []).collect()} == {"high": 1, "medium": 2, "low": 1}


def test_warnings_on_long_statements(spark, all_hot):
    rows = [(1, i, i, D(2024, 1, 1) + datetime.timedelta(i), f"n{i}", Dec("1.00"), None, Dec(100 - i), None, None, False, None) for i in range(1, 12)]
    rows[6] = rows[6][:7] + (Dec("55.00"),) + rows[6][8:]
    rows[9] = rows[9][:3] + (D(2024, 1, 2),) + rows[9][4:]
    df = spark.createDataFrame(rows, TX).withColumn("reference_no", F.lit(None).cast("string"))
    got = {r.id: r.validation_warnings for r in ck.with_warnings(df).collect()}
    assert got[7] == ["balance_mismatch"] and got[8] == ["balance_mismatch"] and got[10] == ["date_order"] and got[4] == [] and got[11] == []


def test_documents_of_statements_without_rows(spark):
    rows = tx(spark).withColumn("is_ignored", F.lit(True))
    more = spark.createDataFrame([(1,), (9,)], "statement_id long")
    for lines in (sinks.csv_lines(rows, more), sinks.xml_lines(rows, statements=more)):
        assert {r.statement_id: r.n for r in lines.groupBy("statement_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 2, 9: 2}
    half = tx(spark).withColumn("ocr_confidence", F.lit(0.9))
    assert {r[0] for r in sinks.csv_rows(half).filter("Date <> 'TOTAL'").select("`OCR Confidence`").collect()} == {"0.900"}


def test_bank_detection_prefers_ifsc(spark):
    texts = {"HDFC BANK\nIFSC: SBIN0123456": "sbi", "State Bank of India": "sbi", "Account Statement": "au_small_finance", "nothing": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.b for r in ck.detect_bank(df, tp.catalogue(spark), "t").withColumnRenamed("bank_code", "b").collect()} == texts


def test_charge_loses_no_usage_row(spark):
    from vouchline.operators import cache

    usage = spark.createDataFrame([(1, "mistral", 1000, 10), (2, "unknown", 5, 5), (3, None, 7, 7)], "event_id long, source string, prompt_tokens int, completion_tokens int")
    only = cache.price_table(spark).where("provider <> 'local'").limit(1).withColumn("source", F.lit("mistral"))
    got = {r.event_id: r for r in cache.charge(usage, only).collect()}
    assert len(got) == 3 and got[1].cost_usd > 0 and (got[2].provider, got[2].cost_usd, got[3].prompt_tokens) == ("local", 0, 0)
    assert cache.charge(usage, cache.price_table(spark)).count() == 3
