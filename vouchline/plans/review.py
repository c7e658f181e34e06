"""Queries Q1-Q16, X1-X9 and the export sinks."""

from pyspark.sql import functions as F

from vouchline.operators import enrich as en, export as ex, memory as me, review as rv
from vouchline.plans import views as v
from vouchline.plans.registry import SQL, query
from vouchline.session import work_dir
from vouchline.sources import fixtures as fx, sinks


@query("flagship", f"""WITH {v.EN} SELECT client_id, coalesce(payment_mode, 'Unknown') AS payment_mode, suggested_ledger, count(*) AS transactions,
  CAST(sum(coalesce(debit, credit)) AS DECIMAL(28,2)) AS total, CAST(round(sum(confidence)::DOUBLE / count(*), 6) AS DOUBLE) AS mean_confidence FROM en WHERE NOT is_ignored GROUP BY ALL""")
def _(s, d):
    kept = fx.transactions(s, d, clients=False, spread=True).filter("not is_ignored")
    rows = fx.with_clients(en.heuristic(kept).select("statement_id", "payment_mode", "suggested_ledger", "confidence", "debit", "credit"), s, d)
    return rows.groupBy("client_id", F.coalesce("payment_mode", F.lit("Unknown")).alias("payment_mode"), "suggested_ledger").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum(F.coalesce("debit", "credit")).cast("decimal(28,2)").alias("total"),
        F.round(F.sum("confidence").cast("double") / F.count(F.lit(1)), 6).alias("mean_confidence"))


@query("src3_tables", """SELECT n_nationkey AS client_id, count(DISTINCT c_custkey) AS statements, count(*) AS transactions, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS volume
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def _(s, d):
    li, od, cu = (fx.table(s, d, t) for t in ["lineitem", "orders", "customer"])
    rows = li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).join(cu, F.col("o_custkey") == F.col("c_custkey"))
    per = rows.groupBy("c_nationkey", "c_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"))
    return per.groupBy(F.col("c_nationkey").alias("client_id")).agg(
        F.count(F.lit(1)).alias("statements"), F.sum("n").alias("transactions"), F.sum("v").cast("decimal(28,2)").alias("volume"))


@query("q1_list_statements", f"WITH {v.ST} SELECT statement_id, bank_code, status, created_on FROM st WHERE firm_id = 1 AND status = 'REVIEWED' ORDER BY created_on DESC, statement_id LIMIT 5 OFFSET 5")
def _(s, d):
    return rv.list_statements(fx.statements(s, d), 1, page=2, size=5, status="REVIEWED").select("statement_id", "bank_code", "status", "created_on")


@query("q2_counts", f"WITH {v.TX} SELECT st.statement_id, count(id) AS transaction_count FROM st LEFT JOIN tx ON tx.statement_id = st.statement_id GROUP BY ALL")
def _(s, d):
    return rv.with_counts(fx.statements(s, d), fx.transactions(s, d, clients=False)).select("statement_id", "transaction_count")


@query("q3_filter", f"""WITH {v.TX} SELECT id, statement_id, txn_date, narration FROM tx WHERE debit IS NOT NULL AND txn_date >= DATE '1996-03-01' AND txn_date <= DATE '1998-02-28' AND narration ILIKE '%n_ft%rent%'""")
def _(s, d):
    rows = rv.filter_transactions(fx.transactions(s, d, clients=False), "DEBIT", "1996-03-01", "1998-02-28", "n_ft%rent")
    return rows.select("id", "statement_id", "txn_date", "narration")


@query("q4_page_counts", f"""WITH {v.TX} SELECT statement_id, count(*) AS total, CAST(greatest(ceil(count(*) / 4.0), 1) AS BIGINT) AS total_pages FROM tx GROUP BY ALL""")
def _(s, d):
    return rv.page_counts(fx.transactions(s, d, clients=False), ["statement_id"], 4)


@query("q5_statement_result", f"""WITH {v.TX} SELECT statement_id, row_number, strftime(txn_date, '%Y-%m-%d') AS txn_date, narration, CAST(debit AS VARCHAR) AS debit,
  CAST(credit AS VARCHAR) AS credit, CAST(balance AS VARCHAR) AS balance FROM tx""")
def _(s, d):
    return rv.statement_result(fx.transactions(s, d, numbered=True, clients=False))


@query("q6_grid_filter", f"WITH {v.TX} SELECT id, narration FROM tx WHERE contains(lower(narration), 'cash') AND coalesce(credit, 0) <> 0 AND txn_date >= DATE '1995-01-01'")
def _(s, d):
    return rv.grid_filter(fx.transactions(s, d, clients=False), "CASH", "CREDIT", "1995-01-01").select("id", "narration")


@query("q7_grid_totals", f"""WITH {v.TX} SELECT statement_id, CAST(coalesce(sum(debit) FILTER (NOT is_ignored), 0) AS DECIMAL(28,2)) AS total_debit,
  CAST(coalesce(sum(credit) FILTER (NOT is_ignored), 0) AS DECIMAL(28,2)) AS total_credit, count(*) FILTER (coalesce(confirmed_ledger, '') = '') AS unledgered FROM tx GROUP BY ALL""")
def _(s, d):
    return rv.grid_totals(fx.transactions(s, d, clients=False), ["statement_id"])


@query("q8_triage", f"""WITH {v.EN} SELECT statement_id, CASE WHEN is_ignored THEN 'ignored' WHEN ocr_confidence > 0 AND ocr_confidence < 0.70 THEN 'low_ocr' WHEN ocr_confidence > 0 AND ocr_confidence < 0.85 THEN 'medium_ocr'
  WHEN confirmed_ledger IS NULL THEN 'no_ledger' WHEN confidence < 0.5 THEN 'low_confidence' WHEN confidence < 0.8 THEN 'medium_confidence' ELSE 'ok' END AS class, count(*) AS n FROM en GROUP BY ALL""")
def _(s, d):
    tx = en.heuristic(fx.transactions(s, d, clients=False, spread=True))
    return tx.groupBy("statement_id", rv.triage_class(tx).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("q9_bulk_update", f"""WITH {v.TX}, {v.EDITS} SELECT tx.id, CASE WHEN sets_ledger THEN new_ledger ELSE confirmed_ledger END AS confirmed_ledger,
  CASE WHEN sets_ignored THEN new_ignored ELSE is_ignored END AS is_ignored FROM tx LEFT JOIN ed ON ed.id = tx.id AND ed.statement_id = tx.statement_id""")
def _(s, d):
    return rv.apply_edits(fx.transactions(s, d, clients=False), fx.edits(s, d), ["confirmed_ledger", "is_ignored"]).select("id", "confirmed_ledger", "is_ignored")


@query("q9_failed_edits", f"WITH {v.TX}, {v.EDITS} SELECT statement_id, id FROM ed WHERE NOT EXISTS (SELECT 1 FROM tx WHERE tx.id = ed.id AND tx.statement_id = ed.statement_id)")
def _(s, d):
    return rv.failed_edits(fx.transactions(s, d, clients=False), fx.edits(s, d)).select("statement_id", "id")


@query("q10_edits_teach", f"""WITH {v.TX}, {v.EDITS}, t AS (SELECT client_id, {v.mapping_key('narration')} AS pattern, new_ledger, txn_date, tx.id FROM tx JOIN ed ON ed.id = tx.id AND ed.statement_id = tx.statement_id
  WHERE sets_ledger AND coalesce(trim(new_ledger), '') <> '') SELECT client_id, pattern, arg_max(new_ledger, {{'d': txn_date, 'i': id}}) AS ledger_name, count(*) AS hit_count, max(txn_date) AS last_used_at FROM t GROUP BY ALL""")
def _(s, d):
    wanted = rv.ledger_edits(fx.edits(s, d)).select("statement_id", "id", F.col("confirmed_ledger").alias("new_ledger"))
    edited = fx.cleaned(fx.transactions(s, d)).join(wanted, ["statement_id", "id"])
    return me.learn(edited.select("client_id", "narration", "narration_clean", F.col("new_ledger").alias("ledger_name"), F.col("txn_date").alias("used_at"), F.col("id").alias("event_id")))


@query("q11_change_status", f"""WITH {v.ST}, up AS (SELECT o_custkey AS statement_id, CASE o_orderkey % 4 WHEN 0 THEN 'EXPORTED' WHEN 1 THEN 'REVIEWED' WHEN 2 THEN 'BOGUS' ELSE 'PARSING' END AS status, o_orderkey FROM orders),
ok AS (SELECT statement_id, arg_max(status, o_orderkey) AS s FROM up WHERE status <> 'BOGUS' GROUP BY ALL) SELECT st.statement_id, coalesce(s, status) AS status FROM st LEFT JOIN ok ON ok.statement_id = st.statement_id""")
def _(s, d):
    kind = F.col("o_orderkey") % 4
    updates = fx.table(s, d, "orders").select(
        F.col("o_custkey").alias("statement_id"), F.when(kind == 0, "EXPORTED").when(kind == 1, "REVIEWED").when(kind == 2, "BOGUS").otherwise("PARSING").alias("status"),
        F.col("o_orderkey").alias("requested_at"))
    return rv.change_status(fx.statements(s, d), updates).select("statement_id", "status")


@query("q12_delete", f"WITH {v.TX} SELECT id FROM tx JOIN st USING (statement_id) WHERE status <> 'FAILED'")
def _(s, d):
    gone = fx.statements(s, d).filter("status = 'FAILED'")
    return rv.delete_statements(fx.transactions(s, d, clients=False), gone).select("id")


@query("q13_diff", f"""WITH {v.TX}, {v.EDITS}, nw AS (SELECT tx.id, confirmed_ledger AS ol, is_ignored AS oi, CASE WHEN sets_ledger THEN new_ledger ELSE confirmed_ledger END AS nl,
  CASE WHEN sets_ignored THEN new_ignored ELSE is_ignored END AS ni FROM tx LEFT JOIN ed ON ed.id = tx.id AND ed.statement_id = tx.statement_id)
SELECT id, CASE WHEN ol IS DISTINCT FROM nl THEN nl END AS confirmed_ledger, CASE WHEN oi <> ni THEN ni END AS is_ignored, (ol IS DISTINCT FROM nl) AS ledger_changed FROM nw WHERE ol IS DISTINCT FROM nl OR oi <> ni""")
def _(s, d):
    fields = ["confirmed_ledger", "is_ignored"]
    tx = fx.transactions(s, d, clients=False)
    return rv.diff_snapshots(tx, rv.apply_edits(tx, fx.edits(s, d), fields), fields).select(
        "id", *fields, F.array_contains("fields_set", "confirmed_ledger").alias("ledger_changed"))


@query("q14_exports", """WITH xp AS (SELECT o_orderkey AS export_id, o_custkey AS statement_id, CASE o_orderkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' ELSE 'excel' END AS format,
  CASE WHEN o_orderkey % 5 = 0 THEN 'PENDING' ELSE 'READY' END AS status, o_orderdate AS created_at FROM orders)
SELECT statement_id, format, arg_max(export_id, {'c': created_at, 'e': export_id}) AS export_id, max(CAST(created_at AS DATE)) AS created_at FROM xp
WHERE status = 'READY' AND created_at + INTERVAL 1 DAY > TIMESTAMP '1996-06-01' GROUP BY ALL""")
def _(s, d):
    key = F.col("o_orderkey")
    exports = fx.table(s, d, "orders").select(
        key.alias("export_id"), F.col("o_custkey").alias("statement_id"), F.when(key % 3 == 0, "csv").when(key % 3 == 1, "json").otherwise("excel").alias("format"),
        F.when(key % 5 == 0, "PENDING").otherwise("READY").alias("status"), F.col("o_orderdate").cast("date").alias("created_at"))
    exports = exports.withColumn("expires_at", F.date_add("created_at", 1))
    return rv.reusable_exports(exports, F.lit("1996-06-01").cast("date"))


@query("q15_isolation", f"WITH {v.TX} SELECT id, client_id FROM tx WHERE firm_id = 2")
def _(s, d):
    clients = fx.table(s, d, "nation").select(F.col("n_nationkey").alias("client_id"), F.col("n_regionkey").alias("firm_id"))
    return rv.of_firm(fx.transactions(s, d), fx.statements(s, d).drop("firm_id"), clients, 2).select("id", "client_id")


@query("q16_rule_order", f"WITH {v.RULES} SELECT client_id, rule_id, row_number() OVER (PARTITION BY client_id ORDER BY priority, created_at, rule_id) AS place FROM ru")
def _(s, d):
    return rv.rules_in_order(fx.rules(s, d)).select("client_id", "rule_id", F.col("place").cast("bigint").alias("place"))


# ---------------------------------------------------------------- exports


def _rows(s, d, numbered=True, clients=False):
    return ex.export_rows(en.heuristic(fx.transactions(s, d, numbered=numbered, clients=clients, spread=not numbered)))


@query("x1_export_rows", f"WITH {v.EN}, {v.EXPORT} SELECT id, amount, tx_type, ledger_name, is_reviewed FROM ex")
def _(s, d):
    return _rows(s, d, numbered=False).select("id", "amount", "tx_type", "ledger_name", "is_reviewed")


@query("x2_not_ignored", f"WITH {v.TX} SELECT id, statement_id, row_number FROM tx WHERE NOT is_ignored")
def _(s, d):
    return ex.export_rows(fx.transactions(s, d, numbered=True, clients=False)).select("id", "statement_id", "row_number")


SIDES = """CAST(coalesce(sum(amount) FILTER (tx_type = 'DEBIT'), 0) AS DECIMAL(28,2)) AS total_debit, CAST(coalesce(sum(amount) FILTER (tx_type = 'CREDIT'), 0) AS DECIMAL(28,2)) AS total_credit"""


@query("x3_totals", f"WITH {v.EN}, {v.EXPORT} SELECT statement_id, {SIDES} FROM ex GROUP BY ALL")
def _(s, d):
    return ex.statement_totals(_rows(s, d, numbered=False))


@query("x4_rollup", f"""WITH {v.EN}, {v.EXPORT} SELECT firm_id, client_id, statement_id, {SIDES.replace('(28,2)', '(38,2)')}, CAST(grouping_id(firm_id, client_id, statement_id) AS INTEGER) AS level
FROM ex GROUP BY ROLLUP (firm_id, client_id, statement_id)""")
def _(s, d):
    return ex.rollup_totals(_rows(s, d, numbered=False, clients=True))


VOUCHERS = """vo AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY row_number) AS voucher_number, CASE tx_type WHEN 'DEBIT' THEN 'Payment' ELSE 'Receipt' END AS voucher_type,
  coalesce(ledger_name, 'Suspense Account') AS counter_ledger FROM ex WHERE amount > 0)"""


@query("x5_voucher_entries", f"""WITH {v.EN}, {v.EXPORT}, {VOUCHERS} SELECT statement_id, voucher_number, voucher_type, entry_no, CASE entry_no WHEN 1 THEN 'Bank Account' ELSE counter_ledger END AS ledger,
  CASE WHEN (voucher_type = 'Payment') = (entry_no = 1) THEN 'No' ELSE 'Yes' END AS deemed_positive,
  CASE WHEN (voucher_type = 'Payment') = (entry_no = 1) THEN amount ELSE -amount END AS signed_amount FROM vo, (SELECT unnest([1, 2]) AS entry_no)""")
def _(s, d):
    return ex.voucher_entries(ex.vouchers(_rows(s, d), hot=fx.long_statements(s, d)))


@query("x6_summary", f"WITH {v.EN}, {v.EXPORT} SELECT statement_id, count(*) AS transactions, {SIDES}, min(txn_date) AS first_date, max(txn_date) AS last_date FROM ex GROUP BY ALL")
def _(s, d):
    return ex.summary(_rows(s, d, numbered=False))


@query("x7_mode_totals", f"WITH {v.EN}, {v.EXPORT} SELECT statement_id, coalesce(nullif(payment_mode, ''), 'Unknown') AS payment_mode, CAST(coalesce(sum(amount), 0) AS DECIMAL(28,2)) AS total FROM ex GROUP BY ALL")
def _(s, d):
    return ex.mode_totals(_rows(s, d, numbered=False), ["statement_id"])


FILL = """CASE WHEN ocr_confidence < 0.70 THEN 'low' WHEN ocr_confidence < 0.85 THEN 'medium' WHEN row_number % 2 = 0 THEN 'stripe' ELSE 'plain' END"""


@query("x8_fill_class", f"WITH {v.EN}, {v.EXPORT} SELECT id, {FILL} AS fill FROM ex")
def _(s, d):
    rows = _rows(s, d)
    return rows.select("id", ex.fill_class(rows, "row_number").alias("fill"))


@query("x9_closing_balance", f"WITH {v.EN}, {v.EXPORT} SELECT statement_id, arg_max(balance, row_number) AS closing_balance FROM ex GROUP BY ALL")
def _(s, d):
    return ex.closing_balance(_rows(s, d))


CSV = ["Date", "Narration", "Debit", "Credit", "Balance", "Payment Mode", "Counterparty", "Ledger", "OCR Confidence", "Reviewed"]


@query("snk1_csv", f"""WITH {v.EN}, {v.EXPORT} SELECT statement_id, row_number AS sort_key, strftime(txn_date, '%Y-%m-%d') AS "Date", narration AS "Narration", CASE tx_type WHEN 'DEBIT' THEN CAST(amount AS VARCHAR) ELSE '' END AS "Debit",
  CASE tx_type WHEN 'CREDIT' THEN CAST(amount AS VARCHAR) ELSE '' END AS "Credit", CAST(balance AS VARCHAR) AS "Balance", coalesce(payment_mode, '') AS "Payment Mode", coalesce(counterparty, '') AS "Counterparty",
  coalesce(ledger_name, '') AS "Ledger", coalesce(CAST(ocr_confidence AS VARCHAR), '') AS "OCR Confidence", CASE WHEN is_reviewed THEN 'Yes' ELSE 'No' END AS "Reviewed" FROM ex
UNION ALL SELECT st.statement_id, 9223372036854775807, 'TOTAL', '', CAST(CAST(coalesce(sum(amount) FILTER (tx_type = 'DEBIT'), 0) AS DECIMAL(28,2)) AS VARCHAR),
  CAST(CAST(coalesce(sum(amount) FILTER (tx_type = 'CREDIT'), 0) AS DECIMAL(28,2)) AS VARCHAR), '', '', '', '', '', '' FROM st LEFT JOIN ex ON ex.statement_id = st.statement_id GROUP BY st.statement_id""")
def _(s, d):
    return sinks.csv_rows(en.heuristic(fx.transactions(s, d, numbered=True, clients=False)), fx.statements(s, d))


def _js(column: str) -> str:
    return f"coalesce('\"' || {column} || '\"', 'null')"


@query("snk2_json", f"""WITH {v.EN}, {v.EXPORT}, fr AS (SELECT statement_id, min(row_number) AS fr, count(*) AS n, {SIDES} FROM ex GROUP BY ALL)
SELECT st.statement_id, -1 AS line_no, '{{"statement":{{"id":' || st.statement_id || ',"filename":"' || file_name || '","bank_id":"' || bank_code || '","export_timestamp":"2024-01-01T00:00:00Z","total_transactions":'
  || coalesce(n, 0) || ',"total_debit":' || coalesce(total_debit, 0.00) || ',"total_credit":' || coalesce(total_credit, 0.00) || '}},"transactions":[' AS line FROM st LEFT JOIN fr ON fr.statement_id = st.statement_id
UNION ALL SELECT statement_id, 9223372036854775807, ']}}' FROM st
UNION ALL SELECT statement_id, row_number, CASE WHEN row_number = fr THEN '' ELSE ',' END || '{{"id":' || id || ',"statement_id":' || statement_id || ',"date":"' || strftime(txn_date, '%Y-%m-%d') || '","narration":"' || narration
  || '","amount":' || amount || ',"tx_type":"' || tx_type || '","balance":' || balance || ',"payment_mode":' || {_js('payment_mode')} || ',"counterparty":' || {_js('counterparty')} || ',"ledger_name":' || {_js('ledger_name')}
  || ',"ocr_confidence":' || coalesce(CAST(ocr_confidence AS VARCHAR), 'null') || ',"is_reviewed":' || is_reviewed || ',"is_ignored":' || is_ignored || '}}' FROM ex JOIN fr USING (statement_id)""")
def _(s, d):
    meta = fx.statements(s, d).select("statement_id", F.col("file_name").alias("filename"), F.col("bank_code").alias("bank_id"))
    return sinks.json_lines(en.heuristic(fx.transactions(s, d, numbered=True, clients=False)), meta, F.lit("2024-01-01T00:00:00Z"))


@query("snk3_voucher_xml", f"""WITH {v.EN}, {v.EXPORT}, {VOUCHERS}, el AS (SELECT *, strftime(txn_date, '%Y%m%d') AS dy, replace(replace(replace(narration, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS nar,
  CAST(amount AS VARCHAR) AS pos, '-' || CAST(amount AS VARCHAR) AS neg, voucher_type = 'Payment' AS pay FROM vo)
SELECT statement_id, voucher_number AS line_no, '<TALLYMESSAGE xmlns:UDF="TallyUDF"><VOUCHER VCHTYPE="' || voucher_type || '" ACTION="Create" OBJVIEW="Accounting Voucher View"><DATE>' || dy || '</DATE><EFFECTIVEDATE>' || dy
 || '</EFFECTIVEDATE><NARRATION>' || nar || '</NARRATION><VOUCHERTYPENAME>' || voucher_type || '</VOUCHERTYPENAME><VOUCHERNUMBER>' || voucher_number
 || '</VOUCHERNUMBER><PARTYLEDGERNAME>Bank Account</PARTYLEDGERNAME><PERSISTEDVIEW>Accounting Voucher View</PERSISTEDVIEW><ALLLEDGERENTRIES.LIST><LEDGERNAME>Bank Account</LEDGERNAME><ISDEEMEDPOSITIVE>'
 || CASE WHEN pay THEN 'No' ELSE 'Yes' END || '</ISDEEMEDPOSITIVE><AMOUNT>' || CASE WHEN pay THEN pos ELSE neg END || '</AMOUNT></ALLLEDGERENTRIES.LIST><ALLLEDGERENTRIES.LIST><LEDGERNAME>' || counter_ledger
 || '</LEDGERNAME><ISDEEMEDPOSITIVE>' || CASE WHEN pay THEN 'Yes' ELSE 'No' END || '</ISDEEMEDPOSITIVE><AMOUNT>' || CASE WHEN pay THEN neg ELSE pos END || '</AMOUNT></ALLLEDGERENTRIES.LIST></VOUCHER></TALLYMESSAGE>' AS line FROM el
UNION ALL SELECT statement_id, -1, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<ENVELOPE><HEADER><TALLYREQUEST>Import Data</TALLYREQUEST></HEADER><BODY><IMPORTDATA><REQUESTDESC><REPORTNAME>Vouchers</REPORTNAME><STATICVARIABLES><SVCURRENTCOMPANY>My Company'
 || '</SVCURRENTCOMPANY></STATICVARIABLES></REQUESTDESC><REQUESTDATA>' FROM st UNION ALL SELECT statement_id, 9223372036854775807, '</REQUESTDATA></IMPORTDATA></BODY></ENVELOPE>' FROM st""")
def _(s, d):
    return sinks.xml_lines(en.heuristic(fx.transactions(s, d, numbered=True, clients=False)), hot=fx.long_statements(s, d), statements=fx.statements(s, d))


@query("snk2_json_shards", SQL["snk2_json"])
def _(s, d):
    """The same documents, all of them, written as shards and read back."""
    meta = fx.statements(s, d).select("statement_id", F.col("file_name").alias("filename"), F.col("bank_code").alias("bank_id"))
    path = work_dir(s, "documents")
    sinks.write_shards(sinks.json_lines(en.heuristic(fx.transactions(s, d, numbered=True, clients=False)), meta, F.lit("2024-01-01T00:00:00Z")), path)
    return sinks.read_shards(s, path)


@query("snk4_workbook", f"""WITH {v.EN}, {v.EXPORT} SELECT statement_id, row_number, txn_date, narration, CASE tx_type WHEN 'DEBIT' THEN amount END AS debit, CASE tx_type WHEN 'CREDIT' THEN amount END AS credit,
  balance, ledger_name, ocr_confidence, CASE WHEN is_reviewed THEN 'Yes' ELSE 'No' END AS reviewed, {FILL} AS fill FROM ex""")
def _(s, d):
    return sinks.workbook_tables(en.heuristic(fx.transactions(s, d, numbered=True, clients=False)))[0]


@query("snk4_workbook_summary", f"""WITH {v.EN}, {v.EXPORT}, su AS (SELECT statement_id, count(*) AS n, {SIDES}, min(txn_date) AS a, max(txn_date) AS b FROM ex GROUP BY ALL),
hd AS (SELECT st.statement_id, file_name, bank_code, n, a, b, total_debit, total_credit FROM st LEFT JOIN su ON su.statement_id = st.statement_id),
mo AS (SELECT statement_id, coalesce(nullif(payment_mode, ''), 'Unknown') AS label, CAST(sum(coalesce(amount, 0)) AS DECIMAL(28,2)) AS total FROM ex GROUP BY ALL)
SELECT statement_id, CAST(1 AS BIGINT) AS sheet_row, 'Statement' AS label, coalesce(nullif(file_name, ''), 'statement') AS value FROM hd
UNION ALL SELECT statement_id, 2, 'Bank', coalesce(nullif(bank_code, ''), 'Unknown') FROM hd
UNION ALL SELECT statement_id, 3, 'Date Range', CASE WHEN n > 0 THEN strftime(a, '%Y-%m-%d') || ' to ' || strftime(b, '%Y-%m-%d') ELSE 'N/A' END FROM hd
UNION ALL SELECT statement_id, 5, 'Metric', 'Value' FROM hd
UNION ALL SELECT statement_id, 6, 'Total Transactions', CAST(coalesce(n, 0) AS VARCHAR) FROM hd
UNION ALL SELECT statement_id, 7, 'Total Debit', CAST(coalesce(total_debit, 0.00) AS VARCHAR) FROM hd
UNION ALL SELECT statement_id, 8, 'Total Credit', CAST(coalesce(total_credit, 0.00) AS VARCHAR) FROM hd
UNION ALL SELECT statement_id, 10, 'Payment Mode', 'Total' FROM hd
UNION ALL SELECT statement_id, 10 + row_number() OVER (PARTITION BY statement_id ORDER BY label), label, CAST(total AS VARCHAR) FROM mo""")
def _(s, d):
    """The second table of the workbook."""
    meta = fx.statements(s, d).select("statement_id", F.col("file_name").alias("filename"), F.col("bank_code").alias("bank_id"))
    return sinks.summary_cells(en.heuristic(fx.transactions(s, d, numbered=True, clients=False)), meta)


@query("snk5_file_names", f"WITH {v.ST} SELECT statement_id, coalesce(bank_code, 'bank') || '_' || strftime(created_on, '%Y-%m-%d') || '_tally_xml.xml' AS file_name FROM st")
def _(s, d):
    return fx.statements(s, d).select("statement_id", sinks.file_name(F.col("bank_code"), F.col("created_on"), "tally_xml").alias("file_name"))
