"""Queries SRC1-SRC6, P1-P20 and O1-O6."""

from pyspark.sql import functions as F

from vouchline.functions import values
from vouchline.operators import recognition as rc, shape as sh
from vouchline.plans import views as v
from vouchline.plans.registry import query
from vouchline.session import work_dir
from vouchline.skew import hot_keys
from vouchline.sources import fixtures as fx, readers, templates as tp

HDFC_NO = "CAST(row_number AS VARCHAR)"
DAY = "CASE bank_code WHEN 'hdfc' THEN strftime(txn_date, '%d/%m/%y') WHEN 'axis' THEN strftime(txn_date, '%d-%m-%Y') ELSE strftime(txn_date, '%d/%m/%Y') END"

# The typed rows expected from the rendered cells: narration with its continuation, the century taken from two-digit years.
PARSED = """pa AS (SELECT id, statement_id, bank_code, row_number, txn_date, narration || CASE WHEN id % 4 = 0 THEN ' MORE ' || id ELSE '' END AS narration,
  CASE WHEN bank_code IN ('hdfc', 'icici', 'sbi') THEN txn_date END AS value_date, 'REF' || id AS reference_no, debit, credit, balance FROM tx)"""

RAW = f"""rr AS (SELECT statement_id, bank_code, (row_number - 1) * 3 + 3 AS row_idx, CASE WHEN bank_code = 'icici' THEN 8 WHEN bank_code = 'axis' THEN 6 ELSE 7 END AS n, id, 'row' AS kind FROM tx
  UNION ALL SELECT statement_id, bank_code, (row_number - 1) * 3 + 4, CASE WHEN bank_code = 'icici' THEN 8 WHEN bank_code = 'axis' THEN 6 ELSE 7 END, id, 'more' FROM tx WHERE id % 4 = 0
  UNION ALL SELECT statement_id, bank_code, 0, 2, NULL, 'title' FROM tx GROUP BY ALL
  UNION ALL SELECT statement_id, bank_code, 2, CASE WHEN bank_code = 'icici' THEN 8 WHEN bank_code = 'axis' THEN 6 ELSE 7 END, NULL, 'header' FROM tx GROUP BY ALL
  UNION ALL SELECT statement_id, bank_code, max(row_number - 1) * 3 + 6, CASE WHEN bank_code = 'icici' THEN 8 WHEN bank_code = 'axis' THEN 6 ELSE 7 END, NULL, 'total' FROM tx GROUP BY ALL)"""


def _clean(s, d):
    return sh.normalize_rows(fx.raw_rows(s, d))


def _parsed(s, d):
    return sh.parse_statements(fx.raw_rows(s, d), tp.catalogue(s), fx.long_statements(s, d))


@query("src1_delimited_files", """SELECT c_mktsegment || '; "quoted"' || chr(10) || 'second line' AS segment, o_orderkey AS key, CAST(o_totalprice AS DECIMAL(18,2)) AS total,
  CASE o_orderkey % 3 WHEN 0 THEN '1,5" pipe' WHEN 1 THEN '"' ELSE 'plain' END AS note, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'a""b' END AS remark
FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(s, d):
    rows = fx.table(s, d, "orders").join(fx.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    name = F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit('; ""quoted""\nsecond line"'))
    key = F.col("o_orderkey")
    note = F.when(key % 3 == 0, '1,5" pipe').when(key % 3 == 1, '""""').otherwise("plain")  # a quote inside a cell opens nothing
    remark = F.when(key % 5 == 0, '""').otherwise('a""b')
    path = work_dir(s, "delimited")
    rows.select(F.concat_ws(";", key, name, F.col("o_totalprice").cast("decimal(18,2)").cast("string"), note, remark).alias("value")).write.text(path)
    cell = lambda i: F.get("cells", F.lit(i))
    return readers.read_delimited(s, path).select(
        cell(1).alias("segment"), cell(0).cast("bigint").alias("key"), cell(2).cast("decimal(18,2)").alias("total"), cell(3).alias("note"), cell(4).alias("remark"))


BANK_CODES = ", ".join(f"'{b[0]}'" for b in tp.BANKS)


@query("src2_templates", f"""WITH cs AS (SELECT c_custkey AS statement_id, CASE c_custkey % 33 {' '.join(f"WHEN {i} THEN '{b[0]}'" for i, b in enumerate(tp.BANKS))} WHEN 30 THEN 'HDFC' WHEN 31 THEN 'nobank' END AS bank_code FROM customer)
SELECT statement_id, bank_code, CASE WHEN lower(bank_code) IN ({BANK_CODES}) THEN len(string_split(
  CASE lower(bank_code) {' '.join(f"WHEN '{b[0]}' THEN '{'|'.join(b[5])}'" for b in tp.BANKS)} END, '|')) END AS headers FROM cs""")
def _(s, d):
    key = F.col("c_custkey") % 33
    code = F.when(key == 30, "HDFC").when(key == 31, "nobank")
    for i, bank in enumerate(tp.BANKS):
        code = code.when(key == i, bank[0])
    rows = fx.table(s, d, "customer").select(F.col("c_custkey").alias("statement_id"), code.alias("bank_code"))
    return tp.with_template(rows, tp.catalogue(s)).select("statement_id", "bank_code", F.size("template.headers").alias("headers"))


TYPE = """CASE WHEN NOT contains(file_name, '.') THEN 'unknown' WHEN lower(string_split(file_name, '.')[-1]) IN ('jpg', 'jpeg', 'png', 'webp') THEN 'image' ELSE lower(string_split(file_name, '.')[-1]) END"""


@query("src4_file_types", f"WITH {v.ST} SELECT statement_id, {TYPE} AS file_type FROM st")
def _(s, d):
    return fx.statements(s, d).select("statement_id", readers.file_type(F.col("file_name")).alias("file_type"))


@query("src5_routing", f"""WITH {v.ST}, ty AS (SELECT *, {TYPE} AS t FROM st), br AS (SELECT *, CASE t WHEN 'csv' THEN 'cells' WHEN 'xlsx' THEN 'workbook' WHEN 'xls' THEN 'workbook' WHEN 'pdf' THEN 'pdf' ELSE 'unsupported' END AS branch FROM ty)
SELECT statement_id, branch, CASE WHEN branch = 'unsupported' THEN 'Unsupported statement format ''' || t || '''. Upload a CSV, PDF, or Excel file.' END AS error_message FROM br""")
def _(s, d):
    name = F.col("file_name")
    return fx.statements(s, d).select("statement_id", readers.parse_branch(name).alias("branch"), readers.unsupported_error(name).alias("error_message"))


@query("src6_block_json", """SELECT o_orderkey AS doc_id, 9 AS blocks, 4 AS cells, 4 AS words, CAST(9 AS BIGINT) AS children FROM orders""")
def _(s, d):
    b = fx.ocr_blocks(s, d)
    upper = F.struct(
        F.col("id").alias("Id"), F.col("block_type").alias("BlockType"), F.col("page").alias("Page"), F.col("row_index").alias("RowIndex"),
        F.col("column_index").alias("ColumnIndex"), F.col("text").alias("Text"), F.col("confidence").alias("Confidence"),
        F.transform("relationships", lambda r: F.struct(r["type"].alias("Type"), r["ids"].alias("Ids"))).alias("Relationships"))
    docs = b.groupBy("doc_id").agg(F.collect_list(upper).alias("Blocks"))
    json = docs.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("JobId"), "Blocks")).alias("response"))
    ids = F.coalesce(F.aggregate("relationships", F.lit(0), lambda acc, r: acc + F.size(r["ids"])), F.lit(0))
    return readers.parse_blocks(json).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.count(F.lit(1)).cast("int").alias("blocks"), F.count_if(F.col("block_type") == "CELL").cast("int").alias("cells"),
        F.count_if(F.col("block_type") == "WORD").cast("int").alias("words"), F.sum(ids).alias("children"))


# ---------------------------------------------------------------- shaping


@query("p1_normalize_rows", f"WITH {v.TX}, {RAW} SELECT statement_id, row_idx, n AS width FROM rr")
def _(s, d):
    return _clean(s, d).select("statement_id", "row_idx", F.size("cells").alias("width"))


@query("p2_headers", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS header FROM documents")
def _(s, d):
    return fx.table(s, d, "documents").select("doc_id", values.normalize_header(F.col("text")).alias("header"))


@query("p3_template_header", f"""WITH {v.TX} SELECT statement_id, CAST(2 AS BIGINT) AS header_idx, 'template' AS found_by,
  CASE bank_code WHEN 'icici' THEN 2 ELSE 0 END AS date_col, CASE bank_code WHEN 'hdfc' THEN 1 WHEN 'icici' THEN 4 WHEN 'sbi' THEN 2 ELSE 1 END AS narration_col,
  CASE bank_code WHEN 'hdfc' THEN 6 WHEN 'icici' THEN 7 WHEN 'sbi' THEN 6 ELSE 5 END AS balance_col FROM tx GROUP BY ALL""")
def _(s, d):
    found = sh.detect_headers(_clean(s, d), tp.catalogue(s))
    return found.select("statement_id", "header_idx", "found_by", F.col("roles.date").alias("date_col"), F.col("roles.narration").alias("narration_col"), F.col("roles.balance").alias("balance_col"))


@query("p4_alias_header", f"""WITH {v.TX} SELECT statement_id, CAST(2 AS BIGINT) AS header_idx, 'alias' AS found_by,
  CASE bank_code WHEN 'icici' THEN 1 ELSE 0 END AS date_col, CASE bank_code WHEN 'hdfc' THEN 3 WHEN 'icici' THEN 1 WHEN 'sbi' THEN 1 END AS value_date_col,
  CASE bank_code WHEN 'hdfc' THEN 1 WHEN 'icici' THEN 4 WHEN 'sbi' THEN 2 ELSE 1 END AS narration_col,
  CASE bank_code WHEN 'hdfc' THEN 2 WHEN 'icici' THEN 3 WHEN 'sbi' THEN 3 ELSE 2 END AS reference_col,
  CASE bank_code WHEN 'hdfc' THEN 4 WHEN 'icici' THEN 5 WHEN 'sbi' THEN 4 ELSE 3 END AS debit_col FROM tx GROUP BY ALL""")
def _(s, d):
    found = sh.detect_headers(_clean(s, d).withColumn("bank_code", F.lit("unlisted")), tp.catalogue(s))
    return found.select("statement_id", "header_idx", "found_by", *[F.col(f"roles.{r}").alias(f"{r}_col") for r in ["date", "value_date", "narration", "reference", "debit"]])


@query("p5_positions", f"""WITH {v.TX} SELECT statement_id, CASE WHEN statement_id % 2 = 0 THEN 0 END::BIGINT AS header_idx, CASE WHEN statement_id % 2 = 0 THEN 'positions' ELSE 'none' END AS found_by FROM tx GROUP BY ALL""")
def _(s, d):
    rows = _clean(s, d).filter("row_idx <> 2").withColumn("bank_code", F.when(F.col("statement_id") % 2 == 0, F.col("bank_code")).otherwise("unlisted"))
    return sh.detect_headers(rows, tp.catalogue(s)).select("statement_id", "header_idx", "found_by")


@query("p6_cells", f"WITH {v.TX} SELECT id, narration FROM tx")
def _(s, d):
    rows = _clean(s, d)
    roles = sh.detect_headers(rows, tp.catalogue(s)).select("statement_id", "roles")
    ref = sh.cell(F.col("roles.reference"))
    return rows.join(roles, "statement_id").filter(ref.startswith("REF")).filter(F.col("row_idx") > 2).select(
        F.substring(ref, 4, 20).cast("bigint").alias("id"), sh.cell(F.col("roles.narration")).alias("narration"))


@query("p7_continuations", f"WITH {v.TX}, {PARSED} SELECT statement_id, row_number, narration FROM pa UNION ALL SELECT statement_id, max(row_number) + 1, 'TOTAL' FROM pa GROUP BY ALL")
def _(s, d):
    rows = _clean(s, d)
    return sh.merge_continuations(rows, sh.detect_headers(rows, tp.catalogue(s)), fx.long_statements(s, d)).select("statement_id", "row_number", "narration")


@query("p8_dates", f"WITH {v.TX}, {PARSED} SELECT statement_id, row_number, txn_date, value_date FROM pa")
def _(s, d):
    return _parsed(s, d).select("statement_id", "row_number", "txn_date", "value_date")


@query("p8_month_first", f"WITH {v.TX} SELECT statement_id, row_number, txn_date FROM tx")
def _(s, d):
    """Dates written month first, by banks whose templates say so."""
    month_first = tp.catalogue(s).withColumn("date_format", F.lit("%m/%d/%Y"))
    return sh.parse_statements(fx.raw_rows(s, d, "MM/dd/yyyy"), month_first, fx.long_statements(s, d)).select("statement_id", "row_number", "txn_date")


@query("p9_repaired_dates", f"WITH {v.TX} SELECT id, txn_date FROM tx")
def _(s, d):
    tx = fx.transactions(s, d, clients=False)
    kind = F.col("id") % 4
    typed = (
        F.when(kind == 0, F.translate(F.date_format("txn_date", "dd / MM / yyyy"), "01", "Ol"))
        .when(kind == 1, F.translate(F.date_format("txn_date", "yyyy.MM.dd"), "025", "oZS"))
        .when(kind == 2, F.concat(F.translate(F.date_format("txn_date", "dd"), "01", "oi"), F.lit("  "), F.upper(F.date_format("txn_date", "MMM")), F.lit(" "), F.translate(F.date_format("txn_date", "yyyy"), "0", "O")))
        .otherwise(F.date_format("txn_date", "d MMMM yyyy")))
    return tx.select("id", values.parse_date(typed).alias("txn_date"))


@query("p10_amounts", f"""WITH {v.TX} SELECT id, CASE WHEN id % 3 = 0 THEN -coalesce(debit, credit) ELSE coalesce(debit, credit) END AS amount FROM tx""")
def _(s, d):
    tx = fx.transactions(s, d, clients=False)
    shown = F.format_number(F.coalesce("debit", "credit"), 2)
    typed = F.when(F.col("id") % 3 == 0, F.concat(F.lit("("), shown, F.lit(")"))).when(F.col("id") % 3 == 1, F.concat(F.lit("INR "), shown, F.lit(" Dr"))).otherwise(shown)
    return tx.select("id", values.parse_amount(typed).alias("amount"))


@query("p11_transactions", f"WITH {v.TX}, {PARSED} SELECT statement_id, bank_code, row_number, txn_date, value_date, narration, reference_no, debit, credit, balance FROM pa")
def _(s, d):
    return _parsed(s, d).select("statement_id", "bank_code", "row_number", "txn_date", "value_date", "narration", "reference_no", "debit", "credit", "balance")


def _lines(s, d):
    """Text lines: a numbered transaction line per row, and a line of prose for every third id."""
    tx = fx.transactions(s, d, numbered=True, clients=False)
    word = F.when(F.col("id") % 4 == 0, " salary received ").when(F.col("id") % 4 == 1, " refund to ").when(F.col("id") % 4 == 2, " purchase ").otherwise("  plain ")
    line = F.concat(F.lit("p "), F.date_format("txn_date", "dd-MM-yyyy"), F.lit("  shop"), word, F.lit("x"), F.lit("   "), F.format_number(F.coalesce("debit", "credit"), 2),
                    F.when(F.col("id") % 2 == 0, F.concat(F.lit("\t"), F.format_number("balance", 2))).otherwise(""))
    both = F.array_compact(F.array(F.struct((F.col("row_number") * 2).alias("n"), line.alias("t")), F.when(F.col("id") % 3 == 0, F.struct((F.col("row_number") * 2 + 1).alias("n"), F.lit("carried forward on 12-13").alias("t")))))
    return tx.select("statement_id", F.explode(both).alias("l")).select("statement_id", F.col("l.n").alias("line_no"), F.col("l.t").alias("line"))


@query("p12_text_lines", f"""WITH {v.TX} SELECT statement_id, row_number, txn_date, 'shop' || CASE id % 4 WHEN 0 THEN ' salary received ' WHEN 1 THEN ' refund to ' WHEN 2 THEN ' purchase ' ELSE ' plain ' END || 'x' AS narration,
  CASE WHEN id % 4 <> 0 THEN coalesce(debit, credit) END AS debit, CASE WHEN id % 4 = 0 THEN coalesce(debit, credit) END AS credit, CASE WHEN id % 2 = 0 THEN balance END AS balance FROM tx""")
def _(s, d):
    return sh.parse_text_lines(_lines(s, d), fx.long_statements(s, d)).drop("line_no")


@query("p13_side", rf"""WITH m AS (SELECT doc_id, {v.bordered('text')} AS text FROM documents) SELECT doc_id,
  regexp_matches(text, '\b(cr|credit|received|deposit|refund|salary)\b', 'i') AND NOT regexp_matches(text, '\b(dr|debit|paid|payment|withdrawal|purchase|to)\b', 'i') AS is_credit FROM m""")
def _(s, d):
    return fx.table(s, d, "documents").select("doc_id", sh.is_credit(F.col("text")).alias("is_credit"))


def _table_rows(s, d):
    """The header and what is below it, without the title row."""
    return _clean(s, d).filter("row_idx >= 2")


def _cells_sql(date, text, ref, out, into, left, no):
    return (f"CASE bank_code WHEN 'hdfc' THEN [{date}, {text}, {ref}, {date}, {out}, {into}, {left}] WHEN 'icici' THEN [{no}, {date}, {date}, {ref}, {text}, {out}, {into}, {left}] "
            f"WHEN 'sbi' THEN [{date}, {date}, {text}, {ref}, {out}, {into}, {left}] ELSE [{date}, {text}, {ref}, {out}, {into}, {left}] END")


def _money_sql(value):
    return f"format('{{:,.2f}}', CAST({value} AS DOUBLE))"


HEADERS_SQL = "CASE bank_code " + " ".join(
    "WHEN '{}' THEN [{}]".format(b[0], ", ".join(f"'{h}'" for h in b[5])) for b in tp.BANKS if b[0] in ("hdfc", "icici", "sbi", "axis")) + " END"

# The rendered table rows with their cells, numbered per statement from the header on.
NUMBERED = f"""rc AS (SELECT statement_id, (row_number - 1) * 3 + 3 AS row_idx,
   {_cells_sql(DAY, 'narration', "'REF' || id", "coalesce(CAST(debit AS VARCHAR), '')", "coalesce(CAST(credit AS VARCHAR) || ' Cr', '')", _money_sql('balance'), HDFC_NO)} AS cells FROM tx
  UNION ALL SELECT statement_id, (row_number - 1) * 3 + 4, {_cells_sql("''", "'MORE ' || id", "''", "''", "''", "''", "''")} FROM tx WHERE id % 4 = 0
  UNION ALL SELECT statement_id, 2, {HEADERS_SQL} FROM tx GROUP BY statement_id, bank_code
  UNION ALL SELECT statement_id, max(row_number - 1) * 3 + 6, {_cells_sql("''", "'TOTAL'", "''", "'1.00'", "'2.00'", _money_sql('max(balance)'), "''")} FROM tx GROUP BY statement_id, bank_code),
nr AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY row_idx) AS n FROM rc)"""


def _date_sql(value):
    return (rf"CASE WHEN regexp_matches({value}, '^\d+/\d+/\d{{4}}$') THEN CAST(try_strptime({value}, '%d/%m/%Y') AS DATE) WHEN regexp_matches({value}, '^\d+/\d+/\d\d$') THEN CAST(try_strptime({value}, '%d/%m/%y') AS DATE) "
            rf"WHEN regexp_matches({value}, '^\d+-\d+-\d{{4}}$') THEN CAST(try_strptime({value}, '%d-%m-%Y') AS DATE) END")


def _amount_sql(value):
    return rf"TRY_CAST(regexp_replace({value}, '[^0-9.\-]', '', 'g') AS DECIMAL(18,2))"


def _named_sql(words):
    return "CASE WHEN " + " OR ".join(f"contains(lower(name), '{w}')" for w in words) + " THEN 30 ELSE 0 END"


EVIDENCE_SQL = {"date": "10 * dates", "narration": "CASE WHEN letters / c > 15 THEN 20 ELSE 0 END", "debit": "CASE WHEN numbers / c > 0.7 THEN 20 ELSE 0 END",
                "credit": "CASE WHEN numbers / c > 0.7 THEN 20 ELSE 0 END", "balance": "CASE WHEN numbers / c > 0.9 THEN 20 ELSE 0 END"}
SCORED_SQL = rf"""{NUMBERED}, hc AS (SELECT statement_id, unnest(range(len(cells))) AS pos, unnest(cells) AS name FROM nr WHERE n = 1),
sv AS (SELECT hc.statement_id, pos, name, cells[pos + 1] AS v FROM hc LEFT JOIN nr ON nr.statement_id = hc.statement_id AND n BETWEEN 2 AND 11),
sa AS (SELECT statement_id, pos, name, greatest(count(v), 1) AS c, count(*) FILTER (TRY_CAST(replace(replace(trim(v), ',', ''), '₹', '') AS DOUBLE) IS NOT NULL) AS numbers, coalesce(sum(length(v)), 0) AS letters,
  count(*) FILTER (regexp_matches(v, '\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}')) + count(*) FILTER (regexp_matches(v, '\d{{4}}[/-]\d{{1,2}}[/-]\d{{1,2}}')) AS dates FROM sv GROUP BY ALL),
al AS ({" UNION ALL ".join(f"SELECT statement_id, pos, '{r}' AS role, {_named_sql(w)} + {EVIDENCE_SQL[r]} AS score, {least} AS least, {full} AS full_score FROM sa" for r, (w, least, full) in sh.SCORED_ROLES.items())}),
be AS (SELECT *, row_number() OVER (PARTITION BY statement_id, role ORDER BY score DESC, pos) AS k FROM al),
sr AS (SELECT statement_id, role, CAST(pos AS INTEGER) AS pos, CAST(score AS INTEGER) AS score, CAST(round_even(score / full_score, 2) AS DOUBLE) AS confidence FROM be WHERE k = 1 AND score > least)"""


@query("p14_score_columns", f"WITH {v.TX}, {SCORED_SQL} SELECT * FROM sr")
def _(s, d):
    return sh.score_columns(_table_rows(s, d))


def _plain_sql(role):
    value = f"cells[list_extract(map_extract(roles, '{role}'), 1) + 1]"
    return f"nullif(TRY_CAST(trim(replace(replace(replace(trim({value}), '₹', ''), '$', ''), ',', '')) AS DECIMAL(18,2)), 0)"


@query("p15_extract_scored", f"""WITH {v.TX}, {SCORED_SQL}, ro AS (SELECT statement_id, map_from_entries(list((role, pos))) AS roles, CAST(round_even(CAST(sum(CAST(round(confidence * 100) AS BIGINT)) * 10 AS DOUBLE) / count(*), 0) / 1000 AS DOUBLE) AS parser_confidence FROM sr GROUP BY ALL),
x AS (SELECT statement_id, row_idx, {_date_sql("cells[list_extract(map_extract(roles, 'date'), 1) + 1]")} AS txn_date, trim(cells[list_extract(map_extract(roles, 'narration'), 1) + 1]) AS narration,
  {_plain_sql('debit')} AS debit, {_plain_sql('credit')} AS credit, {_plain_sql('balance')} AS balance, parser_confidence FROM nr JOIN ro USING (statement_id) WHERE n > 1)
SELECT * FROM x WHERE txn_date IS NOT NULL OR narration IS NOT NULL""")
def _(s, d):
    rows = _table_rows(s, d)
    return sh.extract_scored(rows, sh.score_columns(rows))


ROLES_SQL = rf"""{NUMBERED}, cv AS (SELECT statement_id, unnest(range(len(cells))) AS pos, trim(unnest(cells)) AS v FROM nr WHERE n BETWEEN 2 AND 21),
cd AS (SELECT *, regexp_matches(v, '^\s*\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}\s*$') AS is_date, regexp_matches(v, '^\s*-?\(?[\d,]+(?:\.\d{{1,2}})?\)?\s*(?:Cr|Dr)?\s*$', 'i') AS is_amount FROM cv WHERE v <> ''),
ca AS (SELECT statement_id, CAST(pos AS INTEGER) AS pos, count(*) FILTER (is_date) AS dates, count(*) FILTER (is_amount) AS amounts, coalesce(sum(length(v)) FILTER (NOT is_date AND NOT is_amount), 0) AS letters FROM cd GROUP BY ALL),
dt AS (SELECT statement_id, arg_max(pos, {{'d': dates, 'p': -pos}}) AS date FROM ca WHERE dates > 0 GROUP BY ALL),
am AS (SELECT ca.statement_id, any_value(date) AS date, coalesce(list(pos ORDER BY pos) FILTER (amounts > 0 AND pos IS DISTINCT FROM date), []) AS a FROM ca LEFT JOIN dt ON dt.statement_id = ca.statement_id GROUP BY ALL),
ro AS (SELECT statement_id, date, CASE WHEN len(a) >= 3 THEN a[-3] ELSE a[1] END AS debit, CASE WHEN len(a) >= 3 THEN a[-2] ELSE a[2] END AS credit, CASE WHEN len(a) >= 3 THEN a[-1] END AS balance FROM am),
na AS (SELECT ca.statement_id, arg_max(pos, {{'l': letters, 'p': -pos}}) AS narration FROM ca JOIN ro USING (statement_id) WHERE letters > 0 AND pos IS DISTINCT FROM date AND pos IS DISTINCT FROM debit
  AND pos IS DISTINCT FROM credit AND pos IS DISTINCT FROM balance GROUP BY ALL),
pr AS (SELECT ro.*, narration FROM ro LEFT JOIN na USING (statement_id))"""


@query("p16_pattern_roles", f"WITH {v.TX}, {ROLES_SQL} SELECT statement_id, date, debit, credit, balance, narration FROM pr")
def _(s, d):
    return sh.pattern_roles(_table_rows(s, d))


@query("p17_extract_by_pattern", f"""WITH {v.TX}, {ROLES_SQL}, x AS (SELECT statement_id, row_idx, {_date_sql('cells[date + 1]')} AS txn_date, cells[narration + 1] AS narration,
  {_amount_sql('cells[debit + 1]')} AS debit, {_amount_sql('cells[credit + 1]')} AS credit, {_amount_sql('cells[balance + 1]')} AS balance FROM nr JOIN pr USING (statement_id))
SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY row_idx) AS row_number FROM x WHERE txn_date IS NOT NULL""")
def _(s, d):
    rows = _table_rows(s, d)
    return sh.extract_by_pattern(rows, sh.pattern_roles(rows), fx.long_statements(s, d))


@query("p18_row_confidence", f"WITH {v.TX}, {PARSED} SELECT statement_id, row_number, CAST((row_number - 1) * 3 + 3 AS DOUBLE) / 1000 AS ocr_confidence FROM pa")
def _(s, d):
    rows = fx.raw_rows(s, d).withColumn("row_confidence", F.col("row_idx") / 1000)
    return sh.parse_statements(rows, tp.catalogue(s), fx.long_statements(s, d)).select("statement_id", "row_number", "ocr_confidence")


@query("p19_outcomes", f"""WITH {v.TX}, ty AS (SELECT *, {TYPE} AS t FROM st), cn AS (SELECT statement_id, count(*) AS n FROM tx WHERE statement_id % 5 <> 0 GROUP BY ALL)
SELECT ty.statement_id, coalesce(n, 0) AS row_count, CASE WHEN t = 'csv' THEN 'csv' WHEN t IN ('xlsx', 'xls') THEN 'excel' WHEN t = 'pdf' THEN 'pdf' END AS parser,
  CASE WHEN n IS NOT NULL AND t IN ('csv', 'pdf', 'xlsx', 'xls') OR t = 'pdf' THEN 'READY_FOR_REVIEW' ELSE 'FAILED' END AS status,
  CASE WHEN t NOT IN ('csv', 'pdf', 'xlsx', 'xls') THEN 'Unsupported statement format ''' || t || '''.' WHEN n IS NULL THEN 'The file was read but no transaction rows matched.' END AS error_message
FROM ty LEFT JOIN cn USING (statement_id)""")
def _(s, d):
    st = fx.statements(s, d).select("statement_id", readers.file_type(F.col("file_name")).alias("file_type"))
    parsed = fx.transactions(s, d, clients=False).filter("statement_id % 5 <> 0")
    return sh.outcomes(st, parsed).drop("file_type")


@query("p20_unparsed_only", f"WITH {v.TX}, {RAW} SELECT statement_id, row_idx FROM rr WHERE statement_id % 5 = 0")
def _(s, d):
    done = fx.transactions(s, d, clients=False).filter("statement_id % 5 <> 0")
    return sh.unparsed_only(_clean(s, d), done).select("statement_id", "row_idx")


# ---------------------------------------------------------------- recognition

WORDS = """ow AS (SELECT l_orderkey // 10 AS doc_id, l_linenumber % 2 + 1 AS page, 'w' || l_partkey AS text, l_quantity / 50 AS confidence, (l_partkey % 40) * 30 AS x,
  (l_suppkey % 8) * 14 + l_linenumber % 3 AS y, l_partkey % 30 + 20 AS w, l_suppkey % 5 + 10 AS h FROM lineitem),
lm AS (SELECT doc_id, page, greatest(10, CAST(floor(median(h) * 0.6) AS BIGINT)) AS rg, greatest(20, CAST(floor(median(w) * 0.8) AS BIGINT)) AS cg FROM ow GROUP BY ALL),
yc AS (SELECT *, y + h // 2 AS yc FROM ow JOIN lm USING (doc_id, page)),
y2 AS (SELECT *, CASE WHEN abs(yc - lag(yc) OVER p) <= rg THEN 0 ELSE 1 END AS o FROM yc WINDOW p AS (PARTITION BY doc_id, page ORDER BY yc, x, text)),
ro AS (SELECT *, CAST(sum(o) OVER (PARTITION BY doc_id, page ORDER BY yc, x, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_no FROM y2),
x2 AS (SELECT *, CASE WHEN x - lag(x + w) OVER p <= cg THEN 0 ELSE 1 END AS c FROM ro WINDOW p AS (PARTITION BY doc_id, page, row_no ORDER BY x, yc, text)),
ce AS (SELECT *, CAST(sum(c) OVER (PARTITION BY doc_id, page, row_no ORDER BY x, yc, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cell_no FROM x2),
cl AS (SELECT doc_id, page, row_no, cell_no, string_agg(text, ' ' ORDER BY x, yc, text) AS text, avg(confidence) AS confidence, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2 FROM ce GROUP BY ALL)"""


def _cells(s, d):
    words = fx.ocr_words(s, d)
    return rc.split_cells(rc.cluster_rows(words), hot_keys(words, rc.PAGE))


@query("o1_rows", f"WITH {WORDS} SELECT doc_id, page, text, x, y, row_no FROM ro")
def _(s, d):
    return rc.cluster_rows(fx.ocr_words(s, d)).select("doc_id", "page", "text", "x", "y", F.col("row_no").cast("long").alias("row_no"))


@query("o2_cells", f"WITH {WORDS} SELECT doc_id, page, row_no, cell_no, text, CAST(round(confidence, 6) AS DOUBLE) AS confidence, x1, y1, x2, y2 FROM cl")
def _(s, d):
    cells = _cells(s, d)
    return cells.withColumns({"confidence": F.round("confidence", 6), "row_no": F.col("row_no").cast("long"), "cell_no": F.col("cell_no").cast("long")})


@query("o3_row_confidence", f"WITH {WORDS} SELECT doc_id, page, row_no, CAST(round(avg(confidence), 6) AS DOUBLE) AS row_confidence FROM cl GROUP BY ALL")
def _(s, d):
    cells = _cells(s, d)
    return rc.row_confidence(cells).withColumns({"row_confidence": F.round("row_confidence", 6), "row_no": F.col("row_no").cast("long")})


CELLS = """bc AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 <> 0 THEN 2 ELSE 1 END AS page, r AS row_no, c AS cell_no,
  CASE WHEN r = 1 AND c = 1 THEN 'Date' WHEN r = 1 THEN 'Amount' WHEN c = 1 THEN CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority ELSE '' END AS text,
  CAST(o_orderkey % 50 + 50 + CASE WHEN r = 1 AND c = 1 THEN 1 WHEN r = 2 AND c = 2 THEN -1 ELSE 0 END AS DOUBLE) / 100 AS confidence
  FROM orders, (SELECT unnest([1, 1, 2, 2]) AS r, unnest([1, 2, 1, 2]) AS c))"""


@query("o4_block_cells", f"WITH {CELLS} SELECT *, CAST(cell_no AS DOUBLE) AS x1, cell_no + 0.5::DOUBLE AS x2 FROM bc")
def _(s, d):
    return rc.table_cells(fx.ocr_blocks(s, d)).select("doc_id", "page", "row_no", "cell_no", "text", "confidence", "x1", "x2")


@query("o5_stitched_pages", f"WITH {CELLS} SELECT doc_id, count(*) AS cells, CAST(round(sum(confidence), 4) AS DOUBLE) AS confidence FROM bc GROUP BY ALL")
def _(s, d):
    blocks = fx.ocr_blocks(s, d).withColumnRenamed("doc_id", "job_id")
    first = blocks.filter("id in ('T', 'C11', 'C12', 'W1')").withColumn("part_no", F.lit(1))
    second = blocks.filter("id <> 'T'").withColumn("part_no", F.lit(2))
    cells = rc.table_cells(rc.stitch_pages(first.unionByName(second)))
    return cells.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query("o6_tiers", """SELECT l_orderkey // 10 AS doc_id, CASE WHEN l_quantity / 50 >= 0.85 THEN 'high' WHEN l_quantity / 50 >= 0.70 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n,
  CAST(round(avg(l_quantity / 50), 6) AS DOUBLE) AS mean_confidence FROM lineitem GROUP BY ALL""")
def _(s, d):
    return rc.tier_counts(fx.ocr_words(s, d), ["doc_id"]).withColumn("mean_confidence", F.round("mean_confidence", 6))
