import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from vouchline.operators import quality as q, shape as sh
from vouchline.sources import readers, templates as tp

RAW = "statement_id long, bank_code string, row_idx long, cells array<string>"
Dec, D = decimal.Decimal, datetime.date


def raw(spark, statements):
    return spark.createDataFrame([(sid, bank, i, cells) for sid, bank, rows in statements for i, cells in enumerate(rows)], RAW)


def parsed(spark, *statements):
    out = sh.parse_statements(raw(spark, statements), tp.catalogue(spark)).orderBy("statement_id", "row_number").collect()
    return [(r.statement_id, r.row_number, r.txn_date, r.narration, r.debit, r.credit, r.balance) for r in out]


HDFC = ["Date", "Narration", "Chq./Ref.No.", "Value Dt", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance"]


def test_hdfc_with_titles_totals_and_split_narration(spark):
    rows = [["HDFC BANK"], ["", " "], HDFC, ["01/04/24", "UPI-SWIGGY", "R1", "01/04/24", "350.00", "", "1,000.00"], ["", "more text", "", "", "", "", ""],
            ["", "nan", "", "", "", "", ""], ["02/04/24", "SALARY", "R2", "02/04/24", "", "50,000.00", "51,000.00"], ["", "TOTAL", "", "", "350.00", "50,000.00", ""]]
    assert parsed(spark, (1, "HDFC", rows)) == [
        (1, 1, D(2024, 4, 1), "UPI-SWIGGY more text", Dec("350.00"), None, Dec("1000.00")),
        (1, 3, D(2024, 4, 2), "SALARY", None, Dec("50000.00"), Dec("51000.00")),
    ]


def test_leading_continuations_form_one_row_and_shift_numbers(spark, all_hot):
    rows = [["Date", "Particulars", "Chq No", "Debit", "Credit", "Balance"], ["", "lead", "", "", "", ""], ["", "lead two", "", "", "", ""],
            *[[f"{d:02d}-01-2024", f"n{d}", "", "1.00", "", "5.00"] for d in range(1, 12)], ["", "tail", "", "", "", ""]]
    got = parsed(spark, (1, "axis", rows), (2, "axis", rows[:1] + rows[3:]))
    assert [(r[0], r[1]) for r in got] == [(1, n) for n in range(2, 13)] + [(2, n) for n in range(1, 12)]
    assert got[10][3] == "n11 tail" and got[-1][3] == "n11 tail"


def test_header_choice_is_row_by_row(spark):
    alias_first = [["Txn Date", "Remarks", "x"], HDFC]
    no_header = [["01/04/24", "n", "r", "01/04/24", "1", "", "2"]]
    got = sh.detect_headers(raw(spark, [(1, "hdfc", alias_first), (2, "hdfc", no_header), (3, None, no_header)]), tp.catalogue(spark))
    found = {r.statement_id: (r.header_idx, r.found_by, r.roles and r.roles.narration) for r in got.collect()}
    assert found == {1: (0, "alias", 1), 2: (0, "positions", 1), 3: (None, "none", None)}


def test_two_known_rows_of_every_bank(spark):
    """The regression rows of all thirty templates parse exactly."""
    statements, expected = [], []
    for sid, (code, _, _, _, _, headers, columns, fmt) in enumerate(tp.BANKS):
        def line(**cells):
            row = [""] * len(headers)
            for role, value in cells.items():
                if role in columns:
                    row[columns[role]] = value
            return row
        day = D(2026, 5, 1).strftime(fmt)
        statements.append((sid, code, [headers, line(date=day, value_date=day, narration="UPI PAYMENT TO TEST VENDOR", reference="REF001", debit="100.00", balance="9900.00"),
                                       line(date=day, value_date=day, narration="NEFT CREDIT FROM TEST CUSTOMER", reference="REF002", credit="500.00", balance="10400.00")]))
        expected += [(sid, 1, "UPI PAYMENT TO TEST VENDOR", Dec("100.00"), None, Dec("9900.00")), (sid, 2, "NEFT CREDIT FROM TEST CUSTOMER", None, Dec("500.00"), Dec("10400.00"))]
    want = spark.createDataFrame(expected, "statement_id long, row_number long, narration string, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2)")
    got = sh.parse_statements(raw(spark, statements), tp.catalogue(spark))
    compared = q.compare_rows(want, got, ["statement_id", "row_number"])
    assert compared.count() == 60 and compared.filter("reason is not null").count() == 0
    assert q.suite_summary(compared, "statement_id").first().asDict() == {"total": 30, "passed": 30, "failed": 0}
    assert got.filter("txn_date <> date'2026-05-01'").count() == 0


def test_text_lines(spark):
    lines = ["Page 1", "01-02-2024  UPI paid to shop   1,200.50   9,000.00", "2024-02-03 salary received 50,000", "03/02/2024 refund to card (20.00)", "x 04/02/2024 misc 5"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "statement_id long, line_no long, line string")
    got = sh.parse_text_lines(df).orderBy("row_number").collect()
    assert [(r.row_number, r.narration, r.debit, r.credit, r.balance) for r in got] == [
        (1, "UPI paid to shop", Dec("1200.50"), None, Dec("9000.00")), (2, "salary received", None, Dec("50000.00"), None),
        (3, "refund to card", Dec("-20.00"), None, None), (4, "misc", Dec("5.00"), None, None)]


def test_roles_from_cell_patterns(spark):
    rows = [["No", "When", "What", "Out", "In", "Left", "x"]] + [[str(i), f"0{i}/01/2024", "some long narration", f"{i}00.00", "", "1,000.00", ""] for i in range(1, 5)]
    rows[2][4] = "55.00 Cr"
    roles = sh.pattern_roles(raw(spark, [(1, None, rows)])).first()
    assert (roles.date, roles.debit, roles.credit, roles.balance, roles.narration) == (1, 3, 4, 5, 2)
    got = sh.extract_by_pattern(raw(spark, [(1, None, rows)]), sh.pattern_roles(raw(spark, [(1, None, rows)]))).orderBy("row_number").collect()
    assert [(r.row_number, r.narration, r.debit) for r in got] == [(i, "some long narration", Dec(f"{i}00.00")) for i in range(1, 5)]


def test_scored_columns(spark):
    rows = [["Posted", "Memo", "Spent", "Income", "Running"]] + [[f"{i:02d}/01/2024", "a fairly long description", "10.00", "0", "₹1,000.00"] for i in range(1, 4)]
    rows.append(["13/25/2024", "x", "abc", "5", "1"])
    rows.append(["12/25/2024", "month first", "7", "", "1"])
    df = raw(spark, [(1, None, rows)])
    scored = sh.score_columns(df)
    assert {r.role: (r.pos, r.score) for r in scored.collect()} == {"date": (0, 80), "narration": (1, 50), "debit": (2, 50), "credit": (3, 50), "balance": (4, 50)}
    got = {r.narration: (r.txn_date, r.debit, r.credit) for r in sh.extract_scored(df, scored).collect()}
    assert got["month first"] == (D(2024, 12, 25), Dec("7.00"), None) and got["x"] == (None, None, Dec("5.00"))


def test_delimited_files(spark, tmp_path, all_hot):
    (tmp_path / "a.csv").write_text('﻿Date,Narration,Debit\n01/01/2024,"a, ""b""\nsecond",5\n\nx,y\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("Date;Narration;Debit\n01/01/2024;one, two;5,00\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("only words\n", encoding="utf-8")
    got = readers.read_delimited(spark, str(tmp_path)).select(F.regexp_extract("file", "([abc]).csv", 1).alias("f"), "row_idx", "cells").orderBy("f", "row_idx").collect()
    assert [(r.f, r.row_idx, r.cells) for r in got] == [
        ("a", 0, ["Date", "Narration", "Debit"]), ("a", 1, ["01/01/2024", 'a, "b"\nsecond', "5"]), ("a", 2, [""]), ("a", 3, ["x", "y"]),
        ("b", 0, ["Date", "Narration", "Debit"]), ("b", 1, ["01/01/2024", "one, two", "5,00"]), ("c", 0, ["only words"])]


def test_unclosed_quote_marks_its_record_and_loses_no_line(spark, tmp_path):
    (tmp_path / "d.csv").write_text('a,b\n1,"open\n' + "".join(f"{i},x\n" for i in range(50)), encoding="utf-8")
    got = readers.read_delimited(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [(r.cells, r.error) for r in got] == [(["a", "b"], None), (["1", '"open'], "A quoted cell is not closed.")] + [([str(i), "x"], None) for i in range(50)]


@pytest.mark.parametrize("blocks", [None, 200])
def test_files_agree_with_a_standard_csv_reader(spark, tmp_path, monkeypatch, blocks):
    import csv
    import io
    import random

    from vouchline import skew

    if blocks:  # many small splits, every file split
        monkeypatch.setattr(skew, "HOT_ROWS", 2)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(blocks))
    csv.field_size_limit(1 << 24)
    rng, texts = random.Random(7), {}
    for n in range(12):
        rows = [[rng.choice(["", "a", 'say "hi"', "x,y", "two\nlines", '5" pipe', '"', '""', "l1\n\nl3", '",', ' "q"']) for _ in range(rng.randrange(1, 5))] for _ in range(40)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["h1", "h2", "h3", "h4"], *rows])
        texts[n] = out.getvalue() + '1,5" pipe\n2,6" pipe\n3,w\n'
    texts[90] = "h,i\n" + ",".join(f'"c{i}"' for i in range(20_000)) + "\nlast,row\n"
    texts[91] = 'h,i\nbig,"' + "z" * 1_500_000 + '"\nlast,row\n'
    for n, t in texts.items():
        (tmp_path / f"f{n}.csv").write_text(t, encoding="utf-8")
    try:
        got = readers.read_delimited(spark, str(tmp_path)).select(F.regexp_extract("file", "f([0-9]+).csv", 1).cast("int").alias("n"), "row_idx", "cells", "error").orderBy("n", "row_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for n, t in texts.items():
        mine = [r.cells for r in got if r.n == n]
        assert mine == [r or [""] for r in csv.reader(io.StringIO(t, newline=""))], n
    assert not any(r.error for r in got)


@pytest.mark.parametrize("name, kind, branch", [("A.PDF", "pdf", "pdf"), ("x.y.XLS", "xls", "workbook"), ("p.webp", "image", "unsupported"), ("noext", "unknown", "unsupported"), ("a.docx", "docx", "unsupported")])
def test_file_types(spark, name, kind, branch):
    row = spark.createDataFrame([(name,)], "n string").select(readers.file_type(F.col("n")).alias("t"), readers.parse_branch(F.col("n")).alias("b")).first()
    assert (row.t, row.b) == (kind, branch)
