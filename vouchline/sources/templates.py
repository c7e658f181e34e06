"""The bank template catalogue and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Column positions of the four statement layouts.
PLAIN = {"date": 0, "narration": 1, "reference": 2, "debit": 3, "credit": 4, "balance": 5}
WITH_VALUE_DATE = {"date": 0, "value_date": 1, "narration": 2, "reference": 3, "debit": 4, "credit": 5, "balance": 6}
HDFC_LAYOUT = {"date": 0, "narration": 1, "reference": 2, "value_date": 3, "debit": 4, "credit": 5, "balance": 6}
ICICI_LAYOUT = {"date": 2, "narration": 4, "reference": 3, "value_date": 1, "debit": 5, "credit": 6, "balance": 7}

ACCOUNT = "Account Statement"
OF_ACCOUNT = "Statement of Account"
DMY, DMY_DASH, DMY_SHORT = "%d/%m/%Y", "%d-%m-%Y", "%d/%m/%y"

# Code | bank_code | name | keywords | IFSC prefix | headers | layout | date format.
BANKS = [
    ("au_small_finance", "AU", "AU Small Finance Bank Ltd.", ["AU Small Finance Bank", "AU SMALL FINANCE BANK", "AUBANK", ACCOUNT],
     "AUBL", ["Transaction Date", "Value Date", "Narration", "Reference No", "Debit", "Credit", "Balance"], WITH_VALUE_DATE, DMY),
    ("axis", "AXIS", "Axis Bank Ltd.", ["axis bank", "AXISBANK", "axis bank limited", "AXIS BANK"],
     "UTIB", ["Date", "Particulars", "Chq./Ref.No.", "Debit Amount", "Credit Amount", "Balance"], PLAIN, DMY_DASH),
    ("bandhan", "BANDHAN", "Bandhan Bank Ltd.", ["Bandhan Bank", OF_ACCOUNT],
     "BDBL", ["Txn Date", "Value Date", "Particulars", "Ref No", "Debit", "Credit", "Balance"], WITH_VALUE_DATE, DMY),
    ("bank_of_baroda", "BOB", "Bank of Baroda", ["Bank of Baroda", "BANK OF BARODA", "BARODA CONNECT", ACCOUNT],
     "BARB", ["Date", "Description", "Cheque No", "Debit", "Credit", "Balance"], PLAIN, DMY),
    ("bank_of_india", "BOI", "Bank of India", ["Bank of India", "BANK OF INDIA", "BOI", ACCOUNT],
     "BKID", ["Date", "Narration", "Chq No", "Debit", "Credit", "Balance"], PLAIN, DMY),
    ("boma", "BOMA", "Bank of Maharashtra", ["Bank of Maharashtra", OF_ACCOUNT],
     "MAHB", ["Txn Date", "Particulars", "Cheque No", "Withdrawn", "Deposit", "Balance"], PLAIN, DMY),
    ("canara", "CANARA", "Canara Bank", ["Canara Bank", "CANARA BANK", "CANARABANK", OF_ACCOUNT],
     "CNRB", ["Date", "Particulars", "Cheque No", "Withdrawals", "Deposits", "Balance"], PLAIN, DMY),
    ("cbi", "CBI", "Central Bank of India", ["Central Bank of India", "CENTRAL BANK OF INDIA", "CBI", ACCOUNT],
     "CBIN", ["Date", "Narration", "Cheque No", "Debit", "Credit", "Balance"], PLAIN, DMY),
    ("city_union", "CITY_UNION", "City Union Bank Ltd.", ["City Union Bank", OF_ACCOUNT],
     "CIUB", ["Date", "Narration", "Ref No", "Withdrawal", "Deposit", "Balance"], PLAIN, DMY),
    ("dhanlaxmi", "DHANLAXMI", "Dhanlaxmi Bank Ltd.", ["Dhanlaxmi Bank", ACCOUNT],
     "DLXB", ["Date", "Particulars", "Chq/Ref No", "Debit", "Credit", "Balance"], PLAIN, DMY),
    ("equitas", "EQUITAS", "Equitas Small Finance Bank Ltd.", ["Equitas Small Finance Bank", ACCOUNT],
     "ESFB", ["Txn Date", "Narration", "Ref No", "Withdrawal", "Deposit", "Balance"], PLAIN, DMY),
    ("federal", "FEDERAL", "Federal Bank Ltd.", ["Federal Bank", "FEDERAL BANK", "FEDBANK", ACCOUNT],
     "FDRL", ["Date", "Particulars", "Cheque No", "Debit", "Credit", "Balance"], PLAIN, DMY_DASH),
    ("hdfc", "HDFC", "HDFC Bank Ltd.", ["HDFC BANK", OF_ACCOUNT],
     "HDFC", ["Date", "Narration", "Chq./Ref.No.", "Value Dt", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance"], HDFC_LAYOUT, DMY_SHORT),
    ("icici", "ICICI", "ICICI Bank", ["ICICI Bank Limited", "Statement of Transactions"],
     "ICIC", ["S No.", "Value Date", "Transaction Date", "Cheque Number", "Transaction Remarks", "Withdrawal Amount (INR )",
              "Deposit Amount (INR )", "Balance (INR )"], ICICI_LAYOUT, DMY),
    ("idbi", "IDBI", "IDBI Bank Ltd.", ["IDBI Bank", OF_ACCOUNT],
     "IBKL", ["Txn Date", "Value Date", "Narration", "Ref No.", "Debit", "Credit", "Balance"], WITH_VALUE_DATE, DMY),
    ("idfc_first", "IDFC", "IDFC FIRST Bank Ltd.", ["IDFC FIRST Bank", "IDFCFIRSTBANK", "IDFC Bank", ACCOUNT],
     "IDFB", ["Transaction Date", "Value Date", "Narration", "Cheque/Ref No", "Withdrawal", "Deposit", "Closing Balance"],
     WITH_VALUE_DATE, DMY),
    ("indian_bank", "INDIAN_BANK", "Indian Bank", ["Indian Bank", OF_ACCOUNT],
     "IDIB", ["Date", "Value Date", "Particulars", "Chq/Ref No", "Debit", "Credit", "Balance"], WITH_VALUE_DATE, DMY),
    ("indusind", "INDUSIND", "IndusInd Bank Ltd.", ["IndusInd Bank", "INDUSIND BANK", "INDUSINDBANK", OF_ACCOUNT],
     "INDB", ["Date", "Particulars", "Chq./Ref. No.", "Withdrawals", "Deposits", "Balance"], PLAIN, DMY_DASH),
    ("iob", "IOB", "Indian Overseas Bank", ["Indian Overseas Bank", ACCOUNT],
     "IOBA", ["Date", "Particulars", "Chq No", "Withdrawals", "Deposits", "Balance"], PLAIN, DMY),
    ("jkb", "JKB", "Jammu & Kashmir Bank Ltd.", ["Jammu & Kashmir Bank", OF_ACCOUNT],
     "JAKA", ["Txn Date", "Description", "Ref No", "Debit", "Credit", "Balance"], PLAIN, DMY),
    ("karur_vysya", "KVB", "Karur Vysya Bank Ltd.", ["Karur Vysya Bank", ACCOUNT],
     "KVBL", ["Date", "Particulars", "Instrument No", "Debit", "Credit", "Balance"], PLAIN, DMY),
    ("kotak", "KOTAK", "Kotak Mahindra Bank Ltd.", ["kotak mahindra", "KOTAKBANK", "kotak bank", "Kotak Mahindra Bank", "KMB"],
     "KKBK", ["Date", "Description", "Reference No.", "Debit", "Credit", "Closing Balance"], PLAIN, DMY_DASH),
    ("pnb", "PNB", "Punjab National Bank", ["Punjab National Bank", "PUNJAB NATIONAL BANK", "PNB", ACCOUNT],
     "PUNB", ["Txn Date", "Value Date", "Description", "Cheque No", "Debit", "Credit", "Balance"], WITH_VALUE_DATE, DMY),
    ("punjab_and_sind_bank", "PSIB", "Punjab & Sind Bank", ["Punjab & Sind Bank", OF_ACCOUNT],
     "PSIB", ["Date", "Description", "Cheque No", "Debit", "Credit", "Balance"], PLAIN, DMY),
    ("rbl", "RBL", "RBL Bank Ltd.", ["RBL Bank", "RATNAKAR BANK", "RBLBANK", ACCOUNT],
     "RATN", ["Txn Date", "Value Date", "Description", "Cheque/Ref No", "Debit", "Credit", "Balance"], WITH_VALUE_DATE, DMY),
    ("sbi", "SBI", "State Bank of India", ["State Bank of India", "SBI", ACCOUNT],
     "SBIN", ["Txn Date", "Value Date", "Description", "Ref No./Cheque No.", "Debit", "Credit", "Balance"], WITH_VALUE_DATE, DMY),
    ("south_indian_bank", "SIB", "South Indian Bank Ltd.", ["South Indian Bank", OF_ACCOUNT],
     "SIBL", ["Date", "Value Date", "Particulars", "Chq/Ref No", "Debit", "Credit", "Balance"], WITH_VALUE_DATE, DMY),
    ("uco", "UCO", "UCO Bank", ["UCO Bank", ACCOUNT],
     "UCBA", ["Date", "Particulars", "Instrument No", "Debit", "Credit", "Balance"], PLAIN, DMY),
    ("union_bank", "UNION", "Union Bank of India", ["Union Bank of India", "UNION BANK OF INDIA", "UNIONBANK", ACCOUNT],
     "UBIN", ["Date", "Particulars", "Cheque No", "Debit", "Credit", "Balance"], PLAIN, DMY),
    ("yes_bank", "YES", "Yes Bank Ltd.", ["YES BANK", "Yes Bank Ltd", "YESBANK", OF_ACCOUNT],
     "YESB", ["Transaction Date", "Value Date", "Description", "Cheque No/Reference No", "Debit", "Credit", "Balance"],
     WITH_VALUE_DATE, DMY),
]

# What follows the IFSC prefix, where it is not `0` and six digits.
IFSC_TAIL = {"hdfc": r"000[0-9]{4}", "icici": r"000[0-9]{4}", "bank_of_baroda": r"0[0-9A-Z]{6}", "jkb": r"0[A-Z0-9]{6}"}
IFSC_COLON_REQUIRED = {"hdfc", "icici"}

# Fingerprint keywords that many banks share.
GENERIC_KEYWORDS = [ACCOUNT, OF_ACCOUNT, "Statement of Transactions"]

SCHEMA = (
    "code string, bank_code string, bank_name string, type string, headers array<string>, "
    "columns map<string,int>, date_format string, keywords array<string>, ifsc_regex array<string>"
)
REQUIRED = ["bank_code", "bank_name", "type", "fingerprint", "extraction"]


def ifsc_pattern(code: str, prefix: str) -> str:
    colon = ":" if code in IFSC_COLON_REQUIRED else ":?"
    return rf"IFSC\s*{colon}\s*{prefix}{IFSC_TAIL.get(code, '0[0-9]{6}')}"


def catalogue(spark: SparkSession) -> DataFrame:
    """The 30 built-in templates; a user's own catalogue is any DataFrame of the same schema."""
    rows = [
        (code, bank, name, "pdf_text", headers, layout, fmt, keywords, [ifsc_pattern(code, prefix)])
        for code, bank, name, keywords, prefix, headers, layout, fmt in BANKS
    ]
    return spark.createDataFrame(rows, SCHEMA)


def with_template(df: DataFrame, templates: DataFrame) -> DataFrame:
    """Attach each row's template by file-stem code; an unknown or missing bank gets a null template.

    The catalogue is small in practice, but nothing here depends on it: Spark broadcasts it by its size or shuffles.
    """
    packed = templates.select(F.lower("code").alias("_code"), F.struct(*templates.columns).alias("template"))
    return df.join(packed, F.lower("bank_code") == F.col("_code"), "left").drop("_code")


def validation_error(template: dict[str, Column]) -> Column:
    """First missing field of an uploaded template, or null when it is valid."""
    error = F.lit(None).cast("string")
    for field in reversed(REQUIRED):
        error = F.when(template[field].isNull(), F.concat(F.lit("missing "), F.lit(field))).otherwise(error)
    return error


def catalogue_changes(old: DataFrame, new: DataFrame, key: str = "code", version: str = "version") -> DataFrame:
    """added / modified / deleted templates between two catalogue versions."""
    before = old.select(key, F.col(version).alias("_old"))
    after = new.select(key, F.col(version).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted")
        .when(F.col("_old") != F.col("_new"), "modified")
    )
    return before.join(after, key, "full").select(key, change.alias("change")).filter("change is not null")
