"""Masking of personal data in texts, log lines and nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The identifier patterns. Digits, blanks and word borders are Unicode-aware (`(?U)` is set where they are
# used): an identifier next to an accented letter is judged as one next to a plain letter.
CARD = r"\b(?:\d[\s-]?){13,19}\b"
AADHAAR = r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"
PAN = r"\b[A-Z]{5}\d{4}[A-Z]\b"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
PHONE = r"(?:\+91[\s-]?|0)?[6-9]\d{9}\b"
ACCT = r"\b\d{9,18}\b"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"

# The order of the passes decides which token a number gets.
TEXT_PASSES = [
    ("[CARD]", CARD), ("[AADHAAR]", AADHAAR), ("[PAN]", "(?i)" + PAN),
    ("[IFSC]", "(?i)" + IFSC), ("[PHONE]", PHONE), ("[ACCT]", ACCT),
]
LOG_PASSES = [
    ("[ACCT]", ACCT), ("[PAN]", "(?i)" + PAN), ("[PHONE]", PHONE), ("[IFSC]", "(?i)" + IFSC), ("[EMAIL]", EMAIL),
]
SCAN_ORDER = [
    ("CARD", CARD), ("AADHAAR", AADHAAR), ("PAN", "(?i)" + PAN), ("PHONE", PHONE), ("ACCT", ACCT),
]


def _apply(text: Column, passes: list[tuple[str, str]]) -> Column:
    for token, pattern in passes:
        text = F.regexp_replace(text, "(?U)" + pattern, token)
    return text


def mask_text(text: Column, account_number: Column | None = None) -> Column:
    """Replace identifiers by tokens; the statement's own account number goes first, literally."""
    if account_number is not None:
        known = F.coalesce(account_number, F.lit("")) != ""
        text = F.when(known, F.replace(text, account_number, F.lit("[ACCT]"))).otherwise(text)
    return _apply(text, TEXT_PASSES)


def first_violation(text: Column) -> Column:
    """Name of the first identifier kind still found in the text, or null."""
    label = F.when(text.rlike("(?U)" + SCAN_ORDER[0][1]), SCAN_ORDER[0][0])
    for name, pattern in SCAN_ORDER[1:]:
        label = label.when(text.rlike("(?U)" + pattern), name)
    return label


def redact_log(text: Column) -> Column:
    return _apply(text, LOG_PASSES)


def _scrub(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return redact_log(column)
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: _scrub(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(column, lambda _, v: _scrub(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        rebuilt = F.struct(*[_scrub(column[f.name], f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(column.isNotNull(), rebuilt)
    return column


def scrub_record(df: DataFrame, *columns: str) -> DataFrame:
    """Redact every string leaf of the given columns, however deeply nested; keys stay as they are."""
    return df.withColumns({c: _scrub(F.col(c), df.schema[c].dataType) for c in columns})
