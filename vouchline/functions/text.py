"""Narration text: cleaning, payment mode, counterparty, ledger hint, confidence and pattern key.

Everything is a column expression, so the whole chain runs as one projection inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Payment-mode patterns, first match wins in this order.
MODE_PATTERNS = [
    ("UPI", r"(^|[/|\s])upi[a-z]*(\b|[/|\s]|$)|\b(phonepe|gpay|google pay|paytm|bhim)\b"),
    ("NEFT", r"(^|[/|\s])neft(\b|[/|\s]|$)"),
    ("RTGS", r"(^|[/|\s])rtgs(\b|[/|\s]|$)"),
    ("IMPS", r"(^|[/|\s])imps(\b|[/|\s]|$)"),
    ("CHEQUE", r"\b(chq|cheque|check)\b"),
    ("CASH", r"\b(cash|atm|withdrawal)\b"),
    ("CARD", r"\b(pos|debit card|credit card|card)\b"),
]

# Ledger keyword classes, first match wins in this order.
LEDGER_PATTERNS = [
    ("Food Expenses", r"\b(swiggy|zomato|restaurant|food)\b"),
    ("Online Purchases", r"\b(amazon|flipkart|myntra)\b"),
    ("Salary", r"\b(salary|payroll|wages)\b"),
    ("Rent", r"\b(rent)\b"),
    ("Fuel Expenses", r"\b(fuel|petrol|diesel)\b"),
    ("Utilities", r"\b(electricity|water|broadband|mobile|recharge)\b"),
    ("Cash", r"\b(atm|cash withdrawal)\b"),
]

# Words that never name a counterparty.
NOISE_WORDS = ["upi", "neft", "rtgs", "imps", "pos", "chq", "cheque", "ref", "txn", "payment", "transfer"]

# Noise removed from narrations.
REFERENCE_CODE = r"\b(ref|txn|utr|rrn)[:\-\s]*[a-z0-9\-]+\b"
LONG_NUMBER = r"\b\d{6,}\b"
NOT_KEPT = r"[^a-zA-Z0-9&.\-\s]"
NAME_TOKEN = r"[A-Za-z][A-Za-z0-9&.\-]+"

GENERIC_LEDGERS = ["Expenses", "Receipts"]


def title_case(text: Column) -> Column:
    """Capital first letter for each run of ASCII letters, the rest lower ("a-b" becomes "A-B").

    `initcap` only sees blanks as word ends, so a marked blank is put before every letter run and taken out again.
    """
    marked = F.regexp_replace(text, r"(?<=[^A-Za-z ])(?=[A-Za-z])", "\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def non_empty(value: Column) -> Column:
    """The value, null where it is empty. Unlike `nullif` it holds the value's expression once, however long that is."""
    return F.get(F.filter(F.array(value), lambda v: v != ""), F.lit(0))


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_narration(narration: Column) -> Column:
    text = F.translate(narration, "/", " ")
    text = F.regexp_replace(text, "(?i)" + REFERENCE_CODE, " ")
    text = F.regexp_replace(text, LONG_NUMBER, " ")
    text = squeeze(F.regexp_replace(text, NOT_KEPT, " "))
    return F.coalesce(non_empty(title_case(text)), F.trim(narration))


def first_match(lowered: Column, patterns: list[tuple[str, str]]) -> Column:
    """Name of the first pattern found. The patterns are lower case, and lower-casing once beats ignoring case in each."""
    label = F.when(lowered.rlike(patterns[0][1]), patterns[0][0])
    for name, pattern in patterns[1:]:
        label = label.when(lowered.rlike(pattern), name)
    return label


def payment_mode(lowered: Column) -> Column:
    return first_match(lowered, MODE_PATTERNS)


def counterparty(cleaned: Column) -> Column:
    tokens = F.filter(
        F.regexp_extract_all(cleaned, F.lit(NAME_TOKEN), F.lit(0)),
        lambda t: (F.length(t) > 2) & ~F.lower(t).isin(NOISE_WORDS),
    )
    return non_empty(title_case(F.array_join(F.slice(tokens, 1, 4), " ")))


def ledger_hint(lowered: Column, debit: Column, credit: Column) -> Column:
    return F.coalesce(
        first_match(lowered, LEDGER_PATTERNS),
        F.when(credit.isNotNull() & debit.isNull(), "Receipts"),
        F.when(debit.isNotNull() & credit.isNull(), "Expenses"),
    )


def confidence(narration: Column, cleaned: Column, mode: Column, party: Column, ledger: Column) -> Column:
    """Score between 0.100 and 0.950, built from the quality of the other four results."""

    def points(value: str) -> Column:
        return F.lit(value).cast("decimal(4,3)")

    mode_points = F.when(mode.isNotNull(), points("0.20")).otherwise(points("-0.10"))
    ledger_points = (
        F.when(ledger.isNull(), points("-0.05")).when(ledger.isin(GENERIC_LEDGERS), points("0.05")).otherwise(points("0.20"))
    )
    shrink = F.length(cleaned) / F.greatest(F.length(narration), F.lit(1))
    clean_points = (
        F.when(F.length(F.trim(cleaned)) > 5, F.when(shrink < 0.85, points("0.10")).otherwise(points("0.05")))
        .otherwise(points("0"))
    )
    party_points = F.when(F.length(F.trim(party)) > 2, points("0.05")).otherwise(points("0"))
    words = F.size(F.split(F.trim(narration), r"[\s/|]+"))
    short_points = F.when(words <= 2, points("-0.10")).otherwise(points("0"))
    score = points("0.40") + mode_points + ledger_points + clean_points + party_points + short_points
    return F.least(F.greatest(score, points("0.10")), points("0.95")).cast("decimal(4,3)")


def pattern_key(text: Column) -> Column:
    """Lower-case letters and digits, every other run as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def mapping_text(cleaned: Column, narration: Column) -> Column:
    """The text a mapping is learnt from: the cleaned narration when there is one."""
    return F.coalesce(non_empty(cleaned), narration)


def mapping_pattern(df: DataFrame) -> Column:
    """Pattern key that mappings of `df` go by: of `narration_clean` where the row has one, else of `narration`."""
    narration = F.col("narration")
    return pattern_key(mapping_text(F.col("narration_clean"), narration) if "narration_clean" in df.columns else narration)


def with_pattern(df: DataFrame, name: str = "pattern") -> DataFrame:
    """`df` with its `mapping_pattern`, rows with an empty one left out. A generator is not merged with what stands above it, so the
    text is cleaned once per row, not once for each use and filter."""
    return df.withColumn(name, F.explode(F.filter(F.array(mapping_pattern(df)), lambda p: p != "")))
