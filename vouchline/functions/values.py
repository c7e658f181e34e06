"""Reading dates and amounts from statement cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Month names by number.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]

# Letters a recogniser confuses with digits.
CONFUSED_LETTERS = "OoIliSsZz"
MEANT_DIGITS = "001115522"


def _calendar_date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, month, day).try_cast("date")


def _numeric_date(text: Column) -> Column:
    """Day first with / or -, or ISO. Two-digit years 69..99 belong to the last century, 00..68 to this one.

    One test decides, then the text is turned into ISO form: cheaper than taking the parts out one by one.
    """
    day_first, iso = r"(\d{1,2})([/\-])(\d{1,2})\2", r"\d{4}-\d{1,2}-\d{1,2}"
    turned = F.regexp_replace(text, rf"^{day_first}(\d{{4}})$", "$4-$3-$1")
    turned = F.regexp_replace(turned, rf"^{day_first}(69|[7-9]\d)$", "19$4-$3-$1")
    turned = F.regexp_replace(turned, rf"^{day_first}(\d\d)$", "20$4-$3-$1")
    return F.when(text.rlike(rf"^(?:{day_first}(?:\d{{4}}|\d\d)|{iso})$"), turned.try_cast("date"))


def _month_number(word: Column) -> Column:
    names = {name: number for number, month in enumerate(MONTHS, 1) for name in (month, month[:3])}
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(lookup, F.lower(word))


def _word_date(text: Column) -> Column:
    form = r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$"
    return F.when(
        text.rlike(form),
        _calendar_date(
            F.regexp_extract(text, form, 3),
            _month_number(F.regexp_extract(text, form, 2)).cast("string"),
            F.regexp_extract(text, form, 1),
        ),
    )


# Date formats that the usual reading covers, and what the marks of a format mean in Spark.
USUAL_FORMATS = ["%d/%m/%y", "%d/%m/%Y", "%Y-%m-%d", "%d-%m-%Y", "%d-%m-%y", "%d %b %Y", "%d %B %Y"]
FORMAT_MARKS = [("%d", "d"), ("%m", "M"), ("%Y", "yyyy"), ("%y", "yy"), ("%b", "MMM"), ("%B", "MMMM")]


def _strict_date(text: Column, extra_formats: tuple[str, ...]) -> Column:
    return F.coalesce(_numeric_date(text), _word_date(text), *[F.try_to_date(text, fmt) for fmt in extra_formats])


def repair_date(text: Column, extra_formats: tuple[str, ...] = ()) -> Column:
    """Second attempt for recogniser output: loose blanks, mixed separators, letters in place of digits."""
    tight = F.regexp_replace(F.trim(text), r"\s*([/\-.])\s*", "$1")
    digits = F.translate(F.regexp_replace(tight, r"\s+", ""), CONFUSED_LETTERS, MEANT_DIGITS)
    numeric = _numeric_date(F.translate(digits, "/.", "--"))
    spaced = F.translate(F.regexp_replace(tight, r"\s+", " "), CONFUSED_LETTERS, MEANT_DIGITS)
    words = F.transform(
        F.split(F.trim(tight), r"\s+"),
        lambda w: F.when(
            w.rlike(r"^[0-9OolIiSsZz/.\-]+$"), F.translate(w, CONFUSED_LETTERS, MEANT_DIGITS)
        ).otherwise(w),
    )
    extra = [F.try_to_date(spaced if " " in fmt else digits, fmt) for fmt in extra_formats]
    return F.coalesce(numeric, _word_date(F.array_join(words, " ")), *extra)


def configured_date(text: Column, form: Column) -> Column:
    """Date by a template's own format, in the notation of the catalogue (`%m/%d/%Y`); null where the usual reading does the same."""
    pattern = form
    for mark, letters in FORMAT_MARKS:
        pattern = F.replace(pattern, F.lit(mark), F.lit(letters))
    return F.when(~form.isin(USUAL_FORMATS), F.call_function("try_to_timestamp", text, pattern).cast("date"))


def parse_date(text: Column, extra_formats: tuple[str, ...] = (), own: Column | None = None) -> Column:
    """Date of a cell: by the template's `own` format, then day/month/year with / or -, ISO, or day month-word year; then the repaired
    reading. `extra_formats` takes further Spark patterns.
    """
    cleaned = F.trim(text)
    first = [] if own is None else [configured_date(cleaned, own)]
    return F.when(
        cleaned != "", F.coalesce(*first, _strict_date(cleaned, extra_formats), repair_date(cleaned, extra_formats))
    )


def parse_us_date_last(text: Column) -> Column:
    """The heuristic parser's reading: day first, ISO, and month/day/year only when nothing else fits."""
    cleaned = F.trim(text)
    form = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    month_first = F.when(
        cleaned.rlike(form),
        _calendar_date(
            F.regexp_extract(cleaned, form, 3), F.regexp_extract(cleaned, form, 1), F.regexp_extract(cleaned, form, 2)
        ),
    )
    return F.coalesce(_numeric_date(cleaned), month_first)


def parse_amount(text: Column) -> Column:
    """Amount of a cell; thousands commas, currency and Cr/Dr marks are dropped, brackets mean negative."""
    cleaned = F.trim(text)
    number = F.regexp_replace(cleaned, r"[^0-9.\-]", "").try_cast("decimal(18,2)")
    return F.when(cleaned.startswith("(") & cleaned.endswith(")"), -number).otherwise(number)


def parse_plain_amount(text: Column) -> Column:
    """The heuristic parser's reading: only currency signs, commas and outer blanks are dropped."""
    return F.trim(F.regexp_replace(F.trim(text), r"[₹$,]", "")).try_cast("decimal(18,2)")


def normalize_header(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))
