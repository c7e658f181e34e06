"""From ragged cell rows to typed transactions.

Input everywhere: statement_id, bank_code, row_idx, cells array<string> (other columns pass through where noted).
Header search looks only at a bounded number of first rows per statement; everything after it works on single rows, plus
one ordered pass per statement for continuation rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vouchline.functions.text import squeeze
from vouchline.functions.values import normalize_header, parse_amount, parse_date, parse_plain_amount, parse_us_date_last
from vouchline.skew import block, hot_keys, ordered
from vouchline.sources.templates import with_template

ROLES = ["date", "value_date", "narration", "reference", "debit", "credit", "balance"]
HEADER_ROWS = 15
HEADER_MATCHES = 3
SAMPLE_ROWS = 20

# Header words per column role.
ALIASES = {
    "date": ["date", "txn date", "transaction date", "transaction dt"],
    "value_date": ["value date", "value dt", "val date"],
    "narration": ["narration", "description", "transaction remarks", "remarks", "particulars"],
    "reference": ["ref", "reference", "reference no", "chq ref no", "cheque number", "chq num", "chq no"],
    "debit": ["debit", "withdrawal", "withdrawal amt", "withdrawal amount"],
    "credit": ["credit", "deposit", "deposit amt", "deposit amount"],
    "balance": ["balance", "closing balance"],
}

# Cell texts that count as blank.
BLANK_WORDS = ["nan", "none", "null"]

# A transaction line in free text, and the words that decide its side.
LINE_DATE = r"(\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b\d{4}-\d{1,2}-\d{1,2}\b)"
LINE_AMOUNT = r"(-?\(?\d[\d,]*(?:\.\d{1,2})?\)?)"
TEXT_LINE = LINE_DATE + r"\s+(.+?)\s+" + LINE_AMOUNT + r"(?:\s+" + LINE_AMOUNT + r")?$"
CREDIT_WORDS = r"(?iU)\b(cr|credit|received|deposit|refund|salary)\b"
DEBIT_WORDS = r"(?iU)\b(dr|debit|paid|payment|withdrawal|purchase|to)\b"

# Cell patterns for statements without a header.
CELL_DATE = (
    r"(?i)^\s*\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\s*$|^\s*\d{4}-\d{1,2}-\d{1,2}\s*$|"
    r"^\s*\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{2,4}\s*$"
)
CELL_AMOUNT = r"(?i)^\s*-?\(?[\d,]+(?:\.\d{1,2})?\)?\s*(?:Cr|Dr)?\s*$"


def normalize_rows(rows: DataFrame) -> DataFrame:
    """Trim cells, null becomes '', rows without any text are dropped."""
    trimmed = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    return rows.withColumn("cells", trimmed).filter(F.exists("cells", lambda c: c != ""))


def cell(index: Column, cells: Column | str = "cells") -> Column:
    """Trimmed cell at an index; missing, negative or out of range gives ''."""
    return F.coalesce(F.trim(F.get(cells, index)), F.lit(""))


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows per statement as one array; the limit applies before the shuffle too."""
    place = F.row_number().over(W.partitionBy("statement_id").orderBy("row_idx"))
    return (
        rows.withColumn("_n", place).filter(F.col("_n") <= n)
        .groupBy("statement_id", "bank_code")
        .agg(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))).alias("first_rows"))
    )


def template_matches(headers: Column, expected: Column) -> Column:
    """How many expected headers appear as an exact cell; repeated expectations count twice."""
    return F.size(F.filter(expected, lambda h: F.array_contains(headers, h)))


def alias_positions(headers: Column) -> Column:
    """Role struct: first column whose header contains one of the role's aliases, else -1."""
    def position(role: str) -> Column:
        # An alias that contains another one of the same role can never decide.
        shortest = [a for a in ALIASES[role] if not any(o != a and o in a for o in ALIASES[role])]

        def has_alias(h: Column) -> Column:
            found = F.contains(h, F.lit(shortest[0]))
            for alias in shortest[1:]:
                found = found | F.contains(h, F.lit(alias))
            return found

        return (F.array_position(F.transform(headers, has_alias), True) - 1).cast("int").alias(role)

    return F.struct(*[position(r) for r in ROLES])


def template_positions(columns: Column) -> Column:
    return F.struct(*[F.try_element_at(columns, F.lit(r)).alias(r) for r in ROLES])


def detect_headers(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Header row and column roles per statement.

    Row by row, a template match counts before an alias match; without any match the template's positions apply with the
    first row as header. `header_idx` is null when nothing fits. `starts_split` tells that the first data row is a
    continuation, which shifts the row numbers by one.
    """
    prepared = templates.withColumn("expected", F.transform("headers", normalize_header))
    head = with_template(first_rows(rows, HEADER_ROWS + 1), prepared)
    no_headers = F.array().cast("array<string>")
    looked = F.transform(
        F.slice("first_rows", 1, HEADER_ROWS),
        lambda r: F.struct(r.row_idx.alias("row_idx"), F.transform(r.cells, normalize_header).alias("headers")),
    )
    judged = head.withColumns({"_looked": looked, "_expected": F.coalesce("template.expected", no_headers)}).withColumn(
        "_judged",
        F.transform(
            "_looked",
            lambda r: F.struct(
                r.row_idx.alias("row_idx"),
                (template_matches(r.headers, F.col("_expected")) >= HEADER_MATCHES).alias("by_template"),
                alias_positions(r.headers).alias("aliases"),
            ),
        ),
    )
    hit = F.get(F.filter("_judged", lambda r: r.by_template | ((r.aliases.date >= 0) & (r.aliases.narration >= 0))), 0)
    known = F.col("template").isNotNull() & (F.size(F.map_keys("template.columns")) > 0)
    positions = template_positions(F.col("template.columns"))
    by_alias = F.struct(*[F.when(F.col(f"_hit.aliases.{r}") >= 0, F.col(f"_hit.aliases.{r}")).alias(r) for r in ROLES])
    found = judged.withColumn("_hit", hit).select(
        "statement_id", "bank_code", "first_rows",
        F.coalesce("_hit.row_idx", F.when(known, F.get("first_rows", F.lit(0)).row_idx)).alias("header_idx"),
        F.when(F.col("_hit.by_template"), positions).when(F.col("_hit").isNotNull(), by_alias)
        .when(known, positions).alias("roles"),
        F.when(F.col("_hit.by_template"), "template").when(F.col("_hit").isNotNull(), "alias")
        .when(known, "positions").otherwise("none").alias("found_by"), F.col("template.date_format").alias("date_format"),
    )
    first_data = F.get(F.filter("first_rows", lambda r: r.row_idx > F.col("header_idx")), 0)
    texts = {r: F.col(f"_texts.{r}") for r in ROLES}
    return (
        found.withColumn("_first", first_data)
        .withColumn("_texts", F.struct(*[_shown(cell(F.col(f"roles.{r}"), F.col("_first.cells"))).alias(r) for r in ROLES]))
        .withColumn("starts_split", F.coalesce(is_continuation(texts), F.lit(False)))
        .drop("_first", "_texts", "first_rows")
    )


def _shown(text: Column) -> Column:
    return F.when(F.lower(text).isin(BLANK_WORDS), "").otherwise(text)


def is_continuation(texts: dict[str, Column]) -> Column:
    """Narration present while date, amounts and balance are blank."""
    rest = texts["narration"] != ""
    for role in ["date", "value_date", "debit", "credit", "balance"]:
        rest = rest & (texts[role] == "")
    return rest


def role_texts(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Data rows below the header with one text column per role; from here on the cell arrays are no longer needed."""
    data = rows.drop("bank_code").join(headers.filter("header_idx is not null"), "statement_id").filter("row_idx > header_idx")
    extra = [*(["row_confidence"] if "row_confidence" in rows.columns else []), *(["date_format"] if "date_format" in headers.columns else [])]
    kept = ["statement_id", "bank_code", "row_idx", *extra, "starts_split"]
    return data.select(*kept, *[cell(F.col(f"roles.{r}")).alias(r) for r in ROLES]).select(*kept, *[_shown(F.col(r)).alias(r) for r in ROLES])


def merge_continuations(rows: DataFrame, headers: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Data rows with continuation text joined to the row above.

    Adds row_number, which counts rows that are rejected later too. One ordered pass numbers the opening rows; the number
    is the group key of the merge, whose partial aggregation runs before the shuffle.
    """
    opens = F.when(is_continuation({r: F.col(r) for r in ROLES}), 0).otherwise(1)
    marked = role_texts(rows, headers).withColumns({"_opens": opens, "_shift": F.col("starts_split").cast("int")}).drop("starts_split")
    numbered = ordered(
        marked, ["statement_id"], ["row_idx"], split=block("row_idx"), running={"_group": ("sum", F.col("_opens"))},
        hot=hot_keys(rows, ["statement_id"]) if hot is None else hot,
    )
    first = [c for c in marked.columns if c not in ("statement_id", "narration", "_opens", "_shift")]
    merged = numbered.groupBy("statement_id", (F.col("_group") + F.col("_shift")).cast("long").alias("row_number")).agg(
        F.min_by(F.struct(*first), "row_idx").alias("_f"),
        F.array_sort(F.collect_list(F.struct("row_idx", "narration"))).alias("_parts"),
    )
    texts = F.filter(F.transform("_parts", lambda p: p["narration"]), lambda t: t != "")
    return merged.select("statement_id", "_f.*", "row_number", F.array_join(texts, " ").alias("narration"))


def typed_rows(merged: DataFrame) -> DataFrame:
    """Typed candidate rows, accepted or not; `accepted` needs a date and a narration. A template's own date format is tried first."""
    own = F.col("date_format") if "date_format" in merged.columns else None
    extra = [F.col("row_confidence").alias("ocr_confidence")] if "row_confidence" in merged.columns else []
    typed = merged.select(
        "statement_id", "bank_code", "row_number", "row_idx", parse_date(F.col("date"), own=own).alias("txn_date"),
        parse_date(F.col("value_date"), own=own).alias("value_date"), "narration", F.nullif(F.col("reference"), F.lit("")).alias("reference_no"),
        *[parse_amount(F.col(c)).alias(c) for c in ["debit", "credit", "balance"]], *extra,
    )
    return typed.withColumn("accepted", F.col("txn_date").isNotNull() & (F.col("narration") != ""))


def parse_statements(rows: DataFrame, templates: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """The whole chain: raw cell rows of any number of statements to typed transactions."""
    clean = normalize_rows(rows)
    headers = detect_headers(clean, templates)
    return typed_rows(merge_continuations(clean, headers, hot)).filter("accepted").drop("accepted", "row_idx")


def outcomes(statements: DataFrame, parsed: DataFrame) -> DataFrame:
    """Row count, parser kind, status and error text per statement. PDFs without rows stay reviewable."""
    counts = parsed.groupBy("statement_id").agg(F.count(F.lit(1)).alias("row_count"))
    none, kind = F.col("row_count") == 0, F.col("file_type")
    supported = kind.isin("csv", "pdf", "xlsx", "xls")
    return (
        statements.join(counts, "statement_id", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))
        .withColumns({
            "parser": F.when(kind == "csv", "csv").when(kind.isin("xlsx", "xls"), "excel").when(kind == "pdf", "pdf"),
            "status": F.when(~none & supported, "READY_FOR_REVIEW").when(none & (kind == "pdf"), "READY_FOR_REVIEW").otherwise("FAILED"),
            "error_message": F.when(~supported, F.concat(F.lit("Unsupported statement format '"), kind, F.lit("'.")))
            .when(none, "The file was read but no transaction rows matched."),
        })
    )


def unparsed_only(rows: DataFrame, transactions: DataFrame) -> DataFrame:
    """Rows of statements that have no transactions yet, so a second run adds nothing."""
    return rows.join(transactions.select("statement_id").distinct(), "statement_id", "left_anti")


# ---------------------------------------------------------------- free text lines


def parse_text_lines(lines: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Transactions out of text lines (statement_id, line_no, line); numbering is dense per statement."""
    # One pass of the pattern: a matching line is rewritten to its four parts around a mark, any other stays as it is.
    parts = F.regexp_replace(squeeze(F.col("line")), rf"^.*?{TEXT_LINE}", "$1\u0001$2\u0001$3\u0001$4")
    found = (
        lines.select("statement_id", "line_no", F.split(parts, "\u0001").alias("_p")).filter(F.size("_p") == 4)
        .select(
            "statement_id", "line_no", parse_date(F.get("_p", F.lit(0))).alias("txn_date"), F.trim(F.get("_p", F.lit(1))).alias("narration"),
            parse_amount(F.get("_p", F.lit(2))).alias("_amount"), parse_amount(F.get("_p", F.lit(3))).alias("balance"),
        )
        .filter("txn_date is not null and _amount is not null")
    )
    credit = is_credit(F.col("narration"))
    sided = found.withColumns(
        {"debit": F.when(~credit, F.col("_amount")), "credit": F.when(credit, F.col("_amount"))}
    ).drop("_amount")
    return ordered(
        sided, ["statement_id"], ["line_no"], split=block("line_no"), running={"row_number": ("sum", F.lit(1))}, hot=hot
    ).withColumn("row_number", F.col("row_number").cast("long"))


def is_credit(body: Column) -> Column:
    """Credit only with a credit word and no debit word; debit is the default."""
    return body.rlike(CREDIT_WORDS) & ~body.rlike(DEBIT_WORDS)


# ---------------------------------------------------------------- statements without a usable header

# Header keywords and weights of the heuristic parser.
SCORED_ROLES = {
    "date": (["date", "dt", "day", "posted"], 20, 40),
    "narration": (["narration", "description", "ref", "detail", "memo"], 15, 50),
    "debit": (["debit", "withdrawal", "payment", "spent", "dr.", "dr", "out"], 15, 50),
    "credit": (["credit", "deposit", "received", "income", "cr.", "cr", "in"], 15, 50),
    "balance": (["balance", "closing", "running", "bal"], 15, 50),
}
SCORED_DATES = [r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"\d{4}[/-]\d{1,2}[/-]\d{1,2}"]


def score_columns(rows: DataFrame, sample: int = 10) -> DataFrame:
    """Column roles by header words and by the first values below the header (first row = header).

    One row per statement and role: position, score and confidence; the leftmost column wins equal scores. Only the first
    eleven rows of a statement are looked at.
    """
    head = first_rows(rows, sample + 1).withColumn("_header", F.get("first_rows", F.lit(0)).cells)
    cells = head.select(
        "statement_id", F.posexplode("_header").alias("pos", "name"), F.slice("first_rows", 2, sample).alias("_rows")
    ).withColumn("values", F.filter(F.transform("_rows", lambda r: F.get(r.cells, F.col("pos"))), lambda v: v.isNotNull()))
    counted = F.greatest(F.size("values"), F.lit(1))
    numeric = F.size(F.filter("values", lambda v: F.regexp_replace(F.trim(v), "[,₹]", "").try_cast("double").isNotNull())) / counted
    first, second = SCORED_DATES
    date_hits = F.size(F.filter("values", lambda v: v.rlike(first))) + F.size(F.filter("values", lambda v: v.rlike(second)))
    text_length = F.aggregate("values", F.lit(0), lambda acc, v: acc + F.length(v)) / counted
    evidence = {
        "date": date_hits * 10, "narration": F.when(text_length > 15, 20).otherwise(0),
        "debit": F.when(numeric > 0.7, 20).otherwise(0), "credit": F.when(numeric > 0.7, 20).otherwise(0),
        "balance": F.when(numeric > 0.9, 20).otherwise(0),
    }
    scored = []
    for role, (words, least, full) in SCORED_ROLES.items():
        named = F.lit(False)
        for word in words:
            named = named | F.contains(F.lower("name"), F.lit(word))
        scored.append(F.struct(F.lit(role).alias("role"), (F.when(named, 30).otherwise(0) + evidence[role]).alias("score"),
                               F.lit(least).alias("least"), F.lit(full).alias("full")))
    long = cells.select("statement_id", "pos", F.explode(F.array(*scored)).alias("s")).select("statement_id", "pos", "s.*")
    best = long.groupBy("statement_id", "role").agg(
        F.max_by(F.struct("pos", "score", "least", "full"), F.struct(F.col("score"), -F.col("pos"))).alias("b")
    )
    return best.filter("b.score > b.least").select(
        "statement_id", "role", "b.pos", "b.score", F.bround(F.col("b.score") / F.col("b.full"), 2).alias("confidence")
    )


def extract_scored(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """Transactions by the scored columns; a row is kept when it has a date or a narration column."""
    roles = scored.groupBy("statement_id").agg(
        F.map_from_entries(F.collect_list(F.struct("role", "pos"))).alias("roles"),
        # The mean of whole hundredths, in thousandths: exact, so that halves round the same way everywhere.
        (F.bround(F.sum(F.bround(F.col("confidence") * 100, 0).cast("long")) * 10 / F.count(F.lit(1)), 0) / 1000).alias("parser_confidence"),
    )
    header = rows.groupBy("statement_id").agg(F.min("row_idx").alias("_header"))
    data = rows.join(roles.join(header, "statement_id"), "statement_id").filter("row_idx > _header")

    def at(role: str) -> Column:
        return F.get("cells", F.try_element_at("roles", F.lit(role)))

    amounts = {c: F.nullif(parse_plain_amount(at(c)), F.lit(0).cast("decimal(18,2)")) for c in ["debit", "credit", "balance"]}
    return data.select(
        "statement_id", "row_idx", parse_us_date_last(at("date")).alias("txn_date"), F.trim(at("narration")).alias("narration"),
        *[v.alias(k) for k, v in amounts.items()], "parser_confidence",
    ).filter("txn_date is not null or narration is not null")


def pattern_roles(rows: DataFrame) -> DataFrame:
    """Column roles from cell patterns in rows 2 to 21 of each statement: date, debit, credit, balance, narration."""
    head = first_rows(rows, SAMPLE_ROWS + 1)
    looked = F.when(F.size("first_rows") > 1, F.slice("first_rows", 2, SAMPLE_ROWS)).otherwise(F.col("first_rows"))
    cells = (
        head.withColumn("_width", F.array_max(F.transform("first_rows", lambda r: F.size(r.cells))))
        .select("statement_id", "_width", F.explode(looked).alias("r"))
        .select("statement_id", "_width", F.posexplode("r.cells").alias("pos", "value"))
        .withColumn("value", F.trim("value")).filter("value <> '' and _width >= 2")
    )
    dated, amount = F.col("value").rlike(CELL_DATE), F.col("value").rlike(CELL_AMOUNT)
    columns = cells.groupBy("statement_id", "pos").agg(
        F.count_if(dated).alias("dates"), F.count_if(amount).alias("amounts"),
        F.sum(F.when(~dated & ~amount, F.length("value")).otherwise(0)).alias("letters"),
    )
    packed = columns.groupBy("statement_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "dates", "amounts", "letters"))).alias("c")
    )
    most = F.array_max(F.transform("c", lambda x: x.dates))
    date = F.when(most > 0, F.get(F.filter("c", lambda x: x.dates == most), 0).pos)
    named = packed.withColumn("date", date).withColumn(
        "_a", F.transform(F.filter("c", lambda x: (x.amounts > 0) & ~x.pos.eqNullSafe(F.col("date"))), lambda x: x.pos)
    ).withColumn("_n", F.size("_a"))
    named = named.select(
        "statement_id", "date", "c",
        F.when(F.col("_n") >= 3, F.get("_a", F.col("_n") - 3)).otherwise(F.get("_a", F.lit(0))).alias("debit"),
        F.when(F.col("_n") >= 3, F.get("_a", F.col("_n") - 2)).otherwise(F.get("_a", F.lit(1))).alias("credit"),
        F.when(F.col("_n") >= 3, F.get("_a", F.col("_n") - 1)).alias("balance"),
    )
    used = F.array("date", "debit", "credit", "balance")
    free = F.filter("c", lambda x: (x.letters > 0) & ~F.coalesce(F.array_contains(F.array_compact(used), x.pos), F.lit(False)))
    longest = F.array_max(F.transform(free, lambda x: F.struct(x.letters.alias("letters"), (-x.pos).alias("back"))))
    return named.withColumn("narration", (-longest.back).cast("int")).drop("c")


def extract_by_pattern(rows: DataFrame, roles: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Transactions by pattern roles; without a date or narration there, any cell that reads as a date and the longest
    text that is not an amount. Numbering is dense."""
    data = rows.filter(F.size("cells") >= 2).join(roles, "statement_id")

    def own(role: str) -> Column:
        return F.coalesce(F.get("cells", F.col(role)), F.lit(""))

    any_date = F.get(F.filter(F.transform("cells", lambda c: parse_date(c)), lambda d: d.isNotNull()), 0)
    candidates = F.transform("cells", lambda c, i: F.struct(
        F.when((i != F.coalesce("date", F.lit(-1))) & (F.coalesce(parse_amount(c), F.lit(0)) == 0), F.length(c)).otherwise(0).alias("n"), (-i).alias("back"), c.alias("text"),
    ))
    longest = F.array_max(candidates)
    read = data.select(
        "statement_id", "row_idx", F.coalesce(parse_date(own("date")), any_date).alias("txn_date"),
        F.when(own("narration") != "", own("narration")).when(longest.n > 0, longest.text).otherwise("").alias("narration"),
        *[parse_amount(own(c)).alias(c) for c in ["debit", "credit", "balance"]],
        *(["row_confidence"] if "row_confidence" in rows.columns else []),
    ).filter("txn_date is not null")
    return ordered(
        read, ["statement_id"], ["row_idx"], split=block("row_idx"), running={"row_number": ("sum", F.lit(1))}, hot=hot
    ).withColumn("row_number", F.col("row_number").cast("long"))
