"""Bank-statement tables derived from the generic test tables (orders, customer, nation, events, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vouchline.functions.text import clean_narration
from vouchline.skew import hot_keys, ordered
from vouchline.sources.readers import spread_small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bank_of(statement_id: Column) -> Column:
    kind = statement_id % 4
    return F.when(kind == 0, "hdfc").when(kind == 1, "icici").when(kind == 2, "sbi").otherwise("axis")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement per customer; client = nation, firm = region."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    status = (
        F.when(key % 10 == 0, "FAILED").when(key % 10 < 4, "REVIEWED").when(key % 10 < 6, "EXPORTED")
        .when(key % 10 == 6, "UPLOADED").otherwise("READY_FOR_REVIEW")
    )
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        key.alias("statement_id"),
        F.col("c_nationkey").alias("client_id"),
        F.col("n_regionkey").alias("firm_id"),
        bank_of(key).alias("bank_code"),
        status.alias("status"),
        F.lpad(key.cast("string"), 11, "7").alias("account_number"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 60).cast("int")).alias("created_on"),
        F.concat(F.lower("c_name"), F.when(key % 7 == 0, ".PDF").when(key % 7 == 1, ".xlsx").when(key % 7 == 2, ".jpeg")
                 .when(key % 7 == 3, ".docx").when(key % 7 == 4, "").otherwise(".csv")).alias("file_name"),
    )


def long_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot statements, counted on the order table that everything per statement comes from."""
    return hot_keys(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("statement_id")), ["statement_id"])


def _flat(orders: DataFrame) -> DataFrame:
    """Transactions without client and without row order: a projection of `orders`."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    kind = key % 8
    narration = (
        F.when(kind == 0, F.concat(F.lit("UPI/SWIGGY/PAYMENT/"), (900000000 + key).cast("string")))
        .when(kind == 1, "NEFT-SALARY-EMPLOYER INC")
        .when(kind == 2, F.concat(F.lit("UPI/AMAZON/SHOPPING/"), key.cast("string")))
        .when(kind == 3, "ATM-CASH WITHDRAWAL-MUMBAI")
        .when(kind == 4, F.concat(F.lit("IMPS/PARTY "), (cust % 50).cast("string"), F.lit("/TRANSFER")))
        .when(kind == 5, "NEFT-RENT PAYMENT-OWNER")
        .when(kind == 6, F.concat(F.lit("POS/BIGBASKET/GROCERIES REF:"), key.cast("string")))
        .otherwise("TFR")
    )
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    confirmed = F.when(
        F.col("o_orderpriority") == "1-URGENT",
        F.when(kind == 0, "Staff Welfare").when(kind == 1, "Salary").when(kind == 5, "Rent").otherwise("Sundry"),
    )
    return orders.select(
        key.alias("id"),
        cust.alias("statement_id"),
        bank_of(cust).alias("bank_code"),
        F.col("o_orderdate").cast("date").alias("txn_date"),
        narration.alias("narration"),
        F.when(F.col("o_orderstatus") != "F", amount).alias("debit"),
        F.when(F.col("o_orderstatus") == "F", amount).alias("credit"),
        confirmed.alias("confirmed_ledger"),
        (key % 17 == 0).alias("is_ignored"),
        F.when(key % 5 == 0, ((key % 100).cast("decimal(6,3)") / 100).cast("decimal(4,3)")).alias("ocr_confidence"),
    )


def transactions(spark: SparkSession, sf_dir: str, numbered: bool = False, clients: bool = True, spread: bool = False) -> DataFrame:
    """Transactions; `numbered` adds `row_number` and `balance` (one ordered pass), `clients` the tenant columns.

    `spread` is for costly projections: it gives small tables as many tasks as there are cores.
    """
    orders = table(spark, sf_dir, "orders")
    rows = _flat(spread_small(orders) if spread else orders)
    if numbered:
        signed = F.coalesce(F.col("credit"), -F.col("debit"))
        rows = ordered(
            rows, ["statement_id"], ["txn_date", "id"], split=F.col("txn_date"),
            running={"row_number": ("sum", F.lit(1)), "_moved": ("sum", signed)}, hot=long_statements(spark, sf_dir),
        ).withColumns(
            {"row_number": F.col("row_number").cast("long"), "balance": (F.col("_moved") + 1000000).cast("decimal(18,2)")}
        ).drop("_moved")
    return with_clients(rows, spark, sf_dir) if clients else rows


def with_clients(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.join(statements(spark, sf_dir).select("statement_id", "client_id", "firm_id"), "statement_id")


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes: 30 banks, five changes per statement."""
    return event_columns(table(spark, sf_dir, "events"))


def event_columns(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.floor(F.col("event_id") / 5).alias("statement_id"),
        F.concat(F.lit("bank_"), (F.col("user_id") % 30).cast("string")).alias("bank_code"),
        F.when(kind == "error", "FAILED").when(kind == "view", "READY_FOR_REVIEW").when(kind == "click", "REVIEWED")
        .when(kind == "purchase", "EXPORTED").otherwise("UPLOADED").alias("status"),
    )


# Rule kinds and patterns; the sixth is an invalid regular expression on purpose.
RULE_FORMS = [
    ("contains", "swiggy"), ("startswith", "neft"), ("endswith", "owner"), ("exact", "tfr"),
    ("regex", r"party\s+\d+"), ("regex", "(unclosed"), ("contains", "BIGBASKET"), ("regex", "atm|cash"),
]
LEDGER_NAMES = ["Salary", "Rent", "STAFF WELFARE", "Travel"]


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narration rules from suppliers, unique per client, kind and pattern."""
    form = F.col("s_suppkey") % len(RULE_FORMS)
    kind, pattern = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (k, p) in enumerate(RULE_FORMS):
        kind, pattern = F.when(form == n, k).otherwise(kind), F.when(form == n, p).otherwise(pattern)
    rule_id = F.col("rule_id")
    return (
        table(spark, sf_dir, "supplier")
        .groupBy(F.col("s_nationkey").alias("client_id"), kind.alias("match_type"), pattern.alias("pattern"))
        .agg(F.min("s_suppkey").alias("rule_id"))
        .select(
            "client_id", "match_type", "pattern", "rule_id",
            F.concat(F.lit("Ledger "), (rule_id % 7).cast("string")).alias("ledger_name"),
            (rule_id % 5).cast("int").alias("priority"), (rule_id % 9 != 0).alias("is_active"),
            F.date_add(F.lit("2024-01-01").cast("date"), (rule_id % 3).cast("int")).cast("timestamp").alias("created_at"),
        )
    )


def cleaned(tx: DataFrame) -> DataFrame:
    """Transactions that an earlier run has enriched: with their cleaned narration."""
    return tx.withColumn("narration_clean", clean_narration(F.col("narration")))


def confirmed(tx: DataFrame) -> DataFrame:
    """Confirmed rows in the shape the ledger memory learns from."""
    return tx.filter("confirmed_ledger is not null").select(
        "client_id", "narration", clean_narration(F.col("narration")).alias("narration_clean"), F.col("confirmed_ledger").alias("ledger_name"),
        F.col("txn_date").alias("used_at"), F.col("id").alias("event_id"),
    )


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ledger names for each client whose key is not a multiple of five."""
    return table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0").select(
        F.col("n_nationkey").alias("client_id"), F.explode(F.array(*[F.lit(n) for n in LEDGER_NAMES])).alias("name")
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External answers for two thirds of the transactions, on up to three tiers. Some name an unknown ledger, most of those on all tiers but the last."""
    tx = transactions(spark, sf_dir, numbered=True).filter("id % 3 <> 0")
    pick = F.col("id") % 5
    ledger = (
        F.when((F.col("id") % 97 == 1) & ((F.col("tier") != 3) | (F.col("id") % 5 == 0)), "Moon").when(pick == 0, "salary").when(pick == 1, "RENT")
        .when(pick == 2, "Staff welfare").when(pick == 3, "Travel")
    )
    kind = F.col("statement_id") % 3
    tiers = F.when(kind == 0, F.array(F.lit(1), F.lit(3))).when(kind == 1, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(3)))
    return tx.select(
        "id", "statement_id", "client_id", F.floor((F.col("row_number") - 1) / 50).alias("batch_no"), F.explode(tiers).alias("tier"),
    ).withColumn("suggested_ledger", ledger).withColumns({
        "narration_clean": F.concat(F.lit("Answer "), F.col("id").cast("string")), "payment_mode": F.lit("UPI"),
        "counterparty": F.lit(None).cast("string"), "confidence": F.lit("0.880").cast("decimal(4,3)"),
        "source": F.when(F.col("tier") == 1, "claude").when(F.col("tier") == 2, "claude-fallback").otherwise("gpt4o-fallback"),
    })


def hashed(tx: DataFrame) -> DataFrame:
    from vouchline.operators.cache import content_hash

    return tx.withColumn("content_hash", content_hash(tx))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached answers for a quarter of the transactions' contents."""
    return cache_of(hashed(transactions(spark, sf_dir, numbered=True, clients=False)))


def cache_of(tx: DataFrame) -> DataFrame:
    return tx.filter("id % 4 = 0").groupBy("content_hash").agg(F.min("id").alias("first_id")).select(
        "content_hash", F.lit("anthropic").alias("provider"), F.lit("model-a").alias("model"),
        F.concat(F.lit("Cached "), F.col("first_id").cast("string")).alias("narration_clean"), F.lit("NEFT").alias("payment_mode"),
        F.lit(None).cast("string").alias("counterparty"), F.lit("Cached Ledger").alias("suggested_ledger"),
        F.lit("0.770").cast("decimal(4,3)").alias("confidence"), F.lit("claude").alias("source"), (F.col("first_id") % 3).alias("hit_count"),
        F.lit("2024-01-01").cast("date").alias("last_used_at"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage rows from events: tokens from the number in `props`, cache status from the kind of event."""
    kind = F.col("event_type")
    tokens = F.regexp_extract("props", r"(\d+)", 1).try_cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", F.floor(F.col("event_id") / 5).alias("statement_id"),
        F.when(kind == "view", "HIT").when(kind == "click", "MISS").otherwise("FALLBACK").alias("cache_status"),
        F.when(kind == "view", "claude").when(kind == "click", "gpt4o-fallback").when(kind == "error", "claude-fallback")
        .when(kind == "signup", "rule").otherwise("heuristic").alias("source"),
        tokens.alias("prompt_tokens"), (tokens * 2).alias("completion_tokens"),
    )


def raw_rows(spark: SparkSession, sf_dir: str, day_format: str | None = None) -> DataFrame:
    """Transactions rendered back to string cells in the order of each bank's template.

    Per statement: a title row, a blank row, the header, then up to three rows per transaction (itself, a continuation
    row for every fourth id, a blank row for every fifth), and a totals row at the end. `day_format` replaces the banks' own ways of
    writing a date.
    """
    tx = transactions(spark, sf_dir, numbered=True, clients=False)
    day = F.date_format("txn_date", day_format) if day_format else F.when(F.col("bank_code") == "hdfc", F.date_format("txn_date", "dd/MM/yy")).when(
        F.col("bank_code") == "axis", F.date_format("txn_date", "dd-MM-yyyy")).otherwise(F.date_format("txn_date", "dd/MM/yyyy"))
    ref = F.concat(F.lit("REF"), F.col("id").cast("string"))
    debit, credit = F.coalesce(F.col("debit").cast("string"), F.lit("")), F.coalesce(F.concat(F.col("credit").cast("string"), F.lit(" Cr")), F.lit(""))
    balance, no, blank = F.format_number("balance", 2), F.col("row_number").cast("string"), F.lit("")

    def lay(date: Column, text: Column, reference: Column, out: Column, into: Column, left: Column, number: Column) -> Column:
        bank = F.col("bank_code")
        return (
            F.when(bank == "hdfc", F.array(date, text, reference, date, out, into, left))
            .when(bank == "icici", F.array(number, date, date, reference, text, out, into, left))
            .when(bank == "sbi", F.array(date, date, text, reference, out, into, left))
            .otherwise(F.array(date, text, reference, out, into, left))
        )

    place = (F.col("row_number") - 1) * 3 + 3
    main = F.struct(place.alias("row_idx"), lay(day, F.col("narration"), ref, debit, credit, balance, no).alias("cells"))
    more = F.struct((place + 1).alias("row_idx"), lay(blank, F.concat(F.lit("MORE "), F.col("id").cast("string")), blank, blank, blank, blank, blank).alias("cells"))
    empty = F.struct((place + 2).alias("row_idx"), F.array(blank, F.lit(" ")).alias("cells"))
    parts = F.array_compact(F.array(main, F.when(F.col("id") % 4 == 0, more), F.when(F.col("id") % 5 == 0, empty)))
    body = tx.select("statement_id", "bank_code", F.explode(parts).alias("r")).select("statement_id", "bank_code", "r.*")

    from vouchline.sources.templates import BANKS

    header = F.lit(None).cast("array<string>")
    for bank in BANKS:
        if bank[0] in ("hdfc", "icici", "sbi", "axis"):
            header = F.when(F.col("bank_code") == bank[0], F.array(*[F.lit(h) for h in bank[5]])).otherwise(header)
    ends = tx.groupBy("statement_id", "bank_code").agg(F.max("row_number").alias("row_number"), F.max("balance").alias("balance"))
    total = lay(blank, F.lit("TOTAL"), blank, F.lit("1.00"), F.lit("2.00"), balance, blank)
    frame = F.array(
        F.struct(F.lit(0).cast("long").alias("row_idx"), F.array(F.lit("Statement of Account"), F.col("statement_id").cast("string")).alias("cells")),
        F.struct(F.lit(1).cast("long").alias("row_idx"), F.array(blank, blank).alias("cells")),
        F.struct(F.lit(2).cast("long").alias("row_idx"), header.alias("cells")),
        F.struct((place + 3).alias("row_idx"), total.alias("cells")),
    )
    return body.unionByName(ends.select("statement_id", "bank_code", F.explode(frame).alias("r")).select("statement_id", "bank_code", "r.*"))


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words with boxes, from line items: ten orders are one document of two pages."""
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 10).alias("doc_id"), (line % 2 + 1).alias("page"),
        F.concat(F.lit("w"), part.cast("string")).alias("text"), (F.col("l_quantity") / 50).alias("confidence"),
        ((part % 40) * 30).alias("x"), ((supp % 8) * 14 + line % 3).alias("y"), (part % 30 + 20).alias("w"), (supp % 5 + 10).alias("h"),
    )


def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table-analysis blocks: every order is one document with a table of two rows and two columns."""
    key = F.col("o_orderkey")
    kids = "array<struct<type:string,ids:array<string>>>"

    def block(name, kind, row, col, text, confidence, children) -> Column:
        ids = F.array(*[F.lit(c) for c in children]).cast("array<string>")
        relation = F.array(F.struct(F.lit("CHILD").alias("type"), ids.alias("ids"))) if children else F.lit(None)
        return F.struct(
            F.lit(name).alias("id"), F.lit(kind).alias("block_type"), F.when(key % 3 != 0, F.lit(2)).alias("page"),
            F.lit(row).cast("int").alias("row_index"), F.lit(col).cast("int").alias("column_index"), text.cast("string").alias("text"),
            confidence.cast("double").alias("confidence"), relation.cast(kids).alias("relationships"),
            F.struct(*[F.lit(v).cast("double").alias(n) for n, v in [("left", col or 0), ("top", row or 0), ("width", 0.5), ("height", 0.25)]]).alias("box"),
        )

    none = F.lit(None)
    sure = (key % 50 + 50)
    blocks = F.array(
        block("T", "TABLE", None, None, none, none, ["C11", "C12", "C21", "C22", "W1"]),
        block("C12", "CELL", 1, 2, none, sure, ["W2"]), block("C11", "CELL", 1, 1, none, sure + 1, ["W1"]),
        block("C21", "CELL", 2, 1, none, sure, ["W4", "W3"]), block("C22", "CELL", 2, 2, none, sure - 1, []),
        block("W1", "WORD", None, None, F.lit("Date"), sure, []), block("W2", "WORD", None, None, F.lit("Amount"), sure, []),
        block("W3", "WORD", None, None, F.col("o_orderpriority"), sure, []), block("W4", "WORD", None, None, key.cast("string"), sure, []),
    )
    return table(spark, sf_dir, "orders").select(key.alias("doc_id"), F.explode(blocks).alias("b")).select("doc_id", "b.*")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of five clients, with the label as ledger."""
    raw = F.transform("embedding", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, v: acc + v * v))
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 5).alias("client_id"), "vec_id", F.transform(raw, lambda v: v / norm).alias("vector"), F.col("label").alias("ledger"),
    )


def account_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement periods from orders: every customer is an account, every order a statement of up to 90 days."""
    start = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("account_number"), F.col("o_orderkey").alias("statement_id"), start.alias("period_start"),
        F.date_add(start, (F.col("o_orderkey") % 90).cast("int")).alias("period_end"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and predicted class per labelled document; the prediction is a length rule."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", F.col("quality").cast("int").alias("expected"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("predicted")
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer edits for every sixth order; some name a statement the row is not in, some set a ledger to null."""
    key = F.col("o_orderkey")
    names = F.array_compact(F.array(F.when(key % 2 == 0, "confirmed_ledger"), F.when(key % 3 == 0, "is_ignored")))
    return table(spark, sf_dir, "orders").filter("o_orderkey % 6 in (0, 2, 3)").select(
        F.when(key % 31 == 0, F.lit(-1)).otherwise(F.col("o_custkey")).cast("bigint").alias("statement_id"), key.alias("id"),
        names.alias("fields_set"), F.when(key % 4 != 0, F.concat(F.lit("Edited "), (key % 5).cast("string"))).alias("confirmed_ledger"),
        (key % 9 == 0).alias("is_ignored"),
    )
