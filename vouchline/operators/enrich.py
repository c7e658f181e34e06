"""Narration enrichment: heuristics, client rules, recurring payments, answers and their precedence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vouchline.functions import masking, text
from vouchline.skew import block, ordered

RESULT = ["narration_clean", "payment_mode", "counterparty", "suggested_ledger", "confidence"]
BATCH_SIZE = 50
HISTORY_ROWS = 200
RULES_IN_BLOCK = 256
#: Characters of a gram, under which rules are filed.
GRAM = 3
EXAMPLE_LIMIT = 5
#: Logarithm of the width of a band of amounts: a little less than a tenth, so that rounding parts no two close amounts of one band.
BAND_WIDTH = -math.log(0.9) * 0.999
#: Bands of amounts of nothing or less, and of payments without an amount.
NOTHING_PAID, NO_AMOUNT = -1_000_000, -1_000_001
#: Days in a block; the longest cycle that is looked up by the day itself.
DAYS_IN_BLOCK = 16


def heuristic(df: DataFrame) -> DataFrame:
    """All five results per transaction: projections only, no shuffle. Each step is computed once and then reused."""
    narration, lowered = F.coalesce(F.col("narration"), F.lit("")), F.col("_lowered")
    return (
        df.withColumn("_lowered", F.lower(narration))
        .withColumns({
            "narration_clean": text.clean_narration(narration), "payment_mode": text.payment_mode(lowered),
            "suggested_ledger": text.ledger_hint(lowered, F.col("debit"), F.col("credit")),
        })
        .withColumn("counterparty", text.counterparty(F.col("narration_clean")))
        .withColumn(
            "confidence",
            text.confidence(narration, F.col("narration_clean"), F.col("payment_mode"), F.col("counterparty"),
                            F.col("suggested_ledger")),
        )
        .withColumns({"source": F.lit("heuristic"), "cache_status": F.lit("FALLBACK")})
        .drop("_lowered")
    )


# ---------------------------------------------------------------- client rules


def rule_matches(kind: Column, lowered: Column, pattern: Column, narration: Column) -> Column:
    """Case-insensitive match of one rule; `lowered` is the lower-case pattern."""
    plain = F.lower(narration)
    return (
        F.when(kind == "contains", F.contains(plain, lowered))
        .when(kind == "startswith", F.startswith(plain, lowered))
        .when(kind == "endswith", F.endswith(plain, lowered))
        .when(kind == "exact", plain == lowered)
        .when(kind == "regex", F.rlike(narration, F.concat(F.lit("(?i)"), pattern)))
        .otherwise(False)
    )


def usable_rules(rules: DataFrame) -> DataFrame:
    """Active rules whose regular expression compiles; unknown kinds never match and are left out."""
    kind = F.lower(F.coalesce("match_type", F.lit("contains")))
    compiles = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.coalesce("pattern", F.lit(""))).isNotNull()
    return (
        rules.filter("is_active")
        .withColumns({"match_type": kind, "pattern": F.coalesce("pattern", F.lit(""))})
        .filter(F.col("match_type").isin("contains", "startswith", "endswith", "exact", "regex"))
        .filter((F.col("match_type") != "regex") | compiles)
        .withColumn("lowered", F.lower("pattern"))
    )


def fixed_part(kind: Column, lowered: Column) -> Column:
    """Text that every match of a rule holds, in lower case: the pattern itself; of a regular expression its longest run of plain
    letters, digits and blanks, if it has no alternatives, groups or classes and none but the usual escapes. Else empty.
    """
    simple = ~lowered.rlike(r"[|(\[]") & ~F.regexp_replace(lowered, r"\\[dswb./$^+*?-]", "").contains("\\")
    runs = F.regexp_extract_all(F.regexp_replace(lowered, r"\\.", "\u0001"), F.lit(r"[a-z0-9 ]+(?![?*{a-z0-9 ])|[a-z0-9 ]+(?=[a-z0-9 ][?*{])"), F.lit(0))
    longest = F.aggregate(runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best))
    return F.when(kind != "regex", lowered).when(simple, longest).otherwise("")


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct runs of `size` characters of a text."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))


def file_rules(usable: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((client_id, gram, r): each rule under the gram of its fixed part that the fewest of the client's texts hold; rules without one).

    usable: client_id, r; texts: client_id, gram, one row for each gram of a distinct text.
    """
    keyed = usable.withColumn("_fixed", fixed_part(F.col("r.match_type"), F.col("r.lowered")))
    parts = keyed.filter(F.length("_fixed") >= GRAM).select("client_id", "r", F.explode(grams(F.col("_fixed"))).alias("gram"))
    wanted = parts.select("client_id", "gram").distinct()
    held = texts.join(wanted, ["client_id", "gram"], "left_semi").groupBy("client_id", "gram").agg(F.count(F.lit(1)).alias("_held"))
    # a gram that no text holds is the rarest of all: its rule meets nothing
    rarest = F.min_by("gram", F.struct(F.coalesce("_held", F.lit(0)), "gram"))
    filed = parts.join(held, ["client_id", "gram"], "left").groupBy("client_id", "r").agg(rarest.alias("gram"))
    return filed, keyed.filter(F.length("_fixed") < GRAM).select("client_id", "r")


def _text_grams(distinct: DataFrame) -> DataFrame:
    # splitting texts costs far more than their bytes tell: a fixed number of tasks, which adaptive execution does not merge
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.repartition(tasks, "client_id", "_narration").withColumn("gram", F.explode(grams(F.lower("_narration"))))


def rule_candidates(distinct: DataFrame, usable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct texts with the rules filed under one of their grams, each pair once; the rules that are under none)."""
    texts = _text_grams(distinct)
    filed, rest = file_rules(usable, texts.select("client_id", "gram"))
    return texts.join(filed, ["client_id", "gram"]).drop("gram"), rest


def _rule_hit(r: Column, narration: Column) -> Column:
    return rule_matches(r["match_type"], r["lowered"], r["pattern"], narration)


def _first_rule(rules: Column, narration: Column) -> Column:
    """First of an ordered array of rules that matches, or null."""
    hit = "struct<priority:int,created_at:timestamp,rule_id:bigint,ledger_name:string>"
    return F.aggregate(
        rules, F.lit(None).cast(hit),
        lambda found, r: F.when(found.isNotNull(), found).when(
            rule_matches(r.match_type, r.lowered, r.pattern, narration),
            F.struct(r.priority.alias("priority"), r.created_at.alias("created_at"), r.rule_id.alias("rule_id"), r.ledger_name.alias("ledger_name")).cast(hit),
        ),
    )


def apply_rules(tx: DataFrame, rules: DataFrame, block_rules: int = RULES_IN_BLOCK) -> DataFrame:
    """First matching rule per transaction, lowest priority number then oldest: adds `rule` (struct or null).

    Each distinct narration of a client is matched once. Rules are filed under the rarest gram of their fixed part, so a narration meets
    only rules that share a gram with it, by a hash join. Rules without a fixed part travel as arrays of `block_rules`, in order, and each
    distinct narration of the client goes through those.
    """
    usable = usable_rules(rules).select(
        "client_id", F.struct("priority", "created_at", "rule_id", "match_type", "pattern", "lowered", "ledger_name").alias("r")
    )
    narration = F.coalesce(F.col("narration"), F.lit(""))
    distinct = tx.select("client_id", narration.alias("_narration")).distinct()
    met, rest = rule_candidates(distinct, usable)
    rank = F.row_number().over(W.partitionBy("client_id").orderBy("r.priority", "r.created_at", "r.rule_id"))
    blocks = rest.withColumn("_block", F.floor((rank - 1) / block_rules)).groupBy("client_id", "_block").agg(F.array_sort(F.collect_list("r")).alias("_rules"))
    others = distinct.join(blocks, "client_id").select("client_id", "_narration", _first_rule(F.col("_rules"), F.col("_narration")).alias("_hit")).filter("_hit is not null")
    hit = F.struct(*[F.col(f"r.{c}").alias(c) for c in ["priority", "created_at", "rule_id", "ledger_name"]]).alias("_hit")
    found = met.filter(_rule_hit(F.col("r"), F.col("_narration"))).select("client_id", "_narration", hit)
    hits = found.unionByName(others).groupBy("client_id", "_narration").agg(F.min("_hit").alias("rule"))
    return tx.withColumn("_narration", narration).join(hits, ["client_id", "_narration"], "left").drop("_narration")


def rule_dry_run(tx: DataFrame, rules: DataFrame) -> DataFrame:
    """How many of the client's narrations each rule would match, with the first one as a sample. Equal narrations are matched once.

    Rules meet narrations by grams, as in `apply_rules`; those without a fixed part meet all distinct narrations of their client.
    """
    usable = usable_rules(rules)
    keyed = usable.select("client_id", F.struct("rule_id", "match_type", "pattern", "lowered").alias("r"))
    rows = tx.withColumn("_narration", F.coalesce("narration", F.lit("")))
    distinct = rows.groupBy("client_id", "_narration").agg(F.count(F.lit(1)).alias("n"), F.min_by("narration", "id").alias("narration"), F.min("id").alias("first_id"))
    met, rest = rule_candidates(distinct, keyed)
    hits = met.unionByName(distinct.join(rest, "client_id")).filter(_rule_hit(F.col("r"), F.col("_narration")))
    counts = hits.groupBy("r.rule_id").agg(F.sum("n").alias("matches"), F.min_by("narration", "first_id").alias("sample"))
    return usable.select("rule_id").join(counts, "rule_id", "left").select(
        "rule_id", F.coalesce("matches", F.lit(0)).alias("matches"), "sample"
    )


# ---------------------------------------------------------------- recurring payments


def recent_history(tx: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """The client's latest confirmed transactions. The rank limit is applied before the shuffle as well as after it."""
    latest = W.partitionBy("client_id").orderBy(F.desc("txn_date"), F.desc("id"))
    cleaned = ["narration_clean"] if "narration_clean" in tx.columns else []
    return (
        tx.filter("confirmed_ledger is not null")
        .select("client_id", "id", "txn_date", "narration", *cleaned, "debit", "credit", "confirmed_ledger")
        .withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= rows).drop("_n")
    )


def _close(amount: Column, other: Column) -> Column:
    """Whether two amounts differ by at most a tenth of the larger one; amounts of nothing or less are close to each other."""
    largest = F.greatest(amount, other)
    return (largest <= 0) | (F.abs(amount - other) <= largest * F.lit(0.10).cast("decimal(3,2)"))


def _repeats(now: Column, then: Column) -> Column:
    """Whether one payment (txn_date, is_debit, amount) repeats another: same side, amount within a tenth, a usual cycle of days."""
    days = F.abs(F.datediff(now["txn_date"], then["txn_date"]))
    cycle = (
        days.between(6, 8) | days.between(12, 16) | days.between(25, 35) | (days % 30 <= 5) | (days % 30 >= 25)
        | (F.abs(F.dayofmonth(now["txn_date"]) - F.dayofmonth(then["txn_date"])) <= 5)
    )
    return (now["is_debit"] == then["is_debit"]) & _close(now["amount"], then["amount"]) & cycle


def _payment() -> Column:
    return F.struct("txn_date", F.col("debit").isNotNull().alias("is_debit"), F.coalesce("debit", "credit").alias("amount"))


def mark_recurring(tx: DataFrame, mappings: DataFrame, history: DataFrame, min_hits: int = 2) -> DataFrame:
    """`tx` with `recurring_ledger`: that of the mapping with the row's pattern, where the row repeats one of its confirmed payments.

    history: as `recent_history` gives it, so the payments of a mapping are an array of at most that many; rows meet it by client and
    pattern in one join and none is multiplied. A longer history should go to `recurring`.
    """
    known = mappings.filter((F.col("hit_count") >= min_hits) & (F.col("pattern") != "")).select("client_id", "pattern", "ledger_name")
    past = text.with_pattern(history).select("client_id", "pattern", F.col("confirmed_ledger").alias("ledger_name"), _payment().alias("p"))
    paid = known.join(past, ["client_id", "pattern", "ledger_name"]).groupBy("client_id", "pattern", "ledger_name").agg(F.collect_list("p").alias("_paid"))
    paid = paid.select("client_id", F.col("pattern").alias("_pattern"), F.col("ledger_name").alias("_ledger"), "_paid")
    marked = tx.withColumn("_pattern", text.mapping_pattern(tx)).join(paid, ["client_id", "_pattern"], "left").withColumn("_now", _payment())
    repeats = F.exists("_paid", lambda p: _repeats(F.col("_now"), p))
    return marked.withColumn("recurring_ledger", F.when(repeats, F.col("_ledger"))).drop("_pattern", "_ledger", "_paid", "_now")


def _band(amount: Column) -> Column:
    """Band of an amount: all amounts of one band are close to each other, and an amount is close to none beyond two bands."""
    return F.when(amount > 0, F.floor(F.ln(amount.cast("double")) / BAND_WIDTH).cast("int")).when(amount <= 0, NOTHING_PAID).otherwise(NO_AMOUNT)


def payment_bands(past: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Payments summed up by where a later one may look for them: (keys, _band, _cycles) and (keys, _band, _block, _days).

    past: keys, txn_date, amount. A payment is filed under its band and the two on either side of it. Of all payments of a place only two
    amounts can decide: the least of the band and those above (`up`), and the largest of those below (`down`). Places are the remainder of
    the day number by 30 and the day of the month (`_cycles`: at most 61 of them), and within a block of days the day itself (`_days`: a
    block holds its own days and those of the blocks beside it). So an array is bounded by the calendar, however many payments there are.
    """
    by_day = (
        past.filter("txn_date is not null").groupBy(*keys, _band(F.col("amount")).alias("_own"), "txn_date")
        .agg(F.min("amount").alias("_least"), F.max("amount").alias("_most"))
    )
    reach = (
        F.when(F.col("_own") == NOTHING_PAID, F.array(F.lit(NOTHING_PAID), F.lit(NO_AMOUNT)))
        .when(F.col("_own") == NO_AMOUNT, F.array(F.lit(NOTHING_PAID))).otherwise(F.sequence(F.col("_own") - 2, F.col("_own") + 2))
    )
    below = (F.col("_own") < F.col("_band")) & (F.col("_own") > NOTHING_PAID)
    nearest = [F.min("_up").alias("up"), F.max("_down").alias("down")]
    filed = (
        by_day.withColumn("_band", F.explode(reach))
        .withColumns({"_up": F.when(~below, F.col("_least")), "_down": F.when(below, F.col("_most"))})
        .groupBy(*keys, "_band", "txn_date").agg(F.min("_up").alias("_up"), F.max("_down").alias("_down"))
    )
    day = F.unix_date("txn_date")
    places = F.array(F.pmod(day, F.lit(30)), F.dayofmonth("txn_date") + 30)
    cycles = (
        filed.withColumn("place", F.explode(places)).groupBy(*keys, "_band", "place").agg(*nearest)
        .groupBy(*keys, "_band").agg(F.collect_list(F.struct("place", "up", "down")).alias("_cycles"))
    )
    own = F.floor(day / DAYS_IN_BLOCK).cast("int")
    days = (
        filed.withColumn("_block", F.explode(F.array(own - 1, own, own + 1)))
        .groupBy(*keys, "_band", "_block").agg(F.collect_list(F.struct(day.alias("place"), F.col("_up").alias("up"), F.col("_down").alias("down"))).alias("_days"))
    )
    return cycles, days


def recurring(tx: DataFrame, mappings: DataFrame, history: DataFrame, min_hits: int = 2) -> DataFrame:
    """Transactions that repeat a confirmed payment, for a history of any length: (id, recurring_ledger).

    A band join without pairs. Payments are summed up by client, pattern, ledger, side and band of amounts (`payment_bands`); a row meets
    one row for its own band, and one for its block of days, by equality, and looks for a place whose nearest amount is close. The sums do
    not grow with the payments of a pattern. Rows without a date repeat nothing.
    """
    keys = ["client_id", "pattern", "recurring_ledger", "is_debit"]
    known = mappings.filter(F.col("hit_count") >= min_hits).select("client_id", "pattern", F.col("ledger_name").alias("recurring_ledger"))
    payment = ["client_id", "pattern", _payment().alias("p")]
    past = text.with_pattern(history).select(*payment, F.col("confirmed_ledger").alias("recurring_ledger"))
    cycles, days = payment_bands(past.select("client_id", "pattern", "recurring_ledger", "p.*"), keys)
    day = F.unix_date("txn_date")
    asked = text.with_pattern(tx).select("id", *payment).select("id", "client_id", "pattern", "p.*").filter("txn_date is not null")
    asked = asked.join(known, ["client_id", "pattern"]).withColumns({"_band": _band(F.col("amount")), "_block": F.floor(day / DAYS_IN_BLOCK).cast("int")})

    def met(places: str, usual) -> Column:
        near = lambda p: _close(F.col("amount"), p["up"]) | _close(F.col("amount"), p["down"])
        return F.coalesce(F.exists(places, lambda p: usual(p["place"]) & F.coalesce(near(p), F.lit(False))), F.lit(False))

    def in_cycle(place: Column) -> Column:
        apart = F.pmod(day - place, F.lit(30))
        return F.when(place < 30, (apart <= 5) | (apart >= 25)).otherwise(F.abs(F.dayofmonth("txn_date") + 30 - place) <= 5)

    def in_weeks(place: Column) -> Column:
        return F.abs(day - place).between(6, 8) | F.abs(day - place).between(12, 16)

    looked = asked.join(cycles, [*keys, "_band"], "left").join(days, [*keys, "_band", "_block"], "left")
    return looked.filter(met("_cycles", in_cycle) | met("_days", in_weeks)).select("id", "recurring_ledger")


# ---------------------------------------------------------------- answers and precedence


def allowed_ledgers(ledgers: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """(client_id, ledger_name): the ledgers a client has and those it has learnt."""
    names = ledgers.select("client_id", F.col("name").alias("ledger_name"))
    if mappings is not None:
        names = names.union(mappings.filter("ledger_name is not null and ledger_name <> ''").select("client_id", "ledger_name"))
    return names.distinct()


def validate_answers(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """The client's own spelling of each proposed ledger; one unknown name rejects its whole batch.

    A client without any ledger has no constraint. Batches hold at most 50 rows, so their window is bounded.
    """
    spelling = allowed.groupBy("client_id", F.lower("ledger_name").alias("_key")).agg(F.min("ledger_name").alias("_spelling"))
    constrained = allowed.select("client_id").distinct().withColumn("_constrained", F.lit(True))
    joined = (
        answers.withColumn("_key", F.lower("suggested_ledger"))
        .join(spelling, ["client_id", "_key"], "left").join(constrained, "client_id", "left")
    )
    invalid = F.coalesce(F.col("_constrained"), F.lit(False)) & F.col("suggested_ledger").isNotNull() & F.col("_spelling").isNull()
    batch = W.partitionBy("statement_id", "batch_no", "tier")
    return (
        joined.withColumn("ledger_invalid", invalid)
        .withColumn("batch_rejected", F.max("ledger_invalid").over(batch))
        .withColumn("suggested_ledger", F.coalesce("_spelling", "suggested_ledger"))
        .drop("_key", "_spelling", "_constrained")
    )


def resolve_tiers(answers: DataFrame) -> DataFrame:
    """Per batch only the first tier that gave an answer counts; one that `validate_answers` rejected gave none."""
    if "batch_rejected" in answers.columns:
        answers = answers.filter(~F.col("batch_rejected"))
    best = answers.groupBy("statement_id", "batch_no").agg(F.min("tier").alias("tier"))
    return answers.join(best, ["statement_id", "batch_no", "tier"], "left_semi")


def enrich(
    tx: DataFrame,
    rules: DataFrame | None = None,
    mappings: DataFrame | None = None,
    history: DataFrame | None = None,
    cache: DataFrame | None = None,
    answers: DataFrame | None = None,
    precedence: str = "documented",
    ledgers: DataFrame | None = None,
) -> DataFrame:
    """One result per transaction: rule, recurring, cache, external answer, heuristic.

    `cache` needs `content_hash` on both sides; `answers` is keyed by transaction id. With `precedence="as_coded"` a
    recurring match overrides a rule. With `ledgers` (client_id, name) answers are checked against the ledgers a client has or has
    learnt: a batch with an unknown one falls to its next tier, in the end to the heuristic. Recurring payments go by the row's
    `narration_clean`; rows that come without that column take the one of the heuristic.
    """
    def result(ledger: Column, confidence: str, source: str) -> Column:
        return F.struct(
            F.col("narration_clean"), F.col("payment_mode"), F.col("counterparty"), ledger.alias("suggested_ledger"),
            F.lit(confidence).cast("decimal(4,3)").alias("confidence"), F.lit(source).alias("source"),
            F.lit("MISS").alias("cache_status"),
        )

    packed = [*RESULT, "source", "cache_status"]
    out = fresh = heuristic(tx)
    steps: dict[str, Column] = {}
    if rules is not None:
        out = apply_rules(out, rules)
        steps["rule"] = F.when(F.col("rule").isNotNull(), result(F.col("rule.ledger_name"), "1.000", "rule"))
    if mappings is not None:
        known = tx if "narration_clean" in tx.columns else fresh
        if history is None and known is fresh:
            out = mark_recurring(out, mappings, recent_history(fresh))
        else:
            out = out.join(recurring(known, mappings, history if history is not None else recent_history(known)), "id", "left")
        steps["recurring"] = F.when(
            F.col("recurring_ledger").isNotNull(), result(F.col("recurring_ledger"), "0.920", "recurring")
        )
    if answers is not None:
        if ledgers is not None:
            answers = validate_answers(answers, allowed_ledgers(ledgers, mappings))
        given = resolve_tiers(answers).select(
            "id",
            F.struct(*[F.col(c) for c in RESULT], F.col("source"), F.lit("MISS").alias("cache_status")).alias("_answer"),
        )
        out = out.join(given, "id", "left")
        steps["answers"] = F.col("_answer")
    if cache is not None:
        stored = cache.select(
            "content_hash",
            F.struct(*[F.col(c) for c in RESULT], F.coalesce("source", F.lit("cache")).alias("source"),
                     F.lit("HIT").alias("cache_status")).alias("_cache"),
        )
        out = out.join(stored, "content_hash", "left")
        steps["cache"] = F.col("_cache")
    order = ["recurring", "rule"] if precedence == "as_coded" else ["rule", "recurring"]
    chosen = F.coalesce(
        *[steps[s] for s in [*order, "cache", "answers"] if s in steps], F.struct(*[F.col(c) for c in packed])
    )
    keep = [c for c in tx.columns if c not in packed]
    return out.withColumn("_r", chosen).select(*keep, *[F.col(f"_r.{c}").alias(c) for c in packed])


def _incomplete() -> Column:
    return F.greatest(*[F.col(c).isNull() for c in ["narration_clean", "payment_mode", "suggested_ledger", "confidence"]])


def enrich_missing(tx: DataFrame, *tables: DataFrame | None, **options) -> DataFrame:
    """`enrich` for the rows that miss one of the four fields `pick_work` looks at; all others stay as they are, with a null source.

    tables and options: as for `enrich`. A field that `tx` does not have at all is missing in every row. Rows go by the cleaned narration
    they have, those without one by that of the heuristic.
    """
    tx = tx.withColumns({c: F.lit(None).cast("decimal(4,3)" if c == "confidence" else "string") for c in RESULT if c not in tx.columns})
    cleaned = text.mapping_text(F.col("narration_clean"), text.clean_narration(F.col("narration")))
    work = tx.filter(_incomplete()).withColumn("narration_clean", cleaned).drop(*[c for c in RESULT if c != "narration_clean"])
    return enrich(work, *tables, **options).unionByName(tx.filter(~_incomplete()), allowMissingColumns=True)


def apply_results(tx: DataFrame, results: DataFrame) -> DataFrame:
    """Write the five fields onto the transactions that have a result; others keep theirs."""
    new = results.select("id", F.struct(*RESULT).alias("_r"))
    joined = tx.join(new, "id", "left")
    return joined.withColumns(
        {c: F.when(F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(c)) for c in RESULT}
    ).drop("_r")


def pick_work(tx: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    """Rows that miss any of four fields (all when forced), in row order, at most `limit` per statement."""
    work = tx if force else tx.filter(_incomplete())
    if limit is None:
        return work
    nth = F.row_number().over(W.partitionBy("statement_id").orderBy("row_number", "id"))
    return work.withColumn("_n", nth).filter(F.col("_n") <= limit).drop("_n")


def number_batches(work: DataFrame, size: int = BATCH_SIZE, hot: DataFrame | None = None) -> DataFrame:
    """Consecutive batches per statement, in row order."""
    numbered = ordered(
        work, ["statement_id"], ["row_number"], split=block("row_number"), running={"_nth": ("sum", F.lit(1))}, hot=hot
    )
    return numbered.withColumn("batch_no", F.floor((F.col("_nth") - 1) / size)).drop("_nth")


def request_rows(tx: DataFrame, account_number: Column | None = None) -> DataFrame:
    """Masked request row per transaction, as JSON with nulls kept."""
    body = F.struct(
        F.col("id").cast("string").alias("id"),
        F.date_format("txn_date", "yyyy-MM-dd").alias("date"),
        masking.mask_text(F.col("narration"), account_number).alias("narration"),
        *[F.col(c).cast("string").alias(c) for c in ["debit", "credit", "balance"]],
    )
    return tx.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("request"))


def example_context(examples: Column) -> Column:
    """At most five (narration, ledger) pairs, cut and masked, as a JSON array; null when none is usable."""
    usable = F.filter(
        F.slice(examples, 1, EXAMPLE_LIMIT),
        lambda e: (F.coalesce(e.narration, F.lit("")) != "") & (F.coalesce(e.ledger, F.lit("")) != ""),
    )
    cut = F.transform(
        usable,
        lambda e: F.struct(
            masking.mask_text(F.substring(e.narration, 1, 160)).alias("narration"), F.substring(e.ledger, 1, 120).alias("ledger")
        ),
    )
    return F.when(F.size(cut) > 0, F.to_json(cut))
