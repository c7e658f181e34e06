"""Template coverage, regression comparison, accuracy and failure rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouchline.skew import ordered

# What counts as failed or successful, and the alert limits.
FAILURE_STATUSES = ["FAILED", "PARSE_ERROR"]
SUCCESS_STATUSES = ["READY_FOR_REVIEW", "REVIEWED", "EXPORTED"]
ALERT_RATE = 0.05
ALERT_SAMPLES = 20


def coverage(templates: DataFrame, manifest: DataFrame) -> DataFrame:
    """covered / missing (template without test) / stale (test without template), one row per code."""
    have, tested = templates.select("code").distinct(), manifest.select("code").distinct()
    return (
        have.intersect(tested).withColumn("state", F.lit("covered"))
        .union(have.subtract(tested).withColumn("state", F.lit("missing")))
        .union(tested.subtract(have).withColumn("state", F.lit("stale")))
    )


def coverage_summary(states: DataFrame) -> DataFrame:
    counts = states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ["covered", "missing", "stale"]])
    total = F.col("covered") + F.col("missing")
    return counts.withColumn("percent", F.when(total > 0, F.bround(F.col("covered") / total * 100, 2)).otherwise(F.lit(0.0)))


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def compare_rows(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected against parsed rows by position; `reason` names the first difference, null when equal."""
    e = expected.select(*keys, F.struct("narration", "debit", "credit", "balance").alias("e"))
    a = actual.select(*keys, F.struct("narration", "debit", "credit", "balance").alias("a"))
    reason = (
        F.when(F.col("a").isNull(), "missing row").when(F.col("e").isNull(), "unexpected row")
        .when(~F.contains(_letters(F.col("a.narration")), _letters(F.col("e.narration"))), "narration")
    )
    for field in ["debit", "credit", "balance"]:
        reason = reason.when(~F.col(f"a.{field}").eqNullSafe(F.col(f"e.{field}")), field)
    return e.join(a, keys, "full").select(*keys, reason.alias("reason"))


def suite_summary(compared: DataFrame, case: str) -> DataFrame:
    """Cases, passed and failed; a case passes when all its rows are equal."""
    cases = compared.groupBy(case).agg(F.bool_and(F.col("reason").isNull()).alias("passed"))
    return cases.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")
    )


def failure_alerts(statements: DataFrame, since: Column, rate: float = ALERT_RATE, samples: int = ALERT_SAMPLES) -> DataFrame:
    bank = F.lower(F.coalesce(F.nullif(F.col("bank_code"), F.lit("")), F.lit("unknown")))
    counts = statements.filter(F.col("created_at") >= since).groupBy(bank.alias("bank_code")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status").isin(FAILURE_STATUSES)).alias("failures"),
        F.count_if(F.col("status").isin(SUCCESS_STATUSES)).alias("successes"),
    )
    share = F.col("failures") / F.col("total")
    return counts.select("*", F.bround(share, 4).alias("failure_rate"), ((F.col("total") >= samples) & (share > rate)).alias("alert"))


def running_failure_rate(attempts: DataFrame) -> DataFrame:
    """Failure rate per bank after every attempt. There are few banks, so hot ones are split by hour."""
    failed = F.when(F.col("status").isin(FAILURE_STATUSES), 1).otherwise(0)
    counted = ordered(
        attempts, ["bank_code"], ["ts", "event_id"], split=F.date_trunc("hour", "ts"),
        running={"failures": ("sum", failed), "total": ("sum", F.lit(1))},
    )
    return counted.withColumn("failure_rate", F.col("failures") / F.col("total"))


def accuracy(compared: DataFrame, wanted: float = 0.98) -> DataFrame:
    """Share of expected rows parsed without a difference; missing rows count as wrong."""
    total = compared.filter(F.coalesce("reason", F.lit("")) != "unexpected row").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if(F.col("reason").isNull()).alias("correct")
    )
    return total.withColumn("accuracy", F.col("correct") / F.col("expected")).withColumn("passed", F.col("accuracy") >= wanted)


def first_failures(compared: DataFrame, keys: list[str], rows: int = 10) -> DataFrame:
    return compared.filter("reason is not null").orderBy(*keys).limit(rows)


def confusion_matrix(predictions: DataFrame, labels: list) -> DataFrame:
    return predictions.groupBy("expected").pivot("predicted", labels).agg(F.count(F.lit(1))).na.fill(0)


def classification_accuracy(predictions: DataFrame, wanted: float = 0.80) -> DataFrame:
    right = F.count_if(F.col("expected") == F.col("predicted"))
    return predictions.agg(F.count(F.lit(1)).alias("total"), right.alias("correct")).withColumn(
        "accuracy", F.col("correct") / F.col("total")
    ).withColumn("passed", F.col("accuracy") >= wanted)
