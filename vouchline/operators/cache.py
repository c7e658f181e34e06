"""Answer cache, token estimates, cost and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vouchline.session import path_exists

MILLION = 1_000_000
#: Buckets of a stored cache, and its columns.
CACHE_BUCKETS = 256
CACHE_COLUMNS = (
    "content_hash STRING, provider STRING, model STRING, response STRING, prompt_tokens BIGINT, completion_tokens BIGINT, "
    "cost_usd DECIMAL(10,6), hit_count BIGINT, created_at TIMESTAMP, last_used_at TIMESTAMP"
)

# Result source | provider | model | USD per million tokens in | out.
PRICES = [
    ("claude", "anthropic", "claude-sonnet-4-5", "3.00", "15.00"),
    ("claude-fallback", "anthropic", "claude-3-5-haiku-latest", "3.00", "15.00"),
    ("gpt4o-fallback", "openai", "gpt-4o-mini", "0.15", "0.60"),
    ("rule", "local", "rules-engine-v1", "0", "0"),
    ("recurring", "local", "recurring-v1", "0", "0"),
    ("heuristic", "local", "heuristic-v1", "0", "0"),
]


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "source string, provider string, model string, _in string, _out string").select(
        "source", "provider", "model",
        F.col("_in").cast("decimal(10,2)").alias("usd_in"), F.col("_out").cast("decimal(10,2)").alias("usd_out"),
    )


def ascii_json(json: Column) -> Column:
    """Non-ASCII characters as \\uXXXX (surrogate pairs above U+FFFF); pure ASCII passes untouched."""
    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))

    def escape(ch: Column) -> Column:
        code = F.ascii(ch)
        high = F.lit(0xD800) + F.floor((code - 0x10000) / 1024).cast("int")
        low = F.lit(0xDC00) + F.pmod(code - 0x10000, F.lit(1024))
        return F.when(code < 128, ch).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))

    escaped = F.array_join(F.transform(F.split(json, ""), escape), "")
    return F.when(json.rlike(r"[^\x00-\x7F]"), escaped).otherwise(json)


def content_hash(df: DataFrame) -> Column:
    """SHA-256 over narration and amounts; date and client are not part of the key."""
    body = F.struct(
        F.col("balance").cast("string").alias("balance"), F.col("credit").cast("string").alias("credit"),
        F.col("debit").cast("string").alias("debit"), F.col("narration").alias("narration"),
    )
    return F.sha2(ascii_json(F.to_json(body, {"ignoreNullFields": "false"})), 256)


def lookup(tx: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached answers beside the transactions; rows without one are misses."""
    return tx.join(cache.withColumn("cache_hit", F.lit(True)), "content_hash", "left").withColumn(
        "cache_hit", F.coalesce("cache_hit", F.lit(False))
    )


def misses(tx: DataFrame, cache: DataFrame) -> DataFrame:
    return tx.join(cache, "content_hash", "left_anti")


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """New answers replace answer, tokens and cost; provider, model, creation and hit count of the first write stay.

    Columns: content_hash, provider, model, response, prompt_tokens, completion_tokens, cost_usd, hit_count, written_at. A `last_used_at` in
    the cache counts for the new one.
    """
    used = F.greatest("last_used_at", "written_at") if "last_used_at" in cache.columns else F.col("written_at")
    both = cache.withColumns({"_old": F.lit(1), "_used": used}).unionByName(fresh.withColumns({"_old": F.lit(0), "_used": F.col("written_at")}), allowMissingColumns=True)
    first, last = F.struct(-F.col("_old"), F.col("written_at")), F.struct(F.col("written_at"), -F.col("_old"))
    latest = ["response", "prompt_tokens", "completion_tokens", "cost_usd"]
    return both.groupBy("content_hash").agg(
        F.min_by(F.struct("provider", "model"), first).alias("_f"),
        F.max_by(F.struct(*latest), last).alias("_l"),
        F.max(F.coalesce("hit_count", F.lit(0))).alias("hit_count"),
        F.min("written_at").alias("created_at"), F.max("_used").alias("last_used_at"),
    ).select("content_hash", "_f.provider", "_f.model", *[F.col(f"_l.{c}").alias(c) for c in latest],
             "hit_count", "created_at", "last_used_at")


def stored_cache(spark: SparkSession, path: str, name: str, buckets: int = CACHE_BUCKETS) -> DataFrame:
    """The answer cache kept below `path` (a shared folder), empty if nothing is there; `name` is what the session's catalog calls it.

    It is bucketed by content hash, so `lookup` and `misses` move the transactions to the answers and never the cache. The folder of a row
    is its bucket, so each bucket can be replaced alone. `buckets` must stay the same over the life of a cache; it is the number of tasks of
    a lookup and should leave some hundred megabytes to a bucket.
    """
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({CACHE_COLUMNS}, bucket INT) USING parquet OPTIONS (path '{path}') PARTITIONED BY (bucket) "
                  f"CLUSTERED BY (content_hash) INTO {int(buckets)} BUCKETS")
    if path_exists(spark, path):  # buckets that another session wrote
        spark.catalog.recoverPartitions(name)
        spark.catalog.refreshTable(name)
    return spark.table(name).drop("bucket")


def upsert_stored(fresh: DataFrame, name: str, buckets: int = CACHE_BUCKETS) -> list[int]:
    """`upsert` into a stored cache: only buckets that get an answer are read and written; returns their numbers.

    `fresh` has the columns that `upsert` takes and is computed twice. The same answers brought in again change nothing.
    """
    spark = fresh.sparkSession
    # the hash by which Spark deals rows to buckets, so the folder and the bucket of a row are one number
    bucket = F.pmod(F.hash("content_hash"), F.lit(buckets)).alias("bucket")
    touched = sorted(r.bucket for r in fresh.select(bucket).distinct().collect())  # at most `buckets` numbers
    if touched:
        old = spark.table(name).filter(F.col("bucket").isin(touched)).drop("bucket").withColumnRenamed("created_at", "written_at")
        merged = upsert(old, fresh).select("*", bucket).select(*spark.table(name).columns)
        mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            merged.repartition(buckets, "content_hash").write.insertInto(name, overwrite=True)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    return touched


def count_hits(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """Raise hit_count by the number of hits and move last_used_at; hits: (content_hash, used_at)."""
    used = hits.groupBy("content_hash").agg(F.count(F.lit(1)).alias("_n"), F.max("used_at").alias("_at"))
    return cache.join(used, "content_hash", "left").withColumns(
        {"hit_count": F.col("hit_count") + F.coalesce("_n", F.lit(0)), "last_used_at": F.greatest("last_used_at", "_at")}
    ).drop("_n", "_at")


def hit_usage(hits: DataFrame, cache: DataFrame) -> DataFrame:
    """One zero-cost usage row per hit."""
    return hits.join(cache.select("content_hash", "provider", "model"), "content_hash").select(
        "statement_id", "transaction_id", "provider", "model", F.lit("HIT").alias("cache_status"), "content_hash",
        F.lit(0).alias("prompt_tokens"), F.lit(0).alias("completion_tokens"), F.lit(0).cast("decimal(10,6)").alias("cost_usd"),
    )


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def cost_usd(prompt: Column, completion: Column, usd_in: Column, usd_out: Column) -> Column:
    """Half-even rounding at six places."""
    total = (prompt.cast("decimal(12,0)") * usd_in + completion.cast("decimal(12,0)") * usd_out) / F.lit(MILLION).cast("decimal(8,0)")
    return F.bround(total, 6).cast("decimal(10,6)")


def charge(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Provider, model and cost by result source, as the price table has them. A source that the table lacks takes its `heuristic` row, or
    costs nothing if there is none: no usage row is lost. Local tokens are zeroed."""
    named = prices.withColumnRenamed("source", "_s")
    fallback = prices.filter(F.col("source") == "heuristic").limit(1).select(F.lit(1).alias("_one"), *[F.col(c).alias(f"_{c}") for c in prices.columns if c != "source"])
    joined = usage.withColumn("_one", F.lit(1)).join(named, F.col("source") == F.col("_s"), "left").join(fallback, "_one", "left")
    joined = joined.withColumns({
        "provider": F.when(F.col("_s").isNotNull(), F.col("provider")).otherwise(F.coalesce("_provider", F.lit("local"))),
        "model": F.when(F.col("_s").isNotNull(), F.col("model")).otherwise(F.coalesce("_model", F.lit("heuristic"))),
        **{c: F.coalesce(F.when(F.col("_s").isNotNull(), F.col(c)).otherwise(F.col(f"_{c}")), F.lit(0)).cast(prices.schema[c].dataType) for c in ("usd_in", "usd_out")},
    }).drop("_one", "_provider", "_model", "_usd_in", "_usd_out")
    local = F.col("provider") == "local"
    return joined.withColumn(
        "cost_usd", cost_usd(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("usd_in"), F.col("usd_out"))
    ).withColumns(
        {c: F.when(local, F.lit(0)).otherwise(F.col(c)) for c in ["prompt_tokens", "completion_tokens"]}
    ).drop("_s", "usd_in", "usd_out")


def append_usage(usage: DataFrame, path: str) -> None:
    usage.write.mode("append").partitionBy("cache_status").parquet(path)


def usage_summary(statements: DataFrame, usage: DataFrame) -> DataFrame:
    """Calls, hits, misses, fallbacks, tokens and cost per statement; zeros where nothing was used."""
    totals = usage.groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("calls"),
        *[F.count_if(F.col("cache_status") == s).alias(n) for s, n in
          [("HIT", "cache_hits"), ("MISS", "cache_misses"), ("FALLBACK", "fallback_calls")]],
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
    )
    numbers = [c for c in totals.columns if c not in ("statement_id", "cost_usd")]
    return statements.select("statement_id").join(totals, "statement_id", "left").select(
        "statement_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("cost_usd", F.lit(0)).cast("decimal(18,6)").alias("cost_usd"),
    )


def invalidate(cache: DataFrame, tx: DataFrame) -> DataFrame:
    """Forced re-run: drop the cached answers of these transactions."""
    return cache.join(tx.select("content_hash"), "content_hash", "left_anti")


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the newest row per key, by a pre-aggregated maximum."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
