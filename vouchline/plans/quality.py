"""Queries K1-K8, R1-R5, T1-T7 and V1-V12."""

from pyspark.sql import functions as F

from vouchline.functions import masking
from vouchline.operators import checks as ck, enrich as en, export as ex, memory as me, quality as q, shape as sh
from vouchline.plans import views as v
from vouchline.plans.enrichment import PRECEDENCE, _mask_sql
from vouchline.plans.registry import query
from vouchline.plans.shaping import BANK_CODES
from vouchline.session import move_path, shuffles_freed, work_dir
from vouchline.sources import fixtures as fx, templates as tp
from vouchline.sources.readers import spread_small
from vouchline.streaming import jobs

DOCS = f"docs AS (SELECT *, {v.bordered('text')} AS marked FROM documents)"


def _documents(s, d):
    return spread_small(fx.table(s, d, "documents"))


CASES = [b[0] for b in tp.BANKS]


def _banks_in_use(s, d):
    """The bank of each supplier's statements: the catalogue's banks but two, and one that has no template."""
    key = F.col("s_suppkey") % 29
    code = F.lit("old_bank")
    for i, bank in enumerate(CASES[:28]):
        code = F.when(key == i, bank).otherwise(code)
    return fx.table(s, d, "supplier").select(code.alias("code"))


USED = f"bu AS (SELECT DISTINCT CASE s_suppkey % 29 {' '.join(f'''WHEN {i} THEN '{c}' ''' for i, c in enumerate(CASES[:28]))} ELSE 'old_bank' END AS code FROM supplier)"
CATALOGUE = f"ct AS (SELECT unnest([{BANK_CODES}]) AS code)"
COVERAGE = """cv AS (SELECT coalesce(ct.code, bu.code) AS code, CASE WHEN bu.code IS NULL THEN 'missing' WHEN ct.code IS NULL THEN 'stale' ELSE 'covered' END AS state FROM ct FULL JOIN bu ON ct.code = bu.code)"""


@query("k1_coverage", f"WITH {USED}, {CATALOGUE}, {COVERAGE} SELECT code, state FROM cv")
def _(s, d):
    return q.coverage(tp.catalogue(s), _banks_in_use(s, d))


@query("k1_coverage_summary", f"""WITH {USED}, {CATALOGUE}, {COVERAGE}, n AS (SELECT count(*) FILTER (state = 'covered') AS covered, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'stale') AS stale FROM cv)
SELECT *, CAST(round_even(covered / (covered + missing) * 100, 2) AS DOUBLE) AS percent FROM n""")
def _(s, d):
    return q.coverage_summary(q.coverage(tp.catalogue(s), _banks_in_use(s, d)))


def _compared(s, d):
    """Parsed rows against the transactions they were rendered from, with some expectations spoilt."""
    expected = fx.transactions(s, d, numbered=True, clients=False).select(
        "statement_id", "row_number", F.when(F.col("id") % 13 == 0, "NOT THERE").otherwise(F.col("narration")).alias("narration"),
        F.when(F.col("id") % 11 == 0, F.col("debit") + 1).otherwise(F.col("debit")).cast("decimal(18,2)").alias("debit"), "credit",
        F.when(F.col("id") % 7 == 0, F.col("balance") + 1).otherwise(F.col("balance")).cast("decimal(18,2)").alias("balance"))
    actual = sh.parse_statements(fx.raw_rows(s, d), tp.catalogue(s), fx.long_statements(s, d)).filter("row_number % 6 <> 0")
    return q.compare_rows(expected, actual, ["statement_id", "row_number"])


COMPARED = f"""cm AS (SELECT statement_id, row_number, CASE WHEN row_number % 6 = 0 THEN 'missing row' WHEN id % 13 = 0 THEN 'narration' WHEN id % 11 = 0 AND debit IS NOT NULL THEN 'debit'
  WHEN id % 7 = 0 THEN 'balance' END AS reason FROM tx)"""


@query("k2_compare", f"WITH {v.TX}, {COMPARED} SELECT * FROM cm")
def _(s, d):
    return _compared(s, d)


@query("k3_suite", f"""WITH {v.TX}, {COMPARED}, cs AS (SELECT statement_id, bool_and(reason IS NULL) AS ok FROM cm GROUP BY ALL)
SELECT count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM cs""")
def _(s, d):
    return q.suite_summary(_compared(s, d), "statement_id")


@query("k4_failure_alerts", f"""WITH {v.EVENTS}, n AS (SELECT lower(bank_code) AS bank_code, count(*) AS total, count(*) FILTER (status IN ('FAILED', 'PARSE_ERROR')) AS failures,
  count(*) FILTER (status IN ('READY_FOR_REVIEW', 'REVIEWED', 'EXPORTED')) AS successes FROM ev WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' GROUP BY ALL)
SELECT *, CAST(round_even(failures / total, 4) AS DOUBLE) AS failure_rate, total >= 20 AND failures / total > 0.05 AS alert FROM n""")
def _(s, d):
    events = fx.status_events(s, d).withColumnRenamed("ts", "created_at")
    return q.failure_alerts(events, F.lit("2024-01-02 00:00:00").cast("timestamp"))


@query("k5_running_rate", f"""WITH {v.EVENTS} SELECT event_id, bank_code, CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failures, count(*) OVER w AS total,
  CAST(round(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) OVER w / count(*) OVER w, 9) AS DOUBLE) AS failure_rate FROM ev WINDOW w AS (PARTITION BY bank_code ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def _(s, d):
    rates = q.running_failure_rate(fx.status_events(s, d))
    return rates.select("event_id", "bank_code", "failures", "total", F.round("failure_rate", 9).alias("failure_rate"))


@query("k6_accuracy", f"""WITH {v.TX}, {COMPARED} SELECT count(*) AS expected, count(*) FILTER (reason IS NULL) AS correct, CAST(round(count(*) FILTER (reason IS NULL) / count(*), 9) AS DOUBLE) AS accuracy,
  count(*) FILTER (reason IS NULL) / count(*) >= 0.98 AS passed FROM cm""")
def _(s, d):
    return q.accuracy(_compared(s, d)).withColumn("accuracy", F.round("accuracy", 9))


@query("k6_first_failures", f"WITH {v.TX}, {COMPARED} SELECT * FROM cm WHERE reason IS NOT NULL ORDER BY statement_id, row_number LIMIT 10")
def _(s, d):
    return q.first_failures(_compared(s, d), ["statement_id", "row_number"])


@query("k7_confusion", """WITH p AS (SELECT quality AS expected, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id))
SELECT CAST(expected AS INTEGER) AS expected, count(*) FILTER (predicted = 0) AS "0", count(*) FILTER (predicted = 1) AS "1" FROM p GROUP BY ALL""")
def _(s, d):
    return q.confusion_matrix(fx.predictions(s, d), [0, 1])


@query("k7_accuracy", """WITH p AS (SELECT quality AS expected, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id)),
n AS (SELECT count(*) AS total, count(*) FILTER (expected = predicted) AS correct FROM p) SELECT *, CAST(round(correct / total, 9) AS DOUBLE) AS accuracy, correct / total >= 0.80 AS passed FROM n""")
def _(s, d):
    return q.classification_accuracy(fx.predictions(s, d)).withColumn("accuracy", F.round("accuracy", 9))


def _uploaded(s, d):
    """Uploaded templates, one per part, some with a missing field."""
    key = F.col("p_partkey")
    present = {f: key % m != 0 for f, m in zip(tp.REQUIRED, [11, 7, 13, 5, 17])}
    return fx.table(s, d, "part").select(key.alias("template_id"), *[F.when(ok, F.col("p_name")).alias(f) for f, ok in present.items()])


@query("k8_validation", """SELECT p_partkey AS template_id, CASE WHEN p_partkey % 11 = 0 THEN 'missing bank_code' WHEN p_partkey % 7 = 0 THEN 'missing bank_name' WHEN p_partkey % 13 = 0 THEN 'missing type'
  WHEN p_partkey % 5 = 0 THEN 'missing fingerprint' WHEN p_partkey % 17 = 0 THEN 'missing extraction' END AS error FROM part""")
def _(s, d):
    return _uploaded(s, d).select("template_id", tp.validation_error({f: F.col(f) for f in tp.REQUIRED}).alias("error"))


# ---------------------------------------------------------------- masking


@query("r1_mask", f"WITH {DOCS} SELECT doc_id, {v.unbordered(_mask_sql('marked'))} AS masked FROM docs")
def _(s, d):
    return _documents(s, d).select("doc_id", masking.mask_text(F.col("text")).alias("masked"))


@query("r1_mask_conversations", f"SELECT conv_id, turn, {v.unbordered(_mask_sql(v.bordered('text')))} AS masked FROM conversations")
def _(s, d):
    return fx.table(s, d, "conversations").select("conv_id", "turn", masking.mask_text(F.col("text")).alias("masked"))


@query("r2_mask_account", f"WITH {v.TX}, t AS (SELECT id, replace(account_number || ' ' || narration || ' ' || account_number || '9', account_number, '[ACCT]') AS text FROM tx JOIN st USING (statement_id)) SELECT id, {_mask_sql('text')} AS masked FROM t")
def _(s, d):
    accounts = fx.statements(s, d).select("statement_id", "account_number")
    rows = fx.transactions(s, d, clients=False).join(accounts, "statement_id")
    text = F.concat_ws(" ", "account_number", "narration", F.concat("account_number", F.lit("9")))
    return rows.select("id", masking.mask_text(text, F.col("account_number")).alias("masked"))


SCAN = " ".join(rf"WHEN regexp_matches(marked, '{p}') THEN '{k}'" for k, p in [
    ("CARD", r"\b(?:\d[\s-]?){13,19}\b"), ("AADHAAR", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"), ("PAN", r"(?i)\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("PHONE", r"(?:\+91[\s-]?|0)?[6-9]\d{9}\b"), ("ACCT", r"\b\d{9,18}\b")])


@query("r3_violations", f"WITH {DOCS} SELECT doc_id, CASE {SCAN} END AS violation FROM docs")
def _(s, d):
    return _documents(s, d).select("doc_id", masking.first_violation(F.col("text")).alias("violation"))


@query("r3_violation_counts", f"WITH {DOCS}, s AS (SELECT CASE {SCAN} END AS violation FROM (SELECT {_mask_sql('marked')} AS marked FROM docs)) SELECT coalesce(violation, 'none') AS violation, count(*) AS n FROM s GROUP BY ALL")
def _(s, d):
    masked = _documents(s, d).select(masking.mask_text(F.col("text")).alias("text"))
    return masked.groupBy(F.coalesce(masking.first_violation(F.col("text")), F.lit("none")).alias("violation")).agg(F.count(F.lit(1)).alias("n"))


def _redact_sql(t: str) -> str:
    for token, pattern in [("[ACCT]", r"\b\d{9,18}\b"), ("[PAN]", r"(?i)\b[A-Z]{5}\d{4}[A-Z]\b"), ("[PHONE]", r"(?:\+91[\s-]?|0)?[6-9]\d{9}\b"),
                           ("[IFSC]", r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b"), ("[EMAIL]", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b")]:
        t = f"regexp_replace({t}, '{pattern}', '{token}', 'g')"
    return t


@query("r4_redact_log", f"WITH {DOCS} SELECT doc_id, {v.unbordered(_redact_sql('marked'))} AS redacted FROM docs")
def _(s, d):
    return _documents(s, d).select("doc_id", masking.redact_log(F.col("text")).alias("redacted"))


@query("r5_scrub_record", f"""WITH {DOCS} SELECT doc_id, source, {v.unbordered(_redact_sql('marked'))} AS body, {v.unbordered(_redact_sql("'call 9876543210 or ' || marked"))} AS note, n_chars FROM docs""")
def _(s, d):
    docs = _documents(s, d)
    record = docs.select("doc_id", F.struct(
        "n_chars", F.create_map(F.lit("body"), F.col("text")).alias("fields"),
        F.array(F.struct(F.concat(F.lit("call 9876543210 or "), "text").alias("note"), F.col("source"))).alias("notes")).alias("record"))
    note = F.get("record.notes", F.lit(0))
    return masking.scrub_record(record, "record").select(
        "doc_id", note.source.alias("source"), F.col("record.fields")["body"].alias("body"), note.note.alias("note"), "record.n_chars")


# ---------------------------------------------------------------- streaming: batch forms and the streams themselves

RATES = f"""{v.EVENTS}, mn AS (SELECT bank_code, time_bucket(INTERVAL 1 MINUTE, ts) AS m, count(*) AS n, count(*) FILTER (status IN ('FAILED', 'PARSE_ERROR')) AS f FROM ev GROUP BY ALL),
wi AS (SELECT bank_code, m - to_minutes(k) AS window_start, n, f FROM mn, (SELECT unnest(range(60)) AS k)),
ra AS (SELECT bank_code, window_start, CAST(sum(n) AS BIGINT) AS total, CAST(sum(f) AS BIGINT) AS failures FROM wi GROUP BY ALL)"""


@query("t1_window_rates", f"""WITH {RATES} SELECT bank_code, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, total, failures FROM ra""")
def _(s, d):
    rates = jobs.failure_rates(fx.status_events(s, d))
    return rates.select("bank_code", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "total", "failures")


@query("t1_window_rates_stream", f"""WITH {RATES} SELECT bank_code, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, total, failures FROM ra
WHERE window_start + INTERVAL 1 HOUR <= (SELECT time_bucket(INTERVAL 1 MINUTE, max(ts) - INTERVAL 10 MINUTE) FROM ev)""")
def _(s, d):
    out = work_dir(s, "rates")
    jobs.stream_failure_rates(fx.event_columns(_event_stream(s, d)), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    # The watermark decides window by window; windows that end in its last minutes may still be open.
    limit = fx.status_events(s, d).agg(F.date_trunc("minute", F.max("ts") - F.expr("interval 10 minutes")))
    rows = s.read.parquet(f"{out}/table").filter(F.col("window_end") <= limit.scalar())
    return rows.select("bank_code", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "total", "failures")


def _event_stream(s, d):
    schema = fx.table(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


HELD = """br AS (SELECT *, failures / total > 0.05 AS b FROM ra),
op AS (SELECT *, CASE WHEN b AND lag(b) OVER w AND date_diff('second', lag(window_start) OVER w, window_start) = 60 THEN 0 ELSE 1 END AS o FROM br WINDOW w AS (PARTITION BY bank_code ORDER BY window_start)),
rn AS (SELECT *, sum(o) OVER (PARTITION BY bank_code ORDER BY window_start ROWS UNBOUNDED PRECEDING) AS r FROM op),
he AS (SELECT *, CAST(row_number() OVER (PARTITION BY bank_code, r ORDER BY window_start) AS INTEGER) AS held_for FROM rn)"""


@query("t2_held_alerts", f"WITH {RATES}, {HELD} SELECT bank_code, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, held_for FROM he WHERE b AND held_for >= 5")
def _(s, d):
    held = jobs.held_alerts(jobs.failure_rates(fx.status_events(s, d)))
    return held.select("bank_code", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "held_for")


CLOSED = "window_start + INTERVAL 1 HOUR <= (SELECT time_bucket(INTERVAL 1 MINUTE, max(ts) - INTERVAL 10 MINUTE) FROM ev)"


@query("t2_held_alerts_stream", f"WITH {RATES}, {HELD} SELECT bank_code, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, held_for FROM he WHERE b AND held_for >= 5 AND {CLOSED}")
def _(s, d):
    """Two jobs in a row: windows as they close, then the hold rule over them."""
    out = work_dir(s, "alerts")
    jobs.stream_failure_rates(fx.event_columns(_event_stream(s, d)), f"{out}/rates", f"{out}/rates-checkpoint").awaitTermination()
    rates = s.readStream.schema(s.read.parquet(f"{out}/rates").schema).parquet(f"{out}/rates")
    jobs.stream_alerts(rates, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    limit = fx.status_events(s, d).agg(F.date_trunc("minute", F.max("ts") - F.expr("interval 10 minutes")))
    held = s.read.parquet(f"{out}/table").filter(F.col("window_start") + F.expr("interval 1 hour") <= limit.scalar())
    return held.select("bank_code", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "held_for")


@query("t3_parse_stream", f"WITH {v.TX} SELECT bank_code, statement_id, row_number, txn_date, 'REF' || id AS reference_no, debit, credit, balance FROM tx")
def _(s, d):
    return _parsed_stream(s, d, None).select("bank_code", "statement_id", "row_number", "txn_date", "reference_no", "debit", "credit", "balance")


def _parsed_stream(s, d, enrich):
    """Cell rows arrive in three parts, each with a third of every statement, in a batch each; the last run finds nothing new.

    A part is a file of each task that writes it, so no task takes a whole one; it arrives by a move, without a second copy. The rows that
    transactions begin with come last.
    """
    out = work_dir(s, "statements")
    cells = fx.raw_rows(s, d)
    with shuffles_freed(s):
        cells.withColumn("part", F.col("row_idx") % 3).write.partitionBy("part").parquet(f"{out}/parts")
    for part in (2, 1, 0, None):
        if part is not None:
            move_path(s, f"{out}/parts/part={part}", f"{out}/in")
        rows = s.readStream.schema(cells.schema).option("recursiveFileLookup", "true").parquet(f"{out}/in")
        jobs.stream_statements(rows, tp.catalogue, f"{out}/table", f"{out}/checkpoint", enrich).awaitTermination()
    return jobs.read_statements(s, f"{out}/table")


def _stored(s, tables):
    """The tables, written and read back: what is asked in every batch is derived once."""
    out = work_dir(s, "stored")
    with shuffles_freed(s):
        for name, table in tables.items():
            table.write.parquet(f"{out}/{name}")
    return {name: s.read.schema(table.schema).parquet(f"{out}/{name}") for name, table in tables.items()}


def _answers_to(rows, answers):
    """Of the answers, the batches that hold one to a row of `rows`, whole: a batch is checked and resolved as a whole."""
    asked = answers.join(rows.select("id").distinct(), "id", "left_semi").select("statement_id", "batch_no").distinct()
    return answers.join(asked, ["statement_id", "batch_no"], "left_semi")


# The transactions as they are parsed: with the narration of a second row.
CONTINUED = v.TX.replace(", tx AS (", ", tx0 AS (") + ", tx AS (SELECT * REPLACE (narration || CASE WHEN id % 4 = 0 THEN ' MORE ' || id ELSE '' END AS narration) FROM tx0)"


@query("t4_enrich_stream", f"WITH {v.EN.replace(v.TX, CONTINUED)}, {PRECEDENCE}")
def _(s, d):
    """Fresh rows as they are parsed, all of them, by rules, recurring payments, cache, answers and the heuristic. A narration may go on
    in a second row, which may come in another batch."""
    whole = F.concat("narration", F.when(F.col("id") % 4 == 0, F.concat(F.lit(" MORE "), F.col("id").cast("string"))).otherwise(""))
    known = fx.cleaned(fx.transactions(s, d).withColumn("narration", whole))
    stored = _stored(s, {
        "mappings": me.learn(fx.confirmed(known)), "history": en.recent_history(known), "answers": fx.answers(s, d),
        "cache": fx.cache_of(fx.hashed(fx.transactions(s, d, numbered=True, clients=False).withColumn("narration", whole))),
    })

    def fill(parsed):
        rows = fx.hashed(fx.with_clients(parsed, s, d).withColumn("id", F.substring("reference_no", 4, 20).cast("bigint")))
        return en.enrich_missing(rows, fx.rules(s, d), stored["mappings"], stored["history"], stored["cache"], _answers_to(rows, stored["answers"]), ledgers=fx.ledgers(s, d))

    return _parsed_stream(s, d, fill).select("id", "narration_clean", "suggested_ledger", "confidence", "source")


def _enriched_stream(s, d):
    return _parsed_stream(s, d, lambda parsed: en.enrich(fx.with_clients(parsed, s, d), fx.rules(s, d)))


@query("t4_enrich_stream_whole", f"""WITH {v.EN.replace(v.TX, CONTINUED)}, {v.RULED} SELECT statement_id, row_number, narration, coalesce(h.ledger_name, suggested_ledger) AS suggested_ledger,
  CASE WHEN h.id IS NOT NULL THEN 'rule' ELSE 'heuristic' END AS source FROM en LEFT JOIN (SELECT * FROM hit WHERE n = 1) h ON h.id = en.id""")
def _(s, d):
    """Rules and the heuristic on all fresh rows, also those whose narration goes on in a second row, which may come in another batch."""
    return _enriched_stream(s, d).select("statement_id", "row_number", "narration", "suggested_ledger", "source")


LATEST = f"WITH {v.EVENTS} SELECT statement_id, arg_max(status, {{'t': ts, 'e': event_id}}) AS status, CAST(count(*) AS BIGINT) AS changes FROM ev GROUP BY ALL"


@query("t5_latest_status", LATEST)
def _(s, d):
    return jobs.latest_status(fx.status_events(s, d)).select("statement_id", "status", "changes")


@query("t5_latest_status_stream", LATEST)
def _(s, d):
    """The events arrive in several batches, a third of them twice; two batches make a snapshot, the last one is read beside it."""
    out = work_dir(s, "status")
    events = fx.status_events(s, d)
    for part in range(3):
        events.filter((F.col("event_id") % 3 == part) | ((F.col("event_id") % 3 == 0) & F.lit(part == 2))).coalesce(1).write.mode("append").parquet(f"{out}/in")
        arriving = s.readStream.schema(events.schema).parquet(f"{out}/in")
        jobs.stream_latest_status(arriving, f"{out}/table", f"{out}/checkpoint", compact_every=2).awaitTermination()
    return jobs.read_latest(s, f"{out}/table").select("statement_id", "status", "changes")


@query("t6_progress", """WITH p AS (SELECT event_id, event_id // 5 AS job_id, ts, user_id % 7 AS cur, user_id % 5 AS tot FROM events)
SELECT job_id, CAST(arg_max(least(greatest(20 + (55 * cur) // greatest(tot, 1), 0), 100), {'t': ts, 'e': event_id}) AS BIGINT) AS percent FROM p GROUP BY job_id HAVING max(ts) > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR""")
def _(s, d):
    events = fx.table(s, d, "events").select(
        "event_id", F.floor(F.col("event_id") / 5).alias("job_id"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") % 7).alias("current"), (F.col("user_id") % 5).alias("total"))
    return jobs.job_progress(events, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("job_id", F.col("percent").cast("bigint").alias("percent"))


@query("t7_template_changes", """SELECT p_partkey AS code, CASE WHEN p_partkey % 10 = 0 THEN 'added' WHEN p_partkey % 10 = 1 THEN 'deleted' ELSE 'modified' END AS change FROM part WHERE p_partkey % 10 IN (0, 1, 2)""")
def _(s, d):
    part, key = fx.table(s, d, "part"), F.col("p_partkey")
    old = part.filter("p_partkey % 10 <> 0").select(key.alias("code"), F.xxhash64("p_name").alias("version"))
    new = part.filter("p_partkey % 10 <> 1").select(key.alias("code"), F.xxhash64(F.when(key % 10 == 2, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))).alias("version"))
    return tp.catalogue_changes(old, new)


@query("t7_template_changes_stream", """SELECT CAST(2 AS BIGINT) AS version, CAST(p_partkey AS VARCHAR) AS code, CASE WHEN p_partkey % 10 = 0 THEN 'added' WHEN p_partkey % 10 = 1 THEN 'deleted' ELSE 'modified' END AS change FROM part WHERE p_partkey % 10 IN (0, 1, 2)
UNION ALL SELECT 3, CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 10 = 1 THEN 'added' ELSE 'deleted' END FROM part WHERE p_partkey % 10 IN (1, 3)""")
def _(s, d):
    """Three versions of a catalogue arrive as files, a batch each; the stream is then started again and finds nothing new."""
    out = work_dir(s, "catalogue")
    part, key = fx.table(s, d, "part"), F.col("p_partkey")
    left_out = {1: 0, 2: 1, 3: 3}
    for version, gone in left_out.items():
        name = F.when((key % 10 == 2) & F.lit(version > 1), F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
        rows = part.filter(key % 10 != gone).select(F.lit(version).cast("long").alias("version"), key.cast("string").alias("code"), F.sha2(name, 256).alias("fingerprint"))
        rows.coalesce(1).write.mode("append").parquet(f"{out}/in")
    versions = s.readStream.schema("version long, code string, fingerprint string").option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    for _ in range(2):
        jobs.stream_template_changes(versions, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return jobs.read_template_changes(s, f"{out}/table")


# ---------------------------------------------------------------- validation


SPOILT = """sp AS (SELECT id, statement_id, row_number, CASE WHEN id % 23 = 0 THEN txn_date - 400 ELSE txn_date END AS txn_date, debit, credit, narration, CAST(NULL AS VARCHAR) AS reference_no,
  CASE WHEN id % 19 = 0 THEN CAST(balance + 5 AS DECIMAL(18,2)) ELSE balance END AS balance FROM tx),
pr AS (SELECT *, lag(balance) OVER w AS pb, lag(txn_date) OVER w AS pd FROM sp WINDOW w AS (PARTITION BY statement_id ORDER BY row_number)),
fl AS (SELECT *, coalesce(abs(pb + coalesce(credit, 0) - coalesce(debit, 0) - balance) > 0.01, false) AS bad_balance, coalesce(txn_date < pd, false) AS bad_date FROM pr)"""


def _spoilt(s, d):
    """Transactions with some wrong balances and dates."""
    tx = fx.transactions(s, d, numbered=True, clients=False)
    return tx.withColumns({
        "txn_date": F.when(F.col("id") % 23 == 0, F.date_sub("txn_date", 400)).otherwise(F.col("txn_date")),
        "balance": F.when(F.col("id") % 19 == 0, (F.col("balance") + 5).cast("decimal(18,2)")).otherwise(F.col("balance")),
        "reference_no": F.lit(None).cast("string"),
    })


def _checked(s, d):
    return ck.with_previous(_spoilt(s, d), fx.long_statements(s, d))


@query("v1_balance_check", f"WITH {v.TX}, {SPOILT} SELECT id, bad_balance FROM fl")
def _(s, d):
    return _checked(s, d).select("id", ck.balance_fails().alias("bad_balance"))


@query("v2_date_order", f"WITH {v.TX}, {SPOILT} SELECT id, bad_date FROM fl")
def _(s, d):
    return _checked(s, d).select("id", ck.date_goes_back().alias("bad_date"))


BALANCES = """ba AS (SELECT statement_id, CAST(arg_min(balance - coalesce(credit, 0) + coalesce(debit, 0), row_number) AS DECIMAL(18,2)) AS opening_balance, arg_max(balance, row_number) AS closing_balance,
  min(txn_date) AS period_start, max(txn_date) AS period_end, CAST(sum(coalesce(credit, 0) - coalesce(debit, 0)) AS DECIMAL(28,2)) AS net_movement FROM sp GROUP BY ALL)"""


@query("v3_sum_check", f"WITH {v.TX}, {SPOILT}, {BALANCES} SELECT statement_id, net_movement, abs(opening_balance + net_movement - closing_balance) <= 0.01 AS sum_ok FROM ba")
def _(s, d):
    return ck.statement_balances(_spoilt(s, d)).select("statement_id", "net_movement", "sum_ok")


def _copied(s, d):
    """Rows with every tenth one repeated under a new id."""
    tx = fx.transactions(s, d, clients=False).withColumn("reference_no", F.lit(None).cast("string"))
    return tx.unionByName(tx.filter("id % 10 = 0").withColumn("id", -F.col("id") - 1))


@query("v4_duplicates", f"""WITH {v.TX}, cp AS (SELECT id, statement_id, txn_date, debit, credit, narration FROM tx UNION ALL SELECT -id - 1, statement_id, txn_date, debit, credit, narration FROM tx WHERE id % 10 = 0)
SELECT id, count(*) OVER (PARTITION BY statement_id, txn_date, debit, credit, narration) > 1 AS is_duplicate FROM cp""")
def _(s, d):
    return ck.mark_duplicates(_copied(s, d)).select("id", "is_duplicate")


@query("v5_warnings", f"""WITH {v.TX}, {SPOILT}, du AS (SELECT *, count(*) OVER (PARTITION BY statement_id, txn_date, debit, credit, narration) > 1 AS dup FROM fl)
SELECT id, concat_ws(',', CASE WHEN bad_balance THEN 'balance_mismatch' END, CASE WHEN bad_date THEN 'date_order' END, CASE WHEN dup THEN 'duplicate' END) AS warnings FROM du""")
def _(s, d):
    return ck.with_warnings(_spoilt(s, d), fx.long_statements(s, d)).select("id", F.array_join("validation_warnings", ",").alias("warnings"))


def _header_texts(s, d):
    """Text above the header row of each customer's statement; one in five shows only the IFSC of its bank."""
    key = F.col("c_custkey")
    bank = key % len(tp.BANKS)
    name, prefix = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, b in enumerate(tp.BANKS):
        name, prefix = F.when(bank == i, b[2]).otherwise(name), F.when(bank == i, b[4]).otherwise(prefix)
    ifsc = F.concat(F.lit("IFSC : "), prefix, F.lit("000"), F.lpad((key % 10000).cast("string"), 4, "0"))
    text = F.concat_ws("\n", F.when(key % 5 != 0, name), F.lit("Account Statement"), F.concat(F.lit("Account Holder: Cust Omer "), F.lit("A B")),
                       F.concat(F.lit("A/c No: "), F.lpad(key.cast("string"), 12, "5")), ifsc)
    return fx.table(s, d, "customer").select(key.alias("statement_id"), text.alias("header_text"))


@query("v6_detect_bank", f"SELECT c_custkey AS statement_id, CASE c_custkey % {len(CASES)} {' '.join(f'''WHEN {i} THEN '{c}' ''' for i, c in enumerate(CASES))} END AS bank_code FROM customer")
def _(s, d):
    return ck.detect_bank(_header_texts(s, d), tp.catalogue(s)).select("statement_id", "bank_code")


@query("v6_own_bank", "SELECT c_custkey AS statement_id, CASE WHEN c_custkey % 7 = 0 THEN 'harbour' WHEN c_custkey % 7 = 1 THEN 'hdfc' END AS bank_code FROM customer")
def _(s, d):
    """A bank that the user has added to the catalogue, one that is built in, and headers that name no bank."""
    own = s.createDataFrame([("harbour", "HARB", "Harbour Trust", "pdf_text", ["Date"], {"date": 0}, "%d/%m/%Y", ["Harbour Trust"], ["IFSC HARB0"])], tp.SCHEMA)
    key = F.col("c_custkey")
    text = F.concat(F.lit("Statement\n"), F.when(key % 7 == 0, "Harbour Trust of Goa").when(key % 7 == 1, "IFSC: HDFC0001234").otherwise("Ledger"))
    rows = fx.table(s, d, "customer").select(key.alias("statement_id"), text.alias("header_text"))
    return ck.detect_bank(rows, tp.catalogue(s).unionByName(own)).select("statement_id", "bank_code")


@query("v7_balances_period", f"WITH {v.TX}, {SPOILT}, {BALANCES} SELECT statement_id, opening_balance, closing_balance, period_start, period_end FROM ba")
def _(s, d):
    return ck.statement_balances(_spoilt(s, d)).select("statement_id", "opening_balance", "closing_balance", "period_start", "period_end")


STITCH = """ap AS (SELECT o_custkey AS account_number, o_orderkey AS statement_id, CAST(o_orderdate AS DATE) AS ps, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS pe FROM orders),
b AS (SELECT *, max(pe) OVER (PARTITION BY account_number ORDER BY ps, statement_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ap),
g AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR ps > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY account_number ORDER BY ps, statement_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stitch_no FROM b)"""


@query("v8_stitched", f"WITH {STITCH} SELECT account_number, stitch_no, count(*) AS parts, min(ps) AS period_start, max(pe) AS period_end FROM g GROUP BY ALL")
def _(s, d):
    return ck.stitched(fx.account_periods(s, d))


@query("v9_header_fields", f"""SELECT c_custkey AS statement_id, lpad(CAST(c_custkey AS VARCHAR), 12, '5') AS account_number, CASE c_custkey % {len(tp.BANKS)} {' '.join(f'''WHEN {i} THEN '{b[4]}' ''' for i, b in enumerate(tp.BANKS))} END
  || '000' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS ifsc, 'Cust Omer A B' AS holder FROM customer""")
def _(s, d):
    return _header_texts(s, d).select("statement_id", *ck.header_fields(F.col("header_text")))


@query("v10_retention", f"WITH {v.TX} SELECT id FROM tx WHERE txn_date < DATE '2003-06-15' - INTERVAL 7 YEAR")
def _(s, d):
    return ck.past_retention(fx.transactions(s, d, clients=False), "txn_date", F.lit("2003-06-15").cast("date"), years=ck.TRANSACTION_YEARS).select("id")


@query("v11_edit_rate", """WITH se AS (SELECT o_custkey % 100 AS session_id, o_orderkey AS id FROM orders), sh AS (SELECT session_id, count(*) AS shown FROM se GROUP BY ALL),
e AS (SELECT session_id, count(DISTINCT id) AS edited FROM se WHERE id % 6 IN (0, 2, 3) GROUP BY ALL) SELECT session_id, shown, coalesce(edited, 0) AS edited, CAST(round(coalesce(edited, 0) / shown, 9) AS DOUBLE) AS edit_rate FROM sh LEFT JOIN e USING (session_id)""")
def _(s, d):
    sessions = fx.table(s, d, "orders").select((F.col("o_custkey") % 100).alias("session_id"), F.col("o_orderkey").alias("id"))
    changed = sessions.join(fx.edits(s, d).select("id"), "id")
    return ck.edit_rate(changed, sessions).withColumn("edit_rate", F.round("edit_rate", 9))


@query("v12_by_firm", f"WITH {v.TX} SELECT id, CAST(firm_id AS INTEGER) AS firm_id FROM tx WHERE firm_id = 3")
def _(s, d):
    path = work_dir(s, "by-firm")
    ck.write_by_firm(fx.transactions(s, d).select("id", "statement_id", "firm_id"), path)
    return s.read.parquet(path).filter("firm_id = 3").select("id", "firm_id")
