"""Queries E1-E18, C1-C10 and M1-M8."""

from pyspark.sql import functions as F

from vouchline.functions import text
from vouchline.operators import cache as ca, enrich as en, memory as me
from vouchline.plans.registry import query
from vouchline.plans import views as v
from vouchline.session import work_dir
from vouchline.sources import fixtures as fx

RESULT = "narration_clean, payment_mode, counterparty, suggested_ledger, confidence"


@query("e1_clean_narration", f"WITH {v.EN} SELECT id, narration_clean FROM en")
def _(s, d):
    return fx.transactions(s, d, clients=False).select("id", text.clean_narration(F.col("narration")).alias("narration_clean"))


@query("e2_payment_mode", f"WITH {v.EN} SELECT id, payment_mode FROM en")
def _(s, d):
    return fx.transactions(s, d, clients=False).select("id", text.payment_mode(F.lower("narration")).alias("payment_mode"))


@query("e3_counterparty", f"WITH {v.EN} SELECT id, counterparty FROM en")
def _(s, d):
    return fx.transactions(s, d, clients=False).withColumn("c", text.clean_narration(F.col("narration"))).select("id", text.counterparty(F.col("c")).alias("counterparty"))


@query("e4_ledger_hint", f"WITH {v.EN} SELECT id, suggested_ledger FROM en")
def _(s, d):
    return fx.transactions(s, d, clients=False).select("id", text.ledger_hint(F.lower("narration"), F.col("debit"), F.col("credit")).alias("suggested_ledger"))


@query("e5_confidence", f"WITH {v.EN} SELECT id, confidence FROM en")
def _(s, d):
    return en.heuristic(fx.transactions(s, d, clients=False, spread=True)).select("id", "confidence")


@query("e6_heuristic", f"WITH {v.EN} SELECT id, {RESULT}, 'heuristic' AS source, 'FALLBACK' AS cache_status FROM en")
def _(s, d):
    return en.heuristic(fx.transactions(s, d, clients=False, spread=True)).select("id", *en.RESULT, "source", "cache_status")


@query("e7_rules", f"WITH {v.TX}, {v.RULED} SELECT id, rule_id, ledger_name FROM hit WHERE n = 1")
def _(s, d):
    return en.apply_rules(fx.transactions(s, d), fx.rules(s, d)).filter("rule is not null").select("id", "rule.rule_id", "rule.ledger_name")


MANY_RULES = "hit AS (SELECT a.id, max(b.id) AS rule_id FROM tx a JOIN tx b ON a.client_id = b.client_id AND contains(a.narration, CAST(b.id AS VARCHAR)) GROUP BY ALL)"


@query("e7_many_rules", f"WITH {v.TX}, {MANY_RULES} SELECT id, rule_id FROM hit")
def _(s, d):
    """A rule for every transaction of a client, the newest first: clients with far more rules than one array holds."""
    tx = fx.transactions(s, d)
    rules = tx.select("client_id", F.col("id").alias("rule_id"), (-F.col("id")).cast("int").alias("priority"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
                      F.lit("contains").alias("match_type"), F.col("id").cast("string").alias("pattern"), F.lit("Own").alias("ledger_name"), F.lit(True).alias("is_active"))
    return en.apply_rules(tx, rules).filter("rule is not null").select("id", "rule.rule_id")


@query("e8_rule_dry_run", f"""WITH {v.TX}, {v.RULES}, ok AS (SELECT * FROM ru WHERE is_active AND pattern <> '(unclosed')
SELECT rule_id, count(id) AS matches, arg_min(narration, id) AS sample FROM ok LEFT JOIN tx ON tx.client_id = ok.client_id AND {v.RULE_HIT} GROUP BY rule_id""")
def _(s, d):
    return en.rule_dry_run(fx.transactions(s, d), fx.rules(s, d))


@query("e9_recurring", f"WITH {v.TX}, {v.MP}, {v.RECURRING} SELECT id, recurring_ledger FROM rec")
def _(s, d):
    tx = fx.cleaned(fx.transactions(s, d))
    return en.mark_recurring(tx, me.learn(fx.confirmed(tx)), en.recent_history(tx)).filter("recurring_ledger is not null").select("id", "recurring_ledger")


@query("e9_recurring_long_history", f"WITH {v.TX}, {v.MP}, {v.RECURRING.replace('WHERE n <= 200', '')} SELECT id, recurring_ledger FROM rec")
def _(s, d):
    tx = fx.cleaned(fx.transactions(s, d))
    return en.recurring(tx, me.learn(fx.confirmed(tx)), tx.filter("confirmed_ledger is not null"))


@query("e10_allowed_ledgers", f"WITH {v.TX}, {v.MP}, {v.LEDGERS} SELECT client_id, name AS ledger_name FROM lg UNION SELECT client_id, ledger_name FROM mp")
def _(s, d):
    return en.allowed_ledgers(fx.ledgers(s, d), me.learn(fx.confirmed(fx.transactions(s, d))))


ALLOWED = """al AS (SELECT client_id, lower(name) AS k, min(name) AS spelling FROM (SELECT client_id, name FROM lg UNION SELECT client_id, ledger_name FROM mp) GROUP BY ALL),
va AS (SELECT an.*, coalesce(spelling, suggested_ledger) AS checked, EXISTS (SELECT 1 FROM al a WHERE a.client_id = an.client_id) AND suggested_ledger IS NOT NULL AND spelling IS NULL AS ledger_invalid
  FROM an LEFT JOIN al ON al.client_id = an.client_id AND k = lower(suggested_ledger))"""


@query("e11_validate_ledgers", f"""WITH {v.TX}, {v.MP}, {v.LEDGERS}, {v.ANSWERS}, {ALLOWED}
SELECT id, tier, checked AS suggested_ledger, ledger_invalid, bool_or(ledger_invalid) OVER (PARTITION BY statement_id, batch_no, tier) AS batch_rejected FROM va""")
def _(s, d):
    allowed = en.allowed_ledgers(fx.ledgers(s, d), me.learn(fx.confirmed(fx.transactions(s, d))))
    return en.validate_answers(fx.answers(s, d), allowed).select("id", "tier", "suggested_ledger", "ledger_invalid", "batch_rejected")


RESOLVED = f"""{v.LEDGERS}, {ALLOWED}, ok AS (SELECT id, statement_id, batch_no, tier, checked AS suggested_ledger FROM va QUALIFY NOT bool_or(ledger_invalid) OVER (PARTITION BY statement_id, batch_no, tier)),
best AS (SELECT statement_id, batch_no, min(tier) AS tier FROM ok GROUP BY ALL),
res AS (SELECT ok.* FROM ok JOIN best USING (statement_id, batch_no, tier))"""


def _resolved(s, d):
    allowed = en.allowed_ledgers(fx.ledgers(s, d), me.learn(fx.confirmed(fx.transactions(s, d))))
    return en.resolve_tiers(en.validate_answers(fx.answers(s, d), allowed))


@query("e12_resolve_tiers", f"WITH {v.TX}, {v.MP}, {v.ANSWERS}, {RESOLVED} SELECT id, tier, suggested_ledger FROM res")
def _(s, d):
    return _resolved(s, d).select("id", "tier", "suggested_ledger")


PRECEDENCE = f"""{v.RULED}, {v.MP}, {v.RECURRING}, {v.HASHED}, {v.CACHE}, {v.ANSWERS}, {RESOLVED}
SELECT en.id, CASE WHEN h.id IS NULL AND rec.id IS NULL AND ca.first_id IS NOT NULL THEN 'Cached ' || CAST(ca.first_id AS VARCHAR)
    WHEN h.id IS NULL AND rec.id IS NULL AND res.id IS NOT NULL THEN 'Answer ' || CAST(res.id AS VARCHAR) ELSE narration_clean END AS narration_clean,
  CASE WHEN h.id IS NOT NULL THEN h.ledger_name WHEN rec.id IS NOT NULL THEN recurring_ledger WHEN ca.first_id IS NOT NULL THEN 'Cached Ledger'
    WHEN res.id IS NOT NULL THEN res.suggested_ledger ELSE en.suggested_ledger END AS suggested_ledger,
  CAST(CASE WHEN h.id IS NOT NULL THEN 1.000 WHEN rec.id IS NOT NULL THEN 0.920 WHEN ca.first_id IS NOT NULL THEN 0.770 WHEN res.id IS NOT NULL THEN 0.880 ELSE confidence END AS DECIMAL(4,3)) AS confidence,
  CASE WHEN h.id IS NOT NULL THEN 'rule' WHEN rec.id IS NOT NULL THEN 'recurring' WHEN ca.first_id IS NOT NULL THEN 'claude'
    WHEN res.id IS NOT NULL THEN CASE res.tier WHEN 1 THEN 'claude' WHEN 2 THEN 'claude-fallback' ELSE 'gpt4o-fallback' END ELSE 'heuristic' END AS source
FROM en JOIN hx USING (id) LEFT JOIN (SELECT * FROM hit WHERE n = 1) h ON h.id = en.id LEFT JOIN rec ON rec.id = en.id
  LEFT JOIN ca ON ca.content_hash = hx.content_hash LEFT JOIN res ON res.id = en.id"""


@query("e13_precedence", f"WITH {v.EN}, {PRECEDENCE}")
def _(s, d):
    tx = fx.hashed(fx.transactions(s, d, numbered=True))
    out = en.enrich(tx, fx.rules(s, d), me.learn(fx.confirmed(fx.transactions(s, d))), None, fx.cache(s, d), fx.answers(s, d), ledgers=fx.ledgers(s, d))
    return out.select("id", "narration_clean", "suggested_ledger", "confidence", "source")


@query("e14_apply_results", f"""WITH {v.EN}, {v.MP}, {v.ANSWERS}, {RESOLVED} SELECT en.id,
  CASE WHEN res.id IS NOT NULL THEN 'Answer ' || CAST(res.id AS VARCHAR) ELSE narration_clean END AS narration_clean,
  CASE WHEN res.id IS NOT NULL THEN res.suggested_ledger ELSE en.suggested_ledger END AS suggested_ledger FROM en LEFT JOIN res ON res.id = en.id""")
def _(s, d):
    tx = en.heuristic(fx.transactions(s, d))
    return en.apply_results(tx, _resolved(s, d)).select("id", "narration_clean", "suggested_ledger")


WORK = "wk AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY row_number) AS nth FROM en WHERE payment_mode IS NULL OR id % 2 = 0)"


def _part_done(s, d):
    """Heuristic results with the confidence blanked for even ids, so that those count as not enriched."""
    tx = en.heuristic(fx.transactions(s, d, numbered=True))
    return tx.withColumn("confidence", F.when(F.col("id") % 2 != 0, F.col("confidence")))


@query("e15_pick_work", f"WITH {v.EN}, {WORK} SELECT id, statement_id, row_number FROM wk WHERE nth <= 5")
def _(s, d):
    return en.pick_work(_part_done(s, d), limit=5).select("id", "statement_id", "row_number")


@query("e16_batches", f"""WITH {v.EN}, {WORK} SELECT id, (nth - 1) // 50 AS batch_no FROM wk""")
def _(s, d):
    return en.number_batches(en.pick_work(_part_done(s, d)), hot=fx.long_statements(s, d)).select("id", "batch_no")


def _mask_sql(t: str) -> str:
    for token, pattern in [("[CARD]", r"\b(?:\d[\s-]?){13,19}\b"), ("[AADHAAR]", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"), ("[PAN]", r"(?i)\b[A-Z]{5}\d{4}[A-Z]\b"),
                           ("[IFSC]", r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b"), ("[PHONE]", r"(?:\+91[\s-]?|0)?[6-9]\d{9}\b"), ("[ACCT]", r"\b\d{9,18}\b")]:
        t = f"regexp_replace({t}, '{pattern}', '{token}', 'g')"
    return t


@query("e17_request_rows", f"""WITH {v.TX} SELECT id, '{{"id":"' || id || '","date":"' || strftime(txn_date, '%Y-%m-%d') || '","narration":"' || {_mask_sql('narration')}
  || '","debit":' || coalesce('"' || CAST(debit AS VARCHAR) || '"', 'null') || ',"credit":' || coalesce('"' || CAST(credit AS VARCHAR) || '"', 'null')
  || ',"balance":"' || CAST(balance AS VARCHAR) || '"}}' AS request FROM tx""")
def _(s, d):
    return en.request_rows(fx.transactions(s, d, numbered=True, clients=False))


# ---------------------------------------------------------------- cache


@query("c1_content_hash", f"WITH {v.TX}, {v.HASHED} SELECT id, content_hash FROM hx")
def _(s, d):
    return fx.hashed(fx.transactions(s, d, numbered=True, clients=False)).select("id", "content_hash")


LOOKED_UP = f"""WITH {v.TX}, {v.HASHED}, {v.CACHE} SELECT id, ca.first_id IS NOT NULL AS cache_hit,
  'Cached ' || CAST(first_id AS VARCHAR) AS narration_clean FROM hx LEFT JOIN ca USING (content_hash)"""


@query("c2_lookup", LOOKED_UP)
def _(s, d):
    tx = fx.hashed(fx.transactions(s, d, numbered=True, clients=False))
    return ca.lookup(tx, fx.cache(s, d)).select("id", "cache_hit", "narration_clean")


UPSERTED = f"""WITH {v.TX}, {v.HASHED}, {v.CACHE}, fr AS (SELECT content_hash, min(id) AS new_id FROM hx WHERE id % 6 = 0 GROUP BY ALL)
SELECT content_hash, CASE WHEN first_id IS NULL THEN 'openai' ELSE 'anthropic' END AS provider,
  CASE WHEN new_id IS NULL THEN 'Cached ' || CAST(first_id AS VARCHAR) ELSE 'New ' || CAST(new_id AS VARCHAR) END AS response,
  coalesce(hit_count, 0) AS hit_count, CASE WHEN new_id IS NULL THEN DATE '2024-01-01' ELSE DATE '2024-02-01' END AS last_used_at
FROM ca FULL JOIN fr USING (content_hash)"""


def _answers_old_and_new(s, d):
    old = fx.cache(s, d).select("content_hash", "provider", "model", F.col("narration_clean").alias("response"), "hit_count", F.col("last_used_at").alias("written_at"))
    tx = fx.hashed(fx.transactions(s, d, numbered=True, clients=False)).filter("id % 6 = 0")
    new = tx.groupBy("content_hash").agg(F.min("id").alias("new_id")).select(
        "content_hash", F.lit("openai").alias("provider"), F.lit("model-b").alias("model"), F.concat(F.lit("New "), F.col("new_id").cast("string")).alias("response"),
        F.lit("2024-02-01").cast("date").alias("written_at"))
    zero = {c: F.lit(0) for c in ["prompt_tokens", "completion_tokens", "cost_usd"]}
    return old.withColumns(zero), new.withColumns(zero)


@query("c3_upsert", UPSERTED)
def _(s, d):
    return ca.upsert(*_answers_old_and_new(s, d)).select("content_hash", "provider", "response", "hit_count", "last_used_at")


def _stored(s, *batches):
    """A stored cache that the batches of answers are brought into, one after the other."""
    path = work_dir(s, "answers")
    name = "answers_" + path[-12:]
    ca.stored_cache(s, path, name, 16)
    for batch in batches:
        ca.upsert_stored(batch, name, 16)
    return s.table(name).drop("bucket")


@query("c2_lookup_stored", LOOKED_UP)
def _(s, d):
    """The same answers from a stored cache: only the transactions are shuffled."""
    tx = fx.hashed(fx.transactions(s, d, numbered=True, clients=False))
    stored = _stored(s, _answers_old_and_new(s, d)[0]).select("content_hash", F.col("response").alias("narration_clean"))
    return ca.lookup(tx.drop("narration_clean"), stored).select("id", "cache_hit", "narration_clean")


@query("c3_upsert_stored", UPSERTED)
def _(s, d):
    """Brought into a stored cache in two steps, the second of them twice."""
    old, new = _answers_old_and_new(s, d)
    return _stored(s, old, new, new).select("content_hash", "provider", "response", "hit_count", F.col("last_used_at").cast("date").alias("last_used_at"))


@query("c4_count_hits", f"""WITH {v.TX}, {v.HASHED}, {v.CACHE} SELECT content_hash, hit_count + n AS hit_count, greatest(DATE '2024-01-01', d) AS last_used_at
FROM ca JOIN (SELECT content_hash, count(*) AS n, max(txn_date) AS d FROM hx GROUP BY ALL) USING (content_hash)""")
def _(s, d):
    tx = fx.hashed(fx.transactions(s, d, numbered=True, clients=False))
    return ca.count_hits(fx.cache(s, d), tx.select("content_hash", F.col("txn_date").alias("used_at"))).select("content_hash", "hit_count", "last_used_at")


@query("c5_tokens", f"WITH {v.TX}, {v.HASHED} SELECT id, CAST(greatest(1, length({v.JSON}) // 4) AS INTEGER) AS tokens FROM tx")
def _(s, d):
    body = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in ["balance", "credit", "debit", "narration"]]), {"ignoreNullFields": "false"})
    return fx.transactions(s, d, numbered=True, clients=False).select("id", ca.estimate_tokens(body).alias("tokens"))


PRICED = """pr AS (SELECT *, CASE source WHEN 'claude' THEN 3.00 WHEN 'claude-fallback' THEN 3.00 WHEN 'gpt4o-fallback' THEN 0.15 ELSE 0 END AS pin,
  CASE source WHEN 'claude' THEN 15.00 WHEN 'claude-fallback' THEN 15.00 WHEN 'gpt4o-fallback' THEN 0.60 ELSE 0 END AS pout,
  CASE WHEN source IN ('rule', 'heuristic') THEN 'local' WHEN source = 'gpt4o-fallback' THEN 'openai' ELSE 'anthropic' END AS provider FROM us),
co AS (SELECT *, CAST(round_even(CAST(prompt_tokens * pin + completion_tokens * pout AS DECIMAL(18,8)) / 1000000, 6) AS DECIMAL(10,6)) AS cost_usd FROM pr)"""


@query("c6_cost", f"WITH {v.USAGE}, {PRICED} SELECT event_id, cost_usd FROM co")
def _(s, d):
    return ca.charge(fx.usage(s, d), ca.price_table(s)).select("event_id", "cost_usd")


@query("c7_charge", f"""WITH {v.USAGE}, {PRICED} SELECT event_id, provider, CASE WHEN provider = 'local' THEN 0 ELSE prompt_tokens END AS prompt_tokens,
  CASE WHEN provider = 'local' THEN 0 ELSE completion_tokens END AS completion_tokens, cost_usd FROM co""")
def _(s, d):
    return ca.charge(fx.usage(s, d), ca.price_table(s)).select("event_id", "provider", "prompt_tokens", "completion_tokens", "cost_usd")


@query("c8_hit_usage", f"""WITH {v.TX}, {v.HASHED}, {v.CACHE} SELECT id AS transaction_id, statement_id, 'anthropic' AS provider, 'model-a' AS model, 'HIT' AS cache_status,
  0 AS prompt_tokens, 0 AS completion_tokens, CAST(0 AS DECIMAL(10,6)) AS cost_usd FROM hx JOIN ca USING (content_hash)""")
def _(s, d):
    tx = fx.hashed(fx.transactions(s, d, numbered=True, clients=False)).withColumnRenamed("id", "transaction_id")
    return ca.hit_usage(tx, fx.cache(s, d)).drop("content_hash")


@query("c9_usage_summary", f"""WITH {v.ST}, {v.USAGE}, {PRICED} SELECT st.statement_id, count(event_id) AS calls, count(*) FILTER (cache_status = 'HIT') AS cache_hits,
  count(*) FILTER (cache_status = 'MISS') AS cache_misses, count(*) FILTER (cache_status = 'FALLBACK') AS fallback_calls,
  CAST(coalesce(sum(CASE WHEN provider = 'local' THEN 0 ELSE prompt_tokens END), 0) AS BIGINT) AS prompt_tokens,
  CAST(coalesce(sum(CASE WHEN provider = 'local' THEN 0 ELSE completion_tokens END), 0) AS BIGINT) AS completion_tokens,
  CAST(coalesce(sum(cost_usd), 0) AS DECIMAL(18,6)) AS cost_usd FROM st LEFT JOIN co USING (statement_id) GROUP BY ALL""")
def _(s, d):
    return ca.usage_summary(fx.statements(s, d), ca.charge(fx.usage(s, d), ca.price_table(s)))


@query("c10_invalidate", f"WITH {v.TX}, {v.HASHED}, {v.CACHE} SELECT content_hash, first_id FROM ca WHERE content_hash NOT IN (SELECT content_hash FROM hx WHERE is_ignored)")
def _(s, d):
    tx = fx.hashed(fx.transactions(s, d, numbered=True, clients=False)).filter("is_ignored")
    kept = ca.invalidate(fx.cache(s, d), tx)
    return kept.select("content_hash", F.substring("narration_clean", 8, 20).cast("bigint").alias("first_id"))


# ---------------------------------------------------------------- ledger memory


@query("m1_pattern_key", f"WITH {v.TX} SELECT id, {v.mapping_key('narration')} AS pattern FROM tx")
def _(s, d):
    tx = fx.cleaned(fx.transactions(s, d, clients=False))
    return tx.select("id", text.mapping_pattern(tx).alias("pattern"))


@query("m2_learn", f"""WITH {v.TX}, {v.MP}, m1 AS (SELECT * FROM mp)
SELECT client_id, pattern, ledger_name, CAST(hit_count + coalesce(n, 0) AS BIGINT) AS hit_count, last_used_at FROM m1
LEFT JOIN (SELECT client_id, {v.mapping_key('narration')} AS pattern, count(*) AS n FROM tx WHERE confirmed_ledger IS NOT NULL AND txn_date < DATE '1998-01-01' GROUP BY ALL) USING (client_id, pattern)""")
def _(s, d):
    rows = fx.confirmed(fx.transactions(s, d))
    early = me.learn(rows.filter("used_at < date'1998-01-01'"))
    return me.learn(rows, early)


TOKEN_SQL = f"""q AS (SELECT DISTINCT client_id, {v.mapping_key('narration')} AS pattern FROM tx),
pair AS (SELECT q.client_id, q.pattern, ledger_name, mp.pattern AS mapping, hit_count, last_used_at,
   list_distinct(string_split(q.pattern, ' ')) AS a, list_distinct(string_split(mp.pattern, ' ')) AS b FROM q JOIN mp USING (client_id)),
sc AS (SELECT *, row_number() OVER (PARTITION BY client_id, pattern, ledger_name ORDER BY hit_count DESC, last_used_at DESC, mapping DESC) AS n FROM pair WHERE list_has_any(a, b)),
tok AS (SELECT client_id, pattern, ledger_name, mapping, CASE WHEN mapping = pattern THEN 1.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS score, hit_count FROM sc WHERE n = 1)"""


@query("m3_token_suggestions", f"WITH {v.TX}, {v.MP}, {TOKEN_SQL} SELECT client_id, pattern, ledger_name, mapping, CAST(round(score, 6) AS DOUBLE) AS score, hit_count FROM tok")
def _(s, d):
    tx = fx.cleaned(fx.transactions(s, d))
    queries = tx.select("client_id", text.mapping_pattern(tx).alias("pattern"))
    return me.token_suggestions(queries, me.learn(fx.confirmed(tx))).withColumn("score", F.round("score", 6))


EMBED = f"""pt AS (SELECT {v.KEY.format('narration')} AS pattern FROM tx UNION SELECT {v.mapping_key('narration')} FROM tx), tk AS (SELECT pattern, unnest(string_split(pattern, ' ')) AS t FROM pt),
ft AS (SELECT pattern, CAST(CAST('0x' || substr(sha256(t), 1, 8) AS BIGINT) % 64 AS INTEGER) AS slot,
  CASE WHEN CAST('0x' || substr(sha256(t), 9, 2) AS BIGINT) % 2 = 1 THEN -1 ELSE 1 END AS sign FROM tk),
fs AS (SELECT pattern, slot, sum(sign) AS value FROM ft GROUP BY ALL),
fn AS (SELECT pattern, slot, value / sqrt(sum(value * value) OVER (PARTITION BY pattern)) AS value FROM fs WHERE value <> 0)"""


@query("m4_embedding", f"WITH {v.TX}, {EMBED} SELECT pattern, slot, CAST(round(value, 6) AS DOUBLE) AS value FROM fn")
def _(s, d):
    tx = fx.cleaned(fx.transactions(s, d, clients=False))
    patterns = tx.select(F.explode(F.array(text.pattern_key(F.col("narration")), text.mapping_pattern(tx))).alias("pattern")).distinct()
    return patterns.select("pattern", F.posexplode(me.embed(F.col("pattern"))).alias("slot", "value")).filter("value <> 0").withColumn("value", F.round("value", 6))


@query("m5_vector_top_k", """WITH e AS (SELECT vec_id % 5 AS client_id, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.client_id, a.vec_id AS query, b.vec_id AS item, list_cosine_similarity(a.v, b.v) AS score FROM e a JOIN e b USING (client_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS place FROM s)
SELECT client_id, query, item, CAST(round(score, 4) AS DOUBLE) AS score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3""")
def _(s, d):
    vec = fx.vectors(s, d)
    queries = vec.select("client_id", F.col("vec_id").alias("query"), "vector")
    items = vec.select("client_id", F.col("vec_id").alias("item"), "vector")
    return me.vector_top_k(queries, items, 3).withColumn("score", F.round("score", 4))


VECTOR_SQL = f"""fp AS (SELECT pattern, slot, value FROM fs WHERE value <> 0), nr AS (SELECT pattern, sqrt(sum(value * value)) AS n FROM fp GROUP BY pattern),
dt AS (SELECT q.client_id, q.pattern, mp.pattern AS mapping, any_value(ledger_name) AS ledger_name, any_value(hit_count) AS hit_count, sum(a.value * b.value) AS dot
  FROM q JOIN mp USING (client_id) JOIN fp a ON a.pattern = q.pattern JOIN fp b ON b.pattern = mp.pattern AND b.slot = a.slot GROUP BY ALL),
al AS (SELECT q.client_id, q.pattern, mp.pattern AS mapping, mp.ledger_name, mp.hit_count, round(coalesce(dot, 0) / nullif(x.n * y.n, 0), 9) AS score
  FROM q JOIN mp USING (client_id) LEFT JOIN dt ON dt.client_id = q.client_id AND dt.pattern = q.pattern AND dt.mapping = mp.pattern
  LEFT JOIN nr x ON x.pattern = q.pattern LEFT JOIN nr y ON y.pattern = mp.pattern),
vs AS (SELECT *, row_number() OVER (PARTITION BY client_id, pattern ORDER BY coalesce(score, 0) DESC, hit_count DESC, mapping) AS place FROM al)"""

SAID = f"CASE WHEN {v.cleaned('narration')} <> '' THEN {v.title(v.cleaned('narration'))} ELSE trim(narration) END"
EXAMPLES_SQL = f"""WITH {v.TX}, {v.MP}, {EMBED}, {v.HASHED}, {v.CACHE},
ms AS (SELECT *, {SAID} AS said, {v.mapping_key('narration')} AS pattern FROM hx WHERE content_hash NOT IN (SELECT content_hash FROM ca)),
q AS (SELECT DISTINCT client_id, pattern FROM ms), {VECTOR_SQL},
fi AS (SELECT statement_id, client_id, said, any_value(pattern) AS pattern, min(row_number) AS seen FROM ms GROUP BY statement_id, client_id, said),
ask AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY seen) AS n FROM fi) WHERE n <= 20),
fo AS (SELECT *, row_number() OVER (PARTITION BY statement_id, ledger_name ORDER BY n, place) AS k FROM ask JOIN vs USING (client_id, pattern) WHERE place <= 3 AND score >= 0.3),
exm AS (SELECT statement_id, CAST(row_number() OVER (PARTITION BY statement_id ORDER BY n, place) AS INTEGER) AS position, mapping AS narration, ledger_name AS ledger, score FROM fo WHERE k = 1)"""


def _examples(s, d):
    """Examples for the rows that the cache does not answer."""
    missed = ca.misses(fx.cleaned(fx.hashed(fx.transactions(s, d, numbered=True))), fx.cache(s, d))
    return me.examples(missed, me.learn(fx.confirmed(fx.transactions(s, d))))


@query("m6_examples", EXAMPLES_SQL + " SELECT statement_id, position, narration, ledger, CAST(round_even(score, 4) AS DOUBLE) AS score FROM exm WHERE position <= 5")
def _(s, d):
    return _examples(s, d)


@query("e18_example_context", EXAMPLES_SQL + f""", pi AS (SELECT statement_id, position, '{{"narration":"' || {_mask_sql('narration[1:160]')} || '","ledger":"' || ledger[1:120] || '"}}' AS p FROM exm WHERE position <= 5)
SELECT statement_id, '[' || string_agg(p, ',' ORDER BY position) || ']' AS context FROM pi GROUP BY ALL""")
def _(s, d):
    pairs = _examples(s, d).groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct("position", "narration", "ledger"))).alias("examples"))
    return pairs.select("statement_id", en.example_context(F.col("examples")).alias("context"))


@query("m7_suggestions", f"""WITH {v.TX}, {v.MP}, {EMBED}, {TOKEN_SQL}, {VECTOR_SQL},
un AS (SELECT client_id, pattern, ledger_name, mapping, score, hit_count, 'db' AS source, 0 AS r FROM tok
 UNION ALL SELECT client_id, pattern, ledger_name, mapping, coalesce(score, 0), hit_count, 'vector', 1 FROM (SELECT *, row_number() OVER (PARTITION BY client_id, pattern, ledger_name ORDER BY score DESC, hit_count DESC, mapping DESC) AS k FROM vs WHERE place <= 5) WHERE k = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY client_id, pattern, ledger_name ORDER BY r) AS k FROM un),
pl AS (SELECT *, CAST(row_number() OVER (PARTITION BY client_id, pattern ORDER BY score DESC, hit_count DESC, ledger_name) AS INTEGER) AS place FROM o WHERE k = 1)
SELECT client_id, pattern, ledger_name, mapping, CAST(round_even(score, 4) AS DOUBLE) AS score, source, hit_count, place FROM pl WHERE place <= 5""")
def _(s, d):
    tx = fx.cleaned(fx.transactions(s, d))
    queries = tx.select("client_id", text.mapping_pattern(tx).alias("pattern"))
    return me.suggestions(queries, me.learn(fx.confirmed(tx)))


@query("m8_backfill", f"""WITH {v.TX}, {v.MP}, {EMBED} SELECT client_id, slot, count(*) AS mappings, CAST(round(sum(value), 4) AS DOUBLE) AS weight
FROM mp JOIN fn USING (pattern) GROUP BY ALL""")
def _(s, d):
    vectors = me.backfill(me.learn(fx.confirmed(fx.transactions(s, d))))
    parts = vectors.select("client_id", F.posexplode("vector").alias("slot", "value")).filter("value <> 0")
    return parts.groupBy("client_id", "slot").agg(F.count(F.lit(1)).alias("mappings"), F.round(F.sum("value"), 4).alias("weight"))
