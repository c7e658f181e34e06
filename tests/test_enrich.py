import datetime
import decimal
import hashlib
import json
import os

import numpy as np
from pyspark.sql import functions as F

from vouchline.functions.text import pattern_key
from vouchline.operators import cache as ca, enrich as en, memory as me
from vouchline.session import work_dir

Dec, D = decimal.Decimal, datetime.date
TX = "id long, client_id int, txn_date date, narration string, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2), confirmed_ledger string"
RULE = "rule_id long, client_id int, match_type string, pattern string, ledger_name string, priority int, is_active boolean, created_at timestamp"
T0 = datetime.datetime(2024, 1, 1)


def tx(spark, rows):
    return spark.createDataFrame([(i, c, d, n, deb, cre, None, led) for i, c, d, n, deb, cre, led in rows], TX)


def test_first_transaction_of_the_seed(spark):
    row = en.heuristic(tx(spark, [(1, 1, D(2024, 1, 1), "UPI SWIGGY", Dec("350.00"), None, None)])).first()
    assert (row.payment_mode, row.suggested_ledger, row.counterparty, row.confidence) == ("UPI", "Food Expenses", "Swiggy", Dec("0.800"))
    assert row.source == "heuristic" and row.cache_status == "FALLBACK"


def test_rules_order_kinds_and_overflow(spark):
    rules = spark.createDataFrame([
        (1, 1, "contains", "SWIG", "food", 5, True, T0), (2, 1, "startswith", "upi", "upi", 2, True, T0 + datetime.timedelta(1)), (3, 1, "startswith", "upi", "older", 2, True, T0),
        (4, 1, "regex", "(bad", "bad", 0, True, T0), (5, 1, "exact", "rent", "exact", 1, True, T0), (6, 1, "endswith", "50%_x", "literal", 1, True, T0),
        (7, 1, "contains", "e", "inactive", 0, False, T0), (8, 2, "regex", r"^a\d+$", "regex", 1, True, T0), (9, 1, None, "cash", "default kind", 9, True, T0)], RULE)
    rows = tx(spark, [(1, 1, D(2024, 1, 1), "UPI Swiggy", None, None, None), (2, 1, D(2024, 1, 1), "my swiggy", None, None, None), (3, 1, D(2024, 1, 1), "RENT", None, None, None),
                      (4, 1, D(2024, 1, 1), "take 50%_X", None, None, None), (5, 1, D(2024, 1, 1), "take 50abx", None, None, None), (6, 2, D(2024, 1, 1), "A12", None, None, None),
                      (7, 3, D(2024, 1, 1), "upi", None, None, None), (8, 1, D(2024, 1, 1), "some Cash", None, None, None), (9, 1, D(2024, 1, 1), None, None, None, None)])
    want = {1: "older", 2: "food", 3: "exact", 4: "literal", 5: None, 6: "regex", 7: None, 8: "default kind", 9: None}
    for in_array in (1, 2, 256):
        got = {r.id: r.rule and r.rule.ledger_name for r in en.apply_rules(rows, rules, in_array).collect()}
        assert got == want, in_array


def test_fixed_parts(spark):
    want = {"upi.*swiggy": "swiggy", "party\\s+\\d+": "party", "atm|cash": "", "(rent)": "", "[ab]cde": "", "abcd?": "abc", "abcd*e": "abc", "ab{0,1}cdefg": "cdefg", "abc+d": "abc", "\\x41bcd": "", "a\\.bcd": "bcd", "^neft": "neft", "": ""}
    df = spark.createDataFrame([(p,) for p in want], "p string").select("p", en.fixed_part(F.lit("regex"), F.col("p")).alias("f"))
    assert {r.p: r.f for r in df.collect()} == want


def test_rules_by_gram_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    words = ["upi", "UPI", "swiggy", "a", "rent", "Rent", "x1", "50%", "É", "tea", ""]
    said = [" ".join(rng.choice(words, int(rng.integers(0, 4)))) for _ in range(150)] + [None]
    rows = tx(spark, [(i, i % 2, D(2024, 1, 1), n, None, None, None) for i, n in enumerate(said)])
    kinds = ["contains", "startswith", "endswith", "exact", "regex", "other"]
    made = [(i, i % 2, kinds[i % 6], [" ".join(rng.choice(words, int(rng.integers(0, 3)))), "re+nt?", "a|x1", "upi ?sw", "tea$", "^up"][int(rng.integers(6))], f"L{i}", int(rng.integers(4)), True, T0 + datetime.timedelta(int(rng.integers(3)))) for i in range(60)]
    rules = spark.createDataFrame(made, RULE)
    import re

    def hit(kind, p, n):
        low, q = n.lower(), p.lower()
        return {"contains": q in low, "startswith": low.startswith(q), "endswith": low.endswith(q), "exact": low == q, "other": False}.get(kind) if kind != "regex" else bool(re.search(p, n, re.I))

    want = {}
    for i, n in enumerate(said):
        found = [(pr, at, rid, led) for rid, c, kind, p, led, pr, _, at in made if c == i % 2 and hit(kind, p, n or "")]
        want[i] = min(found)[3] if found else None
    assert {r.id: r.rule and r.rule.ledger_name for r in en.apply_rules(rows, rules, 2).collect()} == want and any(want.values())
    counted = {rid: sum(hit(kind, p, n or "") for i, n in enumerate(said) if i % 2 == c) for rid, c, kind, p, *_ in made if kind != "other"}
    assert {r.rule_id: r.matches for r in en.rule_dry_run(rows, rules).collect()} == counted


def test_many_rules_of_one_client(spark):
    """A hundred thousand rules: a narration meets only those that share its rarest gram, not all of them."""
    n = 100_000
    rules = spark.range(n).selectExpr("id as rule_id", "1 as client_id", "'contains' as match_type", "concat('pay to ', conv(id * 7919 + 1000003, 10, 36), ' ltd') as pattern", "concat('L', id) as ledger_name", "1 as priority", "true as is_active", "timestamp'2024-01-01' as created_at")
    rows = spark.range(2000).selectExpr("id", "1 as client_id", "concat('UPI PAY TO ', conv(id * 50 * 7919 + 1000003, 10, 36), ' LTD REF') as narration")
    usable = en.usable_rules(rules).select("client_id", F.struct("priority", "created_at", "rule_id", "match_type", "pattern", "lowered", "ledger_name").alias("r"))
    met, rest = en.rule_candidates(rows.select("client_id", F.col("narration").alias("_narration")).distinct(), usable)
    assert rest.count() == 0 and met.count() < n * 2000 / 100
    got = {r.id: r.rule.rule_id for r in en.apply_rules(rows, rules).collect() if r.rule}
    assert got == {i: i * 50 for i in range(2000)}


def _recurring_python(rows, mappings, history):
    out = set()
    for i, c, d, n, deb, cre, _ in rows:
        for mc, mp, ml, hits in mappings:
            if mc != c or mp != n.lower() or hits < 2:
                continue
            for _, hc, hd, hn, hdeb, hcre, hl in history:
                a, b = deb or cre, hdeb or hcre
                days = abs((d - hd).days)
                if hc == c and hn.lower() == mp and hl == ml and (deb is None) == (hdeb is None) and abs(a - b) <= Dec("0.1") * max(a, b) and (
                        6 <= days <= 8 or 12 <= days <= 16 or 25 <= days <= 35 or days % 30 <= 5 or days % 30 >= 25 or abs(d.day - hd.day) <= 5):
                    out.add((i, ml))
    return out


def test_recurring_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(1, 3)), D(2024, 1, 1) + datetime.timedelta(int(rng.integers(0, 120))), ["Rent", "Gym", "Sip"][int(rng.integers(3))],
             *((Dec(int(rng.integers(90, 120))), None) if rng.integers(2) else (None, Dec(int(rng.integers(90, 120))))), ["A", "B", None][int(rng.integers(3))]) for i in range(80)]
    df = tx(spark, rows)
    maps = [(1, "rent", "A", 2), (1, "gym", "B", 1), (2, "sip", "B", 5), (2, "rent", "A", 3)]
    mappings = spark.createDataFrame(maps, "client_id int, pattern string, ledger_name string, hit_count long")
    history = [r for r in rows if r[6]]
    got = {(r.id, r.recurring_ledger) for r in en.recurring(df, mappings, en.recent_history(df)).collect()}
    assert got == _recurring_python(rows, maps, history) and got


def test_bands_equal_pairs_of_payments(spark):
    """Amounts at the very borders, of nothing, below it and missing; dates that are missing; ties and repeated rows."""
    rng = np.random.default_rng(8)
    edges = ["0.01", "0.02", "9.00", "9.99", "10.00", "10.01", "11.11", "11.12", "90.00", "99.99", "100.00", "111.11", "111.12", "0.00", "-5.00", "-500.00", "1234567890123456.78"]
    rows = []
    for i in range(700):
        amount = None if i % 23 == 0 else Dec(edges[int(rng.integers(len(edges)))])
        day = None if i % 29 == 0 else D(2024, 1, 1) + datetime.timedelta(int(rng.integers(0, 400)))
        rows.append((i - i % 7 % 2, 1 + i % 2, day, ["Rent", "Gym", "", None][int(rng.integers(4))], *((amount, None) if rng.integers(3) else (None, amount)), ["A", "B", None][int(rng.integers(3))]))
    df = tx(spark, rows)
    maps = spark.createDataFrame([(1, "rent", "A", 2), (1, "gym", "B", 2), (2, "rent", "B", 2), (2, "gym", "A", 9)], "client_id int, pattern string, ledger_name string, hit_count long")
    for history in (df.filter("confirmed_ledger is not null"), df.filter("confirmed_ledger is not null and id % 40 = 3"), df.filter("false")):
        pairs = en.mark_recurring(df, maps, history).filter("recurring_ledger is not null")
        want = sorted((r.id, r.recurring_ledger) for r in pairs.collect())
        assert sorted((r.id, r.recurring_ledger) for r in en.recurring(df, maps, history).collect()) == want


def test_a_pattern_of_a_million_payments_meets_no_pairs(spark):
    """Sums are bounded by bands and calendar, and rows are looked up by equality alone."""
    n = F.col("id")
    df = spark.range(1_000_000).select(
        "id", F.lit(1).alias("client_id"), F.date_add(F.lit(D(2020, 1, 1)), (n % 1500).cast("int")).alias("txn_date"), F.lit("Rent").alias("narration"),
        F.lit("Rent").alias("narration_clean"), (n % 9000 / 7 + 50).cast("decimal(18,2)").alias("debit"), F.lit(None).cast("decimal(18,2)").alias("credit"), F.lit("A").alias("confirmed_ledger"))
    maps = spark.createDataFrame([(1, "rent", "A", 2)], "client_id int, pattern string, ledger_name string, hit_count long")
    past = df.select("client_id", "txn_date", F.col("debit").alias("amount"))
    cycles, days = en.payment_bands(past, ["client_id"])
    size = cycles.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("_cycles")).alias("longest")).first()
    assert size.rows <= 40 and size.longest <= 61
    size = days.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("_days")).alias("longest")).first()
    assert size.rows <= 40 * 97 and size.longest <= 3 * en.DAYS_IN_BLOCK
    found = en.recurring(df, maps, df)
    assert found.count() == 1_000_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "LeftSemi" not in plan


def test_history_is_the_latest_rows_per_client(spark):
    df = tx(spark, [(i, i % 2, D(2024, 1, 1) + datetime.timedelta(i // 4), "x", None, None, "A") for i in range(40)])
    assert sorted(r.id for r in en.recent_history(df, 3).collect()) == [34, 35, 36, 37, 38, 39]


def test_rules_win_unless_as_coded(spark):
    rows = tx(spark, [(1, 1, D(2024, 1, 5), "rent", Dec("100"), None, "Rent"), (2, 1, D(2024, 2, 5), "rent", Dec("101"), None, None)])
    rules = spark.createDataFrame([(1, 1, "exact", "rent", "By rule", 1, True, T0)], RULE)
    maps = spark.createDataFrame([(1, "rent", "Rent", 2)], "client_id int, pattern string, ledger_name string, hit_count long")
    for precedence, want in [("documented", "By rule"), ("as_coded", "Rent")]:
        got = en.enrich(rows, rules, maps, precedence=precedence).collect()
        assert len(got) == 2 and {r.suggested_ledger for r in got} == {want}


def test_content_hash_equals_python(spark):
    texts = ["UPI/A", 'quo"te \\ back', "café ₹500", "emoji \U0001F600 x", "tab\tand\nline", None]
    df = spark.createDataFrame([(i, t, Dec("1.50"), None, Dec("-2.00")) for i, t in enumerate(texts)], "id int, narration string, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2)")
    got = {r.id: r.h for r in df.select("id", ca.content_hash(df).alias("h")).collect()}
    for i, t in enumerate(texts):
        body = {"narration": t, "debit": "1.50", "credit": None, "balance": "-2.00"}
        assert got[i] == hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest(), t


def _embedding(text, size=64):
    import re
    v = np.zeros(size)
    for t in re.findall("[a-z0-9]+", text.lower()):
        h = hashlib.sha256(t.encode()).digest()
        v[int.from_bytes(h[:4], "big") % size] += 1.0 if h[4] % 2 == 0 else -1.0
    n = np.sqrt((v * v).sum())
    return v / n if n else v


def test_embedding_equals_python(spark):
    texts = ["UPI/Swiggy 12", "a a a b", "", "!!"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", me.embed(F.col("t")).alias("v")).collect()
    for r in got:
        assert np.allclose(r.v, _embedding(r.t))


def test_vector_search_is_exact_with_tiny_packs(spark):
    words = ["upi", "neft", "rent", "swiggy", "amazon", "salary", "gym"]
    rng = np.random.default_rng(1)
    patterns = sorted({" ".join(rng.choice(words, int(rng.integers(1, 4)))) + f" {rng.integers(20)}" for _ in range(120)})
    maps = [(1 + i % 2, p, f"L{i % 5}", int(rng.integers(1, 4))) for i, p in enumerate(patterns)]
    m = spark.createDataFrame(maps, "client_id int, pattern string, ledger_name string, hit_count long")
    asked = [(1, "upi swiggy 3"), (1, "rent"), (2, "salary neft 7"), (2, "nothing like it")]
    q = spark.createDataFrame(asked, "client_id int, pattern string")
    got = {(r.client_id, r.pattern, r.place): r.mapping for r in me.search(q, m, 4, pack_rows=7).collect()}
    for c, p in asked:
        scored = sorted(((-(round(float(_embedding(p) @ _embedding(mp)), 9) + 0.0), -h, mp) for mc, mp, _, h in maps if mc == c))[:4]
        assert [got[(c, p, n + 1)] for n in range(4)] == [s[2] for s in scored], (c, p)


def test_token_suggestions_equal_brute_force(spark):
    maps = [(1, "upi swiggy food", "Food", 3, 1), (1, "swiggy", "Food", 3, 2), (1, "upi rent", "Rent", 1, 1), (1, "other", "X", 9, 9), (2, "upi swiggy", "Z", 1, 1)]
    m = spark.createDataFrame(maps, "client_id int, pattern string, ledger_name string, hit_count long, last_used_at int")
    q = spark.createDataFrame([(1, "upi swiggy"), (1, "rent")], "client_id int, pattern string")
    got = {(r.pattern, r.ledger_name): (r.mapping, round(r.score, 4)) for r in me.token_suggestions(q, m).collect()}
    assert got == {("upi swiggy", "Food"): ("swiggy", 0.5), ("upi swiggy", "Rent"): ("upi rent", 0.3333), ("rent", "Rent"): ("upi rent", 0.5)}


def _clustered(spark, n, spread, seed):
    """Vectors around 24 directions of two clients, some equal, one zero; ids are ids of vectors."""
    rng = np.random.default_rng(seed)
    towards = rng.normal(size=(24, 16))
    vectors = towards[rng.integers(0, 24, n)] + spread * rng.normal(size=(n, 16))
    vectors[1::50] = vectors[0]
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[7] = 0
    return [(i % 2, i, [float(x) for x in v]) for i, v in enumerate(vectors)]


def test_nearest_vectors_equal_all_pairs_and_skip_far_groups(spark):
    for spread, most in ((0.05, 0.5), (1.5, 1.0)):
        rows = _clustered(spark, 1500, spread, 5)
        df = spark.createDataFrame([*rows, (2, 9999, None), (3, 9998, [1.0] + [0.0] * 15)], "client_id int, id long, vector array<double>")
        queries, items = df.filter("id % 3 = 1 or client_id > 1").withColumnRenamed("id", "query"), df.filter("client_id <> 3").withColumnRenamed("id", "item")
        got = {}
        for r in me.vector_top_k(queries, items, 4, pack_rows=64, group_rows=16).collect():
            got.setdefault(r.query, {})[r.place] = (r.item, r.score)
        asked = [r for r in rows if r[1] % 3 == 1]
        for client in (0, 1):
            mine = [r for r in rows if r[0] == client]
            all_items, ids = np.array([r[2] for r in mine]), np.array([r[1] for r in mine])
            for _, q, v in [r for r in asked if r[0] == client]:
                scores = np.round(all_items @ np.array(v), 9) + 0.0
                first = np.lexsort((ids, -scores))[:4]
                assert [got[q][n + 1][0] for n in range(4)] == [int(ids[i]) for i in first], (spread, q)
        assert len(got) == len(asked)
        _, home, across = me.vector_meetings(queries, items, 4, pack_rows=64, group_rows=16)
        compared = sum(df.agg(F.sum(F.size("q_keys") * F.size("i_keys"))).first()[0] or 0 for df in (home, across))
        assert compared <= most * sum(len([r for r in asked if r[0] == c]) * len([r for r in rows if r[0] == c]) for c in (0, 1)), (spread, compared)
    none = df.filter("false")
    assert me.vector_top_k(queries, none.withColumnRenamed("id", "item"), 3).isEmpty() and me.vector_top_k(none.withColumnRenamed("id", "query"), items, 3).isEmpty()


def _answers(spark, rows):
    """(number, response, written_at day)"""
    rows = [(hashlib.sha256(str(n).encode()).hexdigest(), "p" + r, "m", r, 1, 2, Dec("0.5"), 0, T0 + datetime.timedelta(day)) for n, r, day in rows]
    return spark.createDataFrame(rows, "content_hash string, provider string, model string, response string, prompt_tokens long, completion_tokens long, cost_usd decimal(10,6), hit_count long, written_at timestamp")


def test_stored_cache_rewrites_only_touched_buckets(spark):
    path = work_dir(spark, "answers")
    assert ca.stored_cache(spark, path, "answers_a", 16).isEmpty()
    assert ca.upsert_stored(_answers(spark, []), "answers_a", 16) == []
    first = _answers(spark, [(n, f"r{n}", 1) for n in range(500)])
    assert ca.upsert_stored(first, "answers_a", 16) == list(range(16))

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    before = files()
    fresh = _answers(spark, [(7, "new", 5), (7, "newer", 6), (900, "added", 5)])
    for _ in range(2):  # brought in again, nothing changes
        touched = ca.upsert_stored(fresh, "answers_a", 16)
        assert 1 <= len(touched) <= 2
        kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
        assert kept == {f for f, at in files().items() if before.get(f) == at} and len(kept) >= 14
        got = {r.content_hash: r for r in spark.table("answers_a").collect()}
        assert len(got) == 501
        for n, r, provider, made, used in ((7, "newer", "pr7", 1, 6), (900, "added", "padded", 5, 5), (8, "r8", "pr8", 1, 1)):
            row = got[hashlib.sha256(str(n).encode()).hexdigest()]
            assert (row.response, row.provider, (row.created_at - T0).days, (row.last_used_at - T0).days) == (r, provider, made, used)
    # another session's catalog finds the same rows below the path
    assert ca.stored_cache(spark, path, "answers_b", 16).count() == 501
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tx = spark.range(600).select("id", F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
        for found in (ca.lookup(tx, ca.stored_cache(spark, path, "answers_b", 16)), ca.misses(tx, ca.stored_cache(spark, path, "answers_b", 16))):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
            missed = found.filter("not cache_hit") if "cache_hit" in found.columns else found
            assert sorted(r.id for r in missed.select("id").collect()) == list(range(500, 600))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_learning_upserts(spark):
    rows = spark.createDataFrame([(1, "UPI/Shop", " A ", 1, 1), (1, "upi shop", "B", 2, 2), (1, "x", "  ", 3, 3), (1, "//", "A", 3, 4)], "client_id int, narration string, ledger_name string, used_at int, event_id long")
    old = spark.createDataFrame([(1, "upi shop", "Old", 4, 0), (2, "keep", "K", 1, 0)], "client_id int, pattern string, ledger_name string, hit_count long, last_used_at int")
    got = {r.pattern: (r.ledger_name, r.hit_count, r.last_used_at) for r in me.learn(rows, old).collect()}
    assert got == {"upi shop": ("B", 6, 2), "keep": ("K", 1, 0)}


def test_plans_have_no_cross_joins(spark):
    q = spark.range(50).select((F.col("id") % 3).cast("int").alias("client_id"), F.concat(F.lit("upi "), F.col("id").cast("string")).alias("pattern"))
    m = q.withColumns({"ledger_name": F.lit("A"), "hit_count": F.lit(2).cast("long"), "last_used_at": F.lit(1)})
    rows = spark.range(50).select("id", (F.col("id") % 3).cast("int").alias("client_id"), F.lit(D(2024, 1, 1)).alias("txn_date"), F.lit("upi 5").alias("narration"),
                                  F.lit(1).cast("decimal(18,2)").alias("debit"), F.lit(None).cast("decimal(18,2)").alias("credit"), F.lit("A").alias("confirmed_ledger"))
    rules = spark.createDataFrame([(1, 1, "exact", "rent", "By rule", 1, True, T0)], RULE)
    for df in [me.token_suggestions(q, m), me.suggestions(q, m), en.recurring(rows, m, en.recent_history(rows)), en.apply_rules(rows, rules)]:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rejected_tiers_fall_through(spark):
    cols = "id long, statement_id long, client_id long, batch_no long, tier int, suggested_ledger string"
    rows = [(1, 1, 7, 0, 1, "Moon"), (2, 1, 7, 0, 1, "rent"), (1, 1, 7, 0, 2, "RENT"), (2, 1, 7, 0, 2, "rent"),  # first tier rejected
            (3, 2, 7, 0, 1, "Moon"), (3, 2, 7, 0, 3, "Mars"),  # all tiers rejected
            (4, 3, 8, 0, 2, "Moon")]  # a client without ledgers
    allowed = en.allowed_ledgers(spark.createDataFrame([(7, "Rent")], "client_id long, name string"))
    got = en.resolve_tiers(en.validate_answers(spark.createDataFrame(rows, cols), allowed)).orderBy("id").collect()
    assert [(r.id, r.tier, r.suggested_ledger) for r in got] == [(1, 2, "Rent"), (2, 2, "Rent"), (4, 2, "Moon")]


def test_mappings_go_by_the_cleaned_narration(spark):
    rows = spark.createDataFrame([(1, "UPI/A/900000123", "Upi A", "Food", 1, 1), (1, "UPI/A/900000456", "Upi A", "Food", 2, 2), (1, "UPI/B", "", "Tea", 3, 3), (1, "UPI/B", None, "Tea", 4, 4)],
                                 "client_id long, narration string, narration_clean string, ledger_name string, used_at int, event_id long")
    assert sorted((r.pattern, r.hit_count) for r in me.learn(rows).collect()) == [("upi a", 2), ("upi b", 2)]


def test_pattern_key(spark):
    assert spark.range(1).select(pattern_key(F.lit(" UPI/Swiggy--12 ")).alias("k")).first().k == "upi swiggy 12"


def test_only_missing_fields_are_enriched(spark):
    rows = tx(spark, [(1, 1, D(2024, 1, 5), "UPI SWIGGY", Dec("5"), None, None), (2, 1, D(2024, 1, 5), "UPI SWIGGY", Dec("5"), None, None)])
    given = rows.withColumns({"narration_clean": F.when(F.col("id") == 1, "Own"), "payment_mode": F.lit("CARD"), "suggested_ledger": F.lit("Mine"), "confidence": F.lit("0.5").cast("decimal(4,3)"), "counterparty": F.lit(None).cast("string")})
    got = {r.id: (r.narration_clean, r.payment_mode, r.suggested_ledger, r.source) for r in en.enrich_missing(given).collect()}
    assert got == {1: ("Own", "CARD", "Mine", None), 2: ("Upi Swiggy", "UPI", "Food Expenses", "heuristic")}
    assert {r.source for r in en.enrich_missing(rows).collect()} == {"heuristic"}


def test_examples_are_found_by_the_cleaned_text(spark):
    maps = spark.createDataFrame([(1, "upi amazon shopping", "Shop", 3)], "client_id int, pattern string, ledger_name string, hit_count long")
    rows = spark.createDataFrame([(9, 1, 1, "UPI/AMAZON/SHOPPING/4711000", "Upi Amazon Shopping")], "statement_id long, client_id int, row_number long, narration string, narration_clean string")
    assert [(r.ledger, r.score) for r in me.examples(rows, maps).collect()] == [("Shop", 1.0)]
    assert me.examples(rows.drop("narration_clean"), maps).first().score < 1


def test_texts_are_cleaned_once(spark):
    """The plans that learn and look up mappings hold the cleaning of a narration a few times, not once for each use of it."""
    from vouchline.sources import fixtures as fx

    sf = "/root/testdata/sf0.001"
    if not __import__("os").path.isdir(sf):
        return
    from vouchline.plans import catalog

    for name in ("m2_learn", "m3_token_suggestions"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") <= 16, (name, plan.count("regexp_replace("))
    assert fx


def test_vectors_without_clusters_are_copied_once_a_lane(spark):
    """Every pack reaches every group here; neither the copies of a pack nor the rows found grow with the number of groups."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1200, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    df = spark.createDataFrame([(1, i, [float(x) for x in v]) for i, v in enumerate(vectors)], "client_id int, id long, vector array<double>")
    queries, items = df.withColumnRenamed("id", "query"), df.withColumnRenamed("id", "item")
    _, _, across = me.vector_meetings(queries, items, 3, pack_rows=32, group_rows=16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = across.select("client_id", F.size("q_keys").alias("n"), F.size("i_keys").alias("m")).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
        found = across.mapInPandas(me._pack_top_k(3), "client_id int, query long, item long, score double").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert met > 0.8 * 1200 * 1200 and found <= 1200 * me.LANES * 3
    got = {}
    for r in me.vector_top_k(queries, items, 3, pack_rows=32, group_rows=16).collect():
        got.setdefault(r.query, {})[r.place] = r.item
    scores = np.round(vectors @ vectors.T, 9) + 0.0
    for q in range(1200):
        assert [got[q][n + 1] for n in range(3)] == [int(i) for i in np.lexsort((np.arange(1200), -scores[q]))[:3]]
