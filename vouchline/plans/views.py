"""The derived tables as SQL, for the agreement checks."""

from __future__ import annotations

BANK = "CASE {0} % 4 WHEN 0 THEN 'hdfc' WHEN 1 THEN 'icici' WHEN 2 THEN 'sbi' ELSE 'axis' END"

ST = f"""st AS (SELECT c_custkey AS statement_id, c_nationkey AS client_id, n_regionkey AS firm_id, {BANK.format('c_custkey')} AS bank_code,
  CASE WHEN c_custkey % 10 = 0 THEN 'FAILED' WHEN c_custkey % 10 < 4 THEN 'REVIEWED' WHEN c_custkey % 10 < 6 THEN 'EXPORTED'
       WHEN c_custkey % 10 = 6 THEN 'UPLOADED' ELSE 'READY_FOR_REVIEW' END AS status,
  lpad(CAST(c_custkey AS VARCHAR), 11, '7') AS account_number,
  DATE '2024-01-01' + CAST(c_custkey % 60 AS INTEGER) AS created_on,
  lower(c_name) || CASE c_custkey % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.docx' WHEN 4 THEN '' ELSE '.csv' END AS file_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

TX = f"""{ST}, tx AS (SELECT o_orderkey AS id, o_custkey AS statement_id, client_id, firm_id, {BANK.format('o_custkey')} AS bank_code,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS row_number,
  CAST(o_orderdate AS DATE) AS txn_date,
  CASE o_orderkey % 8
    WHEN 0 THEN 'UPI/SWIGGY/PAYMENT/' || CAST(900000000 + o_orderkey AS VARCHAR) WHEN 1 THEN 'NEFT-SALARY-EMPLOYER INC'
    WHEN 2 THEN 'UPI/AMAZON/SHOPPING/' || CAST(o_orderkey AS VARCHAR) WHEN 3 THEN 'ATM-CASH WITHDRAWAL-MUMBAI'
    WHEN 4 THEN 'IMPS/PARTY ' || CAST(o_custkey % 50 AS VARCHAR) || '/TRANSFER' WHEN 5 THEN 'NEFT-RENT PAYMENT-OWNER'
    WHEN 6 THEN 'POS/BIGBASKET/GROCERIES REF:' || CAST(o_orderkey AS VARCHAR) ELSE 'TFR' END AS narration,
  CASE WHEN o_orderstatus <> 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS debit,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS credit,
  CAST(1000000 + sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE -CAST(o_totalprice AS DECIMAL(18,2)) END)
    OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance,
  CASE WHEN o_orderpriority = '1-URGENT' THEN CASE o_orderkey % 8 WHEN 0 THEN 'Staff Welfare' WHEN 1 THEN 'Salary' WHEN 5 THEN 'Rent' ELSE 'Sundry' END END AS confirmed_ledger,
  o_orderkey % 17 = 0 AS is_ignored,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(CAST(o_orderkey % 100 AS DECIMAL(6,3)) / 100 AS DECIMAL(4,3)) END AS ocr_confidence
  FROM orders JOIN st ON o_custkey = statement_id)"""


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}', 'i')"


def title(text: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({text}, '[A-Za-z]+|[^A-Za-z]+'), lambda t: upper(t[1:1]) || lower(t[2:])), '')"


def cleaned(text: str) -> str:
    steps = rf"regexp_replace(replace({text}, '/', ' '), '\b(ref|txn|utr|rrn)[:\-\s]*[a-z0-9\-]+\b', ' ', 'gi')"
    steps = rf"regexp_replace({steps}, '\b\d{{6,}}\b', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({steps}, '[^a-zA-Z0-9&.\-\s]', ' ', 'g'), '\s+', ' ', 'g'))"


MODE = "CASE " + " ".join(
    f"WHEN {matches('narration', p)} THEN '{m}'" for m, p in [
        ("UPI", r"(^|[/|\s])upi[a-z]*(\b|[/|\s]|$)|\b(phonepe|gpay|google pay|paytm|bhim)\b"), ("NEFT", r"(^|[/|\s])neft(\b|[/|\s]|$)"),
        ("RTGS", r"(^|[/|\s])rtgs(\b|[/|\s]|$)"), ("IMPS", r"(^|[/|\s])imps(\b|[/|\s]|$)"), ("CHEQUE", r"\b(chq|cheque|check)\b"),
        ("CASH", r"\b(cash|atm|withdrawal)\b"), ("CARD", r"\b(pos|debit card|credit card|card)\b")]) + " END"
LEDGER = "CASE " + " ".join(
    f"WHEN {matches('narration', p)} THEN '{m}'" for m, p in [
        ("Food Expenses", r"\b(swiggy|zomato|restaurant|food)\b"), ("Online Purchases", r"\b(amazon|flipkart|myntra)\b"),
        ("Salary", r"\b(salary|payroll|wages)\b"), ("Rent", r"\b(rent)\b"), ("Fuel Expenses", r"\b(fuel|petrol|diesel)\b"),
        ("Utilities", r"\b(electricity|water|broadband|mobile|recharge)\b"), ("Cash", r"\b(atm|cash withdrawal)\b")]
) + " WHEN credit IS NOT NULL AND debit IS NULL THEN 'Receipts' WHEN debit IS NOT NULL AND credit IS NULL THEN 'Expenses' END"
NOISE = "['upi','neft','rtgs','imps','pos','chq','cheque','ref','txn','payment','transfer']"

EN = f"""{TX}, en0 AS (SELECT *, {cleaned('narration')} AS _c FROM tx),
en1 AS (SELECT * EXCLUDE (_c), CASE WHEN _c <> '' THEN {title('_c')} ELSE trim(narration) END AS narration_clean, {MODE} AS payment_mode, {LEDGER} AS suggested_ledger FROM en0),
en2 AS (SELECT *, array_to_string(list_filter(regexp_extract_all(narration_clean, '[A-Za-z][A-Za-z0-9&.\\-]+'),
   lambda t: length(t) > 2 AND NOT list_contains({NOISE}, lower(t)))[1:4], ' ') AS _p FROM en1),
en3 AS (SELECT * EXCLUDE (_p), CASE WHEN _p <> '' THEN {title('_p')} END AS counterparty FROM en2),
en AS (SELECT *, CAST(least(greatest(0.400 + CASE WHEN payment_mode IS NOT NULL THEN 0.200 ELSE -0.100 END
   + CASE WHEN suggested_ledger IS NULL THEN -0.050 WHEN suggested_ledger IN ('Expenses','Receipts') THEN 0.050 ELSE 0.200 END
   + CASE WHEN length(trim(narration_clean)) > 5 THEN CASE WHEN length(narration_clean) / greatest(length(narration), 1) < 0.85 THEN 0.100 ELSE 0.050 END ELSE 0.000 END
   + CASE WHEN length(trim(counterparty)) > 2 THEN 0.050 ELSE 0.000 END
   + CASE WHEN length(regexp_split_to_array(trim(narration), '[\\s/|]+')) <= 2 THEN -0.100 ELSE 0.000 END, 0.100), 0.950) AS DECIMAL(4,3)) AS confidence FROM en3)"""

KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"



def mapping_key(text: str) -> str:
    """Pattern key of the cleaned narration, of the narration itself where nothing is left."""
    return KEY.format(f"coalesce(nullif({cleaned(text)}, ''), {text})")


MP = f"""mp AS (SELECT client_id, {mapping_key('narration')} AS pattern, arg_max(confirmed_ledger, {{'d': txn_date, 'i': id}}) AS ledger_name,
  count(*) AS hit_count, max(txn_date) AS last_used_at FROM tx WHERE confirmed_ledger IS NOT NULL GROUP BY ALL)"""

RULES = r"""ru AS (SELECT *, 'Ledger ' || CAST(rule_id % 7 AS VARCHAR) AS ledger_name, CAST(rule_id % 5 AS INTEGER) AS priority, rule_id % 9 <> 0 AS is_active,
  DATE '2024-01-01' + CAST(rule_id % 3 AS INTEGER) AS created_at FROM (SELECT s_nationkey AS client_id,
   CASE s_suppkey % 8 WHEN 0 THEN 'contains' WHEN 1 THEN 'startswith' WHEN 2 THEN 'endswith' WHEN 3 THEN 'exact' WHEN 6 THEN 'contains' ELSE 'regex' END AS match_type,
   CASE s_suppkey % 8 WHEN 0 THEN 'swiggy' WHEN 1 THEN 'neft' WHEN 2 THEN 'owner' WHEN 3 THEN 'tfr' WHEN 4 THEN 'party\s+\d+' WHEN 5 THEN '(unclosed'
     WHEN 6 THEN 'BIGBASKET' ELSE 'atm|cash' END AS pattern, min(s_suppkey) AS rule_id FROM supplier GROUP BY ALL))"""

RULE_HIT = r"""(CASE match_type WHEN 'contains' THEN contains(lower(narration), lower(pattern)) WHEN 'startswith' THEN starts_with(lower(narration), lower(pattern))
  WHEN 'endswith' THEN ends_with(lower(narration), lower(pattern)) WHEN 'exact' THEN lower(narration) = lower(pattern)
  ELSE regexp_matches(narration, CASE WHEN pattern = '(unclosed' THEN 'zzzzzz' ELSE pattern END, 'i') END)"""

RULED = f"""{RULES}, hit AS (SELECT id, rule_id, ru.ledger_name, row_number() OVER (PARTITION BY id ORDER BY priority, created_at, rule_id) AS n
  FROM tx JOIN ru ON tx.client_id = ru.client_id AND is_active AND {RULE_HIT})"""

RECURRING = f"""hist AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY txn_date DESC, id DESC) AS n FROM tx WHERE confirmed_ledger IS NOT NULL) WHERE n <= 200),
rec AS (SELECT DISTINCT t.id, m.ledger_name AS recurring_ledger FROM tx t JOIN mp m ON t.client_id = m.client_id AND m.pattern = {mapping_key('t.narration')} AND m.hit_count >= 2
  JOIN hist h ON h.client_id = t.client_id AND {mapping_key('h.narration')} = m.pattern AND h.confirmed_ledger = m.ledger_name AND (t.debit IS NOT NULL) = (h.debit IS NOT NULL)
  WHERE abs(coalesce(t.debit, t.credit) - coalesce(h.debit, h.credit)) <= 0.10 * greatest(coalesce(t.debit, t.credit), coalesce(h.debit, h.credit))
  AND (abs(date_diff('day', h.txn_date, t.txn_date)) BETWEEN 6 AND 8 OR abs(date_diff('day', h.txn_date, t.txn_date)) BETWEEN 12 AND 16
    OR abs(date_diff('day', h.txn_date, t.txn_date)) BETWEEN 25 AND 35 OR abs(date_diff('day', h.txn_date, t.txn_date)) % 30 <= 5
    OR abs(date_diff('day', h.txn_date, t.txn_date)) % 30 >= 25 OR abs(day(t.txn_date) - day(h.txn_date)) <= 5))"""

LEDGERS = """lg AS (SELECT n_nationkey AS client_id, unnest(['Salary', 'Rent', 'STAFF WELFARE', 'Travel']) AS name FROM nation WHERE n_nationkey % 5 <> 0)"""

ANSWERS = """tiers AS (SELECT id, statement_id, client_id, (row_number - 1) // 50 AS batch_no,
  unnest(CASE statement_id % 3 WHEN 0 THEN [1, 3] WHEN 1 THEN [2, 3] ELSE [3] END) AS tier FROM tx WHERE id % 3 <> 0),
an AS (SELECT *,
  CASE WHEN id % 97 = 1 AND (tier <> 3 OR id % 5 = 0) THEN 'Moon' WHEN id % 5 = 0 THEN 'salary' WHEN id % 5 = 1 THEN 'RENT' WHEN id % 5 = 2 THEN 'Staff welfare' WHEN id % 5 = 3 THEN 'Travel' END AS suggested_ledger FROM tiers)"""

JSON = """'{"balance":"' || CAST(balance AS VARCHAR) || '","credit":' || coalesce('"' || CAST(credit AS VARCHAR) || '"', 'null')
  || ',"debit":' || coalesce('"' || CAST(debit AS VARCHAR) || '"', 'null') || ',"narration":"' || narration || '"}'"""

HASHED = f"""hx AS (SELECT *, sha256({JSON}) AS content_hash FROM tx)"""
CACHE = """ca AS (SELECT content_hash, min(id) AS first_id, min(id) % 3 AS hit_count FROM hx WHERE id % 4 = 0 GROUP BY content_hash)"""

USAGE = """us AS (SELECT event_id, event_id // 5 AS statement_id, CASE event_type WHEN 'view' THEN 'HIT' WHEN 'click' THEN 'MISS' ELSE 'FALLBACK' END AS cache_status,
  CASE event_type WHEN 'view' THEN 'claude' WHEN 'click' THEN 'gpt4o-fallback' WHEN 'error' THEN 'claude-fallback' WHEN 'signup' THEN 'rule' ELSE 'heuristic' END AS source,
  TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS prompt_tokens, 2 * TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS completion_tokens FROM events)"""

EVENTS = """ev AS (SELECT event_id, ts, event_id // 5 AS statement_id, 'bank_' || CAST(user_id % 30 AS VARCHAR) AS bank_code,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'READY_FOR_REVIEW' WHEN 'click' THEN 'REVIEWED' WHEN 'purchase' THEN 'EXPORTED' ELSE 'UPLOADED' END AS status FROM events)"""

EXPORT = """ex AS (SELECT *, coalesce(debit, credit) AS amount, CASE WHEN debit IS NOT NULL THEN 'DEBIT' ELSE 'CREDIT' END AS tx_type,
  coalesce(nullif(confirmed_ledger, ''), nullif(suggested_ledger, '')) AS ledger_name, coalesce(confirmed_ledger, '') <> '' AS is_reviewed FROM en WHERE NOT is_ignored)"""

EDITS = """ed AS (SELECT CASE WHEN o_orderkey % 31 = 0 THEN -1 ELSE o_custkey END AS statement_id, o_orderkey AS id, o_orderkey % 2 = 0 AS sets_ledger, o_orderkey % 3 = 0 AS sets_ignored,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'Edited ' || CAST(o_orderkey % 5 AS VARCHAR) END AS new_ledger, o_orderkey % 9 = 0 AS new_ignored FROM orders WHERE o_orderkey % 6 IN (0, 2, 3))"""


def bordered(text: str) -> str:
    """RE2 takes only ASCII letters as word characters. A marked ASCII word around every accented letter gives it the
    word borders of Unicode; `unbordered` takes the marks out again."""
    return rf"regexp_replace({text}, '([\x{{00AA}}\x{{00B5}}\x{{00BA}}\x{{00C0}}-\x{{00D6}}\x{{00D8}}-\x{{00F6}}\x{{00F8}}-\x{{02AF}}\x{{0370}}-\x{{1FFF}}\x{{2C00}}-\x{{2DFF}}\x{{3040}}-\x{{D7FF}}])', '_QZQ_\1_QZQ_', 'g')"


def unbordered(text: str) -> str:
    return f"replace({text}, '_QZQ_', '')"
