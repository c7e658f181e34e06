r"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Four base kinds keep every match that passes its check. Two further kinds are added where their score is high enough: bank accounts
(IBAN, mod-97) and national phone numbers, which need a word such as "call" or "phone" near them. Native DataFrame functions only.

Places come from splitting a text at the matches: a match starts where the pieces and matches before it end. The patterns use possessive
loops and start only where a run of their characters starts, so that a long run costs one pass and no stack: the matches are the same,
since whatever a run is followed by decides all starts within it alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.llm.common import table
from vouchline.llm.registry import query

KINDS = ("email", "ip", "card", "phone", "iban", "national_phone")
BASE = KINDS[:4]
#: (pattern, a cheap test that texts with a match pass)
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None),
    "national_phone": (r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])", None),
}
#: Score of a match by itself and with its checksum passed; near a word of its kind NEAR is added. Added kinds need THRESHOLD.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.7, "national_phone": 0.3}
NEAR, THRESHOLD, CONTEXT = 0.3, 0.6, 40
WORDS = {
    "email": "mail|contact|address", "ip": r"\bip\b|server|host|login", "card": "card|visa|credit|payment", "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|cuenta", "national_phone": "phone|tel|call|mobile|cell|fax",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 1, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters counted from A = 10, leaves 1 divided by 97."""
    plain = F.regexp_replace(value, r"\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    left = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda acc, i: F.when(code(i) >= 65, acc * 100 + code(i) - 55).otherwise(acc * 10 + code(i) - 48) % 97)
    return left == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 16) & (n <= 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, r"\x20", "")).between(15, 34) & mod97(value)
    return F.lit(True)


def _proposed(rows: DataFrame, kind: str, text: str) -> DataFrame:
    """Column `kind`: spans (kind, start, end, score) in order, ends exclusive, counted in code points."""
    pattern, sign = PATTERNS[kind]
    might = F.col(text).contains(sign) if sign else F.col(text).rlike("[0-9]")
    none = F.lit([]).cast("array<string>")
    hits, pieces = f"_{kind}_hits", f"_{kind}_pieces"
    rows = rows.withColumn(hits, F.when(might, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none))
    rows = rows.withColumn(pieces, F.when(F.size(hits) > 0, F.split(F.col(text), pattern, -1)).otherwise(none))
    places = f"_{kind}_places"
    steps = F.transform(F.col(hits), lambda h, i: F.struct(F.char_length(F.get(F.col(pieces), i)).alias("gap"), F.char_length(h).alias("length")))
    rows = rows.withColumn(places, F.aggregate(steps, F.array(F.lit(0)), lambda acc, x: F.concat(
        acc, F.array(F.element_at(acc, -1) + x["gap"], F.element_at(acc, -1) + x["gap"] + x["length"]))))

    def span(h: Column, i: Column) -> Column:
        around = F.concat(F.right(F.get(F.col(pieces), i), F.lit(CONTEXT)), F.lit(" "), F.left(F.get(F.col(pieces), i + 1), F.lit(CONTEXT)))
        near = F.lower(around).rlike(WORDS[kind])
        score = F.lit(SCORES[kind]) + F.when(near, NEAR).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), F.get(F.col(places), 2 * i + 1).alias("start"), F.get(F.col(places), 2 * i + 2).alias("end"),
                        F.least(score, F.lit(1.0)).alias("score"), _valid(kind, h).alias("valid"))

    keep = (lambda s: s["valid"]) if kind in BASE else (lambda s: s["valid"] & (s["score"] >= THRESHOLD))
    kept = F.filter(F.transform(F.col(hits), span), keep)
    rows = rows.withColumn(kind, F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))))
    return rows.drop(hits, pieces, places)


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with one column of spans for each of KINDS, in order of their starts; columns of these names are replaced.

    Whole texts are searched; a null or empty text has none. A national number that overlaps an international one is not added.
    """
    rows = docs.drop(*KINDS)
    rows = rows.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    for kind in KINDS:
        rows = _proposed(rows, kind, text)
    apart = F.filter("national_phone", lambda s: ~F.exists("phone", lambda p: (p["start"] < s["end"]) & (s["start"] < p["end"])))
    return rows.withColumn("national_phone", apart)


def listing(*kinds: str) -> Column:
    """`kind:start:end` of all spans, by kind and start, joined by commas."""
    return F.array_join(F.transform(F.concat(*kinds), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span of the text replaced by its kind in brackets; of overlapping spans the one that starts first stays."""
    found = find_spans(docs, text).withColumn("_spans", F.array_sort(F.concat(*KINDS), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])))
    start = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<string>").alias("out"))
    walk = F.aggregate("_spans", start, lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
        s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("out"))).otherwise(acc))
    out = found.withColumn("_walk", walk)
    whole = F.concat(F.array_join("_walk.out", ""), F.substring(F.col(text), F.col("_walk.at") + 1, F.char_length(text)))
    return out.withColumn(text, whole).drop("_walk", "_spans", *KINDS)


@query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listing(*BASE), 256).alias("base_sha256"), listing(*KINDS).alias("spans"))
