"""URL filtering: host and path rules, and a list of blocked sites held in a cascade of Bloom filters.

The sites of the corpus are all known, so membership can be exact: level 0 holds the listed sites, level 1 the sites that are not listed
yet pass level 0, level 2 the listed ones that pass level 1, and so on until no site is misjudged. A page is judged by an expression over
its own host: no join. Native DataFrame functions only.

A level's bits go to the driver and into the expression, so their number is limited by `MAX_BITS`; a longer list is joined instead, by
the same keys and with the same result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.llm.common import table, written
from vouchline.llm.registry import query

#: Bits of one filter, 1 MiB of them at most; bits for each key and probes.
MAX_BITS, BITS_PER_KEY, PROBES = 1 << 23, 10, 5
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: First labels of sites on the block list.
LISTED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url; both empty where it is null or has no `://`."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def site(host: str = "host") -> Column:
    """The last three labels of a host (all of it if it has fewer): what the list names."""
    return F.substring_index(host, ".", -3)


def match_rule(rules=RULES, host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _place(key: Column, level: int, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(probe)), F.lit(bits))


def _passes(key: Column, level: int, filter_: bytes) -> Column:
    out = F.lit(True)
    for probe in range(PROBES):
        at = _place(key, level, probe, len(filter_) * 8)
        byte = F.conv(F.hex(F.substring(F.lit(filter_), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        out = out & (F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1)
    return out


def _filter_of(keys: DataFrame, level: int, bits: int) -> bytes:
    """The bits of a level, set by Spark; the driver gets the bytes that are not zero."""
    places = F.array(*[_place(F.col("key"), level, p, bits) for p in range(PROBES)])
    rows = keys.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 3).alias("byte")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("at").bitwiseAND(7).cast("int"))).alias("v")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[rows["byte"].to_numpy()] = rows["v"].to_numpy().astype(np.uint8)
    return out.tobytes()


def cascade(universe: DataFrame) -> list[bytes] | None:
    """Filters of universe(key, listed), which has every key once; None if the list is too long for them."""
    levels: list[bytes] = []
    rest = {True: universe.where("listed"), False: universe.where("not listed")}
    while True:
        level = len(levels)
        mine = level % 2 == 0
        n = rest[mine].count()
        if not n:
            return levels
        bits = max(64, 1 << (n * BITS_PER_KEY - 1).bit_length())
        if bits > MAX_BITS:
            return None
        levels.append(_filter_of(rest[mine], level, bits))
        rest[not mine] = rest[not mine].where(_passes(F.col("key"), level, levels[-1]))


def is_listed(key: Column, levels: list[bytes]) -> Column:
    """Exact for every key of the universe that the filters were built on."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(range(len(levels))):
        out = F.when(_passes(key, level, levels[level]), out).otherwise(F.lit(level % 2 == 1))
    return out


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """`pages` with host, path, rule and verdict; listed(key) names blocked sites. Columns of these names are replaced.

    A rule decides where one fits, else the list: block a page whose site is on it. A null url, or one without `://`, has an empty host
    and path and is allowed unless the empty site is listed.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "key", "listed")
    host, path = host_and_path()
    rows = pages.withColumns({"host": host, "path": path})
    known = listed.select("key").distinct().withColumn("listed", F.lit(True))
    universe = rows.select(site().alias("key")).distinct().join(known, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    universe = written(universe, "sites")
    levels = cascade(universe)
    rule, verdict = match_rule(rules)
    if levels is None:
        rows = rows.withColumn("key", site()).join(universe.where("listed"), "key", "left").drop("key")
        bad = F.coalesce("listed", F.lit(False))
    else:
        bad = is_listed(site(), levels)
    return rows.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(bad, "block").otherwise("allow"))}).drop("listed")


URL_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.[^.]*\.[^.]*$') THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""


@query("op7_url_filter", URL_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked sites: three labels of which the first is one of `LISTED`."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    sites = pages.select(site_of_url().alias("key")).distinct()
    listed = sites.where(F.col("key").rlike(r"^[^.]+\.[^.]*\.[^.]*$") & F.substring_index("key", ".", 1).isin(*LISTED))
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def site_of_url(url: str = "url") -> Column:
    return F.substring_index(host_and_path(url)[0], ".", -3)
