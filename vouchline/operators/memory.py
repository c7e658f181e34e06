"""Ledger memory: learning from confirmed rows, token-overlap suggestions and vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vouchline.functions.text import mapping_text, pattern_key, with_pattern

VECTOR_SIZE = 64
PACK_ROWS = 2048
#: Items of a group around a centre, unless a client has more than MAX_GROUPS times as many.
GROUP_ROWS = 256
MAX_GROUPS = 1024
#: Lanes that packs are dealt into on either side of the search across groups.
LANES = 8
#: Packs of queries whose best items a task holds at a time.
PACKS_HELD = 64
#: Columns of a pack of queries beside a pack of items.
MET = ["client_id", "q_grp", "q_pack", "q_keys", "q_vectors", "q_floor", "i_keys", "i_vectors"]
#: What rounding may add to a bound of a cosine.
MARGIN = 1e-6
EXAMPLE_NARRATIONS = 20
EXAMPLE_PER_NARRATION = 3
EXAMPLE_MIN_SCORE = 0.3
EXAMPLE_ROWS = 5


def learn(confirmed: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """Upsert (client, pattern): hit_count grows, the latest ledger wins.

    confirmed: client_id, narration, ledger_name, used_at, event_id (tie-break), and narration_clean, which comes before narration,
    where rows are enriched. Blank ledgers and patterns are ignored.
    """
    latest = F.struct("used_at", "event_id")
    fresh = (
        with_pattern(confirmed.withColumn("ledger_name", F.trim("ledger_name")).filter("ledger_name <> ''"))
        .groupBy("client_id", "pattern")
        .agg(F.count(F.lit(1)).alias("hit_count"), F.max_by("ledger_name", latest).alias("ledger_name"),
             F.max("used_at").alias("last_used_at"))
    )
    if mappings is None:
        return fresh.select("client_id", "pattern", "ledger_name", "hit_count", "last_used_at")
    new = fresh.select("client_id", "pattern", F.struct("ledger_name", "hit_count", "last_used_at").alias("_n"))
    return mappings.join(new, ["client_id", "pattern"], "full").select(
        "client_id", "pattern", F.coalesce("_n.ledger_name", "ledger_name").alias("ledger_name"),
        (F.coalesce("hit_count", F.lit(0)) + F.coalesce("_n.hit_count", F.lit(0))).alias("hit_count"),
        F.coalesce("_n.last_used_at", "last_used_at").alias("last_used_at"),
    )


def tokens(pattern: Column) -> Column:
    return F.array_distinct(F.split(pattern, " "))


def token_suggestions(queries: DataFrame, mappings: DataFrame) -> DataFrame:
    """Per (client, pattern) and ledger: the most used mapping that shares a token, with its token overlap as score.

    The winner per ledger is the most used mapping, not the closest one. So the best mapping per (client, token, ledger)
    is found before the join, and a query meets one row per token and ledger, never all mappings of its client.
    """
    best = F.struct("hit_count", "last_used_at", "pattern")
    per_token = (
        mappings.withColumn("token", F.explode(tokens(F.col("pattern"))))
        .groupBy("client_id", "token", "ledger_name").agg(F.max(best).alias("best"))
    )
    wanted = queries.select("client_id", F.explode(F.filter(F.array("pattern"), lambda p: p != "")).alias("pattern")).distinct()
    winners = (
        wanted.withColumn("token", F.explode(tokens(F.col("pattern"))))
        .join(per_token, ["client_id", "token"])
        .groupBy("client_id", "pattern", "ledger_name").agg(F.max("best").alias("best"))
    )
    mine, theirs = tokens(F.col("pattern")), tokens(F.col("best.pattern"))
    score = F.size(F.array_intersect(mine, theirs)) / F.size(F.array_union(mine, theirs))
    return winners.select(
        "client_id", "pattern", "ledger_name", F.col("best.pattern").alias("mapping"),
        F.when(F.col("best.pattern") == F.col("pattern"), F.lit(1.0)).otherwise(score).alias("score"),
        F.col("best.hit_count").alias("hit_count"),
    )


# ---------------------------------------------------------------- vectors


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_counts(text: Column, size: int = VECTOR_SIZE) -> Column:
    """Signed token counts per dimension; dimension and sign come from the token's SHA-256."""
    def feature(digest: Column) -> Column:
        slot = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % size).cast("int")
        odd = F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 1
        return F.struct(slot.alias("slot"), F.when(odd, -1).otherwise(1).alias("sign"))

    digests = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.sha2(t, 256))
    return _let(
        F.transform(digests, feature),
        lambda features: F.transform(
            F.sequence(F.lit(0), F.lit(size - 1)),
            lambda d: F.aggregate(features, F.lit(0), lambda acc, f: acc + F.when(f.slot == d, f.sign).otherwise(0)),
        ),
    )


def unit_vector(counts: Column) -> Column:
    """Scaled to length one; all zeros stay zeros."""
    def scaled(values: Column) -> Column:
        norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v))
        return _let(norm, lambda n: F.transform(values, lambda v: F.when(n > 0, v / n).otherwise(F.lit(0.0))))

    return _let(counts, scaled)


def embed(text: Column, size: int = VECTOR_SIZE) -> Column:
    return unit_vector(token_counts(text, size))


def backfill(mappings: DataFrame) -> DataFrame:
    """The mapping table with its vectors; write it partitioned by client."""
    return mappings.withColumn("vector", embed(F.col("pattern")))


def _sizes(df: DataFrame, by: list[str]) -> DataFrame:
    # counting the vectors themselves keeps this plan equal to those that use them, so that Spark can compute both from one exchange
    return df.groupBy(*by).agg(F.count("vector").alias("items"))


def _packed(df: DataFrame, key: str, name: str, rows: int, by: list[str], extra: tuple[str, ...] = (), sizes: DataFrame | None = None) -> DataFrame:
    """Rows of a key `by` in packs of about `rows`, so that no pack grows with the client or group."""
    packs = (_sizes(df, by) if sizes is None else sizes).select(*by, F.ceil(F.col("items") / rows).alias("_packs"))
    fields = {f"{name}_keys": key, f"{name}_vectors": "vector", **{f"{name}_{c}": c for c in extra}}
    return (
        df.join(packs, by)
        .withColumn("_pack", F.pmod(F.xxhash64(key), F.col("_packs")))
        .groupBy(*by, "_pack")
        .agg(F.collect_list(F.struct(*[F.col(c).alias(f) for f, c in fields.items()])).alias("_members"))
        .select(*by, "_pack", *[F.col(f"_members.{f}").alias(f) for f in fields])
    )


def _centres(items: DataFrame, group_rows: int) -> DataFrame:
    """(client_id, centres): one vector for about `group_rows` items of a client, at most MAX_GROUPS, picked by the hash of their item."""
    groups = _sizes(items, ["client_id"]).select("client_id", F.ceil(F.col("items") / group_rows).alias("_groups"))
    by_hash = W.partitionBy("client_id").orderBy(F.xxhash64("item"), "item")
    picked = items.withColumn("_n", F.row_number().over(by_hash)).filter(F.col("_n") <= MAX_GROUPS)
    return (
        picked.join(groups, "client_id").filter("_n <= _groups")
        .groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("_n", "vector"))).alias("_c"))
        .select("client_id", F.col("_c.vector").alias("centres"))
    )


def _nearest_centre(key: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                cosines = np.stack(row.x_vectors) @ np.stack(row.centres).T
                group = cosines.argmax(axis=1)
                yield pd.DataFrame({"client_id": row.client_id, key: row.x_keys, "vector": list(row.x_vectors), "grp": group.astype("int32"), "near": cosines.max(axis=1)})

    return run


def _grouped(df: DataFrame, key: str, centres: DataFrame, pack_rows: int) -> DataFrame:
    """`df` with the group of its nearest centre (`grp`) and the cosine to that (`near`)."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    packs = _packed(df, key, "x", pack_rows, ["client_id"]).drop("_pack").join(centres, "client_id")
    return packs.mapInPandas(_nearest_centre(key), f"client_id {types['client_id']}, {key} {types[key]}, vector array<double>, grp int, near double")


def _reached(k: int):
    """For a pack of queries of one group: the other groups in which one of them may find one of its k nearest, a row for each lane with such a group."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                vectors, centres, heads = np.stack(row.q_vectors), np.stack(row.centres), row.heads
                groups = np.array([h["grp"] for h in heads])
                count = np.array([h["items"] for h in heads])
                width = np.arccos(np.clip([h["least"] for h in heads], -1, 1))
                angle = np.arccos(np.clip(vectors @ centres[groups].T, -1, 1))
                upper = np.cos(np.maximum(angle - width, 0)) + MARGIN
                lower = np.cos(np.minimum(angle + width, np.pi)) - MARGIN
                # the k-th score is at least that of the best groups that hold k items together, each taken at its worst
                best = np.argsort(-lower, axis=1)
                filled = (np.cumsum(count[best], axis=1) >= k)
                sure = np.where(filled.any(axis=1), np.take_along_axis(lower, np.take_along_axis(best, filled.argmax(axis=1)[:, None], 1), 1)[:, 0], -np.inf)
                floor = np.maximum(np.nan_to_num(np.array(row.q_floor, dtype=float), nan=-np.inf), sure)
                wanted = (upper >= floor[:, None]) & (groups != row.grp)
                asking = np.flatnonzero(wanted.any(axis=1))
                places = np.flatnonzero(wanted.any(axis=0))
                lanes = sorted({(int(groups[p]) + n) % LANES for p in places for n in range(min(int(heads[p]["last"]) + 1, LANES))})
                if lanes:
                    yield pd.DataFrame({
                        "client_id": row.client_id, "q_grp": row.grp, "q_pack": row.q_pack, "i_lane": lanes, "reached": [groups[places].tolist()] * len(lanes),
                        "q_keys": [[row.q_keys[q] for q in asking]] * len(lanes), "q_vectors": [[row.q_vectors[q] for q in asking]] * len(lanes),
                        "q_floor": [[row.q_floor[q] for q in asking]] * len(lanes),
                    })

    return run


def _pack_top_k(k: int):
    """The first k of each query of a pack among all packs of items that a task compares it with: (client_id, query, item, score)."""
    def rows(client, keys, found) -> pd.DataFrame:
        return pd.DataFrame({
            "client_id": client, "query": [q for q, best in zip(keys, found) for _ in best],
            "item": [b[2] for best in found for b in best], "score": [-b[0] for best in found for b in best],
        })

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for frame in frames:
            for row in frame.itertuples(index=False):
                pack = (row.client_id, row.q_grp, row.q_pack)
                if pack not in held and len(held) == PACKS_HELD:
                    for (client, *_), (keys, found, _) in held.items():
                        yield rows(client, keys, found)
                    held = {}
                if pack not in held:
                    held[pack] = row.q_keys, [[] for _ in row.q_keys], np.nan_to_num(np.array(row.q_floor, dtype=float), nan=-np.inf)
                _, found, floor = held[pack]
                scores = np.round(np.stack(row.q_vectors) @ np.stack(row.i_vectors).T, 9) + 0.0
                kept = min(k, scores.shape[1])
                # neither below the k-th score so far nor below that of this pack of items
                least = np.maximum(floor, -np.partition(-scores, kept - 1, axis=1)[:, kept - 1])
                asking, near = np.nonzero(scores >= least[:, None])
                starts = np.flatnonzero(np.diff(asking, prepend=-1))
                for at, to in zip(starts, [*starts[1:], len(asking)]):
                    q = asking[at]
                    fresh = [(-float(scores[q, i]), row.i_keys[i] is not None, row.i_keys[i]) for i in near[at:to]]
                    found[q] = sorted(found[q] + fresh)[:k]
                    if len(found[q]) == k:
                        floor[q] = max(floor[q], -found[q][-1][0])
        for (client, *_), (keys, found, _) in held.items():
            yield rows(client, keys, found)

    return run


def _first_k(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("client_id", "query").orderBy(F.desc("score"), "item"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def _meet(asking: DataFrame, packs: DataFrame) -> DataFrame:
    """Packs of queries beside each pack of items of their own group."""
    spread = asking.withColumn("i_pack", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    spread = spread.select("client_id", "grp", F.col("grp").alias("q_grp"), F.col("_pack").alias("q_pack"), "i_pack", "q_keys", "q_vectors", F.transform("q_keys", lambda _: F.lit(None).cast("double")).alias("q_floor"))
    return spread.join(packs.withColumnRenamed("_pack", "i_pack"), ["client_id", "grp", "i_pack"]).select(*MET)


def _meet_in_lanes(reached: DataFrame, packs: DataFrame) -> DataFrame:
    """Packs of queries beside each pack of items of a group they reach.

    Packs are dealt into LANES lanes on either side and meet by pair of lanes, so a pack is copied once for each lane, however many packs
    it meets: what is shuffled grows with the vectors, not with the pairs.
    """
    asking = reached.withColumn("q_lane", F.pmod(F.col("q_grp") + F.col("q_pack"), F.lit(LANES)).cast("int"))
    offered = packs.withColumns({
        "i_lane": F.pmod(F.col("grp") + F.col("_pack"), F.lit(LANES)).cast("int"), "q_lane": F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))),
    }).drop("_pack")
    return asking.join(offered, ["client_id", "q_lane", "i_lane"]).filter(F.array_contains("reached", F.col("grp"))).select(*MET)


def vector_meetings(queries: DataFrame, items: DataFrame, k: int, pack_rows: int = PACK_ROWS, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first k of each query within its own group, and the pairs of packs within groups and across them that are compared."""
    queries, items = queries.filter("vector is not null"), items.filter("vector is not null")
    types = {f.name: f.dataType.simpleString() for f in [*queries.schema, *items.schema]}
    scored = f"client_id {types['client_id']}, query {types['query']}, item {types['item']}, score double"
    group = ["client_id", "grp"]
    centres = _centres(items, group_rows)
    asked, held = _grouped(queries, "query", centres, pack_rows), _grouped(items, "item", centres, pack_rows)
    heads = held.groupBy(*group).agg(F.count("vector").alias("items"), F.min("near").alias("least")).withColumn("last", F.ceil(F.col("items") / pack_rows) - 1)
    packs = _packed(held, "item", "i", pack_rows, group, sizes=heads)

    at_home = _meet(_packed(asked, "query", "q", pack_rows, group).join(heads, group), packs)
    home = _first_k(at_home.mapInPandas(_pack_top_k(k), scored), k).groupBy("client_id", "query").agg(F.collect_list(F.struct("item", "score")).alias("_home"))
    floors = home.select("client_id", "query", F.when(F.size("_home") >= k, F.array_min("_home.score")).alias("floor"))
    searched = centres.join(heads.groupBy("client_id").agg(F.collect_list(F.struct("grp", "items", "least", "last")).alias("heads")), "client_id")
    leaving = _packed(asked.join(floors, ["client_id", "query"], "left"), "query", "q", pack_rows, group, ("floor",)).withColumnRenamed("_pack", "q_pack").join(searched, "client_id")
    reached = leaving.mapInPandas(_reached(k), f"client_id {types['client_id']}, q_grp int, q_pack bigint, i_lane int, reached array<int>, q_keys array<{types['query']}>, q_vectors array<array<double>>, q_floor array<double>")
    return home.select("client_id", "query", F.inline("_home")), at_home, _meet_in_lanes(reached, packs)


def vector_top_k(queries: DataFrame, items: DataFrame, k: int, pack_rows: int = PACK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Exact k nearest items by cosine for every query, within its client.

    queries: client_id, query, vector; items: client_id, item, vector, all of unit length or zero; equal scores go by item; rows without
    a vector are left out. Items are grouped around centres, queries first meet the group of their nearest centre. Angles obey the triangle
    inequality, so no item of a group is closer to a query than its centre less the widest angle of the group: a group whose bound does not
    reach the k-th score found so far is not compared. Packs of queries meet packs of items; a pair of packs is one matrix product, and a task
    returns k rows per query of all pairs it compares, so neither the join nor the shuffle carries single pairs. Packs meet by client,
    group and item pack at home and by pair of lanes across groups, so neither a large client nor a large group is one key.
    """
    types = {f.name: f.dataType.simpleString() for f in [*queries.schema, *items.schema]}
    scored = f"client_id {types['client_id']}, query {types['query']}, item {types['item']}, score double"
    home, _, across = vector_meetings(queries, items, k, pack_rows, group_rows)
    return _first_k(home.unionByName(across.mapInPandas(_pack_top_k(k), scored)), k)


def search(queries: DataFrame, mappings: DataFrame, k: int, pack_rows: int = PACK_ROWS) -> DataFrame:
    """The k closest mappings for every distinct (client, pattern).

    Patterns that differ only in hashed-away parts share one vector. Vectors are therefore made distinct on both sides,
    with the k most used mappings kept per vector: those are the only ones that can be among the k best.
    """
    def vector_key() -> Column:
        return F.array_join(F.col("counts").cast("array<string>"), ",")

    def vectors(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy("client_id", key).agg(F.first("counts").alias("counts")).select(
            "client_id", key, unit_vector(F.col("counts")).alias("vector")
        )

    q = queries.select("client_id", "pattern").distinct().withColumn("counts", token_counts(F.col("pattern"))).withColumn("query", vector_key())
    m = mappings.withColumn("counts", token_counts(F.col("pattern"))).withColumn("_vector", vector_key())
    # Items are named so that their order is the order of their best mapping: equal scores then keep the right vectors.
    inside = W.partitionBy("client_id", "_vector").orderBy(F.desc("hit_count"), "pattern")
    name = F.concat(F.lpad((F.lit(10**15) - F.col("hit_count")).cast("string"), 16, "0"), F.lit(" "), F.col("pattern"))
    # The rank stands alone in its window: Spark then keeps k rows per vector before the exchange, and the name is found among those.
    m = m.withColumn("_n", F.row_number().over(inside)).filter(F.col("_n") <= k).withColumn("item", F.first(name).over(inside))

    near = vector_top_k(vectors(q, "query"), vectors(m, "item"), k, pack_rows)
    members = near.select("client_id", "query", "item", "score").join(
        m.select("client_id", "item", F.col("pattern").alias("mapping"), "ledger_name", "hit_count"), ["client_id", "item"]
    )
    place = F.row_number().over(W.partitionBy("client_id", "query").orderBy(F.desc("score"), F.desc("hit_count"), "mapping"))
    best = members.withColumn("place", place).filter(F.col("place") <= k)
    return q.select("client_id", "pattern", "query").join(best, ["client_id", "query"]).select(
        "client_id", "pattern", "mapping", "ledger_name", "score", "hit_count", "place"
    )


def examples(work: DataFrame, mappings: DataFrame) -> DataFrame:
    """Example pairs per statement: its first 20 distinct narrations, three mappings each, one per ledger, at most five.

    work: the rows that missed the cache. They are asked by their cleaned narration, as mappings are learnt, and by the narration itself
    where that is empty or missing.
    """
    said = mapping_text(F.col("narration_clean"), F.col("narration")) if "narration_clean" in work.columns else F.col("narration")
    first_seen = work.groupBy("statement_id", "client_id", said.alias("_said")).agg(F.min("row_number").alias("seen"))
    early = W.partitionBy("statement_id").orderBy("seen")
    asked = (
        first_seen.withColumn("_n", F.row_number().over(early)).filter(F.col("_n") <= EXAMPLE_NARRATIONS)
        .withColumn("pattern", pattern_key(F.col("_said")))
    )
    found = asked.join(
        search(asked, mappings, EXAMPLE_PER_NARRATION).filter(F.col("score") >= EXAMPLE_MIN_SCORE), ["client_id", "pattern"]
    )
    first = found.groupBy("statement_id", "ledger_name").agg(F.min_by(F.struct("mapping", "score", "_n", "place"), F.struct("_n", "place")).alias("b"))
    order = W.partitionBy("statement_id").orderBy("b._n", "b.place")
    return first.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= EXAMPLE_ROWS).select(
        "statement_id", "position", F.col("b.mapping").alias("narration"), F.col("ledger_name").alias("ledger"),
        F.bround("b.score", 4).alias("score"),
    )


def suggestions(queries: DataFrame, mappings: DataFrame, limit: int = 5) -> DataFrame:
    """Token suggestions first, vector suggestions for ledgers not yet named, best `limit` by score and use."""
    by_token = token_suggestions(queries, mappings).withColumns({"source": F.lit("db"), "_rank": F.lit(0)})
    by_vector = (
        search(queries, mappings, limit).drop("place")
        .groupBy("client_id", "pattern", "ledger_name")
        .agg(F.max_by(F.struct("mapping", "score", "hit_count"), F.struct("score", "hit_count", "mapping")).alias("b"))
        .select("client_id", "pattern", "ledger_name", "b.*").withColumns({"source": F.lit("vector"), "_rank": F.lit(1)})
    )
    one = by_token.unionByName(by_vector).groupBy("client_id", "pattern", "ledger_name").agg(
        F.min_by(F.struct("mapping", "score", "source", "hit_count"), "_rank").alias("b")
    ).select("client_id", "pattern", "ledger_name", "b.*")
    place = W.partitionBy("client_id", "pattern").orderBy(F.desc("score"), F.desc("hit_count"), "ledger_name")
    return one.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit).withColumn("score", F.bround("score", 4))
