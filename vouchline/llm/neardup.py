"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find.

1. Every text becomes its set of word shingles (64-bit hashes). A SuperMinHash signature is taken: element x puts, in round j, the value
   j + u_j(x) at slot p_j(x) of a random permutation, and each slot keeps its minimum. All elements do a round at once; a text leaves
   as soon as each slot is below the next round's number, which is after one or two rounds for texts of usual length (early stopping).
2. Texts with equal sets form one class; only its smallest id goes on. Bands of signature values are hashed to bucket keys.
3. Each bucket gets a pivot, the member with most bucket mates. Every other member is verified against it on full sets, once for all
   buckets. A bucket whose members all match their pivot is settled, however large.
4. In buckets that are not settled, members are compared on full sets, in blocks, each pair of blocks in a task of its own;
   a task emits only a spanning forest of the links it finds, not the links.
5. Components of all verified links; the smallest id is the component.

With 30 bands of 5 values a pair at Jaccard 0.85 is missed by banding with probability 2e-8, at 0.8 with 7e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.llm.common import LOWER, U, Words, as_bytes, chunks, mix, sequence_hash, table, written
from vouchline.llm.components import components
from vouchline.llm.registry import query

#: Members of a block in step 4: bounds what one task holds.
BLOCK = 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and where each text's start. Texts shorter than k words are one shingle."""
    w = Words(LOWER[data], offsets)
    h = w.hashes()
    at = w.windows(k)
    doc, value = w.doc[at], sequence_hash(h, at, k)
    for n in range(1, k):
        short = np.flatnonzero(w.counts == n)
        doc, value = np.concatenate((doc, short)), np.concatenate((value, sequence_hash(h, w.first_word[short], n)))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if len(doc):
        keep = np.ones(len(doc), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        doc, value = doc[keep], value[keep]
    return value, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=w.texts))))


def signatures(values: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signature of each non-empty set: m values as 64-bit integers (round in the high bits, fraction below)."""
    texts = len(starts) - 1
    doc = np.repeat(np.arange(texts), np.diff(starts))
    best = np.full((texts, m), np.iinfo(np.uint64).max, np.uint64)
    flat = best.reshape(-1)
    seed, where, perm = values.copy(), doc, None
    for j in range(m):
        r = mix(seed + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = j + ((r & U(0xFFFFFFFF)) % U(m - j)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            rows = np.arange(len(seed))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
            perm[rows, j] = slot
        np.minimum.at(flat, where * m + slot, (U(j) << U(48)) | (r >> U(16)))
        open_ = best.max(axis=1) >= (U(j + 1) << U(48))
        stay = open_[where]
        if not stay.any():
            break
        if j == 0:
            perm = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (int(stay.sum()), m)).copy()
            rows, first = np.arange(len(perm)), k[stay]
            perm[rows, first] = 0
            perm[rows, 0] = first
        else:
            perm = perm[stay]
        seed, where = seed[stay], where[stay]
    return best


def _signed(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in chunks(batch.column("text"), 1 << 18):
            values, starts = shingle_sets(data, offsets, k)
            sizes = np.diff(starts)
            full = np.flatnonzero(sizes)
            sums = np.concatenate((np.zeros((1, 2), np.uint64), np.cumsum(np.stack((mix(values), mix(values ^ U(0x5851F42D4C957F2D))), axis=1), axis=0)))
            digest = (sums[starts[1:]] - sums[starts[:-1]]).view(np.int64)
            keys = np.zeros((len(sizes), bands), np.uint64)
            if len(full):
                s = signatures(values, np.concatenate(([0], np.cumsum(sizes[full]))), bands * rows)
                for b in range(bands):
                    keys[full, b] = mix(sequence_hash(s[:, b * rows : (b + 1) * rows].reshape(-1), np.arange(len(full)) * rows, rows) + U(b))
            ends = np.arange(len(sizes) + 1, dtype=np.int32) * bands
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[i:j], pa.array(sizes), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))],
                ["doc_id", "n_shingles", "d1", "d2", "bands"])


def _set_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in chunks(batch.column("text")):
            values, starts = shingle_sets(data, offsets, k)
            yield pa.RecordBatch.from_arrays([batch.column("node")[i:j], pa.array([values[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary())], ["node", "items"])


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = batch.column("items_a"), batch.column("items_b")
        good = []
        for x, y in zip(one, two):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            good.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "good"])


def block_links(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of side 0 and side 1 (or all, where a member has side 2: one block with itself)."""
    order = np.argsort(ids, kind="stable")
    ids, sides, sets = ids[order], sides[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(items, kind="stable")
    items, owner = items[by], owner[by]
    new = np.ones(len(items), bool)
    new[1:] = items[1:] != items[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
        take = (column >= lo) & (column < lo + 4096)
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[take], column[take] - lo] = 1
        common += part @ part.T
    both = common.astype(np.int64)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    linked &= (sides[:, None] != sides[None, :]) | (sides[:, None] == 2)
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(np.triu(linked, 1))):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(ids[y]), int(ids[x])))
    return out


def _blocks(frame: pa.Table, percent: int) -> pa.Table:
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in frame.column("items")]
    links = block_links(frame.column("node").to_numpy(), frame.column("side").to_numpy(), sets, percent)
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def in_blocks(opened: DataFrame, block: int) -> DataFrame:
    """key, node, p, q, side: the blocks (p, q) in which each member of opened(key, node, n, n_loose, loose) is compared.

    Loose members meet all members. The others are linked to the pivot, so they are one component already: no block holds two of theirs
    to compare, and they are copied by the number of loose members, not by the size of the bucket.
    """
    size = lambda count: F.ceil(count / block).cast("int")
    first, rest = size(F.col("n_loose")), size(F.col("n") - F.col("n_loose"))
    h = F.xxhash64("node")
    own = F.when(F.col("loose"), F.pmod(h, F.col("first"))).otherwise(F.col("first") + F.pmod(h, F.col("rest"))).cast("int")
    last = F.when(F.col("loose"), F.col("first") + F.col("rest")).otherwise(F.col("first")) - 1
    placed = opened.withColumns({"first": first, "rest": rest}).select("key", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return placed.select(
        "key", "node", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 30, rows: int = 5, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of `docs`.

    Links hold between texts with 100 * |common shingles| >= percent * |all shingles|. A null or empty text has no shingles and no
    links. Rows that repeat a doc_id are one document: they share a component and are kept or not together, and link by any of their
    texts. A row with a null id has a null component, takes part in no link and is kept. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes())
    signed = written(
        texts.mapInArrow(lambda it: _signed(it, k, bands, rows), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "signatures")
    ids = signed.where("doc_id is not null and n_shingles > 0")
    classes = ids.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.min_by("bands", "doc_id").alias("bands"))
    classes = written(classes, "classes")
    # a doc_id with several texts ties their classes together
    named = ids.join(classes.where("copies > 1").select("n_shingles", "d1", "d2", "node"), ["n_shingles", "d1", "d2"], "left").select("doc_id", F.coalesce("node", "doc_id").alias("node"))
    ties = named.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    ties = named.join(ties, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()

    members = classes.select("node", "n_shingles", "d1", "d2", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("mates")).where("mates > 1")
    members = written(members.join(sizes, "key"), "members")
    degree = members.groupBy("node").agg(F.sum("mates").alias("degree"))
    pivots = members.join(degree, "node").groupBy("key").agg(F.max_by("node", F.struct("degree", F.negative("node"))).alias("pivot"))
    stars = members.join(pivots, "key").select("key", "node", "pivot", "d1", "d2")
    pairs = written(stars.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes.select("node", "n_shingles", "d1", "d2"), "node")
    # the text of a class: of its smallest id, and with the class's set if that id repeats
    sourced = texts.withColumnRenamed("doc_id", "node").join(wanted.select("node").distinct(), "node", "left_semi")
    sets = sourced.mapInArrow(lambda it: _set_rows(it, k), "node long, items binary")
    sets = written(sets.dropDuplicates(["node", "items"]), "sets")
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
    met = written(met.mapInArrow(lambda it: _verified(it, percent), "a long, b long, good boolean").groupBy("a", "b").agg(F.max("good").alias("good")), "verified")
    links = met.where("good").select("a", "b")

    # buckets that are not settled by their pivot, one for each set of members (the same members have the same pivot)
    loose = ~F.coalesce("good", F.col("node") == F.col("pivot"))
    verdicts = met.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "good")
    open_ = (
        stars.join(verdicts, ["node", "pivot"], "left")
        .groupBy("key").agg(F.count("*").alias("n"), F.count_if(loose).alias("n_loose"), F.first("pivot").alias("pivot"),
                            F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
        .where("n > 2 and n_loose > 0").groupBy("n", "n_loose", "x", "y").agg(F.min("key").alias("key"), F.min_by("pivot", "key").alias("pivot")))
    opened = members.join(open_.select("key", "n", "n_loose", "pivot"), "key").join(verdicts, ["node", "pivot"], "left").withColumn("loose", loose)
    placed = in_blocks(opened, block)
    found = placed.join(sets, "node").groupBy("key", "p", "q").applyInArrow(lambda t: _blocks(t, percent), "a long, b long")

    groups = components(links.union(found.select("a", "b")).union(ties))
    low = named.join(groups, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component"))
    moved = low.where("doc_id <> component")
    return signed.select("doc_id", "n_shingles").join(moved, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        (F.col("component").isNull()).alias("kept"))


@query("op3_minhash_neardup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
