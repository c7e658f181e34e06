"""Removal of word windows that an earlier document has too, by super-k-mer partitioning.

1. The minimiser of a window is the smallest hash among its runs of `run` words. Consecutive windows with one minimiser form a
   super-k-mer. A first pass sends only (minimiser, smallest and largest id, count, smallest and largest hash of the super-k-mer's words),
   combined before the shuffle. Minimisers met under one id only need no more.
2. Where all super-k-mers of a minimiser are the same words, their windows repeat alike: each goes with (id, place) to a join with the
   smallest id, without its words.
3. Otherwise each is packed as one string of its words and sent to the minimiser's bucket. There windows are sorted, equal ones compared
   word by word, and those that also start under a smaller id are marked.
4. A minimiser with more than `hot` different super-k-mers is one no task could hold: these go as single windows, named by 128 bits,
   whose smallest id is combined before the shuffle. Which way a minimiser goes changes nothing in the result.
5. Marked ranges go back to their texts.

Which way each goes is told to the tasks by bit tables of bounded size; a false hit costs traffic, never a result. Ids are compared as
numbers. A null id is larger than any other, and no row with a null id removes anything from another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.llm.common import U, Words, _powers, as_bytes, bits_hold, bits_table, chunks, mix, sequence_hash, table, written
from vouchline.llm.registry import query

WINDOW, RUN = 50, 10
#: Super-k-mers of one minimiser that a task may have to sort together.
HOT = 10_000
#: Largest bit table, as a power of two: 2^27 bits are 16 MB.
MAX_LOG2_BITS = 27
NO_ID = np.iinfo(np.int64).max


def _packs(w: Words, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window's word, number of windows, minimiser) of each super-k-mer of a chunk."""
    at = w.windows(window)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    h = w.hashes()
    low = sequence_hash(h, np.arange(len(h) - run + 1), run)
    span, length = window - run + 1, 1
    while 2 * length <= span:
        low = np.minimum(low[: len(low) - length], low[length:])
        length *= 2
    if length < span:
        rest = span - length
        low = np.minimum(low[: len(low) - rest], low[rest:])
    low = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), low[first]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NO_ID).to_numpy()


def _sums(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Running sums over words from which the hash of any stretch comes at once."""
    power, inverse = _powers(len(w.starts) + 1)
    sums = np.zeros(len(w.starts) + 1, np.uint64)
    np.cumsum(w.hashes() * power[: len(w.starts)], out=sums[1:])
    return sums, inverse


def _minimisers(batches: Iterator[pa.RecordBatch], window: int, run: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = _ids(batch)
        for i, _, data, offsets in chunks(batch.column("text")):
            w = Words(data, offsets)
            first, n, low = _packs(w, window, run)
            if not len(low):
                continue
            sums, inverse = _sums(w)
            words = mix((sums[first + n + window - 1] - sums[first]) * inverse[first] + n.astype(np.uint64)).view(np.int64)
            order = np.argsort(low, kind="stable")
            low, doc, words = low[order], ids[i + w.doc[first]][order], words[order]
            new = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(low[new].view(np.int64)), *(pa.array(f.reduceat(v, new)) for v in (doc, words) for f in (np.minimum, np.maximum)), pa.array(np.diff(np.append(new, len(low))))],
                ["mini", "lo", "hi", "least", "most", "n"])


def _same_rows(batches: Iterator[pa.RecordBatch], window: int, run: int, same) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = _ids(batch)
        for i, _, data, offsets in chunks(batch.column("text")):
            w = Words(data, offsets)
            first, n, low = _packs(w, window, run)
            keep = bits_hold(same.value, low)
            first, n, low = first[keep], n[keep], low[keep]
            doc = w.doc[first]
            at = first - w.first_word[doc]
            yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(ids[i + doc]), batch.column("row").take(pa.array(i + doc)), pa.array(at), pa.array(at + n + window - 1)], ["mini", "doc_id", "row", "from", "to"])


def _pack_rows(batches: Iterator[pa.RecordBatch], window: int, run: int, wanted, other) -> Iterator[pa.RecordBatch]:
    """Super-k-mers with their words, of minimisers in the table `wanted` and not in `other`."""
    for batch in batches:
        ids = _ids(batch)
        for i, _, data, offsets in chunks(batch.column("text")):
            w = Words(data, offsets)
            first, n, low = _packs(w, window, run)
            keep = bits_hold(wanted.value, low)
            if other is not None:
                keep &= ~bits_hold(other.value, low)
            first, n, low = first[keep], n[keep], low[keep]
            raw = data.tobytes()
            packed = [b" ".join(raw[w.starts[a] : w.ends[a + c + window - 2]].split()) for a, c in zip(first.tolist(), n.tolist())]
            doc = w.doc[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(low.view(np.int64)), pa.array(ids[i + doc]), batch.column("row").take(pa.array(i + doc)),
                 pa.array(first - w.first_word[doc]), pa.array(packed, pa.binary())], ["mini", "doc_id", "row", "at", "words"])


def _windows(words: pa.Array, window: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of packed strings, the positions of their windows, and a 64-bit hash of each window."""
    if not isinstance(words, pa.Array):
        words = words.combine_chunks()
    (_, _, data, offsets), = chunks(words, 1 << 62)
    w = Words(data, offsets)
    at = w.windows(window)
    sums, inverse = _sums(w)
    return w, at, mix((sums[at + window] - sums[at]) * inverse[at])


def _marked(rows: pa.Table, window: int) -> pa.RecordBatch:
    """Ranges of words, (doc_id, row, from, to), of windows that start under a smaller id in the same bucket."""
    w, at, h = _windows(rows.column("words"), window)
    ids, mini = rows.column("doc_id").to_numpy(), rows.column("mini").to_numpy()
    pack = w.doc[at]
    doc = ids[pack]
    order = np.lexsort((doc, h, mini[pack]))
    same = (h[order][1:] == h[order][:-1]) & (mini[pack][order][1:] == mini[pack][order][:-1])
    head = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(order)), 0)) if len(order) else order
    raw = w.data.tobytes()
    begin, end = w.starts[at], w.ends[at + window - 1] if len(at) else at
    suspects = np.flatnonzero(doc[order] > doc[order[head]]) if len(order) else order
    hit = np.zeros(len(at), bool)
    for x, y in zip(order[suspects].tolist(), order[head[suspects]].tolist()):
        if raw[begin[x] : end[x]] == raw[begin[y] : end[y]]:
            hit[x] = True
        else:  # two sequences with one hash: look through all of that hash
            hit[x] = any(doc[z] < doc[x] and raw[begin[x] : end[x]] == raw[begin[z] : end[z]] for z in np.flatnonzero(h == h[x]))
    at, pack = at[hit], pack[hit]
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (pack[1:] != pack[:-1]))) if len(at) else at
    last = np.append(new[1:], len(at))[: len(new)] - 1
    base = rows.column("at").to_numpy()[pack[new]] - w.first_word[pack[new]]
    take = pa.array(pack[new])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[pack[new]]), rows.column("row").combine_chunks().take(take), pa.array(at[new] + base), pa.array(at[last] + base + window)], ["doc_id", "row", "from", "to"])


def _buckets(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by minimiser; the last bucket of a batch waits for the rest of its rows."""
    wait = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if wait is None else [*wait.to_batches(), batch])
        mini = rows.column("mini").to_numpy()
        if not len(mini):
            continue
        cut = int(np.flatnonzero(mini == mini[-1])[0])
        if cut:
            yield _marked(rows.slice(0, cut).combine_chunks(), window)
        wait = rows.slice(cut)
    if wait is not None:
        yield _marked(wait.combine_chunks(), window)


def _single(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Windows of hot minimisers, one row each, named by two hashes."""
    for batch in batches:
        if batch.num_rows:
            w, at, h = _windows(batch.column("words"), window)
            take = pa.array(w.doc[at])
            where = batch.column("at").to_numpy()[w.doc[at]] + at - w.first_word[w.doc[at]]
            second = sequence_hash(w.hashes(), at, window)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(second.view(np.int64)), batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(where)], ["h1", "h2", "doc_id", "row", "at"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, kept = [], [], []
        for text, ranges in zip(batch.column("text"), batch.column("ranges")):
            words = (text.as_py() or b"").split()
            n = len(words)
            drop = np.zeros(n + 1, np.int64)
            for r in ranges.as_py() or ():
                drop[r["from"]] += 1
                drop[r["to"]] -= 1
            gone = np.cumsum(drop)[:n] > 0
            counts.append(n)
            removed.append(int(gone.sum()))
            kept.append(b" ".join(words if not removed[-1] else [x for x, g in zip(words, gone.tolist()) if not g]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def repeated_ranges(docs: DataFrame, window: int = WINDOW, run: int = RUN, hot: int = HOT) -> DataFrame:
    """doc_id (null: the largest number), row (hash of the text), from, to: word ranges that an earlier document has too."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), as_bytes())
    met = texts.select("doc_id", "text").mapInArrow(lambda it: _minimisers(it, window, run), "mini long, lo long, hi long, least long, most long, n long")
    met = met.groupBy("mini").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))
    kind = F.when(F.col("least") == F.col("most"), "same").when(F.col("n") > hot, "hot").otherwise("packed")
    met = written(met.where("lo < hi").select("mini", "lo", kind.alias("kind")), "minimisers")
    sizes = {r["kind"]: r["count"] for r in met.groupBy("kind").count().collect()}
    table_of = lambda k: spark.sparkContext.broadcast(bits_table(met.where(F.col("kind") == k), "mini", min(MAX_LOG2_BITS, max(16, (16 * sizes.get(k, 1)).bit_length()))))
    same, packed, heavy = table_of("same"), table_of("packed"), table_of("hot")

    alike = texts.mapInArrow(lambda it: _same_rows(it, window, run, same), "mini long, doc_id long, row long, `from` long, `to` long")
    alike = alike.join(met.where("kind = 'same'").select("mini", "lo"), "mini").where("lo < doc_id").select("doc_id", "row", "from", "to")
    packs = "mini long, doc_id long, row long, at long, words binary"
    cold = texts.mapInArrow(lambda it: _pack_rows(it, window, run, packed, heavy), packs)
    cold = cold.repartition("mini").sortWithinPartitions("mini").mapInArrow(lambda it: _buckets(it, window), "doc_id long, row long, `from` long, `to` long")
    if "hot" not in sizes:
        return alike.union(cold)
    single = texts.mapInArrow(lambda it: _single(_pack_rows(it, window, run, heavy, None), window), "h1 long, h2 long, doc_id long, row long, at long")
    least = single.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    warm = single.join(least, ["h1", "h2"]).where("lo < doc_id").select("doc_id", "row", F.col("at").alias("from"), (F.col("at") + window).alias("to"))
    return alike.union(cold).union(warm)


def substring_dedup(docs: DataFrame, window: int = WINDOW, run: int = RUN, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept: one row for each row of `docs`; kept is what stays of the text, words joined by one space.

    A word goes if a window of `window` words of its document covers it and the same words also start in a document with a smaller id;
    windows are judged on the input. Null and empty texts have no words. Rows that repeat an id never remove from one another.
    """
    ranges = repeated_ranges(docs, window, run, hot).groupBy("doc_id", "row").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))
    ranges = ranges.withColumnsRenamed({"doc_id": "known", "row": "row_"})
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes(), F.xxhash64("text").alias("row"))
    joined = texts.join(ranges, (F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("known")) & (F.col("row") == F.col("row_")), "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
