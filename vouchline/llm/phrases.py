"""Phrases whose words stand together more often than their parts would, by level-wise counting with tries.

1. The texts become chunks of word numbers (a break between pieces and documents is -1), read once; words are summed by language, and
   those with `least` occurrences get a number over all languages, frequent words first. All later passes read the numbers.
2. Candidates of two words: both are frequent. Each chunk tells its distinct pairs; sums that reach `least` make a candidate. Of three
   words: both pairs in them are candidates, tested on the way through the trie of pairs and a bit table for the second pair.
3. Candidates are dealt by ranges of their keys into double-array tries of at most `TRIE_PHRASES` phrases, one broadcast after another.
   In a trie a word is its number's bytes, and a phrase ends where no other one shares its bytes; what is left is compared with its key.
   numpy takes the states of all text positions through it together, one byte after another, and counts the phrases met; the sums of
   all tasks are the counts f of the phrases. A pass through a trie of pairs also tells the candidates of three words.
4. Scores, the rule for phrases inside longer ones, and the ranks are DataFrame expressions on exact decimals.

Words are told apart by 64-bit hashes, pairs and triples by exact keys. A pass over the numbers is cheap (it looks only at the
positions in the trie's range), but their number grows with that of candidates: one for each `TRIE_PHRASES` of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouchline.llm.common import LOWER, U, Words, as_bytes, bits_hold, bits_table, chunks, gathered, mix, table, written
from vouchline.llm.registry import query
from vouchline.session import work_dir

LEAST, TOP = 10, 2000
#: Phrases of one trie: at most some 50 MB in each worker while it is used.
TRIE_PHRASES = 1 << 20
#: Phrases whose counts travel as one row of a task.
PIECE = 1 << 13
#: Keys that one task sorts together.
GROUP_KEYS = 1 << 20
BATCH_BYTES = 1 << 22
#: A row of numbers has some megabytes: without these, Parquet looks at sizes every hundred rows only, and a page, which is (un)packed
#: whole outside of the heap, grows with the rows of a task.
LARGE_ROWS = {"parquet.block.size": 1 << 24, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}
#: Bits of the table of pairs: a false hit costs traffic, never a result.
MAX_LOG2_BITS = 27
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(10, 14)]] = True
_BREAK = _PIECE.copy()
_BREAK[[9, 32]] = True


# --- texts as word numbers --------------------------------------------------------------------------------------------------------

def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in gathered(batches):
        langs = batch.column("lang").fill_null("und").dictionary_encode()
        names = langs.dictionary.to_pylist()
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names] or [0], np.uint64)
        lang_of = langs.indices.to_numpy()
        hashes, langs_, where, breaks, texts = [], [], [], [], []
        for i, _, data, offsets in chunks(batch.column("text")):  # what follows each byte is held for one of these only
            data = LOWER[data]
            w = Words(data, offsets, _BREAK)
            lang = lang_of[i + w.doc].astype(np.int32)
            ends = np.concatenate(([0], np.cumsum(_PIECE[data], dtype=np.int32)))
            apart = np.ones(len(w.doc), bool)
            apart[1:] = (w.doc[1:] != w.doc[:-1]) | (ends[w.starts[1:]] != ends[w.ends[:-1]])
            raw = data.tobytes()
            hashes.append(mix(w.hashes() ^ salt[lang]))
            langs_.append(lang)
            breaks.append(apart)
            where.append((w.starts, w.ends, np.full(len(lang), len(texts), np.int32)))
            texts.append(raw)
        starts, stops, text_of = (np.concatenate(x) for x in zip(*where))
        apart, lang = np.concatenate(breaks), np.concatenate(langs_)
        names_of, first, inverse, counts = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True, return_counts=True)
        codes = np.full(len(inverse) + int(apart.sum()), -1, np.int32)
        codes[np.arange(len(inverse)) + np.cumsum(apart)] = inverse
        words = pa.StructArray.from_arrays(
            [pa.array([names[x] for x in lang[first].tolist()], pa.string()),
             pa.array([texts[t][a:b] for t, a, b in zip(text_of[first].tolist(), starts[first].tolist(), stops[first].tolist())], pa.binary()).cast(pa.string()),
             pa.array(counts, pa.int64()), pa.array(names_of.view(np.int64))], ["lang", "word", "n", "h"])
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([codes.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), words)], ["chunk", "codes", "words"])
        number += 1


def _number_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers within the chunk become those of all chunks; -1 for words that are not frequent, runs of -1 are one."""
    for batch in batches:
        out = []
        for codes, known in zip(batch.column("codes"), batch.column("known")):
            codes = np.frombuffer(codes.as_buffer(), np.int32)
            numbers = np.full(int(codes.max(initial=-1)) + 2, -1, np.int32)  # the last one stands for -1
            if known.is_valid and len(known.values):
                numbers[known.values.field("at").to_numpy()] = known.values.field("id").to_numpy()
            codes = numbers[codes]
            keep = codes >= 0
            keep[1:] |= codes[:-1] >= 0
            out.append(codes[keep].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.binary())], ["chunk", "codes"])


def numbered(df: DataFrame, by: list, name: str) -> DataFrame:
    """`df` in the order of `by`, written, with id 0, 1, 2, ..."""
    df = written(df.orderBy(*by).withColumn("m", F.monotonically_increasing_id()), name)
    part = F.shiftright("m", 33)
    sizes = df.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row for each task of the sort
    before = np.concatenate(([0], np.cumsum([r["count"] for r in sizes])))[: len(sizes)].tolist()
    # from Arrow: rows of Python would leave idle Python workers in the executors
    bases = df.sparkSession.createDataFrame(pa.table({"part": pa.array([r["part"] for r in sizes], pa.int64()), "base": pa.array(before, pa.int64())}))
    return df.withColumn("part", part).join(F.broadcast(bases), "part").withColumn("id", (F.col("base") + F.col("m").bitwiseAND((1 << 33) - 1)).cast("int")).drop("part", "m", "base")


def encode(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunk, codes), frequent words (id, lang, word, n), and (lang, n) of all words."""
    # rows of numbers are large: batches to the workers are bounded by their bytes too
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    texts = docs.select("lang", as_bytes())
    parts = written(texts.mapInArrow(_chunk_rows, "chunk long, codes binary, words array<struct<lang string, word string, n long, h long>>"), "phrase-chunks", **LARGE_ROWS)
    there = parts.select("chunk", F.posexplode("words").alias("at", "w")).select("chunk", "at", "w.*")
    words = written(there.groupBy("h").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("n").alias("n")), "phrase-words")
    frequent = written(numbered(words.where(F.col("n") >= least), [F.desc("n"), "lang", "word"], "phrase-frequent"), "phrase-numbers")
    known = there.select("chunk", "at", "h").join(frequent.select("h", "id"), "h").groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("known"))
    codes = parts.select("chunk", "codes").join(known, "chunk", "left").mapInArrow(_number_rows, "chunk long, codes binary")
    return written(codes, "phrase-codes", **LARGE_ROWS), frequent, words.groupBy("lang").agg(F.sum("n").alias("n"))


# --- double-array tries -----------------------------------------------------------------------------------------------------------

class Trie:
    """A double-array trie over rows of bytes: sorted, distinct, of one length.

    The child of the node at slot s by byte b is at slot base[s] + b if check there is s. Leaves hold -1 - (number of the row) as base.
    With `cut`, a row has no nodes beyond the first that no other row shares: who gets to its leaf still has to compare the rest.
    """

    def __init__(self, rows: np.ndarray, cut: bool = False):
        n, depth = rows.shape
        self.depth = depth
        ends = np.full(n, depth, np.int8)
        if cut:
            shared = np.zeros(max(n - 1, 0), np.int8)  # first bytes that a row shares with the next one
            same = np.ones(len(shared), bool)
            for level in range(depth):
                same &= rows[1:, level] == rows[:-1, level]
                shared += same
            ends[:] = min(depth, 1)
            ends[1:] = np.maximum(ends[1:], shared + 1)
            ends[:-1] = np.maximum(ends[:-1], shared + 1)
        new = np.zeros(n, bool)
        symbols, parents, sizes, last = [], [], [1], []
        above = np.zeros(n, np.int32)
        for level in range(depth):
            new[:1] = n > 0
            new[1:] |= rows[1:, level] != rows[:-1, level]
            nodes = new & (ends > level)
            at = np.flatnonzero(nodes)
            symbols.append(rows[at, level].astype(np.int64))
            parents.append(above[at])
            last.append((np.flatnonzero(ends[at] == level + 1), at[ends[at] == level + 1]))
            above = np.cumsum(nodes, dtype=np.int32) - 1
            sizes.append(len(at))
        bases = self._place([np.bincount(p, minlength=k) for p, k in zip(parents, sizes)], symbols)
        self.base, self.check = np.zeros(self.slots, np.int32), np.full(self.slots, -1, np.int32)
        slot = np.zeros(1, np.int64)
        leaves = []
        for level in range(depth):
            self.base[slot] = bases[level]
            below = bases[level][parents[level]] + symbols[level]
            self.check[below] = slot[parents[level]]
            slot = below
            leaves.append((slot[last[level][0]], last[level][1]))
        for at, number in leaves:
            self.base[at] = -1 - number

    def _place(self, fans: list[np.ndarray], symbols: list[np.ndarray]) -> list[np.ndarray]:
        """A base for each node, so that no two children share a slot: nodes with many children first, those with one fill the gaps."""
        fan, symbol = np.concatenate(fans) if fans else np.zeros(0, np.int64), np.concatenate(symbols) if symbols else np.zeros(0, np.int64)
        first = np.cumsum(fan) - fan
        wide = int((fan > 32).sum())
        room = 256 * (wide + 2) + 2 * len(symbol)
        self.slots = room + 256
        used = np.zeros(self.slots, bool)
        used[0] = True
        base = np.zeros(len(fan), np.int64)
        random = np.random.default_rng(len(symbol))
        start = 256
        for node in np.flatnonzero(fan > 32).tolist():
            base[node] = start
            used[start + symbol[first[node] : first[node] + fan[node]]] = True
            start += 256
        for node in sorted(np.flatnonzero((fan > 8) & (fan <= 32)).tolist(), key=lambda x: -fan[x]):
            own = symbol[first[node] : first[node] + fan[node]]
            while True:
                tries = random.integers(start, room, 32)
                free = np.flatnonzero(~used[tries[:, None] + own].any(axis=1))
                if len(free):
                    base[node] = tries[free[0]]
                    used[base[node] + own] = True
                    break
        claim = np.zeros(self.slots, np.int64)
        for k in range(8, 1, -1):
            left = np.flatnonzero(fan == k)
            while len(left):
                tries = random.integers(1, room, len(left))
                at = tries[:, None] + symbol[first[left][:, None] + np.arange(k)]
                free = np.flatnonzero(~used[at].any(axis=1))
                claim[at[free]] = free[:, None]
                won = free[(claim[at[free]] == free[:, None]).all(axis=1)]
                base[left[won]] = tries[won]
                used[at[won]] = True
                left = np.delete(left, won)
        one = np.flatnonzero(fan == 1)
        base[one] = 256 + np.flatnonzero(~used[256:])[: len(one)] - symbol[first[one]]
        cuts = np.cumsum([len(f) for f in fans])[:-1] if fans else []
        return np.split(base, cuts)

    def walk(self, states: np.ndarray, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(which of the states live on, where they are) after the bytes of one word each."""
        alive = np.arange(len(states))
        for shift in range(8 * (width - 1), -1, -8):
            to = self.base[states] + ((codes[alive] >> shift) & 255)
            ok = self.check[to] == states
            alive, states = alive[ok], to[ok]
        return alive, states


class PhraseTrie:
    """Phrases as sorted keys: pairs (first number << 32 | second), and the third numbers or None."""

    def __init__(self, pairs: np.ndarray, third: np.ndarray | None, width: int):
        self.pairs, self.third, self.width = pairs, third, width
        self.low, self.high = (int(pairs[0]), int(pairs[-1])) if len(pairs) else (1, 0)
        columns = [pairs >> 32, pairs & 0xFFFFFFFF] + ([] if third is None else [third.astype(np.int64)])
        rows = np.stack([(c >> shift & 255).astype(np.uint8) for c in columns for shift in range(8 * (width - 1), -1, -8)], axis=1) if len(pairs) else np.zeros((0, width * len(columns)), np.uint8)
        self.trie = Trie(rows, cut=True)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions at which a phrase of this trie starts, number of the phrase): all positions advance together."""
        length = 2 if self.third is None else 3
        n = len(codes) - length + 1
        if n <= 0 or not len(self.pairs):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero((codes[:n] >= self.low >> 32) & (codes[:n] <= self.high >> 32) & (codes[1 : n + 1] >= 0))
        states, left = np.zeros(len(at), np.int32), at
        ends, numbers = [], []
        for word in range(length):
            for shift in range(8 * (self.width - 1), -1, -8):
                alive, states = self.trie.walk(states, codes[left + word] >> shift, 1)
                left = left[alive]
                base = self.trie.base[states]
                done = base < 0
                ends.append(left[done])
                numbers.append(-1 - base[done])
                left, states = left[~done], states[~done]
        at, number = np.concatenate(ends), np.concatenate(numbers).astype(np.int64)
        same = self.pairs[number] == (codes[at].astype(np.int64) << 32 | codes[at + 1])
        if self.third is not None:
            same &= self.third[number] == codes[at + 2]
        return at[same], number[same]


def _codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for codes in batch.column("codes"):
            yield np.frombuffer(codes.as_buffer(), np.int32)


#: What tasks tell each other: counts of the phrases of a trie (`COUNTS`: numbers within a piece, how often each) or candidates of three
#: words (`TRIPLES`: keys of a part, how often each, at most `least`).
_TOLD = "kind int, part long, keys binary, seen binary"
_MET = "pair long, third int, a long"
COUNTS, TRIPLES = 0, 1


def _told(kind: int, part, keys: list, seen: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(keys), pa.int32()), pa.array(part, pa.int64()), pa.array([x.tobytes() for x in keys], pa.binary()), pa.array([x.tobytes() for x in seen], pa.binary())], ["kind", "part", "keys", "seen"])


def _pass_rows(batches: Iterator[pa.RecordBatch], phrases, tell) -> Iterator[pa.RecordBatch]:
    """What this task met of the trie's phrases, `PIECE` phrases to a row; before that, what `tell` makes of each chunk's positions."""
    t = phrases.value
    counts = np.zeros(len(t.pairs), np.int64)
    met, held = [], 0
    for codes in _codes_of(batches):
        at, number = t.find(codes)
        if tell:
            yield from tell(codes, at, number)
        met.append(number.astype(np.int32))
        held += len(number)
        if held > len(counts):
            counts += np.bincount(np.concatenate(met), minlength=len(counts))
            met, held = [], 0
    if held:
        counts += np.bincount(np.concatenate(met), minlength=len(counts))
    for piece in range(-(-len(counts) // PIECE)):
        part = counts[piece * PIECE : (piece + 1) * PIECE]
        some = np.flatnonzero(part)
        if len(some):
            yield _told(COUNTS, [piece], [some.astype(np.int32)], [part[some]])


def _sum_rows(batches: Iterator[pa.RecordBatch], phrases, least: int) -> Iterator[pa.RecordBatch]:
    """(pair, third, a) of counted phrases, (pair, third, null) of candidates. Rows come sorted: one piece or part is held at a time."""
    t = phrases.value
    now, sums, keys, seen = None, np.zeros(PIECE, np.int64), [], []

    def close() -> pa.RecordBatch:
        if now[0] == COUNTS:
            some = np.flatnonzero(sums)
            at = now[1] * PIECE + some
            third = np.full(len(some), -1, np.int32) if t.third is None else t.third[at]
            return pa.RecordBatch.from_arrays([pa.array(t.pairs[at]), pa.array(third), pa.array(sums[some])], ["pair", "third", "a"])
        key = _summed(np.concatenate(keys), np.concatenate(seen), least)
        return pa.RecordBatch.from_arrays([pa.array(t.pairs[key >> 32]), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.nulls(len(key), pa.int64())], ["pair", "third", "a"])

    for batch in batches:
        for kind, part, k, n in zip(batch.column("kind").to_pylist(), batch.column("part").to_pylist(), batch.column("keys"), batch.column("seen")):
            if (kind, part) != now:
                if now is not None:
                    yield close()
                now, sums, keys, seen = (kind, part), np.zeros(PIECE, np.int64), [], []
            if kind == COUNTS:
                sums[np.frombuffer(k.as_buffer(), np.int32)] += np.frombuffer(n.as_buffer(), np.int64)
            else:
                keys.append(np.frombuffer(k.as_buffer(), np.int64).copy())  # not the whole batch
                seen.append(np.frombuffer(n.as_buffer(), np.int32).copy())
    if now is not None:
        yield close()


# --- candidates -------------------------------------------------------------------------------------------------------------------

def _blocks(keys: np.ndarray, groups: int, least: int, kind: int = TRIPLES) -> Iterator[pa.RecordBatch]:
    """The distinct keys of a chunk, dealt by hash: (kind, part, keys, how often each, at most `least`)."""
    keys, n = np.unique(keys, return_counts=True)
    if not len(keys):
        return
    part = (mix(keys.view(np.uint64)) % U(groups)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    keys, n, part = keys[order], np.minimum(n[order], least).astype(np.int32), part[order]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    ends = np.append(cuts[1:], len(part))
    yield _told(kind, part[cuts], [keys[a:b] for a, b in zip(cuts, ends)], [n[a:b] for a, b in zip(cuts, ends)])


def _pair_blocks(batches: Iterator[pa.RecordBatch], groups: int, least: int) -> Iterator[pa.RecordBatch]:
    for codes in _codes_of(batches):
        wide = codes.astype(np.int64)
        ok = (wide[:-1] >= 0) & (wide[1:] >= 0)
        yield from _blocks((wide[:-1] << 32 | wide[1:])[ok], groups, least)


def _triple_blocks(codes: np.ndarray, at: np.ndarray, number: np.ndarray, groups: int, least: int, bits) -> Iterator[pa.RecordBatch]:
    """Keys (number of the pair in its trie << 32 | third word), for the positions at which a pair starts."""
    ok = at + 2 < len(codes)
    at, number = at[ok], number[ok]
    ok = codes[at + 2] >= 0
    at, number = at[ok], number[ok]
    ok = bits_hold(bits.value, mix((codes[at + 1].astype(np.int64) << 32 | codes[at + 2]).view(np.uint64)))
    yield from _blocks(number[ok] << 32 | codes[at[ok] + 2], groups, least)


def _summed(keys: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """The distinct keys that occur `least` times or more."""
    order = np.argsort(keys)
    keys = keys[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[cuts][np.add.reduceat(n[order].astype(np.int64), cuts) >= least]


def _frequent_keys(rows: pa.Table, least: int) -> pa.Table:
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("keys")])
    n = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in rows.column("seen")])
    return pa.table({"key": _summed(keys, n, least)})


def _candidates(blocks: DataFrame, least: int) -> DataFrame:
    return blocks.drop("kind").groupBy("part").applyInArrow(lambda rows: _frequent_keys(rows, least), "key long")


def _tries(rows: DataFrame, count: int, most: int, width: int) -> Iterator[PhraseTrie]:
    """rows(pair[, third]) dealt by ranges of their keys, `most` phrases or fewer to a trie."""
    third = "third" in rows.columns
    order = ["pair", "third"] if third else ["pair"]
    tries = -(-count // most)
    cuts = [None] * 2
    if tries > 1:
        # ranges of equal size by the rank of the key: the sort is Spark's, the driver gets one row for each range
        rows = written(numbered(rows, order, "phrase-order"), "phrase-ranks")
        cuts = range(0, tries * most + 1, most)
    for low, high in zip(cuts, cuts[1:]):
        part = rows if low is None else rows.where((F.col("id") >= low) & (F.col("id") < high))
        found = part.select(*order).toArrow()
        pairs = found["pair"].to_numpy()
        other = found["third"].to_numpy() if third else np.zeros(len(pairs), np.int32)
        at = np.lexsort((other, pairs))
        yield PhraseTrie(pairs[at].astype(np.int64), other[at].astype(np.int32) if third else None, width)


def count_phrases(codes: DataFrame, frequent: DataFrame, least: int = LEAST, most: int = TRIE_PHRASES, group_keys: int = GROUP_KEYS) -> tuple[DataFrame, DataFrame]:
    """(g1, g2, a) and (g1, g2, g3, a): all phrases of two and three words that occur `least` times or more."""
    spark = codes.sparkSession
    size = frequent.agg(F.count("*").alias("words"), F.sum("n").alias("n")).first()
    width = max(1, -(-int(size["words"] or 1).bit_length() // 8))
    groups = max(1, -(-int(size["n"] or 0) // group_keys))
    least_ = least
    pairs = written(_candidates(codes.mapInArrow(lambda it: _pair_blocks(it, groups, least_), _TOLD), least).withColumnRenamed("key", "pair"), "phrase-pairs")
    n = pairs.count()
    hashed = _mixed(pairs)
    bits = spark.sparkContext.broadcast(bits_table(hashed, "h", min(MAX_LOG2_BITS, max(16, (16 * n).bit_length()))))
    tell = lambda *met: _triple_blocks(*met, groups, least_, bits)
    found = _read(spark, [_passed(codes, trie, least, tell, "phrase-pass-2") for trie in _tries(pairs, n, most, width)])
    bits.destroy()
    every = found.where("a is null").select("pair", "third")
    counted = _read(spark, [_passed(codes, trie, least, None, "phrase-pass-3") for trie in _tries(every, every.count(), most, width)])
    g1, g2 = F.shiftright("pair", 32).cast("int").alias("g1"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("g2")
    twos = found.where(F.col("a") >= least).select(g1, g2, "a")
    threes = counted.where(F.col("a") >= least).select(g1, g2, F.col("third").alias("g3"), "a")
    return twos, threes


def _mixed(pairs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column("pair").to_numpy().view(np.uint64)).view(np.int64))], ["h"])

    return pairs.select("pair").mapInArrow(rows, "h long")


def _passed(codes: DataFrame, trie: PhraseTrie, least: int, tell, name: str) -> str:
    """The folder of (pair, third, a): what all positions meet of a trie, see `_sum_rows`."""
    spark = codes.sparkSession
    phrases = spark.sparkContext.broadcast(trie)
    told = codes.mapInArrow(lambda it: _pass_rows(it, phrases, tell), _TOLD)
    path = work_dir(spark, name)
    told.repartition("kind", "part").sortWithinPartitions("kind", "part").mapInArrow(lambda it: _sum_rows(it, phrases, least), _MET).write.parquet(path)
    phrases.destroy()
    return path


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(_MET).parquet(*paths) if paths else spark.createDataFrame([], _MET)


# --- scores -----------------------------------------------------------------------------------------------------------------------

def _score(l: str, r: str) -> str:
    """floor(1000000 * a * a / (l * r)), exact: the product needs up to 37 digits."""
    d = lambda x: f"cast({x} as decimal(15,0))"
    return f"(cast({d('a')} * {d('a')} * 1000000 as decimal(38,0)) div cast({d(l)} * {d(r)} as decimal(38,0)))"


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, most: int = TRIE_PHRASES, group_keys: int = GROUP_KEYS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    Null langs are `und`, null texts empty; every row counts, also one that repeats another. A language without a phrase that occurs
    `least` times has no row.
    """
    codes, frequent, totals = encode(docs, least)
    twos, threes = count_phrases(codes, frequent, least, most, group_keys)
    ones = frequent.select("id", "lang", "word", "n")
    f = lambda name, n: ones.select(F.col("id").alias(name), F.col("n").alias(n))
    two = twos.join(f("g1", "l"), "g1").join(f("g2", "r"), "g2").withColumn("score", F.expr(_score("l", "r")))
    inner = threes.select("g1", "g2", "a").union(threes.select("g2", "g3", "a")).groupBy("g1", "g2").agg(F.max("a").alias("longer"))
    two = two.join(inner, ["g1", "g2"], "left").where("longer is null or 100 * longer < 50 * a")
    two = two.select("g1", "g2", F.lit(None).cast("int").alias("g3"), "a", "l", "r", "score")
    three = threes.join(f("g1", "l1"), "g1").join(f("g3", "r2"), "g3").join(twos.select("g1", "g2", F.col("a").alias("l2")), ["g1", "g2"])
    three = three.join(twos.select(F.col("g1").alias("g2"), F.col("g2").alias("g3"), F.col("a").alias("r1")), ["g2", "g3"])
    three = three.withColumns({"s1": F.expr(_score("l1", "r1")), "s2": F.expr(_score("l2", "r2"))})
    pick = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    three = three.select("g1", "g2", "g3", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), F.least("s1", "s2").alias("score"))
    found = two.unionByName(three).join(ones.select(F.col("id").alias("g1"), "lang", F.col("word").alias("w1")), "g1")
    # only what can still be ranked gets its words
    first = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    found = found.withColumn("first", first).where(F.col("first") <= top)
    for g, w in (("g2", "w2"), ("g3", "w3")):
        found = found.join(ones.select(F.col("id").alias(g), F.col("word").alias(w)), g, "left")
    found = found.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    found = found.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


# The same result from all phrases, grouped.
PHRASES_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
u AS (SELECT lang, unnest(w) AS x, unnest(w[2:]) AS y, unnest(w[3:]) AS z FROM w),
f1 AS (SELECT lang, x, count(*) AS f FROM u GROUP BY lang, x),
f2 AS (SELECT lang, x, y, count(*) AS f FROM u WHERE y IS NOT NULL GROUP BY lang, x, y),
f3 AS (SELECT lang, x, y, z, count(*) AS f FROM u WHERE z IS NOT NULL GROUP BY lang, x, y, z HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
o AS (SELECT lang, x, y, max(f) AS longer FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY lang, x, y),
c2 AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, p.f AS l, q.f AS r FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.x = f2.x JOIN f1 q ON q.lang = f2.lang AND q.x = f2.y
       LEFT JOIN o ON o.lang = f2.lang AND o.x = f2.x AND o.y = f2.y WHERE f2.f >= 10 AND (o.longer IS NULL OR 100 * o.longer < 50 * f2.f)),
t AS (SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.f AS a, l1.f AS l1, r1.f AS r1, l2.f AS l2, r2.f AS r2,
             1000000::HUGEINT * f3.f * f3.f // (l1.f::HUGEINT * r1.f) AS s1, 1000000::HUGEINT * f3.f * f3.f // (l2.f::HUGEINT * r2.f) AS s2
      FROM f3 JOIN f1 l1 ON l1.lang = f3.lang AND l1.x = f3.x JOIN f2 r1 ON r1.lang = f3.lang AND r1.x = f3.y AND r1.y = f3.z
              JOIN f2 l2 ON l2.lang = f3.lang AND l2.x = f3.x AND l2.y = f3.y JOIN f1 r2 ON r2.lang = f3.lang AND r2.x = f3.z),
s AS (SELECT lang, phrase, a, l, r, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM c2
      UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)::BIGINT FROM t)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s JOIN n USING (lang)
QUALIFY rank <= 2000
"""


@query("op11_phrase_collocations", PHRASES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`; nulls, repeated rows and empty tables as `collocations` says."""
    return collocations(table(spark, sf_dir, "documents"))
