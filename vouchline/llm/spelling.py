"""Spelling variants: words one edit apart, found by walking a trie that is a table of edges.

Nodes are prefixes, named by a 64-bit hash; only prefixes at which words part, end or begin their walk are nodes, so an edge carries
one or more code points. A state is (word, rest of the word, node, edits so far). States without an edit follow their own word, so they
are the nodes of its way. They are joined with the edges of their nodes that begin with another code point, where the one edit is spent
as a replacement, an insertion or a deletion. From then on every level joins the states with the one edge that their rest begins with; a
state that no edge continues is dropped at once, one that ends on a word is a neighbour.

Two words one edit apart share their first or their last half. So each word walks twice, from the node of its first half in the trie of
all words and from that of its last half in the trie of all words reversed: no state stands near a root, where all words meet. A node
has at most as many edges as there are letters, so no key multiplies rows without bound.

Each level is written to the shared folder. The number of levels is that of the nodes on the longest way behind an edit.
"""

from __future__ import annotations

import collections
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouchline.llm.common import LOWER, Words, as_bytes, chunks, gathered, table, written
from vouchline.llm.registry import query

LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: One occurrence in this many is taken with a code point left out.
SLIP = 199
#: Longest word, in bytes, whose checksums are computed together with those of all others.
SHORT = 64
_ASCII = np.zeros(256, bool)
_ASCII[97:123] = True


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of A-Z, a-z and U+00C0 to U+00FF (in UTF-8: 0xC3 and one more byte), A-Z in lower case."""
    data = LOWER[data]
    wide = data == 0xC3
    inside = _ASCII[data] | wide
    inside[1:] |= wide[:-1]
    return Words(np.where(inside, data, 32).astype(np.uint8), offsets)


def _word_rows(batches: Iterator[pa.RecordBatch], least: int, slip: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of a chunk of texts."""
    for batch in gathered(batches):
        ids = batch.column("doc_id").to_pylist()
        for i, _, data, offsets in chunks(batch.column("text"), 1 << 62):
            w = letter_runs(data, offsets)
            if not len(w.starts):
                continue
            _, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
            raw = w.data.tobytes()
            words = [raw[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist())]
            own = np.fromiter((zlib.crc32(x) for x in words), np.uint32, len(words))
            size = np.fromiter(map(len, words), np.int64, len(words))
            points = size - np.fromiter((x.count(b"\xc3") for x in words), np.int64, len(words))
            # crc32(head + word) = crc32(head) moved on by as many zero bytes as the word has, xor crc32(word)
            heads = [f"{'' if x is None else x}:".encode() for x in ids[i : i + w.texts]]
            moved = np.zeros((w.texts, SHORT + 1), np.uint32)
            moved[:, 0] = [zlib.crc32(x) for x in heads]
            for n in range(1, min(SHORT, int(size.max())) + 1):
                moved[:, n] = (moved[:, n - 1] >> np.uint32(8)) ^ _CRC[moved[:, n - 1] & 255]
            use = np.flatnonzero(points[inverse] >= least)
            doc, kind = w.doc[use], inverse[use]
            h = moved[doc, np.minimum(size[kind], SHORT)] ^ own[kind]
            for x in np.flatnonzero(size[kind] > SHORT).tolist():
                h[x] = zlib.crc32(words[kind[x]], int(moved[doc[x], 0]))
            slips = h % np.uint32(slip) == 0
            counts = np.bincount(kind[~slips], minlength=len(words))
            some = np.flatnonzero(counts)
            more = collections.Counter()
            for x, c in zip(kind[slips].tolist(), h[slips].tolist()):
                word = words[x].decode()
                at = c % len(word)
                if len(word) > least:
                    more[(word[:at] + word[at + 1 :]).encode()] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[x] for x in some.tolist()] + list(more), pa.binary()).cast(pa.string()), pa.array(counts[some].tolist() + list(more.values()), pa.int64())], ["word", "n"])


def count_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """word, n: words of `least_chars` code points and `least_count` occurrences or more."""
    found = docs.select("doc_id", as_bytes()).mapInArrow(lambda it: _word_rows(it, least_chars, slip), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _keys(words: DataFrame) -> DataFrame:
    """Each word both ways: side, word, key, half (code points of the part that is walked at once)."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("key")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("key")))
    return words.select("word", F.explode(sides).alias("s")).select("word", "s.side", "s.key", F.floor(F.char_length("word") / 2).cast("int").alias("half"))


def trie_steps(keys: DataFrame) -> DataFrame:
    """side, word, key, half, at, node, ends, child, to, child_word: the nodes on each word's way from its half on, with the next node of it.

    `ends` is the word that ends at the node, or null. A word's way is the prefixes of one word, no more.
    """
    paths = keys.withColumn("at", F.explode(F.sequence(F.floor((F.char_length("key") - 1) / 2).cast("int"), F.char_length("key"))))
    paths = paths.select("side", "word", "key", "half", "at", F.expr("xxhash64(side, substring(key, 1, at))").alias("node"), F.expr("substring(key, at + 1, 1)").alias("next"))
    paths = written(paths, "spelling-paths")
    nodes = paths.groupBy("node").agg(F.min("next").alias("lo"), F.max("next").alias("hi"), F.max(F.col("at") == F.col("half")).alias("start"), F.max(F.when(F.col("next") == "", F.col("word"))).alias("ends"))
    nodes = nodes.where("lo <> hi or lo = '' or start").select("node", "ends")
    way = Window.partitionBy("word", "side").orderBy("at")
    steps = paths.join(nodes, "node").select("side", "word", "key", "half", "at", "node", "ends")
    return steps.withColumns({"child": F.lead("node").over(way), "to": F.lead("at").over(way), "child_word": F.lead("ends").over(way)})


def trie_edges(steps: DataFrame) -> DataFrame:
    """parent, first, label, child, child_word, after: each edge once. `after` holds the code points that edges of the child begin with."""
    edges = steps.where("child is not null").select(F.col("node").alias("parent"), F.expr("substring(key, at + 1, 1)").alias("first"), F.expr("substring(key, at + 1, to - at)").alias("label"), "child", "child_word")
    edges = written(edges.distinct(), "spelling-edges")
    after = edges.groupBy("parent").agg(F.array_join(F.collect_set("first"), "").alias("after")).withColumnRenamed("parent", "child")
    return edges.join(after, "child", "left").withColumn("after", F.coalesce("after", F.lit("")))


#: What is left of the word after an edge on which the one edit is spent: a replacement, an insertion, a deletion.
_SPENT = """explode(array(
 CASE WHEN rest <> '' AND startswith(substring(rest, 2), substring(label, 2)) THEN substring(rest, char_length(label) + 1) END,
 CASE WHEN startswith(rest, substring(label, 2)) THEN substring(rest, char_length(label)) END,
 CASE WHEN rest <> '' AND startswith(substring(rest, 2), label) THEN substring(rest, char_length(label) + 2) END))"""
#: Whether a state with the edit spent ends on a word or has an edge to go on.
_LIVES = "(rest = '' AND child_word IS NOT NULL) OR (rest <> '' AND contains(after, substring(rest, 1, 1)))"


def neighbours(words: DataFrame) -> DataFrame:
    """word, near: all pairs of `words` (distinct) that differ by exactly one inserted, deleted or replaced code point, both ways."""
    steps = written(trie_steps(_keys(words.select("word"))), "spelling-steps")
    edges = written(trie_edges(steps), "spelling-trie")
    # without an edit a word goes its own way only, so its states without one are known: the nodes of that way
    own = steps.where("at >= half")
    found = own.where("ends is not null and char_length(key) = at + 1").select("word", F.col("ends").alias("near"))
    states = own.select("word", "node", F.expr("substring(key, at + 1)").alias("rest"))
    met = states.join(edges, (F.col("node") == F.col("parent")) & (F.substring("rest", 1, 1) != F.col("first")))
    moved = met.select("word", "child", "child_word", "after", F.expr(_SPENT).alias("rest")).where("rest is not null")
    while True:
        moved = written(moved.where(_LIVES).select("word", F.col("child").alias("node"), "rest", F.when(F.col("rest") == "", F.col("child_word")).alias("near")), "spelling-states")
        found = found.unionByName(moved.where("near is not null").select("word", "near"))
        states = moved.where("rest <> ''").withColumn("first", F.substring("rest", 1, 1))
        if states.isEmpty():
            # hashes name the nodes: the pairs are compared letter by letter
            return found.distinct().where("levenshtein(word, near) = 1")
        met = states.join(edges, (F.col("node") == F.col("parent")) & (states["first"] == edges["first"])).where("startswith(rest, label)")
        moved = met.select("word", "child", "child_word", "after", F.expr("substring(rest, char_length(label) + 1)").alias("rest"))


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form), form never null -> word, root: the end of the chain of forms. The way is doubled with every round."""
    state = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = state.select(F.col("word").alias("w"), F.col("root").alias("r"))
        further = state.join(ahead, F.col("root") == F.col("w"), "left")
        if further.where("r is not null").isEmpty():
            return state
        state = written(further.select("word", F.coalesce("r", "root").alias("root")), "spelling-roots")


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words(word, n), each word once -> word, n, n_near, form, form_n, root.

    form is the near word with the largest n (ties: the smallest), if that n is `ratio` times the word's or more; else null. A word
    without near words has n_near 0, form null and itself as root. Without rows the result is empty.
    """
    words = written(words, "spelling-words")
    near = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("b"))
    judged = words.join(best, "word", "left").withColumn("taken", F.coalesce(-F.col("b.less") >= ratio * F.col("n"), F.lit(False)))
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("taken"), F.col("b.near")).alias("form"), F.when(F.col("taken"), -F.col("b.less")).alias("form_n"))
    judged = written(judged, "spelling-forms")
    ends = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each word of `documents`. Null texts have no words; the text of a null doc_id is empty; every row counts, also one
    that repeats another. Without words the result is empty."""
    return spelling_groups(count_words(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")
