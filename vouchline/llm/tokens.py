"""Token ids in shard files with a minimal perfect hash index.

A shard is one file: a JSON header line, the index, then the raw ids (2 bytes each where the vocabulary allows, else 4, little-endian),
documents in ascending id order. The index is a minimal perfect hash over the shard's keys (doc_id, n-th row of that id): levels of bit
arrays in which each key takes the first level where its bit is its own; the rank of that bit is the key's slot. For each slot the file
holds a 32-bit fingerprint of the key and the document's first and last id position, so a key is found in constant time and a key that
was never written is refused except once in 2^32.

Writing: documents are dealt by ranges of doc_id, each task writes its shard under a name of its own and returns one catalogue row per
document. Spark commits the catalogue, so a task that runs twice leaves an unused file and no double rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouchline.llm.common import U, chunks, gathered, mix, table, written
from vouchline.llm.registry import query
from vouchline.session import work_dir

END_ID = 2
#: Words whose ids a worker remembers; beyond it the memory starts anew with the next batch.
CACHE_WORDS = 1_000_000
#: Ids of a shard before a new one begins: bounds what a task holds in memory.
SHARD_IDS = 1 << 23
GAMMA = 2
#: Text that is encoded at once.
ENCODE_BYTES = 1 << 22
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"


class WordEncoder:
    """Ids of whole texts for a vocabulary whose pre-tokens never cross white space and end in a mark.

    Each distinct word of a batch is looked up once; its ids stand in one long array, from which numpy gathers those of all texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.stops = {"": [], **{s: self.tokenizer.encode(s, add_special_tokens=False).ids for s in ".,"}}
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {"": 0}
        self.first, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, f"<u{self.width}")

    def _list(self, words: list[str], first: np.ndarray, size: np.ndarray) -> None:
        self.words.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.first, self.size = np.concatenate((self.first, first)), np.concatenate((self.size, size))

    def _list_ids(self, words: list[str], ids: list[int] | np.ndarray, size: np.ndarray) -> None:
        self._list(words, len(self.ids) + np.cumsum(size) - size, size)
        self.ids = np.concatenate((self.ids, np.asarray(ids, self.ids.dtype)))

    def _gather(self, place: np.ndarray) -> np.ndarray:
        """The ids of listed words, one after another."""
        size = self.size[place]
        before = np.cumsum(size) - size
        return self.ids[np.repeat(self.first[place] - before, size) + np.arange(int(size.sum()))]

    def _find(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def _learn(self, new: pa.Array) -> None:
        """Plain words go by their lower-case letters, many to a call; a stop behind them and all other words are encoded for themselves."""
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(new, _PLAIN)
        some = new.filter(plain)
        stems = pc.utf8_lower(pc.utf8_rtrim(some, ".,"))
        ask = [w for w in stems.unique().to_pylist() if w not in self.words]
        if ask:
            groups = [" ".join(ask[i : i + 256]) for i in range(0, len(ask), 256)]
            flat = np.array([i for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False) for i in e.ids])
            ends = np.flatnonzero(self.last[flat]) + 1
            if len(ends) != len(ask):
                raise ValueError("this vocabulary does not mark the end of each word")
            self._list_ids(ask, flat, np.diff(ends, prepend=0))
        place = self._find(stems.to_pylist())
        for stop, ids in self.stops.items():
            mine = pc.ends_with(some, stop) if stop else pc.invert(pc.match_substring_regex(some, "[.,]$"))
            words, at = some.filter(mine).to_pylist(), place[mine.to_numpy(zero_copy_only=False)]
            if not stop:
                self._list(words, self.first[at], self.size[at])
            elif words:
                size = self.size[at]
                self._list_ids(words, np.insert(self._gather(at).astype(np.int64), np.repeat(np.cumsum(size), len(ids)), np.tile(ids, len(words))), size + len(ids))
        odd = new.filter(pc.invert(plain)).to_pylist()
        if odd:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
            self._list_ids(odd, [i for ids in found for i in ids], np.fromiter(map(len, found), np.int64, len(found)))

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each word is listed; new ones are learnt together."""
        if len(self.words) > CACHE_WORDS:
            self._forget()
        names, known = words.to_pylist(), self.words.get
        place = np.fromiter((known(w, -1) for w in names), np.int64, len(names))
        new = np.flatnonzero(place < 0)
        if len(new):
            self._learn(words.take(pa.array(new)))
            place[new] = self._find([names[i] for i in new.tolist()])
        return place

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id behind it; how many each text has). `texts` are strings without nulls."""
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(texts)  # at the same six bytes; white space at either end leaves an empty word, which has no ids
        words = split.flatten().dictionary_encode()
        place = self._places(words.dictionary)[words.indices.to_numpy()]
        ends = np.cumsum(np.bincount(pc.list_parent_indices(split).to_numpy(), minlength=len(texts)))
        before = np.concatenate(([0], np.cumsum(self.size[place])))[ends]
        return np.insert(self._gather(place), before, end_id), np.diff(before, prepend=0) + 1

    def encode(self, text: bytes, end_id: int) -> bytes:
        return self.encode_all(pa.array([text.decode()], pa.string()), end_id)[0].tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# --- minimal perfect hash ---------------------------------------------------------------------------------------------------------

def key_hash(doc_id: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return mix(mix(doc_id.astype(np.int64).view(np.uint64)) ^ (nth.astype(np.uint64) * U(0x9E3779B97F4A7C15)))


def _bit(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h ^ U((level + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)) % U(size)).astype(np.int64)


def build_index(h: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(sizes of the levels, all their bits one after another). Equal hashes can't be told apart and are refused."""
    if len(np.unique(h)) != len(h):
        raise ValueError("two keys of a shard share one hash")
    sizes, bits, left = [], [], h
    while len(left):
        size = max(64, GAMMA * len(left))
        at = _bit(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def find_slots(h: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level holds it."""
    rank = np.concatenate(([0], np.cumsum(bits)))
    out, base = np.full(len(h), -1, np.int64), 0
    for level, size in enumerate(sizes):
        open_ = np.flatnonzero(out < 0)
        at = base + _bit(h[open_], level, size)
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        base += size
    return out


def _file_system(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path)))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would give it, so that the tasks' own reads and writes go to the same store as Spark's."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def write_shard(path: str, doc_id: np.ndarray, nth: np.ndarray, bodies: list[bytes], width: int) -> None:
    h = key_hash(doc_id, nth)
    sizes, bits = build_index(h)
    slots = find_slots(h, sizes, bits)
    lengths = np.array([len(b) // width for b in bodies], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    prints, first, last = np.zeros(len(h), "<u4"), np.zeros(len(h), "<i8"), np.zeros(len(h), "<i8")
    prints[slots], first[slots], last[slots] = (h >> U(32)).astype(np.uint32), starts[:-1], starts[1:]
    head = json.dumps({"format": "ids-mph-1", "keys": len(h), "ids": int(starts[-1]), "width": width, "levels": sizes}).encode() + b"\n"
    where, name = _file_system(path)
    where.create_dir(os.path.dirname(name), recursive=True)
    with where.open_output_stream(name) as out:
        for part in (head, np.packbits(bits).tobytes(), prints.tobytes(), first.tobytes(), last.tobytes(), *bodies):
            out.write(part)


class Shard:
    """A shard file opened for keyed reading; ids are read from the file as they are asked for."""

    def __init__(self, path: str):
        where, name = _file_system(path)
        self.file = where.open_input_file(name)
        head = b""
        while not head.endswith(b"\n"):
            more = self.file.read(4096)
            if not more:
                raise ValueError(f"{path} is not a shard")
            cut = more.find(b"\n")
            head += more if cut < 0 else more[: cut + 1]
        self.head = json.loads(head)
        self.file.seek(len(head))
        n, total = self.head["keys"], sum(self.head["levels"])
        read = lambda kind, count: np.frombuffer(self.file.read(np.dtype(kind).itemsize * count), kind)
        self.bits = np.unpackbits(read("u1", (total + 7) // 8), count=total).astype(bool)
        self.prints, self.first, self.last = read("<u4", n), read("<i8", n), read("<i8", n)
        self.body, self.kind = self.file.tell(), np.dtype(f"<u{self.head['width']}")

    def find(self, doc_id: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, first, last) of each key."""
        h = key_hash(doc_id, nth)
        slots = find_slots(h, self.head["levels"], self.bits)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == (h[known] >> U(32)).astype(np.uint32)
        at = np.where(known, slots, 0)
        return known, np.where(known, self.first[at] if len(self.first) else 0, 0), np.where(known, self.last[at] if len(self.last) else 0, 0)

    def ids(self, first: int, last: int) -> np.ndarray:
        width = self.kind.itemsize
        return np.frombuffer(self.file.read_at((last - first) * width, self.body + first * width), self.kind)

    def close(self) -> None:
        self.file.close()


NO_ID = np.iinfo(np.int64).min  # null ids come first, as in Spark's ascending order


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    tool = encoder(vocabulary)
    ids, bodies, count, number = [], [], 0, 0

    def close() -> pa.RecordBatch:
        path = f"{folder}/part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.ids"
        doc = np.array([NO_ID if x is None else x for x in ids], np.int64)
        new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        nth = np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc))))
        write_shard(path, doc, nth, bodies, tool.width)
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array([path] * n), pa.array(ids, pa.int64()), pa.array(nth),
             pa.array([len(b) // tool.width for b in bodies], pa.int64())], ["part", "shard", "path", "doc_id", "nth", "n_tokens"])

    for batch in gathered(batches, ENCODE_BYTES):
        keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").fill_null("")
        for i, j, _, _ in chunks(texts.cast(pa.binary()), ENCODE_BYTES):
            flat, lengths = tool.encode_all(texts.slice(i, j - i), end_id)
            raw, cuts = flat.tobytes(), (np.cumsum(lengths) * tool.width).tolist()
            for doc_id, start, end in zip(keys[i:j], [0, *cuts], cuts):
                ids.append(doc_id)
                bodies.append(raw[start:end])
                count += (end - start) // tool.width
                if count >= SHARD_IDS:
                    yield close()
                    ids, bodies, count, number = [], [], 0, number + 1
    if ids:
        yield close()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, opened = None, None
    for batch in batches:
        paths = batch.column("path").to_pylist()
        doc = batch.column("doc_id").fill_null(NO_ID).to_numpy()
        nth = batch.column("nth").to_numpy()
        firsts, counts, crcs = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        i = 0
        while i < len(paths):
            j = i + 1
            while j < len(paths) and paths[j] == paths[i]:
                j += 1
            if opened != paths[i]:
                if shard:
                    shard.close()
                shard, opened = Shard(paths[i]), paths[i]
            known, first, last = shard.find(doc[i:j], nth[i:j])
            if not known.all():
                raise ValueError(f"{paths[i]} lacks a key of its catalogue")
            firsts[i:j], counts[i:j] = first, last - first
            for x, a, b in zip(range(i, j), first.tolist(), last.tolist()):
                crcs[x] = zlib.crc32(shard.ids(a, b).astype("<u4").tobytes())
            i = j
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("shard"), batch.column("doc_id"), pa.array(firsts), pa.array(counts), pa.array(crcs)], ["part", "shard", "doc_id", "first", "n_tokens", "ids_crc32"])
    if shard:
        shard.close()


def write_token_shards(docs: DataFrame, vocabulary: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write the ids of all texts; the catalogue comes back: part, shard, path, doc_id, nth (row of that id in its shard), n_tokens.

    One catalogue row for each row of `docs`. A null or empty text is the end id alone. Null ids come first. Rows that repeat an id
    stand side by side, in an order fixed by their texts, and may continue in the next shard.
    """
    folder = qualified(docs.sparkSession, folder or work_dir(docs.sparkSession, "token-shards"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return written(rows.mapInArrow(lambda it: _write(it, folder, vocabulary, end_id), "part int, shard int, path string, doc_id long, nth long, n_tokens long"), "token-catalogue")


def read_token_shards(catalogue: DataFrame) -> DataFrame:
    """part, shard, doc_id, first (position in its shard), n_tokens, ids_crc32: read from the files by key, for every catalogue row."""
    return catalogue.mapInArrow(_read, "part int, shard int, doc_id long, first long, n_tokens long, ids_crc32 long")


def token_positions(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32: written, read back by key, one row for each row of `docs`."""
    catalogue = write_token_shards(docs, vocabulary, end_id)
    # one row per shard: the running sum is over totals, not documents
    shards = catalogue.groupBy("part", "shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("part", "shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return read_token_shards(catalogue).join(shards, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_token_binary")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_positions(table(spark, sf_dir, "documents"), default_vocabulary())
