"""Documents that hold benchmark passages, also with other numbers, names or units.

Texts become template words in three forms. In the typed form numbers, names (capitalised inside a sentence) and units become typed
placeholders, one for each run of one kind, all else is lower-cased without surrounding punctuation; the first word of a text counts
both as a name and as a word. In the plain form every word is lower-cased and stays, so that copies meet whatever they consist of and in
whatever letter case; in the folded form only numbers and units become placeholders, for copies in other case with other numbers. Windows of template words of benchmark items and documents meet by hash: a bit table of bounded size,
whatever the size of the benchmark, lets each document keep only windows that some item may have, and a hash join settles the rest. For
each document and item the windows on one diagonal are laid together; what fills the slots must correspond one to one. A document is
reported if the consistent stretch covers enough of the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.llm.common import SPACES, U, Words, as_bytes, bits_hold, bits_table, chunks, mix, sequence_hash, table, written
from vouchline.llm.registry import query

#: Template words of a window; of these so many must be no placeholder. Items shorter than a window are one window.
WINDOW, LITERAL = 8, 4
#: Reported: a consistent stretch of this many template words, or of this share of the item.
RUN, SHARE = 13, 0.6
LOG2_BITS = 23

#: Hashes of the placeholders by kind: none, number, unit, name.
KINDS = np.array([0, 0x4E554D4245520001, 0x554E495400000001, 0x4E414D4500000001], np.uint64)
#: Forms of a text: with placeholders, all words as they are, and with placeholders for what does not go by letter case.
TYPED, PLAIN, FOLDED = 0, 1, 2
# Units of measure, currencies and times that a question may swap.
UNITS = (
    "mm cm m km inch inches ft foot feet yard yards mile miles g kg mg lb lbs oz ounce ounces gram grams ton tons tonne tonnes l ml liter liters litre "
    "litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros "
    "pound pounds percent % $ € £ degrees degree meter meters metre metres kilometer kilometers mph km/h kmh watts watt volts volt"
).split()
_OPEN = np.zeros(256, bool)  # bytes of punctuation around a word
_OPEN[[ord(c) for c in "\"'()[]{}<>.,;:!?*_-–|`".encode().decode("latin-1") if ord(c) < 128]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in ".,%$/:+-"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _lower_points() -> np.ndarray:
    """Lower case of each code point below 2^16 that keeps its length in UTF-8; a final sigma counts as a sigma."""
    out = np.arange(1 << 16, dtype=np.int64)
    for point in range(128, 1 << 16):
        small = chr(point).lower()
        if len(small) == 1 and ord(small) != point and (ord(small) < 0x800) == (point < 0x800) and 128 <= ord(small) < 1 << 16:
            out[point] = ord(small)
    out[0x3C2] = 0x3C3
    return out


_POINTS = _lower_points()


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of all letters of up to three bytes whose small letter has the same length in bytes."""
    out = _LOWER[data]
    for length, low, high in ((2, 0xC2, 0xDF), (3, 0xE0, 0xEF)):
        at = np.flatnonzero((data >= low) & (data <= high))
        at = at[at + length <= len(data)]
        if not len(at):
            continue
        lead, tail = data[at].astype(np.int64), data[at + 1].astype(np.int64) & 63
        point = (lead & 31) << 6 | tail if length == 2 else (lead & 15) << 12 | tail << 6 | data[at + 2].astype(np.int64) & 63
        small = _POINTS[point]
        changed = small != point
        at, small = at[changed], small[changed]
        for i in range(length):
            out[at + i] = (0x80 | small >> 6 * (length - 1 - i) & 63) if i else ((0xC0 if length == 2 else 0xE0) | small >> 6 * (length - 1))
    return out


class Template:
    """Template words of a chunk: hashes in which placeholders stand for their kind, and hashes of what fills them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        if not len(data):  # no text in the chunk has a byte
            data, offsets = np.full(1, 32, np.uint8), np.append(offsets[:-1], 1)
        raw = Words(data, offsets)
        starts, ends = raw.starts.copy(), raw.ends.copy()
        while True:  # strip punctuation; a word of nothing else vanishes
            cut = (starts < ends) & _OPEN[data[np.minimum(starts, len(data) - 1)]]
            starts[cut] += 1
            back = (starts < ends) & _OPEN[data[np.maximum(ends - 1, 0)]]
            ends[back] -= 1
            if not (cut.any() or back.any()):
                break
        stop = np.isin(data[np.maximum(raw.ends - 1, 0)], np.frombuffer(b".!?:", np.uint8))
        line = np.concatenate(([0], np.cumsum(data == 10)))
        begins = np.ones(len(starts), bool)
        begins[1:] = stop[:-1] | (raw.doc[1:] != raw.doc[:-1]) | (line[raw.starts[1:]] > line[raw.starts[:-1]])
        keep = starts < ends
        self.starts, self.ends, self.doc, begins = starts[keep], ends[keep], raw.doc[keep], begins[keep]
        words = raw  # same bytes, other ranges, lower case
        words.data = lower(data)
        self.fill = words.hashes(self.starts, self.ends)
        self.texts = raw.texts
        digits, numeric = np.concatenate(([0], np.cumsum(_DIGIT[data]))), np.concatenate(([0], np.cumsum(_NUMERIC[data])))
        count = lambda sums: sums[self.ends] - sums[self.starts]
        number = (count(digits) > 0) & (count(numeric) == self.ends - self.starts)
        first, second = data[self.starts], data[np.minimum(self.starts + 1, len(data) - 1)]
        capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        then = self.starts + 1 + (first >= 0xC3)  # a name goes on in lower case; shouted words do not
        low, after = data[np.minimum(then, len(data) - 1)], data[np.minimum(then + 1, len(data) - 1)]
        shaped = capital & (then < self.ends) & (((low >= 97) & (low <= 122)) | ((low == 0xC3) & (after >= 0xA0)))
        unit = np.isin(self.fill, UNIT_HASHES)
        fixed = np.where(number, 1, np.where(unit, 2, 0))
        typed = np.where((fixed == 0) & shaped & ~begins, 3, fixed)
        opens = np.ones(len(self.doc), bool)
        opens[1:] = self.doc[1:] != self.doc[:-1]
        other = opens & shaped & (fixed == 0) & (typed == 0)  # first words of texts that may be names
        self.forms = {TYPED: Form(self, TYPED, typed), PLAIN: Form(self, PLAIN, np.zeros_like(fixed)), FOLDED: Form(self, FOLDED, fixed)}
        self.named = Form(self, TYPED, np.where(other, 3, typed))
        self.may_be_named = np.zeros(self.texts, bool)
        self.may_be_named[self.doc[other]] = True

    def windows(self, form: int, k: int, whole: bool) -> Iterator[tuple["Form", np.ndarray, np.ndarray]]:
        """(form, positions, hashes) of windows of k words; with `whole`, of texts of k words only."""
        f, g = self.forms[form], self.named
        yield f, *f.found(f.first[:-1][f.counts == k] if whole else f.windows(k), k)
        if form == TYPED:
            # where the first name goes on in a second word, the window from that on is the same
            at = g.first[:-1][self.may_be_named & (g.counts == k if whole else (g.counts >= k) & (g.counts == f.counts))]
            yield g, *g.found(at, k)


class Form:
    """One reading of the words of a chunk: one placeholder stands for each run of words of one kind. Positions count from the end of a text."""

    def __init__(self, t: Template, form: int, kind: np.ndarray):
        self.form, self.kind, self.doc, self.fill = form, kind, t.doc, t.fill
        goes_on = np.zeros(len(kind), bool)
        goes_on[1:] = (kind[1:] > 0) & (kind[1:] == kind[:-1]) & (t.doc[1:] == t.doc[:-1])
        if goes_on.any():
            heads = np.flatnonzero(~goes_on)
            place = np.arange(len(kind)) - heads[np.cumsum(~goes_on) - 1]
            spread = np.where(place > 0, mix(t.fill + mix(place.astype(np.uint64))), t.fill)
            self.kind, self.doc, self.fill = kind[heads], t.doc[heads], np.add.reduceat(spread, heads)
        self.hash = np.where(self.kind > 0, KINDS[self.kind], self.fill)
        self.counts = np.bincount(self.doc, minlength=t.texts)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    def windows(self, k: int) -> np.ndarray:
        n = len(self.doc)
        return np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :]) if n >= k else np.zeros(0, np.int64)

    def found(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows with enough literal words (any, if all words are literal by rule), and their hashes."""
        if self.form != PLAIN:
            literal = np.concatenate(([0], np.cumsum(self.kind == 0)))
            at = at[literal[at + k] - literal[at] >= min(LITERAL, k)]
        return at, mix(sequence_hash(self.hash, at, k) + U(k + (self.form << 32)))


def _word_hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return Words(data, np.array([0, len(data)])).hashes(np.array([0]), np.array([len(data)]))[0]


UNIT_HASHES = np.array([_word_hash(u) for u in UNITS])

ROWS = "form int, hash long, at long, kinds array<int>, fills array<long>"


def _emit(t: Form, ids: list[pa.Array], names: list[str], at: np.ndarray, h: np.ndarray, k: int) -> pa.RecordBatch:
    flat = (at[:, None] + np.arange(k)).reshape(-1)
    ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * k)
    take = pa.array(t.doc[at])
    return pa.RecordBatch.from_arrays(
        [*(c.take(take) for c in ids), pa.array(np.full(len(at), t.form, np.int32)), pa.array(h.view(np.int64)), pa.array(at - t.first[t.doc[at] + 1]), pa.ListArray.from_arrays(ends, pa.array(t.kind[flat].astype(np.int32))),
         pa.ListArray.from_arrays(ends, pa.array(t.fill[flat].view(np.int64)))], [*names, "form", "hash", "at", "kinds", "fills"])


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in chunks(batch.column("text")):
            t = Template(data, offsets)
            for form in t.forms:
                for k in range(1, window + 1):  # short items are one window of their own length
                    for f, at, h in t.windows(form, k, k < window):
                        if len(at):
                            yield _emit(f, [batch.column("item_id")[i:j], pa.array(f.counts)], ["item_id", "size"], at, h, k)


def _document_windows(batches: Iterator[pa.RecordBatch], lengths: list[tuple[int, int]], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in chunks(batch.column("text")):
            t = Template(data, offsets)
            for form, k in lengths:
                for f, at, h in t.windows(form, k, False):
                    hit = bits_hold(shared.value, h)
                    if hit.any():
                        yield _emit(f, [batch.column("doc_id")[i:j], batch.column("row")[i:j]], ["doc_id", "row"], at[hit], h[hit], k)


def _stretch(doc_at, item_at, kinds, doc_fills, item_fills) -> tuple[int, int, int]:
    """(template words, windows, slots) of the longest consistent stretch of one document and item: same diagonal, no gap between
    windows, and a one-to-one match between what fills the slots. A conflict starts a new stretch. Of two readings of one window of the same
    length, that with fewer slots counts."""
    best = (0, 0, 0)
    last, begin, windows, ahead, back, seen = None, 0, 0, {}, {}, None
    for d, b, k, x, y in sorted(zip(doc_at, item_at, kinds, doc_fills, item_fills), key=lambda r: (r[0] - r[1], r[0], len(r[2]), sum(map(bool, r[2])))):
        if seen == (d, b, len(k)):
            continue
        seen = (d, b, len(k))
        pairs = [(int(k[i]), int(y[i]), int(x[i])) for i in range(len(k)) if k[i]]
        joined = last is not None and d - b == last[1] and d <= last[0]
        fits = all(ahead.get((c, p), q) == q and back.get((c, q), p) == p for c, p, q in pairs)
        own = {(c, p): q for c, p, q in pairs}
        if any(own[c, p] != q for c, p, q in pairs):
            continue
        if not (joined and fits):
            begin, windows, ahead, back = d, 0, {}, {}
        windows += 1
        for c, p, q in pairs:
            ahead[c, p] = q
            back[c, q] = p
        last = (max(d + len(k), last[0]) if joined and fits else d + len(k), d - b)
        best = max(best, (last[0] - begin, windows, len(ahead)))
    return best


FOUND = "doc_id long, row long, item_id long, n_template_words long, n_windows long, n_slots long, size long"


def _checked(key: tuple, table_: pa.Table, run: int, share: float) -> pa.Table:
    """The best form of a document and item: one that is reported, and of these that with most words."""
    best = None
    for form in sorted(table_.column("form").unique().to_pylist()):
        part = table_.filter(pc.equal(table_.column("form"), form))
        words, windows, slots = _stretch(*(part.column(c).to_pylist() for c in ("at", "item_at", "kinds", "fills", "item_fills")))
        size = pc.max(part.column("size")).as_py()
        mine = (words >= run or words >= share * size, words, slots, windows, size)
        best = mine if best is None else max(best, mine)
    _, words, slots, windows, size = best
    return pa.table([[x] for x in (*(k.as_py() for k in key), words, windows, slots, size)], schema=pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")]))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run: int = RUN, share: float = SHARE) -> DataFrame:
    """doc_id, row (hash of the text), item_id, n_template_words, n_windows, n_slots, share: one row for each document and item found in it.

    Null and empty texts hold nothing and items without words are never found. Rows with equal id and text count once. A null id is kept
    as null. Items with equal texts are all reported.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), as_bytes()).mapInArrow(lambda it: _item_windows(it, window), "item_id long, size long, " + ROWS)
    items = written(items, "item-windows")
    lengths = sorted(tuple(r) for r in items.select("form", F.size("kinds")).distinct().collect())  # at most `window` numbers a form
    shared = spark.sparkContext.broadcast(bits_table(items, "hash", LOG2_BITS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), as_bytes())
    found = texts.mapInArrow(lambda it: _document_windows(it, lengths, shared), "doc_id long, row long, " + ROWS)
    items = items.select("item_id", "size", "form", "hash", F.col("at").alias("item_at"), F.col("kinds").alias("item_kinds"), F.col("fills").alias("item_fills"))
    met = found.join(items, ["form", "hash"]).where("kinds = item_kinds").dropDuplicates(["doc_id", "row", "item_id", "form", "hash", "at", "item_at"])
    met = met.select("doc_id", "row", "item_id", "form", "size", "at", "item_at", "kinds", "fills", "item_fills")
    checked = met.groupBy("doc_id", "row", "item_id").applyInArrow(lambda key, rows: _checked(key, rows, run, share), FOUND)
    enough = (F.col("n_template_words") >= run) | (F.col("n_template_words") >= share * F.col("size"))
    return checked.where(enough).withColumn("share", F.least(F.lit(1.0), F.col("n_template_words") / F.col("size"))).drop("size")


@query("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (doc_id, item_id) pairs of documents that hold a benchmark item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")
