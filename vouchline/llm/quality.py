"""Quality rules whose cutoffs carry a guarantee: at most a stated share of good texts is rejected, in each stratum, with stated confidence.

Every text gets counts (words, repeated windows, repeated lines, symbols ...). Each rule is "feature >= cutoff". On labelled holdouts,
for every stratum (length class), feature and cutoff of a fixed grid, the share of good texts a rule would reject has an exact binomial
(Clopper-Pearson) upper bound. Cutoffs of a feature are tested from the mildest on and the first that fails ends the sequence, which needs
no correction; across features and strata `delta` is divided by their number (Bonferroni). The last cutoff whose bound was within the
feature's share of `alpha` is taken, if it catches bad texts more often than good ones. The rules of a stratum together reject more than
`alpha` of its good texts with probability below `delta`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.llm.common import SPACES, U, Words, as_bytes, chunks, mix, sequence_hash, table, written
from vouchline.llm.registry import query

#: Upper word counts of the length classes, exclusive; the last class has none.
STRATA = (60, 250, 1000)
#: Cutoffs tried for each feature, in thousandths of a word (or of a line, or of a character).
FEATURES = {
    "repeat_share": "1000 * n_repeat_words div greatest(n_words, 1)",
    "symbol_share": "1000 * n_symbols div greatest(n_words, 1)",
    "dup_line_share": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "upper_share": "1000 * n_upper div greatest(word_chars, 1)",
    "digit_share": "1000 * n_digits div greatest(word_chars, 1)",
    "long_words": "word_chars div greatest(n_words, 1)",
}
GRID = [*range(5, 100, 5), *range(100, 1000, 25), *range(1000, 10001, 500)]
ALPHA, DELTA = 0.03, 0.05

_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
#: 1 for the first byte of a code point that is not white space.
_POINT = np.where(SPACES, 0, 1)
_POINT[128:192] = 0
REPEAT = 5


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeat_words(w: Words) -> np.ndarray:
    """Words of each text that lie in a window of `REPEAT` words found twice or more in it."""
    at = w.windows(REPEAT)
    if not len(at):
        return np.zeros(w.texts, np.int64)
    h = mix(sequence_hash(w.hashes(), at, REPEAT) ^ mix(w.doc[at].astype(np.uint64)))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order] = np.append(same, False) | np.append(False, same)
    edge = np.zeros(len(w.doc) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + REPEAT, -1)
    return np.bincount(w.doc[np.cumsum(edge)[:-1] > 0], minlength=w.texts)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = batch.drop_columns(["text"])
        for i, j, data, offsets in chunks(batch.column("text")):
            w = Words(data, offsets)
            n_lines, dup = [], []
            raw = data.tobytes()
            for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
                lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
                n_lines.append(len(lines))
                dup.append(len(lines) - len(set(lines)))
            counts = [w.counts, *(_per_text(t[data], offsets) for t in (_POINT, _SYMBOLS)), np.array(dup), _repeat_words(w), np.array(n_lines), *(_per_text(t[data], offsets) for t in (_UPPER, _DIGIT))]
            part = rest.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.asarray(c, np.int64)) for c in counts)], [*part.schema.names, *COUNTS])


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits"]


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and the counts of each text. A null or empty text counts nothing. Repeated windows are told apart by 64-bit hashes."""
    names = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, as_bytes()).mapInArrow(_measured, ", ".join(filter(None, [names, *(f"{c} long" for c in COUNTS)])))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def stratum() -> Column:
    out = F.lit(len(STRATA))
    for i in reversed(range(len(STRATA))):
        out = F.when(F.col("n_words") < STRATA[i], i).otherwise(out)
    return out


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact binomial upper bound: the p for which k or fewer of n happen with probability `level`."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def tail(p: float) -> float:
        return sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs))

    low, high = k / n, 1.0 - 1e-12
    low = max(low, 1e-12)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > level else (low, mid)
    return high


def choose_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> list[dict]:
    """The rules, one dictionary each: stratum, feature, cutoff, bound, and the bad and good texts it rejects.

    measured(doc_id, counts) and labels(doc_id, quality); all labelled rows that pass the base rules count. Only the number of good and
    bad texts in each stratum, feature and grid cell reaches the driver. Nulls and labels other than 0 and 1 are ignored.
    """
    labels = labels.where("quality in (0, 1)").select("doc_id", "quality").distinct()
    rows = measured.where(~base_failed()).join(labels, "doc_id")
    grid = F.array(*[F.lit(g) for g in GRID])
    cells = F.array(*[F.struct(F.lit(name).alias("feature"), F.expr(rule).alias("value")) for name, rule in FEATURES.items()])
    cell = F.size(F.filter(grid, lambda g: g <= F.col("f.value")))  # grid cutoffs that the text reaches
    seen = rows.select(stratum().alias("stratum"), "quality", F.explode(cells).alias("f")).groupBy("stratum", "quality", "f.feature", cell.alias("cell")).count().collect()
    level, share = delta / ((len(STRATA) + 1) * len(FEATURES)), alpha / len(FEATURES)
    rules = []
    for s in range(len(STRATA) + 1):
        for name in FEATURES:
            mine = [r for r in seen if (r["stratum"], r["feature"]) == (s, name)]
            reached = [[sum(r["count"] for r in mine if r["quality"] == q and r["cell"] > i) for i in range(-1, len(GRID))] for q in (0, 1)]
            (n_bad, *bad), (n_good, *good) = reached
            chosen = None
            for i in reversed(range(len(GRID))):
                bound = upper_bound(good[i], n_good, level) if n_good else 1.0
                if bound > share:
                    break
                chosen = {"stratum": s, "feature": name, "cutoff": GRID[i], "bound": bound, "bad": bad[i], "good": good[i]}
            if chosen and chosen["bad"] * n_good > chosen["good"] * n_bad:
                rules.append(chosen)
    return rules


def verdict(rules: list[dict]) -> Column:
    """True for rows of counts that no base rule and no chosen rule rejects."""
    bad = base_failed()
    for r in rules:
        bad = bad | ((stratum() == r["stratum"]) & (F.expr(FEATURES[r["feature"]]) >= r["cutoff"]))
    return ~bad


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = written(measure(table(spark, sf_dir, "documents"), "doc_id"), "quality-counts")
    rules = choose_cutoffs(counted, table(spark, sf_dir, "labels"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict(rules).alias("kept"))
