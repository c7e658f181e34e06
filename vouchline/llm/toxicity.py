"""Toxic passages by maximum-scoring segments.

Learning, on a bounded sample of labelled texts: for every word and every word beginning, the log-odds between toxic and clean texts with a
Dirichlet prior drawn from both classes together, kept where it is several standard deviations above zero. A kept word scores its lower
bound, any other word `DRIFT`. Scores of clean text then have a negative mean, so the largest segment sum of n clean words follows an
extreme-value law, P(sum > S) = 1 - exp(-K n e^(-lambda S)); lambda solves sum(p e^(lambda s)) = 1 over the clean word distribution and K
is matched to the segments found in clean texts.

Scoring: one linear scan finds all maximal segments (each is the best-scoring stretch that cannot be extended or cut for gain). Segments
with an expected number of chance finds under `E_VALUE` are passages. Their evidence, lambda S - ln(K n), is summed over the text and
turned into a probability by a logistic curve fitted on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchline.llm.common import U, Words, chunks, mix, part_of, table, written
from vouchline.llm.registry import query

#: Expected number of labelled texts of each class to learn from, and words or beginnings in the model, at most.
SAMPLE, MODEL = 20_000, 100_000
#: Beginnings of words, in bytes; weight of the prior; standard deviations; least number of toxic texts.
BEGINNINGS, PRIOR, SIGMAS, LEAST = (5, 6, 7), 100.0, 3.0, 5
DRIFT, MOST, E_VALUE = -1.0, 6.0, 0.05

BREAKS = np.ones(256, bool)
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions of words, hashes) for whole words and for each length of beginning."""
    out = [(np.arange(len(w.starts)), w.hashes())]
    for n in BEGINNINGS:
        at = np.flatnonzero(w.ends - w.starts > n)
        out.append((at, mix(w.hashes(w.starts[at], w.starts[at] + n) ^ U(n))))
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts of a chunk hold each feature."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy().astype(bool)
        for i, _, data, offsets in chunks(batch.column("text")):
            w = Words(data, offsets, BREAKS)
            pairs = [(h, w.doc[at]) for at, h in features(w)]
            h, doc = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
            h, bad = h[new], toxic[i + doc[new]]
            names, at = np.unique(h, return_inverse=True)
            y = np.bincount(at, weights=bad, minlength=len(names)).astype(np.int64)
            n = np.bincount(at, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(y), pa.array(n - y)], ["feature", "toxic", "clean"])


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, end, sum) of all maximal scoring segments, in linear time. Only positive scores are visited one by one."""
    total = np.cumsum(scores)
    stack: list[list] = []  # first, end, sum before, sum after, index of the nearest earlier candidate with a smaller sum before it
    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i + 1, total[i] - scores[i], total[i], -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            del stack[j:]
    return [(a, b, float(after - before)) for a, b, before, after, _ in stack]


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    scores: np.ndarray
    scale: float = 1.0  # lambda
    k: float = 0.1
    slope: float = 1.0
    intercept: float = 0.0

    def word_scores(self, w: Words) -> np.ndarray:
        out = np.full(len(w.starts), DRIFT)
        if len(self.hashes):
            for at, h in features(w):
                where = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[where] == h
                out[at[hit]] = np.maximum(out[at[hit]], self.scores[where[hit]])
        return out

    def passages(self, w: Words) -> Iterator[list[tuple[int, int, float]]]:
        """For each text: (first byte, end byte, evidence) of its significant segments."""
        scores = self.word_scores(w)
        some = np.bincount(w.doc[scores > 0], minlength=w.texts) > 0
        for i in range(w.texts):
            found = []
            if some[i]:
                a, b = w.first_word[i], w.first_word[i + 1]
                for x, y, s in maximal_segments(scores[a:b]):
                    evidence = self.scale * s - np.log(self.k * (b - a))
                    if evidence >= -np.log(E_VALUE):
                        found.append((int(w.starts[a + x] - w.offsets[i]), int(w.ends[a + y - 1] - w.offsets[i]), float(evidence)))
            yield found

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.intercept, -30, 30)))


def _found(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))
    for batch in batches:
        rest = batch.drop_columns(["text"])
        for i, j, data, offsets in chunks(batch.column("text")):
            found = list(model.passages(Words(data, offsets, BREAKS)))
            evidence = np.array([sum(e for _, _, e in f) for f in found], np.float64)
            part = rest.slice(i, j - i)
            passages = pa.array([[{"start": a, "end": b, "evidence": e} for a, b, e in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(evidence), pa.array(model.probability(evidence)), passages], [*part.schema.names, "evidence", "score", "passages"])


def score_texts(rows: DataFrame, model: Model) -> DataFrame:
    """`rows` with evidence, score and passages instead of text. Places count bytes of the lower-cased text. A text without a known toxic word, null and
    empty ones included, has no passage, evidence 0 and the lowest score. Columns of the added names are replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.drop("evidence", "score", "passages")
    fields = [f for f in rows.schema.fields if f.name != "text"]
    passage = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("evidence", T.DoubleType())])
    schema = T.StructType([*fields, T.StructField("evidence", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(passage))])
    return rows.withColumn("text", F.lower("text").cast("binary")).mapInArrow(lambda it: _found(it, shared), schema)


def _clean_words(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Word scores of clean texts, counted, and what their segments add up to."""
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column("text")):
            w = Words(data, offsets, BREAKS)
            values, n = np.unique(np.round(shared.value.word_scores(w), 6), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["value", "n"])


def _scale(values: np.ndarray, n: np.ndarray) -> float:
    """The positive root of sum(p e^(x s)) = 1; half a word is added to the largest score, so that a root exists."""
    p = np.append(n, 0.5) / (n.sum() + 0.5)
    s = np.append(values, MOST)
    low, high = 1e-6, 60.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 500))).sum() < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    a = np.stack((x, np.ones(len(x))), axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        w = weight * p * (1 - p)
        step = np.linalg.solve(a.T @ (a * w[:, None]) + np.eye(2) * 1e-2, a.T @ (weight * (y - p)) - 1e-2 * b)
        b += np.clip(step, -5, 5)
    return float(max(b[0], 0.0)), float(b[1])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MODEL) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic). Labels other than 0 and 1, null ids and texts count for nothing.

    Of each class about `sample` labels are taken, those with the smallest hash of their id; identical texts count once.
    Without both classes the model knows no word and every score is one half or less.
    """
    labels = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = {c: min(1.0, sample / n) for c, n in sizes.items()}
    if len(share) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), slope=0.0, intercept=-1.0)
    bound = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    taken = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < bound * (1 << 20))
    # about 2 * `sample` rows of two numbers, whatever the size of the tables
    texts = docs.where("text is not null").select("doc_id", F.lower("text").cast("binary").alias("text")).join(F.broadcast(taken), "doc_id")
    texts = written(texts.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample")
    n_toxic, n_clean = texts.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not n_toxic or not n_clean:
        return Model(np.zeros(0, np.uint64), np.zeros(0), slope=0.0, intercept=-1.0)
    y, c = F.col("toxic"), F.col("clean")
    prior = F.lit(PRIOR) * (y + c) / (n_toxic + n_clean)
    delta = F.log((y + prior) / (n_toxic - y + PRIOR - prior)) - F.log((c + prior) / (n_clean - c + PRIOR - prior))
    sigma = F.sqrt(1 / (y + prior) + 1 / (c + prior))
    kept = (
        texts.mapInArrow(_counts, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(y >= LEAST).select("feature", delta.alias("delta"), sigma.alias("sigma")).where(F.col("delta") >= SIGMAS * F.col("sigma"))
        .orderBy(F.desc(F.col("delta") / F.col("sigma")), "feature").limit(most).toArrow())
    hashes = kept["feature"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    model = Model(hashes[order], np.clip(kept["delta"].to_numpy() - kept["sigma"].to_numpy(), 0.5, MOST)[order])

    shared = texts.sparkSession.sparkContext.broadcast(model)
    clean = texts.where("toxic = 0")
    words = clean.mapInArrow(lambda it: _clean_words(it, shared), "value double, n long").groupBy("value").agg(F.sum("n").alias("n")).toArrow()
    values, n = words["value"].to_numpy(), words["n"].to_numpy()
    model.scale = _scale(values, n) if len(n) else 1.0
    # clean segments expected at score S or more in N words: K N e^(-lambda S), summed over the scores that clean words reach
    high = values > 0
    model.k = float((n[high].sum() + 0.5) / (max(1, n.sum()) * max(1e-12, np.average(np.exp(-model.scale * values[high]), weights=n[high]) if high.any() else 1.0)))
    model.k = min(1.0, model.k)
    seen = score_texts(texts, model).select("toxic", "evidence").toArrow()
    toxic = seen["toxic"].to_numpy()
    weight = np.where(toxic == 1, sizes[1] / n_toxic, sizes[0] / n_clean) * (n_toxic + n_clean) / (sizes[0] + sizes[1])
    model.slope, model.intercept = _logistic(np.log1p(seen["evidence"].to_numpy()), toxic, weight)
    return model


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(~part_of("doc_id", 3, 1)))
    rows = docs.select("doc_id", part_of("doc_id", 3, 1).alias("held_out"), "text")
    return score_texts(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
