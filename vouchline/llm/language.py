"""Language of a text by compression: the language whose sample text, as a zstandard raw-content dictionary, gives the smallest output.

Learning takes a bounded sample: for each language texts in the order of a hash until `DICTIONARY` bytes are full. Classifying compresses
whole texts, in pieces of `PIECE` bytes so that the dictionary counts throughout a long text, once per language. The gap between the two
smallest totals, in bits, gives the score; a text whose gap is narrow for its length is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouchline.llm.common import part_of, table, written
from vouchline.llm.registry import query

#: Learning sample: at most this many texts and bytes of a language. Every language is learned.
SAMPLE_TEXTS, DICTIONARY = 400, 1 << 16
#: All dictionaries together have no more bytes than this: beyond 1024 languages each gets an equal, smaller share.
DICTIONARIES = 1 << 26
#: So many dictionaries are ready to use at once in a task; where there are more, they take turns for each batch of rows.
GROUP = 128
#: Long sample texts give no more than this to a dictionary, so that it holds many texts.
TEXT_SHARE = 1 << 11
PIECE, LEVEL = 1 << 14, 6
UNDECIDED = "und"
#: Rejected: a gap of fewer bytes than this, or than this share of the smallest total.
MIN_GAP, MIN_SHARE = 1, 0.002


def _normal(text: str = "text"):
    """Lower case, letters only, one space between runs."""
    return F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}]+", " "))


def learn_dictionaries(labelled: DataFrame, texts: int = SAMPLE_TEXTS, size: int = DICTIONARY) -> dict[str, bytes]:
    """A dictionary for each language of labelled(text, lang), however many there are. Rows without text or language are ignored; a language
    none of whose sampled texts has a letter gets none."""
    labelled = labelled.where("lang is not null and text is not null").select("lang", "text")
    counts = written(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    size = min(size, max(1, DICTIONARIES // max(1, counts.count())))
    # about 2 * `texts` rows of a language leave the scan, whatever its size; the first of them are taken
    share = counts.select("lang", F.least(F.lit(1.0), 2.0 * texts / F.col("n")).alias("share"))
    ranked = labelled.join(F.broadcast(share), "lang").withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1)).where(F.col("h") <= F.col("share") * float(1 << 63))
    ranked = ranked.select("lang", "h", F.substring("text", 1, TEXT_SHARE).alias("text"))
    first = ranked.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("at") <= texts)
    plain = first.select("lang", "at", _normal().alias("text")).where("text <> ''")
    before = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("lang").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    rows = plain.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < size).select("lang", "at", "text")
    out: dict[str, bytes] = {}
    for r in rows.orderBy("lang", "at").collect():
        have = out.get(r["lang"], b"")
        if len(have) < size:
            out[r["lang"]] = (r["text"] + " ").encode()[: size - len(have)] + have
    return out


class Judge:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names, self.dictionaries = sorted(dictionaries), dictionaries
        self.groups = [self.names[i : i + GROUP] for i in range(0, len(self.names), GROUP)]
        self.ready = self._tools(self.groups[0]) if len(self.groups) == 1 else None

    def _tools(self, names: list[str]) -> list:
        import zstandard as z

        tools = []
        for name in names:
            d = z.ZstdCompressionDict(self.dictionaries[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            tools.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return tools

    def sizes(self, texts: list[bytes]) -> list[list[int]]:
        """For each text its size by each language."""
        out: list[list[int]] = [[] for _ in texts]
        for group in self.groups:
            tools = self.ready or self._tools(group)
            for text, mine in zip(texts, out):
                pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
                mine += [sum(len(t.compress(p)) for p in pieces) for t in tools]
        return out

    def verdict(self, text: bytes, sizes: list[int]) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not text or not self.names:
            return UNDECIDED, 0.0, True
        low = min(sizes)
        best = sizes.index(low)
        gap = min((s for i, s in enumerate(sizes) if i != best), default=low + MIN_GAP + low) - low
        score = 1 / sum(2.0 ** -min(60, s - low) for s in sizes)
        return self.names[best], score, gap < max(MIN_GAP, math.ceil(MIN_SHARE * low))


def _judged(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    judge = Judge(shared.value)
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column("normal")]
        out = [judge.verdict(t, s) for t, s in zip(texts, judge.sizes(texts))]
        yield pa.RecordBatch.from_arrays(
            [*batch.drop_columns(["normal"]).columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())],
            [*batch.drop_columns(["normal"]).schema.names, "lang_pred", "score", "rejected"])


def classify(rows: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """`rows` with lang_pred, score and rejected (columns of these names are replaced).

    A null text, or one without a letter, is `und` with score 0 and rejected; so is every text if nothing was learned. Equal totals go to
    the first language by name. Whole texts count.
    """
    from pyspark.sql import types as T

    shared = rows.sparkSession.sparkContext.broadcast(dictionaries)
    rows = rows.drop("lang_pred", "score", "rejected")
    plain = rows.withColumn("normal", _normal(text).cast("binary"))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return plain.mapInArrow(lambda it: _judged(it, shared), schema)


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = learn_dictionaries(docs.where(~part_of("doc_id", 4, 2)))
    return classify(docs.select("doc_id", part_of("doc_id", 4, 2).alias("held_out"), "text"), dictionaries).drop("text")
