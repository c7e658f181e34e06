"""Removal of lines that many documents share, by levelled sorted runs of line hashes.

The corpus arrives in batches, the largest ids first. A run is a table of line hashes, bucketed and sorted by hash, with the largest
document of each and the number of documents seen when it was added. A new batch sums its own lines by hash, merge-anti-joins all runs,
and adds what no run holds as a run of its own; hashes that some run does hold only add to a log of counts. So every hash stands in one
run, under the largest document that holds it. When a level has `FAN` runs they are merged into one run of the next level: a hash is
rewritten once per level, not once per batch, and a batch meets few runs. Runs are bucketed alike, so no join moves them.

Native DataFrame functions only. Lines are named by 128 bits. Tables are external ones below the shared folder; a lost executor costs
the tasks it ran, and what is written is never changed.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.llm.common import table, written
from vouchline.llm.registry import query
from vouchline.session import work_dir

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Batches that a corpus handed over as one table is dealt into; runs of one level before they are merged.
BATCHES, FAN = 4, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), UPPER, LOWER)


def long_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, row (hash of the text), at, h1, h2: one row for each line whose key has `least_chars` code points or more."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.where(F.char_length("line") >= least_chars).withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= least_chars)
    return lines.select("doc_id", "row", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), F.col("line")).alias("h2"))


class LineRuns:
    """The runs of all batches so far. Batches come with falling ids; rows of one id are in one batch."""

    def __init__(self, spark: SparkSession, fan: int = FAN, buckets: int | None = None):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = work_dir(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.repeats: list[DataFrame] = []
        self.names: list[str] = []

    def _sorted_table(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}_{os.urandom(8).hex()}"
        rows.repartition(self.buckets, *KEY).write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.names.append(name)
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """lines(doc_id, h1, h2) of a batch: any number of rows for a document and a line."""
        mine = lines.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("top"))
        mine = self.spark.table(self._sorted_table(mine, "batch"))
        fresh = mine
        for name in self.runs():
            fresh = fresh.join(self.spark.table(name).hint("merge"), KEY, "left_anti")
        met_any = bool(self.runs())
        own = self._sorted_table(fresh, "run")
        if met_any:
            again = mine.join(self.spark.table(own).hint("merge"), KEY, "left_anti")
            self.repeats.append(written(again.select(*KEY, "docs"), "line-repeats"))
        self.levels[0].append(own)
        self.compact()

    def compact(self) -> None:
        """Runs of a full level become one run of the next."""
        for i, level in enumerate(self.levels):
            if len(level) < self.fan:
                return
            merged = self.spark.table(level[0])
            for name in level[1:]:
                merged = merged.unionByName(self.spark.table(name))
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(self._sorted_table(merged, "run"))
            level.clear()

    def counted(self) -> DataFrame:
        """h1, h2, top, docs: every hash that stands in more than one document, with the largest of them and their number."""
        met = None
        for r in self.repeats:
            met = r if met is None else met.unionByName(r)
        if met is not None:
            met = written(met.groupBy(*KEY).agg(F.sum("docs").alias("more")), "line-met")
        out = self.spark.createDataFrame([], "h1 long, h2 long, top long, docs long")
        for name in self.runs():  # each hash is in one run
            run = self.spark.table(name)
            run = run.withColumn("more", F.lit(0)) if met is None else run.join(met.hint("merge"), KEY, "left")
            out = out.unionByName(run.select(*KEY, "top", (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs")).where("docs > 1"))
        return out

    def close(self) -> None:
        """Forget the table names; the files stay."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []


def batch_of(docs: DataFrame, batches: int) -> Column:
    """Number of the batch of a doc_id: ranges of ids with about equally many rows, the largest ids in batch 0, null ids in the last."""
    cuts = docs.select(F.col("doc_id").cast("long").alias("doc_id")).agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()
    out = F.lit(0)
    for cut in sorted(set(cuts["c"] or [])):
        out = out + F.when(F.col("doc_id") > cut, 0).otherwise(1)
    return out


def shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """doc_id, row, lines: positions of the lines that go, for each document that loses any. Written."""
    spark = docs.sparkSession
    path = work_dir(spark, "long-lines")
    lines = long_lines(docs, least_chars).withColumn("batch", batch_of(docs, batches))
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, row long, at int, h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(spark, fan)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch).select("doc_id", *KEY))
    common = written(runs.counted().where(F.col("docs") >= least_docs).select(*KEY, "top"), "common-lines")
    runs.close()
    gone = lines.join(common, KEY).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    return written(gone.groupBy("doc_id", "row").agg(F.collect_set("at").alias("lines")), "gone-lines")


def line_dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: one row for each row of `docs`; kept is the text without the lines that go.

    A line goes if its key has `least_chars` code points or more, at least `least_docs` different ids hold it, and this id is not the
    largest of them. Rows that repeat an id are one document; lines repeated in the largest id all stay. All null ids are one document,
    smaller than any other. A null or empty text is one empty line, which stays. Without rows the result is empty.
    """
    docs = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    gone = shared_lines(docs, least_chars, least_docs, batches, fan).toDF("known", "row_", "gone")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("known")) & (F.xxhash64("text") == F.col("row_"))
    rows = docs.join(gone, same, "left").withColumn("all", F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("all", i)), "\n"))
    return rows.select("doc_id", F.size("all").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


# The same result by one grouping of all lines.
LINES_SQL = r"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
v AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.top AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM v GROUP BY doc_id
"""


@query("op13_line_dedup", LINES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document; nulls, repeated ids and empty tables as `line_dedup` says."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
