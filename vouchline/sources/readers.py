"""Reading statement files and recogniser responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vouchline.skew import hot_keys, ordered

# Delimiters a statement file may use, in order of preference.
DELIMITERS = [",", "\t", ";", "|", ":"]
SNIFF_CHARS = 4096

# File suffixes.
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "webp"]
TABLE_SUFFIXES = ["pdf", "csv", "xlsx", "xls"]

BLOCKS_SCHEMA = (
    "struct<JobId:string,Blocks:array<struct<Id:string,BlockType:string,Page:int,RowIndex:int,ColumnIndex:int,Text:string,"
    "Confidence:double,Geometry:struct<BoundingBox:struct<Left:double,Top:double,Width:double,Height:double>>,"
    "Relationships:array<struct<Type:string,Ids:array<string>>>>>>"
)


def spread_small(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core; a scan that already has enough is left alone.

    A small table is one file and thus one task, which costly text expressions would keep to one core. Tables with at
    least one split per core pay nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def file_type(name: Column) -> Column:
    suffix = F.regexp_extract(F.lower(name), r"\.([^.]+)$", 1)
    return F.when(suffix.isin(IMAGE_SUFFIXES), "image").when(suffix == "", "unknown").otherwise(suffix)


def parse_branch(name: Column) -> Column:
    """Which parser takes the file; anything else becomes an error row, the job goes on."""
    kind = file_type(name)
    return F.when(kind == "csv", "cells").when(kind.isin("xlsx", "xls"), "workbook").when(kind == "pdf", "pdf").otherwise("unsupported")


def unsupported_error(name: Column) -> Column:
    return F.when(
        parse_branch(name) == "unsupported",
        F.concat(F.lit("Unsupported statement format '"), file_type(name), F.lit("'. Upload a CSV, PDF, or Excel file.")),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: splittable, so one very large file is read by many tasks.

    `block` is the byte offset of the split and `line_id` grows inside it.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"),
    )


def sniff_delimiters(lines: DataFrame) -> DataFrame:
    """Delimiter per file from its first characters: most lines contain it, then most occurrences; comma by default.

    lines: file, start (characters before the line), line.
    """
    sample = lines.filter(F.col("start") < SNIFF_CHARS).withColumn("_s", F.substring("line", 1, SNIFF_CHARS))
    counts = [
        F.struct(F.lit(d).alias("delimiter"), F.lit(-n).alias("preference"),
                 (F.length("_s") - F.length(F.replace("_s", F.lit(d), F.lit("")))).alias("n"))
        for n, d in enumerate(DELIMITERS)
    ]
    per = sample.select("file", F.explode(F.array(*counts)).alias("c")).groupBy("file", "c.delimiter", "c.preference").agg(
        F.count_if(F.col("c.n") > 0).alias("lines"), F.sum("c.n").alias("total")
    )
    best = per.filter("total > 0").groupBy("file").agg(F.max_by("delimiter", F.struct("lines", "total", "preference")).alias("delimiter"))
    return best


def _patterns(delimiter: str) -> tuple[str, str, str]:
    """Regular expressions for one delimiter: a line that ends outside a quoted cell if it starts outside, the same if it starts inside,
    and one cell after a delimiter. A quote opens a cell only as its first character. All loops are possessive: linear, and no recursion."""
    d = "\\" + delimiter if delimiter == "|" else delimiter
    inside = '(?:[^"]++|"")*+"'
    cell = f'(?:"{inside}[^{d}]*+|[^"{d}][^{d}]*+|)'
    rest = f"(?:{d}{cell})*+"
    return f"^{cell}{rest}$", f"^{inside}[^{d}]*+{rest}$", f'{d}("{inside}[^{d}]*+|[^{d}]*+)'


def _by_delimiter(delimiter: Column, build) -> Column:
    out = F.lit(None)
    for d in DELIMITERS:
        out = F.when(delimiter == d, build(d)).otherwise(out)
    return out


def split_record(record: Column, delimiter: Column) -> Column:
    """Cells of one record; quoted cells may hold the delimiter, doubled quotes become one."""
    cells = _by_delimiter(delimiter, lambda d: F.regexp_extract_all(F.concat(F.lit(d), record), F.lit(_patterns(d)[2]), F.lit(1)))
    quoted = '^"((?:[^"]++|"")*+)"((?s:.*))$'
    return F.transform(
        cells, lambda c: F.when(c.rlike(quoted), F.concat(F.replace(F.regexp_extract(c, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, quoted, 2))).otherwise(c)
    )


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Ragged cell rows of delimited statement files: file, row_idx, cells, error. A leading byte-order mark is dropped.

    A quoted cell may span lines. What a line does to the state (inside or outside a quoted cell) is one of four things: keep it, swap it,
    end outside, or end inside. The state before a line is thus that of the last line of the latter two kinds, swapped as often as lines
    since then swap: running values, which are computed per split and then offset, so a single huge file stays parallel. Where a file
    ends inside a cell, the record that opened it gets an error and every line from there on is a record of its own.
    """
    lines = read_lines(spark, path)
    hot = hot_keys(lines, ["file"])
    keys, order, split = ["file"], ["block", "line_id"], F.col("block")
    placed = ordered(lines, keys, order, split=split, running={"_n": ("sum", F.lit(1)), "_chars": ("sum", F.length("line") + 1)}, hot=hot)
    placed = placed.withColumns({"start": F.col("_chars") - F.length("line") - 1, "line": F.when(F.col("_n") == 1, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line"))})
    placed = placed.join(sniff_delimiters(placed), "file", "left").withColumn("delimiter", F.coalesce("delimiter", F.lit(",")))
    leaves = lambda i: F.when(F.contains("line", F.lit('"')), _by_delimiter(F.col("delimiter"), lambda d: F.col("line").rlike(_patterns(d)[i]))).otherwise(i == 0)
    told = placed.withColumns({"_from_out": F.when(leaves(0), 0).otherwise(1), "_from_in": F.when(leaves(1), 0).otherwise(1)})
    swaps = F.when((F.col("_from_out") == 1) & (F.col("_from_in") == 0), 1).otherwise(0)
    counted = ordered(told, keys, order, split=split, running={"_swaps": ("sum", swaps)}, hot=hot)
    fixed = F.when(F.col("_from_out") == F.col("_from_in"), F.col("_n") * 2 + (F.col("_from_out") + F.col("_swaps")) % 2)
    known = ordered(counted, keys, order, split=split, running={"_fixed": ("max_before", fixed)}, hot=hot)
    inside = (F.coalesce(F.col("_fixed") % 2, F.lit(0)) + F.col("_swaps") - swaps) % 2
    known = known.withColumn("_inside", inside).withColumn("_after", F.when(F.col("_inside") == 1, F.col("_from_in")).otherwise(F.col("_from_out")))
    ends = known.groupBy("file").agg(F.max_by("_after", "_n").alias("_end"), F.max(F.when(F.col("_inside") == 0, F.col("_n"))).alias("_open"))
    starts = ordered(known, keys, order, split=split, running={"_record": ("sum", 1 - F.col("_inside"))}, hot=hot)
    starts = starts.join(ends.where("_end = 1").select("file", "_open"), "file", "left")
    alone = F.coalesce(F.col("_n") >= F.col("_open"), F.lit(False))
    row_idx = F.col("_record") - 1 + F.when(alone, F.col("_n") - F.col("_open")).otherwise(0)
    records = starts.withColumn("row_idx", row_idx.cast("long")).groupBy("file", "row_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "\n").alias("record"),
        F.first("delimiter").alias("delimiter"), F.bool_or(F.coalesce(F.col("_n") == F.col("_open"), F.lit(False))).alias("_unclosed"),
    )
    return records.select("file", "row_idx", split_record(F.col("record"), F.col("delimiter")).alias("cells"), F.when(F.col("_unclosed"), "A quoted cell is not closed.").alias("error"))


def parse_blocks(responses: DataFrame, json: str = "response") -> DataFrame:
    """Recogniser responses (one JSON text per row) to the block table: doc_id and block columns."""
    parsed = responses.withColumn("_r", F.from_json(json, BLOCKS_SCHEMA)).select(F.col("_r.JobId").alias("doc_id"), F.explode("_r.Blocks").alias("b"))
    box = F.col("b.Geometry.BoundingBox")
    return parsed.select(
        "doc_id", F.col("b.Id").alias("id"), F.col("b.BlockType").alias("block_type"), F.col("b.Page").alias("page"),
        F.col("b.RowIndex").alias("row_index"), F.col("b.ColumnIndex").alias("column_index"), F.col("b.Text").alias("text"),
        F.col("b.Confidence").alias("confidence"),
        F.transform("b.Relationships", lambda r: F.struct(r["Type"].alias("type"), r["Ids"].alias("ids"))).alias("relationships"),
        F.when(box.isNotNull(), F.struct(box.Left.alias("left"), box.Top.alias("top"), box.Width.alias("width"), box.Height.alias("height"))).alias("box"),
    )
