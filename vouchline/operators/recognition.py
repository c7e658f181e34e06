"""From recogniser output to cell rows: word clustering and table-block graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouchline.operators.export import confidence_tier
from vouchline.skew import hot_keys, islands

PAGE = ["doc_id", "page"]


def page_limits(words: DataFrame) -> DataFrame:
    """Row and cell distances per page, from the median word height and width."""
    limit = words.groupBy(*PAGE).agg(F.median("h").alias("_h"), F.median("w").alias("_w"))
    return limit.select(
        *PAGE, F.greatest(F.lit(10), F.floor(F.col("_h") * 0.6)).alias("row_gap"),
        F.greatest(F.lit(20), F.floor(F.col("_w") * 0.8)).alias("cell_gap"),
    )


def cluster_rows(words: DataFrame) -> DataFrame:
    """Text row number per word: a new row starts when the gap to the previous word's centre exceeds the page's limit."""
    centred = words.join(page_limits(words), PAGE).withColumn("y_centre", F.col("y") + F.floor(F.col("h") / 2))
    return islands(
        centred, PAGE, ["y_centre", "x", "text"], split=F.floor(F.col("y_centre") / 256), previous="y_centre",
        opens=lambda before: F.abs(F.col("y_centre") - before) > F.col("row_gap"), out="row_no", hot=hot_keys(words, PAGE),
    )


def split_cells(clustered: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Cells per text row: joined text, mean confidence and bounding box. `hot` may list hot pages."""
    keys = [*PAGE, "row_no"]
    numbered = islands(
        clustered.withColumn("_end", F.col("x") + F.col("w")), keys, ["x", "y_centre", "text"], split=F.floor(F.col("x") / 256),
        previous="_end", opens=lambda before: F.col("x") - before > F.col("cell_gap"), out="cell_no", hot=hot,
    )
    word = F.struct("x", "y_centre", "text")
    return numbered.groupBy(*keys, "cell_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda t: t["text"]), " ").alias("text"),
        F.avg("confidence").alias("confidence"), F.min("x").alias("x1"), F.min("y").alias("y1"),
        F.max("_end").alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"),
    )


def row_confidence(cells: DataFrame, skip_empty: bool = False) -> DataFrame:
    """Mean cell confidence per row; with `skip_empty` empty cells do not count and rows of only empty cells go."""
    keys = [*PAGE, "row_no"]
    if skip_empty:
        cells = cells.filter(F.trim("text") != "")
    return cells.groupBy(*keys).agg(F.avg("confidence").alias("row_confidence"))


def rows_from_cells(cells: DataFrame) -> DataFrame:
    """Cell rows for the parser: cells as an array in column order, with the row's confidence."""
    keys = [*PAGE, "row_no"]
    return cells.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cell_no", "text"))), lambda c: c["text"]).alias("cells"),
        F.avg("confidence").alias("row_confidence"),
    )


def _children(blocks: DataFrame, kind: str, keep: list[Column]) -> DataFrame:
    """(parent columns, child id, place) of the CHILD relations of one block type."""
    relations = F.filter("relationships", lambda r: r["type"] == "CHILD")
    ids = F.flatten(F.transform(relations, lambda r: r["ids"]))
    return blocks.filter(F.col("block_type") == kind).select("doc_id", *keep, F.posexplode(ids).alias("place", "child"))


def table_cells(blocks: DataFrame) -> DataFrame:
    """Cells of every table: text of their words in list order, confidence 0..1, box corners. Absent page means 1."""
    tables = _children(blocks, "TABLE", [F.col("id").alias("table_id"), F.coalesce("page", F.lit(1)).alias("page")])
    cells = blocks.filter("block_type = 'CELL'").select(
        "doc_id", F.col("id").alias("child"), F.coalesce("row_index", F.lit(0)).alias("row_no"),
        F.coalesce("column_index", F.lit(0)).alias("cell_no"), (F.coalesce("confidence", F.lit(0.0)) / 100).alias("confidence"),
        F.col("box.left").alias("x1"), F.col("box.top").alias("y1"),
        (F.col("box.left") + F.col("box.width")).alias("x2"), (F.col("box.top") + F.col("box.height")).alias("y2"),
    )
    words = blocks.filter("block_type = 'WORD'").select("doc_id", F.col("id").alias("child"), F.coalesce("text", F.lit("")).alias("word"))
    texts = (
        _children(blocks, "CELL", [F.col("id").alias("cell_id")]).join(words, ["doc_id", "child"])
        .groupBy("doc_id", F.col("cell_id").alias("child"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ").alias("text"))
    )
    return (
        tables.drop("place").join(cells, ["doc_id", "child"]).join(texts, ["doc_id", "child"], "left")
        .withColumn("text", F.coalesce("text", F.lit(""))).withColumnRenamed("child", "cell_id")
    )


def stitch_pages(parts: DataFrame) -> DataFrame:
    """Blocks of the result pages of one job as one document; a block repeated on two pages counts once.

    parts: job_id, part_no and block columns.
    """
    rest = [c for c in parts.columns if c not in ("job_id", "part_no", "id")]
    return parts.groupBy("job_id", "id").agg(F.min_by(F.struct(*rest), "part_no").alias("_b")).select(
        F.col("job_id").alias("doc_id"), "id", "_b.*"
    )


def tier_counts(rows: DataFrame, keys: list[str], value: str = "confidence") -> DataFrame:
    return rows.groupBy(*keys, confidence_tier(F.col(value)).alias("tier")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_confidence")
    )
