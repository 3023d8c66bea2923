"""Text files with exact line numbers, however they are split among tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order of the splits of a corpus (fixed values).
SPLIT_ORDER = ("train", "valid", "test")


def numbered_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file_ord, file, line_number, value): lines of ``paths`` in their order, numbered from 1 within each path.

    A path may be a folder, whose files follow each other by name. A file is read in blocks by many tasks: rows are
    ranked within their block, whose size the reader bounds, and the counts of earlier blocks are added by a join on
    (file, block). A missing path is an error of the reader.
    """
    parts = []
    for i, p in enumerate(paths):
        t = spark.read.text(p).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        parts.append(t.withColumn("file_ord", F.lit(i)).withColumn("at", F.monotonically_increasing_id()))
    lines = parts[0]
    for t in parts[1:]:
        lines = lines.unionByName(t)
    block = Window.partitionBy("file_ord", "file", "block").orderBy("at")
    ranked = lines.withColumn("in_block", F.row_number().over(block))
    counts = lines.groupBy("file_ord", "file", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file_ord").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file_ord", "file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return ranked.join(starts, ["file_ord", "file", "block"]).select("file_ord", "file", (F.col("before") + F.col("in_block")).alias("line_number"), "value")


def read_jsonl(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str) -> DataFrame:
    """``numbered_lines`` parsed as one JSON object per line; a malformed line is an error, blank lines are dropped."""
    lines = numbered_lines(spark, paths).where(F.trim("value") != "")
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.select("file_ord", "line_number", parsed.alias("j")).select("file_ord", "line_number", "j.*")


def write_jsonl(df: DataFrame, path: str, order: Sequence[str], keep: Sequence[str]) -> None:
    """``keep`` as JSON lines in the given order: range-partitioned, so the folder's files follow each other by name."""
    sorted_ = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    sorted_.select(F.to_json(F.struct(*keep), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)
