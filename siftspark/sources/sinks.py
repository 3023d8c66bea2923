"""Writers: all refuse to overwrite, and each file or folder appears whole through the commit protocol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order: Sequence[str], compression: str = "gzip") -> None:
    """Compressed CSV with a header, in a global order that range partitions keep: equal content gives equal files."""
    df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).write.mode("errorifexists").option("compression", compression).csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header under an explicit schema; a malformed row is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    w = df.write.mode("errorifexists")
    (w.partitionBy(*by) if by else w).parquet(path)


def append_phase(df: DataFrame, path: str, phase: str) -> None:
    """Appends rows under a phase of their own; readers see one table."""
    df.withColumn("phase", F.lit(phase)).write.mode("append").partitionBy("phase").parquet(path)


def split_labels(df: DataFrame, target: str, position: str, path: str) -> None:
    """Metadata without the label and the label by itself, aligned on the position."""
    write_parquet(df.drop(target), f"{path}/metadata")
    write_parquet(df.select(position, "row_id", target), f"{path}/labels")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, digest, n_bytes) of the data files under a folder, digests in upper case."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.upper(F.sha2("content", 256)).alias("digest"), F.col("length").alias("n_bytes"))


def content_digest(df: DataFrame) -> DataFrame:
    """(n, digest): a digest of a table's rows that no order, file layout or writer changes."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    low = F.coalesce(F.sum((row.bitwiseAND(F.lit(0xFFFFFFFF))).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    high = F.coalesce(F.sum(F.shiftrightunsigned(row, 32).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", low.cast("string"), high.cast("string")).alias("digest"))
