"""Per-key results when a few keys hold most rows.

Rows are range-partitioned on (key, secondary order): Spark samples quantiles of the composite key, so a heavy key is
cut across as many partitions as its rows need while light keys share one. Every partition then makes one partial
state per key, and only the states - at most one more per partition than there are keys - are stitched at the borders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftspark.runtime import stage

PART = "_part"


def _width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned on keys and secondary order, with the partition's number as ``_part``."""
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    return df.repartitionByRange(partitions or _width(df), *by).withColumn(PART, F.spark_partition_id())


def keyed_states(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], states: dict[str, tuple[Column, str]], partitions: int | None = None
) -> DataFrame:
    """One row per key from stitched partial states.

    ``states``: name -> (input column, how), how being one of count, sum, min, max. Null keys form a key of their own,
    ties in the secondary order change nothing, an empty input gives no rows, and other columns of ``df`` are ignored,
    whatever their names.
    """
    partial = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    stitch = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    # The secondary order must stay visible under its own name; inputs of states get names of ours.
    inputs = df.select(*keys, *[c for c in order if c not in keys], *[c.alias(f"_in_{n}") for n, (c, _) in states.items()])
    parts = (
        ranged(inputs, keys, order, partitions)
        .groupBy(PART, *keys)
        .agg(*[partial[how](f"_in_{n}").alias(n) for n, (_, how) in states.items()])
    )
    return parts.groupBy(*keys).agg(*[stitch[how](n).alias(n) for n, (_, how) in states.items()])


def running(
    df: DataFrame, key: str, order: Sequence[str], value: str, total: str = "running", rank: str = "rank", partitions: int | None = None
) -> DataFrame:
    """Adds the running sum of ``value`` (a long; null counts as 0) and the 1-based rank of each row within its key.

    The order must be total for a defined result; rows that tie in it get an arbitrary order among themselves. A key's
    rows may lie in any number of partitions: each one carries sums only from its own first row, and the sums of the
    partitions before it are added by a join on (partition, key). Only keys cut by a border take part in that join, at
    most two for each partition, which is the proven bound of what is broadcast.
    """
    cols = df.columns
    if {total, rank, PART} & set(cols):
        raise ValueError(f"{total}, {rank} and {PART} must not be columns of the input")
    sort = [F.col(c).asc_nulls_first() for c in (key, *order)]
    schema = T.StructType([*ranged(df, [key], order, partitions).schema.fields, T.StructField(total, T.LongType()), T.StructField(rank, T.LongType())])

    def local(batches):
        last, sums, rows = object(), 0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            k = pdf[key].astype(object).where(pdf[key].notna(), None)
            new = (k != k.shift()).to_numpy() & ~(k.isna() & k.shift().isna()).to_numpy()
            first = k.iloc[0]
            new[0] = not (first == last or (first is None and last is None))
            run = np.cumsum(new)
            v = pdf[value].fillna(0).astype("int64")
            t = v.groupby(run).cumsum().to_numpy() + np.where(run == 0, sums, 0)
            r = np.arange(len(pdf)) - np.maximum.accumulate(np.where(new, np.arange(len(pdf)), 0)) + 1
            r = r + np.where(run == 0, rows, 0)
            last, sums, rows = k.iloc[-1], int(t[-1]), int(r[-1])
            pdf[total], pdf[rank] = t, r
            yield pdf

    done = stage(ranged(df, [key], order, partitions).sortWithinPartitions(*sort).mapInPandas(local, schema), "running")
    ends = done.groupBy(PART, key).agg(F.max(rank).alias("_n"), F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_s"))
    # Border keys: those in more than one partition.
    cut = ends.groupBy(key).agg(F.collect_list(F.struct(PART, "_n", "_s")).alias("_e")).where(F.size("_e") > 1)
    before = cut.select(F.col(key).alias("_k"), F.explode("_e").alias("_x"), "_e").select(
        "_k",
        F.col(f"_x.{PART}").alias("_p"),
        F.aggregate("_e", F.lit(0).cast("long"), lambda a, e: a + F.when(e[PART] < F.col(f"_x.{PART}"), e["_s"]).otherwise(0)).alias("_ds"),
        F.aggregate("_e", F.lit(0).cast("long"), lambda a, e: a + F.when(e[PART] < F.col(f"_x.{PART}"), e["_n"]).otherwise(0)).alias("_dn"),
    )
    joined = done.join(F.broadcast(before), (done[PART] == F.col("_p")) & done[key].eqNullSafe(F.col("_k")), "left")
    return joined.select(
        *[done[c] for c in cols],
        (done[total] + F.coalesce("_ds", F.lit(0))).alias(total),
        (done[rank] + F.coalesce("_dn", F.lit(0))).alias(rank),
    )


#: A key is hot if it has at least this part of all rows, so there are no more hot keys than its denominator.
HOT = 1000


def join_hot(big: DataFrame, small: DataFrame, key: str, sizes: DataFrame, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has at most one row for each key, without a task for a hot key.

    ``sizes``: (key, _k), the rows of ``big`` for each key, or for those that matter. Rows of keys with at least one in HOT
    of all rows meet their rows of ``small`` as a broadcast, which HOT bounds; the others are shuffled. ``how`` is inner or
    left. Null keys find nothing.
    """
    total = sizes.agg(F.sum("_k")).first()[0] or 0
    hot = sizes.where(F.col(key).isNotNull() & (F.col("_k") * HOT >= F.lit(total))).select(F.col(key).alias("_key"))
    few = F.broadcast(small.join(F.broadcast(hot), F.col(key) == F.col("_key")).drop("_key"))
    marked = big.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left")
    ours, theirs = marked.where("_key is not null").drop("_key"), marked.where("_key is null").drop("_key")
    return ours.join(few, key, how).unionByName(theirs.join(small, key, how))


#: Slots that the order of a group is cut into.
GRAINS = 1024


def unit_slot(x: Column, down: bool = False) -> Column:
    """The slot of a number between 0 and 1 (scores a little outside go to the last ones), in rising or falling order."""
    slot = F.greatest(F.lit(0), F.least(F.lit(GRAINS - 1), F.floor(x * GRAINS))).cast("int")
    return F.lit(GRAINS - 1) - slot if down else slot


def size_slot(x: Column) -> Column:
    """The slot of any number by sign, size and a few digits: 128 for each power of two."""
    far = F.least(F.lit(16384.0), F.greatest(F.lit(0.0), F.log2(F.abs(x)) * 128 + 8192))
    return F.when(x == 0, 0).when(x > 0, far + 1).otherwise(-far - 1).cast("int")


def hex_slot(digest: Column) -> Column:
    """The slot of a hexadecimal digest by its first three digits."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def ordered_sums(
    df: DataFrame, by: Sequence[str], slot: Column, order: list[Column], sums: dict[str, Column], totals: dict[str, str] | None = None, how: Callable[[Column], Column] = F.sum
) -> DataFrame:
    """``df`` with running sums in ``order`` within each group, each row's own value included.

    ``slot`` is a small number that never falls in that order. Windows run within (group, slot), so a group isn't one
    task; what the slots before add is a window over one row for each slot, combined map-side, and joined back on the
    same key. ``totals``: of sums, names of columns with the group's whole sums. ``how``: F.max for running maxima instead.
    Groups must not be null; without ``by`` all rows are one group.
    """
    cols = df.columns
    t = df.select(*cols, slot.alias("_slot"), *[c.alias(f"_v_{n}") for n, c in sums.items()])
    per = t.groupBy(*by, "_slot").agg(*[how(F.col(f"_v_{n}")).alias(f"_p_{n}") for n in sums])
    group = Window.partitionBy(*by)
    before = group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*by, "_slot", *[how(F.col(f"_p_{n}")).over(before).alias(f"_b_{n}") for n in sums], *[how(F.col(f"_p_{n}")).over(group).alias(out) for n, out in (totals or {}).items()])
    inside = Window.partitionBy(*by, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = t.join(offsets, [*by, "_slot"])

    def whole(n: str) -> Column:
        here, earlier = how(F.col(f"_v_{n}")).over(inside), F.col(f"_b_{n}")
        return (F.greatest(here, earlier) if how is F.max else here + F.coalesce(earlier, F.lit(0))).alias(n)

    return joined.select(*cols, *map(whole, sums), *(totals or {}).values())
