"""Blocks of rows that share a key: pruned, cut into tiles where hot, and handed out whole to Arrow batches.

A block's pairs are compared by a task that holds at most two tiles of it. Blocks of up to TILE rows are one tile.
Larger ones are salted into g tiles by row id; each unordered pair of tiles becomes a unit of its own, so no task ever
holds a whole hot block and no pair of rows is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.runtime import stage

#: Rows of a block that one tile holds at most, about.
TILE = 2048
#: Rows of small blocks that are put together into a stratum, about.
STRATUM = 384


def tiled(rows: DataFrame, key: str, row_id: str, useful: Column, extra: list[Column], tile: int = TILE, stratum: int | None = None, ordered: bool = True) -> DataFrame:
    """``rows`` of blocks for which ``useful`` holds, as units (key, _t, _u) with ``_tile``, sorted within partitions.

    ``extra``: aggregates that ``useful`` needs; they and the block's size ``_m`` are combined map-side. A pair of rows
    that lie in the same tile is to be compared in the unit _t = _u = its tile only, others in the unit of their tiles.
    With ``stratum`` the blocks of one tile are put together by hash into strata of about that many rows, which take the
    place of ``key``; a row that is in several blocks of a stratum comes several times, side by side. Not ``ordered``:
    left as they come.
    """
    size = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_m"), *extra).where((F.col("_m") > 1) & useful).select(key, "_m")
    if stratum:
        size = stage(size, "blocks")
        few = size.where(F.col("_m") <= tile).agg(F.sum("_m")).first()[0] or 0
    kept = rows.join(size, key)
    g = F.ceil(F.col("_m") / tile).cast("int")
    own = F.pmod(F.xxhash64(row_id), g.cast("long")).cast("int")
    units = kept.withColumn("_g", g).withColumn("_tile", own).drop("_m")
    units = units.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    units = units.withColumn("_t", F.least("_o", "_tile")).withColumn("_u", F.greatest("_o", "_tile")).drop("_o")
    if stratum:
        strata = F.lit(max(1, -(-few // stratum))).cast("long")
        units = units.withColumn(key, F.when(F.col("_g") > 1, F.col(key)).otherwise(F.pmod(F.xxhash64(key), strata)))
    if not ordered:
        return units.drop("_g")
    return units.drop("_g").repartition(key, "_t", "_u").sortWithinPartitions(key, "_t", "_u", row_id)


def expanded(first: np.ndarray, count: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): each i with first[i], ..., first[i] + count[i] - 1, in parts of about ``most`` pairs."""
    ends = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        n = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        yield i, first[i] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lo = hi


def whole_blocks(batches: Iterator[pa.RecordBatch], key: str, least: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables made of whole units in a partition sorted by units, with the units' start offsets.

    A unit may span Arrow batches; its rows are held until it ends.
    """
    held: list[pa.RecordBatch] = []
    count = 0

    def cut(done: bool):
        nonlocal held, count
        t = pa.Table.from_batches(held).combine_chunks()
        k, a, b = (t.column(c).to_numpy() for c in (key, "_t", "_u"))
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        if done:
            held, count = [], 0
            return t, np.append(new, len(t))
        last = int(new[-1])
        held, count = t.slice(last).to_batches(), len(t) - last
        return (t.slice(0, last).combine_chunks(), new) if last else None

    waiting = least
    for b in batches:
        if b.num_rows:
            held.append(b)
            count += b.num_rows
        if count >= waiting and (out := cut(False)):
            yield out
        waiting = max(least, 2 * count if count >= waiting else waiting)
    if count:
        yield cut(True)
