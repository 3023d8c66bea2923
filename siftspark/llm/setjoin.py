"""All pairs of a source and an external document with similar token sets (problem 3).

Metric pivot partitioning under Jaccard distance, which obeys the triangle inequality. A set's home is its nearest pivot.
If x is at home in cell p and y at home in q, then d(y, p) <= d(x, p) + d(x, y) and d(y, p) <= d(y, q) + 2 d(x, y). So y
is replicated to every cell p whose radius (the farthest set at home there) plus r reaches it and for which the second
bound holds, r being the largest distance of a similar pair; similar pairs then meet in the home cell of either. Cells
are the shuffle key of the exact join, and |d(x, p) - d(y, p)| > r rules out a pair in a cell without a look at it.

Which distance. The pivots are compared on 256-bit projections of the sets (neardup.bit_vectors); the Jaccard distance D
of projections is a metric as well, and costs 32 bytes a row instead of the tokens. If J(x, y) >= t, the sets' symmetric
difference, and so the projections' Hamming distance h, is at most a (n_x + n_y) with a = (1 - t) / (1 + t); with b_x and
b_y bits set, D = 2 h / (b_x + b_y + h), so D <= 2 a g / (1 + a g) for any g >= (n_x + n_y) / (b_x + b_y), which the
larger of n_x / b_x and n_y / b_y is (`reach`). So r is a little larger than 1 - t, and grows with a row's collisions.

Which pivots. Distances of unrelated functions crowd together near 0.8, so pivots picked for the whole corpus would send
nearly every set to nearly every cell (README.md has figures). Pivots are picked in strata instead: sets that share a
block of first tokens (tokensets.block_keys), which no similar pair escapes, some hundred rows each at any corpus size.
There a row becomes a pivot if no pivot before it is within RADIUS of it, so cells are tight, however many they must be.
Candidates come in one order for the whole corpus, so a family has the same pivot in all its strata, and cells of one
pivot are one cell.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import tokensets as ts
from siftspark.llm.blocks import STRATUM, expanded, tiled, whole_blocks
from siftspark.llm.neardup import UNIT_SQL, Units, sides, unit_tables, vector_rows
from siftspark.runtime import stage

SIMILAR = Fraction(7, 10)
#: A row within this distance of a pivot becomes no pivot.
RADIUS = 0.15
#: Pairs looked at together.
CHUNK = 1 << 20
SLACK = 1e-9


def reach(ratio: np.ndarray, t: Fraction) -> np.ndarray:
    """The largest projected distance of a pair with Jaccard >= t whose tokens by bits are at most ``ratio``."""
    x = float((1 - t) / (1 + t)) * ratio
    return 2 * x / (1 + x)


class Cells:
    """Pivots, homes and replicas of all strata of a table of units.

    rows, pivots, d: the entries, row by pivot, sorted by pivot; home: whether the row is at home there. Pivots are row
    numbers, and a stratum's pivots are rows of its own.
    """

    def __init__(self, u: Units, priority: np.ndarray, t: Fraction, radius: float = RADIUS):
        v, bits = u.v, np.bitwise_count(u.v).sum(axis=1, dtype=np.int64)
        self.ratio = u.n / np.maximum(bits, 1)
        m, unit = len(u.n), np.repeat(np.arange(len(u.sizes)), u.sizes)
        widest = np.maximum.reduceat(reach(self.ratio, t), u.starts[:-1])[unit] if m else np.zeros(0)
        order = np.lexsort((priority, unit))
        nearest, home = np.full(m, np.inf), np.full(m, -1)
        self.k = np.zeros(len(u.sizes), np.int64)
        found = []
        # Rounds: each stratum that has a row far from its pivots takes the first such row as its next pivot.
        live, rows = np.arange(len(u.sizes)), order
        while len(live):
            sizes = u.sizes[live]
            starts = np.cumsum(sizes) - sizes
            far = np.where(nearest[rows] > radius, np.arange(len(rows)), len(rows))
            first = np.minimum.reduceat(far, starts)
            keep = first < len(rows)
            if not keep.all():
                rows, live = rows[np.repeat(keep, sizes)], live[keep]
                continue
            self.k[live] += 1
            p = np.repeat(rows[first], sizes)
            h = np.zeros(len(rows), np.int64)
            for w in range(v.shape[1]):
                h += np.bitwise_count(v[rows, w] ^ v[p, w])
            d = 2 * h / np.maximum(bits[rows] + bits[p] + h, 1)
            closer = d < nearest[rows]
            nearest[rows[closer]], home[rows[closer]] = d[closer], p[closer]
            near = d <= radius + widest[rows] + SLACK
            found.append((rows[near], p[near], d[near]))
        self.rows, self.pivots, self.d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        extent, loosest = np.zeros(m), np.zeros(m)
        np.maximum.at(extent, home, nearest)
        np.maximum.at(loosest, home, self.ratio)
        self.r = reach(np.maximum(loosest[self.pivots], self.ratio[self.rows]), t)
        self.home = home[self.rows] == self.pivots
        keep = self.home | ((self.d <= extent[self.pivots] + self.r + SLACK) & (self.d <= nearest[self.rows] + 2 * self.r + SLACK))
        by = np.lexsort((self.rows, self.pivots))
        by = by[keep[by]]
        self.rows, self.pivots, self.d, self.r, self.home = (x[by] for x in (self.rows, self.pivots, self.d, self.r, self.home))

    def pairs(self):
        """(x, y) entries that meet in a cell: x at home, y a replica or a later one at home, not ruled out by the pivot."""
        yield from met(self.pivots, self.home, lambda x, y: np.abs(self.d[x] - self.d[y]) <= np.maximum(self.r[x], self.r[y]) + SLACK)


def met(cells: np.ndarray, home: np.ndarray, fits):
    """(x, y) of sorted ``cells``: x at home, y a replica or a later one at home, where ``fits``."""
    if not len(cells):
        return
    new = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    sizes = np.diff(np.append(new, len(cells)))
    first, count = np.repeat(new, sizes), np.repeat(sizes, sizes)
    for x, y in expanded(first, np.where(home, count, 0), CHUNK):
        ok = (~home[y] | (y > x)) & (x != y)
        x, y = x[ok], y[ok]
        ok = fits(x, y)
        yield x[ok], y[ok]


CELL_SQL = "pivot long, _t long, _u int, _tile int, cid long, home boolean, cells int"
FIGURES = ["strata", "strata_of_one_cell", "sets_in_strata", "cells", "homes", "replicas", "pairs_in_strata", "pairs_in_cells", "pairs_close"]


def _close_entries(u: Units, cells: Cells, across, t: Fraction):
    """Entries with an entry of the other side in their cell, within the bit vectors' radius; and how many pairs there were."""
    keep, looked, close = np.zeros(len(cells.rows), bool), 0, 0
    for x, y in cells.pairs():
        i, j = cells.rows[x], cells.rows[y]
        ok = across(i, j) & u.apart(i, j)
        x, y, i, j = x[ok], y[ok], i[ok], j[ok]
        looked += len(x)
        ok = u.close(i, j)
        keep[x[ok]] = keep[y[ok]] = True
        close += int(ok.sum())
    return keep, looked, close


def _across(tab: pa.Table):
    left, right = sides(tab, "left", "right")
    return lambda i, j: (left[i] & right[j]) | (right[i] & left[j])


def _partition(t: Fraction, figures: bool = False):
    """Cell rows of strata, or, with ``figures``, counts of what the partitioning did."""

    def run(batches):
        for tab, starts in unit_tables(batches):
            u, cid = Units(tab, starts, t), tab.column("cid").to_numpy()
            cells = Cells(u, ts.mix(cid.view(np.uint64)), t)
            keep, looked, close = _close_entries(u, cells, _across(tab), t)
            if figures:
                own = int((u.sizes * (u.sizes - 1) // 2).sum())
                n = [len(u.sizes), int((cells.k == 1).sum()), len(cid), int(cells.k.sum()), int(cells.home.sum()), int((~cells.home).sum()), own, looked, close]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in n], names=FIGURES)
                continue
            rows, pivots = cells.rows[keep], cells.pivots[keep]
            # Cells of a hot block's tiles stay apart, so that no cell outgrows them.
            hot = u.hot[rows]
            key = ts.mix(tab.column("key").to_numpy().view(np.uint64) ^ ts.mix(u.a.astype(np.uint64) << np.uint64(32) | u.b.astype(np.uint64))).view(np.int64)
            unit = np.repeat(np.arange(len(u.sizes)), u.sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cid[pivots]),
                    pa.array(np.where(hot, key[rows], 0)),
                    pa.array(np.where(hot & (u.a[rows] != u.b[rows]), 1, 0).astype(np.int32)),
                    pa.array(np.where(hot, u.tile[rows], 0).astype(np.int32)),
                    pa.array(cid[rows]),
                    pa.array(cells.home[keep]),
                    pa.array(cells.k[unit[rows]].astype(np.int32)),
                ],
                names=["pivot", "_t", "_u", "_tile", "cid", "home", "cells"],
            )

    return run


def _join(t: Fraction):
    """(a, b, cells): similar pairs of the two sides that meet in a cell, one of them at home."""

    def run(batches):
        for tab, starts in whole_blocks(batches, "pivot", least=4_000):
            cid, tile, cut, home, k = (tab.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "_tile", "_u", "home", "cells"))
            tok, across = ts.TokenRows(tab.column("tokens")), _across(tab)
            cell = np.repeat(np.arange(len(starts) - 1), np.diff(starts))

            def fits(x, y):
                lo, hi = np.minimum(tok.n[x], tok.n[y]), np.maximum(tok.n[x], tok.n[y])
                return (lo * t.denominator >= hi * t.numerator) & across(x, y) & ((cut[x] == 0) | (tile[x] != tile[y]))

            for x, y in met(cell, home.astype(bool), fits):
                ok = tok.similar(x, y, t)
                a, b = cid[x[ok]], cid[y[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.minimum(k[x[ok]], k[y[ok]]))], names=["a", "b", "cells"])

    return run


def _units(c: ts.Classes, t: Fraction) -> DataFrame:
    spark, total = c.sets.sparkSession, c.sets.count()
    order = ts.share(spark, ts.order_table(c.sets, "tokens", total))
    rows = c.sets.select("cid", "tokens", "left", "right").mapInArrow(vector_rows(order, total, t), f"{UNIT_SQL}, left boolean, right boolean")
    useful = F.col("_l") & F.col("_r")
    return tiled(rows, "key", "cid", useful, [F.max("left").alias("_l"), F.max("right").alias("_r")], stratum=STRATUM)


def _classes(documents: DataFrame, left: str, right: str) -> ts.Classes:
    docs = stage(ts.token_sets(documents.where(F.col("dataset").isin(left, right))), "tokens")
    return ts.classes(docs, {"left": F.col("dataset") == left, "right": F.col("dataset") == right})


def similar_across(c: ts.Classes, t: Fraction = SIMILAR) -> DataFrame:
    """(a, b, cells): pairs a < b of different classes with Jaccard >= t that hold a document of the left side in one and
    of the right side in the other, and the most cells that a stratum had where the two met."""
    on = ["pivot", "_t", "_u", "_tile", "cid"]
    rows = _units(c, t).mapInArrow(_partition(t), CELL_SQL).groupBy(*on).agg(F.max("home").alias("home"), F.max("cells").alias("cells"))
    held = rows.join(c.sets.select("cid", "tokens", "left", "right"), "cid").repartition("pivot", "_t", "_u").sortWithinPartitions("pivot", "_t", "_u", "cid")
    return held.mapInArrow(_join(t), "a long, b long, cells int").groupBy("a", "b").agg(F.max("cells").alias("cells"))


def document_pairs(documents: DataFrame, left: str = "primevul", right: str = "diversevul", t: Fraction = SIMILAR) -> DataFrame:
    """(doc_id_a, doc_id_b), doc_id_a < doc_id_b: every document of ``left`` with every similar one of ``right``.

    Only documents with at least 20 distinct tokens take part; null and damaged blobs and other datasets don't. Equal
    sets are similar. Copies are compared once and expanded by joins at the end, whose size is that of the result. An
    empty table gives no rows; further columns and nulls in them change nothing.
    """
    c = _classes(documents, left, right)
    pairs = stage(similar_across(c, t).select("a", "b"), "pairs")
    both = c.sets.where(F.col("left") & F.col("right")).select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(both)
    m = c.members.select("doc_id", "dataset", "cid").distinct()
    x = m.where(F.col("dataset") == left).select(F.col("cid").alias("a"), F.col("doc_id").alias("x"))
    y = m.where(F.col("dataset") == right).select(F.col("cid").alias("b"), F.col("doc_id").alias("y"))
    return ways.join(x, "a").join(y, "b").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def partition_figures(documents: DataFrame, left: str = "primevul", right: str = "diversevul", t: Fraction = SIMILAR) -> DataFrame:
    """One row of counts (FIGURES) of what the pivots did, with the similar pairs of classes found, and those of them
    that met in a stratum of more than one cell. An empty table gives zeros."""
    c = _classes(documents, left, right)
    counts = _units(c, t).mapInArrow(_partition(t, True), ", ".join(f"{f} long" for f in FIGURES))
    sums = counts.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in FIGURES])
    found = similar_across(c, t).agg(F.count(F.lit(1)).alias("found"), F.count(F.when(F.col("cells") > 1, 1)).alias("found_among_cells"))
    # Two tables of one row each.
    return sums.withColumn("_1", F.lit(1)).join(found.withColumn("_1", F.lit(1)), "_1").drop("_1")


QUERIES = {
    "p3_found": lambda s, d: document_pairs(ts.documents(s, d)),
    "p3_cells": lambda s, d: partition_figures(ts.documents(s, d)),
}
