"""Groups of near-duplicate documents (problem 2).

Tiled exact comparison on bit vectors: each token set is also a 256-bit vector with a bit for every token's hash. The
Hamming distance of two vectors is at most the symmetric difference of the sets, which for Jaccard >= t is at most
(1 - t) / (1 + t) of the summed sizes: the radius. Tiles are compared with exclusive-or and bit counts; tile pairs whose
population counts differ beyond the radius are skipped. What passes is counted exactly on the tokens, so nothing is
missed and nothing false comes out. Groups need links, not all pairs: within a tile pair rows that are linked already
aren't compared with each other.

Comparing all tiles with all would be quadratic, so tiles are laid within strata of some hundred sets: blocks of sets
that share the first tokens of a global order (tokensets.block_keys), a necessary condition which loses no pair, put
together by hash (blocks.tiled). `tile_figures` counts what the tiles skip.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import tokensets as ts
from siftspark.llm.blocks import STRATUM, tiled, whole_blocks
from siftspark.llm.forest import components
from siftspark.runtime import stage

SIMILAR = Fraction(4, 5)
WORDS = 4
VECTOR = [f"v{w}" for w in range(WORDS)]
VECTOR_SQL = ", ".join(f"{v} long" for v in VECTOR)
#: Close pairs per close row of a unit up to which they are written; in denser ones links are found with the tokens.
DENSE = 8
#: Rows of a tile, and tile pairs compared together.
SQUARE = 16
TOGETHER = 2048


def bit_vectors(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bit = (values.view(np.uint64) >> np.uint64(40)) & np.uint64(64 * WORDS - 1)
    out = np.zeros((len(offsets) - 1, WORDS), np.uint64)
    np.bitwise_or.at(out, (rows, (bit >> np.uint64(6)).astype(int)), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64)


def vector_rows(order, total: int, t: Fraction):
    """Rows (key, cid, n, v0...) of each set's blocks, for mapInArrow; further columns of the input follow."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            values, offsets = ts.flat(b.column("tokens"))
            n = np.diff(offsets).astype(np.int32)
            vectors = bit_vectors(values, offsets)
            rest = b.drop_columns(["cid", "tokens"])
            for key, row in ts.block_keys(values, offsets, order.value, t, total):
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), b.column("cid").take(of), pa.array(n[row]), *[pa.array(vectors[row, w]) for w in range(WORDS)], *rest.take(of).columns],
                    names=["key", "cid", "n", *VECTOR, *rest.schema.names],
                )

    return run


class Units:
    """The units of a table, with what comparing their rows needs."""

    def __init__(self, tab: pa.Table, starts: np.ndarray, t: Fraction):
        self.t, self.starts, self.sizes = t, starts, np.diff(starts)
        self.tile, self.a, self.b = (tab.column(c).to_numpy() for c in ("_tile", "_t", "_u"))
        self.hot = self.b > 0
        self.n = tab.column("n").to_numpy().astype(np.int64)
        self.v = np.stack([tab.column(c).to_numpy() for c in VECTOR], axis=1).view(np.uint64)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs of a unit of two tiles count only across them."""
        return (self.a[i] == self.b[i]) | (self.tile[i] != self.tile[j])

    def close(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs lie within the radius."""
        return self._within(np.bitwise_count(self.v[i] ^ self.v[j]).sum(axis=1, dtype=np.int64), i, j)

    def _within(self, apart: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        p, q = self.t.numerator, self.t.denominator
        return (apart * (q + p) <= (q - p) * (lo + hi)) & (lo * q >= hi * p)

    def tile_pairs(self):
        """(x, y) row numbers of tile pairs, SQUARE each with -1 for none, whose population counts allow a close pair.

        Rows of a unit are sorted by population count and cut into tiles. Two counts differ by no more than the vectors'
        distance, so a pair of tiles whose counts are further apart than the radius of its largest sets is skipped.
        Counts of all tile pairs and of skipped ones add up in `seen` and `skipped`.
        """
        self.seen = self.skipped = 0
        pop = np.bitwise_count(self.v).sum(axis=1, dtype=np.int64)
        unit = np.repeat(np.arange(len(self.sizes)), self.sizes)
        by = np.lexsort((pop, unit))
        tiles = -(-self.sizes // SQUARE)
        of = np.repeat(np.arange(len(tiles)), tiles)
        at = self.starts[:-1][of] + SQUARE * (np.arange(len(of)) - np.repeat(np.cumsum(tiles) - tiles, tiles))
        end = np.minimum(at + SQUARE, self.starts[1:][of])
        slot = at[:, None] + np.arange(SQUARE)
        rows = np.where(slot < end[:, None], by[np.minimum(slot, len(by) - 1)], -1)
        least, most = pop[by[at]], pop[by[end - 1]]
        largest = np.maximum.reduceat(self.n[by], at)
        p, q = self.t.numerator, self.t.denominator
        for d in range(int(tiles.max(initial=0))):
            x = np.flatnonzero(of[d:] == of[: len(of) - d])
            near = (least[x + d] - most[x]) * (q + p) <= (q - p) * (largest[x] + largest[x + d])
            self.seen += len(x)
            self.skipped += int((~near).sum())
            x = x[near]
            for lo in range(0, len(x), TOGETHER):
                yield rows[x[lo : lo + TOGETHER]], rows[x[lo : lo + TOGETHER] + d], d == 0

    def close_pairs(self):
        """Close index pairs of all units, tile pair by tile pair."""
        self.compared = 0
        for a, b, same in self.tile_pairs():
            h = np.zeros((len(a), SQUARE, SQUARE), np.int16)
            for w in range(self.v.shape[1]):
                h += np.bitwise_count(self.v[a, w][:, :, None] ^ self.v[b, w][:, None, :])
            p, q = self.t.numerator, self.t.denominator
            size = self.n[a][:, :, None] + self.n[b][:, None, :]
            ok = (h.astype(np.int64) * (q + p) <= (q - p) * size) & (a >= 0)[:, :, None] & (b >= 0)[:, None, :]
            if same:
                ok &= np.arange(SQUARE)[:, None] < np.arange(SQUARE)
            self.compared += int(((a >= 0).sum(axis=1) * (b >= 0).sum(axis=1)).sum())
            k, x, y = np.nonzero(ok)
            i, j = a[k, x], b[k, y]
            lo, hi = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
            ok = (lo * q >= hi * p) & self.apart(i, j)
            yield i[ok], j[ok]


def sides(tab: pa.Table, left: str, right: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(tab.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in (left, right))


def unit_tables(batches):
    """Tables of whole units with their starts, each row once: a row may be in several blocks of a stratum."""
    for tab, _ in whole_blocks(batches, "key"):
        key, a, b, cid = (tab.column(c).to_numpy() for c in ("key", "_t", "_u", "cid"))
        unit = np.concatenate([[True], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        once = unit | np.concatenate([[True], cid[1:] != cid[:-1]])
        tab = tab.filter(pa.array(once)).combine_chunks()
        yield tab, np.append(np.flatnonzero(unit[once]), len(tab))


def with_tokens(units: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of units with their token sets, whole units together again."""
    held = units.join(sets.select("cid", "tokens"), "cid").repartition("key", "_t", "_u").sortWithinPartitions("key", "_t", "_u", "cid")
    return held.select(*units.columns, "tokens")


UNIT_SQL = f"key long, cid long, n int, {VECTOR_SQL}"
PLACE_SQL = "_tile int, _t int, _u int"
FIGURES = ["units", "sets_in_units", "tile_pairs", "tile_pairs_skipped", "pairs_in_units", "pairs_compared", "pairs_close"]
SIFTED = ["key", "cid", "n", *VECTOR, "_tile", "_t", "_u", "b"]


def _spread(tok: ts.TokenRows, u: Units, lo: int, hi: int, t: Fraction):
    """Links of a spanning forest of the similar rows lo..hi.

    Each row is compared with those that no row reached yet, so a family of m copies of each other costs about m
    comparisons and gives m - 1 links, not one for each pair.
    """
    rest = np.arange(lo, hi)
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.flatnonzero(u.close(np.full(len(rest), x), rest))
            hit = near[tok.similar(np.full(len(near), x), rest[near], t)]
            if len(hit):
                yield np.full(len(hit), x), rest[hit]
                front.extend(rest[hit].tolist())
                rest = np.delete(rest, hit)


def _sift(t: Fraction, figures: bool = False):
    """Close pairs (a, b) of units; of those with many for each row the close rows themselves, with null b.

    So what a unit gives, and what is held of it, is in proportion to its rows, however dense it is. With ``figures``,
    counts of what the tiles did.
    """

    def run(batches):
        for tab, starts in unit_tables(batches):
            u, cid = Units(tab, starts, t), tab.column("cid").to_numpy()
            unit = np.repeat(np.arange(len(u.sizes)), u.sizes)
            close, count, held = np.zeros(len(cid), bool), np.zeros(len(u.sizes), np.int64), []
            for i, j in u.close_pairs():
                close[i] = close[j] = True
                count += np.bincount(unit[i], minlength=len(count))
                fits = count[unit[i]] <= DENSE * u.sizes[unit[i]]
                held.append((i[fits], j[fits]))
            if figures:
                n = [len(u.sizes), len(cid), u.seen, u.skipped, int((u.sizes * (u.sizes - 1) // 2).sum()), u.compared, int(count.sum())]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in n], names=FIGURES)
                continue
            dense = count > DENSE * np.bincount(unit[close], minlength=len(count))
            i, j = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, int),) * 2
            i, j = i[~dense[unit[i]]], j[~dense[unit[i]]]
            x, y = cid[i], cid[j]
            kept = tab.take(pa.array(np.flatnonzero(close & dense[unit])))
            yield from pa.concat_tables(
                [
                    pa.table({"cid": np.minimum(x, y), "b": np.maximum(x, y)}),
                    kept.append_column("b", pa.nulls(len(kept), pa.int64())),
                ],
                promote_options="default",
            ).select(SIFTED).combine_chunks().to_batches()

    return run


def _link(t: Fraction):
    """(a, b): links that connect, within each unit, exactly what similar pairs connect."""

    def run(batches):
        for tab, starts in whole_blocks(batches, "key", least=4_000):
            u, tok, cid = Units(tab, starts, t), ts.TokenRows(tab.column("tokens")), tab.column("cid").to_numpy()
            found = [p for s, e in zip(starts[:-1], starts[1:], strict=True) for p in _spread(tok, u, int(s), int(e), t)]
            if found:
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                x, y = cid[i], cid[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def _units(c: ts.Classes, t: Fraction) -> DataFrame:
    spark, total = c.sets.sparkSession, c.sets.count()
    order = ts.share(spark, ts.order_table(c.sets, "tokens", total))
    rows = c.sets.select("cid", "tokens").mapInArrow(vector_rows(order, total, t), UNIT_SQL)
    return tiled(rows, "key", "cid", F.lit(True), [], stratum=STRATUM)


def similar_links(c: ts.Classes, t: Fraction = SIMILAR) -> DataFrame:
    """(a, b): links between classes with Jaccard >= t whose connected components are those of all similar pairs."""
    sifted = stage(_units(c, t).mapInArrow(_sift(t), f"{UNIT_SQL}, {PLACE_SQL}, b long"), "sifted")
    few = ts.exact_pairs(sifted.where("b is not null").select(F.col("cid").alias("a"), "b").distinct(), c.sets, t)
    many = with_tokens(sifted.where("b is null").drop("b"), c.sets).mapInArrow(_link(t), "a long, b long")
    return few.unionByName(many).distinct()


def near_duplicates(documents: DataFrame, t: Fraction = SIMILAR) -> DataFrame:
    """(doc_id, group_doc_id) of every document in a group of two or more, linked by Jaccard >= t and onwards.

    Documents with fewer than 20 distinct tokens, null or damaged blobs are in no group; equal sets always are. Other
    columns, nulls in them and repeated rows of one doc_id change nothing; an empty table gives no rows.
    """
    c = ts.classes(stage(ts.token_sets(documents), "tokens"))
    links = stage(similar_links(c, t), "links")
    roots = components(links)  # (node, root): classes that are linked
    # A class is in a group of two or more if it is linked or has two documents.
    of = c.sizes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").where("root is not null or _k > 1")
    groups = stage(of.select("cid", F.coalesce("root", "cid").alias("group_doc_id")), "groups")
    return c.of_members(groups, c.members.select("doc_id", "cid"), "inner").select("doc_id", "group_doc_id").distinct()


def tile_figures(documents: DataFrame, t: Fraction = SIMILAR) -> DataFrame:
    """One row of counts (FIGURES) of what the tiles did; zeros for an empty table."""
    c = ts.classes(stage(ts.token_sets(documents), "tokens"))
    counts = _units(c, t).mapInArrow(_sift(t, True), ", ".join(f"{f} long" for f in FIGURES))
    return counts.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in FIGURES])


QUERIES = {
    "p2_found": lambda s, d: near_duplicates(ts.documents(s, d)),
    "p2_tiles": lambda s, d: tile_figures(ts.documents(s, d)),
}
