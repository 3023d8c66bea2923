"""Token sets of documents: decoding, classes of equal sets, a corpus-wide token order and set prefixes.

A set's *prefix* for similarity t is the first n - ceil(t n) + 1 of its n tokens in a global order. Two sets with
Jaccard >= t share at least ceil(t n) tokens of either, so they share a token within both prefixes. The global order
puts rare tokens first; any order is right, this one keeps the blocks small.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.operators.skew import join_hot
from siftspark.runtime import stage, table

#: Documents with fewer distinct tokens take no part in similarity.
LEAST_TOKENS = 20
#: Bits of the numbers of the token order's counters: as many as the corpus asks for, within these bounds. A counter takes
#: a byte, so the table is 64 MB at most.
LEAST_BITS, MOST_BITS = 20, 26
#: A block that is expected to hold more rows than this is keyed by one more token, as far as CHAINS allow.
BLOCK = 1024
#: Tokens of a key at most, by the size of the larger set of a pair. A set of n tokens has p = n - ceil(t n) + 1 first ones,
#: so it makes at most C(p + 2, 3), C(p + 1, 2) or p keys, near a bound those of both sides: 11,500 at t = 0.7, less at larger t.
CHAINS = ((128, 3), (400, 2), (1 << 40, 1))
#: Keys that are made at a time.
KEYS = 1 << 20
#: Rows of counters that come to the driver as one value.
STRIPE = 14


def decode(blob: bytes | None) -> np.ndarray | None:
    """Sorted distinct 64-bit token hashes of a blob; None for null or damaged blobs."""
    if blob is None:
        return None
    try:
        raw = zlib.decompress(blob)
        n, at, out = int.from_bytes(raw[:4], "little"), 4, set()
        for _ in range(n):
            end = at + 4 + int.from_bytes(raw[at : at + 4], "little")
            if at + 4 > len(raw) or end > len(raw):
                return None
            out.add(xxhash.xxh3_64_intdigest(raw[at + 4 : end]))
            at = end
    except zlib.error:
        return None
    return np.sort(np.fromiter(out, dtype=np.uint64, count=len(out)).view(np.int64))


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [decode(x.as_py()) for x in b.column("token_blob")]
        keep = np.array([s is not None and len(s) >= LEAST_TOKENS for s in sets], dtype=bool)
        kept = [s for s, k in zip(sets, keep, strict=True) if k]
        sizes = np.array([len(s) for s in kept], dtype=np.int32)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        rest = b.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays(
            [
                rest.column("doc_id"),
                rest.column("dataset"),
                rest.column("row_id"),
                pa.array(sizes),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in kept], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            ],
            names=["doc_id", "dataset", "row_id", "n", "set_key", "tokens"],
        )


def token_sets(documents: DataFrame) -> DataFrame:
    """(doc_id, dataset, row_id, n, set_key, tokens) of documents with at least LEAST_TOKENS distinct tokens.

    Null and damaged blobs take no part; token_count is not used, because the blob is right where they differ.
    """
    return (
        documents.select("doc_id", "dataset", "row_id", "token_blob")
        .where(F.col("token_blob").isNotNull() & F.col("doc_id").isNotNull())
        .mapInArrow(_decode_batches, "doc_id long, dataset string, row_id string, n int, set_key binary, tokens array<long>")
    )


@dataclass
class Classes:
    """docs: as given; members: (doc_id, dataset, row_id, cid) for all; sets: (cid, n, tokens, *flags); sizes: (cid, _k),
    the members of each class."""

    docs: DataFrame
    members: DataFrame
    sets: DataFrame
    sizes: DataFrame

    def of_members(self, small: DataFrame, rows: DataFrame | None = None, how: str = "left") -> DataFrame:
        """Members, or other ``rows`` with a cid, with what ``small`` has for their class; a class of very many is no task."""
        return join_hot(self.members if rows is None else rows, small, "cid", self.sizes, how)


def classes(docs: DataFrame, flags: dict[str, Column] | None = None) -> Classes:
    """Collapses equal sets to one class, named by the least doc_id, before anything is compared.

    The count of copies of one set is unbounded; they meet only in a map-side combined aggregation over
    (set_key, doc_id). ``flags``: boolean columns of ``docs`` that hold for a class if they do for a member.
    """
    flags = flags or {}
    narrow = docs.groupBy("set_key").agg(F.min("doc_id").alias("cid"), F.count(F.lit(1)).alias("_k"), *[F.max(c).alias(k) for k, c in flags.items()])
    narrow = stage(narrow, "classes")
    members = join_hot(docs.select("doc_id", "dataset", "row_id", "set_key"), narrow.select("set_key", "cid"), "set_key", narrow.select("set_key", "_k")).drop("set_key")
    sets = docs.select(F.col("doc_id").alias("cid"), "n", "tokens").join(narrow.drop("set_key", "_k"), "cid").dropDuplicates(["cid"])
    return Classes(docs, members, stage(sets, "sets"), narrow.select("cid", "_k"))


@dataclass
class Order:
    """How often values occur, by their low bits: a byte for each counter, eight steps for each power of two, rounded up.

    Counters are never too low, and exact for 0 and 1. Different values may share one; then either seems as frequent as
    both, which costs time but no result: any order that all sets share will do.
    """

    codes: np.ndarray

    @property
    def mask(self) -> int:
        return len(self.codes) - 1

    def of(self, values: np.ndarray) -> np.ndarray:
        return _COUNTS[self.codes[values & self.mask]]


_COUNTS = np.concatenate([[0.0], 2.0 ** (np.arange(255) / 8)])


def codes(counts: np.ndarray) -> np.ndarray:
    """The byte of each count."""
    c = np.asarray(counts, float)
    return np.where(c > 0, np.minimum(1 + np.ceil(np.log2(np.maximum(c, 1)) * 8 - 1e-9), 255), 0).astype(np.uint8)


def bits_for(sets: int) -> int:
    """Bits of the counters' numbers for so many sets."""
    return min(MOST_BITS, max(LEAST_BITS, (8 * sets).bit_length()))


def counters(slots: DataFrame, bits: int) -> Order:
    """The order of (slot) rows: counts are combined map-side and come to the driver as stripes of bytes."""
    counts = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).withColumn("stripe", F.shiftright("slot", STRIPE))
    width = 1 << STRIPE

    def striped(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            slot, c = b.column("slot").to_numpy(), codes(b.column("n").to_numpy())
            for k in np.unique(slot >> STRIPE):
                at = slot >> STRIPE == k
                held.setdefault(int(k), np.zeros(width, np.uint8))[slot[at] & (width - 1)] = c[at]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["stripe", "bytes"])

    out = np.zeros(1 << bits, np.uint8)
    # At most 2 ** MOST_BITS bytes.
    for r in counts.repartition("stripe").select("slot", "n").mapInArrow(striped, "stripe int, bytes binary").collect():
        out[r["stripe"] << STRIPE : (r["stripe"] + 1) << STRIPE] |= np.frombuffer(r["bytes"], np.uint8)
    return Order(out)


def order_table(items: DataFrame, column: str, sets: int) -> Order:
    """Occurrences of all array elements of ``column``, of ``sets`` rows."""
    bits = bits_for(sets)
    low = F.explode(F.transform(column, lambda t: t.bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")))
    return counters(items.select(low.alias("slot")), bits)


def share(spark: SparkSession, order: Order):
    """A broadcast of the order; its size is bounded by MOST_BITS."""
    return spark.sparkContext.broadcast(order)


def prefix_lengths(n: np.ndarray, t: Fraction) -> np.ndarray:
    """n - ceil(t n) + 1, in whole numbers."""
    return n - -(-n * t.numerator // t.denominator) + 1


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column, right also for slices."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _depths(n: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most tokens of a key that partners of sets of n tokens allow: those of n and of n / t tokens."""
    ends, depth = (np.array(x) for x in zip(*CHAINS, strict=True))
    return depth[np.searchsorted(ends, n * t.denominator // t.numerator)], depth[np.searchsorted(ends, n)]


def block_keys(values: np.ndarray, offsets: np.ndarray, order: Order, t: Fraction, total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, row) of the blocks that each row of token sets belongs to, some rows at a time.

    Sets with Jaccard >= t share ceil(t n) tokens of either, so the k-th of their common tokens in the global order lies
    among the first n - ceil(t n) + k of both. A key is the chain of a pair's first common tokens: of one if the token
    is rare, of two if it is in more than BLOCK sets, of three if both are expected together in more than BLOCK. Whether
    a chain goes on depends on its tokens, and on how long a chain the larger set of the pair allows (CHAINS), so both
    sets of a pair make the key of their common chain; a set near a bound makes the keys of either length. Tokens that
    are in one set only make no key; their counters, which are never too low, show it.
    """
    sizes = np.diff(offsets)
    if not len(sizes):
        return
    take = np.minimum(prefix_lengths(sizes, t), sizes)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((values, order.of(values), row_of))
    ranked, count = values[by].view(np.uint64), order.of(values[by])
    low, high = _depths(sizes, t)
    # The most keys a row may make; rows are taken together up to KEYS.
    frequent = np.bincount(row_of, weights=(count > BLOCK) & (np.arange(len(by)) - np.repeat(offsets[:-1], sizes) < np.repeat(take, sizes)), minlength=len(sizes))
    most = take + np.where(high > 1, (frequent + 1) * (take + 2) / 2, 0) * np.where(high > 2, (take + 3) / 3, 1)
    edge = np.append(0, np.cumsum(most))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(edge, edge[at] + KEYS, side="right")) - 1)
        rows = np.arange(at, end)
        parts = [_chains(rows[high[rows] == d], ranked, count, offsets, take, d, total) for _, d in CHAINS]
        parts += [_chains(rows[(low[rows] == d) & (high[rows] != d)], ranked, count, offsets, take, d, total) for _, d in CHAINS]
        key, row = (np.concatenate(x) for x in zip(*parts, strict=True))
        # Keys of rare tokens come with either length.
        first = np.lexsort((key, row))
        key, row = key[first], row[first]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        yield key[new].view(np.int64), row[new]
        at = end


def _chains(rows: np.ndarray, ranked: np.ndarray, count: np.ndarray, offsets: np.ndarray, take: np.ndarray, depth: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the chains of up to ``depth`` tokens of some rows."""
    at = np.repeat(offsets[rows], take[rows]) + _within(take[rows])
    row = np.repeat(rows, take[rows])
    keep = count[at] > 1
    at, row = at[keep], row[keep]
    key, expected = ranked[at], count[at]
    keys, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k in range(1, depth + 1):
        ends = (expected <= BLOCK) if k < depth else np.ones(len(at), bool)
        keys.append(key[ends])
        of.append(row[ends])
        at, row, key, expected = (x[~ends] for x in (at, row, key, expected))
        if not len(at):
            break
        # The next token of the chain: any later one among the first n - ceil(t n) + k + 1.
        more = np.maximum(np.minimum(take[row] + k, offsets[row + 1] - offsets[row]) - (at - offsets[row]) - 1, 0)
        prev = np.repeat(np.arange(len(at)), more)
        nxt = at[prev] + 1 + _within(more)
        at, row = nxt, row[prev]
        key = (key[prev] ^ (key[prev] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ranked[at]
        expected = expected[prev] * count[at] / max(total, 1)
    return np.concatenate(keys), np.concatenate(of)


def mix(x: np.ndarray) -> np.ndarray:
    """A well spread one-to-one image of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive stretches."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


#: Tokens of pairs that are intersected at a time.
CHUNK = 1 << 22


class TokenRows:
    """Sizes of intersections of rows' token sets, many pairs at a time; ``weight`` gives the weight of each value."""

    def __init__(self, column: pa.ChunkedArray, weight=None):
        values, self.offsets = flat(column.combine_chunks() if column.num_chunks != 1 else column.chunk(0))
        self.n = np.diff(self.offsets)
        names, self.codes = np.unique(values, return_inverse=True)
        self.width = max(len(names), 1)
        self.weight = weight(names) if weight else None

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.shared(i, j)[0]

    def shared(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values two rows share, and the weights of those together. Memory is bounded by tokens, not pairs."""
        count, total = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        ends = np.cumsum(self.n[i] + self.n[j])
        lo = 0
        while lo < len(i):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, side="right")))
            codes = np.sort(np.concatenate([self._codes(i[lo:hi]), self._codes(j[lo:hi])]))
            twice = codes[1:][codes[1:] == codes[:-1]]
            count[lo:hi] = np.bincount(twice // self.width, minlength=hi - lo)
            if self.weight is not None:
                total[lo:hi] = np.bincount(twice // self.width, weights=self.weight[twice % self.width], minlength=hi - lo)
            lo = hi
        return count, total

    def _codes(self, rows: np.ndarray) -> np.ndarray:
        n = self.n[rows]
        at = np.repeat(self.offsets[rows], n) + _within(n)
        return np.repeat(np.arange(len(rows)), n) * self.width + self.codes[at]

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        c = self.common(i, j)
        return 1 - c / (self.n[i] + self.n[j] - c)

    def similar(self, i: np.ndarray, j: np.ndarray, t: Fraction) -> np.ndarray:
        """Whether Jaccard >= t, in whole numbers."""
        c = self.common(i, j)
        return c * t.denominator >= (self.n[i] + self.n[j] - c) * t.numerator


def exact_pairs(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Of candidate (a, b), those with Jaccard >= t of their token sets."""
    a = sets.select(F.col("cid").alias("a"), F.col("n").alias("_na"), F.col("tokens").alias("_ta"))
    b = sets.select(F.col("cid").alias("b"), F.col("n").alias("_nb"), F.col("tokens").alias("_tb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("_i", F.size(F.array_intersect("_ta", "_tb")))
    return both.where(F.col("_i") * t.denominator >= (F.col("_na") + F.col("_nb") - F.col("_i")) * t.numerator).select("a", "b")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")
