"""Records of evaluation splits that stand, exactly or almost, in the training split (problem 1).

Content-defined chunks: a normalised record is cut where a rolling hash of its content says so, chunk digests are joined
across splits, and the lengths of shared chunks add up to overlap fractions. Edits change only the chunks near them.

Two normal forms are cut. For the overlap fractions of `record_overlap` it is the text, lower-case and with single
spaces, under a hash that rolls over 16 bytes. For `contaminated`, whose measure is the Jaccard of token sets, it is the
set in hash order, under a hash that rolls over the last `window` tokens. A token that is missing in the other set then
spoils at most window + 1 chunks (its own and those that begin less than a window behind it), one that the other set
adds at most `window`. For Jaccard >= t that is D chunks in all (`spoiled`). So of a set's c chunks at least c - D are
shared, with at least the length of the c - D shortest, and if c > D, one of the D + 1 rarest is among them.

Records are cut in two LEVELS. The coarse one joins the chunks of at least mean length and lets a pair pass if a
quarter of either's length is shared, in chunks of any length. Evaluation records that found no partner there are cut again, finer, where c > D is the rule; sets with c <= D
are cut into single tokens as well, for which D is the number of tokens that may be missing. There the D + 1 rarest
chunks are joined and a pair passes if it shares the length just proved, so that nothing is missed. With chunks longer
than two or three tokens there is no such proof: at Jaccard 0.85 every seventh token may differ. What passes is counted
exactly on the tokens.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.text import presence
from siftspark.llm import tokensets as ts
from siftspark.llm.blocks import expanded, tiled, whole_blocks
from siftspark.llm.neardup import sides
from siftspark.operators.skew import join_hot
from siftspark.plans.relations import record_split
from siftspark.runtime import stage, table

SIMILAR = Fraction(17, 20)
#: Text chunks: bytes under the rolling hash, and mean length in bytes.
WINDOW = 16
MEAN_BYTES = 64


@dataclass(frozen=True)
class Level:
    """Tokens under the rolling hash, mean chunk length in tokens, and whether pairs pass by what is proved."""

    window: int
    mean: int
    proved: bool


LEVELS = [Level(4, 4, False), Level(1, 2, True)]
#: Share of a record's tokens in shared chunks from which a pair passes at an unproved level.
LEAST_SHARE = Fraction(1, 4)
#: Pairs of a unit that are looked at together, and the largest length that a packed chunk tells.
CHUNK = 1 << 16
LENGTH = (1 << 12) - 1


def record_splits(records: DataFrame, documents: DataFrame) -> DataFrame:
    """(dataset, row_id, split, key) of the distinct records, with the split and the key as TESTDATA.md defines them.

    A split that neither column names and a record without any key stay null.
    """
    r = records.select(
        "dataset",
        "row_id",
        record_split(F.col("origin_split"), F.col("source_file")).alias("split"),
        F.lower(presence(F.col("exact_code_key"))).alias("own"),
    ).distinct()
    d = documents.select("dataset", "row_id", F.lower(presence(F.col("exact_code_key"))).alias("theirs")).where("theirs is not null")
    # Only the few records without a key look for their document's.
    missing = r.where("own is null").join(d, ["dataset", "row_id"], "left").groupBy("dataset", "row_id", "split").agg(F.min("theirs").alias("key"))
    return r.where("own is not null").withColumnRenamed("own", "key").select("dataset", "row_id", "split", "key").unionByName(
        missing.select("dataset", "row_id", "split", "key")
    )


def spoiled(n: np.ndarray, t: Fraction, window: int) -> np.ndarray:
    """The most chunks of a set of n tokens that a set with Jaccard >= t can spoil.

    With x tokens missing and y added, (n - x) / (n + y) >= t, and (window + 1) x + window y is largest at the largest
    x, or within a few of it, because whole numbers of added tokens fit unevenly.
    """
    p, q = t.numerator, t.denominator
    x = n * (q - p) // q
    worst = np.zeros(len(n), np.int64)
    for back in range(q):
        k = np.maximum(x - back, 0)
        worst = np.maximum(worst, (window + 1) * k + window * ((n * (q - p) - q * k) // p))
    return worst


def rolled(values: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """A hash of each token and the up to window - 1 before it in its row."""
    m = ts.mix(values.view(np.uint64))
    place = np.arange(len(values)) - np.repeat(offsets[:-1], np.diff(offsets))
    h = m.copy()
    for k in range(1, min(window, len(values))):
        turned = (m[:-k] << np.uint64(11 * k % 64)) | (m[:-k] >> np.uint64(64 - 11 * k % 64))
        h[k:] += np.where(place[k:] >= k, turned, np.uint64(0))
    return ts.mix(h)


@dataclass
class Chunks:
    """Chunks of sets: row numbers in rising order, packed digest and length, and of each row the most spoiled chunks.

    Rows from the count of sets on are the single tokens of sets with too few chunks.
    """

    row: np.ndarray
    packed: np.ndarray
    most: np.ndarray

    def least(self) -> np.ndarray:
        """Of each row the length that a similar row shares at least: that of its c - D shortest chunks."""
        length = self.packed & LENGTH
        by = np.lexsort((length, self.row))
        count = np.bincount(self.row, minlength=len(self.most))
        place = np.arange(len(by)) - np.repeat(np.cumsum(count) - count, count)
        kept = place < np.repeat(count - self.most, count)
        return np.bincount(self.row[by][kept], weights=length[by][kept], minlength=len(self.most)).astype(np.int64)


def set_chunks(values: np.ndarray, offsets: np.ndarray, t: Fraction, level: Level) -> Chunks:
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    mixed = ts.mix(values.view(np.uint64))
    cut = rolled(values, offsets, level.window) % np.uint64(level.mean) == 0
    starts = np.zeros(len(values), bool)
    starts[offsets[:-1][n > 0]] = True
    starts[1:] |= cut[:-1]
    at = np.flatnonzero(starts)
    digest = np.add.reduceat(ts.mix(mixed), at) if len(at) else np.zeros(0, np.uint64)
    length = np.diff(np.append(at, len(values)))
    chunk_row = row[at]
    most = spoiled(n, t, level.window)
    few = (np.bincount(chunk_row, minlength=len(n)) <= most) & level.proved
    single = few[row]
    digest = ts.mix(np.concatenate([digest, mixed[single] ^ np.uint64(0x5851F42D4C957F2D)]) + np.uint64(level.window))
    length = np.concatenate([length, np.ones(int(single.sum()), np.int64)])
    packed = (digest & ~np.uint64(LENGTH)) | np.minimum(length, LENGTH).astype(np.uint64)
    singles = np.where(few, ts.prefix_lengths(n, t) - 1, 0)
    return Chunks(np.concatenate([chunk_row, row[single] + len(n)]), packed.view(np.int64), np.concatenate([most, singles]))


CHUNKED_SQL = "cid long, fine boolean, train boolean, eval boolean, most int, least int, n int, chunks array<long>"


def _chunked(t: Fraction, level: Level):
    """(cid, fine, train, eval, most, least, n, chunks): one row for each set, and one more if it is cut into single tokens."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            values, offsets = ts.flat(b.column("tokens"))
            n = np.diff(offsets)
            c = set_chunks(values, offsets, t, level)
            count = np.bincount(c.row, minlength=len(c.most))
            least = c.least() if level.proved else np.tile(-(-n * LEAST_SHARE.numerator // LEAST_SHARE.denominator), 2)
            keep = np.flatnonzero(count)
            of = pa.array(keep % len(n))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count[keep])).astype(np.int32)), pa.array(c.packed))
            yield pa.RecordBatch.from_arrays(
                [b.column("cid").take(of), pa.array(keep >= len(n)), b.column("train").take(of), b.column("eval").take(of),
                 *[pa.array(x[keep].astype(np.int32)) for x in (c.most, least, np.tile(n, 2))], lists],
                names=["cid", "fine", "train", "eval", "most", "least", "n", "chunks"],
            )

    return run


def _digest(packed: np.ndarray) -> np.ndarray:
    """A packed chunk without its length, in the low bits."""
    return packed >> np.int64(12)


def _slots(bits: int):
    def run(batches):
        for b in batches:
            values, _ = ts.flat(b.column("chunks"))
            yield pa.RecordBatch.from_arrays([pa.array((_digest(values) & ((1 << bits) - 1)).astype(np.int32))], names=["slot"])

    return run


def _joined_chunks(order, level: Level):
    """(key, cid, fine, train, eval): the chunks that are joined, the most + 1 rarest or, if nothing is proved, those of at
    least mean length; those of one set only make no key."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            values, offsets = ts.flat(b.column("chunks"))
            take = b.column("most").to_numpy() + 1 if level.proved else np.diff(offsets)
            row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            count = order.value.of(_digest(values))
            by = np.lexsort((values, count, row))
            place = np.arange(len(by)) - np.repeat(offsets[:-1], np.diff(offsets))
            long = (values[by] & LENGTH) >= (1 if level.proved else level.mean)
            by = by[(place < take[row]) & (count[by] > 1) & long]
            of = pa.array(row[by])
            yield pa.RecordBatch.from_arrays([pa.array(values[by]), *[b.column(c).take(of) for c in ("cid", "fine", "train", "eval")]], names=["key", "cid", "fine", "train", "eval"])

    return run


def _across(tab: pa.Table, starts: np.ndarray, needed):
    """(x, y) of the units: an evaluation row and a training row; pairs whose outcome isn't ``needed`` any more drop out."""
    train, ev = sides(tab, "train", "eval")
    tile, a, b = (tab.column(c).to_numpy() for c in ("_tile", "_t", "_u"))
    sizes = np.diff(starts)
    first, count = np.repeat(starts[:-1], sizes), np.repeat(sizes, sizes)
    for x, y in expanded(first, np.where(ev, count, 0), CHUNK):
        ok = train[y] & ((a[x] == b[x]) | (tile[x] != tile[y])) & (x != y)
        x, y = x[ok], y[ok]
        ok = needed(x, y)
        yield x[ok], y[ok]


UNIT = ["key", "_t", "_u", "_tile", "cid", "train", "eval"]
UNIT_SQL = "key long, _t int, _u int, _tile int, cid long, train boolean, eval boolean"


def _overlapping(t: Fraction):
    """Rows of units with a row of the other side, of a size that allows it, with which they share as much length in
    chunks as is asked for."""

    def run(batches):
        for tab, starts in whole_blocks(batches, "key", least=4_000):
            most, least, n = (tab.column(c).to_numpy().astype(np.int64) for c in ("most", "least", "n"))
            chunks = ts.TokenRows(tab.column("chunks"), lambda packed: packed & LENGTH)
            keep = np.zeros(len(tab), bool)

            def needed(x, y):
                return ~(keep[x] & keep[y]) & (np.minimum(n[x], n[y]) * t.denominator >= np.maximum(n[x], n[y]) * t.numerator)  # noqa: B023

            for x, y in _across(tab, starts, needed):
                shared, length = chunks.shared(x, y)
                left = np.maximum(chunks.n[x] - most[x], chunks.n[y] - most[y])
                ok = (shared >= left) & (length >= np.maximum(least[x], least[y])) & (shared > 0)
                keep[x[ok]] = keep[y[ok]] = True
            yield from tab.select(UNIT).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _beside_train(t: Fraction):
    """(cid, partner): an evaluation class and a training class of the unit with Jaccard >= t.

    One partner is enough: pairs are checked in turns, one for each class that has none yet, so a unit gives at most one
    row per class, however many pairs it holds.
    """

    def run(batches):
        for tab, starts in whole_blocks(batches, "key", least=4_000):
            cid, tok = tab.column("cid").to_numpy(), ts.TokenRows(tab.column("tokens"))
            partner = np.full(len(tab), -1)
            for x, y in _across(tab, starts, lambda x, y: partner[x] < 0):  # noqa: B023
                while len(x):
                    _, first = np.unique(x, return_index=True)
                    ok = tok.similar(x[first], y[first], t)
                    partner[x[first[ok]]] = y[first[ok]]
                    rest = np.ones(len(x), bool)
                    rest[first] = False
                    rest &= partner[x] < 0
                    x, y = x[rest], y[rest]
            at = np.flatnonzero(partner >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(cid[partner[at]])], names=["cid", "partner"])

    return run


def _level_links(sets: DataFrame, t: Fraction, level: Level) -> DataFrame:
    """(cid, partner) of evaluation classes among ``sets`` for which the level finds a training class with Jaccard >= t."""
    spark = sets.sparkSession
    chunked = stage(sets.select("cid", "tokens", "train", "eval").mapInArrow(_chunked(t, level), CHUNKED_SQL), "chunks")
    bits = ts.bits_for(chunked.count())
    order = ts.share(spark, ts.counters(chunked.select("chunks").mapInArrow(_slots(bits), "slot int"), bits))
    keys = chunked.select("cid", "fine", "train", "eval", "most", "chunks").mapInArrow(_joined_chunks(order, level), "key long, cid long, fine boolean, train boolean, eval boolean")
    units = tiled(keys, "key", "cid", F.col("_l") & F.col("_r"), [F.max("train").alias("_l"), F.max("eval").alias("_r")], ordered=False)
    held = units.join(chunked.select("cid", "fine", "most", "least", "n", "chunks"), ["cid", "fine"])
    kept = _together(held.select(*UNIT, "most", "least", "n", "chunks")).mapInArrow(_overlapping(t), UNIT_SQL)
    return _together(kept.join(sets.select("cid", "tokens"), "cid").select(*UNIT, "tokens")).mapInArrow(_beside_train(t), "cid long, partner long")


def _together(units: DataFrame) -> DataFrame:
    return units.repartition("key", "_t", "_u").sortWithinPartitions("key", "_t", "_u", "cid")


def near_train(docs: DataFrame, t: Fraction = SIMILAR, levels: list[Level] | None = None) -> tuple[ts.Classes, DataFrame]:
    """Classes with flags train and eval, and (cid, partner, level) of each evaluation class with a document of the
    training split in it (level 0) or in a class with Jaccard >= t (the level that found it, from 1)."""
    c = ts.classes(docs, {"train": F.col("split") == "train", "eval": F.col("split") != "train"})
    found = [c.sets.where("train and eval").select("cid", F.col("cid").alias("partner"), F.lit(0).alias("level"))]
    left = c.sets.withColumn("eval", F.col("eval") & ~F.col("train")).where("train or eval")
    for k, level in enumerate(levels or LEVELS, 1):
        links = stage(_level_links(left, t, level).groupBy("cid").agg(F.min("partner").alias("partner"), F.lit(k).alias("level")), "links")
        found.append(links)
        left = left.join(links.select("cid"), "cid", "left_anti") if level != (levels or LEVELS)[-1] else left
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return c, out


def _placed_sets(splits: DataFrame, documents: DataFrame) -> DataFrame:
    """Token sets of documents that belong to a record of known split, with `split`."""
    of = splits.where("split is not null").select("dataset", "row_id", "split").distinct()
    return stage(ts.token_sets(documents).join(of, ["dataset", "row_id"]), "tokens")


def links(records: DataFrame, documents: DataFrame, t: Fraction = SIMILAR) -> DataFrame:
    """(dataset, origin_split, row_id, train_dataset, train_row_id, found_by): each record outside train whose key is
    that of a train record or whose document has Jaccard >= t with that of a train record, with such a record.

    found_by is `key`, or for others `set` (equal token sets) or `chunks 1`, `chunks 2` (the level of the cut). With a
    key the train record is the least of that key; else it belongs to one of the similar classes, of which the level
    that found one needs no more. Repeated records count once; records without key take part through their document
    only; records without a split are on neither side; documents with fewer than 20 distinct tokens take part through
    their key only. Empty tables give no rows; further columns change nothing.
    """
    splits = stage(record_splits(records, documents), "splits")
    outside = splits.where("split <> 'train'")
    first = F.min(F.struct(F.col("dataset").alias("train_dataset"), F.col("row_id").alias("train_row_id"))).alias("_p")
    keys = splits.where("split = 'train' and key is not null").groupBy("key").agg(first)
    by_key = outside.join(keys, "key").select("dataset", "split", "row_id", "_p", F.lit("key").alias("found_by"))
    docs = _placed_sets(splits, documents)
    c, near = near_train(docs, t)
    near = stage(near, "near")
    placed = stage(docs.select("doc_id", "dataset", "row_id", "split").join(c.members.select("doc_id", "cid").distinct(), "doc_id"), "placed")
    partners = placed.where("split = 'train'").groupBy(F.col("cid").alias("partner")).agg(first)
    named = F.when(F.col("level") == 0, F.lit("set")).otherwise(F.concat(F.lit("chunks "), F.col("level")))
    beside = near.join(partners, "partner").select("cid", "level", "_p")
    by_doc = c.of_members(beside, placed.where("split <> 'train'"), "inner").select("dataset", "split", "row_id", "_p", named.alias("found_by"))
    # The least found_by by rank: key, set, chunks 1, chunks 2.
    rank = F.when(F.col("found_by") == "key", 0).when(F.col("found_by") == "set", 1).otherwise(2)
    both = by_key.unionByName(by_doc).groupBy("dataset", F.col("split").alias("origin_split"), "row_id").agg(F.min(F.struct(rank.alias("rank"), "found_by", "_p")).alias("x"))
    return both.select("dataset", "origin_split", "row_id", "x._p.train_dataset", "x._p.train_row_id", "x.found_by")


def contaminated(records: DataFrame, documents: DataFrame, t: Fraction = SIMILAR) -> DataFrame:
    """(dataset, origin_split, row_id) of the records that `links` names."""
    return links(records, documents, t).select("dataset", "origin_split", "row_id")


_GEAR = ts.mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def text_chunks(text: bytes) -> list[bytes]:
    """Content-defined chunks of normalised text; joined they are the text."""
    if not text:
        return []
    g = _GEAR[np.frombuffer(text, np.uint8)]
    h = np.zeros(len(g), np.uint32)
    for k in range(min(WINDOW, len(g))):
        h[k:] += (g[: len(g) - k] << np.uint32(k)) | (g[: len(g) - k] >> np.uint32(32 - k)) if k else g
    cuts = np.flatnonzero(h[WINDOW - 1 : -1] % np.uint32(MEAN_BYTES) == 0) + WINDOW
    ends = [*cuts.tolist(), len(text)]
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _text_chunk_batches(batches):
    for b in batches:
        docs, digests, lengths = [], [], []
        for i, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            for chunk in text_chunks(" ".join((x or "").lower().split()).encode("utf-8", "replace")):
                docs.append(i)
                digests.append(xxhash.xxh3_128_digest(chunk))
                lengths.append(len(chunk))
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(digests, pa.binary()), pa.array(lengths, pa.int64())], names=["doc_id", "digest", "length"]
        )


def record_overlap(records: DataFrame, documents: DataFrame) -> DataFrame:
    """(dataset, origin_split, row_id, doc_id, n_bytes, shared_bytes, overlap) of every evaluation record with a
    document: how much of its normalised text stands in chunks of training documents.

    A null, empty or white-space text has no chunk, 0 bytes and a null overlap.
    """
    splits = record_splits(records, documents).where("split is not null").select("dataset", "row_id", "split").distinct()
    docs = stage(documents.select("dataset", "row_id", "doc_id").join(splits, ["dataset", "row_id"]), "placed")
    chunks = documents.select("doc_id", "text").mapInArrow(_text_chunk_batches, "doc_id long, digest binary, length long")
    placed = stage(chunks.join(docs.select("doc_id", "split"), "doc_id"), "chunks")
    seen = placed.where("split = 'train'").select("digest").distinct().withColumn("seen", F.lit(True))
    # A digest meets one row of `seen`; rows of a hot one are combined first and aren't shuffled.
    own = placed.where("split <> 'train'").groupBy("digest", "doc_id").agg(F.sum("length").alias("length"))
    sizes = placed.where("split <> 'train'").groupBy("digest").agg(F.count(F.lit(1)).alias("_k"))
    sums = join_hot(own, seen, "digest", sizes, "left").groupBy("doc_id").agg(
        F.sum("length").alias("n_bytes"), F.sum(F.when(F.col("seen"), F.col("length")).otherwise(0)).alias("shared_bytes")
    )
    out = docs.where("split <> 'train'").join(sums, "doc_id", "left").na.fill(0, ["n_bytes", "shared_bytes"])
    return out.select(
        "dataset", F.col("split").alias("origin_split"), "row_id", "doc_id", "n_bytes", "shared_bytes",
        F.when(F.col("n_bytes") > 0, F.round(F.col("shared_bytes") / F.col("n_bytes"), 6)).alias("overlap"),
    )


def overlap_report(records: DataFrame, documents: DataFrame) -> DataFrame:
    """Per dataset and evaluation split: records, records found, documents measured, and their bytes shared with train."""
    splits = record_splits(records, documents).where("split <> 'train'").groupBy("dataset", F.col("split").alias("origin_split")).agg(F.count(F.lit(1)).alias("n_records"))
    found = contaminated(records, documents).groupBy("dataset", "origin_split").agg(F.count(F.lit(1)).alias("n_found"))
    overlap = record_overlap(records, documents).groupBy("dataset", "origin_split").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n_bytes").alias("n_bytes"), F.sum("shared_bytes").alias("shared_bytes"),
        F.count(F.when(F.col("overlap") >= 0.5, 1)).alias("n_half_shared"),
    )
    on = ["dataset", "origin_split"]
    return splits.join(found, on, "left").join(overlap, on, "left").na.fill(0)


def _of(f):
    return lambda spark, folder: f(table(spark, folder, "records"), ts.documents(spark, folder))


QUERIES = {"p1_found": _of(contaminated), "p1_links": _of(links), "p1_overlap": _of(record_overlap), "p1_report": _of(overlap_report)}
