"""MinHash signatures modulo a prime, band keys, and exact set similarity."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.functions.canonical import hash_prefix, sql_hash_prefix

#: Prime, number of functions, bands and rows per band (fixed values).
PRIME = 4_294_967_291
FUNCTIONS, BANDS, ROWS = 128, 16, 8
SEED = "siftspark|minhash|1"
THRESHOLD = 0.9


def coefficients(n: int = FUNCTIONS, seed: str = SEED) -> tuple[list[int], list[int]]:
    """a in 1..P-1 and b in 0..P-1 of each function, from the SHA-256 of `seed|i`."""
    digests = [hashlib.sha256(f"{seed}|{i}".encode()).digest() for i in range(n)]
    return [1 + int.from_bytes(d[:8], "big") % (PRIME - 1) for d in digests], [int.from_bytes(d[8:16], "big") % PRIME for d in digests]


def token_hash(c: Column) -> Column:
    return (hash_prefix(c) % PRIME).cast("long")


def sql_token_hash(expr: str) -> str:
    return f"({sql_hash_prefix(expr)} % {PRIME})::BIGINT"


#: Products of functions and tokens that are held at a time.
HELD = 1 << 20


def signatures(values: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row the least (a x + b) mod P of its token hashes, rows one after another in ``values``; PRIME throughout for a
    row without tokens. Tokens are taken in stretches, whatever rows they belong to; products stay below 2**64."""
    out = np.full((len(sizes), len(a)), PRIME, np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    step = max(1, HELD // len(a))
    for at in range(0, len(values), step):
        part, mine = values[at : at + step], row[at : at + step]
        begins = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        least = np.minimum.reduceat((part[:, None] * a + b) % np.uint64(PRIME), begins, axis=0)
        out[mine[begins]] = np.minimum(out[mine[begins]], least)
    return out.view(np.int64)


def _hash(token: str) -> int:
    """The number of `token_hash`."""
    return int.from_bytes(hashlib.sha256(token.encode()).digest()[:8], "big") % PRIME


def with_signature(df: DataFrame, keep: list[str], n: int = FUNCTIONS, seed: str = SEED) -> DataFrame:
    """``keep`` and `signature` of the column `tokens`; null tokens count as none. A batch's distinct tokens are hashed once."""
    a, b = (np.array(x, np.uint64) for x in coefficients(n, seed))

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            words = pc.list_flatten(lists).dictionary_encode()
            hashes = np.array([_hash(x) for x in words.dictionary.to_pylist()] or [0], np.uint64)
            rows = signatures(hashes[words.indices.to_numpy()], sizes, a, b)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), n).cast(pa.list_(pa.int64()))], names=[*keep, "signature"])

    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, "tokens").mapInArrow(run, f"{types}, signature array<long>")


def band_keys(n_bands: int = BANDS, rows: int = ROWS) -> Column:
    """A 64-bit key of each band of `signature`, in an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.xxhash64(F.slice("signature", i * rows + 1, rows)))


def bands(df: DataFrame, keep: list[str], n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per band: ``keep``, `band` and `band_key`."""
    slices = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.slice("signature", i * rows + 1, rows))
    return df.select(*keep, F.posexplode(slices).alias("band", "part")).select(
        *keep, "band", F.sha2(F.concat_ws(",", F.col("band").cast("string"), F.col("part").cast("array<string>")), 256).alias("band_key")
    )


def lsh_probability(j: Column, n_bands: int = BANDS, rows: int = ROWS) -> Column:
    """The chance that two sets of Jaccard j meet in a band."""
    return 1 - F.pow(1 - F.pow(j, rows), n_bands)


def cardinality_fits(a: Column, b: Column, t: float, slack: float = 1e-15) -> Column:
    """Whether sets of these sizes can have Jaccard >= t; two empty ones can, one empty one can't."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.when(hi == 0, True).when(lo == 0, False).otherwise(lo / hi + slack >= t)


def jaccard(common: Column, either: Column) -> Column:
    return F.when(either == 0, 1.0).otherwise(common / either)
