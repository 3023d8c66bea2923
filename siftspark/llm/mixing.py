"""Documents of several sources mixed to target shares of the size in tokens (problem 8).

Pfair scheduling. Time is cut into slots of one block of BLOCK tokens each. The j-th block of a source with weight w may
not start before slot floor(j / w) and must be done by slot ceil((j + 1) / w); in every slot the source with the earliest
deadline among those released runs. At any slot a source is then less than one block away from its share. Weights are
the target shares as exact fractions; with Q their common denominator the schedule repeats every Q slots, so that one
period, of bounded length, is all that is worked out on the driver, and a block's slot follows from its number.

`blocks` has the mix as the schedule deals it: documents cut at block borders, each piece in the slot of its block.
`mixture` has one row for each use of a document, with the slot of its first token; read that way, document by document,
a source runs ahead of its share by less than one block and the rest of its last document.

The size of the mix is the largest at which every source can give its share with at most max_repeats uses of a document.
Within a source documents stand in hash order; their token offsets come from running totals over a range partitioning
(siftspark.operators.skew), so a source with a third of all rows is no single task.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions.text import presence
from siftspark.llm import tokensets as ts
from siftspark.llm.encode import VOCABULARY, token_counts
from siftspark.operators.skew import running
from siftspark.runtime import stage, table

#: Tokens of a block.
BLOCK = 4096
#: Most slots of a period: the bound of what the driver works out and of the broadcast schedule.
PARTS = 1_000_000


def period(shares: dict[str, float], parts: int = PARTS) -> dict[str, int]:
    """Blocks per period of each source with a positive share, in lowest terms.

    Shares are taken as the decimal fractions they are written as. Only if their common denominator is above ``parts``
    are they rounded to that many parts, by largest remainder, and none to less than one part: no source is left out.
    """
    exact = {s: Fraction(repr(float(v))) for s, v in shares.items() if v > 0}
    if not exact:
        return {}
    total = sum(exact.values())
    exact = {s: v / total for s, v in exact.items()}
    q = lcm(*(v.denominator for v in exact.values()))
    if q <= parts:
        whole = {s: int(v * q) for s, v in exact.items()}
    else:
        whole = {s: max(1, int(v * parts)) for s, v in exact.items()}
        by_rest = sorted(exact, key=lambda s: (whole[s] - exact[s] * parts, s))
        for s in by_rest[: max(0, parts - sum(whole.values()))]:
            whole[s] += 1
    d = gcd(*whole.values())
    return {s: n // d for s, n in whole.items()}


def schedule(blocks: dict[str, int]) -> dict[str, list[int]]:
    """The slot of each block of one period: earliest deadline first among the released ones.

    Of equal deadlines the window that overlaps its successor's, and so binds it, goes first, as Pfair prescribes; then
    the larger weight, then the name.
    """
    q = sum(blocks.values())
    slots: dict[str, list[int]] = {s: [] for s in blocks}
    waiting = [(0, s) for s in sorted(blocks)]
    ready: list[tuple] = []
    for t in range(q):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            n, j = blocks[s], len(slots[s])
            heapq.heappush(ready, (-(-(j + 1) * q // n), (j + 1) * q % n == 0, -n, s))
        s = heapq.heappop(ready)[3]
        slots[s].append(t)
        if len(slots[s]) < blocks[s]:
            heapq.heappush(waiting, (len(slots[s]) * q // blocks[s], s))
    return slots


def sized(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens), sources trimmed and in lower case."""
    named = documents.select("doc_id", "text", F.lower(presence(F.col("source"))).alias("source"))
    return token_counts(named, ["doc_id", "source"], path)


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]]) -> tuple[int, dict[str, int]]:
    """(tokens of the mix, tokens of each source). A source without tokens can't give a share and is left out."""
    able = {s: v for s, v in targets.items() if sizes.get(s, 0) > 0 and v[0] > 0 and v[1] > 0}
    total = sum(v[0] for v in able.values())
    if not able:
        return 0, {}
    size = min(int(sizes[s] * most / (share / total)) for s, (share, most) in able.items())
    return size, {s: int(size * share / total) for s, (share, _) in able.items()}


def _streams(documents: DataFrame, targets: DataFrame, path: str) -> tuple[DataFrame, dict[str, int]]:
    """(doc_id, source, use, n_tokens, place) of every use of a document, and the blocks per period of each source."""
    spark = documents.sparkSession
    docs = stage(sized(documents, path).where("n_tokens > 0 and source is not null"), "sized")
    # One row per source of the target table, which the schedule needs on the driver; documents aren't collected.
    named = targets.select(F.lower(presence(F.col("source"))).alias("source"), "target_share", "max_repeats")
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in named.where("source is not null and target_share > 0 and max_repeats > 0").collect()}
    mine = docs.where(F.col("source").isin(list(wanted)))
    sizes = dict(mine.groupBy("source").agg(F.sum("n_tokens")).collect())
    _, quota = plan(sizes, wanted)
    sources = spark.createDataFrame([(s, quota[s], sizes[s]) for s in quota], "source string, quota long, size long")
    rows = mine.select("source", F.xxhash64("doc_id").alias("h"), "doc_id", "n_tokens")
    # One row per source of the target table is broadcast.
    placed = running(rows, "source", ["h", "doc_id"], "n_tokens", total="upto", rank="nth").join(F.broadcast(sources), "source")
    first = F.col("upto") - F.col("n_tokens")
    passes = F.ceil((F.col("quota") - first) / F.col("size")).cast("int")
    uses = placed.where(first < F.col("quota")).withColumn("use", F.explode(F.sequence(F.lit(1), passes)))
    uses = uses.withColumn("place", (F.col("use") - 1) * F.col("size") + first)
    return uses.select("doc_id", "source", "use", "n_tokens", "place"), period({s: wanted[s][0] for s in quota})


def _slotted(rows: DataFrame, per_period: dict[str, int]) -> DataFrame:
    """``rows`` with `slot`, from `number`, the number of a block in its source's stream. The schedule has at most PARTS rows."""
    import pandas as pd

    spark, q = rows.sparkSession, sum(per_period.values())
    lanes = pd.DataFrame([(s, j, t, len(v)) for s, v in schedule(per_period).items() for j, t in enumerate(v)], columns=["source", "_j", "_t", "_n"])
    sizes = spark.createDataFrame(list(per_period.items()), "source string, _n long")
    cut = rows.join(F.broadcast(sizes), "source").withColumn("_j", F.col("number") % F.col("_n"))
    lanes = spark.createDataFrame(lanes[["source", "_j", "_t"]].astype({"source": str, "_j": "int64", "_t": "int64"}), "source string, _j long, _t long")
    slot = F.floor(F.col("number") / F.col("_n")) * q + F.col("_t")
    return cut.join(F.broadcast(lanes), ["source", "_j"]).withColumn("slot", slot).drop("_j", "_t", "_n")


def mixture(documents: DataFrame, targets: DataFrame, block: int = BLOCK, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, use, n_tokens, slot, place): each use of a document in the mix; read by slot, then place.

    ``use`` counts a document's uses from 1, ``place`` is the token offset in the source's stream. Each source is read
    in whole passes and a last part of one, so it ends less than one document beyond its tokens. Documents without
    tokens or of a source that isn't in ``targets`` aren't dealt; targets with null, zero or negative values ask for
    nothing. Documents of equal hash stand by doc_id. Empty tables give no rows.
    """
    uses, per_period = _streams(documents, targets, path)
    out = _slotted(uses.withColumn("number", F.floor(F.col("place") / block)), per_period)
    return out.select("doc_id", "source", "use", "n_tokens", "slot", "place")


def blocks(documents: DataFrame, targets: DataFrame, block: int = BLOCK, path: str = VOCABULARY) -> DataFrame:
    """(slot, source, number, doc_id, use, start, n_tokens): the pieces of the mix, none across a block's border.

    ``number`` counts a source's blocks from 0, ``start`` is the piece's first token in its document. Every block but a
    source's last has exactly ``block`` tokens, and one slot. What takes part is as in `mixture`.
    """
    uses, per_period = _streams(documents, targets, path)
    last = F.floor((F.col("place") + F.col("n_tokens") - 1) / block)
    pieces = uses.withColumn("number", F.explode(F.sequence(F.floor(F.col("place") / block), last)))
    start = F.greatest(F.lit(0), F.col("number") * block - F.col("place"))
    end = F.least(F.col("n_tokens"), (F.col("number") + 1) * block - F.col("place"))
    pieces = pieces.withColumn("start", start).withColumn("n_tokens", end - start)
    return _slotted(pieces, per_period).select("slot", "source", "number", "doc_id", "use", "start", "n_tokens")


def lag(pieces: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, n_blocks, ahead, behind): how far each source gets from its share of the slots, in blocks of tokens.

    Measured on the sums of the pieces: a source is furthest ahead at the end of a slot of its own and furthest behind
    at the start of one. Its last block, which isn't full, is measured at its start only. Pfair keeps both below 1.
    """
    tokens = pieces.groupBy("source", "slot").agg(F.sum("n_tokens").alias("n"))
    so_far = running(tokens, "source", ["slot"], "n", total="upto", rank="nth")
    asked = targets.select(F.lower(presence(F.col("source"))).alias("source"), "target_share").where("target_share > 0")
    # Sources that gave nothing ask for nothing; one row for each source.
    here = tokens.select("source").distinct()
    w = asked.join(here, "source").withColumn("w", F.col("target_share") / F.sum("target_share").over(Window.partitionBy()))
    at = so_far.join(F.broadcast(w), "source")
    ahead = F.when(F.col("n") == block, F.col("upto") / block - F.col("w") * (F.col("slot") + 1))
    behind = F.col("w") * F.col("slot") - (F.col("upto") - F.col("n")) / block
    return at.groupBy("source").agg(F.count(F.lit(1)).alias("n_blocks"), F.max(ahead).alias("ahead"), F.max(behind).alias("behind"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_documents, n_uses, most_uses, n_tokens, share) of every source asked for."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("tokens"))
    got = per_doc.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_uses"), F.sum("tokens").alias("n_tokens")
    )
    asked = targets.select(F.lower(presence(F.col("source"))).alias("source"), "target_share", "max_repeats")
    both = asked.join(got, "source", "left").na.fill(0, ["n_documents", "n_uses", "most_uses", "n_tokens"])
    whole = F.sum("n_tokens").over(Window.partitionBy())
    return both.withColumn("share", F.when(whole > 0, F.round(F.col("n_tokens") / whole, 6)))


def _of(f):
    return lambda spark, folder: f(ts.documents(spark, folder), table(spark, folder, "mix_targets"))


QUERIES = {
    "p8_mix": _of(mixture),
    "p8_blocks": _of(blocks),
    "p8_shares": _of(lambda d, t: shares(mixture(d, t), t)),
    "p8_lag": _of(lambda d, t: lag(stage(blocks(d, t), "blocks"), t)),
}
