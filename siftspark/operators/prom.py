"""Expert scores, sets and local p-values of the four-expert adapter, for two classes.

With two classes everything has a closed form: class 1 comes first if its probability isn't less than the other's. The
`adapter` reproduces the seeded random streams of NumPy for one cell at a time; the column forms draw their uniforms
from hashes of the record instead, need no order of rows and stay in the JVM.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions.canonical import bucket, sql_bucket
from siftspark.operators.skew import hex_slot, ordered_sums, unit_slot
from siftspark.operators.windows import _TIES
from siftspark.plans import relations as rel
from siftspark.plans.relations import CELL, with_sql

EXPERTS = ("lac", "topk", "aps", "raps")
#: Fixed values.
LAMBDAS = (0.0001, 0.001, 0.01, 0.1, 0.2)
TUNING = 0.2
GRAIN = 1 << 20


def uniform(row_id: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the record and the salt only."""
    return bucket(row_id, salt, GRAIN) / GRAIN


def rank(p: Column, label: Column) -> Column:
    """0 if the label is the more probable class (class 1 if equal), else 1."""
    return F.when((label == 1) == (p >= 1 - p), 0).otherwise(1)


def cumulative(p: Column, r: Column) -> Column:
    top = F.greatest(p, 1 - p)
    return F.when(r == 0, top).otherwise(top + F.least(p, 1 - p))


def expert_score(expert: str, p: Column, label: Column, u: Column | None = None, k_reg: Column | int = 1, lam: Column | float = 0.0) -> Column:
    own = F.when(label == 1, p).otherwise(1 - p)
    if expert == "lac":
        return 1 - own
    r = rank(p, label)
    if expert == "topk":
        return r.cast("double")
    s = cumulative(p, r) - u * own
    return s if expert == "aps" else s + lam * F.greatest(r + 1 - k_reg, F.lit(0))


def higher(df: DataFrame, by: list[str], value: str, alpha: float, name: str = "threshold") -> DataFrame:
    """The order statistic ceil(q (n - 1)) + 1 with q = (n + 1)(1 - alpha) / n, at most 1."""
    g = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    s = ordered_sums(g, by, unit_slot(F.col(value)), [F.col(value)], {"_u": F.col("_n")}, totals={"_u": "_t"})
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_t") + 1) * F.lit(1 - alpha) / F.col("_t")))
    return s.where(F.col("_u") >= F.ceil(q * (F.col("_t") - 1)) + 1).groupBy(*by).agg(F.min(value).alias(name))


def rank_set(p: Column, worst: Column) -> tuple[Column, Column]:
    """(safe, vulnerable) in the set of classes up to a rank, ties with its last class included."""
    last = F.when(worst >= 1, F.least(p, 1 - p)).otherwise(F.greatest(p, 1 - p))
    return 1 - p >= last, p >= last


def cumulative_set(p: Column, threshold: Column, k_reg: Column | int | None = None, lam: Column | float = 0.0) -> tuple[Column, Column]:
    """The set up to the first rank whose cumulative probability, with its penalty, reaches the threshold."""
    first = F.greatest(p, 1 - p) + (0 if k_reg is None else lam * F.greatest(1 - F.lit(k_reg) if isinstance(k_reg, int) else 1 - k_reg, F.lit(0)))
    return rank_set(p, F.when(first >= threshold, 0).otherwise(1))


def neighbours(n: Column) -> Column:
    return F.when(n < 200, n).otherwise(F.floor(n * 0.1))


def nearest(cal: DataFrame, tgt: DataFrame, cell: list[str], k: int, target_id: list[str]) -> DataFrame:
    """(cell, target_id, idx, distance): the k calibration rows whose `p` is nearest, ties by the lesser `idx`.

    Distinct values are ranked per cell; a target takes the k of them at either side of its place, each with its k least
    idx, and keeps the k nearest of those. That is exact, and k^2 rows at most meet a target, whatever the cell's size.
    """
    from siftspark.operators.joins import first_at_least

    w = Window.partitionBy(*cell, "p").orderBy("idx")
    kept = cal.select(*cell, "p", "idx").withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= k)
    values = kept.groupBy(*cell, "p").agg(F.sort_array(F.collect_list("idx")).alias("_ids"))  # at most k
    values = ordered_sums(values, cell, unit_slot(F.col("p")), [F.col("p")], {"_r": F.lit(1)})
    last = values.groupBy(*cell).agg(F.max("_r").alias("_last"))
    q = tgt.select(*cell, *target_id, F.col("p").alias("_own"))
    placed = first_at_least(values.select(*cell, "p", "_r"), q, cell, "p", "_r", "_own", unit_slot).join(last, cell)
    near = placed.withColumn("_r", F.coalesce("_r", F.col("_last") + 1)).withColumn("_r", F.explode(F.sequence(F.col("_r") - k, F.col("_r") + k - 1)))
    met = near.join(values, [*cell, "_r"]).select(*cell, *target_id, F.abs(F.col("p") - F.col("_own")).alias("distance"), F.explode("_ids").alias("idx"))
    by = Window.partitionBy(*cell, *target_id).orderBy("distance", "idx")
    return met.withColumn("_i", F.row_number().over(by)).where(F.col("_i") <= k).drop("_i")


# One cell, in NumPy, with seeded streams.


def _ranks(p: np.ndarray, label: np.ndarray) -> np.ndarray:
    return np.where((label == 1) == (p >= 1 - p), 0, 1)


def cell_scores(expert: str, p: np.ndarray, label: np.ndarray, u: np.ndarray | None = None, k_reg: int = 1, lam: float = 0.0) -> np.ndarray:
    own = np.where(label == 1, p, 1 - p)
    if expert == "lac":
        return 1 - own
    r = _ranks(p, label)
    if expert == "topk":
        return r.astype(float)
    top = np.maximum(p, 1 - p)
    s = np.where(r == 0, top, top + np.minimum(p, 1 - p)) - u * own
    return s if expert == "aps" else s + lam * np.maximum(r + 1 - k_reg, 0)


def cell_higher(scores: np.ndarray, alpha: float) -> float:
    n = len(scores)
    q = min(1.0, max(0.0, (n + 1) * (1 - alpha) / n))
    return float(np.sort(scores)[math.ceil(q * (n - 1))])


def _cell_rank_set(p: np.ndarray, worst: np.ndarray) -> np.ndarray:
    last = np.where(worst >= 1, np.minimum(p, 1 - p), np.maximum(p, 1 - p))
    return np.stack([1 - p >= last, p >= last], axis=1)


def _cell_cumulative_set(p: np.ndarray, threshold: float, k_reg: int | None = None, lam: float = 0.0) -> np.ndarray:
    first = np.maximum(p, 1 - p) + (0 if k_reg is None else lam * max(1 - k_reg, 0))
    return _cell_rank_set(p, np.where(first >= threshold, 0, 1))


def cell_k(n: int) -> int:
    """``neighbours`` of a number."""
    return n if n < 200 else math.floor(0.1 * n)


def cell_window(values: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reach, inside, tied) per own value: the distance to the k-th nearest of the sorted values, and how many of them
    are nearer and just as far. The window of k values is found by bisection over its first rank, without pairs."""
    lo, hi = np.zeros(len(own), int), np.full(len(own), len(values) - k)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        right = (lo < hi) & (own - values[mid] > values[np.minimum(mid + k, len(values) - 1)] - own)
        lo, hi = np.where(right, mid + 1, lo), np.where(right, hi, np.where(lo < hi, mid, hi))
    reach = np.maximum(np.abs(own - values[lo]), np.abs(values[lo + k - 1] - own))
    span = lambda r: np.searchsorted(values, own + r, "right") - np.searchsorted(values, own - r, "left")
    inside = np.maximum(0, span(reach - 1e-12))
    return reach, inside, span(reach + 1e-12) - inside


def _first(lo: np.ndarray, hi: np.ndarray, holds) -> np.ndarray:
    """Per query the least i in lo..hi for which ``holds``, a condition that stays true once it is; hi if none."""
    lo, hi = lo.copy(), hi.copy()
    while (lo < hi).any():
        mid = (lo + hi) // 2
        yes = (lo < hi) & holds(np.minimum(mid, mid.max(initial=0)))
        lo, hi = np.where((lo < hi) & ~yes, mid + 1, lo), np.where(yes, mid, hi)
    return lo


class RangeCounts:
    """How many of the values in a stretch of positions reach a bound: a wavelet matrix over their ranks.

    Every bit of the ranks, from the highest, moves rows with a 0 before those with a 1; a stretch stays a stretch. So a
    query costs one step per bit, and all queries take their steps together.
    """

    def __init__(self, values: np.ndarray):
        self.sorted = np.sort(values)
        ranks = np.searchsorted(self.sorted, values, "left")
        self.ones = []
        for bit in range(max(1, len(values).bit_length()) - 1, -1, -1):
            one = (ranks >> bit) & 1 == 1
            self.ones.append((bit, np.append(0, np.cumsum(one))))
            ranks = np.concatenate([ranks[~one], ranks[one]])

    def at_least(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        r, out = np.searchsorted(self.sorted, bound, "left"), np.zeros(len(lo), np.int64)
        lo, hi = lo.copy(), np.maximum(lo, hi)
        for bit, ones in self.ones:
            a, b, zeros = ones[lo], ones[hi], len(self.sorted) - ones[-1]
            high = (r >> bit) & 1 == 1
            out += np.where(high, 0, b - a)
            lo, hi = np.where(high, zeros + a, lo - a), np.where(high, zeros + b, hi - b)
        return out + (hi - lo)


def local_pvalues(cal: np.ndarray, own: np.ndarray, scores: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Per row of ``scores`` and each own value the share of its k nearest calibration rows whose score isn't below the
    bound. Of rows just as far as the k-th the earlier ones count.

    In the order of values the nearer rows are one stretch with those just as far on either side of it, so the shares are
    counts over stretches, whatever k is. Only where both sides tie with too many rows are the tied rows looked at.
    """
    by = np.lexsort((np.arange(len(cal)), cal))
    v, n = cal[by], len(cal)
    place = np.searchsorted(v, own, "left")
    low, high = np.zeros(len(own), int), np.full(len(own), n)
    first = _first(low, np.full(len(own), n - k), lambda i: own - v[i] <= v[np.minimum(i + k, n - 1)] - own)
    reach = np.maximum(own - v[first], v[np.minimum(first + k, n) - 1] - own)
    left, left_tie = (_first(low, place, f) for f in (lambda i: own - v[i] < reach, lambda i: own - v[i] <= reach))
    right, right_tie = (_first(place, high, f) for f in (lambda i: v[np.minimum(i, n - 1)] - own >= reach, lambda i: v[np.minimum(i, n - 1)] - own > reach))
    need = k - (right - left)
    n_left, n_right = left - left_tie, right_tie - right
    both = (n_left > 0) & (n_right > 0) & (n_left + n_right > need)
    take_left = np.where(both, 0, np.minimum(n_left, need))
    take_right = np.where(both, 0, np.minimum(n_right, need - take_left))
    out = np.empty((len(scores), len(own)))
    for e, score in enumerate(scores):
        held = RangeCounts(score[by])
        found = held.at_least(left, right, bounds[e]) + held.at_least(left_tie, left_tie + take_left, bounds[e]) + held.at_least(right, right + take_right, bounds[e])
        for i in np.flatnonzero(both):
            tied = np.sort(np.concatenate([by[left_tie[i] : left[i]], by[right[i] : right_tie[i]]]))[: need[i]]
            found[i] += int((score[tied] >= bounds[e, i]).sum())
        out[e] = found / k
    return out


class Draws:
    """What is left to chance in a cell: the tuning and the other calibration rows, and the uniforms of APS and RAPS for
    calibration rows (of RAPS the other ones, in their order) and targets."""

    def __init__(self, tuning, rest, aps, aps_target, raps, raps_target):
        self.tuning, self.rest, self.aps, self.raps = tuning, rest, (aps, aps_target), (raps, raps_target)

    @classmethod
    def seeded(cls, n: int, m: int, seed: int) -> Draws:
        """Five streams spawned from the seed serve, in this order, the tuning split, the uniforms of APS for calibration
        and target, and those of RAPS."""
        streams = [np.random.default_rng(x) for x in np.random.SeedSequence(seed).spawn(5)]
        order, cut = streams[0].permutation(n), max(1, math.ceil(TUNING * n))
        return cls(order[:cut], order[cut:], streams[1].random(n), streams[2].random(m), streams[3].random(n - cut), streams[4].random(m))


def cell_adapter(cal: np.ndarray, y: np.ndarray, tgt: np.ndarray, alpha: float, draws: Draws) -> dict[str, np.ndarray]:
    """Sets of each expert and of their union, for one cell.

    An expert accepts a singleton whose local p-value is above 1 - alpha; the union accepts what all four accept. Needs
    two calibration rows.
    """
    tuning, rest = draws.tuning, draws.rest
    forced = np.where(tgt > 0.5, 1, 0)
    pt, yt = cal[tuning], y[tuning]
    k_reg = int(cell_higher(cell_scores("topk", pt, yt), alpha)) + 1
    sizes = []
    for lam in LAMBDAS:
        th = cell_higher(cell_scores("raps", pt, yt, np.zeros(len(pt)), k_reg, lam), alpha)
        sizes.append(_cell_cumulative_set(pt, th, k_reg, lam).sum(axis=1).mean())
    lam = LAMBDAS[int(np.argmin(sizes))]
    u = {"aps": draws.aps, "raps": draws.raps}
    out, accepted = {}, np.ones(len(tgt), bool)
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for e in EXPERTS:
        c, l = (cal[rest], y[rest]) if e == "raps" else (cal, y)
        uc, ut = u.get(e, (None, None))
        held[e] = sc, _ = cell_scores(e, c, l, uc, k_reg, lam), cell_scores(e, tgt, forced, ut, k_reg, lam)
        th = cell_higher(sc, alpha)
        if e == "lac":
            sets = np.stack([1 - tgt >= 1 - th, tgt >= 1 - th], axis=1)
        elif e == "topk":
            sets = _cell_rank_set(tgt, np.full(len(tgt), int(th)))
        else:
            sets = _cell_cumulative_set(tgt, th, k_reg if e == "raps" else None, lam)
        out[e] = sets
    for c, experts in ((cal, EXPERTS[:3]), (cal[rest], EXPERTS[3:])):  # those on the same rows share their neighbours
        sc, st = (np.stack([held[e][i] for e in experts]) for i in (0, 1))
        out |= {f"p_{e}": x for e, x in zip(experts, local_pvalues(c, tgt, sc, st, cell_k(len(c))), strict=True)}
    for e in EXPERTS:
        accepted &= (out[e].sum(axis=1) == 1) & (out[f"p_{e}"] > 1 - alpha)
    union = np.ones((len(tgt), 2), bool)
    union[accepted] = np.stack([forced == 0, forced == 1], axis=1)[accepted]
    return out | {"union": union}


ADAPTED = "detector string, target_group string, seed int, position long, row_id string, alpha double, expert string, in_safe boolean, in_vulnerable boolean, p_value double"


def adapter(scored: DataFrame, cell: list[str], alphas: list[float]) -> DataFrame:
    """``cell_adapter`` for every cell and level. A cell is one task: its streams are drawn over its rows in order, so it
    can't be divided; cells with fewer than two calibration rows give none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["target_group", "position", "row_id"])
        c, t = pdf[pdf.side == "calibration"], pdf[pdf.side == "target"]
        parts = []
        if len(c) > 1 and len(t):
            for a in alphas:
                got = cell_adapter(c.p.to_numpy(), c.y.to_numpy(), t.p.to_numpy(), a, Draws.seeded(len(c), len(t), int(pdf.seed.iloc[0])))
                for e in (*EXPERTS, "union"):
                    parts.append(t[["detector", "target_group", "seed", "position", "row_id"]].assign(alpha=a, expert=e, in_safe=got[e][:, 0], in_vulnerable=got[e][:, 1], p_value=got.get(f"p_{e}", np.nan)))
        names = [x.split()[0] for x in ADAPTED.split(", ")]
        return pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)

    out = scored.groupBy(*cell).applyInPandas(run, ADAPTED)
    return out.withColumn("p_value", F.when(F.col("expert") != "union", F.col("p_value")))


#: Targets of a cell for each task.
SLICE = 20_000
DERIVED = "detector string, target_group string, seed int, position long, row_id string, y int, p double, alpha double, expert string, in_safe boolean, in_vulnerable boolean"


def hashed_adapter(scored: DataFrame, cell: list[str], alphas: list[float]) -> DataFrame:
    """The adapter's sets for every record of the target side, with the tuning split and the uniforms drawn from hashes of
    the records instead of streams. Nothing depends on the order of rows then, so a cell's targets are cut into tasks
    of about SLICE, each with the cell's calibration rows; of those a task holds six numbers a row."""
    u = [uniform(F.col("row_id"), x).alias(f"u_{x}") for x in ("aps", "raps")]
    base = scored.select(*cell, *[c for c in ("target_group", "position", "row_id", "y", "p") if c not in cell], *u, "side")
    tgt = base.where("side = 'target'")
    tasks = tgt.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("long").alias("_n"))
    cal = tuning_split(base.where("side = 'calibration'"), cell).join(tasks, cell).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    tgt = tgt.join(tasks, cell).withColumn("tunes", F.lit(False)).withColumn("_s", F.pmod(F.xxhash64("row_id"), F.col("_n"))).drop("_n")
    names = [x.split()[0] for x in DERIVED.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["target_group", "position", "row_id"])
        c, t = pdf[pdf.side == "calibration"], pdf[pdf.side == "target"]
        parts = []
        if len(c) > 1 and len(t):
            tunes = c.tunes.to_numpy(bool)
            draws = Draws(np.flatnonzero(tunes), np.flatnonzero(~tunes), c.u_aps.to_numpy(), t.u_aps.to_numpy(), c.u_raps.to_numpy()[~tunes], t.u_raps.to_numpy())
            for a in alphas:
                got = cell_adapter(c.p.to_numpy(), c.y.to_numpy(), t.p.to_numpy(), a, draws)
                parts += [t.assign(alpha=a, expert=e, in_safe=got[e][:, 0], in_vulnerable=got[e][:, 1])[names] for e in (*EXPERTS, "union")]
        return pd.concat(parts) if parts else pd.DataFrame(columns=names)

    return cal.unionByName(tgt).groupBy(*cell, "_s").applyInPandas(run, DERIVED)


WINDOW = "detector string, target_group string, seed int, position long, k long, reach double, inside long, tied long"


def windows_1d(scored: DataFrame, cell: list[str]) -> DataFrame:
    """The neighbourhood of each target record as k (``neighbours`` of its cell), the distance to the k-th nearest
    calibration value, and the rows nearer and just as far; of the latter the first ones fill up to k. A cell is one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, t = np.sort(pdf.p[pdf.side == "calibration"].to_numpy()), pdf[pdf.side == "target"]
        names = [x.split()[0] for x in WINDOW.split(", ")]
        if not len(c) or not len(t):
            return pd.DataFrame(columns=names)
        k = cell_k(len(c))
        reach, inside, tied = cell_window(c, t.p.to_numpy(), k)
        return t[["detector", "target_group", "seed", "position"]].assign(k=k, reach=reach, inside=inside, tied=tied)[names]

    return scored.groupBy(*cell).applyInPandas(run, WINDOW)


_ID = ["detector", "target_group", "seed", "side", "position"]


def _e(s, d, side=None):
    return rel.scored(s, d, side)


def _scores(s, d) -> DataFrame:
    e = _e(s, d)
    u = uniform(F.col("row_id"), "aps")
    return e.select(*_ID, *[F.round(expert_score(x, F.col("p"), F.col("y"), u, 1, 0.1), 10).alias(x) for x in EXPERTS])


def _thresholds(s, d) -> DataFrame:
    e = _e(s, d, "calibration").withColumn("score", expert_score("aps", F.col("p"), F.col("y"), uniform(F.col("row_id"), "aps")))
    return higher(e, CELL, "score", 0.1).select(*CELL, F.round("threshold", 10).alias("threshold"))


def _rank_sets(s, d) -> DataFrame:
    th = higher(_e(s, d, "calibration").withColumn("score", expert_score("topk", F.col("p"), F.col("y"))), CELL, "score", 0.1)
    t = _e(s, d, "target").join(th, CELL)
    a, b = rank_set(F.col("p"), F.col("threshold"))
    return t.select(*_ID, a.alias("in_safe"), b.alias("in_vulnerable"))


def _cumulative_sets(s, d) -> DataFrame:
    t = _e(s, d, "target").join(higher(_e(s, d, "calibration").withColumn("score", expert_score("aps", F.col("p"), F.col("y"), uniform(F.col("row_id"), "aps"))), CELL, "score", 0.1), CELL)
    a, b = cumulative_set(F.col("p"), F.col("threshold"))
    return t.select(*_ID, a.alias("in_safe"), b.alias("in_vulnerable"))


def tuning_split(cal: DataFrame, cell: list[str]) -> DataFrame:
    """``cal`` with `tunes`: the calibration rows of each cell that tune RAPS, the first fifth in hash order."""
    h = cal.withColumn("_h", F.sha2(F.concat(F.lit("tune|"), "row_id"), 256))
    r = ordered_sums(h, cell, hex_slot(F.col("_h")), [F.col("_h"), *map(F.col, _TIES)], {"_i": F.lit(1)}, totals={"_i": "_n"})
    return r.withColumn("tunes", F.col("_i") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * TUNING))).drop("_h", "_i", "_n")


def _split(s, d) -> DataFrame:
    return tuning_split(_e(s, d, "calibration"), CELL)


def _tuned(s, d, alpha: float = 0.1) -> DataFrame:
    """(cell, k_reg, lam): the penalty with the least mean set size on the tuning rows, the lesser of equal ones."""
    t = _split(s, d).where("tunes")
    k = higher(t.withColumn("score", expert_score("topk", F.col("p"), F.col("y"))), CELL, "score", alpha, "k").withColumn("k_reg", F.col("k").cast("int") + 1)
    t = t.join(k, CELL).withColumn("lam", F.explode(F.array(*map(F.lit, LAMBDAS))))
    t = t.withColumn("score", expert_score("raps", F.col("p"), F.col("y"), F.lit(0.0), F.col("k_reg"), F.col("lam")))
    th = higher(t, [*CELL, "lam"], "score", alpha)
    a, b = cumulative_set(F.col("p"), F.col("threshold"), F.col("k_reg"), F.col("lam"))
    m = t.join(th, [*CELL, "lam"]).groupBy(*CELL, "k_reg", "lam").agg(F.avg(a.cast("int") + b.cast("int")).alias("size"))
    return m.groupBy(*CELL, "k_reg").agg(F.min_by("lam", F.struct("size", "lam")).alias("lam"))


def _near(s, d, k: int = 5) -> DataFrame:
    c = _e(s, d, "calibration").withColumn("idx", F.concat_ws("|", "target_group", F.format_string("%012d", "position")))
    return nearest(c, _e(s, d, "target"), CELL, k, ["target_group", "position"])


def _pvalues(s, d) -> DataFrame:
    """The share of a record's five nearest calibration rows whose LAC score isn't below its own."""
    c = _e(s, d, "calibration").select(*CELL, F.concat_ws("|", "target_group", F.format_string("%012d", "position")).alias("idx"), expert_score("lac", F.col("p"), F.col("y")).alias("score"))
    t = _e(s, d, "target").select(*CELL, "target_group", "position", expert_score("lac", F.col("p"), (F.col("p") > 0.5).cast("int")).alias("own"))
    j = _near(s, d).join(c, [*CELL, "idx"]).join(t, [*CELL, "target_group", "position"])
    return j.groupBy(*CELL, "target_group", "position").agg(F.round(F.avg((F.col("score") >= F.col("own")).cast("int")), 9).alias("p_value"))


def _accept(s, d) -> DataFrame:
    a, b = rank_set(F.col("p"), F.lit(0))
    j = _e(s, d, "target").join(_pvalues(s, d), [*CELL, "target_group", "position"])
    return j.select(*_ID, ((a.cast("int") + b.cast("int") == 1) & (F.col("p_value") > 1 - 0.3)).alias("accepted"))


def _counts(s, d) -> DataFrame:
    n = _e(s, d, "calibration").groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("k", neighbours(F.col("n")).cast("long"))


#: The levels in use: the lesser budget of each operating point.
LEVELS = sorted({min(b) for b in rel.BUDGETS})


def _local(s, d) -> DataFrame:
    """Every expert's p-value over its cell's own number of neighbours at every level, and whether it accepts."""
    a = adapter(_e(s, d), CELL, LEVELS).where("expert <> 'union'")
    return a.withColumn("accepted", (F.col("in_safe") != F.col("in_vulnerable")) & (F.col("p_value") > 1 - F.col("alpha")))


QUERIES = {
    "prom_scores": _scores,
    "prom_quantile": _thresholds,
    "prom_rank_sets": _rank_sets,
    "prom_cumulative_sets": _cumulative_sets,
    "prom_raps_split": lambda s, d: _split(s, d).select(*_ID, "tunes"),
    "prom_raps_tune": _tuned,
    "prom_neighbor_count": _counts,
    "join_knn_1d": _near,
    "prom_local_pvalue": _pvalues,
    "prom_accept": _accept,
    "join_knn_window": lambda s, d: windows_1d(_e(s, d), CELL),
    "prom_local_experts": _local,
    "prom_union": lambda s, d: adapter(_e(s, d), CELL, [0.1]).where("expert = 'union'"),
    "prom_derived": lambda s, d: hashed_adapter(_e(s, d), CELL, LEVELS).drop("y", "p"),
    "prom_adapter": lambda s, d: adapter(_e(s, d), CELL, [0.01, 0.05, 0.1]),
}

_IDS = ", ".join(_ID)
_U = f"({sql_bucket('row_id', 'aps', GRAIN)} / {GRAIN}::DOUBLE)"
_OWN = "CASE WHEN y = 1 THEN p ELSE 1 - p END"
_RK = "CASE WHEN (y = 1) = (p >= 1 - p) THEN 0 ELSE 1 END"
_TOP = "greatest(p, 1 - p)"
_CUM = f"CASE WHEN {_RK} = 0 THEN {_TOP} ELSE {_TOP} + least(p, 1 - p) END"
_APS = f"({_CUM} - {_U} * ({_OWN}))"


def _higher_sql(name: str, source: str, by: str, alpha: float = 0.1) -> str:
    return f"""{name} AS (SELECT {by}, min(score) AS threshold FROM (SELECT {by}, score, row_number() OVER (PARTITION BY {by} ORDER BY score) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {source})
      WHERE i >= ceil(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (n + 1) * {1 - alpha}::DOUBLE / n)) * (n - 1)) + 1 GROUP BY {by})"""


_SPLIT = f"""sp AS (SELECT *, i <= greatest(1, ceil(n * {TUNING}::DOUBLE)) AS tunes FROM (SELECT *, row_number() OVER (PARTITION BY detector, seed ORDER BY sha256('tune|' || row_id), target_group, position) AS i, count(*) OVER (PARTITION BY detector, seed) AS n FROM cal))"""
_NEAR = """nn AS (SELECT * FROM (SELECT t.detector, t.seed, t.target_group, t.position, concat_ws('|', c.target_group, printf('%012d', c.position)) AS idx, abs(c.p - t.p) AS distance,
    c.p AS cp, c.y AS cy, t.p AS tp, row_number() OVER (PARTITION BY t.detector, t.seed, t.target_group, t.position ORDER BY abs(c.p - t.p), concat_ws('|', c.target_group, printf('%012d', c.position))) AS i
    FROM tgt t JOIN cal c ON c.detector = t.detector AND c.seed = t.seed) WHERE i <= 5),
  pv AS (SELECT detector, seed, target_group, position, round(avg((CASE WHEN cy = 1 THEN 1 - cp ELSE 1 - (1 - cp) END >= CASE WHEN tp > 0.5 THEN 1 - tp ELSE 1 - (1 - tp) END)::INT), 9) AS p_value FROM nn GROUP BY 1, 2, 3, 4)"""
_FORCED = "CASE WHEN p > 0.5 THEN 1 ELSE 0 END"
#: The sets of `hashed_adapter`: as ad, per record of the target side, level and expert.
DERIVED_SQL = f"""{_SPLIT}, lv AS (SELECT DISTINCT least(av, asafe) AS alpha FROM bud),
  q0 AS (SELECT detector, seed, target_group, position, row_id, p, y, tunes, {_OWN} AS own, {_RK} AS rk, {_CUM} AS cum, {_U} AS ua, {_U.replace("aps", "raps")} AS ur FROM sp WHERE n > 1),
  qk AS (SELECT detector, seed, alpha, min(rk) + 1 AS k_reg FROM (SELECT *, row_number() OVER (PARTITION BY detector, seed, alpha ORDER BY rk) AS i, count(*) OVER (PARTITION BY detector, seed, alpha) AS n FROM q0, lv WHERE tunes)
    WHERE i >= ceil(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (n + 1) * (1 - alpha) / n)) * (n - 1)) + 1 GROUP BY 1, 2, 3),
  qs AS (SELECT q0.*, alpha, k_reg, lam, cum + lam * greatest(rk + 1 - k_reg, 0) AS score FROM q0 JOIN qk USING (detector, seed), (SELECT unnest({list(LAMBDAS)}::DOUBLE[]) AS lam) WHERE tunes),
  qt AS (SELECT detector, seed, alpha, k_reg, lam, min(score) AS th FROM (SELECT *, row_number() OVER (PARTITION BY detector, seed, alpha, lam ORDER BY score) AS i, count(*) OVER (PARTITION BY detector, seed, alpha, lam) AS n FROM qs)
    WHERE i >= ceil(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (n + 1) * (1 - alpha) / n)) * (n - 1)) + 1 GROUP BY 1, 2, 3, 4, 5),
  qz AS (SELECT qs.detector, qs.seed, qs.alpha, qs.k_reg, qs.lam, p, CASE WHEN {_TOP} + qs.lam * greatest(1 - qs.k_reg, 0) >= th THEN {_TOP} ELSE least(p, 1 - p) END AS last FROM qs JOIN qt USING (detector, seed, alpha, k_reg, lam)),
  qm AS (SELECT detector, seed, alpha, k_reg, lam, avg((1 - p >= last)::INT + (p >= last)::INT) AS size FROM qz GROUP BY ALL),
  ql AS (SELECT detector, seed, alpha, k_reg, arg_min(lam, (size, lam)) AS lam FROM qm GROUP BY 1, 2, 3, 4),
  qc AS (SELECT q0.*, alpha, unnest(['lac', 'topk', 'aps', 'raps']) AS expert, unnest([1 - own, rk::DOUBLE, cum - ua * own, CASE WHEN tunes THEN NULL ELSE cum - ur * own + lam * greatest(rk + 1 - k_reg, 0) END]) AS score FROM q0 JOIN ql USING (detector, seed)),
  qh AS (SELECT detector, seed, alpha, expert, min(score) AS th FROM (SELECT *, row_number() OVER (PARTITION BY detector, seed, alpha, expert ORDER BY score) AS i, count(*) OVER (PARTITION BY detector, seed, alpha, expert) AS n FROM qc WHERE score IS NOT NULL)
    WHERE i >= ceil(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (n + 1) * (1 - alpha) / n)) * (n - 1)) + 1 GROUP BY 1, 2, 3, 4),
  qf AS (SELECT detector, seed, target_group, position, row_id, p, {_FORCED} AS y FROM tgt),
  qo AS (SELECT *, {_OWN} AS own, {_RK} AS rk, {_CUM} AS cum, {_U} AS ua, {_U.replace("aps", "raps")} AS ur FROM qf),
  qe AS (SELECT qo.*, alpha, k_reg, lam, unnest(['lac', 'topk', 'aps', 'raps']) AS expert, unnest([1 - own, rk::DOUBLE, cum - ua * own, cum - ur * own + lam * greatest(rk + 1 - k_reg, 0)]) AS own_score FROM qo JOIN ql USING (detector, seed)),
  qn AS (SELECT t.detector, t.seed, t.target_group, t.position, t.row_id, c.target_group AS cg, c.position AS cp, c.row_id AS cr, c.tunes,
    row_number() OVER (w ORDER BY abs(c.p - t.p), c.target_group, c.position, c.row_id) AS i, count(*) OVER w AS n,
    row_number() OVER (r ORDER BY abs(c.p - t.p), c.target_group, c.position, c.row_id) AS ir, count(*) OVER r AS nr FROM qo t JOIN q0 c USING (detector, seed)
    WINDOW w AS (PARTITION BY t.detector, t.seed, t.target_group, t.position, t.row_id), r AS (PARTITION BY t.detector, t.seed, t.target_group, t.position, t.row_id, c.tunes)),
  qp AS (SELECT qe.detector, qe.seed, qe.target_group, qe.position, qe.row_id, qe.alpha, qe.expert, avg((score >= own_score)::INT) AS p_value FROM qe JOIN qn USING (detector, seed, target_group, position, row_id)
    JOIN qc ON qc.detector = qe.detector AND qc.seed = qe.seed AND qc.alpha = qe.alpha AND qc.expert = qe.expert AND qc.target_group = cg AND qc.position = cp AND qc.row_id = cr
    WHERE CASE WHEN qe.expert = 'raps' THEN NOT qn.tunes AND ir <= CASE WHEN nr < 200 THEN nr ELSE floor(nr * 0.1) END ELSE i <= CASE WHEN n < 200 THEN n ELSE floor(n * 0.1) END END GROUP BY ALL),
  qy AS (SELECT qe.*, CASE expert WHEN 'lac' THEN 1 - th WHEN 'topk' THEN CASE WHEN th::INT >= 1 THEN least(p, 1 - p) ELSE {_TOP} END
    ELSE CASE WHEN {_TOP} + CASE WHEN expert = 'raps' THEN lam * greatest(1 - k_reg, 0) ELSE 0 END >= th THEN {_TOP} ELSE least(p, 1 - p) END END AS last FROM qe JOIN qh USING (detector, seed, alpha, expert)),
  qx AS (SELECT qy.*, 1 - p >= last AS in_safe, p >= last AS in_vulnerable, p_value FROM qy LEFT JOIN qp USING (detector, seed, target_group, position, row_id, alpha, expert)),
  ad AS (SELECT detector, seed, target_group, position, row_id, alpha, expert, in_safe, in_vulnerable FROM qx UNION ALL
    SELECT detector, seed, target_group, position, row_id, alpha, 'union', NOT ok OR y = 0, NOT ok OR y = 1 FROM
      (SELECT detector, seed, target_group, position, row_id, alpha, y, bool_and(in_safe <> in_vulnerable AND p_value > 1 - alpha) AS ok FROM qx GROUP BY ALL))"""
ORACLE = {
    "prom_scores": with_sql("ev", f"SELECT {_IDS}, round(1 - ({_OWN}), 10) AS lac, ({_RK})::DOUBLE AS topk, round({_APS}, 10) AS aps, round({_APS} + 0.1::DOUBLE * greatest({_RK} + 1 - 1, 0), 10) AS raps FROM ev"),
    "prom_quantile": with_sql("cal", f"WITH x AS (SELECT *, {_APS} AS score FROM cal), {_higher_sql('h', 'x', 'detector, seed')} SELECT detector, seed, round(threshold, 10) AS threshold FROM h"),
    "prom_rank_sets": with_sql("cal tgt", f"""WITH x AS (SELECT *, ({_RK})::DOUBLE AS score FROM cal), {_higher_sql('h', 'x', 'detector, seed')}, l AS (SELECT tgt.*, CASE WHEN threshold >= 1 THEN least(p, 1 - p) ELSE {_TOP} END AS last
        FROM tgt JOIN h USING (detector, seed)) SELECT {_IDS}, 1 - p >= last AS in_safe, p >= last AS in_vulnerable FROM l"""),
    "prom_cumulative_sets": with_sql("cal tgt", f"""WITH x AS (SELECT *, {_APS} AS score FROM cal), {_higher_sql('h', 'x', 'detector, seed')}, l AS (SELECT tgt.*, CASE WHEN {_TOP} >= threshold THEN {_TOP} ELSE least(p, 1 - p) END AS last
        FROM tgt JOIN h USING (detector, seed)) SELECT {_IDS}, 1 - p >= last AS in_safe, p >= last AS in_vulnerable FROM l"""),
    "prom_raps_split": with_sql("cal", f"WITH {_SPLIT} SELECT {_IDS}, tunes FROM sp"),
    "prom_raps_tune": with_sql("cal", f"""WITH {_SPLIT}, t AS (SELECT *, ({_RK})::DOUBLE AS score FROM sp WHERE tunes), {_higher_sql('k', 't', 'detector, seed')},
        l AS (SELECT t.* EXCLUDE (score), threshold::INT + 1 AS k_reg, lam FROM t JOIN k USING (detector, seed), (SELECT unnest({list(LAMBDAS)}::DOUBLE[]) AS lam)),
        x AS (SELECT *, {_CUM} - 0 + lam * greatest({_RK} + 1 - k_reg, 0) AS score FROM l), {_higher_sql('h', 'x', 'detector, seed, lam')},
        z AS (SELECT x.detector, x.seed, x.lam, k_reg, CASE WHEN {_TOP} + x.lam * greatest(1 - k_reg, 0) >= threshold THEN {_TOP} ELSE least(p, 1 - p) END AS last, p FROM x JOIN h ON h.detector = x.detector AND h.seed = x.seed AND h.lam = x.lam),
        m AS (SELECT detector, seed, lam, k_reg, avg((1 - p >= last)::INT + (p >= last)::INT) AS size FROM z GROUP BY 1, 2, 3, 4)
        SELECT detector, seed, k_reg, arg_min(lam, (size, lam)) AS lam FROM m GROUP BY 1, 2, 3"""),
    "prom_neighbor_count": with_sql("cal", "WITH c AS (SELECT detector, seed, count(*) AS n FROM cal GROUP BY 1, 2) SELECT *, CASE WHEN n < 200 THEN n ELSE floor(n * 0.1)::BIGINT END AS k FROM c"),
    "join_knn_1d": with_sql("cal tgt", f"WITH {_NEAR} SELECT detector, seed, target_group, position, distance, idx FROM nn"),
    "join_knn_window": with_sql("cal tgt", """WITH n AS (SELECT t.detector, t.target_group, t.seed, t.position, abs(c.p - t.p) AS d, row_number() OVER (w ORDER BY abs(c.p - t.p)) AS i, count(*) OVER w AS n
        FROM tgt t JOIN cal c USING (detector, seed) WINDOW w AS (PARTITION BY t.detector, t.target_group, t.seed, t.position)),
        k AS (SELECT *, CASE WHEN n < 200 THEN n ELSE floor(n * 0.1)::BIGINT END AS k FROM n),
        r AS (SELECT *, max(d) FILTER (i = k) OVER (PARTITION BY detector, target_group, seed, position) AS reach FROM k)
        SELECT detector, target_group, seed, position, k, reach, count(*) FILTER (d < reach - 1e-12) AS inside, count(*) FILTER (d <= reach + 1e-12 AND d >= reach - 1e-12) AS tied FROM r GROUP BY ALL"""),
    "prom_local_pvalue": with_sql("cal tgt", f"WITH {_NEAR} SELECT * FROM pv"),
    "prom_accept": with_sql("cal tgt", f"WITH {_NEAR} SELECT {_IDS}, (1 - p >= {_TOP})::INT + (p >= {_TOP})::INT = 1 AND p_value > 1 - 0.3::DOUBLE AS accepted FROM tgt JOIN pv USING (detector, seed, target_group, position)"),
    "prom_derived": with_sql("cal tgt bud", f"WITH {DERIVED_SQL} SELECT detector, target_group, seed, position, row_id, alpha, expert, in_safe, in_vulnerable FROM ad"),
}
