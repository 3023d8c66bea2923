"""Paired non-parametric statistics over groups, and summaries of metric rows.

Metric rows are aggregated over records first; what is gathered per comparison is one number per target group.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.operators import metrics as mt
from siftspark.operators.windows import holm
from siftspark.plans import relations as rel
from siftspark.plans.relations import CELL, PRIMARY, with_sql
from siftspark.runtime import stage

OUTCOMES = ["max_relative_violation", "vulnerable_violation", "safe_violation", "singleton_coverage", "review_load"]
#: The outcome of which more is better; of the others less is.
MORE_IS_BETTER = "singleton_coverage"
BASELINE = "unweighted_mondrian"
COMPARED = ["estimated_weight_no_gate_clip_20", "gated_ess_only_clip_20", "gated_infinity_only_clip_20", "gated_full_gate_clip_20", "pooled_split_conformal"]
REPLICATES, LEVEL, SEED = 10_000, 0.95, 20260814
#: Nested samples of the calibration rows.
FRACTIONS, REPETITIONS = (0.25, 0.5, 0.75, 1.0), 5
POINT = ["detector", "av", "asafe", "method"]
#: Differences are put on a grid that no decimal or binary fraction lies between, about 3e-9 wide: means that are equal
#: but for the order of their addition stay equal, and so do their differences.
GRID = 314159265.35


def hodges_lehmann(x: np.ndarray, direct: int = 2000) -> float:
    """The median of all pairwise means, each value also with itself.

    Up to ``direct`` values all means are made; beyond that the middle ones are selected without making the pairs.
    """
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if not n:
        return math.nan
    if n <= direct:
        i, j = np.triu_indices(n)
        return float(np.median((x[i] + x[j]) / 2))
    total = n * (n + 1) // 2
    first = _kth_mean(x, (total + 1) // 2)
    return first if total % 2 else (first + _kth_mean(x, total // 2 + 1)) / 2


def _kth_mean(x: np.ndarray, k: int) -> float:
    """The k-th least of the pairwise means of sorted values.

    The means of a value with those from itself on rise, so what is left of them is one stretch. The weighted median of the
    stretches' middles is a mean that leaves a quarter of the pairs on either side, so few rounds leave few pairs.
    """
    n = len(x)
    own = np.arange(n)
    lo, hi = own.copy(), np.full(n, n)

    def upto(v: float, same: bool) -> np.ndarray:
        """Per value where its means stop being below v, or at most v."""
        a, b = lo.copy(), hi.copy()
        while (left := a < b).any():
            mid = (a + b) // 2
            mean = (x + x[np.minimum(mid, n - 1)]) / 2
            inside = mean <= v if same else mean < v
            a, b = np.where(left & inside, mid + 1, a), np.where(left & ~inside, mid, b)
        return a

    while (size := hi - lo).sum() > 4 * n:
        some = np.flatnonzero(size)
        middle = (x[some] + x[(lo[some] + hi[some] - 1) // 2]) / 2
        order = np.argsort(middle)
        sizes = np.cumsum(size[some][order])
        v = float(middle[order[np.searchsorted(sizes, (sizes[-1] + 1) // 2)]])
        below, within = upto(v, False), upto(v, True)
        if (below - own).sum() >= k:
            hi = below
        elif (within - own).sum() >= k:
            return v
        else:
            lo = within
    j = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
    at = k - 1 - int((lo - own).sum())
    return float(np.partition((np.repeat(x, size) + x[j]) / 2, at)[at])


#: Draws of a resample that are held at a time.
DRAWS = 1 << 18


def resampled_medians(x: np.ndarray, rng: np.random.Generator, replicates: int) -> np.ndarray:
    """Medians of resamples of ``x``. Resamples are drawn as ranks, some at a time; only their middle ranks are selected."""
    values = np.sort(np.asarray(x, float))
    n = len(values)
    rank = np.empty(n, np.int32)
    rank[np.argsort(x, kind="stable")] = np.arange(n)
    middle = (n - 1) // 2
    step, parts = max(1, DRAWS // n), []
    for at in range(0, replicates, step):
        # Below 2^32 numbers of 32 bits are drawn from the same stream as those of 64.
        drawn = rank[rng.integers(0, n, size=(min(step, replicates - at), n), dtype=np.int32)]
        drawn.partition(middle, axis=1)
        upper = drawn[:, middle] if n % 2 else drawn[:, middle + 1 :].min(axis=1)
        parts.append((values[drawn[:, middle]] + values[upper]) / 2)
    return np.concatenate(parts)


def percentile_interval(samples: np.ndarray, level: float = LEVEL) -> tuple[float, float]:
    """Where the middle ``level`` of the samples begins and ends."""
    ends = np.quantile(samples, [0.5 - level / 2, 0.5 + level / 2])
    return float(ends[0]), float(ends[1])


def bootstrap_interval(seed: int, *samples: np.ndarray, replicates: int = REPLICATES) -> tuple[float, float]:
    """Interval of the median of a sample, or of the difference of two samples' medians, each resampled within itself with
    PCG64; NaN if a sample is empty."""
    if not all(len(x) for x in samples):
        return math.nan, math.nan
    if len(samples) == 1 and np.ptp(samples[0]) == 0:  # every resample is the same
        return float(samples[0][0]), float(samples[0][0])
    rng = np.random.default_rng(seed)
    first, *others = [resampled_medians(x, rng, replicates) for x in samples]
    return percentile_interval(first - others[0] if others else first)


#: Numbers of ranks and sums of ranks up to which the ways to reach each sum are counted one rank after the other.
FEW_RANKS, SMALL_SUM = 200, 20_000


def wilcoxon_exact(d: np.ndarray, least: int = 10) -> float:
    """Two-sided exact signed-rank p of the nonzero differences; NaN for fewer than ``least``.

    The statistic uses mid-ranks, the null distribution is the one without ties.
    """
    d = np.asarray(d, float)
    d = d[d != 0]
    n = len(d)
    if n < least:
        return math.nan
    a = np.abs(d)
    order = np.sort(a)
    mid = (np.searchsorted(order, a, "left") + np.searchsorted(order, a, "right") + 1) / 2
    plus = float(mid[d > 0].sum())
    top = n * (n + 1) // 2
    w = math.floor(min(plus, top - plus))
    at_most = _counted(n, w) if n <= FEW_RANKS or w <= SMALL_SUM else _inverted(n, w)
    return float(min(1.0, 2 * at_most))


def _counted(n: int, w: int) -> float:
    """The chance that ranks 1..n, each taken or not, sum to w at most: a distribution grows by one rank after the other."""
    ways = np.zeros(w + 1)
    ways[0] = 1.0
    for r in range(1, n + 1):
        if r <= w:
            ways[r:] = (ways[r:] + ways[:-r]) / 2
            ways[:r] /= 2
        else:
            ways /= 2
    return float(ways.sum())


def _inverted(n: int, w: int) -> float:
    """As ``_counted``, from the characteristic function of the sum, in time that grows with n only.

    Ranks are taken with chances tilted so that the mean of the sum is w; the tilt is a factor exp(K - lean x) of each
    sum's chance. So what is inverted lies around its own mean, and small chances keep their digits. Sums are looked at
    modulo a period of 32 standard deviations, 16 of them below w, and frequencies up to 12 of their inverse: what lies
    beyond either has a chance below the rounding. For w <= top / 2.
    """
    r = np.arange(1.0, n + 1)
    chance = lambda lean: (e := np.exp(lean * r)) / (1 + e)
    lo, hi = -1.0, 0.0
    while lo < (lean := (lo + hi) / 2) < hi:
        lo, hi = (lean, hi) if (r * chance(lean)).sum() < w else (lo, lean)
    lean = hi
    q = chance(lean)
    spread = math.sqrt((r * r * q * (1 - q)).sum())
    below = min(w, math.ceil(16 * spread))
    period = below + math.ceil(16 * spread)
    t = 2 * math.pi / period * np.arange(math.ceil(12 / spread * period / (2 * math.pi)) + 1)
    log_size, angle = np.empty(len(t)), np.empty(len(t))
    for i, f in enumerate(t):
        log_size[i] = np.log1p(-4 * q * (1 - q) * np.sin(r * f / 2) ** 2).sum() / 2
        angle[i] = (np.arctan2(q * np.sin(r * f), 1 - q + q * np.cos(r * f)) - q * r * f).sum() + f * ((q * r).sum() - w)
    z = lean + 1j * t
    stretch = np.full(len(t), below + 1.0, complex)
    np.divide(np.expm1(z * (below + 1)), np.expm1(z), out=stretch, where=z != 0)
    part = (np.exp(log_size + 1j * angle) * stretch).real
    scale = (np.log1p(np.exp(lean * r)) - math.log(2)).sum() - lean * w
    return float(math.exp(scale) * (part[0] + 2 * part[1:].sum()) / period)


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact binomial p; NaN without either."""
    n = wins + losses
    if not n:
        return math.nan
    k = min(wins, losses)
    tail = ways = 1
    for i in range(k):  # each coefficient from the one before
        ways = ways * (n - i) // (i + 1)
        tail += ways
    return min(1.0, 2 * tail / 2**n) if 2 * k != n else 1.0


def seed_means(m: DataFrame, names: list[str]) -> DataFrame:
    """Means over seeds of each group's metric rows."""
    return m.groupBy(*POINT, "target_group").agg(*[F.avg(c).alias(c) for c in names])


def paired(means: DataFrame, names: list[str]) -> DataFrame:
    """(detector, av, asafe, method, outcome, target_group, difference) against the baseline of the same group.

    Equal means added up in another order may differ in their last bits, which would break ties; see GRID.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("outcome"), F.col(c).alias("value")) for c in names]))
    long = means.select(*POINT, "target_group", stacked.alias("o")).select(*POINT, "target_group", "o.outcome", "o.value")
    base = long.where(F.col("method") == BASELINE).select("detector", "av", "asafe", "outcome", "target_group", F.col("value").alias("base"))
    other = long.where(F.col("method").isin(COMPARED))
    apart = F.col("value") - F.col("base")
    return other.join(base, ["detector", "av", "asafe", "outcome", "target_group"]).select(*POINT, "outcome", "target_group", (F.round(apart * GRID) / GRID).alias("difference"))


COMPARISON = (
    "detector string, av double, asafe double, method string, outcome string, groups long, nonzero long, median double, hodges_lehmann double, "
    "ci_lower double, ci_upper double, wins long, ties long, losses long, sign_p double, wilcoxon_p double"
)
#: Tasks that the comparisons are dealt to.
TASKS = 48


def compared(differences: DataFrame, run: Callable[[pd.DataFrame], list], columns: list[str]) -> DataFrame:
    """One row per detector, operating point, method and outcome, with what ``run`` gives for it in ``columns`` of
    COMPARISON. ``run`` gets the row of the comparison; in `x` it has the differences, in order of their target groups.

    A comparison is one row, so it costs Python one array, and the number of tasks doesn't shrink with the size of the data.
    """
    kind = {c.split()[0]: c for c in COMPARISON.split(", ")}
    names = [*POINT, "outcome", *columns]
    rows = differences.groupBy(*POINT, "outcome").agg(F.sort_array(F.collect_list(F.struct("target_group", "difference"))).alias("x"))
    rows = rows.withColumn("x", F.col("x")["difference"]).repartition(TASKS, *POINT, "outcome")

    def each(batches):
        for pdf in batches:
            yield pd.DataFrame([[r.detector, r.av, r.asafe, r.method, r.outcome, *run(r)] for r in pdf.itertuples()], columns=names)

    return rows.mapInPandas(each, ", ".join(kind[c] for c in names))


def _null(x: float):
    return None if x != x else x


def comparisons(differences: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """One row of paired statistics per detector, operating point, method and outcome, with Holm's adjustment.

    The interval's seed depends on the comparison's name, so rows don't depend on each other's order.
    """
    import zlib

    def run(r) -> list:
        d = r.x
        good, bad = (d > 0, d < 0) if r.outcome == MORE_IS_BETTER else (d < 0, d > 0)
        seed = SEED + zlib.crc32(f"{r.detector}|{r.av}|{r.asafe}|{r.method}|{r.outcome}".encode())
        lo, hi = bootstrap_interval(seed, d, replicates=replicates)
        wins, losses = int(good.sum()), int(bad.sum())
        return [len(d), int((d != 0).sum()), float(np.median(d)), hodges_lehmann(d), lo, hi, wins, int((d == 0).sum()), losses, _null(sign_test(wins, losses)), _null(wilcoxon_exact(d))]

    return with_holm(compared(differences, run, [c.split()[0] for c in COMPARISON.split(", ")][5:]))


def with_holm(done: DataFrame) -> DataFrame:
    """Adds `holm_p`, Holm's adjustment of `wilcoxon_p` over the methods."""
    done = stage(done, "comparisons")
    adjusted = holm(done, ["detector", "av", "asafe", "outcome"], "wilcoxon_p", ["method"]).select(*POINT, "outcome", F.col("adjusted").alias("holm_p"))
    return done.join(adjusted, [*POINT, "outcome"], "left")


def attained(m: DataFrame, by: list[str]) -> DataFrame:
    """Per method: groups, those within both budgets, and medians over groups."""
    return m.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"), F.count(F.when((F.col("vulnerable_violation") == 0) & (F.col("safe_violation") == 0), 1)).alias("attained"),
        *[F.round(F.median(c), 9).alias(f"median_{c}") for c in OUTCOMES],
    )


def _primary(c: str = "") -> Column:
    return (F.abs(F.col("av") - PRIMARY[0]) < 1e-12) & (F.abs(F.col("asafe") - PRIMARY[1]) < 1e-12)


def _m(s, d) -> DataFrame:
    return mt.fold_metrics(s, d)


def _differences(s, d) -> DataFrame:
    from siftspark.operators.conformal import clip_sets

    m = mt.with_targets(mt.triage(clip_sets(stage(rel.scored(s, d), "scored"), rel.CLIP), mt.KEYS))
    return paired(stage(seed_means(m, OUTCOMES), "means"), OUTCOMES)


def _centres(s, d) -> DataFrame:
    run = lambda r: [len(r.x), float(np.median(r.x)), hodges_lehmann(r.x)]
    c = compared(_differences(s, d), run, ["groups", "median", "hodges_lehmann"])
    return c.select(*POINT, "outcome", "groups", F.round("median", 9).alias("median"), F.round("hodges_lehmann", 9).alias("hodges_lehmann"))


def _gates(s, d) -> DataFrame:
    from siftspark.operators.conformal import _support, _weighted, gate_rules

    return gate_rules(_support(s, d), _weighted(s, d), CELL)


def _gate_status(s, d) -> DataFrame:
    """Over seeds: whether all pass, the share that does, the mean probability."""
    return _gates(s, d).groupBy("detector", "clip", "av", "asafe").agg(
        F.bool_and("full").alias("pass_all"), F.round(F.avg(F.col("full").cast("int")), 9).alias("pass_rate"), F.round(F.avg("probability"), 6).alias("probability"), F.countDistinct("seed").alias("seeds")
    )


def _support_summary(s, d) -> DataFrame:
    g = _gates(s, d).where("clip = 20").groupBy("detector", "av", "asafe").agg(F.bool_and("ess_only").alias("supported"))
    m = seed_means(_m(s, d).where("method = 'gated_ess_only_clip_20'"), ["singleton_coverage"]).join(g, ["detector", "av", "asafe"])
    return m.groupBy("av", "asafe").agg(
        F.count(F.lit(1)).alias("groups"), F.count(F.when(F.col("supported"), 1)).alias("supported"), F.round(F.median("singleton_coverage"), 9).alias("median_coverage"),
        F.round(F.median(F.when(F.col("supported"), F.col("singleton_coverage"))), 9).alias("median_supported"),
    )


def _delta_counts(s, d) -> DataFrame:
    from siftspark.operators.predicates import delta_class

    x = _differences(s, d).where((F.col("outcome") == "max_relative_violation") & _primary()).withColumn("c", delta_class(F.col("difference")))
    n = lambda k: F.count(F.when(F.col("c") == k, 1)).alias(k)
    return x.groupBy("detector", "method").agg(n("improved"), n("tied"), n("worse"), F.round(F.max("difference"), 9).alias("worst"))


def _detector_perf(s, d) -> DataFrame:
    """Means over seeds of each group's detector metrics."""
    t = rel.scored(s, d, "target")
    by = rel.GROUP
    m = mt.classification(mt.confusion(t, by), by).join(mt.average_precision(t, by, "p", "y"), by)
    names = ["pr_auc", "brier", "precision", "recall", "f1", "f2", "mcc"]
    return m.groupBy("detector", "target_group").agg(*[F.round(F.avg(c), 9).alias(c) for c in names])


def sensitivity(scored: DataFrame) -> DataFrame:
    """Metric rows of the plain, weighted and fully gated sets from nested samples of the calibration rows.

    (fraction, repetition, metrics.KEYS, metrics, passed) at the primary point and the selected clip, for four fractions
    and five repetitions of the sample; `passed` tells whether the gate let the cell's sets stand, null without a gate.
    """
    from functools import reduce

    from siftspark.operators.conformal import gate_rules, gated_sets, mondrian, mondrian_sets, support, weighted_sets
    from siftspark.operators.windows import nested_sample

    drawn = ["fraction", "repetition"]
    cell, points, clips = [*CELL, *drawn], [PRIMARY], (rel.CLIP,)
    whole, tgt = scored.where("side = 'calibration'"), scored.where("side = 'target'")
    tag = lambda df, f, r: df.withColumn("fraction", F.lit(f)).withColumn("repetition", F.lit(r))
    samples = [tag(nested_sample(whole, CELL, f, r, "nested-1"), f, r) for f in FRACTIONS for r in range(REPETITIONS)]
    cal = stage(reduce(DataFrame.unionByName, samples), "samples")
    grid = F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(r).alias("repetition")) for f in FRACTIONS for r in range(REPETITIONS)])
    tgt = tgt.withColumn("_s", F.explode(grid)).select(*tgt.columns, "_s.*")
    weighted = stage(weighted_sets(cal, tgt, cell, points, clips), "weighted")
    rules = stage(gate_rules(support(cal, tgt, scored, cell, clips), weighted, cell), "rules")
    full = f"gated_full_gate_clip_{rel.CLIP:.0f}"
    gated = gated_sets(weighted, rules, cell).where(F.col("method") == full)
    plain = mondrian_sets(tgt, mondrian(cal, cell), cell, points)
    m = mt.with_targets(mt.triage(plain.unionByName(weighted).unionByName(gated), [*drawn, *mt.KEYS]))
    passed = rules.select(*cell, F.lit(full).alias("method"), F.col("full").alias("passed"))
    return m.join(passed, [*cell, "method"], "left")


def _calibration_summary(s, d) -> DataFrame:
    """Attainment and median outcomes per fraction and method, means over seeds and repetitions being taken per group;
    for the gate the share of cells that pass and the groups of which all or any do."""
    m = stage(sensitivity(stage(rel.scored(s, d), "scored")), "sensitivity")
    by = ["detector", "fraction", "method"]
    out = attained(m.groupBy("fraction", *POINT, "target_group").agg(*[F.avg(c).alias(c) for c in OUTCOMES]), by)
    per = m.where("passed is not null").groupBy(*by, "target_group").agg(F.sum(F.col("passed").cast("int")).alias("k"), F.count(F.lit(1)).alias("n"))
    rates = per.groupBy(*by).agg(
        F.round(F.sum("k") / F.sum("n"), 9).alias("pass_rate"), F.count(F.when(F.col("k") == F.col("n"), 1)).alias("all_pass_groups"), F.count(F.when(F.col("k") > 0, 1)).alias("any_pass_groups")
    )
    return out.join(rates, by, "left")


def _neardup_summary(s, d) -> DataFrame:
    """The plain, weighted and fully gated methods on all target records and on those without a near-duplicate in the source."""
    from siftspark.operators.conformal import decisions
    from siftspark.operators.lsh import _flagged_targets

    e = stage(decisions(stage(rel.scored(s, d), "scored")).where(_primary() & F.col("method").isin(BASELINE, "estimated_weight_no_gate_clip_20", "gated_full_gate_clip_20")), "sets")
    kept = e.join(_flagged_targets(s, d).where("row_id is not null").select("row_id"), "row_id", "left_anti")
    both = e.withColumn("cohort", F.lit("all")).unionByName(kept.withColumn("cohort", F.lit("clean")))
    m = mt.with_targets(mt.triage(both, [*mt.KEYS, "cohort"])).groupBy("cohort", *POINT, "target_group").agg(*[F.avg(c).alias(c) for c in OUTCOMES])
    return attained(m, ["cohort", "detector", "method"])


def _severity(s, d) -> DataFrame:
    """(detector, target_group, severe, load): groups with a severe violation of the ungated sets, and what the gate sends to review."""
    m = stage(seed_means(_m(s, d).where(_primary() & F.col("method").isin("estimated_weight_no_gate_clip_20", "gated_full_gate_clip_20")), ["max_relative_violation", "review_load"]), "severity")
    raw = m.where("method = 'estimated_weight_no_gate_clip_20'").select("detector", "target_group", (F.col("max_relative_violation") > 0.5).cast("int").alias("severe"))
    return raw.join(m.where("method = 'gated_full_gate_clip_20'").select("detector", "target_group", F.col("review_load").alias("load")), ["detector", "target_group"])


def _discrimination(s, d) -> DataFrame:
    """How the share of passing seeds tells groups with a severe violation of the ungated sets, per detector."""
    j = _severity(s, d)
    a, p = mt.auroc(j, ["detector"], "load", "severe"), mt.average_precision(j, ["detector"], "load", "severe", "auprc")
    n = j.groupBy("detector").agg(F.count(F.lit(1)).alias("groups"), F.sum("severe").alias("severe"))
    return n.join(a, "detector").join(p, "detector").select("detector", "groups", "severe", F.round("auroc", 9).alias("auroc"), F.round("auprc", 9).alias("auprc"))


def _gate_summary(s, d) -> DataFrame:
    """Per detector and for all together: groups, prevalence of severe violations, of groups that pass in part and that don't,
    and how well the review load tells them."""
    j = _severity(s, d)
    j = stage(j.unionByName(j.withColumn("detector", F.lit("all"))), "cohorts")
    n = j.groupBy("detector").agg(
        F.count(F.lit(1)).alias("groups"), F.round(F.avg("severe"), 9).alias("prevalence"), F.count(F.when(F.col("load") < 1, 1)).alias("passed"), F.sum(F.when(F.col("load") < 1, F.col("severe")).otherwise(0)).alias("severe_passed")
    )
    return n.join(mt.auroc(j, ["detector"], "load", "severe"), "detector").withColumn("auroc", F.round("auroc", 9))


def _strata(s, d) -> DataFrame:
    """Per detector the interval of the difference in median violation between groups that the gate sends to review in
    part and those it sends there whole."""
    m = seed_means(_m(s, d).where(_primary() & F.col("method").isin("estimated_weight_no_gate_clip_20", "gated_full_gate_clip_20")), ["max_relative_violation", "review_load"])
    raw = m.where("method = 'estimated_weight_no_gate_clip_20'").select("detector", "target_group", F.col("max_relative_violation").alias("v"))
    g = m.where("method = 'gated_full_gate_clip_20'").select("detector", "target_group", (F.col("review_load") < 1).alias("passed"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("target_group")
        a, b = pdf.v[pdf.passed].to_numpy(), pdf.v[~pdf.passed].to_numpy()
        lo, hi = bootstrap_interval(SEED, a, b)
        return pd.DataFrame({"detector": [pdf.detector.iloc[0]], "passed": [len(a)], "failed": [len(b)], "ci_lower": [_null(lo)], "ci_upper": [_null(hi)]})

    return raw.join(g, ["detector", "target_group"]).groupBy("detector").applyInPandas(run, "detector string, passed long, failed long, ci_lower double, ci_upper double")


def _runtime(s, d) -> DataFrame:
    """Totals and quartiles of a duration, per kind."""
    e = s.read.parquet(f"{d}/events.parquet")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), q.alias("q"), F.min("value").alias("least"), F.max("value").alias("most"))
    return g.select("event_type", "n", "total", "least", "most", *[F.round(F.col("q")[i], 9).alias(k) for i, k in enumerate(("q25", "median", "q75"))])


def _executed(s, d) -> DataFrame:
    """The fits that ran: every seed of one detector, the first seed of each group of the other, whose seeds share a fit."""
    f = rel.predictions(s, d).groupBy(*rel.GROUP).agg(F.count(F.lit(1)).alias("n"))
    first = F.min("seed").over(Window.partitionBy("detector", "target_group"))
    return f.withColumn("first_seed", first).where("detector = 'hashing_sgd' or seed = first_seed").select(*rel.GROUP, "n")


def _median_intervals(s, d) -> DataFrame:
    """Medians over groups of each detector's mean score, with their intervals."""
    g = rel.predictions(s, d).groupBy("detector", "target_group").agg(F.avg("p").alias("p"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("target_group").p.to_numpy()
        lo, hi = bootstrap_interval(SEED, x)
        return pd.DataFrame({"detector": [pdf.detector.iloc[0]], "groups": [len(x)], "median": [float(np.median(x))], "ci_lower": [lo], "ci_upper": [hi]})

    return g.groupBy("detector").applyInPandas(run, "detector string, groups long, median double, ci_lower double, ci_upper double")


def signs(differences: DataFrame) -> DataFrame:
    """(detector, av, asafe, method, outcome, wins, losses, sign_p): counted in the JVM, so Python gets two numbers for each
    comparison."""
    more = F.col("outcome") == MORE_IS_BETTER
    up, down = F.count(F.when(F.col("difference") > 0, 1)), F.count(F.when(F.col("difference") < 0, 1))
    n = differences.groupBy(*POINT, "outcome").agg(up.alias("up"), down.alias("down"))
    n = n.select(*POINT, "outcome", F.when(more, F.col("up")).otherwise(F.col("down")).alias("wins"), F.when(more, F.col("down")).otherwise(F.col("up")).alias("losses"))
    kinds = [c for c in COMPARISON.split(", ") if c.split()[0] in (*POINT, "outcome", "wins", "losses", "sign_p")]

    def each(batches):
        for pdf in batches:
            yield pdf.assign(sign_p=[_null(sign_test(int(w), int(l))) for w, l in zip(pdf.wins, pdf.losses, strict=True)])

    return n.mapInPandas(each, ", ".join(kinds))


def _method_summary(s, d) -> DataFrame:
    return attained(seed_means(_m(s, d).where(_primary()), OUTCOMES), ["detector", "method"])


QUERIES = {
    "agg_detector_perf": _detector_perf,
    "agg_gate_status": _gate_status,
    "agg_support_summary_v1": _support_summary,
    "agg_method_summary": _method_summary,
    "agg_calibration_summary": _calibration_summary,
    "agg_neardup_summary": _neardup_summary,
    "agg_gate_summary": _gate_summary,
    "agg_delta_counts": _delta_counts,
    "agg_runtime_summary": _runtime,
    "agg_executed_fits": _executed,
    "stat_hodges_lehmann": _centres,
    "stat_bootstrap_median": _median_intervals,
    "stat_bootstrap_strata": _strata,
    "stat_wilcoxon_exact": lambda s, d: comparisons(_differences(s, d), 100).select(*POINT, "outcome", "nonzero", "wilcoxon_p"),
    "stat_sign_test": lambda s, d: signs(_differences(s, d)),
    "stat_holm": lambda s, d: with_holm(compared(_differences(s, d), lambda r: [_null(wilcoxon_exact(r.x))], ["wilcoxon_p"])),
    "stat_paired_comparisons": lambda s, d: comparisons(_differences(s, d)),
    "stat_gate_discrimination": _discrimination,
}

_PT = ", ".join(POINT)
_MEANS = f"sm AS (SELECT {_PT}, target_group, " + ", ".join(f"avg({c}) AS {c}" for c in OUTCOMES) + f" FROM mx GROUP BY {_PT}, target_group)"
_AGG = "count(*) AS groups, count(*) FILTER (vulnerable_violation = 0 AND safe_violation = 0) AS attained, " + ", ".join(f"round(median({c}), 9) AS median_{c}" for c in OUTCOMES)
_DIFF = f"""{_MEANS}, lo AS (UNPIVOT sm ON {', '.join(OUTCOMES)} INTO NAME outcome VALUE value),
  df AS (SELECT a.{_PT.replace(', ', ', a.')}, a.outcome, a.target_group, round((a.value - b.value) * {GRID}::DOUBLE) / {GRID}::DOUBLE AS difference FROM lo a JOIN lo b ON b.detector = a.detector AND b.av = a.av AND b.asafe = a.asafe AND b.outcome = a.outcome
    AND b.target_group = a.target_group WHERE b.method = '{BASELINE}' AND a.method IN ({', '.join(f"'{c}'" for c in COMPARED)}))"""
_PERF = """WITH c AS (SELECT detector, target_group, seed, count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p >= 0.5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (p < 0.5 AND y = 1)::DOUBLE AS fn,
    count(*) FILTER (p < 0.5 AND y = 0)::DOUBLE AS tn, avg(pow(p - y, 2)) AS brier FROM tgt GROUP BY 1, 2, 3),
  g AS (SELECT detector, target_group, seed, p, sum(y) AS pos, sum(1 - y) AS neg FROM tgt GROUP BY 1, 2, 3, 4),
  u AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY detector, target_group, seed) AS ap FROM g WINDOW w AS (PARTITION BY detector, target_group, seed ORDER BY p DESC)),
  a AS (SELECT detector, target_group, seed, coalesce(sum(pos / ap * tp / (tp + fp)) FILTER (ap > 0), 0) AS pr_auc FROM u GROUP BY 1, 2, 3)"""
_D = "CASE WHEN {1} > 0 THEN ({0}) / ({1}) ELSE 0 END"
_P = "av = 0.1 AND asafe = 0.2"
_RULES = "cal tgt bud ev"


def _rules_sql(query: str) -> str:
    from siftspark.operators.conformal import DECISIONS_SQL

    return with_sql(_RULES, f"WITH {DECISIONS_SQL}, {mt.triage_sql('de')}, {_MEANS} {query}")


_DISC = f"""WITH {{}}, j AS (SELECT a.detector, a.target_group, (a.max_relative_violation > 0.5)::INT AS severe, b.review_load AS load FROM sm a JOIN sm b ON a.detector = b.detector AND a.target_group = b.target_group
    AND a.av = b.av AND a.asafe = b.asafe WHERE a.av = 0.1 AND a.asafe = 0.2 AND a.method = 'estimated_weight_no_gate_clip_20' AND b.method = 'gated_full_gate_clip_20'),
  r AS (SELECT *, rank() OVER (PARTITION BY detector ORDER BY load) + (count(*) OVER (PARTITION BY detector, load) - 1) / 2 AS r FROM j),
  q AS (SELECT detector, count(*) AS groups, sum(severe)::BIGINT AS severe, (sum(r) FILTER (severe = 1) - sum(severe) * (sum(severe) + 1) / 2) / nullif(sum(severe) * sum(1 - severe), 0) AS auroc FROM r GROUP BY 1),
  g AS (SELECT detector, load, sum(severe) AS pos, sum(1 - severe) AS neg FROM j GROUP BY 1, 2),
  u AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY detector) AS ap FROM g WINDOW w AS (PARTITION BY detector ORDER BY load DESC)),
  p AS (SELECT detector, coalesce(sum(pos / ap * tp / (tp + fp)) FILTER (ap > 0), 0) AS auprc FROM u GROUP BY 1)
  SELECT detector, groups, severe, round(auroc, 9) AS auroc, round(auprc, 9) AS auprc FROM q JOIN p USING (detector)"""
#: Binomial coefficients in whole numbers, which keeps the p-values exact.
_BINOM = "bi AS (SELECT 0 AS n, 0 AS i, 1::HUGEINT AS c UNION ALL SELECT n + 1, i + step, sum(c)::HUGEINT FROM (SELECT n, i, c, unnest([0, 1]) AS step FROM bi WHERE n < 120) GROUP BY 1, 2)"
_KEY = f"{_PT}, outcome"
#: Ways to reach each sum of ranks; `wi` has the exact signed-rank p of each comparison, `ho` Holm's adjustment.
_WILCOXON = f"""{_DIFF}, ways AS (SELECT 0 AS r, 0 AS s, 1::HUGEINT AS c UNION ALL SELECT r + 1, s + step, sum(c)::HUGEINT FROM (SELECT r, s, c, unnest([0, r + 1]) AS step FROM ways WHERE r < 60) GROUP BY 1, 2),
  mr AS (SELECT *, rank() OVER (PARTITION BY {_KEY} ORDER BY abs(difference)) + (count(*) OVER (PARTITION BY {_KEY}, abs(difference)) - 1) / 2 AS mid FROM df WHERE difference <> 0),
  pl AS (SELECT {_KEY}, count(*) AS n, n * (n + 1) // 2 AS top, floor(least(coalesce(sum(mid) FILTER (difference > 0), 0), n * (n + 1) // 2 - coalesce(sum(mid) FILTER (difference > 0), 0))) AS w FROM mr GROUP BY ALL),
  nn AS (SELECT {_KEY}, count(*) FILTER (difference <> 0) AS nonzero FROM df GROUP BY ALL),
  wi AS (SELECT nn.*, CASE WHEN nonzero >= 10 THEN least(1, 2 * (SELECT sum(c) FROM ways WHERE r = n AND s <= w)::DOUBLE / pow(2, n)) END AS wilcoxon_p FROM nn LEFT JOIN pl USING ({_KEY})),
  hs AS (SELECT *, least(1, (count(*) OVER g - row_number() OVER o + 1) * wilcoxon_p) AS step FROM wi WHERE wilcoxon_p IS NOT NULL WINDOW g AS (PARTITION BY detector, av, asafe, outcome), o AS (PARTITION BY detector, av, asafe, outcome ORDER BY wilcoxon_p, method)),
  ho AS (SELECT wi.*, holm_p FROM wi LEFT JOIN (SELECT {_KEY}, max(step) OVER (PARTITION BY detector, av, asafe, outcome ORDER BY wilcoxon_p, method) AS holm_p FROM hs) USING ({_KEY}))"""
ORACLE = {
    "agg_detector_perf": with_sql("tgt", f"""{_PERF} SELECT detector, target_group, round(avg(pr_auc), 9) AS pr_auc, round(avg(brier), 9) AS brier, round(avg({_D.format('tp', 'tp + fp')}), 9) AS precision,
        round(avg({_D.format('tp', 'tp + fn')}), 9) AS recall, round(avg({_D.format('2 * tp', '2 * tp + fp + fn')}), 9) AS f1, round(avg({_D.format('5 * tp', '5 * tp + fp + 4 * fn')}), 9) AS f2,
        round(avg({_D.format('tp * tn - fp * fn', 'sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))')}), 9) AS mcc FROM c JOIN a USING (detector, target_group, seed) GROUP BY 1, 2"""),
    "agg_gate_status": _rules_sql("SELECT detector, clip, av, asafe, bool_and(full_ok) AS pass_all, round(avg(full_ok::INT), 9) AS pass_rate, round(avg(probability), 6) AS probability, count(DISTINCT seed) AS seeds FROM rg GROUP BY 1, 2, 3, 4"),
    "agg_support_summary_v1": _rules_sql("""SELECT av, asafe, count(*) AS groups, count(*) FILTER (ok) AS supported, round(median(singleton_coverage), 9) AS median_coverage, round(median(singleton_coverage) FILTER (ok), 9) AS median_supported
        FROM sm JOIN (SELECT detector, av, asafe, bool_and(ess_only) AS ok FROM rg WHERE clip = 20 GROUP BY 1, 2, 3) g USING (detector, av, asafe) WHERE method = 'gated_ess_only_clip_20' GROUP BY 1, 2"""),
    "agg_method_summary": _rules_sql(f"SELECT detector, method, {_AGG} FROM sm WHERE {_P} GROUP BY 1, 2"),
    "agg_delta_counts": mt.metrics_sql(f"""WITH {_DIFF} SELECT detector, method, count(*) FILTER (difference < -1e-15) AS improved, count(*) FILTER (abs(difference) <= 1e-15) AS tied, count(*) FILTER (difference > 1e-15) AS worse,
        round(max(difference), 9) AS worst FROM df WHERE outcome = 'max_relative_violation' AND {_P} GROUP BY 1, 2"""),
    "agg_gate_summary": "",
    "agg_runtime_summary": """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.25), 9) AS q25, round(median(value), 9) AS median,
        round(quantile_cont(value, 0.75), 9) AS q75 FROM events GROUP BY 1""",
    "agg_executed_fits": with_sql("prd", """WITH f AS (SELECT detector, target_group, seed, count(*) AS n FROM prd GROUP BY 1, 2, 3)
        SELECT * FROM f QUALIFY detector = 'hashing_sgd' OR seed = min(seed) OVER (PARTITION BY detector, target_group)"""),
    "stat_hodges_lehmann": mt.metrics_sql(f"""WITH {_DIFF}, n AS (SELECT *, row_number() OVER (PARTITION BY {_PT}, outcome ORDER BY target_group) AS i FROM df),
        h AS (SELECT {', '.join('a.' + c for c in POINT)}, a.outcome, median((a.difference + b.difference) / 2) AS h FROM n a JOIN n b USING ({_PT}, outcome) WHERE a.i <= b.i GROUP BY ALL),
        k AS (SELECT {_PT}, outcome, count(*) AS groups, median(difference) AS m FROM df GROUP BY ALL)
        SELECT {_PT}, outcome, groups, round(m, 9) AS median, round(h, 9) AS hodges_lehmann FROM k JOIN h USING ({_PT}, outcome)"""),
    "stat_sign_test": mt.metrics_sql(f"""WITH {_DIFF}, c AS (SELECT {_PT}, outcome, count(*) FILTER (difference > 0) AS up, count(*) FILTER (difference < 0) AS down FROM df GROUP BY ALL),
        w AS (SELECT {_PT}, outcome, CASE WHEN outcome = '{MORE_IS_BETTER}' THEN up ELSE down END AS wins, CASE WHEN outcome = '{MORE_IS_BETTER}' THEN down ELSE up END AS losses FROM c),
        {_BINOM}
        SELECT {_PT}, outcome, wins, losses, CASE WHEN wins + losses = 0 THEN NULL WHEN wins = losses THEN 1 ELSE least(1, 2 * (SELECT sum(c) FROM bi WHERE n = wins + losses AND i <= least(wins, losses))::DOUBLE / pow(2, wins + losses)) END AS sign_p
        FROM w""").replace("WITH ", "WITH RECURSIVE ", 1),
    "stat_wilcoxon_exact": mt.metrics_sql(f"WITH {_WILCOXON} SELECT {_KEY}, nonzero, wilcoxon_p FROM wi").replace("WITH ", "WITH RECURSIVE ", 1),
    "stat_holm": mt.metrics_sql(f"WITH {_WILCOXON} SELECT {_KEY}, wilcoxon_p, holm_p FROM ho").replace("WITH ", "WITH RECURSIVE ", 1),
}
ORACLE["stat_gate_discrimination"] = mt.metrics_sql(_DISC.format(_MEANS))
_ALL_TOO = f"{_MEANS}, j0 AS" + _DISC[_DISC.index(", j AS") + 6 : _DISC.index("  r AS")].rstrip().rstrip(",") + ", j AS (SELECT * FROM j0 UNION ALL SELECT 'all', * EXCLUDE (detector) FROM j0)"
ORACLE["agg_gate_summary"] = mt.metrics_sql(f"""WITH {_ALL_TOO}, r AS (SELECT *, rank() OVER (PARTITION BY detector ORDER BY load) + (count(*) OVER (PARTITION BY detector, load) - 1) / 2 AS r FROM j)
  SELECT detector, count(*) AS groups, round(avg(severe), 9) AS prevalence, count(*) FILTER (load < 1) AS passed, coalesce(sum(severe) FILTER (load < 1), 0)::BIGINT AS severe_passed,
    round((sum(r) FILTER (severe = 1) - sum(severe) * (sum(severe) + 1) / 2) / nullif(sum(severe) * sum(1 - severe), 0), 9) AS auroc FROM r GROUP BY 1""")


def _neardup_sql() -> str:
    from siftspark.operators.conformal import DECISIONS_SQL
    from siftspark.operators.lsh import _FLAG, TARGET

    few = f"SELECT * FROM de WHERE {_P} AND method IN ('{BASELINE}', 'estimated_weight_no_gate_clip_20', 'gated_full_gate_clip_20')"
    names = {"tr AS": "tr2 AS", "vi AS": "vi2 AS", "mx AS": "mx2 AS", "FROM tr)": "FROM tr2)", "FROM vi)": "FROM vi2)"}
    clean = mt.triage_sql("clean")
    for old, new in names.items():
        clean = clean.replace(old, new)
    return with_sql(_RULES, f"""WITH {DECISIONS_SQL}, {_FLAG}, few AS ({few}), flagged AS (SELECT row_id FROM mem WHERE dataset = '{TARGET}' AND row_id IS NOT NULL AND cid IN (SELECT target FROM f)),
      clean AS (SELECT * FROM few WHERE row_id NOT IN (SELECT row_id FROM flagged)), {mt.triage_sql('few')}, {clean},
      both_cohorts AS (SELECT 'all' AS cohort, * FROM mx UNION ALL SELECT 'clean', * FROM mx2),
      sm AS (SELECT cohort, {_PT}, target_group, {', '.join(f'avg({c}) AS {c}' for c in OUTCOMES)} FROM both_cohorts GROUP BY ALL)
      SELECT cohort, detector, method, {_AGG} FROM sm GROUP BY 1, 2, 3""")


ORACLE["agg_neardup_summary"] = _neardup_sql()
