"""Prediction sets from scores: plain, pooled and weighted conformal thresholds, matched acceptance, support rules, gates.

Scores are first collapsed: equal scores of a cell and class become one row with a count or a weight, so the sorted
windows hold as many rows as there are distinct scores, not as there are records. A cell without a class has no
threshold for it; the class is then in every set, which sends the record to review.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.operators.aggregates import kish_ess
from siftspark.operators.joins import first_at_least
from siftspark.operators.predicates import clip
from siftspark.operators.prom import DERIVED_SQL
from siftspark.operators.scalars import infinity_mass, sigmoid
from siftspark.operators.skew import ordered_sums, size_slot, unit_slot
from siftspark.operators.windows import accept_top
from siftspark.plans import relations as rel
from siftspark.plans.relations import BUDGETS, CELL, CLIPS, with_sql
from siftspark.runtime import stage

ALPHAS = {0: sorted({b for _, b in BUDGETS}), 1: sorted({a for a, _ in BUDGETS})}
#: Support rules (fixed values).
LEAST_TOTAL_ESS, LEAST_CLASS_ESS, ESS_OVER_ALPHA, LEAST_NEIGHBOURS = 200.0, 20.0, 2.0, 10
#: Logistic gate on eight standardised support features: name, coefficient, mean, scale (fixed values).
GATE = [
    ("log1p_total_ess", 0.37276606576532234, 8.692198699129445, 0.5151945494178599),
    ("log1p_safe_ess", 0.4731763726031704, 8.659136316520332, 0.5148117463360289),
    ("log1p_vulnerable_ess", -2.2115553431894797, 5.508302167891655, 0.5467046885972603),
    ("maximum_infinity_mass", 0.24325462400384681, 0.07601712983961416, 0.027642644724076095),
    ("p99_infinity_mass", 0.24325462400384681, 0.07601712983961416, 0.027642644724076095),
    ("domain_auroc", 0.7848706692362646, 0.9904203092355185, 0.005809703307868346),
    ("lower_clipping_fraction", 0.23714091663301134, 0.30177263056651155, 0.09395864471770828),
    ("upper_clipping_fraction", -1.2318486782946183, 0.0006624224601897667, 0.0014125568623459895),
]
INTERCEPT = -0.6609051367966677
#: The 25 methods of the evaluation.
METHODS = [
    "unweighted_mondrian", "pooled_split_conformal", "forced_argmax", "msp_matched_unweighted_mondrian", "entropy_matched_unweighted_mondrian",
    "temperature_msp_matched_unweighted_mondrian", "msp_matched_full_gate", "temperature_msp_matched_full_gate",
    *[f"prom_derived_{e}" for e in ("lac", "topk", "aps", "raps", "union")], *[f"estimated_weight_no_gate_clip_{c:.0f}" for c in CLIPS],
    *[f"gated_{m}_clip_{c:.0f}" for m in ("ess_only", "infinity_only", "full_gate") for c in CLIPS],
]
ROW = ["detector", "target_group", "seed", "position", "row_id", "y", "p"]


def score(p: Column, y: Column) -> Column:
    """One less the probability of the label."""
    return F.when(y == 1, 1 - p).otherwise(1 - (1 - p))


def higher_rank(level: Column, n: Column) -> Column:
    """1-based rank of the order statistic ceil(level n), within 1..n."""
    return F.greatest(F.lit(1), F.least(n, F.ceil(level * n)))


def finite_sample_level(n: Column, alpha: Column) -> Column:
    return F.least(F.lit(1.0), F.ceil((n + 1) * (1 - alpha)) / n)


def _steps(scored: DataFrame, by: list[str], size: Column) -> DataFrame:
    """Distinct scores per group with the size up to each and in all."""
    g = scored.groupBy(*by, "score").agg(size.alias("_n"))
    return ordered_sums(g, by, size_slot(F.col("score")), [F.col("score")], {"upto": F.col("_n")}, totals={"upto": "total"}).drop("_n")


def _alphas(y: Column, points: list[tuple[float, float]] = BUDGETS) -> Column:
    zero, one = (F.array(*map(F.lit, sorted({b[i] for b in points}))) for i in (1, 0))
    return F.when(y == 1, one).otherwise(zero)


def _row(cell: list[str]) -> list[str]:
    """A record's columns with those of the cell that aren't among them."""
    return [*ROW, *[c for c in cell if c not in ROW]]


def mondrian(cal: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, y, alpha, threshold): class-conditional thresholds for every level in use."""
    s = _steps(cal.withColumn("score", score(F.col("p"), F.col("y"))), [*cell, "y"], F.count(F.lit(1)))
    s = s.withColumn("alpha", F.explode(_alphas(F.col("y"))))
    k = higher_rank(finite_sample_level(F.col("total"), F.col("alpha")), F.col("total"))
    return s.where(F.col("upto") >= k).groupBy(*cell, "y", "alpha").agg(F.min("score").alias("threshold"))


def pooled(cal: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, alpha, threshold) over both classes; the rank is ceil(level (n - 1)) + 1."""
    s = _steps(cal.withColumn("score", score(F.col("p"), F.col("y"))), cell, F.count(F.lit(1)))
    levels = sorted({min(a, b) for a, b in BUDGETS})
    s = s.withColumn("alpha", F.explode(F.array(*map(F.lit, levels))))
    k = F.ceil(finite_sample_level(F.col("total"), F.col("alpha")) * (F.col("total") - 1)) + 1
    return s.where(F.col("upto") >= k).groupBy(*cell, "alpha").agg(F.min("score").alias("threshold"))


def _decided(df: DataFrame, method: Column | str, in_safe: Column, in_vulnerable: Column, cell: list[str] = CELL) -> DataFrame:
    m = F.lit(method) if isinstance(method, str) else method
    return df.select(*_row(cell), "av", "asafe", m.alias("method"), in_safe.alias("in_safe"), in_vulnerable.alias("in_vulnerable"))


def mondrian_sets(tgt: DataFrame, thresholds: DataFrame, cell: list[str], points: list[tuple[float, float]] = BUDGETS) -> DataFrame:
    t = rel.with_budgets(tgt.select(*_row(cell)), points)
    zero = thresholds.where("y = 0").select(*cell, F.col("alpha").alias("asafe"), F.col("threshold").alias("_t0"))
    one = thresholds.where("y = 1").select(*cell, F.col("alpha").alias("av"), F.col("threshold").alias("_t1"))
    j = t.join(zero, [*cell, "asafe"], "left").join(one, [*cell, "av"], "left")
    return _decided(j, "unweighted_mondrian", F.coalesce(1 - (1 - F.col("p")) <= F.col("_t0"), F.lit(True)), F.coalesce(1 - F.col("p") <= F.col("_t1"), F.lit(True)), cell)


def pooled_sets(tgt: DataFrame, thresholds: DataFrame, cell: list[str]) -> DataFrame:
    t = rel.with_budgets(tgt.select(*ROW)).withColumn("alpha", F.least("av", "asafe"))
    j = t.join(thresholds, [*cell, "alpha"], "left")
    return _decided(j, "pooled_split_conformal", F.coalesce(1 - (1 - F.col("p")) <= F.col("threshold"), F.lit(True)), F.coalesce(1 - F.col("p") <= F.col("threshold"), F.lit(True)))


def forced_sets(tgt: DataFrame) -> DataFrame:
    return _decided(rel.with_budgets(tgt.select(*ROW)), "forced_argmax", F.col("p") <= 0.5, F.col("p") > 0.5)


def _singletons(decided: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, av, asafe, _k): the records with one label."""
    return decided.groupBy(*cell, "av", "asafe").agg(F.count(F.when(F.col("in_safe") != F.col("in_vulnerable"), 1)).alias("_k"))


def _ranked(tgt: DataFrame, by: list[str], certainty: Column | None = None) -> DataFrame:
    """``tgt`` with `_r`, the rank by certainty: that of the most probable label unless told otherwise."""
    most = F.greatest("p", 1 - F.col("p")) if certainty is None else certainty
    order = [F.desc("_m"), F.col("target_group"), F.col("position")]
    return ordered_sums(tgt.withColumn("_m", most), by, unit_slot(F.col("_m"), down=True), order, {"_r": F.lit(1)}).drop("_m")


def _accepted(ranked: DataFrame, k: DataFrame, on: list[str], method: Column | str, cell: list[str]) -> DataFrame:
    """Singletons for the first ``_k`` of each group and operating point, both labels for the others."""
    t = ranked.join(k, on)
    inside = F.col("_r") <= F.col("_k")
    return _decided(t, method, ~inside | (F.col("p") <= 0.5), ~inside | (F.col("p") > 0.5), cell)


def matched_sets(tgt: DataFrame, decided: DataFrame, cell: list[str], method: str, certainty: Column | None = None) -> DataFrame:
    """As many singletons as ``decided`` has in each cell and operating point, for the most certain records: those with
    the most probable label unless ``certainty`` says otherwise."""
    return _accepted(_ranked(tgt, cell, certainty), _singletons(decided, cell), cell, method, cell)


def all_matched(cal: DataFrame, tgt: DataFrame, plain: DataFrame, full: DataFrame, cell: list[str]) -> DataFrame:
    """The five matched methods at once: records are ranked by plain and by temperature-scaled probability, and meet the
    counts of the sets matched, a few rows for each cell. With two classes entropy ranks as probability does."""
    from siftspark.operators.learning import temperatures

    inner = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("p")))
    scaled = sigmoid(F.log(inner / (1 - inner)) / F.col("temperature"))
    warm = tgt.join(temperatures(cal, cell).select(*cell, "temperature"), cell)
    two = warm.withColumn("_v", F.explode(F.array(F.struct(F.lit("plain").alias("scale"), F.col("p").alias("p")), F.struct(F.lit("warm").alias("scale"), scaled.alias("p")))))
    ranked = _ranked(two.select(*[c for c in _row(cell) if c != "p"], "_v.*"), [*cell, "scale"])
    of = [("plain", "msp"), ("plain", "entropy"), ("warm", "temperature_msp")]
    named = lambda df, name, rows: df.withColumn("_x", F.explode(F.array(*[F.struct(F.lit(v).alias("scale"), F.lit(f"{m}_matched_{name}").alias("method")) for v, m in rows]))).select(*cell, "av", "asafe", "_k", "_x.*")
    k = named(_singletons(plain, cell), "unweighted_mondrian", of).unionByName(named(_singletons(full, cell), "full_gate", [of[0], of[2]]))
    return _accepted(ranked, k, [*cell, "scale"], F.col("method"), cell)


def _clipped(df: DataFrame, clips: tuple[float, ...] = CLIPS) -> DataFrame:
    """Each row once per clip, with its clipped weight `w`."""
    options = F.array(*[F.struct(F.lit(c).alias("clip"), clip(F.col("ratio"), c).alias("w")) for c in clips])
    return df.withColumn("_c", F.explode(options)).select(*df.columns, "_c.clip", "_c.w")


def weighted_thresholds(cal: DataFrame, tgt: DataFrame, cell: list[str], points: list[tuple[float, float]] = BUDGETS, clips: tuple[float, ...] = CLIPS) -> DataFrame:
    """(row, clip, w, y-level thresholds): per record, clip, class and level the least score whose cumulative weight
    reaches level (mass + w); null where none does, which stands for infinity."""
    c = _clipped(cal.withColumn("score", score(F.col("p"), F.col("y"))), clips)
    steps = _steps(c, [*cell, "clip", "y"], F.sum("w"))
    mass = steps.select(*cell, "clip", F.col("y").alias("label"), "total").distinct()
    t = _clipped(tgt.select(*_row(cell), "ratio"), clips).drop("ratio")
    q = t.join(mass, [*cell, "clip"]).withColumn("alpha", F.explode(_alphas(F.col("label"), points)))
    q = q.withColumn("mass", (1 - F.col("alpha")) * (F.col("total") + F.col("w")))
    steps = steps.withColumnRenamed("y", "label")
    return first_at_least(steps.select(*cell, "clip", "label", "upto", "score"), q, [*cell, "clip", "label"], "upto", "score", "mass", size_slot).withColumnRenamed("score", "threshold")


def weighted_sets(cal: DataFrame, tgt: DataFrame, cell: list[str], points: list[tuple[float, float]] = BUDGETS, clips: tuple[float, ...] = CLIPS) -> DataFrame:
    th = weighted_thresholds(cal, tgt, cell, points, clips)
    own = F.when(F.col("label") == 1, 1 - F.col("p")).otherwise(1 - (1 - F.col("p")))
    inside = F.coalesce(own <= F.col("threshold"), F.lit(True))
    name = F.concat("label", F.lit("|"), F.col("alpha").cast("string"))
    per = th.groupBy(*_row(cell), "clip").agg(F.map_from_entries(F.collect_list(F.struct(name, inside))).alias("_m"))  # six entries a row
    b = rel.with_budgets(per, points)
    pick = lambda y, a: F.coalesce(F.col("_m")[F.concat(F.lit(f"{y}|"), F.col(a).cast("string"))], F.lit(True))
    method = F.concat(F.lit("estimated_weight_no_gate_clip_"), F.col("clip").cast("int").cast("string"))
    return _decided(b, method, pick(0, "asafe"), pick(1, "av"), cell)


def domain_auroc(scored: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, domain_auroc): how well the density ratio tells target from calibration rows, ties counting half."""
    from siftspark.operators.metrics import auroc

    return auroc(scored.withColumn("_hit", (F.col("side") == "target").cast("int")), cell, "ratio", "_hit", "domain_auroc")


def support(cal: DataFrame, tgt: DataFrame, scored: DataFrame, cell: list[str], clips: tuple[float, ...] = CLIPS) -> DataFrame:
    """Per cell and clip: effective sample sizes, class masses, infinity masses, clipping fractions and domain AUROC.

    The AUROC is that of ``scored`` by the cell's columns that it has: a sample of a cell takes the whole cell's.

    The fractions are those of weights that are clipped already, and so 0, as the published gate is applied.
    """
    c = _clipped(cal, clips)
    w = F.col("w")
    s = c.groupBy(*cell, "clip").agg(
        kish_ess(w).alias("ess"),
        *[kish_ess(F.when(F.col("y") == y, w)).alias(f"ess_{y}") for y in (0, 1)],
        *[F.coalesce(F.sum(F.when(F.col("y") == y, w)), F.lit(0.0)).alias(f"mass_{y}") for y in (0, 1)],
        *[F.count(F.when(F.col("y") == y, 1)).alias(f"n_{y}") for y in (0, 1)],
    )
    t = _clipped(tgt, clips).join(s.select(*cell, "clip", "mass_0", "mass_1"), [*cell, "clip"])
    m = {y: infinity_mass(F.col("w"), F.col(f"mass_{y}")) for y in (0, 1)}
    top = t.groupBy(*cell, "clip").agg(
        *[F.max(m[y]).alias(f"infinity_{y}") for y in (0, 1)],
        F.max(F.greatest(m[0], m[1])).alias("maximum_infinity_mass"),
        F.percentile(F.greatest(m[0], m[1]), F.lit(0.99)).alias("p99_infinity_mass"),
    )
    domain = [c for c in cell if c in scored.columns]
    out = s.join(top, [*cell, "clip"]).join(domain_auroc(scored, domain), domain, "left")
    return out.select(
        "*", F.log1p("ess").alias("log1p_total_ess"), F.log1p("ess_0").alias("log1p_safe_ess"), F.log1p("ess_1").alias("log1p_vulnerable_ess"),
        F.lit(0.0).alias("lower_clipping_fraction"), F.lit(0.0).alias("upper_clipping_fraction"),
    )


def gate_probability() -> Column:
    z = reduce(lambda a, b: a + b, [F.lit(k) * (F.col(n) - F.lit(m)) / F.lit(s) for n, k, m, s in GATE], F.lit(INTERCEPT))
    return sigmoid(z)


def gate_rules(supported: DataFrame, decided: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, clip, av, asafe, ess_only, infinity_only, full, probability): which rules let a cell's sets stand.

    Every rule needs a singleton in the cell; a probability that isn't a number fails.
    """
    need = lambda a: F.greatest(F.lit(LEAST_CLASS_ESS), F.ceil(ESS_OVER_ALPHA / F.col(a)))
    clip_of = F.regexp_extract("method", r"([0-9]+)\z", 1).cast("double").alias("clip")
    single = decided.groupBy(*cell, "av", "asafe", clip_of).agg(F.bool_or(F.col("in_safe") != F.col("in_vulnerable")).alias("single"))
    j = single.join(supported, [*cell, "clip"])
    ess = (F.col("ess") >= LEAST_TOTAL_ESS) & (F.col("ess_0") >= need("asafe")) & (F.col("ess_1") >= need("av"))
    infinity = (F.col("infinity_0") <= F.col("asafe")) & (F.col("infinity_1") <= F.col("av"))
    p = gate_probability()
    return j.select(
        *cell, "clip", "av", "asafe", (ess & F.col("single")).alias("ess_only"), (infinity & F.col("single")).alias("infinity_only"),
        F.coalesce((p < 0.5) & ~F.isnan(p) & F.col("single"), F.lit(False)).alias("full"), p.alias("probability"),
    )


def gated_sets(decided: DataFrame, rules: DataFrame, cell: list[str]) -> DataFrame:
    """The weighted sets under each rule: as they are where it passes, else both labels throughout the cell."""
    d = decided.withColumn("clip", F.regexp_extract("method", r"([0-9]+)\z", 1).cast("double"))
    j = d.join(rules, [*cell, "clip", "av", "asafe"])
    modes = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("ok")) for n, c in (("ess_only", "ess_only"), ("infinity_only", "infinity_only"), ("full_gate", "full"))])
    j = j.withColumn("_g", F.explode(modes))
    method = F.concat(F.lit("gated_"), F.col("_g.name"), F.lit("_clip_"), F.col("clip").cast("int").cast("string"))
    return j.select(*_row(cell), "av", "asafe", method.alias("method"), (~F.col("_g.ok") | F.col("in_safe")).alias("in_safe"), (~F.col("_g.ok") | F.col("in_vulnerable")).alias("in_vulnerable"))


def decisions(scored: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """The sets of all METHODS, one row per record, operating point and method.

    Those after temperature scaling carry the scaled probability; scaling keeps the order of records, so they accept what
    their plain counterparts do unless scaled values tie. What the adapter draws at random it draws from hashes here.
    """
    from siftspark.operators.prom import LEVELS, hashed_adapter

    cal, tgt = scored.where("side = 'calibration'"), scored.where("side = 'target'")
    plain = stage(mondrian_sets(tgt, mondrian(cal, cell), cell), "plain")
    weighted = stage(weighted_sets(cal, tgt, cell), "weighted")
    rules = gate_rules(support(cal, tgt, scored, cell), weighted, cell)
    gated = stage(gated_sets(weighted, rules, cell), "gated")
    full = gated.where("method = 'gated_full_gate_clip_20'")
    derived = rel.with_budgets(hashed_adapter(scored, cell, LEVELS)).where(F.col("alpha") == F.least("av", "asafe"))
    parts = [
        plain, pooled_sets(tgt, pooled(cal, cell), cell), forced_sets(tgt), all_matched(cal, tgt, plain, full, cell), weighted, gated,
        _decided(derived, F.concat(F.lit("prom_derived_"), "expert"), F.col("in_safe"), F.col("in_vulnerable"), cell),
    ]
    return reduce(DataFrame.unionByName, parts)


def clip_sets(scored: DataFrame, clip: float, cell: list[str] = CELL) -> DataFrame:
    """Of ``decisions`` the plain and pooled sets and the weighted and gated ones of one clip, without making the others."""
    cal, tgt = scored.where("side = 'calibration'"), scored.where("side = 'target'")
    weighted = stage(weighted_sets(cal, tgt, cell, clips=(clip,)), "weighted")
    rules = stage(gate_rules(support(cal, tgt, scored, cell, (clip,)), weighted, cell), "rules")
    parts = [mondrian_sets(tgt, mondrian(cal, cell), cell), pooled_sets(tgt, pooled(cal, cell), cell), weighted, gated_sets(weighted, rules, cell)]
    return reduce(DataFrame.unionByName, parts)


def credibility(cal: DataFrame, tgt: DataFrame, cell: list[str], counts: bool = False) -> DataFrame:
    """Label-conditional p-value of the forced label: (1 + calibration scores >= own) / (n + 1); or the two ``counts``."""
    c = cal.select(*cell, F.col("y").alias("label"), score(F.col("p"), F.col("y")).alias("score"))
    g = c.groupBy(*cell, "label", "score").agg(F.count(F.lit(1)).alias("_n"))
    steps = ordered_sums(g, [*cell, "label"], unit_slot(F.col("score"), down=True), [F.desc("score")], {"from_here": F.col("_n")}).select(*cell, "label", "score", "from_here")
    total = g.groupBy(*cell, "label").agg(F.sum("_n").alias("total"))
    forced = (F.col("p") > 0.5).cast("int")
    q = tgt.select(*ROW, forced.alias("label"), score(F.col("p"), forced).alias("own"))
    found = first_at_least(steps, q, [*cell, "label"], "score", "from_here", "own", unit_slot).join(total, [*cell, "label"], "left")
    n_above, n_scores = F.coalesce("from_here", F.lit(0)), F.coalesce("total", F.lit(0))
    if counts:
        return found.select(*ROW, "label", n_above.alias("n_above"), n_scores.alias("n_scores"))
    return found.select(*ROW, "label", F.round((n_above + 1) / (n_scores + 1), 10).alias("credibility"))


def _above(s, d) -> DataFrame:
    """Per record, the calibration scores of its forced label that are at least its own, and how many there are."""
    c = credibility(_e(s, d, "calibration"), _e(s, d, "target"), CELL, counts=True)
    return c.select("detector", "target_group", "seed", "position", "row_id", "label", F.col("n_above").cast("long").alias("n_above"), F.col("n_scores").cast("long").alias("n_scores"))


def support_v1(supported: DataFrame, decided: DataFrame, cell: list[str]) -> DataFrame:
    """The older conjunction: reasons against a cell's weighted sets at each operating point; none means supported."""
    need = lambda a: F.greatest(F.lit(LEAST_CLASS_ESS), F.ceil(ESS_OVER_ALPHA / F.col(a)))
    j = gate_rules(supported, decided, cell).join(supported, [*cell, "clip"])
    single = decided.groupBy(*cell, "av", "asafe", F.regexp_extract("method", r"([0-9]+)\z", 1).cast("double").alias("clip")).agg(F.bool_or(F.col("in_safe") != F.col("in_vulnerable")).alias("single"))
    j = j.join(single, [*cell, "clip", "av", "asafe"])
    tests = [
        ("total_ess", F.col("ess") < LEAST_TOTAL_ESS), ("class_0_ess", F.col("ess_0") < need("asafe")), ("class_1_ess", F.col("ess_1") < need("av")),
        ("class_0_neighbours", F.col("n_0") < LEAST_NEIGHBOURS), ("class_1_neighbours", F.col("n_1") < LEAST_NEIGHBOURS),
        ("infinity_mass", (F.col("infinity_0") > F.col("asafe")) | (F.col("infinity_1") > F.col("av"))), ("no_singleton", ~F.col("single")),
    ]
    reasons = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests]), lambda x: x.isNotNull())
    return j.select(*cell, "clip", "av", "asafe", reasons.alias("reasons"))


def _e(s, d, side=None) -> DataFrame:
    return rel.scored(s, d, side)


def _weighted(s, d) -> DataFrame:
    return weighted_sets(_e(s, d, "calibration"), _e(s, d, "target"), CELL)


def _support(s, d) -> DataFrame:
    return support(_e(s, d, "calibration"), _e(s, d, "target"), _e(s, d), CELL)


def _out(df: DataFrame) -> DataFrame:
    return df.drop("y", "p")


def _validate(s, d) -> DataFrame:
    """One row: scores, and those that aren't numbers, are outside 0..1 or don't add up to 1."""
    p = rel.predictions(s, d)
    return p.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.isnan("p"), 1)).alias("not_finite"), F.count(F.when((F.col("p") < 0) | (F.col("p") > 1), 1)).alias("outside"),
        F.count(F.when(F.abs(F.col("p") + (1 - F.col("p")) - 1) > 1e-6, 1)).alias("unbalanced"),
    )


def _higher(s, d) -> DataFrame:
    st = _steps(rel.predictions(s, d).withColumn("score", F.col("ratio")), CELL, F.count(F.lit(1)))
    st = st.withColumn("level", F.explode(F.array(*map(F.lit, (0.0, 0.1, 0.5, 0.9, 1.0)))))
    return st.where(F.col("upto") >= higher_rank(F.col("level"), F.col("total"))).groupBy(*CELL, "level").agg(F.min("score").alias("value"))


def _with_infinity(s, d) -> DataFrame:
    """Per record the calibration quantile at 0.9 with the record's own weight at infinity, or null."""
    c = _e(s, d, "calibration").withColumn("score", score(F.col("p"), F.col("y")))
    steps = _steps(c, CELL, F.sum("ratio"))
    q = _e(s, d, "target").select(*ROW, "ratio").join(steps.select(*CELL, "total").distinct(), CELL).withColumn("mass", F.lit(0.9) * (F.col("total") + F.col("ratio")))
    return first_at_least(steps.select(*CELL, "upto", "score"), q, CELL, "upto", "score", "mass", size_slot).select("detector", "target_group", "seed", "position", F.col("score").alias("threshold"))


def matched_to_both(scored: DataFrame, cell: list[str], name: str) -> DataFrame:
    """Matched sets at every operating point, with the singletons of the plain and of the fully gated sets; ``name`` is
    `msp` or `lac` (by credibility)."""
    cal, tgt = scored.where("side = 'calibration'"), scored.where("side = 'target'")
    plain = stage(mondrian_sets(tgt, mondrian(cal, cell), cell), "plain")
    weighted = stage(weighted_sets(cal, tgt, cell, clips=(rel.CLIP,)), "weighted")
    rules = gate_rules(support(cal, tgt, scored, cell, (rel.CLIP,)), weighted, cell)
    full = gated_sets(weighted, rules, cell).where(f"method = 'gated_full_gate_clip_{rel.CLIP:.0f}'")
    t, by = (stage(credibility(cal, tgt, cell), "credibility"), F.col("credibility")) if name == "lac" else (tgt, None)
    return matched_sets(t, plain, cell, f"{name}_matched_unweighted_mondrian", by).unionByName(matched_sets(t, full, cell, f"{name}_matched_full_gate", by))


def _matched(name: str):
    return lambda s, d: _out(matched_to_both(stage(_e(s, d), "scored"), CELL, name).withColumn("accepted", F.col("in_safe") != F.col("in_vulnerable")))


QUERIES = {
    "validate_probs": _validate,
    "conf_higher_quantile": _higher,
    "conf_mondrian_thresholds": lambda s, d: mondrian(_e(s, d, "calibration"), CELL),
    "conf_sets": lambda s, d: _out(mondrian_sets(_e(s, d, "target"), mondrian(_e(s, d, "calibration"), CELL), CELL)),
    "conf_weighted_quantile_inf": _with_infinity,
    "join_weighted_quantile": lambda s, d: weighted_thresholds(_e(s, d, "calibration"), _e(s, d, "target"), CELL).select("detector", "target_group", "seed", "position", "clip", "label", "alpha", "threshold"),
    "conf_weighted_sets": lambda s, d: _out(_weighted(s, d)),
    "conf_pooled_sets": lambda s, d: _out(pooled_sets(_e(s, d, "target"), pooled(_e(s, d, "calibration"), CELL), CELL)),
    "conf_forced_argmax": lambda s, d: _out(forced_sets(_e(s, d, "target"))),
    "conf_msp_matched": lambda s, d: _out(matched_sets(_e(s, d, "target"), mondrian_sets(_e(s, d, "target"), mondrian(_e(s, d, "calibration"), CELL), CELL), CELL, "msp_matched_unweighted_mondrian")),
    "conf_lac_credibility": lambda s, d: _out(credibility(_e(s, d, "calibration"), _e(s, d, "target"), CELL)),
    "join_credibility_rank": _above,
    "conf_lac_matched": lambda s, d: accept_top(credibility(_e(s, d, "calibration"), _e(s, d, "target"), CELL), CELL, F.col("credibility"), ["target_group", "position"], F.lit(5)).select("detector", "target_group", "seed", "position", "label", "accepted"),
    "conf_lac_matched_sets": _matched("lac"),
    "topk_matched_accept": _matched("msp"),
    "supp_ess_rule": lambda s, d: gate_rules(_support(s, d), _weighted(s, d), CELL).select(*CELL, "clip", "av", "asafe", "ess_only"),
    "supp_adjust_v1": lambda s, d: support_v1(_support(s, d), _weighted(s, d), CELL),
    "supp_features": lambda s, d: _support(s, d).select(*CELL, "clip", *[F.round(n, 6).alias(n) for n, *_ in GATE]),
    "supp_gate": lambda s, d: gate_rules(_support(s, d), _weighted(s, d), CELL).withColumn("probability", F.round("probability", 6)),
    "eval_fold": lambda s, d: _out(decisions(stage(_e(s, d), "scored"))),
}

# The same in SQL: cu are the collapsed scores of a cell and class, mt the thresholds, md and the others the sets.
_R = "detector, target_group, seed, position, row_id, y, p"
_AL = "al AS (SELECT * FROM (VALUES " + ", ".join(f"({y}, {a}::DOUBLE)" for y, v in ALPHAS.items() for a in v) + ") t(y, alpha))"
_CL = "cl AS (SELECT * FROM (VALUES " + ", ".join(f"({c}::DOUBLE)" for c in CLIPS) + ") t(clip))"
_LEVEL = "least(1.0::DOUBLE, ceil((total + 1) * (1 - alpha)) / total)"
_S = "CASE WHEN y = 1 THEN 1 - p ELSE 1 - (1 - p) END"
MONDRIAN_SQL = f"""{_AL}, sc AS (SELECT *, {_S} AS score FROM cal),
  cu AS (SELECT detector, seed, y, score, sum(count(*)) OVER (PARTITION BY detector, seed, y ORDER BY score) AS upto, sum(count(*)) OVER (PARTITION BY detector, seed, y) AS total FROM sc GROUP BY 1, 2, 3, 4),
  mt AS (SELECT detector, seed, y, alpha, min(score) AS threshold FROM cu JOIN al USING (y) WHERE upto >= greatest(1, least(total, ceil({_LEVEL} * total))) GROUP BY 1, 2, 3, 4),
  tb AS (SELECT {_R}, ratio, av, asafe FROM tgt, bud),
  md AS (SELECT tb.*, 'unweighted_mondrian' AS method, coalesce(1 - (1 - p) <= m0.threshold, true) AS in_safe, coalesce(1 - p <= m1.threshold, true) AS in_vulnerable FROM tb
    LEFT JOIN mt m0 ON m0.detector = tb.detector AND m0.seed = tb.seed AND m0.y = 0 AND m0.alpha = asafe LEFT JOIN mt m1 ON m1.detector = tb.detector AND m1.seed = tb.seed AND m1.y = 1 AND m1.alpha = av)"""
POOLED_SQL = """pu AS (SELECT detector, seed, score, sum(count(*)) OVER (PARTITION BY detector, seed ORDER BY score) AS upto, sum(count(*)) OVER (PARTITION BY detector, seed) AS total FROM sc GROUP BY 1, 2, 3),
  pt AS (SELECT detector, seed, alpha, min(score) AS threshold FROM pu, (SELECT DISTINCT least(av, asafe) AS alpha FROM bud) a
    WHERE upto >= ceil(least(1.0::DOUBLE, ceil((total + 1) * (1 - alpha)) / total) * (total - 1)) + 1 GROUP BY 1, 2, 3),
  po AS (SELECT tb.*, 'pooled_split_conformal' AS method, coalesce(1 - (1 - p) <= threshold, true) AS in_safe, coalesce(1 - p <= threshold, true) AS in_vulnerable FROM tb
    LEFT JOIN pt ON pt.detector = tb.detector AND pt.seed = tb.seed AND alpha = least(av, asafe)),
  fo AS (SELECT *, 'forced_argmax' AS method, p <= 0.5 AS in_safe, p > 0.5 AS in_vulnerable FROM tb)"""


def matched_sql(name: str, of: str, method: str) -> str:
    return f"""{name} AS (SELECT r.* EXCLUDE (i, k), '{method}' AS method, i > k OR p <= 0.5 AS in_safe, i > k OR p > 0.5 AS in_vulnerable FROM
      (SELECT tb.*, row_number() OVER (PARTITION BY tb.detector, tb.seed, tb.av, tb.asafe ORDER BY greatest(p, 1 - p) DESC, target_group, position) AS i, k FROM tb
       JOIN (SELECT detector, seed, av, asafe, count(*) FILTER (in_safe <> in_vulnerable) AS k FROM {of} GROUP BY 1, 2, 3, 4) USING (detector, seed, av, asafe)) r)"""


WEIGHTED_SQL = f"""{_CL}, cw AS (SELECT sc.*, clip, greatest(1 / clip, least(clip, ratio)) AS w FROM sc, cl),
  ws AS (SELECT detector, seed, clip, y, score, sum(sum(w)) OVER (PARTITION BY detector, seed, clip, y ORDER BY score) AS upto, sum(sum(w)) OVER (PARTITION BY detector, seed, clip, y) AS total FROM cw GROUP BY 1, 2, 3, 4, 5),
  ms AS (SELECT DISTINCT detector, seed, clip, y AS label, total FROM ws),
  tw AS (SELECT {_R}, clip, greatest(1 / clip, least(clip, ratio)) AS w FROM tgt, cl),
  qu AS (SELECT tw.*, label, alpha, (1 - alpha) * (total + w) AS mass FROM tw JOIN ms USING (detector, seed, clip) JOIN al ON al.y = label),
  th AS (SELECT qu.*, (SELECT min(score) FROM ws WHERE ws.detector = qu.detector AND ws.seed = qu.seed AND ws.clip = qu.clip AND ws.y = qu.label AND ws.upto >= qu.mass) AS threshold FROM qu),
  ti AS (SELECT *, coalesce(CASE WHEN label = 1 THEN 1 - p ELSE 1 - (1 - p) END <= threshold, true) AS inside FROM th),
  we AS (SELECT tb.*, 'estimated_weight_no_gate_clip_' || clip::INT AS method, coalesce(max(inside) FILTER (label = 0 AND alpha = asafe), true) AS in_safe, coalesce(max(inside) FILTER (label = 1 AND alpha = av), true) AS in_vulnerable
    FROM tb JOIN ti USING ({_R}) GROUP BY tb.*, {_R}, ratio, av, asafe, clip)"""
WEIGHTED_SQL = WEIGHTED_SQL.replace("SELECT tb.*, 'estimated", f"SELECT {_R}, ratio, av, asafe, 'estimated").replace("GROUP BY tb.*, ", "GROUP BY ")
_KISH = "CASE WHEN sum({0} * {0}) > 0 THEN pow(sum({0}), 2) / sum({0} * {0}) ELSE 0 END"
_GATE = " + ".join([str(INTERCEPT), *[f"({k}) * ({n} - ({m})) / {s}" for n, k, m, s in GATE]])
SUPPORT_SQL = f"""su AS (SELECT detector, seed, clip, {_KISH.format('w')} AS ess, {_KISH.format('CASE WHEN y = 0 THEN w END')} AS ess_0, {_KISH.format('CASE WHEN y = 1 THEN w END')} AS ess_1,
    coalesce(sum(w) FILTER (y = 0), 0) AS mass_0, coalesce(sum(w) FILTER (y = 1), 0) AS mass_1, count(*) FILTER (y = 0) AS n_0, count(*) FILTER (y = 1) AS n_1 FROM cw GROUP BY 1, 2, 3),
  im AS (SELECT detector, seed, clip, max(w / (mass_0 + w)) AS infinity_0, max(w / (mass_1 + w)) AS infinity_1, max(greatest(w / (mass_0 + w), w / (mass_1 + w))) AS maximum_infinity_mass,
    quantile_cont(greatest(w / (mass_0 + w), w / (mass_1 + w)), 0.99) AS p99_infinity_mass FROM tw JOIN su USING (detector, seed, clip) GROUP BY 1, 2, 3),
  dr AS (SELECT detector, seed, side, rank() OVER (PARTITION BY detector, seed ORDER BY ratio) + (count(*) OVER (PARTITION BY detector, seed, ratio) - 1) / 2 AS r FROM ev),
  da AS (SELECT detector, seed, count(*) FILTER (side = 'target') AS np, count(*) FILTER (side <> 'target') AS nn, sum(r) FILTER (side = 'target') AS sr FROM dr GROUP BY 1, 2),
  sf AS (SELECT *, ln(1 + ess) AS log1p_total_ess, ln(1 + ess_0) AS log1p_safe_ess, ln(1 + ess_1) AS log1p_vulnerable_ess, 0.0::DOUBLE AS lower_clipping_fraction, 0.0::DOUBLE AS upper_clipping_fraction,
    (sr - np * (np + 1) / 2) / (np * nn) AS domain_auroc FROM su JOIN im USING (detector, seed, clip) JOIN da USING (detector, seed)),
  si AS (SELECT detector, seed, av, asafe, regexp_extract(method, '([0-9]+)$', 1)::DOUBLE AS clip, bool_or(in_safe <> in_vulnerable) AS single FROM we GROUP BY 1, 2, 3, 4, 5),
  ru AS (SELECT si.*, ess >= {LEAST_TOTAL_ESS} AND ess_0 >= greatest({LEAST_CLASS_ESS}, ceil({ESS_OVER_ALPHA} / asafe)) AND ess_1 >= greatest({LEAST_CLASS_ESS}, ceil({ESS_OVER_ALPHA} / av)) AND single AS ess_only,
    infinity_0 <= asafe AND infinity_1 <= av AND single AS infinity_only, 1 / (1 + exp(-({_GATE}))) AS probability, sf.* EXCLUDE (detector, seed, clip) FROM si JOIN sf USING (detector, seed, clip)),
  rg AS (SELECT *, probability < 0.5 AND single AS full_ok FROM ru),
  ga AS (SELECT {", ".join("we." + c.strip() for c in _R.split(","))}, we.ratio, we.av, we.asafe, 'gated_' || mode || '_clip_' || clip::INT AS method, NOT ok OR in_safe AS in_safe, NOT ok OR in_vulnerable AS in_vulnerable
    FROM we JOIN (SELECT detector, seed, clip, av, asafe, unnest(['ess_only', 'infinity_only', 'full_gate']) AS mode, unnest([ess_only, infinity_only, full_ok]) AS ok FROM rg) g
    ON g.detector = we.detector AND g.seed = we.seed AND g.av = we.av AND g.asafe = we.asafe AND g.clip = regexp_extract(method, '([0-9]+)$', 1)::DOUBLE)"""
def _warm_sql(of: str, method: str) -> str:
    return f"(SELECT * REPLACE ('{method}' AS method) FROM {of})"


_ALL = ["md", "po", "fo", "mm", "me", "we", "ga", "mg", _warm_sql("mm", "temperature_msp_matched_unweighted_mondrian"), _warm_sql("mg", "temperature_msp_matched_full_gate"), "pd"]
DECISIONS_SQL = ", ".join(
    [MONDRIAN_SQL, POOLED_SQL, matched_sql("mm", "md", "msp_matched_unweighted_mondrian"), matched_sql("me", "md", "entropy_matched_unweighted_mondrian"), WEIGHTED_SQL, SUPPORT_SQL,
     matched_sql("mg", "(SELECT * FROM ga WHERE method = 'gated_full_gate_clip_20')", "msp_matched_full_gate"),
     DERIVED_SQL, "pd AS (SELECT ad.*, tgt.y, tgt.p, av, asafe, 'prom_derived_' || expert AS method FROM ad JOIN bud ON alpha = least(av, asafe) JOIN tgt USING (detector, seed, target_group, position, row_id))",
     "de AS (" + " UNION ALL ".join(f"SELECT {_R}, av, asafe, method, in_safe, in_vulnerable FROM {n}" for n in _ALL) + ")"]
)
def _lac_sql(of: str, method: str) -> str:
    return f"""SELECT detector, target_group, seed, position, row_id, av, asafe, '{method}' AS method, i > k OR p <= 0.5 AS in_safe, i > k OR p > 0.5 AS in_vulnerable FROM
      (SELECT tb.*, row_number() OVER (PARTITION BY tb.detector, tb.seed, tb.av, tb.asafe ORDER BY credibility DESC, tb.target_group, tb.position) AS i, k FROM tb JOIN cr USING (detector, target_group, seed, position, row_id)
       JOIN (SELECT detector, seed, av, asafe, count(*) FILTER (in_safe <> in_vulnerable) AS k FROM {of} GROUP BY 1, 2, 3, 4) USING (detector, seed, av, asafe))"""


_OUT = "detector, target_group, seed, position, row_id, av, asafe, method, in_safe, in_vulnerable"
_NEED = "cal tgt bud ev"
_CRED = f"""WITH {MONDRIAN_SQL}, f AS (SELECT *, (p > 0.5)::INT AS label FROM tgt), o AS (SELECT *, CASE WHEN label = 1 THEN 1 - p ELSE 1 - (1 - p) END AS own FROM f),
  cr AS (SELECT detector, target_group, seed, position, row_id, label, round(((SELECT count(*) FROM sc WHERE sc.detector = o.detector AND sc.seed = o.seed AND sc.y = label AND score >= own) + 1)
    / ((SELECT count(*) FROM sc WHERE sc.detector = o.detector AND sc.seed = o.seed AND sc.y = label) + 1), 10) AS credibility FROM o)"""
ORACLE = {
    "validate_probs": with_sql("prd", "SELECT count(*) AS n, count(*) FILTER (isnan(p)) AS not_finite, count(*) FILTER (p < 0 OR p > 1) AS outside, count(*) FILTER (abs(p + (1 - p) - 1) > 1e-6) AS unbalanced FROM prd"),
    "conf_higher_quantile": with_sql("prd", """WITH r AS (SELECT detector, seed, ratio, row_number() OVER (PARTITION BY detector, seed ORDER BY ratio) AS i, count(*) OVER (PARTITION BY detector, seed) AS n FROM prd),
        l AS (SELECT unnest([0.0, 0.1, 0.5, 0.9, 1.0]::DOUBLE[]) AS level) SELECT detector, seed, level, ratio AS value FROM r, l WHERE i = greatest(1, least(n, ceil(level * n)))"""),
    "conf_mondrian_thresholds": with_sql(_NEED, f"WITH {MONDRIAN_SQL} SELECT detector, seed, y, alpha, threshold FROM mt"),
    "conf_sets": with_sql(_NEED, f"WITH {MONDRIAN_SQL} SELECT {_OUT} FROM md"),
    "conf_weighted_quantile_inf": with_sql(_NEED, f"""WITH sc AS (SELECT *, {_S} AS score FROM cal), s AS (SELECT detector, seed, score, sum(sum(ratio)) OVER (PARTITION BY detector, seed ORDER BY score) AS upto,
        sum(sum(ratio)) OVER (PARTITION BY detector, seed) AS total FROM sc GROUP BY 1, 2, 3), m AS (SELECT DISTINCT detector, seed, total FROM s)
        SELECT tgt.detector, target_group, tgt.seed, position, (SELECT min(score) FROM s WHERE s.detector = tgt.detector AND s.seed = tgt.seed AND upto >= 0.9::DOUBLE * (m.total + ratio)) AS threshold
        FROM tgt JOIN m ON m.detector = tgt.detector AND m.seed = tgt.seed"""),
    "join_weighted_quantile": with_sql(_NEED, f"WITH {MONDRIAN_SQL}, {WEIGHTED_SQL} SELECT detector, target_group, seed, position, clip, label, alpha, threshold FROM th"),
    "conf_weighted_sets": with_sql(_NEED, f"WITH {MONDRIAN_SQL}, {WEIGHTED_SQL} SELECT {_OUT} FROM we"),
    "conf_pooled_sets": with_sql(_NEED, f"WITH {MONDRIAN_SQL}, {POOLED_SQL} SELECT {_OUT} FROM po"),
    "conf_forced_argmax": with_sql(_NEED, f"WITH {MONDRIAN_SQL}, {POOLED_SQL} SELECT {_OUT} FROM fo"),
    "conf_msp_matched": with_sql(_NEED, f"WITH {MONDRIAN_SQL}, {matched_sql('mm', 'md', 'msp_matched_unweighted_mondrian')} SELECT {_OUT} FROM mm"),
    "conf_lac_credibility": with_sql(_NEED, f"{_CRED} SELECT * FROM cr"),
    "join_credibility_rank": with_sql(_NEED, f"""{_CRED} SELECT o.detector, o.target_group, o.seed, o.position, o.row_id, label, count(*) FILTER (sc.score >= own) AS n_above, count(sc.score) AS n_scores
        FROM o LEFT JOIN sc ON sc.detector = o.detector AND sc.seed = o.seed AND sc.y = label GROUP BY ALL"""),
    "conf_lac_matched": with_sql(_NEED, f"""{_CRED} SELECT detector, target_group, seed, position, label,
        row_number() OVER (PARTITION BY detector, seed ORDER BY credibility DESC, target_group, position) <= 5 AS accepted FROM cr"""),
    "topk_matched_accept": with_sql(_NEED, f"WITH {DECISIONS_SQL} SELECT {_OUT}, in_safe <> in_vulnerable AS accepted FROM mm UNION ALL SELECT {_OUT}, in_safe <> in_vulnerable FROM mg"),
    "conf_lac_matched_sets": with_sql(_NEED, f"""WITH {DECISIONS_SQL}, {_CRED.removeprefix(f'WITH {MONDRIAN_SQL}, ')}, lm AS ({_lac_sql('md', 'lac_matched_unweighted_mondrian')} UNION ALL
        {_lac_sql("(SELECT * FROM ga WHERE method = 'gated_full_gate_clip_20')", 'lac_matched_full_gate')}) SELECT {_OUT}, in_safe <> in_vulnerable AS accepted FROM lm"""),
    "supp_ess_rule": with_sql(_NEED, f"WITH {DECISIONS_SQL} SELECT detector, seed, clip, av, asafe, ess_only FROM rg"),
    "supp_adjust_v1": with_sql(_NEED, f"""WITH {DECISIONS_SQL} SELECT detector, seed, clip, av, asafe, list_filter([
        CASE WHEN ess < {LEAST_TOTAL_ESS} THEN 'total_ess' END, CASE WHEN ess_0 < greatest({LEAST_CLASS_ESS}, ceil({ESS_OVER_ALPHA} / asafe)) THEN 'class_0_ess' END,
        CASE WHEN ess_1 < greatest({LEAST_CLASS_ESS}, ceil({ESS_OVER_ALPHA} / av)) THEN 'class_1_ess' END, CASE WHEN n_0 < {LEAST_NEIGHBOURS} THEN 'class_0_neighbours' END,
        CASE WHEN n_1 < {LEAST_NEIGHBOURS} THEN 'class_1_neighbours' END, CASE WHEN infinity_0 > asafe OR infinity_1 > av THEN 'infinity_mass' END,
        CASE WHEN NOT single THEN 'no_singleton' END], lambda x: x IS NOT NULL) AS reasons FROM rg"""),
    "supp_features": with_sql(_NEED, f"WITH {DECISIONS_SQL} SELECT detector, seed, clip, {', '.join(f'round({n}, 6) AS {n}' for n, *_ in GATE)} FROM sf"),
    "supp_gate": with_sql(_NEED, f"WITH {DECISIONS_SQL} SELECT detector, seed, clip, av, asafe, ess_only, infinity_only, full_ok AS \"full\", round(probability, 6) AS probability FROM rg"),
    "eval_fold": with_sql(_NEED, f"WITH {DECISIONS_SQL} SELECT {_OUT} FROM de"),
}
