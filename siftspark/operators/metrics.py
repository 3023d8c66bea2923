"""Ranking, calibration and set-valued metrics of scored records.

Ranking metrics work on the table of distinct scores with their counts of either class, not on the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.operators import windows
from siftspark.operators.skew import ordered_sums, size_slot, unit_slot
from siftspark.plans import relations as rel
from siftspark.plans.relations import CELL, GROUP, PRIMARY, with_sql
from siftspark.runtime import stage


def score_table(df: DataFrame, by: list[str], score: str, y: str) -> DataFrame:
    """(by, score, pos, neg): rows of either class at each distinct score."""
    return df.groupBy(*by, score).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))


def auroc(df: DataFrame, by: list[str], score: str, y: str, name: str = "auroc") -> DataFrame:
    """The chance that a positive scores above a negative, ties half; null where a class is missing."""
    t = ordered_sums(score_table(df, by, score, y), by, size_slot(F.col(score)), [F.col(score)], {"upto": F.col("neg")})
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return t.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias(name))


def _cumulative(df: DataFrame, by: list[str], score: str, y: str) -> DataFrame:
    sums, totals = {"tp": F.col("pos"), "fp": F.col("neg")}, {"tp": "all_pos", "fp": "all_neg"}
    return ordered_sums(score_table(df, by, score, y), by, -size_slot(F.col(score)), [F.desc(score)], sums, totals).drop("neg")


def average_precision(df: DataFrame, by: list[str], score: str, y: str, name: str = "pr_auc") -> DataFrame:
    """Sum over distinct scores of the recall gained times the precision there; 0 without positives."""
    t = _cumulative(df, by, score, y)
    return t.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("all_pos") > 0, F.col("pos") / F.col("all_pos") * F.col("tp") / (F.col("tp") + F.col("fp")))), F.lit(0.0)).alias(name))


def fnr_at_fpr(df: DataFrame, by: list[str], score: str, y: str, most: float = 0.005, name: str = "fnr_at_fpr") -> DataFrame:
    """One less the best recall among thresholds with a false-positive rate of at most ``most``."""
    t = _cumulative(df, by, score, y)
    ok = (F.col("all_neg") == 0) | (F.col("fp") / F.col("all_neg") <= most + 2.0**-52)
    best = F.max(F.when(ok & (F.col("all_pos") > 0), F.col("tp") / F.col("all_pos")))
    return t.groupBy(*by).agg(F.when(F.max("all_pos") > 0, 1 - F.coalesce(best, F.lit(0.0))).alias(name))


def ece(df: DataFrame, by: list[str], ties: list[str], bins: int = 15, name: str = "ece") -> DataFrame:
    """Expected calibration error over bins of equal size in order of the score."""
    t = ordered_sums(df, by, unit_slot(F.col("p")), [F.col("p"), *map(F.col, ties)], {"_i": F.lit(1)}, {"_i": "_n"})
    t = t.withColumn("_b", windows.equal_bin(F.col("_i") - 1, F.col("_n"), bins))
    b = t.groupBy(*by, "_b", "_n").agg((F.count(F.lit(1)) / F.first("_n") * F.abs(F.avg("y") - F.avg("p"))).alias("_e"))
    return b.groupBy(*by).agg(F.sum("_e").alias(name))


def aurc(df: DataFrame, by: list[str], ties: list[str], name: str = "aurc") -> DataFrame:
    t = df.withColumn("_e", ((F.col("p") >= 0.5).cast("int") != F.col("y")).cast("double"))
    sure = F.greatest("p", 1 - F.col("p"))
    t = ordered_sums(t, by, unit_slot(sure, down=True), [sure.desc(), *map(F.col, ties)], {"_s": F.col("_e"), "_i": F.lit(1)})
    return t.groupBy(*by).agg(F.avg(F.col("_s") / F.col("_i")).alias(name))


def confusion(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, tp, fp, fn, tn, brier) of the label forced at 0.5."""
    f, y = F.col("p") >= 0.5, F.col("y") == 1
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    return df.groupBy(*by).agg(n(f & y).alias("tp"), n(f & ~y).alias("fp"), n(~f & y).alias("fn"), n(~f & ~y).alias("tn"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def classification(c: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1, F2, Matthews correlation and accuracy; 0 where undefined."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(
        *by, "brier", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(5 * tp, 5 * tp + fp + 4 * fn).alias("f2"),
        _ratio(tp * tn - fp * fn, root).alias("mcc"), _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def triage(decided: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of prediction sets; a rate over no record is null."""
    size = F.col("in_safe").cast("int") + F.col("in_vulnerable").cast("int")
    vul, missed = F.col("y") == 1, F.when(F.col("y") == 1, ~F.col("in_vulnerable")).otherwise(~F.col("in_safe"))
    n = lambda c: F.count(F.when(c, 1))
    mean = lambda c, where: F.avg(F.when(where, c.cast("int")))
    single = size == 1
    return decided.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), n(vul).alias("n_vulnerable"), n(~vul).alias("n_safe"), n(missed & vul).alias("vulnerable_missed"), n(missed & ~vul).alias("safe_missed"), n(single).alias("singletons"),
        mean(missed, vul).alias("vulnerable_miscoverage"), mean(missed, ~vul).alias("safe_miscoverage"), F.avg(single.cast("int")).alias("singleton_coverage"),
        mean(single, vul).alias("vulnerable_singleton_rate"), mean(single, ~vul).alias("safe_singleton_rate"), F.avg((size != 1).cast("int")).alias("review_load"),
        F.avg((size == 0).cast("int")).alias("empty_rate"), F.avg((size == 2).cast("int")).alias("doubleton_rate"),
    )


def with_targets(m: DataFrame) -> DataFrame:
    """Adds the violations of both budgets and the greater one relative to its budget; a missing rate violates nothing."""
    v = F.greatest(F.lit(0.0), F.coalesce(F.col("vulnerable_miscoverage"), F.lit(0.0)) - F.col("av"))
    s = F.greatest(F.lit(0.0), F.coalesce(F.col("safe_miscoverage"), F.lit(0.0)) - F.col("asafe"))
    return m.withColumn("vulnerable_violation", v).withColumn("safe_violation", s).withColumn("max_relative_violation", F.greatest(v / F.col("av"), s / F.col("asafe")))


KEYS = [*GROUP, "av", "asafe", "method"]
RATES = [
    "vulnerable_miscoverage", "safe_miscoverage", "singleton_coverage", "vulnerable_singleton_rate", "safe_singleton_rate", "review_load", "empty_rate", "doubleton_rate",
]
VIOLATIONS = ["vulnerable_violation", "safe_violation", "max_relative_violation"]


def fold_metrics(s, d) -> DataFrame:
    """The metric row of every detector, group, seed, operating point and method."""
    from siftspark.operators.conformal import decisions

    return with_targets(triage(decisions(stage(rel.scored(s, d), "scored")), KEYS))


def _t(s, d) -> DataFrame:
    return rel.scored(s, d, "target")


def rounded(df: DataFrame, names: list[str], digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def _one(f, name: str, digits: int = 9):
    return lambda s, d: rounded(f(_t(s, d)), [name], digits)


def _error_detection(t: DataFrame) -> DataFrame:
    """AUROC of the uncertainty as a detector of forced errors."""
    e = t.withColumn("wrong", ((F.col("p") >= 0.5).cast("int") != F.col("y")).cast("int")).withColumn("doubt", 1 - F.greatest("p", 1 - F.col("p")))
    return auroc(e, CELL, "doubt", "wrong", "error_detection_auroc")


_TIES = ["target_group", "position"]
_CLASSES = ["precision", "recall", "f1", "f2", "mcc", "accuracy", "brier"]
QUERIES = {
    "met_triage": lambda s, d: rounded(fold_metrics(s, d), [*RATES, *VIOLATIONS]),
    "met_ece": _one(lambda t: ece(t, CELL, _TIES), "ece"),
    "met_aurc": _one(lambda t: aurc(t, CELL, _TIES), "aurc"),
    "met_fnr_at_fpr": _one(lambda t: fnr_at_fpr(t, CELL, "p", "y"), "fnr_at_fpr"),
    "met_auprc": _one(lambda t: average_precision(t, CELL, "p", "y"), "pr_auc"),
    "met_auroc": _one(lambda t: auroc(t, CELL, "p", "y"), "auroc"),
    "met_error_detection_auroc": _one(_error_detection, "error_detection_auroc"),
    "met_brier": _one(lambda t: confusion(t, CELL).select(*CELL, "brier"), "brier"),
    "met_prf": lambda s, d: rounded(classification(confusion(_t(s, d), CELL), CELL).select(*CELL, "precision", "recall", "f1"), _CLASSES),
    "met_f2": _one(lambda t: classification(confusion(t, CELL), CELL).select(*CELL, "f2"), "f2"),
    "met_mcc": _one(lambda t: classification(confusion(t, CELL), CELL).select(*CELL, "mcc"), "mcc"),
    "met_accuracy_gate": _one(lambda t: classification(confusion(t, CELL), CELL).select(*CELL, "accuracy"), "accuracy"),
    "dec_add_targets": lambda s, d: rounded(fold_metrics(s, d).where(F.col("av") == PRIMARY[0]).select(*KEYS, *VIOLATIONS), VIOLATIONS),
}

_SIZE = "in_safe::INT + in_vulnerable::INT"
_MISS = "CASE WHEN y = 1 THEN NOT in_vulnerable ELSE NOT in_safe END"
_KEYS = ", ".join(KEYS)


def triage_sql(source: str) -> str:
    return f"""tr AS (SELECT {_KEYS}, count(*) AS n, count(*) FILTER (y = 1) AS n_vulnerable, count(*) FILTER (y = 0) AS n_safe, count(*) FILTER (y = 1 AND {_MISS}) AS vulnerable_missed,
    count(*) FILTER (y = 0 AND {_MISS}) AS safe_missed, count(*) FILTER ({_SIZE} = 1) AS singletons, avg(({_MISS})::INT) FILTER (y = 1) AS vulnerable_miscoverage, avg(({_MISS})::INT) FILTER (y = 0) AS safe_miscoverage,
    avg(({_SIZE} = 1)::INT) AS singleton_coverage, avg(({_SIZE} = 1)::INT) FILTER (y = 1) AS vulnerable_singleton_rate, avg(({_SIZE} = 1)::INT) FILTER (y = 0) AS safe_singleton_rate,
    avg(({_SIZE} <> 1)::INT) AS review_load, avg(({_SIZE} = 0)::INT) AS empty_rate, avg(({_SIZE} = 2)::INT) AS doubleton_rate FROM {source} GROUP BY ALL),
  vi AS (SELECT *, greatest(0, coalesce(vulnerable_miscoverage, 0) - av) AS vulnerable_violation, greatest(0, coalesce(safe_miscoverage, 0) - asafe) AS safe_violation FROM tr),
  mx AS (SELECT *, greatest(vulnerable_violation / av, safe_violation / asafe) AS max_relative_violation FROM vi)"""


def metrics_sql(query: str) -> str:
    """``query`` over mx, the metric rows of all methods."""
    from siftspark.operators.conformal import DECISIONS_SQL

    body = query.strip()
    more = f", {body[5:]}" if body[:5] == "WITH " else f" {body}"
    return with_sql("cal tgt bud ev", f"WITH {DECISIONS_SQL}, {triage_sql('de')}{more}")


_CUM = """WITH g AS (SELECT detector, seed, p, sum(y) AS pos, sum(1 - y) AS neg FROM tgt GROUP BY 1, 2, 3),
  c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY detector, seed) AS ap, sum(neg) OVER (PARTITION BY detector, seed) AS an FROM g WINDOW w AS (PARTITION BY detector, seed ORDER BY p DESC))"""
_RANK = "WITH x AS ({}), r AS (SELECT *, rank() OVER (PARTITION BY detector, seed ORDER BY s) + (count(*) OVER (PARTITION BY detector, seed, s) - 1) / 2 AS r FROM x), q AS (SELECT detector, seed, sum(hit) AS np, sum(1 - hit) AS nn, sum(r) FILTER (hit = 1) AS sr FROM r GROUP BY 1, 2) SELECT detector, seed, CASE WHEN np * nn > 0 THEN round((sr - np * (np + 1) / 2) / (np * nn), 9) END AS {} FROM q"
_CONF = "WITH c AS (SELECT detector, seed, count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p >= 0.5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (p < 0.5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (p < 0.5 AND y = 0)::DOUBLE AS tn, avg(pow(p - y, 2)) AS b FROM tgt GROUP BY 1, 2)"
_DIV = "round(CASE WHEN {1} > 0 THEN ({0}) / ({1}) ELSE 0 END, 9)"
_BIN = windows._BIN
ORACLE = {
    "met_triage": metrics_sql("SELECT * REPLACE (" + ", ".join(f"round({c}, 9) AS {c}" for c in [*RATES, *VIOLATIONS]) + ") FROM mx"),
    "met_ece": with_sql("tgt", f"""WITH r AS (SELECT detector, seed, p, y, row_number() OVER (PARTITION BY detector, seed ORDER BY p, target_group, position) - 1 AS i, count(*) OVER (PARTITION BY detector, seed) AS n FROM tgt),
        b AS (SELECT *, {_BIN} AS bin FROM (SELECT *, least(15, n) AS k FROM r)), e AS (SELECT detector, seed, bin, count(*) / max(n) * abs(avg(y) - avg(p)) AS e FROM b GROUP BY 1, 2, 3) SELECT detector, seed, round(sum(e), 9) AS ece FROM e GROUP BY 1, 2"""),
    "met_aurc": with_sql("tgt", """WITH r AS (SELECT detector, seed, avg(CASE WHEN (p >= 0.5)::INT <> y THEN 1.0::DOUBLE ELSE 0.0 END) OVER (PARTITION BY detector, seed
        ORDER BY greatest(p, 1 - p) DESC, target_group, position ROWS UNBOUNDED PRECEDING) AS r FROM tgt) SELECT detector, seed, round(avg(r), 9) AS aurc FROM r GROUP BY 1, 2"""),
    "met_fnr_at_fpr": with_sql("tgt", f"{_CUM} SELECT detector, seed, CASE WHEN max(ap) > 0 THEN round(1 - coalesce(max(tp / ap) FILTER (an = 0 OR fp / an <= 0.005 + {2.0**-52}), 0), 9) END AS fnr_at_fpr FROM c GROUP BY 1, 2"),
    "met_auprc": with_sql("tgt", f"{_CUM} SELECT detector, seed, round(coalesce(sum(pos / ap * tp / (tp + fp)) FILTER (ap > 0), 0), 9) AS pr_auc FROM c GROUP BY 1, 2"),
    "met_auroc": with_sql("tgt", _RANK.format("SELECT detector, seed, p AS s, y AS hit FROM tgt", "auroc")),
    "met_error_detection_auroc": with_sql("tgt", _RANK.format("SELECT detector, seed, 1 - greatest(p, 1 - p) AS s, ((p >= 0.5)::INT <> y)::INT AS hit FROM tgt", "error_detection_auroc")),
    "met_brier": with_sql("tgt", f"{_CONF} SELECT detector, seed, round(b, 9) AS brier FROM c"),
    "met_prf": with_sql("tgt", f"{_CONF} SELECT detector, seed, {_DIV.format('tp', 'tp + fp')} AS precision, {_DIV.format('tp', 'tp + fn')} AS recall, {_DIV.format('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c"),
    "met_f2": with_sql("tgt", f"{_CONF} SELECT detector, seed, {_DIV.format('5 * tp', '5 * tp + fp + 4 * fn')} AS f2 FROM c"),
    "met_mcc": with_sql("tgt", f"{_CONF} SELECT detector, seed, {_DIV.format('tp * tn - fp * fn', 'sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))')} AS mcc FROM c"),
    "met_accuracy_gate": with_sql("tgt", f"{_CONF} SELECT detector, seed, {_DIV.format('tp + tn', 'tp + fp + fn + tn')} AS accuracy FROM c"),
    "dec_add_targets": metrics_sql(f"SELECT {_KEYS}, " + ", ".join(f"round({c}, 9) AS {c}" for c in VIOLATIONS) + " FROM mx WHERE av = 0.1"),
}
