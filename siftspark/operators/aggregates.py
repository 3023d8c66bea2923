"""Grouped results over records, labels and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark.plans import relations as rel
from siftspark.plans.relations import CLIP, CLIPS, with_sql
from siftspark.runtime import table

SPLITS = ["train", "valid", "test", "external"]


def place(split: Column) -> Column:
    """Order of the splits."""
    out = F.lit(len(SPLITS))
    for i, s in reversed(list(enumerate(SPLITS))):
        out = F.when(split == s, i).otherwise(out)
    return out


def dedup(rows: DataFrame, by: list[str], key: str, target: str, order: list[str], row_id: str) -> DataFrame:
    """One row per key: its first row by ``order``, its rows, and how their targets relate to the first one's.

    same_label counts later rows with the first row's target, also where the key has another target too; conflicting
    says whether it has. Rows are combined per (key, target) map-side, so the number of copies of a key doesn't matter.
    """
    first = F.min(F.struct(*order, row_id))
    per = rows.groupBy(*by, key, target).agg(F.count(F.lit(1)).alias("_n"), first.alias("_f"))
    whole = per.groupBy(*by, key).agg(
        F.sum("_n").alias("n"), F.countDistinct(target).alias("_k"), F.min(F.struct("_f", "_n", target)).alias("_m")
    )
    return whole.select(
        *by, key, F.col(f"_m._f.{row_id}").alias(row_id), F.col(f"_m.{target}").alias(target), "n",
        (F.col("_m._n") - 1).alias("same_label"), (F.col("_k") > 1).alias("conflicting"),
    )


def deduplicated(spark: SparkSession, folder: str, dataset: str = "primevul") -> DataFrame:
    r = rel.labelled(spark, folder).where((F.col("dataset") == dataset) & F.col("key").isNotNull())
    return dedup(r.withColumn("at", place(F.col("split"))), ["dataset"], "key", "target", ["at", "first_position"], "row_id")


def _dedup_audit(s, d) -> DataFrame:
    raw = table(s, d, "records").where("dataset = 'primevul'").agg(F.count(F.lit(1)).alias("physical")).withColumn("_", F.lit(1))
    g = deduplicated(s, d).agg(
        F.sum("n").alias("valid"), F.count(F.lit(1)).alias("unique_keys"), F.sum("same_label").alias("same_label"),
        F.count(F.when(F.col("conflicting"), 1)).alias("conflicting"), F.count(F.when(~F.col("conflicting"), 1)).alias("retained"),
    ).withColumn("_", F.lit(1))
    return raw.join(g, "_").drop("_")


def _key_audit(s, d) -> DataFrame:
    r = rel.records(s, d).where("dataset = 'primevul'")
    return r.agg(
        F.count("key").alias("valid"), F.countDistinct("key").alias("unique_keys"), (F.count("key") - F.countDistinct("key")).alias("duplicates"), F.count(F.when(F.col("key").isNull(), 1)).alias("missing")
    )


def _project_counts(s, d) -> DataFrame:
    g = rel.labelled(s, d).where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("vulnerable"))
    return g.withColumn("safe", F.col("n") - F.col("vulnerable"))


def _split_summary(s, d) -> DataFrame:
    """Counts by split and target, with the totals of either and of both."""
    return rel.labelled(s, d).where("split is not null").cube("split", "target").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def _file_audit(s, d) -> DataFrame:
    r = rel.labelled(s, d)
    return r.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("project").alias("projects"), F.countDistinct("commit_id").alias("commits"), F.countDistinct("key").alias("keys"),
        F.sum("target").alias("vulnerable"), F.count(F.when(F.col("commit_id").isNull(), 1)).alias("without_commit"),
    )


def ordered_digest(df: DataFrame, group: str, position: str, item: str, fan: int = 4096) -> DataFrame:
    """(group, n, digest): SHA-256 over the items in order of their positions, by levels.

    Items of ``fan`` consecutive positions are hashed, then ``fan`` consecutive hashes, and so on through three levels,
    so no task holds more than ``fan`` items of a group until there are fan**3. Positions are dense from 0.
    """
    level = df.select(group, F.col(position).alias("_p"), F.col(item).cast("string").alias("_x"), F.lit(1).cast("long").alias("_n"))
    for _ in range(3):
        joined = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("_p", "_x"))), lambda e: e["_x"]))
        level = level.groupBy(group, F.floor(F.col("_p") / fan).alias("_p")).agg(F.sha2(joined, 256).alias("_x"), F.sum("_n").alias("_n"))
    return level.select(group, F.col("_n").alias("n"), F.col("_x").alias("digest"))


def _sequence_hash(s, d) -> DataFrame:
    from siftspark.operators.windows import dense_position

    return ordered_digest(dense_position(rel.records(s, d), "dataset", ["first_position"]), "dataset", "position", "row_id")


def _seed_mean(s, d) -> DataFrame:
    """Mean over seeds of the mean score of each detector, group and side."""
    g = rel.predictions(s, d).groupBy("detector", "target_group", "side", "seed").agg(F.avg("p").alias("m"))
    return g.groupBy("detector", "target_group", "side").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("m"), 11).alias("p"))


def kish_ess(w: Column) -> Column:
    """(sum w)^2 / sum w^2, 0 if there is no weight."""
    return F.when(F.sum(w * w) > 0, F.pow(F.sum(w), 2) / F.sum(w * w)).otherwise(0.0)


def _ess(s, d) -> DataFrame:
    w = F.col("ratio")
    return rel.scored(s, d, "calibration").groupBy(*rel.CELL).agg(
        F.round(kish_ess(w), 6).alias("ess"), F.round(kish_ess(F.when(F.col("y") == 0, w)), 6).alias("ess_safe"), F.round(kish_ess(F.when(F.col("y") == 1, w)), 6).alias("ess_vulnerable")
    )


QUANTILES = {"least": 0.0, "p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99, "most": 1.0}


def weight_summary(df: DataFrame, by: list[str], upper: float) -> DataFrame:
    """Effective sample size and quantiles of clipped weights, and how many were clipped at either end."""
    from siftspark.operators.predicates import clip

    w = clip(F.col("ratio"), upper)
    q = F.percentile(w, F.array(*[F.lit(x) for x in QUANTILES.values()]))
    out = df.groupBy(*by).agg(
        F.round(kish_ess(w), 6).alias("ess"), q.alias("q"), F.count(F.when(F.col("ratio") < 1.0 / upper, 1)).alias("low"), F.count(F.when(F.col("ratio") > upper, 1)).alias("high")
    )
    return out.select(*by, "ess", "low", "high", *[F.round(F.col("q")[i], 9).alias(k) for i, k in enumerate(QUANTILES)])


def _quantiles(s, d) -> DataFrame:
    g = _seed_mean(s, d)
    q = F.percentile("p", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)))
    return g.groupBy("detector", "side").agg(F.count(F.lit(1)).alias("groups"), q.alias("q")).select("detector", "side", "groups", *[F.round(F.col("q")[i], 13).alias(k) for i, k in enumerate(("median", "q25", "q75"))])


def _pivot_detector(s, d) -> DataFrame:
    """Per group the detectors' mean scores side by side, their difference and who wins."""
    g = rel.predictions(s, d).groupBy("target_group").pivot("detector", ["hashing_sgd", "frozen_codebert"]).agg(F.avg("p"))
    x = F.round(F.col("frozen_codebert") - F.col("hashing_sgd"), 9)
    return g.where("hashing_sgd is not null and frozen_codebert is not null").select("target_group", F.round("hashing_sgd", 9).alias("hashing"), F.round("frozen_codebert", 9).alias("codebert"), x.alias("difference"), F.when(x > 0, "codebert").when(x < 0, "hashing").otherwise("tie").alias("winner"))


def _pivot_side(s, d) -> DataFrame:
    g = rel.predictions(s, d).groupBy("detector", "seed").pivot("side", ["calibration", "target"]).agg(F.round(F.avg("p"), 9).alias("p"), F.count(F.lit(1)).alias("n"))
    return g


def _any_all(s, d) -> DataFrame:
    p = rel.predictions(s, d).withColumn("ok", F.col("ratio") <= 1.0)
    return p.groupBy("detector", "target_group").agg(F.bool_and("ok").alias("every"), F.bool_or("ok").alias("some"), F.round(F.avg(F.col("ok").cast("int")), 9).alias("share"))


def _first_of_group(s, d) -> DataFrame:
    """The score of the earliest seed of each group, by seed and position."""
    p = rel.predictions(s, d)
    return p.groupBy("detector", "target_group", "side").agg(F.min_by("p", F.struct("seed", "position", "row_id")).alias("p"), F.countDistinct("seed").alias("seeds"))


def _group_max(s, d) -> DataFrame:
    return rel.predictions(s, d).groupBy("detector", "seed").agg(F.max("p").alias("p"), F.max("ratio").alias("ratio"))


def _project_span(s, d) -> DataFrame:
    return rel.predictions(s, d).groupBy("target_group").agg(F.round(F.avg("p"), 9).alias("mean"), F.min("p").alias("least"), F.max("p").alias("most"), F.bool_and(F.col("p") < 0.5).alias("all_low"))


def _fold_counts(s, d) -> DataFrame:
    r = rel.labelled(s, d).where("dataset = 'primevul' and grp is not null")
    return r.groupBy("grp", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("vulnerable"), F.sum(1 - F.col("target")).alias("safe"))


QUERIES = {
    "agg_dedup_first_conflict": deduplicated,
    "agg_dedup_audit": _dedup_audit,
    "agg_prime_key_audit": _key_audit,
    "agg_project_counts": _project_counts,
    "agg_split_summary": _split_summary,
    "agg_file_audit": _file_audit,
    "agg_sequence_hash": _sequence_hash,
    "agg_seed_mean": _seed_mean,
    "agg_kish_ess": _ess,
    "agg_weight_summary": lambda s, d: weight_summary(rel.predictions(s, d), ["detector", "seed", "side"], CLIP),
    "agg_quantile_summary": _quantiles,
    "agg_pivot_detector": _pivot_detector,
    "agg_pivot_method": _pivot_side,
    "agg_any_all": _any_all,
    "agg_first_per_group": _first_of_group,
    "agg_group_max": _group_max,
    "agg_project_automation": _project_span,
    "agg_fold_counts": _fold_counts,
}

_PLACE = "CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 WHEN 'test' THEN 2 WHEN 'external' THEN 3 ELSE 4 END"
_DD = f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {_PLACE}, first_position, row_id) AS i, first_value(target) OVER (PARTITION BY key ORDER BY {_PLACE}, first_position, row_id) AS t1
    FROM rl WHERE dataset = 'primevul' AND key IS NOT NULL),
  dd AS (SELECT 'primevul' AS dataset, key, max(row_id) FILTER (i = 1) AS row_id, max(t1) AS target, count(*) AS n, count(*) FILTER (target = t1) - 1 AS same_label, count(DISTINCT target) > 1 AS conflicting FROM o GROUP BY key)"""
_SEED = """WITH g AS (SELECT detector, target_group, side, seed, avg(p) AS m FROM prd GROUP BY 1, 2, 3, 4),
  sm AS (SELECT detector, target_group, side, count(*) AS seeds, round(avg(m), 11) AS p FROM g GROUP BY 1, 2, 3)"""
_ESS = "CASE WHEN sum({0} * {0}) > 0 THEN pow(sum({0}), 2) / sum({0} * {0}) ELSE 0 END"
_W = f"greatest(1 / {CLIP}, least({CLIP}, ratio))"
ORACLE = {
    "agg_dedup_first_conflict": with_sql("rl", f"{_DD} SELECT * FROM dd"),
    "agg_dedup_audit": with_sql("rl", f"""{_DD} SELECT (SELECT count(*) FROM records WHERE dataset = 'primevul') AS physical, sum(n)::BIGINT AS valid, count(*) AS unique_keys, sum(same_label)::BIGINT AS same_label,
        count(*) FILTER (conflicting) AS conflicting, count(*) FILTER (NOT conflicting) AS retained FROM dd"""),
    "agg_prime_key_audit": with_sql("rec", "SELECT count(key) AS valid, count(DISTINCT key) AS unique_keys, count(key) - count(DISTINCT key) AS duplicates, count(*) FILTER (key IS NULL) AS missing FROM rec WHERE dataset = 'primevul'"),
    "agg_project_counts": with_sql("rl", "SELECT grp, count(*) AS n, sum(target)::BIGINT AS vulnerable, (count(*) - sum(target))::BIGINT AS safe FROM rl WHERE grp IS NOT NULL GROUP BY 1"),
    "agg_split_summary": with_sql("rl", "SELECT split, target, count(*) AS n, (2 * grouping(split) + grouping(target))::INT AS level FROM rl WHERE split IS NOT NULL GROUP BY CUBE (split, target)"),
    "agg_file_audit": with_sql("rl", """SELECT source_file, count(*) AS n, count(DISTINCT project) AS projects, count(DISTINCT commit_id) AS commits, count(DISTINCT key) AS keys, sum(target)::BIGINT AS vulnerable,
        count(*) FILTER (commit_id IS NULL) AS without_commit FROM rl GROUP BY 1"""),
    "agg_sequence_hash": with_sql("rec", """WITH p AS (SELECT dataset, row_id, row_number() OVER (PARTITION BY dataset ORDER BY first_position) - 1 AS i FROM rec),
        a AS (SELECT dataset, i // 4096 AS i, sha256(string_agg(row_id, chr(10) ORDER BY i)) AS x, count(*) AS n FROM p GROUP BY 1, 2),
        b AS (SELECT dataset, i // 4096 AS i, sha256(string_agg(x, chr(10) ORDER BY i)) AS x, sum(n) AS n FROM a GROUP BY 1, 2)
        SELECT dataset, sum(n)::BIGINT AS n, sha256(string_agg(x, chr(10) ORDER BY i)) AS digest FROM b GROUP BY 1"""),
    "agg_seed_mean": with_sql("prd", f"{_SEED} SELECT * FROM sm"),
    "agg_kish_ess": with_sql("cal", f"""SELECT detector, seed, round({_ESS.format('ratio')}, 6) AS ess, round({_ESS.format('CASE WHEN y = 0 THEN ratio END')}, 6) AS ess_safe,
        round({_ESS.format('CASE WHEN y = 1 THEN ratio END')}, 6) AS ess_vulnerable FROM cal GROUP BY 1, 2"""),
    "agg_weight_summary": with_sql("prd", f"""SELECT detector, seed, side, round({_ESS.format(_W)}, 6) AS ess, count(*) FILTER (ratio < 1 / {CLIP}) AS low, count(*) FILTER (ratio > {CLIP}) AS high, """
        + ", ".join(f"round(quantile_cont({_W}, {q}), 9) AS {k}" for k, q in QUANTILES.items()) + " FROM prd GROUP BY 1, 2, 3"),
    "agg_quantile_summary": with_sql("prd", f"""{_SEED} SELECT detector, side, count(*) AS groups, round(quantile_cont(p, 0.5), 13) AS median, round(quantile_cont(p, 0.25), 13) AS q25, round(quantile_cont(p, 0.75), 13) AS q75 FROM sm GROUP BY 1, 2"""),
    "agg_pivot_detector": with_sql("prd", """WITH m AS (SELECT target_group, avg(p) FILTER (detector = 'hashing_sgd') AS a, avg(p) FILTER (detector = 'frozen_codebert') AS b FROM prd GROUP BY 1), x AS (SELECT *, round(b - a, 9) AS difference FROM m WHERE a IS NOT NULL AND b IS NOT NULL)
        SELECT target_group, round(a, 9) AS hashing, round(b, 9) AS codebert, difference, CASE WHEN difference > 0 THEN 'codebert' WHEN difference < 0 THEN 'hashing' ELSE 'tie' END AS winner FROM x"""),
    "agg_pivot_method": with_sql("prd", """SELECT detector, seed, round(avg(p) FILTER (side = 'calibration'), 9) AS calibration_p, count(*) FILTER (side = 'calibration') AS calibration_n,
        round(avg(p) FILTER (side = 'target'), 9) AS target_p, count(*) FILTER (side = 'target') AS target_n FROM prd GROUP BY 1, 2"""),
    "agg_any_all": with_sql("prd", "SELECT detector, target_group, bool_and(ratio <= 1) AS every, bool_or(ratio <= 1) AS some, round(avg((ratio <= 1)::INT), 9) AS share FROM prd GROUP BY 1, 2"),
    "agg_first_per_group": with_sql("prd", "SELECT detector, target_group, side, arg_min(p, (seed, position, row_id)) AS p, count(DISTINCT seed) AS seeds FROM prd GROUP BY 1, 2, 3"),
    "agg_group_max": with_sql("prd", "SELECT detector, seed, max(p) AS p, max(ratio) AS ratio FROM prd GROUP BY 1, 2"),
    "agg_project_automation": with_sql("prd", "SELECT target_group, round(avg(p), 9) AS mean, min(p) AS least, max(p) AS most, bool_and(p < 0.5) AS all_low FROM prd GROUP BY 1"),
    "agg_fold_counts": with_sql("rl", "SELECT grp, role, count(*) AS n, sum(target)::BIGINT AS vulnerable, sum(1 - target)::BIGINT AS safe FROM rl WHERE dataset = 'primevul' AND grp IS NOT NULL GROUP BY 1, 2"),
}
