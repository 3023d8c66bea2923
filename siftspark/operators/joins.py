"""Joins: anti, semi, not-exists, locator, aligned and range-shaped ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.text import presence, sql_presence
from siftspark.operators.windows import selection
from siftspark.plans import relations as rel
from siftspark.plans.relations import with_sql
from siftspark.runtime import table

SOURCE, TARGET = "primevul", "diversevul"


def contract(left: DataFrame, right: DataFrame, on: list[str], one_to_one: bool = True) -> DataFrame:
    """One row: keys, and keys that break the contract, of a join on ``on``.

    Keys are counted on each side by aggregation before they meet, so a repeated key costs no product.
    """
    sides = left.groupBy(*on).agg(F.count(F.lit(1)).alias("l")).join(right.groupBy(*on).agg(F.count(F.lit(1)).alias("r")), on, "full")
    return sides.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count(F.when(F.col("l").isNull(), 1)).alias("only_right"),
        F.count(F.when(F.col("r").isNull(), 1)).alias("only_left"),
        F.count(F.when((F.col("r") > 1) | ((F.col("l") > 1) & F.lit(one_to_one)), 1)).alias("broken"),
    )


def first_at_least(steps: DataFrame, queries: DataFrame, by: list[str], step: str, value: str, query: str, slot: Callable[[Column], Column]) -> DataFrame:
    """``queries`` with ``value`` of the least step >= query in the same group, or null: an as-of join looking ahead.

    Steps and queries are united and sorted once, downwards, with equal steps before queries; the last value seen is the
    answer. That is linear after the sort, where a join on >= would be quadratic. The sort is within (group, slot), where
    ``slot`` makes a small number of a step or query that never falls with it; a query with no step in its slot takes the
    least step of the next slot that has one. A null query finds nothing.
    """
    from pyspark.sql import Window

    cols = [c for c in queries.columns if c not in by]
    kept = F.struct(*cols) if cols else F.struct(F.lit(1).alias("_none"))
    kind = queries.select(kept.alias("q")).schema["q"].dataType
    one = steps.select(*by, slot(F.col(step)).alias("_slot"), F.col(step).alias("_at"), F.lit(0).alias("_kind"), F.col(value).alias("_value"), F.lit(None).cast(kind).alias("_q"))
    two = queries.select(*by, F.coalesce(slot(F.col(query)), F.lit(0)).alias("_slot"), F.col(query).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(steps.schema[value].dataType).alias("_value"), kept.alias("_q"))
    w = Window.partitionBy(*by, "_slot").orderBy(F.desc("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    # One row for each slot of a group, with or without steps.
    least = F.min(F.when(F.col("_kind") == 0, F.struct("_at", "_value"))).alias("_least")
    ahead = Window.partitionBy(*by).orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    both = one.unionByName(two)
    slots = both.groupBy(*by, "_slot").agg(least).select(*by, "_slot", F.last("_least", ignorenulls=True).over(ahead)["_value"].alias("_next"))
    found = both.join(slots, [*by, "_slot"]).withColumn("_found", F.coalesce(F.last("_value", ignorenulls=True).over(w), "_next")).where("_kind = 1")
    return found.select(*by, *[F.col(f"_q.{c}").alias(c) for c in cols], F.when(F.col("_at").isNotNull(), F.col("_found")).alias(value))


def _source(s, d):
    return rel.records(s, d).where(F.col("dataset") == SOURCE)


def _target(s, d):
    return rel.records(s, d).where(F.col("dataset") == TARGET)


def _locator(spark: SparkSession, folder: str) -> DataFrame:
    """Status of each cached place against the record that stands there."""
    c = table(spark, folder, "cache_locations").distinct().select(
        "source_file", "line_number", F.col("row_id").alias("cached_id"), presence(F.col("project")).alias("cached_project"), F.lower(presence(F.col("commit_id"))).alias("cached_commit")
    )
    r = table(spark, folder, "records").distinct().select(
        "source_file", "line_number", "row_id", presence(F.col("project")).alias("project"), F.lower(presence(F.col("commit_id"))).alias("commit_id")
    )
    same = F.col("cached_id").eqNullSafe(F.col("row_id")) & F.col("cached_project").eqNullSafe(F.col("project")) & F.col("cached_commit").eqNullSafe(F.col("commit_id"))
    status = F.when(F.col("row_id").isNull(), "absent").when(same, "same").otherwise("differs")
    return c.join(r, ["source_file", "line_number"], "left").select("source_file", "line_number", "cached_id", status.alias("status"))


def _zip(spark: SparkSession, folder: str) -> DataFrame:
    """Records and cache aligned on the feature position: positions on one side only, and with unequal ids."""
    r = rel.records(spark, folder).where("feature_position is not null").select("feature_position", "row_id")
    c = table(spark, folder, "cache_locations").distinct().where("feature_position is not null").select("feature_position", F.col("row_id").alias("cached_id"))
    z = r.join(c, "feature_position", "full")
    return z.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("cached_id").isNull(), 1)).alias("uncached"),
        F.count(F.when(F.col("row_id").isNull(), 1)).alias("unrecorded"), F.count(F.when(F.col("row_id") != F.col("cached_id"), 1)).alias("unequal"),
    )


def _baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Mean scores of the two detectors per group, aligned on the group; null where one is missing."""
    p = rel.predictions(spark, folder).groupBy("target_group", "detector").agg(F.avg("p").alias("m"))
    a = p.where("detector = 'hashing_sgd'").select("target_group", F.col("m").alias("base"))
    b = p.where("detector = 'frozen_codebert'").select("target_group", F.col("m").alias("other"))
    return a.join(b, "target_group", "full").select("target_group", F.round("base", 9).alias("base"), F.round("other", 9).alias("other"), F.round(F.col("other") - F.col("base"), 9).alias("difference"))


def _packages(spark: SparkSession, folder: str) -> DataFrame:
    """(target_group, row_id): for each selected target group the source records of all other groups.

    The selection has at most 24 groups; their names become an array of literals that is unfolded per row, not a join.
    """
    names = [r["grp"] for r in selection(spark, folder).where("chosen").orderBy("place").collect()]
    r = _source(spark, folder).where("grp is not null").select("row_id", "grp")
    targets = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return r.withColumn("target_group", F.explode(targets)).where("grp <> target_group").select("target_group", "row_id")


def _overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Common and united projects of each two splits; a project's splits are gathered first, at most one row each."""
    s = rel.records(spark, folder).where("project is not null and split is not null").select("split", "project").distinct()
    sizes = s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    pairs = s.select(F.col("split").alias("a"), "project").join(s.select(F.col("split").alias("b"), "project"), "project").where("a < b")
    common = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    na, nb = sizes.select(F.col("split").alias("a"), F.col("n").alias("na")), sizes.select(F.col("split").alias("b"), F.col("n").alias("nb"))
    return common.join(na, "a").join(nb, "b").select("a", "b", "common", (F.col("na") + F.col("nb") - F.col("common")).alias("either"))


def _suffixed(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of a record under two seeds side by side."""
    p = rel.predictions(spark, folder).groupBy("detector", "row_id", "seed").agg(F.max("p").alias("p"))
    a = p.where("seed = 13").select("detector", "row_id", F.col("p").alias("p_13"))
    b = p.where("seed = 37").select("detector", "row_id", F.col("p").alias("p_37"))
    return a.join(b, ["detector", "row_id"])


def _sorted_search(spark: SparkSession, folder: str) -> DataFrame:
    """Scores whose position is looked up among the feature positions, with the record found there, if any."""
    p = rel.predictions(spark, folder).where("side = 'calibration'").select("detector", "target_group", "seed", "position", "row_id")
    r = _source(spark, folder).where("feature_position is not null").select(F.col("feature_position").alias("position"), F.col("row_id").alias("found_id"))
    return p.join(r, "position", "left").select("detector", "target_group", "seed", "position", F.col("found_id").isNotNull().alias("found"), F.col("found_id").eqNullSafe(F.col("row_id")).alias("same"))


def _covered(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of the target with their scores' coverage, none where they have no score."""
    g = _target(spark, folder).where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n_records"))
    p = rel.predictions(spark, folder).where("side = 'target'").groupBy(F.col("target_group").alias("grp")).agg(F.count(F.lit(1)).alias("n_scores"))
    return g.join(p, "grp", "left").select("grp", "n_records", F.coalesce("n_scores", F.lit(0)).alias("n_scores"))


def _text_of_selected(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of a selection of places: located by file and line, checked by key, in the selection's order."""
    m = _source(spark, folder).where("role = 'calibration'").select("source_file", "line_number", "first_position", "key")
    d = rel.documents(spark, folder).where("text is not null").select("source_file", "line_number", "doc_id", F.lower(presence(F.col("exact_code_key"))).alias("text_key"), F.length("text").cast("long").alias("n"))
    return m.join(d, ["source_file", "line_number"]).select("first_position", "doc_id", "n", F.col("key").eqNullSafe(F.col("text_key")).alias("same_key"))


def _absent(spark: SparkSession, folder: str) -> DataFrame:
    """Source records for which no label 1 exists."""
    ones = table(spark, folder, "labels").where("target = 1").select("row_id")
    return _source(spark, folder).join(ones, "row_id", "left_anti").select("row_id")


def _scored_ids(s, d) -> DataFrame:
    return rel.predictions(s, d).where("side = 'target'").select("row_id").distinct()


QUERIES = {
    "join_anti_exact_key": lambda s, d: _target(s, d).where("key is not null").join(_source(s, d).where("key is not null").select("key").distinct(), "key", "left_anti").select("row_id", "key"),
    "join_meta_labels": lambda s, d: rel.labelled(s, d).select("row_id", "dataset", "split", "grp", "target"),
    "join_locator_verify": _locator,
    "join_not_exists": _absent,
    "join_validate_11": lambda s, d: contract(table(s, d, "records").distinct(), rel.labels(s, d), ["row_id"]),
    "join_validate_m1": lambda s, d: contract(rel.predictions(s, d), table(s, d, "labels"), ["row_id"], one_to_one=False),
    "join_self_suffix": _suffixed,
    "join_paired_baseline": _baseline,
    "join_position_zip": _zip,
    "join_sorted_search": _sorted_search,
    "join_semi_retained": lambda s, d: _target(s, d).join(_scored_ids(s, d), "row_id", "left_semi").select("row_id", "first_position"),
    "join_logo_exclude": _packages,
    "join_id_to_position": lambda s, d: _scored_ids(s, d).join(rel.records(s, d).select("row_id", "dataset", "first_position"), "row_id"),
    "join_grid_cross": lambda s, d: rel.with_budgets(rel.predictions(s, d).select(*rel.CELL).distinct()),
    "join_project_overlap": _overlap,
    "join_left_support_cov": _covered,
    "scan_locator_lookup": _text_of_selected,
}

_CONTRACT = """s AS (SELECT * FROM l FULL JOIN r USING (row_id))
    SELECT count(*) AS n_keys, count(*) FILTER (nl IS NULL) AS only_right, count(*) FILTER (nr IS NULL) AS only_left, count(*) FILTER ({}) AS broken FROM s"""
ORACLE = {
    "join_anti_exact_key": with_sql("rec", f"SELECT row_id, key FROM rec WHERE dataset = '{TARGET}' AND key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rec x WHERE x.dataset = '{SOURCE}' AND x.key = rec.key)"),
    "join_meta_labels": with_sql("rl", "SELECT row_id, dataset, split, grp, target FROM rl"),
    "join_locator_verify": f"""WITH c AS (SELECT DISTINCT * FROM cache_locations), r AS (SELECT DISTINCT * FROM records)
        SELECT c.source_file, c.line_number, c.row_id AS cached_id, CASE WHEN r.row_id IS NULL THEN 'absent'
            WHEN c.row_id IS NOT DISTINCT FROM r.row_id AND {sql_presence('c.project')} IS NOT DISTINCT FROM {sql_presence('r.project')}
             AND lower({sql_presence('c.commit_id')}) IS NOT DISTINCT FROM lower({sql_presence('r.commit_id')}) THEN 'same' ELSE 'differs' END AS status
        FROM c LEFT JOIN r ON c.source_file = r.source_file AND c.line_number = r.line_number""",
    "join_not_exists": with_sql("rec", f"SELECT row_id FROM rec WHERE dataset = '{SOURCE}' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.row_id = rec.row_id AND l.target = 1)"),
    "join_validate_11": with_sql("lab", "WITH l AS (SELECT row_id, count(*) AS nl FROM (SELECT DISTINCT * FROM records) GROUP BY 1), r AS (SELECT row_id, count(*) AS nr FROM lab GROUP BY 1), " + _CONTRACT.format("nl > 1 OR nr > 1")),
    "join_validate_m1": with_sql("prd", "WITH l AS (SELECT row_id, count(*) AS nl FROM prd GROUP BY 1), r AS (SELECT row_id, count(*) AS nr FROM labels GROUP BY 1), " + _CONTRACT.format("nr > 1")),
    "join_self_suffix": with_sql("prd", """SELECT detector, row_id, max(p) FILTER (seed = 13) AS p_13, max(p) FILTER (seed = 37) AS p_37 FROM prd GROUP BY 1, 2
        HAVING count(*) FILTER (seed = 13) > 0 AND count(*) FILTER (seed = 37) > 0"""),
    "join_paired_baseline": with_sql("prd", """WITH m AS (SELECT target_group, avg(p) FILTER (detector = 'hashing_sgd') AS a, avg(p) FILTER (detector = 'frozen_codebert') AS b FROM prd GROUP BY 1)
        SELECT target_group, round(a, 9) AS base, round(b, 9) AS other, round(b - a, 9) AS difference FROM m"""),
    "join_position_zip": with_sql("rec", """WITH r AS (SELECT feature_position AS f, row_id AS x FROM rec WHERE feature_position IS NOT NULL),
        c AS (SELECT feature_position AS f, row_id AS y FROM (SELECT DISTINCT * FROM cache_locations) WHERE feature_position IS NOT NULL)
        SELECT count(*) AS n, count(*) FILTER (y IS NULL) AS uncached, count(*) FILTER (x IS NULL) AS unrecorded, count(*) FILTER (x <> y) AS unequal FROM r FULL JOIN c USING (f)"""),
    "join_sorted_search": with_sql("prd rec", f"""SELECT detector, target_group, seed, position, r.row_id IS NOT NULL AS found, r.row_id IS NOT DISTINCT FROM prd.row_id AS same
        FROM prd LEFT JOIN (SELECT * FROM rec WHERE dataset = '{SOURCE}' AND feature_position IS NOT NULL) r ON r.feature_position = prd.position WHERE side = 'calibration'"""),
    "join_semi_retained": with_sql("prd rec", f"SELECT row_id, first_position FROM rec WHERE dataset = '{TARGET}' AND row_id IN (SELECT row_id FROM prd WHERE side = 'target')"),
    "join_id_to_position": with_sql("prd rec", "SELECT row_id, dataset, first_position FROM rec WHERE row_id IN (SELECT row_id FROM prd WHERE side = 'target')"),
    "join_grid_cross": with_sql("prd bud", "SELECT DISTINCT detector, seed, av, asafe FROM prd, bud"),
    "join_project_overlap": with_sql("rec", """WITH s AS (SELECT DISTINCT split, project FROM rec WHERE split IS NOT NULL AND project IS NOT NULL), n AS (SELECT split, count(*) AS k FROM s GROUP BY 1),
        c AS (SELECT x.split AS a, y.split AS b, count(*) AS common FROM s x JOIN s y USING (project) WHERE x.split < y.split GROUP BY 1, 2)
        SELECT a, b, common, na.k + nb.k - common AS either FROM c JOIN n na ON na.split = a JOIN n nb ON nb.split = b"""),
    "join_left_support_cov": with_sql("prd rec", f"""WITH g AS (SELECT grp, count(*) AS n_records FROM rec WHERE dataset = '{TARGET}' AND grp IS NOT NULL GROUP BY 1),
        p AS (SELECT target_group AS grp, count(*) AS n FROM prd WHERE side = 'target' GROUP BY 1) SELECT grp, n_records, coalesce(n, 0) AS n_scores FROM g LEFT JOIN p USING (grp)"""),
    "scan_locator_lookup": with_sql("rec", f"""SELECT first_position, doc_id, length(text) AS n, key IS NOT DISTINCT FROM lower({sql_presence('exact_code_key')}) AS same_key
        FROM rec JOIN documents d ON rec.source_file = d.source_file AND rec.line_number = d.line_number WHERE rec.dataset = '{SOURCE}' AND role = 'calibration' AND text IS NOT NULL"""),
}
