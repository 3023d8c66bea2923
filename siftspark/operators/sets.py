"""Set operations between tables and within rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.operators.skew import running
from siftspark.plans import relations as rel
from siftspark.plans.relations import with_sql
from siftspark.runtime import stage, table


def stacked(parts: list[DataFrame], order: list[str], name: str = "position") -> DataFrame:
    """The parts one after the other, in the order given, renumbered densely from 0; lacking columns are null."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part_no", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    whole = out.withColumn("_whole", F.lit("all")).withColumn("_one", F.lit(1).cast("long"))
    return running(whole, "_whole", ["_part_no", *order], "_one", total="_total", rank="_rank").withColumn(name, F.col("_rank") - 1).drop("_whole", "_one", "_total", "_rank", "_part_no")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table only, with the side they are on."""
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def merged_parts(parts: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """One row: keys, and keys that more than one part claims."""
    per = parts.select(part, *keys).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("n_keys"), F.count(F.when(F.col("k") > 1, 1)).alias("claimed_twice"))


def _sides(s, d) -> tuple[DataFrame, DataFrame]:
    r = rel.records(s, d)
    return r.where("dataset = 'primevul'"), r.where("dataset = 'diversevul'")


def _union(s, d) -> DataFrame:
    a, b = _sides(s, d)
    return stacked([a.select("dataset", "row_id", "first_position", "role"), b.select("dataset", "row_id", "first_position")], ["first_position"]).select("dataset", "row_id", "role", "position")


def _equality(s, d) -> DataFrame:
    r = rel.records(s, d).where("feature_position is not null").select("row_id")
    return differences(r, table(s, d, "cache_locations").distinct().select("row_id"))


def _groups(s, d) -> DataFrame:
    r = rel.records(s, d).where("dataset = 'diversevul' and grp is not null").select("grp").distinct()
    p = rel.predictions(s, d).select(F.col("target_group").alias("grp")).distinct()
    return r.intersect(p).withColumn("where", F.lit("both")).unionByName(r.subtract(p).withColumn("where", F.lit("records"))).unionByName(p.subtract(r).withColumn("where", F.lit("scores")))


def lacking(rows: DataFrame, cell: list[str], item: str, needed: list[str]) -> DataFrame:
    """(cell, missing): cells that lack some of the needed items."""
    seen = rows.groupBy(*cell).agg(F.collect_set(item).alias("seen"))
    missing = F.sort_array(F.array_except(F.array(*[F.lit(m) for m in needed]), F.col("seen")))
    return seen.withColumn("missing", missing).where(F.size("missing") > 0).select(*cell, "missing")


def _superset(s, d) -> DataFrame:
    """Cells that lack some of the evaluation's methods; of seed 13 two methods are planted to be left out."""
    from siftspark.operators.conformal import METHODS, decisions

    rows = decisions(stage(rel.scored(s, d), "scored")).where("seed <> 13 or method not in ('forced_argmax', 'prom_derived_union')")
    return lacking(rows, rel.GROUP, "method", METHODS)


QUERIES = {
    "set_union_all": _union,
    "set_merge_parts": lambda s, d: merged_parts(rel.predictions(s, d), "detector", ["target_group", "seed"]),
    "set_distinct_insert": lambda s, d: rel.records(s, d).where("key is not null").select("dataset", "key").dropDuplicates(),
    "set_equality": _equality,
    "set_intersect_union_count": _groups,
    "set_superset_methods": _superset,
}
def _superset_sql() -> str:
    from siftspark.operators.conformal import DECISIONS_SQL, METHODS

    return with_sql("cal tgt bud ev", f"""WITH {DECISIONS_SQL}, s AS (SELECT detector, target_group, seed, list(DISTINCT method) FILTER (seed <> 13 OR method NOT IN ('forced_argmax', 'prom_derived_union')) AS seen FROM de GROUP BY 1, 2, 3)
        SELECT detector, target_group, seed, list_sort(list_filter({METHODS}, lambda x: NOT list_contains(seen, x))) AS missing FROM s WHERE len(missing) > 0""")


ORACLE = {
    "set_union_all": with_sql("rec", """SELECT dataset, row_id, CASE WHEN dataset = 'primevul' THEN role END AS role,
        row_number() OVER (ORDER BY dataset DESC, first_position) - 1 AS position FROM rec WHERE dataset IN ('primevul', 'diversevul')"""),
    "set_merge_parts": with_sql("prd", "WITH k AS (SELECT target_group, seed, count(DISTINCT detector) AS k FROM prd GROUP BY 1, 2) SELECT count(*) AS n_keys, count(*) FILTER (k > 1) AS claimed_twice FROM k"),
    "set_distinct_insert": with_sql("rec", "SELECT DISTINCT dataset, key FROM rec WHERE key IS NOT NULL"),
    "set_equality": with_sql("rec", """WITH a AS (SELECT row_id FROM rec WHERE feature_position IS NOT NULL), b AS (SELECT row_id FROM (SELECT DISTINCT * FROM cache_locations))
        SELECT row_id, 'left' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT row_id, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""),
    "set_intersect_union_count": with_sql("rec prd", """WITH a AS (SELECT DISTINCT grp FROM rec WHERE dataset = 'diversevul' AND grp IS NOT NULL), b AS (SELECT DISTINCT target_group AS grp FROM prd)
        SELECT grp, CASE WHEN a.grp IS NULL THEN 'scores' WHEN b.grp IS NULL THEN 'records' ELSE 'both' END AS "where" FROM a FULL JOIN b USING (grp)"""),
    "set_superset_methods": _superset_sql(),
}
