"""Results per project for `records` and `cache_locations`, without a task per heavy project (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.text import presence, sql_presence
from siftspark.operators.skew import keyed_states, running
from siftspark.runtime import stage, table

HEAVY_PERCENT = 2


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    def one(name: str) -> DataFrame:
        return table(spark, folder, name).select(
            F.lit(name).alias("table_name"), presence(F.col("project")).alias("project"), "row_id", F.col("feature_position").alias("at")
        )

    return one("records").unionByName(one("cache_locations"))


def project_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, rows with a feature position and first and last position of every (table, project).

    A null project stands for rows without one; repeated rows count. Empty tables give no rows.
    """
    return keyed_states(
        _rows(spark, folder),
        ["table_name", "project"],
        ["row_id"],
        {
            "n_rows": (F.lit(1), "count"),
            "n_placed": (F.col("at"), "count"),
            "first_at": (F.col("at"), "min"),
            "last_at": (F.col("at"), "max"),
        },
    )


def heavy_projects(spark: SparkSession, folder: str, percent: int = HEAVY_PERCENT) -> DataFrame:
    """Projects with at least ``percent`` % of all rows of their table.

    The totals are sums over the same states, combined map-side; there is one row for each of the two tables, which is
    the proven bound of the broadcast side.
    """
    states = stage(keyed_states(_rows(spark, folder), ["table_name", "project"], ["row_id"], {"n_rows": (F.lit(1), "count")}), "states")
    totals = states.groupBy("table_name").agg(F.sum("n_rows").alias("all_rows"))
    return (
        states.where(F.col("project").isNotNull())
        .join(F.broadcast(totals), "table_name")
        .where(F.col("n_rows") * 100 >= F.col("all_rows") * percent)
        .select("table_name", "project")
    )


def project_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Rank of each distinct record within its project by (ingested_at, row_id), and the rows so far with a commit."""
    rows = (
        table(spark, folder, "records")
        .distinct()
        .select(
            presence(F.col("project")).alias("project"),
            "ingested_at",
            "row_id",
            F.col("commit_id").isNotNull().cast("long").alias("has_commit"),
        )
    )
    return running(rows, "project", ["ingested_at", "row_id"], "has_commit", total="commits_so_far", rank="place").select(
        "project", "row_id", "place", "commits_so_far"
    )


QUERIES = {"p5_found": heavy_projects, "p5_projects": project_rows, "p5_ranks": project_ranks}

_UNION = f"""
    SELECT 'records' AS table_name, {sql_presence('project')} AS project, feature_position AS pos FROM records
    UNION ALL SELECT 'cache_locations', {sql_presence('project')}, feature_position AS pos FROM cache_locations"""

ORACLE = {
    "p5_found": f"""
        WITH r AS ({_UNION}), t AS (SELECT table_name, count(*) AS n FROM r GROUP BY 1)
        SELECT r.table_name, r.project FROM r JOIN t USING (table_name) WHERE r.project IS NOT NULL
        GROUP BY r.table_name, r.project, t.n HAVING count(*) * 100 >= t.n * {HEAVY_PERCENT}""",
    "p5_projects": f"""
        WITH r AS ({_UNION})
        SELECT table_name, project, count(*) AS n_rows, count(pos) AS n_placed, min(pos) AS first_at, max(pos) AS last_at
        FROM r GROUP BY 1, 2""",
    "p5_ranks": f"""
        WITH r AS (SELECT DISTINCT * FROM records),
        s AS (SELECT {sql_presence('project')} AS project, ingested_at, row_id, commit_id FROM r)
        SELECT project, row_id,
               row_number() OVER (PARTITION BY project ORDER BY ingested_at NULLS FIRST, row_id NULLS FIRST) AS place,
               count(commit_id) OVER (PARTITION BY project ORDER BY ingested_at NULLS FIRST, row_id NULLS FIRST
                   ROWS UNBOUNDED PRECEDING) AS commits_so_far FROM s""",
}
