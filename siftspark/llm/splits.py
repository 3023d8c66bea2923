"""Train, validation and test splits that part neither a project group nor a commit (problem 6).

Project groups that share a commit are bound. Minimum-edge contraction (forest.py) over the groups, with the most shared
commits as the least edge, builds a spanning forest that is kept as a table; its roots are the units. Units of similar
size form bands; within each band they are dealt to the splits systematically.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark.functions.text import presence, sql_presence
from siftspark.llm.forest import spanning_forest
from siftspark.operators.skew import join_hot, running
from siftspark.runtime import stage, table

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Units with at least this share of all records are placed one by one; there are at most 1 / LARGE of them.
LARGE = 0.001
#: Step of the systematic deal, the fractional part of the golden ratio (fixed value).
STEP = 0.6180339887498949


def commit(c: Column) -> Column:
    """The commit id if it counts: 40 hexadecimal digits, not all zero."""
    clean = F.lower(presence(c))
    return F.when(clean.rlike(r"\A[0-9a-f]{40}\z") & (clean != "0" * 40), clean)


def grouped(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """``records`` with `grp`, the group by alias, by project or, without one, as recorded, and `commit`."""
    r = records.withColumn("_p", presence(F.col("project"))).withColumn("_g", presence(F.col("project_group"))).withColumn("commit", commit(F.col("commit_id")))
    a = aliases.where("alias is not null").groupBy(F.col("alias").alias("_p")).agg(F.min("project_group").alias("_to"))
    # The alias table is small as a rule; it is left to the optimiser, by its size, whether it is broadcast.
    return r.join(a, "_p", "left").withColumn("grp", F.coalesce("_to", "_p", "_g")).drop("_p", "_g", "_to")


def named_records(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """(row_id, mark, grp, commit) of the distinct records. ``mark`` is a hash of all columns: it tells records apart
    that share what else is kept, and stands in for the rest of the row where rows are shuffled."""
    marked = grouped(records.withColumn("mark", F.xxhash64(*[F.col(c) for c in records.columns])), aliases)
    return marked.select("row_id", "mark", "grp", "commit").distinct()


def bonds(rows: DataFrame) -> DataFrame:
    """(a, b, w): groups that share commits, w being less the number of them that link the two.

    A commit of k groups gives k - 1 edges, from its least group to each other one, not one for each pair. Only group and
    commit are shuffled, once, and repeated rows are dropped before that.
    """
    pairs = stage(rows.where("grp is not null and commit is not null").select("grp", "commit").distinct(), "pairs")
    hubs = stage(pairs.groupBy("commit").agg(F.min("grp").alias("a"), F.count(F.lit(1)).alias("_k")).where("_k > 1"), "hubs")
    return join_hot(pairs, hubs.select("commit", "a"), "commit", hubs.select("commit", "_k")).where("grp <> a").groupBy("a", F.col("grp").alias("b")).agg((-F.count(F.lit(1))).alias("w"))


def bound_groups(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """(project_group, unit_group): each group bound to another, with the least name of its unit.

    Null or blank projects fall back on project_group, groups without either and commits that don't count bind
    nothing, repeated rows change nothing, empty tables give no rows.
    """
    return spanning_forest(bonds(grouped(records, aliases)))[1].select(F.col("node").alias("project_group"), F.col("root").alias("unit_group"))


def assign(records: DataFrame, aliases: DataFrame, proportions: dict[str, float] = PROPORTIONS) -> DataFrame:
    """(row_id, unit, split) of the distinct records; a unit is never parted.

    A record without a group goes with the unit of its commit, else with the records of that commit, else alone, named by
    its row_id or, without one, by a hash of its row. Units
    of at least LARGE of all records, at most 1,000, are given one by one, largest first, to the split that is furthest
    below its share. The rest is dealt by rank within its band of sizes (powers of two) in proportion to what the
    splits still lack.
    """
    rows = stage(named_records(records, aliases), "grouped")
    _, roots = spanning_forest(bonds(rows))
    named = rows.join(roots.withColumnRenamed("node", "grp"), "grp", "left").withColumn("unit", F.coalesce("root", "grp"))
    by_commit = named.where("unit is not null and commit is not null").groupBy("commit").agg(F.min("unit").alias("of_commit"))
    lone = named.where("unit is null").join(by_commit, "commit", "left")
    lone = lone.withColumn("unit", F.coalesce("of_commit", F.concat(F.lit("commit "), "commit"), F.concat(F.lit("record "), "row_id"), F.concat(F.lit("row "), F.col("mark").cast("string"))))
    placed = stage(named.where("unit is not null").select("row_id", "unit").unionByName(lone.select("row_id", "unit")), "placed")
    sizes = stage(placed.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = sizes.where(F.col("n") >= F.lit(LARGE * total)).orderBy(F.desc("n"), "unit").collect() if total else []
    names, lack = list(proportions), {k: v * total for k, v in proportions.items()}
    given = []
    for unit, n in large:
        to = max(names, key=lambda k: (lack[k], -names.index(k)))
        lack[to] -= n
        given.append((unit, to))
    rest = sum(max(x, 0) for x in lack.values()) or 1
    small = sizes.where(F.col("n") < F.lit(LARGE * total)).select(
        F.floor(F.log2("n")).cast("string").alias("band"), F.xxhash64("unit").alias("h"), "unit", "n"
    )
    ranked = running(small, "band", ["h", "unit"], "n", total="so_far", rank="place")
    x = (F.col("place") + F.lit(0.5)) * F.lit(STEP)
    x = x - F.floor(x)
    split, edge = F.lit(names[-1]), 1.0
    for k in reversed(names[1:]):
        edge -= max(lack[k], 0) / rest
        split = F.when(x < edge, F.lit(names[names.index(k) - 1])).otherwise(split)
    dealt = ranked.select("unit", split.alias("split"))
    if given:
        dealt = dealt.unionByName(records.sparkSession.createDataFrame(given, "unit string, split string"))
    return placed.join(dealt, "unit").select("row_id", "unit", "split")


def shares(assigned: DataFrame) -> DataFrame:
    """(split, n_units, n_records, share): what the splits got."""
    units = assigned.groupBy("split", "unit").agg(F.count(F.lit(1)).alias("n"))
    got = units.groupBy("split").agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("n_records"))
    return got.withColumn("share", F.round(F.col("n_records") / F.sum("n_records").over(Window.partitionBy()), 6))


def _tables(f):
    return lambda spark, folder: f(table(spark, folder, "records"), table(spark, folder, "project_aliases"))


QUERIES = {
    "p6_found": _tables(bound_groups),
    "p6_forest": _tables(lambda r, a: spanning_forest(bonds(grouped(r, a)))[0]),
    "p6_splits": _tables(assign),
    "p6_shares": _tables(lambda r, a: shares(assign(r, a))),
}

ORACLE = {
    "p6_found": f"""
    WITH RECURSIVE r AS (SELECT DISTINCT * FROM records),
    g AS (SELECT coalesce(a.project_group, {sql_presence('r.project')}, {sql_presence('r.project_group')}) AS grp,
                 lower({sql_presence('commit_id')}) AS c
          FROM r LEFT JOIN project_aliases a ON a.alias = {sql_presence('r.project')}),
    p AS (SELECT DISTINCT grp, c FROM g WHERE grp IS NOT NULL AND regexp_full_match(c, '[0-9a-f]{{40}}') AND c <> repeat('0', 40)),
    h AS (SELECT c, min(grp) AS a FROM p GROUP BY c HAVING count(*) > 1),
    e AS (SELECT DISTINCT a, grp AS b FROM p JOIN h USING (c) WHERE a <> grp),
    u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT DISTINCT x AS node, x AS seen FROM u UNION SELECT node, y FROM reach JOIN u ON x = seen)
    SELECT node AS project_group, min(seen) AS unit_group FROM reach GROUP BY node""",
}
