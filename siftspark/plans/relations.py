"""The cleaned relations that the operators' queries start from, as DataFrames and as common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.text import presence, sql_presence
from siftspark.runtime import table

#: Risk budgets, seeds, clips and salts of the evaluation (fixed values).
BUDGETS = [(a, b) for a in (0.01, 0.05, 0.1) for b in (0.05, 0.1, 0.2)]
PRIMARY = (0.1, 0.2)
SEEDS = (13, 37, 73, 101, 137)
CLIPS = (10.0, 20.0, 50.0)
CLIP = 20.0
#: Scores of one detector and seed share their thresholds; results are kept per target group.
CELL = ["detector", "seed"]
GROUP = ["detector", "target_group", "seed"]


def aliases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "project_aliases").where("alias is not null").groupBy("alias").agg(F.min("project_group").alias("to_group"))


def record_split(origin_split: Column, source_file: Column) -> Column:
    """The split of a record: as stated, in lower case, else the one its file names; null if neither says."""
    said, file = F.lower(presence(origin_split)), F.lower(presence(source_file))
    named = F.when(file.startswith("diversevul"), F.lit("external")).otherwise(F.nullif(F.regexp_extract(file, r"(train|validation|valid|val|test|external)\.jsonl\z", 1), F.lit("")))
    split = F.coalesce(said, named)
    return F.when(split.isin("val", "validation"), F.lit("valid")).otherwise(split)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct records, trimmed, with `split` and `grp` (group by alias, project or as recorded)."""
    r = table(spark, folder, "records").distinct()
    r = r.select(
        "row_id", "dataset",
        record_split(F.col("origin_split"), F.col("source_file")).alias("split"),
        "source_file", "line_number", presence(F.col("project")).alias("project"), presence(F.col("project_group")).alias("given"),
        F.lower(presence(F.col("commit_id"))).alias("commit_id"), presence(F.col("source_role")).alias("role"),
        F.lower(presence(F.col("exact_code_key"))).alias("key"), "first_position", "feature_position", "conflicting_label", "ingested_at",
    )
    a = aliases(spark, folder)
    return r.join(a, r["project"] == a["alias"], "left").withColumn("grp", F.coalesce("to_group", "project", "given")).drop("alias", "to_group", "given")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, target): the latest target that isn't null."""
    return (
        table(spark, folder, "labels").where("target is not null and row_id is not null")
        .groupBy("row_id").agg(F.max(F.struct("labelled_at", "target")).alias("l")).select("row_id", F.col("l.target").alias("target"))
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).join(labels(spark, folder), "row_id")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct scores with both numbers, as detector, target_group, seed, side, position, row_id, p, ratio."""
    return (
        table(spark, folder, "predictions").where("p_vulnerable is not null and ratio is not null").distinct()
        .select("detector", "target_group", "seed", "side", "position", "row_id", F.col("p_vulnerable").alias("p"), "ratio")
    )


def scored(spark: SparkSession, folder: str, side: str | None = None) -> DataFrame:
    """Predictions with their label `y`."""
    p = predictions(spark, folder).join(labels(spark, folder).withColumnRenamed("target", "y"), "row_id")
    return p if side is None else p.where(F.col("side") == side)


def with_budgets(df: DataFrame, points: list[tuple[float, float]] = BUDGETS) -> DataFrame:
    """Each row at each operating point (av, asafe), all nine if not told otherwise: an array of literals, no join."""
    options = F.array(*[F.struct(F.lit(a).alias("av"), F.lit(b).alias("asafe")) for a, b in points])
    return df.withColumn("_b", F.explode(options)).select(*df.columns, "_b.av", "_b.asafe")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


_FILE = sql_presence("source_file")
CTES = {
    "ali": "SELECT alias, min(project_group) AS to_group FROM project_aliases WHERE alias IS NOT NULL GROUP BY 1",
    "rec0": f"""SELECT row_id, dataset,
        coalesce(lower({sql_presence('origin_split')}), CASE WHEN lower({_FILE}) LIKE 'diversevul%' THEN 'external'
            ELSE nullif(regexp_extract(lower({_FILE}), '(train|validation|valid|val|test|external)\\.jsonl\\z', 1), '') END) AS split0,
        source_file, line_number, {sql_presence('project')} AS project, {sql_presence('project_group')} AS given,
        lower({sql_presence('commit_id')}) AS commit_id, {sql_presence('source_role')} AS role,
        lower({sql_presence('exact_code_key')}) AS key, first_position, feature_position, conflicting_label, ingested_at
        FROM (SELECT DISTINCT * FROM records)""",
    "rec": """SELECT row_id, dataset, CASE WHEN split0 IN ('val', 'validation') THEN 'valid' ELSE split0 END AS split, source_file,
        line_number, project, commit_id, role, key, first_position, feature_position, conflicting_label, ingested_at,
        coalesce(to_group, project, given) AS grp FROM rec0 LEFT JOIN ali ON project = alias""",
    "lab": "SELECT row_id, arg_max(target, (labelled_at, target)) AS target FROM labels WHERE target IS NOT NULL GROUP BY 1",
    "rl": "SELECT rec.*, target FROM rec JOIN lab USING (row_id)",
    "prd": """SELECT DISTINCT detector, target_group, seed, side, position, row_id, p_vulnerable AS p, ratio FROM predictions
        WHERE p_vulnerable IS NOT NULL AND ratio IS NOT NULL""",
    "ev": "SELECT prd.*, target AS y FROM prd JOIN lab USING (row_id)",
    "cal": "SELECT * FROM ev WHERE side = 'calibration'",
    "tgt": "SELECT * FROM ev WHERE side = 'target'",
    "bud": "SELECT * FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in BUDGETS) + ") AS t(av, asafe)",
}
_NEEDS = {"rec0": [], "rec": ["ali", "rec0"], "rl": ["rec", "lab"], "ev": ["prd", "lab"], "cal": ["ev"], "tgt": ["ev"]}


def with_sql(names: str, query: str) -> str:
    """``query`` after the named expressions and those they need."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, []):
            need(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    body = query.strip()
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
