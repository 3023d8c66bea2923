"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.canonical import bucket, number_name, sql_bucket
from siftspark.functions.text import presence, sql_presence
from siftspark.plans import relations as rel
from siftspark.plans.relations import BUDGETS, CLIP, PRIMARY, with_sql
from siftspark.runtime import table

SALT, OFFICIAL_SALT = "roles-1", "official-1"
ARTIFACT_NAME = r"^[A-Za-z0-9._-]+$"


def required(df: DataFrame, fields: list[str]) -> Column:
    """Whether none of the fields is blank."""
    out = F.lit(True)
    for f in fields:
        out = out & presence(F.col(f)).isNotNull()
    return out


def binary(c: Column) -> Column:
    """The label, or an error if it is neither 0 nor 1."""
    return F.when(c.isin(0, 1), c).otherwise(F.raise_error(F.concat(F.lit("not a binary label: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("int"))


def role(b: Column, train: int = 70, validation: int = 80) -> Column:
    return F.when(b < train, "train").when(b < validation, "model_validation").otherwise("calibration")


def official_role(split: Column, b: Column, cut: int = 50) -> Column:
    """train and test as given; the validation split halved by bucket."""
    return F.when(split == "train", "train").when(split == "test", "test").when(split == "valid", F.when(b < cut, "model_validation").otherwise("calibration"))


def alias_union(maps: list[DataFrame]) -> DataFrame:
    """(alias, project_group): the union of alias maps and each group's own name; `conflict` if an alias has two groups."""
    every = maps[0]
    for m in maps[1:]:
        every = every.unionByName(m)
    every = every.unionByName(every.select(F.col("project_group").alias("alias"), "project_group"))
    return every.groupBy("alias").agg(F.min("project_group").alias("project_group"), (F.countDistinct("project_group") > 1).alias("conflict"))


def clip(r: Column, upper: float = CLIP) -> Column:
    return F.greatest(F.lit(1.0 / upper), F.least(F.lit(upper), r))


def delta_class(d: Column, tolerance: float = 1e-15) -> Column:
    """The class of a change in a quantity of which less is better."""
    return F.when(d < -tolerance, "improved").when(d > tolerance, "worse").otherwise("tied")


def severe(v: Column, s: Column, av: Column, asafe: Column) -> Column:
    return F.greatest(v / av, s / asafe) > 0.5


def grid(spark: SparkSession) -> DataFrame:
    """The nine operating points; a fixed size."""
    return spark.createDataFrame(BUDGETS, "av double, asafe double")


def _required_counts(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "records").distinct()
    ok = required(r, ["project", "commit_id", "exact_code_key"])
    return r.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("valid"), F.count(F.when(~ok, 1)).alias("missing")
    )


def _alias_map(spark, folder) -> DataFrame:
    return rel.records(spark, folder).select("row_id", "project", "grp")


def _alias_union(spark, folder) -> DataFrame:
    given = table(spark, folder, "project_aliases").where("alias is not null and project_group is not null")
    own = rel.records(spark, folder).where("project is not null and grp is not null").select(F.col("project").alias("alias"), F.col("grp").alias("project_group")).distinct()
    return alias_union([given, own])


def _event_json(spark, folder) -> DataFrame:
    """The number k of the JSON column, also where it is written with single quotes; other texts give null."""
    e = table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.replace("props", F.lit('"'), F.lit("'"))).otherwise(F.col("props")).alias("props"))
    return e.select("event_id", F.from_json("props", "k long", {"allowSingleQuotes": "true"})["k"].alias("k"))


def _scores(s, d):
    return rel.predictions(s, d)


_ID = ["detector", "target_group", "seed", "side", "position"]
_IDS = ", ".join(_ID)
_PROBES = ["ok-1.npz", "no space", "", "ünsafe", "a/b", "x_y"]

QUERIES = {
    "filter_required_fields": _required_counts,
    "assert_binary_target": lambda s, d: rel.labels(s, d).select("row_id", binary(F.col("target")).alias("target")),
    "map_alias": _alias_map,
    "map_alias_union": _alias_union,
    "bucket_role": lambda s, d: rel.records(s, d).where("commit_id is not null").select("row_id", role(bucket(F.col("commit_id"), SALT, 100)).alias("role")),
    "bucket_role_official": lambda s, d: rel.records(s, d).where("dataset = 'primevul'").select("row_id", official_role(F.col("split"), bucket(F.col("row_id"), OFFICIAL_SALT, 100)).alias("role")),
    "filter_operating_point": lambda s, d: rel.with_budgets(_scores(s, d)).where((F.abs(F.col("av") - PRIMARY[0]) < 1e-12) & (F.abs(F.col("asafe") - PRIMARY[1]) < 1e-12)).select(*_ID, "av", "asafe"),
    "filter_method_isin": lambda s, d: _scores(s, d).where(F.col("detector").isin("hashing_sgd", "other") & F.col("seed").isin(13, 37)).select(*_ID, "p"),
    "json_extract_support": _event_json,
    "flatten_nested": lambda s, d: _scores(s, d).groupBy("detector", "seed").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("side")).alias("sides"))).alias("support")),
    "operating_key": lambda s, d: grid(s).select("av", "asafe", F.concat(F.lit("av"), number_name(F.col("av")), F.lit("_as"), number_name(F.col("asafe"))).alias("key")),
    "clip_weights": lambda s, d: _scores(s, d).select(*_ID, *[clip(F.col("ratio"), c).alias(f"w{c:g}") for c in rel.CLIPS]),
    "argmax_label": lambda s, d: _scores(s, d).select(*_ID, F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("forced"), F.when(F.col("p") > 0.5, 1).otherwise(0).alias("argmax")),
    "prob_matrix": lambda s, d: _scores(s, d).where((F.col("p") >= 0) & (F.col("p") <= 1)).select(*_ID, (1 - F.col("p")).alias("p0"), F.col("p").alias("p1")),
    "classify_delta": lambda s, d: _scores(s, d).select(*_ID, delta_class(F.col("ratio") - 1).alias("class")),
    "validate_artifact_name": lambda s, d: s.createDataFrame([(x,) for x in _PROBES], "name string").unionByName(rel.records(s, d).select(F.col("source_file").alias("name")).distinct()).select("name", F.col("name").rlike(ARTIFACT_NAME).alias("valid")),
    "severe_flag": lambda s, d: rel.with_budgets(_scores(s, d)).select(*_ID, "av", "asafe", severe(F.col("p"), F.col("p") / 2, F.col("av"), F.col("asafe")).alias("severe")),
}

_OK = " AND ".join(f"{sql_presence(f)} IS NOT NULL" for f in ("project", "commit_id", "exact_code_key"))
ORACLE = {
    "filter_required_fields": f"SELECT dataset, count(*) AS n, count(*) FILTER ({_OK}) AS valid, count(*) FILTER (NOT ({_OK})) AS missing FROM (SELECT DISTINCT * FROM records) GROUP BY 1",
    "assert_binary_target": with_sql("lab", "SELECT row_id, target FROM lab"),
    "map_alias": with_sql("rec", "SELECT row_id, project, grp FROM rec"),
    "map_alias_union": with_sql("rec", """WITH g AS (SELECT alias, project_group FROM project_aliases WHERE alias IS NOT NULL AND project_group IS NOT NULL
        UNION SELECT project, grp FROM rec WHERE project IS NOT NULL AND grp IS NOT NULL), u AS (SELECT * FROM g UNION SELECT project_group, project_group FROM g)
        SELECT alias, min(project_group) AS project_group, count(DISTINCT project_group) > 1 AS conflict FROM u GROUP BY 1"""),
    "bucket_role": with_sql("rec", f"""SELECT row_id, CASE WHEN b < 70 THEN 'train' WHEN b < 80 THEN 'model_validation' ELSE 'calibration' END AS role
        FROM (SELECT row_id, {sql_bucket('commit_id', SALT, 100)} AS b FROM rec WHERE commit_id IS NOT NULL)"""),
    "bucket_role_official": with_sql("rec", f"""SELECT row_id, CASE WHEN split IN ('train', 'test') THEN split WHEN split = 'valid' THEN
        CASE WHEN {sql_bucket('row_id', OFFICIAL_SALT, 100)} < 50 THEN 'model_validation' ELSE 'calibration' END END AS role FROM rec WHERE dataset = 'primevul'"""),
    "filter_operating_point": with_sql("prd bud", f"SELECT {_IDS}, av, asafe FROM prd, bud WHERE av = 0.1 AND asafe = 0.2"),
    "filter_method_isin": with_sql("prd", f"SELECT {_IDS}, p FROM prd WHERE detector IN ('hashing_sgd', 'other') AND seed IN (13, 37)"),
    "json_extract_support": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "flatten_nested": with_sql("prd", """SELECT detector, seed, to_json({n: count(*), sides: list_sort(list(DISTINCT side))})::VARCHAR AS support FROM prd GROUP BY 1, 2"""),
    "operating_key": with_sql("bud", "SELECT av, asafe, 'av' || replace(av::VARCHAR, '.', 'p') || '_as' || replace(asafe::VARCHAR, '.', 'p') AS key FROM bud"),
    "clip_weights": with_sql("prd", f"SELECT {_IDS}, " + ", ".join(f"greatest(1::DOUBLE / {c:g}, least({c:g}::DOUBLE, ratio)) AS w{c:g}" for c in rel.CLIPS) + " FROM prd"),
    "argmax_label": with_sql("prd", f"SELECT {_IDS}, (p >= 0.5)::INT AS forced, (p > 0.5)::INT AS argmax FROM prd"),
    "prob_matrix": with_sql("prd", f"SELECT {_IDS}, 1 - p AS p0, p AS p1 FROM prd WHERE p BETWEEN 0 AND 1"),
    "classify_delta": with_sql("prd", f"SELECT {_IDS}, CASE WHEN ratio - 1 < -1e-15 THEN 'improved' WHEN ratio - 1 > 1e-15 THEN 'worse' ELSE 'tied' END AS class FROM prd"),
    "validate_artifact_name": with_sql("rec", f"""WITH n AS (SELECT unnest({_PROBES!r}) AS name UNION ALL SELECT DISTINCT source_file FROM rec)
        SELECT name, regexp_matches(name, '{ARTIFACT_NAME}') AS valid FROM n"""),
    "severe_flag": with_sql("prd bud", f"SELECT {_IDS}, av, asafe, greatest(p / av, (p / 2) / asafe) > 0.5 AS severe FROM prd, bud"),
}
