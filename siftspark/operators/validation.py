"""Integrity checks: each query gives the violations, or one row that counts them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions import minhash as mh
from siftspark.operators import metrics as mt
from siftspark.operators import statistics as st
from siftspark.operators.lsh import _CLS
from siftspark.operators.sets import repeated
from siftspark.plans import relations as rel
from siftspark.plans.relations import SEEDS, with_sql
from siftspark.runtime import stage, table

#: Columns that must not leave the row level.
BANNED = ["text", "token_blob", "signature_blob", "target", "p_vulnerable"]
SIGNATURE_BYTES = 1024


def bounds(df: DataFrame, unit: list[str], least: dict[str, float]) -> DataFrame:
    """(column, nulls, outside): nulls, and values outside 0..1 or below a least one."""
    one = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")) for c in unit]
    two = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"), F.lit(lo).alias("lo"), F.lit(float("inf")).alias("hi")) for c, lo in least.items()]
    x = df.select(F.explode(F.array(*one, *two)).alias("x")).select("x.*")
    return x.groupBy("column").agg(F.count(F.when(F.col("v").isNull(), 1)).alias("nulls"), F.count(F.when((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi")), 1)).alias("outside"))


def incomplete(df: DataFrame, cell: list[str], item: str, expected: list) -> DataFrame:
    """Cells that lack some of the expected items."""
    seen = df.groupBy(*cell).agg(F.collect_set(item).alias("_s"))
    missing = F.sort_array(F.array_except(F.array(*[F.lit(x) for x in expected]), F.col("_s")))
    return seen.withColumn("missing", missing).where(F.size("missing") > 0).select(*cell, "missing")


def banned_columns(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Row-level columns of the named tables."""
    found = [(n, c) for n in names for c in table(spark, folder, n).columns if c in BANNED]
    return spark.createDataFrame(found, "table_name string, column string")


def sealed(inventory: DataFrame, observed: DataFrame) -> DataFrame:
    """(name, status) of items that are missing, unexpected or differ between two (name, digest) tables."""
    j = inventory.withColumnRenamed("digest", "_a").join(observed.withColumnRenamed("digest", "_b"), "name", "full")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(F.col("_a") != F.col("_b"), "differs")
    return j.withColumn("status", status).where("status is not null").select("name", "status")


def _seal(s, d) -> DataFrame:
    """The exact keys of documents that state one, against those of their texts; of the latter, those of ids that leave 1,
    2 and 3 over 7 are planted to be left out, altered and added under a negative id."""
    from siftspark.functions.canonical import exact_key

    x = rel.documents(s, d).where("text is not null and exact_code_key is not null").withColumn("_k", F.col("doc_id") % 7)
    stated = x.select(F.col("doc_id").cast("string").alias("name"), F.col("exact_code_key").alias("digest"))
    own = x.where("_k <> 1").withColumn("digest", F.when(F.col("_k") == 2, F.reverse(exact_key(F.col("text")))).otherwise(exact_key(F.col("text"))))
    names = F.when(F.col("_k") == 3, F.array("doc_id", -F.col("doc_id"))).otherwise(F.array("doc_id"))
    return sealed(stated, own.select(F.explode(names).alias("name"), "digest").withColumn("name", F.col("name").cast("string")))


def _frozen(s, d) -> DataFrame:
    """Rows and distinct keys of every table with the number that must be unique."""
    r, c, a = table(s, d, "records").distinct(), table(s, d, "cache_locations").distinct(), table(s, d, "project_aliases")
    parts = [(r, "records", "row_id"), (c, "cache_locations", "feature_position"), (a, "project_aliases", "alias"), (table(s, d, "documents"), "documents", "doc_id")]
    out = None
    for df, name, key in parts:
        x = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"))
        out = x if out is None else out.unionByName(x)
    return out


def rederived(means: DataFrame, stated: DataFrame) -> DataFrame:
    """(detector, method, status) of stated attainment, (detector, method, groups, attained), against a count from metric
    rows in another way: `agrees`, `differs`, or on which side it is `missing` or `unexpected`."""
    two = means.withColumn("ok", (F.col("max_relative_violation") == 0).cast("int")).groupBy("detector", "method").agg(F.sum("ok").alias("a2"), F.countDistinct("target_group").alias("g2"))
    same = (F.col("attained") == F.col("a2")) & (F.col("groups") == F.col("g2"))
    status = F.when(F.col("g2").isNull(), "unexpected").when(F.col("groups").isNull(), "missing").when(same, "agrees").otherwise("differs")
    return stated.join(two, ["detector", "method"], "full").select("detector", "method", status.alias("status"))


def _rederived(s, d) -> DataFrame:
    """The method summary, in which `forced_argmax` is planted to be one off and `prom_derived_lac` to be left out."""
    m = stage(st.seed_means(mt.fold_metrics(s, d).where(st._primary()), st.OUTCOMES), "means")
    one = st.attained(m, ["detector", "method"]).select("detector", "method", "groups", "attained").where("method <> 'prom_derived_lac'")
    return rederived(m, one.withColumn("attained", F.col("attained") + (F.col("method") == "forced_argmax").cast("int")))


def gate_agreement(status: DataFrame) -> DataFrame:
    """Whether passing shares agree with the rule that all seeds pass."""
    return status.select("detector", "clip", "av", "asafe", ((F.col("pass_rate") == 1) == F.col("pass_all")).alias("agrees"))


def _gate_check(s, d) -> DataFrame:
    """The gate's status, in which `pass_all` is planted to be wrong for clip 50."""
    return gate_agreement(st._gate_status(s, d).withColumn("pass_all", F.col("pass_all") != (F.col("clip") == 50)))


def _cross_dataset(s, d) -> DataFrame:
    """Exact keys that stand in both corpora, by number of records."""
    r = rel.records(s, d).where("key is not null").groupBy("key").agg(F.count(F.when(F.col("dataset") == "primevul", 1)).alias("n_source"), F.count(F.when(F.col("dataset") == "diversevul", 1)).alias("n_target"))
    return r.where("n_source > 0 and n_target > 0")


def _efficiency(s, d) -> DataFrame:
    f = st._executed(s, d).groupBy("detector").agg(F.count(F.lit(1)).alias("fits"), F.min("n").alias("least"), F.countDistinct("target_group").alias("groups"))
    return f.withColumn("positive", F.col("least") > 0)


def _reopened(s, d) -> DataFrame:
    """An index that is written and opened again; copies with a cut signature and of another seed are planted to be refused."""
    from siftspark.operators import lsh
    from siftspark.operators.files import _path, refused

    sets = lsh.token_classes(s, d)
    good, damaged, other = (_path(s, n) for n in ("index", "damaged", "other"))
    lsh.write_index(sets, good)
    bad = s.read.parquet(f"{good}/signatures").withColumn("signature", F.when(F.col("cid") % 5 == 0, F.slice("signature", 1, 8)).otherwise(F.col("signature")))
    bad.write.parquet(f"{damaged}/signatures")
    for path, seed in ((damaged, mh.SEED), (other, "another")):
        s.read.parquet(f"{good}/documents").write.parquet(f"{path}/documents")
        s.read.json(f"{good}/manifest").withColumn("seed", F.lit(seed)).write.json(f"{path}/manifest")
    s.read.parquet(f"{good}/signatures").write.parquet(f"{other}/signatures")
    no = [refused(lambda: lsh.open_index(s, p), why) for p, why in ((damaged, "signatures"), (other, "parameters"))]  # noqa: B023
    index = lsh.open_index(s, good)
    n = index.documents.agg(F.count(F.lit(1)).alias("n_documents")).withColumn("_1", F.lit(1))
    k = index.signatures.agg(F.count(F.lit(1)).alias("n_classes"), (F.count(F.lit(1)) * mh.BANDS).alias("n_bands")).withColumn("_1", F.lit(1))
    return n.join(k, "_1").select("n_documents", "n_classes", "n_bands", F.lit(no[0]).alias("damaged_refused"), F.lit(no[1]).alias("other_seed_refused"))


MEMORY = "executor string, tasks long, max_memory long, memory_used long, peak_heap long, peak_off_heap long"


def executor_memory(spark: SparkSession) -> DataFrame:
    """Per executor, the driver among them: tasks done, storage memory at most and in use, and the peaks of heap and
    off-heap memory that its heartbeats told (null before the first). One row for each executor."""
    held = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    rows = []
    for i in range(held.size()):
        e = held.apply(i)
        peaks = e.peakMemoryMetrics()
        peak = [peaks.get().getMetricValue(n) if peaks.isDefined() else None for n in ("JVMHeapMemory", "JVMOffHeapMemory")]
        rows.append((e.id(), e.totalTasks(), e.maxMemory(), e.memoryUsed(), *peak))
    return spark.createDataFrame(rows, MEMORY)


def _monitored(s, d) -> DataFrame:
    """The memory of the executors after an aggregation over the largest table."""
    table(s, d, "records").groupBy("project").agg(F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return executor_memory(s)


QUERIES = {
    "res_rss_monitor": _monitored,
    "val_unique_key": lambda s, d: repeated(table(s, d, "records"), ["row_id"]),
    "val_grid_complete": lambda s, d: incomplete(rel.predictions(s, d), ["detector", "target_group"], "seed", list(SEEDS)),
    "val_bounds": lambda s, d: bounds(table(s, d, "predictions"), ["p_vulnerable"], {"ratio": 0.0}),
    "val_seal": _seal,
    "val_cross_dataset": _cross_dataset,
    "val_signature_len": lambda s, d: rel.documents(s, d).groupBy("dataset").agg(F.count("signature_blob").alias("stated"), F.count(F.when(F.length("signature_blob") != SIGNATURE_BYTES, 1)).alias("wrong"), F.count(F.when(F.col("signature_blob").isNull(), 1)).alias("missing")),
    "val_rederive_summary": _rederived,
    "val_gate_summary": _gate_check,
    "val_banned_columns": lambda s, d: banned_columns(s, d, ["records", "labels", "documents", "predictions", "cache_locations", "mix_targets"]),
    "val_frozen_inputs": _frozen,
    "val_efficiency": _efficiency,
    "val_evidence_counts": lambda s, d: mt.fold_metrics(s, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("av", "asafe").alias("points")),
    "open_existing_index": _reopened,
    "scan_manifest_by_line": lambda s, d: repeated(table(s, d, "records"), ["source_file", "line_number"]),
}

ORACLE = {
    "val_unique_key": "SELECT row_id, count(*) AS n FROM records GROUP BY 1 HAVING count(*) > 1",
    "val_grid_complete": with_sql("prd", f"""WITH s AS (SELECT detector, target_group, list(DISTINCT seed) AS seen FROM prd GROUP BY 1, 2), m AS (SELECT *, list_sort(list_filter({list(SEEDS)}::INT[], lambda x: NOT list_contains(seen, x))) AS missing FROM s)
        SELECT detector, target_group, missing FROM m WHERE len(missing) > 0"""),
    "val_bounds": """SELECT 'p_vulnerable' AS "column", count(*) FILTER (p_vulnerable IS NULL) AS nulls, count(*) FILTER (p_vulnerable < 0 OR p_vulnerable > 1) AS outside FROM predictions
        UNION ALL SELECT 'ratio', count(*) FILTER (ratio IS NULL), count(*) FILTER (ratio < 0) FROM predictions""",
    "val_seal": """SELECT (CASE doc_id % 7 WHEN 3 THEN -doc_id ELSE doc_id END)::VARCHAR AS name, CASE doc_id % 7 WHEN 1 THEN 'missing' WHEN 2 THEN 'differs' ELSE 'unexpected' END AS status
        FROM documents WHERE text IS NOT NULL AND exact_code_key IS NOT NULL AND doc_id % 7 IN (1, 2, 3)""",
    "val_cross_dataset": with_sql("rec", """SELECT key, count(*) FILTER (dataset = 'primevul') AS n_source, count(*) FILTER (dataset = 'diversevul') AS n_target FROM rec WHERE key IS NOT NULL GROUP BY 1
        HAVING count(*) FILTER (dataset = 'primevul') > 0 AND count(*) FILTER (dataset = 'diversevul') > 0"""),
    "val_signature_len": f"SELECT dataset, count(signature_blob) AS stated, count(*) FILTER (octet_length(signature_blob) <> {SIGNATURE_BYTES}) AS wrong, count(*) FILTER (signature_blob IS NULL) AS missing FROM documents GROUP BY 1",
    "val_rederive_summary": mt.metrics_sql(f"""WITH {st._MEANS}, g AS (SELECT DISTINCT detector, method FROM sm WHERE {st._P})
        SELECT *, CASE method WHEN 'forced_argmax' THEN 'differs' WHEN 'prom_derived_lac' THEN 'missing' ELSE 'agrees' END AS status FROM g"""),
    "val_gate_summary": st._rules_sql("SELECT detector, clip, av, asafe, (avg(full_ok::INT) = 1) = (bool_and(full_ok) <> (clip = 50)) AS agrees FROM rg GROUP BY 1, 2, 3, 4"),
    "val_banned_columns": f"""SELECT table_name, column_name AS "column" FROM information_schema.columns WHERE column_name IN ({', '.join(f"'{b}'" for b in BANNED)}) AND table_name IN ('records', 'labels', 'documents', 'predictions', 'cache_locations', 'mix_targets')""",
    "val_frozen_inputs": """SELECT 'records' AS table_name, count(*) AS n_rows, count(DISTINCT row_id) AS n_keys FROM (SELECT DISTINCT * FROM records)
        UNION ALL SELECT 'cache_locations', count(*), count(DISTINCT feature_position) FROM (SELECT DISTINCT * FROM cache_locations)
        UNION ALL SELECT 'project_aliases', count(*), count(DISTINCT alias) FROM project_aliases UNION ALL SELECT 'documents', count(*), count(DISTINCT doc_id) FROM documents""",
    "val_efficiency": with_sql("prd", """WITH f AS (SELECT detector, target_group, seed, count(*) AS n FROM prd GROUP BY 1, 2, 3), e AS (SELECT * FROM f QUALIFY detector = 'hashing_sgd' OR seed = min(seed) OVER (PARTITION BY detector, target_group))
        SELECT detector, count(*) AS fits, min(n) AS least, count(DISTINCT target_group) AS groups, min(n) > 0 AS positive FROM e GROUP BY 1"""),
    "val_evidence_counts": mt.metrics_sql("SELECT method, count(*) AS n, count(DISTINCT (av, asafe)) AS points FROM mx GROUP BY 1"),
    "open_existing_index": f"WITH {_CLS} SELECT count(*) AS n_documents, (SELECT count(*) FROM c) AS n_classes, {mh.BANDS} * (SELECT count(*) FROM c) AS n_bands, true AS damaged_refused, true AS other_seed_refused FROM d",
    "scan_manifest_by_line": "SELECT source_file, line_number, count(*) AS n FROM records GROUP BY 1, 2 HAVING count(*) > 1",
}
