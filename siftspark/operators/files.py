"""Queries over sources and sinks: each writes with one of the writers into the shared folder and reads that back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.text import SPACE
from siftspark.plans import relations as rel
from siftspark.plans.relations import with_sql
from siftspark.runtime import shared_dir, table
from siftspark.sources import lines, sinks
from siftspark.sources.arrays import local, registered

LABEL_NAMES = {"target", "label", "labels", "y"}
_CSV_ORDER = ["detector", "target_group", "seed", "side", "position"]
PREDICTION = "detector string, target_group string, seed int, side string, position long, row_id string, p double, ratio double"


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/files/{name}-{uuid.uuid4().hex}"


def label_free(df: DataFrame) -> DataFrame:
    """``df``, or an error if it has a label column."""
    bad = LABEL_NAMES & {c.lower() for c in df.columns}
    if bad:
        raise ValueError(f"label columns in metadata: {sorted(bad)}")
    return df


def contiguous(df: DataFrame, position: str) -> DataFrame:
    """One row: whether the positions are 0, 1, ... n - 1 without gaps or repeats."""
    return df.agg(F.count(F.lit(1)).alias("n"), ((F.min(position) == 0) & (F.max(position) == F.count(F.lit(1)) - 1) & (F.countDistinct(position) == F.count(F.lit(1)))).alias("contiguous"))


def _ordered_scan(s, d) -> DataFrame:
    """Source records as JSON lines per split, read back with their line numbers in split order."""
    r = rel.records(s, d).where("dataset = 'primevul'")
    paths = []
    for split in lines.SPLIT_ORDER:
        paths.append(_path(s, f"primevul_{split}.jsonl"))
        lines.write_jsonl(r.where(F.col("split") == split), paths[-1], ["first_position"], ["row_id", "project", "commit_id"])
    return lines.read_jsonl(s, paths, "row_id string, project string, commit_id string")


def _single_scan(s, d) -> DataFrame:
    """External records as one source; those without a required field drop out, the rest get dense positions."""
    from siftspark.operators.windows import dense_position

    p = _path(s, "diversevul.jsonl")
    lines.write_jsonl(rel.records(s, d).where("dataset = 'diversevul'"), p, ["first_position"], ["row_id", "project", "commit_id", "key"])
    j = lines.read_jsonl(s, [p], "row_id string, project string, commit_id string, key string").where("project is not null and commit_id is not null and key is not null")
    return dense_position(j.withColumn("g", F.lit("all")), "g", ["line_number"]).select("row_id", "position")


def _csv(s, d) -> DataFrame:
    p = _path(s, "scores.csv.gz")
    sinks.write_csv(rel.predictions(s, d), p, _CSV_ORDER)
    return sinks.read_csv(s, p, PREDICTION)


def _manifest(s, d) -> DataFrame:
    """Positions of the external manifest after a round through compressed CSV."""
    p = _path(s, "manifest.csv.gz")
    m = rel.records(s, d).where("dataset = 'diversevul'").select("first_position", "row_id", "grp")
    sinks.write_csv(m, p, ["first_position"])
    return sinks.read_csv(s, p, "first_position long, row_id string, grp string")


def _label_free(s, d) -> DataFrame:
    return label_free(rel.records(s, d).where("dataset = 'primevul' and feature_position is not null").select("feature_position", "row_id", "source_file", "line_number"))


def _json(s, d) -> DataFrame:
    p = _path(s, "mix.json")
    sinks.write_json(table(s, d, "mix_targets"), p)
    return s.read.schema("source string, target_share double, max_repeats int").json(p)


def _arrays(s, d) -> DataFrame:
    """Scores kept as archives of arrays, one for each task, and read back."""
    p = _path(s, "scores")
    registered(s)
    rel.predictions(s, d).write.format("npz").mode("append").save(p)
    return s.read.format("npz").schema(PREDICTION).option("range", 200).load(p)


def _arrays_whole(s, d) -> DataFrame:
    """A table's content before and after a round through archives, files left unfinished, and whether a second write is refused."""
    p = _path(s, "whole")
    registered(s)
    df = rel.predictions(s, d)
    df.write.format("npz").mode("append").save(p)
    unfinished = sum(f.startswith(".") for f in os.listdir(local(p)))
    a, b = sinks.content_digest(df).withColumnRenamed("digest", "before"), sinks.content_digest(s.read.format("npz").schema(PREDICTION).load(p)).withColumnRenamed("digest", "after")
    again = refused(lambda: df.write.format("npz").mode("append").save(p), "exists already")
    return a.join(b, "n").select("n", (F.col("before") == F.col("after")).alias("same"), F.lit(unfinished).cast("long").alias("unfinished"), F.lit(again).alias("refused"))


def refused(write, reason: str) -> bool:
    """Whether ``write`` fails for that reason; any other error is an error."""
    try:
        write()
    except Exception as x:
        if reason not in str(x):
            raise
        return True
    return False


def _database(s, d) -> DataFrame:
    """Documents kept in SQLite files, opened for reading only: rows and characters by dataset."""
    p = _path(s, "documents")
    registered(s)
    rel.documents(s, d).select("doc_id", "dataset", "n_chars").write.format("sqlite").option("table", "documents").mode("append").save(p)
    t = s.read.format("sqlite").schema("dataset string, n_chars long").option("table", "documents").option("range", 500).load(p)
    return t.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


def _mapped(s, d) -> DataFrame:
    """Embeddings kept as matrices and read through memory maps: rows, width and the sum of all numbers."""
    p = _path(s, "embeddings")
    registered(s)
    table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>")).write.format("npy").mode("append").save(p)
    t = s.read.format("npy").option("range", 100).load(p)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return t.groupBy(F.size("vector").cast("long").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 3).alias("total"))


def _packages(s, d) -> DataFrame:
    """Labelled scores in a folder for each group; per group the rows of each side and label."""
    p = _path(s, "packages")
    sinks.write_parquet(rel.scored(s, d).withColumn("folder", F.col("target_group")), p, ["folder"])
    t = s.read.parquet(p)
    n = lambda side, y: F.count(F.when((F.col("side") == side) & (F.col("y") == y), 1)).alias(f"{side}_{y}")
    return t.groupBy("target_group").agg(*[n(side, y) for side in ("calibration", "target") for y in (0, 1)])


def _same_bytes(s, d) -> DataFrame:
    """Rows, and whether the files of two writes of one table are the same byte for byte."""
    df, seen = rel.predictions(s, d).repartition(4, "row_id").sortWithinPartitions(*_CSV_ORDER), []
    for _ in range(2):
        p = _path(s, "twice.csv.gz")
        sinks.write_csv(df, p, _CSV_ORDER)
        # One row for each file; the name of a part is its number and an id of the write.
        seen.append(sorted((r["file"][:10], r["digest"]) for r in sinks.inventory(s, p).where("file like 'part-%'").collect()))
    return df.agg(F.count(F.lit(1)).alias("n"), F.lit(seen[0] == seen[1] and bool(seen[0])).alias("same_bytes"))


def _json_whole(s, d) -> DataFrame:
    """Rows of JSON lines, whether a reader finds a finished folder, and whether a second write is refused."""
    p = _path(s, "mix-once")
    t = table(s, d, "mix_targets")
    sinks.write_json(t, p)
    done = os.path.exists(os.path.join(local(p), "_SUCCESS")) and not os.path.exists(os.path.join(local(p), "_temporary"))
    again = refused(lambda: sinks.write_json(t, p), "PATH_ALREADY_EXISTS")
    return s.read.schema(t.schema).json(p).agg(F.count(F.lit(1)).alias("n"), F.lit(done).alias("finished"), F.lit(again).alias("refused"))


def _sidecar(s, d) -> DataFrame:
    """Record ids kept as plain lines beside a manifest, aligned by line; both lengths and the unequal lines."""
    m = rel.records(s, d).where("dataset = 'diversevul'").select("first_position", "row_id")
    p = _path(s, "ids.txt")
    m.repartitionByRange("first_position").sortWithinPartitions("first_position").select("row_id").write.text(p)
    from siftspark.operators.windows import dense_position

    left = dense_position(m.withColumn("g", F.lit("all")), "g", ["first_position"]).select((F.col("position") + 1).alias("line_number"), "row_id")
    right = lines.numbered_lines(s, [p]).select("line_number", F.col("value").alias("side_id"))
    j = left.join(right, "line_number", "full")
    return j.agg(F.count("row_id").alias("n_left"), F.count("side_id").alias("n_right"), F.count(F.when(~F.col("row_id").eqNullSafe(F.col("side_id")), 1)).alias("unequal"))


def _split_sink(s, d) -> DataFrame:
    p = _path(s, "vault")
    sinks.split_labels(rel.labelled(s, d).select("row_id", "first_position", "dataset", "target"), "target", "first_position", p)
    m, v = label_free(s.read.parquet(f"{p}/metadata")), s.read.parquet(f"{p}/labels")
    return m.join(v, ["row_id", "first_position"]).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("vulnerable"))


def _union_schema(s, d) -> DataFrame:
    """Tables of different columns as one, lacking values null."""
    a = rel.predictions(s, d).where("side = 'target'").select("row_id", "p")
    return a.unionByName(rel.predictions(s, d).where("side = 'calibration'").select("row_id", "ratio"), allowMissingColumns=True)


def _append(s, d) -> DataFrame:
    p = _path(s, "phases")
    for side in ("calibration", "target"):
        sinks.append_phase(rel.predictions(s, d).where(F.col("side") == side).drop("side"), p, side)
    return s.read.parquet(p).groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("ids"))


def _seal(s, d) -> DataFrame:
    """A seal of each seed's scores against a copy in which seed 13 is left out, seed 37 altered and seed 999 added."""
    from siftspark.operators.validation import sealed

    def seal(df: DataFrame) -> DataFrame:
        row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
        return df.groupBy(F.col("seed").cast("string").alias("name")).agg(F.concat_ws("-", F.count(F.lit(1)).cast("string"), F.sum(row.cast("decimal(38,0)")).cast("string")).alias("digest"))

    p, df = _path(s, "sealed"), rel.predictions(s, d)
    added = df.where("seed = 73").withColumn("seed", F.lit(999))
    sinks.write_parquet(df.where("seed <> 13").withColumn("p", F.when(F.col("seed") == 37, F.col("p") / 2).otherwise(F.col("p"))).unionByName(added), p)
    return sealed(seal(df), seal(s.read.parquet(p)))


def _refused(s, d) -> DataFrame:
    """Per kind of sink whether a second write to the same path is refused, for the reason that it exists."""
    t, found = table(s, d, "mix_targets"), []
    kinds = {
        "json": sinks.write_json, "parquet": sinks.write_parquet, "csv": lambda df, p: sinks.write_csv(df, p, ["source"]),
        "labels": lambda df, p: sinks.split_labels(df.withColumn("row_id", F.col("source")).withColumn("y", F.lit(1)), "y", "max_repeats", p),
    }
    for kind, write in kinds.items():
        p = _path(s, f"once-{kind}")
        write(t, p)
        found.append((kind, refused(lambda: write(t, p), "PATH_ALREADY_EXISTS"), s.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).count() > 0))  # noqa: B023
    return s.createDataFrame(found, "kind string, refused boolean, kept boolean")


def _figures(s, d) -> DataFrame:
    """What a figure of automation per group plots: mean, least and greatest score, in order."""
    g = rel.predictions(s, d).groupBy("detector", "target_group").agg(F.round(F.avg("p"), 9).alias("mean"), F.min("p").alias("least"), F.max("p").alias("most"))
    return g


def _bibliography(s, d) -> DataFrame:
    """Entries of a bibliography in braces notation: kind, key, normalised title."""
    from siftspark.sources.bibliography import entries

    p = _path(s, "refs")
    shapes = [
        "@article{doc%d,\n  title = {Notes {on} %s \\& \\'{E}t\\'{e}},\n  year = {2020}\n}\n",
        "@InProceedings{doc%d,\n  booktitle = {Proceedings of nothing},\n  title = \"Notes on %s {\\'E}t\\'e\",\n  year = 2021\n}\n",
        "@comment{nothing here}\n@string{x = {y}}\n@book(doc%d,\n  TITLE={Notes \\emph{on}\n    %s \\textbf{\\'Et{\\'e}}},\n)\n",
        "@misc{doc%d,\n  note = {%s},\n  title = {Notes on nothing}}\n",
    ]
    k, value = F.col("doc_id") % len(shapes), F.lit(None)
    for i, shape in enumerate(shapes):
        value = F.when(k == i, F.format_string(shape, "doc_id", "source")).otherwise(value)
    sample = rel.documents(s, d).where("dataset = 'context' and text is not null and source is not null").select(value.alias("value"))
    sample.write.text(p)
    return entries(s, p)


def _titles(s, d, f) -> DataFrame:
    from siftspark.sources import bibliography as b

    heads, k, head = ["Notes {on} ", "\\emph{Notes} on ", "N{\\^o}tes \\\"on ", "{\\textbf Notes} {{on}} "], F.col("doc_id") % 4, F.lit(None)
    for i, h in enumerate(heads):
        head = F.when(k == i, F.lit(h)).otherwise(head)
    t = rel.documents(s, d).select("doc_id", F.concat(head, "source").alias("t"), F.concat(F.lit("Notes on "), "lang").alias("u"))
    return f(t, b)


def _snapshot(s, d) -> DataFrame:
    """Allowed columns of the tables, copied under another path, with rows and columns of each copy."""
    from siftspark.operators.validation import BANNED

    out = None
    for name in ("records", "predictions", "mix_targets", "project_aliases"):
        p, t = _path(s, f"snapshot-{name}"), table(s, d, name)
        sinks.write_parquet(t.drop(*BANNED), p)
        copy = s.read.parquet(p)
        x = copy.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), F.lit(len(copy.columns)).cast("long").alias("columns"))
        out = x if out is None else out.unionByName(x)
    return out


_ROW = "detector, target_group, seed, side, position, row_id, p, ratio"
QUERIES = {
    "scan_jsonl_ordered": _ordered_scan,
    "scan_jsonl_single": _single_scan,
    "scan_manifest_gz": _manifest,
    "scan_manifest_labelfree": _label_free,
    "scan_csv": _csv,
    "scan_json": _json,
    "scan_npz": _arrays,
    "scan_sqlite_ro": _database,
    "scan_memmap": _mapped,
    "scan_rowid_sidecar": _sidecar,
    "scan_bibtex": _bibliography,
    "fn_strip_latex": lambda s, d: _titles(s, d, lambda t, b: t.select("doc_id", b.strip_markup(F.col("t")).alias("title"))),
    "fn_normalize_title": lambda s, d: _titles(s, d, lambda t, b: t.select("doc_id", b.normal_title(b.strip_markup(F.col("t"))).alias("title"))),
    "fn_similarity": lambda s, d: _titles(s, d, lambda t, b: t.select("doc_id", F.round(b.similarity(*[b.normal_title(b.strip_markup(F.col(x))) for x in ("t", "u")]), 6).alias("similarity"))),
    "sink_snapshot": _snapshot,
    "sink_gz_csv_det": _same_bytes,
    "sink_split_meta_labels": _split_sink,
    "sink_fold_packages": _packages,
    "sink_npz_atomic": _arrays_whole,
    "sink_json_atomic": _json_whole,
    "sink_csv_union_schema": _union_schema,
    "sink_csv": _append,
    "sink_seal": _seal,
    "sink_no_overwrite": _refused,
    "sink_figures": _figures,
    "val_contiguous": lambda s, d: contiguous(rel.records(s, d).where("dataset = 'diversevul'"), "first_position"),
}
_PKG = with_sql("ev", "SELECT target_group, " + ", ".join(f"count(*) FILTER (side = '{side}' AND y = {y}) AS {side}_{y}" for side in ("calibration", "target") for y in (0, 1)) + " FROM ev GROUP BY 1")
_ORD = "CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 WHEN 'test' THEN 2 END"
ORACLE = {
    "scan_jsonl_ordered": with_sql("rec", f"""SELECT ({_ORD})::INT AS file_ord, row_number() OVER (PARTITION BY split ORDER BY first_position) AS line_number, row_id, project, commit_id FROM rec
        WHERE dataset = 'primevul' AND split IN ('train', 'valid', 'test')"""),
    "scan_jsonl_single": with_sql("rec", "SELECT row_id, row_number() OVER (ORDER BY first_position) - 1 AS position FROM rec WHERE dataset = 'diversevul' AND project IS NOT NULL AND commit_id IS NOT NULL AND key IS NOT NULL"),
    "scan_manifest_gz": with_sql("rec", "SELECT first_position, row_id, grp FROM rec WHERE dataset = 'diversevul'"),
    "scan_manifest_labelfree": with_sql("rec", "SELECT feature_position, row_id, source_file, line_number FROM rec WHERE dataset = 'primevul' AND feature_position IS NOT NULL"),
    "scan_csv": with_sql("prd", f"SELECT {_ROW} FROM prd"),
    "sink_gz_csv_det": with_sql("prd", "SELECT count(*) AS n, true AS same_bytes FROM prd"),
    "scan_json": "SELECT * FROM mix_targets",
    "sink_json_atomic": "SELECT count(*) AS n, true AS finished, true AS refused FROM mix_targets",
    "scan_npz": with_sql("prd", f"SELECT {_ROW} FROM prd"),
    "sink_fold_packages": _PKG,
    "scan_sqlite_ro": "SELECT dataset, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1",
    "scan_memmap": "SELECT len(embedding) AS width, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 3) AS total FROM embeddings GROUP BY 1",
    "scan_rowid_sidecar": with_sql("rec", "SELECT count(*) AS n_left, count(*) AS n_right, 0::BIGINT AS unequal FROM rec WHERE dataset = 'diversevul'"),
    "scan_bibtex": """WITH x AS (SELECT doc_id, doc_id % 4 AS k, trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) AS s FROM documents WHERE dataset = 'context' AND text IS NOT NULL AND source IS NOT NULL)
        SELECT ['article', 'inproceedings', 'book', 'misc'][k + 1] AS kind, 'doc' || doc_id AS key, CASE k WHEN 3 THEN 'notes on nothing' ELSE 'notes on ' || s || ' et e' END AS title FROM x""",
    "fn_strip_latex": f"SELECT doc_id, trim(regexp_replace(CASE doc_id % 4 WHEN 2 THEN 'N\\^otes \\\"on ' ELSE 'Notes on ' END || source, '{SPACE}+', ' ', 'g')) AS title FROM documents",
    "fn_normalize_title": "SELECT doc_id, trim(regexp_replace(lower(CASE doc_id % 4 WHEN 2 THEN 'n otes on ' ELSE 'Notes on ' END || source), '[^a-z0-9]+', ' ', 'g')) AS title FROM documents",
    "sink_snapshot": """SELECT 'records' AS table_name, count(*) AS n, 14::BIGINT AS columns FROM records UNION ALL SELECT 'predictions', count(*), 7 FROM predictions
        UNION ALL SELECT 'mix_targets', count(*), 3 FROM mix_targets UNION ALL SELECT 'project_aliases', count(*), 2 FROM project_aliases""",
    "sink_split_meta_labels": with_sql("rl", "SELECT dataset, count(*) AS n, sum(target)::BIGINT AS vulnerable FROM rl GROUP BY 1"),
    "sink_npz_atomic": with_sql("prd", "SELECT count(*) AS n, true AS same, 0::BIGINT AS unfinished, true AS refused FROM prd"),
    "sink_seal": with_sql("prd", """SELECT DISTINCT CASE seed WHEN 73 THEN '999' ELSE seed::VARCHAR END AS name, CASE seed WHEN 13 THEN 'missing' WHEN 37 THEN 'differs' ELSE 'unexpected' END AS status
        FROM prd WHERE seed IN (13, 37, 73)"""),
    "sink_csv_union_schema": with_sql("prd", "SELECT row_id, CASE WHEN side = 'target' THEN p END AS p, CASE WHEN side <> 'target' THEN ratio END AS ratio FROM prd"),
    "sink_csv": with_sql("prd", "SELECT side AS phase, count(*) AS n, count(DISTINCT row_id) AS ids FROM prd GROUP BY 1"),
    "sink_no_overwrite": "SELECT unnest(['json', 'parquet', 'csv', 'labels']) AS kind, true AS refused, true AS kept",
    "sink_figures": with_sql("prd", "SELECT detector, target_group, round(avg(p), 9) AS mean, min(p) AS least, max(p) AS most FROM prd GROUP BY 1, 2"),
    "val_contiguous": with_sql("rec", """SELECT count(*) AS n, min(first_position) = 0 AND max(first_position) = count(*) - 1 AND count(DISTINCT first_position) = count(*) AS contiguous FROM rec WHERE dataset = 'diversevul'"""),
}
