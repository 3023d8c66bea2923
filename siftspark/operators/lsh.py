"""Near-duplicates of the source corpus in the target corpus: bands, candidates, exact check, exclusions.

Documents with equal token sets are one class, so copies meet once; counts per document and pair come back from class
sizes, not from an expansion into pairs. Texts are read once, into a table of token sets. Those are of the short tokens,
which SQL can repeat, or of the lexer's, which the audit of code asks for (the `_lexer` queries).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions import lexer
from siftspark.functions import minhash as mh
from siftspark.functions.canonical import short_tokens, sql_canonical
from siftspark.operators import scalars
from siftspark.plans import relations as rel
from siftspark.plans.relations import with_sql
from siftspark.runtime import stage

SOURCE, TARGET = "primevul", "diversevul"
#: Classes of either side that a unit of a band's bucket holds, about.
TILE = 512


@dataclass
class Sets:
    """docs: (doc_id, dataset, row_id, set_key) of both corpora; classes: (cid, tokens, n, n_source, n_target), one for
    each token set, named by the least doc_id."""

    docs: DataFrame
    classes: DataFrame


def token_classes(spark: SparkSession, folder: str, lexed: bool = False) -> Sets:
    return classes_of(rel.documents(spark, folder).where(F.col("dataset").isin(SOURCE, TARGET) & F.col("text").isNotNull()), lexed)


def classes_of(d: DataFrame, lexed: bool = False) -> Sets:
    keep = ["doc_id", "dataset", "row_id"]
    t = lexer.with_tokens(d, keep) if lexed else d.select(*keep, F.array_sort(F.array_distinct(short_tokens(F.col("text")))).alias("tokens"))
    t = stage(t.withColumn("set_key", F.sha2(F.to_json("tokens"), 256)), "tokens")
    c = t.groupBy("set_key").agg(
        F.min("doc_id").alias("cid"),
        F.count(F.when(F.col("dataset") == SOURCE, 1)).alias("n_source"),
        F.count(F.when(F.col("dataset") == TARGET, 1)).alias("n_target"),
    )
    held = c.join(t.select(F.col("doc_id").alias("cid"), "tokens"), "cid")
    return Sets(t.drop("tokens"), stage(held.select("cid", "set_key", "tokens", F.size("tokens").alias("n"), "n_source", "n_target"), "classes"))


def members(spark: SparkSession, folder: str, sets: Sets) -> DataFrame:
    """(doc_id, dataset, row_id, grp, cid) of both corpora's documents."""
    g = rel.records(spark, folder).select("dataset", "row_id", "grp")
    return sets.docs.join(sets.classes.select("set_key", "cid"), "set_key").join(g, ["dataset", "row_id"], "left").select("doc_id", "dataset", "row_id", "grp", "cid")


def candidates(classes: DataFrame, t: float = mh.THRESHOLD, tile: int = TILE) -> DataFrame:
    """(target, source): classes that share a band key and whose sizes allow Jaccard >= t; a class may meet itself.

    Buckets without both sides drop out before the join. In larger ones each side is cut into tiles, and every pair of
    tiles is a join key of its own. A pair that shares several bands comes from the first of them only, so nothing needs
    to be made distinct.
    """
    keep = ["cid", "n", "n_source", "n_target"]
    signed = mh.with_signature(classes, keep).select(*keep, mh.band_keys().alias("keys"))
    b = stage(signed, "bands").select(*keep, "keys", F.posexplode("keys").alias("band", "key"))
    sizes = b.groupBy("band", "key").agg(*[F.ceil(F.count(F.when(F.col(c) > 0, 1)) / tile).cast("int").alias(g) for c, g in (("n_source", "_gs"), ("n_target", "_gt"))]).where("_gs > 0 and _gt > 0")
    units = b.join(sizes, ["band", "key"])

    def side(count: str, mine: str, other: str, name: str, letter: str) -> DataFrame:
        own, facing = F.pmod(F.xxhash64("cid"), F.col(f"_g{mine}").cast("long")).cast("int"), F.sequence(F.lit(0), F.col(f"_g{other}") - 1)
        return units.where(F.col(count) > 0).select("band", "key", own.alias(f"_{mine}"), F.explode(facing).alias(f"_{other}"), F.col("cid").alias(name), F.col("n").alias(f"n_{letter}"), F.col("keys").alias(f"keys_{letter}"))

    x, s = side("n_target", "t", "s", "target", "t"), side("n_source", "s", "t", "source", "s")
    lo, hi = F.least("n_s", "n_t"), F.greatest("n_s", "n_t")
    fits = (hi == 0) | ((lo > 0) & (lo / F.greatest(hi, F.lit(1)) >= t))
    first = F.array_position(F.zip_with("keys_t", "keys_s", lambda p, q: p == q), True) - 1
    return x.join(s, ["band", "key", "_t", "_s"]).where(fits & (first == F.col("band"))).select("target", "source")


#: What an index must have been made with, and of how many rows.
MANIFEST = "functions int, bands int, rows int, seed string, n_documents long, n_classes long"


@dataclass
class Index:
    """documents: (doc_id, dataset, row_id, cid); signatures: (cid, n, n_source, n_target, signature)."""

    documents: DataFrame
    signatures: DataFrame


def write_index(sets: Sets, path: str) -> None:
    """Documents, signatures and a manifest under ``path``; an error if there is something already."""
    spark = sets.classes.sparkSession
    docs = sets.docs.join(sets.classes.select("set_key", "cid"), "set_key").select("doc_id", "dataset", "row_id", "cid")
    docs.write.mode("errorifexists").parquet(f"{path}/documents")
    mh.with_signature(sets.classes, ["cid", "n", "n_source", "n_target"]).write.mode("errorifexists").parquet(f"{path}/signatures")
    row = (mh.FUNCTIONS, mh.BANDS, mh.ROWS, mh.SEED, sets.docs.count(), sets.classes.count())
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def open_index(spark: SparkSession, path: str) -> Index:
    """The index under ``path``, or a ValueError if it isn't whole: other parameters or columns, other counts than its
    manifest's, signatures of a wrong length, or documents of a class that isn't there. One aggregate for each table."""
    m = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    if m is None or (m["functions"], m["bands"], m["rows"], m["seed"]) != (mh.FUNCTIONS, mh.BANDS, mh.ROWS, mh.SEED):
        raise ValueError(f"the index under {path} has other parameters")
    docs, signed = spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/signatures")
    if docs.columns != ["doc_id", "dataset", "row_id", "cid"] or signed.columns != ["cid", "n", "n_source", "n_target", "signature"]:
        raise ValueError(f"the index under {path} has other columns")
    d = docs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    g = signed.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cid").alias("ids"), F.count(F.when(F.size("signature") != mh.FUNCTIONS, 1)).alias("bad"), F.sum(F.col("n_source") + F.col("n_target")).alias("of")).first()
    if g["bad"]:
        raise ValueError(f"{g['bad']} signatures under {path} have another length")
    if (d["n"], d["ids"], g["n"], g["ids"], g["of"] or 0) != (m["n_documents"], m["n_documents"], m["n_classes"], m["n_classes"], m["n_documents"]):
        raise ValueError(f"the index under {path} has other counts than its manifest")
    if docs.join(signed.select("cid"), "cid", "left_anti").limit(1).count():
        raise ValueError(f"documents under {path} belong to no class")
    return Index(docs, signed)


def verified(pairs: DataFrame, classes: DataFrame, t: float = mh.THRESHOLD) -> DataFrame:
    """(target, source, common, either): the pairs with Jaccard >= t, counted on the tokens."""
    a = classes.select(F.col("cid").alias("target"), F.col("tokens").alias("x"))
    b = classes.select(F.col("cid").alias("source"), F.col("tokens").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    p = pairs.join(a, "target").join(b, "source").withColumn("common", common).withColumn("either", F.size("x") + F.size("y") - common)
    return p.where(mh.jaccard(F.col("common"), F.col("either")) >= t).select("target", "source", "common", "either")


def _flagged(spark, folder, lexed: bool = False) -> tuple[Sets, DataFrame]:
    sets = token_classes(spark, folder, lexed)
    return sets, stage(verified(candidates(sets.classes), sets.classes), "flagged")


def _flagged_targets(spark, folder, lexed: bool = False) -> DataFrame:
    """Per flagged target document: its class, its pairs with source documents and the greatest Jaccard among them."""
    sets, f = _flagged(spark, folder, lexed)
    size = sets.classes.select(F.col("cid").alias("source"), "n_source")
    per = f.join(size, "source").groupBy(F.col("target").alias("cid")).agg(F.sum("n_source").alias("n_pairs"), F.max(mh.jaccard(F.col("common"), F.col("either"))).alias("j"))
    m = members(spark, folder, sets).where(F.col("dataset") == TARGET)
    return m.join(per, "cid").select("doc_id", "row_id", "cid", "n_pairs", F.round("j", 10).alias("jaccard"))


def _affected(spark, folder) -> DataFrame:
    sets, f = _flagged(spark, folder)
    per = f.join(sets.classes.select(F.col("cid").alias("source"), "n_source"), "source").groupBy(F.col("target").alias("cid")).agg(F.sum("n_source").alias("k"))
    m = members(spark, folder, sets).where(F.col("dataset") == TARGET).join(per, "cid")
    return m.groupBy("grp").agg(F.countDistinct("row_id").alias("n_targets"), F.sum("k").alias("n_pairs"))


def _clean(spark, folder) -> DataFrame:
    """Target documents that no flagged pair holds."""
    sets, f = _flagged(spark, folder)
    return members(spark, folder, sets).where(F.col("dataset") == TARGET).join(f.select(F.col("target").alias("cid")), "cid", "left_anti").select("doc_id", "row_id", "grp")


def _candidate_docs(spark, folder) -> DataFrame:
    """The verified pairs with, of each class, the least document of the side it stands for."""
    sets, f = _flagged(spark, folder)
    of = sets.docs.join(sets.classes.select("set_key", "cid"), "set_key").groupBy("cid", "dataset").agg(F.min(F.struct("doc_id", "row_id")).alias("d"))
    a = of.where(F.col("dataset") == TARGET).select(F.col("cid").alias("target"), F.col("d.doc_id").alias("target_doc"), F.col("d.row_id").alias("target_row"))
    b = of.where(F.col("dataset") == SOURCE).select(F.col("cid").alias("source"), F.col("d.doc_id").alias("source_doc"), F.col("d.row_id").alias("source_row"))
    return f.join(a, "target").join(b, "source").select("target", "source", "target_doc", "target_row", "source_doc", "source_row", "common", "either")


def incomplete(banded: DataFrame) -> DataFrame:
    """(cid, n): documents of (cid, band) rows that haven't each band once."""
    g = banded.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("band").alias("k"))
    return g.where((F.col("n") != mh.BANDS) | (F.col("k") != mh.BANDS)).select("cid", "n")


def _stored_bands(spark, folder) -> DataFrame:
    """(cid, band) of the bands of the stored signatures: eight values each, so a missing or short blob lacks bands."""
    d = rel.documents(spark, folder).where("text is not null")
    held = F.floor(F.coalesce(F.length("signature_blob"), F.lit(0)) / (8 * mh.ROWS)).cast("int")
    return d.select(F.col("doc_id").alias("cid"), F.explode_outer(F.when(held > 0, F.sequence(F.lit(1), held))).alias("band"))


def _band_counts(spark, folder) -> DataFrame:
    """Per document count of bands, how many documents have it, and whether that is all bands: (n, documents, complete)."""
    g = _stored_bands(spark, folder).groupBy("cid").agg(F.count("band").alias("n"))
    return g.groupBy("n").agg(F.count(F.lit(1)).alias("documents")).withColumn("complete", F.col("n") == mh.BANDS)


def _token_summary(spark, folder) -> DataFrame:
    m = scalars._short_sets(spark, folder).join(rel.documents(spark, folder).select("doc_id", "dataset"), "doc_id").where("tokens is not null")
    n = F.size("tokens").cast("long")
    return m.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.min(n), F.lit(0)).alias("least"), F.coalesce(F.max(n), F.lit(0)).alias("most"), F.round(F.avg(n), 9).alias("mean"), F.count(F.when(n == 0, 1)).alias("empty")
    )


def _counts(spark, folder) -> DataFrame:
    sets, f = _flagged(spark, folder)
    c = sets.classes
    size = c.select(F.col("cid").alias("source"), "n_source")
    p = f.join(size, "source").join(c.select(F.col("cid").alias("target"), "n_target"), "target")
    pairs = p.agg(F.coalesce(F.sum(F.col("n_source") * F.col("n_target")), F.lit(0)).alias("n_pairs")).withColumn("_", F.lit(1))
    d = c.agg(F.sum("n_source").alias("n_source"), F.sum("n_target").alias("n_target"), F.min("cid").alias("first_id"), F.max("cid").alias("last_class")).withColumn("_", F.lit(1))
    return d.join(pairs, "_").drop("_")


def inserted_twice(pairs: DataFrame, again: DataFrame) -> DataFrame:
    """(target, source, state): what a second insertion of pairs does: `same`, `changed` or `new`."""
    kept = pairs.select("target", "source", F.col("common").alias("c2"), F.col("either").alias("e2"))
    same = (F.col("c2") == F.col("common")) & (F.col("e2") == F.col("either"))
    return again.join(kept, ["target", "source"], "left").select("target", "source", F.when(F.col("c2").isNull(), "new").when(same, "same").otherwise("changed").alias("state"))


def _stable(spark, folder) -> DataFrame:
    """How many pairs a second run of the check finds the same, after a third of them (by target) were altered and as many left out."""
    sets, f = _flagged(spark, folder)
    kept = f.where(F.col("target") % 3 != 0).withColumn("common", F.col("common") + (F.col("target") % 3 == 1).cast("int"))
    return inserted_twice(kept, verified(f.select("target", "source"), sets.classes)).groupBy("state").agg(F.count(F.lit(1)).alias("n_pairs"))


def _retained_counts(spark, folder) -> DataFrame:
    return _clean(spark, folder).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def _recall(spark, folder, lexed: bool = False) -> DataFrame:
    """(exact_pairs, found): class pairs whose sets share at least nine tenths, by a join on the tokens that such a pair
    must share, and those of them that the bands found."""
    sets, f = _flagged(spark, folder, lexed)
    exact = stage(exact_pairs(sets.classes), "exact")
    both = exact.join(f, ["target", "source"], "left")
    return both.agg(F.count(F.lit(1)).alias("exact_pairs"), F.count("common").alias("found"))


def exact_pairs(classes: DataFrame, tenths: int = 9) -> DataFrame:
    """(target, source) with Jaccard >= tenths / 10: sets that share one of their n - ceil(tenths n / 10) + 1 rarest tokens,
    counted on the tokens, and classes with both sides. Tokens of one set only make no pair."""
    rows = classes.where("n > 0").select("cid", "n", "n_source", "n_target", F.explode("tokens").alias("token"))
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ranked = rows.join(often, "token").groupBy("cid", "n", "n_source", "n_target").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("t"))
    # Tokens of this set alone come first in the order; what they leave of the prefix is taken.
    take = F.col("n") - F.ceil(F.col("n") * tenths / 10) + 1 - (F.col("n") - F.size("t"))
    keys = ranked.where(take > 0).select("cid", "n", "n_source", "n_target", F.explode(F.slice("t", F.lit(1), take.cast("int"))).alias("k"))
    x = keys.where("n_target > 0").select("k.token", F.col("cid").alias("target"), F.col("n").alias("nt"))
    y = keys.where("n_source > 0").select("k.token", F.col("cid").alias("source"), F.col("n").alias("ns"))
    near = x.join(y, "token").where((F.col("target") != F.col("source")) & (F.least("nt", "ns") * 10 >= F.greatest("nt", "ns") * tenths)).select("target", "source").distinct()
    equal = classes.where("n_source > 0 and n_target > 0").select(F.col("cid").alias("target"), F.col("cid").alias("source"))
    return verified(near, classes, tenths / 10).select("target", "source").unionByName(equal)


QUERIES = {
    "join_lsh_bands": lambda s, d: candidates(token_classes(s, d).classes),
    "join_lsh_bands_lexer": lambda s, d: candidates(token_classes(s, d, True).classes),
    "join_lsh_recall": _recall,
    "join_lsh_recall_lexer": lambda s, d: _recall(s, d, True),
    "agg_flagged_targets_lexer": lambda s, d: _flagged_targets(s, d, True),
    "join_candidate_docs": _candidate_docs,
    "join_anti_flagged": _clean,
    "agg_flagged_targets": _flagged_targets,
    "agg_affected_projects": _affected,
    "agg_count_distinct": lambda s, d: _flagged_targets(s, d).agg(F.countDistinct("row_id").alias("n_targets")),
    "agg_counts": _counts,
    "agg_having_incomplete": lambda s, d: incomplete(_stored_bands(s, d)),
    "agg_token_summary": _token_summary,
    "agg_retained_by_project": _retained_counts,
    "val_pair_idempotent": _stable,
    "val_band_complete": _band_counts,
}

_CLS = f"""d AS (SELECT doc_id, dataset, row_id, list_sort(list_distinct(regexp_extract_all({sql_canonical('text')}, '{scalars.cn.SHORT}'))) AS tokens
    FROM documents WHERE dataset IN ('{SOURCE}', '{TARGET}') AND text IS NOT NULL),
  c AS (SELECT min(doc_id) AS cid, tokens, len(tokens) AS n, count(*) FILTER (dataset = '{SOURCE}') AS n_source, count(*) FILTER (dataset = '{TARGET}') AS n_target FROM d GROUP BY tokens)"""
_BANDS = f"""{_CLS}, h AS (SELECT cid, {mh.sql_token_hash('token')} AS x FROM (SELECT cid, unnest(tokens) AS token FROM c)),
  co AS (SELECT i, (1 + {scalars.cn.sql_hash_prefix(f"'{mh.SEED}|' || i")} % {mh.PRIME - 1})::BIGINT AS a, (('0x' || substr(sha256('{mh.SEED}|' || i), 17, 16))::UBIGINT % {mh.PRIME})::BIGINT AS b FROM range({mh.FUNCTIONS}) t(i)),
  m AS (SELECT cid, i, min((a::HUGEINT * x + b) % {mh.PRIME})::BIGINT AS v FROM h, co GROUP BY 1, 2),
  k AS (SELECT cid, i // {mh.ROWS} AS band, list(v ORDER BY i) AS key FROM m GROUP BY 1, 2),
  q AS (SELECT k.*, n, n_source, n_target FROM k JOIN c USING (cid)),
  cand AS (SELECT DISTINCT t.cid AS target, s.cid AS source FROM q t JOIN q s USING (band, key) WHERE t.n_target > 0 AND s.n_source > 0 AND least(t.n, s.n) / greatest(t.n, s.n) >= 0.9
    UNION SELECT a.cid, b.cid FROM c a, c b WHERE a.n = 0 AND b.n = 0 AND a.n_target > 0 AND b.n_source > 0)"""
_FLAG = f"""{_BANDS}, f0 AS (SELECT target, source, len(list_intersect(a.tokens, b.tokens)) AS common, a.n + b.n AS total FROM cand JOIN c a ON a.cid = target JOIN c b ON b.cid = source),
  f AS (SELECT target, source, common::INT AS common, (total - common)::INT AS either FROM f0 WHERE CASE WHEN total = 0 THEN 1 ELSE common / (total - common) END >= 0.9),
  mem AS (SELECT d.doc_id, d.dataset, d.row_id, c.cid FROM d JOIN c ON d.tokens = c.tokens)"""
_J = "CASE WHEN either = 0 THEN 1.0 ELSE common / either END"
ORACLE = {
    "join_lsh_bands": f"WITH {_BANDS} SELECT target, source FROM cand",
    "join_candidate_docs": f"""WITH {_FLAG} SELECT f.target, f.source, a.doc_id AS target_doc, a.row_id AS target_row, b.doc_id AS source_doc, b.row_id AS source_row, common, either FROM f
        JOIN (SELECT cid, min(doc_id) AS doc_id, arg_min(row_id, doc_id) AS row_id FROM mem WHERE dataset = '{TARGET}' GROUP BY 1) a ON a.cid = f.target
        JOIN (SELECT cid, min(doc_id) AS doc_id, arg_min(row_id, doc_id) AS row_id FROM mem WHERE dataset = '{SOURCE}' GROUP BY 1) b ON b.cid = f.source""",
    "join_lsh_recall": f"""WITH {_FLAG}, e AS (SELECT a.cid AS target, b.cid AS source FROM c a JOIN c b ON a.n_target > 0 AND b.n_source > 0 AND least(a.n, b.n) >= 0.9 * greatest(a.n, b.n)
        WHERE (a.n = 0 AND b.n = 0) OR len(list_intersect(a.tokens, b.tokens)) * 19 >= 9 * (a.n + b.n)) SELECT count(*) AS exact_pairs, count(f.target) AS found FROM e LEFT JOIN f USING (target, source)""",
    "join_anti_flagged": with_sql("rec", f"WITH {_FLAG} SELECT doc_id, mem.row_id, grp FROM mem LEFT JOIN rec USING (dataset, row_id) WHERE dataset = '{TARGET}' AND cid NOT IN (SELECT target FROM f)"),
    "agg_flagged_targets": f"""WITH {_FLAG}, p AS (SELECT target, sum(n_source)::BIGINT AS n_pairs, round(max({_J}), 10) AS jaccard FROM f JOIN c ON cid = source GROUP BY 1)
        SELECT doc_id, row_id, cid, n_pairs, jaccard FROM mem JOIN p ON cid = target WHERE dataset = '{TARGET}'""",
    "agg_affected_projects": with_sql("rec", f"""WITH {_FLAG}, p AS (SELECT target, sum(n_source)::BIGINT AS k FROM f JOIN c ON cid = source GROUP BY 1)
        SELECT grp, count(DISTINCT mem.row_id) AS n_targets, sum(k)::BIGINT AS n_pairs FROM mem JOIN p ON cid = target LEFT JOIN rec USING (dataset, row_id) WHERE dataset = '{TARGET}' GROUP BY 1"""),
    "agg_count_distinct": f"WITH {_FLAG} SELECT count(DISTINCT row_id) AS n_targets FROM mem WHERE dataset = '{TARGET}' AND cid IN (SELECT target FROM f)",
    "agg_counts": f"""WITH {_FLAG} SELECT (SELECT sum(n_source) FROM c)::BIGINT AS n_source, (SELECT sum(n_target) FROM c)::BIGINT AS n_target, (SELECT min(cid) FROM c) AS first_id,
        (SELECT max(cid) FROM c) AS last_class, (SELECT coalesce(sum(b.n_source * a.n_target), 0) FROM f JOIN c a ON a.cid = target JOIN c b ON b.cid = source)::BIGINT AS n_pairs""",
    "agg_having_incomplete": f"""WITH h AS (SELECT doc_id AS cid, coalesce(octet_length(signature_blob), 0) // {8 * mh.ROWS} AS n FROM documents WHERE text IS NOT NULL)
        SELECT cid, greatest(n, 1) AS n FROM h WHERE n <> {mh.BANDS}""",
    "agg_token_summary": f"""WITH s AS (SELECT dataset, len(list_distinct(regexp_extract_all({sql_canonical('text')}, '{scalars.cn.SHORT}'))) AS n FROM documents WHERE text IS NOT NULL)
        SELECT dataset, count(*) AS n, min(s.n) AS least, max(s.n) AS most, round(avg(s.n), 9) AS mean, count(*) FILTER (s.n = 0) AS empty FROM s GROUP BY 1""",
    "agg_retained_by_project": with_sql("rec", f"WITH {_FLAG} SELECT grp, count(*) AS n FROM mem LEFT JOIN rec USING (dataset, row_id) WHERE dataset = '{TARGET}' AND cid NOT IN (SELECT target FROM f) GROUP BY 1"),
    "val_pair_idempotent": f"WITH {_FLAG} SELECT CASE target % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'same' END AS state, count(*) AS n_pairs FROM f GROUP BY 1",
    "val_band_complete": f"""WITH h AS (SELECT coalesce(octet_length(signature_blob), 0) // {8 * mh.ROWS} AS n FROM documents WHERE text IS NOT NULL)
        SELECT n, count(*) AS documents, n = {mh.BANDS} AS complete FROM h GROUP BY 1""",
}
