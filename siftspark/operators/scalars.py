"""Scalar functions over texts, identifiers and scores."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions import canonical as cn
from siftspark.functions import lexer
from siftspark.functions import minhash as mh
from siftspark.plans import relations as rel
from siftspark.plans.relations import with_sql

SALT = "roles-1"
EPSILON = 1e-7


def logit(p: Column, epsilon: float = EPSILON) -> Column:
    c = F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))
    return F.log(c / (1 - c))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def odds(p: Column, epsilon: float = 2.0**-52) -> Column:
    c = F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))
    return c / (1 - c)


def infinity_mass(weight: Column, mass: Column) -> Column:
    """The share that a test point of this weight has in the class's mass with it."""
    return weight / (mass + weight)


def _docs(spark, folder) -> DataFrame:
    return rel.documents(spark, folder)


def _short_sets(spark, folder) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.array_sort(F.array_distinct(cn.short_tokens(F.col("text")))).alias("tokens"))


def _signatures(spark, folder) -> DataFrame:
    return mh.with_signature(_short_sets(spark, folder).where("tokens is not null"), ["doc_id"])


def _neighbours(spark, folder) -> DataFrame:
    """Each document's token set beside that of the next id."""
    s = _short_sets(spark, folder).where("tokens is not null")
    nxt = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("tokens").alias("other"))
    common = F.size(F.array_intersect("tokens", "other"))
    return s.join(nxt, "doc_id").select(
        "doc_id", F.size("tokens").alias("n_a"), F.size("other").alias("n_b"), common.alias("common"), (F.size("tokens") + F.size("other") - common).alias("either")
    )


def _agreement(spark, folder) -> DataFrame:
    """Equal positions of the stored signatures of documents that are copies of the first with their key."""
    d = _docs(spark, folder).where("signature_blob is not null and exact_code_key is not null")
    first = d.groupBy("exact_code_key").agg(F.min_by("signature_blob", "doc_id").alias("left"), F.min("doc_id").alias("doc_id_a"))
    pairs = d.join(first, "exact_code_key").where("doc_id > doc_id_a")

    def run(batches):
        import numpy as np

        for b in batches:
            x, y = ([np.frombuffer(v, "<u8") for v in b.column(c).to_pylist()] for c in ("left", "signature_blob"))
            n = [int((p == q).sum()) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id_a"), b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id_a", "doc_id_b", "agreeing"])

    return pairs.select("doc_id_a", "doc_id", "left", "signature_blob").mapInArrow(run, "doc_id_a long, doc_id_b long, agreeing long")


def _signature_values(spark, folder) -> DataFrame:
    """The stored signatures as arrays, back to bytes, and whether those are the same."""

    def run(batches):
        import numpy as np

        for b in batches:
            v = [np.frombuffer(x, "<u8") for x in b.column("signature_blob").to_pylist()]
            same = [x == y.astype("<u8").tobytes() for x, y in zip(b.column("signature_blob").to_pylist(), v, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in v], pa.int64()), pa.array(same)], names=["doc_id", "n_values", "same"])

    return _docs(spark, folder).where("signature_blob is not null").select("doc_id", "signature_blob").mapInArrow(run, "doc_id long, n_values long, same boolean")


def _class_weights(spark, folder) -> DataFrame:
    """n / (2 n_c) of each class within each group that has both."""
    from pyspark.sql import Window

    w = Window.partitionBy("grp")
    c = rel.labelled(spark, folder).where("grp is not null").groupBy("grp", "target").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("total", F.sum("n").over(w)).withColumn("k", F.count(F.lit(1)).over(w)).where("k = 2").select(
        "grp", "target", F.round(F.col("total") / (2 * F.col("n")), 9).alias("weight")
    )


def _coefficients(spark: SparkSession, folder: str) -> DataFrame:
    a, b = mh.coefficients()
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i long, a long, b long")


def _scores(spark, folder) -> DataFrame:
    return rel.predictions(spark, folder)


def _file_digests(spark: SparkSession, folder: str) -> DataFrame:
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.upper(F.sha2("content", 256)).alias("sha256"), F.col("length").alias("n_bytes"))


def _with(column: str, expression):
    return lambda s, d: _docs(s, d).select("doc_id", expression(F.col("text")).alias(column))


_ID = ["detector", "target_group", "seed", "side", "position"]

QUERIES = {
    "fn_canonicalize": _with("canonical", cn.canonical),
    "fn_normalize_v1": _with("normal", cn.normal_lines),
    "fn_exact_key": _with("exact_key", cn.exact_key),
    "fn_stable_bucket": lambda s, d: rel.records(s, d).select("row_id", cn.bucket(F.col("row_id"), SALT, 100).alias("bucket")),
    "fn_stable_id": lambda s, d: rel.records(s, d).select("row_id", cn.stable_id(F.col("dataset"), F.col("source_file"), F.col("line_number").cast("string"), F.col("key")).alias("id")),
    "fn_sha256_file": _file_digests,
    "fn_lexical_tokens": _with("tokens", cn.short_tokens),
    "fn_cpp_tokens": lambda s, d: lexer.with_tokens(_docs(s, d).where("dataset <> 'context'"), ["doc_id"], distinct=False),
    "fn_token_set": _short_sets,
    "fn_serialize_tokens": lambda s, d: _stored_sets(s, d),
    "fn_deserialize_tokens": lambda s, d: lexer.decoded_blobs(_docs(s, d), ["doc_id"]).select("doc_id", F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("n_tokens")),
    "fn_token_set_sha": lambda s, d: _set_digests(s, d),
    "fn_minhash_coeffs": _coefficients,
    "fn_token_hash": lambda s, d: _short_sets(s, d).select(F.explode("tokens").alias("token")).distinct().select("token", mh.token_hash(F.col("token")).alias("value")),
    "fn_minhash": _signatures,
    "fn_signature_blob": _signature_values,
    "fn_minhash_agreement": _agreement,
    "fn_band_keys": lambda s, d: mh.bands(_signatures(s, d), ["doc_id"]),
    "fn_jaccard": lambda s, d: _neighbours(s, d).select("doc_id", "common", "either", F.round(mh.jaccard(F.col("common"), F.col("either")), 10).alias("jaccard")),
    "fn_cardinality_bound": lambda s, d: _neighbours(s, d).select("doc_id", "n_a", "n_b", mh.cardinality_fits(F.col("n_a"), F.col("n_b"), mh.THRESHOLD).alias("fits")),
    "fn_lsh_probability": lambda s, d: s.range(101).select("id", F.round(mh.lsh_probability(F.col("id") / 100), 10).alias("probability")),
    "fn_logit_sigmoid": lambda s, d: _scores(s, d).select(*_ID, F.round(logit(F.col("p")), 9).alias("logit"), F.round(sigmoid(logit(F.col("p")) / 2), 9).alias("halved")),
    "fn_softmax": lambda s, d: _scores(s, d).select(*_ID, F.round(F.exp("p") / (F.exp("p") + F.exp("ratio")), 9).alias("share")),
    "fn_odds_ratio": lambda s, d: _scores(s, d).select(*_ID, F.round(odds(F.col("p")), 9).alias("odds")),
    "fn_log1p": lambda s, d: _scores(s, d).select(*_ID, F.round(F.log1p("ratio"), 9).alias("log1p")),
    "fn_infinity_mass": lambda s, d: _scores(s, d).select(*_ID, F.round(F.greatest(infinity_mass(F.col("ratio"), F.lit(20.0)), infinity_mass(F.col("ratio"), F.lit(5.0))), 9).alias("mass")),
    "fn_balanced_class_weight": _class_weights,
    "fn_format_fixed": lambda s, d: _scores(s, d).select(*_ID, F.format_string("%.12f", "p").alias("p12")),
    "fn_json_dumps": lambda s, d: _scores(s, d).select(*_ID, F.to_json(F.struct("detector", "position", "seed")).alias("json")),
}


def _stored_sets(spark, folder) -> DataFrame:
    """Whether the serialized lexical token set of each text is its stored one."""

    def run(batches):
        for b in batches:
            texts, blobs = b.column("text").to_pylist(), b.column("token_blob").to_pylist()
            same = [lexer.deserialize(lexer.serialize(lexer.token_set(t))) == lexer.deserialize(x) for t, x in zip(texts, blobs, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(same)], names=["doc_id", "same"])

    d = _docs(spark, folder).where("text is not null and token_blob is not null")
    return d.select("doc_id", "text", "token_blob").mapInArrow(run, "doc_id long, same boolean")


def _set_digests(spark, folder) -> DataFrame:
    """SHA-256 of the uncompressed token sets, for documents that state it."""

    def run(batches):
        for b in batches:
            out = [lexer.set_digest(lexer.deserialize(x)) for x in b.column("token_blob").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out)], names=["doc_id", "digest"])

    d = _docs(spark, folder).where("token_blob is not null and token_set_sha256 is not null")
    return d.select("doc_id", "token_blob").mapInArrow(run, "doc_id long, digest string")


_C = cn.sql_canonical("text")
_SETS = f"s AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all({_C}, '{cn.SHORT}'))) AS tokens FROM documents WHERE text IS NOT NULL)"
_PAIRS = f"""WITH {_SETS}, n AS (SELECT a.doc_id, len(a.tokens) AS n_a, len(b.tokens) AS n_b, len(list_intersect(a.tokens, b.tokens)) AS common
    FROM s a JOIN s b ON b.doc_id = a.doc_id + 1)"""
_COEF = f"""c AS (SELECT i, (1 + {cn.sql_hash_prefix(f"'{mh.SEED}|' || i")} % {mh.PRIME - 1})::BIGINT AS a,
    (('0x' || substr(sha256('{mh.SEED}|' || i), 17, 16))::UBIGINT % {mh.PRIME})::BIGINT AS b FROM range({mh.FUNCTIONS}) t(i))"""
_SIGS = f"""{_SETS}, h AS (SELECT doc_id, {mh.sql_token_hash('token')} AS x FROM (SELECT doc_id, unnest(tokens) AS token FROM s)),
    {_COEF}, m AS (SELECT doc_id, i, min((a::HUGEINT * x + b) % {mh.PRIME})::BIGINT AS v FROM h, c GROUP BY 1, 2),
    g AS (SELECT s.doc_id, coalesce(list(v ORDER BY i) FILTER (WHERE v IS NOT NULL), list_transform(range({mh.FUNCTIONS}), lambda z: {mh.PRIME})) AS signature
          FROM s LEFT JOIN m USING (doc_id) GROUP BY 1)"""
_LOGIT = f"ln(least(greatest(p, {EPSILON}), {1 - EPSILON}) / (1 - least(greatest(p, {EPSILON}), {1 - EPSILON})))"
_IDS = ", ".join(_ID)

ORACLE = {
    "fn_canonicalize": f"SELECT doc_id, {_C} AS canonical FROM documents",
    "fn_normalize_v1": f"SELECT doc_id, regexp_replace(regexp_replace(text, '{cn.BLANK}*({cn.BREAK})', chr(10), 'g'), '{cn.STRIP}', '', 'g') AS normal FROM documents",
    "fn_exact_key": f"SELECT doc_id, sha256({_C}) AS exact_key FROM documents",
    "fn_stable_bucket": with_sql("rec", f"SELECT row_id, {cn.sql_bucket('row_id', SALT, 100)} AS bucket FROM rec"),
    "fn_stable_id": with_sql("rec", "SELECT row_id, substr(sha256(concat_ws('|', dataset, source_file, line_number, key)), 1, 24) AS id FROM rec"),
    "fn_lexical_tokens": f"SELECT doc_id, regexp_extract_all({_C}, '{cn.SHORT}') AS tokens FROM documents",
    "fn_token_set": f"WITH {_SETS} SELECT doc_id, s.tokens FROM documents LEFT JOIN s USING (doc_id)",
    "fn_serialize_tokens": "SELECT doc_id, true AS same FROM documents WHERE text IS NOT NULL AND token_blob IS NOT NULL",
    "fn_token_set_sha": "SELECT doc_id, token_set_sha256 AS digest FROM documents WHERE token_blob IS NOT NULL AND token_set_sha256 IS NOT NULL",
    "fn_minhash_coeffs": f"WITH {_COEF} SELECT i, a, b FROM c",
    "fn_token_hash": f"WITH {_SETS}, t AS (SELECT DISTINCT unnest(tokens) AS token FROM s) SELECT token, {mh.sql_token_hash('token')} AS value FROM t",
    "fn_minhash": f"WITH {_SIGS} SELECT doc_id, signature FROM g",
    "fn_signature_blob": "SELECT doc_id, (octet_length(signature_blob) // 8)::BIGINT AS n_values, true AS same FROM documents WHERE signature_blob IS NOT NULL",
    "fn_minhash_agreement": """WITH d AS (SELECT doc_id, exact_code_key FROM documents WHERE signature_blob IS NOT NULL AND exact_code_key IS NOT NULL),
        f AS (SELECT exact_code_key, min(doc_id) AS doc_id_a FROM d GROUP BY 1)
        SELECT doc_id_a, doc_id AS doc_id_b, 128::BIGINT AS agreeing FROM d JOIN f USING (exact_code_key) WHERE doc_id > doc_id_a""",
    "fn_band_keys": f"""WITH {_SIGS} SELECT doc_id, band::INT AS band,
        sha256(array_to_string(list_prepend(band::VARCHAR, list_transform(signature[band * {mh.ROWS} + 1:(band + 1) * {mh.ROWS}], lambda v: v::VARCHAR)), ',')) AS band_key
        FROM g, range({mh.BANDS}) t(band)""",
    "fn_jaccard": f"{_PAIRS} SELECT doc_id, common::INT AS common, (n_a + n_b - common)::INT AS either, round(CASE WHEN n_a + n_b = 0 THEN 1.0 ELSE common / (n_a + n_b - common) END, 10) AS jaccard FROM n",
    "fn_cardinality_bound": f"{_PAIRS} SELECT doc_id, n_a::INT AS n_a, n_b::INT AS n_b, CASE WHEN greatest(n_a, n_b) = 0 THEN true WHEN least(n_a, n_b) = 0 THEN false ELSE least(n_a, n_b) / greatest(n_a, n_b) + 1e-15 >= 0.9 END AS fits FROM n",
    "fn_lsh_probability": f"SELECT id, round(1 - pow(1 - pow(id / 100, {mh.ROWS}), {mh.BANDS}), 10) AS probability FROM range(101) t(id)",
    "fn_logit_sigmoid": with_sql("prd", f"SELECT {_IDS}, round({_LOGIT}, 9) AS logit, round(1 / (1 + exp(-{_LOGIT} / 2)), 9) AS halved FROM prd"),
    "fn_softmax": with_sql("prd", f"SELECT {_IDS}, round(exp(p) / (exp(p) + exp(ratio)), 9) AS share FROM prd"),
    "fn_odds_ratio": with_sql("prd", f"SELECT {_IDS}, round(p / (1 - p), 9) AS odds FROM prd"),
    "fn_log1p": with_sql("prd", f"SELECT {_IDS}, round(ln(1 + ratio), 9) AS log1p FROM prd"),
    "fn_infinity_mass": with_sql("prd", f"SELECT {_IDS}, round(greatest(ratio / (20 + ratio), ratio / (5 + ratio)), 9) AS mass FROM prd"),
    "fn_balanced_class_weight": with_sql("rl", """WITH c AS (SELECT grp, target, count(*) AS n FROM rl WHERE grp IS NOT NULL GROUP BY 1, 2),
        t AS (SELECT *, sum(n) OVER (PARTITION BY grp) AS total, count(*) OVER (PARTITION BY grp) AS k FROM c)
        SELECT grp, target, round(total / (2 * n), 9) AS weight FROM t WHERE k = 2"""),
    "fn_format_fixed": with_sql("prd", f"SELECT {_IDS}, printf('%.12f', p) AS p12 FROM prd"),
    "fn_json_dumps": with_sql("prd", f"SELECT {_IDS}, to_json({{detector: detector, position: position, seed: seed}})::VARCHAR AS json FROM prd"),
}
