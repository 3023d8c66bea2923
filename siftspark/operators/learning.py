"""Features, classifiers and density ratios.

Fits use pyspark.ml on distributed data; results are deterministic but not those of another library bit for bit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark.functions.canonical import bucket, hash_prefix, sql_hash_prefix
from siftspark.operators.metrics import auroc, average_precision
from siftspark.operators.predicates import role
from siftspark.operators.scalars import odds
from siftspark.plans import relations as rel
from siftspark.plans.relations import CELL, with_sql
from siftspark.runtime import stage, table

#: Fixed values.
BUCKETS = 1 << 18
WORD = r"[A-Za-z0-9_]+"
PENALTIES = (1e-6, 1e-5, 1e-4)
FOLDS = 5
SALT = "folds-1"


def grams(text: Column) -> Column:
    """Words and pairs of neighbouring words, case kept; a null text has none."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    pairs = F.transform(F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b")), lambda z: F.concat_ws(" ", z["a"], z["b"]))
    return F.concat(words, pairs)


def hashed_grams(docs: DataFrame, key: str, n: int = BUCKETS) -> DataFrame:
    """(key, idx, value): counts of hashed grams, scaled to length 1; a text without words has no row."""
    # Texts are shuffled once, by key; counts and lengths then need no other exchange.
    # The remainder by a power of two is in the last digits of the prefix, which spares decimals of twenty digits.
    digest = F.sha2("gram", 256)
    slot = (hash_prefix(F.col("gram")) % n).cast("int") if n & (n - 1) or n > 1 << 20 else F.conv(F.substring(digest, 12, 5), 16, 10).cast("int").bitwiseAND(F.lit(n - 1))
    g = docs.select(key, "text").repartition(key).select(key, F.explode(grams(F.col("text"))).alias("gram")).select(key, slot.alias("idx"))
    c = g.groupBy(key, "idx").agg(F.count(F.lit(1)).alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return c.select(key, "idx", F.round(F.col("n") / length, 9).alias("value"))


def sparse_features(docs: DataFrame, n: int = BUCKETS) -> DataFrame:
    """``docs`` with the sparse vector `features` of their column `text`."""
    t = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    words = RegexTokenizer(inputCol="_text", outputCol="_w", pattern=WORD, gaps=False, toLowercase=False).transform(t)
    both = NGram(n=2, inputCol="_w", outputCol="_p").transform(words).withColumn("_g", F.concat("_w", "_p"))
    return Normalizer(p=2.0, inputCol="_c", outputCol="features").transform(HashingTF(numFeatures=n, inputCol="_g", outputCol="_c").transform(both)).drop("_text", "_w", "_p", "_g", "_c")


def balanced(df: DataFrame, y: str) -> DataFrame:
    """Adds `weight`, n / (2 n_c) of each class."""
    n = {r[0]: r[1] for r in df.groupBy(y).count().collect()}  # two rows
    total = sum(n.values())
    return df.withColumn("weight", F.when(F.col(y) == 1, total / (2 * max(n.get(1, 0), 1))).otherwise(total / (2 * max(n.get(0, 0), 1))))


def _logistic(reg: float, rounds: int = 25) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=reg, maxIter=rounds, tol=1e-6)


def selected(train: DataFrame, valid: DataFrame, grid: tuple[float, ...], larger: bool):
    """(model, [(reg, pr_auc)], best): the penalty with the best average precision on ``valid``, ties to the larger or
    smaller one, refitted on both. Either class must be there."""
    tried, best = [], None
    for reg in sorted(grid, reverse=larger):
        m = _logistic(reg).fit(balanced(train, "y"))
        s = m.transform(valid).select(F.lit(1).alias("g"), "y", vector_to_array("probability")[1].alias("p"))
        ap = average_precision(s, ["g"], "p", "y").first()["pr_auc"]
        tried.append((reg, ap))
        if best is None or ap > best[1]:
            best = (reg, ap)
    final = _logistic(best[0]).fit(balanced(train.unionByName(valid), "y"))
    return final, tried, best[0]


def _functions(spark, folder) -> DataFrame:
    """Source functions with label, role and text."""
    d = rel.documents(spark, folder).where("dataset = 'primevul' and text is not null").select("row_id", "text")
    r = rel.labelled(spark, folder).where("dataset = 'primevul'").select("row_id", "commit_id", F.col("target").alias("y"))
    return d.join(r, "row_id").withColumn("role", role(bucket(F.coalesce("commit_id", "row_id"), "roles-1", 100)))


def _detector(spark: SparkSession, folder: str) -> tuple:
    f = stage(sparse_features(_functions(spark, folder)).select("row_id", "role", "y", "features"), "features")
    return f, selected(f.where("role = 'train'"), f.where("role = 'model_validation'"), PENALTIES, larger=True)


def detector_grid(spark: SparkSession, folder: str) -> DataFrame:
    """(reg, pr_auc, chosen) of the hashing detector."""
    _, (_, tried, best) = _detector(spark, folder)
    return spark.createDataFrame([(r, round(a, 9), r == best) for r, a in tried], "reg double, pr_auc double, chosen boolean")


def detector_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, p): the chosen detector's scores of the calibration rows."""
    f, (model, _, _) = _detector(spark, folder)
    return model.transform(f.where("role = 'calibration'")).select("row_id", F.round(vector_to_array("probability")[1], 6).alias("p"))


def head_grid(spark: SparkSession, folder: str) -> DataFrame:
    """(reg, pr_auc, chosen) of a standardised logistic head on the embeddings; the scaler sees the training rows only."""
    e = table(spark, folder, "embeddings").select("vec_id", (F.col("label") >= 5).cast("int").alias("y"), array_to_vector("embedding").alias("raw"))
    e = e.withColumn("role", role(bucket(F.col("vec_id").cast("string"), "heads-1", 100)))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(e.where("role = 'train'"))
    x = stage(scaler.transform(e).select("vec_id", "y", "role", "features"), "head")
    n = x.where("role = 'train'").count()
    _, tried, best = selected(x.where("role = 'train'"), x.where("role = 'model_validation'"), tuple(1 / (c * max(n, 1)) for c in (0.01, 0.1, 1.0)), larger=True)
    return spark.createDataFrame([(r, round(a, 6), r == best) for r, a in tried], "reg double, pr_auc double, chosen boolean")


def crossfit_ratio(df: DataFrame, row_id: str, domain: str, folds: int = FOLDS, salt: str = SALT, reg: float = 1e-4) -> DataFrame:
    """(row_id, domain, fold, ratio): the out-of-fold odds of the target domain.

    Folds go by hash of the row. For each, a classifier is fitted on the other folds, equal numbers of either domain
    taken in hash order; ``folds`` fits in all, each distributed. ``df`` has `features`; domain is 0 or 1.
    """
    x = df.select(row_id, F.col(domain).alias("y"), "features", bucket(F.col(row_id), salt, folds).alias("fold"))
    x = stage(x.withColumn("h", F.xxhash64(F.lit(salt), F.col(row_id))), "domains")
    parts = None
    for k in range(folds):
        rest = x.where(F.col("fold") != k)
        n = {r[0]: r[1] for r in rest.groupBy("y").count().collect()}  # two rows
        least = min(n.get(0, 0), n.get(1, 0))
        if not least:
            raise ValueError(f"fold {k} lacks a domain")
        # Equal shares by hash: the expected number of either domain is that of the smaller one.
        cut = {y: min(int(-(2**63) + least / n[y] * 2**64), 2**63 - 1) for y in (0, 1)}
        train = rest.where(((F.col("y") == 0) & (F.col("h") <= cut[0])) | ((F.col("y") == 1) & (F.col("h") <= cut[1])))
        m = _logistic(reg, 10).fit(balanced(train, "y"))
        scored = m.transform(x.where(F.col("fold") == k)).select(row_id, F.col("y").alias(domain), "fold", odds(vector_to_array("probability")[1]).alias("ratio"))
        parts = scored if parts is None else parts.unionByName(scored)
    return parts


def _domains(spark, folder) -> DataFrame:
    return rel.documents(spark, folder).where("dataset <> 'context' and text is not null").select("row_id", "text", (F.col("dataset") == "diversevul").cast("int").alias("domain"))


def _ratios(spark, folder) -> DataFrame:
    return crossfit_ratio(sparse_features(_domains(spark, folder)), "row_id", "domain")


def kept_model(spark: SparkSession, folder: str) -> DataFrame:
    """(feature, coefficient, mean, scale) of the published gate after a round through the shared folder."""
    from siftspark.operators.conformal import GATE
    from siftspark.operators.files import _path
    from siftspark.sources.sinks import write_json

    p, schema = _path(spark, "gate"), "feature string, coefficient double, mean double, scale double"
    write_json(spark.createDataFrame(GATE, schema), p)
    return spark.read.schema(schema).json(p)


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Newton's method for weighted logistic loss plus ridge / 2 |b|^2, the last coefficient being the free intercept."""
    z = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    r = np.append(np.full(x.shape[1], ridge), 1e-9)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -35, 35)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(r), z.T @ (w * (p - y)) + r * b)
        b -= step
        if np.abs(step).max() < 1e-10:
            break
    return b


GATE_OUT = "detector string, seed int, clip double, severe int, probability double"


def gate_fit(rows: DataFrame, names: list[str]) -> DataFrame:
    """Out-of-group probabilities of a standardised, balanced logistic gate; groups are the seeds.

    A row is a cell with a clip, so the frame of a fit has as many rows as there are cells, not records. A group whose
    complement has one class only gets that class's share.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g in sorted(pdf.seed.unique()):
            t, h = pdf[pdf.seed != g], pdf[pdf.seed == g]
            y = t.severe.to_numpy(float)
            if len(t) == 0 or y.min() == y.max():
                p = np.full(len(h), y.mean() if len(t) else 0.5)
            else:
                x = t[names].to_numpy(float)
                mean, scale = x.mean(axis=0), x.std(axis=0)
                scale[scale == 0] = 1
                b = fit_logistic((x - mean) / scale, y, np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))))
                p = 1 / (1 + np.exp(-(np.hstack([(h[names].to_numpy(float) - mean) / scale, np.ones((len(h), 1))]) @ b)))
            out.append(h[["detector", "seed", "clip", "severe"]].assign(probability=np.round(p, 9)))
        return pd.concat(out)

    return rows.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda pdf: run(pdf), GATE_OUT)


def gate_frame(spark: SparkSession, folder: str) -> DataFrame:
    """(cell, clip, severe, features): support features beside whether the ungated sets violate a budget badly.

    Violations are averaged over groups first and the greater relative one taken then, which isn't the mean of the greater.
    """
    from siftspark.operators.conformal import GATE, _support
    from siftspark.operators.metrics import fold_metrics
    from siftspark.operators.predicates import severe

    m = fold_metrics(spark, folder).where("method like 'estimated%'").withColumn("clip", F.regexp_extract("method", r"([0-9]+)\z", 1).try_cast("double"))
    v = m.where(F.abs(F.col("av") - 0.1) + F.abs(F.col("asafe") - 0.2) < 1e-12).groupBy(*CELL, "clip").agg(F.avg("vulnerable_violation").alias("v"), F.avg("safe_violation").alias("s"))
    bad = v.select(*CELL, "clip", severe(F.col("v"), F.col("s"), F.lit(0.1), F.lit(0.2)).cast("int").alias("severe"))
    return _support(spark, folder).join(bad, [*CELL, "clip"]).select(*CELL, "clip", "severe", *[F.round(F.coalesce(n, F.lit(0.0)), 6).alias(n) for n, *_ in GATE])


def _gate(spark, folder) -> DataFrame:
    from siftspark.operators.conformal import GATE

    return gate_fit(gate_frame(spark, folder), [n for n, *_ in GATE])


def in_sample_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, ratio): the odds of a domain classifier on the rows it was fitted on, clipped; the cross-fitted ones are
    the ones to use."""
    from siftspark.operators.predicates import clip

    x = stage(sparse_features(_domains(spark, folder)).select("row_id", F.col("domain").alias("y"), "features"), "domains")
    m = _logistic(1e-4, 10).fit(balanced(x, "y"))
    return m.transform(x).select("row_id", F.round(clip(odds(vector_to_array("probability")[1])), 4).alias("ratio"))


def pooled_means(df: DataFrame, by: str, vector: str, keep: Column | None = None) -> DataFrame:
    """(by, at, value): means over the kept rows of a group, element by element."""
    rows = df if keep is None else df.where(keep)
    return rows.select(by, F.posexplode(vector).alias("at", "x")).groupBy(by, "at").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


TEMPERATURE = "detector string, seed int, temperature double, loss_before double, loss_after double"


def fit_temperature(p: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """(temperature, loss at 1, loss there): golden-section search of log T in [ln 0.05, ln 20] for the log loss of
    logits divided by T, over distinct scores with counts."""
    eps = 1e-7
    c = np.clip(p, eps, 1 - eps)
    z = np.log(c / (1 - c))

    def loss(u: float) -> float:
        q = 1 / (1 + np.exp(-z / math.exp(u)))
        return float(-(n * (y * np.log(np.clip(q, eps, 1)) + (1 - y) * np.log(np.clip(1 - q, eps, 1)))).sum() / n.sum())

    lo, hi, g = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = loss(a), loss(b)
    while hi - lo > 1e-7:
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = loss(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = loss(b)
    u = (lo + hi) / 2
    return math.exp(u), loss(0.0), loss(u)


def temperatures(cal: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """A temperature per cell, from its distinct scores with their counts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, before, after = fit_temperature(pdf.p.to_numpy(), pdf.y.to_numpy(float), pdf.n.to_numpy(float))
        return pd.DataFrame({"detector": [pdf.detector.iloc[0]], "seed": [pdf.seed.iloc[0]], "temperature": [round(t, 5)], "loss_before": [round(before, 9)], "loss_after": [round(after, 9)]})

    return cal.groupBy(*cell, "p", "y").agg(F.count(F.lit(1)).alias("n")).groupBy(*cell).applyInPandas(run, TEMPERATURE)


def _fold_records(spark, folder) -> DataFrame:
    r = _ratios(spark, folder)
    return r.groupBy("fold").agg(F.count(F.when(F.col("domain") == 0, 1)).alias("held_source"), F.count(F.when(F.col("domain") == 1, 1)).alias("held_target"), F.round(F.avg("ratio"), 6).alias("mean_ratio"))


def _domain_scores(spark, folder) -> DataFrame:
    """How well the out-of-fold odds tell the domains: rows, AUROC and average precision."""
    r = stage(_ratios(spark, folder).withColumn("g", F.lit(1)), "ratios")
    n = r.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("domain").alias("n_target"))
    return n.join(auroc(r, ["g"], "ratio", "domain"), "g").join(average_precision(r, ["g"], "ratio", "domain"), "g").select("n", "n_target", F.round("auroc", 6).alias("auroc"), F.round("pr_auc", 6).alias("pr_auc"))


QUERIES = {
    "ml_hash_vectorize": lambda s, d: hashed_grams(rel.documents(s, d).where("dataset <> 'context'"), "doc_id"),
    "scan_sparse": lambda s, d: hashed_grams(rel.documents(s, d), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_set"), F.round(F.sum(F.col("value") * F.col("value")), 5).alias("length")),
    "ml_detector_sgd": detector_grid,
    "ml_predict": detector_scores,
    "ml_head_logistic": head_grid,
    "ml_crossfit_density": lambda s, d: _ratios(s, d).select("row_id", "domain", "fold", F.round("ratio", 6).alias("ratio")),
    "ml_crossfit_folds": _fold_records,
    "ml_domain_scores": _domain_scores,
    "ml_gate_fit": _gate,
    "ml_smoke_domain_ratio": in_sample_ratio,
    "gate_train_frame": gate_frame,
    "scan_model": kept_model,
    "ml_embed": lambda s, d: pooled_means(table(s, d, "embeddings"), "label", "embedding"),
    "conf_temperature": lambda s, d: temperatures(rel.scored(s, d, "calibration")),
}

_GRAMS = f"""w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS w FROM documents WHERE text IS NOT NULL {{}}),
  g AS (SELECT doc_id, unnest(w || list_transform(range(greatest(len(w) - 1, 0)), lambda i: w[i + 1] || ' ' || w[i + 2])) AS gram FROM w),
  c AS (SELECT doc_id, ({sql_hash_prefix('gram')} % {BUCKETS})::INT AS idx, count(*) AS n FROM g GROUP BY 1, 2), l AS (SELECT doc_id, sqrt(sum(n * n)) AS length FROM c GROUP BY 1),
  v AS (SELECT doc_id, idx, round(n / length, 9) AS value FROM c JOIN l USING (doc_id))"""
ORACLE = {
    "ml_hash_vectorize": f"WITH {_GRAMS.format('AND dataset <> ' + chr(39) + 'context' + chr(39))} SELECT doc_id, idx, value FROM v",
    "scan_sparse": f"WITH {_GRAMS.format('')} SELECT doc_id, count(*) AS n_set, round(sum(value * value), 5) AS length FROM v GROUP BY 1",
    "ml_embed": "WITH e AS (SELECT label, unnest(range(len(embedding)))::INT AS at, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, at, round(avg(x), 6) AS value FROM e GROUP BY 1, 2".replace(" at", ' "at"'),
}


def _gate_sql() -> str:
    from siftspark.operators.conformal import GATE
    from siftspark.operators.metrics import metrics_sql

    return metrics_sql(f"""WITH v AS (SELECT detector, seed, regexp_extract(method, '([0-9]+)$', 1)::DOUBLE AS clip, avg(vulnerable_violation) AS v, avg(safe_violation) AS s FROM mx
        WHERE method LIKE 'estimated%' AND av = 0.1 AND asafe = 0.2 GROUP BY 1, 2, 3)
        SELECT detector, seed, clip, (greatest(v / 0.1, s / 0.2) > 0.5)::INT AS severe, {', '.join(f'round(coalesce({n}, 0), 6) AS {n}' for n, *_ in GATE)} FROM v JOIN sf USING (detector, seed, clip)""")


def _model_sql() -> str:
    from siftspark.operators.conformal import GATE

    return "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {k}::DOUBLE, {m}::DOUBLE, {s}::DOUBLE)" for n, k, m, s in GATE) + ") t(feature, coefficient, mean, scale)"


ORACLE["gate_train_frame"] = _gate_sql()
ORACLE["scan_model"] = _model_sql()
