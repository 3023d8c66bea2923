"""Ranking, running and sorted results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark.operators.skew import GRAINS, hex_slot, ordered_sums, running, size_slot, unit_slot
from siftspark.plans import relations as rel
from siftspark.plans.relations import with_sql

#: Groups chosen as targets.
CHOSEN = 24


def selection(spark: SparkSession, folder: str, chosen: int = CHOSEN) -> DataFrame:
    """(grp, n, vulnerable, place, chosen): groups of the external records that have both classes, by the most vulnerable
    records, the most records, the name in lower case and the name."""
    g = rel.labelled(spark, folder).where("dataset = 'diversevul' and grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("vulnerable"))
    order = [F.desc("vulnerable"), F.desc("n"), F.lower("grp"), F.col("grp")]
    r = ordered_sums(g.where("vulnerable between 1 and n - 1"), [], -size_slot(F.col("vulnerable")), order, {"place": F.lit(1)})
    return r.withColumn("chosen", F.col("place") <= chosen)


def dense_position(df: DataFrame, group: str, order: list[str], name: str = "position") -> DataFrame:
    """A dense 0-based ordinal within each group, over a range partitioning: no task holds a whole group."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running(one, group, order, "_one", total="_total", rank="_rank").withColumn(name, F.col("_rank") - 1).drop("_one", "_total", "_rank")


def accept_top(df: DataFrame, cell: list[str], score: Column, ties: list[str], k: Column) -> DataFrame:
    """Whether each row is among the k best of its cell by a score between 0 and 1; ties go by the given columns."""
    r = ordered_sums(df.withColumn("_s", score), cell, unit_slot(F.col("_s"), down=True), [F.desc("_s"), *map(F.col, ties)], {"_r": F.lit(1)})
    return r.withColumn("accepted", F.col("_r") <= k).drop("_s", "_r")


def holm(df: DataFrame, by: list[str], p: str, ties: list[str]) -> DataFrame:
    """Step-down adjusted p-values: running maximum of (m - rank) p in rising order, at most 1. Null p takes no part."""
    order = [F.col(p), *map(F.col, ties)]
    ranked = ordered_sums(df.where(F.col(p).isNotNull()), by, unit_slot(F.col(p)), order, {"_i": F.lit(1)}, {"_i": "_m"})
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col(p))
    return ordered_sums(ranked, by, unit_slot(F.col(p)), order, {"adjusted": step}, how=F.max).drop("_i", "_m")


_ID = ["detector", "target_group", "seed", "side", "position"]
_IDS = ", ".join(_ID)
_TIES = ["target_group", "position"]


def _running_weight(s, d) -> DataFrame:
    own = 1 - F.col("p")
    r = ordered_sums(rel.scored(s, d, "calibration"), [*rel.CELL, "y"], unit_slot(own), [own, *map(F.col, _TIES)], {"weight": F.col("ratio")})
    return r.select(*_ID, F.round("weight", 6).alias("weight"))


def _running_error(s, d) -> DataFrame:
    """Each record's rank by certainty within its cell and the error rate up to there."""
    t = rel.scored(s, d, "target").withColumn("e", ((F.col("p") >= 0.5).cast("int") != F.col("y")).cast("double"))
    sure = F.greatest("p", 1 - F.col("p"))
    t = ordered_sums(t, rel.CELL, unit_slot(sure, down=True), [sure.desc(), *map(F.col, _TIES)], {"errors": F.col("e"), "place": F.lit(1)})
    return t.select(*_ID, "place", F.round(F.col("errors") / F.col("place"), 9).alias("error_rate"))


def _bins(s, d) -> DataFrame:
    t = rel.scored(s, d, "target")
    t = ordered_sums(t, rel.CELL, unit_slot(F.col("p")), [F.col("p"), *map(F.col, _TIES)], {"i": F.lit(1)}, {"i": "n"})
    return t.withColumn("bin", equal_bin(F.col("i") - 1, F.col("n"))).groupBy(*rel.CELL, "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 9).alias("p"), F.round(F.avg("y"), 9).alias("y"))


def equal_bin(i: Column, n: Column, bins: int = 15) -> Column:
    """Number of the bin of 0-based rank i among n rows in min(bins, n) bins of equal size, earlier ones one larger."""
    k = F.least(F.lit(bins), n)
    size, extra = F.floor(n / k), n % k
    return F.when(i < extra * (size + 1), F.floor(i / (size + 1))).otherwise(extra + F.floor((i - extra * (size + 1)) / size)).cast("int")


def _tie_groups(s, d) -> DataFrame:
    """Cumulative true and false positives at each distinct score, highest first."""
    g = rel.scored(s, d, "target").groupBy(*rel.CELL, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return ordered_sums(g, rel.CELL, unit_slot(F.col("p"), down=True), [F.desc("p")], {"tp": F.col("pos"), "fp": F.col("neg")}).select(*rel.CELL, "p", "tp", "fp")


def nested_sample(df: DataFrame, cell: list[str], fraction: float, repetition: int, salt: str, least: int = 40, per_class: int = 20) -> DataFrame:
    """A hash-ordered prefix of each cell, with at least ``per_class`` rows of each class where the cell has them.

    The prefix of max(ceil(fraction n), least) rows by SHA-256 of `salt|repetition|row_id` is taken; what a class lacks
    is added from its next rows in that order. Prefixes of a larger fraction hold those of a smaller one.
    """
    digest = F.sha2(F.concat(F.lit(f"{salt}|{repetition}|"), F.col("row_id")), 256)
    r = df.withColumn("_h", digest)
    for by, name, totals in ((cell, "_i", {"_i": "_n"}), ([*cell, "y"], "_c", None)):
        r = ordered_sums(r, by, hex_slot(F.col("_h")), [F.col("_h"), *map(F.col, _TIES)], {name: F.lit(1)}, totals)
    inside = F.col("_i") <= F.greatest(F.ceil(F.lit(fraction) * F.col("_n")), F.lit(least))
    return r.where(inside | (F.col("_c") <= per_class)).drop("_h", "_i", "_c", "_n")


def _signed_ranks(s, d) -> DataFrame:
    """Mid-ranks of the absolute differences of the detectors' mean scores per group."""
    from siftspark.operators.joins import _baseline

    b = _baseline(s, d).where("difference <> 0").select("target_group", "difference", F.abs("difference").alias("a"))
    sizes = b.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    before = ordered_sums(sizes, [], size_slot(F.col("a")), [F.col("a")], {"upto": F.col("k")}).withColumn("before", F.col("upto") - F.col("k"))
    return b.join(before, "a").select("target_group", "difference", (F.col("before") + (F.col("k") + 1) / 2).alias("mid_rank"))


def _class_rank(s, d) -> DataFrame:
    return rel.predictions(s, d).select(*_ID, F.when(F.col("p") >= 1 - F.col("p"), 1).otherwise(0).alias("first_class"))


def _holm(s, d) -> DataFrame:
    return holm(rel.predictions(s, d).select(*_ID, "p"), rel.CELL, "p", ["side", *_TIES]).select(*_ID, F.round("adjusted", 10).alias("adjusted"))


def _top_projects(s, d) -> DataFrame:
    g = rel.records(s, d).where("project is not null").groupBy("source_file", "project").agg(F.count(F.lit(1)).alias("n"))
    r = ordered_sums(g, ["source_file"], -size_slot(F.col("n")), [F.desc("n"), F.col("project")], {"place": F.lit(1)})
    return r.where("place <= 20")


def _batches(s, d) -> DataFrame:
    """Documents per range of 2,000 ids, with running totals."""
    g = rel.documents(s, d).groupBy(F.floor(F.col("doc_id") / 2000).alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    return ordered_sums(g, [], F.floor(F.col("batch") / GRAINS), [F.col("batch")], {"so_far": F.col("n")})


def _ordered(s, d, slot: Column, *by: Column) -> DataFrame:
    g = rel.labelled(s, d).where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("v"))
    return ordered_sums(g, [], slot, list(by), {"place": F.lit(1)})


def _selection(s, d):
    return selection(s, d)


def _accept(s, d) -> DataFrame:
    t = rel.scored(s, d, "target")
    return accept_top(t, rel.CELL, F.greatest("p", 1 - F.col("p")), _TIES, F.lit(7)).select(*_ID, "accepted")


QUERIES = {
    "win_dense_position": lambda s, d: dense_position(rel.records(s, d).where("project is not null and commit_id is not null and key is not null"), "dataset", ["first_position"]).select("dataset", "row_id", "position"),
    "win_selection_rank": _selection,
    "topk_stable_accept": _accept,
    "win_running_weight": _running_weight,
    "win_running_mean_error": _running_error,
    "win_equal_mass_bins": _bins,
    "win_tie_groups": _tie_groups,
    "win_nested_hash_sample": lambda s, d: nested_sample(rel.scored(s, d, "calibration"), rel.CELL, 0.5, 1, "nested-1").select(*_ID),
    "win_holm": _holm,
    "win_signed_ranks": _signed_ranks,
    "win_binary_class_rank": _class_rank,
    "sort_nocase": lambda s, d: _ordered(s, d, F.ascii(F.lower("grp")), F.lower("grp"), F.col("grp")).select("grp", "place"),
    "sort_multi": lambda s, d: _ordered(s, d, -size_slot(F.col("v")), F.desc("v"), F.col("n"), F.col("grp")).select("grp", "n", "v", "place"),
    "sort_ids": lambda s, d: rel.predictions(s, d).select("target_group", "row_id").distinct().transform(lambda t: ordered_sums(t, ["target_group"], hex_slot(F.col("row_id")), [F.col("row_id")], {"place": F.lit(1)})),
    "limit_k": _top_projects,
    "batch_ranges": _batches,
}

_TIE = "target_group, position"
_GRP = "WITH g AS (SELECT grp, count(*) AS n, sum(target)::BIGINT AS v FROM rl WHERE grp IS NOT NULL GROUP BY 1)"
SELECTION_SQL = f"""WITH g AS (SELECT grp, count(*) AS n, sum(target)::BIGINT AS vulnerable FROM rl WHERE dataset = 'diversevul' AND grp IS NOT NULL GROUP BY 1),
    sel AS (SELECT *, row_number() OVER (ORDER BY vulnerable DESC, n DESC, lower(grp), grp) AS place FROM g WHERE vulnerable BETWEEN 1 AND n - 1)"""
_BIN = "CASE WHEN i < n % k * (n // k + 1) THEN i // (n // k + 1) ELSE n % k + (i - n % k * (n // k + 1)) // (n // k) END"
ORACLE = {
    "win_dense_position": with_sql("rec", """SELECT dataset, row_id, row_number() OVER (PARTITION BY dataset ORDER BY first_position) - 1 AS position FROM rec
        WHERE project IS NOT NULL AND commit_id IS NOT NULL AND key IS NOT NULL"""),
    "win_selection_rank": with_sql("rl", f"{SELECTION_SQL} SELECT grp, n, vulnerable, place, place <= {CHOSEN} AS chosen FROM sel"),
    "topk_stable_accept": with_sql("tgt", f"SELECT {_IDS}, row_number() OVER (PARTITION BY detector, seed ORDER BY greatest(p, 1 - p) DESC, {_TIE}) <= 7 AS accepted FROM tgt"),
    "win_running_weight": with_sql("cal", f"SELECT {_IDS}, round(sum(ratio) OVER (PARTITION BY detector, seed, y ORDER BY 1 - p, {_TIE} ROWS UNBOUNDED PRECEDING), 6) AS weight FROM cal"),
    "win_running_mean_error": with_sql("tgt", f"""SELECT {_IDS}, row_number() OVER w AS place, round(avg(CASE WHEN (p >= 0.5)::INT <> y THEN 1.0::DOUBLE ELSE 0.0 END) OVER w, 9) AS error_rate
        FROM tgt WINDOW w AS (PARTITION BY detector, seed ORDER BY greatest(p, 1 - p) DESC, {_TIE} ROWS UNBOUNDED PRECEDING)"""),
    "win_equal_mass_bins": with_sql("tgt", f"""WITH r AS (SELECT detector, seed, p, y, row_number() OVER (PARTITION BY detector, seed ORDER BY p, {_TIE}) - 1 AS i,
        count(*) OVER (PARTITION BY detector, seed) AS n FROM tgt), b AS (SELECT *, ({_BIN})::INT AS bin FROM (SELECT *, least(15, n) AS k FROM r))
        SELECT detector, seed, bin, count(*) AS n, round(avg(p), 9) AS p, round(avg(y), 9) AS y FROM b GROUP BY 1, 2, 3"""),
    "win_tie_groups": with_sql("tgt", """WITH g AS (SELECT detector, seed, p, sum(y) AS pos, sum(1 - y) AS neg FROM tgt GROUP BY 1, 2, 3)
        SELECT detector, seed, p, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp FROM g WINDOW w AS (PARTITION BY detector, seed ORDER BY p DESC)"""),
    "win_nested_hash_sample": with_sql("cal", f"""WITH h AS (SELECT *, sha256('nested-1|1|' || row_id) AS h FROM cal),
        r AS (SELECT *, row_number() OVER (PARTITION BY detector, seed ORDER BY h, {_TIE}) AS i, row_number() OVER (PARTITION BY detector, seed, y ORDER BY h, {_TIE}) AS c,
        count(*) OVER (PARTITION BY detector, seed) AS n FROM h) SELECT {_IDS} FROM r WHERE i <= greatest(ceil(0.5 * n), 40) OR c <= 20"""),
    "win_holm": with_sql("prd", f"""WITH r AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY detector, seed) - row_number() OVER w + 1) * p) AS s,
        row_number() OVER w AS i FROM prd WINDOW w AS (PARTITION BY detector, seed ORDER BY p, side, {_TIE}))
        SELECT {_IDS}, round(max(s) OVER (PARTITION BY detector, seed ORDER BY i), 10) AS adjusted FROM r"""),
    "win_signed_ranks": with_sql("prd", """WITH m AS (SELECT target_group, round(avg(p) FILTER (detector = 'frozen_codebert') - avg(p) FILTER (detector = 'hashing_sgd'), 9) AS difference FROM prd GROUP BY 1),
        a AS (SELECT * FROM m WHERE difference <> 0)
        SELECT target_group, difference, rank() OVER (ORDER BY abs(difference)) + (count(*) OVER (PARTITION BY abs(difference)) - 1) / 2 AS mid_rank FROM a"""),
    "win_binary_class_rank": with_sql("prd", f"SELECT {_IDS}, (p >= 1 - p)::INT AS first_class FROM prd"),
    "sort_nocase": with_sql("rl", f"{_GRP} SELECT grp, row_number() OVER (ORDER BY lower(grp), grp) AS place FROM g"),
    "sort_multi": with_sql("rl", f"{_GRP} SELECT grp, n, v, row_number() OVER (ORDER BY v DESC, n, grp) AS place FROM g"),
    "sort_ids": with_sql("prd", "WITH x AS (SELECT DISTINCT target_group, row_id FROM prd) SELECT *, row_number() OVER (PARTITION BY target_group ORDER BY row_id) AS place FROM x"),
    "limit_k": with_sql("rec", """WITH g AS (SELECT source_file, project, count(*) AS n FROM rec WHERE project IS NOT NULL GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY n DESC, project) AS place FROM g QUALIFY place <= 20"""),
    "batch_ranges": "WITH g AS (SELECT doc_id // 2000 AS batch, count(*) AS n FROM documents GROUP BY 1) SELECT batch, n, (sum(n) OVER (ORDER BY batch))::BIGINT AS so_far FROM g",
    "join_logo_exclude": with_sql("rl rec", f"{SELECTION_SQL} SELECT sel.grp AS target_group, row_id FROM rec JOIN sel ON rec.grp <> sel.grp WHERE dataset = 'primevul' AND place <= {CHOSEN}"),
}
