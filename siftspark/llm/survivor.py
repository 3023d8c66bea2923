"""One surviving record per group of records with the same dataset and key (problem 4).

Currency reasoning. Where rows carry timestamps, the order in which values of a field replace each other is observed in
every group and added up over the corpus: `transitions` holds how often value v gave way to value w, where that is the
commoner way round. `precedence` makes a partial order of them: v stands before w if the strongest chain of transitions
from v to w is stronger than any from w to v, a chain being as strong as its weakest link. That relation is transitive
and has no cycles, whatever cycles the transitions have. In a group a value is topologically latest if it stands before
no other value of the group.

`survivors` chooses one whole row: most complete, then latest, then first in position. Which row is latest its timestamp
tells; if one of the most complete rows has none, the partial order decides between those rows and the latest dated one.
`fused` takes each field's value from the latest timestamp, and from the partial order where timestamps are missing.
Chains are worked out only from values of groups with missing timestamps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark.functions.text import presence, sql_presence
from siftspark.llm import tokensets as ts
from siftspark.runtime import stage, table

FIELDS = ["project", "project_group", "commit_id", "source_role"]
#: Fields whose values recur, so that their transitions can be learned; commit ids don't.
LEARNED = ["project", "project_group", "source_role"]


def keyed(records: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The distinct records that have a key, with `key` and `label`: the target with the latest labelled_at.

    Labels without target are left out; of two at the same time the larger counts; a null time is the earliest.
    """
    r = records.distinct().withColumn("own", F.lower(presence(F.col("exact_code_key"))))
    d = (
        documents.select("dataset", "row_id", F.lower(presence(F.col("exact_code_key"))).alias("theirs"))
        .where("theirs is not null")
        .groupBy("dataset", "row_id")
        .agg(F.min("theirs").alias("theirs"))
    )
    have = r.where("own is not null").withColumn("key", F.col("own"))
    lack = r.where("own is null").join(d, ["dataset", "row_id"]).withColumn("key", F.col("theirs")).drop("theirs")
    latest = (
        labels.where("target is not null and row_id is not null")
        .groupBy("row_id")
        .agg(F.max(F.struct("labelled_at", "target")).alias("_l"))
        .select("row_id", F.col("_l.target").alias("label"))
    )
    cols = ["dataset", "key", "row_id", "first_position", "ingested_at", "conflicting_label", *[presence(F.col(f)).alias(f) for f in FIELDS]]
    return have.unionByName(lack).select(*cols).join(latest, "row_id", "left")


def survivors(rows: DataFrame) -> DataFrame:
    """(dataset, exact_code_key, row_id) of groups of two or more records without a conflict of labels.

    The row with the most fields that aren't blank wins, then the latest, then the least first_position (null is the
    last), then the least row_id. One aggregation, combined map-side, whatever the size of a group, if all most complete
    rows of a group have an ingested_at. Otherwise the latest of those that have one and those without are compared by
    how many of their values are known to be replaced by another's; if that says nothing, a dated row comes first. A
    group with two labels or with conflicting_label = 1 gives no row; missing labels don't conflict.
    """
    full = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    age = (-F.coalesce(F.unix_micros("ingested_at"), F.lit(-(2**62)))).alias("age")
    at = F.coalesce("first_position", F.lit(2**62)).alias("at")
    groups = rows.groupBy("dataset", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("label").alias("lo"),
        F.max("label").alias("hi"),
        F.max(F.coalesce("conflicting_label", F.lit(0))).alias("conflict"),
        F.min(F.struct((-full).alias("less"), age, at, "row_id")).alias("best"),
        F.min(F.struct((-full).alias("less"), F.col("ingested_at").isNotNull().alias("dated"))).alias("least"),
    )
    agreed = F.col("lo").isNull() | (F.col("lo") == F.col("hi"))
    kept = stage(groups.where((F.col("n") > 1) & agreed & (F.col("conflict") != 1)).select("dataset", "key", "best", (~F.col("least.dated")).alias("open")), "groups")
    done = kept.select("dataset", F.col("key").alias("exact_code_key"), F.col("best.row_id").alias("row_id"))
    if not kept.where("open").limit(1).count():
        return done
    open_ = kept.where("open").select("dataset", "key", F.col("best.less").alias("_less"), F.col("best.age").alias("_age"), F.col("best.at").alias("_at"), F.col("best.row_id").alias("_id"))
    here = rows.join(open_, ["dataset", "key"]).where(-full == F.col("_less"))
    is_best = (age == F.col("_age")) & (at == F.col("_at")) & F.col("row_id").eqNullSafe(F.col("_id"))
    here = stage(here.where(F.col("ingested_at").isNull() | is_best).select("dataset", "key", "row_id", age, at, *LEARNED), "contenders")
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in LEARNED])).alias("x")
    values = here.select("dataset", "key", one).select("dataset", "key", "x.field", "x.value").where("value is not null").distinct()
    lost = replaced(values, transitions(_values(rows))).groupBy("dataset", "key", "field", "value").agg(F.first("lost").alias("lost"))
    scored = here.withColumn("score", F.lit(0))
    for f in LEARNED:
        mine = lost.where(F.col("field") == f).select("dataset", "key", F.col("value").alias(f), (F.col("lost") > 0).cast("int").alias("_s"))
        scored = scored.join(mine, ["dataset", "key", f], "left").withColumn("score", F.col("score") + F.coalesce("_s", F.lit(0))).drop("_s")
    chosen = scored.groupBy("dataset", F.col("key").alias("exact_code_key")).agg(F.min(F.struct("score", "age", "at", "row_id")).alias("b"))
    sure = kept.where("not open").select("dataset", F.col("key").alias("exact_code_key"), F.col("best.row_id").alias("row_id"))
    return sure.unionByName(chosen.select("dataset", "exact_code_key", "b.row_id"))


def _values(rows: DataFrame) -> DataFrame:
    """(dataset, key, field, value, n, first_at, last_at): a group's distinct values, combined before any ordering."""
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("x")
    return (
        rows.select("dataset", "key", "ingested_at", one)
        .select("dataset", "key", "ingested_at", "x.field", "x.value")
        .where("value is not null")
        .groupBy("dataset", "key", "field", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ingested_at").alias("first_at"), F.max("ingested_at").alias("last_at"))
    )


def transitions(values: DataFrame) -> DataFrame:
    """(field, value, later, seen): how many groups show `value` giving way to `later`, where that prevails.

    A value gives way to the next one in order of last appearance if that is strictly later.
    """
    w = Window.partitionBy("dataset", "key", "field").orderBy("last_at", "value")
    steps = (
        values.where(F.col("field").isin(LEARNED) & F.col("last_at").isNotNull())
        .withColumn("later", F.lead("value").over(w))
        .withColumn("then", F.lead("last_at").over(w))
        .where(F.col("then") > F.col("last_at"))
        .groupBy("field", "value", "later")
        .agg(F.count(F.lit(1)).alias("seen"))
    )
    back = steps.select("field", F.col("value").alias("later"), F.col("later").alias("value"), F.col("seen").alias("back"))
    return steps.join(back, ["field", "value", "later"], "left").where(F.col("seen") > F.coalesce("back", F.lit(0))).drop("back")


def precedence(order: DataFrame, wanted: DataFrame) -> DataFrame:
    """(field, value, later): pairs of ``wanted`` (field, value) of which the first stands before the second.

    Chains are followed from the wanted values only, in rounds, keeping the strongest one to each value, until nothing
    grows any more.
    """
    edges = order.select("field", F.col("value").alias("dst"), F.col("later").alias("next"), "seen")
    start = order.join(wanted, ["field", "value"], "left_semi")
    reach = front = stage(start.select("field", F.col("value").alias("src"), F.col("later").alias("dst"), F.col("seen").alias("width")), "chains")
    while front.limit(1).count():
        longer = front.join(edges, ["field", "dst"]).select("field", "src", F.col("next").alias("dst"), F.least("width", "seen").alias("width"))
        both = reach.withColumn("old", F.col("width")).unionByName(longer.where("src <> dst").withColumn("old", F.lit(None).cast("long")))
        both = stage(both.groupBy("field", "src", "dst").agg(F.max("width").alias("width"), F.max("old").alias("old")), "chains")
        reach = both.drop("old")
        front = both.where("old is null or width > old").drop("old")
    back = reach.select("field", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("width").alias("back"))
    ends = reach.join(wanted.select("field", F.col("value").alias("dst")), ["field", "dst"], "left_semi")
    stands = ends.join(back, ["field", "src", "dst"], "left").where(F.col("width") > F.coalesce("back", F.lit(0)))
    return stands.select("field", F.col("src").alias("value"), F.col("dst").alias("later"))


def replaced(values: DataFrame, order: DataFrame) -> DataFrame:
    """(dataset, key, field, value, lost, won) of (dataset, key, field, value): how many values of its group a value
    stands before (is replaced by) and after. Joined on the precedence, not all values of a group with all."""
    values = stage(values.select("dataset", "key", "field", "value"), "undated")
    before = precedence(order, values.select("field", "value").distinct())
    older = values.join(before, ["field", "value"])
    met = older.join(values.withColumnRenamed("value", "later"), ["dataset", "key", "field", "later"])
    marks = met.select("dataset", "key", "field", "value", F.lit(1).alias("lost"), F.lit(0).alias("won")).unionByName(
        met.select("dataset", "key", "field", F.col("later").alias("value"), F.lit(0).alias("lost"), F.lit(1).alias("won"))
    )
    return marks.groupBy("dataset", "key", "field", "value").agg(F.sum("lost").alias("lost"), F.sum("won").alias("won"))


def fused(rows: DataFrame) -> DataFrame:
    """(dataset, exact_code_key, n_records, project, project_group, commit_id, source_role) of groups of two or more.

    Per field: a value with the latest timestamp of the group's timestamped values if all of them have one; otherwise
    one that stands before no other value of the group, preferring those that more values stand before, then later
    timestamps, then more rows, then the least value. A field without any value is null.
    """
    values = stage(_values(rows), "values")
    # Per group and field: its values, and whether each has a time; combined map-side, then joined back to undated ones.
    state = values.groupBy("dataset", "key", "field").agg(F.count(F.lit(1)).alias("k"), F.count("last_at").alias("dated"))
    unsure = state.where("k > 1 and dated < k").select("dataset", "key", "field")
    marks = replaced(values.join(unsure, ["dataset", "key", "field"], "left_semi"), transitions(values))
    open_ = values.join(unsure.withColumn("unsure", F.lit(True)), ["dataset", "key", "field"], "left")
    scored = open_.join(marks, ["dataset", "key", "field", "value"], "left")
    best = F.min(
        F.struct(
            (F.coalesce("lost", F.lit(0)) > 0).cast("int").alias("replaced"),
            (-F.coalesce("won", F.lit(0))).cast("long").alias("later_than"),
            (-F.coalesce(F.unix_micros("last_at"), F.lit(-(2**62)))).alias("age"),
            (-F.col("n")).alias("fewer"),
            "value",
        )
    )
    chosen = scored.groupBy("dataset", "key", "field").agg(best.alias("b"))
    wide = chosen.groupBy("dataset", "key").pivot("field", FIELDS).agg(F.min("b.value"))
    sizes = rows.groupBy("dataset", "key").agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")
    return sizes.join(wide, ["dataset", "key"], "left").withColumnRenamed("key", "exact_code_key")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return keyed(table(spark, folder, "records"), ts.documents(spark, folder), table(spark, folder, "labels"))


_STEPS = """
    x AS (UNPIVOT (SELECT dataset, key, ingested_at, project, project_group, commit_id, source_role FROM g)
          ON project, project_group, commit_id, source_role INTO NAME field VALUE value),
    v AS (SELECT dataset, key, field, value, count(*) AS n, max(ingested_at) AS last_at FROM x GROUP BY ALL),
    s AS (SELECT field, value, last_at, lead(value) OVER w AS later, lead(last_at) OVER w AS after FROM v
          WHERE last_at IS NOT NULL AND field <> 'commit_id' WINDOW w AS (PARTITION BY dataset, key, field ORDER BY last_at, value)),
    c AS (SELECT field, value, later, count(*) AS seen FROM s WHERE after > last_at GROUP BY ALL),
    tr AS (SELECT a.field, a.value, a.later, a.seen FROM c a LEFT JOIN c b ON a.field = b.field AND a.value = b.later
           AND a.later = b.value WHERE a.seen > coalesce(b.seen, 0))"""

QUERIES = {
    "p4_found": lambda s, d: survivors(_rows(s, d)),
    "p4_fused": lambda s, d: fused(stage(_rows(s, d), "keyed")),
    "p4_transitions": lambda s, d: transitions(_values(_rows(s, d))),
}

_KEYED = f"""
    WITH r AS (SELECT DISTINCT * FROM records),
    d AS (SELECT dataset, row_id, min(lower({sql_presence('exact_code_key')})) AS theirs FROM documents GROUP BY 1, 2),
    l AS (SELECT row_id, arg_max(target, (labelled_at, target)) AS label FROM labels WHERE target IS NOT NULL GROUP BY 1),
    k AS (SELECT r.dataset, coalesce(lower({sql_presence('r.exact_code_key')}), d.theirs) AS key, r.row_id,
                 first_position, ingested_at, conflicting_label, l.label,
                 {', '.join(f"{sql_presence('r.' + f)} AS {f}" for f in FIELDS)}
          FROM r LEFT JOIN d ON r.dataset = d.dataset AND r.row_id = d.row_id LEFT JOIN l ON r.row_id = l.row_id),
    g AS (SELECT * FROM k WHERE key IS NOT NULL)"""

ORACLE = {
    "p4_found": f"""{_KEYED},
    ok AS (SELECT dataset, key FROM g GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT label) < 2
           AND max(coalesce(conflicting_label, 0)) <> 1),
    n AS (SELECT g.*, (project IS NOT NULL)::INT + (project_group IS NOT NULL)::INT + (commit_id IS NOT NULL)::INT
                 + (source_role IS NOT NULL)::INT AS full_fields FROM g JOIN ok USING (dataset, key)),
    b AS (SELECT *, row_number() OVER (PARTITION BY dataset, key ORDER BY full_fields DESC, ingested_at DESC NULLS LAST,
                 first_position NULLS LAST, row_id) AS i FROM n)
    SELECT dataset, key AS exact_code_key, row_id FROM b WHERE i = 1""",
    "p4_transitions": f"{_KEYED}, {_STEPS} SELECT * FROM tr",
    "p4_fused": f"""{_KEYED.replace('WITH r', 'WITH RECURSIVE r', 1)}, {_STEPS},
    open AS (SELECT dataset, key, field FROM v GROUP BY 1, 2, 3 HAVING count(*) > 1 AND count(last_at) < count(*)),
    u AS (SELECT v.* FROM v JOIN open USING (dataset, key, field)),
    chain AS (SELECT DISTINCT tr.field, tr.value AS src, tr.later AS dst, tr.seen AS width FROM tr JOIN u USING (field, value)
              UNION SELECT chain.field, src, tr.later, least(width, seen) FROM chain JOIN tr ON tr.field = chain.field AND tr.value = dst
              WHERE tr.later <> src),
    wide AS (SELECT field, src, dst, max(width) AS width FROM chain GROUP BY 1, 2, 3),
    before AS (SELECT a.field, a.src, a.dst FROM wide a LEFT JOIN wide b ON a.field = b.field AND a.src = b.dst AND a.dst = b.src
               WHERE a.width > coalesce(b.width, 0)),
    met AS (SELECT x.dataset, x.key, x.field, x.value AS old, y.value AS new FROM u x JOIN u y USING (dataset, key, field)
            JOIN before ON before.field = x.field AND src = x.value AND dst = y.value),
    scored AS (SELECT v.*, EXISTS (FROM met WHERE (met.dataset, met.key, met.field, old) = (v.dataset, v.key, v.field, v.value)) AS lost,
               (SELECT count(*) FROM met WHERE (met.dataset, met.key, met.field, new) = (v.dataset, v.key, v.field, v.value)) AS won FROM v),
    b AS (SELECT *, row_number() OVER (PARTITION BY dataset, key, field ORDER BY lost, won DESC, last_at DESC NULLS LAST, n DESC, value) AS i FROM scored),
    z AS (SELECT dataset, key, count(*) AS n_records FROM g GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT z.dataset, z.key AS exact_code_key, n_records, {', '.join(f"min(value) FILTER (field = '{f}') AS {f}" for f in FIELDS)}
    FROM z LEFT JOIN b ON z.dataset = b.dataset AND z.key = b.key AND i = 1 GROUP BY ALL""",
}
