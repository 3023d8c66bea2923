import pandas as pd
from pyspark.sql import functions as F

from siftspark.operators import heavy
from siftspark.operators.skew import join_hot, keyed_states, running

ROWS = [("hot", i, i % 7) for i in range(300)] + [("b", 1, None), (None, 5, 2), (None, 5, 2), ("", 0, 1), ("c", None, 4)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "k string, o int, v int").withColumn("count", F.lit("clash"))


def test_states_of_hot_and_null_keys(spark):
    got = keyed_states(frame(spark), ["k"], ["o"], {"n": (F.lit(1), "count"), "s": (F.col("v"), "sum"), "hi": (F.col("v"), "max")}, 8).collect()
    want = pd.DataFrame(ROWS, columns=["k", "o", "v"]).groupby("k", dropna=False).v
    assert {r["k"]: r["n"] for r in got} == {"hot": 300, "b": 1, None: 2, "": 1, "c": 1}
    assert {r["k"]: r["s"] for r in got}["hot"] == want.sum()["hot"]
    assert {r["k"]: r["hi"] for r in got}["b"] is None


def test_running_is_stitched_at_borders(spark):
    got = running(frame(spark), "k", ["o"], "v", partitions=8).collect()
    assert len(got) == len(ROWS)
    hot = sorted((r["o"], r["running"], r["rank"]) for r in got if r["k"] == "hot")
    total = 0
    for o, run, rank in hot:
        total += o % 7
        assert (run, rank) == (total, o + 1)
    assert sorted(r["rank"] for r in got if r["k"] is None) == [1, 2]
    assert [r["running"] for r in got if r["k"] == "b"] == [0]


def test_empty(spark):
    e = frame(spark, [])
    assert keyed_states(e, ["k"], ["o"], {"n": (F.lit(1), "count")}).count() == 0
    assert running(e, "k", ["o"], "v").count() == 0


def test_heavy_projects(spark, folder):
    got = heavy.heavy_projects(spark, folder)
    assert got.columns == ["table_name", "project"] and got.count() > 0
    for name in ("records", "cache_locations"):
        t = spark.read.parquet(f"{folder}/{name}.parquet").toPandas()
        n = t.project.dropna().str.strip().value_counts()
        want = set(n[(n * 100 >= 2 * len(t))].index) - {""}
        assert {r["project"] for r in got.where(F.col("table_name") == name).collect()} == want


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from siftspark.operators import skew

    big = spark.createDataFrame([("a", i) for i in range(60)] + [("b", 1), ("c", 2), (None, 3), ("none", 4)], "k string, x int")
    small = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("unused", "U")], "k string, v string")
    sizes = big.groupBy("k").agg(F.count(F.lit(1)).alias("_k"))
    for parts in (1, 2, 1000):
        monkeypatch.setattr(skew, "HOT", parts)
        for how in ("inner", "left"):
            got, want = join_hot(big, small, "k", sizes, how), big.join(small, "k", how)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert join_hot(big.limit(0), small, "k", sizes.limit(0)).count() == 0
