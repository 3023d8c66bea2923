import pytest
from pyspark.sql import functions as F

from siftspark.plans import jobs
from siftspark.sources import lines, sinks
from siftspark.streaming import ingest


def test_line_numbers_across_blocks(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b"
    a.write_text("".join(f"line {i}\n" for i in range(5000)))
    b.mkdir()
    (b / "part-0").write_text("x\n\ny\n")
    (b / "part-1").write_text("z")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = lines.numbered_lines(spark, [str(a), str(b)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["line_number"], r["value"]) for r in got if r["file_ord"] == 0) == [(i + 1, f"line {i}") for i in range(5000)]
    assert sorted((r["line_number"], r["value"]) for r in got if r["file_ord"] == 1) == [(1, "x"), (2, ""), (3, "y"), (4, "z")]


def test_malformed_line_is_an_error(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"x": 1}\n\n{"x": oops\n')
    with pytest.raises(Exception):
        lines.read_jsonl(spark, [str(p)], "x int").collect()
    with pytest.raises(Exception):
        lines.read_jsonl(spark, [str(tmp_path / "none")], "x int").collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}", None) for i in range(100)], "i int, v string, w double")
    sinks.write_csv(df, str(tmp_path / "c"), ["i"])
    with pytest.raises(Exception):
        sinks.write_csv(df, str(tmp_path / "c"), ["i"])
    back = sinks.read_csv(spark, str(tmp_path / "c"), "i int, v string, w double")
    d = lambda x: sinks.content_digest(x).first()
    assert d(back) == d(df) == d(df.repartition(5)) != d(df.where("i > 0"))
    assert sinks.inventory(spark, str(tmp_path / "c")).where(F.length("digest") == 64).count() > 0
    assert d(df.limit(0))["n"] == 0


def test_job(spark, folder, tmp_path):
    made = jobs.run(spark, "corpus_audit", folder, str(tmp_path / "out"))
    assert made.count() > 0 and spark.read.parquet(str(tmp_path / "out/corpus_audit/files")).count() > 0
    assert all(q in jobs._ALL for job in jobs.JOBS.values() for q in job.values())


def test_stream_dedup(spark, folder):
    s = ingest.read_events(spark, folder)
    q = ingest.first_of_each(s.withColumn("k", F.col("event_id") % 50), ["k"], "ts", "3650 days").writeStream.format("memory").queryName("firsts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 50
    w = ingest.windowed_counts(s, "ts", ["event_type"]).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    w.processAllAvailable()
    w.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{folder}/events.parquet").count()


def test_array_files(spark, tmp_path):
    from siftspark.sources.arrays import registered

    registered(spark)
    df = spark.createDataFrame([(i, i / 3, f"s{i}" if i % 9 else "", [float(i), 1.0]) for i in range(500)], "i long, x double, s string, v array<float>")
    df.write.format("npz").mode("append").save(f"file://{tmp_path}/a")
    back = spark.read.format("npz").schema("s string, v array<float>, i long").option("range", 64).load(f"{tmp_path}/a")
    assert back.count() == 500 and back.exceptAll(df.select("s", "v", "i")).count() == 0
    with pytest.raises(Exception, match="exists already"):
        df.write.format("npz").mode("append").save(f"{tmp_path}/a")
    with pytest.raises(Exception, match="nulls"):
        df.withColumn("i", F.lit(None).cast("long")).write.format("npz").mode("append").save(f"{tmp_path}/null")
    with pytest.raises(Exception, match="file system"):
        df.write.format("npz").mode("append").save("hdfs://nowhere/a")
    df.limit(0).write.format("npz").mode("append").save(f"{tmp_path}/none")
    assert spark.read.format("npz").schema("i long").load(f"{tmp_path}/none").count() == 0


def test_sqlite_files(spark, tmp_path):
    import sqlite3

    from siftspark.sources.arrays import registered

    registered(spark)
    con = sqlite3.connect(f"{tmp_path}/x.sqlite")
    con.execute('CREATE TABLE "a b" (i, "odd ""name""", t)')
    con.executemany('INSERT INTO "a b" VALUES (?, ?, ?)', [(i, i * 0.5 if i % 3 else None, f"t{i}") for i in range(300)])
    con.execute('DELETE FROM "a b" WHERE i % 10 = 0')
    con.commit()
    con.close()
    before = (tmp_path / "x.sqlite").read_bytes()
    t = spark.read.format("sqlite").schema('t string, `odd "name"` double').option("table", "a b").option("range", 40).load(f"{tmp_path}/x.sqlite")
    rows = {r["t"]: r['odd "name"'] for r in t.collect()}
    assert rows == {f"t{i}": (i * 0.5 if i % 3 else None) for i in range(300) if i % 10} and (tmp_path / "x.sqlite").read_bytes() == before
    with pytest.raises(Exception):
        spark.read.format("sqlite").schema("i long").option("table", "a b").load(f"{tmp_path}/gone.sqlite").count()


def test_index_reopens_whole_only(spark, tmp_path):
    from siftspark.operators import lsh

    rows = [(i, lsh.SOURCE if i % 2 else lsh.TARGET, f"r{i}", f"int f{i % 5}(int a) {{ return a + {i % 3}; }}") for i in range(20)]
    sets = lsh.classes_of(spark.createDataFrame(rows, "doc_id long, dataset string, row_id string, text string"))
    p = f"{tmp_path}/index"
    lsh.write_index(sets, p)
    index = lsh.open_index(spark, p)
    assert index.documents.count() == 20 and index.signatures.count() == sets.classes.count()
    index.documents.limit(19).write.parquet(f"{tmp_path}/short/documents")
    index.signatures.write.parquet(f"{tmp_path}/short/signatures")
    spark.read.json(f"{p}/manifest").write.json(f"{tmp_path}/short/manifest")
    with pytest.raises(ValueError, match="counts"):
        lsh.open_index(spark, f"{tmp_path}/short")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        lsh.write_index(sets, p)
