import random

import pytest
from pyspark.sql import functions as F

from siftspark.llm import encode, forest, mixing, quality, splits, survivor

RECORD = (
    "dataset string, row_id string, exact_code_key string, project string, project_group string, commit_id string, "
    "source_role string, first_position long, ingested_at timestamp, conflicting_label int, n int, split string, unit string"
)
LABEL = "row_id string, target int, labelled_at timestamp, position long"
DOCS = "doc_id long, dataset string, row_id string, exact_code_key string, text string, source string, n_tokens string"


def record(row_id, key, project=None, group=None, commit=None, role=None, at=None, day=None, conflict=0):
    from datetime import datetime

    when = None if day is None else datetime(2024, 1, day)
    return ("d", row_id, key, project, group, commit, role, at, when, conflict, 9, "x", "y")


def label(row_id, target, day):
    from datetime import datetime

    return (row_id, target, None if day is None else datetime(2024, 2, day), 0)


def survived(spark, records, labels, docs=()):
    rows = survivor.keyed(spark.createDataFrame(records, RECORD), spark.createDataFrame(list(docs), DOCS), spark.createDataFrame(labels, LABEL))
    return rows


def test_survivors(spark):
    recs = [
        record("a1", "A", "p", "g", at=5, day=1),
        record("a2", " a ", "p", " ", at=4, day=9),
        record("a3", "A", "p", "g", at=6, day=1),
        record("b1", "b", at=1), record("b2", "B", at=2),
        record("c1", "c", at=1, conflict=1), record("c2", "c", at=2),
        record("d1", "d", at=1), record("e1", None, at=1), record("e2", "e", at=9, day=None), record("f1", "f"), record("f2", "f"),
    ]
    labels = [label("a1", 1, 1), label("a1", 0, 3), label("a1", None, 5), label("a3", 0, 1), label("b1", 0, 1), label("b2", 1, 1), label(None, 1, 1), label("f1", 1, None)]
    docs = [(1, "d", "e1", "E\n", "t", "s", "z")]
    rows = survived(spark, recs * 2, labels, docs)
    got = {tuple(r) for r in survivor.survivors(rows).collect()}
    assert got == {("d", "a", "a1"), ("d", "e", "e1"), ("d", "f", "f1")}


def test_currency_without_timestamps(spark):
    recs = []
    for i in range(4):  # old gives way to new wherever rows are dated
        recs += [record(f"{i}x", f"k{i}", "old", role="train", day=1), record(f"{i}y", f"k{i}", "new", day=2)]
    recs += [record("u", "q", "old", commit="c1"), record("v", "q", "new", commit="c0"), record("w", "q", "old"), record("z", "one", "old")]
    rows = survived(spark, recs, [])
    steps = {tuple(r) for r in survivor.transitions(survivor._values(rows)).collect()}
    assert steps == {("project", "old", "new", 4)}
    got = {r["exact_code_key"]: r for r in survivor.fused(rows).collect()}
    assert set(got) == {"k0", "k1", "k2", "k3", "q"}
    assert got["q"]["project"] == "new" and got["q"]["n_records"] == 3 and got["q"]["commit_id"] == "c0" and got["q"]["source_role"] is None
    assert got["k1"]["project"] == "new" and got["k1"]["source_role"] == "train"


def test_precedence_without_cycles(spark):
    """Chains reach through values that no group holds, and of a cycle the weakest link gives way."""
    steps = [("f", "a", "b", 5), ("f", "b", "c", 4), ("f", "c", "a", 1), ("f", "c", "d", 2), ("g", "d", "a", 9)]
    order = spark.createDataFrame(steps, "field string, value string, later string, seen long")
    wanted = spark.createDataFrame([("f", x) for x in "acd"], "field string, value string")
    assert {tuple(r) for r in survivor.precedence(order, wanted).collect()} == {("f", "a", "c"), ("f", "a", "d"), ("f", "c", "d")}
    assert survivor.precedence(order, wanted.limit(0)).count() == 0


def undated(seed=5):
    """Groups whose projects run through versions in time, some rows without one, and a cycle now and then."""
    r = random.Random(seed)
    recs = []
    for k in range(120):
        at = sorted(r.sample(range(1, 28), 3))
        versions = sorted(r.sample(range(8), 3))
        if k % 10 == 0:
            versions.reverse()
        for i, (day, v) in enumerate(zip(at, versions, strict=True)):
            role = r.choice([None, "train", "calibration"])
            recs.append(record(f"r{k}.{i}", f"k{k}", f"v{v}", f"g{v // 2}", role=role, at=1000 * k + i, day=day if k < 60 or r.random() < 0.5 else None))
    return recs


def duck(records, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for table, schema, rows in (("records", RECORD, records), ("documents", DOCS, []), ("labels", LABEL, [])):
        columns = ", ".join(c.strip().replace("long", "BIGINT").replace("string", "VARCHAR") for c in schema.split(","))
        con.sql(f"CREATE TABLE {table} ({columns})")
        if rows:
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])  # noqa: F841
            con.sql(f"INSERT INTO {table} SELECT * FROM frame")
    return con.sql(survivor.ORACLE[name])


def test_fused_against_sql(spark):
    from compare import rows as same

    recs = undated()
    want = duck(recs, "p4_fused")
    got = survivor.fused(survived(spark, recs, []))
    assert sorted(got.columns) == sorted(want.columns)
    a, b = same(got.collect(), got.columns), same(want.fetchall(), want.columns)
    assert a == b and len(a) == 120


def test_survivor_without_timestamp(spark):
    """An undated row wins over the latest dated one only if its values are known to come later."""
    recs = []
    for i in range(4):
        recs += [record(f"{i}x", f"k{i}", "old", at=2 * i, day=1), record(f"{i}y", f"k{i}", "mid", at=2 * i + 1, day=2)]
        recs += [record(f"{i}z", f"m{i}", "mid", at=2 * i, day=1), record(f"{i}w", f"m{i}", "new", at=2 * i + 1, day=2)]
    recs += [record("u", "q", "old", at=100, day=9), record("v", "q", "new", at=101), record("w", "q", "new", at=99)]
    recs += [record("a", "s", "new", at=100, day=1), record("b", "s", "old", at=1)]
    recs += [record("c", "t", "x", at=100, day=1), record("d", "t", "y", at=1), record("e", "e", "x", at=3), record("f", "e", "x", at=2)]
    got = {r["exact_code_key"]: r["row_id"] for r in survivor.survivors(survived(spark, recs, [])).collect()}
    assert got == {**{f"k{i}": f"{i}y" for i in range(4)}, **{f"m{i}": f"{i}w" for i in range(4)}, "q": "w", "s": "a", "t": "c", "e": "f"}


def test_forest(spark):
    r = random.Random(1)
    edges = [(r.randrange(120), r.randrange(120), r.randrange(9)) for _ in range(90)] + [(i, i + 1, 0) for i in range(200, 240)] + [(5, 5, 1), (None, 3, 1)]
    df = spark.createDataFrame(edges, "a int, b int, w int")
    kept, roots = forest.spanning_forest(df)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    cost = used = 0
    for a, b, w in sorted((e for e in edges if e[0] is not None and e[0] != e[1]), key=lambda e: (e[2], min(e[:2]), max(e[:2]))):
        x, y = sorted((find(a), find(b)))
        if x != y:
            root[y] = x
            cost, used = cost + w, used + 1
    assert {tuple(x) for x in roots.collect()} == {(x, find(x)) for x in list(root)}
    weights = {}
    for a, b, w in edges:
        if a is not None:
            k = (min(a, b), max(a, b))
            weights[k] = min(w, weights.get(k, 99))
    found = [tuple(x) for x in kept.collect()]
    assert len(found) == len(set(found)) == used and sum(weights[x] for x in found) == cost
    empty = forest.spanning_forest(df.limit(0))
    assert empty[0].count() == empty[1].count() == 0


def test_splits(spark):
    hexes = [f"{i:040x}" for i in range(400)]
    r = random.Random(3)
    recs = [record(f"r{i}", None, f"p{r.randrange(60)}", commit=hexes[1 + r.randrange(300)] if i % 9 == 0 else None) for i in range(900)]
    recs += [record(f"s{i}", None, " hot ", commit="0" * 40) for i in range(400)]
    recs += [record("n1", None, None, " p1 "), record("n2", None), record("n3", None, commit=hexes[399].upper()), record("n4", None, commit=hexes[399]), record("n5", None, "alias")]
    df, aliases = spark.createDataFrame(recs * 2, RECORD), spark.createDataFrame([("alias", "p2"), ("alias", "p2"), (None, "z")], "alias string, project_group string")
    got = splits.assign(df, aliases).toPandas()
    assert len(got) == len(recs) and got.groupby("unit").split.nunique().max() == 1
    by = got.set_index("row_id")
    assert by.unit["n3"] == by.unit["n4"] and by.unit["n2"] == "record n2" and by.split["n1"] == by[by.unit == by.unit["n1"]].split.iloc[0]
    groups = {}
    for x in recs:
        groups.setdefault((x[3] or "").strip(), set()).add(by.split[x[1]])
        if x[5] and x[5].strip("0"):
            groups.setdefault(x[5].lower(), set()).add(by.split[x[1]])
    assert all(len(v) == 1 for k, v in groups.items() if k)
    bound = splits.bound_groups(df, aliases).toPandas()
    least = bound.groupby("unit_group").project_group.min()
    assert len(bound) and (least == least.index).all()
    none = df.limit(0)
    assert splits.assign(none, aliases).count() == 0 and splits.bound_groups(none, aliases).count() == 0


def test_deal_meets_proportions(spark):
    recs = [record(f"r{i}", None, f"p{i // 3}") for i in range(9000)]
    df = spark.createDataFrame(recs, RECORD)
    share = {r["split"]: r["share"] for r in splits.shares(splits.assign(df, spark.createDataFrame([], "alias string, project_group string"))).collect()}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01 and abs(share["validation"] - 0.1) < 0.01


TEXTS = ["", None, " ", "int x;\r\n\treturn x;", "naïve 🚀🚀 Größe 漢字", "<|endoftext|> plain", "a" * 300_000, "x y " * 100_000, "\u0000﻿ "]


def test_encoding(spark):
    rows = [(i, "context", None, None, t, "s", "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, DOCS)
    ids = {r["doc_id"]: r["ids"] for r in encode.token_ids(df).collect()}
    assert ids[0] == ids[1] == [] and 50256 not in ids[5] and len(ids) == len(TEXTS)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.VOCABULARY)
    t.encode_special_tokens = True
    assert all(ids[i] == t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS))
    assert all(r["same"] for r in encode.round_trip(df).collect())
    spans = {r["doc_id"]: r for r in encode.token_spans(df).collect()}
    assert spans[4]["n_split"] > 0 and spans[3]["n_split"] == 0
    assert all(s["n_bytes"] == (s["ends"][-1] if s["ends"] else 0) for s in spans.values())
    bad = spark.createDataFrame([(1, [10**6]), (2, None), (3, [ids[4][-1]])], "doc_id long, ids array<int>")
    back = {r["doc_id"]: r["text"] for r in encode.decoded(bad).collect()}
    assert back[1] == "�" and back[2] is None
    assert encode.token_ids(df.limit(0)).count() == 0


def test_byte_characters():
    table = encode.byte_characters()
    assert len(set(table)) == 256 and table[ord("A")] == "A" and table[32] == "Ġ"


@pytest.mark.parametrize("shares", [{"a": 0.5, "b": 0.5}, {"a": 0.61, "b": 0.3, "c": 0.09}, {f"s{i}": i + 1 for i in range(12)}, {"a": 0.99999, "b": 0.00001}, {"a": 1 / 3, "b": 2 / 3}])
def test_schedule_stays_within_a_block(shares):
    blocks = mixing.period(shares, 200_000)
    slots, q = mixing.schedule(blocks), sum(blocks.values())
    assert set(blocks) == set(shares)
    assert sorted(t for v in slots.values() for t in v) == list(range(q))
    for s, n in blocks.items():
        for j, t in enumerate(slots[s]):
            assert j * q // n <= t < -(-(j + 1) * q // n)


def test_no_source_is_left_out():
    assert mixing.period({"a": 0.99996, "b": 0.00004}) == {"a": 24999, "b": 1}
    tiny = mixing.period({"a": 1.0, "b": 1e-12, "c": 0.1234567890123})
    assert set(tiny) == {"a", "b", "c"} and min(tiny.values()) >= 1
    assert mixing.period({}) == {} == mixing.period({"a": 0.0})


def test_mixture(spark):
    """Documents that are longer than a block, a source with a share of 1e-5, sources without text or name."""
    rows = [(i, "c", None, None, "word " * (90 if i % 50 == 0 else 1 + i % 7), [" Big\n", "big", "small", "none", None, "empty"][i % 6 if i > 120 else 0], "clash") for i in range(400)]
    rows += [(1000, "c", None, None, None, "big", ""), (1001, "c", None, None, "", "empty", ""), (1002, "c", None, None, "word " * 5, "tiny", "")]
    rows = [r if r[5] != "empty" else (*r[:4], "", *r[5:]) for r in rows]
    asked = [("big", 0.5, 200), ("small", 0.4, 999), ("empty", 0.1, 2), ("tiny", 0.00001, 1), (None, 0.2, 1), ("null", None, 1)]
    targets = spark.createDataFrame(asked, "source string, target_share double, max_repeats int")
    df, size = spark.createDataFrame(rows, DOCS), 16
    mix = mixing.mixture(df, targets, block=size)
    got = {r["source"]: r for r in mixing.shares(mix, targets).collect()}
    total = 0.90001
    assert abs(got["big"]["share"] - 0.5 / total) < 0.005 and abs(got["small"]["share"] - 0.4 / total) < 0.005
    assert got["small"]["most_uses"] <= 999 and got["big"]["most_uses"] <= 200 and got["empty"]["n_uses"] == 0 and got["tiny"]["most_uses"] == 1
    p = mix.toPandas()
    assert not p.duplicated(["doc_id", "use"]).any() and set(p.source) == {"big", "small", "tiny"}

    pieces = mixing.blocks(df, targets, block=size)
    b = pieces.toPandas()
    # The pieces of a use are the document, in order, and a slot has one block of one source.
    whole = b.groupby(["doc_id", "use"]).n_tokens.sum().sort_index()
    assert whole.equals(p.set_index(["doc_id", "use"]).n_tokens.sort_index())
    starts = b.sort_values(["doc_id", "use", "start"])
    assert (starts.groupby(["doc_id", "use"]).n_tokens.cumsum() - starts.n_tokens == starts.start).all()
    per_slot = b.groupby("slot").agg(tokens=("n_tokens", "sum"), sources=("source", "nunique"), numbers=("number", "nunique"))
    assert (per_slot.sources == 1).all() and (per_slot.numbers == 1).all() and per_slot.tokens.max() == size
    assert (per_slot.tokens < size).sum() <= 3
    # Block by block, by brute force: less than one block from the share at every slot while all sources run.
    order = b.groupby(["slot", "source"]).n_tokens.sum().reset_index()
    end = int(order.groupby("source").slot.max().drop("tiny").min())
    weight = {"big": 0.5 / total, "small": 0.4 / total, "tiny": 0.00001 / total}
    given, worst = dict.fromkeys(weight, 0), 0.0
    dealt = dict(zip(order.slot, zip(order.source, order.n_tokens, strict=True), strict=True))
    for t in range(end):
        s, n = dealt.get(t, ("tiny", 0))
        given[s] += n
        worst = max(worst, *(abs(given[x] / size - weight[x] * (t + 1)) for x in ("big", "small")))
    assert worst < 1
    lags = {r["source"]: r for r in mixing.lag(pieces, targets, block=size).collect()}
    assert all((r["ahead"] or 0) < 1 and r["behind"] < 1 for r in lags.values()) and lags["big"]["n_blocks"] == b[b.source == "big"].number.nunique()
    assert mixing.mixture(df.limit(0), targets).count() == 0 and mixing.mixture(df, targets.limit(0)).count() == 0
    assert mixing.blocks(df.limit(0), targets).count() == 0


PROSE = "The lock was taken before the buffer had been freed, which is why the test fails. We have not seen this in the last run."


def test_types(spark):
    texts = {
        0: PROSE, 1: "  " + PROSE.replace(" ", "\n", 3), 2: "- one item\n- two\n- three more\n* four", 3: "a|b|c\n1|2|3\n4|5|6\n7|8|9",
        4: None, 5: " \t\n", 6: "qwrtp sdfgh zxcvb mnbvc lkjhg pqwrt ghjkl", 7: "", 8: "Die Sperre wurde erst nach dem Puffer freigegeben, weil die Länge noch belegt war.",
        9: "T€he loÃck waÂs ta™ken befo€re th¿e bufÃfer h�ad be™en frÃeed b€y the te¿st.", 10: PROSE * 2000,
    }
    rows = [(i, "context", None, None, t, "s", "clash") for i, t in texts.items()] + [(100 + i, "context", None, None, f"{PROSE} {i}", "s", "") for i in range(60)]
    german = "Die Sperre wurde erst nach dem Puffer freigegeben, weil die Länge noch nicht belegt war und der Leser wartet."
    rows += [(200 + i, "context", None, None, f"{german} {i}", "s", "") for i in range(30)]
    rows += [(300 + i, "context", None, None, f"k{i}: 1\nv_{i}: no\nx{i}: 0x1\n", "s", "") for i in range(20)] + [(999, "primevul", None, None, "{};", "s", "")]
    df = spark.createDataFrame(rows, DOCS).withColumn("lang", F.when(F.col("doc_id").between(200, 299) | (F.col("doc_id") == 8), "de").when(F.col("doc_id") % 5 > 0, "en"))
    words = quality.common_words(df)
    assert {"the", "was", "der", "wurde", "nicht"} <= set(words) and "qwrtp" not in words and "" not in words
    assert quality.common_words(df.drop("lang")) and quality.common_words(df.limit(0)) == []
    found = {r["doc_id"] for r in quality.not_prose(df).collect()}
    assert {x for x in found if x < 100} == {2, 3, 6, 9} and {x for x in found if x >= 100} == set(range(300, 320))
    t = {r["doc_id"]: r for r in quality.typed(df.where("dataset = 'context'")).collect()}
    assert t[2]["type"] == "list" and t[3]["type"] == "table" and t[6]["type"] == "junk" and 4 not in t and 5 not in t and 7 not in t
    assert all(abs(sum(r[f"p_{x}"] for x in quality.TYPES) - 1) < 1e-9 for r in t.values())
    s = {r["doc_id"]: r for r in quality.statistics(df).collect()}
    assert s[0]["n_words"] == len(PROSE.split()) and s[0]["lines_ending_in_punctuation"] == 1.0 and s[2]["bullet_lines"] == 1.0
    assert quality.not_prose(df.limit(0)).count() == 0 and quality.function_accuracies(df.limit(0)).count() == len(quality.FUNCTIONS)


def test_em_learns_accuracies():
    r = random.Random(8)
    patterns = {}
    for _ in range(3000):
        prose = r.random() < 0.7
        v = [0] * len(quality.FUNCTIONS)
        for j, acc in ((0, 0.95), (1, 0.9), (2, 0.7)):
            v[j] = 1 if (r.random() < acc) == prose else 2
        patterns[tuple(v)] = patterns.get(tuple(v), 0) + 1
    acc, prior = quality.learn([(list(k), n) for k, n in patterns.items()])
    assert len(patterns) > 4
    assert abs(acc[0] - 0.95) < 0.04 and abs(acc[1] - 0.9) < 0.04 and abs(acc[2] - 0.7) < 0.05 and abs(prior[0] - 0.7) < 0.05


def test_em_in_parts(spark):
    """Rounds over a table give what the driver learns, and a model learned on one half types the other as its own does."""
    rows = [(i, "context", None, None, [f"{PROSE} {i}", f"- a{i}\n- b\n- c\n- d", f"a|b|{i}\n1|2|3\n4|5|6\n7|8|9"][i % 3], "s", "") for i in range(120)]
    df = spark.createDataFrame(rows, DOCS)
    voted = quality._voted(df)
    (a, p), (b, q) = quality._fit(voted), quality._fit(voted, most=0)
    assert abs(a - b).max() < 1e-9 and abs(p - q).max() < 1e-9
    cells = quality.halves(df).collect()
    same = sum(r["n"] for r in cells if r["type"] == r["other_type"])
    assert sum(r["n"] for r in cells) == 120 and same >= 118 and {r["half"] for r in cells} == {0, 1}
