import math
import random
import time
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.operators import aggregates, conformal, joins, learning, metrics, predicates, prom, skew, statistics, validation, windows
from siftspark.operators import sets as so


@pytest.mark.parametrize("slot", [skew.size_slot, lambda x: F.floor(x / 10).cast("int"), lambda x: F.lit(0)])
def test_first_at_least(spark, slot):
    r = random.Random(1)
    steps = [(g, float(x), f"v{g}{x}") for g in (0, 1) for x in r.sample(range(40), 12)]
    qs = [(i, i % 3, float(r.randrange(45)) if i % 7 else None) for i in range(60)]
    got = joins.first_at_least(spark.createDataFrame(steps, "g int, at double, v string"), spark.createDataFrame(qs, "i int, g int, q double"), ["g"], "at", "v", "q", slot).collect()
    want = {i: min(((a, v) for k, a, v in steps if k == g and q is not None and a >= q), default=(None, None))[1] for i, g, q in qs}
    assert {x["i"]: x["v"] for x in got} == want


def test_dedup_counts_against_the_first_row(spark):
    rows = [("k", 1, 0, "a"), ("k", 1, 1, "b"), ("k", 0, 2, "c"), ("k", 1, 3, "d"), ("m", 0, 4, "e"), ("m", 0, 5, "f"), ("z", 1, 6, "g")]
    got = aggregates.dedup(spark.createDataFrame([("d", *r) for r in rows], "ds string, key string, target int, at int, row_id string"), ["ds"], "key", "target", ["at"], "row_id").collect()
    assert {(r["key"], r["row_id"], r["n"], r["same_label"], r["conflicting"]) for r in got} == {("k", "a", 4, 2, True), ("m", "e", 2, 1, False), ("z", "g", 1, 0, False)}


def test_ordered_digest_depends_on_order_only(spark):
    a = spark.createDataFrame([("g", i, f"x{i}") for i in range(50)], "g string, p long, x string")
    d = lambda df: aggregates.ordered_digest(df, "g", "p", "x", fan=4).first()["digest"]
    assert d(a) == d(a.repartition(7)) != d(a.withColumn("p", 49 - F.col("p")))


def test_equal_bins(spark):
    for n in (1, 14, 15, 17, 100):
        got = [r[0] for r in spark.range(n).select(windows.equal_bin(F.col("id"), F.lit(n)).alias("b")).orderBy("id").collect()]
        want = [k for k, part in enumerate(np.array_split(np.arange(n), min(15, n))) for _ in part]
        assert got == want


def test_nested_samples(spark):
    rows = [("c", 0, "g", i, f"r{i}", int(i % 10 == 0), i / 100) for i in range(100)]
    df = spark.createDataFrame(rows, "detector string, seed int, target_group string, position long, row_id string, y int, p double")
    sizes = {f: {r["row_id"] for r in windows.nested_sample(df, ["detector", "seed"], f, 1, "s", 10, 5).collect()} for f in (0.1, 0.3, 1.0)}
    assert sizes[0.1] <= sizes[0.3] <= sizes[1.0] and len(sizes[1.0]) == 100
    assert sum(int(x[1:]) % 10 == 0 for x in sizes[0.1]) >= 5


def test_holm(spark):
    got = {r["k"]: r["adjusted"] for r in windows.holm(spark.createDataFrame([(1, "a", 0.01), (1, "b", 0.04), (1, "c", 0.03), (1, "d", None)], "g int, k string, p double"), ["g"], "p", ["k"]).collect()}
    assert got == {"a": pytest.approx(0.03), "c": pytest.approx(0.06), "b": pytest.approx(0.06)}


CELLED = "detector string, target_group string, seed int, side string, position long, row_id string, p double, ratio double, y int"


def scores(p, y, side, ratio=1.0):
    return [("d", "g", 1, side, i, f"{side}{i}", float(x), float(ratio if np.isscalar(ratio) else ratio[i]), int(k)) for i, (x, k) in enumerate(zip(p, y, strict=True))]


def test_mondrian_by_definition(spark):
    r = np.random.default_rng(3)
    p, y = np.round(r.random(80), 2), r.integers(0, 2, 80)
    got = {(x["y"], x["alpha"]): x["threshold"] for x in conformal.mondrian(spark.createDataFrame(scores(p, y, "calibration"), CELLED), ["detector", "seed"]).collect()}
    for label, alphas in conformal.ALPHAS.items():
        s = np.sort([1 - v if label else 1 - (1 - v) for v, k in zip(p, y, strict=True) if k == label])
        for a in alphas:
            level = min(1.0, math.ceil((len(s) + 1) * (1 - a)) / len(s))
            assert got[(label, a)] == s[max(0, min(len(s) - 1, math.ceil(level * len(s)) - 1))]


def test_missing_class_is_in_every_set(spark):
    cal, tgt = (spark.createDataFrame(scores([0.1, 0.2], [0, 0], s), CELLED) for s in ("calibration", "target"))
    got = conformal.mondrian_sets(tgt, conformal.mondrian(cal, ["detector", "seed"]), ["detector", "seed"])
    assert got.where("not in_vulnerable").count() == 0 and got.count() == 18


def test_weighted_sets_by_definition(spark):
    r = np.random.default_rng(5)
    pc, yc, wc = np.round(r.random(40), 3), r.integers(0, 2, 40), np.round(np.exp(r.normal(0, 2, 40)), 4)
    pt, yt, wt = np.round(r.random(12), 3), r.integers(0, 2, 12), np.round(np.exp(r.normal(0, 2, 12)), 4)
    cal, tgt = spark.createDataFrame(scores(pc, yc, "calibration", wc), CELLED), spark.createDataFrame(scores(pt, yt, "target", wt), CELLED)
    got = {(x["position"], x["clip"], x["label"], x["alpha"]): x["threshold"] for x in conformal.weighted_thresholds(cal, tgt, ["detector", "seed"]).collect()}
    for (i, c), label in product(product(range(12), (10.0, 20.0, 50.0)), (0, 1)):
        w, t = np.clip(wc[yc == label], 1 / c, c), np.clip(wt[i], 1 / c, c)
        s = np.array([1 - v if label else 1 - (1 - v) for v in pc[yc == label]])
        o = np.argsort(s, kind="stable")
        cum = np.cumsum(w[o])
        for a in conformal.ALPHAS[label]:
            at = np.searchsorted(cum, (1 - a) * (cum[-1] + t), side="left")
            want = None if at >= len(s) else s[o][at]
            assert got[(i, c, label, a)] == want


def test_ess(spark):
    one = spark.createDataFrame([(1.0,)] * 10, "w double").agg(aggregates.kish_ess(F.col("w")), aggregates.kish_ess(F.lit(None).cast("double"))).first()
    assert tuple(one) == (10.0, 0.0)


def test_weight_summary(spark):
    r = aggregates.weight_summary(spark.createDataFrame([("a", 0.001), ("a", 1.0), ("a", 1000.0)], "k string, ratio double"), ["k"], 20.0).first()
    assert (r["least"], r["most"], r["low"], r["high"]) == (0.05, 20.0, 1, 1)


def test_triage(spark):
    rows = [(0, 0.1, True, False), (1, 0.9, False, True), (0, 0.4, True, True), (1, 0.4, True, False)]
    m = metrics.triage(spark.createDataFrame([("m", *r) for r in rows], "k string, y int, p double, in_safe boolean, in_vulnerable boolean"), ["k"]).first()
    assert (m["singleton_coverage"], m["review_load"], m["vulnerable_miscoverage"], m["safe_miscoverage"], m["vulnerable_singleton_rate"], m["safe_singleton_rate"]) == (0.75, 0.25, 0.5, 0.0, 1.0, 0.5)


def test_ranking_metrics_by_definition(spark):
    r = np.random.default_rng(7)
    p, y = np.round(r.random(200), 1), r.integers(0, 2, 200)
    df = spark.createDataFrame([("k", float(a), int(b)) for a, b in zip(p, y, strict=True)], "k string, p double, y int")
    auc = metrics.auroc(df, ["k"], "p", "y").first()["auroc"]
    assert auc == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]))
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        rec = y[hit].sum() / y.sum()
        ap, last = ap + (rec - last) * y[hit].mean(), rec
    assert metrics.average_precision(df, ["k"], "p", "y").first()["pr_auc"] == pytest.approx(ap)
    one = df.where("y = 1")
    assert metrics.auroc(one, ["k"], "p", "y").first()["auroc"] is None and metrics.fnr_at_fpr(df.where("y = 0"), ["k"], "p", "y").first()["fnr_at_fpr"] is None


P, Y, U = [0.2, 0.7, 0.4, 0.6], [0, 0, 1, 1], [0.0, 0.5, 0.25, 0.75]
EXPECTED = {"lac": [0.2, 0.7, 0.6, 0.4], "topk": [0, 1, 1, 0], "aps": [0.8, 0.85, 0.9, 0.15], "raps": [0.8, 1.05, 1.1, 0.15]}


@pytest.mark.parametrize("expert", prom.EXPERTS)
def test_expert_scores(spark, expert):
    got = prom.cell_scores(expert, np.array(P), np.array(Y), np.array(U), 1, 0.2)
    assert got == pytest.approx(EXPECTED[expert])
    df = spark.createDataFrame(list(zip(range(4), P, Y, U, strict=True)), "i int, p double, y int, u double")
    cols = [r[0] for r in df.orderBy("i").select(prom.expert_score(expert, F.col("p"), F.col("y"), F.col("u"), 1, 0.2)).collect()]
    assert cols == pytest.approx(EXPECTED[expert])


def test_adapter_parts(spark):
    assert prom.cell_higher(np.array([0.1, 0.2, 0.9]), 0.5) == 0.9
    assert [r[0] for r in spark.createDataFrame([(199,), (200,), (209,), (210,)], "n int").select(prom.neighbours(F.col("n"))).collect()] == [199, 20, 20, 21]
    cal = np.array([0.2, 0.1, 0.3, 0.1])
    a, b = (prom.cell_adapter(np.linspace(0.05, 0.95, 60), np.arange(60) % 2, np.linspace(0.1, 0.9, 20), 0.1, prom.Draws.seeded(60, 20, 13)) for _ in range(2))
    assert all((a[k] == b[k]).all() for k in a) and a["union"].shape == (20, 2) and a["union"].any(axis=1).all()


def test_nearest_by_definition(spark):
    r = random.Random(9)
    cal = [("c", round(r.random(), 1), f"{i:03d}") for i in range(70)]
    tgt = [("c", i, round(r.random(), 2)) for i in range(25)] + [("none", 99, 0.5)]
    got = prom.nearest(spark.createDataFrame(cal, "cell string, p double, idx string"), spark.createDataFrame(tgt, "cell string, i int, p double"), ["cell"], 4, ["i"]).collect()
    found = {}
    for x in got:
        found.setdefault(x["i"], set()).add(x["idx"])
    assert found == {i: {k for _, k in sorted((abs(p - q), k) for _, p, k in cal)[:4]} for c, i, q in tgt if c == "c"}


def test_statistics():
    assert statistics.hodges_lehmann(np.array([1.0, 2, 3])) == 2
    x = np.random.default_rng(1).normal(size=301)
    assert statistics.hodges_lehmann(x, direct=10) == pytest.approx(statistics.hodges_lehmann(x), abs=1e-12)
    assert statistics.hodges_lehmann(x[:300], direct=10) == pytest.approx(statistics.hodges_lehmann(x[:300]), abs=1e-12)
    assert statistics.sign_test(5, 5) == 1 and statistics.sign_test(10, 0) == pytest.approx(2 / 1024) and math.isnan(statistics.sign_test(0, 0))
    d = np.array([1.1, -2.2, 3.3, 4.4, -5.5, 6.6, 7.7, 8.8, 9.9, 10.1, 0.0])
    n = 10
    rank = np.arange(1, 11)
    plus = rank[np.array([1, 0, 1, 1, 0, 1, 1, 1, 1, 1], bool)].sum()
    every = [sum(r for r, s in zip(rank, signs, strict=True) if s) for signs in product((0, 1), repeat=n)]
    low = min(plus, 55 - plus)
    assert statistics.wilcoxon_exact(d) == pytest.approx(min(1, 2 * np.mean(np.array(every) <= low)))
    assert math.isnan(statistics.wilcoxon_exact(d[:5]))
    lo, hi = statistics.bootstrap_interval(7, np.array([0.1, 0.2, 0.3]), np.array([0.8, 0.9, 1.0]))
    assert hi < 0 and math.isnan(statistics.bootstrap_interval(7, np.array([]), d)[0])
    assert statistics.bootstrap_interval(3, d) == statistics.bootstrap_interval(3, d)


def test_temperature():
    r = np.random.default_rng(2)
    z = r.normal(0, 3, 4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-z / 2))).astype(float)
    t, before, after = learning.fit_temperature(1 / (1 + np.exp(-z)), y, np.ones(4000))
    assert 1.7 < t < 2.4 and after < before


def test_logistic_fit():
    x = np.array([[-2.0], [-1], [1], [2]])
    b = learning.fit_logistic(x, np.array([0.0, 0, 1, 1]), np.ones(4), ridge=1e-2)
    assert b[0] > 1 and abs(b[1]) < 1e-6


def test_crossfit_ratio(spark):
    from pyspark.ml.linalg import Vectors

    r = random.Random(3)
    rows = [(f"r{i}", int(i % 4 == 0), Vectors.dense([r.gauss(2.0 if i % 4 == 0 else 0.0, 1.0)])) for i in range(400)]
    got = learning.crossfit_ratio(spark.createDataFrame(rows, ["row_id", "domain", "features"]), "row_id", "domain").toPandas()
    assert len(got) == 400 and got.fold.nunique() == 5
    assert got[got.domain == 1].ratio.median() > 2 * got[got.domain == 0].ratio.median()


def test_validation(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 1.5), (2, "a", None)], "c int, i string, v double")
    assert validation.bounds(df, ["v"], {}).first().asDict() == {"column": "v", "nulls": 1, "outside": 1}
    assert [tuple(r) for r in validation.incomplete(df, ["c"], "i", ["a", "b"]).collect()] == [(2, ["b"])]
    s = validation.sealed(spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "name string, digest string"), spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "3")], "name string, digest string"))
    assert {tuple(r) for r in s.collect()} == {("y", "differs"), ("z", "missing"), ("w", "unexpected")}
    assert so.differences(df.select("c"), df.select("c").limit(2)).count() == 1
    assert joins.contract(df, df.select("c").distinct(), ["c"]).first().asDict() == {"n_keys": 2, "only_right": 0, "only_left": 0, "broken": 1}


def test_predicates(spark):
    with pytest.raises(Exception, match="not a binary label"):
        spark.createDataFrame([(2,)], "t int").select(predicates.binary(F.col("t"))).collect()
    m = spark.createDataFrame([("a", "g"), ("a", "h"), ("b", "g")], "alias string, project_group string")
    assert {tuple(r) for r in predicates.alias_union([m]).collect()} == {("a", "g", True), ("b", "g", False), ("g", "g", False), ("h", "h", False)}


def test_calibration_sensitivity_is_the_whole_grid(spark):
    r = np.random.default_rng(11)
    draw = lambda n, side: scores(np.round(r.random(n), 3), np.arange(n) % 8 == 0, side, np.exp(r.normal(0, 1, n)))
    scored = spark.createDataFrame(draw(200, "calibration") + draw(30, "target"), CELLED)
    got = statistics.sensitivity(scored).collect()
    methods = {"unweighted_mondrian", "estimated_weight_no_gate_clip_20", "gated_full_gate_clip_20"}
    assert {(x["fraction"], x["repetition"], x["method"]) for x in got} == set(product((0.25, 0.5, 0.75, 1.0), range(5), methods)) and len(got) == 60
    assert all((x["passed"] is not None) == (x["method"] == "gated_full_gate_clip_20") for x in got)
    cell, tgt = ["detector", "seed"], scored.where("side = 'target'")
    for f, rep in ((0.25, 3), (1.0, 0)):
        cal = windows.nested_sample(scored.where("side = 'calibration'"), cell, f, rep, "nested-1")
        weighted = conformal.weighted_sets(cal, tgt, cell)
        rules = conformal.gate_rules(conformal.support(cal, tgt, scored, cell), weighted, cell)
        sets = conformal.mondrian_sets(tgt, conformal.mondrian(cal, cell), cell).unionByName(weighted).unionByName(conformal.gated_sets(weighted, rules, cell)).where("av = 0.1 and asafe = 0.2")
        want = {x["method"]: (x["vulnerable_missed"], x["safe_missed"], x["singletons"]) for x in metrics.triage(sets, ["method"]).collect() if x["method"] in methods}
        assert {x["method"]: (x["vulnerable_missed"], x["safe_missed"], x["singletons"]) for x in got if (x["fraction"], x["repetition"]) == (f, rep)} == want


def test_summaries_have_the_full_gate(spark, folder):
    methods = {"unweighted_mondrian", "estimated_weight_no_gate_clip_20", "gated_full_gate_clip_20"}
    for name in ("agg_calibration_summary", "agg_neardup_summary"):
        assert {x["method"] for x in statistics.QUERIES[name](spark, folder).collect()} == methods


def test_local_pvalues_take_the_neighbours_of_the_cell(spark):
    r = np.random.default_rng(17)
    pc, yc, pt = np.round(r.random(230), 2), r.integers(0, 2, 230), np.round(r.random(25), 3)
    scored = spark.createDataFrame(scores(pc, yc, "calibration") + scores(pt, np.zeros(25), "target"), CELLED)
    got = {(x["position"], x["expert"], x["alpha"]): x["p_value"] for x in prom.adapter(scored, ["detector", "seed"], prom.LEVELS).collect()}
    assert prom.LEVELS == [0.01, 0.05, 0.1] and len(got) == 25 * 5 * 3
    lac = np.where(yc == 1, 1 - pc, pc)
    order = sorted(range(230), key=lambda i: ("g", i, f"calibration{i}"))
    for i, v in enumerate(pt):
        near = sorted(order, key=lambda j: (abs(pc[j] - v), j))[:23]
        want = np.mean(lac[near] >= (1 - v if v > 0.5 else v))
        assert all(got[(i, "lac", a)] == pytest.approx(want) for a in prom.LEVELS) and got[(i, "union", 0.1)] is None
    for x in prom.windows_1d(scored, ["detector", "seed"]).collect():
        far = np.sort(np.abs(pc - pt[x["position"]]))
        assert x["k"] == 23 and x["reach"] == pytest.approx(far[22])
        assert x["inside"] == (far < far[22] - 1e-9).sum() < 23 <= x["inside"] + x["tied"] == (far < far[22] + 1e-9).sum()


def test_matched_sets_accept_as_many_as_those_matched(spark):
    r = np.random.default_rng(19)
    pc, yc, pt = np.round(r.random(300), 2), r.integers(0, 2, 300), np.round(r.random(60), 2)
    scored = spark.createDataFrame(scores(pc, yc, "calibration") + scores(pt, np.zeros(60), "target"), CELLED)
    cell, tgt = ["detector", "seed"], scored.where("side = 'target'")
    plain = conformal.mondrian_sets(tgt, conformal.mondrian(scored.where("side = 'calibration'"), cell), cell)
    k = {(x["av"], x["asafe"]): x["k"] for x in plain.where("in_safe <> in_vulnerable").groupBy("av", "asafe").agg(F.count(F.lit(1)).alias("k")).collect()}
    assert max(k.values()) > 7
    own = [(v > 0.5, 1 - v if v > 0.5 else 1 - (1 - v)) for v in pt]
    sc = np.where(yc == 1, 1 - pc, 1 - (1 - pc))
    cred = [((sc[yc == f] >= o).sum() + 1) / ((yc == f).sum() + 1) for f, o in own]
    for name, best in (("lac", cred), ("msp", np.maximum(pt, 1 - pt))):
        order = sorted(range(60), key=lambda i: (-best[i], i))
        got = conformal.matched_to_both(scored, cell, name).where(f"method = '{name}_matched_unweighted_mondrian' and in_safe <> in_vulnerable").collect()
        for b in conformal.BUDGETS:
            assert {x["position"] for x in got if (x["av"], x["asafe"]) == b} == set(order[: k.get(b, 0)])


def test_range_counts():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 300):
        v = r.integers(0, 12, n) / 10
        lo = r.integers(0, n + 1, 200)
        hi = np.maximum(lo, r.integers(0, n + 1, 200))
        bound = r.integers(-1, 14, 200) / 10
        assert prom.RangeCounts(v).at_least(lo, hi, bound).tolist() == [(v[a:b] >= x).sum() for a, b, x in zip(lo, hi, bound, strict=True)]


@pytest.mark.parametrize("n", [1, 5, 60, 240])
def test_local_pvalues_by_definition(n):
    """Ties on one side, on both and among equal values; values beyond both ends."""
    r = np.random.default_rng(n)
    cal, own = r.integers(0, 9, n) / 8, np.concatenate([r.integers(-1, 19, 60) / 16, [-1.0, 2.0]])
    scores, bounds = r.integers(0, 6, (2, n)) / 5, r.integers(0, 7, (2, 62)) / 5
    for k in {1, max(1, n // 3), n}:
        got = prom.local_pvalues(cal, own, scores, bounds, k)
        for i, v in enumerate(own):
            near = sorted(range(n), key=lambda j: (abs(cal[j] - v), j))[:k]
            assert got[:, i].tolist() == [(scores[e, near] >= bounds[e, i]).sum() / k for e in (0, 1)]


def test_ordered_sums(spark):
    r = random.Random(4)
    rows = [(g, r.choice([0.0, 0.25, 0.5, r.random()]), i, r.randrange(5)) for i in range(300) for g in ("hot" if i % 4 else "b",)]
    df = spark.createDataFrame(rows, "g string, x double, i int, v int")
    for down in (False, True):
        x = F.desc("x") if down else F.col("x")
        got = skew.ordered_sums(df, ["g"], skew.unit_slot(F.col("x"), down), [x, F.col("i")], {"upto": F.col("v"), "place": F.lit(1)}, {"upto": "whole"}).collect()
        for g in ("hot", "b"):
            mine = sorted((q for q in rows if q[0] == g), key=lambda q: (-q[1] if down else q[1], q[2]))
            want = {q[2]: (sum(z[3] for z in mine[: k + 1]), k + 1, sum(z[3] for z in mine)) for k, q in enumerate(mine)}
            assert {q["i"]: (q["upto"], q["place"], q["whole"]) for q in got if q["g"] == g} == want
    numbers = [-1e300, -5.0, -1e-9, 0.0, 1e-300, 0.3, 0.30001, 7.0, 1e9]
    slots = [q[0] for q in spark.createDataFrame([(z,) for z in numbers], "x double").select(skew.size_slot(F.col("x"))).collect()]
    assert slots == sorted(slots) and len(set(slots)) > 6


def test_bootstrap_against_whole_resamples():
    r = np.random.default_rng(6)
    for n in (1, 4, 31):
        x = r.integers(0, 9, n) / 4
        at = np.random.default_rng(11).integers(0, n, size=(500, n))
        want = np.median(x[at], axis=1)
        assert statistics.resampled_medians(x, np.random.default_rng(11), 500).tolist() == want.tolist()


def test_resamples_in_parts_are_the_same(monkeypatch):
    x = np.arange(17.0)
    whole = statistics.bootstrap_interval(5, x, x[:6] * 2)
    monkeypatch.setattr(statistics, "DRAWS", 40)
    assert statistics.bootstrap_interval(5, x, x[:6] * 2) == whole


def test_equal_means_are_ties(spark):
    rows = [("d", 0.1, 0.2, m, "g", 0.1 + 0.2 if m == statistics.BASELINE else 0.3) for m in (statistics.BASELINE, statistics.COMPARED[0])]
    df = spark.createDataFrame(rows, "detector string, av double, asafe double, method string, target_group string, singleton_coverage double")
    assert statistics.paired(df, ["singleton_coverage"]).first()["difference"] == 0.0


def test_all_methods_in_every_cell(spark):
    r = np.random.default_rng(23)
    scored = spark.createDataFrame(scores(r.random(80), r.integers(0, 2, 80), "calibration") + scores(r.random(15), np.zeros(15), "target"), CELLED)
    got = conformal.decisions(scored).groupBy("method").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {x["method"] for x in got} == set(conformal.METHODS) and len(conformal.METHODS) == 25 and {x["n"] for x in got} == {15 * 9}


def test_hodges_lehmann_is_a_mean_of_pairs():
    r = np.random.default_rng(31)
    for n in (11, 240, 601):
        for x in (r.normal(size=n), r.integers(-9, 9, n) / 7, np.where(r.random(n) < 0.8, 0.0, r.normal(size=n)), np.full(n, 0.3)):
            assert statistics.hodges_lehmann(x, direct=10) == statistics.hodges_lehmann(x)


def test_sets_of_one_clip_are_those_of_all_methods(spark):
    r = np.random.default_rng(24)
    scored = spark.createDataFrame(scores(r.random(300), r.integers(0, 2, 300), "calibration") + scores(r.random(20), r.integers(0, 2, 20), "target"), CELLED)
    few, every = conformal.clip_sets(scored, 20.0), conformal.decisions(scored)
    methods = {statistics.BASELINE, *statistics.COMPARED}
    keep = lambda df: sorted(tuple(x) for x in df.where(F.col("method").isin(*methods)).select(sorted(df.columns)).collect())
    assert keep(few) == keep(every) and {x[0] for x in few.select("method").distinct().collect()} == methods


def test_sign_test_of_many_groups(spark):
    assert statistics.sign_test(4, 9) == 2 * sum(math.comb(13, i) for i in range(5)) / 2**13
    began = time.process_time()
    p = statistics.sign_test(9_900, 10_100)
    assert time.process_time() - began < 2 and p == pytest.approx(math.erfc(199 / math.sqrt(2 * 20_000)), rel=1e-3)
    rows = [("d", 0.1, 0.2, "m", o, f"g{i}", x) for o in ("review_load", statistics.MORE_IS_BETTER) for i, x in enumerate((1.0, -1.0, -2.0, 0.0))] + [("d", 0.1, 0.2, "m", "safe_violation", "g", 0.0)]
    df = spark.createDataFrame(rows, "detector string, av double, asafe double, method string, outcome string, target_group string, difference double")
    got = {x["outcome"]: (x["wins"], x["losses"], x["sign_p"]) for x in statistics.signs(df).collect()}
    assert got == {"review_load": (2, 1, 1.0), statistics.MORE_IS_BETTER: (1, 2, 1.0), "safe_violation": (0, 0, None)}


def test_signed_rank_p_of_many_groups():
    for n, w in ((300, 20_001), (300, 22_575), (640, 60_000), (640, 90_000), (640, 102_560)):
        assert statistics._inverted(n, w) == pytest.approx(statistics._counted(n, w), rel=1e-12)
    d = np.random.default_rng(12).normal(0.03, 1, 9_000)
    began = time.process_time()
    p = statistics.wilcoxon_exact(d)
    assert time.process_time() - began < 5
    rank, n = np.argsort(np.argsort(np.abs(d))) + 1, len(d)
    low = min(rank[d > 0].sum(), rank[d < 0].sum())
    z = (n * (n + 1) / 4 - low - 0.5) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-2)
    assert statistics.wilcoxon_exact(np.full(3_000, 0.5)) == 0 and statistics.wilcoxon_exact(np.tile([1.0, -1.0], 500)) == 1


def test_comparisons_are_dealt_to_tasks(spark):
    r = np.random.default_rng(17)
    x = {m: r.integers(-3, 4, 60) / 4 for m in statistics.COMPARED[:2]} | {statistics.COMPARED[2]: np.full(60, 0.25)}
    rows = [("d", 0.1, 0.2, m, "review_load", f"g{i:02}", float(x[m][i])) for m in x for i in r.permutation(60)]
    df = spark.createDataFrame(rows, "detector string, av double, asafe double, method string, outcome string, target_group string, difference double")
    assert statistics.compared(df, lambda q: [len(q.x)], ["groups"]).rdd.getNumPartitions() == statistics.TASKS
    got = {q["method"]: q for q in statistics.comparisons(df, 200).collect()}
    for m, v in x.items():
        seed = statistics.SEED + zlib.crc32(f"d|0.1|0.2|{m}|review_load".encode())
        medians = np.median(v[np.random.default_rng(seed).integers(0, 60, size=(200, 60))], axis=1)
        q = got[m]
        assert (q["ci_lower"], q["ci_upper"]) == statistics.percentile_interval(medians) and q["median"] == np.median(v) and q["hodges_lehmann"] == statistics.hodges_lehmann(v)
        assert (q["wins"], q["ties"], q["losses"]) == ((v < 0).sum(), (v == 0).sum(), (v > 0).sum()) and q["wilcoxon_p"] == statistics.wilcoxon_exact(v) and q["holm_p"] >= q["wilcoxon_p"]
