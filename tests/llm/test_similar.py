import random
from fractions import Fraction

import numpy as np
import pytest

from siftspark.llm import neardup, overlap, setjoin
from siftspark.llm import tokensets as ts
from siftspark.llm.blocks import tiled
from tests.llm.util import DOC, blob, doc, families, jaccard


def brute(sets, t):
    ok = [i for i, s in enumerate(sets) if s is not None and len(s) >= 20]
    return {(i, j) for x, i in enumerate(ok) for j in ok[x + 1 :] for c, u in [jaccard(sets[i], sets[j])] if c * t.denominator >= u * t.numerator}


def grouped(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {(x, find(x)) for x in list(root)}


def test_decode():
    assert ts.decode(None) is None
    assert ts.decode(b"not zlib") is None
    assert ts.decode(blob([])).tolist() == []
    a = ts.decode(blob(["x", "y", "λ"]))
    assert len(a) == 3 and (np.diff(a) > 0).all()
    import zlib

    assert ts.decode(zlib.compress(b"\x05\x00\x00\x00\x01")) is None


def arrays(sets):
    ids = [np.sort(np.array([hash(("t", x)) for x in s], np.int64)) for s in sets]
    return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])


def order_of(values):
    return ts.Order(ts.codes(np.bincount(values & ((1 << ts.LEAST_BITS) - 1), minlength=1 << ts.LEAST_BITS)))


@pytest.mark.parametrize("chains", [ts.CHAINS, ((30, 3), (38, 2), (1 << 40, 1)), ((1 << 40, 1),)])
@pytest.mark.parametrize("limit", [0, 2, 10, 10**6])
@pytest.mark.parametrize("t", [Fraction(7, 10), Fraction(4, 5)])
def test_similar_sets_share_a_block(monkeypatch, limit, t, chains):
    monkeypatch.setattr(ts, "BLOCK", limit)
    monkeypatch.setattr(ts, "CHAINS", chains)
    monkeypatch.setattr(ts, "KEYS", 500)
    sets = [s for s in families(3, 150) if len(s) >= 20]
    values, offsets = arrays(sets)
    parts = list(ts.block_keys(values, offsets, order_of(values), t, len(sets)))
    key, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    assert len(parts) > 1 and len(set(zip(key.tolist(), row.tolist(), strict=True))) == len(key)
    keys = [set(key[row == i].tolist()) for i in range(len(sets))]
    for i, j in brute(sets, t):
        assert keys[i] & keys[j] or sets[i] == sets[j]


def test_keys_are_bounded():
    """Sets of nothing but frequent tokens, of any size, make no more keys than is said."""
    r, t = np.random.default_rng(1), Fraction(7, 10)
    for n, most in ((60, 1_600), (128, 11_500), (129, 7_600), (400, 7_600), (659, 7_600), (4_000, 1_300)):
        values = np.sort(r.integers(0, 2**62, n))
        order = ts.Order(np.full(1 << ts.LEAST_BITS, ts.codes(np.array([200_000]))[0]))
        keys = sum(len(k) for k, _ in ts.block_keys(values, np.array([0, n]), order, t, 10**6))
        assert 0 < keys <= most


def test_counters(spark):
    counts = np.array([0, 1, 2, 3, 9, 1000, 10**6, 10**9])
    got = ts._COUNTS[ts.codes(counts)]
    assert (got >= counts - 1e-6).all() and (got <= counts * 1.1).all() and got[:2].tolist() == [0, 1]
    slots = [5] * 7 + [1 << 19] + [(1 << 20) - 1] * 2
    order = ts.counters(spark.createDataFrame([(x,) for x in slots], "slot int"), 20)
    assert [round(x) for x in order.of(np.array([5, 1 << 19, (1 << 20) - 1, 6, (1 << 20) + 5]))] == [7, 1, 2, 0, 7] and len(order.codes) == 1 << 20
    assert ts.bits_for(10) == 20 and ts.bits_for(10**6) == 23 and ts.bits_for(10**12) == 26


@pytest.mark.parametrize("window", [1, 2, 3])
def test_similar_sets_share_what_is_proved(window):
    """Of every similar pair: a rarest chunk in common, as many chunks and as much length as the bound says."""
    t, level = overlap.SIMILAR, overlap.Level(window, 2, True)
    sets = [s for s in families(5, 250) if len(s) >= 20]
    values, offsets = arrays(sets)
    c = overlap.set_chunks(values, offsets, t, level)
    count = order_of(overlap._digest(c.packed)).of(overlap._digest(c.packed))
    by = np.lexsort((c.packed, count, c.row))
    own = [c.packed[by][c.row[by] == r] for r in range(len(c.most))]
    rare = [set(x[: m + 1].tolist()) for x, m in zip(own, c.most.tolist(), strict=True)]
    least, n, fine = c.least(), len(sets), 0
    for i, j in brute(sets, t):
        rows = [(k + i, k + j) for k in (0, n) if rare[k + i] & rare[k + j]]
        assert rows
        fine += rows[-1][0] >= n
        for x, y in rows:
            shared = set(own[x].tolist()) & set(own[y].tolist())
            length = sum(v & overlap.LENGTH for v in shared)
            assert len(shared) >= max(len(own[x]) - c.most[x], len(own[y]) - c.most[y]) and length >= max(least[x], least[y])
    assert fine or window < 3


def test_coarse_chunks_are_long():
    values, offsets = arrays([{f"t{i}" for i in range(20_000)}])
    level = overlap.LEVELS[0]
    length = overlap.set_chunks(values, offsets, overlap.SIMILAR, level).packed & overlap.LENGTH
    assert length.sum() == 20_000 and abs(length.mean() - level.mean) < 0.2
    gone = np.delete(values, [5_000, 15_000])
    other = overlap.set_chunks(gone, np.array([0, len(gone)]), overlap.SIMILAR, level)
    whole = overlap.set_chunks(values, offsets, overlap.SIMILAR, level)
    assert len(set(whole.packed.tolist()) - set(other.packed.tolist())) <= 2 * (level.window + 1)


@pytest.mark.parametrize("window", [1, 2, 4])
def test_spoiled_bound(window):
    n = np.arange(20, 200)
    got = overlap.spoiled(n, overlap.SIMILAR, window)
    for size, d in zip(n.tolist(), got.tolist(), strict=True):
        worst = max((window + 1) * x + window * y for x in range(size) for y in range(size) if (size - x) * 20 >= 17 * (size + y))
        assert worst <= d <= worst + window


def test_near_duplicates(spark):
    sets = [*families(1, 160), None, set(), {str(i) for i in range(19)}, *[{str(i) for i in range(1000, 1030)}] * 30]
    rows = [doc(i, s) for i, s in enumerate(sets)]
    got = {tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows + rows[:5], DOC)).collect()}
    assert got == grouped(brute(sets, neardup.SIMILAR)) and len(got) > 40


def test_hot_block_is_cut_into_tiles(spark, monkeypatch):
    """Many different but similar sets share their rare tokens; tiles of 8 rows must lose no pair."""
    core = {f"k{i}" for i in range(40)}
    sets = [core | {f"v{i}", f"w{i % 5}"} for i in range(60)]
    rows = [(1, i, i) for i in range(60)] + [(2, 99, 0)]
    df = spark.createDataFrame(rows, "key long, cid long, x int")
    from pyspark.sql import functions as F

    units = tiled(df, "key", "cid", F.lit(True), [], tile=8).collect()
    seen = {}
    for r in units:
        seen.setdefault((r["key"], r["_t"], r["_u"]), []).append((r["cid"], r["_tile"]))
    pairs = [tuple(sorted((a, b))) for (k, t, u), v in seen.items() for x, (a, ta) in enumerate(v) for b, tb in v[x + 1 :] if t == u or ta != tb]
    assert len(pairs) == len(set(pairs)) == 60 * 59 // 2 and max(map(len, seen.values())) < 60
    for dense in (1000, 0):
        monkeypatch.setattr(neardup, "DENSE", dense)
        got = {tuple(r) for r in neardup.near_duplicates(spark.createDataFrame([doc(i, s) for i, s in enumerate(sets)], DOC)).collect()}
        assert got == {(i, 0) for i in range(60)}


def test_pairs_across(spark):
    core = [f"k{i}" for i in range(60)]
    import random

    r = random.Random(2)
    hot = [set(r.sample(core, 50)) for _ in range(60)]
    sets = [*families(7, 120), *hot, None]
    sides = ["primevul", "diversevul", "context"]
    rows = [doc(i, s, sides[i % 3 if i % 7 else 0]) for i, s in enumerate(sets)]
    got = [tuple(r) for r in setjoin.document_pairs(spark.createDataFrame(rows, DOC)).collect()]
    want = {(i, j) for i, j in brute(sets, setjoin.SIMILAR) if {rows[i][1], rows[j][1]} == {"primevul", "diversevul"}}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


RECORD = "dataset string, row_id string, origin_split string, source_file string, exact_code_key string, split string, ingested int"


def test_contaminated(spark):
    sets = families(9, 90)
    splits = ["train", " Train\t", "VAL", "test", None, "external"]
    files = ["primevul_train.jsonl", "diversevul.jsonl", "primevul_valid.jsonl"]
    docs = [doc(i, s, "primevul", f"r{i}", key=f"K{i}" if i != 4 else "same", text="a b c" if i % 2 else None) for i, s in enumerate(sets)]
    recs = [("primevul", f"r{i}", splits[i % 6], files[i % 3], [f"k{i}", None, " "][i % 3] if i > 6 else "SAME", "clash", 1) for i in range(95)]
    recs += [("diversevul", "lone", None, None, "same", "clash", 1), ("primevul", "no key", "test", None, None, "clash", 1)]
    got = {tuple(r) for r in overlap.contaminated(spark.createDataFrame(recs * 2, RECORD), spark.createDataFrame(docs, DOC)).collect()}
    names = {"val": "valid"}
    info = {}
    for d, r, s, f, k, *_ in recs:
        s = (s or "").strip().lower() or ("external" if (f or "").startswith("diversevul") else (f or "_.").split("_")[1].split(".")[0])
        i = int(r[1:]) if r[1:].isdigit() else None
        k = (k or "").strip().lower() or ((f"k{i}" if i != 4 else "same") if i is not None and i < 90 else "")
        info[(d, r)] = (names.get(s, s), k, sets[i] if i is not None and i < 90 else None)
    train = [v for v in info.values() if v[0] == "train"]
    keys = {k for _, k, _ in train if k}
    want = set()
    for (d, r), (s, k, x) in info.items():
        near = x is not None and len(x) >= 20 and any(y is not None and len(y) >= 20 and jaccard(x, y)[0] * 20 >= jaccard(x, y)[1] * 17 for _, _, y in train)
        if s and s != "train" and (k in keys or near):
            want.add((d, s, r))
    assert got == want and len(got) > 5
    linked = overlap.links(spark.createDataFrame(recs * 2, RECORD), spark.createDataFrame(docs, DOC)).collect()
    assert len(linked) == len(want)
    for r in linked:
        s, k, x = info[(r["dataset"], r["row_id"])]
        ts_, tk, y = info[(r["train_dataset"], r["train_row_id"])]
        assert ts_ == "train" and (k == tk and k if r["found_by"] == "key" else jaccard(x, y)[0] * 20 >= jaccard(x, y)[1] * 17)
    assert {r["found_by"] for r in linked} >= {"key"}


def test_train_partner_of_each_level(spark):
    """The coarse cut finds most and the fine one the rest; the fine cut alone finds all."""
    docs = [(*doc(i, s), ["train", "test"][i % 2]) for i, s in enumerate(families(11, 400, size=60))]
    df = ts.token_sets(spark.createDataFrame(docs, DOC + ", split string")).join(spark.createDataFrame([(d[0], d[-1]) for d in docs], "doc_id long, split string"), "doc_id")
    _, two = overlap.near_train(df)
    _, one = overlap.near_train(df, levels=[overlap.LEVELS[1]])
    a, b = {r["cid"]: r["level"] for r in two.collect()}, {r["cid"] for r in one.collect()}
    assert set(a) == b and {1, 2} <= set(a.values())


def test_text_chunks():
    import random

    r = random.Random(4)
    text = bytes(r.randrange(97, 123) for _ in range(5000))
    chunks = overlap.text_chunks(text)
    assert b"".join(chunks) == text and 20 < len(chunks) < 300
    edited = overlap.text_chunks(text[:2000] + b"!!" + text[2000:])
    assert len(set(chunks) - set(edited)) <= 3
    assert overlap.text_chunks(b"") == [] and overlap.text_chunks(b"ab") == [b"ab"]


def test_record_overlap(spark):
    text = " ".join(f"word{i}" for i in range(400))
    docs = [doc(0, None, "primevul", "a", text=text), doc(1, None, "primevul", "b", text=text.upper().replace(" ", "\n ")), doc(2, None, "primevul", "c"), doc(3, None, "primevul", "d", text=" ")]
    recs = [("primevul", x, s, None, None, "", 0) for x, s in (("a", "train"), ("b", "test"), ("c", "valid"), ("d", "test"))]
    got = {r["row_id"]: r for r in overlap.record_overlap(spark.createDataFrame(recs, RECORD), spark.createDataFrame(docs, DOC)).collect()}
    assert set(got) == {"b", "c", "d"} and got["b"]["overlap"] == 1.0
    assert got["c"]["overlap"] is None and got["d"]["n_bytes"] == 0


def test_empty(spark):
    d, r = spark.createDataFrame([], DOC), spark.createDataFrame([], RECORD)
    assert neardup.near_duplicates(d).count() == 0
    assert setjoin.document_pairs(d).count() == 0
    assert overlap.contaminated(r, d).count() == 0
    assert overlap.record_overlap(r, d).count() == 0


def units(sets, t, keys=None):
    """One table of units over the sets, sorted, for the functions that run on Arrow batches."""
    import pyarrow as pa

    values, offsets = arrays(sets)
    vectors = neardup.bit_vectors(values, offsets)
    keys = np.zeros(len(sets), np.int64) if keys is None else keys
    by = np.argsort(keys, kind="stable")
    zero = np.zeros(len(sets), np.int32)
    columns = {"key": keys[by], "_t": zero, "_u": zero, "_tile": zero, "cid": by, "n": np.diff(offsets)[by].astype(np.int32)}
    tab = pa.table(columns | {v: vectors[by, w] for w, v in enumerate(neardup.VECTOR)})
    return by, neardup.Units(tab, np.append(np.unique(keys[by], return_index=True)[1], len(sets)), t)


def crowd(seed=6):
    r = random.Random(seed)
    core = list(range(70))
    return [set(r.sample(core, r.randint(38, 60))) for _ in range(150)] + [set(range(1000 + 50 * i, 1050 + 50 * i)) for i in range(10)] + families(seed, 120, size=60)


@pytest.mark.parametrize("radius", [0.0, 0.15, 0.5])
def test_cells_lose_no_pair(radius):
    """Pivot cells of three strata, against all pairs: sets of one family at all distances, and strangers."""
    t, sets = setjoin.SIMILAR, crowd()
    keys = np.array([(0 if len(s) < 46 else 1) if i % 7 else 2 for i, s in enumerate(sets)])
    by, u = units(sets, t, keys)
    cells = setjoin.Cells(u, ts.mix(by.astype(np.uint64)), t, radius)
    met = [tuple(sorted((int(by[i]), int(by[j])))) for x, y in cells.pairs() for i, j in zip(cells.rows[x], cells.rows[y], strict=True)]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if keys[i] == keys[j] and len(sets[i] & sets[j]) * 10 >= 7 * len(sets[i] | sets[j])}
    assert want <= set(met) and len(want) > 100
    assert cells.k.min() > 1 and cells.home.sum() == len(sets)
    # Each set is at home at its nearest pivot, and cells rule most pairs out.
    assert len(set(met)) < 0.7 * sum(m * (m - 1) // 2 for m in u.sizes)


def test_tiles_lose_no_pair():
    t, sets = neardup.SIMILAR, crowd(8)
    keys = np.array([i % 3 for i in range(len(sets))])
    by, u = units(sets, t, keys)
    got = {tuple(sorted((int(by[a]), int(by[b])))) for i, j in u.close_pairs() for a, b in zip(i, j, strict=True)}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if keys[i] == keys[j] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])}
    assert want <= got and want and u.skipped > 0.1 * u.seen


def test_figures(spark):
    sides = ["primevul", "diversevul"]
    df = spark.createDataFrame([doc(i, s, sides[i % 2]) for i, s in enumerate(families(7, 120))], DOC)
    cells = setjoin.partition_figures(df).first().asDict()
    pairs = setjoin.document_pairs(df).count()
    assert 0 < cells["found_among_cells"] <= cells["found"] <= pairs and cells["homes"] == cells["sets_in_strata"] and cells["cells"] > cells["strata"]
    tiles = neardup.tile_figures(df).first().asDict()
    assert 0 < tiles["pairs_close"] < tiles["pairs_in_units"] and tiles["tile_pairs"] > tiles["tile_pairs_skipped"] > 0
    assert set(neardup.tile_figures(df.limit(0)).first()) == {0} == set(setjoin.partition_figures(df.limit(0)).first())
