import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.functions import canonical as cn
from siftspark.functions import lexer
from siftspark.functions import minhash as mh
from siftspark.functions.text import presence, strip

SNIPPET = """// gone
int main() { /* gone
too */ const char *s = "a \\" b"; char c = '\\'';
auto r = R"x(raw ) " text)x"; x >>= 2; p->*m; %:%: u8R"(more)" u8"z"
return 0x1Fu + 1.5e-3 + 1'000; }"""


def test_lexer():
    got = lexer.lexical_tokens(SNIPPET)
    assert got == (
        "int main ( ) { const char * s = ; char c = ; auto r = ; x >>= 2 ; p ->* m ; %:%: return 0x1Fu + 1.5e-3 + 1'000 ; }".split()
    )
    assert lexer.lexical_tokens('a "never closed b c') == ["a"]
    assert lexer.lexical_tokens("a /* never closed b") == ["a"]
    assert lexer.lexical_tokens('x R"toolongadelimiterhere(b)" c') == ["x"]
    assert lexer.lexical_tokens("fooR\"(x)\" é $ @ y") == ["fooR", "y"]
    assert lexer.lexical_tokens("a<=>b<<=c...d") == ["a", "<=>", "b", "<<=", "c", "...", "d"]
    assert lexer.lexical_tokens("") == []


def test_stored_sets():
    t = ["b", "a", "ü", ""]
    assert lexer.deserialize(lexer.serialize(t)) == t
    import zlib

    for bad in (b"", b"\x01", b"\x02\0\0\0\x01\0\0\0a", b"\x00\0\0\0x"):
        with pytest.raises(ValueError):
            lexer.deserialize(zlib.compress(bad))


def test_text_columns(spark):
    rows = [("  int x;  \r\n\treturn x;\t\r\n",), (None,), ("",), ("  \n",), ("a\r\rb \t\nc\u0085d   e",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(cn.canonical(F.col("t"))).collect()]
    assert got[0] == "int x;\n\treturn x;" and got[1] is None and got[2] == "" and got[3] == ""
    assert got == [None if t is None else lexer.canonical_text(t) for (t,) in rows]
    old = [r[0] for r in df.select(cn.normal_lines(F.col("t"))).collect()]
    assert old == [None if t is None else "\n".join(x.rstrip() for x in t.splitlines()).strip() for (t,) in rows]
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == [None if t is None else t.strip() for (t,) in rows]
    assert [r[0] for r in df.select(presence(F.col("t"))).collect()][1:4] == [None, None, None]
    assert spark.createDataFrame([("if (x >= 10) x++;",)], "t string").select(cn.short_tokens(F.col("t"))).first()[0] == "if ( x >= 10 ) x ++ ;".split()


def test_signatures(spark):
    a, b = mh.coefficients()
    assert len(set(a)) == 128 and 0 < min(a) and max(a + b) < mh.PRIME
    x = np.array([0, 1, mh.PRIME - 1], np.uint64)
    ab = np.array(a, np.uint64), np.array(b, np.uint64)
    want = [min((p * int(v) + q) % mh.PRIME for v in x) for p, q in zip(a, b, strict=True)]
    # Empty rows before, between and after; a row that goes over several stretches.
    sizes = np.array([0, 3, 0, 3, 0])
    for held in (mh.HELD, 256):
        mh.HELD, kept = held, mh.HELD
        got = mh.signatures(np.concatenate([x, x]), sizes, *ab)
        mh.HELD = kept
        assert got[1].tolist() == got[3].tolist() == want and {*got[0], *got[2], *got[4]} == {mh.PRIME}
    assert (mh.signatures(np.zeros(0, np.uint64), np.array([0, 0]), *ab) == mh.PRIME).all()
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, None), (3, [])], "i int, tokens array<string>")
    rows = {r["i"]: r["signature"] for r in mh.with_signature(df, ["i"]).collect()}
    hashed = {r["t"]: r["h"] for r in df.select(F.explode("tokens").alias("t")).distinct().select("t", mh.token_hash(F.col("t")).alias("h")).collect()}
    assert rows[1] == [min((p * v + q) % mh.PRIME for v in hashed.values()) for p, q in zip(a, b, strict=True)] and set(rows[2]) == set(rows[3]) == {mh.PRIME}
    p = spark.range(1).select(mh.lsh_probability(F.lit(0.9)), mh.cardinality_fits(F.lit(9), F.lit(10), 0.9), mh.cardinality_fits(F.lit(8), F.lit(10), 0.9), mh.cardinality_fits(F.lit(0), F.lit(0), 0.9), mh.jaccard(F.lit(0), F.lit(0))).first()
    assert p[0] > 0.9998 and list(p)[1:] == [True, False, True, 1.0]


@pytest.mark.parametrize("lexed", [False, True])
def test_lsh_recall(spark, lexed):
    """Of the pairs of classes with Jaccard >= 0.9, by brute force, the bands find at least nine tenths, whatever the
    tiles, and the exact join finds all."""
    from siftspark.operators import lsh

    held = lsh.token_classes(spark, "/root/testdata/sf0.01", lexed).classes
    rows = [tuple(r) for r in lsh.candidates(held).collect()]
    found = set(rows)
    assert len(rows) == len(found) and {tuple(r) for r in lsh.candidates(held, tile=1).collect()} == found
    sets = [(r["cid"], set(r["tokens"]), r["n_source"], r["n_target"]) for r in held.collect()]
    true = set()
    for i, x, _, nt in sets:
        for j, y, ns, _ in sets:
            if nt and ns and (len(x & y) >= 0.9 * len(x | y)):
                true.add((i, j))
    assert {tuple(r) for r in lsh.exact_pairs(held).collect()} == true
    assert len(true) > 5 and len(true & found) >= 0.9 * len(true)
