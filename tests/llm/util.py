import random
import struct
import zlib

DOC = "doc_id long, dataset string, row_id string, token_blob binary, exact_code_key string, text string, n long, tokens string"


def blob(tokens):
    if tokens is None:
        return None
    raw = struct.pack("<I", len(tokens))
    for t in sorted(tokens):
        b = t.encode()
        raw += struct.pack("<I", len(b)) + b
    return zlib.compress(raw, 6)


def doc(i, tokens, dataset="context", row_id=None, key=None, text=None):
    # The last two columns clash with names the operators use themselves.
    return (i, dataset, row_id, blob(tokens), key, text, 7, "clash")


def families(seed, n, size=40, vocabulary=400, common=12):
    """Random sets: families of edited copies, exact copies and strangers, some with fewer than 20 tokens."""
    r = random.Random(seed)
    shared = [f"c{i}" for i in range(common)]
    out = []
    while len(out) < n:
        base = set(r.sample(range(vocabulary), r.randint(10, size))) | set(shared[: r.randint(2, common)])
        for _ in range(r.choice([1, 1, 2, 5])):
            s = set(base)
            for _ in range(r.randint(0, 12)):
                s.discard(r.choice(sorted(s, key=str))) if r.random() < 0.5 else s.add(r.randrange(vocabulary))
            out.append({str(x) for x in s})
    return out[:n]


def jaccard(a, b):
    return len(a & b), len(a | b)
