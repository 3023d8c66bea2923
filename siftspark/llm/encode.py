"""Token ids of all texts under a public byte-level tokenizer, with byte offsets, and back (problem 7).

Texts go to the tokenizers library as Arrow batches, in slices of a bounded number of characters. A byte-level
vocabulary spells every byte as one printable character (`byte_characters`), so a token's number of bytes is the length
of its spelling, and running sums of those are its byte offsets in the text. Decoding reverses the table byte by byte
and reads the joined bytes as UTF-8: a character that tokens split comes back whole, one that is incomplete as U+FFFD.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import tokensets as ts

#: Where the vocabulary file lies if a query isn't told: a path on every executor, or the bare name of a file that was
#: shipped with SparkContext.addFile.
VOCABULARY = os.environ.get("SIFTSPARK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")
#: Characters encoded at a time; a longer text goes alone, and whole.
SLICE = 1 << 18

_LOADED: dict[str, object] = {}


def _place(path: str) -> str:
    """The file itself, or where Spark put it if ``path`` is the name of a file shipped with SparkContext.addFile."""
    return path if os.path.sep in path else SparkFiles.get(path)


def _tokenizer(path: str):
    """The tokenizer of this worker process, single-threaded: Spark's tasks already use all cores."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(_place(path))
        t.encode_special_tokens = True
        _LOADED[path] = t
    return _LOADED[path]


def byte_characters() -> list[str]:
    """The character that spells each byte: itself if it is a printable Latin-1 one, else the next from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary file."""
    key = f"bytes of {path}"
    if key not in _LOADED:
        with open(_place(path), encoding="utf-8") as f:
            model = json.load(f)
        back = {c: b for b, c in enumerate(byte_characters())}
        spelled = dict(model["model"]["vocab"])
        out = [b""] * (max([*spelled.values(), *[t["id"] for t in model["added_tokens"]]]) + 1)
        for s, i in spelled.items():
            out[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        for t in model["added_tokens"]:
            out[t["id"]] = t["content"].encode()
        _LOADED[key] = out
    return _LOADED[key]


def encode_texts(texts: list[str | None], path: str) -> Iterator[list[int]]:
    """Ids of each text; null and empty texts have none."""
    t = _tokenizer(path)
    part, size = [], 0
    for x in texts:
        if part and size + len(x or "") > SLICE:
            yield from (e.ids for e in t.encode_batch_fast(part, add_special_tokens=False))
            part, size = [], 0
        part.append(x or "")
        size += len(x or "")
    if part:
        yield from (e.ids for e in t.encode_batch_fast(part, add_special_tokens=False))


def _lists(ids: list[list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _small(batches, rows: int = 1024):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def token_ids(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document; null and empty texts get an empty list. Special tokens' strings are plain text."""

    def run(batches):
        for b in _small(batches):
            ids = list(encode_texts(b.column("text").to_pylist(), path))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(ids)], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and n_tokens of every document."""

    def run(batches):
        for b in _small(batches):
            n = np.fromiter((len(x) for x in encode_texts(b.column("text").to_pylist(), path)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n)], names=[*keep, "n_tokens"])

    types = [f"{c} {documents.schema[c].dataType.simpleString()}" for c in keep]
    return documents.select(*keep, "text").mapInArrow(run, ", ".join([*types, "n_tokens long"]))


def token_spans(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_split, ends): byte offsets at which the tokens end, and how many of those lie
    within a character. Null and empty texts have no tokens and 0 bytes."""

    def run(batches):
        sizes = np.array([len(x) for x in token_bytes(path)], np.int64)
        for b in _small(batches):
            texts = [(x or "").encode() for x in b.column("text").to_pylist()]
            ids = [np.array(x, np.int64) for x in encode_texts(b.column("text").to_pylist(), path)]
            ends = [np.cumsum(sizes[x]) for x in ids]
            split = [int(((np.frombuffer(t, np.uint8)[e[:-1]] & 0xC0) == 0x80).sum()) if len(e) else 0 for t, e in zip(texts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(e) for e in ends], pa.int64()), pa.array(split, pa.int64()), pa.array([e.tolist() for e in ends], pa.list_(pa.int64()))],
                names=["doc_id", "n_bytes", "n_tokens", "n_split", "ends"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_split long, ends array<long>")


def decoded(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give null, ids outside the vocabulary U+FFFD."""

    def run(batches):
        table, bad = token_bytes(path), "�".encode()
        for b in _small(batches):
            out = [None if x is None else b"".join(table[i] if 0 <= i < len(table) else bad for i in x).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, same): whether the decoded ids are the text; null counts as empty."""
    back = decoded(token_ids(documents, path), path).withColumnRenamed("text", "back")
    return documents.select("doc_id", "text").join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


QUERIES = {
    "p7_ids": lambda s, d: token_ids(ts.documents(s, d)),
    "p7_spans": lambda s, d: token_spans(ts.documents(s, d)),
    # Where the last token ends is where the text ends.
    "p7_bytes": lambda s, d: token_spans(ts.documents(s, d)).select("doc_id", "n_bytes", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).alias("last_end")),
    "p7_round_trip": lambda s, d: round_trip(ts.documents(s, d)),
}

ORACLE = {
    "p7_round_trip": "SELECT doc_id, true AS same FROM documents",
    "p7_bytes": "SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, n_bytes AS last_end FROM documents",
}
