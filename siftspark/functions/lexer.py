"""Lexical tokens of C and C++ texts, without comments and literals, and the stored form of token sets.

One regular expression walks a text: its first alternatives swallow comments and literals (to the end of the text if
they aren't closed), the named group holds a token, and characters that fit nothing are passed over.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

#: Operators of more than one character (fixed values); single ones are the characters of SINGLE.
OPERATORS = (
    "%:%: >>= <<= <=> ->* ... :: .* ## -> ++ -- << >> <= >= == != && || *= /= %= += -= &= ^= |= <: :> <% %> %:"
).split()
SINGLE = r"{}[]();:?.~!+-*/%^&|=<>,#\\"[:-1]

_PREFIX = r"(?:u8|[uUL])?"
_LEXER = re.compile(
    "|".join(
        [
            r"//[^\n]*",
            r"/\*(?s:.*?)(?:\*/|\Z)",
            _PREFIX + r'R"(?P<fence>[^(]{0,16})\((?s:.*?)(?:\)(?P=fence)"|\Z)',
            _PREFIX + r'R"(?s:.*)\Z',
            _PREFIX + r'"(?:\\(?s:.)|[^"\\])*(?:"|\\?\Z)',
            _PREFIX + r"'(?:\\(?s:.)|[^'\\])*(?:'|\\?\Z)",
            "(?P<token>"
            + "|".join(
                [
                    r"[A-Za-z_][A-Za-z_0-9]*",
                    r"[0-9](?:[A-Za-z0-9_.']|(?<=[eEpP])[+-])*",
                    *[re.escape(o) for o in sorted(OPERATORS, key=len, reverse=True)],
                    "[" + re.escape(SINGLE) + "]",
                ]
            )
            + ")",
        ]
    )
)


def canonical_text(text: str) -> str:
    unix = text.replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"[ \t]+\n", "\n", unix).strip()


def lexical_tokens(text: str) -> list[str]:
    return [m["token"] for m in _LEXER.finditer(canonical_text(text)) if m["token"] is not None]


def token_set(text: str) -> list[str]:
    return sorted(set(lexical_tokens(text)))


def payload(tokens: Iterable[str]) -> bytes:
    """Count, then length and bytes of each token; lengths are little-endian 32 bits."""
    coded = [t.encode() for t in tokens]
    return struct.pack("<I", len(coded)) + b"".join(struct.pack("<I", len(t)) + t for t in coded)


def serialize(tokens: Iterable[str]) -> bytes:
    return zlib.compress(payload(tokens), 6)


def deserialize(blob: bytes) -> list[str]:
    """The tokens of a blob; one that is cut short or has bytes left over is an error."""
    raw, at, out = zlib.decompress(blob), 4, []
    if len(raw) < 4:
        raise ValueError("no count")
    for _ in range(struct.unpack_from("<I", raw)[0]):
        if at + 4 > len(raw):
            raise ValueError("length cut short")
        end = at + 4 + struct.unpack_from("<I", raw, at)[0]
        if end > len(raw):
            raise ValueError("token cut short")
        out.append(raw[at + 4 : end].decode())
        at = end
    if at != len(raw):
        raise ValueError("bytes left over")
    return out


def set_digest(tokens: Iterable[str]) -> str:
    return hashlib.sha256(payload(tokens)).hexdigest()


def with_tokens(df: DataFrame, keep: list[str], distinct: bool = True) -> DataFrame:
    """``keep`` and `tokens` of the column `text`, in Arrow batches; a null text has null tokens."""

    def run(batches):
        read = token_set if distinct else lexical_tokens
        for b in batches:
            out = [None if x is None else read(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, pa.list_(pa.string()))], names=[*keep, "tokens"])

    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, "text").mapInArrow(run, f"{types}, tokens array<string>")


def decoded_blobs(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and `tokens` of the column `token_blob`; a null blob has null tokens."""

    def run(batches):
        for b in batches:
            out = [None if x is None else deserialize(x) for x in b.column("token_blob").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, pa.list_(pa.string()))], names=[*keep, "tokens"])

    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, "token_blob").mapInArrow(run, f"{types}, tokens array<string>")
