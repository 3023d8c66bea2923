"""Canonical text, keys, hash buckets and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftspark.functions.text import STRIP, strip

#: Line breaks of any kind (fixed values of Unicode).
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: White space within a line.
BLANK = r"[\t\x1f\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
#: Tokens of the short form: identifiers, hexadecimal and decimal numbers, operators (fixed pattern).
SHORT = (
    r"[A-Za-z_][A-Za-z_0-9]*|0[xX][0-9A-Fa-f]+|[0-9]+(?:\.[0-9]+)?|"
    r"==|!=|<=|>=|->|\+\+|--|&&|\|\||<<|>>|[-+*/%&|^~!<>=?:;,.(){}\[\]]"
)


def canonical(c: Column) -> Column:
    """Unix line ends, no blanks before them, no white space at the ends; null stays null."""
    unix = F.regexp_replace(c, "\r\n?", "\n")
    return strip(F.regexp_replace(unix, "[ \t]+\n", "\n"))


def normal_lines(c: Column) -> Column:
    """The older normal form: any line break, every line without white space at its end, joined by line feeds."""
    return strip(F.regexp_replace(c, rf"{BLANK}*({BREAK})", "\n"))


def exact_key(c: Column) -> Column:
    return F.sha2(canonical(c), 256)


def hash_prefix(c: Column) -> Column:
    """The first 64 bits of SHA-256 as an unsigned decimal(20, 0)."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def bucket(c: Column, salt: str, n: int) -> Column:
    """Stable bucket 0..n-1 of a value under a salt."""
    return (hash_prefix(F.concat(F.lit(f"{salt}|"), c)) % n).cast("int")


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def short_tokens(c: Column) -> Column:
    return F.regexp_extract_all(canonical(c), F.lit(SHORT), F.lit(0))


def number_name(c: Column) -> Column:
    """A number as part of a name: shortest form, p instead of the point."""
    return F.replace(F.regexp_replace(c.cast("string"), r"\.0\z", ""), F.lit("."), F.lit("p"))


#: The same forms for SQL engines with RE2 expressions.
def sql_canonical(name: str) -> str:
    unix = f"regexp_replace({name}, '\\r\\n?', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({unix}, '[ \\t]+\\n', chr(10), 'g'), '{STRIP}', '', 'g')"


def sql_hash_prefix(expr: str) -> str:
    return f"('0x' || substr(sha256({expr}), 1, 16))::UBIGINT"


def sql_bucket(name: str, salt: str, n: int) -> str:
    return f"({sql_hash_prefix(f"'{salt}|' || {name}")} % {n})::INT"
