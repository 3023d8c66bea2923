"""Column expressions over text; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, as a character class that Java and RE2 read alike (fixed values of Unicode).
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = rf"^{SPACE}+|{SPACE}+\z"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; null stays null."""
    return F.regexp_replace(c, STRIP, "")


def presence(c: Column) -> Column:
    """The stripped value, or null where it is null or blank."""
    return F.nullif(strip(c), F.lit(""))


def sql_strip(name: str) -> str:
    return f"regexp_replace({name}, '{STRIP}', '', 'g')"


def sql_presence(name: str) -> str:
    return f"nullif({sql_strip(name)}, '')"
