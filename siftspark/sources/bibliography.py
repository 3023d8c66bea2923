"""Bibliographies in braces notation."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftspark.functions.text import SPACE


def strip_markup(c: Column) -> Column:
    """Without commands of letters, what space follows them, and braces; double hyphens as one, white space as single spaces."""
    bare = F.translate(F.regexp_replace(c, r"\\[A-Za-z]+\s*", ""), "{}", "")
    return F.trim(F.regexp_replace(F.replace(bare, F.lit("--"), F.lit("-")), f"{SPACE}+", " "))


@F.pandas_udf(T.StringType())
def normal_title(s: pd.Series) -> pd.Series:
    """Compatibility form, ASCII letters and digits in lower case, single spaces; null stays null."""
    def one(x):
        if x is None:
            return None
        ascii_ = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower()
        return " ".join(re.sub(r"[^a-z0-9]+", " ", ascii_).split())

    return s.map(one)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two titles, 0 to 1; null if either is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, title) of the entries of the files under ``path``; an entry begins with an @ at the start of a line.

    A title stands in braces or quotes and may go over lines; comments, preambles and strings are no entries, an entry
    without title has an empty one.
    """
    e = spark.read.option("lineSep", "\n@").text(path).select(F.regexp_replace("value", r"^\s*@", "").alias("e"))
    e = e.where(F.col("e").rlike(r"^\s*[A-Za-z]+\s*[{(]") & ~F.col("e").rlike(r"(?i)^\s*(comment|preamble|string)\b"))
    end = r"\s*(?:,\s*\n|,?\s*\n?\s*[})]\s*$)"
    braced, quoted = (F.regexp_extract("e", rf"(?is)[\s,{{]title\s*=\s*{left}(.*?){right}{end}", 1) for left, right in ((r"\{", r"\}"), ('"', '"')))
    title = F.when(braced != "", braced).otherwise(quoted)
    return e.select(
        F.lower(F.regexp_extract("e", r"^\s*([A-Za-z]+)\s*[{(]", 1)).alias("kind"), F.regexp_extract("e", r"[{(]\s*([^,\s]+)\s*,", 1).alias("key"), normal_title(strip_markup(title)).alias("title")
    )
