"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, the separators of a word `[^\x20\x09-\x0D]+`.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once (bound as a lambda variable)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the ASCII-space separated words of a text; empty for null."""
    one_line = F.trim(F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, " " * len(ASCII_SPACE)))
    return F.array_remove(F.split(one_line, " "), "")


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def temp_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use (names compare without case)."""
    used, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name in used:
        name = "_" + name
    return name
