"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of letters and digits: everything from U+0080 on counts as a letter.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; null gives the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of numbers as a literal of the plan: its size is known, so Spark broadcasts it
    only below its own limit."""
    names = [part.split()[0] for part in schema.split(",")]
    casts = [f"CAST({name} AS {part.split()[1]}) AS {name}" for name, part in zip(names, schema.split(","))]
    body = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {', '.join(casts)} FROM VALUES {body} AS t({', '.join(names)})")
