"""Seeded samples, splits and folds.

All of them order rows by ``md5(seed:id)``: deterministic, the same in every engine, and
independent of partitioning. No variant sorts the table or numbers it in one task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.operators.segments import ranked

DEFAULT_SEED = 42
_PREFIX_DIGITS = 4
#: Hex digits a threshold is compared in: shares down to 1e-18 of the rows.
_THRESHOLD_DIGITS = 15


def hash_key(row_id: str | Column, seed: int = DEFAULT_SEED) -> Column:
    column = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")).cast("binary"))


def _below(row_id: str, fraction: float, seed: int) -> Column:
    if not 0 <= fraction <= 1:
        raise ValueError("fraction lies between 0 and 1")
    steps = 16**_THRESHOLD_DIGITS
    cut = int(Decimal(str(fraction)) * steps)
    if cut >= steps:
        return F.lit(True)
    return F.substring(hash_key(row_id, seed), 1, _THRESHOLD_DIGITS) < f"{cut:0{_THRESHOLD_DIGITS}x}"


def hash_sample(df: DataFrame, row_id: str, fraction: float, seed: int = DEFAULT_SEED) -> DataFrame:
    """A row-local sample of about ``fraction`` of the rows; no shuffle."""
    return df.where(_below(row_id, fraction, seed))


def train_test_split(
    df: DataFrame, row_id: str, test_fraction: float = 0.2, seed: int = DEFAULT_SEED
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by hash threshold; no shuffle."""
    test = _below(row_id, test_fraction, seed)
    return df.where(~test), df.where(test)


def with_split(df: DataFrame, row_id: str, test_fraction: float = 0.2, seed: int = DEFAULT_SEED) -> DataFrame:
    return df.withColumn("is_test", _below(row_id, test_fraction, seed))


def exact_sample(
    df: DataFrame, row_id: str, n: int | None = None, fraction: float | None = None, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Exactly ``n`` rows (or ``round(fraction * rows)``): those with the smallest hashes.

    The hash prefix that holds the n-th row is found from at most 65,536 counts, and the same
    is done once more inside it. Rows of smaller prefixes pass as they are; only the rows of
    the last prefix, one in four billion, are ranked.
    """
    digest = hash_key(row_id, seed)
    parts = [F.substring(digest, 1 + i * _PREFIX_DIGITS, _PREFIX_DIGITS) for i in range(2)]
    out, inside = None, F.lit(True)
    for part in parts:
        sizes = df.where(inside).groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
        if out is None:
            total = sum(r["n"] for r in sizes)
            if n is None:
                if fraction is None:
                    raise ValueError("give n or fraction")
                n = round(total * fraction)
            if n >= total:
                return df
            left = n
        for row in sizes:
            if row["n"] >= left:
                break
            left -= row["n"]
        sure = df.where(inside & (part < row["p"]))
        out = sure if out is None else out.unionByName(sure)
        inside = inside & (part == row["p"])
    return out.unionByName(df.where(inside).orderBy(digest, row_id).limit(left))


def exact_split(
    df: DataFrame, row_id: str, test_fraction: float = 0.2, seed: int = DEFAULT_SEED
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly ``round(test_fraction * rows)`` test rows."""
    test = exact_sample(df, row_id, fraction=test_fraction, seed=seed)
    return df.join(test.select(row_id), row_id, "left_anti"), test


def stratified_folds(
    df: DataFrame, label: str, row_id: str, k: int = 5, seed: int = DEFAULT_SEED, out: str = "fold"
) -> DataFrame:
    """Shuffled stratified folds: within a class, rows are dealt to folds in hash order.

    A class is ranked in segments of its hash prefix, so a dominant class is spread evenly.
    """
    digest = hash_key(row_id, seed)
    keyed = df.withColumn("__digest", digest)
    numbered = ranked(
        keyed,
        [label],
        F.substring("__digest", 1, _PREFIX_DIGITS),
        [F.col("__digest"), F.col(row_id)],
        out="__rank",
    )
    return numbered.withColumn(out, ((F.col("__rank") - 1) % k).cast("int")).drop("__digest", "__rank")
