"""Leakage-safe splits by a portable hash: the first 12 hex digits of MD5, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def portable_hash(value: Column, salt: str = "") -> Column:
    """A non-negative 48-bit number."""
    text = F.concat(value, F.lit(f"|{salt}|")) if salt else value
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")


def in_validation(s1: Column, modulus: int = 5) -> Column:
    return F.pmod(portable_hash(s1), F.lit(modulus)) == 0


def salted_sample(ids: DataFrame, column: str, salt: str, modulus: int, without: list[DataFrame] = ()) -> DataFrame:
    """Ids of one salted class in ``modulus``, without those of other splits."""
    out = ids.select(column).distinct()
    for other in without:
        out = out.join(other.select(column), column, "left_anti")
    return out.where(F.pmod(portable_hash(F.col(column), salt), F.lit(modulus)) == 0)


def overlap(splits: dict[str, DataFrame], column: str) -> DataFrame:
    """Ids that occur in more than one split; empty if the splits are disjoint."""
    rows = None
    for name, df in splits.items():
        part = df.select(column, F.lit(name).alias("split"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(column).agg(F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits"), F.countDistinct("split").alias("n")).where("n > 1")


def write_new(df: DataFrame, path: str) -> None:
    """Write a split; an existing one is never replaced."""
    df.write.mode("error").parquet(path)
