"""Joins in which a key may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str | Column], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``left`` joined with the few rows that ``right`` has for each key.

    The left rows of a key are dealt to ``salts`` parts by the hash of ``by``, columns
    of their own, so a repeated task deals alike; the right rows go to every part.
    """
    parted = left.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return parted.join(copies, [*keys, "__salt"], how).drop("__salt")
