"""Classification scores (an extension: the catalogue's documents only mention macro-F1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def macro_f1(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """accuracy and macro_f1 over the classes that occur in either column."""
    pairs = rows.groupBy(truth, guess).count()
    sides = pairs.select(F.col(truth).alias("c"), F.col("count").alias("t"), F.lit(0).alias("g"), F.when(F.col(truth) == F.col(guess), F.col("count")).otherwise(0).alias("hit"))
    sides = sides.unionByName(pairs.select(F.col(guess).alias("c"), F.lit(0).alias("t"), F.col("count").alias("g"), F.lit(0).alias("hit")))
    each = sides.groupBy("c").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("hit").alias("hit"))
    return each.agg(F.round(F.sum("hit") / F.sum("t"), 6).alias("accuracy"), F.round(F.avg(2 * F.col("hit") / (F.col("t") + F.col("g"))), 6).alias("macro_f1"))
