"""Running sums in two levels, so that no configuration's rows meet in one task: sums of chunks of rows,
the sums of the chunks before (a window over chunks, of which there are few), then a window within each
chunk. Chunks are made from values, not from where rows lie, so a lost task makes the same ones again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chunks in which values are cut by their quantiles.
CUTS = 256


def _cut(df: DataFrame, key: str, **values: str) -> DataFrame:
    """df with, for each name of values, the array of its quantiles within the key."""
    at = [(k + 1) / CUTS for k in range(CUTS)]
    cuts = df.groupBy(key).agg(*(F.percentile_approx(v, at, 1000).alias(n) for n, v in values.items()))
    return df.join(cuts, key)


def _under(cuts: str, value: str) -> Column:
    return F.size(F.filter(cuts, lambda c: c < F.col(value)))


def _before(df: DataFrame, key: str, chunk: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    ahead = Window.partitionBy(key).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(key, *chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(key, *chunk).agg(F.sum(value).alias("its_"))
    sums = sums.select(key, *chunk, F.coalesce(F.sum("its_").over(ahead), F.lit(0)).alias("ahead_"))
    return df.join(sums, [key, *chunk]).withColumn(name, F.col("ahead_") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("ahead_", *chunk)


def sum_before(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """df with the sum of `value` over the rows of equal key that come before by `order`, numbers without ties
    however far apart. df is read three times: store what is dear to make."""
    cut = _cut(df, key, cuts_=order)
    return _before(cut.withColumn("chunk_", _under("cuts_", order)).drop("cuts_"), key, ["chunk_"], [order], value, name)


def rank_by(df: DataFrame, key: str, value: str, tie: str, name: str) -> DataFrame:
    """df with its rank from 1 by `value`, then by `tie`, within each key. Rows that equal a cut, however many,
    are chunks by their tie. df is read three times: store what is dear to make."""
    cut = _cut(df, key, cuts_=value, ties_=tie)
    equal = F.exists("cuts_", lambda c: c == F.col(value))
    cut = cut.withColumns({"chunk_": _under("cuts_", value), "equal_": equal, "part_": F.when(equal, _under("ties_", tie)).otherwise(0)}).drop("cuts_", "ties_")
    return _before(cut, key, ["chunk_", "equal_", "part_"], [value, tie], F.lit(1), name).withColumn(name, F.col(name) + 1)
