"""Results as text arrays and as one summary table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def array_lines(rows: DataFrame, line_no: str, *columns: str, places: int = 6) -> DataFrame:
    """rows with (line_no, line) beside what isn't among columns: the numbers of a row with a fixed number of decimals,
    parted by spaces. A null is written as nan."""
    number = f"%.{places}f"
    parts = [F.when(F.col(c).isNull(), "nan").otherwise(F.format_string(number, F.col(c).cast("double"))) for c in columns]
    rest = [c for c in rows.columns if c not in {*columns, line_no, "line_no", "line"}]
    return rows.select(*rest, F.col(line_no).alias("line_no"), F.concat_ws(" ", *parts).alias("line"))


def summary(results: dict[str, DataFrame], key: str = "config_id") -> DataFrame:
    """(analysis, config_id, name, value): the numbers of several results below each other. A result without the key
    is about all configurations; columns that aren't numbers are left out."""
    parts = []
    for analysis, df in results.items():
        numbers = [f.name for f in df.schema.fields if f.name != key and f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte", "decimal")]
        named = df.select((F.col(key).cast("string") if key in df.columns else F.lit("all")).alias(key), *(F.col(c).cast("double").alias(c) for c in numbers))
        parts.append(named.unpivot([key], numbers, "name", "value").select(F.lit(analysis).alias("analysis"), key, "name", "value"))
    return reduce(DataFrame.unionByName, parts)
