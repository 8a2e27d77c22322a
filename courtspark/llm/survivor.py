"""Best representative of each duplicate group, record by record or field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.operators.keyed import latest_by_key


def best_fields(df: DataFrame, group: str, fields: Mapping[str, Column], order: Sequence[Column]) -> DataFrame:
    """(group, field_name, field_value): for each group and field the first usable value under `order`.

    `fields` maps a name to a string column that is null where the value isn't usable; a group without a usable value
    has no row for the field. Full ties are broken by the value itself. Null groups are left out, repeated rows change
    nothing. The window keeps one row, so Spark limits every group before the shuffle: a group with a third of all
    rows sends one row per input partition and field.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in fields.items()])
    long = df.where(F.col(group).isNotNull()).withColumn("_cell", F.explode(F.filter(cells, lambda x: x["value"].isNotNull())))
    long = long.withColumn("field_name", F.col("_cell.name")).withColumn("field_value", F.col("_cell.value"))
    best = latest_by_key(long, [group, "field_name"], [*order, F.col("field_value").asc()])
    return best.select(group, "field_name", "field_value")


def best_records(df: DataFrame, group: str, fields: Mapping[str, Column], order: Sequence[Column]) -> DataFrame:
    """One whole record per group: most usable fields first, then `order`, then the values themselves. Null groups are left out."""
    filled = sum((c.isNotNull().cast("int") for c in fields.values()), F.lit(0))
    ranked = df.where(F.col(group).isNotNull()).withColumn("n_usable", filled)
    ties = [F.col(c).asc_nulls_last() for c in df.columns]
    return latest_by_key(ranked, [group], [F.col("n_usable").desc(), *order, *ties])
