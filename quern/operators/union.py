"""One type across projects, differences between stores, and arms compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class UnionError(ValueError):
    """Projects that cannot be read as one."""


def union_entries(projects: dict[str, DataFrame], type_hash: str) -> DataFrame:
    """The entries of all projects with their project, only those of one definition. A project without any is refused."""
    if not projects:
        raise UnionError("no projects")
    parts = []
    for name, df in projects.items():
        if "type_hash" not in df.columns:
            raise UnionError(f"{name} holds no entries")
        mine = df.filter(F.col("type_hash") == type_hash)
        if not mine.head(1) and df.head(1):
            raise UnionError(f"{name} has another definition of the type")
        parts.append(mine.withColumn("project", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def collapse_exact(records: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(distinct records, conflicting ids): equal records are one; an id with different contents is a conflict."""
    distinct = records.distinct()
    return distinct, distinct.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def lost_ids(baseline: DataFrame, present: DataFrame, key: str = "id") -> DataFrame:
    return baseline.select(key).distinct().join(present.select(key), key, "left_anti")


def compare_arms(units: DataFrame, at: Column) -> DataFrame:
    """(arm, span, units, hit) from one row per unit (arm, first, last, hit): spans lie before or after ``at``, straddle it, or are undated."""
    span = F.when(F.col("first").isNull() | F.col("last").isNull(), "undated").when(F.col("last") < at, "before").when(F.col("first") >= at, "after").otherwise("straddling")
    return units.withColumn("arm", F.coalesce("arm", F.lit("unassigned"))).groupBy("arm", span.alias("span")).agg(F.count("*").alias("units"), F.count_if("hit").alias("hit"))


def single_arm_units(assignments: DataFrame, unit: str = "unit") -> DataFrame:
    """(unit, arm) of the units that were only ever in one arm."""
    return assignments.groupBy(unit).agg(F.min("arm").alias("arm"), F.max("arm").alias("other")).filter("arm = other").drop("other")
