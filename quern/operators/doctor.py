"""Checks of a store's health: dead types, drifting versions, names that are easily confused, states that tell nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.explore import profile_states
from quern.plans.entries import View
from quern.plans.spec import Registry, confusable_names


def list_types(entries: DataFrame, registry: Registry, invalidations: DataFrame | None = None) -> DataFrame:
    """(type_name, version, standing, struck): the latest version of every type and its entries, none included."""
    spark = entries.sparkSession
    latest = spark.createDataFrame([(name, versions[-1].version) for name, versions in registry.versions.items()], "type_name string, version int")
    marked = entries.select("id", "type_name").withColumn("struck", F.lit(False))
    if invalidations is not None:
        gone = invalidations.select(F.col("entry_id").alias("id"), F.lit(True).alias("gone")).distinct()
        marked = entries.select("id", "type_name").join(gone, "id", "left").withColumn("struck", F.coalesce("gone", F.lit(False)))
    counted = marked.groupBy("type_name").agg(F.count_if(~F.col("struck")).alias("standing"), F.count_if("struck").alias("struck"))
    # types are registry-sized
    return F.broadcast(latest).join(counted, "type_name", "left").select("type_name", "version", F.coalesce("standing", F.lit(0)).alias("standing"), F.coalesce("struck", F.lit(0)).alias("struck"))


def dead_types(entries: DataFrame, registry: Registry) -> DataFrame:
    return list_types(entries, registry).filter("standing = 0").select("type_name")


def version_drift(entries: DataFrame) -> DataFrame:
    """(type_name, type_version, n, first, last)."""
    return entries.groupBy("type_name", "type_version").agg(F.count("*").alias("n"), F.min("recorded_at").alias("first"), F.max("recorded_at").alias("last"))


def silent_properties(view: View) -> DataFrame:
    """Properties that no entry measures."""
    return profile_states(view).filter("state = 'measured' and n = 0").select("property")


def name_pairs(registry: Registry) -> list[tuple[str, str, tuple[str, ...]]]:
    return confusable_names(list(registry.versions))


def identity_vocabulary(lines: DataFrame, columns: list[str]) -> DataFrame:
    """(identity, value, lines): in how many lines each identity stands."""
    cells = F.array(*(F.struct(F.lit(c).alias("identity"), F.col(c).alias("value")) for c in columns))
    return lines.select("line", F.inline(cells)).filter("value is not null").groupBy("identity", "value").agg(F.count_distinct("line").alias("lines"))


def open_by_version(entries: DataFrame, invalidations: DataFrame, start: int, length: int) -> DataFrame:
    """(version, n): standing entries by a part of their id."""
    standing = entries.join(invalidations.select(F.col("entry_id").alias("id")), "id", "left_anti")
    return standing.groupBy(F.substring("id", start, length).alias("version")).agg(F.count("*").alias("n"))
