"""Series and ordered events: rates with gaps filled, change points, run structure, numbering."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.rng import DEFAULT_SEED, Mulberry
from quern.operators.association import benjamini_hochberg

LEAST_POINTS = 3
STATE_LIKE = 2.0


def day(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def week(at: Column) -> Column:
    """The Monday of the week."""
    return F.date_format(F.date_trunc("week", at), "yyyy-MM-dd")


def weekday(at: Column) -> Column:
    return F.date_format(at, "E")


def rate_series(df: DataFrame, at: str, bucket: str = "day") -> DataFrame:
    """(label, n) for every bucket between the first and the last, empty ones as 0."""
    start = F.to_date(F.col(at)) if bucket == "day" else F.to_date(F.date_trunc("week", F.col(at)))
    counted = df.filter(F.col(at).isNotNull()).groupBy(start.alias("d")).agg(F.count("*").alias("n"))
    step = F.expr("interval 1 day" if bucket == "day" else "interval 7 days")
    every = counted.agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b", step)).alias("d"))
    return every.join(counted, "d", "left").select(F.date_format("d", "yyyy-MM-dd").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def pettitt_statistic(values: list[float]) -> tuple[int, int, float]:
    """(place, K, p): the split with the largest running sum of signs, the first of equals. Ties are zero. By ranks, in n log n."""
    v = np.asarray(values, float)
    n = len(v)
    ordered = np.sort(v)
    net = np.searchsorted(ordered, v, "left") - (n - np.searchsorted(ordered, v, "right"))
    running = np.cumsum(net)[:-1]
    place = int(np.abs(running).argmax())
    k = int(abs(running[place]))
    return place, k, min(1.0, 2 * math.exp(-6.0 * k * k / (n**3 + n**2)))


def cusum_statistic(values: list[float], iterations: int = 1000, seed: str = DEFAULT_SEED) -> tuple[int, float, float]:
    """(place, range, p): the range of the centred running sum, against seeded shuffles that go on from each other."""
    v, mean, rng = list(map(float, values)), sum(values) / len(values), Mulberry(seed)

    def scan(x: list[float]) -> tuple[float, int]:
        running = np.cumsum(np.asarray(x[:-1]) - mean)
        return float(max(0.0, running.max()) - min(0.0, running.min())), int(np.abs(running).argmax())

    observed, place = scan(v)
    shuffled, extreme = list(v), 0
    for _ in range(iterations):
        rng.shuffle(shuffled)
        extreme += scan(shuffled)[0] >= observed
    return place, observed, (extreme + 1) / (iterations + 1)


def change_points(series: DataFrame, method: str = "pettitt", iterations: int = 1000, seed: str = DEFAULT_SEED) -> DataFrame:
    """Per series of (series, label, value): (series, n, at, statistic, p, p_adjusted). One task holds one series; shorter than
    three points gives none."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("label", kind="stable")
        values = rows["value"].tolist()
        if len(values) < LEAST_POINTS:
            return pd.DataFrame(columns=["series", "n", "at", "statistic", "p"])
        place, statistic, p = pettitt_statistic(values) if method == "pettitt" else cusum_statistic(values, iterations, seed)
        return pd.DataFrame([{"series": rows["series"].iloc[0], "n": len(values), "at": rows["label"].iloc[place], "statistic": float(statistic), "p": p}])

    found = series.filter("value is not null").groupBy("series").applyInPandas(one, "series string, n long, at string, statistic double, p double")
    return benjamini_hochberg(found).select("series", "n", "at", "statistic", "p", "p_adjusted")


def runs(df: DataFrame, partition: str, value: str, order: list[str]) -> DataFrame:
    """(partition, run, value, n): maximal runs of equal values in order. Rows without a partition or value are in none."""
    w = Window.partitionBy(partition).orderBy(*order)
    change = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(0))
    rows = df.filter(F.col(partition).isNotNull() & F.col(value).isNotNull()).withColumn("__change", change)
    return rows.withColumn("run", F.sum("__change").over(w)).groupBy(F.col(partition).alias("partition"), "run", F.col(value).alias("value")).agg(F.count("*").alias("n"))


def run_structure(df: DataFrame, partition: str, value: str, order: list[str]) -> DataFrame:
    """One row: rows, partitions, runs, longest, expected_runs, rows_per_run, runs_per_expected, state_like."""
    found = runs(df, partition, value, order)
    by_value = found.groupBy("partition", "value").agg(F.sum("n").alias("c"), F.count("*").alias("r"), F.max("n").alias("l"))
    per = by_value.groupBy("partition").agg(F.sum("c").alias("size"), F.sum("r").alias("runs"), F.max("l").alias("longest"), F.sum(F.col("c").cast("double") * F.col("c")).alias("squares"))
    expected = 1 + (F.col("size") - 1) * (1 - F.col("squares") / (F.col("size") * F.col("size")))
    out = per.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("rows"), F.count("*").alias("partitions"), F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"), F.coalesce(F.max("longest"), F.lit(0)).alias("longest"), F.coalesce(F.sum(expected), F.lit(0.0)).alias("expected_runs"))
    per_run = F.when(F.col("runs") > 0, F.col("rows") / F.when(F.col("runs") > 0, F.col("runs"))).otherwise(0.0)
    share = F.when(F.col("expected_runs") > 0, F.col("runs") / F.when(F.col("expected_runs") > 0, F.col("expected_runs"))).otherwise(1.0)
    return out.withColumn("rows_per_run", per_run).withColumn("runs_per_expected", share).withColumn("state_like", per_run >= STATE_LIKE)


def first_of_runs(df: DataFrame, partition: str, value: str, order: list[str]) -> DataFrame:
    """The first row of each run of equal values."""
    w = Window.partitionBy(partition).orderBy(*order)
    return df.withColumn("__before", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w)).filter((F.col("__n") == 1) | ~F.col("__before").eqNullSafe(F.col(value))).drop("__before", "__n")


def number_turns(df: DataFrame, partition: str, order: list[str], boundary: Column, call: Column, batch_key: Column | None = None) -> DataFrame:
    """``seq`` (place), ``segment`` (boundaries so far), ``call`` (calls so far) and ``batch`` (changes of the batch key)."""
    w = Window.partitionBy(partition).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("seq", F.row_number().over(w) - 1).withColumn("segment", F.sum(boundary.cast("int")).over(so_far)).withColumn("call", F.sum(call.cast("int")).over(so_far))
    if batch_key is not None:
        out = out.withColumn("__key", batch_key)
        out = out.withColumn("batch", F.sum(F.when(F.col("__key").isNotNull() & ~F.col("__key").eqNullSafe(F.last("__key", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))), 1).otherwise(0)).over(so_far)).drop("__key")
    return out


def spread_sample(df: DataFrame, count: int, order: list[str]) -> DataFrame:
    """``count`` rows evenly spread over the order: the places floor(i * n / count)."""
    n = df.count()
    if n <= count:
        return df
    places = df.sparkSession.createDataFrame([(i * n // count + 1,) for i in range(count)], "__place long")
    # a window over all rows in one task would not scale: the range-partitioned places come from per-partition counts
    from quern.plans.shared import cut

    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before = rows.groupBy("__part").agg(F.count("*").alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.join(F.broadcast(before.drop("__c")), "__part").withColumn("__place", F.col("__before") + F.col("__in") + 1)
    return placed.join(F.broadcast(places), "__place").select(*df.columns)
