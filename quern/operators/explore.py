"""Profiles, crosstabs, paging and dumps of a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.entries import View, rendered, signatures
from quern.plans.shared import cut
from quern.plans.spec import STATES

TOP = 10
#: Sorts a state after every value of the same count.
AFTER_VALUES = "\uffff"


def profile_states(view: View) -> DataFrame:
    """(property, state, n), zeros included: one aggregate row, turned to long form."""
    cells = [(p.name, s, F.count_if(F.col(f"{p.name}_state") == s)) for p in view.properties for s in STATES]
    row = view.df.agg(*(c.alias(f"c{i}") for i, (_, _, c) in enumerate(cells)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(p).alias("property"), F.lit(s).alias("state"), F.col(f"c{i}").alias("n")) for i, (p, s, _) in enumerate(cells)))))


def profile_ranges(view: View, names: list[str]) -> DataFrame:
    """(property, least, most) over measured values, as text; one aggregate row."""
    row = view.df.agg(*(f(F.when(F.col(f"{n}_state") == STATES[0], F.col(n))).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("property"), F.col(f"min_{n}").cast("string").alias("least"), F.col(f"max_{n}").cast("string").alias("most")) for n in names))))


def profile_distinct(view: View, names: list[str]) -> DataFrame:
    """(property, n_distinct) over measured values. Long form first: one shuffle of pre-aggregated (property, value) pairs, not an expansion per property."""
    long = signatures(view, names).filter(F.col("state") == STATES[0])
    counted = long.groupBy("property", "value").count().groupBy("property").agg(F.count("value").alias("n_distinct"))
    every = view.df.sparkSession.createDataFrame([(n,) for n in names], "property string")
    return every.join(F.broadcast(counted), "property", "left").select("property", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def top_values(view: View, names: list[str], top: int = TOP) -> DataFrame:
    """(property, value, n, place): the most frequent measured values, ties by value."""
    counted = signatures(view, names).filter(F.col("state") == STATES[0]).groupBy("property", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("property").orderBy(F.desc("n"), "value"))
    return counted.withColumn("place", place).filter(F.col("place") <= top)


def profile_entries(view: View) -> DataFrame:
    """(n, first, last): the entries and their span."""
    return view.df.agg(F.count("*").alias("n"), F.min("recorded_at").alias("first"), F.max("recorded_at").alias("last"))


def _key(view: View, name: str) -> tuple[Column, Column]:
    """A grouping key: the value as text where measured, and the state where not."""
    state = F.col(f"{name}_state")
    return F.when(state == STATES[0], rendered(view, name)), F.when(state != STATES[0], state)


def _marker(prefix: str = "") -> Column:
    return F.coalesce(F.concat(F.lit(AFTER_VALUES), F.col(f"{prefix}state")), F.col(f"{prefix}value"))


def group_one(view: View, name: str, top: int = TOP) -> DataFrame:
    """(value, state, n, place): the largest groups of one property, states as groups of their own."""
    value, state = _key(view, name)
    counted = view.df.groupBy(value.alias("value"), state.alias("state")).agg(F.count("*").alias("n"))
    # the largest few of a key's groups: a top-k without a window over all of them
    largest = counted.orderBy(F.desc("n"), _marker()).limit(top)
    return largest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), _marker())))


def crosstab(view: View, first: str, second: str, top: int = TOP) -> DataFrame:
    """(a_value, a_state, b_value, b_state, n): joint counts of the groups that are among each axis' largest.

    One shuffle of the joint counts serves both margins; the margins' largest are at most ``top`` rows each, so they are
    broadcast.
    """
    (av, as_), (bv, bs) = _key(view, first), _key(view, second)
    joint = view.df.groupBy(av.alias("a_value"), as_.alias("a_state"), bv.alias("b_value"), bs.alias("b_state")).agg(F.count("*").alias("n"))
    kept = joint
    for side in ("a", "b"):
        margin = joint.groupBy(f"{side}_value", f"{side}_state").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), _marker(f"{side}_")).limit(top)
        margin = margin.select(F.col(f"{side}_value").alias("v"), F.col(f"{side}_state").alias("s"))
        kept = kept.join(F.broadcast(margin), F.col(f"{side}_value").eqNullSafe(F.col("v")) & F.col(f"{side}_state").eqNullSafe(F.col("s")), "left_semi")
    return kept


def page(view: View, size: int, after: tuple[str, str] | None = None) -> DataFrame:
    """The next ``size + 1`` entries after a (recorded_at, id): the extra row tells that more follow."""
    rows = view.df
    if after:
        at, key = F.lit(after[0]), F.lit(after[1])
        rows = rows.filter((F.col("recorded_at") > at) | ((F.col("recorded_at") == at) & (F.col("id") > key)))
    return rows.orderBy("recorded_at", "id").limit(size + 1)


def cluster_cells(view: View, name: str, cluster: str) -> DataFrame:
    """(value, state, cluster, n): counts by group and cluster, for designs."""
    value, state = _key(view, name)
    return view.df.groupBy(value.alias("value"), state.alias("state"), F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))


def dump_chunks(view: View, size: int, order: list[str]) -> DataFrame:
    """(chunk, n, characters, least, most) of a dump cut into chunks of ``size`` in order.

    Places are counted over range partitions: each counts its rows, the few totals are summed, and rows never meet in one task.
    """
    text = F.length(F.to_json(F.struct(*[F.col(c) for c in view.df.columns])))
    rows = view.df.select(*order, text.alias("__len")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    # places must not change between their two uses
    rows = cut(rows.withColumn("__in", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    totals = rows.groupBy("__part").agg(F.count("*").alias("c"))
    before = totals.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    placed = rows.join(F.broadcast(before), "__part").withColumn("chunk", F.floor((F.col("before") + F.col("__in")) / size))
    return placed.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("__len").alias("characters"), F.min(order[0]).alias("least"), F.max(order[0]).alias("most"))
