"""Seeded samples that anyone can draw again: random, stratified, diverse, outlying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.rng import DEFAULT_SEED, Mulberry
from quern.plans.shared import cut

#: Distinct combinations that a diverse sample may bring to the driver.
MOST_IDS = 5_000_000
#: Spark's increasing ids hold a row's place in its partition in the lower 33 bits.
PART_ROWS = (1 << 33) - 1


class SampleError(ValueError):
    """A sample that cannot be drawn."""


def _check(size: int) -> None:
    if size < 1:
        raise SampleError("a sample has at least one row")


def _at_ranks(df: DataFrame, key: str, order: list[Column], ranks: list[int]) -> DataFrame:
    """The keys at the given places, from 0, of the rows in ``order``.

    Range partitions are sorted, each by itself, and their sizes added up: only the places and one number per partition are ever in
    one place. Rows that are equal in ``order`` are shared out too.
    """
    tied = [*order, F.col("__tie")]
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*tied).sortWithinPartitions(*tied)
    # a checkpoint keeps partitions and the order of their rows, and an increasing id counts a partition's rows
    held = cut(dealt.select(key)).select(key, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(PART_ROWS).alias("__row"))
    starts, at = [], 0
    for r in held.groupBy("__part").count().orderBy("__part").collect():
        starts.append((r["__part"], at))
        at += r["count"]
    spark = df.sparkSession
    parts = spark.createDataFrame(starts, "__part int, __start long")
    wanted = spark.createDataFrame([(r,) for r in ranks], "__rank long")
    ranked = held.join(F.broadcast(parts), "__part").select(key, (F.col("__start") + F.col("__row")).alias("__rank"))
    return ranked.join(F.broadcast(wanted), "__rank", "left_semi").select(key)


def random_sample(df: DataFrame, key: str, size: int, seed: str = DEFAULT_SEED) -> DataFrame:
    """``size`` rows, each set of ids as likely as any other, the same for the same seed."""
    _check(size)
    places = Mulberry(seed).places(df.count(), size)
    return _pick(df, key, _at_ranks(df.select(key), key, [F.asc_nulls_first(key)], places))


def _pick(df: DataFrame, key: str, chosen: DataFrame) -> DataFrame:
    """The rows of the chosen keys, which are no more than a sample has."""
    return df.join(F.broadcast(chosen), key, "left_semi").orderBy(key)


def allocate(populations: list[int], size: int) -> list[int]:
    """Rows per stratum: largest remainders, then one at least for each that has any, taken from the largest allocations."""
    out, there = [0] * len(populations), [i for i, p in enumerate(populations) if p > 0]
    total = sum(populations)
    if not there or size <= 0:
        return out
    if size >= total:
        return list(populations)
    if size < len(there):
        for i in sorted(there, key=lambda i: (-populations[i], i))[:size]:
            out[i] = 1
        return out
    for i in there:
        out[i] = size * populations[i] // total
    by_remainder = sorted(there, key=lambda i: (-(size * populations[i] / total - out[i]), -populations[i], i))
    for k in range(size - sum(out)):
        out[by_remainder[k % len(by_remainder)]] += 1
    for i in there:
        if not out[i]:
            donor = min((j for j in there if out[j] > 1), key=lambda j: (-out[j], -populations[j], j), default=None)
            if donor is None:
                break
            out[donor] -= 1
            out[i] = 1
    return out


def stratified_sample(df: DataFrame, key: str, stratum: str, size: int, seed: str = DEFAULT_SEED) -> DataFrame:
    """Rows in proportion to the strata, one at least of each; strata in order share one generator."""
    _check(size)
    sizes = df.groupBy(F.col(stratum).alias("__stratum")).agg(F.count("*").alias("__n"))
    # no more strata than rows of the sample can have a part in it: the largest
    largest = sizes.orderBy(F.desc("__n"), F.asc_nulls_last("__stratum")).limit(size + 1).collect()
    rows = df.select(F.col(key), F.col(stratum).alias("__stratum"))
    if len(largest) > size:
        largest = largest[:size]
        kept = df.sparkSession.createDataFrame([(r["__stratum"],) for r in largest], f"__kept {df.schema[stratum].dataType.simpleString()}")
        rows = rows.join(F.broadcast(kept), F.col("__stratum").eqNullSafe(F.col("__kept")), "left_semi")
        parts = {r["__stratum"]: 1 for r in largest}
    else:
        names = sorted((r["__stratum"] for r in largest), key=lambda x: (x is None, x))
        by = {r["__stratum"]: r["__n"] for r in largest}
        parts = dict(zip(names, allocate([by[x] for x in names], size), strict=True))
    rng, places, start = Mulberry(seed), [], 0
    for r in sorted(largest, key=lambda r: (r["__stratum"] is None, r["__stratum"])):
        places += [start + i for i in rng.places(r["__n"], parts[r["__stratum"]])]
        start += r["__n"]
    return _pick(df, key, _at_ranks(rows, key, [F.asc_nulls_last("__stratum"), F.asc_nulls_first(key)], places))


def diverse_sample(df: DataFrame, key: str, columns: list[str], size: int) -> DataFrame:
    """Rows that cover the most values, greedily, the smallest id first among equals; fewer once every value is covered.

    Only one row per distinct combination of values can be chosen with gain, so only those come to the driver.
    """
    _check(size)
    heads = df.groupBy(*columns).agg(F.min(key).alias("__id"))
    if heads.count() > MOST_IDS:
        raise SampleError(f"{MOST_IDS} distinct combinations at most")
    rows = [(r["__id"], {(c, r[c]) for c in columns}) for r in heads.orderBy("__id").collect()]
    covered, chosen = set(), []
    while len(chosen) < size:
        gain, at = 0, None
        for i, (_, pairs) in enumerate(rows):
            g = len(pairs - covered)
            if g > gain:
                gain, at = g, i
        if at is None:
            break
        covered |= rows[at][1]
        chosen.append(rows[at][0])
    return _pick(df, key, df.sparkSession.createDataFrame([(c,) for c in chosen], f"`{key}` {df.schema[key].dataType.simpleString()}"))


def outlier_scores(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, score): the sum over columns of minus the logarithm of the share that holds the row's value."""
    n = df.count()
    out = df.select(key, *columns, F.lit(0.0).alias("score"))
    for c in columns:
        counts = df.groupBy(F.col(c).alias("__v")).agg(F.count("*").alias("__n"))
        out = out.join(counts, F.col(c).eqNullSafe(F.col("__v"))).withColumn("score", F.col("score") - F.log(F.col("__n") / n)).drop("__v", "__n")
    return out.select(key, "score")


def outlier_sample(df: DataFrame, key: str, columns: list[str], size: int) -> DataFrame:
    """The ``size`` rows whose values are rarest together, ties by id."""
    _check(size)
    return outlier_scores(df, key, columns).orderBy(F.desc("score"), key).limit(size)


def estimate_tokens(text: str) -> int:
    return -(-len(text) // 2)


def fit_to_budget(rows: list[str], budget: int) -> int:
    """How many leading rows stay within an estimate of tokens, by bisection."""
    low, high = 0, len(rows)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(map(estimate_tokens, rows[:middle])) <= budget else (low, middle - 1)
    return low
