"""Association of categorical columns: contingency statistics, controls by permutation, and rules."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quern.functions.proportion import chi2_p, median_of, wilson
from quern.functions.rng import DEFAULT_SEED, Mulberry
from quern.plans.shared import cut

#: A column that tells this share of another one's entropy defines it.
DEFINITIONAL = 0.5
LEAST_ROWS = 20
#: Rows whose cells are counted at a time.
STEP = 1 << 18
#: A chunk of a pair's rows as codes.
CHUNK_NAMES = ["a", "b", "part", "chunk", "names_a", "codes_a", "names_b", "codes_b"]
CHUNK_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.string()), pa.binary()]


def pair_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pair, a, b, va, vb, n): joint counts of every pair of columns, in declaration order; rows with a null in a pair leave it.

    The pairs of a row are made beside each other and counted before the shuffle, so its size is the number of cells.
    """
    pairs = [F.struct(F.lit(i).alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("va"), F.col(b).cast("string").alias("vb")) for i, (a, b) in enumerate(combinations(columns, 2))]
    return df.select(F.inline(F.array(*pairs))).filter("va is not null and vb is not null").groupBy("pair", "a", "b", "va", "vb").agg(F.count("*").alias("n"))


def _xlog2(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def pair_statistics(cells: DataFrame) -> DataFrame:
    """Per pair: n, rows, cols, chi2, df, v, v_corrected, bits, uncertainty, a_tells_b, b_tells_a, least_expected, definitional.

    Cells that never occur still count: each contributes its expectation to chi-square, which the margins' products give
    without making them, as all expectations sum to n.
    """
    keys = ["pair", "a", "b"]
    n_of = cells.groupBy(*keys).agg(F.sum("n").alias("t"))
    ma = cells.groupBy(*keys, "va").agg(F.sum("n").alias("ra"))
    mb = cells.groupBy(*keys, "vb").agg(F.sum("n").alias("rb"))
    sa = ma.join(n_of, keys).groupBy(*keys, "t").agg(F.count("*").alias("rows"), F.min("ra").alias("least_a"), F.sum(_xlog2(F.col("ra") / F.col("t"))).alias("xa"))
    sb = mb.groupBy(*keys).agg(F.count("*").alias("cols"), F.min("rb").alias("least_b"), F.sum(_xlog2(F.col("rb").cast("double"))).alias("yb"))
    joint = cells.join(ma, [*keys, "va"]).join(mb, [*keys, "vb"]).join(n_of, keys)
    e = F.col("ra").cast("double") * F.col("rb") / F.col("t")
    p = F.col("n") / F.col("t")
    # sum((o - e)^2 / e) over all cells = sum(o^2 / e) - n
    sj = joint.groupBy(*keys).agg(F.sum(F.col("n").cast("double") * F.col("n") / e).alias("o2e"), F.sum(_xlog2(p)).alias("xj"))
    s = sa.join(sb, keys).join(sj, keys)
    t = F.col("t").cast("double")
    s = s.withColumn("chi2", F.greatest(F.lit(0.0), F.col("o2e") - t)).withColumn("df", (F.col("rows") - 1) * (F.col("cols") - 1))
    small = F.least(F.col("rows"), F.col("cols")) - 1
    s = s.withColumn("v", F.when(small > 0, F.sqrt(F.col("chi2") / (t * small))).otherwise(0.0))
    phi = F.greatest(F.lit(0.0), F.col("chi2") / t - F.col("df") / F.when(t > 1, t - 1))
    r, c = (F.col(x) - (F.col(x) - 1) ** 2 / F.when(t > 1, t - 1) for x in ("rows", "cols"))
    under = F.least(r, c) - 1
    s = s.withColumn("v_corrected", F.coalesce(F.when(under > 0, F.sqrt(phi / F.when(under > 0, under))), F.lit(0.0)))
    ha, hb, hj = -F.col("xa"), -(F.col("yb") / t - F.log2(t)), -F.col("xj")
    bits = F.greatest(F.lit(0.0), ha + hb - hj)
    tells = lambda h: F.when(h > 1e-12, F.least(F.lit(1.0), bits / F.when(h > 1e-12, h))).otherwise(0.0)
    s = s.withColumn("bits", bits).withColumn("uncertainty", F.when(ha + hb > 1e-12, F.least(F.lit(1.0), 2 * bits / F.when(ha + hb > 1e-12, ha + hb))).otherwise(0.0))
    s = s.withColumn("a_tells_b", tells(hb)).withColumn("b_tells_a", tells(ha)).withColumn("least_expected", F.col("least_a").cast("double") * F.col("least_b") / t)
    s = s.withColumn("definitional", F.greatest("a_tells_b", "b_tells_a") >= DEFINITIONAL)
    return s.select(*keys, F.col("t").alias("n"), "rows", "cols", "chi2", "df", "v", "v_corrected", "bits", "uncertainty", "a_tells_b", "b_tells_a", "least_expected", "definitional")


@F.pandas_udf(DoubleType())
def chi2_tail(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_p(float(s), int(d)) if s == s and d else 1.0 for s, d in zip(statistic, df, strict=True)])


def benjamini_hochberg(df: DataFrame, p: str = "p", family: Iterable[str] = ()) -> DataFrame:
    """``p_adjusted`` by the step-up procedure within each family. Null p-values, and those of a null family, get none.

    Only distinct values are ordered, over range partitions: each ranks its own, and the counts below it and the least value above
    it are carried over from one row per partition and family. So a family may be as long as the data.
    """
    by = list(family)
    distinct = cut(df.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("__n")))
    # parts must not change between their uses
    dealt = cut(distinct.repartitionByRange(*by, p).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "__part").agg(F.sum("__n").alias("__sum"))
    below = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*by, "__part", F.coalesce(F.sum("__sum").over(below), F.lit(0)).alias("__below"), F.sum("__sum").over(Window.partitionBy(*by)).alias("__m"))
    inside = Window.partitionBy(*by, "__part")
    rank = F.col("__below") + F.sum("__n").over(inside.orderBy(p).rowsBetween(Window.unboundedPreceding, 0))
    raw = dealt.join(carried, [*by, "__part"]).withColumn("__q", F.col("__m") / rank * F.col(p))
    above = Window.partitionBy(*by).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    least = raw.groupBy(*by, "__part").agg(F.min("__q").alias("__q")).select(*by, "__part", F.min("__q").over(above).alias("__above"))
    own = F.min("__q").over(inside.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    adjusted = raw.join(least, [*by, "__part"]).select(*by, p, F.least(F.lit(1.0), own, F.col("__above")).alias("p_adjusted"))
    return df.join(adjusted, [*by, p], "left")


def rank_associations(df: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs that do not define each other, with p-values adjusted over them, strongest first. Pairs are few."""
    s = pair_statistics(pair_counts(df, columns)).filter("not definitional").withColumn("p", chi2_tail("chi2", "df"))
    return benjamini_hochberg(s).orderBy(F.desc("v_corrected"), "p", "a", "b")


def _chi2(a: np.ndarray, b: np.ndarray, expected: np.ndarray) -> float:
    table, cols = np.zeros(expected.size, np.int64), expected.shape[1]
    for at in range(0, len(a), step := max(STEP, expected.size)):
        table += np.bincount(a[at : at + step].astype(np.intp) * cols + b[at : at + step], minlength=expected.size)
    return float(((table.reshape(expected.shape) - expected) ** 2 / expected).sum())


def _spread(stats: list[float], observed: float) -> dict:
    stats.sort()
    middle, n = len(stats) // 2, len(stats)
    return {
        "chi2": observed, "iterations": n, "median": stats[middle] if n % 2 else (stats[middle - 1] + stats[middle]) / 2,
        "p95": stats[min(n - 1, math.floor(0.95 * n))], "most": stats[-1], "p": (sum(s >= observed - 1e-12 for s in stats) + 1) / (n + 1),
    }


def _narrow(codes: np.ndarray, most: int) -> np.ndarray:
    return codes.astype(np.min_scalar_type(max(0, most - 1)))


def _shuffled(x: np.ndarray, y: np.ndarray, iterations: int, seed: str) -> dict:
    """The null of two columns of codes, all of which occur. Only the codes and one segment of swaps are held."""
    expected = np.outer(np.bincount(x), np.bincount(y)) / len(x)
    observed, rng, stats, y = _chi2(x, y, expected), Mulberry(seed), [], y.copy()
    for _ in range(iterations):
        rng.shuffle_array(y)
        stats.append(_chi2(x, y, expected))
    return _spread(stats, observed)


def permutation_null(a: list[str], b: list[str], iterations: int = 500, seed: str = DEFAULT_SEED, blocks: list[str] | None = None) -> dict:
    """Chi-square of shuffled labels: median, p95, most, and the observed value's p. With blocks, whole blocks swap ``a``'s label.

    Each shuffle goes on from the one before, so iterations run in order; different pairs are independent tasks.
    """
    a_names, x = np.unique(a, return_inverse=True)
    b_names, y = np.unique(b, return_inverse=True)
    if blocks is None:
        return _shuffled(_narrow(x, len(a_names)), _narrow(y, len(b_names)), iterations, seed)
    observed, rng, stats = _chi2(x, y, np.outer(np.bincount(x), np.bincount(y)) / len(x)), Mulberry(seed), []
    labels: dict[str, int] = {}
    for block, label in zip(blocks, x.tolist(), strict=True):
        if block is None or labels.setdefault(block, label) != label:
            raise ValueError("every row needs a block, and a block has one label")
    place = {block: i for i, block in enumerate(labels)}
    at, shuffled = np.array([place[block] for block in blocks]), list(labels.values())
    for _ in range(iterations):
        rng.shuffle(shuffled)
        moved = np.asarray(shuffled)[at]
        margin = np.outer(np.bincount(moved, minlength=len(a_names)), np.bincount(y)) / len(x)
        stats.append(_chi2(moved, y, margin) if (margin > 0).all() else _chi2_open(moved, y, margin))
    return _spread(stats, observed)


def _chi2_open(a: np.ndarray, b: np.ndarray, margin: np.ndarray) -> float:
    table = np.bincount(a * margin.shape[1] + b, minlength=margin.size).reshape(margin.shape)
    some = margin > 0
    return float(((table - margin)[some] ** 2 / margin[some]).sum())


def permutation_control(df: DataFrame, columns: list[str], order: list[str], iterations: int = 500, seed: str = DEFAULT_SEED) -> DataFrame:
    """(a, b, chi2, median, p95, most, p) per pair, of any number of rows; one task shuffles one pair.

    Rows are put in order and coded where they lie; a pair's task gets them as chunks of codes with the names that these stand for, so it
    holds one byte per row and column where a column has up to 256 values.
    """
    pairs = list(combinations(columns, 2))
    by = [F.col(c).asc_nulls_last() for c in order]
    rows = df.select(*order, *(F.col(c).cast("string").alias(f"__c{i}") for i, c in enumerate(columns))).repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = rows.select(F.spark_partition_id().alias("part"), *(f"__c{i}" for i in range(len(columns))))
    places = list(combinations(range(len(columns)), 2))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, batch in enumerate(batches):
            out = []
            for (i, j), (a, b) in zip(places, pairs, strict=True):
                x, y = batch.column(i + 1), batch.column(j + 1)
                both = pc.and_(pc.is_valid(x), pc.is_valid(y))
                found = [v.filter(both).dictionary_encode() for v in (x, y)]
                if len(found[0]):
                    codes = [v.indices.to_numpy(zero_copy_only=False) for v in found]
                    codes = [c.astype(np.min_scalar_type(len(v.dictionary) - 1)).tobytes() for c, v in zip(codes, found, strict=True)]
                    out.append((a, b, batch.column(0)[0].as_py(), at, found[0].dictionary.to_pylist(), codes[0], found[1].dictionary.to_pylist(), codes[1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), CHUNK_TYPES, strict=True)], CHUNK_NAMES)

    def joined(chunks: pd.DataFrame, names: str, codes: str) -> np.ndarray:
        """The chunks' codes as places among all their names in order."""
        every = sorted({v for found in chunks[names] for v in found})
        place, kind = {v: i for i, v in enumerate(every)}, np.min_scalar_type(len(every) - 1)
        parts = []
        for found, raw in zip(chunks[names], chunks[codes], strict=True):
            parts.append(np.array([place[v] for v in found], kind)[np.frombuffer(raw, np.min_scalar_type(len(found) - 1))])
        return np.concatenate(parts)

    def one(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values(["part", "chunk"])
        found = _shuffled(joined(chunks, "names_a", "codes_a"), joined(chunks, "names_b", "codes_b"), iterations, seed)
        return pd.DataFrame([{"a": chunks["a"].iloc[0], "b": chunks["b"].iloc[0], **{k: found[k] for k in ("chi2", "median", "p95", "most", "p")}}])

    chunks = numbered.mapInArrow(code, "a string, b string, part int, chunk int, names_a array<string>, codes_a binary, names_b array<string>, codes_b binary")
    return chunks.groupBy("a", "b").applyInPandas(one, "a string, b string, chi2 double, median double, p95 double, most double, p double")


def association_rules(items: DataFrame, least: int = 20, most: int = 3) -> DataFrame:
    """(antecedent, consequent, support, n_antecedent, n_consequent, n, confidence, lift, productive, informative) from (id, item).

    Frequent sets of up to ``most`` items by FP-growth, which shares its conditional trees out over the cluster. A rule is
    productive if it is more confident than every rule with the same consequent and fewer of its antecedents.
    """
    from pyspark.ml.fpm import FPGrowth

    baskets = items.filter("item is not null").groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n = baskets.count()
    if n < least:
        schema = "antecedent array<string>, consequent string, support long, n_antecedent long, n_consequent long, n long, confidence double, lower double, upper double, lift double, productive boolean, informative boolean"
        return items.sparkSession.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=0.0).fit(baskets)
    sets = model.freqItemsets.filter(F.size("items") <= most).select(F.array_sort("items").alias("items"), F.col("freq").alias("support"))
    split = sets.filter(F.size("items") > 1).withColumn("consequent", F.explode("items")).withColumn("antecedent", F.array_remove("items", F.col("consequent")))
    ante = sets.select(F.col("items").alias("antecedent"), F.col("support").alias("n_antecedent"))
    cons = sets.filter(F.size("items") == 1).select(F.col("items")[0].alias("consequent"), F.col("support").alias("n_consequent"))
    rules = split.join(ante, "antecedent").join(cons, "consequent").select("antecedent", "consequent", "support", "n_antecedent", "n_consequent", F.lit(n).cast("long").alias("n"))
    w = wilson(F.col("support"), F.col("n_antecedent"))
    rules = rules.withColumn("confidence", F.col("support") / F.col("n_antecedent")).withColumn("lower", w["lower"]).withColumn("upper", w["upper"])
    base = F.col("n_consequent") / F.col("n")
    rules = rules.withColumn("lift", F.col("confidence") / base).withColumn("informative", F.col("lower") > base)
    # antecedents have at most most - 1 items: every shorter one is the antecedent less one item, or nothing
    shorter = rules.filter(F.size("antecedent") > 1).select("antecedent", "consequent", F.explode("antecedent").alias("x"))
    shorter = shorter.withColumn("part", F.array_remove("antecedent", F.col("x"))).join(rules.select(F.col("antecedent").alias("part"), "consequent", F.col("confidence").alias("c")), ["part", "consequent"])
    best = shorter.groupBy("antecedent", "consequent").agg(F.max("c").alias("best"))
    out = rules.join(best, ["antecedent", "consequent"], "left")
    return out.withColumn("productive", F.col("confidence") > F.greatest(F.coalesce("best", F.lit(0.0)), base)).drop("best")


__all__ = ["association_rules", "benjamini_hochberg", "median_of", "pair_counts", "pair_statistics", "permutation_control", "permutation_null", "rank_associations"]
