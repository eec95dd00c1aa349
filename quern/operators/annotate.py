"""Labels that are added later: schemes, rules, invalidations, agreement and backtests. Entries are never changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.proportion import wilson
from quern.operators.search import matches_any
from quern.plans.spec import canonical_json, sha256_hex

#: Fixed value: the closed vocabulary of the reserved invalidation scheme.
INVALIDATIONS = ("wrong_subject", "wrong_value", "superseded", "duplicate")


class AnnotationError(ValueError):
    """A batch of annotations that cannot be recorded."""


def scheme_hash(labels: list[str], rules: list[dict]) -> str:
    return sha256_hex(canonical_json({"labels": sorted(set(labels)), "rules": rules}))


def register_scheme(known: list[dict], name: str, labels: list[str], rules: list[dict]) -> tuple[dict, bool]:
    """The scheme's version and whether it is new: the same definition as the latest is unchanged."""
    made = scheme_hash(labels, rules)
    versions = sorted((s for s in known if s["name"] == name), key=lambda s: s["version"])
    if versions and versions[-1]["hash"] == made:
        return versions[-1], False
    return {"name": name, "version": versions[-1]["version"] + 1 if versions else 1, "labels": sorted(set(labels)), "rules": rules, "hash": made}, True


def latest_labels(annotations: DataFrame, order: list[str], extra: list[str] | None = None) -> DataFrame:
    """(entry_id, label): each entry's latest. An aggregate, so an entry's history is never sorted in one place."""
    return annotations.groupBy("entry_id").agg(F.max_by("label", F.struct(*order)).alias("label"), *(F.max_by(c, F.struct(*order)).alias(c) for c in extra or []))


def struck(entries: DataFrame, invalidations: DataFrame) -> DataFrame:
    return entries.join(invalidations.select(F.col("entry_id").alias("id")), "id", "left_semi")


def standing(entries: DataFrame, invalidations: DataFrame) -> DataFrame:
    return entries.join(invalidations.select(F.col("entry_id").alias("id")), "id", "left_anti")


def invalidated_counts(annotations: DataFrame, order: list[str]) -> DataFrame:
    """(label, n) by latest label."""
    return latest_labels(annotations, order).filter("label is not null").groupBy("label").agg(F.count("*").alias("n"))


def rule_condition(rule: dict, text: str = "evidence_text") -> Column:
    return F.expr(rule["query"]) if rule["kind"] == "sql" else matches_any(F.col(text), rule["query"])


def apply_rules(entries: DataFrame, rules: list[dict]) -> DataFrame:
    """(id, label): the first rule in order that matches an entry labels it."""
    label: Column = F.lit(None).cast("string")
    for rule in reversed(rules):
        label = F.when(F.coalesce(rule_condition(rule), F.lit(False)), rule["label"]).otherwise(label)
    return entries.select("id", label.alias("label")).filter("label is not null")


def record(annotations: DataFrame, entries: DataFrame, new: DataFrame, labels: list[str]) -> DataFrame:
    """``annotations`` with a pass of new ones, or a refusal: unknown entries or labels, two labels for an entry, odd confidences."""
    faults = new.join(entries.select(F.col("id").alias("entry_id"), F.lit(True).alias("__there")), "entry_id", "left").agg(
        F.count_if(F.col("__there").isNull()).alias("unknown entries"), F.count_if(~F.col("label").isin(labels)).alias("labels outside the scheme"),
        (F.count("*") - F.count_distinct("entry_id")).alias("entries with two labels"),
        F.count_if((F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("confidences outside 0 and 1") if "confidence" in new.columns else F.lit(0).alias("confidences"),
    ).head()
    found = {k: n for k, n in faults.asDict().items() if n}
    if found:
        raise AnnotationError(", ".join(f"{n} {k}" for k, n in found.items()))
    return annotations.unionByName(new, allowMissingColumns=True)


def invalidation_id(entry_id: str, label: str, reason: str, superseded_by: str | None = None) -> str:
    return "inv-" + sha256_hex("\0".join([entry_id, label, reason, superseded_by or ""]))


def invalidate(existing: DataFrame, entry_id: str, label: str, reason: str, created_at: str, superseded_by: str | None = None) -> DataFrame:
    """``existing`` with one more invalidation; recording the same again changes nothing."""
    if label not in INVALIDATIONS:
        raise AnnotationError(f"{label} is not one of {', '.join(INVALIDATIONS)}")
    if not reason.strip():
        raise AnnotationError("an invalidation needs a reason")
    if (label == "superseded") != (superseded_by is not None):
        raise AnnotationError("superseded goes with the entry that supersedes")
    row = (invalidation_id(entry_id, label, reason, superseded_by), entry_id, label, reason, created_at, superseded_by)
    new = existing.sparkSession.createDataFrame([row], "id string, entry_id string, label string, note string, created_at string, value string")
    return existing.unionByName(new.join(existing.select("id"), "id", "left_anti"), allowMissingColumns=True)


def census(entries: DataFrame, annotations: DataFrame) -> DataFrame:
    """(label, n): entries by label, then ``considered``, ``labelled`` and ``unclassified`` in all."""
    inside = annotations.join(entries.select(F.col("id").alias("entry_id")), "entry_id", "left_semi").select("entry_id", "label").distinct()
    by_label = inside.groupBy("label").agg(F.count("*").alias("n"))
    labelled = inside.agg(F.count_distinct("entry_id").alias("n"))
    considered = entries.agg(F.count("*").alias("c"))
    # both are single rows
    both = considered.join(F.broadcast(labelled), F.lit(True))
    totals = both.select(F.inline(F.array(*(F.struct(F.lit(k).alias("label"), v.alias("n")) for k, v in (("considered", F.col("c")), ("labelled", F.col("n")), ("unclassified", F.col("c") - F.col("n")))))))
    return by_label.unionByName(totals)


def passes(annotations: DataFrame) -> DataFrame:
    """(scheme, version, created_at, n): the passes."""
    return annotations.groupBy("scheme", "scheme_version", "created_at").agg(F.count("*").alias("n"))


def kappa(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cohen's kappa of two raters (id, label): one row (n, only_a, only_b, agree, observed, expected, kappa); kappa is null where chance alone agrees always."""
    both = a.select("id", F.col("label").alias("la")).join(b.select("id", F.col("label").alias("lb")), "id", "full_outer")
    counted = both.groupBy("la", "lb").agg(F.count("*").alias("n"))
    paired = counted.filter("la is not null and lb is not null")
    margin = paired.select(F.col("la").alias("l"), F.col("n").alias("na"), F.lit(0).alias("nb")).unionByName(paired.select(F.col("lb").alias("l"), F.lit(0).alias("na"), F.col("n").alias("nb")))
    chance = margin.groupBy("l").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("products"))
    sums = counted.agg(
        F.coalesce(F.sum(F.when(F.expr("la is not null and lb is not null"), F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.expr("lb is null"), F.col("n"))), F.lit(0)).alias("only_a"),
        F.coalesce(F.sum(F.when(F.expr("la is null"), F.col("n"))), F.lit(0)).alias("only_b"), F.coalesce(F.sum(F.when(F.expr("la = lb"), F.col("n"))), F.lit(0)).alias("agree"),
    )
    n = F.when(F.col("n") > 0, F.col("n"))
    out = sums.join(F.broadcast(chance), F.lit(True)).withColumn("observed", F.col("agree") / n).withColumn("expected", F.col("products") / (n * n)).drop("products")
    return out.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / F.when(F.col("expected") < 1, 1 - F.col("expected"))))


def backtest(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(label, support, predicted, hits, precision, recall): per true or predicted label, over the truth's entries."""
    both = truth.select("id", F.col("label").alias("t")).join(predicted.select("id", F.col("label").alias("p")), "id", "left")
    counted = both.groupBy("t", "p").agg(F.count("*").alias("n"))
    cells = counted.select(F.inline(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.lit(0).alias("hits")), F.struct(F.col("p").alias("label"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.when(F.expr("t = p"), F.col("n")).otherwise(0).alias("hits")))))
    per = cells.filter("label is not null").groupBy("label").agg(*(F.sum(c).alias(c) for c in ("support", "predicted", "hits")))
    return per.withColumn("precision", wilson(F.col("hits"), F.col("predicted"))).withColumn("recall", wilson(F.col("hits"), F.col("support")))
