"""Typed views of entries: every property as a column and its state beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.spec import ENVELOPE, SPARK_TYPES, STATES, Property, TypeSpec


@dataclass(frozen=True)
class View:
    """A DataFrame with, for each property, its typed column and ``<name>_state``."""

    df: DataFrame
    properties: tuple[Property, ...]

    def where(self, condition: Column | str) -> View:
        """The entries that meet a predicate over envelope and properties. A string must be one expression."""
        return View(self.df.filter(F.expr(condition) if isinstance(condition, str) else condition), self.properties)

    def __getitem__(self, name: str) -> Property:
        return next(p for p in self.properties if p.name == name)


def state_of(present: Column, not_applicable: Column, declared: Column | None = None) -> Column:
    """The four-way state; without ``declared`` every version declares the property."""
    otherwise = F.lit(STATES[2]) if declared is None else F.when(declared, STATES[2]).otherwise(STATES[3])
    return F.when(present, STATES[0]).when(not_applicable, STATES[1]).otherwise(otherwise)


def typed(raw: Column, kind: str) -> Column:
    return raw if SPARK_TYPES[kind] == "string" else raw.try_cast(SPARK_TYPES[kind])


def project(entries: DataFrame, versions: list[TypeSpec], invalidations: DataFrame | None = None) -> View:
    """The view of one major version family over stored entries (``properties_json``, ``na_json``).

    A key that is there is measured, also with JSON null; properties are those of all versions, typed by the newest that
    declares them, in alphabetical order. ``invalidations`` (entry_id, label) fills ``invalidated``.
    """
    newest: dict[str, Property] = {}
    declaring: dict[str, list[int]] = {}
    for spec in sorted(versions, key=lambda s: s.version):
        for p in spec.properties:
            newest[p.name] = p
            declaring.setdefault(p.name, []).append(spec.version)
    numbers = [s.version for s in versions]
    rows = entries.filter((F.col("type_name") == versions[0].name) & F.col("type_version").isin(numbers))
    rows = rows.withColumn("__props", F.from_json("properties_json", "map<string,string>")).withColumn("__na", F.from_json("na_json", "array<string>"))
    columns = [F.col(c) for c in ENVELOPE if c in rows.columns]
    if invalidations is not None:
        rows = rows.join(invalidations.select(F.col("entry_id").alias("id"), F.col("label").alias("invalidated")), "id", "left")
        columns.append(F.col("invalidated"))
    for name in sorted(newest):
        everywhere = set(declaring[name]) == set(numbers)
        declared = None if everywhere else F.col("type_version").isin(declaring[name])
        columns.append(typed(F.col("__props")[name], newest[name].type).alias(name))
        columns.append(state_of(F.map_contains_key("__props", F.lit(name)), F.coalesce(F.array_contains("__na", name), F.lit(False)), declared).alias(f"{name}_state"))
    return View(rows.select(*columns), tuple(newest[n] for n in sorted(newest)))


def adapt(df: DataFrame, key: str, properties: dict[str, tuple[str, str]], recorded_at: str | None = None, not_applicable: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> View:
    """A view over columns that are typed already: name -> (type, expression). Null is not measured, or not applicable by its rule."""
    na = not_applicable or {}
    columns = [F.expr(key).alias("id"), *([F.expr(recorded_at).alias("recorded_at")] if recorded_at else []), *(F.col(c) for c in keep)]
    made = []
    for name, (kind, expression) in properties.items():
        value = F.expr(expression)
        columns += [value.alias(name), state_of(value.isNotNull(), F.coalesce(F.expr(na[name]), F.lit(False)) if name in na else F.lit(False)).alias(f"{name}_state")]
        made.append(Property(name, kind))
    return View(df.select(*columns), tuple(made))


def rendered(view: View, name: str) -> Column:
    """A property's value as text."""
    return F.col(name).cast("string")


def select_states(view: View, names: list[str]) -> DataFrame:
    """The id and, per property, its value as text or the name of its state."""
    return view.df.select("id", *(F.when(F.col(f"{n}_state") == STATES[0], rendered(view, n)).otherwise(F.col(f"{n}_state")).alias(n) for n in names))


def signatures(view: View, names: list[str]) -> DataFrame:
    """Long form: (id, property, state, value as text)."""
    cells = F.array(*(F.struct(F.lit(n).alias("property"), F.col(f"{n}_state").alias("state"), F.when(F.col(f"{n}_state") == STATES[0], rendered(view, n)).alias("value")) for n in names))
    return view.df.select("id", F.inline(cells))


def validate(entries: DataFrame, spec: TypeSpec) -> DataFrame:
    """(id, errors, warnings) of entries with ``properties_json`` and ``na_json``, all rules in one pass.

    Errors: a value of the wrong type, a property both measured and not applicable, a required property without a decision,
    a document that is no JSON object. Warnings: undeclared properties, repeated not-applicable names, nothing measured.
    """
    props, na = F.from_json("properties_json", "map<string,string>"), F.coalesce(F.from_json("na_json", "array<string>"), F.array().cast("array<string>"))
    rows = entries.select("id", "properties_json", props.alias("p"), na.alias("na"))
    p, n = F.col("p"), F.col("na")
    errors = [F.when(p.isNull(), F.lit("properties are no JSON object"))]
    for q in spec.properties:
        has, value = F.coalesce(F.map_contains_key(p, F.lit(q.name)), F.lit(False)), p[q.name]
        errors += [
            F.when(has & ~F.coalesce(accepts(value, q), F.lit(False)), F.lit(f"{q.name}: not a {q.type}")),
            F.when(has & F.array_contains(n, q.name), F.lit(f"{q.name}: measured and not applicable")),
        ]
        if q.required:
            errors.append(F.when(~has & ~F.array_contains(n, q.name), F.lit(f"{q.name}: needs a value or not applicable")))
    declared = F.array(*(F.lit(q.name) for q in spec.properties))
    unknown = F.array_except(F.map_keys(p), declared)
    warnings = [
        F.when(F.size(unknown) > 0, F.concat(F.lit("undeclared: "), F.array_join(F.array_sort(unknown), ", "))),
        F.when(F.size(F.array_distinct("na")) < F.size("na"), F.lit("not applicable is repeated")),
        F.when((F.size(F.array_intersect(F.map_keys(p), declared)) == 0) & (F.size("na") > 0), F.lit("nothing is measured")),
    ]
    return rows.select("id", F.array_compact(F.array(*errors)).alias("errors"), F.array_compact(F.array(*warnings)).alias("warnings"))


def accepts(value: Column, q: Property) -> Column:
    """Whether a value, as the text a JSON reader gives for it, is one of the property's type."""
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return {
        "string": value.isNotNull(), "text": value.isNotNull(), "ref": F.length(value) > 0, "number": finite, "integer": finite & (F.floor(number) == number),
        "boolean": value.isin("true", "false"), "enum": value.isin(list(q.enum_values)) if q.enum_values else F.lit(False),
        "timestamp": value.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?Z$") & value.try_cast("timestamp").isNotNull(), "duration": finite & (number >= 0), "json": value.rlike(r"(?s)^\s*[\[{]"),
    }[q.type]
