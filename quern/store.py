"""A store in Parquet: types on the driver, entries and annotations as tables, one writer that only appends."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import annotate, explore, search
from quern.plans.entries import View, project, validate
from quern.plans.spec import Property, Registry, TypeSpec, type_hash
from quern.sql import cursor_scope, decode_cursor, encode_cursor, query
from quern.sources.records import StoreError

ENTRY = "id string, type_name string, type_version int, type_hash string, recorded_at string, run_id string, workflow string, actor string, source string, cwd string, repo string, git_sha string, branch string, properties_json string, na_json string, evidence_text string, writer_version string, schema_version int"
ANNOTATION = "id string, entry_id string, scheme string, scheme_version int, label string, value string, confidence double, note string, created_by string, created_at string"


class Store:
    """Entries partitioned by type, so that a type's view reads only its own files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.registry = spark, path.rstrip("/"), Registry()
        for row in self._read("types", "spec string").collect():
            self.define(spec_of(json.loads(row["spec"])), write=False)

    def _read(self, name: str, schema: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    @property
    def entries(self) -> DataFrame:
        return self._read("entries", ENTRY)

    @property
    def annotations(self) -> DataFrame:
        return self._read("annotations", ANNOTATION)

    def define(self, spec: TypeSpec, write: bool = True) -> tuple[TypeSpec, str]:
        made, what = self.registry.register(spec)
        if write and what != "unchanged":
            self.spark.createDataFrame([(json.dumps(spec_json(made)),)], "spec string").coalesce(1).write.mode("append").parquet(f"{self.path}/types")
        return made, what

    def record(self, type_name: str, rows: DataFrame, dry_run: bool = False) -> DataFrame:
        """Append entries (id, recorded_at, properties_json, na_json and any envelope columns), all or none; a dry run returns them."""
        spec = self.registry.versions[type_name][-1]
        faults = validate(rows, spec).filter(F.size("errors") > 0).head(1)
        if faults:
            raise StoreError(f"{faults[0]['id']}: {'; '.join(faults[0]['errors'])}")
        ids = rows.select("id")
        if ids.groupBy("id").count().filter("count > 1").head(1) or ids.join(self.entries.select("id"), "id", "left_semi").head(1):
            raise StoreError("an id is taken")
        fixed = {"type_name": F.lit(spec.name), "type_version": F.lit(spec.version), "type_hash": F.lit(type_hash(spec)), "source": F.coalesce(F.col("source"), F.lit("self")) if "source" in rows.columns else F.lit("self"), "schema_version": F.lit(1)}
        columns = [part.split() for part in ENTRY.split(", ")]
        made = rows.select(*((fixed[c] if c in fixed else F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns))
        if not dry_run:
            made.write.mode("append").partitionBy("type_name").parquet(f"{self.path}/entries")
        return made

    def invalidations(self) -> DataFrame:
        return annotate.latest_labels(self.annotations.filter("scheme = 'invalidation'"), ["created_at", "id"])

    def view(self, type_name: str, major: int | None = None) -> View:
        versions = self.registry.versions[type_name]
        return project(self.entries, self.registry.family(type_name, major or versions[-1].major), self.invalidations())

    def register_views(self) -> None:
        """Temporary views ``v_<type>_v<major>`` for free SQL."""
        for name, versions in self.registry.versions.items():
            for major in {v.major for v in versions}:
                self.view(name, major).df.createOrReplaceTempView(f"v_{name}_v{major}")

    def query(self, sql: str) -> DataFrame:
        self.register_views()
        return query(self.spark, sql)

    def explore(self, type_name: str, where: str | None = None, group_by: list[str] | None = None) -> DataFrame:
        """State counts, or the groups of one property, or the crosstab of two."""
        view = self.view(type_name)
        view = view.where(where) if where else view
        if not group_by:
            return explore.profile_states(view)
        return explore.group_one(view, group_by[0]) if len(group_by) == 1 else explore.crosstab(view, *group_by[:2])

    def page(self, type_name: str, size: int, cursor: str | None = None, where: str | None = None) -> tuple[list, str | None]:
        """Rows and the next page's cursor, if there is one."""
        scope = cursor_scope(type_name, where)
        view = self.view(type_name)
        rows = explore.page(view.where(where) if where else view, size, decode_cursor(cursor, scope) if cursor else None).collect()
        more = len(rows) > size
        rows = rows[:size]
        return rows, encode_cursor(rows[-1]["recorded_at"], rows[-1]["id"], scope) if more else None

    def search(self, text: str, type_name: str | None = None, limit: int = search.LIMIT) -> DataFrame:
        docs = self.entries if type_name is None else self.entries.filter(F.col("type_name") == type_name)
        return search.search(docs, text, "id", "evidence_text", limit)

    def annotate(self, scheme: str, rules: list[dict], created_at: str, type_name: str | None = None) -> DataFrame:
        """One pass of a scheme's rules, first match wins; appended and returned."""
        scope = self.entries if type_name is None else self.entries.filter(F.col("type_name") == type_name)
        labels = sorted({r["label"] for r in rules})
        found = annotate.apply_rules(scope, rules).select(
            F.concat(F.lit(f"{scheme}:{created_at}:"), "id").alias("id"), F.col("id").alias("entry_id"), F.lit(scheme).alias("scheme"), F.lit(1).alias("scheme_version"), "label",
            *(F.lit(None).cast(t).alias(c) for c, t in (("value", "string"), ("confidence", "double"), ("note", "string"), ("created_by", "string"))), F.lit(created_at).alias("created_at"),
        )
        annotate.record(self.annotations, self.entries, found, labels)
        found.write.mode("append").parquet(f"{self.path}/annotations")
        return found

    def invalidate(self, entry_id: str, label: str, reason: str, created_at: str, superseded_by: str | None = None) -> None:
        before = self.annotations
        after = annotate.invalidate(before, entry_id, label, reason, created_at, superseded_by)
        new = after.join(before.select("id"), "id", "left_anti").withColumn("scheme", F.lit("invalidation"))
        new.select(*(F.col(c) for c in before.columns)).write.mode("append").parquet(f"{self.path}/annotations")


def spec_json(spec: TypeSpec) -> dict:
    return {"name": spec.name, "description": spec.description, "properties": [p.__dict__ | {"enum_values": list(p.enum_values)} for p in spec.properties]}


def spec_of(shape: dict) -> TypeSpec:
    return TypeSpec(shape["name"], tuple(Property(**(p | {"enum_values": tuple(p.get("enum_values", ()))})) for p in shape["properties"]), shape.get("description"))
