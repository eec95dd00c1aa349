"""Stores: JSON-lines trees and their interchange form, Parquet at rest, and the checks on the way in and out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("type", "entry", "scheme", "annotation")
MOST_RECORDS = 5_000
UTC_MS = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"


class StoreError(ValueError):
    """A store or a line that is refused."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, id, recorded_at, line, fault) of every JSON line; faults name what is wrong."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).filter(F.trim("line") != "")
    get = lambda k: F.get_json_object("line", f"$.{k}")
    kind = get("kind")
    fault = F.when(F.try_parse_json("line").isNull(), "not json").when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "unknown kind").when(get("id").isNull() & kind.isin("entry", "annotation"), "no id")
    at = F.coalesce(get("recorded_at"), get("created_at"))
    return rows.select("path", kind.alias("kind"), get("id").alias("id"), at.alias("recorded_at"), "line", fault.alias("fault"))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """The records of a tree in canonical order; equal lines are one, and faults or ids with two contents are refused."""
    rows = read_lines(spark, path).drop("path")
    bad = rows.filter("fault is not null").select("fault").head(1)
    if bad:
        raise StoreError(bad[0]["fault"])
    distinct = rows.drop("fault").distinct()
    twice = distinct.filter("id is not null").groupBy("kind", "id").agg(F.count("*").alias("n")).filter("n > 1").head(1)
    if twice:
        raise StoreError(f"{twice[0]['id']} has two contents")
    return distinct.orderBy("kind", "recorded_at", "id")


def write_tree(records: DataFrame, path: str) -> None:
    """Lines by kind, in files of a bounded number of records."""
    records.select("kind", "line").write.mode("append").option("maxRecordsPerFile", MOST_RECORDS).partitionBy("kind").text(path)


def entries_of(records: DataFrame) -> DataFrame:
    """Entry lines as columns."""
    schema = "id string, type_name string, type_version int, type_hash string, recorded_at string, run_id string, workflow string, actor string, source string, cwd string, repo string, git_sha string, branch string, evidence_text string, writer_version string, schema_version int"
    parsed = records.filter("kind = 'entry'").withColumn("e", F.from_json("line", schema))
    return parsed.select("e.*", F.get_json_object("line", "$.properties").alias("properties_json"), F.coalesce(F.get_json_object("line", "$.na"), F.lit("[]")).alias("na_json"))


def to_lines(entries: DataFrame, kind: str = "entry") -> DataFrame:
    """Interchange lines of a table, nulls left out."""
    body = F.to_json(F.struct(F.lit(kind).alias("kind"), *[F.col(c) for c in entries.columns]))
    at = F.col("recorded_at") if "recorded_at" in entries.columns else F.lit(None).cast("string")
    return entries.select(F.lit(kind).alias("kind"), (F.col("id") if "id" in entries.columns else F.lit(None).cast("string")).alias("id"), at.alias("recorded_at"), body.alias("line"))


def integrity_faults(entries: DataFrame, known_types: DataFrame) -> DataFrame:
    """(id, fault): references, sources, documents, empty texts and timestamps that a store does not take."""
    typed = entries.join(known_types.select("type_name", "type_version", "type_hash", F.lit(True).alias("__known")), ["type_name", "type_version", "type_hash"], "left")
    empty = [F.when(F.col(c) == "", F.lit(f"{c} is empty")) for c in ("run_id", "workflow", "actor", "cwd", "repo", "git_sha", "branch") if c in entries.columns]
    faults = F.array_compact(F.array(
        F.when(F.col("__known").isNull(), F.lit("unknown type")), F.when(~F.coalesce((F.col("source") == "self") | F.col("source").startswith("derived:"), F.lit(False)), F.lit("unknown source")),
        F.when(F.from_json("properties_json", "map<string,string>").isNull(), F.lit("properties are no object")), F.when(F.from_json("na_json", "array<string>").isNull(), F.lit("na is no list")),
        F.when(~F.coalesce(F.col("recorded_at").rlike(UTC_MS), F.lit(False)), F.lit("recorded_at is no UTC time")), *empty,
    ))
    return typed.select("id", F.explode(faults).alias("fault"))


def import_faults(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, fault): ids already taken, ids twice in the import, annotations of unknown entries."""
    entries, annotations = new.filter("kind = 'entry'"), new.filter("kind = 'annotation'")
    taken = entries.join(existing.filter("kind = 'entry'").select("id"), "id", "left_semi").select("id", F.lit("taken").alias("fault"))
    twice = new.filter("id is not null").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("twice").alias("fault"))
    both = existing.filter("kind = 'entry'").select("id").union(entries.select("id"))
    orphans = annotations.select("id", F.get_json_object("line", "$.entry_id").alias("e")).join(both.select(F.col("id").alias("e")), "e", "left_anti").select("id", F.lit("unknown entry").alias("fault"))
    return taken.union(twice).union(orphans)


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 over names, lengths and bytes of a tree's files; per-file digests are made where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    digests = files.select(F.concat_ws("\0", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1), F.col("length").cast("string"), F.sha2("content", 256)).alias("d"))
    folded = digests.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("f"))
    return folded.head()["f"]


def event_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events, each once by stream and place, of whichever file first has it."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json(path).withColumn("__file", F.col("_metadata.file_path"))
    keys = ["session_id", "agent_id", "seq"]
    names = [c for c in rows.columns if c not in (*keys, "__file")]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), "__file").alias("e"))
    return first.select(*keys, "e.*")


#: Fixed patterns of texts that are not exported.
SECRETS = (r"\b(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,}", r"\bAKIA[0-9A-Z]{16}\b", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"(?i)\b(?:password|token|secret)\s*[:=]\s*\S{8,}")


def redact(text: Column, labels: dict[str, str]) -> Column:
    """Secrets hidden, then identities replaced by their tokens, longest first."""
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "<secret>")
    for label in sorted(labels, key=lambda x: (-len(x), x)):
        text = F.regexp_replace(text, re.escape(label), labels[label])
    return text


def redaction_map(lines: DataFrame, columns: list[str]) -> dict[str, str]:
    """A token for each identity in ``columns``, numbered by where it first occurs (``place``) and padded alike. Identities are few."""
    out: dict[str, str] = {}
    for c in columns:
        found = lines.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("place").alias("p")).orderBy("p", c).collect()
        width = len(str(len(found)))
        out |= {r[c]: f"{c}-{i + 1:0{width}d}" for i, r in enumerate(found)}
    return out


def entry_difference(old: dict, new: dict) -> list[str]:
    """Fields whose values differ; a redaction's placeholder equals anything."""
    hidden = re.compile(r"<secret>|[a-z_]+-\d+")
    same = lambda a, b: a == b or any(isinstance(x, str) and hidden.fullmatch(x) for x in (a, b))
    return sorted(k for k in {*old, *new} if not same(old.get(k), new.get(k)))
