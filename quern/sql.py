"""Free SQL over registered views: one read-only statement, columns without repeated names."""

from __future__ import annotations

import base64
import json
import re
import urllib.parse

from pyspark.sql import DataFrame, SparkSession

from quern.plans.spec import canonical_json, sha256_hex

#: Nodes of plans that only read. A list of what is allowed, since not every writing plan calls itself a command.
READING = frozenset("Project Filter Aggregate Sort GlobalLimit LocalLimit Limit Distinct Union Intersect Except UnresolvedWith With SubqueryAlias Join AsOfJoin UnresolvedInlineTable UnresolvedSubqueryColumnAliases UnresolvedHaving Offset WithWindowDefinition OneRowRelation UnresolvedRelation RelationTimeTravel Pivot Unpivot LateralJoin Generate Tail CTE WithCTE UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedHint Sample Window LocalRelation".split())
#: Functions that call any static method of the driver's or an executor's machine.
CALLING = frozenset("reflect java_method try_reflect".split())


class QueryError(ValueError):
    """A statement that is not run."""


def statement_count(sql: str) -> int:
    """Statements in a text, empty ones apart; quotes and comments hide semicolons."""
    rest = re.sub(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`", lambda m: " " if m[0][:2] in ("--", "/*") else "x", sql, flags=re.S)
    return sum(bool(part.strip()) for part in rest.split(";"))


def query(spark: SparkSession, sql: str) -> DataFrame:
    """The result of one reading statement; repeated column names get a number.

    Every node of the parsed statement must be one that reads, in whatever clause, subquery or named query it stands.
    """
    if statement_count(sql) != 1:
        raise QueryError(f"one statement at a time, not {statement_count(sql)}")
    sql = sql.strip().rstrip(";")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    check_reading(spark, plan)
    return distinct_names(spark.sql(sql))


def check_reading(spark: SparkSession, plan) -> None:
    """Refuses a parsed plan with a node that may write or a function that calls out."""
    def listed(seq) -> list:
        return list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(seq))

    plans, expressions = [plan], []
    while plans:
        node = plans.pop()
        if node.nodeName() not in READING:
            raise QueryError(f"only reading statements are run, not {node.nodeName()}")
        if node.nodeName() == "UnresolvedTableValuedFunction":
            _check_name(listed(node.name()))
        plans += [*listed(node.children()), *listed(node.innerChildren()), *listed(node.subqueries())]
        expressions += listed(node.expressions())
    while expressions:
        e = expressions.pop()
        if e.nodeName() == "UnresolvedFunction":
            _check_name(listed(e.nameParts()))
        expressions += listed(e.children())


def _check_name(parts: list[str]) -> None:
    name = parts[-1]
    if name.lower() in CALLING:
        raise QueryError(f"{name} calls methods of the machine")


def distinct_names(df: DataFrame) -> DataFrame:
    seen: dict[str, int] = {}
    names = []
    taken = set(df.columns)
    for c in df.columns:
        seen[c] = seen.get(c, 0) + 1
        name = c if seen[c] == 1 else f"{c}_{seen[c]}"
        while seen[c] > 1 and name in taken:
            seen[c] += 1
            name = f"{c}_{seen[c]}"
        taken.add(name)
        names.append(name)
    return df.toDF(*names)


def register_compat(spark: SparkSession) -> None:
    """``json_extract`` for statements written for stores that have it."""
    spark.sql("create or replace temporary function json_extract(j string, p string) returns string return get_json_object(j, p)")


def cursor_scope(type_name: str, condition: str | None = None, struck: bool = False) -> str:
    base = canonical_json({"order": "recorded_at,id", "type": type_name})
    return sha256_hex("\0".join([base, condition or "", "struck" if struck else ""]) if condition or struck else base)[:16]


def encode_cursor(recorded_at: str, key: str, scope: str) -> str:
    return "asc1:" + urllib.parse.quote(canonical_json({"i": key, "r": recorded_at, "s": scope}), safe="!'()*-._~")


def decode_cursor(cursor: str, scope: str) -> tuple[str, str]:
    """(recorded_at, id), refusing another query's cursor."""
    if not cursor.startswith("asc1:"):
        raise QueryError("not a cursor")
    try:
        found = json.loads(urllib.parse.unquote(cursor[5:], errors="strict"))
        at, key, of = found["r"], found["i"], found["s"]
    except (ValueError, KeyError, TypeError):
        raise QueryError("not a cursor") from None
    if of != scope:
        raise QueryError("the cursor belongs to another query")
    return at, key


def to_hex(value: bytes) -> str:
    return f"X'{base64.b16encode(value).decode()}'"


def neutral_csv(df: DataFrame) -> DataFrame:
    """Texts that a spreadsheet would run as formulas, made plain by an apostrophe; numbers stay."""
    from pyspark.sql import functions as F

    def plain(c):
        risky = F.col(c).rlike(r"^[=+\-@\t\r]") & F.col(c).try_cast("double").isNull()
        return F.when(risky, F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c)

    return df.select(*(plain(c) if t == "string" else F.col(c) for c, t in df.dtypes))
