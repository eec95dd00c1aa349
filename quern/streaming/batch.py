"""Handlers as DataFrame plans over finished streams.

Nothing here runs a machine: what came before a trigger is a running ``last``; where a window closes comes from running
minima and from one look-up by call number; and a watch whose test does not refer to the trigger is a difference of two
running counts. Only a test that refers to its trigger needs a range join, and that join has the stream as its key.
"""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.streaming.handlers import END, MOST_SUBJECT, REFERENCE, STOP_TOKENS, Handler, HandlerError, references

STREAM = ["session_id", "agent_id"]
NEVER = (1 << 62) - 1


def field_of(df: DataFrame, path: str, prefix: str = "") -> Column:
    """A field, or a place of an array field, as a column; null where there is none."""
    name, _, rest = path.partition(".")
    if f"{prefix}{name}" not in df.columns:
        return F.lit(None)
    column = F.col(f"{prefix}{name}")
    return F.get(column, F.lit(int(rest))) if rest.isdigit() else column[rest] if rest else column


def token_array(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]{4,})"), F.lit(1))
    return F.array_except(found, F.array(*(F.lit(t) for t in sorted(STOP_TOKENS))))


def pattern_of(spec: str | dict) -> str:
    source, flags = (spec, "") if isinstance(spec, str) else (spec["regex"], spec.get("flags", ""))
    return f"(?{''.join(sorted(flags))}){source}" if flags else source


def condition(test: dict | None, df: DataFrame, refs: dict[str, Column], prefix: str = "") -> Column:
    """A test as a column that is true or false, never null."""
    parts = [F.lit(True)]
    for key, value in (test or {}).items():
        if key == "any":
            parts.append(reduce(lambda a, b: a | b, (condition(t, df, refs, prefix) for t in value), F.lit(False)))
        elif key == "all":
            parts += [condition(t, df, refs, prefix) for t in value]
        elif key == "not":
            parts.append(~condition(value, df, refs, prefix))
        else:
            column, name = field_of(df, key, prefix), f"{prefix}{key.partition('.')[0]}"
            array = name in df.columns and df.schema[name].dataType.typeName() == "array" and "." not in key
            for op, operand in (value if isinstance(value, dict) else {"eq": value}).items():
                parts.append(_operator(op, column, operand, refs, array))
    return reduce(lambda a, b: a & b, parts)


def _operator(op: str, column: Column, operand: Any, refs: dict[str, Column], array: bool) -> Column:
    ref = isinstance(operand, str) and operand.startswith("$")
    other = refs.get(operand[1:], F.lit(None)) if ref else F.lit(operand) if not isinstance(operand, dict | list) else None
    false = F.lit(False)
    match op:
        case "exists":
            return column.isNotNull() if operand else column.isNull()
        case "eq":
            return F.coalesce(column == other, false)
        case "ne":
            return F.coalesce(column != other, F.lit(True))
        case "gt":
            return F.coalesce(column > other, false)
        case "gte":
            return F.coalesce(column >= other, false)
        case "lt":
            return F.coalesce(column < other, false)
        case "lte":
            return F.coalesce(column <= other, false)
        case "in":
            return F.coalesce(column.isin(list(operand)), false)
        case "matches":
            return F.coalesce(F.substring(column.cast("string"), 1, MOST_SUBJECT).rlike(pattern_of(operand)), false)
        case "contains":
            return F.coalesce(F.array_contains(column, other) if array else F.contains(column, other), false)
        case "any_matches":
            return F.coalesce(F.exists(column, lambda v: v.rlike(pattern_of(operand))), false)
        case "followed_by":
            places = F.sequence(F.lit(1), F.size(column) - 1)
            follows = F.exists(places, lambda i: (F.get(column, i - 1) == operand[0]) & (F.get(column, i) == operand[1]))
            return F.coalesce(F.when(F.size(column) > 1, follows), false)
        case "shares_token":
            text = F.array_join(column, " ") if array else column.cast("string")
            return F.coalesce(F.arrays_overlap(token_array(text), token_array(other)), false)
    raise HandlerError(f"{op} is not an operator")


def captures(handler: Handler, df: DataFrame) -> dict[str, Column]:
    """Each capture's first matching source; an empty match is a match."""
    out = {}
    for name, sources in handler.captures.items():
        found = []
        for s in sources:
            pattern = pattern_of({"regex": s["regex"], "flags": s.get("flags", "")})
            group = s.get("group", 1 if re.compile(s["regex"]).groups else 0)
            column = field_of(df, s["field"]).cast("string")
            found.append(F.when(column.rlike(pattern), F.regexp_extract(column, pattern, group)))
        out[name] = F.coalesce(*found)
    return out


def run(events: DataFrame, handler: Handler) -> DataFrame:
    """The rows a handler emits: session_id, agent_id, seq of the trigger, and a text per emitted field."""
    if handler.each and "table" in handler.each:
        raise HandlerError("tables in texts are read by the machine: use run_machines")
    if handler.scope == "session":
        # a session is one stream in the order of offers; its events keep their own stream and place beside it
        whole = events.withColumns({"own_agent": F.col("agent_id"), "own_seq": F.col("seq"), "agent_id": F.lit("*"), "seq": F.col("offer"), "call": F.lit(0).cast("long")})
        rows = run(whole, replace(handler, scope="stream"))
        places = whole.select("session_id", F.col("seq").alias("__offer"), "own_agent", "own_seq")
        found = rows.withColumnRenamed("seq", "__offer").drop("agent_id").join(places, ["session_id", "__offer"])
        return found.select("session_id", F.col("own_agent").alias("agent_id"), F.col("own_seq").alias("seq"), *handler.emit)
    order = W.partitionBy(*STREAM).orderBy("seq")
    past, future = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    df = events
    if handler.before:
        is_before = (F.col("kind") == handler.before["on"]) & condition(handler.before.get("where"), df, {})
        plain = [c for c in events.columns]
        df = df.withColumn("__before", F.last(F.when(is_before, F.struct(*plain)), ignorenulls=True).over(past))
    window = handler.window
    if window:
        ends = F.when(F.col("kind") == END, F.col("seq"))
        df = df.withColumn("__end", F.coalesce(F.min(ends).over(future), F.lit(NEVER)))
        until = F.when(F.col("kind") == window.until, F.col("seq")) if window.until else F.lit(None).cast("long")
        df = df.withColumn("__until", F.coalesce(F.min(until).over(future), F.lit(NEVER)))
    free = window and not any(references(x.get("where")) for x in window.watchers)
    if free:
        hit = reduce(lambda a, b: a | b, ((F.col("kind") == x["on"]) & condition(x.get("where"), df, {}) for x in window.watchers))
        df = df.withColumn("__hit", hit).withColumn("__upto", F.count_if(F.col("__hit")).over(order.rowsBetween(W.unboundedPreceding, 0)))
        df = df.withColumn("__next", F.min(F.when(F.col("__hit"), F.struct("seq", *[c for c in events.columns if c != "seq"]))).over(future))
    rows = df.filter((F.col("kind") == handler.on) & condition(handler.where, df, {}))
    if handler.before:
        rows = rows.filter("__before is not null")
    for name, column in captures(handler, rows).items():
        rows = rows.withColumn(f"__capture_{name}", column)
    if handler.each:
        start = int(handler.each.get("from", 0))
        rows = rows.select("*", F.posexplode(field_of(rows, handler.each["field"])).alias("__index", "__item")).filter(F.col("__index") >= start)
        if handler.each.get("matches"):
            rows = rows.filter(F.col("__item").rlike(pattern_of(handler.each["matches"])))
    refs = _references(handler, rows)
    if handler.saw:
        rows = _seen(rows, events, handler, refs)
    if not window:
        return _emit(rows, handler, refs | {"count": F.lit(0)})
    rows = _close(rows, df, window)
    if free:
        return _emit_free(rows, df, handler, refs)
    return _emit_joined(rows, events, handler, refs)


def _seen(rows: DataFrame, events: DataFrame, handler: Handler, refs: dict[str, Column]) -> DataFrame:
    """The triggers before which an event of the stream passes ``saw``'s test. The stream is the join's key."""
    earlier = events.filter(F.col("kind") == handler.saw["on"]).select(*(F.col(c).alias(f"w_{c}") for c in events.columns))
    joint = [*rows.columns, *earlier.columns]
    pair = rows.limit(0).join(earlier.limit(0), F.lit(True)).select(*joint)
    test = condition(handler.saw.get("where"), pair, refs, "w_")
    before = (F.col("session_id") == F.col("w_session_id")) & (F.col("agent_id") == F.col("w_agent_id")) & (F.col("w_seq") < F.col("seq"))
    return rows.join(earlier, before & test, "left_semi")


def _references(handler: Handler, rows: DataFrame) -> dict[str, Column]:
    refs = {c: F.col(c) for c in rows.columns if not c.startswith("__")} | {n: F.col(f"__capture_{n}") for n in handler.captures}
    if handler.each:
        refs |= {handler.each.get("as", "item"): F.col("__item"), "index": F.col("__index")}
    return refs


def _close(rows: DataFrame, df: DataFrame, window) -> DataFrame:
    """``__close``, where the window closes, ``__by_end``, and ``__limit``, where watched events exceed the calls."""
    rows = rows.withColumn("__limit", F.lit(NEVER)).withColumn("__calls", F.lit(NEVER))
    if window.calls is not None:
        # of call c: where it starts, and the last end among the calls up to it; a call that never ends holds windows open
        starts = df.filter("kind = 'tool.use.start'").groupBy(*STREAM, "call", "id").agg(F.min("seq").alias("s"))
        stops = df.filter("kind = 'tool.use.end'").groupBy(*STREAM, "id").agg(F.max("seq").alias("e"))
        calls = starts.join(stops, [*STREAM, "id"], "left").withColumn("e", F.coalesce("e", F.lit(NEVER)))
        upto = W.partitionBy(*STREAM).orderBy("call").rowsBetween(W.unboundedPreceding, 0)
        calls = calls.withColumn("m", F.max("e").over(upto))
        firsts = df.groupBy(*STREAM, F.col("call").alias("c")).agg(F.min("seq").alias("first"))
        beyond = firsts.withColumn("previous", F.lag("c").over(W.partitionBy(*STREAM).orderBy("c")))
        # calls rise by one, so the first event beyond a limit is the first of the next call
        beyond = beyond.select(*STREAM, F.explode(F.sequence(F.coalesce("previous", F.lit(0).cast("long")), F.col("c") - 1)).alias("__last"), F.col("first").alias("__first")).filter("__last >= 0")
        held = calls.select(*STREAM, F.col("call").alias("__last"), F.col("m").alias("__held"))
        rows = rows.withColumn("__last", F.col("call") + window.calls).drop("__limit", "__calls").join(beyond, [*STREAM, "__last"], "left").join(held, [*STREAM, "__last"], "left")
        limit = F.coalesce("__first", F.lit(NEVER))
        closes = F.greatest(limit, F.coalesce("__held", F.lit(0)))
        rows = rows.withColumn("__limit", limit).withColumn("__calls", closes).drop("__last", "__first", "__held")
    close = F.least("__end", "__until", "__calls")
    return rows.withColumn("__close", close).withColumn("__by_end", (F.col("__end") <= F.col("__close")) & (F.col("__close") < NEVER))


def _emits(handler: Handler, n: Column) -> Column:
    window = handler.window
    closed = F.col("__close") < NEVER
    if window.mode == "count":
        return closed & (n >= window.at_least)
    return closed & (n == 0) & (~F.col("__by_end") | F.lit(window.until == END))


def _emit_free(rows: DataFrame, df: DataFrame, handler: Handler, refs: dict[str, Column]) -> DataFrame:
    stop = F.least("__close", "__limit")
    if handler.window.mode == "first":
        found = rows.filter(F.col("__next").isNotNull() & (F.col("__next.seq") < stop))
        return _emit(found, handler, refs | {"match": F.col("__next"), "count": F.lit(1)})
    # hits before the stop are those up to the event that stops it, less itself: that event never counts
    at = df.select(*STREAM, F.col("seq").alias("__stop"), (F.col("__upto") - F.col("__hit").cast("int")).alias("__before_stop"))
    total = df.groupBy(*STREAM).agg(F.max("__upto").alias("__total"))
    joined = rows.withColumn("__stop", stop).join(at, [*STREAM, "__stop"], "left").join(total, STREAM)
    joined = joined.withColumn("__n", F.coalesce("__before_stop", "__total") - F.col("__upto"))
    return _emit(joined.filter(_emits(handler, F.col("__n"))), handler, refs | {"count": F.col("__n")})


def _emit_joined(rows: DataFrame, events: DataFrame, handler: Handler, refs: dict[str, Column]) -> DataFrame:
    kinds = sorted({x["on"] for x in handler.window.watchers})
    seen = events.filter(F.col("kind").isin(kinds)).select(*(F.col(c).alias(f"w_{c}") for c in events.columns))
    rows = rows.withColumn("__row", F.struct(*STREAM, "seq", F.col("__index") if handler.each else F.lit(0)))
    inside = (F.col("session_id") == F.col("w_session_id")) & (F.col("agent_id") == F.col("w_agent_id")) & (F.col("w_seq") > F.col("seq")) & (F.col("w_seq") < F.least("__close", "__limit"))
    pair = rows.join(seen, inside)
    tests = reduce(lambda a, b: a | b, ((F.col("w_kind") == x["on"]) & condition(x.get("where"), pair, refs, "w_") for x in handler.window.watchers))
    hits = pair.filter(tests).groupBy("__row").agg(F.count("*").alias("__n"), F.min(F.struct(F.col("w_seq").alias("seq"), *(F.col(f"w_{c}").alias(c) for c in events.columns if c != "seq"))).alias("__match"))
    joined = rows.join(hits, "__row", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    if handler.window.mode == "first":
        return _emit(joined.filter("__n > 0"), handler, refs | {"match": F.col("__match"), "count": F.lit(1)})
    return _emit(joined.filter(_emits(handler, F.col("__n"))), handler, refs | {"count": F.col("__n")})


def _text(column: Column, kind: str) -> Column:
    if kind.startswith("array"):
        return F.array_join(column, " ")
    if kind in ("double", "float"):
        return F.when(column == F.floor(column), F.floor(column).cast("string")).otherwise(column.cast("string"))
    return column.cast("string")


def _emit(rows: DataFrame, handler: Handler, refs: dict[str, Column]) -> DataFrame:
    if handler.before:
        refs = refs | {"before": F.col("__before")}

    def value(path: str) -> Column:
        head, _, rest = path.partition(".")
        if head not in refs:
            return F.lit(None).cast("string")
        column = refs[head]
        if rest:
            column = F.get(column, F.lit(int(rest))) if rest.isdigit() else column[rest]
        return _text(column, dict(rows.select(column.alias("x")).dtypes)["x"])

    def part(m: re.Match) -> Column:
        text = value(m[1].strip())
        name = (m[2] or "").strip()
        if name.startswith("map."):
            return F.element_at(F.create_map(*(F.lit(x) for kv in handler.maps[name[4:]].items() for x in kv)), F.lower(text))
        if name == "basename":
            return F.coalesce(F.nullif(F.regexp_extract(text, r"([^\\/]+)[\\/]*$", 1), F.lit("")), text)
        return F.regexp_replace(F.lower(text), r"\s+", "_") if name == "snake" else text

    def filled(template: str) -> Column:
        whole = REFERENCE.fullmatch(template)
        if whole:
            return part(whole)
        out, at = [], 0
        for m in REFERENCE.finditer(template):
            out += [F.lit(template[at : m.start()]), F.coalesce(part(m), F.lit(""))]
            at = m.end()
        return F.concat(*out, F.lit(template[at:]))

    return rows.select(*STREAM, "seq", *(filled(str(t)).alias(name) for name, t in handler.emit.items()))
