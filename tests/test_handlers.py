import random

import pytest

from quern.functions.markdown import sections, tables
from quern.streaming.batch import run
from quern.streaming.handlers import HandlerError, Machine, holds, parse
from quern.streaming.stream import replay_counts, run_machines, run_stream

SCHEMA = "session_id string, agent_id string, seq long, call long, kind string, id string, tool string, path string, argv array<string>, n double, ts string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def stream_of(rng, name):
    """A stream with overlapping calls, prompts, changes and reads."""
    rows, call, running = [], 0, []
    for _ in range(rng.randint(0, 60)):
        kind = rng.choice(["tool.use.start", "tool.use.end", "prompt.submit", "file.changed", "file.read", "check.run", "command.run"])
        key = None
        if kind == "tool.use.start":
            call += 1
            key = f"c{call}"
            running.append(key)
        elif kind == "tool.use.end":
            if not running:
                continue
            key = running.pop(rng.randrange(len(running)))
        rows.append((name, "main", len(rows), call, kind, key, rng.choice(["Edit", "Write", None]), rng.choice(["a/x.py", "b/y.py", None]), rng.choice([["git", "x.py", "add"], ["ls", "y.py"], None]), float(rng.randint(0, 3)), f"2024-01-01 00:00:{len(rows):02d}"))
    if rng.random() < 0.6:
        rows.append((name, "main", len(rows), call, "session.end", None, None, None, None, None, "2024-01-01 00:01:00"))
    return rows


PROGRAMS = [
    {"on": "file.changed", "emit": {"p": "${path}", "t": "edit by ${tool|snake} of ${path|basename}!"}},
    {"on": "file.changed", "where": {"path": {"ne": "a/x.py"}, "any": [{"n": {"gte": 2}}, {"tool": {"exists": False}}]}, "emit": {"n": "${n}"}},
    {"on": "file.changed", "window": {"until": "prompt.submit", "absent": {"on": "check.run"}}, "emit": {"p": "${path}"}},
    {"on": "file.changed", "window": {"until": "session.end", "absent": {"on": "check.run"}}, "emit": {"p": "${path}"}},
    {"on": "file.changed", "window": {"calls": 2, "until": "prompt.submit", "first": {"on": "check.run", "where": {"n": {"gt": 0}}}}, "emit": {"p": "${path}", "n": "${match.n}"}},
    {"on": "file.read", "window": {"calls": 1, "count": {"on": "command.run", "at_least": 2}}, "emit": {"p": "${path}", "c": "${count}"}},
    {"on": "file.read", "window": {"calls": 3, "absent": {"on": "command.run"}}, "emit": {"p": "${path}"}},
    {"on": "file.read", "where": {"path": {"exists": True}}, "capture": {"base": {"field": "path", "regex": r"([^/\\]+)$"}}, "window": {"until": "session.end", "absent": {"any": [{"on": "file.changed", "where": {"path": {"eq": "$path"}}}, {"on": "command.run", "where": {"argv": {"contains": "$base"}}}]}}, "emit": {"p": "${path}", "b": "${base}"}},
    {"on": "file.read", "window": {"calls": 4, "count": {"on": "file.changed", "where": {"path": {"eq": "$path"}}, "at_least": 1}}, "emit": {"p": "${path}", "c": "${count}"}},
    {"on": "file.read", "window": {"calls": 4, "first": {"on": "file.changed", "where": {"n": {"gt": "$n"}}}}, "emit": {"p": "${path}", "m": "${match.path}"}},
    {"on": "check.run", "before": {"on": "file.changed", "where": {"tool": "Edit"}}, "emit": {"p": "${before.path}", "n": "${n}"}},
    {"on": "command.run", "where": {"argv": {"followed_by": ["git", "x.py"]}}, "each": {"field": "argv", "from": 1, "as": "word"}, "emit": {"w": "${word}", "i": "${index}"}},
    {"on": "command.run", "where": {"argv": {"any_matches": r"^l"}, "not": {"n": 3}}, "emit": {"a": "${argv}", "second": "${argv.1}"}},
    {"on": "file.changed", "where": {"path": {"matches": {"regex": r"X\.PY$", "flags": "i"}}, "tool": {"in": ["Edit", "Write"]}}, "maps": {"m": {"edit": "changed"}}, "emit": {"t": "${tool|map.m}"}},
]


@pytest.fixture(scope="module")
def streams():
    rng = random.Random(11)
    return [r for k in range(60) for r in stream_of(rng, f"s{k}")]


def expected(rows, handler):
    out, machines = [], {}
    for r in rows:
        event = {c: v for c, v in zip(COLUMNS, r, strict=True) if v is not None}
        out += machines.setdefault(r[0], Machine(handler)).accept(event)
    return out


@pytest.mark.parametrize("k", range(len(PROGRAMS)))
def test_plan_equals_machine(spark, streams, k):
    handler = parse(PROGRAMS[k])
    found = [tuple(r) for r in run(spark.createDataFrame(streams, SCHEMA), handler).collect()]
    want = [tuple(r[c] for c in ("session_id", "agent_id", "seq", *handler.emit)) for r in expected(streams, handler)]
    assert len(want) > 0
    assert sorted(found, key=str) == sorted(want, key=str)


SESSION_PROGRAMS = [
    {"on": "check.run", "scope": "session", "saw": {"on": "file.changed", "where": {"path": {"eq": "$path"}}}, "emit": {"p": "${path}"}},
    {"on": "file.changed", "scope": "session", "window": {"until": "prompt.submit", "absent": {"on": "check.run"}}, "emit": {"p": "${path}"}},
    {"on": "file.read", "scope": "session", "window": {"until": "prompt.submit", "first": {"on": "file.changed", "where": {"path": {"eq": "$path"}}}}, "emit": {"n": "${match.n}"}},
]


@pytest.mark.parametrize("k", range(len(SESSION_PROGRAMS)))
def test_sessions_interleave_their_agents(spark, k):
    rng, rows = random.Random(3), []
    for name in range(30):
        parts = [[(f"s{name}", agent, *r[2:]) for r in stream_of(rng, "x") if r[4] != "session.end"] for agent in ("main", "sub")]
        offer = 0
        while any(parts):
            part = rng.choice([p for p in parts if p])
            rows.append((*part.pop(0), offer))
            offer += 1
    handler = parse(SESSION_PROGRAMS[k])
    events = spark.createDataFrame(rows, SCHEMA + ", offer long")
    found, want = run(events, handler).collect(), run_machines(events, handler).collect()
    assert len(want) > 5 and sorted(map(tuple, found), key=str) == sorted(map(tuple, want), key=str)


def test_machines_over_groups_and_counts(spark, streams):
    handler, events = parse(PROGRAMS[2]), spark.createDataFrame(streams, SCHEMA)
    assert run_machines(events, handler).count() == len(expected(streams, handler))
    counts = replay_counts(events, handler).collect()
    assert sum(r.rows for r in counts) == len(expected(streams, handler)) and sum(r.unclosed for r in counts) > 0
    assert all(r.triggers == r.rows + r.unclosed + r.no_match for r in counts)


def test_stream_equals_batch(spark, streams, tmp_path):
    handler = parse(PROGRAMS[4])
    source = tmp_path / "in"
    for part in range(3):
        batch = [r for r in streams if r[2] // 15 == part or (part == 2 and r[2] >= 45)]
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{source}/b{part}")
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{source}")
    q = run_stream(df, handler).writeStream.format("memory").queryName("handled").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = [tuple(r) for r in spark.table("handled").collect()]
    want = [tuple(r[c] for c in ("session_id", "agent_id", "seq", *handler.emit)) for r in expected(streams, handler)]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize(
    "program",
    [
        {}, {"on": "x"}, {"on": "x", "emit": {"a": "b"}, "what": 1}, {"on": "x", "emit": {"a": "b"}, "where": {"p": {"like": 1}}}, {"on": "x", "emit": {"a": "b"}, "window": {"until": "y"}},
        {"on": "x", "emit": {"a": "b"}, "window": {"absent": {"on": "y"}}}, {"on": "x", "emit": {"a": "b"}, "window": {"until": "y", "absent": {"on": "y"}}}, {"on": "x", "emit": {"a": "b"}, "where": {"p": {"matches": "("}}},
        {"on": "x", "emit": {"a": "b"}, "before": {"on": "y", "where": {"p": {"eq": "$q"}}}}, {"on": "x", "emit": {"a": "b"}, "window": {"until": "z", "first": {"on": "y"}, "count": {"on": "y"}}},
    ],
)
def test_bad_programs_are_refused(program):
    with pytest.raises(HandlerError):
        parse(program)


def test_absent_values():
    assert holds({"a": {"ne": 1}}, {}, {}) and not holds({"a": {"eq": 1}}, {}, {}) and not holds({"a": {"in": [1]}}, {}, {}) and holds({"a": {"exists": False}}, {}, {})
    assert holds({"p": {"shares_token": "$q"}}, {"p": "lib/parser_core.py"}, {"q": "the parser_core"}) and not holds({"p": {"shares_token": "src test"}}, {"p": "src/test"}, {})


def test_tables_and_sections():
    text = "# One\nx\n| Risk: Fix | B |\n|---|:-:|\n| a \\| b | c |\n| d | e |\n\ny\n## Two\nz"
    assert tables(text) == [(["risk_fix", "b"], [["a | b", "c"], ["d", "e"]])]
    assert sections(text)["Two"] == "z"
    handler = parse({"on": "w", "each": {"table": "after", "header": ["b"], "as": "row"}, "emit": {"v": "${row.b}"}})
    event = {"session_id": "s", "agent_id": "m", "seq": 0, "call": 0, "kind": "w", "after": text}
    assert [r["v"] for r in Machine(handler).accept(event)] == ["c", "e"]
