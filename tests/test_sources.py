import json

import pytest

from quern.sources import records, transcripts
from quern.sources.shell import check_run, exec_segments, output_verdict, read_verdict
from quern.sql import QueryError, cursor_scope, decode_cursor, encode_cursor, neutral_csv, query, statement_count


@pytest.mark.parametrize(
    ("command", "segments"),
    [
        ("cd x && FOO=1 timeout 5 pytest -q | tail", [["pytest", "-q"], ["tail"]]), ("echo 'a; b' # c; d", [["echo", "a; b"]]), ('sh -c "make test; ls"', [["make", "test"], ["ls"]]),
        ("cat <<EOF\nrm x\nEOF\nls", [["cat"], ["ls"]]), ("", []), ("a 2>&1 || b", [["a", "2>&1"], ["b"]]),
    ],
)
def test_shell_segments(command, segments):
    assert exec_segments(command) == segments


@pytest.mark.parametrize(
    ("command", "runner", "exit_status"),
    [
        ("pnpm --filter x test", "pnpm test", True), ("npm run lint && echo ok", "npm run lint", True), ("pytest | tail", "pytest", False), ("cargo clippy; ls", "cargo clippy", False),
        ("prettier --write .", None, None), ("prettier --check .", "prettier", True), ("npx vitest run", "npx vitest", True), ("go test ./...", "go test", True), ("go build", None, None), ("ls", None, None),
    ],
)
def test_checks(command, runner, exit_status):
    found = check_run(command)
    assert (found and found.runner, found and found.exit_status) == (runner, exit_status)


def test_verdicts():
    assert output_verdict(" Test Files  1 failed | 1 passed (2)") == "failed" and output_verdict(" Test Files  2 passed (2)") == "passed" and output_verdict("x") is None
    assert read_verdict(True, False, "") == ("passed", "exit_status") and read_verdict(False, True, "verdict: green") == ("passed", "output") and read_verdict(True, None, "") is None


@pytest.fixture
def tree(tmp_path):
    def use(key, name, given, message):
        return {"type": "assistant", "sessionId": "s1", "uuid": f"u{key}", "timestamp": f"2024-01-01T00:00:0{key}.000Z", "message": {"id": message, "model": "m", "content": [{"type": "tool_use", "id": f"t{key}", "name": name, "input": given}]}}

    def result(key, error=False, content="", **more):
        return {"type": "user", "sessionId": "s1", "uuid": f"r{key}", "message": {"content": [{"type": "tool_result", "tool_use_id": f"t{key}", "is_error": error, "content": content}]}, **more}

    lines = [
        {"type": "user", "sessionId": "s1", "message": {"role": "user", "content": "please fix"}}, use(1, "Edit", {"file_path": "a.py", "old_string": "x", "new_string": "y"}, "m1"), use(2, "Bash", {"command": "cd p && pytest -q"}, "m1"),
        result(1), result(2, False, "ok"), {"type": "system", "sessionId": "s1", "uuid": "c1", "compactMetadata": {"trigger": "auto", "preTokens": 9, "postTokens": 3, "cumulativeDroppedTokens": 6, "durationMs": 1}},
        use(3, "Grep", {"pattern": "foo"}, "m2"), result(3, False, "", toolUseResult={"mode": "files", "numFiles": 4}), use(4, "Bash", {"command": "pytest"}, "m3"), result(4, True), use(5, "Bash", {"command": "rm x"}, "m4"), result(5, True, toolDenialKind="user"),
        {"type": "user", "sessionId": "s1", "uuid": "f1", "userFeedback": "not so"},
    ]
    root = tmp_path / "corpus"
    (root / "-proj" / "s1" / "subagents").mkdir(parents=True)
    (root / "-proj" / "s1.jsonl").write_text("﻿" + "\n".join(json.dumps(x, ensure_ascii=False) for x in lines) + "\n\nnot json\n[1]")
    (root / "-proj" / "s1" / "subagents" / "agent-q7.jsonl").write_text(json.dumps({"type": "user", "sessionId": "s1", "message": {"content": "sub"}}) + "\n")
    (root / "odd.jsonl").write_text("{}\n")
    return f"file:{root}"


def test_transcripts(spark, tree):
    decoded = transcripts.decode(transcripts.scan(spark, tree)).cache()
    found = transcripts.counters(decoded).collect()
    counts = {r.path.rsplit("/", 1)[-1]: (r.objects, r.empty, r.malformed) for r in found}
    assert counts["s1.jsonl"] == (13, 1, 2)
    root = found[0].path.split("/corpus/")[0] + "/corpus"
    events = transcripts.normalize(decoded, root).collect()
    main = sorted((e for e in events if e.agent_id == "main"), key=lambda e: e.seq)
    assert [e.kind for e in main] == [
        "prompt.submit", "model.context", "tool.use.start", "tool.use.start", "tool.use.end", "file.changed", "tool.use.end", "command.run", "check.run", "segment.start", "tool.use.start", "tool.use.end", "search.run",
        "tool.use.start", "tool.use.end", "command.run", "check.run", "tool.use.start", "tool.use.end", "command.run", "session.end",
    ]
    assert [e.batch for e in main if e.kind == "tool.use.start"] == [1, 1, 2, 3, 4] and main[-1].call == 5
    assert main[12].hits == 4 and main[8].verdict == "passed" and main[0].text == "please fix" and main[-1].segment == 1
    assert {e.agent_id for e in events} == {"main", "q7"}
    derived = transcripts.derive(decoded, root)
    kinds = sorted(r.id for r in derived.collect())
    assert kinds == ["derived:context_compaction:s1:c1", "derived:tool_denial:s1:t5", "derived:user_correction:s1:f1", "derived:verification_run:s1:t2", "derived:verification_run:s1:t4"]
    outcome = {r.id: r.outcome for r in transcripts.ingest(derived.limit(0), derived).collect()}
    assert set(outcome.values()) == {"written"}
    assert {r.outcome for r in transcripts.ingest(derived, derived).collect()} == {"present"}


def test_record_tree_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([("e1", "t", "2024-01-01T00:00:00.000Z"), ("e2", "t", "2024-01-02T00:00:00.000Z")], "id string, type_name string, recorded_at string")
    lines = records.to_lines(entries)
    path = f"file://{tmp_path}/tree"
    lines.select("kind", "line").coalesce(1).write.text(f"{path}/plain") if False else None
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "0001.jsonl").write_text("\n".join(r.line for r in lines.union(lines).collect()))
    assert [r.id for r in records.read_tree(spark, path).collect()] == ["e1", "e2"]
    assert records.entries_of(records.read_tree(spark, path)).count() == 2
    assert len(records.fingerprint(spark, path)) == 64
    (tmp_path / "tree" / "0002.jsonl").write_text('{"kind":"entry","id":"e1","recorded_at":"2025-01-01T00:00:00.000Z"}')
    with pytest.raises(records.StoreError):
        records.read_tree(spark, path)
    new = spark.createDataFrame([("entry", "e1", "{}"), ("annotation", "a1", '{"entry_id":"nope"}'), ("entry", "e9", "{}"), ("entry", "e9", "{}")], "kind string, id string, line string")
    assert sorted((r.id, r.fault) for r in records.import_faults(new, lines).collect()) == [("a1", "unknown entry"), ("e1", "taken"), ("e9", "twice")]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "place long, project string")
    labels = records.redaction_map(df, ["project"])
    assert labels == {"b": "project-1", "a": "project-2"}
    text = spark.createDataFrame([("key sk-abcdefghijklmnopqrst of alpha and alphabet",)], "t string")
    assert text.select(records.redact(text["t"], {"alpha": "p-1", "alphabet": "p-2"})).head()[0] == "key <secret> of p-1 and p-2"
    assert records.entry_difference({"a": 1, "b": "x"}, {"a": 2, "b": "project-1"}) == ["a"]


def test_queries_only_read(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert query(spark, "select id, id from three; -- end").columns == ["id", "id_2"]
    assert query(spark, "with x as (select 1 as a) select * from x").count() == 1
    for bad in ("drop view three", "select 1; select 2", "", "insert into three values (1)", "set a = 1"):
        with pytest.raises(QueryError):
            query(spark, bad)
    assert statement_count("select ';' /* ; */ -- ;\n; ;") == 1


def test_cursors():
    scope = cursor_scope("t", "a > 1")
    assert decode_cursor(encode_cursor("2024", "é 1", scope), scope) == ("2024", "é 1")
    for bad in ("x", "asc1:%7B"):
        with pytest.raises(QueryError):
            decode_cursor(bad, scope)
    with pytest.raises(QueryError):
        decode_cursor(encode_cursor("2024", "1", cursor_scope("t")), scope)


def test_csv_is_neutral(spark):
    df = spark.createDataFrame([("=1+1",), ("-5",), ("a",)], "x string")
    assert [r.x for r in neutral_csv(df).collect()] == ["'=1+1", "-5", "a"]
