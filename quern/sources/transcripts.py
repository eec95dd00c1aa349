"""Transcript trees: which files, which lines, which events and entries they hold."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.shell import SEARCH_HEADS, check_run, exec_segments, read_verdict

# Temporary roots, and tools by their role.
EPHEMERAL_ROOTS = ("-tmp", "-private-tmp", "-var-tmp", "-private-var-tmp", "-var-folders", "-private-var-folders")
ROLES = {
    "Bash": "exec", "Read": "read", "Edit": "edit", "Write": "edit", "MultiEdit": "edit", "NotebookEdit": "edit", "Grep": "search", "Glob": "search", "Agent": "spawn",
    "Task": "spawn", "AskUserQuestion": "ask",
}
DERIVE_VERSION = 12


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, line_no, value): lines of all ``*.jsonl`` files, divided at line feeds only."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("wholetext", True).text(root)
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n").alias("parts"))
    return rows.select("path", F.posexplode("parts").alias("line_no", "value")).withColumn("line_no", F.col("line_no") + 1)


def known_files_skipped(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, mtime, size) that a former run did not see as they are now."""
    return files.join(known, ["path", "mtime", "size"], "left_anti")


def is_ephemeral(project: Column) -> Column:
    found = F.lit(False)
    for root in EPHEMERAL_ROOTS:
        found = found | (project == root) | project.startswith(root + "-")
    return found


def classify(path: Column, root: str) -> Column:
    """struct(kind, project, session, agent): session files lie in a project's folder, subagents' two folders below their session."""
    inner = F.substring(path, F.length(F.lit(root.rstrip("/") + "/")) + 1, F.length(path))
    parts = F.split(inner, "/")
    n, leaf = F.size(parts), F.element_at(parts, -1)
    session = F.when(n == 2, F.regexp_replace(leaf, r"\.jsonl$", "")).when(n == 4, parts[1])
    kind = F.when(n == 2, "session").when((n == 4) & (parts[2] == "subagents"), "subagent").otherwise("unclassified")
    agent = F.when(kind == "subagent", F.regexp_replace(leaf, r"^agent-|\.jsonl$", "")).otherwise("main")
    return F.struct(kind.alias("kind"), parts[0].alias("project"), session.alias("session"), agent.alias("agent"))


def project_relative(project: Column, cwd: Column) -> Column:
    """What a working directory is below its project's encoded root, or null."""
    encoded = F.regexp_replace(cwd, "[/.]", "-")
    return F.when(encoded == project, "").when(encoded.startswith(F.concat(project, F.lit("-"))), F.substring(cwd, F.length(project) + 2, F.length(cwd)))


def decode(lines: DataFrame) -> DataFrame:
    """``status`` of each line: object, empty, not_json or not_object; a byte-order mark is not content."""
    value = F.regexp_replace("value", "^\ufeff", "")
    parsed = F.try_parse_json(value)
    status = F.when(F.trim(value) == "", "empty").when(parsed.isNull(), "not_json").when(F.schema_of_variant(parsed).startswith("OBJECT"), "object").otherwise("not_object")
    return lines.withColumn("value", value).withColumn("status", status)


def counters(decoded: DataFrame) -> DataFrame:
    """(path, lines, objects, empty, malformed)."""
    return decoded.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(F.col("status") == "object").alias("objects"), F.count_if(F.col("status") == "empty").alias("empty"), F.count_if(F.col("status").isin("not_json", "not_object")).alias("malformed"))


def blocks(record: dict) -> list[dict]:
    content = (record.get("message") or {}).get("content") if isinstance(record.get("message"), dict) else None
    return [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []


def result_text(content) -> str:
    if isinstance(content, str):
        return content
    return "\n".join(b["text"] for b in content or [] if isinstance(b, dict) and isinstance(b.get("text"), str)) if isinstance(content, list) else ""


def prompt_text(record: dict) -> str | None:
    """The user's own prose of a record."""
    message = record.get("message")
    if record.get("type") != "user" or record.get("isMeta") is True or not isinstance(message, dict):
        return None
    content = message.get("content")
    if isinstance(content, str):
        return None if content.lstrip().startswith("<task-notification>") else content or None
    found = blocks(record)
    if any(b.get("type") == "tool_result" for b in found):
        return None
    return "\n".join(b["text"] for b in found if b.get("type") == "text" and b.get("text")) or None


def hits_of(tool: str, command: str, result: dict | None, is_error: bool | None) -> int | None:
    """How much a search found; none without an output that says so."""
    if tool in ("Grep", "Glob"):
        if result is None:
            return None
        if isinstance(result.get("numFiles"), int) and result.get("mode") != "content":
            return result["numFiles"]
        if isinstance(result.get("numLines"), int):
            return result["numLines"]
        if isinstance(result.get("filenames"), list):
            return len(result["filenames"])
        content = result.get("content")
        return len(content.strip().split("\n")) if isinstance(content, str) and content.strip() else 0 if isinstance(content, str) else None
    lines = [x for x in str((result or {}).get("stdout") or "").split("\n") if x.strip()]
    if re.search(r"(^|\s)-c(\s|$)|--count", command):
        tails = [x.rsplit(":", 1)[-1].strip() for x in lines]
        return sum(int(x) for x in tails if x.isdigit())
    return len(lines)


class Normalizer:
    """Events of one transcript file, in order."""

    def __init__(self, session: str, agent: str):
        self.session, self.agent = session, agent
        self.seq = self.calls = self.batches = self.segment = 0
        self.pending: dict[str, dict] = {}
        self.message = self.model = self.ts = None
        self.out: list[dict] = []

    def emit(self, kind: str, call: int, batch: int | None, **fields) -> None:
        self.out.append({"kind": kind, "session_id": self.session, "agent_id": self.agent, "seq": self.seq, "call": call, "batch": batch, "ts": self.ts, "derive_version": DERIVE_VERSION, "segment": self.segment, **fields})
        self.seq += 1

    def accept(self, record: dict) -> None:
        self.ts = record.get("timestamp") or self.ts
        message = record["message"] if isinstance(record.get("message"), dict) else {}
        if isinstance(record.get("compactMetadata"), dict):
            self.segment += 1
            self.emit("segment.start", self.calls, None, index=self.segment, text=record["compactMetadata"].get("trigger"))
        text = prompt_text(record)
        if text:
            self.emit("prompt.submit", self.calls, None, text=text)
        attachment = record.get("attachment")
        if isinstance(attachment, dict) and attachment.get("type") == "hook_success":
            content = str(attachment.get("content") or "").encode()
            self.emit("hook.delivery", self.calls, None, head=attachment.get("hookEvent"), hits=len(content), text=hashlib.sha256(content).hexdigest())
        model = message.get("model")
        if record.get("type") == "assistant" and model and model != "<synthetic>" and model != self.model:
            self.emit("model.context", self.calls, None, text=model, before=self.model)
            self.model = model
        for b in blocks(record):
            if b.get("type") == "tool_use" and b.get("id"):
                self.calls += 1
                if message.get("id") != self.message or not self.batches:
                    self.batches, self.message = self.batches + 1, message.get("id")
                self.pending[b["id"]] = {"tool": b.get("name"), "input": b.get("input") if isinstance(b.get("input"), dict) else {}, "call": self.calls, "batch": self.batches}
                self.emit("tool.use.start", self.calls, self.batches, id=b["id"], tool=b.get("name"), role=ROLES.get(b.get("name"), "other"))
        results = [b for b in blocks(record) if b.get("type") == "tool_result"]
        whole = record.get("toolUseResult") if len(results) == 1 and isinstance(record.get("toolUseResult"), dict) else None
        for b in results:
            start = self.pending.pop(b.get("tool_use_id"), None)
            if start:
                self.result(b, start, whole)

    def result(self, block: dict, start: dict, whole: dict | None) -> None:
        tool, given, call, batch = start["tool"], start["input"], start["call"], start["batch"]
        error = block.get("is_error") if isinstance(block.get("is_error"), bool) else None
        role, key = ROLES.get(tool, "other"), block["tool_use_id"]
        self.emit("tool.use.end", call, batch, id=key, tool=tool, role=role, is_error=error)
        if tool == "Bash":
            command = str(given.get("command") or "")
            segments = exec_segments(command)
            for i, argv in enumerate(segments):
                self.emit("command.run", call, batch, id=key, head=argv[0], argv=argv, index=i, is_error=error)
                if argv[0] in SEARCH_HEADS and len(segments) <= 3:
                    self.emit("search.run", call, batch, id=key, tool=argv[0], pattern=" ".join(argv[1:]), hits=hits_of(tool, command, whole, error))
            check = check_run(command)
            if check:
                said = read_verdict(check.exit_status, error, result_text(block.get("content")))
                self.emit("check.run", call, batch, id=key, runner=check.runner, verdict=said[0] if said else None, verdict_source=said[1] if said else None, argv=check.paths or None)
        elif role == "search":
            self.emit("search.run", call, batch, id=key, tool=tool, pattern=given.get("pattern"), hits=hits_of(tool, "", whole, error))
        elif role == "read":
            self.emit("file.read", call, batch, id=key, tool=tool, path=given.get("file_path"))
        elif role == "edit" and error is not True:
            for edit in given["edits"] if isinstance(given.get("edits"), list) else [given]:
                after = next((edit[k] for k in ("new_string", "content", "new_source") if edit.get(k) is not None), "")
                self.emit("file.changed", call, batch, id=key, tool=tool, path=given.get("file_path") or given.get("notebook_path"), before=edit.get("old_string") or "", after=after)
        elif role == "spawn":
            launched = bool(whole and (whole.get("isAsync") is True or whole.get("status") == "async_launched"))
            self.emit("agent.spawn", call, batch, id=key, child=(whole or {}).get("agentId"), text=given.get("description"))
            if whole is not None and not launched:
                self.emit("agent.return", call, batch, id=key, child=whole.get("agentId"), text="failed" if error else whole.get("status") or "completed", hits=whole.get("totalTokens"))

    def finish(self) -> list[dict]:
        self.emit("session.end", self.calls, None)
        return self.out


EVENT_SCHEMA = "kind string, session_id string, agent_id string, seq long, call long, batch long, ts string, derive_version int, segment int, id string, tool string, role string, is_error boolean, text string, head string, argv array<string>, index int, pattern string, hits long, path string, before string, after string, runner string, verdict string, verdict_source string, child string"
EVENT_COLUMNS = [part.split()[0] for part in EVENT_SCHEMA.split(", ")]


def _records(frame: pd.DataFrame) -> Iterator[dict]:
    for value in frame.sort_values("line_no")["value"]:
        yield json.loads(value)


def normalize(decoded: DataFrame, root: str) -> DataFrame:
    """The event stream of every session and subagent file; a file is one stream and one group."""
    rows = decoded.filter("status = 'object'").withColumn("file", classify(F.col("path"), root)).filter("file.kind <> 'unclassified'")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        machine = Normalizer(frame["session"].iloc[0], frame["agent"].iloc[0])
        for record in _records(frame):
            machine.accept(record)
        return pd.DataFrame([{c: e.get(c) for c in EVENT_COLUMNS} for e in machine.finish()], columns=EVENT_COLUMNS).astype(object)

    return rows.select("path", "line_no", "value", "file.session", "file.agent").groupBy("path").applyInPandas(one, EVENT_SCHEMA)


class Deriver:
    """Typed entries of one transcript file."""

    def __init__(self, project: str):
        self.project, self.names, self.commands, self.verdict, self.skill = project, {}, {}, None, None
        self.out: list[dict] = []

    def emit(self, kind: str, key: str, record: dict, properties: dict, evidence: str | None = None) -> None:
        known = {k: v for k, v in properties.items() if v is not None}
        self.out.append({"id": f"derived:{kind}:{key}", "type_name": kind, "session_id": record.get("sessionId"), "project": self.project, "occurred_at": record.get("timestamp"), "properties_json": json.dumps(known, sort_keys=True), "evidence_text": evidence})

    def accept(self, record: dict) -> None:
        session, uuid, found = record.get("sessionId"), record.get("uuid"), blocks(record)
        for b in found:
            if b.get("type") == "tool_use":
                given = b.get("input") if isinstance(b.get("input"), dict) else {}
                self.names[b.get("id")], self.commands[b.get("id")] = b.get("name"), str(given.get("command") or "") if b.get("name") == "Bash" else None
                if b.get("name") == "Skill" and session and given.get("skill"):
                    self.skill = given["skill"]
                    self.emit("skill_activation", f"{session}:{b['id']}", record, {"skill": given["skill"]})
        used = [b.get("tool_use_id") for b in found if b.get("type") == "tool_result"]
        one = used[0] if len(used) == 1 else None
        if record.get("toolDenialKind") and session and one:
            self.emit("tool_denial", f"{session}:{one}", record, {"denial_kind": record["toolDenialKind"], "tool_use_id": one, "tool_name": self.names.get(one)})
        meta = record.get("compactMetadata")
        if isinstance(meta, dict) and session and uuid:
            values = {"trigger": meta.get("trigger"), "pre_tokens": meta.get("preTokens"), "post_tokens": meta.get("postTokens"), "cumulative_dropped_tokens": meta.get("cumulativeDroppedTokens"), "duration_ms": meta.get("durationMs")}
            if all(v is not None for v in values.values()):
                self.emit("context_compaction", f"{session}:{uuid}", record, values)
        attributed = record.get("attributionSkill")
        if attributed and attributed != self.skill and session and uuid:
            self.emit("skill_activation", f"{session}:{uuid}", record, {"skill": attributed, "agent": record.get("attributionAgent")})
        if record.get("type") == "assistant":
            self.skill = attributed or self.skill
        for b in found:
            if b.get("type") == "tool_result" and self.commands.get(b.get("tool_use_id")):
                self.check(b, record)
        if record.get("userFeedback") and session and uuid:
            self.emit("user_correction", f"{session}:{uuid}", record, {"tool_name": self.names.get(one)}, record["userFeedback"])

    def check(self, block: dict, record: dict) -> None:
        run = check_run(self.commands[block["tool_use_id"]])
        said = run and read_verdict(run.exit_status, block.get("is_error"), result_text(block.get("content")))
        if not said or not record.get("sessionId"):
            return
        before, self.verdict = self.verdict, said[0]
        if (before is None and said[0] == "passed") or (before is not None and before != said[0]):
            self.emit("verification_run", f"{record['sessionId']}:{block['tool_use_id']}", record, {"runner": run.runner, "verdict": said[0], "verdict_source": said[1], "previous_verdict": before})


ENTRY_SCHEMA = "id string, type_name string, session_id string, project string, occurred_at string, properties_json string, evidence_text string"


def derive(decoded: DataFrame, root: str) -> DataFrame:
    """Entries with ids that do not change between runs."""
    rows = decoded.filter("status = 'object'").withColumn("file", classify(F.col("path"), root)).filter("file.kind <> 'unclassified'")
    columns = [part.split()[0] for part in ENTRY_SCHEMA.split(", ")]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        machine = Deriver(frame["project"].iloc[0])
        for record in _records(frame):
            machine.accept(record)
        return pd.DataFrame(machine.out, columns=columns).astype(object)

    return rows.select("path", "line_no", "value", "file.project").groupBy("path").applyInPandas(one, ENTRY_SCHEMA)


def ingest(existing: DataFrame, derived: DataFrame) -> DataFrame:
    """(id, outcome) of derived entries against the stored ones: written, present or collided."""
    content = lambda df: df.select("id", F.sha2(F.concat_ws("\0", "type_name", "properties_json", F.coalesce("evidence_text", F.lit(""))), 256).alias("h"))
    old, new = content(existing).withColumnRenamed("h", "old"), content(derived)
    outcome = F.when(F.col("old").isNull(), "written").when(F.col("old") == F.col("h"), "present").otherwise("collided")
    return new.join(old, "id", "left").select("id", outcome.alias("outcome"))
