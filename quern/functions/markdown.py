"""Tables and headings of markdown texts."""

from __future__ import annotations

import re

MOST_TEXT = 100_000
RULE = re.compile(r"\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?")


def column_name(cell: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", cell.lower()).strip("_")


def split_row(line: str) -> list[str]:
    """Cells of a table line; an escaped bar belongs to its cell."""
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    parts = re.split(r"(?<!\\)\|", line)
    if len(parts) > 1 and not parts[-1].strip():
        parts.pop()
    return [p.strip().replace("\\|", "|") for p in parts]


def tables(text: str) -> list[tuple[list[str], list[list[str]]]]:
    """(header names, rows) of every table, in order."""
    out: list[tuple[list[str], list[list[str]]]] = []
    inside = False
    held = ""
    for line in text[:MOST_TEXT].split("\n"):
        line = line.strip()
        if inside and line.startswith("|"):
            out[-1][1].append(split_row(line))
            held = ""
            continue
        inside = bool(held.startswith("|") and RULE.fullmatch(line))
        if inside:
            out.append(([column_name(c) for c in split_row(held)], []))
        held = line
    return out


def sections(text: str) -> dict[str, str]:
    """Body by heading."""
    out: dict[str, str] = {}
    at = None
    for line in text[:MOST_TEXT].split("\n"):
        m = re.match(r"#{1,6}\s+(.*?)\s*#*$", line)
        if m:
            at = m[1]
            out[at] = ""
        elif at is not None:
            out[at] += line + "\n"
    return {k: v.strip() for k, v in out.items()}
