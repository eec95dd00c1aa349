"""Entry types as data: properties, names, identity, and how one version differs from the next."""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from dataclasses import dataclass, field
from typing import Any

#: The closed set of property types, and the columns of every entry.
PROPERTY_TYPES = ("string", "number", "integer", "boolean", "enum", "timestamp", "duration", "ref", "text", "json")
ENVELOPE = (
    "id", "type_name", "type_version", "type_hash", "recorded_at", "run_id", "workflow", "actor", "source", "cwd", "repo", "git_sha", "branch",
    "evidence_text", "writer_version", "schema_version",
)
STATES = ("measured", "not_applicable", "not_measured", "not_declared")
UNIT_TYPES = ("number", "integer", "duration")

SPARK_TYPES = {
    "string": "string", "number": "double", "integer": "bigint", "boolean": "boolean", "enum": "string", "timestamp": "string", "duration": "double", "ref": "string",
    "text": "string", "json": "string",
}
#: What a profile shows of a property of each type.
SUMMARIES = {
    "string": "top", "boolean": "top", "enum": "top", "ref": "top", "number": "range", "integer": "range", "timestamp": "range", "duration": "range", "text": "cardinality",
    "json": "cardinality",
}


class SpecError(ValueError):
    """A type that cannot be registered."""


@dataclass(frozen=True)
class Property:
    name: str
    type: str
    required: bool = False
    enum_values: tuple[str, ...] = ()
    unit: str | None = None
    description: str | None = None


@dataclass(frozen=True)
class TypeSpec:
    name: str
    properties: tuple[Property, ...] = ()
    description: str | None = None
    version: int = 1
    major: int = 1
    labels: dict[str, str] = field(default_factory=dict, hash=False, compare=False)

    def __getitem__(self, name: str) -> Property:
        return next(p for p in self.properties if p.name == name)


def canonical_name(text: str) -> str:
    """Composed, lower-case words joined by underscores; humps divide words."""
    text = unicodedata.normalize("NFC", text)
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
    return re.sub(r"[\W_]+", "_", text).strip("_").lower()


def canonical_json(value: Any) -> str:
    """JSON with keys in order and whole numbers without a fraction, equal for equal values."""
    if value is None or isinstance(value, bool | str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int | float):
        if isinstance(value, float):
            if not math.isfinite(value):
                raise SpecError("only finite numbers have a canonical form")
            return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
        return str(value)
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in keys) + "}"
    return "[" + ",".join(map(canonical_json, value)) + "]"


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def definition_shape(spec: TypeSpec) -> dict:
    """What counts for a type's identity; prose does not."""
    shapes = []
    for p in spec.properties:
        shape: dict[str, Any] = {"name": p.name, "type": p.type, "required": p.required}
        if p.enum_values:
            shape["enum_values"] = list(p.enum_values)
        if p.unit is not None:
            shape["unit"] = p.unit
        shapes.append(shape)
    return {"name": spec.name, "properties": shapes}


def type_hash(spec: TypeSpec) -> str:
    return sha256_hex(canonical_json(definition_shape(spec)))


def check_spec(spec: TypeSpec) -> None:
    """Refuses names that views could not carry and properties that no value could satisfy."""
    seen: set[str] = set()
    for p in spec.properties:
        name = canonical_name(p.name)
        if not name or not re.fullmatch(r"[^\W\d]\w*", name):
            raise SpecError(f"{p.name!r} is not a usable property name")
        if name in ENVELOPE or name.endswith("_state") or name == "invalidated":
            raise SpecError(f"{name!r} is reserved")
        if name in seen:
            raise SpecError(f"{name!r} is declared twice")
        if p.type not in PROPERTY_TYPES:
            raise SpecError(f"{p.type!r} is not a property type")
        if p.type == "enum" and not p.enum_values:
            raise SpecError(f"{name!r} allows no value")
        if p.unit is not None and p.type not in UNIT_TYPES:
            raise SpecError(f"{name!r} of type {p.type} cannot have a unit")
        seen.add(name)


@dataclass(frozen=True)
class Change:
    kind: str
    property: str
    level: str


LEVELS = ("none", "minor", "major")


def diff_specs(old: TypeSpec, new: TypeSpec) -> list[Change]:
    """The changes from one definition to the next, each with the version step it asks for."""
    before, after = {p.name: p for p in old.properties}, {p.name: p for p in new.properties}
    out = [Change("removed", n, "major") for n in before if n not in after]
    out += [Change("added", n, "major" if p.required else "minor") for n, p in after.items() if n not in before]
    for name in (n for n in before if n in after):
        a, b = before[name], after[name]
        if a.type != b.type:
            out.append(Change("retyped", name, "major"))
        if a.required != b.required:
            out.append(Change("became_required", name, "major") if b.required else Change("became_optional", name, "minor"))
        if a.unit != b.unit:
            out.append(Change("unit_changed", name, "major"))
        out += [Change("enum_value_removed", name, "major")] * bool(set(a.enum_values) - set(b.enum_values))
        out += [Change("enum_value_added", name, "minor")] * bool(set(b.enum_values) - set(a.enum_values))
        if a.description != b.description:
            out.append(Change("metadata", name, "none"))
    return out


def step_of(changes: list[Change]) -> str:
    return max((c.level for c in changes), key=LEVELS.index, default="none")


class Registry:
    """All versions of all types. Small by nature, so it lives on the driver."""

    def __init__(self) -> None:
        self.versions: dict[str, list[TypeSpec]] = {}

    def register(self, spec: TypeSpec) -> tuple[TypeSpec, str]:
        """The registered version and what happened: created, unchanged, minor or major. A definition seen before is unchanged."""
        check_spec(spec)
        spec = TypeSpec(canonical_name(spec.name), tuple(Property(canonical_name(p.name), *list(p.__dict__.values())[1:]) for p in spec.properties), spec.description)
        known = self.versions.setdefault(spec.name, [])
        for version in known:
            if type_hash(version) == type_hash(spec):
                return version, "unchanged"
        if not known:
            known.append(spec)
            return spec, "created"
        step = step_of(diff_specs(known[-1], spec))
        made = TypeSpec(spec.name, spec.properties, spec.description or known[-1].description, known[-1].version + 1, known[-1].major + (step == "major"))
        known.append(made)
        return made, step

    def family(self, name: str, major: int) -> list[TypeSpec]:
        return [v for v in self.versions[name] if v.major == major]


def name_tokens(name: str) -> frozenset[str]:
    return frozenset(canonical_name(name).split("_")) - {""}


def confusable_names(names: list[str]) -> list[tuple[str, str, tuple[str, ...]]]:
    """Pairs of names that share a word, with the shared words."""
    ordered = sorted(set(names))
    pairs = ((a, b, tuple(sorted(name_tokens(a) & name_tokens(b)))) for i, a in enumerate(ordered) for b in ordered[i + 1 :])
    return [(a, b, shared) for a, b, shared in pairs if shared]
