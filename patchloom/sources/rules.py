"""Rules and packs: the model, its validation, and how packs override each other."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields, replace
from importlib import resources
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import globs, languages, patterns
from . import yaml_subset

#: Ranks and weights, and the categories in display order with their titles.
SEVERITIES = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
CONFIDENCES = {"high": (3, 1.0), "medium": (2, 0.7), "low": (1, 0.45)}
CATEGORIES = {
    "spoofing": "Spoofing", "tampering": "Tampering", "repudiation": "Repudiation", "information-disclosure": "Information disclosure", "denial-of-service": "Denial of service",
    "elevation-of-privilege": "Elevation of privilege", "supply-chain": "Supply chain", "secrets": "Secrets exposure",
}
TRIGGERS, EVENTS = ("added", "removed", "any", "file"), ("created", "deleted", "renamed", "modified")
_ID = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


class RuleError(ValueError):
    """A rule or pack that does not compile."""


@dataclass(frozen=True)
class Near:
    present: tuple[str, ...] = ()
    absent: tuple[str, ...] = ()
    window: int = 5
    scope: str = "hunk"


@dataclass(frozen=True)
class Rule:
    """What to look for, where, and what to ask the reviewer."""

    id: str
    title: str = ""
    category: str = ""
    severity: str = ""
    confidence: str = "medium"
    on: str = ""
    languages: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    near: Near | None = None
    file_events: tuple[str, ...] = ()
    question: str = ""
    guidance: str = ""
    references: tuple[str, ...] = ()
    cwe: tuple[str, ...] = ()
    owasp: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    redact: bool = False
    enabled: bool = True
    pack: str = ""

    @property
    def trigger(self) -> str:
        return self.on or ("added" if self.patterns else "file")


_LISTS = {f.name for f in fields(Rule) if f.type.startswith("tuple")}


def _strings(value: Any, where: str) -> tuple[str, ...]:
    if value is None:
        return ()
    if not isinstance(value, list) or any(isinstance(v, list | dict) for v in value):
        raise RuleError(f"{where}: expected a list of texts")
    return tuple(str(v) for v in value)


def from_dict(raw: Any, pack: str = "") -> Rule:
    """A rule of a pack's mapping; fields that no rule has are errors."""
    if not isinstance(raw, dict):
        raise RuleError("empty rule entry")
    name = str(raw.get("id") or "")
    if unknown := set(raw) - {f.name for f in fields(Rule)} - {"pack"} | ({"pack"} & set(raw)):
        raise RuleError(f"rule {name!r}: unknown field {sorted(unknown)[0]!r}")
    out: dict[str, Any] = {"pack": pack}
    for key, value in raw.items():
        if key in _LISTS:
            out[key] = _strings(value, f"rule {name!r}, {key}")
        elif key == "near":
            if value is not None:
                if not isinstance(value, dict) or set(value) - {"present", "absent", "window", "scope"}:
                    raise RuleError(f"rule {name!r}: unknown field in near")
                window = value.get("window") or 0
                out[key] = Near(_strings(value.get("present"), "near"), _strings(value.get("absent"), "near"), window if window > 0 else 5, str(value.get("scope") or "hunk"))
        elif key in ("redact", "enabled"):
            out[key] = (key == "enabled") if value is None else bool(value)
        else:
            out[key] = "" if value is None else str(value)
    out["confidence"] = out.get("confidence") or "medium"
    out.setdefault("id", "")
    return Rule(**out)


def validate(r: Rule) -> Rule:
    """The rule itself, or RuleError with what is wrong first."""
    if not r.id:
        raise RuleError("rule is missing id")
    fail = lambda what: RuleError(f"rule {r.id!r}: {what}")
    if not _ID.fullmatch(r.id):
        raise fail("id must be lower-case letters and digits parted by . or -")
    if not r.title:
        raise fail("missing title")
    if r.severity not in SEVERITIES:
        raise fail(f"invalid severity {r.severity!r} (one of {', '.join(SEVERITIES)})")
    if r.confidence not in CONFIDENCES:
        raise fail(f"invalid confidence {r.confidence!r} (one of {', '.join(CONFIDENCES)})")
    if r.category not in CATEGORIES:
        raise fail(f"invalid category {r.category!r} (one of {', '.join(CATEGORIES)})")
    if r.trigger not in TRIGGERS:
        raise fail(f"invalid on {r.on!r} (one of {', '.join(TRIGGERS)})")
    if not r.question:
        raise fail("missing question")
    if not r.patterns and not r.paths:
        raise fail("needs patterns or paths")
    if not r.patterns and r.trigger != "file":
        raise fail(f"on {r.trigger} needs patterns")
    near = r.near or Near()
    if r.near and not (near.present or near.absent):
        raise fail("near needs present or absent")
    if near.scope not in ("hunk", "file"):
        raise fail("near.scope must be hunk or file")
    for where, found in (("patterns", r.patterns), ("exclude_patterns", r.exclude_patterns), ("near.present", near.present), ("near.absent", near.absent)):
        for k, p in enumerate(found):
            try:
                patterns.to_java(p)
            except patterns.PatternError as e:
                raise fail(f"{where}[{k}]: {e}") from None
    for where, found in (("paths", r.paths), ("exclude_paths", r.exclude_paths)):
        try:
            globs.compiled(list(found))
        except globs.GlobError as e:
            raise fail(f"{where}: {e}") from None
    for k in r.languages:
        if k.strip().lower() not in languages.KNOWN:
            raise fail(f"unknown language {k!r}")
    for k in r.file_events:
        if k.strip().lower() not in EVENTS:
            raise fail(f"unknown file event {k!r}")
    return r


@dataclass
class RuleSet:
    """Compiled rules: ``rules`` the enabled ones in order of severity and id; ``by_id`` all of them."""

    rules: list[Rule]
    by_id: dict[str, Rule]
    overridden: dict[str, list[str]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.rules)

    @property
    def ids(self) -> list[str]:
        return sorted(r.id for r in self.rules)

    def selected(self, only=(), disable=(), enable=(), severity=None, min_confidence: str = "") -> list[Rule]:
        """The rules that a configuration runs, with their severities overridden."""
        for rid, level in (severity or {}).items():
            if rid not in self.by_id:
                raise RuleError(f"severity override: no such rule {rid!r}")
            if level not in SEVERITIES:
                raise RuleError(f"severity override of {rid!r}: invalid severity {level!r}")
        off = set(disable) - set(enable)
        least = CONFIDENCES.get(min_confidence or "low", (1, 0))[0]
        chosen = [r for r in self.rules if (r.id in only if only else True) and r.id not in off and CONFIDENCES[r.confidence][0] >= least]
        return [replace(r, severity=(severity or {}).get(r.id, r.severity)) for r in chosen]


def slow_patterns(r: Rule) -> list[str]:
    """Patterns of a rule that a backtracking matcher may not finish in reasonable time."""
    near = r.near or Near()
    return [p for p in (*r.patterns, *r.exclude_patterns, *near.present, *near.absent) if patterns.nested_repetition(p)]


def compile_set(packs: list[list[Rule]]) -> RuleSet:
    """A later pack's rule replaces an earlier one of the same id."""
    by_id: dict[str, Rule] = {}
    overridden: dict[str, list[str]] = {}
    for pack in packs:
        for r in pack:
            validate(r)
            if r.id in by_id:
                overridden.setdefault(r.id, [by_id[r.id].pack]).append(r.pack)
            by_id[r.id] = replace(r, languages=tuple(k.strip().lower() for k in r.languages), file_events=tuple(k.strip().lower() for k in r.file_events))
    live = sorted((r for r in by_id.values() if r.enabled), key=lambda r: (-SEVERITIES[r.severity], r.id))
    slow = [f"rule {r.id!r}: nested repetition may take exponential time: {p}" for r in by_id.values() for p in slow_patterns(r)]
    return RuleSet(live, by_id, overridden, slow)


def parse_pack(text: str, name: str, is_json: bool = False) -> list[Rule]:
    """The rules of one pack file, YAML or JSON; a pack without rules or with unknown fields is an error."""
    raw = json.loads(text) if is_json else yaml_subset.load(text)
    if not isinstance(raw, dict) or set(raw) - {"version", "name", "description", "rules"}:
        raise RuleError(f"{name}: not a rule pack")
    if not raw.get("rules"):
        raise RuleError(f"{name}: the pack has no rules")
    return [from_dict(r, str(raw.get("name") or name)) for r in raw["rules"]]


def load_path(path: str) -> list[list[Rule]]:
    """The packs of a file, or of a folder's .yaml, .yml and .json files in order of their paths."""
    found = [path]
    if os.path.isdir(path):
        found = []
        for at, folders, names in os.walk(path):
            folders[:] = [f for f in folders if not f.startswith(".")]
            found += [os.path.join(at, n) for n in names if n.endswith((".yaml", ".yml", ".json"))]
        if not found:
            raise RuleError(f"{path}: no rule packs")
    out = []
    for f in sorted(found):
        with open(f, encoding="utf-8") as text:
            out.append(parse_pack(text.read(), os.path.splitext(os.path.basename(f))[0], f.endswith(".json")))
    return out


def builtin() -> list[list[Rule]]:
    """The packs that come with the library."""
    at = resources.files("patchloom") / "packs"
    return [parse_pack(f.read_text(encoding="utf-8"), f.name.removesuffix(".yaml")) for f in sorted(at.iterdir(), key=lambda f: f.name) if f.name.endswith(".yaml")]


def default(paths: list[str] = ()) -> RuleSet:
    """The built-in packs and then those of ``paths``."""
    return compile_set([*builtin(), *(pack for p in paths for pack in load_path(p))])


def to_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """One row per rule, in order: what reports need of it. As many rows as there are rules."""
    rows = [
        (k, r.id, r.title, r.category, r.severity, r.confidence, r.trigger, r.question.strip(), r.guidance.rstrip("\n"), list(r.cwe), list(r.owasp), list(r.references), list(r.tags), r.redact)
        for k, r in enumerate(rules)
    ]
    schema = (
        "rule_ord int, rule_id string, title string, category string, severity string, confidence string, trigger string, question string, guidance string, "
        "cwe array<string>, owasp array<string>, refs array<string>, tags array<string>, redact boolean"
    )
    return spark.createDataFrame(rows, schema)
