"""Configuration files: YAML or JSON, every field optional, unknown fields errors."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

from ..operators.routing import Route, Router
from ..operators.scoring import Gate, Weights
from . import yaml_subset

NAMES = [".patchloom.yaml", ".patchloom.yml", ".patchloom.json", "patchloom.yaml"]


class ConfigError(ValueError):
    """A configuration that cannot be used; the message names the field."""


@dataclass(frozen=True)
class Entropy:
    enabled: bool = True
    min_entropy: float = 3.6
    min_length: int = 20
    exclude_paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    min_confidence: str = ""
    gate: Gate = Gate()
    exclude_paths: tuple[str, ...] = ()
    rule_paths: tuple[str, ...] = ()
    baseline: str = ""
    disable: tuple[str, ...] = ()
    enable: tuple[str, ...] = ()
    only: tuple[str, ...] = ()
    severity: dict[str, str] = field(default_factory=dict)
    entropy: Entropy = Entropy()
    weights: Weights = Weights()
    router: Router = Router()
    marker: str = "patchloom:ignore"
    redact_across_rules: bool = True
    #: Characters of a line beyond which patterns with nested repetition are not tried; 0 tries them on every line.
    slow_pattern_line: int = 0


#: The fields of each section.
_FIELDS = {
    "": ["version", "min_confidence", "fail_on", "fail_score", "exclude_paths", "rule_paths", "baseline", "rules", "entropy", "scoring", "review", "limits"],
    "rules": ["disable", "enable", "only", "severity"],
    "entropy": ["enabled", "min_entropy", "min_length", "exclude_paths"],
    "scoring": ["base", "removal_multiplier", "saturation", "lead_scale", "blast_radius_weight", "bands"],
    "review": ["default", "routes", "mention"],
    "limits": ["slow_pattern_line"],
    "route": ["name", "categories", "rules", "paths", "min_severity", "reviewers"],
}


def _section(raw: dict, name: str) -> dict:
    part = raw if name == "" else raw.get(name) or {}
    if not isinstance(part, dict):
        raise ConfigError(f"{name}: expected a mapping")
    if unknown := set(part) - set(_FIELDS[name]):
        raise ConfigError(f"unknown field {(name + '.') * bool(name)}{sorted(unknown)[0]}")
    return part


def _texts(part: dict, key: str) -> tuple[str, ...]:
    value = part.get(key) or []
    if not isinstance(value, list):
        raise ConfigError(f"{key}: expected a list")
    return tuple(str(v) for v in value)


def _number(part: dict, key: str) -> float:
    value = part.get(key) or 0
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise ConfigError(f"{key}: expected a number")
    return float(value)


def from_dict(raw: Any) -> Config:
    raw = {} if raw is None else raw
    if not isinstance(raw, dict):
        raise ConfigError("expected a mapping")
    top, rules, ent, sco, rev, limits = (_section(raw, n) for n in ("", "rules", "entropy", "scoring", "review", "limits"))
    if top.get("version") not in (None, 0, 1):
        raise ConfigError(f"unsupported version {top['version']!r}")
    routes = []
    for r in rev.get("routes") or []:
        if not isinstance(r, dict) or set(r) - set(_FIELDS["route"]):
            raise ConfigError("unknown field in review.routes")
        routes.append(Route(_texts(r, "reviewers"), str(r.get("name") or ""), _texts(r, "categories"), _texts(r, "rules"), _texts(r, "paths"), str(r.get("min_severity") or "").strip().lower()))
    number = lambda part, key, default: _number(part, key) if _number(part, key) > 0 else default
    return Config(
        min_confidence=str(top.get("min_confidence") or "").strip().lower(), gate=Gate(str(top.get("fail_on") or "").strip().lower(), _number(top, "fail_score")),
        exclude_paths=_texts(top, "exclude_paths"), rule_paths=_texts(top, "rule_paths"), baseline=str(top.get("baseline") or ""),
        disable=_texts(rules, "disable"), enable=_texts(rules, "enable"), only=_texts(rules, "only"), severity={str(k): str(v).strip().lower() for k, v in (rules.get("severity") or {}).items()},
        entropy=Entropy(ent.get("enabled") is not False, number(ent, "min_entropy", 3.6), int(number(ent, "min_length", 20)), _texts(ent, "exclude_paths")),
        weights=Weights({k: float(v) for k, v in (sco.get("base") or {}).items()}, *(_number(sco, k) for k in ("removal_multiplier", "saturation", "lead_scale", "blast_radius_weight")), {k: float(v) for k, v in (sco.get("bands") or {}).items()}),
        router=Router(tuple(routes), (), _texts(rev, "default"), rev.get("mention") is not False), slow_pattern_line=int(_number(limits, "slow_pattern_line")),
    )


def load(path: str = "", root: str = ".") -> Config:
    """A configuration file, or the first of :data:`NAMES` under ``root``, or the defaults."""
    if not path:
        path = next((p for n in NAMES if os.path.isfile(p := os.path.join(root, n))), "")
        if not path:
            return Config()
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return from_dict(json.loads(text) if path.endswith(".json") else yaml_subset.load(text))


def owners_file(root: str = ".") -> str:
    """The text of the code-owners file of a repository, or nothing."""
    for place in (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS"):
        at = os.path.join(root, place)
        if os.path.isfile(at):
            with open(at, encoding="utf-8") as f:
                return f.read()
    return ""
