"""Detectors: findings that no pattern expresses, as functions from lines to hits.

A detector has a rule, for what its findings say, and a function (lines, config) -> hits. ``lines`` are those of
files that are neither binary nor excluded, with ``prev_text``; hits keep their columns and add ``match`` (the text
found), ``line`` (its number) and ``title_of`` (the finding's title, or null for the rule's). Suppression, folding,
scores, routes and reports treat them like any rule's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.config import Config
from ..sources.rules import CONFIDENCES, Rule, validate
from . import entropy


@dataclass(frozen=True)
class Detector:
    rule: Rule
    hits: Callable[[DataFrame, Config], DataFrame]
    enabled: Callable[[Config], bool] = lambda cfg: True


def _entropy_hits(lines: DataFrame, cfg: Config) -> DataFrame:
    found = entropy.hits(lines, cfg.entropy.min_entropy, cfg.entropy.min_length, list(cfg.entropy.exclude_paths))
    at = F.when(F.col("new_line") > 0, F.col("new_line")).otherwise(F.col("old_line"))
    return found.withColumns({"line": at, "title_of": F.concat(F.lit("High-entropy value assigned to `"), "name", F.lit("`"))})


_registered: dict[str, Detector] = {}


def register(detector: Detector) -> None:
    """Add a detector, or replace the one whose rule has the same id."""
    _registered[validate(detector.rule).id] = detector


def unregister(rule_id: str) -> None:
    _registered.pop(rule_id, None)


def all_rules() -> list[Rule]:
    return [d.rule for d in _registered.values()]


def running(cfg: Config) -> list[Detector]:
    """The detectors that a configuration leaves on, in order of registration."""

    def on(d: Detector) -> bool:
        rid = d.rule.id
        chosen = (not cfg.only or rid in cfg.only) and not (rid in cfg.disable and rid not in cfg.enable)
        return chosen and d.enabled(cfg) and CONFIDENCES[d.rule.confidence][0] >= CONFIDENCES[cfg.min_confidence or "low"][0]

    return [d for d in _registered.values() if on(d)]


register(Detector(entropy.RULE, _entropy_hits, lambda cfg: cfg.entropy.enabled))
