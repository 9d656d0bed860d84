"""The command line: scan, baseline write, rules, init, version. Exit codes: 0 passed, 1 gate failed, 2 error."""

from __future__ import annotations

import argparse
import dataclasses
import datetime
import difflib
import json
import os
import shutil
import subprocess
import sys
from collections.abc import Callable

from . import __version__
from .functions import languages
from .sources import config, rules

STARTER = """version: 1
min_confidence: low
fail_on: critical
exclude_paths: []
rules:
  disable: []
entropy:
  enabled: true
review:
  default: []
  routes: []
"""


def _session():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("patchloom").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def built() -> tuple[str, str]:
    """The commit and its date that the library was packed from, or is checked out at; unknown where neither is known.

    A package says it in a file ``BUILD`` beside this one: two words.
    """
    here = os.path.dirname(os.path.abspath(__file__))
    try:
        with open(os.path.join(here, "BUILD"), encoding="utf-8") as f:
            said = f.read().split()
    except OSError:
        run = subprocess.run(["git", "-C", here, "log", "-1", "--format=%h %cs", "--", here], capture_output=True, text=True, timeout=20, check=False) if shutil.which("git") else None
        said = run.stdout.split() if run and not run.returncode else []
    return (said[0], said[1]) if len(said) == 2 else ("unknown", "unknown")


def _banner() -> str:
    import platform

    from pyspark import __version__ as engine

    commit, date = built()
    return f"patchloom {__version__} (commit {commit}, built {date}, Spark {engine}, Python {platform.python_version()})\n"


def _write(path: str, text: str) -> None:
    if path in ("", "-"):
        sys.stdout.write(text)
        return
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _config(a: argparse.Namespace) -> config.Config:
    """The configuration file with what flags say over it."""
    cfg = config.load(a.config, a.root)
    new: dict = {"only": (*cfg.only, *a.only), "disable": (*cfg.disable, *a.disable), "rule_paths": (*cfg.rule_paths, *a.rules)}
    if a.min_confidence:
        new["min_confidence"] = a.min_confidence
    if a.fail_on or a.fail_score:
        new["gate"] = dataclasses.replace(cfg.gate, **({"fail_on": a.fail_on} if a.fail_on else {}), **({"fail_score": a.fail_score} if a.fail_score else {}))
    if a.baseline:
        new["baseline"] = a.baseline
    owners = config.owners_file(a.root)
    if owners:
        from .operators.routing import parse_owners

        new["router"] = dataclasses.replace(cfg.router, owners=parse_owners(owners))
    return dataclasses.replace(cfg, **new)


def _analysis(a: argparse.Namespace):
    from .plans.analysis import analyse
    from .sources import baseline, patches

    cfg, spark = _config(a), _session()
    chosen = rules.default(list(cfg.rule_paths))
    note = (lambda text: None) if a.quiet else lambda text: print(f"patchloom: {text}", file=sys.stderr)
    for slow in chosen.warnings:
        note(slow)
    a.source = "standard input" if a.diff == "-" else a.diff
    if a.diff == "-":
        rows = patches.from_texts(spark, {"-": sys.stdin.read()})
    elif a.diff:
        with open(a.diff, encoding="utf-8", errors="replace", newline="") as f:
            rows = patches.from_texts(spark, {a.diff: f.read()})
    else:
        base = a.base or ("" if a.staged else patches.base_ref(a.root))
        a.source = patches.described(a.root, base, a.head, a.staged)
        rows = patches.from_git(spark, patches.repo_root(a.root), base, a.head, a.staged, a.context)
    note(f"{a.source}, {len(chosen)} rules")
    known = baseline.entries(spark, cfg.baseline) if cfg.baseline else None
    return analyse(rows, chosen, cfg, known), rows.first()["patch_id"], cfg, spark


def scan(a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from .plans import reports

    found, patch_id, cfg, _ = _analysis(a)
    if not found.scores.head(1):
        reason = found.rejected.first()
        if reason and reason["reason"] != "no file changes found":
            raise ValueError(reason["reason"])
        sys.stdout.write("no changes\n")
        return 0
    r = reports.collected(found, patch_id)
    contract = lambda: json.dumps(json.loads(reports.json_reports(found.findings, found.stats, found.category_scores, found.scores, {"source": a.source}).where(F.col("patch_id") == patch_id).first()["report"]), indent=2, ensure_ascii=False) + "\n"
    forms: dict[str, Callable[[], str]] = {"pretty": lambda: reports.pretty(r, a.color), "markdown": lambda: reports.markdown(r, cfg.router.mention, cfg.marker), "sarif": lambda: reports.sarif(r), "json": contract}
    _write(a.out, forms["markdown" if a.format == "md" else a.format]())
    for path, form in ((a.sarif_out, "sarif"), (a.markdown_out, "markdown"), (a.json_out, "json")):
        if path:
            _write(path, forms[form]())
    if a.ci_out:
        with open(a.ci_out, "a", encoding="utf-8") as f:
            f.write(reports.key_values(r))
    return int(r["score"]["gate_failed"])


def baseline_write(a: argparse.Namespace) -> int:
    from .sources import baseline

    target, a.baseline = a.out or a.baseline or ".patchloom-baseline.json", ""
    found, _, _, spark = _analysis(a)
    now = datetime.datetime.now(datetime.UTC)
    rows = baseline.merged(baseline.entries(spark, os.path.abspath(target)), found.findings, a.reason, now.strftime("%Y-%m-%d"))
    n = baseline.write(rows, target, now.strftime("%Y-%m-%dT%H:%M:%SZ"))
    sys.stdout.write(f"{target}: {n} entries\n")
    return 0


def rules_cmd(a: argparse.Namespace) -> int:
    if a.what == "languages":
        sys.stdout.write("\n".join(languages.KNOWN) + "\n")
        return 0
    if a.what == "categories":
        sys.stdout.write("\n".join(f"{k}\t{v}" for k, v in rules.CATEGORIES.items()) + "\n")
        return 0
    if a.what == "validate":
        own = rules.compile_set([p for path in a.names for p in rules.load_path(path)])
        shipped = rules.default().by_id
        sys.stdout.write(f"{len(own)} rules\n" + "".join(f"{i} overrides a built-in rule\n" for i in own.ids if i in shipped) + "".join(f"warning: {w}\n" for w in own.warnings))
        return 0
    known = rules.default(a.rules)
    if a.what == "show":
        for name in a.names:
            if name not in known.by_id:
                near = difflib.get_close_matches(name, known.by_id, 5, 0.5)
                raise rules.RuleError(f"no rule {name!r}" + (f"; similar: {', '.join(near)}" if near else ""))
            sys.stdout.write(json.dumps(dataclasses.asdict(known.by_id[name]), indent=2) + "\n")
            if name in known.overridden:
                sys.stdout.write(f"# from {' over '.join(reversed(known.overridden[name]))}\n")
        return 0
    rows = [r for r in known.rules if (not a.category or r.category == a.category) and (not a.severity or r.severity == a.severity)]
    if a.json:
        sys.stdout.write(json.dumps([dataclasses.asdict(r) for r in rows], indent=2) + "\n")
    elif a.what == "docs":
        for category, title in rules.CATEGORIES.items():
            part = [r for r in rows if r.category == category]
            if part:
                sys.stdout.write(f"## {title}\n\n| Rule | Severity | Confidence | On | Title |\n| --- | --- | --- | --- | --- |\n" + "".join(f"| `{r.id}` | {r.severity} | {r.confidence} | {r.trigger} | {r.title} |\n" for r in part) + "\n")
    else:
        sys.stdout.write("".join(f"{r.severity:<9} {r.confidence:<7} {r.trigger:<8} {r.id:<52} {r.title}\n" for r in rows) + f"{len(rows)} rules\n")
    return 0


def init(a: argparse.Namespace) -> int:
    path = os.path.join(a.root, config.NAMES[0])
    if os.path.exists(path) and not a.force:
        raise ValueError(f"{path} exists; --force overwrites it")
    _write(path, STARTER)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="patchloom", description="Risk of source changes, many patches at once.")
    sub = p.add_subparsers(dest="command", required=True)

    def shared(s: argparse.ArgumentParser) -> None:
        s.add_argument("--diff", default="")
        for flag in ("--base", "--head", "--config", "--baseline", "--min-confidence", "--fail-on", "--out"):
            s.add_argument(flag, default="")
        s.add_argument("--root", default=".")
        s.add_argument("--staged", action="store_true")
        s.add_argument("--quiet", action="store_true")
        s.add_argument("--context", type=int, default=5)
        s.add_argument("--fail-score", type=float, default=0)
        for flag in ("--only", "--disable", "--rules"):
            s.add_argument(flag, action="append", default=[])

    s = sub.add_parser("scan")
    shared(s)
    s.add_argument("--format", choices=["pretty", "markdown", "md", "sarif", "json"], default="pretty")
    for flag in ("--sarif-out", "--markdown-out", "--json-out", "--ci-out"):
        s.add_argument(flag, default="")
    s.add_argument("--color", action=argparse.BooleanOptionalAction, default=sys.stdout.isatty() and "NO_COLOR" not in os.environ or "FORCE_COLOR" in os.environ)
    s.set_defaults(run=scan)
    b = sub.add_parser("baseline")
    b.add_argument("action", choices=["write"])
    shared(b)
    b.add_argument("--reason", default="")
    b.set_defaults(run=baseline_write)
    r = sub.add_parser("rules")
    r.add_argument("what", choices=["list", "show", "validate", "docs", "languages", "categories"])
    r.add_argument("names", nargs="*")
    r.add_argument("--category", default="")
    r.add_argument("--severity", default="")
    r.add_argument("--json", action="store_true")
    r.add_argument("--rules", action="append", default=[])
    r.set_defaults(run=rules_cmd)
    i = sub.add_parser("init")
    i.add_argument("--root", default=".")
    i.add_argument("--force", action="store_true")
    i.set_defaults(run=init)
    sub.add_parser("version").set_defaults(run=lambda a: sys.stdout.write(_banner()) * 0)
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        return a.run(a)
    except (ValueError, OSError, RuntimeError) as e:
        sys.stderr.write(f"patchloom: {e}\n")
        return 2


if __name__ == "__main__":
    sys.exit(main())
