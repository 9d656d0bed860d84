"""Path globs as patterns for rlike. Rule globs ignore case; code-owner globs do not."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\*\*/|\*\*|\*|\?|\{|\}|,|[^*?{},]+", re.S)


class GlobError(ValueError):
    """A glob that does not compile."""


def to_java(glob: str) -> str:
    """Anchored at both ends; a glob without a slash matches the name at any depth. ``{a,b}`` alternates."""
    glob = glob.removeprefix("./")
    out, depth = ["(?iu)(?d)^" + ("(?:.*/)?" if "/" not in glob else "")], 0
    plain = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    for token in _TOKEN.findall(glob):
        if token in plain:
            out.append(plain[token])
        elif token == "{":
            depth += 1
            out.append("(?:")
        elif token == "}":
            depth -= 1
            if depth < 0:
                raise GlobError(f"unbalanced }} in {glob!r}")
            out.append(")")
        elif token == "," and depth:
            out.append("|")
        else:
            out.append(_quoted(token))
    if depth:
        raise GlobError(f"unbalanced {{ in {glob!r}")
    return "".join(out) + "$"


def _quoted(text: str) -> str:
    return re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", text)


def compiled(globs: list[str]) -> list[str]:
    """Patterns of a list of globs; blank ones and negations are errors."""
    out = []
    for g in globs:
        g = g.strip()
        if not g or g.startswith("!"):
            raise GlobError(f"invalid glob {g!r}")
        out.append(to_java(g))
    return out


def any_of(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs; none match nothing."""
    found = compiled(globs)
    return path.rlike("|".join(f"(?:{p})" for p in found)) if found else F.lit(False)


def matches(glob: str, path: str) -> bool:
    """One glob and one path, on the driver."""
    return re.search(to_java(glob).removeprefix("(?iu)(?d)"), path, re.I) is not None


def owners_to_java(pattern: str) -> str:
    """A code-owners pattern: case counts, a slash before the end anchors at the root, and a pattern without a dot
    or with a slash at its end also covers what lies beneath."""
    inner = pattern.strip("/")
    if inner in ("", "*"):
        return "^.*$"
    anywhere = not pattern.startswith("/") and "/" not in inner
    plain = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(plain.get(t) or _quoted(t) for t in re.findall(r"\*\*|\*|\?|[^*?]+", inner))
    beneath = "(?:/.*)?" if pattern.endswith("/") or "." not in inner else ""
    return f"^{'(?:.*/)?' if anywhere else ''}{body}{beneath}$"
