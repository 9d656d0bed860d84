"""Text functions of findings: fingerprints, masking, entropy and suppression notes."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\p{IsWhite_Space}]"
MARKER = "patchloom:ignore"


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is computed once for a row however often ``f`` names it, in lambdas too."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def trimmed(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, rf"^{WHITE}+|{WHITE}+$", "")


def normalised(x: Column) -> Column:
    """Trimmed, with every run of white space as one space."""
    return F.regexp_replace(trimmed(x), rf"{WHITE}+", " ")


def fingerprint(rule_id: Column, path: Column, text: Column) -> Column:
    """The first 16 hex digits of SHA-256 over rule, path and normalised text, parted by NUL."""
    return F.substring(F.sha2(F.concat(rule_id, F.lit("\0"), path, F.lit("\0"), normalised(text)), 256), 1, 16)


def masked(secret: Column) -> Column:
    """A secret's first characters and how many were taken out."""
    n = F.octet_length(secret)
    return (
        F.when(n <= 6, F.lit("[redacted]"))
        .when(n <= 16, F.concat(F.substring(secret, 1, 3), F.lit("[redacted]")))
        .otherwise(F.concat(F.substring(secret, 1, 4), F.lit("[redacted "), (n - 4).cast("string"), F.lit(" chars]")))
    )


def redacted(line: Column, secret: Column) -> Column:
    """The line with every occurrence of the secret masked; all of it if the secret is short or not in it."""
    secret = trimmed(secret)
    whole = (F.octet_length(secret) < 4) | ~F.contains(line, secret)
    return F.when(whole, masked(line)).otherwise(F.replace(line, secret, masked(secret)))


def redacted_all(line: Column, secrets: Column) -> Column:
    """The line with every occurrence of each secret masked, longest first; all of it if one is short or not in it."""
    longest_first = F.array_sort(F.transform(secrets, trimmed), lambda a, b: F.length(b) - F.length(a))

    def shown(line: Column, secrets: Column) -> Column:
        whole = F.exists(secrets, lambda s: (F.octet_length(s) < 4) | ~F.contains(line, s))
        return F.when(whole, masked(line)).otherwise(F.aggregate(secrets, line, lambda text, s: F.replace(text, s, masked(s))))

    return once(longest_first, lambda found: once(line, lambda x: shown(x, found)))


def truncated(x: Column, most: int = 200) -> Column:
    """At most ``most`` bytes, cut between characters, with dots after a cut."""

    def cut(x: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(most), F.lit(max(most // 4 - 1, 0)), F.lit(-1)), lambda n: F.octet_length(F.substring(x, F.lit(1), n)) <= most)
        plain = F.octet_length(F.substring(x, 1, most)) <= most  # as many characters as bytes
        return F.when(F.octet_length(x) <= most, x).otherwise(F.concat(F.when(plain, F.substring(x, 1, most)).otherwise(F.substring(x, F.lit(1), F.get(fits, F.lit(0)))), F.lit("...")))

    return once(x, cut)


def displayed(text: Column, secrets: Column, redact: Column) -> Column:
    """Trimmed, with all secrets masked if asked for, and cut."""
    return once(trimmed(text), lambda x: truncated(F.when(redact, redacted_all(x, secrets)).otherwise(x)))


def cleaned_section(x: Column) -> Column:
    x = trimmed(x)
    return F.when(F.octet_length(x) > 80, F.concat(F.substring(x, 1, 77), F.lit("..."))).otherwise(x)


def entropy(x: Column) -> Column:
    """Shannon entropy in bits over the bytes of a text; 0 for an empty one."""
    hexed = F.hex(F.encode(x, "UTF-8"))
    n = F.octet_length(x)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.substring(hexed, k * 2 + 1, F.lit(2)))
    counts = F.transform(F.array_distinct(pairs), lambda b: F.size(F.filter(pairs, lambda p: p == b)) / n)
    return F.when(n > 0, F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(0.0)


def mixed(x: Column) -> Column:
    """Three kinds of characters at least (lower, upper, digit, other), or two in 32 bytes."""
    kinds = functools.reduce(lambda a, b: a + b, (x.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^a-zA-Z0-9]")))
    return (kinds >= 3) | ((kinds >= 2) & (F.octet_length(x) >= 32))


_CLOSERS = ["*/", "-->", "#}", "--}}", "}}", "]]"]


def suppression(text: Column, marker: str = MARKER) -> Column:
    """The note on a line: struct(ids, reason), or null where there is none or its bracket is not closed.

    Forms after the marker: ``[ids] reason``, ``ids -- reason``, ``id reason`` and ``reason``; without ids it
    holds for every rule. What closes a comment after the reason is left out.
    """
    quoted = "".join("\\" + c if not c.isalnum() else c for c in marker)
    rest = trimmed(F.regexp_extract(text, f"(?s){quoted}(.*)$", 1))
    bracket, closed = rest.startswith("["), F.contains(rest, F.lit("]"))
    dashes = F.contains(rest, F.lit("--"))
    head = trimmed(F.substring_index(rest, "--", 1))
    first = F.substring_index(head, " ", 1)
    is_id = first.rlike(r"^[a-z0-9._*,\-]+$") & first.rlike(r"[.\-]")
    ids = F.when(bracket, F.regexp_extract(rest, r"(?s)^\[([^\]]*)\]", 1)).when(dashes, head).when(is_id, first).otherwise("")
    after = lambda n: trimmed(F.substring(rest, n, F.lit(1 << 30)))
    tail = F.when(bracket, F.regexp_extract(rest, r"(?s)^\[[^\]]*\](.*)$", 1)).when(dashes, after(F.instr(rest, "--") + 2)).when(is_id, F.substring(head, F.length(first) + 1, F.lit(1 << 30))).otherwise(head)
    reason = trimmed(F.regexp_replace(trimmed(tail), r"^[:\-]+", ""))
    ended = reason
    for closer in reversed(_CLOSERS):
        ended = F.when(reason.endswith(closer), trimmed(F.substring(reason, F.lit(1), F.length(reason) - len(closer)))).otherwise(ended)
    listed = F.filter(F.split(ids, "[, ]"), lambda i: i != "")
    return F.when(F.contains(text, F.lit(marker)) & ~(bracket & ~closed), F.struct(listed.alias("ids"), (ids == "").alias("every"), ended.alias("reason")))


def suppresses(note: Column, rule_id: Column) -> Column:
    """Whether a note holds for a rule: it names it, or a prefix of it before a star, or nothing at all."""
    named = F.exists(note["ids"], lambda i: (i == rule_id) | (i.endswith("*") & rule_id.startswith(F.regexp_replace(i, r"\*$", ""))))
    return F.coalesce(note["every"] | named, F.lit(False))
