"""Literals that a pattern cannot match without, read from its syntax tree.

Most lines hold none of a rule's literals, and to look for a literal costs far less than to try a pattern. A pattern
gives a set of lower-case ASCII strings of which every text that it matches holds at least one once
:func:`searchable` has folded it. Where a pattern has none, or is written in a way this reader does not know, it gives nothing, and is always tried.
"""

from __future__ import annotations

import re
import warnings
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings of one set, and characters of one string, at most.
MOST, LONGEST = 128, 24
#: Single characters that are rare enough in a line to be looked for.
_RARE = frozenset("@$|<>{}%^~`\\!&#")
#: Up to so many literals are looked for one by one, more by an automaton.
FEW = 32
#: The characters beyond ASCII that case-insensitive matching takes for an ASCII letter.
_ALSO = {"İ": "i", "ı": "i", "ſ": "s", "K": "k"}


def searchable(text: Column) -> Column:
    """``text`` as literals are looked for in it."""
    every = F.lower(F.translate(text, "".join(_ALSO), "".join(_ALSO.values())))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(every)  # ASCII has none of them


def folded(text: str) -> str:
    """The same of a plain string."""
    return text.translate(str.maketrans(_ALSO)).lower()


def _plain(pattern: str) -> str:
    """The pattern for the standard library's reader: flags go, and classes that it does not know match anything."""
    pattern = re.sub(r"\(\?[imsU-]+\)", "", pattern)
    pattern = re.sub(r"\(\?[imsU-]+:", "(?:", pattern).replace("(?<", "(?P<").replace(r"\z", r"\Z")
    return re.sub(r"\[:\^?\w+:\]|\\[pP](?:\{\^?\w+\}|\w)|\\x\{\w+\}", r"\\W", pattern)


class _Reader:
    def __init__(self):
        from re import _constants as C

        self.c = C

    def exact(self, nodes) -> set[str] | None:
        """All strings that a sequence matches, if they are few and made of ASCII; places count as nothing."""
        out = {""}
        for op, arg in nodes:
            got = self._one(op, arg)
            if got is None or len(got) * len(out) > MOST:
                return None
            out = {a + b for a in out for b in got}
            if max(map(len, out)) > LONGEST:
                return None
        return out

    def _one(self, op, arg) -> set[str] | None:
        C = self.c
        if op is C.AT:
            return {""}
        if op is C.LITERAL:
            return {chr(arg).lower()} if arg < 128 else None
        if op is C.SUBPATTERN:
            return self.exact(arg[3])
        if op is C.BRANCH:
            parts = [self.exact(b) for b in arg[1]]
            return None if any(p is None for p in parts) or sum(map(len, parts)) > MOST else set().union(*parts)
        if op is C.IN:
            return self._set(arg)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, sub = arg
            if high is C.MAXREPEAT or high > 3:
                return None
            one = self.exact(sub)
            if one is None or len(one) ** max(1, high) > MOST:
                return None
            out, power = set(), {""}
            for k in range(high + 1):
                if k >= low:
                    out |= power
                power = {a + b for a in power for b in one}
            return out
        return None

    def _set(self, items) -> set[str] | None:
        C, out = self.c, set()
        for op, arg in items:
            if op is C.LITERAL and arg < 128:
                out.add(chr(arg).lower())
            elif op is C.RANGE and arg[1] < 128 and arg[1] - arg[0] < 4:
                out |= {chr(k).lower() for k in range(arg[0], arg[1] + 1)}
            else:
                return None
        return out if len(out) <= 4 else None

    def needed(self, nodes) -> set[str] | None:
        """A set of strings of which one is in every match; the one with the longest shortest string."""
        found: list[set[str]] = []
        run: list = []

        def close():
            # The longest stretches of the run that have few strings.
            k = 0
            while k < len(run):
                best, end = None, k
                for j in range(k + 1, len(run) + 1):
                    got = self.exact(run[k:j])
                    if got is None:
                        break
                    best, end = got, j
                if best is not None and "" not in best:
                    found.append(best)
                k = end if end > k else k + 1
            run.clear()

        for node in nodes:
            op, arg = node
            if self._one(op, arg) is not None:
                run.append(node)
                continue
            close()
            got = self._inner(op, arg)
            if got:
                found.append(got)
        close()
        return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)

    def _inner(self, op, arg) -> set[str] | None:
        C = self.c
        if op is C.SUBPATTERN:
            return self.needed(arg[3])
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            return self.needed(arg[2])
        if op is C.BRANCH:
            parts = [self.needed(b) for b in arg[1]]
            if all(parts) and sum(map(len, parts)) <= MOST:
                return set().union(*parts)
        return None


@cache
def of_pattern(pattern: str) -> frozenset[str]:
    """Folded strings of which each text that ``pattern`` matches holds one; empty where there are none to go by."""
    if "\\Q" in pattern:
        return frozenset()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = re._parser.parse(_plain(pattern))
    except (re.error, OverflowError, RecursionError):
        return frozenset()
    found = _Reader().needed(list(tree)) or set()
    # A string that holds another of the set adds nothing.
    least = {a for a in found if not any(b != a and b in a for b in found)}
    return frozenset(least) if least and all(len(a) > 1 or a in _RARE for a in least) else frozenset()


def of_any(patterns: tuple[str, ...]) -> frozenset[str]:
    """The same for texts that one of several patterns matches."""
    parts = [of_pattern(p) for p in patterns]
    return frozenset().union(*parts) if parts and all(parts) else frozenset()


def candidates(folded_text: Column, sets: dict[int, frozenset[str]]) -> Column:
    """The keys of the ``sets`` of which a folded text holds a literal, as an array.

    A few literals are looked for inside the engine. Many are the states of one automaton, which reads a line once
    however many they are; it is built once in each worker, and works on batches of Arrow strings.
    """
    words: dict[str, list[int]] = {}
    for k, found in sets.items():
        for w in found:
            words.setdefault(w, []).append(k)
    if not words:
        return F.array().cast("array<int>")
    if len(words) <= FEW:
        held = [F.when(F.contains(folded_text, F.lit(w)), F.array(*map(F.lit, ks))) for w, ks in sorted(words.items())]
        return F.array_distinct(F.flatten(F.filter(F.array(*held), lambda x: x.isNotNull())))
    return _scanner(tuple((w, tuple(ks)) for w, ks in sorted(words.items())))(folded_text)


_automata: dict = {}


def _automaton(words: tuple):
    if words not in _automata:
        import ahocorasick

        _automata.clear()
        made = ahocorasick.Automaton()
        for w, ks in words:
            made.add_word(w, ks)
        made.make_automaton()
        _automata[words] = made
    return _automata[words]


def _scanner(words: tuple):
    import pyarrow as pa

    def scan(texts: pa.Array) -> pa.Array:
        found = _automaton(words).iter
        out = []
        for t in texts.to_pylist():
            out.append(sorted({k for _, ks in found(t) for k in ks}) if t else [])
        return pa.array(out, pa.list_(pa.int32()))

    scan.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scan, "array<int>")
