"""Linear-time regular expressions, run by the engine's backtracking matcher.

Rules are written in the RE2 dialect. :func:`to_java` rejects what that dialect does not have and rewrites what
means something else to java.util.regex: word edges, white space, case folding and line ends.
"""

from __future__ import annotations

import re

#: Unlike a class of ranges, this one is ASCII whatever the case flags are, and a look into a table.
_WORD = r"\w"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NO_EDGE = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
#: The same before a character that only a word character can match.
_BEGINS = f"(?<!{_WORD})"
_BLANK, _NO_BLANK = r"\t\n\f\r ", r"\x00-\x08\x0B\x0E-\x1F!-\x{10FFFF}"
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_QUANTIFIER = re.compile(r"\{\d+(?:,\d*)?\}")
#: One such character that must be there; with case folding k and s also match characters beyond ASCII.
_BEFORE_WORD = re.compile(r"[0-9A-JL-RT-Za-jl-rt-z_](?![?*{])")
_FLAGS = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])")


class PatternError(ValueError):
    """A pattern that the dialect does not have."""


def _escape(p: str, k: int, in_class: bool) -> tuple[str, int]:
    """The translation of the escape at p[k] and the position after it."""
    if k + 1 >= len(p):
        raise PatternError("trailing backslash")
    c = p[k + 1]
    if c in "123456789" or c == "k":
        raise PatternError("back-references are not supported")
    if c in "GZXRhHNVyYmM" or c == "C":
        raise PatternError(f"unknown escape \\{c}")
    if c == "Q":
        end = p.find("\\E", k)
        end = len(p) if end < 0 else end
        return "".join(re.sub(r"([^\w\s])", r"\\\1", ch) for ch in p[k + 2 : end]), min(len(p), end + 2)
    simple = {"s": _BLANK, "S": _NO_BLANK}
    if c in simple:
        return (simple[c] if in_class else f"[{simple[c]}]"), k + 2
    if not in_class and c == "b" and _BEFORE_WORD.match(p, k + 2):
        return _BEGINS, k + 2
    if not in_class and c in "bB":
        return (_EDGE if c == "b" else _NO_EDGE), k + 2
    if c in "pP":
        end = p.find("}", k) + 1 if p[k + 2 : k + 3] == "{" else k + 3
        if end <= k + 2:
            raise PatternError("unclosed class name")
        return p[k:end], end
    if c == "x" and p[k + 2 : k + 3] == "{":
        end = p.find("}", k) + 1
        return p[k:end], end
    return p[k : k + 2], k + 2


def _class(p: str, k: int) -> tuple[str, int]:
    out, start = ["["], k
    k += 1
    if p[k : k + 1] == "^":
        out.append("^")
        k += 1
    first = True
    while k < len(p):
        c = p[k]
        if c == "]" and not first:
            return "".join(out) + "]", k + 1
        first = False
        if c == "\\":
            got, k = _escape(p, k, True)
            out.append(got)
        elif c == "[" and (m := re.match(r"\[:(\^?)(\w+):\]", p[k:])):
            if m[2] not in _POSIX:
                raise PatternError(f"unknown class [:{m[2]}:]")
            out.append(f"[^{_POSIX[m[2]]}]" if m[1] else _POSIX[m[2]])
            k += m.end()
        else:
            out.append("\\" + c if c in "[]&^" and not (c == "^" and len(out) == 1) else c)
            k += 1
    raise PatternError(f"missing ] for the class at {start}")


def to_java(pattern: str) -> str:
    """The same language for java.util.regex; PatternError for what RE2 would not compile."""
    if pattern == "":
        raise PatternError("empty pattern")
    out, k, depth, can_repeat = ["(?d)"], 0, 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            got, k = _escape(pattern, k, False)
            out.append(got)
            can_repeat = True
        elif c == "[":
            got, k = _class(pattern, k)
            out.append(got)
            can_repeat = True
        elif c == "(":
            if m := re.match(r"\(\?P?<(\w+)>", pattern[k:]):
                got = f"(?<{m[1].replace('_', 'x')}>"
                k += m.end()
                depth += 1
            elif pattern[k + 1 : k + 2] == "?":
                m = _FLAGS.match(pattern, k)
                if not m or (not m[1] and not m[2] and m[3] == ")"):
                    raise PatternError(f"unsupported group {pattern[k : k + 4]!r}")
                if "U" in m[1] + (m[2] or ""):
                    raise PatternError("the ungreedy flag is not supported")
                on, off = m[1] + "u" * ("i" in m[1]), (m[2] or "") + "u" * ("i" in (m[2] or ""))
                got = f"(?{on}{'-' + off if off else ''}{m[3]}"
                k = m.end()
                depth += m[3] == ":"
            else:
                got, k, depth = "(", k + 1, depth + 1
            out.append(got)
            can_repeat = False
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise PatternError("unexpected )")
            out.append(c)
            k, can_repeat = k + 1, True
        elif c in "*+?" or (c == "{" and _QUANTIFIER.match(pattern, k)):
            if not can_repeat:
                raise PatternError(f"nothing to repeat at {k}")
            end = k + 1 if c != "{" else _QUANTIFIER.match(pattern, k).end()
            if pattern[end : end + 1] == "?":
                end += 1
            elif pattern[end : end + 1] in ("+", "*") or (pattern[end : end + 1] == "{" and _QUANTIFIER.match(pattern, end)):
                raise PatternError("repeated repetition")
            out.append(pattern[k:end])
            k, can_repeat = end, False
        else:
            out.append("\\" + c if c in "{}" else c)
            k, can_repeat = k + 1, c not in "|^"
    if depth:
        raise PatternError("missing )")
    return "".join(out)


def nested_repetition(pattern: str) -> bool:
    """Whether an unbounded repetition holds another, which a backtracking matcher may never finish."""
    bare = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "x", pattern)
    return bool(re.search(r"\([^()]*[*+][^()]*\)(?:[*+]|\{\d+,\})", bare))


def never_empty(pattern: str) -> bool:
    """Whether every match has a character; False where that is not known."""
    from re import _parser

    try:
        return _parser.parse(re.sub(r"\(\?[a-zA-Z-]+\)", "", pattern)).getwidth()[0] > 0
    except re.error:
        return False
