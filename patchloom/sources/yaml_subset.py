"""A small YAML: block and flow mappings and sequences, quoted and block scalars, comments.

Anchors, aliases, tags, several documents, tabs for indentation and repeated keys are errors that name the line.
Keys stay text. Plain scalars become booleans (true, yes, on and their opposites), null, whole and broken numbers.
"""

from __future__ import annotations

import re
from typing import Any


class YamlError(ValueError):
    def __init__(self, line: int, message: str):
        super().__init__(f"line {line}: {message}")
        self.line = line


_TRUE, _FALSE, _NULL = {"true", "yes", "on"}, {"false", "no", "off"}, {"", "~", "null"}
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},"'#&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+|$)""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", "/": "/", '"': '"', "\\": "\\", " ": " "}


def plain(text: str) -> Any:
    low = text.lower()
    if low in _TRUE:
        return True
    if low in _FALSE:
        return False
    if low in _NULL:
        return None
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", text):
        return float(text)
    return text


def _uncomment(line: str) -> str:
    """The line without a comment, which starts at its beginning or after a space, outside quotes."""
    quote, k = "", 0
    while k < len(line):
        c = line[k]
        if quote:
            if c == "\\" and quote == '"':
                k += 1
            elif c == quote:
                quote = ""
        elif c in "\"'" and (k == 0 or line[k - 1] in " [{,:"):
            quote = c
        elif c == "#" and (k == 0 or line[k - 1] in " \t"):
            return line[:k].rstrip()
        k += 1
    return line.rstrip()


def _double(body: str, line: int) -> str:
    def one(m: re.Match) -> str:
        kind = m[1]
        if kind[0] in "xu":
            return chr(int(kind[1:], 16))
        if kind not in _ESCAPES:
            raise YamlError(line, f"unknown escape \\{kind}")
        return _ESCAPES[kind]

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)", one, body)


class _Reader:
    def __init__(self, text: str):
        self.raw = text.replace("\r\n", "\n").split("\n")
        self.at = 0

    def _skip(self) -> None:
        while self.at < len(self.raw):
            line = self.raw[self.at]
            if line.strip() and not line.lstrip().startswith("#"):
                lead = line[: len(line) - len(line.lstrip())]
                if "\t" in lead:
                    raise YamlError(self.at + 1, "tabs cannot indent")
                return
            self.at += 1

    def document(self) -> Any:
        self._skip()
        if self.at < len(self.raw) and self.raw[self.at].rstrip() == "---":
            self.at += 1
            self._skip()
        if self.at >= len(self.raw):
            return None
        out = self.block(self._indent())
        self._skip()
        if self.at < len(self.raw):
            what = "several documents are not supported" if self.raw[self.at].startswith(("---", "...")) else "unexpected content"
            raise YamlError(self.at + 1, what)
        return out

    def _indent(self) -> int:
        line = self.raw[self.at]
        return len(line) - len(line.lstrip(" "))

    def block(self, indent: int) -> Any:
        text = self.raw[self.at].strip()
        if text == "-" or text.startswith("- "):
            return self.sequence(indent)
        if _KEY.match(_uncomment(text)):
            return self.mapping(indent)
        self.at += 1
        return self.scalar(_uncomment(text), self.at, indent)

    def sequence(self, indent: int) -> list:
        out = []
        while True:
            self._skip()
            if self.at >= len(self.raw) or self._indent() != indent or not (self.raw[self.at].strip() == "-" or self.raw[self.at].lstrip().startswith("- ")):
                if self.at < len(self.raw) and self._indent() > indent:
                    raise YamlError(self.at + 1, "bad indentation")
                return out
            line = self.raw[self.at]
            rest = line[indent + 1 :]
            if not _uncomment(rest).strip():
                self.at += 1
                out.append(self._nested(indent))
            elif _KEY.match(_uncomment(rest.strip())) or rest.strip().startswith("- "):
                # The item starts on the dash's line: read it as a block of its own.
                self.raw[self.at] = " " * (len(line) - len(rest.lstrip())) + rest.lstrip()
                out.append(self.block(self._indent()))
            else:
                self.at += 1
                out.append(self.scalar(_uncomment(rest).strip(), self.at, indent))

    def mapping(self, indent: int) -> dict:
        out: dict[str, Any] = {}
        while True:
            self._skip()
            if self.at >= len(self.raw) or self._indent() < indent:
                return out
            if self._indent() > indent:
                raise YamlError(self.at + 1, "bad indentation")
            text = _uncomment(self.raw[self.at].strip())
            if text.startswith("---"):
                return out
            m = _KEY.match(text)
            if not m:
                if text.startswith("- ") or text == "-":
                    return out
                raise YamlError(self.at + 1, f"expected a key, found {text!r}")
            key = m[1]
            key = _double(key[1:-1], self.at + 1) if key[0] == '"' else key[1:-1].replace("''", "'") if key[0] == "'" else key.strip()
            if key in out:
                raise YamlError(self.at + 1, f"repeated key {key!r}")
            rest = text[m.end() :].strip()
            self.at += 1
            out[key] = self.scalar(rest, self.at, indent) if rest else self._nested(indent, True)

    def _nested(self, indent: int, in_map: bool = False) -> Any:
        self._skip()
        if self.at >= len(self.raw):
            return None
        here, text = self._indent(), self.raw[self.at].strip()
        if here > indent or (in_map and here == indent and (text == "-" or text.startswith("- "))):
            return self.block(here)
        return None

    def scalar(self, text: str, line: int, indent: int) -> Any:
        if text[:1] in "&*!" and text[:1]:
            raise YamlError(line, {"&": "anchors", "*": "aliases", "!": "tags"}[text[0]] + " are not supported")
        if text[:1] in "|>" and re.fullmatch(r"[|>][-+]?\d?[-+]?", text):
            return self._folded(text, indent)
        if text[:1] in "[{":
            while not _closed(text):
                if self.at >= len(self.raw):
                    raise YamlError(line, "unclosed flow collection")
                text += " " + _uncomment(self.raw[self.at].strip())
                self.at += 1
            value, end = _flow(text, 0, line)
            if text[end:].strip():
                raise YamlError(line, f"unexpected {text[end:].strip()!r}")
            return value
        if text[:1] in "\"'" and text[:1]:
            value, end = _quoted(text, 0, line)
            if text[end:].strip():
                raise YamlError(line, f"unexpected {text[end:].strip()!r}")
            return value
        return plain(text)

    def _folded(self, head: str, indent: int) -> str:
        lines, inner = [], None
        while self.at < len(self.raw):
            line = self.raw[self.at]
            if line.strip():
                here = len(line) - len(line.lstrip(" "))
                if here <= indent:
                    break
                inner = here if inner is None else inner
                if here < inner:
                    break
                lines.append(line[inner:])
            else:
                lines.append("")
            self.at += 1
        tail = 0
        while lines and not lines[-1]:
            lines.pop()
            tail += 1
        if head[0] == "|":
            body = "\n".join(lines)
        else:
            body = re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(lines))
            body = re.sub(r"\n(\n+)", r"\1", body)
        return body if "-" in head else body + "\n" * (1 + tail * ("+" in head)) if lines else ""


def _closed(text: str) -> bool:
    bare = re.sub(r""""(?:[^"\\]|\\.)*"|'(?:[^']|'')*'""", "", text)
    return bare.count("[") + bare.count("{") <= bare.count("]") + bare.count("}")


def _quoted(text: str, k: int, line: int) -> tuple[str, int]:
    m = re.compile(r""""((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'""", re.S).match(text, k)
    if not m:
        raise YamlError(line, "unclosed quote")
    return (_double(m[1], line) if m[1] is not None else m[2].replace("''", "'")), m.end()


def _flow_key(text: str, k: int, line: int) -> tuple[str, int]:
    if text[k : k + 1] in ('"', "'"):
        return _quoted(text, k, line)
    m = re.compile(r"[^,\[\]{}:]*").match(text, k)
    return m[0].strip(), m.end()


def _flow(text: str, k: int, line: int) -> tuple[Any, int]:
    blank = re.compile(r"\s*")
    k = blank.match(text, k).end()
    if text[k : k + 1] in ("[", "{"):
        closer, pairs, out = {"[": "]", "{": "}"}[text[k]], text[k] == "{", []
        k = blank.match(text, k + 1).end()
        while text[k : k + 1] != closer:
            value, k = _flow_key(text, k, line) if pairs else _flow(text, k, line)
            k = blank.match(text, k).end()
            if pairs:
                if text[k : k + 1] != ":":
                    raise YamlError(line, "expected : in a flow mapping")
                inner, k = _flow(text, k + 1, line)
                if value in dict(out):
                    raise YamlError(line, f"repeated key {value!r}")
                value = (value, inner)
                k = blank.match(text, k).end()
            out.append(value)
            if text[k : k + 1] == ",":
                k = blank.match(text, k + 1).end()
            elif text[k : k + 1] != closer:
                raise YamlError(line, f"expected , or {closer}")
        return (dict(out) if pairs else out), k + 1
    if text[k : k + 1] in ('"', "'"):
        return _quoted(text, k, line)
    if text[k : k + 1] in ("&", "*", "!"):
        raise YamlError(line, "anchors, aliases and tags are not supported")
    m = re.compile(r"(?:[^,\[\]{}:]|:(?=[^\s,\]}]))*").match(text, k)
    return plain(m[0].strip()), m.end()


def load(text: str) -> Any:
    """The value of one document; None for an empty one."""
    return _Reader(text).document()
