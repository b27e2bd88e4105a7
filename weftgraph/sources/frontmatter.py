"""The front matter of notes: fence, and a small subset of YAML."""

from __future__ import annotations

import re


class FrontMatterError(ValueError):
    pass


def split(raw: str) -> tuple[str | None, str]:
    """(front matter, body); a text without a closed fence is all body."""
    if not re.match(r"---[ \t]*\r?\n", raw):
        return None, raw
    head = raw.index("\n") + 1
    m = re.compile(r"^---[ \t]*(?:\r?\n|\Z)", re.M).search(raw, head)
    if not m:
        return None, raw
    return raw[head : m.start()], raw[m.end() :]


def parse(text: str) -> dict:
    """Maps and lists by indentation, inline ``[ ]`` and ``{ }``, scalars, comments."""
    lines = []
    for n, line in enumerate(text.splitlines()):
        if "\t" in line[: len(line) - len(line.lstrip())]:
            raise FrontMatterError(f"tab in the indentation of line {n + 1}")
        bare = _uncomment(line).rstrip()
        if bare.strip():
            lines.append((len(bare) - len(bare.lstrip(" ")), bare.strip()))
    value, at = _block(lines, 0, lines[0][0] if lines else 0)
    if at != len(lines):
        raise FrontMatterError("unexpected indentation")
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise FrontMatterError("front matter must be a map")
    return value


def _uncomment(line: str) -> str:
    """The line up to a comment: ``#`` after a blank, outside quotes and brackets."""
    quote, depth, i = None, 0, 0
    while i < len(line):
        ch = line[i]
        if quote:
            if quote == '"' and ch == "\\":
                i += 1
            elif ch == quote:
                quote = None
        elif ch in "'\"":
            quote = ch
        elif ch in "[{":
            depth += 1
        elif ch in "]}":
            depth = max(0, depth - 1)
        elif ch == "#" and depth == 0 and (i == 0 or line[i - 1].isspace()):
            return line[:i]
        i += 1
    return line


_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


def _unquoted(text: str) -> str:
    """What stands between quotes; only double ones know escapes."""
    inner = text[1:-1]
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), inner, flags=re.S) if text[0] == '"' else inner


_KEY = re.compile(r"""(?P<key>"[^"]*"|'[^']*'|[^:\[\]{},"'][^:]*?)\s*:(?:\s+(?P<rest>.*))?$""")


def _block(lines: list, at: int, indent: int):
    if at >= len(lines):
        return None, at
    if lines[at][1] == "-" or lines[at][1].startswith("- "):
        out = []
        while at < len(lines) and lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1].startswith("- ")):
            rest = lines[at][1][1:].strip()
            if not rest:
                deeper = at + 1 < len(lines) and lines[at + 1][0] > indent
                value, at = _block(lines, at + 1, lines[at + 1][0]) if deeper else (None, at + 1)
            elif _KEY.match(rest) and not rest.startswith(("[", "{")):
                lines[at] = (indent + 2, rest)
                value, at = _block(lines, at, indent + 2)
            else:
                value, at = scalar(rest), at + 1
            out.append(value)
        return out, at
    out = {}
    while at < len(lines) and lines[at][0] == indent:
        m = _KEY.match(lines[at][1])
        if not m:
            raise FrontMatterError(f"expected a key: {lines[at][1]!r}")
        key = m["key"].strip("'\"")
        if m["rest"]:
            out[key], at = scalar(m["rest"].strip()), at + 1
            continue
        nxt = lines[at + 1] if at + 1 < len(lines) else None
        if nxt and (nxt[0] > indent or nxt[0] == indent and nxt[1].startswith("-")):
            out[key], at = _block(lines, at + 1, nxt[0])
        else:
            out[key], at = None, at + 1
    return out, at


def _pieces(text: str) -> list[str]:
    """Comma-separated parts at depth 0."""
    out, depth, quote, start = [], 0, None, 0
    for i, ch in enumerate(text):
        if quote:
            quote = None if ch == quote and not (quote == '"' and text[i - 1] == "\\" and text[i - 2] != "\\") else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "[{":
            depth += 1
        elif ch in "]}":
            depth -= 1
        elif ch == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    tail = text[start:].strip()
    return out + ([tail] if tail else [])


def scalar(text: str):
    if text.startswith("[[") and text.endswith("]]"):
        return text
    if text.startswith("[") and text.endswith("]"):
        return [scalar(p) for p in _pieces(text[1:-1])]
    if text.startswith("{") and text.endswith("}"):
        out = {}
        for p in _pieces(text[1:-1]):
            k, sep, v = p.partition(":")
            if not sep:
                raise FrontMatterError(f"expected a key: {p!r}")
            out[k.strip().strip("'\"")] = scalar(v.strip())
        return out
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return _unquoted(text)
    low = text.lower()
    if low in ("null", "~", ""):
        return None
    if low in ("true", "false"):
        return low == "true"
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"[+-]?(?:\d+\.\d*|\.\d+|\d+(?=[eE]))(?:[eE][+-]?\d+)?", text):
        return float(text)
    return text
