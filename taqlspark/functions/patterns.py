"""Pattern dialects as Java regular expressions."""

from __future__ import annotations

import re

_SPECIAL = r".^$*+?{}[]()|\/"


def _quoted(c: str) -> str:
    return "\\" + c if c in _SPECIAL or c == "&" else c


def from_regex(pattern: str) -> str:
    """A search. A backslash makes any character literal (so ``\\d`` is a d), and braces are literal."""
    out, i, in_set = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(_quoted(pattern[i]))
        elif in_set:
            out.append("\\" + c if c in "[&" else c)
            in_set = c != "]"
        elif c == "[":
            in_set = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                i += 1
                out.append("^")
            if pattern[i + 1 : i + 2] == "]":
                i += 1
                out.append("\\]")
        else:
            out.append("\\" + c if c in "{}\\" else c)
        i += 1
    return "(?s)" + "".join(out)


def from_glob(pattern: str) -> str:
    """A whole string: ``*`` any run, ``?`` one character, ``[...]`` a set, ``{a,b}`` alternatives, backslash quotes."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(_quoted(pattern[i]))
        elif c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("[", "\\[").replace("&", "\\&") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(_quoted(c))
        i += 1
    return "(?s)^" + "".join(out) + "\\z"


def from_sql(pattern: str) -> str:
    """A whole string: ``%`` any run, ``_`` one character; a backslash makes any character literal, at the end itself."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(_quoted(pattern[i]))
        else:
            out.append({"%": ".*", "_": "."}.get(c) or _quoted(c))
        i += 1
    return "(?s)^" + "".join(out) + "\\z"


def valid(java: str) -> bool:
    """Whether the pattern compiles; a bad one matches nothing."""
    try:
        re.compile(java.replace("\\z", "\\Z"))
    except re.error:
        return False
    return True
