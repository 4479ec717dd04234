"""Tokens of a statement."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..types import TaqlError


@dataclass
class Token:
    """kind: name, int, float, str, dollar, op or end; at: where it begins."""

    kind: str
    text: str
    at: int
    value: object = None


_TOKEN = re.compile(
    r"""(?P<ws>\s+)
    |(?P<float>(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+)
    |(?P<int>[0-9]+)
    |(?P<str>'(?:[^']|'')*')
    |(?P<dollar>\$[0-9]+)
    |(?P<name>[A-Za-z_][A-Za-z0-9_.$]*)
    |(?P<op>&&|\|\||==|!=|<>|<=|>=|!~|[-+*/%(),\[\]=<>~!&|;:.{}^@])""",
    re.X,
)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TaqlError(f"unexpected {text[at]!r} at {at}")
        kind, body = m.lastgroup or "", m.group()
        if kind != "ws":
            value: object = None
            if kind == "int":
                value = int(body)
            elif kind == "float":
                value = float(body)
            elif kind == "str":
                value = body[1:-1].replace("''", "'")
            elif kind == "dollar":
                value = int(body[1:])
            out.append(Token(kind, body, at, value))
        at = m.end()
    out.append(Token("end", "", at))
    return out
