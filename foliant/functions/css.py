"""The references of a style sheet, found and rewritten in place; all other text stays as it is (no Spark import)."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

_TOKEN = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|@import\b|\burl\(|[;{}]", re.S | re.I)
_STRING = re.compile(r"\s*(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')\s*", re.S)
_BARE = re.compile(r"\s*((?:\\[0-9a-fA-F]{1,6}\s?|\\.|[^\\\s\"'()])*)\s*\)", re.S)
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(\n)|(.))", re.S)
_CHARSET = re.compile(r"\A﻿?@charset\s+(\"[^\"]*\"|'[^']*')\s*;", re.I)
_SPECIAL = re.compile(r"[\s\"'()\\]")


class Span(NamedTuple):
    """A reference: its place, its kind (url or import) and the address as it is written."""

    start: int
    end: int
    kind: str
    path: str


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            code = int(m[1], 16)
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
        return "" if m[2] else m[3]

    return _ESCAPE.sub(one, text) if "\\" in text else text


def references(sheet: str) -> list[Span]:
    """The url() and @import references, in order. Those in comments, strings and broken rules are none."""
    out: list[Span] = []
    importing = False
    at = 0
    while m := _TOKEN.search(sheet, at):
        token = m[0].lower()
        at = m.end()
        if token.startswith("/*"):
            continue
        if token == "@import":
            importing = True
        elif token == "url(":
            quoted = _STRING.match(sheet, at)
            if quoted and sheet[quoted.end() : quoted.end() + 1] == ")":
                out.append(Span(m.start(), quoted.end() + 1, "import" if importing else "url", unescape(quoted[1][1:-1])))
                at = quoted.end() + 1
            elif bare := _BARE.match(sheet, at):
                if bare[1]:
                    out.append(Span(m.start(), bare.end(), "import" if importing else "url", unescape(bare[1])))
                at = bare.end()
            importing = False
        elif token[0] in "\"'":
            if importing and len(token) > 1 and token[-1] == token[0]:
                out.append(Span(m.start(), m.end(), "import", unescape(m[0][1:-1])))
            importing = False
        else:
            importing = False
    return out


def url_token(address: str, original: str | None = None) -> str:
    """A url() for an address, behind a comment with the one it had."""
    comment = f"/* original URL: {original.replace('*/', '* /')} */ " if original is not None else ""
    return f"{comment}url({_SPECIAL.sub(lambda m: chr(92) + m[0] if not m[0].isspace() else chr(92) + format(ord(m[0]), 'x') + ' ', address)})"


def rewrite(sheet: str, replace: Callable[[Span], str | None]) -> str:
    """The sheet with each reference replaced by what ``replace`` gives for it (None: left alone)."""
    out, last = [], 0
    for span in references(sheet):
        new = replace(span)
        if new is not None:
            out += [sheet[last : span.start], new]
            last = span.end
    out.append(sheet[last:])
    return "".join(out)


def charset_rule(sheet: str) -> str | None:
    """The charset the sheet's first rule names."""
    found = _CHARSET.match(sheet)
    return found[1][1:-1].lower() if found else None


def without_charset_rule(sheet: str) -> str:
    return _CHARSET.sub("", sheet, count=1)
