"""The candidates of a ``srcset`` attribute (no Spark import)."""

from __future__ import annotations

import re
from typing import NamedTuple

_SPACES = " \t\n\f\r"
_INT = re.compile(r"\d+\Z")
_FLOAT = re.compile(r"-?(?:\d+|\d*\.\d+)(?:[eE][+-]?\d+)?\Z")


class Candidate(NamedTuple):
    url: str
    w: int | None = None
    h: int | None = None
    d: float | None = None
    descriptors: tuple[str, ...] = ()


def _descriptors(text: str, at: int) -> tuple[list[str], int]:
    """The tokens up to the candidate's end; parentheses keep blanks and commas."""
    tokens, now, depth = [], "", 0
    while at < len(text):
        c = text[at]
        at += 1
        if depth == 0 and c == ",":
            break
        if depth == 0 and c in _SPACES:
            if now:
                tokens.append(now)
            now = ""
            continue
        depth += (c == "(") - (c == ")" and depth > 0)
        now += c
    if now:
        tokens.append(now)
    return tokens, at


def _read(tokens: list[str]) -> dict | None:
    """Width, height and density; None for descriptors that are wrong or don't go together."""
    out: dict = {}
    for token in tokens:
        number, unit = token[:-1], token[-1]
        if unit in "wh" and _INT.match(number) and int(number) > 0 and unit not in out and "d" not in out:
            out[unit] = int(number)
        elif unit == "x" and _FLOAT.match(number) and float(number) >= 0 and not out:
            out["d"] = float(number)
        else:
            return None
    return None if "h" in out and "w" not in out else out


def parse(text: str) -> list[Candidate]:
    """The candidates in order. One with wrong descriptors is kept, with the descriptors as they are written."""
    out, at = [], 0
    while True:
        while at < len(text) and (text[at] in _SPACES or text[at] == ","):
            at += 1
        if at >= len(text):
            return out
        end = at
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        url, at = text[at:end], end
        if url.endswith(","):
            out.append(Candidate(url.rstrip(",")))
            continue
        tokens, at = _descriptors(text, at)
        values = _read(tokens)
        out.append(Candidate(url, descriptors=tuple(tokens)) if values is None else Candidate(url, values.get("w"), values.get("h"), values.get("d")))


def number(value: float) -> str:
    """A number as it is written in attributes: without a fraction where it has none."""
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def serialize(candidates: list[Candidate]) -> str:
    """The attribute's text."""
    out = []
    for c in candidates:
        words = [c.url, *c.descriptors]
        if c.w is not None:
            words.append(f"{c.w}w")
        if c.h is not None:
            words.append(f"{c.h}h")
        if c.d is not None:
            words.append(f"{number(c.d)}x")
        out.append(" ".join(words))
    return ", ".join(out)
