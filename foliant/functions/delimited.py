"""Quote-aware tokenizer for delimited records: a finite automaton whose chunk transitions compose.

A chunk read from each possible state gives the state it ends in and the field ends on the way. Transitions of
neighbouring chunks compose, so the chunks of one long record, or of one huge file, are read independently of each other
and joined afterwards.

States: START (at the first character of a field), PLAIN (inside an unquoted field), QUOTED (inside quotes), CLOSED
(just after a quote inside quotes: the field's end or half of a doubled quote), BROKEN (a quote where none may be).
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)
STATES = (START, PLAIN, QUOTED, CLOSED)


class Transition(NamedTuple):
    """From one state over one chunk: the state reached, the offsets of separators, of record ends, and of the error."""

    state: int
    separators: tuple[int, ...]
    record_ends: tuple[int, ...]
    error: int


@lru_cache(maxsize=16)
def _patterns(sep: str, breaks: bool) -> tuple[re.Pattern, str]:
    stops = re.escape(sep) + '"' + ("\n" if breaks else "")
    return re.compile(f"[{stops}]"), sep


def read_chunk(chunk: str, state: int, sep: str, breaks: bool = False) -> Transition:
    """One pass over ``chunk`` from ``state``. With ``breaks`` an unquoted line feed ends the record, else it is text."""
    stop, _ = _patterns(sep, breaks)
    seps: list[int] = []
    ends: list[int] = []
    at, size = 0, len(chunk)
    while at < size:
        if state == QUOTED:
            found = chunk.find('"', at)
            if found < 0:
                return Transition(QUOTED, tuple(seps), tuple(ends), -1)
            at, state = found + 1, CLOSED
            continue
        here = chunk[at]
        if state == CLOSED and here == '"':
            at, state = at + 1, QUOTED
        elif here == sep:
            seps.append(at)
            at, state = at + 1, START
        elif breaks and here == "\n":
            ends.append(at)
            at, state = at + 1, START
        elif state == CLOSED:
            if breaks and here == "\r" and chunk[at + 1 : at + 2] in ("", "\n"):
                at += 1
                continue
            return Transition(BROKEN, tuple(seps), tuple(ends), at)
        elif here == '"':
            if state != START:
                return Transition(BROKEN, tuple(seps), tuple(ends), at)
            at, state = at + 1, QUOTED
        else:
            found = stop.search(chunk, at)
            at, state = (found.start() if found else size), PLAIN
    return Transition(state, tuple(seps), tuple(ends), -1)


def chunk_table(chunk: str, sep: str, breaks: bool = False) -> tuple[Transition, ...]:
    """The chunk's transition from every state; it needs nothing of the chunks before it."""
    return tuple(read_chunk(chunk, s, sep, breaks) for s in STATES)


def compose(tables: list[tuple[Transition, ...]], sizes: list[int], state: int = START) -> Transition:
    """The transition over consecutive chunks, with offsets from the first one's beginning."""
    seps: list[int] = []
    ends: list[int] = []
    base = 0
    for table, size in zip(tables, sizes):
        step = table[state]
        seps += [base + x for x in step.separators]
        ends += [base + x for x in step.record_ends]
        state = step.state
        if state == BROKEN:
            return Transition(BROKEN, tuple(seps), tuple(ends), base + step.error)
        base += size
    return Transition(state, tuple(seps), tuple(ends), -1)


def tokenize(record: str, sep: str, chunk_chars: int = 1 << 16) -> tuple[list[str] | None, int]:
    """The record's fields, or None and the offset of the quoting error (its length for a quote never closed)."""
    if len(record) <= chunk_chars:
        whole = read_chunk(record, START, sep)
    else:
        chunks = [record[i : i + chunk_chars] for i in range(0, len(record), chunk_chars)]
        whole = compose([chunk_table(c, sep) for c in chunks], [len(c) for c in chunks])
    if whole.state == BROKEN:
        return None, whole.error
    if whole.state == QUOTED:
        return None, len(record)
    fields, last = [], 0
    for end in (*whole.separators, len(record)):
        field = record[last:end]
        fields.append(field[1:-1].replace('""', '"') if field[:1] == '"' else field)
        last = end + 1
    return fields, -1
