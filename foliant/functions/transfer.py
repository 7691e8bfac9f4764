"""Content transfer encodings (no Spark import)."""

from __future__ import annotations

import base64
import binascii
import re

_ESCAPE = re.compile(rb"=([0-9A-Fa-f]{2})")
_SOFT = re.compile(rb"=[ \t]*\r?\n")
_BLANK = re.compile(rb"[\t\n\f\r ]+")


def decode_quoted_printable(data: bytes) -> bytes:
    """``=XX`` becomes a byte, a soft break goes; any other ``=`` stays."""
    if b"=" not in data:
        return data
    joined = _SOFT.sub(b"", data)
    if joined.endswith(b"=") and data.endswith(b"="):
        joined = joined[:-1]  # a soft break whose line end belonged to the delimiter
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), joined)


def encode_quoted_printable(data: bytes, width: int = 76) -> bytes:
    """Quoted-printable lines of at most ``width`` characters; line breaks are kept as they are."""
    out = []
    for line in re.split(rb"(\r?\n)", data):
        if line in (b"\n", b"\r\n"):
            out.append(line)
            continue
        body = re.sub(rb"[^\x20-\x3c\x3e-\x7e\t]", lambda m: b"=%02X" % m[0][0], line)
        if body[-1:] in (b" ", b"\t"):
            body = body[:-1] + b"=%02X" % body[-1]
        while len(body) > width:
            cut = width - 1
            while cut > width - 4 and b"=" in body[cut - 2 : cut] and cut > 1:
                cut -= 1
            out.append(body[:cut] + b"=\r\n")
            body = body[cut:]
        out.append(body)
    return b"".join(out)


def decode_base64(text: bytes | str) -> bytes | None:
    """The bytes of base64 text, blanks ignored and padding optional; None for anything else."""
    raw = text.encode("ascii", "replace") if isinstance(text, str) else text
    raw = _BLANK.sub(b"", raw)
    if raw.endswith(b"=") and len(raw) % 4 == 0:
        raw = raw[:-2] if raw.endswith(b"==") else raw[:-1]
    if len(raw) % 4 == 1 or re.search(rb"[^A-Za-z0-9+/]", raw):
        return None
    try:
        return base64.b64decode(raw + b"=" * (-len(raw) % 4))
    except (binascii.Error, ValueError):
        return None


def encode_base64(data: bytes) -> str:
    """Base64 on one line."""
    return base64.b64encode(data).decode("ascii")


def join_base64_lines(data: bytes) -> bytes:
    """Base64 text without its line breaks."""
    return data.replace(b"\r\n", b"").replace(b"\n", b"")
