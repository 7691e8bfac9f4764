"""RFC 2047 encoded words in header values (no Spark import)."""

from __future__ import annotations

import re

from foliant.functions.charset import decode
from foliant.functions.transfer import decode_base64

_WORD = re.compile(r"=\?([^?\s]+)\?([QqBb])\?([^?]*)\?=")
_HEX = re.compile(rb"=([0-9A-Fa-f]{2})")


def word_bytes(encoding: str, value: str) -> bytes | None:
    """The bytes of one encoded word; None where its base64 is damaged."""
    if encoding in "Bb":
        return decode_base64(value)
    raw = value.replace("_", " ").encode("utf-8")
    return _HEX.sub(lambda m: bytes([int(m[1], 16)]), raw)


def decode_header(header: str | None) -> str:
    """The header as text. Neighbouring words lose the blanks between them, and those of one charset are joined as bytes."""
    if not header:
        return ""
    out: list[str] = []
    pending, charset = b"", None
    last = 0
    for m in _WORD.finditer(header):
        between = header[last : m.start()]
        neighbours = charset is not None and not between.strip()
        data = word_bytes(m[2], m[3])
        label = m[1].split("*")[0].lower()
        if not neighbours or label != charset or data is None:
            if charset is not None:
                out.append(decode(pending, charset))
                pending, charset = b"", None
            if not neighbours:
                out.append(between)
        if data is None:
            out.append(m[3])
            charset, pending = label, b""
        else:
            charset, pending = label, pending + data
        last = m.end()
    if charset is not None:
        out.append(decode(pending, charset))
    out.append(header[last:])
    return "".join(out)


def encode_words(text: str, charset: str = "utf-8", how: str = "B", per_word: int = 30) -> str:
    """``text`` as encoded words of at most ``per_word`` bytes each, which may part characters."""
    import base64

    data = text.encode(charset)
    words = []
    for i in range(0, len(data), per_word) or [0]:
        piece = data[i : i + per_word]
        body = base64.b64encode(piece).decode() if how == "B" else "".join(chr(b) if chr(b).isalnum() and b < 128 else "_" if b == 32 else f"={b:02X}" for b in piece)
        words.append(f"=?{charset}?{how}?{body}?=")
    return " ".join(words)
