"""Charset labels, byte order marks and decoding as browsers do it (no Spark import)."""

from __future__ import annotations

import codecs
import re
from functools import lru_cache

_PARAMETER = re.compile(r"charset\s*=\s*(\"[^\"]*\"|'[^']*'|[^;]+)", re.I)
#: Labels whose codec has another name than the label, as browsers read them.
LABELS = {
    "ascii": "cp1252", "euc_kr": "cp949", "iso8859-9": "cp1254", "iso8859-11": "cp874", "us-ascii": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "latin1": "cp1252", "l1": "cp1252", "windows-1252": "cp1252", "x-cp1252": "cp1252",
    "gb2312": "gb18030", "gbk": "gb18030", "x-gbk": "gb18030", "chinese": "gb18030", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932",
    "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "korean": "cp949", "big5": "big5hkscs", "big5-hkscs": "big5hkscs", "x-x-big5": "big5hkscs", "iso-8859-9": "cp1254", "latin5": "cp1254", "iso-8859-11": "cp874", "tis-620": "cp874",
    "koi8-u": "koi8-u", "x-mac-cyrillic": "mac-cyrillic", "macintosh": "mac-roman", "x-mac-roman": "mac-roman", "utf-16": "utf-16-le", "unicode": "utf-16-le", "utf8": "utf-8", "unicode-1-1-utf-8": "utf-8", "iso-8859-8-i": "iso8859-8",
}
#: The codecs of the public encoding standard; labels of any other one are unknown.
CODECS = frozenset(
    (
        "utf-8", "utf-16-le", "utf-16-be", "cp866", "iso8859-2", "iso8859-3", "iso8859-4", "iso8859-5", "iso8859-6", "iso8859-7", "iso8859-8", "iso8859-10", "iso8859-13", "iso8859-14", "iso8859-15", "iso8859-16",
        "koi8-r", "koi8-u", "mac-roman", "mac-cyrillic", "cp874", "cp1250", "cp1251", "cp1252", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp1258",
        "gb18030", "big5hkscs", "euc_jp", "iso2022_jp", "cp932", "cp949",
    )
)
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))


def charset_parameter(content_type: str | None) -> str | None:
    """The charset a content type names, unquoted and in lower case."""
    found = _PARAMETER.search(content_type or "")
    return found[1].strip().strip("\"'").lower() or None if found else None


def with_charset(content_type: str, charset: str) -> str:
    """The content type with its charset parameter replaced, if it has one."""
    return _PARAMETER.sub(f"charset={charset}", content_type)


def mark_charset(data: bytes) -> str | None:
    """The charset told by a byte order mark."""
    return next((name for mark, name in _MARKS if data.startswith(mark)), None)


@lru_cache(maxsize=256)
def codec_name(label: str | None) -> str:
    """The codec for a label; utf-8 for none or an unknown one, as for labels that name no charset of the web (utf-7, escapes)."""
    name = (label or "utf-8").strip().lower()
    if name == "x-user-defined":
        return name
    try:
        name = codecs.lookup(LABELS.get(name, name)).name
        name = LABELS.get(name, name)
        return name if name in CODECS else "utf-8"
    except (LookupError, ValueError):
        return "utf-8"


@lru_cache(maxsize=64)
def _single_byte_table(name: str) -> str | None:
    """For a one-byte charset its 256 characters, with controls where the charset has none."""
    if name == "x-user-defined":
        return "".join(chr(i if i < 128 else 0xF700 + i) for i in range(256))
    if not name.startswith(("cp125", "cp874", "iso8859", "koi8", "mac", "cp866")):
        return None
    return "".join(bytes([i]).decode(name, "ignore") or chr(i) for i in range(256))


def decode(data: bytes, label: str | None = None) -> str:
    """``data`` as text; malformed sequences become U+FFFD and a byte order mark goes."""
    name = codec_name(label)
    table = _single_byte_table(name)
    text = codecs.charmap_decode(data, "replace", table)[0] if table else data.decode(name, "replace")
    return text[1:] if text[:1] == "﻿" else text
