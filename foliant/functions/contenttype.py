"""What a content type says of a part (no Spark import). All tests look at the beginning, whatever the case; null is nothing."""

from __future__ import annotations

import re


def _starts(content_type: str | None, *beginnings: str) -> bool:
    return bool(content_type) and content_type.lower().startswith(beginnings)


def is_document(t: str | None) -> bool:
    return _starts(t, "text/html", "application/xhtml+xml")


def is_stylesheet(t: str | None) -> bool:
    return _starts(t, "text/css")


def is_text(t: str | None) -> bool:
    return _starts(t, "text/")


def is_image(t: str | None) -> bool:
    return _starts(t, "image/")


def is_plain_text(t: str | None) -> bool:
    return _starts(t, "text/plain")


def is_media(t: str | None) -> bool:
    return _starts(t, "image/", "audio/", "video/", "font/")


def is_multipart(t: str | None) -> bool:
    return _starts(t, "multipart/")


def is_alternative(t: str | None) -> bool:
    return _starts(t, "multipart/alternative")


_BOUNDARY = re.compile(r";\s*boundary=(?:\"([^\"]*)\"|'([^']*)'|([^;]*))")


def boundary(t: str | None) -> str | None:
    """The boundary a multipart type names."""
    found = _BOUNDARY.search(";" + (t or ""))
    value = next((g for g in found.groups() if g is not None), "").strip() if found else ""
    return value or None


def media_type(t: str | None) -> str:
    """The type as it stands in a data address: parameters trimmed, without quotes."""
    return ";".join(p.strip().replace('"', "").replace("'", "") for p in (t or "application/octet-stream").split(";") if p.strip())
