"""Addresses: parsing, normal form and resolution after the URL standard (no Spark import)."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import unquote_to_bytes

#: The schemes whose addresses have a host and a path, and their default ports.
SPECIAL = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_STRIP = "".join(map(chr, range(0x21)))
_PATH_SAFE = frozenset(c for c in map(chr, range(0x21, 0x7F)) if c not in "\"#<>?`{}^")
_QUERY_SAFE = frozenset(c for c in map(chr, range(0x21, 0x7F)) if c not in "\"#<>'")
_HASH_SAFE = frozenset(c for c in map(chr, range(0x21, 0x7F)) if c not in '"<>`')
_USER_SAFE = frozenset(c for c in map(chr, range(0x21, 0x7F)) if c not in "\"#<>?`{}/:;=@[\\]^|")
_FORBIDDEN_HOST = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")
_DOT, _DOTS = re.compile(r"\.|%2e", re.I), re.compile(r"(\.|%2e){2}", re.I)


def _escape(text: str, safe: frozenset[str]) -> str:
    if all(c in safe for c in text):
        return text
    return "".join(c if c in safe else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _host(text: str, special: bool) -> str | None:
    if text.startswith("["):
        return text.lower() if text.endswith("]") else None
    if not special:
        return _escape(text, _PATH_SAFE)
    name = unquote_to_bytes(text).decode("utf-8", "replace")
    if not name.isascii():
        try:
            import idna

            name = idna.encode(name, uts46=True, std3_rules=False).decode("ascii")
        except Exception:  # noqa: BLE001 - idna has several error classes
            return None
    name = name.lower()
    return None if not name or _FORBIDDEN_HOST.search(name) else name


class Url:
    """An absolute address in its parts; ``opaque`` ones have a path that is no list of segments."""

    __slots__ = ("scheme", "user", "host", "port", "path", "opaque", "query", "fragment")

    def __init__(self, scheme="", user="", host=None, port=None, path=(), opaque=None, query=None, fragment=None):
        self.scheme, self.user, self.host, self.port, self.path, self.opaque, self.query, self.fragment = scheme, user, host, port, tuple(path), opaque, query, fragment

    def href(self, fragment: bool = True) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            out += "//" + (self.user + "@" if self.user else "") + self.host + (f":{self.port}" if self.port is not None else "")
        out += self.opaque if self.opaque is not None else "/" + "/".join(self.path) if self.path or self.host is not None or self.scheme in SPECIAL else ""
        if self.query is not None:
            out += "?" + self.query
        if fragment and self.fragment is not None:
            out += "#" + self.fragment
        return out


def _segments(text: str, special: bool, start: tuple[str, ...] = ()) -> tuple[str, ...]:
    out = list(start)
    pieces = (text.replace("\\", "/") if special else text).split("/")
    for i, piece in enumerate(pieces):
        last = i == len(pieces) - 1
        if _DOTS.fullmatch(piece):
            if out:
                out.pop()
            if last:
                out.append("")
        elif _DOT.fullmatch(piece):
            if last:
                out.append("")
        else:
            out.append(_escape(piece, _PATH_SAFE))
    return tuple(out)


def _authority(text: str, scheme: str) -> tuple[str, str | None, int | None] | None:
    special = scheme in SPECIAL
    user = ""
    if "@" in text:
        name, text = text.rsplit("@", 1)
        name, colon, password = name.partition(":")
        user = _escape(name, _USER_SAFE) + (":" + _escape(password, _USER_SAFE) if colon and password else "")
    port = None
    found = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", text)
    if not found:
        return None
    if found[2]:
        port = int(found[2])
        if port > 65535:
            return None
        if port == SPECIAL.get(scheme):
            port = None
    if not found[1]:
        return (user, "", None) if scheme == "file" or not special else None
    host = _host(found[1], special)
    return None if host is None else (user, host, port)


@lru_cache(maxsize=65536)
def parse(text: str, base: str | None = None) -> Url | None:
    """The address ``text`` names, seen from ``base``; None where it names none."""
    text = re.sub(r"[\t\n\r]", "", text.strip(_STRIP))
    rest, hash_sign, fragment = text.partition("#")
    fragment = _escape(fragment, _HASH_SAFE) if hash_sign else None
    found = _SCHEME.match(rest)
    origin = None
    if found:
        scheme = found[1].lower()
        rest = rest[found.end() :]
        special = scheme in SPECIAL
        if special and base is not None and not rest.startswith(("/", "\\")):
            origin = parse(base)
            if origin is None or origin.scheme != scheme:
                origin = None
        if origin is None:
            if special:
                body, question, query = rest.partition("?")
                body = body.replace("\\", "/")
                stripped = body.lstrip("/") if scheme != "file" else body[2:] if body.startswith("//") else body
                authority, slash, path = stripped.partition("/") if scheme != "file" or body.startswith("//") else ("", "/", stripped.lstrip("/"))
                place = _authority(authority, scheme)
                if place is None:
                    return None
                return Url(scheme, *place, _segments(path, True) if slash else ("",), None, _escape(query, _QUERY_SAFE) if question else None, fragment)
            body, question, query = rest.partition("?")
            query = _escape(query, _QUERY_SAFE | {"'"}) if question else None
            if body.startswith("//"):
                authority, slash, path = body[2:].partition("/")
                place = _authority(authority, scheme)
                if place is None:
                    return None
                return Url(scheme, *place, _segments(path, False) if slash else (), None, query, fragment)
            if body.startswith("/"):
                return Url(scheme, "", None, None, _segments(body[1:], False), None, query, fragment)
            return Url(scheme, "", None, None, (), "".join(c if " " <= c <= "~" else _escape(c, frozenset()) for c in body), query, fragment)
    elif base is not None:
        origin = parse(base)
    if origin is None:
        return None
    special = origin.scheme in SPECIAL
    if origin.opaque is not None:
        return Url(origin.scheme, "", None, None, (), origin.opaque, origin.query, fragment) if not rest and fragment is not None else None
    body, question, query = rest.partition("?")
    query = _escape(query, _QUERY_SAFE if special else _QUERY_SAFE | {"'"}) if question else None
    if special:
        body = body.replace("\\", "/")
    if body.startswith("//"):
        return parse(f"{origin.scheme}:{body}" + (f"?{query}" if question else "") + (f"#{fragment}" if fragment is not None else ""))
    keep = (origin.scheme, origin.user, origin.host, origin.port)
    if body.startswith("/"):
        return Url(*keep, _segments(body[1:], special), None, query, fragment)
    if not body:
        return Url(*keep, origin.path, None, query if question else origin.query, fragment)
    return Url(*keep, _segments(body, special, origin.path[:-1]), None, query, fragment)


def normalize(value: str) -> str:
    """An absolute address in its normal form; anything else unchanged."""
    found = parse(value)
    return found.href() if found else value


def resolve(path: str, base: str | None) -> str:
    """``path`` seen from ``base``; data addresses, and those that can't be resolved, unchanged."""
    if path.startswith("data:") or not base:
        return path
    found = parse(path, base)
    if found:
        return found.href()
    if path.startswith("//") and (scheme := _SCHEME.match(base)):
        return f"{scheme[1]}:{path}"
    return path


def same_page(href: str, base: str) -> str:
    """What a link becomes: only its fragment where it stays on the page, else its address."""
    found, home = parse(href, base), parse(base)
    if found is not None and found.fragment and home is not None and found.href(fragment=False) == home.href():
        return "#" + found.fragment
    return resolve(href, base)


def unwrap_urn(url: str) -> str:
    """The address inside ``urn:scheme:address``."""
    return re.sub(r"\Aurn:[^:]+:(.+)\Z", r"\1", url, flags=re.S)
