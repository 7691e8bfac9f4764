"""From the bytes of an archive to its parts (no Spark import).

The body is cut at its delimiters first, in one search over the bytes; headers, transfer encoding and charset are dealt
with part by part afterwards.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from foliant.functions import charset, contenttype, css, markup, transfer, urls

MISLABELED, BOUNDARY_UNUSED, NO_DELIMITERS, SYNTHESIZED, LEFT_ENCODED = (
    "document-mislabeled-as-archive",
    "declared-boundary-unused",
    "multipart-without-delimiters",
    "index-synthesized",
    "base64-left-encoded",
)
_BLANK_LINE = re.compile(rb"(?:\A|\n)\r?\n")
_HEADER = re.compile(r"[!-9;-~]+:")
_MARKUP, _WIDE_MARKUP = re.compile(rb"[ \t\r\n]*<"), re.compile(rb"[\x00 \t\r\n]*<")


@dataclass
class Part:
    """One part. ``data`` is its text, or base64 text where ``transfer_encoding`` is base64."""

    ordinal: int
    id: str
    written_id: str
    content_id: str | None
    content_type: str | None
    transfer_encoding: str | None
    data: str = ""
    depth: int = 0
    container: bool = False
    charset: str | None = None


@dataclass
class Archive:
    headers: dict[str, str] = field(default_factory=dict)
    parts: list[Part] = field(default_factory=list)
    index: int | None = None  # the ordinal of the main document
    anomalies: list[tuple[str, str | None]] = field(default_factory=list)

    def addresses(self) -> tuple[dict[str, int], dict[str, int]]:
        """Part numbers by address (the first part of an address counts) and by frame (the last one does)."""
        found: dict[str, int] = {}
        frames: dict[str, int] = {}
        for p in self.parts:
            if p.content_id is not None:
                frames[p.content_id] = p.ordinal
            for key in (p.content_id, p.id, p.written_id):
                if key is not None:
                    found.setdefault(key, p.ordinal)
        return found, frames

    @property
    def index_id(self) -> str | None:
        return self.parts[self.index].id if self.index is not None else None


def starts_with_markup(data: bytes) -> bool:
    """True where a tag is the first thing in ``data``, blanks and a byte order mark aside."""
    name = charset.mark_charset(data)
    start = 3 if name == "utf-8" else 2 if name else 0
    return (_WIDE_MARKUP if start == 2 else _MARKUP).match(data, start) is not None


def read_headers(lines: list[str]) -> dict[str, str]:
    """Header fields, names in lower case; of a name that comes twice the last counts. A folded line is joined as it is."""
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] not in (" ", "\t") and ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
        elif name is not None:
            out[name] += line.strip()
    return out


def header_block(data: bytes) -> tuple[list[bytes], int]:
    """The lines before the first blank one, and where the body begins (-1 where no blank line ends them)."""
    end = _BLANK_LINE.search(data)
    block = data[: end.start() + (0 if end and end.start() == 0 and data[:1] in b"\r\n" else 1)] if end else data
    return [x for x in block.replace(b"\r\n", b"\n").split(b"\n") if x], end.end() if end else -1


def _part_headers(lines: list[bytes]) -> bool:
    """True where the lines are headers, one of them of a part's content."""
    text = [x.decode("latin-1") for x in lines]
    return all(x[:1] in (" ", "\t") or _HEADER.match(x) for x in text) and any(x[:8].lower() == "content-" for x in text)


def delimiter_pattern(boundary: bytes) -> re.Pattern:
    """Delimiters, also behind text on their line; longer look-alikes are none. Group 1 marks the closing one."""
    return re.compile(rb"--" + re.escape(boundary) + rb"(--)?[ \t]*(?:\r?\n|\Z)")


def _trim_end(data: bytes) -> bytes:
    """The line end before a delimiter, or at the end of the file, belongs to neither."""
    return data[:-2] if data.endswith(b"\r\n") else data[:-1] if data.endswith(b"\n") else data


class _Reader:
    def __init__(self):
        self.archive = Archive()
        self.raw: list[bytes] = []
        self.taken: set[str] = set()
        self.generated = 0

    def add(self, headers: dict[str, str], body: bytes, depth: int) -> None:
        a = self.archive
        content_type, content_id = headers.get("content-type"), headers.get("content-id")
        encoding = headers.get("content-transfer-encoding")
        encoding = encoding.strip().lower() if encoding else None
        written = headers.get("content-location")
        if written is None:
            written = content_id
        while written is None:
            name = f"_{self.generated}"
            self.generated += 1
            if name not in self.taken:
                written = name
        part = Part(len(a.parts), urls.normalize(written), written, content_id, content_type, encoding, depth=depth, container=contenttype.is_alternative(content_type))
        self.taken |= {part.id, written} | ({content_id} if content_id is not None else set())
        a.parts.append(part)
        if part.container:
            part.data = charset.decode(body)
            inner = contenttype.boundary(content_type)
            if inner:
                self.multipart(body, inner.encode(), depth + 1)
            return
        if a.index is None and contenttype.is_document(content_type):
            a.index = part.ordinal
        self.decode(part, body)

    def multipart(self, body: bytes, boundary: bytes, depth: int) -> bool:
        """Adds the parts between the delimiters; False where there are none."""
        marks = list(delimiter_pattern(boundary).finditer(body))
        for i, mark in enumerate(marks):
            stop = marks[i + 1].start() if i + 1 < len(marks) else len(body)
            region = body[mark.end() : stop]
            lines, start = header_block(region)
            if start < 0:
                if not lines or i + 1 == len(marks):
                    continue
                start = len(region)
            if mark[1] and i and not _part_headers(lines):
                continue  # text behind the closing delimiter is no part, unless headers make it one
            self.add(read_headers([charset.decode(x) for x in lines]), _trim_end(region[start:]), depth)
        return bool(marks)

    def decode(self, part: Part, body: bytes) -> None:
        """The part's transfer encoding and charset."""
        declared = charset.charset_parameter(part.content_type)
        index = self.archive.index == part.ordinal
        document, sheet = contenttype.is_document(part.content_type), contenttype.is_stylesheet(part.content_type)
        raw = body
        if part.transfer_encoding == "quoted-printable":
            raw = transfer.decode_quoted_printable(body)
        elif part.transfer_encoding == "base64":
            raw = transfer.join_base64_lines(body)
            if part.content_type and (index or (document and part.content_id is not None) or sheet):
                # parts that will be shown as text are decoded, all others stay as they are
                found = transfer.decode_base64(raw)
                if found is not None:
                    raw, part.transfer_encoding = found, None
                else:
                    self.archive.anomalies.append((LEFT_ENCODED, part.id))
        mark = charset.mark_charset(raw)
        label = mark or declared
        if part.transfer_encoding == "binary" and not contenttype.is_text(part.content_type):
            part.transfer_encoding, part.data = "base64", transfer.encode_base64(raw)
            return
        part.charset = None if part.transfer_encoding == "base64" else charset.codec_name(label)
        part.data = charset.decode(raw, label)
        if not part.content_type:
            return
        if part.transfer_encoding != "base64":
            part.content_type = charset.with_charset(part.content_type, "utf-8")
        if sheet:
            self.sheet_charset(part, raw, label, mark)
        elif document:
            label = self.document_charset(part, raw, label, mark)
            if index:
                self.again(label)

    def sheet_charset(self, part: Part, raw: bytes, label: str | None, mark: str | None) -> None:
        named = css.charset_rule(part.data)
        if named is not None:
            if mark is None and named not in ("utf-8", label):
                part.data = charset.decode(raw, named)
            part.data = css.without_charset_rule(part.data)

    def document_charset(self, part: Part, raw: bytes, label: str | None, mark: str | None) -> str | None:
        """Reads the document again in the charset its meta elements name, and removes them."""
        if part.transfer_encoding == "base64" or "<meta" not in part.data.lower():
            return label
        now = label
        doc = markup.parse(part.data)

        def metas(kind: str) -> list[markup.Node]:
            if kind == "charset":
                return [m for m in doc.root.find("meta") if m.attrs.get("charset")]
            return [m for m in doc.root.find("meta") if m.attrs.get("http-equiv", "").lower() == "content-type"]

        changed = False
        for kind in ("charset", "content-type"):
            found = metas(kind)
            if not found:
                continue
            changed = True
            named = found[0].attrs["charset"].lower() if kind == "charset" else charset.charset_parameter(found[0].attrs.get("content"))
            if mark is None and named and named not in ("utf-8", now):
                now = named
                part.data = charset.decode(raw, now)
                part.charset = charset.codec_name(now)
                doc = markup.parse(part.data)
                found = metas(kind) + (metas("charset") if kind == "content-type" else [])
            for node in {id(n): n for n in found}.values():
                node.remove()
        if changed:
            part.data = doc.serialize()
        return now

    def again(self, label: str | None) -> None:
        """Headers of raw bytes are read in the main document's charset where UTF-8 lost characters."""
        headers = self.archive.headers
        if label in (None, "utf-8") or not any("�" in v for v in headers.values()):
            return
        other = read_headers([charset.decode(x, label) for x in self.raw])
        for name, value in headers.items():
            if "�" in value and name in other:
                headers[name] = other[name]

    def single(self, headers: dict[str, str], body: bytes) -> None:
        self.add(headers, _trim_end(body), 0)


def parse(data: bytes | str) -> Archive:
    """The archive in ``data``; damaged ones give what can be told, with anomalies."""
    if isinstance(data, str):
        data = data.encode("utf-8", "replace")
    reader = _Reader()
    a = reader.archive
    if starts_with_markup(data):
        a.anomalies.append((MISLABELED, None))
        a.headers["content-type"] = "text/html"
        reader.single(dict(a.headers), data)
        return a
    lines, start = header_block(data)
    reader.raw = lines
    a.headers = read_headers([charset.decode(x) for x in lines])
    if start < 0:
        return a
    body = data[start:]
    declared = contenttype.boundary(a.headers.get("content-type"))
    if declared and reader.multipart(body, declared.encode(), 0):
        return a
    first = body.split(b"\n", 1)[0].rstrip()
    if first.startswith(b"--") and len(first) > 2:
        if declared:
            a.anomalies.append((BOUNDARY_UNUSED, None))
        reader.multipart(body, first[2:], 0)
        return a
    if not body:
        return a
    headers = a.headers
    if contenttype.is_multipart(headers.get("content-type")):
        a.anomalies.append((NO_DELIMITERS, None))
        headers, body = _body_headers(headers, body)
    reader.single(headers, body)
    return a


def _body_headers(headers: dict[str, str], body: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of the one part left where no delimiter parts it: its own block, or what the body looks like."""
    if starts_with_markup(body):
        return {"content-type": "text/html"}, body
    lines: list[str] = []
    at = 0
    while at < len(body):
        end = body.find(b"\n", at)
        end = len(body) if end < 0 else end + 1
        line = charset.decode(body[at:end]).rstrip("\r\n")
        if not (_HEADER.match(line) or (lines and line[:1] in (" ", "\t"))):
            if not line:
                at = end
            break
        lines.append(line)
        at = end
    own = read_headers(lines)
    return (own, body[at:]) if "content-type" in own else (headers, body)
