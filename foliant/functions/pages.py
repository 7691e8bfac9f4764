"""From the parts of an archive to one self-contained page (no Spark import).

References are listed first, apart from any rewriting: ``page_references`` and ``css.references`` serve the relational
operators as well. Conversion is a pure function of the parts: nothing given to it is changed.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple
from urllib.parse import quote

from foliant.functions import charset, contenttype, css, markup, mimeheader, mime, srcset, transfer, urls
from foliant.functions.events import HANDLERS
from foliant.functions.markup import Node

#: The policy of a converted page, and relations that only hint at fetches.
POLICY = "default-src 'none'; connect-src 'self' data:; font-src 'self' data:; img-src 'self' data:; style-src 'self' 'unsafe-inline' data:; frame-src 'self' data:; media-src 'self' data:; object-src 'self' data:; "
SCRIPTS_ON, SCRIPTS_OFF = "script-src 'self' 'unsafe-inline' data:;", "script-src 'none';"
_HINTS = re.compile(r"preconnect|prerender|dns-prefetch|preload|prefetch|manifest|modulepreload", re.I)
_RESOURCE, _CANDIDATES, _BACKGROUND = ("src", "resource"), ("srcset", "candidates"), ("background", "resource")
#: What a page loads with itself: per element its attributes ("" for its text) and what they hold.
LOADS = {
    "audio": (_RESOURCE,), "body": (_BACKGROUND,), "embed": (("src", "frame"),), "frame": (("src", "frame"),), "iframe": (("src", "frame"),), "img": (_RESOURCE, _CANDIDATES), "input": (_RESOURCE,), "link": (("href", "link"),), "object": (("data", "frame"),),
    "script": (_RESOURCE,), "source": (_RESOURCE, _CANDIDATES), "style": (("", "sheet"),), "table": (_BACKGROUND,), "td": (_BACKGROUND,), "th": (_BACKGROUND,), "video": (_RESOURCE,),
}
_ORIGINAL = "data-original-"


class Reference(NamedTuple):
    """One reference of a page: where it stands, as it is written, resolved, and whether it is fetched as bytes."""

    node: Node | None
    tag: str
    attribute: str
    kind: str  # resource, stylesheet, icon, frame, css, import
    raw: str
    resolved: str
    binary: bool


@dataclass
class Page:
    data: str = ""
    title: str | None = None
    favicons: list[dict] = field(default_factory=list)
    unfound: list[str] = field(default_factory=list)
    anomalies: list[tuple[str, str | None]] = field(default_factory=list)
    error: str | None = None


def page_base(doc: markup.Document, address: str) -> tuple[str, Node | None]:
    """The address references are seen from, and the base element that says so."""
    found = doc.root.find("base")
    if found and found[0].attrs.get("href"):
        return urls.resolve(found[0].attrs["href"], address), found[0]
    return address, found[0] if found else None


def loads(node: Node) -> list[tuple[str, str]]:
    """(attribute, kind) of what the element loads; a link is a stylesheet, an icon or another link by its relation."""
    a = node.attrs
    out = [("style", "css")] if a.get("style") else []
    for attribute, kind in LOADS.get(node.tag, ()):
        value = a.get(attribute) if attribute else ""
        if attribute and not value or attribute == "background" and value.startswith("data:") or node.tag == "input" and a.get("type", "").lower() != "image":
            continue
        if kind == "link":
            rel = a.get("rel", "").lower()
            if not rel:
                continue
            kind = "stylesheet" if "stylesheet" in rel.split() else "icon" if "icon" in rel else "link"
        out.append((attribute, kind))
    return out


def page_references(doc: markup.Document, base: str) -> list[Reference]:
    """All references of a page, in document order; what stands in a template is not loaded with the page."""
    out: list[Reference] = []
    inert: set[int] = set()
    for node in doc.root.walk():
        if node.parent is not None and (node.parent.tag == "template" or id(node.parent) in inert):
            inert.add(id(node))
            continue
        for attribute, kind in loads(node):
            if kind in ("css", "sheet"):
                spans = css.references(node.attrs["style"] if kind == "css" else node.own_text())
                found = [("import" if s.kind == "import" and kind == "sheet" else "css", s.path, s.kind != "import" or kind == "css") for s in spans if not s.path.startswith("data:")]
            elif kind == "candidates":
                found = [("resource", c.url, True) for c in srcset.parse(node.attrs[attribute])]
            else:
                found = [(kind, node.attrs[attribute], kind not in ("stylesheet", "frame"))] if kind != "link" else []
            out += [Reference(node, node.tag, attribute, k, raw, urls.resolve(raw, base), binary) for k, raw, binary in found]
    return out


def sheet_references(sheet: str, base: str) -> list[Reference]:
    """All references of a style sheet."""
    return [Reference(None, "", "", "import" if s.kind == "import" else "css", s.path, urls.resolve(s.path, base), s.kind != "import") for s in css.references(sheet) if not s.path.startswith("data:")]


def lookup_keys(resolved: str, raw: str) -> list[str]:
    """The addresses a part may have for a reference, in the order in which they are tried. Fragments are not cut."""
    keys = [resolved, raw]
    if resolved.startswith("cid:"):
        keys.append(f"<{resolved[4:]}>")
    return list(dict.fromkeys(keys))


def data_address(part: mime.Part) -> str:
    """The part as a data: address; what is base64 already is taken as it is."""
    payload = part.data if part.transfer_encoding == "base64" else transfer.encode_base64(part.data.encode("utf-8", "replace"))
    return f"data:{contenttype.media_type(part.content_type)};base64,{payload}"


def part_text(part: mime.Part) -> str:
    """The part's text, also where it is still base64."""
    if part.transfer_encoding == "base64":
        raw = transfer.decode_base64(part.data)
        return charset.decode(raw, charset.charset_parameter(part.content_type)) if raw is not None else part.data
    return part.data


def page_info(headers: dict[str, str], address: str) -> str:
    """What the archive's headers tell of the page, as JSON."""
    info: dict = {"@context": "https://schema.org", "@type": "WebPage", "additionalProperty": {"@type": "PropertyValue", "name": "savedBy", "value": mimeheader.decode_header(headers.get("from"))}, "url": address, "name": mimeheader.decode_header(headers.get("subject"))}
    if headers.get("date") is not None:
        info["dateCreated"] = headers["date"]
    return json.dumps(info, indent=2, ensure_ascii=False)


class _Converter:
    def __init__(self, archive: mime.Archive, scripts: bool):
        self.parts, self.scripts = archive.parts, scripts
        self.found, self.frames = archive.addresses()
        self.sheets: dict[int, str | None] = {}
        self.unfound: dict[str, None] = {}

    def part(self, resolved: str, raw: str) -> mime.Part | None:
        return next((self.parts[self.found[k]] for k in lookup_keys(resolved, raw) if k in self.found), None)

    def miss(self, address: str) -> str:
        if not address.startswith("data:"):
            self.unfound.setdefault(address)
        return address

    def sheet_text(self, text: str, base: str) -> str:
        """A style sheet with its references inlined."""

        def replace(span: css.Span) -> str | None:
            if span.path.startswith("data:"):
                return None
            address = urls.resolve(span.path, base)
            part = self.part(address, span.path)
            if part is None:
                return css.url_token(self.miss(address), address)
            return css.url_token(data_address(self.with_sheet(part) if span.kind == "import" or contenttype.is_stylesheet(part.content_type) else part), address)

        try:
            return css.rewrite(text, replace)
        except (ValueError, RecursionError):
            return text

    def with_sheet(self, part: mime.Part, base: str | None = None) -> mime.Part:
        """The part with its own sheet rewritten, once; a sheet that imports itself is left as it is on the way."""
        if part.ordinal not in self.sheets:
            self.sheets[part.ordinal] = None
            self.sheets[part.ordinal] = self.sheet_text(part_text(part), base or part.id)
        text = self.sheets[part.ordinal]
        return part if text is None else mime.Part(part.ordinal, part.id, part.written_id, part.content_id, part.content_type, None, text)

    def page(self, part: mime.Part, address: str, headers: dict[str, str] | None, open_frames: tuple[int, ...], sheet_base: str | None = None) -> Page:
        doc = markup.parse(part_text(part))
        base, base_node = page_base(doc, part.id)
        if base_node is not None:
            base_node.remove()
        result = Page()
        removed: list[Node] = []
        canonical = False
        for node in list(doc.root.walk()):
            for attribute, kind in loads(node):
                if kind == "css":
                    node.attrs["style"] = self.sheet_text(node.attrs["style"], base)
                elif kind == "sheet":
                    self.style(node, base)
                elif kind == "candidates":
                    self.candidates(node, base)
                elif kind == "resource":
                    self.inline(node, attribute, base)
                elif kind == "frame":
                    self.frame(node, attribute, base, open_frames)
                else:
                    canonical |= self.link(node, base, address, result, removed, sheet_base)
            if self.sanitise(node, base):
                removed.append(node)
            if node.tag == "title" and node.parent is doc.head and result.title is None and node.own_text():
                result.title = node.own_text()
        for node in removed:
            node.remove()
        head = doc.head
        if not canonical:
            head.append(Node("link", {"rel": "canonical", "href": address}))
        head.insert(0, Node("meta", {"http-equiv": "content-security-policy", "content": POLICY + (SCRIPTS_ON if self.scripts else SCRIPTS_OFF)}))
        head.insert(0, Node("meta", {"charset": "utf-8"}))
        if headers is not None:
            script = head.insert(1, Node("script", {"type": "application/ld+json"}))
            script.append(Node("#text", text=page_info(headers, address).replace("</", "<\\/")))
        result.data = doc.serialize()
        return result

    def sanitise(self, node: Node, base: str) -> bool:
        """Takes from an element what a saved page must not do; True for one that must go."""
        a = node.attrs
        a.pop("integrity", None)
        if not self.scripts:
            for name in [n for n in a if n in HANDLERS]:
                del a[name]
        if node.tag in ("a", "area"):
            a.pop("ping", None)
            if a.get("href"):
                a["href"] = urls.same_page(a["href"], base)
        if node.tag == "template" and a.get("shadowmode"):
            a["shadowrootmode"] = a.pop("shadowmode")
        if node.tag == "script":
            return not self.scripts and a.get("type", "").lower() != "application/ld+json"
        return node.tag == "meta" and a.get("http-equiv", "").lower() in ("refresh", "content-security-policy")

    def style(self, node: Node, base: str) -> None:
        text = self.sheet_text(node.own_text(), base)
        node.attrs = {k: node.attrs[k] for k in ("media", "title") if node.attrs.get(k)}
        node.children = []
        node.append(Node("#text", text=text))

    def candidates(self, node: Node, base: str) -> None:
        out = []
        for c in srcset.parse(node.attrs["srcset"]):
            resolved = urls.resolve(c.url, base)
            found = self.part(resolved, c.url)
            out.append(c._replace(url=data_address(found) if found else self.miss(resolved)))
        self.set(node, "srcset", srcset.serialize(out))

    def set(self, node: Node, attribute: str, value: str | None) -> None:
        """Sets an attribute and keeps the address it had."""
        old = node.attrs.get(attribute)
        if old and not old.startswith("data:") and old != value:
            node.attrs[_ORIGINAL + attribute] = old
        if value is not None:
            node.attrs[attribute] = value

    def inline(self, node: Node, attribute: str, base: str, change: Callable[[mime.Part], mime.Part] = lambda p: p) -> mime.Part | None:
        raw = node.attrs[attribute]
        resolved = urls.resolve(raw, base)
        part = self.part(resolved, raw)
        self.set(node, attribute, data_address(change(part)) if part else self.miss(resolved))
        return part

    def link(self, node: Node, base: str, address: str, result: Page, removed: list[Node], sheet_base: str | None) -> bool:
        """A link element; True for a canonical one."""
        a = node.attrs
        rel = a["rel"].lower()
        words, raw = rel.split(), a["href"]
        resolved = urls.resolve(raw, base)
        canonical = False
        if "stylesheet" in words:
            part = self.part(resolved, raw)
            if part is None:
                self.set(node, "href", self.miss(resolved))
            else:
                # a sheet addressed by its Content-ID has no address of its own to resolve against
                home = part.id
                if home.startswith("cid:"):
                    home = sheet_base if re.fullmatch(r"<.+>", address) and sheet_base else address
                sheet = self.with_sheet(part, home)
                if a.get("title") or "alternate" in words:
                    self.set(node, "href", data_address(sheet))
                else:
                    style = Node("style", {"media": a["media"]} if a.get("media") else {})
                    if not resolved.startswith("data:"):
                        style.attrs[_ORIGINAL + "href"] = resolved
                    style.append(Node("#text", text=part_text(sheet)))
                    node.replace(style)
                    return False
        elif "icon" in rel:
            part = self.inline(node, "href", base)
            icon = {"href": a["href"], "original_href": resolved if part else None, "media": a.get("media"), "type": a.get("type"), "sizes": a.get("sizes")}
            result.favicons.append(icon)
        elif rel == "canonical":
            canonical = True
        kept = _HINTS.sub("", rel).strip()
        if kept:
            a["rel"] = kept
        else:
            removed.append(node)
        return canonical

    def frame(self, node: Node, attribute: str, base: str, open_frames: tuple[int, ...]) -> None:
        raw = node.attrs[attribute]
        resolved = urls.resolve(raw, base)
        if resolved.startswith("cid:"):
            number = self.frames.get(f"<{resolved[4:]}>")
            part = self.parts[number] if number is not None else None
        else:
            part = self.part(resolved, raw)
        if part is None:
            self.set(node, attribute, self.miss(resolved))
        elif node.tag in ("embed", "object") or contenttype.is_media(part.content_type) or part.ordinal in open_frames:
            self.set(node, attribute, data_address(part))
        else:
            own = f"<{resolved[4:]}>" if resolved.startswith("cid:") else resolved
            inner = self.page(part, own, None, (*open_frames, part.ordinal), part.id)
            if node.tag == "iframe":
                self.set(node, "src", None)
                del node.attrs["src"]
                node.attrs["srcdoc"] = inner.data
            else:
                self.set(node, attribute, "data:text/html," + quote(inner.data, safe="!'()*~-_."))


def synthesized(parts: list[mime.Part]) -> mime.Part | None:
    """The page a browser shows for an archive without a document: its first image or plain text."""
    for p in parts:
        if contenttype.is_image(p.content_type):
            body = f'<html><body><img src="{data_address(p)}"></body></html>'
        elif contenttype.is_plain_text(p.content_type):
            body = f"<html><body><pre>{markup.escape_plain(part_text(p))}</pre></body></html>"
        else:
            continue
        return mime.Part(p.ordinal, p.id, p.written_id, p.content_id, "text/html", None, body)
    return None


def convert(archive: mime.Archive, scripts: bool = False) -> Page:
    """The archive as one page. An archive without anything to show gives an error, never an exception."""
    # frames may be nested as deep as an archive has parts
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000 + 50 * len(archive.parts)))
    converter = _Converter(archive, scripts)
    anomalies = list(archive.anomalies)
    part = archive.parts[archive.index] if archive.index is not None else None
    if part is None:
        part = synthesized(archive.parts)
        if part is None:
            return Page(anomalies=anomalies, error="Index page not found")
        anomalies.append((mime.SYNTHESIZED, part.id))
    page = converter.page(part, part.id, archive.headers, (part.ordinal,))
    page.unfound, page.anomalies = list(converter.unfound), anomalies
    return page
