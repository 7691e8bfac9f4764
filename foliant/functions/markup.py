"""Reading HTML into a light tree and writing it back (no Spark import).

The tree follows the HTML parsing rules that matter for archives: void, raw and escapable text elements, implied html,
head and body, implied end tags of p, li, dd, dt, option and table parts, implied table parts, formatting that is closed out of
order or left open over the end of a block, and content that stands in a table outside of its cells.
"""

from __future__ import annotations

import html
import re

#: Elements without content, and elements whose content is text.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("style script xmp iframe noembed noframes plaintext noscript".split())
_ESCAPABLE = frozenset(("title", "textarea"))
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Elements of formatting, elements that formatting is reopened in, elements that keep it inside, parts of tables.
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_SPECIAL = _CLOSES_P | frozenset("body button caption col colgroup frameset head html iframe marquee object tbody td template textarea tfoot th thead title tr".split())
_MARKERS = frozenset("applet caption marquee object td template th".split())
_TABLE = frozenset("table tbody tfoot thead tr".split())
_IN_TABLE = frozenset("caption colgroup col tbody tfoot thead tr td th style script template form".split())
_TAG = re.compile(r"</?[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_BAD_NAME = re.compile(r"[\"'>/=\s]")
_UNESCAPED = re.compile(r"(?<!\\)</|(?<!\\)/>")


class Node:
    """An element, or a text, comment or doctype if ``tag`` begins with ``#``."""

    __slots__ = ("tag", "attrs", "children", "parent", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs if attrs is not None else {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def append(self, child: "Node") -> "Node":
        child.parent = self
        self.children.append(child)
        return child

    def insert(self, at: int, child: "Node") -> "Node":
        child.parent = self
        self.children.insert(at, child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def replace(self, other: "Node") -> None:
        if self.parent is not None:
            at = next(i for i, c in enumerate(self.parent.children) if c is self)
            self.parent.children[at] = other
            other.parent, self.parent = self.parent, None

    def walk(self):
        """The elements below, in document order."""
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if not node.tag.startswith("#"):
                yield node
                stack.extend(reversed(node.children))

    def find(self, tag: str) -> list["Node"]:
        return [n for n in self.walk() if n.tag == tag]

    def own_text(self) -> str:
        return "".join(c.text for c in self.children if c.tag == "#text")


class Document:
    """A page: its doctype, and its html element with head and body."""

    def __init__(self):
        self.doctype: str | None = None
        self.root = Node("html")
        self.head: Node | None = None
        self.body: Node | None = None

    def serialize(self) -> str:
        return (self.doctype + "\n" if self.doctype else "") + serialize(self.root)


def read_attributes(text: str) -> dict[str, str]:
    """The attributes of a tag; of a name that comes twice the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        name = m[1].lower()
        if name not in out:
            value = next((v for v in m.groups()[1:] if v is not None), "")
            out[name] = html.unescape(value) if "&" in value else value
    return out


def _tag_end(text: str, at: int) -> int:
    """The offset of the tag's closing bracket; quoted values may hold one."""
    quote = ""
    before = ""
    while at < len(text):
        c = text[at]
        if quote:
            if c == quote:
                quote = ""
        elif c == ">":
            return at
        elif c in "\"'" and before == "=":
            quote = c
        if not c.isspace():
            before = c
        at += 1
    return -1


def parse(text: str) -> Document:
    """The page ``text`` describes; any text gives a page."""
    doc = Document()
    stack = [doc.root]
    at, size = 0, len(text)

    def current() -> Node:
        return stack[-1]

    def open_head() -> None:
        if doc.head is None:
            doc.head = doc.root.append(Node("head"))
            stack.append(doc.head)

    def open_body() -> None:
        if doc.body is None:
            open_head()
            del stack[1:]
            doc.body = doc.root.append(Node("body"))
            stack.append(doc.body)

    def add_text(value: str, raw: bool = False) -> None:
        if not value:
            return
        value = value if raw or "&" not in value else html.unescape(value)
        if not raw and not value.isspace():
            reopen()
        if not raw and doc.body is None and not any(n.tag in _ESCAPABLE or n.tag in RAW or n.tag == "template" for n in stack):
            if not value.strip():
                if doc.head is not None:
                    (current() if current().tag == "head" else doc.root).append(Node("#text", text=value))
                return
            open_body()
        place(Node("#text", text=value), not value.isspace())

    active: list[Node | None] = []  # open formatting, with a marker (None) for each element that keeps it inside

    def place(node: Node, foster: bool) -> Node:
        """Puts the node where it belongs: before the table if it can't stand in one."""
        if foster and current().tag in _TABLE:
            table = next(n for n in reversed(stack) if n.tag in ("table", "template") or n is stack[0])
            if table.tag == "table" and table.parent is not None:
                at_ = next(i for i, c in enumerate(table.parent.children) if c is table)
                return table.parent.insert(at_, node)
        return current().append(node)

    def reopen() -> None:
        """Formatting that the end of a block has closed goes on in the next one."""
        if not active or active[-1] is None or active[-1] in stack:
            return
        first = len(active)
        while first and active[first - 1] is not None and active[first - 1] not in stack:
            first -= 1
        for i in range(first, len(active)):
            node = Node(active[i].tag, dict(active[i].attrs))
            place(node, True)
            stack.append(node)
            active[i] = node

    def format_with(node: Node) -> None:
        """Keeps an open formatting element; of equal ones only the last three."""
        equal = []
        for other in reversed(active):
            if other is None:
                break
            if other.tag == node.tag and other.attrs == node.attrs:
                equal.append(other)
        if len(equal) >= 3:
            active.remove(equal[-1])
        active.append(node)

    def end_formatting(tag: str) -> None:
        """Closes a formatting element; blocks it was opened before and closed in keep their own copy of it."""
        if current().tag == tag and current() not in active:
            stack.pop()
            return
        for _ in range(8):
            outer = None
            for other in reversed(active):
                if other is None:
                    break
                if other.tag == tag:
                    outer = other
                    break
            if outer is None:
                return
            if outer not in stack:
                active.remove(outer)
                return
            i = stack.index(outer)
            if any(n.tag in _MARKERS or n.tag == "table" for n in stack[i + 1 :]):
                return
            block = next((n for n in stack[i + 1 :] if n.tag in _SPECIAL), None)
            if block is None:
                del stack[i:]
                active.remove(outer)
                return
            common, mark = stack[i - 1], active.index(outer)
            last, k, steps = block, stack.index(block), 0
            while True:
                steps += 1
                k -= 1
                node = stack[k]
                if node is outer:
                    break
                if steps > 3 and node in active:
                    mark -= active.index(node) < mark
                    active.remove(node)
                if node not in active:
                    del stack[k]
                    continue
                copy = Node(node.tag, dict(node.attrs))
                active[active.index(node)] = stack[k] = copy
                if last is block:
                    mark = active.index(copy) + 1
                last.remove()
                last = copy.append(last) and copy
            last.remove()
            common.append(last)
            copy = Node(outer.tag, dict(outer.attrs))
            for child in list(block.children):
                copy.append(child)
            block.children = []
            block.append(copy)
            mark -= active.index(outer) < mark
            active.remove(outer)
            active.insert(mark, copy)
            stack.remove(outer)
            stack.insert(stack.index(block) + 1, copy)

    def leave(node: Node) -> None:
        """Forgets the formatting inside an element that keeps it."""
        if node.tag in _MARKERS:
            while active and active.pop() is not None:
                pass

    while at < size:
        lt = text.find("<", at)
        if lt < 0:
            add_text(text[at:])
            break
        if lt > at:
            add_text(text[at:lt])
        at = lt
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            comment = Node("#comment", text=text[at + 4 : end if end >= 0 else size])
            if doc.head is not None or len(stack) > 1:
                current().append(comment)
            at = end + 3 if end >= 0 else size
            continue
        if text[at : at + 9].lower() == "<!doctype":
            end = text.find(">", at)
            words = text[at + 9 : end if end >= 0 else size].strip()
            if doc.doctype is None and doc.head is None:
                name = words.split(None, 1)
                doc.doctype = "<!DOCTYPE " + (name[0].lower() + (" " + name[1] if len(name) > 1 else "") if name else "html") + ">"
            at = end + 1 if end >= 0 else size
            continue
        if text.startswith(("<!", "<?"), at):
            end = text.find(">", at)
            at = end + 1 if end >= 0 else size
            continue
        m = _TAG.match(text, at)
        if not m:
            add_text("<")
            at += 1
            continue
        end = _tag_end(text, m.end())
        if end < 0:
            break  # a tag the text ends in says nothing
        closing = text[at + 1] == "/"
        tag = m[0][2 if closing else 1 :].lower()
        inside = text[m.end() : end]
        at = end + 1
        if closing:
            if tag in ("html", "body"):
                continue
            if tag == "head":
                if doc.head is not None and doc.body is None:
                    del stack[1:]
                continue
            if tag in _FORMATTING and any(n is not None and n.tag == tag for n in active):
                end_formatting(tag)
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    for n in reversed(stack[i:]):
                        leave(n)
                    del stack[i:]
                    break
                if stack[i] is doc.body:
                    break
            continue
        attrs = read_attributes(inside)
        if tag == "html":
            doc.root.attrs = {**attrs, **doc.root.attrs}
            continue
        if tag == "head":
            if doc.head is None:
                open_head()
                doc.head.attrs = attrs
            continue
        if tag in ("body", "frameset") and not any(n.tag == "template" for n in stack):
            if doc.body is None:
                open_head()
                del stack[1:]
                doc.body = doc.root.append(Node(tag, attrs))
                stack.append(doc.body)
            else:
                doc.body.attrs = {**attrs, **doc.body.attrs}
            continue
        if doc.body is None and not any(n.tag == "template" for n in stack):
            if tag in _HEAD:
                if doc.head is None:
                    open_head()
                elif current() is doc.root:
                    stack.append(doc.head)
            else:
                open_body()
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in ("button", "td", "th", "table", "body", "template", "object", "caption"):
                    break
        if tag in _IMPLIED:
            ends, stops = _IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stops or stack[i] is doc.body or stack[i].tag == "template":
                    break
                if stack[i].tag in ends:
                    for n in reversed(stack[i:]):
                        leave(n)
                    del stack[i:]
                    if tag != "tr" and not tag.startswith("t"):
                        break
                    # table parts close every open part between
                    if i > 1 and stack[-1].tag not in ends:
                        break
        if current().tag == "colgroup" and tag not in ("col", "template"):
            stack.pop()
        # parts of tables that are left out
        if tag in ("tr", "td", "th") and current().tag == "table":
            stack.append(current().append(Node("tbody")))
        if tag in ("td", "th") and current().tag in ("tbody", "thead", "tfoot"):
            stack.append(current().append(Node("tr")))
        if tag == "col" and current().tag == "table":
            stack.append(current().append(Node("colgroup")))
        if tag == "a" and any(n is not None and n.tag == "a" for n in active):
            end_formatting("a")
        if tag not in _SPECIAL and tag not in _HEAD and tag not in RAW:
            reopen()
        node = place(Node(tag, attrs), tag not in _IN_TABLE)
        if tag in _FORMATTING:
            format_with(node)
        elif tag in _MARKERS:
            active.append(None)
        if tag in VOID or (inside.rstrip().endswith("/") and any(n.tag in ("svg", "math") for n in stack)):
            continue
        if tag in RAW or tag in _ESCAPABLE:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
            stop = close.start() if close else size
            body = text[at:stop]
            if tag == "textarea" and body[:1] == "\n":
                body = body[1:]
            if body:
                node.append(Node("#text", text=html.unescape(body) if tag in _ESCAPABLE and "&" in body else body))
            after = text.find(">", stop) if close else -1
            at = after + 1 if after >= 0 else size
            continue
        stack.append(node)
        if tag in ("pre", "listing") and text.startswith("\n", at):
            at += 1  # the line end behind the tag is none of its text
    open_body()
    return doc


def escape_text(text: str) -> str:
    """Text as it is written between tags."""
    return text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attribute(text: str) -> str:
    """Text as it is written in a quoted attribute."""
    return text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")


def escape_plain(text: str) -> str:
    """Plain text shown as a page."""
    return text.replace("&", "&amp;").replace("<", "&lt;")


def escape_script(text: str) -> str:
    """Script or style text in which no closing tag can be read."""
    return _UNESCAPED.sub(lambda m: "<\\/" if m[0] == "</" else "\\/>", text)


def serialize(node: Node) -> str:
    """The markup of a node."""
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        if item.tag == "#text":
            parent = item.parent.tag if item.parent is not None else ""
            if parent in ("style", "script") and (parent == "style" or item.parent.attrs.get("type", "").lower() in ("", "text/javascript")):
                out.append(escape_script(item.text))
            else:
                out.append(item.text if parent in RAW else escape_text(item.text))
        elif item.tag == "#comment":
            out.append(f"<!--{item.text}-->")
        else:
            attrs = "".join(f' {k}="{escape_attribute(v)}"' for k, v in item.attrs.items() if not _BAD_NAME.search(k))
            out.append(f"<{item.tag}{attrs}>")
            if item.tag not in VOID:
                stack.append(f"</{item.tag}>")
                stack.extend(reversed(item.children))
    return "".join(out)
