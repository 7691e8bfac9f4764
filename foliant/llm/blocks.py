"""Reading a page into its text blocks and the containers they stand in (no Spark import)."""

from __future__ import annotations

import html
import re

BLOCK_TAGS = ("h1", "h2", "h3", "p", "li", "blockquote", "pre", "figcaption")
_DROP = re.compile(r"<(script|style|template|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_TOKEN = re.compile(r"<(h1|h2|h3|p|li|blockquote|pre|figcaption)>([^<]*(?:<(?!/\1\s*>)[^<]*)*)(?:</\1\s*>|\Z)|<(/?)(?!(?:ul|ol|tr|td|th|tbody|a|b|i|em|strong|span|html|head|body|meta|link|br|img|hr|input|title|noscript|h[1-6]|p|li)\b)([a-zA-Z][\w:-]*)([^<>]*)>", re.S)
_LINK = re.compile(r"<a\b[^>]*>(.*?)</a\s*>", re.S | re.I)
_TAG = re.compile(r"<[^<>]*>")
_NAME = re.compile(r"""(?:id|class|role)\s*=\s*["']?([^"'>]*)""", re.I)
_SPACE = re.compile(r"\s+")


def plain(markup: str) -> str:
    """The text of a piece of markup, spaces folded."""
    if "<" in markup:
        markup = _TAG.sub("", markup)
    if "&" in markup:
        markup = html.unescape(markup)
    markup = markup.strip()
    return _SPACE.sub(" ", markup) if "\n" in markup or "  " in markup or "\t" in markup else markup


class Block:
    """One text element: its tag, text, share of link text, path of containers, their numbers from the outermost on, markup."""

    __slots__ = ("tag", "text", "link", "path", "chain", "label", "raw")

    def __init__(self, tag: str, text: str, link: float, path: str, chain: tuple[int, ...], label: bool, raw: str):
        self.tag, self.text, self.link, self.path, self.chain, self.label, self.raw = tag, text, link, path, chain, label, raw


def read_blocks(page: str) -> list[Block]:
    """The page's blocks in document order."""
    start = page.find("<body")
    if start > 0:
        page = page[start:]
    if "<script" in page or "<style" in page or "<!--" in page or "<template" in page or "<textarea" in page:
        page = _DROP.sub("", page)
    blocks: list[Block] = []
    stack: list[tuple[str, str, int]] = []
    path, chain, boxes = "", (), 0
    for tag, body, closing, name, rest in _TOKEN.findall(page):
        if tag:
            link, label = 0.0, False
            if "<" not in body:
                text = plain(body)
            elif body.startswith("<a ") and body.endswith("</a>") and body.count("<a") == 1:
                text, link = plain(body), 1.0
            else:
                text = plain(body)
                if "<a" in body and text:
                    link = min(1.0, sum(len(plain(x)) for x in _LINK.findall(body)) / len(text))
                    label = body.startswith(("<b>", "<strong>")) and body.endswith("</a>") and link > 0.3
            blocks.append(Block(tag, text, link, f"{path}/{tag}", chain, label, body))
            continue
        name = name.lower()
        if closing:
            while stack:
                if stack.pop()[0] == name:
                    break
        elif rest[-1:] != "/":
            boxes += 1
            found = _NAME.search(rest) if rest else None
            stack.append((name, f"{name}.{found[1].strip()}" if found else name, boxes))
        path = "/".join(x[1] for x in stack)
        chain = tuple(x[2] for x in stack)
    return blocks
