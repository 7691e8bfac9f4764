"""Words of the usual filler and forms of unfilled slots. Fixed values, all of them."""

from __future__ import annotations

import re

#: Words of the common pseudo-Latin filler.
FILLER_WORDS = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo "
    "consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "massa vitae porta lacus viverra vestibulum mauris tellus pellentesque maecenas nunc vel urna".split()
)

#: Slots a template engine or an editor leaves unfilled.
SLOTS = (
    r"\{\{[^{}\n]{1,60}\}\}", r"\{%[^{}\n]{1,60}%\}", r"\$\{[A-Za-z_][\w.]*\}", r"#\{[A-Za-z_][\w.]*\}", r"\[\[[A-Z][A-Z0-9_]*\]\]", r"%%[A-Z][A-Z0-9_]*%%", r"@@[A-Z][A-Z0-9_]*@@", r"__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__",
    r"\*\|[A-Z][A-Z0-9_]*\|\*", r"%\([a-z_]\w*\)[sdf]", r"<%=?[^<>%\n]{1,60}%>", r"&lt;%=?[^<>%\n]{1,60}%&gt;", r"\[(?:[Yy]our|YOUR|[Ii]nsert|INSERT) [^\]\n]{1,40}\]", r"(?:<|&lt;)(?:INSERT|YOUR) [A-Z_ ]{1,40}(?:>|&gt;)",
    r"\[object Object\]", r"(?<![\w{$#])\{[a-z][a-z0-9]*(?:_[a-z0-9]+)*\}(?![\w}])",
)

SLOT_RE = re.compile("|".join(SLOTS))
