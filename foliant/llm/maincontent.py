"""Problem 5: the main body of a page, without menus, notices, side columns, promotions and footers.

Method: tag-path ratios. Text length and punctuation are summed per root-to-leaf path, smoothed along the page, fused, and
the paths above the threshold select content nodes and with them the container that holds the article, on every page; the
headline that stands in the title only says where it begins. Lines that come
back on a host's pages, or on the pages of many hosts, are boilerplate wherever they stand; their counts cover all pages.
Blocks outside of containers are parted at side columns instead, and these parts are scored as containers are.

Stages: (1) one reading of every page into compact block features, kept as a table; (2) counts of lines per host and over
hosts; (3) the decision per page from its features and the repeated lines of its host. No stage holds a host in one task:
lines are counted with map-side combination and joined back, which AQE may split for a hot host.

Defined results: null or empty pages give no rows; a null title is replaced by the first heading that isn't the site's;
repeated rows count once; pages that are cases of problem 3 give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.blocks import BLOCK_TAGS, Block, read_blocks
from foliant.llm.residue import LEAF, Tree, batch_of, holders, mined, part_values, read_page
from foliant.runtime import materialize

#: A line is boilerplate of a host if it stands under this share of its different headlines, and under two at least.
HOST_SHARE = 0.15
#: ... and of the web if it stands on the pages of this share of all hosts, and of three at least.
WEB_SHARE, WEB_HOSTS = 0.004, 3
#: Blocks whose fused score is below this share of the mean of their page are no content nodes.
THRESHOLD = 0.02

_TAG_NO = {t: i for i, t in enumerate(BLOCK_TAGS)}
_H1, _H2, _H3, _P, _LI, _QUOTE, _PRE, _CAPTION = range(8)
_DIGITS = re.compile(r"\d+")
_PROPER = re.compile(r" [A-ZÀ-ÖØ-Þ]\w*")
_LEAD = re.compile(r"^[A-ZÀ-ÖØ-Þ][a-z]+(?: [A-ZÀ-ÖØ-Þ][a-z]+)*(?=,)")
_PUNCT = (".", ",", ";", ":", "!", "?", "…", "。", "、")
_SUFFIX = re.compile(r"\s+[|–—·-]\s+[^|–—·]{1,60}$")


_LISTS = {"tag": pa.int8(), "size": pa.int32(), "punct": pa.int32(), "link": pa.int8(), "words": pa.int32(), "box": pa.int32(), "path": pa.int32(), "line": pa.int64(), "web": pa.int64(), "flag": pa.int8()}


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def line_keys(text: str) -> tuple[int, int]:
    """Keys of a line as it stands on one host, and with digits and proper names masked, as it stands on many."""
    same = _DIGITS.sub("0", text)
    masked = _PROPER.sub(" N", _LEAD.sub("N", same))
    if "N N" in masked:
        masked = re.sub(r"N(?: N)+", "N", masked)
    return _key(same), _key(masked)


def page_features(blocks: list[Block], title: str | None) -> dict:
    """What the decision needs of a page, as parallel lists over its blocks."""
    depth = 0
    while blocks and all(len(b.chain) > depth for b in blocks) and len({b.chain[depth] for b in blocks}) == 1:
        depth += 1
    bare = _SUFFIX.sub("", title) if title else ""
    site = title[len(bare):].strip(" |–—·-") if title else ""
    rows = []
    headline, best = -1, 0
    for i, b in enumerate(blocks):
        tag, text, link = _TAG_NO[b.tag], b.text, b.link
        size = len(text)
        same = web = flag = punct = 0
        box = b.chain[depth] if len(b.chain) > depth else 0
        if tag == _LI:
            words = text.count(" ") + 1 if " " in text or text.isascii() else 1 + size // 4
            rows.append((tag, size, 0, int(100 * link), words, box, b.path, 0, 0, 2 if b.label else 0))
            continue
        if tag <= _P and link < 0.9 and size:
            same, web = line_keys(text)
        # 1 crumb, 2 label with a link, 4 the title's own text, 8 the site's name, 16 numbered or signed line
        if b.label:
            flag = 2
        if tag == _P:
            punct = sum(map(text.count, _PUNCT))
            if size < 160:
                if text[-1:] not in ".!?" and ("›" in text or " > " in text or ("»" in text and "«" not in text)):
                    flag |= 1
                if size < 100 and ("©" in text or _DIGITS.search(text)):
                    flag |= 16
        elif tag == _QUOTE:
            punct = sum(map(text.count, _PUNCT))
        elif tag <= _H2 and text:
            if title and (text == bare or text == title or (size > 12 and title.startswith(text))):
                flag |= 4
                if size > best:
                    headline, best = i, size
            elif text == site:
                flag |= 8
        words = text.count(" ") + 1 if " " in text or text.isascii() else 1 + size // 4
        rows.append((tag, size, punct, int(100 * link), words, box, b.path, same, web, flag))
    keys = {p: _key(p) & 0x7FFFFFFF for p in {r[6] for r in rows}}
    out: dict = dict(zip(_LISTS, zip(*rows))) if rows else {k: [] for k in _LISTS}
    out["path"] = [keys[p] for p in out["path"]]
    head = blocks[headline].text if headline >= 0 else bare or next((b.text for b in blocks if b.tag in ("h1", "h2") and " " in b.text), "")
    out["headline"] = headline
    out["about"] = _key(head)
    return out


def _runs(tag: list[int]) -> list[tuple[int, int]]:
    """Runs of list items, as half-open ranges."""
    runs, i = [], 0
    while i < len(tag):
        if tag[i] == _LI:
            j = i
            while j < len(tag) and tag[j] == _LI:
                j += 1
            runs.append((i, j))
            i = j
        else:
            i += 1
    return runs


def choose(f: dict, host_lines: set[int], web_lines: set[int]) -> list[int]:
    """The numbers of the blocks that belong to the article."""
    tag, size, link, words, box, flag = (f[k] for k in ("tag", "size", "link", "words", "box", "flag"))
    n = len(tag)
    head = f["headline"]
    common = [
        bool(flag[i] & 3)
        or (f["line"][i] != 0 and ((tag[i] in (_P, _H3) and (f["line"][i] in host_lines or f["web"][i] in web_lines)) or (tag[i] <= _H2 and (head < 0 or i < head) and i + 1 < n and tag[i + 1] == _LI and f["line"][i] in host_lines)))
        for i in range(n)
    ]
    for i in range(n):  # the article's own headline is never boilerplate
        if flag[i] & 4:
            common[i] = False
        elif flag[i] & 8:
            common[i] = True
    menu = [False] * n
    side_start = [False] * n
    for a, b in _runs(tag):
        linked = all(link[i] >= 90 for i in range(a, b))
        short = sum(words[i] for i in range(a, b)) <= 3.2 * (b - a)
        before = a - 1
        if linked and (short or (before >= 0 and tag[before] == _H3)):
            menu[a:b] = [True] * (b - a)
            if before >= 0 and tag[before] == _H3:
                common[before] = side_start[before] = True
        elif short and all(link[i] == 0 for i in range(a, b)) and before >= 0 and common[before] and tag[before] == _P:
            menu[a:b] = [True] * (b - a)  # the buttons of a notice
    # a line just before the last menu is the footer's, whatever it says
    last = n
    while last > 0 and (menu[last - 1] or common[last - 1]):
        last -= 1
    if last < n and menu[last] and last > 0 and tag[last - 1] == _P and size[last - 1] < 100 and flag[last - 1] & 16 and not link[last - 1]:
        common[last - 1] = True
    good = [not common[i] and not menu[i] and size[i] > 0 for i in range(n)]

    # tag-path ratios: text and punctuation per path, link text and repeated lines left out
    text: dict[int, float] = {}
    marks: dict[int, float] = {}
    nodes: dict[int, int] = {}
    for i in range(n):
        p = f["path"][i]
        nodes[p] = nodes.get(p, 0) + 1
        if good[i]:
            text[p] = text.get(p, 0.0) + size[i] * (100 - link[i]) / 100
            marks[p] = marks.get(p, 0.0) + f["punct"][i]
    ratio = [text.get(p, 0.0) / nodes[p] * (1.0 + marks.get(p, 0.0) / nodes[p]) for p in f["path"]]
    own = [ratio[i] * (0.2 + size[i] / (1.0 + text.get(f["path"][i], 0.0) / nodes[f["path"][i]])) if good[i] else 0.0 for i in range(n)]
    # smoothed over what is neither a menu nor a repeated line; a list is as near to the text around it as its ends
    kept = [i for i in range(n) if good[i]]
    around = [0.0, *(own[i] for i in kept), 0.0]
    smooth = [0.0] * n
    for k, i in enumerate(kept):
        smooth[i] = 0.25 * around[k] + 0.5 * around[k + 1] + 0.25 * around[k + 2]
    for a, b in _runs([tag[i] for i in kept]):
        edge = 0.25 * max(around[a], around[b + 1])
        for i in kept[a:b]:
            smooth[i] = max(smooth[i], edge)
    mean = sum(smooth) / max(1, n)
    node = [smooth[i] > THRESHOLD * mean for i in range(n)]

    # a part is a container, or the blocks outside of containers up to the next side column
    part, columns = [], 0
    for i in range(n):
        columns += side_start[i]
        part.append(box[i] or -columns)
    content = [node[i] and tag[i] in (_P, _QUOTE, _PRE, _LI, _CAPTION) and smooth[i] >= 0.5 * mean for i in range(n)]
    score: dict[int, float] = {}
    sided: set[int] = set()
    for i in range(n):
        if content[i]:
            score[part[i]] = score.get(part[i], 0.0) + size[i] * (100 - link[i]) / 100
        if side_start[i] and box[i]:
            sided.add(box[i])

    # the scores choose the part; the title's headline only says where the article begins, and that it doesn't end before
    start = f["headline"]
    own_part = part[start] if start >= 0 else None
    open_to = {p: s for p, s in score.items() if p not in sided or p == own_part}
    open_to = {p: s for p, s in open_to.items() if p in part[max(start, 0) :]} or open_to
    home = max(open_to, key=lambda p: open_to[p]) if open_to else own_part
    if home is None:
        return []
    if start < 0:
        heads = [i for i in range(n) if part[i] == home and tag[i] <= _H2 and good[i] and words[i] >= 2]
        start = heads[0] if heads else next(i for i in range(n) if part[i] == home and (home > 0 or content[i]))
        # text above the first subheading belongs to the article too, down from the last thing that doesn't
        if tag[start] != _H1:
            while start > 0 and good[start - 1] and part[start - 1] == home and tag[start - 1] in (_P, _QUOTE, _PRE, _CAPTION, _LI):
                start -= 1
    # other containers behind the beginning that hold content nodes of the same paths continue the article
    paths = {f["path"][i] for i in range(n) if content[i] and part[i] == home}
    more = {part[i] for i in range(start, n) if home > 0 and part[i] > 0 and part[i] not in sided and content[i] and f["path"][i] in paths}
    begin = dict.fromkeys(more, 0) | {own_part: start} | {home: start if home <= 0 and part[start] == home else 0}
    return [i for i in range(n) if node[i] and i >= begin.get(part[i], n)]


_FEATURES = {"archive_id": pa.string(), "host": pa.string(), "about": pa.int64(), "headline": pa.int32(), **{k: pa.list_(t) for k, t in _LISTS.items()}, "found": pa.bool_(), "keys": pa.list_(pa.int64())}
_NAMES = {pa.string(): "string", pa.int8(): "tinyint", pa.int32(): "int", pa.int64(): "bigint", pa.bool_(): "boolean"}
_DDL = ", ".join(f"{k} array<{_NAMES[t.value_type]}>" if pa.types.is_list(t) else f"{k} {_NAMES[t]}" for k, t in (_FEATURES | LEAF).items())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One reading of each page gives its features and, for problem 3, its statements' leaves."""
    tree = Tree()
    schema = _FEATURES | LEAF
    for batch in batches:
        rows = []
        for archive, host, title, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
            blocks = read_blocks(data)
            slot, filler, *read = read_page(data, blocks)
            rows.append({"archive_id": archive, "host": host or "", **page_features(blocks, title), "found": slot or filler, "keys": tree.read(*read, host, archive)})
        yield batch_of(schema, {k: [r[k] for r in rows] for k in _FEATURES})
    yield batch_of(schema, tree.flush())


def read_pages(pages: DataFrame) -> DataFrame:
    """The features of every page that has data, and the leaves of their statements' tree (leaf set), kept as a table."""
    rows = pages.filter(F.col("data").isNotNull()).select("archive_id", "host", "title", "data")
    return materialize(rows.mapInArrow(_read, _DDL), "pages")


def repeated_lines(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, lines) and (web,): the lines that come back on a host and on the web.

    Both are bounded: a host has at most 1/HOST_SHARE times the mean lines of a page, the web 1/WEB_SHARE times those of a host.
    """
    lines = features.select("host", "about", F.explode(F.arrays_zip("line", "web")).alias("l")).select("host", "about", F.col("l.line").alias("line"), F.col("l.web").alias("web")).filter("line != 0")
    once = lines.groupBy("host", "line", "web", "about").agg(F.lit(1).alias("one")).drop("one")
    topics = features.select("host", "about").distinct().groupBy("host").agg(F.count("*").alias("topics"))
    per_host = once.groupBy("host", "line").agg(F.count("*").alias("n"))
    at_least = F.greatest(F.when(F.col("topics") > 10, F.lit(3)).otherwise(F.lit(2)), F.ceil(F.col("topics") * HOST_SHARE))
    hosts = per_host.filter("n >= 2").join(topics, "host").filter(F.col("n") >= at_least).groupBy("host").agg(F.collect_list("line").alias("lines"))
    per_web = once.filter("web != 0").select("host", "web").distinct().groupBy("web").agg(F.count("*").alias("n"))
    n_hosts = features.agg(F.count_distinct("host")).first()[0]
    web = per_web.filter(F.col("n") >= max(WEB_HOSTS, WEB_SHARE * n_hosts)).select("web")
    return hosts, web


def _decide(web_lines: set[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(_LISTS)
        for batch in batches:
            cols = {name: batch.column(name).to_pylist() for name in ("archive_id", "headline", "lines", *names)}
            ids: list[str] = []
            numbers: list[int] = []
            for k in range(batch.num_rows):
                f = {name: cols[name][k] for name in names}
                f["headline"] = cols["headline"][k]
                chosen = choose(f, set(cols["lines"][k] or ()), web_lines)
                ids += [cols["archive_id"][k]] * len(chosen)
                numbers += chosen
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(numbers, pa.int32())], names=["archive_id", "block_no"])

    return run


def article_blocks(pages: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(archive_id, block_no) of the blocks that belong to each page's article; pages of residue give none.

    Messages stand alone in parts much more often than in pages with their menus: ``parts`` tells them apart.
    """
    table = read_pages(pages)
    features = table.filter("leaf IS NULL").select(*_FEATURES)
    leaves = table.filter("leaf IS NOT NULL").select(*LEAF)
    if parts is not None:
        leaves = leaves.unionByName(mined(part_values(parts)).filter("leaf IS NOT NULL").select(*LEAF))
    hosts, web = repeated_lines(features)
    # at most a page's mean number of lines / WEB_SHARE rows, a few thousand numbers at any size
    web_lines = {r[0] for r in web.collect()}
    residue = holders(features, leaves, "archive_id")
    kept = features.drop("found", "keys").join(residue, "archive_id", "left_anti").join(hosts, "host", "left")
    return kept.mapInArrow(_decide(web_lines), "archive_id string, block_no int").distinct()
