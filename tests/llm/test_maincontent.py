from foliant.llm import maincontent as m
from foliant.llm.blocks import read_blocks

PROSE = "The choir measured the water level each morning, and it kept a list. The old mill was closed for the winter."
SITES = ["alpha", "beta", "gamma", "delta"]


def page(site, n, layout):
    menu = "<ul>" + "".join(f'<li><a href="/{i}">Menu {i}</a></li>' for i in range(4)) + "</ul>"
    title = f"Story number {n} about the long winter of {1900 + n}"
    name = "".join("abcdefghij"[int(c)] for c in str(n)) * 3
    body = f"<h1>{title}</h1><p>{PROSE} Part {name} of {site}.</p><p>Share this page with a friend.</p><ul><li>First point of story {n}</li><li><a href='/x'>Second point of story {n}</a></li></ul><p>{PROSE} End {name} of {site}.</p>"
    side = '<h3>Most read</h3><ul><li><a href="/r/1">The garden committee asked for a quieter bell</a></li><li><a href="/r/2">The ferry crew lost the ledger again</a></li></ul>'
    foot = f"<p>© 2024 {site.title()} News. All rights reserved.</p>" + menu
    if layout == "flat":
        return title, f"<html><body>{menu}{body}{side}{foot}</body></html>"
    return title, f'<html><body><div class="m">{menu}</div><div class="c">{body}</div><div class="s">{side}</div><div class="f">{foot}</div></body></html>'


def test_articles_only(spark):
    rows = []
    for k, site in enumerate(SITES):
        for n in range(4):
            title, html = page(site, 10 * k + n, "flat" if k % 2 else "boxed")
            rows.append((f"{site}{n}", f"{site}.example", f"{title} | {site.title()} News", html, "x"))
    # the message stands alone in parts, in pages it has the site around it
    parts = spark.createDataFrame([(f"p{i}", 0, f"h{i}.example", "text/plain", "Page not found. Nothing is here.") for i in range(4)], "archive_id string, part_no int, host string, content_type string, data string")
    rows += [rows[0], ("null", "x.example", None, None, "x"), ("empty", "x.example", "T", "", "x"), ("junk", "y.example", "404", "<html><body><h1>404</h1><p>Page not found. Nothing is here.</p></body></html>", "x")]
    rows.append(("bare", "z.example", None, rows[0][3].replace("Story number 0", "Another story")[:], "x"))
    pages = spark.createDataFrame(rows, "archive_id string, host string, title string, data string, tag string")
    got: dict = {}
    for r in m.article_blocks(pages, parts).collect():
        got.setdefault(r["archive_id"], []).append(r["block_no"])
    assert set(got) == {f"{s}{n}" for s in SITES for n in range(4)} | {"bare"}
    for found in got.values():
        assert sorted(found) == [4, 5, 7, 8, 9]


def test_scores_choose_the_container_behind_a_headline():
    def found(body, title="A long winter at the mill"):
        return m.choose(m.page_features(read_blocks(f"<html><body>{body}</body></html>"), title), set(), set())

    head, text = "<h1>A long winter at the mill</h1><p>By Ann Lee, staff.</p>", f"<p>{PROSE}</p><p>{PROSE} More.</p>"
    side = '<h3>Most read</h3><ul><li><a href="/1">The garden committee asked for a quieter bell</a></li></ul>'
    menu = '<div class="m"><ul><li><a href="/1">Home</a></li></ul></div>'
    # the body in a container beside that of the headline
    assert found(f'{menu}<header>{head}</header><div class="body">{text}</div><div class="s">{side}</div>') == [1, 2, 3, 4]
    assert found(f'{menu}<header>{head}</header><section class="t">{text}</section><div class="s">{side}</div><section class="t">{text}</section>') == [1, 2, 3, 4, 7, 8]
    # the body behind a side column, without containers
    assert found(f"{head}{side}{text}") == [0, 1, 4, 5]
    # a headline that isn't the title's, behind other text
    assert found(f"<h1>Mill News</h1><p>We use cookies here.</p>{side}<h2>Another tale of winter</h2>{text}", None) == [4, 5, 6]


def test_blocks_are_numbered_in_document_order():
    blocks = read_blocks("<html><head><title>t</title><script><p>no</p></script></head><body><!-- <p>no</p> --><h1>a</h1><div id=x><p>b <a href='#'>c</a></p><ul><li>d</li></ul></div><pre>e\n f</pre><figcaption>g</figcaption></body></html>")
    assert [(b.tag, b.text) for b in blocks] == [("h1", "a"), ("p", "b c"), ("li", "d"), ("pre", "e f"), ("figcaption", "g")]
    assert blocks[1].path == "div.x/p" and round(blocks[1].link, 2) == 0.33


def test_empty_table(spark):
    pages = spark.createDataFrame([], "archive_id string, host string, title string, data string")
    assert m.article_blocks(pages).count() == 0


def test_long_lines_repeat_as_well(spark):
    notice = "We and our partners keep small files on your device and read them to measure how this site is used. " * 30
    rows = []
    for n in range(4):
        title, html = page("alpha", n, "flat")
        rows.append((f"a{n}", "alpha.example", title, html.replace("<h1>", f"<p>{notice}</p><h1>", 1).replace("<h3>", f"<p>{notice}</p><h3>", 1)))
    got: dict = {}
    for r in m.article_blocks(spark.createDataFrame(rows, "archive_id string, host string, title string, data string")).collect():
        got.setdefault(r["archive_id"], []).append(r["block_no"])
    assert {k: sorted(v) for k, v in got.items()} == {f"a{n}": [5, 6, 8, 9, 10] for n in range(4)}
