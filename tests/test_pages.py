import pytest

from foliant.functions import mime, pages
from tests.test_mime import archive, part


def convert(html, *parts, head="", scripts=False, headers=b""):
    page = part(f"<html><head>{head}</head><body>{html}</body></html>".encode(), "text/html", location="https://e.com/p")
    return pages.convert(mime.parse(archive(page, *parts, headers=headers)), scripts)


PNG = part(b"iVBORw0K", "image/png", "base64", "https://e.com/i.png")
DATA = "data:image/png;base64,iVBORw0K"


def test_images_srcset_and_backgrounds():
    p = convert('<img src="i.png" srcset="i.png 2x, no.png 3x"><table background="/i.png"></table><input type=IMAGE src=i.png><video poster="i.png"></video>', PNG)
    assert f'src="{DATA}"' in p.data and f'srcset="{DATA} 2x, https://e.com/no.png 3x"' in p.data and f'background="{DATA}"' in p.data
    assert 'data-original-src="i.png"' in p.data and 'poster="i.png"' in p.data
    assert p.unfound == ["https://e.com/no.png"]


def test_fragments_are_not_cut_from_references():
    assert convert('<img src="i.png#x">', PNG).unfound == ["https://e.com/i.png#x"]


def test_style_sheets():
    sheet = part(b'@charset "utf-8"; @import "t.css"; a{b:url(i.png)}', "text/css", location="https://e.com/s/s.css")
    other = part(b"c{d:url(../i.png)} @import url(s.css);", "text/css", location="https://e.com/s/t.css")
    p = convert("", sheet, other, PNG, head='<link rel="stylesheet" media="print" href="s/s.css"><link rel="alternate stylesheet" title="x" href="s/s.css"><style title=q type=t>e{f:url(i.png)}</style>')
    assert '<style media="print" data-original-href="https://e.com/s/s.css">' in p.data
    assert "/* original URL: https://e.com/s/t.css */ url(data:text/css;base64," in p.data
    assert f'<style title="q">e{{f:/* original URL: https://e.com/i.png */ url({DATA})}}</style>' in p.data
    assert 'rel="alternate stylesheet"' in p.data and 'href="data:text/css;base64,' in p.data
    assert p.unfound == ["https://e.com/s/i.png"]


def test_links_icons_and_hints():
    p = convert('<a href="#x">1</a><a href="p#y" ping="z">2</a><a href="q">3</a>', PNG, head='<link rel="shortcut icon" href="i.png" sizes="1x1"><link rel="preload prefetch" href="x"><link rel="apple-touch-icon" href="no.png">')
    assert 'href="#x"' in p.data and 'href="#y"' in p.data and 'href="https://e.com/q"' in p.data and "ping" not in p.data and "preload" not in p.data
    assert p.favicons == [{"href": DATA, "original_href": "https://e.com/i.png", "media": None, "type": None, "sizes": "1x1"}, {"href": "https://e.com/no.png", "original_href": None, "media": None, "type": None, "sizes": None}]


def test_scripts_and_handlers():
    html = '<script src="s.js"></script><script type="application/ld+json">{}</script><p onclick="x" onfoo="y" integrity="z">t</p>'
    p = convert(html)
    assert "s.js" not in p.data and 'type="application/ld+json">{}' in p.data and "onclick" not in p.data and "onfoo" in p.data and "integrity" not in p.data
    assert "script-src 'none';" in p.data and p.unfound == ["https://e.com/s.js"]
    q = convert(html, scripts=True)
    assert "https://e.com/s.js" in q.data and "onclick" in q.data and "'unsafe-inline' data:;\"" in q.data


def test_head():
    p = convert("", headers=b"Subject: =?utf-8?Q?a=3C/script=3E?=\r\nFrom: x\r\n", head='<title>T</title><base href="https://b.com/"><meta http-equiv="refresh" content="0"><meta http-equiv="Content-Security-Policy" content="y">')
    assert p.title == "T" and p.data.startswith('<html><head><meta charset="utf-8"><script type="application/ld+json">{')
    assert "a<\\/script>" in p.data and "refresh" not in p.data and "<base" not in p.data and '<link rel="canonical" href="https://e.com/p">' in p.data
    assert '"dateCreated"' not in p.data


def test_base_element_changes_addresses():
    assert convert('<img src="x.png">', head='<base href="https://b.com/c/">').unfound == ["https://b.com/c/x.png"]


def test_frames():
    inner = part(b'<p>in</p><img src="no.png">', "text/html", content_id="<f@x>", location="https://e.com/f")
    p = convert('<iframe src="cid:f@x"></iframe><frame src="f"><object data="i.png"></object><embed src="f"><iframe src="i.png"></iframe>', inner, PNG)
    assert 'srcdoc="<html>' in p.data and "data:text/html,%3Chtml%3E" in p.data and f'data="{DATA}"' in p.data and f'<iframe src="{DATA}"' in p.data
    assert p.unfound == ["https://e.com/no.png"]


def test_a_frame_of_its_own_page_ends():
    assert convert('<iframe src="p"></iframe>').error is None


def test_archives_without_a_document():
    image = pages.convert(mime.parse(archive(PNG)))
    assert f'<img src="{DATA}">' in image.data and image.anomalies == [("index-synthesized", "https://e.com/i.png")]
    text = pages.convert(mime.parse(archive(part(b"a<b&c", "text/plain"))))
    assert "<pre>a&lt;b&amp;c</pre>" in text.data
    assert pages.convert(mime.parse(archive(part(b"x", "text/css")))).error == "Index page not found"


def test_conversion_changes_nothing_it_is_given():
    a = mime.parse(archive(part(b'<img src="i.png"><link rel=stylesheet href=s.css>', "text/html", location="https://e.com/p"), PNG, part(b"a{b:url(i.png)}", "text/css", location="https://e.com/s.css")))
    assert pages.convert(a) == pages.convert(a)


def test_template_shadow_mode_and_missing_type():
    p = convert('<template shadowmode="open"><img src="u"></template>', part(b"x", None, location="https://e.com/u"))
    assert 'shadowrootmode="open"' in p.data and "data:application/octet-stream;base64,eA==" in p.data


def test_frames_are_followed_to_any_depth():
    from foliant.functions import mime, pages

    n = 170
    parts = [mime.Part(i, f"https://e.com/{i}", f"https://e.com/{i}", None, "text/html", None, f'<p>level {i}</p><frameset><frame src="{i + 1}"></frameset>' if i == 0 else f"<p>level</p><iframe src={i + 1}></iframe>") for i in range(n)]
    page = pages.convert(mime.Archive({}, parts, 0))
    assert page.error is None and page.unfound == [f"https://e.com/{n}"]


@pytest.mark.parametrize(
    "given,expected",
    [
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"), ("<p><b>x</p><p>y</b>z", "<p><b>x</b></p><p><b>y</b>z</p>"), ("<a href=1>x<a href=2>y</a>", '<a href="1">x</a><a href="2">y</a>'),
        ("<b><i>1</b>2</i>3", "<b><i>1</i></b><i>2</i>3"), ("<b>1<div>2<i>3</b>4</i></div>", "<b>1</b><div><b>2<i>3</i></b><i>4</i></div>"), ("<i>1</i></i>2", "<i>1</i>2"),
        ("<table>x<tr><td>y</table>z", "x<table><tbody><tr><td>y</td></tr></tbody></table>z"), ("<table><b>x</b><td><i>y</table>z", "<b>x</b><table><tbody><tr><td><i>y</i></td></tr></tbody></table>z"),
        ("<table><col><tr><th>a<td>b<tr><td>c</table>", "<table><colgroup><col></colgroup><tbody><tr><th>a</th><td>b</td></tr><tr><td>c</td></tr></tbody></table>"), ("<div><em>a</div>b", "<div><em>a</em></div><em>b</em>"),
    ],
)
def test_repairs(given, expected):
    from foliant.functions import markup

    assert markup.parse(f"<html><head></head><body>{given}</body></html>").serialize() == f"<html><head></head><body>{expected}</body></html>"


def test_repairs_of_random_markup_keep_all_text():
    import random

    from foliant.functions import markup

    rnd = random.Random(4)
    for _ in range(300):
        text = "".join(rnd.choice(["<b>", "</b>", "<i>", "</i>", "<a>", "</a>", "<p>", "</p>", "<div>", "</div>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<li>", "<object>", "</object>", "x", "y "]) for _ in range(60))
        doc = markup.parse(text)
        assert sorted(c for n in [doc.root, *doc.root.walk()] for t in n.children if t.tag == "#text" for c in t.text if not c.isspace()) == sorted(c for c in markup_text(text) if not c.isspace())
        assert markup.parse(doc.serialize()) is not None


def markup_text(text):
    import re

    return re.sub("<[^>]*>", "", text)
