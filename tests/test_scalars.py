import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.functions import css, markup, mimeheader, srcset, transfer, urls


@given(st.binary(max_size=300))
@settings(max_examples=150, deadline=None)
def test_quoted_printable_round_trip(data):
    data = data.replace(b"\r", b"")
    assert transfer.decode_quoted_printable(transfer.encode_quoted_printable(data)) == data
    assert all(len(x.rstrip(b"\r")) <= 76 for x in transfer.encode_quoted_printable(data).split(b"\n"))


@given(st.binary(max_size=200))
@settings(max_examples=100, deadline=None)
def test_base64_round_trip(data):
    lines = base64.encodebytes(data)
    assert transfer.decode_base64(lines) == data == transfer.decode_base64(lines.rstrip(b"\n=") if data else b"")


@pytest.mark.parametrize("text", ["%", "a", "ab=c", "YQ===", "é"])
def test_damaged_base64(text):
    assert transfer.decode_base64(text) is None


def test_quoted_printable_keeps_what_is_no_escape():
    assert transfer.decode_quoted_printable(b"a=zz =3d=3D\n= \r\nb=") == b"a=zz ==\nb"


@given(st.text(max_size=80), st.sampled_from(["Q", "B"]))
@settings(max_examples=150, deadline=None)
def test_encoded_words_round_trip(text, how):
    assert mimeheader.decode_header(mimeheader.encode_words(text, how=how, per_word=7)) == text


@pytest.mark.parametrize(
    "header,expected",
    [
        (None, ""),
        ("plain", "plain"),
        ("=?utf-8?Q?a_b=C3=A9?=", "a bé"),
        ("=?utf-8?B?w6k=?= =?utf-8?B?w6k=?=", "éé"),
        ("=?utf-8?B?w6k=?= x =?utf-8?B?w6k=?=", "é x é"),
        ("=?iso-8859-1?Q?=E9?= =?utf-8?Q?=C3=A9?=", "éé"),
        ("=?utf-8?X?a?=", "=?utf-8?X?a?="),
        ("a =?utf-8?Q?b?=c", "a bc"),
        ("=?utf-8?B?%%?=", "%%"),
    ],
)
def test_encoded_words(header, expected):
    assert mimeheader.decode_header(header) == expected


@pytest.mark.parametrize(
    "path,base,expected",
    [
        ("b", "http://a.com/x/y", "http://a.com/x/b"),
        ("../b", "http://a.com/x/y/z", "http://a.com/x/b"),
        ("/b/./c/%2e%2e/d", "http://a.com/x", "http://a.com/b/d"),
        ("//h/p", "https://a.com/", "https://h/p"),
        ("?q", "http://a.com/x?y#z", "http://a.com/x?q"),
        ("#f", "http://a.com/x?y#z", "http://a.com/x?y#f"),
        ("", "http://a.com/x?y#z", "http://a.com/x?y"),
        ("HTTP://A.com:80", None, "http://a.com/"),
        ("https://a.com:443/é b", None, "https://a.com/%C3%A9%20b"),
        ("http://bücher.de/", None, "http://xn--bcher-kva.de/"),
        ("http:b", "http://a.com/x/y", "http://a.com/x/b"),
        ("a\\b", "http://a.com/x/", "http://a.com/x/a/b"),
        ("data:x", "http://a.com/", "data:x"),
        ("b", "_0", "b"),
        ("b", "<cid>", "b"),
        ("cid:x@y", "http://a.com/", "cid:x@y"),
        ("http://u:p@a.com/", None, "http://u:p@a.com/"),
        ("http://a.com:99999/", "http://b.com/", "http://a.com:99999/"),
    ],
)
def test_resolution(path, base, expected):
    assert (urls.resolve(path, base) if base else urls.normalize(path)) == expected


def test_same_page_links():
    assert urls.same_page("b#f", "http://a.com/b") == "#f"
    assert urls.same_page("c#f", "http://a.com/b") == "http://a.com/c#f"
    assert urls.unwrap_urn("urn:snapshot-1:http://x") == "http://x" and urls.unwrap_urn("urn:x") == "urn:x"


@pytest.mark.parametrize(
    "text,expected",
    [
        ("a.png", "a.png"),
        ("small.webp 1.0x, wide.webp 2x", "small.webp 1x, wide.webp 2x"),
        ("a.png 10w 20h,b.png", "a.png 10w 20h, b.png"),
        ("a,b.png, c.png", "a,b.png, c.png"),
        ("a.png 1.5x 2w", "a.png 1.5x 2w"),
        ("a.png -1x", "a.png -1x"),
        ("a.png calc(1, 2) 3w", "a.png calc(1, 2) 3w"),
        (" , ", ""),
        ("a.png 0w", "a.png 0w"),
        ("data:image/png;base64,AA== 2x", "data:image/png;base64,AA== 2x"),
    ],
)
def test_srcset(text, expected):
    assert srcset.serialize(srcset.parse(text)) == expected


def test_sheet_references_skip_comments_strings_and_broken_rules():
    sheet = "@import; /* url(a) */ b{c:'url(d)'} @import url( 'e f' ) print; @import \"g\\\"h\"; i{j:url(k\\)l) url()}"
    assert [(s.kind, s.path) for s in css.references(sheet)] == [("import", "e f"), ("import", 'g"h'), ("url", "k)l")]


def test_sheets_keep_all_other_text():
    sheet = "a { b : c } /* d */ e{f:url(g)}"
    assert css.rewrite(sheet, lambda s: None) == sheet
    assert css.rewrite(sheet, lambda s: css.url_token("h (i)", "g")) == "a { b : c } /* d */ e{f:/* original URL: g */ url(h\\20 \\(i\\))}"
    assert css.references(css.rewrite(sheet, lambda s: css.url_token("h (i)")))[0].path == "h (i)"


@pytest.mark.parametrize(
    "text,expected",
    [
        ("x", "<html><head></head><body>x</body></html>"),
        ("<!doctype HTML><title>a &amp; b</title>x", "<!DOCTYPE html>\n<html><head><title>a &amp; b</title></head><body>x</body></html>"),
        ("<p>a<p>b<ul><li>c<li>d</ul>", "<html><head></head><body><p>a</p><p>b</p><ul><li>c</li><li>d</li></ul></body></html>"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "<html><head></head><body><table><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table></body></html>"),
        ("<script>a</p></script><b>x", "<html><head><script>a<\\/p></script></head><body><b>x</b></body></html>"),
        ('<a b="c>d" e=\'f"\' g=h i>j</a>', '<html><head></head><body><a b="c>d" e="f&quot;" g="h" i="">j</a></body></html>'),
        ("a < b &lt; c &nbsp; d", "<html><head></head><body>a &lt; b &lt; c &nbsp; d</body></html>"),
        ("<img src=x>y<br/>z", '<html><head></head><body><img src="x">y<br>z</body></html>'),
        ("<html lang=de><head></head><body class=x><!-- c --></body></html>", '<html lang="de"><head></head><body class="x"><!-- c --></body></html>'),
        ("<textarea><b></textarea>", "<html><head></head><body><textarea>&lt;b&gt;</textarea></body></html>"),
        ("<div", "<html><head></head><body></body></html>"),
    ],
)
def test_markup(text, expected):
    once = markup.parse(text).serialize()
    assert once == expected


@given(st.text(alphabet="<>/abp=\"' !-&;\n", max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_gives_a_page(text):
    once = markup.parse(text).serialize()
    assert once.count("<body") >= 1 and "</html>" in once
