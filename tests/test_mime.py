import pytest

from foliant.functions import mime, transfer
from foliant.functions.charset import decode


def part(body=b"", content_type="text/plain", encoding=None, location=None, content_id=None, eol=b"\r\n"):
    lines = [f"Content-Type: {content_type}".encode()] if content_type else []
    if encoding:
        lines.append(f"Content-Transfer-Encoding: {encoding}".encode())
    if location:
        lines.append(f"Content-Location: {location}".encode())
    if content_id:
        lines.append(f"Content-ID: {content_id}".encode())
    return b"--B" + eol + eol.join(lines) + eol + eol + body + eol


def archive(*parts, headers=b"", closing=True, boundary="B", eol=b"\r\n", preamble=b""):
    return headers + f'Content-Type: multipart/related; boundary="{boundary}"'.encode() + eol + eol + preamble + b"".join(parts) + (b"--B--" + eol if closing else b"")


@pytest.mark.parametrize("body", [b"a", b"a\r\n", b"a\n", b"", b"\r\n", b"a\r\n\r\n", b"a --B b", b"--Bx\r\na"])
@pytest.mark.parametrize("closing", [True, False])
def test_line_end_before_a_delimiter_belongs_to_it(body, closing):
    got = mime.parse(archive(part(body), closing=closing)).parts
    assert [p.data for p in got] == [body.decode()]


@pytest.mark.parametrize("tail,expected", [(b"--B--", "x"), (b"--B", "x"), (b"--B  \t", "x"), (b"--Bye", "x--Bye"), (b"--B --", "x--B --")])
def test_delimiters_glued_to_text(tail, expected):
    data = b"Content-Type: multipart/related; boundary=B\n\n--B\nContent-Type: text/plain\n\nx" + tail
    assert mime.parse(data).parts[0].data == expected


def test_epilogue_and_preamble_are_no_parts():
    got = mime.parse(archive(part(b"x"), preamble=b"hello\r\n--no\r\n") + b"\r\nepilogue\r\n\r\nmore")
    assert [p.data for p in got.parts] == ["x"]


def test_cut_files_keep_what_there_is():
    assert [p.data for p in mime.parse(b"Content-Type: multipart/related; boundary=B\n\n--B\nContent-Type: text/html\n\n").parts] == [""]
    assert [p.data for p in mime.parse(b"Content-Type: multipart/related; boundary=B\n\n--B\nContent-Type: text/html\n\n<p>ab").parts] == ["<p>ab"]
    assert mime.parse(b"").parts == [] and mime.parse(b"From: x").parts == []


@pytest.mark.parametrize("encoding", ["8bit", "quoted-printable", "base64", "binary"])
@pytest.mark.parametrize("charset", ["koi8-r", "windows-1251", "shift_jis", "euc-jp", "gbk", "utf-8"])
@pytest.mark.parametrize("declared", ["header", "meta", "http-equiv"])
def test_charsets_of_documents(encoding, charset, declared):
    text = "日本語 テスト" if charset in ("shift_jis", "euc-jp") else "中文字符" if charset == "gbk" else "Привет, мир"
    meta = {"header": "", "meta": f'<meta charset="{charset}">', "http-equiv": f'<meta http-equiv="Content-Type" content="text/html; charset={charset}">'}[declared]
    raw = f"<html><head>{meta}</head><body>{text}</body></html>".encode(charset)
    sent = {"8bit": raw, "binary": raw, "quoted-printable": transfer.encode_quoted_printable(raw), "base64": transfer.encode_base64(raw).encode()}[encoding]
    got = mime.parse(archive(part(sent, "text/html" + (f"; charset={charset}" if declared == "header" else ""), encoding))).parts[0]
    assert text in got.data and "charset=" not in got.data.replace("charset=utf-8", "")
    assert got.transfer_encoding != "base64"


def test_http_equiv_wins_over_meta_charset():
    raw = '<html><head><meta charset="koi8-r"><meta http-equiv="content-type" content="text/html; charset=windows-1251"></head><body>Мир</body></html>'.encode("cp1251")
    assert "Мир" in mime.parse(archive(part(raw, "text/html"))).parts[0].data


def test_byte_order_mark_outranks_everything():
    raw = b"\xff\xfe" + '<meta charset="koi8-r"><p>Мир'.encode("utf-16-le")
    assert "Мир" in mime.parse(archive(part(raw, "text/html; charset=big5", "binary"))).parts[0].data


def test_sheet_charset_rule():
    raw = '@charset "windows-1251"; a{content:"Мир"}'.encode("cp1251")
    assert mime.parse(archive(part(raw, "text/css"))).parts[0].data == ' a{content:"Мир"}'


def test_images_stay_encoded():
    a = mime.parse(archive(part(b"iVBO\r\nRw0K", "image/png", "Base64"), part(b"\x89PNG\r\n\x1a\n", "image/png", "binary")))
    assert [(p.transfer_encoding, p.data) for p in a.parts] == [("base64", "iVBORw0K"), ("base64", "iVBORw0KGgo=")]


def test_identity_and_addresses():
    a = mime.parse(archive(part(b"1", location="http://EX.com/a/../b"), part(b"2", content_id="<x>"), part(b"3"), part(b"4", location="http://ex.com/b", content_id="<x>")))
    assert [p.id for p in a.parts] == ["http://ex.com/b", "<x>", "_0", "http://ex.com/b"]
    found, frames = a.addresses()
    assert found == {"http://ex.com/b": 0, "http://EX.com/a/../b": 0, "<x>": 1, "_0": 2} and frames == {"<x>": 3}


def test_generated_ids_skip_taken_ones():
    assert [p.id for p in mime.parse(archive(part(b"1", location="_0"), part(b"2"))).parts] == ["_0", "_1"]


def test_nested_alternative():
    inner = b"--I\r\nContent-Type: text/plain\r\n\r\np\r\n--I\r\nContent-Type: text/html\r\n\r\n<p>h</p>\r\n--I--"
    a = mime.parse(archive(part(inner, "multipart/alternative; boundary=I"), part(b"<p>2", "text/html")))
    assert [(p.depth, p.content_type) for p in a.parts] == [(0, "multipart/alternative; boundary=I"), (1, "text/plain"), (1, "text/html"), (0, "text/html")]
    assert a.index == 2


@pytest.mark.parametrize(
    "data,anomalies,texts",
    [
        (b" \r\n<html><p>x", ["document-mislabeled-as-archive"], ["<p>x"]),
        (b"\xef\xbb\xbf<html>x", ["document-mislabeled-as-archive"], ["x"]),
        (b"Content-Type: multipart/related; boundary=A\n\n--C\nContent-Type: text/plain\n\nx\n--C--", ["declared-boundary-unused"], ["x"]),
        (b"Content-Type: multipart/related\n\n--C\nContent-Type: text/plain\n\nx\n--C--", [], ["x"]),
        (b"Content-Type: multipart/related; boundary=A\n\nContent-Type: text/html\n\n<p>x", ["multipart-without-delimiters"], ["<p>x"]),
        (b"Content-Type: multipart/related; boundary=A\n\n<p>x", ["multipart-without-delimiters"], ["<p>x"]),
        (b"Content-Type: text/plain\n\nx\ny\n", [], ["x\ny"]),
        (b"Content-Type: multipart/related; boundary=B\n\n--B\nContent-Type: text/html\nContent-Transfer-Encoding: base64\n\n%%%\n--B--", ["base64-left-encoded"], ["%%%"]),
    ],
)
def test_recovery(data, anomalies, texts):
    a = mime.parse(data)
    assert [t for t, _ in a.anomalies] == anomalies
    assert all(t in p.data for t, p in zip(texts, a.parts, strict=True))


def test_headers():
    head = b"X-A: 1\r\nx-a:  2 \r\nX-B: one\r\n\ttwo: 2\r\nFrom: <Saved by \xcc\xe8\xf0>\r\n"
    a = mime.parse(archive(part("<p>Мир".encode("cp1251"), "text/html; charset=windows-1251"), headers=head))
    assert a.headers["x-a"] == "2" and a.headers["x-b"] == "onetwo: 2" and a.headers["from"] == "<Saved by Мир>"


def test_boundary_in_quotes_may_hold_a_semicolon():
    data = b'Content-Type: multipart/related; boundary="a;b"\n\n--a;b\nContent-Type: text/plain\n\nx\n--a;b--'
    assert mime.parse(data).parts[0].data == "x"


def test_unknown_labels_are_utf8():
    assert decode("é".encode(), "no-such-charset") == "é" and decode(b"\x93", "latin1") == "“" and decode(b"\xff") == "�"


def test_parts_behind_a_closing_delimiter():
    data = b"Content-Type: multipart/related; boundary=B\n\n--B\nContent-Type: text/plain\n\nx\n--B--\nContent-Type: text/plain\n\ny\n--B--\nbye\n\nnow\n--B\nContent-Type: text/css\n\nz\n--B--\n"
    assert [p.data for p in mime.parse(data).parts] == ["x", "y", "z"]


def test_markup_behind_any_number_of_blanks():
    assert [t for t, _ in mime.parse(b" \n" * 25_000 + b"<html>x").anomalies] == ["document-mislabeled-as-archive"]
    assert mime.starts_with_markup(b"\xff\xfe" + (" " * 9_000 + "<p>").encode("utf-16-le")) and not mime.starts_with_markup(b" " * 9_000 + b"a<p>")


@pytest.mark.parametrize("label", ["utf-7", "unicode_escape", "raw_unicode_escape", "punycode", "idna", "cp037", "rot13", "hex", "utf-32", "cp437"])
def test_labels_of_no_web_charset_are_utf8(label):
    assert decode(b"+ADw-script \\u003c \xc3\xa9", label) == "+ADw-script \\u003c é"


@pytest.mark.parametrize("label,raw,text", [("gb2312", "中文".encode("gbk"), "中文"), ("EUC-KR", "한국".encode("euc-kr"), "한국"), ("big5", "中文".encode("big5"), "中文"), ("iso-2022-jp", "日本".encode("iso2022_jp"), "日本"), ("latin2", "ł".encode("latin2"), "ł"), ("koi8-r", "Мир".encode("koi8-r"), "Мир"), ("iso-8859-9", "ğ".encode("cp1254"), "ğ"), ("ibm866", "Мир".encode("cp866"), "Мир"), ("macintosh", "é".encode("mac-roman"), "é")])
def test_labels_of_web_charsets(label, raw, text):
    assert decode(raw, label) == text
