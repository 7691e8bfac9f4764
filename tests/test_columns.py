"""The expressions and the kernels must agree."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import charset, columns, contenttype, markup, transfer, urls
from foliant.sources.fetching import wait_before

TYPES = [None, "", "text/html", "TEXT/HTML; charset=\"UTF-8\"", "text/cssx", "image/png", "font/woff2", "multipart/related; boundary=\"a;b\"; type=x", "multipart/Alternative;boundary=c ", "application/xhtml+xml;charset='koi8-r'", "text/plain; format=flowed; Charset=WINDOWS-1251"]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").repartition(1)


def evaluate(spark, values, *exprs, kind="string"):
    rows = column(spark, values, kind).select("i", *(e.alias(f"e{k}") for k, e in enumerate(exprs))).orderBy("i").collect()
    return [tuple(r)[1:] for r in rows]


def test_content_types(spark):
    v = F.col("v")
    names = ["is_document", "is_stylesheet", "is_text", "is_image", "is_plain_text", "is_media", "is_multipart", "is_alternative"]
    got = evaluate(spark, TYPES, *(getattr(columns, n)(v) for n in names), columns.charset_parameter(v), columns.boundary_parameter(v), columns.media_type(v))
    expected = [tuple(getattr(contenttype, n)(t) for n in names) + (charset.charset_parameter(t), contenttype.boundary(t), contenttype.media_type(t) if t != "" else "") for t in TYPES]
    assert got == expected


def test_text_functions(spark):
    texts = ["a<b>&\"c\"\xa0", "</script>/>", "<\\/x\\/>", "", "é日本", None]
    v = F.col("v")
    got = evaluate(spark, texts, columns.escape_text(v), columns.escape_attribute(v), columns.escape_plain(v), columns.escape_script(v))
    assert got == [(None,) * 4 if t is None else (markup.escape_text(t), markup.escape_attribute(t), markup.escape_plain(t), markup.escape_script(t)) for t in texts]


def test_base64(spark):
    values = ["aGk=", "aGk", " aG\r\nk= ", "%", "", None, "iVBORw0KGgo"]
    got = evaluate(spark, values, columns.decode_base64(F.col("v")))
    assert [None if x is None else bytes(x) for (x,) in got] == [None if t is None else transfer.decode_base64(t) for t in values]
    raw = [b"\xff" * 100, b"", None]
    assert evaluate(spark, raw, columns.encode_base64(F.col("v")), kind="binary") == [(None if b is None else transfer.encode_base64(b),) for b in raw]
    marks = [b"\xef\xbb\xbfa", b"\xff\xfea", b"\xfe\xff", b"a", b""]
    assert evaluate(spark, marks, columns.mark_charset(F.col("v")), kind="binary") == [(charset.mark_charset(b),) for b in marks]


def test_addresses(spark):
    values = ["urn:a:http://x", "urn:x", "cid:a@b", "http://e.com/p#f", "https://e.com/p", "ftp://x", None]
    v = F.col("v")
    got = evaluate(spark, values, columns.unwrap_urn(v), columns.cid_key(v), columns.is_fetchable(v), columns.same_page_link(v, F.lit("http://e.com/p")))
    assert got == [
        ("http://x", None, True, "urn:a:http://x"), ("urn:x", None, True, "urn:x"), ("cid:a@b", "<a@b>", False, "cid:a@b"), ("http://e.com/p#f", None, True, "#f"), ("https://e.com/p", None, True, "https://e.com/p"), ("ftp://x", None, False, "ftp://x"), (None, None, False, None),
    ]
    assert urls.same_page("http://e.com/p#f", "http://e.com/p") == "#f"
    assert evaluate(spark, ["a/b.mhtml", "a.b/c", "x"], columns.output_name(v)) == [("a/b.html",), ("a.html",), ("x",)]


@pytest.mark.parametrize("value", [None, "", " ", "1", "2.5", "5", "5.1", "-3", "soon", "Wed, 01 Jan 2025 00:00:04 GMT", "Wed, 01 Jan 2025 00:01:04 GMT", "Wed, 01 Jan 2020 00:00:00 GMT"])
def test_waits(spark, value):
    got = evaluate(spark, [value], columns.retry_delay_ms(F.col("v"), F.lit(2), F.timestamp_seconds(F.lit(1735689600))))[0][0]
    expected = wait_before(2, value, now=1735689600)
    assert got == (None if expected is None else int(expected * 1000))


def test_status(spark):
    got = evaluate(spark, [None, 200, 404, 429, 499, 500, 599, 600], columns.is_transient(F.col("v")), columns.backoff_ms(F.lit(3)), kind="int")
    assert [x for x, _ in got] == [False, False, False, True, False, True, True, False] and {x for _, x in got} == {4000}
