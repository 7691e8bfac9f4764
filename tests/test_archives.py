import os

import pytest
from pyspark.sql import functions as F

from foliant.operators import archives as ops
from foliant.plans.queries import QUERIES
from foliant.sources.archivefiles import read_archives, write_pages
from tests.test_mime import archive, part

HTML = b'<html><head><title>T</title><link rel="stylesheet" href="s.css"></head><body><img src="i.png"><img src="no.png"><a href="x">l</a><iframe src="cid:f"></iframe></body></html>'


def one(extra=()):
    return archive(part(HTML, "text/html", location="https://e.com/p"), part(b"a{b:url(bg.png)}", "text/css", location="https://e.com/s.css"), part(b"iVBO", "image/png", "base64", "https://e.com/i.png"), part(b"<p>f", "text/html", content_id="<f>"), *extra)


def frame(spark, *contents):
    return spark.createDataFrame([(f"a{i}", bytearray(c) if c is not None else None, "x") for i, c in enumerate(contents)], "archive_id string, content binary, parts string")


def test_bad_archives_do_not_fail_the_job(spark):
    rows = {r["archive_id"]: r for r in ops.parse_archives(frame(spark, one(), None, b"", b"\x00\xff")).collect()}
    assert rows["a0"]["error"] is None and len(rows["a0"]["parts"]) == 4 and rows["a1"]["error"] == "no content" and rows["a2"]["parts"] == []
    pages = {r["archive_id"]: r for r in ops.convert_archives(frame(spark, one(), None, b"")).collect()}
    assert pages["a0"]["title"] == "T" and pages["a2"]["error"] == "Index page not found"


def test_both_paths_leave_the_same_holes(spark):
    archives = frame(spark, one(), one((part(b"x", "image/png", "binary", "https://e.com/no.png"),)))
    parts = ops.archive_parts(ops.parse_archives(archives))
    resolved = ops.resolve_references(ops.references(parts), ops.addresses(parts))
    relational = {tuple(r) for r in ops.unfound_references(resolved).collect()}
    converted = {tuple(r) for r in ops.page_unfound(ops.convert_archives(archives)).collect()}
    assert relational == converted == {("a0", "https://e.com/no.png"), ("a0", "https://e.com/bg.png"), ("a1", "https://e.com/bg.png")}
    again = {tuple(r) for r in ops.page_unfound(ops.convert_parts(parts)).collect()}
    assert again == converted
    assert {tuple(r) for r in ops.used_parts(resolved).filter("archive_id = 'a0'").collect()} == {("a0", 1), ("a0", 2), ("a0", 3)}
    assert ops.unused_parts(parts, resolved).count() == 0


def test_fetch_rounds_reach_what_fetched_sheets_need(spark):
    data = archive(part(b'<link rel="stylesheet" href="s.css"><img src="gone.png"><img src="late.png">', "text/html", location="https://e.com/p"))
    web = spark.createDataFrame(
        [
            ("https://e.com/s.css", 503, None, None, "1", 1), ("https://e.com/s.css", 200, "text/css", bytearray(b'@import "t.css";'), None, 2),
            ("https://e.com/t.css", 200, "text/css", bytearray(b"a{b:url(i.png)}"), None, 1), ("https://e.com/i.png", 200, "image/png", bytearray(b"\x01\x02"), None, 1),
            ("https://e.com/gone.png", 404, None, None, None, 1), ("https://e.com/late.png", 429, None, None, "120", 1), ("https://e.com/late.png", 200, "image/png", bytearray(b"x"), None, 2),
        ],
        "url string, status int, content_type string, body binary, retry_after string, at int",
    ).withColumn("fetched_at", F.timestamp_seconds("at")).drop("at")
    parts, failed = ops.fetch_rounds(ops.archive_parts(ops.parse_archives(frame(spark, data))), web)
    assert {r["id"] for r in parts.collect()} == {"https://e.com/p", "https://e.com/s.css", "https://e.com/t.css", "https://e.com/i.png"}
    assert {r["address"] for r in failed.collect()} == {"https://e.com/gone.png", "https://e.com/late.png"}
    page = ops.convert_parts(parts).collect()[0]
    assert sorted(page["unfound_resources"]) == ["https://e.com/gone.png", "https://e.com/late.png"] and "original URL: https://e.com/t.css" in page["html"]


def test_fetch_rounds_go_on_to_the_end_of_a_chain(spark):
    data = archive(part(b'<link rel="stylesheet" href="s0.css">', "text/html", location="https://e.com/p"))
    chain = [(f"https://e.com/s{k}.css", 200, "text/css", bytearray(f'@import "s{k + 1}.css";'.encode()), None, None) for k in range(10)]
    web = spark.createDataFrame(chain, "url string, status int, content_type string, body binary, retry_after string, fetched_at timestamp")
    found = ops.archive_parts(ops.parse_archives(frame(spark, data)))
    parts, failed = ops.fetch_rounds(found, web)
    assert {r["id"] for r in parts.collect()} == {"https://e.com/p", *(f"https://e.com/s{k}.css" for k in range(10))}
    assert [r["address"] for r in failed.collect()] == ["https://e.com/s10.css"]
    with pytest.raises(RuntimeError, match="1 resources"):
        ops.fetch_rounds(found, web, max_rounds=1)


def test_import_closure_ends_on_cycles(spark):
    direct = spark.createDataFrame([("a", "1", "2"), ("a", "2", "3"), ("a", "3", "1"), ("b", "1", "9")], "archive_id string, sheet string, imported string")
    got = {tuple(r) for r in ops.import_closure(direct).collect()}
    assert got == {("a", x, y) for x in "123" for y in "123"} | {("b", "1", "9")}


def test_queries_read_the_references_of_sheets(spark, tmp_path):
    rows = [
        ("a", 0, "https://e.com/p", "text/html", '<link rel="stylesheet" href="https://e.com/s.css">'),
        ("a", 1, "https://e.com/s.css", "text/css", "a{b:url(i.png)} c{d:url(no.png)}"),
        ("a", 2, "https://e.com/i.png", "image/png", "iVBO"),
        ("b", 0, "https://e.com/q", "text/html", "<p>x</p>"),
    ]
    kept = "archive_id string, part_no int, id string, content_type string, data string, content_id string, transfer_encoding string, captured_at timestamp, ingested_at timestamp"
    spark.createDataFrame([(*r, None, None, None, None) for r in rows], kept).write.parquet(str(tmp_path / "parts.parquet"))
    spark.createDataFrame([("a",), ("b",)], "archive_id string").write.parquet(str(tmp_path / "archives.parquet"))

    def found(name):
        return {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()}

    assert found("used_parts") == {("a", 1), ("a", 2)}
    assert found("unfound_references") == found("missing_resources") == {("a", "https://e.com/no.png")}
    assert found("archives_without_holes") == {("b",)}
    assert ("a", 1, "https://e.com/i.png", 2) in found("resolved_references")


def test_empty_tables(spark):
    nothing = frame(spark, one()).limit(0)
    parts = ops.archive_parts(ops.parse_archives(nothing))
    assert ops.unfound_references(ops.resolve_references(ops.references(parts), ops.addresses(parts))).count() == ops.convert_archives(nothing).count() == ops.convert_parts(parts).count() == 0


def test_files_stream_and_command_line(spark, tmp_path):
    from foliant.cli import main
    from foliant.streaming.ingest import convert_stream

    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.mht", "b.MHTML", "c.txt"):
        (folder / name).write_bytes(one())
    read = read_archives(spark, str(folder))
    assert sorted(os.path.basename(r["path"]) for r in read.select("path").collect()) == ["a.mht", "b.MHTML"]
    assert read_archives(spark, str(folder), max_bytes=3).count() == 0
    assert write_pages(ops.convert_archives(read)) == 2 and "<title>T</title>" in (folder / "b.html").read_text()
    query = convert_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("title = 'T'").count() == 2
    assert main([str(folder / "a.mht"), "--output", str(tmp_path / "page")]) == 0 and (tmp_path / "page.html").exists()
    assert main([]) == 1 and main([str(folder / "missing.mht")]) == 1


def test_pages_of_one_name_in_a_folder(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "x.mht").write_bytes(one())
    read = read_archives(spark, str(tmp_path / "in"))
    assert write_pages(ops.convert_archives(read), str(tmp_path / "out")) == 2
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.html")) == ["a/x.html", "b/x.html"]
