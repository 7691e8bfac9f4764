import threading
import time

import pytest

from foliant.sources.fetching import Answer, fetch_addresses, fetch_all, fetch_one, part_data, wait_before


def scripted(*script):
    calls = []

    def fetch(url):
        step = script[min(len(calls), len(script) - 1)]
        calls.append(url)
        if step == "throw":
            raise OSError("no network")
        return step if isinstance(step, Answer) else Answer(step, "text/css", b"x")

    return fetch, calls


@pytest.mark.parametrize(
    "script,attempts,ok",
    [
        ([200], 1, True), ([404], 1, False), ([503, 200], 2, True), ([429, 500, 200], 3, True), ([503], 3, False), (["throw", 200], 2, True), (["throw"], 3, False), ([599, 301], 2, False),
        ([Answer(429, retry_after="6"), 200], 1, False), ([Answer(429, retry_after="soon"), 200], 1, False), ([Answer(503, retry_after="1"), 200], 2, True),
    ],
)
def test_retries(script, attempts, ok):
    fetch, calls = scripted(*script)
    waits = []
    answer, n = fetch_one("urn:snapshot-1:https://e.com/a", fetch, sleep=waits.append)
    assert (answer is not None, n, len(calls)) == (ok, attempts, attempts) and set(calls) == {"https://e.com/a"} and len(waits) == attempts - 1


def test_waits():
    assert [wait_before(i) for i in range(5)] == [0.5, 1.0, 2.0, 4.0, 5.0]
    assert wait_before(0, "-3") == 0 and wait_before(3, "2.5") == 2.5 and wait_before(0, "5") == 5 and wait_before(0, "5.1") is None and wait_before(0, "x") is None and wait_before(1, " ") == 1.0
    assert wait_before(0, "Wed, 01 Jan 2025 00:00:04 GMT", now=1735689600) == 4 and wait_before(0, "Wed, 01 Jan 2025 00:01:04 GMT", now=1735689600) is None and wait_before(0, "Wed, 01 Jan 2020 00:00:00 GMT", now=1735689600) == 0


@pytest.mark.parametrize("parallel,n,expected", [(16, 60, 16), (4, 60, 4), (1, 10, 1), (0, 10, 1), (16, 3, 3)])
def test_pool(parallel, n, expected):
    lock, state = threading.Lock(), {"now": 0, "peak": 0}

    def fetch(url):
        with lock:
            state["now"] += 1
            state["peak"] = max(state["peak"], state["now"])
        time.sleep(0.02)
        with lock:
            state["now"] -= 1
        return Answer(200)

    assert len(fetch_all([f"https://e.com/{i}" for i in range(n)], fetch, parallel)) == n and state["peak"] == expected


def test_spark(spark):
    missing = spark.createDataFrame([("a", "https://e.com/1"), ("b", "https://e.com/1"), ("a", "https://e.com/2")], "archive_id string, address string")

    def fetch(url):
        return Answer(200, None, url.encode()) if url.endswith("1") else Answer(404)

    rows = {r["address"]: r for r in fetch_addresses(missing, fetch, partitions=2).collect()}
    assert len(rows) == 2 and rows["https://e.com/1"]["content_type"] == "application/octet-stream" and bytes(rows["https://e.com/1"]["body"]) == b"https://e.com/1" and rows["https://e.com/2"]["ok"] is False


def test_part_data():
    # text is read as UTF-8, as in rounds that read a table of answers
    assert part_data(Answer(200, "text/css; charset=latin1", "é".encode()), False) == "é" and part_data(Answer(200, None, b"\xe9"), True) == "6Q=="


def test_rounds_with_a_client(spark):
    from foliant.operators import archives as ops

    page = b'Content-Type: text/html\nContent-Location: https://e.com/p\n\n<link rel="stylesheet" href="s.css"><img src="gone.png"><template><img src="inert.png"></template>'
    parts = ops.archive_parts(ops.parse_archives(spark.createDataFrame([("a", bytearray(page)), ("b", bytearray(page))], "archive_id string, content binary")))

    def client(url):
        return {"https://e.com/s.css": Answer(200, "text/css", b'@import "t.css";'), "https://e.com/t.css": Answer(200, "text/css", b"a{}")}.get(url, Answer(404))

    found, failed = ops.fetch_rounds(parts, client, partitions=2)
    assert sorted(tuple(r) for r in found.select("archive_id", "id").collect()) == [(a, f"https://e.com/{n}") for a in "ab" for n in ("p", "s.css", "t.css")]
    assert sorted(tuple(r) for r in failed.collect()) == [("a", "https://e.com/gone.png"), ("b", "https://e.com/gone.png")]


def test_conversion_fetches(spark):
    from foliant.operators import archives as ops

    page = b'Content-Type: text/html\nContent-Location: https://e.com/p\nSubject: S\n\n<link rel="stylesheet" href="s.css"><img src="gone.png">'
    rows = spark.createDataFrame([("a", bytearray(page)), ("b", bytearray(b"")), ("c", None)], "archive_id string, content binary")
    got = {r["archive_id"]: r for r in ops.convert_archives(rows, web=lambda url: Answer(200, "text/css", b"a{b:c}") if url.endswith(".css") else Answer(404), max_retries=0, max_parallel=2).collect()}
    assert "a{b:c}" in got["a"]["html"] and got["a"]["unfound_resources"] == ["https://e.com/gone.png"] and got["a"]["error"] is None
    assert got["b"]["error"] == "Index page not found" and got["c"]["error"] == "no content"
