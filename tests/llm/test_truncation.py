import base64

from foliant.llm import truncation as t

SCHEMA = "archive_id string, part_no int, source string, id string, content_type string, transfer_encoding string, data string, cut string"


def parts(spark, rows):
    return spark.createDataFrame([(a, n, s, f"_{n}", ct, None, d, "clash") for a, n, s, ct, d in rows], SCHEMA)


def cut(spark, rows):
    return {r["part_no"] for r in t.cut_values(parts(spark, rows)).filter("cut").collect()}


def test_syntax_left_open(spark):
    png = base64.b64encode(b"\x89PNG\r\n\x1a\nxx\x00\x00\x00\x00IEND\xaeB`\x82").decode()
    whole = ["<p>a</p>", "<html><body><p>a</p>", "<!DOCTYPE html><p>a</p></body></html>\n", '{"a": [1]}', "a{b:c}", "a{b:c}\n/* end */", "let a = 1;", "function f(e) { return e; }", "<svg><path/></svg>", png, png.rstrip("="), "A sentence.", "A sentence\n- item one\n- item two", "Text.\n\n-- \nName Name", "Text.\n\nhttp://a.b/c", "He said “yes.”", "文です。", "", "   ", None]
    open_ = ["<p>a", "<p>a</p>\n<", "<html><body><p>some text and", '{"a": [1', "a{b:c} .d {", "let a = docu", "function f(e) { return e;", "<svg><path d=", png[:-6], "A sentence that is long enough. And one that is not com", "文です。文の途" + "中で" * 30]
    types = {"{": "application/json", "a{": "text/css", "le": "text/javascript", "fu": "text/javascript"}
    rows = [("a", i, "s", next((v for k, v in types.items() if d and d.startswith(k)), "text/plain"), d) for i, d in enumerate([*whole, *open_])]
    assert cut(spark, rows) == set(range(len(whole), len(whole) + len(open_)))


def test_limits_are_spikes(spark):
    body = "word " * 100
    rows = [("a", i, "s", "text/plain", f"- {body}"[:100] if i < 30 else f"- {body}"[: 110 + i % 57]) for i in range(200)]
    got = t.cut_values(parts(spark, rows)).collect()
    assert {r["part_no"] for r in got if r["cut"]} == set(range(30)) and all(r["at_limit"] for r in got if r["part_no"] < 30)
    report = t.truncation_report(parts(spark, rows)).collect()[0]
    assert (report["n_parts"], report["n_cut"], report["cut_share"]) == (200, 30, 0.15)


def test_svg_needs_the_end_of_its_root(spark):
    whole = ["<svg/>", "<?xml version='1.0'?>\n<svg width='1'/>\n", "<svg><svg><path/></svg></svg>", "<svg><svg/><path/></svg>\n<!-- <svg> -->", "<svg><path/></svg><p>A page.</p>"]
    open_ = ["<svg><path/>", "<svg><g><path/></g>", "<svg width='1'>", "<svg><svg><path/></svg>", "<svg><path/><!-- </svg> -->"]
    assert cut(spark, [("a", i, "s", "image/svg+xml", d) for i, d in enumerate([*whole, *open_])]) == set(range(len(whole), len(whole) + len(open_)))


def test_each_kind_has_its_own_end_at_a_limit(spark):
    pieces = {
        "text/html": ("<html><body><nav><ul><li>a</li></ul>", "<html><body><nav><ul><li>a</li></ul></nav>", "<p>{}</p>"),
        "text/css": ("/* a {b:c}", "/* a {b:c} */", "a.{}{{b:c}}"),
        "text/javascript": ("window.on(function() {}", "window.on(function() {});", "let a{} = {{}}"),
    }
    rows, expected = [], set()
    for k, (kind, (open_, whole, fill)) in enumerate(pieces.items()):
        for i in range(40):
            start, size = (open_, 300) if i < 20 else (whole, 300) if i < 25 else (open_, 320 + 7 * i)
            rows.append((f"{k}", i, f"s{k}", kind, start + fill.format("x" * (size - len(start) - len(fill.format(""))))))
            if i < 20:
                expected.add((f"{k}", i))
    got = t.cut_values(parts(spark, rows)).collect()
    assert {len(r[4]) for r in rows if r[1] < 25} == {300}
    assert {(r["archive_id"], r["part_no"]) for r in got if r["cut"]} == expected


def test_marked_limit_and_repeated_rows(spark):
    rows = [("a", i % 20, "s", "text/plain", ("x" * 57 + f"{i % 20:02d} sentence that stops" + "y" * 60)[:97] + "...") for i in range(40)] + [("a", 99, "s", "text/plain", "It ends like that...")]
    assert cut(spark, rows) == set(range(20))


def test_report_tells_the_tests_apart(spark):
    # list items need no stop, so that only the limit tells; prose ends open at any length
    rows = [("a", i, "s", "text/plain", ("- " + "word " * 100)[: 100 if i < 30 else 110 + i]) for i in range(60)]
    rows += [("b", i, "s", "text/plain", ("Prose " + "word " * 100)[: 300 + 40 * i]) for i in range(4)]
    report = t.truncation_report(parts(spark, rows)).collect()[0]
    assert (report["n_cut"], report["n_broken"], report["n_by_limit"]) == (34, 4, 30)


def test_anomalies(spark):
    p = parts(spark, [("a", 0, "s", "text/html", "<p>x</p>")]).withColumnRenamed("id", "old").selectExpr("archive_id", "part_no", "source", "'https://e.com/abc' as id", "content_type", "data")
    rows = [("a", [("index-synthesized", "https://e.com/abc")]), ("b", [("index-synth", None)]), ("a", [("base64-left-encoded", "https://e.com/a")]), ("c", None), ("d", [("unknown", None)]), ("e", [("index-synthesized", "https://e.com/a")])]
    a = spark.createDataFrame(rows, "archive_id string, anomalies array<struct<type:string,id:string>>")
    assert {r["archive_id"] for r in t.cut_anomalies(a, p).collect()} == {"a", "b"}


def test_empty(spark):
    p = parts(spark, [("a", 0, "s", "t", "x")]).limit(0)
    a = spark.createDataFrame([], "archive_id string, anomalies array<struct<type:string,id:string>>")
    assert t.truncated_records(p, a).count() == t.truncation_report(p).count() == 0


def test_short_limits_and_frequent_whole_lengths(spark):
    # a limit of 24 characters; names of 9 characters are as frequent, but whole
    rows = [("a", i, "s", "text/css", f"a.n{i:03d}{{color:red;margin:auto}}"[:24]) for i in range(30)]
    rows += [("a", 100 + i, "s", "text/css", "a{b:c;d:e}"[: 10]) for i in range(30)] + [("a", 200 + i, "s", "text/css", f"a.n{'x' * i}{{color:red}}") for i in range(40)]
    got = {r["part_no"]: r for r in t.cut_values(parts(spark, rows)).collect()}
    assert {n for n, r in got.items() if r["cut"]} == {n for n, r in got.items() if r["by_limit"]} == set(range(30))
    assert t.length_limits(spark.createDataFrame([("s", 24, 24, True, False)] * 3, "source string, chars int, bytes int, failing boolean, ellipsis boolean")).count() == 0


def test_last_lines_and_blanks_of_any_length(spark):
    item = "Things to bring.\n\n- " + "a rope and a lamp and " * 100 + "a boat"
    rows = [("a", 0, "s", "text/plain", item), ("a", 1, "s", "text/plain", " " * 3000 + "<p>a</p>" + "\n" * 3000), ("a", 2, "s", "text/plain", "It ends well." + "\"" * 300), ("a", 3, "s", "text/html", "<p>a</p>" + " " * 3000 + "<img alt='" + "x" * 3000)]
    assert cut(spark, rows) == {3}
