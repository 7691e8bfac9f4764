import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.functions.delimited import START, STATES, chunk_table, compose, read_chunk, tokenize
from foliant.operators import records

GOOD = ["arc-0000000001", "3", 'text/html; charset="x"', "Base64 ", "12", "2024-02-29T23:59:59.5+02:00", '{"a": "b"}', '[{"type": "index-synthesized", "id": "_1"}]']


def line(fields, sep=","):
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator="").writerow(fields)
    return out.getvalue()


@given(st.text(alphabet='a",\n', max_size=40), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_chunks_compose_to_the_whole(text, size):
    chunks = [text[i : i + size] for i in range(0, len(text), size)]
    for breaks in (False, True):
        tables = [chunk_table(c, ",", breaks) for c in chunks]
        for state in STATES:
            assert compose(tables, [len(c) for c in chunks], state) == read_chunk(text, state, ",", breaks)


@given(st.lists(st.text(alphabet='ab",\t\n x', max_size=8), min_size=1, max_size=6), st.sampled_from([",", "\t"]))
@settings(max_examples=200, deadline=None)
def test_tokenizer_reads_what_csv_writes(fields, sep):
    quoted = sep.join('"' + f.replace('"', '""') + '"' for f in fields)
    assert tokenize(quoted, sep, 3) == (fields, -1)
    plain = [f for f in fields if '"' not in f and sep not in f] or ["a"]
    assert tokenize(sep.join(plain), sep)[0] == plain


def test_broken_quoting_has_an_offset():
    assert tokenize('a"b', ",") == (None, 1) and tokenize('"a"b', ",") == (None, 3) and tokenize('a,"b', ",") == (None, 4) and tokenize("", ",") == ([""], -1)


def test_columns():
    assert records.check_record(GOOD)[0] == []
    wrong = {0: ["arc-1", "ARC-0000000001", "arc-00000000012", " arc-0000000001"], 1: ["", "-1", "1.0", "٣"], 3: ["gzip", "7bits", "\xa08bit"], 4: ["1,5", " 1", ""], 6: ["", "null", "[]", "{'a': 'b'}", '{"a": 1}', '{"a": NaN}', '{"a": "b"} x'], 7: ["", "{}", '["x"]', '[{"type": "x"}]', '[{"id": "_1"}]', '[{"type": "index-synthesized", "id": 1}]', '[{"type": "index-synthesized", "id": null}]'],
             5: ["2023-02-29T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01 00:00:00", "2024-01-01T00:00:00+2:00", "2024-1-1T00:00:00Z", "2024-01-01T00:00:60Z", ""]}
    for i, values in wrong.items():
        for v in values:
            assert records.check_record([*GOOD[:i], v, *GOOD[i + 1 :]])[0] == [records.COLUMNS[i]], v


def test_spark(spark):
    rows = [
        (1, "a.csv", line(GOOD), "x"),
        (1, "a.csv", line(GOOD), "x"),
        (2, "a.tsv", line(GOOD, "\t"), "x"),
        (3, "a.csv", 'a"b', "x"),
        (4, "a.csv", "a,b", "x"),
        (5, "a.csv", None, "x"),
        (6, "a.csv", line(["x", "y", *GOOD[2:]]), "x"),
        (7, "a.csv", line(GOOD[:2] + ["v" * 200_000] + GOOD[3:]), "x"),
        (8, None, line(GOOD), None),
    ]
    lines = spark.createDataFrame(rows, "line_id bigint, file_name string, line string, reasons string")
    assert sorted(map(tuple, records.rejected_records(lines).collect())) == [(3, "quoting"), (4, "column_count"), (5, "column_count"), (6, "archive_id"), (6, "part_no")]
    good = {r["line_id"]: r for r in records.valid_records(lines).collect()}
    assert sorted(good) == [1, 2, 7, 8] and good[1]["transfer_encoding"] == "base64" and good[1]["part_no"] == 3 and good[1]["headers"] == {"a": "b"} and len(good[7]["content_type"]) == 200_000
    empty = lines.limit(0)
    assert records.rejected_records(empty).count() == records.valid_records(empty).count() == 0


def test_files_are_split_into_records_over_chunks(spark):
    text = 'a,b\r\n"c\n""d",e\n\nf\n"open, g\nh'
    expected = ["a,b", '"c\n""d",e', "", "f", '"open, g\nh']
    for size in (1, 3, 100):
        chunks = spark.createDataFrame([("f", i // size, text[i : i + size]) for i in range(0, len(text), size)], "file_name string, chunk_no bigint, text string")
        got = records.split_records(chunks).orderBy("record_no").collect()
        # the last record is never closed: it is measured, but not brought together
        assert [r["record"] for r in got] == [*expected[:-1], None], size
        assert [r["closed"] for r in got] == [True] * 4 + [False] and got[-1]["n_chars"] == len(expected[-1])
    assert START == 0
