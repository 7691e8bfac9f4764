"""The registered queries of the core, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import charset, columns, mimeheader, srcset, urls
from foliant.operators import archives as ops
from foliant.operators import records
from foliant.plans import build
from foliant.runtime import read_table, shared_dir, ship
from foliant.sources.archivefiles import put_files, read_archives, write_pages
from foliant.streaming.ingest import convert_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, into: dict | None = None, sql_into: dict | None = None):
    """Register a query, with the SQL that must give the same rows."""

    def register(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, base: str) -> DataFrame:
            ship(spark)
            return f(spark, base)

        (QUERIES if into is None else into)[name] = run
        if sql is not None:
            (SQL if sql_into is None else sql_into)[name] = sql
        return run

    return register


def _fields(sep: str, column: str) -> tuple[str, str]:
    """SQL: whether all quoting is sound, and the list of the fields, for one separator."""
    field = f"""("(?:[^"]|"")*"|[^"{sep}]*)"""
    return f"regexp_full_match({column}, '(?s){field}({sep}{field})*')", f"regexp_extract_all('{sep}' || {column}, '(?s){sep}{field}', 1)"


_COMMA, _TAB = _fields(",", "line"), _fields("\t", "line")
#: DuckDB lets a comma stand before a closing bracket, the standard doesn't; strings are emptied before it is looked for.
_STRICT = """json_valid({0}) AND NOT regexp_matches(regexp_replace({0}, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g'), ',\\s*[}}\\]]')"""
_KNOWN_TYPES = "('document-mislabeled-as-archive', 'declared-boundary-unused', 'multipart-without-delimiters', 'index-synthesized', 'base64-left-encoded')"
_RECORDS = f"""r AS (SELECT DISTINCT line_id, lower(coalesce(file_name, '')) LIKE '%.tsv' AS tabs, coalesce(line, '') AS line FROM part_lines),
    q AS (SELECT line_id, CASE WHEN tabs THEN {_TAB[0]} ELSE {_COMMA[0]} END AS quoted, list_transform(CASE WHEN tabs THEN {_TAB[1]} ELSE {_COMMA[1]} END, lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM r),
    c AS (SELECT line_id, f[1] AS archive_id, f[2] AS part_no, f[3] AS content_type, lower(trim(f[4], ' ' || chr(9))) AS transfer_encoding, f[5] AS n_bytes, f[6] AS captured_at, f[7] AS headers, f[8] AS anomalies FROM q WHERE quoted AND len(f) = 8),
    j AS (SELECT *, CASE WHEN {_STRICT.format('headers')} THEN headers END AS h, CASE WHEN {_STRICT.format('anomalies')} THEN anomalies END AS a FROM c),
    bad AS (SELECT line_id, 'quoting' AS reason FROM q WHERE NOT quoted UNION ALL SELECT line_id, 'column_count' FROM q WHERE quoted AND len(f) <> 8
    UNION ALL SELECT line_id, 'archive_id' FROM c WHERE NOT regexp_full_match(archive_id, 'arc-[0-9]{{10}}')
    UNION ALL SELECT line_id, 'part_no' FROM c WHERE NOT regexp_full_match(part_no, '[0-9]+')
    UNION ALL SELECT line_id, 'n_bytes' FROM c WHERE NOT regexp_full_match(n_bytes, '[0-9]+')
    UNION ALL SELECT line_id, 'transfer_encoding' FROM c WHERE transfer_encoding NOT IN ('', 'base64', 'quoted-printable', '7bit', '8bit', 'binary')
    UNION ALL SELECT line_id, 'captured_at' FROM c WHERE NOT regexp_full_match(captured_at, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])') OR try_cast(captured_at[:10] AS DATE) IS NULL
    UNION ALL SELECT line_id, 'headers' FROM j WHERE h IS NULL OR json_type(h) <> 'OBJECT' OR len(list_filter(json_keys(h), lambda k: json_type(h -> ('$."' || k || '"')) <> 'VARCHAR')) > 0
    UNION ALL SELECT line_id, 'anomalies' FROM j WHERE a IS NULL OR json_type(a) <> 'ARRAY' OR len(list_filter(CAST(CASE WHEN json_type(a) = 'ARRAY' THEN a ELSE '[]' END AS JSON[]), lambda x: coalesce(json_type(x) <> 'OBJECT'
      OR json_type(x -> '$.type') IS DISTINCT FROM 'VARCHAR' OR (x ->> '$.type') NOT IN {_KNOWN_TYPES} OR (list_contains(json_keys(x), 'id') AND json_type(x -> '$.id') <> 'VARCHAR'), true))) > 0)"""


@query("p2_found", f"WITH {_RECORDS} SELECT line_id, reason FROM bad")
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return records.rejected_records(read_table(spark, base, "part_lines"))


@query("p2_valid")
def p2_valid(spark: SparkSession, base: str) -> DataFrame:
    return records.valid_records(read_table(spark, base, "part_lines"))


@query(
    "p2_typed",
    f"""WITH {_RECORDS} SELECT line_id, archive_id, CAST(part_no AS BIGINT) AS part_no, content_type, transfer_encoding, CAST(n_bytes AS BIGINT) AS n_bytes, epoch_us(CAST(captured_at AS TIMESTAMPTZ)) AS captured_us,
        CAST(len(json_keys(h)) AS INT) AS n_headers, CAST(json_array_length(a) AS INT) AS n_anomalies FROM j WHERE line_id NOT IN (SELECT line_id FROM bad)""",
)
def p2_typed(spark: SparkSession, base: str) -> DataFrame:
    valid = records.valid_records(read_table(spark, base, "part_lines"))
    return valid.select("line_id", "archive_id", F.col("part_no").cast("bigint").alias("part_no"), "content_type", "transfer_encoding", F.col("n_bytes").cast("bigint").alias("n_bytes"), F.unix_micros("captured_at").alias("captured_us"), F.size("headers").alias("n_headers"), F.size("anomalies").alias("n_anomalies"))


@query("p2_once", "SELECT DISTINCT line_id, 1::BIGINT AS n FROM part_lines")
def p2_once(spark: SparkSession, base: str) -> DataFrame:
    lines = read_table(spark, base, "part_lines")
    return records.valid_records(lines).select("line_id").unionByName(records.rejected_records(lines).select("line_id").distinct()).groupBy("line_id").agg(F.count("*").alias("n"))


# ---- parsing: archives built from documents, so that SQL over documents tells what must come back -------------------------


def _documents(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "documents")


def _parse(rows: DataFrame, key: str, text: Column) -> DataFrame:
    return ops.parse_archives(rows.select(F.col(key).cast("string").alias("archive_id"), F.encode(text, "utf-8").alias("content")))


def _bodies(parsed: DataFrame, data: Column | None = None) -> DataFrame:
    return ops.archive_parts(parsed).select(F.col("archive_id").cast("bigint").alias("doc_id"), (F.col("data") if data is None else data).alias("text"))


_TEXTS = "SELECT doc_id, text FROM documents"


@query("parse_roundtrip_8bit", _TEXTS)
def parse_roundtrip_8bit(spark, base):
    return _bodies(_parse(_documents(spark, base), "doc_id", build.archive(build.part(F.col("text")))))


@query("roundtrip_base64", _TEXTS)
def roundtrip_base64(spark, base):
    body = build.part(F.base64(F.encode("text", "utf-8")), encoding="base64")
    return _bodies(_parse(_documents(spark, base), "doc_id", build.archive(body)), F.decode(columns.decode_base64(F.col("data")), "utf-8"))


@query("roundtrip_quoted_printable", _TEXTS)
def roundtrip_quoted_printable(spark, base):
    encoded = build.mapped(_documents(spark, base), "doc_id", F.col("text"), build.quoted_printable)
    return _bodies(_parse(encoded, "doc_id", build.archive(build.part(F.col("value"), encoding="quoted-printable"))))


@query("roundtrip_binary", _TEXTS)
def roundtrip_binary(spark, base):
    body = build.part(F.col("text"), "application/octet-stream", "binary")
    return _bodies(_parse(_documents(spark, base), "doc_id", build.archive(body)), F.decode(columns.decode_base64(F.col("data")), "utf-8"))


@query("delimiter_variants", "SELECT doc_id, v AS variant, text FROM documents, (SELECT unnest(['glued', 'lf', 'open', 'padding', 'preamble']) AS v)")
def delimiter_variants(spark, base):
    text = F.col("text")
    plain = build.part(text)
    variants = {
        "glued": build.archive(F.regexp_replace(plain, "\r\n$", "")),
        "lf": build.archive(build.part(text, eol="\n"), eol="\n"),
        "open": build.archive(plain, closing=False),
        "padding": build.archive(F.concat(F.lit(f"--{build.BOUNDARY} \t\r\n"), F.substring(plain, len(build.BOUNDARY) + 5, 1 << 30))),
        "preamble": build.archive(plain, preamble="This is a multi-part message.\r\n--not the boundary\r\n"),
    }
    rows = _documents(spark, base).select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), v.alias("value")) for k, v in variants.items()))).alias("v"))
    rows = rows.select(F.concat_ws("/", F.col("doc_id").cast("string"), "v.variant").alias("key"), "v.value")
    parsed = ops.archive_parts(_parse(rows, "key", F.col("value")))
    return parsed.select(F.split("archive_id", "/")[0].cast("bigint").alias("doc_id"), F.split("archive_id", "/")[1].alias("variant"), F.col("data").alias("text"))


def _threads(spark: SparkSession, base: str, *, location: bool = False) -> DataFrame:
    """An archive per thread: its documents are the parts, by document id."""
    at = F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string")) if location else None
    rows = _documents(spark, base).withColumn("thread", F.coalesce("question_id", "doc_id")).select("thread", "doc_id", build.part(F.col("text"), location=at).alias("part"))
    joined = rows.groupBy("thread").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "part"))), lambda x: x["part"]), "").alias("body"))
    return joined.select(F.col("thread").cast("string").alias("archive_id"), F.encode(build.archive(F.col("body")), "utf-8").alias("content"))


_THREAD = "SELECT coalesce(question_id, doc_id) AS thread, doc_id, text FROM documents"


@query("thread_part_counts", f"SELECT thread, count(*) AS n_parts FROM ({_THREAD}) GROUP BY thread")
def thread_part_counts(spark, base):
    return ops.archive_parts(ops.parse_archives(_threads(spark, base))).groupBy(F.col("archive_id").cast("bigint").alias("thread")).agg(F.count("*").alias("n_parts"))


@query("generated_ids", f"SELECT thread, '_' || (row_number() OVER (PARTITION BY thread ORDER BY doc_id) - 1) AS id, text FROM ({_THREAD})")
def generated_ids(spark, base):
    return ops.archive_parts(ops.parse_archives(_threads(spark, base))).select(F.col("archive_id").cast("bigint").alias("thread"), "id", F.col("data").alias("text"))


@query("part_locations", f"SELECT thread, 'https://docs.example/' || doc_id AS id, text FROM ({_THREAD})")
def part_locations(spark, base):
    return ops.archive_parts(ops.parse_archives(_threads(spark, base, location=True))).select(F.col("archive_id").cast("bigint").alias("thread"), "id", F.col("data").alias("text"))


@query("nested_alternative", "SELECT doc_id, o AS ordinal, d AS depth, t AS content_type FROM documents, (VALUES (0, 0, 'multipart/alternative; boundary=inner'), (1, 1, 'text/plain'), (2, 1, 'text/html'), (3, 0, 'text/css')) v(o, d, t)")
def nested_alternative(spark, base):
    inner = F.concat(F.lit("--inner\r\nContent-Type: text/plain\r\n\r\n"), F.col("text"), F.lit("\r\n--inner\r\nContent-Type: text/html\r\n\r\n<p>x</p>\r\n--inner--"))
    text = build.archive(build.part(inner, "multipart/alternative; boundary=inner"), build.part(F.lit("a{}"), "text/css"))
    parts = ops.archive_parts(_parse(_documents(spark, base), "doc_id", text))
    return parts.select(F.col("archive_id").cast("bigint").alias("doc_id"), "ordinal", "depth", "content_type")


@query("parts_behind_closing", "SELECT doc_id, o AS ordinal, CASE o WHEN 0 THEN text ELSE kind END AS text FROM documents, (VALUES (0), (1), (2)) v(o)")
def parts_behind_closing(spark, base):
    # a closing delimiter between two parts, a text behind it, and a delimiter with headers after that
    b = build.BOUNDARY
    more = F.concat(F.lit(f"--{b}--\r\nContent-Type: text/plain\r\n\r\n"), F.col("kind"), F.lit(f"\r\n--{b}--\r\nno part\r\n\r\nat all\r\n--{b}\r\nContent-Type: text/css\r\n\r\n"), F.col("kind"), F.lit("\r\n"))
    parts = ops.archive_parts(_parse(_documents(spark, base), "doc_id", build.archive(build.part(F.col("text")), more)))
    return parts.select(F.col("archive_id").cast("bigint").alias("doc_id"), "ordinal", F.col("data").alias("text"))


_ANOMALY = "SELECT doc_id, '{}' AS type, {} AS id FROM documents"


def _anomalies(spark: SparkSession, base: str, text: Column) -> DataFrame:
    return ops.archive_anomalies(_parse(_documents(spark, base), "doc_id", text)).select(F.col("archive_id").cast("bigint").alias("doc_id"), "type", "id")


@query("anomaly_mislabelled", _ANOMALY.format("document-mislabeled-as-archive", "CAST(NULL AS VARCHAR)"))
def anomaly_mislabelled(spark, base):
    return _anomalies(spark, base, F.concat(F.repeat(F.lit("\r\n "), 2000), F.lit("<html><body><p>"), columns.escape_text(F.col("text")), F.lit("</p></body></html>")))


@query("anomaly_boundary_unused", _ANOMALY.format("declared-boundary-unused", "CAST(NULL AS VARCHAR)"))
def anomaly_boundary_unused(spark, base):
    return _anomalies(spark, base, build.archive(build.part(F.col("text")), boundary="another"))


@query("anomaly_no_delimiters", _ANOMALY.format("multipart-without-delimiters", "CAST(NULL AS VARCHAR)"))
def anomaly_no_delimiters(spark, base):
    return _anomalies(spark, base, F.concat(F.lit("Content-Type: multipart/related; boundary=b\r\n\r\nContent-Type: text/plain\r\n\r\n"), F.col("text")))


@query("anomaly_left_encoded", _ANOMALY.format("base64-left-encoded", "'https://docs.example/' || doc_id"))
def anomaly_left_encoded(spark, base):
    at = F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string"))
    return _anomalies(spark, base, build.archive(build.part(F.lit("not base64!"), "text/html", "base64", location=at)))


@query("header_fields", "SELECT doc_id, n AS name, CASE n WHEN 'x-kind' THEN kind WHEN 'x-folded' THEN 'one' || kind ELSE 'id ' || doc_id END AS value FROM documents, (SELECT unnest(['x-kind', 'x-folded', 'subject']) AS n)")
def header_fields(spark, base):
    head = F.concat(F.lit("X-Kind: none\r\nx-kind:  "), F.col("kind"), F.lit(" \r\nX-Folded: one\r\n\t"), F.col("kind"), F.lit("\r\nSubject: id "), F.col("doc_id").cast("string"), F.lit("\r\n"))
    parsed = _parse(_documents(spark, base), "doc_id", build.archive(build.part(F.lit("x")), headers=head))
    return ops.archive_headers(parsed).filter("name != 'content-type'").select(F.col("archive_id").cast("bigint").alias("doc_id"), "name", "value")


_TITLES = "SELECT doc_id, title FROM documents WHERE title IS NOT NULL"


def _words(spark: SparkSession, base: str, how) -> DataFrame:
    titled = _documents(spark, base).filter("title IS NOT NULL")
    return build.mapped(build.mapped(titled, "doc_id", F.col("title"), how), "doc_id", F.col("value"), mimeheader.decode_header).withColumnRenamed("value", "title")


@query("encoded_words_b", _TITLES)
def encoded_words_b(spark, base):
    return _words(spark, base, build.words_b)


@query("encoded_words_q", _TITLES)
def encoded_words_q(spark, base):
    return _words(spark, base, build.words_q)


# ---- charsets and content types ---------------------------------------------------------------------------------------


@query("charset_cyrillic", "SELECT doc_id, text FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7FА-яЁё]*')")
def charset_cyrillic(spark, base):
    # the texts that windows-1251 can hold; the page says so in its meta elements only
    rows = _documents(spark, base).filter(F.col("text").rlike("\\A[\\x00-\\x7FА-яЁё]*\\z"))
    head = "Content-Type: text/html\r\n\r\n<html><head><meta charset=\"windows-1251\"></head><body><pre>\n"

    def page(text: str) -> bytes:
        return (head + text.replace("&", "&amp;").replace("<", "&lt;") + "</pre></body></html>").encode("cp1251")

    content = build.mapped(rows, "doc_id", F.col("text"), page, "binary")
    parts = ops.archive_parts(ops.parse_archives(content.select(F.col("doc_id").cast("string").alias("archive_id"), F.col("value").alias("content"))))
    body = F.regexp_extract("data", "(?s)<pre>(.*)</pre>", 1)
    plain = F.replace(F.replace(F.replace(body, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return parts.select(F.col("archive_id").cast("bigint").alias("doc_id"), plain.alias("text"))


@query("charset_mark", _TEXTS)
def charset_mark(spark, base):
    content = build.mapped(_documents(spark, base), "doc_id", F.col("text"), lambda t: b"\xff\xfe" + t.encode("utf-16-le"), "binary")
    return build.mapped(content, "doc_id", F.col("value"), lambda b: charset.decode(b, charset.mark_charset(b))).withColumnRenamed("value", "text")


#: Labels with a phrase in their charset, and the place where a document names it.
_PHRASES = {"koi8-r": "Привет, мир", "windows-1251": "Съешь ещё", "shift_jis": "日本語テスト", "euc-jp": "日本語の本", "gbk": "中文字符", "big5": "繁體中文", "euc-kr": "한국어", "iso-8859-2": "Zażółć", "macintosh": "déjà"}
_PLACES = ("header", "meta", "http-equiv", "sheet")


@query("charset_matrix", f"SELECT doc_id, l AS label, w AS place, p || ' ' || doc_id AS text FROM documents, (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _PHRASES.items())}) v(l, p), (VALUES {', '.join(f"('{w}')" for w in _PLACES)}) u(w)")
def charset_matrix(spark, base):
    def content(key: str) -> bytes:
        label, place, n = key.split(" ")
        text = f"{_PHRASES[label]} {n}"
        if place == "sheet":
            body, kind = f'@charset "{label}"; /*<{text}>*/', "text/css"
        else:
            meta = {"header": "", "meta": f'<meta charset="{label}">', "http-equiv": f'<meta http-equiv="Content-Type" content="text/html; charset={label}">'}[place]
            body, kind = f"<html><head>{meta}</head><body><p>{text}</p></body></html>", "text/html" + (f"; charset={label}" if place == "header" else "")
        return f"Content-Type: {kind}\r\n\r\n".encode() + body.encode({"macintosh": "mac-roman"}.get(label, label))

    keys = F.explode(F.array(*(F.concat_ws(" ", F.lit(k), F.lit(w), F.col("doc_id").cast("string")) for k in _PHRASES for w in _PLACES)))
    rows = build.mapped(_documents(spark, base).select(keys.alias("key")), "key", F.col("key"), content, "binary")
    parts = ops.archive_parts(ops.parse_archives(rows.select(F.col("key").alias("archive_id"), F.col("value").alias("content"))))
    words = F.split("archive_id", " ")
    return parts.select(words[2].cast("bigint").alias("doc_id"), words[0].alias("label"), words[1].alias("place"), F.regexp_extract("data", "<(?:p>)?([^<>]*)(?:</p>|>\\*/)", 1).alias("text"))


@query("raw_headers", "SELECT doc_id, l AS label, p || ' ' || doc_id AS sender FROM documents, (VALUES ('koi8-r', 'Привет'), ('windows-1251', 'Съешь'), ('shift_jis', '日本語')) v(l, p)")
def raw_headers(spark, base):
    def content(key: str) -> bytes:
        label, n = key.split(" ")
        sender = {"koi8-r": "Привет", "windows-1251": "Съешь", "shift_jis": "日本語"}[label]
        return f"From: {sender} {n}\r\nContent-Type: text/html; charset={label}\r\n\r\n<p>x</p>".encode(label)

    keys = F.explode(F.array(*(F.concat_ws(" ", F.lit(k), F.col("doc_id").cast("string")) for k in ("koi8-r", "windows-1251", "shift_jis"))))
    rows = build.mapped(_documents(spark, base).select(keys.alias("key")), "key", F.col("key"), content, "binary")
    heads = ops.archive_headers(ops.parse_archives(rows.select(F.col("key").alias("archive_id"), F.col("value").alias("content")))).filter("name = 'from'")
    return heads.select(F.split("archive_id", " ")[1].cast("bigint").alias("doc_id"), F.split("archive_id", " ")[0].alias("label"), F.col("value").alias("sender"))


@query("unknown_labels", "SELECT doc_id, l AS label, text FROM documents, (SELECT unnest(['utf-7', 'unicode_escape', 'punycode', 'cp037', 'no-such']) AS l)")
def unknown_labels(spark, base):
    labels = ("utf-7", "unicode_escape", "punycode", "cp037", "no-such")
    rows = _documents(spark, base).select(F.explode(F.array(*(F.struct(F.concat_ws(" ", F.lit(x), F.col("doc_id").cast("string")).alias("key"), build.archive(build.part(F.col("text"), f"text/plain; charset={x}")).alias("value")) for x in labels))).alias("v")).select("v.*")
    parts = ops.archive_parts(_parse(rows, "key", F.col("value")))
    return parts.select(F.split("archive_id", " ")[1].cast("bigint").alias("doc_id"), F.split("archive_id", " ")[0].alias("label"), F.col("data").alias("text"))


_PART_KEYS = "SELECT DISTINCT archive_id, part_no, content_type, transfer_encoding, id, content_id, data FROM parts"


def _parts(spark: SparkSession, base: str) -> DataFrame:
    """The parts table as the engine's own part rows, redelivered rows once."""
    rows = read_table(spark, base, "parts").select("archive_id", F.col("part_no").alias("ordinal"), "id", "content_id", "content_type", "transfer_encoding", "data").distinct()
    return rows.select("archive_id", "ordinal", F.lit(0).alias("depth"), "id", F.col("id").alias("written_id"), "content_id", "content_type", "transfer_encoding", F.lit(None).cast("string").alias("charset"), F.lit(False).alias("container"), "data")


@query(
    "content_type_parameters",
    f"""SELECT archive_id, part_no, nullif(lower(trim(replace(regexp_extract(content_type, '(?i)charset=([^;]+)', 1), '"', ''))), '') AS charset,
        trim(split_part(content_type, ';', 1)) AS media FROM ({_PART_KEYS})""",
)
def content_type_parameters(spark, base):
    return _parts(spark, base).select("archive_id", F.col("ordinal").alias("part_no"), columns.charset_parameter(F.col("content_type")).alias("charset"), F.trim(F.substring_index("content_type", ";", 1)).alias("media"))


_CLASSES = {
    "document": ("is_document", "lower(content_type) LIKE 'text/html%' OR lower(content_type) LIKE 'application/xhtml+xml%'"),
    "stylesheet": ("is_stylesheet", "lower(content_type) LIKE 'text/css%'"),
    "text": ("is_text", "lower(content_type) LIKE 'text/%'"),
    "image": ("is_image", "lower(content_type) LIKE 'image/%'"),
    "plain": ("is_plain_text", "lower(content_type) LIKE 'text/plain%'"),
    "media": ("is_media", "regexp_matches(lower(content_type), '^(image|audio|video|font)/')"),
    "multipart": ("is_multipart", "lower(content_type) LIKE 'multipart/%'"),
    "alternative": ("is_alternative", "lower(content_type) LIKE 'multipart/alternative%'"),
}


@query("content_type_classes", f"SELECT archive_id, part_no, {', '.join(f'coalesce({sql}, false) AS {name}' for name, (_, sql) in _CLASSES.items())} FROM ({_PART_KEYS})")
def content_type_classes(spark, base):
    return _parts(spark, base).select("archive_id", F.col("ordinal").alias("part_no"), *(getattr(columns, f)(F.col("content_type")).alias(name) for name, (f, _) in _CLASSES.items()))


@query("base64_sizes", f"SELECT archive_id, part_no, CAST(floor(length(rtrim(data, '=')) * 3 / 4) AS BIGINT) AS n_bytes FROM ({_PART_KEYS}) WHERE data LIKE 'iVBOR%' AND regexp_full_match(data, '[A-Za-z0-9+/]*=*') AND length(rtrim(data, '=')) % 4 <> 1")
def base64_sizes(spark, base):
    rows = _parts(spark, base).filter("data LIKE 'iVBOR%'").select("archive_id", F.col("ordinal").alias("part_no"), F.length(columns.decode_base64(F.col("data"))).cast("bigint").alias("n_bytes"))
    return rows.filter("n_bytes IS NOT NULL")


@query(
    "data_addresses",
    f"""SELECT archive_id, part_no, 'data:' || array_to_string(list_filter(list_transform(string_split(coalesce(content_type, 'application/octet-stream'), ';'), lambda x: trim(replace(x, '"', ''))), lambda x: x <> ''), ';') || ';base64,'
        || CASE WHEN lower(trim(transfer_encoding)) = 'base64' THEN data ELSE to_base64(encode(data)) END AS address FROM ({_PART_KEYS}) WHERE data IS NOT NULL""",
)
def data_addresses(spark, base):
    rows = _parts(spark, base).filter("data IS NOT NULL")
    return rows.select("archive_id", F.col("ordinal").alias("part_no"), columns.data_address(F.col("content_type"), F.col("transfer_encoding"), F.col("data")).alias("address"))


# ---- addresses and references -----------------------------------------------------------------------------------------

_KEYS = f"""SELECT archive_id, 'resource' AS kind, key, min(part_no) AS ordinal FROM (SELECT archive_id, part_no, id AS key FROM ({_PART_KEYS}) UNION ALL SELECT archive_id, part_no, content_id FROM ({_PART_KEYS})) WHERE key IS NOT NULL GROUP BY ALL
    UNION ALL SELECT archive_id, 'frame', content_id, max(part_no) FROM ({_PART_KEYS}) WHERE content_id IS NOT NULL GROUP BY ALL"""


@query("address_map", _KEYS)
def address_map(spark, base):
    return ops.addresses(_parts(spark, base))


@query("index_documents", f"SELECT archive_id, min(part_no) AS ordinal, arg_min(id, part_no) AS id FROM ({_PART_KEYS}) WHERE lower(content_type) LIKE 'text/html%' OR lower(content_type) LIKE 'application/xhtml+xml%' GROUP BY archive_id")
def index_documents(spark, base):
    return ops.index_parts(_parts(spark, base))


@query(
    "synthesized_indexes",
    f"""SELECT archive_id, min(part_no) AS ordinal, arg_min(id, part_no) AS id FROM ({_PART_KEYS}) WHERE (lower(content_type) LIKE 'image/%' OR lower(content_type) LIKE 'text/plain%')
        AND archive_id NOT IN (SELECT archive_id FROM parts WHERE lower(content_type) LIKE 'text/html%' OR lower(content_type) LIKE 'application/xhtml+xml%') GROUP BY archive_id""",
)
def synthesized_indexes(spark, base):
    return ops.synthesized_index(_parts(spark, base))


_DOCS = f"SELECT * FROM ({_PART_KEYS}) WHERE (lower(content_type) LIKE 'text/html%' OR lower(content_type) LIKE 'application/xhtml+xml%') AND data IS NOT NULL AND coalesce(lower(transfer_encoding), '') <> 'base64'"
#: The markup of the table has references in link, script and img elements only, quoted and absolute.
_REFS = f"""SELECT archive_id, part_no, unnest(regexp_extract_all(data, '<(?:link rel="[a-z ]*(?:stylesheet|icon)[a-z ]*" href|script src|img src)="([^"]*)"', 1)) AS address FROM ({_DOCS})"""
_HITS = f"""SELECT r.archive_id, r.part_no AS ordinal, r.address AS resolved, coalesce(k.ordinal, -1) AS part FROM ({_REFS}) r LEFT JOIN (SELECT * FROM ({_KEYS}) WHERE kind = 'resource') k ON k.archive_id = r.archive_id AND k.key = r.address"""


def _resolved(spark: SparkSession, base: str) -> DataFrame:
    parts = _parts(spark, base)
    return ops.resolve_references(ops.references(parts), ops.addresses(parts))


@query("resolved_references", _HITS)
def resolved_references(spark, base):
    return _resolved(spark, base).select("archive_id", "ordinal", "resolved", F.coalesce("part", F.lit(-1)).alias("part"))


@query("unfound_references", f"SELECT DISTINCT archive_id, resolved AS address FROM ({_HITS}) WHERE part < 0 AND resolved NOT LIKE 'data:%'")
def unfound_references(spark, base):
    return ops.unfound_references(_resolved(spark, base))


@query("used_parts", f"SELECT DISTINCT archive_id, part AS ordinal FROM ({_HITS}) WHERE part >= 0")
def used_parts(spark, base):
    return ops.used_parts(_resolved(spark, base))


_MISSING = f"SELECT archive_id, resolved AS address FROM ({_HITS}) WHERE part < 0 AND regexp_matches(resolved, '^(https?:|urn:)') GROUP BY ALL"


@query("missing_resources", _MISSING)
def missing_resources(spark, base):
    return ops.missing_resources(_resolved(spark, base)).select("archive_id", "address")


@query("archives_without_holes", f"SELECT archive_id FROM archives EXCEPT SELECT archive_id FROM ({_HITS}) WHERE part < 0 AND resolved NOT LIKE 'data:%'")
def archives_without_holes(spark, base):
    known = read_table(spark, base, "archives").select("archive_id").distinct()
    return known.join(ops.unfound_references(_resolved(spark, base)).select("archive_id").distinct(), "archive_id", "left_anti")


#: Answers of an address in the order they were fetched; the first that isn't to be repeated ends the attempts.
_ANSWERS = """SELECT url, status, row_number() OVER (PARTITION BY url ORDER BY fetched_at NULLS LAST, status NULLS FIRST, content_type NULLS FIRST) AS attempt,
    status = 429 OR status BETWEEN 500 AND 599 AS transient,
    CASE WHEN coalesce(trim(retry_after), '') = '' THEN 500 WHEN try_cast(trim(retry_after) AS DOUBLE) IS NOT NULL THEN greatest(0, try_cast(trim(retry_after) AS DOUBLE) * 1000)
         WHEN try_strptime(regexp_replace(trim(retry_after), '^\\w+,\\s*', ''), '%d %b %Y %H:%M:%S GMT') IS NOT NULL
         THEN greatest(0, epoch_ms(try_strptime(regexp_replace(trim(retry_after), '^\\w+,\\s*', ''), '%d %b %Y %H:%M:%S GMT')) - epoch_ms(fetched_at)) END AS delay FROM web"""
_LAST = f"SELECT url, arg_min(status, attempt) AS status FROM ({_ANSWERS}) WHERE attempt <= 3 AND status IS NOT NULL AND (NOT transient OR delay IS NULL OR delay > 5000) GROUP BY url"


_HOLES = "SELECT DISTINCT archive_id, unnest(unfound_resources) AS address FROM page_data"


@query("fetch_answers", f"SELECT m.archive_id, m.address, coalesce(l.status, 0) AS status, coalesce(l.status BETWEEN 200 AND 299, false) AS ok FROM ({_HOLES}) m LEFT JOIN ({_LAST}) l ON l.url = m.address")
def fetch_answers(spark, base):
    holes = read_table(spark, base, "page_data").select("archive_id", F.explode("unfound_resources").alias("address")).distinct().withColumn("encoding", F.lit("base64"))
    answers = ops.fetch(holes, read_table(spark, base, "web"))
    return answers.select("archive_id", "address", F.coalesce("status", F.lit(0)).alias("status"), "ok")


_OK = f"SELECT url, status FROM ({_LAST}) WHERE status BETWEEN 200 AND 299"


@query(
    "fetch_rounds",
    f"""SELECT archive_id, part_no AS ordinal, id FROM ({_PART_KEYS}) UNION ALL
        SELECT m.archive_id, l.last + row_number() OVER (PARTITION BY m.archive_id ORDER BY m.address), m.address FROM ({_MISSING}) m JOIN ({_OK}) o ON o.url = m.address JOIN (SELECT archive_id, max(part_no) AS last FROM parts GROUP BY archive_id) l ON l.archive_id = m.archive_id""",
)
def fetch_rounds(spark, base):
    parts, _ = ops.fetch_rounds(_parts(spark, base), read_table(spark, base, "web"))
    return parts.select("archive_id", "ordinal", "id")


def _chain(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """A page for each address of web, which reaches it through a sheet and the sheet that this one imports."""
    web = read_table(spark, base, "web")
    urls_ = web.select("url").distinct().withColumn("key", F.sha1("url"))
    page = F.concat(F.lit('<link rel="stylesheet" href="https://chain.example/'), "key", F.lit('/a.css"><img src="https://chain.example/none.png">'))
    parts = urls_.select(
        F.col("key").alias("archive_id"), F.lit(0).alias("ordinal"), F.lit(0).alias("depth"), F.lit("https://chain.example/").alias("id"), F.lit("https://chain.example/").alias("written_id"), F.lit(None).cast("string").alias("content_id"),
        F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("transfer_encoding"), F.lit(None).cast("string").alias("charset"), F.lit(False).alias("container"), page.alias("data"),
    )

    def sheet(name: str, body: Column) -> DataFrame:
        return urls_.select(F.concat(F.lit("https://chain.example/"), "key", F.lit(name)).alias("url"), F.lit(200).alias("status"), F.lit("text/css").alias("content_type"), F.encode(body, "utf-8").alias("body"), F.lit(None).cast("string").alias("retry_after"), F.lit(None).cast("timestamp").alias("fetched_at"))

    sheets = sheet("/a.css", F.lit('@import "b.css";')).unionByName(sheet("/b.css", F.concat(F.lit('a{background:url("'), "url", F.lit('")}'))))
    answers = web.select("url", "status", F.lit("image/png").alias("content_type"), "body", "retry_after", "fetched_at").unionByName(sheets)
    return parts, answers


_CHAIN = """(SELECT DISTINCT sha1(url) AS key, url FROM web)"""


@query(
    "fetch_chain",
    f"""SELECT key AS archive_id, 'https://chain.example/' AS id, true AS ok FROM {_CHAIN} UNION ALL SELECT key, 'https://chain.example/' || key || '/' || n || '.css', true FROM {_CHAIN}, (VALUES ('a'), ('b')) v(n)
        UNION ALL SELECT key, 'https://chain.example/none.png', false FROM {_CHAIN} UNION ALL SELECT c.key, c.url, o.status IS NOT NULL FROM {_CHAIN} c LEFT JOIN ({_OK}) o ON o.url = c.url""",
)
def fetch_chain(spark, base):
    parts, failed = ops.fetch_rounds(*_chain(spark, base))
    return parts.select("archive_id", "id", F.lit(True).alias("ok")).unionByName(failed.select("archive_id", F.col("address").alias("id"), F.lit(False).alias("ok")))


@query("fetched_pages", f"SELECT c.key AS archive_id, CASE WHEN o.status IS NULL THEN 2 ELSE 1 END AS n_unfound FROM {_CHAIN} c LEFT JOIN ({_OK}) o ON o.url = c.url")
def fetched_pages(spark, base):
    parts, _ = ops.fetch_rounds(*_chain(spark, base))
    return ops.convert_parts(parts).select("archive_id", F.size("unfound_resources").alias("n_unfound"))


@query("retry_delays", f"SELECT DISTINCT url, attempt, coalesce(CASE WHEN delay <= 5000 THEN delay::BIGINT END, -1) AS delay FROM ({_ANSWERS})")
def retry_delays(spark, base):
    from pyspark.sql import Window

    order = Window.partitionBy("url").orderBy(F.col("fetched_at").asc_nulls_last(), "status", "content_type")
    web = read_table(spark, base, "web").withColumn("attempt", F.row_number().over(order))
    return web.select("url", F.col("attempt").cast("bigint").alias("attempt"), F.coalesce(columns.retry_delay_ms(F.col("retry_after"), F.lit(0), F.col("fetched_at")), F.lit(-1)).cast("bigint").alias("delay")).distinct()


@query("retry_control", "SELECT DISTINCT url, coalesce(status, 0) AS status, coalesce(status = 429 OR status BETWEEN 500 AND 599, false) AS transient, least(500 * 2 ** coalesce(status % 7, 0), 5000)::BIGINT AS backoff FROM web")
def retry_control(spark, base):
    web = read_table(spark, base, "web")
    return web.select("url", F.coalesce("status", F.lit(0)).alias("status"), columns.is_transient(F.col("status")).alias("transient"), columns.backoff_ms(F.coalesce(F.col("status") % 7, F.lit(0))).alias("backoff")).distinct()


# ---- addresses as values ----------------------------------------------------------------------------------------------

_URLS = "SELECT DISTINCT url FROM archives WHERE url IS NOT NULL"


def _urls(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "archives").select("url").filter("url IS NOT NULL").distinct()


@query("normalized_addresses", f"SELECT url, url AS normal FROM ({_URLS})")
def normalized_addresses(spark, base):
    spoiled = F.regexp_replace(F.regexp_replace(F.col("url"), "^https://([^/]*)/", "HTTPS://$1:443/./x/../"), "^http://([^/]*)/", " HTTP://$1:80/x/%2e%2E/")
    return build.mapped(_urls(spark, base), "url", spoiled, urls.normalize).withColumnRenamed("value", "normal")


@query("resolved_links", f"SELECT DISTINCT archive_id, 'https://' || host || href AS address FROM (SELECT archive_id, host, unnest(regexp_extract_all(data, '<a href=\"(/[^\"]*)\"', 1)) AS href FROM page_data)")
def resolved_links(spark, base):
    pages = read_table(spark, base, "page_data").select("archive_id", "host", F.explode(F.regexp_extract_all("data", F.lit('<a href="(/[^"]*)"'), 1)).alias("href")).distinct()
    keyed = pages.select("archive_id", F.concat_ws(" ", F.concat(F.lit("https://"), "host", F.lit("/a/b?c")), "href").alias("pair"))

    def resolve(pair: str) -> str:
        home, href = pair.split(" ", 1)
        return urls.resolve(href, home)

    return build.mapped(keyed, "archive_id", F.col("pair"), resolve).withColumnRenamed("value", "address").distinct()


@query("address_forms", f"SELECT url, '#top' AS same, url || '/x#top' AS other, url AS unwrapped, '<' || url || '>' AS cid FROM ({_URLS})")
def address_forms(spark, base):
    url = F.col("url")
    return _urls(spark, base).select(
        "url",
        columns.same_page_link(F.concat(url, F.lit("#top")), url).alias("same"),
        columns.same_page_link(F.concat(url, F.lit("/x#top")), url).alias("other"),
        columns.unwrap_urn(F.concat(F.lit("urn:snapshot-0:"), url)).alias("unwrapped"),
        columns.cid_key(F.concat(F.lit("cid:"), url)).alias("cid"),
    )


@query("output_names", "SELECT DISTINCT archive_id, regexp_replace(path, '\\.[^.]+$', '.html') AS page FROM archives")
def output_names(spark, base):
    return read_table(spark, base, "archives").select("archive_id", columns.output_name(F.col("path")).alias("page")).distinct()


# ---- style sheets, srcset, markup -------------------------------------------------------------------------------------


@query("sheet_references", "SELECT doc_id, n AS ref_no, k AS kind, 'https://s.example/a/' || doc_id || '/' || f AS address FROM documents, (VALUES (0, 'import', 'i.css'), (1, 'import', 'j.css'), (2, 'css', 'k l.png'), (3, 'css', 'm.png')) v(n, k, f)")
def sheet_references(spark, base):
    n = F.col("doc_id").cast("string")
    sheet = F.concat(F.lit("/* url(no.png) */ @import '"), n, F.lit("/i.css' screen; @IMPORT url( "), n, F.lit('/j.css ); a{content:"url(no)"; background:url("'), n, F.lit('/k l.png")} b{src:URL('), n, F.lit("/m.png), url(data:x)}"))
    part = _documents(spark, base).select(n.alias("archive_id"), F.lit(0).alias("ordinal"), F.lit("https://s.example/a/s.css").alias("id"), F.lit("text/css").alias("content_type"), F.lit(None).cast("string").alias("transfer_encoding"), sheet.alias("data"))
    return ops.references(part).select(F.col("archive_id").cast("bigint").alias("doc_id"), "ref_no", "kind", F.replace("resolved", F.lit("%20"), F.lit(" ")).alias("address"))


@query(
    "import_closure",
    """WITH RECURSIVE d AS (SELECT DISTINCT doc_id AS sheet, coalesce(duplicate_of, CASE WHEN question_id <> doc_id THEN question_id END) AS imported FROM documents),
       r AS (SELECT sheet, imported FROM d WHERE imported IS NOT NULL UNION SELECT r.sheet, d.imported FROM r JOIN d ON d.sheet = r.imported WHERE d.imported IS NOT NULL) SELECT DISTINCT sheet, imported FROM r""",
)
def import_closure(spark, base):
    imported = F.coalesce("duplicate_of", F.when(F.col("question_id") != F.col("doc_id"), F.col("question_id")))
    direct = _documents(spark, base).select(F.lit("all").alias("archive_id"), F.col("doc_id").alias("sheet"), imported.alias("imported")).filter("imported IS NOT NULL").distinct()
    return ops.import_closure(direct).select("sheet", "imported")


@query("srcset_candidates", "SELECT doc_id, 'a' || doc_id || '.png 1x, b.png ' || (doc_id + 1) || 'w ' || (doc_id + 2) || 'h, c(1,2).png 2.5x, d.png bad 3q' AS srcset FROM documents")
def srcset_candidates(spark, base):
    n = F.col("doc_id")
    text = F.concat(F.lit(" , a"), n.cast("string"), F.lit(".png  1.0x,b.png "), (n + 1).cast("string"), F.lit("w "), (n + 2).cast("string"), F.lit("h , c(1,2).png 2.5x, d.png bad 3q"))
    return build.mapped(_documents(spark, base), "doc_id", text, lambda t: srcset.serialize(srcset.parse(t))).withColumnRenamed("value", "srcset")


_SQ = "replace(replace({}, '&', '&amp;'), chr(160), '&nbsp;')"


@query(
    "escapes",
    f"""SELECT doc_id, replace(replace({_SQ.format('text')}, '<', '&lt;'), '>', '&gt;') AS as_text, replace({_SQ.format('text')}, '"', '&quot;') AS as_attribute,
        replace(replace(text, '&', '&amp;'), '<', '&lt;') AS as_plain, replace(replace('x </ ' || text || ' /> y', '</', '<\\/'), '/>', '\\/>') AS as_script FROM documents""",
)
def escapes(spark, base):
    text = F.col("text")
    return _documents(spark, base).select("doc_id", columns.escape_text(text).alias("as_text"), columns.escape_attribute(text).alias("as_attribute"), columns.escape_plain(text).alias("as_plain"), columns.escape_script(F.concat(F.lit("x </ "), text, F.lit(" /> y"))).alias("as_script"))


# ---- whole pages ------------------------------------------------------------------------------------------------------

_PAGES = "SELECT DISTINCT archive_id, data FROM page_data WHERE data IS NOT NULL"


def _converted(spark: SparkSession, base: str) -> DataFrame:
    pages = read_table(spark, base, "page_data").filter("data IS NOT NULL").select("archive_id", "data").distinct()
    return ops.convert_archives(pages.select("archive_id", F.encode("data", "utf-8").alias("content")))


@query("page_titles", f"SELECT archive_id, nullif(replace(replace(replace(replace(regexp_extract(data, '<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '') AS title FROM ({_PAGES})")
def page_titles(spark, base):
    return _converted(spark, base).select("archive_id", "title")


@query("page_heads", f"SELECT archive_id, true AS policy, true AS charset, 1::BIGINT AS scripts, true AS canonical, (length(data) - length(replace(data, '<li>', ''))) // 4 AS items, 'document-mislabeled-as-archive' AS anomaly FROM ({_PAGES})")
def page_heads(spark, base):
    html = F.col("html")

    def times(tag: str) -> Column:
        return ((F.length(html) - F.length(F.replace(html, F.lit(tag), F.lit("")))) / len(tag)).cast("bigint")

    return _converted(spark, base).select(
        "archive_id",
        html.contains("script-src 'none';").alias("policy"),
        html.contains('<head><meta charset="utf-8">').alias("charset"),
        times("<script").alias("scripts"),
        html.contains('<link rel="canonical" href="_0">').alias("canonical"),
        times("<li>").alias("items"),
        F.element_at("anomalies", 1)["type"].alias("anomaly"),
    )


@query("converted_parts")
def converted_parts(spark, base):
    pages = ops.convert_parts(_parts(spark, base))
    return pages.select("archive_id", "error", "title", F.length("html").alias("n_chars"), F.size("favicons").alias("n_favicons"), F.size("unfound_resources").alias("n_unfound"))


_TITLE_SQL = "nullif(replace(replace(replace(replace(regexp_extract({}, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '')"


@query(
    "converted_titles",
    f"""SELECT a.archive_id, d.archive_id IS NULL AND s.archive_id IS NULL AS failed, {_TITLE_SQL.format('d.data')} AS title FROM (SELECT DISTINCT archive_id FROM parts) a
        LEFT JOIN (SELECT archive_id, arg_min(coalesce(data, ''), part_no) AS data FROM ({_PART_KEYS}) WHERE lower(content_type) LIKE 'text/html%' OR lower(content_type) LIKE 'application/xhtml+xml%' GROUP BY archive_id) d USING (archive_id)
        LEFT JOIN (SELECT DISTINCT archive_id FROM parts WHERE lower(content_type) LIKE 'image/%' OR lower(content_type) LIKE 'text/plain%') s USING (archive_id)""",
)
def converted_titles(spark, base):
    return ops.convert_parts(_parts(spark, base)).select("archive_id", F.col("error").isNotNull().alias("failed"), "title")


@query("converted_unfound", f"SELECT DISTINCT archive_id, resolved AS address FROM ({_HITS}) h JOIN (SELECT archive_id, min(part_no) AS ordinal FROM ({_DOCS.replace(' AND data IS NOT NULL', '')}) GROUP BY archive_id) USING (archive_id, ordinal) WHERE part < 0 AND resolved NOT LIKE 'data:%'")
def converted_unfound(spark, base):
    # conversion and the anti-join must leave the same holes
    return ops.page_unfound(ops.convert_parts(_parts(spark, base))).distinct()


_TEXT_SQL = f"replace(replace({_SQ.format('text')}, '<', '&lt;'), '>', '&gt;')"


def _text_pages(spark: SparkSession, base: str, *parts: Column) -> DataFrame:
    rows = _documents(spark, base).select(F.col("doc_id").cast("string").alias("archive_id"), F.encode(build.archive(*parts), "utf-8").alias("content"))
    return ops.convert_archives(rows).withColumn("doc_id", F.col("archive_id").cast("bigint"))


@query(
    "sanitised_pages",
    f"""SELECT doc_id, 'T ' || doc_id AS title, {_TEXT_SQL} AS body, false AS handler, false AS script, true AS data_script, false AS refresh, false AS hint, false AS ping, '#x' AS link FROM documents""",
)
def sanitised_pages(spark, base):
    head = F.concat(F.lit('<html><head><title>T '), F.col("doc_id").cast("string"), F.lit('</title><meta http-equiv="Refresh" content="0"><link rel="preload" href="z"></head><body><p onclick="a" onfoo="b" integrity="c">'))
    tail = F.lit('</p><script>evil()</script><script type="application/ld+json">{"k": 1}</script><a href="#x" ping="y">l</a></body></html>')
    html = F.col("html")
    pages = _text_pages(spark, base, build.part(F.concat(head, columns.escape_text(F.col("text")), tail), "text/html; charset=utf-8", location=F.lit("https://e.example/p")))
    return pages.select(
        "doc_id",
        "title",
        F.regexp_extract(html, '(?s)<p onfoo="b">(.*?)</p>', 1).alias("body"),
        html.contains("onclick").alias("handler"),
        html.contains("evil()").alias("script"),
        html.contains('<script type="application/ld+json">{"k": 1}</script>').alias("data_script"),
        html.contains("Refresh").alias("refresh"),
        html.contains("preload").alias("hint"),
        html.contains("ping").alias("ping"),
        F.regexp_extract(html, '<a href="([^"]*)"', 1).alias("link"),
    )


@query("inlined_icons", "SELECT doc_id, 'https://e.example/i/' || doc_id || '.png' AS original_href, 'data:image/png;base64,' || to_base64(encode(text)) AS href, '16x16' AS sizes FROM documents")
def inlined_icons(spark, base):
    at = F.concat(F.lit("/i/"), F.col("doc_id").cast("string"), F.lit(".png"))
    page = build.part(F.concat(F.lit('<link rel="shortcut icon" sizes="16x16" href="'), at, F.lit('">')), "text/html", location=F.lit("https://e.example/p"))
    icon = build.part(F.base64(F.encode("text", "utf-8")), "image/png", "base64", location=F.concat(F.lit("https://e.example"), at))
    return ops.page_favicons(_text_pages(spark, base, page, icon)).select(F.col("archive_id").cast("bigint").alias("doc_id"), "original_href", "href", "sizes")


_IMAGE = "'data:image/png;base64,' || to_base64(encode(text))"
#: Where an image stands in a page, and the pattern that finds its address behind the conversion.
_IMAGE_PLACES = {
    "style attribute": ('<p style="color:red; background:url(i.png)">x</p>', 'style="color:red; background:[^"]*url\\((data:[^)"]*)\\)"'),
    "style element": ("<style>a{b:url('i.png')}</style>", "<style>a\\{b:[^}]*url\\((data:[^)]*)\\)\\}</style>"),
    "src": ('<img src="i.png">', '<img src="(data:[^"]*)" data-original-src="i.png">|<img data-original-src="i.png" src="(data:[^"]*)">'),
    "srcset": ('<img srcset="i.png 2x">', '<img [^>]*\\bsrcset="(data:[^ "]*) 2x"'),
    "background": ('<table background="i.png"></table>', '<table [^>]*\\bbackground="(data:[^"]*)"'),
    "input": ('<input type="image" src="i.png">', '<input [^>]*\\bsrc="(data:[^"]*)"'),
    "embed": ('<embed src="i.png">', '<embed [^>]*\\bsrc="(data:[^"]*)"'),
    "object": ('<object data="i.png"></object>', '<object [^>]*\\bdata="(data:[^"]*)"'),
    "video": ('<video src="i.png"></video>', '<video [^>]*\\bsrc="(data:[^"]*)"'),
    "frame of an image": ('<iframe src="i.png"></iframe>', '<iframe [^>]*\\bsrc="(data:[^"]*)"'),
}


def _image_part() -> Column:
    return build.part(F.base64(F.encode("text", "utf-8")), "image/png", "base64", location=F.lit("https://e.example/i.png"))


@query("inlined_images", f"SELECT doc_id, w AS place, {_IMAGE} AS address FROM documents, (SELECT unnest([{', '.join(repr(k) for k in _IMAGE_PLACES)}]) AS w)")
def inlined_images(spark, base):
    page = build.part(F.lit("".join(x for x, _ in _IMAGE_PLACES.values())), "text/html; charset=utf-8", location=F.lit("https://e.example/p"))
    pages = _text_pages(spark, base, page, _image_part())
    found = [F.struct(F.lit(k).alias("place"), F.concat(F.regexp_extract("html", x, 1), F.regexp_extract("html", x, 2) if "|" in x else F.lit("")).alias("address")) for k, (_, x) in _IMAGE_PLACES.items()]
    return pages.select("doc_id", F.inline(F.array(*found)))


@query("inlined_sheets", f"SELECT doc_id, 'print' AS media, 'https://e.example/s.css' AS original, {_IMAGE} AS image, 'b{{y:1}}' AS imported, {_IMAGE} AS nested FROM documents")
def inlined_sheets(spark, base):
    page = build.part(F.lit('<link rel="stylesheet" media="print" href="s.css">'), "text/html", location=F.lit("https://e.example/p"))
    sheet = build.part(F.lit('@charset "utf-8"; @import "t.css"; a{x:url(i.png)}'), "text/css", location=F.lit("https://e.example/s.css"))
    other = build.part(F.lit('b{y:1} @import url(s.css); c{z:url("i.png")}'), "text/css", location=F.lit("https://e.example/t.css"))
    html = F.col("html")
    style = _text_pages(spark, base, page, sheet, other, _image_part()).select("doc_id", html, F.regexp_extract(html, "(?s)<style ([^>]*)>(.*?)</style>", 2).alias("style"))
    style = style.withColumn("inner", F.decode(F.unbase64(F.regexp_extract("style", "url\\(data:text/css[^,]*,([^)]*)\\)", 1)), "utf-8"))
    return style.select(
        "doc_id", F.regexp_extract(html, '<style [^>]*\\bmedia="([^"]*)"', 1).alias("media"), F.regexp_extract(html, '<style [^>]*\\bdata-original-href="([^"]*)"', 1).alias("original"), F.regexp_extract("style", "a\\{x:.*?url\\((data:image[^)]*)\\)\\}", 1).alias("image"),
        F.regexp_extract("inner", "^(b\\{y:1\\})", 1).alias("imported"), F.regexp_extract("inner", "c\\{z:.*?url\\((data:image[^)]*)\\)\\}", 1).alias("nested"),
    )


@query("sheets_by_content_id", f"SELECT doc_id, {_IMAGE} AS image FROM documents")
def sheets_by_content_id(spark, base):
    # a sheet without an address of its own is seen from the page
    page = build.part(F.lit('<link rel="stylesheet" href="cid:s@x">'), "text/html", location=F.lit("https://e.example/p"))
    sheet = build.part(F.lit("a{x:url(i.png)}"), "text/css", location=F.lit("cid:s@x"), content_id=F.lit("<s@x>"))
    return _text_pages(spark, base, page, sheet, _image_part()).select("doc_id", F.regexp_extract("html", "a\\{x:.*?url\\((data:image[^)]*)\\)\\}", 1).alias("image"))


@query("frame_documents", f"SELECT doc_id, {_TEXT_SQL} AS body FROM documents")
def frame_documents(spark, base):
    page = build.part(F.lit('<html><head></head><frameset><frame src="f.html"></frameset></html>'), "text/html", location=F.lit("https://e.example/p"))
    inner = build.part(F.concat(F.lit("<p>"), columns.escape_text(F.col("text")), F.lit("</p>")), "text/html; charset=utf-8", location=F.lit("https://e.example/f.html"))
    address = F.url_decode(F.regexp_extract("html", '<frame [^>]*\\bsrc="data:text/html,([^"]*)"', 1))
    return _text_pages(spark, base, page, inner).select("doc_id", F.regexp_extract(address, "(?s)<p>(.*)</p>", 1).alias("body"))


@query("page_details", "SELECT doc_id, 'https://c.example/' || doc_id AS canonical, 1::BIGINT AS canonicals, true AS shadow, true AS untouched, coalesce(title, 'none') AS name, 'https://e.example/p' AS url, '<!DOCTYPE html>' AS doctype FROM documents")
def page_details(spark, base):
    n = F.col("doc_id").cast("string")
    body = F.concat(F.lit('<!DOCTYPE html><link rel="canonical" href="https://c.example/'), n, F.lit('"><template shadowmode="open"><p>x</p></template><video poster="p.png"></video><p data-k="1" lang="en">y</p>'))
    subject = F.concat(F.lit("Subject: =?utf-8?B?"), F.base64(F.encode(F.coalesce("title", F.lit("none")), "utf-8")), F.lit("?=\r\n"))
    content = build.archive(build.part(body, "text/html", location=F.lit("https://e.example/p")), headers=subject)
    rows = _documents(spark, base).select(n.alias("archive_id"), F.encode(content, "utf-8").alias("content"))
    html = F.col("html")
    info = F.replace(F.regexp_extract(html, '(?s)<script type="application/ld\\+json">(.*?)</script>', 1), F.lit("<\\/"), F.lit("</"))
    return ops.convert_archives(rows).select(
        F.col("archive_id").cast("bigint").alias("doc_id"), F.regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1).alias("canonical"), ((F.length(html) - F.length(F.replace(html, F.lit('rel="canonical"'), F.lit("")))) / 15).cast("bigint").alias("canonicals"),
        html.contains('<template shadowrootmode="open"><p>x</p></template>').alias("shadow"), html.contains('<video poster="p.png"></video><p data-k="1" lang="en">y</p>').alias("untouched"),
        F.get_json_object(info, "$.name").alias("name"), F.get_json_object(info, "$.url").alias("url"), F.regexp_extract(html, "^<![^>]*>", 0).alias("doctype"),
    )


@query("template_references", "SELECT doc_id, 'https://e.example/' || doc_id || '.png' AS address FROM documents")
def template_references(spark, base):
    n = F.col("doc_id").cast("string")
    page = F.concat(F.lit('<img src="/'), n, F.lit('.png"><template><img src="/in.png"><div><link rel="stylesheet" href="/in.css"></div></template>'))
    part = _documents(spark, base).select(n.alias("archive_id"), F.lit(0).alias("ordinal"), F.lit("https://e.example/p").alias("id"), F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("transfer_encoding"), page.alias("data"))
    return ops.references(part).select(F.col("archive_id").cast("bigint").alias("doc_id"), F.col("resolved").alias("address"))


def _files(spark: SparkSession, base: str, label: str) -> str:
    """The threads as archive files in a folder of the shared place."""
    folder = f"{shared_dir(spark)}/foliant-{label}-{uuid.uuid4().hex}"
    _threads(spark, base).select(F.concat(F.lit(f"{folder}/"), F.pmod(F.hash("archive_id"), F.lit(7)).cast("string"), F.lit("/"), "archive_id", F.lit(".mhtml")).alias("name"), "content").mapInArrow(put_files, "name string").count()
    return folder


@query("archives_from_files", f"SELECT thread, count(*) AS n_parts FROM ({_THREAD}) GROUP BY thread")
def archives_from_files(spark, base):
    read = read_archives(spark, _files(spark, base, "files") + "/*")
    parts = ops.archive_parts(ops.parse_archives(read))
    return parts.groupBy(F.regexp_extract("archive_id", "([0-9]+)\\.mhtml$", 1).cast("bigint").alias("thread")).agg(F.count("*").alias("n_parts"))


@query("archives_as_a_stream", f"SELECT DISTINCT thread, false AS failed FROM ({_THREAD})")
def archives_as_a_stream(spark, base):
    folder = _files(spark, base, "stream")
    convert_stream(spark, folder, f"{folder}-out", f"{folder}-state").awaitTermination()
    return spark.read.parquet(f"{folder}-out").select(F.regexp_extract("archive_id", "([0-9]+)\\.mhtml$", 1).cast("bigint").alias("thread"), F.lit(False).alias("failed"))


@query("written_pages", f"SELECT DISTINCT thread FROM ({_THREAD})")
def written_pages(spark, base):
    folder = _files(spark, base, "pages")
    write_pages(ops.convert_archives(read_archives(spark, folder)), f"{folder}-out")
    pages = read_archives(spark, f"{folder}-out", pattern="*.html")
    return pages.filter("length > 0").select(F.regexp_extract("path", "([0-9]+)\\.html$", 1).cast("bigint").alias("thread"))


@query("repaired_markup", f"SELECT doc_id, {_TEXT_SQL} || '<b>1</b><p><b>' || kind || '</b>3</p><table><tbody><tr><td><i>y</i></td></tr></tbody></table>' AS body FROM documents")
def repaired_markup(spark, base):
    # formatting closed out of order, and text that stands in a table outside of its cells
    page = F.concat(F.lit("<html><head></head><body><div><b>1<p>"), F.col("kind"), F.lit("</b>3</p><table>"), columns.escape_text(F.col("text")), F.lit("<td><i>y</table></div></body></html>"))
    pages = _text_pages(spark, base, build.part(page, "text/html; charset=utf-8", location=F.lit("https://e.example/p")))
    found = F.regexp_extract("html", "(?s)<div>(<b>1</b>.*?</p>)(.*)(<table>.*</table>)</div>", 2)
    return pages.select("doc_id", F.concat(found, F.regexp_extract("html", "(?s)<div>(<b>1</b>.*?3</p>)", 1), F.regexp_extract("html", "(?s)(<table>.*</table>)</div>", 1)).alias("body"))


@query("synthesized_pages", f"SELECT doc_id, {_TEXT_SQL} AS body, 'index-synthesized' AS anomaly FROM documents")
def synthesized_pages(spark, base):
    pages = _text_pages(spark, base, build.part(F.lit("a{}"), "text/css"), build.part(F.col("text"), "text/plain; charset=utf-8"))
    return pages.select("doc_id", F.regexp_extract("html", "(?s)<pre>(.*)</pre>", 1).alias("body"), F.element_at("anomalies", 1)["type"].alias("anomaly"))


@query("framed_pages", "SELECT doc_id, 'https://e.example/no/' || doc_id AS address FROM documents")
def framed_pages(spark, base):
    # the frame is reached by its Content-ID; what it misses is missed by the page
    page = build.part(F.lit('<iframe src="cid:f@x"></iframe>'), "text/html", location=F.lit("https://e.example/p"))
    frame = build.part(F.concat(F.lit('<base href="https://e.example/no/"><p>'), columns.escape_text(F.col("text")), F.lit('</p><img src="'), F.col("doc_id").cast("string"), F.lit('">')), "text/html; charset=utf-8", content_id=F.lit("<f@x>"))
    return ops.page_unfound(_text_pages(spark, base, page, frame).filter(F.col("html").contains("srcdoc=") & ~F.col("html").contains("cid:f@x&quot;"))).select(F.col("archive_id").cast("bigint").alias("doc_id"), "address")


def flagship(spark: SparkSession, base: str) -> DataFrame:
    """Archives of threads, parsed and converted: (archive_id, title, n_parts, n_unfound, n_chars)."""
    ship(spark)
    content = _threads(spark, base, location=True)
    parts = ops.archive_parts(ops.parse_archives(content)).groupBy("archive_id").agg(F.count("*").alias("n_parts"))
    pages = ops.convert_archives(content).select("archive_id", "title", F.size("unfound_resources").alias("n_unfound"), F.length("html").alias("n_chars"))
    return pages.join(parts, "archive_id")
