"""The engine over DataFrames: archives to parts, addresses, references, missing resources, pages.

Bytes and markup are read in Arrow batches by the pure kernels of ``foliant.functions``; everything between is relational,
so that Catalyst plans it: address maps are aggregations, lookups are equi-joins on (archive, address), missing resources
are anti-joins. Every key is (archive_id, address): no group is larger than an archive.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import columns, markup, mime, pages
from foliant.sources import fetching
from foliant.runtime import materialize, release

PART = "ordinal int, depth int, id string, written_id string, content_id string, content_type string, transfer_encoding string, charset string, container boolean, data string"
PARSED = f"archive_id string, error string, headers map<string,string>, index_id string, index_ordinal int, anomalies array<struct<type:string,id:string>>, parts array<struct<{', '.join(x.replace(' ', ':', 1) for x in PART.split(', '))}>>"
PAGE = "archive_id string, error string, html string, title string, favicons array<struct<href:string,original_href:string,media:string,type:string,sizes:string>>, unfound_resources array<string>, anomalies array<struct<type:string,id:string>>"
REFERENCE = "archive_id string, ordinal int, ref_no int, tag string, attribute string, kind string, raw string, resolved string, encoding string"

_S = pa.string()
_ANOMALIES = pa.list_(pa.struct([("type", _S), ("id", _S)]))
_PARTS = pa.list_(pa.struct([("ordinal", pa.int32()), ("depth", pa.int32()), *((n, _S) for n in ("id", "written_id", "content_id", "content_type", "transfer_encoding", "charset")), ("container", pa.bool_()), ("data", _S)]))
_PARSED = pa.schema([("archive_id", _S), ("error", _S), ("headers", pa.map_(_S, _S)), ("index_id", _S), ("index_ordinal", pa.int32()), ("anomalies", _ANOMALIES), ("parts", _PARTS)])
_PAGE = pa.schema([("archive_id", _S), ("error", _S), ("html", _S), ("title", _S), ("favicons", pa.list_(pa.struct([(n, _S) for n in ("href", "original_href", "media", "type", "sizes")]))), ("unfound_resources", pa.list_(_S)), ("anomalies", _ANOMALIES)])
_REFERENCE = pa.schema([("archive_id", _S), ("ordinal", pa.int32()), ("ref_no", pa.int32()), *((n, _S) for n in ("tag", "attribute", "kind", "raw", "resolved", "encoding"))])


def _named(anomalies: list[tuple[str, str | None]]) -> list[dict]:
    return [{"type": t, "id": i} for t, i in anomalies]


def _rows(batches: Iterator[pa.RecordBatch], one, schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    """``one`` applied to (archive_id, content); an archive that fails gives its error, not a failed job."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            piece = batch.slice(start, most)
            out = []
            for archive, content in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                try:
                    row = {"error": "no content"} if content is None else one(content)
                except Exception as e:  # noqa: BLE001 - one bad archive must not end the others
                    row = {"error": f"{type(e).__name__}: {e}"}
                out.append({"archive_id": archive, **row})
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _parsed(content: bytes | str) -> dict:
    a = mime.parse(content)
    parts = [{k: getattr(p, k) for k in ("ordinal", "depth", "id", "written_id", "content_id", "content_type", "transfer_encoding", "charset", "container", "data")} for p in a.parts]
    return {"headers": list(a.headers.items()), "index_id": a.index_id, "index_ordinal": a.index, "anomalies": _named(a.anomalies), "parts": parts}


def parse_archives(archives: DataFrame) -> DataFrame:
    """(archive_id, content) to a row per archive with its headers, parts, index and anomalies."""
    return archives.select("archive_id", "content").mapInArrow(lambda b: _rows(b, _parsed, _PARSED), PARSED)


def archive_parts(parsed: DataFrame) -> DataFrame:
    """A row per part."""
    return parsed.select("archive_id", F.inline("parts"))


def archive_headers(parsed: DataFrame) -> DataFrame:
    """(archive_id, name, value) of the top-level headers."""
    return parsed.select("archive_id", F.explode("headers").alias("name", "value"))


def archive_anomalies(parsed: DataFrame) -> DataFrame:
    """(archive_id, type, id) of what was wrong and recovered from."""
    return parsed.select("archive_id", F.inline("anomalies"))


def addresses(parts: DataFrame) -> DataFrame:
    """(archive_id, kind, key, ordinal): the first part of an address counts, of a frame the last."""
    keys = F.array(F.struct(F.lit("resource").alias("kind"), F.col("id").alias("key")), F.struct(F.lit("resource").alias("kind"), F.col("written_id").alias("key")), F.struct(F.lit("resource").alias("kind"), F.col("content_id").alias("key")), F.struct(F.lit("frame").alias("kind"), F.col("content_id").alias("key")))
    rows = parts.select("archive_id", "ordinal", F.inline(keys)).filter("key IS NOT NULL")
    return rows.groupBy("archive_id", "kind", "key").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last")).select("archive_id", "kind", "key", F.when(F.col("kind") == "frame", F.col("last")).otherwise(F.col("first")).alias("ordinal"))


def index_parts(parts: DataFrame) -> DataFrame:
    """(archive_id, ordinal, id) of each archive's main document: its first part of a document type."""
    return parts.filter(columns.is_document(F.col("content_type"))).groupBy("archive_id").agg(F.min("ordinal").alias("ordinal"), F.min_by("id", "ordinal").alias("id"))


def synthesized_index(parts: DataFrame) -> DataFrame:
    """(archive_id, ordinal, id) of the image or text shown for an archive without a document."""
    without = parts.join(index_parts(parts).select("archive_id"), "archive_id", "left_anti")
    shown = without.filter(columns.is_image(F.col("content_type")) | columns.is_plain_text(F.col("content_type")))
    return shown.groupBy("archive_id").agg(F.min("ordinal").alias("ordinal"), F.min_by("id", "ordinal").alias("id"))


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for archive, ordinal, address, sheet, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if sheet:
                found = pages.sheet_references(text, address)
            else:
                doc = markup.parse(text)
                found = pages.page_references(doc, pages.page_base(doc, address)[0])
            out += [(archive, ordinal, k, r.tag, r.attribute, r.kind, r.raw, r.resolved, "base64" if r.binary else None) for k, r in enumerate(found)]
        cols = list(zip(*out)) if out else [[]] * len(_REFERENCE)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _REFERENCE)], schema=_REFERENCE)


def references(parts: DataFrame) -> DataFrame:
    """A row per reference of the documents and style sheets among the parts."""
    sheet = columns.is_stylesheet(F.col("content_type"))
    read = parts.filter((sheet | columns.is_document(F.col("content_type"))) & F.col("data").isNotNull() & (F.coalesce(F.lower("transfer_encoding"), F.lit("")) != "base64"))
    return read.select("archive_id", "ordinal", "id", sheet.alias("sheet"), "data").mapInArrow(_references, REFERENCE)


def resolve_references(refs: DataFrame, known: DataFrame) -> DataFrame:
    """The references with the part each one finds (null for none), looked up as resolved, as written, by Content-ID."""
    tried = refs.select("*", F.inline(columns.lookup_keys(F.col("resolved"), F.col("raw")))).filter("key IS NOT NULL")
    hits = tried.join(known.filter("kind = 'resource'").select("archive_id", "key", F.col("ordinal").alias("part")), ["archive_id", "key"], "left")
    group = ["archive_id", "ordinal", "ref_no"]
    return hits.groupBy(*group, "tag", "attribute", "kind", "raw", "resolved", "encoding").agg(F.min_by("part", F.when(F.col("part").isNotNull(), F.col("priority"))).alias("part"))


def used_parts(resolved: DataFrame) -> DataFrame:
    """(archive_id, ordinal) of the parts some reference finds."""
    return resolved.filter("part IS NOT NULL").select("archive_id", F.col("part").alias("ordinal")).distinct()


def unused_parts(parts: DataFrame, resolved: DataFrame) -> DataFrame:
    """The parts no reference finds, main documents apart."""
    return parts.join(used_parts(resolved), ["archive_id", "ordinal"], "left_anti").join(index_parts(parts).select("archive_id", "ordinal"), ["archive_id", "ordinal"], "left_anti")


def unfound_references(resolved: DataFrame) -> DataFrame:
    """(archive_id, address) of the references without a part; data addresses need none."""
    return resolved.filter("part IS NULL AND NOT startswith(resolved, 'data:')").select("archive_id", F.col("resolved").alias("address")).distinct()


def missing_resources(resolved: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(archive_id, address, encoding) of what can be fetched: each address once, with the first encoding asked for."""
    wanted = resolved.filter(F.col("part").isNull() & columns.is_fetchable(F.col("resolved")))
    once = wanted.groupBy("archive_id", F.col("resolved").alias("address")).agg(F.min_by(F.struct("encoding"), F.struct("ordinal", "ref_no"))["encoding"].alias("encoding"))
    return once if failed is None else once.join(failed.select("archive_id", "address").distinct(), ["archive_id", "address"], "left_anti")


def fetch(missing: DataFrame, web: DataFrame, max_retries: int = 2) -> DataFrame:
    """The missing resources with the answer of the web table: ok, or failed with the attempts it took.

    ``web`` holds answers (url, status, content_type, body, retry_after, fetched_at), several for an address that was asked
    again. Attempts go through them in order while they are transient and the wait asked for is short enough.
    """
    answers = web.select("url", "status", "content_type", "body", columns.is_transient(F.col("status")).alias("transient"), columns.retry_delay_ms(F.col("retry_after"), F.lit(0), F.col("fetched_at")).alias("delay"), "fetched_at")
    # only the first answers of an address count; the rank limit is applied before the shuffle
    order = Window.partitionBy("url").orderBy(F.col("fetched_at").asc_nulls_last(), "status", "content_type")
    tried = answers.withColumn("attempt", F.row_number().over(order)).filter(F.col("attempt") <= max_retries + 1)
    ends = F.col("status").isNotNull() & (~F.col("transient") | F.col("delay").isNull())
    last = tried.groupBy("url").agg(F.count("*").alias("answers"), F.min_by(F.struct("status", "content_type", "body"), F.when(ends, F.col("attempt"))).alias("last"))
    return (
        missing.withColumn("url", columns.unwrap_urn(F.col("address")))
        .join(last, "url", "left")
        .withColumn("ok", F.coalesce(F.col("last.status").between(200, 299), F.lit(False)))
        .select("archive_id", "address", "encoding", "url", "ok", F.col("last.status").alias("status"), F.coalesce("last.content_type", F.lit("application/octet-stream")).alias("content_type"), F.when(F.col("ok"), F.col("last.body")).alias("body"), F.coalesce("answers", F.lit(0)).alias("answers"))
    )


def fetched_parts(fetched: DataFrame, after: DataFrame) -> DataFrame:
    """The fetched resources as further parts of their archives, numbered behind those of ``after``."""
    last = after.groupBy("archive_id").agg(F.max("ordinal").alias("last"))
    number = F.row_number().over(Window.partitionBy("archive_id").orderBy("address"))
    rows = fetched.filter("ok").join(last, "archive_id")
    return rows.select(
        "archive_id",
        (F.col("last") + number).cast("int").alias("ordinal"),
        F.lit(0).alias("depth"),
        F.col("address").alias("id"),
        F.col("address").alias("written_id"),
        F.lit(None).cast("string").alias("content_id"),
        "content_type",
        F.col("encoding").alias("transfer_encoding"),
        F.lit(None).cast("string").alias("charset"),
        F.lit(False).alias("container"),
        F.when(F.col("encoding") == "base64", columns.encode_base64(F.coalesce("body", F.lit(b"")))).otherwise(F.decode(F.make_valid_utf8(F.coalesce("body", F.lit(b"")).cast("string")).cast("binary"), "utf-8")).alias("data"),
    )


def fetch_with(missing: DataFrame, client: fetching.Fetch, max_retries: int = fetching.MAX_RETRIES, max_parallel: int = fetching.MAX_PARALLEL, partitions: int | None = None) -> DataFrame:
    """The missing resources with the answers of a client, in the form of ``fetch``: each address is asked for once."""
    asked = fetching.fetch_addresses(missing, client, partitions, max_parallel, max_retries)
    joined = missing.join(asked, "address").withColumn("url", columns.unwrap_urn(F.col("address")))
    return joined.select("archive_id", "address", "encoding", "url", "ok", "status", F.coalesce("content_type", F.lit("application/octet-stream")).alias("content_type"), "body", F.col("attempts").alias("answers"))


def fetch_rounds(parts: DataFrame, web: DataFrame | fetching.Fetch, max_rounds: int | None = None, max_retries: int = 2, max_parallel: int = fetching.MAX_PARALLEL, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(parts, failed): parts are added until no reference is missing that hasn't failed.

    ``web`` is a table of answers or a client. Each round reads only the parts the last one added, and looks up only their
    references and those still open; lineage is cut with a table per round in the shared folder. Every address of an archive
    is tried once and each round but the last fetches one at least, so the rounds end of themselves. With ``max_rounds``, an
    error says that addresses are left after so many rounds.
    """
    columns_ = [c.split()[0] for c in PART.split(", ")]
    parts = parts.select("archive_id", *columns_)
    everything = known = fresh = parts
    open_refs = failed = tried = None
    for k in itertools.count():
        resolved = resolve_references(references(fresh), addresses(everything))
        if open_refs is not None:  # the open ones can only be found among the new parts
            resolved = resolved.unionByName(resolve_references(open_refs.drop("part"), addresses(fresh)))
        last, open_refs = open_refs, materialize(resolved.filter("part IS NULL"), f"open{k}")
        if last is not None:
            release(last)
        wanted = missing_resources(open_refs, tried)
        if k == max_rounds and (left := wanted.count()):
            raise RuntimeError(f"{left} resources are still to be fetched after {max_rounds} rounds")
        answers = fetch_with(wanted, web, max_retries, max_parallel, partitions) if callable(web) else fetch(wanted, web, max_retries)
        answers = materialize(answers, f"fetched{k}")
        asked = answers.select("archive_id", "address")
        tried = asked if tried is None else tried.unionByName(asked)
        bad = answers.filter("NOT ok").select("archive_id", "address")
        failed = bad if failed is None else failed.unionByName(bad)
        if not answers.filter("ok").limit(1).count():
            release(open_refs)
            break
        fresh = materialize(fetched_parts(answers, everything), f"parts{k}")
        everything = everything.unionByName(fresh)
    return everything, failed


def import_closure(imports: DataFrame) -> DataFrame:
    """(archive_id, sheet, imported) of all sheets reached from each sheet; cycles end of themselves.

    ``imports`` are direct ones. Pairs at most double their reach in a round, so few rounds do; each is kept as a table.
    """
    reached = materialize(imports.select("archive_id", "sheet", "imported").distinct(), "imports")
    size = reached.count()
    for k in itertools.count():
        step = reached.alias("a").join(reached.alias("b"), (F.col("a.archive_id") == F.col("b.archive_id")) & (F.col("a.imported") == F.col("b.sheet"))).select("a.archive_id", "a.sheet", "b.imported")
        last, reached = reached, materialize(reached.unionByName(step).distinct(), f"closure{k}")
        release(last)
        now = reached.count()
        if now == size:
            return reached
        size = now


def _page(page: pages.Page) -> dict:
    return {"error": page.error, "html": page.data, "title": page.title, "favicons": page.favicons, "unfound_resources": page.unfound, "anomalies": _named(page.anomalies)}


def convert_archives(archives: DataFrame, scripts: bool = False, web: DataFrame | fetching.Fetch | None = None, max_retries: int = fetching.MAX_RETRIES, max_parallel: int = fetching.MAX_PARALLEL, partitions: int | None = None) -> DataFrame:
    """(archive_id, content) to one self-contained page each. No shuffle: an archive is converted where it is read.

    With ``web``, a table of answers or a client, missing resources are fetched first, round by round; that needs a shuffle
    by archive.
    """
    if web is None:
        return archives.select("archive_id", "content").mapInArrow(lambda b: _rows(b, lambda c: _page(pages.convert(mime.parse(c), scripts)), _PAGE, 16), PAGE)
    parsed = materialize(parse_archives(archives), "parsed")
    parts, _ = fetch_rounds(archive_parts(parsed), web, None, max_retries, max_parallel, partitions)
    found = convert_parts(parts, parsed, scripts)
    own = parsed.select("archive_id", F.col("error").alias("parse_error"), F.col("anomalies").alias("parse_anomalies"))
    joined = own.join(found, "archive_id", "left").withColumn("error", F.coalesce("parse_error", "error", F.when(F.col("html").isNull(), F.lit("Index page not found"))))
    more = F.coalesce("anomalies", F.array().cast(found.schema["anomalies"].dataType))
    return joined.withColumn("anomalies", F.concat(F.coalesce("parse_anomalies", F.array().cast(found.schema["anomalies"].dataType)), more)).select(*found.columns)


def convert_parts(parts: DataFrame, headers: DataFrame | None = None, scripts: bool = False) -> DataFrame:
    """Pages from part rows (after fetching, say). The parts of an archive come together in one row: one shuffle by archive."""
    fields = [c.split()[0] for c in PART.split(", ")]
    rows = parts.groupBy("archive_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))
    rows = rows.join(headers.select("archive_id", "headers"), "archive_id", "left") if headers is not None else rows.withColumn("headers", F.lit(None).cast("map<string,string>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for archive, found, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    number = {p["ordinal"]: i for i, p in enumerate(found)}
                    listed = [mime.Part(number[p["ordinal"]], p["id"], p["written_id"] or p["id"], p["content_id"], p["content_type"], (p["transfer_encoding"] or "").strip().lower() or None, p["data"] or "", p["depth"] or 0, bool(p["container"])) for p in found]
                    index = next((p.ordinal for p in listed if pages.contenttype.is_document(p.content_type)), None)
                    row = _page(pages.convert(mime.Archive(dict(own or ()), listed, index), scripts))
                except Exception as e:  # noqa: BLE001
                    row = {"error": f"{type(e).__name__}: {e}"}
                out.append({"archive_id": archive, **row})
            yield pa.RecordBatch.from_pylist(out, schema=_PAGE)

    return rows.select("archive_id", "parts", "headers").mapInArrow(run, PAGE)


def page_favicons(converted: DataFrame) -> DataFrame:
    return converted.select("archive_id", F.posexplode("favicons").alias("icon_no", "icon")).select("archive_id", "icon_no", "icon.*")


def page_unfound(converted: DataFrame) -> DataFrame:
    return converted.select("archive_id", F.explode("unfound_resources").alias("address"))
