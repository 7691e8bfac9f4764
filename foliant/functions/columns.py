"""The engine's scalar operators as Catalyst expressions: nothing here needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _starts(content_type: Column, *beginnings: str) -> Column:
    low = F.lower(content_type)
    test = F.lit(False)
    for b in beginnings:
        test = test | low.startswith(b)
    return F.coalesce(test, F.lit(False))


def is_document(t: Column) -> Column:
    return _starts(t, "text/html", "application/xhtml+xml")


def is_stylesheet(t: Column) -> Column:
    return _starts(t, "text/css")


def is_text(t: Column) -> Column:
    return _starts(t, "text/")


def is_image(t: Column) -> Column:
    return _starts(t, "image/")


def is_plain_text(t: Column) -> Column:
    return _starts(t, "text/plain")


def is_media(t: Column) -> Column:
    return _starts(t, "image/", "audio/", "video/", "font/")


def is_multipart(t: Column) -> Column:
    return _starts(t, "multipart/")


def is_alternative(t: Column) -> Column:
    return _starts(t, "multipart/alternative")


def is_fetchable(address: Column) -> Column:
    """Addresses that can be fetched: http, https and urn."""
    return F.coalesce(address.rlike(r"^(https?:|urn:)"), F.lit(False))


def is_transient(status: Column) -> Column:
    """Answers after which another attempt makes sense."""
    return F.coalesce((status == 429) | status.between(500, 599), F.lit(False))


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(500.0) * F.pow(F.lit(2.0), attempt), F.lit(5000.0)).cast("bigint")


def retry_delay_ms(retry_after: Column, attempt: Column, now: Column | None = None) -> Column:
    """The wait before the next attempt; null where there shall be none (a longer wait than 5 s, or one that can't be read)."""
    seconds = F.when(F.trim(retry_after).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.trim(retry_after).cast("double"))
    moment = F.try_to_timestamp(F.regexp_replace(F.trim(retry_after), r"^\w+,\s*", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    date = (F.unix_millis(moment) - F.unix_millis(now if now is not None else F.current_timestamp())).cast("double")
    told = F.coalesce(seconds * 1000, date)
    asked = F.when(told.isNotNull(), F.greatest(F.lit(0.0), told))  # greatest alone would make null 0
    return F.when(F.coalesce(F.trim(retry_after), F.lit("")) == "", backoff_ms(attempt)).when(asked <= 5000, asked.cast("bigint"))


def charset_parameter(content_type: Column) -> Column:
    """The charset a content type names, unquoted and in lower case; null for none."""
    found = F.lower(F.trim(F.regexp_replace(F.regexp_extract(content_type, r"(?i)charset\s*=\s*(\"[^\"]*\"|'[^']*'|[^;]+)", 1), "[\"']", "")))
    return F.when(found != "", found)


def boundary_parameter(content_type: Column) -> Column:
    """The boundary a multipart type names; null for none."""
    found = F.trim(F.regexp_replace(F.regexp_extract(F.concat(F.lit(";"), content_type), r";\s*boundary=(\"[^\"]*\"|'[^']*'|[^;]*)", 1), r"^[\"']|[\"']$", ""))
    return F.when(found != "", found)


def mark_charset(data: Column) -> Column:
    """The charset told by a byte order mark of binary data."""
    return F.when(F.substring(data, 1, 3) == F.lit(b"\xef\xbb\xbf"), "utf-8").when(F.substring(data, 1, 2) == F.lit(b"\xff\xfe"), "utf-16le").when(F.substring(data, 1, 2) == F.lit(b"\xfe\xff"), "utf-16be")


def with_charset(content_type: Column, charset: str) -> Column:
    return F.regexp_replace(content_type, r"(?i)charset\s*=\s*(\"[^\"]*\"|'[^']*'|[^;]+)", f"charset={charset}")


def decode_base64(text: Column) -> Column:
    """Bytes of base64 text, blanks ignored; null for anything else."""
    return F.try_to_binary(F.regexp_replace(text, "[\\t\\n\\f\\r ]", ""), F.lit("base64"))


def encode_base64(data: Column) -> Column:
    """Base64 on one line."""
    return F.translate(F.base64(data), "\r\n", "")


def media_type(content_type: Column) -> Column:
    pieces = F.filter(F.transform(F.split(F.coalesce(content_type, F.lit("application/octet-stream")), ";"), lambda p: F.trim(F.regexp_replace(p, "[\"']", ""))), lambda p: p != "")
    return F.array_join(pieces, ";")


def data_address(content_type: Column, transfer_encoding: Column, data: Column) -> Column:
    """A part as a data: address."""
    payload = F.when(F.lower(F.trim(transfer_encoding)) == "base64", data).otherwise(encode_base64(F.encode(data, "utf-8")))
    return F.concat(F.lit("data:"), media_type(content_type), F.lit(";base64,"), payload)


def unwrap_urn(address: Column) -> Column:
    return F.regexp_replace(address, r"(?s)^urn:[^:]+:(.+)$", "$1")


def cid_key(address: Column) -> Column:
    """The address of the part a cid: reference means; null for other references."""
    return F.when(address.startswith("cid:"), F.concat(F.lit("<"), F.substring(address, 5, 1 << 30), F.lit(">")))


def same_page_link(resolved: Column, base: Column) -> Column:
    """Only the fragment of a resolved link that stays on the page."""
    return F.when((F.substring_index(resolved, "#", 1) == F.substring_index(base, "#", 1)) & F.contains(resolved, F.lit("#")) & (F.substring_index(resolved, "#", -1) != ""), F.concat(F.lit("#"), F.regexp_extract(resolved, "#(.*)$", 1))).otherwise(resolved)


def escape_text(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("\xa0"), F.lit("&nbsp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("\xa0"), F.lit("&nbsp;")), F.lit('"'), F.lit("&quot;"))


def escape_plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def escape_script(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?<!\\)</", r"<\\/"), r"(?<!\\)/>", r"\\/>")


def output_name(path: Column) -> Column:
    """The page's file name for an archive's."""
    return F.regexp_replace(path, r"\.[^.]+$", ".html")


def lookup_keys(resolved: Column, raw: Column) -> Column:
    """(priority, key) pairs of the addresses a part may have for a reference."""
    return F.array(F.struct(F.lit(0).alias("priority"), resolved.alias("key")), F.struct(F.lit(1).alias("priority"), raw.alias("key")), F.struct(F.lit(2).alias("priority"), cid_key(resolved).alias("key")))
