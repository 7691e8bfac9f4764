"""Problem 1: text cut off by field limits or by a broken transfer.

Method: per source the lengths in characters and in bytes are counted. A length that stands far above its neighbourhood, and
whose values mostly fail the end test of their kind, is a field limit; a value of a limit's length that fails the test is cut
(``by_limit``). The end tests are terminal punctuation for prose, elements, brackets and comments that are all closed for
markup, styles and scripts, the end of the file for images. A transfer breaks at any length, so beside the limits a value
whose own syntax is left open (tag, SVG root, JSON, rule, statement, PNG, sentence) is cut as well (``broken``).

Everything is a Catalyst expression: no Python worker sees a row.

Defined results: null data is never cut; an empty value is complete; repeated rows count once; ties have no effect;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.runtime import materialize

#: Lengths this near to a limit belong to it: a cut inside a multi-byte character loses or adds a few bytes.
BYTE_SLACK = 3
#: A limit holds this many times the mean count of the lengths around it (taken as LEAST_MEAN where they are empty).
SPIKE_RATIO, NEIGHBOURS, LEAST_MEAN = 12.0, 48, 0.4
#: ... and this share of its values fails the end test; at lengths that are frequent by nature most values are whole.
FAILING_SHARE = 0.5

#: The last base64 characters of a complete PNG, for each alignment of its final IEND chunk.
PNG_ENDS = ("AElFTkSuQmCC", "JRU5ErkJggg", "SUVORK5CYII")
#: The anomaly types an archive can have.
ANOMALY_TYPES = (
    "document-mislabeled-as-archive",
    "declared-boundary-unused",
    "multipart-without-delimiters",
    "index-synthesized",
    "base64-left-encoded",
)

_TAG_START = r"^(?i)<(!doctype|!--|\?xml|/?(html|head|body|title|meta|p|div|h[1-6]|ul|ol|li|table|center|main|article|section|span|a|b|pre|blockquote|header|footer|nav|aside|noscript|br|img|style|script|svg|figure|form)\b)"
_STOPS, _CLOSERS = ".!?…。！？", "\"”»’')]"
#: Elements that need an end tag; their start tags, if not closed in themselves, and their end tags.
_PAIRED = r"(a|abbr|article|aside|b|blockquote|button|center|code|div|dl|em|fieldset|figcaption|figure|footer|form|h[1-6]|header|i|iframe|label|main|nav|noscript|ol|pre|script|section|select|span|strong|style|sub|sup|svg|table|textarea|title|u|ul|video)"
_PAIR_START, _PAIR_END = rf"(?i)<{_PAIRED}(\s[^<>]*)?(?<!/)>", rf"(?i)</{_PAIRED}\s*>"
_SVG_START, _SVG_END = r"(?i)<svg(\s[^<]*)?(?<!/)>", r"(?i)</svg\s*>"
_MARKUP_COMMENT = r"(?s)<!--.*?-->"
_BLANKS = " \t\r\n\f"


def _end(data: Column) -> Column:
    """The value without blanks behind it."""
    return F.rtrim(data, F.lit(_BLANKS))


def _terminal(data: Column) -> Column:
    """True where the value ends with terminal punctuation, closing quotes and brackets aside."""
    last = F.substring(F.rtrim(_end(data), F.lit(_CLOSERS)), -1, 1)
    return F.lit(_STOPS).contains(last) & (last != "")


def _ends_with_tag(data: Column, pattern: str) -> Column:
    """True where the value ends with a tag and the tag without its ``<`` fits the pattern."""
    end = _end(data)
    return end.endswith(">") & end.contains("<") & F.substring_index(end, "<", -1).rlike(pattern)


def value_kind(data: Column, content_type: Column) -> Column:
    """What a value is by its own first characters: png, svg, markup, json, style, script or text."""
    # the patterns look at the beginning only, behind any number of blanks
    head = F.ltrim(data, F.lit(" \t\r\n"))
    declared = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(data.rlike(r"^( {4}|\t)"), "text")
        .when(head.startswith("iVBORw0KG"), "png")
        .when(head.startswith("<svg") | (head.startswith("<?xml") & head.contains("<svg")), "svg")
        .when(head.rlike(_TAG_START), "markup")
        .when(head.rlike(r'^(\{\s*"|\{\s*\}|\[\s*(\[\s*)*[{"\d\]])'), "json")
        .when(head.rlike(r"^([.#@*]?[A-Za-z][\w.:#>\[\]=\"' ,()-]{0,200}\{|/\*)") & ~declared.contains("javascript") & ~declared.startswith("text/plain"), "style")
        .when(declared.contains("javascript") & head.rlike(r"^(function|let|const|var|window|if|for|while|import|export|class|return|\(|//|/\*|[\w.$]+\s*[=(.])"), "script")
        .when(head.rlike(r"^((let|const|var)\s+[\w$]+\s*=|function\s*[\w$]*\s*\(|window\.[\w$]+\s*=)") & ~declared.startswith("text/plain"), "script")
        .otherwise("text")
    )


def _more(data: Column, start: str, end: str) -> Column:
    """True where the pattern ``start`` is found more often than ``end``."""
    return F.regexp_count(data, F.lit(start)) > F.regexp_count(data, F.lit(end))


def _open_at_limit(data: Column, kind: Column) -> Column:
    """True where a value of a limit's length isn't whole, though its syntax may not show that at any other length.

    JSON, SVG and PNG need no such test: no beginning of theirs passes the test of their syntax.
    """
    bare = F.regexp_replace(data, _MARKUP_COMMENT, "")
    last = F.substring_index(_end(data), "\n", -1)
    comment = _more(data, r"(^|[\s;{}(),])/\*", r"\*/")
    brackets = _more(data, r"\(", r"\)") | _more(data, r"\[", r"\]")
    return (
        F.when(kind == "markup", (F.lower(F.substring(_end(data), -7, 7)) != "</html>") & (bare.contains("<!--") | _more(bare, _PAIR_START, _PAIR_END)))
        .when(kind == "style", comment | brackets)
        .when(kind == "script", comment | brackets | (last.rlike(r"^\s*//[^#@]") & ~_terminal(data)))
        .when(kind == "text", ~_terminal(data))
        .otherwise(F.lit(False))
    )


def _open_syntax(data: Column, kind: Column) -> Column:
    """True where the value's own syntax is left open."""
    end = _end(data)
    braces = F.length(F.replace(data, F.lit("{"), F.lit(""))) != F.length(F.replace(data, F.lit("}"), F.lit("")))
    bare = F.rtrim(end, F.lit("="))
    png = F.lit(True)
    for tail in PNG_ENDS:
        png = png & ~bare.endswith(tail)
    last = F.substring_index(end, "\n", -1)
    # the last line of prose: a list item, a signature, an address or code needs no full stop
    whole_line = (
        last.rlike(r"^\s*([-*•]|\d+[.)])\s")
        | last.rlike(r"^\s*(https?|ftp)://\S+$")
        | last.rlike(r"^(    |\t|```|~~~)")
        | F.substring_index(end, "\n", -2).rlike(r"^-- ?\n")
        | ~end.contains("\n") & (F.length(data) < 40)
    )
    text = ~_terminal(data) & ~whole_line & ~_ends_with_tag(data, r"^/?\w+[^<>]*>$")

    def times(piece: str) -> Column:
        return (F.length(data) - F.length(F.replace(data, F.lit(piece), F.lit("")))) / len(piece)

    def ends_with(*pieces: str) -> Column:
        out = F.lit(False)
        for piece in pieces:
            out = out | end.endswith(piece)
        return out

    # html and body may be left open, containers that need an end tag may not
    boxes = F.lit(False)
    for tag in ("div", "ul", "ol", "table", "center", "main", "article", "section", "blockquote"):
        boxes = boxes | (times(f"<{tag}>") + times(f"<{tag} ") > times(f"</{tag}>"))
    inside = _ends_with_tag(data, r"(?i)^(?!/|!|\?|br|hr|img|meta|link|input|html|body|head)[^<>]*[^<>/]>$|^/(a|b|i|em|strong|span|code|li|td|tr)>$")
    markup = ~end.endswith(">") | ((F.lower(F.substring(end, -7, 7)) != "</html>") & (inside | boxes))
    opened = (
        F.when(kind == "png", png)
        .when(kind == "svg", ~end.endswith(">") | _more(F.regexp_replace(data, _MARKUP_COMMENT, ""), _SVG_START, _SVG_END))
        .when(kind == "markup", markup)
        .when(kind == "json", F.expr("try_parse_json(data) IS NULL"))
        .when(kind == "style", braces | ~ends_with("}", "*/", ";"))
        .when(kind == "script", braces | ~ends_with("}", ";", "*/") & ~last.startswith("//"))
        .otherwise(text)
    )
    return F.when(end == "", F.lit(False)).otherwise(opened)


def length_histogram(values: DataFrame) -> DataFrame:
    """(source, unit, len, n, failing, n_ellipsis): how many values of each source have each length in characters and bytes."""
    units = F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("len")) for u in ("chars", "bytes")))
    return (
        values.select("source", "failing", "ellipsis", F.inline(units))
        .groupBy("source", "unit", "len")
        .agg(F.count("*").alias("n"), F.sum(F.col("failing").cast("long")).alias("failing"), F.sum(F.col("ellipsis").cast("long")).alias("n_ellipsis"))
    )


def length_limits(values: DataFrame) -> DataFrame:
    """(source, unit, limit, n, failing, ellipsis_share) of the lengths that stand out and at which values end too early.

    ``values`` has source, chars, bytes, failing and ellipsis. The histogram has at most one row per source and length; the
    limits are far fewer, as each holds ``SPIKE_RATIO`` times its surroundings.
    """
    lengths = length_histogram(values)
    around = Window.partitionBy("source", "unit").orderBy("len")
    below = F.coalesce(F.sum("n").over(around.rangeBetween(-NEIGHBOURS, -BYTE_SLACK - 1)), F.lit(0))
    above = F.coalesce(F.sum("n").over(around.rangeBetween(BYTE_SLACK + 1, NEIGHBOURS)), F.lit(0))
    mean = (below + above) / F.lit(2.0 * (NEIGHBOURS - BYTE_SLACK))
    return (
        lengths.withColumn("mean", mean)
        .filter((F.col("n") >= SPIKE_RATIO * F.greatest(F.col("mean"), F.lit(LEAST_MEAN))) & (F.col("failing") >= FAILING_SHARE * F.col("n")))
        .select("source", "unit", F.col("len").alias("limit"), "n", "failing", (F.col("n_ellipsis") / F.col("n")).alias("ellipsis_share"))
    )


def value_lengths(parts: DataFrame) -> DataFrame:
    """(archive_id, part_no, source, kind, chars, bytes, open_end, ellipsis, unended, failing) of each value, repeated rows once."""
    rows = (
        parts.filter(F.col("data").isNotNull())
        .select("archive_id", "part_no", "source", value_kind(F.col("data"), F.col("content_type")).alias("kind"), "data")
        .select(
            "archive_id",
            "part_no",
            "source",
            "kind",
            F.length("data").alias("chars"),
            F.octet_length("data").alias("bytes"),
            _open_syntax(F.col("data"), F.col("kind")).alias("open_end"),
            (F.col("data").endswith("...") | F.col("data").endswith("…")).alias("ellipsis"),
            _open_at_limit(F.col("data"), F.col("kind")).alias("unended"),
        )
        .groupBy("archive_id", "part_no")
        .agg(*(F.first(c).alias(c) for c in ("source", "kind", "chars", "bytes", "open_end", "ellipsis", "unended")))
    )
    return rows.withColumn("failing", F.col("open_end") | F.col("unended") | F.col("ellipsis"))


def cut_values(parts: DataFrame) -> DataFrame:
    """(archive_id, part_no, source, kind, cut, at_limit, by_limit, broken) for each part that has data, repeated rows once.

    A value is cut ``by_limit`` if it has a limit's length and fails its end test, and ``broken`` if it has another length and
    its own end tells so.
    """
    # read by the histogram and by the decision: kept once, without the values
    rows = materialize(value_lengths(parts), "lengths")
    by_source = (
        length_limits(rows)
        .groupBy(F.col("source").alias("limit_source"))
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("unit") == "chars", F.col("limit")))).alias("char_limits"),
            F.array_sort(F.collect_set(F.when(F.col("unit") == "bytes", F.col("limit")))).alias("byte_limits"),
            F.array_sort(F.collect_set(F.when((F.col("unit") == "chars") & (F.col("ellipsis_share") > 0.5), F.col("limit")))).alias("marked_limits"),
        )
    )
    # a row per source that has limits: broadcast if its size, known by then, allows it
    joined = rows.join(by_source, F.col("source").eqNullSafe(F.col("limit_source")), "left")
    near = F.coalesce(F.exists("byte_limits", lambda x: F.abs(F.col("bytes") - x) <= BYTE_SLACK), F.lit(False))
    exact = F.coalesce(F.array_contains("char_limits", F.col("chars")), F.lit(False)) | F.coalesce(F.array_contains("byte_limits", F.col("bytes")), F.lit(False))
    marked = F.coalesce(F.array_contains("marked_limits", F.col("chars")), F.lit(False)) & F.col("ellipsis")
    told = joined.withColumn("at_limit", exact | near)
    told = told.withColumn("by_limit", F.col("at_limit") & F.col("open_end") | exact & F.col("unended") | marked).withColumn("broken", F.col("open_end") & ~F.col("at_limit"))
    return told.select("archive_id", "part_no", "source", "kind", (F.col("by_limit") | F.col("broken")).alias("cut"), "at_limit", "by_limit", "broken")


def cut_anomalies(archives: DataFrame, parts: DataFrame) -> DataFrame:
    """archive_id of the archives with an anomaly whose type or id was cut.

    A type is cut if it is a proper beginning of a known one; an id, if no part of the archive has it and one begins so.
    """
    entries = archives.select("archive_id", F.explode("anomalies").alias("a")).select("archive_id", F.col("a.type").alias("type"), F.col("a.id").alias("anomaly_id")).distinct()
    beginning = F.lit(False)
    for name in ANOMALY_TYPES:
        beginning = beginning | (F.lit(name).startswith(F.col("type")) & (F.col("type") != name))
    by_type = entries.filter(beginning).select("archive_id")
    ids = entries.filter(F.col("anomaly_id").isNotNull()).select("archive_id", "anomaly_id").distinct()
    known = parts.filter(F.col("id").isNotNull()).select("archive_id", "id")
    by_id = (
        ids.join(known, "archive_id")
        .groupBy("archive_id", "anomaly_id")
        .agg(F.bool_or(F.col("id") == F.col("anomaly_id")).alias("whole"), F.bool_or(F.col("id").startswith(F.col("anomaly_id"))).alias("begins"))
        .filter(F.col("begins") & ~F.col("whole"))
        .select("archive_id")
    )
    return by_type.unionByName(by_id).distinct()


def truncation_report(parts: DataFrame) -> DataFrame:
    """(source, n_parts, n_cut, n_at_limit, n_by_limit, n_broken, cut_share): how often each source truncates, and what tells so."""

    def number(which: str) -> Column:
        return F.sum(F.col(which).cast("long"))

    counts = cut_values(parts).groupBy("source").agg(F.count("*").alias("n_parts"), *(number(c).alias(f"n_{c}") for c in ("cut", "at_limit", "by_limit", "broken")))
    return counts.withColumn("cut_share", F.col("n_cut") / F.col("n_parts"))


def truncated_records(parts: DataFrame, archives: DataFrame) -> DataFrame:
    """(archive_id, part_no) of the cut parts; part_no -1 for archives with a cut anomaly."""
    found = cut_values(parts).filter("cut").select("archive_id", F.col("part_no").cast("int").alias("part_no"))
    return found.unionByName(cut_anomalies(archives, parts).select("archive_id", F.lit(-1).cast("int").alias("part_no")))
