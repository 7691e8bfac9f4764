"""The registered queries of the operators for training text."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm import langid, maincontent, mixing, mojibake, packing, residue, truncation
from foliant.plans.queries import Query
from foliant.plans.queries import query as _query
from foliant.runtime import read_table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
query = partial(_query, into=QUERIES, sql_into=SQL)


@query("p1_found")
def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return truncation.truncated_records(read_table(spark, base, "parts"), read_table(spark, base, "archives"))


@query("p1_report")
def p1_report(spark: SparkSession, base: str) -> DataFrame:
    return truncation.truncation_report(read_table(spark, base, "parts"))


_VALUES = "SELECT archive_id, part_no, any_value(source) AS source, length(any_value(data)) AS chars, strlen(any_value(data)) AS bytes FROM parts WHERE data IS NOT NULL GROUP BY archive_id, part_no"


@query("p1_lengths", f"SELECT source, unit, len, count(*) AS n FROM (SELECT source, 'chars' AS unit, chars AS len FROM ({_VALUES}) UNION ALL SELECT source, 'bytes', bytes FROM ({_VALUES})) GROUP BY ALL")
def p1_lengths(spark: SparkSession, base: str) -> DataFrame:
    return truncation.length_histogram(truncation.value_lengths(read_table(spark, base, "parts"))).select("source", "unit", F.col("len").cast("bigint").alias("len"), "n")


@query(
    "p1_anomalies",
    """WITH a AS (SELECT DISTINCT archive_id, x.type AS type, x.id AS id FROM (SELECT archive_id, unnest(anomalies) AS x FROM archives)), t AS (SELECT unnest(['document-mislabeled-as-archive', 'declared-boundary-unused', 'multipart-without-delimiters', 'index-synthesized', 'base64-left-encoded']) AS name)
       SELECT archive_id FROM a JOIN t ON starts_with(t.name, a.type) AND t.name <> a.type UNION SELECT a.archive_id FROM a WHERE a.id IS NOT NULL AND EXISTS (SELECT 1 FROM parts p WHERE p.archive_id = a.archive_id AND starts_with(p.id, a.id))
       AND NOT EXISTS (SELECT 1 FROM parts p WHERE p.archive_id = a.archive_id AND p.id = a.id)""",
)
def p1_anomalies(spark: SparkSession, base: str) -> DataFrame:
    return truncation.cut_anomalies(read_table(spark, base, "archives"), read_table(spark, base, "parts"))


@query("p1_sources", f"SELECT source, count(*) AS n_parts, true AS told_once FROM ({_VALUES}) GROUP BY source")
def p1_sources(spark: SparkSession, base: str) -> DataFrame:
    report = truncation.truncation_report(read_table(spark, base, "parts"))
    return report.select("source", "n_parts", (F.col("n_cut") == F.col("n_by_limit") + F.col("n_broken")).alias("told_once"))


@query("p3_found")
def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return residue.residue_records(read_table(spark, base, "parts"), read_table(spark, base, "page_data"))


@query("p4_found")
def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return mojibake.garbled_records(read_table(spark, base, "parts"), read_table(spark, base, "archives"))


@query("p4_restored")
def p4_restored(spark: SparkSession, base: str) -> DataFrame:
    return mojibake.restored_records(read_table(spark, base, "parts"), read_table(spark, base, "archives"))


@query("p5_found")
def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return maincontent.article_blocks(read_table(spark, base, "page_data"), read_table(spark, base, "parts"))


@query(
    "p5_blocks",
    """SELECT archive_id, CAST(len(regexp_extract_all(regexp_replace(data, '(?is)<(script|style|template|textarea)\\b[^>]*>.*?</(script|style|template|textarea)\\s*>|<!--.*?-->', '', 'g'), '<(h1|h2|h3|p|li|blockquote|pre|figcaption)>')) AS INT) AS n_blocks
       FROM (SELECT archive_id, any_value(data) AS data FROM page_data WHERE data IS NOT NULL GROUP BY archive_id)""",
)
def p5_blocks(spark: SparkSession, base: str) -> DataFrame:
    features = maincontent.read_pages(read_table(spark, base, "page_data")).filter("leaf IS NULL")
    return features.groupBy("archive_id").agg(F.max(F.size("tag")).alias("n_blocks"))


@query("p6_placement")
def p6_placement(spark: SparkSession, base: str) -> DataFrame:
    return packing.container_placement(read_table(spark, base, "documents"), read_table(spark, base, "containers"))


@query("p6_documents", "SELECT DISTINCT container_kind, capacity_tokens, doc_id, 1::BIGINT AS n, true AS whole FROM containers, documents WHERE text <> ''")
def p6_documents(spark: SparkSession, base: str) -> DataFrame:
    # every text is placed once in each kind, and split only if it is larger than a container
    placed = packing.container_placement(read_table(spark, base, "documents"), read_table(spark, base, "containers"))
    pieces = placed.groupBy(*packing.KIND, "doc_id").agg(F.count_distinct("piece").alias("pieces"), F.count("*").alias("rows"), F.sum("tokens").alias("tokens"))
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return pieces.select(*packing.KIND, "doc_id", (F.col("rows") - F.col("pieces") + 1).alias("n"), (F.col("pieces") == least).alias("whole"))


@query("p6_containers", "SELECT DISTINCT container_kind, capacity_tokens, 0::BIGINT AS n_overfull, true AS nearly_full FROM containers")
def p6_containers(spark: SparkSession, base: str) -> DataFrame:
    placed = packing.container_placement(read_table(spark, base, "documents"), read_table(spark, base, "containers"))
    used = placed.groupBy(*packing.KIND, "container_no").agg(F.sum("tokens").alias("tokens"))
    over = F.sum((F.col("tokens") > F.col("capacity_tokens")).cast("bigint"))
    return used.groupBy(*packing.KIND).agg(over.alias("n_overfull"), (F.sum("tokens") / F.sum("capacity_tokens") > 0.99).alias("nearly_full"))


@query("p6_fill")
def p6_fill(spark: SparkSession, base: str) -> DataFrame:
    containers = read_table(spark, base, "containers")
    return packing.container_fill(packing.container_placement(read_table(spark, base, "documents"), containers), containers)


@query("p7_mixture")
def p7_mixture(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mixture(read_table(spark, base, "documents"), read_table(spark, base, "mix_targets"))


@query("p7_sources", "SELECT source, target_share, max_repeats, true AS near, true AS within_repeats FROM mix_targets")
def p7_sources(spark: SparkSession, base: str) -> DataFrame:
    # the shares reached are within 2 % of the targets, as far as the sources have texts
    targets, documents = read_table(spark, base, "mix_targets"), read_table(spark, base, "documents")
    shares = mixing.mixture_shares(mixing.mixture(documents, targets), targets)
    total = F.sum(F.when(F.col("n_docs") > 0, F.col("target_share"))).over(Window.partitionBy(F.lit(0)))  # a row per source by now
    wanted = F.col("target_share") / total
    return shares.select("source", "target_share", "max_repeats", ((F.col("n_docs") == 0) | (F.abs(F.col("share") - wanted) <= 0.02 * wanted)).alias("near"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"))


@query("p7_shares")
def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    targets = read_table(spark, base, "mix_targets")
    return mixing.mixture_shares(mixing.mixture(read_table(spark, base, "documents"), targets), targets)


@query("p8_found")
def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return langid.mislabelled_documents(read_table(spark, base, "documents"))


_NAMES = ", ".join(f"('{code}', '{name}')" for code, (_, names) in langid.LANGUAGES.items() for name in (code, *names.split()))
_LABEL = "lower(trim(lang))"


@query("p8_labels", f"WITH n(code, name) AS (VALUES {_NAMES}) SELECT d.doc_id, coalesce(a.code, b.code) AS label FROM (SELECT DISTINCT doc_id, lang FROM documents) d LEFT JOIN n a ON a.name = {_LABEL} LEFT JOIN n b ON b.name = regexp_extract({_LABEL}, '^[^-_ (,;]*')")
def p8_labels(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "documents").select("doc_id", "lang").distinct().select("doc_id", langid.normal_label_column(F.col("lang")).alias("label"))


@query("p8_segments")
def p8_segments(spark: SparkSession, base: str) -> DataFrame:
    return langid.language_segments(read_table(spark, base, "documents"))
