"""Command line: ``python -m foliant.cli [--output FILE] [--enable-scripts] [--fetch-missing-resources [--web TABLE]] ARCHIVE...``"""

from __future__ import annotations

import argparse
import glob
import sys

from foliant import __version__


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliant", description="Converts MHTML archives to self-contained HTML pages.")
    p.add_argument("archives", nargs="*", help="archive files or globs")
    p.add_argument("--output", help="the page's file, for exactly one archive that is no glob")
    p.add_argument("--enable-scripts", action="store_true")
    p.add_argument("--fetch-missing-resources", action="store_true")
    p.add_argument("--web", help="Parquet table of answers (url, status, content_type, body, retry_after, fetched_at) to fetch from, instead of the network")
    p.add_argument("--max-retries", type=int, default=2)
    p.add_argument("--max-parallel-requests", type=int, default=16)
    p.add_argument("--version", action="version", version=__version__)
    return p


def main(args: list[str] | None = None) -> int:
    options = parser().parse_args(args)
    if not options.archives:
        parser().print_usage(sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from foliant.operators import archives as ops
    from foliant.runtime import materialize, ship
    from foliant.sources import fetching
    from foliant.sources.archivefiles import expand, put_file, read_archives, write_pages

    spark = SparkSession.builder.appName("foliant").getOrCreate()
    ship(spark)
    paths, missing = expand(spark, options.archives)
    for p in missing:
        print(f"Error processing {p}: no such file", file=sys.stderr)
    if not paths:
        return 1
    read = read_archives(spark, paths, pattern=None)
    web = None
    if options.fetch_missing_resources:
        web = spark.read.parquet(options.web) if options.web else fetching.http()
    pages = ops.convert_archives(read, options.enable_scripts, web, options.max_retries, options.max_parallel_requests)
    pages = materialize(pages, "pages")
    for row in pages.filter("error IS NOT NULL").select("archive_id", "error").toLocalIterator():
        print(f"Error processing {row['archive_id']}: {row['error']}", file=sys.stderr)
    if options.output and len(options.archives) == 1 and not glob.has_magic(options.archives[0]):
        target = options.output if options.output.lower().endswith(".html") else options.output + ".html"
        page = pages.filter("error IS NULL").select("html").first()
        if page is not None:
            put_file(target, page["html"].encode("utf-8", "replace"))
    else:
        write_pages(pages)
    return 0


if __name__ == "__main__":
    sys.exit(main())
