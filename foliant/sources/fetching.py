"""Fetching missing resources through a function given by the caller (an HTTP client, a cache, a stub).

Within a partition at most ``max_parallel`` requests are under way; ``partitions`` bounds them over the cluster. Transient
answers and exceptions are tried again after the wait the answer asks for, or after one that doubles.
"""

from __future__ import annotations

import base64
import email.utils
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.functions import urls

#: The requests of one pool, the further attempts, the first wait and the longest one in seconds.
MAX_PARALLEL, MAX_RETRIES, FIRST_WAIT, LONGEST_WAIT = 16, 2, 0.5, 5.0


class Answer(NamedTuple):
    status: int
    content_type: str | None = None
    body: bytes = b""
    retry_after: str | None = None


Fetch = Callable[[str], Answer]


def wait_before(attempt: int, retry_after: str | None = None, now: float | None = None) -> float | None:
    """Seconds to wait before the next attempt; None where there shall be none."""
    if not retry_after or not retry_after.strip():
        return min(FIRST_WAIT * 2**attempt, LONGEST_WAIT)
    try:
        asked = float(retry_after)
        if asked != asked or asked in (float("inf"), float("-inf")):
            return None
    except ValueError:
        try:
            moment = email.utils.parsedate_to_datetime(retry_after.strip())
        except (TypeError, ValueError):
            return None
        asked = moment.timestamp() - (time.time() if now is None else now)
    asked = max(0.0, asked)
    return asked if asked <= LONGEST_WAIT else None


def fetch_one(address: str, fetch: Fetch, max_retries: int = MAX_RETRIES, sleep: Callable[[float], None] = time.sleep) -> tuple[Answer | None, int]:
    """The answer for an address (None where it failed) and the attempts it took."""
    url = urls.unwrap_urn(address)
    attempt = 0
    while True:
        try:
            answer = fetch(url)
        except Exception:  # noqa: BLE001 - whatever a client raises is a failed attempt
            wait = wait_before(attempt)
        else:
            if 200 <= answer.status <= 299:
                return answer, attempt + 1
            if answer.status != 429 and not 500 <= answer.status <= 599:
                return None, attempt + 1
            wait = wait_before(attempt, answer.retry_after)
        if wait is None or attempt >= max_retries:
            return None, attempt + 1
        sleep(wait)
        attempt += 1


def fetch_all(addresses: list[str], fetch: Fetch, max_parallel: int = MAX_PARALLEL, max_retries: int = MAX_RETRIES, sleep: Callable[[float], None] = time.sleep) -> list[tuple[Answer | None, int]]:
    """The answers in the order of the addresses, from a pool of at least one and at most ``max_parallel`` workers."""
    if not addresses:
        return []
    with ThreadPoolExecutor(max(1, min(max_parallel, len(addresses)))) as pool:
        return list(pool.map(lambda a: fetch_one(a, fetch, max_retries, sleep), addresses))


_ROW = pa.schema([("address", pa.string()), ("ok", pa.bool_()), ("status", pa.int32()), ("content_type", pa.string()), ("body", pa.binary()), ("attempts", pa.int32())])


def fetch_addresses(missing: DataFrame, fetch: Fetch, partitions: int | None = None, max_parallel: int = MAX_PARALLEL, max_retries: int = MAX_RETRIES) -> DataFrame:
    """(address, ok, status, content_type, body, attempts): each address is fetched once, however many archives miss it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                addresses = batch.column(0).slice(start, 256).to_pylist()
                rows = []
                for address, (answer, attempts) in zip(addresses, fetch_all(addresses, fetch, max_parallel, max_retries)):
                    rows.append({"address": address, "ok": answer is not None, "status": answer.status if answer else None, "content_type": (answer.content_type or "application/octet-stream") if answer else None, "body": answer.body if answer else None, "attempts": attempts})
                yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    wanted = missing.select("address").distinct()
    return (wanted.repartition(partitions, "address") if partitions else wanted).mapInArrow(run, "address string, ok boolean, status int, content_type string, body binary, attempts int")


def part_data(answer: Answer, binary: bool) -> str:
    """An answer's body as a part carries it: base64, or UTF-8 text (as ``archives.fetched_parts`` reads it)."""
    return base64.b64encode(answer.body).decode("ascii") if binary else answer.body.decode("utf-8", "replace")


def http(timeout: float = 30.0) -> Fetch:
    """A client of the standard library, for http and https addresses."""

    def fetch(url: str) -> Answer:
        request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (compatible; foliant)"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310 - only fetchable addresses come here
                return Answer(r.status, r.headers.get("Content-Type"), r.read())
        except urllib.error.HTTPError as e:
            return Answer(e.code, retry_after=e.headers.get("Retry-After"))

    return fetch
