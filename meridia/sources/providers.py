"""Calls to outside models as batch functions: bounded batches, retries, one rate limit for a job, and statuses.

A provider is a picklable factory of an object with `__call__(list of texts) -> list of results`; it is made once per
partition. Without one, stored results are read instead.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


class Retryable(Exception):
    """A failure worth trying again; `wait` may name the seconds to wait."""

    def __init__(self, message: str = "", wait: float | None = None):
        super().__init__(message)
        self.wait = wait


def call_with_retries(call: Callable, texts: list[str], attempts: int = 3, sleep: Callable = time.sleep):
    """The call's results, waiting 1, 2, 4... seconds (or what the failure asks for) between attempts."""
    for k in range(attempts):
        try:
            return call(texts)
        except Retryable as e:
            if k == attempts - 1:
                raise
            sleep(e.wait if e.wait is not None else 2.0**k)


def http_provider(url: str, key: str = "", timeout: float = 60.0) -> Callable[[], Callable[[list[str]], list[str]]]:
    """A factory of a provider that posts {"input": texts} and takes {"output": results}.

    429 and 5xx are tried again, after the seconds that Retry-After asks for; other statuses are failures at once.
    """

    def make() -> Callable[[list[str]], list[str]]:
        def call(texts: list[str]) -> list[str]:
            head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
            asked = urllib.request.Request(url, json.dumps({"input": texts}).encode(), head)
            try:
                with urllib.request.urlopen(asked, timeout=timeout) as answer:
                    return json.load(answer)["output"]
            except urllib.error.HTTPError as e:
                if e.code == 429 or e.code >= 500:
                    said = e.headers.get("Retry-After", "")
                    raise Retryable(f"status {e.code}", float(said) if said.replace(".", "", 1).isdigit() else None) from e
                raise ValueError(f"status {e.code}") from e
            except (urllib.error.URLError, TimeoutError) as e:
                raise Retryable(str(e)) from e

        return call

    return make


def apply_provider(rows: DataFrame, factory: Callable, batch: int = 20, per_second: float = 10.0, streams: int = 1, attempts: int = 3) -> DataFrame:
    """record_id, result string, status (ok, empty, failed: why) of rows (record_id, text).

    Calls of the whole job stay under per_second: rows go in `streams` partitions, and each makes its share of the calls.
    A retry counts as a call. An answer with another number of results than texts fails its batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, due = factory(), 0.0

        def paced(texts: list[str]) -> list[str]:
            nonlocal due
            time.sleep(max(0.0, due - time.monotonic()))
            due = time.monotonic() + streams / per_second
            got = own(texts)
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} results for {len(texts)} texts")
            return got

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for s in range(0, len(ids), batch):
                asked = [t or "" for t in texts[s : s + batch]]
                try:
                    got, status = call_with_retries(paced, asked, attempts), None
                except Exception as e:
                    got, status = [None] * len(asked), f"failed: {type(e).__name__}"
                yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + batch], b.column(0).type), pa.array(got, pa.string()), pa.array([status or ("ok" if g else "empty") for g in got])], ["record_id", "result", "status"])

    kind = dict(rows.dtypes)["record_id"]
    return rows.select("record_id", "text").repartition(streams).mapInArrow(run, f"record_id {kind}, result string, status string")


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").count()
