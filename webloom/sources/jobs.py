"""The job API as a Spark stream source, and the choice between gateways.

A job is submitted with an idempotency key, and its results are paged by cursor. `job_results` is a data source whose offset is the cursor, so Spark's checkpoint is the record of what was consumed, and a batch that fails is read again from its cursor.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

RECORD = "record_id string, source_type string, schema_version string, observed_at string, payload string, external_id string, raw_ref string, published_at string, deleted boolean, sequence long"
RETRYABLE = (408, 425, 429)
STATES = ("queued", "running", "completed", "completed_with_errors", "failed", "cancelled")


class UpstreamError(Exception):
    """code; retryable; retry_after in seconds; ambiguous: a submission may have arrived; fallback: another gateway may be asked."""

    def __init__(self, code: str, message: str, retryable: bool = False, retry_after: float | None = None, ambiguous: bool = False, fallback: bool | None = None):
        super().__init__(message)
        self.code, self.retryable, self.retry_after, self.ambiguous = code, retryable, retry_after, ambiguous
        self.fallback = retryable if fallback is None else fallback


def call(method: str, url: str, body: dict | None = None, token: str | None = None, timeout: float = 30.0, attempts: int = 3, pause: float = 0.1, headers: dict | None = None) -> dict:
    """One JSON request, tried again after retryable answers."""
    data = None if body is None else json.dumps(body).encode()
    for turn in range(attempts):
        request = urllib.request.Request(url, data, {"Content-Type": "application/json", **({"Authorization": f"Bearer {token}"} if token else {}), **(headers or {})}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                made = json.loads(answer.read() or b"{}")
            if not isinstance(made, dict):
                raise UpstreamError("PROTOCOL_ERROR", "an object was expected")
            return made
        except urllib.error.HTTPError as e:
            asked = e.headers.get("Retry-After", "")
            error = UpstreamError(f"HTTP_{e.code}", str(e), e.code in RETRYABLE or e.code >= 500, float(asked) if asked.replace(".", "", 1).isdigit() else None)
        except (OSError, TimeoutError) as e:
            error = UpstreamError("UNREACHABLE", str(e), True, ambiguous=method == "POST")
        except ValueError as e:
            raise UpstreamError("PROTOCOL_ERROR", str(e)) from None
        if not error.retryable or turn == attempts - 1:
            raise error
        time.sleep(max(pause * 2**turn, error.retry_after or 0))
    raise AssertionError


class JobApi:
    def __init__(self, base: str, token: str | None = None, **more):
        self.base, self.token, self.more = base.rstrip("/"), token, more

    def submit(self, spec: dict, key: str) -> str:
        return str(call("POST", f"{self.base}/jobs", {"spec": spec, "idempotency_key": key}, self.token, headers={"Idempotency-Key": key}, **self.more)["job_id"])

    def status(self, job: str) -> str:
        state = str(call("GET", f"{self.base}/jobs/{quote(job)}", None, self.token, **self.more).get("status", "")).lower()
        if state not in STATES:
            raise UpstreamError("PROTOCOL_ERROR", f"unknown state {state!r}")
        return state

    def results(self, job: str, cursor: str | None) -> dict:
        at = f"?cursor={quote(cursor)}" if cursor else ""
        return call("GET", f"{self.base}/jobs/{quote(job)}/results{at}", None, self.token, **self.more)

    def cancel(self, job: str) -> None:
        call("POST", f"{self.base}/jobs/{quote(job)}/cancel", {}, self.token, **self.more)


def record(raw: dict, nth: int) -> tuple:
    """A record as a row of RECORD; a missing id is record-<n>. What is no record raises PROTOCOL_ERROR."""
    if not isinstance(raw, dict) or not isinstance(raw.get("payload", {}), dict) or not isinstance(raw.get("deleted", False), bool):
        raise UpstreamError("PROTOCOL_ERROR", "not a record")
    text = lambda k, d=None: d if raw.get(k) is None else str(raw[k])
    return (text("record_id", f"record-{nth}"), text("source_type", ""), text("schema_version", "1.0"), text("observed_at"), json.dumps(raw.get("payload", {}), sort_keys=True, ensure_ascii=False, separators=(",", ":")), text("external_id"), text("raw_ref"), text("published_at"), raw.get("deleted", False), raw.get("sequence"))


class JobResults(DataSource):
    """spark.readStream.format("job_results").option("url", ...).option("job", ...)"""

    @classmethod
    def name(cls) -> str:
        return "job_results"

    def schema(self) -> str:
        return RECORD

    def simpleStreamReader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


TERMINAL = ("completed", "completed_with_errors", "failed", "cancelled")


class PagedReader(SimpleDataSourceStreamReader):
    """The offset is the cursor of the page that is read next, how many of its records were consumed, how many were in all, and whether that was the end. The last page has no cursor after it: while the job runs it is read again for records that came later."""

    def __init__(self, options: dict):
        self.api, self.job = JobApi(options["url"], options.get("token")), options["job"]

    def initialOffset(self) -> dict:
        return {"cursor": "", "seen": 0, "n": 0, "done": False}

    def _page(self, start: dict) -> tuple[list[tuple], dict]:
        state = self.api.status(self.job)  # before the page: what a finished job has is all there
        got = self.api.results(self.job, start["cursor"] or None)
        raw = got.get("records", [])
        if not isinstance(raw, list) or not isinstance(got.get("has_more", False), bool):
            raise UpstreamError("PROTOCOL_ERROR", "not a page of records")
        rows = [record(r, start["n"] + k + 1) for k, r in enumerate(raw[start["seen"] :])]
        n = start["n"] + len(rows)
        if not got.get("has_more"):
            return rows, {"cursor": start["cursor"], "seen": start["seen"] + len(rows), "n": n, "done": state in TERMINAL}
        after = str(got.get("next_cursor") or "")
        if after in ("", start["cursor"]):
            raise UpstreamError("UPSTREAM_CURSOR_STALLED", "more records, but the cursor stays")
        return rows, {"cursor": after, "seen": 0, "n": n, "done": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["done"]:
            return iter(()), start
        rows, after = self._page(start)
        return iter(rows), after

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start
        while at["n"] < end["n"]:
            before = at
            rows, at = self._page(at)
            yield from rows[: end["n"] - before["n"]]


class MemoryJobs:
    """Jobs over rows that are given: made by idempotency key, paged by an integer offset, no cursor after the last page. For tests and demos; same calls as JobApi."""

    def __init__(self, records: Callable[[dict], list[dict]], page_size: int = 100):
        if page_size < 1:
            raise ValueError("page_size must be at least 1")
        self.make, self.page_size = records, page_size
        self.jobs: dict[str, list[dict]] = {}
        self.keys: dict[str, str] = {}

    def submit(self, spec: dict, key: str) -> str:
        if key not in self.keys:
            self.keys[key] = f"job_{hashlib.sha256(key.encode()).hexdigest()[:32]}"
            self.jobs[self.keys[key]] = list(self.make(spec))
        return self.keys[key]

    def _rows(self, job: str) -> list[dict]:
        if job not in self.jobs:
            raise UpstreamError("UNKNOWN_JOB", f"unknown job {job}")
        return self.jobs[job]

    def status(self, job: str) -> str:
        self._rows(job)
        return "completed"

    def results(self, job: str, cursor: str | None) -> dict:
        rows, at = self._rows(job), int(cursor or 0)
        if not 0 <= at <= len(rows):
            raise UpstreamError("PROTOCOL_ERROR", "no such offset")
        end = min(at + self.page_size, len(rows))
        more = end < len(rows)
        return {"records": rows[at:end], "has_more": more, "next_cursor": str(end) if more else None, "result_schema_version": "1.0"}

    def cancel(self, job: str) -> None:
        self._rows(job)


def all_records(api: JobApi | MemoryJobs, job: str) -> list[tuple]:
    """Every record of a job, page after page."""
    reader = PagedReader.__new__(PagedReader)
    reader.api, reader.job = api, job
    at, out = reader.initialOffset(), []
    while not at["done"]:
        before = at
        rows, at = reader._page(at)
        out += rows
        if at == before:
            break
    return out


def route(gateways: dict[str, Callable[[], str]], hint: str | None = None, sticky: str | None = None) -> tuple[str, str]:
    """Submits to the first gateway that takes the job: (gateway, job). The hinted one is tried first, a hint that names none is an error; a job that has a gateway stays there. Another one is tried only after a failure that allows it (fallback) and that can't have left a job behind."""
    if hint is not None and hint not in gateways:
        raise UpstreamError("UNKNOWN_GATEWAY", f"unknown gateway {hint}")
    order = [sticky] if sticky else [*([hint] if hint else []), *(g for g in gateways if g != hint)]
    last: UpstreamError | None = None
    for name in order:
        if name not in gateways:
            raise UpstreamError("UNKNOWN_GATEWAY", f"unknown gateway {name}")
        try:
            return name, gateways[name]()
        except UpstreamError as e:
            last = e
            if e.ambiguous or not e.fallback:
                break
    raise last or UpstreamError("NO_UPSTREAM_GATEWAY", "no gateway is configured")
