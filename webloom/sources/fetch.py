"""A static fetcher: GET over HTTP from the executors, without following redirects.

It is a fetcher as crawl.py has them: rows with a column `wire` come back with the columns of an answer. A request is checked by the network policy first, names looked up once in a task; a body beyond max_bytes is an error; an error that may pass is tried once more.
"""

from __future__ import annotations

import http.client
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.html import decode_body
from webloom.functions.urls import network_reason
from webloom.session import ship

MAX_BYTES = 8_000_000
TIMEOUT = 20.0
ATTEMPTS, PAUSE = 2, 0.1


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **more):
        return None


def addresses(host: str) -> list[str]:
    return sorted({r[4][0] for r in socket.getaddrinfo(host, 443, socket.AF_UNSPEC, socket.SOCK_STREAM)})


def get(url: str, timeout: float = TIMEOUT, max_bytes: int = MAX_BYTES, allow_private: bool = False, resolve: Callable[[str], list[str]] | None = addresses) -> dict:
    """One request: status, media_type, body, redirect_to, or error and whether it may pass."""
    made = {"status": 0, "media_type": "", "body": "", "redirect_to": None, "error": None, "retryable": False}
    reason = network_reason(url, "GET", allow_private, resolve_host=resolve)
    if reason:
        return made | {"error": "network_policy_denied", "retryable": reason == "dns_resolution_failed"}
    try:
        try:
            answer = urllib.request.build_opener(_Stay).open(urllib.request.Request(url, headers={"User-Agent": "webloom"}), timeout=timeout)
        except urllib.error.HTTPError as e:
            answer = e
        with answer:
            head = answer.headers
            size = head.get("Content-Length", "")
            raw = b"" if size.isdigit() and int(size) > max_bytes else answer.read(max_bytes + 1)
            if (size.isdigit() and int(size) > max_bytes) or len(raw) > max_bytes:
                return made | {"error": "response_too_large"}
            kind = head.get("Content-Type", "")
            moved = head.get("Location") if 300 <= answer.status < 400 else None
            return made | {"status": answer.status, "media_type": kind.partition(";")[0].strip().lower(), "body": decode_body(raw, kind), "redirect_to": moved}
    except (OSError, ValueError, http.client.HTTPException):
        return made | {"error": "http_fetch_failed", "retryable": True}


def static(timeout: float = TIMEOUT, max_bytes: int = MAX_BYTES, allow_private: bool = False) -> Callable[[DataFrame], DataFrame]:
    def fetch(wanted: DataFrame) -> DataFrame:
        ship(wanted.sparkSession)
        kind = "wire string, status int, media_type string, body string, redirect_to string, error string, requests int, rendered boolean, fallback_failed boolean"

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known: dict[str, list[str]] = {}

            def resolve(host: str) -> list[str]:
                if host not in known:
                    known[host] = addresses(host)
                return known[host]

            for frame in frames:
                rows = []
                for url in frame["wire"]:
                    for turn in range(1, ATTEMPTS + 1):
                        got = get(url, timeout, max_bytes, allow_private, resolve)
                        if not got["retryable"] or turn == ATTEMPTS:
                            break
                        time.sleep(PAUSE * turn)
                    rows.append((url, got["status"], got["media_type"], got["body"], got["redirect_to"], got["error"], turn, False, False))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in kind.split(", ")])

        # answers are joined back, so whatever rows carry does not pass through Python
        answers = wanted.select("wire").distinct().mapInPandas(run, kind)
        return wanted.join(answers.withColumnRenamed("wire", "w"), F.col("wire") == F.col("w"), "left").drop("w")

    return fetch
