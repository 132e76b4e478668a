"""The run engine over a store, against gateways that keep what they were asked in files."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from webloom.functions import ids
from webloom.operators import engine, policies
from webloom.operators.engine import Engine, Retry, RunNotFound
from webloom.sources.jobs import UpstreamError
from webloom.sources.store import Store

NOW = datetime(2026, 1, 1)


class Scripted:
    """A job for each key, its records paged by offset; the first calls of an operation fail as told."""

    def __init__(self, root, records, page_size=10, failures=None, state="completed"):
        self.root, self.records, self.page_size, self.failures, self.state = Path(root), records, page_size, failures or {}, state

    def count(self, operation):
        return len(list(self.root.glob(operation + "-*")))

    def asked(self, operation):
        n = self.count(operation)
        (self.root / f"{operation}-{n}").touch()
        told = self.failures.get(operation, [])
        if n < len(told):
            raise UpstreamError(*told[n])

    def submit(self, spec, key):
        self.asked("submit")
        return "job-" + key

    def status(self, job):
        self.asked("status")
        return self.state

    def results(self, job, cursor):
        self.asked("read")
        at = int(cursor or 0)
        end = min(at + self.page_size, len(self.records))
        more = end < len(self.records)
        return {"records": self.records[at:end], "has_more": more, "next_cursor": str(end) if more else None}

    def cancel(self, job):
        self.asked("cancel")


def rec(name, key="k", body="v1"):
    return {"record_id": name, "payload": {"key": key, "body": body}}


def registry(kind="page"):
    def draft(r):
        body = F.get_json_object("r_payload", "$.body")
        return r.select("gateway_key", F.col("r_record_id").alias("record_id"), "arrival", F.lit(kind).alias("content_type_key"), F.lit("1.0").alias("content_schema_version"), F.lit(None).cast("timestamp").alias("observed_at"), (~F.col("r_deleted")).alias("present"), F.when(~F.col("r_deleted"), ids.canonical_struct(body=body)).alias("content"), F.col("r_payload").alias("identity"), F.lit(None).cast("string").alias("attempt_ref"), F.lit(None).cast("timestamp").alias("published_at"))

    known = policies.Registry()
    known.add(policies.Policy("page", frozenset({("page", "1.0")}), "subject", lambda x: F.get_json_object(x, "$.key"), lambda x: F.get_json_object(x, "$.body")))
    known.add(policies.Mapping("pages", frozenset({("pages", "1.0")}), draft))
    return known


@pytest.fixture
def build(spark, tmp_path):
    def make(records, retry=Retry(poll_interval=0, base_delay=2, max_delay=10), known=None, **script):
        calls = tmp_path / "calls"
        calls.mkdir(exist_ok=True)
        gateway = Scripted(calls, records, **script)
        return Engine(Store(spark, f"file://{tmp_path}/store"), known or registry(), lambda: {"g": gateway}, retry), gateway

    return make


def submit(engine, key="one", scope="a", most=None, deadline=None):
    kind = "submitted_order long, scope_key string, idempotency_key string, collection_type string, schema_version string, spec string, gateway string, priority int, deadline_at timestamp, max_records long"
    rows = engine.spark.createDataFrame([(1, scope, key, "pages", "1.0", "{}", None, 0, deadline, most)], kind)
    return engine.submit(rows, NOW).first()


def brief(engine, run):
    r = engine.get(run, "a")
    return r["status"], r["error_code"], r["processed"], r["failed"], r["changes"]


def test_run_to_its_end(build):
    engine, gateway = build([rec("1", "k1"), rec("1", "k1"), rec("2", "k2"), rec("2", "k2", "other")], page_size=1)
    first = submit(engine)
    assert first.outcome == "created" and submit(engine).outcome == "existing"
    assert engine.wake(NOW) == {"inspected": 1, "progressed": 1, "completed": 1, "failed": 0, "deferred": 0}
    # a repeated record is ignored, one with another content is a failure
    assert brief(engine, first.run_id) == ("completed_with_errors", "UPSTREAM_COMPLETED_WITH_ERRORS", 2, 1, 2)
    assert [r.code for r in engine.store.read("failures").collect()] == ["IDEMPOTENCY_CONFLICT"]
    assert engine.wake(NOW)["inspected"] == 0 and gateway.count("submit") == 1
    with pytest.raises(RunNotFound):
        engine.get(first.run_id, "b")
    # another run brings the same records, an absence and a change: history goes on from what is stored
    gateway.records[:] = [rec("1", "k1"), rec("3", "k1", "v2"), {**rec("4", "k2"), "deleted": True}, {"record_id": "5", "payload": {}}]
    second = submit(engine, "two")
    engine.wake(NOW)
    assert brief(engine, second.run_id) == ("completed_with_errors", "UPSTREAM_COMPLETED_WITH_ERRORS", 2, 1, 2)
    kinds = engine.store.read("events").orderBy("event_order").collect()
    assert [(e.subject_key, e.kind, e.sequence) for e in kinds] == [("k1", "first_seen", 1), ("k2", "first_seen", 1), ("k1", "revised", 2), ("k2", "missing_suspected", 2)]
    assert {a.operation for a in engine.store.read("attempts").collect()} == {"submit", "status", "read_results"}


def test_pages_over_wakes(build):
    engine, _ = build([rec(str(i), str(i)) for i in range(3)], retry=Retry(poll_interval=0, batches=1), page_size=1)
    run = submit(engine).run_id
    seen = []
    for _ in range(3):
        engine.wake(NOW)
        seen.append(brief(engine, run)[::2])
    assert seen == [("running", 1, 1), ("running", 2, 2), ("completed", 3, 3)]


def test_backoff(build):
    busy = ("TEMPORARY", "not now", True)
    engine, gateway = build([], failures={"submit": [busy, busy]})
    run = submit(engine).run_id
    asked = []
    for at in (0, 0, 2, 6):
        engine.wake(NOW + timedelta(seconds=at))
        asked.append((gateway.count("submit"), brief(engine, run)[0]))
    assert asked == [(1, "running"), (1, "running"), (2, "running"), (3, "completed")]


def test_failure_for_good(build):
    engine, _ = build([], failures={"submit": [("UNAUTHORIZED", "no")]})
    run = submit(engine).run_id
    assert engine.wake(NOW)["failed"] == 1 and brief(engine, run)[:2] == ("failed", "UNAUTHORIZED")


def test_limit_and_deadline(build):
    engine, gateway = build([rec("1", "a"), rec("1", "a"), rec("2", "b")])
    run, late = submit(engine, most=1).run_id, submit(engine, "late", deadline=NOW).run_id
    engine.wake(NOW)
    assert brief(engine, run) == ("completed_with_errors", "RESULT_LIMIT_REACHED", 1, 0, 1) and gateway.count("cancel") == 1
    assert brief(engine, late)[:3] == ("completed_with_errors", "DEADLINE_EXCEEDED", 0) and gateway.count("submit") == 1


def test_cancel_and_recover(build):
    engine, gateway = build([], state="running")
    queued = submit(engine).run_id
    assert [engine.cancel(queued, "a", NOW) for _ in range(2)] == ["cancelled"] * 2 and gateway.count("submit") == 0
    run = submit(engine, "two").run_id
    engine.wake(NOW)
    assert engine.cancel(run, "a", NOW) == "running" and engine.recover(NOW) == 1 and engine.get(run, "a")["status"] == "queued"
    engine.wake(NOW)
    assert brief(engine, run)[0] == "cancelled" and gateway.count("cancel") == 1


def test_unsupported(build):
    engine, _ = build([rec("1")], known=registry("unknown"))
    run = submit(engine).run_id
    engine.wake(NOW)
    r = engine.get(run, "a")
    assert (r["status"], r["failures"], r["cursor"], r["processed"], r["failed"]) == ("running", 1, None, 0, 0)
    assert engine.incomplete().count() == 1


def test_another_writer(build, monkeypatch):
    """A wake that another commit overtakes gives up its copy and does not fail the run, which is claimed again after its lease."""
    build_, _ = build([rec("1")])
    run = submit(build_).run_id
    called = engine.calls

    def overtaken(*args):
        monkeypatch.setattr(engine, "calls", called)
        build_.store.commit("other", {})
        return called(*args)

    monkeypatch.setattr(engine, "calls", overtaken)
    assert build_.wake(NOW) == {"inspected": 1, "progressed": 0, "completed": 0, "failed": 0, "deferred": 0}
    assert brief(build_, run)[:3] == ("queued", None, 0) and build_.store.read("events") is None
    assert build_.wake(NOW)["inspected"] == 0 and build_.wake(NOW + timedelta(seconds=60))["completed"] == 1
    assert brief(build_, run)[:3] == ("completed", None, 1)
