"""The run engine: submission, wakes, cancellation and recovery as DataFrame steps over a store.

A wake claims due runs under a lease, calls their gateways in tasks of one run each, takes the pages that were read through mappings, policies and change history, and writes all that in one commit. A run's next status is one CASE over what its calls and records gave. Runs are appended with a higher state_version; the last version counts.

Every commit names the store's version that it was worked out from. A wake that finds another writer's commit gives up what it has and leaves the runs to be claimed again after their leases: a job is submitted under the run's id and records are admitted by (scope, gateway, record), so a repeated wake changes nothing twice. A run one of whose records no policy or mapping can take keeps its cursor and none of the wake's records, and is tried again as after any retryable failure.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from webloom.functions import ids
from webloom.operators import delivery, history, policies
from webloom.operators import runs as run_rules
from webloom.session import Workspace, ship
from webloom.sources import jobs
from webloom.sources.store import ConflictError, Store

RUN = (
    "run_id string, scope_key string, idempotency_key string, request_fingerprint string, collection_type string, schema_version string, spec string, gateway string, mapping_key string, priority int, "
    "status string, accepted_at timestamp, started_at timestamp, finished_at timestamp, updated_at timestamp, next_wakeup_at timestamp, lease_owner string, lease_until timestamp, "
    "gateway_key string, job_id string, cursor string, received long, processed long, failed long, changes long, failures int, cancel_requested boolean, deadline_at timestamp, max_records long, "
    "error_code string, error_message string, state_version long"
)
RESULT = "gateway_key string, job_id string, cursor string, received long, state string, drained boolean, cancelled boolean, failures int, error_code string, error_message string, retryable boolean, retry_after double, attempts array<struct<operation:string,gateway_key:string,outcome:string,error_code:string>>"
CALL = f"run_id string, page int, first long, records array<struct<{', '.join(f.replace(' ', ':') for f in jobs.RECORD.split(', '))}>>, result struct<{', '.join(f.replace(' ', ':', 1) for f in RESULT.split(', '))}>"
CLAIMS_MOST = 1000
_RUN_SPAN, _WAKE_SPAN = 10**9, 10**12


class RunNotFound(LookupError):
    """No such run in this scope."""


@dataclass(frozen=True)
class Retry:
    max_attempts: int = 3
    base_delay: float = 1.0
    max_delay: float = 60.0
    poll_interval: float = 1.0
    lease: float = 60.0
    batches: int = 100  #: pages of a run in one wake

    def __post_init__(self):
        if self.max_attempts < 1 or self.batches < 1:
            raise ValueError("max_attempts and batches must be at least 1")
        if self.base_delay < 0 or self.max_delay < self.base_delay or self.poll_interval < 0 or self.lease <= 0:
            raise ValueError("delays must not be negative, the longest not below the first, and a lease must last")


def latest(rows: DataFrame) -> DataFrame:
    """The last version of each run."""
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), "state_version").alias("r")).select("r.*")


def transition(runs: DataFrame, now: Column, retry: Retry = Retry()) -> DataFrame:
    """The runs after a wake. Beside the columns of RUN: result (a RESULT; null where nothing was called), n_new, n_failed, n_changes, limited (a record came past max_records) and unsupported (no mapping or policy took a record). What the wake gave is counted in; a run that is over is not touched."""
    r = lambda name: F.col(f"result.{name}")
    stop = F.coalesce(F.col("deadline_at") <= now, F.lit(False))
    over = F.col("status").isin(*run_rules.TERMINAL)
    took = ~F.coalesce("unsupported", F.lit(False))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)) + F.when(took, F.coalesce("n_" + {"processed": "new", "failed": "failed", "changes": "changes"}[c], F.lit(0))).otherwise(0)
    cancelled = F.coalesce(r("cancelled"), F.lit(False)) | (F.coalesce("cancel_requested", F.lit(False)) & F.col("job_id").isNull())
    limited = F.coalesce("limited", F.lit(False)) & took
    asked = r("error_code").isNotNull()
    code = F.when(~took, "ENGINE_FAILURE").otherwise(r("error_code"))
    tried = F.when(~took, 1).otherwise(F.coalesce(r("failures"), F.col("failures"), F.lit(0)))
    given_up = code.isNotNull() & ((took & asked & ~F.coalesce(r("retryable"), F.lit(False))) | (tried >= retry.max_attempts))
    state, bad = r("state"), count("failed") > 0
    # what ends a run, the first that holds: condition, status, error
    ends = (
        (stop, "completed_with_errors", F.lit("DEADLINE_EXCEEDED")),
        (cancelled, "cancelled", None),
        (limited, "completed_with_errors", F.lit("RESULT_LIMIT_REACHED")),
        (given_up, "failed", code),
        (code.isNotNull() | ~F.coalesce(r("drained"), F.lit(False)), "running", None),
        (((state == "completed") & bad) | (state == "completed_with_errors"), "completed_with_errors", F.lit("UPSTREAM_COMPLETED_WITH_ERRORS")),
        (state == "completed", "completed", None),
        (state == "failed", "failed", F.lit("UPSTREAM_JOB_FAILED")),
        (state == "cancelled", "cancelled", None),
    )
    status, error = F.lit("running"), F.lit(None).cast("string")
    for condition, name, why in reversed(ends):
        status = F.when(condition, name).otherwise(status)
        error = F.when(condition, why if why is not None else F.lit(None).cast("string")).otherwise(error)
    wait = F.when(code.isNotNull(), delivery.backoff(tried, retry.base_delay, retry.max_delay, r("retry_after"))).when(F.coalesce(r("drained"), F.lit(False)), retry.poll_interval).otherwise(0.0)
    ended = status.isin(*run_rules.TERMINAL)
    message = F.when(given_up & took, r("error_message")).otherwise(error)
    none = F.lit(None)
    new = {
        "status": status,
        "started_at": F.when(stop, F.col("started_at")).otherwise(F.coalesce("started_at", now)),
        "finished_at": F.when(ended, now),
        "updated_at": now,
        "next_wakeup_at": F.when(~ended, (now.cast("double") + wait).cast("timestamp")),
        "lease_owner": none.cast("string"),
        "lease_until": none.cast("timestamp"),
        "gateway_key": F.coalesce(r("gateway_key"), F.col("gateway_key")),
        "job_id": F.coalesce(r("job_id"), F.col("job_id")),
        "cursor": F.when(took, F.coalesce(r("cursor"), F.col("cursor"))).otherwise(F.col("cursor")),
        "received": F.when(took, F.coalesce(r("received"), F.col("received"))).otherwise(F.col("received")),
        "processed": count("processed"),
        "failed": count("failed"),
        "changes": count("changes"),
        "failures": tried.cast("int"),
        "error_code": error,
        "error_message": message,
        "state_version": F.col("state_version") + 1,
    }
    names = [f.split()[0] for f in RUN.split(", ")]
    return runs.select(*[F.when(over, F.col(c)).otherwise(new[c]).alias(c) if c in new else F.col(c) for c in names])


def recover(runs: DataFrame, now: Column) -> DataFrame:
    """The runs that an interrupted worker left, due again: not over, under no live lease."""
    left = runs.where(~F.col("status").isin(*run_rules.TERMINAL) & F.coalesce(F.col("lease_until") <= now, F.lit(True)))
    return left.withColumns({
        "status": F.when(F.col("status") == "running", "queued").otherwise(F.col("status")), "lease_owner": F.lit(None).cast("string"), "lease_until": F.lit(None).cast("timestamp"),
        "next_wakeup_at": now, "updated_at": now, "state_version": F.col("state_version") + 1,
    })


class _Caller:
    """A run's calls in a wake."""

    def __init__(self, run: dict, gateways: dict, batches: int):
        self.run, self.gateways, self.batches = run, gateways, batches
        self.end = {"gateway_key": run["gateway_key"], "job_id": run["job_id"], "cursor": run["cursor"], "received": run["received"] or 0, "drained": False, "failures": run["failures"] or 0, "attempts": []}

    def ask(self, operation: str, call: Callable):
        gateway = None if operation == "submit" else self.end["gateway_key"]
        try:
            made = call()
        except Exception as e:  # whatever a gateway raises is its failure and not the task's
            known = e if isinstance(e, jobs.UpstreamError) else jobs.UpstreamError("UPSTREAM_UNAVAILABLE", str(e), True)
            self.end["failures"] += 1
            self.end["attempts"].append({"operation": operation, "gateway_key": gateway, "outcome": "failed", "error_code": known.code})
            self.end |= {"error_code": known.code, "error_message": str(known) or known.code, "retryable": known.retryable, "retry_after": known.retry_after}
            return None
        self.end["failures"] = 0
        self.end["attempts"].append({"operation": operation, "gateway_key": made[0] if operation == "submit" else gateway, "outcome": "success", "error_code": None})
        return (made,)

    def api(self):
        if self.end["gateway_key"] not in self.gateways:
            raise jobs.UpstreamError("UNKNOWN_GATEWAY", f"unknown gateway {self.end['gateway_key']}")
        return self.gateways[self.end["gateway_key"]]

    def page(self) -> tuple[list[tuple], str | None]:
        """The records at the cursor, and the next cursor; None after the last page."""
        got = self.api().results(self.end["job_id"], self.end["cursor"])
        raw = got.get("records", [])
        if not isinstance(raw, list):
            raise jobs.UpstreamError("PROTOCOL_ERROR", "not a page of records")
        rows = [jobs.record(r, self.end["received"] + k + 1) for k, r in enumerate(raw)]
        if not got.get("has_more"):
            return rows, None
        after = str(got.get("next_cursor") or "")
        if after in ("", self.end["cursor"] or ""):
            raise jobs.UpstreamError("UPSTREAM_CURSOR_STALLED", "more records, but the cursor stays")
        return rows, after

    def rows(self) -> Iterator[dict]:
        """A row for each page, and one with the result."""
        run, end = self.run, self.end
        if run["overdue"]:
            yield {"run_id": run["run_id"]}
            return
        if run["cancel_requested"]:
            if end["job_id"] is not None:
                end["cancelled"] = self.ask("cancel", lambda: self.api().cancel(end["job_id"])) is not None
            yield {"run_id": run["run_id"], "result": end}
            return
        if end["job_id"] is None:
            spec = json.loads(run["spec"] or "{}")
            made = self.ask("submit", lambda: jobs.route({k: (lambda g=g: g.submit(spec, run["run_id"])) for k, g in self.gateways.items()}, run["gateway"]))
            if made:
                end["gateway_key"], end["job_id"] = made[0]
        if end["job_id"] is not None and (state := self.ask("status", lambda: self.api().status(end["job_id"]))):
            end["state"] = state[0]
            for nth in range(self.batches):
                got = self.ask("read_results", self.page)
                if got is None:
                    break
                records, after = got[0]
                yield {"run_id": run["run_id"], "page": nth, "first": end["received"], "records": records}
                end["received"] += len(records)
                if after is None:
                    end["drained"] = True
                    break
                end["cursor"] = after
        yield {"run_id": run["run_id"], "result": end}


def calls(claimed: DataFrame, gateways: Callable[[], dict], now: Column, batches: int = 100) -> DataFrame:
    """What the gateways of the claimed runs answer (CALL). gateways makes them in the task, by name."""
    schema = StructType.fromDDL(CALL)
    arrow = to_arrow_schema(schema)
    names = [f.split()[0] for f in jobs.RECORD.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = gateways()
        for part in parts:
            for r in part.to_pylist():
                for row in _Caller(r, known, batches).rows():
                    row["records"] = [dict(zip(names, x, strict=True)) for x in row["records"]] if "records" in row else None
                    yield pa.RecordBatch.from_pylist([row], arrow)

    overdue = F.coalesce(F.col("deadline_at") <= now, F.lit(False)).alias("overdue")
    slim = claimed.select("run_id", "spec", "gateway", "gateway_key", "job_id", "cursor", "received", "failures", F.coalesce("cancel_requested", F.lit(False)).alias("cancel_requested"), overdue)
    return slim.repartition("run_id").mapInArrow(run, schema)


def consume(pages: DataFrame, claimed: DataFrame, registry: policies.Registry, wake: int = 0, ingested: DataFrame | None = None) -> DataFrame:
    """The records of pages (run_id, page, first, records) as observations in arrival order, with claim_order, outcome (created, duplicate, failed), error, limited (cut off past max_records). claimed: RUN and claim_order from 1, at most 1000 rows."""
    run = F.broadcast(claimed.select("run_id", "collection_type", "schema_version", "mapping_key", F.col("gateway_key").alias("run_gateway"), "claim_order", F.coalesce("received", F.lit(0)).alias("had")))
    rows = pages.where("records is not null").join(run, "run_id").select("*", F.posexplode("records").alias("at", "record"))
    order = F.lit(wake).cast("long") * _WAKE_SPAN + F.col("claim_order").cast("long") * _RUN_SPAN + F.col("first") - F.col("had") + F.col("at")
    rows = rows.select(F.col("run_gateway").alias("gateway_key"), "mapping_key", "collection_type", "schema_version", order.alias("arrival"), *[F.col(f"record.{f.split()[0]}").alias(f"r_{f.split()[0]}") for f in jobs.RECORD.split(", ")])
    made = [m.draft(rows.where(F.struct("collection_type", "schema_version").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in sorted(m.types)]) & (F.col("mapping_key") == key))) for key, m in registry.mappings.items()]
    drafts = reduce(DataFrame.unionByName, made)
    nth = F.floor(F.col("arrival") % _WAKE_SPAN / _RUN_SPAN).cast("int")
    owner = F.broadcast(claimed.select(F.col("claim_order").cast("int").alias("claim_order"), "run_id", F.col("scope_key").alias("run_scope"), "max_records", F.coalesce("processed", F.lit(0)).alias("before")))
    drafts = drafts.withColumn("claim_order", nth).join(owner, "claim_order")
    seen = policies.observe(drafts, registry, F.col("run_scope"), F.concat(F.lit("attempt_"), F.col("run_id"), F.lit(f"-{wake}")))
    print_ = ids.fingerprint(subject=F.col("subject_key"), content=F.col("content"), observed=F.col("observed_at").cast("string"))
    seen = seen.withColumn("fingerprint", print_)

    def judged(rows: DataFrame) -> DataFrame:
        good = history.admit(rows.where("error is null"), ingested)
        return good.unionByName(rows.where("error is not null").withColumn("outcome", F.lit("failed")))

    line = Window.partitionBy("run_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    bound = seen.where("max_records is not null")
    room = F.col("max_records") - F.col("before")
    cut = judged(bound).withColumn("used", F.coalesce(F.count_if(F.col("outcome") == "created").over(line), F.lit(0))).withColumn("limited", F.col("used") >= room)
    seen = seen.where("max_records is null").withColumn("limited", F.lit(False)).unionByName(cut.drop("used", "outcome"))
    kept = judged(seen.where("not limited")).unionByName(seen.where("limited").withColumn("outcome", F.lit(None).cast("string")))
    conflict = F.col("outcome") == "conflict"
    return kept.withColumns({"error": F.when(conflict, "IDEMPOTENCY_CONFLICT").otherwise(F.col("error")), "outcome": F.when(conflict, "failed").otherwise(F.col("outcome"))})


def tally(consumed: DataFrame, decided: DataFrame) -> DataFrame:
    """claim_order, n_new, n_failed, n_changes, limited, unsupported of each run. A row that history rejects has failed."""
    of = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    records = consumed.groupBy("claim_order").agg(of(F.col("outcome") == "created").alias("made"), of(F.col("outcome") == "failed").alias("bad"), F.bool_or("limited").alias("limited"), F.bool_or(F.coalesce(F.col("error") == "CONFIGURATION_ERROR", F.lit(False))).alias("unsupported"))
    told = decided.groupBy("claim_order").agg(of(F.col("rejected")).alias("refused"), F.count("kind").alias("n_changes"))
    j = records.join(told, "claim_order", "left")
    refused = F.coalesce("refused", F.lit(0))
    return j.select("claim_order", (F.col("made") - refused).alias("n_new"), (F.col("bad") + refused).alias("n_failed"), F.coalesce("n_changes", F.lit(0)).alias("n_changes"), "limited", "unsupported")


class Engine:
    def __init__(self, store: Store, registry: policies.Registry, gateways: Callable[[], dict], retry: Retry = Retry(), worker: str = "worker", **quotas):
        self.store, self.registry, self.gateways, self.retry, self.worker, self.quotas = store, registry, gateways, retry, worker, quotas
        self.spark = store.spark

    def runs(self) -> DataFrame:
        rows = self.store.read("runs")
        return latest(rows) if rows is not None else self.spark.createDataFrame([], RUN)

    def get(self, run_id: str, scope_key: str) -> dict:
        found = self.runs().where((F.col("run_id") == run_id) & (F.col("scope_key") == scope_key)).collect()
        if not found:
            raise RunNotFound(run_id)
        return found[0].asDict()

    def incomplete(self) -> DataFrame:
        return self.runs().where(~F.col("status").isin(*run_rules.TERMINAL)).orderBy("accepted_at", "run_id")

    def _commit(self, tables: dict[str, DataFrame], version: int) -> None:
        self.store.commit(uuid.uuid4().hex, tables, version)

    def submit(self, requests: DataFrame, now: datetime) -> DataFrame:
        """Requests (submitted_order, scope_key, idempotency_key, collection_type, schema_version, spec, gateway, priority, deadline_at, max_records) with outcome and run_id; those that are created are stored. Raises where no mapping takes a type."""
        version = self.store.manifest()["version"]
        for r in requests.select("collection_type", "schema_version").distinct().limit(CLAIMS_MOST + 1).collect():
            self.registry.mapping(r.collection_type, r.schema_version)
        if requests.where("max_records = 0").limit(1).count():
            raise ValueError("max_records = 0 lets no run start")
        key = F.struct("collection_type", "schema_version")
        mapping = reduce(lambda rest, m: F.when(key.isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in sorted(m.types)]), m.key).otherwise(rest), self.registry.mappings.values(), F.lit(None).cast("string"))
        r = requests.withColumns({"mapping_key": mapping, "request_fingerprint": ids.fingerprint(**{c: F.col(c) for c in ("collection_type", "schema_version", "spec", "gateway")})})
        out = run_rules.submit(r, self.runs().select("scope_key", "idempotency_key", "request_fingerprint"))
        name = F.concat(F.lit("run_"), F.substring(ids.digest(ids.canonical_array(F.col("scope_key"), F.col("idempotency_key"))), 1, 32))
        out = Workspace(self.spark, "submit").save(out.withColumn("run_id", name), "out")
        at = F.lit(now).cast("timestamp")
        given = {"status": F.lit("queued"), "accepted_at": at, "updated_at": at, "next_wakeup_at": at, "received": F.lit(0), "processed": F.lit(0), "failed": F.lit(0), "changes": F.lit(0), "failures": F.lit(0), "cancel_requested": F.lit(False), "state_version": F.lit(1)}
        fields = [f.split() for f in RUN.split(", ")]
        self._commit({"runs": out.where("outcome = 'created'").select(*[(given[c] if c in given else F.col(c) if c in out.columns else F.lit(None)).cast(t).alias(c) for c, t in fields])}, version)
        return out.select("submitted_order", "run_id", "outcome")

    def cancel(self, run_id: str, scope_key: str, now: datetime) -> str:
        """The run's status after the request: one without a job is cancelled at once, one with a job in its next wake."""
        version, run = self.store.manifest()["version"], self.get(run_id, scope_key)
        if run["status"] in run_rules.TERMINAL:
            return run["status"]
        status = run["status"] if run["job_id"] else "cancelled"
        at = F.lit(now).cast("timestamp")
        row = self.spark.createDataFrame([run], RUN).withColumns({"cancel_requested": F.lit(True), "status": F.lit(status), "updated_at": at, "next_wakeup_at": at if run["job_id"] else F.lit(None).cast("timestamp"), "finished_at": F.lit(None).cast("timestamp") if run["job_id"] else at, "state_version": F.col("state_version") + 1})
        self._commit({"runs": row}, version)
        return status

    def recover(self, now: datetime) -> int:
        version = self.store.manifest()["version"]
        rows = Workspace(self.spark, "recover").save(recover(self.runs(), F.lit(now).cast("timestamp")), "runs")
        n = rows.count()
        if n:
            self._commit({"runs": rows}, version)
        return n

    def _claim(self, now: datetime, limit: int, ws: Workspace) -> DataFrame | None:
        """Due runs under a lease that is committed before anything is called."""
        version = self.store.manifest()["version"]
        all_, at = self.runs(), F.lit(now).cast("timestamp")
        busy = {f"active_{by}s": {r[col]: r.active for r in run_rules.active(all_, at, col).collect()} for by, col in (("scope", "scope_key"), ("gateway", "gateway")) if f"{by}_limits" in self.quotas}
        quotas = dict(self.quotas)
        if "global_limit" in quotas:
            quotas["global_limit"] = max(0, quotas["global_limit"] - run_rules.active(all_, at).first().active)
        order = run_rules.allocate(run_rules.runnable(all_, at), limit, **quotas, **busy).select("run_id", "claim_order")
        lease = F.lit(now + timedelta(seconds=self.retry.lease)).cast("timestamp")
        held = all_.join(F.broadcast(order), "run_id").withColumns({"lease_owner": F.lit(self.worker), "lease_until": lease, "state_version": F.col("state_version") + 1})
        held = ws.save(held, "claimed")
        if not held.limit(1).count():
            return None
        self._commit({"runs": held.drop("claim_order")}, version)
        return held

    def wake(self, now: datetime, limit: int = 10) -> dict:
        """Claims at most `limit` due runs, moves each on and stores all of it at once: inspected, progressed, completed, failed, deferred."""
        if not 1 <= limit <= CLAIMS_MOST:
            raise ValueError(f"limit must be from 1 to {CLAIMS_MOST}")
        ship(self.spark)
        ws, at = Workspace(self.spark, "wake"), F.lit(now).cast("timestamp")
        held = self._claim(now, limit, ws)
        if held is None:
            return dict.fromkeys(("inspected", "progressed", "completed", "failed", "deferred"), 0)
        version = self.store.manifest()["version"]
        called = ws.save(calls(held, self.gateways, at, self.retry.batches), "calls")
        ended = called.where("page is null").select("run_id", "result")
        known = held.join(F.broadcast(ended), "run_id")
        named = known.withColumn("gateway_key", F.coalesce("result.gateway_key", "gateway_key"))
        pinned = {(a, b): m.key for m in self.registry.mappings.values() for a, b in m.types}
        kept = reduce(lambda rest, x: F.when((F.col("collection_type") == x[0][0]) & (F.col("schema_version") == x[0][1]), F.col("mapping_key") == x[1]).otherwise(rest), pinned.items(), F.lit(False))
        ingests, documents = self.store.read("ingests"), self.store.read("documents")
        consumed = ws.save(consume(called, named, self.registry, version, ingests), "consumed")
        spoiled = consumed.where("error = 'CONFIGURATION_ERROR'").select("claim_order").distinct()
        good = consumed.join(F.broadcast(spoiled), "claim_order", "left_anti")
        decided = ws.save(policies.decide(good.where("outcome = 'created'"), self.registry, policies.latest_state(documents)), "decided")
        sums = tally(consumed, decided)
        judged = named.join(F.broadcast(sums), "claim_order", "left").withColumn("unsupported", F.coalesce("unsupported", F.lit(False)) | ~kept)
        after = ws.save(transition(judged, at, self.retry), "after")
        made = {
            "runs": after,
            "attempts": ended.select("run_id", F.posexplode("result.attempts").alias("nth", "a")).select("run_id", F.lit(version).alias("wake"), "nth", "a.*", at.alias("at")),
            "failures": good.where("outcome = 'failed'").select("run_id", "record_id", F.col("error").alias("code")).unionByName(decided.where("rejected").select("run_id", "record_id", F.lit("REJECTED").alias("code"))),
            "ingests": decided.where("not coalesce(rejected, false)").select(*history.INGEST, "fingerprint"),
            "events": history.change_events(decided),
            "snapshots": history.snapshots(decided),
            "documents": policies.state(decided, self.registry).withColumn("wake", F.lit(version)),
        }
        try:
            self._commit(made, version)
        except ConflictError:
            return {"inspected": held.count(), "progressed": 0, "completed": 0, "failed": 0, "deferred": 0}
        self._stop_limited(after, at)
        keys = ("status", "cursor", "processed", "failed")
        was = held.select("run_id", *[F.col(k).alias("was_" + k) for k in keys])
        moved = reduce(Column.__or__, [~F.col(k).eqNullSafe(F.col("was_" + k)) for k in keys])
        done = F.col("status").isin("completed", "completed_with_errors", "cancelled")
        row = after.join(F.broadcast(was), "run_id").agg(F.count("*").alias("inspected"), F.count_if(moved).alias("progressed"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed")).first().asDict()
        return row | {"deferred": row["inspected"] - row["completed"] - row["failed"]}

    def _stop_limited(self, after: DataFrame, at: Column) -> None:
        """Asks for the end of jobs whose runs are over by a limit; a failure of that is of no matter."""
        rows = after.where("error_code in ('RESULT_LIMIT_REACHED', 'DEADLINE_EXCEEDED') and job_id is not null").withColumns({"cancel_requested": F.lit(True), "deadline_at": F.lit(None).cast("timestamp")})
        calls(rows, self.gateways, at).write.format("noop").mode("overwrite").save()
