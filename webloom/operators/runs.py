"""Runs: idempotent submission, fair allocation, quotas, result limits, summaries and status."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "completed_with_errors", "failed", "cancelled")


def submit(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Outcome of each request by (scope_key, idempotency_key): created, existing, or conflict if its fingerprint differs."""
    line = Window.partitionBy("scope_key", "idempotency_key").orderBy("submitted_order")
    first = requests.withColumn("known", F.first("request_fingerprint").over(line)).withColumn("nth", F.row_number().over(line))
    stored = runs.select("scope_key", "idempotency_key", F.col("request_fingerprint").alias("stored"))
    j = first.join(stored, ["scope_key", "idempotency_key"], "left")
    known = F.coalesce("stored", "known")
    outcome = F.when(known != F.col("request_fingerprint"), "conflict").when(F.col("stored").isNotNull() | (F.col("nth") > 1), "existing").otherwise("created")
    return j.withColumn("outcome", outcome).drop("known", "nth", "stored")


def runnable(runs: DataFrame, now: Column) -> DataFrame:
    """Not finished, due, and under no live lease."""
    due = F.coalesce(F.col("next_wakeup_at") <= now, F.lit(True))
    free = F.coalesce(F.col("lease_until") <= now, F.lit(True))
    return runs.where(~F.col("status").isin(*TERMINAL) & due & free)


def active(runs: DataFrame, now: Column, by: str | None = None) -> DataFrame:
    live = runs.where(F.col("lease_until") > now)
    return live.agg(F.count("*").alias("active")) if by is None else live.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("active"))


def round_robin(candidates: DataFrame, after_scope: str | None = None) -> DataFrame:
    """Allocation order without quotas: rounds over the scopes, those past the last served one first; inside a scope by priority, acceptance and id."""
    inside = Window.partitionBy("scope_key").orderBy(F.desc("priority"), "accepted_at", "run_id")
    wrapped = F.col("scope_key") <= F.lit(after_scope) if after_scope is not None else F.lit(False)
    return candidates.withColumn("round", F.row_number().over(inside)).withColumn("wrapped", wrapped).orderBy("round", "wrapped", "scope_key").drop("wrapped")


def allocate(candidates: DataFrame, limit: int, global_limit: int | None = None, scope_limits: dict | None = None, gateway_limits: dict | None = None, active_scopes: dict | None = None, active_gateways: dict | None = None, after_scope: str | None = None) -> DataFrame:
    """Claims under quotas, one after the other, so that a scope whose quota is spent, or a run whose gateway is full, is passed over and not waited for.

    Order decides, so the claim itself is one sequential pass. What it has to see is bounded first: whichever gateways are full, the first `limit` runs of each (scope, gateway) hold every claim. And every scope before another one that still has runs of an open gateway claims one in the first round, so of the scopes with runs of a gateway only the first `limit` in rotation count, those whose quota is spent left out. That is limit * limit runs for each gateway.
    """
    wrapped = (F.col("scope_key") <= F.lit(after_scope)) if after_scope is not None else F.lit(False)
    order = (F.desc("priority"), F.col("accepted_at"), F.col("run_id"))
    c = candidates.withColumn("wrapped", wrapped)
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy("scope_key", "gateway").orderBy(*order))).where(F.col("nth") <= limit)
    busy = {**{k: 0 for k in scope_limits or {}}, **(active_scopes or {})}
    spent = [k for k, n in busy.items() if k != "*" and n >= (scope_limits or {}).get(k, (scope_limits or {}).get("*", 1 << 30))]
    c = c.where(~F.col("scope_key").isin(*spent)) if spent else c
    line = Window.partitionBy("gateway").orderBy("wrapped", "scope_key")
    near = c.select("gateway", "wrapped", "scope_key").distinct().withColumn("place", F.row_number().over(line)).where(F.col("place") <= limit).select("scope_key", F.col("gateway").alias("g"))
    c = c.alias("c").join(near.alias("n"), (F.col("c.scope_key") == F.col("n.scope_key")) & F.col("c.gateway").eqNullSafe(F.col("n.g")), "left_semi")
    kind = "scope_key string, run_id string, gateway string, claim_order int"
    room = min(limit, global_limit if global_limit is not None else limit)
    scope_limits, gateway_limits = dict(scope_limits or {}), dict(gateway_limits or {})
    scopes, gateways = dict(active_scopes or {}), dict(active_gateways or {})

    def greedy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queues: dict[tuple, list] = {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                queues.setdefault((r.wrapped, r.scope_key), []).append((-r.priority, r.accepted_at, r.run_id, r.gateway))
        for q in queues.values():
            q.sort()
        in_scope, in_gateway, out = dict(scopes), dict(gateways), []
        ring = sorted(queues)
        progress = True
        while progress and len(out) < room:
            progress = False
            for key in ring:
                if len(out) >= room:
                    break
                scope = key[1]
                if in_scope.get(scope, 0) >= scope_limits.get(scope, scope_limits.get("*", 1 << 30)):
                    continue
                for k, (_, _, run_id, gateway) in enumerate(queues[key]):
                    if gateway is not None and in_gateway.get(gateway, 0) >= gateway_limits.get(gateway, 1 << 30):
                        continue
                    del queues[key][k]
                    in_scope[scope] = in_scope.get(scope, 0) + 1
                    if gateway is not None:
                        in_gateway[gateway] = in_gateway.get(gateway, 0) + 1
                    out.append((scope, run_id, gateway, len(out) + 1))
                    progress = True
                    break
        yield pd.DataFrame(out, columns=["scope_key", "run_id", "gateway", "claim_order"])

    slim = c.select("wrapped", "scope_key", "priority", F.unix_micros(F.col("accepted_at").cast("timestamp")).alias("accepted_at"), "run_id", "gateway")
    return slim.repartition(1).mapInPandas(greedy, kind)  # both bounds hold before this one task


def save_fenced(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Outcome of each changed run: saved if its state_version is the stored one, else stale."""
    s = stored.select("run_id", F.col("state_version").alias("now"))
    return changed.join(s, "run_id", "left").withColumn("outcome", F.when(F.col("now") == F.col("state_version"), "saved").otherwise("stale")).drop("now")


def cap_results(records: DataFrame, most: int) -> DataFrame:
    """Records of each run up to its limit, counted before any dedup; the one after it marks the run as limited."""
    line = Window.partitionBy("run_id").orderBy("record_order")
    r = records.withColumn("nth", F.row_number().over(line))
    n = F.count("*").over(Window.partitionBy("run_id"))
    return r.withColumn("limited", n > most).where(F.col("nth") <= most)


def summarise(outcomes: DataFrame) -> DataFrame:
    """Counters of each run over outcome: created, duplicate, failed."""
    return outcomes.groupBy("run_id").agg(
        F.count("*").alias("received"),
        F.count_if(F.col("outcome") == "created").alias("processed"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.count_if(F.col("outcome").isin("failed", "conflict")).alias("failed"),
    ).withColumn("status", F.when(F.col("failed") > 0, "completed_with_errors").otherwise("completed"))
