"""Outbox delivery: in-order claims, acknowledgement with fencing, and retry times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backoff(attempt: Column, base: float = 1.0, most: float = 300.0, retry_after: Column | None = None) -> Column:
    """Seconds until the next try: base doubled with each attempt, at most `most`, never less than what the peer asked for."""
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))
    return wait if retry_after is None else F.greatest(wait, F.coalesce(retry_after, F.lit(0.0)))


def claimable(outbox: DataFrame, now: Column) -> DataFrame:
    """Rows that may go out now: pending and due, or delivering under an expired lease; and no undelivered row of the same document before them. A blocked row holds back all that follow."""
    head = F.min(F.when(F.col("status") != "delivered", F.col("sequence"))).over(Window.partitionBy("scope_key", "document_id"))
    due = ((F.col("status") == "pending") & (F.col("next_attempt_at") <= now)) | ((F.col("status") == "delivering") & (F.col("lease_until") <= now))
    return outbox.withColumn("head", head).where(due & (F.col("sequence") == F.col("head"))).drop("head")


def claim(outbox: DataFrame, now: Column, worker: str, batch: int = 100, lease_seconds: int = 60) -> DataFrame:
    """The next batch with its lease: a top-k by creation time and id."""
    if not 1 <= batch <= 1000:
        raise ValueError("batch must be from 1 to 1000")
    rows = claimable(outbox, now).orderBy("created_at", "event_id").limit(batch)
    lease = (now.cast("double") + lease_seconds).cast("timestamp")
    return rows.withColumns({"status": F.lit("delivering"), "lease_owner": F.lit(worker), "lease_until": lease, "attempt_count": F.col("attempt_count") + 1, "state_version": F.col("state_version") + 1})


def settle(outbox: DataFrame, results: DataFrame, now: Column, max_attempts: int = 5, base: float = 1.0, most: float = 300.0) -> DataFrame:
    """The outbox after results (event_id, lease_owner, state_version, ok, code, message). A result counts only under the owner and version that claimed the row; a failed last attempt blocks it. Rows without a result stay as they are."""
    r = results.select(*[F.col(c).alias("r_" + c) for c in ("event_id", "lease_owner", "state_version", "ok", "code", "message")])
    same = (F.col("event_id") == F.col("r_event_id")) & (F.col("lease_owner") == F.col("r_lease_owner")) & (F.col("state_version") == F.col("r_state_version"))
    o = outbox.join(r, same & (F.col("status") == "delivering"), "left")
    hit = F.col("r_event_id").isNotNull()
    good, spent = hit & F.col("r_ok"), F.col("attempt_count") >= max_attempts
    clean = lambda c, n: F.substring(F.translate(F.coalesce(c, F.lit("")), "\r\n", "  "), 1, n)
    later = (now.cast("double") + backoff(F.col("attempt_count"), base, most)).cast("timestamp")
    kept = lambda c: F.col(c) if c in outbox.columns else F.lit(None).cast("timestamp")
    made = {
        "status": F.when(good, "delivered").when(hit & spent, "blocked").when(hit, "pending").otherwise(F.col("status")),
        "lease_owner": F.when(~hit, F.col("lease_owner")),
        "lease_until": F.when(~hit, F.col("lease_until")),
        "next_attempt_at": F.when(hit & ~good & ~spent, later).otherwise(F.col("next_attempt_at")),
        "state_version": F.when(hit, F.col("state_version") + 1).otherwise(F.col("state_version")),
        "last_error_code": F.when(good, F.lit(None)).when(hit, clean(F.col("r_code"), 64)).otherwise(F.col("last_error_code")),
        "last_error_message": F.when(good, F.lit(None)).when(hit, clean(F.col("r_message"), 500)).otherwise(F.col("last_error_message")),
        "delivered_at": F.when(good, now).otherwise(kept("delivered_at")),
        "updated_at": F.when(hit, now).otherwise(kept("updated_at")),
    }
    return o.select(*[c for c in outbox.columns if c not in made], *[v.alias(c) for c, v in made.items()])


def replace_rows(outbox: DataFrame, changed: DataFrame) -> DataFrame:
    """The outbox with changed rows in the place of those of the same event."""
    return outbox.join(changed.select("event_id"), "event_id", "left_anti").select(*outbox.columns).unionByName(changed.select(*outbox.columns))


def summary(claimed: DataFrame, settled: DataFrame) -> DataFrame:
    """claimed, delivered, retried, blocked of one dispatch."""
    done = settled.join(claimed.select("event_id"), "event_id", "left_semi")
    return done.agg(F.count("*").alias("claimed"), F.count_if(F.col("status") == "delivered").alias("delivered"), F.count_if(F.col("status") == "pending").alias("retried"), F.count_if(F.col("status") == "blocked").alias("blocked"))


def enqueue(outbox: DataFrame | None, events: DataFrame, now: Column) -> DataFrame:
    """The outbox with a pending row for each event that it does not hold; an event that is there already keeps its state, so a batch that is run again adds nothing."""
    none = F.lit(None).cast("string")
    new = events.select(
        "scope_key", "document_id", "event_id", "sequence", F.lit("pending").alias("status"), F.col("event_order").alias("created_at"), now.alias("next_attempt_at"), none.alias("lease_owner"), none.cast("timestamp").alias("lease_until"),
        F.lit(0).cast("long").alias("attempt_count"), F.lit(1).cast("long").alias("state_version"), none.alias("last_error_code"), none.alias("last_error_message"), none.cast("timestamp").alias("delivered_at"), now.alias("updated_at"),
    )
    if outbox is None:
        return new
    return outbox.unionByName(new.join(outbox.select("event_id"), "event_id", "left_anti").select(*new.columns), allowMissingColumns=True)
