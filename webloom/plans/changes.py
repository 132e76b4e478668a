"""Queries over observations, outbox and runs, each with its SQL.

Events play observations (user_id is the subject, event_id the arrival order, an `error` an absence), orders play runs, conversations play the records of a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import ids
from webloom.operators import delivery, engine, history, policies, runs

STAMP, SQL_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"
OUTBOX_NOW = "2024-01-15 00:00:00"
RUNS_NOW = "1998-01-01 00:00:00"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope_key, subject_key, arrival, present, content_hash, observed_at."""
    present = F.coalesce(F.col("event_type"), F.lit("")) != "error"
    content = F.sha2(F.floor(F.coalesce("value", F.lit(0.0))).cast("string"), 256)
    return _table(spark, sf_dir, "events").select(
        F.concat(F.lit("scope-"), F.pmod("user_id", F.lit(4)).cast("string")).alias("scope_key"),
        F.col("user_id").cast("string").alias("subject_key"),
        F.col("event_id").alias("arrival"),
        present.alias("present"),
        F.when(present, content).alias("content_hash"),
        F.col("ts").alias("observed_at"),
    )


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.decide(observations(spark, sf_dir))


_LINE = "(partition by scope_key, subject_key order by arrival)"
_UPTO = "(partition by scope_key, subject_key order by arrival rows unbounded preceding)"
_DECIDED = f"""
obs as (select event_id as arrival, 'scope-' || (user_id % 4) as scope_key, user_id::varchar as subject_key, coalesce(event_type, '') <> 'error' as present,
  case when coalesce(event_type, '') <> 'error' then sha256(floor(coalesce(value, 0))::bigint::varchar) end as content_hash, ts as observed_at from events),
numbered as (select *, row_number() over {_LINE} as nth from obs),
begun as (select *, min(case when present then nth end) over {_UPTO} as first_present from numbered),
judged as (select *, present and first_present > 2 as rejected, present and first_present <= 2 as good from begun),
islands as (select *, count(*) filter (where good) over {_UPTO} as island from judged),
streaks as (select *, case when good then 0 else count(*) filter (where not present) over (partition by scope_key, subject_key, island order by arrival rows unbounded preceding) end as streak from islands),
seen as (select *, coalesce(lag(streak) over {_LINE}, 0) as before, last_value(case when good then content_hash end ignore nulls) over (partition by scope_key, subject_key order by arrival rows between unbounded preceding and 1 preceding) as last_hash from streaks),
kinds as (select *, case when rejected then null when not present and streak >= 2 then 'missing_confirmed' when not present then 'missing_suspected'
  when last_hash is null then 'first_seen' when before >= 2 then 'restored' when content_hash is distinct from last_hash then 'revised' end as kind from seen),
made as (select *, coalesce(good and kind in ('first_seen', 'revised', 'restored') and content_hash is distinct from last_hash, false) as made_snapshot,
  case when rejected then null when present then 'present' when streak >= 2 then 'missing_confirmed' else 'missing_suspected' end as state,
  'doc_' || substr(sha256('{{"identity_version":"1.0","key":"' || subject_key || '","namespace":"subject","scope_key":"' || scope_key || '"}}'), 1, 32) as document_id from kinds),
decided as (select *, count(kind) over {_UPTO} as sequence, count(*) filter (where made_snapshot) over {_UPTO} as revision from made),
changes as (select scope_key, subject_key, document_id, 'evt_' || substr(sha256('["' || document_id || '","' || sequence || '"]'), 1, 32) as event_id, sequence, kind,
  case when revision > made_snapshot::int then revision - made_snapshot::int end::bigint as from_revision, case when present then revision end as to_revision, arrival as event_order, observed_at as effective_observed_at
  from decided where kind is not null)
"""


@query(f"with {_DECIDED} select * replace (strftime(effective_observed_at, '{SQL_STAMP}') as effective_observed_at) from changes")
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change event with its snapshots before and after."""
    return history.change_events(_decided(spark, sf_dir)).withColumn("effective_observed_at", F.date_format("effective_observed_at", STAMP))


@query(f"with {_DECIDED} select scope_key, kind, count(*) as n from changes group by all")
def change_counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.change_events(_decided(spark, sf_dir)).groupBy("scope_key", "kind").agg(F.count("*").alias("n"))


@query(
    f"""with {_DECIDED} select scope_key, subject_key, arg_max(state, arrival) as state, arg_max(streak, arrival)::bigint as missing_streak, max(revision) as revision, max(sequence) as sequence,
  strftime(arg_min(observed_at, arrival), '{SQL_STAMP}') as first_observed_at, strftime(max(observed_at), '{SQL_STAMP}') as last_observed_at from decided where not rejected group by all"""
)
def documents_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current state of every document."""
    d = history.documents(_decided(spark, sf_dir))
    return d.withColumns({c: F.date_format(c, STAMP) for c in ("first_observed_at", "last_observed_at")})


def _in_two_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The observations' first half decided, the state after it, and the second half decided from that state."""
    rows = observations(spark, sf_dir)
    middle = (rows.agg(F.max("arrival")).first()[0] or 0) // 2
    first = history.decide(rows.where(F.col("arrival") <= middle))
    stored = history.state(first)
    return first, stored, history.decide(rows.where(F.col("arrival") > middle), stored=stored)


@query(ORACLE_SQL["change_events"])
def history_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of two batches, the second from the stored state of the first; the same as of a full replay."""
    first, _, second = _in_two_batches(spark, sf_dir)
    events = history.change_events(first).unionByName(history.change_events(second))
    return events.withColumn("effective_observed_at", F.date_format("effective_observed_at", STAMP))


@query(ORACLE_SQL["documents_current"])
def documents_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every document after two batches."""
    _, stored, second = _in_two_batches(spark, sf_dir)
    d = history.documents(second, stored)
    return d.withColumns({c: F.date_format(c, STAMP) for c in ("first_observed_at", "last_observed_at")})


@query(
    f"""with {_DECIDED} select scope_key, subject_key, document_id, 'snap_' || substr(sha256('["' || document_id || '","' || revision || '"]'), 1, 32) as snapshot_id, revision, content_hash,
  strftime(observed_at, '{SQL_STAMP}') as observed_at, arrival as recorded_order from decided where made_snapshot"""
)
def snapshots_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Immutable snapshots with dense revisions."""
    return history.snapshots(_decided(spark, sf_dir)).withColumn("observed_at", F.date_format("observed_at", STAMP))


@query(f"with {_DECIDED} select subject_key, arrival, present, streak::bigint as streak, rejected, state from decided")
def missing_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absences in a row after each observation, and the rows that are rejected."""
    return _decided(spark, sf_dir).select("subject_key", "arrival", "present", F.col("streak").cast("long").alias("streak"), "rejected", "state")


@query(
    f"""with {_DECIDED}, page as (select * from changes where scope_key = 'scope-1' and kind in ('revised', 'restored') and effective_observed_at > '2024-01-03' and effective_observed_at < '2024-01-25' order by event_order limit 101)
select document_id, event_id, kind, event_order, case when (select count(*) from page) > 100 then (select to_base64(encode(max(event_order)::varchar)) from (select event_order from page order by event_order limit 100)) end as next_cursor
from page order by event_order limit 100"""
)
def change_query_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of filtered changes and the cursor to go on from."""
    events = history.change_events(_decided(spark, sf_dir))
    page = history.query_changes(events, limit=100, scope="scope-1", kinds=("revised", "restored"), after="2024-01-03", before="2024-01-25")
    return page.select("document_id", "event_id", "kind", "event_order", "next_cursor")


@query(
    f"""with {_DECIDED}, e as (select document_id, count(*) as n_events, string_agg(kind, ',' order by sequence) as kinds from changes group by 1),
s as (select document_id, count(*) as n_snapshots, string_agg(content_hash, ',' order by revision) as hashes from decided where made_snapshot group by 1)
select document_id, n_events, kinds, coalesce(n_snapshots, 0) as n_snapshots, coalesce(sha256(hashes), '') as snapshots_sha256 from e left join s using (document_id)"""
)
def timeline_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's events and snapshots in order, flattened for comparison."""
    d = _decided(spark, sf_dir)
    t = history.timeline(history.change_events(d), history.snapshots(d))
    return t.select(
        "document_id",
        F.size("events").cast("long").alias("n_events"),
        F.array_join(F.transform("events", lambda e: e["kind"]), ",").alias("kinds"),
        F.coalesce(F.size("snapshots"), F.lit(0)).cast("long").alias("n_snapshots"),
        F.coalesce(F.sha2(F.array_join(F.transform("snapshots", lambda s: s["content_hash"]), ","), 256), F.lit("")).alias("snapshots_sha256"),
    )


def registry() -> policies.Registry:
    """Events are followed by user and by whole value, orders by their key and status."""
    made = policies.Registry()
    at = lambda path: lambda text: F.get_json_object(text, path)
    made.add(policies.Policy("event-value", frozenset({("event.value", "1.0")}), "user", at("$.key"), at("$.amount")))
    made.add(policies.Policy("order-status", frozenset({("order.status", "1.0"), ("order.status", "1.1")}), "order", at("$.order"), at("$.status"), missing_after=3))
    none = F.lit(None).cast("string")

    def draft(rows: DataFrame, name: str, version: Column, key: Column, label: str, present: Column, attempt: Column, **content: Column) -> DataFrame:
        return rows.select(
            F.lit(name).alias("gateway_key"), F.col("id").cast("string").alias("record_id"), F.col("id").alias("arrival"), F.lit(name).alias("content_type_key"), version.alias("content_schema_version"), F.col("at").alias("observed_at"), present.alias("present"),
            F.when(present, ids.canonical_struct(**content)).alias("content"), ids.canonical_struct(**{label: key}).alias("identity"), attempt.alias("attempt_ref"), F.lit(None).cast("timestamp").alias("published_at"),
        )

    def event(e: DataFrame) -> DataFrame:
        e = e.withColumn("id", F.col("event_id")).withColumn("at", F.col("ts"))
        amount = F.floor(F.coalesce("value", F.lit(0.0))).cast("long")
        return draft(e, "event.value", F.lit("1.0"), F.col("user_id").cast("string"), "key", F.coalesce("event_type", F.lit("")) != "error", none, amount=amount, volatile=F.col("event_type"))

    def order(o: DataFrame) -> DataFrame:
        o = o.withColumn("id", F.col("o_orderkey")).withColumn("at", F.col("o_orderdate"))
        version = F.when(F.col("o_orderpriority").startswith("1"), "9.9").otherwise("1.1")
        return draft(o, "order.status", version, F.col("id").cast("string"), "order", F.col("o_orderstatus") != "P", F.concat(F.lit("own-"), F.col("id").cast("string")), status=F.col("o_orderstatus"))

    made.add(policies.Mapping("events", frozenset({("events", "1.0")}), event))
    made.add(policies.Mapping("orders", frozenset({("orders", "1.0")}), order))
    return made


@query(
    """select 'event.value' as gateway_key, event_id::varchar as record_id, 'event-value' as policy_ref, 'user' as namespace, user_id::varchar as subject_key, coalesce(event_type, '') <> 'error' as present,
  case when coalesce(event_type, '') <> 'error' then sha256(floor(coalesce(value, 0))::bigint::varchar) end as content_hash, 'attempt-1' as attempt_ref, case when user_id is null then 'INVALID_DRAFT' end as error from events
union all select 'order.status', o_orderkey::varchar, case when own then 'order-status' end, case when own then 'order' end, case when own then o_orderkey::varchar end, o_orderstatus <> 'P',
  case when own and o_orderstatus <> 'P' then sha256(o_orderstatus) end, 'own-' || o_orderkey, case when not own then 'CONFIGURATION_ERROR' end from (select *, not starts_with(o_orderpriority, '1') as own from orders)"""
)
def policy_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of two collections as observations, by mappings and policies; urgent orders have a version that no policy claims."""
    known = registry()
    rows = policies.drafts(_table(spark, sf_dir, "events"), known, "events").unionByName(policies.drafts(_table(spark, sf_dir, "orders"), known, "orders"))
    seen = policies.observe(rows, known, F.lit("scope-0"), F.lit("attempt-1"))
    return seen.select("gateway_key", "record_id", "policy_ref", "namespace", "subject_key", "present", "content_hash", "attempt_ref", "error")


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, a seventh of them once more, and an eleventh with another value."""
    e = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("scope-"), F.pmod("user_id", F.lit(4)).cast("string")).alias("scope_key"), F.coalesce("event_type", F.lit("")).alias("event_type"), F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("amount"))
    again = e.where("event_id % 7 = 0").withColumn("arrival", F.col("event_id") + 10**12)
    other = e.where("event_id % 11 = 0").withColumn("amount", F.col("amount") + 1).withColumn("arrival", F.col("event_id") + 2 * 10**12)
    rows = e.withColumn("arrival", F.col("event_id")).unionByName(again).unionByName(other)
    print_ = ids.fingerprint(amount=F.col("amount").cast("string"), event_type=F.col("event_type"))
    return rows.select("scope_key", F.lit("events").alias("gateway_key"), F.col("event_id").cast("string").alias("record_id"), "arrival", print_.alias("fingerprint"))


_ADMITTED = """
e as (select event_id, 'scope-' || (user_id % 4) as scope_key, coalesce(event_type, '') as event_type, floor(coalesce(value, 0))::bigint as amount from events),
rows as (select *, event_id as arrival from e union all select *, event_id + 1000000000000 from e where event_id % 7 = 0 union all select event_id, scope_key, event_type, amount + 1, event_id + 2000000000000 from e where event_id % 11 = 0),
printed as (select scope_key, event_id::varchar as record_id, arrival, sha256('{"amount":"' || amount || '","event_type":"' || event_type || '"}') as fingerprint from rows),
known as (select *, first_value(fingerprint) over w as known, row_number() over w as nth from printed window w as (partition by scope_key, record_id order by arrival)),
admitted as (select scope_key, record_id, arrival, fingerprint, case when known <> fingerprint then 'conflict' when nth > 1 then 'duplicate' else 'created' end as outcome from known)
"""


@query(f"with {_ADMITTED} select * from admitted")
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as created, duplicate or conflict."""
    return history.admit(_replayed(spark, sf_dir)).drop("gateway_key")


@query(f"with {_ADMITTED} select scope_key, outcome, count(*) as n from admitted group by all")
def ingest_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.admit(_replayed(spark, sf_dir)).groupBy("scope_key", "outcome").agg(F.count("*").alias("n"))


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' outbox, in a mixed state: some delivered, some under a lease, a few blocked."""
    e = history.change_events(_decided(spark, sf_dir))
    die = F.pmod(F.col("event_order") * 7919, F.lit(100))
    at = F.col("effective_observed_at").cast("timestamp")
    status = F.when(die < 60, "delivered").when(die < 70, "delivering").when(die == 99, "blocked").otherwise("pending")
    none = F.lit(None).cast("string")
    return e.select(
        "scope_key", "document_id", "event_id", "sequence", status.alias("status"), F.col("event_order").alias("created_at"), at.alias("next_attempt_at"), F.when(status == "delivering", F.lit("w0")).alias("lease_owner"),
        F.when(status == "delivering", at).alias("lease_until"), F.pmod("event_order", F.lit(5)).cast("long").alias("attempt_count"), F.lit(1).cast("long").alias("state_version"),
        F.when(die >= 60, F.concat(F.lit("E"), (die % 7).cast("string"))).alias("last_error_code"), F.when(die >= 60, "an earlier failure").otherwise(none).alias("last_error_message"), F.when(die < 60, at).alias("delivered_at"), at.alias("updated_at"),
    )


_OUTBOX = f"""{_DECIDED},
outbox as (select scope_key, document_id, event_id, sequence, case when d < 60 then 'delivered' when d < 70 then 'delivering' when d = 99 then 'blocked' else 'pending' end as status, event_order as created_at,
  effective_observed_at as due, event_order % 5 as attempt_count, 1::bigint as state_version, case when d >= 60 then 'E' || (d % 7) end as last_error_code, case when d >= 60 then 'an earlier failure' end as last_error_message, case when d < 60 then effective_observed_at end as delivered_at from (select *, (event_order * 7919) % 100 as d from changes)),
heads as (select *, min(case when status <> 'delivered' then sequence end) over (partition by scope_key, document_id) as head from outbox),
claimable as (select * from heads where status in ('pending', 'delivering') and due <= '{OUTBOX_NOW}' and sequence = head),
claimed as (select * replace (attempt_count + 1 as attempt_count, state_version + 1 as state_version) from (select * from claimable order by created_at, event_id limit 60)),
settled as (select *, case when sequence % 2 = 0 then 'delivered' when attempt_count >= 5 then 'blocked' else 'pending' end as new_status from claimed)
"""


def _now(text: str):
    return F.lit(text).cast("timestamp")


@query(f"with {_OUTBOX} select event_id, document_id, sequence, status from claimable")
def outbox_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due rows without an undelivered row of their document before them."""
    return delivery.claimable(outbox(spark, sf_dir), _now(OUTBOX_NOW)).select("event_id", "document_id", "sequence", "status")


@query(f"with {_OUTBOX} select event_id, attempt_count, state_version, 'w1' as lease_owner, '2024-01-15 00:01:00' as lease_until from claimed")
def outbox_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of 60 under a lease, by creation order."""
    rows = delivery.claim(outbox(spark, sf_dir), _now(OUTBOX_NOW), "w1", batch=60)
    return rows.select("event_id", "attempt_count", "state_version", "lease_owner", F.date_format("lease_until", "yyyy-MM-dd HH:mm:ss").alias("lease_until"))


def _settled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The claimed rows, and the whole outbox after their results."""
    now = _now(OUTBOX_NOW)
    box = outbox(spark, sf_dir)
    claimed = delivery.claim(box, now, "w1", batch=60)
    results = claimed.select("event_id", "lease_owner", "state_version", (F.col("sequence") % 2 == 0).alias("ok"), F.lit("UNREACHABLE").alias("code"), F.lit("no\nanswer").alias("message"))
    return claimed, delivery.settle(delivery.replace_rows(box, claimed), results, now)


@query(
    f"""with {_OUTBOX}, s as (select event_id, new_status, attempt_count, state_version from settled)
select o.event_id, coalesce(new_status, o.status) as status, coalesce(s.state_version + 1, o.state_version) as state_version,
  case when new_status = 'delivered' then null when new_status is not null then 'UNREACHABLE' else last_error_code end as last_error_code, case when new_status = 'delivered' then null when new_status is not null then 'no answer' else last_error_message end as last_error_message,
  strftime(case when new_status = 'pending' then timestamp '{OUTBOX_NOW}' + to_seconds(least(2 ** (s.attempt_count - 1), 300)::int) else due end, '{SQL_STAMP}') as next_attempt_at,
  strftime(case when new_status = 'delivered' then timestamp '{OUTBOX_NOW}' else delivered_at end, '{SQL_STAMP}') as delivered_at, strftime(case when new_status is not null then timestamp '{OUTBOX_NOW}' else due end, '{SQL_STAMP}') as updated_at
from outbox o left join s using (event_id)"""
)
def outbox_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole outbox after the results of a claim; rows without one keep what they had."""
    _, s = _settled(spark, sf_dir)
    return s.select("event_id", "status", "state_version", "last_error_code", "last_error_message", *[F.date_format(c, STAMP).alias(c) for c in ("next_attempt_at", "delivered_at", "updated_at")])


@query(
    f"""with {_DECIDED} select event_id, case when event_order % 3 = 0 then 'delivered' else 'pending' end as status, case when event_order % 3 = 0 then 2 else 1 end::bigint as state_version from changes"""
)
def outbox_enqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events put into an outbox that holds a third of them, delivered."""
    events = history.change_events(_decided(spark, sf_dir))
    at = F.col("effective_observed_at").cast("timestamp")
    held = delivery.enqueue(None, events.where("event_order % 3 = 0"), at).withColumns({"status": F.lit("delivered"), "state_version": F.lit(2).cast("long")})
    return delivery.enqueue(held, events, at).select("event_id", "status", "state_version")


@query(f"with {_OUTBOX} select count(*) as claimed, count(*) filter (where new_status = 'delivered') as delivered, count(*) filter (where new_status = 'pending') as retried, count(*) filter (where new_status = 'blocked') as blocked from settled")
def dispatch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O04, A13."""
    claimed, settled = _settled(spark, sf_dir)
    return delivery.summary(claimed, settled)


@query("select event_id, greatest(least(2.0::double ** (event_id % 12), 300.0::double), coalesce(case when event_id % 3 = 0 then (event_id % 50)::double end, 0.0::double)) as wait_seconds from events")
def outbox_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds before each retry."""
    e = _table(spark, sf_dir, "events")
    asked = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 50).cast("double"))
    return e.select("event_id", delivery.backoff(F.col("event_id") % 12 + 1, retry_after=asked).alias("wait_seconds"))


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs."""
    key = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(
        key.alias("order_key"),
        F.concat(F.lit("scope-"), F.pmod("o_custkey", F.lit(8)).cast("string")).alias("scope_key"),
        F.concat(F.lit("run-"), key.cast("string")).alias("run_id"),
        (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.col("o_orderdate").alias("accepted_at"),
        F.col("o_orderstatus").alias("gateway"),
        F.when(key % 3 == 0, F.col("o_orderdate")).alias("lease_until"),
        F.when(key % 4 == 0, F.col("o_orderdate")).alias("next_wakeup_at"),
        F.when(key % 19 == 0, "cancelled").otherwise("queued").alias("status"),
    )


_RUNS = """runs as (select o_orderkey as order_key, 'scope-' || (o_custkey % 8) as scope_key, 'run-' || o_orderkey as run_id, 5 - substr(o_orderpriority, 1, 1)::int as priority, o_orderdate as accepted_at, o_orderstatus as gateway,
  case when o_orderkey % 3 = 0 then o_orderdate end as lease_until, case when o_orderkey % 4 = 0 then o_orderdate end as next_wakeup_at, case when o_orderkey % 19 = 0 then 'cancelled' else 'queued' end as status from orders)"""
_RUNNABLE = f"""{_RUNS}, runnable as (select * from runs where status <> 'cancelled' and coalesce(next_wakeup_at <= timestamp '{RUNS_NOW}', true) and coalesce(lease_until <= timestamp '{RUNS_NOW}', true))"""


@query(f"with {_RUNNABLE} select row_number() over (partition by scope_key order by priority desc, accepted_at, run_id)::bigint as round, scope_key, run_id, priority from runnable")
def run_allocation_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds over the scopes, past the last served one first."""
    r = runs.round_robin(runs.runnable(run_table(spark, sf_dir), _now(RUNS_NOW)), after_scope="scope-3")
    return r.select(F.col("round").cast("long").alias("round"), "scope_key", "run_id", "priority")


@query()
def run_allocation_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150 claims under scope and gateway quotas; sequential by nature, tested against brute force."""
    rows = runs.runnable(run_table(spark, sf_dir), _now(RUNS_NOW))
    return runs.allocate(rows, limit=150, global_limit=150, scope_limits={"*": 25, "scope-2": 5}, gateway_limits={"O": 40, "F": 60}, after_scope="scope-3")


@query(f"with {_RUNS}, live as (select * from runs where lease_until > timestamp '{RUNS_NOW}') select 'scope' as by, scope_key as name, count(*) as active from live group by 2 union all select 'gateway', gateway, count(*) from live where gateway is not null group by 2 union all select 'all', 'all', count(*) from live")
def run_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live leases in all, by scope and by gateway."""
    r, now = run_table(spark, sf_dir), _now(RUNS_NOW)
    part = lambda by: runs.active(r, now, by).select(F.lit(by.split("_")[0]).alias("by"), F.col(by).alias("name"), "active")
    return part("scope_key").unionByName(part("gateway")).unionByName(runs.active(r, now).select(F.lit("all").alias("by"), F.lit("all").alias("name"), "active"))


_SUBMITTED = """requests as (select o_orderkey as submitted_order, 'scope-' || (o_custkey % 8) as scope_key, 'k' || (o_orderkey % 5000) as idempotency_key, sha256('{"gateway":"' || o_orderstatus || '"}') as request_fingerprint from orders),
stored as (select scope_key, idempotency_key, arg_min(request_fingerprint, submitted_order) as stored from requests where submitted_order < 1000 group by all)"""


@query(
    f"""with {_SUBMITTED}, later as (select *, first_value(request_fingerprint) over w as known, row_number() over w as nth from requests where submitted_order >= 1000 window w as (partition by scope_key, idempotency_key order by submitted_order))
select submitted_order, scope_key, idempotency_key, case when coalesce(stored, known) <> request_fingerprint then 'conflict' when stored is not null or nth > 1 then 'existing' else 'created' end as outcome
from later left join stored using (scope_key, idempotency_key)"""
)
def run_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idempotent submission against stored runs and within the batch."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("submitted_order"), F.concat(F.lit("scope-"), F.pmod("o_custkey", F.lit(8)).cast("string")).alias("scope_key"), F.concat(F.lit("k"), F.pmod("o_orderkey", F.lit(5000)).cast("string")).alias("idempotency_key"), ids.fingerprint(gateway=F.col("o_orderstatus")).alias("request_fingerprint"))
    stored = o.where("submitted_order < 1000").groupBy("scope_key", "idempotency_key").agg(F.min_by("request_fingerprint", "submitted_order").alias("request_fingerprint"))
    return runs.submit(o.where("submitted_order >= 1000"), stored).select("submitted_order", "scope_key", "idempotency_key", "outcome")


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs after their calls: some past their deadline, with a cancel request, over their limit, with failed calls, with records nobody takes."""
    key = F.col("order_key")
    r = run_table(spark, sf_dir)
    given = {
        "job_id": F.when(key % 13 > 0, "job"), "cancel_requested": key % 17 == 0, "deadline_at": F.when(key % 5 == 0, F.col("accepted_at")), "limited": key % 23 == 0, "unsupported": key % 29 == 0, "failures": F.lit(0), "processed": key % 10, "failed": F.lit(0), "changes": F.lit(2), "received": F.lit(4),
        "cursor": F.lit("4"), "n_new": key % 6, "n_failed": (key % 3 == 2).cast("int"), "n_changes": F.lit(1), "state_version": F.lit(1), "status": F.when(key % 19 == 0, "cancelled").when(key % 2 == 0, "running").otherwise("queued"), "started_at": F.when(key % 2 == 0, F.col("accepted_at")),
    }
    state = F.element_at(F.array(*[F.lit(x) for x in ("completed", "running", "failed", "completed", "completed_with_errors", "cancelled", "completed")]), (key % 7 + 1).cast("int"))
    broken = key % 11 == 0
    result = F.struct(
        F.lit("g").alias("gateway_key"), F.lit("job").alias("job_id"), F.lit("9").alias("cursor"), F.lit(9).cast("long").alias("received"), F.when(~broken, state).alias("state"), (~broken & (key % 8 > 0)).alias("drained"), F.lit(False).alias("cancelled"), F.when(broken, key % 4 + 1).otherwise(0).cast("int").alias("failures"),
        F.when(broken, "BUSY").alias("error_code"), F.when(broken, "try later").alias("error_message"), (key % 3 > 0).alias("retryable"), F.when(key % 6 == 0, 30.0).alias("retry_after"),
    )
    fields = [f.split() for f in engine.RUN.split(", ")]
    r = r.withColumns(given)
    r = r.withColumns({c: (F.col(c) if c in r.columns else F.lit(None)).cast(t) for c, t in fields})
    return r.withColumn("result", F.when(key % 5 > 0, result))


_CALLED = """called as (select o_orderkey as k, case when k % 19 = 0 then 'cancelled' when k % 2 = 0 then 'running' else 'queued' end as was, coalesce(k % 5 = 0 and o_orderdate <= timestamp '1996-01-01', false) as stop, k % 17 = 0 and k % 13 = 0 as cancelled, k % 29 = 0 as unsupported,
  k % 5 > 0 as answered, ['completed', 'running', 'failed', 'completed', 'completed_with_errors', 'cancelled', 'completed'][k % 7 + 1] as state, k % 8 > 0 as drained, answered and k % 11 = 0 as broken, (k % 3 = 2 and not unsupported)::int as bad from orders),
ends as (select *, case when unsupported then 'ENGINE_FAILURE' when broken then 'BUSY' end as code, case when unsupported then 1 when broken then k % 4 + 1 else 0 end as tried from called),
ended as (select *, case when was = 'cancelled' then was when stop then 'completed_with_errors' when cancelled then 'cancelled' when k % 23 = 0 and not unsupported then 'completed_with_errors' when code is not null and (tried >= 3 or (not unsupported and k % 3 = 0)) then 'failed'
  when code is not null or not answered or not drained then 'running' when state = 'completed' then case when bad > 0 then 'completed_with_errors' else 'completed' end else state end as status from ends)"""


@query(
    f"""with {_CALLED} select 'run-' || k as run_id, status, case when was = 'cancelled' or status in ('running', 'completed', 'cancelled') then null when stop then 'DEADLINE_EXCEEDED' when k % 23 = 0 and not unsupported then 'RESULT_LIMIT_REACHED' when code is not null then code when state = 'failed' then 'UPSTREAM_JOB_FAILED' else 'UPSTREAM_COMPLETED_WITH_ERRORS' end as error_code,
  k % 10 + case when was = 'cancelled' or unsupported then 0 else k % 6 end as processed, case when was = 'cancelled' then 0 else bad end::bigint as failed, case when was = 'cancelled' or unsupported then 2 else 3 end::bigint as changes, case when was = 'cancelled' or unsupported or not answered then '4' else '9' end as cursor,
  case when was <> 'cancelled' and status = 'running' then case when code is not null then greatest(least(2.0 ** (tried - 1), 60.0), case when answered and k % 6 = 0 then 30.0 else 0 end) when answered and drained then 1.0 else 0.0 end end::double as wait_seconds,
  case when was = 'cancelled' then 1 else 2 end::bigint as state_version from ended"""
)
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run after its calls."""
    now = _now("1996-01-01")
    r = engine.transition(_called(spark, sf_dir), now)
    wait = F.when((F.col("status") == "running"), F.col("next_wakeup_at").cast("double") - now.cast("double"))
    return r.select("run_id", "status", "error_code", "processed", "failed", "changes", "cursor", wait.alias("wait_seconds"), "state_version")


@query(f"with {_RUNS} select run_id, 'queued' as status, 2::bigint as state_version from runs where status <> 'cancelled' and coalesce(lease_until <= timestamp '{RUNS_NOW}', true)")
def run_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that an interrupted worker left, queued again."""
    r = run_table(spark, sf_dir).withColumns({"status": F.when(F.col("status") == "queued", "running").otherwise(F.col("status")), "state_version": F.lit(1).cast("long"), "lease_owner": F.lit("w"), "updated_at": F.col("accepted_at")})
    return engine.recover(r, _now(RUNS_NOW)).select("run_id", "status", "state_version")


def _turn_registry() -> policies.Registry:
    """Turns as records: followed by role, system turns name no subject, every eleventh length is an absence."""
    known = policies.Registry()
    known.add(policies.Policy("turns", frozenset({("turn", "1.0")}), "subject", lambda x: F.get_json_object(x, "$.key"), lambda x: F.get_json_object(x, "$.size")))

    def draft(r: DataFrame) -> DataFrame:
        size = F.get_json_object("r_payload", "$.size")
        present = size.cast("long") % 11 != 0
        return r.select(
            "gateway_key", F.col("r_record_id").alias("record_id"), "arrival", F.lit("turn").alias("content_type_key"), F.lit("1.0").alias("content_schema_version"), F.lit(None).cast("timestamp").alias("observed_at"), present.alias("present"),
            F.when(present, ids.canonical_struct(size=size)).alias("content"), F.col("r_payload").alias("identity"), F.lit(None).cast("string").alias("attempt_ref"), F.lit(None).cast("timestamp").alias("published_at"),
        )

    known.add(policies.Mapping("turns", frozenset({("turns", "1.0")}), draft))
    return known


_TURNS = f"""turns as (select conv_id % 20 as run, row_number() over (partition by conv_id % 20 order by conv_id, turn, role, text) as nth, case when role <> 'system' then role || '-' || conv_id % 7 end as subject_key, length(coalesce(text, '')) as size from conversations where conv_id is not null),
obs as (select (run + 1) * 1000000000 + nth as arrival, run, 'scope-' || run % 4 as scope_key, subject_key, size % 11 <> 0 as present, case when size % 11 <> 0 then sha256(size::varchar) end as content_hash, null::timestamp as observed_at from turns where subject_key is not null),
{_DECIDED[_DECIDED.index("numbered as"):]}"""


@query(
    f"""with {_TURNS}, told as (select run, count(*) filter (where not coalesce(rejected, false)) as made, count(*) filter (where rejected) as refused, count(kind) as changes from decided group by 1),
s as (select run, made, refused + (select count(*) from turns t where t.run = told.run and subject_key is null) as failed, changes from told)
select 'run-' || run as run_id, made as processed, failed, changes, case when run % 5 = 0 then 'running' when run % 4 = 2 then 'failed' when run % 4 = 1 then 'running' when failed > 0 then 'completed_with_errors' else 'completed' end as status from s"""
)
def run_wake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as the pages of 20 runs, taken through mapping, policy and history in one wake."""
    from pyspark.sql import Window

    c = _table(spark, sf_dir, "conversations").where("conv_id is not null")
    run = F.pmod("conv_id", F.lit(20))
    line = Window.partitionBy(run).orderBy("conv_id", "turn", "role", "text")
    payload = ids.canonical_struct(key=F.when(F.col("role") != "system", F.concat("role", F.lit("-"), F.pmod("conv_id", F.lit(7)).cast("string"))), size=F.length(F.coalesce("text", F.lit(""))))
    t = c.select("conv_id", run.alias("run"), payload.alias("payload"), F.row_number().over(line).cast("long").alias("nth"))
    nothing = F.lit(None).cast("string")
    fields = {"record_id": F.concat(F.lit("rec-"), F.col("run").cast("string"), F.lit("-"), F.col("nth").cast("string")), "source_type": F.lit("turn"), "schema_version": F.lit("1.0"), "payload": F.col("payload"), "deleted": F.lit(False), "sequence": F.col("nth")}
    record = F.struct(*[fields.get(n, nothing).alias(n) for n in (f.split()[0] for f in engine.jobs.RECORD.split(", "))])
    pages = t.groupBy("run", "conv_id").agg(F.min("nth").alias("first"), F.array_sort(F.collect_list(F.struct("nth", record.alias("record")))).alias("r"))
    pages = pages.select(F.concat(F.lit("run-"), F.col("run").cast("string")).alias("run_id"), F.col("conv_id").cast("int").alias("page"), "first", F.transform("r", lambda x: x["record"]).alias("records"))
    n = F.col("id")
    held = spark.range(20).select(F.concat(F.lit("run-"), n.cast("string")).alias("run_id"), F.concat(F.lit("scope-"), (n % 4).cast("string")).alias("scope_key"), F.lit("turns").alias("collection_type"), F.lit("1.0").alias("schema_version"), F.lit("turns").alias("mapping_key"), F.lit("g").alias("gateway_key"), (n + 1).cast("int").alias("claim_order"), F.lit("running").alias("status"), F.lit("job").alias("job_id"))
    held = held.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (f.split() for f in engine.RUN.split(", ")) if c not in held.columns])
    known = _turn_registry()
    consumed = engine.consume(pages, held, known)
    decided = policies.decide(consumed.where("outcome = 'created'"), known)
    number = F.substring("run_id", 5, 9).cast("int")
    state = F.when(number % 4 == 2, "failed").when(number % 4 == 1, "running").otherwise("completed")
    result = F.struct(*[{"state": state, "drained": number % 5 > 0, "cancelled": F.lit(False)}.get(c, F.lit(None)).cast(k).alias(c) for c, k in (f.split() for f in engine.RESULT.split(", ")[:12])])
    after = engine.transition(held.withColumn("result", result).join(engine.tally(consumed, decided), "claim_order"), _now(RUNS_NOW))
    return after.select("run_id", "processed", "failed", "changes", "status")


@query("select o_orderkey as order_key, case when o_orderkey % 4 = o_orderkey % 3 then 'saved' else 'stale' end as outcome from orders where o_orderkey % 2 = 0")
def fenced_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compare-and-set on the state version."""
    r = run_table(spark, sf_dir)
    stored = r.select("run_id", (F.col("order_key") % 4).alias("state_version"))
    changed = r.where("order_key % 2 = 0").select("run_id", "order_key", (F.col("order_key") % 3).alias("state_version"))
    return runs.save_fenced(stored, changed).select("order_key", "outcome")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("role") == "system", "duplicate").when((F.col("role") == "assistant") & (F.length(F.coalesce("text", F.lit(""))) % 5 == 0), "failed").otherwise("created")
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("record_order"), outcome.alias("outcome"))


_RECORDS = "records as (select conv_id as run_id, turn as record_order, case when role = 'system' then 'duplicate' when role = 'assistant' and length(coalesce(text, '')) % 5 = 0 then 'failed' else 'created' end as outcome from conversations)"


@query(f"with {_RECORDS} select run_id, count(*) as received, count(*) filter (where outcome = 'created') as processed, count(*) filter (where outcome = 'duplicate') as duplicates, count(*) filter (where outcome = 'failed') as failed, case when count(*) filter (where outcome = 'failed') > 0 then 'completed_with_errors' else 'completed' end as status from records group by run_id")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and status of every run."""
    return runs.summarise(_records(spark, sf_dir))


@query(f"with {_RECORDS}, n as (select *, row_number() over (partition by run_id order by record_order) as nth, count(*) over (partition by run_id) > 4 as limited from records) select run_id, nth::bigint as nth, limited from n where nth <= 4")
def result_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most four records of a run, counted before dedup."""
    return runs.cap_results(_records(spark, sf_dir), 4).select("run_id", F.col("nth").cast("long").alias("nth"), "limited")


@query(f"with {_RECORDS}, s as (select run_id, count(*) filter (where outcome = 'failed') as failed, count(*) filter (where outcome = 'created') as processed from records group by 1) select count(*) as inspected, count(*) filter (where processed > 0) as progressed, count(*) filter (where failed = 0) as completed, count(*) filter (where failed > 0) as with_errors from s")
def wake_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a wake did over all runs."""
    s = runs.summarise(_records(spark, sf_dir))
    return s.agg(F.count("*").alias("inspected"), F.count_if(F.col("processed") > 0).alias("progressed"), F.count_if(F.col("failed") == 0).alias("completed"), F.count_if(F.col("failed") > 0).alias("with_errors"))


@query(
    f"""with {_DECIDED}, stored as (select document_id, subject_key, scope_key, case when hash(1) is not null and arrival % 101 = 0 then 'doc_bad' else document_id end as stored_id, arrival from decided where made_snapshot)
select arrival as recorded_order, stored_id, document_id as expected_id from stored where stored_id <> document_id"""
)
def integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose stored identity is not the one their columns give."""
    s = history.snapshots(_decided(spark, sf_dir)).withColumn("stored_id", F.when(F.col("recorded_order") % 101 == 0, "doc_bad").otherwise(F.col("document_id")))
    expected = ids.document_id(F.col("scope_key"), F.lit("subject"), F.col("subject_key"), F.lit("1.0"))
    return s.where(F.col("stored_id") != expected).select("recorded_order", "stored_id", expected.alias("expected_id"))
