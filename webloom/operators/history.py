"""Change detection: observations in arrival order become documents, snapshots and change events.

The rules are a policy of one number, the absences after which a document counts as missing. In arrival order, for each document: an absence is suspected, or confirmed from that number on; a present row is first seen, restored (after a confirmed absence), revised (other content than the last snapshot), or silent. A document that begins with a confirmed absence can't become present: its present rows are rejected and change nothing. All of it is one sort by document and arrival: windows over the same order share it.

A batch goes on from what is stored: its rows are joined with the documents that state() returned for the rows before them (keys are not null, and all of a batch arrives after what is stored), so nothing is replayed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import ids

KEY = ("scope_key", "subject_key")
INGEST = ("scope_key", "gateway_key", "record_id")


def admit(incoming: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Adds outcome: created, duplicate, or conflict (IDEMPOTENCY_CONFLICT) against stored ingests and earlier rows of the batch. Exact and unbounded in time, so no watermark."""
    line = Window.partitionBy(*INGEST).orderBy("arrival")
    first = incoming.withColumn("known", F.first("fingerprint").over(line)).withColumn("nth", F.row_number().over(line))
    if stored is not None:
        before = stored.select(*INGEST, F.col("fingerprint").alias("stored"))
        first = first.join(before, list(INGEST), "left").withColumn("known", F.coalesce("stored", "known")).withColumn("nth", F.when(F.col("stored").isNotNull(), F.col("nth") + 1).otherwise(F.col("nth"))).drop("stored")
    outcome = F.when(F.col("known") != F.col("fingerprint"), "conflict").when(F.col("nth") > 1, "duplicate").otherwise("created")
    return first.withColumn("outcome", outcome).drop("known", "nth")


def decide(observations: DataFrame, missing_after: int = 2, stored: DataFrame | None = None) -> DataFrame:
    """Every observation with kind (null: no event), streak, state, made_snapshot, sequence and revision after it; stored is the state() of the observations before."""
    old_streak, old_sequence, old_revision, old_hash = F.lit(0), F.lit(0), F.lit(0), F.lit(None).cast("string")
    if stored is not None:
        old = stored.select(*KEY, *[F.col(c).alias(f"__{c}") for c in ("missing_streak", "sequence", "revision", "content_hash")])
        observations = observations.join(old, list(KEY), "left")
        old_streak, old_sequence, old_revision = (F.coalesce(f"__{c}", F.lit(0)) for c in ("missing_streak", "sequence", "revision"))
        old_hash = F.col("__content_hash")
    line = Window.partitionBy(*KEY).orderBy("arrival")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    o = observations.withColumn("nth", F.row_number().over(line))
    o = o.withColumn("first_present", F.min(F.when(F.col("present"), F.col("nth"))).over(upto))
    o = o.withColumn("rejected", F.col("present") & old_hash.isNull() & (old_streak + F.col("first_present") > missing_after))
    good = F.col("present") & ~F.col("rejected")
    o = o.withColumn("island", F.count_if(good).over(upto))
    inside = Window.partitionBy(*KEY, "island").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    o = o.withColumn("streak", F.when(good, 0).otherwise(F.count_if(~F.col("present")).over(inside) + F.when(F.col("island") == 0, old_streak).otherwise(0)))
    o = o.withColumn("before", F.coalesce(F.lag("streak").over(line), old_streak))
    o = o.withColumn("last_hash", F.coalesce(F.last(F.when(good, F.col("content_hash")), ignorenulls=True).over(earlier), old_hash))
    changed = ~F.col("content_hash").eqNullSafe(F.col("last_hash"))
    kind = (
        F.when(F.col("rejected"), None)
        .when(~F.col("present") & (F.col("streak") >= missing_after), "missing_confirmed")
        .when(~F.col("present"), "missing_suspected")
        .when(F.col("last_hash").isNull(), "first_seen")
        .when(F.col("before") >= missing_after, "restored")
        .when(changed, "revised")
    )
    o = o.withColumn("kind", kind)
    o = o.withColumn("made_snapshot", F.coalesce(good & F.col("kind").isin("first_seen", "revised", "restored") & (F.col("last_hash").isNull() | changed), F.lit(False)))
    state = F.when(F.col("present"), "present").when(F.col("streak") >= missing_after, "missing_confirmed").otherwise("missing_suspected")
    o = o.withColumn("state", F.when(~F.col("rejected"), state))
    o = o.withColumn("sequence", F.count("kind").over(upto) + old_sequence).withColumn("revision", F.count_if("made_snapshot").over(upto) + old_revision)
    return o.drop("nth", "first_present", "island", "before", "__missing_streak", "__sequence", "__revision", "__content_hash")


def _document(decided: DataFrame) -> Column:
    """The document's id; rows without a namespace column are of the namespace subject."""
    namespace = F.col("namespace") if "namespace" in decided.columns else F.lit("subject")
    return ids.document_id(F.col("scope_key"), namespace, F.col("subject_key"), F.lit("1.0"))


def change_events(decided: DataFrame) -> DataFrame:
    """One row for each event, with its snapshots before and after."""
    d = decided.where("kind is not null")
    document = _document(d)
    made = F.col("made_snapshot").cast("int")
    before = F.when(F.col("revision") - made > 0, F.col("revision") - made)
    return d.select(
        *KEY,
        document.alias("document_id"),
        ids.event_id(document, F.col("sequence")).alias("event_id"),
        "sequence",
        "kind",
        before.alias("from_revision"),
        F.when(F.col("present"), F.col("revision")).alias("to_revision"),
        F.col("arrival").alias("event_order"),
        F.col("observed_at").alias("effective_observed_at"),
    )


def snapshots(decided: DataFrame) -> DataFrame:
    document = _document(decided)
    return decided.where("made_snapshot").select(*KEY, document.alias("document_id"), ids.snapshot_id(document, F.col("revision")).alias("snapshot_id"), "revision", "content_hash", "observed_at", F.col("arrival").alias("recorded_order"))


def state(decided: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """What a later batch needs of every document: its current state and the content of its last snapshot. With stored, the documents that this batch does not touch stay as they are."""
    ok = decided.where("not rejected")
    fresh = ok.groupBy(*KEY).agg(
        F.max_by("state", "arrival").alias("state"),
        F.max_by("streak", "arrival").cast("long").alias("missing_streak"),
        F.max("revision").alias("revision"),
        F.max("sequence").alias("sequence"),
        F.min_by("observed_at", "arrival").alias("first_observed_at"),
        F.max("observed_at").alias("last_observed_at"),
        F.max_by(F.when(F.col("present"), F.col("content_hash")).otherwise(F.col("last_hash")), "arrival").alias("content_hash"),
    )
    if stored is None:
        return fresh
    new, old = fresh.alias("new"), stored.alias("old")
    both = new.join(old, list(KEY), "full")
    latest = [F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in ("state", "missing_streak", "revision", "sequence")]
    begun = F.coalesce("old.first_observed_at", "new.first_observed_at").alias("first_observed_at")
    ended = F.greatest("old.last_observed_at", "new.last_observed_at").alias("last_observed_at")
    return both.select(*KEY, *latest, begun, ended, F.coalesce("new.content_hash", "old.content_hash").alias("content_hash"))


def documents(decided: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Current state: a partial aggregate by document, no further sort."""
    return state(decided, stored).drop("content_hash")


def timeline(events: DataFrame, snaps: DataFrame) -> DataFrame:
    """Each document with its ordered snapshots and events nested."""
    e = events.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "kind", "from_revision", "to_revision"))).alias("events"))
    s = snaps.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("revision", "content_hash"))).alias("snapshots"))
    return e.join(s, "document_id", "left")


def query_changes(events: DataFrame, limit: int = 100, cursor: str | None = None, scope: str | None = None, document: str | None = None, kinds: tuple[str, ...] = (), after=None, before=None) -> DataFrame:
    """A page of changes in event order: rows of the page, and on each the cursor to go on from, null on the last page. The time bounds are exclusive."""
    import base64

    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    if after is not None and before is not None and before <= after:
        raise ValueError("before must be later than after")
    e = events
    if scope is not None:
        e = e.where(F.col("scope_key") == scope)
    if document is not None:
        e = e.where(F.col("document_id") == document)
    if kinds:
        e = e.where(F.col("kind").isin(*kinds))
    if after is not None:
        e = e.where(F.col("effective_observed_at") > F.lit(after))
    if before is not None:
        e = e.where(F.col("effective_observed_at") < F.lit(before))
    if cursor is not None:
        e = e.where(F.col("event_order") > int(base64.urlsafe_b64decode(cursor)))
    page = e.orderBy("event_order").limit(limit + 1)  # one more row than asked for tells whether there are more
    every = Window.partitionBy()
    page = page.withColumn("n", F.count("*").over(every)).withColumn("nth", F.row_number().over(Window.orderBy("event_order")))
    page = page.withColumn("last", F.max(F.when(F.col("nth") <= limit, F.col("event_order"))).over(every))
    token = F.base64(F.col("last").cast("string").cast("binary"))
    return page.where(F.col("nth") <= limit).withColumn("next_cursor", F.when(F.col("n") > limit, token)).drop("n", "nth", "last")
