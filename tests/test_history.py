import json

import pytest
from pyspark.sql import functions as F

from webloom.operators import delivery, history, policies, runs
from webloom.plans.changes import RUNS_NOW, observations, registry, run_table
from webloom.sources.store import ConflictError, Store
from webloom.streaming.history import DocumentState, step, stream_changes


def kinds(spark, marks, scope="s"):
    """marks: content of each arrival, None for an absence."""
    rows = [(scope, "k", i, m is not None, m) for i, m in enumerate(marks)]
    df = spark.createDataFrame(rows, "scope_key string, subject_key string, arrival long, present boolean, content_hash string").withColumn("observed_at", F.timestamp_seconds("arrival"))
    return [(r.kind, r.rejected) for r in history.decide(df).orderBy("arrival").collect()]


# input -> kinds, from the cases of change detection; x: rejected
CASES = [
    (["a", "a", "b"], ["first_seen", None, "revised"]),
    (["a", None, None, "a"], ["first_seen", "missing_suspected", "missing_confirmed", "restored"]),
    (["a", None, "a"], ["first_seen", "missing_suspected", None]),
    (["a", None, "b"], ["first_seen", "missing_suspected", "revised"]),
    ([None, "a"], ["missing_suspected", "first_seen"]),
    ([None, None, "a", "b", None], ["missing_suspected", "missing_confirmed", "x", "x", "missing_confirmed"]),
    (["a", None, None, None, "b"], ["first_seen", "missing_suspected", "missing_confirmed", "missing_confirmed", "restored"]),
]


@pytest.mark.parametrize("marks,want", CASES)
def test_cases(spark, marks, want):
    assert ["x" if r else k for k, r in kinds(spark, marks)] == want
    s, got = DocumentState(), []
    for m in marks:
        s, kind, rejected, _ = step(s, m is not None, m)
        got.append("x" if rejected else kind)
    assert got == want


def test_batches_from_stored_state(spark):
    """Every case cut in three at all places gives what one replay gives, and documents that a batch leaves alone stay."""
    cols = "scope_key string, subject_key string, arrival long, present boolean, content_hash string"
    marks = [m for m, _ in CASES] + [[None, None, "a", None, "a"], ["a", None, None, None, None, "a", "b"]]
    cuts = [(k, x, y) for k, m in enumerate(marks) for x in range(len(m) + 1) for y in range(x, len(m) + 1)]
    rows = [(f"{k}-{x}-{y}", i, m, (i >= x) + (i >= y)) for k, x, y in cuts for i, m in enumerate(marks[k])]
    df = spark.createDataFrame([("s", key, i, m is not None, m, part) for key, i, m, part in rows], cols + ", part int").withColumn("observed_at", F.timestamp_seconds("arrival"))
    whole = history.decide(df)
    names = ("subject_key", "arrival", "kind", "rejected", "streak", "sequence", "revision", "made_snapshot", "state")
    got, stored = [], None
    for part in range(3):
        d = history.decide(df.where(F.col("part") == part), stored=stored)
        got += [tuple(r[c] for c in names) for r in d.collect()]
        stored = spark.createDataFrame(history.state(d, stored).collect(), history.state(whole).schema)
    assert sorted(got, key=str) == sorted([tuple(r[c] for c in names) for r in whole.collect()], key=str)
    assert sorted(map(tuple, stored.collect()), key=str) == sorted(map(tuple, history.state(whole).collect()), key=str)


def test_snapshots_and_timeline(spark):
    rows = [("s", "k", i, m is not None, m) for i, m in enumerate(["a", None, None, "a", "b"])]
    d = history.decide(spark.createDataFrame(rows, "scope_key string, subject_key string, arrival long, present boolean, content_hash string").withColumn("observed_at", F.timestamp_seconds("arrival")))
    e = history.change_events(d).orderBy("sequence").collect()
    assert [(x.kind, x.from_revision, x.to_revision) for x in e] == [("first_seen", None, 1), ("missing_suspected", 1, None), ("missing_confirmed", 1, None), ("restored", 1, 1), ("revised", 1, 2)]
    assert [r.revision for r in history.snapshots(d).orderBy("revision").collect()] == [1, 2]
    t = history.timeline(history.change_events(d), history.snapshots(d)).first()
    assert len(t.events) == 5 and len(t.snapshots) == 2


def test_paging(spark, sf):
    events = history.change_events(history.decide(observations(spark, sf)))
    seen, cursor = [], None
    while True:
        page = history.query_changes(events, limit=37, scope="scope-2", cursor=cursor).collect()
        seen += [r.event_order for r in page]
        cursor = page[-1].next_cursor if page else None
        if cursor is None or len(seen) > 400:
            break
    want = [r.event_order for r in events.where("scope_key = 'scope-2'").orderBy("event_order").collect()]
    assert seen == want[: len(seen)] and (cursor or len(seen) == len(want))
    with pytest.raises(ValueError):
        history.query_changes(events, limit=0)


def test_admit_against_stored(spark):
    kind = "scope_key string, gateway_key string, record_id string, arrival long, fingerprint string"
    new = spark.createDataFrame([("s", "g", "1", 1, "x"), ("s", "g", "1", 2, "x"), ("s", "g", "2", 3, "z"), ("t", "g", "1", 4, "q")], kind)
    stored = spark.createDataFrame([("s", "g", "1", 0, "x"), ("s", "g", "2", 0, "y")], kind)
    assert [r.outcome for r in history.admit(new, stored).orderBy("arrival").collect()] == ["duplicate", "duplicate", "conflict", "created"]


def test_stream_equals_batch(spark, sf, tmp_path):
    obs = observations(spark, sf).drop("observed_at").cache()
    n = obs.count()
    for k in range(3):
        obs.where(f"arrival >= {n * k // 3} and arrival < {n * (k + 1) // 3}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # files of one second may come in any order, so the whole comes in one batch
    stream = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in"))
    q = stream_changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.arrival: (r.kind, r.sequence, r.revision, r.rejected, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.arrival: (r.kind, r.sequence, r.revision, r.rejected, r.state) for r in history.decide(observations(spark, sf)).collect()}
    assert got == want


def greedy(rows, limit, scope_limit, gateway_limits, after):
    queues = {}
    for r in rows:
        queues.setdefault((r.scope_key <= after, r.scope_key), []).append(r)
    for q in queues.values():
        q.sort(key=lambda r: (-r.priority, r.accepted_at, r.run_id))
    out, scopes, gates = [], {}, {}
    moved = True
    while moved and len(out) < limit:
        moved = False
        for key in sorted(queues):
            scope = key[1]
            if len(out) >= limit or scopes.get(scope, 0) >= scope_limit.get(scope, scope_limit["*"]):
                continue
            free = next((r for r in queues[key] if gates.get(r.gateway, 0) < gateway_limits.get(r.gateway, 10**9)), None)
            if free:
                queues[key].remove(free)
                scopes[scope] = scopes.get(scope, 0) + 1
                gates[free.gateway] = gates.get(free.gateway, 0) + 1
                out.append(free.run_id)
                moved = True
    return out


def test_allocation(spark, sf):
    rows = runs.runnable(run_table(spark, sf), F.lit(RUNS_NOW).cast("timestamp"))
    got = runs.allocate(rows, 90, scope_limits={"*": 20, "scope-2": 5}, gateway_limits={"O": 15, "F": 30}, after_scope="scope-3").orderBy("claim_order").collect()
    assert [r.run_id for r in got] == greedy(rows.collect(), 90, {"*": 20, "scope-2": 5}, {"O": 15, "F": 30}, "scope-3")


def test_outbox_order(spark):
    at = "timestamp'2024-01-01'"
    rows = [("d", 1, "blocked"), ("d", 2, "pending"), ("e", 1, "delivered"), ("e", 2, "pending"), ("e", 3, "pending")]
    box = spark.createDataFrame([("s", d, f"{d}{n}", n, s) for d, n, s in rows], "scope_key string, document_id string, event_id string, sequence long, status string").withColumns({"next_attempt_at": F.expr(at), "lease_until": F.lit(None).cast("timestamp")})
    assert [r.event_id for r in delivery.claimable(box, F.expr(at)).collect()] == ["e2"]


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    a = spark.range(3)
    assert store.read("t") is None and store.commit("b1", {"t": a}) and not store.commit("b1", {"t": a})
    assert store.read("t").count() == 3 and store.commit("b2", {"t": a, "u": a}, expected=1)
    assert store.read("t").count() == 6 and store.read("t", version=1).count() == 3
    with pytest.raises(ConflictError):
        store.commit("b3", {"t": a}, expected=1)


def test_cli(capsys):
    from webloom import cli

    cli.main(["demo"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == ["first_seen", "revised", "missing_suspected"]
    cli.main(["dispatch"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"claimed": 1, "delivered": 1, "retried": 0, "blocked": 0}


def test_policies(spark):
    """Each policy names its subjects, ignores what is volatile and counts absences its own way; bad drafts are failures."""
    cols = "gateway_key string, record_id string, arrival long, content_type_key string, content_schema_version string, present boolean, content string, identity string, attempt_ref string"
    value, status = ("g", "event.value", "1.0"), ("g", "order.status", "1.0")

    def row(i, kind, content, identity, present=None, attempt=None):
        return (kind[0], f"r{i}", i, kind[1], kind[2], content is not None if present is None else present, content, identity, attempt)

    rows = [row(i, value, None if a is None else f'{{"amount":{a},"volatile":{i}}}', '{"key":"7"}') for i, a in enumerate([1, 1, None, None, 1])]
    rows += [row(10 + i, status, None if a is None else f'{{"status":"{a}"}}', '{"order":"7"}', attempt="mine") for i, a in enumerate(["O", None, None, "O"])]
    rows += [row(20, ("g", "other", "1.0"), "{}", "{}"), row(21, value, None, '{"key":"7"}', present=True), row(22, value, "{}", '{"key":"7"}', present=False), row(23, value, '{"amount":1}', "{}"), row(24, (None, None, None), None, None)]
    df = spark.createDataFrame(rows, cols).withColumn("observed_at", F.timestamp_seconds("arrival"))
    known = registry()
    seen = policies.observe(df, known, F.lit("s"), F.lit("filled"))
    got = {r.arrival: r for r in seen.collect()}
    assert [got[i].error for i in (0, 10, 20, 21, 22, 23, 24)] == [None, None, "CONFIGURATION_ERROR", "INVALID_DRAFT", "INVALID_DRAFT", "INVALID_DRAFT", "CONFIGURATION_ERROR"]
    assert got[0].content_hash == got[1].content_hash and (got[0].attempt_ref, got[10].attempt_ref) == ("filled", "mine")
    assert len({r.observation_id for r in got.values()}) == len(rows)
    events = history.change_events(policies.decide(seen, known)).orderBy("event_order").collect()
    assert [(e.event_order, e.kind) for e in events] == [(0, "first_seen"), (2, "missing_suspected"), (3, "missing_confirmed"), (4, "restored"), (10, "first_seen"), (11, "missing_suspected"), (12, "missing_suspected")]
    assert len({e.document_id for e in events}) == 2  # the same key in two namespaces


def test_registry():
    known = registry()
    with pytest.raises(policies.ConfigurationError):
        known.add(known.policies["event-value"])
    with pytest.raises(policies.ConfigurationError):
        known.policy("nothing", "1.0")
    with pytest.raises(policies.UnsupportedType):
        known.mapping("nothing", "1.0")
    twin = policies.Policy("twin", frozenset({("event.value", "1.0")}), "user", F.lower, F.lower)
    known.add(twin)
    for ask in (lambda: known.policy("event.value", "1.0"), lambda: known.of_namespace("user")):
        with pytest.raises(policies.ConfigurationError):
            ask()
    assert known.policy("order.status", "1.1").namespace == "order" and known.mapping("orders", "1.0").key == "orders"
