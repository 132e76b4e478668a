"""python -m webloom.cli demo | dispatch: the change history of four observations, and one dispatch of its outbox, as JSON."""

from __future__ import annotations

import json
import sys

from pyspark.sql import functions as F

from webloom.operators import delivery, history
from webloom.session import local_session

ROWS = [(1, "item", True, "v1"), (2, "item", True, "v1"), (3, "item", True, "v2"), (4, "item", False, None)]


def main(args: list[str]) -> int:
    spark = local_session("2", 2)
    rows = spark.createDataFrame(ROWS, "arrival long, subject_key string, present boolean, content_hash string").withColumns({"scope_key": F.lit("demo"), "observed_at": F.timestamp_seconds(F.col("arrival") + 1767225600)})
    events = history.change_events(history.decide(rows))
    if args[:1] == ["dispatch"]:
        now, none = F.lit("2026-02-01").cast("timestamp"), F.lit(None).cast("string")
        box = events.select("scope_key", "document_id", "event_id", "sequence", F.lit("pending").alias("status"), F.col("event_order").alias("created_at"), F.col("effective_observed_at").alias("next_attempt_at"), none.alias("lease_owner"), none.cast("timestamp").alias("lease_until"), F.lit(0).alias("attempt_count"), F.lit(0).alias("state_version"), none.alias("last_error_code"), none.alias("last_error_message"))
        claimed = delivery.claim(box, now, "cli")
        done = delivery.settle(claimed, claimed.select("event_id", "lease_owner", "state_version", F.lit(True).alias("ok"), none.alias("code"), none.alias("message")), now)
        print(json.dumps(delivery.summary(claimed, done).first().asDict()))
    else:
        print(json.dumps([r.kind for r in events.orderBy("event_order").collect()]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
