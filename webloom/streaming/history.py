"""Change detection as a stream: the same rules as the batch windows, one row after the other, with a small state for each document.

State never expires: a late row is accepted in arrival order and replays are recognised by an ingest table outside, so there is no watermark. Within a micro-batch rows of a document are sorted by arrival.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "scope_key string, subject_key string, arrival long, kind string, sequence long, revision long, rejected boolean, state string"


class DocumentState(NamedTuple):
    rows: int = 0  #: seen so far
    stuck: bool = False  #: began with a confirmed absence
    streak: int = 0
    last_hash: str | None = None
    sequence: int = 0
    revision: int = 0


def step(s: DocumentState, present: bool, content: str | None, missing_after: int = 2) -> tuple[DocumentState, str | None, bool, str | None]:
    """The state after one observation, its event kind, whether it was rejected, and the document's state name (null if rejected)."""
    if not present:
        streak = s.streak + 1
        kind = "missing_confirmed" if streak >= missing_after else "missing_suspected"
        return s._replace(rows=s.rows + 1, stuck=s.stuck or s.rows + 1 == streak == missing_after, streak=streak, sequence=s.sequence + 1), kind, False, kind
    if s.stuck:
        return s._replace(rows=s.rows + 1), None, True, None
    if s.last_hash is None:
        kind = "first_seen"
    elif s.streak >= missing_after:
        kind = "restored"
    else:
        kind = "revised" if content != s.last_hash else None
    new = content != s.last_hash and kind is not None
    return DocumentState(s.rows + 1, False, 0, content, s.sequence + (kind is not None), s.revision + new), kind, False, "present"


def stream_changes(observations: DataFrame, missing_after: int = 2) -> DataFrame:
    """A stream of (scope_key, subject_key, arrival, present, content_hash) as decided rows."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = DocumentState(*state.get) if state.exists else DocumentState()
        out = []
        for r in pd.concat(list(frames)).sort_values("arrival").itertuples():
            s, kind, rejected, name = step(s, bool(r.present), r.content_hash, missing_after)
            out.append((*key, r.arrival, kind, s.sequence, s.revision, rejected, name))
        state.update(tuple(s))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])

    slim = observations.select("scope_key", "subject_key", "arrival", "present", "content_hash")
    return slim.groupBy("scope_key", "subject_key").applyInPandasWithState(run, OUT, "rows long, stuck boolean, streak long, last_hash string, sequence long, revision long", "append", GroupStateTimeout.NoTimeout)
