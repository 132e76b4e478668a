"""Content-derived identities, bit-exact SHA-256 over canonical JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_struct(**fields: Column) -> Column:
    """Canonical JSON of a flat object: keys sorted, no spaces, nulls kept, non-ASCII kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_array(*parts: Column) -> Column:
    return F.to_json(F.array(*parts))


@F.pandas_udf(StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """Canonical form of any JSON text; null for null or malformed input. Numbers keep their own spelling class (1.0 stays 1.0), which variant rendering would lose."""

    def one(x):
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return raw.map(one)


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def document_id(scope: Column, namespace: Column, key: Column, identity_version: Column) -> Column:
    """doc_ and the first half of the digest of scope and subject. The subject's URI is not identity."""
    return F.concat(F.lit("doc_"), F.substring(digest(canonical_struct(scope_key=scope, namespace=namespace, key=key, identity_version=identity_version)), 1, 32))


def page_record_id(collection: Column, canonical_url: Column) -> Column:
    return F.concat(F.lit("page-"), F.substring(digest(F.concat(collection, F.lit("\n"), canonical_url)), 1, 32))


def evidence_ref(body: Column, kind: str) -> Column:
    return F.concat(F.lit("evidence://sha256/"), F.sha2(body.cast("binary"), 256), F.lit("/" + kind))


def event_id(document: Column, sequence: Column) -> Column:
    """Derived, not random: a retried task gives the same event the same id."""
    return F.concat(F.lit("evt_"), F.substring(digest(canonical_array(document, sequence.cast("string"))), 1, 32))


def snapshot_id(document: Column, revision: Column) -> Column:
    return F.concat(F.lit("snap_"), F.substring(digest(canonical_array(document, revision.cast("string"))), 1, 32))


def fingerprint(**fields: Column) -> Column:
    """Digest by which a replayed record is told from a changed one. Leave out run, job, attempt and collector."""
    return digest(canonical_struct(**fields))
