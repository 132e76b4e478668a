"""Record mappings and content policies that users bring, and the way from records to observations.

A mapping turns the records of a collection type into drafts; a policy owns a content type: how its subject is named, what of the content makes a revision, and how many absences mean missing. Both are built of Column and DataFrame functions, so Catalyst plans them: which policy a row takes is one CASE over its type. A Registry is driver-side and small.

Drafts have gateway_key, record_id, arrival, content_type_key, content_schema_version, observed_at, present, content and identity (JSON texts), attempt_ref, published_at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import ids
from webloom.operators import history


class ConfigurationError(ValueError):
    """A key registered twice, or a type that no or more than one policy claims."""


class UnsupportedType(ConfigurationError):
    """No mapping takes this collection type."""


@dataclass(frozen=True)
class Mapping:
    key: str
    types: frozenset[tuple[str, str]]  #: collection type and schema version
    draft: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Policy:
    ref: str
    types: frozenset[tuple[str, str]]  #: content type and schema version
    namespace: str
    identify: Callable[[Column], Column]  #: identity -> subject key
    material: Callable[[Column], Column]  #: content -> the text whose digest tells revisions apart
    missing_after: int = 2


class Registry:
    def __init__(self):
        self.mappings: dict[str, Mapping] = {}
        self.policies: dict[str, Policy] = {}

    def add(self, part: Mapping | Policy) -> None:
        held, key = (self.mappings, part.key) if isinstance(part, Mapping) else (self.policies, part.ref)
        if key in held:
            raise ConfigurationError(f"{key} is registered already")
        held[key] = part

    def mapping(self, kind: str, version: str) -> Mapping:
        fits = [m for m in self.mappings.values() if (kind, version) in m.types]
        if not fits:
            raise UnsupportedType(f"no mapping for {kind}@{version}")
        return _only(fits, f"{kind}@{version}")

    def policy(self, kind: str, version: str) -> Policy:
        return _only([p for p in self.policies.values() if (kind, version) in p.types], f"{kind}@{version}")

    def of_namespace(self, namespace: str) -> Policy:
        return _only([p for p in self.policies.values() if p.namespace == namespace], namespace)


def _only(fits: list, what: str):
    if len(fits) != 1:
        raise ConfigurationError(f"{len(fits)} entries fit {what}, one must")
    return fits[0]


def drafts(records: DataFrame, registry: Registry, kind: str, version: str = "1.0") -> DataFrame:
    """The drafts of a collection's records, by the one mapping that takes its type."""
    return registry.mapping(kind, version).draft(records)


def observe(rows: DataFrame, registry: Registry, scope_key: Column, attempt_ref: Column) -> DataFrame:
    """Drafts as observations: policy_ref, namespace, subject_key, content_hash and a stable observation_id are added, a missing attempt_ref is filled. error names rows that can't be observed, CONFIGURATION_ERROR (not exactly one policy) or INVALID_DRAFT (content and presence disagree, or no subject); they make failures, not observations."""
    kind = F.struct("content_type_key", "content_schema_version")
    known = sorted({t for p in registry.policies.values() for t in p.types})
    owner = {t: [p for p in registry.policies.values() if t in p.types] for t in known}

    def chosen(value: Callable[[Policy], Column]) -> Column:
        """value of the row's policy, null where there isn't one."""
        cases = [(t, p[0]) for t, p in owner.items() if len(p) == 1]
        none = F.lit(None).cast("string")
        return reduce(lambda rest, c: F.when(kind == F.struct(F.lit(c[0][0]), F.lit(c[0][1])), value(c[1])).otherwise(rest), cases, none)

    disagree = F.col("present").isNull() | (F.col("present") != F.col("content").isNotNull())
    out = rows.withColumns({
        "scope_key": scope_key,
        "attempt_ref": F.coalesce("attempt_ref", attempt_ref),
        "policy_ref": chosen(lambda p: F.lit(p.ref)),
        "namespace": chosen(lambda p: F.lit(p.namespace)),
        "subject_key": chosen(lambda p: p.identify(F.col("identity"))),
        "content_hash": F.when(F.col("present"), ids.digest(chosen(lambda p: p.material(F.col("content"))))),
    })
    error = F.when(F.col("policy_ref").isNull(), "CONFIGURATION_ERROR").when(disagree | F.col("subject_key").isNull(), "INVALID_DRAFT")
    name = ids.digest(ids.canonical_array(F.col("scope_key"), F.col("gateway_key"), F.col("record_id")))
    return out.withColumns({"error": error, "observation_id": F.concat(F.lit("obs_"), F.substring(name, 1, 32))})


def decide(observed: DataFrame, registry: Registry, stored: DataFrame | None = None) -> DataFrame:
    """history.decide() with each policy's rule for absences: one sort of its own rows for each policy. stored: the state() of earlier batches."""
    good = observed.where("error is null")
    before = lambda p: None if stored is None else stored.where(F.col("policy_ref") == p.ref)
    parts = [history.decide(good.where(F.col("policy_ref") == p.ref), p.missing_after, before(p)) for p in registry.policies.values()]
    return reduce(DataFrame.unionByName, parts)


def state(decided: DataFrame, registry: Registry) -> DataFrame:
    """history.state() of each policy's documents, which its policy_ref tells apart."""
    parts = [history.state(decided.where(F.col("policy_ref") == p.ref)).withColumn("policy_ref", F.lit(p.ref)) for p in registry.policies.values()]
    return reduce(DataFrame.unionByName, parts)


def latest_state(states: DataFrame | None) -> DataFrame | None:
    """The last of the states (with wake) that were stored for each document."""
    if states is None:
        return None
    key = ("policy_ref", *history.KEY)
    return states.groupBy(*key).agg(F.max_by(F.struct(*[c for c in states.columns if c not in key]), "wake").alias("s")).select(*key, "s.*")
