"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule: its weight at training time u in [0, 1] is w * (1 + s * (1 - 2u)), s between -1 (comes late) and 1 (comes early). Over the whole run the schedule integrates to w, so weights alone set the targets: `share` of all words is divided by weight, no target exceeds `repeats` times its source's size, and the excess is dealt again by weight until none does. That is the level L at which min(cap, L * w) adds up, found in closed form over the sources sorted by cap / w.

Inside a source, documents are laid end to end in the order of a hash of their ids; pass after pass of this line is read until the target is met, so its last document may be read in part, and every source meets its target to the word. A document whose first word is number c of target T is read at the time u where the integrated schedule reaches c / T, which inverts in closed form. Rows come range-sorted by that time.

The running sums never meet in one task: a source is cut into hash buckets, whose totals are summed apart. What is sorted in one task is one row for each source, and BUCKETS rows within a source.

Nulls and texts of white space have size 0 and are not read; a null source is a source, sorted last; a null id is hashed as an empty string; repeated rows are documents of their own (ties in the hash order are settled by text size, and equal rows may swap). Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import Workspace

WEIGHTS = (5, 2, 1)
SLOPES = (0.5, 0.0, -0.5)
SHARE = 1.5
REPEATS = 2
WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3  #: hex digits of the hash, so 4096 buckets in a source


def _cycled(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def source_targets(totals: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, weight, slope, target from (source, source_size)."""
    line = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    t = totals.withColumn("rank", F.row_number().over(line) - 1)
    t = t.select("source", "source_size", "rank", _cycled(weights, F.col("rank")).cast("long").alias("weight"), _cycled(slopes, F.col("rank")).cast("double").alias("slope"))
    t = t.withColumn("cap", F.col("source_size") * repeats)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    goal = F.sum("source_size").over(every) * F.lit(share)
    level = (goal - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    water = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)["level"]
    return t.select("source", "source_size", "weight", "slope", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(water * F.col("weight")).alias("target"))


def _when_read(share_done: Column, slope: Column) -> Column:
    """The time u at which (1 + s) u - s u^2 reaches share_done."""
    root = F.sqrt((1 + slope) * (1 + slope) - 4 * slope * share_done)
    return F.when(slope == 0, share_done).otherwise((1 + slope - root) / (2 * slope))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken, position, next_position, sorted by position; what is not read comes last."""
    ws = Workspace(docs.sparkSession, "mix")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = ws.save(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key")), "sized")
    sized = sized.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    totals = ws.save(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "totals")
    targets = source_targets(totals.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, slopes, share, repeats)
    starts = totals.withColumn("start", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    starts = ws.save(starts.alias("a").join(targets.alias("b"), same).select("a.source", "bucket", "start", "source_size", "slope", "target"), "starts")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = placed.alias("a").join(starts.alias("b"), same & (F.col("a.bucket") == F.col("b.bucket")))
    whole = F.col("target").cast("long")  # words; floor
    passes = F.when(F.col("source_size") > 0, F.expr("cast(target as bigint) div source_size")).otherwise(F.lit(0))
    at = F.col("own") + F.col("start")
    out = out.select("doc_id", "size", "source_size", "target", "slope", "key", at.alias("at"), whole.alias("whole"), passes.alias("passes"))
    rest = F.col("whole") - F.col("passes") * F.col("source_size") - F.col("at")
    out = out.withColumn("taken", F.col("passes") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest)))
    first = F.when(F.col("taken") > 0, _when_read(F.col("at") / F.col("target"), F.col("slope")))
    second = F.when((F.col("taken") > F.col("size")), _when_read((F.col("at") + F.col("source_size")) / F.col("target"), F.col("slope")))
    out = out.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"), second.alias("next_position"), "key")
    return out.orderBy(F.coalesce("position", F.lit(2.0)), "key", "doc_id").drop("key")


_SQL_WORD = r"[^\x20\x09-\x0D]+"
MIX_SQL = f"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{_SQL_WORD}')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as k from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, row_number() over (order by source asc nulls last) - 1 as r from totals),
weighed as (select source, source_size, r, [5, 2, 1][(r % 3 + 1)::int]::bigint as w, [0.5, 0.0, -0.5][(r % 3 + 1)::int]::double as s, source_size * 2 as cap from ranked),
levels as (select *, ((sum(source_size) over ())::bigint::double * 1.5 - coalesce((sum(cap) over before)::bigint, 0)::double) / ((sum(w) over ())::bigint - coalesce((sum(w) over before)::bigint, 0))::double as level
  from weighed window before as (order by cap::double / w::double, r rows between unbounded preceding and 1 preceding)),
flagged as (select *, cap::double <= level * w::double as capped from levels),
targets as (select source, source_size, s, case when capped then cap::double else (select arg_min(level, (cap::double / w::double, r)) from flagged where not capped) * w::double end as target from flagged),
laid as (select d.doc_id, d.size, t.source_size, t.target, t.s, floor(t.target)::bigint as whole, case when t.source_size > 0 then floor(t.target)::bigint // t.source_size else 0 end as passes,
  coalesce((sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding))::bigint, 0) as begins
  from sized d join targets t on d.source is not distinct from t.source),
took as (select *, (passes * size + greatest(0, least(size, whole - passes * source_size - begins)))::bigint as taken from laid),
shares as (select *, begins::double / nullif(target, 0) as y, (begins + source_size)::double / nullif(target, 0) as y2 from took)
select doc_id, size, source_size, target, taken,
  case when taken > 0 then case when s = 0 then y else (1 + s - sqrt((1 + s) * (1 + s) - 4 * s * y)) / (2 * s) end end as position,
  case when taken > size then case when s = 0 then y2 else (1 + s - sqrt((1 + s) * (1 + s) - 4 * s * y2)) / (2 * s) end end as next_position
from shares
"""
