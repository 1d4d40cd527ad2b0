"""Overlaps of intervals: all pairs of one key, whatever lies between them in order.

Two intervals overlap where the one that begins later begins inside the other.  So beginnings are joined with intervals:
time is cut into buckets of a power of two, an interval lies in the one or two buckets of the power that is no
shorter than itself, and a beginning looks into one bucket for each power that occurs.  That is an equi-join on
key, power and bucket, so a busy key is cut by time, and as an interval fills at least a quarter of its buckets
few pairs meet in vain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The power of intervals without an end.
_OPEN = 62


def overlaps(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end", name: str = "id") -> DataFrame:
    """(keys, a, b, start, end): each pair of names once, the one that begins first as ``a`` (then by name), and the time
    that both share.  Intervals hold their beginning and not their end; no end means open, no beginning or nothing
    between them means none.  Names are distinct within a key."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = rows.where(F.col(start).isNotNull()).select(*keys, F.col(name).alias("_id"), us(start).alias("_s"), us(end).alias("_e")).where("_e IS NULL OR _e > _s")
    powers = F.when(F.col("_e").isNull(), _OPEN).otherwise(F.expr("cast(floor(log2(_e - _s)) as int) + 1"))
    placed = own.withColumn("_p", powers).withColumn("_b", F.explode(F.expr(f"if(_p = {_OPEN}, array(0L), sequence(shiftright(_s, _p), shiftright(_e - 1, _p)))")))
    occur = placed.groupBy(*keys).agg(F.collect_set("_p").alias("_ps"))  # 64 a key at most
    begins = own.join(occur, keys).select(*keys, F.col("_id").alias("b"), F.col("_s").alias("_t"), F.col("_e").alias("_u"), F.explode("_ps").alias("_p"))
    begins = begins.withColumn("_b", F.expr(f"if(_p = {_OPEN}, 0L, shiftright(_t, _p))"))
    met = placed.join(begins, [*keys, "_p", "_b"]).where("(_s < _t OR _s = _t AND _id < b) AND (_e IS NULL OR _t < _e)")
    back = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return met.select(*keys, F.col("_id").alias("a"), "b", back(F.col("_t")).alias("start"), back(F.least("_e", "_u")).alias("end"))


def contradictory_times(edges: DataFrame) -> DataFrame:
    """(a, b, start, end, days): pairs of relationships of one source and type, to different targets, that hold at the same time."""
    pairs = overlaps(edges, ["source_entity_id", "relationship_type"])
    ends = edges.select(F.col("id").alias("_id"), F.col("target_entity_id").alias("_t"))
    both = pairs.join(ends.toDF("a", "_at"), "a").join(ends.toDF("b", "_bt"), "b").where("_at <> _bt")
    return both.select("a", "b", "start", "end", F.date_diff("end", "start").alias("days"))
