"""Statistics over entities, relationships, mappings, runs and activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import norm


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def graph_statistics(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_entities, n_relationships, avg_relationships) of active rows."""
    v = entities.where("is_active").agg(F.count("*").alias("n_entities"))
    e = edges.where("is_active").agg(F.count("*").alias("n_relationships"))
    return v.join(e, F.lit(True)).withColumn("avg_relationships", 2.0 * F.col("n_relationships") / F.greatest("n_entities", F.lit(1)))


def conditional_counts(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """One row: how many rows have each value, and how many there are."""
    return df.agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values], F.count("*").alias("n_total"))


def share_of(df: DataFrame, condition: Column, name: str, *keys: str) -> DataFrame:
    """The share of rows that meet a condition; 0 where there are none."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(condition.cast("double")), F.lit(0.0)).alias(name))


def accuracy(df: DataFrame) -> DataFrame:
    """Mean confidence, 0.5 where unknown, a fifth more (1 at most) where verified."""
    conf = F.coalesce("confidence", F.lit(0.5))
    return df.agg(F.avg(F.when(F.col("is_verified"), F.least(conf * 1.2, F.lit(1.0))).otherwise(conf)).alias("accuracy"))


def penalty(bad: Column, total: Column) -> Column:
    """1 less twice the share of bad rows, 0 at least; 1 of none."""
    return F.when(total == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - 2.0 * bad / total))


def trend(runs: DataFrame, at: str, score: str) -> DataFrame:
    """(recent, earlier, trend): the latest 3 of the latest 7 runs against the rest, steady within 0.05."""
    newest = Window.orderBy(F.desc(at), F.desc(score))
    last = runs.select(at, score).orderBy(F.desc(at), F.desc(score)).limit(7).withColumn("place", F.row_number().over(newest))
    both = last.agg(F.avg(F.when(F.col("place") <= 3, F.col(score))).alias("recent"), F.avg(F.when(F.col("place") > 3, F.col(score))).alias("earlier"))
    step = F.col("recent") - F.col("earlier")
    return both.withColumn("trend", F.when(F.col("earlier").isNull(), "insufficient_data").when(step > 0.05, "improving").when(step < -0.05, "declining").otherwise("stable"))


def vector_quality(vectors: DataFrame, group: str | None = None) -> DataFrame:
    """Count, dimension and the spread of norms (population standard deviation)."""
    sized = vectors.withColumn("norm", norm(F.col("embedding"))).withColumn("dim", F.size("embedding"))
    rows = sized.groupBy(group) if group else sized.groupBy()
    return rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim"), F.avg("norm").alias("norm_mean"), F.stddev_pop("norm").alias("norm_std"), F.min("norm").alias("norm_min"), F.max("norm").alias("norm_max"))


def chart(df: DataFrame, x: str, y: str | None, group: str | None = None) -> DataFrame:
    """(x[, series], value): the sum of y by x, what is not a number left out; the count if there is no y."""
    keys = [F.coalesce(F.col(x).cast("string"), F.lit("Unknown")).alias("x")] + ([F.coalesce(F.col(group).cast("string"), F.lit("Unknown")).alias("series")] if group else [])
    value = F.coalesce(F.sum(F.col(y).cast("string").try_cast("double")), F.lit(0.0)) if y else F.count("*").cast("double")
    return df.groupBy(*keys).agg(value.alias("value"))


def profile(df: DataFrame) -> DataFrame:
    """(column_name, n, n_null, n_distinct, least, most) of every column, in one pass."""
    def of(c: str) -> Column:
        s = F.col(c).cast("string")
        return F.struct(F.lit(c).alias("column_name"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_distinct(F.col(c)).alias("n_distinct"), F.min(s).alias("least"), F.max(s).alias("most"))

    return df.agg(F.array(*[of(c) for c in df.columns]).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def recent(df: DataFrame, at: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before a fixed time."""
    return df.where((F.col(at) > F.expr(f"timestamp_ntz'{as_of}' - INTERVAL {int(days)} DAYS")) & (F.col(at) <= F.expr(f"timestamp_ntz'{as_of}'")))


def newest(*feeds: DataFrame, at: str, key: str, each: int = 10, most: int = 20) -> DataFrame:
    """The newest rows of several feeds, ``each`` of one and ``most`` in all."""
    out = None
    for feed in feeds:
        top = feed.orderBy(F.desc(at), key).limit(each)
        out = top if out is None else out.unionByName(top)
    return out.orderBy(F.desc(at), key).limit(most)


def run_metrics(runs: DataFrame) -> DataFrame:
    """Per step: runs, mean seconds, items out over items in, items a second."""
    return runs.groupBy("step_id").agg(F.count("*").alias("n_runs"), F.avg("seconds").alias("avg_seconds"), (F.sum("n_out") / F.sum("n_in")).alias("success_rate"), (F.sum("n_out") / F.greatest(F.sum("seconds"), F.lit(1e-9))).alias("throughput"))
