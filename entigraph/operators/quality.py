"""Declarative rules, compiled to predicates, and quality scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .aggregate import accuracy, penalty

#: Named patterns that a rule may refer to.
PATTERNS = {"email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", "date": r"^\d{4}-\d{2}-\d{2}$", "phone": r"^\+?[0-9\s\-()]{7,}$"}


@dataclass(frozen=True)
class Rule:
    """A rule on a field; ``types`` may hold ``*``.  ``unique`` takes scope ``type`` or ``global``."""

    rule_id: str
    types: tuple[str, ...]
    field: str
    operator: str
    value: str = ""
    severity: str = "warning"


def fails(rule: Rule) -> Column:
    """True where a row breaks the rule."""
    x = F.col(rule.field)
    text = x.cast("string")
    checks = {
        "not_empty": lambda: text.isNull() | (F.trim(text) == ""),
        "min_length": lambda: text.isNull() | (F.length(text) < int(rule.value)),
        "matches_pattern": lambda: text.isNotNull() & ~text.rlike(PATTERNS.get(rule.value, rule.value)),
        "unique": lambda: F.count("*").over(Window.partitionBy(*([F.col("entity_type")] if rule.value == "type" else []), x)) > 1,
        "range": lambda: (x < float(rule.value.split(",")[0])) | (x > float(rule.value.split(",")[1])),
        "before": lambda: x >= F.lit(rule.value).cast("timestamp_ntz"),
        "less_than": lambda: x >= float(rule.value),
    }
    if rule.operator not in checks:
        raise ValueError(f"unknown rule operator {rule.operator!r}; known: {sorted(checks)}")
    return F.coalesce(checks[rule.operator](), F.lit(False))


def violations(entities: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, severity, id) of every broken rule: one pass for all rules that look at one row."""
    single, windowed = [r for r in rules if r.operator != "unique"], [r for r in rules if r.operator == "unique"]

    def scoped(rule: Rule) -> Column:
        return F.lit(True) if "*" in rule.types else F.col("entity_type").isin(*rule.types)

    parts = []
    if single:
        hits = F.array_compact(F.array(*[F.when(scoped(r) & fails(r), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for r in single]))
        parts.append(entities.select("id", F.explode(hits).alias("v")).select("v.rule_id", "v.severity", "id"))
    for r in windowed:
        parts.append(entities.where(scoped(r)).withColumn("_bad", fails(r)).where("_bad").select(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def rule_summary(found: DataFrame, rules: list[Rule], total: int | None = None) -> DataFrame:
    """(rule_id, n_violations) of every rule, zero included."""
    every = found.sparkSession.createDataFrame([(r.rule_id,) for r in rules], "rule_id string")
    counted = found.groupBy("rule_id").agg(F.count("*").alias("n_violations"))
    return every.join(counted, "rule_id", "left").withColumn("n_violations", F.coalesce("n_violations", F.lit(0)))


def report(entities: DataFrame, complete: Column, valid: Column, n_pending: DataFrame, n_duplicates: DataFrame) -> DataFrame:
    """completeness, accuracy, consistency, validity, uniqueness, overall, advice.

    ``n_pending`` and ``n_duplicates`` have one row and one column n each."""
    base = entities.agg(F.count("*").alias("total"), F.coalesce(F.avg(complete.cast("double")), F.lit(0.0)).alias("completeness"), F.coalesce(F.avg(valid.cast("double")), F.lit(0.0)).alias("validity"))
    joined = base.join(accuracy(entities), F.lit(True)).join(n_pending.select(F.col("n").alias("pending")), F.lit(True)).join(n_duplicates.select(F.col("n").alias("duplicates")), F.lit(True))
    scored = joined.withColumn("consistency", penalty(F.col("pending"), F.col("total"))).withColumn("uniqueness", penalty(F.col("duplicates"), F.col("total")))
    parts = ["completeness", "accuracy", "consistency", "validity", "uniqueness"]
    overall = sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / len(parts)
    advice = F.array_join(F.array_compact(F.array(*[F.when(F.col(p) < 0.7, F.lit(f"improve {p}")) for p in parts])), "; ")
    return scored.select(*parts, overall.alias("overall"), advice.alias("advice"))
