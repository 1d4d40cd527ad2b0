"""Rate limits: counts in windows as SQL, and the rules that depend on what was refused as state."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Limit:
    limit: int
    seconds: int
    rule: str = "sliding_window"
    cost: int = 1


#: Named limits.
LIMITS = {"standard": Limit(1000, 3600), "premium": Limit(5000, 3600, "token_bucket"), "burst": Limit(100, 60), "search": Limit(50, 300, "token_bucket", 2)}


def in_trailing_window(calls: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """``calls`` with how many of the key fall in the last ``seconds``, each counted, refused or not."""
    w = f"count(*) OVER (PARTITION BY {key} ORDER BY {at} RANGE BETWEEN INTERVAL {int(seconds)} SECONDS PRECEDING AND CURRENT ROW)"
    return calls.withColumn("n_in_window", F.expr(w))


def fixed_window(calls: DataFrame, key: str, at: str, order: str, limit: int, seconds: int) -> DataFrame:
    """``calls`` with ``allowed``: the first ``limit`` of each key in each window of the clock."""
    second = F.unix_seconds(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key, F.floor(second / seconds)).orderBy(at, order)
    return calls.withColumn("allowed", F.row_number().over(w) <= limit)


def scope_key(user: str, api_key: str, ip: str, endpoint: str):
    """The first known of user, key, address and endpoint, else global."""
    return F.coalesce(user, api_key, ip, endpoint, F.lit("global"))


def sliding_step(seen: list[float], now: float, rule: Limit) -> tuple[bool, list[float]]:
    """Refused calls are not remembered."""
    seen = [t for t in seen if t > now - rule.seconds]
    allowed = len(seen) + rule.cost <= rule.limit
    return allowed, seen + [now] * rule.cost if allowed else seen


def bucket_step(state: tuple[float, float] | None, now: float, rule: Limit) -> tuple[bool, tuple[float, float]]:
    """(tokens, time): refilled evenly up to the limit; a call that is allowed spends its cost."""
    tokens, then = state if state else (float(rule.limit), now)
    tokens = min(float(rule.limit), tokens + max(now - then, 0.0) * rule.limit / rule.seconds)
    allowed = tokens >= rule.cost
    return allowed, (tokens - rule.cost if allowed else tokens, now)


def decide(calls: DataFrame, key: str, at: str, order: str, rule: Limit) -> DataFrame:
    """(order, allowed) in batch: each key's calls in turn, streamed, so a busy key needs no memory but its state."""
    rows = calls.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(order).alias("call_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state = None, None
        for pdf in batches:
            out = []
            for k, us, call in zip(pdf["key"], pdf["us"], pdf["call_id"], strict=True):
                if k != own:
                    own, state = k, None
                now = us / 1e6
                if rule.rule == "token_bucket":
                    allowed, state = bucket_step(state, now, rule)
                else:
                    allowed, state = sliding_step(state or [], now, rule)
                out.append((call, allowed))
            yield pd.DataFrame(out, columns=["call_id", "allowed"])

    ordered = rows.repartition("key").sortWithinPartitions("key", "us", "call_id")
    return ordered.mapInPandas(run, f"call_id {dict(rows.dtypes)['call_id']}, allowed boolean")
