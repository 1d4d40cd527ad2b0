"""Document pipelines: a list of steps becomes one graph of lazy DataFrames.

A step names its inputs; Spark schedules the work.  ``build`` gives the graph, of which nothing runs until a result is
written; ``resume`` writes what each step makes, and does only what changed since the last time.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, chunking, ontology, quality, resolve


@dataclass(frozen=True)
class Step:
    step_id: str
    step_type: str
    inputs: tuple[str, ...] = ()
    run_order: int = 0
    enabled: bool = True
    config: dict = field(default_factory=dict)


def levels(steps: list[Step]) -> list[list[Step]]:
    """Steps by level: each after all its inputs, in ``run_order`` within a level; disabled ones left out."""
    left = {s.step_id: s for s in steps if s.enabled}
    for s in left.values():
        unknown = [i for i in s.inputs if i not in {x.step_id for x in steps}]
        if unknown:
            raise ValueError(f"step {s.step_id} has unknown inputs {unknown}")
    out = []
    while left:
        ready = [s for s in left.values() if not any(i in left for i in s.inputs)]
        if not ready:
            raise ValueError(f"steps depend on each other: {sorted(left)}")
        out.append(sorted(ready, key=lambda s: (s.run_order, s.step_id)))
        for s in ready:
            del left[s.step_id]
    return out


Runner = Callable[[SparkSession, dict[str, DataFrame], dict], DataFrame]


def _all(inputs: dict[str, DataFrame]) -> DataFrame:
    """The rows of all inputs; a column that one of them lacks is null there."""
    if not inputs:
        raise ValueError("the step needs an input")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs.values())


def _chunk(spark, inputs, config):
    return chunking.chunked(_all(inputs), chunking.cut_at_ends, size=config.get("chunk_size", 1000), overlap=config.get("overlap", 200))


def _extract(spark, inputs, config):
    provider = config.get("provider")  # a function of chunks that returns spans; the patterns if there is none
    return provider(_all(inputs)) if provider else chunking.entity_spans(_all(inputs))


def _resolve(spark, inputs, config):
    found = _all(inputs)
    named = found.select(F.sha2(F.concat_ws("|", "doc_id", "chunk_index", "start_position", "entity_text"), 256).alias("id"), "entity_text", "entity_type", "confidence")
    return {"exact": resolve.resolve_exact, "fuzzy": lambda d: resolve.resolve_fuzzy(d, config.get("threshold", 0.85)), "none": lambda d: d}[config.get("strategy", "exact")](named)


RUNNERS: dict[str, Runner] = {
    "read_documents": lambda spark, inputs, config: spark.read.parquet(config["path"]),
    "text_chunking": _chunk,
    "entity_extraction": _extract,
    "entity_resolution": _resolve,
    "ontology_mapping": lambda spark, inputs, config: ontology.map_types(_all(inputs), config["mappings"], config.get("least", 0.7)),
    "validation": lambda spark, inputs, config: quality.violations(_all(inputs), config["rules"]),
    "data_profiling": lambda spark, inputs, config: aggregate.profile(_all(inputs)),
    "duplicate_detection": lambda spark, inputs, config: resolve.duplicates(_all(inputs), config.get("block", ["entity_type"]), config.get("least", 0.8)),
    "sql": lambda spark, inputs, config: spark.sql(config["statement"], **inputs),
}

#: The steps of each kind of source, by template.
TEMPLATES: dict[str, tuple[tuple[str, str, tuple[str, ...]], ...]] = {
    "file": (("read", "read_documents", ()), ("chunk", "text_chunking", ("read",)), ("extract", "entity_extraction", ("chunk",)), ("resolve", "entity_resolution", ("extract",)), ("map", "ontology_mapping", ("resolve",))),
    "api": (("read", "read_documents", ()), ("chunk", "text_chunking", ("read",)), ("extract", "entity_extraction", ("chunk",)), ("resolve", "entity_resolution", ("extract",))),
    "database": (("read", "read_documents", ()), ("profile", "data_profiling", ("read",)), ("chunk", "text_chunking", ("read",)), ("extract", "entity_extraction", ("chunk",)), ("resolve", "entity_resolution", ("extract",))),
}


def from_template(name: str, **configs: dict) -> list[Step]:
    return [Step(i, t, inputs, n, True, configs.get(i, {})) for n, (i, t, inputs) in enumerate(TEMPLATES[name])]


def with_quality_steps(steps: list[Step], after: str, rules: list) -> list[Step]:
    """``steps`` and a validation step at the end."""
    return [*steps, Step("validate", "validation", (after,), max(s.run_order for s in steps) + 1, True, {"rules": rules})]


def build(spark: SparkSession, steps: list[Step], runners: dict[str, Runner] | None = None) -> dict[str, DataFrame]:
    """The DataFrame of every enabled step, none of them run.

    A step without its own inputs named gets what its inputs got; of inputs with one name the later wins."""
    known = RUNNERS | (runners or {})
    out: dict[str, DataFrame] = {}
    for level in levels(steps):
        for step in level:
            if step.step_type not in known:
                raise ValueError(f"no runner for step type {step.step_type!r}")
            out[step.step_id] = known[step.step_type](spark, {i: out[i] for i in step.inputs if i in out}, step.config)
    return out


def run(spark: SparkSession, steps: list[Step], target: str, outputs: tuple[str, ...], runners: dict[str, Runner] | None = None) -> list[tuple[str, str, str | None]]:
    """Write the named outputs below ``target``; (step, status, error) of each, one failure not stopping the rest."""
    built = build(spark, steps, runners)
    log = []
    for name in outputs:
        try:
            built[name].write.mode("overwrite").parquet(f"{target}/{name}")
            log.append((name, "completed", None))
        except Exception as e:  # the run log says what failed
            log.append((name, "failed", str(e)))
    return log


@dataclass(frozen=True)
class StepRun:
    """What became of a step: completed, kept (an earlier run made the same), failed, or skipped (an input failed)."""

    step_id: str
    level: int
    status: str
    fingerprint: str
    path: str | None = None
    seconds: float = 0.0
    error: str | None = None


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of the files at a path, which tell whether a source has changed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    out, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def _said(value: Any) -> Any:
    """A setting as text that stays the same from run to run: rows by their hashes, functions by their names."""
    if isinstance(value, DataFrame):
        row = F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
        return [value.schema.simpleString(), *map(str, value.agg(F.count("*"), F.sum(row.cast("decimal(38,0)"))).first())]
    if callable(value):
        return f"{value.__module__}.{value.__qualname__}"
    return repr(value)


def fingerprint(spark: SparkSession, step: Step, inputs: list[str]) -> str:
    """Of the step's type and settings, the files it reads by ``path``, and the fingerprints of its inputs.  A ``version`` among
    the settings speaks for a source that is no path."""
    files = _files(spark, step.config["path"]) if "path" in step.config else []
    told = json.dumps([step.step_type, step.config, files, inputs], sort_keys=True, default=_said)
    return hashlib.sha256(told.encode()).hexdigest()[:32]


def resume(spark: SparkSession, steps: list[Step], target: str, run_id: str, runners: dict[str, Runner] | None = None) -> list[StepRun]:
    """Run the enabled steps, each from the written outputs of its inputs, and write a status row for each to ``target``/_runs.

    An output lies under its step's fingerprint, so a step whose settings, files and inputs are those of an earlier run keeps
    what that run made; whatever changed runs again, and so do the steps after it.  A step that fails stops those that need
    it and no others."""
    known = RUNNERS | (runners or {})
    runs: dict[str, StepRun] = {}
    for n, level in enumerate(levels(steps)):
        for step in level:
            needed = [runs[i] for i in step.inputs if i in runs]
            mark = fingerprint(spark, step, [r.fingerprint for r in needed])
            path, began = f"{target}/{step.step_id}/{mark}", time.time()
            if bad := [r.step_id for r in needed if r.status in ("failed", "skipped")]:
                runs[step.step_id] = StepRun(step.step_id, n, "skipped", mark, error=f"needs {', '.join(bad)}")
                continue
            if any(f[0].endswith("/_SUCCESS") for f in _files(spark, path)):
                runs[step.step_id] = StepRun(step.step_id, n, "kept", mark, path)
                continue
            try:
                if step.step_type not in known:
                    raise ValueError(f"no runner for step type {step.step_type!r}")
                inputs = {r.step_id: spark.read.parquet(r.path) for r in needed}
                known[step.step_type](spark, inputs, step.config).write.mode("overwrite").parquet(path)
                runs[step.step_id] = StepRun(step.step_id, n, "completed", mark, path, time.time() - began)
            except Exception as e:  # the status row says what failed
                runs[step.step_id] = StepRun(step.step_id, n, "failed", mark, None, time.time() - began, str(e)[:2000])
    rows = [asdict(r) | {"run_id": run_id} for r in runs.values()]
    if rows:
        shape = "run_id string, step_id string, level int, status string, fingerprint string, path string, seconds double, error string"
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("overwrite").json(f"{target}/_runs/{run_id}")
    return list(runs.values())
