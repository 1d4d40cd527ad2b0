"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a document is a blob, addressed by the SHA-256 of its text.  The ledger is a folder
with two tables: ``scanned`` (blob, rule, version) and ``findings`` (blob, rule, version, span_start,
span_end).  A scan asks the ledger which pairs of blob and rule version are new, scans each such blob
once with just the rules that are new for it, adds both tables' rows, and joins the findings of all
current rule versions back to every path that holds the blob.

A rule is a Java regular expression whose matches are taken leftmost and without overlap; a match
counts if ``kept_group`` of it has at least ``least_chars`` characters.  Positions are code points, and
come from running sums of the lengths of matches and of what lies between them, in a window per blob.

Cases: a null text is the empty blob; null paths stay as rows; copies share one scan; repeated rows
are reported each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_path, text_or_empty

_SCANNED = "blob string, rule string, version int"
_FINDINGS = "blob string, rule string, version int, span_start int, span_end int"


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    kept_group: int = 0
    least_chars: int = 1
    #: Lower-cased strings of which a match holds one; texts without any are not searched.
    hints: tuple[str, ...] = ()


# Fixed values of the contract.  Runs are greedy, so a minimum length may stand in the pattern where no
# shorter match can take characters from a later one: for access and hex, not for assign.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)


_HIT = "struct<rule: string, version: int, place: int, gap: int, size: int, kept: boolean>"


def hits_of(text: Column, rule: Rule) -> Column:
    """Array of a rule's matches in ``text``, in order: their number, the characters between the match
    before and this one, and their length.

    No position is known here: summing up inside an array would copy it for each match."""
    pattern = F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.kept_group)) if rule.kept_group else found
    sizes = F.zip_with(F.zip_with(between, found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"))), kept, lambda s, k: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), (F.length(k) >= rule.least_chars).alias("kept")))
    hits = F.transform(F.filter(sizes, lambda s: s["size"].isNotNull()), lambda s, i: F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), i.alias("place"), s["gap"].alias("gap"), s["size"].alias("size"), s["kept"].alias("kept")))
    return F.when(text.rlike(rule.pattern), hits)


def with_spans(hits: DataFrame) -> DataFrame:
    """The findings of (blob, rule, version, place, gap, size, kept): gaps and matches alternate, so a match
    ends at the running sum of both."""
    upto = Window.partitionBy("blob", "rule", "version").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")
    placed = hits.withColumn("span_end", end).where("kept")
    return placed.select("blob", "rule", "version", (F.col("span_end") - F.col("size")).alias("span_start"), "span_end")


def blobs_of(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    return docs.select(F.col(path).alias("path"), text_or_empty().alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))


def read_ledger(spark: SparkSession, ledger: str) -> tuple[DataFrame, DataFrame]:
    """(scanned, findings); empty tables if nothing was ever scanned."""
    out = []
    for name, schema in (("scanned", _SCANNED), ("findings", _FINDINGS)):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{name}")
        there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        out.append(spark.read.schema(schema).parquet(f"{ledger}/{name}") if there else spark.createDataFrame([], schema))
    return out[0], out[1]


def unseen(docs: DataFrame, scanned: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> DataFrame:
    """(blob, text, todo): one row per blob that has a rule version to run; ``todo`` names those rules."""
    current = F.array(*[F.lit(f"{r.name}@{r.version}") for r in rules])
    seen = scanned.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("seen"))
    blobs = blobs_of(docs, path).select("blob", "text").dropDuplicates(["blob"])
    todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(current, F.coalesce("seen", F.array().cast("array<string>"))))
    return todo.where(F.size("todo") > 0).select("blob", "text", "todo")


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> DataFrame:
    """Scan what is new, extend the ledger, and return (path, blob, findings) for every row of ``docs``.

    ``findings``: array of (rule, span_start, span_end) in order of start, then of ``rules``."""
    spark = docs.sparkSession
    scanned, findings = read_ledger(spark, ledger)
    todo = unseen(docs, scanned, rules, path)
    text = F.col("text")
    lowered = F.lower(text)
    parts = []
    for rule in rules:
        worth = F.array_contains("todo", f"{rule.name}@{rule.version}")
        if rule.hints:
            hinted = F.lit(False)
            for hint in rule.hints:
                hinted = hinted | lowered.contains(hint)
            worth = worth & hinted
        parts.append(F.when(worth, hits_of(text, rule)))
    nothing = F.expr(f"cast(array() AS array<{_HIT}>)")
    results = todo.select("blob", "todo", F.concat(*[F.coalesce(p, nothing) for p in parts]).alias("found"))
    # one pass over the texts writes both: the blobs scanned, with what was found in each
    batch = shared_path(spark, "secret-scan")
    results.write.parquet(batch)
    done = spark.read.schema(results.schema).parquet(batch)
    with_spans(done.select("blob", F.explode("found").alias("f")).select("blob", "f.*")).write.mode("append").parquet(f"{ledger}/findings")
    pair = F.split(F.col("pair"), "@")
    done.select("blob", F.explode("todo").alias("pair")).select("blob", pair[0].alias("rule"), pair[1].cast("int").alias("version")).write.mode("append").parquet(f"{ledger}/scanned")
    return report(docs, ledger, rules, path)


def report(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> DataFrame:
    """(path, blob, findings) for every row of ``docs`` from the ledger alone."""
    _, findings = read_ledger(docs.sparkSession, ledger)
    rank = F.lit(None).cast("int")
    for i, rule in enumerate(rules):
        rank = F.when((F.col("rule") == rule.name) & (F.col("version") == rule.version), i).otherwise(rank)
    current = findings.withColumn("rank", rank).where("rank IS NOT NULL").distinct()
    entry = F.struct("span_start", "rank", "rule", "span_end")
    by_blob = current.groupBy("blob").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    listed = F.transform(F.coalesce("found", F.expr("cast(array() AS array<struct<span_start: int, rank: int, rule: string, span_end: int>>)")), lambda f: F.struct(f["rule"].alias("rule"), f["span_start"].alias("span_start"), f["span_end"].alias("span_end")))
    paths = blobs_of(docs, path).select("path", "blob")
    return paths.join(by_blob, "blob", "left").select("path", "blob", listed.alias("findings"))


def digest(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["rule"], f["span_start"].cast("string"), f["span_end"].cast("string"))), ",")


def count_of(findings: Column, rule: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["rule"] == rule)).cast("long")


def _sql_spans(kind: str, pattern: str, kept: str) -> str:
    """DuckDB: the same running sums as a list of (start, rank, text) of one kind."""
    rank = {"assign": 0, "access": 1, "hex": 2}[kind]
    quoted = pattern.replace("'", "''")
    return f"""(SELECT list({{'s': p, 'r': {rank}, 't': '{kind}:' || p || ':' || (p + length(hit))}} ORDER BY p) FROM (
      SELECT hit, kept, sum(length(gap)) OVER (ORDER BY i) + coalesce(sum(length(hit)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM (
        SELECT unnest(generate_series(1, len(hits))) AS i, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(keeps) AS kept FROM (
          SELECT regexp_extract_all(t, '{quoted}') AS hits, string_split_regex(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}', {kept}) AS keeps))) WHERE length(kept) >= {12 if kind == "assign" else 1})"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, coalesce({_sql_spans("assign", RULES[0].pattern, "2")}, []) AS a, coalesce({_sql_spans("access", RULES[1].pattern, "0")}, []) AS k, coalesce({_sql_spans("hex", RULES[2].pattern, "0")}, []) AS h FROM d),
j AS (SELECT *, coalesce(array_to_string(list_transform(list_sort(list_concat(list_concat(a, k), h)), lambda x: x.t), ','), '') AS spans FROM f)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_assign, CAST(len(k) AS BIGINT) AS n_access, CAST(len(h) AS BIGINT) AS n_hex, sha256(spans) AS base_sha256, spans FROM j
"""
