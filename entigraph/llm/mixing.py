"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key ``-ln(u) / w``: ``u`` is a hash of its row, ``w`` its quality weight.
In order of that key, a source is a weighted random order of its documents.  A source that is due more
than its own size gives complete epochs first, every document once per epoch; what remains is a budget
that is filled in key order.

No source is sorted.  Keys are integers; sizes are summed per source over 1024 equal ranges of keys,
and only the range in which a source's budget ends, with those that follow it, is looked at again in 1024
smaller ranges, until it holds ``gather_most`` rows or fewer.  Those are filled: in key order, each
document that still fits.  So a source with a third of all rows costs grouped sums and one small group,
and it misses its target by less than the smallest document among up to ``FILL_MOST`` that follow the
place where its budget ends.  Targets are dealt in one task over one row per source (a name, and sums).

Cases: a null or blank text has size 0, is never short of room and is taken ``most_epochs`` times at
most; a null source is a source of its own, last; rows repeated exactly share a key, and as many of them
as fit are taken; a null doc_id hashes as null; an empty table gives an empty result; other columns are
part of the row's hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import quoted, staged

WEIGHTS = (3.0, 1.0, 2.0)
RANGES = 1024
_TOP = 1 << 60


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Between 0.25 and 1: the share of characters that are not digits, marks or brackets, squared."""
    odd = "0123456789!?#$%&*+=<>[]{}|/\\~^_@"
    share = F.length(F.translate(text, odd, "")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(share * share, F.lit(0.25)), F.lit(0.25))


def sampling_key(row: list[Column], weight: Column) -> Column:
    """-ln(u) / w, mapped in order to whole numbers from 0 to 2**60; ``u`` is a hash of all of ``row``."""
    u = (F.shiftrightunsigned(F.xxhash64(*row), 11) + 0.5) / float(1 << 53)
    key = -F.log(u) / weight
    return F.floor((F.lit(1.0) - F.exp(-key)) * float(_TOP)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most_epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    ``share`` of all sizes is dealt by weight, cyclic in code point order of the sources, null last.
    A target stops at ``most_epochs`` times its source's size; the excess goes to the others by weight
    until none is above.  Sorted by size over weight, the sources that stop are a prefix: a source stops
    if, with all before it stopped, its part of the rest is above its bound."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    bound = F.col("source_size") * F.lit(float(most_epochs))
    listed = sizes.withColumn("weight", weight).withColumn("bound", bound).withColumn("ratio", bound / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    rest = total - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    stops = F.col("weight") * rest / open_weight > F.col("bound")
    marked = listed.withColumn("stops", stops.cast("int"))
    stopped = F.sum(F.when(F.col("stops") == 1, F.col("bound")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("stops") == 1, 0.0).otherwise(F.col("weight"))).over(everything)
    total_kept = marked.withColumn("total", total)
    dealt = F.when(F.col("stops") == 1, F.col("bound")).otherwise(F.col("weight") * (F.col("total") - stopped) / free)
    return total_kept.withColumn("target", F.coalesce(dealt, F.lit(0.0))).select("source", "source_size", "target")


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per source: in key order, take as many of each group of equal rows as still fit; then one more row
    of the smallest size left, if it overshoots by less than what is missing."""
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            room, taken, least = row["room"], {}, None
            for item in sorted(row["items"], key=lambda x: x["key"]):
                n = item["n"] if not item["size"] else min(item["n"], int(room // item["size"]))
                room -= n * item["size"]
                taken[item["key"]] = n
                if n < item["n"] and (least is None or item["size"] < least["size"]):
                    least = item
            if least and least["size"] - room < room:
                taken[least["key"]] += 1
            out += [(row["source"], item["key"], taken[item["key"]], item["n"]) for item in row["items"] if taken[item["key"]]]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], k) for j, k in enumerate(kinds)], names=["ps", "pk", "m", "n"])


#: Rows after the place where a budget ends that may still fill it.
FILL_MOST = 1024


def _narrowed(rows: DataFrame, state: DataFrame, gather_most: int) -> DataFrame:
    """``state`` with the range in which each large source's room ends.  Once that holds few rows (or one
    key), the ranges after it are added that hold at most ``FILL_MOST`` rows with it, and n is 0."""
    width = F.greatest(F.ceil((F.col("high") - F.col("low")) / RANGES), F.lit(1)).cast("long")
    large = state.where((F.col("n") > gather_most) & (F.col("high") - F.col("low") > 1))
    ends = large.select(F.col("source").alias("s"), "low", "high", "room", width.alias("width"))
    inside = rows.join(ends, rows.source.eqNullSafe(ends.s) & (F.col("key") >= F.col("low")) & (F.col("key") < F.col("high")))
    ranges = inside.groupBy("source", "low", "width", "room", F.expr("(key - low) div width").alias("range")).agg(F.sum("size").alias("held"), F.count("*").alias("rows"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranges.withColumn("ends_at", F.sum("held").over(upto)).withColumn("rows_to", F.sum("rows").over(upto))
    whole = Window.partitionBy("source")
    first = F.min(F.when(F.col("ends_at") > F.col("room"), F.struct("range", (F.col("ends_at") - F.col("held")).alias("before"), (F.col("rows_to") - F.col("rows")).alias("rows_before"), "rows"))).over(whole)
    after = summed.withColumn("first", first).where(F.col("first").isNotNull() & (F.col("range") >= F.col("first.range")))
    done = (F.col("first.rows") <= gather_most) | (F.col("width") == 1)
    fit = after.where((F.col("range") == F.col("first.range")) | done & (F.col("rows_to") - F.col("first.rows_before") <= FILL_MOST))
    cut = fit.groupBy("source").agg(F.first("first").alias("f"), F.first("low").alias("c_low"), F.first("width").alias("width"), F.max("range").alias("last"), F.max(F.when(done, 0).otherwise(F.col("first.rows"))).alias("c_n")).withColumnRenamed("source", "cs")
    joined = state.join(cut, state.source.eqNullSafe(cut.cs), "left")
    narrow, is_large = F.col("f").isNotNull(), (F.col("n") > gather_most) & (F.col("high") - F.col("low") > 1)
    low = F.when(narrow, F.col("c_low") + F.col("f.range") * F.col("width")).when(is_large, F.col("high")).otherwise(F.col("low"))
    high = F.when(narrow, F.col("c_low") + (F.col("last") + 1) * F.col("width")).otherwise(F.col("high"))
    n = F.when(narrow, F.col("c_n")).when(is_large, 0).otherwise(F.col("n"))  # a large source whose room never ends is taken whole
    return joined.select("source", "source_size", "target", "epochs", (F.col("room") - F.coalesce("f.before", F.lit(0))).alias("room"), low.alias("low"), high.alias("high"), n.cast("long").alias("n"))


def _mixed(docs: DataFrame, share: float, most_epochs: float, weights: tuple[float, ...], gather_most: int, weight: Column | None) -> DataFrame:
    """(row, size, source_size, target, copies): ``row`` holds the columns of ``docs``."""
    flat = [F.to_json(F.col(quoted(f.name))) if f.dataType.typeName() in ("map", "struct", "array") else F.col(quoted(f.name)) for f in docs.schema]
    packed = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col("text"), F.col("source").cast("string").alias("source"), F.xxhash64(*flat).alias("hash"), (quality(F.col("text")) if weight is None else weight).cast("double").alias("weight"))
    sized = packed.select("row", "source", words(F.col("text")).alias("size"), sampling_key([F.col("hash")], F.col("weight")).alias("mix_key"))
    rows = staged(sized.select("source", F.col("mix_key").alias("key"), "size"), "mix-rows")
    sizes = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sizes")
    goal = targets(sizes, share, most_epochs, weights).join(sizes.select(F.col("source").alias("ns"), "n"), F.col("source").eqNullSafe(F.col("ns"))).drop("ns")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0).cast("long")
    state = goal.withColumn("epochs", epochs).withColumn("room", F.col("target") - F.col("epochs") * F.col("source_size"))
    # low: keys below are taken; [low, high): still open
    state = staged(state.withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(_TOP + RANGES).cast("long")), "mix-state")
    while not state.where((F.col("n") > gather_most) & (F.col("high") - F.col("low") > 1)).isEmpty():  # six rounds at most: ranges are 1/1024 of the last
        state = staged(_narrowed(rows, state, gather_most), "mix-state")
    last = state.select(F.col("source").alias("s"), "low", "high", "room")
    inside = rows.join(last, rows.source.eqNullSafe(last.s) & (F.col("key") >= F.col("low")) & (F.col("key") < F.col("high")))
    groups = inside.groupBy("source", "room", "key").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    chosen = groups.groupBy("source", "room").agg(F.collect_list(F.struct("key", "size", "n")).alias("items")).mapInArrow(_fill, "ps string, pk long, m long, n long")
    picked = staged(chosen, "mix-picked")
    ends = state.select(F.col("source").alias("s"), "source_size", "target", "epochs", "low")
    out = sized.join(ends, F.col("source").eqNullSafe(F.col("s"))).join(picked, F.col("source").eqNullSafe(F.col("ps")) & (F.col("mix_key") == F.col("pk")), "left")
    extra = ((F.col("mix_key") < F.col("low")) | F.col("pk").isNotNull()).cast("long")
    # a row without words weighs nothing, so no target bounds how often it is taken
    copies = F.when(F.col("size") == 0, F.least(F.col("epochs") + extra, F.lit(math.ceil(most_epochs)))).otherwise(F.col("epochs") + extra)
    out = out.withColumn("copies", copies.cast("long"))
    columns = ["row", "size", "source_size", "target", "copies"]
    if picked.where("m < n").isEmpty():
        return out.select(columns)
    # rows of one key are equal in all columns: they are counted, and the first m of them are taken
    split = F.col("pk").isNotNull() & (F.col("m") < F.col("n"))
    counted = out.where(split).groupBy("source", "mix_key", "size", "source_size", "target", "epochs", "m").agg(F.first("row").alias("row"), F.count("*").alias("count"))
    numbered = counted.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).withColumn("copies", F.col("epochs") + (F.col("i") <= F.col("m")).cast("long"))
    return out.where(~split | split.isNull()).select(columns).unionAll(numbered.select(columns))


def mix(docs: DataFrame, share: float = 1.5, most_epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS, gather_most: int = 1024, weight: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, taken and copies (how often the mix takes the row).

    ``weight``: a column of ``docs`` above 0, the quality weight of a row; else it comes from the text.
    Columns of ``docs`` with one of those names are replaced."""
    added = ("size", "source_size", "target", "taken", "copies")
    mixed = _mixed(docs, share, most_epochs, weights, gather_most, weight)
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added]
    return mixed.select(*kept, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, share: float = 1.5, most_epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS, gather_most: int = 1024, weight: Column | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    mixed = _mixed(docs, share, most_epochs, weights, gather_most, weight).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col("row")[c].alias(c) for c in docs.columns])
