"""Candidates among the entities of a block, by the words they share; and the conflicts made of them.

Entities with equal lower-cased texts are one class, so a text that many share is compared once.  Classes
meet on their rarest words alone: sets with a Jaccard index of ``w`` or more have one in common among the first
``n - ceil(w * n) + 1`` of them in order of rarity, which leaves out the words that many share without
losing a pair.  Where such a word is still held by more than ``hot`` classes its block is split by a second
word: those sets also share two of their first ``n - ceil(w * n) + 2``.  Pairs are weighted by the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.properties import mean_likeness
from ..functions.similarity import cosine, jaccard, sequence_ratio, severity, word_and_letter
from ..session import settled
from . import alike


def _place(*keys: str, order: str = "id") -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order))


def _width(rows: DataFrame) -> int:
    """The session's number of shuffle partitions, for rows that take more memory than bytes in a shuffle."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def classes(entities: DataFrame, block: list[str]) -> DataFrame:
    """(block, text, n): the distinct lower-cased texts of each block and how many entities hold them."""
    return entities.groupBy(F.struct(*block).alias("block"), F.lower("entity_text").alias("text")).agg(F.count("*").alias("n"))


def keys(of: DataFrame, w: float, hot: int = 1000) -> DataFrame:
    """(block, text, key, ws): what classes with a Jaccard index of ``w`` or more have in common, and hashes of their words.

    ``o`` words at least are shared; a hot word alone is a key only between sets that may share one word."""
    words = of.select("block", "text", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word")).where("word <> ''")
    held = words.groupBy("block", "word").agg(F.count("*").alias("df"))
    rare_first = F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ws")
    ranked = words.join(held, ["block", "word"]).groupBy("block", "text").agg(rare_first).withColumn("o", F.ceil(F.size("ws") * w - 1e-9).cast("int"))
    first = F.expr("slice(ws, 1, size(ws) - o + 1)")
    second = F.expr("slice(ws, 1, least(size(ws), size(ws) - o + 2))")
    single = F.transform(F.filter(first, lambda x: (x["df"] <= hot) | (F.col("o") == 1)), lambda x: F.array(x["word"]))
    hot_words = F.filter(second, lambda x: x["df"] > hot)
    double = F.flatten(F.transform(hot_words, lambda h: F.transform(F.filter(second, lambda x: x["word"] != h["word"]), lambda x: F.array_sort(F.array(h["word"], x["word"])))))
    hashes = F.transform("ws", lambda x: F.xxhash64(x["word"]))
    return ranked.select("block", "text", F.explode(F.array_distinct(F.concat(single, double))).alias("key"), hashes.alias("ws"))


def alike_classes(of: DataFrame, w: float, hot: int = 1000) -> DataFrame:
    """(block, a, b, weight): pairs of texts of a block, each once, with a Jaccard index of words of ``w`` or more."""
    if w <= 0:
        raise ValueError("texts without a common word do not meet: w has to be above 0")
    k = keys(of, w, hot).withColumn("n", F.size("ws"))
    met = k.select("block", "key", *[F.col(c).alias(f"a{c}") for c in ("text", "ws", "n")]).join(k.select("block", "key", *[F.col(c).alias(f"b{c}") for c in ("text", "ws", "n")]), ["block", "key"])
    both = "size(array_intersect(aws, bws))"
    close = met.where(f"atext < btext AND least(an, bn) >= {w!r}D * greatest(an, bn) - 1e-9D").where(f"{both} * (1 + {w!r}D) >= {w!r}D * (an + bn) - 1e-9D")
    pairs = close.select("block", F.col("atext").alias("a"), F.col("btext").alias("b")).distinct()
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    return pairs.withColumn("weight", jaccard(words("a"), words("b"))).where(F.col("weight") >= w - 1e-9)


def similar_classes(of: DataFrame, least: float, hot: int = 1000) -> DataFrame:
    """(block, a, b, score): as above, by the mean of the indices of words and letters, ``least`` or more."""
    if least <= 0.5:
        raise ValueError("texts without a common word can reach a score of 0.5: least has to be above it")
    met = alike_classes(of, 2 * least - 1, hot)
    return met.withColumn("score", word_and_letter(F.col("a"), F.col("b"))).where(F.col("score") >= least).select("block", "a", "b", "score")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.withColumnRenamed("a", "_a").withColumnRenamed("b", "a").withColumnRenamed("_a", "b"))


def candidate_counts(entities: DataFrame, block: list[str], w: float) -> DataFrame:
    """(id, n): for each entity the others of its block with its text or one that shares words with it, counted by
    classes without making the pairs."""
    of = classes(entities, block)
    near = both_ways(settled(alike_classes(of, w))).join(of.select("block", F.col("text").alias("b"), F.col("n").alias("m")), ["block", "b"])
    per_class = of.join(near.groupBy("block", F.col("a").alias("text")).agg(F.sum("m").alias("m")), ["block", "text"], "left")
    counted = per_class.select("block", "text", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n"))
    keyed = entities.select("id", F.struct(*block).alias("block"), F.lower("entity_text").alias("text"))
    return keyed.join(counted, ["block", "text"]).select("id", "n")


def _first_alike(rows: DataFrame, of: DataFrame, least: float, most: int) -> DataFrame:
    """(id, other_id, text_score, near): the first ``most`` others with an alike text, by id, and the cosine of both embeddings;
    members of a class share a short list."""
    members = rows.select("block", "text", "id").withColumn("p", _place("block", "text")).where(F.col("p") <= most + 1).drop("p")
    near = both_ways(settled(similar_classes(of, least))).select("block", F.col("a").alias("text"), F.col("b").alias("other"), F.col("score").alias("text_score"))
    links = near.unionByName(of.select("block", "text", F.col("text").alias("other"), F.lit(1.0).alias("text_score")))
    listed = links.join(members.select("block", F.col("text").alias("other"), F.col("id").alias("other_id")), ["block", "other"])
    short = listed.withColumn("p", _place("block", "text", order="other_id")).where(F.col("p") <= most + 1).select("block", "text", "other_id", "text_score")
    own, cosines = ["block", "text", "id"], F.lit(None).cast("double")
    if "embedding" in rows.columns:
        short = short.join(rows.select(F.col("id").alias("other_id"), F.col("embedding").alias("other_embedding")), "other_id")
        own, cosines = [*own, "embedding"], cosine(F.col("embedding"), F.col("other_embedding"))
    # a cosine is dear beside a row's bytes, so rows are dealt anew, not by the files that hold them
    found = rows.select(*own).repartition(_width(rows), "id").join(settled(short), ["block", "text"])
    return found.where("id <> other_id").select("id", "other_id", "text_score", cosines.alias("near"))


def _first_differing(rows: DataFrame, most: int, listed: int = 16) -> DataFrame:
    """(id, other_id): for each entity and property the first ``most`` others, by id, whose value differs from its own.

    Entities of one value share what is found.  A property's list holds ``most`` ids of each value, in order; values
    look at its first ``listed`` places, and only those that did not find enough go on to the next, four times as many."""
    values = rows.where("properties IS NOT NULL").select("block", "id", F.explode("properties").alias("key", "value")).where("value IS NOT NULL")
    few = settled(values.withColumn("p", _place("block", "key", "value")).where(F.col("p") <= most))
    pending = few.where("p = 1").select("block", "key", "value").withColumn("found", F.lit(0))
    few = few.drop("p")
    out, lo, hi = None, 0, listed
    while True:
        ranked = few.withColumn("p", _place("block", "key")).where(F.col("p") <= hi).where(F.col("p") > lo)
        window = settled(ranked.select("block", "key", "p", F.col("id").alias("other_id"), F.col("value").alias("other_value")))
        if window.isEmpty():
            break
        met = pending.join(window, ["block", "key"]).where(word_and_letter(F.col("value"), F.col("other_value")) < 0.7)
        found = settled(met.select("block", "key", "value", "other_id", "found").withColumn("p", _place("block", "key", "value", order="other_id")).where(F.col("p") + F.col("found") <= most))
        new = found.select("block", "key", "value", "other_id")
        out = new if out is None else out.unionAll(new)
        counted = found.groupBy("block", "key", "value").agg(F.count("*").alias("more"))
        pending = settled(pending.join(counted, ["block", "key", "value"], "left").withColumn("found", F.col("found") + F.coalesce("more", F.lit(0))).drop("more").where(F.col("found") < most))
        if pending.isEmpty():
            break
        lo, hi = hi, hi * 4
    return values.join(out, ["block", "key", "value"]).select("id", "other_id") if out is not None else rows.select("id", F.col("id").alias("other_id")).limit(0)


def conflicts(entities: DataFrame, block: list[str], least: float = 0.8, embedding_least: float = 0.9, most: int = 5) -> DataFrame:
    """(entity_id, other_id, conflict_type, score): for each entity the first ``most`` others of its block, by id, that
    conflict with it.

    Texts that score ``least`` are a possible duplicate; if both sides have embeddings with a cosine of
    ``embedding_least``, a high-confidence duplicate with the mean of both scores.  Otherwise common properties
    that differ are inconsistent attributes, at 0.7.  ``properties`` and ``embedding`` may be missing or null.

    Whoever is listed conflicts, and one that is alike, but beyond the list of those, is beyond the first ``most`` as
    well.  So pairs carry their scores and no entity is fetched again."""
    extra = [c for c in ("properties", "embedding") if c in entities.columns]
    rows = entities.where("id IS NOT NULL").select("id", F.lower("entity_text").alias("text"), F.struct(*block).alias("block"), *extra)
    met = _first_alike(rows, classes(entities, block), least, most)
    if "properties" in extra:
        none = F.lit(None).cast("double")
        met = met.unionAll(_first_differing(rows, most).select("id", "other_id", none, none))
    scored = met.repartition(_width(rows), "id").groupBy("id", "other_id").agg(F.max("text_score").alias("text_score"), F.max("near").alias("near"))
    told = scored.withColumn("p", _place("id", order="other_id")).where(F.col("p") <= most)
    sure = F.col("text_score").isNotNull() & F.coalesce(F.col("near") >= embedding_least, F.lit(False))
    kind = F.when(sure, "high_confidence_duplicate").when(F.col("text_score").isNotNull(), "possible_duplicate").otherwise("inconsistent_attributes")
    score = F.when(sure, (F.col("text_score") + F.col("near")) / 2).otherwise(F.coalesce("text_score", F.lit(0.7)))
    return told.select(F.col("id").alias("entity_id"), "other_id", kind.alias("conflict_type"), score.alias("score"))


def duplicates_by_mean(entities: DataFrame, block: list[str], least: float = 0.85) -> DataFrame:
    """(a_id, b_id, score, severity): duplicates by the mean of four scores: equal texts, the sequence ratio of texts, the
    cosine of embeddings (0 where one is missing) and the likeness of properties.

    Entities that agree in text, embedding and properties are one and stand under their smallest id; see
    ``same_entities``.  Unequal texts reach 0.75 at most, so above that only equal texts meet; below it, texts
    whose ratio alone can still lift the mean, by the join over pieces (``least`` above 0.625)."""
    one = _distinct(entities, block).select("block", "text", F.col("rep").alias("id"), "properties", "embedding")
    if least > 0.75:
        a, b = (one.select("block", "text", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "properties", "embedding")]) for s in ("a", "b"))
        met = a.join(b, ["block", "text"]).where("a_id < b_id").withColumns({"same": F.lit(1.0), "ratio": F.lit(1.0)})
    else:
        texts = one.groupBy("block", "text").agg(F.min("id").alias("place")).select("block", F.col("text").alias("item"), "place")
        texts = alike.measured(texts)
        near = alike.pairs(texts, texts, 4 * least - 2).select("block", F.col("leader").alias("x"), F.col("item").alias("y"))
        links = near.unionAll(one.select("block", F.col("text").alias("x"), F.col("text").alias("y")).distinct())
        side = lambda s, t: one.select("block", F.col("text").alias(t), *[F.col(c).alias(f"{s}_{c}") for c in ("id", "properties", "embedding")])
        met = links.join(side("a", "x"), ["block", "x"]).join(side("b", "y"), ["block", "y"]).where("x <> y OR a_id < b_id")
        met = met.withColumn("same", (F.col("x") == F.col("y")).cast("double")).withColumn("ratio", sequence_ratio(F.when(F.col("a_id") < F.col("b_id"), F.col("x")).otherwise(F.col("y")), F.when(F.col("a_id") < F.col("b_id"), F.col("y")).otherwise(F.col("x"))))
    semantic = F.coalesce(F.when(F.col("a_embedding").isNotNull() & F.col("b_embedding").isNotNull(), cosine(F.col("a_embedding"), F.col("b_embedding"))), F.lit(0.0))
    scored = met.withColumn("semantic", semantic).where((F.col("same") + F.col("ratio") + F.col("semantic") + 1) / 4 >= least)
    scored = scored.withColumn("score", (F.col("same") + F.col("ratio") + F.col("semantic") + mean_likeness(F.col("a_properties"), F.col("b_properties"))) / 4)
    return scored.where(F.col("score") >= least).select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "score", severity(F.col("score")).alias("severity"))


def _distinct(entities: DataFrame, block: list[str]) -> DataFrame:
    sorted_map = F.array_sort(F.map_entries("properties"))
    return entities.groupBy(F.struct(*block).alias("block"), F.lower("entity_text").alias("text"), "embedding", sorted_map.alias("entries")).agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("properties", F.map_from_entries("entries"))


def same_entities(entities: DataFrame, block: list[str]) -> DataFrame:
    """(rep, n): entities that agree in everything ``duplicates_by_mean`` looks at, under their smallest id."""
    return _distinct(entities, block).select("rep", "n")
