"""Cutting documents into chunks, and extracting entities and relations from them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Patterns by type, matched in either case.
ENTITY_PATTERNS = {
    "Bank": r"\b(VietinBank|BIDV|Vietcombank|ACB|MB Bank|Techcombank|VPBank|HD Bank|TPBank|SeABank|VIB|OCB)\b",
    "Person": r"\b([A-Z][a-z]+ [A-Z][a-z]+(?:\s[A-Z][a-z]+)?)\b",
    "Account": r"\b(\d{10,14})\b",
    "Money": r"\b(\d+(?:,\d+)*(?:\.\d+)?(?:\s?(?:VND|USD|triệu đồng|tỷ đồng)))\b",
    "Date": r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b",
    "Product": r"\b(thẻ tín dụng|thẻ ghi nợ|tiết kiệm|vay thế chấp|vay tín chấp|bảo hiểm nhân thọ|quỹ đầu tư)\b",
}
#: Relation of two types that stand in one sentence, in that order.
PAIR_RELATIONS = {
    ("Person", "Bank"): "associated_with",
    ("Bank", "Person"): "serves",
    ("Person", "Account"): "has_account",
    ("Account", "Person"): "belongs_to",
    ("Bank", "Product"): "offers",
    ("Product", "Bank"): "offered_by",
    ("Person", "Product"): "uses",
    ("Product", "Person"): "used_by",
}
#: Fixed values: (pattern, type of the source, type of the target, relation), matched in either case.
RELATION_PATTERNS = (
    (r"(.*)\s(mở|có|sở hữu)\s(.*)\stại\s(.*)", "Person", "Account", "owns_account"),
    (r"(.*)\s(chuyển|gửi)\s(.*)\scho\s(.*)", "Person", "Person", "transfers_money_to"),
    (r"(.*)\s(là khách hàng của|sử dụng dịch vụ của)\s(.*)", "Person", "Bank", "is_customer_of"),
    (r"(.*)\s(cung cấp|phát hành)\s(.*)\scho\s(.*)", "Bank", "Person", "provides_product_to"),
)


def fixed_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, chunk_index, chunk): windows of ``size`` characters, each ``size - overlap`` after the last."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length("text") - overlap) / step).cast("int") - 1, F.lit(0))
    at = F.when(F.length("text") > 0, F.sequence(F.lit(0), last))
    return docs.select("doc_id", "text", F.posexplode(at).alias("chunk_index", "_k")).select("doc_id", "chunk_index", F.expr(f"substring(text, _k * {step} + 1, {size})").alias("chunk"))


def paragraphs(docs: DataFrame, each: int = 5) -> DataFrame:
    """(doc_id, chunk_index, chunk): paragraphs (blank lines between), ``each`` of them a chunk."""
    parts = F.filter(F.split("text", r"\n\s*\n"), lambda p: F.trim(p) != "")
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("p") / each).cast("int") - 1, F.lit(0))), lambda k: F.array_join(F.slice("p", k * each + 1, each), "\n\n"))
    return docs.select("doc_id", parts.alias("p")).where(F.size("p") > 0).select("doc_id", F.posexplode(groups).alias("chunk_index", "chunk"))


def pack_sentences(text: str, size: int = 1000, overlap: int = 200, least: int = 100) -> list[str]:
    """Sentences packed to ``size``; a chunk begins with the last ``overlap`` characters of the one before."""
    out, chunk = [], ""
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        if chunk and len(chunk) + len(sentence) > size:
            if len(chunk) >= least:
                out.append(chunk)
            chunk = chunk[-overlap:] + sentence
        else:
            chunk = f"{chunk} {sentence}" if chunk else sentence
    if len(chunk) >= least:
        out.append(chunk)
    return out or ([text] if len(text) >= least else [])


def cut_at_ends(text: str, size: int = 1000, overlap: int = 200, spaced: bool = False) -> list[str]:
    """Cut at the first sentence end within 100 characters of ``size``; ``spaced``: white space must follow it."""
    if size <= overlap + 100:
        raise ValueError("size must be over overlap + 100")
    if len(text) <= size:
        return [text] if text else []
    pattern = re.compile(r"[.!?\n](?=\s)" if spaced else r"[.!?\n]")
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            found = pattern.search(text, max(end - 100, start), min(end + 100, len(text)))
            end = found.end() if found else end
        out.append(text[start:end])
        if end >= len(text):
            break
        start = end - overlap
    return out


def chunked(docs: DataFrame, how: Callable[..., list[str]], **options) -> DataFrame:
    """(doc_id, chunk_index, chunk) by one of the rules above, in Arrow batches."""

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        return ((d, i, c) for d, t in rows for i, c in enumerate(how(t or "", **options)))

    kinds = {"doc_id": pa.int64(), "chunk_index": pa.int32(), "chunk": pa.string()}
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_in_pieces(cut, kinds), "doc_id long, chunk_index int, chunk string")


#: Rows, and characters of text, that a task of Python makes before it sends them.
PIECE_ROWS, PIECE_CHARS = 2048, 1 << 20


def _in_pieces(rows_of: Callable[[Iterator[tuple]], Iterator[tuple]], kinds: dict[str, pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows made of a batch's rows one after the other, the last of ``kinds`` or ``entity_text`` being a text: a batch is
    never made into Python values whole, and what is made of it leaves in pieces."""
    names, at = list(kinds), list(kinds).index("entity_text") if "entity_text" in kinds else len(kinds) - 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds.values())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, chars = [], 0
            for row in rows_of(tuple(c[j].as_py() for c in batch.columns) for j in range(batch.num_rows)):
                held.append(row)
                chars += len(row[at])
                if len(held) >= PIECE_ROWS or chars >= PIECE_CHARS:
                    yield batch_of(held)
                    held, chars = [], 0
            if held:
                yield batch_of(held)

    return run


def records_in_chunks(rows: DataFrame, key: str, each: int = 50) -> DataFrame:
    """``rows`` (structured records with an array column ``items``) as chunks of ``each`` items."""
    n = F.greatest(F.ceil(F.size("items") / each).cast("int") - 1, F.lit(0))
    return rows.where(F.size("items") > 0).select(key, F.posexplode(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice("items", k * each + 1, each))).alias("chunk_index", "chunk"))


def entity_values(docs: DataFrame, patterns: dict[str, str] = ENTITY_PATTERNS) -> DataFrame:
    """(doc_id, entity_type, entity_text): every match of each pattern, without places, in the JVM and in one scan."""
    typed = lambda kind: lambda x: F.struct(F.lit(kind).alias("entity_type"), x.alias("entity_text"))
    found = [F.transform(F.regexp_extract_all("text", F.lit(f"(?iuU){pattern}"), F.lit(0)), typed(kind)) for kind, pattern in patterns.items()]
    return docs.select("doc_id", F.explode(F.concat(*found)).alias("e")).select("doc_id", "e.entity_type", "e.entity_text")


def entity_spans(chunks: DataFrame, patterns: dict[str, str] = ENTITY_PATTERNS, confidence: float = 0.6) -> DataFrame:
    """Matches with their places: doc_id, chunk_index, entity_text, entity_type, start, end, confidence."""

    def spans(rows: Iterator[tuple]) -> Iterator[tuple]:
        compiled = {k: re.compile(p, re.I) for k, p in patterns.items()}
        return ((d, i, m[0], k, m.start(), m.end(), confidence) for d, i, t in rows for k, p in compiled.items() for m in p.finditer(t))

    kinds = {"doc_id": pa.int64(), "chunk_index": pa.int32(), "entity_text": pa.string(), "entity_type": pa.string(), "start_position": pa.int32(), "end_position": pa.int32(), "confidence": pa.float64()}
    rows = chunks.select(F.col("doc_id").cast("long"), F.col("chunk_index").cast("int"), "chunk")
    return rows.mapInArrow(_in_pieces(spans, kinds), "doc_id long, chunk_index int, entity_text string, entity_type string, start_position int, end_position int, confidence double")


def sentences(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, sentence_no, start, end): spans between sentence ends, in the JVM."""
    pieces = chunks.select("doc_id", "chunk_index", F.posexplode(F.split("chunk", r"[.!?]", -1)).alias("sentence_no", "piece"))
    sized = pieces.select("doc_id", "chunk_index", "sentence_no", F.length("piece").alias("size"))
    upto = Window.partitionBy("doc_id", "chunk_index").orderBy("sentence_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = (F.sum("size").over(upto) + F.col("sentence_no")).cast("int")
    return sized.select("doc_id", "chunk_index", "sentence_no", (end - F.col("size")).alias("start"), end.alias("end"))


def _ends_of(about: list[Column]) -> Callable[[Column, Column], Column]:
    return lambda s, t: F.struct(F.lower(F.trim(s)).alias("source"), F.lower(F.trim(t)).alias("target"), *about)


def relations_by_pattern(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, source_text, target_text, relationship_type, confidence): relations told by a verb.

    A pattern needs four groups to tell one; its first and third are the ends, and each end has to be matched with an
    entity of its type in the chunk: the first whose text is the same, else the first that contains the end or is
    contained in it, in either case.  ``found`` holds doc_id, chunk_index, entity_text, entity_type, start_position.
    Chunks are read once; patterns are tried only where their verb stands."""
    told = []
    for pattern, source, target, kind in RELATION_PATTERNS:
        if re.compile(pattern).groups < 4:
            continue
        verb = re.search(r"\\s\([^()]*\)\\s", pattern)[0]
        group = lambda i, p=f"(?iuUd){pattern}": F.regexp_extract_all("chunk", F.lit(p), F.lit(i))
        about = [F.lit(source).alias("source_type"), F.lit(target).alias("target_type"), F.lit(kind).alias("relationship_type")]
        ends = F.zip_with(group(1), group(3), _ends_of(about))
        told.append(F.when(F.col("chunk").rlike(f"(?iuU){verb}"), ends))
    rows = chunks.select("doc_id", "chunk_index", F.posexplode(F.flatten(F.filter(F.array(*told), lambda x: x.isNotNull()))).alias("nth", "r")).select("doc_id", "chunk_index", "nth", "r.*")
    for end in ("source", "target"):
        own = found.select("doc_id", "chunk_index", F.col("entity_type").alias(f"{end}_type"), "entity_text", "start_position")
        text = F.lower("entity_text")
        fits = (text == F.col(end)) | F.contains(text, F.col(end)) | F.contains(F.col(end), text)
        met = rows.join(own, ["doc_id", "chunk_index", f"{end}_type"]).where(fits)
        first = F.min_by("entity_text", F.struct(text != F.col(end), F.col("start_position"))).alias(f"{end}_text")
        rows = met.groupBy(*rows.columns).agg(first)
    return rows.select("doc_id", "chunk_index", "source_text", "target_text", "relationship_type", F.lit(0.6).alias("confidence"))


def related_in_sentences(found: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, source_text, target_text, relationship_type, confidence): entities of different
    types within one sentence, in order; the type by the pair of types, else related_to.

    Sides are merged, never broadcast: both come from exploded rows, which Spark takes to be as small as the file
    they were made of."""
    inside = found.join(spans.hint("merge"), ["doc_id", "chunk_index"]).where((F.col("start_position") >= F.col("start")) & (F.col("end_position") <= F.col("end")))
    a = inside.select("doc_id", "chunk_index", "sentence_no", *[F.col(c).alias(f"a_{c}") for c in ("entity_text", "entity_type", "start_position")])
    b = inside.select("doc_id", "chunk_index", "sentence_no", *[F.col(c).alias(f"b_{c}") for c in ("entity_text", "entity_type", "start_position")])
    pairs = a.join(b.hint("merge"), ["doc_id", "chunk_index", "sentence_no"]).where("a_start_position < b_start_position AND a_entity_type <> b_entity_type")
    kind = F.lit("related_to")
    for (x, y), name in PAIR_RELATIONS.items():
        kind = F.when((F.col("a_entity_type") == x) & (F.col("b_entity_type") == y), name).otherwise(kind)
    return pairs.select("doc_id", "chunk_index", F.col("a_entity_text").alias("source_text"), F.col("b_entity_text").alias("target_text"), kind.alias("relationship_type"), F.lit(0.5).alias("confidence"))


def in_document_totals(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, n_entities)."""
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    e = found.groupBy("doc_id").agg(F.count("*").alias("n_entities"))
    return c.join(e, "doc_id", "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))


def word_counts(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))
