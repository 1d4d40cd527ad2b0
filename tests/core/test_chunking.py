"""Chunks and what is found in them."""

from entigraph.operators import chunking


def test_no_side_of_related_entities_is_broadcast(spark):
    """Exploded rows look as small as their file; sent to all tasks they outgrow the driver."""
    chunks = spark.createDataFrame([(1, 0, "Anna Bell is at BIDV. Carl Low pays 5 USD!")], "doc_id long, chunk_index int, chunk string")
    related = chunking.related_in_sentences(chunking.entity_spans(chunks), chunking.sentences(chunks))
    assert "Broadcast" not in related._jdf.queryExecution().executedPlan().toString()
    pairs = [(r.source_text, r.target_text, r.relationship_type) for r in related.collect()]
    assert ("Anna Bell is", "BIDV", "associated_with") in pairs
    assert not any(s.startswith("Anna") and t.startswith(("Carl", "5 USD")) for s, t, _ in pairs)


def test_chunks_leave_in_pieces(spark, monkeypatch):
    """One batch of documents comes out as many bounded ones, whole and in order."""
    monkeypatch.setattr(chunking, "PIECE_ROWS", 4)
    monkeypatch.setattr(chunking, "PIECE_CHARS", 3000)
    sent = []

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            import pyarrow as pa

            batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a" * 9000, None, "b" * 10])], names=["doc_id", "text"])
            sent.extend(run(iter([batch])))

    chunking.chunked(Docs(), chunking.cut_at_ends, size=1000, overlap=200)
    assert len(sent) > 2 and all(b.num_rows <= 4 for b in sent)
    rows = [tuple(r.values()) for b in sent for r in b.to_pylist()]
    assert rows == [(1, i, c) for i, c in enumerate(chunking.cut_at_ends("a" * 9000))] + [(3, 0, "b" * 10)]
