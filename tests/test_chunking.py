import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorewell.operators import chunking


def test_pack_rules():
    assert chunking.pack("", 10, 2) == []
    assert chunking.pack("  Short.  ", 1000, 200) == [(0, 6, "Short.")]
    text = "This is a sentence. " * 50
    chunks = chunking.pack(text, 100, 20)
    assert len(chunks) > 1 and all(text.strip()[a:b] == t for a, b, t in chunks)
    one = "no break " * 300
    assert chunking.pack(one, 100, 20) == [(0, len(one.strip()), one.strip())]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab c.", min_size=1, max_size=30).map(lambda s: "A" + s.strip() + "."), min_size=1, max_size=40), st.integers(5, 80))
def test_pack_covers_every_sentence(sentences, size):
    text = " ".join(sentences)
    chunks = chunking.pack(text, size, 2)
    assert chunks[0][0] == 0 and chunks[-1][1] == len(text.strip())
    assert all(a[0] < b[0] and b[0] <= a[1] + 1 for a, b in zip(chunks, chunks[1:]))


def test_chunks_in_spark(spark):
    docs = spark.createDataFrame([("a", "Aa bb. " * 40), ("b", ""), ("c", None), ("d", "x")], "id string, abstract string")
    rows = chunking.chunk_sentences(docs, 50, 10).orderBy("document_id", "chunk_index").collect()
    assert {r["document_id"] for r in rows} == {"a", "d"}
    assert [r["chunk_index"] for r in rows if r["document_id"] == "a"] == list(range(len(rows) - 1))
    chars = chunking.chunk_chars(docs, 50, 10).filter("document_id = 'a'").orderBy("chunk_index").collect()
    assert chars[-1]["end_offset"] == 279 and [r["start_offset"] for r in chars] == [40 * i for i in range(len(chars))]
    assert chunking.chunk_pending(docs, chunking.chunk_sentences(docs.filter("id = 'a'"), 50, 10), size=50, overlap=10).count() == len(rows)
    with pytest.raises(ValueError):
        chunking.chunk_chars(docs, 10, 10)
