"""Documents into chunks with character offsets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed value: where a sentence ends.
_BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_SPANS = "array<struct<start:int,end:int,text:string>>"


def _check(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("overlap must be at least 0 and less than size")


def pack(text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, text) of the chunks of one text, offsets in the stripped text. Sentences are packed greedily, each
    counting one more than its length; a full chunk hands its last few on to the next, if it has more than that."""
    text = text.strip()
    if not text:
        return []
    spans, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        a, b = at, m.start() if m else len(text)
        part = text[a:b]
        if part.strip():
            a += len(part) - len(part.lstrip())
            spans.append((a, a + len(part.strip())))
        at = m.end() if m else b
    if len(text) <= size or len(spans) == 1:
        return [(0, len(text), text)]
    carry = max(1, overlap // max(1, size // len(spans)))
    total, cuts, first = [0], [], 0
    for a, b in spans:
        total.append(total[-1] + b - a + 1)
    for i in range(len(spans)):
        if i > first and total[i + 1] - total[first] > size:
            cuts.append((first, i))
            first = i - carry if i - first > carry else i
    cuts.append((first, len(spans)))
    return [(spans[i][0], spans[j - 1][1], " ".join(text[a:b] for a, b in spans[i:j])) for i, j in cuts]


def _finish(spans: DataFrame, size: int, overlap: int) -> DataFrame:
    return spans.select(
        F.sha2(F.concat_ws("\x01", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")), 256).alias("id"), "document_id", "chunk_index",
        F.col("span.text").alias("text"), F.col("span.start").alias("start_offset"), F.col("span.end").alias("end_offset"), T.estimate_tokens(F.col("span.text")).alias("token_count"),
        F.struct(F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap")).alias("extra_data"),
    )


def chunk_sentences(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "id", text_col: str = "abstract", text_mode: str = "joined") -> DataFrame:
    """Chunks of whole sentences. text_mode "slice" takes the text between the offsets instead of sentences joined by a
    blank. One narrow Arrow pass; documents without text have no chunks."""
    _check(size, overlap)

    @F.pandas_udf(_SPANS)
    def spans(text: pd.Series) -> pd.Series:
        def one(t):
            t = t or ""
            return [{"start": a, "end": b, "text": x if text_mode == "joined" else t.strip()[a:b]} for a, b, x in pack(t, size, overlap)]

        return text.map(one)

    return _finish(docs.select(F.col(id_col).alias("document_id"), F.posexplode(spans(text_col)).alias("chunk_index", "span")), size, overlap)


def chunk_chars(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "id", text_col: str = "abstract") -> DataFrame:
    """Windows of size characters every size - overlap; the first that reaches the end is the last."""
    _check(size, overlap)
    text = T.strip(F.col(text_col))
    docs = docs.select(F.col(id_col).alias("document_id"), text.alias("t")).filter("t <> ''").withColumn("n", F.char_length("t"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("n") - size) / (size - overlap)) * (size - overlap)).cast("int"), F.lit(size - overlap))
    docs = docs.select("document_id", "t", "n", F.posexplode(starts).alias("chunk_index", "at"))
    span = F.struct(F.col("at").alias("start"), F.least("n", F.col("at") + size).alias("end"), F.substring("t", F.col("at") + 1, F.lit(size)).alias("text"))
    return _finish(docs.withColumn("span", span), size, overlap)


def _has_text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def chunk_pending(docs: DataFrame, chunks: DataFrame, replace: bool = False, size: int = 1000, overlap: int = 200) -> DataFrame:
    """All chunks after chunking the documents that have text and no chunks yet, or, with replace, all that have text."""
    todo = docs.filter(_has_text("abstract"))
    if replace:
        kept = chunks.join(todo.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    else:
        todo, kept = todo.join(chunks.select(F.col("document_id").alias("id")), "id", "left_anti"), chunks
    return kept.unionByName(chunk_sentences(todo, size, overlap), allowMissingColumns=True)


def chunking_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    d = docs.join(chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"), F.sum("token_count").alias("tokens")), "id", "left")
    row = d.agg(F.count("*").alias("documents"), F.count_if(_has_text("abstract")).alias("with_abstract"), F.count("n").alias("chunked"), F.count_if(_has_text("abstract") & F.col("n").isNull()).alias("needing"), *(F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("n", "chunks"), ("chars", "total_chars"), ("tokens", "total_tokens"))))
    return row.withColumn("avg_chunks", F.when(F.col("chunked") > 0, F.col("chunks") / F.col("chunked")).otherwise(0.0))


def document_chunks(chunks: DataFrame, evidence: DataFrame, document_id) -> DataFrame:
    used = evidence.select(F.col("chunk_id").alias("id")).distinct().withColumn("has_extractions", F.lit(True))
    return chunks.filter(F.col("document_id") == document_id).join(used, "id", "left").withColumn("has_extractions", F.coalesce("has_extractions", F.lit(False))).orderBy("chunk_index")


def chunk_at_offset(chunks: DataFrame, positions: DataFrame, first: bool = False) -> DataFrame:
    """positions (document_id, offset) with the chunks that hold them; overlapping chunks all, or the first."""
    found = chunks.join(positions, "document_id").filter("start_offset <= offset and offset < end_offset")
    found = found.withColumn("relative", F.col("offset") - F.col("start_offset"))
    if not first:
        return found
    best = found.groupBy("document_id", "offset").agg(F.min("chunk_index").alias("chunk_index"))
    return found.join(best, ["document_id", "offset", "chunk_index"], "left_semi")


def preview_chunks(docs: DataFrame, n: int = 5, **options) -> DataFrame:
    return chunk_sentences(docs.orderBy("id").limit(n), **options)
