"""Language ID by nearest centroid over TF-IDF vectors of hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

BITS = 13
DIMS = 1 << BITS
_HASHES = 1 << 40
#: A model holds some centroids for each language, so there is a limit to their number; it is checked.
MOST_LANGS = 2000
_LETTER = regex.compile(r"\p{L}")
# Bytes that separate letters: all of ASCII but a-z after lower-casing.
_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[:128] = 32
_KEEP[97:123] = np.arange(97, 123)


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # rows of length 1
    floors: np.ndarray  # cosine below which a text is rejected, by centroid
    idf: np.ndarray


def ngram_counts(texts: list[str]) -> np.ndarray:
    """How often each hashed 2- and 3-gram of letter bytes occurs: one row of DIMS per text. A run of anything but
    letters counts as one blank, and each text stands between blanks."""
    parts = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    b = _KEEP[np.frombuffer(b"".join(parts), np.uint8)]
    edge = np.empty(len(b), bool)
    edge[:1] = True
    edge[1:] = owner[1:] != owner[:-1]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | edge[1:]
    b, owner = b[keep].astype(np.uint32), owner[keep]
    out = np.zeros(len(parts) * DIMS, np.int64)
    for n in (2, 3):
        if len(b) < n:
            continue
        m = len(b) - n + 1
        gram = sum(b[i : i + m] << np.uint32(8 * i) for i in range(n)) + np.uint32(n << 24)
        inside = owner[:m] == owner[n - 1 :]
        slot = (gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        out += np.bincount((owner[:m] * DIMS + slot)[inside], minlength=len(out))
    return out.reshape(len(parts), DIMS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def in_blocks(texts: list[str], most_chars: int = 1 << 20, most: int = 128) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts, whole, in blocks of bounded size; a longer text is a block of its own."""
    at, size, block = 0, 0, []
    for i, t in enumerate(texts):
        if block and (size + len(t) > most_chars or len(block) == most):
            yield at, block
            at, size, block = i, 0, []
        block.append(t)
        size += len(t)
    if block:
        yield at, block


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for _, block in in_blocks(batch.column(0).to_pylist()):
            total += (ngram_counts(block) > 0).sum(axis=0)
            n += len(block)
    slots = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1)), pa.array(np.append(total[slots], n))], ["slot", "n"])


def _cluster(v: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from the first row and then the rows farthest from all chosen ones; no randomness."""
    chosen, near = [0], v @ v[0]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    c = v[chosen]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.stack([v[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(labelled: DataFrame, per_lang: int = 600, clusters: int = 3, rounds: int = 8, false_reject: float = 0.002, slack: float = 0.9, seed: int = 5) -> Model:
    """Fit on (id, text, lang). Document frequencies cover all labelled rows. The centroids come from a bounded
    sample: of each language about `per_lang` different pairs of id and text, chosen by a hash of both, clustered in one task a
    language; pairs that repeat count once, whatever share of the rows they are. A language has one pair in it at least.
    A language's floor is `slack` times the cosine that a share `false_reject` of its sample lies below. The driver gets a number per
    n-gram slot and the centroids: `clusters` a language, however many rows there are."""
    spark = labelled.sparkSession
    labelled = labelled.filter("lang is not null and text is not null")
    rows = labelled.select("text").mapInArrow(tidy(_document_frequencies), "slot long, n long").groupBy("slot").agg(F.sum("n")).collect()
    found = dict(rows)
    df = np.zeros(DIMS)
    for slot, n in found.items():
        if slot >= 0:
            df[slot] = n
    idf = (np.log((1 + found.get(-1, 0)) / (1 + df)) + 1).astype(np.float32)
    labelled = labelled.withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "id", "text"), F.lit(_HASHES)))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.01).alias("pairs"), F.min("h").alias("least"))
    if sizes.count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    part = F.col("h") <= F.greatest(F.col("least"), F.least(F.lit(1.0), per_lang / F.col("pairs")) * _HASHES)

    def encode(batches):
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, block in in_blocks(texts):
                v = vectors(ngram_counts(block), idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array(langs[at : at + len(block)]), pa.array([x.tobytes() for x in v])], ["lang", "v"])

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack([np.frombuffer(x, np.float16) for x in sorted(pdf["v"])]).astype(np.float32)
        c = _cluster(v, clusters, rounds)
        floor = slack * float(np.quantile((v @ c.T).max(axis=1), false_reject))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "k": range(len(c)), "c": [x.astype(np.float32).tobytes() for x in c], "floor": floor})

    chosen = labelled.join(F.broadcast(sizes), "lang").filter(part).groupBy("lang", "h").agg(F.min("text").alias("text"))
    sample = chosen.select("text", "lang").mapInArrow(tidy(encode), "lang string, v binary")
    made = sorted(sample.groupBy("lang").applyInPandas(centroids, "lang string, k int, c binary, floor double").collect())
    return Model([r["lang"] for r in made], np.stack([np.frombuffer(r["c"], np.float32) for r in made]), np.array([r["floor"] for r in made]), idf) if made else Model([], np.zeros((0, DIMS), np.float32), np.zeros(0), idf)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected (columns of these names are replaced): the language of the nearest
    centroid and its cosine. `und` with score 0, rejected, if the text is null or has no letter, or nothing was learned;
    rejected too if the cosine is below the language's floor. The model, of fixed size, travels with the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "rejected")
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [t if t is not None and _LETTER.search(t) else "" for t in batch.column(at).to_pylist()]
            lang, score, rejected = [], [], []
            for _, block in in_blocks(texts):
                if not m.langs:
                    lang += ["und"] * len(block)
                    score += [0.0] * len(block)
                    rejected += [True] * len(block)
                    continue
                # In double precision and rounded: a product's last bits hang on how many texts the block has.
                cos = np.round(vectors(ngram_counts(block), m.idf).astype(np.float64) @ m.centroids.T.astype(np.float64), 9)
                best = cos.argmax(axis=1)
                for t, j, s in zip(block, best.tolist(), cos[np.arange(len(block)), best].tolist()):
                    lang.append(m.langs[j] if t else "und")
                    score.append(min(1.0, max(0.0, s)) if t else 0.0)
                    rejected.append(not t or s < m.floors[j])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*batch.schema.names, "lang_pred", "score", "rejected"])

    added = {"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double"), "rejected": F.lit(None).cast("boolean")}
    return docs.mapInArrow(tidy(run), docs.withColumns(added).schema)


def learn(docs: DataFrame, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the rows whose crc32 of the id as text is not held_out modulo folds."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return fit(docs.filter(~_out_of_fit("id", folds, held_out)))


def _out_of_fit(id_col: str, folds: int, held_out: int) -> F.Column:
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds) == held_out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learns from the rows with a language whose crc32 of the id as
    text is not `held_out` modulo `folds`, and predicts every row from its whole text alone.

    Null or letterless texts are `und`; null ids count as the text '' in the fold; rows without a language are only
    predicted; equal texts get equal results (ties go to the first language by name); repeated rows are predicted one
    by one; an empty table gives an empty result; other columns are ignored."""
    out = predict(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), learn(docs, folds, held_out, id_col, text_col, lang_col))
    return out.select("doc_id", _out_of_fit("doc_id", folds, held_out).alias("held_out"), "lang_pred", "score", "rejected")
