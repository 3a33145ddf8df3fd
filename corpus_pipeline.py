"""A training corpus in five stages: language, exact copies, near copies, mixture, pieces.

Every stage takes (spark, docs, sf_dir) and all that the one before it kept, and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the columns of documents.

Decisions are taken per row, not per doc_id: exact_copies, near_copies and mixture number the rows and join what was
decided back on that number. Null ids are ids like others (the smallest), rows that share an id are rows of their own,
and a row that is repeated whole is a copy of itself, of which one stays. Null and empty texts have no letter, so the
first stage drops them. Rows travel as one struct beside the number, so that columns of any name pass through. Stages
on a table without rows return one without rows.

What a stage returns must be written before any stage is called again in the application: that call deletes the
intermediate tables which the frame reads, unless it is that call's own docs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common, exact_dedup, jaccard, langid, mixing, pieces
from lorewell.llm.common import load, store

#: By application, the intermediate tables of the stage before, which are deleted when the next one begins: its docs have
#: been written by then.
_LEFT: dict[str, list[str]] = {}


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.pop(spark.sparkContext.applicationId, [])
        read = docs.inputFiles() if left else []  # docs that were not written still need their tables
        needed = [path for path in left if any(path.rsplit("/", 1)[1] in file for file in read)]
        common.remove(spark, *(path for path in left if path not in needed))
        mark = len(common.MADE)
        out = f(spark, docs, sf_dir)
        _LEFT[spark.sparkContext.applicationId] = needed + common.MADE[mark:]
        return out

    return run


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: those without letters, or farther from every centroid than all but a few
    rows that were learned from. Everything else stays, whatever its columns are called."""
    found = langid.predict(docs.select(F.struct("*").alias("doc"), "text"), langid.learn(docs))
    return found.filter(~F.col("rejected")).select("doc.*")


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): a number for each row, and the row. Written to the shared folder, so that a row has the same number
    wherever it is read."""
    return store(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "rows")


def _facts(rows: DataFrame) -> DataFrame:
    """(row, key, text, source); key orders like doc_id, nulls first, and is one row's."""
    return rows.select("row", F.struct(F.col("doc.doc_id").alias("doc_id"), "row").alias("key"), F.col("doc.text").alias("text"), F.col("doc.source").alias("source"))


def _kept(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select(F.col("doc_id.row").alias("row")), "row", "left_semi").select("doc.*")


@_stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal without white space, one stays: the longest, then the smallest id, nulls first."""
    rows = _numbered(docs)
    return _kept(rows, exact_dedup.exact_dedup(_facts(rows), id_col="key").filter("kept"))


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a word-shingle Jaccard similarity of 0.8 or more, the one with the smallest id stays, nulls
    first. Texts without words are linked with nothing and stay."""
    rows = _numbered(docs)
    return _kept(rows, jaccard.similar_groups(_facts(rows), id_col="key").filter("doc_id <=> component_id"))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. Null sources are one source, the last; texts without words are not taken."""
    rows = _numbered(docs)
    copies = mixing.mix_sources(_facts(rows), id_col="key", row_col="row").filter("copies > 0").select("row", "copies")
    return rows.join(copies, "row").select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts in pieces, and whether decoding gives them back; a null text would have null ids."""
    out = pieces.encode_texts(docs.select("doc_id", "lang", "source", "text"), decode_too=True)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("encoding", encoding)]

#: SQL cannot express the centroids, the components or the pieces: tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
