"""Integer vectors dealt to parts, and exact inner products of them in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, partitions

#: About so many rows make a part, which one task holds at a time.
PART_ROWS = 65_536
#: So many queries at most go to every part at a time.
QUERY_ROWS = 100_000
#: Scores beyond this or its negative become it, so that differences of two scores are longs.
MOST = 2**62 - 1


def integer_vectors(rows: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = None) -> DataFrame:
    """(id, label, v): every vector as floor(scale * x) of its components x, taken as doubles; label is null without a
    column of labels. Rows whose vector is null or holds a null or non-finite component go. An integer beyond a long
    becomes the nearest long."""
    label = F.col(label_col).cast("long") if label_col else F.lit(None).cast("long")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return rows.filter(finite).select("id", "label", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def deal(vectors: DataFrame, tables: Stored, name: str, ask: F.Column) -> tuple[DataFrame, int, int]:
    """The vectors with row (a number of its own for each row), ask (whether it is a query), block (of queries) and part,
    stored in buckets by part; the number of parts, and of blocks of queries. Parts are dealt by a hash of the row number, so they are even
    whatever ids, labels and vectors repeat. Two counts reach the driver."""
    vectors = vectors.withColumns({"ask": F.coalesce(ask, F.lit(False)), "row": F.monotonically_increasing_id()})
    n, asks = vectors.agg(F.count("*"), F.count_if("ask")).first()
    parts = max(partitions(vectors.sparkSession), -(-n // PART_ROWS))
    blocks = max(1, -(-asks // QUERY_ROWS))
    vectors = vectors.withColumns({"part": F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"), "block": F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks)).cast("int")})
    return tables.put_buckets(vectors.repartition(parts, "part"), name, "part", parts), parts, blocks


def to_parts(asks: DataFrame, parts: int) -> DataFrame:
    """The rows of a block of queries, once for each part."""
    return asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def largest_square(vectors: DataFrame) -> int:
    """No inner product of two of the vectors is above this number, nor below its negative. One row reaches the driver."""
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    most = vectors.agg(F.max(square)).first()[0] or 0.0
    return min(MOST, int(most * (1 + 1e-9)) + 1)


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """A column of integer lists as rows of a matrix; what a shorter list lacks counts as zero."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width or 0, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def floats(*sides: np.ndarray) -> list[np.ndarray]:
    """The matrices in the narrowest type in which products of their rows are exact: single or double precision, else
    Python's integers."""
    most = [float(np.abs(s.astype(np.float64)).max(initial=0.0)) for s in sides]
    size = max(most, default=0.0) ** 2 * max(1, sides[0].shape[1])
    return [s.astype(np.float32 if size < 2**24 else np.float64 if size < 2**53 else object) for s in sides]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, of the type of floats(), as longs between -MOST and MOST."""
    out = a @ b.T
    return np.clip(out, -MOST, MOST).astype(np.int64) if out.dtype == object else out.astype(np.int64)


def integers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def order_of_ids(ids: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """The order of rows by id, nulls last, then by row number."""
    null = ids.is_null().to_numpy()
    return np.lexsort((rows, ids.fill_null(0).to_numpy(), null))


def own_places(candidates: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """For each asking row, where it lies among the candidates' row numbers, or -1."""
    if not len(candidates):
        return np.full(len(asks), -1)
    order = np.argsort(candidates)
    at = order[np.minimum(np.searchsorted(candidates, asks, sorter=order), len(order) - 1)]
    return np.where(candidates[at] == asks, at, -1)

