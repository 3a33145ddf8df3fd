"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, give_back
from .vectors import deal, floats, integer_vectors, integers, largest_square, matrix, order_of_ids, own_places, products, to_parts

BINS = 1024
#: Scores of so many queries and candidates are laid out at a time.
_ROWS, _COLUMNS = 256, 4096
_HITS = "q long, query_id long, vec_id long, row long, score long"


def _blocks(cands: pa.Table, asks: pa.Table):
    """(slice of queries, slice of candidates in order of id, their scores, which scores are a query's own) for all of them."""
    rows = integers(cands["row"])
    order = order_of_ids(cands["id"], rows)
    c, q = matrix(cands["v"]), matrix(asks["v"])
    width = max(c.shape[1], q.shape[1])
    c, q = floats(*(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (c[order], q)))
    own = own_places(rows[order], integers(asks["row"]))
    for a in range(0, len(q), _ROWS):
        for b in range(0, len(c), _COLUMNS):
            scores = products(q[a : a + _ROWS], c[b : b + _COLUMNS])
            at = own[a : a + _ROWS] - b
            inside = np.flatnonzero((at >= 0) & (at < scores.shape[1]))
            yield slice(a, a + scores.shape[0]), order[b : b + _COLUMNS], scores, (inside, at[inside])


def _histograms(span: int, width: int, k: int):
    """Counts the scores of a part from each query's `low` on, up to a span, in bins of a width. Bins are sent from the top until
    they hold what the query still needs: no lower one can hold the kth value of all parts."""

    def run(cands: pa.Table, asks: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if len(cands) and len(asks):
            q, low, need = integers(asks["row"]), integers(asks["low"]), k - integers(asks["above"])
            counts, at = None, None
            for here, _, scores, own in _blocks(cands, asks):
                if at is None or here.start != at.start:
                    found += _sent(counts, need, q, at)
                    counts, at = np.zeros((scores.shape[0], BINS), np.int64), here
                over = scores - low[here, None]
                bins, inside = over // width, (over >= 0) & (over < span)
                inside[own] = False
                counts += np.bincount((bins + np.arange(len(bins))[:, None] * BINS)[inside], minlength=counts.size).reshape(counts.shape)
            found += _sent(counts, need, q, at)
        give_back()
        q, bins, n = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        return pa.table({"q": q, "bin": bins, "n": n})

    return run


def _sent(counts, need, q, at):
    if counts is None:
        return []
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
    i, b = np.nonzero((counts > 0) & (above < need[at, None]))
    return [(q[at][i], b, counts[i, b])]


def _hits(k: int):
    """What lies above each query's kth value, and of what equals it the first by id that it needs."""

    def run(cands: pa.Table, asks: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if len(cands) and len(asks):
            q, low, need = integers(asks["row"]), integers(asks["low"]), k - integers(asks["above"])
            equal = np.zeros(len(q), np.int64)  # so far
            for here, places, scores, own in _blocks(cands, asks):
                keep = scores >= low[here, None]
                keep[own] = False
                tie = keep & (scores == low[here, None])
                nth = np.cumsum(tie, axis=1) + equal[here, None]
                keep &= ~tie | (nth <= need[here, None])
                equal[here] += tie.sum(axis=1)
                i, j = np.nonzero(keep)
                found.append((i + here.start, places[j], scores[i, j]))
        give_back()
        i, j, scores = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        a, c = asks.take(i), cands.take(j)
        return pa.table({"q": a["row"], "query_id": a["id"], "vec_id": c["id"], "row": c["row"], "score": pa.array(scores, pa.int64())})

    return run


def exact_top_k(rows: DataFrame, queries: F.Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` (a condition on id) holds of, the k other rows with the highest
    integer inner products; all, if there are fewer. Ties go to the smaller id.

    Every query is scored against every row, in blocks: rows lie in parts, each block of queries goes to every part. A
    first pass counts scores in BINS bins over all values that there can be; counts of all parts are added up, which
    tells the bin that holds each query's kth value, and how many lie above it. Further passes count within that bin
    until a bin is one value. The last pass sends what lies above the kth value, and of ties as many a part as are
    needed, which are ranked. So a query sends a few bins or rows a part, however many rows tie with it.

    Rows are rows: a repeated id or row is a query and a candidate of its own, and only the query's own row is left out. Null ids
    are candidates, last among ties. Vectors that are null or hold null or non-finite components take no part. Vectors of
    unlike lengths are filled up with zeros. Scores beyond 2**62 - 1 or its negative become it. Other columns, whatever
    their names, are ignored; no rows or no queries give no rows.
    """
    spark = rows.sparkSession
    tables = Stored(spark)
    vectors = integer_vectors(rows, scale, id_col, vec_col)
    cands, parts, blocks = deal(vectors, tables, "topk-vectors", queries)
    most = largest_square(cands)
    cands_by_part, out = cands.select("part", "row", "id", "v").groupBy("part"), None
    for block in range(blocks):
        asks = cands.filter(F.col("ask") & (F.col("block") == block)).select("row", "id", "v")
        state = asks.withColumns({"low": F.lit(-most).cast("long"), "above": F.lit(0).cast("long")})
        span = 2 * most + 1
        while span > 1:
            width = -(-span // BINS)
            counts = cands_by_part.cogroup(to_parts(state, parts).groupBy("part")).applyInArrow(_histograms(span, width, k), "q long, bin long, n long")
            state, span = tables.put(_located(counts, state, width, k), "topk-state"), width
        hits = cands_by_part.cogroup(to_parts(state, parts).groupBy("part")).applyInArrow(_hits(k), _HITS)
        first = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        ranked = hits.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        done = tables.put(ranked.select("query_id", "rank", "vec_id", "score"), f"topk-{block}")
        out = done if out is None else out.union(done)
    tables.drop("topk-vectors", "topk-state")
    return out


def _located(counts: DataFrame, state: DataFrame, width: int, k: int) -> DataFrame:
    """The state of each query after a pass: where the bin with its kth value begins, and how many scores lie above
    it. A query with fewer than k scores goes on with the lowest bin that has any. A query has at most BINS rows here."""
    counts = counts.groupBy("q", "bin").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))) - F.col("n")
    counts = counts.withColumn("over", above).join(state.select(F.col("row").alias("q"), F.col("above").alias("before")), "q")
    found = counts.filter(F.col("over") + F.col("before") < k).groupBy("q").agg(F.min_by(F.struct("bin", "over"), "bin").alias("at"))
    state = state.join(found.withColumnRenamed("q", "row"), "row")
    return state.select("row", "id", "v", (F.col("low") + F.col("at.bin") * width).alias("low"), (F.col("above") + F.col("at.over")).alias("above"))
