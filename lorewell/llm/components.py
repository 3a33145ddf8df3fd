"""Connected components: tasks contract their edges, alternating large and small stars (DataFrame joins) connect tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, tidy

#: Edges that one task contracts, 16 bytes each.
EDGES = 1 << 20
_EDGE = "u long, v long"


def _least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the least node that each reaches over them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while len(a):
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (jumped := least[least]).tobytes() != least.tobytes():
            least = jumped
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[least]


def _contract(most: int):
    """Map step of edges (u, v): the stars that stand for each `most` edges of the task, about."""

    def stars(kept: list[np.ndarray]) -> pa.RecordBatch:
        node, least = _least(*np.concatenate(kept, axis=1))
        on = node > least
        return pa.RecordBatch.from_arrays([pa.array(node[on], pa.int64()), pa.array(least[on], pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            kept.append(np.stack([c.to_numpy() for c in batch.columns]))
            held += batch.num_rows
            if held > most:
                yield stars(kept)
                kept, held = [], 0
        if kept:
            yield stars(kept)

    return tidy(run)


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One star step over (u, v) with u > v. Every u learns the least of its neighbours and itself and links the
    larger (both: seen from either end) or the smaller ones to it."""
    if both:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = edges.join(least, "u")
    if both:
        out = out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame, tables: Stored | None = None, name: str = "roots", most: int = EDGES) -> DataFrame:
    """(node, root) for every node with a link (u, v): root is the least node it reaches. Tasks of about `most` edges
    replace theirs by stars. One task's are the result; those of more tasks are connected in rounds, each written to the
    shared folder, where only the last stays, as table `name` of tables; rounds end when a checksum of the edges stands
    still. Counts alone reach the driver."""
    tables = tables or Stored(links.sparkSession)
    edges = tables.put(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), f"{name}-stars")
    mark, tasks = None, 2
    while tasks > 1:
        tasks = 1 + edges.count() // most
        edges = tables.put(edges.coalesce(tasks).mapInArrow(_contract(most), _EDGE), f"{name}-stars")
        if tasks > 1:
            edges = tables.put(_star(_star(edges, True), False), f"{name}-stars")
            now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if now == mark:
                break
            mark = now
    out = tables.put(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", F.col("v").alias("root")).distinct()), name)
    tables.drop(f"{name}-stars")
    return out
