"""Hard negatives by bounds along spanning trees of anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, give_back
from .vectors import deal, floats, integer_vectors, integers, matrix, order_of_ids, own_places, products, to_parts

#: About so many anchors make a tree.
TREE_ROWS = 512
#: Signs of so many random projections bring near anchors into one tree.
_BITS = 6
#: Candidates are walked through so many at a time.
_COLUMNS = 4096
_TREE = "tree string, row long, id long, label long, v array<long>, at int, parent int, edge double"


def _projections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = matrix(pa.chunked_array([batch.column("v")])).astype(np.float64)
        sign = v @ np.random.default_rng(7).normal(size=(_BITS, v.shape[1])).T > 0  # narrower vectors may get other signs: only speed hangs on them
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sign @ (1 << np.arange(_BITS)), pa.int64())], [*batch.schema.names, "code"])


def _spanning_tree(anchors: pa.Table) -> pa.Table:
    """A minimum spanning tree of at most some TREE_ROWS anchors, from the first by row number on: `at` numbers them so that a
    parent comes before its children, edge is the distance to it."""
    anchors = anchors.sort_by("row")
    v = matrix(anchors["v"]).astype(np.float64)
    n = len(v)
    near, parent, order, place = np.full(n, np.inf), np.full(n, -1), [], np.full(n, -1)
    near[0] = 0.0
    edge = np.zeros(n)
    for at in range(n):
        j = int(np.where(place < 0, near, np.inf).argmin()) if at else 0
        place[j], edge[j] = at, near[j]
        order.append(j)
        gap = np.sqrt(np.square(v - v[j]).sum(axis=1))
        closer = (gap < near) & (place < 0)
        near[closer], parent[closer] = gap[closer], at
    out = anchors.select(["tree", "row", "id", "label", "v"]).take(order)
    for name, values in (("at", pa.array(range(n), pa.int32())), ("parent", pa.array(parent[order], pa.int32())), ("edge", pa.array(edge[order]))):
        out = out.append_column(name, values)
    return out


def anchor_trees(anchors: DataFrame) -> DataFrame:
    """The anchors (row, id, label, v) in trees of about TREE_ROWS. Anchors go to a tree with others of like signs; what
    there are too many of, as of equal vectors, is dealt to several trees. The counts are 2**_BITS rows at most."""
    coded = anchors.select("row", "id", "label", "v").mapInArrow(_projections, "row long, id long, label long, v array<long>, code long")
    many = coded.groupBy("code").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / TREE_ROWS))
    dealt = coded.join(F.broadcast(many), "code").select(F.concat_ws("-", "code", salt).alias("tree"), "row", "id", "label", "v")
    return dealt.groupBy("tree").applyInArrow(_spanning_tree, _TREE)


class Walk:
    """The candidates of a part, met by the anchors of a tree from parents to children, a block of candidates at a time."""

    def __init__(self, cands: pa.Table):
        self.rows = integers(cands["row"])
        self.order = order_of_ids(cands["id"], self.rows)
        self.rows, self.labels = self.rows[self.order], integers(cands["label"])[self.order]
        self.v = matrix(cands["v"])[self.order]
        self.norms = np.sqrt(np.square(self.v.astype(np.float64)).sum(axis=1)) * (1 + 1e-12)
        self.rescored = self.met = 0

    def scores(self, tree: pa.Table, wanted) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """For each anchor and block: (anchor, block, places in it, exact scores) of the candidates that `wanted(anchor,
        block, low, high)` marks, given bounds of all scores in the block. A root's scores are exact. A child's score differs
        from its parent's by at most the edge times the candidate's norm."""
        anchors = matrix(tree["v"])
        width = max(anchors.shape[1], self.v.shape[1])
        v, anchors = floats(*(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (self.v, anchors)))
        parent, edge = integers(tree["parent"]), tree["edge"].to_numpy() * (1 + 1e-12)
        own = own_places(self.rows, integers(tree["row"]))
        for start in range(0, len(v), _COLUMNS):
            block = slice(start, min(len(v), start + _COLUMNS))
            low = np.empty((len(anchors), block.stop - start))
            high = np.empty_like(low)
            for i in range(len(anchors)):
                if i == 0:
                    low[0] = high[0] = products(anchors[:1], v[block])[0]
                else:
                    slack = edge[i] * self.norms[block]
                    slack += 1e-9 * (slack + np.abs(low[parent[i]]) + np.abs(high[parent[i]])) * (edge[i] > 0)
                    low[i], high[i] = low[parent[i]] - slack, high[parent[i]] + slack
                mark = wanted(i, block, low[i], high[i])
                if start <= own[i] < block.stop:
                    mark[own[i] - start] = False
                at = np.flatnonzero(mark)
                exact = products(anchors[i : i + 1], v[block][at])[0]
                low[i, at] = high[i, at] = exact
                self.rescored += len(at)
                self.met += len(mark)
                yield i, block, at, exact


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, the first among ties."""
    if len(scores) <= k:
        return np.argsort(-scores, kind="stable")
    kth = np.partition(scores, -k)[-k]
    at = np.flatnonzero(scores >= kth)
    return at[np.argsort(-scores[at], kind="stable")[:k]]


class Best:
    """The best candidates so far of each of some queues. Candidates come in the order of their ids, so the first stay
    among ties."""

    def __init__(self, n: int, k: int):
        self.k, self.at, self.scores = k, [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n

    def floor(self, i: int) -> float:
        """A score must be above this to change the queue."""
        if len(self.scores[i]) < self.k:
            return -np.inf
        least = int(self.scores[i][-1])
        return float(least) if abs(least) < 2**53 else np.nextafter(float(least), -np.inf)

    def add(self, i: int, at: np.ndarray, scores: np.ndarray) -> None:
        if len(at):
            at, scores = np.append(self.at[i], at), np.append(self.scores[i], scores)
            keep = _best(scores, self.k)
            self.at[i], self.scores[i] = at[keep], scores[keep]


def _trees(anchors: pa.Table) -> Iterator[pa.Table]:
    """The table, sorted and cut into its trees."""
    if len(anchors):
        anchors = anchors.sort_by([("tree", "ascending"), ("at", "ascending")])
        cut = np.flatnonzero(integers(anchors["at"]) == 0)
        for a, b in zip(cut, [*cut[1:], len(anchors)]):
            yield anchors.slice(a, b - a)


def _positives(k: int):
    """The k best candidates of the anchor's label in a part."""

    def run(cands: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        walk = Walk(cands) if len(cands) else None
        for tree in _trees(anchors) if walk else ():
            labels, best = integers(tree["label"]), Best(len(tree), k)
            same = lambda i, block, low, high: (walk.labels[block] == labels[i]) & (high > best.floor(i))  # noqa: E731, B023
            for i, block, at, exact in walk.scores(tree, same):
                best.add(i, at + block.start, exact)
            for i in range(len(tree)):
                found.append(pa.table({"anchor": np.repeat(integers(tree["row"])[i], len(best.at[i])), "positive_id": cands["id"].take(walk.order[best.at[i]]), "positive": walk.rows[best.at[i]], "score": best.scores[i]}))
        give_back()
        return _joined(found, "anchor long, positive_id long, positive long, score long")

    return run


def _joined(found: list[pa.Table], schema: str) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.concat_tables(found).combine_chunks() if found else pa.table({n: pa.array([], pa.int64()) for n in names})


_NEGATIVE = "anchor long, nth long, negative_id long, negative long, score long"


def _negatives(k: int, low_share: int, high_share: int):
    """For each anchor and positive, the k best candidates of other labels in a part whose score lies in the positive's window."""

    def run(cands: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        walk = Walk(cands) if len(cands) else None
        for tree in _trees(anchors) if walk else ():
            labels, positives = integers(tree["label"]), tree["positives"].to_pylist()
            windows = [[(-(-low_share * p // 100), high_share * p // 100) for p in ps] for ps in positives]
            best = [Best(len(w), k) for w in windows]

            def overlaps(i, block, low, high):
                mark = np.zeros(len(low), bool)
                for n, (least, most) in enumerate(windows[i]):  # noqa: B023
                    mark |= (high >= least) & (low <= most) & (high > best[i].floor(n))  # noqa: B023
                return mark & (walk.labels[block] != labels[i])  # noqa: B023

            for i, block, at, exact in walk.scores(tree, overlaps):
                for n, (least, most) in enumerate(windows[i]):
                    inside = (exact >= least) & (exact <= most)
                    best[i].add(n, at[inside] + block.start, exact[inside])
            for i, anchor in enumerate(integers(tree["row"])):
                for n, at in enumerate(best[i].at):
                    found.append(pa.table({"anchor": np.repeat(anchor, len(at)), "nth": np.repeat(n, len(at)), "negative_id": cands["id"].take(walk.order[at]), "negative": walk.rows[at], "score": best[i].scores[n]}))
        give_back()
        return _joined(found, _NEGATIVE)

    return run


def hard_negatives(rows: DataFrame, anchors: F.Column, positives: int = 5, negatives: int = 10, low_share: int = 30, high_share: int = 90, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). Anchors are the rows that `anchors` (a
    condition on id) holds of; an anchor's positives are the other rows of its label with the highest scores. For each, its first
    rows of other labels with low_share * positive_score <= 100 * score <= high_share * positive_score. Scores are integer
    inner products with the anchor, higher ones come first, ties by smaller id. Fewer are returned if there are fewer.

    Anchors are connected by minimum spanning trees, rows lie in parts, and every tree walks every part from its root: the
    parent's score, plus and minus the edge times the candidate's norm, bounds the child's. Only candidates
    whose bounds overlap a window (for positives: reach above the best so far) are scored again. What is sent is at
    most the best few a window and part, of about PART_ROWS rows.

    Rows are rows: repeated ids or rows stand by themselves, an anchor is only not its own positive. Null ids are no
    anchors, and last among ties. Rows with a null label, a null vector, or null or non-finite components take no part.
    Vectors of unlike lengths are filled up with zeros; scores beyond 2**62 - 1 or its negative become it. Anchors whose positives have negative scores
    have empty windows there. Other columns, whatever their names, are ignored; no rows or no anchors give no rows.
    """
    tables = Stored(rows.sparkSession)
    vectors = integer_vectors(rows.filter(F.col(label_col).isNotNull()), scale, id_col, vec_col, label_col)
    cands, parts, blocks = deal(vectors, tables, "negatives-vectors", anchors)
    by_part, out = cands.select("part", "row", "id", "label", "v").groupBy("part"), None
    for block in range(blocks):
        trees = tables.put(anchor_trees(cands.filter(F.col("ask") & (F.col("block") == block))), "negatives-trees")
        found = by_part.cogroup(to_parts(trees, parts).groupBy("part")).applyInArrow(_positives(positives), "anchor long, positive_id long, positive long, score long")
        first = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"), "positive")
        chosen = tables.put(found.withColumn("nth", F.row_number().over(first) - 1).filter(F.col("nth") < positives), "negatives-positives")
        lists = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "score"))).alias("list"))
        asked = trees.join(lists.select(F.col("anchor").alias("row"), F.col("list.score").alias("positives")), "row", "left")
        asked = tables.put(asked.withColumn("positives", F.coalesce("positives", F.array().cast("array<long>"))), "negatives-asked")
        found = by_part.cogroup(to_parts(asked, parts).groupBy("part")).applyInArrow(_negatives(negatives, low_share, high_share), _NEGATIVE)
        first = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), F.asc_nulls_last("negative_id"), "negative")
        ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
        chosen = chosen.select("anchor", "nth", "positive_id", F.col("score").alias("positive_score")).join(trees.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        done = ranked.withColumnRenamed("score", "negative_score").join(chosen, ["anchor", "nth"])
        done = tables.put(done.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), f"negatives-{block}")
        out = done if out is None else out.union(done)
    tables.drop("negatives-vectors", "negatives-trees", "negatives-positives", "negatives-asked")
    return out
