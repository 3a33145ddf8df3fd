"""A Merkle manifest of a dataset: trees of row digests, a proof for each row, and its check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, partitions

FAN = 16
_HEX = 64
#: About so many nodes of a level make a bucket.
BUCKET_ROWS = 8192
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: F.Column) -> F.Column:
    """Lowercase hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: F.Column) -> F.Column:
    """`-` for null, else the number of bytes, a colon and the value as text: no two lists of fields are written alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[F.Column]) -> F.Column:
    return digest(*(field(c) for c in columns))


def numbered(rows: DataFrame, tables: Stored, name: str, group: str, order: Sequence[str]) -> DataFrame:
    """The rows with `place`: their number within the group, from 0, in the given order. Rows are sorted by ranges, so a
    group with a third of all rows spans many tasks; what a task holds of each group is counted, and counts of the tasks
    before are added. Those counts are one row for each task and group that it holds."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(partitions(spark), group, *order).sortWithinPartitions(group, *order)
    ranged = tables.put(ranged.withColumn("_at", F.monotonically_increasing_id()), f"{name}-sorted")
    task = F.shiftright("_at", 33)
    runs = ranged.groupBy(group, task.alias("_task")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_task")) - F.col("_n")
    runs = runs.select(group, "_task", (before - F.col("_first")).alias("_shift"))
    return ranged.withColumn("_task", task).join(runs, [group, "_task"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def tree_levels(nodes: DataFrame, tables: Stored, name: str) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Of nodes (tree, place, node, ...): (nodes, runs) of each level, and (tree, node) of the roots. A run is up to FAN
    consecutive nodes of a level.

    The node in slot 0 of a run asks for its siblings by their computed indices, run and slot offset, in a self-join of
    the level, and emits the run's digests in order, whose digest is the parent. Every level is stored in buckets by
    (tree, run), so neither that join nor the grouping of its rows, FAN a run at most, needs an exchange. A tree leaves
    when it has one node. One count a level reaches the driver."""
    spark = nodes.sparkSession
    levels: list[tuple[DataFrame, DataFrame]] = []
    roots: DataFrame | None = None
    while True:
        n = nodes.count()
        if not n and levels:
            return levels, roots
        run = nodes.withColumns({"run": F.floor(F.col("place") / FAN), "slot": (F.col("place") % FAN).cast("int")}).drop("place")
        buckets = max(1, min(partitions(spark), -(-n // BUCKET_ROWS)))
        level = f"{name}-{len(levels)}"
        stored = tables.put_buckets(run.repartition(buckets, "tree", "run"), level, ["tree", "run"], buckets)
        first = stored.filter("slot = 0").select("tree", "run", F.col("node").alias("own"))
        asked = first.select("*", F.explode(F.sequence(F.lit(1), F.lit(FAN - 1))).alias("slot"))
        found = asked.join(stored.select("tree", "run", "slot", "node"), ["tree", "run", "slot"], "left")
        others = F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("slot", "node"))))
        runs = found.groupBy("tree", "run").agg(F.first("own").alias("own"), others.alias("others"))
        runs = runs.select("tree", "run", F.concat("own", F.array_join(F.col("others.node"), "")).alias("nodes"))
        # Places in a tree are dense, so a tree with one node has a first run of one node.
        single = (F.col("run") == 0) & (F.length("nodes") == _HEX)
        runs = tables.put_buckets(runs.withColumn("parent", F.when(~single, digest(F.col("nodes")))), f"{level}-runs", ["tree", "run"], buckets)
        tops = runs.filter("parent is null").select("tree", F.col("nodes").alias("node"))
        roots = tops if roots is None else roots.union(tops)
        levels.append((stored, runs))
        nodes = runs.filter("parent is not null").select("tree", F.col("run").alias("place"), F.col("parent").alias("node"))


def proofs(levels: list[tuple[DataFrame, DataFrame]], tables: Stored, name: str, above: DataFrame) -> DataFrame:
    """The nodes of the lowest level with `path`: what stands left and right of the node in its run, then of its parent and
    so on up to the root, then the path of `above` (tree, path). From the top down, every level joins the paths of its parents by run."""
    paths = None
    for at in reversed(range(len(levels))):
        nodes, runs = levels[at]
        around = runs.select("tree", "run", "nodes", "parent")
        if paths is None:
            around = around.withColumn("up", F.array().cast("array<struct<left:string,right:string>>"))
        else:
            around = around.join(paths.select("tree", F.col("place").alias("run"), F.col("path").alias("up")), ["tree", "run"], "left")
        around = around.join(above.select("tree", F.col("path").alias("top")), "tree")
        # A tree's root has no siblings in the tree: its path begins with that of the tree.
        around = around.withColumn("up", F.when(F.col("parent").isNull(), F.col("top")).otherwise(F.col("up"))).drop("top")
        cut = F.col("slot") * _HEX
        own = F.array(F.struct(F.expr(f"substring(nodes, 1, slot * {_HEX})").alias("left"), F.expr(f"substring(nodes, slot * {_HEX} + {_HEX + 1})").alias("right")))
        path = F.when(F.col("parent").isNull(), F.col("up")).otherwise(F.concat(own, "up"))
        paths = nodes.join(around, ["tree", "run"]).withColumn("path", path).withColumn("place", F.col("run") * FAN + F.col("slot")).drop("nodes", "parent", "up", "run", "slot")
        if at:
            paths = tables.put(paths, f"{name}-paths-{at}")
    return paths


def fold(start: F.Column, path: str = "path") -> F.Column:
    """The root that a digest and a path lead to."""
    return F.aggregate(path, start, lambda node, at: digest(at["left"], node, at["right"]))


def merkle_manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", every: int = 5) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): a leaf for each row, a tree of FAN for each
    source, its leaves ascending by id, and one over the roots of the sources, in the order of their UTF-8 bytes, null first.

    proof_sha256 is the digest of a leaf's siblings, level by level, left to right. Where `every` divides the CRC-32 of
    the decimal id, the row is tampered with: A-Z of its text are lower-cased. folded_root is what the (tampered) leaf and the
    original siblings lead to, and the row is verified if that is the root.

    A null is a field of its own, unlike the empty text. Null ids come first and are not tampered with. Rows that share an id are in the order of
    their leaves, so equal rows, which are leaves of their own, get each other's proofs in no certain order. A source with one row
    has its leaf as root; if there is one source, that is the root. Other columns, whatever their names, are ignored;
    no rows give no rows."""
    tables = Stored(docs.sparkSession)
    picked = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), F.col(id_col).alias("doc_id"), F.col(group_col).cast("string").alias("source"))
    as_they_are = [F.col(f"c{i}") for i in range(len(columns))]
    lowered = [F.translate(c, _UPPER, _LOWER) if name == text_col else c for c, name in zip(as_they_are, columns)]
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    leaves = picked.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("tree"), leaf(as_they_are).alias("node"), F.when(touched, leaf(lowered)).alias("tampered"))
    levels, subroots = tree_levels(numbered(leaves, tables, "manifest", "tree", ["doc_id", "node"]), tables, "manifest")
    if subroots.isEmpty():
        return _result(leaves.withColumns({"subroot": F.col("node"), "path": F.array().cast("array<struct<left:string,right:string>>")}), "")
    # The tree over the sources: `-` for null sorts before `=` and a name.
    upper = numbered(subroots.select(F.lit("").alias("root"), F.col("tree").alias("source"), F.col("node")), tables, "manifest-sources", "root", ["source"])
    above, top = tree_levels(upper.withColumnRenamed("root", "tree"), tables, "manifest-sources")
    root = top.first()["node"]
    none = docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    by_source = tables.put(proofs(above, tables, "manifest-sources", none).select(F.col("source").alias("tree"), F.col("node").alias("subroot"), "path"), "manifest-subroots")
    rows = proofs(levels, tables, "manifest", by_source).join(by_source.select("tree", "subroot"), "tree")
    return _result(rows, root)


def _result(rows: DataFrame, root: str) -> DataFrame:
    siblings = F.aggregate("path", F.lit(""), lambda text, at: F.concat(text, at["left"], at["right"]))
    folded = fold(F.coalesce("tampered", "node"))
    out = rows.select("doc_id", F.col("node").alias("leaf"), "subroot", F.lit(root).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
