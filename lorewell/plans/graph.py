"""Traversals as level loops of joins. A level is one join of the frontier with the edges seen from both ends; depth is
bounded, and each level is written to the shared folder, which cuts the plan and survives lost executors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.query import degree, first_of_each
from ..sources.shared import store
from ..vocabulary import RELATION_LABELS
from .adjacency import Adjacency, Edges, both_ways


def allowed_edges(relations: DataFrame, labels: Sequence[str] | None = None, min_confidence: float = 0.0, known: Sequence[str] = RELATION_LABELS) -> DataFrame:
    """Edges of the known ones among labels (no filter if none is known) with at least the confidence; null has none."""
    labels = [x for x in labels or () if x in known]
    relations = relations.filter(F.col("confidence") >= min_confidence)
    return relations.filter(F.col("label").isin(labels)) if labels else relations


def subgraph(entities: DataFrame, relations: DataFrame, start: str, depth: int = 1, max_nodes: int = 50, max_edges: int = 100, labels: Sequence[str] | None = None, entity_types: Sequence[str] | None = None, min_confidence: float = 0.0, induced: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, depth), edges) around one entity, level by level, until a cap is reached. Order within a level: rank
    of the node, outgoing before incoming, edge id. An edge counts when its neighbor passes the type filter, even if the
    node cap stops the neighbor; induced drops those. Caps bound every table but the edges scanned."""
    if not 1 <= depth <= 3:
        raise ValueError("depth is 1 to 3")
    steps = both_ways(allowed_edges(relations, labels, min_confidence))
    nodes = store(entities.filter(F.col("id") == start).select("id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("rank")), "level")
    edges = None
    # Numbers among at most max_nodes * ... rows: each level is cut by orderBy().limit() before it is numbered.
    number = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    for level in range(depth):
        frontier = nodes.filter(F.col("depth") == level).select(F.col("id").alias("node"), "rank")
        # At most max_nodes rows, so a broadcast: a level is one scan of the edges and shuffles what it reaches alone.
        reached = steps.join(F.broadcast(frontier), "node")
        if entity_types:
            reached = reached.join(entities.filter(F.col("type").isin(*entity_types)).select(F.col("id").alias("neighbor")), "neighbor", "left_semi")
        reached = store(reached, "reached")
        fresh = reached.select("edge", F.struct("rank", "back", "edge").alias("at")).groupBy("edge").agg(F.min("at").alias("at"), F.lit(level).alias("level"))
        if edges is not None:
            fresh = fresh.join(edges.select("edge"), "edge", "left_anti")
        have = edges.count() if edges is not None else 0
        fresh = fresh.orderBy("at").limit(max(0, max_edges - have))
        edges = store(fresh if edges is None else edges.unionByName(fresh), "edges")
        first = reached.groupBy(F.col("neighbor").alias("id")).agg(F.min(F.struct("rank", "back", "edge")).alias("at")).join(nodes.select("id"), "id", "left_anti")
        first = number(first.orderBy("at").limit(max(0, max_nodes - nodes.count())), "at").select("id", F.lit(level + 1).alias("depth"), "rank")
        nodes = store(nodes.unionByName(first), "level")
        if nodes.count() >= max_nodes or edges.count() >= max_edges or nodes.filter(F.col("depth") == level + 1).isEmpty():
            break
    found = relations.join(edges.select(F.col("edge").alias("id")), "id", "left_semi")
    if induced:
        for end in ("head_id", "tail_id"):
            found = found.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return entities.join(nodes.select("id", "depth"), "id"), found


def subgraph_summary(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> DataFrame:
    """(kind, key, count): nodes, edges, depth reached, whether a cap was reached, nodes by type and edges by label."""
    n = nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))
    row = n.join(edges.agg(F.count("*").alias("edges")), F.lit(True)).withColumn("truncated", ((F.col("nodes") >= max_nodes) | (F.col("edges") >= max_edges)).cast("int"))
    flat = row.selectExpr("stack(4, 'nodes', nodes, 'edges', edges, 'depth', cast(depth as bigint), 'truncated', cast(truncated as bigint)) as (kind, count)").select("kind", F.lit(None).cast("string").alias("key"), "count")
    by = lambda df, c: df.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("count")).select(F.lit(c).alias("kind"), "key", "count")
    return flat.union(by(nodes, "type")).union(by(edges, "label"))


def shortest_hops(relations: DataFrame, sources: DataFrame, max_hops: int, edges: Adjacency | Edges | None = None) -> DataFrame:
    """(id, hops) for every node within max_hops of the sources (id), edges taken both ways. A hop brings the nodes of the
    last one to the edges, which are stored once there are many of those (or before, as `edges`)."""
    own = None if edges else Edges(relations)
    edges = edges or own
    seen = store(sources.select("id").distinct().withColumn("hops", F.lit(0)), "hops")
    for hop in range(1, max_hops + 1):
        near = seen.filter(F.col("hops") == hop - 1).select(F.col("id").alias("node"))
        fresh = edges.hop(near).select(F.col("neighbor").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop))
        fresh = store(fresh, "hops")
        if fresh.isEmpty():
            break
        seen = store(seen.unionByName(fresh), "hops")
    if own:
        own.drop()
    return seen


def find_paths(relations: DataFrame, source: str, target: str, max_hops: int = 3, labels: Sequence[str] | None = None, min_confidence: float = 0.0, max_paths: int = 5, report: list[dict[str, int]] | None = None) -> DataFrame:
    """Up to max_paths paths (path_rank, path_length, total_confidence, steps) from source to target: a breadth-first tree
    over nodes seen once, and every edge from the tree to the target. Steps are (node, edge, back, confidence). Order:
    length, rank of the tree node, outgoing before incoming, edge id. Search ends at the level that fills max_paths.

    Distances to the target come first, as far as max_hops allows. Then only steps to nodes that can still arrive in the hops
    left are taken; a node that cannot has no successor that can, so the tree over the others is the same. `report` gets
    the steps taken and the tree nodes kept, level by level."""
    if source == target:
        raise ValueError("source and target must differ")
    if not 1 <= max_hops <= 5:
        raise ValueError("max_hops is 1 to 5")
    spark = relations.sparkSession
    edges = Edges(allowed_edges(relations, labels, min_confidence))
    to_go = shortest_hops(relations, spark.createDataFrame([(target,)], "id string"), max_hops - 1, edges)
    way = f"array<struct<back:boolean,edge:{relations.schema['id'].dataType.simpleString()}>>"
    kind = "array<struct<node:string,edge:string,back:boolean,confidence:double>>"
    tree = store(spark.createDataFrame([(source,)], "id string").withColumns({"at": F.array().cast(way), "steps": F.array().cast(kind)}), "tree")
    seen, found, n = tree.select("id"), None, 0
    for hop in range(1, max_hops + 1):
        near = tree.select(F.col("id").alias("node"), "at", "steps")
        step = F.struct(F.col("neighbor").alias("node"), F.col("edge").cast("string").alias("edge"), "back", "confidence")
        arriving = to_go.filter(F.col("hops") <= max_hops - hop).select(F.col("id").alias("neighbor"))
        # The order of a path is its tree node's, then the direction and edge that lead on.
        taken = edges.hop(near).join(arriving, "neighbor", "left_semi")
        reached = store(taken.select(F.col("neighbor").alias("id"), F.concat("at", F.array(F.struct("back", "edge"))).alias("at"), F.concat("steps", F.array(step)).alias("steps")), "reached")
        hits = reached.filter(F.col("id") == target).orderBy("at").limit(max_paths - n).withColumn("path_length", F.lit(hop))
        found = hits if found is None else found.unionByName(hits)
        n += hits.count()
        done = n >= max_paths or hop == max_hops
        if not done:
            tree = reached.filter(F.col("id") != target).join(seen, "id", "left_anti").groupBy("id").agg(F.min_by(F.struct("at", "steps"), "at").alias("s")).select("id", "s.at", "s.steps")
            tree = store(tree, "tree")
            seen = seen.union(tree.select("id"))
        if report is not None:
            report.append({"hop": hop, "steps": reached.count(), "kept": 0 if done else tree.count(), "paths": n})
        if done:
            break
    edges.drop()
    rank = F.row_number().over(Window.orderBy("path_length", "at")).alias("path_rank")
    return found.select(rank, "path_length", F.aggregate("steps", F.lit(1.0), lambda a, s: a * s["confidence"]).alias("total_confidence"), F.concat(F.array(F.struct(F.lit(source).alias("node"), F.lit(None).cast("string").alias("edge"), F.lit(None).cast("boolean").alias("back"), F.lit(None).cast("double").alias("confidence"))), "steps").alias("steps"))


def path_steps(paths: DataFrame) -> DataFrame:
    return paths.select("path_rank", "path_length", "total_confidence", F.posexplode("steps").alias("step", "s")).select("path_rank", "path_length", "total_confidence", "step", "s.*")


def multi_center_subgraph(entities: DataFrame, relations: DataFrame, terms: Sequence[str], depth: int = 2, max_nodes: int = 150) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges between them) around all entities whose normalized name holds a term, searched at once.
    Nearer nodes come first, then ids, up to max_nodes; centres are all kept."""
    is_centre = reduce(lambda a, b: a | b, (F.col("normalized_name").ilike(f"%{t}%") for t in terms))
    hops = shortest_hops(relations, entities.filter(is_centre), depth)
    centres = hops.filter("hops = 0")
    room = max(0, max_nodes - centres.count())
    kept = centres.unionByName(hops.filter("hops > 0").join(entities.select("id"), "id", "left_semi").orderBy("hops", "id").limit(room))
    kept = store(kept, "kept")
    return entities.join(kept.withColumnRenamed("hops", "depth"), "id"), induced_edges(relations, kept)


def induced_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    for end in ("head_id", "tail_id"):
        relations = relations.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return relations


def top_degree_graph(entities: DataFrame, relations: DataFrame, max_nodes: int = 200) -> tuple[DataFrame, DataFrame]:
    """The nodes of the most edges, and the edges between them, which are stored: they are few, and Spark knows then how few."""
    nodes = store(degree(entities, relations).orderBy(F.desc("degree"), "id").limit(max_nodes), "top")
    return nodes, store(induced_edges(relations, nodes), "between")


def graph_view_tables(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a drawing needs. Nodes: edges inside the view, depth, centre, a label of at most 22 characters, three
    aliases. Edges: width by confidence and evidence, up to three quotes cut short, and how many more there are."""
    inside = edges.select(F.explode(F.array("head_id", "tail_id")).alias("id")).groupBy("id").agg(F.count("*").alias("connections"))
    label = F.when(F.char_length("name") > 22, F.concat(F.substring("name", 1, 22), F.lit("…"))).otherwise(F.col("name"))
    shown = nodes.join(inside, "id", "left").fillna(0, ["connections"]).withColumns({"view_label": label, "is_centre": F.col("depth") == 0, "first_aliases": F.slice(F.coalesce("aliases", F.array().cast("array<string>")), 1, 3)})
    near = evidence.join(edges.select(F.col("id").alias("relation_id")), "relation_id", "left_semi").select("relation_id", "id", "quote")
    first = first_of_each(near, ["relation_id"], ["id"], 3).groupBy("relation_id").agg(F.array_sort(F.collect_list(F.struct("id", "quote"))).alias("first"))
    near = near.groupBy("relation_id").agg(F.count("*").alias("n")).join(first, "relation_id").withColumnRenamed("relation_id", "id")
    short = F.transform("first", lambda x: F.when(F.char_length(x["quote"]) > 147, F.concat(F.substring(x["quote"], 1, 147), F.lit("..."))).otherwise(x["quote"]))
    n = F.coalesce("n", F.lit(0))
    lines = edges.join(near, "id", "left").select("id", "head_id", "tail_id", "label", "confidence", n.alias("evidence_count"), (1 + 2 * F.coalesce("confidence", F.lit(0.0)) + 0.3 * F.least(n, F.lit(5))).alias("width"), F.coalesce(short, F.array().cast("array<string>")).alias("quotes"), F.when(n > 3, F.concat(F.lit("and "), (n - 3).cast("string"), F.lit(" more"))).alias("more"))
    return shown, lines


def graph_stats(entities: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(kind, key, value): totals, entities by type, relations by label, average confidence to three places."""
    n = F.count("*").cast("double").alias("value")
    names = lambda kind, key: (F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), key.cast("string").alias("key"), "value")
    # Each table is read once: groups by kind and the sum of all.
    by = lambda df, c, name: df.rollup(c).agg(n, F.grouping(c).alias("all")).select(*names(F.when(F.col("all") == 1, name).otherwise(c), F.col(c)))
    sums = relations.groupBy("label").agg(F.sum("confidence").alias("s"), F.count("confidence").alias("c"), F.count("*").alias("n"))
    mean = F.when(F.sum("c") > 0, F.round(F.sum("s") / F.sum("c"), 3)).otherwise(0.0)
    kinds = F.array(F.struct(F.lit("label").alias("kind"), F.col("n").cast("double").alias("value")))
    edges = sums.rollup("label").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), F.coalesce(mean, F.lit(0.0)).alias("mean"), F.grouping("label").alias("all"))
    whole = F.array(F.struct(F.lit("relations").alias("kind"), F.col("n").alias("value")), F.struct(F.lit("avg_confidence").alias("kind"), F.col("mean").alias("value")))
    edges = edges.select("label", F.explode(F.when(F.col("all") == 1, whole).otherwise(kinds)).alias("x")).select(F.col("x.kind").alias("kind"), F.col("label").alias("key"), F.col("x.value").alias("value"))
    return reduce(DataFrame.union, [by(entities, "type", "entities"), edges, evidence.agg(n).select(*names("evidence", F.lit(None)))])
