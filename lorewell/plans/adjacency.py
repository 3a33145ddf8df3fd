"""Edges for traversals: read level by level where few nodes ask, or stored once, seen from both ends, in buckets by node,
nodes of many edges in shards."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, store

#: A node with more edges is split into shards of about so many.
SHARD_EDGES = 10_000
#: A frontier of up to so many nodes is sent to the edges, a number of 64 bits a node; for a larger one the edges are stored.
FEW_NODES = 2_000_000


def both_ways(relations: DataFrame) -> DataFrame:
    """(node, neighbor, back, edge, label, confidence), every edge from either end; a loop twice."""
    out = relations.select(F.col("head_id").alias("node"), F.col("tail_id").alias("neighbor"), F.lit(False).alias("back"), F.col("id").alias("edge"), "label", "confidence")
    return out.unionByName(relations.select(F.col("tail_id").alias("node"), F.col("head_id").alias("neighbor"), F.lit(True).alias("back"), F.col("id").alias("edge"), "label", "confidence"))


@dataclass
class Adjacency:
    steps: DataFrame  # both_ways with the shard of the node that the step is in
    hubs: DataFrame  # (node, shards) of the nodes that have several
    table: str

    def hop(self, frontier: DataFrame) -> DataFrame:
        """The steps from the nodes of a frontier (node, ...), with its columns. The frontier goes to the buckets of its nodes, a
        hub to each of its shards; the steps stay where they are."""
        shards = F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)
        asked = frontier.join(self.hubs, "node", "left").withColumn("shard", F.explode(shards)).drop("shards")
        return self.steps.join(asked, ["node", "shard"]).drop("shard")

    def drop(self) -> None:
        self.steps.sparkSession.sql(f"drop table if exists {self.table}")


def build_adjacency(relations: DataFrame, shard_edges: int = SHARD_EDGES) -> Adjacency:
    """Write the adjacency of relations (id, head_id, tail_id, label, confidence). Degrees are counted before anything is dealt
    out, so a node with a third of all edges is written, and later read, by as many tasks as it has shards. There is at
    most one hub in shard_edges steps."""
    spark = relations.sparkSession
    steps = both_ways(relations)
    hubs = steps.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > shard_edges)
    hubs = store(hubs.select("node", F.ceil(F.col("n") / shard_edges).cast("int").alias("shards")), "hubs")
    shard = F.coalesce(F.pmod(F.xxhash64("edge", "back"), F.col("shards")).cast("int"), F.lit(0))
    steps = steps.join(hubs, "node", "left").withColumn("shard", shard).drop("shards")
    buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"lorewell_{uuid.uuid4().hex}"
    steps.repartition(buckets, "node", "shard").write.bucketBy(buckets, "node", "shard").option("path", shared_dir(spark, "adjacency")).format("parquet").saveAsTable(table)
    return Adjacency(spark.table(table), hubs, table)


@dataclass
class Edges:
    """The edges of relations with the hops of an `Adjacency`, which is not stored before a frontier has more than `few` nodes. Up
    to there a hop scans the edges and exchanges only those from the frontier's nodes."""

    relations: DataFrame
    few: int = FEW_NODES
    stored: Adjacency | None = None

    def hop(self, frontier: DataFrame) -> DataFrame:
        if self.stored is None and frontier.count() > self.few:
            self.stored = build_adjacency(self.relations)
        if self.stored is not None:
            return self.stored.hop(frontier)
        # Numbers choose the steps, names decide.
        near = F.broadcast(frontier.select(F.xxhash64("node").alias("_near")).distinct())
        steps = both_ways(self.relations)
        return steps.join(near, F.xxhash64(steps["node"]) == F.col("_near"), "left_semi").join(frontier, "node")

    def drop(self) -> None:
        if self.stored is not None:
            self.stored.drop()
