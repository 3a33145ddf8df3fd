import random

import pytest

from lorewell.plans import adjacency, graph


def edges(spark, *rows):
    return spark.createDataFrame([(f"{h}{t}{label}", h, t, label, c) for h, t, label, c in rows], "id string, head_id string, tail_id string, label string, confidence double")


def nodes(spark, names, kind="Gene"):
    return spark.createDataFrame([(n, n, n, kind, None) for n in names], "id string, name string, normalized_name string, type string, aliases array<string>")


def test_paths_on_a_diamond(spark):
    r = edges(spark, ("a", "b", "BINDS", 0.5), ("c", "a", "BINDS", 1.0), ("b", "d", "BINDS", 0.5), ("b", "d", "INHIBITS", 0.8), ("c", "d", "BINDS", 0.9), ("a", "a", "BINDS", 0.9), ("d", "e", "BINDS", None))
    paths = graph.find_paths(r, "a", "d", 3).orderBy("path_rank").collect()
    assert sorted(round(p["total_confidence"], 3) for p in paths) == [0.25, 0.4, 0.9] and {p["path_length"] for p in paths} == {2}
    assert graph.find_paths(r, "a", "e", 4).count() == 0  # a null confidence is under every minimum
    with pytest.raises(ValueError):
        graph.find_paths(r, "a", "a")


def test_hops_on_a_line(spark):
    r = edges(spark, ("a", "b", "X", 1.0), ("c", "b", "X", 1.0), ("c", "d", "X", 1.0), ("x", "y", "X", 1.0))
    got = {x["id"]: x["hops"] for x in graph.shortest_hops(r, spark.createDataFrame([("a",)], "id string"), 5).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_subgraph_caps_on_a_hub(spark):
    r = edges(spark, *[("hub", f"n{i:03}", "BINDS", 0.9) for i in range(300)])
    e = nodes(spark, ["hub", *(f"n{i:03}" for i in range(300))])
    n, found = graph.subgraph(e, r, "hub", 2, 50, 100)
    assert (n.count(), found.count()) == (50, 100)
    n, found = graph.subgraph(e, r, "hub", 1, 50, 100, induced=True)
    assert found.count() == 49
    counts = {(x["kind"], x["key"]): x["count"] for x in graph.subgraph_summary(n, found, 50, 100).collect()}
    assert counts["truncated", None] == 1 and counts["label", "BINDS"] == 49


def test_unknown_labels_do_not_filter(spark):
    r = edges(spark, ("a", "b", "BINDS", 0.9), ("a", "c", "INHIBITS", 0.2))
    assert graph.allowed_edges(r, ["NONE"]).count() == 2 and graph.allowed_edges(r, ["BINDS", "NONE"]).count() == 1 and graph.allowed_edges(r, None, 0.5).count() == 1


def test_paths_follow_edge_ids(spark):
    r = edges(spark, *[("a", "z", f"L{i}", 0.5) for i in range(9)])
    paths = graph.find_paths(r, "a", "z", 1, max_paths=4).orderBy("path_rank").collect()
    assert [p["steps"][1]["edge"] for p in paths] == ["azL0", "azL1", "azL2", "azL3"]


def plain_paths(rows, source, target, max_hops, max_paths):
    """The documented search without pruning: the tree over nodes seen once, level by level."""
    steps = [(h, t, False, f"{h}{t}{label}") for h, t, label, _ in rows] + [(t, h, True, f"{h}{t}{label}") for h, t, label, _ in rows]
    tree, seen, found = {source: []}, {source}, []
    for _ in range(max_hops):
        reached = [(way + [(back, edge)], there) for node, way in tree.items() for here, there, back, edge in steps if here == node]
        found += sorted(way for way, there in reached if there == target)[: max_paths - len(found)]
        fresh = {}
        for way, there in sorted(reached):
            if there not in seen and there != target:
                fresh.setdefault(there, way)
        tree = fresh
        seen |= set(fresh)
        if len(found) >= max_paths:
            break
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_paths_are_the_paths(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", rng.choice("XYZ"), 0.5) for _ in range(26)} | {("n0", f"leaf{i}", "X", 0.5) for i in range(20)})
    r, report = edges(spark, *rows), []
    for hops in (1, 2, 4):
        got = graph.find_paths(r, "n0", "n5", hops, max_paths=3, report=report).orderBy("path_rank").collect()
        assert [[(s["back"], s["edge"]) for s in p["steps"][1:]] for p in got] == plain_paths(rows, "n0", "n5", hops, 3)
    assert report[0].keys() == {"hop", "steps", "kept", "paths"}
    assert all(x["steps"] < 20 for x in report if x["hop"] == 1)  # no leaf is walked to


def test_a_hub_is_spread_and_edges_stay_where_they_are(spark):
    rows = [("hub", f"n{i}", "X", 0.5) for i in range(400)] + [(f"n{i}", f"n{i + 1}", "X", 0.5) for i in range(200)]
    r = edges(spark, *rows)
    stored = adjacency.build_adjacency(r, shard_edges=50)
    sizes = {(x["node"], x["shard"]): x["count"] for x in stored.steps.groupBy("node", "shard").count().collect()}
    assert sum(n == "hub" for n, _ in sizes) == 8 and max(sizes.values()) < 100
    near = spark.createDataFrame([("hub", 1), ("n7", 2)], "node string, tag int")
    found = stored.hop(near)
    assert sorted((x["node"], x["neighbor"], x["tag"]) for x in found.collect()) == sorted([("hub", f"n{i}", 1) for i in range(400)] + [("n7", x, 2) for x in ("hub", "n6", "n8")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stored.hop(near)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[plan.index("SortMergeJoin [node") :]
    steps = join[: join.index("Exchange")]  # the side of the steps comes first: a sort of the scanned buckets
    assert "FileScan parquet" in steps and "Bucketed: true" in steps
    before = {x["id"]: x["hops"] for x in graph.shortest_hops(r, spark.createDataFrame([("n3",)], "id string"), 3, stored).collect()}
    assert before == {x["id"]: x["hops"] for x in graph.shortest_hops(r, spark.createDataFrame([("n3",)], "id string"), 3).collect()} and len(before) == 401
    stored.drop()


def test_first_of_each(spark):
    from lorewell.operators.query import first_of_each

    df = spark.createDataFrame([(k, i) for k in "ab" for i in range(30)], "k string, i int")
    assert sorted(map(tuple, first_of_each(df, ["k"], ["i"], 2, salts=4).collect())) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_few_nodes_are_sent_to_the_edges(spark):
    rng = random.Random(3)
    r = edges(spark, *sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", "X", 0.5) for _ in range(45)}))
    near = spark.createDataFrame([("n1", 1), ("n2", 2), ("nowhere", 3)], "node string, tag int")
    stored, few, many = adjacency.build_adjacency(r), adjacency.Edges(r), adjacency.Edges(r, few=2)
    rows = lambda x: sorted(map(str, x.hop(near).select("node", "neighbor", "back", "edge", "tag").collect()))
    assert rows(few) == rows(stored) == rows(many) and few.stored is None and many.stored is not None
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = few.hop(near)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first = next(line for line in plan.splitlines() if "LeftSemi" in line)
    assert "BroadcastHashJoin [xxhash64(" in first
    many.drop()
    stored.drop()


def test_edges_of_a_view_are_stored(spark):
    r = edges(spark, ("a", "b", "X", 0.5), ("a", "c", "X", 0.5), ("b", "c", "X", 0.5), ("d", "a", "X", 0.5))
    n, found = graph.top_degree_graph(nodes(spark, "abcd"), r, 3)
    assert sorted(x["id"] for x in found.collect()) == ["abX", "acX", "bcX"]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
