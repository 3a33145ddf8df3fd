from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import build, quality
from lorewell.plans.star import Star

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_in_the_order_of_their_text(spark):
    numbers = [0, 1, 10, 100, 11, 2, 19, 9, 123456789012345678, 12345678901234567, 9223372036854775807]
    rows = spark.createDataFrame([(n, p) for n in numbers for p in (0, 7, 70)], "n long, p int").withColumn("at", build.number_order("n", "p"))
    got = [(r["n"], r["p"]) for r in rows.orderBy("at").collect()]
    assert got == sorted(((n, p) for n in numbers for p in (0, 7, 70)), key=lambda x: (str(x[0]), x[1]))
    back = rows.select(F.col("n").alias("m"), F.col("p").alias("o"), "at").withColumns(build.ordered_numbers("at", "n", "p"))
    assert back.filter("n <> m or p <> o").count() == 0


def test_lines_are_reduced_in_hash_tables_and_kept_without_ids(spark):
    s = Star(spark, SMALL, keep=True)
    for df in (s.relations, s.evidence):
        stored = {f.name for f in spark.read.parquet(*df.inputFiles()).schema}
        assert not stored & {"id", "head_id", "tail_id", "relation_id", "quote", "quote_hash"}
    loose = Star(spark, SMALL)
    assert "SortAggregate" not in plan(loose.evidence) and "SortAggregate" not in plan(loose._first_lines("head"))


def test_first_lines_are_those_of_the_operator(spark):
    s = Star(spark, SMALL)
    assert s.evidence.exceptAll(build.build_evidence(s.resolved)).count() == 0 and build.build_evidence(s.resolved).exceptAll(s.evidence).count() == 0
    whole = build.build_entities(s.mentions)
    assert s.entities.exceptAll(whole).count() == 0 and whole.count() == s.entities.count()


def test_edges_with_a_null_end_or_none(spark):
    edges = spark.createDataFrame([("1", "a", "b"), ("2", None, "b"), ("3", "a", None), ("4", "a", "x"), ("5", "x", "y"), ("6", None, None)], "id string, head_id string, tail_id string")
    entities = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    found = quality.orphan_relations(edges, entities)
    assert sorted(r["id"] for r in found.collect()) == ["2", "3", "4", "5", "6"]
    assert "SortMergeJoin" not in plan(found)


def test_facts_are_counted_as_numbers(spark):
    s = Star(spark, SMALL)
    done = plan(quality.check_constraints({"relations": s.relations, "evidence": s.raw_evidence}))
    assert "ObjectHashAggregate" not in done and "collect_list" not in done and "to_json" not in done


def test_edges_and_evidence_take_numbers_and_no_positions(spark):
    loose = Star(spark, SMALL)
    for df in (loose.relations, loose.evidence):
        assert "Window" not in plan(df)
    stored = dict(spark.read.parquet(*Star(spark, SMALL, keep=True)._numbers.inputFiles()).dtypes)
    assert "string" not in stored.values()


def test_only_orders_that_name_something_first_are_placed(spark):
    s = Star(spark, SMALL, keep=True)
    orders = s._first_orders.select("l_orderkey").distinct().count()
    assert orders <= s._first_orders.select("head").union(s._first_orders.select("tail")).distinct().count()
    assert s.entities.exceptAll(build.build_entities(s.mentions)).count() == 0


def test_ids_are_packed_and_unpacked(spark):
    ids = ["a" * 64, "0f" * 32, "A" * 64, "a" * 63, "a" * 64 + "\n", "", "é", "\0", "x" * 32, None]
    rows = spark.createDataFrame([(x,) for x in ids], "id string").withColumn("b", T.packed("id"))
    assert [r["back"] for r in rows.select(T.unpacked("b").alias("back")).collect()] == ids
    assert rows.select("b").distinct().count() == len(ids)
    assert [r[0] for r in rows.limit(2).select(F.octet_length("b")).collect()] == [32, 32]


def test_few_matches_are_broadcast_to_the_edges(spark):
    s = Star(spark, SMALL, keep=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30k")
    try:
        done = plan(quality.term_has_edges(s.entities, s.relations, "africa", "in"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in done
