import json
import time

import pytest
from pyspark.sql import types as T

from lorewell import schemas
from lorewell.plans.kg import build_kg
from lorewell.streaming import incremental
from tests.test_build import ENTITIES, RELATIONS, chunks, outputs


def test_streamed_graph_is_the_batch_graph(spark, tmp_path):
    rows = [("1", "entities", ENTITIES), ("1", "relations", RELATIONS), ("2", "entities", ENTITIES), ("2", "relations", RELATIONS.replace("0.9", "0.95"))]
    source = str(tmp_path / "in")
    for k in (0, 2):
        outputs(spark, *rows[k : k + 2]).coalesce(1).write.mode("append").parquet(source)
    incremental.stream_build_kg(spark, source, chunks(spark), str(tmp_path / "out"), str(tmp_path / "check"), files_per_batch=1).awaitTermination()
    want = build_kg(outputs(spark, *rows), chunks(spark))
    for name in ("entities", "relations", "evidence"):
        got = incremental.graph_table(spark, str(tmp_path / "out"), name)
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in getattr(want, name).collect())
    assert incremental.graph_table(spark, str(tmp_path / "out"), "relations").first()["confidence"] == 0.95
    assert incremental.graph_table(spark, str(tmp_path / "out"), "nothing") is None
    for name, changed in (("evidence", 0), ("entities", 0), ("relations", 1)):  # a batch writes what it adds or changes alone
        deltas = spark.read.parquet(str(tmp_path / "out" / name / "deltas"))
        assert deltas.count() == incremental.graph_table(spark, str(tmp_path / "out"), name).count() + changed


def answers(spark, source, numbers):
    """A chunk for each number, in a file of its own: an entity that all share, one of its own, and a relation of both."""
    for n in numbers:
        entities = json.dumps({"entities": [{"name": "Shared" if n else "SHARED", "type": "Gene", "normalized_name": "shared"}, {"name": f"Own {n}", "type": "Disease", "normalized_name": f"own_{n}"}]})
        relations = json.dumps({"relations": [{"head": "Shared" if n else "SHARED", "tail": f"Own {n}", "label": "BINDS", "confidence": 0.9, "evidence": f"quote {n}"}]})
        outputs(spark, (f"c{n}", "entities", entities), (f"c{n}", "relations", relations)).coalesce(1).write.mode("append").parquet(source)


def of_graph(spark, out):
    read = lambda name: incremental.graph_table(spark, out, name)
    return {name: sorted(map(str, read(name).select(sorted(read(name).columns)).collect())) for name in ("entities", "relations", "evidence")}


def test_a_late_batch_costs_what_its_keys_cost(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    texts = spark.createDataFrame([(f"c{n}", "d", f"Here quote {n}.") for n in (0, 1, 2, 3, 4, 99)], "id string, document_id string, text string")
    state = lambda query: [(p["stateOperators"][0]["numRowsUpdated"], p["stateOperators"][0]["numRowsTotal"]) for p in query.recentProgress if p["numInputRows"]]
    answers(spark, source, range(5))
    query = incremental.stream_build_kg(spark, source, texts, out, check)
    query.awaitTermination()
    assert state(query) == [(1 + 3 * 5, 1 + 3 * 5)]
    before = of_graph(spark, out)
    assert [len(before[n]) for n in ("entities", "relations", "evidence")] == [6, 5, 5]
    assert incremental.compact(spark, out).keys() == {"entities", "relations", "evidence"}
    assert of_graph(spark, out) == before and not list((tmp_path / "out" / "relations" / "deltas").glob("batch=*"))
    answers(spark, source, [3, 0])  # nothing new
    answers(spark, source, [99])
    query = incremental.stream_build_kg(spark, source, texts, out, check)
    query.awaitTermination()
    assert state(query) == [(1 + 3 * 3, 1 + 3 * 6)]
    after = of_graph(spark, out)
    assert {n: len(after[n]) - len(before[n]) for n in after} == {"entities": 1, "relations": 1, "evidence": 1}
    assert spark.read.parquet(f"{out}/evidence/deltas").count() == 1 and spark.read.parquet(f"{out}/relations/deltas").count() == 1
    incremental.compact(spark, out)
    assert of_graph(spark, out) == after and incremental.compact(spark, out) == {}


def test_ids_are_chosen_before_the_aggregate(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    answers(spark, source, range(2))
    incremental.stream_build_kg(spark, source, chunks(spark), out, str(tmp_path / "check")).awaitTermination()
    for name in ("entities", "relations", "evidence"):
        ids = incremental.graph_table(spark, out, name).select("id").orderBy("id").limit(1)
        rows = incremental.graph_table(spark, out, name, spark.createDataFrame(ids.collect(), "id string"))
        assert rows.count() == 1
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert 0 <= plan.index("Aggregate") < plan.index("LeftSemi") and "Aggregate" not in plan[plan.index("LeftSemi") :]


def test_a_batch_that_dies_is_applied_once(spark, tmp_path, monkeypatch):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "id string, pmid string, abstract string"
    for rows in ([("a", "1", "Aa bb."), ("b", "1", "Same."), ("z", None, "None.")], [("c", "2", "Cc.")], [("d", "1", "Late."), ("0", "2", "Late and smaller.")], [("e", "3", "Ee.")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.02)
    kind = T._parse_datatype_string(schema)
    real, calls = incremental.chunk_sentences, []

    def die(docs, *args):
        calls.append(1)
        if len(calls) == 2:  # the documents of a batch are written, its chunks are not
            raise RuntimeError("lost")
        return real(docs, *args)

    monkeypatch.setattr(incremental, "chunk_sentences", die)
    run = lambda: incremental.stream_ingest(spark, source, target, check, kind, files_per_batch=1).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    read = lambda t: spark.read.option("recursiveFileLookup", "true").parquet(f"{target}/{t}")
    assert sorted((r["id"], r["pmid"]) for r in read("documents").collect()) == [("a", "1"), ("c", "2"), ("e", "3")]
    assert read("chunks").count() == 3
    spark.createDataFrame([("f", "3", "Much later.")], schema).write.mode("append").parquet(source)
    run()
    assert read("documents").count() == 3 and read("chunks").count() == 3


def test_ingest_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, pmid string, abstract string"
    for rows in ([("a", "1", "Aa bb. Cc dd.")], [("b", "1", "Again."), ("c", "2", "New one.")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    incremental.stream_ingest(spark, source, target, str(tmp_path / "check"), T._parse_datatype_string(schema), files_per_batch=1).awaitTermination()
    read = lambda t: spark.read.option("recursiveFileLookup", "true").parquet(f"{target}/{t}")
    assert sorted(r["pmid"] for r in read("documents").collect()) == ["1", "2"] and read("chunks").count() == 2
    assert schemas.CHUNKS.startswith("id string")


def test_progress(spark, tmp_path):
    schema = "chunk_id string, error string"
    spark.createDataFrame([("a", None), ("b", "x"), ("c", None)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    seen = []
    query = incremental.stream_progress(stream).writeStream.outputMode("complete").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen[-1].asDict() == {"processed": 3, "errors": 1}


def test_facts_hold_a_spelling_once(spark):
    from lorewell.plans.star import Star

    s = Star(spark, "/root/testdata/sf0.001", keep=True)
    found = incremental._facts(s.outputs, s.chunks).filter("kind = 'entities'")
    assert found.count() == found.select("key").distinct().count()


def test_facts_hold_no_digests_of_triples(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    answers(spark, source, range(3))
    texts = spark.createDataFrame([(f"c{n}", "d", f"Here quote {n}.") for n in range(3)], "id string, document_id string, text string")
    incremental.stream_build_kg(spark, source, texts, out, str(tmp_path / "check")).awaitTermination()
    facts = spark.read.schema(incremental._FACTS).option("recursiveFileLookup", "true").parquet(f"{out}/facts")
    assert facts.filter("kind = 'triples'").count() == 3 and facts.filter("kind = 'triples' and key is not null").count() == 0
    assert not {"relation_id", "head_id", "quote_hash"} & set(facts.select("row.*").columns)
    places = incremental.graph_table(spark, out, "evidence").select("quote_start", "quote_end").distinct().collect()
    assert [tuple(r) for r in places] == [(5, 12)]
    # A quote is written once, so compacting quotes needs no exchange, while a surer relation is written again.
    answers(spark, source, [1, 2])
    incremental.stream_build_kg(spark, source, texts, out, str(tmp_path / "check")).awaitTermination()
    deltas = incremental._changes(spark, out, "evidence")
    assert deltas.count() == deltas.select("id").distinct().count() == 3
