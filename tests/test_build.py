from pyspark.sql import functions as F

from lorewell import schemas
from lorewell.operators import build, evidence, merge, quality, runlog
from lorewell.plans.kg import build_kg

ENTITIES = '{"entities": [{"name": "GBA1", "type": "gene", "normalized_name": "gba1"}, {"name": "Parkinson", "type": "Disease", "normalized_name": "PD"}, {"name": "x", "type": "planet"}]}'
RELATIONS = '```json\n{"relations": [{"head": "GBA1", "tail": "Parkinson", "label": "increases-risk", "confidence": "0.9", "evidence": "GBA1 raises risk"}, {"head": "GBA1", "tail": "nobody", "label": "BINDS", "evidence": ""}, {"head": "GBA1", "tail": "Parkinson", "label": "LIKES"}, {"head": "GBA1", "tail": "Parkinson", "label": "BINDS", "confidence": 0.4}]}\n```'


def outputs(spark, *rows):
    return spark.createDataFrame([("r", c, "d", p, x) for c, p, x in rows], schemas.OUTPUTS)


def chunks(spark):
    return spark.createDataFrame([("1", "d", "So gba1 raises risk here."), ("2", "d", "Nothing.")], "id string, document_id string, text string")


def test_build_kg_and_again(spark):
    o = outputs(spark, ("1", "entities", ENTITIES), ("1", "relations", RELATIONS), ("2", "entities", ENTITIES.replace("GBA1", "Gba-1")), ("2", "relations", '{"relations": [{"label": "BINDS", "confidence": "high"}]}'))
    g = build_kg(o, chunks(spark))
    entities = {r["normalized_name"]: r for r in g.entities.collect()}
    assert entities["gba1"]["name"] == "GBA1" and entities["gba1"]["aliases"] == ["Gba-1"] and set(entities) == {"gba1", "pd"}
    relations = g.relations.collect()
    assert [(r["label"], r["confidence"]) for r in relations] == [("INCREASES_RISK", 0.9)]
    quotes = g.evidence.collect()
    assert [(r["quote_start"], r["quote_end"]) for r in quotes] == [(3, 19)]
    assert g.unresolved.count() == 1 and [r["error"] for r in g.errors.collect()] == ["confidence is no number"]
    again = build_kg(o, chunks(spark), g.entities, g.relations, g.evidence)
    for name in ("entities", "relations", "evidence"):
        assert sorted(map(str, getattr(again, name).select("id").collect())) == sorted(map(str, getattr(g, name).select("id").collect()))


def test_quarantine_and_constraints(spark):
    t = spark.createDataFrame([("a", 1.2), ("b", None), ("c", 0.3)], "head string, confidence double")
    ok, bad = build.quarantine_relations(t)
    assert ok.count() == 2 and bad.first()["head"] == "a"
    rel = spark.createDataFrame([("r", "a", "b", "L", 1.5), ("s", "a", "b", "L", None)], "id string, head_id string, tail_id string, label string, confidence double")
    found = {r["rule"]: r["violations"] for r in quality.check_constraints({"relations": rel}).collect()}
    assert found["relations: unique head_id, tail_id, label"] == 1 and found["relations: confidence between 0 and 1"] == 1


def test_overall_score(spark):
    checks = lambda *x: spark.createDataFrame([(v,) for v in x], "passed boolean")
    score = lambda c, n: quality.overall_score(c, n).first()["score"]
    assert [score(checks(True), 0), score(checks(True, False), 2), score(checks(True), 3), score(checks(False), 0)] == ["PASS", "WARN", "FAIL", "FAIL"]


def test_merge_and_diff(spark):
    e = spark.createDataFrame([("1", "A", "a", "Gene", ["x"]), ("2", "B", "b", "Gene", None)], "id string, name string, normalized_name string, type string, aliases array<string>")
    r = spark.createDataFrame([("r", "2", "1", "BINDS", 0.5), ("s", "1", "1", "BINDS", 0.7)], "id string, head_id string, tail_id string, label string, confidence double")
    kept, edges, audit = merge.merge_entities(e, r, spark.createDataFrame([("2", "1")], "source_id string, target_id string"))
    assert kept.first()["aliases"] == ["x", "B"] and [tuple(x)[1:] for x in edges.collect()] == [("1", "1", "BINDS", 0.7)] and audit.first()["action"] == "MERGE"
    diff = runlog.diff_snapshots(e, e.filter("id = '1'").withColumn("name", F.lit("Z")), ["id"], "entities").collect()
    assert {(d["record_id"], d["action"]) for d in diff} == {("1", "UPDATE"), ("2", "DELETE")}


def test_dedup_is_idempotent(spark):
    ev = spark.createDataFrame([("1", "r", "h", 2), ("2", "r", "h", 1), ("3", "r", "g", 5)], "id string, relation_id string, quote_hash string, created_at int")
    once = evidence.dedup_evidence(ev)
    assert sorted(x["id"] for x in once.collect()) == ["2", "3"] == sorted(x["id"] for x in evidence.dedup_evidence(once).collect())
    evidence.assert_unique(once, ["relation_id", "quote_hash"])


def test_unique_and_authors(spark):
    import pytest
    from pyspark.sql import functions as F

    from lorewell.functions import text as T
    from lorewell.operators import evidence, runlog

    twice = spark.createDataFrame([("a", 1), ("a", 1)], "id string, n int")
    assert evidence.assert_unique(twice.limit(1), ["id"]).count() == 1
    with pytest.raises(ValueError, match="not unique"):
        evidence.assert_unique(twice, ["id"])
    people = spark.createDataFrame([([("A B",), ("",)],)], "authors array<struct<name:string>>")
    assert people.select(T.author_names(F.col("authors"))).first()[0] == ["A B"]
    runs = spark.createDataFrame([(str(i), "running", i) for i in range(5)], "id string, status string, created_at int")
    page, total = runlog.list_jobs(runs, "running", 2, 2)
    assert [r["id"] for r in page.collect()] == ["2", "1"] and total.first().asDict() == {"total": 5, "pages": 3}
    assert runlog.bulk_delete_audit(twice.select("id"), "t").count() == 1


def test_graph_of_one_text(spark):
    from lorewell.plans.kg import kg_from_text

    g = kg_from_text(spark, "x", ENTITIES, RELATIONS)
    assert g.entities.count() > 0 and g.relations.count() > 0 and g.errors.count() == 0


ODD = """{"entities": [{"name": "A", "type": "Gene", "normalized_name": "a"}, {"name": "A", "type": "Disease", "normalized_name": "other"}, null, {"type": "Gene"}, {"name": "B c", "type": "gene"}]}"""
ODDER = """{"relations": [{"head": "A", "tail": "B c", "label": "BINDS", "confidence": 0.6, "evidence": " b "}, {"head": "A", "label": "inhibits", "confidence": 0.9}, null, {"head": "x", "tail": "A", "label": "BINDS"}, {"head": "A", "tail": "B c", "label": "BINDS", "confidence": 7}, {"head": "A", "tail": "A", "label": "BINDS", "confidence": "NaN"}]}"""


def test_a_chunk_in_one_row_says_what_its_answers_say(spark):
    from lorewell.operators import parsing
    from lorewell.plans.kg import mentions_of, triples_of

    many = '{"entities": [' + ", ".join(f'{{"name": "n{i}", "type": "{"Gene" if i % 3 else "planet"}"}}' for i in range(50)) + "]}"
    long = '{"relations": [' + ", ".join(f'{{"head": "n{i}", "tail": "n{i + 1}", "label": "BINDS", "confidence": {0.5 + i % 4 / 10}}}' for i in range(48)) + "]}"
    o = outputs(spark, ("1", "entities", ODD), ("1", "relations", ODDER), ("2", "entities", many), ("2", "relations", long), ("3", "relations", ODDER), ("4", "entities", ODD), ("4", "relations", "no"), (None, "entities", ODD), (None, "relations", ODDER))
    mentions = parsing.parse_entities(o)
    resolved = build.resolve_mentions(parsing.parse_relations(o, mentions), mentions)
    parsed = parsing.parse_chunks(o)
    rows = lambda df, like: sorted(map(str, df.select(like.columns).collect()))
    assert rows(mentions_of(parsed), mentions) == rows(mentions, mentions) and mentions.count() > 20
    triples = triples_of(parsed)
    triples = triples.withColumns({"head_id": build.end_id(triples, "h"), "tail_id": build.end_id(triples, "t")})
    assert rows(triples, resolved) == rows(resolved, resolved) and resolved.count() > 30
    left = {r["chunk_id"] for r in mentions_of(parsing.parse_chunks(o, drop_on_error=True)).collect()}
    assert left == {"1", "2", None}


def test_answers_meet_once_and_edges_are_grouped_by_names(spark):
    o = outputs(spark, ("1", "entities", ENTITIES), ("1", "relations", RELATIONS))
    g = build_kg(o, chunks(spark))
    for df, most in ((g.relations, 1), (g.evidence, 1)):
        done = df._jdf.queryExecution().executedPlan().toString()
        assert done.count("Exchange hashpartitioning") == most and "sha2" not in done[done.index("Exchange hashpartitioning") :]
