import random

import pytest
from pyspark.sql import functions as F

from lorewell.operators import quality, query, runlog, term_index

ENTITY = "id string, name string, normalized_name string, type string, aliases array<string>"
PATTERNS = ["abc", "ABC", "a%c", "ab_a", "a", "", "%", "bcab%abca", "a\\%b", "é", "éab", "zzz", "abcabcabc"]


@pytest.fixture(scope="module")
def entities(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcABC%_é ") for _ in range(rng.randint(0, 9)))
    rows = [(str(i), word(), word(), "Gene", None if i % 3 else [word(), word()]) for i in range(300)]
    return spark.createDataFrame([*rows, ("n", None, None, "Gene", None)], ENTITY)


def test_the_index_finds_what_a_scan_finds(spark, entities, tmp_path):
    path = str(tmp_path / "index")
    term_index.build_term_index(entities, path)
    for p in PATTERNS:
        scan = sorted(r["id"] for r in term_index.find(entities, p).collect())
        assert sorted(r["id"] for r in term_index.find(entities, p, path).collect()) == scan, p
        assert sorted(r["id"] for r in quality.matching(entities, p, path).collect()) == sorted(r["id"] for r in quality.matching(entities, p).collect()), p
    assert term_index.find(entities, "abc", path).count() > 0
    none = spark.createDataFrame([], "id string, head_id string, tail_id string, label string, confidence double")
    assert query.search_entities(entities, none, "abc", index=path).count() == query.search_entities(entities, none, "abc").count()
    term_index.build_term_index(entities.limit(0), path)  # replaced as a whole
    assert term_index.find(entities, "abc", path).count() == 0


def test_grams_of_patterns():
    assert term_index.grams_of("Abcd%x_yza") == ["abc", "bcd", "yza"]
    assert term_index.grams_of("ab%cd") == [] == term_index.grams_of("")
    assert term_index.grams_of("a\\%bc") == ["%bc", "a%b"] and term_index.grams_of("abécde") == ["cde"]


def test_a_search_reads_its_folders_and_grams_alone(spark, entities, tmp_path):
    path = str(tmp_path / "index")
    term_index.build_term_index(entities, path)
    plan = term_index.candidates(spark, path, "abcab")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [Or" in plan or "In(gram" in plan


def test_constraints_are_counted_as_one_by_one(spark):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    rel = [(str(i % 90), pick("e1", "e2", "lost", None), pick("e1", "e3"), pick("A", "B", None), pick(0.5, 1.5, None)) for i in range(100)]
    tables = {
        "entities": spark.createDataFrame([("e1", "n", "n", "Gene"), ("e2", None, "n", "Gene"), ("e3", "m", None, "Gene"), ("e4", "m", None, "Gene"), ("e5", "m", None, "Gene")], "id string, name string, normalized_name string, type string"),
        "relations": spark.createDataFrame(rel, "id string, head_id string, tail_id string, label string, confidence double"),
        "evidence": spark.createDataFrame([(pick("1", "gone"), "c", pick("q", None), pick("h", "k")) for _ in range(30)], "relation_id string, chunk_id string, quote string, quote_hash string"),
        "jobs": spark.createDataFrame([(101, 5, 4), (5, 1, 2), (None, None, 3)], "progress int, processed_items int, total_items int"),
    }
    got = {r["rule"]: r["violations"] for r in quality.check_constraints(tables).collect()}
    ids = {r["id"] for r in tables["entities"].collect()}
    rows = tables["evidence"].collect()
    count = lambda keys: sum(n > 1 for n in {k: keys.count(k) for k in keys}.values())
    assert got == {
        "entities: unique normalized_name, type": 2, "relations: unique head_id, tail_id, label": count([r[1:4] for r in rel]), "evidence: unique relation_id, chunk_id, quote_hash": count([(r[0], r[1], r[3]) for r in rows]),
        "relations.head_id in entities": sum(r[1] is not None and r[1] not in ids for r in rel), "relations.tail_id in entities": 0, "evidence.relation_id in relations": sum(r[0] == "gone" for r in rows),
        "relations: confidence between 0 and 1": sum(r[4] == 1.5 for r in rel), "jobs: progress between 0 and 100": 1, "jobs: processed <= total": 1,
        "entities.name not null": 1, "entities.normalized_name not null": 3, "entities.type not null": 0, "relations.label not null": sum(r[3] is None for r in rel), "evidence.quote not null": sum(r[2] is None for r in rows), "evidence.quote_hash not null": 0,
    }


def test_each_table_is_scanned_once(spark, tmp_path):
    tables = {}
    for name, schema in (("entities", "id string, name string, normalized_name string, type string"), ("relations", "id string, head_id string, tail_id string, label string, confidence double")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    plan = quality.check_constraints(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_diffs_by_digests_are_the_full_join(spark):
    rng = random.Random(9)
    old = [(i, rng.choice(["a", None]), i % 7) for i in range(500)]
    new = [(i, "b" if i % 50 == 3 else v, n) for i, v, n in old if i % 60 != 4] + [(900 + i, None, 1) for i in range(5)]
    kind = "k long, v string, n long"
    a, b = spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)
    want = {(str(k), "DELETE") for k in {r[0] for r in old} - {r[0] for r in new}} | {(str(k), "INSERT") for k in range(900, 905)} | {(str(k), "UPDATE") for k, v, n in new if k < 900 and (k, v, n) not in old}
    for buckets in (1, 64, 4096):
        assert {(r["record_id"], r["action"]) for r in runlog.diff_snapshots(a, b, ["k"], "t", buckets).collect()} == want
    pack = lambda df: runlog._packed(df, ["k"], 64)
    assert runlog.unlike_buckets(pack(a), pack(a.repartition(5).orderBy(F.desc("k")))).count() == 0  # no row is joined
    assert 0 < runlog.unlike_buckets(pack(a), pack(a.filter("k <> 7"))).count() < 2
    assert runlog.diff_snapshots(a.limit(0), a.limit(0), ["k"], "t").count() == 0
