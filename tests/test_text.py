import json

from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators.query import page_meta


def one(spark, column, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values[0])))
    return [r[0] for r in spark.createDataFrame(list(values), schema).select(column).collect()]


def test_entity_types(spark):
    got = one(spark, T.match_entity_type(F.col("c0")), ("gene",), (" Cell Type",), ("compound drug",), ("TISSUE/REGION",), ("cell_type",), ("planet",), (None,))
    assert got == ["Gene", "CellType", "Compound/Drug", "Tissue/Region", "CellType", None, None]


def test_relation_labels(spark):
    got = one(spark, T.match_relation_label(F.col("c0")), ("increases risk",), ("part-of",), ("BINDS",), ("likes",))
    assert got == ["INCREASES_RISK", "PART_OF", "BINDS", None]


def test_sentences_know_unicode_blanks(spark):
    got = one(spark, T.split_sentences(F.col("c0")), ("One. Two! Three? (no) four. five",), ("",), (None,))
    assert got == [["One.", "Two!", "Three? (no) four. five"], [], None]


def test_names_and_hashes(spark):
    assert one(spark, T.normalize_name(F.col("c0")), ("  Alpha  Synuclein. ",), ("GCase",)) == ["alpha synuclein", "gcase"]
    a, b, c = one(spark, T.quote_hash(F.col("c0")), ("x y",), (" x y\n",), ("x z",))
    assert a == b != c and len(a) == 64


def test_locate(spark):
    got = one(spark, T.locate_quote(F.col("c0"), F.col("c1")), ("é B", "aé B"), ("AÉ", "aé"), ("zz", "aé"), ("", "abc"))
    assert [tuple(x) for x in got] == [(1, 4), (0, 2), (None, None), (0, 0)]


def test_json_is_found_and_mended(spark):
    answers = ['```json\n{"a": [1, 2,]}\n```', 'x {"a": [{"b": 1}{"b": 2}]} y', '{"a": [{"b": 1}, {"b": 2}, {"b"', '{"a": [{"b"', "none", '{"a": "x"\n"b": 2}']
    got = one(spark, T.repair_json(T.extract_json(F.col("c0"))), *[(a,) for a in answers])
    assert json.loads(got[0]) == {"a": [1, 2]}
    assert json.loads(got[1]) == {"a": [{"b": 1}, {"b": 2}]}
    assert json.loads(got[2]) == {"a": [{"b": 1}]}  # the last complete one goes too
    assert json.loads(got[5]) == {"a": "x", "b": 2}
    for bad in (got[3], got[4]):
        try:
            json.loads(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_pages():
    assert [page_meta(t, p, s)["pages"] for t, p, s in ((100, 1, 20), (101, 1, 20), (0, 1, 20), (5, 1, 0))] == [5, 6, 0, 0]
    assert page_meta(100, 3, 10)["offset"] == 20


def test_an_answer_is_mended_once(spark):
    from lorewell.operators import parsing

    rows = [("r", "1", "entities", '{"entities": [{"name": "a", "type": "gene"},]}'), ("r", "2", "entities", "none"), ("r", "1", "relations", '{"relations": [{"head": "a", "tail": "b", "label": "BINDS", "confidence": "x"}]}'), ("r", "2", "relations", "none")]
    outputs = spark.createDataFrame(rows, "run_id string, chunk_id string, pass string, content string")
    mentions, errors = parsing.parse_entities(outputs), parsing.extraction_errors(outputs)
    entity, relation = (parsing.parsed(outputs, kind).filter("json is null") for kind in ("entities", "relations"))
    for df, times in ((mentions, 1), (entity, 2), (relation, 2)):  # a filter and, for the rows that pass it, the column
        assert df._jdf.queryExecution().optimizedPlan().toString().count("```(?:json)?") == times
    assert [r["name"] for r in mentions.collect()] == ["a"]
    assert sorted((r["chunk_id"], r["pass"], r["error"]) for r in errors.collect()) == [("1", "relations", "confidence is no number"), ("2", "entities", "not JSON"), ("2", "relations", "not JSON")]
