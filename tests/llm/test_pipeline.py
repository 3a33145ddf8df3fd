import importlib
import re


import corpus_pipeline
from tests.llm.test_dedup_ops import shingles, texts
from tests.llm.test_mixing import water

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_a_small_corpus(spark, tmp_path):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts(5)]  # the last repeats a row
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    letters = {i for i, t, *_ in rows if t and re.search("[a-zA-Z]", t)}
    assert {r["doc_id"] for r in seen["language"]} == letters
    best = {}
    for r in seen["language"]:
        key = re.sub(r"\s", "", r["text"])
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"]), r["doc_id"]))
    exact = {i for _, i in best.values()}
    assert {r["doc_id"] for r in seen["exact_copies"]} == exact
    sets = {r["doc_id"]: shingles(r["text"]) for r in seen["exact_copies"]}
    near = {r["doc_id"] for r in seen["near_copies"]}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert near <= exact and not any(linked(a, b) for a in near for b in near if a < b)
    left = exact - near
    while left:  # each dropped one hangs on a kept one, through others perhaps
        hang = {a for a in left if any(linked(a, b) for b in exact - left)}
        assert hang
        left -= hang
    assert len(seen["exact_copies"]) == len(exact) and len(seen["near_copies"]) == len(near)
    # Words taken are within a word of each source's target by water filling, and no row is taken more than 3 times.
    got = [r["doc_id"] for r in seen["mixture"]]
    size, by = {}, {}
    for r in seen["near_copies"]:
        size[r["doc_id"]] = len(r["text"].split())
        by.setdefault(r["source"], []).append(r["doc_id"])
    names = sorted(by)
    for name, target in zip(names, water([sum(size[i] for i in by[n]) for n in names], [5, 2, 1])):
        assert abs(sum(size[i] for i in got if i in by[name]) - target) <= 3
    assert max(got.count(i) for i in set(got)) <= 3
    assert all(r["round_trip"] for r in seen["encoding"]) and sorted(r["doc_id"] for r in seen["encoding"]) == sorted(got)


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    text = lambda k: " ".join(f"word{k}x{j}" for j in range(40))
    # Two null ids; id 1 on two texts; 2 on a row that stands there twice; 3 an exact and 4 a near copy of a null id's.
    rows = [(None, text(0)), (None, text(1)), (1, text(2)), (1, text(3)), (2, text(4)), (2, text(4)), (3, text(0)), (4, text(1) + " end")]
    rows = [(i, t, "en", "s", len(t)) for i, t in rows]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    key = lambda found: sorted((-1 if r[0] is None else r[0], r[1]) for r in found)
    left = {"language": rows, "exact_copies": rows[:5] + rows[7:], "near_copies": rows[:5], "mixture": rows[:5]}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name in left:
            assert key(docs.select("doc_id", "text").collect()) == key(left[name]), name
    out = docs.collect()
    assert key((r["doc_id"], "") for r in out) == key((i, "") for i, *_ in rows[:5]) and all(r["round_trip"] for r in out)
    # A row that stands twice and is due once a row leaves the mixture twice, not four times.
    twice = spark.createDataFrame([rows[4]] * 2 + [rows[0]], COLUMNS)
    assert key(corpus_pipeline.mixture(spark, twice, "").select("doc_id", "text").collect()) == key([rows[0], rows[4], rows[4]])


def test_stages_with_clashing_columns_and_without_rows(spark, tmp_path):
    names = ["copies", "_copy", "ids", "decoded", "lang_pred", "score", "rejected", "row", "key", "doc", "size", "digest"]
    schema = COLUMNS + "".join(f", {n} string" for n in names)
    rows = [(i, " ".join(f"word{i % 7}x{j}" for j in range(30)), "en", None, 9, *names) for i in range(12)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [*(c.split()[0] for c in COLUMNS.split(", ")), *names]
            path = str(tmp_path / f"{len(data)}-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        found = docs.collect()
        assert {r["doc_id"] for r in found} == {i for i, *_ in data[:7]} and all(list(r)[5:] == names for r in found)
        assert corpus_pipeline.encoding(spark, docs, "").count() == len(found)


def test_entry_lists_them():
    """One query for each of the thirteen operators and the pipeline; SQL for none but registered queries."""
    entry = importlib.import_module("__spark_entry__")
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_\w+$", n)[1]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run and set(entry.oracle_sql()) <= set(entry.queries())
    assert {n for n in names if n in entry.oracle_sql()} == {"op4_exact_dedup", "op8_url_filter", "op11_exact_top_k", "op12_hard_negatives", "op13_merkle_manifest"}
