import datetime

import pytest
from pyspark.sql import functions as F

from lorewell.sources import articles, tables, versions

XML = """<PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">1</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>2021 Jan-Feb</MedlineDate></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>A <i>mixed</i> &amp; title</ArticleTitle>
<Abstract><AbstractText Label="AIM">One <b>two</b>.</AbstractText><AbstractText>Three.</AbstractText></Abstract>
<AuthorList><Author ValidYN="Y"><LastName>Doe</LastName><ForeName>Jo</ForeName><Initials>J</Initials></Author><Author><CollectiveName>Group</CollectiveName></Author><Author ValidYN="N"><LastName>No</LastName></Author></AuthorList>
<PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article><MeshHeadingList><MeshHeading><DescriptorName>M1</DescriptorName></MeshHeading></MeshHeadingList><KeywordList><Keyword>k</Keyword></KeywordList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">1</ArticleId><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>2</PMID><Article><Journal><JournalIssue><PubDate><Year>2020</Year><Month>Feb</Month><Day>31</Day></PubDate></JournalIssue></Journal><ArticleTitle>B</ArticleTitle></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><Article><ArticleTitle>No id</ArticleTitle></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>"""


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    one, two = articles.read_articles_xml(spark, str(tmp_path / "a.xml")).orderBy("pmid").collect()
    assert (one["title"], one["abstract"], one["doi"], one["journal"]) == ("A mixed & title", "AIM: One two.\n\nThree.", "10.1/x", "J")
    assert [a["name"] for a in one["authors"]] == ["Jo Doe"] and one["mesh_terms"] == ["M1"] and one["extra_data"]["keywords"] == ["k"] and one["extra_data"]["publication_types"] == ["Review"]
    assert one["publication_date"] == datetime.date(2021, 1, 1) and two["publication_date"] == datetime.date(2020, 1, 1) and two["abstract"] is None


def test_ingest(spark):
    old = spark.createDataFrame([("a", "1")], "id string, pmid string")
    new = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "2"), ("e", None)], "id string, pmid string")
    after, counts = tables.ingest_documents(old, new)
    assert sorted(r["id"] for r in after.collect()) == ["a", "c"] and counts.first().asDict() == {"fetched": 4, "errors": 1, "inserted": 1, "skipped": 2}
    assert tables.ingest_documents(old, new, dry_run=True)[0].count() == 1


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 0.123456)], "quote string, similarity double")
    tables.export_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().asDict() == {"quote": "a b", "similarity": "0.1235"}
    tables.export_report(df.select("similarity"), str(tmp_path / "md"), "markdown", "T")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "md")).collect()) == sorted(["## T", "", "| similarity |", "| --- |", "| 0.123456 |"])
    lines = tables.markdown(spark.range(40).repartition(3), "N").orderBy("line", "key").collect()
    assert [r["text"] for r in lines] == ["## N", "", "| id |", "| --- |", *(f"| {i} |" for i in range(40))]


def test_tables_are_replaced_whole(spark, tmp_path):
    path, schemas = str(tmp_path / "t"), {"chunks": "id string, document_id string"}
    one = spark.createDataFrame([(str(i), str(i % 5)) for i in range(40)], schemas["chunks"])
    tables.write_tables({"chunks": one}, path)
    again = tables.read_tables(spark, path, schemas)["chunks"]
    tables.write_tables({"chunks": again.filter("document_id <> '0'")}, path, "overwrite")  # made from itself
    assert tables.read_tables(spark, path, schemas)["chunks"].count() == 32
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["chunks"]
    folder = versions.current(spark, f"{path}/chunks").folders[0]
    parts = spark.read.parquet(f"{path}/chunks/{folder}").groupBy("document_id").agg({"part": "min"}).collect()
    assert len(parts) == 4
    with pytest.raises(ValueError, match="exists"):
        tables.write_tables({"chunks": one}, path)
    tables.write_tables({"chunks": one.limit(3)}, path, "append")
    assert tables.read_tables(spark, path, schemas)["chunks"].count() == 35


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    """Killed between the data and the pointer, within the pointer, and between the new pointer and the old data's end."""
    path, schemas = str(tmp_path / "t"), {"entities": "id string"}
    ids = lambda: sorted(r["id"] for r in tables.read_tables(spark, path, schemas)["entities"].collect())
    frame = lambda *x: spark.createDataFrame([(i,) for i in x], schemas["entities"])
    tables.write_tables({"entities": frame("old")}, path)
    real = versions.commit
    for kind in ("before the pointer", "in the pointer"):

        def die(spark, table, *_):
            if kind == "in the pointer":  # noqa: B023
                (tmp_path / "t" / "entities" / "_versions" / "000000002").write_text("folder v-half\n")
            raise SystemExit

        monkeypatch.setattr(versions, "commit", die)
        with pytest.raises(SystemExit):
            tables.write_tables({"entities": frame("new")}, path, "overwrite")
        assert ids() == ["old"]
    monkeypatch.setattr(versions, "commit", real)
    monkeypatch.setattr(versions, "vacuum", lambda *_: (_ for _ in ()).throw(SystemExit))
    with pytest.raises(SystemExit):
        tables.write_tables({"entities": frame("newer")}, path, "overwrite")
    assert ids() == ["newer"]
    monkeypatch.undo()
    tables.write_tables({"entities": frame("last")}, path, "overwrite")
    assert ids() == ["last"] and len([p for p in (tmp_path / "t" / "entities").iterdir() if p.name.startswith("v-")]) == 1


def test_a_reader_keeps_its_version_and_writers_do_not_lose_appends(spark, tmp_path):
    table = str(tmp_path / "t")
    frame = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    versions.add(frame("a"), table, True)
    reader = versions.read(spark, table)
    versions.add(frame("b"), table, True)
    assert [r[0] for r in reader.collect()] == ["a"] and [r[0] for r in versions.read(spark, table).collect()] == ["b"]
    frame("d").write.parquet(f"{table}/v-mine")
    others = []

    def folders(before):
        if not others:  # another writer comes between
            others.append(versions.add(frame("c"), table, False))
        return [*before.folders, "v-mine"]

    versions.commit(spark, table, folders)
    assert sorted(r[0] for r in versions.read(spark, table).collect()) == ["b", "c", "d"]


def test_a_key_is_read_from_its_folder(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id string, chunk_id string"
    tables.write_tables({"evidence": spark.createDataFrame([(str(i), str(i % 30)) for i in range(300)], schema)}, path)
    rows = tables.of_key(spark, path, "evidence", "7", schema)
    assert sorted(int(r["id"]) for r in rows.collect()) == list(range(7, 300, 30))
    assert "PartitionFilters: [isnotnull(part" in rows._jdf.queryExecution().toString()
    large = spark.range(200_000).select(F.col("id").cast("string"), F.lit("one").alias("chunk_id"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        tables.write_tables({"evidence": large}, path, "overwrite")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(tables.of_key(spark, path, "evidence", "one", schema).inputFiles()) > 1  # one key, many tasks


def test_model_outputs(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"run_id": "r", "chunk_id": "c", "pass": "entities", "content": "{}"}\n')
    row = tables.read_model_outputs(spark, str(tmp_path)).first()
    assert (row["run_id"], row["content"], row["document_id"]) == ("r", "{}", None)
