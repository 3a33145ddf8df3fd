"""Registered queries of the graph engine, one an operator, over the driver's tables. Each runs over whole tables; limits
stand only where they are the feature."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import build, chunking, evidence, merge, parsing, quality, query, runlog, term_index
from .plans import graph
from .plans.kg import build_kg, extract_document
from .plans.star import Star, entity_id, normal
from .sources import tables
from .sources.shared import shared_dir, store
from .streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SEGMENTS = ["Supplier#", "small", "HOUSE", "nowhere"]


def query_of(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("abstract"), "lang", "source")


def char_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_chars(documents(spark, d))


# Sources


@query_of
def s3_ingest_documents(spark, d):
    """Half of the documents exist; the other half and repeats of the first arrive. pmid is the id without its last digit."""
    docs = documents(spark, d).select("id", F.floor(F.col("id") / 10).cast("string").alias("pmid"), "abstract")
    after, _ = tables.ingest_documents(docs.filter("id % 20 = 0"), docs, order=("id",))
    return after.select("id", "pmid")


@query_of
def s4_filter_corpus(spark, d):
    return tables.filter_corpus(documents(spark, d), [["the", "la "], ["tion", "ung"]], text=("abstract",)).select("id", "score")


@query_of
def s4_filter_corpus_dates(spark, d):
    """Three months of a year, a document a day, the best 25."""
    dated = documents(spark, d).withColumn("publication_date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 365).cast("int")))
    return tables.filter_corpus(dated, [["the", "la ", "der "]], min_date="2024-02-01", max_date="2024-04-30", limit=25, text=("abstract",)).select("id", "score", "publication_date")


@query_of
def s5_full_text(spark, d):
    return documents(spark, d).select("id", F.md5(T.full_text(F.col("source"), F.col("abstract"))).alias("h"))


@query_of
def s7_read_write(spark, d):
    """Entities and evidence written, written again over themselves and read back."""
    s, path = Star(spark, d, keep=True), shared_dir(spark, "tables")
    schemas = {"entities": "id string, name string", "evidence": "id string, chunk_id string"}
    for _ in range(2):
        tables.write_tables({"entities": s.entities.select("id", "name"), "evidence": s.evidence.select("id", "chunk_id")}, path, "overwrite")
    got = tables.read_tables(spark, path, schemas)
    return got["entities"].select(F.lit("entity").alias("kind"), "id", F.col("name").alias("value")).union(got["evidence"].select(F.lit("evidence"), "id", "chunk_id"))


# Chunking


@query_of
def c1_split_sentences(spark, d):
    return documents(spark, d).select("id", F.posexplode(T.split_sentences(F.col("abstract"))).alias("pos", "sentence"))


@query_of
def c2_split_paragraphs(spark, d):
    return documents(spark, d).select("id", F.posexplode(T.split_paragraphs(F.col("abstract"))).alias("pos", "paragraph"))


@query_of
def c3_chunk_sentences(spark, d):
    return chunking.chunk_sentences(documents(spark, d)).select("document_id", "chunk_index", "text", "start_offset", "end_offset", "token_count")


@query_of
def c4_chunk_chars(spark, d):
    return char_chunks(spark, d).select("document_id", "chunk_index", "text", "start_offset", "end_offset")


@query_of
def c5_estimate_tokens(spark, d):
    return documents(spark, d).select("id", T.estimate_tokens(F.col("abstract")).alias("tokens"))


@query_of
def c6_chunk_pending(spark, d):
    docs = documents(spark, d)
    have = chunking.chunk_sentences(docs.filter("id % 3 = 0"))
    return chunking.chunk_pending(docs, have).groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


@query_of
def c7_chunking_stats(spark, d):
    return chunking.chunking_stats(documents(spark, d), char_chunks(spark, d)).withColumn("avg_chunks", F.round("avg_chunks", 6))


@query_of
def c8_document_chunks(spark, d):
    """Every other chunk of one document has extractions."""
    chunks = char_chunks(spark, d)
    return chunking.document_chunks(chunks, chunks.filter("chunk_index % 2 = 0").select(F.col("id").alias("chunk_id")), 7).select("document_id", "chunk_index", "has_extractions")


@query_of
def c9_chunk_at_offset(spark, d):
    chunks = char_chunks(spark, d)
    at = documents(spark, d).select(F.col("id").alias("document_id"), F.explode(F.array(F.lit(0), F.lit(850), F.lit(1700))).alias("offset"))
    return chunking.chunk_at_offset(chunks, at).select("document_id", "offset", "chunk_index", "relative")


@query_of
def c9_chunk_at_offset_first(spark, d):
    at = documents(spark, d).select(F.col("id").alias("document_id"), F.explode(F.array(F.lit(0), F.lit(850), F.lit(1700))).alias("offset"))
    return chunking.chunk_at_offset(char_chunks(spark, d), at, first=True).select("document_id", "offset", "chunk_index", "relative")


@query_of
def c11_preview_chunks(spark, d):
    return chunking.preview_chunks(documents(spark, d), 5, size=1000, overlap=200).select("document_id", "chunk_index", "text", "start_offset", "end_offset")


@query_of
def c10_offsets(spark, d):
    a, b = F.col("start_offset"), F.col("end_offset")
    return char_chunks(spark, d).select("document_id", "chunk_index", T.relative_offset(F.lit(900), a, b).alias("relative"), T.absolute_offset(F.lit(150), a, b).alias("absolute"))


@query_of
def c6_rechunk(spark, d):
    """All documents with text chunked anew; chunks of a document without any stay."""
    docs = documents(spark, d)
    have = chunking.chunk_sentences(docs.filter("id % 3 = 0"), 500, 50)
    lost = have.filter("chunk_index = 0").withColumn("document_id", -F.col("document_id") - 1)
    return chunking.chunk_pending(docs, have.unionByName(lost), replace=True).groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


# Model answers


@query_of
def x2_repair_json(spark, d):
    """The entity answers, fenced and with a comma too many, as JSON."""
    answers = Star(spark, d).outputs.filter(F.col("pass") == "entities")
    return answers.select("chunk_id", F.md5(T.repair_json(T.extract_json(F.col("content")))).alias("h"))


@query_of
def x2_repairs_parsed(spark, d):
    """The entity answers with every fault that is mended, a sixth of the chunks each: a comma too many, none between objects,
    none after a string, a number or an object at a line's end, and answers that were cut off."""
    lines = Star(spark, d).mentions.filter(F.col("chunk_id").startswith("o"))
    kind = F.pmod(F.substring("chunk_id", 2, 20).cast("long"), F.lit(6))
    item = F.to_json(F.struct("name", "type", "normalized_name"))
    item = F.when(kind == 2, F.replace(item, F.lit(',"type"'), F.lit('\n"type"'))).when(kind == 3, F.concat(F.lit('{"score":1\n'), F.substring(item, 2, 2000))).when(kind == 4, F.concat(F.lit('{"of":{}\n'), F.substring(item, 2, 2000))).otherwise(item)
    lines = lines.groupBy("chunk_id", kind.alias("kind")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", item.alias("j")))), lambda x: x["j"]).alias("items"))
    body = F.concat(F.lit('Sure: {"entities": ['), F.when(F.col("kind") == 1, F.array_join("items", " ")).otherwise(F.array_join("items", ", ")))
    content = F.when(F.col("kind") == 5, F.expr("substring(body, 1, char_length(body) - 5)")).when(F.col("kind") == 0, F.concat("body", F.lit(",]}"))).otherwise(F.concat("body", F.lit("]}")))
    answers = lines.withColumn("body", body).select(F.lit("run1").alias("run_id"), "chunk_id", F.lit("entities").alias("pass"), content.alias("content"))
    return parsing.parse_entities(answers).select("chunk_id", "position", "name", "type", "normalized_name")


def _long_answers(spark: SparkSession, d: str) -> DataFrame:
    """All lines of a customer as one chunk: more entities and relations than are taken of one."""
    s = Star(spark, d, keep=True)
    lines = s.lines.join(s.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    named = lambda c, kind: F.struct(F.col(c).alias("name"), F.lit(kind).alias("type"), F.lower(F.translate(c, " -", "__")).alias("normalized_name"))
    both = F.to_json(F.array(named("head", "Gene"), named("tail", "Compound/Drug")))
    relation = F.to_json(F.struct("head", "tail", "label", "confidence", "evidence"))
    rows = lines.withColumns({"both": both, "relation": relation}).select("o_custkey", F.struct("l_orderkey", "position", F.expr("substring(both, 2, char_length(both) - 2)").alias("both"), "relation").alias("x"))
    rows = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    text = lambda name, field: F.concat(F.lit(f'{{"{name}": ['), F.array_join(F.col(f"xs.{field}"), ", "), F.lit("]}"))
    rows = rows.select(F.concat(F.lit("c"), "o_custkey").alias("chunk_id"), F.explode(F.array(F.struct(F.lit("entities").alias("pass"), text("entities", "both").alias("content")), F.struct(F.lit("relations").alias("pass"), text("relations", "relation").alias("content")))).alias("a"))
    return rows.select(F.lit("run1").alias("run_id"), "chunk_id", "a.*")


@query_of
def x3_parse_capped(spark, d):
    return parsing.parse_entities(_long_answers(spark, d)).select("chunk_id", "position", "name", "type")


@query_of
def x4_parse_capped(spark, d):
    answers = _long_answers(spark, d)
    return parsing.parse_relations(answers, parsing.parse_entities(answers)).select("chunk_id", "position", "head", "tail", "label", "confidence")


@query_of
def x3_parse_entities(spark, d):
    return parsing.parse_entities(Star(spark, d).outputs).select("chunk_id", "position", "name", "type", "normalized_name")


@query_of
def x4_parse_relations(spark, d):
    outputs = Star(spark, d).outputs
    return parsing.parse_relations(outputs, parsing.parse_entities(outputs)).select("chunk_id", "position", "head", "tail", "label", "confidence", "evidence")


@query_of
def x5_extraction_errors(spark, d):
    return parsing.extraction_errors(Star(spark, d).outputs)


@query_of
def x6_match_entity_type(spark, d):
    """Event types and part types against a vocabulary in another spelling."""
    words = Star(spark, d).table("part").select(F.col("p_type").alias("value")).distinct()
    return words.select("value", T.match_entity_type(F.lower("value"), ["ECO NOMY", "Standard", "pro/mo"]).alias("type"))


@query_of
def x7_match_relation_label(spark, d):
    """Labels in another spelling."""
    spelled = Star(spark, d).lines.select(T.match_relation_label(F.concat(F.lit(" "), F.lower(F.translate("label", "_", "-")))).alias("label"))
    return spelled.groupBy("label").agg(F.count("*").alias("count"))


@query_of
def x9_validate_vocabulary(spark, d):
    return parsing.validate_vocabulary(Star(spark, d).table("part"), "p_type", ["ECONOMY", "PROMO"])


@query_of
def x10_normalize_name(spark, d):
    part = Star(spark, d).table("part")
    return part.select("p_partkey", T.normalize_name(F.concat(F.lit(" ("), F.upper("p_name"), F.lit("  "), F.col("p_brand"), F.lit(". "))).alias("name"))


@query_of
def x11_extraction_summary(spark, d):
    o = Star(spark, d).outputs
    m = parsing.parse_entities(o)
    return parsing.extraction_summary(o, m, parsing.parse_relations(o, m))


# Graph build


@query_of
def g1_build_entities(spark, d):
    return Star(spark, d).entities.withColumn("aliases", F.array_join(F.array_sort("aliases"), "|"))


@query_of
def g2_resolve_mentions(spark, d):
    s = Star(spark, d)
    return build.resolve_mentions(s.lines.drop("l_orderkey"), s.mentions).select("chunk_id", "position", "head_id", "tail_id")


@query_of
def g3_build_relations(spark, d):
    return Star(spark, d).relations


@query_of
def g4_locate_quotes(spark, d):
    s = Star(spark, d, keep=True)
    return build.locate_quotes(s.evidence, s.chunks).select("id", "quote_start", "quote_end")


@query_of
def g6_build_evidence(spark, d):
    return Star(spark, d).evidence


@query_of
def g7_pending_chunks(spark, d):
    s = Star(spark, d)
    orders = s.table("orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"))
    return build.pending_chunks(orders, s.evidence)


@query_of
def g8_extract_document(spark, d):
    """The graph of one customer's orders."""
    s = Star(spark, d, keep=True)
    return extract_document(s.outputs, s.chunks, 7).relations


@query_of
def g9_build_kg(spark, d):
    s = Star(spark, d, keep=True)
    g = build_kg(s.outputs, s.chunks)
    return g.relations


@query_of
def g9_build_kg_drop_on_error(spark, d):
    """A chunk whose relation answer is no JSON loses its mentions too."""
    s = Star(spark, d, keep=True)
    return build_kg(s.outputs, s.chunks, drop_on_error=True).mentions.select("chunk_id", "position", "name", "type")


@query_of
def g9_build_kg_evidence(spark, d):
    s = Star(spark, d, keep=True)
    return build_kg(s.outputs, s.chunks).evidence.select("id", "relation_id", "chunk_id", "quote")


@query_of
def g9_build_kg_entities(spark, d):
    s = Star(spark, d, keep=True)
    return build_kg(s.outputs, s.chunks).entities.select("id", "name", "normalized_name", "type")


@query_of
def g11_quarantine_relations(spark, d):
    lines = Star(spark, d).lines.withColumn("confidence", F.col("confidence") * 1.25)
    return build.quarantine_relations(lines)[1].select("chunk_id", "position", F.round("confidence", 4).alias("confidence"))


@query_of
def g12_triples(spark, d):
    s = Star(spark, d, keep=True)
    return build.triple_view(s.relations, s.entities, s.evidence).select("id", "triple", "evidence_count", "has_evidence", "is_high_confidence", "is_directional")


@query_of
def g13_relation_evidence(spark, d):
    s = Star(spark, d, keep=True)
    return build.relation_evidence(s.relations, s.evidence).select("id", F.col("evidence_count").cast("long").alias("evidence_count"), F.array_join(F.transform("evidence", lambda e: e["quote"]), "|").alias("quotes"))


# Searches


@query_of
def q1_search_entities(spark, d):
    s = Star(spark, d, keep=True)
    return query.search_entities(s.entities, s.relations, "ring_brand#1").select("id", "name", "type", "out_degree", "in_degree", "degree")


@query_of
def q1_search_indexed(spark, d):
    """Parts of names, with wildcards, with none that has three letters in a row, and that nothing holds, by an index of grams."""
    s, path = Star(spark, d, keep=True), shared_dir(spark, "terms")
    term_index.build_term_index(s.entities, path)
    found = (term_index.find(s.entities, p, path).select(F.lit(p).alias("pattern"), "id", "name") for p in ("RING_brand#1", "supplier#%7", "a_b", "er", "no such name"))
    return reduce(DataFrame.union, found)


@query_of
def e8_term_has_edges_indexed(spark, d):
    s, path = Star(spark, d, keep=True), shared_dir(spark, "terms")
    term_index.build_term_index(s.entities, path)
    return quality.term_has_edges(s.entities, s.relations, "Supplier#00000000", index=path)


@query_of
def q2_entity_matches(spark, d):
    return query.entity_matches(Star(spark, d).entities, "RING BRAND").select("id", "name")


@query_of
def q3_entity_type_counts(spark, d):
    return query.entity_type_counts(Star(spark, d).entities)


@query_of
def q4_get_entity(spark, d):
    s = Star(spark, d)
    return query.get_entity(s.entities, _first_supplier(s)).select("id", "name", "type", F.size("aliases").cast("long").alias("aliases"))


@query_of
def q8_entity_names(spark, d):
    return query.entity_names(Star(spark, d).entities).select("id", F.array_join(F.array_sort("names"), "|").alias("names"))


def _first_supplier(s: Star) -> str:
    name = s.table("supplier").orderBy("s_suppkey").select("s_name").first()[0]
    return s.spark.range(1).select(entity_id("Gene", F.lit(name.lower().replace(" ", "_").replace("-", "_")))).first()[0]


@query_of
def q5_neighborhood(spark, d):
    s = Star(spark, d, keep=True)
    return query.neighborhood(s.entities, s.relations, s.evidence, _first_supplier(s)).select("id", "label", "confidence", "neighbor_id", "neighbor", "direction", "evidence_count")


@query_of
def q6_neighborhood_stats(spark, d):
    s = Star(spark, d, keep=True)
    me = _first_supplier(s)
    return query.neighborhood_stats(s.relations, query.neighborhood(s.entities, s.relations, s.evidence, me), me)


@query_of
def q7_entity_relations(spark, d):
    s = Star(spark, d, keep=True)
    return query.entity_relations(s.relations, s.evidence, _first_supplier(s), "both", 2, 20).select("id", "label", "confidence", F.coalesce(F.size("evidence"), F.lit(0)).cast("long").alias("quotes"))


def _customers(s: Star) -> tuple[DataFrame, DataFrame]:
    """Customers as documents, orders as their chunks."""
    docs = s.table("customer").select(F.col("c_custkey").alias("id"))
    return docs, s.table("orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), F.col("o_custkey").alias("document_id"))


@query_of
def q9_list_documents(spark, d):
    s = Star(spark, d)
    return query.list_documents(*_customers(s), s.evidence)


@query_of
def q9_list_documents_newest(spark, d):
    """The second page of customers, those with the latest first order on top."""
    s = Star(spark, d)
    docs, chunks = _customers(s)
    born = s.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("created_at"))
    listed = query.list_documents(docs.join(born, "id", "left"), chunks, s.evidence)
    return query.paginate(listed, [F.desc_nulls_last("created_at")], 2, 20).select("id", "chunk_count", "has_extractions")


@query_of
def q10_get_document(spark, d):
    s = Star(spark, d)
    return query.get_document(*_customers(s), s.evidence, 7)


@query_of
def q11_delete_documents(spark, d):
    s = Star(spark, d)
    docs, chunks = _customers(s)
    return query.delete_documents(docs, chunks, s.evidence, docs.filter("id % 5 = 0"))[2].select("id", "chunk_id")


@query_of
def q11_delete_documents_rest(spark, d):
    """Documents and chunks that stay, and the audit rows of what goes."""
    s = Star(spark, d, keep=True)
    docs, chunks = _customers(s)
    ids = docs.filter("id % 5 = 0")
    kept = query.delete_documents(docs, chunks, s.evidence, ids)
    row = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"))
    audit = query.documents_audit(docs, chunks, s.evidence, ids).select(F.concat("action", F.lit(" "), "table_name").alias("kind"), F.col("record_id").alias("id"))
    return row(kept[0], "documents").union(row(kept[1], "chunks")).union(audit)


@query_of
def q12_paginate(spark, d):
    return query.paginate(Star(spark, d).entities.select("id", "name"), ["name"], 3, 20)


@query_of
def q13_delete_entities(spark, d):
    """Brands go, and with them their edges and those edges' evidence."""
    s = Star(spark, d, keep=True)
    kept = query.delete_entities(s.entities, s.relations, s.evidence, s.entities.filter(F.col("normalized_name").endswith("_brand#1")).select("id"))
    return reduce(DataFrame.union, (df.select(F.lit(kind).alias("kind"), "id") for kind, df in zip(("entities", "relations", "evidence"), kept)))


# Graph


@query_of
def t1_subgraph(spark, d):
    s = Star(spark, d, keep=True)
    nodes, _ = graph.subgraph(s.entities, s.relations, _first_supplier(s), 1, 50, 100)
    return nodes.select("id", "name", "depth")


@query_of
def t2_subgraph_edges(spark, d):
    s = Star(spark, d, keep=True)
    _, edges = graph.subgraph(s.entities, s.relations, _first_supplier(s), 1, 50, 100, labels=["BINDS", "NONE"], entity_types=["Compound/Drug"], min_confidence=0.7)
    return edges.select("id", "head_id", "tail_id", "label", "confidence")


def _region(s: Star) -> str:
    """The entity of the region Africa."""
    return s.spark.range(1).select(entity_id("Tissue/Region", F.lit("africa"))).first()[0]


@query_of
def t1_subgraph_depth2(spark, d):
    s = Star(spark, d, keep=True)
    return graph.subgraph(s.entities, s.relations, _region(s), 2, 50, 100)[0].select("id", "name", "depth")


@query_of
def t2_subgraph_edges_depth2(spark, d):
    s = Star(spark, d, keep=True)
    return graph.subgraph(s.entities, s.relations, _region(s), 2, 50, 100)[1].select("id", "head_id", "tail_id", "label", "confidence")


@query_of
def t3_subgraph_summary(spark, d):
    s = Star(spark, d, keep=True)
    nodes, edges = graph.subgraph(s.entities, s.relations, _region(s), 2, 50, 100)
    return graph.subgraph_summary(nodes, edges, 50, 100)


@query_of
def t4_find_paths(spark, d):
    """From the first supplier to a customer's segment, over places."""
    s = Star(spark, d, keep=True)
    target = s.table("customer").agg(F.min(entity_id("Disease", F.lower("c_mktsegment")))).first()[0]
    return graph.path_steps(graph.find_paths(s.relations, _first_supplier(s), target, 4, ["EXPRESSED_IN", "ASSOCIATED_WITH"])).select("path_rank", "path_length", F.round("total_confidence", 6).alias("total_confidence"), "step", "node", "edge", "back")


@query_of
def t6_shortest_hops(spark, d):
    s = Star(spark, d, keep=True)
    return graph.shortest_hops(s.relations, spark.createDataFrame([(_first_supplier(s),)], "id string"), 2)


@query_of
def t7_multi_center_subgraph(spark, d):
    s = Star(spark, d, keep=True)
    return graph.multi_center_subgraph(s.entities, s.relations, ["supplier#00000000", "household"], 1)[0].select("id", "depth")


@query_of
def t7_multi_center_depth2(spark, d):
    """Edges between the nodes within two hops."""
    s = Star(spark, d, keep=True)
    return graph.multi_center_subgraph(s.entities, s.relations, ["africa", "household"], 2)[1].select("id", "head_id", "tail_id")


@query_of
def t8_top_degree_graph(spark, d):
    s = Star(spark, d, keep=True)
    return graph.top_degree_graph(s.entities, s.relations)[1].select("id", "head_id", "tail_id", "label", "confidence")


@query_of
def t9_graph_view(spark, d):
    s = Star(spark, d, keep=True)
    nodes, edges = graph.top_degree_graph(s.entities, s.relations, 200)
    return graph.graph_view_tables(nodes.withColumn("depth", F.lit(0)), edges, s.evidence)[1].select("id", F.round("width", 6).alias("width"), "evidence_count", F.array_join("quotes", "|").alias("quotes"), "more")


@query_of
def t9_graph_view_nodes(spark, d):
    s = Star(spark, d, keep=True)
    nodes, edges = graph.top_degree_graph(s.entities, s.relations, 200)
    return graph.graph_view_tables(nodes.withColumn("depth", F.lit(0)), edges, s.evidence)[0].select("id", "connections", "view_label", "is_centre")


@query_of
def t10_graph_stats(spark, d):
    s = Star(spark, d, keep=True)
    return graph.graph_stats(s.entities, s.relations, s.evidence)


@query_of
def t11_degree(spark, d):
    s = Star(spark, d, keep=True)
    return query.degree(s.entities, s.relations).select("id", "out_degree", "in_degree", "degree")


@query_of
def t12_common_neighbors(spark, d):
    s = Star(spark, d, keep=True)
    return quality.common_neighbors(s.entities, s.relations, "supplier#00000000", "asia")


# Evaluation


@query_of
def e1_summary_stats(spark, d):
    s = Star(spark, d, keep=True)
    return quality.summary_stats(s.table("customer"), s.table("orders"), s.entities, s.relations, s.evidence)


@query_of
def e2_duplicates(spark, d):
    s = Star(spark, d)
    mentions, edges = s.mentions.select("normalized_name", "type"), s.resolved.select("head_id", "tail_id", "label")
    return quality.duplicates(mentions, edges, s.raw_evidence)


@query_of
def e3_orphan_relations(spark, d):
    s = Star(spark, d, keep=True)
    return quality.orphan_relations(s.relations, s.entities).select("id", "head_id", "tail_id", "label")


@query_of
def e4_relations_without_evidence(spark, d):
    s = Star(spark, d, keep=True)
    return quality.relations_without_evidence(s.relations, s.evidence).select("id", "label")


@query_of
def e5_entities_without_relations(spark, d):
    s = Star(spark, d, keep=True)
    return quality.entities_without_relations(s.entities, s.relations).select("id", "name")


@query_of
def e6_ratios(spark, d):
    s = Star(spark, d, keep=True)
    return quality.ratios(s.entities, s.relations, s.evidence)


@query_of
def e7_invalid_values(spark, d):
    s = Star(spark, d, keep=True)
    return quality.invalid_values(s.entities, s.relations, ["Gene", "Disease"], ["BINDS", "INHIBITS"])


@query_of
def e8_term_has_edges(spark, d):
    s = Star(spark, d, keep=True)
    return quality.term_has_edges(s.entities, s.relations, "supplier#00000000")


@query_of
def e9_term_coverage(spark, d):
    return quality.term_coverage(Star(spark, d).entities, SEGMENTS, 3)


@query_of
def e10_diversity(spark, d):
    return quality.diversity(Star(spark, d).entities, "type", 3)


@query_of
def e11_evidence_validity(spark, d):
    s = Star(spark, d, keep=True)
    return quality.evidence_validity(s.evidence, s.chunks)


@query_of
def e12_terms_connected(spark, d):
    s = Star(spark, d, keep=True)
    return quality.terms_connected(s.entities, s.relations, [("supplier#00000000", "asia"), ("customer#00000000", "household"), ("ring", "africa")])


@query_of
def e13_overall_score(spark, d):
    """The searches for terms as checks, dangling edges as issues."""
    s = Star(spark, d, keep=True)
    checks = quality.terms_connected(s.entities, s.relations, [("supplier#00000000", "asia"), ("ring", "africa")]).select("passed")
    checks = checks.union(quality.term_has_edges(s.entities, s.relations, "supplier#00000000").select("passed")).union(quality.term_has_edges(s.entities, s.relations, "africa", "in").select("passed"))
    return quality.overall_score(checks, 0)


@query_of
def e14_example_queries(spark, d):
    s = Star(spark, d, keep=True)
    return quality.example_queries(s.entities, s.relations, s.evidence, "supplier#00000000")


@query_of
def e15_extraction_progress(spark, d):
    s = Star(spark, d, keep=True)
    orders = s.table("orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"))
    return quality.extraction_progress(orders, s.entities, s.relations, s.evidence)


@query_of
def e16_check_constraints(spark, d):
    s = Star(spark, d, keep=True)
    return quality.check_constraints({"entities": s.entities, "relations": s.relations, "evidence": s.raw_evidence})


# Evidence


def benchmark_evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Quotes to audit, all of them. By the first letters of the id an eighth is in capitals, and some leave the relation
    out, name it otherwise, hold words too many, join two sentences or are made up."""
    s = Star(spark, d, keep=True)
    n, q = F.substring("id", 1, 2), F.col("quote")
    word = lambda by: F.regexp_replace(q, " [A-Z_]+ ", by)
    quote = F.when(n < "20", F.upper(q)).when(n == "20", word(" ... ")).when(n == "21", word(" acts on ")).when(n == "22", F.concat(F.substring(q, 1, 12), F.lit(" x "), F.substring(q, 13, 1000)))
    quote = quote.when(n == "23", F.concat(q, F.lit(" and so does "), q)).when(n == "24", F.lit("Nothing of this stands in the text at all.")).otherwise(q)
    return s.evidence.withColumn("quote", quote), s.chunks


@query_of
def a1_classify_quotes(spark, d):
    quotes, chunks = benchmark_evidence(spark, d)
    return evidence.classify_quotes(quotes.select("id", "chunk_id", "quote"), chunks).select("id", "category", F.round("similarity", 6).alias("similarity"))


@query_of
def a3_audit_summary(spark, d):
    quotes, chunks = benchmark_evidence(spark, d)
    return evidence.audit_summary(evidence.classify_quotes(quotes.select("chunk_id", "quote"), chunks)).select("audited", "exact", "case_insensitive", "fuzzy", "no_match", "valid")


@query_of
def a6_repair_candidates(spark, d):
    return evidence.repair_candidates(*benchmark_evidence(spark, d)).select("id", "new_quote", "new_start", "new_end", F.round("similarity", 6).alias("similarity"), "sentence_count")


def _capitals(s: Star) -> DataFrame:
    """Candidates that write some quotes in capitals."""
    some = s.evidence.filter(F.substring("id", 1, 1) == "a")
    return some.select("id", F.upper("quote").alias("new_quote"), T.quote_hash(F.upper("quote")).alias("new_hash"), F.lit(0).alias("new_start"), F.char_length("quote").alias("new_end"), (F.char_length("quote") / 100).alias("similarity"), (F.char_length("quote") % 3 + 1).alias("sentence_count"))


@query_of
def a7_apply_repairs(spark, d):
    s = Star(spark, d, keep=True)
    return evidence.apply_repairs(s.evidence, _capitals(s)).select("id", "quote", "quote_hash")


@query_of
def a8_repair_summary(spark, d):
    out = evidence.repair_summary(_capitals(Star(spark, d, keep=True)))
    return out.select("repairs", *(F.round(c, 6).alias(c) for c in ("min_similarity", "avg_similarity", "max_similarity")), "single_sentence", "multi_sentence")


def _repaired(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    quotes, chunks = benchmark_evidence(spark, d)
    return quotes, store(evidence.repair_candidates(quotes, chunks), "candidates")


@query_of
def a7_repair_chain(spark, d):
    """The candidates of A6 applied, then one row a relation and quote, which is checked."""
    quotes, candidates = _repaired(spark, d)
    done = evidence.dedup_evidence(evidence.apply_repairs(quotes, candidates), ("chunk_id", "id"))
    return evidence.assert_unique(store(done, "repaired"), ["relation_id", "quote_hash"]).select("id", "relation_id", "quote", "quote_hash")


@query_of
def a8_repair_chain_summary(spark, d):
    out = evidence.repair_summary(_repaired(spark, d)[1])
    return out.select("repairs", *(F.round(c, 6).alias(c) for c in ("min_similarity", "avg_similarity", "max_similarity")), "single_sentence", "multi_sentence")


@query_of
def a14_diagnosis_chain(spark, d):
    return evidence.diagnosis_recommendations(evidence.diagnose_quotes(*benchmark_evidence(spark, d))).select("cause", "count", "pct", "advice")


@query_of
def a9_diagnose_quotes(spark, d):
    return evidence.diagnosis_summary(evidence.diagnose_quotes(*benchmark_evidence(spark, d)))


@query_of
def a11_dedup_evidence(spark, d):
    return evidence.dedup_evidence(Star(spark, d).raw_evidence).select("id", "relation_id", "quote")


@query_of
def a14_diagnosis_recommendations(spark, d):
    """Quotes with a cause by the first letter of their id."""
    cause = F.when(F.substring("id", 1, 1) < "8", "ELLIPSIS").when(F.substring("id", 1, 1) < "c", "CHUNK_EDGE").otherwise("HALLUCINATED")
    return evidence.diagnosis_recommendations(Star(spark, d).evidence.select(cause.alias("cause"))).select("cause", "count", "pct", F.char_length("advice").alias("advice"))


@query_of
def a13_exact_match(spark, d):
    quotes, chunks = benchmark_evidence(spark, d)
    return evidence.with_text(quotes, chunks).select("id", T.exact_match(F.col("quote"), F.col("chunk_text")).alias("exact"))


# Run log


@query_of
def r1_job_metrics(spark, d):
    """A user's events as a run of twenty items."""
    runs = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("completed_at"), F.count("*").cast("int").alias("processed_items"))
    runs = runs.withColumns({"total_items": F.lit(20), "progress": F.lit(0), "status": F.when(F.col("processed_items") >= 20, "completed").otherwise("running")})
    return runlog.job_metrics(runs).select("id", "progress", "items_remaining", F.round("duration_seconds", 3).alias("duration_seconds"), "is_terminal")


@query_of
def r2_list_jobs(spark, d):
    """A user's events as a run."""
    runs = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("created_at"), F.count("*").alias("n"))
    page, total = runlog.list_jobs(runs.withColumn("status", F.when(F.col("n") >= 20, "completed").otherwise("running")), "completed", 2, 15)
    return page.join(total, F.lit(True)).select("id", "status", "total", "pages")


@query_of
def r3_job_transitions(spark, d):
    """Event types of a user as states of a run."""
    states = {"click": "pending", "view": "running", "purchase": "completed", "error": "failed"}
    e = spark.read.parquet(f"{d}/events.parquet")
    state = F.coalesce(F.create_map(*(F.lit(x) for kv in states.items() for x in kv))[F.col("event_type")], F.lit("cancelled"))
    return runlog.job_transitions(e.select(F.col("user_id").alias("job_id"), "ts", "event_id", state.alias("status")), tie=("event_id",)).select("job_id", "event_id", "status", "before")


@query_of
def r4_diff_snapshots(spark, d):
    """Customers before and after a change."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
    new = c.filter("c_custkey % 7 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 5 == 0, 0).otherwise(F.col("c_nationkey")))
    return runlog.diff_snapshots(c, new, ["c_custkey"], "customer").select("table_name", "record_id", "action")


@query_of
def r5_merge_entities(spark, d):
    """Every brand-1 part into the one with the smallest id."""
    s = Star(spark, d, keep=True)
    parts = s.entities.filter(F.col("normalized_name").endswith("_brand#1")).select("id")
    least = parts.agg(F.min("id").alias("target_id"))
    mapping = parts.join(least, F.col("id") != F.col("target_id")).select(F.col("id").alias("source_id"), "target_id")
    return merge.merge_entities(s.entities, s.relations, mapping)[1]


def _supplier_chains(s: Star) -> tuple[DataFrame, merge.Merged]:
    """The edges between entities that exist, and the graph after suppliers are merged: each into the one with half its
    number, so in chains; 5 into 10, a cycle; every ninth also into the one before it; one into an entity that there is none of."""
    n, at = F.col("s_suppkey"), lambda c: entity_id("Gene", normal(F.format_string("Supplier#%09d", c.cast("int"))))
    keys = s.table("supplier").select("s_suppkey")
    to = F.when(n == 5, F.lit(10)).otherwise(F.floor(n / 2))
    mapping = keys.filter("s_suppkey >= 2 and s_suppkey <> 7").select(at(n).alias("source_id"), at(to).alias("target_id"))
    mapping = mapping.union(keys.filter("s_suppkey > 0 and s_suppkey % 9 = 0").select(at(n), at(n - 1))).union(keys.filter("s_suppkey = 7").select(at(n), F.lit("nowhere")))
    sound = quality.sound_relations(s.relations, s.entities)
    return sound, merge.merge_graph(s.entities, sound, mapping, s.evidence)


@query_of
def r5_merge_chains(spark, d):
    """Chains, cycles, several targets and a target that does not exist: the edges after the merge."""
    return _supplier_chains(Star(spark, d, keep=True))[1].relations


@query_of
def r5_merge_evidence(spark, d):
    """The evidence after the same merge."""
    return _supplier_chains(Star(spark, d, keep=True))[1].evidence.select("id", "relation_id", "chunk_id", "quote_hash")


@query_of
def r5_merge_report(spark, d):
    """The same merge: what was not followed, rows of the change log, and dangling edges and evidence, of which there are none."""
    s = Star(spark, d, keep=True)
    _, merged = _supplier_chains(s)
    edges = store(merged.relations, "merged-relations")
    counts = [
        merged.problems.groupBy(F.col("problem").alias("what")).agg(F.count("*").alias("rows")),
        merged.audit.select(F.lit("merged").alias("what")).groupBy("what").agg(F.count("*").alias("rows")),
        merged.entities.agg(F.count("*").alias("rows")).select(F.lit("entities").alias("what"), "rows"),
        quality.orphan_relations(edges, merged.entities).agg(F.count("*").alias("rows")).select(F.lit("orphan edges").alias("what"), "rows"),
        merged.evidence.select(T.packed("relation_id").alias("id")).join(edges.select(T.packed("id").alias("id")), "id", "left_anti").agg(F.count("*").alias("rows")).select(F.lit("orphan evidence").alias("what"), "rows"),
    ]
    return reduce(DataFrame.union, counts)


@query_of
def r6_bulk_delete_audit(spark, d):
    gone = Star(spark, d).table("customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"))
    rows = runlog.bulk_delete_audit(gone, "customer", "test", per_row=100)
    return rows.groupBy("table_name", "action", "reason").agg(F.sum(F.get_json_object("old_data", "$.count").cast("long")).alias("ids"))


@query_of
def r7_audit_history(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")
    log = runlog.diff_snapshots(c, c.filter("c_custkey % 7 <> 0"), ["c_custkey"], "customer").withColumns({"created_at": F.col("record_id").cast("long"), "id": F.col("record_id")})
    return runlog.audit_history(log, "customer", action="DELETE").select("record_id", "old_data")


# Streams


@query_of
def i1_stream_ingest(spark, d):
    """Documents arrive in two runs of a stream: a twentieth, then all, so that many ids come again; pmid is the id without
    its last digit."""
    path = shared_dir(spark, "ingest")
    docs = documents(spark, d).select(F.col("id").cast("string").alias("id"), F.floor(F.col("id") / 10).cast("string").alias("pmid"), "abstract")
    for part in (docs.filter("cast(id as long) % 20 = 0"), docs):
        part.write.mode("append").parquet(f"{path}/in")
        incremental.stream_ingest(spark, f"{path}/in", f"{path}/out", f"{path}/state", docs.schema).awaitTermination()
    return spark.read.schema(docs.schema).option("recursiveFileLookup", "true").parquet(f"{path}/out/documents").select("id", "pmid")


def _streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the graph after the answers came in two runs, half of the chunks each, and were compacted between."""
    s, path = Star(spark, d, keep=True), shared_dir(spark, "graph")
    answers, chunks = s.outputs, s.chunks
    for half in (0, 1):
        answers.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == half).write.mode("append").option("compression", "zstd").parquet(f"{path}/in")
        incremental.stream_build_kg(spark, f"{path}/in", chunks, f"{path}/out", f"{path}/state").awaitTermination()
        if not half:
            incremental.compact(spark, f"{path}/out")
    return incremental.graph_table(spark, f"{path}/out", name)


@query_of
def i2_stream_relations(spark, d):
    return _streamed(spark, d, "relations").select("id", "head_id", "tail_id", "label", "confidence")


@query_of
def i2_stream_evidence(spark, d):
    """Which chunk a quote is first seen in hangs on arrival; which quotes there are does not."""
    return _streamed(spark, d, "evidence").select("id", "relation_id", "quote")


@query_of
def i2_stream_entities(spark, d):
    return _streamed(spark, d, "entities").select("id", "normalized_name", "type")
