"""Searches and listings over the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..vocabulary import ENTITY_TYPES
from .term_index import find


def page_meta(total: int, page: int = 1, size: int = 20) -> dict[str, int]:
    """offset and pages of a listing; a size of 0 has no pages."""
    return {"total": total, "page": page, "page_size": size, "offset": (page - 1) * size, "pages": -(-total // size) if size else 0}


def paginate(df: DataFrame, order: Sequence[str | Column], page: int = 1, size: int = 20, tie: Sequence[str] = ("id",)) -> DataFrame:
    """One page in total order: the tie key is always appended, so that pages neither overlap nor miss rows."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1, size is 1 to 100")
    return df.orderBy(*order, *tie).offset((page - 1) * size).limit(size)


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, salts: int = 64) -> DataFrame:
    """The first n rows of each key, without gathering the rows of a key: each of `salts` shares of it is cut to n
    first, so that a key with a third of all rows is still sorted by many tasks."""
    for by in ([*keys, "_salt"], list(keys)):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        df = (df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts))) if "_salt" in by else df).withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    return df.drop("_salt")


def degree(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """entities with out_degree, in_degree and degree; a loop counts at both ends. One pass over the edges."""
    ends = relations.select(F.explode(F.array(F.struct(F.col("head_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("tail_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    counts = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return entities.join(counts, "id", "left").fillna(0, ["out_degree", "in_degree"]).withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def search_entities(entities: DataFrame, relations: DataFrame, q: str | None = None, type: str | None = None, types: Sequence[str] = ENTITY_TYPES, index: str | None = None) -> DataFrame:
    """Entities whose normalized name, name or an alias holds q without case (% and _ are wildcards), of a type, with
    degrees, which only the edges at those entities are counted for. Order by name and page it with `paginate`; its
    count is the total. With `index`, where `build_term_index` wrote one, names are read of candidates only."""
    if type is not None:
        if type not in types:
            raise ValueError(f"{type!r} is not one of: {', '.join(types)}")
        entities = entities.filter(F.col("type") == type)
    if q:
        entities = find(entities, q, index)
    return degree(entities, relations) if q is None and type is None else degree_of(entities, relations)


def degree_of(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """As degree, for few entities: an end of an edge that is none of them is dropped before anything is counted."""
    ids = entities.select("id")
    ends = relations.select(F.col("head_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(relations.select("tail_id", F.lit(0), F.lit(1)))
    counts = ends.join(ids, "id", "left_semi").groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return entities.join(counts, "id", "left").fillna(0, ["out_degree", "in_degree"]).withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def entity_matches(entities: DataFrame, text: str) -> DataFrame:
    """Literal substring, without case, of normalized name, name or any alias."""
    t = F.lit(text.lower())
    return entities.filter(F.contains(F.lower("normalized_name"), t) | F.contains(F.lower("name"), t) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), t)))


def entity_type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type")


def get_entity(entities: DataFrame, id: str) -> DataFrame:
    return entities.filter(F.col("id") == id).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def entity_names(entities: DataFrame) -> DataFrame:
    return entities.withColumn("names", F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))


def _evidence_count(df: DataFrame, evidence: DataFrame) -> DataFrame:
    counts = evidence.groupBy(F.col("relation_id").alias("id")).agg(F.count("*").alias("evidence_count"))
    return df.join(counts, "id", "left").fillna(0, ["evidence_count"])


def neighborhood(entities: DataFrame, relations: DataFrame, evidence: DataFrame, id: str, limit: int = 50) -> DataFrame:
    """Up to limit // 2 outgoing and as many incoming edges of an entity, the surest first (nulls last, then id), with
    neighbor, direction and evidence_count. Each side is cut before anything is joined to it."""
    order = (F.desc_nulls_last("confidence"), "id")
    side = lambda own, other, name: relations.filter(F.col(own) == id).orderBy(*order).limit(limit // 2).select("id", "label", "confidence", F.col(other).alias("neighbor_id"), F.lit(name).alias("direction"))
    edges = side("head_id", "tail_id", "outgoing").unionByName(side("tail_id", "head_id", "incoming"))
    who = entities.select(F.col("id").alias("neighbor_id"), F.col("name").alias("neighbor"), F.col("type").alias("neighbor_type"))
    near = evidence.join(edges.select(F.col("id").alias("relation_id")), "relation_id", "left_semi")
    return _evidence_count(edges.join(who, "neighbor_id"), near)


def neighborhood_stats(relations: DataFrame, shown: DataFrame, id: str) -> DataFrame:
    """(kind, key, count): all edges that touch the entity, and the shown rows by label and by neighbor type."""
    total = relations.filter((F.col("head_id") == id) | (F.col("tail_id") == id)).agg(F.count("*").alias("count")).select(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("key"), "count")
    by = lambda kind, c: shown.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("count")).select(F.lit(kind).alias("kind"), "key", "count")
    return total.union(by("label", "label")).union(by("neighbor_type", "neighbor_type"))


def entity_relations(relations: DataFrame, evidence: DataFrame, id: str, direction: str = "both", page: int = 1, size: int = 20) -> DataFrame:
    """A page of an entity's edges, confidence descending with nulls first, with their evidence."""
    out, back = F.col("head_id") == id, F.col("tail_id") == id
    rows = paginate(relations.filter({"outgoing": out, "incoming": back}.get(direction, out | back)), [F.desc_nulls_first("confidence")], page, size)
    near = evidence.join(rows.select(F.col("id").alias("relation_id")), "relation_id", "left_semi")
    quotes = near.groupBy(F.col("relation_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("evidence_id"), "chunk_id", "quote"))).alias("evidence"))
    return rows.join(quotes, "id", "left").orderBy(F.desc_nulls_first("confidence"), "id")


def list_documents(docs: DataFrame, chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """docs with chunk_count and has_extractions; newest first when paged by created_at descending."""
    used = evidence.select(F.col("chunk_id").alias("cid")).distinct()
    per = chunks.join(used, F.col("id") == F.col("cid"), "left").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunk_count"), (F.count("cid") > 0).alias("has_extractions"))
    return docs.join(per, "id", "left").withColumns({"chunk_count": F.coalesce("chunk_count", F.lit(0)), "has_extractions": F.coalesce("has_extractions", F.lit(False))})


def get_document(docs: DataFrame, chunks: DataFrame, evidence: DataFrame, id) -> DataFrame:
    return list_documents(docs.filter(F.col("id") == id), chunks.filter(F.col("document_id") == id), evidence)


def delete_documents(docs: DataFrame, chunks: DataFrame, evidence: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents (id), their chunks and the evidence in those; relations stay."""
    gone = chunks.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return docs.join(ids, "id", "left_anti"), chunks.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_anti"), evidence.join(gone, "chunk_id", "left_anti")


def deletion_audit(table: str, gone: DataFrame, reason: str | None = None) -> DataFrame:
    """Audit rows (table_name, record_id, action, old_data, reason) of deleted rows, each with what it held as JSON."""
    return gone.select(F.lit(table).alias("table_name"), F.col("id").cast("string").alias("record_id"), F.lit("DELETE").alias("action"), F.to_json(F.struct("*")).alias("old_data"), F.lit(reason).cast("string").alias("reason"))


def documents_audit(docs: DataFrame, chunks: DataFrame, evidence: DataFrame, ids: DataFrame, reason: str | None = None) -> DataFrame:
    """What `delete_documents` takes away, as audit rows of all three tables."""
    cut = chunks.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    lost = evidence.join(cut.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    rows = [deletion_audit(n, df, reason) for n, df in (("documents", docs.join(ids, "id", "left_semi")), ("chunks", cut), ("evidence", lost))]
    return rows[0].union(rows[1]).union(rows[2])


def delete_entities(entities: DataFrame, relations: DataFrame, evidence: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the entities (id), the edges at either end of them, and those edges' evidence."""
    kept = relations
    for end in ("head_id", "tail_id"):
        kept = kept.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    kept = kept.select(relations.columns)
    gone = relations.join(ids.select(F.col("id").alias("head_id")), "head_id", "left_semi").select("id").union(relations.join(ids.select(F.col("id").alias("tail_id")), "tail_id", "left_semi").select("id"))
    return entities.join(ids, "id", "left_anti"), kept, evidence.join(gone.select(F.col("id").alias("relation_id")), "relation_id", "left_anti").select(evidence.columns)
