"""Graph tables from mentions and triples. Every id is a hash of its key, so that building twice builds once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import store


def key_id(*columns: str | Column) -> Column:
    return F.sha2(F.concat_ws("\x01", *columns), 256)


def build_entities(mentions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One entity a (normalized_name, type): the name seen first, and as aliases the other spellings, unlike without
    case among each other and unlike the normalized name. Order is (chunk_id, position), existing entities first.
    Mentions are reduced to distinct spellings before names are gathered, so a name in a third of all chunks is one row a task."""
    seen = mentions.select("normalized_name", "type", "name", F.struct(F.lit(1).alias("new"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("position").cast("int").alias("position")).alias("at"))
    if existing is not None:
        known = existing.select("normalized_name", "type", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array()))).alias("position", "name"))
        seen = seen.union(known.select("normalized_name", "type", "name", F.struct(F.lit(0).alias("new"), F.lit("").alias("chunk_id"), F.col("position").alias("position")).alias("at")))
    names = seen.groupBy("normalized_name", "type", F.lower("name").alias("low")).agg(F.min_by("name", "at").alias("name"), F.min("at").alias("at"))
    groups = names.groupBy("normalized_name", "type").agg(F.array_sort(F.collect_list(F.struct("at", "low", "name"))).alias("names"))
    display = F.col("names")[0]
    others = F.filter("names", lambda x: (x["low"] != display["low"]) & (x["low"] != F.lower("normalized_name")))
    return groups.select(key_id("normalized_name", "type").alias("id"), display["name"].alias("name"), "normalized_name", "type", F.transform(others, lambda x: x["name"]).alias("aliases"))


def resolve_mentions(triples: DataFrame, mentions: DataFrame) -> DataFrame:
    """triples with head_id and tail_id, by exact name within the chunk; of equal names the last mention counts. Null ids
    where a name is no mention: `unresolved` selects those."""
    last = mentions.groupBy("chunk_id", "name").agg(F.max_by(F.struct("normalized_name", "type"), "position").alias("e"))
    last = last.select("chunk_id", "name", key_id("e.normalized_name", "e.type").alias("entity_id"))
    head = last.select("chunk_id", F.col("name").alias("head"), F.col("entity_id").alias("head_id"))
    tail = last.select("chunk_id", F.col("name").alias("tail"), F.col("entity_id").alias("tail_id"))
    return triples.join(head, ["chunk_id", "head"], "left").join(tail, ["chunk_id", "tail"], "left")


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.filter("head_id is null or tail_id is null")


def quarantine_relations(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): confidence is null or between 0 and 1."""
    ok = F.col("confidence").isNull() | F.col("confidence").between(0.0, 1.0)
    return triples.filter(ok), triples.filter(~ok)


def end_id(rows: DataFrame, end: str) -> Column:
    """The id of an end of rows: itself, or of an entity (normalized_name, type) its hash; null if there is none."""
    if rows.schema[end].dataType.typeName() != "struct":
        return F.col(end)
    return F.when(F.col(end).isNotNull(), key_id(f"{end}.normalized_name", f"{end}.type"))


def build_relations(resolved: DataFrame, existing: DataFrame | None = None, ends: tuple[str, str] = ("head_id", "tail_id")) -> DataFrame:
    """One edge a (head_id, tail_id, label) with its highest confidence; with existing edges, the upsert of both. Ends are ids
    or entities (normalized_name, type), which are shorter to exchange than the ids that are their hashes."""
    edges = resolved.filter(F.col(ends[0]).isNotNull() & F.col(ends[1]).isNotNull())
    if ends != ("head_id", "tail_id"):
        edges = group_edges(edges, *ends)
        edges = edges.withColumns({"head_id": end_id(edges, ends[0]), "tail_id": end_id(edges, ends[1])})
        if existing is None:
            return edges.select(key_id("head_id", "tail_id", "label").alias("id"), "head_id", "tail_id", "label", "confidence")
    edges = edges.select("head_id", "tail_id", "label", "confidence")
    if existing is not None:
        edges = edges.union(existing.select("head_id", "tail_id", "label", "confidence"))
    return group_edges(edges, "head_id", "tail_id").select(key_id("head_id", "tail_id", "label").alias("id"), "*")


def group_edges(edges: DataFrame, *ends: str) -> DataFrame:
    """One row a (ends, label) with the highest confidence. Ends are ids, or shorter what ids are hashes of."""
    return edges.groupBy(*ends, "label").agg(F.max("confidence").alias("confidence"))


def locate_quotes(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """evidence with quote_start and quote_end in its chunk's text, null where the quote is not found."""
    digests = [c for c, kind in evidence.dtypes if kind == "string" and c in ("id", "relation_id", "quote_hash")]
    found = evidence.drop("quote_start", "quote_end").withColumns({c: T.packed(c) for c in digests}).join(chunks.select(F.col("id").alias("chunk_id"), F.col("text").alias("_text")), "chunk_id", "left")
    at = T.locate_quote(F.col("quote"), F.col("_text"))
    return found.withColumns({"quote_start": at["start"], "quote_end": at["end"], **{c: T.unpacked(c) for c in digests}}).drop("_text")


def build_evidence(resolved: DataFrame, chunks: DataFrame | None = None, existing: DataFrame | None = None, keep_empty: bool = True, ends: tuple[str, str] = ("head_id", "tail_id")) -> DataFrame:
    """One row a (relation, hash of the stripped quote), the first by (chunk_id, position), minus what exists already. Ends are
    as in `build_relations`. Rows are grouped by what ids and hashes follow from, the quote itself goes along where white space was
    stripped of it, and digests are made last."""
    rows = resolved.filter(F.col(ends[0]).isNotNull() & F.col(ends[1]).isNotNull()).withColumn("_quote", F.coalesce("evidence", F.lit("")))
    if ends == ("head_id", "tail_id"):
        key = {"_relation": T.packed(key_id("head_id", "tail_id", "label"))}
    else:
        key = {"_relation": F.struct(F.col(ends[0]).alias("h"), F.col(ends[1]).alias("t"), F.col("label").alias("label"))}
    rows = rows.withColumn("_bare", T.strip(F.col("_quote")))
    if not keep_empty:
        rows = rows.filter("_bare <> ''")
    placed = "at" in rows.columns
    first = F.min(F.struct("chunk_id", "position", F.when(F.col("_quote") != F.col("_bare"), F.col("_quote")).alias("quote"), *(["at"] if placed else [])))
    places = [F.col("e.at.start").alias("quote_start"), F.col("e.at.end").alias("quote_end")] if placed else []
    rows = rows.withColumns(key).groupBy("_relation", "_bare").agg(first.alias("e")).select("_relation", "e.chunk_id", F.coalesce("e.quote", "_bare").alias("quote"), *places)
    if chunks is not None and not placed:
        rows = locate_quotes(rows, chunks)
    if ends == ("head_id", "tail_id"):
        relation = T.unpacked("_relation")
    else:
        relation = key_id(key_id("_relation.h.normalized_name", "_relation.h.type"), key_id("_relation.t.normalized_name", "_relation.t.type"), "_relation.label")
    rows = evidence_ids(rows.withColumn("relation_id", relation))
    if existing is not None:
        rows = rows.join(existing.select("relation_id", "quote_hash"), ["relation_id", "quote_hash"], "left_anti").select(rows.columns)
    return rows


def evidence_ids(rows: DataFrame) -> DataFrame:
    """(id, relation_id, chunk_id, quote, quote_hash) of (relation_id, chunk_id, quote), with the quote's place if rows have it."""
    rows = rows if "quote_hash" in rows.columns else rows.withColumn("quote_hash", T.quote_hash(F.col("quote")))
    places = [c for c in ("quote_start", "quote_end") if c in rows.columns]
    return rows.select(key_id("relation_id", "quote_hash").alias("id"), "relation_id", "chunk_id", "quote", "quote_hash", *places)


def number_order(number: str, position: str | Column) -> Column:
    """A number that orders rows by (number as text, position), for whole numbers from 0 up and positions of
    up to ten digits. The least string of a group needs its rows sorted, the least number is kept in a hash table."""
    text = F.col(number).cast("string")
    return F.concat(F.rpad(text, 19, "0"), F.lpad(F.char_length(text).cast("string"), 2, "0"), F.lpad((F.col(position) if isinstance(position, str) else position).cast("string"), 10, "0")).cast("decimal(31,0)")


def ordered_numbers(order: str, number: str, position: str) -> dict[str, Column]:
    """The number and position that `number_order` was made of."""
    text = F.lpad(F.col(order).cast("string"), 31, "0")
    return {number: F.substr(text, F.lit(1), F.substring(text, 20, 2).cast("int")).cast("long"), position: F.substring(text, 22, 10).cast("int")}


def pending_chunks(chunks: DataFrame, evidence: DataFrame, limit: int | None = None, document_ids: list | None = None) -> DataFrame:
    """Chunks without evidence."""
    todo = chunks.join(evidence.select(F.col("chunk_id").alias("id")), "id", "left_anti").select(chunks.columns)
    if document_ids is not None:
        todo = todo.filter(F.col("document_id").isin(document_ids))
    return todo.orderBy("id").limit(limit) if limit is not None else todo


def _large(rows: DataFrame, key: str, per_row: int) -> DataFrame:
    """(key, _n): keys of more than per_row rows. Hashes are counted first, keys only where a hash has so many rows. They are
    stored, so that Spark knows how few they are."""
    near = store(rows.groupBy(F.xxhash64(key).alias("_hash")).agg(F.count("*").alias("_n")).filter(F.col("_n") > per_row).select("_hash"), "large")
    some = rows.join(near, F.xxhash64(key) == F.col("_hash"), "left_semi")
    return store(some.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > per_row), "large")


def pages(rows: DataFrame, key: str, value: str, spread: str, per_row: int, name: str = "items") -> DataFrame:
    """(key, page, items): the values of each key as sorted arrays, page 0 alone if there are up to per_row, else as many
    pages as keep a page at about that, by a hash of `spread`. So no row and no task gathers all values of a key. Only keys of
    more than one page, at most one in per_row rows, are joined back."""
    large = _large(rows, key, per_row)
    page = F.coalesce(F.pmod(F.xxhash64(spread), F.ceil(F.col("_n") / per_row)), F.lit(0)).cast("int")
    return rows.join(large, key, "left").groupBy(key, page.alias("page")).agg(F.array_sort(F.collect_list(value)).alias(name))


def relation_evidence(relations: DataFrame, evidence: DataFrame, per_row: int = 10_000) -> DataFrame:
    """relations with their evidence as an array ordered by id, and evidence_count, the number of all. A relation with more
    than per_row has several rows, numbered by page, each with a part of it of about that size."""
    own = T.spared("id", key_id("relation_id", T.quote_hash(F.col("quote"))))
    rows = evidence.select(T.packed("relation_id").alias("_id"), F.struct(own.alias("own"), "chunk_id", "quote").alias("e"))
    large = _large(rows, "_id", per_row)
    # The id goes packed alone.
    columns, relations = relations.columns, relations.withColumn("_id", T.packed("id")).drop("id")
    items = lambda df, *keys: df.groupBy("_id", *keys).agg(F.collect_list("e").alias("evidence"))
    usual = relations.join(large, "_id", "left_anti").join(items(rows.join(large, "_id", "left_anti")), "_id", "left")
    usual = usual.select(*relations.columns, F.lit(0).alias("page"), F.coalesce("evidence", F.array()).alias("evidence"), F.coalesce(F.size("evidence"), F.lit(0)).cast("long").alias("evidence_count"))
    evidence_id = lambda e: T.restored(e["own"], key_id(T.unpacked("_id"), T.quote_hash(e["quote"])))
    page = F.pmod(F.xxhash64(evidence_id(F.col("e"))), F.ceil(F.col("_n") / per_row)).cast("int")
    paged = items(rows.join(large, "_id").withColumn("page", page), "page").join(large, "_id")
    paged = relations.join(paged, "_id").select(*relations.columns, "page", "evidence", F.col("_n").alias("evidence_count"))
    ordered = F.array_sort(F.transform("evidence", lambda e: F.struct(evidence_id(e).alias("evidence_id"), e["chunk_id"].alias("chunk_id"), e["quote"].alias("quote"))))
    out = usual.union(paged).withColumns({"evidence": ordered, "id": T.unpacked("_id")})
    return out.select(*columns, "page", "evidence", "evidence_count")


def triple_view(relations: DataFrame, entities: DataFrame, evidence: DataFrame, sure: float = 0.7) -> DataFrame:
    """relations with head, tail, triple as text, evidence_count, has_evidence, is_high_confidence and is_directional."""
    digests = ("id", "head_id", "tail_id")
    usual = key_id("head_id", "tail_id", "label")
    rows = relations.withColumns({**{c: T.packed(c) for c in digests}, "_own": T.spared("id", usual)})
    counts = evidence.groupBy(T.packed("relation_id").alias("id")).agg(F.count("*").alias("evidence_count"))
    rows = rows.join(counts, "id", "left")
    rows = rows.drop("id")
    for end in ("head", "tail"):
        rows = rows.join(entities.select(T.packed("id").alias(f"{end}_id"), F.col("name").alias(end)), f"{end}_id", "left")
    out = rows.withColumns({c: T.unpacked(c) for c in digests[1:]}).withColumn("id", T.restored("_own", usual))
    out = out.select(*relations.columns, "head", "tail", "evidence_count")
    n = F.coalesce("evidence_count", F.lit(0))
    return out.withColumns({"evidence_count": n, "has_evidence": n > 0, "is_high_confidence": F.coalesce(F.col("confidence") >= sure, F.lit(False)), "is_directional": T.is_directional(F.col("label")), "triple": F.concat_ws(" ", "head", "label", "tail")})
