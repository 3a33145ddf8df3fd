"""Tables of raw model answers into mentions and triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..vocabulary import ENTITY_TYPES, RELATION_LABELS

_ENTITIES = "struct<entities:array<struct<name:string,type:string,normalized_name:string>>>"
_RELATIONS = "struct<relations:array<struct<head:string,tail:string,label:string,confidence:string,evidence:string>>>"


def parsed(outputs: DataFrame, kind: str) -> DataFrame:
    """The answers of one pass with `json`, null if they cannot be mended. try_parse_json decides: from_json takes broken
    text too. Each step is computed once (`let`), filters on json included."""
    closed = lambda x: T.let(T.close_json(x), lambda y: F.when(T.is_json(y), y))
    json = T.let(T.mend_json(T.extract_json(F.col("content"))), lambda x: F.when(T.is_json(x), x).otherwise(closed(x)))
    return outputs.filter(F.col("pass") == kind).withColumn("json", json)


def parse_entities(outputs: DataFrame, types: Sequence[str] = ENTITY_TYPES, most: int = 20) -> DataFrame:
    """mentions: per chunk the first `most` entities of a known type, types in the vocabulary's spelling."""
    items = parsed(outputs, "entities").select("chunk_id", F.posexplode_outer(F.from_json("json", _ENTITIES)["entities"]).alias("position", "e")).filter("position is not null")
    items = items.select("chunk_id", "position", F.coalesce("e.name", F.lit("")).alias("name"), T.match_entity_type(F.col("e.type"), types).alias("type"), F.lower(F.coalesce("e.normalized_name", F.lit(""))).alias("normalized_name")).filter("type is not null")
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy("position"))
    return items.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def _relations(outputs: DataFrame) -> DataFrame:
    """Relation answers with their relations r, null if the answer is no JSON or a confidence (of a known label) no number."""
    bad = lambda x: x["confidence"].isNotNull() & x["confidence"].try_cast("double").isNull() & T.match_relation_label(x["label"]).isNotNull()
    both = T.let(F.from_json("json", _RELATIONS)["relations"], lambda r: T.let(~F.coalesce(F.exists(r, bad), F.lit(False)), lambda ok: F.struct(ok.alias("numeric"), F.when(ok, r).alias("r"))))
    return parsed(outputs, "relations").withColumn("_both", both).withColumns({"numeric": F.col("_both.numeric"), "r": F.col("_both.r")}).drop("_both")


def parse_relations(outputs: DataFrame, mentions: DataFrame, labels: Sequence[str] = RELATION_LABELS, threshold: float = 0.5, most: int = 30) -> DataFrame:
    """triples of chunks with at least two mentions: known labels, confidence (0.5 if missing) of the threshold or more,
    the `most` surest of a chunk, earlier ones first among equals. An answer with a confidence that is no number fails."""
    enough = mentions.groupBy("chunk_id").count().filter("count >= 2").select("chunk_id")
    items = _relations(outputs).join(enough, "chunk_id", "left_semi").select("chunk_id", F.posexplode_outer("r").alias("position", "r")).filter("position is not null")
    text = [F.coalesce(f"r.{c}", F.lit("")).alias(c) for c in ("head", "tail", "evidence")]
    items = items.select("chunk_id", "position", *text, T.match_relation_label(F.col("r.label"), labels).alias("label"), F.coalesce(F.col("r.confidence").try_cast("double"), F.lit(0.5)).alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("confidence"), "position"))
    return items.filter((F.col("confidence") >= threshold) & F.col("label").isNotNull()).withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def extraction_errors(outputs: DataFrame) -> DataFrame:
    """Answers that cannot be used: (run_id, chunk_id, pass, error, raw), raw cut at 2,000 characters."""
    entity = parsed(outputs, "entities").filter("json is null").withColumn("error", F.lit("not JSON"))
    relation = _relations(outputs).filter("json is null or not numeric").withColumn("error", F.when(F.col("json").isNotNull(), "confidence is no number").otherwise("not JSON"))
    columns = ["run_id", "chunk_id", "pass", "error", F.substring("content", 1, 2000).alias("raw")]
    return entity.select(*columns).union(relation.select(*columns))


def parse_chunks(outputs: DataFrame, chunks: DataFrame | None = None, types: Sequence[str] = ENTITY_TYPES, labels: Sequence[str] = RELATION_LABELS, threshold: float = 0.5, most_entities: int = 20, most_relations: int = 30, drop_on_error: bool = False) -> DataFrame:
    """(chunk_id, mentions, triples), a row a chunk: what `parse_entities` and `parse_relations` say of it, as arrays, mentions
    by position, triples surest first. Answers are parsed where they lie and the two of a chunk meet in one exchange; what
    hangs on one chunk is done within its row. A triple has the entities that its ends name, as h and t, null where an end is no
    mention, and with chunks the place of its quote in the text. With drop_on_error a chunk whose relation answer
    fails has none of either."""
    # Words of the vocabulary cross the exchange as numbers, a normalized name only where it is not the usual one.
    place = lambda word, words: F.nullif(F.array_position(F.array(*map(F.lit, words)), word), F.lit(0)).cast("int")
    word = lambda n, words: F.array(*map(F.lit, words))[n - 1]
    usual = lambda name: F.lower(F.translate(name, " -", "__"))
    normal = lambda e: F.lower(F.coalesce(e["normalized_name"], F.lit("")))
    item = lambda e, i: F.struct(i.alias("position"), F.coalesce(e["name"], F.lit("")).alias("name"), place(T.match_entity_type(e["type"], types), types).alias("type"), F.when(normal(e) != usual(F.coalesce(e["name"], F.lit(""))), normal(e)).alias("normalized_name"))
    mentions = F.filter(F.transform(F.from_json("json", _ENTITIES)["entities"], item), lambda m: m["type"].isNotNull())
    whole = lambda m: F.struct(m["position"].alias("position"), m["name"].alias("name"), word(m["type"], types).alias("type"), F.coalesce(m["normalized_name"], usual(m["name"])).alias("normalized_name"))
    text = lambda r, c: F.coalesce(r[c], F.lit("")).alias(c)
    # In the order of their rank, the last first.
    triple = lambda r, i: F.struct(F.coalesce(r["confidence"].try_cast("double"), F.lit(0.5)).alias("confidence"), (-i).alias("before"), *(text(r, c) for c in ("head", "tail", "evidence")), place(T.match_relation_label(r["label"], labels), labels).alias("label"))
    triples = F.filter(F.transform("r", triple), lambda x: (x["confidence"] >= threshold) & x["label"].isNotNull())
    none = F.lit(None)
    failed = F.col("json").isNull() | ~F.coalesce("numeric", F.lit(True))
    rows = parsed(outputs, "entities").select("chunk_id", mentions.alias("mentions"))
    relations = _relations(outputs).select("chunk_id", triples.alias("triples"), failed.alias("failed"))
    rows = rows.unionByName(relations, allowMissingColumns=True)
    if chunks is not None:
        rows = rows.unionByName(chunks.select(F.col("id").alias("chunk_id"), F.col("text").alias("_text")), allowMissingColumns=True)
    more = [F.first("_text", ignorenulls=True).alias("_text")] if chunks is not None else []
    if drop_on_error:
        more.append(F.coalesce(F.bool_or("failed"), F.lit(False)).alias("failed"))
    rows = rows.groupBy("chunk_id").agg(F.flatten(F.collect_list("mentions")).alias("mentions"), F.flatten(F.collect_list("triples")).alias("triples"), *more)
    if drop_on_error:
        rows = rows.filter(F.col("chunk_id").isNull() | ~F.col("failed"))
    rows = rows.withColumns({"mentions": F.transform(F.slice(F.array_sort("mentions"), 1, most_entities), whole), "triples": F.slice(F.sort_array("triples", asc=False), 1, most_relations)})
    named = lambda name: F.transform(F.slice(F.filter("mentions", lambda m: m["name"] == name), -1, 1), lambda m: F.struct(m["normalized_name"].alias("normalized_name"), m["type"].alias("type")))
    at = lambda t: T.locate_quote(t["evidence"], F.col("_text")) if chunks is not None else F.struct(none.cast("int").alias("start"), none.cast("int").alias("end"))
    end = lambda name: F.try_element_at(named(name), F.lit(1))
    resolved = F.transform("triples", lambda t: F.struct((-t["before"]).alias("position"), *(t[c].alias(c) for c in ("head", "tail", "evidence")), word(t["label"], labels).alias("label"), t["confidence"].alias("confidence"), end(t["head"]).alias("h"), end(t["tail"]).alias("t"), at(t).alias("at")))
    enough = F.col("chunk_id").isNotNull() & (F.size("mentions") >= 2)
    rows = rows.select("chunk_id", "mentions", F.when(enough, resolved).otherwise(F.slice(resolved, 1, 0)).alias("triples"))
    return rows.filter((F.size("mentions") > 0) | (F.size("triples") > 0))


def validate_vocabulary(df: DataFrame, column: str, allowed: Sequence[str], strict: bool = False) -> DataFrame:
    """Values outside the vocabulary, with their rows' count and the allowed list; strict raises if there are any."""
    bad = df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows")).withColumn("allowed", F.lit(", ".join(allowed)))
    if strict and (first := bad.first()):
        raise ValueError(f"{column} {first['value']!r} is not one of: {first['allowed']}")
    return bad


def extraction_summary(outputs: DataFrame, mentions: DataFrame, triples: DataFrame) -> DataFrame:
    """Per run: chunks, entities, relations, errors."""
    chunks = outputs.select("run_id", "chunk_id").distinct()
    counts = [chunks.groupBy("run_id").agg(F.count("*").alias("chunks")), chunks.join(mentions, "chunk_id").groupBy("run_id").agg(F.count("*").alias("entities")), chunks.join(triples, "chunk_id").groupBy("run_id").agg(F.count("*").alias("relations")), extraction_errors(outputs).groupBy("run_id").agg(F.count("*").alias("errors"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(c, "run_id", "left")
    return out.fillna(0)
