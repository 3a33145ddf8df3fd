"""Evaluation and integrity of a graph."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import store
from ..vocabulary import ENTITY_TYPES, RELATION_LABELS
from .query import degree_of
from .term_index import candidates


def _one_row(*parts: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    return reduce(lambda a, b: a.join(b, F.lit(True)), parts)


def summary_stats(docs: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: sizes, processed chunks and their share, evidence coverage, confidence (0 without edges)."""
    with_evidence = evidence.select(F.col("relation_id").alias("id")).distinct().withColumn("has", F.lit(1))
    relations = relations.join(with_evidence, "id", "left")  # one pass over the edges gives all their numbers
    conf = lambda f: F.round(F.coalesce(f("confidence"), F.lit(0.0)), 3)
    row = _one_row(
        docs.agg(F.count("*").alias("documents")), chunks.agg(F.count("*").alias("chunks")), entities.agg(F.count("*").alias("entities")), evidence.agg(F.count("*").alias("evidence"), F.count_distinct("chunk_id").alias("chunks_processed")),
        relations.agg(F.count("has").alias("covered"), F.count("*").alias("relations"), conf(F.avg).alias("avg_confidence"), conf(F.min).alias("min_confidence"), conf(F.max).alias("max_confidence")),
    )
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) * 100.0 / F.col(b)).otherwise(0.0), 2)
    return row.withColumns({"processed_pct": share("chunks_processed", "chunks"), "evidence_coverage_pct": share("covered", "relations")})


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how many rows are too many."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("extra")).filter("extra > 0")


def duplicates(entities: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(kind, duplicates): rows beyond the first of a key."""
    each = (("entities", entities, ["normalized_name", "type"]), ("relations", relations, ["head_id", "tail_id", "label"]), ("evidence", evidence, ["relation_id", "quote_hash"]))
    return reduce(DataFrame.union, (unique_violations(df, keys).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicates")).select(F.lit(kind).alias("kind"), "duplicates") for kind, df, keys in each))


def _missing(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Ends of edges that are no entity, mostly few, stored, so that Spark knows their size when it joins the edges with them.
    The ends that occur are looked up, not each edge."""
    ends = relations.select(F.explode(F.array("head_id", "tail_id")).alias("id")).filter("id is not null").select(T.packed("id").alias("id")).distinct()
    return store(ends.join(entities.select(T.packed("id").alias("id")), "id", "left_anti").select(T.unpacked("id").alias("id")), "missing")


def sound_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of which both ends are entities."""
    missing = _missing(relations, entities)
    for end in ("head_id", "tail_id"):
        relations = relations.filter(F.col(end).isNotNull()).join(missing.toDF(end), end, "left_anti").select(relations.columns)
    return relations


def orphan_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of which an end is null or no entity."""
    missing = _missing(relations, entities).withColumn("gone", F.lit(True))
    rows = relations.join(missing.toDF("head_id", "no_head"), "head_id", "left").join(missing.toDF("tail_id", "no_tail"), "tail_id", "left")
    return rows.filter("head_id is null or tail_id is null or no_head or no_tail").select(relations.columns)


def relations_without_evidence(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    rows = relations.withColumn("id", T.packed("id")).join(evidence.select(T.packed("relation_id").alias("id")), "id", "left_anti")
    return rows.withColumn("id", T.unpacked("id")).select(relations.columns)


def entities_without_relations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Both ends as one anti join; an OR would compare every pair."""
    return entities.join(relations.select(F.explode(F.array("head_id", "tail_id")).alias("id")), "id", "left_anti")


def ratios(entities: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    row = _one_row(*(df.agg(F.count("*").alias(n)) for df, n in ((entities, "e"), (relations, "r"), (evidence, "v"))))
    per = lambda a, b: F.round(F.when(F.col(b) > 0, a / F.col(b)).otherwise(0.0), 2)
    return row.select(per(F.col("r") * 2, "e").alias("relations_per_entity"), per(F.col("v"), "r").alias("evidence_per_relation"))


def invalid_values(entities: DataFrame, relations: DataFrame, types: Sequence[str] = ENTITY_TYPES, labels: Sequence[str] = RELATION_LABELS) -> DataFrame:
    bad = lambda df, c, ok: df.filter(~F.col(c).isin(*ok)).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("count")).select(F.lit(c).alias("kind"), "value", "count")
    return bad(entities, "type", types).union(bad(relations, "label", labels))


def matching(entities: DataFrame, term: str, index: str | None = None) -> DataFrame:
    """Entities whose normalized name holds the term, of the candidates of an index if there is one."""
    few = candidates(entities.sparkSession, index, term) if index else None
    return (entities if few is None else entities.join(few, "id", "left_semi")).filter(F.col("normalized_name").ilike(f"%{term}%"))


def _found(entities: DataFrame, term: str, index: str | None = None) -> DataFrame:
    """The ids of `matching`, stored: they are mostly few, and Spark knows then how few when it joins the edges with them."""
    return store(matching(entities, term, index).select("id"), "matching")


def term_has_edges(entities: DataFrame, relations: DataFrame, term: str, direction: str = "out", index: str | None = None) -> DataFrame:
    """(entities, edges, passed): entities that hold the term, and their outgoing (or incoming) edges."""
    own = _found(entities, term, index)
    end = "head_id" if direction == "out" else "tail_id"
    edges = relations.join(own.select(F.col("id").alias(end)), end, "left_semi").agg(F.count("*").alias("edges"))
    return _one_row(own.agg(F.count("*").alias("entities")), edges).withColumn("passed", F.col("edges") > 0)


def term_coverage(entities: DataFrame, terms: Sequence[str], least: int) -> DataFrame:
    """How many terms any entity holds, in one pass over the entities."""
    hits = entities.agg(*(F.coalesce(F.max(F.col("normalized_name").ilike(f"%{t}%").cast("int")), F.lit(0)).alias(f"t{i}") for i, t in enumerate(terms)))
    found = reduce(lambda a, b: a + b, (F.col(f"t{i}") for i in range(len(terms))), F.lit(0))
    return hits.select(F.lit(len(terms)).alias("terms"), found.alias("found"), (found >= least).alias("passed"))


def diversity(df: DataFrame, column: str, least: int) -> DataFrame:
    n = F.count_distinct(column)
    return df.agg(n.alias("kinds"), (n >= least).alias("passed"))


def evidence_validity(evidence: DataFrame, chunks: DataFrame, sample: float | None = None) -> DataFrame:
    """Quotes that are exact parts of their chunk; passes if none is not, or most are."""
    rows = (evidence.sample(sample, seed=1) if sample else evidence).join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id")
    ok = F.contains("text", "quote")
    return rows.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid")).withColumn("passed", (F.col("invalid") == 0) | (F.col("valid") > F.col("invalid")))


def common_neighbors(entities: DataFrame, relations: DataFrame, a: str, b: str, index: str | None = None) -> DataFrame:
    """(direct, common, passed) for the entities that hold term a and those that hold b: a->b edges, and entities between
    a's edges and edges into b."""
    head, tail = _found(entities, a, index).toDF("head_id"), _found(entities, b, index).toDF("tail_id")
    out, into = relations.join(head, "head_id", "left_semi"), relations.join(tail, "tail_id", "left_semi")
    direct = out.join(tail, "tail_id", "left_semi").agg(F.count("*").alias("direct"))
    common = out.select(F.col("tail_id").alias("id")).distinct().join(into.select(F.col("head_id").alias("id")), "id", "left_semi").agg(F.count("*").alias("common"))
    return _one_row(direct, common).withColumn("passed", (F.col("direct") > 0) | (F.col("common") > 0))


def terms_connected(entities: DataFrame, relations: DataFrame, pairs: Sequence[tuple[str, str]], index: str | None = None) -> DataFrame:
    """(a, b, direct, common, passed) for pairs of terms: whether an edge or a shared neighbor connects them."""
    return reduce(DataFrame.union, (common_neighbors(entities, relations, a, b, index).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "direct", "common", "passed") for a, b in pairs))


def example_queries(entities: DataFrame, relations: DataFrame, evidence: DataFrame, term: str, n: int = 5) -> DataFrame:
    """(query, name, value): what a few searches give, n rows each: entities that hold the term by name, the largest
    entity types, and the surest neighbors of the first such entity that has any."""
    found = store(degree_of(store(matching(entities, term), "matching"), relations), "degrees")
    search = found.orderBy("name", "id").limit(n).select(F.lit("search").alias("query"), "name", F.col("degree").cast("double").alias("value"))
    types = counts_by(entities, "type").limit(n).select(F.lit("types").alias("query"), F.col("type").alias("name"), F.col("count").cast("double").alias("value"))
    first = found.filter("degree > 0").orderBy("name", "id").limit(1).select("id")
    ends = relations.select(F.col("head_id").alias("id"), F.col("tail_id").alias("other"), "confidence", F.col("id").alias("edge")).union(relations.select("tail_id", "head_id", "confidence", "id"))
    near = ends.join(F.broadcast(first), "id", "left_semi").join(entities.select(F.col("id").alias("other"), "name"), "other")  # one row is broadcast
    near = near.orderBy(F.desc_nulls_last("confidence"), "edge", "other").limit(n).select(F.lit("neighbors").alias("query"), "name", F.col("confidence").alias("value"))
    return search.union(types).union(near)


def overall_score(checks: DataFrame, issues: int | Column) -> DataFrame:
    """checks (passed) and a number of issues: PASS, WARN or FAIL."""
    n = F.lit(issues) if isinstance(issues, int) else issues
    row = checks.agg(F.count_if("passed").alias("passed"), F.count("*").alias("checks"))
    share = F.when(F.col("checks") > 0, F.col("passed") / F.col("checks")).otherwise(0.0)
    return row.withColumn("score", F.when((n == 0) & (share >= 0.8), "PASS").when((n <= 2) & (share >= 0.5), "WARN").otherwise("FAIL"))


def extraction_progress(chunks: DataFrame, entities: DataFrame, relations: DataFrame, evidence: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    done = chunks.join(evidence.select(F.col("chunk_id").alias("id")), "id", "left_semi").agg(F.count("*").alias("processed"))
    row = _one_row(chunks.agg(F.count("*").alias("total")), done, entities.agg(F.count("*").alias("entities")), relations.agg(F.count("*").alias("relations")))
    row = row.join(errors.agg(F.count("*").alias("errors")), F.lit(True)) if errors is not None else row.withColumn("errors", F.lit(0).cast("long"))
    return row.withColumn("remaining", F.col("total") - F.col("processed"))


#: Of each table: unique keys, columns that point to another table, rules that a row must not break, columns that are never null.
UNIQUE = {"documents": ["pmid"], "chunks": ["document_id", "chunk_index"], "entities": ["normalized_name", "type"], "relations": ["head_id", "tail_id", "label"], "evidence": ["relation_id", "chunk_id", "quote_hash"]}
FOREIGN = (("chunks", "document_id", "documents"), ("relations", "head_id", "entities"), ("relations", "tail_id", "entities"), ("evidence", "relation_id", "relations"), ("evidence", "chunk_id", "chunks"))
CHECKS = (("relations", "confidence between 0 and 1", "confidence between 0 and 1"), ("jobs", "progress between 0 and 100", "progress between 0 and 100"), ("jobs", "processed <= total", "processed_items <= total_items"))
NOT_NULL = {"documents": ["pmid", "title"], "chunks": ["text", "chunk_index"], "entities": ["name", "normalized_name", "type"], "relations": ["label"], "evidence": ["quote", "quote_hash"]}


def check_constraints(t: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) for every unique, foreign key, check and not-null rule of the tables that are given: keys that
    occur more than once, rows that point to nothing, rows that break a rule.

    Each table is read once: a row becomes one fact for each of its keys (the id that others may point to, those that it
    points to, those that are unique) and for each rule that it breaks. A fact is a number for its kind, a digest of its key
    of 128 bits and the place of its rule among those of the kind; facts with one key meet in one exchange, added up in each
    task first, so a key in a third of all rows is one row a task."""
    foreign = [(c, column, p) for c, column, p in FOREIGN if c in t and p in t]
    checks = [(n, f"{n}: {text}", F.coalesce(F.expr(rule), F.lit(True))) for n, text, rule in CHECKS if n in t]
    checks += [(n, f"{n}.{c} not null", F.col(c).isNotNull()) for n, cs in NOT_NULL.items() if n in t for c in cs]
    unique = [(n, f"{n}: unique {', '.join(keys)}", keys) for n, keys in UNIQUE.items() if n in t]
    # Kinds: ids of a table, with a place for each column that points to them; each unique key; each check.
    pointing = {p: [f"{c}.{column} in {p}" for c, column, to in foreign if to == p] for p in dict.fromkeys(p for _, _, p in foreign)}
    kinds = [("ids", rules) for rules in pointing.values()] + [("unique", [r]) for _, r, _ in unique] + [("check", [r]) for _, r, _ in checks]
    at = {r: (kind, place) for kind, (_, rules) in enumerate(kinds) for place, r in enumerate(rules)}
    digest = lambda c: F.substring(F.unhex(F.sha2(c.cast("string"), 256)), 1, 16)
    whole = lambda keys: F.concat(*(F.coalesce(F.concat(F.char_length(F.col(k).cast("string")), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in keys))
    fact = lambda kind, key, place: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(place).cast("int").alias("place"))
    no_key = F.lit(None).cast("binary")
    parts = []
    for name, df in t.items():
        facts = [fact(list(pointing).index(name), digest(F.col("id")), None)] if name in pointing else []
        facts += [F.when(F.col(c).isNotNull(), fact(at[f"{n}.{c} in {p}"][0], digest(F.col(c)), at[f"{n}.{c} in {p}"][1])) for n, c, p in foreign if n == name]
        facts += [fact(*at[rule][:1], digest(whole(keys)), 0) for n, rule, keys in unique if n == name]
        facts += [F.when(~ok, fact(at[rule][0], no_key, 0)) for n, rule, ok in checks if n == name]
        if facts:
            parts.append(df.select(F.explode(F.array_compact(F.array(*facts))).alias("f")).select("f.*"))
    rules = [r for _, r, _ in unique] + [f"{c}.{column} in {p}" for c, column, p in foreign] + [r for _, r, _ in checks]
    spark = next(iter(t.values())).sparkSession
    listed = spark.createDataFrame([(r, *at[r], kinds[at[r][0]][0]) for r in rules], "rule string, kind int, place int, what string")
    # Facts of one key beside each other: is there a row with that id? Counts a place are plain numbers, so a hash table keeps them.
    places = range(max(len(rules) for _, rules in kinds))
    here = reduce(DataFrame.union, parts).groupBy("kind", "key").agg(F.max(F.col("place").isNull()).alias("there"), *(F.count_if(F.col("place") == i).alias(f"n{i}") for i in places))
    sums = [F.struct(F.lit(i).alias("place"), F.sum(F.when(~F.col("there"), F.col(f"n{i}"))).alias("apart"), F.count_if(F.col(f"n{i}") > 1).alias("twice")) for i in places]
    found = here.groupBy("kind").agg(F.array(*sums).alias("s")).select("kind", F.explode("s").alias("s")).select("kind", "s.*")
    violations = F.when(F.col("what") == "unique", F.col("twice")).otherwise(F.col("apart"))
    return listed.join(found, ["kind", "place"], "left").select("rule", F.coalesce(violations, F.lit(0)).alias("violations"))
