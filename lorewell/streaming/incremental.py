"""Incremental runs with Structured Streaming: documents in, graph tables out.

What has been seen is kept by key in Spark's disk-backed state store, so a batch costs what its own keys cost, however
large the tables are, and reads none of them. What a batch adds or changes is a folder of its own (`batch=<number>`), which a batch
that runs again after a failure writes again, so each is applied once. `compact` merges older folders into one version.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import packed, quote_hash, unpacked
from ..operators.build import build_entities, key_id, quarantine_relations
from ..operators.chunking import chunk_sentences
from ..operators.parsing import parse_chunks
from ..plans.kg import mentions_of, triples_of
from ..schemas import OUTPUTS
from ..sources import versions
from ..sources.shared import store
from ..sources.tables import ingest_documents

_ROCKS = "spark.sql.streaming.stateStore.rocksdb"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKS}.changelogCheckpointing.enabled": "true",
    f"{_ROCKS}.allowFAllocate": "false",
}
_ENTITY = "struct<normalized_name:string,type:string>"
#: Facts say what ids and hashes follow from; these are made where rows are written.
_FACTS = f"kind string, key binary, chunk_id string, position int, confidence double, row struct<normalized_name:string,type:string,name:string,head:{_ENTITY},tail:{_ENTITY},label:string,quote:string,quote_start:int,quote_end:int>"
_ROWS = {
    "entities": ("normalized_name", "type", "name", "chunk_id", "position"),
    "relations": ("head_id", "tail_id", "label", "confidence"),
    "evidence": ("relation_id", "chunk_id", "quote", "quote_hash", "quote_start", "quote_end"),
}


def _own_session(spark: SparkSession) -> SparkSession:
    """A session with the state store's settings, so that no other query of spark sees them."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    for name, value in _STATE.items():
        own.conf.set(name, value)
    return own


def first_seen(rows: DataFrame, keys: list[str], place: Column, *more: Column) -> DataFrame:
    """Of a stream, the keys that a micro-batch touches, with `first`, the time of the batch that first had the key and
    the smallest place there, and `latest`, that of this batch. The time of a batch is in its log, so it is the same when
    the batch runs again. A key is new where first.at = latest. State is a row a key, on disk, and never expires."""
    rows = rows.withColumn("now", F.current_timestamp())
    return rows.groupBy(*keys).agg(F.min(F.struct(F.col("now").alias("at"), place.alias("place"))).alias("first"), F.max("now").alias("latest"), *more)


def _start(query: DataFrame, batch, checkpoint: str) -> StreamingQuery:
    return query.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _reader(spark: SparkSession, schema, files_per_batch: int | None):
    reader = spark.readStream.schema(schema)
    return reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader


def stream_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, size: int = 1000, overlap: int = 200, files_per_batch: int | None = None) -> StreamingQuery:
    """Append each new pmid of the documents that arrive in source once to target/documents, and its chunks to
    target/chunks. Of rows of one batch with a new pmid the first by id stays; a pmid that comes again in any later batch
    is left out. Rows without a pmid are. State holds pmids, ids and the names of files, from which the batch's new documents are
    read; no document of an earlier batch is."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{target}/documents/batch_none")
    own = _own_session(spark)
    rows = _reader(own, schema, files_per_batch).parquet(source).filter("pmid is not null")
    seen = first_seen(rows.select("pmid", "id", F.col("_metadata.file_path").alias("file")), ["pmid"], F.struct("id", "file"))

    def batch(found: DataFrame, number: int) -> None:
        fresh = found.filter("first.at = latest").select("pmid", "first.place.id", "first.place.file").persist()
        try:
            files = [unquote(r[0]) for r in fresh.select("file").distinct().collect()]  # of this batch
            docs = found.sparkSession.read.schema(schema).parquet(*files or [f"{target}/documents/batch_none"])
            docs = docs.join(fresh, ["pmid", "id"], "left_semi").select(docs.columns)
            first, _ = ingest_documents(docs.limit(0), docs, order=("id", F.to_json(F.struct(*docs.columns))))
            first.write.mode("overwrite").parquet(f"{target}/documents/batch_{number}")
        finally:
            fresh.unpersist()
        chunk_sentences(spark.read.schema(docs.schema).parquet(f"{target}/documents/batch_{number}"), size, overlap).write.mode("overwrite").parquet(f"{target}/chunks/batch_{number}")

    return _start(seen, batch, checkpoint)


def _facts(df: DataFrame, chunks: DataFrame) -> DataFrame:
    """What a batch of answers says: spellings of entities, with their keys, and triples, a relation and a quote each, which get
    theirs in `_keyed`."""
    parsed = store(parse_chunks(df, chunks), "parsed")
    kinds = T._parse_datatype_string(_FACTS)["row"].dataType

    def facts(rows: DataFrame, kind: str, key: Column, confidence: Column, **columns: Column) -> DataFrame:
        row = F.struct(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))
        return rows.select(F.lit(kind).alias("kind"), key.cast("binary").alias("key"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("position").cast("int").alias("position"), confidence.cast("double").alias("confidence"), row.alias("row"))

    # Of a batch only the first mention of a spelling counts.
    first = mentions_of(parsed).groupBy("normalized_name", "type", F.lower("name").alias("low")).agg(F.min(F.struct("chunk_id", F.col("position").cast("int").alias("position"), "name")).alias("m"))
    first = first.select("normalized_name", "type", "m.*")
    triples = quarantine_relations(triples_of(parsed))[0].filter("h is not null and t is not null")
    names = {c: F.col(c) for c in ("normalized_name", "type", "name")}
    spellings = facts(first, "entities", packed(key_id("normalized_name", "type", F.lower("name"))), F.lit(None), **names)
    quote = {"quote": F.col("evidence"), "quote_start": F.col("at.start"), "quote_end": F.col("at.end")}
    return spellings.union(facts(triples, "triples", F.lit(None), F.col("confidence"), head=F.col("h"), tail=F.col("t"), label=F.col("label"), **quote))


def _relation_ids(row: str) -> dict[str, Column]:
    """head_id, tail_id and the id of the relation in a fact's row."""
    head, tail = (key_id(f"{row}.{end}.normalized_name", f"{row}.{end}.type") for end in ("head", "tail"))
    return {"head_id": head, "tail_id": tail, "relation_id": key_id(head, tail, F.col(f"{row}.label"))}


def _keyed(facts: DataFrame) -> DataFrame:
    """facts with a key each: a triple becomes the fact that its relation is and the fact that its quote is one of it."""
    rows = facts.withColumn("relation", F.when(F.col("kind") == "triples", packed(_relation_ids("row")["relation_id"])))
    none, text = F.lit(None), F.lit(None).cast("string")
    fact = lambda kind, key, placed, confidence, row: F.struct(kind.alias("kind"), key.alias("key"), F.when(placed, F.col("chunk_id")).alias("chunk_id"), F.when(placed, F.col("position")).alias("position"), confidence.alias("confidence"), row.alias("row"))
    yes, no = F.lit(True), F.lit(False)
    edge = F.col("row").withField("quote", text).withField("quote_start", none.cast("int")).withField("quote_end", none.cast("int"))
    quote = packed(key_id(unpacked("relation"), quote_hash(F.col("row.quote"))))
    both = F.array(fact(F.lit("relations"), F.col("relation"), no, F.col("confidence"), edge), fact(F.lit("evidence"), quote, yes, none.cast("double"), F.col("row")))
    own = F.array(fact(F.col("kind"), F.col("key"), yes, F.col("confidence"), F.col("row")))
    return rows.select(F.explode(F.when(F.col("kind") == "triples", both).otherwise(own)).alias("f")).select("f.*")


def stream_build_kg(spark: SparkSession, source: str, chunks: DataFrame, target: str, checkpoint: str, format: str = "parquet", files_per_batch: int | None = None) -> StreamingQuery:
    """Merge the model answers that arrive in source into the graph under target; `graph_table` reads it.

    A first stream turns answers into keyed facts, a second one, which is returned, merges these by key in the state store: of a
    spelling or a quote the first batch that has it counts, and in it the first by (chunk_id, position), of a relation the
    highest confidence. Each batch writes the rows that are new or changed to target/<table>/deltas/batch=<number>. Both
    answers of a chunk must arrive in one batch. State holds one row a spelling, relation and quote."""
    own = _own_session(spark)

    def parse(df: DataFrame, number: int) -> None:
        _facts(df, chunks).write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/facts/{number}")

    _start(_reader(spark, OUTPUTS, files_per_batch).format(format).load(source), parse, f"{checkpoint}/facts").awaitTermination()

    best = F.max(F.struct("confidence", (-F.unix_micros("now")).alias("before"))).alias("best")
    facts = _reader(own, _FACTS, files_per_batch).option("recursiveFileLookup", "true").parquet(f"{target}/facts")
    merged = first_seen(_keyed(facts), ["kind", "key"], F.struct("chunk_id", "position", "row"), best)

    def write(found: DataFrame, number: int) -> None:
        new = F.when(F.col("kind") == "relations", -F.col("best.before") == F.unix_micros("latest")).otherwise(F.col("first.at") == F.col("latest"))
        found = found.filter(new).select("kind", "key", "first.place.row", "first.place.chunk_id", "first.place.position", "best.confidence").persist()
        rows = found.withColumns({"id": unpacked("key"), **_relation_ids("row"), "quote_hash": quote_hash(F.col("row.quote"))}).select("*", "row.*")
        try:
            for name, columns in _ROWS.items():
                rows.filter(F.col("kind") == name).select("id", *columns).write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/{name}/deltas/batch={number}")
        finally:
            found.unpersist()

    return _start(merged, write, f"{checkpoint}/merge")


def _changes(spark: SparkSession, target: str, name: str) -> DataFrame | None:
    """The rows of the compacted version and of the batches after it, with the number of the batch of each."""
    base, deltas = versions.current(spark, f"{target}/{name}/base"), None
    try:
        deltas = spark.read.parquet(f"{target}/{name}/deltas")
    except AnalysisException:
        pass  # no batch yet, or all are compacted
    if base is None:
        return deltas
    rows = versions.read(spark, f"{target}/{name}/base")
    return rows if deltas is None else rows.unionByName(deltas.filter(F.col("batch") > int(base.notes["through"])))


def _latest(rows: DataFrame) -> DataFrame:
    """The last row of each id. Digests cross the exchange in half their bytes."""
    ids = [c for c in ("id", "head_id", "tail_id", "relation_id", "quote_hash") if c in rows.columns]
    columns = [packed(c).alias(c) if c in ids else F.col(c) for c in rows.columns if c not in ("id", "batch")]
    last = rows.groupBy(packed("id").alias("id")).agg(F.max(F.struct("batch", *columns)).alias("r"))
    return last.select("id", "r.*").withColumns({c: unpacked(c) for c in ids}).select(rows.columns)


def graph_table(spark: SparkSession, target: str, name: str, ids: DataFrame | None = None) -> DataFrame | None:
    """A table of the graph after all batches, or of it the rows whose id is in ids (id): those are chosen before anything is
    aggregated. None if no batch has written it. Entities are put together from their spellings, in order of arrival."""
    rows = _changes(spark, target, name)
    if rows is None:
        return None
    if name == "entities":
        rows = rows.withColumn("id", key_id("normalized_name", "type"))
    if ids is not None:
        rows = rows.join(ids.select("id"), "id", "left_semi")
    if name != "entities":
        return _latest(rows).drop("batch")
    return build_entities(rows.withColumn("chunk_id", F.concat_ws(":", F.lpad(F.col("batch").cast("string"), 12, "0"), "chunk_id")))


def compact(spark: SparkSession, target: str) -> dict[str, int]:
    """Merge the deltas of each table into one version, through the last batch, and delete them; returns the last
    batch by table. Readers see the table before or after, whenever this dies. Call it while no stream is at work."""
    done = {}
    for name in _ROWS:
        rows = _changes(spark, target, name)
        if rows is None:
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}/deltas")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        batches = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith("batch=")] if fs.exists(at) else []
        if not batches:
            continue
        done[name] = max(int(p.getName().removeprefix("batch=")) for p in batches)
        # Spellings and quotes are written once, by the first batch that has them; a relation is written again when it becomes surer.
        versions.add(_latest(rows) if name == "relations" else rows, f"{target}/{name}/base", True, notes={"through": str(done[name])})
        versions.vacuum(spark, f"{target}/{name}/base", 1)
        for path in batches:
            fs.delete(path, True)
    return done


def stream_progress(results: DataFrame) -> DataFrame:
    """Running counts over a stream of (chunk_id, error): processed chunks and errors. Write in complete mode."""
    return results.groupBy().agg(F.count("*").alias("processed"), F.count("error").alias("errors"))
