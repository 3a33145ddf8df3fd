"""Exact deduplication as a stateful stream, native Spark operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, Stored, shared_dir

# Spark's disk-backed state store. Without fallocate a store takes the room its state needs, not fixed megabytes for
# every partition; changelogs upload what a batch changed; all stores of an executor share bounded buffers and caches.
_ROCKS = "spark.sql.streaming.stateStore.rocksdb"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKS}.allowFAllocate": "false",
    f"{_ROCKS}.changelogCheckpointing.enabled": "true",
    f"{_ROCKS}.boundedMemoryUsage": "true",
    f"{_ROCKS}.maxMemoryUsageMB": "96",
}
_KEPT = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")
SALTS = 16
#: Up to so many hit digests (about 10 MB) are sent to every task, so that no other text is exchanged.
SENT_HITS = 100_000


def _own_session(spark: SparkSession) -> SparkSession:
    """A session of this application with the stream's settings, so that no other query of spark sees them."""
    own = spark.newSession()
    for name in _KEPT:
        own.conf.set(name, spark.conf.get(name))
    for name, value in _STATE.items():
        own.conf.set(name, value)
    return own


def normalised(text) -> F.Column:
    """Text without any white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def sha256_digest(text) -> F.Column:
    return F.sha2(text, 256)


def digest_state(keys: DataFrame) -> DataFrame:
    """The state of a stream of keys (digest, doc_id, n_chars, place): for every digest the number of rows, and the
    stable identifier and content locator of the row that stays (most code points, then smallest doc_id). State is
    kept on disk and never expires, so a copy is found however much later it arrives."""
    first = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id"), F.col("place")))
    state = keys.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size"))
    return state.select("digest", F.col("first.doc_id").alias("keep_id"), (-F.col("first.less")).alias("keep_chars"), F.col("first.place").alias("keep_place"), "group_size")


def run_stream(keys: DataFrame, spark: SparkSession, folder: str, files_per_batch: int | None = None, batch: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Append the keys to folder/keys, feed what is new there through the stream until all of it is consumed, and return
    the new keys, the older ones and the last state of each digest. The stream's state stays in folder/state, so the
    next call finds the copies of every row before. Every micro-batch writes the digests it touched to a folder of its
    own, so a batch run twice replaces itself. Keys of a `batch` that were written whole are not written again, so
    the stream meets them once however often the call is made."""
    source = f"batch-{batch}" if batch else shared_dir(spark, "x").rsplit("-", 1)[1]
    spark.createDataFrame([], keys.schema).write.mode("overwrite").parquet(f"{folder}/keys/none")
    written = f"{folder}/keys/{source}"
    if not _exists(spark, f"{written}/_SUCCESS"):
        keys.write.mode("overwrite").parquet(written)
    older = _read(spark, f"{folder}/keys", keys.schema).filter(~F.contains(F.input_file_name(), F.lit(f"/keys/{source}/")))
    own = _own_session(spark)
    reader = own.readStream.schema(keys.schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/groups/batch={number}/rows")

    groups = digest_state(reader.parquet(f"{folder}/keys"))
    schema = T.StructType([*groups.schema.fields, T.StructField("batch", T.IntegerType())])
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/groups/batch=none/rows")  # so that no rows at all read as none
    query = groups.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    latest = _read(spark, f"{folder}/groups", schema).groupBy("digest").agg(F.max_by(F.struct("keep_id", "keep_chars", "keep_place", "group_size"), "batch").alias("s"))
    return spark.read.schema(keys.schema).parquet(written), older, latest.select("digest", "s.*")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def _facts(docs: DataFrame, digest, body: bool = False) -> DataFrame:
    columns = [digest(normalised(F.col("text"))).alias("digest"), F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"), "place"]
    return docs.select("doc_id", *columns, *([normalised(F.col("text")).alias("body")] if body else []))


def exact_dedup(docs: DataFrame, digest=sha256_digest, files_per_batch: int | None = None, id_col: str = "doc_id", text_col: str = "text", state: str | None = None, batch: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, keep_place), one row per row of docs.

    Rows are equal when their texts are identical without white space. The stream keeps one state per digest; every
    hit (a digest that two rows share) is then checked on the full bytes: the smallest and the largest normalised
    text of a digest must be one. Both are pre-aggregated in each task, so thousands of copies meet as one row a
    task. Digests whose texts differ are regrouped by the text itself, so a collision never merges two texts.

    With `state`, a folder that all executors share, the state outlives the call: rows of a later call with the same
    folder meet those of all calls before, in groups that count both, and the texts of older rows that they hit are
    read back for the check from where the state's locators say they are (Parquet files with the same two columns,
    still in place). Older rows are not returned again, and a row that was kept stays in what was returned then. A call
    that may be made again after a failure names its rows by a `batch`: with the same name they count once.

    Null text counts as empty. Repeated rows are rows: they count in group_size, and rows that share the id that
    stays are all kept. An id may stand on several texts, and each is judged by itself. Null ids sort first among
    equals. Other columns of docs, whatever their names, are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    tables = Stored(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.input_file_name().alias("place"))
    keys, older, groups = run_stream(_facts(rows, digest), spark, state or shared_dir(spark, "dedup"), files_per_batch, batch)
    groups = tables.put(groups.join(keys.select("digest"), "digest", "left_semi"), "dedup-latest")
    out = keys.join(groups, "digest")
    bodies = _facts(rows, digest, body=True)
    if state:
        bodies = bodies.unionByName(_read_back(spark, older, groups, digest, id_col, text_col, docs.schema))
    hits = groups.filter("group_size > 1").select("digest")
    if hits.count() <= SENT_HITS:
        hit = bodies.join(F.broadcast(hits), "digest", "left_semi")
    else:  # salted, so that the copies of one text are spread over SALTS tasks
        hits = hits.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        hit = bodies.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(hits, ["digest", "salt"], "left_semi")
    differ = tables.put(hit.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).filter("low <> high").select("digest"), "dedup-collisions")
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "keep_place"]
    if differ.isEmpty():
        return out.select(*columns)
    split = bodies.join(differ, "digest", "left_semi")
    own = split.groupBy("digest", "body").agg(F.min(F.struct((-F.col("n_chars")).alias("less"), "doc_id", "place")).alias("first"), F.count("*").alias("group_size"))
    apart = _facts(rows, digest, body=True).join(differ, "digest", "left_semi").join(own, ["digest", "body"]).withColumns({"keep_id": F.col("first.doc_id"), "keep_place": F.col("first.place")})
    return out.join(differ, "digest", "left_anti").select(*columns).union(apart.select(*columns))


def _read_back(spark: SparkSession, older: DataFrame, groups: DataFrame, digest, id_col: str, text_col: str, schema: T.StructType) -> DataFrame:
    """The rows of earlier calls whose digest is hit again, read from the files that their locators name. The driver
    gets the names of those files, as for any scan."""
    hit = older.join(groups.select("digest"), "digest", "left_semi")
    places = [r[0] for r in hit.select("place").distinct().collect()]
    if "" in places:
        raise ValueError("rows of an earlier call come from no file and cannot be read back")
    if not places:
        return hit.withColumn("body", F.lit("")).select("doc_id", "digest", "n_chars", "place", "body")
    rows = spark.read.schema(schema).parquet(*places).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.input_file_name().alias("place"))
    return _facts(rows, digest, body=True).join(groups.select("digest"), "digest", "left_semi")
