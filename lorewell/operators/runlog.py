"""Run log and change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..vocabulary import TERMINAL_STATES
from .build import key_id
from .query import paginate


def job_metrics(runs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """runs with progress, items_remaining, duration_seconds (until as_of if unfinished) and is_terminal."""
    done, total = F.col("processed_items"), F.col("total_items")
    progress = F.when(total > 0, F.least(F.lit(100), F.floor(done * 100 / total))).otherwise(F.coalesce("progress", F.lit(0))).cast("int")
    end = F.coalesce("completed_at", as_of if as_of is not None else F.current_timestamp())
    seconds = F.when(F.col("started_at").isNotNull(), (F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6)
    return runs.withColumns({"progress": progress, "items_remaining": F.when(total.isNotNull(), F.greatest(F.lit(0), total - done)), "duration_seconds": seconds, "is_terminal": F.col("status").isin(*TERMINAL_STATES)})


def list_jobs(runs: DataFrame, status: str | None = None, page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(a page of the runs of a state, newest first, then by id; one row with their total and the number of pages)."""
    runs = runs.filter(F.col("status") == status) if status else runs
    total = runs.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return paginate(runs, [F.desc_nulls_last("created_at")], page, size), total


def job_transitions(events: DataFrame, id_col: str = "job_id", at: str = "ts", status: str = "status", tie: Sequence[str] = ()) -> DataFrame:
    """Illegal steps of (job, time, state): legal are a start as pending, pending to running or cancelled, and running to
    a terminal state; nothing follows those."""
    before = F.lag(status).over(Window.partitionBy(id_col).orderBy(at, *tie))
    steps = events.withColumn("before", before)
    legal = F.when(F.col("before").isNull(), F.col(status) == "pending").when(F.col("before") == "pending", F.col(status).isin("running", "cancelled")).when(F.col("before") == "running", F.col(status).isin(*TERMINAL_STATES)).otherwise(F.lit(False))
    return steps.filter(~legal)


def _packed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    data = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket"), data.alias("data"))


def unlike_buckets(old: DataFrame, new: DataFrame) -> DataFrame:
    """The buckets of two packed tables that hold unlike rows, by digests that do not hang on the order of rows: their
    number, and the XOR of two independent 64-bit hashes of each. A row a bucket and task is exchanged."""
    digest = lambda df, name: df.groupBy("_bucket").agg(F.struct(F.count("*"), F.bit_xor(F.xxhash64(F.lit(1), "data")), F.bit_xor(F.xxhash64(F.lit(2), "data"))).alias(name))
    both = digest(old, "a").join(digest(new, "b"), "_bucket", "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("_bucket")


def diff_snapshots(old: DataFrame, new: DataFrame, keys: Sequence[str], table: str, buckets: int = 4096) -> DataFrame:
    """Audit rows: INSERT, DELETE and UPDATE between two states of a table, rows as JSON. Compared null-safely.

    Rows are dealt to buckets by a hash of their keys, and digests of the buckets are compared first; only the rows of
    unlike buckets are joined. So tables that are alike exchange digests only. A bucket whose rows changed counts as
    alike only if two 64-bit hashes and the number of rows agree by chance. Keys are unique; the list of unlike buckets, `buckets` numbers at most, is
    broadcast."""
    old, new = _packed(old, keys, buckets), _packed(new, keys, buckets)
    unlike = F.broadcast(unlike_buckets(old, new))
    rows = lambda df, name: df.join(unlike, "_bucket", "left_semi").select(*keys, F.col("data").alias(name))
    both = rows(old, "old_data").join(rows(new, "new_data"), list(keys), "full_outer").filter(~F.col("old_data").eqNullSafe(F.col("new_data")))
    action = F.when(F.col("new_data").isNull(), "DELETE").when(F.col("old_data").isNull(), "INSERT").otherwise("UPDATE")
    return both.select(F.lit(table).alias("table_name"), F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("record_id"), action.alias("action"), "old_data", "new_data")


def bulk_delete_audit(ids: DataFrame, table: str, reason: str | None = None, per_row: int = 10_000) -> DataFrame:
    """Audit rows that list deleted ids: one row up to per_row ids, and as many more as keep a row at about that, by a
    hash of the id, so that no row gathers all."""
    slots = max(1, -(-ids.count() // per_row))
    rows = ids.groupBy(F.pmod(F.xxhash64("id"), F.lit(slots)).alias("slot")).agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("ids"))
    return rows.select(F.lit(table).alias("table_name"), key_id(F.array_join("ids", ",")).alias("record_id"), F.lit("BULK_DELETE").alias("action"), F.to_json(F.struct("ids", F.size("ids").alias("count"))).alias("old_data"), F.lit(reason).alias("reason"))


def audit_history(log: DataFrame, table: str | None = None, record: str | None = None, action: str | None = None) -> DataFrame:
    for column, value in (("table_name", table), ("record_id", record), ("action", action)):
        if value is not None:
            log = log.filter(F.col(column) == value)
    return log.orderBy(F.desc("created_at"), "id")
