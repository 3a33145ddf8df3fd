"""Reading, writing and admitting tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from . import versions

TABLES = {"documents": schemas.DOCUMENTS, "chunks": schemas.CHUNKS, "entities": schemas.ENTITIES, "relations": schemas.RELATIONS, "evidence": schemas.EVIDENCE}


def read_tables(spark: SparkSession, path: str, tables: dict[str, str] = TABLES) -> dict[str, DataFrame]:
    """The last complete version of each table, or a plain folder of Parquet files."""
    return {name: versions.read(spark, f"{path}/{name}", schema) for name, schema in tables.items()}


#: What a document's rows are dealt by, and into how many folders.
DEALT, FOLDERS = {"chunks": "document_id", "evidence": "chunk_id"}, 64


def _part(key: str | Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "error", dealt: dict[str, str] = DEALT, folders: int = FOLDERS, keep: int = 1) -> None:
    """Write tables under path, each as a version of its own: readers see the old table or the new one, whenever the
    writer dies (`sources.versions`). Those in `dealt` lie in folders by a hash of that column, `part`, which `of_key`
    goes to at once. mode is "error" (if there is a table), "append" or "overwrite"; a table may be made from itself. All but the last
    `keep` versions are deleted; None keeps all, for readers that are at work meanwhile."""
    for name, df in tables.items():
        table = f"{path}/{name}"
        if mode == "error" and versions.current(df.sparkSession, table):
            raise ValueError(f"{table} exists")
        rows = df.withColumn("part", _part(dealt[name], folders)) if name in dealt else df
        versions.add(rows, table, mode != "append", "part" if name in dealt else None)
        if keep is not None:
            versions.vacuum(df.sparkSession, table, keep)


def of_key(spark: SparkSession, path: str, name: str, value: str, schema: str, dealt: dict[str, str] = DEALT, folders: int = FOLDERS) -> DataFrame:
    """The rows of a dealt table with a key, from the key's folder alone."""
    rows = versions.read(spark, f"{path}/{name}", f"{schema}, part int")
    part = spark.range(1).select(_part(F.lit(value), folders)).first()[0]
    return rows.filter((F.col("part") == part) & (F.col(dealt[name]) == value)).drop("part")


def read_model_outputs(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return spark.read.schema(schemas.OUTPUTS).format(format).load(path)


def export_csv(df: DataFrame, path: str, decimals: Sequence[str] = ("similarity",)) -> None:
    """A report as CSV with a header: line breaks in text become blanks, columns in decimals get four places."""
    columns = [F.format_string("%.4f", c).alias(c) if c in decimals else F.regexp_replace(c, r"[\r\n]+", " ").alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes]
    df.select(*columns).write.option("header", True).csv(path)


def markdown(df: DataFrame, title: str) -> DataFrame:
    """A report as lines (line, key, text) of a Markdown table: in order by line, then key, which is df's row."""
    cells = lambda values: F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))
    body = df.select(cells([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("text"), F.struct(*df.columns).alias("key"))
    body = body.select(F.lit(5).alias("line"), "key", "text")
    head = [(1, f"## {title}"), (2, ""), (3, "| " + " | ".join(df.columns) + " |"), (4, "|" + " --- |" * len(df.columns))]
    return df.sparkSession.createDataFrame(head, "line int, text string").unionByName(body, allowMissingColumns=True).select("line", "key", "text")


def export_report(df: DataFrame, path: str, format: str = "json", title: str = "Report") -> None:
    if format == "json":
        df.write.json(path)
    else:
        # A range-partitioned sort: the files are in order one after another.
        markdown(df, title).orderBy("line", "key").select("text").write.text(path)


def ingest_documents(existing: DataFrame, incoming: DataFrame, order: Sequence[str | Column] = ("id",), dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents after the ingest, one row of counts). Of incoming rows the first with each new pmid is inserted."""
    first = F.row_number().over(Window.partitionBy("pmid").orderBy(*order))
    fresh = incoming.filter("pmid is not null").withColumn("_n", first).filter("_n = 1").drop("_n").join(existing.select("pmid"), "pmid", "left_anti").select(incoming.columns)
    total = incoming.agg(F.count("*").alias("fetched"), F.count_if(F.col("pmid").isNull()).alias("errors"))
    counts = total.join(fresh.agg(F.count("*").alias("inserted")), F.lit(True)).withColumn("skipped", F.col("fetched") - F.col("errors") - F.col("inserted"))
    return (existing if dry_run else existing.unionByName(fresh, allowMissingColumns=True)), counts


def filter_corpus(docs: DataFrame, all_of: Sequence[Sequence[str]], min_date=None, max_date=None, limit: int | None = None, text: Sequence[str] = ("title", "abstract"), date_col: str = "publication_date", id_col: str = "id") -> DataFrame:
    """Documents that hold a term of every group, in a range of dates; the best by number of terms held, then by id."""
    words = F.lower(F.concat_ws("\n", *text))
    has = [[F.contains(words, F.lit(t.lower())) for t in group] for group in all_of]
    keep = reduce(and_, (reduce(or_, group) for group in has), F.lit(True))
    if min_date is not None:
        keep &= F.col(date_col) >= F.lit(min_date)
    if max_date is not None:
        keep &= F.col(date_col) <= F.lit(max_date)
    score = reduce(lambda a, b: a + b, (h.cast("int") for group in has for h in group), F.lit(0))
    out = docs.filter(keep).withColumn("score", score)
    return out.orderBy(F.desc("score"), id_col).limit(limit) if limit is not None else out


