"""An inverted index of three-letter grams over the names of entities, for searches of parts of names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions

_GRAM, FOLDERS = 3, 256
_NAMES = "array<string>"


def all_names(entities: DataFrame) -> DataFrame:
    """(id, name): normalized names, names and aliases."""
    return entities.select("id", F.explode(F.concat(F.array("normalized_name", "name"), F.coalesce("aliases", F.array().cast(_NAMES)))).alias("name")).filter("name is not null")


def holds(pattern: str) -> F.Column:
    """Whether the normalized name, the name or an alias of an entity holds the pattern without case; % and _ are wildcards."""
    p = f"%{pattern}%"
    return F.col("normalized_name").ilike(p) | F.col("name").ilike(p) | F.exists(F.coalesce("aliases", F.array().cast(_NAMES)), lambda a: a.ilike(p))


def _folder(gram) -> F.Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def build_term_index(entities: DataFrame, path: str) -> None:
    """Write the grams of all names in lower case to path: (gram, id), in folders by a hash of the gram and sorted by it, so
    that a search reads its grams alone, and how many entities have each gram. A gram that most names hold is written by
    as many tasks as its size asks for. Building again replaces the index as a whole."""
    spark = entities.sparkSession
    low = F.lower("name")
    grams = F.transform(F.sequence(F.lit(1), F.char_length(low) - _GRAM + 1), lambda i: F.substring(low, i, F.lit(_GRAM)))
    grams = all_names(entities).filter(F.char_length(low) >= _GRAM).select("id", F.explode(F.array_distinct(grams)).alias("gram")).distinct()
    folder = f"{path}/postings"
    versions.add(grams.withColumn("part", _folder("gram")).hint("rebalance", "part").sortWithinPartitions("part", "gram"), folder, True, "part")
    postings = versions.read(spark, folder, "gram string, id string, part int")
    versions.add(postings.groupBy("gram").agg(F.count("*").alias("n")), f"{path}/counts", True)


def grams_of(pattern: str) -> list[str]:
    """The grams that a name must have to hold a LIKE pattern: those of its runs between wildcards. A backslash makes the next
    character literal. Only ASCII counts, of which lower case is the same everywhere."""
    runs = re.sub(r"\\(.)|[%_]", lambda m: m[1] or "\0", pattern, flags=re.S)
    runs = [r.lower() for r in re.split(r"[^\x01-\x7f]+", runs)]
    return sorted({r[i : i + _GRAM] for r in runs for i in range(len(r) - _GRAM + 1)})


def candidates(spark: SparkSession, path: str, pattern: str, rarest: int = 4) -> DataFrame | None:
    """The ids of entities that have the rarest grams of a pattern, a superset of those whose names hold it; None if the
    pattern has no gram, which only a scan can answer. The counts of the pattern's own grams reach the driver."""
    grams = grams_of(pattern)
    if not grams:
        return None
    counts = versions.read(spark, f"{path}/counts", "gram string, n long").filter(F.col("gram").isin(grams))
    known = {r["gram"]: r["n"] for r in counts.collect()}
    chosen = sorted(grams, key=lambda g: (known.get(g, 0), g))[:rarest]
    parts = [r[0] for r in spark.createDataFrame([(g,) for g in chosen], "gram string").select(_folder("gram")).distinct().collect()]
    postings = versions.read(spark, f"{path}/postings", "gram string, id string, part int").filter(F.col("part").isin(parts) & F.col("gram").isin(chosen))
    return postings.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(chosen)).select("id")


def find(entities: DataFrame, pattern: str, index: str | None = None) -> DataFrame:
    """The entities that hold the pattern, by the index if there is one and it can tell anything; always checked."""
    few = candidates(entities.sparkSession, index, pattern) if index else None
    return (entities if few is None else entities.join(few, "id", "left_semi")).filter(holds(pattern))
