"""The default controlled vocabularies, as data. Operators take them as parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Entity types, and relation labels with whether head and tail may be swapped.
ENTITY_TYPES = ["Disease", "Gene", "Protein", "Pathway", "CellType", "Tissue/Region", "Compound/Drug", "Phenotype", "Biomarker"]
RELATION_LABELS = ["ASSOCIATED_WITH", "INCREASES_RISK", "DECREASES_RISK", "UPREGULATES", "DOWNREGULATES", "ACTIVATES", "INHIBITS", "BINDS", "BIOMARKER_FOR", "PART_OF", "EXPRESSED_IN"]
UNDIRECTED_LABELS = ["ASSOCIATED_WITH", "BINDS"]
JOB_STATES = ["pending", "running", "completed", "failed", "cancelled"]
TERMINAL_STATES = ["completed", "failed", "cancelled"]


def type_table(spark: SparkSession, types: list[str] = ENTITY_TYPES) -> DataFrame:
    return spark.createDataFrame([(t,) for t in types], "type string")


def label_table(spark: SparkSession, labels: list[str] = RELATION_LABELS, undirected: list[str] = UNDIRECTED_LABELS) -> DataFrame:
    return spark.createDataFrame([(x, x not in undirected) for x in labels], "label string, directional boolean")
