"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, word_count

REPEATS = 3
#: Documents of mean size whose words the knapsack programme fits.
NEAR = 12


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0) -> DataFrame:
    """(source, source_size, target) per source. Sources by code point, null last, take the weights in turn and share
    `share` of all words; a target stops at REPEATS times its source's size and the excess is reshared by weight
    until none is above: target = min(cap, level * weight) with the one level that spends the budget.

    Works on one row per source; the windows order those rows, never documents.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w)
    per = per.withColumn("cap", F.col("source_size") * REPEATS).withColumn("turn", F.col("cap") / F.col("weight"))
    order = Window.orderBy("turn", "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(whole) * share - before) / open_weight)
    level = F.min(F.when(F.col("level") <= F.col("turn"), F.struct("turn", "rank", "level"))).over(whole)["level"]
    target = F.when(F.sum("source_size").over(whole) == 0, F.lit(0.0)).otherwise(F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, reserve: int | None = None) -> np.ndarray:
    """How many documents of each size to take so that their sizes sum to the budget, or as near below it as the
    bounded-knapsack programme reaches. All but `reserve` words (NEAR documents of mean size) are spread over the sizes
    in proportion; what is left is found exactly: each size's count is split into powers of two, sizes near the mean come
    first, and every reachable sum remembers its last item. The same rule holds at every size of budget."""
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    mean = total / int(counts[sizes > 0].sum())
    reserve = int(NEAR * mean) if reserve is None else reserve
    share, carry = max(0.0, (budget - reserve) / total), 0.0
    for i in np.argsort(-sizes, kind="stable"):
        if sizes[i] <= 0:
            continue
        carry += share * sizes[i] * counts[i]
        take[i] = min(int(carry // sizes[i]), counts[i])
        carry -= take[i] * sizes[i]
    left = budget - int((take * sizes).sum())
    last = np.full(left + 1, -1, np.int32)
    reach = np.zeros(left + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for i in np.argsort(np.abs(sizes - mean), kind="stable"):
        n, k = min(int(counts[i] - take[i]), left // int(sizes[i]) if sizes[i] > 0 else 0), 1
        while n > 0 and not reach[left]:
            k = min(k, n)
            step = k * int(sizes[i])
            new = np.flatnonzero(reach[:-step] & ~reach[step:]) + step
            last[new] = len(items)
            reach[new] = True
            items.append((int(i), k))
            n, k = n - k, 2 * k
        if reach[left]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, k = items[last[at]]
        take[i] += k
        at -= k * int(sizes[i])
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    whole, target = int((sizes * counts).sum()), float(pdf["target"].iloc[0])
    every = min(REPEATS, int(target // whole)) if whole else 0
    budget = int(round(target - every * whole)) if every < REPEATS else 0
    return pdf[["sid", "size"]].assign(every=every, extra=fit_budget(sizes, counts, budget) if whole else 0 * counts)


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), seed: int = 17, salts: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), with row_col that column as well: how often the mix takes each document.

    Documents are counted by exact word length per source; a target above a source's size takes whole rounds of it,
    and the remaining budget is fitted on that histogram (one row per length, so at most the longest text's words)
    by `fit_budget`. Which documents of a length fill its count is decided by a seeded hash of the id: lengths are
    cut into `salts` cells by that hash, whole cells are taken in turn, and only the documents of the last one are
    ranked, so that a length which a third of all rows share is still spread over many tasks.

    Null text has size 0 and is never taken; null sources form one source, the last; ties and repeated rows count
    one by one; an empty table gives an empty result. Other columns of docs are ignored. No document is taken more
    than REPEATS times. row_col, a unique number of the row, tells rows of one id apart and decides ties among them.
    """
    spark = docs.sparkSession
    tables = Stored(spark)
    unique = F.col(row_col) if row_col else F.monotonically_increasing_id()
    # The numeric key of a source stands in for its name, so that null sources join like any other.
    sid = F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), unique.alias("row"))
    sizes = sizes.withColumns({"sid": sid, "salt": F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(salts)), "turn": F.xxhash64(F.lit(seed + 1), F.col("doc_id"))})
    sizes = tables.put(sizes, "mix-sizes")
    targets = tables.put(source_targets(sizes, weights).withColumn("sid", sid), "mix-targets")
    cells = sizes.groupBy("sid", "size", "salt").agg(F.count("*").alias("n"))
    lengths = cells.groupBy("sid", "size").agg(F.sum("n").alias("n"))
    plan = lengths.join(targets.select("sid", "target"), "sid").groupBy("sid").applyInPandas(_plan, "sid long, size long, every int, extra long")
    in_turn = Window.partitionBy("sid", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("earlier", F.coalesce(F.sum("n").over(in_turn), F.lit(0))).join(plan, ["sid", "size"])
    more = F.least(F.greatest(F.col("extra") - F.col("earlier"), F.lit(0)), F.col("n"))
    cells = tables.put(cells.select("sid", "size", "salt", "every", "n", more.alias("more")).join(targets.select("sid", "source_size", "target"), "sid"), "mix-cells")
    # Only in the cell where a length's count runs out does it matter which document comes first.
    key = F.struct("turn", "doc_id", "row")
    partly = sizes.join(cells.filter("more > 0 and more < n").select("sid", "size", "salt", "more"), ["sid", "size", "salt"])
    rank = F.row_number().over(Window.partitionBy("sid", "size", "salt").orderBy("turn", "doc_id", "row"))
    border = partly.withColumn("rank", rank).filter("rank = more").select("sid", "size", "salt", key.alias("border"))
    out = sizes.join(cells.join(border, ["sid", "size", "salt"], "left"), ["sid", "size", "salt"])
    extra = F.when(F.col("more") == F.col("n"), 1).when(F.col("more") > 0, (key <= F.col("border")).cast("int")).otherwise(0)
    out = out.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("every") + extra))
    own = [F.col("row").alias(row_col)] if row_col else []
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *own)
