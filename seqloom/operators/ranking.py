"""Ranks, reorderings and top-k reports with full tie-breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.columns import weighted_hamming
from seqloom.session import materialize

#: Rows that one window may hold. Larger groups are put in order over several tasks; the result is the same.
WINDOW_ROWS = 2_000_000


def place_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with the 0-based place of each row in its group, ascending; the order must be total.

    If a group has more than WINDOW_ROWS rows, the table is sorted in range partitions and written, and a row's place is
    its place in its partition and the rows of its group in earlier ones.
    """
    most = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= WINDOW_ROWS:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    keys = [*group, *order]
    line = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()), "line")
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = line.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    here = F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order)) - 1
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("__part", *group)]
    met = line.withColumn("__here", here).alias("l").join(counts.alias("c"), same)
    return met.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], (F.col("l.__here") + F.col("c.__before")).cast("int").alias(name))


def competition_rank(df: DataFrame, group: Sequence[str], value: str, name: str = "rank", descending: bool = True) -> DataFrame:
    """0-based rank: how many rows of the group are strictly better.

    Counted from the distinct values of a group and their rows, so that equal values shrink before the exchange.
    """
    up = Window.partitionBy(*group).orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, -1)
    values = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n")).withColumn(name, F.coalesce(F.sum("__n").over(up), F.lit(0)).cast("int")).drop("__n")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*group, value)]
    return df.alias("l").join(values.alias("r"), same).select("l.*", F.col(f"r.{name}").alias(name))


def ranking_metric(h_cdr3: Column, h_cdr1: Column, h_cdr1_len: Column, everything: Column) -> Column:
    """Mean confidence of the heavy CDR3; with a CDR1 longer than 12 the mean of both; without a CDR3 the global mean."""
    return F.when(h_cdr3.isNull(), everything).when(h_cdr1_len > 12, (h_cdr1 + h_cdr3) / 2).otherwise(h_cdr3)


# Weights of FRONT, FR1, CDR1, FR2, CDR2, FR3, CDR3, FR4, BACK when rows are ordered by likeness.
REGION_WEIGHTS = {"H": [0, 0, 1, 1, 1, 1, 3, 1, 0], "L": [0, 0, 1, 1, 1, 1, 1, 1, 0]}


def region_weights(lengths: Column, chain_type: Column, others: float = 1.0) -> Column:
    """Weight of each position from region lengths (nine, FRONT to BACK); chains of other types weigh ``others`` everywhere.

    That is 1 for an alignment of one chain. Of several chains' weights, laid end to end, it must be 0: where a whole
    target weighs 0, reorder_by_likeness takes all positions alike.
    """
    table = F.when(chain_type == "H", F.array(*[F.lit(float(w)) for w in REGION_WEIGHTS["H"]])).when(chain_type == "L", F.array(*[F.lit(float(w)) for w in REGION_WEIGHTS["L"]])).otherwise(F.array(*[F.lit(others)] * 9))
    return F.flatten(F.zip_with(lengths, table, lambda n, w: F.array_repeat(w, n.cast("int"))))


def reorder_by_likeness(rows: DataFrame, weights: DataFrame, block: Sequence[str], order: str, seq: str = "seq", name: str = "place") -> DataFrame:
    """Rows of each block in stable order of weighted distance to the block's first row: ``distance`` and ``place``.

    weights: block columns and an array ``weights``; all-zero weights count as all ones. The distance is one expression
    per row; the order is only materialised as a number.
    """
    first = rows.groupBy(*block).agg(F.min_by(F.upper(F.col(seq)), F.col(order)).alias("__q"))
    none = ~F.exists("weights", lambda w: w != 0)
    used = F.when(none, F.transform("weights", lambda _: F.lit(1.0))).otherwise(F.col("weights"))
    measured = rows.join(first.join(weights, list(block)).withColumn("weights", used), list(block))
    measured = measured.withColumn("distance", weighted_hamming(F.upper(F.col(seq)), F.col("__q"), F.col("weights"))).drop("__q", "weights")
    measured = measured.withColumn("__far", F.coalesce("distance", F.lit(float("inf"))))
    return place_in_group(measured, block, ["__far", order], name).drop("__far")


def top_then_filter(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, keep: Column) -> DataFrame:
    """The first k rows of each group, of which those that pass the filter: the index keeps its gaps."""
    return df.withColumn("index", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("index") <= k).filter(keep)


def distinct_top(df: DataFrame, group: Sequence[str], distinct: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group with different values of ``distinct``."""
    once = df.withColumn("__d", F.row_number().over(Window.partitionBy(*group, distinct).orderBy(*order))).filter("__d = 1").drop("__d")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= k)
