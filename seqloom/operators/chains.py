"""Rows of chains and targets: names, offsets, lists to keep or to skip, and look-ups by name or identifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.columns import safe_name


def unique_names(chains: DataFrame, name: str, target: str, order: str, out: str = "safe") -> DataFrame:
    """Names fit for paths; a one-letter name, and one that the target has used before, gets the target's name as well."""
    clean = chains.withColumn("__clean", safe_name(F.col(name)))
    again = F.row_number().over(Window.partitionBy(target, "__clean").orderBy(order)) > 1
    return clean.withColumn("__again", again | (F.length("__clean") == 1)).withColumn(out, F.when(F.col("__again"), F.concat_ws("_", "__clean", target)).otherwise(F.col("__clean"))).drop("__clean", "__again")


def residue_offsets(chains: DataFrame, target: str, order: Sequence[str], seq: str, gap: int = 200, out: str = "offset") -> DataFrame:
    """Where each chain's residue numbers begin if a target's chains are numbered through, with a gap between two."""
    w = Window.partitionBy(target).orderBy(*order)
    before = F.coalesce(F.sum(F.length(seq)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chains.withColumn(out, (gap * (F.row_number().over(w) - 1) + before).cast("long"))


def chain_numbers(index: Column, gap: int = 200) -> Column:
    """The inverse: for residue numbers that jump by at least ``gap`` between chains, the 0-based chain of each."""
    jump = lambda i: (F.get(index, i) - F.get(index, i - 1) >= gap).cast("int")
    zero = F.array().cast("array<int>")
    return F.aggregate(F.sequence(F.lit(0), F.size(index) - 1), zero, lambda acc, i: F.concat(acc, F.array(F.when(i == 0, 0).otherwise(F.element_at(acc, -1) + jump(i)).cast("int"))))


def chunks(rows: DataFrame, group: Sequence[str], order: Sequence[str], n: int, out: str = "chunk") -> DataFrame:
    """n chunks of each group, the first ones a row longer where it doesn't divide."""
    return rows.withColumn(out, F.ntile(n).over(Window.partitionBy(*group).orderBy(*order)))


def group_clonotypes(chains: DataFrame, clonotype: str, *values: Column) -> DataFrame:
    """One row for each clonotype with the given aggregates."""
    return chains.filter(F.col(clonotype).isNotNull()).groupBy(clonotype).agg(*values)


def skip_existing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """What isn't there yet."""
    return wanted.join(there.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def keep_listed(chains: DataFrame, key: Column, listed: DataFrame, name: str) -> DataFrame:
    """Rows whose key is in a list."""
    return chains.withColumn("__key", key).join(listed.select(F.col(name).alias("__key")).distinct(), "__key", "left_semi").drop("__key")


def with_clonotypes(chains: DataFrame, clonotypes: DataFrame, on: Sequence[str], order: str, out: str = "last_clonotype") -> DataFrame:
    """Chains with the clonotype of their name, the last one of several."""
    last = clonotypes.filter("clonotype is not null").groupBy(*on).agg(F.max_by("clonotype", order).alias(out))
    return chains.join(last, list(on))


def with_release_date(hits: DataFrame, identifier: Column, dates: DataFrame, cutoff: Column) -> DataFrame:
    """Hits with the release date of their structure (dates: id in any case, release_date) and whether it passes; a missing date does."""
    first = dates.groupBy(F.lower("id").alias("__id")).agg(F.min("release_date").alias("release_date"))
    met = hits.withColumn("__id", F.lower(identifier)).join(first, "__id", "left").drop("__id")
    return met.withColumn("passes", F.coalesce(F.col("release_date") <= cutoff, F.lit(True)))


def target_lengths(chains: DataFrame, target: str, seq: str) -> DataFrame:
    """Residues of each target, by which targets are put in order."""
    return chains.groupBy(target).agg(F.coalesce(F.sum(F.length(seq)), F.lit(0)).alias("length"))


def prepend_query(rows: DataFrame, queries: DataFrame, key: str, idx: str = "row_idx") -> DataFrame:
    """Rows of alignments after their query, which is row 0."""
    return queries.withColumn(idx, F.lit(0).cast(rows.schema[idx].dataType)).unionByName(rows.withColumn(idx, (F.col(idx) + 1).cast(rows.schema[idx].dataType)))
