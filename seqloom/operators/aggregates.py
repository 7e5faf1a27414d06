"""Column statistics of alignments: frequencies, information, profiles, composition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.columns import chars


def cells(rows: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """keys, pos (from 0), aa (upper case): one row per letter or gap."""
    return rows.select(*keys, F.posexplode(chars(F.upper(F.col(seq)))).alias("pos", "aa"))


def column_counts(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, pos, aa, n, total). Counts shrink to columns x letters before the exchange, however deep an alignment is."""
    n = cells(rows, [key], seq).groupBy(key, "pos", "aa").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy(key, "pos")))


def column_frequency(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Frequency of each letter among all rows of a column, X and gap counted below the line; X rows are dropped."""
    return column_counts(rows, key, seq).filter("aa <> 'X'").select(key, "pos", "aa", (F.col("n") / F.col("total")).alias("freq"))


def residue_frequency(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, pos, aa, p, gap): shares among the residues of a column, and the column's share of gaps."""
    w = Window.partitionBy(key, "pos")
    c = column_counts(rows, key, seq).withColumn("gaps", F.coalesce(F.sum(F.when(F.col("aa") == "-", F.col("n"))).over(w), F.lit(0)))
    return c.filter("aa <> '-'").select(key, "pos", "aa", (F.col("n") / (F.col("total") - F.col("gaps"))).alias("p"), (F.col("gaps") / F.col("total")).alias("gap"))


def column_information(rows: DataFrame, key: str, seq: str = "seq", letters: int = 20) -> DataFrame:
    """(key, pos, aa, information) = (log2(letters) - entropy) * p * (1 - gap)."""
    p = residue_frequency(rows, key, seq)
    entropy = F.sum(-F.col("p") * F.log2("p")).over(Window.partitionBy(key, "pos"))
    return p.withColumn("h", entropy).select(key, "pos", "aa", ((F.lit(letters * 1.0) * 0 + F.log2(F.lit(float(letters))) - F.col("h")) * F.col("p") * (1 - F.col("gap"))).alias("information"))


def profile(rows: DataFrame, key: str, seq: str = "seq", eps: float = 0.0) -> DataFrame:
    """Mean one-hot of each column over its rows; with eps, masked: gaps are out and eps is added below the line."""
    c = cells(rows, [key], seq)
    if eps:
        c = c.filter("aa <> '-'")
    n = c.groupBy(key, "pos", "aa").agg(F.count(F.lit(1)).alias("n"))
    return n.select(key, "pos", "aa", (F.col("n") / (F.sum("n").over(Window.partitionBy(key, "pos")) + eps)).alias("p"))


def cluster_profile(rows: DataFrame, assigned: DataFrame, key: str = "cluster", seq: str = "seq") -> DataFrame:
    """Per cluster and column the mean one-hot of its members and its centre: (n + centre) / (members + 1 + 1e-6).

    rows: row_id, seq of centres and members; assigned: row_id, cluster, is_centre.
    """
    joined = rows.join(assigned, "row_id")
    size = assigned.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    n = cells(joined, [key], seq).groupBy(key, "pos", "aa").agg(F.count(F.lit(1)).alias("n"))
    return n.join(size, key).select(key, "pos", "aa", (F.col("n") / (F.col("size") + 1e-6)).alias("p"))


def deletion_mean(rows: DataFrame, key: str, deletions: str = "deletions") -> DataFrame:
    return rows.select(key, F.posexplode(F.col(deletions)).alias("pos", "d")).groupBy(key, "pos").agg(F.avg("d").alias("deletion_mean"))


def gap_and_similarity(rows: DataFrame, msa: str = "msa_id", idx: str = "row_idx", seq: str = "seq") -> DataFrame:
    """Each row's share of gaps, and of columns that equal the query's."""
    query = rows.filter(F.col(idx) == 0).groupBy(msa).agg(F.min(F.upper(F.col(seq))).alias("__q"))
    same = F.zip_with(chars(F.upper(F.col(seq))), chars(F.col("__q")), lambda a, b: (a == b).cast("int"))
    n = F.length(seq)
    gaps = n - F.length(F.translate(F.col(seq), "-", ""))
    return rows.join(query, msa).withColumn("gap_share", gaps / n).withColumn("similarity", F.aggregate(same, F.lit(0), lambda a, x: a + x) / n).drop("__q")


def frequent_labels(df: DataFrame, label: str, least: int = 16) -> DataFrame:
    """Rows whose label occurs at least ``least`` times. The few frequent labels come from an aggregate, not a window."""
    keep = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least).select(label)
    return df.join(keep, label, "left_semi")
