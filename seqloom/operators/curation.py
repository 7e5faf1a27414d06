"""Training-set curation: filters, keep probabilities, caches, mixture draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.columns import largest_share
from seqloom.operators.sampling import _draw


def quality_filter(chains: DataFrame, seq: str = "seq", resolution: str = "resolution", worst: float = 9.0, most_share: float = 0.8) -> DataFrame:
    """Resolution at most ``worst`` or unknown, and no residue with more than ``most_share`` of the sequence."""
    return chains.filter((F.col(resolution).isNull() | (F.col(resolution) <= worst)) & (largest_share(F.col(seq)) <= most_share))


def complex_filter(structures: DataFrame, seqs: str = "seqs", resolution: str = "resolution", worst: float = 9.0, least_length: int = 200, most_share: float = 0.8) -> DataFrame:
    """Known resolution, enough residues in all, only the twenty residues, and no share above the limit in any chain."""
    total = F.aggregate(seqs, F.lit(0), lambda s, x: s + F.length(x))
    return structures.filter((F.col(resolution) <= worst) & (total >= least_length) & F.forall(seqs, lambda s: s.rlike("^[ACDEFGHIKLMNPQRSTVWY]+$")) & F.forall(seqs, lambda s: largest_share(s) <= most_share))


def keep_probability(length: Column, cluster_size: Column) -> Column:
    """(1 / cluster size, where it is positive) x length clipped to 256..512, over 512."""
    base = F.when(cluster_size > 0, 1.0 / cluster_size).otherwise(F.lit(1.0))
    return base * F.greatest(F.lit(256), F.least(F.lit(512), length)) / 512.0


def stochastic_keep(df: DataFrame, probability: Column, key: str, seed: int) -> DataFrame:
    return df.filter(_draw(seed, key) < probability)


def structure_cache(chains: DataFrame, file_id: str = "file_id") -> DataFrame:
    """One row per file: chain ids and sequences in order, and their number. A file is bounded by its chains."""
    line = F.sort_array(F.collect_list(F.struct("chain_ord", "chain", "seq")))
    return chains.groupBy(file_id).agg(line.alias("l")).select(file_id, F.transform("l", lambda x: x["chain"]).alias("chain_ids"), F.transform("l", lambda x: x["seq"]).alias("seqs"), F.size("l").alias("no_chains"))


def cluster_sizes(lines: DataFrame, line: str = "value") -> DataFrame:
    """(chain_id, cluster_size) from a file with one cluster of blank-separated members a line."""
    members = F.filter(F.split(F.lower(F.trim(F.col(line))), r"\s+"), lambda m: m != "")
    return lines.select(F.explode(members).alias("chain_id"), F.size(members).alias("cluster_size"))


def chain_cache(chains: DataFrame, sizes: DataFrame) -> DataFrame:
    """Chains with the size of their cluster, -1 if they are in none."""
    return chains.join(sizes, "chain_id", "left").withColumn("cluster_size", F.coalesce("cluster_size", F.lit(-1)))


def mixture_draws(n: int, weights: list[tuple[str, float]], spark, seed: int) -> DataFrame:
    """(draw, dataset): n draws of a dataset by weight, with replacement."""
    total, low, pick = sum(w for _, w in weights), 0.0, F.lit(weights[-1][0])
    edges = []
    for name, w in weights:
        low += w / total
        edges.append((name, low))
    for name, edge in reversed(edges):
        pick = F.when(F.col("u") < edge, name).otherwise(pick)
    return spark.range(n).withColumnRenamed("id", "draw").withColumn("u", _draw(seed, "draw")).select("draw", pick.alias("dataset"))
