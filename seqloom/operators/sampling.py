"""Deterministic strides, quotas and seeded random samples of alignment rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.columns import contiguous_bucket
from seqloom.operators.ranking import place_in_group


def _draw(seed: int, *key: str) -> Column:
    """A number in (0, 1) hashed from seed and key: the same on every run and every partitioning."""
    return (F.xxhash64(F.lit(seed), *key).bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / F.lit(float(1 << 53))


def strided_sample(rows: DataFrame, block: Sequence[str], order: Sequence[str], buckets: int, turn: int, turns: int, shift: int = 0) -> DataFrame:
    """One row per contiguous bucket of each block; in turn t the one at min((n // max(turns - 1, 1)) * t + shift, n - 1).

    Once t is at least a bucket's size its last row is taken; the first pick is row 0; empty buckets give nothing.
    """
    size = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("__n"))
    r = place_in_group(rows, block, order, "__r").join(size, list(block))
    r = r.withColumn("bucket", contiguous_bucket(F.col("__r"), F.col("__n"), F.lit(buckets)))
    # bucket i begins at floor(i n / k), so nothing has to be counted again
    begin = lambda i: F.floor(i * F.col("__n") / buckets)
    r = r.withColumn("__m", begin(F.col("bucket") + 1) - begin(F.col("bucket"))).withColumn("__p", F.col("__r") - begin(F.col("bucket")))
    at = F.when(F.lit(turn) >= F.col("__m"), F.col("__m") - 1).otherwise(F.least(F.floor(F.col("__m") / max(turns - 1, 1)) * turn + shift, F.col("__m") - 1))
    at = F.when(F.col("__r") == F.col("__p"), 0).otherwise(at)  # the first bucket that has rows
    return r.filter(F.col("__p") == at).drop("__r", "__n", "__m", "__p")


def quota_sample(rows: DataFrame, target: str, cluster: str, order: str, most: int, first: int = 512) -> DataFrame:
    """At most ``most`` rows of each target, shared out over clusters from small to large, middle rows of equal stretches.

    The i-th of m clusters gets min(its size, (most - taken so far) // (m - i)) rows; of each cluster only its first
    ``first`` rows count. Cluster sizes are one row per cluster, so the running quota is computed on a small table.
    """
    w = Window.partitionBy(target, cluster).orderBy(order)
    r = rows.withColumn("__p", F.row_number().over(w) - 1).filter(F.col("__p") < first)
    sizes = r.groupBy(target, cluster).agg(F.count(F.lit(1)).cast("int").alias("__n"), F.min(order).alias("__first"))
    line = sizes.groupBy(target).agg(F.sort_array(F.collect_list(F.struct("__n", "__first", cluster))).alias("line"))
    zero = F.struct(F.lit(0).alias("taken"), F.array().cast("array<int>").alias("quota"))

    def step(acc: Column, x: Column) -> Column:
        got = F.least(x["__n"], F.floor((F.lit(most) - acc["taken"]) / (F.size("line") - F.size(acc["quota"])))).cast("int")
        return F.struct((acc["taken"] + got).alias("taken"), F.concat(acc["quota"], F.array(got)).alias("quota"))

    shared = line.withColumn("quota", F.aggregate("line", zero, step)["quota"]).select(target, F.explode(F.arrays_zip("line", "quota")).alias("z"))
    quota = shared.select(target, F.col(f"z.line.{cluster}").alias(cluster), F.col("z.quota").alias("__q")).filter("__q > 0")
    size = sizes.select(target, cluster, "__n")
    r = r.join(size, [target, cluster]).join(quota, [target, cluster])
    # stretches with the larger ones first: n = q * k + rest, the first `rest` have one row more
    k, rest = F.floor(F.col("__n") / F.col("__q")).cast("int"), F.col("__n") % F.col("__q")
    long = F.col("__p") < rest * (k + 1)
    start = F.when(long, F.floor(F.col("__p") / (k + 1)) * (k + 1)).otherwise(rest * (k + 1) + F.floor((F.col("__p") - rest * (k + 1)) / k) * k)
    size_of = F.when(long, k + 1).otherwise(k)
    return r.filter(F.col("__p") == start + F.floor(size_of / 2)).drop("__p", "__n", "__q")


def uniform_sample(rows: DataFrame, block: Sequence[str], idx: str, n: int, seed: int) -> DataFrame:
    """Row 0 and n - 1 further rows of each block, without replacement; ``is_extra`` marks the remainder."""
    w = Window.partitionBy(*block).orderBy(F.desc(F.col(idx) == 0), "__u", idx)
    drawn = rows.withColumn("__u", _draw(seed, *block, idx))
    return drawn.withColumn("is_extra", F.row_number().over(w) > n).drop("__u")


def gumbel_order(rows: DataFrame, block: Sequence[str], idx: str, logit: Column, seed: int) -> DataFrame:
    """Rows in the order of logit plus Gumbel noise: ``place``; row 0 is first."""
    noisy = rows.withColumn("__g", logit - F.log(-F.log(_draw(seed, *block, idx))))
    return noisy.withColumn("place", F.row_number().over(Window.partitionBy(*block).orderBy(F.desc(F.col(idx) == 0), F.desc("__g"), idx)) - 1).drop("__g")


def masked_cells(cells: DataFrame, keys: Sequence[str], profile: DataFrame, on: Sequence[str], seed: int, share: float = 0.15, uniform: float = 0.1, from_profile: float = 0.1, same: float = 0.1, letters: str = "ARNDCQEGHILKMFPSTWYV") -> DataFrame:
    """Masked-alignment corruption of (keys, pos, aa) cells: ``corrupt`` is what a model sees.

    A cell is touched with probability ``share`` and becomes a uniform letter, a draw from its column's profile
    (``on`` joins cells to rows of letter ``aa`` and probability ``p``), stays, or becomes '#'.
    """
    up_to = Window.partitionBy(*on).orderBy("aa")
    table = profile.withColumn("__c", F.sum("p").over(up_to)).groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("__c", "aa"))).alias("__t"))
    c = cells.withColumn("__u", _draw(seed, *keys, "pos")).withColumn("__v", _draw(seed + 1, *keys, "pos")).withColumn("__w", _draw(seed + 2, *keys, "pos"))
    drawn = F.coalesce(F.element_at(F.filter("__t", lambda x: x["__c"] >= F.col("__w")), 1)["aa"], F.col("aa"))
    any_letter = F.substring(F.lit(letters), (F.floor(F.col("__w") * len(letters)) + 1).cast("int"), F.lit(1))
    kind = F.when(F.col("__v") < uniform, any_letter).when(F.col("__v") < uniform + from_profile, drawn).when(F.col("__v") < uniform + from_profile + same, F.col("aa")).otherwise("#")
    return c.join(table, list(on), "left").withColumn("corrupt", F.when(F.col("__u") < share, kind).otherwise(F.col("aa"))).drop("__u", "__v", "__w", "__t")


def delete_blocks(rows: DataFrame, group: Sequence[str], idx: str, share: float = 0.3, blocks: int = 5, seed: int = 5) -> DataFrame:
    """Rows without ``blocks`` runs of row numbers, each ``share`` of the group long, that begin at hashed places; row 0 stays.

    Runs may overlap. A run is a pair of numbers, so only the size of a group is joined to its rows.
    """
    size = rows.groupBy(*group).agg((F.max(idx) + 1).alias("__n"))
    start = lambda k: F.floor(_draw(seed + k, *group) * F.col("__n"))
    long = F.floor(F.col("__n") * share)
    hit = F.lit(False)
    for k in range(blocks):
        hit = hit | F.col(idx).between(start(k), start(k) + long - 1)
    return rows.join(size, list(group)).filter((F.col(idx) == 0) | ~hit).drop("__n")
