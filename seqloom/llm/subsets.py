"""Varied subsets by systematic selection along a Hilbert curve.

Rows become points (signed projections of their columns, scaled so that no statistic of the data is needed), points
become cells of a grid, and cells are put in the order of the Hilbert curve through the grid, so that neighbours on the
curve are similar rows. There are two curves, one inside the other: the coarse cell of a row is that of the densest row
of its group of related rows, the fine one its own. The distinct cells of all alignments are sorted globally; evenly
spaced ones are chosen, and each gives its best record. Every coarse cell gives one fine cell before any gives a second, and
what is left is dealt evenly, so that a large group cannot crowd out the rest. Groups come into it only by where they
are: two of them in one coarse cell would share its places (60 bits make that unlikely, not impossible).

Places on the curve are found by a sort in range partitions and the counts of those before: no window holds more than a partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.related import encode
from seqloom.session import materialize

#: Dimensions of the grid and bits of each: 60-bit curve keys.
DIMS, BITS = 6, 10


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows x dims, each below 2**bits), by Gray-code correction."""
    x = points.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[:, i] & q) > 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, dims - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def grid_points(seqs: list[str], dims: int = DIMS, bits: int = BITS, seed: int = 5) -> np.ndarray:
    """Quantised projections: each (column, letter) has a fixed random direction; a row's sum is scaled by its letters."""
    codes = encode(seqs)
    width = codes.shape[1]
    table = np.random.default_rng(seed).standard_normal((max(width, 1), 27, dims)).astype(np.float32)
    table[:, 0] = 0
    total = np.zeros((len(seqs), dims), np.float32)
    for j in range(width):
        total += table[j][codes[:, j]]
    z = total / np.sqrt(np.maximum((codes > 0).sum(1), 1))[:, None]
    share = 0.5 * (1 + np.tanh(0.7978845608 * (z + 0.044715 * z**3)))  # the normal distribution function, closely
    return np.clip((share * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)


@F.pandas_udf(T.LongType())
def curve_key(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Curve key of a text; one without letters has no place and gets a hash of the number given with it."""
    for texts, number in batches:
        seqs = [s or "" for s in texts]
        if not seqs:
            yield pd.Series([], dtype="int64")
            continue
        key = hilbert_key(grid_points(seqs), BITS)
        void = ~(encode(seqs) > 0).any(1)
        mixed = (number.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIMS * BITS)
        yield pd.Series(np.where(void, mixed.astype(np.int64), key), dtype="int64")


def ranked(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """df with the 0-based place of each row in its group; the order must be total. Groups may be of any size."""
    keys = [group, *order]
    line = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()), "ranked")
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = line.groupBy("__part", group).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    here = F.row_number().over(Window.partitionBy("__part", group).orderBy(*order))
    return line.withColumn("__here", here).join(counts, ["__part", group]).withColumn(name, F.col("__here") - 1 + F.col("__before")).drop("__part", "__here", "__before")


def _evenly(place: F.Column, wanted: F.Column, all_of: F.Column) -> F.Column:
    """Whether a place (from 0) is among ``wanted`` evenly spaced ones of ``all_of``: those with which a running share
    passes a whole number."""
    return F.floor((place + 1) * wanted / all_of) > F.floor(place * wanted / all_of)


def choose(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """(msa_id, row_id, group_id, group_rows, cell): the chosen rows of every alignment in requests.

    rows has row_id, msa_id, seq, group_id, density and turn, as related.row_groups gives them; requests has msa_id
    (unique) and subset_size. Chosen are exactly min(subset_size, rows of the alignment) rows; a null or non-positive
    size, or an alignment without rows, gives none. If there are at least as many places as groups, every group is
    present. The best record of a fine cell has the fewest gaps, then the smallest row_id. Rows that repeat share a cell
    and are taken only when cells run out. Other columns don't matter.
    """
    wanted = requests.filter("msa_id is not null and subset_size > 0").select("msa_id", F.col("subset_size").cast("long").alias("k"))
    asked = rows.join(wanted.select("msa_id"), "msa_id", "left_semi").select("msa_id", "row_id", "seq", "group_id", "density", "turn")
    densest = F.min_by("seq", F.struct("turn", -F.col("density"), "row_id"))
    groups = asked.groupBy("msa_id", "group_id").agg(densest.alias("rep_seq"), F.count(F.lit(1)).alias("group_rows"))
    groups = groups.withColumn("cell", curve_key("rep_seq", "group_id")).drop("rep_seq")
    n_gaps = F.length("seq") - F.length(F.regexp_replace("seq", "[^A-Za-z]", ""))
    placed = materialize(asked.withColumn("fine", curve_key("seq", "row_id")).withColumn("n_gaps", F.coalesce(n_gaps, F.lit(0))).drop("seq", "density", "turn").join(groups, ["msa_id", "group_id"]), "placed")
    best = F.min(F.struct("n_gaps", "row_id", "group_id", "group_rows")).alias("best")
    points = ranked(placed.groupBy("msa_id", "cell", "fine").agg(best), "msa_id", ["cell", "fine"], "at")
    cells = points.groupBy("msa_id", "cell").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("m"))
    cells = materialize(cells, "cells")
    # cells by size: those no larger than an even share are used up, the rest share what is left. One row for each size.
    up = Window.partitionBy("msa_id").orderBy("m")
    sizes = cells.groupBy("msa_id", "m").agg(F.count(F.lit(1)).alias("c")).withColumn("n_cells", F.sum("c").over(Window.partitionBy("msa_id"))).withColumn("upto", F.sum(F.col("m") * F.col("c")).over(up)).withColumn("larger", F.col("n_cells") - F.sum("c").over(up))
    fits = F.col("upto") + F.col("m") * F.col("larger") <= F.col("k")
    level = sizes.join(wanted, "msa_id").withColumn("fits", fits).groupBy("msa_id").agg(
        F.first("k").alias("k"), F.first("n_cells").alias("n_cells"), F.sum(F.col("m") * F.col("c")).alias("n_points"),
        *[F.coalesce(f(F.when(F.col("fits"), F.col(x))), F.lit(0)).alias(y) for f, x, y in ((F.max, "m", "full"), (F.max, "upto", "used"), (F.sum, "c", "n_full"))],
    )
    rest, left = F.col("n_cells") - F.col("n_full"), F.col("k") - F.col("used")
    level = level.withColumn("rest", rest).withColumn("even", F.when(rest > 0, F.floor(left / rest)).otherwise(0)).withColumn("spare", F.when(rest > 0, left - F.col("even") * rest).otherwise(0))
    level = materialize(level, "level")
    known = cells.join(level.drop("n_cells", "n_points", "used", "n_full"), "msa_id")
    partly = ranked(known.filter("m > full").select("msa_id", "cell", "start", "m", "even", "spare", "rest"), "msa_id", ["cell"], "along")
    quotas = partly.select("msa_id", "cell", "start", "m", (F.col("even") + _evenly(F.col("along"), F.col("spare"), F.col("rest")).cast("long")).alias("quota"))
    quotas = quotas.unionByName(known.filter("m <= full").select("msa_id", "cell", "start", "m", F.col("m").alias("quota"))).filter("quota > 0")
    # the middles of quota equal stretches of a cell's m fine cells
    place = F.col("at") - F.col("start")
    guess = F.floor((2 * place * F.col("quota") + F.col("m")) / (2 * F.col("m")))
    middle = lambda s: F.floor((2 * s + 1) * F.col("m") / (2 * F.col("quota"))) == place
    first = points.join(quotas, ["msa_id", "cell"]).filter(middle(guess - 1) | middle(guess) | middle(guess + 1))
    first = first.select("msa_id", "best.row_id", "best.group_id", "best.group_rows", "cell")
    short = level.filter("k > n_points").select("msa_id", (F.col("k") - F.col("n_points")).alias("lack"))
    if not short.limit(1).count():
        return first
    # fewer distinct fine cells than places: all are taken, and evenly spaced ones of the remaining rows fill up
    first = materialize(first, "first")
    again = ranked(placed.join(short, "msa_id").join(first.select("row_id"), "row_id", "left_anti"), "msa_id", ["cell", "fine", "row_id"], "at")
    again = again.join(again.groupBy("msa_id").agg(F.count(F.lit(1)).alias("n")), "msa_id").filter(_evenly(F.col("at"), F.least("lack", "n"), F.col("n")))
    return first.unionByName(again.select("msa_id", "row_id", "group_id", "group_rows", "cell"))
