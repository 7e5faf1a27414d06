"""What is done around alignments, templates and structures before they become features: naming, stubs, padding, masks,
spatial crops, selection, cleanup and merging of outputs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.columns import chars

# Fixed value: the accession under which paired rows are named.
PAIR_ACCESSION = "A0A8T2NDK6"


def pair_names(number: Column) -> Column:
    """The name of the pair of that number: its number is what pairs its rows again."""
    n = number.cast("string")
    return F.concat(F.lit(f">tr|{PAIR_ACCESSION}|{PAIR_ACCESSION}_"), n, F.lit("/H"), n, F.lit("-L"), n)


def stub_alignment(chains: DataFrame, key: str, seq: str, copies: Column, out: str = "row_idx") -> DataFrame:
    """Chains without an alignment as ``copies`` rows of their own sequence, numbered from 0."""
    return chains.withColumn(out, F.explode(F.sequence(F.lit(0), copies - 1))).select(key, out, seq)


def striding_mask(seq: Column, row: Column, size: int, stride: int) -> Column:
    """The text with a window of ``size`` gaps that begins a stride further in each row, and at the front again after the end."""
    n = F.length(seq)
    start = (row * stride) % F.greatest(n - size + 1, F.lit(1))
    return F.concat(F.substring(seq, F.lit(1), start.cast("int")), F.repeat(F.lit("-"), F.least(n, F.lit(size))), F.substring(seq, (start + size + 1).cast("int"), n))


def random_mask(seq: Column, key: Column, k: int, seed: int) -> Column:
    """The text with k positions, drawn by a hash of seed and key, as X."""
    n = F.length(seq)
    order = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), i.alias("i"))))
    hit = F.transform(F.slice(order, 1, k), lambda x: x["i"])
    masked = F.transform(F.array(hit), lambda h: F.array_join(F.transform(chars(seq), lambda c, i: F.when(F.array_contains(h, i), "X").otherwise(c)), ""))  # one draw, not one for each position
    return F.when(n > 0, F.get(masked, F.lit(0))).otherwise(seq)


def pad_rows(rows: DataFrame, keys: DataFrame, key: str, place: str, most: int, values: dict[str, Column]) -> DataFrame:
    """Exactly ``most`` rows for each key (keys: one column): the first ones by ``place``, and padding of the given values
    with ``is_padding``. place is numbered from 0."""
    kept = rows.filter(F.col(place) < most).select(key, place, *values, F.lit(False).alias("is_padding"))
    every = keys.select(key).withColumn(place, F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    missing = every.join(kept.select(key, place), [key, place], "left_anti")
    return kept.unionByName(missing.select(key, place, *[v.alias(n) for n, v in values.items()], F.lit(True).alias("is_padding")))


def fixed_size(array: Column, size: int, fill: Column) -> Column:
    """An array cut or padded to exactly a size."""
    return F.concat(F.slice(array, 1, size), F.array_repeat(fill, F.greatest(F.lit(size) - F.size(array), F.lit(0))))


def blank_region(array: Column, start: Column, end: Column, fill: Column) -> Column:
    """An array with the half-open range replaced by a value."""
    return F.transform(array, lambda x, i: F.when((i >= start) & (i < end), fill).otherwise(x))


def spatial_crop(atoms: DataFrame, structure: Sequence[str], residue: str, centre: DataFrame, size: int) -> DataFrame:
    """The ``size`` residues of each structure nearest to its centre (structure and cx, cy, cz); ties by residue. ``distance`` is kept."""
    d = F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0)))
    near = atoms.join(centre, list(structure)).withColumn("distance", d)
    order = Window.partitionBy(*structure).orderBy(F.round("distance", 9), residue)
    return near.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= size).drop("__n", "cx", "cy", "cz")


def crop_budget(lengths: Column, size: int) -> Column:
    """Residues that each chain of a target keeps if chains are served in order until ``size`` residues are given out."""
    zero = F.struct(F.lit(size).alias("left"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        got = F.least(n, acc["left"])
        return F.struct((acc["left"] - got).alias("left"), F.concat(acc["out"], F.array(got)).alias("out"))

    return F.aggregate(lengths, zero, step)["out"]


def first_passing(df: DataFrame, keep: Column, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows that pass, in order: what one epoch takes."""
    return df.filter(keep).orderBy(*order).limit(n)


def clean_atoms(atoms: DataFrame, chain: Sequence[str], residue: str, residues: Sequence[str]) -> DataFrame:
    """Atoms of the known residue types only, modified methionine as methionine, without chains of a single residue."""
    aa = F.when(F.col("aa") == "MSE", "MET").otherwise(F.col("aa"))
    atom = F.when((F.col("aa") == "MSE") & (F.col("atom") == "SE"), "SD").otherwise(F.col("atom"))
    known = atoms.withColumns({"aa": aa, "atom": atom}).filter(F.col("aa").isin(list(residues)))
    long = known.groupBy(*chain).agg((F.min(residue) != F.max(residue)).alias("__long")).filter("__long").drop("__long")
    return known.join(long, list(chain), "left_semi")


def structure_features(structures: DataFrame, default_date: str = "2010-01-01") -> DataFrame:
    """Chains of structures with length and release date; a missing date is the default."""
    chain = structures.select("file_id", F.coalesce("release_date", F.lit(default_date).cast("date")).alias("release_date"), F.coalesce("resolution", F.lit(0.0)).alias("resolution"), F.posexplode(F.arrays_zip("chain_ids", "seqs")).alias("chain_index", "z"))
    return chain.select("file_id", "release_date", "resolution", "chain_index", F.col("z.chain_ids").alias("chain"), F.col("z.seqs").alias("seq"), F.length("z.seqs").alias("seq_length"))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Outputs of a run merged into earlier ones: a new row replaces that of its key."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def protein_chains(monomers: DataFrame, types: DataFrame, chains: DataFrame) -> DataFrame:
    """(file_id, chain) of chains whose entity has a peptide monomer.

    monomers: file_id, entity, monomer; types: file_id, monomer, type; chains: file_id, entity, chain.
    """
    peptide = monomers.join(types, ["file_id", "monomer"]).groupBy("file_id", "entity").agg(F.bool_or(F.lower("type").contains("peptide")).alias("peptide")).filter("peptide")
    return chains.join(peptide, ["file_id", "entity"], "left_semi").select("file_id", "chain").distinct()


def knee(values: np.ndarray) -> int:
    """Where a rising curve bends: the place farthest from the line between its ends."""
    y = np.sort(np.asarray(values, float))
    if len(y) < 3 or y[-1] == y[0]:
        return len(y) - 1
    x = np.linspace(0, 1, len(y))
    return int((x - (y - y[0]) / (y[-1] - y[0])).argmax())


def nearest_distances(pairs: DataFrame, a: str, b: str, distance: str, k: int) -> DataFrame:
    """(key, distance) to the k-th nearest other row; pairs holds each pair once."""
    both = pairs.select(F.col(a).alias("key"), F.col(b).alias("other"), distance).unionByName(pairs.select(F.col(b).alias("key"), F.col(a).alias("other"), distance))
    order = Window.partitionBy("key").orderBy(distance, "other")
    return both.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") == k).select("key", distance)
