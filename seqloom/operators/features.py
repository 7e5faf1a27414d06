"""Model features of sequences and alignments as array columns, and the row operations around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.columns import chars, deletion_value, has_deletion, one_hot, residue_codes
from seqloom.operators.sampling import _draw

# Names of chains in a structure file, at most 62.
CHAIN_NAMES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def sequence_features(df: DataFrame, seq: str) -> DataFrame:
    """aatype, residue_index (from 0), length and the mask of ones."""
    n = F.length(seq)
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("aatype", residue_codes(F.col(seq))).withColumn("residue_index", index).withColumn("seq_length", n).withColumn("seq_mask", F.array_repeat(F.lit(1.0), n))


def target_features(codes: Column, n: int = 21) -> Column:
    """Per residue the flag 'between segments' (0) and a one-hot of n classes."""
    return F.transform(one_hot(codes, n), lambda v: F.concat(F.array(F.lit(0)), v))


def alignment_features(codes: Column, deletions: Column, n: int = 23) -> Column:
    """Per column: one-hot, has_deletion, deletion_value."""
    extra = F.arrays_zip(has_deletion(deletions).alias("h"), deletion_value(deletions).alias("v"))
    return F.zip_with(one_hot(codes, n), extra, lambda hot, x: F.concat(F.transform(hot, lambda i: i.cast("double")), F.array(x["h"].cast("double"), x["v"])))


def profile_arrays(rows: DataFrame, msa: str = "msa_id", seq: str = "seq", deletions: str = "deletions", n: int = 23) -> DataFrame:
    """(msa, profile, deletion_mean): for each column of an alignment the shares of n residue codes among its rows and the
    mean deletion (rows without deletions count as none there). Counted by column and code before anything is gathered."""
    size = rows.groupBy(msa).agg(F.count(F.lit(1)).alias("__rows"), F.sum(F.col(deletions).isNotNull().cast("int")).alias("__known"))
    cell = F.posexplode(F.arrays_zip(residue_codes(F.col(seq)).alias("c"), F.coalesce(F.col(deletions), F.array().cast("array<int>")).alias("d"))).alias("pos", "x")
    counts = rows.select(msa, cell).groupBy(msa, "pos", F.col("x.c").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("x.d"), F.lit(0)).alias("d"))
    column = counts.groupBy(msa, "pos").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("held"), F.sum("d").alias("d"))  # at most n codes
    shares = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("held", k), F.lit(0)) / (F.col("__rows") + 1e-6))
    line = column.join(size, msa).select(msa, F.struct("pos", shares.alias("p"), F.when(F.col("__known") > 0, F.col("d") / F.col("__known")).otherwise(0.0).alias("m")).alias("s"))
    held = line.groupBy(msa).agg(F.array_sort(F.collect_list("s")).alias("line"))  # one entry for each column
    return held.select(msa, F.transform("line", lambda x: x["p"]).alias("profile"), F.transform("line", lambda x: x["m"]).alias("deletion_mean"))


def full_alignment_features(own: Column, profile: Column, deletion_mean: Column) -> Column:
    """alignment_features with the column's profile and its mean deletion: 49 channels for each column."""
    return F.zip_with(F.zip_with(own, profile, lambda a, b: F.concat(a, b)), deletion_value(deletion_mean), lambda a, m: F.concat(a, F.array(m)))


def argmax(array: Column) -> Column:
    return F.array_position(array, F.array_max(array)) - 1


def pad_to(array: Column, multiple: int, fill: Column) -> Column:
    """An array padded to the next multiple of a length."""
    size = (F.ceil(F.size(array) / multiple) * multiple).cast("int")
    return F.concat(array, F.array_repeat(fill, size - F.size(array)))


def shift_regions(intervals: Column, by: Column) -> Column:
    return F.transform(intervals, lambda r: F.struct((r["s"] + by).cast("int").alias("s"), (r["e"] + by).cast("int").alias("e")))


def mask_ends(seq: Column, front: Column, back: Column) -> Column:
    """The text with gaps over its first ``front`` and last ``back`` columns."""
    n = F.length(seq)
    middle = F.substring(seq, front + 1, F.greatest(n - front - back, F.lit(0)))
    return F.concat(F.repeat(F.lit("-"), front), middle, F.repeat(F.lit("-"), back))


def slice_part(rows: DataFrame, part: Column, msa: str = "msa_id", idx: str = "row_idx", seq: str = "seq") -> DataFrame:
    """The columns of an alignment in which its query shows ``part`` (an expression over the query's row)."""
    query = rows.filter(F.col(idx) == 0).withColumn("__part", part).groupBy(msa).agg(F.min(F.struct(F.instr(seq, F.col("__part")).alias("at"), F.length("__part").alias("n"))).alias("__p")).filter("__p.at > 0")
    return rows.join(query, msa).withColumn(seq, F.substring(F.col(seq), F.col("__p.at"), F.col("__p.n"))).drop("__p")


def merge_homomers(rows: DataFrame, group: Sequence[str], order: str, seq: str) -> DataFrame:
    """Rows of the chains of one entity side by side, in the order of chains (a target's chains are few)."""
    line = F.sort_array(F.collect_list(F.struct(order, seq)))
    return rows.groupBy(*group).agg(F.array_join(F.transform(line, lambda x: x[seq]), "").alias(seq))


def stack_blocks(paired: DataFrame, unpaired: DataFrame) -> DataFrame:
    """Paired rows above unpaired ones: ``block`` 0 and 1."""
    return paired.withColumn("block", F.lit(0)).unionByName(unpaired.withColumn("block", F.lit(1)))


def missing_rows(counts: DataFrame, key: str, n: str, least: int = 512) -> DataFrame:
    """(key, pad_idx): the rows that an alignment lacks to ``least``."""
    return counts.filter(F.col(n) < least).select(key, F.explode(F.sequence(F.col(n), F.lit(least - 1).cast("long"))).alias("pad_idx"))


def random_unknown(cells: DataFrame, keys: Sequence[str], share: float, seed: int) -> DataFrame:
    """Cells (keys, pos, aa) with a share of the letters replaced by X; gaps stay."""
    hit = (F.col("aa") != "-") & (_draw(seed, *keys, "pos") < share)
    return cells.withColumn("aa", F.when(hit, F.lit("X")).otherwise(F.col("aa")))


def contiguous_crop(df: DataFrame, key: str, seq: str, size: int, seed: int) -> DataFrame:
    """A window of ``size`` residues at a hashed start; shorter texts stay whole."""
    room = F.greatest(F.length(seq) - size, F.lit(0))
    start = F.floor(_draw(seed, key) * (room + 1)).cast("int")
    return df.withColumn("crop_start", start).withColumn(seq, F.substring(F.col(seq), start + 1, F.lit(size)))


def ensemble(df: DataFrame, turns: int) -> DataFrame:
    """Every row once per turn; no join, the turns are an array."""
    return df.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))


def chain_names(chains: DataFrame, target: str, order: Sequence[str]) -> DataFrame:
    """One-letter names of a target's chains; more than 62 are an error."""
    n = F.row_number().over(Window.partitionBy(target).orderBy(*order))
    named = F.when(n <= len(CHAIN_NAMES), F.substring(F.lit(CHAIN_NAMES), n, F.lit(1))).otherwise(F.raise_error(F.lit("more than 62 chains")).cast("string"))
    return chains.withColumn("chain_name", named)


def is_homomer(chains: DataFrame, target: str, entity: str) -> DataFrame:
    """Targets with whether they have exactly one entity."""
    return chains.filter(F.col(entity) > 0).groupBy(target).agg((F.count_distinct(entity) == 1).alias("is_homomer"))


def seqres_lines(seq: Column, chain: Column) -> Column:
    """Fixed-width records of thirteen one-letter residues a line."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(seq) - 1) / 13).cast("int")), lambda k: F.struct((k + 1).alias("k"), F.array_join(chars(F.substring(seq, k * 13 + 1, F.lit(13))), "   ").alias("r")))
    return F.transform(parts, lambda p: F.format_string("SEQRES %3d %s %4d    %s", p["k"], chain, F.length(seq), p["r"]))


def confident(b_factors: Column, above: float = 50.0) -> Column:
    return F.exists(b_factors, lambda b: b > above)
