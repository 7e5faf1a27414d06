"""Row algebra of multiple sequence alignments: dedup, union, padding, merging, cropping, joins between chains.

Order is data: each table carries an ordinal, every window has a full tie-break, and "first" means smallest ordinal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.columns import chars


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. Aggregated, not windowed: a hot key shrinks before the exchange."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*df.columns)


def drop_query_gaps(rows: DataFrame, msa: str = "msa_id", idx: str = "row_idx", seq: str = "seq") -> DataFrame:
    """Rows without the columns in which the alignment's query (row 0) has a gap."""
    query = rows.filter(F.col(idx) == 0).groupBy(msa).agg(F.min(seq).alias("__query"))
    keep = F.filter(F.zip_with(chars(F.col(seq)), chars(F.col("__query")), lambda c, q: F.when(q != "-", c)), lambda c: c.isNotNull())
    return rows.join(query, msa).withColumn(seq, F.array_join(keep, "")).drop("__query")


def pad_to_full(rows: DataFrame, full: DataFrame, msa: str = "msa_id", idx: str = "row_idx", seq: str = "seq") -> DataFrame:
    """Rows gap-padded to the full chain (full: msa_id, full_seq) at the place of the query; row 0 is the chain itself.

    An alignment whose query doesn't stand in the chain is left out.
    """
    query = rows.filter(F.col(idx) == 0).select(msa, F.translate(F.upper(seq), "-", "").alias("__query"))
    at = query.join(full, msa).withColumn("__at", F.instr("full_seq", F.col("__query")) - 1).filter("__at >= 0")
    front = F.repeat(F.lit("-"), F.col("__at"))
    back = F.repeat(F.lit("-"), F.greatest(F.length("full_seq") - F.col("__at") - F.length(seq), F.lit(0)))
    padded = F.when(F.col(idx) == 0, F.col("full_seq")).otherwise(F.concat(front, F.col(seq), back))
    return rows.join(at.select(msa, "full_seq", "__at"), msa).withColumn(seq, padded).drop("full_seq", "__at")


def merge_parts(left: DataFrame, right: DataFrame, linker: int, key: str = "row_idx", seq: str = "seq") -> DataFrame:
    """Two part alignments of one chain side by side, rows paired by ordinal, with a gap linker."""
    return left.select(key, F.col(seq).alias("__l")).join(right.select(key, F.col(seq).alias("__r")), key).select(key, F.concat("__l", F.repeat(F.lit("-"), F.lit(linker)), "__r").alias(seq))


def block_diagonal(rows: DataFrame, chains: DataFrame, seq: str = "seq") -> DataFrame:
    """Unpaired rows of several chains of a target as rows of the whole: gaps before and after the own chain.

    rows: target_id, chain_ord, row_idx, seq; chains: target_id, chain_ord, length.
    """
    w = Window.partitionBy("target_id").orderBy("chain_ord")
    offset = chains.withColumn("__pre", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")).withColumn("__all", F.sum("length").over(Window.partitionBy("target_id")).cast("int"))
    joined = rows.join(offset, ["target_id", "chain_ord"])
    pad = lambda n: F.repeat(F.lit("-"), n.cast("int"))
    return joined.withColumn(seq, F.concat(pad(F.col("__pre")), F.col(seq), pad(F.col("__all") - F.col("__pre") - F.col("length")))).drop("__pre", "__all", "length")


def crop(rows: DataFrame, block: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` rows of each block."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*block).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")


def islands(positions: DataFrame, keys: Sequence[str], pos: str, longer_than: int = 3) -> DataFrame:
    """Runs of consecutive positions longer than a limit: keys, start, end (inclusive), n."""
    w = Window.partitionBy(*keys).orderBy(pos)
    runs = positions.select(*keys, pos).distinct().withColumn("__g", F.col(pos) - F.row_number().over(w))
    return runs.groupBy(*keys, "__g").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > longer_than).drop("__g")


def gap_columns(rows: DataFrame, msa: str = "msa_id", idx: str = "row_idx", seq: str = "seq") -> DataFrame:
    """(msa, pos) of columns in which every row but the query has a gap, before the last other column."""
    cells = rows.filter(F.col(idx) > 0).select(msa, F.posexplode(chars(F.col(seq))).alias("pos", "c"))
    filled = cells.groupBy(msa, "pos").agg(F.max((F.col("c") != "-").cast("int")).alias("filled"))
    last = filled.filter("filled = 1").groupBy(msa).agg(F.max("pos").alias("__last"))
    return filled.filter("filled = 0").join(last, msa).filter("pos < __last").select(msa, "pos")


def without_paired(unpaired: DataFrame, paired: DataFrame, on: Sequence[str]) -> DataFrame:
    """Unpaired rows whose sequence isn't in the paired alignment."""
    return unpaired.join(paired.select(*on).distinct(), list(on), "left_anti")


def fan_out(df: DataFrame, key: str, compute: Column, name: str) -> DataFrame:
    """Compute once per distinct value of key and give the result to all its rows (null keys get null)."""
    once = df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(name, compute)
    return df.join(once, key, "left")


def paired_rows(rows: DataFrame, target: str = "target_id", chain: str = "chain_idx", pair: str = "pair_id") -> DataFrame:
    """(target, pair_id, rows): rows of all chains of a target that carry the same id; the last row of a chain counts.

    rows: target, chain_idx, row, pair_id. Row 0 of all chains comes first (pair_id ''); empty ids pair nothing.
    """
    n = rows.groupBy(target).agg(F.count_distinct(chain).alias("__n"))
    last = rows.filter((F.col(pair) != "") & (F.col("row") > 0)).groupBy(target, pair, chain).agg(F.max("row").alias("row"))
    full = last.groupBy(target, pair).agg(F.transform(F.sort_array(F.collect_list(F.struct(chain, "row"))), lambda x: x["row"]).alias("rows"))
    met = full.join(n, target).filter(F.size("rows") == F.col("__n")).drop("__n")
    query = n.select(target, F.lit("").alias(pair), F.array_repeat(F.lit(0).cast(rows.schema["row"].dataType), F.col("__n").cast("int")).alias("rows"))
    return query.unionByName(met)


def species_pairs(rows: DataFrame, target: str, chain: str, species: str, similarity: str, row: str, max_rows: int = 600) -> DataFrame:
    """Rows of a target's chains paired by rank of similarity within a species: (target, species, rank, n_chains, rows).

    ``rows`` has one entry for each chain of the target, in the order of chains; -1 where the species has none there.
    Species of one chain only, or with more than max_rows rows in a chain, are skipped; within a species as many pairs
    are formed as the poorest of its chains has rows.
    """
    chains = rows.groupBy(target).agg(F.array_sort(F.collect_set(chain)).alias("__chains"))  # a target's chains are few
    known = rows.filter(F.col(species) != "")
    size = known.groupBy(target, species, chain).agg(F.count(F.lit(1)).alias("__m"))
    fit = size.groupBy(target, species).agg(F.count(F.lit(1)).alias("n_chains"), F.min("__m").alias("__least"), F.max("__m").alias("__most")).filter((F.col("n_chains") > 1) & (F.col("__most") <= max_rows))
    w = Window.partitionBy(target, species, chain).orderBy(F.desc(similarity), row)
    ranked = known.join(fit, [target, species]).withColumn("rank", F.row_number().over(w)).filter("rank <= __least")
    held = ranked.groupBy(target, species, "rank", "n_chains").agg(F.map_from_entries(F.collect_list(F.struct(chain, row))).alias("__held")).join(chains, target)
    none = F.lit(-1).cast(rows.schema[row].dataType)
    return held.select(target, species, "rank", "n_chains", F.transform("__chains", lambda c: F.coalesce(F.try_element_at("__held", c), none)).alias("rows"))


def order_pairs(pairs: DataFrame, target: str, rows: str = "rows", n_chains: str = "n_chains", ties: Sequence[str] = (), out: str = "place") -> DataFrame:
    """Place of each pair in its target: those of more chains first, then by the product of their rows."""
    product = F.abs(F.aggregate(rows, F.lit(1.0), lambda acc, r: acc * r.cast("double")))
    return pairs.withColumn(out, F.row_number().over(Window.partitionBy(target).orderBy(F.desc(n_chains), product, *ties)))


def gather_pairs(pairs: DataFrame, rows: DataFrame, target: str, place: str, chain: str, row: str, seq: str = "seq", joined: str = "rows") -> DataFrame:
    """(target, place, seq): the rows of each pair side by side; -1 and rows that aren't there are gaps over the whole chain."""
    size = rows.groupBy(target, chain).agg(F.max(F.length(seq)).alias("__n"))
    order = size.withColumn("__k", F.row_number().over(Window.partitionBy(target).orderBy(chain)) - 1)
    cells = pairs.select(target, place, F.posexplode(joined).alias("__k", row)).join(order, [target, "__k"])
    met = cells.join(rows.select(target, chain, row, seq), [target, chain, row], "left")
    line = F.array_sort(F.collect_list(F.struct("__k", F.coalesce(seq, F.repeat(F.lit("-"), F.col("__n"))).alias("s"))))
    return met.groupBy(target, place).agg(F.array_join(F.transform(line, lambda x: x["s"]), "").alias(seq))


def append_blocks(blocks: DataFrame, target: str, single: str, name: str, order: Sequence[str], out: str = "row_idx") -> DataFrame:
    """Rows of a target's alignments one below the other: those of pairs in reverse order of their names, then single ones
    in order; ``out`` numbers them from 0. Rows must be padded to one length before."""
    pair_last = F.when(F.col(single), F.lit(None)).otherwise(F.col(name))
    w = Window.partitionBy(target).orderBy(single, F.desc(pair_last), name, *order)
    return blocks.withColumn(out, F.row_number().over(w) - 1)


def concatenate_with_gaps(rows: DataFrame, chains: DataFrame, order: Sequence[str]) -> DataFrame:
    """Alignments of a target's chains in the columns of the whole target, each row once (the first one counts)."""
    return first_wins(block_diagonal(rows, chains), ["target_id", "seq"], order)


def rebuild_linker(rows: DataFrame, columns: DataFrame, msa: str = "msa_id", idx: str = "row_idx", seq: str = "seq", key: str = "row_id", seed: int = 7, longer_than: int = 3) -> DataFrame:
    """Rows in which the gaps of linker columns (``columns``: msa, pos; runs longer than a limit) are filled with the query's
    residues there, in an order drawn for each row; the query stays."""
    runs = islands(columns, [msa], "pos", longer_than)
    line = runs.groupBy(msa).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__runs"))  # at most one for four columns
    query = rows.filter(F.col(idx) == 0).groupBy(msa).agg(F.min(seq).alias("__q"))
    met = rows.join(line, msa, "left").join(query, msa, "left")

    def fill(text: Column, run: Column) -> Column:
        n = run["end"] - run["start"] + 1
        own = chars(F.substring(F.col("__q"), run["start"] + 1, n))
        drawn = F.array_sort(F.transform(own, lambda c, i: F.struct(F.xxhash64(F.lit(seed), F.col(key), run["start"], i).alias("h"), c.alias("c"))))
        return F.concat(F.substring(text, F.lit(1), run["start"]), F.array_join(F.transform(drawn, lambda x: x["c"]), ""), F.substring(text, run["end"] + 2, F.length(text)))

    filled = F.aggregate("__runs", F.col(seq), fill)
    return met.withColumn(seq, F.when((F.col(idx) > 0) & F.col("__runs").isNotNull(), filled).otherwise(F.col(seq))).drop("__runs", "__q")


def diagonal_mask(before: Column, own: Column, total: Column) -> Column:
    """For each column of a target 1 where an unpaired row's own chain is, 0 elsewhere."""
    rest = total - before - own
    return F.concat(F.array_repeat(F.lit(0), before.cast("int")), F.array_repeat(F.lit(1), own.cast("int")), F.array_repeat(F.lit(0), rest.cast("int")))


def chain_counts(rows: DataFrame, msa: str = "msa_id", seq: str = "seq", deletions: str = "deletions") -> DataFrame:
    """(msa, num_alignments, seq_length, deletion_mean): the counts and the mean deletion of a cell that go with the
    features of a chain; rows without deletions count as rows only."""
    total = F.aggregate(F.coalesce(F.col(deletions), F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.groupBy(msa).agg(F.count(F.lit(1)).alias("num_alignments"), F.max(F.length(seq)).alias("seq_length"), (F.sum(total) / F.sum(F.when(F.col(deletions).isNotNull(), F.size(deletions)))).alias("deletion_mean"))


def positional_pairs(chains: DataFrame, target: str = "target_id", kind: str = "chain_type", source: str = "ori_name", name: str = "chain_id", order: Sequence[str] = ("ord", "chain_id")) -> DataFrame:
    """Heavy and light chains of a target: (target, heavy, light, is_cross).

    Lists are aligned at their ends; a pair needs two different source chains. Targets without such a pair get all
    pairs of different source chains (is_cross), and those without any list their chains alone. One heavy and one light
    chain are a pair whatever their sources.
    """
    back = Window.partitionBy(target, kind).orderBy(*[F.desc(c) for c in order])
    numbered = chains.filter(F.col(kind).isin("H", "L")).withColumn("__k", F.row_number().over(back)).withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy(target, kind)))
    side = lambda k, n: numbered.filter(F.col(kind) == k).select(target, "__k", F.col(name).alias(n), F.col(source).alias(f"{n}_src"), F.col("__m").alias(f"{n}_n"))
    h, li = side("H", "heavy"), side("L", "light")
    single = (F.col("heavy_n") == 1) & (F.col("light_n") == 1)
    other = ~F.col("heavy_src").eqNullSafe(F.col("light_src"))
    direct = h.join(li, [target, "__k"]).filter(single | other).select(target, "heavy", "light", F.lit(False).alias("is_cross"))
    rest_h, rest_l = (x.join(direct.select(target).distinct(), target, "left_anti") for x in (h, li))
    cross = rest_h.drop("__k").join(rest_l.drop("__k"), target).filter(other).select(target, "heavy", "light", F.lit(True).alias("is_cross"))
    paired = direct.unionByName(cross)
    alone = lambda x, a, b: x.join(paired.select(target).distinct(), target, "left_anti").select(target, F.col(a).alias(a), F.lit(None).cast(chains.schema[name].dataType).alias(b), F.lit(False).alias("is_cross"))
    return paired.unionByName(alone(h, "heavy", "light")).unionByName(alone(li, "light", "heavy"))


def self_pairs(domains: DataFrame, source: Sequence[str], kind: str, order: str, name: str) -> DataFrame:
    """Pairs of domains of different kind in one source chain."""
    a = domains.select(*source, F.col(kind).alias("ka"), F.col(order).alias("oa"), F.col(name).alias("first"))
    b = domains.select(*source, F.col(kind).alias("kb"), F.col(order).alias("ob"), F.col(name).alias("second"))
    return a.join(b, list(source)).filter("oa < ob and ka <> kb").select(*source, "first", "second")


def assembly_ids(chains: DataFrame, target: str, order: Sequence[str], seq: str, by_sequence: bool = False) -> DataFrame:
    """asym_id, entity_id and sym_id of each chain; by default every chain is an entity of its own."""
    w = Window.partitionBy(target).orderBy(*order)
    out = chains.withColumn("asym_id", F.row_number().over(w))
    if not by_sequence:
        return out.withColumn("entity_id", F.col("asym_id")).withColumn("sym_id", F.lit(1))
    first = Window.partitionBy(target, seq).orderBy("asym_id")
    out = out.withColumn("__first", F.min("asym_id").over(Window.partitionBy(target, seq)))
    return out.withColumn("entity_id", F.dense_rank().over(Window.partitionBy(target).orderBy("__first"))).withColumn("sym_id", F.row_number().over(first)).drop("__first")
