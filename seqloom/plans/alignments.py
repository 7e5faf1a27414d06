"""Queries of the alignment operators over msa_rows and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import columns as C
from seqloom.operators import aggregates as A
from seqloom.operators import features as X
from seqloom.operators import msa as M
from seqloom.operators import ranking as R
from seqloom.operators import sampling as S


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rows(spark, d):
    return t(spark, d, "msa_rows").select("row_id", "msa_id", "row_idx", F.upper("seq").alias("seq"), "description", "deletions")


def dedup_first_wins(spark, d):
    return M.first_wins(rows(spark, d).select("msa_id", "seq", "row_idx", "row_id"), ["msa_id", "seq"], ["row_idx", "row_id"]).select("msa_id", "row_id")


def _gapped(spark, d):
    """Alignments whose query is given gaps where its row 1 has them, so that columns fall out."""
    m = rows(spark, d)
    one = m.filter("row_idx = 1").groupBy("msa_id").agg(F.min("seq").alias("s1"))
    q = F.array_join(F.zip_with(C.chars(F.col("seq")), C.chars(F.col("s1")), lambda a, b: F.when(b == "-", "-").otherwise(a)), "")
    return m.join(one, "msa_id").withColumn("seq", F.when(F.col("row_idx") == 0, q).otherwise(F.col("seq")))


def drop_query_gaps(spark, d):
    return M.drop_query_gaps(_gapped(spark, d)).select("row_id", "seq")


def _full(spark, d):
    c = t(spark, d, "chains").filter("name is not null and full_seq is not null")
    return c.select(F.concat_ws("_", "target_id", "name").alias("msa_id"), F.regexp_replace(F.upper("full_seq"), "[^A-Z]", "").alias("full_seq")).groupBy("msa_id").agg(F.min("full_seq").alias("full_seq"))


def pad_to_full(spark, d):
    return M.pad_to_full(rows(spark, d), _full(spark, d)).select("row_id", F.length("seq").cast("long").alias("n"), "seq")


def merge_parts(spark, d):
    """The two halves of the whole length."""
    m = rows(spark, d).filter("row_idx > 0")
    pair = m.groupBy("msa_id").agg(F.min("row_idx").alias("x")).select("msa_id").withColumn("half", F.lit(1))
    half = F.floor(F.length("seq") / 2).cast("int")
    one, two = F.substring("seq", F.lit(1), half), F.substring("seq", half + 1, F.length("seq"))
    left = m.join(pair, "msa_id").select(F.concat_ws(":", "msa_id", "row_idx").alias("row_idx"), one.alias("seq"), "row_id")
    right = m.select(F.concat_ws(":", "msa_id", "row_idx").alias("row_idx"), two.alias("seq"), "row_id")
    first = lambda x: M.first_wins(x, ["row_idx"], ["row_id"])
    return M.merge_parts(first(left), first(right), 3).select("row_idx", "seq")


def _two_chains(m):
    """Neighbouring alignments as the two chains of one target: each target of the tables has one alignment only."""
    number = F.substring("msa_id", 2, 8).cast("int")
    return m.withColumn("target_id", F.concat(F.lit("p"), F.floor(number / 2).cast("string"))).withColumn("chain_idx", number % 2)


def block_diagonal(spark, d):
    m = _two_chains(rows(spark, d)).withColumnRenamed("chain_idx", "chain_ord")
    chains = m.groupBy("target_id", "chain_ord").agg(F.max(F.length("seq")).alias("length"))
    return M.block_diagonal(m, chains).select("row_id", "seq")


def block_crop(spark, d):
    return M.crop(rows(spark, d), ["msa_id"], ["row_idx", "row_id"], 100).select("msa_id", "row_id")


def gap_islands(spark, d):
    m = _gapped(spark, d)
    cells = m.select("row_id", F.posexplode(C.chars(F.col("seq"))).alias("pos", "c")).filter("c = '-'")
    runs = M.islands(cells, ["row_id"], "pos", 3)
    return runs.select("row_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n")


def gap_columns(spark, d):
    return M.gap_columns(rows(spark, d)).select("msa_id", F.col("pos").cast("long").alias("pos"))


def anti_join_paired(spark, d):
    m = rows(spark, d)
    return M.without_paired(m.filter("row_id % 2 = 1"), m.filter("row_id % 2 = 0"), ["msa_id", "seq"]).select("row_id")


def _species(spark, d):
    """Rows with a pairing id: the source named in the description."""
    m = _two_chains(rows(spark, d))
    return m.withColumn("pair_id", F.coalesce(F.lower(F.trim(F.element_at(F.split("description", "\\|"), 1))), F.lit(""))).withColumn("row", F.col("row_idx"))


def paired_rows(spark, d):
    return M.paired_rows(_species(spark, d)).select("target_id", "pair_id", F.array_join(F.transform("rows", lambda x: x.cast("string")), ",").alias("rows"))


def _three_chains(m):
    """Three neighbouring alignments as the chains of one target."""
    number = F.substring("msa_id", 2, 8).cast("int")
    return m.withColumn("target_id", F.concat(F.lit("p"), F.floor(number / 3).cast("string"))).withColumn("chain_idx", number % 3)


def _species_rows(spark, d):
    s = _three_chains(rows(spark, d)).withColumn("pair_id", F.coalesce(F.lower(F.trim(F.element_at(F.split("description", "\\|"), 1))), F.lit("")))
    q = s.filter("row_idx = 0").groupBy("msa_id").agg(F.min("seq").alias("q"))
    return s.join(q, "msa_id").withColumn("similarity", C.identity_score(F.col("seq"), F.col("q"))).filter("row_idx > 0")


def _species_pairs(spark, d):
    return M.species_pairs(_species_rows(spark, d), "target_id", "chain_idx", "pair_id", "similarity", "row_id")


def _listed(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def species_pairs(spark, d):
    return _species_pairs(spark, d).select("target_id", "pair_id", F.col("rank").cast("long").alias("rank"), "n_chains", _listed("rows").alias("rows"))


def pair_order(spark, d):
    p = M.order_pairs(_species_pairs(spark, d), "target_id", ties=["pair_id", "rank"])
    return p.select("target_id", F.col("place").cast("long").alias("place"), "pair_id", F.col("rank").cast("long").alias("rank"))


def paired_sequences(spark, d):
    """The paired rows themselves, chain after chain, gaps where a chain has none."""
    p = M.order_pairs(_species_pairs(spark, d), "target_id", ties=["pair_id", "rank"])
    return M.gather_pairs(p, _species_rows(spark, d), "target_id", "place", "chain_idx", "row_id").select("target_id", F.col("place").cast("long").alias("place"), "seq")


def append_blocks(spark, d):
    """Alignments of light chains as single ones, the others as those of pairs."""
    m = _three_chains(rows(spark, d)).withColumn("single", F.col("msa_id").endswith("L"))
    return M.append_blocks(m.select("row_id", "target_id", "msa_id", "single", F.col("row_idx").alias("idx")), "target_id", "single", "msa_id", ["idx", "row_id"]).select("row_id", F.col("row_idx").cast("long").alias("row_idx"))


def gap_concatenation(spark, d):
    m = _three_chains(rows(spark, d)).withColumnRenamed("chain_idx", "chain_ord")
    chains = m.groupBy("target_id", "chain_ord").agg(F.max(F.length("seq")).alias("length"))
    return M.concatenate_with_gaps(m.select("target_id", "chain_ord", "seq", "row_idx", "row_id"), chains, ["chain_ord", "row_idx", "row_id"]).select("row_id", "seq")


def diagonal_masks(spark, d):
    """Cluster bias of the first row, and sum and place of the mask of unpaired rows."""
    m = _three_chains(rows(spark, d))
    chains = m.groupBy("target_id", "chain_idx").agg(F.max(F.length("seq")).alias("n"))
    w = Window.partitionBy("target_id").orderBy("chain_idx")
    chains = chains.withColumn("pre", F.sum("n").over(w) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("target_id")))
    mask = M.diagonal_mask(F.col("pre"), F.col("n"), F.col("total"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    j = m.join(chains, ["target_id", "chain_idx"]).withColumn("mask", mask)
    return j.select("row_id", F.when(F.col("row_idx") == 0, 1).otherwise(0).alias("bias"), F.size("mask").cast("long").alias("n"), total("mask").alias("on"), (F.array_position("mask", 1) - 1).alias("first"))


def chain_counts(spark, d):
    return M.chain_counts(rows(spark, d)).select("msa_id", "num_alignments", F.col("seq_length").cast("long").alias("seq_length"), F.round("deletion_mean", 6).alias("deletion_mean"))


def rebuild_linker(spark, d):
    """Alignments whose rows but the query lose columns 31 to 40: filled again with the query's residues in some order."""
    m = rows(spark, d)
    cut = F.concat(F.substring("seq", 1, 30), F.lit("-" * 10), F.substring("seq", F.lit(41), F.length("seq")))
    m = m.withColumn("seq", F.when(F.col("row_idx") > 0, cut).otherwise(F.col("seq")))
    out = M.rebuild_linker(m, M.gap_columns(m))
    middle = F.array_join(F.array_sort(C.chars(F.substring("seq", 31, 10))), "")  # the draw is a permutation
    return out.select("row_id", F.substring("seq", 1, 30).alias("front"), middle.alias("letters"), F.substring("seq", F.lit(41), F.length("seq")).alias("back"))


def delete_blocks(spark, d):
    return S.delete_blocks(rows(spark, d), ["msa_id"], "row_idx").select("msa_id", "row_id")


def strided_blocks(spark, d):
    m = rows(spark, d).withColumn("block", F.col("row_id") % 2)
    return S.strided_sample(m, ["msa_id", "block"], ["row_idx", "row_id"], 16 // 2, 3, 20).select("msa_id", "block", F.col("bucket").cast("long").alias("bucket"), "row_id")


def top_ranked(spark, d):
    """Rows of which fewer than five of their alignment are more like the query."""
    m = A.gap_and_similarity(rows(spark, d)).withColumn("similarity", F.round("similarity", 6))
    return R.competition_rank(m, ["msa_id"], "similarity").filter("rank < 5").select("row_id")


def reorder_and_crop(spark, d):
    """The first 50 rows of each alignment in the order of likeness."""
    return reorder_by_likeness(spark, d).filter("place < 50")


def column_frequency(spark, d):
    return A.column_frequency(rows(spark, d), "msa_id").select("msa_id", F.col("pos").cast("long").alias("pos"), "aa", F.round("freq", 6).alias("freq"))


def residue_frequency(spark, d):
    return A.residue_frequency(rows(spark, d), "msa_id").select("msa_id", F.col("pos").cast("long").alias("pos"), "aa", F.round("p", 6).alias("p"), F.round("gap", 6).alias("gap"))


def column_information(spark, d):
    return A.column_information(rows(spark, d), "msa_id").select("msa_id", F.col("pos").cast("long").alias("pos"), "aa", F.round("information", 6).alias("information"))


def profile(spark, d):
    return A.profile(rows(spark, d), "msa_id", eps=1e-4).select("msa_id", F.col("pos").cast("long").alias("pos"), "aa", F.round("p", 6).alias("p"))


def deletion_mean(spark, d):
    return A.deletion_mean(rows(spark, d), "msa_id").select("msa_id", F.col("pos").cast("long").alias("pos"), F.round("deletion_mean", 6).alias("deletion_mean"))


def gap_and_similarity(spark, d):
    return A.gap_and_similarity(rows(spark, d)).select("row_id", F.round("gap_share", 6).alias("gap_share"), F.round("similarity", 6).alias("similarity"))


def frequent_labels(spark, d):
    return A.frequent_labels(t(spark, d, "bucket_store").filter("cdr3 is not null").withColumn("label", F.concat_ws("/", "cdr1_len", "cdr2_len")), "label", 16).select("row_ord")


def _assigned(spark, d):
    m = rows(spark, d)
    centre = (F.col("row_idx") < 4)
    assigned = m.select("row_id", F.concat_ws("#", "msa_id", (F.col("row_idx") % 4).cast("string")).alias("cluster"), centre.alias("is_centre"))
    return m.select("row_id", "seq"), assigned


def cluster_profile(spark, d):
    m, assigned = _assigned(spark, d)
    return A.cluster_profile(m, assigned).select("cluster", F.col("pos").cast("long").alias("pos"), "aa", F.round("p", 6).alias("p"))


def reorder_by_likeness(spark, d):
    m = rows(spark, d)
    weights = m.groupBy("msa_id").agg(F.max(F.length("seq")).alias("n")).select("msa_id", F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: (i % 4).cast("double")).alias("weights"))
    out = R.reorder_by_likeness(m.withColumn("ordinal", F.col("row_idx").cast("long") * 1000000000 + F.col("row_id")), weights, ["msa_id"], "ordinal")
    return out.select("row_id", F.col("distance").alias("distance"), F.col("place").cast("long").alias("place"))


def competition_rank(spark, d):
    m = A.gap_and_similarity(rows(spark, d))
    m = m.withColumn("similarity", F.round("similarity", 6))
    return R.competition_rank(m, ["msa_id"], "similarity").select("row_id", F.col("rank").cast("long").alias("rank"))


def distinct_top(spark, d):
    m = A.gap_and_similarity(rows(spark, d)).filter("row_idx > 0").withColumn("similarity", F.round("similarity", 6))
    return R.distinct_top(m, ["msa_id"], "seq", [F.desc("similarity"), F.asc("row_id")], 20).select("msa_id", "row_id", F.col("place").cast("long").alias("place"))


def top_then_filter(spark, d):
    m = A.gap_and_similarity(rows(spark, d)).withColumn("similarity", F.round("similarity", 6))
    return R.top_then_filter(m, ["msa_id"], [F.desc("similarity"), F.asc("row_id")], 100, F.col("gap_share") == 0).select("row_id", F.col("index").cast("long").alias("index"))


def strided_sample(spark, d):
    return S.strided_sample(rows(spark, d), ["msa_id"], ["row_idx", "row_id"], 16, 3, 20).select("msa_id", F.col("bucket").cast("long").alias("bucket"), "row_id")


def quota_sample(spark, d):
    m = rows(spark, d).withColumn("cluster", F.length(F.regexp_replace("seq", "[^AL]", "")) % 5).withColumn("place", F.col("row_idx").cast("long") * 1000000000 + F.col("row_id"))
    return S.quota_sample(m, "msa_id", "cluster", "place", 64).select("msa_id", F.col("cluster").cast("long").alias("cluster"), "row_id")


def uniform_sample(spark, d):
    return S.uniform_sample(rows(spark, d), ["msa_id"], "row_idx", 32, 7).select("msa_id", "row_id", "is_extra")


def gumbel_order(spark, d):
    return S.gumbel_order(rows(spark, d), ["msa_id"], "row_idx", F.lit(0.0), 7).select("msa_id", "row_id", "place")


def masked_cells(spark, d):
    m = rows(spark, d)
    p = A.profile(m, "msa_id")
    return S.masked_cells(A.cells(m, ["row_id", "msa_id"]), ["row_id"], p, ["msa_id", "pos"], 7).groupBy("row_id").agg(F.sum((F.col("aa") != F.col("corrupt")).cast("int")).alias("n_changed"), F.count(F.lit(1)).alias("n"))


def _chains(spark, d):
    return t(spark, d, "chains").filter("length(full_seq) > 0").withColumn("full_seq", F.regexp_replace(F.upper("full_seq"), "[^A-Z]", ""))


def sequence_features(spark, d):
    f = X.sequence_features(_chains(spark, d), "full_seq")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    hot = X.target_features(F.col("aatype"), 22)
    return f.select("chain_id", F.col("seq_length").cast("long").alias("n"), total("residue_index").alias("index_sum"), total("aatype").alias("aa_sum"), total(F.transform(hot, lambda v: X.argmax(v) - 1)).alias("hot_sum"), F.aggregate("seq_mask", F.lit(0.0), lambda s, x: s + x).alias("mask_sum"), F.size(X.pad_to(F.col("aatype"), 50, F.lit(0))).cast("long").alias("padded"))


def alignment_features(spark, d):
    m = rows(spark, d).filter("deletions is not null")
    f = X.alignment_features(C.residue_codes(F.col("seq")), F.col("deletions"))
    return m.select("row_id", F.size(f).cast("long").alias("n"), F.round(F.aggregate(F.transform(f, lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def full_features(spark, d):
    """Channels of each row's columns with profile and mean deletion: their number and their sums."""
    m = rows(spark, d)
    j = m.filter("deletions is not null").join(X.profile_arrays(m), "msa_id")
    f = X.full_alignment_features(X.alignment_features(C.residue_codes(F.col("seq")), F.col("deletions")), F.col("profile"), F.col("deletion_mean"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    j = j.select("row_id", f.alias("f"))
    return j.select("row_id", F.size("f").cast("long").alias("n"), F.size(F.get("f", F.lit(0))).cast("long").alias("channels"), F.round(total(F.transform("f", lambda v: total(F.slice(v, 1, 25)))), 5).alias("own"), F.round(total(F.transform("f", lambda v: total(F.slice(v, 26, 23)))), 5).alias("profile"), F.round(total(F.transform("f", lambda v: F.get(v, F.lit(48)))), 5).alias("mean"))


def mask_ends(spark, d):
    return rows(spark, d).select("row_id", X.mask_ends(F.col("seq"), F.lit(10), F.lit(12)).alias("seq"))


def slice_part(spark, d):
    return X.slice_part(rows(spark, d), F.substring("seq", 21, 30)).select("row_id", "seq")


def merge_homomers(spark, d):
    m = M.first_wins(_two_chains(rows(spark, d)).select("target_id", "chain_idx", "row_idx", "row_id", "seq"), ["target_id", "chain_idx", "row_idx"], ["row_id"])
    return X.merge_homomers(m, ["target_id", "row_idx"], "chain_idx", "seq")


def stack_blocks(spark, d):
    m = rows(spark, d).select("row_id", "msa_id")
    return X.stack_blocks(m.filter("row_id % 2 = 0"), m.filter("row_id % 2 = 1")).groupBy("msa_id", F.col("block").cast("long").alias("block")).agg(F.count(F.lit(1)).alias("n"))


def missing_rows(spark, d):
    return X.missing_rows(rows(spark, d).groupBy("msa_id").agg(F.count(F.lit(1)).alias("n")), "msa_id", "n", 128)


def random_unknown(spark, d):
    c = X.random_unknown(A.cells(rows(spark, d), ["row_id"]), ["row_id"], 0.1, 11)
    return c.groupBy("row_id").agg(F.sum((F.col("aa") == "X").cast("long")).alias("n_unknown"))


def contiguous_crop(spark, d):
    return X.contiguous_crop(_chains(spark, d), "chain_id", "full_seq", 64, 3).select("chain_id", "crop_start", "full_seq")


def ensemble(spark, d):
    return X.ensemble(rows(spark, d).filter("row_idx = 0").select("msa_id"), 4).groupBy("msa_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").cast("long").alias("last"))


def chain_names(spark, d):
    return X.chain_names(t(spark, d, "chains"), "target_id", ["ord", "chain_id"]).select("chain_id", "chain_name")


def is_homomer(spark, d):
    a = M.assembly_ids(t(spark, d, "chains"), "target_id", ["ord", "chain_id"], "full_seq", by_sequence=True)
    return X.is_homomer(a, "target_id", "entity_id")


def seqres_lines(spark, d):
    out = _chains(spark, d).select("chain_id", F.posexplode(X.seqres_lines(F.col("full_seq"), F.lit("A"))).alias("k", "line"))
    return out.select("chain_id", F.col("k").cast("long").alias("k"), "line")


_NAMES = [
    "sequence_features", "alignment_features", "full_features", "mask_ends", "slice_part", "merge_homomers", "stack_blocks", "missing_rows", "random_unknown",
    "contiguous_crop", "ensemble", "chain_names", "is_homomer", "seqres_lines",
    "dedup_first_wins", "drop_query_gaps", "pad_to_full", "merge_parts", "block_diagonal", "block_crop", "gap_islands", "gap_columns", "anti_join_paired",
    "paired_rows", "species_pairs", "pair_order", "paired_sequences", "append_blocks", "gap_concatenation", "diagonal_masks", "chain_counts",
    "rebuild_linker", "delete_blocks", "strided_blocks", "top_ranked", "reorder_and_crop", "column_frequency", "residue_frequency", "column_information", "profile", "deletion_mean", "gap_and_similarity",
    "frequent_labels", "cluster_profile", "reorder_by_likeness", "competition_rank", "distinct_top", "top_then_filter", "strided_sample", "quota_sample",
    "uniform_sample", "gumbel_order", "masked_cells",
]


def queries() -> dict:
    return {name: globals()[name] for name in _NAMES}


_M = "WITH m AS (SELECT row_id, msa_id, row_idx, upper(seq) AS seq, description, deletions FROM msa_rows)"
_MIX = "list_transform(range(1, length(a) + 1), lambda i: CASE WHEN substr(b, i, 1) = '-' THEN '-' ELSE substr(a, i, 1) END)"
_GAPPED = f"""{_M}, one AS (SELECT msa_id, min(seq) AS s1 FROM m WHERE row_idx = 1 GROUP BY msa_id),
    g0 AS (SELECT m.*, seq AS a, s1 AS b FROM m JOIN one USING (msa_id)), g AS (SELECT row_id, msa_id, row_idx, CASE WHEN row_idx = 0 THEN array_to_string({_MIX}, '') ELSE seq END AS seq FROM g0)"""
_CELLS = f"{_M}, cells AS (SELECT row_id, msa_id, row_idx, pos - 1 AS pos, substr(seq, CAST(pos AS INTEGER), 1) AS aa FROM m, LATERAL (SELECT unnest(range(1, length(seq) + 1)) AS pos)), cnt AS (SELECT msa_id, pos, aa, count(*) AS n FROM cells GROUP BY ALL)"
_P = f"{_CELLS}, w AS (SELECT *, sum(n) OVER (PARTITION BY msa_id, pos) AS total, coalesce(sum(n) FILTER (aa = '-') OVER (PARTITION BY msa_id, pos), 0) AS gaps FROM cnt), p AS (SELECT msa_id, pos, aa, n / (total - gaps) AS p, gaps / total AS gap FROM w WHERE aa <> '-')"
_SIM = f"""{_M}, q AS (SELECT msa_id, min(seq) AS q FROM m WHERE row_idx = 0 GROUP BY msa_id),
    sim AS (SELECT m.*, (length(seq) - length(replace(seq, '-', ''))) / length(seq) AS gap_share, list_sum(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN substr(seq, i, 1) = substr(q, i, 1) THEN 1 ELSE 0 END)) / length(seq) AS similarity FROM m JOIN q USING (msa_id))"""
_SPECIES = f"{_M}, s AS (SELECT row_id, msa_id, row_idx, seq, 'p' || (CAST(substr(msa_id, 2, 8) AS INTEGER) // 2) AS target_id, CAST(substr(msa_id, 2, 8) AS INTEGER) % 2 AS chain_idx, coalesce(lower(trim(split_part(description, '|', 1))), '') AS pair_id FROM m)"


_THREE = f"{_M}, s AS (SELECT *, 'p' || (CAST(substr(msa_id, 2, 8) AS INTEGER) // 3) AS target_id, CAST(substr(msa_id, 2, 8) AS INTEGER) % 3 AS chain_idx, coalesce(lower(trim(split_part(description, '|', 1))), '') AS pair_id FROM m)"
_TRIPLES = f"""{_THREE}, q AS (SELECT msa_id, min(seq) AS q FROM s WHERE row_idx = 0 GROUP BY msa_id), x0 AS (SELECT s.*, q FROM s JOIN q USING (msa_id) WHERE row_idx > 0), ch AS (SELECT target_id, list(DISTINCT chain_idx ORDER BY chain_idx) AS cs FROM x0 GROUP BY target_id),
    x AS (SELECT *, list_sum(list_transform(range(1, length(q) + 1), lambda i: CASE WHEN substr(seq, i, 1) = substr(q, i, 1) THEN 1 ELSE -1 END)) / length(q) AS sim FROM x0 WHERE pair_id <> ''),
    n AS (SELECT target_id, pair_id, chain_idx, count(*) AS m FROM x GROUP BY ALL), f AS (SELECT target_id, pair_id, min(m) AS least, count(*) AS n_chains FROM n GROUP BY ALL HAVING count(*) > 1 AND max(m) <= 600),
    r AS (SELECT target_id, pair_id, chain_idx, row_id, row_number() OVER (PARTITION BY target_id, pair_id, chain_idx ORDER BY sim DESC, row_id) AS rank FROM x),
    h AS (SELECT target_id, pair_id, rank, n_chains, map_from_entries(list((chain_idx, row_id))) AS held FROM r JOIN f USING (target_id, pair_id) WHERE rank <= least GROUP BY target_id, pair_id, rank, n_chains),
    tr AS (SELECT target_id, pair_id, rank, n_chains, list_transform(cs, lambda c: coalesce(held[c], -1)) AS rl, array_to_string(list_transform(cs, lambda c: coalesce(held[c], -1)), ',') AS rows FROM h JOIN ch USING (target_id))"""


_C = "WITH c AS (SELECT *, regexp_replace(upper(full_seq), '[^A-Z]', '', 'g') AS s FROM chains WHERE length(full_seq) > 0), "


def oracle_sql() -> dict[str, str]:
    code = "CASE WHEN strpos('ACDEFGHIKLMNPQRSTVWYX-', c) > 0 THEN strpos('ACDEFGHIKLMNPQRSTVWYX-', c) - 1 ELSE 20 END"
    return {
        "sequence_features": f"""{_C} k AS (SELECT chain_id, length(s) AS n, list_sum(list_transform(split(translate(s, 'BJOUZ', 'DXXCE'), ''), lambda c: {code})) AS a FROM c)
            SELECT chain_id, n, n * (n - 1) // 2 AS index_sum, CAST(a AS BIGINT) AS aa_sum, CAST(a AS BIGINT) AS hot_sum, CAST(n AS DOUBLE) AS mask_sum, CAST(ceil(n / 50) * 50 AS BIGINT) AS padded FROM k""",
        "alignment_features": f"{_M} SELECT row_id, length(seq) AS n, round(length(seq) + list_sum(list_transform(deletions, lambda x: least(greatest(x, 0), 1) + atan(x / 3.0) * 2 / pi())), 5) AS total FROM m WHERE deletions IS NOT NULL",
        "full_features": f"""{_M}, z AS (SELECT msa_id, count(*) AS n FROM m GROUP BY msa_id), dm AS (SELECT msa_id, pos, avg(d) AS a FROM (SELECT msa_id, unnest(deletions) AS d, unnest(range(1, len(deletions) + 1)) AS pos FROM m WHERE deletions IS NOT NULL) GROUP BY ALL),
            dv AS (SELECT msa_id, sum(atan(a / 3.0) * 2 / pi()) AS mean FROM dm GROUP BY msa_id)
            SELECT row_id, length(seq) AS n, 49 AS channels, round(length(seq) + list_sum(list_transform(deletions, lambda x: least(greatest(x, 0), 1) + atan(x / 3.0) * 2 / pi())), 5) AS own, round(length(seq) * z.n / (z.n + 1e-6), 5) AS profile, round(mean, 5) AS mean
            FROM m JOIN z USING (msa_id) JOIN dv USING (msa_id) WHERE deletions IS NOT NULL""",
        "mask_ends": f"{_M} SELECT row_id, repeat('-', 10) || substr(seq, 11, length(seq) - 22) || repeat('-', 12) AS seq FROM m",
        "slice_part": f"{_M}, q AS (SELECT msa_id, min(strpos(seq, substr(seq, 21, 30))) AS pre FROM m WHERE row_idx = 0 GROUP BY msa_id) SELECT row_id, substr(seq, CAST(pre AS INTEGER), 30) AS seq FROM m JOIN q USING (msa_id)",
        "merge_homomers": f"{_M}, b AS (SELECT 'p' || (CAST(substr(msa_id, 2, 8) AS INTEGER) // 2) AS target_id, CAST(substr(msa_id, 2, 8) AS INTEGER) % 2 AS c, row_idx, seq FROM m QUALIFY row_number() OVER (PARTITION BY msa_id, row_idx ORDER BY row_id) = 1) SELECT target_id, row_idx, string_agg(seq, '' ORDER BY c) AS seq FROM b GROUP BY ALL",
        "stack_blocks": f"{_M} SELECT msa_id, row_id % 2 AS block, count(*) AS n FROM m GROUP BY 1, 2",
        "missing_rows": f"{_M}, n AS (SELECT msa_id, count(*) AS n FROM m GROUP BY 1) SELECT msa_id, unnest(range(n, 128)) AS pad_idx FROM n WHERE n < 128",
        "ensemble": f"{_M} SELECT msa_id, 4 * count(*) AS n, CAST(3 AS BIGINT) AS last FROM m WHERE row_idx = 0 GROUP BY msa_id",
        "chain_names": "SELECT chain_id, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', CAST(row_number() OVER (PARTITION BY target_id ORDER BY ord, chain_id) AS INTEGER), 1) AS chain_name FROM chains",
        "is_homomer": "SELECT target_id, count(DISTINCT coalesce(full_seq, '')) = 1 AS is_homomer FROM chains GROUP BY target_id",
        "seqres_lines": f"""{_C} l AS (SELECT chain_id, s, unnest(range(0, (length(s) - 1) // 13 + 1)) AS k FROM c)
            SELECT chain_id, k, format('SEQRES {{:3d}} A {{:4d}}    {{}}', k + 1, length(s), array_to_string(split(substr(s, CAST(k * 13 + 1 AS INTEGER), 13), ''), '   ')) AS line FROM l""",
        "dedup_first_wins": f"{_M} SELECT msa_id, row_id FROM m QUALIFY row_number() OVER (PARTITION BY msa_id, seq ORDER BY row_idx, row_id) = 1",
        "drop_query_gaps": f"{_GAPPED}, q AS (SELECT msa_id, min(seq) AS q FROM g WHERE row_idx = 0 GROUP BY msa_id) SELECT row_id, array_to_string(list_transform(list_filter(range(1, length(seq) + 1), lambda i: substr(q, i, 1) <> '-'), lambda i: substr(seq, i, 1)), '') AS seq FROM g JOIN q USING (msa_id)",
        "pad_to_full": f"""{_M}, f AS (SELECT concat_ws('_', target_id, name) AS msa_id, min(regexp_replace(upper(full_seq), '[^A-Z]', '', 'g')) AS full_seq FROM chains WHERE name IS NOT NULL AND full_seq IS NOT NULL GROUP BY 1),
            q AS (SELECT msa_id, full_seq, strpos(full_seq, replace(seq, '-', '')) - 1 AS pre FROM m JOIN f USING (msa_id) WHERE row_idx = 0),
            r AS (SELECT row_id, CASE WHEN row_idx = 0 THEN full_seq ELSE repeat('-', pre) || seq || repeat('-', greatest(length(full_seq) - pre - length(seq), 0)) END AS seq FROM m JOIN q USING (msa_id) WHERE pre >= 0)
            SELECT row_id, length(seq) AS n, seq FROM r""",
        "merge_parts": f"{_M} SELECT msa_id || ':' || row_idx AS row_idx, substr(seq, 1, length(seq) // 2) || '---' || substr(seq, length(seq) // 2 + 1) AS seq FROM m WHERE row_idx > 0 QUALIFY row_number() OVER (PARTITION BY msa_id, row_idx ORDER BY row_id) = 1",
        "block_diagonal": f"""{_M}, b AS (SELECT row_id, seq, 'p' || (CAST(substr(msa_id, 2, 8) AS INTEGER) // 2) AS target_id, CAST(substr(msa_id, 2, 8) AS INTEGER) % 2 AS c FROM m), l AS (SELECT target_id, c, max(length(seq)) AS n FROM b GROUP BY ALL),
            o AS (SELECT target_id, c, n, sum(n) OVER (PARTITION BY target_id ORDER BY c) - n AS pre, sum(n) OVER (PARTITION BY target_id) AS total FROM l)
            SELECT row_id, repeat('-', CAST(pre AS BIGINT)) || seq || repeat('-', CAST(total - pre - n AS BIGINT)) AS seq FROM b JOIN o USING (target_id, c)""",
        "block_crop": f"{_M} SELECT msa_id, row_id FROM m QUALIFY row_number() OVER (PARTITION BY msa_id ORDER BY row_idx, row_id) <= 100",
        "gap_islands": f"""{_GAPPED}, c AS (SELECT row_id, pos - 1 AS pos FROM g, LATERAL (SELECT unnest(range(1, length(seq) + 1)) AS pos) WHERE substr(seq, CAST(pos AS INTEGER), 1) = '-'),
            r AS (SELECT row_id, pos, pos - row_number() OVER (PARTITION BY row_id ORDER BY pos) AS k FROM c) SELECT row_id, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM r GROUP BY row_id, k HAVING count(*) > 3""",
        "gap_columns": f"""{_CELLS}, f AS (SELECT msa_id, pos, max(CASE WHEN aa <> '-' THEN 1 ELSE 0 END) AS filled FROM cells WHERE row_idx >= 1 GROUP BY ALL), l AS (SELECT msa_id, max(pos) AS last FROM f WHERE filled = 1 GROUP BY msa_id)
            SELECT msa_id, pos FROM f JOIN l USING (msa_id) WHERE filled = 0 AND pos < last""",
        "anti_join_paired": f"{_M} SELECT row_id FROM m WHERE row_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM m n WHERE n.row_id % 2 = 0 AND n.msa_id = m.msa_id AND n.seq = m.seq)",
        "paired_rows": f"""{_SPECIES}, n AS (SELECT target_id, count(DISTINCT chain_idx) AS k FROM s GROUP BY target_id), l AS (SELECT target_id, pair_id, chain_idx, max(row_idx) AS r FROM s WHERE pair_id <> '' AND row_idx > 0 GROUP BY ALL),
            f AS (SELECT target_id, pair_id, count(*) AS k, string_agg(CAST(r AS VARCHAR), ',' ORDER BY chain_idx) AS rows FROM l GROUP BY ALL)
            SELECT target_id, pair_id, rows FROM f JOIN n USING (target_id, k) UNION ALL SELECT target_id, '', CASE k WHEN 1 THEN '0' ELSE '0,0' END FROM n""",
        "species_pairs": f"{_TRIPLES} SELECT target_id, pair_id, rank, n_chains, rows FROM tr",
        "pair_order": f"{_TRIPLES} SELECT target_id, row_number() OVER (PARTITION BY target_id ORDER BY n_chains DESC, abs(list_product(rl)), pair_id, rank) AS place, pair_id, rank FROM tr",
        "paired_sequences": f"""{_TRIPLES}, po AS (SELECT target_id, row_number() OVER (PARTITION BY target_id ORDER BY n_chains DESC, abs(list_product(rl)), pair_id, rank) AS place, rl FROM tr),
            u AS (SELECT po.target_id, place, k, rl[k] AS row_id FROM po, range(1, 4) t(k) WHERE k <= len(rl)), lc AS (SELECT target_id, chain_idx, max(length(seq)) AS n, row_number() OVER (PARTITION BY target_id ORDER BY chain_idx) AS k FROM x0 GROUP BY target_id, chain_idx)
            SELECT u.target_id, place, string_agg(coalesce(x0.seq, repeat('-', CAST(lc.n AS BIGINT))), '' ORDER BY u.k) AS seq FROM u JOIN lc ON u.target_id = lc.target_id AND u.k = lc.k LEFT JOIN x0 ON x0.row_id = u.row_id GROUP BY u.target_id, place""",
        "append_blocks": f"{_THREE} SELECT row_id, row_number() OVER (PARTITION BY target_id ORDER BY msa_id LIKE '%L', CASE WHEN msa_id LIKE '%L' THEN '' ELSE msa_id END DESC, msa_id, row_idx, row_id) - 1 AS row_idx FROM s",
        "gap_concatenation": f"""{_THREE}, l AS (SELECT target_id, chain_idx, max(length(seq)) AS n FROM s GROUP BY ALL), o AS (SELECT *, sum(n) OVER (PARTITION BY target_id ORDER BY chain_idx) - n AS pre, sum(n) OVER (PARTITION BY target_id) AS total FROM l),
            b AS (SELECT row_id, row_idx, target_id, chain_idx, repeat('-', CAST(pre AS BIGINT)) || seq || repeat('-', CAST(total - pre - n AS BIGINT)) AS seq FROM s JOIN o USING (target_id, chain_idx))
            SELECT row_id, seq FROM b QUALIFY row_number() OVER (PARTITION BY target_id, seq ORDER BY chain_idx, row_idx, row_id) = 1""",
        "diagonal_masks": f"""{_THREE}, l AS (SELECT target_id, chain_idx, max(length(seq)) AS n FROM s GROUP BY ALL), o AS (SELECT *, sum(n) OVER (PARTITION BY target_id ORDER BY chain_idx) - n AS pre, sum(n) OVER (PARTITION BY target_id) AS total FROM l)
            SELECT row_id, CASE WHEN row_idx = 0 THEN 1 ELSE 0 END AS bias, CAST(total AS BIGINT) AS n, CAST(o.n AS BIGINT) AS "on", CAST(pre AS BIGINT) AS first FROM s JOIN o USING (target_id, chain_idx)""",
        "chain_counts": "SELECT msa_id, count(*) AS num_alignments, max(length(seq)) AS seq_length, round(sum(list_sum(deletions)) / sum(len(deletions)), 6) AS deletion_mean FROM msa_rows GROUP BY msa_id",
        "rebuild_linker": f"""{_M}, q AS (SELECT msa_id, min(seq) AS q FROM m WHERE row_idx = 0 GROUP BY msa_id), n AS (SELECT msa_id, count(*) FILTER (row_idx > 0) AS deep FROM m GROUP BY msa_id)
            SELECT row_id, substr(seq, 1, 30) AS front, array_to_string(list_sort(split(substr(CASE WHEN row_idx = 0 THEN seq ELSE q END, 31, 10), '')), '') AS letters, substr(seq, 41) AS back FROM m JOIN q USING (msa_id)""",
        "strided_blocks": f"""{_M}, r AS (SELECT msa_id, row_id % 2 AS block, row_id, row_number() OVER (PARTITION BY msa_id, row_id % 2 ORDER BY row_idx, row_id) - 1 AS r, count(*) OVER (PARTITION BY msa_id, row_id % 2) AS n FROM m),
            b AS (SELECT *, (SELECT min(i) FROM range(0, 8) x(i) WHERE r >= i * n // 8 AND r < (i + 1) * n // 8) AS bucket FROM r), c AS (SELECT *, r - min(r) OVER (PARTITION BY msa_id, block, bucket) AS p, count(*) OVER (PARTITION BY msa_id, block, bucket) AS k, min(bucket) OVER (PARTITION BY msa_id, block) AS b0 FROM b)
            SELECT msa_id, block, bucket, row_id FROM c WHERE p = CASE WHEN bucket = b0 THEN 0 WHEN 3 >= k THEN k - 1 ELSE least((k // 19) * 3, k - 1) END""",
        "top_ranked": f"{_SIM} SELECT row_id FROM sim QUALIFY rank() OVER (PARTITION BY msa_id ORDER BY round(similarity, 6) DESC) <= 5",
        "column_frequency": f"{_CELLS} SELECT msa_id, pos, aa, round(freq, 6) AS freq FROM (SELECT msa_id, pos, aa, n / sum(n) OVER (PARTITION BY msa_id, pos) AS freq FROM cnt) WHERE aa <> 'X'",
        "residue_frequency": f"{_P} SELECT msa_id, pos, aa, round(p, 6) AS p, round(gap, 6) AS gap FROM p",
        "column_information": f"{_P}, h AS (SELECT *, sum(-p * log2(p)) OVER (PARTITION BY msa_id, pos) AS h FROM p) SELECT msa_id, pos, aa, round((log2(20) - h) * p * (1 - gap), 6) AS information FROM h",
        "profile": f"{_CELLS} SELECT msa_id, pos, aa, round(n / (sum(n) OVER (PARTITION BY msa_id, pos) + 1e-4), 6) AS p FROM cnt WHERE aa <> '-'",
        "deletion_mean": "SELECT msa_id, pos - 1 AS pos, round(avg(d), 6) AS deletion_mean FROM (SELECT msa_id, unnest(deletions) AS d, unnest(range(1, len(deletions) + 1)) AS pos FROM msa_rows WHERE deletions IS NOT NULL) GROUP BY msa_id, pos",
        "gap_and_similarity": f"{_SIM} SELECT row_id, round(gap_share, 6) AS gap_share, round(similarity, 6) AS similarity FROM sim",
        "frequent_labels": "WITH l AS (SELECT row_ord, concat_ws('/', cdr1_len, cdr2_len) AS label FROM bucket_store WHERE cdr3 IS NOT NULL) SELECT row_ord FROM l QUALIFY count(*) OVER (PARTITION BY label) >= 16",
        "cluster_profile": f"{_CELLS}, k AS (SELECT msa_id || '#' || (row_idx % 4) AS cluster, pos, aa, count(*) AS n FROM cells GROUP BY ALL), z AS (SELECT msa_id || '#' || (row_idx % 4) AS cluster, count(*) AS size FROM m GROUP BY ALL) SELECT cluster, pos, aa, round(n / (size + 1e-6), 6) AS p FROM k JOIN z USING (cluster)",
        "reorder_by_likeness": f"""{_M}, f AS (SELECT msa_id, arg_min(seq, CAST(row_idx AS BIGINT) * 1000000000 + row_id) AS q FROM m GROUP BY msa_id),
            x AS (SELECT row_id, msa_id, row_idx, CAST(list_sum(list_transform(range(1, length(q) + 1), lambda i: CASE WHEN substr(seq, i, 1) <> substr(q, i, 1) THEN i % 4 ELSE 0 END)) AS DOUBLE) AS distance FROM m JOIN f USING (msa_id))
            SELECT row_id, distance, row_number() OVER (PARTITION BY msa_id ORDER BY distance, row_idx, row_id) - 1 AS place FROM x""",
        "reorder_and_crop": f"""{_M}, f AS (SELECT msa_id, arg_min(seq, CAST(row_idx AS BIGINT) * 1000000000 + row_id) AS q FROM m GROUP BY msa_id),
            x AS (SELECT row_id, msa_id, row_idx, CAST(list_sum(list_transform(range(1, length(q) + 1), lambda i: CASE WHEN substr(seq, i, 1) <> substr(q, i, 1) THEN i % 4 ELSE 0 END)) AS DOUBLE) AS distance FROM m JOIN f USING (msa_id))
            SELECT row_id, distance, row_number() OVER (PARTITION BY msa_id ORDER BY distance, row_idx, row_id) - 1 AS place FROM x QUALIFY place < 50""",
        "competition_rank": f"{_SIM} SELECT row_id, rank() OVER (PARTITION BY msa_id ORDER BY round(similarity, 6) DESC) - 1 AS rank FROM sim",
        "distinct_top": f"{_SIM}, o AS (SELECT msa_id, row_id, round(similarity, 6) AS s FROM sim WHERE row_idx > 0 QUALIFY row_number() OVER (PARTITION BY msa_id, seq ORDER BY round(similarity, 6) DESC, row_id) = 1) SELECT msa_id, row_id, place FROM (SELECT *, row_number() OVER (PARTITION BY msa_id ORDER BY s DESC, row_id) AS place FROM o) WHERE place <= 20",
        "top_then_filter": f'{_SIM} SELECT row_id, "index" FROM (SELECT *, row_number() OVER (PARTITION BY msa_id ORDER BY round(similarity, 6) DESC, row_id) AS "index" FROM sim) WHERE "index" <= 100 AND gap_share = 0',
        "strided_sample": f"""{_M}, r AS (SELECT msa_id, row_id, row_number() OVER (PARTITION BY msa_id ORDER BY row_idx, row_id) - 1 AS r, count(*) OVER (PARTITION BY msa_id) AS n FROM m),
            b AS (SELECT *, (SELECT min(i) FROM range(0, 16) x(i) WHERE r >= i * n // 16 AND r < (i + 1) * n // 16) AS bucket FROM r), c AS (SELECT *, r - min(r) OVER (PARTITION BY msa_id, bucket) AS p, count(*) OVER (PARTITION BY msa_id, bucket) AS k, min(bucket) OVER (PARTITION BY msa_id) AS b0 FROM b)
            SELECT msa_id, bucket, row_id FROM c WHERE p = CASE WHEN bucket = b0 THEN 0 WHEN 3 >= k THEN k - 1 ELSE least((k // 19) * 3, k - 1) END""",
    }
