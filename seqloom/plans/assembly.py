"""Queries of naming, stubs, padding, masks, crops, selection, cleanup and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import columns as C
from seqloom.operators import assembly as S
from seqloom.operators import chains as N
from seqloom.operators import clustering as K


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pair_names(spark, d):
    return t(spark, d, "msa_rows").select("row_id", S.pair_names(F.col("row_idx")).alias("name"))


def query_first(spark, d):
    """Alignment rows below the first chain of their target."""
    m = t(spark, d, "msa_rows").select("msa_id", "row_idx", F.upper("seq").alias("seq"), "row_id")
    q = m.filter("row_idx = 0").groupBy("msa_id").agg(F.min("seq").alias("seq")).withColumn("row_id", F.lit(-1).cast("long"))
    return N.prepend_query(m, q, "msa_id").select("msa_id", F.col("row_idx").cast("long").alias("row_idx"), "seq", "row_id")


def used_alignment(spark, d):
    """Alignments as they were used: codes as letters, rows by number."""
    m = t(spark, d, "msa_rows")
    return m.select("row_id", F.concat(F.lit("seq_"), F.col("row_idx").cast("string")).alias("name"), C.residue_text(C.residue_codes(F.col("seq"))).alias("seq"))


def names_join(spark, d):
    """Chains and alignments that have the same name."""
    c = t(spark, d, "chains").select("chain_id", F.upper(F.concat_ws("_", "target_id", "name")).alias("k"))
    return c.join(t(spark, d, "msa_rows").select(F.upper("msa_id").alias("k")).distinct(), "k").select("chain_id", "k")


def stub_alignments(spark, d):
    c = t(spark, d, "chains").filter("chain_type is null and length(full_seq) > 0")
    return S.stub_alignment(c, "chain_id", "full_seq", F.lit(5)).select("chain_id", F.col("row_idx").cast("long").alias("row_idx"), "full_seq")


def striding_masks(spark, d):
    return t(spark, d, "msa_rows").select("row_id", S.striding_mask(F.upper("seq"), F.col("row_idx"), 10, 7).alias("seq"))


def random_masks(spark, d):
    """How many letters a random mask of eight positions leaves as they were."""
    m = t(spark, d, "msa_rows").withColumn("s", F.upper("seq")).withColumn("masked", S.random_mask(F.upper("seq"), F.col("row_id"), 8, 3))
    same = F.aggregate(F.zip_with(C.chars(F.col("s")), C.chars(F.col("masked")), lambda a, b: F.when(a != b, 1).when(a == "X", 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return m.select("row_id", F.length("masked").cast("long").alias("n"), (same >= 8).alias("eight"))


def padded_templates(spark, d):
    """Four templates for each target: chains stand in for templates, zeros for what is missing."""
    c = t(spark, d, "chains")
    n = F.row_number().over(Window.partitionBy("target_id").orderBy("ord", "chain_id")) - 1
    rows = c.withColumn("place", n).select("target_id", "place", F.coalesce(F.length("full_seq"), F.lit(0)).alias("length"))
    out = S.pad_rows(rows, c.select("target_id").distinct(), "target_id", "place", 4, {"length": F.lit(0)})
    return out.select("target_id", F.col("place").cast("long").alias("place"), F.col("length").cast("long").alias("length"), "is_padding")


def fixed_sizes(spark, d):
    """Residue codes at a fixed size of 128, CDR3 blanked."""
    c = t(spark, d, "chains").filter("size(regions) = 7").withColumn("i", C.region_intervals(C.region_lengths(F.col("regions"))))
    cdr3 = F.get("i", F.lit(5))
    a = S.blank_region(S.fixed_size(C.residue_codes(F.array_join("regions", "")), 128, F.lit(21)), cdr3["s"], cdr3["e"], F.lit(-1))
    return c.select("chain_id", F.size(a).cast("long").alias("n"), F.size(F.filter(a, lambda x: x == 21)).cast("long").alias("padding"), F.size(F.filter(a, lambda x: x == -1)).cast("long").alias("blank"))


def spatial_crops(spark, d):
    """The forty rows of each label nearest to its first one."""
    e = t(spark, d, "embeddings").select("label", "vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])
    first = e.groupBy("label").agg(*[F.min_by(c, "vec_id").alias(f"c{c}") for c in "xyz"])
    return S.spatial_crop(e, ["label"], "vec_id", first, 40).select("label", "vec_id", F.round("distance", 6).alias("distance"))


def crop_budgets(spark, d):
    c = t(spark, d, "chains").groupBy("target_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chain_id", F.coalesce(F.length("full_seq"), F.lit(0)).alias("n")))), lambda x: x["n"]).alias("lengths"))
    return c.select("target_id", F.aggregate(S.crop_budget(F.col("lengths"), 256), F.lit(0).cast("long"), lambda a, x: a + x).alias("kept"), F.array_join(F.transform(S.crop_budget(F.col("lengths"), 256), lambda x: x.cast("string")), ",").alias("each"))


def epoch_rows(spark, d):
    """One epoch: the first hundred chains whose structure has a usable resolution."""
    s = S.structure_features(t(spark, d, "structures"))
    return S.first_passing(s, F.col("resolution") <= 3.0, ["file_id", "chain_index"], 100).select("file_id", F.col("chain_index").cast("long").alias("chain_index"))


def structure_features(spark, d):
    return S.structure_features(t(spark, d, "structures")).select("file_id", "release_date", "resolution", F.col("chain_index").cast("long").alias("chain_index"), "chain", F.col("seq_length").cast("long").alias("seq_length"))


def clean_atoms(spark, d):
    """Embeddings as atoms, some of them of modified or foreign residues."""
    e = t(spark, d, "embeddings")
    aa = F.when(F.col("vec_id") % 11 == 0, "HOH").when(F.col("vec_id") % 5 == 0, "MSE").otherwise("GLY")
    atoms = e.select(F.when(F.col("vec_id") % 50 == 1, F.concat(F.lit("s"), F.col("vec_id").cast("string"))).otherwise(F.col("label").cast("string")).alias("chain"), F.col("vec_id").alias("residue"), aa.alias("aa"), F.when(aa == "MSE", "SE").otherwise("CA").alias("atom"))
    return S.clean_atoms(atoms, ["chain"], "residue", ["MET", "GLY"]).select("chain", "residue", "aa", "atom")


def upsert(spark, d):
    """The later half of arrivals merged into the earlier ones, by name."""
    c = t(spark, d, "chains").filter("name is not null").withColumn("k", F.concat_ws("_", "target_id", "name"))
    part = lambda odd: c.filter(F.col("ord") % 2 == odd).groupBy("k").agg(F.max("chain_id").alias("chain_id"))
    return S.upsert(part(0), part(1), ["k"])


def knee_distances(spark, d):
    """Distance of each row to its fifth nearest, of those within a limit."""
    pairs = K.blocked_pairs(t(spark, d, "embeddings"), "vec_id", "embedding", 0.9)
    return S.nearest_distances(pairs, "a", "b", "distance", 5).select(F.col("key").alias("vec_id"), F.round("distance", 6).alias("distance"))


_NAMES = [
    "pair_names", "query_first", "used_alignment", "names_join", "stub_alignments", "striding_masks", "random_masks", "padded_templates", "fixed_sizes",
    "spatial_crops", "crop_budgets", "epoch_rows", "structure_features", "clean_atoms", "upsert", "knee_distances",
]


def queries() -> dict:
    return {name: globals()[name] for name in _NAMES}


def oracle_sql() -> dict[str, str]:
    start = "((row_idx * 7) % greatest(length(s) - 9, 1))"
    return {
        "pair_names": "SELECT row_id, '>tr|A0A8T2NDK6|A0A8T2NDK6_' || row_idx || '/H' || row_idx || '-L' || row_idx AS name FROM msa_rows",
        "query_first": "SELECT msa_id, row_idx + 1 AS row_idx, upper(seq) AS seq, row_id FROM msa_rows UNION ALL SELECT msa_id, 0, min(upper(seq)), -1 FROM msa_rows WHERE row_idx = 0 GROUP BY msa_id",
        "used_alignment": "SELECT row_id, 'seq_' || row_idx AS name, regexp_replace(translate(upper(seq), 'BJOUZ', 'DXXCE'), '[^ACDEFGHIKLMNPQRSTVWXY-]', 'X', 'g') AS seq FROM msa_rows",
        "names_join": "SELECT chain_id, upper(concat_ws('_', target_id, name)) AS k FROM chains WHERE upper(concat_ws('_', target_id, name)) IN (SELECT upper(msa_id) FROM msa_rows)",
        "stub_alignments": "SELECT chain_id, unnest(range(0, 5)) AS row_idx, full_seq FROM chains WHERE chain_type IS NULL AND length(full_seq) > 0",
        "striding_masks": f"SELECT row_id, substr(s, 1, {start}) || repeat('-', least(length(s), 10)) || substr(s, {start} + 11) AS seq FROM (SELECT row_id, row_idx, upper(seq) AS s FROM msa_rows)",
        "random_masks": "SELECT row_id, length(seq) AS n, true AS eight FROM msa_rows",
        "padded_templates": """WITH c AS (SELECT target_id, row_number() OVER (PARTITION BY target_id ORDER BY ord, chain_id) - 1 AS place, coalesce(length(full_seq), 0) AS length FROM chains), k AS (SELECT DISTINCT target_id FROM chains)
            SELECT k.target_id, p AS place, coalesce(length, 0) AS length, length IS NULL AS is_padding FROM k CROSS JOIN range(0, 4) r(p) LEFT JOIN c ON c.target_id = k.target_id AND c.place = p""",
        "fixed_sizes": """WITH l AS (SELECT chain_id, list_transform(regions, lambda r: length(r)) AS n FROM chains WHERE len(regions) = 7), m AS (SELECT chain_id, list_sum(n) AS total, list_sum(n[1:5]) AS a, n[6] AS c FROM l), k AS (SELECT *, greatest(0, least(128, a + c) - least(128, a)) AS blank FROM m)
            SELECT chain_id, 128 AS n, CAST(greatest(0, 128 - total) AS BIGINT) AS padding, CAST(blank AS BIGINT) AS blank FROM k""",
        "spatial_crops": """WITH e AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), f AS (SELECT label, arg_min(x, vec_id) AS cx, arg_min(y, vec_id) AS cy, arg_min(z, vec_id) AS cz FROM e GROUP BY label),
            g AS (SELECT label, vec_id, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS d FROM e JOIN f USING (label)) SELECT label, vec_id, round(d, 6) AS distance FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(d, 9), vec_id) <= 40""",
        "crop_budgets": """WITH c AS (SELECT target_id, ord, chain_id, coalesce(length(full_seq), 0) AS n, coalesce(sum(coalesce(length(full_seq), 0)) OVER (PARTITION BY target_id ORDER BY ord, chain_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM chains),
            g AS (SELECT *, CAST(least(n, greatest(0, 256 - pre)) AS BIGINT) AS got FROM c) SELECT target_id, CAST(sum(got) AS BIGINT) AS kept, string_agg(CAST(got AS VARCHAR), ',' ORDER BY ord, chain_id) AS "each" FROM g GROUP BY target_id""",
        "epoch_rows": "SELECT file_id, i AS chain_index FROM (SELECT file_id, coalesce(resolution, 0.0) AS r, unnest(range(0, len(seqs))) AS i FROM structures) WHERE r <= 3.0 ORDER BY file_id, i LIMIT 100",
        "structure_features": "SELECT file_id, coalesce(release_date, DATE '2010-01-01') AS release_date, coalesce(resolution, 0.0) AS resolution, unnest(range(0, len(seqs))) AS chain_index, unnest(chain_ids) AS chain, length(unnest(seqs)) AS seq_length FROM structures",
        "clean_atoms": """WITH a AS (SELECT CASE WHEN vec_id % 50 = 1 THEN 's' || vec_id ELSE CAST(label AS VARCHAR) END AS chain, vec_id AS residue, CASE WHEN vec_id % 11 = 0 THEN 'HOH' WHEN vec_id % 5 = 0 THEN 'MET' ELSE 'GLY' END AS aa, CASE WHEN vec_id % 11 <> 0 AND vec_id % 5 = 0 THEN 'SD' ELSE 'CA' END AS atom FROM embeddings)
            SELECT * FROM a WHERE aa <> 'HOH' QUALIFY min(residue) OVER (PARTITION BY chain) <> max(residue) OVER (PARTITION BY chain)""",
        "upsert": """WITH c AS (SELECT concat_ws('_', target_id, name) AS k, chain_id, "ord" % 2 AS o FROM chains WHERE name IS NOT NULL), n AS (SELECT k, o, max(chain_id) AS chain_id FROM c GROUP BY k, o) SELECT k, arg_max(chain_id, o) AS chain_id FROM n GROUP BY k""",
        "knee_distances": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS n FROM v),
            p AS (SELECT a.vec_id, b.vec_id AS other, greatest(0, 1 - list_dot_product(a.n, b.n)) AS d FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE 1 - list_dot_product(a.n, b.n) <= 0.9)
            SELECT vec_id, round(d, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, other) = 5""",
    }
