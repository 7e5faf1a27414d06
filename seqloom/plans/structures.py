"""Queries of the template, geometry, curation and clustering operators over structures, chains and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import columns as C
from seqloom.operators import chains as N
from seqloom.operators import clustering as K
from seqloom.operators import curation as T
from seqloom.operators import features as X
from seqloom.operators import geometry as G
from seqloom.operators import templates as H

CUTOFF = "2015-01-01"


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def struct_chains(spark, d):
    """One row per chain of a structure."""
    s = t(spark, d, "structures")
    e = s.select("file_id", "release_date", "resolution", F.posexplode(F.arrays_zip("chain_ids", "seqs")).alias("chain_ord", "z"))
    return e.select("file_id", "release_date", "resolution", "chain_ord", F.col("z.chain_ids").alias("chain"), F.col("z.seqs").alias("seq"))


def _hits(spark, d):
    """Each heavy chain of a target against the structure that its original name points to."""
    c = t(spark, d, "chains").filter("full_seq is not null").select("chain_id", F.regexp_replace(F.upper("full_seq"), "[^A-Z]", "").alias("query"), H.hit_id(F.col("ori_name")).alias("h"))
    s = struct_chains(spark, d).withColumn("file_id", F.lower("file_id"))
    joined = c.filter("h is not null").select("chain_id", "query", F.col("h.id").alias("file_id"), F.col("h.chain").alias("chain"))
    return joined.join(s, ["file_id", "chain"]).withColumn("template", F.col("seq")).withColumn("aligned_cols", F.least(F.length("query"), F.length("seq")))


def hit_ids(spark, d):
    h = H.hit_id(F.col("ori_name"))
    return t(spark, d, "chains").select("chain_id", h["id"].alias("id"), h["chain"].alias("chain"))


def template_prefilter(spark, d):
    out = H.prefilter(_hits(spark, d), F.lit(CUTOFF).cast("date"))
    return out.select("chain_id", "file_id", "chain_ord", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"))


def template_scores(spark, d):
    h = _hits(spark, d)
    n = F.least(F.length("query"), F.length("template"))
    return h.select("chain_id", "file_id", "chain_ord", F.round(H.hit_score(F.substring("query", F.lit(1), n), F.substring("template", F.lit(1), n)), 6).alias("score"))


def locate_chain(spark, d):
    h = _hits(spark, d).filter("length(template) > 0").select("chain_id", "file_id", "chain", "template").distinct()
    s = struct_chains(spark, d).select(F.lower("file_id").alias("file_id"), "chain", "seq", "chain_ord")
    return H.locate_chain(h, s, ["chain_id", "file_id", "template"]).select("chain_id", "file_id", "template", F.col("how").cast("long").alias("how"), "chain")


def id_closure(spark, d):
    """Replacement chains: each part points to half its number, down to the odd ones."""
    p = t(spark, d, "part").filter("p_partkey % 2 = 0 and p_partkey > 0").select(F.col("p_partkey").cast("string").alias("from_id"), (F.col("p_partkey") / 2).cast("long").cast("string").alias("to_id"))
    return H.closure(p)


def release_dates(spark, d):
    dates = t(spark, d, "structures").select(F.col("file_id").alias("id"), "release_date")
    return N.with_release_date(t(spark, d, "chains").select("chain_id", "ori_name"), F.substring("ori_name", 1, 4), dates, F.lit(CUTOFF).cast("date")).select("chain_id", "release_date", "passes")


def index_arrays(spark, d):
    m = t(spark, d, "msa_rows")
    a = H.index_array(F.upper("seq"), 5)
    return m.select("row_id", F.array_max(a).cast("long").alias("last"), F.size(F.filter(a, lambda i: i == -1)).cast("long").alias("n_gaps"))


def residue_maps(spark, d):
    m = t(spark, d, "msa_rows").select("row_id", "msa_id", "row_idx", F.upper("seq").alias("seq"))
    q = m.filter("row_idx = 0").groupBy("msa_id").agg(F.min("seq").alias("q"))
    j = m.filter("row_idx >= 1").join(q, "msa_id")
    j = j.withColumn("iq", H.index_array(F.col("q"), 0)).withColumn("ih", H.index_array(F.col("seq"), 0))
    mapped = F.col("mapped")
    j = j.withColumn("mapped", H.residue_mapping(F.col("q"), F.col("seq"), F.col("iq"), F.col("ih"), F.translate("q", "-", "")))
    total = F.aggregate(F.transform(F.map_entries(mapped), lambda e: e["key"] * 1000 + e["value"]), F.lit(0).cast("long"), lambda s, x: s + x)
    return j.select("row_id", F.size(mapped).cast("long").alias("n"), total.alias("total"))


def quality_filter(spark, d):
    return T.quality_filter(struct_chains(spark, d)).select("file_id", "chain")


def complex_filter(spark, d):
    return T.complex_filter(t(spark, d, "structures")).select("file_id")


def structure_cache(spark, d):
    c = T.structure_cache(struct_chains(spark, d))
    return c.select("file_id", F.array_join("chain_ids", ",").alias("chain_ids"), F.array_join("seqs", ",").alias("seqs"), F.col("no_chains").cast("long").alias("no_chains"))


def _sizes(spark, d):
    lines = struct_chains(spark, d).groupBy("seq").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("_", F.lower("file_id"), F.lower("chain")))), " ").alias("value"))
    return T.cluster_sizes(lines.select("value")).filter("cluster_size > 1")


def chain_cache(spark, d):
    c = struct_chains(spark, d).select(F.concat_ws("_", F.lower("file_id"), F.lower("chain")).alias("chain_id"), "seq")
    out = T.chain_cache(c, _sizes(spark, d).groupBy("chain_id").agg(F.max("cluster_size").alias("cluster_size")))
    return out.select("chain_id", F.col("cluster_size").cast("long").alias("cluster_size"), F.round(T.keep_probability(F.length("seq"), F.col("cluster_size")), 9).alias("keep"))


def stochastic_keep(spark, d):
    c = t(spark, d, "chains").filter("full_seq is not null")
    return T.stochastic_keep(c, T.keep_probability(F.length("full_seq"), F.lit(2)), "chain_id", 3).select("chain_id")


def mixture_draws(spark, d):
    return T.mixture_draws(1000, [("structures", 0.7), ("distilled", 0.3)], spark, 5).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


def _points(spark, d):
    """Embeddings as atoms: the label is the structure, the id the residue, the first dimensions the place."""
    e = t(spark, d, "embeddings")
    return e.select("label", F.col("vec_id").alias("residue"), *[(F.get("embedding", F.lit(i)).cast("double") * 10).alias(c) for i, c in enumerate("xyz")])


def _moved(spark, d):
    return _points(spark, d).withColumns({"x": F.col("x") + F.sin(F.col("residue").cast("double")), "y": F.col("y") * 1.1, "z": F.col("z")})


def centre_distance(spark, d):
    return G.centre_distance(_points(spark, d), ["label"]).select("label", F.round("centre_distance", 6).alias("centre_distance"))


def gdt(spark, d):
    a, b = _points(spark, d), _moved(spark, d).select("label", "residue", *[F.col(c).alias(f"{c}2") for c in "xyz"])
    pairs = a.join(b, ["label", "residue"]).withColumn("d", G.distance("xyz", ["x2", "y2", "z2"]))
    return G.gdt(pairs, ["label"], "d").select("label", F.round("gdt", 6).alias("gdt"))


def lddt(spark, d):
    return G.lddt(_moved(spark, d), _points(spark, d), ["label"], "residue").select("label", "residue", F.round("lddt", 6).alias("lddt"))


def drmsd(spark, d):
    return G.drmsd(_moved(spark, d), _points(spark, d), ["label"], "residue").select("label", F.round("drmsd", 6).alias("drmsd"))


def distogram(spark, d):
    return G.distogram(G.residue_pairs(_points(spark, d), ["label"], "residue"), ["label"]).select("label", F.col("bin").cast("long").alias("bin"), "n")


def neighbour_breaks(spark, d):
    return G.neighbour_breaks(_points(spark, d), ["label"], "residue", 20.0).select("label", "residue", F.round("d", 6).alias("d"), "broken")


def interface(spark, d):
    return G.interface(_points(spark, d).withColumn("one", F.lit(1)), ["one"], "label", "residue", 2.5).select("label", "residue", F.round("min_distance", 6).alias("min_distance"))


def superpose(spark, d):
    a, b = _points(spark, d), _moved(spark, d)
    side = lambda x, n: x.select("label", "residue", *[F.col(c).alias(f"{c}{n}") for c in "xyz"])
    return G.superpose(side(a, 1).join(side(b, 2), ["label", "residue"]), ["label"]).select("label", "n", F.round("rmsd", 6).alias("rmsd"), F.round("aligned_rmsd", 6).alias("aligned_rmsd"))


def _atoms(spark, d):
    """Embeddings as residues: the label is the chain, the id the residue, twelve dimensions the places of four atoms."""
    e = t(spark, d, "embeddings").withColumn("aa", F.substring(F.lit(C.RESIDUES), (F.col("vec_id") % 20 + 1).cast("int"), F.lit(1)))
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 10
    four = F.array(*[F.struct(F.lit(n).alias("atom"), *[at(3 * k + j).alias(c) for j, c in enumerate("xyz")]) for k, n in enumerate(("N", "CA", "C", "CB"))])
    return e.select("label", F.col("vec_id").alias("residue"), "aa", F.explode(four).alias("p")).select("label", "residue", "aa", "p.*").filter("not (aa = 'G' and atom = 'CB')")


def _residues(spark, d):
    return G.residues(_atoms(spark, d), ["label", "residue"])


def residue_atoms(spark, d):
    r = _residues(spark, d)
    return r.select("label", "residue", "aa", "n_atoms", F.round(F.get("CA", F.lit(0)), 6).alias("ca_x"), F.col("CB").isNull().alias("no_cb"))


def pseudo_beta(spark, d):
    return G.pseudo_beta(_atoms(spark, d), ["label", "residue"]).select("label", "residue", *[F.round(c, 6).alias(c) for c in "xyz"])


def torsions(spark, d):
    r = G.amide_bonds(G.backbone_torsions(_residues(spark, d), ["label"], "residue"))
    return r.select("label", "residue", *[F.round(F.cos(a), 6).alias(f"cos_{a}") for a in ("phi", "psi", "omega")], F.round(F.sin("phi"), 6).alias("sin_phi"), "amide", "amide_ok")


def frames(spark, d):
    return G.frames(_residues(spark, d)).select("label", "residue", *[F.round(F.get("frame", F.lit(i)), 6).alias(f"f{i}") for i in range(9)])


def bond_violations(spark, d):
    return G.bond_violations(_residues(spark, d), ["label"], "residue").select("label", "residue", F.round("bond", 6).alias("bond"), "violates")


def clashes(spark, d):
    a = _atoms(spark, d).withColumn("radius", F.when(F.col("atom") == "N", 1.55).otherwise(1.7)).withColumn("one", F.lit(1)).withColumns({c: F.col(c) * 8 for c in "xyz"})
    return G.clashes(a, ["one"], "label", "residue", "radius").select("c1", "r1", "atom1", "c2", "r2", "atom2", F.round("d", 6).alias("d"))


def rmsd_models(spark, d):
    """Chains as models of one structure: their first residues superposed with each other."""
    p = _points(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("residue")))
    return G.near_models(G.rmsd_matrix(p, "label", "place"), 1e9).select("model", F.round("mean_rmsd", 6).alias("mean_rmsd"))


def aligned_error(spark, d):
    e = t(spark, d, "embeddings")
    return e.select("vec_id", F.round(G.expected_error(F.transform("embedding", lambda v: v.cast("double"))), 6).alias("error"))


def predicted_tm(spark, d):
    e = t(spark, d, "embeddings").select("label", F.col("vec_id").alias("residue"), F.transform("embedding", lambda v: v.cast("double")).alias("logits"))
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return G.template_score(e.join(n, "label").withColumn("on", F.col("residue") % 7), ["label"], "on", "logits", "n").select("label", F.round("ptm", 6).alias("ptm"))


def confident_chains(spark, d):
    e = t(spark, d, "embeddings")
    return e.select("vec_id", X.confident(F.transform("embedding", lambda v: v.cast("double") * 100)).alias("confident"))


def _mapped(spark, d):
    h = _hits(spark, d).select("chain_id", "file_id", "chain_ord", "query", "template")
    n = F.least(F.length("query"), F.length("template"))
    pair = h.select("chain_id", "file_id", "chain_ord", F.length("query").alias("length"), F.explode(F.sequence(F.lit(0), n - 1)).alias("q"), "query", "template").withColumn("h", F.col("q"))
    same = F.substring("query", F.col("q") + 1, F.lit(1)) == F.substring("template", F.col("h") + 1, F.lit(1))
    return h, pair.filter(same).select("chain_id", "file_id", "chain_ord", "q", "h")


def template_features(spark, d):
    """Template residues at the positions at which they agree with the query, and empty templates where there are too few."""
    h, mapping = _mapped(spark, d)
    keys = ["chain_id", "file_id", "chain_ord"]
    atoms = h.select(*keys, F.posexplode(C.chars(F.col("template"))).alias("h", "letter")).withColumns({"x": F.col("h") * 1.5, "y": F.lit(1.0), "z": F.col("chain_ord") * 1.0})
    queries = h.select(*keys, F.length("query").alias("length"))
    out = H.templates_or_empty(H.place_template(mapping, atoms, queries, keys), queries, keys)
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("mask").alias("placed"), F.round(F.sum("x"), 6).alias("x"))


def own_templates(spark, d):
    """Each chain's own structure as its template."""
    c = t(spark, d, "chains").filter("length(full_seq) > 0").select("chain_id", F.length("full_seq").alias("length"))
    return H.identity_mapping(c, ["chain_id"]).groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("q") - F.col("h"))).alias("off"))


def realigned_hits(spark, d):
    h = _hits(spark, d)
    n = F.least(F.length("query"), F.length("template"))
    return h.select("chain_id", "file_id", "chain_ord", H.realigned(F.substring("query", F.lit(1), n), F.substring("template", F.lit(1), n)).alias("same"))


def search_inputs(spark, d):
    c = t(spark, d, "chains")
    extra = F.length("full_seq") - F.aggregate(C.region_lengths(F.col("regions")), F.lit(0), lambda a, x: a + x)
    paired = F.col("chain_type").isNotNull() & (F.col("chain_id") % 2 == 0)
    return c.select("chain_id", H.search_input(paired, F.greatest(extra, F.lit(0)), F.lit(0)).alias("input"))


def weighted_template_scores(spark, d):
    """Hits of heavy chains, scored by the weights of their regions."""
    r = t(spark, d, "chains").filter("size(regions) = 7 and chain_type = 'H'").select("chain_id", H.region_hit_weights(C.region_lengths(F.col("regions"))).alias("weights"))
    j = _hits(spark, d).join(r, "chain_id").withColumn("n", F.least(F.length("query"), F.length("template"), F.size("weights")))
    cut = lambda c: F.substring(c, F.lit(1), F.col("n"))
    return j.select("chain_id", "file_id", "chain_ord", F.round(H.hit_score(cut("query"), cut("template"), F.slice("weights", F.lit(1), F.col("n"))), 6).alias("score"))


def confidence(spark, d):
    e = t(spark, d, "embeddings")
    return e.select("vec_id", F.round(G.expected_confidence(F.transform(F.slice("embedding", 1, 50), lambda v: v.cast("double"))), 6).alias("confidence"))


def cosine_pairs(spark, d):
    return K.blocked_pairs(t(spark, d, "embeddings"), "vec_id", "embedding", 0.6).select("a", "b", F.round("distance", 6).alias("distance"))


def representatives(spark, d):
    return K.representatives(t(spark, d, "embeddings"), "label", "vec_id", "embedding", 16).select("label", "vec_id", "centre", F.col("rank").cast("long").alias("rank"))


def nearest_centre(spark, d):
    e = t(spark, d, "embeddings")
    return K.nearest_centre(e, e.filter("vec_id % 10 = 0"), "vec_id", "embedding").select("vec_id", "centre", F.round("agreement", 6).alias("agreement"))


def joint_clusters(spark, d):
    c = t(spark, d, "bucket_store").filter("cdr1_len is not null and cdr2_len is not null and chain_type is not null and cdr3_len is not null")
    base = c.select(F.col("chain_type").alias("target"), (F.col("row_ord") % 2).cast("int").alias("chain_idx"), F.floor(F.col("row_ord") / 2).alias("row"), (F.col("cdr1_len") % 4 - 1).alias("label"), (F.col("cdr2_len") % 3 == 0).alias("paired"))
    both = base.filter("paired").groupBy("target", "row").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("target", "row")
    labels = base.filter("paired").join(both, ["target", "row"]).unionByName(base.filter("not paired"))
    return K.joint_clusters(labels, "target").select("target", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), "n_paired", "n_rows")


def density_clusters(spark, d):
    return K.density_clusters(t(spark, d, "embeddings").withColumn("one", F.lit(1)), ["one"], "vec_id", "embedding").select("vec_id", "label")


def kmeans_labels(spark, d):
    return K.kmeans_labels(t(spark, d, "embeddings"), "vec_id", "embedding", 10)


_NAMES = [
    "hit_ids", "template_prefilter", "template_scores", "locate_chain", "id_closure", "release_dates", "index_arrays", "residue_maps", "quality_filter",
    "complex_filter", "structure_cache", "chain_cache", "stochastic_keep", "mixture_draws", "centre_distance", "gdt", "lddt", "drmsd", "distogram",
    "neighbour_breaks", "interface", "superpose", "confidence", "cosine_pairs", "representatives", "nearest_centre", "joint_clusters", "density_clusters",
    "kmeans_labels", "residue_atoms", "pseudo_beta", "torsions", "frames", "bond_violations", "clashes", "rmsd_models", "aligned_error", "predicted_tm",
    "confident_chains", "template_features", "own_templates", "realigned_hits", "search_inputs", "weighted_template_scores",
]


def queries() -> dict:
    return {name: globals()[name] for name in _NAMES}


_S = "WITH s AS (SELECT file_id, release_date, resolution, unnest(chain_ids) AS chain, unnest(seqs) AS seq, unnest(range(0, len(seqs))) AS chain_ord FROM structures)"
_ID = "CASE WHEN regexp_matches(ori_name, '^[a-zA-Z\\d]{{4}}_[a-zA-Z0-9.]+') THEN {} END"
_CHAIN = "regexp_extract(substr(ori_name, 6), '^[a-zA-Z0-9.]+')"
_HITS = f"""{_S}, c AS (SELECT chain_id, regexp_replace(upper(full_seq), '[^A-Z]', '', 'g') AS query, {_ID.format("lower(substr(ori_name, 1, 4))")} AS file_id, {_ID.format(_CHAIN)} AS chain FROM chains WHERE full_seq IS NOT NULL),
    h AS (SELECT chain_id, query, lower(s.file_id) AS file_id, c.chain, chain_ord, release_date, seq AS template, least(length(query), length(seq)) AS aligned_cols FROM c JOIN s ON c.file_id = lower(s.file_id) AND c.chain = s.chain)"""
_A = "WITH a AS (SELECT label, vec_id AS residue, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z FROM embeddings), b AS (SELECT label, residue, x + sin(CAST(residue AS DOUBLE)) AS x, y * 1.1 AS y, z FROM a)"
_D = lambda p, q: f"sqrt(({p}.x - {q}.x) * ({p}.x - {q}.x) + ({p}.y - {q}.y) * ({p}.y - {q}.y) + ({p}.z - {q}.z) * ({p}.z - {q}.z))"
_PAIRS = f"{_A}, p AS (SELECT u.label, u.residue AS r1, v.residue AS r2, {_D('u', 'v')} AS d FROM a u JOIN a v ON u.label = v.label AND u.residue < v.residue), q AS (SELECT u.label, u.residue AS r1, v.residue AS r2, {_D('u', 'v')} AS e FROM b u JOIN b v ON u.label = v.label AND u.residue < v.residue)"
_SHARE = lambda s: f"list_max(list_transform(range(1, length({s}) + 1), lambda i: length({s}) - length(replace({s}, substr({s}, i, 1), '')))) / length({s})"
_PLACE = lambda k: f"[{', '.join(f'CAST(embedding[{3 * k + j}] AS DOUBLE) * 10' for j in (1, 2, 3))}]"
_ATOMS = f"WITH a AS (SELECT label, vec_id AS residue, substr('ACDEFGHIKLMNPQRSTVWY', CAST(vec_id % 20 + 1 AS INTEGER), 1) AS aa, {_PLACE(0)} AS N, {_PLACE(1)} AS CA, {_PLACE(2)} AS C, {_PLACE(3)} AS CB FROM embeddings)"
_SUB = lambda p, q: f"[{', '.join(f'{p}[{i}] - {q}[{i}]' for i in (1, 2, 3))}]"
_CROSS = lambda p, q: f"[({p})[2] * ({q})[3] - ({p})[3] * ({q})[2], ({p})[3] * ({q})[1] - ({p})[1] * ({q})[3], ({p})[1] * ({q})[2] - ({p})[2] * ({q})[1]]"


def _DIHEDRAL(a, b, c, d):  # noqa: N802
    u, v, w = _SUB(b, a), _SUB(c, b), _SUB(d, c)
    m, n = _CROSS(u, v), _CROSS(v, w)
    return f"CASE WHEN {a} IS NOT NULL AND {d} IS NOT NULL THEN atan2(list_dot_product({_CROSS(m, n)}, {v}) / sqrt(list_dot_product({v}, {v})), list_dot_product({m}, {n})) END"


_V = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, e, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS n FROM v)"


def oracle_sql() -> dict[str, str]:
    return {
        "hit_ids": f"SELECT chain_id, {_ID.format('lower(substr(ori_name, 1, 4))')} AS id, {_ID.format(_CHAIN)} AS chain FROM chains",
        "template_prefilter": f"""{_HITS} SELECT chain_id, file_id, CAST(chain_ord AS INTEGER) AS chain_ord, CASE WHEN release_date > DATE '{CUTOFF}' THEN 'date' WHEN aligned_cols / length(query) <= 0.1 THEN 'ratio'
            WHEN strpos(query, template) > 0 AND length(template) / length(query) > 0.95 THEN 'duplicate' WHEN length(template) < 10 THEN 'length' ELSE '' END AS reject_reason FROM h""",
        "template_scores": f"{_HITS} SELECT chain_id, file_id, CAST(chain_ord AS INTEGER) AS chain_ord, round(list_sum(list_transform(range(1, aligned_cols + 1), lambda i: CASE WHEN substr(query, i, 1) = substr(template, i, 1) THEN 1.0 ELSE -1.0 END)) / aligned_cols, 6) AS score FROM h",
        "locate_chain": f"""{_HITS}, x AS (SELECT DISTINCT chain_id, file_id, chain AS named, template FROM h WHERE length(template) > 0),
            j AS (SELECT x.chain_id, x.file_id, x.template, s.chain, s.chain_ord, CASE WHEN strpos(seq, x.template) > 0 AND s.chain = x.named THEN 1 WHEN strpos(seq, x.template) > 0 THEN 2 WHEN regexp_matches(seq, replace(x.template, 'X', '.')) THEN 3 END AS how FROM x JOIN s ON lower(s.file_id) = x.file_id)
            SELECT chain_id, file_id, template, how, chain FROM j WHERE how IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chain_id, file_id, template ORDER BY how, chain_ord, chain) = 1""",
        "id_closure": "WITH RECURSIVE r AS (SELECT p_partkey AS k, p_partkey // 2 AS n FROM part WHERE p_partkey % 2 = 0 AND p_partkey > 0 UNION ALL SELECT k, n // 2 FROM r WHERE n % 2 = 0) SELECT CAST(k AS VARCHAR) AS from_id, CAST(n AS VARCHAR) AS to_id FROM r WHERE n % 2 = 1",
        "release_dates": f"SELECT chain_id, s.release_date, coalesce(s.release_date <= DATE '{CUTOFF}', true) AS passes FROM chains LEFT JOIN (SELECT lower(file_id) AS id, min(release_date) AS release_date FROM structures GROUP BY 1) s ON lower(substr(ori_name, 1, 4)) = s.id",
        "index_arrays": "SELECT row_id, CASE WHEN replace(seq, '-', '') = '' THEN -1 ELSE 4 + length(replace(seq, '-', '')) END AS last, length(seq) - length(replace(seq, '-', '')) AS n_gaps FROM msa_rows",
        "residue_maps": """WITH m AS (SELECT row_id, msa_id, row_idx, upper(seq) AS seq FROM msa_rows), q AS (SELECT msa_id, min(seq) AS q FROM m WHERE row_idx = 0 GROUP BY msa_id),
            c AS (SELECT row_id, i, length(replace(substr(q, 1, i), '-', '')) - 1 AS k, length(replace(substr(seq, 1, i), '-', '')) - 1 AS h, substr(q, i, 1) <> '-' AND substr(seq, i, 1) <> '-' AS ok FROM (SELECT row_id, q, seq, CAST(unnest(range(1, length(q) + 1)) AS INTEGER) AS i FROM m JOIN q USING (msa_id) WHERE row_idx >= 1))
            SELECT row_id, count(*) FILTER (ok) AS n, CAST(coalesce(sum(k * 1000 + h) FILTER (ok), 0) AS BIGINT) AS total FROM c GROUP BY row_id""",
        "quality_filter": f"{_S} SELECT file_id, chain FROM s WHERE (resolution IS NULL OR resolution <= 9) AND {_SHARE('seq')} <= 0.8",
        "complex_filter": f"""SELECT file_id FROM structures WHERE resolution <= 9 AND list_sum(list_transform(seqs, lambda x: length(x))) >= 200 AND list_bool_and(list_transform(seqs, lambda x: regexp_full_match(x, '[ACDEFGHIKLMNPQRSTVWY]+')))
            AND list_bool_and(list_transform(seqs, lambda x: list_max(list_transform(split(x, ''), lambda c: length(x) - length(replace(x, c, '')))) / length(x) <= 0.8))""",
        "structure_cache": f"{_S} SELECT file_id, string_agg(chain, ',' ORDER BY chain_ord) AS chain_ids, string_agg(seq, ',' ORDER BY chain_ord) AS seqs, count(*) AS no_chains FROM s GROUP BY file_id",
        "chain_cache": f"""{_S}, c AS (SELECT lower(file_id) || '_' || lower(chain) AS chain_id, seq FROM s), z AS (SELECT seq, count(DISTINCT chain_id) AS n FROM c GROUP BY seq HAVING count(DISTINCT chain_id) > 1), y AS (SELECT chain_id, max(n) AS n FROM c JOIN z USING (seq) GROUP BY chain_id)
            SELECT chain_id, coalesce(n, -1) AS cluster_size, round(CASE WHEN coalesce(n, -1) > 0 THEN 1.0 / n ELSE 1.0 END * greatest(256, least(512, length(seq))) / 512.0, 9) AS keep FROM c LEFT JOIN y USING (chain_id)""",
        "centre_distance": f"{_A}, c AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM a GROUP BY label), m AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM c) SELECT label, round(avg({_D('a', 'm')}), 6) AS centre_distance FROM a, m GROUP BY label",
        "gdt": f"{_A}, p AS (SELECT a.label, {_D('a', 'b')} AS d FROM a JOIN b USING (label, residue)) SELECT label, round((avg((d <= 1)::INT) + avg((d <= 2)::INT) + avg((d <= 4)::INT) + avg((d <= 8)::INT)) / 4, 6) AS gdt FROM p GROUP BY label",
        "lddt": f"""{_PAIRS}, k AS (SELECT p.label, r1, r2, ((abs(d - e) < 0.5)::INT + (abs(d - e) < 1)::INT + (abs(d - e) < 2)::INT + (abs(d - e) < 4)::INT) / 4.0 AS k FROM p JOIN q USING (label, r1, r2) WHERE d < 15)
            SELECT label, r AS residue, round(avg(k), 6) AS lddt FROM (SELECT label, r1 AS r, k FROM k UNION ALL SELECT label, r2, k FROM k) GROUP BY label, r""",
        "drmsd": f"{_PAIRS} SELECT label, round(sqrt(avg((d - e) * (d - e))), 6) AS drmsd FROM p JOIN q USING (label, r1, r2) GROUP BY label",
        "distogram": f"{_PAIRS} SELECT label, CAST(greatest(0, least(63, floor((d - 2.0) / (20.0 / 64)))) AS BIGINT) AS bin, count(*) AS n FROM p GROUP BY 1, 2",
        "neighbour_breaks": f"{_A}, l AS (SELECT label, residue, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS d FROM a WINDOW w AS (PARTITION BY label ORDER BY residue)) SELECT label, residue, round(d, 6) AS d, d > 20 AS broken FROM l WHERE d IS NOT NULL",
        "interface": f"{_A} SELECT u.label, u.residue, round(min({_D('u', 'v')}), 6) AS min_distance FROM a u JOIN a v ON u.label <> v.label AND abs(u.x - v.x) < 2.5 AND {_D('u', 'v')} < 2.5 GROUP BY 1, 2",
        "residue_atoms": f"{_ATOMS} SELECT label, residue, aa, CASE WHEN aa = 'G' THEN 3 ELSE 4 END AS n_atoms, round(CA[1], 6) AS ca_x, aa = 'G' AS no_cb FROM a",
        "pseudo_beta": f"{_ATOMS} SELECT label, residue, round(p[1], 6) AS x, round(p[2], 6) AS y, round(p[3], 6) AS z FROM (SELECT label, residue, CASE WHEN aa = 'G' THEN CA ELSE CB END AS p FROM a)",
        "torsions": f"""{_ATOMS}, w AS (SELECT *, lag(C) OVER o AS pc, lag(CA) OVER o AS pca, lead(N) OVER o AS nn FROM a WINDOW o AS (PARTITION BY label ORDER BY residue)),
            g AS (SELECT label, residue, aa, {_DIHEDRAL('pc', 'N', 'CA', 'C')} AS phi, {_DIHEDRAL('N', 'CA', 'C', 'nn')} AS psi, {_DIHEDRAL('pca', 'pc', 'N', 'CA')} AS omega FROM w),
            k AS (SELECT *, CASE WHEN abs(degrees(omega)) >= 140 THEN 'trans' WHEN abs(degrees(omega)) <= 40 THEN 'cis' WHEN omega IS NOT NULL THEN 'twisted' END AS amide FROM g)
            SELECT label, residue, round(cos(phi), 6) AS cos_phi, round(cos(psi), 6) AS cos_psi, round(cos(omega), 6) AS cos_omega, round(sin(phi), 6) AS sin_phi, amide, amide = 'trans' OR (amide = 'cis' AND aa = 'P') AS amide_ok FROM k""",
        "frames": f"""{_ATOMS}, u AS (SELECT label, residue, {_SUB('C', 'CA')} AS c, {_SUB('N', 'CA')} AS n FROM a), v AS (SELECT *, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS f FROM u),
            w AS (SELECT *, list_transform(range(1, 4), lambda i: n[i] - list_dot_product(f, n) * f[i]) AS s0 FROM v), x AS (SELECT *, list_transform(s0, lambda y: y / sqrt(list_dot_product(s0, s0))) AS s FROM w), y AS (SELECT *, {_CROSS('f', 's')} AS t FROM x)
            SELECT label, residue, {", ".join(f"round({v}[{i % 3 + 1}], 6) AS f{i}" for i, v in enumerate(["f"] * 3 + ["s"] * 3 + ["t"] * 3))} FROM y""",
        "bond_violations": f"""{_ATOMS}, w AS (SELECT *, lag(C) OVER (PARTITION BY label ORDER BY residue) AS pc FROM a), b AS (SELECT label, residue, aa, sqrt(list_sum(list_transform(range(1, 4), lambda i: (N[i] - pc[i]) ** 2))) AS bond FROM w WHERE pc IS NOT NULL)
            SELECT label, residue, round(bond, 6) AS bond, abs(bond - CASE WHEN aa = 'P' THEN 1.341 ELSE 1.329 END) > 12 * CASE WHEN aa = 'P' THEN 0.016 ELSE 0.014 END AS violates FROM b""",
        "clashes": f"""{_ATOMS}, p AS (SELECT label, residue, 'N' AS atom, 1.55 AS r, N AS p FROM a UNION ALL SELECT label, residue, 'CA', 1.7, CA FROM a UNION ALL SELECT label, residue, 'C', 1.7, C FROM a UNION ALL SELECT label, residue, 'CB', 1.7, CB FROM a WHERE aa <> 'G'),
            m AS (SELECT u.label AS c1, u.residue AS r1, u.atom AS atom1, v.label AS c2, v.residue AS r2, v.atom AS atom2, u.r + v.r - 1.5 AS most, sqrt((8 * (u.p[1] - v.p[1])) ** 2 + (8 * (u.p[2] - v.p[2])) ** 2 + (8 * (u.p[3] - v.p[3])) ** 2) AS d
              FROM p u JOIN p v ON (u.label < v.label OR (u.label = v.label AND v.residue - u.residue > 1)) AND abs(u.p[1] - v.p[1]) < 0.5)
            SELECT c1, r1, atom1, c2, r2, atom2, round(d, 6) AS d FROM m WHERE d < most""",
        "aligned_error": "WITH l AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), w AS (SELECT vec_id, list_transform(e, lambda x: exp(x - list_max(e))) AS w FROM l) SELECT vec_id, round(list_sum(list_transform(w, lambda x, i: x * (i - 0.5) * 31.0 / (len(w) - 1))) / list_sum(w), 6) AS error FROM w",
        "predicted_tm": """WITH l AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, count(*) OVER (PARTITION BY label) AS n FROM embeddings), w AS (SELECT label, vec_id, 1.24 * (greatest(n, 19) - 15) ** (1.0 / 3) - 1.8 AS d0, list_transform(e, lambda x: exp(x - list_max(e))) AS w FROM l),
            v AS (SELECT label, vec_id % 7 AS r, avg(list_sum(list_transform(w, lambda x, i: x / (1 + ((i - 0.5) * 31.0 / (len(w) - 1) / d0) ** 2))) / list_sum(w)) AS v FROM w GROUP BY 1, 2) SELECT label, round(max(v), 6) AS ptm FROM v GROUP BY label""",
        "confident_chains": "SELECT vec_id, list_max(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 100)) > 50 AS confident FROM embeddings",
        "template_features": f"""{_HITS}, k AS (SELECT chain_id, file_id, chain_ord, length(query) AS n, list_filter(range(0, aligned_cols), lambda i: substr(query, i + 1, 1) = substr(template, i + 1, 1)) AS places FROM h)
            SELECT chain_id, file_id, CAST(chain_ord AS INTEGER) AS chain_ord, n, CAST(CASE WHEN len(places) < 5 THEN 0 ELSE len(places) END AS BIGINT) AS placed, round(CASE WHEN len(places) < 5 THEN 0 ELSE list_sum(places) * 1.5 END, 6) AS x FROM k""",
        "own_templates": "SELECT chain_id, length(full_seq) AS n, CAST(0 AS BIGINT) AS off FROM chains WHERE length(full_seq) > 0",
        "realigned_hits": f"{_HITS} SELECT chain_id, file_id, CAST(chain_ord AS INTEGER) AS chain_ord, len(list_filter(range(1, aligned_cols + 1), lambda i: substr(query, i, 1) = substr(template, i, 1))) >= 0.9 * aligned_cols AS same FROM h",
        "search_inputs": "SELECT chain_id, CASE WHEN chain_type IS NOT NULL AND chain_id % 2 = 0 AND coalesce(greatest(length(full_seq) - list_sum(list_transform(regions, lambda r: length(r))), 0), 0) = 0 THEN 'alignment' ELSE 'query' END AS input FROM chains",
        "weighted_template_scores": f"""{_HITS}, r AS (SELECT chain_id, regions FROM chains WHERE len(regions) = 7 AND chain_type = 'H'),
            j AS (SELECT chain_id, file_id, chain_ord, query, template, repeat('1', length(regions[1])) || repeat('3', length(regions[2])) || repeat('1', length(regions[3])) || repeat('3', length(regions[4])) || repeat('0', length(regions[5]) + length(regions[6]) + length(regions[7])) AS w FROM h JOIN r USING (chain_id)),
            n AS (SELECT *, least(length(query), length(template), length(w)) AS n FROM j)
            SELECT chain_id, file_id, CAST(chain_ord AS INTEGER) AS chain_ord, round(list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN substr(query, i, 1) = substr(template, i, 1) THEN 1.0 ELSE -1.0 END * CAST(substr(w, i, 1) AS INTEGER))) / list_sum(list_transform(range(1, n + 1), lambda i: CAST(substr(w, i, 1) AS INTEGER))), 6) AS score FROM n""",
        "confidence": "WITH l AS (SELECT vec_id, list_transform(embedding[1:50], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), w AS (SELECT vec_id, list_transform(e, lambda x: exp(x - list_max(e))) AS w FROM l) SELECT vec_id, round(100 * list_sum(list_transform(w, lambda x, i: x * (i - 0.5) / 50)) / list_sum(w), 6) AS confidence FROM w",
        "cosine_pairs": f"{_V} SELECT p.vec_id AS a, q.vec_id AS b, round(greatest(0, 1 - list_dot_product(p.n, q.n)), 6) AS distance FROM u p JOIN u q ON p.vec_id < q.vec_id WHERE 1 - list_dot_product(p.n, q.n) <= 0.6",
        "representatives": f"""{_V}, m AS (SELECT label, k, avg(x) AS x FROM (SELECT label, unnest(n) AS x, unnest(range(1, len(n) + 1)) AS k FROM u) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY k) AS mean FROM m GROUP BY label),
            f AS (SELECT u.label, vec_id, n, round(1 - list_dot_product(n, mean), 9) AS far FROM u JOIN c USING (label)), z AS (SELECT label, arg_min(vec_id, struct_pack(a := far, b := vec_id)) AS centre, arg_min(n, struct_pack(a := far, b := vec_id)) AS cn FROM f GROUP BY label)
            SELECT label, vec_id, centre, rank FROM (SELECT f.label, vec_id, centre, row_number() OVER (PARTITION BY f.label ORDER BY (vec_id = centre) DESC, round(greatest(0, 1 - list_dot_product(n, cn)), 9), vec_id) AS rank FROM f JOIN z ON f.label = z.label) WHERE rank <= 16""",
        "nearest_centre": f"{_V}, p AS (SELECT a.vec_id, c.vec_id AS centre, round(list_dot_product(a.e, c.e), 9) AS agreement FROM u a, u c WHERE c.vec_id % 10 = 0) SELECT vec_id, centre, round(agreement, 6) AS agreement FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY agreement DESC, centre) = 1",
        "joint_clusters": """WITH b AS (SELECT chain_type AS target, row_ord % 2 AS c, row_ord // 2 AS r, cdr1_len % 4 - 1 AS label, cdr2_len % 3 = 0 AS paired FROM bucket_store WHERE cdr1_len IS NOT NULL AND cdr2_len IS NOT NULL AND chain_type IS NOT NULL AND cdr3_len IS NOT NULL),
            p AS (SELECT target, r, string_agg(CAST(label AS VARCHAR), ',' ORDER BY c) AS labels, min(label) AS low, list(label ORDER BY c) AS ls FROM b WHERE paired GROUP BY target, r HAVING count(*) = 2),
            tp AS (SELECT target, labels, any_value(ls) AS ls, count(*) AS n_paired FROM p WHERE low > -1 GROUP BY target, labels), sg AS (SELECT target, c, label, count(*) AS n FROM b WHERE NOT paired GROUP BY ALL)
            SELECT target, labels, n_paired, n_paired + CAST(coalesce((SELECT sum(n) FROM sg WHERE sg.target = tp.target AND ls[c + 1] = label), 0) AS BIGINT) AS n_rows FROM tp
            WHERE n_paired >= 3 AND n_paired + coalesce((SELECT sum(n) FROM sg WHERE sg.target = tp.target AND ls[c + 1] = label), 0) > 15""",
    }
