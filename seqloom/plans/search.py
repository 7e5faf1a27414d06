"""Queries of the search, scalar and join operators over chains, bucket_store and bucket_catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import columns as C
from seqloom.operators import chains as N
from seqloom.operators import features as X
from seqloom.operators import msa, search
from seqloom.operators.ranking import competition_rank, place_in_group
from seqloom.operators.ranking import ranking_metric as metric

BAND = [10, 2, 10, 2, 10, 4, 5]
START = [10, 0, 0, 0, 0, 0, 5]
START_L = [10, 0, 10, 0, 10, 0, 10]
START_PAIR = [16, 0, 2, 0, 5, 0, 10, 16, 0, 2, 0, 2, 0, 10]
MIN_ROWS, CAP = 300, 50


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def region_store(spark: SparkSession, d: str) -> DataFrame:
    """Chains with seven regions, and their lengths."""
    return t(spark, d, "chains").filter(F.size("regions") == 7).withColumn("lens", C.region_lengths(F.col("regions")))


def query_chains(spark: SparkSession, d: str, heavy: list[int], light: list[int]) -> DataFrame:
    """The queries: every chain with regions whose id is divisible by 20, with the tolerance of its type."""
    of_type = F.when(F.col("chain_type") == "L", F.lit(light)).otherwise(F.lit(heavy))
    return region_store(spark, d).filter("chain_id % 20 = 0").select(F.col("chain_id").alias("query_id"), F.col("chain_type").alias("query_type"), F.col("lens").alias("target"), of_type.alias("tolerance"), F.get("regions", F.lit(5)).alias("query_cdr3"))


def band_filter_all(spark, d):
    return search.band_filter_all(region_store(spark, d), query_chains(spark, d, BAND, BAND), "lens").select("query_id", "chain_id", "chain_type")


def _relaxed_all(spark, d):
    return search.relaxed_search_all(region_store(spark, d), query_chains(spark, d, START, START_L), "lens", 7, MIN_ROWS, CAP)


def relaxed_search_all(spark, d):
    return _relaxed_all(spark, d).select("query_id", "chain_id", "entry")


def search_top_k_all(spark, d):
    near = _relaxed_all(spark, d).withColumn("cdr3", F.get("regions", F.lit(5))).filter(F.length("cdr3") == F.length("query_cdr3"))
    near = near.withColumn("distance", C.symbol_hamming(F.col("cdr3"), F.col("query_cdr3")))
    return competition_rank(near, ["query_id"], "distance", descending=False).filter("rank < 20").select("query_id", "chain_id", "distance", F.col("rank").cast("long").alias("rank"))


def substitution_search(spark, d):
    """Chains of the query's type within the widening band: at least 1,000, of more than 10,000 the close ones, 10,000 at most."""
    store, most = region_store(spark, d).withColumn("cdr3", F.get("regions", F.lit(5))), 10_000
    parts = []
    for kind, start in (("H", START), ("L", START_L)):
        own = store.filter(F.col("chain_type") == kind)
        limits = search.length_limits(own, "lens", 7).withColumn("quantile", F.transform("longest", lambda x: x.cast("double")))  # here the longest regions are the reference too
        asked = search.clamp_targets(query_chains(spark, d, start, start).filter(F.col("query_type") == kind), limits)
        parts.append(search.relaxed_search_all(own, asked, "lens", 7, 1000, 50))
    found = search.keep_close(parts[0].unionByName(parts[1]), [("cdr3", "query_cdr3")], most, "query_id", "chain_id", cut=True)
    return found.select("query_id", "chain_id", "entry")


def pair_store(spark: SparkSession, d: str) -> DataFrame:
    """Heavy and light chains of a target with fourteen regions."""
    one = lambda k: region_store(spark, d).select(F.col("chain_id").alias(k), F.col("regions").alias(f"{k}_regions"))
    pairs = msa.positional_pairs(t(spark, d, "chains")).filter("heavy is not null and light is not null").select("heavy", "light")
    both = pairs.join(one("heavy"), "heavy").join(one("light"), "light").withColumn("regions", F.concat("heavy_regions", "light_regions")).drop("heavy_regions", "light_regions")
    return both.withColumn("lens", C.region_lengths(F.col("regions"))).withColumn("cdr3", F.get("regions", F.lit(5))).withColumn("light_cdr3", F.get("regions", F.lit(12)))


def paired_search(spark, d):
    """Pairs within the widening band over fourteen regions: at least 2,000, of more than 50,000 those with close heavy CDR3."""
    store = pair_store(spark, d)
    asked = store.filter("heavy % 20 = 0").select(F.col("heavy").alias("query_id"), F.col("light").alias("query_light"), F.col("lens").alias("target"), F.lit(START_PAIR).alias("tolerance"), F.col("cdr3").alias("query_cdr3"))
    asked = search.clamp_targets(asked, search.length_limits(store, "lens", 14))
    found = search.relaxed_search_all(store, asked, "lens", 14, 2000, 100)
    return search.keep_close(found, [("cdr3", "query_cdr3")], 50_000, "query_id", "heavy", cut=False).select("query_id", "query_light", "heavy", "light", "entry")


def _cdr3_pairs(spark, d):
    """Every stored chain with every query of its CDR3 length: query_id, row_ord, cdr3, n, and the popcount distance.

    CDR3s of capital letters are packed into three numbers once a row, so that a pair costs a few operations on numbers, without
    arrays. Whether there are others is asked first; only then their pairs are added: those of ASCII texts of up to 35 characters
    by more numbers, the rest by characters. No column of the result is one that can be null, unless a row_ord is: a writer keeps
    no levels for such columns. The queries are the side that is hashed: neither side is sorted. A task has one block of the rows
    and all queries, so that tasks are even, whatever the lengths; their number is set by the pairs and not by the bytes of the
    two sides, which are few.
    """
    tasks = max(96, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = query_chains(spark, d, START, START_L).select(F.coalesce("query_id", F.lit(0)).alias("query_id"), F.col("query_cdr3").alias("cdr3"))  # ids divisible by 20 aren't null
    store = t(spark, d, "bucket_store").select("row_ord", "cdr3")
    asked, store = (df.filter("length(cdr3) > 0").withColumn("usual", C.fits_letters(F.col("cdr3"))) for df in (asked, store))
    odd_queries = asked.agg(F.max(~F.col("usual"))).first()[0]
    odd_rows, nameless = store.agg(F.max(~F.col("usual")), F.max(F.col("row_ord").isNull())).first()
    if not nameless:
        store = store.withColumn("row_ord", F.coalesce("row_ord", F.lit(0)))

    def pairs(rows, queries, packed, distance):
        words = lambda df, k: df.withColumn("n", F.length("cdr3")).withColumns({f"{k}{i}": w for i, w in enumerate(packed(F.col("cdr3")))}).drop("usual")
        rows = words(rows, "a").withColumn("block", F.pmod(F.xxhash64("row_ord", "cdr3"), F.lit(tasks)).cast("int"))
        queries = words(queries, "b").withColumnRenamed("cdr3", "query_cdr3").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
        rows, queries = (df.repartitionById(tasks, F.col("block")) for df in (rows, queries))
        return rows.join(queries.hint("shuffle_hash"), ["n", "block"]).select("query_id", "row_ord", "cdr3", "n", distance.cast("long").alias("distance"))

    at = lambda k, count: [F.col(f"{k}{i}") for i in range(count)]
    found = pairs(store.filter("usual"), asked.filter("usual"), C.packed_letters, C.packed_popcount(at("a", C.LETTER_WORDS), at("b", C.LETTER_WORDS)))
    fit = lambda text: [F.when(C.fits_packed(text), w) for w in C.packed(text)]
    other = F.coalesce(C.packed_popcount(at("a", C.PACK_WORDS), at("b", C.PACK_WORDS)), C.popcount_hamming(F.col("cdr3"), F.col("query_cdr3")), F.lit(0))  # never null, as the lengths are the same
    if odd_rows:
        found = found.unionAll(pairs(store.filter("not usual"), asked, fit, other))
    if odd_queries:
        found = found.unionAll(pairs(store.filter("usual"), asked.filter("not usual"), fit, other))
    return found


def close_cdr3(spark, d):
    return _cdr3_pairs(spark, d).filter(F.col("distance") <= F.floor(F.col("n") * 1.6)).select("query_id", "row_ord", "cdr3")


def popcount_hamming(spark, d):
    return _cdr3_pairs(spark, d).select("query_id", "row_ord", "distance")


def weighted_hamming(spark, d):
    """Weights are half the places."""
    store = t(spark, d, "bucket_store").select("row_ord", F.col("cdr3").alias("text"))
    asked = query_chains(spark, d, START, START_L).select("query_id", F.col("query_cdr3").alias("text"))
    return search.place_distances(store, asked, max(96, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def length_limits(spark, d):
    one = search.length_limits(region_store(spark, d), "lens", 7)
    return one.select(F.posexplode(F.arrays_zip("longest", "quantile")).alias("region", "z")).select("region", F.col("z.longest").cast("long").alias("longest"), F.round("z.quantile", 6).alias("quantile"))


def _bucket_queries(spark, d):
    at = lambda i: F.get("lens", F.lit(i))
    return region_store(spark, d).filter("chain_id % 20 = 0").select(F.col("chain_id").alias("query_id"), "chain_type", at(1).alias("c1"), at(3).alias("c2"), at(5).alias("c3"), F.get("regions", F.lit(5)).alias("cdr3"))


def bucket_choice(spark, d):
    chosen = search.choose_buckets_all(t(spark, d, "bucket_catalog"), _bucket_queries(spark, d))
    return chosen.select("query_id", "path", F.col("distance").cast("long").alias("distance"), F.col("rank").cast("long").alias("rank"))


def unpaired_search(spark, d):
    return search.unpaired_search_all(t(spark, d, "bucket_store"), t(spark, d, "bucket_catalog"), _bucket_queries(spark, d))


def clonotype_search(spark, d):
    c = t(spark, d, "chains").filter("clonotype is not null")
    asked = c.filter("chain_id % 20 = 0").select(F.col("chain_id").alias("query_id"), "clonotype")
    return search.clonotype_search_all(c, "clonotype", asked).select("query_id", "chain_id", F.col("level_diff").cast("long").alias("level_diff"), F.col("level_marks").cast("long").alias("level_marks"))


def clonotype_groups(spark, d):
    return N.group_clonotypes(t(spark, d, "chains"), "clonotype", F.count(F.lit(1)).alias("n"), F.min("chain_id").alias("first_chain"))


def skip_existing(spark, d):
    wanted = t(spark, d, "chains").select(F.concat_ws("_", "target_id", "name").alias("msa_id")).distinct()
    return N.skip_existing(wanted, t(spark, d, "msa_rows"), "msa_id")


def keep_set(spark, d):
    listed = t(spark, d, "structures").select(F.lower("file_id").alias("k"))
    return N.keep_listed(t(spark, d, "chains"), F.substring("ori_name", 1, 4), listed, "k").select("chain_id")


def sliding_windows(spark, d):
    return t(spark, d, "chains").select("chain_id", F.explode(C.sliding_windows(F.col("full_seq"))).alias("w")).select("chain_id", F.col("w.start").cast("long").alias("start"), "w.window")


def region_intervals(spark, d):
    out = region_store(spark, d).select("chain_id", F.posexplode(C.region_intervals(F.col("lens"))).alias("region", "i"))
    return out.select("chain_id", F.col("region").cast("long").alias("region"), F.col("i.s").cast("long").alias("s"), F.col("i.e").cast("long").alias("e"))


def region_vector(spark, d):
    s = region_store(spark, d).withColumn("i", C.region_intervals(F.col("lens")))
    v = s.select("chain_id", F.posexplode(C.region_vector(F.aggregate("lens", F.lit(0), lambda a, x: a + x), F.col("i"))).alias("pos", "region"))
    return v.groupBy("chain_id", F.col("region").cast("long").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("long").alias("first"))


def safe_names(spark, d):
    return N.unique_names(t(spark, d, "chains"), "name", "target_id", "chain_id").select("chain_id", "safe")


def residue_codes(spark, d):
    m = t(spark, d, "msa_rows")
    codes = C.residue_codes(F.col("seq"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return m.select("row_id", total(codes).alias("total"), total(F.transform(C.recode(codes), lambda c, i: c * (i + 1))).alias("mixed"), (C.residue_text(codes) == F.upper("seq")).alias("same"))


def deletion_values(spark, d):
    m = t(spark, d, "msa_rows").filter("deletions is not null")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return m.select("row_id", F.round(total(C.deletion_value(F.col("deletions"))), 6).alias("value"), F.aggregate(C.has_deletion(F.col("deletions")), F.lit(0).cast("long"), lambda s, x: s + x).alias("n_deletions"))


def query_identity(spark, d):
    m = t(spark, d, "msa_rows")
    q = m.filter("row_idx = 0").groupBy("msa_id").agg(F.min(F.upper("seq")).alias("q"))
    return m.join(q, "msa_id").select("row_id", F.round(C.identity_score(F.upper("seq"), F.col("q")), 6).alias("identity"))


def letter_block(spark, d):
    b = C.letter_block(F.upper("seq"))
    return t(spark, d, "msa_rows").select("row_id", b["start"].cast("long").alias("start"), b["end"].cast("long").alias("end"))


def spreadsheet_ids(spark, d):
    return t(spark, d, "chains").select("chain_id", C.spreadsheet_id(F.col("chain_id")).alias("label"))


def contiguous_split(spark, d):
    m = t(spark, d, "msa_rows").select("msa_id", "row_idx", "row_id")
    r = place_in_group(m, ["msa_id"], ["row_idx", "row_id"], "r").join(m.groupBy("msa_id").agg(F.count(F.lit(1)).alias("n")), "msa_id")
    return r.withColumn("bucket", C.contiguous_bucket(F.col("r"), F.col("n"), F.lit(7))).groupBy("msa_id", F.col("bucket").cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("r").cast("long").alias("first"))


def chunk_list(spark, d):
    r = N.chunks(t(spark, d, "msa_rows"), ["msa_id"], ["row_idx", "row_id"], 7)
    return r.groupBy("msa_id", F.col("chunk").cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


def positional_pairs(spark, d):
    return msa.positional_pairs(t(spark, d, "chains"))


def self_pairs(spark, d):
    c = t(spark, d, "chains").filter("chain_type is not null")
    return msa.self_pairs(c, ["target_id"], "chain_type", "chain_id", "chain_id").select("target_id", "first", "second")


def assembly_ids(spark, d):
    c = msa.assembly_ids(t(spark, d, "chains"), "target_id", ["ord", "chain_id"], "full_seq", by_sequence=True)
    return c.select("chain_id", *[F.col(x).cast("long").alias(x) for x in ("asym_id", "entity_id", "sym_id")])


def species_ids(spark, d):
    """Identifiers made of the rows' own numbers, some of them malformed."""
    m = t(spark, d, "msa_rows").select("row_id", F.concat(F.when(F.col("row_id") % 3 == 0, "sp|").otherwise("tr|"), F.lit("A0A8T2NDK"), F.col("row_idx").cast("string"), F.lit("|X_"), F.substring("msa_id", 7, 4), F.lit("/1-9 text")).alias("description"))
    return m.select("row_id", C.species_id(F.col("description")).alias("species"))


def ranking_metric(spark, d):
    """Mean residue codes as confidences: the ranking value of each chain."""
    s = region_store(spark, d)
    mean = lambda i: F.length(F.regexp_replace(F.get("regions", F.lit(i)), "[^A-M]", "")) / F.length(F.get("regions", F.lit(i)))
    h3 = F.when(F.col("chain_type") == "H", mean(5))
    value = metric(h3, mean(1), F.length(F.get("regions", F.lit(1))), mean(0))
    return s.select("chain_id", F.round(value, 6).alias("metric"))


def residue_gap(spark, d):
    return N.residue_offsets(t(spark, d, "chains"), "target_id", ["ord", "chain_id"], "full_seq").select("chain_id", "offset")


def clonotype_join(spark, d):
    c = t(spark, d, "chains")
    return N.with_clonotypes(c, c.select("target_id", "name", "clonotype", F.col("chain_id").alias("at")), ["target_id", "name"], "at").select("chain_id", "last_clonotype")


def target_order(spark, d):
    return N.target_lengths(t(spark, d, "chains"), "target_id", "full_seq")


def region_shift(spark, d):
    """Regions of chains after three residues more in front."""
    s = region_store(spark, d).select("chain_id", F.posexplode(X.shift_regions(C.region_intervals(F.col("lens")), F.lit(3))).alias("region", "i"))
    return s.select("chain_id", F.col("region").cast("long").alias("region"), F.col("i.s").cast("long").alias("s"), F.col("i.e").cast("long").alias("e"))


def substitution_scores(spark, d):
    """Each alignment row against its query under a table made by a rule: 4 for the same letter, -1 for another, -4 for a gap."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ-"
    value = lambda a, b: -4 if "-" in (a, b) else 4 if a == b else -1
    table = C.substitution_table("\n".join([" ".join(letters), *(" ".join([a, *(str(value(a, b)) for b in letters)]) for a in letters)]))
    m = t(spark, d, "msa_rows").select("row_id", "msa_id", "row_idx", F.upper("seq").alias("seq"))
    q = m.filter("row_idx = 0").groupBy("msa_id").agg(F.min("seq").alias("q"))
    score = C.substitution_score(F.col("q"), F.col("seq"), table, frozen=(0, 5), strict_gap=(3,))
    return m.join(q, "msa_id").select("row_id", F.aggregate(score, F.lit(0.0), lambda a, x: a + x).alias("score"))


def fan_out(spark, d):
    c = t(spark, d, "bucket_store").select("row_ord", "cdr3")
    return msa.fan_out(c, "cdr3", F.round(C.largest_share(F.col("cdr3")), 6), "share").select("row_ord", "share")


_NAMES = [
    "band_filter", "relaxed_search", "search_top_k", "close_cdr3", "popcount_hamming", "weighted_hamming", "length_limits", "bucket_choice", "unpaired_search",
    "clonotype_search", "clonotype_groups", "skip_existing", "keep_set", "sliding_windows", "region_intervals", "region_vector", "safe_names", "residue_codes",
    "deletion_values", "query_identity", "letter_block", "spreadsheet_ids", "contiguous_split", "chunk_list", "positional_pairs", "self_pairs", "assembly_ids",
    "species_ids", "region_shift", "substitution_scores", "ranking_metric", "residue_gap", "clonotype_join", "target_order", "fan_out", "substitution_search", "paired_search",
]


def queries() -> dict:
    return {name: globals().get(f"{name}_all") or globals()[name] for name in _NAMES}


_STORE = "WITH s AS (SELECT * FROM chains WHERE len(regions) = 7), q AS (SELECT chain_id AS query_id, chain_type AS qt, regions AS qr FROM s WHERE chain_id % 20 = 0)"
_NEED = lambda n, start: f"list_transform(range(0, {n}), lambda i: greatest(abs(len(r[i+1]) - len(qr[i+1])) - ({start})[i+1], 0))"
_LAST = lambda n: f"list_max(list_transform(range(0, {n}), lambda i: CASE WHEN need[i+1] = 0 THEN 0 ELSE i + {n} * (need[i+1] - 1) + 1 END))"
_STOP = lambda least, cap: f"""g AS (SELECT query_id, query_light, entry, sum(count(*)) OVER (PARTITION BY query_id, query_light ORDER BY entry) AS held FROM f WHERE entry < {cap} GROUP BY query_id, query_light, entry),
    stop AS (SELECT query_id, query_light, coalesce(min(entry) FILTER (held >= {least}), {cap - 1}) AS stop FROM g GROUP BY query_id, query_light),
    got AS (SELECT f.* FROM f JOIN stop ON f.query_id = stop.query_id AND f.query_light IS NOT DISTINCT FROM stop.query_light WHERE entry <= stop AND entry < {cap})"""  # noqa: E731
_START = f"(CASE WHEN qt = 'L' THEN {START_L} ELSE {START} END)"
_ENTRY = lambda same, least: f"""{_STORE}, e AS (SELECT query_id, NULL AS query_light, s.chain_id, s.regions AS r, qr, {_NEED(7, _START).replace("r[i+1]", "s.regions[i+1]", 1)} AS need FROM s JOIN q ON {same}),
    f AS (SELECT *, {_LAST(7)} AS entry FROM e), {_STOP(least, CAP)}"""  # noqa: E731
_CDR3 = f"{_STORE}, p AS (SELECT query_id, row_ord, cdr3, qr[6] AS q FROM bucket_store JOIN q ON length(cdr3) = length(qr[6]) AND length(cdr3) > 0)"
_POP = "list_sum(list_transform(range(1, length(q) + 1), lambda i: bit_count(xor(ascii(substr(cdr3, i, 1)), ascii(substr(q, i, 1))))))"
_PAIRED = """WITH n AS (SELECT chain_id, target_id, chain_type, ori_name, row_number() OVER (PARTITION BY target_id, chain_type ORDER BY ord DESC, chain_id DESC) AS k, count(*) OVER (PARTITION BY target_id, chain_type) AS m FROM chains WHERE chain_type IN ('H', 'L')),
            h AS (SELECT * FROM n WHERE chain_type = 'H'), l AS (SELECT * FROM n WHERE chain_type = 'L'),
            dp AS (SELECT h.target_id, h.chain_id AS heavy, l.chain_id AS light, false AS is_cross FROM h JOIN l ON h.target_id = l.target_id AND h.k = l.k WHERE (h.m = 1 AND l.m = 1) OR h.ori_name IS DISTINCT FROM l.ori_name),
            cp AS (SELECT h.target_id, h.chain_id AS heavy, l.chain_id AS light, true AS is_cross FROM h JOIN l ON h.target_id = l.target_id WHERE h.target_id NOT IN (SELECT target_id FROM dp) AND h.ori_name IS DISTINCT FROM l.ori_name),
            p AS (SELECT * FROM dp UNION ALL SELECT * FROM cp)
    SELECT heavy, light FROM p"""
_PREFIX = lambda g, m: f"(CASE WHEN strpos({g}, '{m}') > 0 THEN substr({g}, 1, strpos({g}, '{m}') - 1) ELSE substr({g}, 1, greatest(length({g}) - 1, 0)) END)"
_SIM = lambda a, b, m: f"({a} = {b} OR {_PREFIX(a, m)} = {_PREFIX(b, m)})"
_LEVEL = lambda k: f"({_SIM('v', 'tv', search.LEVELS[k][0])} AND {_SIM('j', 'tj', search.LEVELS[k][1])})"


def oracle_sql() -> dict[str, str]:
    order = "ACDEFGHIKLMNPQRSTVWYX-"
    perm = [C.INTERNAL_ORDER.index(c) for c in order]
    code = "CASE WHEN strpos('ACDEFGHIKLMNPQRSTVWYX-', c) > 0 THEN strpos('ACDEFGHIKLMNPQRSTVWYX-', c) - 1 ELSE 20 END"
    return {
        "band_filter": f"{_STORE} SELECT query_id, s.chain_id, s.chain_type FROM s, q WHERE list_bool_and(list_transform(range(1, 8), lambda i: abs(len(s.regions[i]) - len(qr[i])) <= ({BAND})[i]))",
        "relaxed_search": f"{_ENTRY('true', MIN_ROWS)} SELECT query_id, chain_id, CAST(entry AS INTEGER) AS entry FROM got",
        "substitution_search": f"{_ENTRY('s.chain_type = qt', 1000)} SELECT query_id, chain_id, CAST(entry AS INTEGER) AS entry FROM got",
        "paired_search": f"""{_STORE}, pp AS ({_PAIRED}), ps AS (SELECT heavy, light, a.regions || b.regions AS r FROM pp JOIN s a ON a.chain_id = heavy JOIN s b ON b.chain_id = light),
            e AS (SELECT x.heavy AS query_id, x.light AS query_light, y.heavy, y.light, x.r AS qr, {_NEED(14, START_PAIR).replace("r[i+1]", "y.r[i+1]", 1).replace("qr[i+1]", "x.r[i+1]")} AS need FROM ps x, ps y WHERE x.heavy % 20 = 0),
            f AS (SELECT *, {_LAST(14)} AS entry FROM e), {_STOP(2000, 100)}
            SELECT query_id, query_light, heavy, light, CAST(entry AS INTEGER) AS entry FROM got""",
        "search_top_k": f"""{_ENTRY('true', MIN_ROWS)}, h AS (SELECT query_id, chain_id, r[6] AS cdr3, qr[6] AS q FROM got WHERE length(r[6]) = length(qr[6])),
            k AS (SELECT query_id, chain_id, CAST(coalesce(list_sum(list_transform(range(1, length(q) + 1), lambda i: CASE WHEN substr(cdr3, i, 1) <> substr(q, i, 1) THEN 1 ELSE 0 END)), 0) AS INTEGER) AS distance FROM h)
            SELECT * FROM (SELECT query_id, chain_id, distance, rank() OVER (PARTITION BY query_id ORDER BY distance) - 1 AS rank FROM k) WHERE rank < 20""",
        "close_cdr3": f"{_CDR3} SELECT query_id, row_ord, cdr3 FROM p WHERE {_POP} <= CAST(floor(length(q) * 1.6) AS INTEGER)",
        "popcount_hamming": f"{_CDR3} SELECT query_id, row_ord, CAST({_POP} AS BIGINT) AS distance FROM p",
        "weighted_hamming": f"""{_CDR3} SELECT query_id, row_ord, CAST(list_sum(list_transform(range(1, length(q) + 1), lambda i: CASE WHEN substr(cdr3, i, 1) <> substr(q, i, 1) THEN 1 ELSE 0 END)) AS BIGINT) AS distance,
            CAST(list_sum(list_transform(range(1, length(q) + 1), lambda i: CASE WHEN substr(cdr3, i, 1) <> substr(q, i, 1) THEN i / 2.0 ELSE 0.0 END)) AS DOUBLE) AS weighted FROM p""",
        "length_limits": f"{_STORE}, l AS (SELECT i AS region, len(regions[i + 1]) AS n FROM s, range(0, 7) r(i)) SELECT CAST(region AS INTEGER) AS region, max(n) AS longest, round(quantile_cont(n, 0.999), 6) AS quantile FROM l GROUP BY region",
        "bucket_choice": f"""{_STORE}, k AS (SELECT query_id, qt, len(qr[2]) AS c1, len(qr[4]) AS c2, len(qr[6]) AS c3 FROM q),
            o AS (SELECT query_id, path, c.ord AS ord, c.cdr3_len = c3 AS own, coalesce(seq_count, 0) AS n, abs(c.cdr1_len - c1) + abs(c.cdr2_len - c2) + abs(c.cdr3_len - c3) AS distance FROM bucket_catalog c JOIN k ON c.chain_type = qt),
            u AS (SELECT * FROM o WHERE distance IS NOT NULL), x AS (SELECT query_id, coalesce(sum(n) FILTER (own), 0) >= 1000 AS exact FROM u GROUP BY query_id),
            r AS (SELECT query_id, path, distance, exact, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY distance, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY query_id ORDER BY distance, ord) - 1 AS rank
              FROM u JOIN x USING (query_id) WHERE NOT exact OR own)
            SELECT query_id, path, CAST(distance AS BIGINT) AS distance, rank FROM r WHERE exact OR before <= 1000""",
        "clonotype_search": f"""WITH c AS (SELECT chain_id, split_part(split_part(clonotype, ';', 1), '|', 1) AS v, split_part(split_part(clonotype, ';', 2), '|', 1) AS j, split_part(clonotype, ';', 3) AS cdr3 FROM chains WHERE clonotype IS NOT NULL),
            tq AS (SELECT chain_id AS query_id, v AS tv, j AS tj, cdr3 AS tc FROM c WHERE chain_id % 20 = 0),
            m AS (SELECT query_id, chain_id, abs(length(cdr3) - length(tc)) AS d, {_LEVEL(0)} AS l0, {_LEVEL(1)} AS l1, {_LEVEL(2)} AS l2 FROM c, tq),
            lv AS (SELECT t.query_id, a.d, k.k, (SELECT count(*) FROM m WHERE m.query_id = t.query_id AND m.d <= a.d AND CASE k.k WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END) AS n FROM tq t, range(0, 10) a(d), range(0, 3) k(k)),
            lw AS (SELECT query_id, d, k FROM lv WHERE n > 100 OR (d = 9 AND k = 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, k) = 1)
            SELECT query_id, chain_id, lw.d AS level_diff, lw.k AS level_marks FROM m JOIN lw USING (query_id) WHERE m.d <= lw.d AND CASE lw.k WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END""",
        "clonotype_groups": "SELECT clonotype, count(*) AS n, min(chain_id) AS first_chain FROM chains WHERE clonotype IS NOT NULL GROUP BY clonotype",
        "skip_existing": "SELECT DISTINCT concat_ws('_', target_id, name) AS msa_id FROM chains WHERE concat_ws('_', target_id, name) NOT IN (SELECT msa_id FROM msa_rows WHERE msa_id IS NOT NULL)",
        "keep_set": "SELECT chain_id FROM chains WHERE substr(ori_name, 1, 4) IN (SELECT lower(file_id) FROM structures)",
        "sliding_windows": """SELECT chain_id, start, CASE WHEN length(full_seq) > 200 THEN substr(full_seq, start + 1, 150) ELSE full_seq END AS "window"
            FROM (SELECT chain_id, full_seq, unnest(CASE WHEN length(full_seq) > 200 THEN range(0, length(full_seq), 100) ELSE [0] END) AS start FROM chains WHERE length(full_seq) > 0)""",
        "region_intervals": f"{_STORE}, l AS (SELECT chain_id, i AS region, len(regions[i + 1]) AS n FROM s, range(0, 7) r(i)) SELECT chain_id, region, CAST(sum(n) OVER w - n AS BIGINT) AS s, CAST(sum(n) OVER w AS BIGINT) AS e FROM l WINDOW w AS (PARTITION BY chain_id ORDER BY region)",
        "region_shift": f"{_STORE}, l AS (SELECT chain_id, i AS region, len(regions[i + 1]) AS n FROM s, range(0, 7) r(i)) SELECT chain_id, region, CAST(sum(n) OVER w - n + 3 AS BIGINT) AS s, CAST(sum(n) OVER w + 3 AS BIGINT) AS e FROM l WINDOW w AS (PARTITION BY chain_id ORDER BY region)",
        "substitution_scores": """WITH m AS (SELECT row_id, msa_id, row_idx, upper(seq) AS seq FROM msa_rows), q AS (SELECT msa_id, min(seq) AS q FROM m WHERE row_idx = 0 GROUP BY msa_id),
            p AS (SELECT row_id, i, substr(q, i, 1) AS a, substr(seq, i, 1) AS b FROM (SELECT row_id, q, seq, CAST(unnest(range(1, length(q) + 1)) AS INTEGER) AS i FROM m JOIN q USING (msa_id)))
            SELECT row_id, CAST(sum(CASE WHEN i = 4 AND b = '-' THEN -50 WHEN a = '-' OR b = '-' THEN -4 WHEN a = b THEN 4 ELSE -1 END) AS DOUBLE) AS score FROM p GROUP BY row_id""",
        "region_vector": f"{_STORE}, l AS (SELECT chain_id, i AS region, len(regions[i + 1]) AS n FROM s, range(0, 7) r(i)), m AS (SELECT chain_id, region + 1 AS region, n, CAST(sum(n) OVER (PARTITION BY chain_id ORDER BY region) - n AS BIGINT) AS first FROM l) SELECT chain_id, region, n, first FROM m WHERE n > 0",
        "safe_names": r"""WITH c AS (SELECT chain_id, target_id, translate(translate(name, '<:"/\|?*+-()[]{}', ''), chr(32) || ',' || chr(13) || chr(10), '____') AS clean FROM chains),
            n AS (SELECT *, row_number() OVER (PARTITION BY target_id, clean ORDER BY chain_id) AS k FROM c)
            SELECT chain_id, CASE WHEN length(clean) = 1 OR k > 1 THEN concat_ws('_', clean, target_id) ELSE clean END AS safe FROM n""",
        "residue_codes": f"""WITH f AS (SELECT row_id, seq, translate(upper(seq), 'BJOUZ', 'DXXCE') AS t FROM msa_rows), e AS (SELECT row_id, seq, t, list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1)) AS cs FROM f),
            g AS (SELECT row_id, seq, t, list_transform(cs, lambda c: {code}) AS k FROM e)
            SELECT row_id, CAST(list_sum(k) AS BIGINT) AS total, CAST(list_sum(list_transform(k, lambda x, i: ({perm})[x + 1] * i)) AS BIGINT) AS mixed, t = upper(seq) AS same FROM g""",
        "deletion_values": "SELECT row_id, round(list_sum(list_transform(deletions, lambda x: atan(x / 3.0) * 2 / pi())), 6) AS value, CAST(list_sum(list_transform(deletions, lambda x: least(greatest(x, 0), 1))) AS BIGINT) AS n_deletions FROM msa_rows WHERE deletions IS NOT NULL",
        "query_identity": """WITH q AS (SELECT msa_id, min(upper(seq)) AS q FROM msa_rows WHERE row_idx = 0 GROUP BY msa_id)
            SELECT row_id, round(list_sum(list_transform(range(1, length(q) + 1), lambda i: CASE WHEN substr(upper(seq), i, 1) = substr(q, i, 1) THEN 1 ELSE -1 END)) / length(q), 6) AS identity FROM msa_rows JOIN q USING (msa_id)""",
        "letter_block": "WITH b AS (SELECT row_id, upper(seq) AS u, regexp_extract(upper(seq), '([A-Z](?:[A-Z-]*[A-Z])?)', 1) AS r FROM msa_rows) SELECT row_id, CASE WHEN r <> '' THEN strpos(u, r) - 1 END AS start, CASE WHEN r <> '' THEN strpos(u, r) - 1 + length(r) END AS \"end\" FROM b",
        "spreadsheet_ids": """WITH RECURSIVE z AS (SELECT chain_id, chain_id AS n, '' AS label FROM chains UNION ALL SELECT chain_id, (n - 1) // 26, label || chr(CAST((n - 1) % 26 + 65 AS INTEGER)) FROM z WHERE n > 0) SELECT chain_id, label FROM z WHERE n = 0""",
        "contiguous_split": "WITH r AS (SELECT msa_id, row_number() OVER (PARTITION BY msa_id ORDER BY row_idx, row_id) - 1 AS r, count(*) OVER (PARTITION BY msa_id) AS n FROM msa_rows), b AS (SELECT msa_id, r, (SELECT min(i) FROM range(0, 7) x(i) WHERE r >= i * n // 7 AND r < (i + 1) * n // 7) AS bucket FROM r) SELECT msa_id, bucket, count(*) AS n, min(r) AS first FROM b GROUP BY msa_id, bucket",
        "chunk_list": "SELECT msa_id, chunk, count(*) AS n FROM (SELECT msa_id, ntile(7) OVER (PARTITION BY msa_id ORDER BY row_idx, row_id) AS chunk FROM msa_rows) GROUP BY msa_id, chunk",
        "positional_pairs": """WITH n AS (SELECT chain_id, target_id, chain_type, ori_name, row_number() OVER (PARTITION BY target_id, chain_type ORDER BY ord DESC, chain_id DESC) AS k, count(*) OVER (PARTITION BY target_id, chain_type) AS m FROM chains WHERE chain_type IN ('H', 'L')),
            h AS (SELECT * FROM n WHERE chain_type = 'H'), l AS (SELECT * FROM n WHERE chain_type = 'L'),
            dp AS (SELECT h.target_id, h.chain_id AS heavy, l.chain_id AS light, false AS is_cross FROM h JOIN l ON h.target_id = l.target_id AND h.k = l.k WHERE (h.m = 1 AND l.m = 1) OR h.ori_name IS DISTINCT FROM l.ori_name),
            cp AS (SELECT h.target_id, h.chain_id AS heavy, l.chain_id AS light, true AS is_cross FROM h JOIN l ON h.target_id = l.target_id WHERE h.target_id NOT IN (SELECT target_id FROM dp) AND h.ori_name IS DISTINCT FROM l.ori_name),
            p AS (SELECT * FROM dp UNION ALL SELECT * FROM cp)
            SELECT * FROM p UNION ALL SELECT target_id, CASE WHEN chain_type = 'H' THEN chain_id END, CASE WHEN chain_type = 'L' THEN chain_id END, false FROM n WHERE target_id NOT IN (SELECT target_id FROM p)""",
        "self_pairs": "SELECT a.target_id, a.chain_id AS first, b.chain_id AS second FROM chains a JOIN chains b ON a.target_id = b.target_id AND a.chain_id < b.chain_id AND a.chain_type <> b.chain_type",
        "assembly_ids": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY ord, chain_id) AS asym_id FROM chains), f AS (SELECT *, min(asym_id) OVER (PARTITION BY target_id, full_seq) AS fst FROM a)
            SELECT chain_id, asym_id, dense_rank() OVER (PARTITION BY target_id ORDER BY fst) AS entity_id, row_number() OVER (PARTITION BY target_id, full_seq ORDER BY asym_id) AS sym_id FROM f""",
        "species_ids": "WITH d AS (SELECT row_id, 'A0A8T2NDK' || row_idx AS acc, substr(msa_id, 7, 4) AS sp FROM msa_rows) SELECT row_id, CASE WHEN length(acc) BETWEEN 6 AND 10 AND regexp_full_match(sp, '[A-Za-z0-9]{1,12}') THEN sp WHEN length(acc) BETWEEN 6 AND 10 AND regexp_full_match(sp, '[A-Za-z0-9]{1,12}_[0-9]+') THEN split_part(sp, '_', 1) ELSE '' END AS species FROM d",
        "ranking_metric": f"""{_STORE}, v AS (SELECT chain_id, chain_type, length(regions[2]) AS n1, list_transform(regions, lambda r: length(regexp_replace(r, '[^A-M]', '', 'g')) / length(r)) AS m FROM s)
            SELECT chain_id, round(CASE WHEN chain_type <> 'H' OR chain_type IS NULL OR m[6] IS NULL THEN m[1] WHEN n1 > 12 THEN (m[2] + m[6]) / 2 ELSE m[6] END, 6) AS metric FROM v""",
        "residue_gap": 'SELECT chain_id, CAST(200 * (row_number() OVER w - 1) + coalesce(sum(length(full_seq)) OVER (PARTITION BY target_id ORDER BY ord, chain_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM chains WINDOW w AS (PARTITION BY target_id ORDER BY ord, chain_id)',
        "clonotype_join": "SELECT chain_id, last_clonotype FROM chains JOIN (SELECT target_id, name, arg_max(clonotype, chain_id) AS last_clonotype FROM chains WHERE clonotype IS NOT NULL GROUP BY target_id, name) USING (target_id, name)",
        "target_order": "SELECT target_id, CAST(coalesce(sum(length(full_seq)), 0) AS BIGINT) AS length FROM chains GROUP BY target_id",
        "fan_out": "SELECT row_ord, round(list_max(list_transform(range(1, length(cdr3) + 1), lambda i: length(cdr3) - length(replace(cdr3, substr(cdr3, i, 1), '')))) / length(cdr3), 6) AS share FROM bucket_store",
    }
