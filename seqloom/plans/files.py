"""Queries of readers and writers: the tables written in a format, read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import columns as C
from seqloom.session import scratch_path
from seqloom.sources import sequences as Q
from seqloom.sources import structures as R


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark, d):
    """Chains as FASTA records of a file for each chain type."""
    c = t(spark, d, "chains").filter("full_seq is not null").select("chain_id", "regions", F.coalesce("chain_type", F.lit("none")).alias("source_file"), F.concat(F.lit("c"), F.col("chain_id").cast("string")).alias("name"), F.regexp_replace(F.upper("full_seq"), "[^A-Z]", "").alias("seq"))
    return c.filter("seq <> ''").withColumn("ord", F.col("chain_id"))


def fasta_files(spark, d):
    """Written one file a chain type, read file by file."""
    path = scratch_path(spark, "fasta")
    Q.to_fasta(_records(spark, d), path)
    files = Q.whole_files(spark, f"{path}/*")
    return Q.read_fasta(files).select(F.regexp_extract("source_file", "file=([^/]+)", 1).alias("file"), "ord", "name", "seq").withColumn("ord", F.col("ord").cast("long"))


def fasta_records(spark, d):
    """Written and read record by record."""
    path = scratch_path(spark, "records")
    Q.write_fasta_records(_records(spark, d), path, ["chain_id"])
    return Q.read_fasta_records(spark, path).select("name", "seq")


def two_line_fasta(spark, d):
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("l")))), lambda x: x["l"]), "\n")
    return Q.read_two_line(_records(spark, d).groupBy("source_file").agg(line.alias("value"))).select("source_file", "name", "seq")


def region_fasta(spark, d):
    """Regions joined by marks, of which CDR1 to CDR3 are picked."""
    c = t(spark, d, "chains").filter("size(regions) = 7").select("chain_id", F.array_join("regions", "*").alias("marked"))
    return c.select("chain_id", Q.pick_regions(F.col("marked"), [1, 3, 5]).alias("cdrs"))


def zip_fasta(spark, d):
    """Chains of even and odd number side by side."""
    r = _records(spark, d).withColumn("k", F.floor(F.col("chain_id") / 2))
    both = r.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("k")
    half = lambda i: r.filter(F.col("chain_id") % 2 == i).join(both, "k").select(F.col("k").alias("ord"), "name", "seq")
    return Q.zip_fasta(half(0), half(1)).select("name", "seq")


def a3m_files(spark, d):
    """Alignments with their deletions written as lower-case insertions."""
    m = t(spark, d, "msa_rows").withColumn("del", F.coalesce("deletions", F.array_repeat(F.lit(0), F.length("seq"))))
    cell = F.zip_with(C.chars(F.upper("seq")), "del", lambda c, n: F.concat(F.repeat(F.lit("x"), F.coalesce(n, F.lit(0))), c))
    line = F.concat(F.lit(">r"), F.col("row_id").cast("string"), F.lit("\n"), F.array_join(cell, ""))
    text = m.groupBy(F.col("msa_id").alias("source_file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "row_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("value"))
    return Q.read_a3m(text).select(F.substring("description", F.lit(2), F.length("description")).cast("long").alias("row_id"), "seq", F.aggregate("deletions", F.lit(0).cast("long"), lambda a, x: a + x).alias("deleted"))


def _stockholm(spark, d):
    """Alignments in two blocks, the query given gaps in columns 11 to 15."""
    m = t(spark, d, "msa_rows").select("msa_id", "row_id", "row_idx", F.upper("seq").alias("s"))
    s = F.when(F.col("row_idx") == 0, F.concat(F.substring("s", 1, 10), F.lit("-----"), F.substring("s", F.lit(16), F.length("s")))).otherwise(F.col("s"))
    m = m.withColumn("s", s).withColumn("name", F.concat(F.lit("r"), F.col("row_id").cast("string")))
    block = lambda a, n: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "row_id", F.concat_ws(" ", "name", F.substring("s", F.lit(a), F.lit(n))).alias("l")))), lambda x: x["l"]), "\n")
    return m.groupBy(F.col("msa_id").alias("source_file")).agg(F.concat(F.lit("# STOCKHOLM 1.0\n\n"), block(1, 50), F.lit("\n\n"), block(51, 10_000), F.lit("\n//\n")).alias("value"))


def stockholm_files(spark, d):
    r = Q.read_stockholm(_stockholm(spark, d))
    return r.select(F.substring("description", F.lit(2), F.length("description")).cast("long").alias("row_id"), "seq", F.aggregate("deletions", F.lit(0).cast("long"), lambda a, x: a + x).alias("deleted"))


def stockholm_a3m(spark, d):
    return Q.stockholm_to_a3m(_stockholm(spark, d), drop_query_gaps=False).select(F.substring("name", F.lit(2), F.length("name")).cast("long").alias("row_id"), "a3m")


def stockholm_dedup(spark, d):
    return Q.dedup_stockholm(_stockholm(spark, d)).select(F.substring("name", F.lit(2), F.length("name")).cast("long").alias("row_id"))


def stockholm_truncated(spark, d):
    return Q.truncate_stockholm(_stockholm(spark, d), 10).select(F.substring("name", F.lit(2), F.length("name")).cast("long").alias("row_id"), "raw")


def clonotype_csv(spark, d):
    """The last clonotype of a name, by the order of lines."""
    path = scratch_path(spark, "clonotypes")
    c = t(spark, d, "chains").filter("clonotype is not null and name is not null").select("chain_id", F.regexp_replace(F.concat_ws("_", "target_id", "name"), r"[^\w]", "").alias("name"), "clonotype")
    c.orderBy("chain_id").select("name", "clonotype").coalesce(1).write.option("header", True).csv(path)
    return Q.read_clonotypes(spark, path).select("name", "clonotype")


def bucket_files(spark, d):
    c = t(spark, d, "bucket_catalog").filter("seq_count is not null and chain_type is not null and cdr1_len is not null and cdr2_len is not null and cdr3_len is not null")
    named = c.select(F.concat(F.lit("/store/"), F.concat_ws("_", "chain_type", "cdr1_len", "cdr2_len", "cdr3_len", "seq_count"), F.lit(".fasta")).alias("path"), "ord")
    return Q.bucket_catalog(named).select("path", "chain_type", *[F.col(x).cast("long").alias(x) for x in ("cdr1_len", "cdr2_len", "cdr3_len", "seq_count")])


def tblout_files(spark, d):
    c = t(spark, d, "chains").select(F.coalesce("chain_type", F.lit("none")).alias("source_file"), F.concat_ws(" ", F.concat(F.lit("c"), F.col("chain_id").cast("string")), F.lit("-"), F.lit("q"), F.lit("-"), F.concat(F.col("chain_id").cast("string"), F.lit("e-3"))).alias("line"))
    text = c.groupBy("source_file").agg(F.concat(F.lit("# target\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("value"))
    return Q.read_tblout(text).select("source_file", "target", F.round("e_value", 6).alias("e_value"))


def pdb_files(spark, d):
    """Embeddings as atoms, written in fixed columns and read back."""
    e = t(spark, d, "embeddings").withColumn("n", (F.col("vec_id") % 9999).cast("int"))
    at = lambda i: (F.get("embedding", F.lit(i)).cast("double") * 10)
    line = R.pdb_lines(F.col("n"), F.lit("CA"), F.lit("GLY"), F.lit("A"), F.col("n"), at(0), at(1), at(2), F.lit(50.0))
    text = e.groupBy(F.concat(F.lit("s"), F.col("label").cast("string")).alias("source_file")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("value"))
    return R.read_pdb_atoms(text).select("source_file", F.col("residue_number").cast("long").alias("n"), "atom", *[F.round(c, 3).alias(c) for c in "xyz"])


def region_index(spark, d):
    c = t(spark, d, "chains").filter("size(regions) = 7").withColumn("i", C.region_intervals(C.region_lengths(F.col("regions")), F.lit(2)))
    total = F.aggregate(C.region_lengths(F.col("regions")), F.lit(4), lambda a, x: a + x)
    j = c.select("chain_id", Q.region_json(F.col("i"), F.col("chain_type"), total, F.lit(2), F.lit(2)).alias("json"))
    i = Q.read_region_json(j, "json")
    return i.select("chain_id", *[F.get(f"index.{r}", F.lit(k)).cast("long").alias(f"{r.lower()}_{k}") for r in ("CDR1", "CDR3", "BACK") for k in (0, 1)])


def alignment_index(spark, d):
    """Texts laid end to end, a file in parts of about 1 MB, and read again by their byte ranges."""
    r = _records(spark, d).select(F.col("source_file").alias("db"), "name", F.col("seq").alias("value"))
    index = Q.build_index(r)
    laid = r.join(index.select("db", "name", "start"), ["db", "name"]).groupBy("db", F.floor(F.col("start") / (1 << 20)).alias("part"))
    blobs = laid.agg(F.min("start").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), "").cast("binary").alias("content"))
    return Q.read_range(blobs, index).select("db", "name", "value")


def hmm_descriptions(spark, d):
    c = t(spark, d, "chains").filter("full_seq is not null")
    text = F.concat(F.lit("1abc_"), F.col("chain_id").cast("string"), F.lit("/3-"), F.length("full_seq").cast("string"), F.when(F.col("chain_id") % 3 == 0, " mol:protein ").otherwise(" mol:protein length:"), F.length("full_seq").cast("string"), F.lit("  Some name"))
    h = R.hmm_description(text)
    return c.select("chain_id", h["chain"].alias("chain"), h["end"].cast("long").alias("last"), h["length"].cast("long").alias("length"), h["text"].alias("text"))


_NAMES = [
    "fasta_files", "fasta_records", "two_line_fasta", "region_fasta", "zip_fasta", "a3m_files", "stockholm_files", "stockholm_a3m", "stockholm_dedup",
    "stockholm_truncated", "clonotype_csv", "bucket_files", "tblout_files", "pdb_files", "region_index", "alignment_index", "hmm_descriptions",
]


def queries() -> dict:
    return {name: globals()[name] for name in _NAMES}


def oracle_sql() -> dict[str, str]:
    rec = "WITH r AS (SELECT chain_id, coalesce(chain_type, 'none') AS file, 'c' || chain_id AS name, regexp_replace(upper(full_seq), '[^A-Z]', '', 'g') AS seq FROM chains WHERE full_seq IS NOT NULL AND regexp_replace(upper(full_seq), '[^A-Z]', '', 'g') <> '')"
    sto = "WITH m AS (SELECT msa_id, row_id, row_idx, upper(seq) AS s FROM msa_rows)"
    return {
        "fasta_files": f'{rec} SELECT file, row_number() OVER (PARTITION BY file ORDER BY chain_id) - 1 AS "ord", name, seq FROM r',
        "fasta_records": f"{rec} SELECT name, seq FROM r",
        "two_line_fasta": f"{rec} SELECT file AS source_file, name, seq FROM r",
        "region_fasta": "SELECT chain_id, regions[2] || regions[4] || regions[6] AS cdrs FROM chains WHERE len(regions) = 7",
        "zip_fasta": f"{rec} SELECT a.name || '|' || b.name AS name, a.seq || '*' || b.seq AS seq FROM r a JOIN r b ON a.chain_id % 2 = 0 AND b.chain_id = a.chain_id + 1",
        "a3m_files": "SELECT row_id, upper(seq) AS seq, CAST(coalesce(list_sum(deletions), 0) AS BIGINT) AS deleted FROM msa_rows",
        "stockholm_files": f"{sto} SELECT row_id, substr(s, 1, 10) || substr(s, 16) AS seq, CASE WHEN row_idx = 0 OR length(s) <= 15 THEN 0 ELSE length(replace(substr(s, 11, 5), '-', '')) END AS deleted FROM m",
        "stockholm_a3m": f"{sto} SELECT row_id, CASE WHEN row_idx = 0 THEN substr(s, 1, 10) || '-----' || substr(s, 16) ELSE s END AS a3m FROM m",
        "stockholm_dedup": f"{sto} SELECT row_id FROM m QUALIFY row_number() OVER (PARTITION BY msa_id, substr(s, 1, 10) || substr(s, 16) ORDER BY row_idx, row_id) = 1",
        "stockholm_truncated": f"{sto} SELECT row_id, CASE WHEN row_idx = 0 THEN substr(s, 1, 10) || '-----' || substr(s, 16) ELSE s END AS raw FROM m QUALIFY row_number() OVER (PARTITION BY msa_id ORDER BY row_idx, row_id) <= 10",
        "clonotype_csv": r"SELECT regexp_replace(concat_ws('_', target_id, name), '[^\w]', '', 'g') AS name, arg_max(clonotype, chain_id) AS clonotype FROM chains WHERE clonotype IS NOT NULL AND name IS NOT NULL GROUP BY 1",
        "bucket_files": "SELECT '/store/' || concat_ws('_', chain_type, cdr1_len, cdr2_len, cdr3_len, seq_count) || '.fasta' AS path, chain_type, CAST(cdr1_len AS BIGINT) AS cdr1_len, CAST(cdr2_len AS BIGINT) AS cdr2_len, CAST(cdr3_len AS BIGINT) AS cdr3_len, seq_count FROM bucket_catalog WHERE seq_count IS NOT NULL AND chain_type IS NOT NULL AND cdr1_len IS NOT NULL AND cdr2_len IS NOT NULL AND cdr3_len IS NOT NULL",
        "tblout_files": "SELECT coalesce(chain_type, 'none') AS source_file, 'c' || chain_id AS target, round(chain_id / 1000.0, 6) AS e_value FROM chains UNION ALL SELECT DISTINCT coalesce(chain_type, 'none'), 'query', 0.0 FROM chains",
        "pdb_files": "SELECT 's' || label AS source_file, vec_id % 9999 AS n, 'CA' AS atom, round(CAST(embedding[1] AS DOUBLE) * 10, 3) AS x, round(CAST(embedding[2] AS DOUBLE) * 10, 3) AS y, round(CAST(embedding[3] AS DOUBLE) * 10, 3) AS z FROM embeddings",
        "region_index": "WITH l AS (SELECT chain_id, list_transform(regions, lambda r: length(r)) AS n FROM chains WHERE len(regions) = 7) SELECT chain_id, CAST(2 + n[1] AS BIGINT) AS cdr1_0, CAST(2 + n[1] + n[2] AS BIGINT) AS cdr1_1, CAST(2 + list_sum(n[1:5]) AS BIGINT) AS cdr3_0, CAST(2 + list_sum(n[1:6]) AS BIGINT) AS cdr3_1, CAST(2 + list_sum(n) AS BIGINT) AS back_0, CAST(4 + list_sum(n) AS BIGINT) AS back_1 FROM l",
        "alignment_index": f"{rec} SELECT file AS db, name, seq AS value FROM r",
        "hmm_descriptions": "SELECT chain_id, CASE WHEN chain_id % 3 <> 0 THEN CAST(chain_id AS VARCHAR) END AS chain, CASE WHEN chain_id % 3 <> 0 THEN length(full_seq) END AS last, CASE WHEN chain_id % 3 <> 0 THEN length(full_seq) END AS length, CASE WHEN chain_id % 3 <> 0 THEN 'Some name' END AS text FROM chains WHERE full_seq IS NOT NULL",
    }
