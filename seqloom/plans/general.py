"""Queries of the general operators over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.dense_counts import dominant_keys, key_profile

PAIR = ["cdr1_len", "cdr2_len"]


def bucket_rows(spark: SparkSession, d: str) -> DataFrame:
    """bucket_store with sequences in one spelling: upper case, without the end sign."""
    store = spark.read.parquet(f"{d}/bucket_store.parquet")
    return store.withColumn("sequence", F.rtrim(F.upper("sequence"), F.lit("*")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The (cdr1_len, cdr2_len) pairs that hold at least 3 % of all rows."""
    return dominant_keys(spark.read.parquet(f"{d}/bucket_store.parquet"), PAIR, 0.03).select(*PAIR)


def p1_pair_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct sequences and distinct cdr3 of every pair, dominant pairs named."""
    profile = key_profile(bucket_rows(spark, d), PAIR, ["sequence", "cdr3"])
    total = profile.agg(F.sum("n_rows").alias("n_total"))
    dominant = F.col("cdr1_len").isNotNull() & F.col("cdr2_len").isNotNull() & (F.col("n_rows") * 100 >= F.col("n_total") * 3)
    return profile.join(F.broadcast(total)).select(
        *PAIR, "n_rows", F.col("n_distinct_sequence").alias("n_sequences"), F.col("n_distinct_cdr3").alias("n_cdr3"), dominant.alias("is_dominant")
    )


def queries() -> dict:
    return {"p1_found": p1_found, "p1_pair_profile": p1_pair_profile}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            SELECT cdr1_len, cdr2_len FROM bucket_store WHERE cdr1_len IS NOT NULL AND cdr2_len IS NOT NULL
            GROUP BY cdr1_len, cdr2_len HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM bucket_store)""",
        "p1_pair_profile": """
            SELECT cdr1_len, cdr2_len, count(*) AS n_rows, count(DISTINCT rtrim(upper(sequence), '*')) AS n_sequences,
              count(DISTINCT cdr3) AS n_cdr3,
              cdr1_len IS NOT NULL AND cdr2_len IS NOT NULL AND count(*) * 100 >= 3 * (SELECT count(*) FROM bucket_store) AS is_dominant
            FROM bucket_store GROUP BY cdr1_len, cdr2_len""",
    }
