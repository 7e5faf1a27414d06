"""Queries of the training-data operators and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import formatting, keyword_pages, leaks, mixture, near_duplicates, related, subsets
from seqloom.session import materialize


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_row_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of every alignment row."""
    return related.row_groups(_t(spark, d, "msa_rows")).select("row_id", "msa_id", "component", "confirmed", "group_id")


def p2_components(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the mixture alone, without the check: each but the smallest of its component, with that smallest one."""
    rows = related.row_groups(_t(spark, d, "msa_rows")).select("row_id", "component")
    first = rows.groupBy("component").agg(F.min("row_id").alias("first_row_id"))
    return rows.join(first, "component").filter(F.col("row_id") != F.col("first_row_id")).select("first_row_id", "row_id")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical rows of every group."""
    return related.group_summary(materialize(related.row_groups(_t(spark, d, "msa_rows")), "rows"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are related to a row with a smaller row_id, directly or through others."""
    groups = p2_row_groups(spark, d)
    return groups.filter(F.col("group_id") != F.col("row_id")).select(F.col("group_id").alias("first_row_id"), "row_id")


def p3_subsets(spark: SparkSession, d: str) -> DataFrame:
    """The chosen rows of every requested alignment."""
    requests = _t(spark, d, "subset_requests")
    rows = _t(spark, d, "msa_rows").join(requests.select("msa_id"), "msa_id", "left_semi").select("row_id", "msa_id", "seq")
    groups = related.row_groups(rows).select("row_id", "group_id", "density", "turn")
    return subsets.choose(rows.join(groups, "row_id"), requests)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Chosen rows that are a group of their own: no good subset can do without them."""
    return p3_subsets(spark, d).filter("group_rows = 1").select("row_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that repeat an earlier one in another spelling, with the smallest record_id of their copies."""
    ledger, keyed = formatting.ledger_of(_t(spark, d, "msa_raw"), "line", "record_id", "seen_at", "loaded_at")
    found = formatting.copies_of(keyed, ledger, "record_id")
    return found.filter(F.col("first_id") != F.col("record_id")).select(F.col("first_id").alias("first_record_id"), "record_id")


def p4_ledger(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct record: its earliest representative and the number of copies."""
    ledger, _ = formatting.ledger_of(_t(spark, d, "msa_raw"), "line", "record_id", "seen_at", "loaded_at")
    return ledger.table().select(F.col("first_id").alias("first_record_id"), "first_seen", "copies")


_TEXTS = {"chains": ("chain_id", "full_seq"), "msa_rows": ("row_id", "seq")}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of rows of one table whose 5-letter substrings agree to 60 % and whose letters are not identical."""
    parts = [near_duplicates.near_duplicates(_t(spark, d, t), *cols).select(F.lit(t).alias("tbl"), "id_a", "id_b") for t, cols in _TEXTS.items()]
    return parts[0].unionAll(parts[1])


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Class, group and number of links of every row of both tables."""
    parts = [near_duplicates.duplicate_groups(_t(spark, d, t), *cols).withColumn("tbl", F.lit(t)) for t, cols in _TEXTS.items()]
    return parts[0].unionAll(parts[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 13 consecutive words of an item: the hits within one word edit whose best distance is 0."""
    hits = leaks.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"), short_items=False)
    return hits.filter("best_edits = 0").select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """All hits within two word edits, with the best distance and the number of passages held unchanged."""
    return leaks.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"), budget=2)


def _mix(spark: SparkSession, d: str, *more: str) -> tuple[DataFrame, DataFrame]:
    sized = materialize(mixture.with_tokens(_t(spark, d, "documents"), "text").select("doc_id", "source", "n_tokens", *more), "tokens")
    return sized, mixture.plan_mix(sized, _t(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources of which the draws use every document max_repeats times and yet less than the target share."""
    return mixture.mix_report(*_mix(spark, d)).filter("falls_short").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Target, planned and actual share of every source."""
    return mixture.mix_report(*_mix(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix, shuffled, with its texts."""
    return mixture.mix(*_mix(spark, d, "text"), text="text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which more than half the words stand among keywords, links or tags."""
    return keyword_pages.keyword_share(_t(spark, d, "documents")).filter("is_keyword_page").select("doc_id")


def p8_pages(spark: SparkSession, d: str) -> DataFrame:
    """The measures of every document."""
    return keyword_pages.keyword_share(_t(spark, d, "documents"))


_SAID = r"""
    WITH bare AS (SELECT record_id, seen_at, regexp_replace(line, '(?i)deletion_matrix|sequences', '|', 'g') AS b FROM msa_raw WHERE line IS NOT NULL),
    said AS (SELECT record_id, seen_at, translate(regexp_replace(upper(b), '[^A-Z.\-]', '', 'g'), '.', '-') || '|' ||
      array_to_string(list_transform(regexp_extract_all(b, '\d+'), lambda x: CAST(CAST(x AS HUGEINT) AS VARCHAR)), ',') AS said FROM bare)"""


_REL = """
    WITH RECURSIVE m AS (SELECT row_id, msa_id, upper(seq) AS s FROM msa_rows WHERE msa_id IS NOT NULL AND seq IS NOT NULL),
    c AS (SELECT msa_id, row_id, pos, substr(s, CAST(pos AS INTEGER), 1) AS l FROM m, LATERAL (SELECT unnest(range(1, length(s) + 1)) AS pos) WHERE regexp_matches(substr(s, CAST(pos AS INTEGER), 1), '[A-Z]')),
    rel AS (SELECT x.row_id AS a, y.row_id AS b FROM c x JOIN c y ON x.msa_id = y.msa_id AND x.pos = y.pos AND x.row_id <> y.row_id GROUP BY 1, 2 HAVING 5 * sum((x.l = y.l)::INT) >= 3 * count(*))"""
_SHINGLES = """
    WITH t AS (SELECT 'chains' AS tbl, chain_id AS id, regexp_replace(upper(full_seq), '[^A-Z]', '', 'g') AS s FROM chains UNION ALL SELECT 'msa_rows', row_id, regexp_replace(upper(seq), '[^A-Z]', '', 'g') FROM msa_rows),
    g AS (SELECT DISTINCT tbl, id, s, substr(s, CAST(i AS INTEGER), 5) AS w FROM t, LATERAL (SELECT unnest(range(1, length(s) - 3)) AS i) WHERE length(s) >= 5),
    n AS (SELECT tbl, id, any_value(s) AS s, count(*) AS n FROM g GROUP BY tbl, id),
    both_of AS (SELECT x.tbl, x.id AS id_a, y.id AS id_b, count(*) AS k FROM g x JOIN g y ON x.tbl = y.tbl AND x.w = y.w AND x.id < y.id GROUP BY ALL)"""


def queries() -> dict:
    return {"p2_found": p2_found, "p2_row_groups": p2_row_groups, "p2_components": p2_components, "p2_groups": p2_groups, "p3_found": p3_found, "p3_subsets": p3_subsets, "p4_found": p4_found, "p4_ledger": p4_ledger, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_leaks": p6_leaks, "p7_found": p7_found, "p7_report": p7_report, "p7_mix": p7_mix, "p8_found": p8_found, "p8_pages": p8_pages}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _REL + """,
            r AS (SELECT a, b FROM rel UNION SELECT r.a, rel.b FROM r JOIN rel ON r.b = rel.a WHERE r.a <> rel.b)
            SELECT min(b) AS first_row_id, a AS row_id FROM r GROUP BY a HAVING min(b) < a""",
        "p3_found": _REL + """ SELECT row_id FROM msa_rows JOIN subset_requests USING (msa_id) WHERE row_id NOT IN (SELECT a FROM rel)""",
        "p5_found": _SHINGLES + """
            SELECT k.tbl, id_a, id_b FROM both_of k JOIN n a ON a.tbl = k.tbl AND a.id = id_a JOIN n b ON b.tbl = k.tbl AND b.id = id_b WHERE a.s <> b.s AND 5 * k >= 3 * (a.n + b.n - k)""",
        "p5_groups": _SHINGLES.replace("WITH t", "WITH RECURSIVE t", 1) + """,
            k AS (SELECT tbl, id, CASE WHEN length(s) >= 5 THEN min(id) OVER (PARTITION BY tbl, s) ELSE id END AS class_id FROM t),
            f AS (SELECT x.tbl, id_a, id_b FROM both_of x JOIN n a ON a.tbl = x.tbl AND a.id = id_a JOIN n b ON b.tbl = x.tbl AND b.id = id_b WHERE a.s <> b.s AND 5 * k >= 3 * (a.n + b.n - k)),
            e AS (SELECT DISTINCT f.tbl, a.class_id AS u, b.class_id AS v FROM f JOIN k a ON a.tbl = f.tbl AND a.id = id_a JOIN k b ON b.tbl = f.tbl AND b.id = id_b), d AS (SELECT * FROM e UNION SELECT tbl, v, u FROM e),
            r AS (SELECT tbl, u, v FROM d UNION SELECT r.tbl, r.u, d.v FROM r JOIN d ON r.tbl = d.tbl AND r.v = d.u),
            l AS (SELECT tbl, u, count(*) AS n FROM d GROUP BY ALL), low AS (SELECT tbl, u, min(v) AS v FROM r GROUP BY ALL)
            SELECT k.id, k.tbl, k.class_id, least(k.class_id, low.v) AS group_id, coalesce(l.n, 0) AS n_links FROM k LEFT JOIN l ON l.tbl = k.tbl AND l.u = k.class_id LEFT JOIN low ON low.tbl = k.tbl AND low.u = k.class_id""",
        "p7_found": """
            WITH s AS (SELECT lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS name, sum(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]'))) AS n FROM documents GROUP BY 1)
            SELECT t.source FROM mix_targets t LEFT JOIN s ON s.name = lower(trim(t.source)) WHERE coalesce(s.n, 0) * max_repeats < target_share * (SELECT sum(n) FROM s)""",
        "p4_found": _SAID + """
            SELECT f AS first_record_id, record_id FROM (SELECT record_id, min(record_id) OVER (PARTITION BY said) AS f FROM said) WHERE f <> record_id""",
        "p4_ledger": _SAID + """
            SELECT min(record_id) AS first_record_id, min(seen_at) AS first_seen, count(*) AS copies FROM said GROUP BY said""",
        "p6_found": r"""
            WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
            runs AS (SELECT item_id, array_to_string(w[i:i+12], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM iw WHERE len(w) >= 13)),
            own AS (SELECT run, min(item_id) AS item_id FROM runs GROUP BY run HAVING count(DISTINCT item_id) = 1),
            dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
            druns AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+12], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM dw WHERE len(w) >= 13))
            SELECT DISTINCT doc_id, item_id FROM druns JOIN own USING (run)""",
    }
