"""Mixing sources to target shares of tokens by Poisson replication.

Sizes are tokens of a public tokenizer. A source's rate is the mean number of uses of its documents that would give it
its target of a mix as large as all documents; it is limited by max_repeats. Each document draws its number of uses
from a Poisson distribution cut at max_repeats whose mean is that rate, by inverting the distribution at a number
hashed from seed, document and text: the draw needs no state, no exchange, and gives the same mix on every run. A source
that needs at least max_repeats uses of everything is used exactly max_repeats times. The mix is then shuffled
globally by a hash of document and copy.

Everything is a table: targets, their sums and their Poisson tables, so any number of sources is planned alike, and
nothing goes to the driver. A source falls short if the draws use each of its documents max_repeats times and still miss the goal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialize

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def with_tokens(df: DataFrame, text: str, tokenizer: str = TOKENIZER, out: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of its text (null or blank text: 0), by a sentencepiece or tokenizers file.

    The file must lie at that path on every executor, or be added with addFile and named as SparkFiles gives it.
    """
    if tokenizer.endswith(".model"):

        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import sentencepiece

            machine = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            for batch in batches:
                yield pd.Series([len(ids) for ids in machine.encode([t or "" for t in batch], num_threads=1)], dtype="int64")

    else:

        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from tokenizers import Tokenizer

            machine = Tokenizer.from_file(tokenizer)
            machine.encode_special_tokens = True
            for batch in batches:
                yield pd.Series([len(e.ids) for e in machine.encode_batch([t or "" for t in batch], add_special_tokens=False)], dtype="int64")

    sized = F.pandas_udf(count, "long")
    return df.withColumn(out, sized(F.col(f"`{text}`")))


def cut_poisson(rate: float, cap: int) -> list[float]:
    """Cumulative probabilities of 0..cap uses for a Poisson distribution cut at cap with the mean ``rate``."""
    if cap <= 0 or rate <= 0:
        return [1.0]
    if rate >= cap:
        return [0.0] * cap + [1.0]

    def table(lam: float) -> list[float]:
        p, total, out = math.exp(-lam), 0.0, []
        for k in range(cap):
            total += p
            out.append(min(total, 1.0))
            p *= lam / (k + 1)
        return [*out, 1.0]

    low, high = 0.0, 1.0
    mean = lambda lam: sum(1 - c for c in table(lam)[:-1])
    while mean(high) < rate and high < 700:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < rate else (low, mid)
    return table(high)


def _spelled(col: F.Column) -> F.Column:
    return F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))


def plan_mix(sized: DataFrame, targets: DataFrame, source: str = "source", tokens: str = "n_tokens") -> DataFrame:
    """One row per source of targets: source, name, target_share, max_repeats, docs, source_tokens, total_tokens,
    goal_tokens, capacity_tokens, rate, and table, with which its draws are inverted. It is written to the shared folder.

    The goal is target_share of all documents' tokens, whether their source is known or not. Source names match after
    trimming and lower-casing; a null or blank name matches nothing; a null share or max_repeats counts as 0.
    """
    key = _spelled(F.col(f"`{source}`"))
    sums = sized.groupBy(key.alias("name")).agg(F.sum(F.col(f"`{tokens}`")).alias("n"), F.count(F.lit(1)).alias("d"))
    sums = materialize(sums, "sums")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"))  # one row
    share, cap = F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0))
    wanted = targets.select("source", F.nullif(_spelled(F.col("source")), F.lit("")).alias("name"), share.alias("target_share"), cap.alias("max_repeats"))
    plan = wanted.join(sums, "name", "left").join(F.broadcast(total))
    have = F.coalesce("n", F.lit(0))
    plan = plan.select("source", "name", "target_share", "max_repeats", F.coalesce("d", F.lit(0)).alias("docs"), have.alias("source_tokens"), "total_tokens", (F.col("target_share") * F.col("total_tokens")).alias("goal_tokens"), (have * F.col("max_repeats")).alias("capacity_tokens"))
    rate = F.when(F.col("source_tokens") > 0, F.least(F.col("goal_tokens") / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    table = F.pandas_udf(lambda r, c: pd.Series([cut_poisson(float(x), int(y)) for x, y in zip(r, c)]), "array<double>")
    plan = plan.withColumn("rate", rate)
    return materialize(plan.withColumn("table", table("rate", "max_repeats")), "plan")


def replicate(sized: DataFrame, plan: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str | None = None, seed: int = 17) -> DataFrame:
    """The documents of the plan's sources with ``target`` (the source as in targets) and ``uses``, the number drawn.

    The draw depends on seed, doc_id and, where it is named, text, so that documents without an id draw for themselves.
    """
    draw = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in (doc_id, text) if c]).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    tables = plan.filter("name is not null").select(F.col("name").alias("__name"), F.col("source").alias("target"), F.col("table").alias("__table"))
    met = sized.withColumn("__name", _spelled(F.col(f"`{source}`"))).withColumn("__u", draw).join(tables, "__name")
    uses = F.size(F.filter("__table", lambda c: F.col("__u") >= c))
    return met.withColumn("uses", uses).drop("__name", "__u", "__table")


def mix(sized: DataFrame, plan: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str | None = None, seed: int = 17) -> DataFrame:
    """The mix itself, shuffled globally: the documents' columns with target, copy_no and shuffle_key (ascending over partitions)."""
    used = replicate(sized, plan, doc_id, source, text, seed).filter(F.col("uses") > 0)
    copies = used.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("uses")))).drop("uses")
    key = F.xxhash64(F.lit(seed + 1), *[F.col(f"`{c}`") for c in (doc_id, text) if c], "copy_no")
    return copies.withColumn("shuffle_key", key).repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")


def mix_report(sized: DataFrame, plan: DataFrame, doc_id: str = "doc_id", source: str = "source", tokens: str = "n_tokens", text: str | None = None, seed: int = 17) -> DataFrame:
    """One row per source of targets: what the drawn mix reaches of the planned size (planned_share) and of its own size
    (actual_share), and whether the source falls short.

    Sources that fall short make the mix smaller than planned, so the actual shares of the others are above their targets;
    planned_share is what compares with target_share.
    """
    drawn = replicate(sized, plan, doc_id, source, text, seed)
    got = drawn.groupBy(F.col("target").alias("source")).agg(F.sum(F.col(f"`{tokens}`") * F.col("uses")).alias("mixed"), F.sum("uses").alias("used"))
    joined = plan.drop("name", "table").join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed", F.lit(0))).withColumn("mixed_docs", F.coalesce("used", F.lit(0))).drop("mixed", "used")
    joined = materialize(joined, "mixed")
    total = joined.agg(F.sum("mixed_tokens").alias("mix_total"))  # one row
    exhausted = F.col("mixed_docs") == F.col("docs") * F.col("max_repeats")
    return joined.join(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "source_tokens", "goal_tokens", "capacity_tokens", "rate", "mixed_tokens", "mixed_docs", "mix_total",
        F.when(F.col("total_tokens") > 0, F.col("mixed_tokens") / F.col("total_tokens")).otherwise(0.0).alias("planned_share"),
        F.when(F.col("mix_total") > 0, F.col("mixed_tokens") / F.col("mix_total")).otherwise(0.0).alias("actual_share"),
        (exhausted & (F.col("mixed_tokens") < F.col("goal_tokens"))).alias("falls_short"),
    )
