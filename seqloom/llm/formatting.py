"""Copies hidden by formatting: canonical keys and an incremental ledger of their counts.

A record is reduced to what it says: the aligned sequence column by column and the deletion counts number by number.
The key is 128 bits of that. The ledger is a table of (bucket, key, representative, copies, first and last arrival)
partitioned by bucket; a batch is aggregated first (hot keys shrink to one row per task before the exchange) and then
full-outer-joined with the buckets it touches, so a batch costs its own size plus the buckets it meets.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.session import drop_materialized, materialize, scratch_path

KEY = ["key_a", "key_b"]
_FIELD_NAMES = ["deletion_matrix", "sequences"]
_ESCAPES = r"\\[nrt]|\\u00[aA]0|\\u20[0-9a-fA-F]{2}"


def canonical_record(line: F.Column) -> tuple[F.Column, F.Column]:
    """(sequence, deletions) of a record written in any of the known spellings.

    Field names and escapes of JSON (line breaks, tabs, blanks) count as blanks; then letters and gap signs belong to the
    sequence and digits to the deletions, whichever field comes first and whatever separates them. Leading zeros of
    numbers say nothing. Null gives nulls; a record without letters or numbers gives empty strings.
    """
    escaped = F.when(F.contains(line, F.lit("\\")), F.regexp_replace(line, _ESCAPES, " ")).otherwise(line)
    bare = F.lower(escaped)
    for name in _FIELD_NAMES:
        bare = F.replace(bare, F.lit(name), F.lit(" "))
    sequence = F.upper(F.replace(F.regexp_replace(bare, r"[^a-z.\-]++", ""), F.lit("."), F.lit("-")))
    deletions = F.trim(F.regexp_replace(bare, r"(?:[^0-9]++|^)(?:0++(?=[0-9]))?", " "))
    return sequence, deletions


def with_record_key(df: DataFrame, line: str) -> DataFrame:
    """df with key_a, key_b; rows whose line is null have a null key and are copies of nothing."""
    sequence, deletions = canonical_record(F.col(f"`{line}`"))
    said = F.concat_ws("|", sequence, deletions)
    none = F.when(F.col(f"`{line}`").isNotNull(), F.lit(0).cast("long"))  # added, so that what is hashed is computed once for both keys
    return df.withColumns({"key_a": F.xxhash64(said) + none, "key_b": F.xxhash64(F.lit(11), said, F.lit("b")) + none})


class CopyLedger:
    """Counts of canonical keys, kept in buckets of Parquet files and grown batch by batch.

    Columns: key_a, key_b, first_id (smallest id of all copies), first_seen (earliest time, null if none is
    known), copies, bucket. The folder holds one subfolder for each version of a bucket and a manifest, which names the
    live ones and the batches they hold. An update writes new versions of the buckets it touches and then a
    new manifest, in one rename; what the manifest doesn't name doesn't exist, so an update that was broken off, a lost
    executor or a batch_id given again changes nothing, and another process goes on where this one ended. Versions
    that are no longer named are deleted after that. One process writes at a time.

    There are so many buckets that one holds about ``bucket_rows`` keys; when it gets more, their number is doubled and the
    update rewrites all of them.
    """

    SCHEMA = T.StructType(
        [
            T.StructField("key_a", T.LongType()),
            T.StructField("key_b", T.LongType()),
            T.StructField("first_id", T.LongType()),
            T.StructField("first_seen", T.TimestampNTZType()),
            T.StructField("copies", T.LongType()),
            T.StructField("bucket", T.IntegerType()),
        ]
    )

    def __init__(self, spark: SparkSession, path: str | None = None, n_buckets: int = 1, bucket_rows: int = 2_000_000):
        self.spark, self.bucket_rows = spark, bucket_rows
        self.path = (path or scratch_path(spark, "ledger")).rstrip("/")
        self.number, self.n_buckets, self.n_keys = 0, n_buckets, 0
        self.live: dict[int, int] = {}  # bucket -> its version; as many entries as buckets
        self.done: set[str] = set()
        self._read()

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _read(self) -> None:
        """The manifest of the highest number, if there is one."""
        fs, folder = self._fs(f"{self.path}/manifest")
        if not fs.exists(folder):
            return
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()]
        if not numbers:
            return
        raw = self.spark.read.text(f"{self.path}/manifest/{max(numbers)}.json", wholetext=True).first()[0]
        held = json.loads(raw)
        self.number, self.n_buckets, self.n_keys = max(numbers), held["n_buckets"], held["n_keys"]
        self.live, self.done = {int(b): v for b, v in held["live"].items()}, set(held["done"])

    def _commit(self, number: int, live: dict[int, int], n_buckets: int, n_keys: int, done: set[str]) -> None:
        text = json.dumps({"live": live, "n_buckets": n_buckets, "n_keys": n_keys, "done": sorted(done)})
        fs, draft = self._fs(f"{self.path}/manifest/draft-{number}")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(draft, self._fs(f"{self.path}/manifest/{number}.json")[1]):
            raise RuntimeError("the manifest was written by another process")
        gone = {(b, v) for b, v in self.live.items() if live.get(b) != v}
        self.number, self.live, self.n_buckets, self.n_keys, self.done = number, live, n_buckets, n_keys, done
        for bucket, version in gone:
            fs.delete(self._fs(self._folder(bucket, version))[1], True)
        for old in (number - 1, number - 2):
            fs.delete(self._fs(f"{self.path}/manifest/{old}.json")[1], False)

    def _folder(self, bucket: int, version: int) -> str:
        return f"{self.path}/version={version}/bucket={bucket}"

    def table(self, buckets: list[int] | None = None) -> DataFrame:
        """The current rows of all buckets, or of some."""
        files = [self._folder(b, v) for b, v in sorted(self.live.items()) if buckets is None or b in buckets]
        if not files:
            return self.spark.createDataFrame([], self.SCHEMA)
        schema = T.StructType([*self.SCHEMA, T.StructField("version", T.LongType())])
        return self.spark.read.option("basePath", self.path).schema(schema).parquet(*files).drop("version")

    def update(self, batch: DataFrame, batch_id: str, record_id: str, seen: str) -> None:
        """Add a batch that has key_a, key_b, an id and a time; rows with a null key are left out."""
        if batch_id in self.done:
            return
        fresh = (
            batch.filter(F.col("key_a").isNotNull())
            .groupBy(*KEY)
            .agg(F.min(f"`{record_id}`").cast("long").alias("new_id"), F.min(f"`{seen}`").cast("timestamp_ntz").alias("new_seen"), F.count(F.lit(1)).alias("new_copies"))
        )
        fresh = materialize(fresh, "fresh")
        n_fresh, n_buckets = fresh.count(), self.n_buckets
        while self.n_keys + n_fresh > n_buckets * self.bucket_rows:
            n_buckets *= 2
        bucket = F.pmod(F.col("key_a"), F.lit(n_buckets)).cast("int")
        if n_buckets > self.n_buckets or n_fresh >= 8 * n_buckets:
            touched = list(range(n_buckets))  # hashed keys, so a batch of that size meets nearly every bucket
        else:
            touched = [r[0] for r in fresh.select(bucket).distinct().collect()]  # at most 8 * n_buckets keys
        old = self.table(None if n_buckets > self.n_buckets else touched).drop("bucket")
        merged = fresh.join(old, KEY, "full_outer").select(
            *KEY,
            F.least("first_id", "new_id").alias("first_id"),
            F.least("first_seen", "new_seen").alias("first_seen"),
            (F.coalesce("copies", F.lit(0)) + F.coalesce("new_copies", F.lit(0))).alias("copies"),
            bucket.alias("bucket"),
        )
        version = self.number + 1
        target = f"{self.path}/version={version}"
        merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        fs, at = self._fs(target)
        written = [int(f.getPath().getName().removeprefix("bucket=")) for f in fs.listStatus(at) if f.isDirectory() and f.getPath().getName().startswith("bucket=")]
        live = {b: v for b, v in self.live.items() if b not in touched} | {b: version for b in written}
        n_keys = self.spark.read.parquet(target).count() if written else 0
        n_keys += self.table([b for b in self.live if b not in touched]).count() if set(self.live) - set(touched) else 0
        self._commit(version, live, n_buckets, n_keys, self.done | {batch_id})
        drop_materialized(fresh)


def ledger_of(df: DataFrame, line: str, record_id: str, seen: str, arrived: str, n_batches: int = 2, n_buckets: int = 1, bucket_rows: int = 2_000_000) -> tuple[CopyLedger, DataFrame]:
    """Feed a whole table to a new ledger in n_batches of arrival time; returns it and the records' ids and keys.

    Rows without an arrival time come with the first batch. The result is the same for any number of batches.
    """
    # the spellings are parsed once; what is kept is a key and the times of each record
    keyed = with_record_key(df, line).select(*[F.col(f"`{c}`").alias(c) for c in dict.fromkeys([record_id, seen, arrived])], *KEY)
    keyed = materialize(keyed, "keyed")
    when = F.col(f"`{arrived}`").cast("timestamp").cast("double")
    low, high = keyed.agg(F.min(when), F.max(when)).first()
    ledger = CopyLedger(df.sparkSession, n_buckets=n_buckets, bucket_rows=bucket_rows)
    if low is None or high == low:
        ledger.update(keyed, "0", record_id, seen)
        return ledger, keyed
    step = (high - low) / n_batches
    at = F.least(F.coalesce(F.floor((when - F.lit(low)) / F.lit(step)), F.lit(0)), F.lit(n_batches - 1))
    for k in range(n_batches):
        ledger.update(keyed.filter(at == k), str(k), record_id, seen)
    return ledger, keyed


def copies_of(keyed: DataFrame, ledger: CopyLedger, record_id: str, hot_copies: int = 10_000, hot_keys: int = 50_000) -> DataFrame:
    """Every record with a known key: record_id, first_id, copies.

    Keys with more copies than max(hot_copies, records / hot_keys) are at most hot_keys; they are broadcast, so that
    a key that holds a third of all rows is never gathered by a join. All others meet their ledger row by key.
    """
    table = ledger.table()
    total = table.agg(F.sum("copies")).first()[0] or 0
    limit = max(hot_copies, total // hot_keys)
    hot = table.filter(F.col("copies") > limit).select(*KEY, F.col("first_id").alias("hot_id"), F.col("copies").alias("hot_n"))
    cold = table.filter((F.col("copies") <= limit) & (F.col("copies") > 1)).select(*KEY, "first_id", "copies")
    rows = keyed.filter(F.col("key_a").isNotNull()).select(F.col(f"`{record_id}`").alias(record_id), *KEY).join(F.broadcast(hot), KEY, "left")
    of_hot = rows.filter(F.col("hot_id").isNotNull()).select(record_id, F.col("hot_id").alias("first_id"), F.col("hot_n").alias("copies"))
    of_cold = rows.filter(F.col("hot_id").isNull()).join(cold, KEY, "left")
    return of_hot.unionAll(of_cold.select(record_id, F.coalesce("first_id", record_id).alias("first_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies")))
