"""Per-key counts that no hot key can unbalance: dense accumulator arrays over equal input splits.

Every task dictionary-encodes the keys of its own input split and scatter-adds into a dense
``codes x measures`` array (``numpy.bincount``), whatever the keys are: a split of n rows costs the same if all
rows carry one key or n. The arrays leave the task as blocks, one per hash block of the key space, and the blocks
are summed by a second round that streams over them. What is shuffled is bounded by splits x distinct keys, never
by rows, and nothing goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that a task holds at most before it hands its arrays on and begins anew; the result doesn't depend on it.
FLUSH_KEYS = 200_000


class _Accumulator:
    """A dictionary of keys (tuples of int64, null as a flag) and the dense array of their sums."""

    def __init__(self, width: int, measures: int):
        self.width, self.measures = width, measures
        self.codes: dict[bytes, int] = {}
        self.keys: list[np.ndarray] = []
        self.sums = np.zeros((64, measures), np.int64)

    def __len__(self) -> int:
        return len(self.codes)

    def add(self, keys: np.ndarray, weights: np.ndarray) -> None:
        """keys: rows x (2 * width) int64; weights: rows x measures int64."""
        if not len(keys):
            return
        flat = np.ascontiguousarray(keys)
        void = flat.view(np.dtype((np.void, flat.dtype.itemsize * flat.shape[1]))).ravel()
        _, first, local = np.unique(void, return_index=True, return_inverse=True)
        dense = np.stack([np.bincount(local, weights=weights[:, m], minlength=len(first)) for m in range(self.measures)], axis=1)
        code = np.empty(len(first), np.int64)
        for i, at in enumerate(first):
            key = flat[at]
            raw = key.tobytes()
            found = self.codes.get(raw)
            if found is None:
                found = self.codes[raw] = len(self.keys)
                self.keys.append(key.copy())
            code[i] = found
        if len(self.keys) > len(self.sums):
            grown = np.zeros((max(2 * len(self.sums), len(self.keys)), self.measures), np.int64)
            grown[: len(self.sums)] = self.sums
            self.sums = grown
        self.sums[code] += np.rint(dense).astype(np.int64)

    def blocks(self, n_blocks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not self.keys:
            return
        keys = np.stack(self.keys)
        mixed = np.zeros(len(keys), np.uint64)
        for c in range(keys.shape[1]):
            mixed = (mixed ^ keys[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        block = ((mixed >> np.uint64(33)) % np.uint64(n_blocks)).astype(np.int64)
        for b in np.unique(block):
            at = np.flatnonzero(block == b)
            yield int(b), keys[at], self.sums[at]


_BLOCK_SCHEMA = T.StructType(
    [T.StructField("block", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("sums", T.BinaryType())]
)


def dense_sums(df: DataFrame, keys: Sequence[str], measures: Sequence[str], n_blocks: int = 64) -> DataFrame:
    """Sums of integer measures for every combination of integer keys (null is a key of its own).

    Rows without any measure (null) add 0. An empty table gives no rows; ties and repeated rows simply add up; other
    columns are ignored. Sums are exact up to 2**53 a split.
    """
    width, n_measures = len(keys), len(measures)
    types = {f.name: f.dataType for f in df.schema.fields}
    clash = set(keys) & set(measures)
    if clash:
        raise ValueError(f"keys and measures share names: {sorted(clash)}")
    plain = df.select(
        *[F.col(f"`{k}`").cast("long").alias(f"k{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.col(f"`{m}`").cast("long"), F.lit(0)).alias(f"m{i}") for i, m in enumerate(measures)],
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = _Accumulator(width, n_measures)
        for batch in batches:
            key = np.zeros((batch.num_rows, 2 * width), np.int64)
            for i in range(width):
                column = batch.column(i)
                key[:, 2 * i] = column.fill_null(0).to_numpy(zero_copy_only=False)
                key[:, 2 * i + 1] = column.is_null().to_numpy(zero_copy_only=False)
            weight = np.stack([batch.column(width + m).to_numpy(zero_copy_only=False) for m in range(n_measures)], axis=1)
            acc.add(key, weight)
            if len(acc) > FLUSH_KEYS:
                yield from emit(acc)
                acc = _Accumulator(width, n_measures)
        yield from emit(acc)

    def emit(acc: _Accumulator) -> Iterator[pa.RecordBatch]:
        rows = [(b, k.astype("<i8").tobytes(), s.astype("<i8").tobytes()) for b, k, s in acc.blocks(n_blocks)]
        if rows:
            b, k, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(s, pa.binary())], names=["block", "keys", "sums"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Accumulator] = {}
        for batch in batches:
            for b, k, s in zip(*(batch.column(c).to_pylist() for c in range(3))):
                acc = held.setdefault(b, _Accumulator(width, n_measures))
                acc.add(np.frombuffer(k, "<i8").reshape(-1, 2 * width), np.frombuffer(s, "<i8").reshape(-1, n_measures))
        for b in sorted(held):
            acc = held.pop(b)
            key, total = np.stack(acc.keys), acc.sums[: len(acc)]
            columns = [pa.array(key[:, 2 * i], pa.int64(), mask=key[:, 2 * i + 1].astype(bool)) for i in range(width)]
            columns += [pa.array(total[:, m], pa.int64()) for m in range(n_measures)]
            yield pa.RecordBatch.from_arrays(columns, names=[f"k{i}" for i in range(width)] + [f"m{i}" for i in range(n_measures)])

    out = T.StructType([T.StructField(f"k{i}", T.LongType()) for i in range(width)] + [T.StructField(f"m{i}", T.LongType()) for i in range(n_measures)])
    summed = plain.mapInArrow(encode, _BLOCK_SCHEMA).repartition("block").mapInArrow(reduce, out)
    return summed.select(
        *[F.col(f"k{i}").cast(types[k]).alias(k) for i, k in enumerate(keys)],
        *[F.col(f"m{i}").alias(m) for i, m in enumerate(measures)],
    )


def fingerprint(col: F.Column) -> list[F.Column]:
    """128 bits of a value as two columns; null gives nulls."""
    return [F.when(col.isNotNull(), F.xxhash64(col)), F.when(col.isNotNull(), F.xxhash64(F.lit(7), col, F.lit("second")))]


def key_profile(df: DataFrame, keys: Sequence[str], distinct: Sequence[str], n_blocks: int = 64) -> DataFrame:
    """For every key: ``n_rows`` and, for each column c of ``distinct``, ``n_distinct_<c>`` (nulls not counted).

    Rows are counted with dense_sums. For the distinct counts, (key, 128-bit fingerprint of the value) is made unique
    first: that exchange is spread by the value as well as the key, so a hot key's values go to all tasks; then
    dense_sums adds up what is left. All measures travel through one dense reduction.
    """
    names = ["n_rows", *[f"n_distinct_{c}" for c in distinct]]
    key_cols = [F.col(f"`{k}`") for k in keys]
    zero = {n: F.lit(0) for n in names}
    parts = [df.select(*key_cols, *[(zero | {"n_rows": F.lit(1)})[n].alias(n) for n in names])]
    for c in distinct:
        a, b = fingerprint(F.col(f"`{c}`"))
        once = df.filter(F.col(f"`{c}`").isNotNull()).select(*key_cols, a.alias("__fa"), b.alias("__fb")).distinct()
        parts.append(once.select(*key_cols, *[(zero | {f"n_distinct_{c}": F.lit(1)})[n].alias(n) for n in names]))
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionAll(part)
    return dense_sums(everything, keys, names, n_blocks)


def dominant_keys(df: DataFrame, keys: Sequence[str], min_share: float = 0.03) -> DataFrame:
    """The keys, no part null, that hold at least ``min_share`` of all rows: keys, n_rows, n_total.

    The total counts every row, those with null keys too. With an empty table there is no dominant key. The threshold
    is exact: n_rows >= min_share * n_total, with the share taken as a fraction of a million.
    """
    ones = df.select(*[F.col(f"`{k}`") for k in keys], F.lit(1).alias("n_rows"))
    counted = dense_sums(ones, keys, ["n_rows"])
    total = counted.agg(F.sum("n_rows").alias("n_total"))  # one row
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(f"`{k}`").isNotNull()
    share = round(min_share * 1_000_000)
    return counted.filter(complete).join(F.broadcast(total)).filter(F.col("n_rows") * 1_000_000 >= F.col("n_total") * share)
