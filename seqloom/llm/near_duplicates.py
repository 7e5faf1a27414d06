"""Near-duplicate sequences by a grouped prefix join on sets of 5-letter substrings.

All tokens (substrings of ``K`` letters) are ordered from rare to frequent. Two sets with Jaccard similarity >= t have a
common token among the first n - ceil(t n) + 1 of one and the first n - ceil(2t/(1+t) n) + 1 of the other, smaller one: their
prefixes. A common prefix token alone isn't much evidence once a large collection has used up the 5-letter substrings,
so group pairs are filtered before they leave the join: every sequence carries a sketch of parity bits (token i flips
bit h(i)), and the number of differing bits is at most the number of differing tokens, which for a similar pair is at
most (n + m) (1 - t) / (1 + t). The filter loses nothing and passes few strangers.

Steps: (1) a sketch of token frequencies (fixed size) gives the order; any order is correct, a good one is fast.
(2) Sequences with the same prefix and size are collapsed into one group, copies into one class; groups are written
out once. (3) Prefix tokens travel as packed blocks, one per map task and class of tokens, and are joined within the class; the
probes of a class are split over several tasks when there are many.
(4) Candidate group pairs are made unique, expanded to their members and verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.components import components
from seqloom.session import drop_materialized, materialize

K = 5
#: Size of the frequency sketch: 2**SKETCH_BITS counters in SKETCH_BLOCKS blocks.
SKETCH_BITS, SKETCH_BLOCKS = 20, 16
#: Classes of tokens, each of which is joined by itself: one for so many sequences, so that a join task keeps its size,
#: up to a limit; beyond it the probes of a class are split.
ROWS_A_CLASS, MOST_CLASSES = 40_000, 256
#: Sketch bits for each token of a long set (one of twenty is longer); a sketch has at most 64 words of 64 bits.
BITS_A_TOKEN, MOST_WORDS = 1.4, 64


def token_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every position of every text of capital letters; codes are numbers below 26**5."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    raw = np.frombuffer("".join(texts).encode("ascii"), np.uint8).astype(np.int32) - 65
    n = len(raw) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(n, np.int32)
    for k in range(K):
        code = code * 26 + raw[k : k + n]
    row = np.repeat(np.arange(len(texts)), lengths)[:n]
    ends = np.cumsum(lengths)
    inside = np.arange(n) + K <= ends[row]
    return row[inside], code[inside].astype(np.int64)


def _slot(code: np.ndarray) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _class(code: np.ndarray, classes: int) -> np.ndarray:
    return (((code.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(classes)).astype(np.int64)


def token_order(letters: DataFrame, spark) -> np.ndarray:
    """Frequencies of all tokens of all rows, hashed into 2**SKETCH_BITS counters; that size doesn't depend on the data."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            _, code = token_table(batch.column(0).to_pylist())
            held += np.bincount(_slot(code), minlength=len(held))
        yield pack(held)

    def pack(held: np.ndarray) -> pa.RecordBatch:
        wide = np.uint32 if held.max(initial=0) < 2**32 else np.uint64
        parts = np.split(held.astype(wide), SKETCH_BLOCKS)
        planes = [p.view(np.uint8).reshape(len(p), -1).T.copy().tobytes() for p in parts]  # byte planes compress well
        return pa.RecordBatch.from_arrays([pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(planes, pa.binary())], names=["block", "counts"])

    def unpack(raw: bytes) -> np.ndarray:
        n = (1 << SKETCH_BITS) // SKETCH_BLOCKS
        flat = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T)
        return flat.view(np.uint32 if flat.shape[1] == 4 else np.uint64).ravel().astype(np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[block] = held.get(block, 0) + unpack(raw)
        if held:
            blocks = sorted(held)
            raw = [held[b].astype(np.uint64).view(np.uint8).reshape(len(held[b]), 8).T.copy().tobytes() for b in blocks]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(raw, pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    total = letters.mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    n = len(out) // SKETCH_BLOCKS
    for r in total:
        out[r["block"] * n : (r["block"] + 1) * n] = unpack(bytes(r["counts"]))
    return np.minimum(out, 2**26 - 1).astype(np.uint32)


class Ranked:
    """The distinct tokens of a batch of texts, each text's from rare to frequent."""

    def __init__(self, texts: list[str], order: np.ndarray):
        row, code = token_table(texts)
        out_row, out_code = [], []
        for low in range(0, len(texts), 4096):  # 12 bits of row, 26 of frequency, 24 of code in one number
            a, b = np.searchsorted(row, [low, low + 4096])
            key = ((row[a:b] - low) << 50) | (order[_slot(code[a:b])].astype(np.int64) << 24) | code[a:b]
            key.sort()
            key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
            out_row.append((key >> 50) + low)
            out_code.append((key & 0xFFFFFF).astype(np.int32))
        self.row = np.concatenate(out_row) if out_row else np.zeros(0, np.int64)
        self.code = np.concatenate(out_code) if out_code else np.zeros(0, np.int32)
        self.size = np.bincount(self.row, minlength=len(texts))
        self.start = np.concatenate([[0], np.cumsum(self.size)])


def prefix_lengths(size: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(probe, index) prefix lengths for Jaccard >= num/den."""
    return size - -(-size * num // den) + 1, size - -(-size * 2 * num // (num + den)) + 1


def parity_sketches(ranked: Ranked, words: int) -> np.ndarray:
    """64 * words parity bits for each text of a batch."""
    n, bits = len(ranked.size), 64 * words
    bit = (((ranked.code.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(ranked.row * bits + bit, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1).view(np.uint64).reshape(n, words)


def similar(a: list[str], b: list[str], num: int, den: int) -> np.ndarray:
    """For each i: is the similarity of a[i] and b[i] at least num/den. Tokens are sorted once per distinct text; pairs that
    their long sketches rule out aren't compared."""
    n = len(a)
    which, texts = pd.factorize(np.array(a + b, dtype=object))
    ranked = Ranked(list(texts), np.zeros(1 << SKETCH_BITS, np.uint32))
    x, y = which[:n], which[n:]
    sketch, total = parity_sketches(ranked, 16), ranked.size[x] + ranked.size[y]
    differ = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64)
    ok = (differ * (num + den) <= total * (den - num)) & (total > 0)
    left = np.flatnonzero(ok)
    for lot in np.array_split(left, -(-len(left) // 5000)) if len(left) else []:
        key = []
        for side in (x[lot], y[lot]):
            count = ranked.size[side]
            at = np.repeat(ranked.start[side] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            key.append((np.repeat(np.arange(len(lot)), count) << 24) | ranked.code[at])
        key = np.concatenate(key)
        key.sort()
        common = np.bincount(key[1:][key[1:] == key[:-1]] >> 24, minlength=len(lot))
        ok[lot] = common * den >= (total[lot] - common) * num
    return ok


_POSTING = "cls int, split int, n int, packed binary, tokens binary"


def _planes(x: np.ndarray, width: int) -> bytes:
    """The bytes of numbers, all lowest ones first: neighbours are alike and compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(raw: bytes, n: int, width: int) -> np.ndarray:
    flat = np.zeros((n, 8), np.uint8)
    flat[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return flat.view("<u8").ravel().astype(np.int64)


def _pack(gid: np.ndarray, size: np.ndarray, count: np.ndarray, own: np.ndarray, sketch: np.ndarray) -> bytes:
    return b"".join([_planes(np.diff(gid, prepend=0), 8), _planes(size, 4), _planes(count, 4), _planes(own, 4), sketch.tobytes()])


def _unpack(raw: bytes, n: int) -> list[np.ndarray]:
    gid, size, count, own = (_numbers(raw[a * n : b * n], n, b - a) for a, b in ((0, 8), (8, 12), (12, 16), (16, 20)))
    return [np.cumsum(gid), size, count, own, np.frombuffer(raw[20 * n :], np.uint64).reshape(n, -1)]


def _postings(order_of, words: int, classes: int, splits: int, num: int, den: int):
    """gid, letters, alone -> packed blocks by class and split.

    A block holds, for each sequence, how many tokens it has in the class, rare ones first, how many of them are in its
    index prefix, and its sketch. With several splits, a sequence probes in one of them and is indexed in all.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = order_of.value
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(zero_copy_only=False))))  # small steps between numbers
            gid = batch.column(0).to_numpy(zero_copy_only=False)
            alone = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            ranked = Ranked(batch.column(1).to_pylist(), order)
            sketch = parity_sketches(ranked, words)
            probe, index = prefix_lengths(ranked.size, num, den)
            place = np.arange(len(ranked.row)) - ranked.start[ranked.row]
            keep = place < probe[ranked.row]
            row, code, indexed = ranked.row[keep], ranked.code[keep], (place < index[ranked.row])[keep]
            cls = _class(code, classes)
            home = (gid[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % splits
            rows = []
            for c in range(classes):
                for split in range(splits):
                    at = np.flatnonzero((cls == c) & (indexed | (home == split)))
                    if not len(at):
                        continue
                    held, count = np.unique(row[at], return_counts=True)
                    own = np.bincount(row[at], weights=indexed[at], minlength=len(gid))[held].astype(np.int64)
                    # two low bits of the count: does the sequence probe here, and is it the only member of its group
                    here = (home[at][np.r_[0, np.cumsum(count)[:-1]]] == split).astype(np.int64)
                    rows.append((c, split, len(held), _pack(gid[held], ranked.size[held], count * 4 + here * 2 + alone[held], own, sketch[held]), _planes(code[at], 3)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])], names=["cls", "split", "n", "packed", "tokens"])

    return emit


#: Meetings that a join task holds at once.
_AT_ONCE = 2_000_000


def _join_class(num: int, den: int):
    def join(table: pa.Table) -> pa.Table:
        parts, tokens = [], []
        for n, packed, raw in zip(*(table.column(c).to_pylist() for c in ("n", "packed", "tokens"))):
            parts.append(_unpack(packed, n))
            tokens.append(_numbers(raw, len(raw) // 3, 3))
        gid, size, count, own, sketch = (np.concatenate(x) for x in zip(*parts))
        token, alone, probes, count = np.concatenate(tokens), count & 1, (count >> 1) & 1, count >> 2
        order = np.lexsort((gid, size))  # probes look only at what comes before them
        rank = np.empty(len(gid), np.int64)
        rank[order] = np.arange(len(gid))
        owner = np.repeat(rank, count)
        start = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
        place = np.arange(len(token)) - np.repeat(start, count)
        by, bits = size[order], np.ascontiguousarray(sketch[order].T)
        # a group of several members is bound by its prefix alone: its sketch speaks for one of them
        free = np.where(alone[order] == 1, 0, 1 << 20)
        index = np.flatnonzero(place < np.repeat(own, count))
        key = (token[index] << 32) | owner[index]
        key.sort()
        posted = key & 0xFFFFFFFF
        # a probe of token w and rank r meets the postings of w with smaller rank and enough tokens
        floor_rank = np.searchsorted(by, -(-by * num // den))  # smallest rank that is large enough for each rank
        probe = np.flatnonzero(np.repeat(probes, count))
        w, r = token[probe] << 32, owner[probe]
        line = np.argsort(w | r)  # in the order of the postings, so that searching and reading stay near
        w, r = w[line], r[line]
        low, high = np.searchsorted(key, w | floor_rank[r]), np.searchsorted(key, w | r)
        meets = np.flatnonzero(high > low)
        low, many, r = low[meets], (high - low)[meets], r[meets]
        done = np.concatenate([[0], np.cumsum(many)])
        out, a = [], 0
        while a < len(r):
            b = max(a + 1, int(np.searchsorted(done, done[a] + _AT_ONCE, side="right")) - 1)
            n = many[a:b]
            x = np.repeat(r[a:b], n)
            y = posted[np.repeat(low[a:b] - done[a:b], n) + np.arange(done[a], done[b])]
            differ = np.zeros(len(x), np.int64)
            for word in bits:
                differ += np.bitwise_count(word[x] ^ word[y])
            near = differ * (num + den) <= (by[x] + by[y]) * (den - num) + free[x] + free[y]
            out.append((x[near] << 32) | y[near])
            a = b
        pair = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        g = gid[order]
        x, y = g[pair >> 32], g[pair & 0xFFFFFFFF]
        return pa.table({"ga": np.minimum(x, y), "gb": np.maximum(x, y)})

    return join


def letters_of(col: F.Column) -> F.Column:
    """The letters A-Z of a text, in upper case."""
    return F.regexp_replace(F.upper(col), "[^A-Z]", "")


def _prefix_keys(order_of, num: int, den: int):
    """id, letters -> the same after collapsing copies within a batch, with a 128-bit key of size and prefix."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        order = order_of.value
        for batch in batches:
            frame = pd.DataFrame({"id": batch.column(0).to_numpy(zero_copy_only=False), "letters": batch.column(1).to_pylist()})
            once = frame.groupby("letters", sort=False)["id"].agg(["min", "size"]).reset_index()
            texts = once["letters"].tolist()
            ranked = Ranked(texts, order)
            probe, _ = prefix_lengths(ranked.size, num, den)
            raw = memoryview(ranked.code.tobytes())
            keys = [xxhash.xxh3_128_intdigest(raw[4 * s : 4 * (s + p)], seed=int(n)) for s, p, n in zip(ranked.start.tolist(), probe.tolist(), ranked.size.tolist())]
            low = np.array([k & (2**64 - 1) for k in keys], np.uint64).view(np.int64)
            high = np.array([k >> 64 for k in keys], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(once["min"].to_numpy()), pa.array(once["size"].to_numpy(), pa.int64()), pa.array(texts, pa.string())], names=["ka", "kb", "id", "copies", "letters"])

    return key


def classes_of(df: DataFrame, record_id: str, text: str, num: int = 3, den: int = 5) -> tuple[DataFrame, object]:
    """(gid, place, alone, cid, copies, letters), one row per distinct sequence of at least K letters: its prefix group and place
    in it, its smallest id and how many rows have it; and the broadcast token order. The table is written to the shared folder."""
    spark = df.sparkSession
    plain = df.filter(F.col(f"`{text}`").isNotNull() & F.col(f"`{record_id}`").isNotNull()).select(F.col(f"`{record_id}`").cast("long").alias("id"), letters_of(F.col(f"`{text}`")).alias("letters")).filter(F.length("letters") >= K)
    order_of = spark.sparkContext.broadcast(token_order(plain.select("letters"), spark))
    keyed = plain.mapInArrow(_prefix_keys(order_of, num, den), "ka long, kb long, id long, copies long, letters string")
    # one exchange serves the collapse of copies and that of prefixes; copies shrank to one row a batch before it
    once = keyed.repartition("ka", "kb").groupBy("ka", "kb", "letters").agg(F.min("id").alias("cid"), F.sum("copies").alias("copies"))
    same = Window.partitionBy("ka", "kb").orderBy("cid")
    numbered = once.withColumn("place", F.row_number().over(same)).withColumn("at", F.monotonically_increasing_id())
    alone = (F.col("place") == 1) & F.lead("cid").over(same).isNull()
    return materialize(numbered.select(F.first("at").over(same).alias("gid"), "place", alone.alias("alone"), "cid", "copies", "letters"), "classes"), order_of


def _apart(spark, n: int) -> list[int]:
    """n different numbers that a hash exchange deals evenly to its partitions."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = spark.range(16 * max(n, parts)).select(F.col("id").cast("int").alias("i")).select("i", F.pmod(F.hash("i"), F.lit(parts)).alias("p"))
    turn = many.withColumn("turn", F.row_number().over(Window.partitionBy("p").orderBy("i"))).orderBy("turn", "p").limit(n)
    return [r["i"] for r in turn.collect()]  # one for each task of the join


def similar_classes(table: DataFrame, order_of, num: int = 3, den: int = 5) -> DataFrame:
    """(u, v), u < v: the smallest ids of two different sequences whose similarity is at least num/den."""
    n, long = table.agg(F.count(F.lit(1)), F.percentile_approx(F.length("letters"), 0.95, 1000)).first()
    classes = min(MOST_CLASSES, max(1, -(-n // ROWS_A_CLASS)))
    splits, words = max(1, -(-n // (classes * ROWS_A_CLASS))), int(min(MOST_WORDS, max(1, -(-BITS_A_TOKEN * (long or 0) // 64))))
    posted = table.filter("place = 1").select("gid", "letters", "alone").mapInArrow(_postings(order_of, words, classes, splits, num, den), _POSTING)
    apart = _apart(table.sparkSession, classes * splits)
    posted = posted.withColumn("task", F.get(F.lit(apart), F.col("cls") * splits + F.col("split"))).groupBy("task")
    met = materialize(posted.applyInArrow(_join_class(num, den), "ga long, gb long").distinct(), "met")  # the postings are gone before members meet
    inner = table.filter("place = 2").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    members = table.select("gid", "cid", "letters")
    pairs = met.unionAll(inner).join(members.toDF("ga", "ca", "la"), "ga").join(members.toDF("gb", "cb", "lb"), "gb").filter("ga <> gb or ca < cb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ca, cb = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            ok = similar(batch.column(2).to_pylist(), batch.column(3).to_pylist(), num, den) if len(ca) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ca, cb)[ok]), pa.array(np.maximum(ca, cb)[ok])], names=["u", "v"])

    return pairs.select("ca", "cb", "la", "lb").mapInArrow(verify, "u long, v long")


def _copies(df: DataFrame, record_id: str, text: str, table: DataFrame) -> DataFrame:
    """(cid, id) of all rows of the classes with more than one row."""
    rows = df.filter(F.col(f"`{record_id}`").isNotNull()).select(F.col(f"`{record_id}`").cast("long").alias("id"), letters_of(F.col(f"`{text}`")).alias("letters"))
    key = [F.xxhash64("letters").alias("ha"), F.xxhash64(F.lit(3), "letters").alias("hb")]
    return rows.select("id", *key).join(table.filter("copies > 1").select("cid", *key), ["ha", "hb"]).select("cid", "id")


def near_duplicates(df: DataFrame, record_id: str, text: str, num: int = 3, den: int = 5) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows with similarity >= num/den whose letters are not identical.

    Only letters A-Z count, in either case. Rows without an id, null or empty texts and texts of fewer than five
    letters are in no pair. Copies of one text are collapsed while searching and expanded in the result. Empty tables
    give no pairs; columns other than the two named don't matter.
    """
    table, order_of = classes_of(df, record_id, text, num, den)
    pairs = materialize(similar_classes(table, order_of, num, den), "pairs")
    copies = materialize(_copies(df, record_id, text, table), "copies")
    drop_materialized(table)
    wide = pairs.join(copies.toDF("u", "iu"), "u", "left").join(copies.toDF("v", "iv"), "v", "left")
    a, b = F.coalesce("iu", "u"), F.coalesce("iv", "v")
    return wide.select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"))


def duplicate_groups(df: DataFrame, record_id: str, text: str, num: int = 3, den: int = 5) -> DataFrame:
    """(id, class_id, group_id, n_links) of every row with an id: class_id is the smallest id with the same letters,
    group_id the smallest id that can be reached by similar pairs, n_links the number of different texts it is similar
    to. Rows without five letters are classes of their own."""
    table, order_of = classes_of(df, record_id, text, num, den)
    pairs = materialize(similar_classes(table, order_of, num, den), "pairs")
    links = pairs.select("u").unionAll(pairs.select("v")).groupBy(F.col("u").alias("cid")).agg(F.count(F.lit(1)).alias("n_links"))
    roots = components(pairs).toDF("cid", "root")
    copies = _copies(df, record_id, text, table).toDF("class_id", "id")
    rows = df.filter(F.col(f"`{record_id}`").isNotNull()).select(F.col(f"`{record_id}`").cast("long").alias("id"))
    out = rows.join(copies, "id", "left").withColumn("cid", F.coalesce("class_id", "id")).join(links, "cid", "left").join(roots, "cid", "left")
    return out.select("id", F.col("cid").alias("class_id"), F.coalesce("root", "cid").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
