"""Searches and readers whose work grew faster than their tables, and what they give for odd texts."""

import random

from pyspark.sql import functions as F

from seqloom.functions import columns as C
from seqloom.operators import search as operators
from seqloom.plans import search as plan
from seqloom.sources import sequences as S


def test_packed_distances_equal_those_of_characters(spark):
    rng = random.Random(4)
    texts = []
    for n in [1, 2, 6, 7, 8, 13, 14, 15, 27, 28, 35]:
        for _ in range(20):
            a = [chr(rng.randrange(1, 128)) for _ in range(n)]
            texts.append(("".join(a), "".join(x if rng.random() < 0.5 else chr(rng.randrange(1, 128)) for x in a)))
    df = spark.createDataFrame(texts, "a string, b string")
    a, b = F.col("a"), F.col("b")
    w = F.transform(F.sequence(F.lit(1), F.length("a")), lambda i: i.cast("double"))
    pairs = [(C.packed_popcount, C.popcount_hamming(a, b)), (C.packed_symbols, C.symbol_hamming(a, b)), (C.packed_places, C.weighted_hamming(a, b, w))]
    got = df.filter(C.fits_packed(a)).select(*[x for f, slow in pairs for x in (f(C.packed(a), C.packed(b)).cast("double"), slow.cast("double"))]).collect()
    assert len(got) == len(texts) and all(tuple(r[0::2]) == tuple(r[1::2]) for r in got)
    assert not spark.range(1).select(C.fits_packed(F.lit("A" * 36)) | C.fits_packed(F.lit("Aé"))).first()[0]


def _folder(spark, path, cdr3s):
    rows = [(i, c) for i, c in enumerate(cdr3s)]
    spark.createDataFrame(rows, "row_ord long, cdr3 string").write.parquet(f"{path}/bucket_store.parquet")
    chains = [(20 * (i + 1), "H", ["A"] * 5 + [c or "", "A"]) for i, c in enumerate(cdr3s)]
    spark.createDataFrame(chains, "chain_id long, chain_type string, regions array<string>").write.parquet(f"{path}/chains.parquet")
    return str(path)


CDR3S = ["ACD", "ACE", "aCD", "ÄCD", "日CD", "A" * 36, "A" * 35 + "C", "AC", "", None]


def _pairs():
    return [(20 * (j + 1), i, a, b) for i, a in enumerate(CDR3S) for j, b in enumerate(CDR3S) if a and b and len(a) == len(b)]


def _bits(a, b):
    return sum((ord(x) ^ ord(y)).bit_count() for x, y in zip(a, b))


def _in_numbers_alone(df):
    """Whether pairs that fit are compared without arrays of characters: the plan's first branch has no higher-order function."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return "zip_with" not in text.split("Join", 1)[0].lower() and "zipwith" not in text.split("Join", 1)[0].lower()


def test_close_cdr3_of_odd_texts(spark, tmp_path):
    df = plan.close_cdr3(spark, _folder(spark, tmp_path, CDR3S))
    want = sorted((q, i) for q, i, a, b in _pairs() if _bits(a, b) <= int(len(a) * 1.6))
    assert sorted((r["query_id"], r["row_ord"]) for r in df.collect()) == want
    assert _in_numbers_alone(df)


def test_popcount_hamming_of_odd_texts(spark, tmp_path):
    df = plan.popcount_hamming(spark, _folder(spark, tmp_path, CDR3S))
    assert sorted(tuple(r) for r in df.collect()) == sorted((q, i, _bits(a, b)) for q, i, a, b in _pairs())
    assert _in_numbers_alone(df)


def test_letters_in_few_numbers_equal_those_of_characters(spark):
    rng = random.Random(5)
    block = [chr(i) for i in range(64, 96)]
    texts = [("".join(block), "".join(block[::-1]))] + [tuple("".join(rng.choice(block) for _ in range(n)) for _ in range(2)) for n in range(1, 37) for _ in range(5)]
    df = spark.createDataFrame(texts, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.filter(C.fits_letters(a) & C.fits_letters(b)).select("a", "b", C.packed_popcount(C.packed_letters(a), C.packed_letters(b))).collect()
    assert len(got) == len(texts) and all(r[2] == _bits(r[0], r[1]) for r in got)
    for odd in ["A" * 37, "Aa", "A ", "A-", "A*", "AÄ", None]:
        assert not spark.range(1).select(C.fits_letters(F.lit(odd).cast("string"))).first()[0]


def test_pairs_of_letters_are_one_join_without_nulls(spark, tmp_path):
    """The usual CDR3s leave one join, of even tasks, and no column that a writer would keep levels for."""
    cdr3s = ["ACD", "ACE", "A" * 36, "", None] + ["CARDY"] * 400
    df = plan.popcount_hamming(spark, _folder(spark, tmp_path, cdr3s))
    assert not any(field.nullable for field in df.schema)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    rows = df.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 90 and max(r["count"] for r in rows) < 5 * 405 * 400 / 96
    assert sum(r["count"] for r in rows) == 400 * 400 + 4 + 1


def test_pairs_of_rows_without_row_ord(spark, tmp_path):
    folder = _folder(spark, tmp_path, CDR3S)
    rows = [(None, "ACF"), (None, "日CE"), (7, "ACF")]
    spark.createDataFrame(rows, "row_ord long, cdr3 string").write.mode("append").parquet(f"{folder}/bucket_store.parquet")
    want = _pairs() + [(20 * (j + 1), i, a, b) for i, a in rows for j, b in enumerate(CDR3S) if b and len(a) == len(b)]
    key = lambda r: (r[0], -1 if r[1] is None else r[1], r[2])
    assert sorted(map(tuple, plan.popcount_hamming(spark, folder).collect()), key=key) == sorted(((q, i, _bits(a, b)) for q, i, a, b in want), key=key)
    near = [(q, i, a) for q, i, a, b in want if _bits(a, b) <= int(len(a) * 1.6)]
    assert sorted(map(tuple, plan.close_cdr3(spark, folder).collect()), key=key) == sorted(near, key=key)


def test_weighted_hamming_of_odd_texts(spark, tmp_path):
    df = plan.weighted_hamming(spark, _folder(spark, tmp_path, CDR3S))
    differ = lambda a, b: [k for k, (x, y) in enumerate(zip(a, b), 1) if x != y]
    assert sorted(tuple(r) for r in df.collect()) == sorted((q, i, len(differ(a, b)), sum(differ(a, b)) / 2) for q, i, a, b in _pairs())
    assert _in_numbers_alone(df)


def test_ranges_of_files_in_parts(spark):
    """Ranges over the edges of blocks and parts, of no bytes, beyond the end, twice, and of an unknown file."""
    text = "".join(chr(97 + i % 26) for i in range(1000)).encode()
    blobs = spark.createDataFrame([("d", 0, bytearray(text[:333])), ("d", 333, bytearray(text[333:])), ("e", 0, bytearray(b""))], "db string, at long, content binary")
    asked = [("d", "a", 0, 1000), ("d", "b", 300, 100), ("d", "c", 128, 64), ("d", "z", 64, 0), ("d", "y", 1000, 0), ("d", "x", 990, 50), ("d", "w", 2000, 300), ("d", "t", 5, 9), ("d", "t", 5, 9), ("e", "v", 0, 4), ("f", "u", 0, 4)]
    got = S.read_range(blobs, spark.createDataFrame(asked, "db string, name string, start long, size long"), block=64)
    assert sorted((r["name"], r["value"]) for r in got.collect()) == sorted((n, text[s : s + k].decode() if db == "d" else "") for db, n, s, k in asked if db != "f")


def test_listed_buckets_are_the_reachable_ones_of_the_choice(spark):
    """The same ranks as of the whole choice, up to the bucket with which plain ones are enough, and no further."""
    rng = random.Random(6)
    catalog, size = [], []
    for b in range(300):
        n = rng.choice([0, 1, 3, 8, 90])
        catalog.append((f"p{b}", rng.choice("HL"), rng.randrange(5, 8), rng.choice([5, 6, None]), rng.choice([6, 7, 12]), rng.choice([None, n, 5 * n, 40 * n]), b))
        size += [(f"p{b}", n)] * (n > 0)
    catalog = spark.createDataFrame(catalog, "path string, chain_type string, cdr1_len int, cdr2_len int, cdr3_len int, seq_count long, ord int")
    asked = [(i, kind, c1, c2, c3) for i, (kind, c1, c2, c3) in enumerate((k, a, b, c) for k in "HL" for a in (5, 9) for b in (5, 6) for c in (6, 7, 9, 12))]
    queries = spark.createDataFrame(asked, "query_id long, chain_type string, c1 int, c2 int, c3 int")
    held, wanted, whole = dict(size), set(), {}
    for r in operators.choose_buckets_all(catalog, queries).collect():
        whole.setdefault(r["query_id"], []).append(r)
    for q, kind, c1, c2, c3 in asked:
        plain = 0
        for r in sorted(whole.get(q, []), key=lambda r: r["rank"]):
            n, least = held.get(r["path"], 0), 40 if c3 == 12 else 8
            sharp = r["cdr3_len"] == c3 and n >= 10 * least
            if plain < least and n:
                wanted.add((kind, c1, c2, c3, r["path"], r["rank"], n, sharp))
            plain += 0 if sharp else n
    least = lambda c: F.when(c > 10, 40).otherwise(8)
    got = operators._listed_buckets(catalog, spark.createDataFrame(size, "path string, n long"), queries.drop("query_id"), least)
    got = {tuple(r) for r in got.select("chain_type", "c1", "c2", "c3", "path", "rank", "n", "sharp").collect()}
    assert got == wanted and any(r[-1] for r in got) and len(got) < sum(map(len, whole.values())) / 3


def test_distances_of_a_length_in_several_pieces(spark, monkeypatch):
    """More queries and rows than go at once, mixed with letters beyond ASCII, long texts and a null row_ord: every pair once."""
    monkeypatch.setattr(operators, "_PAIRS_AT_ONCE", 12)
    monkeypatch.setattr(operators, "_ROWS_AT_ONCE", 5)
    rng = random.Random(8)
    texts = ["".join(rng.choice("ACDÄ日😀" if k % 3 == 0 else "ACDEFGHIK") for _ in range(n)) for n in (1, 8, 9, 17, 40) for k in range(30)]
    store = spark.createDataFrame([*enumerate(texts), (None, "ACDEFGHI")], "row_ord long, text string")
    queries = spark.createDataFrame([(20 * i, x) for i, x in enumerate(texts) if i % 2], "query_id long, text string")
    pairs = [(20 * j, i, x, y) for i, x in [*enumerate(texts), (None, "ACDEFGHI")] for j, y in enumerate(texts) if j % 2 and len(x) == len(y)]
    key = lambda r: (r[0], -1 if r[1] is None else r[1])
    got = operators.place_distances(store, queries, 3).collect()
    differ = lambda a, b: [k for k, (x, y) in enumerate(zip(a, b), 1) if x != y]
    assert sorted(map(tuple, got), key=key) == sorted(((q, i, len(differ(x, y)), sum(differ(x, y)) / 2) for q, i, x, y in pairs), key=key)
