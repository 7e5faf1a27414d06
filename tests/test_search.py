import random

from pyspark.sql import functions as F

from seqloom.operators import dense_counts, search
from seqloom.plans import search as plan


def loop(rows, target, tol, overflow, min_rows, cap):
    """The relaxation as a direct loop."""
    tol, left, n = list(tol), list(overflow), len(target)
    for cycle in range(cap):
        got = [i for i, lens in rows if all(abs(a - b) <= w for a, b, w in zip(lens, target, tol))]
        if len(got) >= min_rows or cycle == cap - 1:
            return sorted(got)
        if sum(left) > 0:
            at = next(i for i, c in enumerate(left) if c > 0)
            tol[at] += 1
            left[at] -= 1
        else:
            tol[cycle % n] += 1


def test_relaxation_equals_the_loop(spark):
    rng = random.Random(8)
    rows = [(i, [rng.randrange(3, 15) for _ in range(7)]) for i in range(150)]
    df = spark.createDataFrame(rows + [(999, None)], "id long, lens array<int>").cache()
    for k in range(12):
        target = [rng.randrange(3, 22) for _ in range(7)]
        top = [max(r[1][i] for r in rows) for i in range(7)]
        clamped, overflow = search.clamp_target(target, top, [t - rng.random() for t in top]) if k % 2 else (target, [0] * 7)
        tol = [rng.randrange(0, 5) for _ in range(7)]
        got = sorted(r["id"] for r in search.relaxed_search(df, "lens", clamped, tol, 40, 50, overflow).collect())
        assert got == loop(rows, clamped, tol, overflow, 40, 50)


def test_many_targets_equal_the_loop(spark):
    """Clamped targets with overflow, and what is done where a query finds too many rows."""
    rng = random.Random(18)
    rows = [(i, [rng.randrange(3, 12) for _ in range(7)], "".join(rng.choice("ACDEFG") for _ in range(rng.randrange(5, 7)))) for i in range(150)]
    store = spark.createDataFrame(rows + [(999, None, None)], "id long, lens array<int>, cdr3 string")
    limits = search.length_limits(store, "lens", 7, 0.9)
    top, ref = limits.first()
    asked = [(q, [rng.randrange(3, 18) for _ in range(7)], [rng.randrange(0, 5) for _ in range(7)], "ACDEFG"[: 5 + q % 2]) for q in range(9)]
    queries = search.clamp_targets(spark.createDataFrame(asked, "query_id long, target array<int>, tolerance array<int>, query_cdr3 string"), limits)
    found = search.relaxed_search_all(store, queries, "lens", 7, 40, 50)
    got, close, cut = ({} for _ in range(3))
    for into, df in ((got, found), (close, search.keep_close(found, [("cdr3", "query_cdr3")], 45, "query_id", "id", cut=False)), (cut, search.keep_close(found, [("cdr3", "query_cdr3")], 3, "query_id", "id", cut=True))):
        for r in df.collect():
            into.setdefault(r["query_id"], []).append(r["id"])
    pop = lambda a, b: sum((ord(x) ^ ord(y)).bit_count() for x, y in zip(a, b))
    near = lambda ids, q: [i for i in ids if len(rows[i][2]) == len(q) and pop(rows[i][2], q) <= int(len(q) * 1.6)]
    for q, target, tol, cdr3 in asked:
        clamped, overflow = search.clamp_target(target, top, ref)
        want = loop([r[:2] for r in rows], clamped, tol, overflow, 40, 50)
        assert sorted(got.get(q, [])) == want
        assert sorted(close.get(q, [])) == (near(want, cdr3) if len(want) > 45 else want)
        assert sorted(cut.get(q, [])) == (near(want, cdr3)[:3] if len(want) > 3 else want)


def walk(store, catalog, regions, chain_type, min_rows, max_rows, tol=1.0):
    """The unpaired search as a direct walk over buckets."""
    c1, c2, c3 = (len(regions[i]) for i in (1, 3, 5))
    pop = lambda a, b: sum((ord(x) ^ ord(y)).bit_count() for x, y in zip(a, b))
    if c3 > 10:
        min_rows = min_rows * c3 // 10 * 4
    own = [c for c in catalog if c[1] == chain_type]
    exact = [c for c in own if c[4] == c3]
    dist = lambda c: abs(c[2] - c1) + abs(c[3] - c2) + abs(c[4] - c3)
    listed = sorted(exact, key=lambda c: (dist(c), c[6]))
    if sum(c[5] for c in exact) < 1000:
        listed, n = sorted(own, key=lambda c: (dist(c), c[6])), 0
        for i, c in enumerate(listed):
            n += c[5]
            if n > 1000:
                listed = listed[: i + 1]
                break
    out = []
    for c in listed:
        if len(out) >= min_rows:
            break
        rows = [r for r in store if r[0] == c[0]]
        if not rows:
            continue
        near = lambda t, rows=rows: [r[1] for r in rows if len(r[2]) == c3 and pop(r[2], regions[5]) <= int(c3 * t)]
        if c[4] == c3 and len(rows) >= 10 * min_rows:
            out += near(tol)
        else:
            out += [r[1] for r in rows]
            if len(out) > max_rows:
                return out[:max_rows]
        t = tol
        while len(out) > max_rows:
            t *= 0.9
            out = near(t)
            if t < 0.1:
                break
    return out


def test_unpaired_search_equals_the_walk(spark):
    rng = random.Random(3)
    schema_s, schema_c = "path string, row_ord long, cdr3 string", "path string, chain_type string, cdr1_len int, cdr2_len int, cdr3_len int, seq_count long, ord int"
    for seed, (min_rows, max_rows, big) in enumerate([(20, 5000, 30), (5, 60, 300), (40, 50, 30), (2, 25, 400)]):
        store, catalog, n = [], [], 0
        for b in range(12):
            c3, size = rng.choice([6, 6, 7, 8]), big if b == 0 else rng.randrange(1, 40)
            catalog.append((f"p{b}", "H" if b % 5 else rng.choice("HL"), rng.randrange(5, 9), rng.randrange(5, 9), c3, size * rng.choice([1, 40]), b))
            for _ in range(size):
                n += 1
                store.append((f"p{b}", n, "".join(rng.choice("ACDEFG") for _ in range(c3))))
        regions = ["A" * 5, "A" * 7, "A", "A" * 6, "A", "ACDEFG", "A"]
        got = search.unpaired_search(spark.createDataFrame(store, schema_s), spark.createDataFrame(catalog, schema_c), regions, "H", min_rows, max_rows)
        assert [r["row_ord"] for r in got.collect()] == walk(store, catalog, regions, "H", min_rows, max_rows), seed
        asked = [(1, "H", 5, 7, 6, "ACDEFG"), (2, "L", 5, 6, 7, "GACDEFG"), (3, "H", 8, 8, 12, "ACDEFGACDEFG")]
        many = search.unpaired_search_all(spark.createDataFrame(store, schema_s), spark.createDataFrame(catalog, schema_c), spark.createDataFrame(asked, "query_id long, chain_type string, c1 int, c2 int, c3 int, cdr3 string"), min_rows, max_rows).orderBy("query_id", "rank", "row_ord").collect()
        for q, kind, c1, c2, c3, cdr3 in asked:
            line = ["A", "A" * c1, "A", "A" * c2, "A", cdr3, "A"]
            assert [r["row_ord"] for r in many if r["query_id"] == q] == walk(store, catalog, line, kind, min_rows, max_rows), (seed, q)


def test_dense_sums(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, -3, 2**40]), rng.choice([None, 0, 5]), rng.choice([None, 1, 7]), "x") for _ in range(2000)]
    df = spark.createDataFrame(rows, "a long, b int, w long, k0 string").repartition(5)
    want = {}
    for a, b, w, _ in rows:
        want[a, b] = want.get((a, b), 0) + (w or 0)
    for flush in (200_000, 1):
        monkeypatch.setattr(dense_counts, "FLUSH_KEYS", flush)
        got = dense_counts.dense_sums(df, ["a", "b"], ["w"], n_blocks=3)
        assert {(r["a"], r["b"]): r["w"] for r in got.collect()} == want
        assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint"]
    assert dense_counts.dense_sums(df.limit(0), ["a"], ["w"]).count() == 0


def test_key_profile(spark):
    rows = [(1, 1, "a", "p"), (1, 1, "a", None), (1, 1, "A", "q"), (None, 1, "z", "z"), (2, None, None, None), (1, 1, "", "")]
    df = spark.createDataFrame(rows, "k int, j int, s string, c string").withColumn("n_rows", F.lit(5))
    got = {(r["k"], r["j"]): (r["n_rows"], r["n_distinct_s"], r["n_distinct_c"]) for r in dense_counts.key_profile(df, ["k", "j"], ["s", "c"]).collect()}
    assert got == {(1, 1): (4, 3, 3), (None, 1): (1, 1, 1), (2, None): (1, 0, 0)}
    assert {(r["k"], r["j"], r["n_rows"], r["n_total"]) for r in dense_counts.dominant_keys(df, ["k", "j"], 0.5).collect()} == {(1, 1, 4, 6)}
    assert dense_counts.dominant_keys(df.limit(0), ["k", "j"]).count() == 0


def test_searches_take_every_query(spark):
    folder = "/root/testdata/sf0.01"
    chains = [r for r in spark.read.parquet(f"{folder}/chains.parquet").collect() if r["regions"] is not None and len(r["regions"]) == 7]
    rows = [(r["chain_id"], [len(x) for x in r["regions"]]) for r in chains]
    asked = [r for r in chains if r["chain_id"] % 20 == 0]
    assert {r["chain_type"] for r in asked} == {"H", "L"}
    band, relaxed, top = set(), set(), set()
    for q in asked:
        target = [len(x) for x in q["regions"]]
        band |= {(q["chain_id"], i) for i, lens in rows if all(abs(a - b) <= w for a, b, w in zip(lens, target, plan.BAND))}
        got = loop(rows, target, plan.START_L if q["chain_type"] == "L" else plan.START, [0] * 7, plan.MIN_ROWS, plan.CAP)
        relaxed |= {(q["chain_id"], i) for i in got}
        cdr3 = {r["chain_id"]: r["regions"][5] for r in chains if r["chain_id"] in set(got) and len(r["regions"][5]) == target[5]}
        far = {i: sum(a != b for a, b in zip(c, q["regions"][5])) for i, c in cdr3.items()}
        top |= {(q["chain_id"], i, n) for i, n in far.items() if sum(m < n for m in far.values()) < 20}
    for query, want in ((plan.band_filter_all, band), (plan.relaxed_search_all, relaxed)):
        got = [(r["query_id"], r["chain_id"]) for r in query(spark, folder).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    got = [(r["query_id"], r["chain_id"], r["distance"]) for r in plan.search_top_k_all(spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == top
