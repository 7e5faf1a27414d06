import random

import numpy as np
import pytest

from seqloom.llm import related, subsets
from seqloom.llm.components import components


def brute(rows):
    first = {i: i for i, _, _ in rows}
    ok = [(i, m, s.upper()) for i, m, s in rows if m is not None and s]

    def linked(a, b):
        both = [(x, y) for x, y in zip(a, b) if x.isalpha() and y.isalpha()]
        return both and 5 * sum(x == y for x, y in both) >= 3 * len(both)

    pairs = [(a[0], b[0]) for k, a in enumerate(ok) for b in ok[:k] if a[1] == b[1] and linked(a[2], b[2])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(first[a], first[b])
            changed |= first[a] != low or first[b] != low
            first[a] = first[b] = low
    return first


def table(seed, n, spread, width=40, msas=3):
    rng = random.Random(seed)
    rows, i = [], 0
    for m in range(msas):
        roots = ["".join(rng.choice("ACDEFGHIKL") for _ in range(width)) for _ in range(6)]
        for _ in range(n):
            s = list(rng.choice(roots))
            for _ in range(rng.randrange(int(width * spread) + 1)):
                s[rng.randrange(width)] = rng.choice("ACDEFGHIKLX")
            if rng.random() < 0.3:
                k = rng.randrange(width // 2)
                s[:k] = "-" * k
            if rng.random() < 0.1:
                s[rng.randrange(width) :] = []
            i += rng.randrange(1, 4)
            rows.append((i, f"m{m}", "".join(s).lower() if rng.random() < 0.2 else "".join(s)))
        rows.append((i + 5, f"m{m}", rows[-1][2]))
        rows += [(i + 6, f"m{m}", "-" * width), (i + 7, f"m{m}", "-" * width), (i + 8, f"m{m}", None), (i + 9, f"m{m}", "")]
        i += 10
    return rows + [(i + 1, None, "ACD"), (i + 2, None, "ACD")]


@pytest.mark.parametrize("spread,chunk", [(0.3, 10_000), (0.3, 25), (0.6, 25), (0.9, 30)])
def test_groups_are_exact(spark, spread, chunk):
    rows = table(1, 90, spread)
    df = spark.createDataFrame([(i, m, s, 1, "x") for i, m, s in rows], "row_id long, msa_id string, seq string, gid int, u string")
    got = {r["row_id"]: r["group_id"] for r in related.row_groups(df, whole=chunk, chunk_rows=chunk).collect()}
    assert got == brute(rows)


def test_summary_and_empty(spark):
    rows = table(2, 40, 0.2, msas=1)
    df = spark.createDataFrame(rows, "row_id long, msa_id string, seq string")
    groups = related.row_groups(df)
    summary = related.group_summary(groups).collect()
    assert sum(r["n_rows"] for r in summary) == len(rows)
    assert all(1 <= len(r["typical_rows"]) <= 3 for r in summary)
    assert related.row_groups(df.limit(0)).count() == 0


def test_bound_never_excludes_a_relative():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 5, (60, 30)).astype(np.uint8)
    middle = related.consensus_of(codes[:30])
    own = related.slack(codes[:30], middle)
    need = 3 * (codes[30:] > 0).sum(1) - 5 * ((codes[30:] == middle) & (codes[30:] > 0)).sum(1)
    close = related.related(related.planes(codes[30:]), related.planes(codes[:30]))
    assert all(need[i] <= own[j] for i, j in np.argwhere(close)) and close.any()


def test_components(spark):
    rng = random.Random(1)
    chain = [(i + 1, i) for i in range(60)]
    edges = chain + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(7, 7), (500, 7), (7, 500), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            if a is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hilbert_neighbours():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = subsets.hilbert_key(side, 3)
    assert sorted(key) == list(range(512))
    path = side[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_subsets(spark):
    rows = table(4, 60, 0.25)
    df = spark.createDataFrame(rows, "row_id long, msa_id string, seq string").filter("msa_id is not null")
    grouped = df.join(related.row_groups(df).select("row_id", "group_id", "density", "turn"), "row_id")
    size = {m: sum(1 for r in rows if r[1] == m) for m in ("m0", "m1", "m2")}
    n_groups = {r["msa_id"]: r["n"] for r in grouped.groupBy("msa_id").agg({"group_id": "approx_count_distinct"}).toDF("msa_id", "n").collect()}
    requests = spark.createDataFrame([("m0", 20), ("m1", 3), ("m2", 1000), ("m9", 5), (None, 4)], "msa_id string, subset_size int")
    got = subsets.choose(grouped, requests).collect()
    by = {m: [r for r in got if r["msa_id"] == m] for m in size}
    assert len(by["m0"]) == 20 and len({r["group_id"] for r in by["m0"]}) == n_groups["m0"]
    assert len(by["m1"]) == 3 and len({r["group_id"] for r in by["m1"]}) == 3
    assert len(by["m2"]) == size["m2"] and len({r["row_id"] for r in by["m2"]}) == size["m2"]
    assert len(got) == 23 + size["m2"]
    assert subsets.choose(grouped.limit(0), requests).count() == 0
    assert subsets.choose(grouped, requests.limit(0)).count() == 0


FOLDER = "/root/testdata/sf0.001"


def shares(noise=None):
    """Shares of the true cases of sf0.001 that the components alone, the confirmed ones and the groups give."""
    import pandas as pd

    true, found = set(), {"component": set(), "confirmed": set(), "group_id": set()}
    for _, g in pd.read_parquet(f"{FOLDER}/msa_rows.parquet").sort_values("row_id").groupby("msa_id"):
        ids, codes = g["row_id"].to_numpy(), related.encode(g["seq"].tolist())
        link = related.Union(len(ids))
        for i, j in np.argwhere(np.triu(related.related(related.planes(codes), related.planes(codes)), 1)):
            link.join(int(i), int(j))
        first = ids[link.labels()]
        true |= {(a, b) for a, b in zip(first, ids) if a != b}
        got = related.whole_groups(codes, ids)
        for name, cases in found.items():
            low = pd.Series(ids).groupby(got[name].to_numpy()).transform("min").to_numpy()
            cases |= {(a, b) for a, b in zip(low, ids) if a != b}
    return {name: len(cases & true) / len(true) for name, cases in found.items()}


def test_rows_come_from_the_mixture(monkeypatch):
    good = shares()
    assert good["component"] > 0.97 and good["confirmed"] > 0.98 and good["group_id"] == 1
    real, rng = related.best_mixture, np.random.default_rng(1)

    def noise(codes):
        model, _, log = real(codes)
        model.log_density = lambda x: rng.standard_normal((len(x), len(model.mean)))
        return model, rng.integers(0, log.shape[1], len(codes)), rng.standard_normal(log.shape)

    monkeypatch.setattr(related, "best_mixture", noise)
    bad = shares()
    assert bad["component"] < 0.5 and bad["confirmed"] < 0.5


def test_typical_rows_of_a_deep_alignment(spark):
    """The typical rows of large groups are near the group's consensus, whether an alignment is one task or several."""
    rng = random.Random(9)
    roots = ["".join(rng.choice("ACDEFGHIKL") for _ in range(60)) for _ in range(3)]
    rows = []
    for i in range(300):
        s = list(roots[i % 3])
        for _ in range(rng.randrange(15)):
            s[rng.randrange(60)] = rng.choice("ACDEFGHIKL")
        rows.append((i, "m", "".join(s)))
    df = spark.createDataFrame(rows, "row_id long, msa_id string, seq string")
    for whole in (1000, 90):
        got = related.group_summary(related.row_groups(df, whole=whole, chunk_rows=40)).collect()
        assert sorted(r["n_rows"] for r in got) == [100, 100, 100]
        for r in got:
            off = [sum(a != b for a, b in zip(rows[i][2], roots[i % 3])) for i in range(300) if i % 3 == r["group_id"] % 3]
            best = [sum(a != b for a, b in zip(rows[i][2], roots[i % 3])) for i in r["typical_rows"]]
            assert len(best) == 3 and max(best) < sorted(off)[60]


def test_subsets_come_from_the_curve(spark, monkeypatch):
    """One cell for all rows loses rows that every good subset needs."""
    from pyspark.sql import functions as F

    rows = table(5, 60, 0.25, msas=2)
    df = spark.createDataFrame(rows, "row_id long, msa_id string, seq string").filter("msa_id is not null")
    df = df.join(related.row_groups(df).select("row_id", "group_id", "density", "turn"), "row_id")
    n = df.groupBy("msa_id").agg(F.count_distinct("group_id").cast("int").alias("subset_size"))
    single = {r["row_id"] for r in df.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("row_id")).filter("n = 1").collect()}
    chosen = lambda: {r["row_id"] for r in subsets.choose(df, n).collect() if r["group_rows"] == 1}
    assert chosen() == single and len(single) > 5
    monkeypatch.setattr(subsets, "curve_key", lambda a, b: F.lit(7).cast("long"))
    assert len(chosen()) < 0.7 * len(single)
