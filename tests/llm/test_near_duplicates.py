import random
import re

from seqloom.llm import near_duplicates as nd


def brute(rows):
    clean = [(i, re.sub("[^A-Z]", "", s.upper())) for i, s in rows if i is not None and s is not None]
    sets = [(i, s, {s[k : k + 5] for k in range(len(s) - 4)}) for i, s in clean]
    out = set()
    for x in range(len(sets)):
        for y in range(x):
            (i, s, a), (j, t, b) = sets[x], sets[y]
            if s != t and (a | b) and 5 * len(a & b) >= 3 * len(a | b):
                out.add((min(i, j), max(i, j)))
    return out


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        what = rng.random()
        if what < 0.6:
            s[k] = rng.choice("ACDEFGHIKL")
        elif what < 0.8:
            s.insert(k, rng.choice("ACDEFGHIKL"))
        else:
            del s[k]
    return "".join(s)


def rows_of(seed, lengths, families, members):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(families):
        base = "".join(rng.choice("ACDEFGHIKL") for _ in range(rng.choice(lengths)))
        for _ in range(members):
            s = edited(rng, base, rng.randrange(0, max(2, len(base) // 15)))
            if rng.random() < 0.2 and len(s) > 40:  # a block moved
                s = s[30:] + s[:30]
            if rng.random() < 0.2:
                s = s.lower() + "*"
            rows.append((i, s))
            i += rng.randrange(1, 3)
    return rows


def test_all_pairs_are_found(spark):
    rows = rows_of(1, [7, 9, 12, 18, 25, 30, 60, 110], 25, 8)
    rows += [(90000, None), (90001, ""), (90002, "AC"), (None, "ACDEFACDEF"), (90003, "A" * 5000), (90004, "A" * 5000 + "C"), (90005, "aaaaa"), (90006, rows[0][1]), (90007, rows[0][1])]
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "id long, s string, gid string")
    got = [tuple(r) for r in nd.near_duplicates(df, "id", "s").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)
    assert len(got) > 100


def test_probes_split_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(nd, "ROWS_A_CLASS", 1)
    rows = rows_of(2, [8, 40, 100], 15, 7)
    df = spark.createDataFrame(rows, "id long, s string")
    assert {tuple(r) for r in nd.near_duplicates(df, "id", "s").collect()} == brute(rows)


def test_groups(spark):
    rows = rows_of(3, [30, 100], 8, 6) + [(5000, None)]
    df = spark.createDataFrame(rows, "id long, s string")
    pairs = brute(rows)
    got = {r["id"]: r for r in nd.duplicate_groups(df, "id", "s").collect()}
    assert set(got) == {i for i, _ in rows}
    assert got[5000]["n_links"] == 0 and got[5000]["group_id"] == 5000
    root = {i: i for i, _ in rows}
    same = {}
    for i, s in rows:
        if s is not None:
            same.setdefault(re.sub("[^A-Z]", "", s.upper()), []).append(i)
    links = set(pairs) | {(ids[0], j) for ids in same.values() for j in ids[1:]}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert {i: r["group_id"] for i, r in got.items()} == root


def test_empty(spark):
    df = spark.createDataFrame([], "id long, s string")
    assert nd.near_duplicates(df, "id", "s").count() == 0
    assert nd.duplicate_groups(df, "id", "s").count() == 0
