import random

import numpy as np

from seqloom.operators import clustering, ranking, sampling


def test_places_over_several_tasks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, i long").repartition(7)
    want, seen = {}, {}
    for g, v, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        want[i] = seen[g] = seen.get(g, -1) + 1
    for most in (1000, 10):
        monkeypatch.setattr(ranking, "WINDOW_ROWS", most)
        got = ranking.place_in_group(df, ["g"], ["v", "i"], "place")
        assert got.columns == ["g", "v", "i", "place"] and {r["i"]: r["place"] for r in got.collect()} == want
    ranks = {r["i"]: r["rank"] for r in ranking.competition_rank(df, ["g"], "v").collect()}
    assert ranks == {i: sum(1 for g2, v2, _ in rows if g2 == g and v2 > v) for g, v, i in rows}
    assert ranking.place_in_group(df.limit(0), ["g"], ["v", "i"], "place").count() == 0


def test_strided_sample_over_several_tasks(spark, monkeypatch):
    df = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(301)], "g string, i long").repartition(5)
    one = {tuple(r) for r in sampling.strided_sample(df, ["g"], ["i"], 8, 2, 5).collect()}
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 10)
    assert {tuple(r) for r in sampling.strided_sample(df, ["g"], ["i"], 8, 2, 5).collect()} == one and len(one) == 16


def test_nearest_centre_in_blocks(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 5)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, vectors[3].tolist())], "k long, v array<double>")
    centres = df.filter("k % 3 = 0")
    want = {int(i): min((-round(float(v @ vectors[c] if c < 60 else v @ vectors[3]), 9), c) for c in [*range(0, 60, 3), 99])[1] for i, v in [*enumerate(vectors), (99, vectors[3])]}
    for rows in (1000, 4):
        assert {r["k"]: r["centre"] for r in clustering.nearest_centre(df, centres, "k", "v", block_rows=rows).collect()} == want
    assert clustering.nearest_centre(df, centres.limit(0), "k", "v").count() == 0


def test_pairs_in_blocks(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(50, 4))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "k long, v array<double>")
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if 1 - unit[i] @ unit[j] <= 0.4}
    for rows in (1000, 7):
        assert {(r["a"], r["b"]) for r in clustering.blocked_pairs(df, "k", "v", 0.4, block_rows=rows).collect()} == want


def test_kmeans_features_keep_the_matrix_distances(spark):
    """Three far apart groups are found, as k-means on the rows of the distance matrix finds them."""
    rng = np.random.default_rng(3)
    centres = np.eye(6)[:3] * 5
    df = spark.createDataFrame([(i, (centres[i % 3] + rng.normal(size=6) * 0.2).tolist()) for i in range(90)], "k long, v array<double>")
    got = {r["k"]: r["label"] for r in clustering.kmeans_labels(df, "k", "v", 3).collect()}
    assert len({(i % 3, label) for i, label in got.items()}) == 3 == len(set(got.values()))


def test_superposition_from_sums(spark):
    from seqloom.operators import geometry

    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g in range(6):
        a = rng.normal(size=(12, 3)) * 5
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        b = a @ turn + rng.normal(size=3) + rng.normal(size=(12, 3)) * 0.3  # half of the turns are mirrored
        rows += [(g, *map(float, p), *map(float, q)) for p, q in zip(a, b)]
        want[g] = (np.sqrt(((a - b) ** 2).sum(1).mean()), geometry.kabsch(a, b)[2])
    df = spark.createDataFrame(rows, "g int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    got = {r["g"]: (r["rmsd"], r["aligned_rmsd"]) for r in geometry.superpose(df, ["g"]).collect()}
    assert all(np.allclose(got[g], want[g]) for g in want) and len(got) == 6


def test_few_atoms_and_empty_templates(spark):
    from seqloom.operators import templates

    queries = spark.createDataFrame([(1, 8), (2, 3)], "q_id int, length int")
    mapping = spark.createDataFrame([(1, q, q + 1) for q in range(6)] + [(2, 0, 0)], "q_id int, q int, h int")
    atoms = spark.createDataFrame([(i, h, "A", 1.0, 2.0, float(h)) for i in (1, 2) for h in range(9)], "q_id int, h int, letter string, x double, y double, z double")
    placed = templates.place_template(mapping, atoms, queries, ["q_id"])
    assert {r["q_id"]: r["reject_reason"] for r in placed.collect()} == {1: None, 2: "few_atoms"}
    out = templates.templates_or_empty(placed, queries, ["q_id"]).collect()
    assert sorted((r["q_id"], r["q"], r["letter"], r["mask"]) for r in out) == [(1, q, "A" if q < 6 else "-", int(q < 6)) for q in range(8)] + [(2, q, "-", 0) for q in range(3)]


def test_deleted_blocks(spark):
    df = spark.createDataFrame([("a", i) for i in range(200)], "g string, i int")
    kept = sorted(r["i"] for r in sampling.delete_blocks(df, ["g"], "i", 0.1, 2).collect())
    gone = sorted(set(range(200)) - set(kept))
    assert 0 in kept and 20 <= len(gone) + 1 and len(gone) <= 40
    assert sum(b - a > 1 for a, b in zip(gone, gone[1:])) <= 1  # two runs at most


def test_protein_chains_and_knee(spark):
    from seqloom.operators import assembly

    monomers = spark.createDataFrame([("f", 1, "ALA"), ("f", 1, "DA"), ("f", 2, "DA"), ("g", 1, "ALA")], "file_id string, entity int, monomer string")
    types = spark.createDataFrame([("f", "ALA", "L-PEPTIDE LINKING"), ("f", "DA", "DNA linking"), ("g", "ALA", "other")], "file_id string, monomer string, type string")
    chains = spark.createDataFrame([("f", 1, "A"), ("f", 1, "B"), ("f", 2, "C"), ("g", 1, "A")], "file_id string, entity int, chain string")
    assert {tuple(r) for r in assembly.protein_chains(monomers, types, chains).collect()} == {("f", "A"), ("f", "B")}
    assert assembly.knee(np.r_[np.linspace(0, 0.1, 90), np.linspace(0.2, 1, 10)]) == 89 and assembly.knee(np.ones(4)) == 3
