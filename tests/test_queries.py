import importlib

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from seqloom.operators import geometry
from seqloom.plans.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
PLANS = [importlib.import_module(f"seqloom.plans.{m}") for m in entry._MODULES]
QUERIES = {n: q for p in PLANS for n, q in p.queries().items()}
ORACLE = {n: s for p in PLANS for n, s in p.oracle_sql().items()}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def _t(name):
    return pd.read_parquet(f"{FOLDER}/{name}.parquet")


def _sizes():
    return _t("msa_rows").groupby("msa_id").size()


def unpaired(got):
    """tests/test_search.py holds the operator against a walk; here: whole buckets or close rows, nearest first."""
    store = _t("bucket_store").set_index("row_ord")
    assert not got.duplicated(["query_id", "row_ord"]).any() and (got.query_id % 20 == 0).all() and len(got)
    assert (store.path[got.row_ord].to_numpy() == got.path.to_numpy()).all()
    assert (got.groupby(["query_id", "path"])["rank"].nunique() == 1).all()


def random_unknown(got):
    rows = _t("msa_rows").set_index("row_id")
    had = rows.seq.str.upper().str.count("X")[got.row_id].to_numpy()
    letters = rows.seq.str.upper().str.count("[A-Z]")[got.row_id].to_numpy()
    assert (got.n_unknown >= had).all() and 0.07 < (got.n_unknown - had).sum() / letters.sum() < 0.13


def contiguous_crop(got):
    full = _t("chains").set_index("chain_id").full_seq.str.upper().str.replace("[^A-Z]", "", regex=True)
    for r in got.itertuples():
        whole = full[r.chain_id]
        assert r.full_seq == whole[r.crop_start : r.crop_start + 64] and len(r.full_seq) == min(64, len(whole))


def uniform_sample(got):
    size = _sizes()
    kept = got[~got.is_extra].groupby("msa_id").size()
    assert kept.to_dict() == {m: min(32, n) for m, n in size.items()} and len(got) == size.sum()
    first = _t("msa_rows").query("row_idx == 0").row_id
    assert set(first) <= set(got[~got.is_extra].row_id)


def gumbel_order(got):
    assert got.groupby("msa_id").place.apply(lambda p: sorted(p) == list(range(len(p)))).all()
    assert set(got[got.place == 0].row_id) <= set(_t("msa_rows").query("row_idx == 0").row_id)


def masked_cells(got):
    rows = _t("msa_rows").set_index("row_id")
    assert (rows.seq.str.len()[got.row_id].to_numpy() == got.n).all()
    assert 0.08 < got.n_changed.sum() / got.n.sum() < 0.15  # 15 % touched, a tenth of those stays and some draw the same


def delete_blocks(got):
    first = _t("msa_rows").query("row_idx == 0").row_id
    assert set(first) <= set(got.row_id) and 0 < len(got) < len(_t("msa_rows")) and got.row_id.is_unique


def stochastic_keep(got):
    chains = _t("chains").dropna(subset=["full_seq"])
    assert set(got.chain_id) <= set(chains.chain_id)
    want = (0.5 * chains.full_seq.str.len().clip(256, 512) / 512).sum()
    assert abs(len(got) - want) < 4 * max(1, want) ** 0.5


def mixture_draws(got):
    n = dict(zip(got.dataset, got.n))
    assert sum(n.values()) == 1000 and abs(n["structures"] - 700) < 60


def superpose(got):
    e = _t("embeddings")
    for r in got.itertuples():
        own = e[e.label == r.label]
        a = np.array(own.embedding.tolist(), float)[:, :3] * 10
        b = a.copy()
        b[:, 0] += np.sin(own.vec_id.to_numpy(float))
        b[:, 1] *= 1.1
        assert r.n == len(a) and abs(r.rmsd - np.sqrt(((a - b) ** 2).sum(1).mean())) < 1e-5 and abs(r.aligned_rmsd - geometry.kabsch(a, b)[2]) < 1e-5


def rmsd_models(got):
    e, points = _t("embeddings").sort_values("vec_id"), {}
    for label, own in e.groupby("label"):
        points[label] = np.array(own.embedding.tolist(), float)[:, :3] * 10
    for r in got.itertuples():
        others = [p for m, p in points.items() if m != r.model]
        own = points[r.model]
        far = [geometry.kabsch(own[: min(len(own), len(p))], p[: min(len(own), len(p))])[2] for p in others]
        assert abs(r.mean_rmsd - np.mean(far)) < 1e-4


def density_clusters(got):
    e = _t("embeddings")
    x = np.array(e.sort_values("vec_id").embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert sorted(got.vec_id) == sorted(e.vec_id)
    for label, own in got[got.label > 0].groupby("label"):
        assert len(own) >= 5  # a cluster has its least size, and label 0 is noise
    assert got.label.min() >= 0


def kmeans_labels(got):
    e = _t("embeddings").set_index("vec_id")
    assert sorted(got.vec_id) == sorted(e.index) and got.label.between(0, 9).all() and got.label.nunique() > 1
    u = np.array(e.embedding[got.vec_id].tolist(), float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    f = 1 - u @ u.T  # the rows of the distance matrix: each is nearest to its own cluster's mean
    means = np.stack([f[got.label.to_numpy() == k].mean(0) for k in sorted(got.label.unique())])
    near = ((f[:, None, :] - means[None]) ** 2).sum(2).argmin(1)
    assert (np.array(sorted(got.label.unique()))[near] == got.label.to_numpy()).mean() > 0.97


def quota_sample(got):
    """The walk over clusters from small to large, middle rows of equal stretches."""
    m, want = _t("msa_rows").sort_values(["row_idx", "row_id"]), set()
    m["cluster"] = m.seq.str.upper().str.count("[AL]") % 5
    for msa, rows in m.groupby("msa_id"):
        clusters = sorted((min(len(c), 512), int(c.row_idx.iloc[0]) * 10**9 + int(c.row_id.iloc[0]), k) for k, c in rows.groupby("cluster"))
        taken = 0
        for i, (n, _, k) in enumerate(clusters):
            quota = min(n, (64 - taken) // (len(clusters) - i))
            taken += quota
            ids = rows[rows.cluster == k].row_id.tolist()[:512]
            want |= {(msa, k, int(part[len(part) // 2])) for part in np.array_split(np.array(ids), quota)} if quota else set()
    assert {tuple(r) for r in got[["msa_id", "cluster", "row_id"]].itertuples(index=False)} == want


EXPECTED = {f.__name__: f for f in (quota_sample, random_unknown, contiguous_crop, uniform_sample, gumbel_order, masked_cells, delete_blocks, stochastic_keep, mixture_draws, superpose, rmsd_models, density_clusters, kmeans_labels)} | {"unpaired_search": unpaired}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE:
        ours_columns, ours, theirs_columns, theirs = compare(spark, con, QUERIES[name], ORACLE[name], FOLDER)
        assert ours_columns == theirs_columns and ours == theirs
    else:
        EXPECTED[name](QUERIES[name](spark, FOLDER).toPandas())


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
