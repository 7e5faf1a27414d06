import pandas as pd
import pytest

from seqloom.llm import queries as plan
from seqloom.plans.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


def _t(name):
    return pd.read_parquet(f"{FOLDER}/{name}.parquet")


def row_groups(got):
    rows = _t("msa_rows")
    assert sorted(got.row_id) == sorted(rows.row_id)
    assert (got.groupby("group_id").row_id.min() == got.groupby("group_id").group_id.first()).all()
    assert (got.groupby("group_id").msa_id.nunique() == 1).all() and (got.groupby("confirmed").group_id.nunique() == 1).all()


def components(got):
    assert len(got) and (got.first_row_id < got.row_id).all() and got.row_id.is_unique


def groups(got):
    rows = _t("msa_rows")
    assert got.n_rows.sum() == len(rows) and got.group_id.is_unique
    assert all(1 <= len(x) == min(3, n) for x, n in zip(got.typical_rows, got.n_rows))
    of = dict(zip(rows.row_id, rows.msa_id))
    assert all(of[r] == m for m, line in zip(got.msa_id, got.typical_rows) for r in line)


def chosen(got):
    wanted, size = _t("subset_requests").set_index("msa_id").subset_size, _t("msa_rows").groupby("msa_id").size()
    assert got.row_id.is_unique
    assert got.groupby("msa_id").size().to_dict() == {m: min(k, size[m]) for m, k in wanted.items() if m in size}


def leaks(got):
    assert got[["doc_id", "item_id"]].drop_duplicates().shape[0] == len(got) > 0 and got.best_edits.between(0, 2).all()
    assert ((got.n_passages > 0) == (got.best_edits == 0)).all()


def report(got):
    targets = _t("mix_targets").set_index("source")
    assert sorted(got.source) == sorted(targets.index)
    for r in got.itertuples():
        assert r.mixed_tokens <= r.capacity_tokens and r.falls_short == (r.capacity_tokens < r.goal_tokens)
        assert abs(r.planned_share * r.goal_tokens - r.mixed_tokens * r.target_share) <= 1e-6 * max(1, r.goal_tokens)
    assert abs(got.actual_share.sum() - 1) < 1e-9 and abs(got.goal_tokens.sum() * got.target_share.iloc[0] - got.goal_tokens.iloc[0]) < 1e-3


def mixed(got):
    docs, targets = _t("documents"), _t("mix_targets").set_index("source")
    assert set(got.doc_id) <= set(docs.doc_id) and not got.duplicated(["doc_id", "copy_no"]).any()
    assert (got.groupby("doc_id").copy_no.max() == got.groupby("doc_id").size()).all()
    assert all(n <= targets.max_repeats[t] for t, n in got.groupby("target").copy_no.max().items())
    text = dict(zip(docs.doc_id, docs.text.fillna("")))
    assert all(text[d] == (x or "") for d, x in zip(got.doc_id, got.text))


def pages(got):
    docs = _t("documents")
    assert got.doc_id.is_unique and set(got.doc_id) <= set(docs.doc_id[docs.text.fillna("").str.strip() != ""])
    assert (got.is_keyword_page == (got.keyword_share > 0.5)).all() and got.keyword_share.between(0, 1).all() and (got.n_words > 0).all()
    assert got[got.is_keyword_page].pmi_gain.median() < got[~got.is_keyword_page].pmi_gain.median() - 2


def found_pages(got):
    text = dict(zip(_t("documents").doc_id, _t("documents").text))
    assert 0 < len(got) < 0.2 * len(text) and got.doc_id.is_unique


EXPECTED = {
    "p2_row_groups": row_groups, "p2_components": components, "p2_groups": groups, "p3_subsets": chosen, "p6_leaks": leaks,
    "p7_report": report, "p7_mix": mixed, "p8_pages": pages, "p8_found": found_pages,
}


@pytest.mark.parametrize("name", list(plan.queries()))
def test_query(spark, name):
    query, sql = plan.queries()[name], plan.oracle_sql().get(name)
    if sql:
        ours_columns, ours, theirs_columns, theirs = compare(spark, connect(FOLDER), query, sql, FOLDER)
        assert ours_columns == theirs_columns and ours == theirs
    else:
        EXPECTED[name](query(spark, FOLDER).toPandas())
