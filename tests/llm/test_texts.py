import random

import numpy as np
import pandas as pd
import pytest

from seqloom.llm import keyword_pages, leaks
from seqloom.llm import queries as plan


def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, w in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != w)))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(0)
    for _ in range(300):
        p = [rng.choice("abc") for _ in range(rng.randrange(1, 80))]
        t = [rng.choice("abc") for _ in range(rng.randrange(0, 90))]
        want = edit_distance_in(p, t)
        assert leaks.myers_best(p, t, 100) == want
        assert leaks.myers_best(p, t, 1) == min(want, 2)


def words(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


VOCAB = [f"w{i}" for i in range(400)]


def test_myers_of_many_rows():
    rng = np.random.default_rng(0)
    for m in (1, 5, 13, 64):
        p, t = rng.integers(1, 4, (50, m)), rng.integers(1, 4, (50, 30))
        assert leaks.myers_rows(p, t).tolist() == [edit_distance_in(list(a), list(b)) for a, b in zip(p, t)]


@pytest.mark.parametrize("bits", [26, 8])
def test_leaks(spark, monkeypatch, bits):
    """A small bitmap lets more through to the join; the result is the same."""
    monkeypatch.setattr(leaks, "BITMAP_BITS", bits)
    monkeypatch.setattr(leaks, "BITMAP_BLOCKS", 8)
    rng = random.Random(5)
    shared = words(rng, 15)
    items = {i: words(rng, 30) + (shared if i < 2 else []) for i in range(6)}
    docs, exact, near = {}, set(), set()
    for d in range(40):
        w, item = words(rng, 50), d % 6
        part = items[item][5:18]
        kind = d % 5
        if kind == 1:
            w[20:20] = part
            exact.add((d, item))
        elif kind == 2:
            w[20:20] = [*part[:6], "other", *part[7:]]
            near.add((d, item))
        elif kind == 3:
            w[20:20] = part[:12]
            near.add((d, item))
        elif kind == 4:
            w[20:20] = shared
            near |= {(d, 0), (d, 1)}  # all but the first word of a passage that leads into the shared one
        docs[d] = w
    rows = [(d, " ".join(w).upper().replace(" ", ", ")) for d, w in docs.items()] + [(100, None), (101, ""), (102, "  "), (103, "é " * 30000)]
    df = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, item_id long")
    its = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(77, None), (78, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leaks.leaks(df, its).collect()}
    assert {k for k, r in got.items() if r["n_passages"] > 0} == exact
    assert {k for k, r in got.items() if r["n_passages"] == 0 and r["best_edits"] == 1} == near
    assert leaks.leaks(df.limit(0), its).count() == 0 and leaks.leaks(df, its.limit(0)).count() == 0


def test_short_items_and_missing_ids(spark):
    its = spark.createDataFrame([(1, "Alpha beta, gamma delta"), (2, "omega"), (3, " "), (None, "omega omega")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x alpha BETA gamma delta y"), (2, "alpha beta gamma"), (3, "an omega"), (None, "omega"), (4, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["best_edits"], r["n_passages"]) for r in leaks.leaks(df, its).collect()}
    assert got == {(1, 1, 0, 1), (3, 2, 0, 1)}


def test_leaks_equal_all_passages_against_all_documents(spark):
    folder, span, budget = "/root/testdata/sf0.001", 13, 2
    docs, items = (pd.read_parquet(f"{folder}/{t}.parquet") for t in ("documents", "eval_items"))
    number, owners, want = {}, {}, {}
    code = lambda ws: [number.setdefault(w, len(number) + 1) for w in ws]
    for i, text in zip(items["item_id"], items["text"]):
        w = code(leaks.words_of(text))
        for k in range(max(1, len(w) - span + 1)):
            owners.setdefault(tuple(w[k : k + span]), set()).add(i)
    for size in {len(p) for p, own in owners.items() if len(own) == 1 and p}:
        some = [(p, min(own)) for p, own in owners.items() if len(own) == 1 and len(p) == size]
        patterns, of = np.array([p for p, _ in some]), np.array([i for _, i in some])
        most = leaks.budget_of(size, span, budget)
        for d, text in zip(docs["doc_id"], docs["text"]):
            w = np.array(code(leaks.words_of(text or "")))
            near = patterns if not len(w) else patterns[(hit := np.isin(patterns, w).sum(1) >= size - most)]
            if len(w) and len(near):
                for i, e in zip(of[hit], leaks.myers_rows(near, np.broadcast_to(w, (len(near), len(w))))):
                    if e <= most:
                        low, n = want.get((d, i), (e, 0))
                        want[d, i] = (min(low, e), n + (e == 0))
    got = {(r["doc_id"], r["item_id"]): (r["best_edits"], r["n_passages"]) for r in plan.p6_leaks(spark, folder).collect()}
    assert got == want and len(got) > 3


def test_keyword_pages(spark):
    rng = random.Random(9)
    subjects, verbs, objects = ([f"{k}{c}" for c in "abcdefghij"] for k in ("sub", "verb", "obj"))
    keys = [f"key{c}" for c in "abcdefghijkl"]

    def sentence():
        return f"the {rng.choice(subjects)} of this {rng.choice(verbs)} was left with its {rng.choice(objects)} and then kept."

    rows = []
    for i in range(300):
        kind = i % 10
        if kind == 0:
            text = " ".join(rng.choice(keys) for _ in range(60))
        elif kind == 1:
            text = sentence() + " " + "; ".join(f"{rng.choice(keys)} {rng.choice(keys)}" for _ in range(30))
        elif kind == 2:
            text = "\n".join(f"{rng.choice(keys)} https://site{rng.randrange(99)}.test/a/b?id={k}" for k in range(30))
        elif kind == 3:
            text = " ".join(sentence() for _ in range(6)) + " https://one.test/a https://two.test/b " + rng.choice(keys)
        else:
            text = " ".join(sentence() for _ in range(6))
        rows.append((i, text))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "12 13 14"), (904, " ".join(keys) * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    got = {r["doc_id"]: r for r in keyword_pages.keyword_share(df).collect()}
    assert set(got) == {i for i, t in rows if t and t.strip()}
    assert {i for i, r in got.items() if r["is_keyword_page"] and i < 900} == {i for i in range(300) if i % 10 in (0, 1, 2)}
    assert keyword_pages.keyword_share(df.limit(0)).count() == 0


def test_repeated_phrases(spark):
    rng = random.Random(4)

    def name():
        return "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4))

    def prose(n):
        return " ".join(f"the {name()} of this {name()} was left with its {name()} and then kept." for _ in range(n))

    rows, want = [], set()
    for i in range(80):
        phrase, kind = " ".join(name() for _ in range(4)), i % 8
        if kind == 0:
            text = " ".join([phrase] * 60)
        elif kind == 1:
            text = prose(4) + "\n" + "; ".join(rng.choice([phrase, phrase[::-1], phrase[5:] + "x"]) for _ in range(60))
        elif kind == 2:
            text = "\n".join(f"warn: negative gap length at row {rng.randrange(9999)}" for _ in range(60))
        elif kind == 3:
            text = "\n".join(f"melting point of the antibody {name()} was {rng.randrange(99)}.{k} degrees" for k in range(60))
        elif kind == 4:
            text = prose(12) + " " + " ".join([phrase] * 6)
        else:
            text = prose(12)
        rows.append((i, text))
        if kind < 2:
            want.add(i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in keyword_pages.keyword_share(df).collect() if r["is_keyword_page"]} == want


def test_rare_keywords(spark, monkeypatch):
    rng = random.Random(6)

    def names(n):
        return ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5)) for _ in range(n)]

    subjects = names(9)
    prose = [" ".join(f"the {rng.choice(subjects)} of this {names(1)[0]} was left with its {rng.choice(subjects)} and then kept." for _ in range(8)) for _ in range(60)]
    pages = [" ".join(rng.choice(own) for _ in range(60)) for own in (names(12) for _ in range(15))]  # words of one page only
    df = spark.createDataFrame(list(enumerate(prose + pages + pages[:2])), "doc_id long, text string").repartition(3)
    got = keyword_pages.keyword_share(df).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got if r["is_keyword_page"]] == list(range(60, 77))
    for most in (400, 5, 1):  # the bound of shipped words says nothing about the result
        monkeypatch.setattr(keyword_pages, "MAX_WORDS", most)
        monkeypatch.setattr(keyword_pages, "MAX_PAIRS", 10 * most)
        assert keyword_pages.keyword_share(df).orderBy("doc_id").collect() == got


def test_all_three_measures_decide(spark, monkeypatch):
    """Word salad is found by low PMI and order-free neighbours, repeated phrases by collocations; without either they aren't."""
    rng = random.Random(11)
    keys = [f"key{c}" for c in "abcdefghijkl"]
    prose = [f"the {rng.choice('abcd')}x of this {rng.choice('efgh')}y was left with its {rng.choice('ijkl')}z and then kept. " * 5 for _ in range(40)]
    salad = [" ".join(rng.choice(keys) for _ in range(60)) for _ in range(8)]
    phrases = [" ".join([f"red{i} small{i} wooden{i} boat{i}".replace(str(i), "abcdefgh"[i])] * 40) for i in range(8)]
    df = spark.createDataFrame(list(enumerate(prose + salad + phrases)), "doc_id long, text string")
    found = lambda: {r["doc_id"] for r in keyword_pages.keyword_share(df).collect() if r["is_keyword_page"]}
    rows = {r["doc_id"]: r for r in keyword_pages.keyword_share(df).collect()}
    assert max(rows[i]["pmi_gain"] for i in range(40, 48)) < min(rows[i]["pmi_gain"] for i in range(40))
    assert {i for i, r in rows.items() if r["is_keyword_page"]} >= set(range(40, 56))
    real = keyword_pages.GAIN
    monkeypatch.setattr(keyword_pages, "GAIN", -1e9)  # every window coherent
    assert not found() & set(range(40, 48))
    monkeypatch.setattr(keyword_pages, "GAIN", real)
    monkeypatch.setattr(keyword_pages, "REPEATS", 10_000)
    assert not found() & set(range(48, 56))
