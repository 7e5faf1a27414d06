import datetime as dt
import json
import random

from pyspark.sql import functions as F

from seqloom.llm import formatting, mixture

SPELLINGS = [
    lambda s, d: json.dumps({"sequences": s, "deletion_matrix": d}),
    lambda s, d: '{ "DELETION_MATRIX":[' + " ,".join(map(str, d)) + '],\n  "SEQUENCES" : "' + s.lower() + '"}',
    lambda s, d: s.replace("-", ".") + "\t(" + "; ".join(map(str, d)) + ")",
    lambda s, d: " ".join(map(str, d)) + "\t" + s[:2] + "\n" + s[2:] + "*",
    lambda s, d: f"<deletion_matrix>[{','.join(map(str, d))}]</deletion_matrix> <sequences>{s}</sequences>",
    lambda s, d: f"Sequences: {s}||Deletion_Matrix=" + "\n".join(map(str, d)),
]


def table(spark):
    rng = random.Random(4)
    rows, truth, i = [], {}, 0
    for r in range(12):
        s = "".join(rng.choice("ACDX-") for _ in range(12))
        d = [rng.choice([0, 0, 1, 12]) for _ in range(12)]
        for k in range(1 + r % 5):
            i += 1
            rows.append((i, rng.choice(SPELLINGS)(s, d), dt.datetime(2024, 1, 1 + i % 20) if k else None, "other"))
            truth.setdefault((s, tuple(d)), []).append(i)
    rows += [(900, None, None, "x"), (901, "", dt.datetime(2024, 2, 1), "x"), (902, "  ", None, "x")]
    truth["empty"] = [901, 902]
    schema = "record_id long, line string, at timestamp, key_c string"
    return spark.createDataFrame(rows, schema), truth


def test_ledger_counts_copies_in_any_number_of_batches(spark):
    df, truth = table(spark)
    for n in (1, 3):
        ledger, keyed = formatting.ledger_of(df, "line", "record_id", "at", "at", n_batches=n, n_buckets=4)
        assert sorted((r["first_id"], r["copies"]) for r in ledger.table().collect()) == sorted((min(v), len(v)) for v in truth.values())
        got = {r["record_id"]: (r["first_id"], r["copies"]) for r in formatting.copies_of(keyed, ledger, "record_id").collect()}
        assert got == {i: (min(v), len(v)) for v in truth.values() for i in v}
        hot = {r["record_id"]: r["first_id"] for r in formatting.copies_of(keyed, ledger, "record_id", hot_copies=2).collect()}
        assert hot == {i: min(v) for v in truth.values() for i in v}


def test_a_batch_counts_once_and_touches_its_buckets_only(spark):
    df, _ = table(spark)
    keyed = formatting.with_record_key(df, "line")
    ledger = formatting.CopyLedger(spark, n_buckets=8)
    ledger.update(keyed, "a", "record_id", "at")
    before = dict(ledger.live)
    ledger.update(keyed, "a", "record_id", "at")
    assert ledger.live == before
    ledger.update(keyed.filter("record_id = 1"), "b", "record_id", "at")
    assert sum(before[b] != ledger.live[b] for b in before) == 1
    assert ledger.table().agg(F.sum("copies")).first()[0] == df.filter("line is not null").count() + 1


def test_ledger_goes_on_in_another_process(spark, tmp_path):
    df, truth = table(spark)
    keyed = formatting.with_record_key(df, "line")
    path = f"file://{tmp_path}/ledger"
    first = formatting.CopyLedger(spark, path, bucket_rows=3)
    first.update(keyed.filter("record_id < 15"), "a", "record_id", "at")
    again = formatting.CopyLedger(spark, path, bucket_rows=3)
    assert again.live == first.live and again.done == {"a"} and again.n_buckets > 1
    again.update(keyed.filter("record_id < 15"), "a", "record_id", "at")
    again.update(keyed.filter("record_id >= 15"), "b", "record_id", "at")
    last = formatting.CopyLedger(spark, path, bucket_rows=3)
    assert sorted((r["first_id"], r["copies"]) for r in last.table().collect()) == sorted((min(v), len(v)) for v in truth.values())
    assert last.n_keys == len(truth) and last.n_buckets * 3 >= last.n_keys
    on_disk = {(int(v.name[8:]), int(b.name[7:])) for v in (tmp_path / "ledger").glob("version=*") for b in v.glob("bucket=*")}
    assert on_disk == {(v, b) for b, v in last.live.items()}  # old versions are gone
    # an update that ended before its manifest leaves nothing behind that counts
    (tmp_path / "ledger" / "version=99" / "bucket=0").mkdir(parents=True)
    assert formatting.CopyLedger(spark, path).table().count() == len(truth)


def test_empty_ledger(spark):
    df, _ = table(spark)
    ledger, keyed = formatting.ledger_of(df.limit(0), "line", "record_id", "at", "at")
    assert ledger.table().count() == 0 and formatting.copies_of(keyed, ledger, "record_id").count() == 0


def test_cut_poisson_has_the_mean():
    for rate, cap in [(0.3, 1), (0.9, 1), (1.7, 2), (0.01, 5), (4.9, 5), (2.5, 7)]:
        table = mixture.cut_poisson(rate, cap)
        assert abs(sum(1 - c for c in table[:-1]) - rate) < 1e-6 and table[-1] == 1.0
    assert mixture.cut_poisson(3, 2) == [0.0, 0.0, 1.0] and mixture.cut_poisson(0, 3) == [1.0]


def test_mix(spark):
    rows = [(i, ["web", " Web", "WEB "][i % 3], 10) for i in range(3000)] + [(5000 + i, "small", 10) for i in range(100)] + [(9000, None, 10), (None, "web", 0)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("web", 0.5, 1), ("small", 0.3, 4), ("absent", 0.2, 3)], "source string, target_share double, max_repeats int")
    plan = mixture.plan_mix(sized, targets)
    report = {r["source"]: r for r in mixture.mix_report(sized, plan).collect()}
    assert report["small"]["falls_short"] and report["absent"]["falls_short"] and not report["web"]["falls_short"]
    assert report["small"]["mixed_tokens"] == 4000 and report["absent"]["mixed_tokens"] == 0
    assert abs(report["web"]["mixed_tokens"] - 0.5 * 31010) < 0.05 * 31010
    mixed = mixture.mix(sized, plan)
    a, b = mixed.collect(), mixture.mix(sized.repartition(7), plan).collect()
    assert {(r["doc_id"], r["copy_no"]) for r in a} == {(r["doc_id"], r["copy_no"]) for r in b}
    assert max(r["copy_no"] for r in a if r["source"] == "web") == 1
    assert [r["shuffle_key"] for r in a] == sorted(r["shuffle_key"] for r in a)
    assert mixture.mix_report(sized.limit(0), mixture.plan_mix(sized.limit(0), targets)).count() == 3


def test_tokens(spark):
    df = spark.createDataFrame([("antibody models",), (None,), ("",), ("x " * 20000,)], "text string")
    for file in ("piece_bpe_32k.model", "byte_bpe_50k.json"):
        got = [r["n_tokens"] for r in mixture.with_tokens(df, "text", f"/opt/tokenizers/{file}").collect()]
        assert got[0] > 1 and got[1] == 0 and got[2] == 0 and got[3] >= 20000


def test_falls_short_is_what_the_draws_give(spark, monkeypatch):
    sized = spark.createDataFrame([(i, "web", 10) for i in range(500)] + [(5000 + i, "small", 10) for i in range(60)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("web", 0.6, 1), ("small", 0.4, 3)], "source string, target_share double, max_repeats int")
    short = lambda: {r["source"] for r in mixture.mix_report(sized, mixture.plan_mix(sized, targets)).filter("falls_short").collect()}
    assert short() == {"small"}
    monkeypatch.setattr(mixture, "cut_poisson", lambda rate, cap: [0.5, 1.0])
    assert short() == set()


def test_documents_without_id_draw_for_themselves(spark):
    sized = spark.createDataFrame([(None, "web", 10, f"text {i}") for i in range(400)], "doc_id long, source string, n_tokens long, text string")
    targets = spark.createDataFrame([("web", 0.5, 1)], "source string, target_share double, max_repeats int")
    assert 150 < mixture.mix(sized, mixture.plan_mix(sized, targets), text="text").count() < 250
