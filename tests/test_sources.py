from pyspark.sql import functions as F

from seqloom.sources import sequences as S
from seqloom.sources import structures as X
from seqloom.streaming import ingest_region_fasta


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "source_file string, value string")


def test_fasta(spark):
    got = S.read_fasta(files(spark, "junk\n>a b\nAC\n# note\nDE\n\n>c\nFG", ">x\r\nAA\r\n", "")).orderBy("source_file", "ord").collect()
    assert [tuple(r) for r in got] == [("f0", 0, "a b", "ACDE"), ("f0", 1, "c", "FG"), ("f1", 0, "x", "AA")]
    two = S.read_two_line(files(spark, ">a\nAC\n>b\nDE\n")).orderBy("ord").collect()
    assert [(r["name"], r["seq"]) for r in two] == [("a", "AC"), ("b", "DE")]


def test_fasta_zip_and_union(spark):
    a, b = S.read_fasta(files(spark, ">h1|x\nAA\n>h2\nBB")), S.read_fasta(files(spark, ">l1\nCC\n>l2\nDD"))
    assert [(r["name"], r["seq"]) for r in S.zip_fasta(a, b).orderBy("ord").collect()] == [("h1|x|l1", "AA*CC"), ("h2|l2", "BB*DD")]
    assert [(r["part"], r["group"]) for r in S.union_fasta([a, b]).orderBy("part", "ord").collect()] == [(0, "h1"), (0, "h2"), (1, "l1"), (1, "l2")]


def test_fasta_write(spark, tmp_path):
    S.to_fasta(S.read_fasta(files(spark, ">a\nAC\n>b\nDE")), str(tmp_path / "out"))
    text = S.whole_files(spark, str(tmp_path / "out")).first()["value"]
    assert text.strip() == ">a\nAC\n>b\nDE"


def test_a3m(spark):
    got = S.read_a3m(files(spark, ">q\nACD\n>h\naaA-bCDe\n")).orderBy("row_idx").collect()
    assert [(r["seq"], r["deletions"]) for r in got] == [("ACD", [0, 0, 0]), ("A-CD", [2, 0, 1, 0])]


def test_stockholm(spark):
    sto = files(spark, "# STOCKHOLM 1.0\n#=GS h DE some text\nq AC-D\nh A-EF\nd A--F\n\nq -G\nh H-\nd --\n//\n")
    got = {r["description"]: (r["seq"], r["deletions"]) for r in S.read_stockholm(sto).collect()}
    assert got == {"q": ("ACDG", [0, 0, 0, 0]), "h": ("A-F-", [0, 0, 1, 1]), "d": ("A-F-", [0, 0, 0, 0])}
    a3m = {r["name"]: r["a3m"] for r in S.stockholm_to_a3m(sto).collect()}
    assert a3m == {"q": "ACDG", "h some text": "A-eFh-", "d": "A-F-"}
    assert sorted(r["name"] for r in S.dedup_stockholm(sto).collect()) == ["h", "q"]
    assert {r["raw"] for r in S.drop_empty_columns(files(spark, "a A--B\nb A--C\n")).collect()} == {"AB", "AC"}
    assert S.stockholm_to_a3m(sto, most=1).count() == 1


def test_tables(spark, tmp_path):
    t = {r["target"]: r["e_value"] for r in S.read_tblout(files(spark, "# x\nhit1 - q - 1e-5 3\n")).collect()}
    assert t == {"hit1": 1e-5, "query": 0.0}
    (tmp_path / "c.csv").write_text("name,clonotype\na,x\nb,y\na,z\n")
    assert dict(S.read_clonotypes(spark, str(tmp_path / "c.csv")).collect()) == {"a": "z", "b": "y"}
    assert [r["name"] for r in S.split_multi_a3m(files(spark, ">a 1\nAA\n\x00>b\nBB\n")).orderBy("part").collect()] == ["a", "b"]
    cat = S.bucket_catalog(spark.createDataFrame([("s0/H_7_5_17_79.fasta",)], "path string")).first()
    assert tuple(cat)[1:] == ("H", 7, 5, 17, 79)


def test_alignment_index(spark):
    f = spark.createDataFrame([("d", "b", "xyz"), ("d", "a", "ä1")], "db string, name string, value string")
    idx = S.build_index(f)
    assert [(r["name"], r["start"], r["size"]) for r in idx.orderBy("name").collect()] == [("a", 0, 3), ("b", 3, 3)]
    blob = spark.createDataFrame([("d", bytearray("ä1xyz".encode()))], "db string, content binary")
    assert {r["name"]: r["value"] for r in S.read_range(blob, idx).collect()} == {"a": "ä1", "b": "xyz"}
    other = idx.withColumn("start", F.lit(9).cast("long")).filter("name = 'a'")
    assert {r["name"]: r["start"] for r in S.unify_indices([idx, other]).collect()} == {"a": 9, "b": 3}


CIF = """data_X
_refine.ls_d_res_high 2.50
loop_
_pdbx_audit_revision_history.revision_date
2010-05-01
2009-01-02
loop_
_atom_site.id
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.B_iso_or_equiv
_atom_site.pdbx_PDB_model_num
1 'CA' GLY A 5 1.0 2.0 3.0 10.0 1
2 CB ALA A 6 1.5 2.5 3.5 11.0 1
3 CB ALA A 6 9.5 2.5 3.5 11.0 2
"""


def test_structures(spark):
    atoms = X.read_cif_atoms(files(spark, CIF)).collect()
    assert [(r["release_date"], r["resolution"], r["residue_number"], r["atom"], r["x"]) for r in atoms] == [("2009-01-02", 2.5, 5, "CA", 1.0), ("2009-01-02", 2.5, 6, "CB", 1.5)]
    df = spark.createDataFrame([(1, "CA", "GLY", "A", 5, 1.0, -2.0, 3.5, 10.0)], "s int, a string, r string, c string, n int, x double, y double, z double, b double")
    line = df.select(X.pdb_lines(*[F.col(c) for c in "sarcnxyzb"]).alias("value")).first()[0]
    assert len(line) == 80
    back = X.read_pdb_atoms(files(spark, line + "\nENDMDL\n" + line)).collect()
    assert [(r["chain"], r["residue_number"], r["residue"], r["atom"], r["x"], r["y"], r["z"], r["b"]) for r in back] == [("A", 5, "GLY", "CA", 1.0, -2.0, 3.5, 10.0)]


HHR = "Query q\n\nNo 1\n>1abc_A some\nProbab=99.0 E-value=1e-3 Score=9 Aligned_cols=4 Identities=50% Similarity=0.5 Sum_probs=3.5 Template_Neff=1\n\nQ q 2 AC-D 4 (10)\nT Consensus 5 acde 8 (20)\nT 1abc_A 5 ACED 8 (20)\n\n"


def test_hits(spark):
    r = X.read_hhr(files(spark, HHR, "nothing")).collect()
    assert len(r) == 1 and r[0]["name"] == "1abc_A some" and r[0]["sum_probs"] == 3.5
    assert (r[0]["query"], r[0]["hit_sequence"], r[0]["indices_query"], r[0]["indices_hit"]) == ("AC-D", "ACED", [1, 2, -1, 3], [4, 5, 6, 7])
    d = spark.createDataFrame([("1ABC_B/3-50 mol:protein length:120 heavy",), ("bad",)], "t string").select(X.hmm_description(F.col("t")).alias("d")).collect()
    assert tuple(d[0]["d"]) == ("1abc", "B", 3, 50, 120, "heavy") and d[1]["d"] is None


def test_fixed_columns(spark):
    obs = X.read_obsolete(files(spark, "OBSLTE    31-JUL-94 116L     216L\nOBSLTE    29-JAN-96 125D\n")).collect()
    assert [tuple(r) for r in obs] == [("116l", "216l")]
    dates = X.read_release_dates(files(spark, '{"1abc": {"release_date": "2020-01-02"}}')).first()
    assert dates["id"] == "1ABC" and str(dates["release_date"]) == "2020-01-02"
    pn = X.read_proteinnet(files(spark, "[ID]\nT1\n[PRIMARY]\nAC\n[TERTIARY]\n100 200\n300 400\n[MASK]\n++\n")).first()
    assert pn["id"] == "T1" and pn["primary"] == "AC" and pn["mask"] == "++" and [round(x, 2) for x in pn["tertiary"]] == [1.0, 2.0, 3.0, 4.0]


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(">a\nAC*D--E*F\n")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck"))
    ingest_region_fasta(*args).awaitTermination()
    (tmp_path / "in" / "b.fasta").write_text(">b\nA*B\n")
    ingest_region_fasta(*args).awaitTermination()
    assert sorted((r["name"], r["lens"]) for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [("a", [2, 2, 1]), ("b", [1, 1])]


def test_fasta_records_of_split_files(spark, tmp_path):
    """Files cut into many splits give the same records as whole ones."""
    import random

    rng = random.Random(1)
    want = []
    for f in range(3):
        text = "; a remark before the first record\n\n" if f == 1 else ""
        for i in range(400):
            seq = "".join(rng.choice("ACDEFG") for _ in range(rng.randrange(0, 90)))
            lines = [seq[k : k + 30] for k in range(0, len(seq), 30)]
            text += f">f{f}_{i} some text\n" + "\n".join(["# note", "", *lines] if i % 5 == 0 else lines) + ("\r\n" if i % 7 == 0 else "\n")
            want.append((f"f{f}_{i} some text", seq))
        (tmp_path / f"f{f}.fasta").write_text(text if f else text.rstrip("\n"), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = S.read_fasta_records(spark, f"file://{tmp_path}")
        assert got.rdd.getNumPartitions() > 10
        assert sorted((r["name"], r["seq"]) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_file_ranges(spark, tmp_path):
    (tmp_path / "a.db").write_bytes("onetwoéthree".encode())
    index = spark.createDataFrame([("a.db", "x", 0, 3), ("a.db", "y", 3, 5), ("a.db", "z", 8, 5)], "db string, name string, start long, size long")
    assert {r["name"]: r["value"] for r in S.read_file_ranges(index, str(tmp_path)).collect()} == {"x": "one", "y": "twoé", "z": "three"}
