import numpy as np
from pyspark.sql import functions as F

from seqloom.functions import columns as C
from seqloom.operators import clustering as K
from seqloom.operators import geometry as G
from seqloom.operators import ranking as R
from seqloom.operators import templates as H
from seqloom.sources import sequences as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0] if values else spark.range(1).select(column.alias("x")).first()[0]


def test_species(spark):
    rows = ["tr|A0A146SKV9|A0A146SKV9_FUNHE/3-9 x", "sp|P12345_1|ALBU_HUMAN_2", "sp|P1|A_B", "", "  tr|A0A146SKV9|X_MOUSE", None]
    df = spark.createDataFrame([(r,) for r in rows], "d string")
    assert [r[0] for r in df.select(C.species_id(F.col("d"))).collect()] == ["FUNHE", "HUMAN", "", "", "MOUSE", ""]


def test_names(spark):
    assert one(spark, C.safe_name(F.lit('a<b:"/\\|?*+-()[]{}c d,e'))) == "abc_d_e"
    assert [one(spark, C.spreadsheet_id(F.lit(n))) for n in (1, 26, 27, 28, 703)] == ["A", "Z", "AA", "BA", "AAA"]


def test_distances(spark):
    assert one(spark, C.popcount_hamming(F.lit("AC"), F.lit("CA"))) == 2
    assert one(spark, C.popcount_hamming(F.lit("AC"), F.lit("A"))) is None
    assert one(spark, C.symbol_hamming(F.lit(""), F.lit(""))) == 0
    assert one(spark, C.weighted_hamming(F.lit("ACD"), F.lit("AED"), F.array(F.lit(1.0), F.lit(3.0), F.lit(5.0)))) == 3.0


def test_genes(spark):
    pairs = [("IGHV1-3*01", "IGHV1-3*02", "*", True), ("IGHV1-3", "IGHV1-5", "-", True), ("IGHV1", "IGHV2", "-", True), ("IGHV1", "IGLV1", "V", False), ("A", "B", "*", True)]
    for a, b, mark, want in pairs:
        assert one(spark, C.similar_gene(F.lit(a), F.lit(b), mark)) is want


def test_substitution(spark):
    table = C.substitution_table("  A C -\nA 4 0 -4\nC 0 9 -4\n- -4 -4 1\n")
    assert table["C"]["C"] == 9
    score = C.substitution_score(F.lit("ACCA"), F.lit("AAC-"), table, weights=F.array(*[F.lit(2.0)] * 4), frozen=[1], strict_gap=[3])
    assert one(spark, score) == [8.0, 0.0, 18.0, -50.0]


def test_encoding(spark):
    codes = C.residue_codes(F.lit("acB-z*"))
    assert one(spark, codes) == [0, 1, 2, 21, 3, 20]
    assert one(spark, C.residue_text(C.recode(codes), C.INTERNAL_ORDER)) == "ACD-EX"
    assert one(spark, C.one_hot(F.array(F.lit(1), F.lit(0)), 2)) == [[0, 1], [1, 0]]


def test_region_json(spark):
    df = spark.createDataFrame([([2, 1, 2, 1, 2, 0, 1],)], "lens array<int>").withColumn("i", C.region_intervals(F.col("lens"), F.lit(3)))
    text = df.select(S.region_json(F.col("i"), F.lit("H"), F.lit(14), F.lit(3), F.lit(2)).alias("j"))
    got = S.read_region_json(text, "j").select("index.*").first()
    assert got["FRONT"] == [0, 3] and got["FR1"] == [3, 5] and got["CDR3"] == [11, 11] and got["BACK"] == [12, 14] and got["length"] == 14


def test_weights(spark):
    lens = F.array(*[F.lit(n) for n in (1, 0, 2, 0, 0, 0, 2, 0, 1)])
    assert one(spark, R.region_weights(lens, F.lit("H"))) == [0.0, 1.0, 1.0, 3.0, 3.0, 0.0]
    assert one(spark, R.region_weights(lens, F.lit("X"))) == [1.0] * 6
    assert one(spark, R.region_weights(lens, F.lit("X"), 0.0)) == [0.0] * 6


def test_index_and_mapping(spark):
    assert one(spark, H.index_array(F.lit("A-cD"), 5)) == [5, -1, 7]
    got = one(spark, H.residue_mapping(F.lit("CD-E"), F.lit("AA-G"), F.array(*[F.lit(x) for x in (4, 5, -1, 6)]), F.array(*[F.lit(x) for x in (9, 10, -1, 11)]), F.lit("XXCDE")))
    assert got == {2: 0, 3: 1, 4: 2}


def test_kabsch():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(20, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    rotation, shift, rmsd = G.kabsch(a, a @ q + [1, 2, 3])
    assert rmsd < 1e-9 and np.allclose(a @ rotation + shift, a @ q + [1, 2, 3])


def test_density_labels():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (25, 2)), [[2.5, 40.0]]])
    labels = K.density_labels(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 5)
    assert len(set(labels[:20])) == 1 and len(set(labels[20:45])) == 1 and labels[0] != labels[20] and labels[45] == -1
    assert (K.density_labels(np.zeros((3, 3)), 5) == -1).all()


def test_closure_and_empty(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "d"), ("n", None)], "from_id string, to_id string")
    assert dict(H.closure(links).collect()) == {"a": "d", "b": "d", "c": "d", "x": "d"}
    assert H.closure(links.limit(0)).count() == 0
