"""Coordinates as columns x, y, z: distances, superposition and similarity measures of structures."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance(a: Sequence[str], b: Sequence[str]) -> Column:
    return F.sqrt(sum(((F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(a, b)), F.lit(0.0)))


def _side(atoms: DataFrame, keys: Sequence[str], residue: str, tag: str) -> DataFrame:
    return atoms.select(*keys, F.col(residue).alias(f"r{tag}"), *[F.col(c).alias(f"{c}{tag}") for c in "xyz"])


def residue_pairs(atoms: DataFrame, keys: Sequence[str], residue: str) -> DataFrame:
    """All pairs of residues (r1 < r2) of one structure with their distance; a structure is bounded by its length."""
    a, b = _side(atoms, keys, residue, "1"), _side(atoms, keys, residue, "2")
    return a.join(b, list(keys)).filter("r1 < r2").select(*keys, "r1", "r2", distance(["x1", "y1", "z1"], ["x2", "y2", "z2"]).alias("d"))


def pseudo_beta(atoms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The CA atom of a glycine and the CB atom of any other residue. atoms: keys, aa, atom, x, y, z."""
    return atoms.filter(((F.col("aa") == "G") & (F.col("atom") == "CA")) | ((F.col("aa") != "G") & (F.col("atom") == "CB"))).select(*keys, "aa", "x", "y", "z")


def neighbour_breaks(atoms: DataFrame, chain: Sequence[str], residue: str, most: float = 150.0) -> DataFrame:
    """Consecutive residues of a chain with their distance; ``broken`` beyond the limit."""
    w = Window.partitionBy(*chain).orderBy(residue)
    before = atoms.withColumns({f"p{c}": F.lag(c).over(w) for c in "xyz"}).filter(F.col("px").isNotNull())
    return before.withColumn("d", distance("xyz", ["px", "py", "pz"])).withColumn("broken", F.col("d") > most).drop("px", "py", "pz")


def centre_distance(atoms: DataFrame, structure: Sequence[str]) -> DataFrame:
    """Per structure the mean distance of its atoms to the mean of all structures' centroids."""
    centroid = atoms.groupBy(*structure).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    common = centroid.agg(*[F.avg(f"c{c}").alias(f"m{c}") for c in "xyz"])  # one row
    return atoms.join(F.broadcast(common)).groupBy(*structure).agg(F.avg(distance("xyz", ["mx", "my", "mz"])).alias("centre_distance"))


def gdt(pairs: DataFrame, keys: Sequence[str], d: str, cutoffs: Sequence[float] = (1, 2, 4, 8)) -> DataFrame:
    """Mean over cutoffs of the share of residues within it; (0.5, 1, 2, 4) for the high-accuracy variant."""
    share = sum((F.avg((F.col(d) <= c).cast("double")) for c in cutoffs), F.lit(0.0)) / len(cutoffs)
    return pairs.groupBy(*keys).agg(share.alias("gdt"))


def drmsd(a: DataFrame, b: DataFrame, keys: Sequence[str], residue: str) -> DataFrame:
    """Root mean squared difference of the two models' residue distances."""
    x, y = residue_pairs(a, keys, residue), residue_pairs(b, keys, residue).withColumnRenamed("d", "e")
    return x.join(y, [*keys, "r1", "r2"]).groupBy(*keys).agg(F.sqrt(F.avg((F.col("d") - F.col("e")) * (F.col("d") - F.col("e")))).alias("drmsd"))


def lddt(model: DataFrame, truth: DataFrame, keys: Sequence[str], residue: str, within: float = 15.0) -> DataFrame:
    """Per residue the mean share of preserved distances (0.5, 1, 2, 4) to residues that are near in the truth."""
    pairs = residue_pairs(truth, keys, residue).filter(F.col("d") < within).join(residue_pairs(model, keys, residue).withColumnRenamed("d", "e"), [*keys, "r1", "r2"])
    off = F.abs(F.col("d") - F.col("e"))
    kept = sum(((off < c).cast("double") for c in (0.5, 1.0, 2.0, 4.0)), F.lit(0.0)) / 4
    scored = pairs.withColumn("kept", kept)
    return scored.select(*keys, F.explode(F.array("r1", "r2")).alias(residue), "kept").groupBy(*keys, residue).agg(F.avg("kept").alias("lddt"))


def distogram(pairs: DataFrame, keys: Sequence[str], d: str = "d", low: float = 2.0, high: float = 22.0, bins: int = 64) -> DataFrame:
    """Counts of residue distances by bin; the outer bins take what lies beyond."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(d) - low) / ((high - low) / bins)))).cast("int")
    return pairs.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def interface(atoms: DataFrame, structure: Sequence[str], chain: str, residue: str, within: float) -> DataFrame:
    """Residues with an atom of another chain of the structure nearer than a limit.

    Space is cut into cubes as wide as the limit and atoms meet only those of the 27 cubes around them.
    """
    cube = [F.floor(F.col(c) / within).cast("long").alias(f"g{c}") for c in "xyz"]
    base = atoms.select(*structure, F.col(chain).alias("c1"), F.col(residue).alias("r1"), *[F.col(c).alias(f"{c}1") for c in "xyz"], *cube)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    other = atoms.select(*structure, F.col(chain).alias("c2"), *[F.col(c).alias(f"{c}2") for c in "xyz"], *cube)
    for c in "xyz":
        other = other.withColumn("__o", F.explode(near)).withColumn(f"g{c}", F.col(f"g{c}") + F.col("__o")).drop("__o")
    met = base.join(other, [*structure, "gx", "gy", "gz"]).filter("c1 <> c2").withColumn("d", distance(["x1", "y1", "z1"], ["x2", "y2", "z2"])).filter(F.col("d") < within)
    return met.groupBy(*structure, F.col("c1").alias(chain), F.col("r1").alias(residue)).agg(F.min("d").alias("min_distance"))


def kabsch(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, translation and RMSD that put a onto b."""
    ca, cb = a.mean(0), b.mean(0)
    u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))])
    rotation = u @ flip @ vt
    moved = (a - ca) @ rotation + cb
    return rotation, cb - ca @ rotation, float(np.sqrt(((moved - b) ** 2).sum(1).mean()))


def superpose(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, rmsd, aligned_rmsd) of matched residues x1..z1 and x2..z2.

    The best rotation needs only the sums and products of the coordinates, so a group is aggregated, never gathered.
    """
    side = lambda n: [F.col(f"{c}{n}").cast("double") for c in "xyz"]
    a, b = side(1), side(2)
    sums = [F.array(*[F.sum(x) for x in a]).alias("sa"), F.array(*[F.sum(x) for x in b]).alias("sb"), F.array(*[F.sum(x * y) for x in a for y in b]).alias("sab")]
    squares = [F.sum(sum((x * x for x in v), F.lit(0.0))).alias(name) for v, name in ((a, "qa"), (b, "qb"))]
    off = F.sum(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)))
    held = pairs.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"), F.sqrt(off / F.count(F.lit(1))).alias("rmsd"), *sums, *squares)

    def aligned(n: pd.Series, sa: pd.Series, sb: pd.Series, sab: pd.Series, qa: pd.Series, qb: pd.Series) -> pd.Series:
        out = []
        for k, x, y, xy, p, q in zip(n, sa, sb, sab, qa, qb):
            x, y = np.array(x), np.array(y)
            u, s, vt = np.linalg.svd(np.array(xy).reshape(3, 3) - np.outer(x, y) / k)
            s[2] *= np.sign(np.linalg.det(u @ vt)) or 1.0
            out.append(max(0.0, (p - x @ x / k) + (q - y @ y / k) - 2 * s.sum()) / k)
        return pd.Series(out) ** 0.5

    best = F.pandas_udf(aligned, "double")
    return held.select(*keys, "n", "rmsd", best("n", "sa", "sb", "sab", "qa", "qb").alias("aligned_rmsd"))


def expected_confidence(logits: Column, bins: int = 50) -> Column:
    """100 x the expectation of the bin centres under a softmax of logits."""
    top = F.array_max(logits)
    weight = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(weight, F.lit(0.0), lambda s, v: s + v)
    return 100 * F.aggregate(F.transform(weight, lambda w, i: w * (i + 0.5) / bins), F.lit(0.0), lambda s, v: s + v) / total


def expected_error(logits: Column, longest: float = 31.0) -> Column:
    """Expected aligned error of a pair: bins of equal width up to the longest, the last one open, under a softmax."""
    n = F.size(logits)
    top = F.array_max(logits)
    weight = F.transform(logits, lambda v: F.exp(v - top))
    step = F.lit(longest) / (n - 1)
    return F.aggregate(F.transform(weight, lambda w, i: w * (i + 0.5) * step), F.lit(0.0), lambda s, v: s + v) / F.aggregate(weight, F.lit(0.0), lambda s, v: s + v)


def template_score(pairs: DataFrame, keys: Sequence[str], residue: str, error_logits: str, n: str, longest: float = 31.0) -> DataFrame:
    """Predicted TM score: the best residue's mean over its pairs of the expectation of 1 / (1 + (error / d0)^2).

    pairs: keys, residue (the one that is aligned on), logits of a pair's error, and n, the residues of the structure.
    """
    m = F.greatest(F.col(n), F.lit(19)).cast("double")
    d0 = 1.24 * F.pow(m - 15, F.lit(1.0 / 3)) - 1.8
    top = F.array_max(error_logits)
    weight = F.transform(error_logits, lambda v: F.exp(v - top))
    step = F.lit(longest) / (F.size(error_logits) - 1)
    value = F.aggregate(F.transform(weight, lambda w, i: w / (1 + F.pow((i + 0.5) * step / d0, F.lit(2.0)))), F.lit(0.0), lambda s, v: s + v) / F.aggregate(weight, F.lit(0.0), lambda s, v: s + v)
    each = pairs.withColumn("__v", value).groupBy(*keys, residue).agg(F.avg("__v").alias("__v"))
    return each.groupBy(*keys).agg(F.max("__v").alias("ptm"))


def _minus(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [p - q for p, q in zip(a, b)]


def _cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _unit(a: Sequence[Column]) -> list[Column]:
    length = F.sqrt(F.greatest(_dot(a, a), F.lit(1e-20)))
    return [x / length for x in a]


def dihedral(a: Sequence[Column], b: Sequence[Column], c: Sequence[Column], d: Sequence[Column]) -> Column:
    """The angle of four points around the line from the second to the third, in radians."""
    u, v, w = _minus(b, a), _minus(c, b), _minus(d, c)
    m, n = _cross(u, v), _cross(v, w)
    return F.atan2(_dot(_cross(m, n), _unit(v)), _dot(m, n))


def residues(atoms: DataFrame, keys: Sequence[str], names: Sequence[str] = ("N", "CA", "C", "CB")) -> DataFrame:
    """One row for each residue: keys, aa, and for each atom name a column array of x, y, z, null where it is missing; ``n_atoms``.

    Selenium of a modified methionine counts as its sulphur, and the residue as methionine.
    """
    aa = F.when(F.col("aa") == "MSE", "MET").otherwise(F.col("aa"))
    name = F.when((F.col("aa") == "MSE") & (F.col("atom") == "SE"), "SD").otherwise(F.col("atom"))
    held = atoms.withColumns({"__atom": name, "aa": aa})
    place = F.array("x", "y", "z")
    return held.groupBy(*keys).agg(F.min("aa").alias("aa"), F.count(F.lit(1)).alias("n_atoms"), *[F.max(F.when(F.col("__atom") == n, place)).alias(n) for n in names])


def _xyz(column: Column) -> list[Column]:
    return [F.get(column, F.lit(i)) for i in range(3)]


def backbone_torsions(rows: DataFrame, chain: Sequence[str], residue: str) -> DataFrame:
    """rows (of residues()) with phi, psi and omega of each residue, omega being that of the bond to the one before."""
    w = Window.partitionBy(*chain).orderBy(residue)
    before = lambda c: _xyz(F.lag(c).over(w))
    n, ca, c = (_xyz(F.col(x)) for x in ("N", "CA", "C"))
    return rows.withColumns({"phi": dihedral(before("C"), n, ca, c), "psi": dihedral(n, ca, c, _xyz(F.lead("N").over(w))), "omega": dihedral(before("CA"), before("C"), n, ca)})


def frames(rows: DataFrame) -> DataFrame:
    """rows (of residues()) with ``frame``: nine numbers, the axes of the residue: along CA to C, N made orthogonal to it, and across."""
    n, ca, c = (_xyz(F.col(x)) for x in ("N", "CA", "C"))
    first = _unit(_minus(c, ca))
    arm = _minus(n, ca)
    along = _dot(first, arm)
    second = _unit([p - along * q for p, q in zip(arm, first)])
    return rows.withColumn("frame", F.array(*first, *second, *_cross(first, second)))


def amide_bonds(torsions: DataFrame, allowed: float = 40.0) -> DataFrame:
    """torsions with ``amide``: trans, cis or twisted, by how far omega is from 180 or 0 degrees; ``amide_ok`` is false for
    a twisted bond and for a cis bond before a residue that isn't a proline."""
    turn = F.abs(F.degrees("omega"))
    kind = F.when(turn >= 180 - allowed, "trans").when(turn <= allowed, "cis").when(turn.isNotNull(), "twisted")
    return torsions.withColumn("amide", kind).withColumn("amide_ok", (F.col("amide") == "trans") | ((F.col("amide") == "cis") & F.col("aa").isin("P", "PRO")))


# Length of the bond between C and N of the next residue and its deviation, in general and before proline.
C_N_BOND = {"other": (1.329, 0.014), "proline": (1.341, 0.016)}


def bond_violations(rows: DataFrame, chain: Sequence[str], residue: str, factor: float = 12.0) -> DataFrame:
    """Consecutive residues with the length of the bond between them, and whether it is off by more than ``factor`` deviations."""
    w = Window.partitionBy(*chain).orderBy(residue)
    gap = _minus(_xyz(F.col("N")), _xyz(F.lag("C").over(w)))
    length = rows.withColumn("bond", F.sqrt(_dot(gap, gap))).filter(F.col("bond").isNotNull())
    pro = F.col("aa").isin("P", "PRO")
    want, off = (F.when(pro, C_N_BOND["proline"][i]).otherwise(C_N_BOND["other"][i]) for i in (0, 1))
    return length.withColumn("violates", F.abs(F.col("bond") - want) > factor * off)


def clashes(atoms: DataFrame, structure: Sequence[str], chain: str, residue: str, radius: str, overlap: float = 1.5, widest: float = 4.0) -> DataFrame:
    """Pairs of atoms of different residues that are nearer than their radii less an overlap; a chain's neighbouring residues
    are no pairs. Atoms meet in cubes of the widest distance, so that no structure's pairs are formed."""
    cube = [F.floor(F.col(c) / widest).cast("long").alias(f"g{c}") for c in "xyz"]
    one = lambda n: atoms.select(*structure, F.col(chain).alias(f"c{n}"), F.col(residue).alias(f"r{n}"), F.col("atom").alias(f"atom{n}"), F.col(radius).alias(f"radius{n}"), *[F.col(c).alias(f"{c}{n}") for c in "xyz"], *cube)
    other = one(2)
    for c in "xyz":
        other = other.withColumn("__o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(f"g{c}", F.col(f"g{c}") + F.col("__o")).drop("__o")
    met = one(1).join(other, [*structure, "gx", "gy", "gz"]).filter("struct(c1, r1) < struct(c2, r2) and not (c1 = c2 and r2 - r1 <= 1)")
    met = met.withColumn("d", distance(["x1", "y1", "z1"], ["x2", "y2", "z2"])).filter(F.col("d") < F.col("radius1") + F.col("radius2") - overlap)
    return met.select(*structure, "c1", "r1", "atom1", "c2", "r2", "atom2", "d")


def rmsd_matrix(points: DataFrame, model: str, residue: str) -> DataFrame:
    """(a, b, rmsd), a < b, of all pairs of models, after the best superposition of their common residues."""
    one, two = ((points.select(F.col(model).alias(m), residue, *[F.col(c).alias(f"{c}{i}") for c in "xyz"])) for m, i in (("a", 1), ("b", 2)))
    return superpose(one.join(two, residue).filter("a < b"), ["a", "b"]).select("a", "b", F.col("aligned_rmsd").alias("rmsd"))


def near_models(matrix: DataFrame, below: float = 4.0) -> DataFrame:
    """(model, mean_rmsd) of models whose mean RMSD to the others is below a limit."""
    both = matrix.select(F.col("a").alias("model"), "rmsd").unionByName(matrix.select(F.col("b").alias("model"), "rmsd"))
    return both.groupBy("model").agg(F.avg("rmsd").alias("mean_rmsd")).filter(F.col("mean_rmsd") < below)
