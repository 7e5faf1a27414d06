"""Distances between vectors, representatives, cluster pairing, and density clustering of bounded sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import materialize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def blocked_pairs(df: DataFrame, key: str, vector: str, most: float, block_rows: int = 10_000) -> DataFrame:
    """(a, b, distance), a < b, of all pairs with cosine distance <= most, in blocks of rows.

    Rows are dealt into blocks of about block_rows by a hash of the key; each pair of blocks is one task with one matrix
    product, so a task holds two blocks whatever the size of the table, and only pairs within the limit leave it.
    """
    blocks = max(1, -(-df.count() // block_rows))
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    left = rows.withColumn("o", F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))))
    right = rows.select(F.col("k").alias("k2"), F.col("v").alias("v2"), F.col("b").alias("o2")).withColumn("b2", F.explode(F.sequence(F.lit(0), F.col("o2"))))

    def unit(v: pd.Series) -> np.ndarray:
        x = np.array(v.tolist(), float)
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "distance": []})
        distance = np.maximum(0, 1 - unit(a["v"]) @ unit(b["v2"]).T)
        i, j = np.nonzero(distance <= most)
        x, y = a["k"].to_numpy()[i], b["k2"].to_numpy()[j]
        once = (x < y) if a["b"].iloc[0] == b["o2"].iloc[0] else (x != y)
        return pd.DataFrame({"a": np.minimum(x, y)[once], "b": np.maximum(x, y)[once], "distance": distance[i, j][once]})

    return left.groupBy("b", "o").cogroup(right.groupBy("b2", "o2")).applyInPandas(product, "a long, b long, distance double")


def representatives(df: DataFrame, cluster: str, key: str, vector: str, most: int = 128) -> DataFrame:
    """Per cluster its centre (smallest mean distance, then smallest key) and the rows nearest to it.

    The mean cosine distance of a row to its cluster is one minus the dot product with the mean of the unit vectors, so
    no pair is formed: the mean is an aggregate over (cluster, dimension).
    """
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    unit = df.select(cluster, key, F.transform(vector, lambda x: x.cast("double") / norm).alias("u"))
    mean = unit.select(cluster, F.posexplode("u").alias("d", "x")).groupBy(cluster, "d").agg(F.avg("x").alias("x"))
    mean = mean.groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("mean"))  # one entry per dimension
    far = unit.join(mean, cluster).withColumn("mean_distance", 1 - dot(F.col("u"), F.col("mean")))
    centre = far.groupBy(cluster).agg(F.min(F.struct(F.round("mean_distance", 9).alias("m"), F.col(key).alias("centre"), F.col("u").alias("cu"))).alias("c")).select(cluster, "c.centre", "c.cu")
    near = far.join(centre, cluster).withColumn("distance", F.greatest(F.lit(0.0), 1 - dot(F.col("u"), F.col("cu"))))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(F.col(key) == F.col("centre")), F.round("distance", 9), key))
    return near.withColumn("rank", rank).filter(F.col("rank") <= most).select(cluster, key, "centre", "distance", "rank")


def nearest_centre(rows: DataFrame, centres: DataFrame, key: str, vector: str, block_rows: int = 100_000) -> DataFrame:
    """(key, centre, agreement): the centre of largest dot product (to nine digits), the smallest id among equals.

    Centres are shipped in blocks of at most about block_rows, each a matrix; rows are multiplied with it batch by batch and
    only the best of a block leaves the task, so that more centres mean more blocks over the same rows.
    """
    c = centres.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-c.count() // block_rows))
    out = None
    for block in range(blocks):
        part = c.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block).orderBy("k").toPandas()  # a block
        if not len(part):
            continue
        shipped = rows.sparkSession.sparkContext.broadcast((part["k"].to_numpy(), np.array(part["v"].tolist(), float)))

        def nearest(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            ids, matrix = shipped.value
            for batch in batches:
                for lot in np.array_split(np.arange(len(batch)), -(-len(batch) * len(ids) // 20_000_000) or 1):
                    agree = np.round(np.array(batch["v"].iloc[lot].tolist(), float).reshape(len(lot), -1) @ matrix.T, 9)
                    best = agree.argmax(1)  # ids are sorted, so the first of equals is the smallest
                    yield pd.DataFrame({"k": batch["k"].iloc[lot].to_numpy(), "agreement": agree[np.arange(len(lot)), best], "centre": ids[best]})

        one = rows.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(nearest, "k long, agreement double, centre long")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return rows.select(F.col(key), F.lit(None).cast("long").alias("centre"), F.lit(None).cast("double").alias("agreement")).limit(0)
    if blocks > 1:
        out = out.groupBy("k").agg(F.max(F.struct("agreement", (-F.col("centre")).alias("n"))).alias("m")).select("k", F.col("m.agreement").alias("agreement"), (-F.col("m.n")).alias("centre"))
    return out.select(F.col("k").alias(key), "centre", "agreement")


def joint_clusters(labels: DataFrame, target: str, least_pairs: int = 3, more_rows: int = 15) -> DataFrame:
    """Label tuples of paired rows that have enough support: target, labels, n_paired, n_rows.

    labels: target, chain_idx, row, label, paired. A tuple with -1 is dropped; it needs at least least_pairs paired rows
    and more than more_rows rows with the single rows of its labels. Nothing qualifying gives no rows.
    """
    paired = labels.filter("paired").groupBy(target, "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("chain_idx", "label"))), lambda x: x["label"]).alias("labels"))
    tuples = paired.filter(~F.array_contains("labels", -1)).groupBy(target, "labels").agg(F.count(F.lit(1)).alias("n_paired"))
    single = labels.filter("not paired").groupBy(target, "chain_idx", "label").agg(F.count(F.lit(1)).alias("n"))
    each = tuples.select(target, "labels", F.posexplode("labels").alias("chain_idx", "label")).join(single, [target, "chain_idx", "label"], "left")
    total = each.groupBy(target, "labels").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_single"))
    out = tuples.join(total, [target, "labels"]).withColumn("n_rows", F.col("n_paired") + F.col("n_single"))
    return out.filter((F.col("n_paired") >= least_pairs) & (F.col("n_rows") > more_rows)).select(target, "labels", "n_paired", "n_rows")


def density_labels(distance: np.ndarray, least: int) -> np.ndarray:
    """HDBSCAN labels of a distance matrix with min_cluster_size = min_samples = least; noise is -1."""
    n = len(distance)
    if n < max(2, least):
        return np.full(n, -1)
    core = np.sort(distance, axis=1)[:, min(least, n) - 1]
    reach = np.maximum(distance, np.maximum(core[:, None], core[None, :]))
    # minimum spanning tree (Prim)
    inside, best, source = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        closer = (reach[at] < best) & ~inside
        best[closer], source[closer] = reach[at][closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((float(best[at]), int(source[at]), at))
    edges.sort()
    # single-linkage tree: node n + k joins two nodes at edge k
    top, left, right, size, height = list(range(n)), {}, {}, {i: 1 for i in range(n)}, {}
    find = list(range(2 * n - 1))

    def root(x: int) -> int:
        while find[x] != x:
            find[x] = find[find[x]]
            x = find[x]
        return x

    for k, (d, a, b) in enumerate(edges):
        x, y, new = root(a), root(b), n + k
        find[x] = find[y] = new
        left[new], right[new], size[new], height[new] = x, y, size[x] + size[y], d
    del top

    def leaves(x: int) -> list[int]:
        out, stack = [], [x]
        while stack:
            y = stack.pop()
            if y < n:
                out.append(y)
            else:
                stack += [left[y], right[y]]
        return out

    # condensed tree: clusters are split only into two children that are large enough
    births, parents, stability, split = {0: 0.0}, {}, {0: 0.0}, {0: None}
    members: dict[int, int] = {0: 2 * n - 2}
    todo, fresh = [(0, 2 * n - 2)], 1
    density = lambda d: 1 / max(d, 1e-12)
    while todo:
        c, node = todo.pop()
        while True:
            if node < n:
                break
            lam, x, y = density(height[node]), left[node], right[node]
            big = [z for z in (x, y) if size[z] >= least]
            if len(big) == 2:
                stability[c] += (lam - births[c]) * size[node]
                split[c] = (fresh, fresh + 1)
                for z in big:
                    births[fresh], parents[fresh], stability[fresh], split[fresh], members[fresh] = lam, c, 0.0, None, z
                    todo.append((fresh, z))
                    fresh += 1
                break
            stability[c] += (lam - births[c]) * (size[node] if not big else size[node] - size[big[0]])
            if not big:
                break
            node = big[0]
    chosen, total = {}, dict(stability)
    for c in sorted(stability, reverse=True):
        if split[c] is None:
            chosen[c] = True
            continue
        below = sum(total[k] for k in split[c])
        chosen[c] = c != 0 and stability[c] >= below
        total[c] = max(stability[c], below) if c != 0 else below
    labels, name, stack = np.full(n, -1), 0, [0]
    while stack:
        c = stack.pop()
        if chosen[c] and c != 0:
            labels[leaves(members[c])] = name
            name += 1
        elif split[c]:
            stack += list(split[c])[::-1]
    return labels


def density_clusters(df: DataFrame, group: Sequence[str], key: str, vector: str, least: int = 5, max_rows: int = 20_000) -> DataFrame:
    """(group, key, label) by HDBSCAN on cosine distances; labels are shifted by one, so noise is cluster 0.

    A group is a set of sampled rows and must have at most max_rows rows (an error otherwise): the matrix is dense.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_rows:
            raise ValueError(f"a group has more than {max_rows} rows")
        pdf = pdf.sort_values(key)
        x = np.array(pdf[vector].tolist(), float)
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
        return pdf[[*group, key]].assign(label=density_labels(np.maximum(0, 1 - x @ x.T), least) + 1)

    schema = ", ".join([*(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group), f"`{key}` {df.schema[key].dataType.simpleString()}", "label int"])
    return df.select(*group, key, vector).groupBy(*group).applyInPandas(one, schema)


def kmeans_labels(df: DataFrame, key: str, vector: str, k: int, seed: int = 0) -> DataFrame:
    """(key, label) of k-means on the rows' cosine distances to all rows (distance-matrix rows as features).

    With unit vectors U the difference of two rows of the matrix is U (u - v), so its length is that of R (u - v) for any R
    with R'R = U'U: the features are R u, as many numbers as a vector has, and no matrix of rows times rows is made.
    U'U is a sum over rows; it is the only thing that goes to the driver.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = df.filter(F.col(vector).isNotNull()).select(key, F.transform(vector, lambda x: x.cast("double") / F.sqrt(dot(F.col(vector), F.col(vector)))).alias("u"))
    unit = materialize(unit, "unit")

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            u = np.array(batch["u"].tolist(), float)
            held = u.T @ u if held is None else held + u.T @ u
        if held is not None:
            yield pd.DataFrame({"m": [held.ravel()]})

    parts = unit.select("u").mapInPandas(products, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()  # the vector's length squared
    if not parts:
        return unit.select(key, F.lit(0).alias("label"))
    power, turn = np.linalg.eigh(np.array([r["x"] for r in parts]).reshape(int(len(parts) ** 0.5), -1))
    root = (turn * np.sqrt(np.maximum(power, 0))).T

    def turned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.array(batch.tolist(), float).reshape(len(batch), -1) @ root.T))

    features = unit.select(key, array_to_vector(F.pandas_udf(turned, "array<double>")("u")).alias("features"))
    features = materialize(features, "features")
    return KMeans(k=k, seed=seed).fit(features).transform(features).select(key, F.col("prediction").alias("label"))


def external(df: DataFrame, scorer, schema: str) -> DataFrame:
    """Boundary for external tools and trained scorers: an Arrow-batched function of pandas frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)

    return df.mapInPandas(run, schema)
