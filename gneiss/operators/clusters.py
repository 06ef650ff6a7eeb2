"""Clusters of entities and how well two clusterings agree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.resampling import poisson_times
from gneiss.operators.similarity import _unit
from gneiss.session import cut

#: Entities that the driver-side linkage of a similarity matrix takes; ``average_linkage_of`` needs no matrix.
MOST_LINKED = 5_000


def average_linkage(similarity: np.ndarray, n_clusters: int) -> np.ndarray:
    """Labels 0.. of average-linkage clusters of a small square similarity matrix; ties merge the least indices."""
    n = len(similarity)
    if n > MOST_LINKED:
        raise ValueError(f"{n} entities; the driver links up to {MOST_LINKED}")
    far = 1.0 - similarity.astype(float)
    np.fill_diagonal(far, np.inf)
    size, owner = np.ones(n), np.arange(n)
    alive = np.ones(n, dtype=bool)
    for _ in range(max(0, n - n_clusters)):
        a, b = np.unravel_index(np.argmin(far), far.shape)
        a, b = min(a, b), max(a, b)
        merged = (size[a] * far[a] + size[b] * far[b]) / (size[a] + size[b])
        far[a], far[:, a] = merged, merged
        far[a, a] = np.inf
        far[b], far[:, b] = np.inf, np.inf
        size[a] += size[b]
        alive[b] = False
        owner[owner == b] = a
    return np.unique(owner, return_inverse=True)[1]


def average_linkage_of(units: np.ndarray, n_clusters: int) -> np.ndarray:
    """Labels 0.. of average-linkage clusters of unit vectors at distance 1 - cosine.

    The mean similarity of two clusters is the product of their mean vectors, so there is one vector per
    cluster and no matrix of pairs; a nearest-neighbour chain finds the merges in about 3 n products of
    n x dimensions. The tree is that of the greedy order; equal similarities may merge in another order.
    """
    n = len(units)
    mean, size, height, alive = units.astype(float), np.ones(n), np.zeros(n), np.ones(n, dtype=bool)
    chain: list[int] = []
    merges: list[tuple[float, int, int]] = []
    first = 0
    while len(merges) < n - 1:
        if not chain:
            while not alive[first]:
                first += 1
            chain.append(first)
        a = chain[-1]
        sim = mean @ mean[a]
        sim[~alive] = -np.inf
        sim[a] = -np.inf
        b = int(np.argmax(sim))
        # nearly equal is equal: the chain turns back, so that rounding cannot lead it in a circle
        if len(chain) < 2 or sim[chain[-2]] < sim[b] - 1e-12:
            chain.append(b)
            continue
        b = chain[-2]
        del chain[-2:]
        low, high = min(a, b), max(a, b)
        height[low] = max(1.0 - sim[b], height[a], height[b])
        merges.append((float(height[low]), low, high))
        mean[low] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
        size[low] = size[a] + size[b]
        alive[high] = False
    owner = np.arange(n)

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = i = owner[owner[i]]
        return i

    # lowest merges first; the sort is stable, so a merge comes after those it builds on
    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(0, n - n_clusters)]:
        a, b = root(a), root(b)
        owner[max(a, b)] = min(a, b)
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


def link_entities(df: DataFrame, entity: str, vector: str, n_clusters: int) -> DataFrame:
    """(entity, cluster) of average linkage of the entities themselves by cosine, linked by the driver from their vectors.

    NULL vectors, NULL ids and vectors of another length than the least entity's take no part.
    """
    kind = df.schema[entity].dataType.simpleString()
    rows = df.select(F.col(entity).alias("e"), F.col(vector).cast("array<double>").alias("v")).where(F.col(entity).isNotNull() & F.col(vector).isNotNull())
    got = rows.toArrow().sort_by("e").combine_chunks()
    if got.num_rows:
        lengths = got["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        got = got.filter(pa.array(lengths == lengths[0])).combine_chunks()
    if not got.num_rows:
        return df.sparkSession.createDataFrame([], f"{entity} {kind}, cluster int")
    flat = got["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, -1)
    labels = average_linkage_of(_unit(flat, False), n_clusters)
    return df.sparkSession.createDataFrame(list(zip(got["e"].to_pylist(), labels.tolist(), strict=True)), f"{entity} {kind}, cluster int")


def propagate_labels(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(entity, community) by synchronous label propagation on a weighted undirected graph.

    A declared stand-in for modularity optimisation: each round an entity takes the label of greatest
    summed weight among its neighbours and itself (its own label weighs as its strongest edge, so that
    pairs do not swap for ever), ties to the least label. Every round is cut, so
    neither lineage nor a lost executor repeats earlier ones; it stops when nothing changes.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), "w"))
    graph = cut(both.groupBy("x", "y").agg(F.max("w").alias("w")))
    strongest = graph.groupBy("x").agg(F.max("w").alias("w"))
    labels = graph.select("x").distinct().select(F.col("x").alias("entity"), F.col("x").alias("community"))
    for _ in range(rounds):
        votes = graph.join(labels, graph["y"] == labels["entity"]).groupBy("x", "community").agg(F.sum("w").alias("w"))
        own = labels.withColumnRenamed("entity", "x").join(strongest, "x").select("x", "community", "w")
        votes = votes.unionByName(own).groupBy("x", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("x").agg(F.min_by("community", F.struct(-F.round("w", 9), F.col("community"))).alias("community"))
        new = cut(best.select(F.col("x").alias("entity"), "community"))
        changed = new.join(labels.withColumnRenamed("community", "__old"), "entity").where(F.col("community") != F.col("__old")).limit(1).count()
        labels = new
        if not changed:
            break
    return labels


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information (arithmetic mean) of two labelings.

    All from the contingency table, whose size is that of the label pairs.
    """
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows, columns = cells.groupBy(a).agg(F.sum("n").alias("n")), cells.groupBy(b).agg(F.sum("n").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    entropy = lambda: -F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("t")))
    total = F.broadcast(cells.agg(F.sum("n").cast("double").alias("t")))  # one row
    c = cells.agg(pairs("n").alias("cc"))
    r = rows.join(total).agg(pairs("n").alias("rr"), entropy().alias("hr"))
    k = columns.join(total).agg(pairs("n").alias("kk"), entropy().alias("hk"), F.max("t").alias("t"))
    joint = cells.join(total).agg(entropy().alias("hj"))
    one = c.join(F.broadcast(r)).join(F.broadcast(k)).join(F.broadcast(joint))  # one row each
    expected = F.col("rr") * F.col("kk") / (F.col("t") * (F.col("t") - 1) / 2)
    most = (F.col("rr") + F.col("kk")) / 2
    mutual, mean = F.col("hr") + F.col("hk") - F.col("hj"), (F.col("hr") + F.col("hk")) / 2
    return one.select(
        F.when(most != expected, (F.col("cc") - expected) / (most - expected)).otherwise(1.0).alias("ari"),
        F.when(mean > 0, mutual / mean).otherwise(1.0).alias("nmi"),
    )


def kmeans(df: DataFrame, entity: str, vector: str, k: int, components: int, seed: int = 1) -> DataFrame:
    """(entity, cluster) of k-means on the first principal components of standardised vectors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = df.select(entity, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    steps = [
        StandardScaler(inputCol="__v", outputCol="__s", withMean=True), PCA(k=components, inputCol="__s", outputCol="__p"),
        KMeans(k=k, seed=seed, featuresCol="__p", predictionCol="cluster"),
    ]
    return Pipeline(stages=steps).fit(rows).transform(rows).select(entity, "cluster")


def agreement_by(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, ari): adjusted Rand index of two labellings in every group, from the contingency tables."""
    cells = df.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    joint = cells.groupBy(*by).agg(pairs("n").alias("cc"), F.sum("n").cast("double").alias("t"))
    rows = cells.groupBy(*by, a).agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs("n").alias("rr"))
    columns = cells.groupBy(*by, b).agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs("n").alias("kk"))
    one = joint.join(rows, by).join(columns, by)
    expected = F.col("rr") * F.col("kk") / (F.col("t") * (F.col("t") - 1) / 2)
    most = (F.col("rr") + F.col("kk")) / 2
    return one.select(*by, F.when(most != expected, (F.col("cc") - expected) / (most - expected)).otherwise(1.0).alias("ari"))


def reproduction(df: DataFrame, entity: str, vector: str, n_clusters: int, draws: int, share: float, seed: int = 42) -> DataFrame:
    """(cluster, n_members, n_testable, reproduced): for every average-linkage cluster the share of replicates in which at least
    ``share`` of its drawn members lie in one cluster of the replicate.

    A replicate holds the entities that drawing as many as there are, with replacement, leaves (each by its own digest). The
    linkage itself runs on the driver, as ``link_entities`` does, one replicate after another.
    """
    whole = cut(link_entities(df, entity, vector, n_clusters))
    named = whole.select(entity, F.col("cluster").alias("__own"))
    found = None
    for b in range(draws):
        drawn = df.where(poisson_times(seed, F.lit(b), entity) > 0)
        again = cut(link_entities(drawn, entity, vector, n_clusters))
        cells = again.join(named, entity).groupBy("__own", "cluster").agg(F.count("*").alias("n"))
        part = cells.groupBy("__own").agg(F.max("n").alias("top"), F.sum("n").alias("seen"))
        found = part if found is None else found.unionByName(part)
    sizes = named.groupBy("__own").agg(F.count("*").alias("n_members"))
    rate = found.groupBy("__own").agg(F.count("*").alias("n_testable"), F.avg((F.col("top") >= share * F.col("seen")).cast("double")).alias("reproduced"))
    return sizes.join(rate, "__own", "left").select(F.col("__own").alias("cluster"), "n_members", F.coalesce("n_testable", F.lit(0)).alias("n_testable"), "reproduced")


def component_plane(df: DataFrame, entity: str, vector: str) -> DataFrame:
    """(entity, x, y): the first two principal components of the vectors, each with the sign that makes its greatest loading positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.where(F.col(vector).isNotNull()).select(entity, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    model = PCA(k=2, inputCol="__v", outputCol="__p").fit(rows)
    loadings = model.pc.toArray()
    turn = [1.0 if loadings[np.abs(loadings[:, k]).argmax(), k] > 0 else -1.0 for k in range(2)]
    p = vector_to_array("__p")
    return model.transform(rows).select(entity, (p[0] * turn[0]).alias("x"), (p[1] * turn[1]).alias("y"))
