"""Entity similarity: feature preparation, nearest neighbours, and what neighbourhoods say.

Neighbours are searched for a stated query set: blocks of query vectors (bounded) are broadcast, every task
keeps its own best k per query while it reads its rows, and the tasks' survivors are ranked together. No
pair of rows is ever materialised beyond a task's best. What describes all similarities (agreement of axes,
resolution, separation) takes every (query, row) pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.stats import correlation
from gneiss.operators.aggregates import counted_quantiles, exact_quantiles
from gneiss.operators.ranks import auroc_of_all, average_rank
from gneiss.operators.resampling import digest
from gneiss.session import written

#: Query vectors of one broadcast block.
QUERY_BLOCK = 2048
#: The same of a search for neighbours, which compares tiles of so many queries and rows at a time.
NEAREST_BLOCK, TILE = 16_384, 1024
#: Pairs of one piece that a task compares at a time.
PAIR_BLOCK = 1_000_000


def prepare(long: DataFrame, entity: str, feature: str, value: str, most_missing: float = 0.20) -> DataFrame:
    """(entity, feature, z): dense features with some spread, missing cells at the feature's median, standardised.

    z uses the population SD over all entities; imputed cells count.
    """
    each = long.groupBy(entity, feature).agg(F.avg(value).alias("__v"), F.collect_list(value).alias("__x"))
    several = F.when(F.size("__x") > 1, F.col("__x")).alias("__x")  # the values of a cell that has more than its mean
    held = written(each.groupBy(entity).agg(F.collect_list(F.struct(feature, "__v", several)).alias("__cells")))
    cells = held.select(entity, F.explode("__cells").alias("__cell")).select(entity, "__cell.*").where(F.col("__v").isNotNull() & F.col(feature).isNotNull())
    values = cells.select(feature, F.explode(F.coalesce("__x", F.array("__v"))).alias("__x"))
    lines = held.agg(F.count("*").alias("__n"), F.count(entity).alias("__k"))  # one row
    seen = cells.groupBy(feature).agg(F.count("*").alias("__c"), F.count(entity).alias("__e"), F.avg("__v").alias("__a"), F.var_pop("__v").alias("__w"))
    sd = values.groupBy(feature).agg(F.stddev_samp("__x").alias("__sd")).where(F.col("__sd") > 0)
    dense = seen.join(F.broadcast(lines)).where(1 - F.col("__e") / F.col("__k") <= most_missing)
    dense = written(dense.join(sd, feature))
    counts = values.join(dense.select(feature), feature, "left_semi").groupBy(feature, "__x").agg(F.count("*").alias("__times"))
    middle = counted_quantiles(counts, [feature], "__x", {"__med": ("__times", 0.5)})
    # Mean and SD over all entities, the missing ones at the median, from the figures of the measured ones.
    n, c, med = F.col("__n"), F.col("__c"), F.col("__med")
    mean = (c * F.col("__a") + (n - c) * med) / n
    variance = (c * (F.col("__w") + (F.col("__a") - F.col("__m")) ** 2) + (n - c) * (med - F.col("__m")) ** 2) / n
    stats = written(middle.join(dense, feature).withColumn("__m", mean).select(feature, "__med", "__m", F.sqrt(variance).alias("__s")))
    z = lambda x: F.when(F.col("__s") > 0, (x - F.col("__m")) / F.col("__s")).otherwise(0.0).alias("z")
    measured = cells.join(stats, feature).select(entity, feature, z(F.col("__v")))
    # An entity's missing features are named by set difference, so only the holes of the grid are made.
    every = stats.agg(F.collect_list(feature).alias("__all"))  # one row
    own = F.transform(F.filter("__cells", lambda x: x["__v"].isNotNull()), lambda x: x[feature])
    holes = held.join(F.broadcast(every)).select(entity, F.explode(F.array_except("__all", own)).alias(feature))
    return measured.unionByName(holes.join(stats, feature).select(entity, feature, z(F.col("__med"))))


def ranked_rows(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Values replaced by their average rank within the entity: Pearson on these is Spearman."""
    return df.withColumn(value, average_rank([entity], value))


def vectors(df: DataFrame, entity: str, feature: str, value: str) -> DataFrame:
    """(entity, vector) with the features in alphabetical order; every entity must have them all."""
    return df.groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(F.struct(feature, value))), lambda s: s[value]).alias("vector"))


def _unit(rows: np.ndarray, centre: bool) -> np.ndarray:
    rows = rows.astype(np.float64)
    if centre:
        rows = rows - rows.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _best(batches: Iterator[pa.RecordBatch], shared, k: int, centre: bool) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """The task's k best rows of every query, by similarity at 12 digits and then by the least id.

    Tiles of queries and rows are compared in single precision; the pairs that reach a query's k-th best so far within
    the error of that are compared again in double precision. A task holds one tile and k rows a query.
    """
    ids, (units,), kind, _ = shared.value
    units = np.where(np.isfinite(units).all(axis=1, keepdims=True), units, np.nan)
    coarse, error = units.astype(np.float32), (units.shape[1] + 8) * 2.0**-23
    own: dict[object, list[int]] = {}
    for i, name in enumerate(ids):
        own.setdefault(name, []).append(i)
    cut = np.where(np.isnan(units[:, :1]).any(axis=1), np.inf, -np.inf)  # what a pair's coarse similarity must reach
    held: dict[int, tuple[np.ndarray, ...]] = {}

    def keep(at: int, found: list[tuple[np.ndarray, ...]]) -> None:
        q, name, sim = (np.concatenate(x) for x in zip(*([held[at]] if at in held else []), *found, strict=True))
        key = np.round(sim, 12)
        order = np.lexsort((name, -key, q))
        first = np.searchsorted(q[order], q[order])
        order = order[np.arange(len(order)) - first < k]
        held[at] = q[order], name[order], sim[order]
        full = np.flatnonzero(q[order][k - 1 :] == q[order][: max(0, len(order) - k + 1)]) + k - 1
        cut[q[order][full]] = np.maximum(cut[q[order][full]], key[order][full] - error - 1e-12)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), centre)
        usable = np.flatnonzero(np.isfinite(rows).all(axis=1))
        rows, names = rows[usable], batch.column(0).to_numpy(zero_copy_only=False)[usable]
        thin = rows.astype(np.float32)
        same = np.array([(q, r) for r, name in enumerate(names.tolist()) for q in own.get(name, ())], dtype=int).reshape(-1, 2)
        for at in range(0, len(ids), TILE):
            found, most = [], 0
            for low in range(0, len(rows), TILE):
                sim = coarse[at : at + TILE] @ thin[low : low + TILE].T
                itself = same[(same[:, 0] >= at) & (same[:, 0] < at + TILE) & (same[:, 1] >= low) & (same[:, 1] < low + TILE)]
                sim[itself[:, 0] - at, itself[:, 1] - low] = -np.inf
                limit = cut[at : at + TILE]
                new = np.flatnonzero(np.isneginf(limit))
                if len(new) and sim.shape[1] >= k:
                    limit[new] = -np.partition(-sim[new], k - 1, axis=1)[:, k - 1] - 2 * error
                hit = np.flatnonzero(sim.max(axis=1) >= limit)
                q, r = np.nonzero((sim[hit] >= limit[hit, None]) & ~np.isneginf(sim[hit]))
                q, r = at + hit[q], low + r
                step = max(1, PAIR_BLOCK // units.shape[1])
                for i in range(0, len(q), step):
                    a, b = q[i : i + step], r[i : i + step]
                    found.append((a, names[b], np.einsum("ij,ij->i", units[a], rows[b])))
                most += len(q)
                if most > PAIR_BLOCK // 8:
                    keep(at, found)
                    found, most = [], 0
            if found:
                keep(at, found)
    for q, name, sim in held.values():
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(ids[q]), kind), pa.array(name.tolist(), kind), pa.array(sim), pa.array(np.round(sim, 12))], ["query", "neighbour", "similarity", "near"]
        )


def _blocks(base: DataFrame, queries: DataFrame, entity: str, vectors: Sequence[str], centre: bool, extra: Sequence[str] = (), most: int | None = None) -> Iterator[tuple[object, DataFrame]]:
    """For each block of queries what is broadcast of it, (ids, unit vectors of each of ``vectors``, id type, extras), and the rows of ``base`` to compare.

    Vectors of another length than the first query's, NULL vectors and NULL ids take no part.
    """
    spark, kind = base.sparkSession, base.schema[entity].dataType
    asked = queries.select(entity, *vectors, *extra).where(F.col(entity).isNotNull())
    for v in vectors:
        asked = asked.where(F.col(v).isNotNull())
    asked = asked.distinct()
    blocks = max(1, -(-asked.count() // (most or QUERY_BLOCK)))
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(entity), F.lit(blocks)) == b)
        rows = sorted(part.collect(), key=lambda r: r[0])
        if not rows:
            continue
        sizes = [len(rows[0][v]) for v in vectors]
        rows = [r for r in rows if [len(r[v]) for v in vectors] == sizes]
        ids = np.array([r[0] for r in rows], dtype=object)
        units = [_unit(np.array([r[v] for r in rows], dtype=float), centre) for v in vectors]
        arrow = pa.string() if kind.typeName() == "string" else pa.int64() if kind.typeName() in ("long", "bigint") else pa.int32()
        shared = spark.sparkContext.broadcast((ids, units, arrow, [[r[x] for r in rows] for x in extra]))
        usable = base.select(entity, *[F.col(v).cast("array<double>").alias(f"v{i}") for i, v in enumerate(vectors)], *extra).where(F.col(entity).isNotNull())
        for i, size in enumerate(sizes):
            usable = usable.where(F.size(f"v{i}") == size)
        yield shared, usable


def nearest(base: DataFrame, queries: DataFrame, entity: str, vector: str, k: int = 25, centre: bool = False) -> DataFrame:
    """(query, neighbour, rank, similarity): the k nearest rows of ``base`` by cosine (centred: Pearson).

    ``queries`` is the stated query set, taken in blocks; a row is no neighbour of itself. Vectors of
    another length than the first query's, NULL vectors and NULL ids take no part; a zero vector has
    similarity 0 with all. Ties go to the least neighbour.
    """
    name = base.schema[entity].dataType.simpleString()
    found = None
    for shared, usable in _blocks(base, queries, entity, [vector], centre, most=NEAREST_BLOCK):
        got = usable.mapInArrow(partial(_best, shared=shared, k=k, centre=centre), f"query {name}, neighbour {name}, similarity double, near double")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return base.sparkSession.createDataFrame([], f"query {name}, neighbour {name}, rank int, similarity double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), F.asc("neighbour")))
    return found.select("query", "neighbour", place.alias("rank"), "similarity").where(F.col("rank") <= k)


def _compared(batches: Iterator[pa.RecordBatch], ids: np.ndarray, units: list[np.ndarray], centre: bool) -> Iterator[tuple[list[np.ndarray], np.ndarray, pa.RecordBatch]]:
    """Pieces of the rows: similarities with every query on every axis, which of them are pairs, and the piece.

    A row is no pair with itself, nor is one whose similarity is undefined on an axis.
    """
    step = max(1, PAIR_BLOCK // len(ids))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            names = np.array(piece.column(0).to_pylist(), dtype=object)
            sims = [u @ _unit(piece.column(1 + i).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1), centre).T for i, u in enumerate(units)]
            there = ids[:, None] != names[None, :]
            for sim in sims:
                there &= np.isfinite(sim)
            yield sims, there, piece


def _co_moments(batches: Iterator[pa.RecordBatch], shared, centre: bool) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    ids, units, _, _ = shared.value
    n, sums = 0, np.zeros(5)
    for (a, b), there, _ in _compared(batches, ids, units, centre):
        x, y = a[there], b[there]
        n += len(x)
        sums += [x.sum(), y.sum(), x @ x, y @ y, x @ y]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (n, *sums.tolist())], ["n", "x", "y", "xx", "yy", "xy"])


def _pairs(batches: Iterator[pa.RecordBatch], shared, centre: bool) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    ids, units, kind, _ = shared.value
    for (sim,), there, _ in _compared(batches, ids, units, centre):
        rows = np.nonzero(there)[0]
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(list(ids[rows]), kind), pa.array(sim[there])], ["query", "similarity"])


def _labelled(batches: Iterator[pa.RecordBatch], shared, centre: bool) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    ids, units, _, (labels,) = shared.value
    own = np.array(labels, dtype=object)
    for (sim,), there, piece in _compared(batches, ids, units, centre):
        other = np.array(piece.column(2).to_pylist(), dtype=object)
        if there.any():
            yield pa.RecordBatch.from_arrays([pa.array(sim[there]), pa.array((own[:, None] == other[None, :])[there].astype(bool))], ["similarity", "same"])


def all_pairs(base: DataFrame, queries: DataFrame, entity: str, vector: str, centre: bool = False) -> DataFrame:
    """(query, similarity) of every pair of a query and another row of ``base``: queries x rows of them, never held by a task."""
    fields = f"query {base.schema[entity].dataType.simpleString()}, similarity double"
    found = base.sparkSession.createDataFrame([], fields)
    for shared, usable in _blocks(base, queries, entity, [vector], centre):
        found = found.unionByName(usable.mapInArrow(partial(_pairs, shared=shared, centre=centre), fields))
    return found


def _paired(batches: Iterator[pa.RecordBatch], shared, centre: bool) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    ids, units, kind, (labels,) = shared.value
    own = np.array(labels, dtype=object)
    for (a, b), there, piece in _compared(batches, ids, units, centre):
        rows, columns = np.nonzero(there)
        if len(rows):
            other = np.array(piece.column(3).to_pylist(), dtype=object)
            same = (own[:, None] == other[None, :])[there].astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(ids[rows]), kind), piece.column(0).take(pa.array(columns)), pa.array(a[there]), pa.array(b[there]), pa.array(same)],
                ["query", "neighbour", "first", "second", "same"],
            )


def pairs_on_axes(base: DataFrame, queries: DataFrame, entity: str, first: str, second: str, label: str, centre: bool = False) -> DataFrame:
    """(query, neighbour, first, second, same): every pair of a query and another row of ``base`` with its similarity on two
    axes and whether both have the same label. Rows without a label make no pair."""
    kind = base.schema[entity].dataType.simpleString()
    fields = f"query {kind}, neighbour {kind}, first double, second double, same boolean"
    found = base.sparkSession.createDataFrame([], fields)
    known = F.col(label).isNotNull()
    for shared, usable in _blocks(base.where(known), queries.where(known), entity, [first, second], centre, [label]):
        found = found.unionByName(usable.mapInArrow(partial(_paired, shared=shared, centre=centre), fields))
    return found


def axis_correlation(base: DataFrame, queries: DataFrame, entity: str, first: str, second: str, centre: bool = False) -> DataFrame:
    """(n, r): correlation of the similarities on two axes over every (query, base row) pair that both measure.

    A task yields only its sums, so no pair is shuffled. r is NULL where an axis does not vary.
    """
    fields = "n bigint, x double, y double, xx double, yy double, xy double"
    found = base.sparkSession.createDataFrame([], fields)
    for shared, usable in _blocks(base, queries, entity, [first, second], centre):
        found = found.unionByName(usable.mapInArrow(partial(_co_moments, shared=shared, centre=centre), fields))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.sum(c).alias(c) for c in ("x", "y", "xx", "yy", "xy")])
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    vx, vy = F.col("xx") - x * x / n, F.col("yy") - y * y / n
    # what rounding leaves of the variance of equal similarities is no variance
    r = F.when((vx > 1e-12 * F.col("xx")) & (vy > 1e-12 * F.col("yy")), (F.col("xy") - x * y / n) / F.sqrt(vx * vy))
    return total.select("n", F.when(n > 1, r).alias("r"))


def purity(knn: DataFrame, labels: DataFrame, entity: str, label: str) -> DataFrame:
    """One row: share of neighbours of the query's label, the share expected by chance, and their ratio."""
    own = labels.select(F.col(entity).alias("query"), F.col(label).alias("__q"))
    other = labels.select(F.col(entity).alias("neighbour"), F.col(label).alias("__n"))
    hits = knn.join(own, "query").join(other, "neighbour")
    got = hits.agg(F.avg((F.col("__q") == F.col("__n")).cast("double")).alias("purity"))
    counts = labels.groupBy(label).agg(F.count("*").alias("c"))
    base = counts.agg((F.sum(F.col("c") * (F.col("c") - 1)) / (F.sum("c") * (F.sum("c") - 1))).alias("base_rate"))
    return got.join(F.broadcast(base)).withColumn("enrichment", F.col("purity") / F.nullif(F.col("base_rate"), F.lit(0.0)))  # one row each


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """One row: mean share of the k neighbours that two axes have in common, over queries of both."""
    both = a.select("query").distinct().join(b.select("query").distinct(), "query")
    shared = a.select("query", "neighbour").join(b.select("query", "neighbour"), ["query", "neighbour"]).groupBy("query").agg(F.count("*").alias("c"))
    return both.join(shared, "query", "left").agg(F.avg(F.coalesce("c", F.lit(0)) / k).alias("overlap"), F.count("*").alias("n_queries"))


def cross_axis(axes: dict[str, DataFrame]) -> DataFrame:
    """(query, neighbour, n_axes, axes) of neighbours found by more than one axis."""
    rows = None
    for name, knn in axes.items():
        part = knn.select("query", "neighbour", F.lit(name).alias("axis"))
        rows = part if rows is None else rows.unionByName(part)
    got = rows.groupBy("query", "neighbour").agg(F.count("*").alias("n_axes"), F.sort_array(F.collect_set("axis")).alias("axes"))
    return got.where(F.col("n_axes") > 1)


def resolution(base: DataFrame, queries: DataFrame, entity: str, vector: str, centre: bool = False) -> DataFrame:
    """One row: quantiles of all similarities, and the median over queries of how far the best stands above the query's own median.

    Quantiles are exact, from range-sorted pieces.
    """
    pairs = all_pairs(base, queries, entity, vector, centre)
    whole = exact_quantiles(pairs.select(F.lit("all").alias("pairs"), "similarity"), ["pairs"], "similarity", [0.01, 0.5, 0.99])
    own = exact_quantiles(pairs, ["query"], "similarity", [0.5])
    best = pairs.groupBy("query").agg(F.max("similarity").alias("best"))
    gap = own.join(best, "query").agg(F.median(F.col("best") - F.col("q0")).alias("nearest_gap"))  # one value per query
    return gap.join(F.broadcast(whole), how="left").select(F.col("q0").alias("p01"), F.col("q1").alias("p50"), F.col("q2").alias("p99"), "nearest_gap")  # one row each


def separation(base: DataFrame, queries: DataFrame, entity: str, vector: str, label: str, centre: bool = False) -> DataFrame:
    """One row: AUROC of similarity for equal labels over every pair of a query and another row of ``base``.

    Rows without a label make no pair. Similarities tie at 12 digits.
    """
    fields = "similarity double, same boolean"
    found = base.sparkSession.createDataFrame([], fields)
    known = F.col(label).isNotNull()
    for shared, usable in _blocks(base.where(known), queries.where(known), entity, [vector], centre, [label]):
        found = found.unionByName(usable.mapInArrow(partial(_labelled, shared=shared, centre=centre), fields))
    return auroc_of_all(found.select(F.round("similarity", 12).alias("similarity"), "same"), "similarity", "same")


def confusion(knn: DataFrame, labels: DataFrame, entity: str, label: str) -> DataFrame:
    """(query_label, neighbour_label, n) of nearest neighbours of another label."""
    own = labels.select(F.col(entity).alias("query"), F.col(label).alias("query_label"))
    other = labels.select(F.col(entity).alias("neighbour"), F.col(label).alias("neighbour_label"))
    first = knn.where(F.col("rank") == 1).join(own, "query").join(other, "neighbour")
    return first.where(F.col("query_label") != F.col("neighbour_label")).groupBy("query_label", "neighbour_label").agg(F.count("*").alias("n"))


def split_half(long: DataFrame, entity: str, feature: str, value: str) -> tuple[DataFrame, DataFrame]:
    """The long table in two halves of its features, by a digest of their names."""
    side = F.pmod(digest(feature), F.lit(2))
    return long.where(side == 0), long.where(side == 1)


def retest(a: DataFrame, b: DataFrame, entity: str, feature: str, value: str) -> DataFrame:
    """(entity, r, reliability): correlation of an entity's two profiles, and Spearman-Brown 2r / (1 + r)."""
    both = a.select(entity, feature, F.col(value).alias("__a")).join(b.select(entity, feature, F.col(value).alias("__b")), [entity, feature])
    got = both.groupBy(entity).agg(correlation("__a", "__b").alias("r"), F.count("*").alias("n"))
    return got.select(entity, "n", "r", (2 * F.col("r") / (1 + F.col("r"))).alias("reliability"))
