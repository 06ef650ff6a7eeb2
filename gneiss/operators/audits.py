"""Audits of a score against labels: gate readouts, partial areas, bootstraps, permutations, intervals.

Readouts, tests and bootstraps are plans. The Arrow islands work on one feature's entities (permutation) or on one stratum
of a feature (intervals); every random draw is seeded by its group, so results do not depend on partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.stats import log_choose, phi
from gneiss.operators.aggregates import counted_quantiles
from gneiss.operators.combine import W_FIRST, W_NORM, W_SECOND
from gneiss.operators.correlate import spearman_by
from gneiss.operators.ranks import auroc, partial_areas
from gneiss.operators.resampling import ratio_bootstrap
from gneiss.operators.running import running_sums
from gneiss.session import written

#: Fixed values of the audits: the false-positive regions that are read out.
REGIONS = {"pauc_gate": (0.8, 1.0), "pauc_ranker": (0.0, 0.1), "auc": (0.0, 1.0)}


def _bound(f: Callable[..., pd.DataFrame], **fixed: object) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``f`` of a group's rows with its other arguments given."""

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        return f(pdf, **fixed)

    return apply


def seed_of(*keys: object) -> int:
    """A stable seed for a group."""
    return zlib.crc32("\x1f".join(map(str, keys)).encode())


def hypergeometric_tail(observed: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """P(at most ``observed`` marked among ``drawn`` of ``total``, ``marked`` of which are)."""
    least = F.greatest(F.lit(0), drawn - (total - marked)).cast("int")
    most = F.least(observed, marked, drawn).cast("int")
    every = log_choose(total, drawn)
    term = lambda k: F.exp(log_choose(marked, k) + log_choose(total - marked, drawn - k) - every)
    ks = F.when(most >= least, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))
    return F.least(F.lit(1.0), F.aggregate(ks, F.lit(0.0), lambda a, k: a + term(k)))


def gate_readout(df: DataFrame, feature: str, entity: str, score: str, positive: str, floor_value: str, bins: int = 10, least: tuple[int, int, int] = (30, 5, 5)) -> DataFrame:
    """One row per feature: bin ratios, negative predictive values, partial areas, tail probability, floor test.

    Entities are placed by score, then entity, and cut into ``bins`` equal-count bins; ``profile`` has the bins'
    positive rates over the feature's, ``d1_ratio`` the lowest bin's, ``upper_sd`` the population SD of the others,
    ``d1_hyper_p`` the chance of so few positives in the lowest bin. ``npvX`` is the share of negatives among the lowest X %
    (at least one row, half rounded to even). ``n_floor`` counts rows at the feature's least ``floor_value``, and their rate
    over the feature's is ``floor_ratio`` from 20 rows on. Features with too few rows, positives or
    negatives (``least``) give no row; a NULL label is a negative. Places come from running counts over range-sorted
    pieces, so features of any size are spread over tasks.
    """
    rows = df.where(F.col(score).isNotNull()).select(feature, entity, score, F.coalesce(positive, F.lit(False)).alias("y"), F.col(floor_value).alias("f"))
    placed = running_sums(rows, [feature], [F.asc(score), F.asc(entity)], {"k": F.lit(1), "y": F.col("y").cast("int")})
    n, n_pos = F.col("k_all"), F.col("y_all")
    fit = placed.where((n >= least[0]) & (n_pos >= least[1]) & (n - n_pos >= least[2]))
    floors = rows.groupBy(feature).agg(F.min("f").alias("lowest"))
    k, bin_of = F.col("k_upto"), F.least(F.floor((F.col("k_upto") - 1) * bins / n), F.lit(bins - 1))
    first = lambda share: k <= F.greatest(F.lit(1), F.bround(n * share))
    at_floor = F.col("f") == F.col("lowest")
    counts = fit.join(floors, feature).groupBy(feature).agg(
        F.max(n).alias("n_lines"), F.max(n_pos).alias("n_pos"),
        *[F.count_if(bin_of == b).alias(f"size{b}") for b in range(bins)],
        *[F.count_if((bin_of == b) & F.col("y")).alias(f"hits{b}") for b in range(bins)],
        *[(F.count_if(first(q / 100) & ~F.col("y")) / F.count_if(first(q / 100))).alias(f"npv{q}") for q in (5, 10, 20)],
        F.count_if(at_floor).alias("n_floor"), F.count_if(at_floor & F.col("y")).alias("floor_hits"),
    )
    base = F.col("n_pos") / F.col("n_lines")
    ratio = [F.col(f"hits{b}") / F.nullif(F.col(f"size{b}"), F.lit(0)) / base for b in range(bins)]
    mean = F.aggregate(F.array(*ratio[1:]), F.lit(0.0), lambda a, x: a + x, lambda a: a / (bins - 1))
    sd = F.sqrt(F.aggregate(F.transform(F.array(*ratio[1:]), lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x, lambda a: a / (bins - 1)))
    areas = partial_areas(rows.select(feature, score, "y"), [feature], score, "y", REGIONS)
    return counts.join(areas, feature).select(
        feature, "n_lines", "n_pos", base.alias("base_rate"), F.array(*ratio).alias("profile"), ratio[0].alias("d1_ratio"), sd.alias("upper_sd"),
        hypergeometric_tail(F.col("hits0"), F.col("n_lines"), F.col("n_pos"), F.col("size0")).alias("d1_hyper_p"), *REGIONS,
        "npv5", "npv10", "npv20", "n_floor", F.when(F.col("n_floor") >= 20, F.col("floor_hits") / F.col("n_floor") / base).alias("floor_ratio"),
    )


def gate_summary(gates: DataFrame, value: str = "pauc_gate", centre: float = 0.5) -> DataFrame:
    """One row over all features: median and quartiles of ``value``, the share above ``centre``, and the two-sided
    p of the signed-rank test against it (normal approximation with tie correction, NULL under six differences)."""
    known = gates.where(F.col(value).isNotNull())
    p = signed_rank(known.select((F.col(value) - centre).alias("difference")), [], "difference")
    over = known.agg(
        F.count("*").alias("n_features"), F.percentile(value, F.lit(0.25)).alias("q25"), F.median(value).alias("median"), F.percentile(value, F.lit(0.75)).alias("q75"),
        F.avg((F.col(value) > centre).cast("double")).alias("share_above"),
    )
    return over.join(F.broadcast(p.select("w", "p_value")))  # one row each


def signed_rank(df: DataFrame, by: Sequence[str], difference: str) -> DataFrame:
    """(by, n, w, z, p_value): Wilcoxon's signed-rank test of differences against 0.

    Zeros, NULL and NaN are left out; ties share their mean rank; ``w`` is the rank sum of the positive ones. Normal
    approximation with tie correction, NULL under six differences. Groups of any size: sizes are
    counted first and run up in pieces.
    """
    x = F.col(difference)
    known = df.where(x.isNotNull() & ~F.isnan(x.cast("double")) & (x != 0))
    each = known.groupBy(*by, F.abs(x).alias("__size")).agg(F.count("*").alias("c"), F.count_if(x > 0).alias("up"))
    ran = running_sums(each, by, [F.asc("__size")], {"c": F.col("c")})
    rank = F.col("c_upto") - (F.col("c") - 1) / 2.0
    got = ran.groupBy(*by).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum(F.col("up") * rank).alias("w"), F.sum(F.col("c").cast("double") ** 3 - F.col("c")).alias("ties")
    )
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    staged = got.withColumn("z", F.when(n >= 6, (F.col("w") - n * (n + 1) / 4) / sd)).withColumn("__down", -F.abs("z"))
    return staged.select(*by, "n", "w", "z", (2 * phi("__down")).alias("p_value"))


def rank_sum(df: DataFrame, by: Sequence[str], value: str, positive: str) -> DataFrame:
    """(by, u, z, cliffs_delta): Mann-Whitney by average ranks, normal approximation without tie correction."""
    got = auroc(df, by, value, positive)
    a, b = F.col("n_pos"), F.col("n_neg")
    u = F.col("auroc") * a * b
    z = (u - a * b / 2.0) / F.sqrt(a * b * (a + b + 1) / 12.0)
    return got.select(*by, "n_pos", "n_neg", u.alias("u"), z.alias("z"), (2 * F.col("auroc") - 1).alias("cliffs_delta"))


def cluster_bootstrap(df: DataFrame, feature: str, cluster: str, top: Column, bottom: Column, draws: int = 1000, digits: int = 15) -> DataFrame:
    """(feature, n_clusters, estimate, ci_low, ci_high, se) of sum(top) / sum(bottom), whole clusters drawn again, rounded to ``digits``."""
    got = ratio_bootstrap(df, [feature], cluster, top, bottom, draws)
    return got.withColumns({c: F.round(c, digits) for c in ("estimate", "ci_low", "ci_high", "se")})


def _permuted(pdf: pd.DataFrame, feature: str, stratum: str, entity: str, value: str, positive: str, draws: int) -> pd.DataFrame:
    rows = pdf[pdf[value].notna()].sort_values([stratum, entity], na_position="last")
    x, label = rows[value].to_numpy(dtype=float), rows[positive].fillna(False).to_numpy(dtype=bool)
    key = rows[feature].iloc[0] if len(rows) else pdf[feature].iloc[0]
    if not len(rows) or label.all() or not label.any():
        return pd.DataFrame([{feature: key, "n": len(rows), "delta": np.nan, "p_value": np.nan}])
    codes = pd.factorize(rows[stratum], use_na_sentinel=False)[0]
    rng = np.random.default_rng(seed_of(key, "permute"))
    gap = lambda y: x[y].mean() - x[~y].mean()
    real, beyond = gap(label), 0
    for _ in range(draws):
        shuffled = np.empty_like(label)
        order = np.lexsort((rng.random(len(x)), codes))
        shuffled[np.argsort(codes, kind="stable")] = label[order]
        beyond += abs(gap(shuffled)) >= abs(real) - 1e-12
    return pd.DataFrame([{feature: key, "n": len(rows), "delta": real, "p_value": (beyond + 1) / (draws + 1)}])


def permutation_test(df: DataFrame, feature: str, stratum: str, entity: str, value: str, positive: str, draws: int = 200) -> DataFrame:
    """(feature, n, delta, p_value): difference of means against labels shuffled within strata."""
    kind = df.schema[feature].dataType.simpleString()
    f = _bound(_permuted, feature=feature, stratum=stratum, entity=entity, value=value, positive=positive, draws=draws)
    return df.select(feature, stratum, entity, value, positive).groupBy(feature).applyInPandas(f, f"{feature} {kind}, n bigint, delta double, p_value double")


def false_discovery(df: DataFrame, p: str, out: str = "q", method: str = "bh") -> DataFrame:
    """``df`` with ``out``: the false-discovery rate of each p by step-up; NULL p have none and do not count.

    ``method``: "bh" (independent tests), "by" (any dependence: times the harmonic sum), "storey" (times the estimated
    share of true nulls, (1 + #{p > 0.5}) / (m / 2), at most 1). Distinct p values are counted, run up over
    range-sorted pieces, and take the least of their own and all later ones' rates the same way.
    """
    levels = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("c"))
    ran = running_sums(levels, [], [F.asc("__p")], {"c": F.col("c"), "late": F.when(F.col("__p") > 0.5, F.col("c"))})
    m, r = F.col("c_all").cast("double"), F.col("c_upto")
    if method == "by":
        # sum of 1 / i for i = 1 .. m by its expansion, exact below 20
        exact = F.aggregate(F.sequence(F.lit(1), F.least(F.col("c_all"), F.lit(20)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
        factor = F.when(m <= 20, exact).otherwise(F.ln(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m) + 1 / (120 * m**4))
    elif method == "storey":
        factor = F.least(F.lit(1.0), (1 + F.col("late_all")) / (0.5 * m))
    else:
        factor = F.lit(1.0)
    raw = ran.select("__p", (F.col("__p") * m * factor / r).alias("__raw"))
    # Least over this and all greater p: within a piece by a window, beyond it from one row per piece.
    pieces = written(raw.repartitionByRange(F.desc("__p")).withColumn("__piece", F.spark_partition_id()))
    own = pieces.withColumn("__own", F.min("__raw").over(Window.partitionBy("__piece").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    heads = pieces.groupBy("__piece").agg(F.min("__raw").alias("__least"))
    earlier = heads.select(F.col("__piece").alias("__at"), F.min("__least").over(Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))  # one row per piece
    q = own.join(F.broadcast(earlier), F.col("__piece") == F.col("__at")).select("__p", F.least("__own", "__before", F.lit(1.0)).alias(out))
    return df.join(q, F.col(p) == F.col("__p"), "left").drop("__p")


def _normal(u: np.ndarray) -> np.ndarray:
    """Inverse normal of shares, looked up once per distinct one."""
    values, which = np.unique(u, return_inverse=True)
    return np.array([NormalDist().inv_cdf(v) for v in values])[which].reshape(u.shape)


#: Draws of a stratum that are held at once.
DRAW_BLOCK = 50


def _stratum_draws(pdf: pd.DataFrame, feature: str, entity: str, stratum: str, draws: int, top: int, tail: float, rho: float) -> pd.DataFrame:
    """Band of every entity of one (feature, stratum), and the draws in which it is among the stratum's first."""
    rows = pdf.sort_values(entity, kind="stable")
    n = len(rows)
    get = lambda c: rows[c].to_numpy(dtype=float)
    z1, e1, z2, e2 = get("z1"), np.nan_to_num(get("se1")), get("z2"), np.nan_to_num(get("se2"))
    slope, centre, sd = get("beta"), get("centre"), get("sd")
    two = ~np.isnan(z2)
    shares = _normal(np.clip(np.arange(1, n + 1) / n, 0.001, 0.999))

    def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        order = np.argsort(a, axis=1, kind="stable")
        first = np.empty_like(a)
        np.put_along_axis(first, order, np.broadcast_to(shares, a.shape), axis=1)
        residual = (b - slope * a - centre) / sd
        return np.where(two, (W_FIRST * first + W_SECOND * residual) / W_NORM, first)

    # Quantiles need the outermost values alone, so only those are kept from block to block.
    place = tail * (draws - 1)
    keep = int(np.floor(place)) + 2
    lowest, highest = np.zeros((0, n)), np.zeros((0, n))
    firsts: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    rng = np.random.default_rng(seed_of(rows[feature].iloc[0], rows[stratum].iloc[0], draws))
    for begin in range(0, draws, DRAW_BLOCK):
        size = min(DRAW_BLOCK, draws - begin)
        noise = rng.standard_normal((2, size, n))
        noise[1] = rho * noise[0] + np.sqrt(1 - rho * rho) * noise[1]
        z = combined(z1 + noise[0] * e1, np.nan_to_num(z2) + noise[1] * e2)
        lowest = np.sort(np.vstack((lowest, z)), axis=0)[:keep]
        highest = -np.sort(-np.vstack((highest, z)), axis=0)[:keep]
        best = np.argsort(-z, axis=1, kind="stable")[:, :top]
        for i in range(size):
            for j in best[i]:
                firsts[j].append((begin + i, float(z[i, j])))
    at, part = int(np.floor(place)), place - np.floor(place)
    edge = lambda x: x[at] + (x[min(at + 1, len(x) - 1)] - x[at]) * part
    return pd.DataFrame(
        {
            feature: rows[feature], entity: rows[entity], "z_low": edge(lowest), "z_high": edge(highest), "z_point": combined(z1[None, :], np.nan_to_num(z2)[None, :])[0],
            "firsts": [[{"draw": d, "z": z} for d, z in x] for x in firsts],
        }
    )


def score_intervals(df: DataFrame, feature: str, entity: str, stratum: str, draws: int = 500, top: int = 10, tail: float = 0.025, error_correlation: float = 0.0) -> DataFrame:
    """(feature, entity, score, ci_low, ci_high, ci_width, n_layers, n_sources, top_global_pct, top_stratum_pct, win_rate_pct).

    ``df`` has z1, se1 (first layer), z2, se2 (second, NULL where unmeasured), per feature beta, centre and sd of the
    residual, and point (the deterministic score, NULL where unknown) and n_sources. Every draw adds normal
    noise of the standard errors, ranks the first layer within (feature, stratum), takes the residual of the second and
    combines both. ``score`` is the point score, or that of the draw without noise where it is unknown; the band
    runs from the ``tail`` to the 1 - ``tail`` quantile and is widened to hold it. The shares of draws in which an
    entity is among the ``top`` of its stratum, of all, or the very first come in per cent.

    ``error_correlation`` is that of the two layers' errors of an entity.

    A task holds one (feature, stratum), ``DRAW_BLOCK`` draws at a time; draws are seeded by both, so
    partitions do not matter. Only each draw's first ``top`` of a stratum go on to be ranked over all strata.
    """
    names = [feature, entity, stratum, "z1", "se1", "z2", "se2", "beta", "centre", "sd"]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"`{feature}` {kinds[feature]}, `{entity}` {kinds[entity]}, z_low double, z_high double, z_point double, firsts array<struct<draw: int, z: double>>"
    f = _bound(_stratum_draws, feature=feature, entity=entity, stratum=stratum, draws=draws, top=top, tail=tail, rho=error_correlation)
    bands = written(df.where(F.col("z1").isNotNull()).select(*names).groupBy(feature, stratum).applyInPandas(f, schema))
    firsts = bands.select(feature, entity, F.explode("firsts").alias("x")).select(feature, entity, "x.draw", "x.z")
    # top x strata rows a (feature, draw)
    placed = firsts.withColumn("k", F.row_number().over(Window.partitionBy(feature, "draw").orderBy(F.desc("z"), F.asc(entity))))
    wins = placed.groupBy(feature, entity).agg(F.count_if(F.col("k") <= top).alias("__g"), F.count_if(F.col("k") == 1).alias("__w"))
    known = df.where(F.col("z1").isNotNull()).select(feature, entity, "point", "n_sources", F.when(F.col("z2").isNotNull(), 2).otherwise(1).alias("n_layers"))
    joined = bands.join(known, [feature, entity]).join(wins, [feature, entity], "left")
    score = F.coalesce("point", phi("z_point"))
    low, high = F.least(phi("z_low"), F.col("score")), F.greatest(phi("z_high"), F.col("score"))
    pct = lambda c: 100.0 * F.coalesce(c, F.lit(0)) / draws
    return joined.withColumn("score", score).withColumns({"ci_low": low, "ci_high": high}).select(
        feature, entity, "score", "ci_low", "ci_high", (F.col("ci_high") - F.col("ci_low")).alias("ci_width"), "n_layers", "n_sources",
        pct(F.col("__g")).alias("top_global_pct"), pct(F.size("firsts")).alias("top_stratum_pct"), pct(F.col("__w")).alias("win_rate_pct"),
    )


#: How much the second layer's error grows with its platforms' disagreement.
TIER_FACTORS = {"consistent": 1.0, "cautious": 1.5, "conflicting": 2.2}


def second_layer_error(k: Column, between: Column, tier: Column, prior: float = 0.45, within: float = 0.3) -> Column:
    """Standard error from the spread between sources and a floor that grows with the platform tier; an unknown tier
    counts as cautious."""
    factor = F.lit(TIER_FACTORS["cautious"])
    for name, times in TIER_FACTORS.items():
        factor = F.when(tier == name, times).otherwise(factor)
    a = F.coalesce(F.when(k >= 2, between / F.sqrt(F.greatest(k, F.lit(1)).cast("double"))), F.lit(prior))
    return F.sqrt(a * a + (within * factor) ** 2)


def first_layer_error(k: Column, between: Column, prior: float = 0.25, within: float = 0.3, sources: int = 3, cap: float = 1.5) -> Column:
    """Standard error from the spread between sources and a floor that grows as sources are missing, up to ``cap``."""
    seen = F.greatest(k, F.lit(1)).cast("double")
    a = F.coalesce(F.when(k >= 2, between / F.sqrt(seen)), F.lit(prior))
    b = within * F.least(F.sqrt(sources / seen), F.lit(cap))
    return F.sqrt(a * a + b * b)


def hit_at_k(df: DataFrame, by: Sequence[str], rank: str, positive: str, k: int = 20) -> DataFrame:
    """One row: hits within the first k of every group over all positives."""
    per = df.groupBy(*by).agg(F.count_if((F.col(rank) <= k) & F.col(positive)).alias("__h"), F.count_if(F.col(positive)).alias("__p"))
    return per.agg(F.sum("__h").alias("hits"), F.sum("__p").alias("positives"), (F.sum("__h") / F.nullif(F.sum("__p"), F.lit(0))).alias("hit_rate"))


def sweep(values: Sequence[float], name: str, query: Callable[[float], DataFrame]) -> DataFrame:
    """The union of a query's results for every value of a parameter, with the value as column ``name``."""
    out = None
    for v in values:
        part = query(v).withColumn(name, F.lit(v))
        out = part if out is None else out.unionByName(part)
    return out


def scale_guard(df: DataFrame, value: str, first: Column, second: Column, target_rate: float, least_gap: float = 0.15) -> DataFrame:
    """One row: medians of all, of the reference rows expected low (``first``) and of those expected not to be (``second``), their
    separation, the cut below which ``target_rate`` of the second fall, and whether the sets stand apart the right way."""
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"), F.count_if(first).alias("a"), F.count_if(second).alias("b"))
    got = counted_quantiles(counts, [], "v", {"median_all": ("n", 0.5), "median_first": ("a", 0.5), "median_second": ("b", 0.5), "threshold": ("b", target_rate)})
    gap = F.col("median_second") - F.col("median_first")
    return got.select("median_all", "median_first", "median_second", gap.alias("separation"), "threshold", F.coalesce(gap > least_gap, F.lit(False)).alias("passed"))


def family_rates(df: DataFrame, name: str, families: dict[str, str], fired: Column) -> DataFrame:
    """(family, n, rate): how often ``fired`` holds among the rows whose name matches each family's pattern; the first that
    matches counts, the rest are "other"."""
    family = F.lit("other")
    for label, pattern in reversed(list(families.items())):
        family = F.when(F.lower(name).rlike(pattern), label).otherwise(family)
    return df.groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.avg(fired.cast("double")).alias("rate"))


def completeness(df: DataFrame, value: str, sources: str, ties: Sequence[str], most: int, top: int) -> DataFrame:
    """One row: spread and mean size of values from ``most`` sources over those from one, and the share of ``most`` among the
    ``top`` greatest and least values over its share of all (ties by ``ties``)."""
    x, full, one = F.col(value), F.col(sources) == most, F.col(sources) == 1
    whole = df.agg(
        (F.stddev_pop(F.when(full, x)) / F.stddev_pop(F.when(one, x))).alias("r_sd"), (F.avg(F.when(full, F.abs(x))) / F.avg(F.when(one, F.abs(x)))).alias("r_abs"),
        F.avg(full.cast("double")).alias("base"),
    )
    known = df.where(x.isNotNull())
    ends = [known.orderBy(o, *ties).limit(top).agg(F.avg(full.cast("double")).alias(n)) for o, n in ((F.desc(value), "c"), (F.asc(value), "d"))]
    base = F.nullif(F.col("base"), F.lit(0.0))
    return whole.join(ends[0]).join(ends[1]).select("r_sd", "r_abs", (F.col("c") / base).alias("t1c"), (F.col("d") / base).alias("t1d"))  # one row each


def paired_labels(rows: DataFrame, feature: str, label: str, a: str, b: str, value: str) -> DataFrame:
    """One row over the features that have ``value`` under both labels: medians, signed-rank p of the difference, rank
    correlation and the share that falls on the same side of 1."""
    wide = rows.groupBy(feature).agg(F.max(F.when(F.col(label) == a, F.col(value))).alias("a"), F.max(F.when(F.col(label) == b, F.col(value))).alias("b"))
    both = written(wide.where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    test = signed_rank(both.withColumn("x", F.col("a") - F.col("b")), [], "x").select("p_value")
    rho = spearman_by(both.withColumn("__one", F.lit(1)), ["__one"], "a", "b").select(F.col("rho").alias("spearman"))
    over = both.agg(
        F.count("*").alias("n_features"), F.median("a").alias("median_a"), F.median("b").alias("median_b"), F.avg(((F.col("a") < 1) == (F.col("b") < 1)).cast("double")).alias("sign_agreement")
    )
    return over.join(test, how="left").join(rho, how="left")  # one row each


def gini(df: DataFrame, value: str) -> DataFrame:
    """One row: (n, gini, largest_share) of non-negative contributions; NULL where they sum to 0."""
    ran = running_sums(df.where(F.col(value).isNotNull()), [], [F.asc(value)], {"__k": F.lit(1)})
    got = ran.agg(F.count("*").alias("n"), F.sum(F.col("__k_upto") * F.col(value)).alias("kx"), F.sum(value).alias("total"), F.max(value).alias("top"))
    total, n = F.nullif(F.col("total"), F.lit(0)), F.col("n")
    return got.select("n", (2 * F.col("kx") / (n * total) - (n + 1) / n).alias("gini"), (F.col("top") / total).alias("largest_share"))


def interval_checks(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(check, violations) of a table of ``score_intervals``: one pass, and one aggregation for repeated pairs."""
    pct = [F.col(c) for c in ("top_global_pct", "top_stratum_pct", "win_rate_pct")]
    outside = pct[0].isNull()
    for c in pct:
        outside = outside | (c < 0) | (c > 100)
    rules = {
        "band holds the score": ~((F.col("ci_low") <= F.col("score")) & (F.col("score") <= F.col("ci_high"))),
        "width is high less low": F.abs(F.col("ci_high") - F.col("ci_low") - F.col("ci_width")) > 1e-12,
        "shares within 0 and 100": outside,
        "layers within 1 and 2": ~F.col("n_layers").isin(1, 2),
    }
    one = intervals.agg(*[F.count_if(F.coalesce(r, F.lit(True))).alias(f"c{i}") for i, r in enumerate(rules.values())])
    repeated = intervals.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("c9"))
    named = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("violations")) for i, n in enumerate(rules)], F.struct(F.lit("one row a pair").alias("check"), F.col("c9").alias("violations")))
    return one.join(repeated).select(F.explode(named).alias("x")).select("x.check", "x.violations")  # one row each
