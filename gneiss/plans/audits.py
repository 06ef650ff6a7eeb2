"""Queries of similarity, neighbours, statistics, audits and clusters, and the streaming extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions.stats import correlation
from gneiss.functions import stats
from gneiss.operators import aggregates, audits, clusters, combine, correlate, ranks, serving, similarity, thresholds, zscores
from gneiss.plans import roles
from gneiss.plans.registry import Registry
from gneiss.plans.roles import sql
from gneiss.plans.scoring import _METHOD, _PAIRED, flags, layers, paired, r6
from gneiss.plans.stage import measured, stage
from gneiss.session import cut, table, written

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
K = 10


# ------------------------------------------------------------------ similarity


def embedded(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, v, v0, v1, label): the embeddings and their two halves of dimensions, the axes."""
    e = table(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", v.alias("v"), *[F.slice(v, 1 + 32 * i, 32).alias(f"v{i}") for i in (0, 1)], "label")


def asked(e: DataFrame) -> DataFrame:
    """The stated query set: every id divisible by 50."""
    return e.where(F.col("vec_id") % 50 == 0)


def neighbours(spark: SparkSession, d: str, half: int | None = None) -> DataFrame:
    """The K nearest embeddings of every id divisible by 50, against all; ``half`` takes half of the dimensions."""
    e = embedded(spark, d)
    return similarity.nearest(e, asked(e), "vec_id", "v" if half is None else f"v{half}", K)


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label")


def _knn(slice_: str = "") -> dict[str, str]:
    v = f"embedding{slice_}"
    return {
        "kn": f"""SELECT query, neighbour, similarity, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 12) DESC, neighbour) AS rank FROM (
  SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity(CAST(a.{v} AS DOUBLE[]), CAST(b.{v} AS DOUBLE[])) AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) QUALIFY rank <= {K}"""
    }


@query(sql("SELECT query, neighbour, round(similarity, 6) AS similarity, rank FROM kn", **_knn()))
def g01_nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d).select("query", "neighbour", *r6("similarity"), "rank")


_PAIRS = {
    "pr": """SELECT a.vec_id AS query, b.vec_id AS neighbour, a.label AS la, b.label AS lb, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s,
  list_cosine_similarity(CAST(a.embedding[1:32] AS DOUBLE[]), CAST(b.embedding[1:32] AS DOUBLE[])) AS s0, list_cosine_similarity(CAST(a.embedding[33:64] AS DOUBLE[]), CAST(b.embedding[33:64] AS DOUBLE[])) AS s1
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0"""
}


@query(sql("SELECT round(p01, 6) AS p01, round(p50, 6) AS p50, round(p99, 6) AS p99, round(gap, 6) AS nearest_gap FROM (SELECT quantile_cont(s, 0.01) AS p01, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.99) AS p99 FROM pr), (SELECT median(g) AS gap FROM (SELECT max(s) - median(s) AS g FROM pr GROUP BY query))", **_PAIRS))
def g02_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Over every pair of the query set."""
    e = embedded(spark, d)
    return similarity.resolution(e, asked(e), "vec_id", "v").select(*r6("p01", "p50", "p99", "nearest_gap"))


_HALVES = {"k0": _knn("[1:32]")["kn"], "k1": _knn("[33:64]")["kn"]}


@query(sql("SELECT round(avg(coalesce(c, 0) / 10.0), 6) AS overlap, count(*) AS n_queries FROM (SELECT DISTINCT query FROM k0) LEFT JOIN (SELECT query, count(*) AS c FROM k0 JOIN k1 USING (query, neighbour) GROUP BY query) USING (query)", **_HALVES))
def g04_split_half_overlap(spark: SparkSession, d: str) -> DataFrame:
    return similarity.overlap(neighbours(spark, d, 0), neighbours(spark, d, 1), K).select(*r6("overlap"), "n_queries")


@query(sql("SELECT query, neighbour, count(*) AS n_axes FROM (SELECT query, neighbour FROM k0 UNION ALL SELECT query, neighbour FROM k1) GROUP BY ALL HAVING count(*) > 1", **_HALVES))
def u07_cross_axis_agreement(spark: SparkSession, d: str) -> DataFrame:
    return similarity.cross_axis({"first": neighbours(spark, d, 0), "second": neighbours(spark, d, 1)}).select("query", "neighbour", "n_axes")


@query(sql("SELECT count(*) AS n, round(corr(s0, s1), 6) AS r FROM pr", **_PAIRS))
def g03_axis_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Over every pair of the query set."""
    e = embedded(spark, d)
    return similarity.axis_correlation(e, asked(e), "vec_id", "v0", "v1").select("n", *r6("r"))


@query(sql("""SELECT round(purity, 6) AS purity, round(base, 6) AS base_rate, round(purity / base, 6) AS enrichment FROM (SELECT avg(CAST(a.label = b.label AS DOUBLE)) AS purity FROM kn JOIN embeddings a ON query = a.vec_id JOIN embeddings b ON neighbour = b.vec_id),
(SELECT sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) AS base FROM (SELECT label, count(*) AS c FROM embeddings GROUP BY label))""", **_knn()))
def g06_neighbour_purity(spark: SparkSession, d: str) -> DataFrame:
    return similarity.purity(neighbours(spark, d), labels(spark, d), "vec_id", "label").select(*r6("purity", "base_rate", "enrichment"))


@query(sql("""SELECT n1 AS n_pos, n0 AS n_neg, round((sum(r) FILTER (WHERE same) - n1 * (n1 + 1) / 2.0) / (CAST(n1 AS DOUBLE) * n0), 6) AS auroc FROM (SELECT same, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r, count(*) FILTER (WHERE same) OVER () AS n1, count(*) FILTER (WHERE NOT same) OVER () AS n0
FROM (SELECT round(s, 12) AS s, la = lb AS same FROM pr WHERE la IS NOT NULL AND lb IS NOT NULL)) GROUP BY n1, n0""", **_PAIRS))
def g07_separation_auroc(spark: SparkSession, d: str) -> DataFrame:
    """Over every pair of the query set."""
    e = embedded(spark, d)
    return similarity.separation(e, asked(e), "vec_id", "v", "label").select("n_pos", "n_neg", *r6("auroc"))


@query(sql("SELECT a.label AS query_label, b.label AS neighbour_label, count(*) AS n FROM kn JOIN embeddings a ON query = a.vec_id JOIN embeddings b ON neighbour = b.vec_id WHERE rank = 1 AND a.label <> b.label GROUP BY ALL", **_knn()))
def g08_confusion(spark: SparkSession, d: str) -> DataFrame:
    return similarity.confusion(neighbours(spark, d), labels(spark, d), "vec_id", "label")


@query(sql("SELECT ent, n, round(r, 6) AS r, round(2 * r / (1 + r), 6) AS reliability FROM (SELECT ent, count(*) AS n, corr(a, b) AS r FROM wide WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ent HAVING count(*) >= 5)", "m", **_PAIRED))
def g05_retest_reliability(spark: SparkSession, d: str) -> DataFrame:
    m = stage(spark, d, "measurements")
    got = similarity.retest(m.where(F.col("src") == "A"), m.where(F.col("src") == "N"), "ent", "feat", "value")
    return got.where(F.col("n") >= 5).select("ent", "n", *r6("r", "reliability"))


@query()
def g01_entity_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Spearman neighbours of entities over imputed, standardised profiles: query entities divisible by 50, all entities as base."""
    m = measured(spark, d).groupBy("ent", "feat").agg(F.avg("value").alias("value"))
    z = similarity.prepare(m, "ent", "feat", "value", 0.5)
    v = written(similarity.vectors(similarity.ranked_rows(z, "ent", "z"), "ent", "feat", "z"))  # read by queries and base, block by block
    return similarity.nearest(v, v.where(F.col("ent") % 50 == 0), "ent", "vector", K, centre=True)


# ------------------------------------------------------------------ audits


def panel(spark: SparkSession, d: str) -> DataFrame:
    """(feat, ent, strat, score, dep, expr): scores with a label from another source of the pair."""
    s = stage(spark, d, "scores")
    lab = stage(spark, d, "raw").groupBy("feat", "ent").agg((F.max("disc") >= 0.1).alias("dep"), F.max("val").alias("expr"))
    return s.join(lab, ["feat", "ent"])


_PANEL = {
    "lb": "SELECT feat, ent, max(disc) >= 0.1 AS dep, max(val) AS expr FROM raw GROUP BY ALL",
    "pn": "SELECT feat, ent, strat, score, dep, expr FROM sc JOIN lb USING (feat, ent)",
}


@query(sql("""SELECT feat, n1 AS n_pos, n0 AS n_neg, round((sum(CASE WHEN dep THEN r END) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auroc FROM (SELECT *, rank() OVER (PARTITION BY feat ORDER BY score) + (count(*) OVER (PARTITION BY feat, score) - 1) / 2.0 AS r,
count(*) FILTER (WHERE dep) OVER (PARTITION BY feat) AS n1, count(*) FILTER (WHERE NOT dep) OVER (PARTITION BY feat) AS n0 FROM pn) GROUP BY feat, n1, n0""", "sc", **_PANEL))
def g15_auroc(spark: SparkSession, d: str) -> DataFrame:
    return ranks.auroc(panel(spark, d), ["feat"], "score", "dep").select("feat", "n_pos", "n_neg", *r6("auroc"))


@query(sql("""SELECT feat, round(u, 3) AS u, round((u - n1 * n0 / 2.0) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0), 6) AS z, round(2 * u / (n1 * n0) - 1, 6) AS cliffs_delta FROM (SELECT feat, n1, n0, sum(CASE WHEN dep THEN r END) - n1 * (n1 + 1) / 2.0 AS u FROM (SELECT *, rank() OVER (PARTITION BY feat ORDER BY score) + (count(*) OVER (PARTITION BY feat, score) - 1) / 2.0 AS r,
count(*) FILTER (WHERE dep) OVER (PARTITION BY feat) AS n1, count(*) FILTER (WHERE NOT dep) OVER (PARTITION BY feat) AS n0 FROM pn) GROUP BY feat, n1, n0)""", "sc", **_PANEL))
def g19_rank_sum(spark: SparkSession, d: str) -> DataFrame:
    return audits.rank_sum(panel(spark, d), ["feat"], "score", "dep").select("feat", F.round("u", 3).alias("u"), *r6("z", "cliffs_delta"))


_AREA = "(1 + (coalesce(sum(CASE WHEN least(x1, {h}) > greatest(x0, {l}) THEN (least(x1, {h}) - greatest(x0, {l})) * (y0 + (y1 - y0) * ((greatest(x0, {l}) + least(x1, {h})) / 2 - x0) / (x1 - x0)) END), 0) - ({h} * {h} - {l} * {l}) / 2) / ({h} - {l} - ({h} * {h} - {l} * {l}) / 2)) / 2"
_GATE = {
    "pk": "SELECT feat, ent, score, coalesce(dep, false) AS y, expr AS f, row_number() OVER (PARTITION BY feat ORDER BY score, ent) AS k, count(*) OVER (PARTITION BY feat) AS n, count(*) FILTER (WHERE dep) OVER (PARTITION BY feat) AS np, min(expr) OVER (PARTITION BY feat) AS lo FROM pn WHERE score IS NOT NULL",
    "fit": "SELECT *, least((k - 1) * 10 // n, 9) AS b FROM pk WHERE n >= 30 AND np >= 5 AND n - np >= 5",
    "bn": "SELECT feat, b, count(*) AS size, count(*) FILTER (WHERE y) AS hits, count(*) FILTER (WHERE y) / count(*) / (max(np) / max(n)) AS ratio FROM fit GROUP BY ALL",
    "b2": "SELECT feat, list(round(ratio, 6) ORDER BY b) AS profile, max(ratio) FILTER (WHERE b = 0) AS d1_ratio, stddev_pop(ratio) FILTER (WHERE b > 0) AS upper_sd, max(size) FILTER (WHERE b = 0) AS size0, max(hits) FILTER (WHERE b = 0) AS hits0 FROM bn GROUP BY feat",
    "ct": "SELECT feat, max(n) AS n_lines, max(np) AS n_pos, " + ", ".join(f"count(*) FILTER (WHERE k <= greatest(1, round_even(n * {q} / 100.0, 0)) AND NOT y) / count(*) FILTER (WHERE k <= greatest(1, round_even(n * {q} / 100.0, 0))) AS npv{q}" for q in (5, 10, 20))
    + ", count(*) FILTER (WHERE f = lo) AS n_floor, count(*) FILTER (WHERE f = lo AND y) AS floor_hits FROM fit GROUP BY feat",
    "ps": "SELECT feat, score, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS q FROM pk GROUP BY ALL",
    "pt": "SELECT feat, (sum(q) OVER w - q) / sum(q) OVER (PARTITION BY feat) AS x0, sum(q) OVER w / sum(q) OVER (PARTITION BY feat) AS x1, (sum(p) OVER w - p) / sum(p) OVER (PARTITION BY feat) AS y0, sum(p) OVER w / sum(p) OVER (PARTITION BY feat) AS y1 FROM ps WINDOW w AS (PARTITION BY feat ORDER BY score DESC)",
    "ar": f"SELECT feat, {_AREA.format(l=0.8, h=1.0)} AS pauc_gate, {_AREA.format(l=0.0, h=0.1)} AS pauc_ranker, {_AREA.format(l=0.0, h=1.0)} AS auc FROM pt GROUP BY feat",
    "gt": """SELECT feat, n_lines, n_pos, n_pos / n_lines AS base_rate, profile, d1_ratio, upper_sd, least(1.0, list_sum(list_transform(generate_series(greatest(0, size0 - (n_lines - n_pos)), least(hits0, n_pos, size0)), lambda k:
  exp(lgamma(n_pos + 1) - lgamma(k + 1) - lgamma(n_pos - k + 1) + lgamma(n_lines - n_pos + 1) - lgamma(size0 - k + 1) - lgamma(n_lines - n_pos - size0 + k + 1) - lgamma(n_lines + 1) + lgamma(size0 + 1) + lgamma(n_lines - size0 + 1))))) AS d1_hyper_p,
  pauc_gate, pauc_ranker, auc, npv5, npv10, npv20, n_floor, CASE WHEN n_floor >= 20 THEN floor_hits / n_floor / (n_pos / n_lines) END AS floor_ratio FROM ct JOIN b2 USING (feat) JOIN ar USING (feat)""",
}
_GATE_FIGURES = ("base_rate", "d1_ratio", "upper_sd", "d1_hyper_p", "pauc_gate", "pauc_ranker", "auc", "npv5", "npv10", "npv20", "floor_ratio")


@query(sql("SELECT feat, n_lines, n_pos, profile, n_floor, " + ", ".join(f"round({c}, 6) AS {c}" for c in _GATE_FIGURES) + " FROM gt", "sc", **_PANEL, **_GATE))
def g16_gate_readout(spark: SparkSession, d: str) -> DataFrame:
    """Decile ratios, partial areas, predictive values, tail probability and floor test per feature."""
    got = audits.gate_readout(panel(spark, d), "feat", "ent", "score", "dep", "expr")
    return got.select("feat", "n_lines", "n_pos", F.transform("profile", lambda x: F.round(x, 6)).alias("profile"), "n_floor", *r6(*_GATE_FIGURES))


_SIGNED = {
    "df": "SELECT pauc_gate - 0.5 AS x FROM gt WHERE pauc_gate IS NOT NULL",
    "rk": "SELECT x, abs(x) AS a, rank() OVER (ORDER BY abs(x)) + (count(*) OVER (PARTITION BY abs(x)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY abs(x)) AS t FROM df WHERE x <> 0",
    "wx": "SELECT sum(r) FILTER (WHERE x > 0) AS w, count(*) AS n, sum(t * t - 1.0) AS ties FROM rk",
}


@query(sql("SELECT n_features, round(q25, 6) AS q25, round(med, 6) AS median, round(q75, 6) AS q75, round(share_above, 6) AS share_above, round(w, 3) AS w, round(CASE WHEN n >= 6 THEN 2 * (" + stats.sql_phi("(-abs((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)))")
           + ") END, 6) AS p_value FROM (SELECT count(*) AS n_features, quantile_cont(pauc_gate, 0.25) AS q25, median(pauc_gate) AS med, quantile_cont(pauc_gate, 0.75) AS q75, avg(CAST(pauc_gate > 0.5 AS DOUBLE)) AS share_above FROM gt WHERE pauc_gate IS NOT NULL), wx",
           "sc", **_PANEL, **_GATE, **_SIGNED))
def g18_gate_summary(spark: SparkSession, d: str) -> DataFrame:
    """The gates of all features together, with the signed-rank test of their partial areas against chance."""
    got = audits.gate_summary(audits.gate_readout(panel(spark, d), "feat", "ent", "score", "dep", "expr"))
    return got.select("n_features", *r6("q25", "median", "q75", "share_above"), F.round("w", 3).alias("w"), *r6("p_value"))


@query(sql("""SELECT feat, decile, count(*) AS n, round(avg(CAST(dep AS DOUBLE)), 6) AS rate, round(avg(CAST(dep AS DOUBLE)) / base, 6) AS ratio FROM (SELECT feat, dep, avg(CAST(dep AS DOUBLE)) OVER (PARTITION BY feat) AS base, CAST(least((row_number() OVER (PARTITION BY feat ORDER BY score, ent) - 1) * 10 // count(*) OVER (PARTITION BY feat), 9) AS INTEGER) AS decile FROM pn) GROUP BY feat, decile, base""", "sc", **_PANEL))
def g44_decile_rates(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).withColumn("decile", ranks.equal_count_bin(["feat"], "score", "ent"))
    rate = F.avg(F.col("dep").cast("double"))
    base = p.groupBy("feat").agg(rate.alias("base"))
    got = p.groupBy("feat", "decile").agg(F.count("*").alias("n"), rate.alias("rate")).join(base, "feat")
    return got.select("feat", "decile", "n", *r6("rate"), F.round(F.col("rate") / F.col("base"), 6).alias("ratio"))


def md5_number(*keys: object) -> str:
    """The SQL of ``resampling.digest``."""
    return f"CAST('0x' || substr(md5(concat_ws('/', {', '.join(map(str, keys))})), 1, 12) AS BIGINT)"


def multiplicities_sql(clusters: str, cluster: str, draws: int, seed: int = 42) -> str:
    """The SQL of ``resampling.multiplicities``."""
    ids = f"SELECT {cluster}, row_number() OVER (ORDER BY {cluster}) - 1 AS c FROM (SELECT DISTINCT {cluster} FROM {clusters} WHERE {cluster} IS NOT NULL)"
    return f"""SELECT {cluster}, b, times FROM (SELECT b, {md5_number(seed, 'b', 'i')} % n AS c, count(*) AS times FROM (SELECT unnest(range({draws})) AS b), (SELECT unnest(range(n)) AS i, n FROM (SELECT count(DISTINCT {cluster}) AS n FROM {clusters})) GROUP BY ALL)
  JOIN ({ids}) USING (c)"""


_BOOT = {
    "tm": multiplicities_sql("pn", "strat", 600),
    "su": "SELECT feat, strat, sum(CAST(dep AS INTEGER)) AS t, count(*) AS u FROM pn GROUP BY ALL",
    "rp": "SELECT feat, b, sum(t * times) / sum(u * times) AS r FROM su JOIN tm USING (strat) GROUP BY ALL",
}


@query(sql("SELECT feat, n_clusters, round(estimate, 6) AS estimate, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(se, 6) AS se FROM (SELECT feat, count(*) AS n_clusters, sum(t) / sum(u) AS estimate FROM su GROUP BY feat) JOIN (SELECT feat, quantile_cont(r, 0.025) AS ci_low, quantile_cont(r, 0.975) AS ci_high, stddev_samp(r) AS se FROM rp GROUP BY feat) USING (feat)", "sc", **_PANEL, **_BOOT))
def g11_cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    return audits.cluster_bootstrap(p, "feat", "strat", F.col("dep").cast("int"), F.lit(1), 600, 6)


@query()
def g14_permutation_test(spark: SparkSession, d: str) -> DataFrame:
    return audits.permutation_test(panel(spark, d), "feat", "strat", "ent", "score", "dep", 200)


def interval_rows(spark: SparkSession, d: str) -> DataFrame:
    """What ``audits.score_intervals`` takes: layers, errors, residual figures and point scores."""
    a, b = (cut(x) for x in layers(spark, d))
    m = stage(spark, d, "measurements")
    agreement = correlate.agreement(m.where(F.col("src") == "A"), m.where(F.col("src") == "N"), "feat", "ent", "value", 30)
    tiers = agreement.select("feat", correlate.platform_tier(F.col("platform_rho")).alias("tier"))
    first = a.select("feat", "ent", F.col("z_t").alias("z1"), F.col("k_src").alias("n_sources"), audits.first_layer_error(F.col("k_src"), F.col("z_spread"), sources=2).alias("se1"))
    second = b.join(tiers, "feat", "left").select("feat", "ent", F.col("z_t").alias("z2"), audits.second_layer_error(F.col("k_src"), F.col("z_spread"), F.col("tier")).alias("se2"))
    both = first.join(second, ["feat", "ent"])
    slopes = combine.regression_slopes(both, "feat", "z1", "z2").select("feat", "beta")
    resid = both.join(slopes, "feat").withColumn("r", F.col("z2") - F.col("beta") * F.col("z1"))
    stats_ = resid.groupBy("feat").agg(F.median("r").alias("centre"), F.greatest(F.stddev_samp("r"), F.lit(1e-6)).alias("sd"))
    points = combine.core_score(a, b, "feat", "ent", "z_t", "k_src").select("feat", "ent", F.col("core_score").alias("point"))
    return (
        first.join(second, ["feat", "ent"], "left").join(slopes, "feat").join(stats_, "feat")
        .join(roles.entities(spark, d), "ent").join(points, ["feat", "ent"], "left")
    )


@query()
def g30_score_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Monte-Carlo intervals around the point score, top-k stability and win rates."""
    return audits.score_intervals(interval_rows(spark, d), "feat", "ent", "strat", 500, 10)


@query(sql("SELECT CAST(sum(h) AS BIGINT) AS hits, CAST(sum(p) AS BIGINT) AS positives, round(sum(h) / sum(p), 6) AS hit_rate FROM (SELECT feat, count(*) FILTER (WHERE k <= 20 AND dep) AS h, count(*) FILTER (WHERE dep) AS p FROM (SELECT *, row_number() OVER (PARTITION BY feat ORDER BY score DESC, ent) AS k FROM pn) GROUP BY feat)", "sc", **_PANEL))
def a36_hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).withColumn("k", ranks.order_rank(["feat"], "score", "ent"))
    return audits.hit_at_k(p, ["feat"], "k", "dep").select("hits", "positives", *r6("hit_rate"))


@query(sql("SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS n, count(*) FILTER (WHERE score >= threshold AND dep) AS n_pos FROM pn, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold) GROUP BY threshold", "sc", **_PANEL))
def g33_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """All thresholds in one pass of conditional counts."""
    cuts = [0.5, 0.6, 0.7, 0.8, 0.9]
    s = F.col("score")
    one = panel(spark, d).agg(*[F.count_if(s >= c).alias(f"n{i}") for i, c in enumerate(cuts)], *[F.count_if((s >= c) & F.col("dep")).alias(f"p{i}") for i, c in enumerate(cuts)])
    rows = F.array(*[F.struct(F.lit(c).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"p{i}").alias("n_pos")) for i, c in enumerate(cuts)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query(sql("SELECT feat, round(quantile_cont(score, 0.95) FILTER (WHERE NOT dep), 6) AS threshold FROM pn GROUP BY feat", "sc", **_PANEL))
def g21_threshold_at_false_positive_rate(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).groupBy("feat").agg(F.round(F.percentile(F.when(~F.col("dep"), F.col("score")), F.lit(0.95)), 6).alias("threshold"))


@query(sql("SELECT count(*) AS n_scored, count(*) FILTER (WHERE dep) AS n_labelled, count(*) FILTER (WHERE dep AND score >= 0.5) AS n_high, count(*) FILTER (WHERE dep AND score >= 0.5 AND expr > 16) AS n_expressed FROM pn", "sc", **_PANEL))
def g36_attrition_waterfall(spark: SparkSession, d: str) -> DataFrame:
    dep, high, lit = F.col("dep"), F.col("score") >= 0.5, F.col("expr") > 16
    return panel(spark, d).agg(F.count("*").alias("n_scored"), F.count_if(dep).alias("n_labelled"), F.count_if(dep & high).alias("n_high"), F.count_if(dep & high & lit).alias("n_expressed"))


@query(sql("SELECT feat, ent, bool_or(src = 'R' AND disc >= 0.1) AS positive, bool_or(src = 'R') AS measured FROM raw GROUP BY ALL", "raw"))
def g39_measured_and_positive(spark: SparkSession, d: str) -> DataFrame:
    """Unmeasured is not negative: both views side by side."""
    r = F.col("src") == "R"
    return roles.raw(spark, d).groupBy("feat", "ent").agg(F.bool_or(r & (F.col("disc") >= 0.1)).alias("positive"), F.bool_or(r).alias("measured"))


@query(sql("SELECT feat, count(*) FILTER (WHERE expr <= cut) AS n_bottom, round(max(cut), 6) AS cut FROM (SELECT feat, expr, max(CASE WHEN k <= round(n * 0.1) THEN expr END) OVER (PARTITION BY feat) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY feat ORDER BY expr) AS k, count(*) OVER (PARTITION BY feat) AS n FROM pn)) GROUP BY feat", "sc", **_PANEL))
def g40_bottom_share_with_ties(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("feat")
    p = panel(spark, d).withColumn("k", F.row_number().over(w.orderBy("expr"))).withColumn("n", F.count("*").over(w))
    p = p.withColumn("cut", F.max(F.when(F.col("k") <= F.round(F.col("n") * 0.1), F.col("expr"))).over(w))
    return p.groupBy("feat").agg(F.count_if(F.col("expr") <= F.col("cut")).alias("n_bottom"), F.round(F.max("cut"), 6).alias("cut"))


@query(sql("SELECT round(avg(m), 6) AS per_feature_mean, round(sum(p) / sum(n), 6) AS pooled_ratio FROM (SELECT feat, avg(CAST(dep AS DOUBLE)) AS m, count(*) FILTER (WHERE dep) AS p, count(*) AS n FROM pn GROUP BY feat)", "sc", **_PANEL))
def g46_two_estimands(spark: SparkSession, d: str) -> DataFrame:
    g = panel(spark, d).groupBy("feat").agg(F.avg(F.col("dep").cast("double")).alias("m"), F.count_if("dep").alias("p"), F.count("*").alias("n"))
    return g.agg(F.round(F.avg("m"), 6).alias("per_feature_mean"), F.round(F.sum("p") / F.sum("n"), 6).alias("pooled_ratio"))


_TOP20 = {
    "ta": "SELECT feat, ent FROM (SELECT feat, ent, row_number() OVER (PARTITION BY feat ORDER BY score DESC, ent) AS k FROM pn) WHERE k <= 20",
    "tb": "SELECT feat, ent FROM (SELECT feat, ent, row_number() OVER (PARTITION BY feat ORDER BY expr DESC, ent) AS k FROM pn) WHERE k <= 20",
}


@query(sql("SELECT coalesce(ta.feat, tb.feat) AS feat, count(*) FILTER (WHERE tb.ent IS NULL) AS displaced, count(*) FILTER (WHERE ta.ent IS NOT NULL AND tb.ent IS NOT NULL) AS kept FROM ta FULL JOIN tb ON ta.feat = tb.feat AND ta.ent = tb.ent GROUP BY 1", "sc", **_PANEL, **_TOP20))
def g47_top_k_displacement(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    top = lambda c, flag: p.withColumn("k", ranks.order_rank(["feat"], c, "ent")).where(F.col("k") <= 20).select("feat", "ent", F.lit(True).alias(flag))
    both = top("score", "a").join(top("expr", "b"), ["feat", "ent"], "full_outer")
    return both.groupBy("feat").agg(F.count_if(F.col("b").isNull()).alias("displaced"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"))


@query(sql("SELECT strat, round(a / sum(a) OVER (), 6) AS share_all, round(b / sum(b) OVER (), 6) AS share_top FROM (SELECT strat, count(*) AS a, count(*) FILTER (WHERE score >= 0.8) AS b FROM pn GROUP BY strat)", "sc", **_PANEL))
def g49_composition_shift(spark: SparkSession, d: str) -> DataFrame:
    g = panel(spark, d).groupBy("strat").agg(F.count("*").alias("a"), F.count_if(F.col("score") >= 0.8).alias("b"))
    t = g.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return g.join(F.broadcast(t)).select("strat", F.round(F.col("a") / F.col("ta"), 6).alias("share_all"), F.round(F.col("b") / F.col("tb"), 6).alias("share_top"))  # one row


@query(sql("SELECT CASE WHEN score < 0.25 THEN 0 WHEN score < 0.5 THEN 1 WHEN score < 0.75 THEN 2 ELSE 3 END AS bin, count(*) AS n FROM pn GROUP BY 1", "sc", **_PANEL))
def g51_binned_counts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    return panel(spark, d).groupBy(F.when(s < 0.25, 0).when(s < 0.5, 1).when(s < 0.75, 2).otherwise(3).alias("bin")).agg(F.count("*").alias("n"))


@query(sql("SELECT CAST(p_mutation >= 0.5 AS INTEGER) + CAST(p_fusion >= 0.5 AS INTEGER) + CAST(has_cna_alteration AS INTEGER) AS n_channels, count(*) AS n FROM fl GROUP BY 1", "fl"))
def g52_channels_firing_together(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("p_mutation") >= 0.5).cast("int") + (F.col("p_fusion") >= 0.5).cast("int") + F.col("has_cna_alteration").cast("int")
    return flags(spark, d).groupBy(n.alias("n_channels")).agg(F.count("*").alias("n"))


@query(sql("SELECT src, feat, round(stddev_samp(value) / nullif(max(mad) * 1.4826, 0), 6) AS ratio FROM (SELECT *, median(abs(value - med)) OVER (PARTITION BY src, feat) AS mad FROM (SELECT src, feat, value, median(value) OVER (PARTITION BY src, feat) AS med FROM m)) GROUP BY src, feat", "m"))
def g55_sd_to_mad(spark: SparkSession, d: str) -> DataFrame:
    m = stage(spark, d, "measurements")
    mad = aggregates.group_mad(m, ["src", "feat"], "value").select("src", "feat", "mad_scaled")
    sd = m.groupBy("src", "feat").agg(F.stddev_samp("value").alias("sd"))
    return sd.join(mad, ["src", "feat"]).select("src", "feat", F.round(F.col("sd") / F.nullif(F.col("mad_scaled"), F.lit(0.0)), 6).alias("ratio"))


@query(sql("SELECT CASE WHEN regexp_matches(lower(approved_name), 'kinase') THEN 'kinase' WHEN regexp_matches(lower(approved_name), 'receptor') THEN 'receptor' ELSE 'other' END AS family, count(*) AS n, round(avg(CAST(prev_symbols IS NOT NULL AS DOUBLE)), 6) AS renamed_share FROM gene_lookup GROUP BY 1"))
def g22_family_shares(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower("approved_name")
    family = F.when(name.rlike("kinase"), "kinase").when(name.rlike("receptor"), "receptor").otherwise("other")
    return table(spark, d, "gene_lookup").groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("prev_symbols").isNotNull().cast("double")), 6).alias("renamed_share"))


_GRID = ((0.9, 0.3, 10.0), (0.9, 0.3, 25.0), (0.7, 0.5, 25.0))


def _chain(i: int, upper: float, lower: float, prior: float) -> dict[str, str]:
    """The three-regime score's expressions for one parameter set, without the held-out source."""
    out = {}
    for k, v in _METHOD.items():
        if k == "fl_":
            continue
        t = v.replace("det >= 0.7", f"det >= {upper}").replace("det >= 0.55", f"det >= {lower}").replace("(nb + 25.0)", f"(nb + {prior})").replace("FROM m ", "FROM mb m ").replace("JOIN nb ", f"JOIN nb{i} ")
        for g in ("g1", "g2", "g3"):
            t = t.replace(f"FROM {g}", f"FROM {g}_{i}")
        out[f"nb{i}" if k == "nb" else f"{k}_{i}"] = t
    out[f"zt{i}"] = f"SELECT feat, ent, round(sum(z) / sqrt(count(*)), 9) AS x FROM g4_{i} WHERE z IS NOT NULL GROUP BY feat, ent"
    out[f"rk{i}"] = f"SELECT feat, rank() OVER (PARTITION BY feat ORDER BY x) + (count(*) OVER (PARTITION BY feat, x) - 1) / 2.0 AS i, rank() OVER (PARTITION BY feat ORDER BY y) + (count(*) OVER (PARTITION BY feat, y) - 1) / 2.0 AS j FROM zt{i} JOIN (SELECT feat, ent, round(z, 9) AS y FROM z WHERE src = 'N' AND z IS NOT NULL) USING (feat, ent)"
    out[f"rh{i}"] = f"SELECT {upper} AS upper_cut, {lower} AS lower_cut, {prior} AS n0, avg(rho) AS mean_rho, stddev_samp(rho) / sqrt(count(*)) AS se, count(*) AS n FROM (SELECT feat, corr(i, j) AS rho FROM rk{i} GROUP BY feat HAVING count(*) >= 30 AND count(DISTINCT i) > 1 AND count(DISTINCT j) > 1)"
    return out


_CALIBRATION = {"fl_": _METHOD["fl_"], "mb": "SELECT * FROM m WHERE src <> 'N'", **_chain(0, *_GRID[0]), **_chain(1, *_GRID[1]), **_chain(2, *_GRID[2]), "al": "SELECT * FROM rh0 UNION ALL SELECT * FROM rh1 UNION ALL SELECT * FROM rh2",
                "bs": "SELECT max(mean_rho) AS top, max_by(se, mean_rho) AS top_se FROM al"}


@query(sql("SELECT CAST(upper_cut AS DOUBLE) AS upper_cut, CAST(lower_cut AS DOUBLE) AS lower_cut, CAST(n0 AS DOUBLE) AS n0, round(mean_rho, 6) AS mean_rho, round(se, 6) AS se, n, (upper_cut, lower_cut, n0) = (SELECT max((upper_cut, lower_cut, n0)) FROM al, bs WHERE mean_rho >= top - top_se) AS chosen FROM al", "m", "z", **_CALIBRATION))
def c04_calibration_grid(spark: SparkSession, d: str) -> DataFrame:
    """Held-out agreement of the three-regime score for each parameter set; within one standard error of the best the
    strictest is chosen."""
    m = stage(spark, d, "measurements")
    floors = aggregates.exact_quantiles(m, ["src"], "value", [0.4]).select("src", F.col("q0").alias("flr"))
    base = m.join(floors, "src")
    held = zscores.robust_z(m.where(F.col("src") == "N"), ["src", "strat", "feat"], "value", "zr").select("feat", "ent", "zr")
    out = None
    for upper, lower, prior in _GRID:
        z = zscores.method_z(base.where(F.col("src") != "N"), "src", "strat", "feat", "ent", "value", "flr", zscores.Regimes(upper, lower, prior))
        both = combine.stouffer_simple(z, ["feat", "ent"], "z").join(held, ["feat", "ent"])
        both = both.withColumns({"z_t": F.round("z_t", 9), "zr": F.round("zr", 9)})  # equal values are ties whatever the last bit
        rho = correlate.spearman_by(both, ["feat"], "z_t", "zr", 30)
        one = rho.agg(F.avg("rho").alias("mean_rho"), (F.stddev_samp("rho") / F.sqrt(F.count("*").cast("double"))).alias("se"), F.count("*").alias("n"))
        one = one.select(F.lit(upper).alias("upper_cut"), F.lit(lower).alias("lower_cut"), F.lit(prior).alias("n0"), "mean_rho", "se", "n")
        out = one if out is None else out.unionByName(one)
    best = out.agg(F.max_by(F.struct("mean_rho", "se"), "mean_rho").alias("b"))
    joined = out.join(F.broadcast(best))  # one row
    near = F.col("mean_rho") >= F.col("b.mean_rho") - F.col("b.se")
    strict = F.struct("upper_cut", "lower_cut", "n0")
    pick = joined.where(near).agg(F.max(strict).alias("chosen"))
    return joined.join(F.broadcast(pick)).select("upper_cut", "lower_cut", "n0", *r6("mean_rho", "se"), "n", (strict == F.col("chosen")).alias("chosen"))


# ------------------------------------------------------------------ clusters


@query(sql("""SELECT round((cc - rr * kk / (t * (t - 1) / 2)) / ((rr + kk) / 2 - rr * kk / (t * (t - 1) / 2)), 6) AS ari, round((hr + hk - hj) / ((hr + hk) / 2), 6) AS nmi FROM
(SELECT sum(n * (n - 1) / 2.0) AS cc, -sum(n / t * ln(n / t)) AS hj, max(t) AS t FROM ct, tt),
(SELECT sum(n * (n - 1) / 2.0) AS rr, -sum(n / t * ln(n / t)) AS hr FROM (SELECT a, sum(n) AS n FROM ct GROUP BY a), tt), (SELECT sum(n * (n - 1) / 2.0) AS kk, -sum(n / t * ln(n / t)) AS hk FROM (SELECT b, sum(n) AS n FROM ct GROUP BY b), tt)""",
           ct="SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY ALL", tt="SELECT sum(n)::DOUBLE AS t FROM ct"))
def g27_cluster_agreement(spark: SparkSession, d: str) -> DataFrame:
    return clusters.agreement(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus").select(*r6("ari", "nmi"))


@query()
def g25_average_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Average-linkage clusters of the embedded entities themselves."""
    return clusters.link_entities(table(spark, d, "embeddings"), "vec_id", "embedding", 4)


@query()
def g26_graph_communities(spark: SparkSession, d: str) -> DataFrame:
    """Label propagation on the graph of customers and the brands they order most, weighted by orders."""
    r = roles.raw(spark, d).groupBy("ent", "feat").agg(F.count("*").cast("double").alias("w"))
    edges = r.select(F.concat(F.lit("e"), F.col("ent").cast("string")).alias("a"), F.col("feat").alias("b"), "w")
    return clusters.propagate_labels(edges, 5)


@query()
def g29_kmeans_on_components(spark: SparkSession, d: str) -> DataFrame:
    return clusters.kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", 10, 8)


@query(sql("SELECT round(corr(a, b), 6) AS r_ab, round(corr(a, c), 6) AS r_ac, count(*) AS n FROM wide", "m", **_PAIRED))
def g50_source_independence(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).agg(F.round(correlation("a", "b"), 6).alias("r_ab"), F.round(correlation("a", "c"), 6).alias("r_ac"), F.count("*").alias("n"))


# ------------------------------------------------------------------ thresholds and alternatives


_LEAST = thresholds.least_rows(0.9)
_FLOOR = thresholds.critical_rho(_LEAST)


def _pair_rho(right: str) -> str:
    """Rank correlations of source A's features with themselves and with the next one of the ring, in another source."""
    rows = f"""SELECT 'matched' AS kind, a.feat, a.v AS x, b.v AS y FROM av a JOIN av b USING (feat, ent) WHERE a.src = 'A' AND b.src = '{right}'
  UNION ALL SELECT 'null', b.feat, a.v, b.v FROM av a JOIN rg ON rg.feat = a.feat AND rg.nx <> a.feat JOIN av b ON b.feat = rg.nx AND b.ent = a.ent WHERE a.src = 'A' AND b.src = '{right}'"""
    return f"""SELECT kind, corr(i, j) AS rho FROM (SELECT kind, feat, x, y, rank() OVER (PARTITION BY kind, feat ORDER BY x) + (count(*) OVER (PARTITION BY kind, feat, x) - 1) / 2.0 AS i,
  rank() OVER (PARTITION BY kind, feat ORDER BY y) + (count(*) OVER (PARTITION BY kind, feat, y) - 1) / 2.0 AS j FROM ({rows})) GROUP BY kind, feat HAVING count(*) >= {_LEAST} AND count(DISTINCT x) > 1 AND count(DISTINCT y) > 1"""


_DERIVED = {
    "av": "SELECT src, feat, ent, avg(value) AS v FROM m GROUP BY ALL",
    "rg": f"SELECT feat, coalesce(lead(feat) OVER w, first_value(feat) OVER w) AS nx FROM (SELECT DISTINCT feat FROM av WHERE src = 'A') WINDOW w AS (ORDER BY {md5_number(0, 'feat')}, feat)",
    "rx": _pair_rho("N"), "ri": _pair_rho("A"),
    "bd": "SELECT quantile_cont(rho, 0.95) FILTER (WHERE kind = 'null') AS q, median(rho) FILTER (WHERE kind = 'matched') AS md, count(*) FILTER (WHERE kind = 'null') AS n_null, count(*) FILTER (WHERE kind = 'matched') AS n_matched FROM rx",
    "is_": f"SELECT CASE WHEN count(*) >= 30 THEN least(greatest(quantile_cont(rho, 0.95), 0), 0.95) ELSE {_FLOOR!r} END AS isoform_corr FROM ri WHERE kind = 'null'",
    "lo": f"SELECT n_null, n_matched, CASE WHEN n_matched >= 10 AND n_null >= 30 THEN least(greatest(q, 0), 0.9) ELSE {_FLOOR!r} END AS agree_low, CASE WHEN n_matched >= 10 AND n_null >= 30 THEN least(greatest(least(greatest(q, 0), 0.9) + 0.05, md), 0.95) ELSE {min(_FLOOR + max(0.05, _FLOOR), 0.9)!r} END AS agree_high FROM bd",
    "cr": "SELECT * FROM (VALUES " + ", ".join(f"({n}, {thresholds.critical_rho(n)!r}::DOUBLE)" for n in range(4, 301)) + ") t(n, r)",
}


@query(sql(f"SELECT round(isoform_corr, 6) AS isoform_corr, round(agree_low, 6) AS agree_low, round(agree_high, 6) AS agree_high, n_null, n_matched, coalesce((SELECT min(n) FROM cr WHERE r <= greatest(abs(agree_low), 1e-3)), 300) AS min_shared, {_LEAST} AS seed_overlap, round({thresholds.critical_rho(44)!r}, 6) AS critical_rho_44 FROM is_, lo", "m", **_DERIVED))
def c08_agreement_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of isoform and platform agreement from null and matched correlations, with the rows that they need (M14)."""
    m = stage(spark, d, "measurements")
    least = thresholds.least_rows(0.9)
    first, second = m.where(F.col("src") == "A"), m.where(F.col("src") == "N")
    rho = thresholds.paired_correlations(first, second, "feat", "ent", "value", least)
    iso = thresholds.paired_correlations(first, first, "feat", "ent", "value", least)
    got = thresholds.derived(rho, iso, least)
    return got.select(
        *r6("isoform_corr", "agree_low", "agree_high"), "n_null", "n_matched", "min_shared", F.lit(least).alias("seed_overlap"), F.round(F.lit(thresholds.critical_rho(44)), 6).alias("critical_rho_44")
    )


_ABLE = {"ab": "SELECT ent FROM sc WHERE feat IN ('Brand#11', 'Brand#22', 'Brand#7') AND score IS NOT NULL GROUP BY ent HAVING count(DISTINCT feat) = 3"}


@query(sql("SELECT query AS ent, neighbour, rank, round(s, 6) AS similarity FROM (SELECT query, neighbour, s, row_number() OVER (PARTITION BY query ORDER BY round(s, 12) DESC, neighbour) AS rank FROM pr WHERE neighbour IN (SELECT ent FROM ab)) WHERE rank <= 5", "sc", **_PAIRS, **_ABLE))
def q12_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of all that have a score for every feature of the query."""
    e = embedded(spark, d)
    got = serving.nearest_able(e, asked(e), "vec_id", "v", stage(spark, d, "scores"), roles.FEATURES, "feat", "ent", "score", 5)
    return got.select("ent", "neighbour", "rank", *r6("similarity"))
