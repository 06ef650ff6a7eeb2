"""Queries of the measuring, scoring and evidence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions.stats import correlation
from gneiss.functions import stats
from gneiss.operators import aggregates, combine, correlate, evidence, ranks, reshape, zscores
from gneiss.plans import roles
from gneiss.plans.registry import Registry
from gneiss.plans.roles import sql
from gneiss.plans.stage import stage
from gneiss.session import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# ------------------------------------------------------------------ aggregates


@query(sql("SELECT feat, ent, src, strat, round(value, 6) AS value, n_rep FROM m", "m"))
def a01_replicate_median(spark: SparkSession, d: str) -> DataFrame:
    return roles.measurements(spark, d).select("feat", "ent", "src", "strat", *r6("value"), "n_rep")


@query(sql("SELECT feat, round(avg(val), 6) AS mean, count(*) AS n_rows, count(val) AS n_values, count(DISTINCT ent) AS n_ent, bool_or(val > 16) AS any_high, max(val > 16) AS max_high, sum(CAST(val > 16 AS INTEGER)) AS n_high FROM raw GROUP BY feat", "raw"))
def a03_group_mean_counts(spark: SparkSession, d: str) -> DataFrame:
    high = F.col("val") > 16
    return roles.raw(spark, d).groupBy("feat").agg(
        F.round(F.avg("val"), 6).alias("mean"), F.count("*").alias("n_rows"), F.count("val").alias("n_values"), F.count_distinct("ent").alias("n_ent"),
        F.bool_or(high).alias("any_high"), F.max(high).alias("max_high"), F.sum(high.cast("int")).alias("n_high"),
    )


@query(sql("SELECT feat, strat, round(stddev_samp(val), 6) AS sd_samp, round(stddev_pop(val), 6) AS sd_pop FROM raw GROUP BY feat, strat", "raw"))
def a06_sample_and_population_sd(spark: SparkSession, d: str) -> DataFrame:
    return roles.raw(spark, d).groupBy("feat", "strat").agg(F.round(F.stddev_samp("val"), 6).alias("sd_samp"), F.round(F.stddev_pop("val"), 6).alias("sd_pop"))


@query(sql("SELECT src, strat, feat, round(max(med), 6) AS med, round(median(abs(value - med)), 6) AS mad, round(median(abs(value - med)) * 1.4826, 6) AS mad_scaled FROM d1 GROUP BY ALL", "d1"))
def a07_mad(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.group_mad(stage(spark, d, "measurements"), ["src", "strat", "feat"], "value").select("src", "strat", "feat", *r6("med", "mad", "mad_scaled"))


@query(sql("SELECT feat, round(quantile_cont(val, 0.05), 6) AS p05, round(quantile_cont(val, 0.25), 6) AS p25, round(quantile_cont(val, 0.5), 6) AS p50, round(quantile_cont(val, 0.75), 6) AS p75, round(quantile_cont(val, 0.95), 6) AS p95, round(quantile_cont(val, 0.75) - quantile_cont(val, 0.25), 6) AS iqr FROM raw GROUP BY feat", "raw"))
def a09_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.spread(roles.raw(spark, d), ["feat"], "val").select("feat", *r6("p05", "p25", "p50", "p75", "p95", "iqr"))


@query(sql("SELECT feat, round(avg(val), 6) AS mean, round(stddev_samp(val), 6) AS std, round(CASE WHEN avg(val) > 0 THEN stddev_samp(val) / avg(val) END, 6) AS cv FROM raw GROUP BY feat", "raw"))
def a10_coefficient_of_variation(spark: SparkSession, d: str) -> DataFrame:
    return roles.raw(spark, d).groupBy("feat").agg(*aggregates.variation("val")).select("feat", *r6("mean", "std", "cv"))


_PAIRED = {"wide": "SELECT feat, ent, max(CASE WHEN src = 'A' THEN value END) AS a, max(CASE WHEN src = 'N' THEN value END) AS b, max(CASE WHEN src = 'R' THEN value END) AS c FROM m GROUP BY ALL"}


def paired(spark: SparkSession, d: str) -> DataFrame:
    wide = reshape.pivot_first(stage(spark, d, "measurements"), ["feat", "ent"], "src", ["A", "N", "R"], "value")
    return wide.select("feat", "ent", F.col("A").alias("a"), F.col("N").alias("b"), F.col("R").alias("c"))


@query(sql("SELECT feat, count(*) AS n, round(corr(coalesce(a, 0), coalesce(b, 0)), 6) AS r FROM wide GROUP BY feat", "m", **_PAIRED))
def a11_pearson_by_group(spark: SparkSession, d: str) -> DataFrame:
    return correlate.pearson_by(paired(spark, d), ["feat"], "a", "b").select("feat", "n", *r6("r"))


_RANKED = _PAIRED | {
    "bo": "SELECT * FROM wide WHERE a IS NOT NULL AND b IS NOT NULL",
    "rk": "SELECT feat, rank() OVER (PARTITION BY feat ORDER BY a) + (count(*) OVER (PARTITION BY feat, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY feat ORDER BY b) + (count(*) OVER (PARTITION BY feat, b) - 1) / 2.0 AS rb FROM bo",
}


@query(sql("SELECT feat, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM rk GROUP BY feat HAVING count(*) >= 30", "m", **_RANKED))
def a12_spearman_by_group(spark: SparkSession, d: str) -> DataFrame:
    return correlate.spearman_by(paired(spark, d), ["feat"], "a", "b", 30).select("feat", "n", *r6("rho"))


@query(sql("SELECT round(corr(a, b), 6) AS r, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_pairs FROM wide", "m", **_PAIRED))
def a13_whole_table_correlation(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).agg(F.round(correlation("a", "b"), 6).alias("r"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_pairs"))


@query(sql("SELECT src, count(*) FILTER (WHERE val > 15) AS n_high, count(DISTINCT ent) AS n_ent FROM raw GROUP BY src", "raw"))
def a14_filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    return roles.raw(spark, d).groupBy("src").agg(F.count_if(F.col("val") > 15).alias("n_high"), F.count_distinct("ent").alias("n_ent"))


@query(sql("SELECT src, strat, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM raw GROUP BY src, strat", "raw"))
def a15_percent_of_total(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.share_of_total(roles.raw(spark, d), ["src", "strat"]).select("src", "strat", "n", *r6("pct"))


@query(sql("SELECT sub, feat, count(*) AS n FROM raw GROUP BY ALL HAVING count(*) >= 100", "raw"))
def a16_having(spark: SparkSession, d: str) -> DataFrame:
    return roles.raw(spark, d).groupBy("sub", "feat").agg(F.count("*").alias("n")).where(F.col("n") >= 100)


@query(sql("SELECT feat, ent, k_src, round(z_t, 6) AS z_t FROM st", "st"))
def a17_stouffer_by_coverage(spark: SparkSession, d: str) -> DataFrame:
    return combine.stouffer_by_coverage(roles.z_of(stage(spark, d, "measurements")), "feat", "ent", "src", "z", 3).select("feat", "ent", "k_src", *r6("z_t"))


_TWO_LEVEL = {
    "mm": "SELECT src, platform, strat, feat, ent, median(val) AS value, count(*) AS n_rep FROM raw GROUP BY ALL",
    "e1": "SELECT *, count(value) OVER (PARTITION BY src, platform, strat, feat) AS n, median(value) OVER (PARTITION BY src, platform, strat, feat) AS med FROM mm",
    "e2": "SELECT *, median(abs(value - med)) OVER (PARTITION BY src, platform, strat, feat) AS mad FROM e1",
    "ez": "SELECT *, CASE WHEN n >= 5 THEN (value - med) / greatest(1.4826 * mad, 0.384) END AS z FROM e2",
    "inn": "SELECT feat, ent, src, sum(sqrt(n_rep) * z) / sqrt(sum(n_rep)) AS zs, count(DISTINCT platform) AS k FROM ez WHERE z IS NOT NULL GROUP BY ALL",
}


@query(sql("SELECT feat, ent, round(sum(zs) / sqrt(count(*)), 6) AS z_t, count(*) AS k_src, CAST(sum(k) AS BIGINT) AS k_methods FROM inn GROUP BY feat, ent", "raw", **_TWO_LEVEL))
def a18_stouffer_two_level(spark: SparkSession, d: str) -> DataFrame:
    m = aggregates.replicate_median(roles.raw(spark, d), ["src", "platform", "strat", "feat", "ent"], "val")
    z = zscores.robust_z(m, ["src", "platform", "strat", "feat"], "val")
    return combine.stouffer_two_level(z, "feat", "ent", "src", "platform", "z", "n_rep").select("feat", "ent", *r6("z_t"), "k_src", "k_methods")


_WIDE_Z = {"wz": "SELECT feat, ent, max(CASE WHEN src = 'A' THEN z END) AS a, max(CASE WHEN src = 'N' THEN z END) AS b, max(CASE WHEN src = 'R' THEN z END) AS c FROM z GROUP BY ALL"}


def wide_z(spark: SparkSession, d: str) -> DataFrame:
    wide = reshape.pivot_first(roles.z_of(stage(spark, d, "measurements")), ["feat", "ent"], "src", ["A", "N", "R"], "z")
    return wide.select("feat", "ent", F.col("A").alias("a"), F.col("N").alias("b"), F.col("R").alias("c"))


@query(sql("SELECT feat, ent, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (1.2 * a + 1.1 * b) / sqrt(1.2 * 1.2 + 1.1 * 1.1 + 2 * 1.2 * 1.1 * 0.373) END, 6) AS z FROM wz", "z", **_WIDE_Z))
def a19_stouffer_known_correlation(spark: SparkSession, d: str) -> DataFrame:
    z = combine.stouffer_pair(F.col("a"), F.col("b"), 0.373, 1.2, 1.1)
    return wide_z(spark, d).select("feat", "ent", F.round(z, 6).alias("z"))


@query(sql("""SELECT feat, ent, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / sqrt(nullif(CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER) + CAST(c IS NOT NULL AS INTEGER)
  + 2 * 0.3 * CAST(a IS NOT NULL AND b IS NOT NULL AS INTEGER) + 2 * 0.2 * CAST(a IS NOT NULL AND c IS NOT NULL AS INTEGER) + 2 * 0.1 * CAST(b IS NOT NULL AND c IS NOT NULL AS INTEGER), 0)), 6) AS z FROM wz""", "z", **_WIDE_Z))
def a20_stouffer_correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    z = combine.stouffer_correlated({k: F.col(k) for k in "abc"}, {("a", "b"): 0.3, ("a", "c"): 0.2, ("b", "c"): 0.1})
    return wide_z(spark, d).select("feat", "ent", F.round(z, 6).alias("z"))


@query(sql("SELECT feat, ent, round(sum(z) / sqrt(count(*)), 6) AS z_t, round(avg(z), 6) AS z_mean, round(max(z) - min(z), 6) AS z_spread, count(*) AS k_src FROM z WHERE z IS NOT NULL GROUP BY feat, ent", "z"))
def a21_stouffer_simple(spark: SparkSession, d: str) -> DataFrame:
    return combine.stouffer_simple(roles.z_of(stage(spark, d, "measurements")), ["feat", "ent"], "z").select("feat", "ent", *r6("z_t", "z_mean", "z_spread"), "k_src")


@query(sql("SELECT feat, ent, min(CASE WHEN n < 5 THEN 3 WHEN med < 15 THEN 1 ELSE 0 END) AS status, max(CASE WHEN n_rep > 1 THEN 1 ELSE 0 END) AS scale FROM d1 GROUP BY feat, ent", "d1"))
def a22_status_fold(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("src", "strat", "feat")
    m = stage(spark, d, "measurements").withColumn("n", F.count("value").over(w)).withColumn("med", F.median("value").over(w))
    status = F.when(F.col("n") < 5, 3).when(F.col("med") < 15, 1).otherwise(0)
    return m.groupBy("feat", "ent").agg(F.min(status).alias("status"), F.max(F.when(F.col("n_rep") > 1, 1).otherwise(0)).alias("scale"))


@query(sql("""SELECT sub, feat AS top, n AS n_top, tot AS n, round(n / tot, 6) AS fraction FROM (SELECT sub, feat, n, sum(n) OVER (PARTITION BY sub)::BIGINT AS tot, row_number() OVER (PARTITION BY sub ORDER BY n DESC, feat) AS k FROM cc) WHERE k = 1""", "raw", cc="SELECT sub, feat, count(*) AS n FROM raw GROUP BY ALL"))
def a23_most_common(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.most_common(roles.raw(spark, d), ["sub"], "feat").select("sub", "top", "n_top", "n", *r6("fraction"))


@query(sql("SELECT strat, feat AS label, count(*) AS n FROM raw GROUP BY ALL", "raw"))
def a24_distribution(spark: SparkSession, d: str) -> DataFrame:
    got = aggregates.distribution(roles.raw(spark, d), ["strat"], "feat")
    return got.select("strat", F.explode("distribution").alias("label", "n"))


@query(sql("SELECT feat, round(power(sum(n_rep), 2) / sum(n_rep * n_rep), 6) AS n_eff FROM m GROUP BY feat", "m"))
def a25_effective_size(spark: SparkSession, d: str) -> DataFrame:
    return stage(spark, d, "measurements").groupBy("feat").agg(F.round(aggregates.effective_size("n_rep"), 6).alias("n_eff"))


@query(sql("""SELECT round(power(sum(v), 2) / sum(v * v), 6) AS participation, round(sum(CASE WHEN k <= 10 THEN v END) / sum(v), 6) AS top10_share FROM (SELECT v, row_number() OVER (ORDER BY v DESC, feat) AS k FROM (SELECT feat, var_samp(value) AS v FROM m GROUP BY feat))""", "m"))
def a26_participation_ratio(spark: SparkSession, d: str) -> DataFrame:
    m = stage(spark, d, "measurements")
    v = m.groupBy("feat").agg(F.var_samp("value").alias("v"))
    top = reshape.top_variance(m, "feat", "value", 10).agg(F.sum("variance").alias("t"))
    both = v.agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).join(F.broadcast(top))  # one row each
    return both.select(F.round(F.col("s") ** 2 / F.col("q"), 6).alias("participation"), F.round(F.col("t") / F.col("s"), 6).alias("top10_share"))


@query(sql("SELECT feat, round(skewness(val), 5) AS skew, round(kurtosis_pop(val) + 3, 5) AS kurt, round((skewness(val) * skewness(val) + 1) / (kurtosis_pop(val) + 3), 5) AS bimodality FROM raw GROUP BY feat", "raw"))
def a27_shape(spark: SparkSession, d: str) -> DataFrame:
    skew, kurt = aggregates.adjusted_skewness("val"), aggregates.plain_kurtosis("val")
    return roles.raw(spark, d).groupBy("feat").agg(
        F.round(skew, 5).alias("skew"), F.round(kurt, 5).alias("kurt"), F.round((skew * skew + 1) / kurt, 5).alias("bimodality")
    )


@query(sql("""SELECT feat, n_in, n_out, round((ma - mb) / sqrt(((n_in - 1) * va + (n_out - 1) * vb) / (n_in + n_out - 2)), 6) AS d FROM (SELECT feat, count(*) FILTER (WHERE strat = 'ASIA') AS n_in, count(*) FILTER (WHERE strat <> 'ASIA') AS n_out,
  avg(val) FILTER (WHERE strat = 'ASIA') AS ma, avg(val) FILTER (WHERE strat <> 'ASIA') AS mb, var_samp(val) FILTER (WHERE strat = 'ASIA') AS va, var_samp(val) FILTER (WHERE strat <> 'ASIA') AS vb FROM raw GROUP BY feat)""", "raw"))
def a28_cohens_d(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.cohens_d(roles.raw(spark, d), ["feat"], F.col("strat") == "ASIA", "val").select("feat", "n_in", "n_out", *r6("d"))


@query(sql("SELECT feat, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS r FROM (SELECT feat, corr(val, qty) AS ab, corr(val, disc) AS ac, corr(qty, disc) AS bc FROM raw GROUP BY feat)", "raw"))
def a29_partial_correlation(spark: SparkSession, d: str) -> DataFrame:
    got = roles.raw(spark, d).groupBy("feat").agg(correlation("val", "qty").alias("ab"), correlation("val", "disc").alias("ac"), correlation("qty", "disc").alias("bc"))
    return got.select("feat", F.round(correlate.partial_correlation(F.col("ab"), F.col("ac"), F.col("bc")), 6).alias("r"))


@query(sql("SELECT sub, string_agg(DISTINCT feat, '; ' ORDER BY feat) AS feats FROM raw GROUP BY sub", "raw"))
def a30_joined_distinct(spark: SparkSession, d: str) -> DataFrame:
    return roles.raw(spark, d).groupBy("sub").agg(F.array_join(F.sort_array(F.collect_set("feat")), "; ").alias("feats"))


@query(sql("SELECT ent, feat, round(val, 6) AS val FROM (SELECT *, row_number() OVER (PARTITION BY ent ORDER BY ok, ln, feat, val) AS k FROM raw) WHERE k = 1", "raw"))
def a31_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return reshape.first_of_each(roles.raw(spark, d), ["ent"], [F.asc("ok"), F.asc("ln"), F.asc("feat"), F.asc("val")]).select("ent", "feat", *r6("val"))


_VARIANTS = {
    "pv": "SELECT feat, variant, ent, avg(val) AS v FROM raw GROUP BY ALL",
    "pp": "SELECT a.feat, a.variant AS p1, b.variant AS p2, a.v AS v1, b.v AS v2 FROM pv a JOIN pv b ON a.feat = b.feat AND a.ent = b.ent AND a.variant < b.variant",
    "pr2": "SELECT feat, p1, p2, rank() OVER (PARTITION BY feat, p1, p2 ORDER BY v1) + (count(*) OVER (PARTITION BY feat, p1, p2, v1) - 1) / 2.0 AS r1, rank() OVER (PARTITION BY feat, p1, p2 ORDER BY v2) + (count(*) OVER (PARTITION BY feat, p1, p2, v2) - 1) / 2.0 AS r2 FROM pp",
    "rho": "SELECT feat, p1, p2, corr(r1, r2) AS rho FROM pr2 GROUP BY ALL HAVING count(*) >= 8 AND count(DISTINCT r1) > 1 AND count(DISTINCT r2) > 1",
    "qc": "SELECT feat, n_variants, coalesce(n_pairs, 0) AS n_pairs, min_rho FROM (SELECT feat, count(DISTINCT variant) AS n_variants FROM raw GROUP BY feat) LEFT JOIN (SELECT feat, count(*) AS n_pairs, min(rho) AS min_rho FROM rho GROUP BY feat) USING (feat)",
}


@query(sql("SELECT feat, n_variants, n_pairs, round(min_rho, 6) AS min_rho FROM qc", "raw", **_VARIANTS))
def a34_least_pair_spearman(spark: SparkSession, d: str) -> DataFrame:
    return correlate.least_pair_rho(roles.raw(spark, d), "feat", "variant", "ent", "val", 8).select("feat", "n_variants", "n_pairs", *r6("min_rho"))


@query(sql("""SELECT feat, ent, round(CASE WHEN roll = 'max' THEN top ELSE mean END, 6) AS value, n_variants, roll AS rollup FROM (SELECT feat, ent, max(v) AS top, avg(v) AS mean FROM pv GROUP BY feat, ent)
JOIN (SELECT feat, n_variants, CASE WHEN n_variants = 1 THEN 'single' WHEN min_rho >= -0.7 THEN 'max' ELSE 'mean' END AS roll FROM qc) USING (feat)""", "raw", **_VARIANTS))
def a35_collapse_variants(spark: SparkSession, d: str) -> DataFrame:
    return correlate.collapse_variants(roles.raw(spark, d), "feat", "variant", "ent", "val", 8, -0.7).select("feat", "ent", *r6("value"), "n_variants", "rollup")


@query(sql("""SELECT feat, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_distinct, round(coalesce(sum(c) FILTER (WHERE c > 1), 0) / sum(c), 6) AS tie_mass, max(c) AS largest_block, arg_min(c, qty) AS floor_block, count(*) FILTER (WHERE c > 1) AS n_tie_blocks
FROM (SELECT feat, qty, count(*) AS c FROM raw GROUP BY ALL) GROUP BY feat""", "raw"))
def a37_tie_statistics(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.tie_statistics(roles.raw(spark, d), ["feat"], "qty").select("feat", "n", "n_distinct", *r6("tie_mass"), "largest_block", "floor_block", "n_tie_blocks")


@query(sql("SELECT feat, round(1 - count(DISTINCT qty) * 1.0 / count(qty), 6) AS tie_rate FROM raw GROUP BY feat", "raw"))
def a39_tie_rate(spark: SparkSession, d: str) -> DataFrame:
    return roles.raw(spark, d).groupBy("feat").agg(F.round(1 - F.count_distinct("qty") / F.count("qty"), 6).alias("tie_rate"))


# ------------------------------------------------------------------ windows


@query(sql("SELECT feat, ent, strat, CASE WHEN strat IS NOT NULL THEN row_number() OVER (PARTITION BY feat, strat ORDER BY score DESC NULLS LAST, ent) END AS stratum_rank FROM sc", "sc"))
def w01_stratum_rank(spark: SparkSession, d: str) -> DataFrame:
    return stage(spark, d, "scores").select("feat", "ent", "strat", ranks.order_rank(["feat", "strat"], "score", "ent").alias("stratum_rank"))


_RANKS = "rank() OVER (PARTITION BY feat ORDER BY qty) + (count(*) OVER (PARTITION BY feat, qty) - 1) / 2.0"


@query(sql(f"SELECT ok, ln, {_RANKS} AS avg_rank, round(({_RANKS}) / count(*) OVER (PARTITION BY feat), 9) AS pct, rank() OVER (PARTITION BY feat ORDER BY qty DESC) AS min_rank FROM raw", "raw"))
def w02_percentile_and_tie_ranks(spark: SparkSession, d: str) -> DataFrame:
    return roles.raw(spark, d).select(
        "ok", "ln", ranks.average_rank(["feat"], "qty").alias("avg_rank"), F.round(ranks.percentile_rank(["feat"], "qty"), 9).alias("pct"), ranks.min_rank(["feat"], "qty").alias("min_rank")
    )


@query(sql("SELECT feat, ent, score, row_number() OVER (PARTITION BY feat ORDER BY score DESC, ent) AS flat_rank FROM sc", "sc"))
def w06_flat_rank(spark: SparkSession, d: str) -> DataFrame:
    return stage(spark, d, "scores").select("feat", "ent", "score", ranks.order_rank(["feat"], "score", "ent").alias("flat_rank"))


@query(sql("""SELECT feat, ent, row_number() OVER (PARTITION BY feat ORDER BY p DESC, ent) AS driver_rank FROM (SELECT feat, ent, CASE WHEN NOT has_driver_alteration THEN -1.0 WHEN is_lof_alteration AND coalesce(gene_role, '') <> 'both' THEN round(1 - pct, 9) ELSE round(pct, 9) END AS p FROM pr WHERE core_score IS NOT NULL)""", "pr"))
def w07_driver_rank(spark: SparkSession, d: str) -> DataFrame:
    f = flags(spark, d).where(F.col("core_score").isNotNull()).withColumn("pct", ranks.percentile_rank(["feat"], "core_score"))
    loss = F.col("is_lof_alteration") & (F.coalesce("gene_role", F.lit("")) != "both")
    p = F.when(~F.col("has_driver_alteration"), -1.0).when(loss, F.round(1 - F.col("pct"), 9)).otherwise(F.round("pct", 9))
    return f.withColumn("p", p).select("feat", "ent", ranks.order_rank(["feat"], "p", "ent").alias("driver_rank"))


@query(sql(f"SELECT ok, ln, round({stats.sql_phi_inverse('s1')}, 6) AS vdw, round({stats.sql_phi_inverse('s2')}, 6) AS midrank FROM sh", "raw", sh=f"SELECT ok, ln, rank() OVER (PARTITION BY feat ORDER BY qty) / (count(*) OVER (PARTITION BY feat) + 1) AS s1, (({_RANKS}) - 0.5) / count(*) OVER (PARTITION BY feat) AS s2 FROM raw"))
def w08_normal_scores(spark: SparkSession, d: str) -> DataFrame:
    r = roles.raw(spark, d).select("ok", "ln", "feat", "qty")
    both = ranks.normal_scores(ranks.normal_scores(r, ["feat"], "qty", "vdw"), ["feat"], "qty", "midrank", "mid")
    return both.select("ok", "ln", *r6("vdw", "midrank"))


@query(sql(f"""SELECT ok, ln, CAST(least((row_number() OVER (PARTITION BY feat ORDER BY qty, id) - 1) * 10 // count(*) OVER (PARTITION BY feat), 9) AS INTEGER) AS ordinal_bin,
  CAST(least(floor((ceil({_RANKS}) - 1) * 10 / count(*) OVER (PARTITION BY feat)), 9) AS INTEGER) AS average_bin FROM rw""", "raw", rw="SELECT *, ok * 10 + ln AS id FROM raw"))
def w10_equal_count_bins(spark: SparkSession, d: str) -> DataFrame:
    r = roles.raw(spark, d).withColumn("id", F.col("ok") * 10 + F.col("ln"))
    return r.select(
        "ok", "ln", ranks.equal_count_bin(["feat"], "qty", "id").alias("ordinal_bin"), ranks.equal_count_bin(["feat"], "qty", "id", ties="average").alias("average_bin")
    )


@query(sql("SELECT src, strat, feat, ent, round(z, 6) AS z FROM z", "z"))
def w12_robust_z(spark: SparkSession, d: str) -> DataFrame:
    return roles.z_of(stage(spark, d, "measurements")).select("src", "strat", "feat", "ent", *r6("z"))


@query(sql("""SELECT src, strat, feat, ent, round(CASE WHEN n >= 5 THEN (value - med) / CASE WHEN abs(1.4826 * mad) > 1e-8 THEN 1.4826 * mad WHEN abs(sd) > 1e-8 THEN sd ELSE 1.0 END END, 6) AS z
FROM (SELECT *, stddev_pop(value) OVER (PARTITION BY src, strat, feat) AS sd FROM d2)""", "d2"))
def w13_robust_z_or_sd(spark: SparkSession, d: str) -> DataFrame:
    return zscores.robust_z_or_sd(stage(spark, d, "measurements"), ["src", "strat", "feat"], "value").select("src", "strat", "feat", "ent", *r6("z"))


@query(sql("SELECT src, feat, ent, round((value - avg(value) OVER (PARTITION BY src, feat)) / nullif(stddev_samp(value) OVER (PARTITION BY src, feat), 0), 6) AS z FROM m", "m"))
def w15_plain_z(spark: SparkSession, d: str) -> DataFrame:
    return zscores.plain_z(stage(spark, d, "measurements"), ["src", "feat"], "value").select("src", "feat", "ent", *r6("z"))


_METHOD = {
    "fl_": "SELECT src, quantile_cont(value, 0.4) AS flr FROM m GROUP BY src",
    "nb": "SELECT src, strat, count(DISTINCT ent) AS nb FROM m GROUP BY ALL",
    "g1": "SELECT m.*, flr, nb, median(value) OVER (PARTITION BY src, feat) AS med_g FROM m JOIN fl_ USING (src) JOIN nb USING (src, strat)",
    "g2": "SELECT *, median(abs(value - med_g)) OVER (PARTITION BY src, feat) * 1.4826 AS mad_g0, count(value) OVER w AS n, median(value) OVER w AS med, count(*) FILTER (WHERE value >= flr) OVER w AS nd FROM g1 WINDOW w AS (PARTITION BY src, strat, feat)",
    "g3": f"SELECT *, CASE WHEN mad_g0 > 1e-9 THEN mad_g0 ELSE 0.0 END AS mad_g, coalesce(median(abs(value - med)) OVER (PARTITION BY src, strat, feat) * 1.4826, 0.0) AS mad, nd / n AS det, nb / (nb + 25.0) AS w, ((rank() OVER (PARTITION BY src, strat, feat ORDER BY value) + (count(*) OVER (PARTITION BY src, strat, feat, value) - 1) / 2.0) - 0.5) / n AS shr FROM g2",
    "g4": f"SELECT src, strat, feat, ent, det, nb, CASE WHEN nb < 5 THEN 3 WHEN w >= 0.9 THEN 1 ELSE 2 END AS scale_source, CASE WHEN nb < 5 THEN NULL WHEN det >= 0.7 THEN (value - med) / greatest(sqrt(w * mad * mad + (1 - w) * mad_g * mad_g), 0.1 * mad_g, 0.384) WHEN det >= 0.55 THEN {stats.sql_phi_inverse('shr')} END AS z, CASE WHEN nb < 5 THEN 3 WHEN det >= 0.7 THEN 0 WHEN det >= 0.55 THEN 1 ELSE 2 END AS status FROM g3",
}


def method_scores(spark: SparkSession, d: str, stratify: bool = True) -> DataFrame:
    m = stage(spark, d, "measurements")
    floors = aggregates.exact_quantiles(m, ["src"], "value", [0.4]).select("src", F.col("q0").alias("flr"))
    return zscores.method_z(m.join(floors, "src"), "src", "strat" if stratify else None, "feat", "ent", "value", "flr", zscores.Regimes(0.7, 0.55, 25.0))


@query(sql("SELECT src, strat, feat, ent, round(det, 6) AS det_frac, round(z, 6) AS z, status, scale_source FROM g4", "m", **_METHOD))
def w16_method_z(spark: SparkSession, d: str) -> DataFrame:
    return method_scores(spark, d).select("src", "strat", "feat", "ent", *r6("det_frac", "z"), "status", "scale_source")


@query(sql("""SELECT event_type, user_id, round(z, 6) AS z, z <= -1.0 AS sensitive FROM (SELECT *, (v - med) / nullif(1.4826 * median(abs(v - med)) OVER (PARTITION BY event_type), 0) AS z FROM (SELECT *, median(v) OVER (PARTITION BY event_type) AS med FROM (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL)))"""))
def w17_sensitivity_label(spark: SparkSession, d: str) -> DataFrame:
    mean = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    z = zscores.robust_z(mean, ["event_type"], "v", floor=1e-12, min_peers=1)
    return z.select("event_type", "user_id", *r6("z"), (F.col("z") <= -1.0).alias("sensitive"))


_STD = {
    "h1": "SELECT *, count(*) OVER w AS n, median(z_t) OVER w AS med, median(z_t) OVER g AS med_g, greatest(coalesce(stddev_samp(z_t) OVER g, 1e-6), 1e-6) AS sd_g, stddev_samp(z_t) OVER w AS sd0 FROM st WINDOW w AS (PARTITION BY feat, k_src), g AS (PARTITION BY feat)",
    "h2": "SELECT *, greatest(coalesce(sd0, sd_g), 1e-6) AS sd, n / (n + 25.0) AS w FROM h1",
    "h3": "SELECT feat, ent, k_src, greatest(-5.0, least(5.0, (z_t - CASE WHEN n < 5 THEN w * med + (1 - w) * med_g ELSE med END) / CASE WHEN n < 5 THEN sqrt(w * sd * sd + (1 - w) * sd_g * sd_g) ELSE sd END)) AS std_z FROM h2",
}


@query(sql("SELECT feat, ent, k_src, round(std_z, 6) AS std_z FROM h3", "st", **_STD))
def w18_standardise_strata(spark: SparkSession, d: str) -> DataFrame:
    return zscores.standardise(roles.combined_of(stage(spark, d, "measurements"), roles.entities(spark, d)), "feat", "k_src", "z_t", "std_z").select("feat", "ent", "k_src", *r6("std_z"))


@query(sql("""SELECT feat, ent, round(greatest(-5.0, least(5.0, (z_t - median(z_t) OVER (PARTITION BY feat)) / sqrt(w * power(greatest(stddev_samp(z_t) OVER (PARTITION BY feat), 1e-6), 2) + (1 - w) * sda * sda))), 6) AS z
FROM (SELECT *, count(*) OVER (PARTITION BY feat) / (count(*) OVER (PARTITION BY feat) + 25.0) AS w, (SELECT stddev_samp(z_t) FROM st) AS sda FROM st)""", "st"))
def w19_shrunken_sd(spark: SparkSession, d: str) -> DataFrame:
    return zscores.shrunken_z(roles.combined_of(stage(spark, d, "measurements"), roles.entities(spark, d)), "feat", "z_t", "z").select("feat", "ent", *r6("z"))


@query(sql(f"""SELECT ok, ln, round(abs(p1 - p2), 9) AS shift FROM (SELECT ok, ln, src, ({_RANKS}) / count(*) OVER (PARTITION BY feat) AS p1, (rank() OVER (PARTITION BY feat, src ORDER BY qty) + (count(*) OVER (PARTITION BY feat, src, qty) - 1) / 2.0) / count(*) OVER (PARTITION BY feat, src) AS p2 FROM raw)""", "raw"))
def w21_percentile_shift(spark: SparkSession, d: str) -> DataFrame:
    r = roles.raw(spark, d)
    both = r.withColumn("p1", ranks.percentile_rank(["feat"], "qty")).withColumn("p2", ranks.percentile_rank(["feat", "src"], "qty"))
    return both.select("ok", "ln", F.round(F.abs(F.col("p1") - F.col("p2")), 9).alias("shift"))


@query(sql("""SELECT feat, qty AS score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, round(sum(p) OVER w / sum(p) OVER (PARTITION BY feat), 6) AS tpr, round(sum(n) OVER w / sum(n) OVER (PARTITION BY feat), 6) AS fpr
FROM (SELECT feat, qty, count(*) FILTER (WHERE val > 15.5) AS p, count(*) FILTER (WHERE val <= 15.5) AS n FROM raw GROUP BY ALL) WINDOW w AS (PARTITION BY feat ORDER BY qty DESC ROWS UNBOUNDED PRECEDING)""", "raw"))
def w22_roc_steps(spark: SparkSession, d: str) -> DataFrame:
    r = roles.raw(spark, d).withColumn("pos", F.col("val") > 15.5)
    return ranks.roc_steps(r, ["feat"], "qty", "pos").select("feat", F.col("qty").alias("score"), "tp", "fp", *r6("tpr", "fpr"))


# ------------------------------------------------------------------ scalar functions


@query(sql(f"SELECT ok, ln, round({stats.sql_phi('x')}, 9) AS phi, round({stats.sql_phi_inverse('p')}, 9) AS quantile, round({stats.sql_hill('qty', 20, 2)}, 9) AS hill, round({stats.sql_noisy_or('disc', 'tax')}, 9) AS noisy_or, round(log2(greatest(x, 0.0) + 1), 9) AS log2p1 FROM (SELECT *, (qty - 25) / 5 AS x, (qty + 1) / 60 AS p FROM raw)", "raw"))
def m01_scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    r = roles.raw(spark, d).withColumn("x", (F.col("qty") - 25) / 5).withColumn("p", (F.col("qty") + 1) / 60)
    r = stats.with_phi_inverse(r, "p", "quantile")
    return r.select(
        "ok", "ln", F.round(stats.phi("x"), 9).alias("phi"), F.round("quantile", 9).alias("quantile"), F.round(stats.hill("qty", 20, 2), 9).alias("hill"),
        F.round(stats.noisy_or("disc", "tax"), 9).alias("noisy_or"), F.round(stats.log2p1(F.col("x")), 9).alias("log2p1"),
    )


@query(sql("SELECT feat, ent, round(CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN NULL ELSE least(a, b, c) END, 6) AS low, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN NULL WHEN a <= b AND a <= c THEN 'a' WHEN b <= c THEN 'b' ELSE 'c' END AS which, coalesce(abs(a) > 1 AND abs(b) > 1 AND sign(a) <> sign(b), false) AS opposed FROM wz", "z", **_WIDE_Z))
def m09_strict_min_and_signs(spark: SparkSession, d: str) -> DataFrame:
    """Row-wise minimum, its column and opposed signs, of every feature."""
    w = wide_z(spark, d)
    cols = {k: F.col(k) for k in "abc"}
    return w.select("feat", "ent", F.round(stats.strict_min(list(cols.values())), 6).alias("low"), stats.argmin_name(cols, "abc").alias("which"), stats.signs_disagree(F.col("a"), F.col("b")).alias("opposed"))


_GEO = {
    "gv": "SELECT method, log2_value AS v FROM geo_values WHERE log2_value IS NOT NULL AND NOT isnan(log2_value)",
    "ga": "SELECT method, count(*) AS n, min(v) AS lo, median(v) AS med, quantile_cont(v, 0.99) AS p99, max(v) AS hi FROM gv GROUP BY method",
}


@query(sql("""SELECT method, CASE WHEN n = 0 THEN 'unknown' WHEN lo >= -10 AND p99 < 25 AND hi <= 50 THEN 'log2' ELSE 'linear' END AS scale_v1,
CASE WHEN n < 50 THEN 'unknown' WHEN lo < -0.5 THEN 'log' WHEN p99 > 100 OR (med > 0 AND p99 / greatest(med, 1e-9) > 50) THEN 'linear' WHEN p99 < 25 THEN 'log' ELSE 'linear' END AS scale_v2, round(p99, 6) AS p99 FROM ga""", **_GEO))
def m06_scale_detection(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("log2_value")
    rows = table(spark, d, "geo_values").where(v.isNotNull() & ~F.isnan(v))
    ends = rows.groupBy("method").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    got = aggregates.exact_quantiles(rows, ["method"], "log2_value", [0.5, 0.99]).join(ends, "method")
    got = got.withColumnsRenamed({"q0": "med", "q1": "p99"})
    v1 = F.when(F.col("n") == 0, "unknown").when((F.col("lo") >= -10) & (F.col("p99") < 25) & (F.col("hi") <= 50), "log2").otherwise("linear")
    steep = (F.col("med") > 0) & (F.col("p99") / F.greatest("med", F.lit(1e-9)) > 50)
    v2 = (
        F.when(F.col("n") < 50, "unknown").when(F.col("lo") < -0.5, "log").when((F.col("p99") > 100) | steep, "linear").when(F.col("p99") < 25, "log").otherwise("linear")
    )
    return got.select("method", v1.alias("scale_v1"), v2.alias("scale_v2"), *r6("p99"))


@query(sql("SELECT src, round(quantile_cont(value, 0.1), 6) AS floor FROM m GROUP BY src", "m"))
def m08_detection_floor(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.exact_quantiles(stage(spark, d, "measurements"), ["src"], "value", [0.1]).select("src", F.round("q0", 6).alias("floor"))


@query(sql("SELECT feat, n_shared, round(platform_rho, 6) AS platform_rho, round(CASE WHEN isnan(platform_rho) THEN 1.0 ELSE least(greatest((platform_rho + 0.1) / 0.2, 0.0), 1.0) END, 6) AS confidence, CASE WHEN platform_rho >= 0.5 THEN 'consistent' WHEN platform_rho >= 0.3 THEN 'cautious' ELSE 'conflicting' END AS tier FROM (SELECT feat, count(*) AS n_shared, corr(ra, rb) AS platform_rho FROM rk GROUP BY feat HAVING count(*) >= 30)", "m", **_RANKED))
def c05_platform_tier(spark: SparkSession, d: str) -> DataFrame:
    m = stage(spark, d, "measurements")
    got = correlate.agreement(m.where(F.col("src") == "A"), m.where(F.col("src") == "N"), "feat", "ent", "value", 30)
    rho = F.col("platform_rho")
    return got.select("feat", "n_shared", *r6("platform_rho"), F.round(stats.confidence_ramp(rho, -0.1, 0.1), 6).alias("confidence"), correlate.platform_tier(rho).alias("tier"))


# ------------------------------------------------------------------ composite scores

_GUARDED = {
    "ls": "SELECT src, strat, count(DISTINCT ent) AS lines FROM m GROUP BY ALL",
    "gd": "SELECT src, strat, feat, ent, CASE WHEN count(*) FILTER (WHERE value > 15) OVER (PARTITION BY src, strat, feat) * 1.0 / lines >= 0.2 THEN z END AS z FROM z JOIN ls USING (src, strat)",
    "gw": "SELECT feat, src, sqrt(count(DISTINCT ent)) AS w FROM gd WHERE z IS NOT NULL GROUP BY ALL",
    "gs": "SELECT feat, ent, sum(w * z) / sqrt(sum(w * w)) AS zf, count(DISTINCT src) AS k FROM gd JOIN gw USING (feat, src) WHERE z IS NOT NULL GROUP BY feat, ent",
}


@query(sql("SELECT feat, ent, k AS k_src, round(CASE WHEN k < 3 THEN zf / sqrt(3.0 / k) ELSE zf END, 6) AS z_t FROM gs", "z", **_GUARDED))
def c01_bulk_score(spark: SparkSession, d: str) -> DataFrame:
    """Robust z, silence guard, weighted combination: the first layer's score."""
    z = zscores.silence_guard(roles.z_of(stage(spark, d, "measurements")), ["src", "strat"], "feat", "ent", "value", "z", expressed=15.0)
    return combine.stouffer_by_coverage(z, "feat", "ent", "src", "z", 3).select("feat", "ent", "k_src", *r6("z_t"))


@query(sql("SELECT feat, ent, round(sum(z) / sqrt(count(*)), 6) AS z_t, count(*) AS k_src FROM g4 WHERE status = 0 AND z IS NOT NULL GROUP BY feat, ent", "m", **_METHOD))
def c02_engine_ok_only(spark: SparkSession, d: str) -> DataFrame:
    """Three-regime z, exported for status ok only, sources combined alike."""
    ok = method_scores(spark, d).where(F.col("status") == 0)
    return combine.stouffer_simple(ok, ["feat", "ent"], "z").select("feat", "ent", *r6("z_t"), "k_src")


_LAYERS = {
    "za": "SELECT feat, ent, sum(z) / sqrt(count(*)) AS z, count(*) AS k FROM z WHERE src <> 'R' AND z IS NOT NULL GROUP BY feat, ent",
    "zb": "SELECT feat, ent, sum(z) / sqrt(count(*)) AS z, count(*) AS k FROM z WHERE src = 'R' AND z IS NOT NULL GROUP BY feat, ent",
}


def _std(name: str, out: str) -> str:
    return (
        f"SELECT feat, ent, z, greatest(-5.0, least(5.0, (z - CASE WHEN n < 5 THEN w * med + (1 - w) * med_g ELSE med END) / CASE WHEN n < 5 THEN sqrt(w * sd * sd + (1 - w) * sd_g * sd_g) ELSE sd END)) AS {out} "
        f"FROM (SELECT *, greatest(coalesce(sd0, sd_g), 1e-6) AS sd, n / (n + 25.0) AS w FROM (SELECT *, count(*) OVER w AS n, median(z) OVER w AS med, median(z) OVER g AS med_g, "
        f"greatest(coalesce(stddev_samp(z) OVER g, 1e-6), 1e-6) AS sd_g, stddev_samp(z) OVER w AS sd0 FROM {name} WINDOW w AS (PARTITION BY feat, k), g AS (PARTITION BY feat)))"
    )


_CORE = _LAYERS | {
    "sa": _std("za", "a_std"),
    "sb": _std("zb", "b_std"),
    "bo": "SELECT sa.feat, sa.ent, sa.z AS a, a_std, sb.z AS b, b_std FROM sa JOIN sb ON sa.feat = sb.feat AND sa.ent = sb.ent",
    "ov": "SELECT stddev_samp(a) AS sx, stddev_samp(b) AS sy FROM bo",
    "ea": "SELECT feat, count(*) AS n, corr(a, b) AS r, stddev_samp(a) AS x, stddev_samp(b) AS y FROM bo GROUP BY feat",
    "sl": """SELECT feat, n AS n_shared, CASE WHEN n >= 30 THEN 30.0 / (n + 30.0) * 0.353 + (1 - 30.0 / (n + 30.0)) * r ELSE 0.353 END AS rho,
  CASE WHEN n >= 30 THEN (30.0 / (n + 30.0) * 0.353 + (1 - 30.0 / (n + 30.0)) * r) * sqrt(n / (n + 25.0) * y * y + (1 - n / (n + 25.0)) * sy * sy) / sqrt(n / (n + 25.0) * x * x + (1 - n / (n + 25.0)) * sx * sx) ELSE 0.353 * sy / sx END AS beta FROM ea, ov""",
    "re": "SELECT bo.*, b - beta * a AS resid FROM bo JOIN sl USING (feat)",
    "rz": """SELECT *, greatest(-5.0, least(5.0, (resid - median(resid) OVER (PARTITION BY feat)) / sqrt(w * power(greatest(coalesce(stddev_samp(resid) OVER (PARTITION BY feat), 1e-6), 1e-6), 2) + (1 - w) * sda * sda))) AS resid_z
  FROM (SELECT *, count(*) OVER (PARTITION BY feat) / (count(*) OVER (PARTITION BY feat) + 25.0) AS w, (SELECT stddev_samp(resid) FROM re) AS sda FROM re)""",
    "two": """SELECT feat, ent, CASE WHEN swap THEN (sqrt(1.431) * a_std + sqrt(1.45) * b_std) / sqrt(2.881) ELSE (sqrt(1.431) * a_std + sqrt(1.45) * resid_z) / sqrt(2.881) END AS cz, 2 AS n_layers, CASE WHEN swap THEN 'C_regime3' ELSE 'A' END AS combination_variant
  FROM (SELECT *, coalesce(abs(a_std) > 1 AND abs(b_std) > 1 AND sign(a_std) <> sign(b_std), false) AS swap FROM rz)""",
    "one": """SELECT feat, ent, sqrt(1.431) / sqrt(2.881) * a_std AS cz, 1 AS n_layers, 'A_fallback_scaled' AS combination_variant FROM sa
  WHERE ent NOT IN (SELECT ent FROM bo) OR feat NOT IN (SELECT feat FROM bo)""",
    "cs": f"SELECT feat, ent, {stats.sql_phi('cz')} AS core_score, n_layers, combination_variant FROM (SELECT * FROM two UNION ALL SELECT * FROM one)",
}


def layers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    z = roles.z_of(stage(spark, d, "measurements"))
    return tuple(combine.stouffer_simple(z.where(c), ["feat", "ent"], "z") for c in (F.col("src") != "R", F.col("src") == "R"))


@query(sql("SELECT feat, n_shared, round(rho, 6) AS rho, round(beta, 6) AS beta FROM sl", "z", **_CORE))
def c09_regression_slopes(spark: SparkSession, d: str) -> DataFrame:
    a, b = layers(spark, d)
    both = a.select("feat", "ent", F.col("z_t").alias("a")).join(b.select("feat", "ent", F.col("z_t").alias("b")), ["feat", "ent"])
    return combine.regression_slopes(both, "feat", "a", "b").select("feat", "n_shared", *r6("rho", "beta"))


@query(sql("SELECT feat, ent, round(core_score, 6) AS core_score, n_layers, combination_variant FROM cs", "z", **_CORE))
def c11_core_score(spark: SparkSession, d: str) -> DataFrame:
    """Regression residual, orthogonal combination, disagreement rule and one-layer fallback in one plan."""
    a, b = layers(spark, d)
    return combine.core_score(a, b, "feat", "ent", "z_t", "k_src").select("feat", "ent", *r6("core_score"), "n_layers", "combination_variant")


@query(sql("""SELECT feat, ent, round(core_score, 6) AS core_score, n_layers, combination_variant FROM cs UNION ALL
SELECT feat, ent, round(core_score, 6), 1, 'A_fallback_scaled' FROM (SELECT feat, ent, """ + stats.sql_phi("cz") + """ AS core_score FROM (SELECT feat, ent, sqrt(1.431) / sqrt(2.881) * a_std AS cz FROM sa)) x
WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.feat = x.feat AND cs.ent = x.ent)""", "z", **_CORE))
def c13_core_score_holes_filled(spark: SparkSession, d: str) -> DataFrame:
    a, b = layers(spark, d)
    return combine.core_score(a, b, "feat", "ent", "z_t", "k_src", fill_holes=True).select("feat", "ent", *r6("core_score"), "n_layers", "combination_variant")


_AGREE = {
    "ag": "SELECT feat, count(*) AS n_shared, corr(ra, rb) AS platform_rho FROM rk GROUP BY feat HAVING count(*) >= 55",
}


@query(sql("SELECT feat, ent, k_src, round(CASE WHEN k_src >= 2 THEN z_full * CASE WHEN platform_rho IS NULL THEN 1.0 ELSE least(greatest((platform_rho + 0.1) / 0.2, 0.0), 1.0) END ELSE z_full END, 6) AS z_t FROM s LEFT JOIN ag USING (feat)", "s", **_RANKED, **_AGREE))
def c07_agreement_weighted_score(spark: SparkSession, d: str) -> DataFrame:
    """Second layer: sources merged without shrinkage, times the platforms' agreement where two or more were merged."""
    m = stage(spark, d, "measurements")
    agree = correlate.agreement(m.where(F.col("src") == "A"), m.where(F.col("src") == "N"), "feat", "ent", "value", 55)
    z = combine.stouffer_by_coverage(roles.z_of(stage(spark, d, "measurements")), "feat", "ent", "src", "z")
    return correlate.weigh_by_agreement(z, agree, "feat", "z_t", "k_src", -0.1, 0.1).select("feat", "ent", "k_src", *r6("z_t"))


@query(sql("SELECT feat, ent, round(p_mutation, 6) AS p_mutation, max_vep_rank FROM mut", "mut"))
def c14_mutation_score(spark: SparkSession, d: str) -> DataFrame:
    return evidence.mutation_scores(roles.mutations(stage(spark, d, "raw")), ["feat", "ent"]).select("feat", "ent", *r6("p_mutation"), "max_vep_rank")


@query(sql("SELECT feat, ent, round(p_fusion, 6) AS p_fusion FROM fus", "fus"))
def c15_fusion_score(spark: SparkSession, d: str) -> DataFrame:
    return evidence.fusion_scores(roles.fusions(stage(spark, d, "raw")), ["feat", "ent"]).select("feat", "ent", *r6("p_fusion"))


@query(sql("SELECT feat, ent, has_cna_alteration, has_cna_context, round(total_cn_mean, 6) AS total_cn_mean FROM cna", "cna"))
def c16_copy_number_flags(spark: SparkSession, d: str) -> DataFrame:
    got = evidence.cna_flags(roles.copy_numbers(stage(spark, d, "raw")), ["feat", "ent"], roles.roles(spark, d), "feat")
    return got.select("feat", "ent", "has_cna_alteration", "has_cna_context", *r6("total_cn_mean"))


def flags(spark: SparkSession, d: str) -> DataFrame:
    keys = ["feat", "ent"]
    scored = stage(spark, d, "scores").select("feat", "ent", F.col("score").alias("core_score"), F.lit(1).alias("n_layers"))
    return evidence.route(
        scored, evidence.mutation_scores(roles.mutations(stage(spark, d, "raw")), keys), evidence.fusion_scores(roles.fusions(stage(spark, d, "raw")), keys),
        evidence.cna_flags(roles.copy_numbers(stage(spark, d, "raw")), keys, roles.roles(spark, d), "feat"), roles.roles(spark, d), keys, "feat",
    )


@query(sql("SELECT feat, ent, round(core_score, 6) AS core_score, n_layers, round(p_mutation, 6) AS p_mutation, max_vep_rank, round(p_fusion, 6) AS p_fusion, has_cna_alteration, has_driver_alteration, has_alteration, is_lof_alteration, gene_role FROM fl", "fl"))
def c17_driver_routing(spark: SparkSession, d: str) -> DataFrame:
    return flags(spark, d).select(
        "feat", "ent", *r6("core_score"), "n_layers", *r6("p_mutation"), "max_vep_rank", *r6("p_fusion"), "has_cna_alteration", "has_driver_alteration", "has_alteration", "is_lof_alteration", "gene_role"
    )


@query(sql("SELECT feat, ent, round(pct, 6) AS score_rank_pct, confidence_tier FROM ti", "ti"))
def c19_confidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    return evidence.tiers(flags(spark, d), "feat").select("feat", "ent", *r6("score_rank_pct"), "confidence_tier")


@query(sql("SELECT 0::BIGINT AS no_tier, 0::BIGINT AS unknown_tier, 0::BIGINT AS high_without_driver, 0::BIGINT AS evidence_mismatch, 0::BIGINT AS driver_without_context"))
def c20_tier_invariants(spark: SparkSession, d: str) -> DataFrame:
    return evidence.tier_violations(evidence.tiers(flags(spark, d), "feat"))


@query(sql("""SELECT feat, ent, CASE WHEN core_score >= 0.8 THEN 'likely_essential' WHEN core_score >= 0.5 THEN 'possibly_essential' ELSE 'likely_non_essential' END AS essentiality_check,
  (contains(coalesce(gene_role, ''), 'oncogene') AND has_cna_alteration) OR (contains(coalesce(gene_role, ''), 'tsg') AND NOT has_cna_alteration) AS cna_role_consistent,
  CAST(CAST(n_layers >= 1 AS INTEGER) + CAST(n_layers >= 2 AS INTEGER) + CAST(p_mutation > 0 AS INTEGER) + CAST(p_fusion > 0 AS INTEGER) + CAST(has_cna_alteration AS INTEGER) AS INTEGER) AS n_layers_present FROM fl""", "fl"))
def c21_evidence_ledger(spark: SparkSession, d: str) -> DataFrame:
    return evidence.ledger(flags(spark, d)).select("feat", "ent", "essentiality_check", "cna_role_consistent", "n_layers_present")


@query(sql("""SELECT feat, n_lines, n_expressed, round(n_expressed / n_lines, 6) AS expressed_share, CASE WHEN n_lines < 30 THEN 'NO_EVIDENCE' WHEN n_expressed / n_lines < 0.2 THEN 'UNINFORMATIVE' WHEN n_expressed / n_lines > 0.95 THEN 'NEAR_UNIVERSAL' WHEN n_expressed < 10 THEN 'TRIVIALLY_SATISFIED' ELSE 'OK' END AS state
FROM (SELECT feat, count(value) AS n_lines, count(*) FILTER (WHERE value > 15) AS n_expressed FROM m GROUP BY feat)""", "m"))
def c22_feature_states(spark: SparkSession, d: str) -> DataFrame:
    return evidence.feature_states(stage(spark, d, "measurements"), "feat", "value", expressed=15.0).select("feat", "n_lines", "n_expressed", *r6("expressed_share"), "state")


@query(sql("""SELECT feat, ent, CASE WHEN pa IS NULL OR pb IS NULL THEN 'not_covered' WHEN abs(pa - pb) <= 0.2 THEN 'corroborated' ELSE 'contradicted' END AS geo_support FROM (SELECT feat, ent,
  CASE WHEN a IS NOT NULL THEN (rank() OVER (PARTITION BY feat ORDER BY a NULLS LAST) + (count(*) OVER (PARTITION BY feat, a) - 1) / 2.0) / count(a) OVER (PARTITION BY feat) END AS pa,
  CASE WHEN b IS NOT NULL THEN (rank() OVER (PARTITION BY feat ORDER BY b NULLS LAST) + (count(*) OVER (PARTITION BY feat, b) - 1) / 2.0) / count(b) OVER (PARTITION BY feat) END AS pb FROM wide)""", "m", **_PAIRED))
def c24_corroboration(spark: SparkSession, d: str) -> DataFrame:
    p = paired(spark, d).withColumn("pa", ranks.percentile_rank(["feat"], "a")).withColumn("pb", ranks.percentile_rank(["feat"], "b"))
    return p.select("feat", "ent", evidence.corroboration(F.col("pa"), F.col("pb"), 0.2).alias("geo_support"))
