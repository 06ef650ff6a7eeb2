"""Queries of composite scores, states, details and composed views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import stats
from gneiss.functions.ids import gene_id, upper_id
from gneiss.operators import combine, correlate, evidence, serving, similarity
from gneiss.plans import roles, scoring
from gneiss.plans.audits import _ABLE, _PAIRS, asked, embedded
from gneiss.plans.registry import Registry
from gneiss.plans.roles import FEATURES, sql
from gneiss.plans.scoring import _METHOD, flags, method_scores, r6
from gneiss.plans.stage import stage
from gneiss.session import table, written

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
A = FEATURES[0]


# ------------------------------------------------------------------ composite scores

_GLOBAL = {k.replace("g", "o") if k.startswith("g") else f"{k}o": v.replace("src, strat, feat", "src, feat").replace("SELECT src, feat, ent, det", "SELECT src, feat, ent, det").replace("SELECT src, strat, count", "SELECT src, count")
           .replace("USING (src, strat)", "USING (src)").replace("FROM g", "FROM o").replace("JOIN fl_ ", "JOIN fl_o ").replace("JOIN nb ", "JOIN nbo ") for k, v in _METHOD.items()}


@query(sql("""SELECT feat, ent, round(sum(l.z) / sqrt(count(l.z)), 6) AS z_lineage, round(sum(g.z) / sqrt(count(g.z)), 6) AS z_global, count(l.z) AS k_src, round(avg(l.det), 6) AS det_frac, min(l.status) AS status, min(l.scale_source) AS scale_source
FROM (SELECT * FROM g4) l JOIN (SELECT src, feat, ent, z FROM o4) g USING (src, feat, ent) GROUP BY feat, ent""", "m", **_METHOD, **_GLOBAL))
def c02_engine(spark: SparkSession, d: str) -> DataFrame:
    """Sources combined on the stratified and on the global axis, with the best status and the scale behind the z."""
    own = method_scores(spark, d).select("src", "feat", "ent", "z", "det_frac", "status", "scale_source")
    overall = method_scores(spark, d, stratify=False).select("src", "feat", "ent", F.col("z").alias("zg"))
    both = own.join(overall, ["src", "feat", "ent"])
    combined = lambda c: F.when(F.count(c) > 0, F.round(F.sum(c) / F.sqrt(F.count(c).cast("double")), 6))
    return both.groupBy("feat", "ent").agg(
        combined("z").alias("z_lineage"), combined("zg").alias("z_global"), F.count("z").alias("k_src"), F.round(F.avg("det_frac"), 6).alias("det_frac"), F.min("status").alias("status"), F.min("scale_source").alias("scale_source")
    )


_FIRST = {
    "tr": "SELECT feat FROM (" + scoring.ORACLE["c05_platform_tier"] + ") WHERE tier = 'conflicting'",
    "kz": "SELECT feat, ent, src, z FROM z WHERE z IS NOT NULL AND src IN ('A', 'N') AND NOT (src = 'N' AND feat IN (SELECT feat FROM tr))",
    "kw": "SELECT feat, src, sqrt(count(DISTINCT ent)) AS w FROM kz GROUP BY ALL",
}


@query(sql("SELECT feat, ent, round(sum(w * z) / sqrt(sum(w * w)), 6) AS z_t, count(DISTINCT src) AS n_sources FROM kz JOIN kw USING (feat, src) GROUP BY feat, ent", "z", **_FIRST))
def c06_first_platform_score(spark: SparkSession, d: str) -> DataFrame:
    """The first protein score: the second platform dropped for features on which both disagree."""
    m = stage(spark, d, "measurements")
    rho = correlate.agreement(m.where(F.col("src") == "A"), m.where(F.col("src") == "N"), "feat", "ent", "value", 30)
    conflicting = rho.where(correlate.platform_tier(F.col("platform_rho")) == "conflicting").select("feat")
    z = roles.z_of(stage(spark, d, "measurements")).where(F.col("src").isin("A", "N"))
    return combine.platform_score(z, conflicting, "feat", "ent", "src", "z", "N").select("feat", "ent", *r6("z_t"), "n_sources")


_SERIES = {
    "v": r"SELECT upper(trim(gsm_id)) AS gsm, regexp_replace(upper(trim(gene_id)), '^(ENSG[0-9]+)\.[0-9]+$', '\1') AS gene, log2_value AS x FROM geo_values WHERE log2_value IS NOT NULL AND NOT isnan(log2_value)",
    "sr": "SELECT upper(trim(gsm_id)) AS gsm, min(upper(trim(gse_id))) AS gse FROM geo_platform WHERE trim(gse_id) <> '' GROUP BY 1",
    "md": "SELECT upper(trim(gsm)) AS gsm, min(upper(trim(model_id))) AS model FROM no_depmap_equivalent_geo_expr WHERE trim(model_id) <> '' AND trim(gsm) <> '' GROUP BY 1",
    "sc_": "SELECT gse, min(x) AS lo, quantile_cont(x, 0.99) AS p99, max(x) AS hi FROM v JOIN sr USING (gsm) GROUP BY gse",
    "y": "SELECT gse, gsm, gene, median(CASE WHEN lo >= -10 AND p99 < 25 AND hi <= 50 THEN x ELSE log2(greatest(x, 0.0) + 1) END) AS value FROM v JOIN sr USING (gsm) JOIN sc_ USING (gse) GROUP BY ALL",
}


@query("WITH " + ", ".join(f"{k} AS ({q})" for k, q in _SERIES.items()) + " SELECT gene, model, round(median(value), 6) AS value, count(*) AS n_samples, count(DISTINCT gse) AS n_series FROM y JOIN md USING (gsm) GROUP BY gene, model")
def c25_series_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Scale decided per series, probes to genes by median within a sample, then the median of a pair over all its samples."""
    v = table(spark, d, "geo_values").where(F.col("log2_value").isNotNull() & ~F.isnan("log2_value"))
    v = v.select(upper_id(F.col("gsm_id")).alias("gsm"), gene_id(F.col("gene_id")).alias("gene"), F.col("log2_value").alias("x"))
    series = table(spark, d, "geo_platform").select(upper_id(F.col("gsm_id")).alias("gsm"), upper_id(F.col("gse_id")).alias("gse")).where(F.col("gse").isNotNull()).groupBy("gsm").agg(F.min("gse").alias("gse"))
    models = table(spark, d, "no_depmap_equivalent_geo_expr").select(upper_id(F.col("gsm")).alias("gsm"), upper_id(F.col("model_id")).alias("model")).where(F.col("model").isNotNull() & F.col("gsm").isNotNull())
    named = v.join(series, "gsm")
    scale = named.groupBy("gse").agg(((F.min("x") >= -10) & (F.percentile("x", F.lit(0.99)) < 25) & (F.max("x") <= 50)).alias("log"))
    y = F.when(F.col("log"), F.col("x")).otherwise(stats.log2p1(F.col("x")))
    samples = named.join(scale, "gse").withColumn("y", y).groupBy("gse", "gsm", "gene").agg(F.median("y").alias("value"))
    pairs = samples.join(models.groupBy("gsm").agg(F.min("model").alias("model")), "gsm")
    return pairs.groupBy("gene", "model").agg(F.round(F.median("value"), 6).alias("value"), F.count("*").alias("n_samples"), F.count_distinct("gse").alias("n_series"))


# ------------------------------------------------------------------ states

_LABEL = {"lb": "SELECT feat, ent, max(disc) >= 0.1 AS dep FROM raw GROUP BY ALL"}


@query(sql("""SELECT feat, n_scored, round(spread, 6) AS spread, round(agreement, 6) AS agreement, CASE WHEN n_scored < 30 THEN 'NO_EVIDENCE' WHEN spread < 0.35 THEN 'UNINFORMATIVE' WHEN agreement < 0 AND gene_role <> 'tsg' THEN 'CONFLICTING' ELSE 'RANKED' END AS state
FROM (SELECT feat, count(*) AS n_scored, quantile_cont(score, 0.9) - median(score) AS spread, corr(score, CAST(dep AS DOUBLE)) AS agreement FROM sc JOIN lb USING (feat, ent) WHERE score IS NOT NULL GROUP BY feat) JOIN roles USING (feat)""", "sc", "roles", "raw", **_LABEL))
def c22_ranking_states(spark: SparkSession, d: str) -> DataFrame:
    """Whether each feature's ranking is to be shown, refused or suppressed."""
    lab = stage(spark, d, "raw").groupBy("feat", "ent").agg((F.max("disc") >= 0.1).alias("dep"))
    s = stage(spark, d, "scores").join(lab, ["feat", "ent"]).join(roles.roles(spark, d), "feat")
    return evidence.ranking_states(s, "feat", "score", F.col("dep"), "gene_role", spread=0.35, against=0.0).select("feat", "n_scored", *r6("spread", "agreement"), "state")


_ASKED = ("Brand#11", " brand#22", "BRAND#7", "Brand#77", "nothing")


@query(sql("SELECT asked, resolved, coalesce(n_lines, 0) AS n_lines, coalesce(state, 'UNKNOWN_GENE') AS state FROM (SELECT unnest([" + ", ".join(f"'{a}'" for a in _ASKED) + "]) AS asked) LEFT JOIN (SELECT feat AS resolved, lower(feat) AS k, count(value) AS n_lines, CASE WHEN count(value) < 30 THEN 'NO_EVIDENCE' WHEN count(*) FILTER (WHERE value > 15) / count(value) < 0.2 THEN 'UNINFORMATIVE' WHEN count(*) FILTER (WHERE value > 15) / count(value) > 0.95 THEN 'NEAR_UNIVERSAL' WHEN count(*) FILTER (WHERE value > 15) < 10 THEN 'TRIVIALLY_SATISFIED' ELSE 'OK' END AS state FROM m GROUP BY feat) ON k = lower(trim(asked))", "m"))
def c23_asked_states(spark: SparkSession, d: str) -> DataFrame:
    """What is known of the features that were asked for, those that are none included."""
    states = evidence.feature_states(stage(spark, d, "measurements"), "feat", "value", expressed=15.0)
    names = spark.createDataFrame([(a,) for a in _ASKED], "asked string")
    return evidence.asked_states(names, "asked", states, "feat").select("asked", "resolved", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "state")


@query(sql("""SELECT feat, unnest(list_filter([CASE WHEN s < 0.2 THEN 'SILENT_GENE' END, CASE WHEN s > 0.95 THEN 'NEAR_UNIVERSAL_GENE' END, CASE WHEN a < 10 THEN 'TRIVIALLY_SATISFIED' END, CASE WHEN r IN ('tsg', 'both') THEN 'LOSS_IS_PROTEIN_LEVEL' END], lambda x: x IS NOT NULL)) AS abstention
FROM (SELECT feat, avg(CAST(val > 15 AS DOUBLE)) AS s, count(*) FILTER (WHERE disc >= 0.1 AND tax >= 0.08 AND qty > 49) AS a, max(gene_role) AS r FROM raw JOIN roles USING (feat) GROUP BY feat)""", "raw", "roles"))
def d16_abstentions(spark: SparkSession, d: str) -> DataFrame:
    """Every reason for which a set query on a feature would say nothing."""
    rows = stage(spark, d, "raw").join(roles.roles(spark, d), "feat")
    altered = (F.col("disc") >= 0.1) & (F.col("tax") >= 0.08) & (F.col("qty") > 49)
    return evidence.abstentions(rows, "feat", "val", altered, "gene_role", 15.0)


@query(sql("""SELECT e.feat, e.ent, CASE WHEN NOT sq THEN NULL WHEN coalesce(max_vep_rank, 0) >= 3 THEN true WHEN coalesce(max_vep_rank, 0) = 2 AND variant_count > 0 AND gene_role = 'oncogene' THEN NULL ELSE false END AS altered
FROM (SELECT feat, ent, bool_or(platform = 'F') AS sq FROM raw GROUP BY ALL) e LEFT JOIN mut0 m ON e.feat = m.feat AND e.ent = m.ent JOIN roles r ON e.feat = r.feat""", "raw", "mut0", "roles"))
def d19_altered_or_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Altered, not altered, or not to be told: moderate changes of listed features leave the answer open."""
    rows = stage(spark, d, "raw")
    seen = rows.groupBy("feat", "ent").agg(F.bool_or(F.col("platform") == "F").alias("sq"))
    got = seen.join(roles.mutations(rows), ["feat", "ent"], "left").join(roles.roles(spark, d), "feat")
    return got.select("feat", "ent", evidence.altered_or_unknown(F.col("sq"), F.col("max_vep_rank"), F.col("variant_count"), F.col("gene_role") == "oncogene").alias("altered"))


@query(sql("SELECT feat, ent, round(cn / ploidy, 6) AS relative, CASE WHEN cn / ploidy > 1.5 THEN 1 WHEN cn / ploidy < 0.5 THEN -1 ELSE 0 END AS vote FROM (SELECT feat, ent, avg(total_cn) AS cn FROM cna0 GROUP BY ALL) JOIN (SELECT ent, avg(total_cn) AS ploidy FROM cna0 GROUP BY ent) USING (ent)", "cna0"))
def d21_relative_copy_number(spark: SparkSession, d: str) -> DataFrame:
    """Copy number over the entity's ploidy, and what it votes for."""
    c = roles.copy_numbers(stage(spark, d, "raw"))
    got = evidence.relative_copy_number(c, ["feat", "ent"], "ent", "total_cn")
    return got.select("feat", "ent", *r6("relative"), evidence.copy_number_vote(F.col("relative")).alias("vote"))


@query(sql("""SELECT feat, k, round(q, 6) AS q, round(CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) ELSE 0 END, 6) AS i2 FROM (SELECT feat, count(*) AS k, greatest(0, sum(w * mean * mean) - sum(w * mean) * sum(w * mean) / sum(w)) AS q
FROM (SELECT feat, src, avg(value) AS mean, count(value) / nullif(var_samp(value), 0) AS w FROM m GROUP BY ALL) WHERE w IS NOT NULL GROUP BY feat HAVING count(*) >= 2)""", "m"))
def d09_heterogeneity(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sources' means of a feature differ beyond chance."""
    return combine.heterogeneity(stage(spark, d, "measurements"), "feat", "src", "value").select("feat", "k", *r6("q", "i2"))


@query(sql("SELECT feat, ent, place FROM (SELECT feat, ent, row_number() OVER (PARTITION BY feat ORDER BY has_driver_alteration DESC, core_score DESC NULLS LAST, ent) AS place FROM fl) WHERE place <= 10", "fl"))
def d05_driver_first_order(spark: SparkSession, d: str) -> DataFrame:
    """Drivers first, then the score: two sort keys instead of one number that holds both."""
    order = Window.partitionBy("feat").orderBy(F.desc("has_driver_alteration"), F.desc_nulls_last("core_score"), "ent")
    return flags(spark, d).withColumn("place", F.row_number().over(order)).where(F.col("place") <= 10).select("feat", "ent", "place")


# ------------------------------------------------------------------ detail and composed views

# The pair that the details are of: the least entity of the query set that has a score for the feature.
_ONE = f"(SELECT min(ent) FROM sc WHERE feat = '{A}' AND ent % 50 = 0)"


def detailed_entity(spark: SparkSession, d: str) -> int:
    return stage(spark, d, "scores").where((F.col("feat") == A) & (F.col("ent") % 50 == 0)).agg(F.min("ent")).first()[0]


_DETAIL = {
    "dt": f"SELECT feat, ent, score, 1 + (SELECT count(*) FROM sc x WHERE x.feat = '{A}' AND x.score > sc.score) AS rank, (SELECT count(*) FROM sc x WHERE x.feat = '{A}' AND x.score IS NOT NULL) AS total FROM sc WHERE feat = '{A}' AND ent = {_ONE}",
    "lv": f"SELECT string_agg(src || '=' || CAST(round({stats.sql_phi('z')}, 4) AS DECIMAL(9, 4)), ',' ORDER BY src) AS levels, count(*) AS n_levels FROM z WHERE feat = '{A}' AND ent = {_ONE} AND z IS NOT NULL",
    "al": "SELECT string_agg(neighbour, ',' ORDER BY rank) AS alternatives FROM (SELECT neighbour, row_number() OVER (ORDER BY round(s, 12) DESC, neighbour) AS rank FROM px WHERE query = " + _ONE + " AND neighbour IN (SELECT ent FROM ab)) WHERE rank <= 5",
}


@query(sql("""SELECT dt.ent, dt.score, rank, total, confidence_tier, n_layers, round(p_mutation, 6) AS p_mutation, round(p_fusion, 6) AS p_fusion, p_mutation >= 0.5 AS mutation_driver, p_fusion >= 0.5 AS fusion_driver, has_cna_alteration, has_driver_alteration, levels, n_levels, alternatives
FROM dt JOIN ti ON ti.feat = dt.feat AND ti.ent = dt.ent, lv, al""", "sc", "ti", "z", px=_PAIRS["pr"], **_ABLE, **_DETAIL))
def q11_full_detail(spark: SparkSession, d: str) -> DataFrame:
    """All there is of one pair: rank, tier, drivers by layer, levels by source, and the nearest entities able to answer the query."""
    s, ent = stage(spark, d, "scores"), detailed_entity(spark, d)
    one = serving.detail(s, A, ent, "feat", "ent", "score")
    proof = evidence.tiers(flags(spark, d), "feat").where((F.col("feat") == A) & (F.col("ent") == ent))
    proof = proof.select("ent", "confidence_tier", "n_layers", *r6("p_mutation", "p_fusion"), (F.col("p_mutation") >= 0.5).alias("mutation_driver"), (F.col("p_fusion") >= 0.5).alias("fusion_driver"), "has_cna_alteration", "has_driver_alteration")
    z = roles.z_of(stage(spark, d, "measurements")).where((F.col("feat") == A) & (F.col("ent") == ent) & F.col("z").isNotNull())
    level = F.concat("src", F.lit("="), F.round(stats.phi("z"), 4).cast("decimal(9,4)").cast("string"))
    levels = z.select(level.alias("l")).agg(F.array_join(F.sort_array(F.collect_list("l")), ",").alias("levels"), F.count("*").alias("n_levels"))  # one row a source
    e = embedded(spark, d)
    near = serving.nearest_able(e, e.where(F.col("vec_id") == ent), "vec_id", "v", s, FEATURES, "feat", "ent", "score", 5)
    best = near.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"].cast("string")), ",").alias("alternatives"))  # five rows
    return one.join(proof, "ent").join(levels).join(best)  # one row each


@query(sql(f"SELECT ent, score, strat, row_number() OVER (ORDER BY score DESC, ent) AS place FROM sc WHERE feat = '{A}' AND score IS NOT NULL ORDER BY place LIMIT 30", "sc"))
def q15_ranked_frame(spark: SparkSession, d: str) -> DataFrame:
    """The first 30 of a feature with what describes them."""
    best = serving.rank_one(stage(spark, d, "scores"), A, "feat", "ent", "score", 30)
    placed = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "ent")))  # 30 rows
    return placed.join(roles.entities(spark, d), "ent", "left").select("ent", "score", "strat", "place")


_AXES = " UNION ALL ".join(
    f"SELECT query, '{a}' AS axis, neighbour, la = lb AS same_label, round({c}, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY round({c}, 12) DESC, neighbour) AS rank FROM pr" for a, c in (("first", "s0"), ("second", "s1"))
)


@query(sql(f"SELECT query AS vec_id, axis, true AS covered, CAST(rank AS INTEGER) AS rank, neighbour, similarity, same_label FROM ({_AXES}) WHERE rank <= 10 UNION ALL SELECT -1, unnest(['first', 'second']), false, NULL, NULL, NULL, NULL", **_PAIRS))
def q17_similar_per_axis(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest on each axis, side by side, and a row that says so where an axis does not cover the entity."""
    e = embedded(spark, d)
    wanted = asked(e).select("vec_id").unionByName(spark.createDataFrame([(-1,)], "vec_id long"))
    got = serving.similar_per_axis(e, wanted, "vec_id", {"first": "v0", "second": "v1"}, "label", 10)
    return got.select("vec_id", "axis", "covered", "rank", "neighbour", *r6("similarity"), "same_label")


@query(sql(f"""SELECT 'gene' AS step, 1 AS place, '{A}' AS item, CAST(count(value) AS DOUBLE) AS figure FROM m WHERE feat = '{A}'
UNION ALL SELECT 'candidate', place, CAST(ent AS VARCHAR), round(value, 6) FROM (SELECT *, CAST(row_number() OVER (ORDER BY value DESC, ent) AS INTEGER) AS place FROM (SELECT ent, max(value) AS value FROM m WHERE feat = '{A}' AND value > 15 AND ent % 50 = 0 GROUP BY ent)) WHERE place <= 5
UNION ALL SELECT 'alternative', place, CAST(neighbour AS VARCHAR), round(s, 6) FROM (SELECT neighbour, s, CAST(row_number() OVER (ORDER BY round(s, 12) DESC, neighbour) AS INTEGER) AS place FROM pr WHERE query = (SELECT ent FROM (SELECT ent, max(value) AS value FROM m WHERE feat = '{A}' AND value > 15 AND ent % 50 = 0 GROUP BY ent) ORDER BY value DESC, ent LIMIT 1)) WHERE place <= 5""", "m", **_PAIRS))
def q18_explore(spark: SparkSession, d: str) -> DataFrame:
    """From a feature to what is known of it, its best candidates of the query set, and the entities like the first of them."""
    m = stage(spark, d, "measurements").where(F.col("feat") == A)
    gene = m.agg(F.count("value").cast("double").alias("figure")).select(F.lit("gene").alias("step"), F.lit(1).alias("place"), F.lit(A).alias("item"), "figure")
    best = m.where((F.col("value") > 15) & (F.col("ent") % 50 == 0)).groupBy("ent").agg(F.max("value").alias("value")).orderBy(F.desc("value"), "ent").limit(5)
    placed = written(best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "ent"))))  # five rows
    e = embedded(spark, d)
    first = e.join(placed.where(F.col("place") == 1).select(F.col("ent").alias("vec_id")), "vec_id", "left_semi")
    near = similarity.nearest(e, first, "vec_id", "v", 5)
    return (
        gene.unionByName(placed.select(F.lit("candidate").alias("step"), "place", F.col("ent").cast("string").alias("item"), F.round("value", 6).alias("figure")))
        .unionByName(near.select(F.lit("alternative").alias("step"), F.col("rank").alias("place"), F.col("neighbour").cast("string").alias("item"), F.round("similarity", 6).alias("figure")))
    )


_REQUESTS = {"plain": ([A], (), 0.5, 30), "no feature": ([], (), 0.5, 30), "eleven features": ([A] * 11, (), 0.5, 30), "six strata": ([A], ("x",) * 6, 0.5, 30), "floor": ([A], (), 1.5, 30), "rows": ([A], (), 0.5, 201), "most rows": ([A] * 10, ("x",) * 5, 0.0, 200)}


@query("SELECT unnest(['plain', 'no feature', 'eleven features', 'six strata', 'floor', 'rows', 'most rows']) AS request, unnest([true, false, false, false, false, false, true]) AS accepted")
def q23_request_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Which requests the service takes."""
    rows = []
    for name, request in _REQUESTS.items():
        try:
            serving.checked_request(*request)
            rows.append((name, True))
        except ValueError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "request string, accepted boolean")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, {n} AS n_columns" for t, n in (("region", 2), ("nation", 3), ("customer", 5), ("kept", 7))))
def q24_dataset_info(spark: SparkSession, d: str) -> DataFrame:
    """Rows and columns of the data sets an assistant may be asked about; counts come from the files' footers."""
    out = None
    for t in ("region", "nation", "customer", "kept"):
        df = table(spark, d, t)
        part = df.agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
        out = part if out is None else out.unionByName(part)
    return out


@query(sql(f"SELECT src, round(value, 6) AS value, round(med, 6) AS median, round(1.4826 * mad, 6) AS scale, round((value - med) / greatest(1.4826 * mad, 0.384), 6) AS z, n AS peers FROM d2 WHERE feat = '{A}' AND ent = {_ONE}", "d2", "sc"))
def q24_score_explained(spark: SparkSession, d: str) -> DataFrame:
    """How each source's value of a pair becomes its z: the peers, their median and scale."""
    m = stage(spark, d, "measurements").where(F.col("feat") == A)
    own = m.where(F.col("ent") == detailed_entity(spark, d)).select("src", "strat", F.col("value").alias("own"))
    peers = m.join(own.select("src", "strat"), ["src", "strat"], "left_semi")
    med = peers.groupBy("src", "strat").agg(F.median("value").alias("med"), F.count("value").alias("peers"))
    mad = peers.join(med, ["src", "strat"]).groupBy("src", "strat").agg((F.median(F.abs(F.col("value") - F.col("med"))) * 1.4826).alias("scale"))
    z = (F.col("own") - F.col("med")) / F.greatest("scale", F.lit(0.384))
    return own.join(med, ["src", "strat"]).join(mad, ["src", "strat"]).select("src", F.round("own", 6).alias("value"), F.round("med", 6).alias("median"), F.round("scale", 6).alias("scale"), F.round(z, 6).alias("z"), "peers")

