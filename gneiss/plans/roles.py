"""The roles of the scoring operators bound to the order tables, as DataFrames and as SQL.

entity = customer, feature = part brand, stratum = region, source = return flag, platform = line status,
replicate = line item, value = log2(price + 1).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.stats import log2p1, phi, sql_hill, sql_noisy_or, sql_phi
from gneiss.operators import combine, zscores
from gneiss.operators.aggregates import replicate_median
from gneiss.session import table

FEATURES = ("Brand#11", "Brand#22", "Brand#7")

#: Common table expressions by name, each after those it needs.
CTES = {
    "raw": """SELECT l_returnflag AS src, l_linestatus AS platform, r_name AS strat, n_name AS sub, p_brand AS feat, p_type AS variant, c_custkey AS ent,
  l_orderkey AS ok, l_linenumber AS ln, l_quantity AS qty, l_discount AS disc, l_tax AS tax, o_orderpriority AS prio, log2(l_extendedprice + 1) AS val
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey""",
    "m": "SELECT src, strat, feat, ent, median(val) AS value, count(*) AS n_rep FROM raw GROUP BY ALL",
    "d1": "SELECT *, count(value) OVER (PARTITION BY src, strat, feat) AS n, median(value) OVER (PARTITION BY src, strat, feat) AS med FROM m",
    "d2": "SELECT *, median(abs(value - med)) OVER (PARTITION BY src, strat, feat) AS mad FROM d1",
    "z": "SELECT src, strat, feat, ent, value, CASE WHEN n >= 5 THEN (value - med) / greatest(1.4826 * mad, 0.384) END AS z FROM d2",
    "wt": "SELECT feat, src, sqrt(count(DISTINCT ent)) AS w FROM z WHERE z IS NOT NULL GROUP BY ALL",
    "s": "SELECT feat, ent, min(strat) AS strat, sum(w * z) / sqrt(sum(w * w)) AS z_full, count(DISTINCT src) AS k_src FROM z JOIN wt USING (feat, src) WHERE z IS NOT NULL GROUP BY feat, ent",
    "st": "SELECT feat, ent, strat, k_src, CASE WHEN k_src < 3 THEN z_full / sqrt(3.0 / k_src) ELSE z_full END AS z_t FROM s",
    "sc": f"SELECT feat, ent, strat, k_src, round({sql_phi('z_t')}, 6) AS score FROM st",
    "mut0": f"""SELECT feat, ent, max(CASE prio WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END) AS max_vep_rank,
  max(disc * 10) AS max_pathogenicity, count(*) AS variant_count FROM raw WHERE platform = 'F' GROUP BY ALL""",
    "mut": f"""SELECT feat, ent, max_vep_rank, least({sql_noisy_or(sql_hill('CAST(max_vep_rank AS DOUBLE)', 2.5, 2), sql_hill('max_pathogenicity', 0.5, 2), sql_hill('least(CAST(variant_count AS DOUBLE), 5.0)', 3, 1.5))}, 1.0) AS p_mutation FROM mut0""",
    "fus0": """SELECT feat, ent, max(CASE prio WHEN '1-URGENT' THEN 3.0 WHEN '2-HIGH' THEN 2.0 WHEN '3-MEDIUM' THEN 1.0 END) AS c, max(tax * 5) AS best_ffpm, count(*) AS fusion_count,
  bool_or(qty > 40) AS any_in_frame FROM raw WHERE src = 'R' GROUP BY ALL""",
    "fus": f"""SELECT feat, ent, least({sql_noisy_or(sql_hill('c', 2, 1.5), sql_hill('best_ffpm', 0.5, 2), sql_hill('CAST(fusion_count AS DOUBLE)', 2, 2))} + CASE WHEN any_in_frame THEN 0.15 ELSE 0.0 END, 1.0) AS p_fusion FROM fus0""",
    "roles": "SELECT DISTINCT p_brand AS feat, CASE CAST(right(p_brand, 1) AS INTEGER) WHEN 1 THEN 'oncogene' WHEN 2 THEN 'tsg' WHEN 3 THEN 'both' ELSE 'unknown' END AS gene_role FROM part",
    "cna0": "SELECT feat, ent, qty / 10.0 AS total_cn, CASE WHEN qty > 45 THEN 'amplification' WHEN qty < 5 THEN 'deletion' ELSE 'neutral' END AS cna_call, platform = 'O' AND disc > 0.09 AS is_ambiguous FROM raw",
    "cna": """SELECT feat, ent, bool_or((cna_call = 'amplification' AND gene_role IN ('oncogene', 'both')) OR (cna_call = 'deletion' AND gene_role IN ('tsg', 'both'))) AS has_cna_alteration,
  bool_or(cna_call <> 'neutral' AND NOT ((cna_call = 'amplification' AND gene_role IN ('oncogene', 'both')) OR (cna_call = 'deletion' AND gene_role IN ('tsg', 'both')))) AS has_cna_context,
  avg(total_cn) AS total_cn_mean FROM cna0 JOIN roles USING (feat) WHERE NOT is_ambiguous GROUP BY feat, ent""",
    "proof": """SELECT coalesce(a.feat, c.feat) AS feat, coalesce(a.ent, c.ent) AS ent, p_mutation, max_vep_rank, p_fusion, has_cna_alteration, has_cna_context
FROM (SELECT coalesce(mut.feat, fus.feat) AS feat, coalesce(mut.ent, fus.ent) AS ent, p_mutation, max_vep_rank, p_fusion FROM mut FULL JOIN fus ON mut.feat = fus.feat AND mut.ent = fus.ent) a
FULL JOIN cna c ON a.feat = c.feat AND a.ent = c.ent""",
    "fl0": """SELECT coalesce(s.feat, p.feat) AS feat, coalesce(s.ent, p.ent) AS ent, s.score AS core_score, CASE WHEN s.score IS NULL THEN 0 ELSE 1 END AS n_layers,
  coalesce(p_mutation, 0.0) AS p_mutation, coalesce(max_vep_rank, 0) AS max_vep_rank, coalesce(p_fusion, 0.0) AS p_fusion,
  coalesce(has_cna_alteration, false) AS has_cna_alteration, coalesce(has_cna_context, false) AS cx FROM sc s FULL JOIN proof p ON s.feat = p.feat AND s.ent = p.ent""",
    "fl": """SELECT fl0.* EXCLUDE (cx), gene_role, p_mutation >= 0.5 OR p_fusion >= 0.5 OR has_cna_alteration AS has_driver_alteration,
  p_mutation > 0 OR p_fusion > 0 OR has_cna_alteration OR cx AS has_alteration,
  coalesce(gene_role IN ('tsg', 'both'), false) AND (has_cna_alteration OR (p_mutation >= 0.5 AND max_vep_rank >= 3)) AS is_lof_alteration FROM fl0 LEFT JOIN roles USING (feat)""",
    "pr": """SELECT *, CASE WHEN core_score IS NOT NULL THEN (rank() OVER (PARTITION BY feat ORDER BY core_score ASC NULLS LAST) + (count(*) OVER (PARTITION BY feat, core_score) - 1) / 2.0)
  / count(core_score) OVER (PARTITION BY feat) END AS pct FROM fl""",
    "ti": """SELECT *, CASE WHEN core_score IS NULL THEN 'NO_EVIDENCE' WHEN has_driver_alteration AND CASE WHEN is_lof_alteration AND coalesce(gene_role, '') <> 'both' THEN pct <= 1 - CAST(0.8 AS DOUBLE) ELSE pct >= 0.8 END THEN 'HIGH'
  WHEN has_driver_alteration THEN 'CONTEXT' WHEN pct >= 0.8 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_tier FROM pr""",
}


def sql(body: str, *last: str, **more: str) -> str:
    """``body`` after the expressions up to those named in ``last``, then the extra ones in order."""
    need, todo = set(), list(last)
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo += [k for k in CTES if k != name and re.search(rf"(FROM|JOIN) \(?{k}\b", CTES[name])]
    parts = [f"{k} AS ({v})" for k, v in CTES.items() if k in need] + [f"{k} AS ({v})" for k, v in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def raw(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    joined = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return joined.select(
        F.col("l_returnflag").alias("src"), F.col("l_linestatus").alias("platform"), F.col("r_name").alias("strat"), F.col("n_name").alias("sub"),
        F.col("p_brand").alias("feat"), F.col("p_type").alias("variant"), F.col("c_custkey").alias("ent"), F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        F.col("o_orderpriority").alias("prio"), log2p1(F.col("l_extendedprice")).alias("val"),
    )


def measurements_of(rows: DataFrame) -> DataFrame:
    """(src, strat, feat, ent, value, n_rep): the replicates' exact median."""
    return replicate_median(rows, ["src", "strat", "feat", "ent"], "val").withColumnRenamed("val", "value")


def measurements(spark: SparkSession, d: str) -> DataFrame:
    return measurements_of(raw(spark, d))


def measurements_by_entity(spark: SparkSession, d: str) -> DataFrame:
    """The measurements made from their own columns alone and without a stage, hashed by entity: the entities are joined
    last, so what follows per entity needs no further exchange."""
    t = lambda name, *c: table(spark, d, name).select(*c)
    lines = t("lineitem", "l_orderkey", "l_partkey", "l_returnflag", "l_extendedprice").join(t("part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    ordered = lines.join(t("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = ordered.join(entities(spark, d), F.col("o_custkey") == F.col("ent"))
    return measurements_of(joined.select(F.col("l_returnflag").alias("src"), "strat", F.col("p_brand").alias("feat"), "ent", log2p1(F.col("l_extendedprice")).alias("val")))


def z_of(m: DataFrame) -> DataFrame:
    return zscores.robust_z(m, ["src", "strat", "feat"], "value")


def z_table(spark: SparkSession, d: str) -> DataFrame:
    return z_of(measurements(spark, d))


def combined_of(m: DataFrame, lines: DataFrame) -> DataFrame:
    """(feat, ent, z_t, k_src, strat): all sources, sparse pairs shrunk."""
    z = zscores.robust_z(m, ["src", "strat", "feat"], "value")
    return combine.stouffer_by_coverage(z, "feat", "ent", "src", "z", 3).join(lines, "ent", "left")


def combined(spark: SparkSession, d: str) -> DataFrame:
    return combined_of(measurements(spark, d), entities(spark, d))


def entities(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("c_custkey").alias("ent"), F.col("r_name").alias("strat"))


def scores_of(m: DataFrame, lines: DataFrame) -> DataFrame:
    """(feat, ent, strat, k_src, score)."""
    return combined_of(m, lines).select("feat", "ent", "strat", "k_src", F.round(phi("z_t"), 6).alias("score"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return scores_of(measurements(spark, d), entities(spark, d))


def roles(spark: SparkSession, d: str) -> DataFrame:
    """(feat, gene_role) of every feature."""
    return table(spark, d, "part").select(F.col("p_brand").alias("feat"), role("p_brand").alias("gene_role")).distinct()


def role(feature: str) -> Column:
    """The role that a feature's name gives it."""
    digit = F.right(feature, F.lit(1)).cast("int")
    return F.when(digit == 1, "oncogene").when(digit == 2, "tsg").when(digit == 3, "both").otherwise("unknown")


def ordinal(prio: str = "prio") -> Column:
    return F.when(F.col(prio) == "1-URGENT", 3).when(F.col(prio) == "2-HIGH", 2).when(F.col(prio) == "3-MEDIUM", 1)


def mutations(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("platform") == "F").groupBy("feat", "ent").agg(
        F.max(F.coalesce(ordinal(), F.lit(0))).alias("max_vep_rank"), F.max(F.col("disc") * 10).alias("max_pathogenicity"), F.count("*").alias("variant_count")
    )


def fusions(rows: DataFrame) -> DataFrame:
    best = F.max(ordinal())
    word = F.when(best == 3, "high").when(best == 2, "medium").when(best == 1, "low")
    return rows.where(F.col("src") == "R").groupBy("feat", "ent").agg(
        word.alias("max_confidence"), F.max(F.col("tax") * 5).alias("best_ffpm"), F.count("*").alias("fusion_count"), F.bool_or(F.col("qty") > 40).alias("any_in_frame")
    )


def copy_numbers(rows: DataFrame) -> DataFrame:
    call = F.when(F.col("qty") > 45, "amplification").when(F.col("qty") < 5, "deletion").otherwise("neutral")
    return rows.select(
        "feat", "ent", (F.col("qty") / 10.0).alias("total_cn"), call.alias("cna_call"), ((F.col("platform") == "O") & (F.col("disc") > 0.09)).alias("is_ambiguous")
    )
