"""Queries of reshaping, joins, top-k, set operations, resolvers and the serving surface."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions.ids import ensembl_id, gene_id, lower_label, nan_to_null, upper_id
from gneiss.functions.stats import clip, correlation, log2p1, score_band, selectivity, strict_min
from gneiss.operators import aggregates, audits, combine, evidence, ranks, reshape, resolve, serving, skew
from gneiss.operators.zscores import plain_z
from gneiss.plans import roles
from gneiss.plans.registry import Registry
from gneiss.plans.roles import FEATURES, sql
from gneiss.plans.scoring import _PAIRED, _WIDE_Z, flags, paired, r6, wide_z
from gneiss.plans.stage import stage
from gneiss.session import checkpoint_dir, table
from gneiss.sources import readers, writers

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
A, B, C = FEATURES
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "gene_lookup", "cell_line_lookup")


# ------------------------------------------------------------------ scans, sources, sinks


@query("SELECT c_custkey, c_mktsegment, CAST(NULL AS VARCHAR) AS c_phone FROM customer")
def s01_projected_scan(spark: SparkSession, d: str) -> DataFrame:
    """Only the named columns are read; an optional column that is absent comes out NULL."""
    return readers.parquet(spark, f"{d}/customer.parquet", ["c_custkey", "c_mktsegment"], ["c_phone"])


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderpriority = '1-URGENT'")
def s05_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Both predicates compare stored values, so they reach the scan."""
    o = table(spark, d, "orders").where((F.col("o_custkey") == 7) & (F.col("o_orderpriority") == "1-URGENT"))
    return o.select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


def folder_of(spark: SparkSession) -> str:
    base = checkpoint_dir(spark).removeprefix("file:")
    return tempfile.mkdtemp(dir=base) if os.path.isdir(base) else f"{base.rstrip('/')}/{os.urandom(8).hex()}"


@query("SELECT CAST(n_nationkey AS VARCHAR) AS entity, 'n_regionkey' AS feature, CAST(n_regionkey AS DOUBLE) AS value FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'twice', n_nationkey * 2.0 FROM nation")
def s06_wide_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A wide table written as CSV and read back as long rows."""
    path = folder_of(spark) + "/wide.csv"
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", (F.col("n_nationkey") * 2).alias("twice"))
    writers.csv_report(n, path)
    return readers.wide_delimited(spark, path, "entity")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def s15_clustered_parquet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The orders range-clustered by customer and read back."""
    path = folder_of(spark) + "/orders"
    writers.clustered(table(spark, d, "orders"), path, ["o_custkey"])
    return spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s16_idempotent_append(spark: SparkSession, d: str) -> DataFrame:
    """Two batches, the second of them twice: nothing is doubled."""
    path = folder_of(spark) + "/events"
    e = table(spark, d, "events").select("event_id", "event_type")
    odd = F.pmod("event_id", F.lit(2)) == 1
    for batch, part in ((0, e.where(~odd)), (1, e.where(odd)), (1, e.where(odd))):
        writers.append_once(part, path, "batch", batch)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT r_regionkey, r_name FROM region")
def s18_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = folder_of(spark) + "/region"
    r = table(spark, d, "region")
    writers.json_report(r, path)
    return spark.read.schema(r.schema).json(path)


@query("SELECT table_name, column_name FROM (SELECT 'region' AS table_name, unnest(['r_regionkey', 'r_name']) AS column_name UNION ALL SELECT 'nation', unnest(['n_nationkey', 'n_name', 'n_regionkey']))")
def s20_catalog(spark: SparkSession, d: str) -> DataFrame:
    return readers.catalog(spark, {t: table(spark, d, t) for t in ("region", "nation")}).select("table_name", "column_name")


@query("SELECT 'nation' AS name, count(*) AS n FROM nation")
def s23_write_if_absent(spark: SparkSession, d: str) -> DataFrame:
    path = folder_of(spark) + "/nation"
    made = writers.cached(spark, path, lambda: table(spark, d, "nation"))
    again = writers.cached(spark, path, lambda: made.limit(0))
    return again.agg(F.lit("nation").alias("name"), F.count("*").alias("n"))


@query()
def s25_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Hash and size of every input file of one table."""
    return readers.manifest(spark, f"{d}/nation.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*), 6) AS missing_share, count(DISTINCT CAST({c} AS VARCHAR)) AS n_distinct, count(DISTINCT CAST({c} AS VARCHAR)) = count(*) AS is_unique FROM cell_line_lookup"
    for c in ("model_id", "cell_line_name", "synonyms", "lineage", "cvcl_accession")
)


@query(_PROFILE)
def s27_column_profile(spark: SparkSession, d: str) -> DataFrame:
    got = aggregates.profile(table(spark, d, "cell_line_lookup"), ["model_id", "cell_line_name", "synonyms", "lineage", "cvcl_accession"])
    return got.select("column_name", "n_rows", "n_missing", *r6("missing_share"), "n_distinct", "is_unique")


# ------------------------------------------------------------------ reshape and filter


@query("SELECT o_orderkey, 'l1' AS feature, round(o_totalprice, 2) AS value FROM orders UNION ALL SELECT o_orderkey, 'l2', CAST(o_custkey AS DOUBLE) FROM orders WHERE o_custkey > 100")
def r01_melt(spark: SparkSession, d: str) -> DataFrame:
    """Wide to long; NULL cells give no row."""
    o = table(spark, d, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("l1"), F.when(F.col("o_custkey") > 100, F.col("o_custkey").cast("double")).alias("l2"))
    return reshape.melt(o, ["o_orderkey"], ["l1", "l2"])


@query(sql("SELECT feat, ent, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM wide", "m", **_PAIRED))
def r04_pivot_by_source(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).select("feat", "ent", *r6("a", "b", "c"))


@query(sql("SELECT feat, ent, src, count(*) AS n FROM raw GROUP BY ALL HAVING count(*) > 1", "raw"))
def r04_pivot_violations(spark: SparkSession, d: str) -> DataFrame:
    return reshape.duplicates(roles.raw(spark, d), ["feat", "ent", "src"])


@query(sql("SELECT c_custkey AS ent, round(value, 6) AS value FROM customer LEFT JOIN (SELECT ent, value FROM m WHERE src = 'R' AND feat = 'Brand#11') ON c_custkey = ent", "m"))
def r08_align_to_axis(spark: SparkSession, d: str) -> DataFrame:
    m = roles.measurements(spark, d).where((F.col("src") == "R") & (F.col("feat") == A)).select("ent", "value")
    return reshape.align(table(spark, d, "customer").select(F.col("c_custkey").alias("ent")), m, ["ent"]).select("ent", *r6("value"))


@query(f"SELECT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('{A}', '{B}', '{C}')")
def r10_membership(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "lineitem").join(table(spark, d, "part").where(F.col("p_brand").isin(*FEATURES)), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("l_orderkey", "p_brand")


@query("SELECT model_id, lineage FROM cell_line_lookup WHERE contains(lower(lineage), 'l') OR contains(lower(synonyms), 'l')")
def r12_contains_any(spark: SparkSession, d: str) -> DataFrame:
    return reshape.contains_any(table(spark, d, "cell_line_lookup"), ["lineage", "synonyms"], ["L"]).select("model_id", "lineage")


@query("SELECT model_id FROM cell_line_lookup")
def r12_contains_none_keeps_all(spark: SparkSession, d: str) -> DataFrame:
    """No match means no filter, as the service has it."""
    return reshape.contains_any(table(spark, d, "cell_line_lookup"), ["lineage"], ["no such lineage"]).select("model_id")


@query("SELECT model_id FROM cell_line_lookup WHERE false")
def r13_contains_none_keeps_none(spark: SparkSession, d: str) -> DataFrame:
    """No match means an empty result, as the command line has it."""
    return reshape.contains_any(table(spark, d, "cell_line_lookup"), ["lineage"], ["no such lineage"], "none").select("model_id")


@query("SELECT row_id, map_location, coalesce(starts_with(map_location, '1'), false) AS on_one FROM gene_lookup_join_loss")
def r15_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gene_lookup_join_loss").select("row_id", "map_location", F.coalesce(F.col("map_location").startswith("1"), F.lit(False)).alias("on_one"))


@query("SELECT c_custkey, greatest(-100.0, least(c_acctbal, 5000.0)) AS clipped, CASE WHEN c_acctbal >= 5000 THEN 'high' WHEN c_acctbal >= 0 THEN 'mid' ELSE 'low' END AS band FROM customer")
def r17_clip_and_band(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", clip(b, -100.0, 5000.0).alias("clipped"), score_band(b, 5000, 0, ("high", "mid", "low")).alias("band"))


@query(sql("SELECT feat, ent, CASE WHEN gene_role = 'tsg' AND lower(c_mktsegment) IN ('machinery', 'unknown') THEN NULL ELSE score END AS score FROM sc JOIN roles USING (feat) JOIN customer ON ent = c_custkey", "sc", "roles"))
def r18_structural_absence(spark: SparkSession, d: str) -> DataFrame:
    s = roles.scores(spark, d).join(roles.roles(spark, d), "feat").join(table(spark, d, "customer").select(F.col("c_custkey").alias("ent"), "c_mktsegment"), "ent")
    return reshape.structurally_absent(s, "score", F.col("gene_role") == "tsg", F.col("c_mktsegment"), ["machinery", "unknown"]).select("feat", "ent", "score")


@query("SELECT row_id, nullif(regexp_extract(upper(trim(gene_id)), '^(ENSG[0-9]+)(\\.[0-9]+)?$', 1), '') AS ensg, CASE WHEN NOT isnan(log2_value) THEN log2_value END AS value FROM expr_long")
def r21_canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "expr_long").select("row_id", ensembl_id(F.col("gene_id")).alias("ensg"), nan_to_null(F.col("log2_value")).alias("value"))


_GENES = {
    "g_expr": "SELECT DISTINCT regexp_replace(upper(trim(gene_id)), '^(ENSG[0-9]+)\\.[0-9]+$', '\\1') AS g FROM expr_long",
    "g_geo": "SELECT DISTINCT regexp_replace(upper(trim(gene_id)), '^(ENSG[0-9]+)\\.[0-9]+$', '\\1') AS g FROM geo_values",
    "g_all": "SELECT upper(ensg_id) AS g FROM gene_lookup",
}


def _gene_sets(spark: SparkSession, d: str) -> list[DataFrame]:
    got = [table(spark, d, t).select(gene_id(F.col("gene_id")).alias("g")) for t in ("expr_long", "geo_values")]
    return [*got, table(spark, d, "gene_lookup").select(F.upper("ensg_id").alias("g"))]


@query(sql("SELECT g FROM g_expr INTERSECT SELECT g FROM g_geo INTERSECT SELECT g FROM g_all", **_GENES))
def r23_universe_common(spark: SparkSession, d: str) -> DataFrame:
    return reshape.universe_common(_gene_sets(spark, d))


@query(sql("SELECT g FROM (SELECT g FROM g_expr UNION SELECT g FROM g_geo) WHERE g IN (SELECT g FROM g_all)", **_GENES))
def r24_universe_any(spark: SparkSession, d: str) -> DataFrame:
    a, b, roster = _gene_sets(spark, d)
    return reshape.universe_any([a, b], roster, "g")


@query(sql("SELECT feat, count(*) AS n FROM m WHERE feat IN (SELECT feat FROM m GROUP BY feat HAVING 1 - count(DISTINCT ent) * 1.0 / (SELECT count(DISTINCT ent) FROM m) <= 0.25) GROUP BY feat", "m"))
def r25_dense_features(spark: SparkSession, d: str) -> DataFrame:
    return reshape.keep_dense_features(roles.measurements(spark, d), "feat", "ent", "value", 0.25).groupBy("feat").agg(F.count("*").alias("n"))


@query(sql("SELECT feat, round(v, 6) AS variance FROM (SELECT feat, var_samp(value) AS v FROM m GROUP BY feat) WHERE v > 0 ORDER BY v DESC, feat LIMIT 10", "m"))
def r26_top_variance(spark: SparkSession, d: str) -> DataFrame:
    return reshape.top_variance(roles.measurements(spark, d), "feat", "value", 10).select("feat", *r6("variance"))


@query(sql("SELECT feat, round(stddev_samp(value), 6) AS sd, round(avg(value), 6) AS mean FROM m GROUP BY feat HAVING stddev_samp(value) > 0.2 AND avg(value) > -0.75", "m"))
def r27_selective_features(spark: SparkSession, d: str) -> DataFrame:
    return reshape.selective_features(roles.measurements(spark, d), "feat", "value").select("feat", *r6("sd", "mean"))


# ------------------------------------------------------------------ joins and resolvers


@query(sql("SELECT feat, ent, min(CASE WHEN src IN ('A', 'N', 'R') THEN value END) AS low, count(DISTINCT src) AS k FROM m GROUP BY feat, ent HAVING count(DISTINCT src) = 3", "m").replace("min(CASE WHEN src IN ('A', 'N', 'R') THEN value END) AS low", "round(min(value), 6) AS low"))
def j03_all_sources(spark: SparkSession, d: str) -> DataFrame:
    """The N-way inner join as one aggregation: pairs that every source has."""
    got = roles.measurements(spark, d).groupBy("feat", "ent").agg(F.round(F.min("value"), 6).alias("low"), F.count_distinct("src").alias("k"))
    return got.where(F.col("k") == 3)


@query(sql("SELECT mut.feat, mut.ent FROM mut WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.feat = mut.feat AND m.ent = mut.ent AND src = 'N')", "mut", "m"))
def j04_orphan_pairs(spark: SparkSession, d: str) -> DataFrame:
    seen = roles.measurements(spark, d).where(F.col("src") == "N").select("feat", "ent")
    return roles.mutations(stage(spark, d, "raw")).select("feat", "ent").join(seen, ["feat", "ent"], "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j05_semi_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query(sql("SELECT count(*) FILTER (WHERE a.ent IS NOT NULL AND b.ent IS NOT NULL) AS both, count(*) FILTER (WHERE b.ent IS NULL) AS left_only, count(*) FILTER (WHERE a.ent IS NULL) AS right_only FROM (SELECT DISTINCT feat, ent FROM m WHERE src = 'A') a FULL JOIN (SELECT DISTINCT feat, ent FROM m WHERE src = 'R') b ON a.feat = b.feat AND a.ent = b.ent", "m").replace("AS both", 'AS "both"'))
def j06_outer_join_audit(spark: SparkSession, d: str) -> DataFrame:
    m = roles.measurements(spark, d)
    return resolve.presence(m.where(F.col("src") == "A"), m.where(F.col("src") == "R"), ["feat", "ent"])


@query("""SELECT o_custkey AS k, arg_max(l_suppkey, (l_shipdate, -l_suppkey)) AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def j09_bridge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("m"))
    second = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("m"), F.col("l_suppkey").alias("t"), "l_shipdate")
    both = first.join(second, "m")
    return reshape.first_of_each(both, ["k"], [F.desc("l_shipdate"), F.asc("t")]).select("k", "t")


_LINES = {
    "nm": """SELECT model_id AS entity, regexp_replace(lower(n), '[^a-z0-9]+', '', 'g') AS name, kind, rung FROM (
  SELECT model_id, cell_line_name AS n, 'name' AS kind, 0 AS rung FROM cell_line_lookup UNION ALL SELECT model_id, stripped_cell_line_name, 'stripped', 1 FROM cell_line_lookup
  UNION ALL SELECT model_id, unnest(string_split(synonyms, '|')), 'synonym', 2 FROM cell_line_lookup UNION ALL SELECT model_id, cvcl_accession, 'accession', 3 FROM cell_line_lookup) WHERE n IS NOT NULL AND trim(n) <> ''""",
    "qs": "SELECT row_id, regexp_replace(lower(hpa_name), '[^a-z0-9]+', '', 'g') AS name FROM no_depmap_equivalent_hpa_rna",
    "ht": "SELECT row_id, entity, kind, rung, min(rung) OVER (PARTITION BY row_id) AS best FROM qs JOIN nm USING (name)",
    "kp": "SELECT DISTINCT row_id, entity, kind FROM ht WHERE rung = best",
}


def line_names(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cell_line_lookup")
    one = lambda c: F.array(resolve.squeezed(F.col(c)))
    listed = F.transform(F.split("synonyms", r"\|"), resolve.squeezed)
    return resolve.names_long(t, "model_id", [("name", one("cell_line_name")), ("stripped", one("stripped_cell_line_name")), ("synonym", listed), ("accession", one("cvcl_accession"))])


@query(sql("SELECT DISTINCT qs.row_id, entity, kind AS matched_via, coalesce(count(DISTINCT entity) OVER (PARTITION BY qs.row_id) > 1, false) AS is_ambiguous FROM qs LEFT JOIN kp ON qs.row_id = kp.row_id", **_LINES).replace("count(DISTINCT entity) OVER (PARTITION BY qs.row_id) > 1", "(SELECT count(DISTINCT k2.entity) FROM kp k2 WHERE k2.row_id = qs.row_id) > 1"))
def j12_resolve_by_rungs(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_by_rungs(table(spark, d, "no_depmap_equivalent_hpa_rna"), "row_id", resolve.squeezed(F.col("hpa_name")), line_names(spark, d))


_SYMBOLS = {
    "sy": """SELECT ensg_id AS entity, upper(trim(n)) AS name, kind, rung FROM (SELECT ensg_id, hgnc_symbol AS n, 'symbol' AS kind, 0 AS rung FROM gene_lookup
  UNION ALL SELECT ensg_id, unnest(string_split(prev_symbols, '|')), 'previous', 1 FROM gene_lookup UNION ALL SELECT ensg_id, unnest(string_split(alias_symbols, '|')), 'alias', 2 FROM gene_lookup) WHERE n IS NOT NULL AND trim(n) <> ''"""
}


def symbols(spark: SparkSession, d: str) -> DataFrame:
    listed = lambda c: F.transform(F.split(c, r"\|"), lambda x: F.upper(F.trim(x)))
    return resolve.names_long(table(spark, d, "gene_lookup"), "ensg_id", [("symbol", F.array(upper_id(F.col("hgnc_symbol")))), ("previous", listed("prev_symbols")), ("alias", listed("alias_symbols"))])


@query(sql("SELECT name, count(DISTINCT entity) AS n_entities FROM sy GROUP BY name HAVING count(DISTINCT entity) > 1", **_SYMBOLS))
def j14_symbol_collisions(spark: SparkSession, d: str) -> DataFrame:
    return resolve.collisions(symbols(spark, d)).select("name", "n_entities")


@query(sql("SELECT name, min(entity) AS entity FROM sy GROUP BY name HAVING count(DISTINCT entity) = 1", **_SYMBOLS))
def j15_unambiguous_aliases(spark: SparkSession, d: str) -> DataFrame:
    return resolve.unambiguous(symbols(spark, d))


@query(sql("SELECT query_id, entity, kind FROM (SELECT query_id, upper(trim(query)) AS name FROM gene_alias_result) JOIN (SELECT name, entity, kind FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rung, entity) AS k FROM sy) WHERE k = 1) USING (name)", **_SYMBOLS))
def j16_alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "gene_alias_result").select("query_id", upper_id(F.col("query")).alias("name"))
    return asked.join(resolve.first_wins(symbols(spark, d)), "name").select("query_id", "entity", "kind")


_KEYS = {
    "cols": "SELECT 'customer.c_custkey' AS c, CAST(c_custkey AS VARCHAR) AS v FROM customer UNION SELECT 'orders.o_custkey', CAST(o_custkey AS VARCHAR) FROM orders UNION SELECT 'orders.o_orderkey', CAST(o_orderkey AS VARCHAR) FROM orders UNION SELECT 'lineitem.l_orderkey', CAST(l_orderkey AS VARCHAR) FROM lineitem UNION SELECT 'nation.n_name', n_name FROM nation",
    "ns": "SELECT c, count(*) AS n FROM cols GROUP BY c",
    "shd": "SELECT a.c AS a, b.c AS b, count(*) AS n FROM cols a JOIN cols b ON a.v = b.v AND a.c < b.c GROUP BY ALL",
}


@query(sql("SELECT a, b, x.n AS n_a, y.n AS n_b, shd.n AS n_shared FROM shd JOIN ns x ON a = x.c JOIN ns y ON b = y.c WHERE shd.n >= 5 AND shd.n >= 0.05 * least(x.n, y.n)", **_KEYS))
def j19_join_discovery(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, c in (("customer", "c_custkey"), ("orders", "o_custkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("nation", "n_name")):
        part = table(spark, d, t).select(F.lit(f"{t}.{c}").alias("column_name"), F.col(c).cast("string").alias("value"))
        out = part if out is None else out.unionByName(part)
    return resolve.overlap_pairs(out)


_CASES = """WITH b AS (SELECT c_custkey, c_nationkey, CAST(floor(c_acctbal / 2000) AS BIGINT) AS band, u FROM customer JOIN (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1) ON o_custkey = c_custkey),
k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, band, u ORDER BY CAST('0x' || substr(md5(concat_ws('/', 0, c_custkey)), 1, 12) AS BIGINT), c_custkey) AS k FROM b)
"""


@query(_CASES + 'SELECT a.c_nationkey, a.band, a.c_custkey AS "case", o.c_custkey AS control FROM k a JOIN k o ON a.c_nationkey = o.c_nationkey AND a.band = o.band AND a.k = o.k WHERE a.u AND NOT o.u')
def j21_matched_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Urgent and low-priority customers paired within nation and balance band, none twice."""
    c = table(spark, d, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 2000))
    urgent = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    both = c.join(urgent, F.col("c_custkey") == F.col("o_custkey"))
    return resolve.matched_pairs(both.where("u"), both.where("NOT u"), "c_custkey", ["c_nationkey", "band"])


@query("SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 6) AS mean, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def j02_spread_join(spark: SparkSession, d: str) -> DataFrame:
    """A lookup join whose hot keys are spread by a salt."""
    left = table(spark, d, "customer").withColumnRenamed("c_nationkey", "k")
    right = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    got = skew.spread_join(left, right, "k", "inner", "c_custkey").groupBy(F.col("k").alias("c_nationkey"), "n_name")
    return got.agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"))


# ------------------------------------------------------------------ set operations


@query(sql("SELECT in_A, in_N, in_R, count(*) AS n FROM (SELECT ent, bool_or(src = 'A') AS in_A, bool_or(src = 'N') AS in_N, bool_or(src = 'R') AS in_R FROM m WHERE feat = 'Brand#11' GROUP BY ent) GROUP BY ALL", "m"))
def u05_venn(spark: SparkSession, d: str) -> DataFrame:
    return resolve.venn(roles.measurements(spark, d).where(F.col("feat") == A), "ent", "src", ["A", "N", "R"])


@query("SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def u04_except(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    keys = lambda p: o.where(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("k"))
    return keys("1-URGENT").subtract(keys("5-LOW"))


@query("SELECT n_nationkey AS k, n_name AS name, NULL::INTEGER AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 1 FROM region")
def u01_union_all_by_name(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    r = table(spark, d, "region").select(F.lit(1).alias("extra"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("k"))
    return n.unionByName(r, allowMissingColumns=True)


# ------------------------------------------------------------------ serving


def _score(spark: SparkSession, d: str) -> tuple:
    return stage(spark, d, "scores"), "feat", "ent", "score"


@query(sql(f"SELECT ent, score FROM sc WHERE feat = '{A}' AND score IS NOT NULL ORDER BY score DESC, ent LIMIT 20", "sc"))
def q01_rank_one(spark: SparkSession, d: str) -> DataFrame:
    s, *names = _score(spark, d)
    return serving.rank_one(s, A, *names, 20)


_JOINT = {
    "jw": f"SELECT ent, max(CASE WHEN feat = '{A}' THEN score END) AS s0, max(CASE WHEN feat = '{B}' THEN score END) AS s1, max(CASE WHEN feat = '{C}' THEN score END) AS s2 FROM sc WHERE feat IN ('{A}', '{B}', '{C}') GROUP BY ent",
    "jj": f"SELECT *, least(s0, s1, s2) AS joint_score, CASE WHEN s0 <= s1 AND s0 <= s2 THEN '{A}' WHEN s1 <= s2 THEN '{B}' ELSE '{C}' END AS limiting FROM jw WHERE s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL",
}


@query(sql("SELECT ent, s0, s1, s2, joint_score, limiting, (SELECT count(*) FROM jj WHERE joint_score >= 0.2) AS total_passing FROM jj WHERE joint_score >= 0.2 ORDER BY joint_score DESC, ent LIMIT 20", "sc", **_JOINT))
def q02_joint_rank(spark: SparkSession, d: str) -> DataFrame:
    s, *names = _score(spark, d)
    return serving.rank_joint(s, FEATURES, *names, floor=0.2)


def _excluding(k: int, low: str, rest: str) -> str:
    return sql(f"SELECT ent, round({low}, 6) AS wanted_score, round({low} * {rest}, 6) AS selectivity FROM jw WHERE {low} * {rest} IS NOT NULL{' AND ' + low + ' >= 0.3' if k == 5 else ''} ORDER BY {low} * {rest} DESC, ent LIMIT 20", "sc", **_JOINT)


@query(_excluding(3, "s0", "(1 - s1)"))
def q03_exclude(spark: SparkSession, d: str) -> DataFrame:
    s, *names = _score(spark, d)
    return serving.rank_excluding(s, [A], [B], *names).select("ent", *r6("wanted_score", "selectivity"))


@query(_excluding(4, "s0", "(1 - s1) * (1 - s2)"))
def q04_exclude_many(spark: SparkSession, d: str) -> DataFrame:
    s, *names = _score(spark, d)
    return serving.rank_excluding(s, [A], [B, C], *names).select("ent", *r6("wanted_score", "selectivity"))


@query(_excluding(5, "(CASE WHEN s0 IS NOT NULL AND s1 IS NOT NULL THEN least(s0, s1) END)", "(1 - s2)"))
def q05_joint_and_exclude(spark: SparkSession, d: str) -> DataFrame:
    s, *names = _score(spark, d)
    return serving.rank_excluding(s, [A, B], [C], *names, floor=0.3).select("ent", *r6("wanted_score", "selectivity"))


def _grouped(metric: str) -> str:
    return sql(
        """SELECT ent, strat, metric, rank_within, rank_global FROM (SELECT *, dense_rank() OVER (ORDER BY best DESC, strat) AS g FROM (SELECT *, max(metric) OVER (PARTITION BY strat) AS best,
row_number() OVER (PARTITION BY strat ORDER BY metric DESC, ent) AS rank_within, rank() OVER (ORDER BY metric DESC) AS rank_global FROM mt WHERE metric IS NOT NULL)) WHERE g <= 3 AND rank_within <= 5""",
        "sc", **_JOINT, mt=metric,
    )


def _by_stratum(spark: SparkSession, d: str, metric: DataFrame) -> DataFrame:
    known = metric if "strat" in metric.columns else metric.join(roles.entities(spark, d), "ent")
    return serving.grouped_top(known, "ent", "strat", "metric", 3, 5)


_ENTS = "JOIN (SELECT c_custkey AS ent, r_name AS strat FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) e USING (ent)"


@query(_grouped(f"SELECT ent, strat, score AS metric FROM sc WHERE feat = '{A}'"))
def q06_rank_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    return _by_stratum(spark, d, stage(spark, d, "scores").where(F.col("feat") == A).select("ent", "strat", F.col("score").alias("metric")))


@query(_grouped(f"SELECT ent, strat, joint_score AS metric FROM jj {_ENTS}"))
def q07_joint_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    s, *names = _score(spark, d)
    return _by_stratum(spark, d, serving.joint(s, FEATURES, *names, tie_order="alphabetical").select("ent", F.col("joint_score").alias("metric")))


def _selective(spark: SparkSession, d: str, wanted: list[str], unwanted: list[str]) -> DataFrame:
    s, *names = _score(spark, d)
    wide = serving.by_feature(s, [*wanted, *unwanted], *names)
    return _by_stratum(spark, d, wide.select("ent", F.round(_product(len(wanted), len(unwanted)), 9).alias("metric")))


def _product(wanted: int, unwanted: int) -> Column:
    return selectivity(strict_min([F.col(f"s{i}") for i in range(wanted)]), [F.col(f"s{wanted + i}") for i in range(unwanted)])


@query(_grouped(f"SELECT ent, strat, round(s0 * (1 - s1), 9) AS metric FROM jw {_ENTS}"))
def q08_exclude_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    return _selective(spark, d, [A], [B])


@query(_grouped(f"SELECT ent, strat, round(s0 * (1 - s1) * (1 - s2), 9) AS metric FROM jw {_ENTS}"))
def q09_exclude_many_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    return _selective(spark, d, [A], [B, C])


@query(_grouped(f"SELECT ent, strat, round(CASE WHEN s0 IS NOT NULL AND s1 IS NOT NULL THEN least(s0, s1) END * (1 - s2), 9) AS metric FROM jw {_ENTS}"))
def q10_joint_exclude_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    return _selective(spark, d, [A, B], [C])


@query(sql(f"SELECT ent, score, 1 + (SELECT count(*) FROM sc x WHERE x.feat = '{A}' AND x.score > sc.score) AS rank, (SELECT count(*) FROM sc x WHERE x.feat = '{A}') AS total FROM sc WHERE feat = '{A}' AND ent = 7", "sc"))
def q11_detail(spark: SparkSession, d: str) -> DataFrame:
    s, *names = _score(spark, d)
    return serving.detail(s, A, 7, *names)


@query("SELECT model_id, cell_line_name, lineage, len(string_split(coalesce(synonyms, ''), '|')) AS n FROM cell_line_lookup")
def q13_list_dimension(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cell_line_lookup").select("model_id", "cell_line_name", "lineage", F.size(F.split(F.coalesce("synonyms", F.lit("")), r"\|")).cast("long").alias("n"))


@query(sql("SELECT ent, round(value, 6) AS value FROM m WHERE feat = 'Brand#11' AND src = 'A' AND value > 15 ORDER BY value DESC, ent LIMIT 15", "m"))
def q16_candidates_by_value(spark: SparkSession, d: str) -> DataFrame:
    m = stage(spark, d, "measurements").where((F.col("feat") == A) & (F.col("src") == "A") & (F.col("value") > 15))
    return m.orderBy(F.desc("value"), "ent").limit(15).select("ent", *r6("value"))


_TERMS = {
    "tq": f"""SELECT ent, CASE WHEN abs(x - 15.5) > 0.2 THEN x > 15.5 END AS t1, CASE WHEN abs(y - 15.5) > 0.2 THEN y > 15.5 END AS t2, NOT z > 16 AS t3 FROM (SELECT ent, max(CASE WHEN feat = '{A}' THEN value END) AS x, max(CASE WHEN feat = '{B}' THEN value END) AS y, max(CASE WHEN feat = '{C}' THEN value END) AS z FROM m GROUP BY ent)""",
    "sq": "SELECT *, t1 AND t2 AND t3 AS verdict, CASE WHEN (t1 AND t2 AND t3) IS NULL THEN 'Possible' WHEN t1 AND t2 AND t3 THEN 'Matches' ELSE 'Excluded' END AS bucket FROM tq",
}


def answers(spark: SparkSession, d: str) -> DataFrame:
    wide = serving.by_feature(stage(spark, d, "measurements"), FEATURES, "feat", "ent", "value")
    everyone = stage(spark, d, "measurements").select("ent").distinct()
    all_rows = everyone.join(wide, "ent", "left")
    terms = {"t1": serving.truth(F.col("s0"), 15.5, 0.2), "t2": serving.truth(F.col("s1"), 15.5, 0.2), "t3": ~serving.truth(F.col("s2"), 16)}
    return serving.set_query(all_rows, "ent", terms)


@query(sql("SELECT ent, t1, t2, t3, verdict, bucket, array_to_string(list_filter([CASE WHEN coalesce(t1, false) THEN NULL ELSE 't1' END, CASE WHEN coalesce(t2, false) THEN NULL ELSE 't2' END, CASE WHEN coalesce(t3, false) THEN NULL ELSE 't3' END], lambda x: x IS NOT NULL), ',') AS blame FROM sq", "m", **_TERMS))
def q19_three_valued_query(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).withColumn("blame", F.array_join("blame", ","))


@query(sql(f"SELECT strat, count(*) FILTER (WHERE bucket = 'Matches') AS \"Matches\", count(*) FILTER (WHERE bucket = 'Possible') AS \"Possible\", count(*) FILTER (WHERE bucket = 'Excluded') AS \"Excluded\" FROM sq {_ENTS} GROUP BY strat", "m", **_TERMS))
def q21_buckets_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    return serving.bucket_counts(answers(spark, d).join(roles.entities(spark, d), "ent"), "strat")


@query(sql("SELECT count(*) AS n, count(*) FILTER (WHERE t1 IS NOT NULL AND t2 IS NOT NULL AND t3 IS NOT NULL) AS n_joint, count(t1) AS n_t1, count(t2) AS n_t2, count(t3) AS n_t3, round((count(*) FILTER (WHERE t1 IS NOT NULL AND t2 IS NOT NULL AND t3 IS NOT NULL) / count(*)) / (count(t1) / count(*) * count(t2) / count(*) * count(t3) / count(*)), 6) AS independence_ratio FROM sq", "m", **_TERMS))
def q17_coverage(spark: SparkSession, d: str) -> DataFrame:
    return serving.coverage(answers(spark, d), ["t1", "t2", "t3"]).select("n", "n_joint", "n_t1", "n_t2", "n_t3", *r6("independence_ratio"))


_PAIRSCORE = f"SELECT round(corr(s0, s1), 6) AS r01, round(corr(s0, s2), 6) AS r02, round(corr(s1, s2), 6) AS r12, coalesce(abs(corr(s0, s1)) > 0.7, false) AS redundant FROM jw"


@query(sql(_PAIRSCORE, "sc", **_JOINT))
def q22_redundancy(spark: SparkSession, d: str) -> DataFrame:
    s, *names = _score(spark, d)
    w = serving.by_feature(s, FEATURES, *names)
    r = correlation("s0", "s1")
    return w.agg(F.round(r, 6).alias("r01"), F.round(correlation("s0", "s2"), 6).alias("r02"), F.round(correlation("s1", "s2"), 6).alias("r12"), F.coalesce(F.abs(r) > 0.7, F.lit(False)).alias("redundant"))


@query(sql(f"SELECT ent, dense_rank() OVER (ORDER BY confirms DESC, v1 DESC NULLS LAST, contradicts) AS band FROM ev", "m", ev=f"SELECT ent, count(*) FILTER (WHERE value > 15.5) AS confirms, max(CASE WHEN feat = '{A}' THEN CAST(value > 16 AS INTEGER) END) AS v1, count(*) FILTER (WHERE value < 14) AS contradicts FROM m GROUP BY ent"))
def k10_evidence_bands(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    e = stage(spark, d, "measurements").groupBy("ent").agg(F.count_if(v > 15.5).alias("confirms"), F.max(F.when(F.col("feat") == A, (v > 16).cast("int"))).alias("v1"), F.count_if(v < 14).alias("contradicts"))
    return serving.evidence_order(e, "confirms", ["v1"], "contradicts").select("ent", "band")


@query("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25")
def k01_top_n(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(25).select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


# ------------------------------------------------------------------ operators of the documents only


@query(sql("SELECT ent, feat, round((coalesce(a * 0.5, 0) + coalesce(b * 0.3, 0) + coalesce(c * 0.2, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.5 END + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END, 0), 6) AS score FROM wz", "z", **_WIDE_Z))
def d02_weighted_layers(spark: SparkSession, d: str) -> DataFrame:
    w = combine.weighted_present({k: F.col(k) for k in "abc"}, {"a": 0.5, "b": 0.3, "c": 0.2})
    return wide_z(spark, d).select("ent", "feat", F.round(w, 6).alias("score"))


@query(sql("SELECT feat, k_src, ent, round((rank() OVER (PARTITION BY feat, k_src ORDER BY score) + (count(*) OVER (PARTITION BY feat, k_src, score) - 1) / 2.0) / count(*) OVER (PARTITION BY feat, k_src), 9) AS pct FROM sc", "sc"))
def d03_percentile_by_layers(spark: SparkSession, d: str) -> DataFrame:
    return roles.scores(spark, d).select("feat", "k_src", "ent", F.round(ranks.percentile_rank(["feat", "k_src"], "score"), 9).alias("pct"))


@query(sql("SELECT feat, ent, CASE WHEN gene_role = 'tsg' THEN round(1 - score, 6) ELSE score END AS score FROM sc JOIN roles USING (feat)", "sc", "roles"))
def d04_inverted_suppressors(spark: SparkSession, d: str) -> DataFrame:
    s = roles.scores(spark, d).join(roles.roles(spark, d), "feat")
    return s.select("feat", "ent", F.when(F.col("gene_role") == "tsg", F.round(1 - F.col("score"), 6)).otherwise(F.col("score")).alias("score"))


@query(sql("SELECT feat, strat, count(*) AS n, round(sqrt(ln(2 / 0.05) / (2 * count(*))), 9) AS dkw_band FROM sc GROUP BY ALL", "sc"))
def d06_dkw_band(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return roles.scores(spark, d).groupBy("feat", "strat").agg(n.alias("n"), F.round(F.sqrt(F.ln(F.lit(2 / 0.05)) / (2 * n)), 9).alias("dkw_band"))


@query(sql("SELECT feat, round(power(sum(n_rep), 2) / sum(n_rep * n_rep) / (1 + (power(sum(n_rep), 2) / sum(n_rep * n_rep) - 1) * 0.1), 6) AS n_eff FROM m GROUP BY feat", "m"))
def d07_correlated_effective_size(spark: SparkSession, d: str) -> DataFrame:
    n = aggregates.effective_size("n_rep")
    return roles.measurements(spark, d).groupBy("feat").agg(F.round(n / (1 + (n - 1) * 0.1), 6).alias("n_eff"))


@query("""WITH e AS (SELECT event_type, user_id, min(value) / 1000 AS p FROM events GROUP BY ALL),
r AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, (SELECT sum(1.0::DOUBLE / i) FROM (SELECT unnest(generate_series(1, (SELECT count(*) FROM e))) AS i)) AS h,
  least(1.0, (1 + (SELECT count(*) FROM e WHERE p > 0.5)) / (0.5 * (SELECT count(*) FROM e))) AS pi0 FROM e)
SELECT event_type, user_id, round(p, 9) AS p, round(least(1.0, min(p * m / r) OVER w), 9) AS q, round(least(1.0, min(p * m * h / r) OVER w), 9) AS q_by, round(least(1.0, min(p * m * pi0 / r) OVER w), 9) AS q_storey
FROM r WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""")
def d08_false_discovery_rate(spark: SparkSession, d: str) -> DataFrame:
    """Step-up rates under independence, under any dependence, and with the estimated share of true nulls."""
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg((F.min("value") / 1000).alias("p"))
    for out, method in (("q", "bh"), ("q_by", "by"), ("q_storey", "storey")):
        e = audits.false_discovery(e, "p", out, method)
    return e.select("event_type", "user_id", *[F.round(c, 9).alias(c) for c in ("p", "q", "q_by", "q_storey")])


_ANOVA = {
    "gm": "SELECT feat, strat, count(*) AS n, avg(val) AS m, var_samp(val) AS v FROM raw GROUP BY ALL",
    "tt": "SELECT feat, count(*) AS k, sum(n) AS nn, sum(n * m) / sum(n) AS gm, sum((n - 1) * v) AS ssw, sum(n * m * m) - power(sum(n * m), 2) / sum(n) AS ssb FROM gm GROUP BY feat",
}


@query(sql("SELECT feat, round(ssb / (k - 1) / (ssw / (nn - k)), 5) AS f, round(ssb / (ssb + ssw), 6) AS eta2, round((ssb - (k - 1) * ssw / (nn - k)) / (ssb + ssw + ssw / (nn - k)), 6) AS omega2 FROM tt", "raw", **_ANOVA))
def d11_analysis_of_variance(spark: SparkSession, d: str) -> DataFrame:
    g = roles.raw(spark, d).groupBy("feat", "strat").agg(F.count("*").alias("n"), F.avg("val").alias("m"), F.var_samp("val").alias("v"))
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    t = g.groupBy("feat").agg(
        F.count("*").alias("k"), F.sum(n).alias("nn"), F.sum((n - 1) * v).alias("ssw"), (F.sum(n * m * m) - F.sum(n * m) ** 2 / F.sum(n)).alias("ssb")
    )
    within = F.col("ssw") / (F.col("nn") - F.col("k"))
    total = F.col("ssb") + F.col("ssw")
    return t.select(
        "feat", F.round(F.col("ssb") / (F.col("k") - 1) / within, 5).alias("f"), F.round(F.col("ssb") / total, 6).alias("eta2"),
        F.round((F.col("ssb") - (F.col("k") - 1) * within) / (total + within), 6).alias("omega2"),
    )


@query(sql("SELECT ent, round(avg(z), 6) AS mean_z FROM (SELECT ent, (value - avg(value) OVER (PARTITION BY src, feat)) / nullif(stddev_samp(value) OVER (PARTITION BY src, feat), 0) AS z FROM m) GROUP BY ent", "m"))
def d12_global_mean_z(spark: SparkSession, d: str) -> DataFrame:
    return plain_z(roles.measurements(spark, d), ["src", "feat"], "value").groupBy("ent").agg(F.round(F.avg("z"), 6).alias("mean_z"))


@query(sql("SELECT feat, ent, src, round((value - min(value) OVER (PARTITION BY feat)) / nullif(max(value) OVER (PARTITION BY feat) - min(value) OVER (PARTITION BY feat), 0), 6) AS scaled, value > 15 AS over FROM m", "m").replace("AS over", 'AS above'))
def d13_min_max_score(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("feat")
    low, high = F.min("value").over(w), F.max("value").over(w)
    return roles.measurements(spark, d).select("feat", "ent", "src", F.round((F.col("value") - low) / F.nullif(high - low, F.lit(0.0)), 6).alias("scaled"), (F.col("value") > 15).alias("above"))


@query(sql("SELECT gene_role, round((1 - stddev_samp(core_score) FILTER (WHERE has_driver_alteration) / stddev_samp(core_score)) * 100, 5) AS reduction FROM fl GROUP BY gene_role", "fl"))
def d14_variance_reduction(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("core_score")
    sd = F.stddev_samp(F.when(F.col("has_driver_alteration"), x))
    return flags(spark, d).groupBy("gene_role").agg(F.round((1 - sd / F.stddev_samp(x)) * 100, 5).alias("reduction"))


@query(sql("SELECT ent, CAST(t1 AS INTEGER) IS NOT NULL AS assessed1, CAST(coalesce(CAST(t1 AS INTEGER), 0) + coalesce(CAST(t2 AS INTEGER), 0) + coalesce(CAST(t3 AS INTEGER), 0) AS INTEGER) AS n_passed, CAST(CAST(t1 IS NOT NULL AS INTEGER) + CAST(t2 IS NOT NULL AS INTEGER) + CAST(t3 IS NOT NULL AS INTEGER) AS INTEGER) AS n_assessed FROM sq", "m", **_TERMS))
def d15_pass_fail_unassessed(spark: SparkSession, d: str) -> DataFrame:
    terms = ("t1", "t2", "t3")
    passed = sum((F.coalesce(F.col(t).cast("int"), F.lit(0)) for t in terms), F.lit(0))
    assessed = sum((F.col(t).isNotNull().cast("int") for t in terms), F.lit(0))
    return answers(spark, d).select("ent", F.col("t1").isNotNull().alias("assessed1"), passed.alias("n_passed"), assessed.alias("n_assessed"))


@query(sql("SELECT feat, ent, CASE WHEN round(total_cn_mean / 2, 9) > 1.5 THEN 1 WHEN round(total_cn_mean / 2, 9) < 0.5 THEN -1 WHEN total_cn_mean IS NOT NULL THEN 0 END AS vote FROM cna", "cna"))
def d20_copy_number_vote(spark: SparkSession, d: str) -> DataFrame:
    got = evidence.cna_flags(roles.copy_numbers(stage(spark, d, "raw")), ["feat", "ent"], roles.roles(spark, d), "feat")
    return got.select("feat", "ent", evidence.copy_number_vote(F.round(F.col("total_cn_mean") / 2, 9)).alias("vote"))


@query("SELECT upper(trim(gsm)) AS k, row_id, lower(trim(resolution_method)) AS how FROM no_depmap_equivalent_geo_expr WHERE gsm IS NOT NULL")
def j11_normalised_keys(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "no_depmap_equivalent_geo_expr").where(F.col("gsm").isNotNull())
    return t.select(upper_id(F.col("gsm")).alias("k"), "row_id", lower_label(F.col("resolution_method")).alias("how"))


@query("SELECT row_id, trim(list_last(string_split(string_split(diseases, '||')[1], ';'))) AS disease, len(list_filter(list_transform(regexp_split_to_array(cell_line_names, '[;,|/\\\\]'), lambda x: trim(x)), lambda x: lower(x) NOT IN ('', 'nan', 'none', 'null'))) AS n_names FROM multi_model_entities")
def m21_delimited_lists(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "multi_model_entities")
    return t.select("row_id", resolve.last_of_nested(F.col("diseases")).alias("disease"), F.size(resolve.split_list(F.col("cell_line_names"))).cast("long").alias("n_names"))


@query("SELECT query_id, regexp_replace(lower(trim(query)), '\\s+', ' ', 'g') AS normal FROM gene_alias_result")
def m24_query_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gene_alias_result").select("query_id", F.regexp_replace(F.lower(F.trim("query")), r"\s+", " ").alias("normal"))


@query("SELECT l_orderkey, l_linenumber, round(log2(greatest(l_quantity, 0) + 1), 9) AS v FROM lineitem")
def m05_log_scale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(log2p1(F.col("l_quantity")), 9).alias("v"))
