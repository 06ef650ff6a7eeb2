"""Queries of further sources and sinks, filters, joins and scalar functions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions.ids import ensembl_id, upper_id
from gneiss.functions.stats import score_band, sql_phi_inverse, with_phi_inverse
from gneiss.operators import correlate, ranks, reshape, resolve, zscores
from gneiss.plans import roles
from gneiss.plans import stage as stages
from gneiss.plans.registry import Registry
from gneiss.plans.roles import FEATURES, sql
from gneiss.plans.scoring import _PAIRED, paired, r6
from gneiss.plans.serving import folder_of
from gneiss.plans.stage import stage
from gneiss.session import table
from gneiss.sources import readers, writers

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


# ------------------------------------------------------------------ sources and sinks


@query(sql("SELECT ent, feat, round(avg(value), 6) AS value FROM m WHERE feat IN ('Brand#11', 'Brand#22') GROUP BY ALL", "m"))
def s02_wide_subset(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of a stored wide table that has them and one that it lacks, back in long form."""
    path = folder_of(spark) + "/wide"
    features = [r["feat"] for r in roles.roles(spark, d).select("feat").orderBy("feat").collect()]  # the table's columns
    writers.parquet(reshape.pivot_first(stage(spark, d, "measurements"), ["ent"], "feat", features, "value", "avg"), path)
    wide = readers.wide_subset(spark, path, "ent", ["Brand#11", "Brand#22", "Brand#none"])
    return reshape.melt(wide, ["ent"], wide.columns[1:], "feat", "value").select("ent", "feat", *r6("value"))


@query("SELECT 'region' AS table_name, true AS present UNION ALL SELECT 'lineitem', true UNION ALL SELECT 'no_such_table', false")
def s03_presence_guard(spark: SparkSession, d: str) -> DataFrame:
    return readers.present(spark, d, ["region", "lineitem", "no_such_table"], required=False)


@query("SELECT s_name AS feature, 'supplier ' || s_suppkey AS description, e AS entity, round(CASE e WHEN 'balance' THEN s_acctbal ELSE CAST(s_nationkey AS DOUBLE) END, 2) AS value FROM supplier, (SELECT unnest(['balance', 'nation']) AS e)")
def s07_gct_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers as a GCT file, read back long."""
    path = folder_of(spark) + "/gct"
    s = table(spark, d, "supplier")
    body = s.select(F.concat_ws("\t", "s_name", F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")), F.round("s_acctbal", 2).cast("string"), F.col("s_nationkey").cast("string")).alias("value"))
    head = spark.createDataFrame([("#1.2",), ("2\t2",), ("Name\tDescription\tbalance\tnation",)], "value string")
    head.unionByName(body).write.text(path)
    return readers.gct(spark, path).withColumn("value", F.round("value", 2))


def _soft_files(spark: SparkSession, d: str) -> str:
    """The samples of geo_platform as SOFT texts, one file a sample, and one file without a sample."""
    path = folder_of(spark) + "/soft"
    p = table(spark, d, "geo_platform").select(upper_id(F.col("gsm_id")).alias("id"), "title", F.regexp_replace("data_processing", r"[\r\n]+", " ").alias("text")).where(F.col("id").isNotNull())
    one = p.groupBy("id").agg(F.min("title").alias("title"), F.min("text").alias("text"))
    lines = F.concat_ws("\n", F.concat(F.lit("^SAMPLE = "), F.col("id")), F.concat(F.lit("!Sample_title = "), F.col("title")), F.concat(F.lit("!Sample_data_processing = "), F.col("text")))
    files = one.select(lines.alias("value"), F.col("id").alias("file")).unionByName(spark.createDataFrame([("nothing of a sample", "none")], "value string, file string"))
    files.write.partitionBy("file").text(path)
    return path


_SOFT = "WITH s AS (SELECT upper(trim(gsm_id)) AS gsm_id, min(title) AS title, min(regexp_replace(data_processing, '[\\r\\n]+', ' ', 'g')) AS t FROM geo_platform WHERE trim(gsm_id) <> '' GROUP BY 1)\n"


@query(_SOFT + "SELECT gsm_id, trim(title) AS title, nullif(trim(t), '') AS data_processing FROM s")
def s09_soft_records(spark: SparkSession, d: str) -> DataFrame:
    records, _ = readers.soft(spark, _soft_files(spark, d))
    text = F.col("fields")["data_processing"]
    return records.select("gsm_id", F.col("fields")["title"].alias("title"), F.when(text != "", text).alias("data_processing"))


@query(_SOFT + "SELECT count(*) AS n_records, 1 AS n_failures FROM s")
def s10_soft_folder(spark: SparkSession, d: str) -> DataFrame:
    records, failures = readers.soft(spark, _soft_files(spark, d))
    return records.agg(F.count("*").alias("n_records")).join(failures.agg(F.count("*").alias("n_failures")))  # one row each


@query("""WITH w AS (SELECT DISTINCT upper(trim(gsm_id)) AS id FROM geo_values WHERE trim(gsm_id) <> '' UNION SELECT 'GSM-NONE'), p AS (SELECT DISTINCT upper(trim(gsm_id)) AS id FROM geo_platform)
SELECT id, CASE WHEN id IN (SELECT id FROM p) THEN 'landed' ELSE 'not landed' END AS outcome FROM w""")
def s11_harvest(spark: SparkSession, d: str) -> DataFrame:
    """Which of the samples that values name have a landed record, and a failure row for the others."""
    wanted = table(spark, d, "geo_values").select(upper_id(F.col("gsm_id")).alias("id")).unionByName(spark.createDataFrame([("GSM-NONE",)], "id string"))
    landed = table(spark, d, "geo_platform").select(upper_id(F.col("gsm_id")).alias("id")).distinct()
    records, failures = readers.harvest(wanted, "id", landed)
    return records.select("id", F.lit("landed").alias("outcome")).unionByName(failures.select("id", F.col("reason").alias("outcome")))


@query("SELECT r_regionkey, r_name FROM region")
def s12_fetched_once(spark: SparkSession, d: str) -> DataFrame:
    """A file of another file system copied to the shared folder on first use, then read there."""
    cache = folder_of(spark)
    first = readers.fetched(spark, f"file://{d}/region.parquet", cache)
    assert readers.fetched(spark, f"file://{d}/region.parquet", cache) == first
    return spark.read.parquet(first).select("r_regionkey", "r_name")


@query("SELECT 'floor_q' AS name, 0.1 AS value UNION ALL SELECT 'n0', 25.0 UNION ALL SELECT 'upper_cut', 0.9")
def s13_parameters(spark: SparkSession, d: str) -> DataFrame:
    path = folder_of(spark) + "/parameters"
    spark.createDataFrame([(json.dumps({"floor_q": 0.1, "n0": 25, "upper_cut": 0.9}),)], "value string").coalesce(1).write.text(path)
    return spark.createDataFrame([(k, float(v)) for k, v in readers.parameters(spark, path).items()], "name string, value double")


_FOLDED = "SELECT query_id, lower(trim(query)) AS k FROM gene_alias_result WHERE trim(query) <> ''"


@query(f"""WITH q AS ({_FOLDED}), s AS (SELECT DISTINCT lower(hgnc_symbol) AS k, ensg_id FROM gene_lookup), a AS (SELECT k, min(ensg_id) AS ensg_id FROM (SELECT DISTINCT lower(trim(unnest(string_split(alias_symbols, '|')))) AS k, ensg_id FROM gene_lookup) WHERE k <> '' GROUP BY k)
SELECT q.query_id, coalesce(s.ensg_id, a.ensg_id) AS entry, CASE WHEN s.ensg_id IS NOT NULL THEN 'symbols' WHEN a.ensg_id IS NOT NULL THEN 'aliases' END AS source, CASE WHEN s.ensg_id IS NULL THEN 'remote' ELSE '' END AS degraded
FROM (SELECT query_id, min(k) AS k FROM q GROUP BY 1) q LEFT JOIN (SELECT k, min(ensg_id) AS ensg_id FROM s GROUP BY k) s USING (k) LEFT JOIN a USING (k)""")
def s14_lookup_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Sources asked in order; one that is out of reach is named as degraded where it would have been asked."""
    g = table(spark, d, "gene_lookup")
    asked = table(spark, d, "gene_alias_result").select("query_id", F.lower(F.trim("query")).alias("k")).where(F.col("k") != "").groupBy("query_id").agg(F.min("k").alias("k"))
    symbols = g.select(F.lower("hgnc_symbol").alias("k"), F.col("ensg_id").alias("entry"))
    aliases = g.select(F.explode(F.split("alias_symbols", r"\|")).alias("k"), F.col("ensg_id").alias("entry")).withColumn("k", F.lower(F.trim("k"))).where(F.col("k") != "")
    return resolve.with_fallback(asked, "query_id", "k", {"symbols": symbols, "remote": None, "aliases": aliases}).select("query_id", "entry", "source", F.array_join("degraded", ",").alias("degraded"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority <= '2-HIGH' GROUP BY 1")
def s17_partitioned_append(spark: SparkSession, d: str) -> DataFrame:
    """One distributed write, a directory a key, and a read that opens only the wanted ones."""
    path = folder_of(spark) + "/by_priority"
    writers.by_key(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), path, "o_orderpriority")
    return spark.read.parquet(path).where(F.col("o_orderpriority") <= "2-HIGH").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(sql("SELECT feat, count(*) AS n, round(max(score), 6) AS best FROM sc GROUP BY feat", "sc"))
def s24_stored_scores(spark: SparkSession, d: str) -> DataFrame:
    """All stage tables written anew, then the stored scores read: what the serving queries start from."""
    stages.forget(spark)
    return stage(spark, d, "scores").groupBy("feat").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


@query("SELECT r_name, count(*) AS n_nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def s26_csv_report(spark: SparkSession, d: str) -> DataFrame:
    path = folder_of(spark) + "/report"
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    writers.csv_report(joined.groupBy("r_name").agg(F.count("*").alias("n_nations")), path)
    return readers.delimited(spark, path).select("r_name", F.col("n_nations").cast("long").alias("n_nations"))


# ------------------------------------------------------------------ reshape and filters


@query(sql("SELECT feat, ent, round(avg(value), 6) AS mean, round(median(value), 6) AS middle, round(avg(value) FILTER (WHERE src = 'A'), 6) AS a, round(avg(value) FILTER (WHERE src = 'R'), 6) AS r FROM m GROUP BY feat, ent", "m"))
def r05_pivot_with_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Mean and median pivots beside each other, from one aggregation each."""
    m = roles.measurements(spark, d)
    means = reshape.pivot_first(m, ["feat", "ent"], "src", ["A", "R"], "value", "avg")
    whole = reshape.pivot_first(m.withColumn("all", F.lit("all")), ["feat", "ent"], "all", ["all"], "value", "avg")
    middle = reshape.pivot_first(m.withColumn("all", F.lit("all")), ["feat", "ent"], "all", ["all"], "value", "median")
    both = whole.select("feat", "ent", F.round("all", 6).alias("mean")).join(middle.select("feat", "ent", F.round("all", 6).alias("middle")), ["feat", "ent"])
    return both.join(means.select("feat", "ent", F.round("A", 6).alias("a"), F.round("R", 6).alias("r")), ["feat", "ent"])


@query("SELECT n_name AS name, n_nationkey AS id FROM nation")
def r09_renamed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").withColumnsRenamed({"n_nationkey": "id", "n_name": "name"}).drop("n_regionkey").select("name", "id")


@query("SELECT model_id, lineage FROM cell_line_lookup WHERE lower(lineage) = (SELECT min(lower(lineage)) FROM cell_line_lookup)")
def r14_exact_label(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cell_line_lookup").select("model_id", "lineage")
    wanted = c.agg(F.min(F.lower("lineage"))).first()[0] or ""
    return reshape.exact_label(c, "lineage", wanted.upper())


@query("""SELECT id, min(row_id) AS position FROM (SELECT row_id, regexp_extract(upper(trim(gene_id)), '^(ENSG[0-9]+)(\\.[0-9]+)?$', 1) AS id FROM expr_long)
WHERE id <> '' AND id IN (SELECT upper(ensg_id) FROM gene_lookup) GROUP BY id""")
def r22_roster_filter(spark: SparkSession, d: str) -> DataFrame:
    """Canonical ids of the roster in the order in which they are first asked for."""
    roster = table(spark, d, "gene_lookup").select(F.upper("ensg_id").alias("ensg_id"))
    return reshape.roster_filter(table(spark, d, "expr_long"), "row_id", ensembl_id(F.col("gene_id")), roster, "ensg_id")


# ------------------------------------------------------------------ joins


@query(sql("SELECT count(*) FILTER (WHERE a.ent IS NOT NULL AND b.ent IS NOT NULL) AS matched, count(*) FILTER (WHERE b.ent IS NULL) AS only_left, count(*) FILTER (WHERE a.ent IS NULL) AS only_right FROM mut a FULL JOIN (SELECT DISTINCT feat, ent FROM cna0 WHERE cna_call = 'amplification') b ON a.feat = b.feat AND a.ent = b.ent", "mut", "cna0"))
def j07_outer_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = stage(spark, d, "raw")
    amplified = roles.copy_numbers(rows).where(F.col("cna_call") == "amplification").select("feat", "ent").distinct()
    both = reshape.outer_merge(roles.mutations(rows).select("feat", "ent"), amplified, ["feat", "ent"])
    return both.agg(
        F.count_if(F.col("in_left") & F.col("in_right")).alias("matched"), F.count_if(~F.col("in_right")).alias("only_left"), F.count_if(~F.col("in_left")).alias("only_right")
    )


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' WHEN 2 THEN 'east' END AS side FROM nation")
def j08_map_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A small mapping whose later entries win, as one literal map: no join at all."""
    return table(spark, d, "nation").select("n_nationkey", resolve.mapped(F.col("n_regionkey"), [(0, "north"), (1, "west"), (2, "east"), (0, "south")]).alias("side"))


@query(f"""WITH q AS ({_FOLDED}), s AS (SELECT lower(hgnc_symbol) AS k, hgnc_symbol AS symbol, 0 AS rung FROM gene_lookup UNION ALL SELECT lower(trim(unnest(string_split(prev_symbols, '|')))), hgnc_symbol, 1 FROM gene_lookup),
b AS (SELECT k, min_by(symbol, (rung, symbol)) AS symbol FROM s WHERE k <> '' GROUP BY k)
SELECT symbol, min(query_id) AS first_query FROM q JOIN b USING (k) GROUP BY symbol""")
def j18_resolved_once(spark: SparkSession, d: str) -> DataFrame:
    """What the queries resolve to, each canonical symbol at its first occurrence."""
    g = table(spark, d, "gene_lookup")
    own = g.select(F.lower("hgnc_symbol").alias("k"), F.col("hgnc_symbol").alias("symbol"), F.lit(0).alias("rung"))
    old = g.select(F.explode(F.split("prev_symbols", r"\|")).alias("k"), F.col("hgnc_symbol").alias("symbol"), F.lit(1).alias("rung"))
    names = own.unionByName(old.withColumn("k", F.lower(F.trim("k")))).where(F.col("k") != "")
    best = names.groupBy("k").agg(F.min(F.struct("rung", "symbol")).alias("b")).select("k", "b.symbol")
    asked = table(spark, d, "gene_alias_result").select("query_id", F.lower(F.trim("query")).alias("k"))
    return reshape.first_resolved(asked.join(best, "k", "left"), "query_id", "symbol").select("symbol", F.col("query_id").alias("first_query"))


_ALL_PAIRS = {"cp": "SELECT a.feat AS feat_a, b.feat AS feat_b, count(*) AS n, corr(a.score, b.score) AS r FROM sc a JOIN sc b ON a.ent = b.ent AND a.feat < b.feat WHERE a.score IS NOT NULL AND b.score IS NOT NULL GROUP BY ALL"}


@query(sql("SELECT feat_a, feat_b, n, round(r, 6) AS r FROM cp", "sc", **_ALL_PAIRS))
def j20_feature_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of features with the correlation of their scores, from matrix products per task."""
    return correlate.pair_correlations(stage(spark, d, "scores"), "feat", "ent", "score").select(F.col("a").alias("feat_a"), F.col("b").alias("feat_b"), "n", *r6("r"))


@query(sql("SELECT count(*) AS n_pairs, round(avg(abs(r)), 6) AS mean_abs_r, round(quantile_cont(abs(r), 0.95), 6) AS p95, count(*) FILTER (WHERE abs(r) > 0.05) AS n_dependent FROM cp WHERE CAST('0x' || substr(md5(feat_a || '/' || feat_b), 1, 12) AS BIGINT) % 2 = 0", "sc", **_ALL_PAIRS))
def g50_pair_independence(spark: SparkSession, d: str) -> DataFrame:
    """How independent the scores of sampled feature pairs are."""
    p = correlate.pair_correlations(stage(spark, d, "scores"), "feat", "ent", "score")
    sampled = p.where(F.pmod(F.conv(F.substring(F.md5(F.concat_ws("/", "a", "b")), 1, 12), 16, 10).cast("bigint"), F.lit(2)) == 0)
    r = F.abs("r")
    return sampled.agg(F.count("*").alias("n_pairs"), F.round(F.avg(r), 6).alias("mean_abs_r"), F.round(F.percentile(r, F.lit(0.95)), 6).alias("p95"), F.count_if(r > 0.05).alias("n_dependent"))


# ------------------------------------------------------------------ aggregates, windows, top-k


@query(f"SELECT round(1.0 / ({sql_phi_inverse('0.75')}), 9) AS mad_constant, 1.4826 AS used")
def a08_mad_constant(spark: SparkSession, d: str) -> DataFrame:
    """The factor that makes the MAD of normal values their SD, from the inverse normal, and the rounded one in use."""
    one = with_phi_inverse(spark.range(1).select(F.lit(0.75).alias("p")), "p", "z")
    return one.select(F.round(1.0 / F.col("z"), 9).alias("mad_constant"), F.lit(zscores.MAD_SCALE).alias("used"))


@query("SELECT upper(trim(gsm_id)) AS gsm, count(*) AS n, round(min(log2_value), 6) AS low, round(avg(log2_value), 6) AS mean, round(max(log2_value), 6) AS high FROM geo_values WHERE log2_value IS NOT NULL AND NOT isnan(log2_value) GROUP BY 1")
def a33_sample_scale(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "geo_values").where(F.col("log2_value").isNotNull() & ~F.isnan("log2_value"))
    x = "log2_value"
    return v.groupBy(upper_id(F.col("gsm_id")).alias("gsm")).agg(F.count("*").alias("n"), F.round(F.min(x), 6).alias("low"), F.round(F.avg(x), 6).alias("mean"), F.round(F.max(x), 6).alias("high"))


@query(sql("SELECT src, strat, feat, ent, round((value - med) / greatest(1.4826 * mad, 0.384), 6) AS z FROM d2 WHERE n >= 5", "d2"))
def w14_robust_z_unguarded(spark: SparkSession, d: str) -> DataFrame:
    """Robust z without silence guard and without shrinking sparse pairs, as the first protein score takes it."""
    return zscores.robust_z(roles.measurements(spark, d), ["src", "strat", "feat"], "value").where(F.col("z").isNotNull()).select("src", "strat", "feat", "ent", *r6("z"))


@query("SELECT row_id, log2_value FROM (SELECT row_id, log2_value, row_number() OVER (ORDER BY log2_value DESC, row_id) AS k, count(*) OVER () AS n FROM expr_long WHERE log2_value IS NOT NULL AND NOT isnan(log2_value)) WHERE k <= greatest(10, floor(n * 0.01))")
def k06_top_fraction(spark: SparkSession, d: str) -> DataFrame:
    """The highest hundredth of all values."""
    return reshape.top_fraction(table(spark, d, "expr_long").select("row_id", "log2_value"), "log2_value", ["row_id"], 0.01)


@query(sql("SELECT ent, score, row_number() OVER (ORDER BY score DESC, ent) AS place FROM sc WHERE feat = 'Brand#11' AND lower(strat) = 'asia' AND score IS NOT NULL ORDER BY place LIMIT 20", "sc"))
def k08_rank_in_one_stratum(spark: SparkSession, d: str) -> DataFrame:
    """The best of one stratum of one feature, ranked anew; the 20 kept are numbered after the cut."""
    s = stage(spark, d, "scores").where((F.col("feat") == FEATURES[0]) & F.col("score").isNotNull())
    best = reshape.exact_label(s, "strat", "Asia").orderBy(F.desc("score"), "ent").limit(20)
    return best.select("ent", "score", F.row_number().over(Window.orderBy(F.desc("score"), "ent")).alias("place"))  # 20 rows


# ------------------------------------------------------------------ scalar functions

# Written out apart from the readers' rules, so that either can show a fault of the other.
_FAMILY = r"""CASE WHEN regexp_matches(t, '\bgc[\s-]?rma\b') THEN 'gcrma' WHEN regexp_matches(t, '\brma\b') OR regexp_matches(t, 'robust\s+multi[\s-]?array') THEN 'rma'
 WHEN regexp_matches(t, '\bmas\s*5') OR regexp_matches(t, '\bgcos\b') OR regexp_matches(t, 'microarray\s+suite\s*5') OR regexp_matches(t, 'trimmed\s+mean.*target') OR regexp_matches(t, 'global\s+scaling') THEN 'mas5'
 WHEN regexp_matches(t, '\bplier\b') THEN 'plier' WHEN regexp_matches(t, '\bdchip\b') OR regexp_matches(t, 'model[\s-]based\s+expression') THEN 'dchip' WHEN regexp_matches(t, '\bmas\s*4') OR regexp_matches(t, 'average\s+difference') THEN 'mas4'
 WHEN regexp_matches(t, '\bvsn\b') OR regexp_matches(t, 'variance\s+stabilis?z?ing') THEN 'vsn' WHEN regexp_matches(t, 'quantile\s+normal') THEN 'quantile' WHEN regexp_matches(t, '\blowess\b') OR regexp_matches(t, '\bloess\b') THEN 'lowess'
 WHEN regexp_matches(t, '\brsem\b') OR regexp_matches(t, '\btpm\b') OR regexp_matches(t, '\bfpkm\b') OR regexp_matches(t, '\brpkm\b') OR regexp_matches(t, '\bdeseq\b') THEN 'rnaseq' ELSE 'unknown' END"""
_TEXTS = "SELECT upper(trim(gsm_id)) AS gsm, concat_ws(' ', proc_family, data_processing) AS raw_t, lower(concat_ws(' ', proc_family, data_processing)) AS t FROM geo_platform"


@query(f"""SELECT gsm, family, CASE WHEN family IN ('gcrma', 'rma', 'plier', 'vsn', 'lowess') THEN 'log' WHEN family IN ('mas5', 'dchip', 'mas4', 'rnaseq') THEN 'linear' ELSE 'unknown' END AS scale FROM (SELECT gsm, {_FAMILY} AS family FROM ({_TEXTS}))""")
def m16_processing_family(spark: SparkSession, d: str) -> DataFrame:
    """Processing method and scale that a sample's texts name, by ten ordered rules."""
    text = F.concat_ws(" ", "proc_family", "data_processing")
    return table(spark, d, "geo_platform").select(upper_id(F.col("gsm_id")).alias("gsm"), readers.processing_family(text).alias("family"), readers.processing_scale(text).alias("scale"))


@query(f"""SELECT method, count(*) AS n FROM (SELECT CASE WHEN contains(t, 'gcrma') THEN 'gcRMA' WHEN contains(t, 'rma') OR contains(t, 'robust multi') THEN 'RMA' WHEN contains(t, 'mas5') OR contains(t, 'mas 5') OR contains(t, 'gcos') THEN 'MAS5'
WHEN contains(t, 'quantile') THEN 'quantile' ELSE 'other' END AS method FROM ({_TEXTS})) GROUP BY method""")
def m17_harvested_method(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", "proc_family", "data_processing")
    return table(spark, d, "geo_platform").groupBy(readers.harvested_method(text).alias("method")).agg(F.count("*").alias("n"))


_GUESS = """CASE WHEN lower(source_name) LIKE '%mouse%' OR lower(characteristics) LIKE '%mus musculus%' THEN 'possible_mouse' WHEN lower(source_name) LIKE '%rat%' OR lower(characteristics) LIKE '%rattus%' THEN 'possible_rat'
WHEN lower(source_name) LIKE '%human%' OR lower(characteristics) LIKE '%homo sapiens%' THEN 'looks_human' ELSE 'unclear' END"""


@query(f"SELECT {_GUESS} AS guess, count(*) AS n FROM geo_platform GROUP BY 1")
def m18_species_guess(spark: SparkSession, d: str) -> DataFrame:
    guess = readers.species_guess(F.col("source_name"), F.col("characteristics"))
    return table(spark, d, "geo_platform").groupBy(guess.alias("guess")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(cvcl_accession) AS n_accession, count(*) FILTER (WHERE regexp_full_match(upper(trim(cvcl_accession)), 'CVCL_[0-9A-Z]{4}')) AS n_well_formed, count(lineage) AS n_lineage, count(*) FILTER (WHERE deleted_at IS NULL) AS n_current FROM cell_line_lookup")
def g57_accession_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How far the lines of the lookup have an accession of the right form, a lineage, and are still there."""
    good = F.coalesce(upper_id(F.col("cvcl_accession")).rlike("^CVCL_[0-9A-Z]{4}$"), F.lit(False))
    return table(spark, d, "cell_line_lookup").agg(
        F.count("*").alias("n"), F.count("cvcl_accession").alias("n_accession"), F.count_if(good).alias("n_well_formed"), F.count("lineage").alias("n_lineage"), F.count_if(F.col("deleted_at").isNull()).alias("n_current")
    )


@query("SELECT p_partkey, string_split(p_name || ' (' || p_partkey || ')', ' (')[1] AS symbol, replace(p_name, ' ', '-') AS dashed, p_type[1:3] AS head FROM part")
def m20_split_replace_slice(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")"))
    return table(spark, d, "part").select("p_partkey", resolve.leading_symbol(label).alias("symbol"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("dashed"), F.substring("p_type", 1, 3).alias("head"))


#: Tissue names of one vocabulary and what another calls them; all others are snake-cased.
TISSUES = {
    "Bowel": "colorectal",
    "CNS/Brain": "central_nervous_system",
    "Lymphoid": "lymphocyte",
    "Myeloid": "blood",
    "Head and Neck": "upper_aerodigestive",
    "Esophagus/Stomach": "gastric",
    "Biliary Tract": "bile_duct",
    "Ampulla of Vater": "bile_duct",
    "Bladder/Urinary Tract": "urinary_tract",
    "Ovary/Fallopian Tube": "ovary",
    "Adrenal Gland": "adrenal_cortex",
    "Vulva/Vagina": "vulva",
    "Embryonal": "embryo",
    "Other": "unknown",
}


@query("SELECT tissue, CASE trim(tissue) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TISSUES.items()) + " ELSE replace(replace(lower(trim(tissue)), ' ', '_'), '/', '_') END AS label, count(*) AS n FROM (SELECT tissue FROM multi_model_entities UNION ALL SELECT unnest(['Bowel', 'CNS/Brain', 'Soft Tissue', 'Ovary/Fallopian Tube', 'Skin'])) GROUP BY 1")
def m23_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Tissue labels in the other vocabulary, snake-cased where it has no word of its own."""
    samples = spark.createDataFrame([(t,) for t in ("Bowel", "CNS/Brain", "Soft Tissue", "Ovary/Fallopian Tube", "Skin")], "tissue string")
    t = table(spark, d, "multi_model_entities").select("tissue").unionByName(samples)
    return t.groupBy("tissue").agg(F.count("*").alias("n")).select("tissue", reshape.vocabulary_label(F.col("tissue"), TISSUES).alias("label"), "n")


@query("""SELECT query_id, CASE WHEN regexp_full_match(trim(query), '(?i)ENSG[0-9]+(\\.[0-9]+)?\\s*[,/|+ ]\\s*ACH-[0-9]+') THEN 'score_explainer' WHEN regexp_full_match(trim(query), '(?i)ENSG[0-9]+(\\.[0-9]+)?') THEN 'gene_alias_lookup'
WHEN lower(trim(query)) IN ('kept', 'expr_long') THEN 'dataset_info' END AS tool FROM gene_alias_result""")
def m25_fast_path(spark: SparkSession, d: str) -> DataFrame:
    """Inputs that name their answer's kind by their form alone; NULL for all others."""
    return table(spark, d, "gene_alias_result").select("query_id", resolve.fast_path(F.col("query"), ["kept", "expr_long"]).alias("tool"))


@query(sql("SELECT feat, ent, CASE WHEN a IS NOT NULL THEN round(ln(1 + greatest(a, 0)), 6) END AS log1p, round(CASE WHEN a IS NOT NULL THEN rank() OVER (PARTITION BY feat ORDER BY a NULLS LAST) + (count(*) OVER (PARTITION BY feat, a) - 1) / 2.0 END, 6) AS rank FROM wide", "m", **_PAIRED))
def m32_transform_variants(spark: SparkSession, d: str) -> DataFrame:
    """A feature's values on the log1p and on the rank scale."""
    p = paired(spark, d).withColumn("rank", ranks.average_rank(["feat"], "a"))
    return p.select("feat", "ent", F.when(F.col("a").isNotNull(), F.round(F.log1p(F.greatest("a", F.lit(0.0))), 6)).alias("log1p"), *r6("rank"))


@query(sql("SELECT feat, ent, CASE WHEN score >= 0.8 THEN 'High' WHEN score >= 0.5 THEN 'Moderate' ELSE 'Low' END AS level, CASE WHEN score >= 0.9 THEN 'strong' WHEN score >= 0.1 THEN 'ordinary' ELSE 'weak' END AS tier FROM sc", "sc"))
def m35_level_and_tier(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    return stage(spark, d, "scores").select("feat", "ent", score_band(s, names=("High", "Moderate", "Low")).alias("level"), score_band(s, 0.9, 0.1, ("strong", "ordinary", "weak")).alias("tier"))

