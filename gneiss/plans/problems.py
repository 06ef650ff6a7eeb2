"""Queries p1, p2, p3 and p6 over whole tables, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.ids import gene_id, upper_id
from gneiss.operators import orphans, packed, units, wide
from gneiss.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- 1: attribute rows to wide rows

PROFILE_KINDS = {"mapped_reads": "bigint", "passed_qc": "boolean", "profiled_on": "date"}


def profiles(spark: SparkSession, d: str) -> wide.Wide:
    rows = table(spark, d, "profile_eav")
    key = gene_id(F.col("gene_id"))
    return wide.widen(
        rows,
        entity=upper_id(F.col("profile_id")),
        attribute=F.when(F.lower(key).isin(*PROFILE_KINDS), F.lower(key)).otherwise(key),
        value=F.col("log2_value"),
        newest=[F.col("loaded_at"), F.col("row_id")],
        carried={"model_id": upper_id(F.col("model_id"))},
        kinds=PROFILE_KINDS,
        entity_name="profile_id",
    )


_CELLS = r"""
WITH r AS (
  SELECT upper(trim(profile_id, ' ' || chr(9) || chr(10) || chr(13))) AS profile_id,
         upper(trim(model_id, ' ' || chr(9) || chr(10) || chr(13))) AS model_id,
         CASE WHEN lower(trim(gene_id)) IN ('mapped_reads', 'passed_qc', 'profiled_on') THEN lower(trim(gene_id))
              ELSE regexp_replace(upper(trim(gene_id)), '^(ENSG[0-9]+)\.[0-9]+$', '\1') END AS gene_id,
         trim(log2_value, ' ' || chr(9) || chr(10) || chr(13)) AS t, loaded_at, row_id
  FROM profile_eav),
n AS (SELECT *, row_number() OVER (PARTITION BY profile_id, gene_id ORDER BY loaded_at DESC, row_id DESC) AS k FROM r),
v AS (SELECT *,
        CASE WHEN gene_id = 'mapped_reads' THEN regexp_full_match(t, '[+-]?[0-9]+')
             WHEN gene_id = 'passed_qc' THEN lower(t) IN ('true', 'false')
             WHEN gene_id = 'profiled_on' THEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(t AS DATE) IS NOT NULL
             ELSE regexp_full_match(t, '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?') END AS ok
      FROM n WHERE k = 1)
"""


@query(_CELLS + "SELECT DISTINCT profile_id, model_id, gene_id FROM v WHERE ok")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every filled cell of the wide profile table."""
    return wide.filled_cells(profiles(spark, d), "gene_id").select("profile_id", "model_id", "gene_id")


@query(
    _CELLS
    + """
SELECT profile_id, max(model_id) AS model_id,
  max(CASE WHEN gene_id = 'mapped_reads' AND ok THEN CAST(t AS BIGINT) END) AS mapped_reads,
  max(CASE WHEN gene_id = 'passed_qc' AND ok THEN lower(t) END) = 'true' AS passed_qc,
  CAST(max(CASE WHEN gene_id = 'profiled_on' AND ok THEN CAST(t AS DATE) END) AS VARCHAR) AS profiled_on,
  count(*) FILTER (WHERE ok AND gene_id LIKE 'ENSG%') AS n_genes,
  coalesce(round(sum(try_cast(replace(t, ',', '.') AS DOUBLE)) FILTER (WHERE ok AND gene_id LIKE 'ENSG%'), 6), 0) AS sum_log2,
  CAST(count(*) FILTER (WHERE NOT ok AND lower(t) NOT IN ('', '-', '#n/a', 'n/a', 'na', 'n.d.', 'nan', 'null', 'none', 'below detection')) AS INTEGER) AS n_cast_failures
FROM v GROUP BY 1"""
)
def p1_profiles(spark: SparkSession, d: str) -> DataFrame:
    """One row per profile: its named attributes in their types, and figures over its gene columns."""
    w = profiles(spark, d)
    named = ("mapped_reads", "passed_qc", "profiled_on")
    parts = None
    for i, (block, names) in enumerate(zip(w.blocks, w.columns, strict=True)):
        genes = [F.col(f"`{c}`") for k, c in names.items() if k not in PROFILE_KINDS]
        present = F.array_compact(F.array(*genes).cast("array<double>"))
        part = block.select(
            "profile_id", "model_id",
            *[(F.col(c) if i == 0 else F.lit(None).cast(PROFILE_KINDS[c])).alias(c) for c in named],
            F.size(present).cast("long").alias("n_genes"),
            F.aggregate(present, F.lit(0.0), lambda a, x: a + x).alias("sum_log2"),
            (F.size("cast_failures") if i == 0 else F.lit(0)).alias("n_cast_failures"),
        )
        parts = part if parts is None else parts.unionByName(part)
    if len(w.blocks) > 1:  # an entity has one row in each block
        parts = parts.groupBy("profile_id").agg(
            F.max("model_id").alias("model_id"), *[F.max(c).alias(c) for c in named],
            F.sum("n_genes").alias("n_genes"), F.sum("sum_log2").alias("sum_log2"), F.max("n_cast_failures").alias("n_cast_failures"),
        )
    return parts.withColumns({"profiled_on": F.col("profiled_on").cast("string"), "sum_log2": F.round("sum_log2", 6)})


# ---------------------------------------------------------------- 2: packed fields

PACKED = (
    ("gene_lookup_join_loss", "alias_symbols"),
    ("gene_lookup_join_loss", "previous_symbols"),
    ("multi_model_entities", "model_ids"),
)


def packed_fields(spark: SparkSession, d: str) -> DataFrame:
    """All packed fields under one another, each (table, field) a source of its own."""
    out = None
    for name, field in PACKED:
        part = table(spark, d, name).select(
            F.lit(name).alias("table_name"), "row_id", F.lit(field).alias("field_name"),
            F.lit(f"{name}.{field}").alias("source"), F.col(field).alias("text"),
        )
        out = part if out is None else out.unionByName(part)
    return out


_PACKED_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, row_id, '{f}' AS field_name, regexp_extract_all({f}, "
    f"""'"(?:[^"]|"")*"|[\\p{{L}}\\p{{M}}\\p{{Nd}}.@_-]+') AS xs FROM {t}"""
    for t, f in PACKED
)


@query(
    f"""WITH s AS ({_PACKED_SQL}),
c AS (SELECT table_name, row_id, field_name, list_filter(list_transform(xs, lambda x:
        CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}]')) AS xs FROM s)
SELECT table_name, row_id, field_name, CAST(p.pos AS BIGINT) AS pos, xs[p.pos] AS item
FROM c, LATERAL (SELECT unnest(generate_series(1, len(xs))) AS pos) p"""
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the packed fields with its position."""
    fields = packed_fields(spark, d)
    found = packed.infer_delimiters(fields, "source", "text")
    out = packed.split_packed(fields, "source", "text", found)
    return out.select("table_name", "row_id", "field_name", "pos", "item").distinct()


_DELIMITERS_SQL = (
    "WITH t AS ("
    + " UNION ALL ".join(f"SELECT '{t}.{f}' AS s, {f} AS t FROM {t} WHERE {f} IS NOT NULL" for t, f in PACKED)
    + r"""),
f AS (SELECT s, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '"(?:[^"]|"")*"', chr(10), 'g'), '["\x01]', chr(10), 'g'),
    '[\p{L}\p{M}]+', 'A', 'g'), '\p{Nd}+', '9', 'g') AS f FROM t),
v AS (SELECT s, w, count(*) AS c FROM (SELECT s, unnest(list_distinct(regexp_extract_all(f, '[A9.@_-]+'))) AS w FROM f) GROUP BY ALL),
e AS (SELECT s, f, unnest(list_distinct(regexp_extract_all(f, '[^A9\n]'))) AS d FROM f),
n AS (SELECT s, d, count(*) AS n_fields FROM e GROUP BY ALL),
j AS (SELECT s, d, j, count(*) AS c FROM (SELECT s, d, unnest(regexp_extract_all(replace(f, d, chr(1)), '[A9.@_\x01-]+')) AS j FROM e)
  WHERE contains(j, chr(1)) AND replace(j, chr(1), '') <> '' GROUP BY ALL),
w AS (SELECT s, d, CAST(sum(c) AS BIGINT) AS n_runs, count(*) AS n_shapes, sum(c) * ln(sum(c)) - sum(c * ln(c)) + sum(length(j)) * ln(4) AS whole FROM j GROUP BY ALL),
p AS (SELECT s, d, w, sum(c) AS m FROM (SELECT s, d, c, unnest(string_split(j, chr(1))) AS w FROM j) WHERE w <> '' GROUP BY ALL),
o AS (SELECT n.s, n.d, coalesce(sum(c) FILTER (NOT contains(w, n.d)), 0) AS total, count(*) FILTER (NOT contains(w, n.d)) AS k FROM n JOIN v ON n.s = v.s GROUP BY ALL),
q AS (SELECT p.s, p.d, sum(-m * ln((coalesce(v.c, 0) + 0.5) / (coalesce(total, 0) + 0.5 * (coalesce(k, 0) + 2)))) AS pieces
  FROM p LEFT JOIN v ON p.s = v.s AND p.w = v.w LEFT JOIN o ON p.s = o.s AND p.d = o.d GROUP BY ALL)
SELECT n.s AS source, n.d AS delimiter, n_fields, coalesce(n_runs, 0) AS n_runs, coalesce(n_shapes, 0) AS n_shapes,
  round(coalesce(whole, 0), 3) AS whole, round(coalesce(pieces, 0), 3) AS pieces, round(coalesce(whole, 0) - coalesce(pieces, 0), 3) AS score,
  coalesce(whole, 0) - coalesce(pieces, 0) + CASE WHEN n.d IN ('-', '.', '@', '_') THEN -12 ELSE 12 END > 0 AS separates
FROM n LEFT JOIN w ON n.s = w.s AND n.d = w.d LEFT JOIN q ON n.s = q.s AND n.d = q.d"""
)


@query(_DELIMITERS_SQL)
def p2_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """The candidate delimiters of every packed field, how both readings score and which separate."""
    return packed.delimiter_scores(packed_fields(spark, d), "source", "text")


# ---------------------------------------------------------------- 3: references without a target


def references(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "kept").select(
        F.lit("kept").alias("table_name"), F.lit("model_id").alias("field_name"), F.col("kept_id").alias("row_id"),
        upper_id(F.col("model_id")).alias("key"), F.col("saved_at").alias("at"),
    )
    geo = table(spark, d, "no_depmap_equivalent_geo_expr")
    parts = [
        geo.select(
            F.lit("no_depmap_equivalent_geo_expr").alias("table_name"), F.lit(f).alias("field_name"), "row_id",
            upper_id(F.col(f)).alias("key"), F.col("logged_at").alias("at"),
        )
        for f in ("gsm", "cvcl_id")
    ]
    every = kept.unionByName(parts[0]).unionByName(parts[1]).where(F.col("key").isNotNull())
    return every.withColumn("key", F.concat_ws("/", "field_name", "key"))


def existence(spark: SparkSession, d: str) -> DataFrame:
    """Deltas of the three kinds of targets; the referring field's name goes before the key."""
    lines, samples = table(spark, d, "cell_line_lookup"), table(spark, d, "geo_platform")
    parts = [
        orphans.existence_deltas(t, F.concat(F.lit(f"{field}/"), upper_id(F.col(key))), F.col(a), F.col(r))
        for t, field, key, a, r in (
            (lines, "model_id", "model_id", "added_at", "deleted_at"),
            (lines, "cvcl_id", "cvcl_accession", "added_at", "deleted_at"),
            (samples, "gsm", "gsm_id", "loaded_at", "withdrawn_at"),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_ORPHANS = """
WITH refs AS (
  SELECT 'kept' AS table_name, 'model_id' AS field_name, kept_id AS row_id, upper(trim(model_id)) AS k, saved_at AS ref_at FROM kept
  UNION ALL SELECT 'no_depmap_equivalent_geo_expr', 'gsm', row_id, upper(trim(gsm)), logged_at FROM no_depmap_equivalent_geo_expr
  UNION ALL SELECT 'no_depmap_equivalent_geo_expr', 'cvcl_id', row_id, upper(trim(cvcl_id)), logged_at FROM no_depmap_equivalent_geo_expr),
targets AS (
  SELECT 'model_id' AS field_name, upper(trim(model_id)) AS k, added_at AS a, deleted_at AS r FROM cell_line_lookup
  UNION ALL SELECT 'cvcl_id', upper(trim(cvcl_accession)), added_at, deleted_at FROM cell_line_lookup
  UNION ALL SELECT DISTINCT 'gsm', upper(trim(gsm_id)), loaded_at, withdrawn_at FROM geo_platform),
found AS (
  SELECT table_name, refs.field_name, row_id, ref_at, CASE WHEN t.k IS NULL THEN 'missing' WHEN a > ref_at THEN 'late' WHEN r <= ref_at THEN 'deleted' END AS kind
  FROM refs LEFT JOIN targets t ON refs.field_name = t.field_name AND refs.k = t.k WHERE refs.k IS NOT NULL AND refs.k <> '')
"""


def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    return orphans.classify(references(spark, d), existence(spark, d))


@query(_ORPHANS + "SELECT DISTINCT table_name, field_name, row_id, kind FROM found WHERE kind IS NOT NULL")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """References without a valid target at their time."""
    return orphan_rows(spark, d).select("table_name", "field_name", "row_id", "kind")


@query(
    _ORPHANS
    + """SELECT table_name, field_name, strftime(ref_at AT TIME ZONE 'UTC', '%Y-%m') AS month, kind, count(*) AS n_refs
FROM found WHERE kind IS NOT NULL GROUP BY ALL"""
)
def p3_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field, month and kind."""
    rows = orphan_rows(spark, d)
    return rows.groupBy("table_name", "field_name", F.date_format("at", "yyyy-MM").alias("month"), "kind").agg(
        F.count("*").alias("n_refs")
    )


@query(
    _ORPHANS
    + """SELECT r.field_name, r.k AS target_key, count(*) AS n_refs FROM refs r
WHERE r.k IS NOT NULL AND r.k <> '' AND NOT EXISTS (
  SELECT 1 FROM targets t WHERE t.field_name = r.field_name AND t.k = r.k AND t.r IS NULL) GROUP BY ALL"""
)
def p3_current(spark: SparkSession, d: str) -> DataFrame:
    """The state after all deltas: keys with references and no existence, and how many refer to them."""
    state = orphans.counts_of(
        orphans.reference_deltas(references(spark, d), F.col("key"), F.col("at")), existence(spark, d)
    )
    key = F.col("key")
    return orphans.orphan_report(state).select(
        F.substring_index(key, "/", 1).alias("field_name"),
        F.expr("substring(key, locate('/', key) + 1)").alias("target_key"),
        F.col("refs").alias("n_refs"),
    )


# ---------------------------------------------------------------- 6: units


def unit_rows(spark: SparkSession, d: str, check: bool = False) -> DataFrame:
    values = table(spark, d, "geo_values").select(
        "raw_id", upper_id(F.col("gsm_id")).alias("gsm"), gene_id(F.col("gene_id")).alias("gene"),
        F.lower(F.trim("method")).alias("m"), "log2_value", "unit_note",
    )
    # geo_platform repeats rows: one per sample, chosen by its content, not its place.
    samples = (
        table(spark, d, "geo_platform")
        .select(upper_id(F.col("gsm_id")).alias("gsm"), "data_processing", "scale_hint", "loaded_at")
        .groupBy("gsm")
        .agg(F.max_by(F.struct("data_processing", "scale_hint"), F.struct("loaded_at", "data_processing", "scale_hint")).alias("p"))
        .where(F.col("gsm").isNotNull())
    )
    axes = (
        table(spark, d, "method_axis")
        .groupBy(F.lower(F.trim("axis_name")).alias("m"))
        .agg(F.max("units").alias("units"))
    )
    rows = values.join(samples, "gsm", "left").join(axes, "m", "left")
    return units.harmonise(
        rows, "raw_id", "gsm", "gene", "log2_value",
        [F.col("unit_note"), F.col("p.data_processing"), F.col("units")], F.col("p.scale_hint"), check=check,
    )


def _unit_sql(text: str) -> str:
    """The first unit whose pattern the text holds."""
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({text}), '{p}') THEN '{u}'" for u, p in units.UNIT_PATTERNS) + " END"


def _target_sql(x: str, unit: str) -> str:
    tpm = f"CASE {unit} WHEN 'tpm' THEN {x} WHEN 'ktpm' THEN {x} * 1000 WHEN 'log10tpm1' THEN pow(10, {x}) - 1 WHEN 'lntpm1' THEN exp({x}) - 1 END"
    return f"CASE WHEN {unit} = 'log2tpm1' THEN {x} WHEN ({tpm}) >= 0 THEN log2(({tpm}) + 1) END"


_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
_UNITS_SQL = f"""WITH v AS (SELECT raw_id, nullif(upper(trim(gsm_id, {_BLANK})), '') AS gsm, regexp_replace(upper(trim(gene_id, {_BLANK})), '^(ENSG[0-9]+)\\.[0-9]+$', '\\1') AS gene, lower(trim(method)) AS m, CASE WHEN NOT isnan(log2_value) THEN log2_value END AS x, unit_note FROM geo_values),
s AS (SELECT * FROM (SELECT nullif(upper(trim(gsm_id, {_BLANK})), '') AS gsm, data_processing, scale_hint, row_number() OVER (PARTITION BY upper(trim(gsm_id, {_BLANK})) ORDER BY loaded_at DESC NULLS LAST, data_processing DESC NULLS LAST, scale_hint DESC NULLS LAST) AS k FROM geo_platform) WHERE k = 1 AND gsm IS NOT NULL),
ax AS (SELECT lower(trim(axis_name)) AS m, max(units) AS units FROM method_axis GROUP BY 1),
nm AS (SELECT raw_id, v.gsm, gene, x, {_unit_sql("unit_note")} AS u1, {_unit_sql("data_processing")} AS u2, {_unit_sql("units")} AS u3, CASE lower(trim(scale_hint)) WHEN 'linear' THEN 'tpm' WHEN 'log' THEN 'log2tpm1' END AS u4 FROM v LEFT JOIN s ON v.gsm = s.gsm LEFT JOIN ax ON v.m = ax.m),
b AS (SELECT raw_id, gsm, gene, x, coalesce(u1, u2, u3) AS named, coalesce(u1, u2, u3, u4) AS known FROM nm),
lv AS (SELECT gene, quantile_disc(y, 0.5) AS level FROM (SELECT gene, {_target_sql("x", "named")} AS y FROM b WHERE named IS NOT NULL) WHERE y IS NOT NULL GROUP BY gene),
o AS (SELECT DISTINCT b.gsm, b.gene, x, coalesce(level, (SELECT avg(level) FROM lv), 3.0) AS level FROM b LEFT JOIN lv ON b.gene = lv.gene WHERE known IS NULL AND x IS NOT NULL),
f AS (SELECT gsm, count(*) - count(abs({_target_sql("x", "'tpm'")} - level)) AS gaps, avg(abs({_target_sql("x", "'tpm'")} - level)) AS rt, avg(abs(x - level)) AS rl FROM o GROUP BY gsm)
"""


@query(_UNITS_SQL + "SELECT raw_id, unit FROM (SELECT raw_id, x, coalesce(known, CASE WHEN f.rl IS NULL THEN NULL WHEN gaps > 0 OR rt IS NULL OR rl <= rt THEN 'log2tpm1' ELSE 'tpm' END) AS unit FROM b LEFT JOIN f ON b.gsm IS NOT DISTINCT FROM f.gsm) WHERE x IS NOT NULL AND unit <> 'log2tpm1'")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a value in another unit than log2(TPM + 1), with that unit."""
    return unit_rows(spark, d).where(
        F.col("x").isNotNull() & F.col("unit").isNotNull() & (F.col("unit") != units.TARGET)
    ).select(F.col("row_id").alias("raw_id"), "unit")


@query()
def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """Every row's value as log2(TPM + 1), with its unit, where the unit came from, whether it is the only one that
    fits, and whether a named unit agrees with the levels of the other samples."""
    return unit_rows(spark, d, check=True).select(
        F.col("row_id").alias("raw_id"), F.col("sample").alias("gsm_id"), F.col("feature").alias("gene_id"),
        "unit", "unit_from", "unique", "agrees", F.col("value").alias("log2_tpm1"),
    )
