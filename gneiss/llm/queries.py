"""Queries p4, p5, p7, p8, p9 and p10 over whole tables, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions.ids import gene_id, lower_label, upper_id
from gneiss.llm import canonical, language, leakage, mixing, quantiles, topn
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


# ---------------------------------------------------------------- 4: top models of every group

_TOP = """WITH b AS (
  SELECT query_id, lower(trim(lineage)) AS lineage, upper(trim(model_id)) AS model_id, max(metric) AS metric
  FROM kept WHERE query_id IS NOT NULL AND trim(lineage) <> '' AND trim(model_id) <> '' AND metric IS NOT NULL AND NOT isnan(metric)
  GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, lineage ORDER BY metric DESC, model_id) AS k FROM b)
"""


def top_models(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_items(
        table(spark, d, "kept"),
        {"query_id": F.col("query_id"), "lineage": lower_label(F.col("lineage"))},
        upper_id(F.col("model_id")), F.col("metric"), 5, "model_id", "metric", "rank_within_lineage",
    )


@query(_TOP + "SELECT query_id, lineage, model_id, k AS rank_within_lineage FROM r WHERE k <= 5")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best models of every query and lineage with their true ranks."""
    return top_models(spark, d).select("query_id", "lineage", "model_id", "rank_within_lineage")


@query(
    _TOP
    + """SELECT lineage, count(*) AS n_models, count(DISTINCT query_id) AS n_queries, round(avg(metric), 9) AS mean_metric
FROM r WHERE k <= 5 GROUP BY lineage"""
)
def p4_by_lineage(spark: SparkSession, d: str) -> DataFrame:
    """What the best models of all queries look like per lineage."""
    return top_models(spark, d).groupBy("lineage").agg(
        F.count("*").alias("n_models"), F.count_distinct("query_id").alias("n_queries"), F.round(F.avg("metric"), 9).alias("mean_metric")
    )


# ---------------------------------------------------------------- 5: percentiles

PROBS = [0.05, 0.25, 0.5, 0.75, 0.9, 0.95]


def percentile_rows(spark: SparkSession, d: str, size: int = 256) -> DataFrame:
    rows = table(spark, d, "expr_long").where(F.col("log2_value") >= 0)  # NULL and impossible values are missing
    keys = {"gene_id": gene_id(F.col("gene_id")), "stratum": lower_label(F.col("stratum"))}
    leaves = quantiles.summarise(rows, keys, F.col("log2_value"), size)
    return quantiles.rollup(quantiles.premerge(leaves, list(keys), quantiles.planned_leaves(rows), size), "gene_id", "stratum", PROBS, size)


@query(
    r"""WITH v AS (
  SELECT regexp_replace(upper(trim(gene_id)), '^(ENSG[0-9]+)\.[0-9]+$', '\1') AS gene_id, lower(trim(stratum)) AS stratum, log2_value AS x
  FROM expr_long WHERE log2_value >= 0 AND NOT isnan(log2_value)),
g AS (SELECT gene_id, stratum, quantile_disc(x, 0.5) AS m FROM v WHERE stratum IS NOT NULL AND gene_id IS NOT NULL GROUP BY ALL),
o AS (SELECT gene_id, quantile_disc(x, 0.9) AS p FROM v GROUP BY ALL)
SELECT gene_id, stratum FROM g JOIN o USING (gene_id) WHERE m > p"""
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose median lies above the 90th percentile of their gene."""
    return percentile_rows(spark, d).where(
        F.col("gene_id").isNotNull() & F.col("stratum").isNotNull()
        & (F.get("q", F.lit(PROBS.index(0.5))) > F.get("all_q", F.lit(PROBS.index(0.9))))
    ).select("gene_id", "stratum")


@query()
def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per gene and stratum and per gene over all strata, each with its rank-error bound."""
    rows = percentile_rows(spark, d)
    probs = F.array(*[F.lit(p) for p in PROBS])

    def flat(n: str, q: str, err: str, stratum) -> DataFrame:  # noqa: ANN001
        return rows.select("gene_id", stratum, F.col(n).alias("n"), F.explode(F.arrays_zip(probs.alias("p"), F.col(q).alias("value"), F.col(err).alias("rank_error"))).alias("z"))

    each = flat("n", "q", "rank_error", F.col("stratum"))
    whole = flat("all_n", "all_q", "all_rank_error", F.lit("(all)").alias("stratum")).distinct()
    return each.unionByName(whole).select("gene_id", "stratum", "n", "z.p", "z.value", "z.rank_error")


@query()
def p5_by_load(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of each month's loads, kept apart, then put together: the form for separate loads."""
    rows = table(spark, d, "expr_long").where(F.col("log2_value") >= 0)
    keys = {
        "gene_id": gene_id(F.col("gene_id")), "stratum": lower_label(F.col("stratum")), "load": F.date_format("loaded_at", "yyyy-MM")
    }
    loads = quantiles.merge(quantiles.summarise(rows, keys, F.col("log2_value")), list(keys))
    together = quantiles.rollup(loads, "gene_id", "stratum", PROBS)
    at = F.lit(PROBS.index(0.5))
    return together.select("gene_id", "stratum", "n", F.get("q", at).alias("median"), F.get("rank_error", at).alias("rank_error"))


# ---------------------------------------------------------------- 7: free-typed names

#: Words that people add to names without meaning another entry.
CELL_WORDS = r"cell lines?|cells?|lines?|human|parental|adherent|suspension|passage \d+|p\d{1,2}"
GENE_WORDS = r"human|genes?|proteins?|mrna|expression(?: of)?|levels?(?: of)?|of|the|(?<=\d)\.\d{1,3}"


def _names(df: DataFrame, entry: str, single: list[str], lists: list[str]) -> DataFrame:
    """(entry, name) of every name of the reference table, in plain form."""
    each = F.array(*[F.col(c) for c in single])
    for c in lists:
        each = F.concat(each, F.coalesce(F.split(F.col(c), r"\|"), F.array().cast("array<string>")))
    names = df.select(F.col(entry).alias("entry"), F.explode(each).alias("t"))
    return names.select("entry", F.explode(canonical.normal_forms(F.col("t"))).alias("name"))


def typed_names(spark: SparkSession, d: str) -> DataFrame:
    lines = canonical.match(
        table(spark, d, "no_depmap_equivalent_hpa_rna").select("row_id", "hpa_name"),
        ["row_id"],
        canonical.normal_forms(F.col("hpa_name"), CELL_WORDS),
        _names(table(spark, d, "cell_line_lookup"), "model_id", ["cell_line_name", "stripped_cell_line_name"], ["synonyms"]),
    )
    genes = canonical.match(
        table(spark, d, "gene_alias_result").select("query_id", "query"),
        ["query_id"],
        canonical.normal_forms(F.regexp_replace("query", r"(?i)(ensg\d{11})\.\d+", "$1"), GENE_WORDS),
        _names(table(spark, d, "gene_lookup"), "ensg_id", ["ensg_id", "hgnc_symbol", "approved_name"], ["prev_symbols", "alias_symbols"]),
    )
    return lines.select(F.lit("no_depmap_equivalent_hpa_rna").alias("table_name"), "row_id", "entry", "distance", "n_entries").unionByName(
        genes.select(F.lit("gene_alias_result").alias("table_name"), F.col("query_id").alias("row_id"), "entry", "distance", "n_entries")
    )


_FOLD = "regexp_replace(translate(lower({}), '０１２３４５６７８９', '0123456789'), '[^a-z0-9]+', '', 'g')"
_NAMES_SQL = rf"""
lines AS (SELECT model_id AS entry, unnest([cell_line_name, stripped_cell_line_name] || coalesce(string_split(synonyms, '|'), [])) AS t FROM cell_line_lookup),
genes AS (SELECT ensg_id AS entry, unnest([ensg_id, hgnc_symbol, approved_name] || coalesce(string_split(prev_symbols, '|'), []) || coalesce(string_split(alias_symbols, '|'), [])) AS t FROM gene_lookup),
names AS (SELECT 'no_depmap_equivalent_hpa_rna' AS table_name, entry, {_FOLD.format("t")} AS name FROM lines WHERE t IS NOT NULL
  UNION SELECT 'gene_alias_result', entry, {_FOLD.format("t")} FROM genes WHERE t IS NOT NULL),
typed AS (SELECT 'no_depmap_equivalent_hpa_rna' AS table_name, row_id, hpa_name AS t,
    regexp_replace(lower(hpa_name), '^\s*cell line\s|[\s(]+(cells|cell line|line|human|parental|adherent|p[0-9]+)\W*$', '', 'g') AS u FROM no_depmap_equivalent_hpa_rna
  UNION ALL SELECT 'gene_alias_result', query_id, query,
    regexp_replace(lower(query), '^\s*(expression of|gene|human)\s|[\s(]+(human|gene|protein|expression)\W*$|\.[0-9]+\s*$', '', 'g') FROM gene_alias_result),
forms AS (SELECT table_name, row_id, {_FOLD.format("t")} AS form FROM typed UNION SELECT table_name, row_id, {_FOLD.format("u")} FROM typed),
asked AS (SELECT DISTINCT table_name, form FROM forms WHERE form <> ''),
near AS (SELECT a.table_name, a.form, n.entry, levenshtein(a.form, n.name) AS distance FROM asked a JOIN names n
  ON a.table_name = n.table_name AND abs(length(a.form) - length(n.name)) <= 2 AND levenshtein(a.form, n.name) <= CASE WHEN length(a.form) > 2 THEN 2 ELSE 0 END),
hits AS (SELECT f.table_name, f.row_id, entry, distance, min(distance) OVER (PARTITION BY f.table_name, f.row_id) AS best
  FROM forms f JOIN near USING (table_name, form)),
won AS (SELECT table_name, row_id, min(entry) AS entry, min(distance) AS distance FROM hits WHERE distance = best GROUP BY table_name, row_id HAVING count(DISTINCT entry) = 1)
"""


@query(
    "WITH" + _NAMES_SQL + "SELECT DISTINCT table_name, row_id, coalesce(entry, 'UNMATCHED') AS canonical_id FROM typed LEFT JOIN won USING (table_name, row_id)"
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every free-typed name with the entry it means, or UNMATCHED."""
    return typed_names(spark, d).select(
        "table_name", "row_id", F.coalesce("entry", F.lit("UNMATCHED")).alias("canonical_id")
    )


_OUTCOMES = "WITH" + _NAMES_SQL + """,
nx AS (SELECT table_name, row_id, count(DISTINCT entry) AS n_entries FROM hits WHERE distance = best GROUP BY ALL),
o AS (SELECT t.table_name, t.row_id, t.t, coalesce(n_entries, 0) AS n_entries, CASE WHEN w.entry IS NOT NULL AND w.distance = 0 THEN 'exact' WHEN w.entry IS NOT NULL THEN 'slips ' || w.distance WHEN n_entries > 1 THEN 'several entries' ELSE 'unmatched' END AS outcome
  FROM typed t LEFT JOIN won w USING (table_name, row_id) LEFT JOIN nx USING (table_name, row_id))
"""


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    slips = F.concat(F.lit("slips "), F.col("distance").cast("string"))
    known = F.col("entry").isNotNull()
    outcome = F.when(known & (F.col("distance") == 0), "exact").when(known, slips).when(F.col("n_entries") > 1, "several entries").otherwise("unmatched")
    return typed_names(spark, d).withColumn("outcome", outcome)


@query(
    _OUTCOMES
    + """SELECT o.table_name, CASE WHEN o.table_name = 'no_depmap_equivalent_hpa_rna' THEN h.resolution_method END AS resolution_method, outcome, count(*) AS n_rows
FROM o LEFT JOIN no_depmap_equivalent_hpa_rna h ON h.row_id = o.row_id GROUP BY ALL"""
)
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each table, and of each method that had resolved them before, match exactly, with how many
    slips, are as near to several entries, or are not matched at all."""
    before = table(spark, d, "no_depmap_equivalent_hpa_rna").select(F.lit("no_depmap_equivalent_hpa_rna").alias("table_name"), "row_id", "resolution_method")
    return outcomes(spark, d).join(before, ["table_name", "row_id"], "left").groupBy("table_name", "resolution_method", "outcome").agg(F.count("*").alias("n_rows"))


@query(_OUTCOMES + "SELECT table_name, t AS value, max(n_entries) AS n_entries, count(*) AS n_rows FROM o WHERE outcome IN ('unmatched', 'several entries') GROUP BY ALL")
def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values as typed that mean no entry, or several, and how often each occurs."""
    typed = table(spark, d, "no_depmap_equivalent_hpa_rna").select(F.lit("no_depmap_equivalent_hpa_rna").alias("table_name"), "row_id", F.col("hpa_name").alias("value")).unionByName(
        table(spark, d, "gene_alias_result").select(F.lit("gene_alias_result").alias("table_name"), F.col("query_id").alias("row_id"), F.col("query").alias("value"))
    )
    left = outcomes(spark, d).where(F.col("entry").isNull()).join(typed, ["table_name", "row_id"])
    return left.groupBy("table_name", "value").agg(F.max("n_entries").alias("n_entries"), F.count("*").alias("n_rows"))


# ---------------------------------------------------------------- 8: leaked evaluation items


def leaked(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(
        table(spark, d, "documents"), F.col("doc_id"), F.col("text"), table(spark, d, "eval_items"), F.col("item_id"), F.col("text")
    )


@query()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items that leaked into them."""
    return leaked(spark, d).select("doc_id", "item_id").distinct()


@query()
def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked item with the documents that hold it and how much of it they hold."""
    return leaked(spark, d).groupBy("item_id").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.round(F.max("share"), 6).alias("most"), F.round(F.avg("share"), 6).alias("mean_share")
    )


# ---------------------------------------------------------------- 9: mixing sources


def _mixing(spark: SparkSession, d: str, tokens: Callable[[SparkSession, Column], Column] = mixing.token_count) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes, first histogram and plan."""
    docs = table(spark, d, "documents")
    sizes = mixing.sized(docs, F.col("doc_id"), lower_label(F.col("source")), tokens(spark, F.col("text")), F.col("text"))
    targets = table(spark, d, "mix_targets").select(
        lower_label(F.col("source")).alias("source"), F.col("target_share").alias("share"), "max_repeats"
    )
    first = mixing.histogram(sizes)
    return sizes, first, mixing.budgets(first, targets)


def characters(_: SparkSession, text: Column) -> Column:
    """Sizes in characters, which SQL can count too."""
    return F.coalesce(F.length(text), F.lit(0)).cast("bigint")


@query(
    """WITH s AS (SELECT lower(trim(source)) AS source, sum(coalesce(length(text), 0)) AS n FROM documents GROUP BY 1)
SELECT m.source FROM mix_targets m LEFT JOIN s ON s.source = lower(trim(m.source))
WHERE coalesce(s.n, 0) * max_repeats < target_share * (SELECT sum(n) FROM s)"""
)
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that miss their target even at full repeats: their whole histogram does not reach it."""
    return _mixing(spark, d)[2].where("short").select("source")


@query()
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are used and how often."""
    return mixing.mix(*_mixing(spark, d)).select("doc_id", "source", "tokens", "repeats")


@query()
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each source's target share, its share of the mix and of the wanted total."""
    sizes, first, plan = _mixing(spark, d)
    return mixing.shares(mixing.mix(sizes, first, plan), plan)


# The mix by characters: the same operator and whole tables, with sizes that SQL has too. Texts in the order of their
# hash fill the budget while they fit; the operator stops at a bucket of its last level, where two hashes are rarely equal.
_MIX_SQL = """WITH b AS (SELECT doc_id, nullif(lower(trim(source)), '') AS source, coalesce(length(text), 0) AS tokens, sha256(CASE WHEN length(text) > 0 THEN 't' || text ELSE 'i' || doc_id END) AS key FROM documents),
k AS (SELECT *, CAST('0x' || key[1:12] AS BIGINT) % 1073741824 AS h, row_number() OVER (PARTITION BY source, key ORDER BY doc_id) - 1 AS copy, count(*) OVER (PARTITION BY source, key) AS copies FROM b),
t AS (SELECT source, sum(tokens) AS size, sum(tokens) FILTER (WHERE copy = 0) AS once FROM k GROUP BY source),
p AS (SELECT lower(trim(m.source)) AS source, coalesce(target_share, 0) AS share, coalesce(max_repeats, 0) AS max_repeats, coalesce(size, 0) AS size, coalesce(once, 0) AS once, (SELECT sum(size) FROM t) AS total,
  coalesce(target_share, 0) * (SELECT sum(size) FROM t) AS need FROM mix_targets m LEFT JOIN t ON t.source = lower(trim(m.source))),
q AS (SELECT *, CASE WHEN once > 0 THEN least(floor(need / once), max_repeats) ELSE 0 END AS whole FROM p),
r AS (SELECT *, CASE WHEN whole < max_repeats THEN need - whole * once ELSE 0 END AS rest FROM q),
c AS (SELECT source, h, sum(sum(tokens)) OVER (PARTITION BY source ORDER BY h) AS upto FROM k WHERE copy = 0 GROUP BY source, h),
e AS (SELECT r.source, min(h) AS threshold FROM r JOIN c USING (source) WHERE upto > rest GROUP BY r.source),
u AS (SELECT doc_id, k.source, tokens, floor((least(whole + CASE WHEN h < coalesce(threshold, 1073741824) THEN 1 ELSE 0 END, max_repeats) + copies - 1 - copy) / copies) AS repeats
  FROM k JOIN r ON k.source = r.source LEFT JOIN e ON k.source = e.source),
x AS (SELECT doc_id, source, tokens, CAST(repeats AS BIGINT) AS repeats FROM u WHERE repeats > 0)
"""


@query(_MIX_SQL + "SELECT * FROM x")
def p9_mix_characters(spark: SparkSession, d: str) -> DataFrame:
    """The mix with sizes in characters."""
    return mixing.mix(*_mixing(spark, d, characters))


@query(
    _MIX_SQL
    + """SELECT r.source, share, size, max_repeats, size * max_repeats < need AS short, coalesce(n, 0) AS tokens, coalesce(most, 0) AS most_repeats,
  round(coalesce(n, 0) / sum(n) OVER (), 9) AS share_of_mix, round(coalesce(n, 0) / total, 9) AS share_of_total
FROM r LEFT JOIN (SELECT source, CAST(sum(tokens * repeats) AS BIGINT) AS n, max(repeats) AS most FROM x GROUP BY source) USING (source)"""
)
def p9_shares_characters(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached with sizes in characters."""
    sizes, first, plan = _mixing(spark, d, characters)
    got = mixing.shares(mixing.mix(sizes, first, plan), plan)
    return got.withColumns({c: F.round(c, 9) for c in ("share_of_mix", "share_of_total")})


# ---------------------------------------------------------------- 10: languages


def stretches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = language.fit(docs, F.col("doc_id"), F.col("text"), F.col("lang"))
    carried = {"doc_id": F.col("doc_id"), "label": language.named_language(F.col("lang"))}
    return language.segments(docs, carried, F.col("text"), model, spark)


def text_languages(spark: SparkSession, d: str) -> DataFrame:
    found = language.languages_of(stretches(spark, d), ["doc_id", "label"])
    right = F.max(F.col("lang").eqNullSafe(F.col("label"))).over(Window.partitionBy("doc_id", "label"))
    return found.withColumn("label_right", right)


@query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The languages of documents whose label is missing or wrong, and of all documents in several."""
    wrong = ~F.col("label_right") | (F.col("n_languages") > 1)
    return text_languages(spark, d).where(wrong).select("doc_id", "lang").distinct()


@query()
def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document's languages with their sentences and confidence, and whether its label is right."""
    return text_languages(spark, d).select("doc_id", "lang", "sentences", F.round("confidence", 6).alias("confidence"), "n_languages", "label_right")


@query()
def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch in one language with its sentences and confidence."""
    return stretches(spark, d).select("doc_id", "part", "first_sentence", "sentences", "lang", "confidence")
