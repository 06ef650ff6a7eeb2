"""Resolving names and ids: bridges, aliases, ambiguity, precedence and the discovery of join columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.resampling import digest
from gneiss.operators.reshape import first_of_each


def squeezed(c: Column) -> Column:
    """Lower case letters and digits only; NULL where nothing is left."""
    out = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return F.when(out != "", out)


def split_list(c: Column, pattern: str = r"[;,|/\\]", missing: Sequence[str] = ("", "nan", "none", "null")) -> Column:
    """Tokens of a delimited list, trimmed, missing-value words left out; NULL gives an empty array."""
    parts = F.transform(F.split(c, pattern), lambda x: F.trim(x))
    return F.coalesce(F.filter(parts, lambda x: ~F.lower(x).isin(*missing)), F.array().cast("array<string>"))


def last_of_nested(c: Column) -> Column:
    """First ``||`` block, its last ``;`` part."""
    return F.trim(F.element_at(F.split(F.element_at(F.split(c, r"\|\|"), 1), ";"), -1))


def names_long(df: DataFrame, entity: str, sources: Sequence[tuple[str, Column]]) -> DataFrame:
    """(entity, name, kind, rung) of every name, from plain or array columns, in order of precedence."""
    out = None
    for rung, (kind, column) in enumerate(sources):
        part = df.select(F.col(entity).alias("entity"), F.explode(column).alias("name"), F.lit(kind).alias("kind"), F.lit(rung).alias("rung"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("name").isNotNull() & (F.trim("name") != ""))


def collisions(names: DataFrame) -> DataFrame:
    """(name, n_entities, entities) of names that more than one entity has."""
    got = names.groupBy("name").agg(F.count_distinct("entity").alias("n_entities"), F.sort_array(F.collect_set("entity")).alias("entities"))
    return got.where(F.col("n_entities") > 1)


def first_wins(names: DataFrame) -> DataFrame:
    """(name, entity, kind): each name's entity by precedence, then the least entity."""
    return first_of_each(names, ["name"], [F.asc("rung"), F.asc("entity")]).select("name", "entity", "kind")


def unambiguous(names: DataFrame) -> DataFrame:
    """(name, entity) of names that only one entity has."""
    return names.groupBy("name").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity")).where(F.col("n") == 1).select("name", "entity")


def resolve_by_rungs(queries: DataFrame, query_id: str, name: Column, names: DataFrame) -> DataFrame:
    """(query_id, entity, matched_via, is_ambiguous): all entities of the best rung that has the name.

    One join for all rungs; a rung with several entities gives several rows, flagged. Queries that no
    rung has come out with NULL.
    """
    asked = queries.select(F.col(query_id), name.alias("name"))
    hits = asked.join(names.select("name", "entity", "kind", "rung").distinct(), "name")
    best = hits.groupBy(query_id).agg(F.min("rung").alias("rung"))
    kept = hits.join(best, [query_id, "rung"]).select(query_id, "entity", "kind").distinct()
    counts = kept.groupBy(query_id).agg(F.count_distinct("entity").alias("n"))
    found = kept.join(counts, query_id)
    return asked.select(query_id).distinct().join(found, query_id, "left").select(
        query_id, "entity", F.col("kind").alias("matched_via"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("is_ambiguous")
    )


def bridge(first: DataFrame, second: DataFrame, key: str, middle: str, target: str, priority: str) -> DataFrame:
    """key -> middle -> target; of several bridges for a key the one of greatest ``priority``, then least target."""
    both = first.join(second.select(middle, target), middle)
    return first_of_each(both, [key], [F.desc(priority), F.asc(target)]).select(key, target)


def overlap_pairs(columns: DataFrame, least: int = 5, share: float = 0.05) -> DataFrame:
    """(a, b, n_a, n_b, n_shared): columns that share at least ``least`` values and ``share`` of the smaller set.

    ``columns`` is long: (column_name, value). Values meet by key; the pairs are those of columns, and a
    value's columns are as few as the catalog has.
    """
    distinct = columns.where(F.col("value").isNotNull()).distinct()
    sizes = distinct.groupBy("column_name").agg(F.count("*").alias("n"))
    owners = distinct.groupBy("value").agg(F.sort_array(F.collect_set("column_name")).alias("cs"))
    # One row per set of owners: values with the same owners are counted together before pairs are made.
    sets = owners.where(F.size("cs") > 1).groupBy("cs").agg(F.count("*").alias("n"))
    pairs = sets.select("n", "cs", F.posexplode("cs").alias("i", "a")).select("n", "a", F.explode(F.expr("slice(cs, i + 2, size(cs))")).alias("b"))
    shared = pairs.groupBy("a", "b").agg(F.sum("n").alias("n_shared"))
    sized = shared.join(sizes.select(F.col("column_name").alias("a"), F.col("n").alias("n_a")), "a").join(
        sizes.select(F.col("column_name").alias("b"), F.col("n").alias("n_b")), "b"
    )
    enough = (F.col("n_shared") >= least) & (F.col("n_shared") >= share * F.least("n_a", "n_b"))
    return sized.where(enough).select("a", "b", "n_a", "n_b", "n_shared")


def presence(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(both, left_only, right_only): the full outer join audit as one row."""
    left, right = a.select(*keys).distinct().withColumn("__a", F.lit(1)), b.select(*keys).distinct().withColumn("__b", F.lit(1))
    got = left.join(right, list(keys), "full_outer")
    inside, outside = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    return got.agg(F.count_if(inside & outside).alias("both"), F.count_if(inside & ~outside).alias("left_only"), F.count_if(~inside & outside).alias("right_only"))


def venn(members: DataFrame, key: str, group: str, groups: Sequence[str]) -> DataFrame:
    """(in_<group>.., n): counts of every region of the overlap of the groups' keys."""
    flags = members.groupBy(key).agg(*[F.bool_or(F.col(group) == g).alias(f"in_{g}") for g in groups])
    return flags.groupBy(*[f"in_{g}" for g in groups]).agg(F.count("*").alias("n"))


def matched_pairs(cases: DataFrame, controls: DataFrame, key: str, bands: Sequence[str], seed: int = 0) -> DataFrame:
    """(bands, case, control): each case with a control of its bands, none used twice, by seeded order."""

    def placed(df: DataFrame, name: str) -> DataFrame:
        order = digest(seed, key)
        return df.select(*bands, F.col(key).alias(name), F.row_number().over(Window.partitionBy(*bands).orderBy(order, F.col(key))).alias("__k"))

    return placed(cases, "case").join(placed(controls, "control"), [*bands, "__k"]).drop("__k")


def mapped(key: Column, entries: Sequence[tuple[object, object]]) -> Column:
    """The value of a small mapping, NULL where it has none; of several entries of a key the last wins."""
    last = dict(entries)
    return F.create_map(*[F.lit(x) for pair in last.items() for x in pair])[key]


def leading_symbol(label: Column) -> Column:
    """SYMBOL of "SYMBOL (number)"."""
    return F.substring_index(label, " (", 1)


def fast_path(query: Column, datasets: Sequence[str]) -> Column:
    """Which lookup an input asks for by its form alone: a gene id with a model id, a gene id, or a data set's name; else NULL."""
    text = F.trim(query)
    gene = r"(?i)^ENSG[0-9]+(\.[0-9]+)?"
    return (
        F.when(text.rlike(gene + r"\s*[,/|+ ]\s*ACH-[0-9]+$"), "score_explainer").when(text.rlike(gene + "$"), "gene_alias_lookup")
        .when(F.lower(text).isin(*datasets), "dataset_info")
    )


def with_fallback(asked: DataFrame, query_id: str, key: str, sources: dict[str, DataFrame | None]) -> DataFrame:
    """(query_id, entry, source, degraded): the answer of the first source that has one.

    ``sources`` are (key, entry) tables in the order in which they are asked, None for one that is out of reach: it
    answers nothing and is named in ``degraded`` of every query that got as far as it. Several entries
    of a key in one source: the least.
    """
    out = asked.select(query_id, F.col(key).alias("__k"), F.lit(None).cast("string").alias("entry"), F.lit(None).cast("string").alias("source"), F.array().cast("array<string>").alias("degraded"))
    for name, source in sources.items():
        open_ = F.col("entry").isNull()
        if source is None:
            out = out.withColumn("degraded", F.when(open_, F.array_append("degraded", F.lit(name))).otherwise(F.col("degraded")))
            continue
        found = source.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__s")).agg(F.min("entry").alias("__e"))
        joined = out.join(found, F.when(open_, F.col("__k")) == F.col("__s"), "left")
        out = joined.withColumns({"source": F.when(open_ & F.col("__e").isNotNull(), F.lit(name)).otherwise(F.col("source")), "entry": F.coalesce("entry", "__e")}).drop("__s", "__e")
    return out.select(query_id, "entry", "source", "degraded")
