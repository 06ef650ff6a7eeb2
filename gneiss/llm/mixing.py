"""Mix sources to target shares of the total size.

Every text has a hash in [0, 1024^3), the same for all its copies. A source's texts below a hash threshold
are the ones that get one repeat more; thresholds for larger budgets include those of smaller ones. The threshold is
found by histograms: tokens by (source, first 1024 buckets), then only the bucket on the boundary again
by its next 1024, and once more. Histograms are sums before the shuffle; nothing is sorted by hash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.shared import written
from gneiss.operators.skew import spread_join

#: Up to so many target sources their rows are broadcast; beyond it they are joined by shuffling, hot sources spread.
MOST_SOURCES = 10_000
FANOUT = 1024
LEVELS = 3
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer cuts text before merging, as its publisher states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _encoding(vocabulary: bytes):  # noqa: ANN202
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(spark: SparkSession, text: Column, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> Column:
    """Tokens of the whole text by a public byte-level vocabulary; 0 for NULL and empty texts.

    The vocabulary file is read where the query is planned and sent to the tasks (under 2 MB), so it need not lie
    on every machine.
    """
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(shared.value).encode_ordinary
        for part in parts:
            yield pd.Series([len(encode(t)) if t else 0 for t in part], dtype="int64")

    return count(text)


def _with_plan(rows: DataFrame, plan: DataFrame, most_sources: int, spread_by: str = "h") -> DataFrame:
    """``rows`` joined with the plan's one row per source: broadcast up to ``most_sources`` of them, else by a shuffle in
    which a source's rows are spread over salts."""
    if len(plan.limit(most_sources + 1).take(most_sources + 1)) <= most_sources:
        return rows.join(F.broadcast(plan), "source")
    return spread_join(rows, plan, "source", "inner", spread_by)


def sized(docs: DataFrame, doc_id: Column, source: Column, tokens: Column, text: Column | None = None) -> DataFrame:
    """(doc_id, source, tokens, h, copy, copies) of every document, written once since several passes read it.

    With ``text``, copies of a text in one source share their hash and are numbered from 0 by doc_id; a
    document without text, and without ``text`` every document, is the only copy of its own.
    """
    # the first letter keeps ids and texts apart
    own = F.concat(F.lit("i"), doc_id.cast("string"))
    key = F.sha2(own if text is None else F.when(F.length(text) > 0, F.concat(F.lit("t"), text)).otherwise(own), 256)
    base = docs.select(doc_id.alias("doc_id"), source.alias("source"), tokens.alias("tokens"), key.alias("key"))
    hashed = base.withColumn("h", F.pmod(F.conv(F.substring("key", 1, 12), 16, 10).cast("bigint"), F.lit(FANOUT**LEVELS)))
    if text is None:
        return written(hashed.withColumns({"copy": F.lit(0), "copies": F.lit(1)}).drop("key"))
    same = Window.partitionBy("source", "key")
    numbered = hashed.withColumns({"copy": F.row_number().over(same.orderBy("doc_id")) - 1, "copies": F.count("*").over(same)})
    return written(numbered.drop("key"))


def _buckets(rows: DataFrame, width: int) -> DataFrame:
    """Histogram of a level: per source and bucket of ``width`` hashes the tokens of all documents (t_all) and of distinct
    texts (t). Summed before the shuffle."""
    once = F.when(F.col("copy") == 0, F.col("tokens"))
    return rows.groupBy("source", F.floor(F.col("h") / width).alias("bucket")).agg(F.sum("tokens").alias("t_all"), F.coalesce(F.sum(once), F.lit(0)).alias("t"))


def histogram(sizes: DataFrame) -> DataFrame:
    """The first level's histogram, written once: ``FANOUT`` rows a source at most. All of a source's sizes, its shortfall
    and the first boundary are read off it."""
    return written(_buckets(sizes, FANOUT ** (LEVELS - 1)))


def budgets(first: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its size, what it needs of the total size, its whole repeats and what is left over, from the
    first ``histogram``.

    Repeats are those of texts: whole and rest go by the size of the distinct texts, while size and ``short``
    count every document. A source is short if its whole histogram, each bucket taken max_repeats times, stays below
    what it needs. The total is the size of all documents, those without source or target included. ``targets`` has
    source (unique), share and max_repeats; a source without documents has size 0. NULL shares and
    repeats count as 0.
    """
    totals = first.groupBy("source").agg(F.sum("t_all").alias("size"), F.sum("t").alias("distinct_size"))
    total = totals.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    own = totals.where(F.col("source").isNotNull())
    size, once, need = F.coalesce("size", F.lit(0)), F.coalesce("distinct_size", F.lit(0)), F.coalesce("share", F.lit(0.0)) * F.col("total")
    most = F.coalesce("max_repeats", F.lit(0)).cast("bigint")
    base = (
        targets.join(own, "source", "left")
        .join(F.broadcast(total))  # one row
        .select(
            "source", F.coalesce("share", F.lit(0.0)).alias("share"), most.alias("max_repeats"), "total", size.alias("size"),
            once.alias("distinct_size"), need.alias("need"), (size * most < need).alias("short"),
        )
    )
    whole = F.when(F.col("distinct_size") > 0, F.least(F.floor(F.col("need") / F.col("distinct_size")), F.col("max_repeats"))).otherwise(F.lit(0))
    out = base.withColumn("whole", whole.cast("bigint"))
    rest = F.when(F.col("whole") < F.col("max_repeats"), F.col("need") - F.col("whole") * F.col("distinct_size")).otherwise(F.lit(0.0))
    return written(out.withColumn("rest", rest))


def thresholds(sizes: DataFrame, first: DataFrame, plan: DataFrame, most_sources: int = MOST_SOURCES) -> DataFrame:
    """``plan`` with ``threshold``: distinct texts of the source with h below it sum up to at most ``rest`` tokens, and
    one more bucket of the last level would go beyond. The first level is ``histogram``'s; of each further one only the
    boundary bucket is counted again. Up to ``most_sources`` target sources are broadcast, more are joined by shuffling."""
    found = plan.withColumns({"prefix": F.lit(0).cast("bigint"), "left": F.col("rest")})
    for level in range(LEVELS):
        width = FANOUT ** (LEVELS - 1 - level)
        if level == 0:
            buckets = first.where(F.col("source").isNotNull())
        else:
            inside = _with_plan(sizes.where(F.col("copy") == 0), found.select("source", "prefix"), most_sources)
            buckets = _buckets(inside.where(F.floor(F.col("h") / (width * FANOUT)) == F.col("prefix")), width)
        upto = F.sum("t").over(Window.partitionBy("source").orderBy("bucket"))  # FANOUT rows at most
        step = buckets.withColumn("upto", upto).join(found.select("source", "left"), "source")
        # The boundary: the first bucket that does not fit whole; without one, everything below the end fits.
        edge = step.groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("left"), F.col("bucket"))).alias("edge"),
            F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))).alias("used"),
        )
        found = found.join(edge, "source", "left").select(
            *plan.columns,
            F.coalesce("edge", (F.col("prefix") + 1) * FANOUT).cast("bigint").alias("prefix"),
            (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
        )
        found = written(found)  # one row per target source
    return found.select(*plan.columns, F.col("prefix").alias("threshold"))


def mix(sizes: DataFrame, first: DataFrame, plan: DataFrame, most_sources: int = MOST_SOURCES) -> DataFrame:
    """(doc_id, source, tokens, repeats) of every document that is used, ``repeats`` times each.

    A source's texts are used ``whole`` times, those below its threshold once more, never more than
    max_repeats; the uses of a text are dealt out to its copies in turn. Documents without source or
    target are not used.
    """
    cuts = thresholds(sizes, first, plan, most_sources).select("source", "whole", "threshold", "max_repeats")
    used = _with_plan(sizes, cuts, most_sources)
    uses = F.least(F.col("whole") + (F.col("h") < F.col("threshold")).cast("bigint"), F.col("max_repeats"))
    repeats = F.floor((uses + F.col("copies") - 1 - F.col("copy")) / F.col("copies")).cast("bigint")
    return used.select("doc_id", "source", "tokens", repeats.alias("repeats")).where(F.col("repeats") > 0)


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """What every target source really contributes: its tokens and its share of the mix and of the wanted total."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    every = got.agg(F.sum("tokens").alias("mixed"))
    tokens = F.coalesce("tokens", F.lit(0))
    return (
        plan.join(got, "source", "left")
        .join(F.broadcast(every))
        .select(
            "source", "share", "size", "max_repeats", "short", tokens.alias("tokens"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            (tokens / F.nullif(F.col("mixed"), F.lit(0))).alias("share_of_mix"),
            (tokens / F.nullif(F.col("total"), F.lit(0))).alias("share_of_total"),
        )
    )
