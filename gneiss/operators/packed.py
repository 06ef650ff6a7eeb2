"""Several values packed in one field: infer the delimiters of each source, split, keep positions.

A character either separates values or belongs to them. Both readings are scored by how many nats it takes to
write down the shapes (letters, digits and marks) of the texts that hold it: as whole values, whose shapes must
be worth learning, so varying piece counts and types cost; or as pieces, whose shapes must be those of the
source's other values, so pieces of another type cost. The cheaper reading wins.

Everything runs on built-in array and regular-expression functions over counted shapes; the only thing that
reaches the driver is one small row per (source, character).
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters besides letters and digits that values are expected to hold outside quotes.
VALUE_MARKS = "-.@_"
#: Nats in favour of the expectation: what little data cannot overturn.
PRIOR = 12.0
_LETTERS = r"\p{L}\p{M}\p{Nd}"
_QUOTED = r'"(?:[^"]|"")*"'
#: Stands for the candidate in shapes, so that one pattern serves all candidates.
_IT = "\x01"


def shape_of(text: Column) -> Column:
    """Runs of letters become A, runs of digits 9; all else stays."""
    return F.regexp_replace(F.regexp_replace(text, r"[\p{L}\p{M}]+", "A"), r"\p{Nd}+", "9")


def _class(marks: str) -> str:
    return "".join(re.escape(m) for m in marks)


def delimiter_scores(fields: DataFrame, source: str, text: str, marks: str = VALUE_MARKS, prior: float = PRIOR) -> DataFrame:
    """One row per source and candidate character: the evidence that it separates, and whether it does.

    Candidates are all characters outside quotes that are neither letters, digits nor quotes; line ends always
    separate. ``n_runs`` counts the runs of letters, digits, ``marks`` and the candidate that hold it inside
    (all other characters cut runs), ``n_shapes`` their distinct shapes. ``whole`` are the nats to write the
    runs' shapes as values of their own kind: their entropy, and ln 4 for every sign of every distinct shape, which
    must be spelled out once, so inconsistent piece counts make it grow. ``pieces`` are the nats to write the
    pieces' shapes with the (smoothed) shares that shapes have among the source's values without the candidate,
    one vote a field, so pieces of an irregular type make it grow. ``score`` is whole - pieces; with ``prior`` for a character that is no mark,
    or against one that is, above 0 it ``separates``. NULL and empty fields have no candidates.
    """
    held = fields.select(F.col(source).alias("s"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull())
    bare = F.regexp_replace(F.regexp_replace("t", _QUOTED, "\n"), r'["\x01]', "\n")
    # Equal shapes are counted before anything is cut up.
    shapes = held.select("s", shape_of(bare).alias("f")).groupBy("s", "f").agg(F.count("*").alias("c"))
    value = f"[A9{_class(marks)}]+"
    values = shapes.select("s", F.explode(F.array_distinct(F.regexp_extract_all("f", F.lit(value), F.lit(0)))).alias("f"), "c").groupBy("s", "f").agg(F.sum("c").alias("c"))
    each = shapes.select("s", "f", "c", F.explode(F.array_distinct(F.regexp_extract_all("f", F.lit(r"[^A9\n]"), F.lit(0)))).alias("d"))
    runs = F.regexp_extract_all(F.replace("f", F.col("d"), F.lit(_IT)), F.lit(f"[A9{_class(marks)}{_IT}]+"), F.lit(0))
    joined = (
        each.select("s", "d", "c", F.explode(F.filter(runs, lambda x: x.contains(_IT) & (F.replace(x, F.lit(_IT), F.lit("")) != ""))).alias("j"))
        .groupBy("s", "d", "j")
        .agg(F.sum("c").alias("c"))
    )
    whole = joined.groupBy("s", "d").agg(
        F.sum("c").alias("n_runs"), F.count("*").alias("n_shapes"), F.sum(F.col("c") * F.ln(F.col("c").cast("double"))).alias("cc"), F.sum(F.length("j")).alias("signs")
    )
    found = each.groupBy("s", "d").agg(F.sum("c").alias("n_fields"))
    # The source's values without the candidate: their number and the number of their shapes.
    norm = (
        found.select("s", "d")
        .join(values, "s")
        .groupBy("s", "d")
        .agg(F.coalesce(F.sum(F.when(~F.contains("f", F.col("d")), F.col("c"))), F.lit(0)).alias("n"), F.count_if(~F.contains("f", F.col("d"))).alias("k"))
    )
    parts = joined.select("s", "d", F.explode(F.filter(F.split("j", _IT), lambda x: x != "")).alias("f"), "c").groupBy("s", "d", "f").agg(F.sum("c").alias("m"))
    cost = (
        parts.join(values, ["s", "f"], "left")
        .join(norm, ["s", "d"], "left")
        .groupBy("s", "d")
        .agg(F.sum(-F.col("m") * F.ln((F.coalesce("c", F.lit(0)) + 0.5) / (F.coalesce("n", F.lit(0)) + 0.5 * (F.coalesce("k", F.lit(0)) + 2)))).alias("pieces"))
    )
    n = F.coalesce("n_runs", F.lit(0))
    all_whole = F.when(n > 0, n * F.ln(n.cast("double")) - F.col("cc") + F.col("signs") * math.log(4)).otherwise(F.lit(0.0))
    scored = found.join(whole, ["s", "d"], "left").join(cost, ["s", "d"], "left")
    score = all_whole - F.coalesce("pieces", F.lit(0.0))
    expected = F.col("d").isin(*marks) if marks else F.lit(False)
    return scored.select(
        F.col("s").alias("source"),
        F.col("d").alias("delimiter"),
        "n_fields",
        n.alias("n_runs"),
        F.coalesce("n_shapes", F.lit(0)).alias("n_shapes"),
        F.round(all_whole, 3).alias("whole"),
        F.round(F.coalesce("pieces", F.lit(0.0)), 3).alias("pieces"),
        F.round(score, 3).alias("score"),
        (score + F.when(expected, -prior).otherwise(prior) > 0).alias("separates"),
    )


def infer_delimiters(fields: DataFrame, source: str, text: str, marks: str = VALUE_MARKS, prior: float = PRIOR) -> dict[str, dict[str, bool]]:
    """For each source its candidate characters, best score first, and whether they separate.

    A character that is no mark but turns out to belong to values changes what the others cut, so a source
    with such characters takes the worst of them for a mark and is scored again until none is left. Its
    candidates are single characters, so rounds and collected rows are bounded by the characters of
    Unicode, whatever the size of the data.
    """
    out: dict[str, dict[str, bool]] = {}
    waiting = [(fields, marks)]
    while waiting:
        rows_of, inside = waiting.pop()
        found: dict[str, list] = {}
        for r in delimiter_scores(rows_of, source, text, inside, prior).collect():
            found.setdefault(r["source"], []).append(r)
        for name, rows in found.items():
            wrong = [r for r in rows if not r["separates"] and r["delimiter"] not in inside]
            if wrong:
                worst = min(wrong, key=lambda r: (r["score"], r["delimiter"]))["delimiter"]
                waiting.append((fields.where(F.col(source).eqNullSafe(F.lit(name))), inside + worst))
            else:
                out[name] = {r["delimiter"]: r["separates"] for r in sorted(rows, key=lambda r: (-r["score"], r["delimiter"]))}
    return out


def split_packed(
    fields: DataFrame, source: str, text: str, delimiters: Mapping[str, Mapping[str, bool]], marks: str = VALUE_MARKS
) -> DataFrame:
    """The columns of ``fields`` without ``text``, and ``pos`` (long, from 1) and ``item``, a row per value.

    Text in double quotes is one value, given without the quotes and with doubled quotes made
    single. Outside quotes a source's values consist of letters, digits and the characters of
    ``delimiters`` that do not separate; of sources without an entry, letters, digits and ``marks``. Everything
    else separates, a quote that nothing closes too. Blank pieces are no values and take no
    position; values keep their case and order, and repeats stay. NULL, empty and separator-only fields
    give no rows. Columns of ``fields`` named ``pos`` or ``item`` are replaced.
    """
    kept = [c for c in fields.columns if c.lower() not in (text.lower(), "pos", "item")]

    def tokens(inside: str) -> Column:
        return F.regexp_extract_all(F.col(text), F.lit(f"{_QUOTED}|[{_LETTERS}{_class(inside)}]+"), F.lit(0))

    found = tokens(marks)
    for name, candidates in delimiters.items():
        # A mark that did not occur changes nothing.
        inside = "".join(c for c, separates in candidates.items() if not separates)
        found = F.when(F.col(source).eqNullSafe(F.lit(name)), tokens(inside)).otherwise(found)
    inner = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    plain = F.transform(found, lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), inner(x)).otherwise(x))
    items = F.filter(plain, lambda x: x.rlike(r"[^\s\p{Z}]"))
    return fields.select(*[F.col(f"`{c}`") for c in kept], F.posexplode(items).alias("__pos", "item")).select(
        *[F.col(f"`{c}`") for c in kept], (F.col("__pos") + 1).cast("long").alias("pos"), "item"
    )
