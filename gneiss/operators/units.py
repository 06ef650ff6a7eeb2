"""Quantities in different units: read the unit from text, else solve for it by residuals.

``solve_units`` is the general part: a physical identity among columns (mass = density x volume, or a
value = its expected level) makes one unit combination fit; every combination's mean absolute log
residual is a conditional aggregate of one pass, the least one wins, and solutions that another one
comes near are flagged.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.session import written

Convert = Callable[[Column], Column]

#: The expression scale that everything is converted to.
TARGET = "log2tpm1"

#: Values of each unit as transcripts per million.
TO_TPM: dict[str, Convert] = {
    "tpm": lambda x: x,
    "ktpm": lambda x: x * 1000,
    "log2tpm1": lambda x: F.pow(F.lit(2.0), x) - 1,
    "log10tpm1": lambda x: F.pow(F.lit(10.0), x) - 1,
    "lntpm1": lambda x: F.exp(x) - 1,
}

#: How units are named in free text, in order; the first that is found decides.
UNIT_PATTERNS = (
    ("ktpm", r"k\s*tpm|thousands?\b|kilo|10\s*\^\s*-?\s*3|1e-?3\b|divided by 1,?000"),
    ("tpm", r"not logged|not log|un-?logged|linear|\bplain\b"),
    ("log10tpm1", r"log\W{0,2}10|\blg\b|decadic|common log|base\W{0,2}(10|ten)\b"),
    ("lntpm1", r"\bln\b|ln\s*\(|\bln\s*tpm|lntpm|\bnat(ural|\.)?\s*log|log\W?e\b|log1p|base\W{0,2}e\b"),
    ("log2tpm1", r"log\W{0,2}2|\blb\b|binary log|dyadic|base\W{0,2}(2|two)\b|\bld\b"),
    ("tpm", r"\btpm\b|transcripts per million"),
)


def unit_named(text: Column) -> Column:
    """The unit that free text names, NULL if it names none."""
    t = F.lower(text)
    out = F.lit(None).cast("string")
    for unit, pattern in reversed(UNIT_PATTERNS):
        out = F.when(t.rlike(pattern), F.lit(unit)).otherwise(out)
    return out


def hinted(hint: Column) -> Column:
    """The unit that a vague scale hint stands for."""
    h = F.lower(F.trim(hint))
    return F.when(h == "linear", "tpm").when(h == "log", TARGET)


def to_tpm(value: Column, unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, convert in TO_TPM.items():
        out = F.when(unit == name, convert(value)).otherwise(out)
    return out


def to_target(value: Column, unit: Column) -> Column:
    """``value`` of ``unit`` as log2(TPM + 1); values below 0 TPM and unknown units give NULL."""
    tpm = to_tpm(value, unit)
    return F.when(unit == TARGET, value).otherwise(F.when(tpm >= 0, F.log2(tpm + 1)))


def solve_units(
    rows: DataFrame,
    group: list[str],
    candidates: Mapping[str, Mapping[str, Convert]],
    residual: Callable[[dict[str, Column]], Column],
    margin: float = 0.1,
) -> DataFrame:
    """The unit combination of every group that fits its identity best.

    ``candidates`` has the possible conversions of each column to common units, ``residual`` the log
    residual of the identity from the converted columns. One row per group: ``<column>_unit`` for
    each column, ``residual`` (mean of the absolute log residuals over the rows that have one for
    the winner), ``runner_up`` and ``unique``, false where another combination's residual is within
    ``margin`` of the best. Combinations that fit alike are taken in the order of ``candidates``.
    Combinations whose conversion is NULL for more rows than another's come after it. Groups
    without any residual come out with NULL units and ``unique`` false. NULL group keys form groups.
    """
    names = list(candidates)
    combos = list(itertools.product(*[list(candidates[c]) for c in names]))
    scores = []
    for i, combo in enumerate(combos):
        r = F.abs(residual({c: candidates[c][u](F.col(c)) for c, u in zip(names, combo, strict=True)}))
        r = F.when(~F.isnan(r) & (r < float("inf")), r)
        scores.append(F.struct((F.count("*") - F.count(r)).alias("gaps"), F.avg(r).alias("r"), F.lit(i).alias("i")))
    ranked = rows.groupBy(*group).agg(F.array_sort(F.filter(F.array(*scores), lambda s: s["r"].isNotNull())).alias("__fits"))
    best, second = F.get("__fits", F.lit(0)), F.get("__fits", F.lit(1))
    close = second["i"].isNotNull() & (second["gaps"] <= best["gaps"]) & (second["r"] - best["r"] <= margin)
    return ranked.select(
        *group,
        *[
            F.get(F.array(*[F.lit(c[k]) for c in combos]), best["i"]).alias(f"{name}_unit")
            for k, name in enumerate(names)
        ],
        best["r"].alias("residual"),
        second["r"].alias("runner_up"),
        (best["i"].isNotNull() & ~close).alias("unique"),
    )


def product_residual(exponents: Mapping[str, float]) -> Callable[[dict[str, Column]], Column]:
    """Log residual of an identity prod(column ^ exponent) = 1, as mass^1 density^-1 volume^-1."""

    def residual(columns: dict[str, Column]) -> Column:
        out = F.lit(0.0)
        for name, power in exponents.items():
            out = out + F.when(columns[name] > 0, F.ln(columns[name])) * power
        return out

    return residual


def scales(**factors: float) -> dict[str, Convert]:
    """Conversions that multiply: unit name -> factor to the common unit."""
    return {u: (lambda x, f=f: x * F.lit(f)) for u, f in factors.items()}


def harmonise(
    values: DataFrame,
    row_id: str,
    sample: str,
    feature: str,
    value: str,
    texts: list[Column],
    hint: Column,
    candidates: tuple[str, ...] = (TARGET, "tpm"),
    margin: float = 0.1,
    typical_level: float = 3.0,
    check: bool = False,
) -> DataFrame:
    """Every row with its unit, how it was found, and its value as log2(TPM + 1).

    The first of ``texts`` (own note, sample text, method text) that names a unit decides, then the
    hint. The other rows are solved together per sample: their values must agree with the level
    that their features have in the rows of known unit, identity value / level = 1 on the log
    scale; a feature nobody else has is compared with the mean level, and where no text names any
    unit with ``typical_level``. Columns: ``row_id``, ``sample``, ``feature``, ``unit``, ``unit_from``
    (text1.., hint, solved), ``unique``, ``x`` (the value as given), ``value`` (log2(TPM + 1)). NULL and NaN
    values take no part in solving and come out with NULL ``value``. Samples with nothing to solve by
    keep NULL units. Rows without a sample are solved together.

    With ``check``, the units that texts and hints name are held against the identity too, all units of
    ``TO_TPM`` being candidates: ``agrees`` is false for the rows of a sample and named unit where another unit
    fits better by more than ``margin``, NULL where nothing can be held against it.
    """
    named = [unit_named(t) for t in texts]
    base = values.select(
        F.col(row_id).alias("row_id"),
        F.col(sample).alias("sample"),
        F.col(feature).alias("feature"),
        F.when(~F.isnan(value), F.col(value)).alias("x"),
        F.coalesce(*named, hinted(hint)).alias("known"),
        F.coalesce(
            *[F.when(u.isNotNull(), F.lit(f"text{i + 1}")) for i, u in enumerate(named)],
            F.when(hinted(hint).isNotNull(), F.lit("hint")),
        ).alias("unit_from"),
    )
    # Levels, residuals and the result all read the labelled rows: joined and matched with patterns only once.
    base = written(base)
    # The level of each feature: its median, which a wrongly named sample does not move, from summaries that merge before the shuffle.
    sure = base.where(F.col("unit_from").startswith("text")).select("feature", to_target(F.col("x"), F.col("known")).alias("y"))
    levels = sure.groupBy("feature").agg(F.percentile_approx("y", 0.5, 1000).alias("level"))
    overall = levels.agg(F.avg("level").alias("mean_level"))

    def fitted(rows: DataFrame, group: list[str], units: tuple[str, ...]) -> DataFrame:
        with_level = (
            rows.groupBy(*group, "feature", "x")
            .agg(F.count("*").alias("times"))
            .join(levels, "feature", "left")
            .join(F.broadcast(overall))  # one row
            .withColumn("level", F.coalesce("level", "mean_level", F.lit(typical_level)))
        )
        to_common = {"x": {u: (lambda x, u=u: to_target(x, F.lit(u))) for u in units}}
        return solve_units(with_level, group, to_common, lambda c: c["x"] - F.col("level"), margin)

    open_rows = base.where(F.col("known").isNull() & F.col("x").isNotNull()).select("sample", "feature", "x")
    solved = fitted(open_rows, ["sample"], candidates).select("sample", F.col("x_unit").alias("solved"), "unique")
    # Rows without a sample are apart, so that they are not one hot key of the join.
    alone = solved.where(F.col("sample").isNull()).select("solved", "unique")
    out = base.where(F.col("sample").isNotNull()).join(solved, "sample", "left").unionByName(
        base.where(F.col("sample").isNull()).join(F.broadcast(alone), F.lit(True), "left")  # one row at most
    )
    columns = [
        "row_id", "sample", "feature", F.coalesce("known", "solved").alias("unit"),
        F.coalesce("unit_from", F.when(F.col("solved").isNotNull(), F.lit("solved"))).alias("unit_from"),
        F.when(F.col("known").isNotNull(), F.lit(True)).otherwise(F.coalesce("unique", F.lit(False))).alias("unique"),
        "x", to_target(F.col("x"), F.coalesce("known", "solved")).alias("value"),
    ]
    if check:
        labelled = base.where(F.col("known").isNotNull() & F.col("x").isNotNull() & F.col("sample").isNotNull()).select("sample", "known", "feature", "x")
        best = fitted(labelled, ["sample", "known"], tuple(TO_TPM))
        out = out.join(best.select("sample", "known", "x_unit", F.col("unique").alias("clear")), ["sample", "known"], "left")
        agrees = F.when(F.col("x_unit").isNotNull(), (F.col("x_unit") == F.col("known")) | ~F.col("clear"))
        columns.append(agrees.alias("agrees"))
    return out.select(*columns)
