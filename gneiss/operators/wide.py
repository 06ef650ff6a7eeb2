"""Entity-attribute-value rows into typed rows of entities.

Plan: one aggregation keeps the deciding row of every (entity, attribute) with
partial results before the shuffle; a second one gathers each entity's pairs in
a map, whose size is bounded by the number of distinct attributes. The maps are
written once; the known keys are read off them, and a projection takes them out
of the map into typed columns, ``block_columns`` in a table, so neither a plan
nor a map lookup grows with the number of keys. No pivot, no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.ids import trimmed
from gneiss.session import written

NUMBER = r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"
DATE = r"^\d{4}-\d{2}-\d{2}$"

#: Words that stand for a missing value.
MISSING_WORDS = ("", "-", "#n/a", "n/a", "na", "n.d.", "nan", "null", "none", "below detection")


def typed(text: Column, kind: str) -> Column:
    """``text`` as a value of ``kind`` (double, bigint, boolean, date, string); NULL if it is none.

    A comma may be the decimal sign. NaN and infinities are no numbers.
    """
    t = trimmed(text)
    if kind == "double":
        number = F.when(t.rlike(NUMBER), F.replace(t, F.lit(","), F.lit("."))).try_cast("double")
        return F.when(F.abs(number) < float("inf"), number)
    if kind == "bigint":
        return F.when(t.rlike(INTEGER), t).try_cast("bigint")
    if kind == "boolean":
        return F.when(F.lower(t).isin("true", "false"), F.lower(t) == "true")
    if kind == "date":
        return F.when(t.rlike(DATE), t).try_cast("date")
    if kind == "string":
        return t
    raise ValueError(f"unknown type {kind}")


def is_missing_word(text: Column) -> Column:
    return F.coalesce(F.lower(trimmed(text)), F.lit("")).isin(*MISSING_WORDS)


@dataclass(frozen=True)
class Wide:
    """``blocks``: tables with one row per entity: ``entity``, the ``carried`` columns and a column per key of the
    block; every key has its typed column in exactly one of them. The first also has ``cast_failures``, a map of the
    texts that are no value of their key's type, missing words left out. ``columns``: per block, key -> column name."""

    blocks: tuple[DataFrame, ...]
    entity: str
    carried: tuple[str, ...]
    columns: tuple[dict[str, str], ...]

    @property
    def df(self) -> DataFrame:
        """The whole table where one block holds all keys; otherwise an error, since it would be a part."""
        if len(self.blocks) != 1:
            raise ValueError(f"{len(self.blocks)} blocks of columns: read them from blocks")
        return self.blocks[0]


def widen(
    rows: DataFrame,
    entity: Column,
    attribute: Column,
    value: Column,
    newest: list[Column],
    carried: dict[str, Column] | None = None,
    kinds: dict[str, str] | None = None,
    default_kind: str = "double",
    block_columns: int = 500,
    entity_name: str = "entity",
) -> Wide:
    """One row per entity of ``rows``, with one typed column per key.

    Of several rows of an (entity, attribute) pair the one greatest by ``newest`` decides, whatever
    its text; NULLs in ``newest`` come first. Rows without entity or attribute are left out. Equal
    ``newest`` with different texts: the greatest text decides, NULL texts last. ``carried`` columns
    take the newest non-NULL value of the entity. The known keys are those of ``kinds`` (in the first
    block) and all others of the rows in alphabetical order, of ``default_kind``; beyond
    ``block_columns`` of them further blocks follow, so each has its column. A column that would
    clash with another one's name (letter case aside) gets ``_`` appended. An empty table gives an
    empty block with the columns of ``kinds``.
    """
    kinds, carried = kinds or {}, carried or {}
    e, a, v, o, m, numbers, failures = (f"__w_{x}" for x in ("entity", "attribute", "value", "order", "map", "numbers", "failures"))
    # Carried columns go by number inside, so callers may name them as they like.
    given, kept = [f"__w_given{i}" for i in range(len(carried))], [f"__w_kept{i}" for i in range(len(carried))]
    base = rows.select(
        entity.alias(e),
        attribute.alias(a),
        value.cast("string").alias(v),
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(newest)]).alias(o),
        *[c.alias(x) for c, x in zip(carried.values(), given, strict=True)],
    ).where(F.col(e).isNotNull() & F.col(a).isNotNull())

    pairs = base.groupBy(e, a).agg(
        F.max_by(v, F.struct(o, v)).alias(v),
        *[F.max(F.when(F.col(x).isNotNull(), F.struct(F.col(o), F.col(x).alias("x")))).alias(k) for x, k in zip(given, kept, strict=True)],
    )
    maps = pairs.groupBy(e).agg(
        F.map_from_entries(F.collect_list(F.struct(a, v))).alias(m),
        *[F.max(k).getField("x").alias(k) for k in kept],
    )
    maps = written(maps)
    keys = sorted(r[0] for r in maps.select(F.explode(F.map_keys(m)).alias("k")).distinct().collect())  # the table's columns
    others = [k for k in keys if k not in kinds]

    # One pass over the map gives every entry its number and whether it failed; the columns only look up.
    def ok(k: Column, x: Column) -> Column:
        out = typed(x, default_kind).isNotNull()
        for kind in sorted(set(kinds.values())):
            out = F.when(k.isin(*[y for y in kinds if kinds[y] == kind]), typed(x, kind).isNotNull()).otherwise(out)
        return out

    blocks, columns = [], []
    for i in range(0, max(len(others), 1), block_columns):
        part, first = others[i : i + block_columns], i == 0
        known = (kinds if first else {}) | dict.fromkeys(part, default_kind)
        names: dict[str, str] = {}
        taken = {entity_name.lower(), "cast_failures", *[c.lower() for c in carried]}
        for key in known:
            name = key
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            names[key] = name
        # Keys are sorted, so a block's are those between its first and last one.
        mine = (lambda k: (k >= F.lit(part[0])) & (k <= F.lit(part[-1]))) if part else (lambda _: F.lit(False))  # noqa: B023
        staged = maps.select(
            e, m, *kept,
            F.transform_values(
                F.map_filter(m, lambda k, _: mine(k) & ~k.isin(*kinds) if kinds else mine(k)),  # noqa: B023
                lambda _, x: typed(x, default_kind),
            ).alias(numbers),
            *([F.map_filter(m, lambda k, x: ~is_missing_word(x) & ~ok(k, x)).alias(failures)] if first else []),
        )
        blocks.append(
            staged.select(
                F.col(e).alias(entity_name),
                *[F.col(k).alias(c) for k, c in zip(kept, carried, strict=True)],
                *[(typed(F.col(m)[k], kinds[k]) if k in kinds else F.col(numbers)[k]).alias(n) for k, n in names.items()],
                *([F.col(failures).alias("cast_failures")] if first else []),
            )
        )
        columns.append(names)
    return Wide(tuple(blocks), entity_name, tuple(carried), tuple(columns))


def filled_cells(wide: Wide, attribute_name: str = "attribute") -> DataFrame:
    """One row per filled cell of the wide table: entity, carried columns, key."""
    out = None
    for block, names in zip(wide.blocks, wide.columns, strict=True):
        present = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(k)) for k, c in names.items()]).cast("array<string>"))
        part = block.select(f"`{wide.entity}`", *[f"`{c}`" for c in wide.carried], F.explode(present).alias(attribute_name))
        out = part if out is None else out.unionByName(part)
    return out
