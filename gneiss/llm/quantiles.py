"""Mergeable quantile summaries with a known rank error.

A summary is a sorted list of tuples (value, lo, hi): the value is that of one row, whose rank among the
group's n rows lies in [lo, hi]. A leaf keeps exact ranks (lo = hi) at about evenly spaced places;
merging adds the other summaries' lower and upper counts at each tuple's place; pruning keeps the
tuples nearest to ``size`` + 1 evenly spaced ranks and their intervals. A prune widens the gaps by at
most n / (2 * size), so the error after a leaf and L merges is at most (L + 1) * n / (2 * size)
ranks, and the intervals carry what it really is. Nothing is random.

Python work is numpy over whole Arrow batches, all groups of a task at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a leaf task holds at once; more only adds summaries to merge.
LEAF_ROWS = 1_000_000
#: Leaves of one group that a task merges at most.
MOST_TOGETHER = 256


def _summary_fields() -> list[T.StructField]:
    return [
        T.StructField("n", T.LongType()),
        T.StructField("v", T.ArrayType(T.DoubleType())),
        T.StructField("lo", T.ArrayType(T.LongType())),
        T.StructField("hi", T.ArrayType(T.LongType())),
    ]


def _pick(length: np.ndarray, mid: np.ndarray, starts: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Indices of the tuples to keep: all of short lists, else first, last and the nearest to even ranks."""
    keep = np.ones(len(mid), dtype=bool)
    for g in np.flatnonzero(length > size + 1):
        a, b = starts[g], starts[g] + length[g]
        own = mid[a:b]
        targets = np.linspace(1, n[g], size + 1)
        right = np.clip(np.searchsorted(own, targets), 1, len(own) - 1)
        nearest = np.where(targets - own[right - 1] <= own[right] - targets, right - 1, right)
        keep[a:b] = False
        keep[a + nearest] = True
        keep[[a, b - 1]] = True
    return np.flatnonzero(keep)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _codes(columns: list[pa.Array]) -> tuple[np.ndarray, list[pa.Array]]:
    """A dense code per row for the tuple of keys (NULL is a key), and the keys of each code."""
    code = np.zeros(len(columns[0]) if columns else 0, dtype=np.int64)
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code, return_inverse=True)
    first = np.full(int(code.max()) + 1 if len(code) else 0, -1, dtype=np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return code, [c.take(pa.array(first)) for c in columns]


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name).combine_chunks()
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _leaf_table(table: pa.Table, keys: list[str], size: int) -> pa.RecordBatch:
    code, groups = _codes([_column(table, k) for k in keys])
    value = _column(table, "x").to_numpy(zero_copy_only=False)
    order = np.lexsort((value, code))
    value = value[order]
    n = np.bincount(code, minlength=len(groups[0]) if groups else 0)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    rank = np.arange(len(value)) - np.repeat(starts, n) + 1
    kept = _pick(n, rank, starts, n, size)
    counts = np.bincount(code[order][kept], minlength=len(n))
    rank = rank[kept].astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [*groups, pa.array(n.astype(np.int64)), _lists(value[kept], counts), _lists(rank, counts), _lists(rank, counts)],
        [*keys, "n", "v", "lo", "hi"],
    )


def _leaves(batches: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= LEAF_ROWS:
            yield _leaf_table(pa.Table.from_batches(held), keys, size)
            held, rows = [], 0
    if rows:
        yield _leaf_table(pa.Table.from_batches(held), keys, size)


def merge_flat(code: np.ndarray, n_rows: np.ndarray, lengths: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, groups: int, size: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Summaries (one per row: group code, n, tuple count) merged by group: n, tuple counts, v, lo, hi.

    Every summary keeps its smallest and largest row with exact ranks, which pruning never drops.
    """
    ends = np.cumsum(lengths)
    begins = ends - lengths
    up_lo = np.diff(lo, prepend=0)
    up_hi = np.diff(hi, append=0)
    filled = lengths > 0
    up_lo[begins[filled]] = lo[begins[filled]]
    up_hi[ends[filled] - 1] = n_rows[filled] + 1 - hi[ends[filled] - 1]
    tuple_code = np.repeat(code, lengths)
    order = np.lexsort((v, tuple_code))
    v, up_lo, up_hi, tuple_code = v[order], up_lo[order], up_hi[order], tuple_code[order]
    count = np.bincount(tuple_code, minlength=groups)
    starts = np.concatenate(([0], np.cumsum(count)[:-1]))

    def running(x: np.ndarray) -> np.ndarray:
        total = np.cumsum(x)
        before = np.concatenate(([0], total))[starts]
        return total - np.repeat(before, count)

    n = np.bincount(code, weights=n_rows, minlength=groups).astype(np.int64)
    new_lo = running(up_lo)
    new_hi = np.minimum(running(up_hi) - up_hi + 1, np.repeat(n, count))
    if size:
        kept = _pick(count, (new_lo + new_hi) / 2, starts, n, size)
        count = np.bincount(tuple_code[kept], minlength=groups)
        v, new_lo, new_hi = v[kept], new_lo[kept], new_hi[kept]
    return n, count, v, new_lo, new_hi


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = _column(table, "n").to_numpy(zero_copy_only=False)
    lists = [_column(table, c) for c in ("v", "lo", "hi")]
    lengths = np.diff(lists[0].offsets.to_numpy())
    return n, lengths, *[x.flatten().to_numpy(zero_copy_only=False) for x in lists]


def _merged(batches: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        code, groups = _codes([_column(table, k) for k in keys])
        n, count, v, lo, hi = merge_flat(code, *_unpack(table), len(groups[0]), size)
        yield pa.RecordBatch.from_arrays(
            [*groups, pa.array(n), _lists(v, count), _lists(lo, count), _lists(hi, count)], [*keys, "n", "v", "lo", "hi"]
        )


def quantiles_flat(n: np.ndarray, count: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, probs: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Per summary and probability: the value of the tuple whose interval is nearest to rank ceil(p * n), and
    by how many ranks it can be off."""
    out, err = np.full((len(n), len(probs)), np.nan), np.zeros((len(n), len(probs)), dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(count)[:-1]))
    for g in np.flatnonzero(count):
        a, b = starts[g], starts[g] + count[g]
        ranks = np.clip(np.ceil(np.array(probs) * n[g] - 1e-9), 1, n[g]).astype(np.int64)
        off = np.maximum(ranks[:, None] - lo[None, a:b], hi[None, a:b] - ranks[:, None])
        best = off.argmin(axis=1)
        out[g], err[g] = v[a + best], off[np.arange(len(probs)), best]
    return out, err


def _rolled(batches: Iterator[pa.RecordBatch], key: str, sub: str, size: int, probs: list[float]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    code, (keys, subs) = _codes([_column(table, key), _column(table, sub)])
    n, count, v, lo, hi = merge_flat(code, *_unpack(table), len(keys), size)
    over, (tops,) = _codes([keys])
    all_n, all_count, *rest = merge_flat(over, n, count, v, lo, hi, len(tops), size)
    q, e = quantiles_flat(n, count, v, lo, hi, probs)
    all_q, all_e = quantiles_flat(all_n, all_count, *rest, probs)
    wide = np.full(len(n), len(probs))
    yield pa.RecordBatch.from_arrays(
        [keys, subs, pa.array(n), _lists(q.ravel(), wide), _lists(e.ravel(), wide), pa.array(all_n[over]), _lists(all_q[over].ravel(), wide), _lists(all_e[over].ravel(), wide)],
        [key, sub, "n", "q", "rank_error", "all_n", "all_q", "all_rank_error"],
    )


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


def summarise(df: DataFrame, keys: dict[str, Column], value: Column, size: int = 256) -> DataFrame:
    """Leaf summaries of ``value`` by ``keys``: one or more rows (keys, n, v, lo, hi) per group and task, no shuffle.

    NULL and NaN values are missing and take no part; NULL keys form groups of their own. Groups of
    up to ``size`` + 1 rows of a task are kept exactly. An empty table gives no rows. Summaries can
    be stored and merged with those of other loads later.
    """
    names = list(keys)
    base = df.select(*[c.alias(k) for k, c in keys.items()], value.cast("double").alias("x"))
    base = base.where(F.col("x").isNotNull() & ~F.isnan("x"))
    schema = T.StructType([*_key_fields(base, names), *_summary_fields()])
    return base.mapInArrow(partial(_leaves, keys=names, size=size), schema)


def merge(summaries: DataFrame, keys: list[str], size: int = 256) -> DataFrame:
    """Summaries merged to one row per group of ``keys``; other key columns are merged over."""
    base = summaries.select(*keys, "n", "v", "lo", "hi")
    schema = T.StructType([*_key_fields(base, keys), *_summary_fields()])
    return base.repartition(*keys).mapInArrow(partial(_merged, keys=keys, size=size), schema)


def planned_leaves(df: DataFrame) -> int:
    """How many tasks a scan of ``df`` is planned to take, hence how many leaves a group may have."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    part = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return -(-size // max(1, part))


def premerge(summaries: DataFrame, keys: list[str], leaves: int, size: int = 256, together: int = MOST_TOGETHER) -> DataFrame:
    """Summaries of ``leaves`` tasks merged in pieces of ``together`` leaves, level by level, until a group has at most
    ``together`` of them left for the last merge. Up to that many are returned as they are."""
    out = summaries.select(*keys, "n", "v", "lo", "hi")
    while leaves > together:
        leaves = -(-leaves // together)
        out = merge(out.withColumn("piece", F.pmod(F.spark_partition_id(), F.lit(leaves))), [*keys, "piece"], size).drop("piece")
    return out


def rollup(summaries: DataFrame, key: str, sub: str, probs: list[float], size: int = 256) -> DataFrame:
    """Percentiles of every (key, sub) group and, beside them, of the whole key, from one shuffle by key.

    ``q[i]`` is a value whose rank is within ``rank_error[i]`` of ceil(probs[i] * n); ``all_*`` are the
    same over all subs of the key.
    """
    base = summaries.select(key, sub, "n", "v", "lo", "hi")
    doubles, longs = T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            *_key_fields(base, [key, sub]), T.StructField("n", T.LongType()), T.StructField("q", doubles), T.StructField("rank_error", longs),
            T.StructField("all_n", T.LongType()), T.StructField("all_q", doubles), T.StructField("all_rank_error", longs),
        ]
    )
    return base.repartition(key).mapInArrow(partial(_rolled, key=key, sub=sub, size=size, probs=probs), schema)
