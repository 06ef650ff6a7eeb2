"""Free-typed values to the entries of a reference list, by a BK-tree under edit distance.

The tree is built over the distinct normal forms of the reference and broadcast; a list beyond ``SHARD_NAMES``
names is cut into shards whose trees are built by the tasks that search them, each with a part of the values, and
the winners of the shards are merged. Values are normalised and made distinct before the search, and exact hits never
reach it. A task searches all its values together: the frontier of (value, node) pairs goes down the
tree level by level, distances are bit-parallel over whole arrays, and the triangle inequality drops
every child whose edge lies outside [d - t, d + t]. So all entries within t are found.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.shared import tasks

#: Names of one shard: about 100 bytes each in a task.
SHARD_NAMES = 200_000
#: Values that are searched together in one shard's tree.
PART_VALUES = 200_000
#: (value, node) pairs handled at once.
_FRONTIER = 400_000


def _words(text: list[str], width: int) -> np.ndarray:
    """Code points of the texts, 0-padded."""
    out = np.zeros((len(text), width), dtype=np.uint32)
    for i, t in enumerate(text):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
    return out


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the row pairs of two padded code-point arrays.

    Bit-parallel in 64-bit words for values of up to 64 characters, by rows of the table beyond.
    """
    out = np.zeros(len(la), dtype=np.int64)
    short = la <= 64
    if short.any():
        i = np.flatnonzero(short)
        out[i] = _bit_parallel(a[i], la[i], b[i], lb[i])
    if not short.all():
        i = np.flatnonzero(~short)
        out[i] = _by_rows(a[i], la[i], b[i], lb[i])
    return out


def _bit_parallel(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    size = len(la)
    if not size:
        return np.zeros(0, dtype=np.int64)
    width_a, width_b = int(la.max()), int(lb.max())
    plus = np.full(size, ~np.uint64(0))
    minus = np.zeros(size, dtype=np.uint64)
    score = la.astype(np.int64).copy()
    last = np.where(la > 0, one << (np.maximum(la, 1) - 1).astype(np.uint64), np.uint64(0))
    result = score.copy()
    result[lb == 0] = la[lb == 0]
    powers = one << np.arange(width_a, dtype=np.uint64)
    for j in range(width_b):
        same = (a[:, :width_a] == b[:, j : j + 1]) & (a[:, :width_a] != 0)
        match = (same * powers).sum(axis=1, dtype=np.uint64) if width_a else np.zeros(size, dtype=np.uint64)
        low = match | minus
        zero = (((match & plus) + plus) ^ plus) | low
        up = minus | ~(zero | plus)
        down = plus & zero
        score += ((up & last) != 0).astype(np.int64) - ((down & last) != 0).astype(np.int64)
        up = (up << one) | one
        down = down << one
        plus = down | ~(zero | up)
        minus = up & zero
        result = np.where(lb == j + 1, score, result)
    empty = la == 0
    result[empty] = lb[empty]
    return result


def _by_rows(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    size, width = len(la), int(la.max())
    row = np.broadcast_to(np.arange(width + 1), (size, width + 1)).copy()
    out = row[np.arange(size), la].copy()
    steps = np.arange(width + 1)
    for j in range(int(lb.max())):
        cost = (a[:, :width] != b[:, j : j + 1]).astype(np.int64)
        new = np.empty_like(row)
        new[:, 0] = j + 1
        new[:, 1:] = np.minimum(row[:, :-1] + cost, row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        out = np.where(lb == j + 1, row[np.arange(size), la], out)
    return out


@dataclass(frozen=True)
class Tree:
    """Nodes are names in insertion order; the children of node i are ``child[first[i]:first[i + 1]]``, by edge."""

    codes: np.ndarray
    length: np.ndarray
    first: np.ndarray
    child: np.ndarray
    edge: np.ndarray


def build(names: list[str]) -> Tree:
    """The BK-tree of distinct names; all names of one level are placed together."""
    width = max([len(n) for n in names], default=0)
    codes, length = _words(names, width), np.array([len(n) for n in names], dtype=np.int64)
    parent, edges = np.full(len(names), -1, dtype=np.int64), np.zeros(len(names), dtype=np.int64)
    waiting, at = np.arange(1, len(names)), np.zeros(max(0, len(names) - 1), dtype=np.int64)
    while len(waiting):
        d = np.concatenate(
            [
                distances(codes[w], length[w], codes[p], length[p])
                for w, p in zip(np.array_split(waiting, len(waiting) // _FRONTIER + 1), np.array_split(at, len(at) // _FRONTIER + 1), strict=True)
            ]
        )
        # The first name at each (parent, distance) becomes the node there, the others go on below it.
        _, lead, group = np.unique(at * (2 * width + 2) + d, return_index=True, return_inverse=True)
        parent[waiting[lead]], edges[waiting[lead]] = at[lead], d[lead]
        placed = np.zeros(len(waiting), dtype=bool)
        placed[lead] = True
        below = waiting[lead][group]
        waiting, at = waiting[~placed], below[~placed]
    order = np.lexsort((edges, parent))
    order = order[parent[order] >= 0]
    first = np.searchsorted(parent[order], np.arange(len(names) + 1))
    return Tree(codes, length, first, order, edges[order])


def _masks(symbols: np.ndarray, length: np.ndarray, alphabet: int) -> np.ndarray:
    """Per value and symbol the bits of the places where the value has it; symbol 0 is nowhere."""
    masks = np.zeros((len(length), alphabet + 1), dtype=np.uint64)
    rows = np.arange(len(length))
    for i in range(min(64, symbols.shape[1])):
        masks[rows, symbols[:, i]] |= np.where(i < length, np.uint64(1) << np.uint64(i), np.uint64(0))
    masks[:, 0] = 0
    return masks


def _masked(masks: np.ndarray, row: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """``_bit_parallel`` with ready masks: row of the masks, its length, symbols and length of the name."""
    one, size = np.uint64(1), len(row)
    plus, minus = np.full(size, ~np.uint64(0)), np.zeros(size, dtype=np.uint64)
    score = la.copy()
    place = (la - 1).astype(np.uint64)
    result = score.copy()
    for j in range(int(lb.max(initial=0))):
        match = masks[row, b[:, j]]
        low = match | minus
        zero = (((match & plus) + plus) ^ plus) | low
        up = minus | ~(zero | plus)
        down = plus & zero
        score += ((up >> place) & one).astype(np.int64) - ((down >> place) & one).astype(np.int64)
        up = (up << one) | one
        plus = (down << one) | ~(zero | up)
        minus = up & zero
        np.copyto(result, score, where=lb == j + 1)
    return result


def search(tree: Tree, values: list[str], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, node, distance) of every pair within ``threshold``. Empty values find nothing."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    none = np.zeros(0, dtype=np.int64)
    if not len(tree.length) or not values:
        return none, none, none
    width = max(1, max(len(v) for v in values))
    codes, length = _words(values, width), np.array([len(v) for v in values], dtype=np.int64)
    letters = np.unique(tree.codes[tree.codes > 0])
    symbols = (np.searchsorted(letters, tree.codes) + 1).astype(np.int32)
    symbols[tree.codes == 0] = 0
    own = np.searchsorted(letters, codes)
    own = np.where((own < len(letters)) & (letters[np.minimum(own, len(letters) - 1)] == codes), own + 1, 0)
    key = np.arange(len(tree.length)).repeat(np.diff(tree.first)) * (10**6) + tree.edge
    step = max(1, min(_FRONTIER // 16, 2**24 // (len(letters) + 1)))
    for begin in range(0, len(values), step):
        chunk = np.arange(begin, min(begin + step, len(values)))
        masks = _masks(own[chunk], length[chunk], len(letters))
        stack = [(chunk[length[chunk] > 0], None)]
        while stack:
            value, node = stack.pop()
            node = np.zeros(len(value), dtype=np.int64) if node is None else node
            d = np.empty(len(value), dtype=np.int64)
            for rows, fits in ((np.flatnonzero(length[value] <= 64), True), (np.flatnonzero(length[value] > 64), False)):
                if len(rows):
                    v, n = value[rows], node[rows]
                    d[rows] = (
                        _masked(masks, v - begin, length[v], symbols[n], tree.length[n])
                        if fits
                        else _by_rows(codes[v], length[v], tree.codes[n], tree.length[n])
                    )
            hit = d <= threshold
            if hit.any():
                found.append((value[hit], node[hit], d[hit]))
            low = np.searchsorted(key, node * 10**6 + np.maximum(0, d - threshold), "left")
            n = np.searchsorted(key, node * 10**6 + d + threshold, "right") - low
            total = int(n.sum())
            if total:
                flat = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                value, node = np.repeat(value, n), tree.child[flat]
                stack += [(value[a : a + _FRONTIER], node[a : a + _FRONTIER]) for a in range(0, total, _FRONTIER)]
    if not found:
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def plain(text: str) -> str:
    """Compatibility forms folded, accents off, lower case, letters and digits only."""
    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)).casefold()
    return "".join(c for c in folded if c.isalnum())


def normal_forms(text: Column, describing: str = "") -> Column:
    """The plain form of ``text``, and that without describing words where it differs.

    ``describing`` is a regular expression of words that may stand at either end of the value, in
    folded lower case; they are taken off again and again. NULL gives an empty array.
    """

    @F.pandas_udf("array<string>")
    def forms(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ends = re.compile(rf"^\W*(?:{describing})(?![^\W_])|(?<![^\W_])(?:{describing})\W*$") if describing else None

        def each(t: str | None) -> list[str]:
            if not t:
                return []
            out, rest = [plain(t)], unicodedata.normalize("NFKC", t).casefold().strip()
            while ends and (cut := ends.sub(" ", rest).strip()) != rest and plain(cut):
                rest = cut
                out.append(plain(rest))
            return out

        for part in parts:
            yield part.map(each)

    return forms(text)


def _found(values: pa.Array, names: list[str], tree: Tree, threshold: int) -> list[pa.Array]:
    """(form, name, distance): the nearest names of each value, all of them where several are as near."""
    listed = values.to_pylist()
    v, n, d = search(tree, listed, threshold)
    best = np.full(len(listed), threshold + 1)
    np.minimum.at(best, v, d)
    near = d == best[v]
    v, n, d = v[near], n[near], d[near]
    return [values.take(pa.array(v, pa.int64())), pa.array([names[i] for i in n], pa.string()), pa.array(d.astype(np.int32))]


_FOUND = ["form", "name", "distance"]


def _nearest(batches: Iterator[pa.RecordBatch], shared, threshold: int) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    for batch in batches:
        if batch.num_rows:
            names, tree = shared.value
            yield pa.RecordBatch.from_arrays(_found(batch.column(0), names, tree, threshold), _FOUND)


def _nearest_of_shard(values: pa.Table, names: pa.Table, threshold: int) -> pa.Table:
    """Within one shard of the names; values come to every shard, the shards' winners are merged later."""
    listed = sorted(names.column("name").to_pylist())
    return pa.Table.from_arrays(_found(values.column("form").combine_chunks(), listed, build(listed), threshold), _FOUND)


def match(
    values: DataFrame,
    value_id: list[str],
    forms: Column,
    reference: DataFrame,
    threshold: int = 2,
    shard_names: int = SHARD_NAMES,
    part_values: int = PART_VALUES,
) -> DataFrame:
    """The reference entry that each value means.

    ``forms`` is an array of normal forms of the value, plainest first (for example with and without
    describing words); ``reference`` has (entry, name) with ``name`` in normal form, any number of
    names per entry. The nearest name over all forms and shards decides; names of the same entry
    count as one. Result: ``value_id``, ``entry``, ``distance``, ``n_entries``: entry is NULL where
    no name is within ``threshold``, or where several entries are equally near (``n_entries`` tells).
    Every row of ``values`` comes out; NULL values and those without any letter or digit match
    nothing, and a form of up to ``threshold`` characters only matches exactly. Names and values may be of any
    length. Up to ``shard_names`` distinct names the tree is broadcast; beyond it names are cut into shards
    of about that many and the values into parts of about ``part_values``, and each (shard, part) is one group of a
    shuffle, with the same result.
    """
    spark = values.sparkSession
    keyed = values.select(*value_id, F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != ""))).alias("forms"))
    names = reference.select("entry", "name").where(F.col("entry").isNotNull() & (F.col("name") != "")).distinct()
    singles = names.groupBy("name").agg(F.min("entry").alias("entry"), F.count_distinct("entry").alias("n_entries"))
    asked = keyed.select(F.explode("forms").alias("form")).distinct()
    exact = asked.join(singles, asked["form"] == singles["name"]).select(
        "form", F.col("entry"), "n_entries", F.lit(0).alias("distance")
    )
    # Only values without any exact form go to the tree.
    known = exact.select("form")
    hard = (
        keyed.select(*value_id, F.explode("forms").alias("form"))
        .join(known.withColumn("hit", F.lit(1)), "form", "left")
        .groupBy(*value_id)
        .agg(F.max("hit").alias("hit"), F.collect_set("form").alias("forms"))
        .where(F.col("hit").isNull())
        .select(F.explode("forms").alias("form"))
        .distinct()
        .where(F.length("form") > threshold)
    )
    total = names.select("name").distinct()
    schema = "form string, name string, distance int"
    shards = max(1, -(-total.count() // shard_names))
    if shards == 1:
        listed = sorted(r["name"] for r in total.collect())  # at most shard_names names
        shared = spark.sparkContext.broadcast((listed, build(listed)))
        # A given number of parts, which the optimiser does not merge: few values can take long.
        near = hard.repartition(tasks(spark), "form").mapInArrow(partial(_nearest, shared=shared, threshold=threshold), schema)
    else:
        parts = max(1, -(-hard.count() // part_values))
        number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        asked_of = hard.select("form", number("form", parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        spread = total.select("name", number("name", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        groups = asked_of.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part"))
        near = groups.applyInArrow(partial(_nearest_of_shard, threshold=threshold), schema)
    # Of the shards' winners only the nearest count.
    nearest = near.join(near.groupBy("form").agg(F.min("distance").alias("__least")), "form").where(F.col("distance") == F.col("__least")).drop("__least") if shards > 1 else near
    fuzzy = nearest.join(singles, "name").select("form", "entry", "n_entries", "distance")
    answers = exact.unionByName(fuzzy)
    ranked = (
        keyed.select(*value_id, F.explode("forms").alias("form"))
        .join(answers, "form")
        .groupBy(*value_id, "distance")
        .agg(F.min("entry").alias("entry"), F.greatest(F.max("n_entries"), F.count_distinct("entry")).alias("n_entries"))
        .groupBy(*value_id)
        .agg(F.min_by(F.struct("entry", "n_entries", "distance"), "distance").alias("a"))
    )
    joined = keyed.select(*value_id).join(ranked, value_id, "left")
    return joined.select(
        *value_id,
        F.when(F.col("a.n_entries") == 1, F.col("a.entry")).alias("entry"),
        F.col("a.distance").alias("distance"),
        F.coalesce("a.n_entries", F.lit(0)).alias("n_entries"),
    )
