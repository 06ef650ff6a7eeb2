from __future__ import annotations

import random

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from gneiss.llm import canonical


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(rnd, n, longest):
    return sorted({"".join(rnd.choice("abcé1") for _ in range(rnd.randrange(1, longest))) for _ in range(n)})


def test_tree_finds_exactly_what_brute_force_finds():
    rnd = random.Random(5)
    names, values = words(rnd, 300, 12) + words(rnd, 6, 90), words(rnd, 120, 13) + words(rnd, 4, 95) + ["zz", ""]
    tree = canonical.build(names)
    for t in (0, 1, 2, 3):
        v, n, d = canonical.search(tree, values, t)
        got = set(zip(v.tolist(), n.tolist(), d.tolist(), strict=True))
        want = {(i, j, levenshtein(x, y)) for i, x in enumerate(values) for j, y in enumerate(names) if x and levenshtein(x, y) <= t}
        assert got == want
    assert canonical.build([]).length.size == 0 and canonical.search(canonical.build([]), ["a"], 2)[0].size == 0


def test_distances():
    rnd = random.Random(6)
    a, b = [rnd.choice(words(rnd, 9, 80)) for _ in range(60)], [rnd.choice(words(rnd, 9, 80)) for _ in range(60)]
    wa, wb = canonical._words(a, 90), canonical._words(b, 90)
    got = canonical.distances(wa, np.array([len(x) for x in a]), wb, np.array([len(x) for x in b]))
    assert got.tolist() == [levenshtein(x, y) for x, y in zip(a, b, strict=True)]


def match(spark, values, refs, **kw):
    v = spark.createDataFrame(values, "id long, name string, entry string, distance int")
    r = spark.createDataFrame(refs, "entry string, name string")
    got = canonical.match(v, ["id"], canonical.normal_forms(F.col("name"), r"human|cells?|p\d{1,2}"), r, **kw)
    return {i: (e, d, n) for i, e, d, n in rows(got, "id", "entry", "distance", "n_entries")}


REFS = [("E1", "abcdef12"), ("E1", "otherxx"), ("E2", "zzyyxx99"), ("E3", "same777"), ("E4", "same777"), ("E5", "humancell"), ("E6", "qrstuv"), ("E6", "qrstuw"), (None, "nothing1"), ("E7", ""), ("E8", "ab")]


def test_forms_ties_and_missing(spark):
    values = [
        (1, " ABC-def.１２ cells", "q", 1), (2, "abcdef2", None, None), (3, "zzyxx9", None, None), (4, None, None, None), (5, " - ", None, None), (6, "same777", None, None),
        (7, "human cell", None, None), (8, "qrstux", None, None), (9, "x" * 3000, None, None), (10, "acdex12y", None, None), (11, "ac", None, None), (12, "nothing1", None, None), (13, "(human) ABCDEF12 p6", None, None), (1, " ABC-def.１２ cells", "q", 1),
    ]
    got = match(spark, values, REFS)
    assert got[1] == ("E1", 0, 1) and got[13] == ("E1", 0, 1)
    assert got[2] == ("E1", 1, 1) and got[3] == ("E2", 2, 1)
    assert got[4][0] is None and got[5][0] is None and got[9][0] is None and got[10][0] is None and got[11][0] is None and got[12][0] is None
    assert got[6] == (None, 0, 2), "two entries of one name"
    assert got[7] == ("E5", 0, 1), "describing words that are the name itself"
    assert got[8] == ("E6", 1, 1), "two names of one entry are no tie"


def test_shards_merge_to_the_same_answer(spark):
    rnd = random.Random(7)
    refs = [(f"E{i}", n) for i, n in enumerate(words(rnd, 60, 9))]
    values = [(i, n, None, None) for i, n in enumerate(words(rnd, 40, 9))]
    one = match(spark, values, refs)
    assert match(spark, values, refs, shard_names=7) == one and match(spark, values, refs, shard_names=7, part_values=6) == one


def test_names_of_any_length(spark):
    long = "".join(random.Random(9).choice("abcdefgh") for _ in range(2500))
    got = match(spark, [(1, long[:700] + "x" + long[701:], None, None), (2, long[:-3], None, None)], [("E1", long), ("E2", "short77")])
    assert got[1] == ("E1", 1, 1) and got[2][0] is None


def test_empty_sides(spark):
    assert match(spark, [(1, "abcdef", None, None)], []) == {1: (None, None, 0)}
    assert match(spark, [], REFS) == {}
