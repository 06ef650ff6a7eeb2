from __future__ import annotations

import random

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from gneiss.llm import leakage

RND = random.Random(11)
WORDS = [f"w{i}" for i in range(4000)]
ITEM = " ".join(RND.sample(WORDS, 60))
OTHER = " ".join(RND.sample(WORDS, 40))


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id long, share string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return rows(leakage.leaks(d, F.col("doc_id"), F.col("text"), i, F.col("item_id"), F.col("text"), **kw), "doc_id", "item_id")


def noise(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


def test_cases(spark):
    w = ITEM.split()
    every14 = [("changed" if i % 14 == 13 else x) for i, x in enumerate(w)]
    shuffled = w[40:] + w[20:40] + w[:20]
    docs = [
        (1, noise(50) + " " + ITEM + " " + noise(20), 7, "x"), (2, ITEM.upper().replace(" ", ",\r\n * "), None, None), (3, noise(5) + " " + " ".join(w[10:45]), None, None),
        (4, " ".join(w[:28]), None, None), (5, " ".join(every14), None, None), (6, " ".join(RND.sample(w, 60)), None, None), (7, " ".join(shuffled), None, None),
        (8, None, None, None), (9, "", None, None), (10, "<b>" + "</b>&nbsp;".join(w[:31]), None, None), (11, " ".join(w[:16]) + " " + noise(9) + " " + " ".join(w[30:46]), None, None),
        (12, " ".join(w[i] for i in range(0, 60, 2)), None, None), (1, noise(50) + " " + ITEM + " " + noise(20), 7, "x"), (13, noise(20000) + " " + ITEM, None, None), (14, ITEM + " " + OTHER, None, None),
    ]
    items = [(100, ITEM), (200, OTHER), (300, "too short"), (400, None), (None, ITEM), (500, ITEM)]
    got = leaks(spark, docs, items)
    hits = {1, 2, 3, 5, 10, 11, 13, 14}
    assert {d for d, i in got if i == 100} == {d for d, i in got if i == 500} == hits
    assert {d for d, i in got if i == 200} == {14} and not {i for _, i in got} & {300, 400}
    assert got.count((1, 100)) == 2, "repeated rows each count"
    assert leaks(spark, docs, items, block_words=20) == got
    assert leaks(spark, docs, []) == [] and leaks(spark, [], items) == []


def test_winnowing_guarantee():
    rnd = random.Random(12)
    need = leakage.GRAM + leakage.WINDOW - 1
    for _ in range(60):
        span = [rnd.randrange(50) for _ in range(need)]
        a = np.array([rnd.randrange(50, 99) for _ in range(9)] + span + [rnd.randrange(50, 99) for _ in range(7)])
        b = np.array([rnd.randrange(99, 150) for _ in range(4)] + span + [rnd.randrange(99, 150) for _ in range(11)])
        ha, hb = (leakage._hashes(x, tuple(range(leakage.GRAM))) for x in (a, b))
        assert set(ha[leakage._winnowed(ha)]) & set(hb[leakage._winnowed(hb)])


def test_batches_without_a_hit():
    ix = leakage.index([(1, ITEM)])
    for texts in ([noise(30).replace("w", "v")], [noise(300)], [None, ""], [], [" ".join(ITEM.split()[:9])]):
        assert [len(x) for x in leakage.overlaps(ix, texts, 0.5)] == [0, 0, 0]
    assert [len(x) for x in leakage.overlaps(leakage.index([]), [ITEM], 0.5)] == [0, 0, 0]


def test_clean_tables(spark):
    clean = [(i, f"nothing of that kind stands in text number {i}", 0, "x") for i in range(40)]
    assert leaks(spark, clean, [(100, ITEM), (200, OTHER)]) == []


def changed(words, every, rnd):
    """The words with single ones changed, ``every`` words apart, never the last."""
    at = set(range(rnd.randrange(every), len(words) - 1, every))
    return [f"x{rnd.randrange(10**6)}" if i in at else w for i, w in enumerate(words)]


def test_recall_by_distance_of_changed_words():
    """Every changed word with two unchanged ones on both sides gives a hit, so all are found from a distance of 3 on."""
    rnd = random.Random(5)
    for every in (3, 4, 5, 6, 8, 12):
        found = 0
        for k in range(100):
            item = rnd.sample(WORDS, 24 + k)
            text = " ".join([*rnd.sample(WORDS, 30), *changed(item, every, rnd), *rnd.sample(WORDS, 30)])
            found += len(leakage.overlaps(leakage.index([(1, " ".join(item))]), [text], 0.5)[0])
        assert found == 100, every


def test_recall_of_random_changes():
    """Changed words anywhere but beside one another, up to 40 % of the words."""
    rnd = random.Random(6)
    for share in (0.1, 0.2, 0.3, 0.4):
        found = 0
        for _ in range(100):
            item = rnd.sample(WORDS, 60)
            left, at = list(range(1, 59)), set()
            while left and len(at) < share * 60:
                c = rnd.choice(left)
                at.add(c)
                left = [x for x in left if abs(x - c) > 1]
            text = " ".join(f"x{i}" if i in at else w for i, w in enumerate(item))
            found += len(leakage.overlaps(leakage.index([(1, " ".join(item))]), [text], 0.5)[0])
        assert found >= 90, (share, found)


def test_joined_by_shuffling_gives_the_same(spark):
    rnd = random.Random(8)
    pool = [" ".join(rnd.sample(WORDS, 40 + i)) for i in range(12)]
    docs = [(i, " ".join([noise(20), " ".join(changed(rnd.choice(pool).split(), 6, rnd)), noise(5)]) if i % 3 else noise(80), 0, "x") for i in range(60)]
    docs += [docs[1], (99, docs[1][1], 0, "x")]
    items = [(i, t) for i, t in enumerate(pool)] + [(50, pool[0])]
    got = leaks(spark, docs, items)
    assert len(got) >= 42 and leaks(spark, docs, items, block_words=20) == got


def test_stretches_bridge_single_words_only():
    same = np.array([[1] * 5 + [0] + [1] * 3 + [0, 0] + [1] * 7, [1, 0] * 9], dtype=bool)
    got = leakage._stretches(same)
    assert got[0].tolist() == [True] * 9 + [False] * 9
    assert got[1].tolist() == [True] * 17 + [False]
