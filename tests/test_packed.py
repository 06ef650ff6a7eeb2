from __future__ import annotations

import random
import re

from conftest import rows
from hypothesis import example, given, settings
from hypothesis import strategies as st

from gneiss.operators import packed


def split(spark, texts, source="s"):
    df = spark.createDataFrame([(i, source, t) for i, t in enumerate(texts)], "id long, src string, t string")
    found = packed.infer_delimiters(df, "src", "t")
    out = {}
    for i, _, pos, item in rows(packed.split_packed(df, "src", "t", found), "id", "src", "pos", "item"):
        out.setdefault(i, {})[pos] = item
    return [[out.get(i, {}).get(p) for p in sorted(out.get(i, {}))] for i in range(len(texts))]


def brute(text):
    out = []
    for m in re.finditer(r'"(?:[^"]|"")*"|[^\W_]+(?:[-.@_]|[^\W_])*|[-.@_]+(?:[-.@_]|[^\W_])*', text or ""):
        x = m.group()
        x = x[1:-1].replace('""', '"') if x[0] == '"' else x
        if x.strip():
            out.append(x)
    return out


def test_mixed_delimiters_quotes_and_blanks(spark):
    texts = ["A1|B2;C3", '"X, y"|Z', 'Q ""', '"a ""b"" c"/D', " \t;|", "", None, "ach-1 / ACH-2", "A__1@;b.c", '"open;A;B', "A|" * 3000]
    assert split(spark, texts) == [brute(t) for t in texts]
    assert split(spark, texts)[3] == ['a "b" c', "D"]


def test_rare_delimiters_still_separate(spark):
    assert split(spark, ["a|b"] * 50 + ["c~d"])[-1] == ["c", "d"]


def test_scores(spark):
    df = spark.createDataFrame([("s", "a|b|c"), ("s", "d|e|f"), ("s", "g;h"), ("t", None)], "src string, t string")
    got = {(r["source"], r["delimiter"]): r for r in packed.delimiter_scores(df, "src", "t").collect()}
    assert set(got) == {("s", "|"), ("s", ";")} and all(r["separates"] for r in got.values())
    assert got["s", "|"]["n_fields"] == got["s", "|"]["n_runs"] == 2 and got["s", "|"]["n_shapes"] == 1
    assert packed.infer_delimiters(df.limit(0), "src", "t") == {}


def test_a_character_inside_values_is_rejected_by_its_score(spark):
    """':' always stands between letters and digits, in fields of every piece count: splitting there gives pieces of types that no value has."""
    rnd = random.Random(3)
    value = lambda: "HGNC:" + str(rnd.randrange(10**5))
    texts = ["|".join(value() for _ in range(rnd.randrange(1, 5))) for _ in range(60)] + ["A-1;B-2", "x-3"]
    df = spark.createDataFrame([("s", t) for t in texts], "src string, t string")
    got = packed.infer_delimiters(df, "src", "t")["s"]
    assert got == {"|": True, ";": True, ":": False, "-": False}
    assert split(spark, texts) == [re.split(r"[|;]", t) for t in texts]
    scores = {r["delimiter"]: r["score"] for r in packed.delimiter_scores(df, "src", "t", packed.VALUE_MARKS + ":").collect()}
    assert scores["|"] > 20 and scores[":"] < -20


def test_a_mark_that_separates_is_taken_by_its_score(spark):
    rnd = random.Random(4)
    texts = [".".join(f"{'ABC'[rnd.randrange(3)]}{rnd.randrange(99)}" for _ in range(rnd.randrange(1, 7))) for _ in range(200)]
    assert split(spark, texts) == [t.split(".") for t in texts]


def test_replaced_columns(spark):
    df = spark.createDataFrame([("s", "a;b", 9, "old")], "src string, t string, pos int, item string")
    assert rows(packed.split_packed(df, "src", "t", packed.infer_delimiters(df, "src", "t"))) == [("s", 1, "a"), ("s", 2, "b")]


@settings(max_examples=15, deadline=None, derandomize=True)
@example(['A|"\t"|B'])
@given(st.lists(st.text(alphabet='aB1-. ;|/"\\\t', max_size=12), min_size=1, max_size=20))
def test_against_brute_force(spark, texts):
    assert split(spark, texts) == [brute(t) for t in texts]
