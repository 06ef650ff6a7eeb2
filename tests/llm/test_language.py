from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from gneiss.llm import language
from gneiss.llm.text import bare, repaired

SAMPLE = {
    "en": ["The reader was moved before the plate was measured again", "Nobody had expected that the second run would follow the first one", "We keep both of the readings although the label was torn"],
    "de": ["Der Leser wurde verschoben bevor die Platte noch einmal gemessen wurde", "Niemand hatte erwartet dass der zweite Lauf dem ersten folgen würde", "Wir behalten beide Ablesungen obwohl das Etikett zerrissen war"],
    "fr": ["Le lecteur a été déplacé avant que la plaque ne soit mesurée encore", "Personne ne s'attendait à ce que le deuxième essai suive le premier", "Nous gardons les deux lectures bien que l'étiquette soit déchirée"],
    "ru": ["Прибор переставили до того как пластину измерили ещё раз", "Никто не ожидал что второй опыт пойдёт вслед за первым", "Мы сохраняем оба показания хотя наклейка порвалась"],
}


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(2)
    pairs = [(". ".join(rnd.sample(SAMPLE[x], 3)) + ".", x) for x in SAMPLE for _ in range(12)]
    pairs += [(". ".join(SAMPLE["de"]) + ".", "en")] * 2  # wrong labels
    return language.train([t for t, _ in pairs], [x for _, x in pairs])


def found(spark, model, texts, **kw):
    df = spark.createDataFrame([(i, t, None, 3) for i, t in enumerate(texts)], "doc_id long, text string, lang string, part int")
    parts = language.segments(df, {"doc_id": F.col("doc_id")}, F.col("text"), model, spark)
    return rows(language.languages_of(parts, ["doc_id"], **kw), "doc_id", "lang", "sentences", "n_languages"), rows(parts, "doc_id", "part", "lang", "sentences", "first_sentence")


def say(*codes):
    return " ".join(f"{SAMPLE[c][i % 3]}." for i, c in enumerate(codes))


def test_texts_and_stretches(spark, model):
    texts = [say("en", "en", "en"), say("de", "de", "fr", "fr", "fr", "de", "de"), say("en", "fr", "en", "en"), None, "", "123 45.", say("ru").rstrip("."), say("fr", "fr").upper(), say("de", "de") * 400, say("fr", "fr").encode().decode("latin-1")]
    langs, parts = found(spark, model, texts)
    assert [x for x in langs if x[0] == 0] == [(0, "en", 3, 1)]
    assert sorted(x for x in langs if x[0] == 1) == [(1, "de", 4, 2), (1, "fr", 3, 2)]
    assert [x for x in langs if x[0] == 2] == [(2, "en", 3, 1)], "one foreign sentence is a quotation"
    assert not {3, 4, 5} & {x[0] for x in langs}
    assert [x[1] for x in langs if x[0] in (6, 7, 8, 9)] == ["ru", "fr", "de", "fr"]
    assert [x for x in parts if x[0] == 1] == [(1, 0, "de", 2, 0), (1, 1, "fr", 3, 2), (1, 2, "de", 2, 5)]


def test_scores_are_cosines_of_bundles(model):
    """The table of products over the counted norm gives what bundling the n-gram vectors gives, repeats included."""
    for text in (SAMPLE["fr"][0].lower(), "na " * 200 + SAMPLE["de"][0].lower(), SAMPLE["en"][1].lower() * 30):
        code, n = language._encoded([text])
        bundle = language._gram_vectors(code).astype(float).sum(axis=0)
        table = language.score(model, [text])[0]
        products = np.sum(model.products[model.row_of[code]], axis=0) * np.sqrt(language.DIMENSIONS)
        assert np.allclose(table, products / np.linalg.norm(bundle), atol=0.02), text[:20]
        times = np.unique(code, return_counts=True)[1]
        assert language._squared_counts(code, n).tolist() == [float((times**2).sum())]
    assert language._squared_counts(np.zeros(0, dtype=np.int64), np.zeros(2, dtype=np.int64)).tolist() == [0.0, 0.0]


def test_scores_do_not_depend_on_blocks(model, monkeypatch):
    parts = [SAMPLE[x][i].lower() for x in ("en", "de", "fr") for i in (0, 1)] * 5 + [""]
    whole = language.score(model, parts)
    monkeypatch.setattr(language, "BLOCK_LETTERS", 150)
    assert np.allclose(language.score(model, parts), whole) and language.score(model, []).shape == (0, len(model.languages))


def test_labels(spark):
    given = {"en": "en", "EN-gb": "en", "en_US": "en", "English": "en", " deu ": "de", "ger": "de", "pt-BR": "pt", "castellano": "es", "und": None, "n/a": None, "": None, None: None, "russian": "ru"}
    df = spark.createDataFrame(list(given.items()), "l string, w string")
    assert all(r["g"] == r["w"] for r in df.select("w", language.named_language(F.col("l")).alias("g")).collect())


def test_fit_on_a_bounded_sample(spark):
    data = [(i, say(x, x), x if i % 7 else None, 0) for i, x in enumerate(list(SAMPLE) * 20)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, l int")
    m = language.fit(df, F.col("doc_id"), F.col("text"), F.col("lang"), per_language=5)
    assert m.languages == sorted(SAMPLE)
    empty = language.fit(df.limit(0), F.col("doc_id"), F.col("text"), F.col("lang"))
    assert empty.languages == []
    assert found(spark, empty, ["some text here"]) == ([], [])


def test_cleaning():
    assert repaired("M&NBSP;<B>é</B> CafÃ©").split() == ["m", "é", "café"]
    assert bare("Médiane­ café") == "mediane cafe"
    assert language.sentences("The rank of XY12 moved. The second (n=3) run follows! [GSM1]") == ["the rank of   moved.", "the second   run follows!"]
