"""Languages of documents and their stretches by hyperdimensional letter profiles.

Every letter has a random vector of +1 and -1; an n-gram's vector binds (multiplies) its letters' vectors,
each rotated by its place; a text's vector bundles (adds) those of its n-grams and a language's prototype
those of its training texts. Texts go to the prototype of the greatest cosine. Since the dot product of a
bundle is the sum of those of its n-grams, each n-gram's products with all prototypes are worked out once
and a text is scored by adding table rows, which gives its products without building its vector.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.text import repaired

DIMENSIONS = 4096
GRAM = 3
LEAST_LETTERS = 12
#: Labelled documents per language that the prototypes are trained on.
TRAINING_DOCUMENTS = 400
#: Characters that are scored together: about 100 bytes of working memory each.
BLOCK_LETTERS = 500_000
#: How much one unit of cosine is worth in the confidence.
SHARPNESS = 30.0

#: The names and codes of the languages, regional endings aside.
LANGUAGE_NAMES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "ru": "ru rus russian русский",
}
LETTERS = " abcdefghijklmnopqrstuvwxyzäöüßàâæçéèêëîïôœùûÿñáíóúìòãõабвгдеёжзийклмнопрстуфхцчшщъыьэюя*"
_SYMBOLS = np.zeros(0x10000, dtype=np.int32)
for _cp in range(0x10000):
    _c = chr(_cp)
    if _c.isalpha():
        _SYMBOLS[_cp] = LETTERS.find(_c) if _c in LETTERS else len(LETTERS) - 1
#: Bracketed remarks within a line in which no sentence ends, and words with digits.
_NOISE = re.compile(r"\[(?:[^\[\]\n.!?…]|[.!?…](?!\s))*\]|\((?:[^()\n.!?…]|[.!?…](?!\s))*\)|[^\s]*\d[^\s]*?(?=[.!?…]?(?:\s|$))")
_END = re.compile(r"(?<=[.!?…。])[\"'»”)\]]*\s+|\n\s*\n")


def named_language(label: Column) -> Column:
    """The language that a label names, a regional code included; NULL if it names none."""
    t = F.regexp_replace(F.lower(F.trim(label)), r"[-_][a-z]{2,4}$", "")
    out = F.lit(None).cast("string")
    for code, names in LANGUAGE_NAMES.items():
        out = F.when(t.isin(*names.split()), F.lit(code)).otherwise(out)
    return out


def sentences(text: str) -> list[str]:
    """The sentences of a repaired text, without bracketed remarks and words that hold digits.

    Line ends alone end no sentence; pieces of fewer than ``LEAST_LETTERS`` letters are none.
    """
    cleaned = _END.split(_NOISE.sub(" ", repaired(text)))
    return [s for s in cleaned if sum(map(str.isalpha, s)) >= LEAST_LETTERS]


def _encoded(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of all parts and how many each part has. Runs of non-letters are one blank."""
    text = " " + " ".join(parts) + " "
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    lengths[-1] += 1
    owner = np.repeat(np.arange(len(parts)), lengths)
    s = _SYMBOLS[np.minimum(points, 0xFFFF)]
    kept = (s > 0) | np.concatenate(([True], s[:-1] > 0))
    s, owner = s[kept].astype(np.int64), owner[kept]
    n = max(0, len(s) - GRAM + 1)
    code = np.zeros(n, dtype=np.int64)
    for i in range(GRAM):
        code = code * len(LETTERS) + s[i : i + n]
    # The gram around the blank between two parts has letters of both: a part is scored by itself.
    inner = (s[1 : n + 1] > 0) | (owner[:n] == owner[2 : n + 2])
    return code[inner], np.bincount(owner[1 : n + 1][inner], minlength=len(parts))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    row_of: np.ndarray
    """n-gram code -> row of ``products``; row 0 is for n-grams that training never saw."""
    products: np.ndarray
    """Per n-gram its dot products with the prototypes, over the norms of both."""


def _gram_vectors(codes: np.ndarray, seed: int = 1) -> np.ndarray:
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), (len(LETTERS), DIMENSIONS))
    out = np.ones((len(codes), DIMENSIONS), dtype=np.int8)
    rest = codes.copy()
    for i in range(GRAM):
        out *= np.roll(letters, i, axis=1)[rest % len(LETTERS)]
        rest //= len(LETTERS)
    return out


def _fit(counts: dict[str, np.ndarray], codes: np.ndarray) -> Model:
    languages = sorted(counts)
    weights = np.stack([counts[x] / max(1.0, counts[x].sum()) for x in languages])
    weights = np.sqrt(weights)  # bundles of bundles: a frequent n-gram counts by the root of its share
    prototypes = np.zeros((len(languages), DIMENSIONS))
    step = 4096
    for a in range(0, len(codes), step):
        prototypes += weights[:, a : a + step] @ _gram_vectors(codes[a : a + step]).astype(np.float32)
    prototypes -= prototypes.mean(axis=0)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
    products = np.zeros((len(codes) + 1, len(languages)), dtype=np.float32)
    for a in range(0, len(codes), step):
        products[a + 1 : a + 1 + step] = _gram_vectors(codes[a : a + step]).astype(np.float32) @ prototypes.T / np.sqrt(DIMENSIONS)
    row_of = np.zeros(len(LETTERS) ** GRAM, dtype=np.int32)
    row_of[codes] = np.arange(1, len(codes) + 1)
    return Model(languages, row_of, products)


def train(texts: list[str], labels: list[str], rounds: int = 2) -> Model:
    """Prototypes from labelled texts. After a first fit, texts that go to another language than their label
    are left out of the next, so a share of wrong labels does no harm."""
    parts = [" ".join(sentences(t)) or " " for t in texts]
    code, n = _encoded(parts) if parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    codes, column = np.unique(code, return_inverse=True)
    owner = np.repeat(np.arange(len(parts)), n)
    own = np.array(labels)
    use = np.ones(len(parts), dtype=bool)
    model = Model([], np.zeros(len(LETTERS) ** GRAM, dtype=np.int32), np.zeros((1, 0), dtype=np.float32))
    for _ in range(rounds):
        counts = {}
        for x in sorted(set(labels)):
            rows = (use & (own == x))[owner]
            counts[x] = np.bincount(column[rows], minlength=len(codes)).astype(float)
        if not counts:
            return model
        model = _fit(counts, codes)
        best = np.array(model.languages)[score(model, parts).argmax(axis=1)]
        use = best == own
    return model


def _squared_counts(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum over a part's distinct n-grams of their squared counts, per part."""
    key = np.sort(np.repeat(np.arange(len(n)), n) * len(LETTERS) ** GRAM + code)
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(begins, len(key))).astype(float)
    return np.bincount(key[begins] // len(LETTERS) ** GRAM, weights=times * times, minlength=len(n))


def score(model: Model, parts: list[str]) -> np.ndarray:
    """Cosine of each part with each (centred) prototype. The norm of a part's bundle is the root of the sum of the
    squared counts of its n-grams, whose vectors are taken as orthogonal."""
    out = np.zeros((len(parts), len(model.languages)))
    begin = 0
    while begin < len(parts):
        # As many parts as have BLOCK_LETTERS characters together, at least one.
        end, size = begin + 1, len(parts[begin])
        while end < len(parts) and size + len(parts[end]) <= BLOCK_LETTERS:
            size += len(parts[end])
            end += 1
        code, n = _encoded(parts[begin:end])
        rows = model.products[model.row_of[code]]
        starts = np.cumsum(n) - n
        filled = n > 0
        block = np.zeros((end - begin, len(model.languages)))
        if filled.any():
            block[filled] = np.add.reduceat(rows, starts[filled], axis=0)
        out[begin:end] = block / np.sqrt(np.maximum(_squared_counts(code, n), 1))[:, None]
        begin = end
    return out


def _confidence(cosines: np.ndarray) -> np.ndarray:
    """Cosines as shares that sum to 1."""
    x = np.exp(SHARPNESS * (cosines - cosines.max(axis=-1, keepdims=True)))
    return x / x.sum(axis=-1, keepdims=True)


def _joined(best: np.ndarray, margin: np.ndarray, first: np.ndarray, unsure: float) -> np.ndarray:
    """Labels of sentences where an unsure one between two of the same other language takes that one."""
    inner = np.zeros(len(best), dtype=bool)
    if len(best) > 2:
        same = (best[:-2] == best[2:]) & (best[1:-1] != best[:-2]) & (margin[1:-1] < unsure)
        inner[1:-1] = same & ~first[1:-1] & ~first[2:]
    out = best.copy()
    out[inner] = best[np.flatnonzero(inner) - 1]
    return out


#: Margin of cosines under which a sentence's own language is not trusted against both neighbours.
UNSURE = 0.03
SEGMENTS = "n_sentences bigint, part bigint, first_sentence bigint, sentences bigint, lang string, confidence double"


def _segments(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    for batch in batches:
        model: Model = shared.value
        texts = batch.column(batch.num_columns - 1).to_pylist()
        split = [sentences(t) if t else [] for t in texts]
        split = [s or ([repaired(t)] if t and any(map(str.isalpha, t)) else []) for s, t in zip(split, texts, strict=True)]
        n = np.array([len(s) for s in split], dtype=np.int64)
        if not n.sum() or not model.languages:
            continue
        cosines = score(model, [x for s in split for x in s])
        order = np.sort(cosines, axis=1)
        margin = order[:, -1] - order[:, -2] if cosines.shape[1] > 1 else np.ones(len(cosines))
        doc = np.repeat(np.arange(len(n)), n)
        first = np.concatenate(([True], doc[1:] != doc[:-1]))
        best = _joined(cosines.argmax(axis=1), margin, first, UNSURE)
        begins = np.flatnonzero(first | np.concatenate(([True], best[1:] != best[:-1])))
        size = np.diff(np.append(begins, len(best)))
        mean = np.add.reduceat(cosines, begins, axis=0) / size[:, None]
        owner = doc[begins]
        top = np.concatenate(([True], owner[1:] != owner[:-1]))
        part = np.arange(len(begins)) - np.maximum.accumulate(np.where(top, np.arange(len(begins)), 0))
        starts = np.cumsum(n) - n
        sure = _confidence(mean)[np.arange(len(begins)), best[begins]]
        rest = batch.select(range(batch.num_columns - 1)).take(pa.array(owner))
        yield pa.RecordBatch.from_arrays(
            [
                *rest.columns, pa.array(n[owner]), pa.array(part), pa.array(begins - starts[owner]), pa.array(size),
                pa.array(np.array(model.languages, dtype=object)[best[begins]], pa.string()), pa.array(np.round(sure, 6)),
            ],
            names=[*rest.schema.names, "n_sentences", "part", "first_sentence", "sentences", "lang", "confidence"],
        )


def fit(docs: DataFrame, doc_id: Column, text: Column, label: Column, per_language: int = TRAINING_DOCUMENTS) -> Model:
    """A model trained on at most ``per_language`` documents of each labelled language.

    The sample is taken by hash of the id over the whole table; only ids and labels are ranked, and
    texts are fetched for the chosen ids alone.
    """
    base = docs.select(doc_id.alias("i"), named_language(label).alias("l"), text.alias("t"))
    chosen = (
        base.select("i", "l", F.xxhash64("i").alias("h"))
        .where(F.col("i").isNotNull() & F.col("l").isNotNull())
        .withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h", "i")))
        .where(F.col("k") <= per_language)
        .select("i", "l")
        .distinct()
    )
    picked = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # per_language rows a language at most
    rows = base.where(F.length("t") > 0).join(F.broadcast(picked), ["i", "l"], "left_semi").select("i", "l", "t")
    found = sorted((r["l"], str(r["i"]), r["t"]) for r in rows.collect())
    return train([t for _, _, t in found], [x for x, _, _ in found])


def segments(docs: DataFrame, carried: dict[str, Column], text: Column, model: Model, spark: SparkSession) -> DataFrame:
    """One row per stretch of sentences in one language: the carried columns and ``SEGMENTS``.

    ``part`` counts a text's stretches from 0, ``confidence`` is the share of the winning language
    among all. NULL and empty texts and texts without letters have no stretches. A text in which
    no sentence ends is one sentence. Scoring needs no shuffle.
    """
    base = docs.select(*[c.alias(k) for k, c in carried.items()], text.alias("text")).where(F.length("text") > 0)
    shared = spark.sparkContext.broadcast(model)  # a table of n-grams of a fixed alphabet, a few MB
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(partial(_segments, shared=shared), f"{fields}, {SEGMENTS}")


def languages_of(found: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """One row per text (``keys``) and language with at least ``least`` sentences of it, or with the most
    sentences where none has so many: ``lang``, ``sentences``, ``confidence``, ``n_languages``."""
    each = found.groupBy(*keys, "lang").agg(
        F.sum("sentences").alias("sentences"),
        (F.sum(F.col("confidence") * F.col("sentences")) / F.sum("sentences")).alias("confidence"),
    )
    entry = F.struct("sentences", "confidence", "lang")
    texts = each.groupBy(*keys).agg(F.sort_array(F.collect_list(entry), asc=False).alias("all"))  # one per language
    enough = F.filter("all", lambda x: x["sentences"] >= least)
    kept = F.when(F.size(enough) > 0, enough).otherwise(F.slice("all", 1, 1))
    return texts.select(*keys, F.size(kept).alias("n_languages"), F.explode(kept).alias("x")).select(
        *keys, "x.lang", "x.sentences", "x.confidence", "n_languages"
    )
