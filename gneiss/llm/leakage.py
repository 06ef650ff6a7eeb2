"""Evaluation items inside documents, by winnowed fingerprints.

Both sides are cut into words. Every ``GRAM`` words are hashed and of each ``WINDOW`` neighbouring hashes the
least is kept: a span of GRAM + WINDOW - 1 unchanged words has a window in common, hence a kept hash. Beside it
every gram of two words, any one word, and two words is kept, so a single changed word with two unchanged ones
on each side gives a hit too. A hit is extended where it stands: it goes on only if it lies in a stretch of
``STRETCH`` words in which single changed words are bridged. The diagonals (place in the document less place in
the item) of those hits are compared whole, and stretches that follow one another in the item's order are added up.

Not found: stretches without ``GRAM + WINDOW - 1`` unchanged words in a row in which every changed word also
has a lone unchanged one beside it, as in one-changed-one-changed runs.

Up to ``block_words`` words of items, their index is broadcast and the documents are read once, without any
shuffle. Beyond it the fingerprints of both sides are joined by shuffling; each carries the hashes of the words
around it, so hits are extended right after the join and only the pairs with a stretch fetch their texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.text import bare

GRAM, WINDOW, STRETCH = 4, 2, 8
#: Word places of the grams around one changed word.
GAPPED = (0, 1, 3, 4)
BLOCK_WORDS = 2_000_000
_NONE = np.iinfo(np.uint64).max
_WORD = re.compile(r"[^\W_]+")
#: Cells of a table of diagonals by item places that are looked at together.
_CELLS = 4_000_000
#: Hits that are extended together.
_HITS = 1_000_000


def words(text: str) -> list[str]:
    """Words of the whole text: lower case, without accents, markup and punctuation."""
    return _WORD.findall(bare(text))


def _laid_out(lists: list[list[int]], mark: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lists in one array with STRETCH times ``mark`` before, between and after; where each begins, and its length."""
    gap = [mark] * STRETCH
    flat = list(gap)
    for x in lists:
        flat += x
        flat += gap
    lengths = np.array([len(x) for x in lists], dtype=np.int64)
    begin = np.cumsum(lengths + STRETCH) - lengths
    return np.array(flat, dtype=np.int64), begin, lengths


def _hashes(ids: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A hash of the words at the places of ``shape`` from each place on; ``_NONE`` where one of them is negative."""
    n = len(ids) - shape[-1]
    if n <= 0:
        return np.full(len(ids), _NONE, dtype=np.uint64)
    h = np.full(n, len(shape) * 64 + shape[-1], dtype=np.uint64)
    good = np.ones(n, dtype=bool)
    with np.errstate(over="ignore"):
        for i in shape:
            part = ids[i : i + n]
            good &= part >= 0
            h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    h[~good | (h == _NONE)] = _NONE
    return np.append(h, np.full(shape[-1], _NONE, dtype=np.uint64))


def _winnowed(h: np.ndarray) -> np.ndarray:
    """Places of the least hash of every window, the last of equal ones."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    padded = np.append(h, np.full(WINDOW - 1, _NONE, dtype=np.uint64))
    views = np.stack([padded[i : i + len(h)] for i in range(WINDOW)][::-1])
    least = WINDOW - 1 - views.argmin(axis=0)
    places = np.unique(np.arange(len(h)) + least)
    places = places[places < len(h)]
    return places[h[places] != _NONE]


def _prints(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the kept grams of both shapes."""
    plain, gapped = _hashes(ids, tuple(range(GRAM))), _hashes(ids, GAPPED)
    a, b = _winnowed(plain), np.flatnonzero(gapped != _NONE)
    return np.concatenate((a, b)), np.concatenate((plain[a], gapped[b]))


def _in_stretch(same: np.ndarray) -> np.ndarray:
    """Whether the middle bit of each mask of 2 * STRETCH + 1 word matches lies in a stretch, changed words bridged."""
    run = same | ((same << np.uint32(1)) & (same >> np.uint32(1)))
    for step in (1, 2, 4):
        run &= run >> np.uint32(step)
    return (run & np.uint32(sum(1 << i for i in range(1, STRETCH + 1)))) != 0


@dataclass(frozen=True)
class Index:
    """Fingerprints of a block of items, sorted by hash, and the items' words."""

    vocabulary: dict[str, int]
    item_ids: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    size: np.ndarray
    hash: np.ndarray
    place: np.ndarray


def index(items: list[tuple[int, str]]) -> Index:
    vocabulary: dict[str, int] = {}
    lists = [[vocabulary.setdefault(w, len(vocabulary)) for w in words(t)] for _, t in items]
    ids, start, size = _laid_out(lists, -2)
    at, h = _prints(ids)
    order = np.argsort(h, kind="stable")
    return Index(vocabulary, np.array([i for i, _ in items], dtype=np.int64), ids, start, size, h[order], at[order])


def _stretches(same: np.ndarray) -> np.ndarray:
    """Which cells of each row (diagonal) lie in a stretch; a single False between two True is bridged."""
    bridged = same.copy()
    bridged[:, 1:-1] |= same[:, :-2] & same[:, 2:]
    total = np.cumsum(bridged, axis=1, dtype=np.int32)
    width = same.shape[1]
    out = np.zeros_like(same)
    if width >= STRETCH:
        before = np.concatenate((np.zeros((len(same), 1), dtype=np.int32), total[:, : width - STRETCH]), axis=1)
        full = total[:, STRETCH - 1 :] - before == STRETCH
        for i in range(STRETCH):
            out[:, i : i + full.shape[1]] |= full
    return out


def _in_order(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> int:
    """Most matched words of stretches that rise in item and document. rows: (diagonal, stretch cells, matches)."""
    parts = []
    for shift, inside, same in rows:
        edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            parts.append((int(a), int(b), int(a) + shift, int(b) + shift, int(same[a:b].sum())))
    parts.sort()
    best: list[int] = []
    for i, (a, b, da, db, n) in enumerate(parts):
        most = n
        for j in range(i):
            pa_, pb, pda, pdb, _ = parts[j]
            if pb <= b and pda <= da and pdb <= db:
                lost = max(0, pb - a, pdb - da)
                most = max(most, best[j] + max(0, n - lost))
        best.append(most)
    return max(best, default=0)


def _diagonals(ix: Index, ids: np.ndarray, begin: np.ndarray, share: float) -> np.ndarray:
    """Sorted distinct (text, item, shift) with a hit that lies in a stretch, of the pairs with enough hits.

    A hit accounts for the run it stands in, followed for STRETCH words on either side and taken to go on for three
    times as many where it does not end there; a pair whose hits account for less than
    ``share`` of the item goes no further.
    """
    at, h = _prints(ids)
    order = np.argsort(h)
    at, h = at[order], h[order]
    low, high = np.searchsorted(ix.hash, h, "left"), np.searchsorted(ix.hash, h, "right")
    met = np.flatnonzero(high > low)
    at, low, n = at[met], low[met], (high - low)[met]
    upto = np.cumsum(n)
    of_item = np.repeat(np.arange(len(ix.start)), np.append(np.diff(ix.start), len(ix.ids) - ix.start[-1:]))
    of_text = np.repeat(np.arange(len(begin)), np.append(np.diff(begin), len(ids) - begin[-1:]))
    first_item, first_text = ix.start[0], begin[0]
    low_bits = len(ids) + len(ix.ids)
    found = []
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + _HITS, "right")))
        k = n[first:last]
        total = int(k.sum())
        flat = np.arange(total) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[first:last], k)
        mine, theirs = np.repeat(at[first:last], k), ix.place[flat]
        # A stretch goes on to the left or to the right of the hit, over one changed word at most.
        ahead = (ids[mine - 1] == ix.ids[theirs - 1]) | (ids[mine - 2] == ix.ids[theirs - 2])
        after = np.zeros(total, dtype=bool)
        for j in (GRAM, GRAM + 1, GRAM + 2):
            after |= ids[mine + j] == ix.ids[theirs + j]
        kept = np.flatnonzero(ahead | after)
        mine, theirs = mine[kept], theirs[kept]
        same = np.zeros(len(kept), dtype=np.uint32)
        for j in range(-STRETCH, STRETCH + 1):
            same |= (ids[mine + j] == ix.ids[theirs + j]).astype(np.uint32) << np.uint32(j + STRETCH)
        kept = _in_stretch(same)
        mine, theirs, same = mine[kept], theirs[kept], same[kept]
        pair = of_text[mine - first_text] * len(ix.start) + of_item[theirs - first_item]
        run = same | ((same << np.uint32(1)) & (same >> np.uint32(1)))
        begins, ends, down, up = theirs.copy(), theirs + 1, np.ones(len(run), dtype=bool), np.ones(len(run), dtype=bool)
        for j in range(1, STRETCH + 1):
            down &= (run >> np.uint32(STRETCH - j)) & np.uint32(1) > 0
            up &= (run >> np.uint32(STRETCH + j)) & np.uint32(1) > 0
            begins -= down
            ends += up
        begins, ends = begins - 3 * STRETCH * down, ends + 3 * STRETCH * up  # the run goes on out of sight
        found.append((pair, mine - theirs, begins, ends))
        first = last
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    pair, shift, begins, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(pair):
        return np.zeros((0, 3), dtype=np.int64)
    # Places of the item that the runs of a pair's hits account for, each once.
    order = np.lexsort((begins, pair))
    pair, shift, begins, ends = pair[order], shift[order], begins[order], ends[order]
    head = np.concatenate(([True], pair[1:] != pair[:-1]))
    reach = np.maximum.accumulate(ends + pair * (2 * low_bits)) - pair * (2 * low_bits)
    fresh = np.where(head, ends - begins, np.maximum(0, ends - np.maximum(begins, np.append(0, reach[:-1]))))
    heads = np.flatnonzero(head)
    size = np.diff(np.append(heads, len(pair)))
    enough = np.repeat(np.add.reduceat(fresh, heads) >= share * ix.size[pair[heads] % len(ix.start)], size)
    pair, shift = pair[enough], shift[enough]
    key = np.unique(pair * (2 * low_bits) + shift + low_bits)
    pair, shift = key // (2 * low_bits), key % (2 * low_bits) - low_bits
    text, item = pair // len(ix.start), pair % len(ix.start)
    return np.stack([text, item, shift - begin[text] + ix.start[item]], axis=1)


def overlaps(ix: Index, texts: list[str | None], share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, share of the item's words) of the pairs that reach ``share``; empty where nothing is shared."""
    lists = [[ix.vocabulary.get(w, -1) for w in words(t)] if t else [] for t in texts]
    ids, begin, lengths = _laid_out(lists, -1)
    diagonals = _diagonals(ix, ids, begin, share) if len(ix.hash) and len(texts) else np.zeros((0, 3), dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    if not len(diagonals):
        return none, none, np.zeros(0)
    found: list[tuple[int, int, float]] = []
    width = int(ix.size.max())
    step = max(1, _CELLS // max(1, width))
    cuts = np.flatnonzero(np.any(np.diff(diagonals[:, :2], axis=0) != 0, axis=1)) + 1
    pairs = np.concatenate(([0], cuts, [len(diagonals)]))
    first = 0
    while first < len(pairs) - 1:
        # As many whole (text, item) pairs as fit.
        last = max(first + 1, int(np.searchsorted(pairs, pairs[first] + step, "right")) - 1)
        rows = diagonals[pairs[first] : pairs[last]]
        t, i, d = rows.T
        place = np.arange(width)
        inside = place < ix.size[i][:, None]
        target = d[:, None] + place
        inside &= (target >= 0) & (target < lengths[t][:, None])
        mine = ix.ids[np.minimum(ix.start[i][:, None] + place, len(ix.ids) - 1)]
        same = inside & (ids[np.clip(begin[t][:, None] + target, 0, len(ids) - 1)] == mine)
        covered = _stretches(same)
        heads = pairs[first:last] - pairs[first]
        union = np.logical_or.reduceat(covered & same, heads, axis=0).sum(axis=1)
        for k in np.flatnonzero(union >= share * ix.size[i[heads]]):
            a = heads[k]
            b = heads[k + 1] if k + 1 < len(heads) else len(rows)
            got = _in_order([(int(d[r]), covered[r], same[r]) for r in range(a, b)])
            if got >= share * ix.size[i[a]]:
                found.append((int(t[a]), int(i[a]), got / int(ix.size[i[a]])))
        first = last
    if not found:
        return none, none, np.zeros(0)
    text, item, reached = zip(*found, strict=True)
    return np.array(text), np.array(item), np.array(reached)


def _scan(batches: Iterator[pa.RecordBatch], shared, share: float) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    for batch in batches:
        ix: Index = shared.value
        text, item, reached = overlaps(ix, batch.column(1).to_pylist(), share)
        if len(text):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), pa.array(ix.item_ids[item]), pa.array(np.round(reached, 6))],
                ["doc_id", "item_id", "share"],
            )


class _WordNumbers(dict):
    """Word -> a number of 63 bits, the same in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        n = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1
        self[word] = n
        return n


def _printed(batches: Iterator[pa.RecordBatch], mark: int) -> Iterator[pa.RecordBatch]:
    """(key, h, around) of every fingerprint: ``around`` has the words' numbers, 16 bits each, 0 beyond the text."""
    number = _WordNumbers()
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        for a in range(0, len(texts), 500):
            ids, begin, _ = _laid_out([[number[w] for w in words(t)] for t in texts[a : a + 500]], mark)
            at, h = _prints(ids)
            if not len(at):
                continue
            short = np.where(ids < 0, 0, 1 + ids % 65535).astype(np.uint16)
            around = np.stack([short[at + j] for j in range(-STRETCH, STRETCH + 1)], axis=1)
            owner = np.searchsorted(begin, at, "right") - 1
            width = around.shape[1] * 2
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(at), [None, pa.py_buffer(np.ascontiguousarray(around).tobytes())])
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(a + owner)), pa.array(h.view(np.int64)), packed.cast(pa.binary())], ["key", "h", "around"]
            )


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (doc, item) of joined fingerprints whose surroundings hold a stretch."""
    cells = 2 * STRETCH + 1
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, cells) for i in (2, 3))
        match = (a == b) & (a > 0)
        same = (match.astype(np.uint32) << np.arange(cells, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
        kept = pa.array(np.flatnonzero(_in_stretch(same)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["doc", "item"])


def _compared(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """(doc, item, share) of the pairs of a document's and an item's text that reach ``share``."""
    for batch in batches:
        doc, item = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        reached = []
        for d, i in zip(doc, item, strict=True):
            _, _, got = overlaps(index([(0, i)]), [d], share)
            reached.append(round(float(got[0]), 6) if len(got) else None)
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(reached, pa.float64())], ["doc", "item", "share"])
        yield out.filter(pa.array([r is not None for r in reached]))


def _joined(base: DataFrame, asked: DataFrame, share: float) -> DataFrame:
    """``leaks`` by a shuffled join of the fingerprints; equal texts are compared once."""
    docs = base.withColumn("doc", F.sha2("text", 256))
    items = asked.withColumn("item", F.sha2("t", 256))
    doc_texts, item_texts = docs.groupBy("doc").agg(F.first("text").alias("text")), items.groupBy("item").agg(F.first("t").alias("t"))
    prints = "key string, h bigint, around binary"
    left = doc_texts.select("doc", "text").mapInArrow(partial(_printed, mark=-1), prints).toDF("doc", "h", "around")
    right = item_texts.select("item", "t").mapInArrow(partial(_printed, mark=-2), prints).toDF("item", "h", "there")
    hits = left.join(right, "h").select("doc", "item", "around", "there")
    pairs = hits.mapInArrow(_extended, "doc string, item string").distinct()
    texts = pairs.join(doc_texts, "doc").join(item_texts, "item").select("doc", "item", "text", "t")
    found = texts.mapInArrow(partial(_compared, share=share), "doc string, item string, share double")
    return found.join(docs.select("doc", "doc_id"), "doc").join(items.select("item", F.col("i").alias("item_id")), "item").select("doc_id", "item_id", "share")


def leaks(docs: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column, share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, share): the documents that hold at least ``share`` of an item's words in its order,
    in stretches of ``STRETCH`` words or more.

    Repeated documents and items each count by themselves; NULL or empty texts hold nothing and items
    of fewer than ``STRETCH`` words are never found. Texts are read whole. Items without id are left out.
    Up to about ``block_words`` words of items are broadcast; more are joined by shuffling, with the same rows.
    """
    spark = docs.sparkSession
    asked = items.select(item_id.cast("bigint").alias("i"), item_text.alias("t")).where(F.col("i").isNotNull() & (F.length("t") > 0))
    total = asked.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    base = docs.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text")).where(F.length("text") > 0)
    if total > 6 * block_words:
        return _joined(base, asked, share)
    # About block_words words at most.
    shared = spark.sparkContext.broadcast(index(sorted((r["i"], r["t"]) for r in asked.collect())))
    return base.mapInArrow(partial(_scan, shared=shared, share=share), "doc_id bigint, item_id bigint, share double")
